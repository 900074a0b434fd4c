"""Table semantics of the store over plain files: tenant scope, updates, cascades, replacement and status moves."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Status moves that are allowed besides any -> draft.
MOVES = [("draft", "quoted"), ("quoted", "approved"), ("approved", "complete")]


def of_tenant(df: DataFrame, tenant) -> DataFrame:
    """Rows of a tenant; every read of tenant data goes through this filter, which reaches the scan."""
    return df.where(F.col("tenant_id") == tenant)


# What a request without a usable tenant header is told.
NO_HEADER = "missing X-Tenant-Id header"
BAD_TEXT = "X-Tenant-Id header is not valid UTF-8"
BAD_ID = "X-Tenant-Id is not a valid UUID"
UUID = "[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}"


def identified(requests: DataFrame, header: str = "tenant_header") -> DataFrame:
    """requests with tenant_id, hyphenated and in lower case, or the error that a bad header gives.

    Ids are taken hyphenated, alone or in braces or after urn:uuid:, or as 32 digits, in either case; text has to be printable ASCII.
    """
    h = F.col(header)
    low = F.lower(h)
    plain = F.when(low.rlike(f"^{UUID}$"), low).when(low.rlike(f"^[{{]{UUID}[}}]$"), F.substring(low, 2, 36)).when(h.startswith("urn:uuid:") & low.rlike(f"^urn:uuid:{UUID}$"), F.substring(low, 10, 36))
    found = F.when(low.rlike("^[0-9a-f]{32}$"), F.regexp_replace(low, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")).otherwise(plain)
    error = F.when(h.isNull(), NO_HEADER).when(~h.rlike(r"^[\t\x20-\x7E]*$"), BAD_TEXT).when(found.isNull(), BAD_ID)
    return requests.withColumn("error", error).withColumn("tenant_id", F.when(F.col("error").isNull(), found))


def of_requests(requests: DataFrame, df: DataFrame, header: str = "tenant_header") -> DataFrame:
    """(request_id, header) -> request_id, status, error, and every row of the tenant's own rows of df: a bad header gives one row with 400, a tenant without rows one with 200.

    One join for all requests; rows are only ever joined by their tenant.
    """
    r = identified(requests, header).withColumn("status", F.when(F.col("error").isNull(), 200).otherwise(400))
    return r.select("request_id", "status", "error", "tenant_id").join(df, "tenant_id", "left")


def owned(changes: DataFrame, df: DataFrame, tenant, key: str) -> DataFrame:
    """Changes to rows that the tenant owns (semi join)."""
    return changes.join(of_tenant(df, tenant).select(key), key, "left_semi")


def updated(df: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """df with the rows of `changes` in place of those with the same key; keys that df lacks are left out."""
    both = df.withColumn("__new", F.lit(False)).unionByName(changes.select(*df.columns).withColumn("__new", F.lit(True)))
    # rows meet once by their key; null keys are nobody's
    known = Window.partitionBy(key)
    both = both.withColumn("__old", F.bool_or(~F.col("__new")).over(known)).withColumn("__hit", F.bool_or("__new").over(known))
    keep = F.when(F.col(key).isNull(), ~F.col("__new")).otherwise(F.when(F.col("__new"), F.col("__old")).otherwise(~F.col("__hit")))
    return both.where(keep).select(*df.columns)


def by_id(df: DataFrame, key: str, value) -> DataFrame:
    """The row of an id, or no row."""
    return df.where(F.col(key) == value)


def listed(df: DataFrame, by: str | list[str], order: list) -> DataFrame:
    """Rows of each `by` group with their place in the group's listing, from 1."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def inserted(new: DataFrame, key: str, natural: list[str], at) -> DataFrame:
    """New rows with an id made from their natural key, so that a task that runs again gives the same, and both time stamps set."""
    name = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in natural])
    return new.withColumns({key: F.md5(name), "created_at": at, "updated_at": at})


def touched(df: DataFrame, changes: DataFrame, key: str, columns: list[str], at) -> DataFrame:
    """df with the given columns of the rows in `changes`, whose updated_at becomes `at`; keys that df lacks are for not_found()."""
    new = changes.select(F.col(key), *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__hit"))
    j = df.join(new, key, "left")
    value = lambda c: F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c)
    stamp = F.when(F.col("__hit"), at).otherwise(F.col("updated_at")).alias("updated_at")
    return j.select(*[stamp if c == "updated_at" else value(c) if c in columns else F.col(c) for c in df.columns])


def zone_changes(changes: DataFrame, zones: DataFrame) -> DataFrame:
    """Changes whose zone belongs to the project they name: both keys have to match."""
    return changes.join(zones.select("project_id", "zone_id"), ["project_id", "zone_id"], "left_semi")


def not_found(df: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    return changes.join(df.select(key), key, "left_anti")


def cascade_delete(gone: DataFrame, key: str, **tables: DataFrame) -> dict[str, DataFrame]:
    """Each table without rows that refer to the deleted keys."""
    return {name: t.join(gone.select(key).distinct(), key, "left_anti") for name, t in tables.items()}


def replaced(df: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """df with all rows of the (keys) groups that `new` has replaced by those of new: a dynamic partition overwrite."""
    return df.join(new.select(*keys).distinct(), keys, "left_anti").select(*df.columns).unionByName(new.select(*df.columns))


def replaced_for(df: DataFrame, targets: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """df with all rows of the target groups replaced by those of new: a target without new rows ends up empty."""
    return df.join(targets.select(*keys).distinct(), keys, "left_anti").select(*df.columns).unionByName(new.join(targets.select(*keys).distinct(), keys, "left_semi").select(*df.columns))


def put_objects(objects: DataFrame, path: str, version: int) -> None:
    """Append (key, data binary) to an object table; a later version of a key takes the place of an earlier one when it is read."""
    objects.select("key", F.col("data").cast("binary").alias("data"), F.lit(version).cast("long").alias("version")).write.mode("append").parquet(path)


def get_objects(spark, path: str) -> DataFrame:
    """The newest version of each object: key, data."""
    return spark.read.parquet(path).groupBy("key").agg(F.max_by("data", "version").alias("data"))


class Conflict(RuntimeError):
    """Another replacement was committed first."""


class Groups:
    """A table on files whose groups (rows of equal keys) are replaced whole and seen at once.

    Rows lie in a folder a write; a manifest, itself a table, names for each group the write that it lives in. A
    replacement writes its rows, then a manifest, and one rename makes that the newest. What was opened
    before goes on with the older one; a group that is replaced by nothing is in no manifest any more. Keys are not null.
    """

    def __init__(self, spark, path: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _store(self):
        return self._at("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest manifest, -1 where there is none."""
        store, at = self._store(), self._at("manifests")
        names = [f.getPath().getName() for f in store.listStatus(at)] if store.exists(at) else []
        return max([int(n[1:]) for n in names if n.startswith("v")], default=-1)

    def manifest(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/manifests/v{version:09d}")

    def replace(self, rows: DataFrame, targets: DataFrame | None = None) -> int:
        """Replace the groups of `targets` (those of rows where it is None) by rows, of which others than the targets' are left out; the new version."""
        version, write = self.version(), f"w{uuid.uuid4().hex}"
        if targets is not None:
            targets = targets.select(*self.keys).distinct()
            rows = rows.join(targets, self.keys, "left_semi").select(*rows.columns)
        rows.write.parquet(f"{self.path}/rows/write={write}")
        mine = self.spark.read.schema(rows.schema).parquet(f"{self.path}/rows/write={write}").select(*self.keys).distinct()
        live = mine.withColumn("write", F.lit(write))
        if version >= 0:
            live = self.manifest(version).join(mine if targets is None else targets, self.keys, "left_anti").unionByName(live)
        live.write.parquet(f"{self.path}/manifests/_{write}")
        self._commit(f"manifests/_{write}", version + 1)
        return version + 1

    def _commit(self, made: str, version: int) -> None:
        store, to = self._store(), self._at(f"manifests/v{version:09d}")
        if store.exists(to) or not store.rename(self._at(made), to):
            store.delete(self._at(made), True)
            raise Conflict(f"version {version} of {self.path} is there already")

    def read(self, schema: str | None = None) -> DataFrame:
        """The rows as of now, and as of now for as long as the result is used."""
        version = self.version()
        if version < 0:
            raise FileNotFoundError(self.path)
        live = self.manifest(version)
        # Spark takes scans of equal root paths for the same, whatever was there when each was listed: so each reads its own writes
        paths = [f"{self.path}/rows/write={w}" for w in self._writes(live)] or [f"{self.path}/rows"]
        rows = self.spark.read.option("basePath", f"{self.path}/rows")
        rows = (rows.schema(f"{schema}, write string") if schema else rows).parquet(*paths)
        return rows.join(live, [*self.keys, "write"], "left_semi").drop("write")

    @staticmethod
    def _writes(manifest: DataFrame) -> list[str]:
        return sorted(r["write"] for r in manifest.select("write").distinct().collect())  # a row a write

    def vacuum(self) -> int:
        """Delete writes that the newest manifest does not name, and older manifests; who still reads these fails."""
        version, store, n = self.version(), self._store(), 0
        live = self._writes(self.manifest(version))
        for f in store.listStatus(self._at("rows")):
            if f.getPath().getName().removeprefix("write=") not in live:
                n += store.delete(f.getPath(), True)
        for f in store.listStatus(self._at("manifests")):
            if f.getPath().getName() != f"v{version:09d}":
                store.delete(f.getPath(), True)
        return n


def conflicts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def status_moves(events: DataFrame, key: str, status: str, order: list[str]) -> DataFrame:
    """Each event with the status before it and whether the move is allowed; a first event has none before."""
    before = F.lag(status).over(Window.partitionBy(key).orderBy(*order))
    pair = F.concat_ws(">", "before", status)
    ok = F.col("before").isNull() | (F.col(status) == "draft") | pair.isin([f"{a}>{b}" for a, b in MOVES])
    return events.withColumn("before", before).withColumn("allowed", ok)


def latest(events: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """The last event's values per key, by max_by: partial aggregation, no window."""
    return events.groupBy(key).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("v")).select(key, *[F.col(f"v.{c}") for c in values])


def category_counts(catalog: DataFrame, categories: list[str]) -> DataFrame:
    """Counts over the whole catalog, zero for known categories without rows."""
    known = catalog.sparkSession.createDataFrame([(c,) for c in categories], "category string")
    return F.broadcast(known).join(catalog.groupBy("category").agg(F.count("*").alias("n")), "category", "left").select("category", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def search(catalog: DataFrame, category: str | None = None, text: str | None = None) -> DataFrame:
    """By category and by a part of the name in any case."""
    out = catalog if category is None else catalog.where(F.col("category") == category)
    return out if not text else out.where(F.lower("name").contains(text.lower()))


def allowed_requests(requests: DataFrame, origins: list[str], methods: list[str], prefix: str) -> DataFrame:
    return requests.where(F.col("origin").isin(origins) & F.col("method").isin(methods) & F.col("path").startswith(prefix))
