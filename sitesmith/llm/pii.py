"""PII surrogates: keyed, type-consistent replacements with collision checks, in DataFrame functions only.

A mention is what stands in the text, an entity what it means: a kind and a canonical form.
Mentions of one entity get one surrogate, each in its own format.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitesmith.llm.common import drop_path, new_path, stored, table

KEY = "sitesmith-surrogates"
TITLES = r"(?:Mr|Mrs|Ms|Miss|Herr|Frau|Monsieur|Madame|Señora|Señor|Sra|Sr)"
#: Kinds in order of precedence: at one place the first that matches is taken.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9](?:[A-Za-z0-9.\-]*[A-Za-z0-9])?\.[A-Za-z]{2,24}",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9A-Fa-f]{64}|[0-9A-Fa-f]{40}|[0-9A-Fa-f]{32}|AKIA[0-9A-Z]{16})(?![0-9A-Za-z])",
    "card": r"(?<![0-9])(?:[0-9]{16}|[0-9]{4}(?:[ \-][0-9]{4}){3}|3[47][0-9]{13}|3[47][0-9]{2}[ \-][0-9]{6}[ \-][0-9]{5})(?![0-9])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "phone": r"(?<![0-9])(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{3}\)[ .\-]?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}(?![0-9])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])",
    "name": rf"(?<![\p{{L}}]){TITLES}\.? \p{{Lu}}[\p{{L}}'\-]+(?: \p{{Lu}}[\p{{L}}'\-]+)?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
# Names by script and gender; of two parts the first is a given name. Invented here.
GIVEN = {
    "latin_f": ["Alma", "Bruna", "Clea", "Dora", "Edda", "Flora", "Greta", "Hanna", "Ilse", "Jana", "Klara", "Lena", "Mira", "Nora", "Olga", "Petra"],
    "latin_m": ["Alban", "Bruno", "Cyril", "Denis", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Konrad", "Leo", "Marek", "Nils", "Oskar", "Paul"],
    "cyrillic_f": ["Анна", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Ирина"],
    "cyrillic_m": ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Олег"],
    "greek_f": ["Άννα", "Δάφνη", "Ελένη", "Ζωή", "Ηρώ", "Μαρία", "Νίκη", "Σοφία"],
    "greek_m": ["Άρης", "Γιώργος", "Δήμος", "Ηλίας", "Νίκος", "Πέτρος", "Σταύρος", "Φώτης"],
}
PARTS = {
    "latin": ["al", "ber", "cor", "dan", "el", "fa", "gor", "hal", "in", "jor", "kel", "lam", "mor", "nes", "or", "pel", "ros", "sten", "tor", "ul", "ven", "wal", "yor", "zel"],
    "cyrillic": ["ал", "бор", "вен", "гор", "дар", "ел", "зор", "ким", "лен", "мар", "нов", "ор", "пет", "рос", "сем", "тор"],
    "greek": ["αλ", "βαρ", "γερ", "δαν", "ελ", "ζαν", "θερ", "καλ", "λαμ", "μαρ", "νικ", "παπ", "ρος", "σαρ", "τολ", "φωτ"],
}
FEMALE = r"^(?:Mrs|Ms|Miss|Frau|Madame|Señora|Sra)\b"
#: Kinds whose surrogates are a keyed bijection on the values of their format; the others draw from spaces that grow.
NUMBERS = ("card", "ssn", "phone", "ip")
#: Draws of a number that is itself in the text, after which it is taken all the same: distinct, though in use.
DRAWS = 8


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def kind_of(mention: Column) -> Column:
    """The kind of a mention found by ANY; the order is that of PATTERNS. Null for a number that is no card by its check
    digit and for an address of no host (0, 127 and from 224 on): these are no personal data and stay."""
    whole = [F.when(mention.rlike(rf"\A(?:{p})\z"), F.lit(k)) for k, p in PATTERNS.items() if k not in ("card", "ip")]
    card = F.when(mention.rlike(rf"\A(?:{PATTERNS['card']})\z"), F.when(luhn_valid(mention), "card").otherwise("other"))
    ip = F.when(mention.rlike(rf"\A(?:{PATTERNS['ip']})\z"), F.when(F.substring_index(mention, ".", 1).cast("int").between(1, 126) | F.substring_index(mention, ".", 1).cast("int").between(128, 223), "ip").otherwise("other"))
    kind = F.coalesce(card, ip, *whole, F.lit("name"))
    return F.when(kind != "other", kind)


def luhn_sum(only: Column, odd: int) -> Column:
    """Sum of digits in a text of digits, every second doubled; `odd` is 1 if the last counts as it is."""
    double = lambda d: F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
    values = F.transform(F.split(F.reverse(only), ""), lambda c, i: F.when(c == "", 0).when(i % 2 == odd, double(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def luhn_valid(mention: Column) -> Column:
    return luhn_sum(digits(mention), 1) % 10 == 0


def title_of(mention: Column) -> Column:
    return F.regexp_extract(mention, rf"^{TITLES}\.? ", 0)


def entities(mention: Column, kind: Column) -> Column:
    """The entities of a mention, as an array of (kind, canon).

    Emails and secrets are the same without regard to case; cards, SSNs and phone numbers by
    their digits, of a phone number the last ten; names by their parts: a given name goes with
    the title's gender, a family name with all that bear it.
    """
    one = lambda k, c: F.struct(k.alias("kind"), c.alias("canon"))
    rest = F.substring(mention, F.length(title_of(mention)) + 1, F.length(mention))
    given = F.when(mention.rlike(FEMALE), "given_f").otherwise("given_m")
    name = F.when(rest.contains(" "), F.array(one(given, F.substring_index(rest, " ", 1)), one(F.lit("family"), F.substring_index(rest, " ", -1)))).otherwise(F.array(one(F.lit("family"), rest)))
    canon = (
        F.when(kind == "email", F.lower(mention)).when(kind == "secret", F.when(mention.startswith("AKIA"), mention).otherwise(F.lower(mention)))
        .when(kind == "phone", F.substring(digits(mention), -10, 10)).when(kind.isin("card", "ssn"), digits(mention)).otherwise(mention)
    )
    return F.when(kind == "name", name).otherwise(F.array(one(kind, canon)))


def digest(key: str, *parts: Column) -> Column:
    """512 keyed bits as 128 hex digits."""
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *[p.cast("string") for p in parts], F.lit(key)), 512)


def piece(hexes: Column, at: int | Column, size: int = 4) -> Column:
    return F.conv(F.substring(hexes, at, size), 16, 10).cast("long")


def pick(values: list[str], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


def walked(left: Column, right: Column, a: Column, b: Column, salt: Column, key: str, rounds: int = 8) -> Column:
    """A keyed bijection on pairs (left below a, right below b): rounds of a Feistel walk in which each side is shifted by a hash of the other."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    shift = lambda i, x: piece(digest(key, salt, i, x), 1, 13)
    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, lambda s, i: F.struct(
        F.when(i % 2 == 0, (s["l"] + shift(i, s["r"])) % a).otherwise(s["l"]).alias("l"),
        F.when(i % 2 == 1, (s["r"] + shift(i, s["l"])) % b).otherwise(s["r"]).alias("r")))


def number_surrogate(canon: Column, kind: Column, attempt: Column, key: str) -> Column:
    """Another number of the same kind and format; different numbers of a kind give different ones.

    Cards: the first digit and the length stay, the last is the check digit. SSNs: any.
    Phones: an area code or exchange that can be dialled stays one, the exchange 555 stays. IPs:
    a host's address again.
    """
    cut = lambda at, n: F.substring(canon, at, n).cast("long")
    n = F.length(canon)
    octet = lambda i: F.element_at(F.split(canon, "[.]"), i).cast("long")
    # codes that begin with 2 to 9 are 800, others 200; 555 is left out of the exchanges
    dialled = lambda at: cut(at, 3) >= 200
    area, areas = F.when(dialled(1), cut(1, 3) - 200).otherwise(cut(1, 3)), F.when(dialled(1), 800).otherwise(200)
    fixed = cut(4, 3) == 555
    exch = F.when(fixed, 0).when(dialled(4), cut(4, 3) - 200 - (cut(4, 3) > 555).cast("long")).otherwise(cut(4, 3))
    exchs = F.when(fixed, 1).when(dialled(4), 799).otherwise(200)
    first = octet(1) - 1 - (octet(1) > 127).cast("long")
    half = F.when(n == 16, 7).otherwise(6)
    left = F.when(kind == "card", F.expr("cast(substring(canon, 2, if(length(canon) = 16, 7, 6)) as long)")).when(kind == "ssn", cut(1, 5)).when(kind == "phone", area * exchs + exch).otherwise(first * 256 + octet(2))
    right = F.when(kind == "card", F.substring(canon, -8, 7).cast("long")).when(kind == "ssn", cut(6, 4)).when(kind == "phone", cut(7, 4)).otherwise(octet(3) * 256 + octet(4))
    a = F.when(kind == "card", F.pow(F.lit(10), half).cast("long")).when(kind == "ssn", 100_000).when(kind == "phone", areas * exchs).otherwise(222 * 256)
    b = F.when(kind == "card", 10_000_000).when(kind.isin("ssn", "phone"), 10_000).otherwise(65_536)
    # what stays is part of the salt, so that numbers that differ in it only are not shifted alike
    stays = F.when(kind == "card", F.concat(F.substring(canon, 1, 1), n)).when(kind == "phone", F.concat_ws("-", areas, exchs)).otherwise("")
    w = walked(left, right, a, b, F.concat_ws("|", kind, attempt, stays), key)
    pad = lambda x, k: F.lpad(x.cast("string"), k, "0")
    body = F.concat(F.substring(canon, 1, 1), F.when(n == 16, pad(w["l"], 7)).otherwise(pad(w["l"], 6)), pad(w["r"], 7))
    card = F.concat(body, ((10 - luhn_sum(body, 0) % 10) % 10).cast("string"))
    new_area, new_exch = F.floor(w["l"] / exchs), w["l"] % exchs
    out_exch = F.when(fixed, 555).when(dialled(4), new_exch + 200 + (new_exch + 200 >= 555).cast("long")).otherwise(new_exch)
    phone = F.concat(pad(F.when(dialled(1), new_area + 200).otherwise(new_area), 3), pad(out_exch, 3), pad(w["r"], 4))
    top = F.floor(w["l"] / 256) + 1
    ip = F.concat_ws(".", top + (top > 126).cast("long"), w["l"] % 256, F.floor(w["r"] / 256), w["r"] % 256)
    return F.when(kind == "card", card).when(kind == "ssn", F.concat(pad(w["l"], 5), pad(w["r"], 4))).when(kind == "phone", phone).otherwise(ip)


def word_surrogate(canon: Column, kind: Column, attempt: Column, key: str) -> Column:
    """An email at a reserved example domain, a secret of the same length and alphabet, or a name of the same script and gender.

    Each attempt draws from more: names get another syllable, emails two more digits.
    """
    h = digest(key, kind, canon, attempt)
    syllable = lambda parts, at: pick(parts, piece(h, at))
    local = F.substring_index(canon, "@", 1)
    email = F.concat(
        syllable(PARTS["latin"], 1), syllable(PARTS["latin"], 5), F.when(local.contains("."), F.lit(".")).otherwise(F.lit("")), syllable(PARTS["latin"], 9), syllable(PARTS["latin"], 13),
        F.lpad((piece(h, 17, 12) % F.pow(F.lit(10), 8 + 2 * F.least(attempt, F.lit(3))).cast("long")).cast("string"), 8, "0"), F.lit("@"), pick(["example.com", "example.net", "example.org"], piece(h, 33)),
    )
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    aws = F.concat(F.lit("AKIA"), *[F.substring(F.lit(letters), (piece(h, 1 + 2 * i, 2) % 32 + 1).cast("int"), F.lit(1)) for i in range(16)])
    secret = F.when(canon.startswith("AKIA"), aws).otherwise(F.substring(h, F.lit(1), F.length(canon)))

    def named(script):
        more = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3) + F.least(attempt, F.lit(20))), lambda i: pick(PARTS[script], piece(h, 41 + 3 * i, 3))), "")
        extra = F.array_join(F.transform(F.slice(F.sequence(F.lit(0), F.lit(20)), 1, F.least(attempt, F.lit(20))), lambda i: pick(PARTS[script], piece(h, 41 + 3 * i, 3))), "")
        first = F.when(kind == "given_f", pick(GIVEN[f"{script}_f"], piece(h, 33))).otherwise(pick(GIVEN[f"{script}_m"], piece(h, 33)))
        return F.when(kind == "family", F.initcap(more)).otherwise(F.concat(first, extra))

    name = F.when(canon.rlike(r"\p{IsCyrillic}"), named("cyrillic")).when(canon.rlike(r"\p{IsGreek}"), named("greek")).otherwise(named("latin"))
    return F.when(kind == "email", email).when(kind == "secret", secret).otherwise(name)


def surrogate(canon: Column, kind: Column, attempt: Column, key: str = KEY) -> Column:
    return F.when(kind.isin(*NUMBERS), number_surrogate(canon, kind, attempt, key)).otherwise(word_surrogate(canon, kind, attempt, key))


def mentions(text: str) -> Column:
    return F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(ANY), F.lit(0))


def replacements(found: DataFrame, key: str = KEY) -> DataFrame:
    """Distinct (kind, canon) -> (kind, canon, surrogate): no two entities of a kind share one, and none is itself in the text.

    Numbers are distinct by their bijection at the first draw. An entity whose surrogate is in the text, or which another of
    its kind has drawn too, draws again from what nobody has and no number's first draw is; rounds
    are for these few only. A number still without one after DRAWS rounds, where a format is nearly
    used up, keeps its first draw.
    """
    spark = found.sparkSession
    real = found.select("kind", "canon").distinct().withColumn("attempt", F.lit(0))
    first_path = new_path(spark, "pii-drawn")
    drawn = stored(real.withColumn("surrogate", surrogate(F.col("canon"), F.col("kind"), F.col("attempt"), key)), "pii-drawn", first_path)
    taken = drawn.select("kind", F.col("canon").alias("surrogate"))
    firsts = drawn.where(F.col("kind").isin(*NUMBERS)).select("kind", "canon", "surrogate")
    now, settled, paths, turn = drawn, None, [first_path], 0
    while True:
        # one row a surrogate and task travels; the first of equals wins
        won = now.groupBy("kind", "surrogate").agg(F.min("canon").alias("winner")).join(taken, ["kind", "surrogate"], "left_anti")
        if settled is not None:
            won = won.join(settled.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti").join(firsts.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        both = now.join(won.select("kind", F.col("winner").alias("canon"), F.lit(True).alias("won")), ["kind", "canon"], "left")
        paths.append(new_path(spark, "pii-round"))
        both = stored(both.withColumn("won", F.coalesce("won", F.lit(False))), "pii-round", paths[-1])
        done = both.where("won").select("kind", "canon", "surrogate")
        settled = done if settled is None else settled.unionByName(done)
        turn += 1
        left = both.where("not won").select("kind", "canon", "attempt")
        if turn >= DRAWS:
            kept = firsts.join(left.select("kind", "canon"), ["kind", "canon"], "left_semi")
            settled, left = settled.unionByName(kept), left.where(~F.col("kind").isin(*NUMBERS))
        if left.isEmpty():
            break
        now = left.withColumn("attempt", F.expr("attempt + 1"))
        paths.append(new_path(spark, "pii-drawn"))
        now = stored(now.withColumn("surrogate", surrogate(F.col("canon"), F.col("kind"), F.col("attempt"), key)), "pii-drawn", paths[-1])
    out = stored(settled, "pii-surrogates")
    for path in paths:
        drop_path(spark, path)
    return out


def filled(mention: Column, new: Column) -> Column:
    """mention with its last digits replaced by those of new; other characters and digits before them stay."""
    fixed = F.length(digits(mention)) - F.length(new)
    step = lambda s, c: F.when(c.rlike("[0-9]"), F.struct(
        F.concat(s["t"], F.when(s["k"] < fixed, c).otherwise(F.substring(new, s["k"] - fixed + 1, F.lit(1)))).alias("t"), (s["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(s["t"], c).alias("t"), s["k"].alias("k")))
    return F.aggregate(F.split(mention, ""), F.struct(F.lit("").alias("t"), F.lit(0).alias("k")), step, lambda s: s["t"])


def rendered(mention: Column, kind: Column, parts: Column) -> Column:
    """A mention with surrogates (an array, in the order of entities()) in its format: separators, country code, title and case stay."""
    new = F.element_at(parts, 1)
    shout = (F.upper(mention) == mention) & (F.lower(mention) != mention)
    email = F.when(shout, F.upper(new)).when(F.lower(F.substring(mention, 1, 1)) != F.substring(mention, 1, 1), F.concat(F.upper(F.substring(new, 1, 1)), F.substring(new, F.lit(2), F.length(new)))).otherwise(new)
    secret = F.when(shout & ~mention.startswith("AKIA"), F.upper(new)).otherwise(new)
    return (
        F.when(kind == "email", email).when(kind == "secret", secret).when(kind.isin("card", "ssn", "phone"), filled(mention, new))
        .when(kind == "name", F.concat(title_of(mention), F.array_join(parts, " "))).otherwise(new)
    )


def pseudonymized(docs: DataFrame, key: str = KEY) -> DataFrame:
    """One row per document: doc_id, text with surrogates for what was found, n_entities (mentions), n_distinct.

    An entity has the same surrogate in every document. People are found by a title; in a
    document that names one, the full name and the family name without a title are replaced too.
    Documents without any entity pass as they are; the others are joined with the list of their
    own surrogates and put together again from the text between mentions. Null text stays null. Repeated rows repeat; a repeated
    doc_id with different texts uses the surrogates of all of them. Names are Latin, Cyrillic or Greek; a name in
    another script that has capital letters gets a Latin one. Extra columns are ignored.
    """
    # explode_outer: for a plain explode, or a filter on the size, Spark searches the text a second time
    found = docs.select("doc_id", F.explode_outer(F.array_distinct(mentions("text"))).alias("raw")).where("raw is not null")
    found = stored(found.withColumn("mkind", kind_of(F.col("raw"))).where("mkind is not null"), "pii-mentions")
    raws = stored(found.select("raw", "mkind").distinct().select("raw", "mkind", F.posexplode(entities(F.col("raw"), F.col("mkind"))).alias("at", "e")).select("raw", "mkind", "at", "e.kind", "e.canon"), "pii-entities")
    made = raws.join(replacements(raws, key), ["kind", "canon"]).groupBy("raw", "mkind").agg(F.sort_array(F.collect_list(F.struct("at", "surrogate"))).alias("parts"))
    made = made.withColumn("parts", F.col("parts")["surrogate"]).withColumn("new", rendered(F.col("raw"), F.col("mkind"), F.col("parts")))
    # what a name is without its title: the whole of it, and the family name
    bare = F.substring(F.col("raw"), F.length(title_of(F.col("raw"))) + 1, F.length("raw"))
    also = F.when(F.col("mkind") == "name", F.array_distinct(F.array(F.struct(bare.alias("raw"), F.array_join("parts", " ").alias("new")), F.struct(F.substring_index(bare, " ", -1).alias("raw"), F.element_at("parts", -1).alias("new")))))
    made = made.select("raw", "new", also.alias("also"))
    lists = found.join(made, "raw").groupBy("doc_id").agg(F.collect_set(F.struct("raw", "new")).alias("own"), F.array_distinct(F.flatten(F.collect_set("also"))).alias("also"))
    # longer names first, so that a whole name is not taken for its family name; a name that means two people stays with the first
    also = F.array_sort("also", lambda x, y: F.coalesce(F.nullif(F.length(y["raw"]) - F.length(x["raw"]), F.lit(0)), F.when(x["raw"] < y["raw"], -1).when(x["raw"] > y["raw"], 1).when(x["new"] < y["new"], -1).otherwise(1)))
    lists = lists.withColumn("also", also)
    names = F.array_join(F.transform(F.array_distinct(F.col("also")["raw"]), lambda n: F.concat(F.lit("\\Q"), n, F.lit("\\E"))), "|")
    lists = lists.select(
        F.col("doc_id").alias("__id"), "own", "also",
        F.when(F.size("also") > 0, F.concat(F.lit(ANY + r"|(?<![\p{L}])(?:"), names, F.lit(r")(?![\p{L}])"))).alias("pattern"),
    )
    rows = docs.select("doc_id", "text").join(lists, F.col("doc_id").eqNullSafe(F.col("__id")), "left").drop("__id")
    pattern = F.coalesce("pattern", F.lit(ANY))
    raw = F.regexp_extract_all(F.coalesce("text", F.lit("")), pattern, F.lit(0))
    new_of = lambda e: F.coalesce(F.get(F.filter(F.concat("own", "also"), lambda x: x["raw"] == e), 0)["new"], e)
    text = F.array_join(F.zip_with(F.split("text", pattern, -1), F.transform(raw, new_of), lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")
    known = F.filter(raw, lambda e: F.exists(F.concat("own", "also"), lambda x: x["raw"] == e))
    return rows.select(
        "doc_id", F.when(F.col("own").isNull(), F.col("text")).otherwise(text).alias("text"),
        F.when(F.col("own").isNull(), 0).otherwise(F.size(known)).alias("n_entities"),
        F.when(F.col("own").isNull(), 0).otherwise(F.size(F.array_distinct(F.transform(known, new_of)))).alias("n_distinct"),
    )


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymized(table(spark, sf_dir, "documents"))
