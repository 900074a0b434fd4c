"""PLY files of all three formats, whole and by ranges."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from sitesmith.sources import artefacts, ply


def cloud(n=10):
    return pd.DataFrame({"x": np.arange(n) * 0.5, "y": -np.arange(n) * 1.0, "z": np.ones(n), "r": np.arange(n), "g": 200, "b": 255})


@pytest.mark.parametrize("order", ["<", ">"])
def test_binary(order):
    back = pd.concat(list(ply.parse(ply.ply_bytes(cloud(), order), chunk=3)))
    assert back[["x", "y", "z", "r", "b"]].astype(float).values.tolist() == cloud()[["x", "y", "z", "r", "b"]].astype(float).values.tolist()
    assert back["idx"].tolist() == list(range(10))


def test_ascii_without_colour():
    data = b"ply\nformat ascii 1.0\nelement vertex 2\nproperty double x\nproperty float y\nproperty float z\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n1 2 3\n4 5 6\n3 0 1 1\n"
    back = pd.concat(list(ply.parse(data)))
    assert back["z"].tolist() == [3.0, 6.0] and back["r"].isna().all()


@pytest.mark.parametrize("data", [b"", b"ply\nformat ascii 1.0\nelement vertex 1\nproperty int x\nproperty float y\nproperty float z\nend_header\n1 2 3\n", b"ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nend_header\n1 2 3\n"])
def test_invalid(data):
    with pytest.raises(ply.InvalidPly):
        list(ply.parse(data))


def test_read(spark, tmp_path):
    (tmp_path / "a.ply").write_bytes(ply.ply_bytes(cloud(25)))
    whole = ply.read_ply(spark, str(tmp_path)).orderBy("idx").drop("scan_id").collect()
    parts = ply.read_ply_split(spark, str(tmp_path / "a.ply"), 7).orderBy("idx").drop("scan_id").collect()
    assert len(whole) == 25 and whole == parts


def files(spark, path, **options):
    ply.register(spark)
    return spark.read.format("ply").options(**options).load(path)


@pytest.mark.parametrize("encoding", ["little", "big", "ascii"])
def test_source_reads_by_ranges(spark, tmp_path, encoding):
    """One file in many tasks, the same rows as in one, whatever the ranges."""
    data = ply.file_bytes(cloud(500).assign(idx=np.arange(500)), encoding, True)
    (tmp_path / "scan.ply").write_bytes(data + (b"3 0 1 2\n" if encoding == "ascii" else b"\x03\0\0\0"))  # faces may follow
    want = [(i, i * 0.5, -1.0 * i, 1.0, i % 256, 200, 255) for i in range(500)]
    for size in (1 << 20, 97, 1):
        df = ply.read_scans(spark, str(tmp_path), vertices=min(size, 70) if size > 1 else 7, range_bytes=max(size, 20))
        assert sorted(tuple(r)[1:] for r in df.collect()) == want
    assert df.rdd.getNumPartitions() > 50
    assert files(spark, str(tmp_path)).count() == 500


def test_source_leaves_columns_out(spark, tmp_path):
    (tmp_path / "a.ply").write_bytes(ply.ply_bytes(cloud(25)))
    df = ply.read_scans(spark, f"file://{tmp_path}/a.ply", columns="idx long, z double")
    listed = ply.read_scans(spark, [str(tmp_path / "a.ply"), f"file:{tmp_path}/a.ply"])
    assert listed.count() == 50
    assert df.columns == ["idx", "z"] and df.agg({"z": "sum", "idx": "max"}).first().asDict() == {"sum(z)": 25.0, "max(idx)": 24}


@pytest.mark.parametrize("data", [b"no", b"ply\nformat ascii 1.0\nelement face 1\nend_header\n", b"ply\nformat binary_little_endian 1.0\nelement vertex 9\nproperty float x\nproperty float y\nproperty float z\nend_header\n123"])
def test_source_fails_at_the_header(spark, tmp_path, data):
    (tmp_path / "bad.ply").write_bytes(data)
    with pytest.raises(Exception, match="InvalidPly"):
        files(spark, str(tmp_path)).count()


def test_source_tells_missing_lines(spark, tmp_path):
    data = ply.file_bytes(cloud(50).assign(idx=np.arange(50)), "ascii", False)
    (tmp_path / "short.ply").write_bytes(data[: data.rindex(b"\n", 0, len(data) // 2) + 1])
    with pytest.raises(Exception, match="fewer vertices"):
        ply.read_scans(spark, str(tmp_path), range_bytes=64).collect()
    for cut in (data[: data.rindex(b"\n", 0, len(data) // 2) + 1], data[:-3]):
        (tmp_path / "short.ply").write_bytes(cut)
        with pytest.raises(Exception, match="InvalidPly"):
            files(spark, str(tmp_path)).collect()


def test_writes_are_whole(spark, tmp_path):
    """Scans over several files, rows with and without colours, places with gaps; append and overwrite; nothing else is left."""
    f = cloud(60).assign(scan_id=[i % 2 for i in range(60)], idx=[i // 2 * 3 for i in range(60)]).astype({"r": "Int16", "g": "Int16", "b": "Int16"})
    f.loc[f.index % 5 == 0, ["r", "g", "b"]] = pd.NA
    rows = [(int(t.scan_id), int(t.idx), float(t.x), float(t.y), float(t.z), *(None if pd.isna(v) else int(v) for v in (t.r, t.g, t.b))) for t in f.itertuples()]
    df = spark.createDataFrame(rows, "scan_id int, idx long, x double, y double, z double, r int, g int, b int")
    path = str(tmp_path / "scans")
    for mode in ("append", "overwrite"):
        ply.write_scans(df, path, vertices=9, mode=mode)
        back = sorted((tuple(r) for r in ply.read_scans(spark, path, vertices=4).collect()), key=str)
        assert back == sorted(((str(r[0]), *r[1:]) for r in rows), key=str)
    ply.write_scans(df.where("scan_id = 1"), path, "ascii")
    assert ply.read_scans(spark, path).count() == 90
    assert not [x for x in (tmp_path / "scans").rglob(".part*.ply")]
    empty = str(tmp_path / "none")
    ply.write_scans(df.limit(0), empty)
    (tmp_path / "none").mkdir(exist_ok=True)
    assert ply.read_scans(spark, empty).count() == 0


def test_empty_scene_and_png():
    assert artefacts.glb([])[:4] == b"glTF"
    img = artefacts.annotate(np.full((20, 30, 3), 220, np.uint8), [(2, 8, 10, 15, (255, 0, 0)), (3, 8, 12, 15, (0, 0, 255))])
    assert artefacts.png(img)[1:4] == b"PNG"


def test_a_writer_holds_vertices_as_small_as_in_the_file():
    """A file's rows are kept until it is full: 23 bytes each, a property of their places only where they do not follow each other over all pieces."""
    rows = lambda ids: pd.DataFrame({"scan_id": "a", "idx": ids, **{c: np.arange(len(ids)) + 0.1 for c in "xyz"}, **{c: np.arange(len(ids)) % 256.0 for c in "rgb"}})
    a, b = ply.packed(rows(range(1000, 6000)), True), ply.packed(rows(range(6000, 6010)), True)
    assert a.nbytes == 23 * 5000 and ply.packed(rows(range(10)), False).nbytes == 200
    for encoding, parts, first in (("little", [a, b], True), ("big", [a, b], True), ("ascii", [a, b], True), ("little", [b, a], False)):
        data = b"".join(ply.file_pieces(parts, encoding))
        h = ply.header(data)
        assert h.count == 5010 and (b"comment first 1000" in data[:200]) == first and ("idx" in dict(h.properties)) != first
        got = pd.concat(ply.parse(data))
        want = np.concatenate(parts)
        assert np.allclose(got["x"].to_numpy(), want["x"]) and (got["r"].to_numpy() == want["red"]).all()
