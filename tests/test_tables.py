"""Table functions in SQL: bad tables, nulls, sweeps against all pairs."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.errors import AnalysisException

from sitesmith.operators import tables

FEATURES = "scan_id int, cluster_id int, cx double, cy double, spread_ft double, nx double, ny double, nz double, d double"


def gaps(spark, rows, far):
    tables.register(spark)
    return spark.sql(f"SELECT * FROM measure_gaps(TABLE({{f}}), {far})", f=spark.createDataFrame(rows, FEATURES)).collect()


def test_gaps_of_a_sweep_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(s, k, round(float(x), 1), round(float(y), 1), round(float(w), 2), 0.0, 0.0, 1.0, -2.0) for s in range(3) for k, (x, y, w) in enumerate(rng.random((40, 3)) * [12, 4, 2])]
    rows += [(0, 99, None, 1.0, 1.0, 0.0, 0.0, 1.0, 0.0), (7, 1, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0), (7, 2, 1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)]
    want = set()
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[1] < b[1] and None not in (a[2], b[2]):
                d = math.hypot(a[2] - b[2], a[3] - b[3]) * tables.FEET_PER_METRE
                if round(d, 9) <= 9 and round(d - (a[4] + b[4]) / 2, 9) > 0:
                    want.add((a[0], a[1], b[1], round(d, 6)))
    got = gaps(spark, rows, 9.0)
    assert {(r["scan_id"], r["feature_a"], r["feature_b"], round(r["distance_ft"], 6)) for r in got} == want and len(got) == len(want)
    assert {round(r["ground_ft"], 6) for r in got} == {round(2 * tables.FEET_PER_METRE, 6), 0.0}
    assert gaps(spark, [], 9.0) == []


def test_tables_without_the_columns_are_refused(spark):
    tables.register(spark)
    for call in ("measure_gaps(TABLE(SELECT 1 AS scan_id), 9.0)", "extrude_zone(TABLE(SELECT 1 AS zone_id))", "radiance_grid(TABLE(SELECT 1 AS site_id), 50.0, '2024-03-01', '2024-09-30', 6)"):
        with pytest.raises(AnalysisException, match="lacks"):
            spark.sql(f"SELECT * FROM {call}").collect()


def test_zones_without_a_face_and_areas_without_a_bound(spark):
    tables.register(spark)
    ring = "array(named_struct('x', 0D, 'y', 0D), named_struct('x', 2D, 'y', 0D), named_struct('x', 2D, 'y', 1D))"
    zones = f"SELECT * FROM VALUES ('a', {ring}, 'fills', 12D), ('b', array(named_struct('x', 0D, 'y', 0D)), 'fills', 12D), ('c', null, 'fills', 12D) AS z(zone_id, ring, kind, height_inches)"
    got = spark.sql(f"SELECT zone_id, count(*) AS n, min(az) AS low FROM extrude_zone(TABLE({zones})) GROUP BY zone_id").collect()
    assert [(r["zone_id"], r["n"], round(r["low"], 6)) for r in got] == [("a", 8, round(-4 / 12, 6))]
    areas = "SELECT * FROM VALUES (1, 10D, 10.001D, 20D, 20.001D), (2, null, 10D, 20D, 21D), (3, 5D, 5D, 6D, 6D) AS a(site_id, south, north, west, east)"
    got = spark.sql(f"SELECT site_id, count(*) AS n, max(avg_hours) AS h FROM radiance_grid(TABLE({areas}), 50.0, '2024-06-01', '2024-06-01', 3) GROUP BY site_id ORDER BY site_id").collect()
    assert [(r["site_id"], r["n"]) for r in got] == [(1, 9), (3, 1)] and all(11 < r["h"] < 14 for r in got)
