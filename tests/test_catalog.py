"""Catalogue operators against DuckDB on the smallest tables, and against plain sequential versions."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from lumenfield.functions import columns
from lumenfield.operators import pixels, rounds, spatial, thresholds
from lumenfield.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(str([repr(r[i] + 0.0) if isinstance(r[i], float) else str(r[i]) for i in order]) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA)
    want = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert plain(got.collect(), got.columns) == plain(want.fetchall(), names)


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def points(spark, n, seed, size=60.0, name="det_id"):
    r = random.Random(seed)
    rows = [(0, i, r.uniform(0, size), r.uniform(0, size), float(r.randrange(10))) for i in range(n)]
    return rows, spark.createDataFrame(rows, f"field_id bigint, {name} bigint, x double, y double, o double")


def test_greedy_edges_equals_sequential(spark):
    a, dets = points(spark, 150, 1)
    b, refs = points(spark, 120, 2, name="ref_id")
    edges = sorted((math.dist(p[2:4], q[2:4]), p[1], q[1]) for p in a for q in b if math.dist(p[2:4], q[2:4]) <= 4)
    used, want = (set(), set()), set()
    for _, i, j in edges:
        if i not in used[0] and j not in used[1]:
            used[0].add(i)
            used[1].add(j)
            want.add((i, j))
    got = {(r["det_id"], r["ref_id"]) for r in rounds.greedy_edges(dets, refs.drop("o"), 4.0, choices=200).collect()}
    assert got == want


def test_thin_equals_sequential(spark):
    a, dets = points(spark, 200, 3)
    kept = []
    for p in sorted(a, key=lambda p: (p[4], p[1])):
        if all(math.dist(p[2:4], q[2:4]) >= 5 for q in kept):
            kept.append(p)
    got = {r["det_id"] for r in rounds.thin(dets, 5.0, point_id="det_id", order="o").collect()}
    assert got == {p[1] for p in kept}


def test_match_is_one_to_one_and_grows_with_radius(spark):
    _, dets = points(spark, 200, 5)
    _, refs = points(spark, 150, 6, name="ref_id")
    counts = []
    for radius in (1.0, 2.0, 4.0):
        m = spatial.match_one_to_one(dets.drop("o"), refs.drop("o"), radius).collect()
        assert len({r["det_id"] for r in m}) == len({r["ref_id"] for r in m}) == len(m)
        counts.append(len(m))
    assert counts == sorted(counts)


def test_empty_tables(spark):
    _, dets = points(spark, 5, 7)
    none = dets.where("1 = 0")
    assert rounds.thin(none, 5.0, point_id="det_id", order="o").count() == 0
    assert rounds.greedy_edges(none, none.withColumnRenamed("det_id", "ref_id"), 4.0).count() == 0
    assert thresholds.choose_threshold(spark.createDataFrame([], "k int, score double, label int"), ["k"]).count() == 0


def test_pairs_of_odd_rows(spark):
    nan = float("nan")
    left = spark.createDataFrame([(0, 1, 1.0, 1.0, 7.0, 9), (0, 1, 1.0, 1.0, 7.0, 9), (0, 2, None, 1.0, 7.0, 9), (0, 3, nan, 1.0, 7.0, 9), (None, 4, 1.0, 1.0, 7.0, 9)], "field_id int, det_id int, x double, y double, d2 double, bucket_x int")
    right = spark.createDataFrame([(0, 5, 2.0, 1.0, 3, 1.0), (None, 6, 1.0, 1.0, 3, 1.0), (0, 7, nan, nan, 3, 1.0)], "field_id int, ref_id int, x double, y double, det_id int, rx double")
    got = spatial.pairs_within(left, right, 2.0)
    assert [tuple(r) for r in got.select("det_id", "ref_id", "rx", "d2", "bucket_x").collect()] == [(1, 5, 2.0, 1.0, 9)] * 2
    assert spatial.pairs_within(left.limit(0), right, 2.0).count() == spatial.pairs_within(left, right.limit(0), 2.0).count() == 0
    far = spatial.nearest_distance(left.select("field_id", "det_id", "x", "y"), right.select("field_id", "x", "y"), left_id="det_id", start=0.25)
    assert {(r["det_id"], r["nearest_px"]) for r in far.collect()} == {(1, 1.0), (2, None), (3, None), (4, None)}


def test_fill_and_bins_of_odd_rows(spark):
    rows = [(0, 0, 0, 5.0), (0, 1, 0, -999.0), (0, 2, 0, None), (0, 3, 0, float("nan")), (1, 0, 0, -999.0), (None, 0, 0, 3.0), (None, 1, 0, -999.0)]
    image = spark.createDataFrame(rows, "field_id int, px int, py int, v double").withColumn("middle", F.lit("mine"))
    got = {(r["field_id"], r["px"]): r["v"] for r in pixels.fill_bad(image).collect()}
    assert got == {(0, 0): 5.0, (0, 1): 5.0, (0, 2): 5.0, (0, 3): 5.0, (1, 0): None, (None, 0): 3.0, (None, 1): None}
    assert pixels.fill_bad(image).columns == image.columns and pixels.fill_bad(image.limit(0)).count() == 0
    bins = spark.createDataFrame([(None,), (float("nan"),), (18.0,)], "m double").select(columns.magnitude_bin(F.col("m")), columns.snr_bin(F.col("m")), columns.density_bin(F.col("m"))).collect()
    assert bins[0] == (None, None, None) and bins[1][:2] == (None, None) and bins[2][:2] == ("V<=18", "10<=SNR<20")


def test_nearest_distance_of_lonely_points(spark):
    rows, near = points(spark, 60, 5)
    some, far = points(spark, 4, 6, size=5.0, name="ref_id")
    got = {r["det_id"]: r["nearest_px"] for r in spatial.nearest_distance(near, far, left_id="det_id", start=1.0).collect()}
    assert all(math.isclose(got[p[1]], min(math.dist(p[2:4], q[2:4]) for q in some)) for p in rows)
