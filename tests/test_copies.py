"""Joins of rows that ``explode`` has copied: their size is no guess of the planner's, and pixels stay where their field is."""

import re

from lumenfield.operators import photometry, pixels, rounds, selection, spatial
from lumenfield.sources.derived import Tables

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_are_merged_not_broadcast(spark):
    rows = [(0, i, float(x), float(y)) for i, (x, y) in enumerate((a, b) for a in range(-9, 10, 3) for b in range(-9, 10, 3))]
    left = spark.createDataFrame(rows, "field_id int, i int, x double, y double")
    met = spatial.pairs_within(left, left.withColumnRenamed("i", "j"), 3.0)
    assert "Broadcast" not in plan(met)
    want = sorted((p[1], q[1]) for p in rows for q in rows if (p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2 <= 9)
    assert sorted((r["i"], r["j"]) for r in met.collect()) == want


def test_self_pairs_are_shuffled_once(spark):
    rows = [(k, i, x / 4, y / 4) for k in (0, 1) for i, (x, y) in enumerate((a, b) for a in range(-30, 31, 3) for b in range(-12, 13, 3))]
    rows += [(0, 900, 0.0, 0.0), (0, 901, 0.0, 0.0), (0, 902, None, 0.0), (0, 903, float("nan"), 0.0), (None, 904, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "field_id int, i int, x double, y double")
    met = spatial.self_pairs(df, 1.5)
    got = sorted((r["field_id"], r["a"]["i"], r["b"]["i"]) for r in met.collect())
    places = [p for p in rows if None not in p and p[2] == p[2]]
    assert got == sorted((p[0], p[1], q[1]) for p in places for q in places if p[0] == q[0] and (p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2 <= 1.5**2)
    assert "ReusedExchange" in plan(met) and "Broadcast" not in plan(met)


def test_rows_are_not_broadcast_for_their_counts(spark):
    refs = Tables(spark, DATA).refs
    for df in (spatial.local_density(refs), spatial.has_neighbour(refs, refs, 5.0, left_id="ref_id"), selection.nearest_other(refs, 5.0, point_id="ref_id"), rounds.thin(refs, 5.0, point_id="ref_id", order="mag")):
        assert "Broadcast" not in plan(df)


def test_copies_of_the_left_side(spark):
    rows = [(0, i, x / 3, y / 3) for i, (x, y) in enumerate((a, b) for a in range(-20, 21, 5) for b in range(-20, 21, 5))]
    df = spark.createDataFrame(rows, "field_id int, i int, x double, y double")
    both = [sorted((r["i"], r["j"]) for r in spatial.pairs_within(df, df.withColumnRenamed("i", "j"), 2.5, copy_left=c).collect()) for c in (False, True)]
    assert both[0] == both[1] and len(both[0]) > len(rows)


def test_greedy_edges_carry_columns(spark):
    dets = spark.createDataFrame([(0, 1, 0.0, 0.0, 5.0), (0, 2, 0.4, 0.0, 6.0), (0, 3, 9.0, 9.0, 7.0), (0, 4, None, 0.0, 8.0)], "field_id int, det_id int, x double, y double, flux double")
    refs = spark.createDataFrame([(0, 7, 0.1, 0.0, 20.0), (0, 8, 1.5, 0.0, 21.0)], "field_id int, ref_id int, x double, y double, mag double")
    got = rounds.greedy_edges(dets, refs, carry=("x", "flux", "rx", "mag"))
    assert sorted((r["det_id"], r["ref_id"], r["x"], r["flux"], r["rx"], r["mag"]) for r in got.collect()) == [(1, 7, 0.0, 5.0, 0.1, 20.0), (2, 8, 0.4, 6.0, 1.5, 21.0)]
    assert rounds.greedy_edges(dets.where("false"), refs, carry=("flux",)).collect() == []


def test_groups_leave_lone_points_out_of_rounds(spark):
    rows = [(0, 1, 0.0, 0.0), (0, 2, 1.0, 0.0), (0, 3, 9.0, 0.0), (0, 4, None, 0.0), (None, 5, 0.0, 0.0), (0, None, 0.0, 0.0)]
    got = rounds.groups(spark.createDataFrame(rows, "field_id int, ref_id int, x double, y double"), 1.0, point_id="ref_id")
    assert {(r["field_id"], r["ref_id"]): r["group_id"] for r in got.collect()} == {(0, 1): 1, (0, 2): 1, (0, 3): 3, (0, 4): 4, (None, 5): None, (0, None): None}


def test_patches_over_tiles(spark):
    image = [(0, x, y, None if (x + y) % 5 == 0 else float(100 * x + y)) for x in range(-40, 41) for y in range(-40, 41)] + [(0, 3, 3, 7.0)]
    stars = [(0, 1, 0.5, 1.5), (0, 2, -31.6, 33.0), (0, 3, 40.0, -40.0), (None, 4, 0.0, 0.0)]
    df = pixels.around(spark.createDataFrame(stars, "field_id int, ref_id int, x double, y double"), spark.createDataFrame(image, "field_id int, px int, py int, v double"), 4)
    assert "Broadcast" not in plan(df)
    got = sorted((r["ref_id"], r["px"], r["py"], r["dx"], r["dy"], str(r["v"])) for r in df.collect())
    assert got == sorted((s[1], p[1], p[2], p[1] - round(s[2]), p[2] - round(s[3]), str(p[3])) for s in stars for p in image if s[0] == p[0] and max(abs(p[1] - round(s[2])), abs(p[2] - round(s[3]))) <= 4)


def test_pixels_stay_with_their_field(spark):
    image = Tables(spark, DATA).pixels
    shifts = image.select("field_id").distinct().selectExpr("field_id", "0 as exposure", "0.5d as dx", "0.5d as dy")
    for df in (pixels.fill_bad(image), pixels.best_crop(image, 50), photometry.subtract_local_sky(image), photometry.coadd(image.selectExpr("*", "0 as exposure"), shifts)):
        assert not re.search(r"Exchange hashpartitioning\([^)]*(px|py|tile_x|cx)#", plan(df)) and "Broadcast" not in plan(df)
