"""What composed protocols shuffle, and that repeated rows count as they did."""

import re

from lumenfield.operators import protocols, routing, spatial
from tests.test_copies import plan

PLACES = [(0, i, float(3 * (i % 7)), float(2 * (i // 7)), 50.0 + i, 1.0) for i in range(40)] + [(0, 3, 9.0, 0.0, 53.0, 1.0), (0, None, 1.0, 1.0, 5.0, 1.0), (0, 90, None, 1.0, 5.0, 1.0), (None, 91, 1.0, 1.0, 5.0, 1.0)]


def places(spark):
    return spark.createDataFrame(PLACES, "field_id int, det_id int, x double, y double, flux double, psf_fit_quality double")


def test_counts_of_one_table_equal_those_of_two(spark):
    rows = places(spark)
    one = spatial.neighbour_counts(rows, rows, {"n": 4.0}, point_id="det_id", other_id="det_id")
    two = spatial.neighbour_counts(rows, rows.select("*"), {"n": 4.0}, point_id="det_id", other_id="det_id")
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    assert "ReusedExchange" in plan(one) and "Broadcast" not in plan(one)


def test_quality_catalogue_shuffles_its_sources_once_for_two_joins(spark):
    from pyspark.sql import functions as F

    rows = places(spark)
    initial = rows.selectExpr("field_id", "det_id as ref_id", "x + 0.5 as x", "y", "0.5d as p").where("ref_id % 2 = 0")
    image = spark.createDataFrame([(0, px, py, 900.0 if (px, py) == (9, 2) else 1.0) for px in range(20) for py in range(12)], "field_id int, px int, py int, v double")
    out = protocols.blind_quality_catalogue(rows, initial, image, rms=50.0, probability=F.col("p"))
    got = out.collect()
    final = plan(out).split("Initial Plan")[0].splitlines()  # exchanges are reused as it runs
    assert sum("Exchange hashpartitioning" in x and "bucket_x" in x and "Reused" not in x for x in final) <= 4 and not any("Broadcast" in x for x in final)
    alone = {r["det_id"]: r for r in got if r["det_id"] != 3}
    assert len(alone) == 42 and sum(r["det_id"] == 3 for r in got) == 8  # two rows of one id met two counts and two cores
    for f, i, x, y, *_ in PLACES:
        if i is not None and i != 3 and f == 0 and x is not None:
            near = sum(p[0] == 0 and p[1] not in (None, i) and p[2] is not None and (p[2] - x) ** 2 + (p[3] - y) ** 2 <= 100 for p in PLACES)
            assert alone[i]["neighbours"] == near and alone[i]["saturation_neighbour_flag"] == ((x - 9) ** 2 + (y - 2) ** 2 <= 100)
    assert alone[None]["neighbours"] == alone[90]["neighbours"] == alone[91]["neighbours"] == 0 and alone[90]["deblend_flag"]


def test_merge_meets_proposals_once_and_never_by_broadcast(spark, monkeypatch):
    seen, settle = [], routing.settle
    monkeypatch.setattr(routing, "settle", lambda df: seen.append(plan(df)) or settle(df))
    rows = places(spark).drop("psf_fit_quality")
    out = routing.merge(rows, rows, rows.selectExpr("field_id", "det_id + 100 as det_id", "x + 30 as x", "y", "flux"))
    assert out.count() > 0 and len(seen) == 2 and not any("Broadcast" in p for p in seen)
    assert len(re.findall(r"(?<!Reused)Exchange hashpartitioning\([^)]*bucket_x", seen[1])) == 2


def test_crowded_without_a_near_proposal_is_no_fallback(spark):
    spots = spark.createDataFrame([(0, i, 5.0 + i, 0.0) for i in range(4)], "field_id int, det_id int, x double, y double")
    fits = spots.selectExpr("*", "cast(null as double) as flux")
    far, near = (0, 50, 0.0, 0.0, 9.0), (0, 51, 5.5, 0.5, 9.0)  # four proposals within ten pixels, the nearest five or less than one away
    out = routing.merge(spots, fits, spark.createDataFrame([far, near], "field_id int, det_id int, x double, y double, flux double"))
    assert [(r["det_id"], r["route"]) for r in out.collect()] == [(51, "fallback")]
