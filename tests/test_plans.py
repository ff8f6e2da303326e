"""Joins by row are merges: a broadcast of rows goes through the driver, and grows with the table."""

import random

import pytest
from pyspark.sql import functions as F

from lumenfield.operators import photometry, protocols, rounds, shared, spatial


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def written(monkeypatch):
    """The plans of all tables that operators write."""
    plans = []
    for module in (rounds, protocols, spatial, photometry):
        monkeypatch.setattr(module, "settle", lambda df, settle=module.settle: (plans.append(plan_of(df)), settle(df))[1])
    return plans


def places(spark, n=80, names="field_id bigint, ref_id bigint, x double, y double, mag double"):
    r = random.Random(5)
    return spark.createDataFrame([(i % 2, i, r.uniform(0, 60), r.uniform(0, 60), 20.0 + i % 7) for i in range(n)], names)


def test_rounds_broadcast_no_rows(spark, written):
    points = places(spark)
    kept = rounds.thin(points, 9.0, point_id="ref_id", order="mag")
    grouped = rounds.groups(points, 4.0, point_id="ref_id")
    matched = rounds.greedy_edges(points.withColumnRenamed("ref_id", "det_id").withColumn("x", F.col("x") + 0.5), points, 6.0, carry=("mag",))
    assert kept.count() > 0 and grouped.count() == 80 and matched.count() > 0
    assert len(written) > 9 and not [p for p in (*written, *map(plan_of, (kept, grouped, matched))) if "Broadcast" in p]


def test_injection_plan_broadcasts_no_rows(spark, written):
    plan = protocols.injection_plan(places(spark), (20.0, 22.0), {"low": (0, 1), "high": (3, 99)}, batches=1, each=4, attempts=30, most_attempts=300, size=90.0)
    assert plan.count() > 0 and len(written) > 9
    assert not [p for p in (*written, plan_of(plan)) if "Broadcast" in p]


def image(spark, size=60):
    fields = spark.range(2).select(F.col("id").alias("field_id"))
    axis = lambda c: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(size - 1).cast("bigint"))).alias(c)
    return fields.select("field_id", axis("px")).select("field_id", "px", axis("py")).withColumn("v", 1.0 + (F.col("px") * 7 + F.col("py") * 3) % 5)


def lit(spark):
    shape = {"flux": 100.0 + F.col("mag"), "peak": 30.0 + F.col("mag"), "snr": 30.0 + F.col("mag"), "sharpness": F.lit(0.1), "roundness1": F.lit(0.1), "roundness2": F.lit(0.2)}
    return shared.settle(places(spark).withColumns(shape))  # rows of a known small file


def test_render_broadcasts_no_rows(spark):
    out = photometry.render(lit(spark), image(spark), sigma=1.2)
    assert "Broadcast" not in plan_of(out)
    assert out.count() == 2 * 60 * 60 and out.where("model > 0").count() > 1000


def test_stamps_and_fits_broadcast_no_rows(spark, written):
    stars, pixels = lit(spark), image(spark)
    grid = photometry.psf_grid(photometry.psf_stamps(stars, pixels), ["field_id"], F.floor(F.col("x") / 30).cast("int"), 2, least=2)
    fits = photometry.fit_quality(stars, pixels, spark.range(2).selectExpr("id as field_id", "1d as rms"), sigma=1.2)
    assert fits.count() == 80 and grid.count() > 0
    by_row = [p for p in (*written, plan_of(grid), plan_of(fits)) for line in p.splitlines() if "BroadcastHashJoin" in line and ("ref_id" in line or "psf_cell" in line)]
    assert written and not by_row
