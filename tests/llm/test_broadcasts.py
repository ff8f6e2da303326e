"""Joins whose planner would send a table through the driver."""

from pyspark.sql import functions as F

from lumenfield.llm import context_tree as C


def test_levels_of_the_tree_are_merged_not_broadcast(spark, monkeypatch):
    plans, stash = [], C.stash
    monkeypatch.setattr(C, "stash", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stash(df))
    runs = spark.range(600).select((F.col("id") * 7919 % (1 << 24)).alias("run"), F.lit(2).alias("n"))
    known = C.log_probabilities(runs, 2)
    assert sum("Join" in p for p in plans) == 2 and known.count() == 600
    assert not any("Broadcast" in p for p in [*plans, known._jdf.queryExecution().executedPlan().toString()])


def test_chunks_fetch_their_values_by_merge(spark):
    docs = spark.range(40).selectExpr("id as doc_id", "concat('text ', id, ' of words') as text")
    scored = C.scores(docs, depth=2, chunk_bytes=200, broadcast_runs=0)
    assert "Broadcast" not in scored._jdf.queryExecution().executedPlan().toString() and scored.count() == 40
