"""Iterative operators: rounds of joins whose state is written to the shared folder after each round.

Joins of a round are merges: the planner takes state for as few rows as its compressed file is small, and would broadcast it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import spatial as S
from .shared import settle


def thin(points: DataFrame, separation: float, *, point_id: str, order: str, keys: Sequence[str] = S.FIELD, inclusive: bool = False) -> DataFrame:
    """Keep points in the order of (``order``, id) that are at least ``separation`` (``inclusive``: more than that) away from all
    kept before them.

    Each point holds the neighbours before it.  It is kept once all of those are gone and goes once one is kept; a round tells
    the undecided ones alone, and only of what the round before decided.  The number of rounds is the longest chain of neighbours
    in descending order, not the number of points.

    Defined results: rows with a null key or id go; a null order comes last, NaN before it; a point with a null or NaN place
    has no neighbours and stays; rows that repeat an id stay or go together; an empty table stays empty; other columns stay."""
    own = settle(_known(points, *keys, point_id).select(*keys, F.col(point_id).alias("i"), F.col(order).alias("o"), "x", "y"))
    near = F.lit(True) if inclusive else F.col("d2") < separation * separation
    met = S.self_pairs(own, separation, keys=keys).where(near).select(*keys, F.col("a.i").alias("i"), F.col("a.o").alias("o"), F.col("b.i").alias("j"), F.col("b.o").alias("p"))
    before = met.where("i <> j and (coalesce(p < o, p is not null) or (p <=> o and j < i))")
    waits = before.groupBy(*keys, "i").agg(F.collect_set("j").alias("before"))
    ids = own.select(*keys, "i").distinct()
    state = settle(ids.join(waits.hint("merge"), [*keys, "i"], "left").select(*keys, "i", "before", F.col("before").isNull().alias("stays"), F.lit(False).alias("goes")))
    kept = state.where("stays").select(*keys, "i")
    while True:
        open_ = state.where("not stays and not goes").select(*keys, "i", F.explode("before").alias("j"))
        told = state.where("stays or goes").select(*keys, F.col("i").alias("j"), "stays")
        met = open_.join(told.hint("merge"), [*keys, "j"], "left")
        state = settle(
            met.groupBy(*keys, "i")
            .agg(F.coalesce(F.bool_or("stays"), F.lit(False)).alias("goes"), F.collect_list(F.when(F.col("stays").isNull(), F.col("j"))).alias("before"))
            .select(*keys, "i", "before", (~F.col("goes") & (F.size("before") == 0)).alias("stays"), "goes")
        )
        if state.isEmpty():
            return points.join(kept.withColumnRenamed("i", point_id).hint("merge"), [*keys, point_id], "left_semi")
        kept = kept.union(state.where("stays").select(*keys, "i"))


def greedy_edges(dets: DataFrame, refs: DataFrame, radius: float = 2.0, *, choices: int = 8, keys: Sequence[str] = S.FIELD, carry: Sequence[str] = ()) -> DataFrame:
    """One-to-one matching with further choices: of the edges from each detection to its nearest ``choices`` references,
    the shortest goes first, both its ends are taken, and so on.  Each round takes every edge that is the shortest at
    both ends, which is what the sequential rule would do with it.  ``carry`` names columns of either table that come along (a
    reference's place as rx and ry), so that a match need not look up its ends again.

    Defined results: rows with a null key, id or place match nothing; equal distances go by det_id, then ref_id; rows that repeat an id
    count as one at their nearest place; empty tables give no rows; other columns take no part."""
    sides = [_known(t, *keys, i).select(*keys, i, "x", "y", *(c for c in carry if c in t.columns and c not in ("x", "y", "rx", "ry"))) for t, i in ((dets, "det_id"), (refs, "ref_id"))]
    met = S.pairs_within(*sides, radius, keys=keys).repartition(*keys, "det_id")  # where the choices of a detection are ranked too
    met = met.groupBy(*keys, "det_id", "ref_id").agg(F.min(F.struct("d2", *carry)).alias("met")).select(*keys, "det_id", "ref_id", "met.*")
    near = F.row_number().over(W.partitionBy(*keys, "det_id").orderBy("d2", "ref_id"))
    whole = settle(met.withColumn("place", near).where(F.col("place") <= choices).select(*keys, "det_id", "ref_id", "d2", "place", *carry))
    names = [*keys, "det_id", "ref_id", "d2"]
    edges, taken, a = whole.select(*names, "place"), None, F.col("place")  # at first a detection's shortest edge is known
    while not edges.isEmpty():
        b = F.row_number().over(W.partitionBy(*keys, "ref_id").orderBy("d2", "det_id", "ref_id"))
        now = settle(edges.withColumns({"a": a, "b": b}).where("a = 1 and b = 1").select(*names))
        taken = now if taken is None else taken.union(now)
        left = edges.join(now.select(*keys, "det_id").hint("merge"), [*keys, "det_id"], "left_anti").join(now.select(*keys, "ref_id").hint("merge"), [*keys, "ref_id"], "left_anti")
        edges = settle(left.select(*names))  # joins put their keys first
        a = F.row_number().over(W.partitionBy(*keys, "det_id").orderBy("d2", "det_id", "ref_id"))
    if taken is None:
        return whole.drop("place")
    return taken if not carry else whole.drop("place").join(taken.select(*keys, "det_id", "ref_id").hint("merge"), [*keys, "det_id", "ref_id"], "left_semi").select(*names, *carry)


def _known(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows without a null among the columns: a null key meets nothing, so it would never leave a round."""
    return rows.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns)))


def groups(points: DataFrame, radius: float, *, point_id: str, keys: Sequence[str] = S.FIELD) -> DataFrame:
    """``points`` with ``group_id``: the least id of the points that chains of steps up to ``radius`` connect.

    Labels fall to the least one around, and then to the label of their label, so chains shorten by half in a round.

    Defined results: every row stays; a null key or id has a null group, a null or NaN place a group of its own; rows that
    repeat an id are one point at all their places; a column ``group_id`` of the input gives way; an empty table stays empty."""
    points = points.drop("group_id")
    own = _known(points, *keys, point_id).select(*keys, F.col(point_id).alias("i"), "x", "y")
    met = S.self_pairs(own, radius, keys=keys).where("a.i <> b.i")
    edges = settle(met.select(*keys, F.col("a.i").alias("i"), F.col("b.i").alias("j")))
    labels = settle(edges.select(*keys, "i").distinct().withColumn("label", F.col("i")))  # a point alone keeps its id
    while True:
        around = edges.join(labels.select(*keys, F.col("i").alias("j"), "label").hint("merge"), [*keys, "j"]).groupBy(*keys, "i").agg(F.min("label").alias("seen"))
        lower = labels.join(around.hint("merge"), [*keys, "i"], "left").select(*keys, "i", "label", F.least("label", F.coalesce("seen", "label")).alias("low"))
        jump = lower.select(*keys, F.col("i").alias("low"), F.col("low").alias("lower"))
        new = settle(lower.join(jump.hint("merge"), [*keys, "low"], "left").select(*keys, "i", F.col("label").alias("old"), F.least("low", F.coalesce("lower", "low")).alias("label")))
        changed = not new.where("old <> label").isEmpty()
        labels = new.drop("old")
        if not changed:
            alone = F.when(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys)), F.col(point_id))
            return points.join(labels.withColumnsRenamed({"i": point_id, "label": "group_id"}).hint("merge"), [*keys, point_id], "left").withColumn("group_id", F.coalesce("group_id", alone))
