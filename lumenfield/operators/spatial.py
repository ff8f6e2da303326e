"""Spatial joins as bucketed equi-joins.

Both sides are cut into square buckets four times as wide as the search radius; the side named ``right`` is copied into all
buckets that its reach touches, 2.25 on average, and pairs meet by (keys, bucket) with the distance as a residual predicate.  The
work follows the number of neighbours, a bucket is a fine join key, and dense cores are spread over many of them.  The join is a
merge: the planner knows no size of copied rows and would broadcast them.  So are joins by row: it takes rows for as few as their
compressed file is small, and the driver would hold millions.
Equal distances are settled by id, so results do not depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import cell, square
from .shared import settle

FIELD = ("field_id",)
#: Width of a bucket in radii: wider ones copy fewer rows and compare more pairs.
WIDTH = 4.0


def distance2(x: str | Column = "x", y: str | Column = "y", rx: str | Column = "rx", ry: str | Column = "ry") -> Column:
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return square(col(x) - col(rx)) + square(col(y) - col(ry))


def pairs_within(left: DataFrame, right: DataFrame, radius: float, *, keys: Sequence[str] = FIELD, copy_left: bool = False, width: float | None = None) -> DataFrame:
    """All pairs at most ``radius`` apart: the columns of ``left``, those of ``right`` with x and y renamed to rx and
    ry, and the squared distance d2.  With ``copy_left`` the rows of ``left`` are those copied, for a left side of fewer rows.
    Joins of equal bucket ``width`` shuffle one left side once.

    Defined results: a null or NaN coordinate or a null key pairs with nothing; repeated rows pair one by one; an empty side gives
    no rows; columns of ``left`` named rx, ry or d2 give way, and so do those of ``right`` that ``left`` or the result has."""
    a = left.drop(*(c for c in left.columns if c.lower() in ("rx", "ry", "d2")))
    taken = {c.lower() for c in (*a.columns, "rx", "ry", "d2")} - {k.lower() for k in keys}
    b = right.drop(*(c for c in right.columns if c.lower() in taken - {"x", "y"})).withColumnsRenamed({"x": "rx", "y": "ry"})
    own = [free_name(a, n, b) for n in ("bucket_x", "bucket_y")]
    size = width or (WIDTH * radius if radius > 0 else 1.0)
    a, b = a.where(~(F.isnan("x") | F.isnan("y"))), b.where(~(F.isnan("rx") | F.isnan("ry")))
    reach = lambda c: radius + 1e-9 * (F.abs(c) + radius)  # noqa: E731  rounding must not part a pair at just the radius
    for n, c, rc in zip(own, "xy", ("rx", "ry"), strict=True):
        one, many = (lambda c: cell(F.col(c), size)), (lambda c: F.explode(F.sequence(cell(F.col(c) - reach(c), size), cell(F.col(c) + reach(c), size))))
        a, b = a.withColumn(n, (many if copy_left else one)(c)), b.withColumn(n, (one if copy_left else many)(rc))
    met = a.join(b.hint("merge"), [*keys, *own]).drop(*own)
    return met.withColumn("d2", distance2()).where(F.col("d2") <= radius * radius)


def self_pairs(points: DataFrame, radius: float, *, keys: Sequence[str] = FIELD) -> DataFrame:
    """All ordered pairs of rows of one table at most ``radius`` apart, those of a row with itself among them: keys, ``a`` and ``b``
    (the other columns of either row, x and y among them) and d2.  Nulls and NaN as in ``pairs_within``.

    A row goes to the buckets from its place less the radius up to its own, 1.56 on average, and a pair meets in the bucket
    of its least x and y, which both have.  The two sides are the same rows, so they are shuffled once."""
    size = WIDTH * radius if radius > 0 else 1.0
    held = points.where(~(F.isnan("x") | F.isnan("y"))).select(*keys, F.struct(*(c for c in points.columns if c not in keys)).alias("row"))
    for n, c in (("bucket_x", "row.x"), ("bucket_y", "row.y")):
        reach = radius + 1e-9 * (F.abs(c) + radius)
        held = held.withColumn(n, F.explode(F.sequence(cell(F.col(c) - reach, size), cell(F.col(c), size))))
    on = [*keys, "bucket_x", "bucket_y"]
    a, b = held.alias("a"), held.alias("b")
    met = a.join(b.hint("merge"), reduce(and_, (F.col(f"a.{k}") == F.col(f"b.{k}") for k in on)))
    met = met.select(*(F.col(f"a.{k}") for k in on), F.col("a.row").alias("a"), F.col("b.row").alias("b"))
    least = {n: cell(F.least(F.col(f"a.{c}"), F.col(f"b.{c}")), size) for n, c in (("bucket_x", "x"), ("bucket_y", "y"))}
    met = met.where(reduce(and_, (F.col(n) == e for n, e in least.items())))
    return met.select(*keys, "a", "b", distance2("a.x", "a.y", "b.x", "b.y").alias("d2")).where(F.col("d2") <= radius * radius)


def free_name(df: DataFrame, base: str, *others: DataFrame) -> str:
    """``base``, or the first of base_1, base_2, ... that no table has as a column."""
    taken, name, n = {c.lower() for t in (df, *others) for c in t.columns}, base, 0
    while name.lower() in taken:
        n += 1
        name = f"{base}_{n}"
    return name


def nearest(left: DataFrame, right: DataFrame, radius: float, *, left_id: str, right_id: str, keys: Sequence[str] = FIELD, within: Sequence[str] = (), width: float | None = None) -> DataFrame:
    """For each row of ``left`` its nearest row of ``right`` within the radius; with ``within``, the nearest in each
    group of those columns of ``right``.

    Defined results: rows with a null id are one row to choose for; ties go to the least right id; else as ``pairs_within``."""
    return _first(pairs_within(left, right, radius, keys=keys, width=width), [*keys, *within, left_id], "d2", right_id)


def _first(rows: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """The first row of each key; no column of the input is lost."""
    place = free_name(rows, "place")
    return rows.withColumn(place, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(place) == 1).drop(place)


def match_one_to_one(dets: DataFrame, refs: DataFrame, radius: float = 2.0, *, det_id: str = "det_id", ref_id: str = "ref_id", keys: Sequence[str] = FIELD, within: Sequence[str] = ()) -> DataFrame:
    """Each detection proposes its nearest reference; of the proposals to a reference the closest one wins, and a loser
    has no second choice.  As every detection owns one proposal, this is the greedy rule by (distance, det, ref).

    Defined results: as ``nearest``; equal distances go to the least detection."""
    proposals = nearest(dets, refs, radius, left_id=det_id, right_id=ref_id, keys=keys, within=within)
    return _first(proposals, [*keys, *within, ref_id], "d2", det_id)


def match_masks(dets: DataFrame, refs: DataFrame, radius: float = 2.0, *, det_id: str = "det_id", ref_id: str = "ref_id", keys: Sequence[str] = FIELD) -> DataFrame:
    """Every row of both sides of a one-to-one match: keys, side ("detection" or "reference"), id and whether it is matched.

    Defined results: repeated rows of one id share their flag and stay apart; rows with a null id are never matched."""
    pairs = match_one_to_one(dets.select(*keys, det_id, "x", "y"), refs.select(*keys, ref_id, "x", "y"), radius, det_id=det_id, ref_id=ref_id, keys=keys)
    sides = []
    for rows, name, side in ((dets, det_id, "detection"), (refs, ref_id, "reference")):
        hit = pairs.select(*keys, F.col(name).alias("id"), F.lit(True).alias("hit")).where("id is not null").distinct()
        marked = rows.select(*keys, F.col(name).alias("id")).join(hit.hint("merge"), [*keys, "id"], "left")
        sides.append(marked.select(*keys, F.lit(side).alias("side"), "id", F.coalesce("hit", F.lit(False)).alias("matched")))
    return sides[0].unionByName(sides[1])


def neighbour_counts(points: DataFrame, others: DataFrame, radii: dict[str, float], *, point_id: str, other_id: str | None = None, keys: Sequence[str] = FIELD) -> DataFrame:
    """``points`` with one count for each name in ``radii``.  With ``other_id``, rows of equal id do not count."""
    most = max(radii.values())
    if others is points and other_id == point_id:  # the same rows on both sides are shuffled once
        met = self_pairs(points.select(*keys, point_id, "x", "y"), most, keys=keys).where(F.col(f"a.{point_id}") != F.col(f"b.{point_id}")).select(*keys, F.col(f"a.{point_id}").alias(point_id), "d2")
    else:
        right = others.select(*keys, F.col("x"), F.col("y"), *([F.col(other_id).alias("neighbour_id")] if other_id else []))
        met = pairs_within(points.select(*keys, point_id, "x", "y"), right, most, keys=keys)
        if other_id:
            met = met.where(F.col(point_id) != F.col("neighbour_id"))
    counted = met.groupBy(*keys, point_id).agg(*(F.count_if(F.col("d2") <= r * r).alias(n) for n, r in radii.items()))
    return points.join(counted.hint("merge"), [*keys, point_id], "left").fillna(0, list(radii))


def local_density(refs: DataFrame, radius: float = 10.0, *, ref_id: str = "ref_id", keys: Sequence[str] = FIELD, name: str = "neighbours") -> DataFrame:
    """``refs`` with the number of other references within the radius."""
    return neighbour_counts(refs, refs, {name: radius}, point_id=ref_id, other_id=ref_id, keys=keys)


def has_neighbour(left: DataFrame, right: DataFrame, radius: float, *, left_id: str, keys: Sequence[str] = FIELD, negate: bool = False) -> DataFrame:
    """The rows of ``left`` with (or, negated, without) a row of ``right`` within the radius."""
    met = pairs_within(left.select(*keys, left_id, "x", "y"), right.select(*keys, "x", "y"), radius, keys=keys).select(*keys, left_id).distinct()
    return left.join(met.hint("merge"), [*keys, left_id], "left_anti" if negate else "left_semi")


def closest_pair(left: DataFrame, right: DataFrame, *, left_id: str, right_id: str, start: float = 32.0, keys: Sequence[str] = FIELD) -> DataFrame:
    """For each key the closest two rows of different id: keys, ``left_id``, ``right_id``, d2; ties go to the least ids.

    Rings double until every key that both sides have has a pair or a ring holds everything.  Defined results: null keys and null or NaN
    places pair with nothing; keys without a pair have no row."""
    a, b = (t.select(*keys, i, "x", "y").where(~(F.isnan("x") | F.isnan("y"))) for t, i in ((left, left_id), (right.withColumnRenamed(right_id, f"{right_id}_met"), f"{right_id}_met")))
    there = b.select(*keys).distinct()
    todo = a.join(there, list(keys), "left_semi")
    extent = a.select("x", "y").union(b.select("x", "y")).agg(F.max("x") - F.min("x") + F.max("y") - F.min("y")).collect()[0][0] or 0.0
    found, radius = None, start
    while True:
        met = pairs_within(todo, b, radius, keys=keys).where(F.col(left_id) != F.col(f"{right_id}_met"))
        best = met.groupBy(*keys).agg(F.min(F.struct("d2", left_id, f"{right_id}_met")).alias("best"))
        ring = settle(best.select(*keys, F.col(f"best.{left_id}").alias(left_id), F.col(f"best.{right_id}_met").alias(f"{right_id}_met"), F.col("best.d2").alias("d2")))
        found = ring if found is None else found.union(ring)
        if radius > extent:
            return found
        todo = settle(todo.join(ring, list(keys), "left_anti"))
        if todo.isEmpty():
            return found
        radius *= 2


def nearest_distance(left: DataFrame, right: DataFrame, *, left_id: str, start: float = 32.0, keys: Sequence[str] = FIELD, other_id: str | None = None) -> DataFrame:
    """``left`` with ``nearest_px``, the distance to the nearest row of ``right`` however far it is (null if the keys have
    none, or the place is null or NaN).  Rings widen fourfold until all are settled whose keys have a row: a ring twice the extent
    of both tables reaches everything.  The right side and each ring are written to the shared folder, so that nothing is worked
    out twice; rows still to settle are few after the first ring, and it is those that are copied to the buckets around."""
    right = right.select(*keys, "x", "y", *([F.col(other_id).alias("neighbour_id")] if other_id else []))
    own = F.col(left_id) != F.col("neighbour_id") if other_id else F.lit(True)
    right = settle(right.where(~(F.isnan("x") | F.isnan("y"))))
    there = right.select(*keys).distinct()
    todo = left.select(*keys, left_id, "x", "y").where(~(F.isnan("x") | F.isnan("y"))).join(there, list(keys), "left_semi")
    span = left.select("x", "y").union(right.select("x", "y")).where(~(F.isnan("x") | F.isnan("y")))
    extent = span.agg(F.max("x") - F.min("x") + F.max("y") - F.min("y")).collect()[0][0] or 0.0
    found, radius = None, start
    while True:
        ring = settle(pairs_within(todo, right, radius, keys=keys, copy_left=True).where(own).groupBy(*keys, left_id).agg(F.min("d2").alias("d2")))
        found = ring if found is None else found.union(ring)
        if radius > extent:
            break
        todo = settle(todo.join(ring.hint("merge"), [*keys, left_id], "left_anti"))
        if todo.isEmpty():
            break
        radius *= 4
    return left.join(found.select(*keys, left_id, F.sqrt("d2").alias("nearest_px")).hint("merge"), [*keys, left_id], "left")
