"""Ranked selections, crops, labels and designs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from . import recovery, scans
from . import spatial as S


def nearest_other(points: DataFrame, reach: float, *, point_id: str, keys: Sequence[str] = S.FIELD, name: str = "nearest_d2") -> DataFrame:
    """``points`` with ``name``, the squared distance to the nearest other point within ``reach`` (else null)."""
    met = S.pairs_within(points.select(*keys, point_id, "x", "y"), points.select(*keys, F.col(point_id).alias("other"), "x", "y"), reach, keys=keys).where(F.col(point_id) != F.col("other"))
    return points.join(met.groupBy(*keys, point_id).agg(F.min("d2").alias(name)).hint("merge"), [*keys, point_id], "left")


def isolated_bright(points: DataFrame, *, separation: float, most: int, least: int = 5, brightness: str = "snr", point_id: str = "det_id", min_snr: float = 25.0) -> DataFrame:
    """The brightest isolated points of each field.  Where fewer than ``least`` are ``separation`` apart from all others,
    max(6, half of it) does; the brightest point always stays.

    Defined results: a null or NaN place is isolated; a null brightness goes; ties go to the least id; ``place`` of the input gives way."""
    names = {n: S.free_name(points, n) for n in ("nearest_d2", "first", "wide", "close", "n_wide")}
    near, first, wide, close, n_wide = names.values()
    bright = nearest_other(points.drop("place"), separation, point_id=point_id, name=near).where(F.col(brightness) >= min_snr)
    order = W.partitionBy("field_id").orderBy(F.desc(brightness), point_id)
    relaxed = max(6.0, separation * 0.5)
    apart = lambda s: F.col(near).isNull() | (F.col(near) >= s * s) | F.col(first)
    marked = bright.withColumn(first, F.row_number().over(order) == 1).withColumns({wide: apart(separation), close: apart(relaxed)})
    marked = marked.withColumn(n_wide, F.count_if(wide).over(W.partitionBy("field_id")))
    chosen = marked.where(F.when(F.col(n_wide) < least, F.col(close)).otherwise(F.col(wide)))
    return chosen.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop(*names.values())


def stamps(points: DataFrame, *, separation: float = 9.0, most: int = 80, point_id: str = "det_id") -> DataFrame:
    """The brightest points with no other closer than ``separation``."""
    alone = nearest_other(points, separation, point_id=point_id).where(F.col("nearest_d2").isNull() | (F.col("nearest_d2") >= separation * separation))
    place = F.row_number().over(W.partitionBy("field_id").orderBy(F.desc("flux"), point_id))
    return alone.withColumn("place", place).where(F.col("place") <= most).drop("nearest_d2")


def densest_crop(points: DataFrame, *, size: int, crop: int, step: int = 80, keys: Sequence[str] = S.FIELD) -> DataFrame:
    """Origin of the crop around the fullest box of histogram bins; the first in row-major order of equals.

    The histogram is small and dense; the box sum is one framed window along x and one along y."""
    bins = -(-size // step)
    width = size / bins
    k = max(1, -(-crop // int(width))) if width == int(width) else max(1, int(-(-crop // width)))
    before, after = (k - 1) - (k - 1) // 2, (k - 1) // 2
    at = lambda c: F.floor(F.col(c) / width).cast("bigint")
    binned = points.where((F.col("x") >= 0) & (F.col("x") < size) & (F.col("y") >= 0) & (F.col("y") < size)).groupBy(*keys, at("x").alias("ix"), at("y").alias("iy")).agg(F.count("*").alias("n"))
    axis = F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))
    grid = binned.select(*keys).distinct().select(*keys, F.explode(axis).alias("ix")).select(*keys, "ix", F.explode(axis).alias("iy"))
    full = grid.join(binned, [*keys, "ix", "iy"], "left").fillna(0, ["n"])
    along_x = full.withColumn("sx", F.sum("n").over(W.partitionBy(*keys, "iy").orderBy("ix").rowsBetween(-before, after)))
    score = along_x.withColumn("score", F.sum("sx").over(W.partitionBy(*keys, "ix").orderBy("iy").rowsBetween(-before, after)))
    best = score.groupBy(*keys).agg(F.max_by(F.struct("ix", "iy", "score"), F.struct("score", (-F.col("iy")).alias("a"), (-F.col("ix")).alias("b"))).alias("b"))
    origin = lambda c: F.least(F.greatest(F.rint((F.col(f"b.{c}") + 0.5) * width - crop / 2), F.lit(0.0)), F.lit(float(max(0, size - crop)))).cast("bigint")
    return best.select(*keys, origin("ix").alias("x0"), origin("iy").alias("y0"), F.col("b.score").alias("n_in_box"))


def failure_cases(dets: DataFrame, refs: DataFrame, radius: float = 2.0, *, bright: float = 18.0) -> DataFrame:
    """Per field the missed reference with most neighbours, and the missed one closest to a bright source."""
    quality = S.local_density(scans.quality_refs(refs).select("field_id", "ref_id", "x", "y", "mag"))
    missed = quality.join(recovery.proposed(dets, quality, radius), ["field_id", "ref_id"], "left_anti")
    densest = missed.groupBy("field_id").agg(F.max_by("ref_id", F.struct("neighbours", (-F.col("ref_id")).alias("i"))).alias("densest_missed"), F.count("*").alias("n_missed"))
    stars = quality.where(F.col("mag") <= bright).select("field_id", F.col("ref_id").alias("bright_id"), "x", "y")
    close = S.closest_pair(missed, stars, left_id="ref_id", right_id="bright_id").select("field_id", F.col("ref_id").alias("missed_near_bright"))
    return densest.join(close, "field_id", "left")


def training_labels(dets: DataFrame, refs: DataFrame, *, near: float = 2.0, far: float = 8.0, per_positive: int = 5, least: int = 400, most: int = 2000) -> DataFrame:
    """Positives within ``near`` of a reference, negatives farther than ``far`` from all; of negatives a hash keeps
    min(n, max(5 positives, 400), 2000) in each field."""
    met = S.pairs_within(dets.select("field_id", "det_id", "x", "y"), refs.select("field_id", "x", "y"), far).groupBy("field_id", "det_id").agg(F.min("d2").alias("d2"))
    rows = dets.select("field_id", "det_id").join(met, ["field_id", "det_id"], "left")
    label = F.when(F.col("d2") < near * near, 1).when(F.col("d2").isNull() | (F.col("d2") > far * far), 0)
    rows = rows.withColumn("label", label).where("label is not null").select("field_id", "det_id", "label")
    w = W.partitionBy("field_id")
    place = F.row_number().over(W.partitionBy("field_id", "label").orderBy(F.expr("(det_id % 1000003 * 48271) % 2147483647"), "det_id"))
    ranked = rows.withColumns({"positives": F.count_if(F.col("label") == 1).over(w), "place": place})
    return ranked.where((F.col("label") == 1) | (F.col("place") <= F.least(F.greatest(F.col("positives") * per_positive, F.lit(least)), F.lit(most)))).drop("positives", "place")


def calibration_labels(dets: DataFrame, refs: DataFrame, *, radius: float = 2.0, fwhm: float = 3.5, brightest: float = 19.5) -> DataFrame:
    """Matches with bright isolated references are positive (1), detections farther than max(8, 2 radius) from every
    reference negative (0), the rest unknown (-1)."""
    matched = S.match_one_to_one(dets.select("field_id", "det_id", "x", "y"), refs.select("field_id", "ref_id", "x", "y"), radius).select("field_id", "det_id", "ref_id")
    good = recovery.isolated(refs, fwhm=fwhm, radius=radius, brightest=brightest).where("isolated").select("field_id", "ref_id")
    positive = matched.join(good, ["field_id", "ref_id"], "left_semi").select("field_id", "det_id", F.lit(1).alias("yes"))
    near = S.has_neighbour(dets, refs, max(8.0, 2.0 * radius), left_id="det_id").select("field_id", "det_id", F.lit(1).alias("near"))
    rows = dets.select("field_id", "det_id").join(positive, ["field_id", "det_id"], "left").join(near, ["field_id", "det_id"], "left")
    return rows.select("field_id", "det_id", F.when(F.col("yes") == 1, 1).when(F.col("near").isNull(), 0).otherwise(-1).alias("label"))


def adaptation_eval(dets: DataFrame, refs: DataFrame, *, threshold: float, radius: float = 2.0) -> DataFrame:
    """Recovery with all detections and with those at or above a score threshold, over all and over held-out places."""
    kinds = F.explode(F.array(F.lit("raw"), F.lit("retained"))).alias("kind")
    parts = F.explode(F.array(F.lit("all"), F.lit("held_out"))).alias("part")
    test = C.checkerboard(F.col("x"), F.col("y")) == 2
    d = dets.select("field_id", "det_id", "x", "y", "score", kinds).where((F.col("kind") == "raw") | (F.col("score") >= threshold)).select("*", parts).where((F.col("part") == "all") | test)
    r = refs.select("field_id", "ref_id", "x", "y", parts).where((F.col("part") == "all") | test)
    keys = ("field_id", "kind", "part")
    r2 = r.select("*", F.explode(F.array(F.lit("raw"), F.lit("retained"))).alias("kind"))
    hits = S.nearest(d, r2, radius, left_id="det_id", right_id="ref_id", keys=keys).select(*keys, "ref_id").distinct().groupBy(*keys).agg(F.count("*").alias("recovered"))
    n = r2.groupBy(*keys).agg(F.count("*").alias("n_reference"))
    m = d.groupBy(*keys).agg(F.count("*").alias("n_detection"))
    out = n.join(m, list(keys)).join(hits, list(keys), "left").fillna(0, ["recovered"])
    return out.withColumns({"recall": C.r6(C.ratio(F.col("recovered"), F.col("n_reference"))), "match_lower_bound": C.r6(C.ratio(F.col("recovered"), F.col("n_detection")))})


def density_bands(points: DataFrame, *, density: str, keys: Sequence[str] = S.FIELD) -> DataFrame:
    """Quartiles of the densities of each field, rounded outwards, and how many points lie in either band."""
    q = points.groupBy(*keys).agg(F.percentile(density, F.array(F.lit(0.25), F.lit(0.75))).alias("q")).select(*keys, F.floor(F.col("q")[0]).alias("low_max"), F.ceil(F.col("q")[1]).alias("high_min"))
    counted = points.join(q, list(keys)).groupBy(*keys, "low_max", "high_min")
    return counted.agg(F.count_if(F.col(density) <= F.col("low_max")).alias("n_low"), F.count_if(F.col(density) >= F.col("high_min")).alias("n_high"))


def budget_design(tiles: DataFrame, budgets: Sequence[int], repeats: int) -> DataFrame:
    """For each field, budget and repeat the training tiles to use: the first of the pool in a hash order of the repeat."""
    pool = tiles.where("role = 'train'").select("field_id", "tile", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))
    mixed = F.pmod((F.col("tile") * 7919 + F.col("repeat") * 104729 + F.col("field_id") * 31) * 48271, F.lit(2147483647))
    place = F.row_number().over(W.partitionBy("field_id", "repeat").orderBy(mixed, "tile"))
    return pool.withColumn("place", place).select("*", F.explode(F.filter(F.array(*(F.lit(b) for b in budgets)), lambda b: F.col("place") <= b)).alias("budget")).select("field_id", "budget", "repeat", "tile")


def route_density(conservative: DataFrame, proposals: DataFrame, radius: float = 2.0, reach: float = 10.0, dense: int = 3) -> DataFrame:
    """Route of each conservative entry: the neighbour count of its nearest proposal where one is within ``radius``, else
    a direct count; dense places go to the joint branch."""
    counted = S.neighbour_counts(proposals, proposals, {"own": reach}, point_id="det_id", other_id="det_id").select("field_id", F.col("det_id").alias("prop_id"), "x", "y", "own")
    near = S.nearest(conservative.select("field_id", "det_id", "x", "y"), counted, radius, left_id="det_id", right_id="prop_id").select("field_id", "det_id", "own")
    direct = S.neighbour_counts(conservative.select("field_id", "det_id", "x", "y"), proposals, {"direct": reach}, point_id="det_id")
    rows = direct.join(near, ["field_id", "det_id"], "left").withColumn("neighbours", F.coalesce("own", "direct"))
    return rows.select("field_id", "det_id", "neighbours", F.when(F.col("neighbours") >= dense, "joint").otherwise("conservative").alias("route"))


