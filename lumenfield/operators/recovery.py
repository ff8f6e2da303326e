"""Completeness, match rates and calibration of detections against reference catalogues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from . import robust, scans
from . import spatial as S
from .shared import settle

LEAN_DET = ("field_id", "det_id", "x", "y")


def held_out(rows: DataFrame) -> DataFrame:
    """The test part of the checkerboard."""
    return rows.where(C.checkerboard(F.col("x"), F.col("y")) == 2)


def isolated(refs: DataFrame, *, fwhm: float, radius: float, brightest: float) -> DataFrame:
    """``refs`` with ``isolated``: bright and without a neighbour closer than twice the larger of fwhm and radius."""
    reach = max(2.0 * fwhm, 2.0 * radius)
    met = S.pairs_within(refs.select("field_id", "ref_id", "x", "y"), refs.select("field_id", F.col("ref_id").alias("other"), "x", "y"), reach)
    near = met.where((F.col("ref_id") != F.col("other")) & (F.col("d2") < reach * reach)).select("field_id", "ref_id").distinct().withColumn("crowded", F.lit(True))
    return refs.join(near, ["field_id", "ref_id"], "left").withColumn("isolated", (F.col("mag") <= brightest) & F.col("crowded").isNull()).drop("crowded")


def proposed(dets: DataFrame, refs: DataFrame, radius: float = 2.0, *, within: Sequence[str] = ()) -> DataFrame:
    """Distinct references that are some detection's nearest one: those a one-to-one match recovers."""
    near = S.nearest(dets.select(*LEAN_DET), refs.select("field_id", "ref_id", "x", "y", *within), radius, left_id="det_id", right_id="ref_id", within=within)
    return near.select("field_id", *within, "ref_id").distinct()


def _counts(refs: DataFrame, hits: DataFrame, keys: list[str]) -> DataFrame:
    total = refs.groupBy(*keys).agg(F.count("*").alias("n_reference"))
    found = hits.groupBy(*keys).agg(F.count("*").alias("recovered"))
    return total.join(found, keys, "left").fillna(0, ["recovered"])


def _with_interval(rows: DataFrame, n: str, k: str) -> DataFrame:
    return rows.withColumns({"ci_lo": C.r6(C.wilson_low(F.col(k), F.col(n))), "ci_hi": C.r6(C.wilson_high(F.col(k), F.col(n)))})


def stratified_completeness(dets: DataFrame, refs: DataFrame, radius: float = 2.0) -> DataFrame:
    """Recovery of held-out quality references in magnitude and density bins.  Each bin is matched by itself: a
    detection may propose another reference when those of other bins are out of sight."""
    quality = scans.quality_refs(refs).select("field_id", "ref_id", "x", "y", "mag")
    dense = held_out(S.local_density(quality))
    axes = F.array(F.struct(F.lit("magnitude").alias("axis"), C.magnitude_bin(F.col("mag")).alias("bin")), F.struct(F.lit("density").alias("axis"), C.density_bin(F.col("neighbours")).alias("bin")))
    strata = dense.select("field_id", "ref_id", "x", "y", F.explode(axes).alias("s")).select("field_id", "ref_id", "x", "y", "s.axis", "s.bin")
    rows = _counts(strata, proposed(held_out(dets), strata, radius, within=("axis", "bin")), ["field_id", "axis", "bin"])
    return _with_interval(rows.withColumn("completeness", C.r6(C.ratio(F.col("recovered"), F.col("n_reference")))), "n_reference", "recovered")


def completeness_by_limit(dets: DataFrame, refs: DataFrame, limits: Sequence[int], radius: float = 2.0) -> DataFrame:
    """Recovery of references down to each magnitude limit, matched limit by limit."""
    within = refs.withColumn("mag_limit", F.explode(F.filter(F.array(*(F.lit(v) for v in limits)), lambda v: F.col("mag") <= v))).select("field_id", "ref_id", "x", "y", "mag_limit")
    rows = _counts(within, proposed(dets, within, radius, within=("mag_limit",)), ["field_id", "mag_limit"])
    return rows.withColumn("recall", C.r6(C.ratio(F.col("recovered"), F.col("n_reference"))))


def dense_subset(refs: DataFrame, *, faintest: float = 20.0, least: int = 3) -> DataFrame:
    quality = scans.quality_refs(refs).select("field_id", "ref_id", "x", "y", "mag")
    return held_out(S.local_density(quality)).where((F.col("mag") <= faintest) & (F.col("neighbours") >= least))


def dense_recall(dets: DataFrame, refs: DataFrame, radius: float = 2.0, *, faintest: float = 20.0, least: int = 3) -> DataFrame:
    sub = dense_subset(refs, faintest=faintest, least=least).select("field_id", "ref_id", "x", "y")
    rows = _counts(sub, proposed(held_out(dets), sub, radius), ["field_id"])
    return _with_interval(rows.withColumn("recall", C.r6(C.ratio(F.col("recovered"), F.col("n_reference")))), "n_reference", "recovered")


def match_lower_bound_by_snr(dets: DataFrame, refs: DataFrame, *, rms: float, radius: float = 2.0) -> DataFrame:
    """The share of held-out detections in each signal-to-noise bin that a one-to-one match pairs: a lower bound, as the
    catalogue may lack real sources."""
    binned = held_out(dets).withColumn("bin", C.snr_bin(C.source_snr(F.col("flux"), rms))).select(*LEAN_DET, "bin")
    quality = scans.quality_refs(refs).select("field_id", "ref_id", "x", "y")
    near = S.nearest(binned, quality, radius, left_id="det_id", right_id="ref_id")
    hits = near.select("field_id", "bin", "ref_id").distinct().groupBy("field_id", "bin").agg(F.count("*").alias("catalogue_matches"))
    rows = binned.groupBy("field_id", "bin").agg(F.count("*").alias("n_detection")).join(hits, ["field_id", "bin"], "left").fillna(0, ["catalogue_matches"])
    return _with_interval(rows.withColumn("match_lower_bound", C.r6(C.ratio(F.col("catalogue_matches"), F.col("n_detection")))), "n_detection", "catalogue_matches")


def precision_recall_f1(dets: DataFrame, truth: DataFrame, radius: float = 2.0) -> DataFrame:
    hits = proposed(dets, truth, radius).groupBy("field_id").agg(F.count("*").alias("true_positives"))
    d = dets.groupBy("field_id").agg(F.count("*").alias("n_detections"))
    r = truth.groupBy("field_id").agg(F.count("*").alias("n_truth"))
    rows = d.join(r, "field_id").join(hits, "field_id", "left").fillna(0, ["true_positives"])
    k, n, m = F.col("true_positives"), F.col("n_detections"), F.col("n_truth")
    return rows.withColumns({"precision": C.r6(C.ratio(k, n)), "recall": C.r6(C.ratio(k, m)), "f1": C.r6(2.0 * k / F.greatest(n + m, F.lit(1)))})


def radius_scan(dets: DataFrame, refs: DataFrame, radii: Sequence[float]) -> DataFrame:
    """How many references a match recovers at each radius: one join at the largest, the rest from its pairs."""
    met = S.pairs_within(dets.select(*LEAN_DET), refs.select("field_id", "ref_id", "x", "y"), max(radii))
    near = met.withColumn("place", F.row_number().over(W.partitionBy("field_id", "det_id").orderBy("d2", "ref_id"))).where("place = 1")
    fits = F.explode(F.filter(F.array(*(F.lit(r) for r in radii)), lambda r: F.col("d2") <= r * r)).alias("radius")
    return near.select("field_id", "ref_id", fits).distinct().groupBy("field_id", "radius").agg(F.count("*").alias("recovered"))


def sky_match(a: DataFrame, b: DataFrame, *, radius_arcsec: float) -> DataFrame:
    """Nearest row of ``b`` for each row of ``a`` (ra, dec in degrees) in a plane that is flat around b's median
    declination; several rows of ``a`` may share one."""
    scale = robust.quantiles(b, [], {"mid": ("dec", 0.5)}).select(F.cos(F.radians("mid")).alias("scale"))
    flat = lambda d: d.crossJoin(F.broadcast(scale)).withColumns({"x": F.col("ra") * F.col("scale") * 3600.0, "y": F.col("dec") * 3600.0}).drop("ra", "dec", "scale")
    near = S.nearest(flat(a), flat(b), radius_arcsec, left_id="det_id", right_id="ref_id", keys=())
    return near.withColumn("sep_arcsec", F.sqrt("d2"))


# --- calibration -------------------------------------------------------------------------------------------------------


def matched_catalogue(dets: DataFrame, refs: DataFrame, radius: float = 2.0) -> DataFrame:
    """One row for each one-to-one match with quality references: both positions, mag, inst and ``test``."""
    quality = scans.quality_refs(refs).select("field_id", "ref_id", "x", "y", "mag")
    m = S.match_one_to_one(dets.select(*LEAN_DET, "flux"), quality, radius)
    return m.withColumns({"inst": C.instrumental_mag(F.col("flux")), "test": C.checkerboard(F.col("rx"), F.col("ry")) == 2})


def zero_points(matches: DataFrame, keys: Sequence[str] = S.FIELD) -> DataFrame:
    return matches.where("not test").groupBy(*keys).agg(robust.median(F.col("mag") - F.col("inst")).alias("zero_point"), F.count("*").alias("n"))


def magnitude_residuals(matches: DataFrame, keys: Sequence[str] = S.FIELD) -> DataFrame:
    zero = zero_points(matches, keys).select(*keys, "zero_point")
    return matches.join(zero, list(keys)).withColumn("mag_residual", F.col("inst") + F.col("zero_point") - F.col("mag"))


def route_zero_points(matches: DataFrame, route: str, least: int = 10) -> DataFrame:
    """A zero point for each route, the field's where a route has fewer than ``least`` training matches."""
    whole = zero_points(matches).select("field_id", F.col("zero_point").alias("field_zero"))
    difference = F.when(~F.col("test"), F.col("mag") - F.col("inst"))
    each = matches.groupBy("field_id", route).agg(robust.median(difference).alias("route_zero"), F.count_if(~F.col("test")).alias("training_matches"), F.count_if("test").alias("test_matches"))
    return each.join(whole, "field_id").withColumn("zero_point", F.when(F.col("training_matches") >= least, F.col("route_zero")).otherwise(F.col("field_zero"))).drop("route_zero", "field_zero")


def aligned(matches: DataFrame, *, rounds: int = 3, floor: float = 0.05, keys: Sequence[str] = S.FIELD) -> DataFrame:
    """``matches`` with px and py: positions after an affine fit on the part that is not held out."""
    fit = robust.fit_affine(matches.where("not test").select(*keys, "x", "y", "rx", "ry"), keys, rounds=rounds, floor=floor)
    return robust.apply_affine(matches, fit, keys)


def measurement_metrics(matches: DataFrame, *, least_train: int = 10, least_test: int = 5, pixel_mas: float = 50.0, keys: Sequence[str] = S.FIELD) -> DataFrame:
    """Clipped one-dimensional position RMS and magnitude RMS of held-out matches, null where a key has too few."""
    matches = settle(matches)
    sizes = matches.groupBy(*keys).agg(F.count_if(~F.col("test")).alias("n_train"), F.count_if("test").alias("n_test"))
    enough = sizes.where((F.col("n_train") >= least_train) & (F.col("n_test") >= least_test)).select(*keys)
    used = settle(matches.join(enough, list(keys), "left_semi"))
    moved = aligned(used, keys=keys).where("test")
    radial = moved.withColumn("radial", F.sqrt(C.square(F.col("px") - F.col("rx")) + C.square(F.col("py") - F.col("ry"))))
    position = robust.clipped(radial, keys, "radial", 0.05, one_sided=True).groupBy(*keys).agg(F.sqrt(F.avg(C.square(F.col("radial"))) / 2.0).alias("rms_1d_px"))
    magnitude = robust.clipped(magnitude_residuals(used, keys).where("test"), keys, "mag_residual", 0.03).groupBy(*keys).agg(F.stddev_pop("mag_residual").alias("mag_rms"))
    return sizes.join(position, list(keys), "left").join(magnitude, list(keys), "left").withColumn("rms_1d_mas", F.col("rms_1d_px") * pixel_mas)


def common_match_metrics(dets: DataFrame, refs: DataFrame, *, methods: int, radius: float = 2.0, faintest: float = 20.0, least: int = 3) -> DataFrame:
    """``measurement_metrics`` of each (field_id, method): registered and calibrated by the method's own matches, and measured on the crowded
    held-out references that every one of ``methods`` methods matches (column ``method`` of ``dets``).

    Defined results: a null field, method, id or place matches nothing; a method without a match has no row; a reference that repeats
    counts once for each row; too few matches give null metrics."""
    keys = ("field_id", "method")
    lean = dets.where("method is not null").select(*keys, "det_id", "x", "y", "flux")
    crowd = S.local_density(refs.select("field_id", "ref_id", "x", "y", "mag"))
    dense = crowd.where((F.col("mag") <= faintest) & (F.col("neighbours") >= least)).select("field_id", "ref_id").distinct()
    near = S.nearest(lean, refs.select("field_id", "ref_id", "x", "y", "mag"), radius, left_id="det_id", right_id="ref_id", keys=("field_id",), within=("method",))
    first = near.withColumn("place", F.row_number().over(W.partitionBy(*keys, "ref_id").orderBy("d2", "det_id"))).where("place = 1")
    rows = settle(first.select(*keys, "ref_id", "x", "y", "rx", "ry", "mag", C.instrumental_mag(F.col("flux")).alias("inst"), (C.checkerboard(F.col("rx"), F.col("ry")) == 2).alias("test")))
    shared = rows.where("test").groupBy("field_id", "ref_id").agg(F.countDistinct("method").alias("n")).where(F.col("n") == methods).join(dense, ["field_id", "ref_id"], "left_semi")
    kept = rows.where("not test").unionByName(rows.where("test").join(shared, ["field_id", "ref_id"], "left_semi"))
    return measurement_metrics(kept, keys=keys)


def new_candidates(dets: DataFrame, known: DataFrame, *, separation: float, most: int) -> DataFrame:
    """Detections farther than ``separation`` from all known sources, with ``place`` by flux, the first ``most`` of a field.

    Defined results: a detection without a place is far from all; a null flux comes last; an empty table gives none."""
    far = S.has_neighbour(dets, known, separation, left_id="det_id", negate=True)
    place = F.row_number().over(W.partitionBy("field_id").orderBy(F.desc_nulls_last("flux"), "det_id"))
    return far.withColumn("place", place).where(F.col("place") <= most)


def threshold_scan(dets: DataFrame, refs: DataFrame, score: str, thresholds: Sequence[float], radius: float = 2.0) -> DataFrame:
    """field_id, threshold, n_detection and matched references, for detections at or above each threshold.  Pairs are
    found once; detections below the least threshold and null scores take no part."""
    cuts = F.explode(F.array(*(F.lit(float(c)) for c in thresholds)))
    own = dets.select("field_id", "det_id", "x", "y", F.col(score).alias("level"))
    near = S.nearest(own, refs.select("field_id", "ref_id", "x", "y"), radius, left_id="det_id", right_id="ref_id").select("field_id", "ref_id", "level")
    hit = near.withColumn("threshold", cuts).where("level >= threshold").groupBy("field_id", "threshold").agg(F.countDistinct("ref_id").alias("matched"))
    seen = own.withColumn("threshold", cuts).where("level >= threshold").groupBy("field_id", "threshold").agg(F.count("*").alias("n_detection"))
    return seen.join(hit, ["field_id", "threshold"], "left").fillna(0, ["matched"])
