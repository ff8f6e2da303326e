"""Protocols put together from the other operators: scores after realignment, injection plans, the blind quality catalogue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from . import pixels as P
from . import robust, rounds
from . import spatial as S
from .shared import settle


def score_realigned(dets: DataFrame, refs: DataFrame, *, radius: float = 2.0, pixel_mas: float = 74.0, least: int = 5, widest: float = 2.0) -> DataFrame:
    """One row a field of ``refs``: matches of all detections register them by a plain affine map (matches outside the
    test cells only; the identity for fewer than three), the moved detections are matched to the references of the test
    cells, and position and magnitude residuals of those give the two RMS values.

    Defined results: fields without detections count zero; RMS values are null without a match, and the one of magnitudes
    also below ``least`` training matches of positive flux or where no residual is under ``widest``."""
    marked = refs.select("field_id", "ref_id", "x", "y", "mag", (C.checkerboard(F.col("x"), F.col("y")) == 2).alias("test"))
    place = dets.select("field_id", "det_id", "x", "y", "flux")
    first = settle(rounds.greedy_edges(place, marked, radius, carry=("x", "y", "flux", "rx", "ry", "mag", "test")))
    train = first.where("not test")
    fit = robust.fit_affine(train.select("field_id", "x", "y", "rx", "ry"), ["field_id"], rounds=0)
    moved = robust.apply_affine(place, fit, ["field_id"]).select("field_id", "det_id", F.col("px").alias("x"), F.col("py").alias("y"), "flux")
    moved = moved.union(place.join(fit, "field_id", "left_anti").select(*moved.columns))
    again = rounds.greedy_edges(moved, marked.where("test"), radius, carry=("flux", "mag"))
    lit = (F.col("flux") > 0) & ~F.isnan("flux")
    zero = train.where(lit).groupBy("field_id").agg(robust.median(F.col("mag") - C.instrumental_mag(F.col("flux"))).alias("zero"), F.count("*").alias("n")).where(F.col("n") >= least).drop("n")
    off = C.instrumental_mag(F.col("flux")) + F.col("zero") - F.col("mag")
    scored = again.join(zero, "field_id", "left").groupBy("field_id").agg(F.count("*").alias("hits"), F.sqrt(F.avg("d2")).alias("rms"), F.stddev_pop(F.when(F.abs(off) < widest, off)).alias("mag_rms"))
    out = marked.groupBy("field_id").agg(F.count_if("test").alias("test_references"))
    out = out.join(place.groupBy("field_id").agg(F.count("*").alias("candidates")), "field_id", "left").join(first.groupBy("field_id").agg(F.count("*").alias("all_catalogue_matches")), "field_id", "left")
    out = out.join(scored, "field_id", "left").withColumnRenamed("hits", "test_recovered").fillna(0, ["candidates", "all_catalogue_matches", "test_recovered"])
    return out.select("field_id", "candidates", "test_references", "test_recovered", C.ratio(F.col("test_recovered"), F.col("test_references")).alias("test_recovery"), (F.col("rms") * pixel_mas).alias("test_position_rms_mas"), F.col("mag_rms").alias("test_magnitude_rms"), "all_catalogue_matches")


def injection_plan(refs: DataFrame, mags: Sequence[float], bands: dict[str, tuple[int, int]], *, batches: int = 2, each: int = 20, attempts: int = 2000, most_attempts: int = 0, size: float = 1200.0, margin: float = 15.0, reach: float = 10.0, separation: float = 12.0) -> DataFrame:
    """Places for artificial stars: for each field, magnitude, density band and batch the first ``each`` places, of those that a hash
    deals one after another, whose number of references within ``reach`` less one lies in the band and that are at least
    ``separation`` from those taken before.  Groups that ``attempts`` places do not fill get ten times as many, and again, up to
    ``most_attempts`` (0: none); a longer row of places begins with the shorter one, so that full groups are what they would be with all.

    Defined results: a field without references has no rows, and neither has a null one; a band with too few places on the sky stays short of ``each``."""
    listed = lambda values: F.explode(F.array(*(F.lit(v) for v in values)))
    keys = ["field_id", "mag", "band", "batch"]
    groups = settle(refs.where("field_id is not null").select("field_id").distinct().select("field_id", listed(mags).alias("mag")).select("*", listed(bands).alias("band")).select("*", listed(range(batches)).alias("batch")))
    done = None
    while True:
        plan = settle(_places(groups, refs, bands, keys, each=each, attempts=attempts, size=size, margin=margin, reach=reach, separation=separation))
        full = plan.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= each).select(*keys)
        short = settle(groups.join(full.hint("merge"), keys, "left_anti"))
        if attempts >= most_attempts or short.isEmpty():
            return plan if done is None else done.union(plan)
        met = plan.join(full.hint("merge"), keys, "left_semi").select(*plan.columns)
        done = met if done is None else done.union(met)
        groups, attempts = short, min(10 * attempts, most_attempts)


def _places(groups: DataFrame, refs: DataFrame, bands: dict[str, tuple[int, int]], keys: Sequence[str], *, each: int, attempts: int, size: float, margin: float, reach: float, separation: float) -> DataFrame:
    span = size - 2 * margin
    tries = groups.select("*", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))).alias("attempt"))
    drawn = lambda axis: margin + span * F.pmod(F.xxhash64("field_id", "mag", "band", "batch", "attempt", F.lit(axis)), F.lit(1 << 30)) / float(1 << 30)
    tried = tries.select(*keys, "attempt", drawn("x").alias("x"), drawn("y").alias("y")).withColumn("site", F.xxhash64(*keys[1:], "attempt"))
    counted = S.neighbour_counts(tried, refs, {"near": reach}, point_id="site")
    density = F.col("near") - 1
    fits = F.lit(False)
    for name, (low, high) in bands.items():
        fits = fits | ((F.col("band") == name) & density.between(low, high))
    apart = rounds.thin(settle(counted.where(fits)), separation, point_id="attempt", order="attempt", keys=keys)
    place = F.row_number().over(W.partitionBy(*keys).orderBy("attempt"))
    return apart.withColumn("place", place).where(F.col("place") <= each).select(*keys, "place", "attempt", "x", "y", density.alias("neighbours"))


def blind_quality_catalogue(fitted: DataFrame, initial: DataFrame, pixels: DataFrame, *, rms: float, probability: Column) -> DataFrame:
    """``fitted`` sources with snr, neighbours within 10 px, whether they are farther than 1 px from every ``initial`` one,
    whether a bright core of the image is near, the ``probability`` of the nearest initial one within 1.5 px, and the six
    quality bits.  A source without a place, or with a null key, has no neighbours and counts as added by deblending."""
    keys = ["field_id", "det_id"]
    fitted = settle(fitted.select(*keys, "x", "y", "flux", "psf_fit_quality"))  # read four times
    place = fitted.select(*keys, "x", "y")
    # in the buckets of the bright cores, so that both joins meet one shuffle of the places
    near = S.nearest(place, initial.select("field_id", "ref_id", "x", "y", probability.alias("p")), 1.5, left_id="det_id", right_id="ref_id", width=S.WIDTH * 10.0).select(*keys, F.sqrt("d2").alias("gap"), "p")
    core = P.near_bright_core(place, pixels, 1.0, source_id="det_id").select(*keys, F.lit(True).alias("core"))
    # sources take their own columns through the shuffle in which they meet their counts; those that repeat an id come as often as they would meet it
    crowd = S.neighbour_counts(fitted, fitted, {"neighbours": 10.0}, point_id="det_id", other_id="det_id").drop("x", "y")
    copies = F.when(F.col("field_id").isNotNull() & F.col("det_id").isNotNull(), F.count("*").over(W.partitionBy(*keys))).otherwise(1)
    crowd = crowd.withColumn("copies", copies).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).drop("copies", "copy")
    rows = crowd.join(near.hint("merge"), keys, "left").join(core.hint("merge"), keys, "left")
    rows = rows.withColumns({"snr": C.source_snr(F.col("flux"), rms), "deblend": F.col("gap").isNull() | (F.col("gap") > 1.0), "core": F.coalesce("core", F.lit(False)), "neighbours": F.coalesce("neighbours", F.lit(0))})
    mask = C.quality_bitmask(F.col("snr"), F.col("psf_fit_quality"), F.col("neighbours"), F.col("core"), F.col("deblend"), F.col("p"))
    return rows.select(*keys, "snr", "neighbours", F.col("deblend").alias("deblend_flag"), F.col("core").alias("saturation_neighbour_flag"), F.col("p").alias("classifier_probability"), mask.alias("quality_bitmask"))


def common_matches(dets: DataFrame, wanted: DataFrame, refs: DataFrame, *, methods: int, radius: float = 2.0) -> DataFrame:
    """The rows of ``wanted`` in test cells that are the nearest of all ``refs`` to a detection of each of ``methods``
    methods (column ``method`` of ``dets``).  Null keys and places match nothing; repeated rows of ``wanted`` stay."""
    near = S.nearest(dets, refs.select("field_id", "ref_id", "x", "y"), radius, left_id="det_id", right_id="ref_id", keys=("field_id",))
    common = near.groupBy("field_id", "ref_id").agg(F.countDistinct("method").alias("n")).where(F.col("n") == methods)
    return wanted.where(C.checkerboard(F.col("x"), F.col("y")) == 2).join(common, ["field_id", "ref_id"], "left_semi")
