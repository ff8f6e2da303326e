"""Catalogue-level selections, audits and designs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from .robust import quantiles


def crop_catalogue(catalogue: DataFrame, x0: float, y0: float, width: float, height: float) -> DataFrame:
    """Shift to a crop's origin and keep what lies in it."""
    moved = catalogue.withColumns({"x": F.col("x") - x0, "y": F.col("y") - y0})
    return moved.where((F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0) & (F.col("y") < height))


def audit(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """``manifest`` (name, size, sha256, ...) with ``outcome`` against ``files`` (name, size, sha256)."""
    found = files.select("name", F.col("size").alias("found_size"), F.col("sha256").alias("found_sum"))
    outcome = F.when(F.col("found_size").isNull(), "missing").when(F.col("found_size") != F.col("size"), "size_mismatch").when(F.col("found_sum") != F.col("sha256"), "sha256_mismatch").otherwise("ok")
    return manifest.join(found, "name", "left").withColumn("outcome", outcome)


def inventory(rows: DataFrame, counts: dict[str, str], tops: dict[str, str], *, top: int = 20) -> DataFrame:
    """kind, name, n: how often each value occurs; of the columns in ``tops`` only the most frequent values."""
    tally = lambda kind, c: rows.groupBy(F.col(c).alias("name")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    parts = [tally(k, c) for k, c in counts.items()] + [tally(k, c).orderBy(F.desc("n"), "name").limit(top) for k, c in tops.items()]
    return reduce(DataFrame.union, parts)


def with_subsets(refs: DataFrame, *, size: float = 1200.0, margin: float = 12.0) -> DataFrame:
    """``refs`` with the flags inside, measured, quality and calibration."""
    columns = [F.col(c) for c in ("mag", "err", "qfit", "oth", "nv")]
    inside = C.inside(F.col("x"), F.col("y"), size, margin)
    return refs.withColumns({"inside": inside, "measured": inside & C.measured(F.col("mag")), "quality": inside & C.good_quality(*columns), "calibration": inside & C.calibration_quality(*columns)})


def quality_refs(refs: DataFrame) -> DataFrame:
    return with_subsets(refs).where("quality").drop("inside", "measured", "quality", "calibration")


def phat_flag(err: str, snr: str, sharp: str, crowd: str, flag: str) -> Column:
    """Whether the columns of a filter pass the cuts; null where one is null and none fails."""
    return (F.col(err) <= 0.10) & (F.col(snr) >= 10) & (F.abs(F.col(sharp)) <= 0.30) & (F.col(crowd) <= 1) & (F.col(flag) <= 2)


def phat_quality(rows: DataFrame, *, err: str = "mag_err", snr: str = "snr", sharp: str = "sharp", crowd: str = "crowd", flag: str = "flag") -> DataFrame:
    """The same cuts for every filter of a survey: name its columns.  Rows with a null among them go."""
    return rows.where(phat_flag(err, snr, sharp, crowd, flag))


def dolphot_quality(rows: DataFrame) -> DataFrame:
    """``rows`` with the flags science and strict."""
    science = (F.col("type") <= 2) & (F.col("snr") >= 5) & (F.col("chi") <= 2.5)
    return rows.withColumns({"science": science, "strict": science & (F.col("mag_err") <= 0.10) & (F.col("flag") == 0)})


def interior_of_all(trials: DataFrame, exposures: DataFrame, *, size: float, margin: float) -> DataFrame:
    """trial_id and reason: admitted if it lies inside every exposure.  Each exposure shifts by (dx, dy), and only the extremes
    of the shifts matter: one row, whatever the number of exposures.

    Defined results: without an exposure every trial is admitted; a trial without a place has no reason."""
    ends = exposures.agg(*(f(c).alias(f"{n}_{c}") for c in ("dx", "dy") for n, f in (("low", F.min), ("high", F.max))))
    off = lambda c, d: F.coalesce(F.col(c) + F.col(f"low_{d}") < margin, F.lit(False)) | F.coalesce(F.col(c) + F.col(f"high_{d}") >= size - margin, F.lit(False))
    placed = F.col("x").isNotNull() & F.col("y").isNotNull()
    reason = F.when(off("x", "dx"), "outside_x").when(off("y", "dy"), "outside_y").otherwise("admitted")
    return trials.crossJoin(F.broadcast(ends)).select("trial_id", F.when(placed, reason).alias("reason"))


def admit_exposures(exposures: DataFrame, wanted: str, *, least: int, keys: Sequence[str]) -> DataFrame:
    good = exposures.where((F.col("exptime") > 0) & (F.col("filter") == wanted))
    return good.groupBy(*keys).agg(F.count("*").alias("inputs"), F.sum("exptime").alias("exptime")).withColumn("admitted", F.col("inputs") >= least)


def representative(rows: DataFrame, keys: Sequence[str], row_id: str) -> DataFrame:
    """The row of each group that is closest to the median of x and of y.

    Defined results: rows with a null key go; ties go to the least id."""
    middle = quantiles(rows, keys, {"mx": ("x", 0.5), "my": ("y", 0.5)})
    order = W.partitionBy(*keys).orderBy(C.square(F.col("x") - F.col("mx")) + C.square(F.col("y") - F.col("my")), row_id)
    return rows.join(middle, list(keys)).withColumn("place", F.row_number().over(order)).where("place = 1").drop("place", "mx", "my")


def stratified_split(rows: DataFrame, strata: Sequence[str], order: Column, row_id: str, shares: tuple[float, float] = (0.6, 0.2)) -> DataFrame:
    """``rows`` with ``part``: shares of each stratum for training and validation, the rest for tests."""
    place = F.row_number().over(W.partitionBy(*strata).orderBy(order, row_id)) - 1
    rank = place / F.count("*").over(W.partitionBy(*strata)).cast("double")
    return rows.withColumn("rank", rank).withColumn("part", F.when(F.col("rank") < shares[0], "train").when(F.col("rank") < sum(shares), "validation").otherwise("test")).drop("rank")


def standardised(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Zero mean and unit population deviation in each group; the deviation counts as 1e-8 at least."""
    stats = rows.groupBy(*keys).agg(*(f(c).alias(f"{p}_{c}") for c in columns for p, f in (("mean", F.avg), ("dev", F.stddev_pop))))
    z = {c: (F.col(c) - F.col(f"mean_{c}")) / F.greatest(F.col(f"dev_{c}"), F.lit(1e-8)) for c in columns}
    return rows.join(stats, list(keys)).withColumns(z).drop(*(f"{p}_{c}" for c in columns for p in ("mean", "dev")))


def design_grid(*dimensions: DataFrame) -> DataFrame:
    """All combinations of a few small tables."""
    return reduce(DataFrame.crossJoin, dimensions)


def positive_flux(sources: DataFrame, flux: str = "flux") -> DataFrame:
    """Sources whose flux is a finite number above zero; null, NaN and infinite ones go."""
    f = F.col(flux)
    return sources.where(f.isNotNull() & ~F.isnan(f) & (f > 0) & (f < float("inf")))
