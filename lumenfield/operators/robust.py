"""Robust statistics and registration as aggregates: medians, clipping rounds and normal equations, in a fixed number of passes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import square
from .shared import settle

MAD = 1.4826


def median(c: str | Column) -> Column:
    return F.percentile(c, F.lit(0.5))


def quantiles(rows: DataFrame, keys: Sequence[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """Keys, and for each name in ``wanted`` the exact quantile (column, share), for a few keys that hold most rows each.

    ``percentile`` would gather all distinct values of a key in one task.  Here values become (key, value, count) rows, which are
    cut into ranges of key and value; the sums of the ranges tell where each begins, running counts within a range place its
    values, and only values next to a wanted place travel on.

    Defined results: nulls do not count, NaN is above all numbers; a quantile between two values is blended linearly; a
    column without values gives null; null keys are a group; no rows give no groups, but for no keys one row of nulls."""
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    key = F.struct(F.lit(0).alias("all"), *(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)))
    each = F.posexplode(F.array(*(F.col(c).cast("double") for c in columns))).alias("which", "value")
    tally = rows.select(key.alias("key"), each).groupBy("key", "which", "value").agg(F.count("*").alias("n"))
    ranged = settle(tally.repartitionByRange("key", "which", "value").withColumn("part", F.spark_partition_id()))
    known = ranged.where("value is not null")
    sums = known.groupBy("key", "which", "part").agg(F.sum("n").alias("s"))
    every = W.partitionBy("key", "which")
    begins = sums.select("key", "which", "part", (F.sum("s").over(every.orderBy("part")) - F.col("s")).alias("begin"), F.sum("s").over(every).alias("total"))
    running = F.sum("n").over(W.partitionBy("key", "which", "part").orderBy("value"))
    placed = known.withColumn("end", running).join(begins, ["key", "which", "part"]).withColumn("end", F.col("begin") + F.col("end"))
    at = {name: (columns.index(c), share * (F.col("total") - 1)) for name, (c, share) in wanted.items()}
    held = lambda place: (place < F.col("end")) & (place >= F.col("end") - F.col("n"))
    sides = {}
    for i, (which, place) in enumerate(at.values()):
        sides[f"low_{i}"] = F.when((F.col("which") == which) & held(F.floor(place)), F.col("value"))
        sides[f"high_{i}"] = F.when((F.col("which") == which) & held(F.ceil(place)), F.col("value"))
        sides[f"share_{i}"] = F.when(F.col("which") == which, place - F.floor(place))
    met = placed.select("key", *(c.alias(n) for n, c in sides.items())).where(" or ".join(f"low_{i} is not null or high_{i} is not null" for i in range(len(at))))
    found = met.groupBy("key").agg(*(F.max(n).alias(n) for n in sides))
    blend = lambda i: F.when(F.col(f"low_{i}") == F.col(f"high_{i}"), F.col(f"low_{i}")).otherwise(F.col(f"low_{i}") * (1 - F.col(f"share_{i}")) + F.col(f"high_{i}") * F.col(f"share_{i}"))
    named = found.select(F.col("key").alias("found"), *(blend(i).alias(f"q_{i}") for i in range(len(at))))
    groups = ranged.select("key").distinct() if keys else rows.sparkSession.range(1).select(key.alias("key"))
    out = groups.join(named, F.col("key") == F.col("found"), "left")
    return out.select(*(F.col(f"key.k{i}").alias(k) for i, k in enumerate(keys)), *(F.col(f"q_{i}").alias(n) for i, n in enumerate(at)))


def with_center(rows: DataFrame, keys: Sequence[str], value: str, *, few: bool = False) -> DataFrame:
    """``rows`` with ``mid``, the median of ``value`` in each group, and ``mad``, its scaled median absolute deviation; with
    ``few`` keys medians come from ``quantiles``."""
    if few:
        mid = quantiles(rows, keys, {"mid": (value, 0.5)})
        off = quantiles(rows.join(mid, list(keys)).withColumn("off", F.abs(F.col(value) - F.col("mid"))), keys, {"mad": ("off", 0.5)})
        return rows.join(mid, list(keys)).join(off.withColumn("mad", MAD * F.col("mad")), list(keys))
    mid = rows.groupBy(*keys).agg(median(value).alias("mid"))
    dev = rows.join(mid, list(keys)).groupBy(*keys).agg(F.first("mid").alias("mid"), (MAD * median(F.abs(F.col(value) - F.col("mid")))).alias("mad"))
    return rows.join(dev, list(keys))


def clipped(rows: DataFrame, keys: Sequence[str], value: str, floor: float, *, one_sided: bool = False, few: bool = False) -> DataFrame:
    """Rows whose ``value`` lies within max(3 mad, floor) of the median; one-sided: not above that."""
    d = F.col(value) - F.col("mid")
    return with_center(rows, keys, value, few=few).where((d if one_sided else F.abs(d)) <= F.greatest(3.0 * F.col("mad"), F.lit(floor))).drop("mid", "mad")


def robust_rms(rows: DataFrame, keys: Sequence[str], value: str, floor: float = 1e-5, *, least: int = 5, name: str = "rms", few: bool = False) -> DataFrame:
    """Keys, ``name`` (null below ``least`` rows before or after clipping) and the number of inliers."""
    counted = rows.where(F.col(value).isNotNull() & ~F.isnan(value))
    all_ = counted.groupBy(*keys).agg(F.count("*").alias("n_all"))
    kept = clipped(counted, keys, value, floor, few=few).groupBy(*keys).agg(F.count("*").alias("inliers"), F.stddev_pop(value).alias("dev"))
    return all_.join(kept, list(keys)).select(*keys, F.when((F.col("n_all") >= least) & (F.col("inliers") >= least), F.col("dev")).alias(name), "inliers")


def fit_affine(pairs: DataFrame, keys: Sequence[str], *, rounds: int = 3, floor: float = 0.05, least: int = 3) -> DataFrame:
    """Six-parameter affine from (x, y) to (rx, ry) for each group, with clipping rounds on the residual.

    Keys, ax, bx, cx, ay, by, cy with rx = ax + bx (x - ox) + cx (y - oy), and the origin (ox, oy), which keeps the
    normal equations well conditioned.  Below ``least`` pairs the map is the identity."""
    good = rows = settle(pairs.select(*keys, "x", "y", "rx", "ry"))
    for _ in range(rounds):
        coeff = _solve(good, keys, least)
        residual = F.sqrt(square(F.col("px") - F.col("rx")) + square(F.col("py") - F.col("ry")))
        good = settle(_clip(apply_affine(rows, coeff, keys), residual, keys, floor))
    return settle(_solve(good, keys, least))


def _clip(predicted: DataFrame, residual: Column, keys: Sequence[str], floor: float) -> DataFrame:
    return clipped(predicted.withColumn("residual", residual), keys, "residual", floor, one_sided=True).select(*keys, "x", "y", "rx", "ry")


def _solve(pairs: DataFrame, keys: Sequence[str], least: int) -> DataFrame:
    origin = pairs.groupBy(*keys).agg(F.avg("x").alias("ox"), F.avg("y").alias("oy"), F.avg("rx").alias("mx"), F.avg("ry").alias("my"), F.count("*").alias("n"))
    u, v = F.col("x") - F.col("ox"), F.col("y") - F.col("oy")
    p, q = F.col("rx") - F.col("mx"), F.col("ry") - F.col("my")
    sums = pairs.join(origin, list(keys)).groupBy(*keys, "ox", "oy", "mx", "my", "n").agg(*(F.sum(e).alias(k) for k, e in {"uu": u * u, "uv": u * v, "vv": v * v, "up": u * p, "vp": v * p, "uq": u * q, "vq": v * q}.items()))
    c = F.col
    det = c("uu") * c("vv") - c("uv") * c("uv")
    fit = (c("n") >= least) & (F.abs(det) > 1e-9)
    solved = lambda a, b: ((a * c("vv") - b * c("uv")) / det, (b * c("uu") - a * c("uv")) / det)
    (bx, cx), (by, cy) = solved(c("up"), c("vp")), solved(c("uq"), c("vq"))
    pick = lambda e, other, name: F.when(fit, e).otherwise(other).alias(name)
    return sums.select(
        *keys, "ox", "oy", "n", pick(c("mx"), c("ox"), "ax"), pick(bx, F.lit(1.0), "bx"), pick(cx, F.lit(0.0), "cx"), pick(c("my"), c("oy"), "ay"), pick(by, F.lit(0.0), "by"), pick(cy, F.lit(1.0), "cy")
    )


def apply_affine(rows: DataFrame, coeff: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with px and py, where the map sends x and y."""
    u, v = F.col("x") - F.col("ox"), F.col("y") - F.col("oy")
    moved = {"px": F.col("ax") + F.col("bx") * u + F.col("cx") * v, "py": F.col("ay") + F.col("by") * u + F.col("cy") * v}
    return rows.join(coeff.drop("n"), list(keys)).withColumns(moved).drop("ox", "oy", "ax", "bx", "cx", "ay", "by", "cy")


def translation_peak(pairs: DataFrame, keys: Sequence[str], *, reach: float = 30.0, bins: int = 240, around: float = 0.75, least: int = 10) -> DataFrame:
    """The most frequent offset (rx - x, ry - y) of all pairs within ``reach``, refined by the median of the offsets close
    to that bin's center.  Of equally full bins the first in row-major order counts."""
    size = 2 * reach / bins
    edge = lambda c: F.least(F.floor((F.col(c) + reach) / size), F.lit(bins - 1)).cast("bigint")
    offsets = pairs.select(*keys, (F.col("rx") - F.col("x")).alias("dx"), (F.col("ry") - F.col("y")).alias("dy")).where((F.abs("dx") <= reach) & (F.abs("dy") <= reach))
    binned = offsets.groupBy(*keys, edge("dx").alias("bx"), edge("dy").alias("by")).agg(F.count("*").alias("n"))
    total = binned.groupBy(*keys).agg(F.sum("n").alias("pairs"), F.max_by(F.struct("bx", "by"), F.struct("n", (-F.col("bx")).alias("x"), (-F.col("by")).alias("y"))).alias("top")).where(F.col("pairs") >= least)
    center = lambda k: -reach + size * (F.col(f"top.{k}") + 0.5)
    peak = total.select(*keys, "pairs", center("bx").alias("peak_x"), center("by").alias("peak_y"))
    near = offsets.join(peak, list(keys)).where((F.abs(F.col("dx") - F.col("peak_x")) <= around) & (F.abs(F.col("dy") - F.col("peak_y")) <= around))
    return near.groupBy(*keys).agg(F.first("pairs").alias("pairs"), median("dx").alias("dx"), median("dy").alias("dy"), F.count("*").alias("n_near"))


def precision_by(matches: DataFrame, keys: Sequence[str], *, least: int = 5, floor: float = 0.05) -> DataFrame:
    """By ``keys``: n, position_rms_px (null for fewer than ``least`` matches), and the RMS about the median of the
    ``mag_residual`` within three scaled deviations or ``floor`` of it.  ``matches``: d2 and mag_residual.

    Defined results: null residuals take no part in the latter; keys that are null form groups of their own and have no
    magnitude RMS; an empty table gives none."""
    values = matches.where("mag_residual is not null").select(*keys, "mag_residual")
    mid = values.groupBy(*keys).agg(median("mag_residual").alias("mid"))
    off = values.join(mid, list(keys)).withColumn("off", F.abs(F.col("mag_residual") - F.col("mid")))
    mad = off.groupBy(*keys).agg((F.lit(1.4826) * median("off")).alias("mad"))
    rms = off.join(mad, list(keys)).where(F.col("off") <= F.greatest(3.0 * F.col("mad"), F.lit(floor))).groupBy(*keys).agg(F.sqrt(F.avg(F.col("off") * F.col("off"))).alias("magnitude_rms"))
    place = matches.groupBy(*keys).agg(F.count("*").alias("n"), F.when(F.count("*") >= least, F.sqrt(F.avg("d2"))).alias("position_rms_px"))
    return place.join(rms, list(keys), "left")
