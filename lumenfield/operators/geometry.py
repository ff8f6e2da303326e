"""Projections and grids as column arithmetic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import square
from .robust import median


def dither_shift(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Median displacement (dx, dy) of the control points of an exposure, and the RMS of what is left in either axis."""
    mid = points.groupBy(*keys).agg(median("dx").alias("shift_x"), median("dy").alias("shift_y"))
    left = (square(F.col("dx") - F.col("shift_x")) + square(F.col("dy") - F.col("shift_y"))) / 2.0
    return points.join(mid, list(keys)).groupBy(*keys, "shift_x", "shift_y").agg(F.sqrt(F.avg(left)).alias("residual_rms_px"), F.count("*").alias("mapped_points"))


def sky_to_pixel(rows: DataFrame, *, ra0: float, dec0: float, x0: float, y0: float, cd: tuple[tuple[float, float], tuple[float, float]]) -> DataFrame:
    """Gnomonic projection of ra and dec (degrees) and the inverse of a diagonal-dominant CD matrix in arcsec a pixel."""
    a, d = F.radians("ra") - F.radians(F.lit(ra0)), F.radians("dec")
    d0 = F.radians(F.lit(dec0))
    under = F.sin(d0) * F.sin(d) + F.cos(d0) * F.cos(d) * F.cos(a)
    xi = F.degrees(F.cos(d) * F.sin(a) / under) * 3600.0
    eta = F.degrees((F.cos(d0) * F.sin(d) - F.sin(d0) * F.cos(d) * F.cos(a)) / under) * 3600.0
    (p, q), (r, s) = cd
    det = p * s - q * r
    return rows.withColumns({"x": x0 + (s * xi - q * eta) / det, "y": y0 + (p * eta - r * xi) / det})


def grid_interpolate(points: DataFrame, grid: DataFrame, *, step: float, size: float) -> DataFrame:
    """``points`` with ``value``: bilinear blend of the four grid nodes (gx, gy, v) around each; places outside take the
    edge.  Points name their four nodes and meet them in an equi-join."""
    inside = lambda c: F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(size - 1e-3))
    low = lambda c: (F.floor(inside(c) / step) * int(step)).cast("bigint")
    both = lambda c: F.explode(F.array(low(c), low(c) + int(step)))
    named = points.withColumn("gx", both("x")).withColumn("gy", both("y"))
    nodes = grid.select(F.col("gx").cast("bigint").alias("gx"), F.col("gy").cast("bigint").alias("gy"), "v")
    weight = (1 - F.abs(inside("x") - F.col("gx")) / step) * (1 - F.abs(inside("y") - F.col("gy")) / step)
    return named.join(nodes, ["gx", "gy"]).groupBy(*points.columns).agg(F.sum(F.col("v") * weight).alias("value"))
