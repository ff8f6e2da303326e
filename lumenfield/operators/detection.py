"""Detection on pixel rows: point sources by a separable matched filter, segments by connected pixels, joint fluxes of blends."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import rounds
from .pixels import around, good
from .shared import settle


def _tapped(value: str, along: str, across: str, weights: Sequence[float]) -> Column:
    """The weighted sum of the pixels around along one axis; a tap whose row is missing counts as zero."""
    line, half = W.partitionBy("field_id", across).orderBy(along), len(weights) // 2
    taps = [F.col(value) * weights[half]]
    for k in range(1, half + 1):
        for step, at in ((F.lead, k), (F.lag, -k)):
            taps.append(F.when(step(along, k).over(line) == F.col(along) + at, step(value, k).over(line) * weights[half + at]).otherwise(0.0))
    return sum(taps[1:], taps[0])


def matched_filter(image: DataFrame, fwhm: float, *, half: int = 3) -> DataFrame:
    """``image`` with ``match``: the amplitude of a round Gaussian on a flat sky that fits best around each pixel.

    The kernel is a Gaussian less its mean, so the filter is two separable ones, each a pass along x and a pass along y in
    windows of one line of an image.  Defined results: bad, null and NaN pixels count as zero; rows that repeat a pixel count as one,
    the brightest; null fields and places go."""
    sigma = fwhm / (2.0 * math.sqrt(2.0 * math.log(2.0)))
    g = [math.exp(-k * k / (2.0 * sigma * sigma)) for k in range(-half, half + 1)]
    n, total, squares = len(g) ** 2, sum(g) ** 2, sum(x * x for x in g) ** 2
    rows = image.where("field_id is not null and px is not null and py is not null").groupBy("field_id", "px", "py").agg(F.max(F.when(good(F.col("v")), F.col("v")).otherwise(0.0)).alias("v"))
    along = rows.withColumns({"g": _tapped("v", "px", "py", g), "b": _tapped("v", "px", "py", [1.0] * len(g))})
    both = along.withColumns({"g": _tapped("g", "py", "px", g), "b": _tapped("b", "py", "px", [1.0] * len(g))})
    return both.select("field_id", "px", "py", "v", ((F.col("g") - F.col("b") * (total / n)) / (squares - total * total / n)).alias("match"))


def point_sources(image: DataFrame, *, fwhm: float, threshold: float, half: int = 3, box: int = 2) -> DataFrame:
    """Pixels whose match is above ``threshold`` and the greatest within ``box`` pixels either way: field_id, px, py, v, match.

    Defined results: as ``matched_filter``; equal neighbours all stay."""
    found = matched_filter(image, fwhm, half=half)
    line = lambda along, across: W.partitionBy("field_id", across).orderBy(along).rangeBetween(-box, box)
    wide = found.withColumn("top", F.max("match").over(line("px", "py")))
    return wide.withColumn("top", F.max("top").over(line("py", "px"))).where((F.col("match") > threshold) & (F.col("match") >= F.col("top"))).drop("top")


def segments(image: DataFrame, *, threshold: float, least: int = 5) -> DataFrame:
    """Sources as touching pixels (sides or corners) above ``threshold``, of ``least`` pixels or more: field_id, segment (its first pixel, as
    py * 2**20 + px), n, flux, peak, x, y (centroid).  Labels fall by pointer jumping over rows, so that a segment may span any tiles.

    Defined results: bad, null and NaN pixels are dark; null fields and places go; a pixel that repeats counts once, as its brightest."""
    lit = image.where(good(F.col("v")) & (F.col("v") > threshold) & F.col("field_id").isNotNull() & F.col("px").isNotNull() & F.col("py").isNotNull())
    lit = lit.groupBy("field_id", "px", "py").agg(F.max("v").alias("v")).withColumns({"pixel": F.col("py") * (1 << 20) + F.col("px"), "x": F.col("px").cast("double"), "y": F.col("py").cast("double")})
    labelled = rounds.groups(settle(lit), 1.5, point_id="pixel")
    center = lambda c: (F.sum(F.col("v") * F.col(c)) / F.sum("v")).alias(c)
    return labelled.groupBy("field_id", F.col("group_id").alias("segment")).agg(F.count("*").alias("n"), F.sum("v").alias("flux"), F.max("v").alias("peak"), center("x"), center("y")).where(F.col("n") >= least)


def joint_fluxes(sources: DataFrame, image: DataFrame, *, sigma: float, half: int = 5, reach: float = 7.0, most_rounds: int = 200, tolerance: float = 1e-20, source_id: str = "ref_id") -> DataFrame:
    """``source_id``, group_id, flux, background and ``settled`` of each source: Gaussian sources and one flat background fitted together in each
    group of sources that chains of up to ``reach`` connect.

    The normal equations are a table with a row for each two sources that share pixels, so a group of any size stays spread over tasks;
    all groups are solved at once by conjugate gradients, a round two aggregations, scaled by the diagonal.  Rounds end when every group's residual
    has fallen to ``tolerance`` of its first; ``settled`` is false for a group that ``most_rounds`` did not suffice for.
    Defined results: bad, null and NaN pixels take no part; a source without a pixel has no row; null keys and places go; rows that repeat a source
    count as one, the first by place."""
    known = sources.where(F.col("field_id").isNotNull() & F.col(source_id).isNotNull() & ~F.isnan("x") & ~F.isnan("y")).groupBy("field_id", F.col(source_id).alias("s")).agg(F.min(F.struct("x", "y")).alias("at")).select("field_id", "s", "at.x", "at.y")
    grouped = settle(rounds.groups(known, reach, point_id="s"))
    near = around(grouped, image.where(good(F.col("v"))), half, source_id="s").join(grouped.select("field_id", "s", "group_id"), ["field_id", "s"])
    p = F.exp(-((F.col("px") - F.col("x")) ** 2 + (F.col("py") - F.col("y")) ** 2) / (2.0 * sigma * sigma)) / (2.0 * math.pi * sigma * sigma)
    lit = near.select("field_id", "group_id", "px", "py", "v", F.lit(0).alias("kind"), "s", p.alias("p"))
    flat = lit.select("field_id", "group_id", "px", "py", "v").distinct().withColumns({"kind": F.lit(1), "s": F.col("group_id"), "p": F.lit(1.0)})
    design = settle(lit.unionByName(flat))
    group, node = ["field_id", "group_id"], ["field_id", "group_id", "kind", "s"]
    other = design.select(*group, "px", "py", F.col("kind").alias("k2"), F.col("s").alias("s2"), F.col("p").alias("p2"))
    normal = settle(design.join(other, [*group, "px", "py"]).groupBy(*node, "k2", "s2").agg(F.sum(F.col("p") * F.col("p2")).alias("w")))
    diagonal = normal.where("kind = k2 and s = s2").select(*node, F.col("w").alias("w0"))
    start = design.groupBy(*node).agg(F.sum(F.col("p") * F.col("v")).alias("r")).join(diagonal, node)
    state = start.select(*node, "w0", F.lit(0.0).alias("f"), "r", (F.col("r") / F.col("w0")).alias("d"))
    by = W.partitionBy(*group)
    state = settle(state.withColumn("rz", F.sum(F.col("r") * F.col("r") / F.col("w0")).over(by)).withColumn("first", F.col("rz")))
    for _ in range(most_rounds):
        if state.where(F.col("rz") > tolerance * F.col("first")).isEmpty():
            break
        step = normal.join(state.select(*group, F.col("kind").alias("k2"), F.col("s").alias("s2"), F.col("d").alias("d2")), [*group, "k2", "s2"]).groupBy(*node).agg(F.sum(F.col("w") * F.col("d2")).alias("q"))
        live = F.col("rz") > tolerance * F.col("first")
        moved = state.join(step, node).withColumn("dq", F.sum(F.col("d") * F.col("q")).over(by))
        a = F.when(live & (F.col("dq") > 0), F.col("rz") / F.col("dq")).otherwise(0.0)
        moved = moved.withColumns({"f": F.col("f") + a * F.col("d"), "r": F.col("r") - a * F.col("q")})
        moved = moved.withColumn("new", F.sum(F.col("r") * F.col("r") / F.col("w0")).over(by))
        d = F.col("r") / F.col("w0") + F.when(F.col("rz") > 0, F.col("new") / F.col("rz")).otherwise(0.0) * F.col("d")
        state = settle(moved.select(*node, "w0", "f", "r", F.when(live, d).otherwise(F.col("d")).alias("d"), F.when(live, F.col("new")).otherwise(F.col("rz")).alias("rz"), "first"))
    level = state.where("kind = 1").select(*group, F.col("f").alias("background"))
    out = state.where("kind = 0").join(level, group)
    return out.select("field_id", F.col("s").alias(source_id), "group_id", F.col("f").alias("flux"), "background", (F.col("rz") <= tolerance * F.col("first")).alias("settled"))
