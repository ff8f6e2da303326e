"""Image operators over pixel rows (field_id, px, py, v)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import cell, square
from .spatial import has_neighbour

BAD = -700.0
#: Pixels along the side of a tile that sources meet.
TILE = 32


def good(v: Column) -> Column:
    return (v > BAD) & ~F.isnan(v)


def fill_bad(pixels: DataFrame) -> DataFrame:
    """Bad and missing pixels take the median of the field's good ones; in a field without a good one, or without an id,
    they become null.  Every row stays."""
    middle = pixels.where(good(F.col("v"))).groupBy("field_id").agg(F.percentile("v", F.lit(0.5)).alias("field_median"))
    return pixels.join(middle.hint("shuffle_hash"), "field_id", "left").withColumn("v", F.when(good(F.col("v")), F.col("v")).otherwise(F.col("field_median"))).drop("field_median")


def crop(pixels: DataFrame, x0: int, y0: int, width: int, height: int) -> DataFrame:
    return pixels.where((F.col("px") >= x0) & (F.col("px") < x0 + width) & (F.col("py") >= y0) & (F.col("py") < y0 + height))


def tile_summary(pixels: DataFrame, size: int) -> DataFrame:
    tiles = pixels.groupBy("field_id", cell(F.col("py"), size).alias("tile_y"), cell(F.col("px"), size).alias("tile_x"))
    return tiles.agg(F.count("*").alias("n"), F.count_if(good(F.col("v"))).alias("n_good"), F.max(F.when(good(F.col("v")), F.col("v"))).alias("brightest"))


def around(sources: DataFrame, pixels: DataFrame, half: int, *, source_id: str = "ref_id", carry: Sequence[str] = ()) -> DataFrame:
    """Pixels within ``half`` of the rounded place of each source: an equi-join on the tiles that its patch touches, where a tile's
    pixels travel as one array.  dx and dy are offsets from the rounded place; rounding is half to even.  ``carry`` names columns of
    ``sources`` that come along, so that pixels need not look their source up again."""
    named = sources.select("field_id", source_id, "x", "y", *carry, F.rint("x").cast("bigint").alias("cx"), F.rint("y").cast("bigint").alias("cy"))
    for t, c in (("tile_x", "cx"), ("tile_y", "cy")):
        named = named.withColumn(t, F.explode(F.sequence(cell(F.col(c) - half, TILE), cell(F.col(c) + half, TILE))))
    tile = {"tile_x": cell(F.col("px"), TILE), "tile_y": cell(F.col("py"), TILE)}
    held = pixels.select("field_id", "v", *(e.alias(n) for n, e in tile.items()), ((F.col("py") % TILE + TILE) % TILE * TILE + (F.col("px") % TILE + TILE) % TILE).cast("smallint").alias("at"))
    # one list of places for the values and one for the nulls, which a list leaves out: ten bytes a pixel, where structs take forty
    lists = {"at": F.when(F.col("v").isNotNull(), F.col("at")), "v": F.col("v"), "none": F.when(F.col("v").isNull(), F.col("at"))}
    tiles = held.groupBy("field_id", *tile).agg(*(F.collect_list(e).alias(n) for n, e in lists.items()))
    nulls = F.transform("none", lambda k: F.struct(k.alias("at"), F.lit(None).cast(pixels.schema["v"].dataType).alias("v")))
    met = named.join(tiles.hint("merge"), ["field_id", *tile]).select("field_id", source_id, "x", "y", *carry, "cx", "cy", *tile, F.inline(F.concat(F.arrays_zip("at", "v"), nulls)))
    met = met.withColumns({"px": F.col("tile_x") * TILE + F.col("at") % TILE, "py": F.col("tile_y") * TILE + F.floor(F.col("at") / TILE)})
    met = met.withColumns({"dx": (F.col("px") - F.col("cx")).cast("int"), "dy": (F.col("py") - F.col("cy")).cast("int")})
    return met.where((F.abs("dx") <= half) & (F.abs("dy") <= half)).select("field_id", "px", "py", source_id, "x", "y", *carry, "cx", "cy", "dx", "dy", "v")


def halo_tiles(pixels: DataFrame, core: int, halo: int) -> DataFrame:
    """Pixel rows copied to every tile whose core they lie in or within ``halo`` of: tile_x, tile_y and ``owned``."""
    near = lambda c: F.sequence(F.greatest(cell(F.col(c) - halo, core), F.lit(0).cast("bigint")), cell(F.col(c) + halo, core))
    out = pixels.withColumn("tile_x", F.explode(near("px"))).withColumn("tile_y", F.explode(near("py")))
    return out.withColumn("owned", (cell(F.col("px"), core) == F.col("tile_x")) & (cell(F.col("py"), core) == F.col("tile_y")))


def aperture_flux(sources: DataFrame, pixels: DataFrame, radii: dict[str, float], *, source_id: str = "ref_id") -> DataFrame:
    """Sums of the pixels whose centers lie within each radius of a source."""
    half = int(max(radii.values())) + 1
    d2 = square(F.col("px") - F.col("x")) + square(F.col("py") - F.col("y"))
    return around(sources, pixels, half, source_id=source_id).groupBy("field_id", source_id).agg(*(F.sum(F.when(d2 <= r * r, F.col("v")).otherwise(0.0)).alias(n) for n, r in radii.items()))


def texture(sources: DataFrame, pixels: DataFrame, half: int = 12, *, source_id: str = "ref_id") -> DataFrame:
    """Deviation, and the 90 % point and the maximum above the median, of the patch around each source."""
    p = around(sources, pixels, half, source_id=source_id).groupBy("field_id", source_id).agg(F.count("*").alias("n"), F.stddev_pop("v").alias("std"), F.percentile("v", F.array(F.lit(0.5), F.lit(0.9))).alias("q"), F.max("v").alias("top"))
    return p.select("field_id", source_id, "n", "std", (F.col("q")[1] - F.col("q")[0]).alias("p90_above"), (F.col("top") - F.col("q")[0]).alias("max_above"))


def whole_patches(sources: DataFrame, pixels: DataFrame, half: int, *, source_id: str = "ref_id") -> DataFrame:
    """Patches as arrays in row-major order; a source whose patch leaves the image gives none."""
    p = around(sources, pixels, half, source_id=source_id).groupBy("field_id", source_id).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("dy", "dx", "v"))).alias("cells"))
    return p.where(F.col("n") == (2 * half + 1) ** 2).select("field_id", source_id, F.transform("cells", lambda c: c["v"]).alias("patch"))


def stamp_moments(sources: DataFrame, pixels: DataFrame, half: int, *, source_id: str = "ref_id") -> DataFrame:
    """Sum, centroid and widths (of equal Gaussians) of positive stamp pixels, and the number of negative ones."""
    p = around(sources, pixels, half, source_id=source_id).withColumn("w", F.greatest("v", F.lit(0.0)))
    s = p.groupBy("field_id", source_id).agg(F.sum("v").alias("total"), F.count_if(F.col("v") < 0).alias("negative"), F.sum("w").alias("w"), *(F.sum(F.col("w") * e).alias(k) for k, e in {"sx": F.col("dx"), "sy": F.col("dy"), "sxx": F.col("dx") * F.col("dx"), "syy": F.col("dy") * F.col("dy"), "sxy": F.col("dx") * F.col("dy")}.items()))
    c = F.col
    mx, my = c("sx") / c("w"), c("sy") / c("w")
    a, b, d = c("sxx") / c("w") - mx * mx, c("sxy") / c("w") - mx * my, c("syy") / c("w") - my * my
    root = F.sqrt(square((a - d) / 2.0) + b * b)
    width = lambda e: F.lit(2.354820045) * F.sqrt(F.greatest(e, F.lit(0.0)))
    return s.where("w > 0").select("field_id", source_id, "total", "negative", mx.alias("centroid_dx"), my.alias("centroid_dy"), width((a + d) / 2.0 + root).alias("major_fwhm"), width((a + d) / 2.0 - root).alias("minor_fwhm"))


def best_crop(pixels: DataFrame, size: int, *, above: float = 8.0) -> DataFrame:
    """The grid crop with most pixels above the median plus ``above`` median absolute deviations; the first of equals."""
    mid = pixels.groupBy("field_id").agg(F.percentile("v", F.lit(0.5)).alias("mid"))
    mad = pixels.join(mid.hint("shuffle_hash"), "field_id").groupBy("field_id").agg(F.first("mid").alias("mid"), F.percentile(F.abs(F.col("v") - F.col("mid")), F.lit(0.5)).alias("mad"))
    score = pixels.join(mad.hint("shuffle_hash"), "field_id").groupBy("field_id", cell(F.col("py"), size).alias("cy"), cell(F.col("px"), size).alias("cx")).agg(F.count_if(F.col("v") > F.col("mid") + above * F.col("mad")).alias("score"))
    first = F.row_number().over(W.partitionBy("field_id").orderBy(F.desc("score"), "cy", "cx"))
    return score.withColumn("place", first).where("place = 1").select("field_id", (F.col("cx") * size).alias("x0"), (F.col("cy") * size).alias("y0"), "score")


def near_bright_core(sources: DataFrame, pixels: DataFrame, rms: float, radius: float = 10.0, *, source_id: str = "ref_id") -> DataFrame:
    """Sources with a core pixel (above the 99.995 percentile and 20 rms) within ``radius``."""
    cut = pixels.groupBy("field_id").agg(F.greatest(F.percentile("v", F.lit(0.99995)), F.lit(20.0 * rms)).alias("cut"))
    core = pixels.join(cut.hint("shuffle_hash"), "field_id").where(F.col("v") >= F.col("cut")).select("field_id", F.col("px").cast("double").alias("x"), F.col("py").cast("double").alias("y"))
    return has_neighbour(sources, core, radius, left_id=source_id)
