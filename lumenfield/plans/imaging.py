"""Image operators on derived pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import pixels as P
from ..sources.derived import Tables
from .registry import query

_STARS = "stars AS (SELECT * FROM refs WHERE x < 200 AND y < 200), img AS (SELECT field_id, px, py, CASE WHEN v > -700 THEN v - 100 ELSE 0.0 END AS v FROM pixels)"


def _near(half: int) -> str:
    return f"near AS (SELECT s.field_id, s.ref_id, s.x, s.y, i.px, i.py, i.v, i.px - round_even(s.x, 0) AS dx, i.py - round_even(s.y, 0) AS dy FROM stars s JOIN img i ON s.field_id = i.field_id AND abs(i.px - round_even(s.x, 0)) <= {half} AND abs(i.py - round_even(s.y, 0)) <= {half})"


def _stars(t: Tables) -> DataFrame:
    return t.refs.where("x < 200 and y < 200").select("field_id", "ref_id", "x", "y")


def _image(t: Tables) -> DataFrame:
    return t.pixels.withColumn("v", F.when(F.col("v") > P.BAD, F.col("v") - 100).otherwise(0.0))


@query("pixels", sql="""
WITH tx AS (SELECT unnest(range(4)) AS t), h AS (SELECT field_id, a.t AS tile_x, b.t AS tile_y, px, py, v FROM pixels JOIN tx a ON px >= a.t * 50 - 5 AND px < a.t * 50 + 55 JOIN tx b ON py >= b.t * 50 - 5 AND py < b.t * 50 + 55)
SELECT field_id, tile_x, tile_y, count(*) AS n, count(*) FILTER (WHERE px // 50 = tile_x AND py // 50 = tile_y) AS n_owned FROM h GROUP BY ALL""")
def halo_tiles(t: Tables) -> DataFrame:
    tiles = P.halo_tiles(t.pixels, 50, 5).where("tile_x < 4 and tile_y < 4")
    return tiles.groupBy("field_id", "tile_x", "tile_y").agg(F.count("*").alias("n"), F.count_if("owned").alias("n_owned"))


@query("refs", "pixels", sql=f"""
WITH {_STARS}, {_near(9)} SELECT field_id, ref_id, round(sum(CASE WHEN (px - x) * (px - x) + (py - y) * (py - y) <= 9 THEN v ELSE 0.0 END), 4) + 0.0 AS r3, round(sum(CASE WHEN (px - x) * (px - x) + (py - y) * (py - y) <= 25 THEN v ELSE 0.0 END), 4) + 0.0 AS r5,
       round(sum(CASE WHEN (px - x) * (px - x) + (py - y) * (py - y) <= 64 THEN v ELSE 0.0 END), 4) + 0.0 AS r8 FROM near GROUP BY ALL""")
def aperture_flux(t: Tables) -> DataFrame:
    a = P.aperture_flux(_stars(t), _image(t), {"r3": 3.0, "r5": 5.0, "r8": 8.0})
    return a.select("field_id", "ref_id", *((F.round(r, 4) + 0.0).alias(r) for r in ("r3", "r5", "r8")))


@query("refs", "pixels", sql=f"""
WITH {_STARS}, {_near(12)} SELECT field_id, ref_id, count(*) AS n, round(stddev_pop(v), 5) AS std, round(quantile_cont(v, 0.9) - median(v), 5) + 0.0 AS p90_above, round(max(v) - median(v), 5) + 0.0 AS max_above FROM near GROUP BY ALL""")
def texture_features(t: Tables) -> DataFrame:
    x = P.texture(_stars(t), _image(t))
    return x.select("field_id", "ref_id", "n", F.round("std", 5).alias("std"), (F.round("p90_above", 5) + 0.0).alias("p90_above"), (F.round("max_above", 5) + 0.0).alias("max_above"))


@query("refs", "pixels", sql=f"""
WITH {_STARS}, {_near(5)} SELECT field_id, ref_id, round(min_by(v, (dy + 5) * 11 + dx + 5), 6) + 0.0 AS first, round(max_by(v, (dy + 5) * 11 + dx + 5), 6) + 0.0 AS last, round(max(v), 6) + 0.0 AS peak FROM near GROUP BY ALL HAVING count(*) = 121""")
def extract_patches(t: Tables) -> DataFrame:
    p = P.whole_patches(_stars(t), _image(t), 5)
    six = lambda e, n: (C.r6(e) + 0.0).alias(n)
    return p.select("field_id", "ref_id", six(F.col("patch")[0], "first"), six(F.element_at("patch", -1), "last"), six(F.array_max("patch"), "peak"))


@query("refs", "pixels", sql=f"""
WITH {_STARS}, {_near(6)}, w AS (SELECT *, greatest(v, 0.0) AS w FROM near),
s AS (SELECT field_id, ref_id, sum(v) AS total, count(*) FILTER (WHERE v < 0) AS negative, sum(w) AS w, sum(w * dx) AS sx, sum(w * dy) AS sy, sum(w * (dx * dx)) AS sxx, sum(w * (dy * dy)) AS syy, sum(w * (dx * dy)) AS sxy FROM w GROUP BY ALL HAVING sum(w) > 0),
m AS (SELECT *, sx / w AS mx, sy / w AS my, sxx / w - sx / w * (sx / w) AS a, sxy / w - sx / w * (sy / w) AS b, syy / w - sy / w * (sy / w) AS d FROM s)
SELECT field_id, ref_id, round(total, 4) + 0.0 AS total, negative, round(mx, 5) + 0.0 AS centroid_dx, round(my, 5) + 0.0 AS centroid_dy, round(2.354820045 * sqrt(greatest((a + d) / 2.0 + sqrt((a - d) / 2.0 * ((a - d) / 2.0) + b * b), 0.0)), 4) AS major_fwhm FROM m""")
def stamp_moments(t: Tables) -> DataFrame:
    m = P.stamp_moments(_stars(t), _image(t), 6)
    return m.select("field_id", "ref_id", (F.round("total", 4) + 0.0).alias("total"), "negative", (F.round("centroid_dx", 5) + 0.0).alias("centroid_dx"), (F.round("centroid_dy", 5) + 0.0).alias("centroid_dy"), F.round("major_fwhm", 4).alias("major_fwhm"))


@query("refs", "pixels", sql=f"""
WITH {_STARS}, m AS (SELECT field_id, median(v) AS mid FROM img GROUP BY ALL), d AS (SELECT field_id, any_value(mid) AS mid, median(abs(v - mid)) AS mad FROM img JOIN m USING (field_id) GROUP BY ALL),
s AS (SELECT field_id, py // 50 AS cy, px // 50 AS cx, count(*) FILTER (WHERE v > mid + 8.0 * mad) AS score FROM img JOIN d USING (field_id) GROUP BY ALL)
SELECT field_id, cast(cx * 50 AS bigint) AS x0, cast(cy * 50 AS bigint) AS y0, score FROM s QUALIFY row_number() OVER (PARTITION BY field_id ORDER BY score DESC, cy, cx) = 1""")
def image_only_crop(t: Tables) -> DataFrame:
    return P.best_crop(_image(t), 50)


@query("refs", "pixels", sql=f"""
WITH {_STARS}, c AS (SELECT field_id, greatest(quantile_cont(v, 0.99995), 20.0) AS cut FROM img GROUP BY ALL), core AS (SELECT img.* FROM img JOIN c USING (field_id) WHERE v >= cut)
SELECT DISTINCT s.field_id, s.ref_id FROM stars s JOIN core ON s.field_id = core.field_id AND (s.x - px) * (s.x - px) + (s.y - py) * (s.y - py) <= 100""")
def bright_core_flag(t: Tables) -> DataFrame:
    return P.near_bright_core(_stars(t), _image(t), 1.0).select("field_id", "ref_id")
