"""Queries of detection on the derived images."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import detection as D
from ..sources.derived import Tables
from .imaging import _image, _stars
from .registry import query

_IMG = "img AS MATERIALIZED (SELECT field_id, px, py, CASE WHEN v > -700 THEN v - 100 ELSE 0.0 END AS v FROM pixels)"
_FWHM, _HALF = 2.8, 3
_S = _FWHM / (2.0 * math.sqrt(2.0 * math.log(2.0)))
_G = [math.exp(-k * k / (2.0 * _S * _S)) for k in range(-_HALF, _HALF + 1)]
_N, _TOTAL, _SQUARES = len(_G) ** 2, sum(_G) ** 2, sum(x * x for x in _G) ** 2


@query("pixels", sql=f"""
WITH {_IMG}, k AS (SELECT unnest(range(-{_HALF}, {_HALF + 1})) AS k),
gx AS (SELECT field_id, px - k AS px, py, sum(v * exp(-k * k / {2.0 * _S * _S!r})) AS g, sum(v) AS b FROM img CROSS JOIN k WHERE px - k BETWEEN 0 AND 199 GROUP BY ALL),
gy AS (SELECT field_id, px, py - k AS py, sum(g * exp(-k * k / {2.0 * _S * _S!r})) AS g, sum(b) AS b FROM gx CROSS JOIN k WHERE py - k BETWEEN 0 AND 199 GROUP BY ALL),
m AS (SELECT field_id, px, py, (g - b * {_TOTAL / _N!r}) / {_SQUARES - _TOTAL * _TOTAL / _N!r} AS match FROM gy),
a AS (SELECT *, max(match) OVER (PARTITION BY field_id, py ORDER BY px RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS t FROM m),
b AS (SELECT *, max(t) OVER (PARTITION BY field_id, px ORDER BY py RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS top FROM a)
SELECT field_id, px, py, round(match, 4) AS match FROM b WHERE match > 10 AND match >= top""")
def point_sources(t: Tables) -> DataFrame:
    """Peaks of the matched filter over all images."""
    return D.point_sources(_image(t), fwhm=_FWHM, threshold=10.0, half=_HALF).select("field_id", "px", "py", F.round("match", 4).alias("match"))


@query("pixels", sql=f"""
WITH RECURSIVE {_IMG}, lit AS MATERIALIZED (SELECT field_id, py * 1048576 + px AS id, px, py, v FROM img WHERE v > 25),
e AS MATERIALIZED (SELECT a.field_id, a.id AS i, b.id AS j FROM lit a CROSS JOIN (SELECT unnest([-1, 0, 1]) AS dx) x CROSS JOIN (SELECT unnest([-1, 0, 1]) AS dy) y JOIN lit b ON b.field_id = a.field_id AND b.px = a.px + dx AND b.py = a.py + dy),
reach AS (SELECT field_id, i, j FROM e UNION SELECT r.field_id, r.i, e.j FROM reach r JOIN e ON r.field_id = e.field_id AND r.j = e.i),
g AS (SELECT field_id, i, min(j) AS segment FROM reach GROUP BY ALL)
SELECT g.field_id, segment, count(*) AS n, round(sum(v), 4) AS flux, round(max(v), 4) AS peak, round(sum(v * px) / sum(v), 5) AS x, round(sum(v * py) / sum(v), 5) AS y FROM g JOIN lit ON lit.field_id = g.field_id AND lit.id = g.i GROUP BY ALL HAVING count(*) >= 5""")
def segment_sources(t: Tables) -> DataFrame:
    """Connected bright pixels over all images."""
    s = D.segments(_image(t), threshold=25.0)
    return s.select("field_id", "segment", "n", F.round("flux", 4).alias("flux"), F.round("peak", 4).alias("peak"), F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


@query()
def joint_fluxes(t: Tables) -> DataFrame:
    """Fluxes of blended stars and a flat background, fitted together by group."""
    f = D.joint_fluxes(_stars(t), _image(t), sigma=1.2)
    return f.select("field_id", "ref_id", "group_id", F.round("flux", 4).alias("flux"), F.round("background", 4).alias("background"), "settled")
