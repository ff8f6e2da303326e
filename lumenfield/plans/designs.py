"""Ranked selections, labels, registration and iterative operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import geometry as G
from ..operators import recovery, robust, rounds, scans
from ..operators import selection as L
from ..operators import spatial as S
from ..sources.derived import Tables
from .matching import _CLEAN, _MATCH, _MATCHED, _QUAL, _QUALITY, _near, clean_refs
from .registry import query

_SELF = "(SELECT a.field_id, a.det_id, min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d2 FROM {0} a JOIN {0} b ON a.field_id = b.field_id AND a.det_id <> b.det_id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {1} GROUP BY ALL)"
_SOME = "few AS (SELECT field_id, ref_id AS det_id, x, y, (26e0 - mag) * 1e3 AS flux, (26e0 - mag) * 1e2 AS snr FROM refs)"


def _some(t: Tables) -> DataFrame:
    return t.refs.selectExpr("field_id", "ref_id as det_id", "x", "y", "(26d - mag) * 1e3 as flux", "(26d - mag) * 1e2 as snr")


@query("refs", sql=f"""
WITH {_SOME}, b AS (SELECT s.*, n.d2, row_number() OVER (PARTITION BY s.field_id ORDER BY snr DESC, s.det_id) = 1 AS first FROM few s LEFT JOIN {_SELF.format("few", 144)} n USING (field_id, det_id) WHERE snr >= 25),
m AS (SELECT *, count(*) FILTER (WHERE d2 IS NULL OR d2 >= 144 OR first) OVER (PARTITION BY field_id) AS n_wide FROM b),
c AS (SELECT * FROM m WHERE CASE WHEN n_wide < 5 THEN d2 IS NULL OR d2 >= 36 OR first ELSE d2 IS NULL OR d2 >= 144 OR first END)
SELECT field_id, det_id, snr, row_number() OVER (PARTITION BY field_id ORDER BY snr DESC, det_id) AS place FROM c QUALIFY place <= 40""")
def isolated_bright_topk(t: Tables) -> DataFrame:
    return L.isolated_bright(_some(t), separation=12.0, most=40).select("field_id", "det_id", "snr", "place")


@query("refs", sql=f"""
WITH {_SOME} SELECT field_id, det_id, flux, row_number() OVER (PARTITION BY field_id ORDER BY flux DESC, det_id) AS place FROM few s LEFT JOIN {_SELF.format("few", 81)} n USING (field_id, det_id) WHERE d2 IS NULL OR d2 >= 81 QUALIFY place <= 80""")
def stamp_selection(t: Tables) -> DataFrame:
    return L.stamps(_some(t)).select("field_id", "det_id", "flux", "place")


@query("refs", sql="""
WITH h AS (SELECT field_id, cast(floor(x / 80) AS bigint) AS ix, cast(floor(y / 80) AS bigint) AS iy, count(*) AS n FROM refs WHERE x >= 0 AND x < 1200 AND y >= 0 AND y < 1200 GROUP BY ALL),
g AS (SELECT f.field_id, a.i AS ix, b.i AS iy FROM (SELECT DISTINCT field_id FROM h) f CROSS JOIN (SELECT unnest(range(15)) AS i) a CROSS JOIN (SELECT unnest(range(15)) AS i) b),
s AS (SELECT g.field_id, g.ix, g.iy, cast(coalesce(sum(h.n), 0) AS bigint) AS score FROM g LEFT JOIN h ON g.field_id = h.field_id AND h.ix BETWEEN g.ix - 2 AND g.ix + 2 AND h.iy BETWEEN g.iy - 2 AND g.iy + 2 GROUP BY ALL)
SELECT field_id, cast(least(greatest(round_even((ix + 0.5) * 80 - 200, 0), 0), 800) AS bigint) AS x0, cast(least(greatest(round_even((iy + 0.5) * 80 - 200, 0), 0), 800) AS bigint) AS y0, score AS n_in_box
FROM s QUALIFY row_number() OVER (PARTITION BY field_id ORDER BY score DESC, iy, ix) = 1""")
def densest_crop(t: Tables) -> DataFrame:
    return L.densest_crop(t.refs, size=1200, crop=400)


@query("refs", sql="""
WITH r AS (SELECT field_id % 2 AS target, field_id AS exposure, x, y FROM refs WHERE nv >= 1),
h AS (SELECT target, exposure, cast(floor(x / 80) AS bigint) AS ix, cast(floor(y / 80) AS bigint) AS iy, count(*) AS n FROM r WHERE x >= 0 AND x < 1200 AND y >= 0 AND y < 1200 GROUP BY ALL),
g AS (SELECT f.target, f.exposure, a.i AS ix, b.i AS iy FROM (SELECT DISTINCT target, exposure FROM h) f CROSS JOIN (SELECT unnest(range(15)) AS i) a CROSS JOIN (SELECT unnest(range(15)) AS i) b),
s AS (SELECT g.target, g.exposure, g.ix, g.iy, cast(coalesce(sum(h.n), 0) AS bigint) AS score FROM g LEFT JOIN h ON g.target = h.target AND g.exposure = h.exposure AND h.ix BETWEEN g.ix - 2 AND g.ix + 2 AND h.iy BETWEEN g.iy - 2 AND g.iy + 2 GROUP BY ALL),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY target, exposure ORDER BY score DESC, iy, ix) = 1)
SELECT target, exposure, score AS n_in_box FROM b QUALIFY row_number() OVER (PARTITION BY target ORDER BY score DESC, exposure) = 1""")
def best_exposure(t: Tables) -> DataFrame:
    rows = t.refs.where("nv >= 1").select(F.expr("field_id % 2").alias("target"), F.col("field_id").alias("exposure"), "x", "y")
    return L.densest_crop(rows, size=1200, crop=400, keys=("target", "exposure")).groupBy("target").agg(F.max_by(F.struct("exposure", "n_in_box"), F.struct("n_in_box", (-F.col("exposure")).alias("e"))).alias("b")).select("target", "b.*")


@query("refs", "dets", sql=f"""
WITH {_QUALITY}, {_near('dets', 'quality', '2')}, hit AS (SELECT DISTINCT field_id, ref_id FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY field_id, det_id ORDER BY d2, ref_id) = 1) t),
miss AS (SELECT q.*, n FROM quality q JOIN dens USING (field_id, ref_id) ANTI JOIN hit USING (field_id, ref_id)),
a AS (SELECT field_id, count(*) OVER (PARTITION BY field_id) AS n_missed, ref_id AS densest_missed FROM miss QUALIFY row_number() OVER (PARTITION BY field_id ORDER BY n DESC, ref_id) = 1),
b AS (SELECT m.field_id, m.ref_id AS missed_near_bright FROM miss m JOIN quality s ON m.field_id = s.field_id AND s.mag <= 18 AND s.ref_id <> m.ref_id QUALIFY row_number() OVER (PARTITION BY m.field_id ORDER BY (m.x - s.x) * (m.x - s.x) + (m.y - s.y) * (m.y - s.y), m.ref_id) = 1)
SELECT field_id, densest_missed, n_missed, missed_near_bright FROM a LEFT JOIN b USING (field_id)""")
def failure_cases(t: Tables) -> DataFrame:
    return L.failure_cases(t.dets, t.refs)


@query("refs", "dets", sql=f"""
WITH {_QUAL}, few AS (SELECT * FROM quality), n AS (SELECT d.field_id, d.det_id, min((d.x - r.x) * (d.x - r.x) + (d.y - r.y) * (d.y - r.y)) AS d2 FROM dets d JOIN few r ON d.field_id = r.field_id AND (d.x - r.x) * (d.x - r.x) + (d.y - r.y) * (d.y - r.y) <= 64 GROUP BY ALL),
l AS (SELECT d.field_id, d.det_id, CASE WHEN d2 < 4 THEN 1 WHEN d2 IS NULL OR d2 > 64 THEN 0 END AS label FROM dets d LEFT JOIN n USING (field_id, det_id)),
k AS (SELECT *, count(*) FILTER (WHERE label = 1) OVER (PARTITION BY field_id) AS pos, row_number() OVER (PARTITION BY field_id, label ORDER BY (det_id % 1000003 * 48271) % 2147483647, det_id) AS place FROM l WHERE label IS NOT NULL)
SELECT field_id, det_id, label FROM k WHERE label = 1 OR place <= least(greatest(pos * 5, 400), 2000)""")
def training_labels(t: Tables) -> DataFrame:
    return L.training_labels(t.dets, scans.quality_refs(t.refs).select("field_id", "ref_id", "x", "y"))


@query("refs", "dets", sql=f"""
WITH {_near('dets', 'refs', '2')}, {_MATCH}, iso AS (SELECT a.field_id, a.ref_id FROM refs a LEFT JOIN refs b ON a.field_id = b.field_id AND a.ref_id <> b.ref_id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < 49 WHERE a.mag <= 19.5 GROUP BY a.field_id, a.ref_id HAVING count(b.ref_id) = 0),
pos AS (SELECT m.field_id, m.det_id FROM m JOIN iso USING (field_id, ref_id)), near AS (SELECT DISTINCT d.field_id, d.det_id FROM dets d JOIN refs r ON d.field_id = r.field_id AND (d.x - r.x) * (d.x - r.x) + (d.y - r.y) * (d.y - r.y) <= 64)
SELECT d.field_id, d.det_id, CASE WHEN pos.det_id IS NOT NULL THEN 1 WHEN near.det_id IS NULL THEN 0 ELSE -1 END AS label FROM dets d LEFT JOIN pos USING (field_id, det_id) LEFT JOIN near USING (field_id, det_id)""")
def calibration_labels(t: Tables) -> DataFrame:
    return L.calibration_labels(t.dets, t.refs)


@query("refs", "dets", "scored", sql="""
WITH d AS (SELECT dets.field_id, det_id, x, y, score, ((cast(floor(x / 200) AS bigint) + cast(floor(y / 200) AS bigint)) % 3 + 3) % 3 = 2 AS test FROM dets JOIN scored USING (field_id, det_id)),
r AS (SELECT *, ((cast(floor(x / 200) AS bigint) + cast(floor(y / 200) AS bigint)) % 3 + 3) % 3 = 2 AS test FROM refs),
k AS (SELECT * FROM (VALUES ('raw'), ('retained')) k(kind) CROSS JOIN (VALUES ('all'), ('held_out')) p(part)),
dd AS (SELECT d.*, kind, part FROM d CROSS JOIN k WHERE (kind = 'raw' OR score >= 0.5) AND (part = 'all' OR test)), rr AS (SELECT r.field_id, ref_id, x, y, kind, part FROM r CROSS JOIN k WHERE part = 'all' OR test),
p AS (SELECT dd.field_id, dd.kind, dd.part, det_id, ref_id FROM dd JOIN rr ON dd.field_id = rr.field_id AND dd.kind = rr.kind AND dd.part = rr.part AND (dd.x - rr.x) * (dd.x - rr.x) + (dd.y - rr.y) * (dd.y - rr.y) <= 4 QUALIFY row_number() OVER (PARTITION BY dd.field_id, dd.kind, dd.part, det_id ORDER BY (dd.x - rr.x) * (dd.x - rr.x) + (dd.y - rr.y) * (dd.y - rr.y), ref_id) = 1),
h AS (SELECT field_id, kind, part, count(DISTINCT ref_id) AS k FROM p GROUP BY ALL), n AS (SELECT field_id, kind, part, count(*) AS n FROM rr GROUP BY ALL), m AS (SELECT field_id, kind, part, count(*) AS m FROM dd GROUP BY ALL)
SELECT field_id, kind, part, n AS n_reference, m AS n_detection, coalesce(k, 0) AS recovered, round(coalesce(k, 0) / cast(n AS double), 6) AS recall, round(coalesce(k, 0) / cast(m AS double), 6) AS match_lower_bound FROM n JOIN m USING (field_id, kind, part) LEFT JOIN h USING (field_id, kind, part)""")
def adaptation_eval(t: Tables) -> DataFrame:
    return L.adaptation_eval(t.dets.join(t.scored.select("field_id", "det_id", "score"), ["field_id", "det_id"]), t.refs, threshold=0.5)


@query("refs", sql=f"""
WITH {_QUAL}, dens AS (SELECT a.field_id, a.ref_id, count(b.ref_id) AS n FROM quality a LEFT JOIN quality b ON a.field_id = b.field_id AND a.ref_id <> b.ref_id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 900 GROUP BY ALL),
q AS (SELECT field_id, cast(floor(quantile_cont(n, 0.25)) AS bigint) AS low_max, cast(ceil(quantile_cont(n, 0.75)) AS bigint) AS high_min FROM dens GROUP BY ALL)
SELECT field_id, low_max, high_min, count(*) FILTER (WHERE n <= low_max) AS n_low, count(*) FILTER (WHERE n >= high_min) AS n_high FROM dens JOIN q USING (field_id) GROUP BY ALL""")
def density_quartile_bands(t: Tables) -> DataFrame:
    return L.density_bands(S.local_density(scans.quality_refs(t.refs).select("field_id", "ref_id", "x", "y"), 30.0), density="neighbours")


@query("dets", sql="""
WITH t AS (SELECT DISTINCT field_id, least(greatest(cast(floor(y / 200) AS bigint), 0), 5) * 6 + least(greatest(cast(floor(x / 200) AS bigint), 0), 5) AS tile FROM dets),
p AS (SELECT field_id, tile, r AS repeat FROM t CROSS JOIN (SELECT unnest(range(3)) AS r) r WHERE (tile * 17 + 11) % 5 <= 2),
o AS (SELECT *, row_number() OVER (PARTITION BY field_id, repeat ORDER BY (tile * 7919 + repeat * 104729 + field_id * 31) * 48271 % 2147483647, tile) AS place FROM p)
SELECT field_id, b AS budget, repeat, tile FROM o JOIN (SELECT unnest([1, 2, 4, 8]) AS b) b ON place <= b""")
def budget_design(t: Tables) -> DataFrame:
    tile = C.tile_id(F.col("x"), F.col("y"))
    tiles = t.dets.select("field_id", tile.alias("tile")).distinct().withColumn("role", C.tile_role(F.col("tile")))
    return L.budget_design(tiles, (1, 2, 4, 8), 3)


@query("refs", "dets", sql="""
WITH c AS (SELECT * FROM dets WHERE NOT deblend_flag), p AS (SELECT field_id, ref_id AS det_id, x, y FROM refs),
n AS (SELECT a.field_id, a.det_id, a.x, a.y, count(b.det_id) AS own FROM p a LEFT JOIN p b ON a.field_id = b.field_id AND a.det_id <> b.det_id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 100 GROUP BY ALL),
m AS (SELECT c.field_id, c.det_id, own FROM c JOIN n ON c.field_id = n.field_id AND (c.x - n.x) * (c.x - n.x) + (c.y - n.y) * (c.y - n.y) <= 4 QUALIFY row_number() OVER (PARTITION BY c.field_id, c.det_id ORDER BY (c.x - n.x) * (c.x - n.x) + (c.y - n.y) * (c.y - n.y), n.det_id) = 1),
d AS (SELECT c.field_id, c.det_id, count(p.det_id) AS direct FROM c LEFT JOIN p ON c.field_id = p.field_id AND (c.x - p.x) * (c.x - p.x) + (c.y - p.y) * (c.y - p.y) <= 100 GROUP BY ALL)
SELECT field_id, det_id, coalesce(own, direct) AS neighbours, CASE WHEN coalesce(own, direct) >= 3 THEN 'joint' ELSE 'conservative' END AS route FROM d LEFT JOIN m USING (field_id, det_id)""")
def density_route(t: Tables) -> DataFrame:
    return L.route_density(t.dets.where("not deblend_flag"), t.refs.select("field_id", F.col("ref_id").alias("det_id"), "x", "y"))


@query("refs", "dets", sql=f"""
WITH r AS (SELECT * FROM refs) SELECT r.field_id, r.ref_id, EXISTS (SELECT 1 FROM dets d WHERE d.field_id = r.field_id AND (d.x - r.x) * (d.x - r.x) + (d.y - r.y) * (d.y - r.y) <= 4) AS recovered FROM r""")
def injection_recovery(t: Tables) -> DataFrame:
    sites = t.refs.select("field_id", "ref_id", "x", "y")
    found = S.has_neighbour(sites, t.dets, 2.0, left_id="ref_id").select("field_id", "ref_id", F.lit(True).alias("hit"))
    return sites.join(found, ["field_id", "ref_id"], "left").select("field_id", "ref_id", F.coalesce("hit", F.lit(False)).alias("recovered"))


def _affine_sql(name: str, rows: str) -> str:
    return f"""{name}_o AS (SELECT field_id, avg(x) AS ox, avg(y) AS oy, avg(rx) AS mx, avg(ry) AS my, count(*) AS n FROM {rows} GROUP BY field_id),
{name}_s AS (SELECT field_id, any_value(ox) AS ox, any_value(oy) AS oy, any_value(mx) AS mx, any_value(my) AS my, any_value(n) AS n, sum((x - ox) * (x - ox)) AS uu, sum((x - ox) * (y - oy)) AS uv, sum((y - oy) * (y - oy)) AS vv,
  sum((x - ox) * (rx - mx)) AS up, sum((y - oy) * (rx - mx)) AS vp, sum((x - ox) * (ry - my)) AS uq, sum((y - oy) * (ry - my)) AS vq FROM {rows} JOIN {name}_o USING (field_id) GROUP BY field_id),
{name} AS (SELECT *, (up * vv - vp * uv) / (uu * vv - uv * uv) AS bx, (vp * uu - up * uv) / (uu * vv - uv * uv) AS cx, (uq * vv - vq * uv) / (uu * vv - uv * uv) AS by_, (vq * uu - uq * uv) / (uu * vv - uv * uv) AS cy FROM {name}_s)"""


def _clip_sql(name: str, fit: str, rows: str) -> str:
    return f"""{name}_r AS (SELECT r.*, sqrt((mx + bx * (x - ox) + cx * (y - oy) - rx) * (mx + bx * (x - ox) + cx * (y - oy) - rx) + (my + by_ * (x - ox) + cy * (y - oy) - ry) * (my + by_ * (x - ox) + cy * (y - oy) - ry)) AS res FROM {rows} r JOIN {fit} f USING (field_id)),
{name}_m AS (SELECT field_id, median(res) AS mid FROM {name}_r GROUP BY field_id), {name}_d AS (SELECT field_id, any_value(mid) AS mid, 1.4826 * median(abs(res - mid)) AS mad FROM {name}_r JOIN {name}_m USING (field_id) GROUP BY field_id),
{name} AS (SELECT r.* FROM {name}_r r JOIN {name}_d USING (field_id) WHERE res - mid <= greatest(3.0 * mad, 0.05))"""


_FIT = f"""base AS (SELECT field_id, x, y, rx, ry FROM j WHERE NOT test), {_affine_sql('f0', 'base')}, {_clip_sql('g0', 'f0', 'base')}, {_affine_sql('f1', 'g0')}, {_clip_sql('g1', 'f1', 'base')}, {_affine_sql('f2', 'g1')}, {_clip_sql('g2', 'f2', 'base')}, {_affine_sql('f3', 'g2')}"""


@query("refs", "dets", sql=f"WITH {_QUALITY}, {_MATCHED}, {_FIT} SELECT field_id, n, round(bx, 6) AS bx, round(cx, 6) + 0.0 AS cx, round(by_, 6) + 0.0 AS by, round(cy, 6) AS cy, round(mx - ox, 6) + 0.0 AS dx, round(my - oy, 6) + 0.0 AS dy FROM f3")
def affine_fit(t: Tables) -> DataFrame:
    m = recovery.matched_catalogue(t.dets, t.refs).where("not test")
    f = robust.fit_affine(m.select("field_id", "x", "y", "rx", "ry"), ["field_id"])
    six = lambda c, n: (C.r6(c) + 0.0).alias(n)
    return f.select("field_id", "n", six(F.col("bx"), "bx"), six(F.col("cx"), "cx"), six(F.col("by"), "by"), six(F.col("cy"), "cy"), six(F.col("ax") - F.col("ox"), "dx"), six(F.col("ay") - F.col("oy"), "dy"))


@query("refs", "dets", sql=f"WITH {_QUALITY}, {_MATCHED}, base AS (SELECT field_id, x, y, rx, ry FROM j WHERE NOT test), {_affine_sql('f0', 'base')} SELECT field_id, n, round(bx, 6) AS bx, round(cx, 6) + 0.0 AS cx, round(by_, 6) + 0.0 AS by, round(cy, 6) AS cy, round(mx - ox, 6) + 0.0 AS dx, round(my - oy, 6) + 0.0 AS dy FROM f0")
def affine_plain(t: Tables) -> DataFrame:
    """The affine map of all training matches without clipping; fewer than three keep their places."""
    m = recovery.matched_catalogue(t.dets, t.refs).where("not test")
    f = robust.fit_affine(m.select("field_id", "x", "y", "rx", "ry"), ["field_id"], rounds=0, least=3)
    six = lambda c, n: (C.r6(c) + 0.0).alias(n)
    return f.select("field_id", "n", six(F.col("bx"), "bx"), six(F.col("cx"), "cx"), six(F.col("by"), "by"), six(F.col("cy"), "cy"), six(F.col("ax") - F.col("ox"), "dx"), six(F.col("ay") - F.col("oy"), "dy"))


_METRICS = f"""{_FIT}, tst AS (SELECT field_id, x, y, rx, ry, mag, inst FROM j WHERE test), {_clip_sql('t0', 'f3', 'tst')},
pos AS (SELECT field_id, sqrt(avg(res * res) / 2.0) AS rms FROM t0 GROUP BY field_id), z AS (SELECT field_id, median(mag - inst) AS zp FROM j WHERE NOT test GROUP BY field_id), e AS (SELECT field_id, inst + zp - mag AS v FROM tst JOIN z USING (field_id)),
em AS (SELECT field_id, median(v) AS mid FROM e GROUP BY field_id), ed AS (SELECT field_id, any_value(mid) AS mid, 1.4826 * median(abs(v - mid)) AS mad FROM e JOIN em USING (field_id) GROUP BY field_id),
mg AS (SELECT field_id, stddev_pop(v) AS rms FROM e JOIN ed USING (field_id) WHERE abs(v - mid) <= greatest(3.0 * mad, 0.03) GROUP BY field_id), sz AS (SELECT field_id, count(*) FILTER (WHERE NOT test) AS n_train, count(*) FILTER (WHERE test) AS n_test FROM j GROUP BY field_id)
SELECT sz.field_id, n_train, n_test, round(CASE WHEN n_train >= 10 AND n_test >= 5 THEN pos.rms END, 6) AS rms_1d_px, round(CASE WHEN n_train >= 10 AND n_test >= 5 THEN pos.rms * 50.0 END, 4) AS rms_1d_mas, round(CASE WHEN n_train >= 10 AND n_test >= 5 THEN mg.rms END, 6) AS mag_rms FROM sz LEFT JOIN pos USING (field_id) LEFT JOIN mg USING (field_id)"""


def _metrics(rows: DataFrame) -> DataFrame:
    m = recovery.measurement_metrics(rows)
    return m.select("field_id", "n_train", "n_test", C.r6(F.col("rms_1d_px")).alias("rms_1d_px"), F.round("rms_1d_mas", 4).alias("rms_1d_mas"), C.r6(F.col("mag_rms")).alias("mag_rms"))


@query("refs", "dets", sql=f"WITH {_QUALITY}, {_MATCHED}, {_METRICS}")
def measurement_metrics(t: Tables) -> DataFrame:
    return _metrics(recovery.matched_catalogue(t.dets, t.refs))


@query("refs", "dets", sql=f"WITH {_CLEAN}, {_QUALITY.replace('FROM refs', 'FROM clean')}, {_MATCHED.replace('j AS (', 'j0 AS (', 1)}, j AS (SELECT j0.* FROM j0 JOIN dens USING (field_id, ref_id) WHERE n >= 3), {_METRICS}")
def dense_measurement_metrics(t: Tables) -> DataFrame:
    dense = S.local_density(scans.quality_refs(clean_refs(t)).select("field_id", "ref_id", "x", "y")).where("neighbours >= 3").select("field_id", "ref_id")
    return _metrics(recovery.matched_catalogue(t.dets, clean_refs(t)).join(dense, ["field_id", "ref_id"], "left_semi"))


@query("refs", "dets", sql="""
WITH q AS (SELECT * FROM refs WHERE nv >= 1), d AS (SELECT *, det_id % 3 AS method FROM dets),
p AS (SELECT method, d.field_id, d.det_id, q.ref_id FROM d JOIN q ON d.field_id = q.field_id AND (d.x - q.x) * (d.x - q.x) + (d.y - q.y) * (d.y - q.y) <= 4 QUALIFY row_number() OVER (PARTITION BY method, d.field_id, d.det_id ORDER BY (d.x - q.x) * (d.x - q.x) + (d.y - q.y) * (d.y - q.y), q.ref_id) = 1)
SELECT field_id, ref_id FROM p GROUP BY ALL HAVING count(DISTINCT method) = 3""")
def common_match(t: Tables) -> DataFrame:
    refs = t.refs.where("nv >= 1").select("field_id", "ref_id", "x", "y")
    dets = t.dets.select("field_id", F.expr("det_id % 3").alias("method"), "det_id", "x", "y")
    near = S.nearest(dets, refs, 2.0, left_id="det_id", right_id="ref_id")
    return near.groupBy("field_id", "ref_id").agg(F.countDistinct("method").alias("n")).where("n = 3").select("field_id", "ref_id")


@query(sql="""
WITH c AS (SELECT o_custkey % 6 AS exposure, ((o_orderkey * 31) % 2001 - 1000) / 1e4 + o_custkey % 6 AS dx, ((o_orderkey * 17) % 2001 - 1000) / 1e4 - o_custkey % 6 AS dy FROM orders),
m AS (SELECT exposure, median(dx) AS mx, median(dy) AS my FROM c GROUP BY ALL)
SELECT exposure, round(any_value(mx), 6) + 0.0 AS shift_x, round(any_value(my), 6) + 0.0 AS shift_y, round(sqrt(avg(((dx - mx) * (dx - mx) + (dy - my) * (dy - my)) / 2.0)), 6) AS residual_rms_px, count(*) AS mapped_points FROM c JOIN m USING (exposure) GROUP BY exposure""")
def dither_shift(t: Tables) -> DataFrame:
    points = t.orders.selectExpr("o_custkey % 6 as exposure", "((o_orderkey * 31) % 2001 - 1000) / 1e4 + o_custkey % 6 as dx", "((o_orderkey * 17) % 2001 - 1000) / 1e4 - o_custkey % 6 as dy")
    return G.dither_shift(points, ["exposure"]).select("exposure", (C.r6(F.col("shift_x")) + 0.0).alias("shift_x"), (C.r6(F.col("shift_y")) + 0.0).alias("shift_y"), C.r6(F.col("residual_rms_px")).alias("residual_rms_px"), "mapped_points")


@query(sql="""
WITH s AS (SELECT c_custkey AS id, radians(10.68e0 + ((c_custkey * 7919) % 20000 - 10000) / 1e5) AS a, radians(41.26e0 + ((c_custkey * 104729) % 20000 - 10000) / 1e5) AS d FROM customer), h AS (SELECT radians(10.68e0) AS a0, radians(41.26e0) AS d0),
p AS (SELECT id, cos(d) * sin(a - a0) / (sin(d0) * sin(d) + cos(d0) * cos(d) * cos(a - a0)) AS xi, (cos(d0) * sin(d) - sin(d0) * cos(d) * cos(a - a0)) / (sin(d0) * sin(d) + cos(d0) * cos(d) * cos(a - a0)) AS eta FROM s CROSS JOIN h)
SELECT id, round(600 - degrees(xi) * 3600 / 5e-2, 3) AS x, round(600 + degrees(eta) * 3600 / 5e-2, 3) AS y FROM p""")
def sky_to_pixel(t: Tables) -> DataFrame:
    rows = t.customer.selectExpr("c_custkey as id", "10.68d + ((c_custkey * 7919) % 20000 - 10000) / 1e5 as ra", "41.26d + ((c_custkey * 104729) % 20000 - 10000) / 1e5 as dec")
    px = G.sky_to_pixel(rows, ra0=10.68, dec0=41.26, x0=600.0, y0=600.0, cd=((-0.05, 0.0), (0.0, 0.05)))
    return px.select("id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query("refs", sql="""
WITH g AS (SELECT gx.g AS gx, gy.g AS gy, 1.0e0 + gx.g / 1e3 + gy.g / 2e3 + (gx.g * gy.g) / 1e6 AS v FROM (SELECT unnest([0, 400, 800, 1200]) AS g) gx CROSS JOIN (SELECT unnest([0, 400, 800, 1200]) AS g) gy),
r AS (SELECT field_id, ref_id, least(greatest(x, 0e0), 1199.999e0) AS x, least(greatest(y, 0e0), 1199.999e0) AS y FROM refs),
b AS (SELECT *, floor(x / 400) * 400 AS x0, floor(y / 400) * 400 AS y0 FROM r)
SELECT field_id, ref_id, round(sum(v * (1 - abs(x - gx) / 400) * (1 - abs(y - gy) / 400)), 6) AS value FROM b JOIN g ON gx IN (x0, x0 + 400) AND gy IN (y0, y0 + 400) GROUP BY field_id, ref_id""")
def psf_grid_interpolate(t: Tables) -> DataFrame:
    nodes = t.nation.where("n_nationkey < 4").select((F.col("n_nationkey") * 400).alias("g"))
    grid = nodes.select(F.col("g").alias("gx")).crossJoin(nodes.select(F.col("g").alias("gy"))).withColumn("v", F.lit(1.0) + F.col("gx") / 1000.0 + F.col("gy") / 2000.0 + (F.col("gx") * F.col("gy")) / 1e6)
    return G.grid_interpolate(t.refs.select("field_id", "ref_id", "x", "y"), grid, step=400.0, size=1200.0).select("field_id", "ref_id", C.r6(F.col("value")).alias("value"))


@query("refs", sql="""
WITH RECURSIVE e AS (SELECT a.field_id, a.ref_id AS i, b.ref_id AS j FROM refs a JOIN refs b ON a.field_id = b.field_id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 49),
reach AS (SELECT field_id, i, j FROM e UNION SELECT r.field_id, r.i, e.j FROM reach r JOIN e ON r.field_id = e.field_id AND r.j = e.i)
SELECT field_id, i AS ref_id, min(j) AS group_id FROM reach GROUP BY field_id, i""")
def blend_groups(t: Tables) -> DataFrame:
    return rounds.groups(t.refs.select("field_id", "ref_id", "x", "y"), 7.0, point_id="ref_id").select("field_id", "ref_id", "group_id")


def _thin_sql(rows: str, separation: float, count: int) -> str:
    """Rounds of thinning ``rows`` (field_id, i, o, x, y) as tables n0, n1, ...; the last round must leave nothing."""
    near = f"(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < {separation * separation}"
    out = f"te AS MATERIALIZED (SELECT a.field_id, a.i, b.i AS j, b.o < a.o OR (b.o = a.o AND b.i < a.i) AS after FROM {rows} a JOIN {rows} b ON a.field_id = b.field_id AND a.i <> b.i AND {near}), a0 AS MATERIALIZED (SELECT field_id, i FROM {rows})"
    for k in range(count):
        out += f""",
h{k} AS MATERIALIZED (SELECT DISTINCT te.field_id, te.i FROM te JOIN a{k} b ON b.field_id = te.field_id AND b.i = te.j WHERE after), n{k} AS MATERIALIZED (SELECT a.* FROM a{k} a ANTI JOIN h{k} USING (field_id, i)),
g{k} AS MATERIALIZED (SELECT te.field_id, te.j AS i FROM te JOIN n{k} n ON n.field_id = te.field_id AND n.i = te.i UNION SELECT field_id, i FROM n{k}), a{k + 1} AS MATERIALIZED (SELECT a.* FROM a{k} a ANTI JOIN g{k} USING (field_id, i))"""
    return out


def _greedy_sql(dets: str, refs: str, count: int, name: str = "") -> str:
    """Rounds of greedy matching within 2 px as tables {name}t0, {name}t1, ..."""
    d2 = "(d.x - r.x) * (d.x - r.x) + (d.y - r.y) * (d.y - r.y)"
    out = f"{name}e0 AS MATERIALIZED (SELECT d.field_id, d.det_id, r.ref_id, {d2} AS d2 FROM {dets} d JOIN {refs} r ON d.field_id = r.field_id AND {d2} <= 4 QUALIFY row_number() OVER (PARTITION BY d.field_id, d.det_id ORDER BY d2, r.ref_id) <= 8)"
    for k in range(count):
        first = "row_number() OVER (PARTITION BY field_id, {} ORDER BY d2, det_id, ref_id) = 1"
        e, t = f"{name}e{k}", f"{name}t{k}"
        out += f""",
{t} AS MATERIALIZED (SELECT * FROM {e} QUALIFY {first.format("det_id")} AND {first.format("ref_id")}), {name}e{k + 1} AS MATERIALIZED (SELECT * FROM (SELECT * FROM {e} ANTI JOIN {t} USING (field_id, det_id)) q ANTI JOIN {t} USING (field_id, ref_id))"""
    return out


def _all_rounds(name: str, count: int) -> str:
    return " UNION ALL ".join(f"SELECT * FROM {name}{k}" for k in range(count))


#: Rounds that the longest chains of the small tables ask for, and some more.
_THIN_ROUNDS, _GREEDY_ROUNDS = 24, 16


@query("dets", sql=f"WITH pts AS (SELECT field_id, det_id AS i, -flux AS o, x, y FROM dets), {_thin_sql('pts', 3.0, _THIN_ROUNDS)} SELECT field_id, i AS det_id FROM ({_all_rounds('n', _THIN_ROUNDS)}) t")
def min_separation_thin(t: Tables) -> DataFrame:
    points = t.dets.select("field_id", "det_id", "x", "y", (-F.col("flux")).alias("faintness"))
    return rounds.thin(points, 3.0, point_id="det_id", order="faintness").select("field_id", "det_id")


@query("refs", "dets", sql=f"WITH {_greedy_sql('dets', 'refs', _GREEDY_ROUNDS)} SELECT field_id, det_id, ref_id, round(sqrt(d2), 6) AS dist FROM ({_all_rounds('t', _GREEDY_ROUNDS)}) t")
def match_greedy_edges(t: Tables) -> DataFrame:
    return rounds.greedy_edges(t.dets, t.refs).select("field_id", "det_id", "ref_id", C.r6(F.sqrt("d2")).alias("dist"))
