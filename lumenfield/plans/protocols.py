"""Queries of composed protocols."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import protocols as O
from ..operators import recovery, robust, routing
from ..operators import spatial as S
from ..sources.derived import Tables
from .designs import _GREEDY_ROUNDS, _METRICS, _affine_sql, _all_rounds, _clip_sql, _greedy_sql
from .imaging import _image
from .matching import _MATCHED, _QUALITY
from .registry import query


@query("refs", "dets", sql=f"""
WITH {_greedy_sql("dets", "refs", _GREEDY_ROUNDS)}, marked AS MATERIALIZED (SELECT field_id, ref_id, x, y, mag, ((cast(floor(x / 200) AS bigint) + cast(floor(y / 200) AS bigint)) % 3 + 3) % 3 = 2 AS test FROM refs),
one AS MATERIALIZED (SELECT m.field_id, d.x, d.y, d.flux, r.x AS rx, r.y AS ry, r.mag, r.test FROM ({_all_rounds("t", _GREEDY_ROUNDS)}) m JOIN dets d USING (field_id, det_id) JOIN marked r ON r.field_id = m.field_id AND r.ref_id = m.ref_id),
base AS (SELECT field_id, x, y, rx, ry FROM one WHERE NOT test), {_affine_sql("f0", "base")},
moved AS MATERIALIZED (SELECT d.field_id, det_id, flux, CASE WHEN n >= 3 THEN mx + bx * (x - ox) + cx * (y - oy) ELSE x END AS x, CASE WHEN n >= 3 THEN my + by_ * (x - ox) + cy * (y - oy) ELSE y END AS y FROM dets d LEFT JOIN f0 USING (field_id)),
tests AS MATERIALIZED (SELECT * FROM marked WHERE test), {_greedy_sql("moved", "tests", _GREEDY_ROUNDS, "s")},
zero AS (SELECT field_id, median(mag + 2.5 * log10(greatest(flux, 1e-6))) AS zero FROM one WHERE NOT test AND flux > 0 GROUP BY field_id HAVING count(*) >= 5),
again AS (SELECT m.field_id, m.d2, -2.5 * log10(greatest(d.flux, 1e-6)) + zero - r.mag AS off FROM ({_all_rounds("st", _GREEDY_ROUNDS)}) m JOIN dets d USING (field_id, det_id) JOIN marked r ON r.field_id = m.field_id AND r.ref_id = m.ref_id LEFT JOIN zero z ON z.field_id = m.field_id),
scored AS (SELECT field_id, count(*) AS hits, sqrt(avg(d2)) AS rms, stddev_pop(off) FILTER (WHERE abs(off) < 2) AS mag_rms FROM again GROUP BY field_id)
SELECT k.field_id, candidates, test_references, coalesce(hits, 0) AS test_recovered, round(coalesce(hits, 0) / cast(test_references AS double), 6) AS test_recovery, round(rms * 74.0, 6) AS test_position_rms_mas, round(mag_rms, 6) AS test_magnitude_rms, all_catalogue_matches
FROM (SELECT field_id, count(*) FILTER (WHERE test) AS test_references FROM marked GROUP BY field_id) k LEFT JOIN (SELECT field_id, count(*) AS candidates FROM dets GROUP BY field_id) c USING (field_id) LEFT JOIN (SELECT field_id, count(*) AS all_catalogue_matches FROM one GROUP BY field_id) o USING (field_id) LEFT JOIN scored USING (field_id)""")
def score_realigned(t: Tables) -> DataFrame:
    """Scores after a plain affine realignment, with greedy matches."""
    s = O.score_realigned(t.dets, t.refs)
    return s.select("field_id", "candidates", "test_references", "test_recovered", *(C.r6(F.col(c)).alias(c) for c in ("test_recovery", "test_position_rms_mas", "test_magnitude_rms")), "all_catalogue_matches")


_ROUNDS = f"base AS (SELECT field_id, x, y, rx, ry FROM j WHERE NOT test), {_affine_sql('f0', 'base')}"
for _k in range(6):
    _ROUNDS += f", {_clip_sql(f'g{_k}', f'f{_k}', 'base').replace('0.05', '0.15')}, {_affine_sql(f'f{_k + 1}', f'g{_k}')}"
_ROUNDS = _ROUNDS.replace(" AS (SELECT", " AS MATERIALIZED (SELECT")


@query("refs", "dets", sql=f"WITH {_QUALITY}, {_MATCHED}, {_ROUNDS} SELECT field_id, n, round(bx, 6) AS bx, round(cx, 6) + 0.0 AS cx, round(by_, 6) + 0.0 AS by, round(cy, 6) AS cy FROM f6 WHERE n >= 10")
def affine_converged(t: Tables) -> DataFrame:
    """The affine map after six clipping rounds with a floor of 0.15 px, for ten inliers at least."""
    m = recovery.matched_catalogue(t.dets, t.refs).where("not test")
    f = robust.fit_affine(m.select("field_id", "x", "y", "rx", "ry"), ["field_id"], rounds=6, floor=0.15, least=10).where("n >= 10")
    return f.select("field_id", "n", *((C.r6(F.col(c)) + 0.0).alias(c) for c in ("bx", "cx", "by", "cy")))


@query()
def injection_plan(t: Tables) -> DataFrame:
    """Twenty places each for two magnitudes, two density bands and two batches of a field."""
    p = O.injection_plan(t.refs, (20.0, 22.0), {"low": (0, 1), "high": (3, 10_000)}, most_attempts=200_000)
    return p.select("field_id", "mag", "band", "batch", "place", C.r6(F.col("x")).alias("x"), C.r6(F.col("y")).alias("y"), "neighbours")


@query("refs", "dets", "pixels", sql="""
WITH img AS MATERIALIZED (SELECT field_id, px, py, CASE WHEN v > -700 THEN v - 100 ELSE 0.0 END AS v FROM pixels), c AS (SELECT field_id, greatest(quantile_cont(v, 0.99995), 20.0) AS cut FROM img GROUP BY ALL),
core AS MATERIALIZED (SELECT img.* FROM img JOIN c USING (field_id) WHERE v >= cut), hit AS (SELECT DISTINCT d.field_id, d.det_id FROM dets d JOIN core ON d.field_id = core.field_id AND (d.x - px) * (d.x - px) + (d.y - py) * (d.y - py) <= 100),
n AS (SELECT d.field_id, d.det_id, sqrt((d.x - r.x) * (d.x - r.x) + (d.y - r.y) * (d.y - r.y)) AS gap, qfit * 2 AS p FROM dets d JOIN refs r ON d.field_id = r.field_id AND (d.x - r.x) * (d.x - r.x) + (d.y - r.y) * (d.y - r.y) <= 2.25 QUALIFY row_number() OVER (PARTITION BY d.field_id, d.det_id ORDER BY (d.x - r.x) * (d.x - r.x) + (d.y - r.y) * (d.y - r.y), ref_id) = 1),
k AS (SELECT a.field_id, a.det_id, count(*) AS neighbours FROM dets a JOIN dets b ON a.field_id = b.field_id AND a.det_id <> b.det_id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 100 GROUP BY ALL),
q AS (SELECT d.field_id, d.det_id, flux / sqrt(greatest(flux, 0) + 9 * pi() * 2500 + 1e-12) AS snr, psf_fit_quality AS fit, coalesce(neighbours, 0) AS neighbours, gap IS NULL OR gap > 1 AS deblend, hit.det_id IS NOT NULL AS core, p
      FROM dets d LEFT JOIN n USING (field_id, det_id) LEFT JOIN k USING (field_id, det_id) LEFT JOIN hit USING (field_id, det_id))
SELECT field_id, det_id, round(snr, 6) AS snr, neighbours, deblend AS deblend_flag, core AS saturation_neighbour_flag, round(p, 6) AS classifier_probability,
  cast((CASE WHEN snr < 5 THEN 1 ELSE 0 END) + (CASE WHEN fit > 3 THEN 2 ELSE 0 END) + (CASE WHEN neighbours >= 3 THEN 4 ELSE 0 END) + (CASE WHEN core THEN 8 ELSE 0 END) + (CASE WHEN deblend THEN 16 ELSE 0 END) + (CASE WHEN p > 0.2 AND p < 0.8 THEN 32 ELSE 0 END) AS integer) AS quality_bitmask FROM q""")
def blind_quality_catalogue(t: Tables) -> DataFrame:
    """Every detection with its image-only quality columns and bits."""
    q = O.blind_quality_catalogue(t.dets, t.refs, _image(t), rms=50.0, probability=F.col("qfit") * 2)
    return q.select("field_id", "det_id", C.r6(F.col("snr")).alias("snr"), "neighbours", "deblend_flag", "saturation_neighbour_flag", C.r6(F.col("classifier_probability")).alias("classifier_probability"), "quality_bitmask")


@query("refs", "dets", sql="""
WITH q AS (SELECT * FROM refs WHERE nv >= 1), crowd AS (SELECT a.field_id, a.ref_id, count(*) AS n FROM q a JOIN q b ON a.field_id = b.field_id AND a.ref_id <> b.ref_id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 100 GROUP BY ALL),
p AS (SELECT d.det_id % 3 AS method, d.field_id, d.det_id, q.ref_id FROM dets d JOIN q ON d.field_id = q.field_id AND (d.x - q.x) * (d.x - q.x) + (d.y - q.y) * (d.y - q.y) <= 4 QUALIFY row_number() OVER (PARTITION BY d.field_id, d.det_id ORDER BY (d.x - q.x) * (d.x - q.x) + (d.y - q.y) * (d.y - q.y), q.ref_id) = 1),
c AS (SELECT field_id, ref_id FROM p GROUP BY ALL HAVING count(DISTINCT method) = 3)
SELECT field_id, ref_id, n AS neighbours FROM c JOIN crowd USING (field_id, ref_id) JOIN q USING (field_id, ref_id) WHERE n >= 3 AND ((cast(floor(q.x / 200) AS bigint) + cast(floor(q.y / 200) AS bigint)) % 3 + 3) % 3 = 2""")
def common_match_held_out(t: Tables) -> DataFrame:
    """Crowded references of the test cells that every one of three methods matches."""
    refs = t.refs.where("nv >= 1").select("field_id", "ref_id", "x", "y")
    dets = t.dets.select("field_id", "det_id", "x", "y", F.expr("det_id % 3").alias("method"))
    return O.common_matches(dets, S.local_density(refs).where("neighbours >= 3"), refs, methods=3).select("field_id", "ref_id", "neighbours")


@query("refs", "dets", sql=f"""
WITH q AS (SELECT * FROM refs WHERE nv >= 1), crowd AS (SELECT a.field_id, a.ref_id FROM q a JOIN q b ON a.field_id = b.field_id AND a.ref_id <> b.ref_id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 100 WHERE a.mag <= 22 GROUP BY ALL HAVING count(*) >= 3),
p AS (SELECT d.det_id % 3 AS method, d.field_id, d.det_id, d.flux, d.x, d.y, q.ref_id, q.x AS rx, q.y AS ry, q.mag, (d.x - q.x) * (d.x - q.x) + (d.y - q.y) * (d.y - q.y) AS d2 FROM dets d JOIN q ON d.field_id = q.field_id AND (d.x - q.x) * (d.x - q.x) + (d.y - q.y) * (d.y - q.y) <= 4 QUALIFY row_number() OVER (PARTITION BY d.field_id, d.det_id ORDER BY d2, q.ref_id) = 1),
m AS (SELECT *, ((cast(floor(rx / 200) AS bigint) + cast(floor(ry / 200) AS bigint)) % 3 + 3) % 3 = 2 AS test FROM p QUALIFY row_number() OVER (PARTITION BY field_id, method, ref_id ORDER BY d2, det_id) = 1),
c AS (SELECT field_id, ref_id FROM m JOIN crowd USING (field_id, ref_id) WHERE test GROUP BY ALL HAVING count(DISTINCT method) = 3),
j AS (SELECT m.field_id * 3 + method AS field_id, x, y, rx, ry, mag, -2.5 * log10(greatest(flux, 1e-6)) AS inst, test FROM m LEFT JOIN c USING (field_id, ref_id) WHERE NOT test OR c.ref_id IS NOT NULL),
{_METRICS.replace("SELECT sz.field_id, n_train", "SELECT sz.field_id // 3 AS field_id, sz.field_id % 3 AS method, n_train")}""")
def common_match_metrics(t: Tables) -> DataFrame:
    """Position and magnitude RMS of three methods over the crowded references that all of them match."""
    dets = t.dets.withColumn("method", F.expr("det_id % 3"))
    m = recovery.common_match_metrics(dets, t.refs.where("nv >= 1"), methods=3, faintest=22.0)
    return m.select("field_id", "method", "n_train", "n_test", C.r6(F.col("rms_1d_px")).alias("rms_1d_px"), F.round("rms_1d_mas", 4).alias("rms_1d_mas"), C.r6(F.col("mag_rms")).alias("mag_rms"))


@query()
def router_merge(t: Tables) -> DataFrame:
    """Catalogue of crowded places from joint fits and of the others from conservative detections, without doubles."""
    proposals = t.refs.select("field_id", F.col("ref_id").alias("det_id"), "x", "y")
    fits = t.refs.selectExpr("field_id", "ref_id as det_id", "x + (ref_id % 7 - 3) / 10d as x", "y + (ref_id % 5 - 2) / 10d as y", "case when ref_id % 11 = 0 then null else (26d - mag) * 1e3 end as flux")
    merged = routing.merge(proposals, fits, t.dets.where("not deblend_flag").select("field_id", "det_id", "x", "y", "flux"))
    return merged.select("field_id", "det_id", C.r6(F.col("x")).alias("x"), C.r6(F.col("y")).alias("y"), C.r6(F.col("flux")).alias("flux"), "route")
