"""Spatial matching, density, recovery and calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import recovery, robust, scans
from ..operators import spatial as S
from ..sources.derived import Tables
from .registry import query

_QUAL = "quality AS (SELECT * FROM refs WHERE x >= 12 AND x < 1188 AND y >= 12 AND y < 1188 AND mag < 90 AND err < 0.10 AND qfit < 0.30 AND oth < 1.0 AND nv >= 1)"
_DENS = "dens AS (SELECT a.field_id, a.ref_id, count(b.ref_id) AS n FROM quality a LEFT JOIN quality b ON a.field_id = b.field_id AND a.ref_id <> b.ref_id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 100 GROUP BY ALL)"
_QUALITY = f"""{_QUAL},
held AS (SELECT * FROM quality WHERE (cast(floor(x / 200) AS bigint) + cast(floor(y / 200) AS bigint)) % 3 = 2),
held_dets AS (SELECT * FROM dets WHERE ((cast(floor(x / 200) AS bigint) + cast(floor(y / 200) AS bigint)) % 3 + 3) % 3 = 2),
{_DENS}"""
_WILSON = """
round(CASE WHEN n > 0 THEN greatest((k / cast(n AS double) + 1.96 * 1.96 / (2.0 * n)) / (1.0 + 1.96 * 1.96 / n) - 1.96 * sqrt(k / cast(n AS double) * (1.0 - k / cast(n AS double)) / n + 1.96 * 1.96 / (4.0 * n * n)) / (1.0 + 1.96 * 1.96 / n), 0.0) END, 6) AS ci_lo,
round(CASE WHEN n > 0 THEN least((k / cast(n AS double) + 1.96 * 1.96 / (2.0 * n)) / (1.0 + 1.96 * 1.96 / n) + 1.96 * sqrt(k / cast(n AS double) * (1.0 - k / cast(n AS double)) / n + 1.96 * 1.96 / (4.0 * n * n)) / (1.0 + 1.96 * 1.96 / n), 1.0) END, 6) AS ci_hi"""


def _near(left: str, right: str, radius: str, alias: str = "p") -> str:
    return f"""{alias} AS (SELECT d.field_id, d.det_id, r.ref_id, (d.x - r.x) * (d.x - r.x) + (d.y - r.y) * (d.y - r.y) AS d2 FROM {left} d JOIN {right} r
  ON d.field_id = r.field_id AND (d.x - r.x) * (d.x - r.x) + (d.y - r.y) * (d.y - r.y) <= {radius} * {radius})"""


_MATCH = "m AS (SELECT * FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY field_id, det_id ORDER BY d2, ref_id) = 1) t QUALIFY row_number() OVER (PARTITION BY field_id, ref_id ORDER BY d2, det_id) = 1)"


@query("refs", "dets", sql=f"WITH {_near('dets', 'refs', '2')}, {_MATCH} SELECT field_id, det_id, ref_id, round(sqrt(d2), 6) AS dist FROM m")
def match_one_to_one(t: Tables) -> DataFrame:
    m = S.match_one_to_one(t.dets.select("field_id", "det_id", "x", "y"), t.refs.select("field_id", "ref_id", "x", "y"))
    return m.select("field_id", "det_id", "ref_id", C.r6(F.sqrt("d2")).alias("dist"))


@query("refs", "dets", sql=f"""
WITH {_near('dets', 'refs', '2')}, {_MATCH} SELECT d.field_id, 'detection' AS side, d.det_id AS id, m.det_id IS NOT NULL AS matched FROM dets d LEFT JOIN m USING (field_id, det_id)
UNION ALL SELECT r.field_id, 'reference', r.ref_id, m.ref_id IS NOT NULL FROM refs r LEFT JOIN m USING (field_id, ref_id)""")
def match_masks(t: Tables) -> DataFrame:
    """Both sides of the one-to-one match with a flag for each row."""
    return S.match_masks(t.dets, t.refs)


@query("refs", "dets", sql="""
SELECT a.field_id, a.ref_id, round(sqrt(min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))), 6) AS nearest_px FROM refs a JOIN dets b ON a.field_id = b.field_id GROUP BY ALL""")
def nearest_distance(t: Tables) -> DataFrame:
    out = S.nearest_distance(t.refs, t.dets, left_id="ref_id", start=4.0)
    return out.where("nearest_px is not null").select("field_id", "ref_id", C.r6(F.col("nearest_px")).alias("nearest_px"))


@query("refs", sql="""
SELECT a.field_id, a.ref_id, a.mag <= 19.5 AND count(b.ref_id) = 0 AS isolated FROM refs a LEFT JOIN refs b
ON a.field_id = b.field_id AND a.ref_id <> b.ref_id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < 49 GROUP BY a.field_id, a.ref_id, a.mag""")
def isolated_refs(t: Tables) -> DataFrame:
    return recovery.isolated(t.refs, fwhm=3.5, radius=2.0, brightest=19.5).select("field_id", "ref_id", "isolated")


@query("refs", sql=f"WITH {_QUAL}, {_DENS} SELECT field_id, ref_id, n AS neighbours FROM dens")
def local_density(t: Tables) -> DataFrame:
    return S.local_density(scans.quality_refs(t.refs).select("field_id", "ref_id", "x", "y")).select("field_id", "ref_id", "neighbours")


@query("refs", "dets", sql="""
SELECT field_id, ref_id, count(*) FILTER (WHERE d2 <= 64) AS n8, count(*) FILTER (WHERE d2 <= 100) AS n10, count(*) FILTER (WHERE d2 <= 225) AS n15, count(*) AS n20
FROM (SELECT r.field_id, r.ref_id, (r.x - d.x) * (r.x - d.x) + (r.y - d.y) * (r.y - d.y) AS d2 FROM refs r JOIN dets d ON r.field_id = d.field_id WHERE d2 <= 400) t GROUP BY ALL""")
def multi_radius_density(t: Tables) -> DataFrame:
    points = t.refs.select("field_id", "ref_id", "x", "y")
    out = S.neighbour_counts(points, t.dets, {"n8": 8.0, "n10": 10.0, "n15": 15.0, "n20": 20.0}, point_id="ref_id")
    return out.where("n20 > 0").select("field_id", "ref_id", "n8", "n10", "n15", "n20")


@query(sql="""
WITH a AS (SELECT c_custkey AS id, 10.68 + ((c_custkey * 7919) % 20000) / 1e6 AS ra, 41.26 + ((c_custkey * 104729) % 20000) / 1e6 AS dec FROM customer),
b AS (SELECT o_orderkey AS id, 10.68 + ((o_orderkey * 15485863) % 20000) / 1e6 AS ra, 41.26 + ((o_orderkey * 32452843) % 20000) / 1e6 AS dec FROM orders),
c AS (SELECT cos(radians(median(dec))) AS f FROM b),
p AS (SELECT a.id AS det_id, b.id AS ref_id, (a.ra * f * 3600 - b.ra * f * 3600) * (a.ra * f * 3600 - b.ra * f * 3600) + (a.dec * 3600 - b.dec * 3600) * (a.dec * 3600 - b.dec * 3600) AS d2
      FROM a CROSS JOIN c JOIN b ON abs(a.dec - b.dec) <= 0.001 WHERE d2 <= 0.1 * 0.1)
SELECT det_id, ref_id, round(sqrt(d2), 4) AS sep_arcsec FROM p QUALIFY row_number() OVER (PARTITION BY det_id ORDER BY d2, ref_id) = 1""")
def sky_match(t: Tables) -> DataFrame:
    a = t.customer.selectExpr("c_custkey as det_id", "10.68d + ((c_custkey * 7919) % 20000) / 1e6 as ra", "41.26d + ((c_custkey * 104729) % 20000) / 1e6 as dec")
    b = t.orders.selectExpr("o_orderkey as ref_id", "10.68d + ((o_orderkey * 15485863) % 20000) / 1e6 as ra", "41.26d + ((o_orderkey * 32452843) % 20000) / 1e6 as dec")
    return recovery.sky_match(a, b, radius_arcsec=0.1).select("det_id", "ref_id", F.round("sep_arcsec", 4).alias("sep_arcsec"))


@query("refs", "dets", sql=f"""
WITH {_QUALITY}, strata AS (
  SELECT h.*, 'magnitude' AS axis, CASE WHEN mag <= 18 THEN 'V<=18' WHEN mag <= 20 THEN '18<V<=20' WHEN mag <= 21 THEN '20<V<=21' WHEN mag <= 22 THEN '21<V<=22' ELSE 'V>22' END AS bin FROM held h UNION ALL
  SELECT h.*, 'density', CASE WHEN n <= 1 THEN '0-1 neighbours' WHEN n = 2 THEN '2 neighbours' ELSE '>=3 neighbours' END FROM held h JOIN dens USING (field_id, ref_id)),
p AS (SELECT d.field_id, d.det_id, r.ref_id, axis, bin, (d.x - r.x) * (d.x - r.x) + (d.y - r.y) * (d.y - r.y) AS d2 FROM held_dets d JOIN strata r ON d.field_id = r.field_id AND (d.x - r.x) * (d.x - r.x) + (d.y - r.y) * (d.y - r.y) <= 4),
hit AS (SELECT field_id, axis, bin, count(DISTINCT ref_id) AS k FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY field_id, axis, bin, det_id ORDER BY d2, ref_id) = 1) t GROUP BY ALL),
c AS (SELECT field_id, axis, bin, count(*) AS n, coalesce(max(k), 0) AS k FROM strata LEFT JOIN hit USING (field_id, axis, bin) GROUP BY ALL)
SELECT field_id, axis, bin, n AS n_reference, k AS recovered, round(k / cast(n AS double), 6) AS completeness, {_WILSON} FROM c""")
def stratified_completeness(t: Tables) -> DataFrame:
    return recovery.stratified_completeness(t.dets, t.refs)


@query("refs", "dets", sql=f"""
WITH {_QUALITY}, lim AS (SELECT h.*, l AS mag_limit FROM held h JOIN (SELECT unnest([18, 20, 22]) AS l) t ON mag <= l),
p AS (SELECT d.field_id, d.det_id, r.ref_id, mag_limit, (d.x - r.x) * (d.x - r.x) + (d.y - r.y) * (d.y - r.y) AS d2 FROM held_dets d JOIN lim r ON d.field_id = r.field_id AND (d.x - r.x) * (d.x - r.x) + (d.y - r.y) * (d.y - r.y) <= 4),
hit AS (SELECT field_id, mag_limit, count(DISTINCT ref_id) AS k FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY field_id, mag_limit, det_id ORDER BY d2, ref_id) = 1) t GROUP BY ALL)
SELECT field_id, mag_limit, count(*) AS n_reference, coalesce(max(k), 0) AS recovered, round(coalesce(max(k), 0) / greatest(count(*), 1), 6) AS recall FROM lim LEFT JOIN hit USING (field_id, mag_limit) GROUP BY ALL""")
def completeness_by_limit(t: Tables) -> DataFrame:
    refs, dets = recovery.held_out(scans.quality_refs(t.refs)), recovery.held_out(t.dets)
    return recovery.completeness_by_limit(dets, refs, (18, 20, 22))


@query("refs", "dets", sql=f"""
WITH {_QUALITY}, lim AS (SELECT h.*, l AS mag_limit FROM held h JOIN (SELECT unnest([18, 20, 22, 24]) AS l) t ON mag <= l),
p AS (SELECT d.field_id, d.det_id, r.ref_id, mag_limit, (d.x - r.x) * (d.x - r.x) + (d.y - r.y) * (d.y - r.y) AS d2 FROM dets d JOIN lim r ON d.field_id = r.field_id AND (d.x - r.x) * (d.x - r.x) + (d.y - r.y) * (d.y - r.y) <= 4),
hit AS (SELECT field_id, mag_limit, count(DISTINCT ref_id) AS k FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY field_id, mag_limit, det_id ORDER BY d2, ref_id) = 1) t GROUP BY ALL)
SELECT field_id, mag_limit, count(*) AS n_reference, coalesce(max(k), 0) AS recovered, round(coalesce(max(k), 0) / greatest(count(*), 1), 6) AS recall FROM lim LEFT JOIN hit USING (field_id, mag_limit) GROUP BY ALL""")
def recovery_unrestricted(t: Tables) -> DataFrame:
    return recovery.completeness_by_limit(t.dets, recovery.held_out(scans.quality_refs(t.refs)), (18, 20, 22, 24))


#: The references as if all measured well, so that the protocol's cuts leave crowded places.
_CLEAN = "clean AS (SELECT field_id, ref_id, x, y, mag, 1e-2 AS err, 1e-1 AS qfit, 5e-1 AS oth, 1 AS nv FROM refs)"


def clean_refs(t: Tables) -> DataFrame:
    return t.refs.select("field_id", "ref_id", "x", "y", "mag", F.lit(0.01).alias("err"), F.lit(0.1).alias("qfit"), F.lit(0.5).alias("oth"), F.lit(1).alias("nv"))


@query("refs", "dets", sql=f"""
WITH {_CLEAN}, {_QUALITY.replace("FROM refs", "FROM clean")}, sub AS (SELECT h.* FROM held h JOIN dens USING (field_id, ref_id) WHERE mag <= 20 AND n >= 3), {_near('held_dets', 'sub', '2')},
hit AS (SELECT field_id, count(DISTINCT ref_id) AS k FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY field_id, det_id ORDER BY d2, ref_id) = 1) t GROUP BY ALL),
c AS (SELECT field_id, count(*) AS n, coalesce(max(k), 0) AS k FROM sub LEFT JOIN hit USING (field_id) GROUP BY ALL)
SELECT field_id, n AS n_reference, k AS recovered, round(k / cast(n AS double), 6) AS recall, {_WILSON} FROM c""")
def dense_recall(t: Tables) -> DataFrame:
    return recovery.dense_recall(t.dets, clean_refs(t), faintest=20.0, least=3)


@query("refs", "dets", sql=f"""
WITH {_QUALITY}, bins AS (SELECT *, CASE WHEN s < 5 THEN 'SNR<5' WHEN s < 10 THEN '5<=SNR<10' WHEN s < 20 THEN '10<=SNR<20' WHEN s < 50 THEN '20<=SNR<50' ELSE 'SNR>=50' END AS bin
  FROM (SELECT *, flux / sqrt(greatest(flux, 0) + 9 * pi() * 2500 + 1e-12) AS s FROM held_dets) t),
p AS (SELECT d.field_id, d.det_id, d.bin, r.ref_id, (d.x - r.x) * (d.x - r.x) + (d.y - r.y) * (d.y - r.y) AS d2 FROM bins d JOIN quality r ON d.field_id = r.field_id AND (d.x - r.x) * (d.x - r.x) + (d.y - r.y) * (d.y - r.y) <= 4),
hit AS (SELECT field_id, bin, count(DISTINCT ref_id) AS k FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY field_id, bin, det_id ORDER BY d2, ref_id) = 1) t GROUP BY ALL),
c AS (SELECT field_id, bin, count(*) AS n, coalesce(max(k), 0) AS k FROM bins LEFT JOIN hit USING (field_id, bin) GROUP BY ALL)
SELECT field_id, bin, n AS n_detection, k AS catalogue_matches, round(k / cast(n AS double), 6) AS match_lower_bound, {_WILSON} FROM c""")
def match_lower_bound_by_snr(t: Tables) -> DataFrame:
    return recovery.match_lower_bound_by_snr(t.dets, t.refs, rms=50.0)


@query("refs", "dets", sql=f"""
WITH {_near('dets', 'refs', '2')}, {_MATCH}, k AS (SELECT field_id, count(*) AS k FROM m GROUP BY ALL), d AS (SELECT field_id, count(*) AS nd FROM dets GROUP BY ALL), r AS (SELECT field_id, count(*) AS nr FROM refs GROUP BY ALL)
SELECT field_id, nd AS n_detections, nr AS n_truth, k AS true_positives, round(k / cast(nd AS double), 6) AS precision, round(k / cast(nr AS double), 6) AS recall, round(2.0 * k / (nd + nr), 6) AS f1 FROM d JOIN r USING (field_id) JOIN k USING (field_id)""")
def precision_recall_f1(t: Tables) -> DataFrame:
    return recovery.precision_recall_f1(t.dets, t.refs)


@query("refs", "dets", sql="""
WITH r AS (SELECT unnest([1e0, 15e-1, 2e0, 25e-1, 3e0]) AS radius),
p AS (SELECT radius, d.field_id, d.det_id, f.ref_id, (d.x - f.x) * (d.x - f.x) + (d.y - f.y) * (d.y - f.y) AS d2 FROM dets d JOIN refs f ON d.field_id = f.field_id AND (d.x - f.x) * (d.x - f.x) + (d.y - f.y) * (d.y - f.y) <= 9 JOIN r ON (d.x - f.x) * (d.x - f.x) + (d.y - f.y) * (d.y - f.y) <= radius * radius)
SELECT field_id, radius, count(DISTINCT ref_id) AS recovered FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY radius, field_id, det_id ORDER BY d2, ref_id) = 1) t GROUP BY ALL""")
def radius_scan(t: Tables) -> DataFrame:
    return recovery.radius_scan(t.dets, t.refs, (1.0, 1.5, 2.0, 2.5, 3.0))


_MATCHED = f"""{_near('dets', 'quality', '2')}, {_MATCH},
j AS (SELECT m.field_id, m.det_id, m.ref_id, d.x, d.y, r.x AS rx, r.y AS ry, r.mag, -2.5 * log10(greatest(d.flux, 1e-6)) AS inst, (cast(floor(r.x / 200) AS bigint) + cast(floor(r.y / 200) AS bigint)) % 3 = 2 AS test
      FROM m JOIN dets d USING (field_id, det_id) JOIN quality r ON m.field_id = r.field_id AND m.ref_id = r.ref_id)"""


@query("refs", "dets", sql=f"WITH {_QUALITY}, {_MATCHED} SELECT field_id, round(median(mag - inst), 6) AS zero_point, count(*) AS n FROM j WHERE NOT test GROUP BY ALL")
def zero_point(t: Tables) -> DataFrame:
    return recovery.zero_points(recovery.matched_catalogue(t.dets, t.refs)).select("field_id", C.r6(F.col("zero_point")).alias("zero_point"), "n")


@query("refs", "dets", sql=f"""
WITH {_QUALITY}, {_MATCHED}, z AS (SELECT field_id, median(mag - inst) AS zp FROM j WHERE NOT test GROUP BY ALL), e AS (SELECT field_id, inst + zp - mag AS v FROM j JOIN z USING (field_id) WHERE test),
c AS (SELECT field_id, median(v) AS mid, count(*) AS n_all FROM e GROUP BY ALL), s AS (SELECT field_id, any_value(mid) AS mid, any_value(n_all) AS n_all, 1.4826 * median(abs(v - mid)) AS mad FROM e JOIN c USING (field_id) GROUP BY ALL)
SELECT field_id, round(CASE WHEN any_value(n_all) >= 5 AND count(*) >= 5 THEN stddev_pop(v) END, 6) AS rms, count(*) AS inliers FROM e JOIN s USING (field_id) WHERE abs(v - mid) <= greatest(3.0 * mad, 0.03) GROUP BY ALL""")
def robust_rms(t: Tables) -> DataFrame:
    rows = recovery.magnitude_residuals(recovery.matched_catalogue(t.dets, t.refs)).where("test")
    return robust.robust_rms(rows, ["field_id"], "mag_residual", 0.03).select("field_id", C.r6(F.col("rms")).alias("rms"), "inliers")


@query("refs", "dets", sql=f"""
WITH {_QUALITY}, {_MATCHED}, j2 AS (SELECT *, det_id % 10 < 3 AS dense FROM j), g AS (SELECT field_id, median(mag - inst) AS zp FROM j2 WHERE NOT test GROUP BY ALL),
z AS (SELECT field_id, dense, median(mag - inst) FILTER (WHERE NOT test) AS zp, count(*) FILTER (WHERE NOT test) AS training_matches, count(*) FILTER (WHERE test) AS test_matches FROM j2 GROUP BY ALL)
SELECT field_id, dense, round(CASE WHEN training_matches >= 10 THEN z.zp ELSE g.zp END, 6) AS zero_point, training_matches, test_matches FROM z JOIN g USING (field_id)""")
def route_zero_point(t: Tables) -> DataFrame:
    rows = recovery.matched_catalogue(t.dets, t.refs).withColumn("dense", F.expr("det_id % 10 < 3"))
    return recovery.route_zero_points(rows, "dense").select("field_id", "dense", C.r6(F.col("zero_point")).alias("zero_point"), "training_matches", "test_matches")


@query("refs", "dets", sql="""
WITH o AS (SELECT d.field_id, r.x - d.x AS dx, r.y - d.y AS dy FROM dets d JOIN refs r ON d.field_id = r.field_id AND (d.x - r.x) * (d.x - r.x) + (d.y - r.y) * (d.y - r.y) <= 900),
b AS (SELECT field_id, least(cast(floor((dx + 30) / 0.25) AS bigint), 239) AS bx, least(cast(floor((dy + 30) / 0.25) AS bigint), 239) AS by_, count(*) AS n FROM o GROUP BY ALL),
t AS (SELECT field_id, sum(n) OVER (PARTITION BY field_id) AS pairs, -30 + 0.25 * (bx + 0.5) AS px, -30 + 0.25 * (by_ + 0.5) AS py FROM b QUALIFY row_number() OVER (PARTITION BY field_id ORDER BY n DESC, bx, by_) = 1)
SELECT field_id, cast(any_value(pairs) AS bigint) AS pairs, round(median(dx), 6) + 0.0 AS dx, round(median(dy), 6) + 0.0 AS dy, count(*) AS n_near FROM o JOIN t USING (field_id) WHERE abs(dx - px) <= 0.75 AND abs(dy - py) <= 0.75 AND pairs >= 10 GROUP BY field_id""")
def translation_peak(t: Tables) -> DataFrame:
    pairs = S.pairs_within(t.dets.select("field_id", "x", "y"), t.refs.select("field_id", "x", "y"), 30.0)
    return robust.translation_peak(pairs, ["field_id"]).select("field_id", "pairs", C.r6(F.col("dx")).alias("dx"), C.r6(F.col("dy")).alias("dy"), "n_near")
