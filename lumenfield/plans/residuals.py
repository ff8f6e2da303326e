"""Offsets, left-over detections, measurement precision by stratum, its resampled intervals, and paired differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import experiments as X
from ..operators import recovery, robust, scans
from ..operators import spatial as S
from ..sources.derived import Tables
from .comparisons import _POISSON, _UNIFORM
from .matching import _MATCH, _MATCHED, _QUALITY, _near
from .registry import query


@query("refs", "dets", sql=f"""
WITH {_near('dets', 'refs', '30')} SELECT field_id, det_id, count(*) AS n_pairs, round(sum(sqrt(d2)), 3) AS total_px FROM p GROUP BY ALL""")
def offset_pairs(t: Tables) -> DataFrame:
    """All pairs within 30 px, added up by detection."""
    pairs = S.pairs_within(t.dets.select("field_id", "det_id", "x", "y"), t.refs.select("field_id", "x", "y"), 30.0)
    return pairs.groupBy("field_id", "det_id").agg(F.count("*").alias("n_pairs"), F.round(F.sum(F.sqrt("d2")), 3).alias("total_px"))


@query("refs", "dets", sql="""
WITH far AS (SELECT * FROM dets d WHERE NOT EXISTS (SELECT 1 FROM refs r WHERE r.field_id = d.field_id AND (d.x - r.x) * (d.x - r.x) + (d.y - r.y) * (d.y - r.y) <= 1))
SELECT field_id, det_id, place FROM (SELECT field_id, det_id, row_number() OVER (PARTITION BY field_id ORDER BY flux DESC, det_id) AS place FROM far) t WHERE place <= 2500""")
def residual_new_candidates(t: Tables) -> DataFrame:
    """Detections farther than 1 px from every reference, the brightest 2,500 of a field."""
    return recovery.new_candidates(t.dets, t.refs, separation=1.0, most=2500).select("field_id", "det_id", "place")


@query("dets", sql="SELECT field_id, det_id, round(flux, 6) AS flux FROM (SELECT field_id, det_id, flux - 1e3 AS flux FROM dets) d WHERE flux > 0")
def positive_flux(t: Tables) -> DataFrame:
    """Fitted sources with a finite flux above zero."""
    fitted = t.dets.select("field_id", "det_id", (F.col("flux") - 1000.0).alias("flux"))
    return scans.positive_flux(fitted).select("field_id", "det_id", C.r6(F.col("flux")).alias("flux"))


@query("refs", "dets", sql=f"""
WITH {_QUALITY}, {_MATCHED}, z AS (SELECT field_id, median(mag - inst) AS zero_point FROM j WHERE NOT test GROUP BY ALL),
v AS (SELECT j.field_id, CASE WHEN mag <= 18 THEN 'V<=18' WHEN mag <= 20 THEN '18<V<=20' WHEN mag <= 21 THEN '20<V<=21' WHEN mag <= 22 THEN '21<V<=22' ELSE 'V>22' END AS bin, (x - rx) * (x - rx) + (y - ry) * (y - ry) AS d2, inst + zero_point - mag AS res FROM j JOIN z USING (field_id) WHERE test),
mid AS (SELECT field_id, bin, median(res) AS mid FROM v GROUP BY ALL), dev AS (SELECT field_id, bin, any_value(mid) AS mid, 1.4826 * median(abs(res - mid)) AS mad FROM v JOIN mid USING (field_id, bin) GROUP BY ALL),
c AS (SELECT field_id, bin, sqrt(avg((res - mid) * (res - mid))) AS rms FROM v JOIN dev USING (field_id, bin) WHERE abs(res - mid) <= greatest(3.0 * mad, 0.05) GROUP BY ALL)
SELECT field_id, bin, count(*) AS n, round(CASE WHEN count(*) >= 5 THEN sqrt(avg(d2)) END, 6) AS position_rms_px, round(any_value(rms), 6) AS magnitude_rms FROM v JOIN c USING (field_id, bin) GROUP BY ALL""")
def stratified_precision(t: Tables) -> DataFrame:
    """By magnitude bin: position RMS of held-out matches (of five at least), and clipped RMS of magnitudes calibrated on the rest."""
    p = robust.precision_by(recovery.magnitude_residuals(recovery.matched_catalogue(t.dets, t.refs)).where("test").withColumn("bin", C.magnitude_bin(F.col("mag"))), ["field_id", "bin"])
    return p.select("field_id", "bin", "n", C.r6(F.col("position_rms_px")).alias("position_rms_px"), C.r6(F.col("magnitude_rms")).alias("magnitude_rms"))


@query("refs", "dets", sql=f"""
WITH {_QUALITY}, {_near('dets', 'quality', '2')}, {_MATCH}, u AS (SELECT field_id, rep, d2, {_UNIFORM.format(rep='rep', row='ref_id')} AS u FROM m CROSS JOIN (SELECT unnest(range(1, 201)) AS rep) r),
e AS (SELECT field_id, rep, sqrt(sum(w * d2) / cast(sum(w) AS double)) AS rms FROM (SELECT *, {_POISSON} AS w FROM u) t GROUP BY ALL HAVING sum(w) > 0)
SELECT field_id, round(quantile_cont(rms, 0.025), 6) AS lo, round(quantile_cont(rms, 0.975), 6) AS hi, count(*) AS replicates FROM e GROUP BY ALL""")
def residual_bootstrap(t: Tables) -> DataFrame:
    """The 95 % interval of the position RMS of one-to-one matches, matches fixed, under Poisson resampling."""
    matches = S.match_one_to_one(t.dets.select("field_id", "det_id", "x", "y"), scans.quality_refs(t.refs).select("field_id", "ref_id", "x", "y"))
    out = X.residual_bootstrap(matches, "d2", "ref_id", ["field_id"], 200)
    return out.select("field_id", C.r6(F.col("lo")).alias("lo"), C.r6(F.col("hi")).alias("hi"), "replicates")


@query("refs", "dets", sql=f"""
WITH cuts AS (SELECT unnest([25, 30, 35, 40]) / 1e1 AS threshold), d AS (SELECT field_id, det_id, x, y, psf_fit_quality AS s FROM dets), {_near('d', 'refs', '2')},
k AS (SELECT threshold, p.* FROM p JOIN d USING (field_id, det_id) JOIN cuts ON s >= threshold),
near AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY threshold, field_id, det_id ORDER BY d2, ref_id) = 1),
n AS (SELECT threshold, field_id, count(*) AS n_detection FROM d JOIN cuts ON s >= threshold GROUP BY ALL), h AS (SELECT threshold, field_id, count(DISTINCT ref_id) AS matched FROM near GROUP BY ALL)
SELECT field_id, threshold, n_detection, coalesce(matched, 0) AS matched FROM n LEFT JOIN h USING (threshold, field_id)""")
def threshold_scan(t: Tables) -> DataFrame:
    """One-to-one matches as the detection threshold rises, catalogues fixed."""
    return recovery.threshold_scan(t.dets.withColumnRenamed("psf_fit_quality", "s"), t.refs, "s", (2.5, 3.0, 3.5, 4.0))


@query("trials", sql="""
WITH a AS (SELECT trial_id, density_band, cast(recovered AS integer) AS r, runtime_s AS s FROM trials WHERE method_no = 1 AND status = 'eligible'), b AS (SELECT trial_id, cast(recovered AS integer) AS r, runtime_s AS s FROM trials WHERE method_no = 0 AND status = 'eligible')
SELECT density_band, count(*) AS n, round(avg(a.r - b.r), 6) + 0.0 AS recovery_difference, round(avg(a.s - b.s), 6) + 0.0 AS runtime_difference FROM a JOIN b USING (trial_id) GROUP BY ALL""")
def method_difference(t: Tables) -> DataFrame:
    """One method less another on the trials that both have."""
    out = X.difference(t.trials, 1, 0, ["density_band"])
    return out.select("density_band", "n", *((C.r6(F.col(c)) + 0.0).alias(c) for c in ("recovery_difference", "runtime_difference")))
