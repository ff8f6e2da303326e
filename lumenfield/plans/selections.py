"""Projections, filters, partitions and scans over derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import pixels, scans
from ..sources.derived import Tables
from .registry import query


@query("pixels", sql="""
WITH med AS (SELECT field_id, median(v) AS m FROM pixels WHERE v > -700 GROUP BY field_id)
SELECT p.field_id, px, py, round(CASE WHEN v > -700 THEN v ELSE m END, 6) AS v FROM pixels p JOIN med USING (field_id)""")
def fill_bad_pixels(t: Tables) -> DataFrame:
    return pixels.fill_bad(t.pixels).select("field_id", "px", "py", C.r6(F.col("v")).alias("v"))


@query("pixels", sql="""
SELECT field_id, cast(floor(py / 50) AS bigint) AS tile_y, cast(floor(px / 50) AS bigint) AS tile_x, count(*) AS n, count(*) FILTER (WHERE v > -700) AS n_good,
       round(max(CASE WHEN v > -700 THEN v END), 6) AS brightest
FROM pixels WHERE px >= 25 AND px < 175 AND py >= 25 AND py < 175 GROUP BY ALL""")
def crop_tiles(t: Tables) -> DataFrame:
    return pixels.tile_summary(pixels.crop(t.pixels, 25, 25, 150, 150), 50).select("field_id", "tile_y", "tile_x", "n", "n_good", C.r6(F.col("brightest")).alias("brightest"))


@query("refs", sql="""
SELECT field_id, ref_id, round(x - 300, 6) AS x, round(y - 200, 6) AS y, round(mag, 6) AS mag FROM refs
WHERE x - 300 >= 0 AND x - 300 < 600 AND y - 200 >= 0 AND y - 200 < 600""")
def crop_catalogue(t: Tables) -> DataFrame:
    c = scans.crop_catalogue(t.refs, 300.0, 200.0, 600.0, 600.0)
    return c.select("field_id", "ref_id", *(C.r6(F.col(k)).alias(k) for k in ("x", "y", "mag")))


@query(sql="""
WITH files AS (SELECT p_partkey AS file_no, p_size AS size, sha256(p_name) AS sum FROM part WHERE p_partkey % 11 <> 0),
manifest AS (SELECT p_partkey AS file_no, CASE WHEN p_partkey % 13 = 0 THEN p_size + 1 ELSE p_size END AS size,
                    CASE WHEN p_partkey % 17 = 0 THEN sha256('x') ELSE sha256(p_name) END AS sum, p_brand AS instrument FROM part)
SELECT instrument, CASE WHEN f.file_no IS NULL THEN 'missing' WHEN f.size <> m.size THEN 'size_mismatch' WHEN f.sum <> m.sum THEN 'sha256_mismatch' ELSE 'ok' END AS outcome, count(*) AS n
FROM manifest m LEFT JOIN files f USING (file_no) GROUP BY ALL""")
def manifest_audit(t: Tables) -> DataFrame:
    files = t.part.where("p_partkey % 11 <> 0").select(F.col("p_partkey").alias("name"), F.col("p_size").alias("size"), F.sha2("p_name", 256).alias("sha256"))
    manifest = t.part.select(
        F.col("p_partkey").alias("name"),
        F.when(F.expr("p_partkey % 13 = 0"), F.col("p_size") + 1).otherwise(F.col("p_size")).alias("size"),
        F.when(F.expr("p_partkey % 17 = 0"), F.sha2(F.lit("x"), 256)).otherwise(F.sha2("p_name", 256)).alias("sha256"),
        F.col("p_brand").alias("instrument"),
    )
    return scans.audit(manifest, files).groupBy("instrument", "outcome").agg(F.count("*").alias("n"))


@query(sql="""
SELECT kind, name, n FROM (
  SELECT 'brand' AS kind, p_brand AS name, count(*) AS n FROM part GROUP BY p_brand UNION ALL
  SELECT 'size', cast(p_size AS varchar), count(*) FROM part GROUP BY p_size UNION ALL
  SELECT * FROM (SELECT 'type', p_type, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, p_type LIMIT 20)) t""")
def inventory_topk(t: Tables) -> DataFrame:
    return scans.inventory(t.part.withColumn("p_size", F.col("p_size").cast("string")), {"brand": "p_brand", "size": "p_size"}, {"type": "p_type"}, top=20)


@query("refs", sql="""
SELECT field_id, ref_id, inside, inside AND mag < 90 AS measured, inside AND q AS quality, inside AND q AND mag <= 21 AND err < 0.05 AND qfit < 0.15 AND oth < 0.10 AS calibration
FROM (SELECT *, x >= 12 AND x < 1188 AND y >= 12 AND y < 1188 AS inside, mag < 90 AND err < 0.10 AND qfit < 0.30 AND oth < 1.0 AND nv >= 1 AS q FROM refs) t""")
def quality_subsets(t: Tables) -> DataFrame:
    return scans.with_subsets(t.refs).select("field_id", "ref_id", "inside", "measured", "quality", "calibration")


@query(sql="""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (
  SELECT *, (l_partkey % 200) / 1e3 AS mag_err, (l_suppkey * 7 % 300) / 1e1 AS snr, (l_orderkey % 900 - 450) / 1e3 AS sharp, (l_partkey % 2000) / 1e3 AS crowd, l_linenumber % 4 AS flag FROM lineitem) t
WHERE mag_err <= 0.10 AND snr >= 10 AND abs(sharp) <= 0.30 AND crowd <= 1 AND flag <= 2""")
def quality_phat(t: Tables) -> DataFrame:
    named = t.lineitem.selectExpr("*", "(l_partkey % 200) / 1e3 as mag_err", "(l_suppkey * 7 % 300) / 1e1 as snr", "(l_orderkey % 900 - 450) / 1e3 as sharp", "(l_partkey % 2000) / 1e3 as crowd", "l_linenumber % 4 as flag")
    return scans.phat_quality(named).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query(sql="""
WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_partkey % 200) / 1e3 AS err1, (l_suppkey * 7 % 300) / 1e1 AS snr1, (l_orderkey % 900 - 450) / 1e3 AS sharp1, (l_partkey % 2000) / 1e3 AS crowd1, l_linenumber % 4 AS flag1,
  (l_partkey * 3 % 200) / 1e3 AS err2, (l_suppkey * 11 % 300) / 1e1 AS snr2, (l_orderkey * 7 % 900 - 450) / 1e3 AS sharp2, (l_partkey * 7 % 2000) / 1e3 AS crowd2, (l_linenumber + l_partkey) % 4 AS flag2 FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(err1 <= 0.10 AND snr1 >= 10 AND abs(sharp1) <= 0.30 AND crowd1 <= 1 AND flag1 <= 2, false) AS first_filter,
  coalesce(err2 <= 0.10 AND snr2 >= 10 AND abs(sharp2) <= 0.30 AND crowd2 <= 1 AND flag2 <= 2, false) AS second_filter FROM f""")
def quality_filters(t: Tables) -> DataFrame:
    """The survey cuts on the first and on the second filter of each source, as flags."""
    named = t.lineitem.selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "(l_partkey % 200) / 1e3 as err1", "(l_suppkey * 7 % 300) / 1e1 as snr1", "(l_orderkey % 900 - 450) / 1e3 as sharp1", "(l_partkey % 2000) / 1e3 as crowd1", "l_linenumber % 4 as flag1",
        "(l_partkey * 3 % 200) / 1e3 as err2", "(l_suppkey * 11 % 300) / 1e1 as snr2", "(l_orderkey * 7 % 900 - 450) / 1e3 as sharp2", "(l_partkey * 7 % 2000) / 1e3 as crowd2", "(l_linenumber + l_partkey) % 4 as flag2",
    )
    flag = lambda k: F.coalesce(scans.phat_flag(f"err{k}", f"snr{k}", f"sharp{k}", f"crowd{k}", f"flag{k}"), F.lit(False))
    return named.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", flag(1).alias("first_filter"), flag(2).alias("second_filter"))


@query(sql="""
SELECT rule, count(*) AS n FROM (
  SELECT 'science' AS rule, * FROM lineitem WHERE l_linenumber % 5 <= 2 AND (l_suppkey * 7 % 300) / 1e1 >= 5 AND (l_partkey % 400) / 1e2 <= 2.5 UNION ALL
  SELECT 'strict', * FROM lineitem WHERE l_linenumber % 5 <= 2 AND (l_suppkey * 7 % 300) / 1e1 >= 5 AND (l_partkey % 400) / 1e2 <= 2.5 AND (l_partkey % 200) / 1e3 <= 0.10 AND l_orderkey % 4 = 0) t GROUP BY rule""")
def quality_dolphot(t: Tables) -> DataFrame:
    named = t.lineitem.selectExpr("l_linenumber % 5 as type", "(l_suppkey * 7 % 300) / 1e1 as snr", "(l_partkey % 400) / 1e2 as chi", "(l_partkey % 200) / 1e3 as mag_err", "l_orderkey % 4 as flag")
    return scans.dolphot_quality(named).unpivot([], ["science", "strict"], "rule", "passed").where("passed").groupBy("rule").agg(F.count("*").alias("n"))


@query("refs", sql="""
SELECT field_id, ref_id, (cx + cy) % 3 AS checkerboard, cx % 3 AS stripe, (cx + 2 * cy) % 3 AS skewed,
       CASE WHEN x < 400 THEN 'calibrate' WHEN x >= 800 THEN 'test' ELSE 'unused' END AS strip
FROM (SELECT *, cast(floor(x / 200) AS bigint) AS cx, cast(floor(y / 200) AS bigint) AS cy FROM refs) t""")
def spatial_partitions(t: Tables) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    strip = F.when(x < 400, "calibrate").when(x >= 800, "test").otherwise("unused")
    return t.refs.select("field_id", "ref_id", C.checkerboard(x, y).alias("checkerboard"), C.stripes(x).alias("stripe"), C.skewed_cells(x, y).alias("skewed"), strip.alias("strip"))


@query("dets", sql="""
SELECT field_id, tile, CASE WHEN (tile * 17 + 11) % 5 <= 2 THEN 'train' WHEN (tile * 17 + 11) % 5 = 3 THEN 'validation' ELSE 'test' END AS role, count(*) AS n
FROM (SELECT field_id, least(greatest(cast(floor(y / 200) AS bigint), 0), 5) * 6 + least(greatest(cast(floor(x / 200) AS bigint), 0), 5) AS tile FROM dets) t GROUP BY ALL""")
def tile_hash_split(t: Tables) -> DataFrame:
    tile = t.dets.select("field_id", C.tile_id(F.col("x"), F.col("y")).alias("tile"))
    return tile.groupBy("field_id", "tile").agg(F.count("*").alias("n")).select("field_id", "tile", C.tile_role(F.col("tile")).alias("role"), "n")


@query("refs", "dets", sql="""
WITH b AS (
  SELECT 'magnitude' AS axis, CASE WHEN mag <= 18 THEN 'V<=18' WHEN mag <= 20 THEN '18<V<=20' WHEN mag <= 21 THEN '20<V<=21' WHEN mag <= 22 THEN '21<V<=22' ELSE 'V>22' END AS bin, field_id FROM refs UNION ALL
  SELECT 'scene_magnitude', CASE WHEN mag + 6 <= 25 THEN '<=25' WHEN mag + 6 <= 27 THEN '25-27' ELSE '>27' END, field_id FROM refs UNION ALL
  SELECT 'snr', CASE WHEN s < 5 THEN 'SNR<5' WHEN s < 10 THEN '5<=SNR<10' WHEN s < 20 THEN '10<=SNR<20' WHEN s < 50 THEN '20<=SNR<50' ELSE 'SNR>=50' END, field_id
  FROM (SELECT field_id, flux / sqrt(greatest(flux, 0) + 9 * pi() * 100 + 1e-12) AS s FROM dets) t)
SELECT field_id, axis, bin, count(*) AS n FROM b GROUP BY ALL""")
def stratum_bins(t: Tables) -> DataFrame:
    mag = t.refs.select("field_id", F.lit("magnitude").alias("axis"), C.magnitude_bin(F.col("mag")).alias("bin"))
    scene = t.refs.select("field_id", F.lit("scene_magnitude").alias("axis"), C.scene_magnitude_bin(F.col("mag") + 6).alias("bin"))
    snr = t.dets.select("field_id", F.lit("snr").alias("axis"), C.snr_bin(C.source_snr(F.col("flux"), 10.0)).alias("bin"))
    return mag.union(scene).union(snr).groupBy("field_id", "axis", "bin").agg(F.count("*").alias("n"))


_MASK = """
masks AS (
  SELECT field_id, det_id, cast((CASE WHEN snr < 5 THEN 1 ELSE 0 END) + (CASE WHEN psf_fit_quality > 3 THEN 2 ELSE 0 END) + (CASE WHEN n >= 3 THEN 4 ELSE 0 END) + (CASE WHEN core THEN 8 ELSE 0 END)
         + (CASE WHEN deblend_flag THEN 16 ELSE 0 END) + (CASE WHEN p > 0.2 AND p < 0.8 THEN 32 ELSE 0 END) AS integer) AS quality_bitmask
  FROM (SELECT field_id, det_id, flux / sqrt(greatest(flux, 0) + 9 * pi() * 2500 + 1e-12) AS snr, psf_fit_quality, det_id % 6 AS n, det_id % 19 = 0 AS core, deblend_flag,
               CASE WHEN det_id % 7 = 0 THEN NULL ELSE (det_id % 101) / 1e2 END AS p FROM dets) t)"""


def _masked(t: Tables) -> DataFrame:
    probability = F.when(F.expr("det_id % 7 = 0"), F.lit(float("nan"))).otherwise(F.expr("(det_id % 101) / 1e2"))
    mask = C.quality_bitmask(C.source_snr(F.col("flux"), 50.0), F.col("psf_fit_quality"), F.expr("det_id % 6"), F.expr("det_id % 19 = 0"), F.col("deblend_flag"), probability)
    return t.dets.select("field_id", "det_id", mask.alias("quality_bitmask"))


@query("dets", sql=f"WITH {_MASK} SELECT * FROM masks")
def quality_bitmask(t: Tables) -> DataFrame:
    return _masked(t)


@query("dets", sql=f"""WITH {_MASK}
SELECT field_id, count(*) AS n, count(*) FILTER (WHERE quality_bitmask & 1 <> 0) AS low_snr, count(*) FILTER (WHERE quality_bitmask & 2 <> 0) AS poor_psf_fit, count(*) FILTER (WHERE quality_bitmask & 4 <> 0) AS crowded,
       count(*) FILTER (WHERE quality_bitmask & 8 <> 0) AS bright_core_nearby, count(*) FILTER (WHERE quality_bitmask & 16 <> 0) AS residual_deblend, count(*) FILTER (WHERE quality_bitmask & 32 <> 0) AS classifier_uncertain,
       count(*) FILTER (WHERE quality_bitmask = 0) AS clean
FROM masks GROUP BY field_id""")
def quality_flag_counts(t: Tables) -> DataFrame:
    m = F.col("quality_bitmask")
    names = {"low_snr": C.LOW_SNR, "poor_psf_fit": C.POOR_PSF_FIT, "crowded": C.CROWDED, "bright_core_nearby": C.BRIGHT_CORE, "residual_deblend": C.RESIDUAL_DEBLEND, "classifier_uncertain": C.CLASSIFIER_UNCERTAIN}
    return _masked(t).groupBy("field_id").agg(F.count("*").alias("n"), *(F.count_if(m.bitwiseAND(F.lit(b)) != 0).alias(k) for k, b in names.items()), F.count_if(m == 0).alias("clean"))


@query(sql="""
WITH trial AS (SELECT o_orderkey AS trial_id, ((o_orderkey * 104729) % 1300000) / 1e3 - 20 AS x, ((o_orderkey * 49979687) % 1300000) / 1e3 - 20 AS y FROM orders),
exposure AS (SELECT n_nationkey AS exposure_no, n_nationkey * 3e0 AS dx, n_nationkey * 2e0 AS dy FROM nation WHERE n_nationkey < 4),
judged AS (SELECT trial_id, bool_and(x + dx >= 15 AND x + dx < 1185 AND y + dy >= 15 AND y + dy < 1185) AS ok, bool_or(x + dx < 15 OR x + dx >= 1185) AS off_x FROM trial CROSS JOIN exposure GROUP BY trial_id)
SELECT CASE WHEN ok THEN 'admitted' WHEN off_x THEN 'outside_x' ELSE 'outside_y' END AS reason, count(*) AS n FROM judged GROUP BY ALL""")
def footprint_intersection(t: Tables) -> DataFrame:
    trials = t.orders.selectExpr("o_orderkey as trial_id", "((o_orderkey * 104729) % 1300000) / 1e3 - 20 as x", "((o_orderkey * 49979687) % 1300000) / 1e3 - 20 as y")
    exposures = t.nation.where("n_nationkey < 4").selectExpr("n_nationkey as exposure_no", "n_nationkey * 3e0 as dx", "n_nationkey * 2e0 as dy")
    return scans.interior_of_all(trials, exposures, size=1200.0, margin=15.0).groupBy("reason").agg(F.count("*").alias("n"))


@query(sql="""
WITH e AS (SELECT o_custkey % 50 AS field_no, o_orderkey AS exposure_no, (o_orderkey % 7) * 1e2 AS exptime, CASE WHEN o_orderkey % 3 = 0 THEN 'F814W' ELSE 'F606W' END AS filter FROM orders),
v AS (SELECT * FROM e WHERE exptime > 0 AND filter = 'F606W')
SELECT field_no, count(*) AS inputs, sum(exptime) AS exptime, count(*) >= 2 AS admitted FROM v GROUP BY field_no""")
def exposure_admission(t: Tables) -> DataFrame:
    e = t.orders.selectExpr("o_custkey % 50 as field_no", "o_orderkey as exposure_no", "(o_orderkey % 7) * 1e2 as exptime", "case when o_orderkey % 3 = 0 then 'F814W' else 'F606W' end as filter")
    return scans.admit_exposures(e, "F606W", least=2, keys=("field_no",))


@query("dets", sql="SELECT field_id, det_id, round(flux / sqrt(greatest(flux, 0) + 9 * pi() * 100 + 1e-12), 6) AS snr FROM dets")
def source_snr(t: Tables) -> DataFrame:
    return t.dets.select("field_id", "det_id", C.r6(C.source_snr(F.col("flux"), 10.0)).alias("snr"))


@query("dets", sql="""
SELECT field_id, det_id, flux FROM (SELECT *, row_number() OVER (PARTITION BY field_id ORDER BY flux DESC, det_id) AS place FROM dets) t WHERE place <= 1500""")
def bright_budget(t: Tables) -> DataFrame:
    order = W.partitionBy("field_id").orderBy(F.desc("flux"), "det_id")
    return t.dets.select("field_id", "det_id", "flux", F.row_number().over(order).alias("place")).where("place <= 1500").drop("place")


@query("trials", sql="""
SELECT trial_id, method_no, density_band, input_mag, extension FROM (
  SELECT *, row_number() OVER (PARTITION BY method_no, density_band, input_mag, extension ORDER BY trial_id) AS place FROM trials) t WHERE place <= 25""")
def balanced_trials(t: Tables) -> DataFrame:
    strata = ["method_no", "density_band", "input_mag", "extension"]
    order = W.partitionBy(*strata).orderBy("trial_id")
    return t.trials.withColumn("place", F.row_number().over(order)).where("place <= 25").select("trial_id", *strata)


@query("trials", sql="""
WITH e AS (SELECT trial_id, method_no, nearest_px, runtime_s, extension, density_band FROM trials),
m AS (SELECT method_no, extension, density_band, median(nearest_px) AS mx, median(runtime_s) AS my FROM e GROUP BY ALL)
SELECT method_no, extension, density_band, trial_id FROM (
  SELECT e.*, row_number() OVER (PARTITION BY method_no, extension, density_band ORDER BY (nearest_px - mx) * (nearest_px - mx) + (runtime_s - my) * (runtime_s - my), trial_id) AS place FROM e JOIN m USING (method_no, extension, density_band)) t
WHERE place = 1""")
def representative_row(t: Tables) -> DataFrame:
    rows = t.trials.withColumnsRenamed({"nearest_px": "x", "runtime_s": "y"})
    return scans.representative(rows, ["method_no", "extension", "density_band"], "trial_id").select("method_no", "extension", "density_band", "trial_id")


@query("dets", sql="""
WITH d AS (SELECT field_id, det_id, det_id % 3 = 0 AS positive, (det_id % 1000003 * 7919) % 1000003 AS h FROM dets)
SELECT field_id, det_id, CASE WHEN r < 0.6 THEN 'train' WHEN r < 0.8 THEN 'validation' ELSE 'test' END AS part
FROM (SELECT *, (row_number() OVER (PARTITION BY field_id, positive ORDER BY h, det_id) - 1) / cast(count(*) OVER (PARTITION BY field_id, positive) AS double) AS r FROM d) t""")
def stratified_split(t: Tables) -> DataFrame:
    rows = t.dets.select("field_id", "det_id", F.expr("det_id % 3 = 0").alias("positive"))
    return scans.stratified_split(rows, ["field_id", "positive"], F.expr("(det_id % 1000003 * 7919) % 1000003"), "det_id").select("field_id", "det_id", "part")


@query("scored", sql="""
WITH s AS (SELECT *, det_id % 4 AS group_no FROM scored), g AS (SELECT field_id, group_no, avg(score) AS m, greatest(stddev_pop(score), 1e-8) AS s FROM s GROUP BY ALL)
SELECT field_id, det_id, round((score - m) / g.s, 5) + 0.0 AS z FROM s JOIN g USING (field_id, group_no)""")
def normalize_by_group(t: Tables) -> DataFrame:
    rows = t.scored.withColumn("group_no", F.expr("det_id % 4"))
    return scans.standardised(rows, ["field_id", "group_no"], ["score"]).select("field_id", "det_id", (F.round("score", 5) + 0.0).alias("z"))


@query(sql="""
WITH e AS (SELECT n_nationkey AS extension FROM nation WHERE n_nationkey IN (1, 2)), d AS (SELECT CASE r_regionkey WHEN 0 THEN 'low' ELSE 'high' END AS band FROM region WHERE r_regionkey < 2),
i AS (SELECT DISTINCT o_orderkey AS k FROM orders)
SELECT extension, band AS density_band, 245e-1 + 2 * m.n_nationkey AS input_mag, k AS trial_no,
       15 + ((k * 104729 + extension * 7919 + m.n_nationkey * 31) % 1170000) / 1e3 AS x, 15 + ((k * 49979687 + extension * 104729 + m.n_nationkey * 17) % 1170000) / 1e3 AS y
FROM e CROSS JOIN d CROSS JOIN (SELECT n_nationkey FROM nation WHERE n_nationkey < 2) m CROSS JOIN i""")
def trial_design(t: Tables) -> DataFrame:
    extensions = t.nation.where("n_nationkey in (1, 2)").select(F.col("n_nationkey").alias("extension"))
    bands = t.region.where("r_regionkey < 2").select(F.when(F.col("r_regionkey") == 0, "low").otherwise("high").alias("density_band"))
    magnitudes = t.nation.where("n_nationkey < 2").select(F.col("n_nationkey").alias("step"), (F.lit(24.5) + 2 * F.col("n_nationkey")).alias("input_mag"))
    numbers = t.orders.select(F.col("o_orderkey").alias("trial_no")).distinct()
    place = lambda a, b, c: F.expr(f"15 + ((trial_no * {a} + extension * {b} + step * {c}) % 1170000) / 1e3")
    grid = scans.design_grid(extensions, bands, magnitudes, numbers)
    return grid.select("extension", "density_band", "input_mag", "trial_no", place(104729, 7919, 31).alias("x"), place(49979687, 104729, 17).alias("y"))
