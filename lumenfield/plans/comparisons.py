"""Thresholds, statistics and experiment summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import experiments as X
from ..operators import robust
from ..operators import thresholds as T
from ..sources.derived import Tables
from .registry import query


def _wilson(k: str, n: str, z: str = "1.96") -> str:
    p = f"({k} / cast({n} AS double))"
    mid = f"({p} + {z} * {z} / (2.0 * {n})) / (1.0 + {z} * {z} / {n})"
    half = f"{z} * sqrt({p} * (1.0 - {p}) / {n} + {z} * {z} / (4.0 * {n} * {n})) / (1.0 + {z} * {z} / {n})"
    return f"round(CASE WHEN {n} > 0 THEN greatest({mid} - {half}, 0.0) END, 6) AS ci_lo, round(CASE WHEN {n} > 0 THEN least({mid} + {half}, 1.0) END, 6) AS ci_hi"


_SWEEP = """
pts AS (SELECT field_id, score AS threshold, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM s GROUP BY ALL),
sw AS (SELECT field_id, threshold, cast(sum(pos) OVER a AS bigint) AS tp, cast(sum(neg) OVER a AS bigint) AS fp, cast(sum(pos) OVER w AS bigint) AS p, cast(sum(neg) OVER w AS bigint) AS n FROM pts
       WINDOW a AS (PARTITION BY field_id ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING), w AS (PARTITION BY field_id)),
sweep AS (SELECT *, tp / cast(greatest(p, 1) AS double) AS rec, tp / cast(greatest(tp + fp, 1) AS double) AS prec, (n - fp) / cast(greatest(n, 1) AS double) AS spec FROM sw)"""


@query("scored", sql=f"""
WITH s AS (SELECT field_id, label, score FROM scored UNION ALL SELECT DISTINCT field_id, -1, 0.0 FROM scored), {_SWEEP},
f AS (SELECT *, rec >= 0.90 AND prec >= 0.10 AS ok, 2 * prec * rec / greatest(prec + rec, 1e-12) AS f1 FROM sweep),
b AS (SELECT *, bool_or(ok) OVER (PARTITION BY field_id) AS any_ok FROM f QUALIFY row_number() OVER (PARTITION BY field_id ORDER BY ok DESC, CASE WHEN ok THEN threshold END DESC, f1 DESC, threshold) = 1)
SELECT field_id, round(CASE WHEN p >= 3 THEN threshold END, 6) AS threshold, round(CASE WHEN p >= 3 THEN rec END, 6) AS recall, round(CASE WHEN p >= 3 THEN prec END, 6) AS precision,
       CASE WHEN p < 3 THEN 'insufficient_positive_validation_labels' WHEN any_ok THEN 'target_recall_with_min_precision' ELSE 'best_f1_fallback' END AS status FROM b""")
def choose_threshold(t: Tables) -> DataFrame:
    return T.choose_threshold(t.scored, ["field_id"]).select("field_id", *(C.r6(F.col(c)).alias(c) for c in ("threshold", "recall", "precision")), "status")


@query("scored", sql=f"""
WITH s AS (SELECT * FROM scored), {_SWEEP}
SELECT field_id, coalesce(max(threshold) FILTER (WHERE best), 0.5) AS threshold FROM (SELECT *, rec >= 0.90 AND row_number() OVER (PARTITION BY field_id ORDER BY rec >= 0.90 DESC, prec DESC, threshold DESC) = 1 AS best FROM sweep) t GROUP BY field_id""")
def threshold_max_precision(t: Tables) -> DataFrame:
    return T.threshold_max_precision(t.scored, ["field_id"])


@query("scored", sql=f"""
WITH s AS (SELECT field_id, label, score FROM scored UNION ALL SELECT field_id, -1, score + 0.5 FROM scored), {_SWEEP}
SELECT field_id, threshold, round((rec + spec) / 2, 6) AS balanced_accuracy, tp, n - fp AS tn, fp, p - tp AS fn FROM sweep QUALIFY row_number() OVER (PARTITION BY field_id ORDER BY (rec + spec) / 2 DESC, threshold) = 1""")
def threshold_balanced_accuracy(t: Tables) -> DataFrame:
    return T.threshold_balanced_accuracy(t.scored, ["field_id"]).withColumn("balanced_accuracy", C.r6(F.col("balanced_accuracy")))


@query("scored", sql=f"""
WITH s AS (SELECT field_id, label, score FROM scored UNION ALL SELECT DISTINCT field_id, -1, 0.0 FROM scored UNION ALL SELECT DISTINCT field_id, -1, 1.0 FROM scored), {_SWEEP}
SELECT field_id, CASE WHEN rec >= 0.90 THEN threshold ELSE 0.0 END AS threshold, round(CASE WHEN rec >= 0.90 THEN rec END, 6) AS sensitivity, round(CASE WHEN rec >= 0.90 THEN spec END, 6) AS specificity
FROM sweep QUALIFY row_number() OVER (PARTITION BY field_id ORDER BY rec >= 0.90 DESC, spec DESC, threshold DESC) = 1""")
def threshold_high_recall(t: Tables) -> DataFrame:
    out = T.threshold_high_recall(t.scored, ["field_id"])
    return out.select("field_id", "threshold", C.r6(F.col("sensitivity")).alias("sensitivity"), C.r6(F.col("specificity")).alias("specificity"))


@query("scored", sql="""
WITH c AS (SELECT field_id, count(*) AS total, count(*) FILTER (WHERE score >= 0.5 AND label = 1) AS tp, count(*) FILTER (WHERE score < 0.5 AND label = 0) AS tn, count(*) FILTER (WHERE score >= 0.5 AND label = 0) AS fp, count(*) FILTER (WHERE score < 0.5 AND label = 1) AS fn FROM scored GROUP BY field_id)
SELECT *, round((tp + tn) / total, 6) AS accuracy, round(tp / (tp + fn), 6) AS sensitivity, round(tn / (tn + fp), 6) AS specificity, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy, round((tp + fp) / total, 6) AS predicted_high_fraction FROM c""")
def binary_scores(t: Tables) -> DataFrame:
    out = T.binary_scores(t.scored, ["field_id"], 0.5)
    return out.withColumns({c: C.r6(F.col(c)) for c in ("accuracy", "sensitivity", "specificity", "balanced_accuracy", "predicted_high_fraction")})


@query("scored", sql=f"""
WITH s AS (SELECT * FROM scored), {_SWEEP}, d AS (SELECT *, tp - coalesce(lag(tp) OVER o, 0) AS dp, fp - coalesce(lag(fp) OVER o, 0) AS dn FROM sweep WINDOW o AS (PARTITION BY field_id ORDER BY threshold DESC))
SELECT field_id, round(sum(dn * (tp - dp / 2.0)) / (any_value(p) * any_value(n)), 6) AS auroc, round(sum(dp * prec) / any_value(p), 6) AS auprc FROM d GROUP BY field_id""")
def ranking_metrics(t: Tables) -> DataFrame:
    return T.ranking_metrics(t.scored, ["field_id"]).select("field_id", C.r6(F.col("auroc")).alias("auroc"), C.r6(F.col("auprc")).alias("auprc"))


@query("trials", sql=f"""
WITH c AS (SELECT method_no, density_band, count(*) AS n, count(*) FILTER (WHERE recovered) AS k FROM trials WHERE status = 'eligible' GROUP BY ALL) SELECT method_no, density_band, n, k, {_wilson('k', 'n', '1.959963984540054')} FROM c""")
def wilson_interval(t: Tables) -> DataFrame:
    rows = t.trials.where("status = 'eligible'").groupBy("method_no", "density_band").agg(F.count("*").alias("n"), F.count_if("recovered").alias("k"))
    return X.interval(rows, "k", "n", 1.959963984540054)


@query("trials", sql=f"""
WITH c AS (SELECT method_no, density_band, input_mag, count(*) AS injected, count(*) FILTER (WHERE recovered) AS k FROM trials WHERE status = 'eligible' GROUP BY ALL)
SELECT method_no, density_band, input_mag, injected, k AS recovered, round(k / injected, 6) AS recovery, {_wilson('k', 'injected')} FROM c""")
def recovery_aggregate(t: Tables) -> DataFrame:
    return X.recovery_aggregate(t.trials, ["method_no", "density_band", "input_mag"])


@query("trials", sql=f"""
WITH e AS (SELECT *, (trial_id * 17 + method_no * 29) % 4000 / 1e3 AS before_px FROM trials),
c AS (SELECT method_no, density_band, count(*) FILTER (WHERE before_px <= 2) AS excluded, count(*) FILTER (WHERE before_px > 2) AS n, count(*) FILTER (WHERE before_px > 2 AND nearest_px <= 2) AS k FROM e GROUP BY ALL)
SELECT method_no, density_band, excluded, n AS eligible, k AS recovered, round(k / cast(greatest(n, 1) AS double), 6) AS recovery, {_wilson('k', 'n')} FROM c""")
def strict_trial_recovery(t: Tables) -> DataFrame:
    rows = t.trials.drop("status", "recovered").withColumnRenamed("nearest_px", "after_px").withColumn("before_px", F.expr("(trial_id * 17 + method_no * 29) % 4000 / 1e3"))
    return X.strict_recovery(rows, ["method_no", "density_band"])


@query("trials", sql="""
WITH m AS (SELECT count(DISTINCT method_no) AS n FROM trials) SELECT trial_id FROM trials WHERE status = 'eligible' GROUP BY trial_id HAVING count(DISTINCT method_no) = (SELECT n FROM m)""")
def common_trials(t: Tables) -> DataFrame:
    return X.common_ids(t.trials)


@query("trials", sql="""
WITH m AS (SELECT count(DISTINCT method_no) AS m FROM trials), s AS (SELECT trial_id, count(DISTINCT method_no) FILTER (WHERE status = 'eligible') AS n FROM trials GROUP BY ALL)
SELECT trial_id, n AS eligible_methods, CASE WHEN n = 0 THEN 'none' WHEN n = m THEN 'all' ELSE 'some' END AS kind FROM s CROSS JOIN m""")
def eligible_id_sets(t: Tables) -> DataFrame:
    """Intersection, union and difference of the methods' eligible trials."""
    return X.id_sets(t.trials, t.trials.select("method_no").distinct())


@query("trials", "method_runs", sql="""
WITH a AS (SELECT trial_id % 1000 AS field_no, method_no, count(*) AS n, sum(CASE WHEN recovered THEN 1 ELSE 0 END)::bigint AS k FROM trials GROUP BY ALL),
b AS (SELECT field_no, method_no, count(*) AS n, count(astrometric_rms_mas) AS k FROM method_runs GROUP BY ALL)
SELECT field_no, method_no, a.n AS left_n, b.n AS right_n, a.k AS left_k, b.k AS right_k, CASE WHEN a.n IS NOT NULL AND b.n IS NOT NULL THEN 'both' WHEN a.n IS NOT NULL THEN 'left' ELSE 'right' END AS found FROM a FULL JOIN b USING (field_no, method_no)""")
def result_set_join(t: Tables) -> DataFrame:
    """Two result sets joined by (field, method)."""
    stars = t.trials.groupBy(F.expr("trial_id % 1000").alias("field_no"), "method_no").agg(F.count("*").alias("n"), F.sum(F.when(F.col("recovered"), 1).otherwise(0)).alias("k"))
    fields = t.method_runs.groupBy("field_no", "method_no").agg(F.count("*").alias("n"), F.count("astrometric_rms_mas").alias("k"))
    return X.join_results(stars, fields, ["field_no", "method_no"], ["n", "k"])


_ALIASES = "SELECT n_name AS alias, 'method-' || n_regionkey AS canonical, 'Method ' || r_name AS label FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey < 20"


@query(sql=f"""
WITH l AS (SELECT regexp_replace(lower(alias), '[ _-]+', '', 'g') AS k, min({{'canonical': canonical, 'label': label}}) AS t FROM ({_ALIASES}) a GROUP BY ALL),
r AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN lower(n_name) ELSE replace(n_name, ' ', '_') END AS method FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT method, coalesce(t.canonical, method) AS canonical, coalesce(t.label, method) AS label, count(*) AS n FROM r LEFT JOIN l ON regexp_replace(lower(method), '[ _-]+', '', 'g') = k GROUP BY ALL""")
def method_labels(t: Tables) -> DataFrame:
    """Spellings of method names brought to canonical names and labels by a dimension table."""
    n, r = t.nation, t.region
    labels = n.where("n_nationkey < 20").join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("alias"), F.concat(F.lit("method-"), "n_regionkey").alias("canonical"), F.concat(F.lit("Method "), "r_name").alias("label"))
    spelt = F.when(F.expr("s_suppkey % 2 = 0"), F.lower("n_name")).otherwise(F.replace("n_name", F.lit(" "), F.lit("_")))
    rows = t.supplier.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(spelt.alias("method"))
    return X.labelled(rows, labels).groupBy("method", "canonical", "label").agg(F.count("*").alias("n"))


@query("trials", sql=f"""
WITH ids AS (SELECT trial_id FROM trials WHERE status = 'eligible' GROUP BY trial_id HAVING count(DISTINCT method_no) = 5),
c AS (SELECT density_band, input_mag, method_no, count(*) AS n, count(*) FILTER (WHERE recovered) AS k, sqrt(avg(nearest_px * nearest_px) FILTER (WHERE recovered)) AS rms, median(runtime_s) AS rt FROM trials JOIN ids USING (trial_id) GROUP BY ALL)
SELECT density_band, input_mag, method_no, n, k AS recovered, round(k / n, 6) AS recovery, round(rms, 6) AS radial_rms_px, round(rt, 6) AS runtime_median_s, {_wilson('k', 'n')} FROM c""")
def common_denominator_recovery(t: Tables) -> DataFrame:
    return X.common_denominator(t.trials, ["density_band", "input_mag", "method_no"])


_DISCORDANT = """
d AS (SELECT density_band, count(*) AS n, count(*) FILTER (WHERE a.recovered AND NOT b.recovered) AS a_only, count(*) FILTER (WHERE b.recovered AND NOT a.recovered) AS b_only
      FROM (SELECT * FROM trials WHERE method_no = 0 AND status = 'eligible') a JOIN (SELECT trial_id, recovered FROM trials WHERE method_no = 1 AND status = 'eligible') b USING (trial_id) GROUP BY ALL)"""


@query("trials", sql=f"""
WITH {_DISCORDANT}, g AS (SELECT density_band, sum(exp(lgamma(a_only + b_only + 1) - lgamma(i + 1) - lgamma(a_only + b_only - i + 1) - (a_only + b_only) * ln(2.0))) AS tail FROM (SELECT d.*, unnest(range(0, least(a_only, b_only) + 1)) AS i FROM d) t GROUP BY ALL)
SELECT density_band, n, a_only, b_only, round(CASE WHEN a_only + b_only = 0 THEN 1.0 ELSE least(1.0, 2.0 * tail) END, 6) AS p_value FROM d JOIN g USING (density_band)""")
def mcnemar_exact(t: Tables) -> DataFrame:
    d = X.discordant(t.trials, 0, 1, ["density_band"])
    return d.withColumn("p_value", C.r6(X.mcnemar_p(F.col("a_only"), F.col("b_only"))))


_UNIFORM = "((((({rep} * 7919 + {row} % 1000003 * 104729) % 2147483647) * 48271 % 2147483647) * 48271 + 11) % 2147483647) / 2147483647.0"
_POISSON = " + ".join(f"cast(u >= {c} AS integer)" for c in ("0.36787944117144233e0", "0.7357588823428847e0", "0.9196986029286058e0", "0.9810118431238462e0", "0.9963401531726563e0", "0.9994058151824183e0"))


@query("trials", sql=f"""
WITH b AS (SELECT a.trial_id, density_band, cast(a.recovered AS integer) - cast(b.recovered AS integer) AS d FROM (SELECT * FROM trials WHERE method_no = 0 AND status = 'eligible') a JOIN (SELECT trial_id, recovered FROM trials WHERE method_no = 1 AND status = 'eligible') b USING (trial_id)),
u AS (SELECT density_band, rep, d, {_UNIFORM.format(rep='rep', row='trial_id')} AS u FROM b CROSS JOIN (SELECT unnest(range(1, 201)) AS rep) r),
e AS (SELECT density_band, rep, sum(w * d) / cast(sum(w) AS double) AS difference FROM (SELECT *, {_POISSON} AS w FROM u) t GROUP BY ALL HAVING sum(w) > 0)
SELECT density_band, round(quantile_cont(difference, 0.025), 6) + 0.0 AS lo, round(quantile_cont(difference, 0.975), 6) + 0.0 AS hi, count(*) AS replicates FROM e GROUP BY ALL""")
def paired_bootstrap(t: Tables) -> DataFrame:
    return X.paired_bootstrap(t.trials, 0, 1, ["density_band"], 200).select("density_band", C.r6(F.col("lo")).alias("lo"), C.r6(F.col("hi")).alias("hi"), "replicates")


@query("trials", sql="""
SELECT density_band, method_no, count(*) AS n, round(median(runtime_s), 6) AS p50, round(quantile_cont(runtime_s, 0.025), 6) AS p025, round(quantile_cont(runtime_s, 0.975), 6) AS p975 FROM trials GROUP BY ALL""")
def runtime_percentiles(t: Tables) -> DataFrame:
    keys, shares = ["density_band", "method_no"], {"p50": 0.5, "p025": 0.025, "p975": 0.975}
    p = robust.quantiles(t.trials, keys, {n: ("runtime_s", s) for n, s in shares.items()})
    return X.by_keys(t.trials.groupBy(*keys).agg(F.count("*").alias("n")), p, keys).select(*keys, "n", *(C.r6(F.col(n)).alias(n) for n in shares))


@query("trials", sql="""
WITH r AS (SELECT cast(pow(2, method_no) AS bigint) AS workers, runtime_s / pow(2, method_no) + 1 AS wall_s, trial_id % 3 AS total FROM trials),
s AS (SELECT workers, median(wall_s) AS wall, min(wall_s) AS lo, max(wall_s) AS hi, array_to_string(list_sort(list(DISTINCT total)), ';') AS totals FROM r GROUP BY ALL), one AS (SELECT wall AS base FROM s WHERE workers = 1)
SELECT workers, round(wall, 6) AS wall_s_median, round(lo, 6) AS wall_s_min, round(hi, 6) AS wall_s_max, round(base / wall, 6) AS speedup, round(base / wall / workers, 6) AS efficiency, totals AS candidate_totals FROM s CROSS JOIN one""")
def scaling_summary(t: Tables) -> DataFrame:
    runs = t.trials.select(F.pow(F.lit(2.0), F.col("method_no")).cast("bigint").alias("workers"), (F.col("runtime_s") / F.pow(F.lit(2.0), F.col("method_no")) + 1).alias("wall_s"), F.expr("trial_id % 3").alias("total"))
    s = runs.groupBy("workers").agg(F.min("wall_s").alias("lo"), F.max("wall_s").alias("hi"), F.array_join(F.array_sort(F.collect_set("total")).cast("array<string>"), ";").alias("candidate_totals"))
    s = X.by_keys(s, robust.quantiles(runs, ["workers"], {"wall": ("wall_s", 0.5)}), ["workers"])
    one = s.where("workers = 1").select(F.col("wall").alias("base"))
    speed = F.col("base") / F.col("wall")
    return s.crossJoin(F.broadcast(one)).select("workers", C.r6(F.col("wall")).alias("wall_s_median"), C.r6(F.col("lo")).alias("wall_s_min"), C.r6(F.col("hi")).alias("wall_s_max"), C.r6(speed).alias("speedup"), C.r6(speed / F.col("workers")).alias("efficiency"), "candidate_totals")


@query("method_runs", sql="""
SELECT field_no % 5 AS cluster, method_no AS budget, count(*) AS repeats, round(avg(recovery), 6) AS recall_mean, round(CASE WHEN count(*) > 1 THEN 1.96 * stddev_samp(recovery) / sqrt(count(*)) ELSE 0.0 END, 6) AS recall_ci95,
       round(avg(runtime_s_per_mpix), 6) AS runtime_mean, round(CASE WHEN count(*) > 1 THEN 1.96 * stddev_samp(runtime_s_per_mpix) / sqrt(count(*)) ELSE 0.0 END, 6) AS runtime_ci95 FROM method_runs GROUP BY ALL""")
def budget_summary(t: Tables) -> DataFrame:
    half = lambda c: F.when(F.count("*") > 1, 1.96 * F.stddev_samp(c) / F.sqrt(F.count("*"))).otherwise(0.0)
    return t.method_runs.groupBy(F.expr("field_no % 5").alias("cluster"), F.col("method_no").alias("budget")).agg(
        F.count("*").alias("repeats"), C.r6(F.avg("recovery")).alias("recall_mean"), C.r6(half("recovery")).alias("recall_ci95"), C.r6(F.avg("runtime_s_per_mpix")).alias("runtime_mean"), C.r6(half("runtime_s_per_mpix")).alias("runtime_ci95")
    )


@query("method_runs", sql="""
SELECT CASE WHEN field_no % 3 = 0 THEN 'simulation' ELSE 'observation' END AS tier, method_no, count(*) AS n, round(median(recovery), 6) AS recovery_median, round(median(astrometric_rms_mas), 6) AS astrometric_rms_mas_median, round(median(runtime_s_per_mpix), 6) AS runtime_s_per_mpix_median
FROM method_runs GROUP BY ALL""")
def method_medians(t: Tables) -> DataFrame:
    rows = t.method_runs.withColumn("tier", F.when(F.expr("field_no % 3 = 0"), "simulation").otherwise("observation"))
    values = ["recovery", "astrometric_rms_mas", "runtime_s_per_mpix"]
    return X.method_medians(rows, ["tier", "method_no"], values).select("tier", "method_no", "n", *(C.r6(F.col(f"{v}_median")).alias(f"{v}_median") for v in values))


_MATRIX = """
grid AS (SELECT f.field_no, m.method_no FROM (SELECT s_suppkey AS field_no FROM supplier) f CROSS JOIN (SELECT n_nationkey AS method_no FROM nation WHERE n_nationkey < 6) m),
matrix AS (SELECT field_no, method_no, recovery, astrometric_rms_mas, CASE WHEN r.recovery IS NOT NULL AND r.astrometric_rms_mas IS NOT NULL THEN 'complete' WHEN r.recovery IS NOT NULL THEN 'complete_without_measurement' WHEN method_no = 5 THEN 'protocol_excluded' ELSE 'not_archived' END AS status
           FROM grid LEFT JOIN method_runs r USING (field_no, method_no))"""


def _matrix(t: Tables) -> DataFrame:
    fields = t.supplier.select(F.col("s_suppkey").alias("field_no"))
    methods = t.nation.where("n_nationkey < 6").select(F.col("n_nationkey").alias("method_no"))
    status = F.when(F.col("recovery").isNotNull() & F.col("astrometric_rms_mas").isNotNull(), "complete").when(F.col("recovery").isNotNull(), "complete_without_measurement").when(F.col("method_no") == 5, "protocol_excluded").otherwise("not_archived")
    return X.evidence_matrix(fields, methods, t.method_runs, status).select("field_no", "method_no", "recovery", "astrometric_rms_mas", "status")


@query("method_runs", sql=f"WITH {_MATRIX} SELECT * FROM matrix")
def evidence_matrix(t: Tables) -> DataFrame:
    return _matrix(t)


@query("method_runs", sql=f"""
WITH {_MATRIX} SELECT method_no, count(*) FILTER (WHERE status LIKE 'complete%') AS complete_rows, count(*) FILTER (WHERE status NOT LIKE 'complete%') AS unavailable_rows, coalesce(min_by(status, field_no) FILTER (WHERE status NOT LIKE 'complete%'), 'all matrix rows complete') AS scope FROM matrix GROUP BY ALL""")
def method_registry(t: Tables) -> DataFrame:
    done = F.col("status").startswith("complete")
    return _matrix(t).groupBy("method_no").agg(F.count_if(done).alias("complete_rows"), F.count_if(~done).alias("unavailable_rows"), F.coalesce(F.min_by("status", F.when(~done, F.col("field_no"))), F.lit("all matrix rows complete")).alias("scope")).withColumn("scope", F.when(F.col("unavailable_rows") == 0, "all matrix rows complete").otherwise(F.col("scope")))


_PAIR = "pr AS (SELECT field_no, a.recovery - b.recovery AS dr, a.astrometric_rms_mas - b.astrometric_rms_mas AS da FROM (SELECT * FROM method_runs WHERE method_no = 4) a JOIN (SELECT * FROM method_runs WHERE method_no = 2) b USING (field_no))"


@query("method_runs", sql=f"WITH {_PAIR} SELECT field_no, round(dr, 6) + 0.0 AS delta_recovery, round(da, 6) + 0.0 AS delta_astrometric_rms_mas FROM pr")
def branch_delta(t: Tables) -> DataFrame:
    p = X.pairwise(t.method_runs, 4, 2, ["recovery", "astrometric_rms_mas"])
    return p.select("field_no", (C.r6(F.col("delta_recovery")) + 0.0).alias("delta_recovery"), (C.r6(F.col("delta_astrometric_rms_mas")) + 0.0).alias("delta_astrometric_rms_mas"))


@query("method_runs", sql=f"WITH {_PAIR} SELECT count(*) AS fields, count(*) FILTER (WHERE dr > 0) AS recovery_wins, count(*) FILTER (WHERE da < 0) AS position_wins FROM pr")
def pairwise_wins(t: Tables) -> DataFrame:
    p = X.pairwise(t.method_runs, 4, 2, ["recovery", "astrometric_rms_mas"])
    return p.agg(F.count("*").alias("fields"), F.count_if(F.expr("delta_recovery > 0")).alias("recovery_wins"), F.count_if(F.expr("delta_astrometric_rms_mas < 0")).alias("position_wins"))


@query("method_runs", sql="""
WITH g AS (SELECT field_no, count(DISTINCT method_no) = 5 AS all_methods, count(*) FILTER (WHERE method_no IN (2, 4)) = 2 AND coalesce(bool_and(astrometric_rms_mas IS NOT NULL AND test_references >= 100) FILTER (WHERE method_no IN (2, 4)), false) AS measured FROM method_runs GROUP BY ALL)
SELECT field_no, all_methods, measured, all_methods AND measured AS admitted, CASE WHEN all_methods AND measured THEN 'admitted' WHEN all_methods THEN 'increase reference support and complete measurement metrics' ELSE 'run common real-image benchmark' END AS next_gate FROM g""")
def readiness_gate(t: Tables) -> DataFrame:
    key = F.col("method_no").isin(2, 4)
    ok = F.col("astrometric_rms_mas").isNotNull() & (F.col("test_references") >= 100)
    g = t.method_runs.groupBy("field_no").agg((F.countDistinct("method_no") == 5).alias("all_methods"), ((F.count_if(key) == 2) & F.coalesce(F.bool_and(F.when(key, ok)), F.lit(False))).alias("measured"))
    admitted = F.col("all_methods") & F.col("measured")
    gate = F.when(admitted, "admitted").when(F.col("all_methods"), "increase reference support and complete measurement metrics").otherwise("run common real-image benchmark")
    return g.select("field_no", "all_methods", "measured", admitted.alias("admitted"), gate.alias("next_gate"))


@query("trials", sql=f"""
WITH pol AS (SELECT * FROM (VALUES ('photometry_only', 'low', 2), ('photometry_only', 'high', 2), ('joint_only', 'low', 4), ('joint_only', 'high', 4), ('density_adaptive', 'low', 2), ('density_adaptive', 'high', 4)) v(policy, density_band, method_no)),
c AS (SELECT method_no, density_band, count(*) AS injected, count(*) FILTER (WHERE recovered) AS recovered FROM trials WHERE status = 'eligible' GROUP BY ALL), r AS (SELECT method_no, median(runtime_s) AS rt FROM trials GROUP BY ALL),
s AS (SELECT policy, cast(sum(injected) AS bigint) AS n, cast(sum(recovered) AS bigint) AS k, sum(injected * rt) / sum(injected) AS rt FROM pol JOIN c USING (density_band, method_no) JOIN r USING (method_no) GROUP BY ALL)
SELECT policy, n AS injected, k AS recovered, round(k / cast(n AS double), 6) AS recovery, round(rt, 6) AS runtime_weighted, {_wilson('k', 'n')} FROM s""")
def policy_routing(t: Tables) -> DataFrame:
    policy = F.explode(F.array(F.lit("photometry_only"), F.lit("joint_only"), F.lit("density_adaptive"))).alias("policy")
    method = F.when(F.col("policy") == "photometry_only", 2).when(F.col("policy") == "joint_only", 4).when(F.col("density_band") == "high", 4).otherwise(2)
    counts = X.recovery_aggregate(t.trials, ["method_no", "density_band"]).select("method_no", "density_band", "injected", "recovered")
    times = robust.quantiles(t.trials, ["method_no"], {"rt": ("runtime_s", 0.5)})
    table = t.trials.select("density_band").distinct().select("density_band", policy).withColumn("method_no", method)
    s = table.join(counts, ["density_band", "method_no"]).join(times, "method_no").groupBy("policy").agg(F.sum("injected").alias("injected"), F.sum("recovered").alias("recovered"), (F.sum(F.col("injected") * F.col("rt")) / F.sum("injected")).alias("rt"))
    return X.interval(s.select("policy", "injected", "recovered", C.r6(F.col("recovered") / F.col("injected")).alias("recovery"), C.r6(F.col("rt")).alias("runtime_weighted")), "recovered", "injected")


@query("trials", "method_runs", sql="""
SELECT 'artificial_stars' AS tier, method_no, count(*) AS n, cast(NULL AS double) AS recovery_median, round(median(nearest_px), 6) AS nearest_median FROM trials GROUP BY method_no
UNION ALL SELECT 'fields', method_no, count(*), round(median(recovery), 6), NULL FROM method_runs GROUP BY method_no""")
def evidence_union(t: Tables) -> DataFrame:
    stars = X.method_medians(t.trials, ["method_no"], ["nearest_px"]).select("method_no", "n", C.r6(F.col("nearest_px_median")).alias("nearest_median"))
    fields = X.method_medians(t.method_runs, ["method_no"], ["recovery"]).select("method_no", "n", C.r6(F.col("recovery_median")).alias("recovery_median"))
    return X.union_tiers({"artificial_stars": stars, "fields": fields}).select("tier", "method_no", "n", "recovery_median", "nearest_median")


@query("trials", sql="""
WITH t AS (SELECT trial_id % 12 AS tile, method_no, input_mag, count(*) AS injected, count(*) FILTER (WHERE recovered) AS recovered, sqrt(avg(nearest_px * nearest_px) FILTER (WHERE recovered)) AS rms, sum(runtime_s) AS rt FROM trials WHERE status = 'eligible' GROUP BY ALL)
SELECT method_no, input_mag, cast(sum(injected) AS bigint) AS injected, cast(sum(recovered) AS bigint) AS recovered, count(*) AS tile_count, round(median(rms), 6) AS tile_rms_median, round(sum(rt), 4) AS runtime_s_sum FROM t GROUP BY ALL""")
def tile_recovery_rollup(t: Tables) -> DataFrame:
    tiles = t.trials.where("status = 'eligible'").groupBy(F.expr("trial_id % 12").alias("tile"), "method_no", "input_mag").agg(
        F.count("*").alias("injected"), F.count_if("recovered").alias("recovered"), F.sqrt(F.avg(F.when(F.col("recovered"), C.square(F.col("nearest_px"))))).alias("rms"), F.sum("runtime_s").alias("rt")
    )
    return tiles.groupBy("method_no", "input_mag").agg(F.sum("injected").alias("injected"), F.sum("recovered").alias("recovered"), F.count("*").alias("tile_count"), C.r6(robust.median("rms")).alias("tile_rms_median"), F.round(F.sum("rt"), 4).alias("runtime_s_sum"))


@query(sql=f"""
WITH f AS (SELECT o_orderkey AS id, 1 + o_orderkey % 2 AS extension, CASE WHEN o_orderkey % 4 < 2 THEN 'low' ELSE 'high' END AS density_band, CASE WHEN o_custkey % 2 = 0 THEN 'bright' ELSE 'faint' END AS magband, (o_orderkey * 31 % 3000) / 1e3 AS dx, (o_orderkey * 17 % 2500) / 1e3 AS dy, o_orderkey % 5 AS type, ((o_orderkey * 13) % 401 - 200) / 1e3 AS dm FROM orders),
r AS (SELECT *, sqrt(dx * dx + dy * dy) AS sep, type IN (1, 2) AND sqrt(dx * dx + dy * dy) <= 2 AS recovered FROM f), g AS (SELECT * FROM r WHERE recovered),
c AS (SELECT extension, density_band, magband, count(*) AS n, count(*) FILTER (WHERE recovered) AS k FROM r GROUP BY ALL),
m AS (SELECT extension, density_band, magband, median(dm) AS mid FROM g GROUP BY ALL), a AS (SELECT extension, density_band, magband, any_value(mid) AS mid, 1.4826 * median(abs(dm - mid)) AS mad FROM g JOIN m USING (extension, density_band, magband) GROUP BY ALL),
e AS (SELECT extension, density_band, magband, any_value(mid) AS mid, stddev_pop(dm) AS mag_rms, count(*) AS inliers FROM g JOIN a USING (extension, density_band, magband) WHERE abs(dm - mid) <= greatest(3.0 * mad, 1e-6) GROUP BY ALL)
SELECT extension, density_band, magband, n AS injected, k AS recovered, round(k / n, 6) AS recovery, {_wilson('k', 'n')}, round(mid, 6) + 0.0 AS mag_bias_median, round(mag_rms, 6) AS mag_rms, inliers FROM c JOIN e USING (extension, density_band, magband)""")
def fake_star_summary(t: Tables) -> DataFrame:
    f = t.orders.selectExpr(
        "1 + o_orderkey % 2 as extension", "case when o_orderkey % 4 < 2 then 'low' else 'high' end as density_band", "case when o_custkey % 2 = 0 then 'bright' else 'faint' end as magband", "(o_orderkey * 31 % 3000) / 1e3 as dx", "(o_orderkey * 17 % 2500) / 1e3 as dy", "o_orderkey % 5 as type", "((o_orderkey * 13) % 401 - 200) / 1e3 as dm"
    )
    keys = ["extension", "density_band", "magband"]
    sep = F.sqrt(C.square(F.col("dx")) + C.square(F.col("dy")))
    r = f.withColumn("recovered", F.col("type").isin(1, 2) & (sep <= 2))
    counts = X.interval(r.groupBy(*keys).agg(F.count("*").alias("injected"), F.count_if("recovered").alias("recovered")), "recovered", "injected").withColumn("recovery", C.r6(F.col("recovered") / F.col("injected")))
    good = r.where("recovered")
    bias = robust.quantiles(good, keys, {"bias": ("dm", 0.5)})
    rms = robust.robust_rms(good, keys, "dm", 1e-6, name="mag_rms", few=True)
    return counts.join(bias, keys).join(rms, keys).select(*keys, "injected", "recovered", "recovery", "ci_lo", "ci_hi", (C.r6(F.col("bias")) + 0.0).alias("mag_bias_median"), C.r6(F.col("mag_rms")).alias("mag_rms"), "inliers")


