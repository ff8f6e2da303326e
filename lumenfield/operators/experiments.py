"""Experiment tables: recovery with intervals, paired comparisons, summaries over methods and fields."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from .robust import quantiles


def interval(rows: DataFrame, k: str, n: str, z: float = 1.96, *, clip: bool = True) -> DataFrame:
    return rows.withColumns({"ci_lo": C.r6(C.wilson_low(F.col(k), F.col(n), z, clip=clip)), "ci_hi": C.r6(C.wilson_high(F.col(k), F.col(n), z, clip=clip))})


def by_keys(one: DataFrame, two: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of two summaries with one row for each key side by side; null keys meet."""
    other = two.withColumnsRenamed({k: f"other_{k}" for k in keys})
    return one.join(other, reduce(lambda a, b: a & b, (one[k].eqNullSafe(other[f"other_{k}"]) for k in keys)), "left").drop(*(f"other_{k}" for k in keys))


def recovery_aggregate(trials: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Eligible trials, those recovered, their share and its Wilson interval."""
    rows = trials.where("status = 'eligible'").groupBy(*keys).agg(F.count("*").alias("injected"), F.count_if("recovered").alias("recovered"))
    return interval(rows.withColumn("recovery", C.r6(F.col("recovered") / F.col("injected"))), "recovered", "injected")


def strict_recovery(trials: DataFrame, keys: Sequence[str], radius: float = 2.0) -> DataFrame:
    """Trials with a detection at the site before injection (``before_px``) are set aside; the rest counts as recovered
    if one is there afterwards (``after_px``)."""
    status = F.when(F.col("before_px") <= radius, "excluded_preexisting").otherwise("eligible")
    judged = trials.withColumns({"status": status, "recovered": F.col("after_px") <= radius})
    rows = judged.groupBy(*keys).agg(F.count_if(F.expr("status <> 'eligible'")).alias("excluded"), F.count_if(F.expr("status = 'eligible'")).alias("eligible"), F.count_if(F.expr("status = 'eligible' and recovered")).alias("recovered"))
    return interval(rows.withColumn("recovery", C.r6(C.ratio(F.col("recovered"), F.col("eligible")))), "recovered", "eligible")


def common_ids(trials: DataFrame, method: str = "method_no", trial: str = "trial_id") -> DataFrame:
    """Trials that are eligible with every method."""
    methods = trials.agg(F.countDistinct(method).alias("methods"))
    seen = trials.where("status = 'eligible'").groupBy(trial).agg(F.countDistinct(method).alias("n"))
    return seen.join(F.broadcast(methods), F.col("n") == F.col("methods")).select(trial)


def id_sets(trials: DataFrame, methods: DataFrame, method: str = "method_no", trial: str = "trial_id") -> DataFrame:
    """Each trial once, with the number of methods it is eligible with and ``kind``: in all of ``methods`` (intersection), in some
    (union only) or in none (difference: excluded everywhere).

    Defined results: rows with a null trial or method do not count; without methods every trial is in none."""
    all_ = methods.agg(F.countDistinct(method).alias("methods"))
    seen = trials.where(F.col(trial).isNotNull()).groupBy(trial).agg(F.countDistinct(F.when(F.col("status") == "eligible", F.col(method))).alias("n"))
    kind = F.when(F.col("n") == 0, "none").when(F.col("n") == F.col("methods"), "all").otherwise("some")
    return seen.crossJoin(F.broadcast(all_)).select(trial, F.col("n").alias("eligible_methods"), kind.alias("kind"))


def join_results(left: DataFrame, right: DataFrame, on: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Two result sets by their exact keys: keys, each value of both sides (``left_``, ``right_``) and where the key was found.

    Defined results: a null in a key meets a null; a key that one side repeats gives a row for each; values of a side without
    the key are null."""
    side = lambda d, p: d.select(*(F.col(k).alias(f"{p}_key_{k}") for k in on), *(F.col(v).alias(f"{p}_{v}") for v in values), F.lit(True).alias(f"{p}_there"))
    same = reduce(lambda x, y: x & y, (F.col(f"left_key_{k}").eqNullSafe(F.col(f"right_key_{k}")) for k in on))
    met = side(left, "left").join(side(right, "right"), same, "full")
    where = F.when(F.col("left_there") & F.col("right_there"), "both").when(F.col("left_there"), "left").otherwise("right")
    key = lambda k: F.when(F.col("left_there"), F.col(f"left_key_{k}")).otherwise(F.col(f"right_key_{k}")).alias(k)
    return met.select(*(key(k) for k in on), *(f"{p}_{v}" for v in values for p in ("left", "right")), where.alias("found"))


def labelled(rows: DataFrame, labels: DataFrame, name: str = "method") -> DataFrame:
    """``rows`` with ``label`` and the canonical name for the aliases in ``labels`` (alias, canonical, label).  Aliases match without regard
    to case and to blanks, hyphens and underscores; a name without an alias keeps itself as its canonical name and label.

    Defined results: a null name stays null; of an alias that repeats the least (canonical, label) counts; columns canonical and
    label of ``rows`` give way."""
    plain = lambda c: F.regexp_replace(F.lower(c), "[ _-]+", "")
    known = labels.select(plain("alias").alias("alias_key"), F.struct("canonical", "label").alias("to")).groupBy("alias_key").agg(F.min("to").alias("to"))
    lean = rows.drop(*(c for c in rows.columns if c.lower() in ("canonical", "label")))
    met = lean.join(known, plain(lean[name]) == F.col("alias_key"), "left")
    return met.select(*lean.columns, F.coalesce("to.canonical", name).alias("canonical"), F.coalesce("to.label", name).alias("label"))


def common_denominator(trials: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Recovery over the trials that all methods share, with the unclipped radial RMS of what was recovered."""
    shared = trials.join(common_ids(trials), "trial_id", "left_semi")
    rows = shared.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("recovered").alias("recovered"), F.sqrt(F.avg(F.when(F.col("recovered"), C.square(F.col("nearest_px"))))).alias("rms"))
    rows = by_keys(rows, quantiles(shared, keys, {"runtime_median_s": ("runtime_s", 0.5)}), keys)
    out = rows.withColumns({"recovery": C.r6(F.col("recovered") / F.col("n")), "radial_rms_px": C.r6(F.col("rms")), "runtime_median_s": C.r6(F.col("runtime_median_s"))}).drop("rms")
    return interval(out, "recovered", "n")


def discordant(trials: DataFrame, a: int, b: int, keys: Sequence[str]) -> DataFrame:
    """Per key: shared trials that only method ``a`` or only ``b`` recovered."""
    side = lambda m, name: trials.where((F.col("method_no") == m) & (F.col("status") == "eligible")).select("trial_id", *keys, F.col("recovered").alias(name))
    both = side(a, "ra").join(side(b, "rb").drop(*keys), "trial_id")
    return both.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.expr("ra and not rb")).alias("a_only"), F.count_if(F.expr("rb and not ra")).alias("b_only"))


def mcnemar_p(a_only: Column, b_only: Column) -> Column:
    """Exact two-sided p value: twice the lower tail of a fair binomial, at most 1; 1 without discordant pairs, null for nulls.

    Terms fall from the one at min(a, b) downwards, each from the one above: C(n, i - 1) = C(n, i) i / (n - i + 1).  Those
    more than nine root n below it vanish beside it, so that no more are added up, however many pairs there are."""
    n, m = a_only + b_only, F.least(a_only, b_only)
    top = C.log_gamma(n + 1.0) - C.log_gamma(m + 1.0) - C.log_gamma(n - m + 1.0) - n * math.log(2.0)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def add(s: Column, k: Column) -> Column:
        term = s["term"] * (m - k + 1) / (n - m + k)
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    steps = F.least(m, F.ceil(9.0 * F.sqrt(n) + 40.0).cast("bigint"))
    below = F.filter(F.sequence(F.lit(0).cast("bigint"), steps), lambda k: k > 0)
    tail = F.aggregate(below, start, add, lambda s: s["total"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2.0 * F.exp(top) * tail))


def hash_uniform(rep: Column, row: Column, salt: int = 0) -> Column:
    """A number in [0, 1) from integers, the same in any engine."""
    h = F.pmod(rep * 7919 + F.pmod(row, F.lit(1000003)) * 104729 + salt * 15485863, F.lit(2147483647))
    h = F.pmod(h * 48271, F.lit(2147483647))
    h = F.pmod(h * 48271 + 11, F.lit(2147483647))
    return h / 2147483647.0


def poisson_one(u: Column) -> Column:
    """A Poisson(1) count from a uniform number."""
    cuts = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183)
    return reduce(lambda a, b: a + b, ((u >= c).cast("int") for c in cuts))


def paired_bootstrap(trials: DataFrame, a: int, b: int, keys: Sequence[str], replicates: int) -> DataFrame:
    """2.5 and 97.5 percentiles of the difference in recovery under Poisson resampling of trials.

    Each trial meets every replicate once; partial aggregation leaves ``replicates`` rows of a key and task to shuffle."""
    side = lambda m, name: trials.where((F.col("method_no") == m) & (F.col("status") == "eligible")).select("trial_id", *keys, F.col("recovered").cast("int").alias(name))
    both = side(a, "ra").join(side(b, "rb").drop(*keys), "trial_id")
    drawn = both.withColumn("rep", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(replicates).cast("bigint")))).withColumn("w", poisson_one(hash_uniform(F.col("rep"), F.col("trial_id"))))
    each = drawn.groupBy(*keys, "rep").agg(F.sum("w").alias("w"), F.sum(F.col("w") * (F.col("ra") - F.col("rb"))).alias("s")).where("w > 0").withColumn("difference", F.col("s") / F.col("w"))
    return each.groupBy(*keys).agg(F.percentile("difference", F.lit(0.025)).alias("lo"), F.percentile("difference", F.lit(0.975)).alias("hi"), F.count("*").alias("replicates"))


def method_medians(runs: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Medians of each method within a tier; blanks do not count."""
    return by_keys(runs.groupBy(*keys).agg(F.count("*").alias("n")), quantiles(runs, keys, {f"{v}_median": (v, 0.5) for v in values}), keys)


def evidence_matrix(fields: DataFrame, methods: DataFrame, runs: DataFrame, status: Column) -> DataFrame:
    """Every field with every method; what has not run has a status and no values."""
    return fields.crossJoin(F.broadcast(methods)).join(runs, ["field_no", "method_no"], "left").withColumn("status", status)


def pairwise(runs: DataFrame, a: int, b: int, values: Sequence[str], on: str = "field_no") -> DataFrame:
    """Differences of method ``a`` minus method ``b`` on the fields that both have."""
    side = lambda m, p: runs.where(F.col("method_no") == m).select(on, *(F.col(v).alias(f"{p}_{v}") for v in values))
    both = side(a, "a").join(side(b, "b"), on)
    return both.withColumns({f"delta_{v}": F.col(f"a_{v}") - F.col(f"b_{v}") for v in values})


def union_tiers(tiers: dict[str, DataFrame]) -> DataFrame:
    """Rows of several tiers together, with their tier and without any pooling; absent columns are null."""
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), (d.withColumn("tier", F.lit(k)) for k, d in tiers.items()))


def residual_bootstrap(matches: DataFrame, squared: str, row: str, keys: Sequence[str], replicates: int) -> DataFrame:
    """2.5 and 97.5 percentiles of the root of the mean of ``squared`` under Poisson resampling of matches that stay fixed.

    Defined results: a null square counts for nothing, a key without any has no row; equal rows are drawn alike."""
    drawn = matches.where(F.col(squared).isNotNull()).withColumn("rep", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(replicates).cast("bigint"))))
    drawn = drawn.withColumn("w", poisson_one(hash_uniform(F.col("rep"), F.col(row))))
    each = drawn.groupBy(*keys, "rep").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col(squared)).alias("s")).where("w > 0").withColumn("rms", F.sqrt(F.col("s") / F.col("w")))
    return each.groupBy(*keys).agg(F.percentile("rms", F.lit(0.025)).alias("lo"), F.percentile("rms", F.lit(0.975)).alias("hi"), F.count("*").alias("replicates"))


def difference(trials: DataFrame, a: int, b: int, keys: Sequence[str]) -> DataFrame:
    """n, recovery_difference and runtime_difference, a less b, over the trials that are eligible under both methods."""
    side = lambda m, tag: trials.where((F.col("method_no") == m) & (F.col("status") == "eligible")).select("trial_id", *keys, F.col("recovered").cast("int").alias(f"r_{tag}"), F.col("runtime_s").alias(f"s_{tag}"))
    both = side(a, "a").join(side(b, "b").drop(*keys), "trial_id")
    return both.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.col("r_a") - F.col("r_b")).alias("recovery_difference"), F.avg(F.col("s_a") - F.col("s_b")).alias("runtime_difference"))
