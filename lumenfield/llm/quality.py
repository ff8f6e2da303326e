"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

A rule is a predicate over named features of a text.  Features are timed on a bounded number of rows (``sample_rows`` on
average, drawn from the whole table), what each rule rejects is counted over the whole table, and rules are put in order
greedily: next comes the rule that rejects most per second of the rows that the rules before it let through, where features
already at hand cost nothing.  The verdict is nested: each step works out the features that its rule is the first to need, and only
where no earlier rule has rejected.  The split into words is shared by all features that need it.  The order changes the
work, and the rule that is named for a rejection, but never the verdict.

Defined results: a null text counts as empty (0 words: rejected as too short); an empty table gives an empty
table; repeated rows are judged one by one; other columns pass through untouched.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, free_name, let, text_or_empty

SYMBOLS = r"[#*$%&|<>]"
BLANKS = " \t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def window_hashes(words: Column, width: int = 3) -> Column:
    """A 64-bit hash of each run of ``width`` words."""

    def over(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - width)
        return F.when(F.size(w) >= width, F.transform(starts, lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(width))))).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words, lambda x: F.xxhash64(x)), over)


def repeated_words(hashes: Column, width: int = 3) -> Column:
    """How many words lie in a window whose hash occurs twice or more.

    Most texts repeat no window and stop at the distinct test.  The rest sort (hash, place) pairs, keep those with an
    equal neighbour and add up what their windows cover: n log n in the words of a text.
    """

    def covered(s: Column) -> Column:
        same = F.filter(s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]))
        places = F.array_sort(F.transform(same, lambda x: x["i"]))
        start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end"))
        return F.aggregate(places, start, lambda a, i: F.struct((a["n"] + i + width - F.greatest(a["end"], i)).cast("bigint").alias("n"), (i + width).alias("end")), lambda a: a["n"])

    def counted(g: Column) -> Column:
        pairs = F.array_sort(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("bigint")).otherwise(let(pairs, covered))

    return let(hashes, counted)


def full_lines(text: Column) -> Column:
    """The lines of a text that hold a word."""
    return F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")


#: Values that several features are made of, from a text.
SHARED: dict[str, Callable[[Column], Column]] = {"words": words_of, "lines": full_lines}

#: Features: the shared value they are made of (or the text itself) and what they make of it.
FEATURES: dict[str, tuple[str, Callable[[Column], Column]]] = {
    "n_words": ("words", lambda w: F.size(w).cast("bigint")),
    "word_chars": ("words", lambda w: F.length(F.array_join(w, "")).cast("bigint")),
    "n_symbols": ("text", lambda t: F.regexp_count(t, F.lit(SYMBOLS)).cast("bigint")),
    "n_shouts": ("text", lambda t: F.regexp_count(t, F.lit("!!")).cast("bigint")),
    "n_lines": ("lines", lambda x: F.size(x).cast("bigint")),
    "n_dup_lines": ("lines", lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint")),
    "n_repeat_words": ("words", lambda w: repeated_words(window_hashes(w))),
}


@dataclass(frozen=True)
class Rule:
    """Rejects where ``fails`` is true.  ``features`` names what it reads."""

    name: str
    features: tuple[str, ...]
    fails: Callable[..., Column]


BASE_RULES = (
    Rule("too_short", ("n_words",), lambda n: n < 50),
    Rule("repeated_windows", ("n_words", "n_repeat_words"), lambda n, r: 100 * r > 50 * n),
)
RULES = (
    *BASE_RULES,
    Rule("symbols", ("n_words", "n_symbols"), lambda n, s: 10 * s > 3 * n),
    Rule("shouting", ("n_words", "n_shouts"), lambda n, s: 10 * s > 3 * n),
    Rule("duplicate_lines", ("n_lines", "n_dup_lines"), lambda n, d: 100 * d > 50 * n),
    Rule("word_length", ("n_words", "word_chars"), lambda n, c: (c < 2 * n) | (c > 20 * n)),
)


@dataclass(frozen=True)
class RuleCost:
    """A rule in its place: what it costs there, and the share of the rows before it that it rejects."""

    rule: Rule
    seconds: float
    rejected: float

    @property
    def rank(self) -> float:
        return self.rejected / max(self.seconds, 1e-6)


def _fails(rule: Rule, values: Mapping[str, Column]) -> Column:
    return F.coalesce(rule.fails(*(values[f] for f in rule.features)), F.lit(False))


def _bind(names: Sequence[str], text: Column, known: Mapping[str, Column], body: Callable[[Mapping[str, Column]], Column]) -> Column:
    """``body`` of ``known`` and the features ``names``; each of them, and each shared value under them, is worked out once."""
    missing = [n for n in names if n not in known]
    if not missing:
        return body(known)
    source, make = FEATURES[missing[0]]
    if source != "text" and source not in known:
        return let(SHARED[source](text), lambda x: _bind(missing, text, {**known, source: x}, body))
    return let(make(text if source == "text" else known[source]), lambda x: _bind(missing[1:], text, {**known, missing[0]: x}, body))


def first_failure(rules: Sequence[Rule], text: Column, known: Mapping[str, Column] | None = None) -> Column:
    """The name of the first rule that rejects, null if none does; features are worked out when a rule is reached."""
    known = {} if known is None else known
    if not rules:
        return F.lit(None).cast("string")
    return _bind(rules[0].features, text, known, lambda v: F.when(_fails(rules[0], v), F.lit(rules[0].name)).otherwise(first_failure(rules[1:], text, v)))


REPEATS = 3


def measure_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, *, text: str = "text", sample_rows: int = 2000, seed: int = 7) -> tuple[dict[str, float], list[dict[str, bool]], list[int]]:
    """Seconds of each feature and shared value on about ``sample_rows`` rows, net of what any job costs; the sets of rules that
    reject a row of ``docs`` together; and how many rows each set rejects."""
    names = [*dict.fromkeys(f for r in rules for f in r.features)]
    shared = [s for s in dict.fromkeys(FEATURES[n][0] for n in names) if s != "text"]
    total = docs.count()
    if not total:
        return dict.fromkeys([*names, *shared], 1.0), [], []
    drawn = docs.select(text_or_empty(text).alias("t")).sample(fraction=min(1.0, sample_rows / total), seed=seed)
    sample = drawn.repartition(2).persist()  # the scan keeps its own tasks; only the sample moves
    try:
        sample.agg(F.sum(F.length("t"))).collect()
        t = F.col("t")
        made = {s: SHARED[s](t) for s in shared} | {n: let(SHARED[FEATURES[n][0]](t), FEATURES[n][1]) if FEATURES[n][0] != "text" else FEATURES[n][1](t) for n in names}
        spent = {}
        for name, value in {"": F.length(t), **made}.items():
            took = []
            for _ in range(REPEATS):  # the first run compiles; the fastest counts
                began = time.perf_counter()
                sample.agg(F.sum(F.hash(value).cast("bigint"))).collect()
                took.append(time.perf_counter() - began)
            spent[name] = min(took)
        empty = spent.pop("")
        net = {k: max(v - empty, 1e-4) for k, v in spent.items()}
        cost = {n: max(net[n] - net.get(FEATURES[n][0], 0.0), 1e-4) for n in names} | {s: net[s] for s in shared}
    finally:
        sample.unpersist()
    fails = _bind(names, F.col("t"), {}, lambda v: F.struct(*(_fails(r, v).alias(r.name) for r in rules)))
    sets = docs.select(text_or_empty(text).alias("t")).select(fails.alias("fails")).groupBy("fails").count().collect()  # a row for each set of rules
    return cost, [row["fails"].asDict() for row in sets], [row["count"] for row in sets]


def order_rules(rules: Sequence[Rule], cost: Mapping[str, float], verdicts: Sequence[Mapping[str, bool]], counts: Sequence[int] | None = None) -> list[RuleCost]:
    """Greedily by rejections per second among the rows still there, of which each verdict stands for one or for its count;
    equal ones by name."""
    left, known, rows, out = list(rules), set(), list(zip(verdicts, counts or [1] * len(verdicts), strict=True)), []
    while left:
        ranked = []
        for r in left:
            new = {f for f in r.features} | {FEATURES[f][0] for f in r.features} - {"text"}
            seconds = sum(cost.get(x, 0.0) for x in new - known)
            ranked.append(RuleCost(r, seconds, sum(n for v, n in rows if v[r.name]) / max(1, sum(n for _, n in rows))))
        best = min(ranked, key=lambda c: (-c.rank, c.seconds, c.rule.name))
        out.append(best)
        left.remove(best.rule)
        known |= {f for f in best.rule.features} | {FEATURES[f][0] for f in best.rule.features}
        rows = [(v, n) for v, n in rows if not v[best.rule.name]]
    return out


def ordered_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, *, text: str = "text", sample_rows: int = 2000) -> list[Rule]:
    return [c.rule for c in order_rules(rules, *measure_rules(docs, rules, text=text, sample_rows=sample_rows))]


def cascade(docs: DataFrame, rules: Sequence[Rule] = RULES, *, text: str = "text", sample_rows: int = 2000) -> DataFrame:
    """``docs`` and a column ``failed_rule`` (``failed_rule_1`` ... if taken): null for documents to keep."""
    ordered = ordered_rules(docs, rules, text=text, sample_rows=sample_rows)
    return docs.withColumn(free_name(docs, "failed_rule"), first_failure(ordered, text_or_empty(text)))


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES, *, text: str = "text", sample_rows: int = 2000) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with their own columns."""
    ordered = ordered_rules(docs, rules, text=text, sample_rows=sample_rows)
    return docs.where(first_failure(ordered, text_or_empty(text)).isNull())


def quality_report(docs: DataFrame, rules: Sequence[Rule] = RULES, *, doc_id: str = "doc_id", text: str = "text", sample_rows: int = 2000) -> DataFrame:
    """One row per document: its base measures, the base verdict and the cascade's.  The base measures are wanted of every
    text; what else the rules need is worked out as far as the cascade goes, and not at all where the base has rejected."""
    ordered = ordered_rules(docs, rules, text=text, sample_rows=sample_rows)
    t = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("t"))
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def verdicts(v: Mapping[str, Column]) -> Column:
        failed = F.coalesce(_fails(BASE_RULES[0], v) | _fails(BASE_RULES[1], v), F.lit(False))
        kept = let(failed, lambda f: F.struct(f.alias("base_failed"), F.when(f, F.lit(False)).otherwise(first_failure(ordered, F.col("t"), v).isNull()).alias("kept")))
        return F.struct(*(v[b].alias(b) for b in base), kept.alias("verdict"))

    judged = t.select("doc_id", F.explode(F.array(_bind(base, F.col("t"), {}, verdicts))).alias("m"))
    return judged.select("doc_id", *(f"m.{b}" for b in base), "m.verdict.base_failed", "m.verdict.kept")
