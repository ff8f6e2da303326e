"""Personal data: base patterns, loose proposals judged by gradient boosted trees, and redaction.  DataFrame and SQL
operations only.

Base spans (email, ip, card, phone) come from fixed patterns and checks and always stay.  High-recall generators
propose further spans, which overlap: written-out mail addresses, and of each run of digit groups every row of
neighbouring groups whose digits fit a kind, starting at every group.  A proposal that is glued to a letter or digit is none.
Those that pass the check of their kind (Luhn, octets, 8 to 15 digits) are scored by boosted trees from format and context.

There are no labels for personal data, so the trees learn from evidence that is none of their features.  Positive rows are base
spans and worn forms of them (without the plus sign, with other separators, with the at sign written out) in their own
surroundings.  Negative rows are proposals that fail the check of their kind, are dates, or cut through or lie within a base
span.  All distinct ones are used.  A fifth of them, by a hash of context, so that copies
stay together, is held back to calibrate: for each kind the lowest threshold with a precision of ``precision`` on the part
held back selects, and a kind that reaches it nowhere adds nothing.

Matching is linear: each pattern is anchored to run starts and possessive, and gives the same leftmost matches
as its plain form.  Places are sums of the lengths of what lies between matches, in code points.

Defined results: a null text is empty; a text without findings has counts of 0, no spans and the hash of the empty
string; rows that share a doc_id are judged one by one (by a 128-bit hash of id and text), equal rows alike; an empty table gives an empty table; other columns pass
through ``redact`` untouched.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, let, stash, text_or_empty

KINDS = ("email", "ip", "card", "phone")
CONTEXT = 24
PRECISION = 0.95

_LOCAL = "[A-Za-z0-9._%+-]"
#: The base patterns, written so that no place is tried twice.
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT, _DOT = r"(?:@|[(\[{](?i:at)[)\]}]|\x20(?i:at)\x20)", r"(?:\.|[(\[{](?i:dot)[)\]}]|\x20(?i:dot)\x20)"
LOOSE_EMAIL = rf"(?<!{_LOCAL}){_LOCAL}++\x20?{_AT}\x20?[A-Za-z0-9-]++(?:\x20?{_DOT}\x20?[A-Za-z0-9-]{{2,}}+)+"
#: A run of digit groups with at most two separators between neighbours.
LOOSE_RUN = r"[+(]{0,2}(?<![0-9])[0-9](?:[\x20().:/-]{0,2}+[0-9])++"
MOST_GROUPS = 19
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_DATE = r"^(?:(?:19|20)[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.](?:19|20)[0-9]{2})(?:[\x20.:/-].*)?$"
#: Words that announce personal data, by kind.
CUES = {
    "email": r"(?i)(?:mail|contact|write|reply|e-mail)[^A-Za-z]*$",
    "ip": r"(?i)(?:\bip|host|server|address|addr)[^A-Za-z]*$",
    "card": r"(?i)(?:card|visa|master|credit|account|konto|tarjeta|carte)[^A-Za-z]*$",
    "phone": r"(?i)(?:phone|tel|call|fax|mobile|cell|whatsapp|sms)[^A-Za-z]*$",
}


def digits_of(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def total(d: Column) -> Column:
        def one(i: Column) -> Column:
            x = F.substr(d, F.length(d) - i + 1, F.lit(1)).cast("int")
            return x + F.when(i % 2 == 0, x - F.when(x > 4, 9).otherwise(0)).otherwise(0)

        return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda s, i: s + one(i))

    return F.when(F.length(digits) > 0, let(digits, total) % 10 == 0).otherwise(F.lit(False))


def octets_fit(x: Column) -> Column:
    return x.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")


def valid(kind: str, x: Column) -> Column:
    """The base check of a match."""
    if kind == "ip":
        return octets_fit(x)
    if kind == "card":
        return let(digits_of(x), lambda d: F.length(d).between(16, 19) & F.when(F.length(d).between(16, 19), luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(digits_of(x)).between(8, 15)
    return F.lit(True)


def running(sizes: Column) -> Column:
    """The sum of ``sizes`` up to each of them, in blocks of 64: linear in the length but for the sums of whole blocks."""
    add = lambda a, x: a + x
    block = lambda b: F.aggregate(F.slice(sizes, b * 64 + 1, F.lit(64)), F.lit(0), add)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / 64).cast("int")), block)
    before = F.aggregate(blocks, F.array(F.lit(0)), lambda a, x: F.array_append(a, F.element_at(a, -1) + x))
    own = lambda i: F.aggregate(F.slice(sizes, i - i % 64 + 1, i % 64 + 1), F.lit(0), add)
    return let(before, lambda at: F.transform(sizes, lambda x, i: F.get(at, F.floor(i / 64).cast("int")) + own(i)))


_SPAN = "struct<start:int,end:int,match:string,left:string,right:string>"


def matches(text: Column, pattern: str) -> Column:
    """All matches with their places and surroundings: array of (start, end, match, left, right).

    The pattern runs once: matches are put between zero characters, of which the text has none, and split off there."""

    def located(pieces: Column) -> Column:
        found = F.sequence(F.lit(1), F.size(pieces) - 2, F.lit(2))
        around = lambda k: (F.right(F.get(pieces, k - 1), F.lit(CONTEXT)).alias("left"), F.left(F.get(pieces, k + 1), F.lit(CONTEXT)).alias("right"))
        ends = running(F.transform(pieces, lambda x: F.length(x)))
        return let(ends, lambda e: F.transform(found, lambda k: F.struct(F.get(e, k - 1).alias("start"), F.get(e, k).alias("end"), F.get(pieces, k).alias("match"), *around(k))))

    none = F.array().cast(f"array<{_SPAN}>")
    marked = F.regexp_replace(F.translate(text, "\0", "\1"), F.lit(pattern), F.lit("\0$0\0"))
    return let(F.split(marked, "\0", -1), lambda p: F.when(F.size(p) < 3, none).otherwise(located(p)))


def row_key(doc_id: str, text: str) -> Column:
    return F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("\1")), F.lit("\0"), text_or_empty(text)).cast("binary"))


def fits(kind: str, digits: Column, groups: Column) -> Column:
    """Whether so many digits in so many groups may be of a kind."""
    if kind == "ip":
        return (groups == 4) & digits.between(4, 12)
    return digits.between(13, 19) if kind == "card" else digits.between(7, 15)


def windows(runs: Column) -> Column:
    """Of each run of digit groups, the rows of neighbouring groups that fit a kind: (kind, start, end, match, left, right)."""

    def within(run: Column, groups: Column) -> Column:
        def window(i: Column, k: Column) -> Column:
            first, last = F.get(groups, i), F.get(groups, i + k - 1)
            sign = F.length(F.regexp_extract(F.substr(run["match"], F.greatest(first["start"] - 1, F.lit(1)), F.least(first["start"], F.lit(2))), r"[+(]+$", 0))
            begin = let(sign, lambda n: first["start"] - F.when(first["start"] > 0, n).otherwise(0))
            digits = F.aggregate(F.slice(groups, i + 1, k), F.lit(0), lambda a, g: a + F.length(g["match"]))
            made = lambda b, n, kind: F.struct(
                F.lit(kind).alias("kind"),
                (run["start"] + b).alias("start"),
                (run["start"] + last["end"]).alias("end"),
                F.substr(run["match"], b + 1, last["end"] - b).alias("match"),
                F.right(F.concat(run["left"], F.substr(run["match"], F.greatest(b - CONTEXT + 1, F.lit(1)), F.least(b, F.lit(CONTEXT)))), F.lit(CONTEXT)).alias("left"),
                F.left(F.concat(F.substr(run["match"], last["end"] + 1, F.lit(CONTEXT)), run["right"]), F.lit(CONTEXT)).alias("right"),
            )
            kinds = lambda b, n: F.filter(F.array(*(F.when(fits(kind, n, k), made(b, n, kind)) for kind in ("ip", "card", "phone"))), lambda x: x.isNotNull())
            return let(digits, lambda n: F.when((n >= 4) & (n <= 19), let(begin, lambda b: kinds(b, n))).otherwise(F.array().cast(f"array<struct<kind:string,{_SPAN[7:]}>")))

        starts = F.sequence(F.lit(0), F.size(groups) - 1)
        sizes = lambda i: F.sequence(F.lit(1), F.least(F.size(groups) - i, F.lit(MOST_GROUPS)))
        return F.flatten(F.transform(starts, lambda i: F.flatten(F.transform(sizes(i), lambda k: window(i, k)))))

    return F.flatten(F.transform(runs, lambda run: let(matches(run["match"], "[0-9]+"), lambda groups: within(run, groups))))


def candidates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Base spans and proposals of all texts: rid, kind, base, start, end, match, left, right."""
    lean = docs.select(row_key(doc_id, text).alias("rid"), text_or_empty(text).alias("t"))
    lean = lean.where(F.col("t").rlike(rf"[0-9]|{_AT}"))
    none = F.array().cast(f"array<{_SPAN}>")
    t = F.col("t")
    number = t.rlike("[0-9]")
    gates = {"email": F.contains(t, F.lit("@")), "ip": number, "card": number, "phone": F.contains(t, F.lit("+"))}
    columns = {k: F.when(gates[k], matches(t, p)).otherwise(none) for k, p in BASE.items()}
    columns |= {"loose_email": F.when(t.rlike(_AT), matches(t, LOOSE_EMAIL)).otherwise(none)}
    columns |= {"loose_number": let(F.when(number, F.filter(matches(t, LOOSE_RUN), lambda x: F.length(digits_of(x["match"])) >= 4)).otherwise(none), windows)}
    wide = lean.select("rid", *(c.alias(k) for k, c in columns.items()))

    def row(x: Column, kind: Column, base: bool) -> Column:
        return F.struct(kind.alias("kind"), F.lit(base).alias("base"), x["start"].alias("start"), x["end"].alias("end"), x["match"].alias("match"), x["left"].alias("left"), x["right"].alias("right"))

    def proven(kind: str) -> Column:
        return F.transform(F.filter(kind, lambda x: valid(kind, x["match"])), lambda x: row(x, F.lit(kind), True))

    all_ = [proven(k) for k in KINDS]
    all_ += [F.transform("loose_email", lambda x: row(x, F.lit("email"), False)), F.transform("loose_number", lambda x: row(x, x["kind"], False))]
    rows = wide.select("rid", F.explode(F.concat(*all_)).alias("c")).select("rid", "c.*")
    glued = F.col("left").rlike("[A-Za-z0-9]$") | F.col("right").rlike("^[A-Za-z0-9]")
    return rows.where(F.col("base") | ~glued).distinct()


def features(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """Numbers that describe the format of a span and what stands around it."""
    m, left, right = F.col("match"), F.col("left"), F.col("right")
    d = digits_of(m)
    first = F.regexp_extract(m, "^[0-9+(]*", 0)
    cue = reduce(lambda a, k: a.when(F.col("kind") == k, left.rlike(CUES[k])), KINDS[1:], F.when(F.col("kind") == KINDS[0], left.rlike(CUES[KINDS[0]])))
    made = {
        **{f"f_is_{k}": F.col("kind") == k for k in KINDS},
        "f_length": F.length(m),
        "f_digits": F.length(d),
        "f_separators": F.regexp_count(m, F.lit(r"[\x20().:/-]")),
        "f_groups": F.size(F.split(F.regexp_replace(m, "[^0-9]+", " "), " ")),
        "f_first_group": F.length(first),
        "f_dots": F.regexp_count(m, F.lit(r"\.")),
        "f_colons": F.regexp_count(m, F.lit("[:/]")),
        "f_parens": F.regexp_count(m, F.lit(r"\(")),
        "f_written_at": m.rlike(r"(?i)\bat\b"),
        "f_last_letters": F.length(F.regexp_extract(m, "[A-Za-z]*$", 0)),
        "f_distinct": F.size(F.array_distinct(F.split(d, ""))),
        "f_cue": F.coalesce(cue, F.lit(False)),
        "f_left_space": left.rlike(r"[\x20\t\n(\[:,;\"']$") | (left == ""),
        "f_right_stop": right.rlike(r"^[\x20\t\n.,;:)\]!?\"']") | (right == ""),
        "f_left_digits": F.regexp_count(left, F.lit("[0-9]")),
        "f_right_digits": F.regexp_count(right, F.lit("[0-9]")),
        "f_left_money": left.rlike(r"[$€£#]\x20?$"),
    }
    return rows.select("*", *(F.coalesce(c.cast("double"), F.lit(0.0)).alias(k) for k, c in made.items())), list(made)


def worn(rows: DataFrame) -> DataFrame:
    """Forms of base spans that the base patterns would miss, in the same surroundings."""
    m = F.col("match")
    form = (
        F.when(F.col("kind") == "email", F.regexp_replace(F.regexp_replace(m, "@", " at "), r"\.", " dot "))
        .when(F.col("kind") == "phone", F.when(F.pmod(F.xxhash64("match"), F.lit(2)) == 0, F.regexp_replace(m, r"^\+[0-9]+[\x20-]?", "")).otherwise(F.regexp_replace(m, r"^\+", "")))
        .when(F.col("kind") == "card", F.regexp_replace(digits_of(m), "([0-9]{4})(?=[0-9])", "$1."))
        .otherwise(F.regexp_replace(m, r"\.", ":"))
    )
    return rows.withColumn("match", form).where(F.length("match") > 0)


def checked() -> Column:
    """Whether a proposal passes the check of its kind; no feature says so."""
    m, d = F.col("match"), digits_of(F.col("match"))
    return (
        F.when(F.col("kind") == "card", F.length(d).between(16, 19) & luhn(d))
        .when(F.col("kind") == "ip", octets_fit(F.regexp_replace(F.regexp_replace(m, "^[^0-9]+", ""), "[^0-9]+", ".")))
        .when(F.col("kind") == "phone", F.length(d).between(8, 15) & ~m.rlike(_DATE))
        .otherwise(m.rlike(r"(?:\.|(?i:dot)[)\]}]?\x20?)[A-Za-z]{2,6}$"))
    )


def weak_labels(found: DataFrame) -> DataFrame:
    """Rows with ``label``: base spans and worn forms are 1; proposals that fail the check of their kind, or that cut through
    or lie within a base span, are 0.  ``found`` has ``meets`` and ``same``, see ``beside_base``."""
    base = found.where("base").drop("meets", "same")
    wrong = found.where("not base and not same").where(F.col("meets") | ~checked()).drop("meets", "same")
    return base.withColumn("label", F.lit(1.0)).unionByName(worn(base).withColumn("label", F.lit(1.0))).unionByName(wrong.withColumn("label", F.lit(0.0)))


def beside_base(found: DataFrame) -> DataFrame:
    """``found`` with ``meets``: whether a proposal overlaps a base span, and ``same``: whether it is one but for its kind or
    leading signs.  Two running extremes over the spans of a text in order of place, whatever their number."""
    own = Window.partitionBy("rid")
    forth = own.orderBy("start", F.desc("base"), "end").rowsBetween(Window.unboundedPreceding, 0)
    back = own.orderBy(F.desc("start"), "base", F.desc("end")).rowsBetween(Window.unboundedPreceding, 0)
    marks = found.withColumn("ended", F.max(F.when(F.col("base"), F.col("end"))).over(forth)).withColumn("next", F.min(F.when(F.col("base"), F.col("start"))).over(back))
    ends = F.max(F.when(F.col("base"), F.col("end"))).over(Window.partitionBy("rid", "end"))
    meets = F.coalesce(F.col("ended") > F.col("start"), F.lit(False)) | F.coalesce(F.col("next") < F.col("end"), F.lit(False))
    near = F.max(F.when(F.col("base"), F.col("start"))).over(Window.partitionBy("rid", "end"))
    same = F.coalesce(F.abs(near - F.col("start")) <= 2, F.lit(False)) & ends.isNotNull()
    return marks.withColumn("meets", meets).withColumn("same", same).drop("ended", "next")


def apart(scored: DataFrame) -> DataFrame:
    """Of added spans that overlap the best stays: the spans of a text are cut into runs that overlap, and in each run they are
    taken from the best to the worst, unless they overlap one taken before.  Ties go to the longer span, then the one further left.
    A run is part of one text; one that takes much of a very long text takes the square of its spans."""
    order = Window.partitionBy("rid").orderBy("start", "end", "kind")
    ended = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    cut = scored.withColumn("ended", ended).withColumn("run", F.count_if(F.col("ended").isNull() | (F.col("ended") <= F.col("start"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rank = F.struct("score", (F.col("end") - F.col("start")).alias("length"), (-F.col("start")).alias("left"), "kind")
    spans = cut.groupBy("rid", "run").agg(F.sort_array(F.collect_list(F.struct(rank.alias("rank"), F.struct(*scored.columns).alias("span"))), asc=False).alias("spans"))
    each = F.transform("spans", lambda x: x["span"])
    overlaps = lambda x: lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])
    taken = F.aggregate(each, F.filter(each, lambda x: F.lit(False)), lambda kept, x: F.when(F.exists(kept, overlaps(x)), kept).otherwise(F.array_append(kept, x)))
    best = F.when(F.size("spans") == 1, each).otherwise(taken)
    return spans.select(F.explode(best).alias("span")).select("span.*")


@dataclass(frozen=True)
class Judge:
    """Trees, and the threshold of each kind that may add spans."""

    model: GBTClassificationModel
    inputs: list[str]
    thresholds: dict[str, float]


def learn(rows: DataFrame, *, precision: float = PRECISION, least: int = 20) -> Judge | None:
    """Fit and calibrate on all distinct rows; nothing if a class has fewer than ``least``."""
    content = ["kind", "match", "left", "right"]
    data, inputs = features(rows.select(*content, "label").distinct())
    data = stash(data.withColumn("held", F.pmod(F.xxhash64("left", "right"), F.lit(5)) == 0))
    sizes = {(r["held"], r["label"]): r["count"] for r in data.groupBy("held", "label").count().collect()}
    if min(sizes.get((False, y), 0) for y in (0.0, 1.0)) < least:
        return None
    table = VectorAssembler(inputCols=inputs, outputCol="features").transform(data)
    model = GBTClassifier(labelCol="label", maxIter=12, maxDepth=3, stepSize=0.3, seed=7, cacheNodeIds=True).fit(table.where("not held"))
    held = model.transform(table.where("held")).select("kind", "label", vector_to_array("probability")[1].alias("p"))
    cuts = F.explode(F.transform(F.sequence(F.lit(1), F.lit(19)), lambda k: k / 20.0)).alias("cut")
    graded = held.select("kind", "label", "p", cuts).where(F.col("p") >= F.col("cut")).groupBy("kind", "cut").agg(F.avg("label").alias("precision"), F.count("*").alias("n"))
    chosen = graded.where((F.col("precision") >= precision) & (F.col("n") >= 10)).groupBy("kind").agg(F.min("cut").alias("cut")).collect()
    return Judge(model, inputs, {r["kind"]: r["cut"] for r in chosen})


def judged(free: DataFrame, judge: Judge) -> DataFrame:
    """Proposals at or above the threshold of their kind, with ``score``."""
    if not judge.thresholds:
        return free.withColumn("score", F.lit(0.0)).where(F.lit(False))
    rows, _ = features(free)
    scored = judge.model.transform(VectorAssembler(inputCols=judge.inputs, outputCol="features").transform(rows))
    bar = reduce(lambda a, kv: a.when(F.col("kind") == kv[0], kv[1]), list(judge.thresholds.items())[1:], F.when(F.col("kind") == list(judge.thresholds)[0], list(judge.thresholds.values())[0]))
    return scored.withColumn("score", vector_to_array("probability")[1]).where(F.col("score") >= bar).select(*free.columns, "score")


def find(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", precision: float = PRECISION) -> DataFrame:
    """Spans of each text that has any: rid and spans, an array of (rank of the kind, kind, start, end, base, score),
    sorted.  Of added spans that overlap the best one stays; none overlaps a base span."""
    found = stash(beside_base(candidates(docs, doc_id=doc_id, text=text)))
    free = found.where("not base and not meets").where(checked()).drop("meets", "same")
    judge = learn(weak_labels(found), precision=precision)
    spans = found.where("base").drop("meets", "same").withColumn("score", F.lit(1.0))
    if judge is not None:
        spans = spans.unionByName(apart(judged(free, judge)))
    rank = F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col("kind"))
    entry = F.struct(rank.alias("rank"), "start", "end", "kind", "base", "score")
    return spans.groupBy("rid").agg(F.array_sort(F.collect_list(entry)).alias("spans"))


def report(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, all spans."""
    found = find(docs, doc_id=doc_id, text=text, **options)
    rows = docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("rid")).join(found, "rid", "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<rank:bigint,start:int,end:int,kind:string,base:boolean,score:double>>"))
    name = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    joined = lambda a: F.array_join(F.transform(a, name), ",")
    base = F.filter(spans, lambda x: x["base"])
    of_kind = lambda k: lambda x: x["kind"] == k
    return rows.select(
        "doc_id",
        *(F.size(F.filter(base, of_kind(k))).cast("bigint").alias(f"n_{k}") for k in KINDS),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
        F.size(F.filter(spans, lambda x: ~x["base"])).cast("bigint").alias("n_added"),
    )


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each span, and each run of overlapping ones, replaced by the kind of its first."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))

    reach = F.aggregate(ordered, F.array(F.lit(0)), lambda a, x: F.array_append(a, F.greatest(F.element_at(a, -1), x["end"])))

    def piece(x: Column, before: Column) -> Column:
        """What stands before a span, and its kind where no span before it reaches further."""
        fresh = F.concat(F.substr(text, before + 1, x["start"] - before), F.lit("["), F.upper(x["kind"]), F.lit("]"))
        return F.when(x["start"] < before, F.lit("")).otherwise(fresh)

    def pieces(r: Column) -> Column:
        return F.concat(F.array_join(F.transform(ordered, lambda x, i: piece(x, F.get(r, i))), ""), F.substr(text, F.element_at(r, -1) + 1, F.length(text)))

    return let(reach, pieces)


def redact(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by [EMAIL], [IP], [CARD] and [PHONE]; every row stays."""
    key, spans = free_name(docs, "pii_row"), free_name(docs, "pii_spans")
    found = find(docs, doc_id=doc_id, text=text, **options).select(F.col("rid").alias(key), F.col("spans").alias(spans))
    joined = docs.withColumn(key, row_key(doc_id, text)).join(found, key, "left")
    return joined.select(*(F.when(F.col(spans).isNull(), F.col(c)).otherwise(redacted(F.col(c), F.col(spans))).alias(c) if c == text else F.col(c) for c in docs.columns))
