"""Collocations of each language by best-first branch and bound over the tree of phrases.

A phrase's parts split it into two, and its score is 2000000 a / (l + r) at the split that scores lowest: a, l and r
count the phrase, its first part and the rest.  What a prefix q can grow into occurs at most as often as q and begins with the same word, so no
extension scores more than 2000000 f(q) / (f(first word) + f(q)): prefix counts bound all growth below them.

Words and pairs are counted first (one word bounds nothing).  Then each language has a threshold, the score at about twice the
asked rank among its known candidates, and the frontier grows from the best bound down to it: a pass over the texts counts
what follows open pairs, another what follows open triples.  Candidates above the threshold also need what may absorb them, so that the words before
them are counted as well, and rarely a third pass counts the last three words of a four-word phrase.  Where fewer than the asked
number of phrases survive above the threshold, it falls; it is settled once all that is left scores less, ties included.

A pass counts exactly by chunk of texts, and a shuffle adds up.  Which phrases it counts is told by bitmaps of a fixed size: Bloom
filters of the frontier, and buckets of hashed pairs that hold enough pairs in all for one of them to be frequent (counted in
a pass of their own).  A false hit counts one phrase more, and no count ever misses a part.

Defined results: null texts are empty; a null language is ``und``; rows that repeat count; languages with fewer phrases return what
they have; an empty table gives an empty table; other columns take no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import stash, text_or_empty

LEAST = 30
MOST_WORDS = 4
TOP = 2000
#: A phrase goes if a longer one has at least so many hundredths of its count.
ABSORBED = 80
SCALE = 2_000_000
BLOOM_BITS = 25
#: Buckets that pairs are counted in before they are counted by name, and how they are cut for the shuffle.
BUCKET_BITS, SLICE_BITS = 24, 16
CHUNK_BYTES = 1 << 22

_CUTS = np.zeros(256, bool)
_CUTS[[*b".,;:!?", 10, 11, 12, 13]] = True
_GAPS = _CUTS.copy()
_GAPS[[9, 32]] = True
_BLANK = np.zeros(256, bool)
_BLANK[32] = True
_FOLD = np.uint64(0xD6E8FEB86659FD93)


class Wanted(NamedTuple):
    """Bitmaps that say what a pass counts; None counts nothing of the kind."""

    full: np.ndarray | None = None  # buckets of hashed pairs, one of which may be frequent
    pairs: np.ndarray | None = None  # prefixes of triples
    pairs_after: np.ndarray | None = None  # last two words of triples
    triples: np.ndarray | None = None  # triples as such
    prefixes: np.ndarray | None = None  # prefixes of four words
    triples_after: np.ndarray | None = None  # last three words of four


def _has(bits: np.ndarray | None, hashes: np.ndarray) -> np.ndarray:
    if bits is None:
        return np.zeros(len(hashes), bool)
    out = np.ones(len(hashes), bool)
    for at in _places(hashes):
        out &= bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1) == 1
    return out


def _places(hashes: np.ndarray) -> Iterator[np.ndarray]:
    mask = np.uint64((1 << BLOOM_BITS) - 1)
    yield hashes & mask
    yield hashes >> np.uint64(64 - BLOOM_BITS)


def _folded(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return tokens.mix(before * _FOLD + word)


def _hashes(column: pa.Array, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = tokens.text_buffer(column)
    starts, ends, at = tokens.word_spans(data, offsets, gaps)
    return tokens.span_hashes(data, starts, ends), at


def _whole(column: pa.Array) -> np.ndarray:
    """Hashes of whole values."""
    data, offsets = tokens.text_buffer(column)
    return tokens.span_hashes(data, offsets[:-1], offsets[1:])


def _bitmap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        words, at = _hashes(batch.column(1), _BLANK)
        each = _whole(batch.column(0))
        for k in range(int(np.diff(at)[0])):  # all phrases of a bitmap have so many words
            each = _folded(each, words[at[:-1] + k])
        places = np.unique(np.concatenate(list(_places(each))))
        cut = np.flatnonzero(np.concatenate([[True], places[1:] >> np.uint64(6) != places[:-1] >> np.uint64(6)]))
        bits = np.bitwise_or.reduceat(np.uint64(1) << (places & np.uint64(63)), cut)
        yield pa.RecordBatch.from_arrays([pa.array((places[cut] >> np.uint64(6)).astype(np.int64)), pa.array(bits.view(np.int64))], ["slot", "bits"])


def bitmap(phrases: DataFrame) -> np.ndarray | None:
    """A Bloom filter of (lang, phrase), phrases of one length: at most 2**BLOOM_BITS bits reach the driver, however many phrases."""
    met = phrases.select("lang", "phrase").mapInArrow(_bitmap, "slot bigint, bits bigint").groupBy("slot").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()
    if not met.num_rows:
        return None
    out = np.zeros(1 << (BLOOM_BITS - 6), np.uint64)
    out[met.column("slot").to_numpy()] = met.column("bits").to_numpy().view(np.uint64)
    return out


def _count(words: int, wanted) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts by chunk of (lang, phrase): all words (and a null phrase: how many), pairs in full buckets, or longer phrases."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in tokens.chunks(tokens.text_buffer(batch.column(1))[1], CHUNK_BYTES):
                yield from _counted(batch.slice(i, j - i), words, wanted.value)

    return count


def _full(wanted: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes >> np.uint64(64 - BUCKET_BITS)
    return wanted[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1


def _split(part: pa.RecordBatch) -> tuple:
    """The words of a chunk, their languages, and which stand beside the next one: in one piece of one text."""
    data, offsets = tokens.text_buffer(part.column(1))
    data = tokens.LOWER[data]
    starts, ends, at = tokens.word_spans(data, offsets, _GAPS)
    langs = part.column(0).dictionary_encode()
    lang = np.repeat(langs.indices.to_numpy(), np.diff(at))
    passed = np.concatenate([[0], np.cumsum(_CUTS[data], dtype=np.int32)])
    beside = passed[ends[:-1]] == passed[starts[1:]]
    inner = at[1:-1]
    beside[inner[(inner > 0) & (inner < len(starts))] - 1] = False  # a text ends
    return data, starts, ends, langs.dictionary, lang, beside


def _buckets(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """How many pairs fall into each bucket, up to ``least``: packed slices, once a task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << BUCKET_BITS, np.uint8)
        for batch in batches:
            for i, j in tokens.chunks(tokens.text_buffer(batch.column(1))[1], CHUNK_BYTES):
                data, starts, ends, langs, lang, beside = _split(batch.slice(i, j - i))
                if len(starts) < 2:
                    continue
                hashed = tokens.span_hashes(data, starts, ends)
                two = _folded(_folded(_whole(langs)[lang[:-1]], hashed[:-1]), hashed[1:])[beside]
                bucket, n = np.unique(two >> np.uint64(64 - BUCKET_BITS), return_counts=True)
                held[bucket] = np.minimum(held[bucket] + np.minimum(n, least), least)
        parts = [(k, part) for k, part in enumerate(held.reshape(-1, 1 << SLICE_BITS)) if part.any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for _, p in parts], pa.binary())], ["slice", "counts"])

    return count


def _bucket_totals(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Slices in order -> for each the bits of the buckets with ``least`` pairs or more; one slice is held at a time."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, np.zeros(0, np.uint8)
        row = lambda: pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([np.packbits(held >= least, bitorder="little").tobytes()], pa.binary())], ["slice", "bits"])
        for batch in batches:
            for k, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if k != last:
                    if last is not None:
                        yield row()
                    last, held = k, np.zeros(1 << SLICE_BITS, np.uint8)
                held = np.minimum(held + np.frombuffer(zlib.decompress(counts.as_py()), np.uint8), least)
        if last is not None:
            yield row()

    return total


def full_buckets(texts: DataFrame, least: int) -> np.ndarray:
    """A bit for each of 2**BUCKET_BITS buckets: whether ``least`` pairs or more fall into it."""
    least = min(least, 127)  # counters are bytes, and a lower bar only lets more pairs be counted by name
    slices = texts.mapInArrow(_buckets(least), "slice int, counts binary").repartition("slice").sortWithinPartitions("slice")
    out = np.zeros(1 << (BUCKET_BITS - 3), np.uint8)
    for row in slices.mapInArrow(_bucket_totals(least), "slice int, bits binary").collect():  # of a fixed size in all
        size = 1 << (SLICE_BITS - 3)
        out[row["slice"] * size : (row["slice"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return out


def _counted(part: pa.RecordBatch, words: int, wanted: Wanted) -> Iterator[pa.RecordBatch]:
    data, starts, ends, langs, lang, beside = _split(part)
    n = len(starts)
    sizes = ends - starts
    cuts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    coded = pa.LargeStringArray.from_buffers(n, pa.py_buffer(cuts), pa.py_buffer(data[tokens.ranges(starts, sizes)].tobytes())).dictionary_encode()
    spelled, code = coded.dictionary.cast(pa.string()), coded.indices.to_numpy()
    v = max(1, len(spelled))

    def rows(chosen: np.ndarray, size: int) -> pa.RecordBatch:
        key = lang[chosen].astype(np.int64)
        for k in range(size):
            if k == 2:  # two more would pass 64 bits
                key = np.unique(key, return_inverse=True)[1]
            key = key * v + code[chosen + k]
        _, first, counts = np.unique(key, return_index=True, return_counts=True)
        first = chosen[first]
        phrase = [spelled.take(pa.array(code[first + k])) for k in range(size)]
        phrase = phrase[0] if size == 1 else pc.binary_join_element_wise(*phrase, " ")
        return pa.RecordBatch.from_arrays([langs.take(pa.array(lang[first])), phrase, pa.array(counts.astype(np.int64))], ["lang", "phrase", "n"])

    if words == 1:
        yield rows(np.arange(n), 1)
        total = np.bincount(lang, minlength=len(langs)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([langs, pa.nulls(len(total), pa.string()), pa.array(total)], ["lang", "phrase", "n"])
        return
    if n < 2:
        return
    # What begins at a place is hashed from there on, so that a phrase has one hash wherever it stands.
    hashed = _whole(coded.dictionary)[code]
    two = _folded(_folded(_whole(langs)[lang[:-1]], hashed[:-1]), hashed[1:])
    two_ok = beside & _full(wanted.full, two)
    if words == 2:
        yield rows(np.flatnonzero(two_ok), 2)
        return
    three = _folded(two[:-1], hashed[2:])
    three_ok = two_ok[:-1] & two_ok[1:]
    yield rows(np.flatnonzero(three_ok & (_has(wanted.pairs, two[:-1]) | _has(wanted.pairs_after, two[1:]) | _has(wanted.triples, three))), 3)
    four_ok = three_ok[:-1] & three_ok[1:]
    yield rows(np.flatnonzero(four_ok & (_has(wanted.prefixes, three[:-1]) | _has(wanted.triples_after, three[1:]))), 4)


def _pass(texts: DataFrame, words: int, wanted: Wanted = Wanted()) -> DataFrame:  # noqa: B008
    """(lang, phrase, a) of the phrases that a pass counts."""
    shared = texts.sparkSession.sparkContext.broadcast(wanted)
    return texts.mapInArrow(_count(words, shared), "lang string, phrase string, n bigint").groupBy("lang", "phrase").agg(F.sum("n").alias("a"))


def _size(phrase: str = "phrase") -> Column:
    return F.length(phrase) - F.length(F.translate(F.col(phrase), " ", "")) + 1


def _ratio(a: Column, whole: Column) -> Column:
    """floor(SCALE * a / whole), exact beyond 64 bits."""
    wide = [c.cast("decimal(20,0)") for c in (a, whole)]
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * wide[0], wide[1])


def scored(phrases: DataFrame, known: DataFrame) -> DataFrame:
    """``phrases`` (lang, phrase, a) with l, r and score of the split that scores lowest, the bound for what they grow into, and
    ``open``: whether the last words of a four-word phrase are not counted yet.  ``known``: lang, phrase, a of parts."""
    k = F.explode(F.sequence(F.lit(1), _size() - 1)).alias("k")
    splits = phrases.select("lang", "phrase", "a", k).select("*", F.expr("substring_index(phrase, ' ', k)").alias("left"))
    splits = splits.withColumn("right", F.expr("substr(phrase, length(left) + 2)"))
    first = known.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l"))
    rest = known.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r"))
    met = splits.join(first, ["lang", "left"], "left").join(rest, ["lang", "right"], "left")
    score = F.when(F.col("l").isNotNull() & F.col("r").isNotNull(), _ratio(F.col("a"), F.col("l") + F.col("r")))
    best = F.min(F.struct(F.coalesce(score, F.lit(SCALE)).cast("bigint").alias("score"), "k", "l", "r"))
    bound = F.max(F.when(F.col("k") == 1, _ratio(F.col("a"), F.col("l") + F.col("a")))).cast("bigint")
    return met.groupBy("lang", "phrase", "a").agg(best.alias("best"), bound.alias("bound"), F.max((F.col("k") == 1) & F.col("r").isNull()).alias("open")).select("lang", "phrase", "a", "best.l", "best.r", "best.score", "bound", "open")


def absorbed(candidates: DataFrame, longer: DataFrame) -> DataFrame:
    """``candidates`` that no phrase of ``longer`` (lang, phrase, a) with one word more has most occurrences of."""
    before = longer.select("lang", F.expr("substring_index(phrase, ' ', length(phrase) - length(translate(phrase, ' ', '')))").alias("phrase"), "a")
    after = longer.select("lang", F.expr("substr(phrase, instr(phrase, ' ') + 1)").alias("phrase"), "a")
    most = before.union(after).groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    return candidates.join(most, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longest") < ABSORBED * F.col("a"), F.lit(True))).drop("longest")


def _at_rank(candidates: DataFrame, rank: Column | int) -> DataFrame:
    """(lang, level): the score at a rank of each language's candidates, nothing where they are fewer."""
    order = "row_number() over (partition by lang order by score desc, a desc, phrase)"
    return candidates.selectExpr("*", f"{order} as place").where(F.col("place") == rank).select("lang", F.col("score").alias("level"))


def mine(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    spark: SparkSession = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), text_or_empty(text).alias("t"))
    ones = stash(_pass(texts, 1).where((F.col("a") >= least) | F.col("phrase").isNull()))
    words = ones.where("phrase is not null")
    full = full_buckets(texts, least)
    pairs = stash(_pass(texts, 2, Wanted(full)).where(F.col("a") >= least))
    twos = stash(scored(pairs, words))
    nothing = spark.createDataFrame([], pairs.schema)
    threes, fours, grown = nothing, nothing, nothing
    # A language is settled down to its level; None: not yet open.
    levels = stash(_at_rank(twos, 2 * top).join(twos.select("lang").distinct(), "lang", "right").select("lang", F.coalesce("level", F.lit(0)).cast("bigint").alias("level"), F.lit(SCALE).cast("bigint").alias("before")))
    while True:
        met = twos.join(levels, "lang")
        open_pairs = met.where("bound >= level and bound < before")
        tops = met.where("score >= level and score < before")
        new = _pass(texts, 3, Wanted(full, pairs=bitmap(open_pairs), pairs_after=bitmap(tops))).where((F.col("a") >= least) & (_size() == 3))
        threes = stash(threes.union(new).groupBy("lang", "phrase").agg(F.max("a").alias("a")))
        triples = stash(scored(threes, words.union(pairs)))
        met = triples.join(levels, "lang").join(grown.select("lang", "phrase"), ["lang", "phrase"], "left_anti")
        frontier = met.where("bound >= level")
        new = _pass(texts, 3, Wanted(full, prefixes=bitmap(frontier), triples_after=bitmap(met.where("score >= level")))).where((F.col("a") >= least) & (_size() == 4))
        fours = stash(fours.union(new).groupBy("lang", "phrase").agg(F.max("a").alias("a")))
        grown = stash(grown.union(frontier.select("lang", "phrase", "a")))
        last = scored(fours, words.union(pairs).union(threes))
        missing = bitmap(last.join(levels, "lang").where("open and score >= level").select("lang", F.expr("substr(phrase, instr(phrase, ' ') + 1)").alias("phrase")).distinct())
        if missing is not None:
            new = _pass(texts, 3, Wanted(full, triples=missing)).where((F.col("a") >= least) & (_size() == 3))
            threes = stash(threes.union(new).groupBy("lang", "phrase").agg(F.max("a").alias("a")))
            last = scored(fours, words.union(pairs).union(threes))
        candidates = stash(twos.union(triples).union(last))
        kept = stash(absorbed(candidates.join(levels, "lang").where("score >= level").select(*candidates.columns), threes.union(fours)))
        found = kept.groupBy("lang").agg(F.count("*").alias("found"))
        state = levels.join(found, "lang", "left").select("lang", "level", F.coalesce("found", F.lit(0)).alias("found"))
        short = stash(state.where((F.col("found") < top) & (F.col("level") > 0)))
        if short.isEmpty():
            break
        below = candidates.join(short, "lang").where("score < level")
        reach = below.withColumn("rank", 2 * (top - F.col("found")))
        lower = _at_rank(reach, F.col("rank"))
        moved = short.select("lang", F.col("level").alias("before")).join(lower, "lang", "left").select("lang", F.coalesce("level", F.lit(0)).cast("bigint").alias("level"), "before")
        still = levels.join(short.select("lang"), "lang", "left_anti").select("lang", "level", F.col("level").alias("before"))
        levels = stash(moved.union(still))
    totals = ones.where("phrase is null").select("lang", F.col("a").alias("n"))
    ranked = kept.selectExpr("*", "row_number() over (partition by lang order by score desc, a desc, phrase) as rank").where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
