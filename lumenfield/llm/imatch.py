"""I-Match fingerprints over a band of inverse document frequency, with randomised lexicon subsets.

The lexicon is made of the terms that occur in at least ``least`` and at most ``most`` of all documents.  Each of a
ladder of random subsets of it (eight seeds; shares 1, 1/2, 1/4 ... 1/1024 of the lexicon) gives one signature of a text: a
hash of the sorted distinct terms that text and subset share.  A fingerprint is the list of these signatures.  Two texts are as
alike as the share of equal signatures among all subsets that hold a term of either text: large subsets agree for texts with
the same terms only, smaller ones bear more and more edits.

Document frequencies are exact for every term of the band: a term in a share p of all documents is in a share p of the
documents of some partition, so partitions propose what is frequent in them, and a second pass counts the proposed
terms everywhere.  Their number follows from the band (texts of m distinct terms leave room for m / least terms), not
from the size of the corpus; above ``broadcast_terms`` they are counted by a plain shuffle instead.

Defined results: terms are runs without ASCII white space, without regard to ASCII case; a null text is empty; a text without a term of
the lexicon is known by a hash of all its terms, and is alike (1.0) only to a text with the same; equal texts have equal
fingerprints; documents with one doc_id come in descending order of their texts; ids of any type that can be sorted do, and a null doc_id comes last; a table of
one document is its own successor; an empty table gives an empty table; other columns take no part.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .common import text_or_empty

LEAST, MOST = 0.002, 0.2
SEEDS, LEVELS = 8, 11
BROADCAST_TERMS = 2_000_000
PART_BYTES = 32 << 20
MOST_PARTS = 50_000


def distinct_terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(term, text) pairs without repeats, sorted by term and then by text."""
    words, at = tokens.word_hashes(data, offsets)
    order = np.argsort(words, kind="stable")
    term, text = words[order], np.repeat(np.arange(len(at) - 1), np.diff(at))[order]
    fresh = np.ones(len(term), bool)
    fresh[1:] = (term[1:] != term[:-1]) | (text[1:] != text[:-1])
    return term[fresh], text[fresh]


def _sum(terms: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not terms:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    term, back = np.unique(np.concatenate(terms), return_inverse=True)
    return term, np.bincount(back, np.concatenate(counts), len(term)).astype(np.int64)


def _counted(column: pa.Array, wanted: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    data, offsets = tokens.text_buffer(column)
    for i, j in tokens.chunks(offsets):
        term, _ = distinct_terms(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        if wanted is not None:
            term = term[member(term, wanted)]
        yield np.unique(term, return_counts=True)


def member(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values of ``x`` are in the sorted ``table``."""
    if not len(table):
        return np.zeros(len(x), bool)
    return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x


def _rows(term: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(count, pa.int64())], ["term", "df"])


def _propose(share: float):
    """Terms that are frequent in this partition; everything else it has seen is forgotten."""

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, counts, docs, held = [], [], 0, 0
        for batch in batches:
            docs += batch.num_rows
            for t, c in _counted(batch.column(0), None):
                terms.append(t)
                counts.append(c)
                held += len(t)
                if held > 2_000_000:
                    t, c = _sum(terms, counts)
                    terms, counts, held = [t], [c], 0
        t, c = _sum(terms, counts)
        keep = c >= share * docs
        yield _rows(t[keep], c[keep])

    return propose


def _count(wanted):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, counts = [], []
        for batch in batches:
            for t, c in _counted(batch.column(0), None if wanted is None else wanted.value):
                if wanted is None:
                    yield _rows(t, c)
                else:
                    terms.append(t)
                    counts.append(c)
                    if len(terms) == 64:
                        t, c = _sum(terms, counts)
                        terms, counts = [t], [c]
        yield _rows(*_sum(terms, counts))

    return count


def lexicon(docs: DataFrame, *, text: str = "text", least: float = LEAST, most: float = MOST, broadcast_terms: int = BROADCAST_TERMS) -> tuple[np.ndarray, int, int]:
    """Sorted hashes of the terms in the band; the numbers of documents and of bytes."""
    lean = docs.select(text_or_empty(text).alias("t"))
    rows, size = lean.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).collect()[0]
    schema = "term bigint, df bigint"
    proposed = lean.mapInArrow(_propose(least), schema).select("term").distinct()
    some = proposed.limit(broadcast_terms + 1).toArrow().column(0).to_numpy() if rows else np.zeros(0, np.int64)
    if len(some) <= broadcast_terms:
        wanted = docs.sparkSession.sparkContext.broadcast(np.sort(some.view(np.uint64)))
        counted = lean.mapInArrow(_count(wanted), schema)
    else:
        counted = lean.mapInArrow(_count(None), schema)
    band = counted.groupBy("term").agg(F.sum("df").alias("df")).where(F.col("df").between(math.ceil(least * rows), most * rows))
    found = band.select("term").toArrow().column(0).to_numpy()  # at most (mean distinct terms) / least values
    return np.sort(found.view(np.uint64)), rows, size


def subset_hashes(data: np.ndarray, offsets: np.ndarray, words: np.ndarray, seeds: int = SEEDS, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray]:
    """A row of 32-bit signatures for each text, 0 for a subset without a term of it; and a hash of all terms where a text
    has none of the lexicon, else 0."""
    n = len(offsets) - 1
    out = np.zeros((n, seeds, levels), np.uint32)
    term, text = distinct_terms(data, offsets)
    order = np.argsort(text, kind="stable")  # by text, and within it by term
    term, text = term[order], text[order]
    inside = member(term, words)
    counts = np.bincount(text[inside], minlength=n)
    rest = np.zeros(n, np.uint64)
    bare = (counts == 0)[text]
    np.add.at(rest, text[bare], tokens.mix(term[bare]))
    rest[counts == 0] = tokens.mix(rest[counts == 0]) | np.uint64(1)
    for s in range(seeds):
        held, of = term[inside], text[inside]
        for level in range(levels):  # each subset is half of the one before
            if level:
                stays = tokens.mix(held ^ tokens.mix(np.array([977 + s], np.uint64))) < np.uint64(1 << (64 - level))
                held, of = held[stays], of[stays]
            if not len(held):
                break
            starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            rank = np.arange(len(held)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(held)]])))
            signature = tokens.mix(np.add.reduceat(tokens.mix(held) * tokens.powers(int(tokens.BASE), int(rank.max()) + 1)[rank], starts))
            out[of[starts], s, level] = (signature >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    return out, rest


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The share of equal signatures, row by row, among the subsets that hold a term of either text."""
    (x, rx), (y, ry) = a, b
    filled = ((x != 0) | (y != 0)).sum((1, 2))
    equal = ((x == y) & (x != 0)).sum((1, 2))
    return np.where(filled > 0, equal / np.maximum(filled, 1), (rx == ry).astype(float))


def names(prints: tuple[np.ndarray, np.ndarray]) -> list[str]:
    out, rest = prints
    raw = np.ascontiguousarray(out.reshape(len(out), -1).astype(">u4"))
    return [a.tobytes().hex() + (f"{int(b):016x}" if b else "") for a, b in zip(raw, rest, strict=True)]


def _prints(texts: list[str], words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = tokens.text_buffer(pa.array(texts, pa.string()))
    parts = [subset_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words) for i, j in tokens.chunks(offsets)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by the beginning of ``following``."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


_OUT = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(words):
    """Rows in order, each followed by its successor; a guest ends its part and is only a successor."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: pa.RecordBatch | None = None
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                rows = pa.Table.from_batches([part] if carried is None else [carried, part]).combine_chunks()
                carried = part.slice(part.num_rows - 1)
                n = rows.num_rows - 1
                if n < 1:
                    continue
                texts = rows.column("t").to_pylist()
                new = [edited(a, b) for a, b in zip(texts[:-1], texts[1:], strict=True)]
                own, changed = _prints(texts, words.value), _prints(new, words.value)
                first, after = tuple(x[:-1] for x in own), tuple(x[1:] for x in own)
                known = names(first)
                keep = np.flatnonzero(rows.column("guest").to_numpy()[:-1] == 0)
                columns = [
                    rows.column("id").slice(0, n).combine_chunks(),
                    pa.array([len(t) for t in texts[:-1]], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new], pa.string()),
                    pa.array(known, pa.string()),
                    pa.array(names(changed), pa.string()),
                    pa.array(likeness(first, changed)),
                    pa.array(likeness(first, after)),
                ]
                columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(x.split()[0] for x in _OUT.split(", "))]).take(pa.array(keep))

    return compare


def _place(docs: DataFrame, doc_id: str) -> Column:
    """A number that never falls as the id rises; different ids may share one."""
    kind = docs.schema[doc_id].dataType
    if isinstance(kind, T.NumericType):
        return F.col(doc_id).cast("double")
    if isinstance(kind, (T.DateType, T.TimestampType)):
        return F.unix_micros(F.col(doc_id).cast("timestamp")).cast("double")
    head = F.rpad(F.hex(F.substring(F.col(doc_id).cast("string").cast("binary"), 1, 6)), 12, "0")
    return F.conv(head, 16, 10).cast("double")


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: float = LEAST, most: float = MOST, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next.  The successor is the next document in descending order of doc_id, after the last one the first.

    Texts are dealt into ranges of doc_id, and each range gets the first document of the range below it as a guest, so one
    shuffle of the texts brings every document next to its successor."""
    spark = docs.sparkSession
    words, rows, size = lexicon(docs, text=text, least=least, most=most)
    order = F.coalesce(_place(docs, doc_id), F.lit(float("-inf")))
    lean = docs.select(F.col(doc_id).alias("id"), order.alias("at"), text_or_empty(text).alias("t"))
    parts = min(MOST_PARTS, max(2, -(-size // part_bytes)))
    cuts = lean.select("at").where("at is not null").stat.approxQuantile("at", [k / parts for k in range(1, parts)], 0.1 / parts) if rows else []
    cuts = sorted({c for c in cuts if math.isfinite(c)})
    dealt = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="at", outputCol="part", handleInvalid="keep").transform(lean) if cuts else lean.withColumn("part", F.lit(0.0))
    tops = dealt.groupBy("part").agg(F.max("at").alias("at")).orderBy(F.desc("part")).collect()  # one row for each range
    above = [(low["at"], high["part"]) for high, low in zip(tops, [*tops[1:], *tops[:1]], strict=True)]
    guests = F.broadcast(spark.createDataFrame(above, "at double, host double"))  # at most ``MOST_PARTS`` rows
    all_ = dealt.select("id", "at", "t", "part", F.lit(0).alias("guest")).union(dealt.join(guests, "at").select("id", "at", "t", F.col("host").alias("part"), F.lit(1)))
    table = spark.sparkContext.broadcast(words)
    by = [F.asc("part"), F.asc("guest"), F.desc("at"), F.desc_nulls_last("id"), F.desc("t")]
    together = all_.repartition(max(len(cuts) + 1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "part").sortWithinPartitions(*by)
    return together.select("id", "t", "guest").mapInArrow(_compare(table), f"doc_id {dict(docs.dtypes)[doc_id]}, {_OUT}")
