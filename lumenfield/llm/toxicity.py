"""Toxicity scores from character n-grams: a logistic model on presences scaled by naive Bayes log-count ratios.

Features are the runs of three, four and five characters (code points) of a text in lower case, white space as blanks,
hashed into 2**20 buckets; a feature is there or not.  From labelled texts come the log ratios r of how often a bucket occurs in toxic and in other texts, a logistic
model is fitted on presences times r for all buckets that at least ``least_texts`` of these texts have, and the two are folded into one
weight for each bucket.  A text's score adds the weights of its buckets once each.

The fit takes labelled documents in the order of a hash of their ids, one row of each, at most ``sample_rows`` of them and ``sample_chars``
characters together (documented bounds; a longer text is not fitted on).  Tasks work out which buckets each text has; one task takes these
lists, some 130 MB for 8,000 texts and at most 400 MB, and sends out one weight for each bucket, whatever the size of the corpus.
Scoring is a scan with no shuffle.

Defined results: a null or empty text has no features and gets the score of the intercept; without any labelled row of
either class every score is 0.5; of documents that share an id the fit sees the least text; labels that repeat a document count once, as toxic if any says so; a null label does not
count; rows that repeat are scored one by one; a row with null doc_id is scored and not held out; an empty table gives an
empty table; other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tokens
from .common import stash, text_or_empty

SIZES = (3, 4, 5)
BITS = 20
SAMPLE_ROWS = 8000
SAMPLE_CHARS = 1 << 25
LEAST_TEXTS = 3

CHUNK_CHARS = 1 << 20


def _lowered(text: str) -> str:
    """Lower case, character by character, and white space as blanks."""
    low = text.lower()
    low = low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    return low.translate(_BLANKS)


_BLANKS = dict.fromkeys((9, 10, 11, 12, 13), 32)


def code_points(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all texts, and where each text begins."""
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return np.frombuffer(_lowered("".join(texts)).encode("utf-32-le", "surrogatepass"), np.uint32), offsets


def buckets(codes: np.ndarray, size: int) -> np.ndarray:
    """The bucket of each run of ``size`` characters, those that cross into the next text included."""
    n = max(0, len(codes) - size + 1)
    value = np.full(n, size, np.uint64)
    for k in range(size):
        value = value * np.uint64(0x9E3779B97F4A7C15) + codes[k : n + k]
    value ^= value >> np.uint64(29)
    value *= np.uint64(0xBF58476D1CE4E5B9)
    return (value >> np.uint64(64 - BITS)).astype(np.int32)


def present(codes: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The buckets of each text, without repeats.  Each run writes its number to its bucket's place; of runs that share a bucket
    one finds its own number there again."""
    every = [buckets(codes, size) for size in SIZES]
    place = np.empty(1 << BITS, np.int32)
    at = offsets.tolist()
    for i, j in zip(at[:-1], at[1:], strict=True):
        own = np.concatenate([b[i : max(i, j - size + 1)] for size, b in zip(SIZES, every, strict=True)])
        number = np.arange(len(own), dtype=np.int32)
        place[own] = number
        yield own[place[own] == number]


def _runs(sizes: Sequence[int]) -> Iterator[tuple[int, int]]:
    return tokens.chunks(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), CHUNK_CHARS)


class Presences:
    """Which of ``columns`` places each text has: for a text, the places from one start to the next.  Texts go a few at a time."""

    def __init__(self, col: np.ndarray, at: np.ndarray, columns: int):
        self.col, self.at, self.columns = col, at, columns
        self.runs = list(tokens.chunks(at, 1 << 22))

    def times(self, u: np.ndarray) -> np.ndarray:
        """For each text the sum of its places' ``u``."""
        out = np.zeros(len(self.at) - 1)
        for i, j in self.runs:
            sums = np.concatenate([[0.0], np.cumsum(u[self.col[self.at[i] : self.at[j]]])])
            out[i:j] = np.diff(sums[self.at[i : j + 1] - self.at[i]])
        return out

    def gathered(self, e: np.ndarray) -> np.ndarray:
        """For each place the sum of the ``e`` of the texts that have it."""
        out = np.zeros(self.columns)
        for i, j in self.runs:
            out += np.bincount(self.col[self.at[i] : self.at[j]], np.repeat(e[i:j], np.diff(self.at[i : j + 1])), self.columns)
        return out


def fit(col: np.ndarray, at: np.ndarray, toxic: np.ndarray, *, steps: int = 60, penalty: float = 1.0, least_texts: int = LEAST_TEXTS, close: float = 1e-6) -> tuple[np.ndarray, float]:
    """A weight for each bucket, and the intercept, from the buckets of each text: those of ``col`` from one place in ``at`` to the next.

    Accelerated gradient steps whose length follows from the largest eigenvalue of the features, by power iteration, and is halved
    wherever a step does not lower the loss as far as that length promises; they end after ``steps``, or when the gradient
    is below ``close``.  On a validation fold of labelled rows 60 steps did as well as 150, which begin to overfit."""
    weights = np.zeros(1 << BITS, np.float32)
    n_bad, n = int(toxic.sum()), len(toxic)
    if not 0 < n_bad < n:
        return weights, 0.0
    all_ = Presences(col, at, 1 << BITS)
    bad = all_.gathered((toxic == 1).astype(float))
    good = all_.gathered((toxic != 1).astype(float))
    ratio = np.log((bad + 1.0) / (bad + 1.0).sum()) - np.log((good + 1.0) / (good + 1.0).sum())
    chosen = np.flatnonzero(bad + good >= least_texts)
    place = np.full(1 << BITS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    held = place[col] >= 0
    x = Presences(place[col[held]], np.concatenate([[0], np.cumsum(held)])[at], len(chosen))
    scale, y = ratio[chosen], toxic.astype(float)
    turned = lambda v, c: x.times(v * scale) + c

    def loss(z: np.ndarray, v: np.ndarray) -> float:
        return float((np.logaddexp(0.0, z) - y * z).mean() + penalty / n / 2 * (v @ v))

    v, c = scale / max(1e-12, float(np.sqrt(scale @ scale))), 1.0
    top = 1.0
    for _ in range(8):
        z = turned(v, c)
        v, c = x.gathered(z) * scale / n, float(z.mean())
        top = max(1e-12, float(np.sqrt(v @ v + c * c)))
        v, c = v / top, c / top
    bound = top / 4 + penalty / n
    b = b0 = float(np.log(n_bad / (n - n_bad)))
    w, w0, t = np.zeros(len(chosen)), np.zeros(len(chosen)), 1.0
    z, z0 = turned(w, b), turned(w, b)
    for _ in range(steps):
        t1 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        k = (t - 1) / t1
        v, c, zv = w + k * (w - w0), b + k * (b - b0), z + k * (z - z0)
        e = 1 / (1 + np.exp(-np.clip(zv, -500, 500))) - y
        grad, shift = x.gathered(e) * scale / n + penalty / n * v, float(e.mean())
        slope = float(grad @ grad + shift * shift)
        if slope <= close * close:
            break
        before = loss(zv, v)
        while True:
            w1, b1 = v - grad / bound, c - shift / bound
            z1 = turned(w1, b1)
            if loss(z1, w1) <= before - slope / (2 * bound) + 1e-12 * max(1.0, abs(before)):
                break
            bound *= 2
        if grad @ (w1 - w) + shift * (b1 - b) > 0:  # uphill: start the momentum anew
            t1 = 1.0
        w0, b0, z0, w, b, z, t = w, b, z, w1, b1, z1, t1
    weights[chosen] = (w * scale).astype(np.float32)
    return weights, float(b)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def _presences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, y, text) -> (key, y, the buckets of the text as 32-bit numbers)."""
    for batch in batches:
        for i, j in _runs(np.diff(tokens.text_buffer(batch.column(2))[1])):
            each = list(present(*code_points(batch.column(2).slice(i, j - i).to_pylist())))
            ends, bucket = np.concatenate([[0], np.cumsum([len(x) for x in each])]) * 4, np.concatenate(each)
            lists = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(bucket.astype(np.uint32))])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), lists.cast(pa.binary())], ["key", "y", "buckets"])


def sample(docs: DataFrame, labels: DataFrame, *, doc_id: str, text: str, label: str, sample_rows: int, sample_chars: int) -> DataFrame:
    """key, y and t of the labelled documents to fit on: not held out, in the order of a hash, within both bounds."""
    marks = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id))).groupBy(doc_id).agg(F.max(label).alias("y"))
    chosen = marks.orderBy(F.xxhash64(doc_id), doc_id).limit(sample_rows).select(F.col(doc_id).alias("key"), F.col("y").cast("int").alias("y"))
    rows = docs.select(F.col(doc_id).alias("key"), text_or_empty(text).alias("t")).join(F.broadcast(chosen), "key")  # at most ``sample_rows`` short rows
    rows = rows.groupBy("key").agg(F.min("t").alias("t"), F.first("y").alias("y"))
    texts = stash(rows.withColumn("n", F.length("t")).where(F.col("n") <= sample_chars))
    so_far = F.sum(F.col("n").cast("bigint")).over(W.orderBy(F.xxhash64("key"), "key"))  # of at most ``sample_rows`` lengths
    fitting = texts.select("key", so_far.alias("so_far")).where(F.col("so_far") <= sample_chars)
    return texts.join(F.broadcast(fitting.select("key")), "key").select("key", "y", "t")


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS, least_texts: int = LEAST_TEXTS) -> tuple[np.ndarray, float]:
    """Fit on at most ``sample_rows`` labelled documents, and ``sample_chars`` characters of them, that are not held out."""
    rows = sample(docs, labels, doc_id=doc_id, text=text, label=label, sample_rows=sample_rows, sample_chars=sample_chars)
    lists = rows.mapInArrow(_presences, f"key {dict(rows.dtypes)['key']}, y int, buckets binary")

    def solve(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table.column("key").to_numpy(), kind="stable"))).combine_chunks()
        column = table.column("buckets")
        data, at = tokens.text_buffer(column.chunk(0) if isinstance(column, pa.ChunkedArray) else column)
        w, b = fit(data[at[0] : at[-1]].view(np.uint32), (at - at[0]) // 4, table.column("y").to_numpy(), least_texts=least_texts)
        return pa.table({"weights": [w.tobytes()], "intercept": [b]})

    got = lists.groupBy(F.lit(0).alias("one")).applyInArrow(solve, "weights binary, intercept double").collect()
    return (np.frombuffer(got[0]["weights"], np.float32), got[0]["intercept"]) if got else (np.zeros(1 << BITS, np.float32), 0.0)


def _score(model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, intercept = model.value
        for batch in batches:
            sizes = np.diff(tokens.text_buffer(batch.column(1))[1])
            for i, j in _runs(sizes):
                texts = code_points(batch.column(1).slice(i, j - i).to_pylist())
                z = np.array([weights[b].sum(dtype=float) for b in present(*texts)]) + intercept
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], ["doc_id", "score"])

    return score


def scores(docs: DataFrame, model: tuple[np.ndarray, float], *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score, predicted."""
    lean = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("t"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = lean.mapInArrow(_score(shared), f"doc_id {dict(lean.dtypes)['doc_id']}, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
