"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary choices, each made in the context of the bits before it and of up to ``depth`` bytes before that.
At every node (context, bits so far) the model holds the counts of zeros and ones; a Krichevsky-Trofimov estimate takes the
node as a leaf, and weighting mixes it half and half with the product of the nodes one byte deeper.  The estimates of all
depths along a path give the probability of a bit, those of a text's bits its code length.  Texts begin after marks that
no text holds and end in another, so that the probabilities of all texts add up to one.

The tree is a set of tables, a row a node, built from all training documents: runs of depth + 1 bytes are counted by chunk, added
up by a shuffle, and folded upwards and then downwards level by level.  Its size follows the corpus.
Scoring works by chunk too: each chunk of documents fetches what it needs, one value for each of its distinct runs
and words, and adds up the whole texts.  Words of the base score (add-one counts) go the same way.  Up to ``broadcast_runs`` distinct runs
in all, which is checked, the values of runs are broadcast instead; the results are the same.

Defined results: a null text is empty and has an end mark only; documents with a null id are learned from and not held
out; rows that repeat count and are scored one by one; without training documents each bit has probability one half and the
base score is zero; an empty table gives an empty table; other columns take no part.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import stash, text_or_empty

DEPTH = 4
CHUNK_BYTES = 1 << 23
#: 16 bytes each.
BROADCAST_RUNS = 1 << 20
#: Bytes that UTF-8 never has: before a text, and after it.
BEFORE, AFTER = 0xFE, 0xFF


def runs_of(data: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each text and its end mark, the byte below its context of ``depth`` bytes in one integer, and where the
    texts begin in that."""
    sizes = np.diff(offsets)
    starts = np.concatenate([[0], np.cumsum(sizes + depth + 1)])
    whole = np.full(starts[-1], BEFORE, np.uint8)
    whole[tokens.ranges(starts[:-1] + depth, sizes)] = data
    whole[starts[1:] - 1] = AFTER
    at = tokens.ranges(starts[:-1] + depth, sizes + 1)
    runs = np.zeros(len(at), np.int64)
    for k in range(depth + 1):
        runs |= whole[at - k].astype(np.int64) << (8 * k)
    return runs, np.concatenate([[0], np.cumsum(sizes + 1)])


def _runs_coded(data: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    runs, begins = runs_of(data, offsets, depth)
    return *coded(pa.array(runs)), begins


def coded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """For each value its place among the sorted distinct ones, and those."""
    got = values.dictionary_encode()
    order = pc.sort_indices(got.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    return rank[got.indices.to_numpy()], got.dictionary.take(order)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """For each word and each text's end (an empty word), its place in the sorted distinct words; those; where the texts begin."""
    starts, ends, at = tokens.word_spans(data, offsets)
    sizes = ends - starts
    text = data[tokens.ranges(starts, sizes)].tobytes()
    cuts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    places, distinct = coded(pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(cuts), pa.py_buffer(text)))
    per_text = np.diff(at) + 1
    begins = np.concatenate([[0], np.cumsum(per_text)])
    codes = np.zeros(begins[-1], np.int64)
    codes[tokens.ranges(begins[:-1], per_text - 1)] = places + 1
    return codes, pa.concat_arrays([pa.array([""], pa.large_string()), distinct]).cast(pa.string()), begins


def _lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = tokens.text_buffer(column)
    return tokens.LOWER[data], offsets


def _chunks(depth: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each chunk of documents: its number, ids, marks and packed texts, and its runs and words with how often training texts
    have them."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for i, j in tokens.chunks(tokens.text_buffer(batch.column(2))[1], most):
                part = batch.slice(i, j - i)
                data, offsets = _lowered(part.column(2))
                learned = ~part.column(1).to_numpy(zero_copy_only=False)
                lists = [part.column(0), part.column(1), pa.array(np.diff(offsets))]
                for values, distinct, begins in (_runs_coded(data, offsets, depth), words_of(data, offsets)):
                    lists += [distinct, pa.array(np.bincount(values[np.repeat(learned, np.diff(begins))], minlength=len(distinct)))]
                packed = pa.compress(data.tobytes(), "zstd", asbytes=True)
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([packed], pa.binary()), *map(_one_list, lists)], ["chunk", "texts", "ids", "held", "sizes", "runs", "run_counts", "words", "word_counts"])
                number += 1

    return deal


def _one_list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def log_gamma(z: Column) -> Column:
    """ln of the gamma function for z > 0: Stirling's series at z + 7."""
    y = z + 7.0
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    below = z * (z + 1) * (z + 2) * (z + 3) * (z + 4) * (z + 5) * (z + 6)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - F.log(below)


def _estimated(zeros: str = "zeros", ones: str = "ones") -> Column:
    """ln of the Krichevsky-Trofimov probability of so many zeros and ones."""
    a, b = F.col(zeros).cast("double"), F.col(ones).cast("double")
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1) - math.log(math.pi)


def _bits(runs: DataFrame, *columns: str) -> DataFrame:
    """A row for each of the eight choices of a run's last byte: context, node (1 and the bits before), bit."""
    byte = F.col("run").bitwiseAND(F.lit(255))
    each = [F.struct(((1 << j) + F.shiftright(byte, 8 - j)).cast("int").alias("node"), F.shiftright(byte, 7 - j).bitwiseAND(F.lit(1)).cast("int").alias("bit")) for j in range(8)]
    return runs.select("run", F.shiftright("run", 8).alias("context"), *columns, F.explode(F.array(*each)).alias("at")).select("run", "context", *columns, "at.node", "at.bit")


def tree(runs: DataFrame, depth: int) -> list[DataFrame]:
    """The nodes of each depth from (run, n): context, node, zeros, ones, and the share with which the node is a leaf."""
    bits = _bits(runs, "n").groupBy("context", "node").agg(F.sum(F.when(F.col("bit") == 0, F.col("n")).otherwise(0)).alias("zeros"), F.sum(F.when(F.col("bit") == 1, F.col("n")).otherwise(0)).alias("ones"))
    levels = [stash(bits.select("*", _estimated().alias("weighted"), F.lit(1.0).alias("leaf"), F.lit(0.0).alias("inner")))]
    for d in range(depth - 1, -1, -1):
        above = F.col("context").bitwiseAND(F.lit((1 << 8 * d) - 1))
        met = levels[-1].groupBy(above.alias("context"), "node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("below"))
        known = met.select("*", _estimated().alias("own"))
        # ln of the mean of both: the larger and what the smaller adds to it.
        both = F.greatest("own", "below") + F.log1p(F.exp(-F.abs(F.col("own") - F.col("below"))))
        share = F.exp(F.col("own") - F.col("both")), F.exp(F.col("below") - F.col("both"))
        levels.append(stash(known.withColumn("both", both).select("context", "node", "zeros", "ones", (F.col("both") - math.log(2)).alias("weighted"), share[0].alias("leaf"), share[1].alias("inner"))))
    return levels[::-1]


def log_probabilities(runs: DataFrame, depth: int) -> DataFrame:
    """(run, value): ln of the probability of the run's last byte after the others; ``runs``: run, n (zero if never learned).

    Joins are merges: a level's files are small for its rows, and the planner would broadcast it through the driver."""
    levels = tree(runs, depth)
    estimate = (F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1.0)
    path = levels[0].select("context", "node", (F.col("leaf") * estimate).alias("p"), F.col("inner").alias("rest"))
    for d in range(1, depth + 1):
        down = levels[d].select("context", "node", F.col("context").bitwiseAND(F.lit((1 << 8 * (d - 1)) - 1)).alias("above"), "leaf", "inner", estimate.alias("own"))
        path = stash(down.join(path.select(F.col("context").alias("above"), "node", "p", "rest").hint("merge"), ["above", "node"]).select("context", "node", (F.col("p") + F.col("rest") * F.col("leaf") * F.col("own")).alias("p"), (F.col("rest") * F.col("inner")).alias("rest")))
    chosen = F.log(F.when(F.col("bit") == 1, F.col("p")).otherwise(1 - F.col("p")))
    return _bits(runs).join(path.select("context", "node", "p").hint("merge"), ["context", "node"]).groupBy("run").agg(F.sum(chosen).alias("value"))


def _score(depth: int, learned: int, known_words: int, model) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """One chunk with the values of its runs (keys 0, 1, ... in order) and the counts of its words (-1, -2, ...), those left out that no other
    chunk has learned.  ``model``: broadcast runs in order and their values, or nothing."""

    def score(chunk: pa.Table, values: pa.Table) -> pa.Table:
        chunk = chunk.combine_chunks()
        ids, held, sizes = (chunk.column(c).chunk(0).flatten() for c in ("ids", "held", "sizes"))
        offsets = np.concatenate([[0], np.cumsum(sizes.to_numpy())]).astype(np.int64)
        packed = chunk.column("texts")[0].as_buffer()
        data = np.frombuffer(pa.decompress(packed, int(offsets[-1]), "zstd", asbytes=True), np.uint8) if offsets[-1] else np.zeros(0, np.uint8)
        n = len(ids)
        key, value = values.column("key").to_numpy(), values.column("value").to_numpy()
        run, word = key >= 0, key < 0
        codes, distinct, begins = _runs_coded(data, offsets, depth)
        size = np.diff(begins)
        if model is not None:
            log_p = model.value[1][np.searchsorted(model.value[0], distinct.to_numpy())]
        else:
            log_p = np.zeros(len(distinct))
            log_p[key[run]] = value[run]
        total = np.bincount(np.repeat(np.arange(n), size), log_p[codes], n)
        codes, distinct, begins = words_of(data, offsets)
        owner = np.repeat(np.arange(n), np.diff(begins))
        met = np.bincount(codes[~held.to_numpy(zero_copy_only=False)[owner]], minlength=len(distinct)).astype(float)
        met[-1 - key[word]] = value[word]
        count = met[codes]
        base = np.bincount(owner, np.log10((count + 1) / (learned + known_words + 1)), n)
        known = np.bincount(owner[count > 0], minlength=n)
        columns = [ids, held, pa.array(np.diff(begins)), pa.array(known), pa.array(np.full(n, learned, np.int64)), pa.array(base), pa.array(total / math.log(10)), pa.array(size - 1), pa.array(-total / math.log(2) / size)]
        return pa.Table.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte"])

    return score


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def scores(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", held: Column | None = None, depth: int = DEPTH, chunk_bytes: int = CHUNK_BYTES, broadcast_runs: int = BROADCAST_RUNS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the
    text's probability), n_bytes, bits_per_byte (code length, the end mark counted as a byte); texts count in lower case (A-Z).
    ``depth`` is from 1 to 6."""
    kind = dict(docs.dtypes)[doc_id]
    lean = docs.select(F.col(doc_id).alias("id"), (held_out(F.col(doc_id)) if held is None else held).alias("held"), text_or_empty(text).alias("t"))
    chunks = stash(lean.mapInArrow(_chunks(depth, chunk_bytes), f"chunk bigint, texts binary, ids array<{kind}>, held array<boolean>, sizes array<bigint>, runs array<bigint>, run_counts array<bigint>, words array<string>, word_counts array<bigint>"))
    listed = lambda values, counts: chunks.select("chunk", F.posexplode(F.arrays_zip(values, counts)).alias("at", "p")).select("chunk", "at", f"p.{values}", F.col(f"p.{counts}").alias("n"))
    runs = listed("runs", "run_counts").withColumnRenamed("runs", "run")
    totals = stash(runs.groupBy("run").agg(F.sum("n").alias("n")))
    known, model = log_probabilities(totals, depth), None
    if totals.count() <= broadcast_runs:
        small = known.toArrow().sort_by("run")
        model = docs.sparkSession.sparkContext.broadcast((small.column("run").to_numpy(), small.column("value").to_numpy()))
    # A word has one row a chunk, however often it occurs.
    counted = stash(listed("words", "word_counts").selectExpr("chunk", "at", "n", "sum(n) over (partition by words) as c", "row_number() over (partition by words order by chunk) = 1 as first"))
    learned, distinct = counted.where("first and c > 0").agg(F.sum("c"), F.count("*")).collect()[0]
    elsewhere = counted.where("c <> n").select("chunk", -1 - F.col("at"), F.col("c").cast("double"))
    values = elsewhere if model else elsewhere.union(runs.join(known.hint("merge"), "run").select("chunk", "at", "value"))
    values = values.toDF("of", "key", "value")
    rows = chunks.select("chunk", "texts", "ids", "held", "sizes")
    return rows.groupBy("chunk").cogroup(values.groupBy("of")).applyInArrow(_score(depth, learned or 0, distinct or 0, model), f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, n_bytes bigint, bits_per_byte double")
