"""Hard negatives by a secondary sort: scores in windows below those of an anchor's positives.

Vectors are whole numbers (``scale`` times the component, rounded down) and a score is their inner product.  Rows are packed
into blocks, and every block meets every block of anchors in an equi-join on the block's number: matrix products, no row a pair.

First the products give each anchor's positives: the best of each block go on, and the best of those are the anchor's.
Then every block hands on, of each positive's window, the rows that could be among its first few: as many a block as are
asked for in all.  These pair scores are packed into keys (anchor, descending score, id), dealt by anchor and sorted within
partitions, which is ``repartitionAndSortWithinPartitions`` of a DataFrame; a streaming iterator opens a window where a
positive comes by, emits the negatives that fall into open windows, and forgets all with the last row of an anchor.

Defined results: rows with a null id, label or vector, or with a null or non-finite component, take no part; a row is no
partner of an anchor with its own id; rows that repeat count one by one, and so do anchors; vectors of unlike lengths are
filled up with zeros; scores beyond 2**56 count as 2**56 (either sign); ties go by id, the least first; positives with a score below zero
have an empty window; an empty table gives an empty table; other columns take no part.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
#: Window of negatives in hundredths of the positive's score.
LOW, HIGH = 50, 95
ROWS = 2048
ANCHORS = 1024
MOST = 1 << 56

PACKED = "ids binary, labels binary, width int, codes binary, wide boolean"


def _pack(ids: np.ndarray, labels: np.ndarray, vectors: pa.ListArray, scale: int) -> list:
    """One block: ids, labels and the matrix of whole numbers, in the order of ids."""
    order = np.lexsort((labels, ids))
    sizes = np.diff(vectors.offsets.to_numpy())
    width = int(sizes.max(initial=0))
    whole = np.zeros((len(ids), width))
    at = np.repeat(np.arange(len(ids)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    with np.errstate(over="ignore"):
        whole[at] = np.nan_to_num(np.floor(vectors.flatten().to_numpy().astype(float) * scale))
    wide = bool(np.abs(whole).max(initial=0) > 32767)
    return [ids[order].tobytes(), labels[order].tobytes(), width, whole[order].astype(float if wide else np.int16).tobytes(), wide]


def _row(values: list, names: str) -> pa.RecordBatch:
    kinds = {"binary": pa.binary(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}
    parts = [p.split() for p in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], kinds[k]) for v, (_, k) in zip(values, parts, strict=True)], [n for n, _ in parts])


def _row_blocks(scale: int, rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                part = batch.slice(i, rows)
                yield _row(_pack(part.column(0).to_numpy(), part.column(1).to_numpy(), part.column(2), scale), PACKED)

    return pack


def _anchor_block(scale: int) -> Callable[[pa.Table], pa.Table]:
    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        vectors = rows.column("vector").combine_chunks()
        vectors = vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors
        packed = _pack(rows.column("id").to_numpy(), rows.column("label").to_numpy(), vectors, scale)
        return pa.Table.from_batches([_row([rows.column("block")[0].as_py(), *packed], "block bigint, " + PACKED)])

    return pack


def _unpack(batch: pa.RecordBatch, k: int, names: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels, width, codes, wide = (batch.column(batch.schema.get_field_index(names + c))[k].as_py() for c in ("ids", "labels", "width", "codes", "wide"))
    ids = np.frombuffer(ids, np.int64)
    return ids, np.frombuffer(labels, np.int64), np.frombuffer(codes, float if wide else np.int16).reshape(len(ids), width)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices of whole numbers, exact, and kept within 2**56."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width].astype(float), b[:, :width].astype(float)
    if not width:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * width < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    exact = whole(a).dot(whole(b).T)  # integers of any size; only where components are huge
    return np.clip(exact, -MOST, MOST).astype(np.int64)


def _firsts(scores: np.ndarray, fit: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``most`` best fitting scores of each row; ties to the first column."""
    none = np.iinfo(np.int64).min
    left = np.where(fit, scores, none)
    rows, columns = [], []
    for _ in range(most):
        best = left.argmax(1)
        at = np.flatnonzero(left[np.arange(len(left)), best] != none)
        if not len(at):
            break
        rows.append(at)
        columns.append(best[at])
        left[at, best[at]] = none
    return (np.concatenate(rows), np.concatenate(columns)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _positives(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, labels, codes = _unpack(batch, k, "")
                own, marks, wanted = _unpack(batch, k, "a_")
                scores = products(wanted, codes)
                i, j = _firsts(scores, (marks[:, None] == labels[None, :]) & (own[:, None] != ids[None, :]), most)
                block = np.full(len(i), batch.column(batch.schema.get_field_index("block"))[k].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(i), pa.array(own[i]), pa.array(ids[j]), pa.array(scores[i, j])], ["block", "place", "anchor", "id", "score"])

    return find


def window(score: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest negative score with low * score <= 100 * negative <= high * score."""
    return -(-low * score // 100), high * score // 100


def _negatives(most: int, low: int, high: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, labels, codes = _unpack(batch, k, "")
                own, marks, wanted = _unpack(batch, k, "a_")
                held = batch.column(batch.schema.get_field_index("opened")).slice(k, 1).flatten()
                place, rank, score = (held.field(c).to_numpy() for c in range(3))
                scores = products(wanted, codes)
                other = marks[:, None] != labels[None, :]
                kept = [np.zeros(0, np.int64)]
                for r in np.unique(rank):  # each anchor has one positive of a rank
                    at = place[rank == r]
                    least, greatest = window(score[rank == r], low, high)
                    part = scores[at]
                    i, j = _firsts(part, other[at] & (part >= least[:, None]) & (part <= greatest[:, None]), most)
                    kept.append(at[i].astype(np.int64) * len(ids) + j)
                i, j = np.divmod(np.unique(np.concatenate(kept)), max(1, len(ids)))
                block = np.full(len(i), batch.column(batch.schema.get_field_index("block"))[k].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(i), pa.array(own[i]), pa.array(ids[j]), pa.array(scores[i, j]), pa.array(np.zeros(len(i), bool))], ["block", "place", "anchor", "id", "score", "positive"])

    return find


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pair scores packed into keys whose byte order is anchor, descending score, id."""
    for batch in batches:
        block, place, anchor, id_, score = (batch.column(c).to_numpy() for c in range(5))
        key = np.stack([block.astype(np.uint64), place.astype(np.uint64), (MOST - score).astype(np.uint64), id_.astype(np.uint64) ^ np.uint64(1 << 63)], axis=1).astype(">u8")
        packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(key), [None, pa.py_buffer(key.tobytes())]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed, batch.column(2), batch.column(5)], ["block", "place", "key", "anchor", "positive"])


def _windows(most: int, low: int, high: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Walk the sorted keys.  What is held: the windows of one anchor, and its first negatives with a score of zero, which may
    come before a positive with that score."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, opened, zeros = None, [], []
        for batch in batches:
            out: list[tuple] = []
            for key, anchor, positive in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True):
                if key[:16] != last:
                    last, opened, zeros = key[:16], [], []
                down, lifted = struct.unpack(">QQ", key[16:])
                score, id_ = MOST - down, lifted - (1 << 63)
                if positive:
                    taken = [id_, score, 0, -(-low * score // 100), high * score // 100]
                    opened.append(taken)
                    early = zeros if score == 0 else []
                    for z in early:
                        taken[2] += 1
                        out.append((anchor, id_, taken[2], z, score, 0))
                    continue
                if score == 0 and len(zeros) < most:
                    zeros.append(id_)
                for taken in opened:
                    if taken[2] < most and taken[3] <= score <= taken[4]:
                        taken[2] += 1
                        out.append((anchor, taken[0], taken[2], id_, taken[1], score))
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 2 else pa.int64()) for k, c in enumerate(columns)], ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    return walk


def mine(vectors: DataFrame, anchors: Column, *, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, rows: int = ROWS, anchor_rows: int = ANCHORS) -> DataFrame:
    """For each row where ``anchors`` holds and each of its ``positives`` best partners of the same label, the first
    ``negatives`` rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score:
    anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    fit = vectors.where(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & finite)
    values = F.col(vec_id).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), F.col(vector).cast("array<double>").alias("vector")
    blocks = fit.select(*values).mapInArrow(_row_blocks(scale, rows), PACKED)
    asked = stash(fit.where(anchors).select(*values))
    count = max(1, -(-asked.count() // anchor_rows))
    dealt = asked.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(count)))
    packed = stash(dealt.groupBy("block").applyInArrow(_anchor_block(scale), "block bigint, " + PACKED))
    sides = packed.select("block", *(F.col(c).alias("a_" + c) for c in ("ids", "labels", "width", "codes", "wide")))
    spread = blocks.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(count - 1).cast("bigint"))))
    best = spread.join(sides, "block").mapInArrow(_positives(positives), "block bigint, place bigint, anchor bigint, id bigint, score bigint")
    opened = stash(best.selectExpr("*", "row_number() over (partition by block, place order by score desc, id) as rank").where(F.col("rank") <= positives))
    windows = opened.groupBy("block").agg(F.collect_list(F.struct("place", "rank", "score")).alias("opened"))
    below = spread.join(sides.join(windows, "block"), "block").mapInArrow(_negatives(negatives, low, high), "block bigint, place bigint, anchor bigint, id bigint, score bigint, positive boolean")
    pairs = opened.select("block", "place", "anchor", "id", "score", F.lit(True).alias("positive")).union(below)
    keyed = pairs.mapInArrow(_keyed, "block bigint, place bigint, key binary, anchor bigint, positive boolean")
    ordered = keyed.repartition("block", "place").sortWithinPartitions("key")
    return ordered.mapInArrow(_windows(negatives, low, high), "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
