"""Best-fit packing into several permitted sequence lengths.

Every document is cut into pieces of at most the longest permitted length.  Pieces are dealt by a hash of document id, text,
piece and place among equal rows to as many shards as the number of pieces asks for, and each shard is packed by itself: only (id, piece, length)
rows travel, the shard count grows with the table, and no shard holds more than a fixed number of pieces on average.

Within a shard, pieces go in decreasing order into the open bin that they fill best.  Where none has room, a bin is
opened whose length has the least cost for each token it can be expected to hold: what is left in the shard bounds
how full a long bin can get.  At the end each bin is cut down to the shortest permitted length that holds its contents.

Defined results: a null or empty text has one piece of one token (its end mark); an empty table gives an empty table;
rows that repeat a document id are packed one by one under that id; rows of one id or of none lie in many shards, and so do rows that
are equal in all.  Other columns do not take part.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, stash, text_or_empty

CAPACITIES = (512, 1024, 2048, 4096)
PIECES_PER_SHARD = 20_000
#: Equal rows travel as one with a count, and are told apart again in blocks of so many.
COPIES = 1000


def attention_cost(capacity: int) -> float:
    """Relative cost of one training sequence: linear layers plus attention, and a fixed share for each sequence."""
    return 64.0 + capacity + capacity * capacity / 8192.0


def token_count(text: str = "text") -> Column:
    """Words and one end mark."""
    return F.regexp_count(text_or_empty(text), F.lit(WORD)) + 1


def pack_lengths(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES, cost: Callable[[int], float] = attention_cost) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each length (given in decreasing order) and the final capacity of each bin."""
    sizes = sorted(capacities)
    left = sum(lengths)
    room: list[int] = []  # distinct amounts of room among open bins, ascending
    open_bins: dict[int, list[int]] = {}  # room -> open bins with it, oldest first
    used: list[int] = []
    held: list[int] = []
    where, offset = [], []
    for n in lengths:
        k = bisect_left(room, n)
        if k < len(room):
            r = room[k]
            b = heapq.heappop(open_bins[r])
            if not open_bins[r]:
                del open_bins[r]
                room.pop(k)
        else:
            fits = sizes[bisect_left(sizes, n) :]
            c = min(fits, key=lambda c: (cost(c) / min(c, left), c))
            b, r = len(used), c
            used.append(0)
            held.append(c)
        where.append(b)
        offset.append(used[b])
        used[b] += n
        left -= n
        if r - n:
            if r - n not in open_bins:
                insort(room, r - n)
                open_bins[r - n] = []
            heapq.heappush(open_bins[r - n], b)
    return where, offset, [sizes[bisect_left(sizes, u)] for u in used]


def _pack_shard(capacities: Sequence[int], cost: Callable[[int], float]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "item", "piece"], ascending=[False, True, True], kind="stable")
        where, offset, final = pack_lengths(rows["length"].tolist(), capacities, cost)
        return pd.DataFrame({"item": rows["item"].to_numpy(), "piece": rows["piece"].to_numpy(), "length": rows["length"].to_numpy(), "shard": rows["shard"].to_numpy(), "bin": where, "bin_offset": offset, "capacity": [final[b] for b in where]})

    return pack


def pack(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: Column | None = None, capacities: Sequence[int] = CAPACITIES, cost: Callable[[int], float] = attention_cost, pieces_per_shard: int = PIECES_PER_SHARD) -> DataFrame:
    """One row for each piece: doc_id, piece, start (first token of the piece in its document), n_tokens, shard, bin,
    bin_offset, capacity.  (shard, bin) names a bin."""
    most = max(capacities)
    n = (token_count(text) if length is None else length).cast("bigint")
    kind = dict(docs.dtypes)[doc_id]
    salt = F.xxhash64(doc_id, *((text,) if text in docs.columns else ()))
    rows = docs.select(F.col(doc_id).cast("string").alias("item"), salt.alias("salt"), F.greatest(F.coalesce(n, F.lit(1)), F.lit(1)).alias("n"))
    items = stash(rows.groupBy("item", "salt", "n").agg(F.count("*").alias("copies")))
    total = items.agg(F.sum(F.ceil(F.col("n") / most) * F.col("copies")).alias("p")).collect()[0]["p"] or 0
    shards = max(1, -(-int(total) // pieces_per_shard))
    blocks = items.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("copies") / COPIES) - 1)).alias("block")).repartition("item", "salt", "n", "block")
    last = F.least(F.lit(COPIES), F.col("copies") - F.col("block") * COPIES) - 1
    items = blocks.select("item", "salt", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("copy"), "block").select("item", "n", F.xxhash64("salt", "block", "copy").alias("salt"))
    pieces = items.select("item", "salt", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("n") / most) - 1)).alias("piece")).select(
        "item", "piece", F.least(F.lit(most).cast("bigint"), F.col("n") - F.col("piece") * most).alias("length"), F.pmod(F.xxhash64("salt", "piece"), F.lit(shards)).alias("shard")
    )
    packed = pieces.groupBy("shard").applyInPandas(_pack_shard(tuple(capacities), cost), "item string, piece bigint, length bigint, shard bigint, bin bigint, bin_offset bigint, capacity bigint")
    return packed.select(F.col("item").cast(kind).alias("doc_id"), "piece", (F.col("piece") * most).alias("start"), F.col("length").alias("n_tokens"), "shard", "bin", "bin_offset", "capacity")
