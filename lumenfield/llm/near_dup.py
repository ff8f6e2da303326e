"""Near-duplicate classes by Order MinHash.

A sketch keeps, of all occurrence-labelled five-word shingles of a text, the two that a random order ranks lowest, in
the order in which they stand in the text.  Two texts have a sketch in common with a probability that falls with their
edit distance: shared shingles alone do not do, they must come as often and in the same order.  Eighty sketches are
taken, and of texts of up to eighty words, in which few five-word shingles outlive an edit, 24 more of two-word shingles.
Texts that share any sketch are candidates; those that align word by word within a band with an edit similarity of 0.8 or
more are linked.  Classes are the components of the links.

Scale: equal texts collapse to one representative first, so a text with a million copies is one node.  The members of a
bucket (texts with one sketch in common) are first held against one of them, its center, the same one in all buckets where
it is: a row for each member.  A center has then met all others and leaves.  The rest of all buckets with one center is one
group, in which a member is one row, however many of its sketches led there.  A group that is not known to be
of one class goes on to tasks that hold it in blocks of at most ``BLOCK`` members and look at the pairs of two classes that
fit in length and are not told apart by the triangle inequality (one matches the center, the other is too far from it to
match any text that does).  A lower bound on the edit distance, from counts of hashed words, turns pairs down there.  Of what
it leaves, a block gives in two rounds only the pairs of a forest, as if all of them matched: a row for each member at most.
Members that match become one class, and after the rounds (one, if few match) all pairs of two classes
that are still open are aligned, each once.  No
bucket is cut and no pair of two classes that share a sketch is left out.  What is quadratic are the comparisons of counts
within a group of texts that share a passage and little else, some 20 ns a pair.  Texts and counts are shuffled only where
a bitmap of the ids that are asked for has them.

Recall: the sketches are the one place where links are lost, see the README for figures by edit similarity.

Defined results: words are runs without ASCII white space, without regard to ASCII case; a null or empty text has no
words, and all texts without words are one class; a text of fewer than five words is one shingle; rows that share a
doc_id count as one document; a row without doc_id gets a null class; an empty table gives an empty table; other columns pass
through ``keep_one`` untouched.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tokens
from .common import free_name, likely_among, stash, text_or_empty
from .components import components

SHINGLE = 5
SKETCHES = 80
SHORT_SHINGLE = 2
SHORT_SKETCHES = 24
SHORT_WORDS = 80
BLOCK = 4096
FOREST_ROUNDS = 2
FOREST_GAIN = 0.25
SIMILARITY = 0.8
COUNTS = 256
MOST_COUNTS = 8192
COARSE = 32


def shingle_hashes(words: np.ndarray, at: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of each text in text order and where each text's begin; a short text is one shingle."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    counts = np.diff(at)
    end = np.repeat(at[1:], counts)
    place = np.arange(n)
    total = np.zeros(n, np.uint64)
    odd = tokens.mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    for j in range(size):
        inside = place + j < end
        total[: n - j] += np.where(inside[: n - j], words[j:] * odd[j], np.uint64(0))
    keep = (place + size <= end) | (place == np.repeat(at[:-1], counts))
    return tokens.mix(total[keep]), np.concatenate([[0], np.cumsum(keep)])[at]


def label_occurrences(shingles: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Tell the first, second ... occurrence of a shingle in a text apart."""
    n = len(shingles)
    if not n:
        return shingles
    own = shingles ^ tokens.mix(np.repeat(np.arange(1, len(at), dtype=np.uint64), np.diff(at)))
    order = np.argsort(own, kind="stable")
    by = own[order]
    fresh = np.concatenate([[True], by[1:] != by[:-1]])
    if fresh.all():
        return shingles
    first = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n, np.uint64)
    rank[order] = (np.arange(n) - first).astype(np.uint64)
    return tokens.mix(shingles + rank * np.uint64(0xD1342543DE82EF95))


def order_sketches(labelled: np.ndarray, at: np.ndarray, sketches: int = SKETCHES) -> np.ndarray:
    """One row of sketches for each text; texts without shingles must not be among them."""
    counts, starts = np.diff(at), at[:-1]
    out = np.empty((len(counts), sketches), np.uint64)
    seeds = tokens.mix(np.arange(101, 101 + 2 * sketches, dtype=np.uint64))
    top = np.uint64(2**64 - 1)
    low = np.uint64((1 << max(22, len(labelled).bit_length())) - 1)
    place = np.arange(len(labelled), dtype=np.uint64)
    for k in range(sketches):
        # The rank of each shingle, and in the low bits its place: the least value tells where it is.
        x = (labelled ^ seeds[2 * k]) * (seeds[2 * k + 1] | np.uint64(1))
        x = (x & ~low) | place
        one = (np.minimum.reduceat(x, starts) & low).astype(np.int64)
        x[one] = top
        two = np.where(counts > 1, np.minimum.reduceat(x, starts) & low, one.astype(np.uint64)).astype(np.int64)
        out[:, k] = tokens.mix(labelled[np.minimum(one, two)] + np.uint64(3) * tokens.mix(labelled[np.maximum(one, two)] + np.uint64(k)))
    return out


def widths(n: np.ndarray) -> np.ndarray:
    """How many counts a text of ``n`` words has: a power of two, from 256 up to half the words or more, at most 8192."""
    half = np.ceil(np.log2(np.maximum(n, 2) / 2)).astype(np.int64)
    return 1 << np.clip(half, COUNTS.bit_length() - 1, MOST_COUNTS.bit_length() - 1)


def word_counts(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text how many of its words fall to each value of the high bits of a hash, and where the counts of each
    text begin; counts above 255 are 255."""
    n = np.diff(at)
    width = widths(n)
    begin = np.concatenate([[0], np.cumsum(width)])
    shift = (64 - np.log2(width).astype(np.int64)).astype(np.uint64)
    cell = np.repeat(begin[:-1], n) + (tokens.mix(words) >> np.repeat(shift, n)).astype(np.int64)
    return np.minimum(np.bincount(cell, minlength=int(begin[-1])), 255).astype(np.uint8), begin


def folded(counts: np.ndarray, width: int) -> np.ndarray:
    """Rows of counts with neighbours added up to ``width`` of them."""
    return counts.reshape(len(counts), width, -1).sum(2, dtype=np.int16)


def sketch_lists(words: np.ndarray, at: np.ndarray) -> pa.ListArray:
    """All sketches of each text."""
    counts = np.diff(at)
    sizes, parts = np.zeros(len(counts), np.int64), []
    for size, sketches, some in ((SHINGLE, SKETCHES, counts > 0), (SHORT_SHINGLE, SHORT_SKETCHES, (counts > 0) & (counts <= SHORT_WORDS))):
        if not some.any():
            continue
        begin = np.concatenate([[0], np.cumsum(counts[some])])
        shingles, edges = shingle_hashes(words[tokens.ranges(at[:-1][some], counts[some])], begin, size)
        parts.append((some, sizes[some], order_sketches(label_occurrences(shingles, edges), edges, sketches) ^ tokens.mix(np.array([size], np.uint64))))
        sizes[some] += sketches
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(int(offsets[-1]), np.uint64)
    for some, before, rows in parts:
        out[tokens.ranges(offsets[:-1][some] + before, np.full(len(rows), rows.shape[1]))] = rows.reshape(-1)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(out.view(np.int64)))


def whole_hashes(words: np.ndarray, at: np.ndarray, base: int) -> np.ndarray:
    """A hash of the sequence of words of each text."""
    if not len(words):
        return np.zeros(len(at) - 1, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * tokens.powers(base, len(words)))])
    return tokens.mix((sums[at[1:]] - sums[at[:-1]]) * tokens.powers(pow(base, -1, 1 << 64), len(words) + 1)[at[:-1]])


def _marks(lists: pa.ListArray) -> pa.Array:
    at = lists.offsets.to_numpy() * 4
    low = lists.values.to_numpy().view(np.uint64).astype(np.uint32)
    return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(low)])


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = tokens.text_buffer(batch.column(1))
        for i, j in tokens.chunks(offsets):
            words, at = tokens.word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            one = whole_hashes(words, at, int(tokens.BASE))
            two = whole_hashes(tokens.mix(words), at, 0xA24BAED4963EE407)
            lists = sketch_lists(words, at)
            counts, edges = word_counts(words, at)
            bags = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(counts)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), pa.array(np.diff(at), pa.int64()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), lists, bags, _marks(lists)],
                ["id", "n", "one", "two", "sketches", "bag", "marks"],
            )


def sketch(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n (words), one and two (a 128-bit hash of the words), sketches (empty for a text without words), bag
    (``word_counts``), marks (the low 32 bits of the sketches)."""
    lean = docs.select(F.col(doc_id).alias("id"), text_or_empty(text).alias("t"))
    return lean.mapInArrow(_sketch, f"id {dict(lean.dtypes)['id']}, n bigint, one bigint, two bigint, sketches array<bigint>, bag binary, marks binary")


# --- alignment -------------------------------------------------------------------------------------------------------


def within_band(a: np.ndarray, b: np.ndarray, most: int) -> bool:
    """Whether the edit distance of two sequences of word hashes is at most ``most``.

    The band of cells at most that far from the diagonal is worked out column by column with bit vectors (one bit for each row
    of the band, Hyyro's form of the algorithm of Myers), after a common head and tail and a bound from counts of words.
    """
    if abs(len(a) - len(b)) > most:
        return False
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b, n = a[head:], b[head:], n - head
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(differ[0]) if len(differ) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if len(a) < len(b):
        a, b = b, a
    if len(a) <= most:
        return True
    if not len(b) or bag_distance(a, b) > most:  # that many words have no partner
        return False
    which = np.unique(np.concatenate([a, b]), return_inverse=True)[1].tolist()
    rows, columns = which[: len(a)], which[len(a) :]
    places: dict[int, int] = {}
    for i, w in enumerate(rows):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << 2 * most + 1) - 1
    up, down = full ^ ((1 << most) - 1), 0  # where a cell is one more, one less than the cell above it
    lowest, bit = 1 << 2 * most, 1 << 2 * most
    edits, turn = most, len(rows) - most  # of the lowest cell of the band; from ``turn`` on, of the last row
    worst = most + len(columns) - turn
    for j, w in enumerate(columns):
        match = places.get(w, 0)
        match = (match >> j - most if j > most else match << most - j) & full
        same = ((((match & up) + up) ^ up) | match | down) & full  # no more than the cell before it in the diagonal
        plus, minus = down | full & ~(same | up), same & up
        if j < turn:
            edits += not same & lowest
        else:
            bit >>= 1
            edits += bool(plus & bit) - bool(minus & bit)
        if edits > worst:
            return False
        after = same >> 1
        up, down = minus | full & ~(after | plus), after & plus
    return edits <= most


def chained_distance(a: np.ndarray, b: np.ndarray) -> int:
    """An upper bound on the edit distance: match the three-word windows that both have once, in a longest run of places
    that ascend in both, and edit all that lies between."""
    la, lb = len(a), len(b)
    if la < 3 or lb < 3:
        return max(la, lb)
    odd = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
    once = []
    for w in (a, b):
        value, place, times = np.unique(w[:-2] * odd[0] + w[1:-1] * odd[1] + w[2:] * odd[2], return_index=True, return_counts=True)
        once.append((value[times == 1], place[times == 1]))
    (va, pa_), (vb, pb) = once
    _, ia, ib = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
    if not len(ia):
        return max(la, lb)
    order = np.argsort(pa_[ia])
    x, y = pa_[ia][order], pb[ib][order]
    if (y[1:] < y[:-1]).any():
        keep = _ascending(y)
        x, y = x[keep], y[keep]
    gx, gy = x[1:] - x[:-1] - 1, y[1:] - y[:-1] - 1
    both = np.minimum(gx, gy) >= 2  # the two words after a matched window's first agree too
    between = np.maximum(gx, gy) - 2 * both
    return int(between.sum() + max(x[0], y[0]) + max(la - x[-1], lb - y[-1]) - 3)


def _ascending(values: np.ndarray) -> np.ndarray:
    """Indices of a longest ascending run of values, not necessarily neighbours."""
    tails: list[int] = []
    ends: list[int] = []
    back = np.full(len(values), -1)
    for i, v in enumerate(values.tolist()):
        k = bisect_left(tails, v)
        back[i] = ends[k - 1] if k else -1
        tails[k : k + 1] = [v]
        ends[k : k + 1] = [i]
    out, i = [], ends[-1]
    while i >= 0:
        out.append(i)
        i = back[i]
    return np.array(out[::-1])


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether 1 - edit distance / longer length, over words, is at least ``similarity``."""
    longer = max(len(a), len(b))
    most = int(np.floor((1 - similarity) * longer + 1e-9))
    if abs(len(a) - len(b)) > most:
        return False
    return chained_distance(a, b) <= most or within_band(a, b, most)


def too_far(bound: np.ndarray | int, one: np.ndarray | int, two: np.ndarray | int, similarity: float = SIMILARITY) -> np.ndarray:
    """Whether texts of ``one`` and ``two`` words, at an edit distance of ``bound`` or more, have no match in common.

    A common match has at most the lesser number of words over ``similarity``; its distances to both must add up to the
    distance between them at least.
    """
    longest = np.minimum(one, two) / similarity
    return bound > (1 - similarity) * (np.maximum(one, longest) + np.maximum(two, longest)) + 1e-6


def bag_distance(a: np.ndarray, b: np.ndarray) -> int:
    """A lower bound on the edit distance: the words of the longer text that have no partner in the other."""
    values, which = np.unique(np.concatenate([a, b]), return_inverse=True)
    shared = np.minimum(np.bincount(which[: len(a)], minlength=len(values)), np.bincount(which[len(a) :], minlength=len(values))).sum()
    return int(max(len(a), len(b)) - shared)


def _aligner(similarity: float):
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, near = np.zeros(batch.num_rows, bool), np.zeros(batch.num_rows, bool)
            one, two = (tokens.text_buffer(batch.column(k)) for k in (2, 3))
            last, a = None, np.zeros(0, np.uint64)
            for r in range(batch.num_rows):
                (d, o), (e, p) = one, two
                raw = d[o[r] : o[r + 1]].tobytes()
                if raw != last:  # rows come by center
                    last, a = raw, tokens.word_hashes(d[o[r] : o[r + 1]], np.array([0, o[r + 1] - o[r]]))[0]
                b = tokens.word_hashes(e[p[r] : p[r + 1]], np.array([0, p[r + 1] - p[r]]))[0]
                good[r] = similar(a, b, similarity)
                near[r] = not good[r] and not too_far(bag_distance(a, b), len(a), len(b), similarity)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(good), pa.array(near)], ["center", "member", "good", "near"])

    return align


def align(pairs: DataFrame, texts: DataFrame, *, similarity: float) -> DataFrame:
    """``pairs`` (center, member) with ``good``: whether their ``texts`` (id, t) align within the band, and ``near``: whether
    a text that matches one could match the other although they do not match.  The text of a member travels once for each
    of its pairs, that of a center once for all of them."""
    both = pairs.join(texts.withColumnsRenamed({"id": "member", "t": "b"}), "member").join(texts.withColumnsRenamed({"id": "center", "t": "a"}), "center")
    kind = dict(pairs.dtypes)["center"]
    return both.select("center", "member", "a", "b").mapInArrow(_aligner(similarity), f"center {kind}, member {kind}, good boolean, near boolean")


# --- candidates ------------------------------------------------------------------------------------------------------


class Bags:
    """Counts of words of many texts, folded to what two of them have in common."""

    def __init__(self, column: pa.Array):
        data, at = tokens.text_buffer(column)
        self.width = np.diff(at)
        self.base = np.zeros((len(self.width), COUNTS), np.int16)
        self.levels: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        wider = {}
        for w in np.unique(self.width).tolist():
            rows = np.flatnonzero(self.width == w)
            counts = data[tokens.ranges(at[:-1][rows], np.full(len(rows), w))].reshape(-1, w)
            self.base[rows] = folded(counts, COUNTS)
            wider[w] = rows, counts
        for w in wider:
            if w > COUNTS:
                parts = [wider[w], *((wider[2 * w],) if 2 * w in wider else ())]
                place = np.zeros(len(self.width), np.int64)
                rows = np.concatenate([r for r, _ in parts])
                place[rows] = np.arange(len(rows))
                self.levels[w] = place, np.concatenate([folded(c, w) for _, c in parts])

    def apart(self, x: np.ndarray, other: Bags, y: np.ndarray) -> np.ndarray:
        """Twice a lower bound on the edit distance, less the difference in length, for pairs of rows that fit in length."""
        out = np.zeros(len(x), np.int64)
        level = np.minimum(self.width[x], other.width[y])
        for w in np.unique(level).tolist():
            own = np.flatnonzero(level == w)
            mine, theirs = (b.levels.get(w, (np.arange(len(b.base)), b.base)) for b in (self, other))
            for k in range(0, len(own), max(1, (1 << 21) // w)):
                part = own[k : k + max(1, (1 << 21) // w)]
                out[part] = np.abs(mine[1][mine[0][x[part]]] - theirs[1][theirs[0][y[part]]]).sum(1, dtype=np.int64)
        return out


def _screener(similarity: float):
    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bags = Bags(batch.column(3)), Bags(batch.column(4))
            one, two = (batch.column(k).to_numpy() for k in (5, 6))
            more = bags[0].base - bags[1].base
            bound = np.maximum(np.maximum(more, 0).sum(1), np.maximum(-more, 0).sum(1))
            most = np.floor((1 - similarity) * np.maximum(one, two) + 1e-9)
            fine = np.flatnonzero((bound <= most) & (np.abs(one - two) <= most))
            bound[fine] = (bags[0].apart(fine, bags[1], fine) + np.abs(one - two)[fine] + 1) // 2
            likely = bound <= most
            near = ~likely & ~too_far(bound, one, two, similarity)
            columns = [*batch.columns[:3], pa.array(likely), pa.array(near)]
            yield pa.RecordBatch.from_arrays(columns, ["turn", "center", "member", "likely", "near"]).filter(pa.array(likely | near))

    return screen


def screen(pairs: DataFrame, keys: DataFrame, *, similarity: float) -> DataFrame:
    """``pairs`` (turn, member; they may repeat) of a text and the center of the hash ``turn`` that are ``likely`` to match, or else
    ``near`` (see ``align``), with the center; the others go.  A member fetches its counts once for all of its centers."""
    member = keys.select(F.col("id").alias("member"), F.col("n").alias("nm"), F.col("bag").alias("bm"))
    center = keys.select("turn", F.col("id").alias("center"), F.col("bag").alias("bc"), F.col("n").alias("nc"))
    kind = dict(keys.dtypes)["id"]
    least = F.least("nm", "nc") / similarity
    reach = (1 - similarity) * (F.greatest(F.col("nm"), least) + F.greatest(F.col("nc"), least)) + 1e-6  # as in ``too_far``
    told = pairs.groupBy("member").agg(F.collect_set("turn").alias("turns")).join(member, "member").select("member", "nm", "bm", F.explode("turns").alias("turn"))
    both = told.join(center, "turn").where(F.abs(F.col("nm") - F.col("nc")) <= reach).select("turn", "center", "member", "bc", "bm", "nc", "nm")
    return both.mapInArrow(_screener(similarity), f"turn bigint, center {kind}, member {kind}, likely boolean, near boolean")


def close_pairs(n_one: np.ndarray, one: Bags, n_two: np.ndarray, two: Bags, open_: Callable[[slice, slice], np.ndarray], similarity: float = SIMILARITY) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of the pairs of two lists of texts, each in order of their numbers of words ``n``, that fit in length, that
    ``open_`` lets through, and that the counts of words do not tell apart: 32 of them, then 256, then all.  Rows of the first
    list come a few at a time, and ``open_`` is asked again for each."""
    coarse = [folded(x.base, COARSE).T.astype(np.int32).copy() for x in (one, two)]
    for i in range(0, len(n_one), 64):
        rows = slice(i, min(i + 64, len(n_one)))
        low = np.searchsorted(n_two, np.ceil(similarity * n_one[i] - 1e-6))
        high = np.searchsorted(n_two, np.floor(n_one[rows.stop - 1] / similarity + 1e-6), "right")
        for j in range(int(low), int(high), 2048):
            columns = slice(j, min(j + 2048, int(high)))
            ok = open_(rows, columns)
            if not ok.any():
                continue
            a, b = n_one[rows, None], n_two[None, columns]
            spare = 2 * np.floor((1 - similarity) * np.maximum(a, b) + 1e-9) - np.abs(a - b)
            apart = np.zeros(ok.shape, np.int32)
            for c in range(COARSE):
                apart += np.abs(coarse[0][c, rows, None] - coarse[1][c, None, columns])
            x, y = np.nonzero(ok & (apart <= spare))
            for k in range(0, len(x), 4096):
                p, q = x[k : k + 4096], y[k : k + 4096]
                near = np.abs(one.base[p + i] - two.base[q + j]).sum(1, dtype=np.int64) <= spare[p, q]
                p, q = p[near], q[near]
                near = one.apart(p + i, two, q + j) <= spare[p, q]
                yield p[near] + i, q[near] + j


def earlier(turns: pa.ListArray, turn: int) -> np.ndarray:
    """For each row the numbers, from 1, of its ``turns`` that are less than ``turn`` and that another row has; 0 fills up."""
    size = turns.value_lengths().to_numpy()
    row, flat = np.repeat(np.arange(len(size)), size), turns.flatten().to_numpy()
    row, flat = row[flat < turn], flat[flat < turn]
    _, which, times = np.unique(flat, return_inverse=True, return_counts=True)
    row, which = row[times[which] > 1], which[times[which] > 1]
    count = np.bincount(row, minlength=len(size))
    out = np.zeros((len(size), int(count.max(initial=0))), np.int64)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)] = which + 1
    return out


def share_any(sets: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether rows x and y of ``sets`` have a number other than 0 in common."""
    out, step = np.zeros(len(x), bool), max(1, (1 << 22) // max(1, sets.shape[1] ** 2))
    for k in range(0, len(x), step):
        a, b = sets[x[k : k + step], :, None], sets[y[k : k + step], None, :]
        out[k : k + step] = ((a == b) & (a != 0)).any((1, 2))
    return out


def _blocks(similarity: float, forest: bool, backwards: bool):
    """Rows in order of (turn, low, high): members of two blocks, or of one where these are equal -> pairs to align, with
    ``forest`` no more than link their parts if all match, else each pair with a sketch in common, in the
    least group that it shares only."""

    def pairs(group: pa.Table) -> pa.RecordBatch:
        n = group.column("n").to_numpy()
        order = np.argsort(n, kind="stable")
        group, n = group.take(pa.array(order)).combine_chunks(), n[order]
        column = lambda c: x.combine_chunks() if isinstance(x := group.column(c), pa.ChunkedArray) else x
        part, bag, member = column("part").to_numpy(), column("bag"), column("member")
        label = np.unique(part, return_inverse=True)[1]
        good, far, own = (group.column(c).to_numpy() for c in ("good", "far", "own"))
        low = group.column("low")[0].as_py()
        sides = [np.arange(len(n))] * 2 if low == group.column("high")[0].as_py() else [np.flatnonzero(own == low), np.flatnonzero(own != low)]
        if backwards:
            sides = sides[::-1]

        def open_(rows: slice, columns: slice) -> np.ndarray:
            i, j = sides[0][rows, None], sides[1][None, columns]
            ok = (label[i] != label[j]) & ~(good[i] & far[j]) & ~(far[i] & good[j])
            if sides[0] is sides[1]:
                ok &= (i > j) if backwards else (i < j)
            return ok

        if not forest:
            before = earlier(column("turns"), group.column("turn")[0].as_py())
            listed = column("marks")
            size = listed.value_lengths().to_numpy()
            marks = np.zeros((len(n), int(size.max())), np.int32)
            marks[np.repeat(np.arange(len(n)), size), tokens.ranges(np.zeros(len(n), np.int64), size)] = listed.flatten().to_numpy()
        bags = [Bags(bag)] * 2 if sides[0] is sides[1] else [Bags(bag.take(pa.array(s))) for s in sides]
        out: list[list[np.ndarray]] = [[], []]
        for x, y in close_pairs(n[sides[0]], bags[0], n[sides[1]], bags[1], open_, similarity):
            x, y = sides[0][x], sides[1][y]
            if forest:
                kept = []
                for i in np.unique(x).tolist():
                    met = np.flatnonzero(x == i)
                    met = met[label[y[met]] != label[i]]
                    values, first = np.unique(label[y[met]], return_index=True)
                    kept.append(met[first])
                    label[np.isin(label, values)] = label[i]
                keep = np.concatenate(kept) if kept else np.zeros(0, np.int64)
            else:
                keep = ((marks[x] == marks[y]) & (marks[x] != 0)).any(1)
                keep[keep] = ~share_any(before, x[keep], y[keep])
            x, y = x[keep], y[keep]
            out[0].append(x)
            out[1].append(y)
        x, y = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in out)
        return pa.RecordBatch.from_arrays([member.take(pa.array(x)), member.take(pa.array(y)), pa.array(part[x]), pa.array(part[y])], ["center", "member", "one", "two"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)])
            cuts = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1, [batch.num_rows]])
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if last is not None and tuple(keys[:, i]) != last and held:
                    yield pairs(pa.Table.from_batches(held))
                    held = []
                last = tuple(keys[:, i])
                held.append(batch.slice(i, j - i))
        if held:
            yield pairs(pa.Table.from_batches(held))

    return blocks


def _pairs(held: DataFrame, counts: DataFrame, *, similarity: float, block: int, forest: bool, backwards: bool) -> DataFrame:
    """Pairs (center, member, one, two) of texts of two parts that are in one group and that their counts do not tell apart.

    ``held``: member, part, groups (turn, size, good, far); ``counts``: member, n, bag, marks.  A row for each member meets its counts; a group is dealt into
    blocks, and two of them at a time meet in a task."""
    more = () if forest else ("marks", "turns")
    dealt = held.withColumn("turns", F.col("groups")["turn"]).join(counts, "member").select("member", "part", "n", "bag", *more, F.inline("groups"))
    blocks = F.ceil(F.col("size") / block).cast("int")
    dealt = dealt.select("turn", "member", "n", "part", "good", "far", "bag", *more, F.pmod(F.hash("member"), blocks).alias("own"), blocks.alias("blocks"))
    spread = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = spread.select("turn", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "member", "n", "part", "good", "far", "bag", *more)
    met = rows.repartition("turn", "low", "high").sortWithinPartitions("turn", "low", "high")
    kind = dict(counts.dtypes)["member"]
    found = met.mapInArrow(_blocks(similarity, forest, backwards), f"center {kind}, member {kind}, one bigint, two bigint")
    return found.select(F.least("center", "member").alias("center"), F.greatest("center", "member").alias("member"), F.least("one", "two").alias("one"), F.greatest("one", "two").alias("two")).distinct()


def _merged(links_: DataFrame) -> DataFrame:
    """(part, label): for each part that has a link (one, two) to another, the least part within two links of it."""
    both = links_.select(F.col("one").alias("part"), F.col("two").alias("beside")).union(links_.select("two", "one"))
    first = both.groupBy("part").agg(F.min("beside").alias("m")).select("part", F.least("part", "m").alias("label"))
    return both.join(first.withColumnRenamed("part", "beside"), "beside").groupBy("part").agg(F.min("label").alias("m")).select("part", F.least("part", "m").alias("label"))


def links(nodes: DataFrame, docs: DataFrame, *, doc_id: str, text: str, similarity: float = SIMILARITY, block: int = BLOCK, forest_rounds: int = FOREST_ROUNDS) -> DataFrame:
    """Links (a, b) among ``nodes`` (id, n, sketches, bag)."""
    marks = F.transform("sketches", lambda s: F.shiftright(F.shiftleft(s, 32), 32).cast("int"))
    keys = nodes.select("id", "n", "bag", F.xxhash64("id").alias("turn"), marks.alias("marks"))
    rows = nodes.select(F.explode("sketches").alias("bucket"), F.col("id").alias("member"))
    # The center of a bucket is the member with the least hash.  Should two have one hash, both are centers.  Sketches are shuffled
    # once, and hashes, which do not compress, are worked out after that.
    own, every = F.xxhash64("member"), W.partitionBy("bucket")
    met = stash(rows.withColumns({"size": F.count("*").over(every), "turn": F.min(own).over(every)}).where("size > 1").select("bucket", "member", own.alias("own"), "size", "turn"))
    others = met.where("own <> turn")
    judged = stash(screen(others.select("turn", "member"), keys, similarity=similarity))
    # Texts are needed of those that may match their center or a text of the same bucket.
    members = met.select(F.col("member").alias("id")).distinct()
    texts = stash(likely_among(docs.select(F.col(doc_id).alias("id"), text_or_empty(text).alias("t")), "id", members).join(members, "id"))  # a semi-join would be moved before the bitmap
    aligned = align(judged.where("likely").select("center", "member").distinct(), texts, similarity=similarity)
    seen = stash(judged.select("turn", "center", "member", "likely").join(aligned, ["center", "member"], "left").select("turn", "center", "member", F.coalesce("good", F.lit(False)).alias("good"), (F.coalesce("near", F.lit(False)) | ~F.col("likely")).alias("near")))
    found = seen.where("good").select("center", "member")
    # Texts with one part are of one class: both match a center, or centers that match one.
    once = seen.where("good").groupBy("member").agg(F.min("turn").alias("part"))
    further = once.select(F.xxhash64("member").alias("part"), F.col("part").alias("further")).groupBy("part").agg(F.min("further").alias("further"))
    part = once.join(further, "part", "left").select("member", F.coalesce("further", "part").alias("part"))
    state = seen.groupBy("turn", "member").agg(F.max("good").alias("good"), F.max("near").alias("near"))
    good = F.coalesce("good", F.lit(False))
    # Buckets of one center are one group: a member has one row in it, and all pairs of a bucket are pairs of its group.
    marked = others.where("size > 2").select("turn", "member", "own").distinct().join(state, ["turn", "member"], "left").join(part, "member", "left")
    marked = marked.select("turn", "member", F.coalesce("part", "own").alias("part"), good.alias("good"), (~(good | F.coalesce("near", F.lit(False)))).alias("far"))
    tried = seen.select(F.least("center", "member").alias("center"), F.greatest("center", "member").alias("member"))
    rounds = [k < forest_rounds for k in range(forest_rounds + 1)]
    marked = stash(marked)
    counts = stash(likely_among(keys.select(F.col("id").alias("member"), "n", "bag", "marks"), "member", marked.select("member")))
    while rounds:
        forest = rounds.pop(0)
        # Groups of one class are done.  A part is a member's, whatever its groups: a row for each member meets its counts and its new name.
        mixed = marked.groupBy("turn").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count("*").alias("size")).where("p <> q").select("turn", "size")
        held = stash(marked.join(mixed, "turn").groupBy("member", "part").agg(F.collect_list(F.struct("turn", "size", "good", "far")).alias("groups")))
        across = _pairs(held, counts, similarity=similarity, block=block, forest=forest, backwards=len(rounds) % 2 == 1)
        across = stash(across.join(tried, ["center", "member"], "left_anti"))
        ends = across.select(F.col("center").alias("id")).union(across.select("member"))
        judged = align(across.select("center", "member").distinct(), likely_among(texts, "id", ends), similarity=similarity)
        tested = stash(across.join(judged, ["center", "member"]).select("center", "member", "one", "two", "good"))
        found = found.union(tested.where("good").select("center", "member"))
        if not rounds:
            break
        tried = tried.union(tested.select("center", "member"))
        renamed = _merged(tested.where("good").select("one", "two").distinct())
        named = held.join(renamed, "part", "left").select("member", F.coalesce("label", "part").alias("part"), F.inline("groups"))
        marked = named.select("turn", "member", "part", "good", "far")
        hits, all_ = tested.agg(F.count_if("good"), F.count("*")).collect()[0]
        if hits <= FOREST_GAIN * all_:  # another forest would merge little
            rounds = rounds[-1:]
    return found.select(F.col("center").alias("a"), F.col("member").alias("b"))


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row for each row of ``docs``: doc_id and class_id, the least doc_id of its class."""
    sketched = stash(sketch(docs, doc_id=doc_id, text=text).drop("marks"))  # they are the low bits of the sketches
    same = ["one", "two", "n"]
    nodes = stash(sketched.groupBy(*same).agg(F.min("id").alias("id"), F.first("sketches").alias("sketches"), F.first("bag").alias("bag")).where("id is not null"))
    joined = components(links(nodes, docs, doc_id=doc_id, text=text, similarity=similarity))
    named = nodes.select(*same, "id").join(joined.withColumnRenamed("node", "id"), "id", "left").select(*same, F.coalesce("label", "id").alias("class_id"))
    out = sketched.select("id", *same).join(named, same, "left")
    return out.select(F.col("id").alias("doc_id"), F.when(F.col("id").isNotNull(), F.col("class_id")).alias("class_id"))


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the least of its class; rows without doc_id stay."""
    classes = near_duplicates(docs, doc_id=doc_id, text=text, similarity=similarity)
    flag = free_name(docs, "doc_to_drop")
    gone = classes.where("class_id is not null and doc_id <> class_id").select(F.col("doc_id").alias(flag)).distinct()
    return docs.join(gone, docs[doc_id] == gone[flag], "left_anti")
