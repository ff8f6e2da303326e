"""Removal of byte strings of a given length that start anywhere else too.

Common prefixes come from a Burrows-Wheeler transform by bounded interval expansion: boundaries between intervals of
rows start where first symbols differ, and a boundary of value v gives, by one step of backward extension, boundaries
of value v + 1.  Values are thus derived in increasing order, breadth first, and the search stops at the minimum
length: rows that no boundary parts by then share at least that many bytes.

One transform cannot span a corpus, so the suffixes are dealt out such that equal strings always meet.  Each window of
200 bytes is keyed by the least hash of the 32-byte grams in it; neighbouring windows with one key form a fragment.
Fragments whose key occurs once in the corpus cannot repeat and never travel.  The rest are shuffled by key, and each
task runs the transform over a few MB of whole keys at a time.  A text with copies is represented once; a fragment with
copies collapses before the shuffle.  Where a key has more distinct fragments than ``hot_fragments``, as under a very frequent
passage, each of them is cut again by the least hash of the longer grams (96, 160, at last 200 bytes) in its windows: windows that
are equal still meet, and each part goes through the transform like any other.

Defined results: texts are their UTF-8 bytes, null is empty; windows never cross texts; a text shorter than the length
loses nothing; of a text with an equal copy every window repeats; rows that repeat are copies of each other; a null doc_id is a value like any other; an empty table
gives an empty table; other columns take no part, and pass through ``remove_repeats`` untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import free_name, stash, text_or_empty

LENGTH = 200
GRAM = 32
BATCH_BYTES = 3 << 19
HOT_FRAGMENTS = 4000
LONGER_GRAMS = (96, 160)
LONGEST_RUN = 512
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


# --- keys of windows ---------------------------------------------------------------------------------------------------


def sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` (minimum or maximum) over each ``width`` neighbouring values."""
    n, reach = len(values) - width + 1, 1
    while reach * 2 <= width:
        values = pick(values[:-reach], values[reach:])
        reach *= 2
    return pick(values[:n], values[width - reach : width - reach + n])


def window_runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one key, the least hash of the grams inside: key, first window (from the text's begin),
    number of windows; and for each text how many runs come before it.  A run that holds its least gram twice could
    repeat within itself and is cut in two, so that its key counts twice."""
    n, width = len(data) - length + 1, length - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    places = np.arange(len(data) - gram + 1)
    grams = tokens.span_hashes(data, places, places + gram)
    keys = sliding(grams, width, np.minimum)
    valid = np.zeros(n, bool)
    valid[tokens.ranges(offsets[:-1], np.maximum(np.diff(offsets) - length + 1, 0))] = True
    begin = np.zeros(len(data) + 1, bool)
    begin[offsets] = True
    fresh = valid.copy()
    fresh[1:] &= (keys[1:] != keys[:-1]) | ~valid[:-1] | begin[1:n]
    before = np.concatenate([[0], np.cumsum(valid)])
    starts = np.flatnonzero(fresh)
    counts = before[np.concatenate([starts[1:], [n]])] - before[starts] if len(starts) else np.zeros(0, np.int64)
    # least of some window: the greatest key around it is its own
    around = np.concatenate([np.zeros(width - 1, np.uint64), keys, np.zeros(width - 1, np.uint64)])
    chosen = np.flatnonzero(sliding(around, width, np.maximum) == grams)
    low, high = np.searchsorted(chosen, starts), np.searchsorted(chosen, starts + counts + width - 1)
    hits = grams[chosen[tokens.ranges(low, high - low)]] == np.repeat(keys[starts], high - low)
    total = np.concatenate([[0], np.cumsum(hits)])
    edges = np.concatenate([[0], np.cumsum(high - low)])
    again = (total[edges[1:]] - total[edges[:-1]] > 1) & (counts > 1)
    pieces = -(-counts // LONGEST_RUN)
    more = [starts[again] + 1, np.repeat(starts, pieces - 1) + LONGEST_RUN * (tokens.ranges(np.zeros(len(pieces), np.int64), pieces - 1) + 1)]
    starts = np.unique(np.concatenate([starts, *more]))
    counts = before[np.concatenate([starts[1:], [n]])] - before[starts] if len(starts) else np.zeros(0, np.int64)
    at = np.searchsorted(starts, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    return keys[starts], starts - offsets[text], counts, at


def _scan(length: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tokens.text_buffer(batch.column(1))
            for i, j in tokens.chunks(offsets):
                part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                keys, starts, counts, at = window_runs(part, own, length)
                raw = part.tobytes()
                sha = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(own[:-1].tolist(), own[1:].tolist(), strict=True)]
                at = pa.array(at, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(np.diff(own), pa.int64()), pa.array(sha, pa.string()), pa.ListArray.from_arrays(at, pa.array(keys.view(np.int64))), pa.ListArray.from_arrays(at, pa.array(starts, pa.int32())), pa.ListArray.from_arrays(at, pa.array(counts, pa.int32()))],
                    ["id", "n_bytes", "sha", "keys", "starts", "counts"],
                )

    return scan


# --- fragments ---------------------------------------------------------------------------------------------------------


def gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary column of slices of ``data``."""
    total = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, total.buffers()[1], pa.py_buffer(data[tokens.ranges(starts, sizes)].tobytes())])


def _cells(data: np.ndarray, first: np.ndarray, size: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Of slices of ``data``: a 128-bit hash in two parts, the summed weight of all equal ones, and the bytes, which only the
    first of equal ones has."""
    one = tokens.span_hashes(data, first, first + size)
    two = tokens.span_hashes(data, first, first + size, base=0xA24BAED4963EE407)
    _, lead, back = np.unique(one ^ tokens.mix(two), return_index=True, return_inverse=True)
    shown = np.zeros(len(first), bool)
    shown[lead] = True
    raw = gather(data, first, np.where(shown, size, 0))
    if len(first):
        raw = pa.Array.from_buffers(pa.binary(), len(first), [pa.array(shown).buffers()[1], *raw.buffers()[1:]])
    return one.view(np.int64), two.view(np.int64), np.bincount(back, weight, len(lead)).astype(np.int64)[back], raw


def _cut(length: int):
    """rid, text, runs -> fragments; the bytes only at the first of equal ones in a chunk."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tokens.text_buffer(batch.column(1))
            lists = batch.column(2)
            at = lists.offsets.to_numpy().astype(np.int64)
            runs = lists.values
            key, start, count = (runs.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            for i, j in tokens.chunks(offsets):
                own = slice(at[i], at[j])
                row = np.repeat(np.arange(i, j), np.diff(at[i : j + 1]))
                s = start[own].astype(np.int64)
                one, two, times, raw = _cells(data[offsets[i] : offsets[j]], s + offsets[row] - offsets[i], count[own] + length - 1, np.ones(len(s)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[own]), pa.array(one), pa.array(two), batch.column(0).take(pa.array(row)), pa.array(s), pa.array(times), raw],
                    ["key", "one", "two", "rid", "start", "times", "fragment"],
                )

    return cut


def _cut_again(length: int, gram: int):
    """up_one, up_two, up_times, fragment -> the parts of each fragment by the least hash of the ``gram`` bytes in its windows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tokens.text_buffer(batch.column(3))
            for i, j in tokens.chunks(offsets, 1 << 19):
                part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                keys, starts, counts, at = window_runs(part, own, length, gram)
                row = np.repeat(np.arange(j - i), np.diff(at))
                one, two, times, raw = _cells(part, starts + own[row], counts + length - 1, batch.column(2).to_numpy()[i:j][row])
                up = (pa.array(batch.column(k).to_numpy()[i:j][row]) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(one), pa.array(two), *up, pa.array(starts), pa.array(times), raw], ["key", "one", "two", "up_one", "up_two", "start", "times", "fragment"])

    return cut


# --- the transform -------------------------------------------------------------------------------------------------------


def suffix_order(codes: np.ndarray, stop: np.ndarray, length: int) -> np.ndarray:
    """Suffixes in the order of their first ``length`` symbols at least; ``stop``: the end mark (code 0) of each one's string."""
    n = len(codes)
    place = np.arange(n)
    packed = np.zeros(n, np.uint64)
    for j in range(7):  # nine bits for a symbol
        packed <<= np.uint64(9)
        inside = place[: n - j] + j < stop[: n - j] if j else codes > 0
        packed[: n - j] |= np.where(inside, codes[j:], 0).astype(np.uint64)
    order = np.argsort(packed, kind="stable")
    by = packed[order]
    rank = np.empty(n, np.uint64)
    rank[order] = np.cumsum(np.concatenate([[0], (by[1:] != by[:-1]).astype(np.int64)])).astype(np.uint64)
    reach = 7
    while reach < length:
        after = np.zeros(n, np.uint64)
        inside = np.flatnonzero(place + reach < stop)
        after[inside] = rank[inside + reach] + np.uint64(1)
        packed = (rank << np.uint64(32)) | after
        order = np.argsort(packed, kind="stable")
        by = packed[order]
        rank[order] = np.cumsum(np.concatenate([[0], (by[1:] != by[:-1]).astype(np.int64)])).astype(np.uint64)
        reach *= 2
    return order


def repeated_starts(fragments: list[bytes], length: int = LENGTH) -> np.ndarray:
    """Places in the fragments, each closed by one end mark, at which ``length`` bytes begin that begin elsewhere too."""
    sizes = np.array([len(f) for f in fragments], np.int64)
    codes = np.zeros(int(sizes.sum()) + len(sizes), np.uint16)
    stops = np.cumsum(sizes + 1) - 1
    codes[tokens.ranges(stops - sizes, sizes)] = np.frombuffer(b"".join(fragments), np.uint8).astype(np.uint16) + 1
    n = len(codes)
    stop = np.repeat(stops, sizes + 1)
    suffixes = suffix_order(codes, stop, length)
    transform = codes[suffixes - 1]  # of the first suffix: the last end mark
    by = np.argsort(transform, kind="stable")
    back = np.empty(n, np.int32)  # row of the suffix that begins one symbol earlier
    back[by] = np.arange(n, dtype=np.int32)
    last = np.full(n, -1, np.int32)  # the previous row with the same symbol before it
    same = transform[by[1:]] == transform[by[:-1]]
    last[by[1:][same]] = by[:-1][same]
    head = codes[suffixes]
    parted = np.ones(n + 1, bool)
    parted[1:n] = (head[1:] != head[:-1]) | (head[1:] == 0)
    front = np.flatnonzero(parted[:n])
    for _ in range(length - 1):  # from boundaries of each value to those of the next
        if not len(front):
            break
        known = np.flatnonzero(parted)
        ends = known[np.searchsorted(known, front, "right")]
        rows = tokens.ranges(front, ends - front)
        lead = last[rows] < np.repeat(front, ends - front)
        front = back[rows[lead]]
        front = np.sort(front[~parted[front]])
        parted[front] = True
    joined = np.flatnonzero(~parted[:n])
    out = np.zeros(n, bool)
    out[suffixes[joined]] = True
    out[suffixes[joined - 1]] = True
    return out


def flag_runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of true values."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _expand(length: int, batch_bytes: int):
    """Distinct fragments, sorted by key -> the runs of repeated windows in each."""

    def solve(group: list[list]) -> pa.RecordBatch:
        flags = repeated_starts([g[3] for g in group], length)
        at = np.concatenate([[0], np.cumsum([len(g[3]) + 1 for g in group])])
        one, two, begin, end, lists = [], [], [], [], [0]
        for g, a in zip(group, at[:-1], strict=True):
            windows = len(g[3]) - length + 1
            b, e = (np.array([0]), np.array([windows])) if g[4] > 1 else flag_runs(flags[a : a + windows])
            if len(b):
                one.append(g[1])
                two.append(g[2])
                begin.append(b)
                end.append(e + length - 1)
                lists.append(lists[-1] + len(b))
        offsets = pa.array(lists, pa.int32())
        flat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.ListArray.from_arrays(offsets, flat(begin)), pa.ListArray.from_arrays(offsets, flat(end))], ["one", "two", "begins", "ends"])

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[list] = []
        size = 0
        for batch in batches:
            for key, one, two, times, fragment in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and group[-1][:3] == [key, one, two]:
                    group[-1][4] += times
                    continue
                if size >= batch_bytes and group[-1][0] != key:
                    yield solve(group)
                    group, size = [], 0
                group.append([key, one, two, fragment, times])
                size += len(fragment) + 1
        if group:
            yield solve(group)

    return expand


def repeated_runs(fragments: DataFrame, *, length: int, batch_bytes: int, hot_fragments: int, grams: tuple[int, ...] | None = None) -> DataFrame:
    """one, two (the fragment), begins, ends: its byte runs covered by strings that also start elsewhere."""
    grams = (*(g for g in LONGER_GRAMS if g < length), length) if grams is None else grams
    shown = fragments.where("fragment is not null").select("key", "one", "two", "times", "fragment")
    hot = stash(shown.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot_fragments).select("key"))
    any_hot = bool(grams) and not hot.isEmpty()
    plain = (shown.join(hot, "key", "left_anti") if any_hot else shown).repartition("key").sortWithinPartitions("key", "one", "two")
    runs = plain.mapInArrow(_expand(length, batch_bytes), "one bigint, two bigint, begins array<bigint>, ends array<bigint>")
    if not any_hot:
        return runs
    most = shown.join(hot, "key", "left_semi").groupBy("one", "two").agg(F.sum("times").alias("times"), F.first("fragment").alias("fragment"))
    parts = stash(most.mapInArrow(_cut_again(length, grams[0]), "key bigint, one bigint, two bigint, up_one bigint, up_two bigint, start bigint, times bigint, fragment binary"))
    deeper = repeated_runs(parts, length=length, batch_bytes=batch_bytes, hot_fragments=hot_fragments, grams=grams[1:])
    met = parts.select("one", "two", "up_one", "up_two", "start").join(deeper, ["one", "two"])
    move = lambda c: F.transform(c, lambda x: x + F.col("start")).alias(c)
    back = met.select("up_one", "up_two", move("begins"), move("ends")).groupBy("up_one", "up_two").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("begins", "ends")))
    return runs.union(back)


# --- whole texts ---------------------------------------------------------------------------------------------------------


def covered(begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of byte runs, as maximal runs in order."""
    order = np.argsort(begins, kind="stable")
    begins, ends = begins[order], np.maximum.accumulate(ends[order])
    fresh = np.concatenate([[True], begins[1:] > ends[:-1]])
    return begins[fresh], ends[np.concatenate([np.flatnonzero(fresh)[1:] - 1, [len(ends) - 1]])]


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = tokens.text_buffer(batch.column(1))
        lists = batch.column(2)
        at = lists.offsets.to_numpy()
        begin, end = (lists.values.field(k).to_numpy(zero_copy_only=False) for k in range(2))
        removed, spans, sha, kept = [], [], [], []
        for r in range(batch.num_rows):
            b, e = covered(begin[at[r] : at[r + 1]], end[at[r] : at[r + 1]])
            raw = data[offsets[r] : offsets[r + 1]]
            stay = np.concatenate([[0], e]), np.concatenate([b, [len(raw)]])
            left = b"".join(raw[x:y].tobytes() for x, y in zip(*stay, strict=True))
            removed.append(int((e - b).sum()))
            spans.append(len(b))
            sha.append(hashlib.sha256(left).hexdigest())
            kept.append(left.decode("utf-8", "ignore"))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())], ["rid", "n_removed", "n_spans", "kept_sha256", "kept"])


def _rid(doc_id: Column, sha: Column) -> Column:
    """128 bits that stand for an id and its content."""
    return F.unhex(F.md5(F.concat(sha, F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit("\0"))).cast("binary")))


def repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, batch_bytes: int = BATCH_BYTES, hot_fragments: int = HOT_FRAGMENTS, with_text: bool = False) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with ``with_text`` also kept:
    the remaining bytes as text (of a character that is cut through, the stray bytes go)."""
    lean = docs.select(F.col(doc_id).alias("id"), text_or_empty(text).alias("t"))
    kind = dict(lean.dtypes)["id"]
    scanned = stash(lean.mapInArrow(_scan(length), f"id {kind}, n_bytes bigint, sha string, keys array<bigint>, starts array<int>, counts array<int>").withColumn("rid", _rid(F.col("id"), F.col("sha"))))
    copies = scanned.groupBy("sha").agg(F.count("*").alias("copies"), F.min("rid").alias("lead"))
    texts = scanned.join(copies, "sha").select("id", "n_bytes", "sha", "rid", "copies", (F.col("rid") == F.col("lead")).alias("leads"))
    texts = stash(texts)
    leads = texts.where(F.col("leads") & (F.col("n_bytes") >= length)).select("rid").distinct()
    runs = scanned.select("rid", "sha", F.explode(F.arrays_zip("keys", "starts", "counts")).alias("r")).select("rid", "r.keys", "r.starts", "r.counts", F.xxhash64("sha", "r.starts").alias("where"))
    # A key counts as repeated where different texts have it, or one text in two places; copies of a text do not count.
    twice = runs.groupBy("keys").agg(F.min("where").alias("a"), F.max("where").alias("b")).where("a < b").select("keys")
    lists = runs.select("rid", "keys", "starts", "counts").join(twice, "keys").groupBy("rid").agg(F.collect_list(F.struct("keys", "starts", "counts")).alias("runs")).join(leads, "rid", "left_semi")
    source = lean.select(_rid(F.col("id"), F.sha2("t", 256)).alias("rid"), "t").join(lists, "rid")
    source = stash(source)
    cut = stash(source.mapInArrow(_cut(length), "key bigint, one bigint, two bigint, rid binary, start bigint, times bigint, fragment binary"))
    found = stash(repeated_runs(cut, length=length, batch_bytes=batch_bytes, hot_fragments=hot_fragments))
    spans = cut.select("one", "two", "rid", "start").join(found, ["one", "two"]).select("rid", F.explode(F.arrays_zip("begins", "ends")).alias("s"), "start")
    per_text = spans.groupBy("rid").agg(F.collect_list(F.struct((F.col("s.begins") + F.col("start")).alias("b"), (F.col("s.ends") + F.col("start")).alias("e"))).alias("spans"))
    done = source.select("rid", "t").join(per_text, "rid").select("rid", "t", "spans").mapInArrow(_remove, "rid binary, n_removed bigint, n_spans bigint, kept_sha256 string, kept string")
    done = done if with_text else done.drop("kept")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    out = texts.join(done.dropDuplicates(["rid"]), "rid", "left")
    columns = [
        F.col("id").alias("doc_id"),
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(whole, F.lit(1)).when(F.col("n_removed").isNull(), F.lit(0)).otherwise(F.col("n_spans")).cast("bigint").alias("n_spans"),
        F.when(whole, F.lit(EMPTY_SHA)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    ]
    if with_text:
        columns += [F.when(whole, F.lit("")).otherwise(F.col("kept")).alias("kept"), "sha"]
    return out.select(*columns)


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, **options) -> DataFrame:
    """``docs`` with the repeated bytes gone from ``text``; every row stays, a text without repeats as it is."""
    id_, sha, kept = (free_name(docs, n) for n in ("repeat_id", "repeat_sha", "repeat_kept"))
    changed = repeats(docs, doc_id=doc_id, text=text, length=length, with_text=True, **options).where("kept is not null")
    changed = changed.select(F.col("doc_id").alias(id_), F.col("sha").alias(sha), F.col("kept").alias(kept)).dropDuplicates([id_, sha])
    joined = docs.join(changed, F.col(id_).eqNullSafe(F.col(doc_id)) & (F.col(sha) == F.sha2(text_or_empty(text), 256)), "left")
    return joined.select(*(F.coalesce(kept, text).alias(c) if c == text else F.col(c) for c in docs.columns))
