"""Sampled segmentations into sentence pieces, without replacement, and their decoding.

A text has one lattice: an edge for every vocabulary piece that occurs in it.  Edges weigh by a unigram distribution over
the pieces, here a Zipf law on the ranks of a byte-fallback vocabulary, raised to ``power``.  Sampling is Gumbel top-k by
perturbed A-star search: the best path takes the perturbed score of the root; at each of its choices every edge not
taken gets a perturbed score for the best path through it, conditioned on the score of the choice.  The greatest of these
bounds names the next sample, whose path is then drawn onwards from that edge with bounds of its own, and so on: the
bounds are exact, so no path is opened that is not emitted.  The bound left after k samples is the threshold of the
inclusion scores: the probability that a segmentation scores above it.

The search runs for all texts of an Arrow chunk at once.  No piece spans the beginning of a word, so a lattice falls
apart into units; sums over a unit's paths are worked out once for each distinct unit that a task has met lately.  All
noise is a hash of the row key, the place and the piece: the samples of a row do not depend on its partition.

Defined results: spaces become a mark, with one put in front; characters outside the vocabulary, a literal mark among them, become bytes; a null
or empty text has one segmentation, of no pieces; a text with fewer than k segmentations gives them all, with inclusion
1; rows with one key draw the same noise; an empty table gives an empty table; decoding gives the text back exactly.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import text_or_empty

#: The session setting that names the vocabulary file of the registered queries.
SETTING = "spark.lumenfield.tokenizer"
MARK = 0x2581
LITERAL_MARK = 0x110000
CHUNK_CHARS = 320_000
CACHED_UNITS = 120_000
SAMPLES = 3
ZIPF_SHIFT = 8.0
FALLBACK_RANK = 40_000.0


@dataclass(frozen=True)
class Vocabulary:
    """Plain arrays, so that it can be broadcast: its size is that of the tokenizer."""

    codes: np.ndarray  # code points of all pieces, one after another
    at: np.ndarray  # where each piece begins in them
    ids: np.ndarray
    log_weight: np.ndarray
    first_byte: int  # id of the piece of byte 0
    byte_weight: float
    size: int


def load_vocabulary(model_file: str, *, power: float = 1.0) -> Vocabulary:
    import sentencepiece

    if not os.path.exists(model_file):
        raise FileNotFoundError(f"no SentencePiece model at {model_file}: name one with the setting {SETTING}")
    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = model.get_piece_size()
    kept = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    pieces = [model.id_to_piece(i) for i in kept]
    rank = np.minimum([-model.get_score(i) for i in kept], float(n))
    weight = np.concatenate([1 / (rank + ZIPF_SHIFT), np.full(256, 1 / FALLBACK_RANK)]) ** power
    log_weight = np.log(weight / weight.sum())
    codes = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32)
    first_byte = next(i for i in range(n) if model.is_byte(i))
    return Vocabulary(codes, np.concatenate([[0], np.cumsum([len(p) for p in pieces])]), np.array(kept, np.int64), log_weight[:-256], first_byte, float(log_weight[-1]), n)


def _code_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    base = int(tokens.BASE)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * tokens.powers(base, len(codes)))])
    return tokens.mix((total[ends] - total[starts]) * tokens.powers(pow(base, -1, 1 << 64), len(codes) + 1)[starts])


class Lattices:
    """Edges of the lattices of distinct units, with the share of paths that takes each edge."""

    def __init__(self, vocabulary: Vocabulary):
        v = self.vocabulary = vocabulary
        hashes = _code_hashes(v.codes, v.at[:-1], v.at[1:])
        order = np.argsort(hashes)
        self.known, self.known_id, self.known_weight = hashes[order], v.ids[order], v.log_weight[order]
        self.longest = int(np.diff(v.at).max())
        several = np.repeat(np.diff(v.at) > 1, np.diff(v.at))
        self.alone = np.ones(LITERAL_MARK + 1, bool)  # characters that are in no piece of several
        self.alone[v.codes[several]] = False
        self.clear()

    def clear(self) -> None:
        self.units = np.zeros(0, np.uint64)
        self.first_node = np.zeros(0, np.int64)
        self.first_edge = np.zeros(1, np.int64)  # of each node; the last node of a unit has none
        self.to, self.piece, self.share, self.step = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def nodes_of(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The first node of each unit; units not met before are added."""
        hashes = _code_hashes(codes, starts, ends)
        distinct, lead, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.units) > CACHED_UNITS:
            self.clear()
        new = lead[~_member(distinct, self.units)]
        if len(new):
            self._add(hashes[new], codes, starts[new], ends[new])
        return self.first_node[np.searchsorted(self.units, distinct)][back]

    def _add(self, hashes: np.ndarray, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        v, sizes = self.vocabulary, ends - starts
        codes = codes[tokens.ranges(starts, sizes)]
        unit = np.repeat(np.arange(len(sizes)), sizes)
        close = np.cumsum(sizes)
        place = np.arange(len(codes))
        left = close[unit] - place
        node = place + unit
        src, size, piece, weight = [], [], [], []
        for n in range(1, self.longest + 1):
            at = np.flatnonzero(left >= n)
            if not len(at):
                break
            found = _code_hashes(codes, at, at + n)
            k = np.minimum(np.searchsorted(self.known, found), len(self.known) - 1)
            hit = self.known[k] == found
            src.append(at[hit])
            size.append(np.full(int(hit.sum()), n))
            piece.append(self.known_id[k[hit]])
            weight.append(self.known_weight[k[hit]])
            if n == 1:
                lost = at[~hit]
                code = np.where(codes[lost] == LITERAL_MARK, MARK, codes[lost]).astype(np.int64)
                width = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
                src.append(lost)
                size.append(np.ones(len(lost), np.int64))
                piece.append(-1 - code)
                weight.append(width * v.byte_weight)
        src, size, piece, weight = (np.concatenate(x) for x in (src, size, piece, weight))
        total = np.zeros(len(codes) + len(sizes))  # log of the summed weights of all paths from a node to its unit's end
        by = np.lexsort((src, left[src]))
        s, d = src[by], left[src][by]
        goal = node[s] + size[by]
        w = weight[by]
        level = np.searchsorted(d, np.arange(1, int(left.max(initial=0)) + 2))
        for a, b in zip(level[:-1].tolist(), level[1:].tolist(), strict=True):
            if a == b:
                continue
            value = w[a:b] + total[goal[a:b]]
            heads = np.flatnonzero(np.concatenate([[True], s[a + 1 : b] != s[a : b - 1]]))
            top = np.maximum.reduceat(value, heads)
            counts = np.diff(np.concatenate([heads, [b - a]]))
            total[node[s[a + heads]]] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, counts)), heads))
        order = np.lexsort((size, src))
        src, size, piece, weight = src[order], size[order], piece[order], weight[order]
        base = len(self.first_edge) - 1
        share = weight + total[node[src] + size] - total[node[src]]
        degree = np.bincount(node[src], minlength=len(total))
        self.to = np.concatenate([self.to, node[src] + size + base])
        self.piece = np.concatenate([self.piece, piece])
        self.share = np.concatenate([self.share, share])
        self.step = np.concatenate([self.step, size])
        self.first_edge = np.concatenate([self.first_edge, self.first_edge[-1] + np.cumsum(degree)])
        units = np.concatenate([self.units, hashes])
        first = np.concatenate([self.first_node, base + close - sizes + np.arange(len(sizes))])
        order = np.argsort(units)
        self.units, self.first_node = units[order], first[order]


def _member(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(x), bool)
    return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x


def _gumbel(seed: np.ndarray, what: np.ndarray) -> np.ndarray:
    u = ((tokens.mix(seed ^ tokens.mix(what)) >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53
    return -np.log(-np.log(u))


@dataclass
class Path:
    """Choices of one sample of many texts, sorted by text and place, and the bounds of the edges not taken."""

    text: np.ndarray
    place: np.ndarray
    edge: np.ndarray
    begins: np.ndarray  # where the choices of each text begin
    score: np.ndarray  # log probability and perturbed score by text; nan: no such sample
    perturbed: np.ndarray
    other_text: np.ndarray
    other_choice: np.ndarray  # index into the arrays above
    other_edge: np.ndarray
    other_score: np.ndarray
    bound: np.ndarray


def _walk(lat: Lattices, node: np.ndarray, text: np.ndarray, place: np.ndarray, seeds: np.ndarray, draw: int) -> tuple[np.ndarray, ...]:
    """Draw a path from each node to the end of its unit.  Choices: text, place, edge, perturbed weight of the edge taken.
    Edges not taken: choice, edge, perturbed weight."""
    out: list[list[np.ndarray]] = [[] for _ in range(7)]
    made = 0
    while len(node):
        low = lat.first_edge[node]
        degree = lat.first_edge[node + 1] - low
        on = degree > 0
        if not on.all():
            node, text, place, low, degree = node[on], text[on], place[on], low[on], degree[on]
            if not len(node):
                break
        edge = tokens.ranges(low, degree)
        of = np.repeat(np.arange(len(node)), degree)
        what = (place[of] * 64 + np.minimum(lat.step[edge], 63)).astype(np.uint64) ^ np.uint64(draw << 56)
        weight = lat.share[edge] + _gumbel(seeds[text[of]], what)
        heads = np.cumsum(degree) - degree
        top = np.maximum.reduceat(weight, heads)
        taken = weight == top[of]
        if int(taken.sum()) != len(node):  # equal ones: the first
            first = np.zeros(len(edge), bool)
            hit = np.flatnonzero(taken)
            first[hit[np.searchsorted(hit, heads)]] = True
            taken = first
        best = edge[taken]
        for k, x in enumerate((text, place, best, top, of[~taken] + made, edge[~taken], weight[~taken])):
            out[k].append(x)
        made += len(node)
        node, place = lat.to[best], place + lat.step[best]
    kinds = (np.int64, np.int64, np.int64, float, np.int64, np.int64, float)
    return tuple(np.concatenate(x) if x else np.zeros(0, k) for x, k in zip(out, kinds, strict=True))


def _order(text: np.ndarray, place: np.ndarray) -> np.ndarray:
    return np.argsort(text << 40 | place, kind="stable")


def _truncated(weight: np.ndarray, top: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Gumbel values given that their greatest, now ``top``, is ``bound``."""
    with np.errstate(divide="ignore"):
        v = bound - weight + np.log1p(-np.exp(np.minimum(weight - top, 0.0)))
    return bound - np.maximum(v, 0.0) - np.log1p(np.exp(-np.abs(v)))


def _path(lat: Lattices, n: int, drawn: tuple[np.ndarray, ...], before: tuple[np.ndarray, np.ndarray, np.ndarray], start: np.ndarray, perturbed: np.ndarray) -> Path:
    """Join the choices copied from an earlier sample (``before``) with those drawn after them; ``start``: the log
    probability of the former by text."""
    text, place, edge, top, choice, other, weight = drawn
    share = lat.share[edge]
    order = _order(text, place)
    run = np.cumsum(share[order])
    heads = np.searchsorted(text[order], np.arange(n))
    prior = np.concatenate([[0.0], run])[heads]
    ahead = np.empty(len(text))
    ahead[order] = run - share[order] - prior[text[order]]
    ahead += start[text]
    total = start + np.bincount(text, share, n)
    abs_other = ahead[choice] + weight
    bound = _truncated(abs_other, ahead[choice] + top[choice], perturbed[text[choice]])
    t, p, e = (np.concatenate(x) for x in ((before[0], text), (before[1], place), (before[2], edge)))
    final = _order(t, p)
    where = np.empty(len(final), np.int64)
    where[final] = np.arange(len(final))
    t = t[final]
    return Path(t, p[final], e[final], np.searchsorted(t, np.arange(n + 1)), total, perturbed, text[choice], where[len(before[0]) + choice], other, ahead[choice] + lat.share[other], bound)


def sample_paths(lat: Lattices, node: np.ndarray, text: np.ndarray, place: np.ndarray, seeds: np.ndarray, samples: int) -> tuple[list[Path], np.ndarray]:
    """The samples of all texts, and by text the bound that is left."""
    n = len(seeds)
    none = np.zeros(0, np.int64)
    key = text << 40 | place
    root = _gumbel(seeds, np.full(n, 1 << 62, np.uint64))
    paths = [_path(lat, n, _walk(lat, node, text, place, seeds, 0), (none, none, none), np.zeros(n), root)]
    while True:
        best, owner, which = np.full(n, -np.inf), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for k, p in enumerate(paths):
            top = np.full(n, -np.inf)
            np.maximum.at(top, p.other_text, p.bound)
            hit = np.flatnonzero(p.bound == top[p.other_text])
            greatest = np.full(n, -1, np.int64)
            greatest[p.other_text[hit]] = hit
            has = np.flatnonzero(greatest >= 0)
            better = has[p.bound[greatest[has]] > best[has]]
            best[better], owner[better], which[better] = p.bound[greatest[better]], k, greatest[better]
        if len(paths) == samples:
            return paths, best
        some = np.flatnonzero(np.isfinite(best))
        start = np.full(n, np.nan)
        copied: list[list[np.ndarray]] = [[], [], []]
        nodes, texts, places = [], [], []
        for k, p in enumerate(paths):
            own = some[owner[some] == k]
            if not len(own):
                continue
            other = which[own]
            choice, edge = p.other_choice[other], p.other_edge[other]
            start[own] = p.other_score[other]
            head = tokens.ranges(p.begins[own], choice - p.begins[own])
            at = p.place[choice]
            for c, x in zip(copied, ((p.text[head], own), (p.place[head], at), (p.edge[head], edge)), strict=True):
                c += x
            low = np.searchsorted(key, own << 40 | at, "right")  # units that begin after the choice
            rest = tokens.ranges(low, np.searchsorted(key, (own + 1) << 40) - low)
            nodes += [lat.to[edge], node[rest]]
            texts += [own, text[rest]]
            places += [at + lat.step[edge], place[rest]]
            p.bound[other] = -np.inf
        join = lambda x: np.concatenate(x) if x else none
        drawn = _walk(lat, join(nodes), join(texts), join(places), seeds, len(paths))
        paths.append(_path(lat, n, drawn, tuple(join(c) for c in copied), start, np.where(np.isfinite(best), best, np.nan)))


def normalise(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts as the lattice has them, and where each text begins."""
    raw = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    sizes = np.array([len(t) for t in texts], np.int64)
    full = sizes > 0
    at = np.concatenate([[0], np.cumsum(sizes + full)])
    codes = np.full(int(at[-1]), MARK, np.uint32)
    codes[tokens.ranges(at[:-1] + full, sizes)] = np.where(raw == MARK, LITERAL_MARK, np.where(raw == 32, MARK, raw))
    return codes, at


def unit_starts(lat: Lattices, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    alone = lat.alone[codes]
    cut = np.zeros(len(codes) + 1, bool)
    cut[1:-1] = ((codes[1:] == MARK) & (codes[:-1] != MARK)) | alone[1:] | alone[:-1]
    cut[at[:-1]] = True
    return np.flatnonzero(cut[:-1])


def piece_ids(lat: Lattices, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a sequence of edges, and how many each edge gives."""
    piece = lat.piece[edges]
    plain = piece >= 0
    code = -1 - piece
    width = np.where(plain, 1, 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))
    out = np.repeat(piece, width)
    lost = np.flatnonzero(~plain)
    if len(lost):
        begin = np.cumsum(width) - width
        for c in np.unique(code[lost]).tolist():
            for k, b in enumerate(chr(c).encode()):
                out[begin[lost[code[lost] == c]] + k] = lat.vocabulary.first_byte + b
    return out, width


def _encode(vocabulary, samples: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = Lattices(vocabulary.value)
        for batch in batches:
            sizes = np.diff(tokens.text_buffer(batch.column(1))[1])
            for i, j in tokens.chunks(np.concatenate([[0], np.cumsum(sizes)]), CHUNK_CHARS):
                codes, at = normalise(batch.column(1).slice(i, j - i).to_pylist())
                n = j - i
                seeds = tokens.mix(batch.column(0).slice(i, n).to_numpy().view(np.uint64))
                starts = unit_starts(lat, codes, at)
                node = lat.nodes_of(codes, starts, np.concatenate([starts[1:], [len(codes)]]).astype(np.int64)) if len(starts) else np.zeros(0, np.int64)
                text = np.searchsorted(at, starts, "right") - 1
                paths, threshold = sample_paths(lat, node, text, starts - at[text], seeds, samples)
                for rank, p in enumerate(paths):
                    rows = np.flatnonzero(~np.isnan(p.perturbed))
                    ids, width = piece_ids(lat, p.edge)
                    total = np.concatenate([[0], np.cumsum(width)])[p.begins]
                    lists = pa.ListArray.from_arrays(pa.array(total, pa.int32()), pa.array(ids, pa.int32()))
                    with np.errstate(over="ignore"):
                        inclusion = -np.expm1(-np.exp(p.score - threshold))
                    whole = pa.RecordBatch.from_arrays(
                        [pa.array(np.arange(i, j)), pa.array(np.full(n, rank), pa.int32()), lists, pa.array(p.score), pa.array(p.perturbed), pa.array(inclusion)],
                        ["row", "rank", "ids", "log_probability", "perturbed", "inclusion"],
                    ).take(pa.array(rows))
                    keys = [batch.column(k).take(whole.column(0)) for k in range(2, batch.num_columns)]
                    yield pa.RecordBatch.from_arrays([*keys, *whole.columns[1:]], [*batch.schema.names[2:], *whole.schema.names[1:]])

    return encode


def sample_segmentations(rows: DataFrame, vocabulary: Vocabulary, *, key: Sequence[str], text: str = "text", samples: int = SAMPLES, seed: int = 1, decoded: bool = False) -> DataFrame:
    """For each row its key columns and up to ``samples`` rows: rank (from 0), ids, log_probability, perturbed, inclusion;
    with ``decoded`` also the text of the pieces, as ``decode_pieces`` gives it, worked out by the same Python worker."""
    spark: SparkSession = rows.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)
    lean = rows.select(F.xxhash64(F.lit(seed), *key).alias("lattice_seed"), text_or_empty(text).alias("lattice_text"), *key)
    kinds = dict(lean.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in key) + ", rank int, ids array<int>, log_probability double, perturbed double, inclusion double"
    encode, decode = _encode(shared, samples), _decode(shared, "ids")
    if decoded:
        return lean.mapInArrow(lambda batches: decode(encode(batches)), schema + ", decoded string")
    return lean.mapInArrow(encode, schema)


def _decode(vocabulary, column: str):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        raw: list[bytes] = [b""] * v.size
        for b in range(256):
            raw[v.first_byte + b] = bytes([b])
        whole = v.codes.astype("<u4").tobytes().decode("utf-32-le").replace(chr(MARK), " ")
        for k, i in enumerate(v.ids.tolist()):
            raw[i] = whole[v.at[k] : v.at[k + 1]].encode()
        sizes = np.array([len(x) for x in raw], np.int64)
        begin, data = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(raw), np.uint8)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(column))
            at = lists.offsets.to_numpy().astype(np.int64)
            ids = lists.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]].astype(np.int64)
            at -= at[0]
            flat = data[tokens.ranges(begin[ids], sizes[ids])].tobytes()
            ends = np.concatenate([[0], np.cumsum(sizes[ids])])[at].tolist()
            texts = [flat[a + (flat[a : a + 1] == b" ") : b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return decode


def decode_pieces(rows: DataFrame, vocabulary: Vocabulary, *, ids: str = "ids") -> DataFrame:
    """``rows`` with a column ``decoded``: the text of the pieces in ``ids``.  Ids of no text (control pieces) give none."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", decoded string"
    return rows.mapInArrow(_decode(shared, ids), schema)
