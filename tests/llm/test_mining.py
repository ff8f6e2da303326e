"""Collocations, hard negatives and context-tree scores against brute force, and on odd tables."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfield.llm import collocations, context_tree, hard_negatives, registry

# --- 11 ----------------------------------------------------------------------------------------------------------------


def plain_phrases(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in (1, 2, 3, 4):
                f[lang or "und"].update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if a >= least and " " in p}
        gone = set()
        for p, a in cand.items():
            w = p.split(" ")
            for k in range(2, len(w)):
                for i in range(len(w) - k + 1):
                    part = " ".join(w[i : i + k])
                    if 100 * a >= 80 * counts[part]:
                        gone.add(part)
        best = []
        for p, a in cand.items():
            w = p.split(" ")
            cuts = [(2000000 * a // (counts[" ".join(w[:k])] + counts[" ".join(w[k:])]), k) for k in range(1, len(w))]
            s, k = min(cuts)
            if p not in gone:
                best.append((-s, -a, p.encode(), counts[" ".join(w[:k])], counts[" ".join(w[k:])]))
        for i, (s, a, p, l, r) in enumerate(sorted(best)[:top]):
            out.add((lang, i + 1, p.decode(), -a, l, r, n[lang], -s))
    return out


def chatter(seed, rows, lang):
    """Texts of common words with chains that often stay together, so that phrases absorb their parts and thresholds fall."""
    r = random.Random(seed)
    words = [a + b for a in "bcdfg" for b in "aeiou"]
    chains = [[r.choice(words) + str(k) + x for x in "pqrs"[: r.randint(2, 4)]] for k in range(30)]
    out = []
    for _ in range(rows):
        parts = []
        for _ in range(60):
            parts += r.choice(chains)[: r.choice((2, 4, 4, 4))] if r.random() < 0.5 else [r.choice(words)]
            parts += [r.choice((".", ",", "\n"))] if r.random() < 0.1 else []
        out.append((" ".join(parts), lang))
    return out


@pytest.mark.parametrize("top", [1, 3, 10, 40, 2000])
def test_phrases_equal_all_counts(spark, top):
    rows = chatter(top, 40, "en") + chatter(top + 1, 25, None) + [(None, "fr"), ("", "fr"), (" \n.,", "de"), ("Aa bB " * 40, "de"), ("x y\x0bz é\t漢 字  k " * 30, "und"), ("w " * 3000, "en")]
    frame = spark.createDataFrame([(t, lang, 1, 2) for t, lang in rows], "text string, lang string, n int, phrase int")
    got = {tuple(x) for x in collocations.mine(frame, least=5, top=top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}
    assert got == plain_phrases(rows, 5, top)


def test_phrases_of_no_rows(spark):
    assert collocations.mine(spark.createDataFrame([], "text string, lang string")).count() == 0


def test_scores_pass_64_bits(spark):
    huge = 2 * 10**15
    row = spark.createDataFrame([(huge, 3 * huge)], "a bigint, m bigint").select(collocations._ratio(F.col("a"), F.col("m")).alias("s")).first()
    assert row.s == 2000000 * huge // (3 * huge)


# --- 12 ----------------------------------------------------------------------------------------------------------------


def plain_negatives(rows, is_anchor, positives=5, negatives=3):
    fit = []
    for i, vector, label in rows:
        if i is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        fit.append((i, [math.floor(256 * x) for x in vector], label))
    out = []
    for i, v, label in fit:
        if not is_anchor(i):
            continue
        pairs = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j, m) for j, w, m in fit if j != i)
        for s, j, _ in [x for x in pairs if x[2] == label][:positives]:
            window = [(k, t) for t, k, m in pairs if m != label and 50 * -s <= 100 * -t <= 95 * -s]
            out += [(i, j, rank, k, -s, -t) for rank, (k, t) in enumerate(window[:negatives], 1)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id bigint, embedding array<float>, label int, score int, block int")


@pytest.mark.parametrize("case", ["plain", "ties", "zeros", "hot"])
def test_negatives_equal_all_pairs(spark, case):
    r = random.Random(case)
    draw = {"plain": lambda: r.uniform(-1, 1), "ties": lambda: r.choice((0, 0.5, 1)), "zeros": lambda: r.choice((0, 0, 0, 1, -1)), "hot": lambda: r.uniform(0, 1)}[case]
    rows = [(i, [float(draw()) for _ in range(4)], 1 if case == "hot" and i % 3 else r.randrange(4)) for i in range(300)]
    rows += [(400, [0.5, None, 0.0, 0.0], 1), (401, [float("nan")] * 4, 1), (402, [float("inf"), 0.0, 0.0, 0.0], 2), (403, None, 1), (404, [0.5] * 4, None), (None, [0.5] * 4, 1), (410, [], 1), (411, [0.5, 0.5], 2), *rows[20:30]]
    got = hard_negatives.mine(vectors(spark, rows).repartition(5), F.col("vec_id") % 10 == 0, rows=37, anchor_rows=7)
    assert sorted(tuple(x) for x in got.collect()) == plain_negatives(rows, lambda i: i % 10 == 0)


def test_huge_components_stay_exact(spark):
    rows = [(0, [4e9, 1.0], 1), (1, [4e9, 2.0], 1), (2, [3e9, 5.0], 2), (3, [2.5e9, 1.0], 2)]
    a, b = (np.array([[math.floor(256 * x) for x in v]], float) for v in ([5e5, 1.0], [5e5, 5.0]))
    assert hard_negatives.products(a, b)[0, 0] == (256 * 500000) ** 2 + 256 * 1280
    assert hard_negatives.mine(vectors(spark, rows), F.col("vec_id") == 0).count() >= 0
    assert hard_negatives.products(a * 1e9, b * 1e9)[0, 0] == hard_negatives.MOST


def test_negatives_of_no_rows(spark):
    assert hard_negatives.mine(vectors(spark, []), F.col("vec_id") % 10 == 0).count() == 0
    assert hard_negatives.mine(vectors(spark, [(10, [1.0], 1)]), F.col("vec_id") % 10 == 0).count() == 0


# --- 13 ----------------------------------------------------------------------------------------------------------------


def weighted(counts, depth):
    """ln of the weighted probability of the root of each node, by the definition: counts[(context bytes, node)] -> [zeros, ones]."""
    kids = defaultdict(set)
    for context, node in counts:
        if context:
            kids[(context[1:], node)].add(context)

    def estimate(a, b):
        return sum(math.log((i + 0.5)) for i in range(a)) + sum(math.log((i + 0.5)) for i in range(b)) - sum(math.log(i + 1) for i in range(a + b))

    def prob(context, node):
        own = estimate(*counts[(context, node)])
        if len(context) == depth:
            return own
        below = sum(prob(c, node) for c in kids[(context, node)])
        top = max(own, below)
        return top + math.log(0.5 * math.exp(own - top) + 0.5 * math.exp(below - top))

    return lambda node: prob(b"", node)


def add(counts, text, depth, only=None):
    whole = bytes([0xFE] * depth) + text + b"\xff"
    for i in range(depth, len(whole)):
        for j in range(8):
            node, bit = (1 << j) | whole[i] >> (8 - j), whole[i] >> (7 - j) & 1
            if only is None or (i - depth, j) == only:
                for d in range(depth + 1):
                    counts[(whole[i - d : i], node)][bit] += 1
                if only is not None:
                    return node


def test_conditionals_are_ratios_of_weighted_probabilities(spark):
    """The probability of a bit is what adding it does to the weighted probability of all."""
    depth, learned, other = 2, [b"abab abc", b"abba", b"caab abab"], b"abca"
    counts = defaultdict(lambda: [0, 0])
    for t in learned:
        add(counts, t, depth)
    total = 0.0
    for i in range(len(other) + 1):
        for j in range(8):
            more = defaultdict(lambda: [0, 0], {k: list(v) for k, v in counts.items()})
            node = add(more, other, depth, (i, j))
            seen = (b"", node) in counts
            total += weighted(more, depth)(node) - (weighted(counts, depth)(node) if seen else 0.0)
    rows = [(k, t.decode(), False) for k, t in enumerate(learned)] + [(9, other.decode(), True)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, h boolean")
    got = {r.doc_id: r for r in context_tree.scores(frame, held=F.col("h"), depth=depth, chunk_bytes=9).collect()}
    shuffled = {r.doc_id: r for r in context_tree.scores(frame, held=F.col("h"), depth=depth, chunk_bytes=9, broadcast_runs=0).collect()}
    assert all(got[k].score == pytest.approx(shuffled[k].score, rel=1e-12) and got[k].base_score == pytest.approx(shuffled[k].base_score) for k in got)
    assert got[9].score == pytest.approx(total / math.log(10), rel=1e-9)
    assert got[9].bits_per_byte == pytest.approx(-total / math.log(2) / (len(other) + 1))


def test_probabilities_of_all_next_bytes_add_up(spark):
    texts = ["the cat sat on the mat", "the dog sat", "é漢 the"]
    runs = Counter(x for t in texts for x in context_tree.runs_of(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]), 3)[0].tolist())
    context = b"he "
    all_next = [int.from_bytes(context + bytes([x]), "big") for x in range(256)]
    frame = spark.createDataFrame([(x, runs.get(x, 0)) for x in {*runs, *all_next}], "run bigint, n bigint")
    got = {r.run: r.value for r in context_tree.log_probabilities(frame, 3).collect()}
    assert sum(math.exp(got[x]) for x in all_next) == pytest.approx(1.0, abs=1e-9)
    assert got[int.from_bytes(b"he c", "big")] > got[int.from_bytes(b"he z", "big")]


def plain_base(rows):
    def words(t):
        return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [""]

    def held(i):
        return i is not None and zlib.crc32(str(i).encode()) % 7 == 2

    c = Counter(w for i, t in rows if not held(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    return sorted((str(i), held(i), len(words(t)), sum(c[w] > 0 for w in words(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(t)), 6)) for i, t in rows)


def test_base_scores_and_odd_rows(spark):
    r = random.Random(5)
    words = ["Alpha", "beta", "é", "漢字", "gamma-1", "x" * 300, " "]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 60)))) for i in range(60)] + [(None, "beta beta"), (None, None), (7, None), (8, ""), (9, " \t\n"), (900, "beta " * 5000), (900, "beta " * 5000)]
    frame = spark.createDataFrame([(i, t, 1, 2.0) for i, t in rows], "doc_id bigint, text string, chunk int, score double").repartition(3)
    got = context_tree.scores(frame, chunk_bytes=2000).collect()
    assert sorted((str(x.doc_id), x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6)) for x in got) == plain_base(rows)
    assert all(x.score < 0 and math.isfinite(x.score) for x in got)
    same = [x.score for x in got if x.doc_id == 900]
    assert len(same) == 2 and same[0] == pytest.approx(same[1])


def test_scores_without_training_rows_or_rows(spark):
    assert context_tree.scores(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    got = context_tree.scores(spark.createDataFrame([(1, "ab")], "doc_id bigint, text string"), held=F.lit(True)).first()
    assert got.score == pytest.approx(24 * math.log10(0.5)) and got.base_score == 0 and got.n_known == 0 and got.train_tokens == 0


def test_held_out_code_length_beats_uniform_and_shallow(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    deep = registry.op13_context_tree(spark, "/root/testdata/sf0.001").where("held_out").agg(F.sum("score"), F.sum("n_bytes")).first()
    flat = context_tree.scores(frame, depth=1).where("held_out").agg(F.sum("score")).first()
    bits = -deep[0] / deep[1] / math.log10(2)
    assert bits < 4 and deep[0] > flat[0]
