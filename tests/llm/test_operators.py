"""Training-data operators against brute force, and on odd tables: nulls, empty and long texts, ties, repeated rows, no rows and clashing names."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenfield.llm import common, components, imatch, near_dup, packing, pii, quality, registry, segment, sharding, suffix, toxicity, warc
from lumenfield.llm.common import shared_folder

WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "ru", "sa", "te", "vo") for b in ("r", "nd", "sh", "ble", "ing", "x", "th", "a")]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def rich(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(n))


LONG = prose(6000, 99)
ODD = [
    (1, prose(120, 1)), (2, prose(120, 1)), (3, None), (4, ""), (5, " \n\t "), (6, LONG), (7, LONG[:9000] + " changed " + LONG[9010:]), (None, prose(80, 7)), (None, None), (8, prose(60, 8) + " é ▁ 漢字 \U0001f600"), (8, prose(60, 8) + " é ▁ 漢字 \U0001f600"),
    (9, "mail a.b@c.de or 4111 1111 1111 1111, +1 (555) 123-4567, 10.0.0.1 and 999.1.1.1"), (10, "x" * 700), (11, (prose(30, 3) + "\n") * 6),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "kept", 5, "z") for i, t in rows], "doc_id bigint, text string, failed_rule string, n_chars bigint, rid string")


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD).persist()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, []).persist()


# --- 5 -----------------------------------------------------------------------------------------------------------------


def base_measures(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    seen, covered = Counter(grams), set()
    for k, g in enumerate(grams):
        if seen[g] > 1:
            covered |= {k, k + 1, k + 2}
    lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_quality(spark, odd, none):
    got = sorted(tuple(r)[1:7] for r in quality.quality_report(odd).collect())
    assert got == sorted(base_measures(t) for _, t in ODD)
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns
    assert kept.count() == quality.quality_report(odd).where("kept").count()
    assert quality.quality_report(none).count() == quality.keep_good(none).count() == 0


def test_rule_order():
    cost = {"words": 4.0, "lines": 1.0, "n_words": 0.1, "n_repeat_words": 9.0, "n_symbols": 1.0, "n_shouts": 1.0, "n_lines": 0.1, "n_dup_lines": 0.5, "word_chars": 0.5}
    hits = {"duplicate_lines": range(0, 30), "symbols": range(0, 25), "too_short": range(40, 60), "repeated_windows": range(30, 45)}
    verdicts = [{r.name: k in hits.get(r.name, ()) for r in quality.RULES} for k in range(100)]
    got = quality.order_rules(quality.RULES, cost, verdicts)
    # Lines first (30 for 1.6 s); the symbols' rejections are all among those, so words are bound for the short ones.
    assert [c.rule.name for c in got][:3] == ["duplicate_lines", "too_short", "repeated_windows"]
    assert abs(got[0].rejected - 0.3) < 1e-9 and abs(got[1].seconds - 4.1) < 1e-9 and abs(got[2].rejected - 10 / 50) < 1e-9


def test_rejections_are_counted_over_all_rows(spark):
    rows = [(i, prose(60, i) if i % 4 else "short") for i in range(400)]
    _, verdicts, counts = quality.measure_rules(frame(spark, rows), sample_rows=5)
    assert sum(counts) == 400 and sum(n for v, n in zip(verdicts, counts, strict=True) if v["too_short"]) == 100


def test_quality_verdict_against_a_plain_one(spark):
    r = random.Random(8)
    pieces = (prose(60, 1), "!! !! !!", "# $ % #", "a b c d e f", "same line\nsame line\n", "x" * 90, prose(15, 2) + "\n", " ")
    rows = [(i, "".join(r.choice(pieces) + " " for _ in range(r.randrange(1, 9)))) for i in range(300)]

    def keeps(t):
        n, chars, symbols, dup, _, failed = base_measures(t)
        lines = len([x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")])
        return not (failed or 10 * symbols > 3 * n or 10 * t.count("!!") > 3 * n or 100 * dup > 50 * lines or chars < 2 * n or chars > 20 * n)

    got = {x["doc_id"]: x["kept"] for x in quality.quality_report(frame(spark, rows)).collect()}
    assert got == {i: keeps(t) for i, t in rows} and 20 < sum(got.values()) < 280
    assert {x["doc_id"] for x in quality.keep_good(frame(spark, rows)).collect()} == {i for i, k in got.items() if k}


# --- 3 -----------------------------------------------------------------------------------------------------------------


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_band_and_chain_against_dynamic_programming():
    r = random.Random(4)
    for _ in range(60):
        a = [r.randrange(6) for _ in range(r.randrange(1, 30))]
        b = [x for x in a if r.random() > 0.1] + [r.randrange(6) for _ in range(r.randrange(4))]
        x, y = (np.array(v, np.uint64) for v in (a, b))
        d = edits(a, b)
        for most in range(0, 12):
            assert near_dup.within_band(x, y, most) == (d <= most)
        assert near_dup.chained_distance(x, y) >= d


def test_equal_texts_have_one_node(spark):
    texts = [prose(n, n) for n in (3, 50, 200)]
    rows = [(k, texts[k % 3] if k % 2 else f"  {texts[k % 3]} \n") for k in range(60)]
    got = near_dup.sketch(frame(spark, rows).repartition(1)).select("n", "one", "two").distinct().count()
    assert got == 3


def test_near_duplicates(spark, odd, none):
    got = [(r["doc_id"], r["class_id"]) for r in near_dup.near_duplicates(odd).collect()]
    assert len(got) == len(ODD)
    named = dict(got)
    assert named[1] == named[2] == 1 and named[6] == named[7] == 6 and named[3] == named[4] == named[5] == 3 and named[None] is None
    assert named[9] == 9 and named[10] == 10
    kept = near_dup.keep_one(odd)
    assert kept.columns == odd.columns and sorted(x["doc_id"] or 0 for x in kept.collect()) == [0, 0, 1, 3, 6, 8, 8, 9, 10, 11]
    assert near_dup.near_duplicates(none).count() == 0


def test_a_large_family_and_a_shared_passage(spark):
    r = random.Random(5)
    words = prose(300, 50).split()
    rows = []
    for i in range(150):
        w = list(words)
        for _ in range(4):
            w[r.randrange(300)] = f"w{i}"
        rows.append((i, " ".join(w)))
    passage = prose(40, 51)
    rows += [(1000 + i, prose(60, 600 + i) + " " + passage) for i in range(120)]
    named = {x["doc_id"]: x["class_id"] for x in near_dup.near_duplicates(frame(spark, rows)).collect()}
    assert {named[i] for i in range(150)} == {0}
    assert all(named[i] == i for i in range(1000, 1120))


def plain_links(rows):
    """All pairs with an edit similarity of 0.8: a bound from counts of words, then the alignment."""
    words = [np.array([hash(w) for w in t.split()], np.int64).view(np.uint64) for _, t in rows]
    n = np.array([len(w) for w in words])
    counts = np.stack([np.bincount((w % np.uint64(509)).astype(np.int64), minlength=509) for w in words]).astype(np.int32)
    out = []
    for i in range(len(rows)):
        apart = np.abs(counts[i + 1 :] - counts[i]).sum(1) + np.abs(n[i + 1 :] - n[i])
        for j in np.flatnonzero(apart <= 2 * np.floor(0.2 * np.maximum(n[i + 1 :], n[i]) + 1e-9)) + i + 1:
            if near_dup.similar(words[i], words[j]):
                out.append((rows[i][0], rows[j][0]))
    return out


def plain_classes(spark, rows):
    """Classes of the link rule, every pair of texts looked at: a sketch in common and an edit similarity of 0.8."""
    sketches = {r["id"]: set(r["sketches"]) for r in near_dup.sketch(frame(spark, rows)).collect()}
    label = {i: i for i, _ in rows}
    for i, j in plain_links(rows):
        if sketches[i] & sketches[j]:
            old, new = max(label[i], label[j]), min(label[i], label[j])
            label = {k: new if v == old else v for k, v in label.items()}
    return label


def edited(words, places, tag):
    w = list(words)
    for k in places:
        w[k] = f"{tag}w{k}"
    return w


def test_a_match_of_one_member_of_a_large_class(spark):
    # All share a passage of 80 words. 100 texts match the center; each of 40 others matches only its own one of them.
    passage, tail = prose(80, 70).split(), prose(40, 71).split()
    rows = []
    for i in range(100):
        own = edited(tail, random.Random(i).sample(range(40), 18 if i < 40 else 1), f"a{i}")
        rows.append((i, " ".join(passage + own)))
        if i < 40:
            kept = [k for k in range(40) if own[k] == tail[k]]
            rows.append((1000 + i, " ".join(passage + edited(own, random.Random(i).sample(kept, 20), f"b{i}"))))
    named = {x["doc_id"]: x["class_id"] for x in near_dup.near_duplicates(frame(spark, rows)).collect()}
    assert named == plain_classes(spark, rows)
    assert sum(named[1000 + i] == 0 for i in range(40)) > 20


def test_pairs_that_meet_in_large_buckets_only(spark):
    # Of 200 texts with one passage, two each match: all five-word shingles outside of the passage differ.
    passage = prose(110, 80).split()
    rows = []
    for i in range(100):
        tail = rich(40, 900 + i).split()
        rows += [(2 * i, " ".join(passage + tail)), (2 * i + 1, " ".join(passage + edited(tail, range(0, 40, 4), f"c{i}")))]
    named = {x["doc_id"]: x["class_id"] for x in near_dup.near_duplicates(frame(spark, rows)).collect()}
    assert named == plain_classes(spark, rows)
    assert sum(named[2 * i + 1] == 2 * i for i in range(100)) > 80


def test_blocks_of_one_bucket(spark):
    # One passage in 500 texts, and pairs of them that match each other but not the center, in blocks of 50.
    passage = prose(100, 81).split()
    rows = []
    for i in range(250):
        tail = rich(60, 2000 + i).split()
        rows += [(2 * i, " ".join(passage + tail)), (2 * i + 1, " ".join(passage + edited(tail, range(0, 60, 4), f"d{i}")))]
    docs = frame(spark, rows)
    nodes = near_dup.sketch(docs).select("id", "n", "sketches", "bag", "marks").persist()
    assert max(r["count"] for r in nodes.select(F.explode("sketches").alias("s")).groupBy("s").count().collect()) > 400
    got = {tuple(sorted(r)) for r in near_dup.links(nodes, docs, doc_id="doc_id", text="text", block=50).collect()}
    assert got == {(2 * i, 2 * i + 1) for i in range(250)}


def test_members_of_many_open_buckets_are_one_row(spark, monkeypatch):
    # Texts that share a passage share many sketches: each meets its counts once a round, and a group has it once.
    passage = prose(110, 80).split()
    rows = [(i, " ".join(passage + rich(40, 7000 + i).split())) for i in range(60)]
    met, found = [], near_dup._pairs

    def counted(held, *args, **more):
        met.append((held.count(), held.select("member").distinct().count()))
        return found(held, *args, **more)

    monkeypatch.setattr(near_dup, "_pairs", counted)
    assert near_dup.near_duplicates(frame(spark, rows)).where("class_id <> doc_id").count() == 0
    assert met and all(a == b > 40 for a, b in met)


def test_screen_meets_each_pair_once(spark):
    docs = frame(spark, [(i, prose(40 + i % 3, 3)) for i in range(20)])
    keys = near_dup.sketch(docs).select("id", "n", "bag", F.xxhash64("id").alias("turn"))
    centers = keys.where("id < 4").select("turn")
    pairs = keys.where("id >= 4").select(F.col("id").alias("member")).crossJoin(centers).crossJoin(spark.range(5)).select("turn", "member")
    got = near_dup.screen(pairs, keys, similarity=0.8).collect()
    assert all(r["likely"] for r in got)
    assert sorted((r["center"], r["member"]) for r in got) == [(c, m) for c in range(4) for m in range(4, 20)]


def test_pairs_of_shared_groups_are_told_from_others():
    r = np.random.default_rng(4)
    lists = [r.choice(40, r.integers(0, 9), replace=False) - 20 for _ in range(300)]
    sets = near_dup.earlier(pa.array([x.tolist() for x in lists], pa.list_(pa.int64())), 5)
    x, y = (v.ravel() for v in np.triu_indices(300, 1))
    own = [{v for v in one.tolist() if v < 5} for one in lists]
    assert near_dup.share_any(sets, x, y).tolist() == [bool(own[i] & own[j]) for i, j in zip(x, y, strict=True)]


def test_likely_among_keeps_all_that_are_asked_for(spark):
    rows = spark.range(-3000, 3000).withColumn("t", F.col("id").cast("string"))
    kept = {v["id"] for v in common.likely_among(rows, "id", spark.range(0, 3000, 7).select(F.col("id").alias("k"))).collect()}
    assert kept >= set(range(0, 3000, 7)) and len(kept) < 500
    assert common.likely_among(rows, "t", rows.select("t")).count() == 6000
    assert common.likely_among(rows, "id", rows.where("id is null").select("id")).count() == 0


def test_recall_by_edit_similarity(spark):
    # 1,000 planted pairs: substitutions, omissions and insertions in random places.  Links by brute force over all pairs.
    r = random.Random(12)
    rows, band = [], {}
    for i in range(1000):
        n, similarity = r.choice((30, 80, 150, 400)), (0.80, 0.82, 0.85, 0.90, 0.95, 0.99)[i % 6]
        a = rich(n, 5000 + i).split()
        b = list(a)
        for k in r.sample(range(n), int((1 - similarity) * n + 1e-9)):
            kind = r.random()
            b[k] = "" if kind < 0.15 else b[k] + f" i{k}" if kind < 0.3 else f"s{k}"
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
        band[2 * i] = similarity
    found = {x["doc_id"]: x["class_id"] for x in near_dup.near_duplicates(frame(spark, rows)).collect()}
    real = plain_links(rows)
    assert len(real) >= 950
    recall = {s: np.mean([found[i] == found[j] for i, j in real if band[i - i % 2] == s]) for s in sorted(set(band.values()))}
    print({s: round(float(v), 3) for s, v in recall.items()})
    assert min(recall.values()) >= 0.9
    linked = {frozenset(p) for p in real}
    assert all(frozenset((2 * i, 2 * i + 1)) in linked for i in range(1000) if found[2 * i] == found[2 * i + 1])
    assert all(found[i] in (i, i - i % 2) for i, _ in rows)


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100), (200, 201), (None, 3)]
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(pairs, "a int, b int")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 200: 200, 201: 200}


# --- 6 -----------------------------------------------------------------------------------------------------------------


def removed(rows, length=200):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(b[s : s + length] for b in raw for s in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("options", [{}, {"hot_fragments": 1}, {"batch_bytes": 1}])
def test_suffix_repeats(spark, odd, options):
    got = sorted(tuple(r)[1:] for r in suffix.repeats(odd, **options).collect())
    assert got == sorted(removed(ODD))


def test_suffix_empty_and_text(spark, odd, none):
    assert suffix.repeats(none).count() == 0
    out = suffix.remove_repeats(odd)
    assert out.columns == odd.columns and out.count() == len(ODD)
    assert {len(r["text"] or "") for r in out.where("doc_id = 1").collect()} == {0}


# --- 2 -----------------------------------------------------------------------------------------------------------------

KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0
    return kind == "email" or 8 <= len(d) <= 15


def base_spans(t):
    return [(k, m.start(), m.end()) for k, p in KINDS.items() for m in re.finditer(p, t) if passes(k, m.group())]


TRICKY = ["a@b.c_d@e.f", "a@b..c x@y.z.", "\U0001f600 é 1.2.3.4.5.6.7.8 0001.02.3.255 256.1.1.1", "4111-1111 1111-1111 5 +12((345)) 678-90.1", "@@a@a.b@c.d", "+1+2 345 6789++49 (0)30 123456", "1" * 400 + "." + "2." * 50, "a" * 3000 + "@" + "b" * 10, ""]


def test_pii_base(spark, odd):
    rows = [(100 + i, t) for i, t in enumerate(TRICKY)] + ODD
    got = {(r["doc_id"], r["base_sha256"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in pii.report(frame(spark, rows)).collect()}
    want = set()
    for i, t in rows:
        s = base_spans(t or "")
        want.add((i, hashlib.sha256(",".join("%s:%d:%d" % x for x in s).encode()).hexdigest(), *(sum(x[0] == k for x in s) for k in KINDS)))
    assert got == want


def test_pii_learns_and_redacts(spark, odd, none):
    r = random.Random(6)
    number = lambda: f"{r.randrange(200, 999)}) {r.randrange(200, 999)}-{r.randrange(1000, 9999)}"
    rows = [(i, f"{prose(20, i)} call me +1 ({number()} {prose(5, i)} ref 12345678901234{i % 10}x{prose(9, i)}") for i in range(300)]
    rows += [(1000 + i, f"{prose(20, i)} call me ({number()} {prose(5, i)}") for i in range(20)]
    found = {x["doc_id"]: x for x in pii.report(frame(spark, rows)).collect()}
    assert sum(found[1000 + i]["n_added"] > 0 for i in range(20)) >= 15
    out = pii.redact(odd)
    assert out.columns == odd.columns and out.count() == len(ODD)
    assert out.where("doc_id = 9").collect()[0]["text"] == "mail [EMAIL] or [CARD], [PHONE], [IP] and 999.1.1.1"
    assert pii.report(none).count() == pii.redact(none).count() == 0


def test_pii_learns_from_all_proposals(spark, monkeypatch):
    rows = spark.range(24_000).selectExpr("'phone' as kind", "concat('555-', id) as match", "concat(id, ' call ') as left", "'' as right", "cast(id % 2 as double) as label")
    seen, features = [], pii.features
    monkeypatch.setattr(pii, "features", lambda r: seen.append(r.count()) or features(r))
    assert pii.learn(rows) is not None and seen == [24_000]


def test_pii_proposals_overlap(spark):
    texts = ["555 123 4567 555 987 6543", "2024-05-01 555-123-4567", "4111.1111.1111.1111 555-123-4567", "10:0:0:1", "who (AT) mail (DOT) org", "x555-123-4567"]
    got = {}
    for r in pii.candidates(frame(spark, list(enumerate(texts)))).where("not base").join(frame(spark, list(enumerate(texts))).select(pii.row_key("doc_id", "text").alias("rid"), "doc_id"), "rid").collect():
        got.setdefault(r["doc_id"], set()).add((r["kind"], r["match"]))
        assert texts[r["doc_id"]][r["start"] : r["end"]] == r["match"]
    assert {("phone", "555 123 4567"), ("phone", "555 987 6543")} <= got[0]
    assert ("phone", "555-123-4567") in got[1]
    assert {("card", "4111.1111.1111.1111"), ("phone", "555-123-4567")} <= got[2]
    assert got[3] == {("ip", "10:0:0:1")} and ("email", "who (AT) mail (DOT) org") in got[4]
    assert ("phone", "555-123-4567") not in got.get(5, set())  # glued to a letter


def test_pii_apart_leaves_no_overlap(spark):
    r = random.Random(2)
    rows = [("a" if i % 3 else "b", "phone", s := r.randrange(400), s + r.randrange(1, 30), r.random()) for i in range(300)]
    kept = pii.apart(spark.createDataFrame(rows, "rid string, kind string, start int, end int, score double")).collect()
    for rid in "ab":
        own = sorted((x["start"], x["end"]) for x in kept if x["rid"] == rid)
        assert len(own) >= 8 and all(a[1] <= b[0] for a, b in itertools.pairwise(own))


@pytest.mark.parametrize("case", ["falling", "rising", "random", "equal"])
def test_pii_apart_takes_the_best_first(spark, case):
    r = random.Random(4)
    if case in ("falling", "rising"):  # a chain in which each span overlaps the next only
        rows = [("a", "phone", 10 * i, 10 * i + 12, (i if case == "rising" else 24 - i) / 30) for i in range(24)]
    else:
        rows = [(r.choice("ab"), r.choice(("phone", "card")), s := r.randrange(600), s + r.randrange(1, 30), 0.5 if case == "equal" else r.random()) for _ in range(300)]
    want = []
    for x in sorted(set(rows), key=lambda x: (x[4], x[3] - x[2], -x[2], x[1]), reverse=True):
        if not any(y[0] == x[0] and y[2] < x[3] and x[2] < y[3] for y in want):
            want.append(x)
    kept = pii.apart(spark.createDataFrame(rows, "rid string, kind string, start int, end int, score double"))
    assert sorted(tuple(x) for x in kept.collect()) == sorted(want)
    assert case not in ("falling", "rising") or len(want) == 12


# --- 9 -----------------------------------------------------------------------------------------------------------------


def test_pack_spreads_equal_rows(spark):
    rows = spark.range(60_000).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    sizes = [x["count"] for x in packing.pack(rows).groupBy("shard").count().collect()]
    assert len(sizes) == 3 and sum(sizes) == 60_000 and max(sizes) < 1.2 * min(sizes)


def plain_pack(lengths, sizes, cost):
    bins, where, left = [], [], sum(lengths)
    for n in lengths:
        fits = [(c - u, k) for k, (c, u) in enumerate(bins) if c - u >= n]
        if fits:
            k = min(fits)[1]
        else:
            bins.append([min((c for c in sizes if c >= n), key=lambda c: (cost(c) / min(c, left), c)), 0])
            k = len(bins) - 1
        bins[k][1] += n
        left -= n
        where.append(k)
    return where, [min(c for c in sizes if c >= u) for _, u in bins]


def test_packing_equals_plain_best_fit():
    r = random.Random(8)
    for _ in range(20):
        lengths = sorted((r.randrange(1, 65) for _ in range(r.randrange(1, 120))), reverse=True)
        where, _, final = packing.pack_lengths(lengths, (16, 32, 64))
        assert (where, final) == plain_pack(lengths, (16, 32, 64), packing.attention_cost)


def test_packing(spark, odd, none):
    rows = packing.pack(odd, capacities=(64, 256), pieces_per_shard=10).collect()
    assert sum(r["n_tokens"] for r in rows) == sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) + 1 for _, t in ODD)
    for _, own in itertools.groupby(sorted(rows, key=lambda r: (r["shard"], r["bin"], r["bin_offset"])), key=lambda r: (r["shard"], r["bin"])):
        own, at = list(own), 0
        for r in own:
            assert r["bin_offset"] == at
            at += r["n_tokens"]
        assert at <= own[0]["capacity"] and (at > 64 or own[0]["capacity"] == 64)
    assert packing.pack(none).count() == 0


def test_packing_several_lengths_cost_less_than_one():
    r = random.Random(11)
    for _ in range(10):
        lengths = sorted((min(4096, int(r.lognormvariate(5.5, 1.2)) + 1) for _ in range(400)), reverse=True)
        together = sum(packing.attention_cost(c) for c in packing.pack_lengths(lengths)[2])
        single = [sum(packing.attention_cost(c) for c in packing.pack_lengths(lengths, (c,))[2]) for c in packing.CAPACITIES if c >= lengths[0]]
        assert together <= min(single)


def test_packing_of_one_id(spark):
    rows = [(None if i % 2 else 7, prose(30, i)) for i in range(2000)]
    got = packing.pack(frame(spark, rows), pieces_per_shard=200).groupBy("shard").count().collect()
    assert len(got) == 10 and max(r["count"] for r in got) < 300


# --- 8 -----------------------------------------------------------------------------------------------------------------


def test_sharding(spark, odd, none):
    table = sharding.load_in_arrivals(odd, shared_folder(spark), arrivals=3, target_bytes=1 << 16, fan_in=2)
    assert sorted(map(str, table.read().collect())) == sorted(map(str, odd.collect()))
    version = table.append(odd.limit(2))
    assert table.read(version - 1).count() == len(ODD) and table.read().count() == len(ODD) + 2
    with pytest.raises(sharding.CommitConflict):
        table._publish(table.manifest().limit(0).withColumn("gone", F.lit(False)), version)
    assert sharding.load_in_arrivals(none, shared_folder(spark)).read().count() == 0


def test_tiers_sizes_and_lost_writers(spark):
    docs = frame(spark, [(i, rich(400, i)) for i in range(240)])
    table = sharding.ShardTable(spark, shared_folder(spark), docs.schema, 400 << 10, 4)
    files = lambda: {r["path"]: (r["bytes"], r["version"]) for r in table.manifest().collect()}
    seen = {}
    for k in range(12):
        table.append(docs.where(F.col("doc_id") % 12 == k).repartition(2))
        table.compact()
        now = files()
        assert all(seen[p] == v for p, v in now.items() if p in seen)  # no shard is changed
        seen |= now
        tiers = Counter(r["tier"] for r in table.manifest().collect() if r["bytes"] < 200 << 10)
        assert all(n < 4 for n in tiers.values())
        assert table.read().count() == 20 * (k + 1)
    assert len(files()) < 10 < len(seen) and max(b for b, _ in files().values()) < 800 << 10
    # A writer that is lost before its commit leaves files that no reader sees.
    before = table.latest()
    docs.write.parquet(f"{table.root}/shards/lost")
    table.manifest().limit(1).write.json(f"{table.root}/staged/lost")
    assert table.latest() == before and table.read().count() == 240
    old = table.read(before - 1).count()
    assert table.vacuum(keep_versions=2) > 0 and table.read().count() == 240 and table.read(before - 1).count() == old
    assert not table._fs().exists(table._path(f"{table.root}/shards/lost"))


# --- 10 ----------------------------------------------------------------------------------------------------------------


def test_fingerprints(spark, odd, none):
    rows = [(i, t) for i, t in ODD if i is not None and i != 8] + [(50 + i, rich(150, 300 + i)) for i in range(40)]
    got = {r["doc_id"]: r for r in imatch.fingerprints(frame(spark, rows), part_bytes=20_000).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        t, after = t or "", after or ""
        k = len(t) // 3
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), hashlib.sha256((t[: len(t) - k] + after[:k]).encode()).hexdigest())
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    assert got[1]["fingerprint"] == got[2]["fingerprint"] and got[2]["near_next"] == 1.0 and got[3]["fingerprint"] == got[4]["fingerprint"]
    wins = [got[50 + i]["near_edited"] > got[50 + i]["near_next"] for i in range(40)]
    assert sum(wins) >= 36
    assert imatch.fingerprints(odd).count() == len(ODD) and imatch.fingerprints(none).count() == 0


def test_document_frequencies_are_exact(spark):
    rows = [(i, prose(30, i)) for i in range(200)]
    words, n, _ = imatch.lexicon(frame(spark, rows).repartition(7), least=0.2, most=0.5)
    count = Counter(w for _, t in rows for w in set(t.split()))
    assert n == 200 and len(words) == sum(40 <= c <= 100 for c in count.values())


def test_likeness_against_sets_of_terms():
    texts = [rich(n, 70 + n) for n in (5, 40, 200)] + ["", "kar lond", rich(200, 270)]
    texts += [" ".join(rich(120, 7).split()[:80] + rich(40, k).split()) for k in (8, 9)] + [texts[1].upper()]
    terms = [set(t.lower().split()) for t in texts]
    number = lambda w: imatch.tokens.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0][0]
    lexicon = {w for t in terms for w in t if number(w) % 3}
    words = np.sort(np.array([number(w) for w in lexicon], np.uint64))
    prints = imatch._prints(texts, words)
    named = imatch.names(prints)

    def subsets(own):
        for s in range(imatch.SEEDS):
            for level in range(imatch.LEVELS):
                mix = imatch.tokens.mix
                yield frozenset(w for w in own & lexicon if int(mix(np.array([number(w)]) ^ mix(np.array([977 + s], np.uint64)))[0]) < 1 << (64 - level))

    held = [list(subsets(t)) for t in terms]
    for i, j in itertools.product(range(len(texts)), repeat=2):
        some = [(x, y) for x, y in zip(held[i], held[j]) if x or y]
        want = sum(x == y for x, y in some) / len(some) if some else float(terms[i] == terms[j])
        one, two = (tuple(p[[k]] for p in prints) for k in (i, j))
        assert math.isclose(imatch.likeness(one, two)[0], want)
        assert (named[i] == named[j]) == (held[i] == held[j] and (bool(some) or terms[i] == terms[j]))


def test_fingerprints_of_ids_that_are_no_numbers(spark, odd):
    named = odd.withColumn("doc_id", F.concat(F.lit("document-"), F.col("doc_id").cast("string")))
    got = imatch.fingerprints(named, part_bytes=4000).collect()
    assert len(got) == len(ODD)
    order = sorted([(f"document-{i}", t or "") for i, t in ODD if i is not None], reverse=True)
    after = {i: t for (i, _), (_, t) in itertools.pairwise(order)}
    texts = dict(order)
    for r in got:
        if r["doc_id"] in after and r["doc_id"] != "document-8":
            t = texts[r["doc_id"]]
            assert r["edited_sha256"] == hashlib.sha256(imatch.edited(t, after[r["doc_id"]]).encode()).hexdigest()


# --- 7 -----------------------------------------------------------------------------------------------------------------


def test_toxicity(spark, odd, none):
    rows = [(i, prose(80, i) + (" zzgrub zzgrub " if i % 4 == 0 else " ") + prose(40, i + 9000)) for i in range(400)]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(None, 1), (1, None)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.scores(docs, model).collect()
    assert all(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in got if r["held_out"]) and any(r["held_out"] for r in got)
    assert toxicity.scores(odd, model).where("score is null").count() == 0 and toxicity.scores(none, model).count() == 0
    blank = toxicity.train(docs, labels.where("1 = 0"))
    assert {r["score"] for r in toxicity.scores(odd, blank).collect()} == {0.5}


def plain_toxicity(texts, toxic, unseen, penalty=1.0):
    """The same model with dictionaries of character runs and Newton steps over dense rows."""

    def runs(t):
        low = re.sub("[\t-\r]", " ", t.lower())
        return {low[k : k + n] for n in (3, 4, 5) for k in range(len(low) - n + 1)}

    sets = [runs(t) for t in texts]
    bad, good = (Counter(x for s, y in zip(sets, toxic) if y == v for x in s) for v in (1, 0))
    names = sorted(x for x in bad | good if bad[x] + good[x] >= 3)
    every = set(bad) | set(good)
    empty = (1 << toxicity.BITS) - len(every)
    all_bad, all_good = (sum(c.values()) + len(every) + empty for c in (bad, good))
    ratio = np.array([math.log((bad[x] + 1) / all_bad) - math.log((good[x] + 1) / all_good) for x in names])
    rows = lambda ss: np.array([[x in s for x in names] for s in ss], float) * ratio
    x, y = rows(sets), np.array(toxic, float)
    n, w, b = len(y), np.zeros(len(names)), 0.0
    for _ in range(60):
        e = 1 / (1 + np.exp(-(x @ w + b)))
        s = e * (1 - e) + 1e-12
        full = np.hstack([x, np.ones((n, 1))])
        hess = full.T @ (full * s[:, None]) / n + np.diag([penalty / n] * len(names) + [0.0])
        step = np.linalg.solve(hess, np.append(x.T @ (e - y) / n + penalty / n * w, (e - y).mean()))
        w, b = w - step[:-1], b - step[-1]
    return 1 / (1 + np.exp(-(rows([runs(t) for t in unseen]) @ w + b)))


def test_toxicity_against_a_plain_twin():
    r = random.Random(3)
    pick = lambda: " ".join(r.choice(("ÄRGER", "да", "нет", "漢字", "kar", "Mist", "x")) for _ in range(4))
    texts = [pick() + (" schön" if k % 3 else " grübel\tЗло") for k in range(60)]
    toxic = np.array([int(k % 3 == 0 and k % 7 != 0) for k in range(60)])
    each = list(toxicity.present(*toxicity.code_points(texts)))
    weights, intercept = toxicity.fit(np.concatenate(each), np.cumsum([0, *map(len, each)]), toxic, steps=4000)
    unseen = [pick() + end for end in (" schön", " GRÜBEL злО", "") for _ in range(4)]
    z = np.array([weights[b].sum(dtype=float) for b in toxicity.present(*toxicity.code_points(unseen))])
    got = 1 / (1 + np.exp(-(z + intercept)))
    assert np.abs(got - plain_toxicity(texts, toxic, unseen)).max() < 0.01


def test_toxicity_sample_is_bounded_in_characters(spark):
    docs = frame(spark, [(i, "zzgrub " * 10 if i % 2 else "fine words here") for i in range(200)] + [(1000, "x" * 5000)])
    labels = spark.createDataFrame([(i, i % 2) for i in [*range(200), 1000]], "doc_id bigint, toxic int")
    bounds = {"doc_id": "doc_id", "text": "text", "label": "toxic", "sample_rows": 100}
    whole = toxicity.sample(docs, labels, sample_chars=10**6, **bounds).collect()
    some = toxicity.sample(docs, labels, sample_chars=2000, **bounds).collect()
    assert len(whole) == 100 and 2000 - 70 <= sum(len(r["t"]) for r in some) <= 2000 and {r["key"] for r in some} <= {r["key"] for r in whole}
    model = toxicity.train(docs, labels, sample_chars=2000)
    assert all(r["predicted"] == r["doc_id"] % 2 for r in toxicity.scores(docs, model).collect() if r["doc_id"] < 200)
    assert toxicity.train(docs, labels, sample_chars=0)[1] == 0.0


def test_toxicity_of_repeated_ids(spark):
    rows = [(1, "bad zzgrub text")] * 500 + [(i, "zzgrub" if i % 2 else "fine words here") for i in range(2, 60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, toxic int")
    model = toxicity.train(frame(spark, rows), labels)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.scores(frame(spark, rows), model).collect()}
    assert all(got[i] == i % 2 for i in got)


# --- 4 -----------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    return segment.load_vocabulary(registry.TOKENIZER)


def all_segmentations(vocabulary, text):
    lat = segment.Lattices(vocabulary)
    codes, at = segment.normalise([text])
    starts = segment.unit_starts(lat, codes, at)
    nodes = lat.nodes_of(codes, starts, np.concatenate([starts[1:], [len(codes)]]))

    def walk(node):
        low, high = lat.first_edge[node], lat.first_edge[node + 1]
        if low == high:
            yield 0.0, ()
        for e in range(low, high):
            for p, rest in walk(lat.to[e]):
                yield p + lat.share[e], (e, *rest)

    out = {}
    for parts in itertools.product(*(list(walk(n)) for n in nodes)):
        edges = np.array([e for p in parts for e in p[1]])
        out[tuple(segment.piece_ids(lat, edges)[0].tolist())] = sum(p[0] for p in parts)
    return out


def test_sampling_distribution(spark, vocabulary):
    text = "the cat"
    every = all_segmentations(vocabulary, text)
    assert math.isclose(sum(math.exp(p) for p in every.values()), 1.0, rel_tol=1e-9)
    n = 6000
    rows = segment.sample_segmentations(spark.range(n).withColumn("text", F.lit(text)), vocabulary, key=("id",), samples=3).collect()
    first = Counter(tuple(r["ids"]) for r in rows if r["rank"] == 0)
    for ids, p in every.items():
        assert abs(first[ids] / n - math.exp(p)) < 4.5 * math.sqrt(math.exp(p) / n) + 2 / n
    by = {}
    for r in rows:
        by.setdefault(r["id"], []).append(r)
        assert math.isclose(r["log_probability"], every[tuple(r["ids"])], abs_tol=1e-9)
    for own in by.values():
        own.sort(key=lambda r: r["rank"])
        assert len({tuple(r["ids"]) for r in own}) == len(own) and all(a["perturbed"] >= b["perturbed"] for a, b in itertools.pairwise(own))
    # Horvitz-Thompson: inclusion-weighted sums estimate sums over all segmentations.
    estimate = sum(math.exp(r["log_probability"]) / r["inclusion"] for r in rows) / n
    assert abs(estimate - 1.0) < 0.05


def test_segments_of_odd_rows(spark, odd, none, vocabulary):
    drawn = segment.decode_pieces(segment.sample_segmentations(odd, vocabulary, key=("doc_id", "rid")), vocabulary).collect()
    assert Counter(r["decoded"] for r in drawn if r["rank"] == 0) == Counter(t or "" for _, t in ODD)
    assert segment.sample_segmentations(none, vocabulary, key=("doc_id",)).count() == 0


def test_segments_query_covers_documents(odd, spark):
    folder = shared_folder(spark)
    docs = odd.where("doc_id in (1, 3, 8, 9)").select("doc_id", "text")
    docs.write.parquet(f"{folder}/documents.parquet")
    got = registry.QUERIES["op4_gumbel_segments"](spark, folder).where("rank = 0").collect()
    want = Counter((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in ODD if i in (1, 3, 8, 9))
    assert Counter((r["doc_id"], r["decoded_sha256"]) for r in got) == want


# --- 1 -----------------------------------------------------------------------------------------------------------------


def test_revisits(spark):
    rows = [
        (1, "response", "http://www.A.com:80/x/?b=2&a=1&utm_s=q#f", 100, 200, 'ETag: "v1"\r\nServer: s\r\nX: 1\r\nX: 2', "d1"), (2, "revisit", "https://a.com/x?a=1&b=2", 200, 304, 'etag: W/"v1"\r\nDate: now\r\nServer: t', None), (3, "revisit", "a", 150, 304, None, None),
        (4, "response", "http://a.com/x?a=1&b=2", 200, 200, 'ETag: "v2"', "d2"), (5, "revisit", "http://a.com/x?a=1&b=2", 90_000_000, 304, 'ETag: "v1"', None), (6, "revisit", None, 5, 304, "", None), (7, "revisit", "http://a.com/x?a=1&b=2", 100, 304, None, None), (8, "revisit", "http://a.com/x?a=1&b=2", 90_000_000, 304, None, None), (9, "request", "http://a.com/", 1, None, None, None),
    ]
    records = spark.createDataFrame(rows, "record_id bigint, warc_type string, url string, t bigint, status int, headers string, payload_digest string").withColumn("ts", F.timestamp_seconds("t")).withColumn("key", F.lit(1))
    got = {r["record_id"]: (r["base_id"], r["outcome"], r["merged_headers"]) for r in warc.resolve_revisits(records).collect()}
    assert got[2] == (1, "resolved", 'date: now\netag: W/"v1"\nserver: s\nx: 1, 2')
    assert got[5] == (4, "validator_mismatch", None) and got[8] == (4, "unvalidated", 'etag: "v2"')
    assert {got[k][1] for k in (3, 6, 7)} == {"no_response"} and set(got) == {2, 3, 5, 6, 7, 8}
    assert warc.resolve_revisits(records.where("1 = 0")).count() == 0
    odd_times = records.withColumn("ts", F.when(F.col("record_id") == 2, "no time").otherwise(F.col("ts").cast("string")))
    got = {r["record_id"]: r["outcome"] for r in warc.resolve_revisits(odd_times).collect()}
    assert got[2] == "no_response" and got[5] == "validator_mismatch"
