import random
from collections import Counter

import corpus_pipeline
from test_operators import ODD, base_measures, base_spans, edited, frame, plain_links, rich

from lumenfield.llm import near_dup, quality


def test_stages_on_odd_rows(spark):
    docs = frame(spark, ODD)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "").persist()
        assert out.columns == docs.columns
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() > 0


def test_stages_on_no_rows(spark):
    docs = frame(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0


def test_run(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    good = quality.keep_good(docs)
    kept = near_dup.keep_one(good)
    packed = corpus_pipeline.run(spark, folder)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == {r[0] for r in kept.select("doc_id").collect()}


def plain_stages(rows):
    """Documents before packing: every stage by brute force."""
    rows = [(i, t) for i, t in rows if not base_measures(t)[5]]
    label = {i: i for i, _ in rows}
    for i, j in plain_links(rows):
        old, new = max(label[i], label[j]), min(label[i], label[j])
        label = {k: new if v == old else v for k, v in label.items()}
    rows = [(i, t) for i, t in rows if label[i] == i]
    raw = [t.encode() for _, t in rows]
    seen = Counter(b[s : s + 200] for b in raw for s in range(len(b) - 199))
    out = {}
    for (i, _), b in zip(rows, raw, strict=True):
        gone = {k for s in range(len(b) - 199) if seen[b[s : s + 200]] > 1 for k in range(s, s + 200)}
        text = bytes(x for k, x in enumerate(b) if k not in gone).decode("utf-8", "ignore")
        made, at = "", 0
        for kind, start, end in sorted(base_spans(text), key=lambda x: x[1:]):
            if start >= at:
                made += text[at:start] + f"[{kind.upper()}]"
            at = max(at, end)
        out[i] = made + text[at:]
    return out


def test_stages_against_brute_force(spark):
    r = random.Random(21)
    passage = rich(45, 1)
    rows = []
    for i in range(60):
        text = rich(r.randrange(20, 200), 100 + i)
        text += f" {passage} {rich(30, 500 + i)}" if i % 5 == 0 else ""
        text += f" mail u{i}@example.com or 10.0.0.{i}" if i % 7 == 0 else ""
        rows.append((i, text))
        words = text.split()
        if i % 3 == 0:
            rows.append((1000 + i, " ".join(edited(words, r.sample(range(len(words)), len(words) // 20), f"e{i}")) if i % 2 else text))
    want = plain_stages(rows)
    docs = frame(spark, rows)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "").persist()
    assert {x["doc_id"]: x["text"] for x in docs.collect()} == want
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").groupBy("doc_id").sum("n_tokens").collect()
    assert {x[0]: x[1] for x in packed} == {i: len(t.split()) + 1 for i, t in want.items()}
