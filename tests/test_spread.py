"""Exact quantiles over few keys, and joins and sets of result tables, with odd rows."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfield.operators import experiments, robust, spatial


def test_quantiles_equal_numpy(spark):
    r = random.Random(7)
    rows = [(k, r.choice([float(r.randrange(9)), r.gauss(0, 100), None]), r.random() if r.random() < 0.5 else None) for k in ("a", "b", None) for _ in range(700)]
    rows += [("one", 3.0, None), ("none", None, None), ("same", 2.0, 1.0)] + [("same", 2.0, 1.0)] * 500
    df = spark.createDataFrame(rows, "key string, v double, w double").repartition(5)
    wanted = {"v0": ("v", 0.0), "v_mid": ("v", 0.5), "v_hi": ("v", 0.975), "w_lo": ("w", 0.025), "w1": ("w", 1.0)}
    got = {x["key"]: x for x in robust.quantiles(df, ["key"], wanted).collect()}
    assert set(got) == {"a", "b", None, "one", "none", "same"}
    for key in got:
        for name, (c, share) in wanted.items():
            held = [x for x in (row["vw".index(c) + 1] for row in rows if row[0] == key) if x is not None]
            assert got[key][name] == (pytest.approx(np.quantile(held, share), abs=1e-9) if held else None)


def test_quantiles_odd_rows(spark):
    df = spark.createDataFrame([(1.0, "x"), (math.nan, "x"), (3.0, "x"), (None, "x")], "key_value double, which string")
    assert robust.quantiles(df, ["which"], {"mid": ("key_value", 0.5)}).collect()[0]["mid"] == 3.0
    assert math.isnan(robust.quantiles(df, [], {"top": ("key_value", 1.0)}).collect()[0]["top"])
    empty = df.where("false")
    assert robust.quantiles(empty, ["which"], {"mid": ("key_value", 0.5)}).collect() == []
    assert [tuple(x) for x in robust.quantiles(empty, [], {"mid": ("key_value", 0.5)}).collect()] == [(None,)]


def test_id_sets(spark):
    rows = [(1, 0, "eligible"), (1, 1, "eligible"), (2, 0, "eligible"), (2, 0, "eligible"), (2, 1, "no"), (3, 0, "no"), (None, 0, "eligible"), (4, None, "eligible")]
    trials = spark.createDataFrame(rows, "trial_id bigint, method_no int, status string")
    got = experiments.id_sets(trials, trials.select("method_no").where("method_no is not null").distinct())
    assert sorted(map(tuple, got.collect())) == [(1, 2, "all"), (2, 1, "some"), (3, 0, "none"), (4, 0, "none")]
    assert experiments.id_sets(trials.where("false"), trials.select("method_no")).count() == 0


def test_join_results(spark):
    a = spark.createDataFrame([(1, "p", 5), (1, "q", 6), (None, "p", 7), (2, "p", 8), (2, "p", 9)], "k int, m string, v int")
    b = spark.createDataFrame([(1, "p", 50), (None, "p", 70), (3, "p", None)], "k int, m string, v int")
    got = Counter(tuple(x) for x in experiments.join_results(a, b, ["k", "m"], ["v"]).collect())
    want = [(1, "p", 5, 50, "both"), (1, "q", 6, None, "left"), (None, "p", 7, 70, "both"), (2, "p", 8, None, "left"), (2, "p", 9, None, "left"), (3, "p", None, None, "right")]
    assert got == Counter(want)


def test_labels(spark):
    labels = spark.createDataFrame([("Aperture fit", "ap", "Aperture"), ("aperture-FIT", "ap2", "Later"), ("psf", "psf", "PSF")], "alias string, canonical string, label string")
    rows = spark.createDataFrame([("APERTURE_fit", 1), ("psf", 2), ("other", 3), (None, 4)], "method string, label int")
    got = sorted(map(str, map(tuple, experiments.labelled(rows, labels).collect())))
    assert got == sorted(map(str, [("APERTURE_fit", "ap", "Aperture"), ("psf", "psf", "PSF"), ("other", "other", "other"), (None, None, None)]))
    assert experiments.labelled(rows, labels.where("false")).count() == 4


def test_masks(spark):
    dets = spark.createDataFrame([(0, 1, 0.0, 0.0), (0, 2, 0.5, 0.0), (0, None, 9.0, 9.0), (0, 3, None, 1.0), (0, 4, 9.0, 9.2)], "field_id int, det_id int, x double, y double")
    refs = spark.createDataFrame([(0, 7, 0.1, 0.0), (0, 8, 50.0, 0.0)], "field_id int, ref_id int, x double, y double")
    got = Counter((x["side"], x["id"], x["matched"]) for x in spatial.match_masks(dets, refs).collect())
    assert got == Counter([("detection", 1, True), ("detection", 2, False), ("detection", None, False), ("detection", 3, False), ("detection", 4, False), ("reference", 7, True), ("reference", 8, False)])
    assert spatial.match_masks(dets.where("false"), refs).where("matched").count() == 0


def test_few_keys_clip_as_many(spark):
    r = random.Random(3)
    df = spark.createDataFrame([(k, r.gauss(0, 1) if r.random() < 0.95 else 50.0) for k in range(3) for _ in range(300)], "k int, v double")
    one = robust.robust_rms(df, ["k"], "v", 0.01, few=True).orderBy("k").collect()
    two = robust.robust_rms(df, ["k"], "v", 0.01).orderBy("k").collect()
    assert [(x["k"], x["inliers"]) for x in one] == [(x["k"], x["inliers"]) for x in two]
    assert [x["rms"] for x in one] == pytest.approx([x["rms"] for x in two])
    assert df.where(F.col("v") == 50).count() > 0


def test_plain_affine(spark):
    many = [(1, x, y, 2 + 1.1 * x - 0.2 * y, -1 + 0.3 * x + 0.9 * y) for x in (0.0, 1.0, 5.0) for y in (0.0, 2.0, 3.0)]
    few = [(2, 0.0, 0.0, 9.0, 9.0), (2, 1.0, 0.0, 9.0, 8.0)]
    f = {x["k"]: x for x in robust.fit_affine(spark.createDataFrame(many + few, "k int, x double, y double, rx double, ry double"), ["k"], rounds=0, least=3).collect()}
    assert [f[1][c] for c in ("bx", "cx", "by", "cy")] == pytest.approx([1.1, -0.2, 0.3, 0.9])
    assert [f[2][c] for c in ("bx", "cx", "by", "cy")] == [1.0, 0.0, 0.0, 1.0] and (f[2]["ax"], f[2]["ay"]) == (f[2]["ox"], f[2]["oy"])
