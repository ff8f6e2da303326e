"""Composed protocols against sequential rules on small tables."""

import math
import random

from lumenfield.operators import protocols

REFS = "field_id bigint, ref_id bigint, x double, y double, mag double"
DETS = "field_id bigint, det_id bigint, x double, y double, flux double"


def test_injection_plan_follows_the_sequential_rule(spark):
    r = random.Random(3)
    refs = [(0, i, r.uniform(0, 100), r.uniform(0, 100), 20.0) for i in range(120)]
    bands = {"low": (0, 1), "high": (3, 10_000)}
    plan = lambda each, apart: protocols.injection_plan(spark.createDataFrame(refs, REFS), (20.0,), bands, batches=1, each=each, attempts=200, size=130.0, separation=apart).collect()
    tried = plan(10**6, 1e-6)
    assert all(t["neighbours"] == sum(math.dist((t["x"], t["y"]), p[2:4]) <= 10 for p in refs) - 1 for t in tried)
    want = []
    for band in bands:
        kept = []
        for t in sorted((t for t in tried if t["band"] == band), key=lambda t: t["attempt"]):
            if len(kept) < 5 and all(math.dist((t["x"], t["y"]), (k["x"], k["y"])) >= 12 for k in kept):
                kept.append(t)
        want += [(band, t["attempt"]) for t in kept]
    assert sorted((t["band"], t["attempt"]) for t in plan(5, 12.0)) == sorted(want)
    assert protocols.injection_plan(spark.createDataFrame([], REFS), (20.0,), bands).count() == 0


def test_injection_plan_fills_rare_bands(spark):
    r = random.Random(4)
    refs = [(f, 100 * f + i, 30 + r.uniform(0, 12), 30 + r.uniform(0, 12), 20.0) for f in (0, 1) for i in range(9)] + [(None, 999, 1.0, 1.0, 20.0)]
    plan = lambda **tries: sorted(tuple(x) for x in protocols.injection_plan(spark.createDataFrame(refs, REFS), (20.0,), {"low": (-1, 1), "high": (3, 10_000)}, each=2, size=150.0, separation=6.0, **tries).collect())
    few, grown, all_ = plan(attempts=20), plan(attempts=20, most_attempts=2000), plan(attempts=2000)
    assert len(few) < len(grown) == len(all_) == 2 * 2 * 2 * 2 and grown == all_


def test_score_realigned_undoes_a_shift(spark):
    places = [(20.0 + 37 * (i % 15), 20.0 + 41 * (i // 15)) for i in range(150)]
    refs = [(0, i, x, y, 20.0 + i % 3) for i, (x, y) in enumerate(places)] + [(1, 0, 5.0, 5.0, 20.0)]
    dets = [(0, i, x + 0.8, y - 0.6, 10 ** (-0.4 * (20.0 + i % 3 - 25))) for i, (x, y) in enumerate(places)]
    got = {s["field_id"]: s for s in protocols.score_realigned(spark.createDataFrame(dets, DETS), spark.createDataFrame(refs, REFS)).collect()}
    held = sum((int(x // 200) + int(y // 200)) % 3 == 2 for x, y in places)
    s = got[0]
    assert s["test_references"] == s["test_recovered"] == held > 0 and s["all_catalogue_matches"] == s["candidates"] == 150
    assert s["test_position_rms_mas"] < 1e-6 and s["test_magnitude_rms"] < 1e-6
    assert got[1]["candidates"] == got[1]["test_recovered"] == 0 and got[1]["test_position_rms_mas"] is None
