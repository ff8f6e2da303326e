"""The merged catalogue of two branches against a sequential rule."""

import math
import random

import pytest

from lumenfield.operators import rounds, routing


def plain(proposals, fits, conservative, reach=10.0, dense=3, radius=2.0, duplicate=1.0):
    ok = lambda r: all(v is not None and math.isfinite(v) for v in r[2:5]) and r[4] > 0
    far = lambda a, b: math.hypot(a[2] - b[2], a[3] - b[3])
    spots = [p for p in proposals if p[0] is not None]
    around = {p[:2]: sum(q[0] == p[0] and q[1] != p[1] and far(p, q) <= reach for q in spots) for p in spots}
    fitted = {r[:2]: r for r in fits if r[0] is not None and ok(r)}
    out = [(0, *r) for k, r in fitted.items() if around.get(k, 0) >= dense]
    for c in conservative:
        if c[0] is None or not ok(c):
            continue
        near = min(((far(c, p), p[1]) for p in spots if p[0] == c[0] and far(c, p) <= radius), default=None)
        n = around[(c[0], near[1])] if near else sum(p[0] == c[0] and far(c, p) <= reach for p in spots)
        if n < dense:
            out.append((2, *c))
        elif near and (c[0], near[1]) not in fitted:
            out.append((1, *c))
    kept = []
    for e in sorted(out, key=lambda e: (e[0], e[2])):
        if not any(k[1] == e[1] and math.hypot(k[3] - e[3], k[4] - e[4]) <= duplicate for k in kept):
            kept.append(e)
    return sorted((*e[1:], ("joint", "fallback", "conservative")[e[0]]) for e in kept)


def frames(spark, *tables):
    kinds = "field_id bigint, det_id bigint, x double, y double"
    return [spark.createDataFrame([(*r, 5) for r in t], f"{kinds}{', flux double' if k else ''}, branch int") for k, t in enumerate(tables)]


@pytest.mark.parametrize("seed", [1, 2])
def test_merge_equals_the_sequential_rule(spark, seed):
    r = random.Random(seed)
    proposals = [(f, i, r.uniform(0, 60), r.uniform(0, 60)) for f in (1, 2) for i in range(40)] + [(None, 1, 5.0, 5.0)]
    fits = [(f, i, x + r.uniform(-1, 1), y + r.uniform(-1, 1), r.choice((None, float("nan"), -1.0, 5.0, 6.0))) for f, i, x, y in proposals]
    conservative = [(f, 1000 + i, x + r.uniform(-2, 2), y + r.uniform(-2, 2), r.choice((0.0, 3.0, 4.0))) for f, i, x, y in proposals] + [(2, 7, 200.0, 200.0, 1.0), (2, 8, 200.0, 201.0, 1.0), (3, 1, 1.0, 1.0, 1.0), (None, 1, 1.0, 1.0, 1.0), (3, 2, float("nan"), 1.0, 1.0)]
    got = routing.merge(*frames(spark, proposals, fits, conservative))
    assert sorted(tuple(x) for x in got.collect()) == plain(proposals, fits, conservative)


def test_merge_of_one_branch_and_of_none(spark):
    proposals = [(1, i, 10.0 + 2 * i, 10.0) for i in range(6)]
    conservative = [(1, 100 + i, 10.0 + 2 * i, 10.2, 1.0) for i in range(6)]
    only = routing.merge(*frames(spark, proposals, [], conservative)).collect()
    assert sorted((x.det_id, x.route) for x in only) == [(100 + i, "fallback") for i in range(6)]
    fits = [(*p, 2.0) for p in proposals]
    assert {(x.det_id, x.route) for x in routing.merge(*frames(spark, proposals, fits, [])).collect()} == {(i, "joint") for i in range(6)}
    assert routing.merge(*frames(spark, [], [], [])).count() == 0


POINTS = "field_id bigint, det_id bigint, x double, y double, snr double, group_id string, place int"
ROWS = [(1, 1, 0.0, 0.0, 5.0, "g", 9), (1, 2, 1.0, 0.0, 4.0, "g", 9), (1, 3, 2.0, 0.0, None, "g", 9), (1, 4, 0.5, 0.0, None, "g", 9), (None, 5, 0.0, 0.0, 1.0, "g", 9), (1, None, 0.0, 0.0, 1.0, "g", 9), (1, 6, None, 0.0, 1.0, "g", 9), (1, 7, float("nan"), 0.0, 1.0, "g", 9), (2, 1, 0.0, 0.0, float("nan"), "g", 9), (2, 1, 0.0, 0.0, float("nan"), "g", 9)]


def test_rounds_end_on_null_keys(spark):
    points = spark.createDataFrame(ROWS, POINTS)
    kept = rounds.thin(points, 5.0, point_id="det_id", order="snr")
    assert kept.columns == points.columns
    # In ascending order 2 comes first and takes 1, 3 and 4 with it; places that are null or NaN have no neighbours.
    assert sorted((x.field_id, x.det_id) for x in kept.collect()) == [(1, 2), (1, 6), (1, 7), (2, 1), (2, 1)]
    grouped = rounds.groups(points, 1.0, point_id="det_id")
    assert grouped.count() == len(ROWS) and sorted(grouped.columns) == sorted(points.columns)
    assert {(x.det_id, x.group_id) for x in grouped.where("field_id = 1 and det_id is not null").collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (6, 6), (7, 7)}
    assert grouped.where("field_id is null or det_id is null").where("group_id is not null").count() == 0
    refs = points.withColumnRenamed("det_id", "ref_id")
    edges = rounds.greedy_edges(points, refs, 2.0).collect()
    assert sorted((x.field_id, x.det_id, x.ref_id) for x in edges) == [(1, i, i) for i in (1, 2, 3, 4)] + [(2, 1, 1)]
    for f in (lambda p: rounds.thin(p, 5.0, point_id="det_id", order="snr"), lambda p: rounds.groups(p, 1.0, point_id="det_id")):
        assert f(points.limit(0)).count() == 0
