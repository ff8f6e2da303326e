"""Detection on planted images against plain loops and dense solutions."""

import math
import random

import numpy as np
import pytest

from lumenfield.operators import detection as D

PIXELS = "field_id bigint, px bigint, py bigint, v double, match int, group_id int"


def rows_of(image, field=1):
    return [(field, x, y, float(image[y, x]), 7, 8) for y in range(image.shape[0]) for x in range(image.shape[1])]


def stars(places, size, sigma=1.2, sky=0.0):
    yy, xx = np.mgrid[:size, :size]
    return sky + sum(f * np.exp(-((xx - x) ** 2 + (yy - y) ** 2) / (2 * sigma**2)) / (2 * math.pi * sigma**2) for x, y, f in places)


def test_matched_filter_equals_the_direct_sum(spark):
    r = np.random.default_rng(1)
    image = r.normal(size=(20, 23))
    image[3, 4] = -999
    clean = np.where(image > -700, image, 0.0)
    got = {(x.px, x.py): x.match for x in D.matched_filter(spark.createDataFrame(rows_of(image), PIXELS), 2.8).collect()}
    sigma = 2.8 / 2.3548200450309493
    k = np.arange(-3, 4)
    g = np.exp(-(k[:, None] ** 2 + k[None, :] ** 2) / (2 * sigma**2))
    kernel = (g - g.mean()) / ((g * g).sum() - g.sum() ** 2 / 49)
    padded = np.pad(clean, 3)
    for y in range(20):
        for x in range(23):
            assert got[(x, y)] == pytest.approx((padded[y : y + 7, x : x + 7] * kernel).sum(), abs=1e-9)


def test_point_sources_finds_planted_stars(spark):
    places = [(8, 9, 900.0), (25, 11, 700.0), (18, 30, 1200.0), (19, 23, 500.0)]
    image = stars(places, 40, sky=5.0)
    found = D.point_sources(spark.createDataFrame(rows_of(image) + [(None, 1, 1, 9e9, 1, 1), (1, None, 1, 9e9, 1, 1)], PIXELS), fwhm=2.8, threshold=10.0)
    assert {(x.px, x.py) for x in found.collect()} == {p[:2] for p in places}
    assert D.point_sources(spark.createDataFrame([], PIXELS), fwhm=2.8, threshold=1.0).count() == 0


def test_segments_equal_flood_fill(spark):
    r = random.Random(3)
    image = np.array([[r.random() * (2 if (x // 7 + y // 5) % 3 == 0 else 1.02) for x in range(60)] for y in range(50)])
    image[10, :] = 1.5  # a line across all tiles
    image[20, 5] = float("nan")
    lit, want = {(x, y) for y in range(50) for x in range(60) if image[y, x] > 1.0}, []
    while lit:
        todo, blob = [lit.pop()], []
        while todo:
            x, y = todo.pop()
            blob.append((x, y))
            for q in [(x + a, y + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
                if q in lit:
                    lit.remove(q)
                    todo.append(q)
        if len(blob) >= 5:
            want.append((min(y * (1 << 20) + x for x, y in blob), len(blob), round(sum(image[y, x] for x, y in blob), 6)))
    rows = rows_of(image)
    got = D.segments(spark.createDataFrame(rows + rows[:70], PIXELS), threshold=1.0)
    assert sorted((x.segment, x.n, round(x.flux, 6)) for x in got.collect()) == sorted(want)
    assert D.segments(spark.createDataFrame([], PIXELS), threshold=1.0).count() == 0


def test_joint_fluxes_equal_a_dense_solution(spark):
    places = [(10.2, 10.4, 800.0), (13.1, 11.0, 300.0), (15.7, 13.9, 500.0), (30.5, 30.2, 900.0), (33.9, 31.0, 50.0)]
    image = stars(places, 45, sky=4.0) + np.random.default_rng(2).normal(size=(45, 45))
    image[9, 9] = -999
    sources = spark.createDataFrame([(1, k, x, y, 1.0) for k, (x, y, _) in enumerate(places)] + [(1, 9, 500.0, 500.0, 1.0), (None, 8, 10.0, 10.0, 1.0), (1, 7, float("nan"), 1.0, 1.0)], "field_id bigint, ref_id bigint, x double, y double, flux double")
    got = {r.ref_id: r for r in D.joint_fluxes(sources, spark.createDataFrame(rows_of(image), PIXELS), sigma=1.2).collect()}
    assert set(got) == set(range(5)) and all(r.settled for r in got.values())
    for members in ((0, 1, 2), (3, 4)):
        cells = sorted({(round(places[k][0]) + a, round(places[k][1]) + b) for k in members for a in range(-5, 6) for b in range(-5, 6)})
        cells = [(x, y) for x, y in cells if 0 <= x < 45 and 0 <= y < 45 and image[y, x] > -700]
        near = lambda k: np.array([abs(x - round(places[k][0])) <= 5 and abs(y - round(places[k][1])) <= 5 for x, y in cells])
        shape = lambda k: np.array([math.exp(-((x - places[k][0]) ** 2 + (y - places[k][1]) ** 2) / 2.88) / (2.88 * math.pi) for x, y in cells])
        a = np.stack([*(np.where(near(k), shape(k), 0.0) for k in members), np.ones(len(cells))], 1)
        f = np.linalg.lstsq(a, np.array([image[y, x] for x, y in cells]), rcond=None)[0]
        assert [got[k].flux for k in members] == pytest.approx(list(f[:-1]), rel=1e-6)
        assert got[members[0]].background == pytest.approx(f[-1], rel=1e-6) and {got[k].group_id for k in members} == {members[0]}
        assert all(abs(got[k].flux - places[k][2]) < 40 for k in members)
    assert D.joint_fluxes(sources.limit(0), spark.createDataFrame([], PIXELS), sigma=1.2).count() == 0
