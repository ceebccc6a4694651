"""Spatial joins against all pairs, at several latitudes and in hot cells."""

import math
import random

import pytest

from waygrid.config import EARTH_M
from waygrid.operators import spatial


def haversine(a1, o1, a2, o2):
    x = math.sin(math.radians(a2 - a1) / 2) ** 2 + math.cos(math.radians(a1)) * math.cos(math.radians(a2)) * math.sin(math.radians(o2 - o1) / 2) ** 2
    return 2 * EARTH_M * math.asin(min(1, math.sqrt(x)))


def foot(p, s):
    k = math.cos(math.radians(p[1]))
    bx, by, px, py = (s[4] - s[2]) * k, s[3] - s[1], (p[2] - s[2]) * k, p[1] - s[1]
    t = 0.0 if bx * bx + by * by == 0 else max(0.0, min(1.0, (px * bx + py * by) / (bx * bx + by * by)))
    return haversine(p[1], p[2], s[1] + t * (s[3] - s[1]), s[2] + t * (s[4] - s[2]))


def field(lat, n, seed, spread=0.02):
    """Points and short segments around a latitude, as far apart in metres anywhere."""
    rng = random.Random(seed)
    wide = spread / max(0.01, math.cos(math.radians(lat)))
    place = lambda: (max(-90.0, min(90.0, lat + rng.uniform(-spread, spread))), 77 + rng.uniform(-wide, wide))
    points = [(i, *place()) for i in range(n)]
    segments = []
    for i in range(n):
        a = place()
        segments.append((i, *a, max(-90.0, min(90.0, a[0] + rng.uniform(-0.004, 0.004))), a[1] + rng.uniform(-0.2, 0.2) * wide))
    return points, segments


@pytest.mark.parametrize("lat", [0, 28, 45, -60, 75, 89.95])
def test_pairs_at_any_latitude(spark, lat):
    points, segments = field(lat, 120, int(lat))
    want = {(p[0], s[0]) for p in points for s in segments if foot(p, s) <= 500}
    p, s = spark.createDataFrame(points, "pid long, lat double, lon double"), spark.createDataFrame(segments, "sid long, alat double, alon double, blat double, blon double")
    got = spatial.pairs_within(p, s, 500, "pid", "sid").select("pid", "sid").collect()
    assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == want and len(want) > 50
    best = {r["pid"]: r["distance_m"] for r in spatial.nearest(p, s, 500, "pid", "sid").collect()}
    assert set(best) == {i for i, _ in want} and all(abs(best[q[0]] - min(foot(q, x) for x in segments)) < 1e-6 for q in points if q[0] in best)


def test_the_case_that_was_lost(spark):
    """A segment 400 m east of each point, at 60 degrees north."""
    step = 400 / (111195 * 0.5)
    points = [(i, 60 + i / 100, 20 + i / 7) for i in range(200)]
    segments = [(i, a, o + step, a, o + step + 0.0001) for i, a, o in points]
    got = spatial.pairs_within(spark.createDataFrame(points, "pid long, lat double, lon double"), spark.createDataFrame(segments, "sid long, alat double, alon double, blat double, blon double"), 500, "pid", "sid")
    assert got.count() == 200


@pytest.mark.parametrize("part", [7, 10_000])
def test_all_points_in_one_cell(spark, monkeypatch, part):
    monkeypatch.setattr(spatial, "PART_POINTS", part)
    rng = random.Random(2)
    points = [(i, 28.1001 + rng.random() * 1e-4, 77.4001 + rng.random() * 1e-4) for i in range(300)] + [(900, 10.0, 10.0), (901, None, 5.0)]
    segments = [(i, 28.1 + i * 1e-4, 77.4, 28.1 + i * 1e-4, 77.401) for i in range(60)]
    got = spatial.pairs_within(spark.createDataFrame(points, "pid long, lat double, lon double"), spark.createDataFrame(segments, "sid long, alat double, alon double, blat double, blon double"), 300, "pid", "sid")
    want = {(p[0], s[0]) for p in points if p[1] is not None for s in segments if foot(p, s) <= 300}
    rows = [tuple(r) for r in got.select("pid", "sid").collect()]
    assert len(rows) == len(want) and set(rows) == want


@pytest.mark.parametrize("lat", [0, -60, 89.5])
def test_k_nearest_without_a_radius(spark, lat):
    points, _ = field(lat, 60, 4, 0.05)
    others = [(i, a, o) for i, a, o in field(lat, 40, 5, 0.3)[0]] + [(100, 10.0, 10.0), (101, -20.0, 10.0)]
    p, o = spark.createDataFrame(points, "pid long, lat double, lon double"), spark.createDataFrame(others, "oid long, olat double, olon double")
    got = {}
    for r in spatial.k_nearest(p, o, 3, "pid", "oid", first_m=2000).collect():
        got.setdefault(r["pid"], {})[r["rank"]] = r["oid"]
    for i, a, b in points:
        near = sorted(others, key=lambda x: (haversine(a, b, x[1], x[2]), x[0]))[:3]
        assert got[i] == {k + 1: x[0] for k, x in enumerate(near)}
    few = spatial.k_nearest(p, o.filter("oid >= 100"), 3, "pid", "oid").collect()
    assert len(few) == 2 * len(points)
    assert spatial.k_nearest(p, o.limit(0), 3, "pid", "oid").count() == 0
