"""Fixes on their route against all pairs of a route's fixes and segments."""

import math
import random

from waygrid.config import Tracking
from waygrid.operators import tracking

FIXES = "fix_id long, route_id long, lat double, lon double, heading double, last_m double"
SEGMENTS = "route_id long, seq long, alat double, alon double, blat double, blon double"


def bearing(a, o, b, p):
    d = math.radians(p - o)
    x = math.cos(math.radians(a)) * math.sin(math.radians(b)) - math.sin(math.radians(a)) * math.cos(math.radians(b)) * math.cos(d)
    return math.degrees(math.atan2(math.sin(d) * math.cos(math.radians(b)), x)) % 360


def plain(fixes, segments, cfg):
    """Offset, metres and segment of every fix, by all pairs."""
    routes = {}
    for r in sorted(segments):
        before = routes.setdefault(r[0], [])
        start = before[-1][1] if before else 0.0
        before.append((start, start + tracking.metres(*r[2:]), r))
    out = {}
    for fix, route, lat, lon, heading, last in fixes:
        best = None
        for start, end, (_, seq, a, o, b, p) in routes.get(route, []):
            gap = abs((bearing(a, o, b, p) - heading + 180) % 360 - 180) if heading is not None else 0
            if lat is None or gap > cfg.heading_gate_deg or (last is not None and not (end >= last - cfg.route_window_m and start <= last + cfg.route_window_m)):
                continue
            k = math.cos(math.radians(lat))
            bx, by, px, py = (p - o) * k, b - a, (lon - o) * k, lat - a
            t = max(0.0, min(1.0, (px * bx + py * by) / (bx * bx + by * by))) if bx or by else 0.0
            off = tracking.metres(lat, lon, a + t * (b - a), o + t * (p - o))
            best = min(best or (math.inf, 0, 0), (off, seq, start + t * (end - start)))
        out[fix] = best
    return out


def test_as_all_pairs(spark):
    """Bends, a popular route, fixes near and some 300 km off, at two latitudes, with and without heading and last place."""
    rng = random.Random(5)
    segments = []
    for route, (lat, lon) in enumerate([(28.5, 77.4), (63.0, 10.0), (28.5, 77.4)]):
        turn = 0.0
        for seq in range(120):
            turn += rng.uniform(-0.5, 0.5)
            to = lat + 0.002 * math.cos(turn), lon + 0.003 * math.sin(turn)
            segments.append((route, seq, lat, lon, *to))
            lat, lon = to
    fixes = []
    for i in range(900):
        route = 0 if i % 3 else rng.randrange(4)
        s = rng.choice([x for x in segments if x[0] == min(route, 2)])
        spread = rng.choice([1e-4, 1e-4, 0.01, 3.0])
        heading = rng.choice([None, rng.uniform(0, 360)])
        fixes.append((i, route, s[2] + rng.uniform(-spread, spread), s[3] + rng.uniform(-spread, spread), heading, rng.choice([None, None, rng.uniform(-400, 40000), float(rng.randrange(0, 30000, 500))])))
    fixes += [(1000, 0, None, 77.0, None, None), (1001, 0, 28.5, None, None, 10.0), (1002, None, 28.5, 77.4, None, None)]
    got = tracking.match_to_route(spark.createDataFrame(fixes, FIXES), spark.createDataFrame(segments, SEGMENTS)).collect()
    want = plain([f for f in fixes if f[3] is not None], segments, Tracking())
    assert len(got) == len(fixes) and sum(w is None for w in want.values()) > 100
    for r in got:
        w = want.get(r["fix_id"])
        assert (r["seq"] is None) == (w is None), r
        if w:
            assert abs(r["offset_m"] - w[0]) < 1e-6 * max(1, w[0]) and abs(r["route_m"] - w[2]) < 1e-3 and r["seq"] == w[1], (r, w)


def test_empty_sides(spark):
    none, seg = spark.createDataFrame([], FIXES), [(1, 0, 28.5, 77.5, 28.6, 77.5)]
    assert tracking.match_to_route(none, spark.createDataFrame(seg, SEGMENTS)).count() == 0
    one = spark.createDataFrame([(1, 1, 28.5, 77.5, None, None)], FIXES)
    assert [r["seq"] for r in tracking.match_to_route(one, spark.createDataFrame([], SEGMENTS)).collect()] == [None]
    assert [r["seq"] for r in tracking.match_to_route(one, spark.createDataFrame(seg, SEGMENTS)).collect()] == [0]
