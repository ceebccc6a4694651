"""Pairs that share something, and clusters of roads, against plain loops; what they hold and shuffle."""

import math
import random

from waygrid.operators import ingest, places
from waygrid.operators.tracking import metres


def test_pairs_are_told_once_without_being_shuffled(spark):
    rng = random.Random(4)
    held = {w: {(a, a + rng.randrange(3)) for a in rng.sample(range(9), rng.randrange(1, 5))} for w in range(60)}
    rows = spark.createDataFrame([(w, p) for w, ps in held.items() for p in ps for _ in range(2)], "way long, pair struct<a: long, b: long>")
    got = ingest.sharing(rows, "way", "pair", "other")
    assert sorted(map(tuple, got.collect())) == sorted((x, y) for x in held for y in held if x != y and held[x] & held[y])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "Aggregate" not in plan.split("Join")[0]  # nothing gathers what the join found


def test_clusters_are_found_by_cell(spark, monkeypatch):
    """The same clusters as the plain loop's, at a pole and across the 180th meridian too, and few distances for many clusters."""
    rng = random.Random(6)
    rows = [(i, "n", i % 5, 28 + rng.random() / 4, 77 + rng.random() / 4) for i in range(300)] + [(i, "n", 1, 89.9 + rng.random() / 10, rng.uniform(-180, 180)) for i in range(300, 380)]
    rows += [(i, "n", 2, 10 + rng.random() / 10, rng.choice([-1, 1]) * (179.9 + rng.random() / 10)) for i in range(380, 460)]
    for within in (300.0, 3000.0):
        plain = []
        for i, _, rank, lat, lon in rows:
            near = next((c for c in plain if metres(c[2] / c[4], c[3] / c[4], lat, lon) <= within), None)
            if near:
                near[1:] = [max(near[1], rank), near[2] + lat, near[3] + lon, near[4] + 1]
            else:
                plain.append([i, rank, lat, lon, 1])
        got = places.cluster_roads(spark.createDataFrame(rows, "way_id long, norm string, rank int, lat double, lon double"), within)
        assert sorted((r["way_id"], r["rank"], r["ways"], round(r["lat"], 9)) for r in got.collect()) == sorted((c[0], c[1], c[4], round(c[2] / c[4], 9)) for c in plain)
    calls = []
    monkeypatch.setattr(places, "metres", lambda *a: calls.append(a) or metres(*a))
    held = places._Clusters(50.0)
    for i in range(2000):
        held.add(i, 0, 28 + i / 1e3, 77.0)
    held.add(2001, 0, math.nan, 77.0)
    assert len(held.clusters) == 2001 and len(calls) < 2000
