"""Seeded pairs against the plain loop."""

import random

from pyspark.sql import functions as F

from waygrid.operators import sampling
from waygrid.operators.tracking import metres


def numbers(seed):
    """The generator as a loop."""
    a, word = seed % (1 << 32), (1 << 32) - 1
    while True:
        a = (a + 0x6D2B79F5) & word
        t = ((a ^ (a >> 15)) * (a | 1)) & word
        t = ((t + (t ^ (t >> 7)) * (t | 61)) & word) ^ t
        yield (t ^ (t >> 14)) / 2**32


def test_draws(spark):
    for seed in (0, 20260731, 2**32 - 1):
        it = numbers(seed)
        want = [next(it) for _ in range(3000)]
        got = spark.range(3000).withColumn("x", sampling.draw(F.col("id"), seed)).orderBy("id").collect()
        assert [r["x"] for r in got] == want


def test_pairs_as_the_loop(spark):
    rng = random.Random(2)
    segments = [(i, a := 28.0 + rng.random() * 0.05, o := 77.0 + rng.random() * 0.05, a + rng.uniform(-0.004, 0.004), o + rng.uniform(-0.004, 0.004)) for i in range(60)]
    area, wanted = (28.0, 77.0, 28.05, 77.05), 40

    def near(lat, lon):
        from math import cos, radians

        for _, a, o, b, p in segments:
            k = cos(radians(lat))
            bx, by, px, py = (p - o) * k, b - a, (lon - o) * k, lat - a
            t = max(0.0, min(1.0, (px * bx + py * by) / (bx * bx + by * by)))
            if metres(lat, lon, a + t * (b - a), o + t * (p - o)) <= 60:
                return True
        return False

    for most in (40, 3):
        it, want = numbers(7), []
        for attempt in range(most * wanted):
            alon, alat, blon, blat = (low + next(it) * (high - low) for low, high in ((77.0, 77.05), (28.0, 28.05)) * 2)
            if near(alat, alon) and near(blat, blon):
                want.append((attempt, alat, alon, blat, blon))
            if len(want) == wanted:
                break
        df = spark.createDataFrame(segments, "edge_id long, alat double, alon double, blat double, blon double")
        got = sorted(tuple(r) for r in sampling.seeded_pairs(df, area, wanted, 7, 60.0, most).select("pair", "attempt", "alat", "alon", "blat", "blon").collect())
        assert got == [(i + 1, *w) for i, w in enumerate(want)]
    assert 0 < len(want) < wanted
    assert sampling.seeded_pairs(df.limit(0), area, 5, 7, 60.0).count() == 0 and sampling.seeded_pairs(df, area, 0, 7, 60.0).count() == 0
