"""Seeded pairs of places: drawn in an area, kept where both ends lie near a road."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waygrid.operators import spatial
from waygrid.operators.network import numbered
from waygrid.plans.lineage import cut

#: Fixed values of the public 32-bit generator whose state moves on by one step a draw (mulberry32).
STEP, WORD = 0x6D2B79F5, 1 << 32


def _product(x: Column, y: Column) -> Column:
    """Lower 32 bits of a product of two 32-bit numbers, in halves, as the whole does not fit into a long."""
    return ((x.bitwiseAND(0xFFFF) * y) + F.shiftleft((F.shiftright(x, 16) * y).bitwiseAND(0xFFFF), 16)).bitwiseAND(WORD - 1)


def draw(n: Column, seed: int) -> Column:
    """Number n (from 0) that the generator gives, in [0, 1). The state is linear in n, so any draw is made by itself."""
    state = F.pmod(F.lit(seed % WORD) + F.pmod(F.pmod(n + 1, F.lit(WORD)) * F.lit(STEP), F.lit(WORD)), F.lit(WORD))
    first = _product(state.bitwiseXOR(F.shiftright(state, 15)), state.bitwiseOR(F.lit(1)))
    second = (first + _product(first.bitwiseXOR(F.shiftright(first, 7)), first.bitwiseOR(F.lit(61)))).bitwiseAND(WORD - 1).bitwiseXOR(first)
    return second.bitwiseXOR(F.shiftright(second, 14)) / F.lit(float(WORD))


def attempts(numbers: DataFrame, area: tuple[float, float, float, float], seed: int) -> DataFrame:
    """Adds alat, alon, blat, blon to attempts (attempt): four draws each, a longitude before its latitude."""
    south, west, north, east = area
    at = lambda i, low, high: F.lit(low) + draw(F.col("attempt") * 4 + i, seed) * F.lit(high - low)
    return numbers.withColumns({"alon": at(0, west, east), "alat": at(1, south, north), "blon": at(2, west, east), "blat": at(3, south, north)})


def seeded_pairs(segments: DataFrame, area: tuple[float, float, float, float], wanted: int, seed: int, snap_m: float, most: int = 40) -> DataFrame:
    """The first ``wanted`` attempts of which both ends lie within snap_m of a segment (alat, alon, blat, blon):
    (pair from 1, attempt, alat, alon, blat, blon). There are fewer where ``most`` attempts for each wanted pair don't do.
    An area (south, west, north, east) without extent is a point; without segments there are no pairs.

    Rounds of rejection: each makes as many attempts as the share kept so far asks for, and looks for segments near all of
    them in one join. Attempts are numbered over the rounds, so the size of a round decides nothing."""
    spark, limit, at, kept, found = segments.sparkSession, most * wanted, 0, 0, None
    while kept < wanted and at < limit:
        share = max(kept, 1) / at if at else 0.5
        size = min(limit - at, math.ceil((wanted - kept) / share * 1.1) + 64)
        tried = cut(attempts(spark.range(at, at + size).withColumnRenamed("id", "attempt"), area, seed))
        ends = F.explode(F.array(*[F.struct((F.col("attempt") * 2 + i).alias("end_id"), F.col(f"{e}lat").alias("lat"), F.col(f"{e}lon").alias("lon")) for i, e in enumerate("ab")]))
        near = spatial.pairs_within(tried.select(ends.alias("e")).select("e.*"), segments, snap_m, "end_id", "edge_id").select("end_id").distinct()
        both = near.groupBy(F.floor(F.col("end_id") / 2).alias("attempt")).count().filter("count = 2").select("attempt")
        done = cut(tried.join(both, "attempt"))
        kept, at = kept + done.count(), at + size
        done = done.select((F.col("attempt") + 0).alias("attempt"), *[(F.col(c) + F.lit(0.0)).alias(c) for c in ("alat", "alon", "blat", "blon")])
        found = done if found is None else found.unionByName(done)
    if found is None:
        found = attempts(spark.range(0).withColumnRenamed("id", "attempt"), area, seed)
    return numbered(found, ["attempt"], "pair").withColumn("pair", F.col("pair") + 1).filter(F.col("pair") <= wanted)
