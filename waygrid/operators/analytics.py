"""Calibration and audit reports as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def quantile(x: Column, q: float) -> Column:
    """Exact quantile with linear interpolation."""
    return F.percentile(x, F.lit(q))


def quantile_floor(df: DataFrame, by: Sequence[str], x: str, qs: Sequence[float]) -> DataFrame:
    """Value at the place min(n - 1, floor(q n)) of each group's order, for each q; ranks are windowed, so that no
    group is gathered into one value."""
    w = W.partitionBy(*by).orderBy(x)
    n = W.partitionBy(*by)
    ranked = df.filter(F.col(x).isNotNull()).select(*by, x, (F.row_number().over(w) - 1).alias("i"), F.count(F.lit(1)).over(n).alias("n"))
    return ranked.groupBy(*by).agg(*[F.max(F.when(F.col("i") == F.least(F.col("n") - 1, F.floor(q * F.col("n"))), F.col(x))).alias(f"q{int(q * 100)}") for q in qs])


def summary(df: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    c = F.col(x)
    return df.groupBy(*by).agg(F.count(c).alias("n"), *[quantile(c, q).alias(f"p{int(q * 100)}") for q in (0.5, 0.95, 0.99)], F.max(c).alias("max"))


def paired_ratios(df: DataFrame, pair: str, base: str, other: str) -> DataFrame:
    """Median of ratios of two measures a row, and the ratio of their sums."""
    return df.agg(F.count(pair).alias("n"), quantile(F.col(other) / F.col(base), 0.5).alias("median_ratio"), (F.sum(other) / F.sum(base)).alias("total_ratio"))


def quarters(df: DataFrame, by: Sequence[str], size: str, x: str, tie: str) -> DataFrame:
    """Mean of x in four groups by size: floor(n / 4) each, the rest in the last."""
    w = W.partitionBy(*by)
    ranked = df.select(*by, x, (F.row_number().over(w.orderBy(size, tie)) - 1).alias("i"), F.count(F.lit(1)).over(w).alias("n"))
    quarter = F.least(F.lit(3), F.floor(F.col("i") / F.greatest(F.lit(1), F.floor(F.col("n") / 4))))
    return ranked.groupBy(*by, quarter.cast("int").alias("quarter")).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"))


def shares(df: DataFrame, by: Sequence[str], part: str, x: str) -> DataFrame:
    """Share of x that each part has in its group."""
    sums = df.groupBy(*by, part).agg(F.sum(x).alias("amount"))
    return sums.withColumn("share", F.col("amount") / F.sum("amount").over(W.partitionBy(*by)))


def spans(points: DataFrame, bounds: Sequence[float], x: str) -> DataFrame:
    """Number of the first span [bounds[i], bounds[i + 1]] that holds x, so an inner bound belongs to the lower span;
    null outside. The bounds are a literal array: no join."""
    arr = F.array(*[F.lit(float(b)) for b in bounds])
    found = F.filter(F.sequence(F.lit(0), F.lit(len(bounds) - 2)), lambda i: (F.col(x) >= F.element_at(arr, i + 1)) & (F.col(x) <= F.element_at(arr, i + 2)))
    return points.withColumn("span", F.try_element_at(found, F.lit(1)))


def tag_coverage(ways: DataFrame, keys: Sequence[str], rank: str, metres: str) -> DataFrame:
    """Ways and metres with each tag, by class rank and overall (rank null): grouping sets over one pass."""
    present = F.explode(F.filter(F.array(*[F.when(F.map_contains_key("tags", k), F.lit(k)) for k in keys]), lambda k: k.isNotNull())).alias("key")
    exploded = ways.select(present, F.col(rank).alias("rank"), F.col(metres).alias("metres"))
    return exploded.groupingSets([["key"], ["key", "rank"]], "key", "rank").agg(F.count(F.lit(1)).alias("ways"), F.sum("metres").alias("metres"), F.grouping("rank").alias("overall"))


def newest(df: DataFrame, key: str, seq: Sequence[str], value: str) -> DataFrame:
    """Only the latest value of each key holds."""
    return df.groupBy(key).agg(F.max(F.struct(*seq, value)).alias("last")).select(key, F.col(f"last.{value}").alias(value))


def quiet_sessions(df: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """One row for each burst of events that a quiet period ends."""
    return df.groupBy(key, F.session_window(ts, gap).alias("s")).agg(F.count(F.lit(1)).alias("events"), F.max(ts).alias("last"))


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two tables has, copies counted."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def scenario_deltas(results: DataFrame, base: str, scenario: str, pair: str, x: str, moved: float) -> DataFrame:
    """Each scenario against the base one, pair by pair: pairs that moved, better and worse, and the mean change."""
    b = results.filter(F.col(scenario) == base).select(pair, F.col(x).alias("base_x"))
    j = results.filter(F.col(scenario) != base).join(b, pair).withColumn("d", F.col(x) - F.col("base_x"))
    return j.groupBy(scenario).agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.abs("d") > moved).alias("moved"), F.count_if(F.col("d") < -moved).alias("better"), F.count_if(F.col("d") > moved).alias("worse"), F.avg("d").alias("mean_delta"))
