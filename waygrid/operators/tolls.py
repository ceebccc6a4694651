"""What a route pays: runs of equal toll road, the gates and plazas that each run crosses, and its fare."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from waygrid.config import SAME_PLAZA_M, TOLL_ROADS, TOLLABLE_KM

#: Kinds of gates on an edge.
NO_GATE, MAINLINE, RAMP = 0, 1, 2
#: Confidence, from the strongest to the weakest.
CONFIDENCE = ("verified", "approximated", "unpriced")


def edge_gates(pieces: DataFrame, gates: DataFrame) -> DataFrame:
    """(way_id, piece, gate) of the pieces of tolled ways (way_id, piece, node_id, tolled, mainline): the largest kind of
    the gates (node_id) on their nodes, both ends counted. Mainline is a property of the way, so kinds do not mix."""
    kind = F.when(F.col("mainline"), MAINLINE).otherwise(RAMP)
    met = pieces.filter("tolled").join(gates.select("node_id").distinct(), "node_id", "left_semi")
    return met.groupBy("way_id", "piece").agg(F.max(kind).alias("gate"))


def runs(steps: DataFrame) -> DataFrame:
    """Runs of toll road along routes (query_id, i, toll_road, gate, span, metres): their metres, plazas, ramp booths,
    metres after the last mainline gate, and first and last span. Road 0 is free and separates runs.

    A mainline gate counts as a plaza if none came before it in the run or the last one is further than SAME_PLAZA_M."""
    route = W.partitionBy("query_id").orderBy("i")
    marked = steps.withColumn("new", F.coalesce(F.lag("toll_road").over(route) != F.col("toll_road"), F.lit(True)).cast("long"))
    marked = marked.withColumn("run", F.sum("new").over(route)).filter("toll_road <> 0")
    run = W.partitionBy("query_id", "run").orderBy("i")
    marked = marked.withColumn("at_m", F.sum("metres").over(run.rowsBetween(W.unboundedPreceding, W.currentRow)))
    gate_at = F.when(F.col("gate") == MAINLINE, F.col("at_m"))
    before = F.last(gate_at, ignorenulls=True).over(run.rowsBetween(W.unboundedPreceding, -1))
    plaza = (F.col("gate") == MAINLINE) & (before.isNull() | (F.col("at_m") - before > SAME_PLAZA_M))
    return marked.withColumns({"plaza": plaza, "gate_at": gate_at}).groupBy("query_id", "run", "toll_road").agg(
        F.sum("metres").alias("metres"), F.count_if("plaza").alias("plazas"), F.count_if(F.col("gate") == RAMP).alias("ramp_booths"),
        (F.sum("metres") - F.coalesce(F.max("gate_at"), F.lit(0.0))).alias("after_m"), F.min("span").alias("entry"), (F.max("span") + 1).alias("exit"),
    )


def _by_road(value) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for number, road in TOLL_ROADS.items() for x in (number, value(road))]), F.col("toll_road"))


def price(run_table: DataFrame) -> DataFrame:
    """Adds fare and confidence to runs.

    Gate-hybrid roads charge a fee a plaza and the metres after the last, or all metres where no plaza is crossed; such a
    run, or one with a ramp booth, is only as sure as the road's ramps. Matrix roads charge the kilometres between entry
    and exit, half up to a step; a run without a span, or beyond the matrix, is free. Others charge their metres."""
    matrix = F.array(*[F.array(*map(F.lit, row)) for row in TOLLABLE_KM])
    cell = F.get(F.get(matrix, F.col("entry").cast("int")), F.col("exit").cast("int"))
    rate, step, mechanism = _by_road(lambda r: r.rate_per_km), _by_road(lambda r: r.step), _by_road(lambda r: r.mechanism)
    gated = F.when(F.col("plazas") > 0, F.col("plazas") * _by_road(lambda r: r.fee) + F.col("after_m") / 1000 * rate)
    by_metres = F.col("metres") / 1000 * rate
    fare = F.when(mechanism == "matrix", F.coalesce(step * F.floor(rate * cell / step + 0.5), F.lit(0.0))).when(mechanism == "gate-hybrid", F.coalesce(gated, by_metres)).otherwise(by_metres)
    ramps = (mechanism == "gate-hybrid") & ((F.col("ramp_booths") > 0) | (F.col("plazas") == 0))
    confidence = F.when(ramps, _by_road(lambda r: r.with_ramp)).otherwise(_by_road(lambda r: r.confidence))
    return run_table.withColumns({"fare": F.coalesce(fare, F.lit(0.0)), "confidence": F.coalesce(confidence, F.lit(CONFIDENCE[0]))})


def route_tolls(priced: DataFrame) -> DataFrame:
    """(query_id, fare, confidence, runs) of routes with tolls: the sum, and the weakest confidence of their runs."""
    order = F.array_position(F.array(*map(F.lit, CONFIDENCE)), F.col("confidence"))
    sums = priced.groupBy("query_id").agg(F.sum("fare").alias("fare"), F.max(order).alias("weakest"), F.count(F.lit(1)).alias("runs"))
    return sums.select("query_id", "fare", F.element_at(F.array(*map(F.lit, CONFIDENCE)), F.col("weakest").cast("int")).alias("confidence"), "runs")

