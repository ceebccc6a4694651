"""Audits: lines priced on the network, why two routes differ, interchanges and plazas along a road, toll usage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from waygrid.config import ANCHORS_KM, COVERED_M, INTERCHANGE_KM, PLAZA_CAP_KM, PLAZA_KM, UNCOVERED_KMH, UNCOVERED_MOST_M, Objective
from waygrid.functions.geo import haversine
from waygrid.operators import spatial
from waygrid.operators.profile import toll_display


def covered_segments(segments: DataFrame, shapes: DataFrame) -> DataFrame:
    """Segments of lines (line_id, seq, alat, alon, blat, blon) with their metres and the edge_id of the road nearest to
    their middle, null where none is within COVERED_M. Segments of no length are left out."""
    s = segments.withColumn("metres", haversine(F.col("alat"), F.col("alon"), F.col("blat"), F.col("blon"))).filter("metres > 0")
    s = s.select("line_id", "seq", "metres", ((F.col("alat") + F.col("blat")) / 2).alias("lat"), ((F.col("alon") + F.col("blon")) / 2).alias("lon"))
    s = s.withColumn("middle", F.struct("line_id", "seq"))
    return s.join(spatial.nearest(s.select("middle", "lat", "lon"), shapes, COVERED_M, "middle", "edge_id").select("middle", "edge_id"), "middle", "left").drop("middle", "lat", "lon")


def price_lines(covered: DataFrame, edges: DataFrame, cfg: Objective = Objective()) -> DataFrame:
    """Each line (line_id, metres, edge_id a segment) under the objective without turns: metres, uncovered and tolled
    metres, seconds of driving, of distance and of tolls, and their sum.

    A stretch without a road is driven at the slowest speed, so that a gap never makes a line look cheap. Which toll road
    it is can't be told from a line, so tolled metres cost the rate of the unpriced road."""
    joined = covered.join(edges.select("edge_id", "speed_kmh", (F.col("toll_road") > 0).alias("tolled")), "edge_id", "left")
    seconds = F.col("metres") / (F.coalesce(F.col("speed_kmh"), F.lit(UNCOVERED_KMH)) / F.lit(3.6))
    tolled = F.sum(F.when(F.col("tolled"), F.col("metres")).otherwise(0.0))
    sums = joined.groupBy("line_id").agg(
        F.sum("metres").alias("metres"), F.sum(F.when(F.col("edge_id").isNull(), F.col("metres")).otherwise(0.0)).alias("uncovered_m"),
        tolled.alias("toll_m"), F.sum(seconds).alias("drive_s"),
    )
    sums = sums.withColumns({"distance_s": F.col("metres") / 1000 * cfg.neutral_s_per_km, "toll_s": F.col("toll_m") / 1000 * cfg.toll_rate_per_km[3] * (3600 / cfg.rupees_per_hour)})
    return sums.withColumn("cost_s", F.col("drive_s") + F.col("distance_s") + F.col("toll_s"))


def named_roads(covered: DataFrame, edges: DataFrame, most: int = 8) -> DataFrame:
    """The roads that make up most of each line: (line_id, name, class_rank, metres, rank), uncovered stretches left out."""
    on = covered.join(edges.select("edge_id", F.coalesce("name", F.lit("(unnamed)")).alias("name"), "class_rank"), "edge_id")
    sums = on.groupBy("line_id", "name", "class_rank").agg(F.sum("metres").alias("metres"))
    order = W.partitionBy("line_id").orderBy(F.desc(F.round("metres", 6)), "name", "class_rank")
    return sums.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def compare_terms(ours: DataFrame, theirs: DataFrame, key: str, terms: Sequence[str]) -> DataFrame:
    """(key, term, ours, theirs, gap) of two priced tables, term by term."""

    def long(df, name):
        return df.unpivot(key, list(terms), "term", name)

    return long(ours, "ours").join(long(theirs, "theirs"), [key, "term"]).withColumn("gap", F.col("theirs") - F.col("ours"))


def divergence_verdict(uncovered_m: Column, nodes_missing: Column, matched_s: Column, theirs_s: Column, error_s: Column) -> Column:
    """Why another router's line differs from ours, in the order in which causes have to be ruled out. A verdict against
    the router has to beat a minute and twice the error of pricing a line by its middles."""
    margin = F.greatest(F.lit(60.0), error_s * 2)
    gone = uncovered_m > UNCOVERED_MOST_M
    return (
        F.when(gone & (nodes_missing > 0), "OUTSIDE AREA").when(gone, "GRAPH").when(matched_s.isNull(), "UNDECIDED")
        .when(theirs_s < matched_s - margin, "ROUTER").when(theirs_s < matched_s, "TOO CLOSE TO CALL").otherwise("COST MODEL")
    )


def causes(pairs: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """A report's pairs with their cause, - where none was found."""
    return pairs.join(verdicts.select(key, "cause"), key, "left").fillna("-", ["cause"])


def toll_usage(runs: DataFrame, routes: DataFrame) -> DataFrame:
    """(kind, label, amount): kilometres by toll road over all runs, and routes with tolls by confidence and by display."""
    roads = runs.groupBy(F.col("toll_road").cast("string").alias("label")).agg((F.sum("metres") / 1000).alias("amount")).withColumn("kind", F.lit("road_km"))
    paid = runs.groupBy("query_id").agg(F.sum("metres").alias("toll_m")).join(routes, "query_id").filter("toll_m > 0")
    paid = paid.withColumn("display", toll_display(F.col("confidence"), F.col("toll_m")))
    pairs = paid.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("label")) for k in ("confidence", "display")])).alias("x")).select("x.*")
    counts = pairs.groupBy("kind", "label").agg(F.count(F.lit(1)).cast("double").alias("amount"))
    return roads.select("kind", "label", "amount").unionByName(counts)


def clusters(points: DataFrame, key: str, x: str, gap: float = INTERCHANGE_KM) -> DataFrame:
    """(key, start, held): points along each road as clusters. A point nearer than gap to its cluster's start joins it;
    the next one starts another. Not the gap to the point before, so no window says it: roads are dealt out, sorted and
    streamed through a fold that keeps one start."""
    import pandas as pd

    kind = points.schema[key].dataType.simpleString()

    def fold(frames):
        road, start, held = None, 0.0, 0
        for f in frames:
            out = []
            for who, at in zip(f[key], f[x]):
                if held and who == road and at - start < gap:
                    held += 1
                    continue
                if held:
                    out.append((road, start, held))
                road, start, held = who, at, 1
            yield pd.DataFrame(out, columns=[key, "start", "held"])
        if held:
            yield pd.DataFrame([(road, start, held)], columns=[key, "start", "held"])

    return points.select(key, x).filter(F.col(x).isNotNull()).repartition(key).sortWithinPartitions(key, x).mapInPandas(fold, f"{key} {kind}, start double, held bigint")


def nearest_value(predicted: Column, values: Sequence[float], cap: float) -> Column:
    """struct(value, residual): the value nearest to a prediction (of equals the first), value null beyond the cap. The
    values are a literal array of fixed length: no join."""
    near = F.array(*[F.struct(F.abs(F.lit(v) - predicted).alias("far"), F.lit(i).alias("i"), F.lit(v).alias("value"), (F.lit(v) - predicted).alias("residual")) for i, v in enumerate(values)])
    best = F.array_min(near)
    return F.struct(F.when(best["far"] <= cap, best["value"]).alias("value"), best["residual"].alias("residual"))


def fit_anchor(features: DataFrame, key: str, km: str, plazas: Sequence[float] = PLAZA_KM, cap: float = PLAZA_CAP_KM, anchors=ANCHORS_KM) -> DataFrame:
    """(key, anchor, total): the anchor from which plazas lie nearest to a road's features (km from its southern end), by
    the sum of squared distances, each cut off at the cap; of equal sums the lowest anchor.

    The grid has a fixed size. Features are counted by metre first, so a road sends a bounded number of rows to it."""
    first, last, per_km = anchors
    held = features.groupBy(key, (F.floor(F.col(km) * 1000 + 0.5) / 1000).alias("km")).agg(F.count(F.lit(1)).alias("held"))
    grid = held.withColumn("anchor", F.explode(F.transform(F.sequence(F.lit(first * per_km), F.lit(last * per_km)), lambda i: i / per_km)))
    off = F.least(*[F.abs(F.lit(p) - (F.col("anchor") - F.col("km"))) for p in plazas], F.lit(cap))
    sums = grid.groupBy(key, "anchor").agg(F.round(F.sum(F.col("held") * off * off), 6).alias("total"))
    return sums.groupBy(key).agg(F.min(F.struct("total", "anchor")).alias("best")).select(key, "best.anchor", "best.total")


def gates_on_roads(gates: DataFrame, way_nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """(node_id, roads, classes): the names and classes of the roads (way_id, road_name, class_rank) that each gate sits on."""
    on = way_nodes.join(gates.select("node_id").distinct(), "node_id", "left_semi").select("way_id", "node_id").distinct().join(ways, "way_id")
    return on.groupBy("node_id").agg(F.array_sort(F.collect_set("road_name")).alias("roads"), F.array_sort(F.collect_set("class_rank")).alias("classes"))


def meeting_roads(mainline: DataFrame, way_nodes: DataFrame, ways: DataFrame, lat: float, lon: float, radius_m: float = 6000.0) -> DataFrame:
    """(road_name, class_rank, distance_m): roads that share a node with the mainline's ways (way_id) within a radius of a
    stretch's end, and how near to it they do. Nodes (way_id, node_id, lat, lon) are cut to the radius before they are joined."""
    near = way_nodes.withColumn("d", haversine(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))).filter(F.col("d") <= radius_m)
    own = near.join(mainline.select("way_id"), "way_id", "left_semi").select("node_id").distinct()
    other = near.join(mainline.select("way_id"), "way_id", "left_anti").join(own, "node_id", "left_semi")
    return other.join(ways, "way_id").groupBy("road_name", "class_rank").agg(F.min("d").alias("distance_m"))


def joins_and_leaves(steps: DataFrame, road: Column) -> DataFrame:
    """(query_id, first_edge, last_edge, stretches): where each route (query_id, i, edge_id) joins and leaves a road, and on
    how many separate stretches it drives along it."""
    w = W.partitionBy("query_id").orderBy("i")
    marked = steps.withColumn("on", F.coalesce(road, F.lit(False)))
    marked = marked.withColumn("fresh", F.col("on") & ~F.coalesce(F.lag("on").over(w), F.lit(False))).filter("on")
    ends = [f(F.struct("i", "edge_id"))["edge_id"].alias(n) for f, n in ((F.min, "first_edge"), (F.max, "last_edge"))]
    return marked.groupBy("query_id").agg(*ends, F.count_if("fresh").alias("stretches"))


def exposure(distances: DataFrame, by: str, x: str, within: float) -> DataFrame:
    """Percentiles (by floor) of the distance to the nearest opposing road, by group, and the share within a distance."""
    from waygrid.operators.analytics import quantile_floor

    near = distances.groupBy(by).agg(F.count(F.lit(1)).alias("n"), (F.count_if(F.col(x) <= within) / F.count(F.lit(1))).alias("share"))
    return quantile_floor(distances, [by], x, (0.05, 0.5, 0.95)).join(near, by)


def end_pairs(ends: DataFrame, booths: DataFrame, key: Sequence[str]) -> DataFrame:
    """The booths (booth, olat, olon) nearest to both ends of stretches (key, side 1 and 2, lat, lon), as an unordered pair
    (one <= other) with the metres that the ends are off, together."""
    placed = ends.withColumn("end", F.struct(*key, "side"))
    near = spatial.k_nearest(placed, booths, 1, "end", "booth").select(*key, "side", "booth", "distance_m")
    both = near.groupBy(*key).agg(F.min("booth").alias("one"), F.max("booth").alias("other"), F.sum("distance_m").alias("off_m"), F.count(F.lit(1)).alias("ends"))
    return both.filter("ends = 2").drop("ends")
