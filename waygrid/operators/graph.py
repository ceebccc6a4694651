"""Routing graph: vertices, way splitting, adjacency, turn costs, restrictions, components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from waygrid.config import CIRCLE_M, EARTH_M, Objective, TurnCost
from waygrid.functions import lines
from waygrid.functions.geo import bearing, bearing_delta, haversine, manoeuvre_seconds
from waygrid.operators import fields
from waygrid.plans.lineage import cut


def vertex_nodes(way_nodes: DataFrame) -> DataFrame:
    """Nodes that become vertices: an end of a way, or used twice or more, and the number of uses."""
    ends = W.partitionBy("way_id")
    marked = way_nodes.withColumn("end", (F.col("pos") == F.min("pos").over(ends)) | (F.col("pos") == F.max("pos").over(ends)))
    return marked.groupBy("node_id").agg(F.count(F.lit(1)).alias("uses"), F.max("end").alias("end")).filter("end or uses >= 2")


def split_ways(way_nodes: DataFrame, vertices: DataFrame) -> DataFrame:
    """Pieces of ways between vertices: (way_id, piece, node_from, node_to, n_nodes). A vertex belongs to both sides;
    a piece whose ends are equal makes no edge."""
    order = W.partitionBy("way_id").orderBy("pos", "node_id")
    flagged = way_nodes.join(vertices.select("node_id", F.lit(1).alias("is_vertex")), "node_id", "left").withColumn("piece", F.sum(F.coalesce("is_vertex", F.lit(0))).over(order))
    heads = flagged.groupBy("way_id", "piece").agg(F.min(F.struct("pos", "node_id")).alias("head"), F.count(F.lit(1)).alias("held"))
    after = W.partitionBy("way_id").orderBy("piece")
    pieces = heads.withColumn("node_to", F.lead("head.node_id").over(after)).filter(F.col("node_to").isNotNull() & (F.col("piece") > 0))
    return pieces.select("way_id", "piece", F.col("head.node_id").alias("node_from"), "node_to", (F.col("held") + 1).alias("n_nodes")).filter("node_from <> node_to")


def untagged_circles(way_nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """(way_id, span_m, connections) of closed one-way ways that are roundabouts without being tagged so.

    way_nodes: way_id, pos, node_id, lat, lon; ways: way_id, oneway, junction (has the tag), service. Such a way has four
    references or more, the same node at both ends, no pair of nodes further apart than CIRCLE_M, and three nodes or more
    that other references use too. Candidates are taken first, so that pairs are only formed within small circles."""
    uses = way_nodes.groupBy("node_id").agg(F.count(F.lit(1)).alias("uses"))
    ends = way_nodes.groupBy("way_id").agg(F.count(F.lit(1)).alias("refs"), F.min(F.struct("pos", "node_id"))["node_id"].alias("head"), F.max(F.struct("pos", "node_id"))["node_id"].alias("tail"),
                                           F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"))
    high, wide = (F.lit(EARTH_M) * F.radians(b - a) for a, b in ((F.col("south"), F.col("north")), (F.col("west"), F.col("east"))))
    wide = wide * F.least(F.cos(F.radians("south")), F.cos(F.radians("north")))
    closed = ends.filter((F.col("refs") >= 4) & (F.col("head") == F.col("tail")) & (high <= CIRCLE_M + 1) & (wide <= CIRCLE_M + 1))
    closed = closed.join(ways.filter("oneway and not junction and not service").select("way_id"), "way_id", "left_semi").select("way_id")
    nodes = way_nodes.join(closed, "way_id", "left_semi").select("way_id", "node_id", "lat", "lon").distinct().join(uses, "node_id")
    here = nodes.groupBy("way_id").agg(F.count_if(F.col("uses") >= 2).alias("connections"))
    other = nodes.select("way_id", F.col("node_id").alias("other"), F.col("lat").alias("olat"), F.col("lon").alias("olon"))
    busy = nodes.join(here.filter("connections >= 3"), "way_id")
    apart = busy.join(other, "way_id").filter("node_id < other").groupBy("way_id").agg(F.max(haversine(F.col("lat"), F.col("lon"), F.col("olat"), F.col("olon"))).alias("span_m"), F.first("connections").alias("connections"))
    return apart.filter(F.col("span_m") <= CIRCLE_M).select("way_id", "span_m", "connections")


def costs(edges: DataFrame, cfg: Objective = Objective()) -> DataFrame:
    """Seconds of each edge: driving, distance weighed by road quality (and privacy), and a proxy for tolls."""
    quality = F.coalesce(F.element_at(F.array(*map(F.lit, cfg.quality)), F.col("class_rank") + 1), F.lit(1.0))
    rate = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in cfg.toll_rate_per_km.items() for x in p]), F.col("toll_road")), F.lit(0.0))
    km = F.col("length_m") / 1000
    e = edges.withColumn("drive_s", F.col("length_m") / (F.col("speed_kmh") / F.lit(3.6)))
    e = e.withColumn("distance_s", km * cfg.neutral_s_per_km * quality + F.when(F.col("private"), km * cfg.private_s_per_km).otherwise(0.0))
    e = e.withColumn("toll_s", km * rate * (3600 / cfg.rupees_per_hour))
    return e.withColumn("secs", F.col("drive_s") + F.col("distance_s") + F.col("toll_s"))


def adjacency(edges: DataFrame, *columns: str) -> DataFrame:
    """Each edge with each edge that starts where it ends: columns of the first with _in, of the second with _out."""
    a = edges.select(*[F.col(c).alias(f"{c}_in") for c in columns])
    b = edges.select(*[F.col(c).alias(f"{c}_out") for c in columns])
    return a.join(b, F.col("edge_to_in") == F.col("edge_from_out"))


def _turns(edges: DataFrame, shapes: DataFrame | None = None) -> DataFrame:
    """Pairs of edges with what a turn's cost depends on. Bearings are taken once an edge: where it arrives and where it
    departs, over EDGE_WINDOW_M of its shape (edge_id, points in travel order); without shapes edges are straight."""
    straight = bearing(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    if shapes is None:
        e = edges.withColumn("arrives", straight).withColumn("departs", F.col("arrives"))
    else:
        own = shapes.select("edge_id", lines.bearing_in(F.col("points"), bearing=bearing).alias("into"), lines.bearing_out(F.col("points"), bearing=bearing).alias("out"))
        e = edges.join(own, "edge_id", "left").withColumn("arrives", F.coalesce("into", straight)).withColumn("departs", F.coalesce("out", straight))
    degree = edges.groupBy(F.col("edge_from").alias("vertex")).agg(F.count(F.lit(1)).alias("ways_on"))
    pairs = adjacency(e, "edge_id", "edge_from", "edge_to", "shape_id", "reversed", "arrives", "departs", "class_rank").join(degree, F.col("edge_to_in") == F.col("vertex"))
    uturn = (F.col("shape_id_in") == F.col("shape_id_out")) & (F.col("reversed_in") != F.col("reversed_out"))
    return pairs.withColumns({"is_uturn": uturn, "delta": bearing_delta(F.col("arrives_in"), F.col("departs_out"))})


def turn_costs(edges: DataFrame, cfg: TurnCost = TurnCost(), shapes: DataFrame | None = None) -> DataFrame:
    """(edge_in, edge_out, seconds, is_uturn): seconds in single precision. Shapes as for _turns."""
    around = F.when(F.col("ways_on") <= 1, 0.0).otherwise(cfg.uturn_s)
    seconds = F.when(F.col("is_uturn"), around).otherwise(manoeuvre_seconds(F.col("delta"), F.col("class_rank_in"), F.col("class_rank_out"), cfg))
    return _turns(edges, shapes).select(F.col("edge_id_in").alias("edge_in"), F.col("edge_id_out").alias("edge_out"), seconds.cast("float").alias("seconds"), "is_uturn")


def turn_census(edges: DataFrame, cfg: TurnCost = TurnCost()) -> DataFrame:
    """One row: u-turns that cost, those at dead ends, turns across the oncoming lane, and turns onto a lower class."""
    back, on = F.col("is_uturn"), ~F.col("is_uturn")
    return _turns(edges).agg(
        F.count_if(back & (F.col("ways_on") > 1)).alias("uturns"), F.count_if(back & (F.col("ways_on") <= 1)).alias("exempt"),
        F.count_if(on & (F.col("delta") >= cfg.cross_deg)).alias("crossing"), F.count_if(on & (F.col("class_rank_out") > F.col("class_rank_in"))).alias("class_drop"),
    )


def turn_stats(turns: DataFrame) -> DataFrame:
    s = F.col("seconds").cast("double")
    return turns.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(s == 0).alias("free"), F.count_if("is_uturn").alias("uturns"), F.round(F.avg(s), 5).alias("mean_s"), F.round(F.max(s), 5).alias("max_s"))


def legal(pairs: DataFrame, banned: DataFrame) -> DataFrame:
    """Manoeuvres that no pair ban forbids."""
    return pairs.join(banned, (F.col("edge_in") == banned["from_edge"]) & (F.col("edge_out") == banned["to_edge"]), "left_anti")


def illegal_steps(paths: DataFrame, pairs: DataFrame, triples: DataFrame) -> DataFrame:
    """First banned step of each path (path_id, i, edge_id): two lags, then semi joins on both kinds of bans."""
    w = W.partitionBy("path_id").orderBy("i")
    steps = paths.withColumn("via", F.lag("edge_id").over(w)).withColumn("before", F.lag("edge_id", 2).over(w))
    by_pair = steps.join(pairs, (F.col("via") == pairs["from_edge"]) & (F.col("edge_id") == pairs["to_edge"]), "left_semi")
    by_triple = steps.join(triples, (F.col("before") == triples["from_edge"]) & (F.col("via") == triples["via_edge"]) & (F.col("edge_id") == triples["to_edge"]), "left_semi")
    return by_pair.unionByName(by_triple).groupBy("path_id").agg(F.min("i").alias("first_illegal"))


def reachable(edges: DataFrame, seeds: DataFrame, forward: bool = True, most_rounds: int | None = 10_000) -> DataFrame:
    """Vertices that the seeds reach (or that reach them), with their distance in edges. One join a round, on the
    frontier alone; each round ends in the shared folder. most_rounds None: until nothing is new."""
    here, there = ("edge_from", "edge_to") if forward else ("edge_to", "edge_from")
    arcs = edges.select(F.col(here).alias("here"), F.col(there).alias("there")).distinct()
    arcs = cut(arcs)
    seen = cut(seeds.select(F.col("vertex_id"), F.lit(0).alias("hops")).distinct())
    frontier, hops = seen, 0
    while most_rounds is None or hops < most_rounds:
        hops += 1
        fresh = frontier.join(arcs, F.col("vertex_id") == F.col("here")).select(F.col("there").alias("vertex_id")).distinct().join(seen.select("vertex_id"), "vertex_id", "left_anti").withColumn("hops", F.lit(hops))
        frontier = cut(fresh)
        if not frontier.take(1):
            break
        seen = seen.unionByName(frontier)
        if hops % 8 == 0:
            seen = cut(seen)
    return seen


def reachable_by_areas(edges: DataFrame, seeds: DataFrame, forward: bool = True) -> DataFrame:
    """reachable without a limit, in rounds of areas instead of edges, for edges with the places of their ends."""
    ends = (("edge_from", "1"), ("edge_to", "2"))
    (here, a), (there, b) = ends if forward else ends[::-1]
    arcs = edges.groupBy(F.col(here).alias("here"), F.col(there).alias("there")).agg(*[F.min(f"{c}{p}").alias(f"{c}{n}") for n, p in ((1, a), (2, b)) for c in ("lat", "lon")])
    begun = seeds.select(F.lit(0).cast("long").alias("search"), F.col("vertex_id").alias("node"), F.lit(0.0).alias("cost"))
    found = fields.least_costs(arcs.withColumn("step", F.lit(1.0)), begun)
    return found.select(F.col("node").alias("vertex_id"), F.col("cost").cast("int").alias("hops"))


def mutual_groups(arcs: DataFrame) -> DataFrame:
    """(v, root) of vertices that arcs in both directions connect, root being the smallest vertex; others are left out.

    Such vertices are strongly connected. Alternating stars: the rounds grow with the logarithm of a group, not with
    its diameter."""
    back = arcs.select(F.col("b").alias("a"), F.col("a").alias("b"))
    pairs = cut(arcs.join(back, ["a", "b"], "left_semi").filter("a > b").select("a", "b"))
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(least.withColumnRenamed("m", "b")).distinct()
        pairs = cut(small)
        if not pairs.join(pairs.select(F.col("a").alias("b")), "b", "left_semi").take(1) and not pairs.groupBy("a").count().filter("count > 1").take(1):
            return pairs.select(F.col("a").alias("v"), F.col("b").alias("root"))


def strong_components(edges: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """(vertex_id, component) of a directed graph, component being the smallest vertex of it.

    Vertices joined by arcs in both directions become one first, so that long two-way networks take few rounds. Then
    rounds of colouring: vertices without arcs in or out are components of their own; the largest vertex that reaches a
    vertex is its colour; those of a colour that reach its root backwards inside the colour form a component and leave.
    Each step is a join and a minimum or maximum."""
    arcs = cut(edges.select(F.col("edge_from").alias("a"), F.col("edge_to").alias("b")).filter("a <> b").distinct())
    vertices = cut(arcs.select(F.col("a").alias("v")).union(arcs.select(F.col("b").alias("v"))).distinct())
    roots = cut(vertices.join(mutual_groups(arcs), "v", "left").select("v", F.coalesce("root", "v").alias("root")))
    ends = roots.select(F.col("v").alias("a"), F.col("root").alias("ra")), roots.select(F.col("v").alias("b"), F.col("root").alias("rb"))
    arcs = cut(arcs.join(ends[0], "a").join(ends[1], "b").filter("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
    named = _components(arcs, roots.select(F.col("root").alias("v")).distinct(), most_rounds)
    return roots.join(named, "root").select(F.col("v").alias("vertex_id"), "component")


def _components(arcs: DataFrame, vertices: DataFrame, most_rounds: int) -> DataFrame:
    """(root, component) of the vertices by rounds of trimming and colouring."""
    left, done = cut(vertices), None
    for _ in range(most_rounds):
        while True:
            inside = left.join(arcs.select(F.col("a").alias("v")), "v", "left_semi").join(arcs.select(F.col("b").alias("v")), "v", "left_semi")
            stay = cut(inside)
            alone = cut(left.join(stay, "v", "left_anti"))
            if not alone.take(1):
                break
            named = alone.select(F.col("v").alias("root"), F.col("v").alias("component"))
            done = named if done is None else done.unionByName(named)
            left = stay
            arcs = cut(arcs.join(left.select(F.col("v").alias("a")), "a", "left_semi").join(left.select(F.col("v").alias("b")), "b", "left_semi"))
        if not left.take(1):
            return done if done is not None else left.select(F.col("v").alias("root"), F.col("v").alias("component"))
        colour = left.withColumn("c", F.col("v"))
        while True:
            pushed = colour.join(arcs, F.col("v") == F.col("a")).select(F.col("b").alias("v"), "c")
            now = cut(colour.unionByName(pushed).groupBy("v").agg(F.max("c").alias("c")))
            if not now.exceptAll(colour).take(1):
                break
            colour = now
        inner = cut(arcs.join(colour.select(F.col("v").alias("a"), F.col("c").alias("ca")), "a").join(colour.select(F.col("v").alias("b"), F.col("c").alias("cb")), "b").filter("ca = cb").select("a", "b"))
        seeds = colour.filter("v = c")
        found, frontier = seeds, seeds
        while True:
            back = frontier.join(inner, F.col("v") == F.col("b")).select(F.col("a").alias("v"), "c").distinct().join(found.select("v"), "v", "left_anti")
            frontier = cut(back)
            if not frontier.take(1):
                break
            found = cut(found.unionByName(frontier))
        named = found.join(found.groupBy("c").agg(F.min("v").alias("component")), "c").select(F.col("v").alias("root"), "component")
        done = named if done is None else done.unionByName(named)
        left = cut(left.join(found.select("v"), "v", "left_anti"))
        arcs = cut(arcs.join(left.select(F.col("v").alias("a")), "a", "left_semi").join(left.select(F.col("v").alias("b")), "b", "left_semi"))
    raise RuntimeError("strong components did not settle")


def largest_component(components: DataFrame) -> DataFrame:
    """The vertices (vertex_id) of the largest component; of equals the one with the smallest vertex."""
    size = components.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    largest = size.agg(F.max(F.struct("n", (-F.col("component")).alias("low"))).alias("top")).select((-F.col("top.low")).alias("component"))
    return components.join(F.broadcast(largest), "component").select("vertex_id")
