"""The routing network as one job: classified ways, vertices, directed edges, largest component, dense numbers; what
became of each way; relations in a clip; ways chained into runs with distances along them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from waygrid.config import CHAINAGE_SOUTH_KM
from waygrid.functions.geo import haversine
from waygrid.operators import graph, ingest, profile
from waygrid.plans.lineage import cut


def numbered(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Adds consecutive numbers from 0 in the order given.

    Rows are dealt by ranges, sorted and counted in their ranges; only the counts meet in one task. The written table
    keeps the places, so that a lost executor does not deal the rows differently."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    placed = cut(ranged).withColumn("part", F.shiftright("place", 33)).withColumn("place", F.col("place").bitwiseAND((1 << 33) - 1))
    counts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("held"))
    before = F.coalesce(F.sum("held").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("part", before.alias("before"))  # a row a partition
    return placed.join(F.broadcast(offsets), "part").withColumn(name, F.col("place") + F.col("before")).drop("part", "place", "before")


def directed_edges(refs: DataFrame, classified: DataFrame) -> DataFrame:
    """Directed edges between nodes of resolved references (way_id, pos, node_id, lat, lon): one for each direction that
    a piece of a way may be driven in, as long as the piece."""
    order = W.partitionBy("way_id").orderBy("pos", "node_id")
    vertices = graph.vertex_nodes(refs)
    is_vertex = vertices.select("node_id", F.lit(1).alias("is_vertex"))
    stepped = refs.join(is_vertex, "node_id", "left").withColumn("piece", F.sum(F.coalesce("is_vertex", F.lit(0))).over(order))
    stepped = stepped.withColumns({"nlat": F.lead("lat").over(order), "nlon": F.lead("lon").over(order)}).filter("nlat is not null")
    lengths = stepped.groupBy("way_id", "piece").agg(F.sum(haversine(F.col("lat"), F.col("lon"), F.col("nlat"), F.col("nlon"))).alias("length_m"))
    pieces = graph.split_ways(refs.select("way_id", "pos", "node_id"), vertices).join(lengths, ["way_id", "piece"]).join(classified, "way_id")
    ways = [("forward", "node_from", "node_to", 0), ("backward", "node_to", "node_from", 1)]
    each = F.array(*[F.when(F.col(allowed), F.struct(F.col(a).alias("edge_from"), F.col(b).alias("edge_to"), F.lit(r).alias("reversed"))) for allowed, a, b, r in ways])
    out = pieces.withColumn("e", F.explode(F.array_compact(each)))
    return out.select("way_id", "piece", "e.*", "length_m", "speed_kmh", "class_rank", "private", "toll", "toll_road", "road_name")


def build(way_nodes: DataFrame, ways: DataFrame, nodes: DataFrame) -> dict[str, DataFrame]:
    """The network of tagged ways (way_id, tags), their references (way_id, pos, node_id) and nodes (node_id, lat, lon):
    tables vertices, edges, names, and all_edges as they were before the largest component was taken.

    Vertices are numbered by node id, edges by way, piece and direction, names by their first way; -1 is no name."""
    classified = profile.classify(ways).filter("drivable").drop("tags")
    driven = way_nodes.join(classified.select("way_id"), "way_id", "left_semi")
    refs = cut(ingest.resolve(driven, nodes).select("way_id", "pos", "node_id", "lat", "lon"))
    edges = cut(directed_edges(refs, classified))
    kept = cut(graph.largest_component(graph.strong_components(edges)).withColumnRenamed("vertex_id", "node_id"))
    vertices = numbered(kept, ["node_id"], "vertex_id")
    ends = [vertices.select(F.col("node_id").alias(end), F.col("vertex_id").alias(f"v_{end}")) for end in ("edge_from", "edge_to")]
    named = classified.filter("road_name is not null").groupBy("road_name").agg(F.min("way_id").alias("first_way"))
    names = numbered(named, ["first_way"], "name_id").select("name_id", "road_name")
    inside = edges.join(ends[0], "edge_from").join(ends[1], "edge_to").drop("edge_from", "edge_to").withColumnsRenamed({"v_edge_from": "edge_from", "v_edge_to": "edge_to"})
    inside = inside.join(names, "road_name", "left").withColumn("name_id", F.coalesce("name_id", F.lit(-1))).drop("road_name")
    return {"vertices": vertices, "edges": numbered(inside, ["way_id", "piece", "reversed"], "edge_id"), "names": names, "all_edges": edges}


def build_stats(built: dict[str, DataFrame]) -> DataFrame:
    """One row: vertices and edges before and after, one-way edges and kilometres kept."""
    before = built["all_edges"]
    ends = before.select(F.explode(F.array("edge_from", "edge_to")).alias("v")).agg(F.countDistinct("v").alias("vertices_before"))
    other_way = before.groupBy("way_id", "piece").agg(F.count(F.lit(1)).alias("directions"))
    counts = other_way.agg(F.sum("directions").alias("edges_before"), F.count_if(F.col("directions") == 1).alias("oneway_edges"))
    after = built["edges"].agg(F.count(F.lit(1)).alias("edges_after"), (F.sum("length_m") / 1000).alias("km"))
    held = built["vertices"].agg(F.count(F.lit(1)).alias("vertices_after"))
    return ends.crossJoin(counts).crossJoin(after).crossJoin(held)  # one row each


def way_verdicts(asked: DataFrame, clipped: DataFrame, graph_ways: DataFrame) -> DataFrame:
    """What became of each way asked for (way_id), in the order in which the build removes ways: clipped has way_id and
    tags, graph_ways the way_id of those that have edges."""
    found = asked.select("way_id").distinct().join(profile.classify(clipped), "way_id", "left")
    found = found.join(graph_ways.select("way_id", F.lit(True).alias("held")).distinct(), "way_id", "left")
    cause = F.when(F.col("tags").isNull(), "outside-build-area").when(F.col("held"), "present").when(~F.col("drivable"), "excluded-by-profile").otherwise("dropped-by-scc")
    name = F.coalesce(profile.tag("name"), profile.tag("ref"), F.lit(""))
    return found.select("way_id", cause.alias("cause"), F.coalesce(profile.tag("highway"), F.lit("")).alias("highway"), name.alias("name"))


def keep_relation(tags: str = "tags") -> Column:
    """Relations that some later step reads: restrictions, areas, boundaries, and whatever has a name."""
    kind = F.coalesce(profile.tag("type", tags), F.lit(""))
    return kind.isin("restriction", "multipolygon", "boundary") | F.map_contains_key(tags, "name")


def clip_relations(relations: DataFrame, members: DataFrame, kept_ways: DataFrame, nodes_inside: DataFrame) -> DataFrame:
    """(rel_id, kept, nested) of the relations (rel_id, tags) that a clip reads: kept if a member (rel_id, pos, kind, ref)
    is a kept way or a node inside. Nested relations don't count as touching; nested is how many come before the first
    member that does. One shuffle by relation after the semi joins' marks."""
    read = members.join(relations.filter(keep_relation()).select("rel_id"), "rel_id", "left_semi")
    marks = kept_ways.select(F.lit("way").alias("kind"), F.col("way_id").alias("ref")).unionByName(nodes_inside.select(F.lit("node").alias("kind"), F.col("node_id").alias("ref")))
    marked = read.join(marks.distinct().withColumn("hit", F.lit(True)), ["kind", "ref"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    before = W.partitionBy("rel_id").orderBy("pos", "kind", "ref").rowsBetween(W.unboundedPreceding, -1)
    marked = marked.withColumn("touched", F.coalesce(F.max("hit").over(before), F.lit(False)))
    return marked.groupBy("rel_id").agg(F.max("hit").alias("kept"), F.count_if((F.col("kind") == "relation") & ~F.col("touched")).alias("nested"))


def successors(ways: DataFrame) -> DataFrame:
    """(way_id, before): the way that leads into each way (way_id, head, tail), or null. Where several ways end and start
    at a node, they are paired in the order of their ids, so every way has one way before and one after at most."""
    starts = ways.select(F.col("head").alias("node"), "way_id", F.row_number().over(W.partitionBy("head").orderBy("way_id")).alias("k"))
    ends = ways.select(F.col("tail").alias("node"), F.col("way_id").alias("before"), F.row_number().over(W.partitionBy("tail").orderBy("way_id")).alias("k"))
    return starts.join(ends, ["node", "k"], "left").select("way_id", "before")


def _ranked(ways: DataFrame) -> DataFrame:
    """List ranking by pointer doubling over (way_id, before, metres): adds up, the way that the pointer has come to
    (null: the head of a run was passed), start, the head, start_m, metres from the head, and least, the smallest way passed."""
    now = cut(ways.select("way_id", F.col("before").alias("up"), F.coalesce("before", "way_id").alias("start"), F.lit(0.0).alias("start_m"), F.col("way_id").alias("least"), "metres"))
    # metres of a way belong to what comes after it: a pointer's reach is the metres of the ways jumped over
    now = cut(now.join(ways.select(F.col("way_id").alias("up"), F.col("metres").alias("reach")), "up", "left").withColumn("start_m", F.coalesce("reach", F.lit(0.0))).drop("reach", "metres"))
    rounds = max(1, ways.count()).bit_length() + 1
    for _ in range(rounds):
        far = now.select(F.col("way_id").alias("up"), F.col("up").alias("far"), F.col("start").alias("far_start"), F.col("start_m").alias("far_m"), F.col("least").alias("far_least"))
        joined = now.join(far, "up", "left")
        passed = F.col("up").isNotNull()
        step = joined.select(
            "way_id", F.col("far").alias("up"), F.when(passed, F.col("far_start")).otherwise(F.col("start")).alias("start"),
            (F.col("start_m") + F.coalesce("far_m", F.lit(0.0))).alias("start_m"), F.least("least", "far_least").alias("least"),
        )
        now = cut(step)
        if not now.filter("up is not null").take(1):
            break
    return now


def chain(ways: DataFrame) -> DataFrame:
    """(way_id, run, start_m): ways (way_id, head, tail, metres) chained head to tail into runs, named after their first
    way, and the metres before each way. A ring has no first way: it is opened before its smallest one.

    Pointer doubling: rounds grow with the logarithm of the longest run, each a join by way."""
    linked = cut(ways.join(successors(ways), "way_id").select("way_id", "before", "metres"))
    ranked = _ranked(linked)
    rings = ranked.filter("up is not null").select("way_id", "least")
    if not rings.take(1):
        return ranked.select("way_id", F.col("start").alias("run"), "start_m")
    opened = linked.join(rings, "way_id").withColumn("before", F.when(F.col("way_id") != F.col("least"), F.col("before"))).select("way_id", "before", "metres")
    return ranked.filter("up is null").unionByName(_ranked(cut(opened))).select("way_id", F.col("start").alias("run"), "start_m")


def chainage(refs: DataFrame, south_km: float = CHAINAGE_SOUTH_KM) -> DataFrame:
    """(node_id, run, km_from_south, chainage_km) of the nodes on chained ways (way_id, pos, node_id, lat, lon).

    Each run is measured from its own southern end, where the chainage is south_km, and counts down northwards. A node on
    several runs takes the lowest run, and its first place on it."""
    order = W.partitionBy("way_id").orderBy("pos")
    step = F.coalesce(haversine(F.lag("lat").over(order), F.lag("lon").over(order), F.col("lat"), F.col("lon")), F.lit(0.0))
    along = refs.withColumn("step", step).withColumn("along_m", F.sum("step").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    along = cut(along)
    first, last = F.min(F.struct("pos", "node_id")), F.max(F.struct("pos", "node_id"))
    ways = along.groupBy("way_id").agg(first["node_id"].alias("head"), last["node_id"].alias("tail"), F.max("along_m").alias("metres"))
    placed = along.join(chain(ways), "way_id").withColumn("run_m", F.col("start_m") + F.col("along_m"))
    sides = placed.groupBy("run").agg(F.min(F.struct("run_m", "lat"))["lat"].alias("first_lat"), F.max(F.struct("run_m", "lat"))["lat"].alias("last_lat"), F.max("run_m").alias("total_m"))
    metres = F.when(F.col("first_lat") <= F.col("last_lat"), F.col("run_m")).otherwise(F.col("total_m") - F.col("run_m"))
    measured = placed.join(sides, "run").groupBy("node_id").agg(F.min(F.struct("run", "run_m", (metres / 1000).alias("km"))).alias("m"))
    return measured.select("node_id", "m.run", F.col("m.km").alias("km_from_south"), (south_km - F.col("m.km")).alias("chainage_km"))
