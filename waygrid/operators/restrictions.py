"""Turn restrictions: relations resolved to banned pairs and triples of edges, each with a verdict and a reason; and
toll ramps attributed to the roads they touch."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from waygrid.plans.lineage import cut

#: Restriction kinds that are understood.
KINDS = ("no_right_turn", "no_left_turn", "no_u_turn", "no_straight_on", "no_entry", "no_exit", "only_right_turn", "only_left_turn", "only_straight_on", "only_u_turn")


#: Reasons that leave a turn open which should be closed; all others are ignored rightly.
NOT_HONOURED = ("via-way-chain-unsupported", "via-node-dropped-by-scc", "member-way-dropped-by-scc", "member-way-wrong-direction-at-via")


@dataclass(frozen=True)
class Stages:
    """What each stage of a build still held: nodes (node_id) and ways (way_id) of the clip, ways that cars may use
    (way_id), and vertices (vertex_id) before the largest component was taken."""

    clip_nodes: DataFrame
    clip_ways: DataFrame
    drivable_ways: DataFrame
    vertices_before: DataFrame


def removed_ways(ways: DataFrame, edges: DataFrame, stages: Stages) -> DataFrame:
    """(way_id, removed_by) of the ways that have no edges: the first stage that does not hold them any more."""
    marks = [("has_edges", edges), ("in_clip", stages.clip_ways), ("drivable", stages.drivable_ways)]
    out = ways.distinct()
    for name, table in marks:
        out = out.join(table.select("way_id", F.lit(True).alias(name)).distinct(), "way_id", "left")
    stage = F.when(F.col("in_clip").isNull(), "outside-clip").when(F.col("drivable").isNull(), "not-drivable").otherwise("dropped-by-scc")
    return out.filter("has_edges is null").select("way_id", stage.alias("removed_by"))


def removed_nodes(nodes: DataFrame, vertices: DataFrame, stages: Stages) -> DataFrame:
    """(node_id, removed_by) of the nodes that are no vertices: not in the clip, never one, or one of another component."""
    out = nodes.distinct().join(vertices.select(F.col("vertex_id").alias("node_id")).distinct(), "node_id", "left_anti")
    out = out.join(stages.clip_nodes.select("node_id", F.lit(True).alias("in_clip")).distinct(), "node_id", "left")
    out = out.join(stages.vertices_before.select(F.col("vertex_id").alias("node_id"), F.lit(True).alias("was_vertex")).distinct(), "node_id", "left")
    stage = F.when(F.col("in_clip").isNull(), "outside-clip").when(F.col("was_vertex").isNull(), "not-an-intersection").otherwise("dropped-by-scc")
    return out.select("node_id", stage.alias("removed_by"))


def _judged(relations: DataFrame, vertices: DataFrame, edges: DataFrame, stages: Stages | None) -> DataFrame:
    """Adds the first reason, if any, that shows before edges are joined: the relation's own, then its via member's, then
    those of the ways it comes from and goes to."""
    is_vertex = vertices.select(F.col("vertex_id").alias("via_vertex")).distinct()
    r = relations.join(is_vertex, F.col("via_node") == F.col("via_vertex"), "left")
    at_node = F.col("via_node").isNotNull()
    no_vertex = at_node & F.col("via_vertex").isNull()
    reason = (
        F.when(F.col("conditional"), "conditional")
        .when(F.coalesce(F.trim("kind"), F.lit("")) == "", "malformed-roles")
        .when(~F.col("kind").isin(*KINDS), "unknown-restriction-value")
        .when(F.col("from_way").isNull() | F.col("to_way").isNull() | (F.col("via_node").isNull() & F.col("via_way").isNull()), "malformed-roles")
    )
    if "n_via" in relations.columns:
        reason = reason.when(~at_node & (F.col("n_via") > 1), "via-way-chain-unsupported")
    if stages is None:
        return r.withColumn("reason", reason.when(no_vertex, "via-node-not-an-intersection"))
    ways = cut(removed_ways(relations.select(F.explode(F.array("from_way", "to_way", "via_way")).alias("way_id")).filter("way_id is not null"), edges, stages))
    nodes = removed_nodes(relations.select(F.col("via_node").alias("node_id")).filter("node_id is not null"), vertices, stages)
    for name in ("from", "to", "via"):
        own = ways.select(F.col("way_id").alias(f"{name}_gone"), F.col("removed_by").alias(f"{name}_by"))
        r = r.join(own, F.col(f"{name}_way") == F.col(f"{name}_gone"), "left")
    r = r.join(nodes.select(F.col("node_id").alias("node_gone"), F.col("removed_by").alias("node_by")), F.col("via_node") == F.col("node_gone"), "left")
    member = F.when(~at_node & F.col("via_by").isNotNull(), F.col("via_by")).otherwise(F.coalesce("from_by", "to_by"))
    reason = reason.when(no_vertex, F.concat(F.lit("via-node-"), "node_by")).when(member.isNotNull(), F.concat(F.lit("member-way-"), member))
    return r.select(*relations.columns, "via_vertex", reason.alias("reason"))


def resolve(relations: DataFrame, edges: DataFrame, vertices: DataFrame, stages: Stages | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Verdicts (rel_id, verdict, reason), banned pairs and banned triples.

    relations: rel_id, kind, conditional, from_way, to_way, via_node or via_way, and n_via (how many via ways) if there may
    be several. edges: edge_id, way_id, edge_from, edge_to. With stages, members that the build removed name the stage. no_* bans the named turn; only_* bans all others, but not back along the way one came by. The first
    check that fails names the reason; what the profile leaves out on purpose is correctly ignored, and a relation whose
    ways do not lead through its via member is not honoured."""
    judged = cut(_judged(relations, vertices, edges, stages))
    open_ = judged.filter("reason is null").select("rel_id", F.col("kind").startswith("no_").alias("forbids"), "from_way", "to_way", "via_node", "via_way")
    into = edges.select(F.col("edge_id").alias("from_edge"), F.col("way_id").alias("in_way"), F.col("edge_to").alias("at"))
    out = edges.select(F.col("edge_id").alias("to_edge"), F.col("way_id").alias("out_way"), F.col("edge_from").alias("leaves"))
    wanted = (F.col("forbids") & (F.col("out_way") == F.col("to_way"))) | (~F.col("forbids") & (F.col("out_way") != F.col("to_way")) & (F.col("out_way") != F.coalesce("via_way", "from_way")))

    named = F.col("out_way") == F.col("to_way")

    by_node = open_.filter("via_node is not null")
    arriving = by_node.join(into, (F.col("from_way") == F.col("in_way")) & (F.col("via_node") == F.col("at")))
    at_node = F.col("via_node") == F.col("leaves")
    turns = arriving.join(out, at_node & wanted).select("rel_id", "from_edge", F.lit(None).cast("long").alias("via_edge"), "to_edge")

    via = edges.select(F.col("edge_id").alias("via_edge"), F.col("way_id").alias("mid_way"), F.col("edge_from").alias("mid_from"), F.col("edge_to").alias("mid_to"))
    by_way = open_.filter("via_node is null").join(via, F.col("via_way") == F.col("mid_way"))
    along = by_way.join(into, (F.col("from_way") == F.col("in_way")) & (F.col("mid_from") == F.col("at")))
    at_end = F.col("mid_to") == F.col("leaves")
    spans = along.join(out, at_end & wanted).select("rel_id", "from_edge", "via_edge", "to_edge")

    led = arriving.join(out, at_node & named).select("rel_id").union(along.join(out, at_end & named).select("rel_id"))
    led = cut(led.distinct())
    bans = cut(turns.unionByName(spans).distinct().join(led, "rel_id", "left_semi"))
    j = judged.join(led.withColumn("leads", F.lit(True)), "rel_id", "left")
    reason = F.coalesce("reason", F.when(F.col("leads").isNull(), "member-way-wrong-direction-at-via"))
    verdict = F.when(reason.isNull(), "resolved").when(reason.isin(*NOT_HONOURED), "not-honoured").otherwise("correctly-ignored")
    verdicts = j.select("rel_id", verdict.alias("verdict"), reason.alias("reason"))
    pairs = bans.filter("via_edge is null").select("from_edge", "to_edge").distinct()
    triples = bans.filter("via_edge is not null").select("from_edge", "via_edge", "to_edge").distinct()
    return verdicts, pairs, triples


def verdict_report(verdicts: DataFrame) -> DataFrame:
    """Relations by verdict and reason, and by verdict alone."""
    return verdicts.groupingSets([["verdict"], ["verdict", "reason"]], "verdict", "reason").agg(F.count(F.lit(1)).alias("relations"), F.grouping("reason").cast("long").alias("overall"))


def attribute_ramps(way_nodes: DataFrame, roads: DataFrame, rounds: int = 8) -> DataFrame:
    """(way_id, road): ways without a road join the road with which they share most nodes, the lower road of equals;
    what was claimed in a round counts from the next one on, until nothing is claimed or the rounds are over."""
    touches = way_nodes.select("way_id", "node_id").distinct()
    claimed = roads.select("way_id", "road")
    for _ in range(rounds):
        held = touches.join(claimed, "way_id").select("node_id", "road").distinct()
        shared = touches.join(claimed, "way_id", "left_anti").join(held, "node_id").groupBy("way_id", "road").agg(F.count(F.lit(1)).alias("n"))
        best = shared.withColumn("turn", F.row_number().over(W.partitionBy("way_id").orderBy(F.desc("n"), "road"))).filter("turn = 1").select("way_id", "road")
        fresh = cut(best)
        if not fresh.take(1):
            break
        claimed = claimed.unionByName(fresh)
    return claimed
