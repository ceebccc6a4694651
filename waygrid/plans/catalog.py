"""Registered queries over the road-network operators, and their SQL twins. Every query covers its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from waygrid.config import AREA_E7, MATCH_M, PLAZA_KM, SNAP_M, TOLLABLE_KM
from waygrid.functions import geo, strings, tiles
from waygrid.operators import analytics, graph, ingest, instructions, profile, restrictions, routing, search, spatial, tolls, tracking
from waygrid.plans import sql
from waygrid.sources import projection as road

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(twin: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if twin:
            ORACLES[f.__name__] = twin
        return f

    return add


def _shapes(spark, sf_dir):
    return road.shapes(road.edges(spark, sf_dir))


# --- spatial joins ---------------------------------------------------------------------------------------------


@query(f"WITH {sql.EDGE}, {sql.FIX}, {sql.near(SNAP_M)} SELECT fix_id, edge_id, round(t, 6) AS fraction, round(distance_m, 4) AS distance_m FROM v_near QUALIFY row_number() OVER (PARTITION BY fix_id ORDER BY distance_m, edge_id) = 1")
def snap_nearest(spark, sf_dir):
    best = spatial.nearest(road.fixes(spark, sf_dir), _shapes(spark, sf_dir), SNAP_M, "fix_id", "edge_id")
    return best.select("fix_id", "edge_id", F.round("t", 6).alias("fraction"), F.round("distance_m", 4).alias("distance_m"))


@query(f"WITH {sql.EDGE}, {sql.FIX}, {sql.near(MATCH_M)} SELECT fix_id, edge_id, round(distance_m, 4) AS distance_m, rank FROM (SELECT *, row_number() OVER (PARTITION BY fix_id ORDER BY distance_m, edge_id) AS rank FROM v_near) WHERE rank <= 8")
def snap_candidates(spark, sf_dir):
    found = spatial.candidates(road.fixes(spark, sf_dir), _shapes(spark, sf_dir), MATCH_M, 8, "fix_id", "edge_id")
    return found.select("fix_id", "edge_id", F.round("distance_m", 4).alias("distance_m"), F.col("rank").cast("long").alias("rank"))


@query(
    f"WITH {sql.EDGE}, {sql.FIX}, {sql.near(SNAP_M)}, b AS (SELECT fix_id, distance_m FROM v_near QUALIFY row_number() OVER (PARTITION BY fix_id ORDER BY distance_m, edge_id) = 1), "
    "d AS (SELECT f.device_id, b.distance_m FROM b JOIN v_fix f USING (fix_id)) SELECT device_id, count(*) AS n, round(quantile_cont(distance_m, 0.5), 4) AS p50, round(quantile_cont(distance_m, 0.95), 4) AS p95, round(quantile_cont(distance_m, 0.99), 4) AS p99, round(max(distance_m), 4) AS max FROM d GROUP BY device_id"
)
def snap_distribution(spark, sf_dir):
    fixes = road.fixes(spark, sf_dir)
    best = spatial.nearest(fixes, _shapes(spark, sf_dir), SNAP_M, "fix_id", "edge_id").join(fixes.select("fix_id", "device_id"), "fix_id")
    s = analytics.summary(best, ["device_id"], "distance_m")
    return s.select("device_id", "n", *[F.round(c, 4).alias(c) for c in ("p50", "p95", "p99", "max")])


@query(
    f"WITH {sql.EDGE}, {sql.FIX}, {sql.near(SNAP_M)}, e AS (SELECT shape_id, bool_and(private) AS private FROM v_edge GROUP BY shape_id), n AS (SELECT v_near.*, private FROM v_near JOIN e USING (shape_id)) "
    "SELECT fix_id, edge_id, private, round(distance_m, 4) AS distance_m FROM n QUALIFY row_number() OVER (PARTITION BY fix_id ORDER BY private, distance_m, edge_id) = 1"
)
def snap_prefer_public(spark, sf_dir):
    edges = road.edges(spark, sf_dir)
    kind = edges.groupBy("shape_id").agg(F.bool_and("private").alias("private"))
    shapes = road.shapes(edges).join(kind, "shape_id").select("edge_id", "private", "alat", "alon", "blat", "blon")
    found = spatial.nearest_preferred(road.fixes(spark, sf_dir).select("fix_id", "lat", "lon"), shapes, SNAP_M, "fix_id", "edge_id", F.col("private"))
    return found.select("fix_id", "edge_id", F.col("second").alias("private"), F.round("distance_m", 4).alias("distance_m"))


@query(
    f"WITH {sql.EDGE}, r AS (SELECT shape_id, unnest(range(floor(least(alat, blat) / 0.0045)::BIGINT, floor(greatest(alat, blat) / 0.0045)::BIGINT + 1)) AS i, alon, blon FROM v_seg), "
    "c AS (SELECT shape_id, i, unnest(range(floor(least(alon, blon) / 0.0045)::BIGINT, floor(greatest(alon, blon) / 0.0045)::BIGINT + 1)) AS j FROM r), n AS (SELECT i, j, count(*) AS held FROM c GROUP BY i, j) SELECT count(*) AS cells, max(held) AS most, sum(held)::BIGINT AS registered FROM n"
)
def cell_occupancy(spark, sf_dir):
    cells = spatial.register(_shapes(spark, sf_dir), 0.0045).groupBy("cell").agg(F.count(F.lit(1)).alias("held"))
    return cells.agg(F.count(F.lit(1)).alias("cells"), F.max("held").alias("most"), F.sum("held").alias("registered"))


# --- edges, costs, turns -----------------------------------------------------------------------------------------


@query(f"WITH {sql.EDGE} SELECT edge_id, edge_from, edge_to, shape_id, reversed, class_rank, speed_kmh, toll_road, private, round(length_m, 5) AS length_m, round(secs, 5) AS secs FROM v_edge")
def edge_costs(spark, sf_dir):
    e = graph.costs(road.edges(spark, sf_dir))
    return e.select("edge_id", "edge_from", "edge_to", "shape_id", "reversed", "class_rank", "speed_kmh", "toll_road", "private", F.round("length_m", 5).alias("length_m"), F.round("secs", 5).alias("secs"))


@query(f"WITH {sql.EDGE}, {sql.TURN} SELECT edge_in, edge_out, round(seconds::DOUBLE, 3) AS seconds, is_uturn FROM v_turn")
def turn_costs(spark, sf_dir):
    return graph.turn_costs(road.edges(spark, sf_dir)).withColumn("seconds", F.round(F.col("seconds").cast("double"), 3))


@query(f"WITH {sql.EDGE}, {sql.TURN} SELECT count(*) AS pairs, count(*) FILTER (seconds = 0) AS free, count(*) FILTER (is_uturn) AS uturns, round(avg(seconds::DOUBLE), 5) AS mean_s, round(max(seconds::DOUBLE), 5) AS max_s FROM v_turn")
def turn_stats(spark, sf_dir):
    return graph.turn_stats(graph.turn_costs(road.edges(spark, sf_dir)))


@query(f"WITH {sql.EDGE} SELECT toll_road, class_rank, count(*) AS edges, round(sum(length_m) / 1000, 5) AS km, round(sum(drive_s), 3) AS drive_s, round(sum(distance_s), 3) AS distance_s, round(sum(toll_s), 3) AS toll_s FROM v_edge GROUP BY ALL")
def cost_parts(spark, sf_dir):
    e = graph.costs(road.edges(spark, sf_dir)).groupBy("toll_road", "class_rank")
    return e.agg(F.count(F.lit(1)).alias("edges"), F.round(F.sum("length_m") / 1000, 5).alias("km"), *[F.round(F.sum(c), 3).alias(c) for c in ("drive_s", "distance_s", "toll_s")])


@query(f"WITH {sql.EDGE} SELECT directions, count(*) AS shapes FROM v_shape GROUP BY directions")
def carriageway_census(spark, sf_dir):
    return _shapes(spark, sf_dir).groupBy("directions").agg(F.count(F.lit(1)).alias("shapes"))


BANNED = "v_ban AS (SELECT a.edge_id AS from_edge, b.edge_id AS to_edge FROM v_edge a JOIN v_edge b ON a.edge_to = b.edge_from WHERE (a.edge_id * 17 + b.edge_id * 3) % 97 = 0)"


def _bans(edges):
    pairs = graph.adjacency(edges, "edge_id", "edge_from", "edge_to").filter((F.col("edge_id_in") * 17 + F.col("edge_id_out") * 3) % 97 == 0)
    return pairs.select(F.col("edge_id_in").alias("from_edge"), F.col("edge_id_out").alias("to_edge"))


def _triples(edges):
    pairs = graph.adjacency(edges, "edge_id", "edge_from", "edge_to").select(F.col("edge_id_in").alias("a"), F.col("edge_id_out").alias("b"), F.col("edge_to_out").alias("at"))
    third = edges.select(F.col("edge_id").alias("c"), F.col("edge_from").alias("starts"))
    return pairs.join(third, F.col("at") == F.col("starts")).filter((F.col("a") + F.col("b") * 5 + F.col("c") * 11) % 997 == 0).select(F.col("a").alias("from_edge"), F.col("b").alias("via_edge"), F.col("c").alias("to_edge"))


@query(f"WITH {sql.EDGE}, {BANNED}, p AS (SELECT a.edge_id AS i, b.edge_id AS o, a.class_rank FROM v_edge a JOIN v_edge b ON a.edge_to = b.edge_from) SELECT class_rank, count(*) AS manoeuvres FROM p WHERE NOT EXISTS (SELECT 1 FROM v_ban WHERE from_edge = i AND to_edge = o) GROUP BY class_rank")
def legal_manoeuvres(spark, sf_dir):
    edges = road.edges(spark, sf_dir)
    pairs = graph.adjacency(edges, "edge_id", "edge_from", "edge_to", "class_rank").select(F.col("edge_id_in").alias("edge_in"), F.col("edge_id_out").alias("edge_out"), F.col("class_rank_in").alias("class_rank"))
    return graph.legal(pairs, _bans(edges)).groupBy("class_rank").agg(F.count(F.lit(1)).alias("manoeuvres"))


TRIPLES = "v_tri AS (SELECT a.edge_id AS x, b.edge_id AS y, c.edge_id AS z FROM v_edge a JOIN v_edge b ON a.edge_to = b.edge_from JOIN v_edge c ON b.edge_to = c.edge_from WHERE (a.edge_id + b.edge_id * 5 + c.edge_id * 11) % 997 = 0)"


@query(f"WITH {sql.EDGE}, {TRIPLES} SELECT count(*) AS triples, count(*) FILTER (NOT EXISTS (SELECT 1 FROM v_tri r WHERE r.x = t.z AND r.y = t.y AND r.z = t.x)) AS asymmetric FROM v_tri t")
def asymmetric_triples(spark, sf_dir):
    t = _triples(road.edges(spark, sf_dir))
    turned = t.select(F.col("to_edge").alias("from_edge"), "via_edge", F.col("from_edge").alias("to_edge"), F.lit(1).alias("back")).distinct()
    return t.join(turned, ["from_edge", "via_edge", "to_edge"], "left").agg(F.count(F.lit(1)).alias("triples"), F.count_if(F.col("back").isNull()).alias("asymmetric"))


# --- ingest -----------------------------------------------------------------------------------------------------

RAW = """
v_li AS (SELECT l_orderkey AS way_id, l_linenumber AS pos, l_suppkey * 13 % 40 + (l_partkey // 25) % 30 * 40 AS node_id FROM lineitem),
v_raw AS (SELECT way_id, pos, node_id, unnest(CASE WHEN way_id % 7 = 0 THEN [0, 1] ELSE [(way_id % 2)::INT] END) AS extract FROM v_li),
v_way AS (SELECT DISTINCT way_id, pos, node_id FROM v_raw)
"""
_BOX = {"lat": (281000000, 281200000), "lon": (774000000, 774250000)}
NODES = f"v_node AS (SELECT c_custkey AS node_id, {sql.lat('c_custkey')} AS lat_e7, {sql.lon('c_custkey')} AS lon_e7 FROM customer)"
IN_BOX = "v_in AS (SELECT node_id FROM v_node WHERE lat_e7 BETWEEN 281000000 AND 281200000 AND lon_e7 BETWEEN 774000000 AND 774250000)"


def _way_nodes(spark, sf_dir):
    """References of each way once, whatever extracts they came in."""
    return road.raw_ways(spark, sf_dir).select("way_id", "pos", "node_id").distinct()


def _nodes(spark, sf_dir):
    return road.vertices(spark, sf_dir).select(F.col("vertex_id").alias("node_id"), "lat_e7", "lon_e7")


def _in_box(spark, sf_dir):
    return _nodes(spark, sf_dir).filter(geo.in_area(F.col("lat_e7"), F.col("lon_e7"), _BOX)).select("node_id")


@query(f"WITH {RAW}, w AS (SELECT way_id, min(extract) AS extract, count(DISTINCT extract) AS copies FROM v_raw GROUP BY way_id) SELECT way_id, extract, copies FROM w")
def union_extracts(spark, sf_dir):
    ways = road.raw_ways(spark, sf_dir).select("way_id", "extract").distinct()
    return ingest.first_written(ways, "way_id", ["extract"]).select("way_id", "extract", "copies")


@query(f"WITH {RAW}, k AS (SELECT way_id, count(DISTINCT extract) AS extracts, count(*) AS copies FROM v_raw GROUP BY way_id) SELECT sum(copies)::BIGINT AS summed, count(*) AS united, count(*) FILTER (extracts > 1) AS shared FROM k")
def seam_statistics(spark, sf_dir):
    return ingest.seam(road.raw_ways(spark, sf_dir), "way_id")


@query(f"WITH {RAW}, {NODES}, {IN_BOX} SELECT DISTINCT way_id FROM v_way WHERE node_id IN (SELECT node_id FROM v_in)")
def clip_ways(spark, sf_dir):
    return ingest.ways_in_area(_way_nodes(spark, sf_dir), _in_box(spark, sf_dir))


@query(f"WITH {RAW}, {NODES}, {IN_BOX}, k AS (SELECT DISTINCT way_id FROM v_way WHERE node_id IN (SELECT node_id FROM v_in)) SELECT DISTINCT node_id FROM v_way WHERE way_id IN (SELECT way_id FROM k) AND node_id NOT IN (SELECT node_id FROM v_in)")
def complete_ways(spark, sf_dir):
    nodes, ways = _in_box(spark, sf_dir), _way_nodes(spark, sf_dir)
    return ingest.complete_nodes(ways, ingest.ways_in_area(ways, nodes), nodes)


RESOLVED = """
v_r0 AS (SELECT v_way.*, lag(node_id) OVER (PARTITION BY way_id ORDER BY pos, node_id) AS before FROM v_way JOIN v_node USING (node_id)),
v_r1 AS (SELECT way_id, pos, node_id FROM v_r0 WHERE before IS NULL OR before <> node_id),
v_res AS (SELECT *, count(*) OVER (PARTITION BY way_id) AS n FROM v_r1 QUALIFY n >= 2)
"""


@query(f"WITH {RAW}, {NODES}, {RESOLVED} SELECT way_id, count(*) AS refs, min(pos) AS first_pos, sum(node_id)::BIGINT AS id_sum FROM v_res GROUP BY way_id")
def resolve_references(spark, sf_dir):
    r = ingest.resolve(_way_nodes(spark, sf_dir), _nodes(spark, sf_dir))
    return r.groupBy("way_id").agg(F.count(F.lit(1)).alias("refs"), F.min("pos").alias("first_pos"), F.sum("node_id").alias("id_sum"))


VERTEX = """
v_m AS (SELECT *, pos = min(pos) OVER (PARTITION BY way_id) OR pos = max(pos) OVER (PARTITION BY way_id) AS tip FROM v_res),
v_vx AS (SELECT node_id, count(*) AS uses, bool_or(tip) AS tip FROM v_m GROUP BY node_id HAVING tip OR uses >= 2)
"""


@query(f"WITH {RAW}, {NODES}, {RESOLVED}, {VERTEX} SELECT node_id, uses, tip AS is_end FROM v_vx")
def way_vertices(spark, sf_dir):
    v = graph.vertex_nodes(ingest.resolve(_way_nodes(spark, sf_dir), _nodes(spark, sf_dir)))
    return v.select("node_id", "uses", F.col("end").alias("is_end"))


@query(
    f"WITH {RAW}, {NODES}, {RESOLVED}, {VERTEX}, f AS (SELECT way_id, pos, r.node_id, sum(CASE WHEN x.node_id IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY way_id ORDER BY pos, r.node_id ROWS UNBOUNDED PRECEDING) AS piece FROM v_res r LEFT JOIN v_vx x ON r.node_id = x.node_id), "
    "h AS (SELECT way_id, piece, min({'pos': pos, 'node_id': node_id}) AS head, count(*) AS held FROM f GROUP BY way_id, piece), n AS (SELECT way_id, piece, head.node_id AS node_from, lead(head.node_id) OVER (PARTITION BY way_id ORDER BY piece) AS node_to, held FROM h) "
    "SELECT way_id, piece::BIGINT AS piece, node_from, node_to, held + 1 AS n_nodes FROM n WHERE node_to IS NOT NULL AND piece > 0 AND node_from <> node_to"
)
def split_ways(spark, sf_dir):
    r = ingest.resolve(_way_nodes(spark, sf_dir), _nodes(spark, sf_dir)).select("way_id", "pos", "node_id")
    return graph.split_ways(r, graph.vertex_nodes(r))


@query(f"WITH v AS (SELECT {sql.lat('c_custkey')} AS a, {sql.lon('c_custkey')} AS o FROM customer) SELECT count(*) AS nodes, count(*) FILTER (a BETWEEN {AREA_E7['lat'][0]} AND {AREA_E7['lat'][1]} AND o BETWEEN {AREA_E7['lon'][0]} AND {AREA_E7['lon'][1]}) AS inside FROM v")
def area_census(spark, sf_dir):
    inside = geo.in_area(F.col("lat_e7"), F.col("lon_e7"), AREA_E7)
    return road.vertices(spark, sf_dir).agg(F.count(F.lit(1)).alias("nodes"), F.count_if(inside).alias("inside"))


@query(
    f"WITH v AS (SELECT {sql.lat('c_custkey')} AS a, {sql.lon('c_custkey')} AS o FROM customer), w AS (SELECT *, a BETWEEN 281000000 AND 281200000 AND o BETWEEN 774000000 AND 774250000 AS exact, a / 1e7 BETWEEN 28.1 AND 28.12 AND o / 1e7 BETWEEN 77.4 AND 77.425 AS float FROM v) "
    "SELECT exact, count(*) AS nodes, count(*) FILTER (exact <> float) AS disagree FROM w GROUP BY exact"
)
def boundary_disagreement(spark, sf_dir):
    v = road.vertices(spark, sf_dir).select(geo.in_area(F.col("lat_e7"), F.col("lon_e7"), _BOX).alias("exact"), geo.in_area_deg(F.col("lat"), F.col("lon"), _BOX).alias("float"))
    return v.groupBy("exact").agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("exact") != F.col("float")).alias("disagree"))


# --- profile ----------------------------------------------------------------------------------------------------

_K = "p_partkey"
TAGS = f"""
v_tag AS (SELECT {_K} AS way_id, {list(road._HIGHWAYS)}[{_K} % 16 + 1] AS highway, CASE WHEN {_K} % 3 <> 0 THEN {list(road._SPEEDS)}[({_K} // 3) % 6 + 1] END AS maxspeed,
  CASE WHEN {_K} % 5 < 3 THEN ['yes', '-1', 'no', 'reverse', '1'][({_K} // 5) % 5 + 1] END AS oneway, CASE WHEN {_K} % 23 = 0 THEN 'roundabout' END AS junction,
  CASE WHEN {_K} % 11 = 0 THEN ['no', 'private', 'yes', 'destination', 'permissive'][({_K} // 11) % 5 + 1] END AS access, CASE WHEN {_K} % 29 = 0 THEN ['no', 'yes', 'private'][({_K} // 29) % 3 + 1] END AS motorcar,
  CASE WHEN {_K} % 7 = 0 THEN ['yes', 'no', 'true', '1'][({_K} // 7) % 4 + 1] END AS toll, CASE WHEN {_K} % 13 = 0 THEN 'yes' END AS toll_motorcar, CASE WHEN {_K} % 4 <> 0 THEN p_name END AS name, CASE WHEN {_K} % 6 = 0 THEN ['NE2', 'NH 24; SH 1', 'yamuna', ' '][({_K} // 6) % 4 + 1] END AS ref FROM part),
v_p0 AS (SELECT *, CASE highway WHEN 'motorway' THEN 90 WHEN 'trunk' THEN 70 WHEN 'primary' THEN 50 WHEN 'secondary' THEN 40 WHEN 'tertiary' THEN 35 WHEN 'unclassified' THEN 30 WHEN 'residential' THEN 25 WHEN 'living_street' THEN 10 WHEN 'service' THEN 15 WHEN 'road' THEN 25 WHEN 'motorway_link' THEN 45 WHEN 'trunk_link' THEN 40 END AS def,
  CASE highway WHEN 'motorway' THEN 0 WHEN 'trunk' THEN 1 WHEN 'primary' THEN 2 WHEN 'secondary' THEN 3 WHEN 'tertiary' THEN 4 WHEN 'unclassified' THEN 5 WHEN 'residential' THEN 6 WHEN 'living_street' THEN 7 WHEN 'service' THEN 7 WHEN 'road' THEN 5 WHEN 'motorway_link' THEN 0 WHEN 'trunk_link' THEN 1 END AS class_rank,
  CASE maxspeed WHEN '50' THEN 50 WHEN '30 mph' THEN 30 * 1.609344 WHEN '80 km/h' THEN 80 END AS posted, coalesce(motorcar, access) AS acc, coalesce(toll, toll_motorcar) IN ('yes', 'true', '1') AS is_toll, coalesce(junction, '') = 'roundabout' OR highway IN ('motorway', 'motorway_link') AS implied FROM v_tag),
v_prof AS (SELECT way_id, highway, class_rank, CASE WHEN acc IN ('no', 'false') THEN 'denied' WHEN acc IN ('private', 'destination') THEN 'private' ELSE 'allowed' END AS access, def IS NOT NULL AND coalesce(acc, '') NOT IN ('no', 'false') AS drivable,
  coalesce(oneway NOT IN ('-1', 'reverse'), true) AS forward, coalesce(oneway IN ('-1', 'reverse'), false) OR NOT coalesce(oneway IN ('yes', '1') OR (oneway IS NULL AND implied), false) AS backward, greatest(1, least(255, floor(coalesce(posted, def) + 0.5)))::INT AS speed_kmh,
  coalesce(is_toll, false) AS toll, CASE WHEN NOT coalesce(is_toll, false) THEN 0 WHEN contains(lower(concat_ws(' ', name, ref)), 'yamuna') THEN 1 WHEN ref = 'NE2' THEN 2 ELSE 3 END AS toll_road, nullif(trim(split_part(coalesce(name, ref), ';', 1)), '') AS road_name, name, ref FROM v_p0)
"""


@query(f"WITH {TAGS} SELECT way_id, access, drivable, forward, backward, CASE WHEN drivable THEN speed_kmh END AS speed_kmh, class_rank, toll, toll_road, road_name FROM v_prof")
def classify_ways(spark, sf_dir):
    c = profile.classify(road.tagged_ways(spark, sf_dir))
    return c.select("way_id", "access", "drivable", "forward", "backward", F.when(F.col("drivable"), F.col("speed_kmh")).alias("speed_kmh"), "class_rank", "toll", "toll_road", "road_name")


@query(f"WITH {TAGS} SELECT highway, count(*) AS ways, count(*) FILTER (drivable) AS drivable, count(*) FILTER (toll) AS tolled, round(quantile_cont(speed_kmh, 0.5) FILTER (drivable), 3) AS median_kmh, round(quantile_cont(speed_kmh, 0.25) FILTER (drivable), 3) AS p25, round(quantile_cont(speed_kmh, 0.75) FILTER (drivable), 3) AS p75 FROM v_prof GROUP BY highway")
def speed_calibration(spark, sf_dir):
    c = profile.classify(road.tagged_ways(spark, sf_dir)).withColumn("highway", profile.tag("highway"))
    s = F.when(F.col("drivable"), F.col("speed_kmh"))
    return c.groupBy("highway").agg(F.count(F.lit(1)).alias("ways"), F.count_if("drivable").alias("drivable"), F.count_if("toll").alias("tolled"), *[F.round(analytics.quantile(s, q), 3).alias(n) for n, q in (("median_kmh", 0.5), ("p25", 0.25), ("p75", 0.75))])


@query(f"WITH {TAGS}, k AS (SELECT class_rank, way_id % 97 AS metres, unnest([CASE WHEN name IS NOT NULL THEN 'name' END, CASE WHEN ref IS NOT NULL THEN 'ref' END]) AS key FROM v_prof) SELECT key, class_rank AS rank, count(*) AS ways, sum(metres)::BIGINT AS metres, grouping(class_rank) AS overall FROM k WHERE key IS NOT NULL GROUP BY GROUPING SETS ((key), (key, class_rank))")
def tag_coverage(spark, sf_dir):
    c = profile.classify(road.tagged_ways(spark, sf_dir)).withColumn("metres", F.col("way_id") % 97)
    return analytics.tag_coverage(c, ["name", "ref"], "class_rank", "metres").withColumn("overall", F.col("overall").cast("long"))


@query(f"WITH {TAGS} SELECT coalesce(road_name, 'unnamed:' || highway) AS road, toll_road, count(*) AS ways, count(DISTINCT highway) AS classes FROM v_prof WHERE toll GROUP BY ALL")
def tolled_roads(spark, sf_dir):
    c = profile.classify(road.tagged_ways(spark, sf_dir)).filter("toll").withColumn("highway", profile.tag("highway"))
    return c.groupBy(F.coalesce("road_name", F.concat(F.lit("unnamed:"), F.col("highway"))).alias("road"), "toll_road").agg(F.count(F.lit(1)).alias("ways"), F.countDistinct("highway").alias("classes"))


# --- routing ----------------------------------------------------------------------------------------------------

_ROUNDS = 4
_ARCS = f"v_arc AS (SELECT edge_in, edge_out, seconds::DOUBLE + e.secs AS step FROM v_turn JOIN v_edge e ON e.edge_id = edge_out WHERE NOT EXISTS (SELECT 1 FROM v_ban WHERE from_edge = edge_in AND to_edge = edge_out))"
_DEPOTS = "v_depot AS (SELECT c_nationkey::BIGINT AS search, min(c_custkey) AS vertex FROM customer GROUP BY c_nationkey)"
_CHAIN = "".join(f", d{k} AS (SELECT search, edge_id, min(cost) AS cost FROM (SELECT * FROM d{k - 1} UNION ALL SELECT search, edge_out, cost + step FROM d{k - 1} JOIN v_arc ON edge_id = edge_in) GROUP BY search, edge_id)" for k in range(1, _ROUNDS + 1))


@query(f"WITH {sql.EDGE}, {sql.TURN}, {BANNED}, {_ARCS}, {_DEPOTS}, d0 AS (SELECT search, edge_id, secs AS cost FROM v_edge JOIN v_depot ON edge_from = vertex){_CHAIN} SELECT search, edge_id, round(cost, 5) AS cost FROM d{_ROUNDS}")
def depot_costs(spark, sf_dir):
    """Least cost of edges around one depot a nation, with turn costs and bans, within as many turns as the twin unrolls."""
    return _depot_costs(spark, sf_dir, _ROUNDS)


@query()
def depot_costs_all(spark, sf_dir):
    """The same until no cost improves: least costs of all edges that a depot reaches."""
    return _depot_costs(spark, sf_dir, None)


def _depot_costs(spark, sf_dir, rounds):
    edges = graph.costs(road.edges(spark, sf_dir))
    depots = road.read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("search")).agg(F.min("c_custkey").alias("vertex"))
    seeds = edges.join(depots, F.col("edge_from") == F.col("vertex")).select("search", "edge_id", F.col("secs").alias("cost"))
    best = routing.relax(edges, graph.turn_costs(edges), seeds, rounds, _bans(edges))
    return best.select("search", "edge_id", F.round("cost", 5).alias("cost"))


_HOPS = 12


@query(f"WITH RECURSIVE {sql.EDGE}, arcs AS (SELECT DISTINCT edge_from, edge_to FROM v_edge), r(v, h) AS (SELECT 0::BIGINT, 0 UNION SELECT edge_to, h + 1 FROM r JOIN arcs ON v = edge_from WHERE h < {_HOPS}) SELECT v AS vertex_id, min(h) AS hops FROM r GROUP BY v")
def reachable_vertices(spark, sf_dir):
    edges = road.edges(spark, sf_dir)
    return graph.reachable(edges, spark.range(1).select(F.col("id").alias("vertex_id")), most_rounds=_HOPS)


@query()
def reachable_vertices_all(spark, sf_dir):
    """All vertices that vertex 0 reaches (hops) or that reach it (hops_back); null: not in that direction."""
    edges = road.edges(spark, sf_dir)
    seed = spark.range(1).select(F.col("id").alias("vertex_id"))
    there, back = (graph.reachable_by_areas(edges, seed, forward) for forward in (True, False))
    return there.join(back.withColumnRenamed("hops", "hops_back"), "vertex_id", "full")


@query()
def strong_components(spark, sf_dir):
    """Strongly connected components of the whole network."""
    return graph.strong_components(road.edges(spark, sf_dir))


@query()
def largest_component(spark, sf_dir):
    """Vertices of the network's largest strongly connected component."""
    return graph.largest_component(graph.strong_components(road.edges(spark, sf_dir)))


def _vertex_pairs(spark, sf_dir):
    """Every vertex with the one two rows and two columns on."""
    last = road.read(spark, sf_dir, "customer").agg((F.count(F.lit(1)) - 1).alias("last"))
    k = F.col("c_custkey")
    return road.read(spark, sf_dir, "customer").crossJoin(F.broadcast(last)).select(k.alias("query_id"), k.alias("origin"), F.when(k + 82 <= F.col("last"), k + 82).otherwise(F.greatest(k - 82, F.lit(0))).alias("target")).filter("origin <> target")


@query()
def best_routes(spark, sf_dir):
    """A route for every vertex, to the vertex two rows and two columns on, with its cost parts."""
    edges = graph.costs(road.edges(spark, sf_dir))
    turns = graph.turn_costs(edges)
    pairs = _vertex_pairs(spark, sf_dir)
    found = routing.routes(pairs, edges, turns, _bans(edges), _triples(edges))
    return routing.assemble(found, edges, turns).select("query_id", "n_edges", *[F.round(c, 4).alias(c) for c in ("seconds", "length_m", "drive_s", "distance_s", "toll_s", "turn_s")])


@query()
def route_instructions(spark, sf_dir):
    """What a driver is told along the route of every vertex."""
    edges = graph.costs(road.edges(spark, sf_dir))
    found = routing.routes(_vertex_pairs(spark, sf_dir), edges, graph.turn_costs(edges), _bans(edges), _triples(edges))
    told = instructions.build(instructions.route_steps(found, edges))
    return told.select("query_id", "n", "i", "kind", "name", "exit_number", F.round("distance_m", 4).alias("distance_m"), F.round("duration_s", 4).alias("duration_s"))


def _places_on_edges(spark, sf_dir, edges):
    """For every vertex a place on an edge that leaves it, and one on an edge that leaves a vertex two rows on."""
    leaving = edges.groupBy(F.col("edge_from").alias("v")).agg(F.min("edge_id").alias("start_edge"))
    last = road.read(spark, sf_dir, "customer").agg((F.count(F.lit(1)) - 1).alias("last"))
    k = F.col("v")
    asked = leaving.crossJoin(F.broadcast(last)).withColumn("target", F.when(k + 82 <= F.col("last"), k + 82).otherwise(F.greatest(k - 82, F.lit(0))))
    there = leaving.select(F.col("v").alias("target"), F.col("start_edge").alias("end_edge"))
    return asked.join(there, "target").select(k.alias("query_id"), "start_edge", (k % 10 / 10.0).alias("start_fraction"), "end_edge", (k % 7 / 7.0).alias("end_fraction"))


@query()
def point_routes(spark, sf_dir):
    """Routes between places on edges, which may be left and reached in both directions, with their cost parts."""
    edges = graph.costs(road.edges(spark, sf_dir))
    turns = graph.turn_costs(edges)
    found = routing.point_routes(_places_on_edges(spark, sf_dir, edges), edges, turns, _bans(edges), _triples(edges))
    return routing.assemble(found, edges, turns).select("query_id", "n_edges", *[F.round(c, 4).alias(c) for c in ("seconds", "length_m", "drive_s", "distance_s", "toll_s", "turn_s")])


@query()
def route_lines(spark, sf_dir):
    """The same places without toll roads: the line of each route, cut where it starts and ends."""
    edges = graph.costs(road.edges(spark, sf_dir))
    found = routing.point_routes(_places_on_edges(spark, sf_dir, edges), edges, graph.turn_costs(edges), _bans(edges), _triples(edges), avoid_tolls=True)
    shapes = edges.select("edge_id", F.expr("array(struct(lat1 AS lat, lon1 AS lon), struct(lat2 AS lat, lon2 AS lon))").alias("points"))
    rounded = F.transform("points", lambda p: F.struct(F.round(p["lat"], 7).alias("lat"), F.round(p["lon"], 7).alias("lon")))
    return routing.geometry(found, shapes).select("query_id", F.size("points").alias("n_points"), rounded.alias("points"))


_BENT = (
    "v_bent AS (SELECT edge_id, lat1, lon1, (lat1 + lat2) / 2 + 0.0002 AS lat3, (lon1 + lon2) / 2 AS lon3, lat2, lon2, (edge_id % 10) / 20.0::DOUBLE AS f, 1 - (edge_id % 7) / 20.0::DOUBLE AS t FROM v_edge), "
    f"v_legs AS (SELECT *, {sql.haversine('lat1', 'lon1', 'lat3', 'lon3')} AS a, {sql.haversine('lat3', 'lon3', 'lat2', 'lon2')} AS b FROM v_bent)"
)


def _bent_at(share: str, c: str) -> str:
    """Coordinate of the place at a share of a line of two legs."""
    m = f"{share} * (a + b)"
    return f"CASE WHEN {m} <= a THEN {c}1 + {m} / a * ({c}3 - {c}1) ELSE {c}3 + ({m} - a) / b * ({c}2 - {c}3) END"


@query(
    f"WITH {sql.EDGE}, {_BENT} SELECT edge_id, 2 + (a > f * (a + b) AND a < t * (a + b))::INT AS n_points, round({_bent_at('f', 'lat')}, 7) AS lat_first, round({_bent_at('f', 'lon')}, 7) AS lon_first, "
    f"round({_bent_at('t', 'lat')}, 7) AS lat_last, round({_bent_at('t', 'lon')}, 7) AS lon_last FROM v_legs"
)
def clipped_lines(spark, sf_dir):
    """Every edge, bent at its middle, cut at two shares of its length."""
    points = F.expr("array(struct(lat1 AS lat, lon1 AS lon), struct((lat1 + lat2) / 2 + 0.0002D AS lat, (lon1 + lon2) / 2 AS lon), struct(lat2 AS lat, lon2 AS lon))")
    line = geo.clip_polyline(points, F.col("edge_id") % 10 / 20.0, 1 - F.col("edge_id") % 7 / 20.0)
    ends = [F.round(F.element_at("line", i)[c], 7).alias(f"{c}_{n}") for i, n in ((1, "first"), (-1, "last")) for c in ("lat", "lon")]
    return road.edges(spark, sf_dir).select("edge_id", line.alias("line")).select("edge_id", F.size("line").alias("n_points"), *ends)


_GATED = (
    "v_g0 AS (SELECT edge_from // 20 AS query_id, row_number() OVER (PARTITION BY edge_from // 20 ORDER BY edge_id) AS i, edge_id, length_m * 8 AS metres FROM v_edge), "
    "v_g1 AS (SELECT *, (i // 30) % 4 AS toll_road, CASE WHEN edge_id % 5 = 0 THEN 1 WHEN edge_id % 7 = 0 THEN 2 ELSE 0 END AS gate FROM v_g0), "
    "v_g2 AS (SELECT *, CASE WHEN toll_road = 2 AND edge_id % 9 = 0 THEN i % 10 END AS span, CASE WHEN lag(toll_road) OVER w = toll_road THEN 0 ELSE 1 END AS fresh FROM v_g1 WINDOW w AS (PARTITION BY query_id ORDER BY i)), "
    "v_g3 AS (SELECT *, sum(fresh) OVER (PARTITION BY query_id ORDER BY i) AS run FROM v_g2), "
    "v_g4 AS (SELECT *, sum(metres) OVER (PARTITION BY query_id, run ORDER BY i) AS at_m FROM v_g3 WHERE toll_road <> 0), "
    "v_g5 AS (SELECT *, max(CASE WHEN gate = 1 THEN at_m END) OVER (PARTITION BY query_id, run ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM v_g4), "
    "v_g6 AS (SELECT query_id, run, toll_road, sum(metres) AS metres, count(*) FILTER (gate = 1 AND (past IS NULL OR at_m - past > 2000)) AS plazas, count(*) FILTER (gate = 2) AS ramp_booths, "
    "sum(metres) - coalesce(max(CASE WHEN gate = 1 THEN at_m END), 0) AS after_m, min(span) AS entry, max(span) + 1 AS exit FROM v_g5 GROUP BY ALL), "
    f"v_g7 AS (SELECT *, CASE WHEN toll_road = 3 THEN metres / 1000 * 1.95::DOUBLE WHEN toll_road = 2 THEN coalesce(5 * floor(1.95::DOUBLE * ({[list(r) for r in TOLLABLE_KM]}::DOUBLE[][])[entry + 1][exit + 1] / 5 + 0.5), 0) "
    "WHEN plazas > 0 THEN plazas * 140.0::DOUBLE + after_m / 1000 * 2.95::DOUBLE ELSE metres / 1000 * 2.95::DOUBLE END AS fare, "
    "CASE WHEN toll_road = 3 THEN 3 WHEN toll_road = 1 AND (ramp_booths > 0 OR plazas = 0) THEN 2 ELSE 1 END AS unsure FROM v_g6)"
)


def _gated_runs(spark, sf_dir):
    e = road.edges(spark, sf_dir).withColumn("query_id", F.floor(F.col("edge_from") / 20))
    e = e.withColumn("i", F.row_number().over(W.partitionBy("query_id").orderBy("edge_id")).cast("long")).withColumn("toll_road", (F.floor(F.col("i") / 30) % 4).cast("int"))
    gate = F.when(F.col("edge_id") % 5 == 0, tolls.MAINLINE).when(F.col("edge_id") % 7 == 0, tolls.RAMP).otherwise(tolls.NO_GATE)
    span = F.when((F.col("toll_road") == 2) & (F.col("edge_id") % 9 == 0), F.col("i") % 10)
    return tolls.price(tolls.runs(e.select("query_id", "i", "toll_road", gate.alias("gate"), span.alias("span"), (F.col("length_m") * 8).alias("metres"))))


@query(f"WITH {sql.EDGE}, {_GATED} SELECT query_id, toll_road, run::BIGINT AS run, round(metres, 3) AS metres, plazas, ramp_booths, round(after_m, 3) AS after_m, entry, exit, round(fare, 4) AS fare, ['verified', 'approximated', 'unpriced'][unsure] AS confidence FROM v_g7")
def toll_runs(spark, sf_dir):
    """Runs of toll road with gates, plazas and fares by each road's own rule."""
    r = _gated_runs(spark, sf_dir)
    return r.select("query_id", "toll_road", "run", *[F.round(c, 3).alias(c) for c in ("metres", "after_m")], "plazas", "ramp_booths", "entry", "exit", F.round("fare", 4).alias("fare"), "confidence")


@query(f"WITH {sql.EDGE}, {_GATED} SELECT query_id, round(sum(fare), 4) AS fare, ['verified', 'approximated', 'unpriced'][max(unsure)] AS confidence, count(*) AS runs FROM v_g7 GROUP BY query_id")
def route_tolls(spark, sf_dir):
    return tolls.route_tolls(_gated_runs(spark, sf_dir)).withColumn("fare", F.round("fare", 4))


@query(f"WITH {RAW}, p AS (SELECT way_id, pos // 2 AS piece, way_id % 4 = 0 AS mainline FROM v_way WHERE way_id % 3 = 0 AND node_id % 5 = 0) SELECT way_id, piece, max(CASE WHEN mainline THEN 1 ELSE 2 END) AS gate FROM p GROUP BY ALL")
def edge_gates(spark, sf_dir):
    """Gates on pieces of tolled ways."""
    pieces = _way_nodes(spark, sf_dir).select("way_id", F.floor(F.col("pos") / 2).alias("piece"), "node_id", (F.col("way_id") % 3 == 0).alias("tolled"), (F.col("way_id") % 4 == 0).alias("mainline"))
    gates = _way_nodes(spark, sf_dir).select("node_id").filter("node_id % 5 = 0")
    return tolls.edge_gates(pieces, gates)


_ROUND = (
    f"v_ring AS (SELECT way_id, pos, node_id FROM v_way UNION ALL SELECT way_id, 100, arg_min(node_id, pos * 1000000 + node_id) FROM v_way GROUP BY way_id HAVING count(*) >= 3), "
    f"v_at AS (SELECT *, 28.1 + ({sql.lat('node_id')} / 1e7 - 28.1) * 0.03 AS lat, 77.4 + ({sql.lon('node_id')} / 1e7 - 77.4) * 0.03 AS lon, count(*) OVER (PARTITION BY node_id) AS uses FROM v_ring), "
    "v_kept AS (SELECT * FROM v_at WHERE way_id % 3 <> 0 AND way_id % 10 NOT IN (1, 2)), "
    "v_closed AS (SELECT way_id, count(DISTINCT CASE WHEN uses >= 2 THEN node_id END) AS connections FROM v_kept GROUP BY way_id HAVING count(*) >= 4 AND arg_min(node_id, pos * 1000000 + node_id) = arg_max(node_id, pos * 1000000 + node_id))"
)


@query(
    f"WITH {RAW}, {_ROUND}, p AS (SELECT a.way_id, max({sql.haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')}) AS span_m FROM v_kept a JOIN v_kept b ON a.way_id = b.way_id AND a.node_id <= b.node_id GROUP BY a.way_id) "
    "SELECT way_id, round(span_m, 4) AS span_m, connections FROM p JOIN v_closed USING (way_id) WHERE span_m <= 180 AND connections >= 3"
)
def untagged_circles(spark, sf_dir):
    """Ways that end where they begin, on a lattice drawn close together, as roundabouts nobody tagged."""
    ways = _way_nodes(spark, sf_dir)
    back = ways.groupBy("way_id").agg(F.min(F.struct("pos", "node_id"))["node_id"].alias("node_id"), F.count(F.lit(1)).alias("n")).filter("n >= 3").select("way_id", F.lit(100).alias("pos"), "node_id")
    ring = ways.select("way_id", "pos", "node_id").unionByName(back)
    near = ring.withColumn("lat", 28.1 + (road.lattice_lat(F.col("node_id")) / 1e7 - 28.1) * 0.03).withColumn("lon", 77.4 + (road.lattice_lon(F.col("node_id")) / 1e7 - 77.4) * 0.03)
    k = F.col("way_id")
    kinds = ways.select("way_id").distinct().select("way_id", (k % 3 != 0).alias("oneway"), (k % 10 == 1).alias("junction"), (k % 10 == 2).alias("service"))
    return graph.untagged_circles(near, kinds).withColumn("span_m", F.round("span_m", 4))


_CALLED = "v_called AS (SELECT edge_from AS query_id, row_number() OVER (PARTITION BY edge_from ORDER BY edge_id) AS i, CASE edge_id % 3 WHEN 1 THEN name || ' Flyover' WHEN 2 THEN CASE WHEN edge_id % 4 < 2 THEN name END END AS name, length_m * 2 AS length_m FROM v_edge)"


@query(
    f"WITH {sql.EDGE}, {_CALLED}, s AS (SELECT *, coalesce(sum(length_m) OVER (PARTITION BY query_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_m FROM v_called) "
    "SELECT query_id, i, coalesce(first_value(CASE WHEN name NOT LIKE '% Flyover' THEN name END IGNORE NULLS) OVER w, first_value(name IGNORE NULLS) OVER w) AS ahead FROM s WINDOW w AS (PARTITION BY query_id ORDER BY start_m RANGE BETWEEN CURRENT ROW AND 800 FOLLOWING)"
)
def names_ahead(spark, sf_dir):
    """The name that a driver is told at each step of a route."""
    k = F.col("edge_id")
    name = F.when(k % 3 == 1, F.concat("name", F.lit(" Flyover"))).when((k % 3 == 2) & (k % 4 < 2), F.col("name"))
    steps = road.edges(spark, sf_dir).select(F.col("edge_from").alias("query_id"), F.row_number().over(W.partitionBy("edge_from").orderBy("edge_id")).cast("long").alias("i"), name.alias("name"), (F.col("length_m") * 2).alias("length_m"))
    return instructions.name_ahead(steps).select("query_id", "i", "ahead")



_STEPS = "v_step AS (SELECT edge_from AS query_id, row_number() OVER (PARTITION BY edge_from ORDER BY edge_id) AS i, toll_road, length_m FROM v_edge)"


@query(
    f"WITH {sql.EDGE}, {_STEPS}, m AS (SELECT *, CASE WHEN lag(toll_road) OVER w = toll_road THEN 0 ELSE 1 END AS fresh FROM v_step WINDOW w AS (PARTITION BY query_id ORDER BY i)), n AS (SELECT *, sum(fresh) OVER (PARTITION BY query_id ORDER BY i) AS run FROM m), "
    "r AS (SELECT query_id, run, toll_road, sum(length_m) AS metres, min(i) AS first, max(i) AS last FROM n WHERE toll_road <> 0 GROUP BY ALL) SELECT query_id, toll_road, first, last, round(metres, 4) AS metres, round(CASE WHEN toll_road = 2 THEN 5 * floor(metres / 1000 * 1.95::DOUBLE / 5 + 0.5) WHEN toll_road = 1 THEN metres / 1000 * 2.95::DOUBLE ELSE metres / 1000 * 1.95::DOUBLE END, 4) AS fare FROM r"
)
def toll_fares(spark, sf_dir):
    w = W.partitionBy("query_id").orderBy("edge_id")
    steps = road.edges(spark, sf_dir).withColumn("query_id", F.col("edge_from")).withColumn("i", F.row_number().over(w).cast("long"))
    priced = routing.price_runs(routing.toll_runs(steps), {1: 2.95, 2: 1.95, 3: 1.95})
    return priced.select("query_id", "toll_road", "first", "last", F.round("metres", 4).alias("metres"), F.round("fare", 4).alias("fare"))


_PB = "fmod(degrees(atan2((lon2 - lon1) * cos(radians((lat1 + lat2) / 2)), lat2 - lat1)), 360)"


@query(
    f"WITH {sql.EDGE}, b AS (SELECT edge_id, edge_from, edge_to, class_rank, {_PB} AS bearing FROM v_edge), p AS (SELECT a.class_rank, fmod(b.bearing - a.bearing, 360) AS d0 FROM b a JOIN b ON a.edge_to = b.edge_from), q AS (SELECT class_rank, CASE WHEN d0 > 180 THEN d0 - 360 WHEN d0 <= -180 THEN d0 + 360 ELSE d0 END AS d FROM p), "
    "t AS (SELECT class_rank, CASE WHEN abs(d) < 20 THEN 'straight' WHEN abs(d) >= 160 THEN 'u-turn' ELSE CASE WHEN abs(d) < 45 THEN 'slight-' WHEN abs(d) >= 120 THEN 'sharp-' ELSE 'turn-' END || CASE WHEN d > 0 THEN 'right' ELSE 'left' END END AS maneuver FROM q) SELECT class_rank, maneuver, count(*) AS n FROM t GROUP BY ALL"
)
def maneuver_census(spark, sf_dir):
    e = road.edges(spark, sf_dir).withColumn("bearing", geo.planar_bearing(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")))
    pairs = graph.adjacency(e, "edge_from", "edge_to", "class_rank", "bearing")
    kind = instructions.maneuver(geo.bearing_delta(F.col("bearing_in"), F.col("bearing_out")))
    return pairs.groupBy(F.col("class_rank_in").alias("class_rank"), kind.alias("maneuver")).agg(F.count(F.lit(1)).alias("n"))


# --- search -----------------------------------------------------------------------------------------------------

_NORM = "trim(regexp_replace(regexp_replace(lower(name), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"
_ASKED = f"v_n AS (SELECT *, {_NORM} AS norm, string_split({_NORM}, ' ') AS toks FROM v_place), v_asked AS (SELECT row_number() OVER (ORDER BY q) AS query_id, q FROM (SELECT norm AS q FROM v_n UNION SELECT left(norm, 4) FROM v_n))"


def _index_and_queries(spark, sf_dir):
    index = search.build_index(road.places(spark, sf_dir), strings.normalise_ascii(F.col("name")))
    asked = index.select(F.col("norm").alias("q")).distinct().union(index.select(F.trim(F.substring("norm", 1, 4))).distinct()).distinct()
    asked = asked.withColumn("query_id", F.xxhash64("q")).withColumns({"qlat": F.lit(None).cast("double"), "qlon": F.lit(None).cast("double")})
    return index, asked


@query(
    f"WITH {sql.PLACE}, {_ASKED.replace('left(norm, 4)', 'trim(left(norm, 4))')}, m AS (SELECT q, place_id, name, importance, CASE WHEN norm = q THEN 40.0 WHEN starts_with(norm, q) THEN 25.0 WHEN len(list_filter(toks, lambda t: starts_with(t, q))) > 0 THEN 15.0 "
    "WHEN len(list_filter(string_split(q, ' '), lambda x: len(list_filter(toks, lambda t: starts_with(t, x))) = 0)) = 0 THEN 5.0 END AS bonus FROM v_asked, v_n), r AS (SELECT q, place_id, name, (importance + bonus)::DOUBLE AS score, row_number() OVER (PARTITION BY q ORDER BY importance + bonus DESC, name, place_id) AS rank FROM m WHERE bonus IS NOT NULL) SELECT q, rank, place_id, name, score FROM r WHERE rank <= 10"
)
def place_search(spark, sf_dir):
    index, asked = _index_and_queries(spark, sf_dir)
    hits = search.search(index, asked, fuzzy=False).join(asked.select("query_id", "q"), "query_id")
    return hits.select("q", F.col("rank").cast("long").alias("rank"), "place_id", "name", F.col("score").cast("double").alias("score"))


@query()
def place_search_fuzzy(spark, sf_dir):
    """Every name with its first two letters swapped, near the place that is first of that name."""
    index, _ = _index_and_queries(spark, sf_dir)
    named = index.groupBy("norm").agg(F.min(F.struct("place_id", "lat", "lon")).alias("p"))
    q = F.concat(F.substring("norm", 2, 1), F.substring("norm", 1, 1), F.expr("substring(norm, 3)"))
    asked = named.select(F.xxhash64("norm").alias("query_id"), q.alias("q"), F.col("p.lat").alias("qlat"), F.col("p.lon").alias("qlon"))
    hits = search.search(index, asked).join(asked.select("query_id", "q"), "query_id")
    return hits.select("q", "rank", "place_id", "name", F.round("score", 6).alias("score"))


@query("SELECT doc_id, array_to_string(regexp_extract_all(text, '[0-9]+'), ',') AS digits, regexp_matches(text, '[ऀ-ॿ]') AS devanagari FROM documents")
def text_digits(spark, sf_dir):
    d = road.read(spark, sf_dir, "documents")
    return d.select("doc_id", strings.digits_of(F.col("text")).alias("digits"), strings.has_devanagari(F.col("text")).alias("devanagari"))


@query(f"WITH {sql.PLACE}, {_ASKED}, t AS (SELECT unnest(toks) AS token, place_id FROM v_n) SELECT token, count(*) AS places, least(2, greatest(1, floor(length(token) * 0.25)))::INT AS budget FROM t GROUP BY token")
def place_tokens(spark, sf_dir):
    index, _ = _index_and_queries(spark, sf_dir)
    t = index.select(F.explode("toks").alias("token"))
    return t.groupBy("token").agg(F.count(F.lit(1)).alias("places")).withColumn("budget", strings.fuzzy_budget(F.length("token"), 2))


@query(f"WITH {sql.PLACE}, c AS (SELECT unnest(string_split(name, '')) AS ch FROM v_place UNION ALL SELECT unnest(string_split(name, '')) FROM (SELECT n_name AS name FROM nation)) SELECT ch, count(*) AS uses FROM c WHERE ch <> '' GROUP BY ch")
def glyph_coverage(spark, sf_dir):
    names = road.places(spark, sf_dir).select("name").union(road.read(spark, sf_dir, "nation").select("n_name"))
    return names.select(F.explode(F.split("name", "")).alias("ch")).filter("ch <> ''").groupBy("ch").agg(F.count(F.lit(1)).alias("uses"))


# --- tracking ---------------------------------------------------------------------------------------------------

_RN = f"{sql.FIX}, f AS (SELECT *, (epoch_us(ts) // 1000) AS t_ms, row_number() OVER (PARTITION BY device_id ORDER BY (epoch_us(ts) // 1000), fix_id) AS rn FROM v_fix)"
_LATE = "f.t_ms <= r.last_t"
_FAST = f"greatest(0, {sql.haversine('r.la', 'r.lo', 'f.lat', 'f.lon')} - (r.acc + f.accuracy_m)) / ((f.t_ms - r.last_t) / 1000) * 3.6::DOUBLE > 150"
_VERDICT = f"CASE WHEN r.last_t IS NOT NULL AND {_LATE} THEN 'out-of-order' WHEN NOT f.accuracy_m <= 40 THEN 'accuracy' WHEN r.last_t IS NOT NULL AND {_FAST} THEN 'implied-speed' ELSE 'ok' END"


@query(
    f"WITH RECURSIVE {_RN}, r AS (SELECT device_id, fix_id, rn, v AS verdict, CASE WHEN v = 'ok' THEN t_ms END AS last_t, CASE WHEN v = 'ok' THEN lat END AS la, CASE WHEN v = 'ok' THEN lon END AS lo, CASE WHEN v = 'ok' THEN accuracy_m END AS acc FROM (SELECT *, CASE WHEN accuracy_m <= 40 THEN 'ok' ELSE 'accuracy' END AS v FROM f WHERE rn = 1) "
    f"UNION ALL SELECT device_id, fix_id, rn, v, CASE WHEN v = 'ok' THEN t_ms ELSE last_t END, CASE WHEN v = 'ok' THEN lat ELSE la END, CASE WHEN v = 'ok' THEN lon ELSE lo END, CASE WHEN v = 'ok' THEN accuracy_m ELSE acc END FROM (SELECT f.*, r.last_t, r.la, r.lo, r.acc, {_VERDICT} AS v FROM r JOIN f ON f.device_id = r.device_id AND f.rn = r.rn + 1)) SELECT device_id, fix_id, verdict FROM r"
)
def judge_fixes(spark, sf_dir):
    return tracking.judge_fixes(road.fixes(spark, sf_dir)).select("device_id", "fix_id", "verdict")


@query(f"WITH {_RN}, g AS (SELECT a.device_id, a.fix_id, max(b.rn) AS rn FROM f a JOIN f b ON a.device_id = b.device_id AND b.rn BETWEEN a.rn - 15 AND a.rn - 1 AND {sql.haversine('b.lat', 'b.lon', 'a.lat', 'a.lon')} >= 25 GROUP BY ALL) SELECT f.device_id, f.fix_id, o.fix_id AS from_fix FROM f LEFT JOIN g ON f.fix_id = g.fix_id LEFT JOIN f o ON o.device_id = g.device_id AND o.rn = g.rn")
def heading_origins(spark, sf_dir):
    return tracking.headings(road.fixes(spark, sf_dir)).select("device_id", "fix_id", "from_fix")


@query(f"WITH RECURSIVE {_RN}, r AS (SELECT device_id, fix_id, rn, speed_mps AS speed FROM f WHERE rn = 1 UNION ALL SELECT f.device_id, f.fix_id, f.rn, r.speed * 0.7::DOUBLE + f.speed_mps * (1 - 0.7::DOUBLE) FROM r JOIN f ON f.device_id = r.device_id AND f.rn = r.rn + 1) SELECT device_id, fix_id, floor(speed * 10000) / 10000 AS speed FROM r")
def smoothed_speed(spark, sf_dir):
    return tracking.smoothed_speed(road.fixes(spark, sf_dir)).withColumn("speed", F.floor(F.col("speed") * 10000) / 10000)


@query(f"WITH {_RN}, s AS (SELECT *, coalesce({sql.haversine('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')}, 0) AS step_m FROM f WINDOW w AS (PARTITION BY device_id ORDER BY rn)) SELECT device_id, fix_id, round(step_m, 4) AS step_m, round(sum(step_m) OVER (PARTITION BY device_id ORDER BY rn ROWS UNBOUNDED PRECEDING), 3) AS travelled_m FROM s")
def travelled_metres(spark, sf_dir):
    return tracking.cumulative(road.fixes(spark, sf_dir)).select("device_id", "fix_id", F.round("step_m", 4).alias("step_m"), F.round("travelled_m", 3).alias("travelled_m"))


@query(
    f"WITH {sql.FIX}, s AS (SELECT device_id, (epoch_us(ts) // 1000) AS t_ms, fix_id * 7 % 61 AS offset_m FROM v_fix), o AS (SELECT *, offset_m > 30 AS away, sum(CASE WHEN offset_m > 30 THEN 0 ELSE 1 END) OVER (PARTITION BY device_id ORDER BY t_ms) AS stay FROM s), q AS (SELECT *, min(t_ms) OVER (PARTITION BY device_id, stay) AS since FROM o WHERE away) SELECT device_id, min(t_ms) AS alarm_ms FROM q WHERE t_ms - since >= 3000 GROUP BY device_id, stay"
)
def off_route_alarms(spark, sf_dir):
    f = road.fixes(spark, sf_dir).select("device_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("t_ms"), (F.col("fix_id") * 7 % 61).alias("offset_m"))
    return tracking.off_route(f)


def _directed_candidates(fixes, edges, k=8):
    """The k nearest directed edges of each fix: both directions of a segment, each with its own bearing of travel."""
    shapes = road.shapes(edges).drop("edge_id")
    near = spatial.pairs_within(fixes.select("fix_id", "lat", "lon"), shapes, MATCH_M, "fix_id", "shape_id")
    forward = geo.bearing(F.col("alat"), F.col("alon"), F.col("blat"), F.col("blon"))
    foot = [(F.col(f"a{c}") + F.col("t") * (F.col(f"b{c}") - F.col(f"a{c}"))).alias(f"f{c}") for c in ("lat", "lon")]
    near = near.select("fix_id", "shape_id", "distance_m", *foot, forward.alias("forward"))
    both = near.join(edges.select("shape_id", "edge_id", "reversed"), "shape_id")
    ranked = both.withColumn("rank", F.row_number().over(W.partitionBy("fix_id").orderBy("distance_m", "edge_id"))).filter(F.col("rank") <= k)
    return ranked.withColumn("edge_bearing", (F.col("forward") + F.col("reversed") * 180) % 360)


@query()
def match_traces(spark, sf_dir):
    """Each window of twelve fixes of a device matched to the network."""
    fixes, edges = road.fixes(spark, sf_dir), road.edges(spark, sf_dir)
    near = _directed_candidates(fixes, edges).select("fix_id", "edge_id", "distance_m", "flat", "flon", "edge_bearing")
    return tracking.match_traces(fixes, near).withColumns({"offset_m": F.round("offset_m", 4), "probability": F.round("probability", 6)})


_V_NEAR = sql.near(MATCH_M)
_CAND = (
    f"v_cand AS (SELECT n.fix_id, e.edge_id, n.distance_m, fmod({sql.bearing('s.alat', 's.alon', 's.blat', 's.blon')} + e.reversed * 180, 360) AS edge_bearing "
    "FROM v_near n JOIN v_seg s USING (shape_id) JOIN v_edge e USING (shape_id) QUALIFY row_number() OVER (PARTITION BY n.fix_id ORDER BY n.distance_m, e.edge_id) <= 8)"
)


@query(
    f"WITH {sql.EDGE}, {sql.FIX}, {_V_NEAR}, {_CAND}, g AS (SELECT fix_id, edge_id, distance_m, fmod(abs(heading_deg - edge_bearing), 360) AS gap, speed_mps FROM v_cand JOIN v_fix USING (fix_id)) "
    "SELECT fix_id, count(*) AS candidates, count(*) FILTER (speed_mps < 2 OR least(gap, 360 - gap) <= 60) AS agreeing FROM g GROUP BY fix_id"
)
def heading_gate(spark, sf_dir):
    """Candidate edges of each fix, and those whose bearing of travel agrees with the fix's heading."""
    fixes = road.fixes(spark, sf_dir)
    near = _directed_candidates(fixes, road.edges(spark, sf_dir)).join(fixes.select("fix_id", "heading_deg", "speed_mps"), "fix_id")
    agrees = (F.col("speed_mps") < 2) | (geo.bearing_gap(F.col("heading_deg"), F.col("edge_bearing")) <= 60)
    return near.groupBy("fix_id").agg(F.count(F.lit(1)).alias("candidates"), F.count_if(agrees).alias("agreeing"))


_ROUTE = f"""
v_vx AS (SELECT c_custkey AS k, {sql.lat('c_custkey')} / 1e7 AS lat, {sql.lon('c_custkey')} / 1e7 AS lon FROM customer),
v_rs0 AS (SELECT a.k // 40 AS route_id, a.k % 40 AS seq, a.lat AS alat, a.lon AS alon, b.lat AS blat, b.lon AS blon FROM v_vx a JOIN v_vx b ON b.k = a.k + 1 WHERE a.k % 40 < 39),
v_rs1 AS (SELECT *, {sql.haversine('alat', 'alon', 'blat', 'blon')} AS length_m, {sql.bearing('alat', 'alon', 'blat', 'blon')} AS bearing FROM v_rs0),
v_rs AS (SELECT *, sum(length_m) OVER (PARTITION BY route_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS to_m FROM v_rs1),
v_rf AS (SELECT fix_id, device_id % 37 AS route_id, lat, lon, CASE WHEN speed_mps >= 2 THEN heading_deg END AS heading, CASE WHEN fix_id % 3 > 0 THEN (fix_id * 131 % 5000)::DOUBLE END AS last_m FROM v_fix),
v_rp AS (SELECT f.*, s.*, greatest(0.0, least(1.0, ((lon - alon) * cos(radians(lat)) * (blon - alon) * cos(radians(lat)) + (lat - alat) * (blat - alat)) / (pow((blon - alon) * cos(radians(lat)), 2) + pow(blat - alat, 2)))) AS t,
  fmod(abs(bearing - heading), 360) AS gap FROM v_rf f JOIN v_rs s USING (route_id)),
v_rq AS (SELECT *, {sql.haversine('lat', 'lon', 'alat + t * (blat - alat)', 'alon + t * (blon - alon)')} AS off FROM v_rp
  WHERE (heading IS NULL OR least(gap, 360 - gap) <= 60) AND (last_m IS NULL OR (to_m >= last_m - 250 AND to_m - length_m <= last_m + 250))),
v_rm AS (SELECT fix_id, route_id, off AS offset_m, to_m - length_m + t * length_m AS route_m FROM v_rq QUALIFY row_number() OVER (PARTITION BY fix_id ORDER BY off, seq) = 1)
"""


def _route_segments(spark, sf_dir):
    """Each row of the lattice as a route, from west to east."""
    v = road.vertices(spark, sf_dir).select(F.col("vertex_id").alias("k"), "lat", "lon")
    b = v.select((F.col("k") - 1).alias("k"), F.col("lat").alias("blat"), F.col("lon").alias("blon"))
    joined = v.withColumnsRenamed({"lat": "alat", "lon": "alon"}).join(b, "k").filter("k % 40 < 39")
    return joined.select(F.floor(F.col("k") / 40).alias("route_id"), (F.col("k") % 40).alias("seq"), "alat", "alon", "blat", "blon")


def _on_route(spark, sf_dir):
    f = road.fixes(spark, sf_dir)
    heading = F.when(F.col("speed_mps") >= 2, F.col("heading_deg"))
    last = F.when(F.col("fix_id") % 3 > 0, (F.col("fix_id") * 131 % 5000).cast("double"))
    asked = f.select("fix_id", (F.col("device_id") % 37).alias("route_id"), "lat", "lon", heading.alias("heading"), last.alias("last_m"))
    return tracking.match_to_route(asked, _route_segments(spark, sf_dir))


@query(f"WITH {sql.FIX}, {_ROUTE} SELECT f.fix_id, f.route_id, round(m.offset_m, 4) AS offset_m, round(m.route_m, 3) AS route_m FROM v_rf f LEFT JOIN v_rm m ON f.fix_id = m.fix_id")
def route_matches(spark, sf_dir):
    """Fixes on their active route, behind the heading gate and within the window around where they were last seen."""
    return _on_route(spark, sf_dir).select("fix_id", "route_id", F.round("offset_m", 4).alias("offset_m"), F.round("route_m", 3).alias("route_m"))


@query(
    f"WITH {sql.FIX}, {_ROUTE}, k AS (SELECT route_id, seq AS turn, to_m AS at_m FROM v_rs WHERE seq % 5 = 4), i AS (SELECT *, at_m - coalesce(lag(at_m) OVER (PARTITION BY route_id ORDER BY turn), 0) AS leg_m FROM k), z AS (SELECT route_id, max(to_m) AS total_m, max(seq) AS top FROM v_rs GROUP BY route_id), "
    "a AS (SELECT m.fix_id, m.route_m, total_m, i.turn, i.at_m, i.leg_m, leg_m / 10 AS leg_s FROM v_rm m JOIN z USING (route_id) JOIN i USING (route_id)), c AS (SELECT fix_id, min(turn) FILTER (at_m >= route_m - 1e-6) AS ahead, max(turn) AS final FROM a GROUP BY fix_id), "
    "n AS (SELECT a.*, c.ahead, coalesce(ahead, final) AS now FROM a JOIN c USING (fix_id)), o AS (SELECT fix_id, any_value(now) AS instruction, any_value(total_m) - any_value(route_m) AS left_m, any_value(ahead IS NULL) AS past, any_value(total_m) AS total_m, any_value(route_m) AS route_m, sum(leg_s) FILTER (turn > now) AS later, max(at_m) FILTER (turn = now) AS at_m, max(leg_m) FILTER (turn = now) AS leg_m, max(leg_s) FILTER (turn = now) AS leg_s FROM n GROUP BY fix_id), "
    "p AS (SELECT *, CASE WHEN past THEN total_m ELSE at_m END AS target FROM o) SELECT fix_id, instruction, round(greatest(0, target - route_m), 3) AS to_maneuver_m, round(greatest(0, left_m), 3) AS remaining_m, round(coalesce(later, 0) + greatest(0, least(1, (target - route_m) / leg_m)) * leg_s, 3) AS remaining_s FROM p"
)
def route_progress(spark, sf_dir):
    """The current instruction, and metres and seconds left, of every matched fix."""
    w = W.partitionBy("route_id").orderBy("seq")
    s = _route_segments(spark, sf_dir).withColumn("length_m", geo.haversine(F.col("alat"), F.col("alon"), F.col("blat"), F.col("blon")))
    s = s.withColumn("to_m", F.sum("length_m").over(w.rowsBetween(W.unboundedPreceding, 0)))
    turns = s.filter("seq % 5 = 4").withColumn("leg_m", F.col("to_m") - F.coalesce(F.lag("to_m").over(w), F.lit(0.0)))
    turns = turns.select("route_id", F.col("seq").alias("turn"), F.col("to_m").alias("at_m"), "leg_m", (F.col("leg_m") / 10).alias("leg_s"))
    total = s.groupBy("route_id").agg(F.max("to_m").alias("total_m"))
    p = tracking.progress(_on_route(spark, sf_dir).filter("route_m is not null").join(total, "route_id"), turns)
    return p.filter("instruction is not null").select("fix_id", "instruction", *[F.round(c, 3).alias(c) for c in ("to_maneuver_m", "remaining_m", "remaining_s")])


@query(
    "WITH i AS (SELECT l_suppkey AS supplier, epoch_us(l_shipdate) // 86400000000 AS day, epoch_us(l_shipdate) // 86400000000 + floor(l_quantity / 4)::BIGINT AS until FROM lineitem), m AS (SELECT *, max(until) OVER (PARTITION BY supplier ORDER BY day, until ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i), "
    "n AS (SELECT *, sum(CASE WHEN reach IS NULL OR day > reach THEN 1 ELSE 0 END) OVER (PARTITION BY supplier ORDER BY day, until ROWS UNBOUNDED PRECEDING) AS run FROM m) SELECT supplier, min(day) AS day, max(until) AS until FROM n GROUP BY supplier, run"
)
def merged_intervals(spark, sf_dir):
    day = F.floor(F.unix_millis(F.col("l_shipdate").cast("timestamp")) / 86400000).cast("long")
    rows = road.read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("supplier"), day.alias("day"), (day + F.floor(F.col("l_quantity") / 4).cast("long")).alias("until"))
    return tracking.merged_intervals(rows, "supplier", "day", "until")


# --- analytics --------------------------------------------------------------------------------------------------


@query(f"WITH {sql.EDGE}, l AS (SELECT class_rank, list_sort(list(length_m)) AS v FROM v_edge GROUP BY class_rank) SELECT class_rank, " + ", ".join(f"round(v[least(len(v) - 1, floor({q} * len(v))::BIGINT) + 1], 4) AS q{int(q * 100)}" for q in (0.1, 0.5, 0.9)) + " FROM l")
def length_quantiles(spark, sf_dir):
    q = analytics.quantile_floor(road.edges(spark, sf_dir), ["class_rank"], "length_m", (0.1, 0.5, 0.9))
    return q.select("class_rank", *[F.round(c, 4).alias(c) for c in ("q10", "q50", "q90")])


@query(f"WITH {sql.EDGE} SELECT count(*) AS n, round(quantile_cont(secs / drive_s, 0.5), 6) AS median_ratio, round(sum(secs) / sum(drive_s), 6) AS total_ratio FROM v_edge")
def cost_ratios(spark, sf_dir):
    r = analytics.paired_ratios(graph.costs(road.edges(spark, sf_dir)), "edge_id", "drive_s", "secs")
    return r.select("n", F.round("median_ratio", 6).alias("median_ratio"), F.round("total_ratio", 6).alias("total_ratio"))


@query(f"WITH {sql.EDGE}, r AS (SELECT class_rank, secs, row_number() OVER (PARTITION BY class_rank ORDER BY length_m, edge_id) - 1 AS i, count(*) OVER (PARTITION BY class_rank) AS n FROM v_edge) SELECT class_rank, least(3, i // greatest(1, n // 4))::INT AS quarter, count(*) AS n, round(avg(secs), 5) AS mean FROM r GROUP BY ALL")
def cost_quarters(spark, sf_dir):
    return analytics.quarters(graph.costs(road.edges(spark, sf_dir)), ["class_rank"], "length_m", "secs", "edge_id").withColumn("mean", F.round("mean", 5))


@query(f"WITH {sql.EDGE}, s AS (SELECT toll_road, class_rank, sum(length_m) AS amount FROM v_edge GROUP BY ALL) SELECT toll_road, class_rank, round(amount, 3) AS amount, round(amount / sum(amount) OVER (PARTITION BY toll_road), 7) AS share FROM s")
def class_shares(spark, sf_dir):
    s = analytics.shares(road.edges(spark, sf_dir), ["toll_road"], "class_rank", "length_m")
    return s.select("toll_road", "class_rank", F.round("amount", 3).alias("amount"), F.round("share", 7).alias("share"))


_KM = list(PLAZA_KM)


@query(f"WITH e AS (SELECT (o_orderkey * 13 % 140000) / 1000 AS km FROM orders), s AS (SELECT km, list_min(list_filter(range({len(_KM) - 1}), lambda i: km >= ({_KM}::DOUBLE[])[i + 1] AND km <= ({_KM}::DOUBLE[])[i + 2]))::INT AS span FROM e) SELECT span, count(*) AS n, round(min(km), 3) AS lo, round(max(km), 3) AS hi FROM s GROUP BY span")
def chainage_spans(spark, sf_dir):
    e = road.read(spark, sf_dir, "orders").select((F.col("o_orderkey") * 13 % 140000 / 1000).alias("km"))
    return analytics.spans(e, _KM, "km").groupBy("span").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("km"), 3).alias("lo"), F.round(F.max("km"), 3).alias("hi"))


@query("SELECT user_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def newest_values(spark, sf_dir):
    return analytics.newest(road.read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value")


@query("WITH o AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM o) SELECT user_id, count(*) AS events, max(ts) AS last FROM s GROUP BY user_id, run")
def quiet_sessions(spark, sf_dir):
    return analytics.quiet_sessions(road.read(spark, sf_dir, "events"), "user_id", "ts", "2 hours").select("user_id", "events", "last")


@query(f"WITH {RAW}, a AS (SELECT DISTINCT node_id FROM v_raw WHERE extract = 0), b AS (SELECT DISTINCT node_id FROM v_raw WHERE extract = 1) SELECT node_id, 'left' AS side FROM a WHERE node_id NOT IN (SELECT node_id FROM b) UNION ALL SELECT node_id, 'right' FROM b WHERE node_id NOT IN (SELECT node_id FROM a)")
def extract_difference(spark, sf_dir):
    raw = road.raw_ways(spark, sf_dir)
    a, b = (raw.filter(F.col("extract") == x).select("node_id").distinct() for x in (0, 1))
    return analytics.set_difference(a, b)


@query(f"WITH {sql.EDGE} SELECT edge_from AS vertex_id FROM v_edge WHERE toll_road <> 0 INTERSECT SELECT edge_from FROM v_edge WHERE toll_road = 0")
def toll_boundary(spark, sf_dir):
    e = road.edges(spark, sf_dir)
    return e.filter("toll_road <> 0").select(F.col("edge_from").alias("vertex_id")).intersect(e.filter("toll_road = 0").select("edge_from"))


@query(f"WITH v AS (SELECT c_custkey AS vertex_id, c_custkey % 40 AS line, {sql.lat('c_custkey')} / 1e7 AS lat, {sql.lon('c_custkey')} / 1e7 AS lon FROM customer), s AS (SELECT *, coalesce({sql.haversine('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')}, 0) AS step FROM v WINDOW w AS (PARTITION BY line ORDER BY lat, vertex_id)) SELECT vertex_id, line, round(step, 4) AS step_m, round(sum(step) OVER (PARTITION BY line ORDER BY lat, vertex_id ROWS UNBOUNDED PRECEDING), 3) AS along_m FROM s")
def chord_spacing(spark, sf_dir):
    w = W.partitionBy("line").orderBy("lat", "vertex_id")
    v = road.vertices(spark, sf_dir).withColumn("line", F.col("vertex_id") % 40)
    v = v.withColumn("step", F.coalesce(geo.haversine(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")), F.lit(0.0)))
    return v.select("vertex_id", "line", F.round("step", 4).alias("step_m"), F.round(F.sum("step").over(w.rowsBetween(W.unboundedPreceding, 0)), 3).alias("along_m"))


@query(f"WITH {sql.EDGE} SELECT class_rank, edge_id, round(secs, 5) AS secs FROM v_edge QUALIFY row_number() OVER (PARTITION BY class_rank ORDER BY secs DESC, edge_id) <= 5")
def costliest_edges(spark, sf_dir):
    w = W.partitionBy("class_rank").orderBy(F.desc("secs"), "edge_id")
    e = graph.costs(road.edges(spark, sf_dir)).withColumn("turn", F.row_number().over(w)).filter("turn <= 5")
    return e.select("class_rank", "edge_id", F.round("secs", 5).alias("secs"))


@query(f"WITH {RAW}, l AS (SELECT l_orderkey AS way_id, l_linenumber AS pos, l_partkey, l_suppkey, l_linestatus AS kind, l_returnflag AS flag FROM lineitem), o AS (SELECT *, lag(kind) OVER (PARTITION BY way_id ORDER BY pos, l_partkey, l_suppkey, flag, kind) AS before FROM l) SELECT way_id, count(*) AS changes FROM o WHERE before <> kind GROUP BY way_id")
def file_order(spark, sf_dir):
    li = road.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("way_id"), F.col("l_linenumber").alias("pos"), "l_partkey", "l_suppkey", F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("kind"))
    return ingest.out_of_order(li, "way_id", ["pos", "l_partkey", "l_suppkey", "flag", "kind"], "kind").groupBy("way_id").agg(F.count(F.lit(1)).alias("changes"))


_SWEEP = {"base": 1.0, "slow": 0.9, "fast": 1.25}


@query(
    f"WITH {sql.EDGE}, s AS (SELECT edge_id, scenario, length_m / (greatest(1, least(255, floor(speed_kmh * factor + 0.5))) / 3.6::DOUBLE) AS secs FROM v_edge, (VALUES " + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in _SWEEP.items()) + ") AS c(scenario, factor)), "
    "j AS (SELECT s.scenario, s.secs - b.secs AS d FROM s JOIN s b ON s.edge_id = b.edge_id AND b.scenario = 'base' WHERE s.scenario <> 'base') SELECT scenario, count(*) AS pairs, count(*) FILTER (abs(d) > 1) AS moved, count(*) FILTER (d < -1) AS better, count(*) FILTER (d > 1) AS worse, round(avg(d), 6) AS mean_delta FROM j GROUP BY scenario"
)
def speed_sweep(spark, sf_dir):
    factors = F.explode(F.create_map(*[F.lit(x) for p in _SWEEP.items() for x in p])).alias("scenario", "factor")
    e = road.edges(spark, sf_dir).select("edge_id", "length_m", "speed_kmh", factors)
    e = e.withColumn("secs", F.col("length_m") / (F.greatest(F.lit(1), F.least(F.lit(255), F.floor(F.col("speed_kmh") * F.col("factor") + 0.5))) / F.lit(3.6)))
    return analytics.scenario_deltas(e, "base", "scenario", "edge_id", "secs", 1.0).withColumn("mean_delta", F.round("mean_delta", 6))


# --- restrictions -----------------------------------------------------------------------------------------------

_ALL_KINDS = [*restrictions.KINDS, "", "no_parking"]
RELATIONS = f"""
v_we AS (SELECT edge_id, edge_id // 2 AS way_id, edge_from, edge_to FROM v_edge), v_first AS (SELECT edge_from AS v, min(edge_id) // 2 AS next_way FROM v_edge GROUP BY edge_from),
v_rel AS (SELECT edge_id AS rel_id, {_ALL_KINDS}[edge_id % 12 + 1] AS kind, edge_id % 17 = 0 AS conditional, way_id AS from_way, next_way AS to_way, CASE WHEN edge_id % 13 <> 0 THEN edge_to + CASE WHEN edge_id % 19 = 0 THEN 1000000 ELSE 0 END END AS via_node FROM v_we LEFT JOIN v_first ON v = edge_to),
v_rj AS (SELECT r.*, CASE WHEN conditional THEN 'conditional' WHEN kind = '' THEN 'malformed-roles' WHEN kind = 'no_parking' THEN 'unknown-restriction-value' WHEN to_way IS NULL OR via_node IS NULL THEN 'malformed-roles'
  WHEN via_node NOT IN (SELECT c_custkey FROM customer) THEN 'via-node-not-an-intersection' END AS why FROM v_rel r),
v_led AS (SELECT DISTINCT rel_id FROM v_rj JOIN v_we i ON i.way_id = from_way AND i.edge_to = via_node JOIN v_we o ON o.edge_from = via_node AND o.way_id = to_way WHERE why IS NULL),
v_rb AS (SELECT DISTINCT rel_id, i.edge_id AS from_edge, o.edge_id AS to_edge FROM v_rj r JOIN v_we i ON i.way_id = from_way AND i.edge_to = via_node JOIN v_we o ON o.edge_from = via_node
  AND CASE WHEN starts_with(kind, 'no_') THEN o.way_id = to_way ELSE o.way_id <> to_way AND o.way_id <> from_way END WHERE why IS NULL AND rel_id IN (SELECT rel_id FROM v_led))
"""


def _relations(spark, sf_dir):
    edges = road.edges(spark, sf_dir).select("edge_id", F.floor(F.col("edge_id") / 2).alias("way_id"), "edge_from", "edge_to")
    first = edges.groupBy(F.col("edge_from").alias("v")).agg(F.floor(F.min("edge_id") / 2).alias("next_way"))
    e = F.col("edge_id")
    rel = edges.join(first, F.col("edge_to") == F.col("v"), "left").select(
        e.alias("rel_id"), F.element_at(F.array(*map(F.lit, _ALL_KINDS)), (e % 12 + 1).cast("int")).alias("kind"), (e % 17 == 0).alias("conditional"), F.col("way_id").alias("from_way"), F.col("next_way").alias("to_way"),
        F.when(e % 13 != 0, F.col("edge_to") + F.when(e % 19 == 0, 1000000).otherwise(0)).alias("via_node"), F.lit(None).cast("long").alias("via_way"),
    )
    return rel, edges


@query(f"WITH {sql.EDGE}, {RELATIONS} SELECT DISTINCT from_edge, to_edge FROM v_rb")
def restriction_pairs(spark, sf_dir):
    rel, edges = _relations(spark, sf_dir)
    return restrictions.resolve(rel, edges, road.vertices(spark, sf_dir))[1]


@query(
    f"WITH {sql.EDGE}, {RELATIONS}, v AS (SELECT coalesce(why, CASE WHEN r.rel_id NOT IN (SELECT rel_id FROM v_led) THEN 'member-way-wrong-direction-at-via' END) AS reason, why FROM v_rj r), "
    "w AS (SELECT CASE WHEN reason IS NULL THEN 'resolved' WHEN why IS NOT NULL THEN 'correctly-ignored' ELSE 'not-honoured' END AS verdict, reason FROM v) "
    "SELECT verdict, reason, count(*) AS relations, grouping(reason) AS overall FROM w GROUP BY GROUPING SETS ((verdict), (verdict, reason))"
)
def restriction_verdicts(spark, sf_dir):
    rel, edges = _relations(spark, sf_dir)
    return restrictions.verdict_report(restrictions.resolve(rel, edges, road.vertices(spark, sf_dir))[0])


@query(
    f"WITH {sql.EDGE}, {RELATIONS}, v AS (SELECT i.edge_id AS rel_id, i.way_id AS from_way, f.next_way AS via_way, g.next_way AS to_way, i.edge_id % 2 = 0 AS forbids FROM v_we i JOIN v_first f ON f.v = i.edge_to JOIN v_we m ON m.edge_id = (f.next_way * 2) JOIN v_first g ON g.v = m.edge_to WHERE i.edge_id % 5 = 0), "
    "x AS (SELECT v.*, i.edge_id AS from_edge, m.edge_id AS via_edge, m.edge_to AS ends FROM v JOIN v_we m ON m.way_id = via_way JOIN v_we i ON i.way_id = from_way AND i.edge_to = m.edge_from), led AS (SELECT DISTINCT rel_id FROM x JOIN v_we o ON o.edge_from = ends AND o.way_id = to_way) "
    "SELECT DISTINCT from_edge, via_edge, o.edge_id AS to_edge FROM x JOIN v_we o ON o.edge_from = ends AND CASE WHEN forbids THEN o.way_id = to_way ELSE o.way_id <> to_way AND o.way_id <> via_way END WHERE rel_id IN (SELECT rel_id FROM led)"
)
def restriction_triples(spark, sf_dir):
    """Bans that span a via way: from every fifth edge's way along the lowest way on, to the lowest way beyond."""
    _, edges = _relations(spark, sf_dir)
    first = edges.groupBy(F.col("edge_from").alias("v")).agg(F.floor(F.min("edge_id") / 2).alias("next_way"))
    via = edges.join(first, F.col("edge_to") == F.col("v")).filter("edge_id % 5 = 0").select(F.col("edge_id").alias("rel_id"), F.col("way_id").alias("from_way"), F.col("next_way").alias("via_way"))
    beyond = edges.join(first, F.col("edge_to") == F.col("v")).select(F.col("edge_id").alias("mid"), F.col("next_way").alias("to_way"))
    rel = via.join(beyond, F.col("via_way") * 2 == F.col("mid"))
    kind = F.when(F.col("rel_id") % 2 == 0, "no_entry").otherwise("only_straight_on")
    rel = rel.select("rel_id", kind.alias("kind"), F.lit(False).alias("conditional"), "from_way", "to_way", F.lit(None).cast("long").alias("via_node"), "via_way")
    return restrictions.resolve(rel, edges, road.vertices(spark, sf_dir))[2]


_CLAIM = "".join(
    f", h{k} AS (SELECT DISTINCT node_id, road FROM t JOIN c{k - 1} USING (way_id)), c{k} AS (SELECT * FROM c{k - 1} UNION ALL (SELECT way_id, road FROM (SELECT way_id, road, count(*) AS n FROM t JOIN h{k} USING (node_id) WHERE way_id NOT IN (SELECT way_id FROM c{k - 1}) GROUP BY way_id, road) QUALIFY row_number() OVER (PARTITION BY way_id ORDER BY n DESC, road) = 1))"
    for k in (1, 2)
)


@query(f"WITH {RAW}, t AS (SELECT DISTINCT way_id, node_id FROM v_way), c0 AS (SELECT DISTINCT way_id, way_id % 3 + 1 AS road FROM t WHERE way_id % 500 < 3){_CLAIM} SELECT way_id, road FROM c2")
def ramp_roads(spark, sf_dir):
    """Roads of ramps after as many rounds as the twin unrolls."""
    return _ramp_roads(spark, sf_dir, 2)


@query()
def ramp_roads_all(spark, sf_dir):
    """The same until nothing is claimed, at most 8 rounds as in the reference."""
    return _ramp_roads(spark, sf_dir, 8)


def _ramp_roads(spark, sf_dir, rounds):
    ways = _way_nodes(spark, sf_dir)
    seeds = ways.select("way_id").distinct().filter("way_id % 500 < 3").withColumn("road", F.col("way_id") % 3 + 1)
    return restrictions.attribute_ramps(ways, seeds, rounds=rounds)


# --- audits -----------------------------------------------------------------------------------------------------

_PLACE_NEAR = sql.near(SNAP_M).replace("f.fix_id, f.lat, f.lon", "f.place_id AS fix_id, f.lat, f.lon").replace("FROM v_fix f", "FROM v_place f")


@query(f"WITH {sql.EDGE}, {sql.PLACE}, {_PLACE_NEAR}, n AS (SELECT DISTINCT shape_id, name FROM v_edge), m AS (SELECT fix_id AS place_id, name AS road, min(distance_m) AS d FROM v_near JOIN n USING (shape_id) GROUP BY ALL) SELECT place_id, road, round(d, 4) AS distance_m FROM m QUALIFY row_number() OVER (PARTITION BY place_id ORDER BY d, road) <= 4")
def nearby_roads(spark, sf_dir):
    """The four nearest road names around each place."""
    edges = road.edges(spark, sf_dir)
    places = road.places(spark, sf_dir).select("place_id", "lat", "lon")
    near = spatial.pairs_within(places, road.shapes(edges), SNAP_M, "place_id", "edge_id").select("place_id", "shape_id", "distance_m")
    named = near.join(edges.select("shape_id", F.col("name").alias("road")).distinct(), "shape_id").groupBy("place_id", "road").agg(F.min("distance_m").alias("d"))
    ranked = named.withColumn("turn", F.row_number().over(W.partitionBy("place_id").orderBy("d", "road"))).filter("turn <= 4")
    return ranked.select("place_id", "road", F.round("d", 4).alias("distance_m"))


@query(
    f"WITH {sql.EDGE}, b AS (SELECT shape_id, (alat + blat) / 2 AS lat, (alon + blon) / 2 AS lon, {sql.bearing('alat', 'alon', 'blat', 'blon')} AS bearing FROM v_seg), p AS (SELECT x.shape_id, y.shape_id AS other, {sql.haversine('x.lat', 'x.lon', 'y.lat', 'y.lon')} AS d, fmod(abs(x.bearing - y.bearing), 360) AS g FROM b x JOIN b y ON x.shape_id <> y.shape_id AND abs(x.lat - y.lat) < 0.002 AND abs(x.lon - y.lon) < 0.002) "
    "SELECT shape_id, other, round(d, 4) AS distance_m FROM p WHERE d <= 120 AND CASE WHEN g > 180 THEN 360 - g ELSE g END <= 30 QUALIFY row_number() OVER (PARTITION BY shape_id ORDER BY d, other) = 1"
)
def parallel_roads(spark, sf_dir):
    """The nearest other segment with about the same direction: a band join on cells, then a minimum."""
    b = _shapes(spark, sf_dir).select("shape_id", ((F.col("alat") + F.col("blat")) / 2).alias("lat"), ((F.col("alon") + F.col("blon")) / 2).alias("lon"), geo.bearing(F.col("alat"), F.col("alon"), F.col("blat"), F.col("blon")).alias("bearing"))
    other = b.select(F.col("shape_id").alias("other"), F.col("lat").alias("olat"), F.col("lon").alias("olon"), F.col("bearing").alias("obearing"))
    pairs = spatial.point_pairs(b, other, 120, "shape_id").filter("shape_id <> other").withColumnRenamed("distance_m", "d")
    near = pairs.filter(geo.bearing_gap(F.col("bearing"), F.col("obearing")) <= 30)
    best = near.groupBy("shape_id").agg(F.min(F.struct("d", "other")).alias("best"))
    return best.select("shape_id", "best.other", F.round("best.d", 4).alias("distance_m"))


@query(
    f"WITH {sql.EDGE}, b AS (SELECT edge_id, shape_id, (lat1 + lat2) / 2 AS lat, (lon1 + lon2) / 2 AS lon, {sql.bearing('lat1', 'lon1', 'lat2', 'lon2')} AS bearing FROM v_edge), "
    f"p AS (SELECT x.edge_id, y.edge_id AS other, {sql.haversine('x.lat', 'x.lon', 'y.lat', 'y.lon')} AS d, fmod(abs(x.bearing - y.bearing), 360) AS g FROM b x JOIN b y ON x.shape_id <> y.shape_id AND y.lat BETWEEN x.lat - 0.0025 AND x.lat + 0.0025 AND y.lon BETWEEN x.lon - 0.0025 AND x.lon + 0.0025) "
    "SELECT edge_id, other, round(d, 4) AS distance_m FROM p WHERE d <= 150 AND abs(180 - least(g, 360 - g)) <= 30 QUALIFY row_number() OVER (PARTITION BY edge_id ORDER BY d, other) = 1"
)
def opposing_roads(spark, sf_dir):
    """The nearest edge of another segment that runs against an edge's direction: who may be taken for the other side."""
    e = road.edges(spark, sf_dir)
    b = e.select("edge_id", "shape_id", ((F.col("lat1") + F.col("lat2")) / 2).alias("lat"), ((F.col("lon1") + F.col("lon2")) / 2).alias("lon"), geo.bearing(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")).alias("bearing"))
    other = b.select(F.col("edge_id").alias("other"), F.col("shape_id").alias("oshape"), F.col("lat").alias("olat"), F.col("lon").alias("olon"), F.col("bearing").alias("obearing"))
    pairs = spatial.point_pairs(b, other, 150, "edge_id").filter("shape_id <> oshape").withColumnRenamed("distance_m", "d")
    near = pairs.filter(F.abs(180 - geo.bearing_gap(F.col("bearing"), F.col("obearing"))) <= 30)
    best = near.groupBy("edge_id").agg(F.min(F.struct("d", "other")).alias("best"))
    return best.select("edge_id", "best.other", F.round("best.d", 4).alias("distance_m"))


_TOLLED_NEAR = sql.near(150).replace("f.fix_id, f.lat, f.lon", "f.shape_id AS fix_id, f.lat, f.lon").replace("FROM v_fix f JOIN v_seg s", "FROM v_mid f JOIN v_free s")


@query(
    f"WITH {sql.EDGE}, k AS (SELECT shape_id, max(toll_road) AS toll_road, max(length_m) AS length_m FROM v_edge GROUP BY shape_id), v_mid AS (SELECT s.shape_id, (alat + blat) / 2 AS lat, (alon + blon) / 2 AS lon FROM v_seg s JOIN k USING (shape_id) WHERE toll_road > 0), v_free AS (SELECT s.* FROM v_seg s JOIN k USING (shape_id) WHERE toll_road = 0), {_TOLLED_NEAR} "
    "SELECT toll_road, count(*) AS segments, round(sum(CASE WHEN shape_id IN (SELECT fix_id FROM v_near) THEN length_m ELSE 0 END) / sum(length_m), 7) AS covered FROM k WHERE toll_road > 0 GROUP BY toll_road"
)
def free_road_coverage(spark, sf_dir):
    """Share of each toll road's length with a free road beside it: a range join of midpoints, then a conditional sum."""
    edges = road.edges(spark, sf_dir)
    shapes = road.shapes(edges).join(edges.groupBy("shape_id").agg(F.max("toll_road").alias("toll_road"), F.max("length_m").alias("length_m")), "shape_id")
    middles = shapes.filter("toll_road > 0").select(F.col("shape_id").alias("mid"), "toll_road", "length_m", ((F.col("alat") + F.col("blat")) / 2).alias("lat"), ((F.col("alon") + F.col("blon")) / 2).alias("lon"))
    beside = spatial.nearest(middles, shapes.filter("toll_road = 0").select("edge_id", "alat", "alon", "blat", "blon"), 150, "mid", "edge_id").select("mid", F.lit(1).alias("beside"))
    joined = middles.join(beside, "mid", "left").groupBy("toll_road")
    return joined.agg(F.count(F.lit(1)).alias("segments"), F.round(F.sum(F.when(F.col("beside") == 1, F.col("length_m")).otherwise(0.0)) / F.sum("length_m"), 7).alias("covered"))


@query(f"WITH {RAW}, {NODES}, j AS (SELECT way_id, node_id, lat_e7, lon_e7 FROM v_way JOIN v_node USING (node_id)) SELECT way_id, min(lat_e7) AS south, max(lat_e7) AS north, min(lon_e7) AS west, max(lon_e7) AS east, arg_max(node_id, (lat_e7, node_id)) AS northmost FROM j GROUP BY way_id")
def way_boxes(spark, sf_dir):
    j = _way_nodes(spark, sf_dir).join(_nodes(spark, sf_dir), "node_id")
    return j.groupBy("way_id").agg(F.min("lat_e7").alias("south"), F.max("lat_e7").alias("north"), F.min("lon_e7").alias("west"), F.max("lon_e7").alias("east"), F.max(F.struct("lat_e7", "node_id"))["node_id"].alias("northmost"))


_PAIRS = "SELECT DISTINCT way_id, least(node_id, nxt) AS a, greatest(node_id, nxt) AS b FROM (SELECT way_id, node_id, lead(node_id) OVER (PARTITION BY way_id ORDER BY pos, node_id) AS nxt FROM {0}) WHERE nxt IS NOT NULL"


@query(f"WITH {RAW}, {NODES}, {RESOLVED}, p AS ({_PAIRS.format('v_res')}) SELECT DISTINCT x.way_id, y.way_id AS driven FROM p x JOIN p y ON x.a = y.a AND x.b = y.b AND x.way_id <> y.way_id")
def driven_ways(spark, sf_dir):
    """Ways that hold two nodes which are neighbours on another way too, whatever the direction."""
    w = W.partitionBy("way_id").orderBy("pos", "node_id")
    r = ingest.resolve(_way_nodes(spark, sf_dir), _nodes(spark, sf_dir)).withColumn("next", F.lead("node_id").over(w)).filter("next is not null")
    return ingest.sharing(r.select("way_id", F.struct(F.least("node_id", "next").alias("a"), F.greatest("node_id", "next").alias("b")).alias("pair")), "way_id", "pair", "driven")


_N = float(1 << 14)


@query(f"WITH {sql.FIX} SELECT floor((lon + 180) / 360 * {_N})::BIGINT AS x, floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * {_N})::BIGINT AS y, count(*) AS fixes FROM v_fix GROUP BY ALL")
def tile_census(spark, sf_dir):
    x, y = tiles.tile_xy(F.col("lat"), F.col("lon"), 14)
    return road.fixes(spark, sf_dir).groupBy(x.alias("x"), y.alias("y")).agg(F.count(F.lit(1)).alias("fixes"))


@query()
def tile_order(spark, sf_dir):
    """Tiles that hold fixes, along the curve, with the first tile of the same content."""
    held = tile_census(spark, sf_dir).withColumn("tile_id", tiles.tile_id(F.lit(14), "x", "y")).withColumn("body", F.col("fixes").cast("string").cast("binary"))
    return tiles.stored_once(held).select("tile_id", "content", "stored_as")


@query(f"WITH {sql.EDGE} SELECT CASE WHEN length_m < 950 THEN (floor(length_m / 10 + 0.5) * 10)::INT::VARCHAR || ' m' ELSE printf('%.1f km', length_m / 1000) END AS spoken, count(*) AS edges FROM v_edge GROUP BY ALL")
def spoken_distances(spark, sf_dir):
    return road.edges(spark, sf_dir).groupBy(instructions.spoken_distance(F.col("length_m")).alias("spoken")).agg(F.count(F.lit(1)).alias("edges"))


from waygrid.plans import audits as _audits, bent as _bent, gathered as _gathered  # noqa: E402, F401 - register their queries here
