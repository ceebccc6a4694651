"""Registered queries over files in order, places in order, clusters of roads and seeded pairs, and their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from waygrid.config import LANDUSES, LEISURE_AREAS, MATCH_M, ROAD_CLUSTER_M, ROAD_ZOOM, SAMPLE_SEED, WATERWAYS
from waygrid.functions import tiles
from waygrid.operators import places, sampling
from waygrid.plans import sql
from waygrid.plans.catalog import _shapes, query
from waygrid.plans.lineage import shared_folder
from waygrid.sinks import osm_pbf as pbf_sink
from waygrid.sources import osm_pbf
from waygrid.sources import projection as road

# --- files in order ---------------------------------------------------------------------------------------------

_REFS = """
v_el AS (SELECT DISTINCT l_orderkey AS id, l_linenumber AS pos, l_suppkey * 13 % 40 + l_partkey // 25 % 30 * 40 AS node_id FROM lineitem),
v_kept AS (SELECT id, string_agg(node_id::VARCHAR, ',' ORDER BY pos, node_id) AS refs, count(*) AS n FROM v_el WHERE node_id IN (SELECT c_custkey FROM customer) GROUP BY id)
"""


def _elements(spark, sf_dir):
    """Vertices as nodes, and raw ways as ways, some of whose references are to nodes that there are not."""
    nodes = road.vertices(spark, sf_dir).select(F.lit("node").alias("kind"), F.col("vertex_id").alias("id"), F.col("lat_e7").cast("int").alias("lat_e7"), F.col("lon_e7").cast("int").alias("lon_e7"))
    steps = F.array_sort(F.collect_list(F.struct("pos", "node_id")))
    ways = road.raw_ways(spark, sf_dir).select("way_id", "pos", "node_id").distinct().groupBy(F.col("way_id").alias("id")).agg(F.transform(steps, lambda x: x["node_id"]).alias("refs"))
    ways = ways.withColumn("kind", F.lit("way"))
    rows = nodes.unionByName(ways, allowMissingColumns=True)
    return rows.withColumn("members", F.lit(None).cast("array<struct<type: string, ref: bigint, role: string>>")).withColumn("tags", F.create_map().cast("map<string, string>"))


@query(
    f"WITH {_REFS}, e AS (SELECT 0 AS o, 'node' AS kind, c_custkey AS id, {sql.lat('c_custkey')} AS lat_e7, {sql.lon('c_custkey')} AS lon_e7, '' AS refs FROM customer "
    "UNION ALL SELECT 1, 'way', id, NULL, NULL, refs FROM v_kept WHERE n > 1) "
    "SELECT row_number() OVER (ORDER BY o, id) - 1 AS place, kind, id, lat_e7::BIGINT AS lat_e7, lon_e7::BIGINT AS lon_e7, refs FROM e"
)
def pbf_in_order(spark, sf_dir):
    """The network's elements written as PBF by kind and id, and read back, with their places in the files."""
    from waygrid.operators.network import numbered

    osm_pbf.register(spark)
    folder = f"{shared_folder(spark)}/pbf-{uuid.uuid4().hex}"
    pbf_sink.write_sorted(_elements(spark, sf_dir), folder)
    back = numbered(spark.read.format("osm_pbf").load(folder), ["ord"], "number")
    refs = F.coalesce(F.concat_ws(",", F.transform("refs", lambda x: x.cast("string"))), F.lit(""))
    return back.select(F.col("number").cast("long").alias("place"), "kind", "id", F.col("lat_e7").cast("long").alias("lat_e7"), F.col("lon_e7").cast("long").alias("lon_e7"), refs.alias("refs"))


# --- places -----------------------------------------------------------------------------------------------------


@query(
    r"WITH w AS (SELECT unnest(regexp_extract_all(text, '[\p{L}\p{M}]+')) AS name FROM documents), c AS (SELECT name, count(*) AS importance FROM w GROUP BY name) "
    'SELECT name, importance, row_number() OVER (ORDER BY importance DESC, name COLLATE "en", name) - 1 AS place FROM c'
)
def place_order(spark, sf_dir):
    """Words as names of places, as important as they are frequent, in the order in which an index of places is written."""
    words = road.read(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{M}]+"), 0)).alias("name"))
    names = words.groupBy("name").agg(F.count(F.lit(1)).alias("importance")).withColumn("place_id", F.lit(0))
    return places.build_order(names).select("name", "importance", F.col("place").cast("long").alias("place"))


@query()
def road_clusters(spark, sf_dir):
    """Edges of one name near each other as one place; half of them are moved far off, so that names fall into parts. A fold in
    the order of ids, which SQL can't express: tests hold it against the plain loop."""
    e = road.edges(spark, sf_dir)
    far = F.when(F.col("edge_id") % 2 == 0, F.col("edge_id") % 7 * 0.5).otherwise(0.0)
    roads = e.select(F.col("edge_id").alias("way_id"), F.col("name").alias("norm"), F.col("class_rank").alias("rank"), ((F.col("lat1") + F.col("lat2")) / 2 + far).alias("lat"), ((F.col("lon1") + F.col("lon2")) / 2).alias("lon"))
    found = places.cluster_roads(roads, ROAD_CLUSTER_M)
    return found.select("norm", "way_id", "rank", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "ways")


# --- seeded pairs -----------------------------------------------------------------------------------------------

#: Attempts for each pair, at most, and what the twin makes of the draws.
MOST_TRIES = 8
_WORD = "4294967296"
_PAIRS = f"""
v_in AS (SELECT count(*) AS wanted, min({sql.lat('c_custkey')} / 1e7) AS south, max({sql.lat('c_custkey')} / 1e7) AS north, min({sql.lon('c_custkey')} / 1e7) AS west, max({sql.lon('c_custkey')} / 1e7) AS east FROM customer),
v_d0 AS (SELECT n, ((({SAMPLE_SEED} + (n + 1)::HUGEINT * {sampling.STEP}) % {_WORD})::BIGINT) AS a FROM v_in, range(0, 4 * {MOST_TRIES} * (SELECT wanted FROM v_in)) r(n)),
v_d1 AS (SELECT n, (xor(a, a >> 15)::HUGEINT * (a | 1) % {_WORD})::BIGINT AS t FROM v_d0),
v_d2 AS (SELECT n, xor(((t + xor(t, t >> 7)::HUGEINT * (t | 61)) % {_WORD})::BIGINT, t) AS t FROM v_d1),
v_d3 AS (SELECT n // 4 AS attempt, n % 4 AS part, xor(t, t >> 14) / {_WORD}::DOUBLE AS x FROM v_d2),
v_try AS (SELECT attempt, west + max(x) FILTER (part = 0) * (east - west) AS alon, south + max(x) FILTER (part = 1) * (north - south) AS alat,
  west + max(x) FILTER (part = 2) * (east - west) AS blon, south + max(x) FILTER (part = 3) * (north - south) AS blat FROM v_d3, v_in GROUP BY attempt, west, east, south, north),
v_fix AS (SELECT attempt * 2 AS fix_id, alat AS lat, alon AS lon FROM v_try UNION ALL SELECT attempt * 2 + 1, blat, blon FROM v_try)
"""


@query(
    f"WITH {sql.EDGE}, {_PAIRS}, {sql.near(MATCH_M)}, k AS (SELECT fix_id // 2 AS attempt FROM (SELECT DISTINCT fix_id FROM v_near) GROUP BY 1 HAVING count(*) = 2), "
    "r AS (SELECT attempt, row_number() OVER (ORDER BY attempt) AS pair FROM k) "
    "SELECT pair, attempt, round(alat, 7) AS alat, round(alon, 7) AS alon, round(blat, 7) AS blat, round(blon, 7) AS blon FROM r JOIN v_try USING (attempt), v_in WHERE pair <= wanted"
)
def seeded_pairs(spark, sf_dir):
    """As many pairs as the network has vertices, drawn in its box; both ends lie near a road."""
    v = road.vertices(spark, sf_dir)
    box = v.agg(F.min("lat").alias("s"), F.min("lon").alias("w"), F.max("lat").alias("n"), F.max("lon").alias("e"), F.count(F.lit(1)).alias("wanted")).collect()[0]  # one row
    area = (box["s"] or 0.0, box["w"] or 0.0, box["n"] or 0.0, box["e"] or 0.0)
    found = sampling.seeded_pairs(_shapes(spark, sf_dir), area, box["wanted"], SAMPLE_SEED, MATCH_M, MOST_TRIES)
    return found.select(F.col("pair").cast("long").alias("pair"), F.col("attempt").cast("long").alias("attempt"), *[F.round(c, 7).alias(c) for c in ("alat", "alon", "blat", "blon")])


# --- layers of ways ---------------------------------------------------------------------------------------------

#: Tags of made ways: every so many-th way has the key, with one of the values in turn.
_USES = {
    "highway": (3, (*list(ROAD_ZOOM)[:12], "proposed")), "waterway": (4, ("river", "drain", "riverbank", "dam")), "natural": (5, ("water", "wood")), "water": (7, ("pond", "")),
    "landuse": (4, ("residential", "reservoir", "forest", "farmland")), "leisure": (7, ("park", "marina")), "building": (6, ("yes",)), "boundary": (5, ("administrative", "parish")),
    "admin_level": (1, ("4", "6", "8", "x", "")), "oneway": (2, ("yes", "-1", "no", "reverse")), "junction": (6, ("roundabout", "")), "ref": (9, ("NE2", "")),
}
_COLUMNS = ", ".join(f"nullif(CASE WHEN k % {m} = 0 THEN {list(v)}[(k // {m}) % {len(v)} + 1] END, '') AS {t}" for t, (m, v) in _USES.items())
_ZOOMS = " ".join(f"WHEN '{c}' THEN {z}" for c, z in ROAD_ZOOM.items())
_NONE = "NULL, NULL, NULL"


@query(
    f"""WITH t AS (SELECT k, CASE WHEN k % 4 <> 0 THEN p_name END AS name, k % 8 < 4 AS closed, {_COLUMNS} FROM (SELECT p_partkey AS k, p_name FROM part)),
u AS (SELECT *, CASE highway {_ZOOMS} END AS zoom, try_cast(admin_level AS DOUBLE) AS level, CASE WHEN highway IS NOT NULL THEN 'road' WHEN waterway IN {WATERWAYS} THEN 'waterway'
  WHEN "natural" = 'water' OR landuse = 'reservoir' OR waterway = 'riverbank' THEN 'water' WHEN landuse IN {LANDUSES} THEN 'landuse' WHEN leisure IN {LEISURE_AREAS} THEN 'leisure'
  WHEN building IS NOT NULL AND closed THEN 'building' WHEN boundary = 'administrative' AND try_cast(admin_level AS DOUBLE) <= 6 THEN 'boundary' END AS kind FROM t)
SELECT k AS way_id, 'transportation' AS layer, highway AS class, zoom AS min_zoom, CASE WHEN oneway = 'yes' THEN 1 WHEN oneway IN ('-1', 'reverse') THEN -1 END AS oneway, coalesce(junction = 'roundabout', false) AS roundabout, ref, NULL AS name, NULL::DOUBLE AS admin_level FROM u WHERE zoom IS NOT NULL
UNION ALL SELECT k, 'transportation_name', highway, greatest(zoom, 12), NULL, NULL, ref, name, NULL FROM u WHERE zoom IS NOT NULL AND name IS NOT NULL
UNION ALL SELECT k, 'waterway', waterway, CASE WHEN waterway = 'river' THEN 8 ELSE 12 END, {_NONE}, name, NULL FROM u WHERE kind = 'waterway'
UNION ALL SELECT k, 'water', coalesce(water, 'lake'), 8, {_NONE}, name, NULL FROM u WHERE kind = 'water'
UNION ALL SELECT k, 'landuse', CASE kind WHEN 'leisure' THEN leisure ELSE landuse END, CASE kind WHEN 'leisure' THEN 11 ELSE 10 END, {_NONE}, name, NULL FROM u WHERE kind IN ('landuse', 'leisure')
UNION ALL SELECT k, 'building', NULL, 14, {_NONE}, NULL, NULL FROM u WHERE kind = 'building'
UNION ALL SELECT k, 'boundary', NULL, 6, {_NONE}, NULL, level FROM u WHERE kind = 'boundary'"""
)
def way_layers(spark, sf_dir):
    """Tagged ways in the layers of the tiles, with their classes and the zooms from which on they are shown."""
    k = F.col("p_partkey")
    pairs = [F.struct(F.lit("name").alias("key"), F.when(k % 4 != 0, F.col("p_name")).alias("value"))]
    for t, (m, values) in _USES.items():
        value = F.element_at(F.array(*map(F.lit, values)), (F.floor(k / m) % len(values) + 1).cast("int"))
        pairs.append(F.struct(F.lit(t).alias("key"), F.when(k % m == 0, value).alias("value")))
    tags = F.map_from_entries(F.filter(F.array(*pairs), lambda x: x["value"].isNotNull()))
    ways = road.read(spark, sf_dir, "part").select(k.alias("way_id"), tags.alias("tags"), (k % 8 < 4).alias("closed"))
    return ways.select("way_id", F.explode(tiles.way_layers()).alias("l")).select("way_id", "l.*")
