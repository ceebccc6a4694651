"""Registered queries over the built network, lines and audits, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from waygrid.config import COVERED_M, PLACE_ORDER, PLACE_ZOOM, PLAZA_KM, POI_AMENITIES, SNAP_M
from waygrid.functions import display, geo, strings
from waygrid.operators import audits, graph, network, shown, spatial, tolls
from waygrid.plans import sql
from waygrid.plans.lineage import shared_folder
from waygrid.plans.catalog import _BOX, _GATED, IN_BOX, NODES, ORACLES, RAW, RESOLVED, TAGS, VERTEX
from waygrid.plans.catalog import _gated_runs, _in_box, _route_segments, _shapes, _way_nodes, clip_ways, opposing_roads, query
from waygrid.sinks import artifact
from waygrid.sources import projection as road

# --- the built network ------------------------------------------------------------------------------------------

#: The component of the vertex with most arcs: the largest one if it holds more than half of all vertices, as here.
BUILT = f"""
{TAGS}, {RAW.replace("v_way AS", "v_allway AS")},
v_way AS (SELECT * FROM v_allway WHERE way_id IN (SELECT way_id FROM v_prof WHERE drivable)), {NODES}, {RESOLVED}, {VERTEX},
v_st AS (SELECT way_id, pos, node_id, lat_e7 / 1e7 AS lat, lon_e7 / 1e7 AS lon FROM v_res JOIN v_node USING (node_id)),
v_f AS (SELECT s.*, sum(CASE WHEN x.node_id IS NULL THEN 0 ELSE 1 END) OVER w AS piece, lead(lat) OVER w AS nlat, lead(lon) OVER w AS nlon
  FROM v_st s LEFT JOIN v_vx x ON s.node_id = x.node_id WINDOW w AS (PARTITION BY way_id ORDER BY pos, s.node_id)),
v_len AS (SELECT way_id, piece, sum({sql.haversine("lat", "lon", "nlat", "nlon")}) AS length_m FROM v_f WHERE nlat IS NOT NULL GROUP BY ALL),
v_h AS (SELECT way_id, piece, arg_min(node_id, pos * 1000000 + node_id) AS node_from FROM v_f GROUP BY ALL),
v_pc AS (SELECT *, lead(node_from) OVER (PARTITION BY way_id ORDER BY piece) AS node_to FROM v_h),
v_de AS (SELECT way_id, piece, r AS reversed, CASE WHEN r = 0 THEN node_from ELSE node_to END AS node_a, CASE WHEN r = 0 THEN node_to ELSE node_from END AS node_b,
  length_m, speed_kmh, class_rank, access = 'private' AS private, toll, toll_road, road_name
  FROM v_pc JOIN v_len USING (way_id, piece) JOIN v_prof USING (way_id), (VALUES (0), (1)) d(r)
  WHERE node_to IS NOT NULL AND piece > 0 AND node_from <> node_to AND CASE WHEN r = 0 THEN forward ELSE backward END),
v_hub AS (SELECT node_a AS v FROM v_de GROUP BY node_a ORDER BY count(*) DESC, node_a LIMIT 1),
v_ab AS (SELECT DISTINCT node_a AS a, node_b AS b FROM v_de),
v_fw(v) AS (SELECT v FROM v_hub UNION SELECT b FROM v_fw JOIN v_ab ON a = v),
v_bw(v) AS (SELECT v FROM v_hub UNION SELECT a FROM v_bw JOIN v_ab ON b = v),
v_nv AS (SELECT v AS node_id, row_number() OVER (ORDER BY v) - 1 AS vertex_id FROM (SELECT v FROM v_fw INTERSECT SELECT v FROM v_bw)),
v_nm AS (SELECT road_name, row_number() OVER (ORDER BY min(way_id)) - 1 AS name_id FROM v_prof WHERE drivable AND road_name IS NOT NULL GROUP BY road_name),
v_ge AS (SELECT row_number() OVER (ORDER BY way_id, piece, reversed) - 1 AS edge_id, a.vertex_id AS edge_from, b.vertex_id AS edge_to, e.*, coalesce(name_id, -1) AS name_id
  FROM v_de e JOIN v_nv a ON node_a = a.node_id JOIN v_nv b ON node_b = b.node_id LEFT JOIN v_nm USING (road_name))
"""


def _built(spark, sf_dir):
    """The network, built once for all queries on the same tables and read from then on."""
    inputs = [f"{sf_dir}/{t}.parquet" for t in ("orders", "lineitem", "customer", "part", "supplier")]
    store = artifact.ArtifactStore(spark, f"{shared_folder(spark)}/networks")

    def build():
        nodes = road.vertices(spark, sf_dir).select(F.col("vertex_id").alias("node_id"), "lat", "lon")
        return network.build(_way_nodes(spark, sf_dir), road.tagged_ways(spark, sf_dir), nodes)

    return store.load_or_build(artifact.inputs_key(spark, inputs, "built"), build, ("vertices", "edges", "names", "all_edges"))


@query(
    f"WITH RECURSIVE {BUILT} SELECT edge_id, edge_from, edge_to, way_id, reversed, round(length_m, 4) AS length_m, speed_kmh, class_rank, private, toll, "
    "toll_road, name_id FROM v_ge"
)
def built_edges(spark, sf_dir):
    """Edges of the network built from tagged ways: classified, split, directed, its largest component, numbered."""
    e = _built(spark, sf_dir)["edges"].withColumn("length_m", F.round("length_m", 4))
    return e.select("edge_id", "edge_from", "edge_to", "way_id", "reversed", "length_m", "speed_kmh", "class_rank", "private", "toll", "toll_road", "name_id")


@query(f"WITH RECURSIVE {BUILT} SELECT vertex_id, node_id FROM v_nv")
def built_vertices(spark, sf_dir):
    return _built(spark, sf_dir)["vertices"].select("vertex_id", "node_id")


@query(f"WITH RECURSIVE {BUILT} SELECT name_id, road_name FROM v_nm")
def built_names(spark, sf_dir):
    return _built(spark, sf_dir)["names"]


@query(
    f"WITH RECURSIVE {BUILT}, o AS (SELECT count(*) AS n FROM v_de GROUP BY way_id, piece HAVING count(*) = 1) "
    "SELECT (SELECT count(DISTINCT v) FROM (SELECT node_a AS v FROM v_de UNION ALL SELECT node_b FROM v_de)) AS vertices_before, (SELECT count(*) FROM v_de) AS edges_before, "
    "(SELECT count(*) FROM o) AS oneway_edges, (SELECT count(*) FROM v_ge) AS edges_after, round((SELECT sum(length_m) FROM v_ge) / 1000, 4) AS km, (SELECT count(*) FROM v_nv) AS vertices_after"
)
def build_stats(spark, sf_dir):
    return network.build_stats(_built(spark, sf_dir)).withColumn("km", F.round("km", 4))


@query(
    f"WITH RECURSIVE {BUILT} SELECT w.way_id, CASE WHEN p.way_id IS NULL THEN 'outside-build-area' WHEN w.way_id IN (SELECT way_id FROM v_ge) THEN 'present' "
    "WHEN NOT p.drivable THEN 'excluded-by-profile' ELSE 'dropped-by-scc' END AS cause, coalesce(p.highway, '') AS highway, coalesce(p.name, p.ref, '') AS name "
    "FROM (SELECT DISTINCT way_id FROM v_allway) w LEFT JOIN v_prof p ON w.way_id = p.way_id"
)
def way_verdicts(spark, sf_dir):
    """What became of each way that the extracts hold."""
    asked = road.raw_ways(spark, sf_dir).select("way_id")
    return network.way_verdicts(asked, road.tagged_ways(spark, sf_dir), _built(spark, sf_dir)["edges"])


@query(
    f"WITH {RAW}, {NODES}, {IN_BOX}, k AS (SELECT DISTINCT way_id FROM v_way WHERE node_id IN (SELECT node_id FROM v_in)), "
    "m AS (SELECT l_orderkey AS rel_id, l_linenumber AS pos, ['way', 'node', 'relation'][l_partkey % 3 + 1] AS kind, "
    "CASE l_partkey % 3 WHEN 0 THEN l_partkey WHEN 1 THEN l_suppkey * 13 % 40 + (l_partkey // 25) % 30 * 40 ELSE l_suppkey END AS ref FROM lineitem WHERE l_orderkey % 5 < 3 OR l_orderkey % 4 = 0), "
    "h AS (SELECT *, (kind = 'way' AND ref IN (SELECT way_id FROM k)) OR (kind = 'node' AND ref IN (SELECT node_id FROM v_in)) AS hit FROM m), "
    "t AS (SELECT *, coalesce(bool_or(hit) OVER (PARTITION BY rel_id ORDER BY pos, kind, ref ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS touched FROM h) "
    "SELECT rel_id, bool_or(hit) AS kept, count(*) FILTER (kind = 'relation' AND NOT touched) AS nested FROM t GROUP BY rel_id"
)
def clip_relations(spark, sf_dir):
    """Relations of a clip: line items as members, their kinds and what they refer to by arithmetic."""
    li, part, supp = road.read(spark, sf_dir, "lineitem"), F.col("l_partkey"), F.col("l_suppkey")
    ref = F.when(part % 3 == 0, part).when(part % 3 == 1, supp * 13 % 40 + F.floor(part / 25) % 30 * 40).otherwise(supp)
    kind = F.element_at(F.array(*map(F.lit, ("way", "node", "relation"))), (part % 3 + 1).cast("int"))
    members = li.select(F.col("l_orderkey").alias("rel_id"), F.col("l_linenumber").alias("pos"), kind.alias("kind"), ref.cast("long").alias("ref"))
    k = F.col("rel_id")
    types = F.element_at(F.array(*map(F.lit, ("restriction", "multipolygon", "boundary", "route", "site"))), (k % 5 + 1).cast("int"))
    tags = F.map_concat(F.create_map(F.lit("type"), types), F.when(k % 4 == 0, F.create_map(F.lit("name"), F.lit("named"))).otherwise(F.create_map().cast("map<string,string>")))
    relations = members.select("rel_id").distinct().withColumn("tags", tags)
    return network.clip_relations(relations, members, clip_ways(spark, sf_dir), _in_box(spark, sf_dir))


_CHAINED = """
v_w AS (SELECT edge_id AS way_id, edge_from AS head, edge_to AS tail, length_m AS metres, lat1, lat2 FROM v_edge WHERE class_rank = 0),
v_s AS (SELECT way_id, head AS node, row_number() OVER (PARTITION BY head ORDER BY way_id) AS k FROM v_w),
v_t AS (SELECT way_id AS before, tail AS node, row_number() OVER (PARTITION BY tail ORDER BY way_id) AS k FROM v_w),
v_l AS (SELECT s.way_id, before FROM v_s s LEFT JOIN v_t USING (node, k)),
v_run(way_id, run, start_m) AS (SELECT way_id, way_id, 0.0::DOUBLE FROM v_l WHERE before IS NULL
  UNION ALL SELECT l.way_id, r.run, r.start_m + p.metres FROM v_run r JOIN v_l l ON l.before = r.way_id JOIN v_w p ON p.way_id = r.way_id),
v_cy(origin, way_id) AS (SELECT way_id, way_id FROM v_l WHERE way_id NOT IN (SELECT way_id FROM v_run) UNION SELECT origin, before FROM v_cy JOIN v_l USING (way_id)),
v_ring(way_id, run, start_m) AS (SELECT origin, origin, 0.0::DOUBLE FROM v_cy GROUP BY origin HAVING min(way_id) = origin
  UNION ALL SELECT l.way_id, r.run, r.start_m + p.metres FROM v_ring r JOIN v_l l ON l.before = r.way_id JOIN v_w p ON p.way_id = r.way_id WHERE l.way_id <> r.run),
v_ch AS (SELECT * FROM v_run UNION ALL SELECT * FROM v_ring)
"""


@query(
    f"WITH RECURSIVE {sql.EDGE}, {_CHAINED}, n AS (SELECT run, head AS node_id, start_m AS run_m, lat1 AS lat FROM v_ch JOIN v_w USING (way_id) UNION ALL SELECT run, tail, start_m + metres, lat2 FROM v_ch JOIN v_w USING (way_id)), "
    "s AS (SELECT run, arg_min(lat, run_m) AS a, arg_max(lat, run_m) AS b, max(run_m) AS total FROM n GROUP BY run), "
    "k AS (SELECT node_id, run, (CASE WHEN a <= b THEN run_m ELSE total - run_m END) / 1000 AS km FROM n JOIN s USING (run) QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY run, run_m) = 1) "
    "SELECT node_id, run, round(km, 6) AS km_from_south, round(134.548::DOUBLE - km, 6) AS chainage_km FROM k"
)
def chainage(spark, sf_dir):
    """Chainage of the nodes along the motorways, each run from its own southern end."""
    e = road.edges(spark, sf_dir).filter("class_rank = 0")
    ends = [F.struct(F.lit(i).alias("pos"), F.col(n).alias("node_id"), F.col(f"lat{i + 1}").alias("lat"), F.col(f"lon{i + 1}").alias("lon")) for i, n in enumerate(("edge_from", "edge_to"))]
    refs = e.select(F.col("edge_id").alias("way_id"), F.explode(F.array(*ends)).alias("p")).select("way_id", "p.*")
    return network.chainage(refs).select("node_id", "run", *[F.round(c, 6).alias(c) for c in ("km_from_south", "chainage_km")])


@query(
    f"WITH {sql.EDGE}, {sql.TURN}, c AS (SELECT t.*, n.seconds FROM v_t1 t JOIN v_turn n USING (edge_in, edge_out)) "
    "SELECT count(*) FILTER (is_uturn AND ways_on > 1) AS uturns, count(*) FILTER (is_uturn AND ways_on <= 1) AS exempt, "
    "count(*) FILTER (NOT is_uturn AND d >= 40) AS crossing, count(*) FILTER (NOT is_uturn AND rout > rin) AS class_drop FROM c"
)
def turn_census(spark, sf_dir):
    """U-turns that cost and that are exempt, turns across the oncoming lane, and onto a lower class."""
    return graph.turn_census(road.edges(spark, sf_dir))


# --- lines ------------------------------------------------------------------------------------------------------

_LINES = f"""
v_vx AS (SELECT c_custkey AS k, {sql.lat("c_custkey")} / 1e7 AS lat, {sql.lon("c_custkey")} / 1e7 AS lon FROM customer),
v_ln AS (SELECT a.k // 40 AS line_id, a.k % 40 AS seq, (a.lat + b.lat) / 2 AS lat, (a.lon + b.lon) / 2 AS lon, {sql.haversine("a.lat", "a.lon", "b.lat", "b.lon")} AS metres
  FROM v_vx a JOIN v_vx b ON b.k = a.k + 1 WHERE a.k % 40 < 39),
v_fix AS (SELECT line_id * 100 + seq AS fix_id, lat, lon FROM v_ln WHERE metres > 0), {sql.near(COVERED_M)},
v_best AS (SELECT fix_id, edge_id FROM v_near QUALIFY row_number() OVER (PARTITION BY fix_id ORDER BY distance_m, edge_id) = 1),
v_cov AS (SELECT line_id, metres, e.* FROM v_ln LEFT JOIN v_best ON fix_id = line_id * 100 + seq LEFT JOIN (SELECT edge_id, speed_kmh, toll_road, name, class_rank FROM v_edge) e USING (edge_id)),
v_pr AS (SELECT line_id, sum(metres) AS metres, sum(CASE WHEN edge_id IS NULL THEN metres ELSE 0 END) AS uncovered_m, sum(CASE WHEN toll_road > 0 THEN metres ELSE 0 END) AS toll_m,
  sum(metres / (coalesce(speed_kmh, 10) / 3.6::DOUBLE)) AS drive_s FROM v_cov GROUP BY line_id),
v_price AS (SELECT *, metres / 1000 * 24 AS distance_s, toll_m / 1000 * 1.95::DOUBLE * (3600 / 550.0::DOUBLE) AS toll_s FROM v_pr),
v_cost AS (SELECT *, drive_s + distance_s + toll_s AS cost_s FROM v_price)
"""
_TERMS = ("drive_s", "distance_s", "toll_s")


def _covered(spark, sf_dir):
    return audits.covered_segments(_route_segments(spark, sf_dir).withColumnRenamed("route_id", "line_id"), _shapes(spark, sf_dir))


def _priced(spark, sf_dir):
    return audits.price_lines(_covered(spark, sf_dir), road.edges(spark, sf_dir))


@query(
    f"WITH {sql.EDGE}, {_LINES} SELECT line_id, round(metres, 3) AS metres, round(uncovered_m, 3) AS uncovered_m, round(toll_m, 3) AS toll_m, round(drive_s, 3) AS drive_s, "
    "round(distance_s, 3) AS distance_s, round(toll_s, 3) AS toll_s, round(cost_s, 3) AS cost_s FROM v_cost"
)
def line_prices(spark, sf_dir):
    """Each row of the lattice, as a line drawn by someone else, priced under the objective."""
    p = _priced(spark, sf_dir)
    return p.select("line_id", *[F.round(c, 3).alias(c) for c in ("metres", "uncovered_m", "toll_m", *_TERMS, "cost_s")])


@query(
    f"WITH {sql.EDGE}, {_LINES}, s AS (SELECT line_id, name, class_rank, sum(metres) AS m FROM v_cov WHERE edge_id IS NOT NULL GROUP BY ALL) "
    "SELECT line_id, name, class_rank, round(m, 3) AS metres, row_number() OVER (PARTITION BY line_id ORDER BY round(m, 6) DESC, name, class_rank) AS rank FROM s QUALIFY rank <= 8"
)
def line_roads(spark, sf_dir):
    """The eight roads that make up most of each line."""
    n = audits.named_roads(_covered(spark, sf_dir), road.edges(spark, sf_dir))
    return n.select("line_id", "name", "class_rank", F.round("metres", 3).alias("metres"), F.col("rank").cast("long").alias("rank"))


@query(
    f"WITH {sql.EDGE}, {_LINES}, t AS (" + " UNION ALL ".join(f"SELECT line_id, '{t}' AS term, {t} AS x FROM v_cost" for t in _TERMS) + ") "
    "SELECT a.line_id, a.term, round(a.x, 3) AS ours, round(b.x, 3) AS theirs, round(round(b.x, 3) - round(a.x, 3), 3) AS gap FROM t a JOIN t b ON b.line_id = a.line_id + 1 AND a.term = b.term"
)
def line_terms(spark, sf_dir):
    """Each line against its northern neighbour, term by term."""
    p = _priced(spark, sf_dir).select("line_id", *[F.round(t, 3).alias(t) for t in _TERMS])
    theirs = p.withColumn("line_id", F.col("line_id") - 1)
    c = audits.compare_terms(p, theirs, "line_id", _TERMS)
    return c.select("line_id", "term", *[F.round(x, 3).alias(x) for x in ("ours", "theirs", "gap")])


@query(
    f"WITH {sql.EDGE}, {_LINES} SELECT a.line_id, CASE WHEN a.uncovered_m > 200 AND a.line_id % 3 > 0 THEN 'OUTSIDE AREA' WHEN a.uncovered_m > 200 THEN 'GRAPH' WHEN b.cost_s IS NULL THEN 'UNDECIDED' "
    "WHEN a.cost_s < b.cost_s - greatest(60.0::DOUBLE, abs(a.drive_s - b.drive_s) / 20 * 2) THEN 'ROUTER' WHEN a.cost_s < b.cost_s THEN 'TOO CLOSE TO CALL' ELSE 'COST MODEL' END AS verdict "
    "FROM v_cost a LEFT JOIN v_cost b ON b.line_id = a.line_id + 1"
)
def divergence_verdicts(spark, sf_dir):
    """Why each line differs from its northern neighbour, taken for our own route."""
    p = _priced(spark, sf_dir)
    ours = p.select((F.col("line_id") - 1).alias("line_id"), F.col("cost_s").alias("ours_s"), F.col("drive_s").alias("ours_drive_s"))
    j = p.join(ours, "line_id", "left")
    verdict = audits.divergence_verdict(F.col("uncovered_m"), F.col("line_id") % 3, F.col("ours_s"), F.col("cost_s"), F.abs(F.col("drive_s") - F.col("ours_drive_s")) / 20)
    return j.select("line_id", verdict.alias("verdict"))


# --- tolls and interchanges -------------------------------------------------------------------------------------


@query(
    f"WITH {sql.EDGE}, {_GATED}, r AS (SELECT query_id, ['verified', 'approximated', 'unpriced'][max(unsure)] AS confidence, sum(metres) AS m FROM v_g7 GROUP BY query_id HAVING sum(metres) > 0), "
    "x AS (SELECT 'road_km' AS kind, toll_road::VARCHAR AS label, sum(metres) / 1000 AS amount FROM v_g7 GROUP BY ALL UNION ALL SELECT 'confidence', confidence, count(*) FROM r GROUP BY ALL "
    "UNION ALL SELECT 'display', CASE WHEN confidence = 'verified' THEN 'exact' ELSE 'estimated' END, count(*) FROM r GROUP BY ALL) SELECT kind, label, round(amount, 3) AS amount FROM x"
)
def toll_usage(spark, sf_dir):
    """Kilometres by toll road, and routes with tolls by how sure their fare is."""
    runs = _gated_runs(spark, sf_dir)
    return audits.toll_usage(runs, tolls.route_tolls(runs)).withColumn("amount", F.round("amount", 3))


_ATTACH = "v_at AS (SELECT class_rank * 100000 + edge_from // 40 AS road, (lon1 - 77.4) * 97.9 AS km FROM v_edge)"
_STARTS = (
    f"{_ATTACH}, v_cl(road, start) AS (SELECT road, min(km) FROM v_at GROUP BY road UNION ALL SELECT c.road, min(km) FROM v_cl c JOIN v_at a ON a.road = c.road WHERE km - start >= 2 GROUP BY c.road)"
)


def _interchanges(spark, sf_dir):
    e = road.edges(spark, sf_dir)
    attached = e.select((F.col("class_rank") * 100000 + F.floor(F.col("edge_from") / 40)).alias("road"), ((F.col("lon1") - 77.4) * 97.9).alias("km"))
    return audits.clusters(attached, "road", "km")


@query(
    f"WITH RECURSIVE {sql.EDGE}, {_STARTS}, p AS (SELECT a.road, a.km, max(start) AS start FROM v_at a JOIN v_cl c ON c.road = a.road AND start <= km GROUP BY ALL), "
    "n AS (SELECT road, km, count(*) AS held FROM v_at GROUP BY ALL) SELECT road, round(start, 6) AS start, sum(held)::BIGINT AS held FROM p JOIN n USING (road, km) GROUP BY road, start"
)
def interchanges(spark, sf_dir):
    """Places where other roads attach, as interchanges: clusters along each road."""
    return _interchanges(spark, sf_dir).withColumn("start", F.round("start", 6))


@query(
    f"WITH RECURSIVE {sql.EDGE}, {_STARTS}, h AS (SELECT road // 100000 AS class_rank, floor(start * 1000 + 0.5) / 1000 AS km, count(*) AS held FROM v_cl GROUP BY ALL), "
    f"g AS (SELECT class_rank, a / 1000 AS anchor, held, least(3, list_min(list_transform({list(PLAZA_KM)}::DOUBLE[], lambda p: abs(p - (a / 1000 - km))))) AS off FROM h, range(125000, 150001) r(a)), "
    "t AS (SELECT class_rank, anchor, round(sum(held * off * off), 6) AS total FROM g GROUP BY ALL) "
    "SELECT class_rank, anchor, round(total, 4) AS total FROM t QUALIFY row_number() OVER (PARTITION BY class_rank ORDER BY t.total, anchor) = 1"
)
def chainage_fit(spark, sf_dir):
    """The anchor at which the plazas lie nearest to the interchanges of each class."""
    found = _interchanges(spark, sf_dir).select(F.floor(F.col("road") / 100000).alias("class_rank"), F.col("start").alias("km"))
    return audits.fit_anchor(found, "class_rank", "km").withColumn("total", F.round("total", 4))


@query(
    f"WITH RECURSIVE {sql.EDGE}, {_STARTS}, v AS (SELECT road, start, 140 - start * 30 AS predicted FROM v_cl), x AS (SELECT road, start, predicted, unnest({list(PLAZA_KM)}::DOUBLE[]) AS plaza FROM v), "
    "b AS (SELECT *, row_number() OVER (PARTITION BY road, start ORDER BY abs(plaza - predicted), plaza) AS n FROM x) "
    "SELECT road, round(start, 6) AS start, CASE WHEN abs(plaza - predicted) <= 3 THEN plaza END AS plaza_km, round(plaza - predicted, 6) AS residual FROM b WHERE n = 1"
)
def plaza_assignment(spark, sf_dir):
    """The plaza nearest to each interchange's predicted chainage, within the cap."""
    near = audits.nearest_value(140 - F.col("start") * 30, PLAZA_KM, 3.0)
    return _interchanges(spark, sf_dir).withColumn("n", near).select("road", F.round("start", 6).alias("start"), F.col("n.value").alias("plaza_km"), F.round("n.residual", 6).alias("residual"))


@query(
    f"WITH {RAW}, j AS (SELECT node_id, 'road ' || way_id % 50 AS road_name, way_id % 8 AS class_rank FROM v_way WHERE node_id % 5 = 0) "
    "SELECT node_id, array_to_string(list_sort(list(DISTINCT road_name)), ',') AS roads, array_to_string(list_sort(list(DISTINCT class_rank)), ',') AS classes FROM j GROUP BY node_id"
)
def gate_roads(spark, sf_dir):
    """The roads and classes that each gate sits on."""
    w = _way_nodes(spark, sf_dir)
    g = audits.gates_on_roads(w.filter("node_id % 5 = 0").select("node_id"), w, _called_ways(w))
    return g.select("node_id", F.concat_ws(",", "roads").alias("roads"), F.concat_ws(",", F.col("classes").cast("array<string>")).alias("classes"))


def _called_ways(way_nodes):
    k = F.col("way_id")
    return way_nodes.select("way_id").distinct().select("way_id", F.concat(F.lit("road "), (k % 50).cast("string")).alias("road_name"), (k % 8).alias("class_rank"))


@query(
    f"WITH {RAW}, {NODES}, n AS (SELECT way_id, node_id, {sql.haversine('28.12::DOUBLE', '77.42::DOUBLE', 'lat_e7 / 1e7', 'lon_e7 / 1e7')} AS d FROM v_way JOIN v_node USING (node_id)) "
    "SELECT 'road ' || way_id % 50 AS road_name, way_id % 8 AS class_rank, round(min(d), 3) AS distance_m FROM n "
    "WHERE d <= 2000 AND way_id % 100 > 0 AND node_id IN (SELECT node_id FROM n WHERE way_id % 100 = 0) GROUP BY ALL"
)
def meeting_roads(spark, sf_dir):
    """Roads that meet a mainline near the end of a stretch."""
    w = _way_nodes(spark, sf_dir)
    placed = w.join(road.vertices(spark, sf_dir).select(F.col("vertex_id").alias("node_id"), "lat", "lon"), "node_id")
    mainline = w.filter("way_id % 100 = 0").select("way_id").distinct()
    return audits.meeting_roads(mainline, placed, _called_ways(w), 28.12, 77.42, 2000.0).withColumn("distance_m", F.round("distance_m", 3))


@query(
    f"WITH {sql.EDGE}, s AS (SELECT edge_from // 20 AS query_id, row_number() OVER (PARTITION BY edge_from // 20 ORDER BY edge_id) AS i, edge_id FROM v_edge), "
    "o AS (SELECT *, (i // 7) % 3 = 1 AS on_road FROM s), f AS (SELECT *, on_road AND NOT coalesce(lag(on_road) OVER (PARTITION BY query_id ORDER BY i), false) AS fresh FROM o) "
    "SELECT query_id, arg_min(edge_id, i) AS first_edge, arg_max(edge_id, i) AS last_edge, count(*) FILTER (fresh) AS stretches FROM f WHERE on_road GROUP BY query_id"
)
def joins_and_leaves(spark, sf_dir):
    """Where routes join and leave a road, and on how many stretches."""
    s = road.edges(spark, sf_dir).withColumn("query_id", F.floor(F.col("edge_from") / 20))
    s = s.withColumn("i", F.row_number().over(W.partitionBy("query_id").orderBy("edge_id")))
    return audits.joins_and_leaves(s.select("query_id", "i", "edge_id"), F.floor(F.col("i") / 7) % 3 == 1)


@query(
    f"WITH o AS ({ORACLES['opposing_roads']}), {sql.EDGE}, d AS (SELECT class_rank, list_sort(list(distance_m)) AS l, count(*) AS n, count(*) FILTER (distance_m <= 40) AS near FROM o JOIN v_edge USING (edge_id) GROUP BY class_rank) "
    "SELECT class_rank, " + ", ".join(f"l[least(n - 1, floor({q / 100}::DOUBLE * n))::INT + 1] AS q{q}" for q in (5, 50, 95)) + ", n, round(near / n, 6) AS share FROM d"
)
def opposing_exposure(spark, sf_dir):
    """How near the opposing road is, by class, and how often near enough to be taken for one's own."""
    d = opposing_roads(spark, sf_dir).join(road.edges(spark, sf_dir).select("edge_id", "class_rank"), "edge_id")
    return audits.exposure(d, "class_rank", "distance_m", 40.0).withColumn("share", F.round("share", 6))


@query(f"WITH {sql.EDGE} SELECT speed_kmh, count(*) AS edges, max(max(speed_kmh)) OVER () AS fastest FROM v_edge GROUP BY speed_kmh ORDER BY edges DESC, speed_kmh LIMIT 4")
def commonest_speeds(spark, sf_dir):
    """The four commonest speeds, and the fastest."""
    e = road.edges(spark, sf_dir).groupBy("speed_kmh").agg(F.count(F.lit(1)).alias("edges"))  # a row a speed
    return e.withColumn("fastest", F.max("speed_kmh").over(W.partitionBy(F.lit(0)))).orderBy(F.desc("edges"), "speed_kmh").limit(4)


# --- places, layers and what is shown ---------------------------------------------------------------------------


@query(
    f"WITH {sql.PLACE}, p AS (SELECT *, {sql.lat('place_id')} BETWEEN 281000000 AND 281200000 AND {sql.lon('place_id')} BETWEEN 774000000 AND 774250000 AS inside FROM v_place) "
    "SELECT count(*) FILTER (inside) AS total, count(*) FILTER (NOT inside) AS skipped, count(*) FILTER (inside AND importance >= 40) AS settlements, "
    "count(*) FILTER (inside AND regexp_matches(name, '[ऀ-ॿ]')) AS devanagari, count(DISTINCT CASE WHEN inside THEN trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) END) AS names FROM p"
)
def place_stats(spark, sf_dir):
    """What the build of places keeps and leaves out."""
    k = F.col("place_id")
    p = road.places(spark, sf_dir).withColumn("inside", geo.in_area(road.lattice_lat(k), road.lattice_lon(k), _BOX))
    norm = F.trim(F.regexp_replace(F.lower("name"), "[^a-z0-9]+", " "))
    return p.agg(
        F.count_if("inside").alias("total"), F.count_if(~F.col("inside")).alias("skipped"), F.count_if(F.col("inside") & (F.col("importance") >= 40)).alias("settlements"),
        F.count_if(F.col("inside") & strings.has_devanagari(F.col("name"))).alias("devanagari"), F.countDistinct(F.when(F.col("inside"), norm)).alias("names"),
    )


_KINDS = {"place": (4, ("city", "town", "island", "village")), "amenity": (3, ("hospital", "bench", "cafe")), "shop": (5, ("bakery", "")), "healthcare": (9, ("clinic",)), "tourism": (7, ("museum", "hotel"))}
_NODE = "v_nd AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS name, " + ", ".join(f"nullif(CASE WHEN p_partkey % {m} = 0 THEN {list(v)}[(p_partkey // {m}) % {len(v)} + 1] END, '') AS {t}" for t, (m, v) in _KINDS.items()) + " FROM part)"
_BY_PLACE = " ".join(f"WHEN '{p}' THEN {{}}[{i + 1}]" for i, p in enumerate(PLACE_ZOOM))


@query(
    f"WITH {_NODE}, z AS (SELECT *, CASE place {_BY_PLACE.format(*[list(PLACE_ZOOM.values())] * len(PLACE_ZOOM))} END AS zoom, CASE place {_BY_PLACE.format(*[list(PLACE_ORDER.values())] * len(PLACE_ZOOM))} END AS rk, "
    f"coalesce(CASE WHEN amenity IN {POI_AMENITIES} THEN amenity END, CASE WHEN shop IS NOT NULL THEN 'shop' END, healthcare, tourism) AS poi FROM v_nd) "
    "SELECT k AS node_id, CASE WHEN zoom IS NOT NULL THEN 'place' ELSE 'poi' END AS layer, CASE WHEN zoom IS NOT NULL THEN place ELSE poi END AS class, rk AS rank, coalesce(zoom, 14) AS min_zoom "
    "FROM z WHERE zoom IS NOT NULL OR (poi IS NOT NULL AND name IS NOT NULL)"
)
def node_layers(spark, sf_dir):
    """Tagged nodes in the layers of the tiles."""
    k = F.col("p_partkey")
    pairs = [F.struct(F.lit("name").alias("key"), F.when(k % 2 == 0, F.col("p_name")).alias("value"))]
    for t, (m, values) in _KINDS.items():
        value = F.element_at(F.array(*map(F.lit, values)), (F.floor(k / m) % len(values) + 1).cast("int"))
        pairs.append(F.struct(F.lit(t).alias("key"), F.when(k % m == 0, value).alias("value")))
    tags = F.map_from_entries(F.filter(F.array(*pairs), lambda x: x["value"].isNotNull()))
    n = road.read(spark, sf_dir, "part").select(k.alias("node_id"), tags.alias("tags")).withColumn("l", display.node_layer())
    return n.filter("l is not null").select("node_id", "l.layer", "l.class", "l.rank", "l.min_zoom")


@query(
    "WITH c AS (SELECT unicode(unnest(string_split(text, ''))) AS cp FROM documents), n AS (SELECT cp, count(*) AS uses FROM c GROUP BY cp), "
    "s AS (SELECT *, CASE WHEN cp <= 591 OR cp BETWEEN 8192 AND 8303 THEN 'Latin and common' WHEN cp BETWEEN 2304 AND 2431 THEN 'Devanagari' WHEN cp BETWEEN 1536 AND 1791 OR cp BETWEEN 1872 AND 1919 THEN 'Arabic (Urdu)' ELSE 'unsupported' END AS script FROM n WHERE cp > 0) "
    "SELECT script, count(*) AS code_points, sum(uses)::BIGINT AS uses FROM s GROUP BY script"
)
def script_census(spark, sf_dir):
    """Characters of all texts by the script they belong to. Counted by character first, so few rows are shuffled."""
    chars = road.read(spark, sf_dir, "documents").select(F.explode(F.split("text", "")).alias("ch")).filter("ch <> ''")
    held = chars.groupBy("ch").agg(F.count(F.lit(1)).alias("uses")).withColumn("script", F.coalesce(display.script_of(F.ascii("ch")), F.lit("unsupported")))
    return held.groupBy("script").agg(F.count(F.lit(1)).alias("code_points"), F.sum("uses").alias("uses"))


@query(
    f"WITH {sql.EDGE}, m AS (SELECT length_m * 9 AS m FROM v_edge) SELECT CASE WHEN m < 100 THEN floor(m / 10 + 0.5) * 10 WHEN m < 1000 THEN floor(m / 50 + 0.5) * 50 ELSE floor(m / 100 + 0.5) * 100 END::BIGINT AS shown, "
    "count(*) AS edges FROM m GROUP BY ALL"
)
def banner_distances(spark, sf_dir):
    shown_m = display.banner_metres(F.col("length_m") * 9).cast("long")
    return road.edges(spark, sf_dir).groupBy(shown_m.alias("shown")).agg(F.count(F.lit(1)).alias("edges"))


@query(
    f"WITH {sql.EDGE}, {sql.FIX}, {sql.near(SNAP_M)}, b AS (SELECT fix_id, min(distance_m) AS d FROM v_near GROUP BY fix_id) "
    "SELECT fix_id, CASE WHEN d >= 20 THEN floor(d * 10 + 0.5) / 10 END AS gap_m FROM b"
)
def approach_gaps(spark, sf_dir):
    """The gap between a place asked for and the road, where it is long enough to show."""
    best = spatial.nearest(road.fixes(spark, sf_dir).select("fix_id", "lat", "lon"), _shapes(spark, sf_dir), SNAP_M, "fix_id", "edge_id")
    return best.select("fix_id", display.approach_gap(F.col("distance_m")).alias("gap_m"))


@query(
    f"WITH {sql.FIX}, w AS (SELECT *, epoch_us(ts) // 1000 AS t FROM v_fix QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY epoch_us(ts) // 1000 DESC, fix_id DESC) <= 12) "
    "SELECT fix_id, CASE WHEN fix_id % 17 = 0 THEN 'INVALID_PARAMETER' WHEN NOT (lat BETWEEN 28.1 AND 28.12 AND lon BETWEEN 77.4 AND 77.425) THEN 'OUTSIDE_BUILD_AREA' END AS error_code, "
    "CASE WHEN fix_id % 7 = 0 THEN 40.0 ELSE accuracy_m END::DOUBLE AS accuracy_m, CASE WHEN fix_id % 11 > 0 THEN heading_deg END AS heading_deg, speed_mps, CASE WHEN fix_id % 13 = 0 THEN 0 ELSE t END AS t_ms FROM w"
)
def fix_windows(spark, sf_dir):
    """The last twelve fixes of each device as the matcher takes them from a client, with what is missing filled in."""
    k, nan = F.col("fix_id"), F.lit(float("nan"))
    f = road.fixes(spark, sf_dir).withColumn("t", F.unix_millis(F.col("ts").cast("timestamp")))
    f = f.withColumn("n", F.row_number().over(W.partitionBy("device_id").orderBy(F.desc("t"), F.desc("fix_id")))).filter("n <= 12")
    inside = geo.in_area_deg(F.col("lat"), F.col("lon"), _BOX)
    sent = display.clean_fix(
        F.when(k % 17 == 0, nan).otherwise(F.col("lat")), F.col("lon"), F.when(k % 7 > 0, F.col("accuracy_m")), F.when(k % 11 == 0, nan).otherwise(F.col("heading_deg")), F.col("speed_mps"),
        F.when(k % 13 > 0, F.col("t")), inside,
    )
    return f.withColumn("c", sent).select("fix_id", "c.*")


_SHOWN = (
    f"{sql.FIX}, f AS (SELECT device_id, fix_id, epoch_us(ts) // 1000 // 20000000 * 300 AS t_ms, fix_id % 10 = 0 AS on_route, (fix_id * 131 % 5000) * 0.02::DOUBLE AS remaining_s, (fix_id % 4 = 0)::INT AS pt, "
    "28.1::DOUBLE + (fix_id * 37 % 7) * 0.00001::DOUBLE AS la, 77.4::DOUBLE AS lo, row_number() OVER (PARTITION BY device_id ORDER BY epoch_us(ts) // 1000 // 20000000, fix_id) AS rn FROM v_fix)"
)


def _shown(spark, sf_dir):
    k = F.col("fix_id")
    t = F.floor(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000) / 20000000) * 300
    return road.fixes(spark, sf_dir).select(
        "device_id", "fix_id", t.alias("t_ms"), (k % 10 == 0).alias("on_route"), ((k * 131 % 5000) * F.lit(0.02)).alias("remaining_s"), (k % 4 == 0).cast("int").alias("at"),
        (F.lit(28.1) + (k * 37 % 7) * F.lit(0.00001)).alias("lat"), F.lit(77.4).alias("lon"),
    )


_DUE = "NOT f.on_route AND f.t_ms - {0} >= 1000"


@query(
    f"WITH RECURSIVE {_SHOWN}, r AS (SELECT device_id, fix_id, rn, {_DUE.format(0)} AS call, CASE WHEN {_DUE.format(0)} THEN t_ms ELSE 0 END AS last FROM f WHERE rn = 1 "
    f"UNION ALL SELECT f.device_id, f.fix_id, f.rn, {_DUE.format('r.last')}, CASE WHEN {_DUE.format('r.last')} THEN f.t_ms ELSE r.last END FROM r JOIN f ON f.device_id = r.device_id AND f.rn = r.rn + 1) SELECT device_id, fix_id, call FROM r"
)
def match_calls(spark, sf_dir):
    """Fixes at which a window is sent for matching: at most one a second of the fixes' own time."""
    return shown.match_calls(_shown(spark, sf_dir)).select("device_id", "fix_id", "call")


_MOVES = "f.t_ms - r.last >= 1000 AND abs(f.remaining_s - r.shown_s) >= 30"


@query(
    f"WITH RECURSIVE {_SHOWN}, r AS (SELECT device_id, fix_id, rn, t_ms AS last, remaining_s AS shown_s FROM f WHERE rn = 1 "
    f"UNION ALL SELECT f.device_id, f.fix_id, f.rn, CASE WHEN {_MOVES} THEN f.t_ms ELSE r.last END, CASE WHEN {_MOVES} THEN f.remaining_s ELSE r.shown_s END FROM r JOIN f ON f.device_id = r.device_id AND f.rn = r.rn + 1) "
    "SELECT device_id, fix_id, round(shown_s, 4) AS shown_s FROM r"
)
def shown_arrival(spark, sf_dir):
    """Remaining time as the screen has it."""
    return shown.shown_arrival(_shown(spark, sf_dir)).select("device_id", "fix_id", F.round("shown_s", 4).alias("shown_s"))


_AGAIN = f"(f.pt <> r.pt OR {sql.haversine('r.la', 'r.lo', 'f.la', 'f.lo')} > 3)"


@query(
    f"WITH RECURSIVE {_SHOWN}, r AS (SELECT device_id, fix_id, rn, true AS redraw, pt, la, lo FROM f WHERE rn = 1 UNION ALL SELECT f.device_id, f.fix_id, f.rn, {_AGAIN}, CASE WHEN {_AGAIN} THEN f.pt ELSE r.pt END, "
    f"CASE WHEN {_AGAIN} THEN f.la ELSE r.la END, CASE WHEN {_AGAIN} THEN f.lo ELSE r.lo END FROM r JOIN f ON f.device_id = r.device_id AND f.rn = r.rn + 1) SELECT device_id, fix_id, redraw FROM r"
)
def redraws(spark, sf_dir):
    """Fixes at which the driven line is drawn anew."""
    return shown.redraws(_shown(spark, sf_dir)).select("device_id", "fix_id", "redraw")
