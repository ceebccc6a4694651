"""Registered queries over lines of several points, headings of exits and nearest places, and their SQL twins.

The given edges are straight; here each is bent at its middle, 0.0002 degrees to the north, in either direction alike.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from waygrid.config import M_PER_DEG_LAT, M_PER_DEG_LON, MATCH_M
from waygrid.functions import lines
from waygrid.operators import audits, graph, instructions, restrictions, routing, scenarios, spatial, states
from waygrid.plans import sql
from waygrid.plans.catalog import _ALL_KINDS, ORACLES, _bans, _places_on_edges, _shapes, _triples, query
from waygrid.sources import projection as road

BEND = 0.0002


def _points(a: str, b: str):
    """The line between two ends, by their columns."""
    return F.expr(f"array(struct({a[0]} AS lat, {a[1]} AS lon), struct(({a[0]} + {b[0]}) / 2 + {BEND}D AS lat, ({a[1]} + {b[1]}) / 2 AS lon), struct({b[0]} AS lat, {b[1]} AS lon))")


def bent_edges(edges):
    return edges.select("edge_id", _points(("lat1", "lon1"), ("lat2", "lon2")).alias("points"))


def _flat(a1: str, o1: str, a2: str, o2: str) -> str:
    """flat_metres as SQL."""
    return f"sqrt(pow(({o2} - {o1}) * {M_PER_DEG_LON} * cos(radians(({a1} + {a2}) / 2)), 2) + pow(({a2} - {a1}) * {M_PER_DEG_LAT}, 2))"


_MIDDLE = f"(alat + blat) / 2 + {BEND} AS mlat, (alon + blon) / 2 AS mlon"
_PIECE = f"""
v_ml AS (SELECT *, {_MIDDLE} FROM v_seg),
v_bl AS (SELECT *, {_flat("alat", "alon", "mlat", "mlon")} AS first_m, {_flat("mlat", "mlon", "blat", "blon")} AS second_m FROM v_ml),
v_piece AS (
  SELECT edge_id, 0 AS seq, first_m, second_m, alat, alon, mlat AS blat, mlon AS blon FROM v_bl
  UNION ALL
  SELECT edge_id, 1, first_m, second_m, mlat, mlon, blat, blon FROM v_bl)
"""
_NEAR_PIECE = sql.near(MATCH_M).replace("JOIN v_seg s", "JOIN v_piece s").replace("SELECT fix_id, edge_id, shape_id,", "SELECT fix_id, edge_id, seq, first_m, second_m,")


@query(f"""
WITH {sql.EDGE}, {sql.FIX}, {_PIECE}, {_NEAR_PIECE},
v_best AS (SELECT * FROM v_near QUALIFY row_number() OVER (PARTITION BY fix_id ORDER BY distance_m, edge_id * 2 + seq) = 1)
SELECT fix_id, edge_id, seq, round(distance_m, 4) AS distance_m,
  round(CASE WHEN seq = 0 THEN t * first_m ELSE first_m + t * second_m END / (first_m + second_m), 6) AS share
FROM v_best
""")
def snap_shares(spark, sf_dir):
    """The nearest piece of a bent line to each fix, and the share of the whole line that lies before its foot."""
    shapes = _shapes(spark, sf_dir).select("edge_id", _points(("alat", "alon"), ("blat", "blon")).alias("points"))
    parts = lines.pieces(shapes, "edge_id").withColumn("piece", F.col("edge_id") * 2 + F.col("seq"))
    best = spatial.nearest(road.fixes(spark, sf_dir).select("fix_id", "lat", "lon"), parts.drop("edge_id", "seq"), MATCH_M, "fix_id", "piece")
    best = best.select("fix_id", F.floor(F.col("piece") / 2).alias("edge_id"), (F.col("piece") % 2).cast("int").alias("seq"), "t", "distance_m")
    share = lines.share_along(F.col("points"), F.col("seq"), F.col("t"), F.lit(False))
    return best.join(shapes, "edge_id").select("fix_id", "edge_id", "seq", F.round("distance_m", 4).alias("distance_m"), F.round(share, 6).alias("share"))


_WALKS = f"""
v_leg AS (SELECT edge_from // 20 AS query_id, edge_id, length_m, {_flat("lat1", "lon1", "mlat", "mlon")} AS first_m, {_flat("mlat", "mlon", "lat2", "lon2")} AS second_m
  FROM (SELECT *, (lat1 + lat2) / 2 + {BEND} AS mlat, (lon1 + lon2) / 2 AS mlon FROM v_edge)),
v_k AS (SELECT *, row_number() OVER w - 1 AS k, sum(first_m + second_m) OVER w AS end_m, sum(length_m) OVER w AS run0,
  sum(first_m + second_m) OVER (PARTITION BY query_id) AS line_m, sum(length_m) OVER (PARTITION BY query_id) AS edges_m
  FROM v_leg WINDOW w AS (PARTITION BY query_id ORDER BY edge_id)),
v_pt AS (SELECT query_id, 0 AS j, 0.0::DOUBLE AS cum_m FROM v_k WHERE k = 0
  UNION ALL SELECT query_id, 2 * k + 1, end_m - second_m FROM v_k
  UNION ALL SELECT query_id, 2 * k + 2, end_m FROM v_k)
"""


@query(f"""
WITH {sql.EDGE}, {_WALKS},
v_off AS (SELECT w.query_id, k, j, abs(cum_m - run0 * (line_m / edges_m)) AS off_m FROM v_k w JOIN v_pt p ON w.query_id = p.query_id)
SELECT query_id, k, j, round(off_m, 3) AS off_m FROM v_off QUALIFY row_number() OVER (PARTITION BY query_id, k ORDER BY round(off_m, 7), j) = 1
""")
def junction_places(spark, sf_dir):
    """Where edges end on the line that they make together, found by running lengths that are scaled to the line's."""
    e = road.edges(spark, sf_dir)
    legs = e.join(bent_edges(e), "edge_id").select((F.floor(F.col("edge_from") / 20)).alias("query_id"), "edge_id", "length_m", lines.prefix_metres(F.col("points")).alias("reached"))
    w = W.partitionBy("query_id").orderBy("edge_id")
    whole = F.element_at("reached", -1)
    legs = legs.withColumns({"k": F.row_number().over(w) - 1, "end_m": F.sum(whole).over(w), "run": F.sum("length_m").over(w), "line_m": F.sum(whole).over(W.partitionBy("query_id")), "edges_m": F.sum("length_m").over(W.partitionBy("query_id"))})
    behind = legs.select("query_id", F.explode(F.array(F.struct((2 * F.col("k") + 1).alias("j"), (F.col("end_m") - whole + F.get("reached", F.lit(1))).alias("cum_m")), F.struct((2 * F.col("k") + 2).alias("j"), F.col("end_m").alias("cum_m")))).alias("p"))
    points = behind.select("query_id", "p.j", "p.cum_m").unionByName(legs.filter("k = 0").select("query_id", F.lit(0).alias("j"), F.lit(0.0).alias("cum_m")))
    wanted = legs.select("query_id", "k", (F.col("run") * (F.col("line_m") / F.col("edges_m"))).alias("run_m"))
    return lines.nearest_places(points, wanted).select("query_id", "k", "j", F.round("off_m", 3).alias("off_m"))


_BENT_TURN = f"""
v_mb AS (SELECT *, (lat1 + lat2) / 2 + {BEND} AS mlat, (lon1 + lon2) / 2 AS mlon FROM v_edge),
v_b AS (SELECT edge_id, edge_from, edge_to, shape_id, reversed, class_rank, {sql.bearing("mlat", "mlon", "lat2", "lon2")} AS arrives, {sql.bearing("lat1", "lon1", "mlat", "mlon")} AS departs FROM v_mb),
v_t0 AS (SELECT a.class_rank, a.shape_id = b.shape_id AND a.reversed <> b.reversed AS is_uturn, fmod(b.departs - a.arrives, 360) AS d0 FROM v_b a JOIN v_b b ON a.edge_to = b.edge_from),
v_t1 AS (SELECT *, CASE WHEN d0 > 180 THEN d0 - 360 WHEN d0 <= -180 THEN d0 + 360 ELSE d0 END AS d FROM v_t0)
"""


@query(f"""
WITH {sql.EDGE}, {_BENT_TURN}
SELECT class_rank, count(*) AS turns, count(*) FILTER (is_uturn) AS uturns, round(sum(abs(d)) / count(*), 4) AS mean_deg, count(*) FILTER (abs(d) > 25 AND NOT is_uturn) AS sharp FROM v_t1 GROUP BY class_rank
""")
def bent_turns(spark, sf_dir):
    """Turns between bent edges by class: bearings are those of the ground next to the junction, not of the whole edge."""
    e = road.edges(spark, sf_dir)
    turns = graph._turns(e, bent_edges(e))
    size = F.abs("delta")
    return turns.groupBy(F.col("class_rank_in").alias("class_rank")).agg(
        F.count(F.lit(1)).alias("turns"), F.count_if("is_uturn").alias("uturns"), F.round(F.sum(size) / F.count(F.lit(1)), 4).alias("mean_deg"), F.count_if((size > 25) & ~F.col("is_uturn")).alias("sharp"),
    )


_HEADING = "fmod(degrees(atan2((lon2 - lon1) * cos(radians(lat1)), lat2 - lat1)) + 360, 360)"


@query(f"""
WITH RECURSIVE {sql.EDGE},
v_exit AS (SELECT * FROM v_edge WHERE NOT roundabout AND edge_from IN (SELECT edge_to FROM v_edge WHERE roundabout)),
v_on AS (SELECT a.edge_id AS cur, b.edge_id AS nxt, b.lat2, b.lon2, b.length_m FROM v_edge a JOIN v_edge b ON a.edge_to = b.edge_from AND b.edge_to <> a.edge_from
  QUALIFY row_number() OVER (PARTITION BY a.edge_id ORDER BY b.length_m DESC, b.edge_id) = 1),
v_walk(edge_id, lat1, lon1, cur, lat2, lon2, gone_m, k) AS (
  SELECT edge_id, lat1, lon1, edge_id, lat2, lon2, length_m, 0 FROM v_exit
  UNION ALL
  SELECT w.edge_id, w.lat1, w.lon1, o.nxt, o.lat2, o.lon2, w.gone_m + o.length_m, k + 1 FROM v_walk w JOIN v_on o ON w.cur = o.cur
  WHERE w.gone_m < {instructions.EXIT_WALK_M} AND k < {instructions.EXIT_WALK_EDGES})
SELECT edge_id, round({_HEADING}, 6) AS heading FROM v_walk QUALIFY row_number() OVER (PARTITION BY edge_id ORDER BY k DESC) = 1
""")
def exit_headings(spark, sf_dir):
    """Where the roads head that leave roundabouts, after the first 120 m."""
    e = road.edges(spark, sf_dir)
    exits = e.filter("not roundabout").join(e.filter("roundabout").select(F.col("edge_to").alias("edge_from")).distinct(), "edge_from", "left_semi")
    return instructions.exit_headings(e, exits).select("edge_id", F.round("heading", 6).alias("heading"))


@query()
def bent_instructions(spark, sf_dir):
    """What a driver is told between places on bent edges: bearings over 30 m of the route's own line."""
    edges = graph.costs(road.edges(spark, sf_dir))
    found = routing.point_routes(_places_on_edges(spark, sf_dir, edges), edges, graph.turn_costs(edges, shapes=bent_edges(edges)), _bans(edges), _triples(edges))
    told = instructions.build(instructions.route_steps(found, edges, bent_edges(edges)))
    return told.select("query_id", "n", "i", "kind", "name", "exit_number", F.round("distance_m", 4).alias("distance_m"), F.round("duration_s", 4).alias("duration_s"))


# --- nearest places however far ---------------------------------------------------------------------------------

#: Every seventh part stands for a toll booth, every fifth for a place to look from.
_BOOTH = "v_booth AS (SELECT place_id AS booth, lat AS olat, lon AS olon FROM v_place WHERE place_id % 7 = 0)"


def _booths(spark, sf_dir):
    return road.places(spark, sf_dir).filter("place_id % 7 = 0").select(F.col("place_id").alias("booth"), F.col("lat").alias("olat"), F.col("lon").alias("olon"))


@query(f"""
WITH {sql.EDGE}, {sql.PLACE}, {_BOOTH},
v_d AS (SELECT place_id, booth, {sql.haversine("lat", "lon", "olat", "olon")} AS d FROM v_place, v_booth)
SELECT place_id, booth, round(d, 4) AS distance_m, row_number() OVER (PARTITION BY place_id ORDER BY d, booth) AS rank FROM v_d
QUALIFY row_number() OVER (PARTITION BY place_id ORDER BY d, booth) <= 3
""")
def nearest_booths(spark, sf_dir):
    """The three booths nearest to each place, however far they are."""
    found = spatial.k_nearest(road.places(spark, sf_dir).select("place_id", "lat", "lon"), _booths(spark, sf_dir), 3, "place_id", "booth")
    return found.select("place_id", "booth", F.round("distance_m", 4).alias("distance_m"), F.col("rank").cast("long").alias("rank"))


@query(f"""
WITH {sql.EDGE}, {sql.PLACE}, {_BOOTH},
v_end AS (SELECT toll_road, edge_id, unnest([1, 2]) AS side, unnest([lat1, lat2]) AS lat, unnest([lon1, lon2]) AS lon FROM v_edge WHERE toll_road > 0),
v_d AS (SELECT edge_id, side, toll_road, booth, {sql.haversine("lat", "lon", "olat", "olon")} AS d FROM v_end, v_booth),
v_n AS (SELECT * FROM v_d QUALIFY row_number() OVER (PARTITION BY edge_id, side ORDER BY d, booth) = 1),
v_pair AS (SELECT a.toll_road, least(a.booth, b.booth) AS one, greatest(a.booth, b.booth) AS other, a.d + b.d AS off FROM v_n a JOIN v_n b ON a.edge_id = b.edge_id AND a.side = 1 AND b.side = 2)
SELECT toll_road, one, other, count(*) AS stretches, round(max(off), 3) AS most_m FROM v_pair GROUP BY toll_road, one, other
""")
def booth_pairs(spark, sf_dir):
    """Unordered pairs of booths that tolled stretches begin and end nearest to, by road."""
    e = road.edges(spark, sf_dir).filter("toll_road > 0")
    ends = e.select("toll_road", "edge_id", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"lat{s}").alias("lat"), F.col(f"lon{s}").alias("lon")) for s in (1, 2)])).alias("p"))
    pairs = audits.end_pairs(ends.select("toll_road", "edge_id", "p.*"), _booths(spark, sf_dir), ["toll_road", "edge_id"])
    return pairs.groupBy("toll_road", "one", "other").agg(F.count(F.lit(1)).alias("stretches"), F.round(F.max("off_m"), 3).alias("most_m"))


@query(f"""
WITH {sql.EDGE}, {sql.PLACE}, {_BOOTH},
v_toll AS (SELECT s.* FROM v_seg s JOIN (SELECT DISTINCT shape_id FROM v_edge WHERE toll_road > 0) USING (shape_id)),
{sql.near(2000).replace("f.fix_id, f.lat, f.lon", "f.booth AS fix_id, f.olat AS lat, f.olon AS lon").replace("FROM v_fix f JOIN v_seg s", "FROM v_booth f JOIN v_toll s").replace("ON lat BETWEEN", "ON f.olat BETWEEN").replace("AND lon BETWEEN", "AND f.olon BETWEEN").replace("cos(radians(lat)) AS bx", "cos(radians(f.olat)) AS bx").replace("(lon - alon) * cos(radians(lat)) AS px, lat - alat AS py", "(f.olon - alon) * cos(radians(f.olat)) AS px, f.olat - alat AS py")}
SELECT fix_id AS booth, round(min(distance_m), 4) AS distance_m, min(distance_m) <= 50 AS on_road FROM v_near GROUP BY fix_id
""")
def toll_infrastructure(spark, sf_dir):
    """Booths within 2 km of a tolled road, on it (50 m) or beside it."""
    tolled = road.edges(spark, sf_dir).filter("toll_road > 0").select("shape_id").distinct()
    shapes = _shapes(spark, sf_dir).join(tolled, "shape_id").select("edge_id", "alat", "alon", "blat", "blon")
    near = spatial.nearest(_booths(spark, sf_dir).select("booth", F.col("olat").alias("lat"), F.col("olon").alias("lon")), shapes, 2000, "booth", "edge_id")
    return near.select("booth", F.round("distance_m", 4).alias("distance_m"), (F.col("distance_m") <= 50).alias("on_road"))


# --- states of tracked devices ----------------------------------------------------------------------------------

#: Verdicts as the twin of judge_fixes gives them, with the fixes' times.
_JUDGED = ORACLES["judge_fixes"].replace("SELECT device_id, fix_id, verdict FROM r", "")


def _state_fixes(spark, sf_dir):
    """Fixes with a distance from a route and metres left of it, by their number."""
    f = road.fixes(spark, sf_dir).withColumn("t_ms", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long"))
    return f.withColumn("offset_m", (F.col("fix_id") * 31 % 40).cast("double")).withColumn("left_m", (3000 - F.col("fix_id") * 29 % 3001).cast("double"))


@query(f"""
{_JUDGED}
SELECT device_id, count(*) FILTER (verdict = 'ok') AS accepted, count(*) FILTER (verdict = 'accuracy') AS rejected_accuracy,
  count(*) FILTER (verdict = 'implied-speed') AS rejected_speed, count(*) FILTER (verdict = 'out-of-order') AS rejected_order
FROM r GROUP BY device_id
""")
def rejection_counts(spark, sf_dir):
    """What each device's last row has counted: fixes accepted, and rejected by reason."""
    rows = states.device_states(_state_fixes(spark, sf_dir)).filter("kind = 'fix'")
    counts = ["accepted", "rejected_accuracy", "rejected_speed", "rejected_order"]
    last = rows.groupBy("device_id").agg(*[F.max(c).alias(c) for c in counts])
    return last.select("device_id", *counts)


@query(f"""
{_JUDGED},
v_ok AS (SELECT r.device_id, r.fix_id, f.t_ms, lead(f.t_ms) OVER (PARTITION BY r.device_id ORDER BY f.rn) AS next_ms, max(f.t_ms) OVER (PARTITION BY r.device_id) AS last_ok
  FROM r JOIN f ON r.device_id = f.device_id AND r.rn = f.rn WHERE verdict = 'ok'),
v_end AS (SELECT device_id, max(t_ms) AS end_ms FROM f GROUP BY device_id)
SELECT device_id, t_ms + 5000 AS lost_ms FROM v_ok JOIN v_end USING (device_id) WHERE end_ms > t_ms + 5000 AND (next_ms IS NULL OR next_ms > t_ms + 5000)
""")
def signal_losses(spark, sf_dir):
    """When devices were lost: five seconds after an accepted fix that no other one followed in time."""
    return states.device_states(_state_fixes(spark, sf_dir)).filter("kind = 'lost'").select("device_id", F.col("t_ms").alias("lost_ms"))


@query(f"""
{_JUDGED},
v_s AS (SELECT device_id, r.rn, r.fix_id, r.last_t, r.acc, f.t_ms, verdict, max(CASE WHEN verdict = 'ok' THEN r.rn END) OVER (PARTITION BY device_id ORDER BY r.rn) AS ok_rn,
  max(CASE WHEN verdict = 'ok' AND 3000 - r.fix_id * 29 % 3001 <= 25 THEN 1 ELSE 0 END) OVER (PARTITION BY device_id ORDER BY r.rn) AS arrived
  FROM r JOIN f USING (device_id, rn)),
v_q AS (SELECT s.*, o.fix_id * 31 % 40 AS offset_m FROM v_s s LEFT JOIN f o ON s.device_id = o.device_id AND s.ok_rn = o.rn)
SELECT device_id, CASE WHEN arrived = 1 THEN true ELSE false END AS arrived,
  CASE WHEN last_t IS NULL OR t_ms - last_t > 5000 THEN 'lost' WHEN acc > 20 OR offset_m > 30 THEN 'poor' ELSE 'good' END AS quality, count(*) AS fixes
FROM v_q GROUP BY ALL
""")
def signal_quality(spark, sf_dir):
    """Fixes by device, by the quality of its signal when they came and by whether it had arrived."""
    rows = states.device_states(_state_fixes(spark, sf_dir)).filter("kind = 'fix'")
    return rows.groupBy("device_id", (F.col("phase") == "arrived").alias("arrived"), "quality").agg(F.count(F.lit(1)).alias("fixes"))


# --- why restrictions are not honoured --------------------------------------------------------------------------


def _stage_of(way: str) -> str:
    """What removed a way, as SQL: null where it has edges."""
    return (
        f"CASE WHEN {way} IS NULL OR {way} IN (SELECT way_id FROM v_kept) THEN NULL WHEN {way} NOT IN (SELECT way_id FROM v_clip) THEN 'member-way-outside-clip' "
        f"WHEN {way} NOT IN (SELECT way_id FROM v_drive) THEN 'member-way-not-drivable' ELSE 'member-way-dropped-by-scc' END"
    )


_REASONS = f"""
v_we AS (SELECT edge_id, edge_id // 2 AS way_id, edge_from, edge_to FROM v_edge),
v_clip AS (SELECT DISTINCT way_id FROM v_we WHERE way_id % 23 <> 0), v_drive AS (SELECT way_id FROM v_clip WHERE way_id % 19 <> 0),
v_kept AS (SELECT * FROM v_we WHERE way_id IN (SELECT way_id FROM v_drive) AND way_id % 17 <> 0),
v_nclip AS (SELECT c_custkey AS v FROM customer WHERE c_custkey % 23 <> 0), v_nwas AS (SELECT v FROM v_nclip WHERE v % 19 <> 0), v_now AS (SELECT v FROM v_nwas WHERE v % 17 <> 0),
v_first AS (SELECT edge_from AS v, min(edge_id) // 2 AS next_way FROM v_edge GROUP BY edge_from),
v_rel AS (SELECT edge_id AS rel_id, {_ALL_KINDS}[edge_id % 12 + 1] AS kind, edge_id % 37 = 0 AS conditional, way_id AS from_way, next_way AS to_way,
  CASE WHEN edge_id % 5 <> 0 THEN edge_to END AS via_node, CASE WHEN edge_id % 5 = 0 AND edge_id % 3 <> 0 THEN next_way END AS via_way, 1 + (edge_id % 7 = 0)::INT AS n_via
  FROM v_we LEFT JOIN v_first ON v = edge_to),
v_why AS (SELECT *, CASE WHEN conditional THEN 'conditional' WHEN kind = '' THEN 'malformed-roles' WHEN kind = 'no_parking' THEN 'unknown-restriction-value'
  WHEN to_way IS NULL OR (via_node IS NULL AND via_way IS NULL) THEN 'malformed-roles' WHEN via_node IS NULL AND n_via > 1 THEN 'via-way-chain-unsupported'
  WHEN via_node IS NULL THEN coalesce({_stage_of("via_way")}, {_stage_of("from_way")}, {_stage_of("to_way")})
  WHEN via_node NOT IN (SELECT v FROM v_now) THEN CASE WHEN via_node NOT IN (SELECT v FROM v_nclip) THEN 'via-node-outside-clip' WHEN via_node NOT IN (SELECT v FROM v_nwas) THEN 'via-node-not-an-intersection' ELSE 'via-node-dropped-by-scc' END
  ELSE coalesce({_stage_of("from_way")}, {_stage_of("to_way")}) END AS why FROM v_rel),
v_led AS (
  SELECT DISTINCT rel_id FROM v_why JOIN v_kept i ON i.way_id = from_way AND i.edge_to = via_node JOIN v_kept o ON o.edge_from = via_node AND o.way_id = to_way WHERE why IS NULL
  UNION SELECT DISTINCT rel_id FROM v_why JOIN v_kept m ON via_node IS NULL AND m.way_id = via_way JOIN v_kept i ON i.way_id = from_way AND i.edge_to = m.edge_from JOIN v_kept o ON o.edge_from = m.edge_to AND o.way_id = to_way WHERE why IS NULL),
v_said AS (SELECT rel_id, coalesce(why, CASE WHEN rel_id NOT IN (SELECT rel_id FROM v_led) THEN 'member-way-wrong-direction-at-via' END) AS reason FROM v_why)
"""


@query(f"""
WITH {sql.EDGE}, {_REASONS}
SELECT CASE WHEN reason IS NULL THEN 'resolved' WHEN reason IN {restrictions.NOT_HONOURED} THEN 'not-honoured' ELSE 'correctly-ignored' END AS verdict, reason, count(*) AS relations FROM v_said GROUP BY ALL
""")
def restriction_reasons(spark, sf_dir):
    """Relations by verdict and reason where a build has removed members in all of its stages: ways outside the clip, closed
    to cars, or in another component (by their numbers), and nodes likewise."""
    edges = road.edges(spark, sf_dir).select("edge_id", F.floor(F.col("edge_id") / 2).alias("way_id"), "edge_from", "edge_to")
    first = edges.groupBy(F.col("edge_from").alias("v")).agg(F.floor(F.min("edge_id") / 2).alias("next_way"))
    e = F.col("edge_id")
    relations = edges.join(first, F.col("edge_to") == F.col("v"), "left").select(
        e.alias("rel_id"), F.element_at(F.array(*map(F.lit, _ALL_KINDS)), (e % 12 + 1).cast("int")).alias("kind"), (e % 37 == 0).alias("conditional"), F.col("way_id").alias("from_way"), F.col("next_way").alias("to_way"),
        F.when(e % 5 != 0, F.col("edge_to")).alias("via_node"), F.when((e % 5 == 0) & (e % 3 != 0), F.col("next_way")).alias("via_way"), (1 + (e % 7 == 0).cast("int")).alias("n_via"),
    )
    clip = edges.select("way_id").distinct().filter("way_id % 23 <> 0")
    drivable = clip.filter("way_id % 19 <> 0")
    nodes = road.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node_id")).filter("node_id % 23 <> 0")
    before = nodes.filter("node_id % 19 <> 0").select(F.col("node_id").alias("vertex_id"))
    kept = edges.join(drivable.filter("way_id % 17 <> 0"), "way_id", "left_semi")
    stages = restrictions.Stages(nodes, clip, drivable, before)
    verdicts = restrictions.resolve(relations, kept, before.filter("vertex_id % 17 <> 0"), stages)[0]
    return verdicts.groupBy("verdict", "reason").agg(F.count(F.lit(1)).alias("relations"))


# --- scenarios --------------------------------------------------------------------------------------------------


@query()
def turn_sweep(spark, sf_dir):
    """Routes between places on edges with turn costs as they are, without them, and doubled."""
    edges = graph.costs(road.edges(spark, sf_dir))
    turns = graph.turn_costs(edges)
    cases = {"base": F.col("seconds"), "none": F.lit(0.0).cast("float"), "double": (F.col("seconds") * 2).cast("float")}
    bans, triples = _bans(edges), _triples(edges)
    variants = [scenarios.Scenario(name, edges, turns.withColumn("seconds", s), bans, triples) for name, s in cases.items()]
    found = scenarios.routes(_places_on_edges(spark, sf_dir, edges), variants)
    told = scenarios.outcome(found, edges, "base")
    return told.select("scenario", "routes", "moved", "improved", "worsened", *[F.round(c, 4).alias(c) for c in ("median_s", "p95_s", "overlap")])


@query()
def ban_enforcement(spark, sf_dir):
    """Every ban of the network: what the route does without and with bans, from one end of it to the other."""
    edges = graph.costs(road.edges(spark, sf_dir))
    return scenarios.enforcement(edges, graph.turn_costs(edges), _bans(edges), _triples(edges)).drop("ban_id")
