"""SQL twins of the projection, for comparison in another engine."""

from __future__ import annotations

from waygrid.config import CELL_DEG, EARTH_M, RANK_SPEED, Objective


def lat(k: str) -> str:
    return f"(281000000 + (({k} - {k} % 40) // 40) * 12000 + ({k} * 7919 % 1000) * 4)"


def lon(k: str) -> str:
    return f"(774000000 + ({k} % 40) * 12000 + ({k} * 104729 % 1000) * 4)"


def haversine(a1: str, o1: str, a2: str, o2: str) -> str:
    x = f"(pow(sin(radians({a2} - {a1}) / 2), 2) + cos(radians({a1})) * cos(radians({a2})) * pow(sin(radians({o2} - {o1}) / 2), 2))"
    return f"({2 * EARTH_M} * asin(CASE WHEN {x} > 1 THEN 1.0 ELSE sqrt{x} END))"


def bearing(a1: str, o1: str, a2: str, o2: str) -> str:
    d = f"radians({o2} - {o1})"
    return f"fmod(degrees(atan2(sin({d}) * cos(radians({a2})), cos(radians({a1})) * sin(radians({a2})) - sin(radians({a1})) * cos(radians({a2})) * cos({d}))) + 360, 360)"


_QUALITY = ", ".join(map(str, Objective().quality))
_TOLL_S = 3600 / Objective().rupees_per_hour
EDGE = f"""
v_last AS (SELECT count(*) - 1 AS last FROM customer),
v_e0 AS (SELECT o_orderkey AS edge_id, o_custkey AS edge_from, o_custkey + [1, 40, -1, -40][o_orderkey % 4 + 1] AS ahead, last, o_orderkey % 8 AS class_rank,
  CASE WHEN o_orderkey * 13 % 20 < 3 THEN o_orderkey * 13 % 20 + 1 ELSE 0 END AS toll_road, o_orderkey * 7 % 25 = 0 AS private, o_orderpriority AS name, o_orderkey * 11 % 50 = 0 AS roundabout FROM orders, v_last),
v_e1 AS (SELECT *, CASE WHEN ahead BETWEEN 0 AND last THEN ahead ELSE 2 * edge_from - ahead END AS edge_to, [{", ".join(map(str, RANK_SPEED))}][class_rank + 1] AS speed_kmh FROM v_e0),
v_e2 AS (SELECT *, least(edge_from, edge_to) * 1000000000 + greatest(edge_from, edge_to) AS shape_id, CASE WHEN edge_from > edge_to THEN 1 ELSE 0 END AS reversed,
  {lat("edge_from")} / 1e7 AS lat1, {lon("edge_from")} / 1e7 AS lon1, {lat("edge_to")} / 1e7 AS lat2, {lon("edge_to")} / 1e7 AS lon2 FROM v_e1),
v_e3 AS (SELECT *, {haversine("lat1", "lon1", "lat2", "lon2")} AS length_m FROM v_e2),
v_e4 AS (SELECT *, length_m / (speed_kmh / 3.6::DOUBLE) AS drive_s, length_m / 1000 * 24 * ([{_QUALITY}]::DOUBLE[])[class_rank + 1] + CASE WHEN private THEN length_m / 1000 * 180 ELSE 0 END AS distance_s,
  length_m / 1000 * ([0, 2.95, 1.95, 1.95]::DOUBLE[])[toll_road + 1] * {_TOLL_S}::DOUBLE AS toll_s FROM v_e3),
v_edge AS (SELECT *, drive_s + distance_s + toll_s AS secs FROM v_e4),
v_shape AS (SELECT shape_id, min(edge_id) AS edge_id, min(least(edge_from, edge_to)) AS a, min(greatest(edge_from, edge_to)) AS b, bit_or(1 << reversed) AS directions FROM v_edge GROUP BY shape_id),
v_seg AS (SELECT shape_id, edge_id, directions, {lat("a")} / 1e7 AS alat, {lon("a")} / 1e7 AS alon, {lat("b")} / 1e7 AS blat, {lon("b")} / 1e7 AS blon FROM v_shape)
"""
FIX = """
v_fix AS (SELECT event_id AS fix_id, user_id AS device_id, ts, (281000000 + user_id % 37 * 12000 + event_id * 37 % 1201 * 10) / 1e7 AS lat, (774000000 + user_id * 7 % 40 * 12000 + event_id * 53 % 1201 * 10) / 1e7 AS lon,
  (event_id * 17 % 60)::DOUBLE AS accuracy_m, (event_id * 53 % 360)::DOUBLE AS heading_deg, (event_id % 30)::DOUBLE AS speed_mps FROM events)
"""
PLACE = f"""
v_place AS (SELECT p_partkey AS place_id, p_name AS name, p_type AS kind, p_size AS importance, {lat("p_partkey")} / 1e7 AS lat, {lon("p_partkey")} / 1e7 AS lon FROM part)
"""


def near(radius_m: float) -> str:
    """Fixes with the segments within a radius: a bounding box, then the distance."""
    k, t = "cos(radians(lat))", "greatest(0.0, least(1.0, t0))"
    box = radius_m / 111320 * 1.3 + CELL_DEG / 1000
    foot = haversine("lat", "lon", f"alat + {t} * (blat - alat)", f"alon + {t} * (blon - alon)")
    return f"""
v_pairs AS (SELECT *, CASE WHEN bx * bx + by_ * by_ = 0 THEN 0 ELSE (px * bx + py * by_) / (bx * bx + by_ * by_) END AS t0 FROM (
  SELECT f.fix_id, f.lat, f.lon, s.*, (blon - alon) * {k} AS bx, blat - alat AS by_, (lon - alon) * {k} AS px, lat - alat AS py FROM v_fix f JOIN v_seg s
  ON lat BETWEEN least(alat, blat) - {box} AND greatest(alat, blat) + {box} AND lon BETWEEN least(alon, blon) - {box} AND greatest(alon, blon) + {box})),
v_near AS (SELECT fix_id, edge_id, shape_id, {t} AS t, {foot} AS distance_m FROM v_pairs WHERE {foot} <= {radius_m})
"""


TURN = f"""
v_b AS (SELECT edge_id, edge_from, edge_to, shape_id, reversed, class_rank, secs, {bearing("lat1", "lon1", "lat2", "lon2")} AS bearing FROM v_edge),
v_deg AS (SELECT edge_from AS vertex, count(*) AS ways_on FROM v_edge GROUP BY edge_from),
v_t0 AS (SELECT a.edge_id AS edge_in, b.edge_id AS edge_out, a.class_rank AS rin, b.class_rank AS rout, ways_on, a.shape_id = b.shape_id AND a.reversed <> b.reversed AS is_uturn, fmod(b.bearing - a.bearing, 360) AS d0
  FROM v_b a JOIN v_b b ON a.edge_to = b.edge_from JOIN v_deg ON a.edge_to = vertex),
v_t1 AS (SELECT *, CASE WHEN d0 > 180 THEN d0 - 360 WHEN d0 <= -180 THEN d0 + 360 ELSE d0 END AS d FROM v_t0),
v_turn AS (SELECT edge_in, edge_out, is_uturn, (CASE WHEN is_uturn THEN CASE WHEN ways_on <= 1 THEN 0.0 ELSE 40.0 END ELSE
  CASE WHEN abs(d) > 25 THEN 3 * (abs(d) - 25) / 65 ELSE 0 END + CASE WHEN abs(d) >= 40 AND d > 0 THEN 3 ELSE 0 END + CASE WHEN rout > rin THEN 2 * (rout - rin) ELSE 0 END END)::FLOAT AS seconds FROM v_t1)
"""
