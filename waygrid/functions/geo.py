"""Geometry as column expressions, so that it stays in generated code and is visible to the optimiser.

There are two bearings and two projections on purpose: their reference latitudes differ, and so do their results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from waygrid.config import EARTH_M, M_PER_DEG_LAT, M_PER_DEG_LON


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres; null where a coordinate is. A least() would skip the null and give half the earth's girth, so
    what rounding carries beyond the arc sine's domain is caught behind it."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_M) * F.nanvl(F.asin(F.sqrt(a)), F.lit(math.pi / 2))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle bearing in [0, 360)."""
    d = F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    return (F.degrees(F.atan2(y, x)) + 360) % 360


def planar_bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Bearing in a plane at the middle latitude, in (-180, 180]; instructions use this one."""
    return F.degrees(F.atan2((lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2)), lat2 - lat1))


def bearing_gap(a: Column, b: Column) -> Column:
    """Unsigned difference of bearings, 0 to 180."""
    d = F.abs(a - b) % 360
    return F.when(d > 180, 360 - d).otherwise(d)


def bearing_delta(a: Column, b: Column) -> Column:
    """Signed change from a to b in (-180, 180]; to the right is positive."""
    d = (b - a) % 360
    return F.when(d > 180, d - 360).when(d <= -180, d + 360).otherwise(d)


def flat_metres(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dx = (lon2 - lon1) * M_PER_DEG_LON * F.cos(F.radians((lat1 + lat2) / 2))
    dy = (lat2 - lat1) * M_PER_DEG_LAT
    return F.sqrt(dx * dx + dy * dy)


def project(lat: Column, lon: Column, alat: Column, alon: Column, blat: Column, blon: Column, at_lat: Column) -> Column:
    """Share t in [0, 1] of the foot of a point on segment a-b, in a plane at latitude at_lat."""
    return project_at(lat, lon, alat, alon, blat, blon, F.cos(F.radians(at_lat)))


def project_at(lat: Column, lon: Column, alat: Column, alon: Column, blat: Column, blon: Column, k: Column) -> Column:
    """The same with the cosine of the latitude, for joins that have it as a column: no cosine for each pair."""
    bx, by = (blon - alon) * k, blat - alat
    px, py = (lon - alon) * k, lat - alat
    length2 = bx * bx + by * by
    return F.when(length2 == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px * bx + py * by) / length2)))


def scaled(deg: Column) -> Column:
    """Degrees to degrees x 1e7, half up."""
    return F.floor(deg * 1e7 + F.lit(0.5)).cast("int")


def in_area(lat_e7: Column, lon_e7: Column, area: dict) -> Column:
    """Containment on integers, where it is exact; bounds belong to the area."""
    return lat_e7.between(*area["lat"]) & lon_e7.between(*area["lon"])


def in_area_deg(lat: Column, lon: Column, area: dict) -> Column:
    """Containment on degrees; kept to show where it disagrees with the exact form."""
    return lat.between(area["lat"][0] / 1e7, area["lat"][1] / 1e7) & lon.between(area["lon"][0] / 1e7, area["lon"][1] / 1e7)


def smoothing(dt_ms: Column, tau_ms: float) -> Column:
    return 1 - F.exp(-dt_ms / tau_ms)


def ease_angle(current: Column, target: Column) -> Column:
    """Shortest rotation from one heading to another, in [-180, 180)."""
    return (target - current + 540) % 360 - 180


def metres_per_pixel(lat: Column, zoom: Column) -> Column:
    return 156543.03392 * F.cos(F.radians(lat)) / F.pow(F.lit(2.0), zoom)


def camera_zoom(speed_mps: Column) -> Column:
    """17.5 when standing, down to 15.5 from 25 m/s."""
    return 17.5 - 2.0 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), speed_mps / 25))


def manoeuvre_seconds(delta: Column, rank_from: Column, rank_to: Column, cfg) -> Column:
    """Seconds of a turn: its sharpness, crossing of the oncoming lane (driving on the left), and a drop in class."""
    sharp = F.when(F.abs(delta) > cfg.straight_deg, cfg.turn_s * (F.abs(delta) - cfg.straight_deg) / (90 - cfg.straight_deg)).otherwise(0.0)
    cross = F.when((F.abs(delta) >= cfg.cross_deg) & (delta > 0), cfg.cross_s).otherwise(0.0)
    return sharp + cross + F.when(rank_to > rank_from, cfg.class_drop_s * (rank_to - rank_from)).otherwise(0.0)


def once(value: Column, then) -> Column:
    """What ``then`` makes of a value that is worked out once: an expression named twice in another is worked out twice, and
    inside a lambda for every element."""
    return F.element_at(F.transform(F.array(value), then), 1)


def clip_polyline(points: Column, start: Column, end: Column) -> Column:
    """The part of a line (array of lat, lon) between two shares of its length, with both cut points interpolated.

    A line of one point, or cut nowhere, stays as it is; one of no length becomes its first point; shares that leave
    nothing make the point at the first."""
    zero = F.lit(0.0)

    def joined(first, second):
        return haversine(first["lat"], first["lon"], second["lat"], second["lon"])

    def bounded(share, total):
        return F.greatest(zero, F.least(F.lit(1.0), share)) * total

    def between(near):
        gap = near["after"]["m"] - near["before"]["m"]
        t = F.when(gap > 0, (near["m"] - near["before"]["m"]) / gap).otherwise(zero)
        return F.struct(*[(near["before"][c] + t * (near["after"][c] - near["before"][c])).alias(c) for c in ("lat", "lon")])

    def at(placed, m):
        after = F.get(F.filter(F.slice(placed, 2, F.size(placed) - 1), lambda p: p["m"] >= m), F.lit(0))
        before = F.element_at(F.filter(placed, lambda p: (p["m"] < m) | (p["m"] == 0)), -1)
        return once(F.struct(m.alias("m"), F.when(m <= 0, placed[0]).otherwise(before).alias("before"), after.alias("after")), between)

    def bounds(line):
        total = F.element_at(line, -1)["m"]
        return F.struct(line.alias("placed"), total.alias("total"), bounded(start, total).alias("first"), bounded(end, total).alias("last"))

    def cut(b):
        placed, first, last = b["placed"], b["first"], b["last"]
        inner = F.transform(F.filter(placed, lambda p: (p["m"] > first) & (p["m"] < last)), lambda p: F.struct(p["lat"], p["lon"]))
        parts = F.when(last <= first, F.array(at(placed, first))).otherwise(F.concat(F.array(at(placed, first)), inner, F.array(at(placed, last))))
        return F.when(b["total"] == 0, F.slice(points, 1, 1)).otherwise(parts)

    pieces = F.zip_with(F.slice(points, 1, F.size(points) - 1), F.slice(points, 2, F.size(points) - 1), joined)
    reached = F.aggregate(pieces, F.array(zero), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    placed = F.zip_with(points, reached, lambda p, m: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"), m.alias("m")))
    whole = (F.size(points) < 2) | ((start <= 0) & (end >= 1))
    return F.when(whole, points).otherwise(once(placed, lambda line: once(bounds(line), cut)))
