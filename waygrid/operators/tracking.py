"""Position tracking in batch: the same decisions as the streaming tracker, as ordered folds and windows."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from waygrid.config import EARTH_M, M_PER_DEG_LAT, Tracking
from waygrid.functions.geo import bearing, bearing_gap, haversine, project
from waygrid.operators import spatial
from waygrid.plans.lineage import cut, unioned


def metres(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    p, q = math.radians(lat1), math.radians(lat2)
    a = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_M * math.asin(min(1.0, math.sqrt(a)))


def judge_fix(last: tuple | None, fix: tuple, cfg: Tracking) -> str:
    """Verdict on a fix (lat, lon, accuracy_m, t_ms) after the last accepted one: out of order, then inaccurate, then
    implausibly fast once both accuracies are taken off the distance."""
    if last is not None and fix[3] <= last[3]:
        return "out-of-order"
    if not fix[2] <= cfg.accuracy_m:
        return "accuracy"
    if last is not None:
        moved = max(0.0, metres(last[0], last[1], fix[0], fix[1]) - (last[2] + fix[2]))
        if moved / ((fix[3] - last[3]) / 1000) * 3.6 > cfg.max_speed_kmh:
            return "implied-speed"
    return "ok"


FIX_COLUMNS = "device_id bigint, fix_id bigint, t_ms bigint, lat double, lon double, accuracy_m double, verdict string"


def judge_fixes(fixes: DataFrame, cfg: Tracking = Tracking()) -> DataFrame:
    """Verdict of every fix. A fix is compared with the last accepted one of its device, which no window function
    expresses: devices are dealt out, sorted, and streamed through a fold that keeps one fix, so a device with very many
    fixes takes time in its task and no memory."""
    rows = fixes.select("device_id", "fix_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long").alias("t_ms"), "lat", "lon", "accuracy_m")

    def fold(frames):
        device, last = None, None
        for f in frames:
            verdicts = []
            for who, *fix in zip(f["device_id"], f["lat"], f["lon"], f["accuracy_m"], f["t_ms"]):
                if who != device:
                    device, last = who, None
                verdicts.append(judge_fix(last, fix, cfg))
                if verdicts[-1] == "ok":
                    last = fix
            yield f.assign(verdict=verdicts)

    return rows.repartition("device_id").sortWithinPartitions("device_id", "t_ms", "fix_id").mapInPandas(fold, FIX_COLUMNS)


def headings(fixes: DataFrame, cfg: Tracking = Tracking()) -> DataFrame:
    """Nearest earlier fix of the device, within the history, that lies at least the heading window away."""
    w = W.partitionBy("device_id").orderBy("ts", "fix_id").rowsBetween(-cfg.history, -1)
    past = fixes.withColumn("past", F.collect_list(F.struct("fix_id", "lat", "lon")).over(w))
    far = F.filter("past", lambda p: haversine(p["lat"], p["lon"], F.col("lat"), F.col("lon")) >= cfg.heading_window_m)
    return past.withColumn("origin", F.try_element_at(far, F.lit(-1))).select("device_id", "fix_id", F.col("origin.fix_id").alias("from_fix"), "lat", "lon", F.col("origin.lat").alias("from_lat"), F.col("origin.lon").alias("from_lon"))


#: Fixes back from which on a speed has a weight below a double's precision (0.7 to the power of 127 is 2e-20).
SPEED_FIXES = 128


def smoothed_speed(fixes: DataFrame, keep: float = 0.7) -> DataFrame:
    """Exponential mean of speeds in order; the first passes. A fold over the last fixes that still count, in the JVM."""
    w = W.partitionBy("device_id").orderBy("ts", "fix_id").rowsBetween(1 - SPEED_FIXES, 0)
    listed = fixes.withColumn("speeds", F.collect_list("speed_mps").over(w))
    fold = F.aggregate("speeds", F.lit(None).cast("double"), lambda acc, x: F.when(acc.isNull(), x).otherwise(acc * keep + x * (1 - keep)))
    return listed.select("device_id", "fix_id", fold.alias("speed"))


def cumulative(fixes: DataFrame) -> DataFrame:
    """Metres travelled up to each fix of its device."""
    w = W.partitionBy("device_id").orderBy("ts", "fix_id")
    step = haversine(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    return fixes.withColumn("step_m", F.coalesce(step, F.lit(0.0))).withColumn("travelled_m", F.sum("step_m").over(w.rowsBetween(W.unboundedPreceding, 0)))


def off_route(samples: DataFrame, cfg: Tracking = Tracking()) -> DataFrame:
    """Alarms of samples (device_id, t_ms, offset_m): outside the corridor for long enough in event time, once for
    each stay outside. Gaps and islands: a stay is a run of samples outside."""
    w = W.partitionBy("device_id").orderBy("t_ms")
    outside = samples.withColumn("out", F.col("offset_m") > cfg.off_route_m).withColumn("stay", F.sum((~F.col("out")).cast("int")).over(w))
    since = outside.filter("out").withColumn("since", F.min("t_ms").over(W.partitionBy("device_id", "stay")))
    return since.filter(F.col("t_ms") - F.col("since") >= cfg.off_route_ms).groupBy("device_id", "stay").agg(F.min("t_ms").alias("alarm_ms")).drop("stay")


def merged_intervals(rows: DataFrame, key: str, begin: str, end: str) -> DataFrame:
    """Union of overlapping or touching intervals by key."""
    w = W.partitionBy(key).orderBy(begin, end)
    reach = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = rows.withColumn("new", F.coalesce((F.col(begin) > reach), F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(w))
    return marked.groupBy(key, "run").agg(F.min(begin).alias(begin), F.max(end).alias(end)).drop("run")


def windows_of(fixes: DataFrame, size: int) -> DataFrame:
    """Adds window: the number of each device's run of ``size`` fixes in order."""
    turn = F.row_number().over(W.partitionBy("device_id").orderBy("ts", "fix_id"))
    return fixes.withColumn("window", F.floor((turn - 1) / size).cast("long"))


def match_traces(fixes: DataFrame, candidates: DataFrame, cfg: Tracking = Tracking()) -> DataFrame:
    """Probabilistic map matching of each window of a device's fixes: (device_id, window, edge_id, offset_m, probability)
    of the last fix that has a candidate.

    candidates: (fix_id, edge_id, distance_m, flat, flon, edge_bearing) from the spatial join, directed edges with the
    bearing of travel. A fix's heading counts from a speed on; edges that disagree with it are no candidates, before any
    score. Emission is Gaussian in the distance, transitions compare straight distances, a fix without candidates is
    skipped. A window is a group of its own, so no task holds a device's history."""
    moving = F.when(F.col("speed_mps") >= cfg.heading_min_mps, F.col("heading_deg"))
    rows = windows_of(fixes, cfg.match_fixes).select("device_id", "window", "fix_id", "ts", "lat", "lon", "accuracy_m", moving.alias("heading")).join(candidates, "fix_id")
    rows = rows.filter(F.col("heading").isNull() | F.isnan("heading") | (bearing_gap(F.col("heading"), F.col("edge_bearing")) <= cfg.heading_gate_deg))
    layer = F.array_sort(F.collect_list(F.struct("distance_m", "edge_id", "flat", "flon")))
    layers = rows.groupBy("device_id", "window", "fix_id", "ts", "lat", "lon", "accuracy_m").agg(layer.alias("layer"))
    traces = layers.groupBy("device_id", "window").agg(F.array_sort(F.collect_list(F.struct("ts", "fix_id", "lat", "lon", "accuracy_m", "layer"))).alias("fixes"))

    def viterbi(frames):
        for f in frames:
            out = []
            for fixes_ in f["fixes"]:
                before, at = [], None  # the last layer's (edge, log probability, foot, distance), and its fix
                for x in fixes_:
                    now = []
                    moved = metres(*at, x["lat"], x["lon"]) if before else 0.0
                    for c in x["layer"]:
                        log_p = -0.5 * (c["distance_m"] / max(cfg.sigma_floor_m, x["accuracy_m"])) ** 2
                        if before:
                            log_p += max(p - abs(metres(a, b, c["flat"], c["flon"]) - moved) / cfg.transition_m for _, p, a, b, _ in before)
                        now.append((c["edge_id"], log_p, c["flat"], c["flon"], c["distance_m"]))
                    before, at = now, (x["lat"], x["lon"])
                best = max(before, key=lambda c: c[1])
                out.append((best[0], best[4], 1 / sum(math.exp(c[1] - best[1]) for c in before)))
            yield pd.DataFrame({"device_id": f["device_id"], "window": f["window"], "edge_id": [x[0] for x in out], "offset_m": [x[1] for x in out], "probability": [x[2] for x in out]})

    return traces.mapInPandas(viterbi, "device_id bigint, window bigint, edge_id bigint, offset_m double, probability double")


#: Metres of a route in one bucket of its range key, the first ring around a fix that is looked for on its whole route, and
#: how rings grow.
ROUTE_BUCKET_M, FIRST_RING_M, RING_GROWTH = 500.0, 250.0, 8.0


def _agrees(heading: Column, direction: Column, cfg: Tracking) -> Column:
    return heading.isNull() | (bearing_gap(direction, heading) <= cfg.heading_gate_deg)


def _nearest_of(pairs: DataFrame) -> DataFrame:
    best = pairs.groupBy("fix_id").agg(F.min(F.struct("offset_m", "seq", (F.col("from_m") + F.col("t") * F.col("length_m")).alias("route_m"))).alias("best"))
    return best.select("fix_id", "best.offset_m", "best.route_m", "best.seq")


def _in_window(fixes: DataFrame, segments: DataFrame, cfg: Tracking) -> DataFrame:
    """A segment is registered in each bucket of its route from which the window reaches it; a fix looks into its own."""
    bucket = lambda m: F.floor(m / F.lit(ROUTE_BUCKET_M))
    window = F.lit(cfg.route_window_m)
    buckets = F.sequence(bucket(F.col("from_m") - window), bucket(F.col("to_m") + window))
    s = segments.withColumn("bucket", F.explode(buckets)).withColumn("cell", F.xxhash64("route_id", "bucket")).drop("bucket").withColumnRenamed("route_id", "of_segment")
    pairs = spatial.met(fixes.withColumn("cell", F.xxhash64("route_id", bucket(F.col("last_m")))), s, "fix_id")
    near = (F.col("to_m") >= F.col("last_m") - window) & (F.col("from_m") <= F.col("last_m") + window)
    pairs = pairs.filter((F.col("route_id") == F.col("of_segment")) & near & _agrees(F.col("heading"), F.col("edge_bearing"), cfg))
    pairs = pairs.withColumn("t", project(F.col("lat"), F.col("lon"), F.col("alat"), F.col("alon"), F.col("blat"), F.col("blon"), F.col("lat")))
    foot_lat, foot_lon = F.col("alat") + F.col("t") * (F.col("blat") - F.col("alat")), F.col("alon") + F.col("t") * (F.col("blon") - F.col("alon"))
    return _nearest_of(pairs.withColumn("offset_m", haversine(F.col("lat"), F.col("lon"), foot_lat, foot_lon)))


def _with_a_way(fixes: DataFrame, segments: DataFrame, cfg: Tracking) -> DataFrame:
    """Fixes whose route has a segment that agrees with their heading. A route's bearings are kept as the lowest and highest
    of each degree, 360 rows at most: the gate is wider than a degree, so if any bearing of one agrees, its lowest or highest does."""
    degrees = segments.groupBy("route_id", F.floor("edge_bearing").alias("degree")).agg(F.min("edge_bearing").alias("low"), F.max("edge_bearing").alias("high"))
    held = degrees.groupBy("route_id").agg(F.collect_list(F.struct("low", "high")).alias("bearings"))
    some = F.exists("bearings", lambda b: _agrees(F.col("heading"), b["low"], cfg) | _agrees(F.col("heading"), b["high"], cfg))
    return fixes.join(held, "route_id").filter(some).drop("bearings")


def _anywhere(fixes: DataFrame, segments: DataFrame, cfg: Tracking) -> DataFrame:
    """Rings that grow until each fix has a segment: what lies within a ring is met in full, so its nearest can't be beaten."""
    found, left, radius = None, cut(_with_a_way(fixes.filter("lat is not null and lon is not null"), segments, cfg)), FIRST_RING_M
    while True:
        all_round = radius >= M_PER_DEG_LAT * 180
        pairs = spatial.pairs_within(left, segments, radius, "fix_id", "seq", same="route_id").withColumnRenamed("distance_m", "offset_m")
        done = cut(_nearest_of(pairs.filter(_agrees(F.col("heading"), F.col("edge_bearing"), cfg))))
        found = done if found is None else unioned(found, done, number="offset_m")
        left = cut(left.join(done.select("fix_id"), "fix_id", "left_anti"))
        if all_round or not left.take(1):
            return found
        radius *= RING_GROWTH


def match_to_route(fixes: DataFrame, segments: DataFrame, cfg: Tracking = Tracking()) -> DataFrame:
    """Fixes (fix_id, route_id, lat, lon, heading, last_m) on their active route, whose segments are (route_id, seq, alat,
    alon, blat, blon): adds offset_m, route_m (metres along the route) and seq of the nearest segment; null where none is left,
    or where a fix has no coordinates.

    Segments that disagree with a known heading are no candidates; nor are those outside the window around last_m, the
    metres where the vehicle was last seen (null: the whole route). Of equal offsets the first segment along the route.

    No fix meets its whole route: where the vehicle was last seen is a range key, and a fix without it looks around itself
    in rings of its route's own cells. Hot buckets and cells are dealt by their fixes, so a popular route is many tasks."""
    w = W.partitionBy("route_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    length = haversine(F.col("alat"), F.col("alon"), F.col("blat"), F.col("blon"))
    s = segments.select("route_id", "seq", "alat", "alon", "blat", "blon").withColumn("length_m", length).withColumn("to_m", F.sum("length_m").over(w)).withColumn("from_m", F.col("to_m") - F.col("length_m"))
    s = cut(s.withColumn("edge_bearing", bearing(F.col("alat"), F.col("alon"), F.col("blat"), F.col("blon"))))
    asked = fixes.select("fix_id", "route_id", "lat", "lon", "heading", "last_m")
    seen = _in_window(asked.filter("last_m is not null and lat is not null and lon is not null"), s, cfg)
    best = unioned(seen, _anywhere(asked.filter("last_m is null"), s, cfg), number="offset_m")
    return fixes.join(best, "fix_id", "left").select(*fixes.columns, "offset_m", "route_m", "seq")


def progress(matched: DataFrame, instructions: DataFrame) -> DataFrame:
    """What is left of the route for matched fixes (fix_id, route_id, route_m, total_m) with instructions (route_id, turn,
    at_m, leg_m, leg_s): the current instruction is the first still ahead (else the last), adds instruction,
    to_maneuver_m, remaining_m and remaining_s: later legs, and the part of the current leg that is not driven."""
    w = W.partitionBy("route_id").orderBy(F.desc("turn")).rowsBetween(W.unboundedPreceding, -1)
    legs = instructions.withColumn("later_s", F.coalesce(F.sum("leg_s").over(w), F.lit(0.0)))
    ahead = F.col("at_m") >= F.col("route_m") - 1e-6
    j = matched.join(legs, "route_id", "left")
    best = j.groupBy("fix_id", "route_id", "route_m", "total_m").agg(
        F.min(F.when(ahead, F.struct("turn", "at_m", "leg_m", "leg_s", "later_s"))).alias("next"), F.max(F.struct("turn", F.col("total_m").alias("at_m"), "leg_m", "leg_s", "later_s")).alias("last")
    )
    best = best.withColumn("now", F.coalesce("next", "last"))
    part = F.when(F.col("now.leg_m") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("now.at_m") - F.col("route_m")) / F.col("now.leg_m")))).otherwise(0.0)
    return best.select(
        "fix_id", "route_id", F.col("now.turn").alias("instruction"), F.greatest(F.lit(0.0), F.col("now.at_m") - F.col("route_m")).alias("to_maneuver_m"),
        F.greatest(F.lit(0.0), F.col("total_m") - F.col("route_m")).alias("remaining_m"), (F.col("now.later_s") + part * F.col("now.leg_s")).alias("remaining_s"),
    )
