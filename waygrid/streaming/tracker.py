"""Streaming tracker: keyed state per device, event time in the data, no reordering buffer.

A fix is judged against the last accepted one of its device as soon as it comes; a late one is told so and changes
nothing. The same judgement serves the batch form, so both agree on the same fixes in the same order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from waygrid.config import Tracking
from waygrid.operators import states
from waygrid.operators.tracking import judge_fix, metres

FIX_SCHEMA = "device_id long, fix_id long, t_ms long, lat double, lon double, accuracy_m double, offset_m double, speed_mps double"
OUT_SCHEMA = "device_id bigint, fix_id bigint, t_ms bigint, verdict string, speed double, travelled_m double, phase string, off_route boolean"
STATE_SCHEMA = "t_ms bigint, lat double, lon double, accuracy_m double, speed double, travelled_m double, outside_since bigint, alarmed boolean"


def read_fixes(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """Fixes that arrive as JSON files in a folder."""
    return spark.readStream.schema(FIX_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(folder)


def track(fixes: DataFrame, cfg: Tracking = Tracking(), *, ttl_ms: int = 3_600_000) -> DataFrame:
    """Verdict, smoothed speed, metres travelled, phase and off-route alarm of each fix.

    State is one row a device and goes after ``ttl_ms`` without fixes. offset_m is the distance from the route (null when
    there is none): off_route is true once a stay outside the corridor has lasted long enough, and not again before
    the device was back inside."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        t, lat, lon, accuracy, speed, travelled, since, alarmed = state.get if state.exists else (None, None, None, None, None, 0.0, None, False)
        rows = pd.concat(list(frames)).sort_values(["t_ms", "fix_id"])
        out = []
        for r in rows.itertuples():
            last = None if t is None else (lat, lon, accuracy, t)
            verdict, alarm = judge_fix(last, (r.lat, r.lon, r.accuracy_m, r.t_ms), cfg), False
            if verdict == "ok":
                travelled += metres(lat, lon, r.lat, r.lon) if last else 0.0
                if not pd.isna(r.speed_mps):
                    speed = float(r.speed_mps) if speed is None else 0.7 * speed + 0.3 * float(r.speed_mps)
                if not pd.isna(r.offset_m) and r.offset_m > cfg.off_route_m:
                    since = int(r.t_ms) if since is None else since
                    alarm = not alarmed and r.t_ms - since >= cfg.off_route_ms
                    alarmed = alarmed or alarm
                else:
                    since, alarmed = None, False
                t, lat, lon, accuracy = int(r.t_ms), float(r.lat), float(r.lon), float(r.accuracy_m)
            phase = "acquiring" if t is None else "free-drive" if pd.isna(r.offset_m) else "rerouting" if alarmed else "navigating"
            out.append((int(key[0]), int(r.fix_id), int(r.t_ms), verdict, speed, travelled, phase, alarm))
        state.update((t, lat, lon, accuracy, speed, travelled, since, alarmed))
        state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame(out, columns=["device_id", "fix_id", "t_ms", "verdict", "speed", "travelled_m", "phase", "off_route"])

    return fixes.groupBy("device_id").applyInPandasWithState(step, OUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.ProcessingTimeTimeout)


def track_states(fixes: DataFrame, cfg: Tracking = Tracking(), *, delay: str = "2 seconds", ttl_ms: int = 3_600_000) -> DataFrame:
    """The rows of ``states.device_states`` as fixes (states.FIX_SCHEMA) come, and losses as event time passes.

    Each device has one timer in event time: at first for the loss, dropout_ms behind its last accepted fix, then for the
    end of its state, ttl_ms behind it, which a row of kind "idle" tells of. Event time is the newest fix's of any device, less the
    delay. Fixes of one micro-batch are put in order; a fix that is late beyond that is judged as it comes."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        device = states.Device(cfg, state.get if state.exists else states.BEGUN)
        now, who = state.getCurrentWatermarkMs(), int(key[0])
        if state.hasTimedOut:
            rows = device.lose(max(now, (device.t or 0) + cfg.dropout_ms + 1)) if not device.lost else []
            if not rows:
                state.remove()
                yield states.frame([(who, (device.t or 0) + ttl_ms, "idle", None, None, "idle", "lost", *device.counts)])
                return
        else:
            fixes_now = pd.concat(list(frames)).sort_values(["t_ms", "fix_id"])
            columns = ["fix_id", "t_ms", "lat", "lon", "accuracy_m", "offset_m", "left_m"]
            rows = [row for fix in fixes_now[columns].itertuples(index=False, name=None) for row in device.fix(*fix)]
        state.update(device.state())
        wanted = now + ttl_ms if device.t is None else device.t + (ttl_ms if device.lost else cfg.dropout_ms + 1)
        state.setTimeoutTimestamp(max(wanted, now + 1))
        yield states.frame([(who, *row) for row in rows])

    timed = fixes.withColumn("ts", F.timestamp_millis("t_ms")).withWatermark("ts", delay)
    return timed.groupBy("device_id").applyInPandasWithState(step, states.OUT_SCHEMA, states.STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout)


def dropouts(fixes: DataFrame, cfg: Tracking = Tracking()) -> DataFrame:
    """Gaps longer than the dropout limit, as session windows in event time: a session ends where a gap begins."""
    timed = fixes.withColumn("ts", F.timestamp_millis("t_ms")).withWatermark("ts", "1 minute")
    return timed.groupBy("device_id", F.session_window("ts", f"{cfg.dropout_ms} milliseconds").alias("s")).agg(F.count(F.lit(1)).alias("fixes")).select("device_id", F.col("s.start").alias("begun"), F.col("s.end").alias("lost_at"), "fixes")
