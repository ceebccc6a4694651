"""A tracked device's states: phase, signal quality, arrival, loss of signal, and counts of what was rejected and why.

One fold serves the batch form here and the stream (``streaming.tracker.track_states``), so both give the same rows for
the same fixes in the same order. A device is lost ``dropout_ms`` after its last accepted fix: in batch that shows when a
later fix comes, in a stream when event time passes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from waygrid.config import Tracking
from waygrid.operators.tracking import judge_fix

#: Metres left of a route at which one has arrived; the share of the accepted accuracy that is poor.
ARRIVED_M, POOR_SHARE = 25.0, 0.5
REASONS = ("accuracy", "implied-speed", "out-of-order")

FIX_SCHEMA = "device_id bigint, fix_id bigint, t_ms bigint, lat double, lon double, accuracy_m double, offset_m double, left_m double"
OUT_SCHEMA = "device_id bigint, t_ms bigint, kind string, fix_id bigint, verdict string, phase string, quality string, accepted bigint, rejected_accuracy bigint, rejected_speed bigint, rejected_order bigint"
#: The fold's state, as a row.
STATE_SCHEMA = "t_ms bigint, lat double, lon double, accuracy_m double, offset_m double, phase string, outside_since bigint, lost boolean, accepted bigint, rejected_accuracy bigint, rejected_speed bigint, rejected_order bigint"
BEGUN = (None, None, None, None, None, "acquiring", None, False, 0, 0, 0, 0)


def _absent(x) -> bool:
    return x is None or isinstance(x, float) and math.isnan(x)


class Device:
    """The state of one device between fixes."""

    def __init__(self, cfg: Tracking, state: tuple = BEGUN):
        self.cfg = cfg
        self.t, self.lat, self.lon, self.accuracy, self.offset, self.phase, self.since, self.lost, *self.counts = state

    def state(self) -> tuple:
        return (self.t, self.lat, self.lon, self.accuracy, self.offset, self.phase, self.since, self.lost, *self.counts)

    def quality(self, now: int) -> str:
        if self.t is None or now - self.t > self.cfg.dropout_ms:
            return "lost"
        off = self.offset is not None and self.offset > self.cfg.off_route_m
        return "poor" if off or self.accuracy > POOR_SHARE * self.cfg.accuracy_m else "good"

    def lose(self, now: int) -> list[tuple]:
        """The row that tells of the loss, once, if event time has passed the last fix by more than the limit."""
        if self.t is None or self.lost or now - self.t <= self.cfg.dropout_ms:
            return []
        self.lost = True
        return [(self.t + self.cfg.dropout_ms, "lost", None, None, self.phase, "lost", *self.counts)]

    def fix(self, fix_id: int, t: int, lat: float, lon: float, accuracy: float, offset: float, left: float) -> list[tuple]:
        """Rows of one more fix. A rejected one changes nothing but its count."""
        out = self.lose(t)
        last = None if self.t is None else (self.lat, self.lon, self.accuracy, self.t)
        verdict = judge_fix(last, (lat, lon, accuracy, t), self.cfg)
        if verdict == "ok":
            self.counts[0] += 1
            self.t, self.lat, self.lon, self.accuracy, self.lost = t, lat, lon, accuracy, False
            self.offset = None if _absent(offset) else offset
            self._move(t, left)
        else:
            self.counts[1 + REASONS.index(verdict)] += 1
        return [*out, (t, "fix", fix_id, verdict, self.phase, self.quality(t), *self.counts)]

    def _move(self, t: int, left: float) -> None:
        """The phase after an accepted fix. Having arrived stays; a stay outside the corridor that lasts asks for a new route."""
        if self.offset is None:
            self.phase, self.since = ("free-drive" if self.phase == "acquiring" else self.phase), None
            return
        if self.phase in ("acquiring", "free-drive"):
            self.phase = "navigating"
        if self.offset > self.cfg.off_route_m:
            self.since = t if self.since is None else self.since
            if self.phase == "navigating" and t - self.since >= self.cfg.off_route_ms:
                self.phase = "rerouting"
        else:
            self.since = None
            self.phase = "navigating" if self.phase == "rerouting" else self.phase
        if not _absent(left) and left <= ARRIVED_M:
            self.phase = "arrived"


COLUMNS = [c.split()[0] for c in OUT_SCHEMA.split(", ")]


def frame(rows: list[tuple]) -> pd.DataFrame:
    """Rows in the types of OUT_SCHEMA; a timer's row has no fix."""
    return pd.DataFrame(rows, columns=COLUMNS).astype({"fix_id": "Int64"})


def device_states(fixes: DataFrame, cfg: Tracking = Tracking()) -> DataFrame:
    """Rows of all fixes (FIX_SCHEMA) and of losses between them. Devices are dealt out, sorted and streamed through the
    fold, which keeps one device's state: a device with very many fixes takes time in its task and no memory."""
    names = [c.split()[0] for c in FIX_SCHEMA.split(", ")]

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, device = None, None
        for f in frames:
            rows = []
            for key, *fix in f[names].itertuples(index=False, name=None):
                if device is None or key != who:
                    who, device = key, Device(cfg)
                rows += [(key, *row) for row in device.fix(*fix)]
            yield frame(rows)

    return fixes.select(*names).repartition("device_id").sortWithinPartitions("device_id", "t_ms", "fix_id").mapInPandas(fold, OUT_SCHEMA)
