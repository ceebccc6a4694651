"""What changes on a driver's screen: folds over a device's rows in order, each keeping what was last shown.

Devices are dealt out, sorted, and streamed, so a device with very many rows takes time in its task and no memory."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from waygrid.config import ETA_CHANGE_S, ETA_EVERY_MS, MATCH_EVERY_MS, REDRAW_M
from waygrid.operators.tracking import metres


def changes(rows: DataFrame, key: str, order: Sequence[str], columns: Sequence[str], step: Callable, flag: str, kind: str = "boolean") -> DataFrame:
    """Adds a flag of a kind to every row: step(state, *columns) gives the new state and the flag; a device starts with None."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + f", {flag} {kind}"

    def fold(frames):
        who, state = None, None
        for f in frames:
            flags = []
            for device, *row in zip(f[key], *[f[c] for c in columns]):
                if device != who:
                    who, state = device, None
                state, out = step(state, *row)
                flags.append(out)
            yield f.assign(**{flag: flags})

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(fold, schema)


def match_calls(fixes: DataFrame, every_ms: int = MATCH_EVERY_MS) -> DataFrame:
    """Adds call: whether the window up to a fix (device_id, fix_id, t_ms) is sent for matching. Time of the fixes counts,
    from the last call that was made, or from 0; none is made while a route is followed (on_route)."""

    def step(last, t, on_route):
        due = not on_route and t - (last or 0) >= every_ms
        return (t if due else last), due

    return changes(fixes, "device_id", ["t_ms", "fix_id"], ["t_ms", "on_route"], step, "call")


def shown_arrival(progress: DataFrame, every_ms: int = ETA_EVERY_MS, change_s: float = ETA_CHANGE_S) -> DataFrame:
    """Adds shown_s: the remaining seconds on the screen. They move once every_ms have passed since they last did, and by
    change_s at least."""

    def step(state, t, left):
        last_t, shown = state or (0, None)
        if t - last_t >= every_ms and (shown is None or abs(left - shown) >= change_s):
            return (t, left), left
        return (last_t, shown), left if shown is None else shown

    return changes(progress, "device_id", ["t_ms", "fix_id"], ["t_ms", "remaining_s"], step, "shown_s", "double")


def redraws(display: DataFrame, most_m: float = REDRAW_M) -> DataFrame:
    """Adds redraw: whether the driven line (device_id, fix_id, t_ms, at, lat, lon) is drawn anew, because the last point
    of the route behind (at) changed, or the place moved by more than most_m since it was last drawn."""

    def step(state, at, lat, lon):
        due = state is None or at != state[0] or metres(state[1], state[2], lat, lon) > most_m
        return ((at, lat, lon) if due else state), due

    return changes(display, "device_id", ["t_ms", "fix_id"], ["at", "lat", "lon"], step, "redraw")
