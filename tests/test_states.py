"""Device states: the stream against the batch fold, and single cases."""

import random

from waygrid.config import Tracking
from waygrid.operators import states
from waygrid.streaming import tracker


def walk(device, start, n, rng):
    """Fixes with gaps beyond the limit, bad accuracies, jumps and a stay outside the corridor."""
    t, rows = start, []
    for i in range(n):
        t += rng.choice([1000, 1000, 2000, 4000, 9000])
        lat = 28.5 + i * 1e-4 + (0.5 if rng.random() < 0.05 else 0)
        rows.append((device, device * 1000 + i, t, lat, 77.5, rng.choice([5.0, 15.0, 30.0, 60.0]), rng.choice([5.0, 5.0, 50.0]), max(0.0, 400.0 - 12 * i) if device % 2 else None))
    return rows


def test_stream_gives_the_rows_of_the_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = sorted((r for d in range(4) for r in walk(d, 1_000_000, 40, rng)), key=lambda r: r[2])
    end = rows[-1][2]
    beats = [(99, 99_000 + k, end + 60_000 * (k + 1), 10.0, 10.0, 5.0, None, None) for k in range(3)]
    schema = ", ".join(f"{n} {'bigint' if n in ('device_id', 'fix_id', 't_ms') else 'double'}" for n in ("device_id", "fix_id", "t_ms", "lat", "lon", "accuracy_m", "offset_m", "left_m"))
    parts = [rows[k : k + 55] for k in range(0, len(rows), 55)] + [[b] for b in beats]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.json(f"{tmp_path}/in/{k}")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(f"{tmp_path}/in")
    query = tracker.track_states(source).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    assert query.awaitTermination(300)
    got = {tuple(r) for r in spark.read.schema(states.OUT_SCHEMA).parquet(f"{tmp_path}/out").collect()}
    batch = [tuple(r) for r in states.device_states(spark.createDataFrame(rows + beats, schema)).collect()]
    # Past the last fix only event time tells of a loss: the other device's beats carry it on.
    after = {r for r in got if r not in set(batch)}
    assert set(batch) <= got and len(batch) == len(set(batch))
    assert all(r[2] == "lost" and r[1] > end for r in after if r[0] == 99)
    last = {d: max((r[1] for r in batch if r[0] == d and r[4] == "ok"), default=None) for d in range(4)}
    told = {(r[0], r[1]) for r in got if r[2] == "lost"}
    assert all((d, t + 5000) in told for d, t in last.items() if t is not None) and {r[0] for r in after} <= {0, 1, 2, 3, 99}
    assert {r[5] for r in batch} >= {"navigating", "rerouting"} and {r[6] for r in batch} == {"good", "poor", "lost"}


def fed(*fixes, cfg=Tracking()):
    device = states.Device(cfg)
    return [row for i, (t, lat, accuracy, offset, left) in enumerate(fixes) for row in device.fix(i, t, lat, 77.5, accuracy, offset, left)]


def test_arrival_stays(spark):
    rows = fed((0, 28.0, 5.0, 1.0, 500.0), (2000, 28.0001, 5.0, 1.0, 25.0), (4000, 28.0002, 5.0, 1.0, 90.0))
    assert [r[4] for r in rows] == ["navigating", "arrived", "arrived"]


def test_a_rejected_fix_changes_only_its_count(spark):
    rows = fed((0, 28.0, 5.0, 1.0, None), (1000, 28.0, 90.0, 70.0, 0.0), (1000, 29.0, 5.0, 70.0, 0.0), (1000, 28.0, 5.0, 1.0, None), (500, 28.0, 5.0, 1.0, None))
    assert [r[3] for r in rows] == ["ok", "accuracy", "implied-speed", "ok", "out-of-order"]
    assert [r[4] for r in rows] == ["navigating"] * 5 and rows[-1][6:] == (2, 1, 1, 1)


def test_lost_once_and_found_again(spark):
    rows = fed((0, 28.0, 5.0, None, None), (5000, 28.0, 99.0, None, None), (5001, 28.0, 99.0, None, None), (9000, 28.0, 99.0, None, None), (9500, 28.0, 5.0, None, None))
    assert [(r[0], r[1], r[5]) for r in rows] == [(0, "fix", "good"), (5000, "fix", "good"), (5000, "lost", "lost"), (5001, "fix", "lost"), (9000, "fix", "lost"), (9500, "fix", "good")]
    assert {r[4] for r in rows} == {"free-drive"}


def test_a_stay_outside_asks_for_a_route_and_the_way_back_ends_it(spark):
    rows = fed((0, 28.0, 5.0, 31.0, None), (2999, 28.0, 5.0, 31.0, None), (3000, 28.0, 5.0, 31.0, None), (4000, 28.0, 5.0, 30.0, None))
    assert [r[4] for r in rows] == ["navigating", "navigating", "rerouting", "navigating"] and [r[5] for r in rows] == ["poor", "poor", "poor", "good"]


def test_no_fixes(spark):
    assert states.device_states(spark.createDataFrame([], states.FIX_SCHEMA.replace("bigint", "long"))).count() == 0
