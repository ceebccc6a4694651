"""The streaming tracker against its batch form, and file formats against their own bytes."""

import random

import pytest
from pyspark.sql import functions as F

from waygrid.operators import tracking
from waygrid.sinks import tables
from waygrid.sources import osm_pbf
from waygrid.streaming import tracker


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(1)
    rows = [(d, d * 1000 + i, i * 2000, 28.5 + i * 2e-4 + rng.random() * 1e-4, 77.5, rng.choice([5.0, 20.0, 60.0]), rng.choice([5.0, 50.0, 50.0]), rng.random() * 20) for d in range(4) for i in range(30)]
    rows.sort(key=lambda r: r[2])
    schema = tracker.FIX_SCHEMA
    for k in range(3):
        spark.createDataFrame(rows[k * 40 : k * 40 + 40], schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # a processing-time timeout asks for them without end
    query = tracker.track(tracker.read_fixes(spark, f"{tmp_path}/in")).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    assert query.awaitTermination(240)
    got = {r["fix_id"]: r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    fixes = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_millis("t_ms"))
    want = {r["fix_id"]: r["verdict"] for r in tracking.judge_fixes(fixes).collect()}
    assert {i: r["verdict"] for i, r in got.items()} == want
    ok = [r for r in rows if want[r[1]] == "ok"]
    alarms = 0
    for d in range(4):
        since = alarmed = None
        for _, i, t, _, _, _, offset, _ in (r for r in ok if r[0] == d):
            since, alarmed = (t if since is None else since, alarmed) if offset > 30 else (None, None)
            fire = since is not None and not alarmed and t - since >= 3000
            alarmed = alarmed or fire
            alarms += fire
            assert got[i]["off_route"] == bool(fire)
    assert alarms


def test_pbf_round_trip(spark, tmp_path):
    osm_pbf.register(spark)
    member = [("way", 7, "outer"), ("node", 5, "")]
    rows = [("node", 5, 285000001, 775000002, None, None, {"name": "é"}), ("node", 13000000000, -1, -899999999, None, None, {}), ("way", 7, None, None, [5, 13000000000, 5], None, {"highway": "primary"}), ("way", 8, None, None, [5], None, {}), ("relation", 9, None, None, None, member, {"type": "restriction"})]
    df = spark.createDataFrame(rows, osm_pbf.SCHEMA.replace(", ord bigint", "")).withColumn("ord", F.lit(0).cast("long"))
    df.coalesce(1).write.format("osm_pbf").mode("append").save(f"{tmp_path}/out")
    path = f"{tmp_path}/out/part-00000.osm.pbf"
    assert osm_pbf.header(path)["required"] == ["OsmSchema-V0.6"]
    got = spark.read.format("osm_pbf").load(path).orderBy("ord").collect()
    assert [(r["kind"], r["id"], r["lat_e7"], r["lon_e7"], r["refs"], r["members"] and [tuple(m) for m in r["members"]], r["tags"]) for r in got] == [r for r in rows if r[1] != 8]


def test_pbf_rejects_broken_files(tmp_path):
    (tmp_path / "x.pbf").write_bytes(b"\xff\xff\xff\xff")
    with pytest.raises(ValueError):
        list(osm_pbf.blobs(str(tmp_path / "x.pbf")))
    with pytest.raises(ValueError):
        osm_pbf.inflate(b"\x22\x01a")


def test_load_or_build(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    key = tables.cache_key(spark, {"lat": (1, 2)}, [("b", "2"), ("a", "1")])
    assert key == tables.cache_key(spark, {"lat": (1, 2)}, [("a", "1"), ("b", "2")])
    for _ in range(2):
        assert tables.load_or_build(spark, f"{tmp_path}/t", key, build).count() == 3
    assert len(built) == 1
    with pytest.raises(ValueError):
        spark.range(0).write.parquet(f"{tmp_path}/e")
        tables.read_places(spark, f"{tmp_path}/e")
