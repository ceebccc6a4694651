"""Elements written by kind and id over partitions, and read back; places built in order; road clusters by parts."""

import random

from pyspark.sql import functions as F

from waygrid.operators import places
from waygrid.operators.tracking import metres
from waygrid.sinks import osm_pbf as sink
from waygrid.sources import osm_pbf

SCHEMA = osm_pbf.SCHEMA.replace(", ord bigint", "")


def elements(rng, nodes=20000, ways=3000):
    ids = rng.sample(range(1, 1 << 40), nodes)
    rows = [("node", i, rng.randrange(-900000000, 900000000), rng.randrange(-1800000000, 1800000000), None, None, {"name": f"कासना {i % 7}", "k": "v"} if i % 3 == 0 else {}) for i in ids]
    for w in rng.sample(range(1, 1 << 41), ways):
        refs = [rng.choice(ids) if rng.random() < 0.9 else -rng.randrange(1, 99) for _ in range(rng.randrange(0, 9))]
        rows.append(("way", w, None, None, refs, None, {"oneway": "-1", "highway": "tertiary"}))
    rows.append(("relation", 9, None, None, None, [("way", 7, "outer"), ("node", 5, ""), ("relation", 8, "via")], {"type": "restriction"}))
    rows.append(("relation", 3, None, None, None, None, {}))
    rng.shuffle(rows)
    return rows


def test_sorted_round_trip(spark, tmp_path):
    osm_pbf.register(spark)
    rows = elements(random.Random(3))
    here = {r[1] for r in rows if r[0] == "node"}
    spark.createDataFrame(rows[:5], SCHEMA).withColumn("ord", F.lit(0).cast("long")).write.format("osm_pbf").mode("append").save(f"{tmp_path}/out")
    told = sink.write_sorted(spark.createDataFrame(rows, SCHEMA).repartition(7), f"{tmp_path}/out", files=3).collect()[0]
    kept = {r[1]: [x for x in r[4] if x in here] for r in rows if r[0] == "way"}
    assert told.asDict() == {"nodes": 20000, "ways": sum(len(k) > 1 for k in kept.values()), "relations": 2, "dangling": sum(len(r[4]) for r in rows if r[0] == "way") - sum(map(len, kept.values())), "too_short": sum(len(k) < 2 for k in kept.values())}
    want = sorted(((r[0], r[1], r[2], r[3], kept.get(r[1]) if r[0] == "way" else None, r[5], r[6]) for r in rows if r[0] != "way" or len(kept[r[1]]) > 1), key=lambda r: (("node", "way", "relation").index(r[0]), r[1]))
    got = spark.read.format("osm_pbf").load(f"{tmp_path}/out").orderBy("ord").collect()
    for g, w in zip(got, want, strict=True):
        members = [tuple(m) for m in g["members"]] if g["members"] is not None else None
        assert (g["kind"], g["id"], g["lat_e7"], g["lon_e7"], g["refs"], members or None, g["tags"]) == (*w[:5], w[5], w[6])
    head = osm_pbf.header(sink.parts(f"{tmp_path}/out")[0])
    assert head["required"] == ["OsmSchema-V0.6", "DenseNodes"]
    assert head["optional"] == ["Sort.Type_then_ID"]
    lats, lons = ([r[i] / 1e7 for r in rows if r[0] == "node"] for i in (2, 3))
    assert all(abs(a - b) < 1e-9 for a, b in zip(head["bbox"], [min(lons), max(lons), max(lats), min(lats)]))
    assert len(sink.parts(f"{tmp_path}/out")) == 3


def test_append_keeps_earlier_parts(spark, tmp_path):
    osm_pbf.register(spark)
    for i in (1, 2):
        spark.createDataFrame([("node", i, 1, 2, None, None, {})], SCHEMA).withColumn("ord", F.lit(0).cast("long")).coalesce(1).write.format("osm_pbf").mode("append").save(f"{tmp_path}/out")
    assert [r["id"] for r in spark.read.format("osm_pbf").load(f"file://{tmp_path}/out").orderBy("ord").collect()] == [1, 2]


def test_empty_elements(spark, tmp_path):
    osm_pbf.register(spark)
    assert set(sink.write_sorted(spark.createDataFrame([], SCHEMA), f"{tmp_path}/out").collect()[0]) == {0}
    assert spark.read.format("osm_pbf").load(f"{tmp_path}/out").count() == 0


def test_places_in_locale_order(spark):
    """Accents come after their letters and before the next, case is last, and Devanagari follows Latin."""
    names = ["Zebra", "zebra", "eclair", "éclair", "Éclair", "f", "कासना", "दनकौर", "apple", "Äpfel", "apple"]
    df = spark.createDataFrame([(i, n, 9 if n == "f" else 1) for i, n in enumerate(names)], "place_id long, name string, importance int")
    got = [(r["name"], r["place_id"]) for r in places.build_order(df).orderBy("place").collect()]
    assert [g[0] for g in got] == ["f", "Äpfel", "apple", "apple", "eclair", "éclair", "Éclair", "zebra", "Zebra", "कासना", "दनकौर"]
    assert [g[1] for g in got if g[0] == "apple"] == [8, 10]


def test_clusters_by_parts(spark):
    """As one fold over each name, with ways round the poles, on both sides of the 180th meridian and in long rows."""
    rng, rows = random.Random(8), []
    for i in range(3000):
        name = rng.choice(["hot"] * 8 + ["b", "c", "north"])
        lat, lon = rng.choice([(28.5, 77.5), (28.5, 78.5), (0.0, 179.99), (0.0, -179.99), (84.0, 10.0), (-60.0, 5.0)])
        lat, lon = (89.5, rng.uniform(-180, 180)) if name == "north" else (lat + rng.uniform(-0.2, 0.2), max(-180.0, min(180.0, lon + rng.uniform(-0.2, 0.2))))
        rows.append((i, name, rng.randrange(9), lat, lon))
    want = {}
    for i, name, rank, lat, lon in rows:
        held = want.setdefault(name, [])
        near = next((c for c in held if metres(c[2] / c[4], c[3] / c[4], lat, lon) <= 6000), None)
        if near is None:
            held.append([i, rank, lat, lon, 1])
        else:
            near[1:] = [max(near[1], rank), near[2] + lat, near[3] + lon, near[4] + 1]
    df = spark.createDataFrame(rows + [(9999, None, 1, 1.0, 1.0), (9998, "b", 1, None, 1.0)], "way_id long, norm string, rank int, lat double, lon double")
    got = sorted((r["norm"], r["way_id"], r["rank"], r["ways"]) for r in places.cluster_roads(df).collect())
    assert got == sorted((n, c[0], c[1], c[4]) for n, held in want.items() for c in held)
    parts = places._parted(df.filter("norm = 'hot' and lat is not null"), 6000.0).select("norm", "band", "part").distinct().count()
    assert parts >= 5
    assert places.cluster_roads(df.limit(0)).count() == 0


def test_layers_of_ways(spark):
    from waygrid.functions import tiles

    ways = [
        (1, {"highway": "primary", "name": "A", "ref": "NE2", "oneway": "reverse", "junction": "roundabout"}, False), (2, {"highway": "proposed", "building": "yes"}, True), (3, {"waterway": "riverbank", "water": ""}, True),
        (4, {"landuse": "reservoir", "leisure": "park", "water": "pond"}, True), (5, {"landuse": "forest", "leisure": "park", "name": ""}, True), (6, {"building": "yes"}, False), (7, {"building": "yes"}, True),
        (8, {"boundary": "administrative", "admin_level": "6"}, False), (9, {"boundary": "administrative", "admin_level": "x"}, False), (10, {}, True), (11, None, True), (12, {"highway": "", "waterway": "river"}, False),
    ]
    df = spark.createDataFrame(ways, "id long, tags map<string, string>, closed boolean").select("id", F.explode(tiles.way_layers()).alias("l"))
    got = sorted((r["id"], *r["l"]) for r in df.collect())
    assert got == [
        (1, "transportation", "primary", 8, -1, True, "NE2", None, None), (1, "transportation_name", "primary", 12, None, None, "NE2", "A", None), (3, "water", "lake", 8, None, None, None, None, None),
        (4, "water", "pond", 8, None, None, None, None, None), (5, "landuse", "park", 11, None, None, None, None, None), (7, "building", None, 14, None, None, None, None, None),
        (8, "boundary", None, 6, None, None, None, None, 6.0), (12, "waterway", "river", 8, None, None, None, None, None),
    ]
