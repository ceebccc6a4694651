"""The built network, chains, clusters, audits and shown state on small graphs whose results are known."""

import datetime
import random

from pyspark.sql import functions as F

from waygrid.functions import display
from waygrid.functions.geo import haversine
from waygrid.operators import audits, network, shown, tracking


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_a_missing_coordinate_gives_no_distance(spark):
    df = spark.createDataFrame([(None, 1.0), (1.0, 1.0), (0.0, 180.0)], "a double, o double")
    got = [r[0] for r in df.select(haversine(F.col("a"), F.col("o"), F.lit(0.0), F.lit(0.0))).collect()]
    assert got[0] is None and got[1] > 0 and abs(got[2] - 20_015_114.442) < 1
    t = datetime.datetime(2020, 1, 1)
    fixes = spark.createDataFrame([(1, 1, t, 28.0, 77.0), (1, 2, t + datetime.timedelta(seconds=1), 28.0, 77.0)], "device_id long, fix_id long, ts timestamp, lat double, lon double")
    assert rows(tracking.cumulative(fixes), "fix_id", "travelled_m") == [(1, 0.0), (2, 0.0)]


def test_numbers_are_consecutive_in_order(spark):
    values = random.Random(3).sample(range(10_000), 500)
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(7)
    assert rows(network.numbered(df, ["v"], "n"), "n", "v") == list(enumerate(sorted(values)))
    assert network.numbered(df.filter("v < 0"), ["v"], "n").count() == 0


NODES = [(i, 28.0 + i * 0.001, 77.0) for i in range(1, 8)]
# Way 1 is a two-way road 1-2-3, way 2 a one-way road 3-4 that nothing leads back from, way 3 a footpath, way 4 closed to cars.
WAYS = [(1, {"highway": "primary", "name": "Main"}), (2, {"highway": "secondary", "oneway": "yes"}), (3, {"highway": "footway"}), (4, {"highway": "tertiary", "access": "no", "ref": "T1"})]
REFS = [(1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 0, 3), (2, 1, 4), (3, 0, 4), (3, 1, 5), (4, 0, 3), (4, 1, 6), (1, 3, 99)]


def built(spark):
    refs = spark.createDataFrame(REFS, "way_id long, pos int, node_id long")
    ways = spark.createDataFrame(WAYS, "way_id long, tags map<string,string>")
    return ways, network.build(refs, ways, spark.createDataFrame(NODES, "node_id long, lat double, lon double"))


def test_build_keeps_the_largest_component(spark):
    ways, b = built(spark)
    assert rows(b["vertices"], "vertex_id", "node_id") == [(0, 1), (1, 3)]
    assert rows(b["edges"], "edge_id", "edge_from", "edge_to", "way_id", "reversed", "name_id") == [(0, 0, 1, 1, 0, 0), (1, 1, 0, 1, 1, 0)]
    assert abs(b["edges"].first()["length_m"] - 222.39) < 0.1
    stats = network.build_stats(b).first()
    assert (stats.vertices_before, stats.edges_before, stats.oneway_edges, stats.vertices_after, stats.edges_after) == (3, 3, 1, 2, 2)
    asked = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 5)], "way_id long")
    got = rows(network.way_verdicts(asked, ways, b["edges"]), "way_id", "cause", "name")
    assert got == [(1, "present", "Main"), (2, "dropped-by-scc", ""), (3, "excluded-by-profile", ""), (4, "excluded-by-profile", "T1"), (5, "outside-build-area", "")]


def test_build_of_nothing(spark):
    empty = spark.createDataFrame([], "way_id long, pos int, node_id long")
    b = network.build(empty, spark.createDataFrame(WAYS, "way_id long, tags map<string,string>"), spark.createDataFrame(NODES, "node_id long, lat double, lon double"))
    assert b["edges"].count() == 0 and b["vertices"].count() == 0


def test_relations_count_nested_members_before_the_first_that_touches(spark):
    tags = {1: {"type": "boundary"}, 2: {"type": "site"}, 3: {"type": "site", "name": "x"}, 4: {"type": "restriction"}}
    members = [(1, 0, "relation", 9), (1, 1, "way", 5), (1, 2, "relation", 9), (2, 0, "way", 5), (3, 0, "relation", 5), (3, 1, "node", 8), (4, 0, "node", 7)]
    got = network.clip_relations(
        spark.createDataFrame(list(tags.items()), "rel_id long, tags map<string,string>"), spark.createDataFrame(members, "rel_id long, pos int, kind string, ref long"),
        spark.createDataFrame([(5,)], "way_id long"), spark.createDataFrame([(7,)], "node_id long"),
    )
    assert rows(got, "rel_id", "kept", "nested") == [(1, True, 1), (3, False, 1), (4, True, 0)]


def walked(ways):
    """Runs by walking: heads first, then rings from their smallest way."""
    starts, ends, before = {}, {}, {}
    for way_id, head, tail, _ in sorted(ways):
        starts.setdefault(head, []).append(way_id)
        ends.setdefault(tail, []).append(way_id)
    for node, ids in starts.items():
        before |= dict(zip(ids, ends.get(node, [])))
    after, metres = {b: w for w, b in before.items()}, {w[0]: w[3] for w in ways}
    out = {}
    for first in [w[0] for w in sorted(ways) if w[0] not in before] + sorted(w[0] for w in ways):
        w, at = first, 0.0
        while w is not None and w not in out:
            out[w] = (first, at)
            at, w = at + metres[w], after.get(w)
    return sorted((w, run, round(at, 6)) for w, (run, at) in out.items())


def test_chains_like_walking(spark):
    rng = random.Random(5)
    for n, ways in ((6, 30), (40, 30), (3, 1), (25, 60)):
        made = [(i, rng.randrange(n), rng.randrange(n), float(rng.randrange(1, 9))) for i in range(ways)]
        got = network.chain(spark.createDataFrame(made, "way_id long, head long, tail long, metres double"))
        assert sorted((r.way_id, r.run, round(r.start_m, 6)) for r in got.collect()) == walked(made)


def test_chainage_counts_from_the_southern_end(spark):
    refs = [(w, p, n, 28.0 + n * 0.01, 77.0) for w, nodes in ((1, (3, 2)), (2, (2, 1, 0))) for p, n in enumerate(nodes)]
    got = network.chainage(spark.createDataFrame(refs, "way_id long, pos int, node_id long, lat double, lon double"), 100.0).orderBy("node_id").collect()
    assert [r.run for r in got] == [1] * 4 and abs(got[0].km_from_south) < 1e-9
    assert abs(got[3].km_from_south - 3.3358) < 1e-3 and abs(got[3].chainage_km - (100 - 3.3358)) < 1e-3


def test_clusters_measure_from_their_start(spark):
    points = spark.createDataFrame([("a", x) for x in (0.0, 1.5, 1.9, 2.0, 3.9, 4.1)] + [("b", 7.0), ("b", None)], "road string, km double")
    assert rows(audits.clusters(points, "road", "km", 2.0), "road", "start", "held") == [("a", 0.0, 3), ("a", 2.0, 2), ("a", 4.1, 1), ("b", 7.0, 1)]
    assert audits.clusters(points.filter("km > 100"), "road", "km").count() == 0


def test_anchor_and_nearest_plaza(spark):
    plazas = (10.0, 20.0, 40.0)
    features = spark.createDataFrame([("r", 130.25 - p) for p in plazas], "road string, km double")
    best = audits.fit_anchor(features, "road", "km", plazas).first()
    assert (best.anchor, best.total) == (130.25, 0.0)
    near = spark.createDataFrame([(11.0,), (15.0,), (50.0,)], "p double").select("p", audits.nearest_value(F.col("p"), plazas, 6.0).alias("n")).select("p", "n.*")
    assert rows(near, "p", "value", "residual") == [(11.0, 10.0, -1.0), (15.0, 10.0, -5.0), (50.0, None, -10.0)]


def test_divergence_is_ruled_out_in_order(spark):
    cases = [(300.0, 1, 100.0, 50.0, 1.0), (300.0, 0, 100.0, 50.0, 1.0), (200.0, 1, None, 50.0, 1.0), (0.0, 0, 500.0, 100.0, 1.0), (0.0, 0, 500.0, 100.0, 300.0), (0.0, 0, 500.0, 470.0, 1.0), (0.0, 0, 100.0, 100.0, 1.0)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, uncovered double, missing int, matched double, theirs double, error double")
    got = df.orderBy("i").select(audits.divergence_verdict(*[F.col(c) for c in ("uncovered", "missing", "matched", "theirs", "error")])).collect()
    assert [r[0] for r in got] == ["OUTSIDE AREA", "GRAPH", "UNDECIDED", "ROUTER", "TOO CLOSE TO CALL", "TOO CLOSE TO CALL", "COST MODEL"]


def test_causes_of_pairs(spark):
    pairs = spark.createDataFrame([("a",), ("b",)], "pair string")
    assert rows(audits.causes(pairs, spark.createDataFrame([("a", "GRAPH")], "pair string, cause string"), "pair"), "pair", "cause") == [("a", "GRAPH"), ("b", "-")]


def test_calls_wait_a_second_and_arrivals_a_change(spark):
    fixes = spark.createDataFrame([(1, i, t, r) for i, (t, r) in enumerate(((500, False), (1000, False), (1900, False), (2000, True), (2100, False)))], "device_id long, fix_id long, t_ms long, on_route boolean")
    assert rows(shown.match_calls(fixes), "fix_id", "call") == [(0, False), (1, True), (2, False), (3, False), (4, True)]
    progress = spark.createDataFrame([(1, i, t, left) for i, (t, left) in enumerate(((1000, 100.0), (1500, 10.0), (2000, 80.0), (3000, 70.0), (3500, 10.0)))], "device_id long, fix_id long, t_ms long, remaining_s double")
    assert rows(shown.shown_arrival(progress), "fix_id", "shown_s") == [(0, 100.0), (1, 100.0), (2, 100.0), (3, 70.0), (4, 70.0)]
    line = spark.createDataFrame([(1, i, i, at, 28.0 + m / 111_195, 77.0) for i, (at, m) in enumerate(((0, 0), (0, 2), (0, 4), (0, 6), (1, 6)))], "device_id long, fix_id long, t_ms long, at int, lat double, lon double")
    assert rows(shown.redraws(line), "fix_id", "redraw") == [(0, True), (1, False), (2, True), (3, False), (4, True)]


def test_what_is_shown_and_asked(spark):
    assert [display.search_limit(x) for x in (None, float("nan"), 0, 3.9, 99)] == [8, 8, 1, 3, 25]
    df = spark.createDataFrame([(94.9, "exact", "none"), (974.0, "exact", "estimated"), (1049.0, "none", "none"), (96.0, "exact", "exact")], "m double, a string, b string")
    got = df.select(display.banner_metres(F.col("m")), display.weaker_display(F.col("a"), F.col("b")), display.approach_gap(F.col("m") - 80)).collect()
    assert [tuple(r) for r in got] == [(90.0, "none", None), (950.0, "estimated", 894.0), (1000.0, "none", 969.0), (100.0, "exact", None)]
    north = spark.range(1).select(display.vertex_bearing(F.lit(28.0), F.lit(77.0), F.lit(28.1), F.lit(77.0)), display.vertex_bearing(F.lit(28.0), F.lit(77.0), F.lit(28.0), F.lit(76.9))).first()
    assert tuple(north) == (0.0, 270.0)
    tags = [{"place": "city", "amenity": "bank"}, {"place": "island", "amenity": "bank", "name": "x"}, {"amenity": "bank"}, {"amenity": "bench", "shop": "", "tourism": "zoo", "name": "z"}, {"type": "boundary", "boundary": "administrative"}]
    layers = spark.createDataFrame([(t,) for t in tags], "tags map<string,string>").select(display.node_layer().alias("l"), display.tiled_relation().alias("r")).collect()
    assert [r.l and tuple(r.l) for r in layers] == [("place", "city", 1, 6), ("poi", "bank", None, 14), None, ("poi", "zoo", None, 14), None]
    assert [r.r for r in layers] == [False] * 4 + [True]
