"""Toy graphs and traces with answers known by hand or by brute force."""

import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from waygrid.config import Tracking
from waygrid.functions import geo, strings, tiles
from waygrid.operators import analytics, graph, ingest, instructions, places, profile, routing, search, spatial, tracking
from waygrid.plans import catalog
from waygrid.sources import projection


def test_strong_components(spark):
    rng = random.Random(3)
    arcs = sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(60)})
    reach = {v: {v} for a in arcs for v in a}
    for _ in range(41):
        for a, b in arcs:
            reach[a] |= reach[b]
    want = {v: min(w for w in reach if w in reach[v] and v in reach[w]) for v in reach if any(v in a for a in arcs if a[0] != a[1])}
    got = {r["vertex_id"]: r["component"] for r in graph.strong_components(spark.createDataFrame(arcs, "edge_from long, edge_to long")).collect()}
    assert got == want


@pytest.mark.parametrize("arcs", [[(1, 1)], [(i, i + 1) for i in range(6)], [(i, i + 1) for i in range(30)] + [(i + 1, i) for i in range(30)] + [(30, 31), (31, 32), (32, 7), (5, 99)]])
def test_strong_components_of_chains(spark, arcs):
    got = {r["vertex_id"]: r["component"] for r in graph.strong_components(spark.createDataFrame(arcs, "edge_from long, edge_to long")).collect()}
    assert got == ({} if arcs == [(1, 1)] else {v: v for v in range(7)} if len(arcs) == 6 else {**dict.fromkeys(range(33), 0), 99: 99})


def test_strong_components_cover_the_network(spark, sf_dir):
    out = {}
    for r in projection.edges(spark, sf_dir).select("edge_from", "edge_to").collect():
        if r[0] != r[1]:
            out.setdefault(r[0], set()).add(r[1])
            out.setdefault(r[1], set())

    def reach(v):
        seen, todo = {v}, [v]
        while todo:
            for w in out[todo.pop()] - seen:
                seen.add(w)
                todo.append(w)
        return seen

    seen = {v: reach(v) for v in out}
    want = {v: min(w for w in seen[v] if v in seen[w]) for v in out}
    got = {r["vertex_id"]: r["component"] for r in catalog.QUERIES["strong_components"](spark, sf_dir).collect()}
    assert got == want
    most = max(set(want.values()), key=lambda c: (list(want.values()).count(c), -c))
    assert {r["vertex_id"] for r in catalog.QUERIES["largest_component"](spark, sf_dir).collect()} == {v for v in want if want[v] == most}


@pytest.fixture(scope="module")
def network(spark, sf_dir):
    edges = graph.costs(projection.edges(spark, sf_dir)).cache()
    return edges, graph.turn_costs(edges).cache()


def test_whole_searches(spark, sf_dir, network):
    edges, turns = network
    rows = [tuple(r) for r in edges.select("edge_id", "edge_from", "edge_to", "secs").collect()]

    def hops(arcs):
        seen, layer = {0: 0}, {0}
        while layer:
            layer = {b for a, b in arcs if a in layer} - set(seen)
            seen.update(dict.fromkeys(layer, max(seen.values()) + 1))
        return seen

    there, back = hops({(a, b) for _, a, b, _ in rows}), hops({(b, a) for _, a, b, _ in rows})
    got = {r["vertex_id"]: (r["hops"], r["hops_back"]) for r in catalog.QUERIES["reachable_vertices_all"](spark, sf_dir).collect()}
    assert max(there.values()) > catalog._HOPS and got == {v: (there.get(v), back.get(v)) for v in {*there, *back}}
    banned = {tuple(r) for r in catalog._bans(edges).select("from_edge", "to_edge").collect()}
    secs, after = {e: s for e, _, _, s in rows}, {}
    for a, b, s in turns.select("edge_in", "edge_out", F.col("seconds").cast("double")).collect():
        if (a, b) not in banned:
            after.setdefault(a, []).append((b, s + secs[b]))
    depots = {r[0]: r[1] for r in projection.read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.min("c_custkey")).collect()}
    got = {(r["search"], r["edge_id"]): r["cost"] for r in catalog.QUERIES["depot_costs_all"](spark, sf_dir).collect()}
    want = {}
    for search, depot in depots.items():
        todo, best = [(s, e) for e, a, _, s in rows if a == depot], {}
        heapq.heapify(todo)
        while todo:
            c, e = heapq.heappop(todo)
            if e not in best:
                best[e] = c
                for b, s in after.get(e, ()):
                    heapq.heappush(todo, (c + s, b))
        want |= {(search, e): c for e, c in best.items()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-4 for k in want)


def test_ramps_of_a_long_chain(spark, monkeypatch):
    chain = spark.createDataFrame([(w, n) for w in range(9) for n in (w, w + 1)], "way_id long, node_id long")
    monkeypatch.setattr(catalog, "_way_nodes", lambda *_: chain)
    few, whole = ({r["way_id"] for r in catalog.QUERIES[q](spark, "").collect()} for q in ("ramp_roads", "ramp_roads_all"))
    assert few == set(range(5)) and whole == set(range(9))


def test_both_routers_agree(spark, network):
    edges, turns = network
    pairs = spark.createDataFrame([(i, i * 7 % 150, i * 31 % 150) for i in range(20)], "query_id long, origin long, target long").filter("origin <> target")
    triples = spark.createDataFrame([], "from_edge long, via_edge long, to_edge long")
    found = {r["query_id"]: r["seconds"] for r in routing.routes(pairs, edges, turns, triples=triples).collect()}
    seeds = edges.join(pairs, F.col("edge_from") == F.col("origin")).select(F.col("query_id").alias("search"), "edge_id", F.col("secs").alias("cost"))
    best = routing.relax(edges, turns, seeds, 40, every=5)
    ends = edges.select("edge_id", "edge_to")
    want = best.join(ends, "edge_id").join(pairs, (F.col("search") == F.col("query_id")) & (F.col("edge_to") == F.col("target"))).groupBy("query_id").agg(F.min("cost").alias("cost"))
    want = {r["query_id"]: r["cost"] for r in want.collect()}
    assert {q for q, s in found.items() if s is not None} == set(want)
    assert all(abs(found[q] - want[q]) < 1e-6 for q in want)


def test_parts_add_up_and_triples_hold(spark, network):
    edges, turns = network
    pairs = spark.createDataFrame([(i, i, (i * 13 + 41) % 150) for i in range(30)], "query_id long, origin long, target long").filter("origin <> target")
    free = routing.routes(pairs, edges, turns).cache()
    for r in routing.assemble(free, edges, turns).collect():
        assert abs(r["drive_s"] + r["distance_s"] + r["toll_s"] + r["turn_s"] - r["seconds"]) < 1e-6
    used = [r["path"] for r in free.collect() if r["path"] and len(r["path"]) >= 3]
    bans = spark.createDataFrame([tuple(p[:3]) for p in used[:10]], "from_edge long, via_edge long, to_edge long")
    after = routing.routes(pairs, edges, turns, triples=bans).filter("path is not null").select("query_id", F.posexplode("path").alias("i", "edge_id"))
    none = spark.createDataFrame([], "from_edge long, to_edge long")
    steps = after.withColumnRenamed("query_id", "path_id")
    assert graph.illegal_steps(steps, none, bans).count() == 0
    before = free.filter("path is not null").select(F.col("query_id").alias("path_id"), F.posexplode("path").alias("i", "edge_id"))
    assert graph.illegal_steps(before, none, bans).count() > 0


def test_spatial_join_against_brute_force(spark):
    rng = random.Random(8)
    points = [(i, 28.1 + rng.random() / 20, 77.4 + rng.random() / 20) for i in range(60)]
    segments = [(i, a, o, a + (rng.random() - 0.5) / 100, o + (rng.random() - 0.5) / 100) for i in range(80) for a, o in [(28.1 + rng.random() / 20, 77.4 + rng.random() / 20)]]
    p, s = spark.createDataFrame(points, "fix_id long, lat double, lon double"), spark.createDataFrame(segments, "edge_id long, alat double, alon double, blat double, blon double")

    def distance(lat, lon, a, o, b, q):
        k = math.cos(math.radians(lat))
        bx, by, px, py = (q - o) * k, b - a, (lon - o) * k, lat - a
        t = max(0, min(1, (px * bx + py * by) / (bx * bx + by * by)))
        return tracking.metres(lat, lon, a + t * (b - a), o + t * (q - o))

    want = {(i, e) for i, lat, lon in points for e, *ends in segments if distance(lat, lon, *ends) <= 700}
    assert {(r["fix_id"], r["edge_id"]) for r in spatial.pairs_within(p, s, 700, "fix_id", "edge_id").collect()} == want
    nearest = {r["fix_id"]: r["edge_id"] for r in spatial.nearest(p, s, 700, "fix_id", "edge_id").collect()}
    assert nearest == {i: min((distance(lat, lon, *ends), e) for e, *ends in segments if (i, e) in want)[1] for i, lat, lon in points if any(x == i for x, _ in want)}


def test_profile(spark):
    rows = [(1, {"highway": "motorway"}), (2, {"highway": "residential", "oneway": "-1", "maxspeed": "30 mph"}), (3, {"highway": "primary", "access": "private", "motorcar": "no"}), (4, {"highway": "footway"}), (5, {"highway": "service", "junction": "roundabout", "maxspeed": "fast", "toll": "yes", "ref": "NE-2"}), (6, {})]
    got = {r["way_id"]: r for r in profile.classify(spark.createDataFrame(rows, "way_id long, tags map<string,string>")).collect()}
    assert (got[1]["forward"], got[1]["backward"], got[1]["speed_kmh"]) == (True, False, 90)
    assert (got[2]["forward"], got[2]["backward"], got[2]["speed_kmh"]) == (False, True, 48)
    assert not got[3]["drivable"] and not got[4]["drivable"] and not got[6]["drivable"]
    assert (got[5]["backward"], got[5]["speed_kmh"], got[5]["toll_road"]) == (False, 15, 2)


def test_ingest(spark):
    ways = spark.createDataFrame([(1, 0, 10), (1, 1, 10), (1, 2, 11), (1, 3, 99), (2, 0, 11), (2, 1, 12), (3, 0, 10), (3, 1, 10)], "way_id long, pos int, node_id long")
    nodes = spark.createDataFrame([(10, 1), (11, 2), (12, 3)], "node_id long, lat_e7 int")
    resolved = ingest.resolve(ways, nodes)
    assert sorted((r["way_id"], r["node_id"]) for r in resolved.collect()) == [(1, 10), (1, 11), (2, 11), (2, 12)]
    inside = nodes.filter("node_id = 12")
    assert [r["way_id"] for r in ingest.ways_in_area(ways, inside).collect()] == [2]
    assert [r["node_id"] for r in ingest.complete_nodes(ways, ingest.ways_in_area(ways, inside), inside).collect()] == [11]
    pieces = graph.split_ways(spark.createDataFrame([(1, i, n) for i, n in enumerate((5, 6, 7, 8))] + [(2, 0, 7), (2, 1, 9)], "way_id long, pos int, node_id long"), spark.createDataFrame([(5,), (7,), (8,), (9,)], "node_id long"))
    assert sorted((r["way_id"], r["node_from"], r["node_to"], r["n_nodes"]) for r in pieces.collect()) == [(1, 5, 7, 3), (1, 7, 8, 2), (2, 7, 9, 2)]


def test_search(spark):
    rows = [(1, "Pari Chowk", "locality", 50, 28.46, 77.51), (2, "Paris Café", "amenity", 30, 28.5, 77.4), (3, "Alpha Pari", "shop", 26, 28.4, 77.4), (4, "Sector 12", "locality", 40, 28.4, 77.4), (5, "Sector 21", "locality", 60, 28.4, 77.4)]
    index = search.build_index(spark.createDataFrame(rows, "place_id long, name string, kind string, importance int, lat double, lon double"))
    asked = spark.createDataFrame([(1, "pari", None, None), (2, "pair chowk", None, None), (3, "sectro 12", None, None), (4, "cafe", 28.5, 77.4), (5, "zzz", None, None)], "query_id long, q string, qlat double, qlon double")
    hits = {}
    for r in search.search(index, asked).orderBy("query_id", "rank").collect():
        hits.setdefault(r["query_id"], []).append((r["place_id"], round(r["score"], 3)))
    assert hits[1] == [(1, 75.0), (2, 55.0), (3, 41.0)]
    assert hits[2][0] == (1, round(0.35 * 50 - 30, 3))
    assert [p for p, _ in hits[3]] == [4]  # digits must agree
    assert hits[4] == [(2, 100.0)] and 5 not in hits


def test_edit_distance():
    assert strings.edit_distance("ab", "ba", 3) == 1 and strings.edit_distance("ca", "abc", 5) == 3 and strings.edit_distance("kitten", "sitting", 2) == 3


def test_text(spark):
    r = spark.createDataFrame([("É  Rue-d'Or 12,b", "Main Road Flyover Bridge")], "a string, b string").select(strings.normalise(F.col("a")).alias("n"), strings.base_name(F.col("b")).alias("base"), strings.digits_of(F.col("a")).alias("d")).first()
    assert tuple(r) == ("e rue d or 12 b", "main road", "12")


def test_tiles(spark):
    rows = spark.createDataFrame([(0, 0, 0), (1, 0, 0), (1, 0, 1), (1, 1, 1), (1, 1, 0), (2, 0, 0), (3, 7, 0)], "z long, x long, y long")
    assert [r[0] for r in rows.select(tiles.tile_id("z", "x", "y")).collect()] == [0, 1, 2, 3, 4, 5, 84]
    every = spark.range(4096).select(F.lit(6).alias("z"), (F.col("id") % 64).alias("x"), F.floor(F.col("id") / 64).alias("y")).select("x", "y", tiles.tile_id("z", "x", "y").alias("t")).orderBy("t").collect()
    assert all(abs(a["x"] - b["x"]) + abs(a["y"] - b["y"]) == 1 for a, b in zip(every, every[1:]))


def test_judge_fixes():
    cfg = Tracking()
    last = (28.5, 77.5, 5.0, 1000)
    assert tracking.judge_fix(None, (28.5, 77.5, 41.0, 0), cfg) == "accuracy"
    assert tracking.judge_fix(None, (28.5, 77.5, float("nan"), 0), cfg) == "accuracy"
    assert tracking.judge_fix(last, (28.5, 77.5, 5.0, 1000), cfg) == "out-of-order"
    assert tracking.judge_fix(last, (28.51, 77.5, 5.0, 2000), cfg) == "implied-speed"
    assert tracking.judge_fix(last, (28.5001, 77.5, 5.0, 2000), cfg) == "ok"


def test_match_on_a_divided_road(spark):
    """Two carriageways 18 m apart; headings decide, whichever is nearer, but only of a vehicle that moves."""
    columns = "device_id long, fix_id long, ts long, lat double, lon double, accuracy_m double, heading_deg double, speed_mps double"
    near = spark.createDataFrame([(i, e, d, 28.5 + i * 1e-4, lon, b) for i in range(6) for e, d, lon, b in ((10, 8.0, 77.5, 0.0), (11, 10.0, 77.50018, 180.0), (12, 30.0, 77.5004, 5.0))], "fix_id long, edge_id long, distance_m double, flat double, flon double, edge_bearing double")
    for heading, speed, edge in ((0.0, 10.0, 10), (180.0, 10.0, 11), (180.0, 1.0, 10), (None, 10.0, 10)):
        fixes = spark.createDataFrame([(1, i, i * 1000, 28.5 + i * 1e-4, 77.50008, 5.0, heading, speed) for i in range(6)], columns)
        row = tracking.match_traces(fixes, near).first()
        assert row["edge_id"] == edge and (speed < 2 or heading is None or row["probability"] > 0.9)
    assert tracking.match_traces(spark.createDataFrame([(1, 0, 0, 28.5, 77.5, 5.0, 90.0, 9.0)], columns), near).count() == 0


def test_match_in_windows(spark):
    """A window of twelve fixes is matched by itself."""
    fixes = spark.createDataFrame([(1, i, i * 1000, 28.5 + i * 1e-4, 77.5, 5.0, 0.0, 9.0) for i in range(30)], "device_id long, fix_id long, ts long, lat double, lon double, accuracy_m double, heading_deg double, speed_mps double")
    near = spark.createDataFrame([(i, 10 + i // 12, 1.0, 28.5 + i * 1e-4, 77.5, 0.0) for i in range(30)], "fix_id long, edge_id long, distance_m double, flat double, flon double, edge_bearing double")
    assert sorted((r["window"], r["edge_id"], r["probability"]) for r in tracking.match_traces(fixes, near).collect()) == [(0, 10, 1.0), (1, 11, 1.0), (2, 12, 1.0)]


def test_match_to_route_on_a_divided_road(spark):
    """East along one carriageway, back along the other 19 m south: the nearest point is on the wrong leg, the heading on the right one."""
    lats = [28.4712, 28.4712, 28.4712, 28.4712 - 19.39 / 111320, 28.4712 - 19.39 / 111320]
    lons = [77.5031, 77.5081, 77.5131, 77.5131, 77.5031]
    segments = spark.createDataFrame([(1, i, lats[i], lons[i], lats[i + 1], lons[i + 1]) for i in range(4)], "route_id long, seq long, alat double, alon double, blat double, blon double")
    at = 28.4712 - 12 / 111320, 77.5051
    rows = [(1, 1, *at, None, None), (2, 1, *at, 90.0, None), (3, 1, *at, 0.0, 10.0), (4, 1, *at, None, 150.0)]
    got = {r["fix_id"]: r for r in tracking.match_to_route(spark.createDataFrame(rows, "fix_id long, route_id long, lat double, lon double, heading double, last_m double"), segments).collect()}
    assert got[1]["seq"] == 3 and got[2]["seq"] == 0 and got[3]["seq"] is None and got[4]["seq"] == 0
    assert abs(got[2]["route_m"] - tracking.metres(28.4712, 77.5031, 28.4712, 77.5051)) < 0.1 and abs(got[2]["offset_m"] - 12) < 0.1


def test_smoothed_speed_of_a_long_trace(spark):
    speeds = [float(i * 37 % 29) for i in range(700)]
    fixes = spark.createDataFrame([(1, i, i, x) for i, x in enumerate(speeds)], "device_id long, fix_id long, ts long, speed_mps double")
    want, state = [], None
    for x in speeds:
        state = x if state is None else state * 0.7 + x * 0.3
        want.append(state)
    assert max(abs(r["speed"] - want[r["fix_id"]]) for r in tracking.smoothed_speed(fixes).collect()) < 1e-9


def test_build_again_after_a_write_that_died(spark, tmp_path):
    from waygrid.sinks import tables

    half = tmp_path / "t" / "key=k"
    half.mkdir(parents=True)
    (half / "part-0.parquet").write_bytes(b"half")
    for _ in range(2):
        assert tables.load_or_build(spark, str(tmp_path / "t"), "k", lambda: spark.range(3)).count() == 3


STEP = "query_id long, i long, name string, class_rank int, roundabout boolean, length_m double, bearing_in double, bearing_out double, speed_kmh int, choices int, exit_lat double, exit_lon double, exit_bearing double"


def told(spark, *steps):
    rows = [(1, i, name, rank, ring, m, into, out, 36, choices, *(off or (None,) * 3)) for i, (name, rank, ring, m, into, out, choices, off) in enumerate(steps)]
    return instructions.build(spark.createDataFrame(rows, STEP)).orderBy("n").collect()


def test_instructions(spark):
    got = told(
        spark, ("A", 4, False, 300.0, 0.0, 0.0, 2, None), ("A", 4, False, 300.0, 2.0, 2.0, 2, None), ("B", 4, False, 200.0, 92.0, 92.0, 2, None), (None, 1, False, 500.0, 92.0, 92.0, 2, None), ("C Flyover", 1, False, 200.0, 92.0, 92.0, 1, None),
        ("C", 1, False, 700.0, 92.0, 92.0, 2, None), ("R", 4, True, 20.0, 60.0, 120.0, 2, (28.0, 77.0, 90.0)), ("R", 4, True, 20.0, 120.0, 180.0, 2, (28.0, 77.001, 180.0)), ("D", 4, False, 400.0, 130.0, 130.0, 0, None),
    )
    assert [(r["kind"], r["name"], r["exit_number"]) for r in got] == [("depart", "A", None), ("turn-right", "B", None), ("merge", "C", None), ("roundabout-exit", "D", 2), ("arrive", "D", None)]
    assert [r["distance_m"] for r in got] == [0.0, 600.0, 200.0, 1400.0, 440.0] and got[1]["duration_s"] == 60.0
    assert [r["kind"] for r in told(spark, ("A", 4, False, 9.0, 0.0, 0.0, 2, None))] == ["depart", "arrive"]


def test_instructions_left_out(spark):
    near = ("X", 4, False, 8.0, 90.0, 90.0, 2, None), ("Y", 4, False, 30.0, 180.0, 180.0, 2, None), ("Z", 4, False, 90.0, 270.0, 270.0, 2, None)
    got = told(spark, ("A", 4, False, 100.0, 0.0, 0.0, 2, None), *near)
    # Y begins 8 m after X; Z is a right turn 38 m after the right turn into X.
    assert [r["kind"] for r in got] == ["depart", "turn-right", "arrive"]
    bend = told(spark, ("A", 4, False, 100.0, 0.0, 0.0, 2, None), ("A Bridge", 4, False, 100.0, 60.0, 60.0, 3, None), ("A", 4, False, 100.0, 130.0, 130.0, 3, None), ("A", 4, False, 10.0, 160.0, 160.0, 2, None))
    assert [r["kind"] for r in bend] == ["depart", "turn-right", "arrive"] and bend[1]["i"] == 2
    fork = told(spark, ("A", 4, False, 300.0, 0.0, 0.0, 3, None), ("B", 4, False, 300.0, 330.0, 330.0, 2, None), ("C", 4, False, 300.0, 330.0, 330.0, 2, None))
    assert [(r["kind"], r["name"]) for r in fork] == [("depart", "A"), ("fork-left", "B"), ("straight", "C"), ("arrive", "C")]
    ring = told(spark, ("A", 4, False, 300.0, 0.0, 0.0, 3, None), ("R", 4, True, 30.0, 330.0, 330.0, 2, None))
    assert [r["kind"] for r in ring] == ["depart", "roundabout-enter", "arrive"]


def test_places(spark):
    elements = spark.createDataFrame([(1, {"place": "town", "name": " Big  Town "}), (2, {"amenity": "hospital", "name:en": "H"}), (3, {"place": "unknown", "shop": "mall", "name": "M"}), (4, {"shop": "x"})], "id long, tags map<string,string>")
    points = spark.createDataFrame([(1, 1.0, 2.0), (1, 3.0, 4.0), (2, 5.0, 5.0), (3, 6.0, 6.0), (4, 7.0, 7.0)], "id long, lat double, lon double")
    got = {r["place_id"]: (r["name"], r["kind"], r["importance"], r["lat"]) for r in places.build_places(elements, points).collect()}
    assert got == {1: ("Big Town", "place", 90, 2.0), 2: ("H", "amenity", 48, 5.0), 3: ("M", "shop", 26, 6.0)}
    roads = spark.createDataFrame([(1, "a", 5, 28.0, 77.0), (2, "a", 9, 28.01, 77.0), (3, "a", 1, 28.9, 77.0), (4, "b", 1, 28.0, 77.0)], "way_id long, norm string, rank int, lat double, lon double")
    assert sorted((r["norm"], r["way_id"], r["rank"], r["ways"]) for r in places.cluster_roads(roads).collect()) == [("a", 1, 9, 2), ("a", 3, 1, 1), ("b", 4, 1, 1)]


def test_analytics(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(10)], "k string, x double")
    assert tuple(analytics.quantile_floor(df, ["k"], "x", (0.0, 0.5, 0.99)).first())[1:] == (0.0, 5.0, 9.0)
    spans = analytics.spans(df, [0.0, 3.0, 6.0], "x").orderBy("x").collect()
    assert [r["span"] for r in spans] == [0, 0, 0, 0, 1, 1, 1, None, None, None]


def test_geometry(spark):
    r = spark.range(1).select(geo.bearing_delta(F.lit(10.0), F.lit(190.0)).alias("a"), geo.bearing_delta(F.lit(350.0), F.lit(10.0)).alias("b"), geo.bearing_gap(F.lit(350.0), F.lit(10.0)).alias("c"), geo.scaled(F.lit(-1.00000005)).alias("d"), geo.ease_angle(F.lit(350.0), F.lit(10.0)).alias("e"), geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("f")).first()
    assert (r["a"], r["b"], r["c"], r["d"], r["e"]) == (180.0, 20.0, 20.0, -10000000, 20.0) and abs(r["f"] - 111195.08) < 0.1
