"""Routes between places on edges: both forms of the search, brute force over walks, cost parts and geometry."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from waygrid.functions import geo
from waygrid.operators import graph, routing
from waygrid.operators.tracking import metres as apart
from waygrid.plans import catalog
from waygrid.sources import projection

ASKED = "query_id long, start_edge long, start_fraction double, end_edge long, end_fraction double"


@pytest.fixture(scope="module")
def network(spark, sf_dir):
    edges = graph.costs(projection.edges(spark, sf_dir)).cache()
    return edges, graph.turn_costs(edges).cache(), catalog._bans(edges).cache(), catalog._triples(edges).cache()


@pytest.fixture(scope="module")
def asked(spark, network):
    ids = sorted(r["edge_id"] for r in network[0].select("edge_id").collect())
    rng = random.Random(5)
    rows = [(q, rng.choice(ids), rng.random(), rng.choice(ids), rng.random()) for q in range(16)]
    rows += [(20, ids[3], 0.2, ids[3], 0.9), (21, ids[3], 0.9, ids[3], 0.2), (22, ids[5], 0.4, ids[5], 0.4), (23, -7, 0.5, ids[0], 0.5)]
    return rows


def cheapest(network, rows, avoid=False):
    """Least seconds of each row by a plain search whose states are (edge, edge before)."""
    edges, turns, bans, triples = network
    table = {r["edge_id"]: r for r in edges.collect()}
    sides = {}
    for e, r in table.items():
        sides.setdefault(r["shape_id"], []).append(e)
    no, three = {tuple(r) for r in bans.collect()}, {tuple(r) for r in triples.collect()}
    after = {}
    for r in turns.collect():
        if (r["edge_in"], r["edge_out"]) not in no and not (avoid and table[r["edge_out"]]["toll_road"]):
            after.setdefault(r["edge_in"], []).append((r["edge_out"], r["seconds"]))
    out = {}
    for q, a, fa, b, fb in rows:
        if a not in table or b not in table:
            continue

        def both(e, f):
            return {x: f if table[x]["reversed"] == table[e]["reversed"] else 1 - f for x in sides[table[e]["shape_id"]]}

        starts, ends = both(a, fa), both(b, fb)
        todo, seen, best = [((1 - f) * table[e]["secs"], e, -1) for e, f in starts.items()], set(), None
        heapq.heapify(todo)
        while todo:
            cost, e, before = heapq.heappop(todo)
            if (e, before) in seen:
                continue
            seen.add((e, before))
            if e in ends and (before != -1 or ends[e] >= starts[e]):
                total = cost - (1 - ends[e]) * table[e]["secs"]
                best = total if best is None else min(best, total)
            for f, turn in after.get(e, ()):
                if (before, e, f) not in three:
                    heapq.heappush(todo, (cost + turn + table[f]["secs"], f, e))
        if best is not None:
            out[q] = best
    return out


@pytest.mark.parametrize(("most_sent", "avoid"), [(routing.MOST_SENT, False), (routing.MOST_SENT, True), (0, False)])
def test_places_on_edges(spark, network, asked, most_sent, avoid):
    edges, turns, bans, triples = network
    found = routing.point_routes(spark.createDataFrame(asked, ASKED), edges, turns, bans, triples, avoid, most_sent).cache()
    got, want = {r["query_id"]: r for r in found.collect()}, cheapest(network, asked, avoid)
    assert {q for q, r in got.items() if r["seconds"] is not None} == set(want)
    assert all(abs(got[q]["seconds"] - want[q]) < 1e-6 for q in want)
    for r in routing.assemble(found, edges, turns).collect():
        assert abs(r["drive_s"] + r["distance_s"] + r["toll_s"] + r["turn_s"] - r["seconds"]) < 1e-6
    if avoid:
        tolled = {r["edge_id"] for r in edges.filter("toll_road <> 0").collect()}
        assert not any(set(r["path"][1:]) & tolled for r in got.values() if r["path"])


def test_pairs_of_vertices_by_joins(spark, network):
    edges, turns, bans, triples = network
    pairs = spark.createDataFrame([(i, i * 7 % 100, i * 7 % 100 + 41) for i in range(12)] + [(99, 3, 10_000_000)], "query_id long, origin long, target long")
    forms = [{r["query_id"]: r["seconds"] for r in routing.routes(pairs, edges, turns, bans, triples, most_sent=n).collect()} for n in (routing.MOST_SENT, 0)]
    assert forms[0].keys() == forms[1].keys()
    assert all((forms[0][q] is None) == (s is None) and (s is None or abs(forms[0][q] - s) < 1e-6) for q, s in forms[1].items())
    assert forms[0][99] is None


def test_geometry_joins_the_edges(spark, network, asked):
    edges, turns, bans, triples = network
    found = routing.point_routes(spark.createDataFrame(asked, ASKED), edges, turns, bans, triples)
    shapes = edges.select("edge_id", F.expr("array(struct(lat1 as lat, lon1 as lon), struct(lat2 as lat, lon2 as lon))").alias("points"))
    lines = {r["query_id"]: r["points"] for r in routing.geometry(found, shapes).collect()}
    metres = {r["query_id"]: r["length_m"] for r in routing.assemble(found, edges, turns).collect()}
    assert lines.keys() == metres.keys()
    for q, line in lines.items():
        assert all(a != b for a, b in zip(line, line[1:]))
        assert abs(sum(apart(a["lat"], a["lon"], b["lat"], b["lon"]) for a, b in zip(line, line[1:])) - metres[q]) < 1e-3 * max(1, metres[q])


def test_clip_polyline(spark):
    line = [(28.0, 77.0), (28.0, 77.01), (28.01, 77.01)]
    rows = [(1, line, 0.0, 1.0), (2, line, 0.25, 0.25), (3, line, 0.1, 0.9), (4, line[:1], 0.2, 0.5), (5, [line[0]] * 3, 0.2, 0.5), (6, line, 0.5, 2.0), (7, [], 0.0, 0.5), (8, line, 0.8, 0.2)]
    df = spark.createDataFrame(rows, "id int, points array<struct<lat: double, lon: double>>, a double, b double")
    got = {r["id"]: [tuple(p) for p in r["c"]] for r in df.select("id", geo.clip_polyline(F.col("points"), F.col("a"), F.col("b")).alias("c")).collect()}
    assert got[1] == line and got[4] == line[:1] and got[5] == line[:1] and got[7] == []
    assert len(got[2]) == 1 and len(got[8]) == 1 and len(got[3]) == 3 and got[3][1] == line[1]
    assert got[6][-1] == line[-1] and got[2][0][0] == 28.0 and 77.0 < got[2][0][1] < 77.01


def test_clip_polyline_measures_once(spark):
    """A line is measured once, whatever is made of it, and long lines are cut as a plain loop cuts them."""
    clipped = geo.clip_polyline(F.col("points"), F.col("a"), F.col("b"))
    assert str(clipped).lower().count("sin(") <= 3  # one distance: an arc sine and two squared sines
    line = [(28.0 + (i * 37 % 11) / 1e3, 77.0 + i / 1e3) for i in range(120)]
    df = spark.createDataFrame([(line, 0.123, 0.877)], "points array<struct<lat: double, lon: double>>, a double, b double")
    got = [tuple(p) for p in df.select(clipped.alias("c")).first()["c"]]
    pieces = [r[0] for r in spark.createDataFrame([(*p, *q) for p, q in zip(line, line[1:])], "a double, b double, c double, d double").select(geo.haversine(*map(F.col, "abcd"))).collect()]
    reached = [sum(pieces[:i]) for i in range(len(line))]
    low, high = 0.123 * reached[-1], 0.877 * reached[-1]

    def at(m):
        i = next(i for i in range(1, len(line)) if reached[i] >= m)
        t = (m - reached[i - 1]) / pieces[i - 1]
        return tuple(line[i - 1][k] + t * (line[i][k] - line[i - 1][k]) for k in (0, 1))

    want = [at(low), *[p for p, m in zip(line, reached) if low < m < high], at(high)]
    assert len(got) == len(want) and all(abs(x - y) < 1e-9 for p, q in zip(got, want) for x, y in zip(p, q))
