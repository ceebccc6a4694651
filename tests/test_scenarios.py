"""Scenarios searched at once against one search for each."""

from waygrid.operators import graph, routing, scenarios
from waygrid.plans import catalog
from waygrid.sources import projection
from tests.test_point_routes import ASKED, asked, cheapest, network  # noqa: F401
from pyspark.sql import functions as F


def test_scenarios_do_not_mix(spark, network, asked):  # noqa: F811
    edges, turns, bans, triples = network
    free = turns.withColumn("seconds", F.lit(0.0).cast("float"))
    cases = {"base": network, "free": (edges, free, bans, triples), "open": (edges, turns, spark.createDataFrame([], "from_edge long, to_edge long"), spark.createDataFrame([], "from_edge long, via_edge long, to_edge long"))}
    found = scenarios.routes(spark.createDataFrame(asked, ASKED), [scenarios.Scenario(n, *c) for n, c in cases.items()]).cache()
    rows = found.collect()
    assert len(rows) == 3 * len(asked) - 3 * sum(a[1] == -7 for a in asked)
    for name, case in cases.items():
        want = cheapest(case, asked)
        got = {r["query_id"]: r["seconds"] for r in rows if r["scenario"] == name and r["seconds"] is not None}
        assert got.keys() == want.keys() and all(abs(got[q] - want[q]) < 1e-6 for q in want)
    told = {r["scenario"]: r for r in scenarios.outcome(found, edges, "base").collect()}
    base = told["base"]
    assert base["moved"] == base["improved"] == base["worsened"] == 0 and abs(base["overlap"] - 1) < 1e-9
    assert told["free"]["worsened"] == 0 and told["free"]["improved"] > 0 and told["open"]["worsened"] == 0
    seconds = sorted(r["seconds"] for r in rows if r["scenario"] == "base" and r["seconds"] is not None)
    at = (len(seconds) - 1) * 0.5
    assert abs(base["median_s"] - (seconds[int(at)] + (at % 1) * (seconds[min(int(at) + 1, len(seconds) - 1)] - seconds[int(at)]))) < 1e-9
    paths = {(r["query_id"], r["scenario"]): r["path"] for r in rows}
    share = {(r["query_id"], r["scenario"]): r["overlap"] for r in scenarios.shared_length(found, edges, "base").collect()}
    assert all((v > 1 - 1e-9) == (set(paths[k]) <= set(paths[k[0], "base"])) for k, v in share.items() if paths[k[0], "base"] is not None)


def test_bans_are_enforced(spark):
    """A straight road 1-2-3 whose turn is banned, with a way round; and a ban over three edges with none."""
    where = {v: (28.0 + v / 1000, 77.0) for v in range(9)}
    ends = [(0, 1), (1, 2), (1, 3), (3, 2), (2, 4), (5, 6), (6, 7), (7, 8)]
    rows = [(i, a, b, i, 0, 10.0, 0, *where[a], *where[b]) for i, (a, b) in enumerate(ends)]
    edges = spark.createDataFrame(rows, "edge_id long, edge_from long, edge_to long, shape_id long, reversed int, secs double, toll_road int, lat1 double, lon1 double, lat2 double, lon2 double")
    turns = spark.createDataFrame([(i, o, 0.0) for i, (_, b) in enumerate(ends) for o, (a, _) in enumerate(ends) if a == b], "edge_in long, edge_out long, seconds float")
    banned, triples = spark.createDataFrame([(0, 1)], "from_edge long, to_edge long"), spark.createDataFrame([(5, 6, 7), (0, 2, 3)], "from_edge long, via_edge long, to_edge long")
    for most in (routing.MOST_SENT, 0):
        got = {(r["from_edge"], r["via_edge"], r["to_edge"]): (r["control_takes"], r["restricted_takes"], r["routable"]) for r in scenarios.enforcement(edges, turns, banned, triples, most).collect()}
        assert got == {(0, None, 1): (True, False, False), (5, 6, 7): (True, False, False), (0, 2, 3): (True, False, False)}


def test_every_ban_of_the_given_network(spark, sf_dir):
    edges = graph.costs(projection.edges(spark, sf_dir))
    rows = catalog.QUERIES["ban_enforcement"](spark, sf_dir).collect()
    assert len(rows) == catalog._bans(edges).distinct().count() + catalog._triples(edges).distinct().count()
    assert not any(r["restricted_takes"] for r in rows) and sum(r["control_takes"] for r in rows) > 5 and sum(r["routable"] for r in rows) > 100
