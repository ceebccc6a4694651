"""Restrictions on a small crossing, with both kinds of via members."""

import pytest

from waygrid.operators import restrictions

#: Ways 1 (0-1), 2 (1-2), 3 (1-3), 4 (2-4), 5 (2-5), each in both directions: edge ids are way * 10 + direction.
ENDS = {1: (0, 1), 2: (1, 2), 3: (1, 3), 4: (2, 4), 5: (2, 5)}


@pytest.fixture(scope="module")
def graph(spark):
    rows = [(w * 10 + d, w, *(ends if d == 0 else ends[::-1])) for w, ends in ENDS.items() for d in (0, 1)]
    return spark.createDataFrame(rows, "edge_id long, way_id long, edge_from long, edge_to long"), spark.createDataFrame([(i,) for i in range(6)], "vertex_id long")


def test_resolve(spark, graph):
    rows = [
        (1, "no_left_turn", False, 1, 3, 1, None), (2, "only_straight_on", False, 1, 2, 1, None), (3, "no_u_turn", False, 1, 4, None, 2), (4, "only_left_turn", False, 1, 4, None, 2),
        (5, "no_entry", True, 1, 3, 1, None), (6, " ", False, 1, 3, 1, None), (7, "no_parking", False, 1, 3, 1, None), (8, "no_entry", False, None, 3, 1, None), (9, "no_entry", False, 1, 3, 99, None), (10, "no_entry", False, 4, 3, 1, None), (11, "no_entry", False, 1, 4, 1, None),
    ]
    relations = spark.createDataFrame(rows, "rel_id long, kind string, conditional boolean, from_way long, to_way long, via_node long, via_way long")
    verdicts, pairs, triples = restrictions.resolve(relations, *graph)
    got = {r["rel_id"]: (r["verdict"], r["reason"]) for r in verdicts.collect()}
    assert [got[i] for i in (1, 2, 3, 4)] == [("resolved", None)] * 4
    ignored = {5: "conditional", 6: "malformed-roles", 7: "unknown-restriction-value", 8: "malformed-roles", 9: "via-node-not-an-intersection"}
    assert {i: got[i] for i in ignored} == {i: ("correctly-ignored", why) for i, why in ignored.items()}
    assert got[10] == got[11] == ("not-honoured", "member-way-wrong-direction-at-via")
    assert {tuple(r) for r in pairs.collect()} == {(10, 30)}  # only straight on leaves the same turn banned
    assert {tuple(r) for r in triples.collect()} == {(10, 20, 40), (10, 20, 50)}
    report = {(r["verdict"], r["reason"], r["overall"]): r["relations"] for r in restrictions.verdict_report(verdicts).collect()}
    assert report[("resolved", None, 1)] == 4 and report[("correctly-ignored", "malformed-roles", 0)] == 2


def test_reasons_name_the_stage_that_removed_a_member(spark, graph):
    """The via member's reason comes before those of the ways; the way one comes from before the way one goes to."""
    edges, vertices = graph
    ids = lambda name, *values: spark.createDataFrame([(v,) for v in values], f"{name} long")
    stages = restrictions.Stages(ids("node_id", *range(6), 20, 21), ids("way_id", 1, 2, 3, 4, 5, 7, 8), ids("way_id", 1, 2, 3, 4, 5, 8), ids("vertex_id", *range(6), 21))
    rows = [
        (1, 1, 3, 99, None, 0, "via-node-outside-clip"), (2, 1, 3, 20, None, 0, "via-node-not-an-intersection"), (3, 1, 3, 21, None, 0, "via-node-dropped-by-scc"), (4, 1, 4, None, 2, 2, "via-way-chain-unsupported"),
        (5, 6, 3, 1, None, 0, "member-way-outside-clip"), (6, 1, 7, 1, None, 0, "member-way-not-drivable"), (7, 8, 3, 1, None, 0, "member-way-dropped-by-scc"), (8, 1, 4, None, 8, 1, "member-way-dropped-by-scc"),
        (9, 7, 6, 1, None, 0, "member-way-not-drivable"), (10, 6, 7, None, 8, 1, "member-way-dropped-by-scc"), (11, 6, 7, 99, None, 0, "via-node-outside-clip"), (12, 1, 3, 1, None, 0, None), (13, 4, 3, 1, None, 0, "member-way-wrong-direction-at-via"),
    ]
    relations = spark.createDataFrame([(i, "no_left_turn", False, a, b, n, w, k) for i, a, b, n, w, k, _ in rows], "rel_id long, kind string, conditional boolean, from_way long, to_way long, via_node long, via_way long, n_via int")
    verdicts, pairs, _ = restrictions.resolve(relations, edges, vertices, stages)
    got = {r["rel_id"]: (r["reason"], r["verdict"]) for r in verdicts.collect()}
    assert {i: got[i][0] for i in got} == {r[0]: r[-1] for r in rows}
    assert all((v == "not-honoured") == (why in restrictions.NOT_HONOURED) and (v == "resolved") == (why is None) for why, v in got.values())
    assert {tuple(r) for r in pairs.collect()} == {(10, 30)}


def test_attribute_ramps(spark):
    nodes = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 3), (3, 3), (3, 4), (4, 9), (5, 1), (5, 2), (5, 7), (6, 7)], "way_id long, node_id long")
    roads = spark.createDataFrame([(1, 1), (6, 2)], "way_id long, road long")
    got = {r["way_id"]: r["road"] for r in restrictions.attribute_ramps(nodes, roads).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 1, 6: 2}
