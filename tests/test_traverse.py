import pytest
from graphloom.operators.traverse import authorised_projection, hierarchy_violations, impact_events, impact_levels, neighbors, reach_reverse, relations_exist


def graph(spark, edges, hidden=()):
    ids = sorted({x for a, b, _ in edges for x in (a, b)} - set(hidden))
    nodes = spark.createDataFrame([(i, "doc" if i.startswith("d") else "code", i.upper(), "r1" if i < "m" else "r2") for i in ids], "id string, domain string, name string, repo string")
    return nodes, spark.createDataFrame([(a, b, t, 1) for a, b, t in edges], "from_id string, to_id string, rel_type string, weight int")


CHAIN = [("n1", "entry", "CALLS"), ("n2", "n1", "IMPLEMENTS"), ("n3", "n2", "IMPORTS"), ("foreign", "entry", "CALLS"), ("x", "entry", "CONTAINS")]


def test_chain_with_a_hidden_caller(spark, rows):
    nodes, rel = graph(spark, CHAIN, ["foreign"])
    assert rows(reach_reverse(nodes, rel, "entry", 4), "id", "hop", "graph_rank") == [("n1", 1, 1), ("n2", 2, 2), ("n3", 3, 3)]
    assert rows(reach_reverse(nodes, rel, "entry", 2), "id") == [("n1",), ("n2",)]
    assert rows(reach_reverse(nodes, rel, "foreign", 4)) == [] and rows(reach_reverse(nodes, rel, "nowhere", 4)) == []
    with pytest.raises(ValueError):
        reach_reverse(nodes, rel, "entry", 0)


def test_a_cycle_leads_back_and_the_shortest_way_counts(spark, rows):
    nodes, rel = graph(spark, [("a", "b", "CALLS"), ("b", "a", "CALLS"), ("c", "a", "CALLS"), ("c", "b", "CALLS"), ("a", "a", "IMPORTS")])
    assert rows(reach_reverse(nodes, rel, "b", 3), "id", "hop") == [("a", 1), ("b", 2), ("c", 1)]
    assert rows(reach_reverse(nodes, rel, "a", 3), "id", "hop") == [("a", 1), ("b", 1), ("c", 1)]


def test_endpoint_filter_against_level_filter(spark, rows):
    nodes, rel = graph(spark, [("d1", "entry", "CALLS"), ("n2", "d1", "CALLS"), ("k", "d1", "CALLS")])
    assert rows(reach_reverse(nodes, rel, "entry", 3, domain="code"), "id") == [("k",), ("n2",)]
    assert rows(reach_reverse(nodes, rel, "entry", 3, repo="r1"), "id") == [("d1",), ("k",)]
    assert rows(impact_events(nodes, rel, "entry", 3, 10, domain="code").where("event_kind = 'node'")) == []


def events(spark, edges, entry, depth, cap):
    nodes, rel = graph(spark, edges)
    out = []
    for level, progress in impact_levels(nodes, rel, entry, depth, cap):
        out.append(([tuple(r) for r in level.orderBy("node_id").select("node_id", "hop", "edge_type").collect()], progress))
    return out


def test_levels_types_and_progress(spark):
    edges = [("b", "a", "IMPORTS"), ("b", "a", "CALLS"), ("c", "a", "EXTENDS"), ("d", "b", "CALLS"), ("c", "b", "CALLS"), ("a", "d", "CALLS")]
    got = events(spark, edges, "a", 4, 10)
    assert [g[0] for g in got] == [[("b", 1, "CALLS"), ("c", 1, "EXTENDS")], [("d", 2, "CALLS")], []]
    assert got[2][1] == {"nodes_explored": 3, "frontier_size": 0, "current_depth": 3, "truncated": False}


def test_the_cap_truncates_only_when_a_node_is_refused(spark):
    edges = [("b", "a", "CALLS"), ("c", "a", "CALLS"), ("d", "b", "CALLS")]
    exact = events(spark, edges, "a", 1, 2)
    assert exact[-1][1]["truncated"] is False
    later = events(spark, edges, "a", 3, 2)
    assert [p["truncated"] for _, p in later] == [False, True] and later[1][0] == []
    first = events(spark, edges, "a", 3, 1)
    assert first[0][0] == [("b", 1, "CALLS")] and first[0][1]["truncated"] and len(first) == 1
    unknown = events(spark, edges, "zzz", 3, 5)
    assert [p["nodes_explored"] for _, p in unknown] == [0]
    with pytest.raises(ValueError):
        events(spark, edges, "a", 1, 0)


def test_neighbors_of_each_direction(spark, rows):
    nodes, rel = graph(spark, [("a", "b", "CALLS"), ("a", "b", "IMPORTS"), ("c", "a", "CALLS"), ("b", "d", "EXTENDS"), ("b", "a", "CALLS")])
    assert rows(neighbors(nodes, rel, "a", None, "forward", 2), "id", "hop", "traversed_types") == [("b", 1, "CALLS,IMPORTS"), ("d", 2, "EXTENDS")]
    assert rows(neighbors(nodes, rel, "a", ["CALLS"], "reverse"), "id") == [("b",), ("c",)]
    assert rows(neighbors(nodes, rel, "a", None, "both", 1, limit=1), "id") == [("b",)]
    with pytest.raises(ValueError):
        neighbors(nodes, rel, "a", None, "sideways")


def test_claims_about_relations(spark, rows):
    nodes, rel = graph(spark, [("a", "b", "CALLS"), ("b", "c", "CALLS"), ("c", "d", "CALLS"), ("a", "d", "IMPORTS"), ("c", "a", "CALLS")])
    claims = spark.createDataFrame([(1, "a", "c", "CALLS", 2), (2, "a", "c", "CALLS", 1), (3, "a", "d", "CALLS", 9), (4, "d", "a", "CALLS", 4), (5, "a", "zz", "CALLS", 2), (6, "a", "a", "CALLS", 3), (7, "zz", "a", "CALLS", 3)], "claim_id int, source_id string, target_id string, edge_type string, depth int")
    assert rows(relations_exist(nodes, rel, claims), "claim_id", "holds") == [(1, True), (2, False), (3, True), (4, False), (5, False), (6, True), (7, False)]


def test_projection_and_hierarchy(spark, rows):
    nodes, rel = graph(spark, [("r", "a", "CONTAINS"), ("a", "b", "CONTAINS"), ("r", "h", "CONTAINS"), ("h", "c", "CONTAINS")], ["h"])
    assert rows(authorised_projection(nodes, rel, "r")) == [("a", 1), ("b", 2), ("r", 0)]
    items = spark.createDataFrame([("r", 2, ["a", "q"]), ("a", 1, ["r"]), ("a", 1, [])], "id string, level int, child_ids array<string>")
    assert rows(hierarchy_violations(items, "root")) == [("a", "duplicate_id"), ("a", "level_not_below"), ("q", "missing_child"), ("root", "missing_root")]
