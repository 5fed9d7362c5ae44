import random

import pytest
from graphloom.operators import algos
from graphloom.plans import graph_queries
from graphloom.sources.graph import Graph


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def test_pagerank_equals_plain_iteration(spark):
    r = random.Random(1)
    pairs = [(f"n{r.randrange(20)}", f"n{r.randrange(20)}") for _ in range(60)]
    ids = {x for p in pairs for x in p} | {"n0"}
    rank = {i: 0.15 * (i == "n0") for i in ids}
    for _ in range(20):
        new = {i: 0.15 * (i == "n0") for i in ids}
        for a, b in pairs:
            new[b] += 0.85 * rank[a] / sum(x == a for x, _ in pairs)
        rank = new
    got = {x["id"]: x["score"] for x in algos.personalised_pagerank(edges(spark, pairs), "n0").collect()}
    assert got.keys() == rank.keys() and all(abs(got[k] - rank[k]) < 1e-12 for k in got)


def test_betweenness_of_a_path_and_a_diamond(spark, rows):
    assert rows(algos.betweenness(edges(spark, [("a", "b"), ("b", "c"), ("c", "d")]))) == [("a", 0.0), ("b", 2.0), ("c", 2.0), ("d", 0.0)]
    assert rows(algos.betweenness(edges(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")]))) == [("a", 0.0), ("b", 0.5), ("c", 0.5), ("d", 0.0)]


def test_communities_are_connected_and_better_than_singletons(spark):
    cliques = [(f"{c}{i}", f"{c}{j}") for c in "xyz" for i in range(5) for j in range(i)] + [("x0", "y0"), ("y1", "z1")]
    label = {r["id"]: r["community"] for r in algos.communities(edges(spark, cliques)).collect()}
    assert {x: label[x] for x in label} == {x: x[0] + "0" for x in label}
    r = random.Random(4)
    pairs = [(f"n{r.randrange(40)}", f"n{r.randrange(40)}") for _ in range(90)]
    found = algos.detect_communities(pairs)
    assert algos.modularity(pairs, found) > algos.modularity(pairs, {x: x for x in found}) and found == algos.detect_communities(pairs[::-1])
    for c in set(found.values()):
        members = {x for x in found if found[x] == c}
        seen, stack = set(), [c]
        while stack:
            x = stack.pop()
            if x not in seen:
                seen.add(x)
                stack += [b for a, b in pairs + [(b, a) for a, b in pairs] if a == x and b in members]
        assert seen == members


def test_a_large_subgraph_is_refused(spark, monkeypatch):
    monkeypatch.setattr(algos, "MAX_EDGES", 2)
    with pytest.raises(algos.TooLarge):
        algos.communities(edges(spark, [("a", "b"), ("b", "c"), ("c", "d")]))


def test_impact_score(spark, rows):
    deps = spark.createDataFrame([("a", 1, "CALLS"), ("b", 2, "IMPORTS")], "node_id string, hop int, edge_type string")
    ppr = spark.createDataFrame([("e", 1.0), ("a", 0.5), ("b", 0.0)], "id string, score double")
    same = spark.createDataFrame([("a", 3.0), ("b", 3.0)], "id string, score double")
    assert rows(algos.impact_scores(deps, ppr, same, "e"), "node_id", "impact_score") == [("a", 0.5 * 0.5 + 0.3), ("b", 0.15)]
    assert rows(algos.impact_scores(deps, ppr, same, "e", with_entry=False), "node_id", "impact_score") == [("a", 0.8), ("b", 0.15)]


def test_the_whole_impact_score_equals_brute_force(spark, monkeypatch):
    """impact_score_full on a random graph: betweenness by counting all shortest paths, one pair of nodes at a time."""
    r = random.Random(8)
    hub = graph_queries.HUB
    ids = [hub, *(f"n{i:02}" for i in range(14))]
    calls = sorted({(r.choice(ids[1:]), r.choice(ids[:6])) for _ in range(40)} | {("n00", hub), ("n01", hub)})
    graph = Graph(spark.createDataFrame([(i, "code", i) for i in ids], "id string, domain string, name string"), spark.createDataFrame([(a, b, "CALLS") for a, b in calls if a != b], "from_id string, to_id string, rel_type string"))
    monkeypatch.setattr(graph_queries, "code_graph", lambda *_: graph)

    hop, level = {hub: 0}, [hub]
    for d in (1, 2):
        level = sorted({a for a, b in calls if b in level} - set(hop))
        hop |= dict.fromkeys(level, d)
    steps = [(b, a) for a, b in calls if a != b and a in hop and b in hop]
    passed = dict.fromkeys(hop, 0.0)
    for s in hop:
        paths, ended, seen = [[s]], {}, {s}  # all shortest paths from s, by end
        while paths:
            longer = [[*p, b] for p in paths for a, b in steps if a == p[-1] and b not in seen]
            for p in longer:
                ended.setdefault(p[-1], []).append(p)
            seen |= {p[-1] for p in longer}
            paths = longer
        for found in ended.values():
            for p in found:
                for v in p[1:-1]:
                    passed[v] += 1 / len(found)
    rank = {i: 0.15 * (i == hub) for i in hop}
    for _ in range(algos.ROUNDS):
        new = {i: 0.15 * (i == hub) for i in hop}
        for a, b in steps:
            new[b] += 0.85 * rank[a] / sum(x == a for x, _ in steps)
        rank = new
    scaled = lambda m: {i: (v - min(m.values())) / (max(m.values()) - min(m.values())) for i, v in m.items()}
    ppr, between = scaled(rank), scaled(passed)
    want = {i: (between[i], 0.5 * ppr[i] + 0.3 / d + 0.2 * between[i]) for i, d in hop.items() if d}
    assert sum(b > 0 for b, _ in want.values()) > 2
    got = {x["node_id"]: (x["betweenness_norm"], x["impact_score"]) for x in graph_queries.impact_score_full(spark, "").collect()}
    assert got.keys() == want.keys() and all(abs(a - b) < 1e-7 for i in got for a, b in zip(got[i], want[i]))


def test_the_fence(spark, rows):
    p = {"tenant_id": "t", "repo": "r", "acl_group": "g"}
    scope = "tenant_id string, repo string, acl_group string"
    nodes = spark.createDataFrame([("a", "t", "r", "g"), ("b", "t", "r", "x")], f"id string, {scope}")
    parts = spark.createDataFrame([("t", "r", "g", 4)], f"{scope}, generation bigint")
    scores = lambda *ids: spark.createDataFrame([(i, 0.5) for i in ids], "node_id string, impact_score double")
    assert rows(algos.fenced_write(scores("a"), nodes, p, 4, parts)) == [("a", "t", "r", "g", 4, 0.5)]
    for ids, generation in ((("a",), 3), (("a", "b"), 4), (("zz",), 4)):
        with pytest.raises(algos.StaleGeneration):
            algos.fenced_write(scores(*ids), nodes, p, generation, parts)
