import random

import pytest
from graphloom.operators import retrieve
from graphloom.operators.pack import Budget, byte_tokens, citation, deduplicated, pack
from pyspark.sql import functions as F

GRAPH, VECTOR = "node_id string, domain string, name string, hop int, graph_rank int", "node_id string, domain string, vector_score double, vector_rank int"


def twin(graph, vector, k=60, beta=0.15):
    """Fusion and boost in plain Python."""
    out = {}
    for n, _, name, hop, rank in graph:
        e = out.setdefault(n, {"score": 0.0, "hop": None, "name": ""})
        e["score"] += 1 / (k + rank)
        e["hop"] = hop if e["hop"] is None else min(e["hop"], hop)
        e["name"] = e["name"] or name
    for n, _, _, rank in vector:
        out.setdefault(n, {"score": 0.0, "hop": None, "name": ""})["score"] += 1 / (k + rank)
    return {n: e["score"] + (beta / (1 + e["hop"]) if e["hop"] is not None else 0) for n, e in out.items()}


def test_fusion_arithmetic(spark):
    g = spark.createDataFrame([("a", "code", "A", 1, 1)], GRAPH)
    v = spark.createDataFrame([("b", "code", 0.9, 1), ("a", "code", 0.8, 2), ("a", "code", 0.7, 3), ("c", None, 0.6, None)], VECTOR)
    got = {r["node_id"]: r for r in retrieve.rrf_fuse(g, v).collect()}
    assert set(got) == {"a", "b"}
    assert got["a"]["rrf_score"] == pytest.approx(1 / 61 + 1 / 62 + 1 / 63) and got["a"]["vector_rank"] == 2 and got["a"]["vector_score"] == 0.8
    assert got["b"]["hop"] is None and got["b"]["name"] is None and got["a"]["name"] == "A"


def test_fusion_equals_its_twin(spark):
    r = random.Random(2)
    graph = [(f"n{r.randrange(30)}", "code", "x", r.randrange(4), i + 1) for i in range(40)]
    vector = [(f"n{r.randrange(40)}", "code", r.random(), i + 1) for i in range(50)]
    fused = retrieve.boost_proximity(retrieve.rrf_fuse(spark.createDataFrame(graph, GRAPH), spark.createDataFrame(vector, VECTOR)))
    got, want = {x["node_id"]: x["combined_score"] for x in fused.collect()}, twin(graph, vector)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_proximity(spark):
    df = spark.createDataFrame([("a", 0.5, 1.0), ("b", 0.5, 4.0), ("c", 0.5, None)], "node_id string, rrf_score double, hop double")
    assert [round(r[0], 9) for r in retrieve.boost_proximity(df).orderBy("node_id").select("combined_score").collect()] == [0.575, 0.53, 0.5]


def test_vector_search_skips_what_it_cannot_compare(spark, rows):
    points = spark.createDataFrame([(1, "a", "code", [1.0, 0.0]), (2, "b", None, [0.0, 1.0]), (3, None, "doc", [1.0, 1.0]), (4, "d", "code", None), (5, "e", "code", [0.0, 0.0]), (6, "f", "code", [1.0])], "point_id bigint, node_id string, domain string, vector array<float>")
    assert rows(retrieve.vector_search(points, [1.0, 0.0]), "node_id", "domain", "vector_rank") == [("3", "doc", 2), ("a", "code", 1), ("b", "code", 3)]
    assert rows(retrieve.vector_search(points, [1.0, 0.0], "code", 1), "node_id") == [("a",)]


def test_hybrid_search_drops_orphans_and_degrades(spark, rows):
    nodes = spark.createDataFrame([(i, "code", "Function", i.upper(), "t", "r", "g") for i in ("seed", "direct", "indirect", "alone")], "id string, domain string, node_type string, name string, tenant_id string, repo string, acl_group string")
    rel = spark.createDataFrame([("direct", "seed", "CALLS"), ("indirect", "direct", "CALLS")], "from_id string, to_id string, rel_type string")
    points = spark.createDataFrame([(1, "direct", "code", [1.0, 0.1], "r"), (2, "alone", "code", [1.0, 0.2], "r"), (3, "orphan", "code", [1.0, 0.0], "r")], "point_id int, node_id string, domain string, vector array<float>, repo string")
    chunks = spark.createDataFrame([("direct", 1, "two"), ("direct", 0, "one"), ("direct", 0, "one"), ("direct", 2, None)], "entity_id string, chunk_index int, text string")
    found = retrieve.hybrid_search(nodes, rel, points, [1.0, 0.0], "seed", chunks=chunks)
    assert [(r["node_id"], r["name"], r["source_text"]) for r in found.orderBy("rank").collect()] == [("direct", "DIRECT", "one\ntwo"), ("indirect", "INDIRECT", None), ("alone", "ALONE", None)]
    degraded = retrieve.hybrid_search(nodes, rel, points, None, "seed")
    assert retrieve.diagnostics(degraded).first().asDict() == {"n_graph": 2, "n_vector": 0, "n_results": 2, "vector_leg_degraded": True}


def test_fulltext(spark, rows):
    nodes = spark.createDataFrame([("a", "code", "Class", "Order Service", "total total"), ("b", "code", "Interface", "total", "total"), ("c", "code", "Function", "total", None), ("d", "code", "Method", None, "other words here")], "id string, domain string, node_type string, name string, source_text string")
    assert [r["id"] for r in retrieve.fulltext_search(nodes, "total?!").orderBy("text_rank").collect()] == ["c", "a"]
    assert rows(retrieve.fulltext_search(nodes, "?!")) == []
    assert rows(retrieve.fulltext_search(nodes.limit(0), "total")) == []


def test_rerank_formula_and_fence(spark, rows):
    nodes = spark.createDataFrame([("a", "t", "r", "g"), ("b", "t", "r", "g"), ("c", "t", "r", "h")], "id string, tenant_id string, repo string, acl_group string")
    scores = spark.createDataFrame([("a", "t", "r", "g", 2, 0.8), ("b", "t", "r", "g", 1, 0.9), ("c", "t", "r", "g", 2, 0.9)], "node_id string, tenant_id string, repo string, acl_group string, generation int, impact_score double")
    parts = spark.createDataFrame([("t", "r", "g", 2), ("t", "r", "h", 1)], "tenant_id string, repo string, acl_group string, generation int")
    impact = retrieve.current_impact(nodes, scores, parts)
    assert rows(impact) == [("a", 0.8)]
    candidates = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 0.0)], "node_id string, hop double")
    got = {r["node_id"]: r for r in retrieve.rerank("q", candidates, impact, 3, score=lambda q, t: F.lit(0.5)).collect()}
    assert got["a"]["final_score"] == pytest.approx(0.5 + 0.15 * (0.25 + 0.4)) and got["b"]["final_score"] == 0.5 and got["c"]["final_score"] == pytest.approx(0.575)
    assert rows(retrieve.rerank("q", candidates, impact, 1, score=lambda q, t: F.lit(0.5)), "node_id") == [("a",)]
    assert rows(retrieve.rerank("q", candidates.limit(0), impact, 1)) == []
    with pytest.raises(ValueError):
        retrieve.rerank("q", candidates, impact, 0)


RANKED = "query_id string, node_id string, name string, hop int, impact_norm double, final_score double, input_pos int, source_text string, citation string"


def ranked(spark, data):
    return spark.createDataFrame([("q", n, n.upper(), h, i, s, p, t, "c") for p, (n, h, i, s, t) in enumerate(data)], RANKED)


def test_u_order(spark):
    df = ranked(spark, [(f"n{i}", None, 0.0, 1 - i / 10, "") for i in range(6)] + [("n0", None, 0.0, 0.0, "")])
    assert [r["node_id"] for r in deduplicated(df).orderBy("u_pos").collect()] == ["n0", "n2", "n4", "n5", "n3", "n1"]


def test_quotas(spark, rows):
    data = [("a", 0, 0.0, 0.9, "x" * 400), ("b", 1, 0.6, 0.8, "y" * 40), ("c", 1, 0.5, 0.7, "z" * 40), ("d", None, 0.9, 0.6, None)]
    got = pack(ranked(spark, data), Budget(total=50, definitions=0.4, relations=0.4, source=0.4))
    assert rows(got.where("section = 'definitions'"), "node_id") == [("a",)]  # always the best, alone past its quota
    assert rows(got.where("section = 'relations'"), "node_id", "text") == [("a", "A (hop 0)"), ("b", "B (hop 1)"), ("c", "C (hop 1)"), ("d", "D")]
    assert rows(got.where("section = 'full_source'")) == []  # the first doesn't fit, so none
    wide = pack(ranked(spark, data), Budget(source_top_k=2))
    assert rows(wide.where("section = 'full_source'"), "node_id") == [("a",), ("b",)]
    assert rows(wide.where("section = 'definitions'"), "pos", "node_id") == [(0, "a"), (1, "c"), (2, "d"), (3, "b")]
    assert rows(pack(ranked(spark, [])) ) == []


def test_citation_and_tokens(spark):
    df = spark.createDataFrame([("r", "p.go", 1, 2, "c", "é" * 5), ("r", "", 1, 2, "c", ""), ("r", None, 1, 2, "c", "abcd"), ("r", "p", 1, 2, None, "abc")], "r string, p string, s int, e int, c string, t string")
    assert [tuple(x) for x in df.select(citation(*(F.col(c) for c in "rpsec")), byte_tokens(F.col("t"))).collect()] == [("r/p.go:1-2@c", 2), ("provenance non disponibile", 0), ("provenance non disponibile", 1), ("provenance non disponibile", 0)]
