import hashlib
import json

import pytest
from graphloom.operators import algos, ingest
from graphloom.operators.retrieve import search
from pyspark.sql import functions as F

sha = lambda b: hashlib.sha256(b).hexdigest()
NODE = "id string, domain string, node_type string, name string, ast_hash string, tenant_id string, repo string, acl_group string, path string, commit_sha string, start_line int, end_line int"
V1 = b"package p\n\nfunc a() { b() }\n\nfunc b() {}\n"
V2 = b"package p\n\nfunc a() { c(); c() }\n\nfunc c() {}\n"


def command(i, source, path="p.go", **change):
    return json.dumps({"schema_version": "1", "command_id": i, "commit_sha": "a" * 40, "path": path, "source_sha256": sha(source), "source_size_bytes": len(source)} | change)


def run(spark, store, commands, sources):
    c = spark.createDataFrame([(p, "t", "r", "g") for p in commands], "payload string, tenant_id string, repo string, acl_group string")
    s = spark.createDataFrame([(sha(b), bytearray(b)) for b in sources], "source_sha256 string, content binary")
    return ingest.ingest(c, s, store)


def empty(spark):
    make = lambda schema: spark.createDataFrame([], schema)
    return ingest.Store(make(NODE), make("from_id string, rel_type string, to_id string, weight int"), make("id string, entity_id string, chunk_index int, text string, char_count int"), make("command_id string, fingerprint string"))


def test_files_are_applied_once_and_replaced(spark, rows):
    store, events, outcomes = run(spark, empty(spark), [command("1", V1), command("1", V1), command("2", V1, "x.py"), command("3", b"gone", "q.go"), "{"], [V1])
    assert rows(outcomes, "command_id", "outcome") == sorted([("1", "apply"), ("1", "apply"), ("2", "invalid_path"), ("3", "source_not_found"), (None, "invalid_payload")], key=repr)
    assert rows(store.nodes, "name", "node_type") == [("a", "Function"), ("b", "Function"), ("p.go", "File")]
    assert rows(store.relations.groupBy("rel_type").count()) == [("CALLS", 1), ("CONTAINS", 2)]
    assert rows(events.groupBy("aggregate_type").count()) == [("CodeChunk", 2), ("CodeNode", 3), ("CodeRelation", 3)]
    again, more, outcomes = run(spark, store, [command("1", V1), command("1", V2)], [V1, V2])
    assert rows(outcomes, "outcome") == [("conflict",), ("duplicate",)] and more.count() == 0 and again.nodes.count() == 3
    after, _, _ = run(spark, store, [command("9", V2)], [V2])
    assert rows(after.relations.where("rel_type = 'CALLS'"), "weight") == [(2,)]
    assert rows(after.chunks, "text") == [("func a() { c(); c() }",), ("func c() {}",)]


def test_chunks_become_vectors_and_views(spark, rows):
    store, events, _ = run(spark, empty(spark), [command("1", V1)], [V1])
    none = spark.createDataFrame([], "event_id string, consumer string")
    made, more, ledger = ingest.embed_chunks(events, none, "m", 8)
    assert made.count() == 2 and rows(more.groupBy("aggregate_type").count()) == [("CodeEmbedding", 2)]
    assert ingest.embed_chunks(events, ledger, "m", 8)[0].count() == 0
    points = spark.createDataFrame([], "point_id string, node_id string, vector array<float>, domain string, tenant_id string, repo string, acl_group string")
    view = ingest.vector_view(points, made, store.nodes)
    assert view.count() == 2 and ingest.vector_view(view, made, store.nodes).count() == 2
    assert ingest.text_view(store.chunks.limit(0), store.chunks).count() == 2
    chosen = view.orderBy("node_id").first()
    found = search(store.nodes, store.relations, view, "b", list(chosen["vector"]), store.nodes.where("name = 'b'").first()["id"])
    assert {r["name"] for r in found.collect()} <= {"a", "b"} and not found.first()["vector_leg_degraded"]
    text = search(store.nodes, store.relations, view, "b?", None, None)
    assert rows(text, "name", "vector_leg_degraded") == [("b", True)]


def test_impact_job_is_fenced(spark, rows):
    scope = "tenant_id string, repo string, acl_group string"
    ids = ["entry", "n1", "n2", "n3"]
    nodes = spark.createDataFrame([(i, "code", "t", "r", "g") for i in ids] + [("foreign", "code", "other", "r", "g")], f"id string, domain string, {scope}")
    rel = spark.createDataFrame([("n1", "entry", "CALLS"), ("n2", "n1", "IMPLEMENTS"), ("n3", "n2", "IMPORTS"), ("foreign", "entry", "CALLS")], "from_id string, to_id string, rel_type string")
    parts = spark.createDataFrame([("t", "r", "g", 7)], f"{scope}, generation bigint")
    got = algos.impact_job(nodes, rel, "entry", {"tenant_id": "t", "repo": "r", "acl_group": "g"}, parts).collect()
    scores = {r["node_id"]: r["impact_score"] for r in got}
    assert set(scores) == {"n1", "n2", "n3"} and scores["n1"] > scores["n2"] > scores["n3"] and {r["generation"] for r in got} == {7}
    with pytest.raises(algos.StaleGeneration):
        algos.fenced_write(spark.createDataFrame([("n1", 0.5)], "node_id string, impact_score double"), nodes, {"tenant_id": "t", "repo": "r", "acl_group": "g"}, 7, parts.withColumn("generation", F.lit(8)))
