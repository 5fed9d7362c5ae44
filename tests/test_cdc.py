import datetime as dt

from graphloom.operators import cdc, maintain
from pyspark.sql import functions as F

NODE = "id string, node_type string, domain string, name string, ast_hash string, tenant_id string, repo string, acl_group string, path string"
PART = "tenant_id string, repo string, acl_group string, generation bigint"


def node(i, name="n", repo="r", kind="Class"):
    return (i, kind, "code", name, "h", "t", repo, "g", "p")


def merge(spark, current, updates, parts):
    return cdc.merge_nodes(spark.createDataFrame(current, NODE), spark.createDataFrame(updates, NODE), spark.createDataFrame(parts, PART))


def test_unchanged_nodes_leave_generations(spark, rows):
    nodes, parts = merge(spark, [node("a")], [node("a")], [("t", "r", "g", 5)])
    assert rows(parts) == [("t", "r", "g", 5)] and nodes.count() == 1


def test_changes_move_old_and_new_partitions(spark, rows):
    nodes, parts = merge(spark, [node("a"), node("b")], [node("a", repo="r2"), node("b", name="m"), node("c")], [("t", "r", "g", 5), ("t", "other", "g", 9)])
    assert rows(parts) == [("t", "other", "g", 9), ("t", "r", "g", 8), ("t", "r2", "g", 1)]
    assert rows(nodes, "id", "name", "repo") == [("a", "n", "r2"), ("b", "m", "r"), ("c", "n", "r")]
    nulls = merge(spark, [node("a", name=None)], [node("a", name=None)], [("t", "r", "g", 1)])[1]
    assert rows(nulls) == [("t", "r", "g", 2)]  # null equals nothing


def test_placeholder_first_node_later(spark, rows):
    rel = "from_id string, rel_type string, to_id string, weight int"
    empty_rel, parts = spark.createDataFrame([], rel), spark.createDataFrame([("t", "r", "g", 1)], PART)
    nodes = spark.createDataFrame([node("a")], NODE)
    updates = spark.createDataFrame([("a", "CALLS", "b", None), ("a", "BOGUS", "b", 1), (None, "CALLS", "b", 1)], rel)
    placed, relations, parts = cdc.merge_relations(nodes, empty_rel, updates, parts)
    assert rows(placed, "id", "name") == [("a", "n"), ("b", None)] and rows(relations) == [("a", "CALLS", "b", 1)] and rows(parts) == [("t", "r", "g", 2)]
    same = cdc.merge_relations(placed, relations, spark.createDataFrame([("a", "CALLS", "b", 1)], rel), parts)[2]
    assert rows(same) == [("t", "r", "g", 2)]
    after, more = cdc.merge_nodes(placed, spark.createDataFrame([node("b", "late")], NODE), parts)
    assert rows(after, "id", "name") == [("a", "n"), ("b", "late")] and rows(more) == [("t", "r", "g", 3)]


def test_envelopes(spark):
    base = {"id": "i", "aggregate_type": "CodeNode", "aggregate_id": "a", "event_type": " upsert", "payload": "{}", "created_at": dt.datetime(2026, 1, 1)}
    cases = [({}, "accepted"), ({"aggregate_id": None}, "heartbeat"), ({"id": None}, "missing_key"), ({"aggregate_type": "X"}, "unknown_aggregate_type"), ({"event_type": "MOVE"}, "unknown_event_type"), ({"payload": None}, "bad_payload"), ({"payload": "[1]"}, "bad_payload"), ({"payload": "{"}, "bad_payload")]
    df = spark.createDataFrame([tuple((base | c).values()) + (want,) for c, want in cases], "id string, aggregate_type string, aggregate_id string, event_type string, payload string, created_at timestamp, want string")
    got = cdc.routed(df).collect()
    assert all(r["outcome"] == r["want"] for r in got) and got[0]["topic"] == "outbox.event.CodeNode" and got[1]["topic"] is None


def test_ledger_is_by_consumer(spark, rows):
    events = spark.createDataFrame([("1",), ("1",), ("2",), (None,)], "event_id string")
    ledger = cdc.ledger_rows(events.where("event_id = '1'"), "graph")
    assert rows(cdc.unseen(events, ledger, "graph")) == [("2",)] and rows(cdc.unseen(events, ledger, "vector")) == [("1",), ("2",)]


def test_retries_then_dead_letters(spark):
    data = [(False, True, None, "t"), (True, True, None, "t"), (True, True, "4", "t.retry"), (True, True, "5", "t"), (True, True, "x", "t"), (True, False, "0", "t"), (True, None, "-3", "t")]
    df = spark.createDataFrame(data, "f boolean, r boolean, h string, t string")
    got = [tuple(x["s"]) for x in df.select(cdc.retry_route(F.col("f"), F.col("r"), F.col("h"), F.col("t"), retry_suffix=".retry").alias("s")).collect()]
    assert got == [("processed", None, 0, 0), ("retried", "t.retry", 1, 1), ("retried", "t.retry", 5, 16), ("dead_lettered", "t.DLQ", 5, 0), ("retried", "t.retry", 1, 1), ("failed", None, 0, 0), ("retried", "t.retry", 1, 1)]


def test_paths(spark):
    good, bad = ["a.go", "x/y.ts", "ü/b.js", "a/.x.go"], ["", "/a.go", "a\\b.go", "a//b.go", "./a.go", "a/../b.go", "a.tsx", "go", ".go", "a/.go", "a\tb.go", None, "x" * 1022 + ".go"]
    df = spark.createDataFrame([(p,) for p in good + bad], "p string")
    assert [r[0] for r in df.select(cdc.valid_path(F.col("p"))).collect()] == [True] * len(good) + [False] * len(bad)


def test_receipts_sources_and_batches(spark, rows):
    receipts = spark.createDataFrame([("1", "f")], "command_id string, fingerprint string")
    commands = spark.createDataFrame([("1", "f"), ("1", "g"), ("2", "f")], "command_id string, fingerprint string")
    assert rows(cdc.receipt_outcomes(commands, receipts), "command_id", "fingerprint", "outcome") == [("1", "f", "duplicate"), ("1", "g", "conflict"), ("2", "f", "applied")]
    import hashlib

    sha = lambda b: hashlib.sha256(b).hexdigest()
    data = [(b"ok", sha(b"ok"), 2), (None, "x", 1), (b"ok", sha(b"ok"), 3), (b"ok", "0", 2), (b"\xff", sha(b"\xff"), 1), (b"a\0", sha(b"a\0"), 2)]
    df = spark.createDataFrame([(bytearray(c) if c is not None else None, s, n) for c, s, n in data], "c binary, s string, n int")
    assert [r[0] for r in df.select(cdc.verify_source(F.col("c"), F.col("s"), F.col("n"))).collect()] == ["verified", "source_not_found", "source_size_mismatch", "source_digest_mismatch", "source_not_utf8", "source_contains_nul"]
    nodes = spark.createDataFrame([("c", "p.go", "n", "p.go"), ("c", "p.go", "n", "q.go")], "command_id string, command_path string, id string, path string")
    chunks = spark.createDataFrame([("c", "n", 0), ("c", "n", 0), ("c", "zz", 0)], "command_id string, entity_id string, chunk_index int")
    assert [r[1] for r in rows(cdc.invalid_batches(nodes, chunks))] == ["chunk_without_node", "foreign_path", "repeated_chunk", "repeated_node"]


def test_reconcile_and_purge(spark, rows):
    src = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("d", None), (None, "1")], "id string, fingerprint string")
    view = spark.createDataFrame([("a", "1"), ("b", "9"), ("c", None), (None, "1")], "id string, fingerprint string")
    got = maintain.reconcile(src, view)
    assert rows(got, "id", "outcome") == sorted([("a", "match"), ("b", "republish"), ("c", "match"), ("d", "republish"), (None, "error")], key=repr)
    assert rows(maintain.reconcile_report(got)) == [(5, 2, 2, 1)]
    now = dt.datetime(2026, 1, 10)
    df = spark.createDataFrame([(1, now - dt.timedelta(hours=169)), (2, now - dt.timedelta(hours=168)), (3, None)], "i int, ts timestamp")
    kept, purged = maintain.purge(df, "ts", now)
    assert rows(kept, "i") == [(2,), (3,)] and rows(purged, "i") == [(1,)]


def test_ddl_scripts():
    script = "CREATE A; // note; here\nCREATE 'x;y';\n\n;CREATE `b;` // end"
    assert maintain.split_statements(script) == ["CREATE A", "CREATE 'x;y'", "CREATE `b;`"]
    assert maintain.split_statements("// alone") == []

    def run(s):
        if "x" in s:
            raise RuntimeError("no")
        return "created"

    done = maintain.migrate(maintain.split_statements(script), run)
    assert done["created"] == 1 and done["failed"][0] == "CREATE 'x;y'"
