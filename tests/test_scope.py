import hashlib
import struct

import pytest
from graphloom.functions.ids import cache_key, command_fingerprint, point_id, scoped_node_id
from graphloom.operators.scope import Scope, label_outcome, policy_decision, scoped
from graphloom.schema import extension_outcome, specific_label
from pyspark.sql import functions as F


def test_scope_values_are_checked_sorted_and_unique():
    s = Scope("t", "u", ("b", "a", "b"), ("g",))
    assert s.repos == ("a", "b")
    for bad in ("", " t", "t ", "a\nb", "x" * 257, "\ud800"):
        with pytest.raises(ValueError):
            Scope(bad, "u", ("a",), ("g",))
    for repos in ((), tuple(map(str, range(129)))):
        with pytest.raises(ValueError):
            Scope("t", "u", repos, ("g",))


def test_fingerprint_leaves_the_user_out_and_is_length_prefixed():
    a, b = Scope("t", "u", ("r2", "r1"), ("g",)), Scope("t", "v", ("r1", "r2", "r1"), ("g",))
    assert a.fingerprint() == b.fingerprint() != Scope("t", "u", ("r1",), ("r2", "g")).fingerprint()
    put = lambda x: struct.pack(">I", len(x)) + x
    assert a.fingerprint("tag") == hashlib.sha256(b"tag" + put(b"t") + struct.pack(">I", 2) + put(b"r1") + put(b"r2") + struct.pack(">I", 1) + put(b"g")).hexdigest()


def test_rows_outside_the_scope_stay_hidden(spark, rows):
    df = spark.createDataFrame([(1, "t", "a", "g"), (2, "x", "a", "g"), (3, "t", "b", "g"), (4, "t", "a", "h"), (5, None, "a", "g"), (6, "t", None, "g")], "id int, tenant_id string, repo string, acl_group string")
    s = Scope("t", "u", ("a", "c"), ("g",))
    assert rows(scoped(df, s), "id") == [(1,)]
    assert rows(scoped(df, s, "a"), "id") == [(1,)] and rows(scoped(df, s, "b"), "id") == []


def test_policy_reasons_in_order(spark):
    data = [(" ", "u", "x", [], [], "missing_tenant"), ("t", None, "x", [], [], "missing_user"), ("t", "u", "x", ["r"], ["g"], "unknown_action"), ("t", "u", "health", [], [], "allow"), ("t", "u", "get_node", None, ["g"], "empty_repo_scope"), ("t", "u", "get_node", ["r", " "], ["g"], "empty_repo_scope"), ("t", "u", "get_node", ["r"], [], "empty_acl_scope"), ("t", "u", "get_node", ["r"], ["g"], "allow")]
    df = spark.createDataFrame(data, "t string, u string, a string, r array<string>, g array<string>, want string")
    got = df.select("want", policy_decision(*(F.col(c) for c in "tuarg")).alias("d")).collect()
    assert all(r["want"] == r["d"]["reason"] and r["d"]["allow"] == (r["want"] == "allow") for r in got)


def test_labels_and_extensions(spark, rows):
    df = spark.createDataFrame([("t", "r"), ("", "r"), (None, "r"), (" t", "r"), ("t\x01", "r"), ("x" * 257, "r")], "a string, b string")
    assert [r[0] for r in df.select(label_outcome(F.col("a"), F.col("b"))).collect()] == ["accepted", "missing", "missing", "invalid", "invalid", "invalid"]
    df = spark.createDataFrame([("code", '{"node_type":"Class"}'), ("code", None), ("code", "{"), ("legal", '{"node_type":"Class"}'), ("contract", "{}"), (None, "{}"), ("doc", "{}")], "d string, e string")
    assert [r[0] for r in df.select(extension_outcome(F.col("d"), F.col("e"))).collect()] == ["accepted", "missing_ext", "invalid_json", "unknown_node_type", "unsupported_domain", "unsupported_domain", "unknown_node_type"]
    df = spark.createDataFrame([(["CodeNode", "Class"],), (["CodeNode"],), ([],)], "l array<string>")
    assert [r[0] for r in df.select(specific_label(F.col("l"))).collect()] == ["Class", None, None]


def test_identifiers_equal_plain_python(spark):
    import uuid

    namespace = "5f3e8a1c-9b6d-4e2a-8c7f-1a2b3c4d5e6f"
    df = spark.createDataFrame([("ténant", "r", "p" * 300)], "t string, r string, p string")
    row = df.select(scoped_node_id(F.col("t"), F.col("r"), F.col("p")).alias("n"), point_id(F.col("p"), namespace).alias("u"), command_fingerprint([F.col("t"), F.col("r")]).alias("f"), cache_key(F.col("t"), F.col("r"), F.col("p"), F.lit("")).alias("c")).first()
    put = lambda x, w=8: len(x.encode()).to_bytes(w, "big") + x.encode()
    sha = lambda x: hashlib.sha256(x).hexdigest()
    assert row["n"] == sha(b"node-id-v2" + put("ténant") + put("r") + put("p" * 300))
    assert row["u"] == str(uuid.uuid5(uuid.UUID(namespace), "p" * 300))
    assert row["f"] == sha(put("ténant") + put("r"))
    assert row["c"] == "scache:v2:" + sha(b"semantic-cache-key-v2" + put("ténant", 4) + put("r", 4) + put("p" * 300, 4) + put("", 4))
