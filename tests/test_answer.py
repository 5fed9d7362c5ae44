import hashlib

import pytest
from graphloom.operators import agent, answer
from graphloom.operators.retrieve import fulltext_batch
from pyspark.sql import functions as F


def test_intents(spark):
    df = spark.createDataFrame([("Chi chiama X?",), ("How does it work",), ("explain who calls x",), ("hello",), (" ",), (None,)], "q string")
    got = [r["i"] for r in df.select(answer.intent(F.col("q")).alias("i")).collect()]
    assert [g and (g["intent"], g["graph_weight"], g["vector_weight"], g["evidence"]) for g in got] == [("structural", 0.75, 0.25, ["chi chiama"]), ("conceptual", 0.25, 0.75, ["how does"]), ("hybrid", 0.5, 0.5, ["who calls", "explain"]), ("hybrid", 0.5, 0.5, []), None, None]


def claims(spark, cited="r/p:1-2@c", source="a"):
    nodes = spark.createDataFrame([("a", "r", "p", 1, 2, "c"), ("b", "r", "p", 3, 4, "c")], "id string, repo string, path string, start_line int, end_line int, commit_sha string")
    rel = spark.createDataFrame([("a", "b", "CALLS")], "from_id string, to_id string, rel_type string")
    one = lambda row, schema: spark.createDataFrame([row], schema)
    return answer.verify_claims(
        nodes, rel, one(("x", source), "answer_id string, node_id string"), one(("x", source, "b", "CALLS", 9), "answer_id string, source_id string, target_id string, edge_type string, depth int"),
        one(("x", source, cited), "answer_id string, node_id string, cited string"), one(("x", "go", True), "answer_id string, language string, is_valid boolean"),
    )


def test_claims_and_outcomes(spark, rows):
    assert rows(claims(spark)) == []
    assert rows(claims(spark, "old"), "code", "detail") == [("stale-citation", "a")]
    assert rows(claims(spark, source="hidden"), "code") == [("citation-inaccessible",), ("relation-nonexistent",), ("symbol-hallucination",)]
    answers = spark.createDataFrame([("x", 0), ("y", 2), ("z", 1), ("w", 5)], "answer_id string, attempt int")
    issues = spark.createDataFrame([("x", "stale-citation"), ("y", "syntax-invalid"), ("z", "syntax-invalid"), ("z", "stale-citation")], "answer_id string, code string")
    assert rows(answer.answer_outcomes(answers, issues), "answer_id", "n_issues", "outcome") == [("w", 0, "approved"), ("x", 1, "corrected"), ("y", 1, "degraded"), ("z", 2, "regenerated")]


def test_summaries_hide_what_is_denied(spark):
    data = [("repo", 3, "h3", "src", ["m1", "m2"], "g"), ("m1", 2, "h2", "src", ["c1", "c2"], "g"), ("m2", 2, "h2b", "src", [], "x"), ("c1", 1, "h1", "src", [], "g"), ("c2", 1, "h1b", "src", [], "g"), ("under", 1, "h", "src", [], "g")]
    items = spark.createDataFrame(data, "id string, level int, ast_hash string, source string, child_ids array<string>, acl_group string")
    got = {r["id"]: r for r in answer.summary_views(items, "repo", F.col("acl_group") == "g").collect()}
    assert set(got) == {"repo", "m1", "m2", "c1", "c2"}
    assert got["m1"]["complete"] and got["m1"]["effective_hash"] == "h2" and not got["m2"]["visible"] and got["m2"]["summary"] is None
    put = lambda x: len(x).to_bytes(4, "big") + x.encode()
    view = b"summary-view-v1" + put("h3") + put("m1") + b"\1" + put("h2") + put("m2") + b"\0"
    assert got["repo"]["effective_hash"] == hashlib.sha256(view).hexdigest() and not got["repo"]["complete"]
    assert got["repo"]["summary"] == "repo(0)[m1(3)[c1(3)[];c2(3)[]]]"
    cache = spark.createDataFrame([(got["c1"]["cache_key"], "stored")], "cache_key string, summary string")
    again = {r["id"]: r for r in answer.summary_views(items, "repo", F.col("acl_group") == "g", cache=cache).collect()}
    assert again["c1"]["is_hit"] and again["m1"]["summary"] == "m1(3)[stored;c2(3)[]]"
    assert all(not r["visible"] for r in answer.summary_views(items, "m2", F.col("acl_group") == "g").collect())


def test_facts(spark, rows):
    symbols = spark.createDataFrame([("Service.Run",), ("Other.Run",), ("Service",), ("Service.Stop",)], "symbol string")
    facts = [("callers", "Service.Run <- Stop"), ("callers", "Run <- Stop"), ("callers", "Service.Run"), ("methods", "Stop"), ("methods", "Service.Stop"), ("methods", "Stop the thing"), ("methods", "Run"), ("methods", "no such-thing"), ("node_type", "Class"), ("node_type", "Class of things"), ("node_type", "Klass"), ("contains", "__EMPTY__")]
    got = answer.canonicalise(spark.createDataFrame([("q", *f) for f in facts], "query_id string, kind string, value string"), symbols)
    assert {(r["kind"], r["value"]): (r["canonical"], r["status"], r["issue"], r["is_raw"]) for r in got.collect()} == {
        ("callers", "Service.Run <- Stop"): ("Service.Run <- Service.Stop", "unique", "unqualified_symbol", False), ("callers", "Run <- Stop"): (None, "ambiguous", "ambiguous_canonicalization", False), ("callers", "Service.Run"): (None, "not_found", "semantic_error", False),
        ("methods", "Stop"): ("Service.Stop", "unique", "unqualified_symbol", False), ("methods", "Service.Stop"): ("Service.Stop", "exact", None, True), ("methods", "Stop the thing"): ("Service.Stop", "unique", "verbose_fact", False),
        ("methods", "Run"): (None, "ambiguous", "ambiguous_canonicalization", False), ("methods", "no such-thing"): (None, "not_found", "semantic_error", False), ("node_type", "Class"): ("Class", "exact", None, True), ("node_type", "Class of things"): ("Class", "exact", "verbose_fact", False),
        ("node_type", "Klass"): (None, "not_found", "semantic_error", False), ("contains", "__EMPTY__"): ("__EMPTY__", "exact", None, True),
    }
    expected = spark.createDataFrame([("q", "methods", "Service.Stop"), ("q", "methods", "Service.Run"), ("r", "methods", "x")], "query_id string, kind string, value string")
    row = answer.compare_facts(got, expected).where("query_id = 'q'").first()
    assert (row["n_expected"], row["exact_matched"], row["semantic_matched"], row["missing"], row["unexpected"], row["n_actual"], row["n_resolved"]) == (2, 1, 1, 1, 4, 12, 7)


def test_evaluation(spark):
    records = spark.createDataFrame([(str(i), i % 2 == 0, None if i else "x", float(i)) for i in range(20)], "query_id string, passed boolean, error string, latency_ms double")
    none = spark.createDataFrame([], "exact_matched int, semantic_matched int, n_expected int, n_resolved int, n_actual int")
    row = answer.evaluation_summary(records, none).first()
    assert (row["query_count"], row["success_count"], row["pass_rate"], row["latency_p50_ms"], row["latency_p95_ms"], row["fact_recall"]) == (20, 19, 0.5, 9.5, 18.0, 1.0)


def test_audit(spark):
    df = spark.createDataFrame([("e", "x", None)], "event_id string, body string, trace string")
    row = df.select(answer.audit_event(["trace", "event_id", "body"]).alias("a")).first()["a"]
    assert row["body"] == '{"body":"x","event_id":"e"}' and row["digest"] == hashlib.sha256(row["body"].encode()).hexdigest()
    at = df.select(answer.audit_object(F.lit("e"), F.lit("d"), F.lit("2026-01-02 03:04:05.5").cast("timestamp"), 10).alias("o")).first()["o"]
    assert at["name"] == "audit/v1/2026/01/02/e-d.json" and at["retain_until"].second == 16


def explored(query, kind, search, near, limits):
    """One question step by step, in plain Python: stop, steps, tokens, actions with targets, nodes in order of finding."""
    size = lambda action: (len(f"Domanda: {query}\nAzione corrente: {action}".encode()) + 3) // 4
    hits = sorted(search)[: limits.finds]
    taken, order, tokens = [("semantic_search", None)], list(hits), size("semantic_search")
    todo, stack = [], list(hits)
    if kind == "structural":
        seeds = hits[: max(limits.steps - 1, 0) // 2]
        todo = [("expand_dependencies", x) for x in seeds] + [("get_callers", x) for x in seeds] or [("expand_dependencies", None), ("get_callers", None)]
    new, left = True, bool(todo[0][1] if todo else hits)
    while True:
        if kind == "structural" and todo == []:
            return "plan_completed", len(taken), tokens, taken, order
        if len(taken) >= limits.steps:
            return "step_budget_exhausted", len(taken), tokens, taken, order
        if tokens >= limits.tokens:
            return "token_budget_exhausted", len(taken), tokens, taken, order
        if len(taken) > 1 and not new and not left:
            return "blast_radius_stabilized", len(taken), tokens, taken, order
        action, target = (todo.pop(0) if todo else ("get_callees", stack.pop() if stack else None))
        taken.append((action, target))
        found = sorted(near.get((action, target), ()))[: limits.finds] if target else []
        tokens += size(action) if target else 0
        fresh = [x for x in found if x not in order]
        order += fresh
        stack += fresh
        new, left = bool(fresh), left if kind == "structural" else bool(stack)


def test_exploration_equals_a_walk_by_hand(spark):
    ids = [f"n{i}" for i in range(9)]
    nodes = spark.createDataFrame([(x, "code", "Function", f"alpha {x}" if i < 4 else f"beta {x}") for i, x in enumerate(ids)], "id string, domain string, node_type string, name string")
    links = [(f"n{a}", f"n{b}", "CALLS") for a, b in ((0, 4), (0, 5), (1, 4), (2, 6), (3, 0), (4, 7), (5, 7), (7, 0), (6, 6), (8, 1), (3, 8), (7, 8), (6, 3))] + [("n0", "n8", "IMPORTS"), ("n1", "n2", "EXTENDS"), ("n1", "hidden", "IMPORTS")]
    near = {}
    for a, b, t in links:
        if b in ids and a != b:
            near.setdefault(("get_callees" if t == "CALLS" else "expand_dependencies", a), set()).add(b)
            if t == "CALLS":
                near.setdefault(("get_callers", b), set()).add(a)
    rel = spark.createDataFrame(links, "from_id string, to_id string, rel_type string")
    asked = [("s", "who calls alpha", "structural"), ("c", "how does alpha work", "conceptual"), ("h", "alpha?", "hybrid"), ("t", "who calls gamma", "structural"), ("g", "gamma", "hybrid")]
    questions = spark.createDataFrame([(q, text) for q, text, _ in asked] + [("e", " "), ("u", None)], "query_id string, query string")
    # words of the questions are found in names, of which only alpha is one
    for limits in (agent.Limits(), agent.Limits(steps=1), agent.Limits(steps=2), agent.Limits(steps=4), agent.Limits(tokens=30), agent.Limits(steps=6, finds=2), agent.Limits(finds=1)):
        got = agent.explore(questions, nodes, rel, limits)
        outcomes = {r["query_id"]: r for r in got.outcomes.collect()}
        trace, order = {}, {}
        for r in got.trace.collect():
            trace.setdefault(r["query_id"], []).append((r["step"], r["action"], r["target"]))
        for r in got.candidates.collect():
            order.setdefault(r["query_id"], []).append((r["place"], r["node_id"]))
        hits = [r["id"] for r in fulltext_batch(nodes, questions.select("query_id", F.lit("alpha").alias("text")).limit(1), limits.finds).collect()]
        for q, text, kind in asked:
            stop, n, tokens, taken, found = explored(text, kind, hits if "alpha" in text else [], near, limits)
            assert (outcomes[q]["stop"], outcomes[q]["n_steps"], outcomes[q]["n_tokens"], outcomes[q]["intent"]) == (stop, n, tokens, kind), (q, limits)
            assert [t[1:] for t in sorted(trace[q])] == taken and [x for _, x in sorted(order.get(q, []))] == found, (q, limits)
        assert outcomes["e"]["stop"] == outcomes["u"]["stop"] == "empty_question"
    asks = {(r["query_id"], r["step"]) for r in agent.explore(questions, nodes, rel).trace.where("prompt IS NOT NULL").collect()}
    assert max(s for q, s in asks if q == "s") == 9 and sum(q == "s" for q, _ in asks) == 1 and ("c", 1) in asks and not any(q in "tg" for q, _ in asks)
    with pytest.raises(ValueError):
        agent.Limits(steps=0)


def test_prompts_name_what_was_found(spark, rows):
    questions = spark.createDataFrame([("q", "why"), ("r", "how")], "query_id string, query string")
    found = spark.createDataFrame([("q", 2, "b", None, "File"), ("q", 1, "a", "alpha", "Class")], "query_id string, place int, node_id string, name string, node_type string")
    assert rows(agent.context_prompts(questions, found)) == [("q", "Domanda: why\nContesto:\n- alpha (Class) [a]\n-  (File) [b]"), ("r", "Domanda: how\nContesto:")]


def test_replies(spark, rows):
    fenced = '```json\n{"callers": ["a, b"], "methods": [], "node_type": "Class"}\n```'
    df = spark.createDataFrame([("q", fenced), ("r", "no json"), ("s", None), ("t", '{"a": [1]}'), ("u", '{"a": ["x"], "b": 1}'), ("v", '{"a": ""}'), ("w", "[1]"), ("x", '{"a": [null]}')], "query_id string, reply string")
    assert rows(agent.reply_facts(df)) == [("q", "callers", "a, b"), ("q", "methods", "__EMPTY__"), ("q", "node_type", "Class")]
    models = spark.createDataFrame([("vLLM-Fake",), ("real",), (None,)], "m string")
    assert [r[0] for r in models.select(agent.is_fake_model(F.col("m"))).collect()] == [True, False, False]


def test_tools_on_a_graph(spark, rows):
    nodes = spark.createDataFrame([("a", "code", "Function", "alpha", "h", "r", "p"), ("b", "code", "Function", "beta", "h", "r", "p")], "id string, domain string, node_type string, name string, ast_hash string, repo string, path string")
    rel = spark.createDataFrame([("b", "a", "CALLS")], "from_id string, to_id string, rel_type string")
    chunks = spark.createDataFrame([("a", 0, "text"), ("z", 0, "no")], "entity_id string, chunk_index int, text string")
    tools = agent.GraphTools(nodes, rel, chunks)
    assert rows(tools.callers("a"), "id") == [("b",)] and rows(tools.callees("b"), "id") == [("a",)] and rows(tools.dependencies("a")) == []
    assert rows(tools.read_source(spark.createDataFrame([("a",), ("z",)], "entity_id string"))) == [("a", "text")]


def test_cache(spark, rows):
    at = lambda s: F.lit(s).cast("timestamp")
    entries = spark.createDataFrame([("e", "h", "l", "s", "v", 0), ("f", "h", "l", "s", "w", 10)], "entity_id string, ast_hash string, logic string, acl_scope string, value string, ttl_s int")
    cache = answer.cache_put(entries, at("2026-01-01 00:00:00"))
    asked = spark.createDataFrame([("e", "h", "l", "s"), ("f", "h", "l", "s"), ("e", "h2", "l", "s"), ("e", "h", "l", "other")], "entity_id string, ast_hash string, logic string, acl_scope string")
    assert rows(answer.cache_get(asked, cache, at("2026-01-01 00:00:10"), "s"), "entity_id", "outcome", "value") == sorted([("e", "hit", "v"), ("f", "miss", None), ("e", "miss", None), ("e", "denied", None)], key=repr)
