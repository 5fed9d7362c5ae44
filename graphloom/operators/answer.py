"""Intent, claim verification, hierarchical summaries, fact canonicalisation, evaluation, result cache."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.ids import cache_key
from graphloom.operators.pack import citation
from graphloom.operators.traverse import relations_exist
from graphloom.sources.tables import cut

# Phrases that tell what a question asks for, in Italian and English.
STRUCTURAL = ["chi chiama", "who calls", "chiamanti", "impatto", "impact", "dipendenze", "dependencies", "implementa", "implements", "estende", "extends"]
CONCEPTUAL = ["come funziona", "how does", "cosa fa", "what does", "spiega", "explain", "comprendi", "understand", "descrivi", "describe"]


def intent(text: Column) -> Column:
    """struct(intent, graph_weight, vector_weight, evidence): structural, conceptual or hybrid; null for null and blank text."""
    low = F.lower(text)
    found = lambda words: F.filter(F.array(*(F.lit(w) for w in words)), lambda w: low.contains(w))
    s, c = found(STRUCTURAL), found(CONCEPTUAL)
    make = lambda name, g, v, e: F.struct(F.lit(name).alias("intent"), F.lit(g).alias("graph_weight"), F.lit(v).alias("vector_weight"), e.alias("evidence"))
    decided = F.when((F.size(s) > 0) & (F.size(c) == 0), make("structural", 0.75, 0.25, s)).when((F.size(c) > 0) & (F.size(s) == 0), make("conceptual", 0.25, 0.75, c)).otherwise(make("hybrid", 0.5, 0.5, F.concat(s, c)))
    return F.when(F.trim(text) != "", decided)


# Phrases that ask who calls something.
CALLERS = ["chi chiama", "who calls", "chiamanti di"]


def asks_for_callers(text: Column) -> Column:
    """Whether the text has one of the phrases, in any case; false for null."""
    low = F.lower(text)
    return F.coalesce(reduce(or_, (low.contains(p) for p in CALLERS)), F.lit(False))


def estimated_tokens(text: Column) -> Column:
    """A quarter of the bytes, rounded up."""
    return F.floor((F.octet_length(text) + 3) / 4).cast("int")


# --- claims -------------------------------------------------------------------------------------------------------

MAX_DEPTH, MAX_REGENERATIONS = 4, 2  # fixed values


def verify_claims(nodes: DataFrame, relations: DataFrame, symbols: DataFrame, links: DataFrame, citations: DataFrame, snippets: DataFrame) -> DataFrame:
    """answer_id, stage, code, detail: what is wrong with answers, judged by the nodes the caller may see.

    symbols: answer_id, node_id. links: answer_id, source_id, target_id, edge_type, depth. citations: answer_id,
    node_id, cited. snippets: answer_id, language, is_valid. Codes: symbol-hallucination, relation-nonexistent,
    citation-inaccessible, stale-citation, syntax-invalid. Absent and hidden nodes give the same codes.
    """
    ids = nodes.select(F.col("id").alias("node_id"))
    say = lambda df, stage, code, detail: df.select("answer_id", F.lit(stage).alias("stage"), F.lit(code).alias("code"), detail.alias("detail"))
    bad_symbols = say(symbols.join(ids, "node_id", "left_anti"), "symbol", "symbol-hallucination", F.col("node_id"))
    claims = links.withColumn("claim_id", F.struct("answer_id", "source_id", "target_id", "edge_type", "depth")).distinct()
    judged = relations_exist(nodes, relations, claims.select("claim_id", "source_id", "target_id", "edge_type", "depth"), MAX_DEPTH)
    judged = judged.join(ids.withColumnRenamed("node_id", "target_id").withColumn("t", F.lit(True)), "target_id", "left").select("claim_id", (F.col("holds") & F.col("t").isNotNull()).alias("holds"))
    bad_links = say(judged.where(~F.col("holds")).select("claim_id.*"), "relation", "relation-nonexistent", F.format_string("%s -[%s]-> %s", "source_id", "edge_type", "target_id"))
    now = nodes.select(F.col("id").alias("node_id"), citation(F.col("repo"), F.col("path"), F.col("start_line"), F.col("end_line"), F.col("commit_sha")).alias("now"))
    seen = citations.join(now, "node_id", "left")
    hidden = say(seen.where("now IS NULL"), "citation", "citation-inaccessible", F.lit("citation unavailable"))
    stale = say(seen.where("now IS NOT NULL AND NOT (cited <=> now)"), "citation", "stale-citation", F.col("node_id"))
    syntax = say(snippets.where(~F.coalesce("is_valid", F.lit(False))), "syntax", "syntax-invalid", F.coalesce("language", F.lit("unsupported-language")))
    return bad_symbols.unionByName(bad_links).unionByName(hidden).unionByName(stale).unionByName(syntax)


def checked_snippets(snippets: DataFrame) -> DataFrame:
    """answer_id, language, is_valid of snippets (answer_id, language, code): whether strings and brackets close; false for unread languages and null code."""

    def check(batches):
        import pyarrow as pa

        from graphloom.operators.parsing import syntax_ok

        for b in batches:
            ok = [code is not None and syntax_ok(language, code) for language, code in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok, pa.bool_())], names=["answer_id", "language", "is_valid"])

    return snippets.select("answer_id", "language", "code").mapInArrow(check, f"answer_id {dict(snippets.dtypes)['answer_id']}, language string, is_valid boolean")


def corrected_citations(nodes: DataFrame, citations: DataFrame) -> DataFrame:
    """answer_id, node_id, citation: citations of visible nodes as they should read now."""
    now = nodes.select(F.col("id").alias("node_id"), citation(F.col("repo"), F.col("path"), F.col("start_line"), F.col("end_line"), F.col("commit_sha")).alias("citation"))
    return citations.select("answer_id", "node_id").join(now, "node_id").select("answer_id", "node_id", "citation")


def answer_outcomes(answers: DataFrame, issues: DataFrame, max_regenerations: int = MAX_REGENERATIONS) -> DataFrame:
    """answers (answer_id, attempt) with n_issues and outcome: approved, corrected (stale citations alone), regenerated or degraded (no attempts left)."""
    per = issues.groupBy("answer_id").agg(F.count(F.lit(1)).alias("n_issues"), F.max((F.col("code") != "stale-citation").cast("int")).alias("grave"))
    rows = answers.join(per, "answer_id", "left").withColumn("n_issues", F.coalesce("n_issues", F.lit(0)))
    return rows.withColumn("outcome", F.when((F.col("grave") == 1) & (F.col("attempt") >= max_regenerations), "degraded").when(F.col("grave") == 1, "regenerated").when(F.col("n_issues") > 0, "corrected").otherwise("approved")).drop("grave")


def audit_event(columns: list[str]) -> Column:
    """struct(body, digest): canonical JSON of the columns in order of name, nulls left out, and its SHA-256."""
    body = F.to_json(F.struct(*(F.col(c) for c in sorted(columns))))
    return F.struct(body.alias("body"), F.sha2(body, 256).alias("digest"))


def audit_object(event_id: Column, digest: Column, recorded_at: Column, retention_s: int) -> Column:
    """struct(name, retain_until): the write-once object of an audit event; retention ends on a whole second, rounded up."""
    until = recorded_at + F.make_dt_interval(secs=F.lit(retention_s))
    second = F.date_trunc("second", until)
    return F.struct(F.concat(F.lit("audit/v1/"), F.date_format(recorded_at, "yyyy/MM/dd"), F.lit("/"), event_id, F.lit("-"), digest, F.lit(".json")).alias("name"), F.when(second < until, second + F.make_dt_interval(secs=F.lit(1))).otherwise(second).alias("retain_until"))


# --- hierarchical summaries ---------------------------------------------------------------------------------------

LEVELS = ["METHOD", "CLASS", "MODULE", "REPO"]
Summarise = Callable[[Column, Column, Column], Column]


def echo_summary(node_id: Column, source: Column, children: Column) -> Column:
    """A stand-in for a model: the id, the source's size, the children's summaries."""
    return F.concat(node_id, F.lit("("), F.octet_length(source).cast("string"), F.lit(")["), F.array_join(children, ";"), F.lit("]"))


def summary_views(items: DataFrame, root: str, visible: Column, tag: str = "summary-view-v1", cache: DataFrame | None = None, logic: str = "v1", acl_scope: str = "", summarise: Summarise = echo_summary) -> DataFrame:
    """id, level, visible, complete, effective_hash, cache_key, is_hit, summary of every item below the root, level by level.

    items: id, level (0 to 3), ast_hash, source, child_ids (in order) and what visible needs. An item is visible if its
    own predicate holds and that of all on a way down to it. It is complete if all its children are visible and
    complete; then its hash is ast_hash and the model sees its source. Otherwise the hash covers ast_hash and, of each
    child, id, visibility and the hash if visible, and the model sees visible children's summaries alone. cache:
    cache_key, summary. Items are folded to one row each; levels must fall from parent to child.
    """
    items = cut(items.withColumn("own", F.coalesce(visible, F.lit(False))))
    links = items.select(F.col("id").alias("parent"), F.posexplode("child_ids").alias("pos", "child"))
    spark = items.sparkSession
    reached = items.where((F.col("id") == root) & F.col("own")).select("id")
    all_below = items.where(F.col("id") == root).select("id")
    for _ in LEVELS[1:]:
        below = reached.join(links, F.col("id") == F.col("parent")).select(F.col("child").alias("id"))
        reached = cut(reached.unionByName(items.where("own").select("id").join(below, "id", "left_semi")).distinct())
        all_below = cut(all_below.unionByName(all_below.join(links, F.col("id") == F.col("parent")).select(F.col("child").alias("id"))).distinct())
    placed = items.join(all_below, "id", "left_semi").join(reached.withColumn("visible", F.lit(True)), "id", "left").withColumn("visible", F.coalesce("visible", F.lit(False)))
    placed = cut(placed)
    hits = cache.select("cache_key", F.col("summary").alias("cached")) if cache is not None else spark.createDataFrame([], "cache_key string, cached string")
    part = lambda x: F.concat(F.lpad(F.hex(F.octet_length(x)), 8, "0"), F.hex(F.encode(x, "UTF-8")))
    head = F.concat(F.hex(F.encode(F.lit(tag), "UTF-8")), part(F.col("ast_hash")))
    done = None
    for level in range(len(LEVELS)):
        rows = placed.where(F.col("level") == level)
        if done is None:
            kids = rows.select(F.col("id").alias("parent"), F.lit(True).alias("all_complete"), F.lit("").alias("view"), F.array().cast("array<string>").alias("texts")).where("size(texts) < 0")
        else:
            child = links.join(done.select(F.col("id").alias("child"), "visible", "complete", "effective_hash", "summary"), "child")
            view = F.concat(part(F.col("child")), F.when(F.col("visible"), F.concat(F.lit("01"), part(F.col("effective_hash")))).otherwise("00"))
            ordered = lambda x: F.transform(F.array_sort(F.collect_list(x)), lambda s: s["x"])
            kids = child.groupBy("parent").agg(
                F.min((F.col("visible") & F.col("complete")).cast("int")).cast("boolean").alias("all_complete"),
                F.array_join(ordered(F.struct("pos", view.alias("x"))), "").alias("view"),
                ordered(F.when(F.col("visible"), F.struct("pos", F.col("summary").alias("x")))).alias("texts"),
            )
        rows = rows.join(kids, F.col("id") == F.col("parent"), "left")
        complete = F.col("visible") & F.coalesce("all_complete", F.lit(True))
        rows = rows.withColumn("complete", complete).withColumn("texts", F.coalesce("texts", F.array().cast("array<string>")))
        rows = rows.withColumn("effective_hash", F.when(F.col("complete"), F.col("ast_hash")).when(F.col("visible"), F.sha2(F.unhex(F.concat(head, F.coalesce("view", F.lit("")))), 256)))
        rows = rows.withColumn("cache_key", F.when(F.col("visible"), cache_key(F.lit(""), F.col("effective_hash"), F.lit(logic), F.lit(acl_scope)))).join(hits, "cache_key", "left")
        made = summarise(F.col("id"), F.when(F.col("complete"), F.col("source")).otherwise(""), F.col("texts"))
        rows = rows.select("id", "level", "visible", "complete", "effective_hash", "cache_key", F.col("cached").isNotNull().alias("is_hit"), F.when(F.col("visible"), F.coalesce("cached", made)).alias("summary"))
        below = cut(rows)
        done = below if done is None else done.unionByName(below)
    return done


# --- cache --------------------------------------------------------------------------------------------------------


def cache_get(requests: DataFrame, cache: DataFrame, now: Column, caller_scope: str) -> DataFrame:
    """requests (entity_id, ast_hash, logic, acl_scope) with outcome (hit, miss or denied: another scope than the caller's) and value."""
    key = cache_key(F.col("entity_id"), F.col("ast_hash"), F.col("logic"), F.col("acl_scope"))
    fresh = cache.where(F.col("expires_at").isNull() | (F.col("expires_at") > now)).select("cache_key", F.col("value"))
    rows = requests.withColumn("cache_key", key).join(fresh, "cache_key", "left")
    mine = F.coalesce(F.col("acl_scope") == caller_scope, F.lit(False))
    return rows.withColumn("outcome", F.when(~mine, "denied").when(F.col("value").isNotNull(), "hit").otherwise("miss")).withColumn("value", F.when(mine, F.col("value"))).drop("cache_key")


def cache_put(entries: DataFrame, now: Column) -> DataFrame:
    """cache_key, value, expires_at of entries (entity_id, ast_hash, logic, acl_scope, value, ttl_s); ttl 0 or null never ends."""
    key = cache_key(F.col("entity_id"), F.col("ast_hash"), F.col("logic"), F.col("acl_scope"))
    return entries.select(key.alias("cache_key"), "value", F.when(F.col("ttl_s") > 0, now + F.make_dt_interval(secs=F.col("ttl_s"))).alias("expires_at"))


# --- facts --------------------------------------------------------------------------------------------------------

IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*"
FACT_NODE_TYPES = ["File", "Module", "Package", "Class", "Interface", "Method", "Function"]
EMPTY = "__EMPTY__"


def resolve_symbols(names: DataFrame, symbols: DataFrame) -> DataFrame:
    """names (column name, distinct) with status (exact, unique, ambiguous, not_found) and canonical.

    symbols: symbol. A name is exact if it is a symbol, unique if it is the last part of one symbol alone.
    """
    known = symbols.select("symbol").distinct()
    leaves = known.groupBy(F.element_at(F.split("symbol", r"\."), -1).alias("name")).agg(F.count(F.lit(1)).alias("n"), F.min("symbol").alias("leaf"))
    rows = names.select("name").distinct().join(known.select(F.col("symbol").alias("name"), F.lit(True).alias("is_exact")), "name", "left").join(leaves, "name", "left")
    status = F.when(F.col("is_exact"), "exact").when(F.col("n") == 1, "unique").when(F.col("n") > 1, "ambiguous").otherwise("not_found")
    return rows.select("name", status.alias("status"), F.when(F.col("is_exact"), F.col("name")).when(F.col("n") == 1, F.col("leaf")).alias("canonical"))


def canonicalise(facts: DataFrame, symbols: DataFrame) -> DataFrame:
    """facts (query_id, kind, value) with canonical, status, issue and is_raw (the value was canonical already).

    callers: `X <- Y`, both resolved. node_type: a known type. Others: an identifier, or one with further words, which is
    verbose. issue: semantic_error, ambiguous_canonicalization, verbose_fact, unqualified_symbol or null.
    """
    pair = F.split("value", " <- ")
    is_pair = (F.col("kind") == "callers") & (F.size(pair) == 2) & F.forall(pair, lambda p: p.rlike(f"^{IDENTIFIER}$"))
    verbose = F.regexp_extract("value", rf"(?s)^({IDENTIFIER})\s+.+$", 1)
    is_verbose = (F.col("kind") != "callers") & (verbose != "")
    plain = F.col("value").rlike(f"^{IDENTIFIER}$")
    rows = facts.withColumn("a", F.when(is_pair, pair[0]).when(is_verbose, verbose).when((F.col("kind") != "callers") & plain, F.col("value"))).withColumn("b", F.when(is_pair, pair[1])).withColumn("is_verbose", is_verbose)
    found = resolve_symbols(rows.select(F.col("a").alias("name")).union(rows.select("b")).where("name IS NOT NULL"), symbols)
    for side in ("a", "b"):
        rows = rows.join(found.select(F.col("name").alias(side), F.col("status").alias(f"{side}_status"), F.col("canonical").alias(f"{side}_name")), side, "left")
    is_empty, is_type = F.col("value") == EMPTY, F.col("kind") == "node_type"
    good_type = F.col("a").isin(FACT_NODE_TYPES)
    is_caller = F.col("kind") == "callers"
    ambiguous = (F.col("a_status") == "ambiguous") | F.coalesce(F.col("b_status") == "ambiguous", F.lit(False))
    lost = F.coalesce(F.col("a_status"), F.lit("not_found")) == "not_found"
    lost = lost | (is_caller & (F.coalesce(F.col("b_status"), F.lit("not_found")) == "not_found"))
    status = (
        F.when(is_empty, "exact").when(is_type, F.when(F.coalesce(good_type, F.lit(False)), "exact").otherwise("not_found"))
        .when(F.coalesce(ambiguous, F.lit(False)), "ambiguous").when(lost, "not_found")
        .when((F.col("a_status") == "exact") & (~is_caller | (F.col("b_status") == "exact")), "exact").otherwise("unique")
    )
    rows = rows.withColumn("status", status)
    ok = F.col("status").isin("exact", "unique")
    canonical = F.when(is_empty, F.col("value")).when(ok & is_type, F.col("a")).when(ok & is_caller, F.concat_ws(" <- ", "a_name", "b_name")).when(ok, F.col("a_name"))
    issue = F.when(F.col("status") == "ambiguous", "ambiguous_canonicalization").when(F.col("status") == "not_found", "semantic_error").when(~is_empty & F.col("is_verbose"), "verbose_fact").when(F.col("status") == "unique", "unqualified_symbol")
    return rows.select("query_id", "kind", "value", canonical.alias("canonical"), "status", issue.alias("issue")).withColumn("is_raw", F.coalesce(F.col("canonical") == F.col("value"), F.lit(False)))


def compare_facts(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """query_id, n_expected, n_actual, n_resolved, exact_matched, semantic_matched, unexpected, missing, exact_recall, semantic_recall, coverage.

    actual: query_id, kind, canonical (null: unresolved), is_raw. expected: query_id, kind, value, distinct. Recalls are
    1 without expected facts, coverage is 1 without actual ones.
    """
    right = expected.select("query_id", "kind", F.col("value").alias("canonical"), F.lit(1).alias("wanted")).distinct()
    per_fact = actual.where("canonical IS NOT NULL").groupBy("query_id", "kind", "canonical").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("is_raw").cast("int")).alias("raw"))
    both = right.join(per_fact, ["query_id", "kind", "canonical"], "full").groupBy("query_id").agg(
        F.count("wanted").alias("n_expected"),
        F.count(F.when(F.col("wanted").isNotNull() & (F.col("raw") == 1), 1)).alias("exact_matched"),
        F.count(F.when(F.col("wanted").isNotNull() & F.col("n").isNotNull(), 1)).alias("semantic_matched"),
        F.coalesce(F.sum(F.when(F.col("wanted").isNull(), F.col("n"))), F.lit(0)).alias("unexpected"),
        F.count(F.when(F.col("n").isNull(), 1)).alias("missing"),
    )
    counts = actual.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_actual"), F.count("canonical").alias("n_resolved"))
    rows = both.join(counts, "query_id", "full").fillna(0)
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(1.0)
    return rows.withColumn("exact_recall", share("exact_matched", "n_expected")).withColumn("semantic_recall", share("semantic_matched", "n_expected")).withColumn("coverage", share("n_resolved", "n_actual"))


def evaluation_summary(records: DataFrame, comparisons: DataFrame) -> DataFrame:
    """One row: query_count, success_count, pass_rate, fact_recall (over all facts), exact and semantic recall, coverage, p50 and p95 of latency.

    records: query_id, passed, error, latency_ms. p95 is the nearest rank: the smallest latency that 95 % of them don't
    pass.
    """
    per_record = records.agg(
        F.count(F.lit(1)).alias("query_count"),
        F.count(F.when(F.col("error").isNull(), 1)).alias("success_count"),
        F.coalesce(F.avg(F.col("passed").cast("double")), F.lit(0.0)).alias("pass_rate"),
        F.percentile("latency_ms", 0.5).alias("latency_p50_ms"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY latency_ms)").cast("double").alias("latency_p95_ms"),
    )
    share = lambda a, b: F.when(F.sum(b) > 0, F.sum(a) / F.sum(b)).otherwise(1.0)
    facts = comparisons.agg(share("exact_matched", "n_expected").alias("exact_recall"), share("semantic_matched", "n_expected").alias("fact_recall"), share("n_resolved", "n_actual").alias("coverage"))
    row = {**per_record.first().asDict(), **facts.first().asDict()}
    return records.sparkSession.createDataFrame([tuple(row.values())], "query_count bigint, success_count bigint, pass_rate double, latency_p50_ms double, latency_p95_ms double, exact_recall double, fact_recall double, coverage double")
