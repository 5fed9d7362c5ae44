"""Queries on the change pipeline, upkeep, extraction and answers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import answer, cdc, extract, ingest, maintain
from graphloom.operators.changes import current_state
from graphloom.operators.traverse import hierarchy_violations
from graphloom.plans.graph_sql import CODE, STAR
from graphloom.sources import read
from graphloom.sources.graph import code_graph, code_nodes, key_id, star_graph
from graphloom.streaming.outbox import run_outbox, scratch

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- outbox -------------------------------------------------------------------------------------------------------

_OUTCOME = """CASE WHEN aggregate_id IS NULL THEN 'heartbeat' WHEN id IS NULL OR created_at IS NULL OR aggregate_type IS NULL OR event_type IS NULL THEN 'missing_key'
 WHEN aggregate_type NOT IN ('CodeNode', 'CodeRelation', 'CodeChunk', 'CodeEmbedding') THEN 'unknown_aggregate_type' WHEN upper(trim(event_type)) NOT IN ('UPSERT', 'DELETE') THEN 'unknown_event_type'
 WHEN payload IS NULL OR NOT json_valid(payload) OR NOT trim(payload) LIKE '{%' THEN 'bad_payload' ELSE 'accepted' END"""


@query(f"SELECT {_OUTCOME} AS outcome, aggregate_type, count(*) AS n FROM outbox GROUP BY ALL")
def envelope_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return cdc.routed(read(spark, sf, "outbox")).groupBy("outcome", "aggregate_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT delivery_seq, 'outbox.event.' || aggregate_type AS topic, aggregate_id AS message_key FROM outbox WHERE {_OUTCOME} = 'accepted'")
def outbox_routing(spark: SparkSession, sf: str) -> DataFrame:
    return cdc.routed(read(spark, sf, "outbox")).where("outcome = 'accepted'").select("delivery_seq", "topic", "message_key")


@query(f"SELECT delivery_seq, payload->>'id' AS node_id, payload->>'name' AS name, payload->'provenance'->>'commit_sha' AS commit_sha FROM outbox WHERE {_OUTCOME} = 'accepted' AND aggregate_type = 'CodeNode'")
def node_payloads(spark: SparkSession, sf: str) -> DataFrame:
    return cdc.payloads(read(spark, sf, "outbox"), "CodeNode").select("delivery_seq", F.col("p.id").alias("node_id"), F.col("p.name").alias("name"), F.col("p.provenance.commit_sha").alias("commit_sha"))


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").select(F.col("user_id").alias("event_id"), "event_type", F.col("event_id").alias("delivery"))


@query("SELECT DISTINCT user_id AS event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND event_id % 19 = 0)")
def ledger_unseen(spark: SparkSession, sf: str) -> DataFrame:
    """Users as event ids; those with a purchase are marked for this consumer, those with a view for another."""
    e = _events(spark, sf)
    ledger = cdc.ledger_rows(e.where("event_type = 'purchase' AND delivery % 19 = 0"), "sink-graph").unionByName(cdc.ledger_rows(e.where("event_type = 'view'"), "sink-search"))
    return cdc.unseen(e, ledger, "sink-graph").select("event_id")


@query()
def stream_state(spark: SparkSession, sf: str) -> DataFrame:
    """The state that the stream reaches, which is that of p3_found."""
    return current_state(run_outbox(spark, sf, scratch(spark, "outbox"))).select("aggregate_id", "event_id")


ORACLES["stream_state"] = """WITH c AS (SELECT *, CASE WHEN regexp_full_match(regexp_replace(regexp_replace(lower(id), '[\\s{}()]', '', 'g'), '^urn:uuid:|-', '', 'g'), '[0-9a-f]{32}')
 THEN regexp_replace(regexp_replace(regexp_replace(lower(id), '[\\s{}()]', '', 'g'), '^urn:uuid:|-', '', 'g'), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') ELSE id END AS event_id, upper(trim(event_type)) AS op FROM outbox WHERE aggregate_id IS NOT NULL),
 r AS (SELECT *, row_number() OVER (PARTITION BY aggregate_id ORDER BY created_at DESC, tx_order DESC, op, event_id DESC) AS rn FROM c WHERE op IN ('UPSERT', 'DELETE')) SELECT aggregate_id, event_id FROM r WHERE rn = 1 AND op = 'UPSERT'"""


def _merge_input(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers of the star graph: two thirds are there, half are updated (renamed, moved, or the same), the partitions of three repositories exist."""
    n = star_graph(spark, sf).nodes.where("node_type = 'Class'").select("id", *cdc.NODE_VALUES)
    k = F.substring("id", 3, 20).cast("bigint")
    current = n.where(k % 3 != 0)
    updates = n.where(k % 2 == 0).withColumn("name", F.when(k % 4 == 0, F.concat("name", F.lit("'"))).otherwise(F.col("name"))).withColumn("repo", F.when(k % 5 == 0, "repo9").otherwise(F.col("repo")))
    partitions = n.where("repo <> 'repo3'").select(*cdc.SCOPE).distinct().withColumn("generation", F.lit(3).cast("bigint"))
    return current, updates, partitions


_MERGE = f"""WITH {STAR}, n AS (SELECT *, CAST(substring(id, 3) AS BIGINT) AS k FROM nodes WHERE node_type = 'Class'), cur AS (SELECT * FROM n WHERE k % 3 <> 0),
 upd AS (SELECT * REPLACE (CASE WHEN k % 4 = 0 THEN name || '''' ELSE name END AS name, CASE WHEN k % 5 = 0 THEN 'repo9' ELSE repo END AS repo) FROM n WHERE k % 2 = 0),
 chg AS (SELECT u.id, NOT coalesce(u.name = c.name AND u.repo = c.repo AND u.domain = c.domain AND u.ast_hash = c.ast_hash, FALSE) AS changed, u.tenant_id, u.repo, u.acl_group, c.tenant_id AS t2, c.repo AS r2, c.acl_group AS a2 FROM upd u LEFT JOIN cur c ON c.id = u.id)"""


@query(f"{_MERGE} SELECT id, domain, name, repo FROM cur WHERE id NOT IN (SELECT id FROM upd) UNION ALL SELECT id, domain, name, repo FROM upd")
def node_merge(spark: SparkSession, sf: str) -> DataFrame:
    return cdc.merge_nodes(*_merge_input(spark, sf))[0].select("id", "domain", "name", "repo")


@query(f"""{_MERGE}, touch AS (SELECT id, changed, tenant_id, repo, acl_group FROM chg UNION SELECT id, changed, t2, r2, a2 FROM chg WHERE r2 IS NOT NULL),
 per AS (SELECT tenant_id, repo, acl_group, sum(changed::BIGINT) AS n, arg_min(changed::BIGINT, id) AS first FROM touch GROUP BY ALL), part3 AS (SELECT DISTINCT tenant_id, repo, acl_group, 3 AS generation FROM n WHERE repo <> 'repo3')
 SELECT coalesce(p.tenant_id, t.tenant_id) AS tenant_id, coalesce(p.repo, t.repo) AS repo, coalesce(p.acl_group, t.acl_group) AS acl_group, CAST(CASE WHEN p.repo IS NOT NULL THEN 3 + coalesce(t.n, 0) ELSE 1 + t.n - t.first END AS BIGINT) AS generation
 FROM part3 p FULL JOIN per t ON p.tenant_id = t.tenant_id AND p.repo = t.repo AND p.acl_group = t.acl_group""")
def node_merge_generation(spark: SparkSession, sf: str) -> DataFrame:
    return cdc.merge_nodes(*_merge_input(spark, sf))[1]


def _relation_merge(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders to parts: relations of odd orders exist, those of orders divisible by 3 are updated to twice their weight or the same; parts above 150 are unknown nodes."""
    graph = star_graph(spark, sf)
    order, part = F.substring("from_id", 3, 20).cast("bigint"), F.substring("to_id", 3, 20).cast("bigint")
    rel = graph.relations.where("rel_type = 'CALLS'").select("from_id", "rel_type", "to_id", "weight")
    nodes = graph.nodes.where("node_type IN ('Method', 'Function')").where(~((F.col("node_type") == "Function") & (F.substring("id", 3, 20).cast("bigint") > 150)))
    partitions = nodes.select(*cdc.SCOPE).distinct().withColumn("generation", F.lit(1).cast("bigint"))
    updates = rel.where(order % 3 == 0).withColumn("weight", F.when(part % 2 == 0, F.col("weight") * 2).when(part % 7 == 0, F.lit(None)).otherwise(F.col("weight")))
    return cdc.merge_relations(nodes, rel.where(order % 2 == 1), updates, partitions)


_REL_MERGE = f"""WITH {STAR}, r AS (SELECT *, CAST(substring(from_id, 3) AS BIGINT) AS o, CAST(substring(to_id, 3) AS BIGINT) AS p FROM rel WHERE rel_type = 'CALLS'), cur AS (SELECT * FROM r WHERE o % 2 = 1),
 upd AS (SELECT * REPLACE (CASE WHEN p % 2 = 0 THEN weight * 2 WHEN p % 7 = 0 THEN 1 ELSE weight END AS weight) FROM r WHERE o % 3 = 0)"""


@query(f"{_REL_MERGE} SELECT from_id, to_id, weight FROM cur WHERE o % 3 <> 0 UNION ALL SELECT from_id, to_id, weight FROM upd")
def relation_merge(spark: SparkSession, sf: str) -> DataFrame:
    return _relation_merge(spark, sf)[1].select("from_id", "to_id", "weight")


@query(f"{_REL_MERGE} SELECT DISTINCT to_id AS id FROM upd WHERE p > 150")
def relation_placeholders(spark: SparkSession, sf: str) -> DataFrame:
    return _relation_merge(spark, sf)[0].where("tenant_id IS NULL").select("id")


@query(f"""{_REL_MERGE}, kn AS (SELECT * FROM nodes WHERE node_type = 'Method' OR (node_type = 'Function' AND CAST(substring(id, 3) AS BIGINT) <= 150)),
 chg AS (SELECT u.from_id, u.to_id, NOT coalesce(u.weight = c.weight, FALSE) AS changed FROM upd u LEFT JOIN cur c ON c.from_id = u.from_id AND c.to_id = u.to_id),
 touch AS (SELECT from_id, to_id, changed, tenant_id, repo, acl_group FROM chg JOIN kn ON kn.id = from_id UNION SELECT from_id, to_id, changed, tenant_id, repo, acl_group FROM chg JOIN kn ON kn.id = to_id),
 per AS (SELECT tenant_id, repo, acl_group, sum(changed::BIGINT) AS n FROM touch GROUP BY ALL), parts AS (SELECT DISTINCT tenant_id, repo, acl_group FROM kn)
 SELECT parts.*, CAST(1 + coalesce(n, 0) AS BIGINT) AS generation FROM parts LEFT JOIN per USING (tenant_id, repo, acl_group)""")
def relation_merge_generation(spark: SparkSession, sf: str) -> DataFrame:
    return _relation_merge(spark, sf)[2]


@query("""WITH m AS (SELECT event_id, event_type IN ('error', 'click') AS failed, user_id % 10 <> 0 AS retryable, CASE WHEN event_id % 13 = 0 THEN 'x' WHEN event_id % 4 <> 0 THEN CAST(event_id % 8 AS VARCHAR) END AS header FROM events),
 a AS (SELECT *, coalesce(TRY_CAST(header AS INTEGER), 0) AS n FROM m)
 SELECT event_id, CASE WHEN NOT failed THEN 'processed' WHEN NOT retryable THEN 'failed' WHEN n < 5 THEN 'retried' ELSE 'dead_lettered' END AS outcome,
 CASE WHEN failed AND retryable THEN CASE WHEN n < 5 THEN 'outbox.event.CodeNode.retry' ELSE 'outbox.event.CodeNode.DLQ' END END AS topic,
 CAST(CASE WHEN failed AND retryable AND n < 5 THEN n + 1 ELSE n END AS INTEGER) AS attempt, CAST(CASE WHEN failed AND retryable AND n < 5 THEN pow(2, n) ELSE 0 END AS BIGINT) AS delay_s FROM a""")
def retry_routes(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    header = F.when(i % 13 == 0, "x").when(i % 4 != 0, (i % 8).cast("string"))
    topic = F.when(i % 2 == 0, "outbox.event.CodeNode.retry").otherwise("outbox.event.CodeNode")
    route = cdc.retry_route(F.col("event_type").isin("error", "click"), F.col("user_id") % 10 != 0, header, topic, retry_suffix=".retry")
    return read(spark, sf, "events").select("event_id", route.alias("r")).select("event_id", "r.*")


_PATH_OK = "length(p) BETWEEN 1 AND 1024 AND NOT contains(p, '\\') AND len(list_filter(string_split(p, '/'), lambda s: s IN ('', '.', '..'))) = 0 AND regexp_matches(p, '[^/]\\.(go|js|ts)$')"


@query(f"WITH d AS (SELECT DISTINCT provenance.path AS p FROM code_node UNION SELECT DISTINCT path FROM documents UNION SELECT DISTINCT '/' || path FROM documents UNION SELECT DISTINCT replace(path, '/', '//') FROM documents) SELECT p AS path, coalesce({_PATH_OK}, FALSE) AS valid FROM d")
def path_validity(spark: SparkSession, sf: str) -> DataFrame:
    nodes, docs = read(spark, sf, "code_node").select(F.col("provenance.path").alias("path")), read(spark, sf, "documents")
    paths = nodes.union(docs.select("path")).union(docs.select(F.concat(F.lit("/"), "path"))).union(docs.select(F.replace("path", F.lit("/"), F.lit("//")))).distinct()
    return paths.select("path", cdc.valid_path(F.col("path")).alias("valid"))


@query("""WITH c AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN '2' ELSE '1' END AS v, sha256(CAST(event_id AS VARCHAR)) AS h, CASE WHEN event_id % 6 = 0 THEN '../a.go' ELSE 'src/a.go' END AS p, CASE WHEN event_id % 15 = 0 THEN 99999999 ELSE user_id END AS n, CASE WHEN user_id % 9 = 0 THEN ' t' ELSE 't' END AS t FROM events)
 SELECT event_id, CASE WHEN t = ' t' THEN 'invalid_scope' WHEN v = '2' OR event_id % 14 = 0 THEN 'invalid_payload' WHEN p = '../a.go' THEN 'invalid_path' WHEN n > 16777216 THEN 'source_too_large' ELSE 'accepted' END AS outcome FROM c""")
def command_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    digest = F.sha2(i.cast("string"), 256)
    payload = F.to_json(F.struct(
        F.when(i % 10 == 0, "2").otherwise("1").alias("schema_version"), F.lit("c").alias("command_id"), F.when(i % 14 == 0, "zz").otherwise(F.substring(digest, 1, 40)).alias("commit_sha"),
        F.when(i % 6 == 0, "../a.go").otherwise("src/a.go").alias("path"), digest.alias("source_sha256"), F.when(i % 15 == 0, 99999999).otherwise(F.col("user_id")).alias("source_size_bytes"),
    ))
    tenant = F.when(F.col("user_id") % 9 == 0, " t").otherwise("t")
    return read(spark, sf, "events").select("event_id", cdc.command_outcome(payload, [tenant, F.lit("r"), F.lit("g")]).alias("outcome"))


@query("""SELECT event_id, CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 OR event_id % 13 = 0 OR user_id % 9 = 0 THEN 'invalid_scope' ELSE 'accepted' END AS outcome FROM events""")
def command_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Commands whose scope comes in headers: some lack one, give one twice, or have one that is no UTF-8 or has a blank at its end."""
    i = F.col("event_id")
    header = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    text = lambda v: F.encode(v, "UTF-8")
    tenant = F.when(i % 13 == 0, F.unhex(F.lit("FF"))).otherwise(text(F.when(F.col("user_id") % 9 == 0, "t ").otherwise("t")))
    headers = F.array(header("tenant-id", tenant), header("repository", text(F.lit("r"))), header("other", tenant), header("acl-group", text(F.lit("g"))))
    headers = F.when(i % 7 == 0, F.concat(headers, F.array(header("repository", text(F.lit("r")))))).when(i % 11 == 0, F.slice(headers, 2, 3)).otherwise(headers)
    digest = F.sha2(i.cast("string"), 256)
    payload = F.to_json(F.struct(F.lit("1").alias("schema_version"), F.lit("c").alias("command_id"), F.substring(digest, 1, 40).alias("commit_sha"), F.lit("a.go").alias("path"), digest.alias("source_sha256"), F.lit(1).alias("source_size_bytes")))
    return read(spark, sf, "events").select("event_id", cdc.command_outcome(payload, cdc.scope_of_headers(headers)).alias("outcome"))


@query("""SELECT CASE WHEN doc_id % 10 = 0 THEN 'source_not_found' WHEN doc_id % 9 = 0 THEN 'source_size_mismatch' WHEN contains(text, chr(0)) THEN 'source_contains_nul' WHEN doc_id % 4 = 0 THEN 'duplicate' ELSE 'apply' END AS outcome, count(*) AS n FROM documents WHERE text IS NOT NULL AND strlen(text) <= 16777216 GROUP BY ALL""")
def ingest_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as sources of commands: a tenth is not there, some have another size, a quarter was applied before."""
    d = read(spark, sf, "documents").where(F.col("text").isNotNull() & (F.octet_length("text") <= cdc.MAX_SOURCE_BYTES)).select("doc_id", F.encode("text", "UTF-8").alias("content"))
    d = d.withColumn("source_sha256", F.sha2(F.concat(F.col("doc_id").cast("string").cast("binary"), "content"), 256))
    sources = d.where("doc_id % 10 <> 0").select(F.sha2("content", 256).alias("source_sha256"), "content")
    size = F.octet_length("content") + F.when(F.col("doc_id") % 9 == 0, 1).otherwise(0)
    fields = [F.lit("1").alias("schema_version"), F.col("doc_id").cast("string").alias("command_id"), F.lit("a" * 40).alias("commit_sha"), F.concat(F.col("doc_id").cast("string"), F.lit(".go")).alias("path"), F.when(F.col("doc_id") % 10 == 0, F.sha2(F.col("doc_id").cast("string"), 256)).otherwise(F.sha2("content", 256)).alias("source_sha256"), size.alias("source_size_bytes")]
    commands = d.select("doc_id", F.to_json(F.struct(*fields)).alias("payload"), *(F.lit(x).alias(x) for x in ingest.SCOPE))
    first = ingest.judged_commands(commands, commands.limit(0).select(F.lit("").alias("command_id"), F.lit("").alias("fingerprint")), sources)
    receipts = first.where("outcome = 'apply' AND CAST(command_id AS BIGINT) % 4 = 0").select("command_id", "fingerprint")
    return ingest.judged_commands(commands, receipts, sources).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT user_id, min(event_type) AS f FROM events WHERE event_id % 3 = 0 GROUP BY user_id) SELECT event_id, CASE WHEN f IS NULL THEN 'applied' WHEN f = event_type THEN 'duplicate' ELSE 'conflict' END AS outcome FROM events LEFT JOIN r USING (user_id)""")
def receipt_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events")
    receipts = e.where("event_id % 3 = 0").groupBy(F.col("user_id").alias("command_id")).agg(F.min("event_type").alias("fingerprint"))
    return cdc.receipt_outcomes(e.select("event_id", F.col("user_id").alias("command_id"), F.col("event_type").alias("fingerprint")), receipts).select("event_id", "outcome")


@query("""WITH f AS (SELECT 9000000 + row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS pos, l_orderkey FROM lineitem WHERE l_orderkey % 5 = 0 AND l_linenumber = 1)
 SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey % 5 <> 0 GROUP BY ALL UNION ALL SELECT l_orderkey, count(*) FROM f GROUP BY ALL""")
def replaced_children(spark: SparkSession, sf: str) -> DataFrame:
    """Orders divisible by 5 were parsed again: their lines are replaced by their first lines."""
    lines = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    fresh = lines.where("l_orderkey % 5 = 0 AND l_linenumber = 1")
    return cdc.replace_by_parent(lines, fresh, lines.where("l_orderkey % 5 = 0"), "l_orderkey").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


# --- upkeep -------------------------------------------------------------------------------------------------------


def _reconcile_sql(target: str) -> str:
    return f"""WITH v AS (SELECT id, max(fingerprint) AS f FROM view_row WHERE target = '{target}' GROUP BY id), o AS (SELECT s.id, s.fingerprint, CASE WHEN s.id IS NULL THEN 'error' WHEN v.id IS NOT NULL AND s.fingerprint IS NOT DISTINCT FROM v.f THEN 'match' ELSE 'republish' END AS outcome FROM source_row s LEFT JOIN v ON v.id = s.id WHERE s.target = '{target}')"""


@query(f"{_reconcile_sql('graph')} SELECT id, fingerprint, outcome FROM o")
def reconcile_graph(spark: SparkSession, sf: str) -> DataFrame:
    side = lambda t: read(spark, sf, t).where("target = 'graph'")
    return maintain.reconcile(side("source_row"), side("view_row")).select("id", "fingerprint", "outcome")


@query(f"{_reconcile_sql('vector')} SELECT id, fingerprint, outcome FROM o")
def reconcile_vector(spark: SparkSession, sf: str) -> DataFrame:
    side = lambda t: read(spark, sf, t).where("target = 'vector'")
    return maintain.reconcile(side("source_row"), side("view_row")).select("id", "fingerprint", "outcome")


@query("""WITH c AS (SELECT id, max(entity_id) AS f FROM code_chunk GROUP BY id), s AS (SELECT DISTINCT e.id, c.f FROM code_embedding e JOIN c ON c.id = e.chunk_id), v AS (SELECT id, max(fingerprint) AS f FROM view_row WHERE target = 'vector' GROUP BY id)
 SELECT CASE WHEN s.id IS NULL THEN 'error' WHEN v.id IS NOT NULL AND s.f IS NOT DISTINCT FROM v.f THEN 'match' ELSE 'republish' END AS outcome, count(*) AS n FROM s LEFT JOIN v ON v.id = s.id GROUP BY ALL""")
def reconcile_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings with the entities of their chunks against the vector view."""
    s = maintain.vector_sources(read(spark, sf, "code_embedding"), read(spark, sf, "code_chunk"))
    rows = maintain.reconcile(s, read(spark, sf, "view_row").where("target = 'vector'"))
    return rows.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT id, any_value(text) AS text FROM code_chunk GROUP BY id), v AS (SELECT id, CASE WHEN ascii(id) % 5 = 0 THEN upper(text) ELSE text END AS f FROM s WHERE ascii(substring(id, 2, 1)) % 7 <> 0)
 SELECT CASE WHEN v.id IS NOT NULL AND s.text IS NOT DISTINCT FROM v.f THEN 'match' ELSE 'republish' END AS outcome, count(*) AS n FROM s LEFT JOIN v USING (id) GROUP BY ALL""")
def reconcile_text(spark: SparkSession, sf: str) -> DataFrame:
    """Chunk texts against a text view that lost some and changed others."""
    s = read(spark, sf, "code_chunk").groupBy("id").agg(F.first("text").alias("text"))
    view = s.where(F.ascii(F.substring("id", 2, 1)) % 7 != 0).withColumn("text", F.when(F.ascii("id") % 5 == 0, F.upper("text")).otherwise(F.col("text")))
    return maintain.reconcile(s, view, fingerprint="text").groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH v AS (SELECT target, id, max(fingerprint) AS f FROM view_row GROUP BY ALL), o AS (SELECT s.target, CASE WHEN v.id IS NOT NULL AND s.fingerprint IS NOT DISTINCT FROM v.f THEN 'match' ELSE 'republish' END AS outcome FROM source_row s LEFT JOIN v ON v.id = s.id AND v.target = s.target)
 SELECT target, count(*) AS checked, count(*) FILTER (outcome = 'match') AS matched, count(*) FILTER (outcome = 'republish') AS republished, CAST(0 AS BIGINT) AS errored FROM o GROUP BY target""")
def reconcile_counts(spark: SparkSession, sf: str) -> DataFrame:
    key = lambda t: read(spark, sf, t).withColumn("id", F.struct("target", "id"))
    return maintain.reconcile_report(maintain.reconcile(key("source_row"), key("view_row")), "target")


@query(f"WITH {CODE}, v AS (SELECT id, max(fingerprint) AS f FROM view_row WHERE target = 'graph' GROUP BY id), w AS (SELECT DISTINCT s.id FROM source_row s LEFT JOIN v ON v.id = s.id WHERE s.target = 'graph' AND NOT (v.id IS NOT NULL AND s.fingerprint IS NOT DISTINCT FROM v.f)) SELECT id, repo, tenant_id, acl_group, path FROM nodes WHERE id IN (SELECT id FROM w)")
def republished_nodes(spark: SparkSession, sf: str) -> DataFrame:
    rows = maintain.republished_nodes(reconcile_graph(spark, sf), code_nodes(spark, sf))
    p = F.from_json("payload", "provenance struct<repo: string, tenant_id: string, acl_group: string, path: string>")["provenance"]
    return rows.select("id", *(p[c].alias(c) for c in ("repo", "tenant_id", "acl_group", "path")))


NOW = dt.datetime(2026, 6, 1, tzinfo=dt.UTC)


@query("SELECT count(*) FILTER (created_at < TIMESTAMPTZ '2026-05-25 00:00:00+00') AS purged, count(*) FILTER (created_at >= TIMESTAMPTZ '2026-05-25 00:00:00+00' OR created_at IS NULL) AS kept FROM outbox")
def gc_dry_run(spark: SparkSession, sf: str) -> DataFrame:
    kept, purged = maintain.purge(read(spark, sf, "outbox"), "created_at", NOW)
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return count(purged, "purged").withColumn("k", F.lit(1)).join(count(kept, "kept").withColumn("k", F.lit(1)), "k").drop("k")


# --- extraction ---------------------------------------------------------------------------------------------------


@query()
def chunked_documents(spark: SparkSession, sf: str) -> DataFrame:
    return extract.greedy_chunks(read(spark, sf, "documents"), "text", ["doc_id"], 400)


def _files(spark: SparkSession, sf: str) -> DataFrame:
    """The chunks of an entity as a file of its own."""
    texts = read(spark, sf, "code_chunk").where("domain = 'code' AND text IS NOT NULL").groupBy("entity_id", "chunk_index").agg(F.max("text").alias("text"))
    one = texts.groupBy("entity_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"]), "\n").alias("source"))
    paths = code_nodes(spark, sf).select(F.col("id").alias("entity_id"), "path")
    return one.join(paths, "entity_id").select(F.concat_ws("/", "entity_id", "path").alias("path"), "source")


@query()
def extracted_entities(spark: SparkSession, sf: str) -> DataFrame:
    return extract.entities(extract.parse_files(_files(spark, sf), parts=("entities",)))


@query()
def extracted_relations(spark: SparkSession, sf: str) -> DataFrame:
    return extract.relations(extract.parse_files(_files(spark, sf), parts=("relations",)))


@query()
def extracted_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return extract.chunks(extract.parse_files(_files(spark, sf), parts=("chunks",)))


_NAME = "[A-Za-z_][A-Za-z0-9_]*"


@query(f"""WITH f AS (SELECT DISTINCT text AS source FROM code_chunk WHERE domain = 'code' AND text IS NOT NULL),
 i AS (SELECT unnest(regexp_extract_all(source, '(?m)^\\s*type\\s+({_NAME})\\s+interface\\s*\\{{([^{{}}]*(?:\\{{[^{{}}]*\\}}[^{{}}]*)*)', 1)) AS o, unnest(regexp_extract_all(source, '(?m)^\\s*type\\s+({_NAME})\\s+interface\\s*\\{{([^{{}}]*(?:\\{{[^{{}}]*\\}}[^{{}}]*)*)', 2)) AS b FROM f),
 l AS (SELECT o, unnest(string_split(b, chr(10))[2:]) AS line FROM i), m AS (SELECT unnest(regexp_extract_all(source, '(?m)^\\s*func\\s*\\(\\s*{_NAME}\\s+\\*?({_NAME})\\s*\\)\\s*({_NAME})\\s*\\(', 1)) AS a, unnest(regexp_extract_all(source, '(?m)^\\s*func\\s*\\(\\s*{_NAME}\\s+\\*?({_NAME})\\s*\\)\\s*({_NAME})\\s*\\(', 2)) AS b FROM f)
 SELECT unnest(regexp_extract_all(source, '(?m)^\\s*type\\s+({_NAME})\\s+(?:struct|interface)\\b', 1)) AS symbol FROM f UNION SELECT unnest(regexp_extract_all(source, '(?m)^\\s*func\\s+({_NAME})\\s*\\(', 1)) FROM f UNION SELECT a || '.' || b FROM m
 UNION SELECT o || '.' || regexp_extract(line, '^\\s*({_NAME})\\s*\\(', 1) FROM l WHERE regexp_matches(line, '^\\s*({_NAME})\\s*\\(')""")
def declared_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """What the code chunks declare, each taken as a Go file of its own."""
    return extract.symbol_table(read(spark, sf, "code_chunk").where("domain = 'code' AND text IS NOT NULL").select(F.col("text").alias("source")))


@query("""WITH o AS (SELECT 'a' || (p_size % 10) AS path, p_partkey AS id, p_type AS h FROM part WHERE p_partkey % 2 = 0), n AS (SELECT 'b' || (p_size % 10) AS path, p_partkey AS id, p_type AS h FROM part WHERE p_partkey % 2 = 1),
 a AS (SELECT *, row_number() OVER (PARTITION BY path, h ORDER BY id) AS r FROM o), b AS (SELECT *, row_number() OVER (PARTITION BY path, h ORDER BY id) AS r FROM n) SELECT a.id AS old_id, b.id AS new_id, a.h AS ast_hash FROM a JOIN b ON substring(a.path, 2) = substring(b.path, 2) AND a.h = b.h AND a.r = b.r""")
def rename_lineage(spark: SparkSession, sf: str) -> DataFrame:
    """Files a0 to a9 renamed to b0 to b9: even parts were in the old ones, odd parts are in the new ones, types stand for hashes."""
    p = read(spark, sf, "part")
    lines = p.select(F.concat(F.lit("R090\ta"), (F.col("p_size") % 10).cast("string"), F.lit("\tb"), (F.col("p_size") % 10).cast("string")).alias("value")).distinct()
    side = lambda x, odd: p.where(F.col("p_partkey") % 2 == odd).select(F.concat(F.lit(x), (F.col("p_size") % 10).cast("string")).alias("path"), F.col("p_partkey").alias("id"), F.col("p_type").alias("ast_hash"))
    return extract.rename_lineage(extract.parse_renames(lines), side("a", 0), side("b", 1))


# --- answers ------------------------------------------------------------------------------------------------------

_HAS = lambda words: f"list_filter([{', '.join(repr(w) for w in words)}], lambda s: contains(lower(text), s))"


@query(f"""WITH d AS (SELECT doc_id, text, {_HAS(answer.STRUCTURAL)} AS s, {_HAS(answer.CONCEPTUAL)} AS c FROM documents WHERE trim(text) <> '')
 SELECT doc_id, CASE WHEN len(s) > 0 AND len(c) = 0 THEN 'structural' WHEN len(c) > 0 AND len(s) = 0 THEN 'conceptual' ELSE 'hybrid' END AS intent, CASE WHEN len(s) > 0 AND len(c) = 0 THEN 0.75::DOUBLE WHEN len(c) > 0 AND len(s) = 0 THEN 0.25::DOUBLE ELSE 0.5::DOUBLE END AS graph_weight,
 array_to_string(list_concat(s, c), ',') AS evidence FROM d""")
def intents(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "documents").select("doc_id", answer.intent(F.col("text")).alias("i")).where("i IS NOT NULL")
    return rows.select("doc_id", "i.intent", "i.graph_weight", F.array_join("i.evidence", ",").alias("evidence"))


@query("SELECT doc_id, coalesce(contains(lower(text), 'chi chiama') OR contains(lower(text), 'who calls') OR contains(lower(text), 'chiamanti di'), FALSE) AS asks FROM documents")
def caller_questions(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", answer.asks_for_callers(F.col("text")).alias("asks"))


def _claims(spark: SparkSession, sf: str) -> tuple:
    """Answers about relations of the code graph; some cite stale places, claim unknown symbols or reversed relations."""
    graph = code_graph(spark, sf)
    r = read(spark, sf, "code_relation").where("from_id IS NOT NULL AND to_id IS NOT NULL").select(F.col("id").alias("answer_id"), "from_id", "to_id", "rel_type").distinct()
    m = F.pmod(F.ascii("answer_id") + F.ascii(F.substring("answer_id", 2, 1)), F.lit(4))
    turn = m == 1
    links = r.select("answer_id", F.when(turn, F.col("to_id")).otherwise(F.col("from_id")).alias("source_id"), F.when(turn, F.col("from_id")).otherwise(F.col("to_id")).alias("target_id"), F.col("rel_type").alias("edge_type"), F.lit(1).alias("depth"))
    symbols = r.select("answer_id", F.when(m == 2, F.concat("from_id", F.lit("x"))).otherwise(F.col("from_id")).alias("node_id"))
    citations = r.select("answer_id", F.col("from_id").alias("node_id"), F.when(m == 3, "old").otherwise(F.lit("provenance non disponibile")).alias("cited"))
    no_place = graph.nodes.withColumn("path", F.lit(""))
    language = F.when(m == 0, "go").when(m == 1, "cobol").when(m == 2, "typescript").otherwise("javascript")
    code = F.when(m == 2, F.concat(F.lit("class A { run() { return '}'; }"), F.when(F.length("rel_type") % 2 == 0, "}").otherwise(""))).otherwise("f(x) { g([1]) } // )")
    snippets = answer.checked_snippets(r.select("answer_id", language.alias("language"), code.alias("code")))
    answers = r.select("answer_id", F.pmod(F.ascii("answer_id"), F.lit(3)).alias("attempt")).distinct()
    return answers, answer.verify_claims(no_place, graph.relations, symbols, links, citations, snippets)


_VERIFY = f"""WITH {CODE}, r AS (SELECT DISTINCT id AS answer_id, from_id, to_id, rel_type, (ascii(id) + ascii(substring(id, 2, 1))) % 4 AS m FROM code_relation WHERE from_id IS NOT NULL AND to_id IS NOT NULL),
 l AS (SELECT answer_id, CASE WHEN m = 1 THEN to_id ELSE from_id END AS a, CASE WHEN m = 1 THEN from_id ELSE to_id END AS b, rel_type, from_id, m FROM r),
 i AS (SELECT answer_id, 'symbol' AS stage, 'symbol-hallucination' AS code, CASE WHEN m = 2 THEN from_id || 'x' ELSE from_id END AS detail FROM r WHERE m = 2 OR from_id NOT IN (SELECT id FROM nodes)
 UNION ALL SELECT answer_id, 'relation', 'relation-nonexistent', a || ' -[' || rel_type || ']-> ' || b FROM l WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.from_id = a AND e.to_id = b AND e.rel_type = l.rel_type)
 UNION ALL SELECT answer_id, 'citation', 'citation-inaccessible', 'citation unavailable' FROM r WHERE from_id NOT IN (SELECT id FROM nodes)
 UNION ALL SELECT answer_id, 'citation', 'stale-citation', from_id FROM r WHERE m = 3 AND from_id IN (SELECT id FROM nodes)
 UNION ALL SELECT answer_id, 'syntax', 'syntax-invalid', CASE WHEN m = 1 THEN 'cobol' ELSE 'typescript' END FROM r WHERE m = 1 OR m = 2 AND length(rel_type) % 2 = 1)"""


@query(f"{_VERIFY} SELECT * FROM i")
def verify_issues(spark: SparkSession, sf: str) -> DataFrame:
    return _claims(spark, sf)[1]


@query(f"""{_VERIFY}, p AS (SELECT answer_id, count(*) AS n, bool_or(code <> 'stale-citation') AS grave FROM i GROUP BY answer_id)
 SELECT answer_id, CAST(ascii(answer_id) % 3 AS INTEGER) AS attempt, coalesce(n, 0) AS n_issues, CASE WHEN grave AND ascii(answer_id) % 3 >= 2 THEN 'degraded' WHEN grave THEN 'regenerated' WHEN n > 0 THEN 'corrected' ELSE 'approved' END AS outcome FROM (SELECT DISTINCT answer_id FROM r) LEFT JOIN p USING (answer_id)""")
def verify_outcome(spark: SparkSession, sf: str) -> DataFrame:
    return answer.answer_outcomes(*_claims(spark, sf))


def _hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    """Region 2 over its nations, their customers and these customers' orders, as REPO, MODULE, CLASS and METHOD."""
    nodes = star_graph(spark, sf).nodes.where("node_type IN ('Package', 'Module', 'Class', 'Method')")
    kids = None
    for table, parent, child in (("nation", ("r", "n_regionkey"), ("n", "n_nationkey")), ("customer", ("n", "c_nationkey"), ("c", "c_custkey")), ("orders", ("c", "o_custkey"), ("o", "o_orderkey"))):
        rows = read(spark, sf, table).select(F.concat(F.lit(parent[0] + ":"), F.col(parent[1]).cast("string")).alias("id"), F.concat(F.lit(child[0] + ":"), F.col(child[1]).cast("string")).alias("child"))
        kids = rows if kids is None else kids.unionByName(rows)
    kids = kids.groupBy("id").agg(F.array_sort(F.collect_list("child")).alias("child_ids"))
    level = F.when(F.col("node_type") == "Package", 3).when(F.col("node_type") == "Module", 2).when(F.col("node_type") == "Class", 1).otherwise(0)
    return nodes.join(kids, "id", "left").select("id", level.alias("level"), "ast_hash", F.col("name").alias("source"), F.coalesce("child_ids", F.array().cast("array<string>")).alias("child_ids"), "tenant_id", "repo", "acl_group")


_P = lambda x: f"lpad(hex(strlen({x})), 8, '0') || hex(({x})::BLOB)"


def _summary_sql() -> str:
    """Down: who is visible. Up: hashes level by level."""
    level = lambda name, kind, below: f"""{name} AS (SELECT v.id, v.ast_hash, v.vis, v.vis AND coalesce(k.ok, TRUE) AS complete, CASE WHEN v.vis AND coalesce(k.ok, TRUE) THEN v.ast_hash WHEN v.vis THEN sha256(unhex(hex('summary-view-v1'::BLOB) || {_P('v.ast_hash')} || coalesce(k.view, ''))) END AS h
 FROM vis v LEFT JOIN (SELECT l.parent, bool_and(c.vis AND c.complete) AS ok, string_agg({_P('c.id')} || CASE WHEN c.vis THEN '01' || {_P('c.h')} ELSE '00' END, '' ORDER BY c.id) AS view FROM link l JOIN {below} c ON c.id = l.child GROUP BY l.parent) k ON k.parent = v.id WHERE v.node_type = '{kind}')"""  # noqa: E731
    return f"""WITH RECURSIVE {STAR}, link AS (SELECT 'r:' || n_regionkey AS parent, 'n:' || n_nationkey AS child FROM nation UNION ALL SELECT 'n:' || c_nationkey, 'c:' || c_custkey FROM customer UNION ALL SELECT 'c:' || o_custkey, 'o:' || o_orderkey FROM orders),
 ns AS (SELECT *, repo IN ('repo0', 'repo1', 'repo2') AND (acl_group IN ('g0', 'g1') OR id = 'r:2') AS own FROM nodes WHERE node_type IN ('Package', 'Module', 'Class', 'Method')), allb(id) AS (SELECT 'r:2' UNION SELECT child FROM allb JOIN link ON parent = allb.id),
 up(id) AS (SELECT id FROM ns WHERE id = 'r:2' AND own UNION SELECT ns.id FROM up JOIN link ON parent = up.id JOIN ns ON ns.id = child AND own),
 vis AS (SELECT ns.id, ns.ast_hash, ns.node_type, up.id IS NOT NULL AS vis FROM allb JOIN ns USING (id) LEFT JOIN up USING (id)),
 l0 AS (SELECT id, ast_hash, vis, vis AS complete, CASE WHEN vis THEN ast_hash END AS h FROM vis WHERE node_type = 'Method'), {level('l1', 'Class', 'l0')}, {level('l2', 'Module', 'l1')}, {level('l3', 'Package', 'l2')}
 SELECT id, vis AS visible, complete, h AS effective_hash FROM (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3)"""


@query(_summary_sql())
def summary_hashes(spark: SparkSession, sf: str) -> DataFrame:
    visible = F.col("repo").isin("repo0", "repo1", "repo2") & (F.col("acl_group").isin("g0", "g1") | (F.col("id") == "r:2"))
    return answer.summary_views(_hierarchy(spark, sf), "r:2", visible).select("id", "visible", "complete", "effective_hash")


@query("""WITH it AS (SELECT 'n:' || n_nationkey AS id, 2 AS level FROM nation WHERE n_nationkey % 7 <> 0 UNION ALL SELECT 'c:' || c_custkey, CASE WHEN c_custkey % 50 = 0 THEN 2 ELSE 1 END FROM customer UNION ALL SELECT 'c:' || c_custkey, 1 FROM customer WHERE c_custkey % 40 = 0 UNION ALL SELECT 'r:' || r_regionkey, 3 FROM region),
 link AS (SELECT 'r:' || n_regionkey AS parent, 'n:' || n_nationkey AS id FROM nation UNION ALL SELECT 'n:' || c_nationkey, 'c:' || c_custkey FROM customer)
 SELECT id, 'duplicate_id' AS violation FROM it GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'none', 'missing_root' UNION ALL SELECT DISTINCT link.id, 'missing_child' FROM link WHERE parent IN (SELECT id FROM it) AND link.id NOT IN (SELECT id FROM it)
 UNION ALL SELECT DISTINCT p.id, 'level_not_below' FROM it p JOIN link ON link.parent = p.id JOIN it c ON c.id = link.id WHERE c.level >= p.level""")
def hierarchy_faults(spark: SparkSession, sf: str) -> DataFrame:
    """Regions over nations over customers, of which some are missing, repeated or at a level too high; the root is none of them."""
    nation, customer, region = (read(spark, sf, t) for t in ("nation", "customer", "region"))
    below = lambda df, p, a, c, b: df.groupBy(key_id(p, a).alias("id")).agg(F.collect_list(key_id(c, b)).alias("child_ids"))
    kids = below(nation, "r", "n_regionkey", "n", "n_nationkey").unionByName(below(customer, "n", "c_nationkey", "c", "c_custkey"))
    level = lambda df, p, k, v: df.select(key_id(p, k).alias("id"), v.alias("level"))
    items = level(nation.where("n_nationkey % 7 <> 0"), "n", "n_nationkey", F.lit(2)).unionByName(level(customer, "c", "c_custkey", F.when(F.col("c_custkey") % 50 == 0, 2).otherwise(1))).unionByName(level(customer.where("c_custkey % 40 = 0"), "c", "c_custkey", F.lit(1))).unionByName(level(region, "r", "r_regionkey", F.lit(3)))
    return hierarchy_violations(items.join(kids, "id", "left").withColumn("child_ids", F.coalesce("child_ids", F.array().cast("array<string>"))), "none")


@query("""WITH x AS (SELECT l_orderkey AS query_id, l_partkey, max((l_linenumber <= 3)::INT) AS want, max((l_linenumber >= 2)::INT) AS got, count(*) FILTER (l_linenumber >= 2) AS n FROM lineitem GROUP BY ALL)
 SELECT query_id, sum(want)::BIGINT AS n_expected, sum(n)::BIGINT AS n_actual, sum(want * got)::BIGINT AS semantic_matched, coalesce(sum(n) FILTER (want = 0), 0)::BIGINT AS unexpected, sum(want * (1 - got))::BIGINT AS missing, CASE WHEN sum(want) > 0 THEN round(sum(want * got) / sum(want)::DOUBLE, 9) ELSE 1 END AS semantic_recall FROM x GROUP BY query_id""")
def fact_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Of each order, the parts of the first three lines were expected and those from the second on were found."""
    li = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.lit("contains").alias("kind"), F.col("l_partkey").cast("string").alias("value"), "l_linenumber")
    found = li.where("l_linenumber >= 2").select("query_id", "kind", F.col("value").alias("canonical"), F.lit(True).alias("is_raw"))
    rows = answer.compare_facts(found, li.where("l_linenumber <= 3").select("query_id", "kind", "value"))
    return rows.select("query_id", "n_expected", "n_actual", "semantic_matched", "unexpected", "missing", F.round("semantic_recall", 9).alias("semantic_recall"))


@query("""WITH r AS (SELECT o_orderkey AS query_id, o_totalprice AS latency_ms FROM orders) SELECT count(*) AS query_count, round(median(latency_ms), 6) AS latency_p50_ms, quantile_disc(latency_ms, 0.95) AS latency_p95_ms FROM r""")
def evaluation_latencies(spark: SparkSession, sf: str) -> DataFrame:
    records = read(spark, sf, "orders").select(F.col("o_orderkey").alias("query_id"), F.lit(True).alias("passed"), F.lit(None).cast("string").alias("error"), F.col("o_totalprice").alias("latency_ms"))
    none = spark.createDataFrame([], "exact_matched bigint, semantic_matched bigint, n_expected bigint, n_resolved bigint, n_actual bigint")
    return answer.evaluation_summary(records, none).select("query_count", F.round("latency_p50_ms", 6).alias("latency_p50_ms"), "latency_p95_ms")


def _names_and_symbols(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    plain = lambda c: F.replace(c, F.lit(" "), F.lit("_"))
    nation, region = read(spark, sf, "nation"), read(spark, sf, "region")
    symbols = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat_ws(".", plain("n_name"), plain("r_name")).alias("symbol")).union(nation.select(plain("n_name")))
    return symbols.select(F.col("symbol").alias("name")).union(region.select(plain("r_name"))).union(read(spark, sf, "part").select("p_brand")), symbols


@query("""WITH s AS (SELECT DISTINCT replace(n_name, ' ', '_') || '.' || replace(r_name, ' ', '_') AS symbol FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT replace(n_name, ' ', '_') FROM nation),
 leaf AS (SELECT split_part(symbol, '.', -1) AS name, count(*) AS n, min(symbol) AS one FROM s GROUP BY ALL), q AS (SELECT symbol AS name FROM s UNION SELECT replace(r_name, ' ', '_') FROM region UNION SELECT p_brand FROM part)
 SELECT q.name, CASE WHEN s.symbol IS NOT NULL THEN 'exact' WHEN n = 1 THEN 'unique' WHEN n > 1 THEN 'ambiguous' ELSE 'not_found' END AS status, CASE WHEN s.symbol IS NOT NULL THEN q.name WHEN n = 1 THEN one END AS canonical FROM q LEFT JOIN s ON s.symbol = q.name LEFT JOIN leaf ON leaf.name = q.name""")
def symbol_resolution(spark: SparkSession, sf: str) -> DataFrame:
    return answer.resolve_symbols(*_names_and_symbols(spark, sf))


_PLAIN_NAME = "regexp_full_match(name, '[A-Za-z_][A-Za-z0-9_]*([.][A-Za-z_][A-Za-z0-9_]*)*')"


@query(f"""WITH r AS ({ORACLES['symbol_resolution']}), q AS (SELECT name, CASE WHEN {_PLAIN_NAME} THEN status ELSE 'not_found' END AS status, CASE WHEN {_PLAIN_NAME} THEN canonical END AS canonical FROM r)
 SELECT name AS value, canonical, status, CASE status WHEN 'ambiguous' THEN 'ambiguous_canonicalization' WHEN 'not_found' THEN 'semantic_error' WHEN 'unique' THEN 'unqualified_symbol' END AS issue, coalesce(canonical = name, FALSE) AS is_raw FROM q""")
def canonical_facts(spark: SparkSession, sf: str) -> DataFrame:
    """The names as facts of one kind; brands of parts are no identifiers."""
    names, symbols = _names_and_symbols(spark, sf)
    facts = names.distinct().select(F.lit("q").alias("query_id"), F.lit("contains").alias("kind"), F.col("name").alias("value"))
    return answer.canonicalise(facts, symbols).drop("query_id", "kind")


@query("""WITH e AS (SELECT c_custkey AS k, c_custkey % 3 AS ttl FROM customer WHERE c_custkey % 2 = 0) SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'denied' WHEN k IS NOT NULL AND ttl <> 1 THEN 'hit' ELSE 'miss' END AS outcome, CASE WHEN c_custkey % 5 <> 0 AND k IS NOT NULL AND ttl <> 1 THEN 'v' || c_custkey END AS value FROM customer LEFT JOIN e ON k = c_custkey""")
def cache_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the customers are cached for ever, one second or an hour; a fifth of the requests come from another scope."""
    c = read(spark, sf, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("entity_id"), F.lit("h").alias("ast_hash"), F.lit("v1").alias("logic"))
    stored, asked = F.lit("2026-01-01 00:00:00").cast("timestamp"), F.lit("2026-01-01 00:30:00").cast("timestamp")
    ttl = F.when(F.col("c_custkey") % 3 == 1, 1).when(F.col("c_custkey") % 3 == 2, 3600).otherwise(0)
    cache = answer.cache_put(c.where("c_custkey % 2 = 0").withColumn("acl_scope", F.lit("s")).withColumn("value", F.concat(F.lit("v"), "entity_id")).withColumn("ttl_s", ttl), stored)
    requests = c.withColumn("acl_scope", F.when(F.col("c_custkey") % 5 == 0, "other").otherwise("s"))
    return answer.cache_get(requests, cache, asked, "s").select("c_custkey", "outcome", "value")


@query("SELECT doc_id, CAST((strlen(text) + 3) // 4 AS INTEGER) AS tokens FROM documents WHERE text IS NOT NULL")
def reply_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", answer.estimated_tokens(F.col("text")).alias("tokens"))
