"""Queries on delivery, change feeds, references and copies, over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import canonical_uuid
from graphloom.operators.changes import current_state, fold_changes
from graphloom.operators.compare import differences
from graphloom.operators.delivery import deduplicate, surplus_deliveries
from graphloom.operators.references import orphan_references, orphans_by_period
from graphloom.sources import read

COPY_KEYS, COPY_FIELDS = ["target", "id"], ["fingerprint", "name", "node_type", "repo"]


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    """Deliveries of messages; rows without aggregate_id are heartbeats."""
    return read(spark, sf, "outbox").where(F.col("aggregate_id").isNotNull())


#: What decides between deliveries of one position: the time of delivery, then the batch.
DELIVERY_TIES = ("received_at", "batch_id")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    deliveries = _messages(spark, sf).select("id", "delivery_seq", *DELIVERY_TIES)
    return surplus_deliveries(deliveries, "id", "delivery_seq", DELIVERY_TIES)


def p2_messages(spark: SparkSession, sf: str) -> DataFrame:
    rows = _messages(spark, sf).select("id", "delivery_seq", *DELIVERY_TIES, "aggregate_type", "aggregate_id", "payload")
    kept = deduplicate(rows, "id", "delivery_seq", DELIVERY_TIES)
    return kept.select("delivery_seq", "batch_id", canonical_uuid(F.col("id")).alias("message_id"), "aggregate_type", "aggregate_id", "payload")


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    payload = ["event_id", "aggregate_type", "payload"]
    changes = read(spark, sf, "outbox").withColumn("event_id", canonical_uuid(F.col("id")))
    return fold_changes(changes, "aggregate_id", ["created_at", "tx_order"], "event_type", payload)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    changes = read(spark, sf, "outbox").select("aggregate_id", "created_at", "tx_order", "event_type", canonical_uuid(F.col("id")).alias("event_id"))
    folded = fold_changes(changes, "aggregate_id", ["created_at", "tx_order"], "event_type", ["event_id"])
    return current_state(folded).select("aggregate_id", "event_id")


def p3_state(spark: SparkSession, sf: str) -> DataFrame:
    return current_state(_changes(spark, sf)).select("aggregate_id", "aggregate_type", "event_id", "tx_order", "payload")


def p3_tombstones(spark: SparkSession, sf: str) -> DataFrame:
    return _changes(spark, sf).where("is_deleted").select("aggregate_id", "event_id", "tx_order")


def _relation_orphans(spark: SparkSession, sf: str) -> DataFrame:
    ends = F.array(*(F.struct(F.lit(c).alias("ref_field"), F.col(c).alias("ref_key")) for c in ("from_id", "to_id")))
    refs = read(spark, sf, "code_relation").select(F.col("id").alias("ref_id"), F.col("created_at").alias("ref_time"), F.explode(ends).alias("e")).select("ref_id", "ref_time", "e.*")
    nodes = read(spark, sf, "code_node").select(F.col("id").alias("key"), F.col("versioning.valid_to").isNotNull().alias("deleted"), F.col("versioning.valid_from").alias("valid_from"))
    return orphan_references(refs, nodes)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _relation_orphans(spark, sf).select(F.col("ref_id").alias("relation_id"), F.col("ref_field").alias("endpoint")).distinct()


def p5_by_month(spark: SparkSession, sf: str) -> DataFrame:
    return orphans_by_period(_relation_orphans(spark, sf).distinct(), "code_relation")


def _copies(spark: SparkSession, sf: str) -> DataFrame:
    return differences(read(spark, sf, "source_row"), read(spark, sf, "view_row"), COPY_KEYS, COPY_FIELDS)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return _copies(spark, sf).where(~F.col("diff_field").isin("extra_in_source", "extra_in_view")).select("target", "id", "diff_field").distinct()


def p6_differences(spark: SparkSession, sf: str) -> DataFrame:
    return _copies(spark, sf)


def p6_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _copies(spark, sf).groupBy("target", "diff_field").agg(F.count(F.lit(1)).alias("n_entries"), F.sum("n_rows").alias("n_rows"))


QUERIES = {f.__name__: f for f in (p2_found, p2_messages, p3_found, p3_state, p3_tombstones, p5_found, p5_by_month, p6_found, p6_differences, p6_summary)}

_UUID = """CASE WHEN regexp_full_match(regexp_replace(regexp_replace(lower(id), '[\\s{}()]', '', 'g'), '^urn:uuid:|-', '', 'g'), '[0-9a-f]{32}')
  THEN regexp_replace(regexp_replace(regexp_replace(lower(id), '[\\s{}()]', '', 'g'), '^urn:uuid:|-', '', 'g'), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5')
  ELSE id END"""
_LAST = f"""WITH c AS (SELECT *, {_UUID} AS event_id, upper(trim(event_type)) AS op FROM outbox WHERE aggregate_id IS NOT NULL),
 r AS (SELECT *, row_number() OVER (PARTITION BY aggregate_id ORDER BY created_at DESC NULLS LAST, tx_order DESC NULLS LAST, op, event_id DESC NULLS LAST, payload DESC NULLS LAST) AS rn FROM c WHERE op IN ('UPSERT', 'DELETE'))"""
_ORPHANS = """WITH n AS (SELECT id, bool_or(versioning.valid_to IS NOT NULL) AS gone, CASE WHEN bool_or(versioning.valid_from IS NULL) THEN NULL ELSE min(versioning.valid_from) END AS since FROM code_node GROUP BY id),
 e AS (SELECT id AS relation_id, 'from_id' AS endpoint, from_id AS k, created_at FROM code_relation UNION ALL SELECT id, 'to_id', to_id, created_at FROM code_relation),
 o AS (SELECT DISTINCT relation_id, endpoint, k, e.created_at, CASE WHEN n.id IS NULL THEN 'missing' WHEN n.gone THEN 'deleted' ELSE 'late' END AS reason
  FROM e LEFT JOIN n ON n.id = e.k WHERE k IS NOT NULL AND (n.id IS NULL OR n.gone OR n.since > e.created_at))"""
_FIELDS = "fingerprint, name, node_type, repo"
_DIFFS = f"""WITH sx AS (SELECT target, id, {_FIELDS}, count(*) AS n FROM source_row GROUP BY ALL),
 vx AS (SELECT target, id, {_FIELDS}, count(*) AS n FROM view_row GROUP BY ALL),
 j AS (SELECT coalesce(s.target, v.target) AS target, coalesce(s.id, v.id) AS id, s.id IS NULL AS no_s, v.id IS NULL AS no_v, coalesce(s.n, 0) AS ns, coalesce(v.n, 0) AS nv,
  {', '.join(f's.{f} AS s_{f}, v.{f} AS v_{f}' for f in ('fingerprint', 'name', 'node_type', 'repo'))}
  FROM sx s FULL JOIN vx v ON s.target = v.target AND s.id = v.id),
 d AS (SELECT target, id, 'missing_in_view' AS diff_field, NULL AS source_value, NULL AS view_value, ns AS n_rows FROM j WHERE no_v
  UNION ALL SELECT target, id, 'missing_in_source', NULL, NULL, nv FROM j WHERE no_s
  {' '.join(f"UNION ALL SELECT target, id, '{f}', s_{f}, v_{f}, least(ns, nv) FROM j WHERE NOT no_s AND NOT no_v AND s_{f} IS DISTINCT FROM v_{f}" for f in ('fingerprint', 'name', 'node_type', 'repo'))}
  UNION ALL SELECT target, id, 'extra_in_source', NULL, NULL, ns - nv FROM j WHERE NOT no_s AND NOT no_v AND ns > nv
  UNION ALL SELECT target, id, 'extra_in_view', NULL, NULL, nv - ns FROM j WHERE NOT no_s AND NOT no_v AND nv > ns)"""

ORACLES = {
    "p2_found": f"WITH m AS (SELECT delivery_seq, row_number() OVER (PARTITION BY {_UUID} ORDER BY delivery_seq) AS rn FROM outbox WHERE aggregate_id IS NOT NULL AND id IS NOT NULL) SELECT delivery_seq FROM m WHERE rn > 1",
    "p2_messages": f"WITH m AS (SELECT delivery_seq, batch_id, {_UUID} AS message_id, aggregate_type, aggregate_id, payload, row_number() OVER (PARTITION BY {_UUID} ORDER BY delivery_seq) AS rn FROM outbox WHERE aggregate_id IS NOT NULL AND id IS NOT NULL) SELECT * EXCLUDE (rn) FROM m WHERE rn = 1",
    "p3_found": f"{_LAST} SELECT aggregate_id, event_id FROM r WHERE rn = 1 AND op = 'UPSERT'",
    "p3_state": f"{_LAST} SELECT aggregate_id, aggregate_type, event_id, tx_order, payload FROM r WHERE rn = 1 AND op = 'UPSERT'",
    "p3_tombstones": f"{_LAST} SELECT aggregate_id, event_id, tx_order FROM r WHERE rn = 1 AND op = 'DELETE'",
    "p5_found": f"{_ORPHANS} SELECT DISTINCT relation_id, endpoint FROM o",
    "p5_by_month": f"{_ORPHANS} SELECT 'code_relation' AS ref_table, endpoint AS ref_field, strftime(created_at AT TIME ZONE 'UTC', '%Y-%m') AS month, reason, count(*) AS n_refs, count(DISTINCT k) AS n_keys FROM o GROUP BY ALL",
    "p6_found": f"{_DIFFS} SELECT DISTINCT target, id, diff_field FROM d WHERE diff_field NOT LIKE 'extra%'",
    "p6_differences": f"{_DIFFS} SELECT target, id, diff_field, source_value, view_value, CAST(n_rows AS BIGINT) AS n_rows FROM d",
    "p6_summary": f"{_DIFFS} SELECT target, diff_field, count(*) AS n_entries, CAST(sum(n_rows) AS BIGINT) AS n_rows FROM d GROUP BY ALL",
}
