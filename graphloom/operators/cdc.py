"""The outbox change log: envelopes, dedup ledger, idempotent merges with partition generations, retry routing, receipts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.text import clean_label
from graphloom.schema import AGGREGATE_TYPES, EVENT_TYPES, PAYLOADS, REL_TYPES, SINK_NODE_TYPES

SCOPE = ["tenant_id", "repo", "acl_group"]
NODE_VALUES = ["node_type", "domain", "name", "ast_hash", *SCOPE, "path"]
# Attempts, base delay in seconds, topic endings and size limits of the pipeline.
MAX_RETRIES, BACKOFF, DLQ_SUFFIX = 5, 1, ".DLQ"
MAX_PAYLOAD_BYTES, MAX_SOURCE_BYTES, MAX_PATH = 64 << 10, 16 << 20, 1024
SOURCE_ENDINGS = ["go", "js", "ts"]


def envelope_outcome() -> Column:
    """Of an outbox row: accepted, heartbeat (no aggregate_id), missing_key, unknown_aggregate_type, unknown_event_type or bad_payload."""
    missing = F.col("id").isNull() | F.col("created_at").isNull() | F.col("aggregate_type").isNull() | F.col("event_type").isNull()
    is_object = F.coalesce(F.trim("payload").startswith("{") & F.get_json_object("payload", "$").isNotNull(), F.lit(False))
    return (
        F.when(F.col("aggregate_id").isNull(), "heartbeat")
        .when(missing, "missing_key")
        .when(~F.col("aggregate_type").isin(AGGREGATE_TYPES), "unknown_aggregate_type")
        .when(~clean_label(F.col("event_type")).isin(EVENT_TYPES), "unknown_event_type")
        .when(~is_object, "bad_payload")
        .otherwise("accepted")
    )


def routed(outbox: DataFrame, prefix: str = "outbox.event.") -> DataFrame:
    """outbox with outcome, and topic and message_key for accepted rows."""
    ok = F.col("outcome") == "accepted"
    return outbox.withColumn("outcome", envelope_outcome()).withColumn("topic", F.when(ok, F.concat(F.lit(prefix), "aggregate_type"))).withColumn("message_key", F.when(ok, F.col("aggregate_id")))


def payloads(outbox: DataFrame, aggregate_type: str) -> DataFrame:
    """Accepted rows of one aggregate type with the payload expanded to columns p.*; unreadable fields are null."""
    rows = routed(outbox).where((F.col("outcome") == "accepted") & (F.col("aggregate_type") == aggregate_type))
    return rows.withColumn("p", F.from_json("payload", PAYLOADS[aggregate_type]))


def unseen(events: DataFrame, ledger: DataFrame, consumer: str, event_id: str = "event_id") -> DataFrame:
    """Events the consumer hasn't marked in the ledger (event_id, consumer); repeats within events fall away too.

    A sink writes its effect first and then appends ledger_rows, so a crash between the two repeats an idempotent write.
    """
    mine = ledger.where(F.col("consumer") == consumer).select(F.col("event_id").alias(event_id))
    return events.where(F.col(event_id).isNotNull()).dropDuplicates([event_id]).join(mine, event_id, "left_anti")


def ledger_rows(events: DataFrame, consumer: str, event_id: str = "event_id") -> DataFrame:
    return events.select(F.col(event_id).alias("event_id"), F.lit(consumer).alias("consumer")).distinct()


def replace_by_parent(current: DataFrame, fresh: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """current without the children of parents (column key), and fresh."""
    return current.join(parents.select(key).distinct(), key, "left_anti").select(*current.columns).unionByName(fresh.select(*current.columns))


def upsert(current: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """current with the rows of fresh added or put in place of those of equal keys; fresh has one row per key."""
    return current.join(fresh.select(*keys), keys, "left_anti").select(*current.columns).unionByName(fresh.select(*current.columns))


def node_changes(current: DataFrame, updates: DataFrame) -> DataFrame:
    """updates (one per id) with changed and the old scope: changed unless every value is there and equal.

    An update whose node_type is none of the sink's types has no place in the graph view and must be rejected before.
    """
    old = current.select("id", *(F.col(c).alias(f"old_{c}") for c in NODE_VALUES))
    same = F.lit(True)
    for c in NODE_VALUES:
        same = same & F.coalesce(F.col(c) == F.col(f"old_{c}"), F.lit(False))
    return updates.join(old, "id", "left").withColumn("changed", ~same)


def acceptable_nodes(updates: DataFrame) -> DataFrame:
    return updates.where(F.col("node_type").isin(SINK_NODE_TYPES))


def _bumped(touches: DataFrame, partitions: DataFrame) -> DataFrame:
    """New generations from touches (event, changed, scope): the event of the lowest id makes a missing partition with 1, every other changed one adds 1."""
    whole = F.lit(True)
    for c in SCOPE:
        whole = whole & F.col(c).isNotNull()
    per = touches.where(whole).groupBy(*SCOPE).agg(F.sum(F.col("changed").cast("bigint")).alias("n"), F.min_by(F.col("changed").cast("bigint"), F.col("event")).alias("first"))
    both = partitions.select(*SCOPE, "generation").join(per, SCOPE, "full")
    grown = F.col("generation") + F.coalesce("n", F.lit(0))
    return both.select(*SCOPE, F.coalesce(grown, 1 + F.col("n") - F.col("first")).alias("generation"))


def merge_nodes(current: DataFrame, updates: DataFrame, partitions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, partitions) after node updates: values are set, and the old and new partitions of changed nodes move on."""
    changes = node_changes(current, updates)
    scopes = F.array_distinct(F.array(*(F.struct(*(F.col(f"{p}{c}").alias(c) for c in SCOPE)) for p in ("old_", ""))))
    touches = changes.select(F.col("id").alias("event"), "changed", F.explode(scopes).alias("s")).select("event", "changed", "s.*")
    return upsert(current, updates, ["id"]), _bumped(touches, partitions)


def merge_relations(nodes: DataFrame, current: DataFrame, updates: DataFrame, partitions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, relations, partitions) after relation updates (from_id, rel_type, to_id, weight; one per key).

    Ends that don't exist become placeholder nodes, to be filled by later node updates. A null weight is 1, weights
    are set, not added. New relations and new weights move the partitions of both ends on.
    """
    key = ["from_id", "rel_type", "to_id"]
    updates = updates.where(F.col("rel_type").isin(REL_TYPES) & F.col("from_id").isNotNull() & F.col("to_id").isNotNull()).withColumn("weight", F.coalesce("weight", F.lit(1)))
    ends = updates.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct().join(nodes.select("id"), "id", "left_anti")
    placed = nodes.unionByName(ends, allowMissingColumns=True)
    old = current.select(*key, F.col("weight").alias("old_weight"))
    changed = updates.join(old, key, "left").withColumn("changed", ~F.coalesce(F.col("weight") == F.col("old_weight"), F.lit(False)))
    where = nodes.select("id", *SCOPE)
    sides = [changed.select(F.concat_ws("|", *key).alias("event"), "changed", F.col(end).alias("id")).join(where, "id").drop("id") for end in ("from_id", "to_id")]
    touches = sides[0].unionByName(sides[1]).distinct()
    return placed, upsert(current.select(*key, "weight"), updates.select(*key, "weight"), key), _bumped(touches, partitions)


def retry_route(failed: Column, retryable: Column, header: Column, topic: Column, max_retries: int = MAX_RETRIES, backoff: int = BACKOFF, retry_suffix: str = "") -> Column:
    """struct(outcome, topic, attempt, delay_s) of a processed message.

    outcome: processed, retried (to the topic with retry_suffix, attempt and delay doubled each time), dead_lettered
    (to the topic with .DLQ) or failed (not retryable: nothing is committed). A missing or unreadable attempt header
    counts as 0.
    """
    plain = F.when(F.lit(bool(retry_suffix)) & topic.endswith(retry_suffix or "\0"), topic.substr(F.lit(1), F.length(topic) - len(retry_suffix))).otherwise(topic)
    attempt = F.greatest(F.coalesce(F.when(header.rlike(r"^[0-9]{1,9}$"), header.cast("int")), F.lit(0)), F.lit(0))
    make = lambda outcome, to, n, delay: F.struct(F.lit(outcome).alias("outcome"), to.alias("topic"), n.cast("int").alias("attempt"), delay.cast("bigint").alias("delay_s"))
    none = F.lit(None).cast("string")
    return (
        F.when(~F.coalesce(failed, F.lit(False)), make("processed", none, attempt, F.lit(0)))
        .when(~F.coalesce(retryable, F.lit(True)), make("failed", none, attempt, F.lit(0)))
        .when(attempt < max_retries, make("retried", F.concat(plain, F.lit(retry_suffix)), attempt + 1, F.lit(backoff) * F.pow(F.lit(2.0), attempt)))
        .otherwise(make("dead_lettered", F.concat(plain, F.lit(DLQ_SUFFIX)), attempt, F.lit(0)))
    )


def valid_path(path: Column) -> Column:
    """A relative source path: 1 to 1024 code points, no backslash, control character, empty or dotted segment, known ending."""
    return F.coalesce(
        (F.char_length(path) >= 1)
        & (F.char_length(path) <= MAX_PATH)
        & ~path.contains("\\")
        & ~path.rlike(r"\p{Cc}")
        & ~F.exists(F.split(path, "/"), lambda s: s.isin("", ".", ".."))
        & path.rlike(rf"[^/]\.({'|'.join(SOURCE_ENDINGS)})$"),
        F.lit(False),
    )


COMMAND = T.StructType([T.StructField(n, T.StringType()) for n in ("schema_version", "command_id", "commit_sha", "path", "source_sha256")] + [T.StructField("source_size_bytes", T.LongType())])


#: The headers that carry a command's scope; systems with other names hand in theirs.
SCOPE_HEADERS = ["tenant-id", "repository", "acl-group"]


def scope_of_headers(headers: Column, names: list[str] = SCOPE_HEADERS) -> list[Column]:
    """Each scope value of headers, an array of struct(key, value); null for one that is missing, given twice or no UTF-8.

    value is binary or text. Names compare exactly; other headers are ignored. A null value makes a command's scope
    invalid (see command_outcome).
    """
    def one(name: str) -> Column:
        own = F.filter(headers, lambda h: h["key"] == name)
        value = F.get(own, 0)["value"].cast("binary")
        return F.when((F.size(own) == 1) & F.is_valid_utf8(value), value.cast("string"))

    return [one(n) for n in names]


def command_outcome(payload: Column, scope_values: list[Column], max_bytes: int = MAX_SOURCE_BYTES) -> Column:
    """accepted, invalid_payload, invalid_scope, invalid_path or source_too_large of an ingestion command in JSON."""
    c = F.from_json(payload, COMMAND)
    scope = F.lit(True)
    for v in scope_values:
        scope = scope & F.coalesce((v != "") & (F.octet_length(v) <= 256) & ~v.rlike(r"^\p{IsWhite_Space}|\p{IsWhite_Space}$|\p{Cc}"), F.lit(False))
    good = (c["schema_version"] == "1") & c["commit_sha"].rlike("^[0-9a-f]{40}$") & c["source_sha256"].rlike("^[0-9a-f]{64}$") & c["path"].isNotNull() & (c["source_size_bytes"] >= 0)
    return (
        F.when(F.coalesce(F.octet_length(payload) > MAX_PAYLOAD_BYTES, F.lit(True)), "invalid_payload")
        .when(~scope, "invalid_scope")
        .when(~F.coalesce(good, F.lit(False)), "invalid_payload")
        .when(~valid_path(c["path"]), "invalid_path")
        .when(c["source_size_bytes"] > min(max_bytes, MAX_SOURCE_BYTES), "source_too_large")
        .otherwise("accepted")
    )


def receipt_outcomes(commands: DataFrame, receipts: DataFrame) -> DataFrame:
    """commands (command_id, fingerprint) with outcome: applied (no receipt yet), duplicate (same fingerprint) or conflict."""
    known = receipts.select("command_id", F.col("fingerprint").alias("known"))
    return commands.join(known, "command_id", "left").withColumn("outcome", F.when(F.col("known").isNull(), "applied").when(F.col("known") == F.col("fingerprint"), "duplicate").otherwise("conflict")).drop("known")


def verify_source(content: Column, expected_sha256: Column, expected_size: Column) -> Column:
    """verified, source_not_found (null), source_size_mismatch, source_digest_mismatch, source_not_utf8 or source_contains_nul of a binary column."""
    return (
        F.when(content.isNull(), "source_not_found")
        .when(F.octet_length(content) != expected_size, "source_size_mismatch")
        .when(F.sha2(content, 256) != expected_sha256, "source_digest_mismatch")
        .when(~F.is_valid_utf8(content.cast("string")), "source_not_utf8")
        .when(F.hex(content).rlike("^(?:..)*00"), "source_contains_nul")
        .otherwise("verified")
    )


def invalid_batches(nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """command_id, reason of parsed batches that can't be written: foreign_path, repeated_node, repeated_chunk, chunk_without_node, or no row.

    nodes: command_id, command_path, id, path. chunks: command_id, entity_id, chunk_index. Commands without nodes can't
    be seen here; look for them by an anti-join on the commands.
    """
    foreign = nodes.where(~F.coalesce(F.col("path") == F.col("command_path"), F.lit(False))).select("command_id", F.lit("foreign_path").alias("reason"))
    repeated = nodes.groupBy("command_id", "id").count().where("count > 1").select("command_id", F.lit("repeated_node").alias("reason"))
    twice = chunks.groupBy("command_id", "entity_id", "chunk_index").count().where("count > 1").select("command_id", F.lit("repeated_chunk").alias("reason"))
    loose = chunks.join(nodes.select("command_id", F.col("id").alias("entity_id")), ["command_id", "entity_id"], "left_anti").select("command_id", F.lit("chunk_without_node").alias("reason"))
    return foreign.unionByName(repeated).unionByName(twice).unionByName(loose).distinct()
