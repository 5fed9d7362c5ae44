"""From ingestion commands to graph rows, their change events, and the three views that follow the events."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.ids import command_fingerprint, point_id, scoped_node_id
from graphloom.functions.models import embed
from graphloom.operators import cdc, extract

SCOPE = ["tenant_id", "repo", "acl_group"]


@dataclass(frozen=True)
class Store:
    """The tables of record: nodes, relations (from_id, rel_type, to_id, weight), chunks, receipts (command_id, fingerprint)."""

    nodes: DataFrame
    relations: DataFrame
    chunks: DataFrame
    receipts: DataFrame


def judged_commands(commands: DataFrame, receipts: DataFrame, sources: DataFrame) -> DataFrame:
    """commands (payload and the scope columns) with their fields, fingerprint, outcome and the verified source.

    sources: source_sha256, content. outcome: a rejection of the command, duplicate or conflict by its receipt, a
    rejection of its source, or apply. Of commands with one id, those of the lowest fingerprint are looked at first; the
    others conflict with them.
    """
    rows = commands.withColumn("c", F.from_json("payload", cdc.COMMAND)).withColumn("judged", cdc.command_outcome(F.col("payload"), [F.col(s) for s in SCOPE]))
    rows = rows.select("payload", *SCOPE, "c.*", "judged")
    rows = rows.withColumn("fingerprint", command_fingerprint([*(F.col(s) for s in SCOPE), F.col("commit_sha"), F.col("path"), F.col("source_sha256"), F.col("source_size_bytes").cast("string")]))
    firsts = rows.where("judged = 'accepted'").groupBy("command_id").agg(F.min("fingerprint").alias("first"))
    known = receipts.select("command_id", F.col("fingerprint").alias("known"))
    found = sources.groupBy("source_sha256").agg(F.max("content").alias("content"))
    rows = rows.join(firsts, "command_id", "left").join(known, "command_id", "left").join(found, "source_sha256", "left")
    status = cdc.verify_source(F.col("content"), F.col("source_sha256"), F.col("source_size_bytes"))
    outcome = (
        F.when(F.col("judged") != "accepted", F.col("judged"))
        .when(F.coalesce("known", "first") != F.col("fingerprint"), "conflict")
        .when(F.col("known").isNotNull(), "duplicate")
        .when(status != "verified", status)
        .otherwise("apply")
    )
    rows = rows.withColumn("outcome", outcome).withColumn("source", F.when(F.col("outcome") == "apply", F.col("content").cast("string")))
    return rows.drop("judged", "first", "known", "content")


def ingest(commands: DataFrame, sources: DataFrame, store: Store, budget: int = 1500) -> tuple[Store, DataFrame, DataFrame]:
    """(store, events, outcomes) after applying commands.

    Nodes are put in place by id; relations and chunks of a file's nodes are replaced, so files parsed again leave
    nothing behind. events: an UPSERT for each node, relation and chunk written, with JSON payload. One command per file
    and batch; commands repeated with one fingerprint count once.
    """
    judged = judged_commands(commands, store.receipts, sources)
    todo = judged.where("outcome = 'apply'").dropDuplicates(["command_id"])
    parsed = extract.parse_files(todo.select("path", "source"), budget)
    where = todo.select("path", *SCOPE, "commit_sha").dropDuplicates(["path"])
    own = lambda col: scoped_node_id(F.col("tenant_id"), F.col("repo"), F.col(col))

    def scoped(df: DataFrame, *ids: str) -> DataFrame:
        df = df.join(where, "path")
        return df.withColumns({i: own(i) for i in ids})

    nodes = scoped(extract.entities(parsed), "id").select("id", F.lit("code").alias("domain"), F.col("kind").alias("node_type"), "name", "ast_hash", *SCOPE, "path", "commit_sha", "start_line", "end_line")
    nodes = nodes.dropDuplicates(["id"])
    by_path = lambda part: parsed.select("path", F.explode(part).alias("x")).select("path", "x.*")
    full = lambda name: extract.parser_id(F.col("path"), F.col(name))
    relations = scoped(by_path("relations").withColumns({"from_id": full("from_name"), "to_id": full("to_name")}), "from_id", "to_id")
    relations = relations.groupBy("from_id", "rel_type", "to_id").agg(F.max("weight").alias("weight"))
    chunks = scoped(by_path("chunks").withColumn("entity_id", full("qualified")), "entity_id").select("entity_id", "chunk_index", "text", "char_count").dropDuplicates(["entity_id", "chunk_index"])
    chunks = chunks.withColumn("id", F.sha2(F.concat_ws(":", "entity_id", "chunk_index"), 256)).select("id", "entity_id", "chunk_index", "text", "char_count")

    files = where.join(store.nodes.select("id", "path", "tenant_id", "repo"), ["path", "tenant_id", "repo"]).select("id")
    touched = files.unionByName(nodes.select("id")).distinct()
    after = Store(
        cdc.upsert(store.nodes, nodes, ["id"]),
        cdc.replace_by_parent(store.relations, relations, touched.withColumnRenamed("id", "from_id"), "from_id"),
        cdc.replace_by_parent(store.chunks, chunks, touched.withColumnRenamed("id", "entity_id"), "entity_id"),
        store.receipts.unionByName(todo.select("command_id", "fingerprint")),
    )
    provenance = F.struct("repo", "tenant_id", "acl_group", "commit_sha", "path", "start_line", "end_line")
    events = (
        _events(nodes.withColumn("provenance", provenance), "CodeNode", F.col("id"), ["id", "domain", "node_type", "name", "ast_hash", "provenance"])
        .unionByName(_events(relations, "CodeRelation", F.concat_ws("|", "from_id", "rel_type", "to_id"), ["from_id", "rel_type", "to_id", "weight"]))
        .unionByName(_events(chunks, "CodeChunk", F.col("id"), ["id", "entity_id", "chunk_index", "text", "char_count"]))
    )
    return after, events, judged.drop("source")


def _events(rows: DataFrame, kind: str, key: Column, fields: list[str]) -> DataFrame:
    body = F.to_json(F.struct(*fields))
    return rows.select(F.sha2(F.concat_ws("\0", F.lit(kind), key, body), 256).alias("id"), F.lit(kind).alias("aggregate_type"), key.alias("aggregate_id"), F.lit("UPSERT").alias("event_type"), body.alias("payload"))


def embed_chunks(events: DataFrame, ledger: DataFrame, model_id: str, dim: int, model: Callable[[Column, int], Column] = embed) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(embeddings, events, ledger rows) of the chunk events that the embedding worker hasn't seen.

    Chunks without text are marked as seen and give no embedding.
    """
    fresh = cdc.unseen(events.where("aggregate_type = 'CodeChunk'"), ledger, "embedding-worker", "id")
    p = F.from_json("payload", cdc.PAYLOADS["CodeChunk"])
    rows = fresh.select(p.alias("p")).select("p.*").where("text IS NOT NULL").dropDuplicates(["id"])
    made = rows.select(F.sha2(F.concat_ws(":", F.col("id"), F.lit(model_id)), 256).alias("id"), F.col("id").alias("chunk_id"), "entity_id", model(F.col("text"), dim).alias("vector"), F.lit(model_id).alias("model_id"), F.lit(dim).alias("embedding_dim"))
    return made, _events(made, "CodeEmbedding", F.col("id"), ["id", "chunk_id", "entity_id", "model_id", "vector"]), cdc.ledger_rows(fresh, "embedding-worker", "id")


def vector_view(points: DataFrame, embeddings: DataFrame, nodes: DataFrame) -> DataFrame:
    """points (point_id, node_id, vector, scope columns) with those of embeddings put in place, keyed by UUID of the embedding id."""
    fresh = embeddings.select(point_id(F.col("id")).alias("point_id"), F.col("entity_id").alias("node_id"), "vector").dropDuplicates(["point_id"]).join(nodes.select(F.col("id").alias("node_id"), "domain", *SCOPE), "node_id")
    return cdc.upsert(points, fresh, ["point_id"])


def text_view(index: DataFrame, chunks: DataFrame) -> DataFrame:
    """The text index with chunks put in place by id."""
    return cdc.upsert(index, chunks.dropDuplicates(["id"]), ["id"])
