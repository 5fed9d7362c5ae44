"""Upkeep of views: reconciliation, retention, and rename lineage is in extract."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RETENTION_HOURS = 168  # fixed value: a week


def reconcile(source: DataFrame, view: DataFrame, key: str = "id", fingerprint: str = "fingerprint") -> DataFrame:
    """source rows (all columns) with outcome: match, republish (absent in the view or another fingerprint) or error (no key).

    Null fingerprints match only each other. view has one row per key, or rows that agree.
    """
    theirs = view.groupBy(F.col(key).alias(key)).agg(F.max(F.struct(F.lit(1).alias("there"), F.col(fingerprint).alias("f"))).alias("v"))
    joined = source.join(theirs, key, "left")
    same = F.col("v").isNotNull() & F.col(fingerprint).eqNullSafe(F.col("v.f"))
    return joined.withColumn("outcome", F.when(F.col(key).isNull(), "error").when(same, "match").otherwise("republish")).drop("v")


def reconcile_report(rows: DataFrame, *by: str) -> DataFrame:
    """checked, matched, republished, errored of the groups."""
    n = lambda o: F.count(F.when(F.col("outcome") == o, 1))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("checked"), n("match").alias("matched"), n("republish").alias("republished"), n("error").alias("errored"))


def vector_sources(embeddings: DataFrame, chunks: DataFrame) -> DataFrame:
    """id, fingerprint of the rows of record of the vector view: each embedding with the entity of its chunk.

    embeddings: id, chunk_id. chunks: id, entity_id. Repeated rows agree and count once; an embedding whose chunk is not
    there is no row of record.
    """
    own = chunks.groupBy(F.col("id").alias("chunk_id")).agg(F.max("entity_id").alias("fingerprint"))
    return embeddings.select("id", "chunk_id").distinct().join(own, "chunk_id").select("id", "fingerprint")


def republished_nodes(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, payload of the rows to publish again: the node with its whole provenance, which sinks need to accept it."""
    want = rows.where("outcome = 'republish'").select("id").distinct()
    body = F.to_json(F.struct("id", "domain", "node_type", "name", "ast_hash", F.struct("repo", "tenant_id", "acl_group", "commit_sha", "path", "start_line", "end_line").alias("provenance")))
    return nodes.join(want, "id", "left_semi").select("id", body.alias("payload"))


def purge(df: DataFrame, column: str, now: dt.datetime, hours: int = RETENTION_HOURS) -> tuple[DataFrame, DataFrame]:
    """(kept, purged): rows strictly older than now less the retention are purged; without time they stay. Count purged for a dry run."""
    if hours < 0:
        raise ValueError("hours must not be negative")
    old = F.coalesce(F.col(column) < F.lit(now - dt.timedelta(hours=hours)), F.lit(False))
    return df.where(~old), df.where(old)


def split_statements(script: str) -> list[str]:
    """The statements of a DDL script: cut at semicolons outside quotes, // comments and blank ones removed."""
    out, now, quote, i = [], [], "", 0
    while i < len(script):
        c = script[i]
        if quote:
            quote = "" if c == quote else quote
            now.append(c)
        elif c in "'\"`":
            quote = c
            now.append(c)
        elif script.startswith("//", i):
            i = script.find("\n", i)
            if i < 0:
                break
            now.append("\n")
        elif c == ";":
            out.append("".join(now).strip())
            now = []
        else:
            now.append(c)
        i += 1
    out.append("".join(now).strip())
    return [s for s in out if s]


def migrate(statements: list[str], run) -> dict:
    """Statements one by one through run(statement) -> created or exists; stops at the first failure, which is reported."""
    done = {"created": 0, "exists": 0, "failed": None}
    for s in statements:
        try:
            done[run(s)] += 1
        except Exception as e:  # the report names what stopped it
            done["failed"] = (s, str(e))
            break
    return done
