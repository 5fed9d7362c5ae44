"""Property graphs from the given tables.

star_graph turns the star schema into a graph: region (Package), nation (Module), supplier (Interface), part (Function),
orders (Method), customer (Class), with the foreign keys as typed relations. code_graph takes the code tables.
Nodes have id, domain, node_type, name, ast_hash, tenant_id, repo, acl_group, path, commit_sha, start_line, end_line;
relations id, from_id, to_id, rel_type, weight.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.tables import read


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    relations: DataFrame


def key_id(prefix: str, col: str | Column) -> Column:
    return F.concat(F.lit(f"{prefix}:"), (F.col(col) if isinstance(col, str) else col).cast("string"))


def star_nodes(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for table, prefix, key, name, kind in (
        ("region", "r", "r_regionkey", "r_name", "Package"),
        ("nation", "n", "n_nationkey", "n_name", "Module"),
        ("supplier", "s", "s_suppkey", "s_name", "Interface"),
        ("part", "p", "p_partkey", "p_name", "Function"),
        ("orders", "o", "o_orderkey", "o_orderpriority", "Method"),
        ("customer", "c", "c_custkey", "c_name", "Class"),
    ):
        k = F.col(key).cast("bigint")
        rows = read(spark, sf, table).select(
            key_id(prefix, key).alias("id"),
            F.when(k % 7 == 0, "doc").otherwise("code").alias("domain"),
            F.lit(kind).alias("node_type"),
            F.col(name).alias("name"),
            F.sha2(F.concat(F.lit(kind), F.col(name)), 256).alias("ast_hash"),
            F.when(k % 10 == 9, "t1").otherwise("t0").alias("tenant_id"),
            F.concat(F.lit("repo"), (k % 4).cast("string")).alias("repo"),
            F.concat(F.lit("g"), (k % 3).cast("string")).alias("acl_group"),
            F.concat(F.lit(f"src/{prefix}/"), (k % 50).cast("string"), F.lit(".go")).alias("path"),
            F.when(k % 5 != 0, F.concat(F.lit("c"), (k % 11).cast("string"))).alias("commit_sha"),
            (k % 100 + 1).cast("int").alias("start_line"),
            (k % 100 + 20).cast("int").alias("end_line"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def star_relations(spark: SparkSession, sf: str, weighted: bool = True) -> DataFrame:
    """Weighted: one row per relation, orders weighing their line items. Otherwise a relation may be repeated, which traversals don't mind, and nothing is shuffled."""
    line = read(spark, sf, "lineitem")
    one = F.lit(1).cast("bigint").alias("weight")
    edge = lambda df, a, b, kind, w=one: df.select(a.alias("from_id"), b.alias("to_id"), F.lit(kind).alias("rel_type"), w)
    customer, orders, supplier, nation = (read(spark, sf, t) for t in ("customer", "orders", "supplier", "nation"))
    calls, uses = line.withColumn("weight", F.lit(1).cast("bigint")), line.select("l_partkey", "l_suppkey")
    if weighted:
        calls, uses = line.groupBy("l_orderkey", "l_partkey").agg(F.count(F.lit(1)).alias("weight")), uses.distinct()
    parts = [
        edge(calls, key_id("o", "l_orderkey"), key_id("p", "l_partkey"), "CALLS", F.col("weight")),
        edge(uses, key_id("p", "l_partkey"), key_id("s", "l_suppkey"), "DEPENDS_ON"),
        edge(orders, key_id("c", "o_custkey"), key_id("o", "o_orderkey"), "IMPLEMENTS"),
        edge(orders, key_id("c", "o_custkey"), key_id("o", "o_orderkey"), "CONTAINS"),
        edge(supplier, key_id("s", "s_suppkey"), key_id("n", "s_nationkey"), "IMPORTS"),
        edge(customer, key_id("c", "c_custkey"), key_id("n", "c_nationkey"), "OVERRIDES"),
        edge(nation, key_id("n", "n_nationkey"), key_id("r", "n_regionkey"), "EXTENDS"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("id", F.concat_ws("|", "from_id", "rel_type", "to_id"))


def star_graph(spark: SparkSession, sf: str, weighted: bool = True) -> Graph:
    return Graph(star_nodes(spark, sf), star_relations(spark, sf, weighted))


def star_points(spark: SparkSession, sf: str) -> DataFrame:
    """embeddings as points on parts, several per part where there are more vectors than parts."""
    n_parts = read(spark, sf, "part").agg(F.count(F.lit(1))).first()[0]
    points = read(spark, sf, "embeddings").select(F.col("vec_id").alias("point_id"), key_id("p", F.col("vec_id") % n_parts + 1).alias("node_id"), F.col("embedding").alias("vector"))
    nodes = star_nodes(spark, sf).select(F.col("id").alias("node_id"), "domain", "tenant_id", "repo", "acl_group")
    return points.join(nodes, "node_id")


def code_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """One row per node id; repeated rows agree, so any stands for all."""
    rows = read(spark, sf, "code_node").select("id", "domain", "node_type", "name", "ast_hash", "provenance.tenant_id", "provenance.repo", "provenance.acl_group", "provenance.path", "provenance.commit_sha", "provenance.start_line", "provenance.end_line")
    return rows.where(F.col("id").isNotNull()).dropDuplicates(["id"])


def code_relations(spark: SparkSession, sf: str) -> DataFrame:
    """One row per relation id; relations without an end are left out."""
    rows = read(spark, sf, "code_relation").select("id", "from_id", "to_id", "rel_type", F.col("weight").cast("bigint").alias("weight"))
    return rows.where("from_id IS NOT NULL AND to_id IS NOT NULL").dropDuplicates(["id"])


def code_graph(spark: SparkSession, sf: str) -> Graph:
    return Graph(code_nodes(spark, sf), code_relations(spark, sf))
