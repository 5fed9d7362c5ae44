"""Traversal of the relation graph, one join per level.

The steps that the caller may take are held for the traversal (adjacency), so that levels read neither relations nor
nodes again.
Frontier and visited sets are DataFrames, cut after every level so that plans stay flat and lost executors cost one
level; the cut counts its rows, and only counts come to the driver. Sets are broadcast while they are small (FRONTIER
rows), so a level is a scan of the steps without a shuffle of them; larger ones join by shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from graphloom.operators.scope import scoped_relations
from graphloom.schema import TRAVERSED
from graphloom.sources.tables import cut, cut_counted

#: Frontiers of up to so many rows are broadcast.
FRONTIER = 100_000


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= FRONTIER else df


def steps(relations: DataFrame, types: list[str] | None, direction: str) -> DataFrame:
    """here, there, rel_type: steps in the direction (forward, reverse or both) over relations of types (none: all)."""
    kept = relations.where(F.col("rel_type").isin(types)) if types else relations
    forward = kept.select(F.col("from_id").alias("here"), F.col("to_id").alias("there"), "rel_type")
    reverse = kept.select(F.col("to_id").alias("here"), F.col("from_id").alias("there"), "rel_type")
    if direction not in ("forward", "reverse", "both"):
        raise ValueError("direction is forward, reverse or both")
    if direction == "both":
        return forward.unionByName(reverse)
    return forward if direction == "forward" else reverse


def directed_edges(relations: DataFrame, nodes: DataFrame, types: list[str] | None, direction: str) -> DataFrame:
    """The steps of the subgraph that nodes induce, for algorithms that go over all of it."""
    return steps(scoped_relations(relations.select("from_id", "to_id", "rel_type"), nodes), types, direction)


@contextmanager
def adjacency(edges: DataFrame, nodes: DataFrame, *columns: str) -> Iterator[DataFrame]:
    """here, there, rel_type if edges have it, and columns of the node there: the steps that end at one of nodes, held for all levels.

    nodes have one row each id. Frontier nodes are among them already, so what starts elsewhere is never stepped on.
    Executors hold the steps in memory and on disk; what is lost with one is computed again from the relations.
    """
    ends = nodes.select(F.col("id").alias("there"), *columns)
    kept = edges.where("here IS NOT NULL").join(ends, "there") if columns else edges.where("here IS NOT NULL").join(ends, "there", "left_semi")
    kept.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        kept.unpersist()


def levels(edges: DataFrame, nodes: DataFrame, start: DataFrame, max_depth: int, include_start: bool = False) -> DataFrame:
    """id, hop: the least number of steps, 1 to max_depth, from any of start (column id) through nodes alone.

    start must be among nodes. With include_start a start that is met again (on a cycle) is listed with its hop,
    otherwise starts are left out. A level is one job: a join with the frontier and one with what is known already,
    both broadcast while they are small.
    """
    if max_depth < 1:
        raise ValueError("max_depth must be at least 1")
    frontier, rows = cut_counted(start.select("id").distinct())
    if not rows:
        return frontier.select("id", F.lit(0).alias("hop")).limit(0)
    known, n_known = (None, 0) if include_start else (frontier, rows)
    found = None
    with adjacency(edges.select("here", "there"), nodes) as inside:
        for hop in range(1, max_depth + 1):
            met = inside.join(_small(frontier.withColumnRenamed("id", "here"), rows), "here").select(F.col("there").alias("id")).distinct()
            frontier, rows = cut_counted(met if known is None else met.join(_small(known, n_known), "id", "left_anti"))
            known, n_known = frontier if known is None else known.unionByName(frontier), n_known + rows
            level = frontier.select("id", F.lit(hop).alias("hop"))
            found = level if found is None else found.unionByName(level)
            if not rows:
                break
    return found


def reach_reverse(nodes: DataFrame, relations: DataFrame, entry: str, max_depth: int, domain: str | None = None, repo: str | None = None, limit: int | None = 200, types: list[str] = TRAVERSED) -> DataFrame:
    """id, domain, name, hop, graph_rank: who depends on the entry, nearest first.

    nodes are the ones the caller may see; paths run through them alone. domain and repo restrict the result but not
    the nodes between. limit None gives all. The entry itself is listed if a cycle leads back to it. Ties of hop are ranked by id.
    """
    start = nodes.where(F.col("id") == entry)
    found = levels(steps(relations, types, "reverse"), nodes, start, max_depth, include_start=True)
    kept = nodes.select("id", "domain", "name", "repo").join(_small(found, found.count()), "id")
    for name, value in (("domain", domain), ("repo", repo)):
        if value is not None:
            kept = kept.where(F.col(name) == value)
    if limit is None:
        return ranked(kept, ["hop", "id"], "graph_rank").select("id", "domain", "name", "hop", "graph_rank")
    top = kept.orderBy("hop", "id").limit(limit)
    rank = F.row_number().over(Window.orderBy("hop", "id"))  # over at most limit rows
    return top.select("id", "domain", "name", "hop", rank.alias("graph_rank"))


def ranked(rows: DataFrame, by: list[str], out: str) -> DataFrame:
    """rows with out, their place from 1 in the order of the columns by, whatever their number: range-sorted, then counted by partition."""
    placed = cut(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__part", F.spark_partition_id()))
    sizes = [(r["__part"], r["n"]) for r in placed.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()]  # one row a partition
    before, starts = 0, []
    for part, n in sorted(sizes):
        starts.append((part, before))
        before += n
    starts = F.broadcast(rows.sparkSession.createDataFrame(starts, "__part int, __before bigint"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*by))
    return placed.join(starts, "__part").withColumn(out, (F.col("__before") + inside).cast("int")).drop("__part", "__before")


def impact_levels(nodes: DataFrame, relations: DataFrame, entry: str, max_depth: int = 4, max_nodes: int = 1000, domain: str | None = None, repo: str | None = None) -> Iterator[tuple[DataFrame, dict]]:
    """Level by level, the nodes an edit of the entry may touch: (level DataFrame, progress).

    Rows of a level: node_id, domain, hop, edge_type, the lexicographically least type of the edges from the frontier.
    domain and repo filter every level and so prune paths. At most max_nodes nodes in all, lowest ids first within a
    level; truncated is set on the level where a further node had to be refused, which is the last one. Progress:
    nodes_explored, frontier_size, current_depth, truncated. A level without rows has its progress too.
    """
    if max_depth < 1 or max_nodes < 1:
        raise ValueError("max_depth and max_nodes must be at least 1")
    allowed = nodes
    for name, value in (("domain", domain), ("repo", repo)):
        if value is not None:
            allowed = allowed.where(F.col(name) == value)
    frontier, rows = cut_counted(nodes.where(F.col("id") == entry).select("id").distinct())
    if not rows:
        nothing = frontier.select(F.col("id").alias("node_id"), F.lit("").alias("domain"), F.lit(1).alias("hop"), F.lit("").alias("edge_type"))
        yield nothing, {"nodes_explored": 0, "frontier_size": 0, "current_depth": 1, "truncated": False}
        return
    visited, n_visited, explored = frontier, 1, 0
    with adjacency(steps(relations, TRAVERSED, "reverse"), allowed, "domain") as inside:
        for depth in range(1, max_depth + 1):
            met = inside.join(_small(frontier.withColumnRenamed("id", "here"), rows), "here").groupBy(F.col("there").alias("id"), "domain").agg(F.min("rel_type").alias("edge_type"))
            new, count = cut_counted(met.join(_small(visited, n_visited), "id", "left_anti"))
            room = max_nodes - explored
            truncated = count > room
            level, rows = (new.orderBy("id").limit(room), room) if truncated else (new, count)
            explored += rows
            yield (
                level.select(F.col("id").alias("node_id"), "domain", F.lit(depth).alias("hop"), "edge_type"),
                {"nodes_explored": explored, "frontier_size": rows, "current_depth": depth, "truncated": truncated},
            )
            if truncated or not rows:
                return
            frontier = level.select("id")
            visited, n_visited = visited.unionByName(frontier), n_visited + rows


EVENTS = "event_kind string, node_id string, domain string, hop int, edge_type string, impact_kind string, nodes_explored int, frontier_size int, truncated boolean"

# Kinds of impact by the type of the last edge.
IMPACT_KINDS = {"module-boundary": ["IMPORTS", "DEPENDS_ON"], "behavioral": ["CALLS"], "syntactic": ["IMPLEMENTS", "EXTENDS", "OVERRIDES"]}


def impact_kind(edge_type):
    """module-boundary, behavioral, syntactic or the empty string."""
    out = F.lit("")
    for kind, types in IMPACT_KINDS.items():
        out = F.when(edge_type.isin(types), kind).otherwise(out)
    return out


def impact_events(nodes: DataFrame, relations: DataFrame, entry: str, max_depth: int = 4, max_nodes: int = 1000, domain: str | None = None, repo: str | None = None) -> DataFrame:
    """The whole stream of impact_levels: event_kind (node or progress) with the columns of either."""
    out = None
    for level, progress in impact_levels(nodes, relations, entry, max_depth, max_nodes, domain, repo):
        rows = level.select(F.lit("node").alias("event_kind"), "node_id", "domain", "hop", "edge_type", impact_kind(F.col("edge_type")).alias("impact_kind"), *(F.lit(None).cast(t).alias(c) for c, t in (("nodes_explored", "int"), ("frontier_size", "int"), ("truncated", "boolean"))))
        told = level.sparkSession.createDataFrame([("progress", None, None, progress["current_depth"], None, None, progress["nodes_explored"], progress["frontier_size"], progress["truncated"])], EVENTS)
        both = rows.unionByName(told)
        out = both if out is None else out.unionByName(both)
    return out


def neighbors(nodes: DataFrame, relations: DataFrame, entry: str, types: list[str] | None = None, direction: str = "both", depth: int = 1, limit: int | None = 100) -> DataFrame:
    """id, domain, name, hop, traversed_types: the nodes within depth steps of the entry, which is left out.

    traversed_types: the sorted types of the edges by which any shortest walk enters the node. Ordered by id, at most
    limit nodes (None: all, in no order).
    """
    edges = steps(relations, types, direction)
    start = nodes.where(F.col("id") == entry)
    found = levels(edges, nodes, start, depth)
    places = found.unionByName(start.select("id", F.lit(0).alias("hop")).distinct())
    last = edges.join(places.select(F.col("id").alias("here"), F.col("hop").alias("hop_here")), "here").join(found.select(F.col("id").alias("there"), "hop"), "there").where("hop_here = hop - 1")
    by = last.groupBy(F.col("there").alias("id"), "hop").agg(F.array_join(F.array_sort(F.collect_set("rel_type")), ",").alias("traversed_types"))
    named = nodes.select("id", "domain", "name").join(by, "id")
    return named if limit is None else named.orderBy("id").limit(limit)


def get_node(nodes: DataFrame, node_id: str) -> DataFrame:
    """The node among those the caller may see; absent and hidden nodes give no row alike."""
    return nodes.where(F.col("id") == node_id).select("id", "domain", "node_type", "name", "ast_hash", "repo", "path")


def relations_exist(nodes: DataFrame, relations: DataFrame, claims: DataFrame, max_depth: int = 4) -> DataFrame:
    """claims (claim_id, source_id, target_id, edge_type, depth) with a boolean holds.

    A claim holds if edges of its type lead from source to target in at most min(depth, max_depth) steps through nodes
    the caller may see. All claims advance together, one join a level.
    """
    edges = steps(relations, None, "forward")
    at = cut(claims.join(nodes.select(F.col("id").alias("source_id")), "source_id", "left_semi").select("claim_id", "target_id", "edge_type", F.least("depth", F.lit(max_depth)).alias("depth"), F.col("source_id").alias("id")))
    seen, hits = at.select("claim_id", "id"), None
    for hop in range(1, max_depth + 1):
        step = at.where(F.col("depth") >= hop).join(edges, (F.col("id") == F.col("here")) & (F.col("edge_type") == F.col("rel_type"))).select("claim_id", "target_id", "edge_type", "depth", F.col("there").alias("id")).distinct()
        step = step.join(nodes.select("id"), "id", "left_semi").join(seen.distinct().withColumn("old", F.lit(True)), ["claim_id", "id"], "left")
        step = cut(step.where("old IS NULL OR id = target_id").select(*at.columns))
        hit = step.where("id = target_id").select("claim_id")
        hits = hit if hits is None else hits.unionByName(hit)
        at = step.where("id <> target_id")
        seen = seen.unionByName(at.select("claim_id", "id"))
        if at.isEmpty():
            break
    return claims.join(hits.distinct().withColumn("holds", F.lit(True)), "claim_id", "left").withColumn("holds", F.coalesce("holds", F.lit(False)))


def authorised_projection(visible: DataFrame, relations: DataFrame, root: str, max_depth: int = 16) -> DataFrame:
    """id, hop: what the root contains, through visible ancestors alone; the root with hop 0, if it is visible."""
    start = visible.where(F.col("id") == root)
    below = levels(steps(relations, ["CONTAINS"], "forward"), visible, start, max_depth)
    return start.select("id", F.lit(0).alias("hop")).distinct().unionByName(below)


def hierarchy_violations(items: DataFrame, root: str) -> DataFrame:
    """id, violation: duplicate_id, missing_root, missing_child, level_not_below (which includes every cycle).

    items: id, level, child_ids. Levels must fall strictly from parent to child, so no search for cycles is needed.
    """
    spark = items.sparkSession
    duplicate = items.groupBy("id").count().where("count > 1").select("id", F.lit("duplicate_id").alias("violation"))
    no_root = spark.createDataFrame([(root,)], "id string").join(items.select("id"), "id", "left_anti").select("id", F.lit("missing_root").alias("violation"))
    links = items.select(F.col("id").alias("parent"), F.col("level").alias("parent_level"), F.explode("child_ids").alias("id"))
    no_child = links.join(items.select("id"), "id", "left_anti").select("id", F.lit("missing_child").alias("violation")).distinct()
    flat = links.join(items.select("id", "level"), "id").where("level >= parent_level").select(F.col("parent").alias("id"), F.lit("level_not_below").alias("violation")).distinct()
    return duplicate.unionByName(no_root).unionByName(no_child).unionByName(flat)
