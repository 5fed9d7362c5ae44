"""Graph measures and the impact score.

Personalised PageRank and betweenness run as joins and aggregations. Communities are defined on a bounded subgraph (at
most MAX_EDGES edges, checked) and found in one process.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.traverse import FRONTIER, directed_edges, impact_levels
from graphloom.schema import TRAVERSED
from graphloom.sources.tables import cut, cut_counted

# Rounds and damping of PageRank, weights of the impact score.
ROUNDS, DAMPING = 20, 0.85
WEIGHTS = {"ppr": 0.5, "proximity": 0.3, "betweenness": 0.2}
#: Bound of the subgraphs whose communities are found.
MAX_EDGES = 500_000
#: Rounds between lineage cuts.
CUT_EVERY = 5


class TooLarge(ValueError):
    """A subgraph passes MAX_EDGES."""


class StaleGeneration(RuntimeError):
    """The partition changed, or rows vanished, while scores were computed."""


def personalised_pagerank(edges: DataFrame, seed: str, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """id, score of every node of edges (src, dst) and the seed: (1 - d) at the seed and d times what arrives, over out-degrees.

    Repeated edges count as often as they occur; mass of nodes without out-edges is lost. To follow dependents, hand in
    reversed edges.
    """
    spark = edges.sparkSession
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    # edges stay where they are, spread by source, while only scores move
    steps = edges.join(degree, "src").select("src", "dst", (F.lit(damping) / F.col("degree")).alias("share")).repartition("src").persist(StorageLevel.MEMORY_AND_DISK)
    zero = lambda df, c: df.select(F.col(c).alias("id"), F.lit(0.0).alias("score"))
    start = spark.createDataFrame([(seed, 1 - damping)], "id string, score double")
    base, n = cut_counted(zero(edges, "src").union(zero(edges, "dst")).union(start).groupBy("id").agg(F.max("score").alias("score")))
    rank = base
    try:
        for i in range(1, rounds + 1):
            sent = rank.where("score > 0").withColumnRenamed("id", "src")
            arriving = steps.join(F.broadcast(sent) if n <= FRONTIER else sent, "src").select(F.col("dst").alias("id"), (F.col("score") * F.col("share")).alias("score"))
            rank = base.unionByName(arriving).groupBy("id").agg(F.sum("score").alias("score"))
            if i % CUT_EVERY == 0 or i == rounds:
                rank = cut(rank)
    finally:
        steps.unpersist()
    return rank


def _sources(edges: DataFrame, samples: int) -> DataFrame:
    """Nodes to measure from (id): all, or the samples with the smallest hash."""
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    return nodes if samples <= 0 else nodes.orderBy(F.xxhash64("id"), "id").limit(samples)


def _bounded(edges: DataFrame) -> list:
    rows = edges.select("src", "dst").distinct().limit(MAX_EDGES + 1).collect()
    if len(rows) > MAX_EDGES:
        raise TooLarge(f"the subgraph has more than {MAX_EDGES} edges")
    return [(r["src"], r["dst"]) for r in rows]


def estimate(edges: DataFrame) -> DataFrame:
    """One row before a job on edges (src, dst): n_nodes, n_edges, distributed_bytes (PageRank), driver_bytes (communities), fits.

    fits tells whether communities, which need a bounded subgraph, will take it. Bytes are those of ids, scores and lists.
    """
    ids = edges.select(F.col("src").alias("id")).union(edges.select("dst"))
    nodes = ids.distinct().agg(F.count(F.lit(1)).alias("n_nodes"), F.sum(F.octet_length("id") + 16).alias("id_bytes"))
    rows = edges.agg(F.count(F.lit(1)).alias("n_edges"), F.sum(F.octet_length("src") + F.octet_length("dst") + 8).alias("edge_bytes"))
    distinct = edges.select("src", "dst").distinct().agg(F.count(F.lit(1)).alias("n_distinct"))
    one = nodes.withColumn("k", F.lit(1)).join(rows.withColumn("k", F.lit(1)), "k").join(distinct.withColumn("k", F.lit(1)), "k")
    bytes_ = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return one.select("n_nodes", "n_edges", bytes_(F.col("id_bytes") + F.col("edge_bytes")).alias("distributed_bytes"), bytes_(F.col("id_bytes") + 72 * F.col("n_distinct")).alias("driver_bytes"), (F.col("n_distinct") <= MAX_EDGES).alias("fits"))


def betweenness(edges: DataFrame, samples: int = 0) -> DataFrame:
    """id, score: how often shortest directed paths pass the node (Brandes), from every source or from samples of them, drawn by hash.

    All sources advance together, a level of path lengths at a time: forward, the numbers of shortest paths to every
    node met; backward, what of the paths beyond a node passes through it. Rows are (source, node) pairs, so no node,
    however many edges it has, is one task's work alone. Loops and repeated edges count for nothing.
    """
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    links = edges.select("src", "dst").where("src <> dst").distinct().repartition("src").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        level, rows = cut_counted(_sources(edges, samples).select(F.col("id").alias("source"), F.col("id").alias("node"), F.lit(1.0).alias("paths")))
        levels, known = [level], level.select("source", "node")
        while rows:
            met = level.join(links, F.col("node") == F.col("src")).groupBy("source", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))
            level, rows = cut_counted(met.join(known, ["source", "node"], "left_anti"))
            levels.append(level)
            known = known.unionByName(level.select("source", "node"))
        passed, beyond = None, levels.pop().select("source", "node", "paths", F.lit(0.0).alias("passed"))
        while len(levels) > 1:
            # sources themselves, the first level, are the ends of their paths
            near = levels.pop()
            far = beyond.select("source", F.col("node").alias("dst"), ((1 + F.col("passed")) / F.col("paths")).alias("share"))
            through = near.join(links, F.col("node") == F.col("src")).join(far, ["source", "dst"]).groupBy("source", "node").agg(F.sum(F.col("paths") * F.col("share")).alias("passed"))
            beyond = cut(near.join(through, ["source", "node"], "left").select("source", "node", "paths", F.coalesce("passed", F.lit(0.0)).alias("passed")))
            own = beyond.where("passed > 0").groupBy("node").agg(F.sum("passed").alias("score"))
            passed = own if passed is None else passed.unionByName(own)
    finally:
        links.unpersist()
    if passed is None:
        return nodes.select("id", F.lit(0.0).alias("score"))
    total = passed.groupBy(F.col("node").alias("id")).agg(F.sum("score").alias("score"))
    return nodes.join(total, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))


def detect_communities(pairs: list[tuple[str, str]]) -> dict[str, str]:
    """Communities of high modularity on the undirected graph, each connected; the label is the least id.

    Local moving over rising ids, then splitting into connected parts, then the same on the graph of communities.
    """
    weight: dict[str, dict[str, float]] = {}
    for a, b in sorted(pairs):
        weight.setdefault(a, {})
        weight.setdefault(b, {})
        if a != b:
            weight[a][b] = weight[a].get(b, 0.0) + 1.0
            weight[b][a] = weight[b].get(a, 0.0) + 1.0
    own = {v: {v} for v in weight}
    graph, loops = {v: dict(n) for v, n in weight.items()}, dict.fromkeys(weight, 0.0)
    total = sum(sum(n.values()) for n in weight.values())
    while total:
        degree = {v: sum(graph[v].values()) + loops[v] for v in graph}
        label = {v: v for v in graph}
        mass = dict(degree)
        for _ in range(50):
            moved = False
            for v in sorted(graph):
                near: dict[str, float] = {}
                for u, w in graph[v].items():
                    near[label[u]] = near.get(label[u], 0.0) + w
                mass[label[v]] -= degree[v]
                best = max(sorted({label[v], *near}), key=lambda c: (near.get(c, 0.0) - mass.get(c, 0.0) * degree[v] / total, c == label[v]))
                moved |= best != label[v]
                label[v] = best
                mass[best] = mass.get(best, 0.0) + degree[v]
            if not moved:
                break
        parts: dict[str, str] = {}  # connected parts of the communities
        for v in sorted(graph):
            if v not in parts:
                stack = [v]
                while stack:
                    x = stack.pop()
                    if x not in parts:
                        parts[x] = v
                        stack += [u for u in graph[x] if label[u] == label[x] and u not in parts]
        if len(set(parts.values())) == len(graph):
            break
        merged = {p: {} for p in set(parts.values())}
        inner = dict.fromkeys(merged, 0.0)
        for v in graph:
            inner[parts[v]] += loops[v]
            for u, w in graph[v].items():
                if parts[u] == parts[v]:
                    inner[parts[v]] += w
                else:
                    merged[parts[v]][parts[u]] = merged[parts[v]].get(parts[u], 0.0) + w
        held: dict[str, set] = {p: set() for p in merged}
        for v in graph:
            held[parts[v]] |= own[v]
        own, graph, loops = held, merged, inner
    return {x: min(group) for group in own.values() for x in group}


def communities(edges: DataFrame) -> DataFrame:
    """id, community of a bounded subgraph, in one task."""
    pairs = _bounded(edges)
    rows = sorted(detect_communities(pairs).items())
    return edges.sparkSession.createDataFrame(rows, "id string, community string")


def modularity(pairs: list[tuple[str, str]], label: dict[str, str]) -> float:
    kept = [(a, b) for a, b in pairs if a != b]
    if not kept:
        return 0.0
    degree: dict[str, float] = {}
    inside = 0
    for a, b in kept:
        inside += label[a] == label[b]
        for x in (a, b):
            degree[label[x]] = degree.get(label[x], 0.0) + 1
    return inside / len(kept) - sum((d / (2 * len(kept))) ** 2 for d in degree.values())


def min_max(df: DataFrame, value: str, out: str) -> DataFrame:
    """df with out: value scaled to 0..1 over all rows; 0 for null or where all are equal."""
    low, high = df.agg(F.min(value), F.max(value)).first()
    if low is None or high == low:
        return df.withColumn(out, F.lit(0.0))
    return df.withColumn(out, F.coalesce((F.col(value) - F.lit(low)) / F.lit(high - low), F.lit(0.0)))


def impact_scores(dependents: DataFrame, ppr: DataFrame, between: DataFrame, entry: str, weights: dict[str, float] = WEIGHTS, with_entry: bool = True) -> DataFrame:
    """node_id, hop, edge_type, ppr_norm, betweenness_norm, impact_score of each dependent.

    dependents: node_id, hop, edge_type. Measures are scaled over all their nodes, the entry included unless
    with_entry is false; a missing measure counts as 0.
    """
    def scaled(df: DataFrame, name: str) -> DataFrame:
        kept = df if with_entry else df.where(F.col("id") != entry)
        return min_max(kept, "score", name).select(F.col("id").alias("node_id"), name)

    rows = dependents.join(scaled(ppr, "ppr_norm"), "node_id", "left").join(scaled(between, "betweenness_norm"), "node_id", "left").fillna(0.0, ["ppr_norm", "betweenness_norm"])
    score: Column = F.lit(weights["ppr"]) * F.col("ppr_norm") + F.lit(weights["proximity"]) / F.col("hop") + F.lit(weights["betweenness"]) * F.col("betweenness_norm")
    return rows.select("node_id", "hop", "edge_type", "ppr_norm", "betweenness_norm", score.alias("impact_score"))


def fenced_write(scores: DataFrame, nodes: DataFrame, partition: dict, generation: int, partitions: DataFrame) -> DataFrame:
    """The rows to write, with partition and generation, if the fence holds; else StaleGeneration and nothing.

    scores: node_id, impact_score. The fence: the partition (tenant_id, repo, acl_group) still has the generation that
    the scores were computed under, and all their nodes are still in it.
    """
    match = F.lit(True)
    for name in ("tenant_id", "repo", "acl_group"):
        match = match & (F.col(name) == partition[name])
    now = partitions.where(match).agg(F.max("generation")).first()[0]
    if now != generation:
        raise StaleGeneration(f"generation {generation} is now {now}")
    gone = scores.join(nodes.where(match).select(F.col("id").alias("node_id")), "node_id", "left_anti")
    if not gone.isEmpty():
        raise StaleGeneration("nodes left the partition")
    return scores.select("node_id", *(F.lit(partition[n]).alias(n) for n in ("tenant_id", "repo", "acl_group")), F.lit(generation).cast("bigint").alias("generation"), "impact_score")


def impact_job(nodes: DataFrame, relations: DataFrame, entry: str, partition: dict, partitions: DataFrame, depth: int = 4, max_nodes: int = 100_000, samples: int = 0) -> DataFrame:
    """The rows to write for the dependents of the entry within one partition, with community; StaleGeneration if it moved on.

    The generation is read first, then dependents are discovered level by level, measured on the reversed subgraph that
    they and the entry induce, combined, and fenced by that generation.
    """
    match = F.lit(True)
    for name in ("tenant_id", "repo", "acl_group"):
        match = match & (F.col(name) == partition[name])
    generation = partitions.where(match).agg(F.max("generation")).first()[0]
    seen = nodes.where(match)
    found = None
    for level, _ in impact_levels(seen, relations, entry, depth, max_nodes):
        rows = level.select("node_id", "hop", "edge_type")
        found = rows if found is None else found.unionByName(rows)
    members = seen.join(found.select(F.col("node_id").alias("id")), "id", "left_semi").select("id").unionByName(seen.where(F.col("id") == entry).select("id"))
    edges = cut(directed_edges(relations, members, TRAVERSED, "reverse").select(F.col("here").alias("src"), F.col("there").alias("dst")))
    scores = impact_scores(found, personalised_pagerank(edges, entry), betweenness(edges, samples), entry)
    written = fenced_write(scores, nodes, partition, generation, partitions)
    return written.join(communities(edges).withColumnRenamed("id", "node_id"), "node_id", "left")
