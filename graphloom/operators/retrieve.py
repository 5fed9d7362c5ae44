"""Hybrid retrieval: vector and graph legs, reciprocal-rank fusion, proximity, re-check, hydration and rerank.

Inputs are already scoped (see scope.scoped). Every ranking ends with the node id, so that ties have one order.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.vectors import cosine, literal_vector
from graphloom.operators.traverse import reach_reverse
from graphloom.schema import FULLTEXT_NODE_TYPES
from graphloom.sources.tables import cut

# The fusion constant, boosts and limits of a retrieval.
RRF_K, BETA, VECTOR_LIMIT, GRAPH_LIMIT, TOP_K = 60, 0.15, 50, 200, 25
RERANK_BETA, HOP_WEIGHT, IMPACT_WEIGHT = 0.15, 0.5, 0.5
# The usual parameters of the ranking function BM25.
BM25_K1, BM25_B = 1.2, 0.75


def vector_search(points: DataFrame, query: list[float], domain: str | None = None, limit: int = VECTOR_LIMIT) -> DataFrame:
    """node_id, domain, point_id, vector_score, vector_rank: the points most similar to the query, one row per point.

    points: point_id, node_id (null: the point's own id), domain (null: code), vector. Points without usable vector are
    left out. Filters come before the top-k, which is kept per task and merged.
    """
    rows = points.withColumn("domain", F.coalesce("domain", F.lit("code")))
    if domain is not None:
        rows = rows.where(F.col("domain") == domain)
    score = F.nanvl(cosine(F.col("vector"), literal_vector(query)), F.lit(None).cast("double"))
    rows = rows.select(F.coalesce("node_id", F.col("point_id").cast("string")).alias("node_id"), "domain", "point_id", score.alias("vector_score"))
    # nulls sort last, so that the filter can wait until after the cut and the score is computed once
    top = rows.orderBy(F.desc("vector_score"), "point_id").limit(limit).where("vector_score IS NOT NULL")
    return top.withColumn("vector_rank", F.row_number().over(Window.orderBy(F.desc("vector_score"), "point_id")))  # over limit rows


def sanitise_query(text: str) -> str:
    """Without trailing question and punctuation marks."""
    return text.strip().rstrip("?!.,;:")


def by_ids(rows: DataFrame, key: str, ids: list | DataFrame) -> DataFrame:
    """One row for each wanted id that rows have (points, texts or nodes): ids are values, which reach the scan as a filter, or a DataFrame with the column key.

    Rows repeated under an id count once. Null ids find nothing.
    """
    found = rows.join(ids.select(key).distinct(), key, "left_semi") if isinstance(ids, DataFrame) else rows.where(F.col(key).isin(list(ids)))
    return found.dropDuplicates([key])


def _terms(col: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(col, F.lit(""))), r"[^\p{L}\p{Nd}]+"), lambda t: t != "")


def _idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def _saturated(tf: Column, length: Column, average: Column) -> Column:
    return tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * length / average))


def _texts(nodes: DataFrame) -> Column:
    return F.concat_ws(" ", *(c for c in ("name", "signature", "source_text") if c in nodes.columns))


def term_counts(nodes: DataFrame, terms: list[str], chunks: DataFrame | None = None) -> DataFrame:
    """id, domain, name, len and tf0, tf1, ... of the nodes of the indexed types: their words, and those equal to each term.

    Counts are taken where a text lies, in each chunk if chunks are given, and added up by node; texts are never put
    together. Repeated chunks of one index count once (the largest text).
    """
    kept = nodes.where(F.col("node_type").isin(FULLTEXT_NODE_TYPES))
    counts = lambda words: (F.size(words).alias("len"), *(F.size(F.filter(words, partial(_is, t))).alias(f"tf{i}") for i, t in enumerate(terms)))
    own = kept.select("id", "domain", "name", _terms(_texts(nodes)).alias("words")).select("id", "domain", "name", *counts("words"))
    if chunks is None:
        return own
    one = chunks.where("text IS NOT NULL").groupBy("entity_id", "chunk_index").agg(F.max("text").alias("text"))
    each = one.select("entity_id", _terms(F.col("text")).alias("words")).select("entity_id", *counts("words"))
    names = ["len", *(f"tf{i}" for i in range(len(terms)))]
    total = each.groupBy(F.col("entity_id").alias("id")).agg(*(F.sum(c).alias(f"add_{c}") for c in names))
    return own.join(total, "id", "left").select("id", "domain", "name", *((F.col(c) + F.coalesce(f"add_{c}", F.lit(0))).alias(c) for c in names))


def fulltext_search(nodes: DataFrame, query: str, limit: int = TOP_K, chunks: DataFrame | None = None) -> DataFrame:
    """id, domain, name, score, text_rank: nodes of the indexed types by BM25 over name, signature and source_text, and the texts of their chunks.

    nodes: id, domain, node_type, name and, if there, signature and source_text. A query without terms gives no rows.
    One pass over the texts: the counts of the query's terms are kept, a few numbers a node, and serve both the
    statistics and the scores.
    """
    terms = sorted({t for t in _split(sanitise_query(query))})
    if not terms:
        return nodes.limit(0).select("id", "domain", "name", F.lit(0.0).alias("score"), F.lit(0).alias("text_rank"))
    docs = cut(term_counts(nodes, terms, chunks))
    stats = docs.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"), *(F.count(F.when(F.col(f"tf{i}") > 0, 1)).alias(f"df{i}") for i in range(len(terms)))).first()
    score = F.lit(0.0)
    for i in range(len(terms)):
        score = score + _idf(F.lit(stats["n"]), F.lit(stats[f"df{i}"])) * _saturated(F.col(f"tf{i}").cast("double"), F.col("len"), F.lit(stats["avg"] or 1.0))
    hits = docs.withColumn("score", score).where(F.greatest(F.lit(0), *(f"tf{i}" for i in range(len(terms)))) > 0)
    top = hits.select("id", "domain", "name", "score").orderBy(F.desc("score"), "id").limit(limit)
    return top.withColumn("text_rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def fulltext_batch(nodes: DataFrame, queries: DataFrame, limit: int = TOP_K) -> DataFrame:
    """query_id, id, score, text_rank: fulltext_search for every query (query_id, text) at once, over the texts of nodes.

    Postings of the words that queries ask for meet the queries by word, so texts are read once whatever the number of
    queries. Queries without words give no rows.
    """
    docs = nodes.where(F.col("node_type").isin(FULLTEXT_NODE_TYPES)).select("id", _terms(_texts(nodes)).alias("words"))
    asked = cut(queries.select("query_id", F.explode(F.array_distinct(_terms(F.col("text")))).alias("word")).distinct())
    postings = docs.select("id", F.size("words").alias("len"), F.explode("words").alias("word")).join(asked.select("word").distinct(), "word", "left_semi").groupBy("id", "len", "word").agg(F.count(F.lit(1)).cast("double").alias("tf"))
    postings = cut(postings)
    n, average = docs.agg(F.count(F.lit(1)), F.avg(F.size("words"))).first()
    spread = postings.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    worth = postings.join(spread, "word").select("word", "id", (_idf(F.lit(n), F.col("df")) * _saturated(F.col("tf"), F.col("len"), F.lit(average or 1.0))).alias("part"))
    scored = asked.join(worth, "word").groupBy("query_id", "id").agg(F.sum("part").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scored.withColumn("text_rank", place).where(F.col("text_rank") <= limit)


def _is(term: str, word: Column) -> Column:
    return word == F.lit(term)


def _split(text: str) -> list[str]:
    import regex

    return regex.findall(r"[\p{L}\p{Nd}]+", text.lower())


def rrf_fuse(graph: DataFrame, vector: DataFrame, k: int = RRF_K, by: tuple[str, ...] = ()) -> DataFrame:
    """by, node_id, domain, name, hop, vector_score, graph_rank, vector_rank, rrf_score: the legs merged by node.

    graph: node_id, domain, name, hop, graph_rank. vector: node_id, domain, vector_score, vector_rank. Every
    occurrence adds 1 / (k + rank), also several points of one node. The graph leg comes first, then ranks in order:
    the first occurrence that has a value gives it; hop is the least. by: columns that tell several requests apart.
    """
    null = lambda t: F.lit(None).cast(t)
    a = graph.where("graph_rank IS NOT NULL").select(*by, "node_id", "domain", "name", F.col("hop").cast("double").alias("hop"), F.lit(0).alias("leg"), F.col("graph_rank").alias("rank"), null("double").alias("vector_score"))
    b = vector.where("vector_rank IS NOT NULL").select(*by, "node_id", "domain", null("string").alias("name"), null("double").alias("hop"), F.lit(1).alias("leg"), F.col("vector_rank").alias("rank"), "vector_score")
    order = F.struct("leg", "rank")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    named = F.min_by("name", F.when(F.col("name") != "", order)).alias("name")
    return a.unionByName(b).groupBy(*by, "node_id").agg(
        F.min_by("domain", order).alias("domain"),
        named,
        F.min("hop").alias("hop"),
        first("vector_score"),
        F.min(F.when(F.col("leg") == 0, F.col("rank"))).alias("graph_rank"),
        F.min(F.when(F.col("leg") == 1, F.col("rank"))).alias("vector_rank"),
        F.sum(1.0 / (F.lit(float(k)) + F.col("rank"))).alias("rrf_score"),
    )


def boost_proximity(fused: DataFrame, beta: float = BETA) -> DataFrame:
    """fused with combined_score: rrf_score and beta / (1 + hop), nothing where hop is null."""
    return fused.withColumn("combined_score", F.col("rrf_score") + F.coalesce(F.lit(beta) / (1 + F.col("hop")), F.lit(0.0)))


def recheck(fused: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows whose node exists among nodes, the scoped graph view; points without a node fall out."""
    return fused.join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_semi")


def hydrate_names(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """rows with empty or null names filled from nodes."""
    names = nodes.select(F.col("id").alias("node_id"), F.col("name").alias("stored"))
    return rows.join(names, "node_id", "left").withColumn("name", F.coalesce(F.when(F.col("name") != "", F.col("name")), "stored")).drop("stored")


def source_texts(chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """entity_id, source_text: the chunks of the wanted entities (column entity_id) in order, joined by line feeds.

    Repeated chunks of one index count once (the largest text); null texts are skipped. All chunks count, without a
    cap. An entity's text is one value, so it has to fit into a row.
    """
    wanted = chunks.join(entities.select("entity_id").distinct(), "entity_id", "left_semi").where(F.col("text").isNotNull())
    one = wanted.groupBy("entity_id", "chunk_index").agg(F.max("text").alias("text"))
    pieces = F.array_sort(F.collect_list(F.struct("chunk_index", "text")))
    return one.groupBy("entity_id").agg(F.array_join(F.transform(pieces, lambda p: p["text"]), "\n").alias("source_text"))


def hybrid_search(nodes: DataFrame, relations: DataFrame, points: DataFrame, query: list[float] | None, entry: str, max_depth: int = 3, domain: str | None = "code", repo: str | None = None,
                  vector_limit: int = VECTOR_LIMIT, graph_limit: int = GRAPH_LIMIT, top_k: int = TOP_K, beta: float = BETA, chunks: DataFrame | None = None) -> DataFrame:
    """node_id, name, domain, hop, graph_rank, vector_rank, vector_score, rrf_score, combined_score, rank.

    Vector and graph legs are fused, boosted, re-checked against the scoped nodes, cut to top_k and hydrated, with
    source_text where chunks are given. Without a query vector the vector leg is empty (degraded); the graph leg must
    be there.
    """
    graph = reach_reverse(nodes, relations, entry, max_depth, domain, repo, graph_limit).withColumnRenamed("id", "node_id")
    if query is None:
        vector = points.limit(0).select(F.lit("").alias("node_id"), F.lit("").alias("domain"), F.lit(0.0).alias("vector_score"), F.lit(0).alias("vector_rank"))
    else:
        seen = points if repo is None else points.where(F.col("repo") == repo)
        vector = vector_search(seen, query, domain, vector_limit)
    # the legs have at most graph_limit and vector_limit rows, so that one scan of the nodes checks and names them
    fused = F.broadcast(boost_proximity(rrf_fuse(graph, vector), beta))
    seen = nodes.select(F.col("id").alias("node_id"), F.col("name").alias("stored")).join(fused, "node_id")
    named = seen.withColumn("name", F.coalesce(F.when(F.col("name") != "", F.col("name")), "stored")).drop("stored").orderBy(F.desc("combined_score"), "node_id").limit(top_k)
    if chunks is not None:
        named = named.join(source_texts(chunks, named.select(F.col("node_id").alias("entity_id"))).withColumnRenamed("entity_id", "node_id"), "node_id", "left")
    return named.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("combined_score"), "node_id")))


def search(nodes: DataFrame, relations: DataFrame, points: DataFrame, text: str, query: list[float] | None, entry: str | None, top_k: int = TOP_K, **options) -> DataFrame:
    """node_id, name, domain, rank, vector_leg_degraded: hybrid search from an entry, full-text search without one."""
    if entry:
        found = hybrid_search(nodes, relations, points, query, entry, top_k=top_k, **options)
        degraded = found.agg(F.count("vector_rank")).first()[0] == 0
        return found.select("node_id", "name", "domain", "rank", F.lit(degraded).alias("vector_leg_degraded"))
    found = fulltext_search(nodes, text, min(top_k, GRAPH_LIMIT))
    return found.select(F.col("id").alias("node_id"), "name", "domain", F.col("text_rank").alias("rank"), F.lit(True).alias("vector_leg_degraded"))


def diagnostics(result: DataFrame) -> DataFrame:
    """n_graph, n_vector, n_results, vector_leg_degraded of a finished hybrid search: counted after the top-k."""
    has = lambda c: F.count(F.col(c))
    return result.agg(has("graph_rank").alias("n_graph"), has("vector_rank").alias("n_vector"), F.count(F.lit(1)).alias("n_results"), (has("vector_rank") == 0).alias("vector_leg_degraded"))


def digest_score(query: str, text: Column) -> Column:
    """A stand-in for a rerank model: the first four bytes of sha256(query, 0, text) as a share of their range."""
    digest = F.sha2(F.concat(F.encode(F.lit(query), "UTF-8"), F.unhex(F.lit("00")), F.encode(text, "UTF-8")), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967295.0


def current_impact(nodes: DataFrame, scores: DataFrame, partitions: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """node_id, impact_norm: scores that were written under the node's present partition and its present generation.

    scores: node_id, tenant_id, repo, acl_group, generation, impact_score. partitions: tenant_id, repo, acl_group,
    generation. Others count as never written. only: the few candidates (node_id) that are asked for, as a top-k left
    them; they are broadcast.
    """
    where = ["tenant_id", "repo", "acl_group"]
    if only is not None:
        wanted = F.broadcast(only.select("node_id").distinct())
        nodes, scores = nodes.join(wanted, F.col("id") == F.col("node_id"), "left_semi"), scores.join(wanted, "node_id", "left_semi")
    now = nodes.select(F.col("id").alias("node_id"), *where).join(partitions.select(*where, "generation"), where)
    return now.join(scores, ["node_id", *where, "generation"]).select("node_id", F.col("impact_score").alias("impact_norm"))


def rerank(query: str, candidates: DataFrame, impact: DataFrame, top_k: int, score: Callable[[str, Column], Column] = digest_score, beta: float = RERANK_BETA, w_hop: float = HOP_WEIGHT, w_impact: float = IMPACT_WEIGHT) -> DataFrame:
    """candidates with rerank_score, impact_norm, boost, final_score, rank: score plus beta times weighted proximity and impact.

    candidates: node_id, hop and further columns. impact: node_id, impact_norm; missing means 0. The scored text is
    the node id. Empty candidates give no rows; top_k below 1 is an error.
    """
    if top_k < 1:
        raise ValueError("top_k must be at least 1")
    rows = candidates.join(impact.select("node_id", "impact_norm"), "node_id", "left").withColumn("impact_norm", F.coalesce("impact_norm", F.lit(0.0)))
    boost = F.coalesce(F.lit(w_hop) / (1 + F.col("hop")), F.lit(0.0)) + F.lit(w_impact) * F.col("impact_norm")
    rows = rows.withColumn("rerank_score", score(query, F.col("node_id"))).withColumn("boost", boost).withColumn("final_score", F.col("rerank_score") + beta * F.col("boost"))
    top = rows.orderBy(F.desc("final_score"), "node_id").limit(top_k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("final_score"), "node_id")))
