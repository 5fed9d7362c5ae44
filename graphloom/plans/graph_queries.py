"""Queries on the property graphs: scope, lookup, traversal, measures, retrieval and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.ids import cache_key, command_fingerprint, parser_id, point_id, scoped_node_id
from graphloom.functions.vectors import cosine
from graphloom.operators import algos, retrieve
from graphloom.operators.agent import Limits, explore
from graphloom.operators.pack import byte_tokens, citation, deduplicated, pack
from graphloom.operators.scope import Scope, label_outcome, policy_decision, scoped, scoped_relations
from graphloom.operators.traverse import directed_edges, get_node, impact_events, impact_kind, impact_levels, neighbors, reach_reverse, relations_exist
from graphloom.plans.graph_sql import CODE, SCOPED, SEEN, STAR, TYPES, walk
from graphloom.schema import TRAVERSED, extension_outcome
from graphloom.sources import cut, read
from graphloom.sources.graph import Graph, code_graph, code_nodes, key_id, star_graph, star_points

SCOPE = Scope("t0", "u", ("repo0", "repo1", "repo2"), ("g0", "g1"))
SEED = "s:1"
#: The node of the code graph with the most dependents.
HUB = "3eabf2a30356d656061a78245b9b2bff2822a8a3d42ebe4aae75062d2fcc6a20"
QUERY_VECTOR = 7

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _seen(spark: SparkSession, sf: str, weighted: bool = False) -> Graph:
    graph = star_graph(spark, sf, weighted)
    return Graph(scoped(graph.nodes, SCOPE), graph.relations)


# --- scope, projection, identifiers -------------------------------------------------------------------------------


@query(f"WITH {STAR} SELECT id, domain, node_type, name, ast_hash, repo, path FROM nodes WHERE {SCOPED}")
def scoped_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return scoped(star_graph(spark, sf).nodes, SCOPE).select("id", "domain", "node_type", "name", "ast_hash", "repo", "path")


@query(f"WITH {STAR} SELECT repo, node_type, count(*) AS n FROM nodes WHERE {SCOPED} AND repo = 'repo1' GROUP BY ALL")
def scoped_narrowed(spark: SparkSession, sf: str) -> DataFrame:
    return scoped(star_graph(spark, sf).nodes, SCOPE, "repo1").groupBy("repo", "node_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {STAR} SELECT id FROM nodes WHERE FALSE")
def scoped_foreign_repo(spark: SparkSession, sf: str) -> DataFrame:
    return scoped(star_graph(spark, sf).nodes, SCOPE, "repo3").select("id")


@query(f"WITH {SEEN} SELECT from_id, to_id, rel_type, weight FROM e")
def scoped_subgraph(spark: SparkSession, sf: str) -> DataFrame:
    graph = _seen(spark, sf, weighted=True)
    return scoped_relations(graph.relations, graph.nodes).select("from_id", "to_id", "rel_type", "weight")


@query(f"WITH {STAR} SELECT id, domain, node_type, name, ast_hash, repo, path FROM nodes WHERE {SCOPED} AND id = 's:1'")
def node_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return get_node(_seen(spark, sf).nodes, SEED)


@query("""SELECT id, CASE WHEN provenance.tenant_id IS NULL OR provenance.tenant_id = '' OR provenance.repo IS NULL OR provenance.repo = '' OR provenance.acl_group IS NULL OR provenance.acl_group = '' THEN 'missing'
 WHEN trim(provenance.tenant_id) <> provenance.tenant_id OR trim(provenance.repo) <> provenance.repo OR trim(provenance.acl_group) <> provenance.acl_group THEN 'invalid' ELSE 'accepted' END AS outcome FROM code_node""")
def label_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    p = "provenance"
    return read(spark, sf, "code_node").select("id", label_outcome(F.col(f"{p}.tenant_id"), F.col(f"{p}.repo"), F.col(f"{p}.acl_group")).alias("outcome"))


@query("""WITH q AS (SELECT event_id, CASE WHEN user_id % 7 = 0 THEN ' ' ELSE 't' || (user_id % 3) END AS t, CASE WHEN event_id % 11 <> 0 THEN 'u' || user_id END AS u,
 CASE event_type WHEN 'click' THEN 'get_node' WHEN 'view' THEN 'hybrid_search' WHEN 'purchase' THEN 'health' WHEN 'error' THEN 'drop_table' ELSE 'impact_analysis' END AS a, event_id % 5 AS r, event_id % 6 AS g FROM events)
 SELECT event_id, CASE WHEN trim(t) = '' THEN 'missing_tenant' WHEN u IS NULL THEN 'missing_user' WHEN a = 'drop_table' THEN 'unknown_action' WHEN a = 'health' THEN 'allow' WHEN r = 0 THEN 'empty_repo_scope' WHEN g = 0 THEN 'empty_acl_scope' ELSE 'allow' END AS reason,
 NOT (trim(t) = '' OR u IS NULL OR a = 'drop_table' OR (a <> 'health' AND (r = 0 OR g = 0))) AS allow FROM q""")
def policy_decisions(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events")
    kind = F.col("event_type")
    action = F.when(kind == "click", "get_node").when(kind == "view", "hybrid_search").when(kind == "purchase", "health").when(kind == "error", "drop_table").otherwise("impact_analysis")
    tenant = F.when(F.col("user_id") % 7 == 0, " ").otherwise(F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")))
    user = F.when(F.col("event_id") % 11 != 0, F.concat(F.lit("u"), F.col("user_id").cast("string")))
    listed = lambda n, v: F.when(F.col("event_id") % n == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit(v)))
    return e.select("event_id", policy_decision(tenant, user, action, listed(5, "repo0"), listed(6, "g0")).alias("d")).select("event_id", "d.reason", "d.allow")


@query("""SELECT id, CASE WHEN domain NOT IN ('code', 'doc', 'legal') OR domain IS NULL THEN 'unsupported_domain' WHEN ext IS NULL THEN 'missing_ext' WHEN NOT json_valid(ext) THEN 'invalid_json'
 WHEN (domain = 'code' AND ext->>'node_type' IN ('Module','Package','File','Class','Interface','Method','Function','Parameter','Field','CallSite')) OR (domain = 'doc' AND ext->>'node_type' IN ('Document','Section','Paragraph')) OR (domain = 'legal' AND ext->>'node_type' IN ('Contract','Clause','Policy','Regulation')) THEN 'accepted' ELSE 'unknown_node_type' END AS outcome FROM code_node""")
def extension_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "code_node").select("id", extension_outcome(F.col("domain"), F.col("ext")).alias("outcome"))


_BLOB = lambda x, w: f"unhex(lpad(hex(octet_length({x}::BLOB)), {2 * w}, '0')) || ({x})::BLOB"


@query(f"""WITH {STAR}, p AS (SELECT id, tenant_id, repo, acl_group, ast_hash, sha256(path || ':' || name) AS parser_id FROM nodes)
 SELECT id, parser_id, sha256('node-id-v2'::BLOB || {_BLOB('tenant_id', 8)} || {_BLOB('repo', 8)} || {_BLOB('parser_id', 8)}) AS node_id, 'scache:v2:' || sha256('semantic-cache-key-v2'::BLOB || {_BLOB('id', 4)} || {_BLOB('ast_hash', 4)} || {_BLOB("'v1'", 4)} || {_BLOB('acl_group', 4)}) AS cache_key,
 sha256({_BLOB('tenant_id', 8)} || {_BLOB('repo', 8)} || {_BLOB('parser_id', 8)}) AS fingerprint FROM p""")
def scoped_ids(spark: SparkSession, sf: str) -> DataFrame:
    n = star_graph(spark, sf).nodes.withColumn("parser_id", parser_id(F.col("path"), F.col("name")))
    return n.select("id", "parser_id", scoped_node_id(F.col("tenant_id"), F.col("repo"), F.col("parser_id")).alias("node_id"), cache_key(F.col("id"), F.col("ast_hash"), F.lit("v1"), F.col("acl_group")).alias("cache_key"), command_fingerprint([F.col("tenant_id"), F.col("repo"), F.col("parser_id")]).alias("fingerprint"))


@query("""WITH h AS (SELECT DISTINCT id, sha1(unhex('5f3e8a1c9b6d4e2a8c7f1a2b3c4d5e6f') || id::BLOB) AS h FROM code_embedding)
 SELECT id, substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-5' || substring(h, 14, 3) || '-' || format('{:x}', (('0x' || substring(h, 17, 1))::INT & 3) | 8) || substring(h, 18, 3) || '-' || substring(h, 21, 12) AS point_id FROM h""")
def point_ids(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "code_embedding").select("id", point_id(F.col("id")).alias("point_id")).distinct()


@query(f"""WITH {STAR} SELECT id, CASE WHEN commit_sha IS NOT NULL THEN repo || '/' || path || ':' || start_line || '-' || end_line || '@' || commit_sha ELSE 'provenance non disponibile' END AS citation FROM nodes""")
def citations(spark: SparkSession, sf: str) -> DataFrame:
    return star_graph(spark, sf).nodes.select("id", citation(F.col("repo"), F.col("path"), F.col("start_line"), F.col("end_line"), F.col("commit_sha")).alias("citation"))


# --- traversal ----------------------------------------------------------------------------------------------------

_REVERSE = f"SELECT to_id AS here, from_id AS there FROM e WHERE rel_type IN ({TYPES})"


@query(f"WITH RECURSIVE {SEEN}, start AS (SELECT * FROM seen), {walk(repr(SEED), 4, _REVERSE)}, m AS (SELECT id, min(hop) AS hop FROM walk WHERE hop > 0 GROUP BY id), t AS (SELECT s.id, s.domain, s.name, CAST(hop AS INTEGER) AS hop FROM m JOIN seen s USING (id) ORDER BY hop, s.id LIMIT 200) SELECT *, CAST(row_number() OVER (ORDER BY hop, id) AS INTEGER) AS graph_rank FROM t")
def reach_reverse_scoped(spark: SparkSession, sf: str) -> DataFrame:
    graph = _seen(spark, sf)
    return reach_reverse(graph.nodes, graph.relations, SEED, 4)


@query(ORACLES["reach_reverse_scoped"].replace("SELECT s.id, s.domain", "SELECT s.id, s.domain").replace("USING (id) ORDER", "USING (id) WHERE domain = 'code' AND repo = 'repo1' ORDER"))
def reach_reverse_filtered(spark: SparkSession, sf: str) -> DataFrame:
    graph = _seen(spark, sf)
    return reach_reverse(graph.nodes, graph.relations, SEED, 4, domain="code", repo="repo1")


@query(f"WITH RECURSIVE {CODE}, start AS (SELECT * FROM nodes), {walk(repr(HUB), 3, _REVERSE)}, m AS (SELECT id, min(hop) AS hop FROM walk WHERE hop > 0 GROUP BY id), t AS (SELECT s.id, s.domain, s.name, CAST(hop AS INTEGER) AS hop FROM m JOIN nodes s USING (id)  ) SELECT *, CAST(row_number() OVER (ORDER BY hop, id) AS INTEGER) AS graph_rank FROM t")
def reach_reverse_code(spark: SparkSession, sf: str) -> DataFrame:
    graph = code_graph(spark, sf)
    return reach_reverse(graph.nodes, graph.relations, HUB, 3, limit=None)


def _bfs_sql(head: str, table: str, entry: str, depth: int, extra: str = "") -> str:
    """Levels of the impact search, one pair of tables each: the candidates, and all nodes known after it."""
    parts = [f"k0 AS (SELECT id, 0 AS hop FROM {table} WHERE id = '{entry}' UNION SELECT '{entry}', 0)"]
    for d in range(1, depth + 1):
        parts.append(f"l{d} AS (SELECT n.id, any_value(n.domain) AS domain, {d} AS hop, min(rel_type) AS edge_type FROM e JOIN k{d - 1} k ON k.id = e.to_id AND k.hop = {d - 1} JOIN {table} n ON n.id = e.from_id WHERE rel_type IN ({TYPES}) {extra} AND n.id NOT IN (SELECT id FROM k{d - 1}) AND '{entry}' IN (SELECT id FROM {table}) GROUP BY n.id)")
        parts.append(f"k{d} AS (SELECT * FROM k{d - 1} UNION ALL SELECT id, hop FROM l{d})")
    return f"WITH {head}, {', '.join(parts)}, bfs AS ({' UNION ALL '.join(f'SELECT * FROM l{d}' for d in range(1, depth + 1))})"


_KIND = "CASE WHEN edge_type IN ('IMPORTS', 'DEPENDS_ON') THEN 'module-boundary' WHEN edge_type = 'CALLS' THEN 'behavioral' ELSE 'syntactic' END"
_IMPACT = "SELECT id AS node_id, domain, CAST(hop AS INTEGER) AS hop, edge_type, {kind} AS impact_kind FROM bfs"


def _impact_nodes(events: DataFrame) -> DataFrame:
    return events.where("event_kind = 'node'").select("node_id", "domain", "hop", "edge_type", "impact_kind")


@query(f"{_bfs_sql(SEEN, 'seen', SEED, 4)} {_IMPACT.format(kind=_KIND)}")
def impact_bfs(spark: SparkSession, sf: str) -> DataFrame:
    graph = _seen(spark, sf)
    return _impact_nodes(impact_events(graph.nodes, graph.relations, SEED, 4, 1_000_000))


@query(f"{_bfs_sql(SEEN, 'seen', SEED, 4, chr(65) + 'ND n.domain = ' + repr('code'))} {_IMPACT.format(kind=_KIND)}")
def impact_bfs_domain(spark: SparkSession, sf: str) -> DataFrame:
    graph = _seen(spark, sf)
    return _impact_nodes(impact_events(graph.nodes, graph.relations, SEED, 4, 1_000_000, domain="code"))


@query(f"{_bfs_sql(CODE, 'nodes', HUB, 3)} {_IMPACT.format(kind=_KIND)}")
def impact_bfs_code(spark: SparkSession, sf: str) -> DataFrame:
    graph = code_graph(spark, sf)
    return _impact_nodes(impact_events(graph.nodes, graph.relations, HUB, 3, 1_000_000))


@query(f"{_bfs_sql(SEEN, 'seen', SEED, 4)}, c AS (SELECT *, row_number() OVER (ORDER BY hop, id) AS place FROM bfs) SELECT id AS node_id, domain, CAST(hop AS INTEGER) AS hop, edge_type, {_KIND} AS impact_kind FROM c WHERE place <= 60")
def impact_capped(spark: SparkSession, sf: str) -> DataFrame:
    graph = _seen(spark, sf)
    return _impact_nodes(impact_events(graph.nodes, graph.relations, SEED, 4, 60))


@query(f"""{_bfs_sql(SEEN, 'seen', SEED, 4)}, per AS (SELECT d.hop, count(b.id) AS c FROM range(1, 5) d(hop) LEFT JOIN bfs b ON b.hop = d.hop GROUP BY ALL),
 run AS (SELECT hop, c, sum(c) OVER (ORDER BY hop) AS total, coalesce(lag(c) OVER (ORDER BY hop), 1) AS before FROM per), cut AS (SELECT *, total - c AS had FROM run)
 SELECT CAST(hop AS INTEGER) AS hop, CAST(least(total, 60) AS INTEGER) AS nodes_explored, CAST(least(c, 60 - had) AS INTEGER) AS frontier_size, total > 60 AS truncated FROM cut WHERE had <= 60 AND before > 0""")
def impact_progress(spark: SparkSession, sf: str) -> DataFrame:
    graph = _seen(spark, sf)
    return impact_events(graph.nodes, graph.relations, SEED, 4, 60).where("event_kind = 'progress'").select("hop", "nodes_explored", "frontier_size", "truncated")


def _neighbor_sql(step: str, depth: int) -> str:
    return f"""WITH RECURSIVE {CODE}, start AS (SELECT * FROM nodes), st AS ({step}), {walk(repr(HUB), depth, 'SELECT here, there FROM st')}, m AS (SELECT id, min(hop) AS hop FROM walk GROUP BY id),
 l AS (SELECT st.there AS id, b.hop, string_agg(DISTINCT st.rel_type, ',' ORDER BY st.rel_type) AS traversed_types FROM st JOIN m a ON a.id = st.here JOIN m b ON b.id = st.there AND b.hop = a.hop + 1 GROUP BY ALL)
 SELECT n.id, n.domain, n.name, CAST(l.hop AS INTEGER) AS hop, l.traversed_types FROM l JOIN nodes n USING (id)"""


_FWD, _REV = "SELECT from_id AS here, to_id AS there, rel_type FROM e", "SELECT to_id AS here, from_id AS there, rel_type FROM e"


@query(_neighbor_sql(_FWD, 2))
def neighbors_forward(spark: SparkSession, sf: str) -> DataFrame:
    graph = code_graph(spark, sf)
    return neighbors(graph.nodes, graph.relations, HUB, None, "forward", 2, None)


@query(_neighbor_sql(_REV + " WHERE rel_type IN ('CALLS', 'IMPORTS')", 2))
def neighbors_reverse(spark: SparkSession, sf: str) -> DataFrame:
    graph = code_graph(spark, sf)
    return neighbors(graph.nodes, graph.relations, HUB, ["CALLS", "IMPORTS"], "reverse", 2, None)


@query(_neighbor_sql(f"{_FWD} UNION ALL {_REV}", 1))
def neighbors_both(spark: SparkSession, sf: str) -> DataFrame:
    graph = code_graph(spark, sf)
    return neighbors(graph.nodes, graph.relations, HUB, None, "both", 1, None)


def _claims(spark: SparkSession, sf: str) -> DataFrame:
    """Claims that a customer reaches a nation by two relations of one type; true for some."""
    c = read(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("claim_id"), F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("source_id"), F.concat(F.lit("n:"), ((F.col("c_custkey") * 7 + F.col("c_nationkey") * F.when(F.col("c_custkey") % 2 == 0, 1).otherwise(0)) % 25).cast("string")).alias("target_id"), F.lit("OVERRIDES").alias("edge_type"), F.lit(3).alias("depth"))


@query(f"""WITH {STAR}, claims AS (SELECT c_custkey AS claim_id, 'c:' || c_custkey AS source_id, 'n:' || ((c_custkey * 7 + CASE WHEN c_custkey % 2 = 0 THEN c_nationkey ELSE 0 END) % 25) AS target_id FROM customer)
 SELECT claim_id, source_id, target_id, EXISTS (SELECT 1 FROM rel WHERE rel_type = 'OVERRIDES' AND from_id = source_id AND to_id = target_id) AS holds FROM claims""")
def relation_claims(spark: SparkSession, sf: str) -> DataFrame:
    graph = star_graph(spark, sf)
    return relations_exist(graph.nodes, graph.relations, _claims(spark, sf)).select("claim_id", "source_id", "target_id", "holds")


@query(f"""WITH RECURSIVE {CODE}, nxt AS (SELECT from_id AS a, rel_type AS t, min(to_id) AS b FROM rel GROUP BY ALL),
 claims AS (SELECT r.id AS claim_id, r.from_id AS source_id, coalesce(y.b, x.b, r.to_id) AS target_id, r.rel_type AS edge_type, 1 + ascii(r.id) % 4 AS depth FROM rel r LEFT JOIN nxt x ON x.a = r.to_id AND x.t = r.rel_type LEFT JOIN nxt y ON y.a = x.b AND y.t = r.rel_type),
 walk(claim_id, id, hop) AS (SELECT claim_id, source_id, 0 FROM claims WHERE source_id IN (SELECT id FROM nodes) UNION SELECT claim_id, e.to_id, hop + 1 FROM walk JOIN claims USING (claim_id) JOIN e ON e.from_id = walk.id AND e.rel_type = edge_type WHERE hop < depth)
 SELECT claim_id, CAST(depth AS INTEGER) AS depth, EXISTS (SELECT 1 FROM walk w WHERE w.claim_id = c.claim_id AND w.id = c.target_id AND hop > 0) AS holds FROM claims c""")
def relation_claims_deep(spark: SparkSession, sf: str) -> DataFrame:
    """Claims that a relation's start reaches what lies up to two steps beyond its end, within one to four steps."""
    graph = code_graph(spark, sf)
    r = graph.relations.select(F.col("id").alias("claim_id"), F.col("from_id").alias("source_id"), "to_id", F.col("rel_type").alias("edge_type"))
    after = graph.relations.groupBy("from_id", "rel_type").agg(F.min("to_id").alias("b"))
    one = after.select(F.col("from_id").alias("to_id"), F.col("rel_type").alias("edge_type"), F.col("b").alias("x"))
    two = after.select(F.col("from_id").alias("x"), F.col("rel_type").alias("edge_type"), F.col("b").alias("y"))
    claims = r.join(one, ["to_id", "edge_type"], "left").join(two, ["x", "edge_type"], "left").select("claim_id", "source_id", F.coalesce("y", "x", "to_id").alias("target_id"), "edge_type", (F.ascii("claim_id") % 4 + 1).alias("depth"))
    return relations_exist(graph.nodes, graph.relations, claims).select("claim_id", "depth", "holds")


# --- measures -----------------------------------------------------------------------------------------------------


def _code_impact_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Reversed edges of the subgraph of what depends on the hub within two hops, the hub included."""
    graph = code_graph(spark, sf)
    members = reach_members(graph, 2)
    return directed_edges(graph.relations, members, TRAVERSED, "reverse").select(F.col("here").alias("src"), F.col("there").alias("dst"))


def reach_members(graph: Graph, depth: int) -> DataFrame:
    found = None
    for level, _ in impact_levels(graph.nodes, graph.relations, HUB, depth, 1_000_000):
        ids = level.select(F.col("node_id").alias("id"))
        found = ids if found is None else found.unionByName(ids)
    start = graph.nodes.where(F.col("id") == HUB).select("id")
    return start if found is None else start.unionByName(found)


def _ppr_sql(depth: int = 2) -> str:
    rounds = []
    for i in range(1, algos.ROUNDS + 1):
        rounds.append(f"p{i} AS MATERIALIZED (SELECT id, CASE WHEN id = '{HUB}' THEN 0.15::DOUBLE ELSE 0 END + coalesce(s, 0) AS score FROM members LEFT JOIN (SELECT dst, sum(0.85::DOUBLE * score / degree) AS s FROM p{i - 1} JOIN step ON src = p{i - 1}.id GROUP BY dst) a ON dst = id)")
    return f"""{_bfs_sql(CODE, 'nodes', HUB, depth)}, ids AS (SELECT '{HUB}' AS id UNION SELECT id FROM bfs), rev AS MATERIALIZED (SELECT to_id AS src, from_id AS dst FROM e WHERE rel_type IN ({TYPES}) AND to_id IN (SELECT id FROM ids) AND from_id IN (SELECT id FROM ids)),
 members AS MATERIALIZED (SELECT src AS id FROM rev UNION SELECT dst FROM rev UNION SELECT '{HUB}'), step AS MATERIALIZED (SELECT src, dst, count(*) OVER (PARTITION BY src) AS degree FROM rev), p0 AS (SELECT id, CASE WHEN id = '{HUB}' THEN 0.15::DOUBLE ELSE 0 END AS score FROM members), {', '.join(rounds)}"""


@query(f"{_ppr_sql()} SELECT id, round(score, 9) AS score FROM p{algos.ROUNDS}")
def ppr(spark: SparkSession, sf: str) -> DataFrame:
    return algos.personalised_pagerank(_code_impact_edges(spark, sf), HUB).select("id", F.round("score", 9).alias("score"))


@query(f"""{_ppr_sql()}, x AS (SELECT min(score) AS a, max(score) AS b FROM p{algos.ROUNDS}) SELECT bfs.id AS node_id, CAST(hop AS INTEGER) AS hop, edge_type, round(coalesce((score - a) / (b - a), 0), 8) AS ppr_norm,
 round(0.5 * coalesce((score - a) / (b - a), 0) + 0.3::DOUBLE / hop, 8) AS impact_score, {_KIND} AS impact_kind FROM bfs LEFT JOIN p{algos.ROUNDS} p ON p.id = bfs.id, x""")
def impact_score(spark: SparkSession, sf: str) -> DataFrame:
    """The part of the impact score that SQL can give: proximity and PageRank. impact_score_full has all of it."""
    edges = _code_impact_edges(spark, sf)
    none = edges.select(F.col("src").alias("id"), F.lit(0.0).alias("score")).distinct()
    return _impact_scores(spark, sf, edges, none).drop("betweenness_norm")


#: Shortest paths between all members by rising length, at most 12, and what passes through each node.
_BETWEEN = f"""n AS MATERIALIZED (SELECT DISTINCT src, dst FROM rev WHERE src <> dst), d0 AS (SELECT id AS s, id AS v, 0 AS d, 1::DOUBLE AS k FROM members),
 {', '.join(f"d{i} AS MATERIALIZED (SELECT * FROM d{i - 1} UNION ALL SELECT s, dst, {i}, sum(k) FROM d{i - 1} JOIN n ON src = v WHERE d = {i - 1} AND NOT EXISTS (SELECT 1 FROM d{i - 1} o WHERE o.s = d{i - 1}.s AND o.v = dst) GROUP BY s, dst)" for i in range(1, 13))},
 b AS (SELECT x.v AS id, sum(x.k * y.k / z.k) AS score FROM d12 x JOIN d12 y ON y.s = x.v JOIN d12 z ON z.s = x.s AND z.v = y.v WHERE x.d > 0 AND y.d > 0 AND z.d = x.d + y.d GROUP BY x.v)"""


@query(f"""{_ppr_sql()}, {_BETWEEN}, x AS (SELECT min(score) AS a, max(score) AS b FROM p{algos.ROUNDS}), bt AS (SELECT id, coalesce(score, 0) AS score FROM members LEFT JOIN b USING (id)), y AS (SELECT min(score) AS a, max(score) AS b FROM bt),
 t AS (SELECT bfs.id AS node_id, hop, edge_type, coalesce((p.score - x.a) / nullif(x.b - x.a, 0), 0) AS pn, coalesce((bt.score - y.a) / nullif(y.b - y.a, 0), 0) AS bn FROM bfs LEFT JOIN p{algos.ROUNDS} p ON p.id = bfs.id LEFT JOIN bt ON bt.id = bfs.id, x, y)
 SELECT node_id, CAST(hop AS INTEGER) AS hop, edge_type, round(pn, 8) AS ppr_norm, round(bn, 8) AS betweenness_norm, round(0.5 * pn + 0.3::DOUBLE / hop + 0.2 * bn, 8) AS impact_score, {_KIND} AS impact_kind FROM t""")
def impact_score_full(spark: SparkSession, sf: str) -> DataFrame:
    """The whole impact score: proximity, PageRank and exact betweenness."""
    edges = cut(_code_impact_edges(spark, sf))
    return _impact_scores(spark, sf, edges, algos.betweenness(edges))


def _impact_scores(spark: SparkSession, sf: str, edges: DataFrame, between: DataFrame) -> DataFrame:
    graph = code_graph(spark, sf)
    levels = impact_events(graph.nodes, graph.relations, HUB, 2, 1_000_000).where("event_kind = 'node'").select("node_id", "hop", "edge_type")
    scores = algos.impact_scores(levels, algos.personalised_pagerank(edges, HUB), between, HUB)
    return scores.select("node_id", "hop", "edge_type", *(F.round(c, 8).alias(c) for c in ("ppr_norm", "betweenness_norm", "impact_score")), impact_kind(F.col("edge_type")).alias("impact_kind"))


@query(f"{_ppr_sql().split(', p0 AS (')[0]}, {_BETWEEN} SELECT id, round(coalesce(score, 0), 6) AS score FROM members LEFT JOIN b USING (id)")
def betweenness_scores(spark: SparkSession, sf: str) -> DataFrame:
    return algos.betweenness(_code_impact_edges(spark, sf)).select("id", F.round("score", 6).alias("score"))


@query(f"{_ppr_sql().split(', p0 AS (')[0]} SELECT (SELECT count(*) FROM members) AS n_nodes, (SELECT count(*) FROM rev) AS n_edges, TRUE AS fits")
def graph_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return algos.estimate(_code_impact_edges(spark, sf)).select("n_nodes", "n_edges", "fits")


@query()
def community_labels(spark: SparkSession, sf: str) -> DataFrame:
    return algos.communities(_code_impact_edges(spark, sf))


@query("SELECT rel_type, count(*) AS n, count(DISTINCT from_id) AS n_from, CAST(sum(weight) AS BIGINT) AS weight FROM code_relation GROUP BY rel_type HAVING count(*) > 1")
def relation_counts(spark: SparkSession, sf: str) -> DataFrame:
    r = read(spark, sf, "code_relation")
    return r.groupBy("rel_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("from_id").alias("n_from"), F.sum("weight").alias("weight")).where("n > 1")


# --- retrieval ----------------------------------------------------------------------------------------------------

_POINTS = "points AS (SELECT vec_id AS point_id, 'p:' || (vec_id % (SELECT count(*) FROM part) + 1) AS node_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_VECTOR = f"""{_POINTS}, qv AS (SELECT v FROM points WHERE point_id = {QUERY_VECTOR}),
 vec AS (SELECT node_id, s.domain, point_id, list_cosine_similarity(points.v, qv.v) AS vector_score FROM points JOIN seen s ON s.id = node_id, qv WHERE s.domain = 'code' ORDER BY vector_score DESC, point_id LIMIT 50),
 vleg AS (SELECT *, row_number() OVER (ORDER BY vector_score DESC, point_id) AS vector_rank FROM vec)"""


def _vector_of(spark: SparkSession, sf: str) -> list[float]:
    return list(retrieve.by_ids(read(spark, sf, "embeddings"), "vec_id", [QUERY_VECTOR]).first()["embedding"])


@query("SELECT id, model_id, len(vector) AS dim FROM (SELECT id, any_value(model_id) AS model_id, any_value(vector) AS vector FROM code_embedding GROUP BY id) WHERE id IN (SELECT min(id) FROM code_embedding GROUP BY model_id) AND id IS NOT NULL")
def points_by_id(spark: SparkSession, sf: str) -> DataFrame:
    """The first point of each model, looked up by id."""
    points = read(spark, sf, "code_embedding").select("id", "model_id", "vector")
    wanted = points.groupBy("model_id").agg(F.min("id").alias("id")).select("id")
    return retrieve.by_ids(points, "id", wanted).select("id", "model_id", F.size("vector").alias("dim"))


def _points(spark: SparkSession, sf: str) -> DataFrame:
    return scoped(star_points(spark, sf), SCOPE)


@query(f"WITH {SEEN}, {_VECTOR} SELECT node_id, domain, point_id, round(vector_score, 9) AS vector_score, CAST(vector_rank AS INTEGER) AS vector_rank FROM vleg")
def knn_topk(spark: SparkSession, sf: str) -> DataFrame:
    top = retrieve.vector_search(_points(spark, sf), _vector_of(spark, sf), "code")
    return top.withColumn("vector_score", F.round("vector_score", 9))


@query("""WITH v AS (SELECT model_id, id, any_value(CAST(vector AS DOUBLE[])) AS x FROM code_embedding WHERE len(vector) = 64 AND len(list_filter(vector, lambda e: NOT isfinite(e))) = 0 AND len(list_filter(vector, lambda e: e <> 0)) > 0 GROUP BY ALL),
 q AS (SELECT model_id, min(id) AS id FROM v GROUP BY model_id), s AS (SELECT v.model_id, v.id, round(list_cosine_similarity(v.x, w.x), 9) AS score FROM v JOIN q USING (model_id) JOIN v w ON w.model_id = q.model_id AND w.id = q.id),
 r AS (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY score DESC, id) AS rank FROM s) SELECT model_id, id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 20""")
def knn_by_model(spark: SparkSession, sf: str) -> DataFrame:
    """Of each model, the 20 vectors most similar to its first."""
    from pyspark.sql import Window

    usable = F.coalesce((F.size("vector") == 64) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vector", lambda x: x != 0), F.lit(False))
    v = read(spark, sf, "code_embedding").where(usable).select("model_id", "id", "vector").dropDuplicates(["model_id", "id"])
    first = v.groupBy("model_id").agg(F.min_by("vector", "id").alias("q"))
    scored = v.join(F.broadcast(first), "model_id").select("model_id", "id", F.round(cosine(F.col("vector"), F.col("q")), 9).alias("score"))
    place = F.row_number().over(Window.partitionBy("model_id").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", place).where("rank <= 20")


_GRAPH_LEG = ORACLES["reach_reverse_scoped"].split("WITH RECURSIVE ", 1)[1].split(", t AS (", 1)[0].replace("walk.hop < 4", "walk.hop < 3")
_FUSED = f"""WITH RECURSIVE {_GRAPH_LEG}, t AS (SELECT s.id, s.domain, s.name, hop FROM m JOIN seen s USING (id) WHERE s.domain = 'code' ORDER BY hop, s.id LIMIT 200), gleg AS (SELECT *, row_number() OVER (ORDER BY hop, id) AS graph_rank FROM t), {_VECTOR},
 both_legs AS (SELECT id AS node_id, domain, name, hop::DOUBLE AS hop, 0 AS leg, graph_rank AS rank, NULL::DOUBLE AS vector_score FROM gleg UNION ALL SELECT node_id, domain, NULL, NULL, 1, vector_rank, vector_score FROM vleg),
 fused AS (SELECT node_id, any_value(domain) AS domain, min(hop) AS hop, max(vector_score) AS vector_score, min(rank) FILTER (leg = 0) AS graph_rank, min(rank) FILTER (leg = 1) AS vector_rank, sum(1.0::DOUBLE / (60 + rank)) AS rrf_score FROM both_legs GROUP BY node_id),
 boosted AS (SELECT f.*, rrf_score + coalesce(0.15::DOUBLE / (1 + hop), 0) AS combined_score FROM fused f JOIN seen ON seen.id = f.node_id)"""


@query(f"{_FUSED} SELECT node_id, domain, hop, round(vector_score, 9) AS vector_score, CAST(graph_rank AS INTEGER) AS graph_rank, CAST(vector_rank AS INTEGER) AS vector_rank, round(rrf_score, 9) AS rrf_score FROM fused")
def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    graph = _seen(spark, sf)
    leg = reach_reverse(graph.nodes, graph.relations, SEED, 3, "code").withColumnRenamed("id", "node_id")
    fused = retrieve.rrf_fuse(leg, retrieve.vector_search(_points(spark, sf), _vector_of(spark, sf), "code"))
    return fused.select("node_id", "domain", "hop", F.round("vector_score", 9).alias("vector_score"), "graph_rank", "vector_rank", F.round("rrf_score", 9).alias("rrf_score"))


@query(f"""{_FUSED}, top AS (SELECT *, row_number() OVER (ORDER BY combined_score DESC, node_id) AS rank FROM boosted)
 SELECT node_id, nodes.name, top.domain, hop, CAST(graph_rank AS INTEGER) AS graph_rank, CAST(vector_rank AS INTEGER) AS vector_rank, round(combined_score, 9) AS combined_score, CAST(rank AS INTEGER) AS rank FROM top JOIN nodes ON nodes.id = node_id WHERE rank <= 25""")
def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    graph = _seen(spark, sf)
    found = retrieve.hybrid_search(graph.nodes, graph.relations, _points(spark, sf), _vector_of(spark, sf), SEED)
    return found.select("node_id", "name", "domain", "hop", "graph_rank", "vector_rank", F.round("combined_score", 9).alias("combined_score"), "rank")


@query(f"{_FUSED}, top AS (SELECT * FROM boosted ORDER BY combined_score DESC, node_id LIMIT 25) SELECT count(graph_rank) AS n_graph, count(vector_rank) AS n_vector, count(*) AS n_results, count(vector_rank) = 0 AS vector_leg_degraded FROM top")
def hybrid_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    graph = _seen(spark, sf)
    return retrieve.diagnostics(retrieve.hybrid_search(graph.nodes, graph.relations, _points(spark, sf), _vector_of(spark, sf), SEED))


_RERANK = f"""{_FUSED}, top AS (SELECT * FROM boosted ORDER BY combined_score DESC, node_id LIMIT 25), imp AS (SELECT id AS node_id, (length(name) % 10) / 10.0::DOUBLE AS impact FROM seen WHERE length(name) % 3 <> 0),
 sc AS (SELECT top.*, coalesce(impact, 0) AS impact_norm, ('0x' || substring(sha256('who calls'::BLOB || '\\x00'::BLOB || node_id::BLOB), 1, 8))::BIGINT / 4294967295.0::DOUBLE AS rerank_score FROM top LEFT JOIN imp USING (node_id)),
 fin AS (SELECT *, rerank_score + 0.15::DOUBLE * (coalesce(0.5::DOUBLE / (1 + hop), 0) + 0.5::DOUBLE * impact_norm) AS final_score FROM sc), ranked AS (SELECT *, row_number() OVER (ORDER BY final_score DESC, node_id) AS rank FROM fin)"""


def _reranked(spark: SparkSession, sf: str, top_k: int = 10) -> DataFrame:
    graph = _seen(spark, sf)
    found = retrieve.hybrid_search(graph.nodes, graph.relations, _points(spark, sf), _vector_of(spark, sf), SEED).drop("rank")
    found = cut(found)
    where = ["tenant_id", "repo", "acl_group"]
    partitions = graph.nodes.select(*where).distinct().withColumn("generation", F.lit(3))
    stale = F.length("name") % 3 == 0  # these were written under an older generation
    scores = graph.nodes.select(F.col("id").alias("node_id"), *where, F.when(stale, 2).otherwise(3).alias("generation"), ((F.length("name") % 10) / 10.0).alias("impact_score"))
    return retrieve.rerank("who calls", found, retrieve.current_impact(graph.nodes, scores, partitions, found), top_k)


@query(f"{_RERANK} SELECT node_id, round(rerank_score, 9) AS rerank_score, impact_norm, round(final_score, 9) AS final_score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 10")
def reranked(spark: SparkSession, sf: str) -> DataFrame:
    return _reranked(spark, sf).select("node_id", F.round("rerank_score", 9).alias("rerank_score"), "impact_norm", F.round("final_score", 9).alias("final_score"), "rank")


@query("""WITH c AS (SELECT entity_id, chunk_index, max(text) AS text FROM code_chunk WHERE text IS NOT NULL GROUP BY ALL) SELECT entity_id, string_agg(text, chr(10) ORDER BY chunk_index) AS source_text FROM c WHERE entity_id IN (SELECT id FROM code_node) GROUP BY entity_id""")
def hydrate_text(spark: SparkSession, sf: str) -> DataFrame:
    wanted = code_nodes(spark, sf).select(F.col("id").alias("entity_id"))
    return retrieve.source_texts(read(spark, sf, "code_chunk"), wanted)


@query("""WITH c AS (SELECT entity_id, chunk_index, max(text) AS text FROM code_chunk WHERE text IS NOT NULL GROUP BY ALL), w AS (SELECT DISTINCT from_id AS id FROM code_relation WHERE rel_type = 'EXTENDS')
 SELECT entity_id, string_agg(text, chr(10) ORDER BY chunk_index) AS source_text FROM c WHERE entity_id IN (SELECT id FROM w) GROUP BY entity_id""")
def texts_by_id(spark: SparkSession, sf: str) -> DataFrame:
    """The texts of the entities that extend another, looked up by id."""
    wanted = read(spark, sf, "code_relation").where("rel_type = 'EXTENDS'").select(F.col("from_id").alias("entity_id"))
    return retrieve.source_texts(read(spark, sf, "code_chunk"), wanted)


_TERMS = "list_filter(regexp_split_to_array(lower(coalesce(name, '') || coalesce(' ' || source_text, '')), '[^\\p{L}\\p{Nd}]+'), lambda w: w <> '')"


@query(f"""WITH c AS (SELECT entity_id, chunk_index, max(text) AS text FROM code_chunk WHERE text IS NOT NULL GROUP BY ALL), s AS (SELECT entity_id, string_agg(text, ' ' ORDER BY chunk_index) AS source_text FROM c GROUP BY entity_id),
 n AS (SELECT id, any_value(domain) AS domain, any_value(name) AS name FROM code_node WHERE node_type IN ('Method', 'Function', 'Class', 'File') GROUP BY id),
 d AS (SELECT id, domain, name, {_TERMS} AS w FROM n LEFT JOIN s ON entity_id = id),
 f AS (SELECT id, domain, name, len(w) AS l, len(list_filter(w, lambda x: x = 'append')) AS t0, len(list_filter(w, lambda x: x = 'context')) AS t1, len(list_filter(w, lambda x: x = 'return')) AS t2 FROM d),
 st AS (SELECT count(*) AS n, avg(l) AS a, count(*) FILTER (t0 > 0) AS d0, count(*) FILTER (t1 > 0) AS d1, count(*) FILTER (t2 > 0) AS d2 FROM f),
 sc AS (SELECT id, domain, name, {' + '.join(f'ln(1 + (n - d{i} + 0.5::DOUBLE) / (d{i} + 0.5::DOUBLE)) * t{i} * 2.2::DOUBLE / (t{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / a))' for i in range(3))} AS score FROM f, st WHERE t0 + t1 + t2 > 0)
 SELECT id, domain, name, round(score, 8) AS score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS text_rank FROM sc ORDER BY score DESC, id LIMIT 25""")
def fulltext_topk(spark: SparkSession, sf: str) -> DataFrame:
    found = retrieve.fulltext_search(code_nodes(spark, sf), "append context return?", chunks=read(spark, sf, "code_chunk"))
    return found.withColumn("score", F.round("score", 8))


@query(ORACLES["fulltext_topk"].replace("FROM f)", "FROM g)").replace("FROM f, st", "FROM g, st").replace(" st AS (", " g AS (SELECT * FROM f WHERE id IN (SELECT to_id FROM code_relation WHERE rel_type = 'CALLS')), st AS ("))
def fulltext_among(spark: SparkSession, sf: str) -> DataFrame:
    """Full-text search among the entities that are called."""
    called = read(spark, sf, "code_relation").where("rel_type = 'CALLS'").select(F.col("to_id").alias("id"))
    nodes = retrieve.by_ids(code_nodes(spark, sf), "id", called)
    return retrieve.fulltext_search(nodes, "append context return?", chunks=read(spark, sf, "code_chunk")).withColumn("score", F.round("score", 8))


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    """Of each part type three questions about its last word: who calls it, how it works, and the word itself."""
    word = F.lower(F.substring_index("p_type", " ", -1))
    forms = F.array(F.concat(F.lit("who calls "), word, F.lit("?")), F.concat(F.lit("how does "), word, F.lit(" work")), word)
    words = read(spark, sf, "part").select(word.alias("word"), forms.alias("forms")).distinct()
    return words.select("word", F.posexplode("forms").alias("form", "query")).select(F.concat_ws("/", "word", F.col("form").cast("string")).alias("query_id"), "query")


@query()
def explored_questions(spark: SparkSession, sf: str) -> DataFrame:
    """How far questions about parts get in the scoped star graph, within eight steps."""
    graph = _seen(spark, sf)
    types = read(spark, sf, "part").select(key_id("p", "p_partkey").alias("id"), F.col("p_type").alias("signature"))
    nodes = graph.nodes.join(types, "id", "left")
    return explore(_questions(spark, sf), nodes, graph.relations, Limits(steps=8)).outcomes


# --- packing ------------------------------------------------------------------------------------------------------


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of the scoped graph as candidates of requests, one request per repository and group."""
    n = scoped(star_graph(spark, sf).nodes, SCOPE).where("node_type IN ('Function', 'Interface', 'Module')")
    number = F.substring_index("id", ":", -1).cast("bigint")
    return n.select(
        F.concat_ws("/", "repo", "acl_group").alias("query_id"), F.col("id").alias("node_id"), "name", F.when(number % 3 > 0, (number % 3 - 1).cast("int")).alias("hop"), ((number % 10) / 10.0).alias("impact_norm"),
        ((number * 37 % 101) / 101.0).alias("final_score"), number.alias("input_pos"), F.concat(F.repeat(F.lit("line of text\n"), (number % 40).cast("int")), F.col("name")).alias("source_text"), citation(F.col("repo"), F.col("path"), F.col("start_line"), F.col("end_line"), F.col("commit_sha")).alias("citation"),
    )


_CANDIDATES = f"""WITH {STAR}, b AS (SELECT *, CAST(split_part(id, ':', 2) AS BIGINT) AS k FROM nodes WHERE {SCOPED} AND node_type IN ('Function', 'Interface', 'Module')),
 cand AS (SELECT repo || '/' || acl_group AS query_id, id AS node_id, name, CASE WHEN k % 3 > 0 THEN k % 3 - 1 END AS hop, (k % 10) / 10.0::DOUBLE AS impact_norm, (k * 37 % 101) / 101.0::DOUBLE AS final_score, k AS input_pos, repeat('line of text' || chr(10), k % 40) || name AS source_text,
  CASE WHEN commit_sha IS NOT NULL THEN repo || '/' || path || ':' || start_line || '-' || end_line || '@' || commit_sha ELSE 'provenance non disponibile' END AS citation FROM b),
 pos AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, input_pos, node_id) - 1 AS i, count(*) OVER (PARTITION BY query_id) AS n FROM cand),
 u AS (SELECT *, CASE WHEN i % 2 = 0 THEN i // 2 ELSE n - 1 - (i - 1) // 2 END AS u_pos FROM pos)"""


@query(f"{_CANDIDATES} SELECT query_id, node_id, CAST(i AS INTEGER) AS score_pos, CAST(u_pos AS INTEGER) AS u_pos FROM u")
def u_order(spark: SparkSession, sf: str) -> DataFrame:
    return deduplicated(_candidates(spark, sf)).select("query_id", "node_id", "score_pos", "u_pos")


def _pack_sql(section: str, text: str, quota: int, first: str, source: str = "u") -> str:
    return f"""{_CANDIDATES}, el AS ({source}), f AS (SELECT query_id, node_id, i, u_pos, {text} AS text, citation FROM el), tk AS (SELECT *, strlen(text) // 4 + strlen(citation) // 4 AS tokens FROM f),
 us AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY i) AS used FROM tk) SELECT query_id, '{section}' AS section, CAST(row_number() OVER (PARTITION BY query_id ORDER BY u_pos) - 1 AS INTEGER) AS pos, node_id, text, citation, CAST(tokens AS INTEGER) AS tokens FROM us WHERE used <= {quota} {first}"""


@query(_pack_sql("definitions", "CASE WHEN split_part(source_text, chr(10), 1) = '' THEN name ELSE name || ': ' || split_part(source_text, chr(10), 1) END", 3200, "OR i = 0", "SELECT * FROM u"))
def pack_definitions(spark: SparkSession, sf: str) -> DataFrame:
    return pack(_candidates(spark, sf)).where("section = 'definitions'")


@query(_pack_sql("relations", "CASE WHEN hop IS NULL THEN name ELSE name || ' (hop ' || hop || ')' END", 1600, "", "SELECT * FROM u"))
def pack_relations(spark: SparkSession, sf: str) -> DataFrame:
    return pack(_candidates(spark, sf)).where("section = 'relations'")


@query(_pack_sql("full_source", "source_text", 1600, "", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY i) AS x FROM u WHERE hop = 0 OR impact_norm > 0.5) WHERE x <= 4"))
def pack_source(spark: SparkSession, sf: str) -> DataFrame:
    return pack(_candidates(spark, sf)).where("section = 'full_source'")


@query("SELECT doc_id, CAST(strlen(text) // 4 AS INTEGER) AS floor_tokens, CAST((strlen(text) + 3) // 4 AS INTEGER) AS ceil_tokens FROM documents WHERE text IS NOT NULL")
def token_estimates(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents").where("text IS NOT NULL")
    return d.select("doc_id", byte_tokens(F.col("text")).alias("floor_tokens"), F.floor((F.octet_length("text") + 3) / 4).cast("int").alias("ceil_tokens"))
