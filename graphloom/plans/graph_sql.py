"""SQL of the two graphs, the common head of the queries that check graph operators."""

from __future__ import annotations

from graphloom.schema import TRAVERSED


def _star_node(prefix: str, table: str, key: str, name: str, kind: str) -> str:
    return f"""SELECT '{prefix}:' || {key} AS id, CASE WHEN {key} % 7 = 0 THEN 'doc' ELSE 'code' END AS domain, '{kind}' AS node_type, {name} AS name,
 sha256('{kind}' || {name}) AS ast_hash, CASE WHEN {key} % 10 = 9 THEN 't1' ELSE 't0' END AS tenant_id, 'repo' || ({key} % 4) AS repo, 'g' || ({key} % 3) AS acl_group,
 'src/{prefix}/' || ({key} % 50) || '.go' AS path, CASE WHEN {key} % 5 <> 0 THEN 'c' || ({key} % 11) END AS commit_sha, CAST({key} % 100 + 1 AS INTEGER) AS start_line, CAST({key} % 100 + 20 AS INTEGER) AS end_line FROM {table}"""


STAR = f"""nodes AS ({' UNION ALL '.join(_star_node(*x) for x in (('r', 'region', 'r_regionkey', 'r_name', 'Package'), ('n', 'nation', 'n_nationkey', 'n_name', 'Module'), ('s', 'supplier', 's_suppkey', 's_name', 'Interface'), ('p', 'part', 'p_partkey', 'p_name', 'Function'), ('o', 'orders', 'o_orderkey', 'o_orderpriority', 'Method'), ('c', 'customer', 'c_custkey', 'c_name', 'Class')))}),
rel AS (SELECT 'o:' || l_orderkey AS from_id, 'p:' || l_partkey AS to_id, 'CALLS' AS rel_type, count(*) AS weight FROM lineitem GROUP BY ALL
 UNION ALL SELECT DISTINCT 'p:' || l_partkey, 's:' || l_suppkey, 'DEPENDS_ON', 1 FROM lineitem
 UNION ALL SELECT 'c:' || o_custkey, 'o:' || o_orderkey, t, 1 FROM orders, (VALUES ('IMPLEMENTS'), ('CONTAINS')) v(t)
 UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey, 'IMPORTS', 1 FROM supplier
 UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey, 'OVERRIDES', 1 FROM customer
 UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey, 'EXTENDS', 1 FROM nation)"""
SCOPED = "tenant_id = 't0' AND repo IN ('repo0', 'repo1', 'repo2') AND acl_group IN ('g0', 'g1')"
SEEN = f"{STAR}, seen AS (SELECT * FROM nodes WHERE {SCOPED}), e AS (SELECT rel.* FROM rel JOIN seen a ON a.id = from_id JOIN seen b ON b.id = to_id)"
CODE = """nodes AS (SELECT id, any_value(domain) AS domain, any_value(node_type) AS node_type, any_value(name) AS name, any_value(ast_hash) AS ast_hash, any_value(provenance.tenant_id) AS tenant_id, any_value(provenance.repo) AS repo,
 any_value(provenance.acl_group) AS acl_group, any_value(provenance.path) AS path FROM code_node WHERE id IS NOT NULL GROUP BY id),
 rel AS (SELECT id, any_value(from_id) AS from_id, any_value(to_id) AS to_id, any_value(rel_type) AS rel_type, any_value(CAST(weight AS BIGINT)) AS weight FROM code_relation WHERE from_id IS NOT NULL AND to_id IS NOT NULL GROUP BY id),
 e AS (SELECT rel.* FROM rel JOIN nodes a ON a.id = from_id JOIN nodes b ON b.id = to_id)"""
TYPES = ", ".join(f"'{t}'" for t in TRAVERSED)


def walk(entry: str, depth: int, step: str, where: str = "TRUE") -> str:
    """Recursive part walk(id, hop) along step, a table (here, there); UNION removes repeats, depth ends cycles."""
    return f"walk(id, hop) AS (SELECT id, 0 FROM start WHERE id = {entry} UNION SELECT s.there, walk.hop + 1 FROM walk JOIN ({step}) s ON s.here = walk.id WHERE walk.hop < {depth} AND {where})"
