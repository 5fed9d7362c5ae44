"""Row-level security: request scopes, their validation, and the predicate that every read takes."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.ids import list_fingerprint

MAX_BYTES, MAX_LIST = 256, 128
DATA_ACTIONS = ["hybrid_search", "get_node", "expand_neighbors", "impact_analysis", "cache_get", "cache_put"]
HEALTH_ACTIONS = ["health"]


def valid_value(value: str) -> bool:
    """Not empty, no white space around, at most 256 bytes, no control characters."""
    return bool(value) and value.strip() == value and len(value.encode("utf-8", "surrogatepass")) <= MAX_BYTES and not any(unicodedata.category(c) in ("Cc", "Cs") for c in value)


@dataclass(frozen=True)
class Scope:
    """Who asks, and for which tenant, repositories and access groups. Lists are deduplicated and sorted."""

    tenant_id: str
    user_id: str
    repos: tuple[str, ...] = field(default=())
    groups: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        for value in (self.tenant_id, self.user_id, *self.repos, *self.groups):
            if not valid_value(value):
                raise ValueError("invalid scope value")
        for name in ("repos", "groups"):
            values = tuple(sorted(set(getattr(self, name))))
            if not 1 <= len(values) <= MAX_LIST:
                raise ValueError(f"{name} must have 1 to {MAX_LIST} entries")
            object.__setattr__(self, name, values)

    def fingerprint(self, tag: str = "acl-scope-v1") -> str:
        """The partition of shared results; the user is left out on purpose."""
        return list_fingerprint(tag, self.tenant_id, [list(self.repos), list(self.groups)])


def predicate(scope: Scope, repo: str | None = None) -> Column:
    """The rows a scope may see. A requested repository narrows it; one outside the scope leaves no rows."""
    repos = list(scope.repos) if repo is None else [r for r in scope.repos if r == repo]
    if not repos:
        return F.lit(False)
    return (F.col("tenant_id") == scope.tenant_id) & F.col("repo").isin(repos) & F.col("acl_group").isin(list(scope.groups))


def scoped(df: DataFrame, scope: Scope, repo: str | None = None) -> DataFrame:
    """Rows of df within the scope; df has tenant_id, repo and acl_group, rows where one is null are never seen."""
    return df.where(predicate(scope, repo))


def scoped_relations(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Relations whose ends are both among nodes: the subgraph that a scope induces."""
    ids = nodes.select("id")
    return relations.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")


def label_outcome(*labels: Column) -> Column:
    """accepted, missing (a label is null or empty) or invalid (untrimmed, over 256 bytes or with control characters)."""
    missing, invalid = F.lit(False), F.lit(False)
    for x in labels:
        missing = missing | x.isNull() | (x == "")
        edge = x.rlike(r"^\p{IsWhite_Space}|\p{IsWhite_Space}$")
        invalid = invalid | edge | (F.octet_length(x) > MAX_BYTES) | x.rlike(r"\p{Cc}")
    return F.when(missing, "missing").when(invalid, "invalid").otherwise("accepted")


def policy_decision(tenant: Column, user: Column, action: Column, repos: Column, groups: Column) -> Column:
    """struct(allow, reason): the ordered decision table over request columns; repos and groups are string arrays."""
    blank = lambda x: F.coalesce(F.trim(F.regexp_replace(x, r"[\t\r\n]", " ")) == "", F.lit(True))
    listed = lambda xs: F.coalesce((F.size(xs) > 0) & F.forall(xs, lambda v: ~blank(v)), F.lit(False))
    say = lambda allow, reason: F.struct(F.lit(allow).alias("allow"), F.lit(reason).alias("reason"))
    return (
        F.when(blank(tenant), say(False, "missing_tenant"))
        .when(blank(user), say(False, "missing_user"))
        .when(~F.coalesce(action.isin(DATA_ACTIONS + HEALTH_ACTIONS), F.lit(False)), say(False, "unknown_action"))
        .when(action.isin(HEALTH_ACTIONS), say(True, "allow"))
        .when(~listed(repos), say(False, "empty_repo_scope"))
        .when(~listed(groups), say(False, "empty_acl_scope"))
        .otherwise(say(True, "allow"))
    )
