"""Differences between two copies of a dataset, key by key and field by field.

Rows of both copies are folded to variants (equal rows) with their multiplicity on either side; equal rows cancel by
multiplicity. What is left of a key is paired across the sides by minimum-cost assignment, a pair costing the number
of fields in which it differs. Folding happens before the shuffle, so a row repeated without end is one row there. The
leftover variants of one key are assigned in one task, in memory proportional to their number.
"""

from __future__ import annotations

from array import array
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Up to so many leftover variants of a key on either side are assigned over all pairs of them, more over the values they
#: share. Equal differences of a key are one entry per so many source variants, in field order.
BLOCK = 32


def variants(source: DataFrame, view: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Distinct rows of both sides with n_source and n_view, their multiplicities."""
    sides = source.select(*keys, *fields, F.lit(1).alias("__s"), F.lit(0).alias("__v")).unionByName(view.select(*keys, *fields, F.lit(0).alias("__s"), F.lit(1).alias("__v")))
    return sides.groupBy(*keys, *fields).agg(F.sum("__s").alias("n_source"), F.sum("__v").alias("n_view"))


def differences(source: DataFrame, view: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """keys, diff_field, source_value, view_value, n_rows: everything in which the copies differ.

    diff_field is missing_in_view or missing_in_source for a key that is on one side only; the name of each differing
    field for paired rows; extra_in_source or extra_in_view for leftovers without partner of a key that is on both
    sides (surplus copies of one value or further variants). Values compare exactly, null equals only null; a key with
    null parts is a key like any other. Values are given as strings. Columns other than keys and fields are ignored.
    Equal differences of a key are one entry with their number of rows, and one per BLOCK source variants beyond that.
    An empty side makes every key of the other one missing.
    """
    outer, names = keys, fields
    keys, fields = [f"k{i}" for i in range(len(outer))], [f"f{i}" for i in range(len(names))]
    own = lambda df: df.select(*(F.col(n).alias(a) for n, a in zip([*outer, *names], [*keys, *fields])))
    rows = variants(own(source), own(view), keys, fields).withColumn("net", F.col("n_source") - F.col("n_view"))
    values = F.struct(*(F.col(f).cast("string").alias(f) for f in fields))
    by_key = rows.groupBy(*keys).agg(
        (F.sum("n_source") > 0).alias("in_source"),
        (F.sum("n_view") > 0).alias("in_view"),
        F.count(F.when(F.col("net") > 0, 1)).alias("left_source"),
        F.count(F.when(F.col("net") < 0, 1)).alias("left_view"),
        F.sum(F.when(F.col("net") > 0, F.col("net")).otherwise(0)).alias("n_left_source"),
        F.sum(F.when(F.col("net") < 0, -F.col("net")).otherwise(0)).alias("n_left_view"),
        F.max(F.when(F.col("net") > 0, values)).alias("source_row"),
        F.max(F.when(F.col("net") < 0, values)).alias("view_row"),
    )
    both = F.col("in_source") & F.col("in_view")
    entry = lambda name, a, b, n: F.struct(F.lit(name).alias("diff_field"), a.cast("string").alias("source_value"), b.cast("string").alias("view_value"), n.cast("bigint").alias("n_rows"))
    none = F.lit(None)
    paired = F.least("n_left_source", "n_left_view")
    simple = F.when(both & (F.col("left_source") == 1) & (F.col("left_view") == 1), True)
    entries = F.array(
        F.when(~F.col("in_view"), entry("missing_in_view", none, none, F.col("n_left_source"))),
        F.when(~F.col("in_source"), entry("missing_in_source", none, none, F.col("n_left_view"))),
        *(F.when(simple & ~F.col("source_row")[f].eqNullSafe(F.col("view_row")[f]), entry(name, F.col("source_row")[f], F.col("view_row")[f], paired)) for f, name in zip(fields, names)),
        F.when(both & ((simple.isNotNull()) | (F.col("left_view") == 0)) & (F.col("n_left_source") > F.col("n_left_view")), entry("extra_in_source", none, none, F.col("n_left_source") - F.col("n_left_view"))),
        F.when(both & ((simple.isNotNull()) | (F.col("left_source") == 0)) & (F.col("n_left_view") > F.col("n_left_source")), entry("extra_in_view", none, none, F.col("n_left_view") - F.col("n_left_source"))),
    )
    plain = by_key.select(*keys, F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("e")).select(*keys, "e.*")

    several = by_key.where(both & (F.col("left_source") > 0) & (F.col("left_view") > 0) & (F.col("left_source") + F.col("left_view") > 2)).select(*(F.col(k).alias(f"o{k}") for k in keys))
    same = [F.col(k).eqNullSafe(F.col(f"o{k}")) for k in keys]
    left = rows.where(F.col("net") != 0).join(several, same, "inner").select(*keys, *(F.col(f).cast("string").alias(f) for f in fields), "net")
    found = plain.unionByName(_assign_several(left, keys, fields, names))
    return found.select(*(F.col(k).alias(n) for k, n in zip(keys, outer)), "diff_field", "source_value", "view_value", "n_rows")


def _assign_several(left: DataFrame, keys: list[str], fields: list[str], names: list[str]) -> DataFrame:
    """Keys with several leftover variants: minimum-cost assignment over all variants of the key."""
    types = dict(left.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "diff_field string", "source_value string", "view_value string", "n_rows bigint"])

    def assign(group):
        import pandas as pd

        # null is None here and equals itself, as == on tuples has it
        rows = group.astype(object).where(group.notna(), None)
        side = lambda part, sign: sorted(((tuple(r[f] for f in fields), sign * int(r["net"])) for r in part.to_dict("records")), key=lambda v: [(x is not None, x) for x in v[0]])
        source, view = side(rows[rows["net"] > 0], 1), side(rows[rows["net"] < 0], -1)
        block = {a: i // BLOCK for i, (a, _) in enumerate(source)}
        found: dict[tuple, int] = {}
        pairs, rest_source, rest_view = (minimum_cost_pairs if max(len(source), len(view)) <= BLOCK else minimum_cost_pairs_of_many)(source, view)
        for a, b, n in pairs:
            for f, x, y in zip(names, a, b):
                if x != y:
                    found[block[a], f, x, y] = found.get((block[a], f, x, y), 0) + n
        for name, n in (("extra_in_source", rest_source), ("extra_in_view", rest_view)):
            if n:
                found[0, name, None, None] = n
        head = [rows.iloc[0][k] for k in keys]
        return pd.DataFrame([[*head, f, x, y, n] for (_, f, x, y), n in found.items()], columns=[*keys, "diff_field", "source_value", "view_value", "n_rows"])

    return left.groupBy(*keys).applyInPandas(assign, schema)


def minimum_cost_pairs(source: list[tuple[tuple, int]], view: list[tuple[tuple, int]]) -> tuple[list[tuple[tuple, tuple, int]], int, int]:
    """Pairs (source row, view row, multiplicity) of least total difference, and what is left of either side.

    Successive shortest paths over the variants with their multiplicities as supply and demand.
    """
    n, m = len(source), len(view)
    supply, demand = [c for _, c in source], [c for _, c in view]
    cost = [[sum(x != y for x, y in zip(a, b)) for b, _ in view] for a, _ in source]
    flow = [[0] * m for _ in range(n)]
    while any(supply) and any(demand):
        far = float("inf")
        dist = [0 if supply[i] else far for i in range(n)] + [far] * m
        before: list[int | None] = [None] * (n + m)
        changed = True
        while changed:
            changed = False
            for i in range(n):
                for j in range(m):
                    if dist[i] + cost[i][j] < dist[n + j]:
                        dist[n + j], before[n + j], changed = dist[i] + cost[i][j], i, True
                    if flow[i][j] and dist[n + j] - cost[i][j] < dist[i]:
                        dist[i], before[i], changed = dist[n + j] - cost[i][j], n + j, True
        end = min((j for j in range(m) if demand[j]), key=lambda j: dist[n + j])
        path, at = [], n + end
        while before[at] is not None:
            path.append((before[at], at))
            at = before[at]
        amount = min([supply[at], demand[end], *(flow[b][a - n] for a, b in path if a >= n)])
        for a, b in path:
            if a < n:
                flow[a][b - n] += amount
            else:
                flow[b][a - n] -= amount
        supply[at] -= amount
        demand[end] -= amount
    pairs = [(source[i][0], view[j][0], flow[i][j]) for i in range(n) for j in range(m) if flow[i][j]]
    return pairs, sum(supply), sum(demand)


def minimum_cost_pairs_of_many(source: list[tuple[tuple, int]], view: list[tuple[tuple, int]]) -> tuple[list[tuple[tuple, tuple, int]], int, int]:
    """As minimum_cost_pairs, for many variants: without a cost for each pair of them.

    Rows that agree in a set of fields meet in a node of their values there, at the cost of the other fields; the
    cheapest way between two rows is the number of fields in which they differ. Flow is sent along all ways of the
    least cost at once, then along those of the next (primal-dual method, with Dinic's blocking flows), until one side
    is used up. Where fields are so many that pairs are fewer than sets of fields, rows meet directly.
    """
    n, m, width = len(source), len(view), len(source[0][0])
    start, end = n + m, n + m + 1
    without = 1 + sum(c for _, c in source)
    first, to, room, cost, after = array("i", [-1]) * (n + m + 2), array("i"), array("q"), array("h"), array("i")

    def arc(a: int, b: int, size: int, c: int):
        for x, y, r, k in ((a, b, size, c), (b, a, 0, -c)):
            to.append(y)
            room.append(r)
            cost.append(k)
            after.append(first[x])
            first[x] = len(to) - 1

    for i, (_, c) in enumerate(source):
        arc(start, i, c, 0)
    for j, (_, c) in enumerate(view):
        arc(n + j, end, c, 0)
    if n * m <= (n + m) << width:
        for i, (a, _) in enumerate(source):
            for j, (b, _) in enumerate(view):
                arc(i, n + j, without, sum(x != y for x, y in zip(a, b)))
    else:
        for size in range(width + 1):
            for kept in combinations(range(width), size):
                meet: dict[tuple, tuple[list, list]] = {}
                for i, (a, _) in enumerate(source):
                    meet.setdefault(tuple(a[f] for f in kept), ([], []))[0].append(i)
                for j, (b, _) in enumerate(view):
                    if (known := meet.get(tuple(b[f] for f in kept))) is not None:
                        known[1].append(n + j)
                for left, right in meet.values():
                    if right:
                        first.append(-1)
                        for i in left:
                            arc(i, len(first) - 1, without, width - size)
                        for j in right:
                            arc(len(first) - 1, j, without, 0)

    nodes = len(first)
    price = array("i", [0]) * nodes
    while True:
        # distances at reduced costs, which are small whole numbers, by buckets
        far = array("i", [-1]) * nodes
        buckets, d = {0: [start]}, 0
        while far[end] < 0 and buckets:
            d = min(buckets)
            for v in (todo := buckets.pop(d)):
                if far[v] >= 0:
                    continue
                far[v] = d
                e = first[v]
                while e >= 0:
                    w = to[e]
                    if room[e] and far[w] < 0:
                        step = cost[e] + price[v] - price[w]
                        (todo if not step else buckets.setdefault(d + step, [])).append(w)
                    e = after[e]
        if far[end] < 0:
            break
        for v in range(nodes):
            price[v] += far[v] if far[v] >= 0 else d
        while True:
            level = array("i", [-1]) * nodes
            level[start] = 0
            queue = [start]
            for v in queue:
                if level[end] >= 0 and level[v] >= level[end]:
                    break
                e = first[v]
                while e >= 0:
                    w = to[e]
                    if level[w] < 0 and room[e] and cost[e] + price[v] == price[w]:
                        level[w] = level[v] + 1
                        queue.append(w)
                    e = after[e]
            if level[end] < 0:
                break
            at, path, v = array("i", first), [], start
            while True:
                if v == end:
                    amount = min(room[e] for e in path)
                    for e in path:
                        room[e] -= amount
                        room[e ^ 1] += amount
                    full = next(i for i, e in enumerate(path) if not room[e])
                    v = to[path[full] ^ 1]
                    del path[full:]
                    continue
                e = at[v]
                while e >= 0 and not (room[e] and level[to[e]] == level[v] + 1 and cost[e] + price[v] == price[to[e]]):
                    e = after[e]
                at[v] = e
                if e >= 0:
                    path.append(e)
                    v = to[e]
                elif path:
                    v = to[path.pop() ^ 1]
                    at[v] = after[at[v]]
                else:
                    break

    found: dict[tuple[int, int], int] = {}
    arrived: dict[int, list] = {}  # what of each source variant came to a meeting node
    for i in range(n):
        e = first[i]
        while e >= 0:
            if not e & 1 and room[e ^ 1]:
                if n <= to[e] < n + m:
                    found[i, to[e] - n] = room[e ^ 1]
                else:
                    arrived.setdefault(to[e], []).append([i, room[e ^ 1]])
            e = after[e]
    for v, held in arrived.items():
        e = first[v]
        while e >= 0:
            wanted = 0 if e & 1 else room[e ^ 1]
            while wanted:
                amount = min(wanted, held[-1][1])
                found[held[-1][0], to[e] - n] = found.get((held[-1][0], to[e] - n), 0) + amount
                wanted -= amount
                held[-1][1] -= amount
                if not held[-1][1]:
                    held.pop()
            e = after[e]
    paired = sum(found.values())
    return [(source[i][0], view[j][0], c) for (i, j), c in sorted(found.items())], sum(c for _, c in source) - paired, sum(c for _, c in view) - paired
