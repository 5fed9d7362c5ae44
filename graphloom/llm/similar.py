"""The most similar vectors of every vector, through shifted space-filling curves.

Vectors are projected several times, as often as their model needs, each time onto DIMS random orthonormal directions with a random shift, and
placed on a Hilbert curve; each ordering is range-partitioned and sorted by curve position in Spark. In every sorted
partition, windows of WINDOW consecutive vectors meet themselves and their neighbour windows by matrix product, and
the best of each vector are reranked in double precision; the finds of all orderings are merged.

Equal vectors are folded to one representative first and only expanded to the ids that can be among the k most
similar, so a group of copies that holds a third of all rows neither fills the windows nor makes pairs of all copies.

The index (centre and spread of the projections, per model) is fitted on the SAMPLE vectors with the smallest hash (more
where orderings of over a million vectors are chosen), and so is the number of orderings; every vector is indexed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.llm.sample import bounded_sample
from graphloom.operators.skew import join_counted
from graphloom.sources import cut

ORDERINGS, DIMS, BITS, WINDOW, SAMPLE, SEED = 16, 8, 7, 1024, 8192, 20260
#: A model of more than three windows gets as many orderings, at least FEWEST, as let up to PROBES of its vectors meet the
#: part RECALL of their true neighbours; of those of a similarity of CLOSE and more, where only such are wanted, CLOSE_PROBES
#: of them the part CLOSE_RECALL. Other models, and those whose probes have no neighbour, get ORDERINGS.
PROBES, RECALL = 512, 0.93
CLOSE, CLOSE_PROBES, CLOSE_RECALL, FEWEST = 0.9, 2048, 0.999, 4
#: Windows of a range partition. Vectors at a partition's ends lack a neighbour window there, in that ordering only.
WINDOWS_A_PART = 32


def hilbert_keys(cells, bits: int):
    """Positions on the Hilbert curve of integer points, cells being an array (points, dims) of values below 2**bits.

    The transform of Skilling (2004), vectorised over the points; dims * bits must be at most 63.
    """
    import numpy as np

    axes = [np.ascontiguousarray(c, dtype=np.int64) for c in np.asarray(cells).T]
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for i, axis in enumerate(axes):
            inverted = (axis & bit) != 0
            swap = np.where(inverted, 0, (axes[0] ^ axis) & low)
            if i:
                axes[i] = axis ^ swap
            axes[0] = axes[0] ^ swap ^ np.where(inverted, low, 0) if i else axes[0] ^ np.where(inverted, low, 0)
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    turn = np.zeros_like(axes[0])
    for level in range(bits - 1, 0, -1):
        turn = np.where(axes[-1] & (1 << level), turn ^ ((1 << level) - 1), turn)
    axes = [axis ^ turn for axis in axes]
    key = np.zeros_like(turn)
    for level in range(bits - 1, -1, -1):
        for axis in axes:
            key = (key << 1) | ((axis >> level) & 1)
    return key


def usable(vector: str, dim: int):
    """Condition: dim elements, all present and finite, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) == dim) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _pack(dim: int):
    def pack(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            flat = np.ascontiguousarray(b.column(2).flatten().to_numpy(zero_copy_only=False), dtype=np.float32) + np.float32(0)  # -0.0 becomes 0.0
            offsets = np.arange(b.num_rows + 1, dtype=np.int32) * (4 * dim)
            vec = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(1).cast(pa.string()), vec], names=["model", "id", "vec"])

    return pack


def _matrix(column, dim: int):
    import numpy as np

    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float32).reshape(-1, dim)


def _fit(reps: DataFrame, dim: int, total: int, k: int, sizes: dict, least: float | None) -> tuple[list, dict, dict]:
    """Projections; by model the centre and spread in each of them, from a sample; the orderings that models of sizes need."""
    import numpy as np

    # ranks among the sampled vectors must tell apart what windows do
    n_probes, recall = (CLOSE_PROBES, CLOSE_RECALL) if least is not None and least >= CLOSE else (PROBES, RECALL)
    wanted = max(SAMPLE, 8 * total // WINDOW) if sizes else SAMPLE
    sample = bounded_sample(reps.select("model", "vec", "rid"), "rid", wanted, total).collect()
    random = np.random.default_rng(SEED)
    dims = min(DIMS, dim)
    bases: list = []
    by_model: dict = {}
    probes: dict = {}
    for r in sample:
        v = np.frombuffer(bytes(r["vec"]), dtype=np.float32)
        by_model.setdefault(r["model"], []).append(v / np.linalg.norm(v.astype(np.float64)))
        by_model.setdefault(None, []).append(by_model[r["model"]][-1])
        if r["model"] in sizes and len(probes.setdefault(r["model"], [])) < n_probes:
            probes[r["model"]].append((r["rid"], by_model[r["model"]][-1]))
    by_model = {m: np.array(vs) for m, vs in by_model.items() if m is None or len(vs) >= 64}
    fitted: dict = {m: [] for m in by_model}

    def extend(n: int):
        while len(bases) < n:
            bases.append((np.linalg.qr(random.standard_normal((dim, dims)))[0].astype(np.float32), random.uniform(-0.5, 0.5, dims)))
            for m, vs in by_model.items():
                p = vs @ bases[-1][0]
                fitted[m].append((p.mean(0), p.std(0) + 1e-9))

    orderings: dict = {}
    true = _true_neighbours(reps, probes, dim, k, least) if probes else {}
    for m, pairs in true.items():
        own, n = by_model.get(m, by_model[None]), sizes[m]
        a, b = (np.array(x) for x in zip(*pairs))
        missed, o = np.ones(len(a)), 0
        # at n / WINDOW orderings, comparing all pairs would cost less
        while o < FEWEST or (1 - missed.mean() < recall and o < n / WINDOW):
            extend(o + 1)
            (basis, shift), (centre, spread) = bases[o], fitted.get(m, fitted[None])[o]
            known, at, other = (_keys((x @ basis - centre) / spread, shift) for x in (own, a, b))
            known.sort()
            apart = np.abs(np.searchsorted(known, at) - np.searchsorted(known, other)) * (n / len(own))
            missed *= 1 - np.clip(2 - apart / WINDOW, 0, 1)  # one window apart they meet, two they don't
            o += 1
        orderings[m] = o
    extend(ORDERINGS)
    return bases, fitted, orderings


def _keys(scaled, shift):
    """Curve positions of projections in units of their spread."""
    import numpy as np

    return hilbert_keys(np.clip((scaled + shift + 4) * ((1 << BITS) / 8), 0, (1 << BITS) - 1).astype(np.int64), BITS)


def _true_neighbours(reps: DataFrame, probes: dict, dim: int, k: int, least: float | None) -> dict:
    """By model the pairs (unit vector of a probe, that of one of its k nearest, of at least the similarity least), from all vectors of the model."""
    import numpy as np

    sent = reps.sparkSession.sparkContext.broadcast({m: (np.array([r for r, _ in ps]), np.array([v for _, v in ps])) for m, ps in probes.items()})

    def nearest(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        best: dict = {}
        for b in batches:
            model = np.array(b.column(1).to_pylist(), dtype=object)
            for m, (ids, units) in sent.value.items():
                at = np.flatnonzero(model == m)
                if not len(at):
                    continue
                rid, raw = b.column(0).to_numpy(zero_copy_only=False)[at], _matrix(b.column(2).take(pa.array(at)), dim)
                near = units @ (raw / np.linalg.norm(raw.astype(np.float64), axis=1, keepdims=True)).T
                near[ids[:, None] == rid[None, :]] = -2
                for i, top in enumerate(np.argpartition(near, -min(k, len(rid)), axis=1)[:, -k:]):
                    held = best.setdefault((m, i), [])
                    held += [(-float(near[i, j]), raw[j].tobytes()) for j in top if near[i, j] > -2 and (least is None or near[i, j] >= least)]
                    held.sort()
                    del held[k:]
        rows = [(m, i, far, vec) for (m, i), held in best.items() for far, vec in held]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.float64(), pa.binary()))], names=["model", "probe", "far", "vec"])

    found = reps.select("rid", "model", "vec").mapInArrow(nearest, "model string, probe int, far double, vec binary")
    found = found.groupBy("model", "probe").agg(F.slice(F.array_sort(F.collect_list(F.struct("far", "vec"))), 1, k).alias("near"))
    out: dict = {}
    for r in found.collect():
        for e in r["near"]:
            v = np.frombuffer(bytes(e["vec"]), dtype=np.float32)
            out.setdefault(r["model"], []).append((probes[r["model"]][r["probe"]][1], v / np.linalg.norm(v.astype(np.float64))))
    return out


def _place(bases: list, fitted: dict, dim: int, orderings: dict):
    """Rows (rid, model, vec) to one row per ordering of the model, ORDERINGS if not named, with the curve position."""

    def place(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            rid, model, vec = (b.column(i) for i in range(3))
            raw = _matrix(vec, dim).astype(np.float64)
            unit = raw / np.linalg.norm(raw, axis=1, keepdims=True)
            codes = model.dictionary_encode()
            which = codes.indices.to_numpy(zero_copy_only=False)
            models = codes.dictionary.to_pylist()
            wanted = np.array([orderings.get(m, ORDERINGS) for m in models])[which]
            for o, (basis, shift) in enumerate(bases):
                rows = np.flatnonzero(wanted > o)
                if not len(rows):
                    break
                flat = unit[rows] @ basis
                for c, m in enumerate(models):
                    at = which[rows] == c
                    centre, spread = fitted.get(m, fitted[None])[o]
                    flat[at] = (flat[at] - centre) / spread
                keys = _keys(flat, shift)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), o, dtype=np.int32)), model.take(pa.array(rows)), pa.array(keys), rid.take(pa.array(rows)), vec.take(pa.array(rows))], names=["ord", "model", "pos", "rid", "vec"])

    return place


def _search(dim: int, k: int, least: float | None):
    """Over rows sorted by (ord, model, pos): for each row, its best k in its own window and the two beside it."""

    def best(window, around):
        import numpy as np
        import pyarrow as pa

        rid, raw = window
        ids = np.concatenate([r for r, _ in around])
        all_raw = np.concatenate([v for _, v in around])
        norm = np.linalg.norm(all_raw.astype(np.float64), axis=1)
        unit = (all_raw / norm[:, None]).astype(np.float32)
        own = (raw / np.linalg.norm(raw.astype(np.float64), axis=1)[:, None]).astype(np.float32)
        near = own @ unit.T
        near[rid[:, None] == ids[None, :]] = -2
        rows = np.arange(len(rid)) if least is None else np.flatnonzero(near.max(axis=1) >= least - 1e-4)
        if not len(rows) or len(ids) < 2:
            return None
        near = near[rows]
        take = min(k + 3, len(ids) - 1)
        top = np.argpartition(near, -take, axis=1)[:, -take:]
        exact = np.einsum("ij,ikj->ik", raw[rows].astype(np.float64), all_raw[top].astype(np.float64))
        exact /= np.linalg.norm(raw[rows].astype(np.float64), axis=1)[:, None] * norm[top]
        exact[ids[top] == rid[rows][:, None]] = -2
        order = np.lexsort((ids[top], -exact), axis=1)[:, :k]
        found, sims = np.take_along_axis(ids[top], order, 1), np.take_along_axis(exact, order, 1)
        ok = sims > -2 if least is None else sims >= least
        offsets = pa.array(np.concatenate([[0], np.cumsum(ok.sum(axis=1))]).astype(np.int32))
        pairs = pa.StructArray.from_arrays([pa.array(-sims[ok]), pa.array(found[ok])], names=["far", "rid"])
        return pa.RecordBatch.from_arrays([pa.array(rid[rows]), pa.ListArray.from_arrays(offsets, pairs)], names=["rid", "near"])

    def search(batches: Iterator) -> Iterator:
        import numpy as np

        segment, held, windows = None, [], []  # rows of the open window; closed windows: the one before and the one to search

        def close(last: bool):
            """Make windows of the held rows; search those whose right neighbour is known."""
            nonlocal held, windows
            rid, raw = (np.concatenate(x) for x in zip(*held)) if held else (np.empty(0, dtype=np.int64), np.empty((0, dim), dtype=np.float32))
            whole = len(rid) if last else len(rid) // WINDOW * WINDOW
            for a in range(0, whole, WINDOW):
                windows.append((rid[a : min(a + WINDOW, whole)], raw[a : min(a + WINDOW, whole)]))
                if len(windows) == 3:
                    if (out := best(windows[1], windows)) is not None:
                        yield out
                    windows.pop(0)
                elif len(windows) == 2:
                    if (out := best(windows[0], windows)) is not None:
                        yield out
            held = [(rid[whole:], raw[whole:])] if whole < len(rid) else []
            if last and windows:
                if (out := best(windows[-1], windows[-2:])) is not None:
                    yield out
                windows = []

        for b in batches:
            if not b.num_rows:
                continue
            order, model = b.column(0).to_numpy(zero_copy_only=False), b.column(1).dictionary_encode()
            rid, raw = b.column(3).to_numpy(zero_copy_only=False), _matrix(b.column(4), dim)
            codes, names = model.indices.to_numpy(zero_copy_only=False), model.dictionary.to_pylist()
            turns = np.flatnonzero((order[1:] != order[:-1]) | (codes[1:] != codes[:-1])) + 1
            for a, end in zip([0, *turns], [*turns, len(rid)]):
                here = (order[a], names[codes[a]])
                if segment is not None and segment != here:
                    yield from close(True)
                segment = here
                held.append((rid[a:end], raw[a:end]))
                if sum(len(r) for r, _ in held) >= 2 * WINDOW:
                    yield from close(False)
        if segment is not None:
            yield from close(True)

    return search


def most_similar(df: DataFrame, id_col: str, vector: str, model: str, dim: int, k: int = 5, least: float | None = None) -> DataFrame:
    """model, id, neighbour_id, rank, similarity: of each usable vector, the k with the highest cosine among its model's.

    Vectors count if they have dim finite elements, not all zero, and neither id nor model is null. Rows repeated in
    model and id count once (with the largest vector, should they differ). Equal similarity is ranked by id. With
    least, only similarities of at least least are given, which is the same result filtered, but cheaper. A model with
    one vector, and an empty input, give no rows. The search is approximate: neighbours can be missed, similarities
    given are exact. Orderings are added, as far as a sample of each large model needs them, to meet RECALL of the k.
    """
    rows = df.where(usable(vector, dim) & F.col(id_col).isNotNull() & F.col(model).isNotNull())
    rows = rows.select(F.col(model).cast("string").alias("model"), F.col(id_col).cast("string").alias("id"), F.col(vector).cast("array<float>").alias("v"))
    packed = rows.mapInArrow(_pack(dim), "model string, id string, vec binary").groupBy("model", "id").agg(F.max("vec").alias("vec"))
    packed = cut(packed)
    classes = packed.groupBy("model", "vec").agg(F.min("id").alias("rep_id"), F.count(F.lit(1)).alias("n"))
    reps = cut(classes.withColumn("rid", F.monotonically_increasing_id()))

    total = reps.count()
    if not total:
        return df.sparkSession.createDataFrame([], "model string, id string, neighbour_id string, rank int, similarity double")
    sizes = {r["model"]: r["n"] for r in reps.groupBy("model").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 3 * WINDOW).collect()}
    bases, fitted, orderings = _fit(reps, dim, total, k, sizes, least)
    placements = total * ORDERINGS + sum(sizes[m] * (o - ORDERINGS) for m, o in orderings.items())
    placed = reps.select("rid", "model", "vec").mapInArrow(_place(bases, fitted, dim, orderings), "ord int, model string, pos bigint, rid bigint, vec binary")
    parts = max(1, math.ceil(placements / (WINDOW * WINDOWS_A_PART)))
    placed = placed.repartitionByRange(parts, "ord", "model", "pos", "rid").sortWithinPartitions("ord", "model", "pos", "rid")
    near = placed.mapInArrow(_search(dim, k, least), "rid bigint, near array<struct<far: double, rid: bigint>>")
    merged = near.groupBy("rid").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, k).alias("near"))
    edges = merged.select("rid", F.explode("near").alias("e")).select("rid", F.col("e.rid").alias("other"), (-F.col("e.far")).alias("similarity"))

    several = reps.where("n > 1").select("model", "vec", "rid", F.col("n").alias("n_members"))
    members = join_counted(packed, several, ["model", "vec"], "n_members").select("rid", "id", "n_members")
    place = F.row_number().over(Window.partitionBy("rid").orderBy("id"))
    heads = members.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("rid").agg(F.collect_list("id").alias("heads"))
    own = several.select("rid", F.col("rid").alias("other"), F.lit(1.0).alias("similarity"))
    classes = reps.select(F.col("rid").alias("other"), "rep_id").join(heads.withColumnRenamed("rid", "other"), "other", "left").select("other", F.coalesce("heads", F.array("rep_id")).alias("heads"))
    lists = edges.unionByName(own).join(classes, "other").select("rid", F.explode(F.transform("heads", lambda h: F.struct((-F.col("similarity")).alias("far"), h.alias("id")))).alias("e"))
    lists = lists.groupBy("rid").agg(F.slice(F.array_sort(F.collect_list("e")), 1, k + 1).alias("near"))
    lists = cut(lists.join(reps.select("rid", "model", "rep_id", "n"), "rid"))

    everyone = lists.where("n = 1").select("model", F.col("rep_id").alias("id"), "near").unionByName(join_counted(members.drop("n_members"), lists.where("n > 1").drop("rep_id"), ["rid"], "n").select("model", "id", "near"))
    ranked = everyone.withColumn("near", F.slice(F.filter("near", lambda e: e["id"] != F.col("id")), 1, k))
    return ranked.select("model", "id", F.posexplode("near").alias("rank", "e")).select("model", "id", F.col("e.id").alias("neighbour_id"), (F.col("rank") + 1).alias("rank"), (-F.col("e.far")).alias("similarity"))


def similar_pairs(df: DataFrame, id_col: str, vector: str, model: str, dim: int, k: int, least: float) -> DataFrame:
    """id_a < id_b: pairs of at least the similarity least, one being among the k most similar of the other."""
    near = most_similar(df, id_col, vector, model, dim, k, least)
    return near.select(F.least("id", "neighbour_id").alias("id_a"), F.greatest("id", "neighbour_id").alias("id_b")).where("id_a < id_b").distinct()
