import random

import numpy as np
from graphloom.llm import similar
from graphloom.llm.similar import hilbert_keys, most_similar, similar_pairs

SCHEMA = "id string, vector array<float>, model_id string, embedding_dim int, rid bigint, model string, vec string, n int"


def frame(spark, data):
    return spark.createDataFrame([(i, v, m, 64, 1, "x", "y", 2) for i, v, m in data], SCHEMA)


def brute(data, dim, k):
    """Neighbours by cosine, ties by id."""
    kept = {}
    for i, v, m in data:
        if i is not None and m is not None and v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v) and any(v):
            kept[m, i] = np.array(v, dtype=np.float32).astype(np.float64)
    out = {}
    for (m, i), v in kept.items():
        near = sorted((-1.0 if np.array_equal(v, w) else -float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), j) for (o, j), w in kept.items() if o == m and j != i)
        out[m, i] = [(j, -s) for s, j in near[:k]]
    return out


def result(df):
    out = {}
    for r in df.collect():
        out.setdefault((r["model"], r["id"]), []).append((r["rank"], r["neighbour_id"], r["similarity"]))
    return {k: [x[1:] for x in sorted(v)] for k, v in out.items()}


def vectors(seed, n, dim=8):
    r = np.random.default_rng(seed)
    base = r.standard_normal((n, dim))
    base[n // 2 :] = base[: n - n // 2] + 0.1 * r.standard_normal((n - n // 2, dim))
    return [(f"v{i:04}", [float(np.float32(x)) for x in base[i]], "m1" if i % 3 else "m2") for i in range(n)]


def test_the_curve_is_one(spark):
    cells = np.array([[a, b, c] for a in range(8) for b in range(8) for c in range(8)])
    keys = hilbert_keys(cells, 3)
    assert sorted(keys) == list(range(512))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_small_data_equals_brute_force(spark):
    data = vectors(1, 240)
    bad = [("b1", None, "m1"), ("b2", [0.0] * 8, "m1"), ("b3", [float("nan")] + [1.0] * 7, "m1"), ("b4", [1.0] * 7, "m1"), ("b5", [1.0] * 8, None), (None, [1.0] * 8, "m1"), ("b6", [float("inf")] + [1.0] * 7, "m1"), ("b7", [None] + [1.0] * 7, "m1"), ("lone", [1.0] * 8, "m3")]
    data = data + bad + data[:40]
    got, want = result(most_similar(frame(spark, data), "id", "vector", "model_id", 8, 5)), brute(data, 8, 5)
    assert {k: [i for i, _ in v] for k, v in got.items()} == {k: [i for i, _ in v] for k, v in want.items() if v}
    assert all(abs(a[1] - b[1]) < 1e-9 for k in got for a, b in zip(got[k], want[k]))


def test_copies_are_ranked_by_id_without_all_pairs(spark):
    same = [0.5, 1.0, 2.0, -1.0, 0.0, 0.0, 1.0, 3.0]
    data = [(f"c{i:03}", same, "m1") for i in range(60)] + vectors(2, 90)
    random.Random(3).shuffle(data)
    got, want = result(most_similar(frame(spark, data), "id", "vector", "model_id", 8, 5)), brute(data, 8, 5)
    assert {k: [i for i, _ in v] for k, v in got.items()} == {k: [i for i, _ in v] for k, v in want.items() if v}


def test_least_filters_the_same_result(spark, rows):
    data = vectors(4, 200)
    want = {tuple(sorted((i, j))) for (m, i), near in brute(data, 8, 5).items() for j, s in near if s >= 0.9}
    assert rows(similar_pairs(frame(spark, data), "id", "vector", "model_id", 8, 5, 0.9)) == sorted(want)


def test_recall_through_small_windows(spark, monkeypatch):
    """With windows far smaller than the data, near neighbours are still met in some ordering."""
    monkeypatch.setattr(similar, "WINDOW", 64)
    data = [(i, v, "m") for i, v, _ in vectors(5, 4000, 32)]
    unit = np.array([v for _, v, _ in data])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T - 2 * np.eye(len(unit))
    want = {(data[i][0], data[j][0]) for i, j in enumerate(near.argmax(axis=1)) if near[i, j] >= 0.9}
    got = {(r["id"], r["neighbour_id"]) for r in most_similar(frame(spark, data), "id", "vector", "model_id", 32, 1, 0.9).collect()}
    assert len(want) > 500 and len(want & got) >= 0.98 * len(want)


def test_recall_of_all_neighbours_in_a_large_model(spark, monkeypatch):
    """Five neighbours of any similarity, in noise that is large beside the windows."""
    monkeypatch.setattr(similar, "WINDOW", 16)
    monkeypatch.setattr(similar, "WINDOWS_A_PART", 512)
    unit = np.random.default_rng(6).standard_normal((6000, 64)).astype(np.float32)
    near = (unit / np.linalg.norm(unit, axis=1, keepdims=True)) @ (unit / np.linalg.norm(unit, axis=1, keepdims=True)).T - 2 * np.eye(len(unit))
    want = {(f"v{i:04}", f"v{j:04}") for i, row in enumerate(np.argpartition(near, -5, axis=1)[:, -5:]) for j in row}
    data = [(f"v{i:04}", [float(x) for x in v], "m") for i, v in enumerate(unit)]
    got = {(r["id"], r["neighbour_id"]) for r in most_similar(frame(spark, data), "id", "vector", "model_id", 64, 5).collect()}
    assert len(want & got) >= 0.9 * len(want)


def test_empty(spark, rows):
    assert rows(most_similar(frame(spark, []), "id", "vector", "model_id", 8, 5)) == []
