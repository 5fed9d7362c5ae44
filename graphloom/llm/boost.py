"""Gradient-boosted trees with logistic loss, and isotonic calibration, in numpy for a bounded sample."""

from __future__ import annotations

import numpy as np

TREES, PATIENCE, DEPTH, RATE, BINS, LEAST_LEAF, RIDGE = 120, 15, 4, 0.1, 32, 3.0, 1.0
#: Strength of the ridge of the linear model from which the trees start.
LINEAR_RIDGE = 30.0


class _Binned:
    """Rows with every feature cut into at most BINS bins, all bins of all features numbered through."""

    def __init__(self, x: np.ndarray) -> None:
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
        at = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(self.edges)], axis=1)
        self.flat = (at + np.arange(x.shape[1]) * BINS).astype(np.int32)
        # a cut behind the last edge of a feature leaves nothing on its right
        self.real = np.concatenate([np.arange(BINS) < len(e) for e in self.edges])

    def sums(self, rows: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
        """Of each value, its sums up to and with each bin, by feature."""
        where = self.flat[rows].ravel()
        return [np.bincount(where, np.repeat(v[rows], self.flat.shape[1]), len(self.real)).reshape(-1, BINS).cumsum(axis=1).ravel() for v in values]


def _grow(binned: _Binned, grad: np.ndarray, hess: np.ndarray, weight: np.ndarray, rows: np.ndarray, depth: int):
    """A tree as nested tuples (feature, edge, left, right) or a leaf value, and the leaf values of the rows."""
    g, h, n = grad[rows].sum(), hess[rows].sum(), weight[rows].sum()
    if depth < DEPTH and len(rows) >= 2 * LEAST_LEAF:
        gl, hl, nl = binned.sums(rows, grad, hess, weight)
        gain = gl**2 / (hl + RIDGE) + (g - gl) ** 2 / (h - hl + RIDGE) - g**2 / (h + RIDGE)
        gain[~binned.real | (nl < LEAST_LEAF) | (n - nl < LEAST_LEAF)] = -1
        k = int(np.argmax(gain))
        if gain[k] > 1e-6:
            f, b = divmod(k, BINS)
            left = binned.flat[rows, f] <= k
            sides = [_grow(binned, grad, hess, weight, rows[m], depth + 1) for m in (left, ~left)]
            values = np.empty(len(rows))
            values[left], values[~left] = sides[0][1], sides[1][1]
            return (f, float(binned.edges[f][b]), sides[0][0], sides[1][0]), values
    leaf = float(-RATE * g / (h + RIDGE))
    return leaf, np.full(len(rows), leaf)


def fit_linear(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centre, spread, coefficients with the intercept first) of a ridge logistic regression on damped features.

    Newton's method; LINEAR_RIDGE is the strength of the ridge on scaled features, the intercept is free.
    """
    damped = np.sign(x) * np.log1p(np.abs(x))
    centre, spread = np.average(damped, axis=0, weights=weight), damped.std(axis=0) + 1e-6
    z = np.hstack([np.ones((len(x), 1)), (damped - centre) / spread])
    beta, ridge = np.zeros(z.shape[1]), np.full(z.shape[1], LINEAR_RIDGE)
    average = np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3)
    beta[0], ridge[0] = np.log(average / (1 - average)), 1e-3
    target = beta * 0
    target[0] = beta[0]
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ beta))
        slope = z.T @ (weight * (p - y)) + ridge * (beta - target)
        curve = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(ridge)
        step = np.linalg.solve(curve, slope)
        beta = beta - step * min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return centre, spread, beta


def linear(model: tuple, x: np.ndarray) -> np.ndarray:
    centre, spread, beta = model
    return beta[0] + (np.sign(x) * np.log1p(np.abs(x)) - centre) / spread @ beta[1:]


class Growing:
    """Trees over rows x for soft targets y in [0, 1], one more with every step; margins start from the linear model start."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        self.binned, self.y, self.weight = _Binned(x), y, weight
        self.start = fit_linear(x, y, weight)
        self.margin = linear(self.start, x)
        self.trees: list = []

    def step(self):
        p = 1 / (1 + np.exp(-self.margin))
        tree, values = _grow(self.binned, self.weight * (p - self.y), self.weight * np.maximum(p * (1 - p), 1e-6), self.weight, np.arange(len(self.y)), 0)
        self.margin = self.margin + values
        self.trees.append(tree)
        return tree


def _walk(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, edge, left, right = tree
    out, low = np.empty(len(x)), x[:, f] <= edge
    out[low], out[~low] = _walk(left, x[low]), _walk(right, x[~low])
    return out


def margins(trees: list, x: np.ndarray, start: np.ndarray) -> np.ndarray:
    return start + sum((_walk(t, x) for t in trees), np.zeros(len(x)))


def fit_folds(x: np.ndarray, y: np.ndarray, weight: np.ndarray, fold: np.ndarray) -> dict:
    """start, trees, and held_out, the margin of each row by trees grown without its fold.

    There are as many trees as give the least log-loss on held-out folds, at most TREES, looked for until PATIENCE
    further ones haven't lowered it. A fold that is all there is is its own judge.
    """
    sides = [(at, Growing(*(v[~at] if (~at).any() else v for v in (x, y, weight)))) for at in (fold == k for k in np.unique(fold))]
    margin = np.empty(len(y))
    for at, growing in sides:
        margin[at] = linear(growing.start, x[at])
    best, held_out, n_trees, n = np.inf, margin.copy(), 0, 0
    while n < TREES and n - n_trees < PATIENCE:
        n += 1
        for at, growing in sides:
            margin[at] += _walk(growing.step(), x[at])
        loss = float((weight * (np.logaddexp(0, margin) - y * margin)).sum())
        if loss < best:
            best, held_out, n_trees = loss, margin.copy(), n
    whole = Growing(x, y, weight)
    for _ in range(n_trees):
        whole.step()
    return {"start": whole.start, "trees": whole.trees, "held_out": held_out}


def isotonic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray, prior: float = 0.0) -> tuple[list[float], list[float]]:
    """Pool adjacent violators: knots (margin, value) of the non-decreasing least-squares fit; interpolate between them.

    Every block's value is shrunk as by prior further rows at the logistic of its average margin, so that blocks of few
    rows stay near the model's own probability; knots are made non-decreasing again.
    """
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum of weights, mean, lowest and highest margin, mean logistic
    for s, v, w in zip(margin[order], y[order], weight[order]):
        blocks.append([w, v, s, s, 1 / (1 + np.exp(-s))])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w2, v2, _, hi, p2 = blocks.pop()
            w1, v1, lo, _, p1 = blocks.pop()
            blocks.append([w1 + w2, (w1 * v1 + w2 * v2) / (w1 + w2), lo, hi, (w1 * p1 + w2 * p2) / (w1 + w2)])
    xs, ys, least = [], [], 0.0
    for w, v, lo, hi, p in blocks:
        least = max(least, float((w * v + prior * p) / (w + prior)))
        xs += [float(lo)] + [float(hi)] * int(hi > lo)
        ys += [least] * (1 + int(hi > lo))
    return xs, ys
