"""Perturbation masks and attribution solvers in numpy, for one instance of d features at a time.

Explanations are dicts from sorted tuples of feature indexes to scores. Masks that a solver reads by position are made as
blocks: one block holds, for one set and one context, all subsets of the set on top of the context.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np

#: Fixed value: weight of the empty and the full mask in the regression.
EDGE_WEIGHT = 1e6
#: Numbers of masks that are floats at a time.
FLOATS = 1 << 21


def powerset(items) -> list[tuple]:
    items = sorted(items)
    return [c for k in range(len(items) + 1) for c in combinations(items, k)]


def binomial(n: int, r: int) -> int:
    return math.comb(n, r) if 0 <= r <= n else 0


def instance_rng(seed: int, *key) -> np.random.Generator:
    """Depends on the instance alone, not on where it is computed."""
    return np.random.default_rng([seed, *(abs(int(k)) for k in key)])


def masks_all(d: int) -> np.ndarray:
    return (np.arange(1 << d)[:, None] >> np.arange(d - 1, -1, -1) & 1).astype(np.int8)


def masks_banzhaf(d: int, n: int, rng: np.random.Generator) -> np.ndarray:
    return masks_all(d) if n == 2**d else rng.integers(0, 2, (n, d)).astype(np.int8)


def masks_faith_shap(d: int, n: int, rng: np.random.Generator) -> np.ndarray:
    """Sizes k weigh 1 / (k (d - k)); the empty and the full mask are always there."""
    if d == 1:
        return np.array([[0], [1]], np.int8)
    if n == 2**d:
        return masks_all(d)
    sizes = np.arange(1, d)
    share = 1 / (sizes * (d - sizes))
    k = rng.choice(sizes, max(2, n), p=share / share.sum())
    k[:2] = 0, d
    return (rng.random((len(k), d)).argsort(axis=1).argsort(axis=1) < k[:, None]).astype(np.int8)


def _blocks(rows: list, d: int, members, context) -> None:
    for part in powerset(members):
        x = np.zeros(d, np.int8)
        x[list(context)] = 1
        x[list(part)] = 1
        rows.append(x)


def masks_shapley_taylor(d: int, n: int, order: int, rng: np.random.Generator) -> np.ndarray:
    """The lower orders' sets once, then for random permutations a block for each set of the top order, whose context is
    what precedes all of it."""
    rows = [np.isin(np.arange(d), c).astype(np.int8) for k in range(order) for c in combinations(range(d), k)]
    lower, places = len(rows) - 1, np.array(list(combinations(range(d), order)), np.int64).reshape(-1, order)
    out, parts = [np.array(rows)], powerset(range(order))
    for _ in range(int((n - lower) / (lower + binomial(d, order) or 1)) + 1):
        p = rng.permutation(d)
        members, block = np.sort(p[places], axis=1), np.arange(len(places))
        x = np.repeat(((np.argsort(p)[None, :] < places[:, :1]) if order else np.zeros((len(places), d))).astype(np.int8)[:, None, :], len(parts), axis=1)
        for k, part in enumerate(parts):
            for t in part:
                x[block, k, members[:, t]] = 1
        out.append(x.reshape(len(places) * len(parts), d))
    return np.concatenate(out)


def masks_shapley_interaction(d: int, n: int, order: int, rng: np.random.Generator) -> np.ndarray:
    """Blocks of neighbours along random permutations."""
    rows: list = []
    if d < order:
        return np.zeros((0, d), np.int8)
    for _ in range(int(n / max(1, 2 * d - 3)) + 1):
        p = rng.permutation(d)
        for k in range(d - order + 1):
            _blocks(rows, d, [int(x) for x in p[k : k + order]], p[:k])
    return np.array(rows)


def masks(method: str, d: int, n: int, order: int, rng: np.random.Generator) -> np.ndarray:
    if method == "banzhaf_all":
        return masks_all(d)
    if method == "banzhaf":
        return masks_banzhaf(d, n, rng)
    if method == "faith_shap":
        return masks_faith_shap(d, n, rng)
    if method == "shapley_taylor":
        return masks_shapley_taylor(d, n, order, rng)
    if method == "shapley_interaction":
        return masks_shapley_interaction(d, n, order, rng)
    raise ValueError(f"unknown masks {method!r}")


def terms(d: int, order: int) -> list[tuple]:
    return [c for k in range(1, order + 1) for c in combinations(range(d), k)]


def interaction_features(x: np.ndarray, of: list[tuple]) -> np.ndarray:
    """The product of each term's columns: for bits, whether all are set."""
    return np.stack([x[:, list(t)].prod(axis=1) for t in of], axis=1).astype(float) if of else np.zeros((len(x), 0))


def lasso(x: np.ndarray, y: np.ndarray, alpha: float, most: int = 1000) -> np.ndarray:
    """Minimises |y - x w|^2 / (2 n) + alpha |w|_1 by the homotopy of least-angle regression, which meets the huge row
    weights without the slow tail of coordinate descent."""
    n, d = x.shape
    w, active, sign, idle = np.zeros(d), [], [], np.ones(d, bool)
    gram, corr = x.T @ x / n, x.T @ y / n
    least = 1e-12 * max(1, gram.max(initial=0))
    for _ in range(most):
        now = corr - gram @ w
        level = np.abs(now).max(initial=0)
        if level <= alpha + 1e-12:
            break
        for j in np.flatnonzero(idle & (np.abs(now) >= level * (1 - 1e-9) - 1e-12)):
            # What the active columns leave of a fresh one; nothing, if it depends on them.
            across = gram[active, j]
            left = gram[j, j] - (across @ np.linalg.solve(gram[active][:, active], across) if active else 0.0)
            if left > least:
                active, sign, idle[j] = [*active, int(j)], [*sign, float(np.sign(now[j]))], False
        if not active:
            break
        go = np.linalg.solve(gram[active][:, active], np.array(sign))
        slope = gram[:, active] @ go
        step, drop = level - alpha, None
        c, m = np.concatenate([now[idle], -now[idle]]), np.concatenate([slope[idle], -slope[idle]])
        ahead = (level - c[1 - m > 1e-12]) / (1 - m[1 - m > 1e-12])
        step = min(step, ahead[ahead > 1e-14].min(initial=np.inf))
        held = w[active]
        zero = np.divide(-held, go, out=np.full(len(go), np.inf), where=go * held < 0)
        zero[zero <= 1e-14] = np.inf
        if zero.min() < step:
            drop = int(zero.argmin())
            step = zero[drop]
        w[active] = held + step * go
        if drop is not None:
            w[active[drop]], idle[active[drop]] = 0.0, True
            active, sign = active[:drop] + active[drop + 1 :], sign[:drop] + sign[drop + 1 :]
        elif step == level - alpha:
            break
    return w


def solve_faith_shap(x: np.ndarray, y: np.ndarray, order: int = 1, method: str = "lasso", alpha: float = 0.001) -> dict:
    """Weighted regression on the terms up to ``order``; the intercept is a column that the penalty sees too, and is
    returned under the empty tuple."""
    of = terms(x.shape[1], order)
    design = np.hstack([interaction_features(x, of), np.ones((len(x), 1))])
    edge = (x.sum(axis=1) == 0) | (x.sum(axis=1) == x.shape[1])
    root = np.sqrt(np.where(edge, EDGE_WEIGHT, 1.0))
    a, b = design * root[:, None], y * root
    if method == "lasso":
        w = lasso(a, b, alpha)
    elif method == "ridge":
        w = np.linalg.solve(a.T @ a + alpha * np.eye(a.shape[1]), a.T @ b)
    else:
        w = np.linalg.lstsq(a, b, rcond=None)[0]
    return {**dict(zip(of, w[:-1])), (): w[-1]}


def _block_means(x: np.ndarray, y: np.ndarray, start: int, order: int) -> dict:
    """The mean signed sum of each set over the blocks from ``start``."""
    size = 1 << order
    parity = np.array([(-1.0) ** (order - len(c)) for c in powerset(range(order))])
    many = (len(x) - start) // size
    ends = start + np.arange(many) * size
    members = np.nonzero(x[ends + size - 1] != x[ends])[1].reshape(many, order)
    sets, which = np.unique(members, axis=0, return_inverse=True)
    sums = np.bincount(which.reshape(-1), y[start : start + many * size].reshape(many, size) @ parity, len(sets))
    return dict(zip(map(tuple, sets.tolist()), (sums / np.bincount(which.reshape(-1), minlength=len(sets))).tolist()))


def solve_shapley_taylor(x: np.ndarray, y: np.ndarray, order: int) -> dict:
    """Lower orders are discrete derivatives at the empty set, the top order the mean over permutations."""
    lower = [c for k in range(order) for c in combinations(range(x.shape[1]), k)]
    at = {c: float(v) for c, v in zip(lower, y)}
    out = {c: sum((-1) ** (len(c) - len(t)) * at[t] for t in powerset(c)) for c in lower}
    return out | _block_means(x, y, len(lower), order)


def solve_shapley_interaction(x: np.ndarray, y: np.ndarray, order: int) -> dict:
    return _block_means(x, y, 0, order)


def explain(method: str, x: np.ndarray, y: np.ndarray, order: int, alpha: float) -> dict:
    if len(x) == 0:
        return {}
    if method == "shapley_taylor":
        return solve_shapley_taylor(x, y, order)
    if method == "shapley_interaction":
        return solve_shapley_interaction(x, y, order)
    return solve_faith_shap(x, y, order, alpha=alpha)


def by_rows(f, x: np.ndarray) -> np.ndarray:
    """``f`` of the rows of x as floats, a bounded part of them at a time."""
    step = max(1, FLOATS // max(1, x.shape[1]))
    return np.concatenate([f(x[i : i + step].astype(float)) for i in range(0, len(x), step)] or [np.zeros(0)])


def predicted(x: np.ndarray, found: dict) -> np.ndarray:
    d = x.shape[1]
    one, two = np.zeros(d), np.zeros((d, d))
    for t, v in found.items():
        if len(t) == 1:
            one[t[0]] = v
        elif len(t) == 2:
            two[t] = v
    out = found.get((), 0.0) + by_rows(lambda part: part @ one + ((part @ two) * part).sum(axis=1), x)
    for t, v in found.items():
        if len(t) > 2:
            out += v * x[:, list(t)].prod(axis=1)
    return out


def infidelity_r2(x: np.ndarray, y: np.ndarray, found: dict) -> tuple[float, float]:
    """Mean squared residual, and one less its share of the variance (1 where nothing varies and nothing is left)."""
    left = float(((predicted(x, found) - y) ** 2).mean()) if len(x) else 0.0
    spread = float(np.var(y)) if len(y) else 0.0
    return left, 1 - left / spread if spread else float(left == 0)


def integrated_gradients(value: np.ndarray, base: np.ndarray, gradient, steps: int = 100) -> np.ndarray:
    """Attributions of an input [feature][dim] by the trapezoid rule along the line from the baseline, summed over dims."""
    at = np.linspace(0, 1, steps + 1)
    g = np.stack([gradient(base + a * (value - base)) for a in at])
    mean = (g[1:] + g[:-1]).mean(axis=0) / 2
    return (mean * (value - base)).sum(axis=-1)
