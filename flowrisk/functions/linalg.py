"""Dense kernels on bounded matrices, run inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd


def gram_partials(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sum of outer products of the wide rows ``x`` of one task."""
    gram = None
    for pdf in batches:
        if len(pdf) == 0:
            continue
        x = np.stack(pdf["x"].to_numpy()).astype(float)
        x = np.column_stack([np.ones(len(x)), x])
        gram = x.T @ x if gram is None else gram + x.T @ x
    if gram is None:
        return
    n = gram.shape[0] - 1
    i, j = (a.ravel() for a in np.meshgrid(range(n), range(n), indexing="ij"))
    yield pd.DataFrame({
        "i": i, "j": j, "n": int(gram[0, 0]), "s_x": gram[0, i + 1], "s_y": gram[0, j + 1],
        "s_xy": gram[i + 1, j + 1],
    })


def regression_partials(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per (model, child), the Gram matrix of ``[1, xs, y]`` over the rows of one task."""
    grams: dict[tuple, np.ndarray] = {}
    for pdf in batches:
        for key, g in pdf.groupby(["model", "child"], sort=False):
            xs = np.stack(g["xs"].to_numpy()).astype(float)
            z = np.column_stack([np.ones(len(g)), xs, g["y"].to_numpy(dtype=float)])
            grams[key] = grams.get(key, 0.0) + z.T @ z
    if grams:
        yield pd.DataFrame({
            "model": [k[0] for k in grams],
            "child": [k[1] for k in grams],
            "gram": [g.ravel() for g in grams.values()],
        })


def total_gram(parts: pd.DataFrame) -> np.ndarray:
    flat = np.sum(np.stack(parts["gram"].to_numpy()), axis=0)
    k = int(round(np.sqrt(len(flat))))
    return flat.reshape(k, k)


def ridge_from_gram(gram: np.ndarray, alpha: float) -> tuple[float, np.ndarray, int]:
    """Intercept (unpenalised), weights and row count from the Gram matrix of ``[1, X, y]``."""
    n = gram[0, 0]
    mean = gram[0, 1:] / n
    centred = gram[1:, 1:] - n * np.outer(mean, mean)
    k = len(mean) - 1
    w = np.linalg.solve(centred[:k, :k] + alpha * np.eye(k), centred[:k, k]) if k else np.zeros(0)
    return float(mean[k] - w @ mean[:k]), w, int(n)


def ols_from_gram(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Coefficients, t statistics and degrees of freedom from the Gram matrix of ``[1, X, y]``."""
    k = gram.shape[0] - 1
    inv = np.linalg.pinv(gram[:k, :k])
    beta = inv @ gram[:k, k]
    rss = gram[k, k] - 2 * beta @ gram[:k, k] + beta @ gram[:k, :k] @ beta
    dof = max(int(round(gram[0, 0])) - k, 1)
    se = np.sqrt(np.maximum(np.diag(inv) * max(rss, 0.0) / dof, 1e-18))
    return beta, beta / se, dof


class System:
    """Forward stress ``S_t = drive_t + W S_(t-1) + U_t`` of one fitted system, from a row (init, drive, w_dst, w_src, w_val)."""

    #: Scenarios times entities that are worked on at once: half a megabyte, so that steps stay in the cache.
    WORK = 1 << 16

    def __init__(self, row) -> None:
        self.init = np.asarray(row.init, float)
        self.n = len(self.init)
        self.drive = np.asarray(row.drive, float).reshape(-1, self.n)
        dst, src, val = np.asarray(row.w_dst, int), np.asarray(row.w_src, int), np.asarray(row.w_val, float)
        # Where a good part of all pairs are edges, or there are few pairs, a matrix product is faster.
        self.w = None
        if self.n * self.n <= max(32 * len(val), 1 << 12):
            self.w = np.zeros((self.n, self.n))
            np.add.at(self.w, (dst, src), val)
            return
        order = np.argsort(dst, kind="stable")
        self.dst, first, degree = np.unique(dst[order], return_index=True, return_counts=True)
        # Targets by falling in-degree: those with a k-th incoming edge are the first ones, so each k is one gather and one sum.
        falling = np.argsort(-degree, kind="stable")
        self.dst, first, degree = self.dst[falling], first[falling], degree[falling]
        self.ranks = []
        for k in range(int(degree.max(initial=0))):
            edge = order[first[: int((degree > k).sum())] + k]
            self.ranks.append((len(edge), src[edge], val[edge][:, None]))

    def _step(self, state: np.ndarray) -> np.ndarray:
        if self.w is not None:
            return self.w @ state
        total, some = np.zeros((len(self.dst), state.shape[1])), np.empty((len(self.dst), state.shape[1]))
        for count, src, val in self.ranks:
            part = some[:count]
            np.take(state, src, axis=0, out=part, mode="clip")
            part *= val
            total[:count] += part
        out = np.zeros_like(state)
        out[self.dst] = total
        return out

    def losses(self, m: int, sid, key, level, path, paths, shocks) -> np.ndarray:
        """Positive-part sums (``m`` scenarios x entities) when entity ``key`` of scenario ``sid`` is held at ``level``, or where
        ``path`` is not negative on that row of ``paths``. Scenarios are independent, so blocks of them run to the end one by one."""
        moves = self.drive if shocks is None else self.drive + np.asarray(shocks, float).reshape(self.drive.shape)
        order = np.argsort(sid, kind="stable")
        sid, key, level, path = (np.asarray(x)[order] for x in (sid, key, level, path))
        loss = np.empty((m, self.n))
        size = max(1, self.WORK // max(1, self.n))
        for a in range(0, m, size):
            b = min(m, a + size)
            own = slice(*np.searchsorted(sid, [a, b]))
            loss[a:b] = self._losses(b - a, sid[own] - a, key[own], level[own].astype(float), path[own], paths, moves).T
        return loss

    def _losses(self, m: int, sid, key, forced, path, paths, moves) -> np.ndarray:
        on = np.flatnonzero(path >= 0)
        state = np.repeat(self.init[:, None], m, axis=1)
        loss = np.zeros_like(state)
        for t, move in enumerate(moves):
            state = self._step(state)
            state += move[:, None]
            if len(on):
                forced[on] = paths[path[on], t]
            state[key, sid] = forced
            loss += np.maximum(state, 0.0)
        return loss


def quantile(x: np.ndarray, q: float) -> np.ndarray:
    """Linearly interpolated quantile along the first axis."""
    x = np.sort(x, axis=0)
    at = (len(x) - 1) * q
    low, high = int(np.floor(at)), int(np.ceil(at))
    return x[low] if low == high else (high - at) * x[low] + (at - low) * x[high]


def _steepest(x: np.ndarray, y: np.ndarray, p: int, q: float) -> tuple[float, float] | None:
    """The best line through point ``p``: its slope is a weighted quantile of the slopes to all other points. None if no point has another ``x``."""
    dx = x - x[p]
    other = np.flatnonzero(dx)
    if not len(other):
        return None
    dx = dx[other]
    slope, weight = (y[other] - y[p]) / dx, np.abs(dx)
    order = np.argsort(slope, kind="stable")
    run = np.cumsum(weight[order])
    goal = (np.where(dx > 0, q, 1 - q) * weight).sum()
    b = float(slope[order[min(int(np.searchsorted(run, goal)), len(run) - 1)]])
    return float(y[p] - b * x[p]), b


def pinball_line(x: np.ndarray, y: np.ndarray, q: float) -> tuple[float, float]:
    """Intercept and slope of the line of least pinball loss; flat at the quantile if all ``x`` are equal.

    An optimum goes through a point, and the best line through a point is found exactly. The walk moves to points on that line while
    the loss falls. Where more than two points lie on the line, each of them is tried before it ends, so ties neither stop it early nor send it round.
    """
    scale = float(np.abs(y).max(initial=0.0)) or 1.0
    start = int(np.argmin(np.abs(y - quantile(y, q))))
    best, line, todo, seen = np.inf, (float(y[start]), 0.0), [start], set()
    while todo:
        p = todo.pop()
        if (x[p], y[p]) in seen:
            continue
        seen.add((x[p], y[p]))
        found = _steepest(x, y, p, q)
        if found is None:
            return float(quantile(y, q)), 0.0
        rest = y - found[0] - found[1] * x
        loss = float(np.where(rest >= 0, q * rest, (q - 1) * rest).sum())
        if loss < best * (1 - 1e-14):
            best, line, seen = loss, found, {(x[p], y[p])}
            todo = [int(i) for i in np.flatnonzero(np.abs(rest) <= 1e-13 * (scale + abs(found[1]) * np.abs(x).max())) if i != p]
    return line


def pinball_lines(q: float):
    """A map over the groups of one key."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        a, b = pinball_line(pdf["x"].to_numpy(float), pdf["y"].to_numpy(float), q)
        return pd.DataFrame({"key": pdf["key"].iloc[:1], "a": [a], "b": [b]})

    return fit
