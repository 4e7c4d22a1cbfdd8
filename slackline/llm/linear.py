"""Logistic regression on small samples, with numpy alone."""

from __future__ import annotations

import numpy as np


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_dense(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 25) -> tuple[np.ndarray, float]:
    """Newton's method on standardised columns; weights and intercept for the columns as given."""
    if not len(y) or y.min() == y.max():  # one class or none: the (smoothed) prior
        return np.zeros(x.shape[1]), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1
    a = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    penalty = np.full(a.shape[1], l2)
    penalty[-1] = 1e-6
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = sigmoid(a @ w)
        gradient = a.T @ (p - y) + penalty * w
        hessian = (a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    weights = w[:-1] / scale
    return weights, float(w[-1] - weights @ mean)


class Sparse:
    """Rows of present features (sets of column numbers), with ``extra`` dense columns."""

    def __init__(self, rows: list, n_features: int, extra: np.ndarray | None = None):
        self.n, self.k = len(rows), n_features
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows])
        self.col = np.array([c for r in rows for c in r], np.int64)
        self.extra = np.zeros((self.n, 0)) if extra is None else extra

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.n) + self.extra @ w[self.k : -1] + w[-1]

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.col, g[self.row], self.k), self.extra.T @ g, [g.sum()]])

    def take(self, keep: np.ndarray) -> Sparse:
        out = object.__new__(Sparse)
        place = np.cumsum(keep) - 1
        held = keep[self.row]
        out.n, out.k, out.row, out.col, out.extra = int(keep.sum()), self.k, place[self.row[held]], self.col[held], self.extra[keep]
        return out


def fit_sparse(x: Sparse, y: np.ndarray, l2: float = 0.1, steps: int = 100, memory: int = 8) -> np.ndarray:
    """Weights of the features, of the extra columns and the intercept, by L-BFGS on the whole sample."""
    w = np.zeros(x.k + x.extra.shape[1] + 1)
    if not len(y) or y.min() == y.max():
        w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
        return w
    penalty = np.append(np.full(len(w) - 1, l2), 0)

    def loss(w):
        z = x.dot(w)
        return np.logaddexp(0, z).sum() - y @ z + penalty @ (w * w) / 2, x.back(sigmoid(z) - y) + penalty * w

    value, gradient = loss(w)
    moves: list[tuple[np.ndarray, np.ndarray]] = []  # recent changes of the weights and of the gradient
    for _ in range(steps):
        way, used = gradient.copy(), []
        for s, t in reversed(moves):
            used.append(s @ way / (t @ s))
            way -= used[-1] * t
        way *= moves[-1][0] @ moves[-1][1] / (moves[-1][1] @ moves[-1][1]) if moves else 1 / max(1, np.abs(gradient).max())
        for (s, t), a in zip(moves, reversed(used)):
            way += (a - t @ way / (t @ s)) * s
        step, fall = 1.0, gradient @ way
        new = loss(w - way)
        while new[0] > value - 1e-4 * step * fall and step > 1e-6:
            step /= 2
            new = loss(w - step * way)
        move = (-step * way, new[1] - gradient)
        if move[0] @ move[1] > 1e-12:
            moves = [*moves, move][-memory:]
        w, done = w + move[0], value - new[0] < 1e-7 * max(1, abs(value))
        value, gradient = new
        if done:
            break
    return w


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap at which F0.5 is largest: a false alarm weighs more than a miss."""
    if not len(y) or y.min() == y.max():
        return 0.5
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    found = np.cumsum(y)
    f = 1.25 * found / (np.arange(1, len(y) + 1) + 0.25 * y.sum())
    f[:-1][p[:-1] == p[1:]] = -1  # a threshold can't part equal scores
    i = int(np.argmax(f))
    return float((p[i] + (p[i + 1] if i + 1 < len(p) else 0)) / 2)
