"""Canonical minima without their assignments: branch and bound over one place after another.

``Canonical`` minimises over |support|^n assignments; the reference's size is n = 7 on a doubled circle of 12, 36 million for
each work function. Here places get points one after another. A row of k places is known in part then, and the least value
of any configuration that holds what is known bounds it from below; these bounds for all multisets of up to k points take one pass
from k down to 0 over the work function. Penalties between given places are exact, those of an open place are its cheapest point
against the given ones. A partial assignment whose bound exceeds the best known total goes.

Many work functions are searched at once, and depth first in blocks, in the order of assignments: memory is bounded by
``BLOCK * n`` partial assignments, and among equal totals the first assignment wins, as by enumeration. Nothing of
|support|^n exists anywhere. A first bound comes from descents that change one place at a time.
"""

from __future__ import annotations

from functools import cached_property
from itertools import combinations, combinations_with_replacement

import numpy as np

#: Partial assignments that are extended at once.
BLOCK = 8192
#: Starts of the descents that give the first bound.
STARTS = 8

_FAR = np.int64(1) << 60


class Search:
    """The branch and bound of one ``Canonical`` (its rows, support and context); coefficients come with each call."""

    def __init__(self, context, n: int, rows: list[list[int]], support: list[int] | None = None):
        self.context, self.n, self.rows = context, n, rows
        self.support = np.array(sorted(support) if support is not None else range(context.m), np.int64)
        self.order = np.array(support if support is not None else range(context.m), np.int64)  # assignments follow it
        self.d = np.array(context.distances, np.int64)
        self.opposite = (np.arange(context.m) + context.m // 2) % context.m
        #: by place: how often each row takes its point, and its antipode
        self.uses = [[(sum(p == j + 1 for p in row), sum(p == -j - 1 for p in row)) for row in rows] for j in range(n)]
        #: by number of given places: how many points of each row are known
        self.known = [[sum(u + v for u, v in (self.uses[j][r] for j in range(depth))) for r in range(len(rows))] for depth in range(n + 1)]

    @cached_property
    def grown(self) -> list[np.ndarray]:
        """By size t < k: the number of each multiset of t points with one more point; sizes k are configurations."""
        m, k, out = self.context.m, self.context.k, []
        sets = [list(combinations_with_replacement(range(m), t)) for t in range(k)]
        index = [{c: i for i, c in enumerate(s)} for s in sets] + [self.context.index]
        for t in range(k):
            out.append(np.array([[index[t + 1][tuple(sorted((*c, p)))] for p in range(m)] for c in sets[t]], np.int64).reshape(len(sets[t]), m))
        return out

    def bounds(self, wfs: np.ndarray) -> list[np.ndarray]:
        """By size t: [work function, multiset of t points], the least value of a configuration that holds it."""
        allowed = np.unique(np.concatenate([self.support, self.opposite[self.support]]) if any(p < 0 for row in self.rows for p in row) else self.support)
        out = [wfs]
        for t in reversed(range(self.context.k)):
            out.append(out[-1][:, self.grown[t][:, allowed]].min(axis=2))
        return out[::-1]

    def _take(self, state: np.ndarray, depth: int, points: np.ndarray) -> np.ndarray:
        """Multisets' numbers by row once place ``depth`` has these points (one for each line of ``state``)."""
        out = state.copy()
        for r, (plain, anti) in enumerate(self.uses[depth]):
            t = self.known[depth][r]
            for point, times in ((points, plain), (self.opposite[points], anti)):
                for _ in range(times):
                    out[:, r] = self.grown[t][out[:, r], point]
                    t += 1
        return out

    def _matrix(self, coefs) -> np.ndarray:
        c = np.zeros((self.n, self.n), np.int64)
        if coefs is not None and len(coefs):
            for (i, j), x in zip(combinations(range(self.n), 2), coefs, strict=True):
                c[i, j] = c[j, i] = x
        return c

    def positions(self, points: np.ndarray) -> np.ndarray:
        """[assignment, row]: configurations of whole assignments (rows of points)."""
        state = np.zeros((len(points), len(self.rows)), np.int64)
        for j in range(self.n):
            state = self._take(state, j, points[:, j])
        return state

    def totals(self, wfs: np.ndarray, which: np.ndarray, points: np.ndarray, coefs=None) -> np.ndarray:
        """The values of whole assignments at the work functions ``which``."""
        out, c = wfs[which[:, None], self.positions(points)].sum(axis=1), self._matrix(coefs)
        for i, j in zip(*np.nonzero(np.triu(c))):
            out = out - c[i, j] * self.d[points[:, i], points[:, j]]
        return out

    def descend(self, wfs: np.ndarray, coefs=None) -> np.ndarray:
        """An upper bound for each work function: the best of a few descents, one place at a time."""
        s, w = len(self.order), len(wfs)
        begun = np.array([[(a + b * j) % s for j in range(self.n)] for a, b in ((i * s // STARTS, i % 2 * (s // 2)) for i in range(STARTS))])
        points = np.repeat(self.order[begun][None], w, axis=0).reshape(-1, self.n)
        which = np.repeat(np.arange(w), STARTS)
        best = self.totals(wfs, which, points, coefs)
        for _ in range(3):
            before = best.copy()
            for j in range(self.n):
                tried = np.repeat(points, s, axis=0)
                tried[:, j] = np.tile(self.order, len(points))
                values = self.totals(wfs, np.repeat(which, s), tried, coefs).reshape(-1, s)
                k = values.argmin(axis=1)
                best = values[np.arange(len(k)), k]
                points[:, j] = self.order[k]
            if (best == before).all():
                break
        return best.reshape(w, STARTS).min(axis=1)

    def minima(self, wfs: np.ndarray, coefs=None, prefix: tuple[int, ...] = (), limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The least totals and the first assignments (as numbers) that have them, of those that begin with ``prefix``.

        ``prefix`` has positions in the support. ``limit``: totals above it aren't looked for (unless given, what descents
        reach; with a prefix, none). Where nothing is found the number is -1 and the total larger than any.
        """
        wfs = np.ascontiguousarray(wfs, np.int64)
        s, n, c = len(self.order), self.n, self._matrix(coefs)
        low = self.bounds(wfs)
        to_order = self.d[:, self.order]
        reach = int(self.d.max()) if self.d.size else 0
        gain = lambda i, j: min(0, -int(c[i, j]) * reach)
        #: what open places can gain at most, by number of given places: among themselves, and against given ones
        among = [sum(gain(i, j) for i, j in combinations(range(depth, n), 2)) for depth in range(n + 1)]
        against = [sum(gain(i, j) for i in range(depth) for j in range(depth, n)) for depth in range(n + 1)]
        if limit is None:
            limit = np.full(len(wfs), _FAR) if prefix else self.descend(wfs, coefs)
        limit = np.array(limit, np.int64)
        best, first = np.full(len(wfs), _FAR), np.full(len(wfs), -1, np.int64)
        every = np.arange(len(wfs))
        stack = [(0, every, np.zeros(len(wfs), np.int64), np.zeros((len(wfs), 0), np.int64), np.zeros((len(wfs), len(self.rows)), np.int64), np.zeros(len(wfs), np.int64))]
        while stack:
            depth, which, code, points, state, paid = stack.pop()
            if depth == n:
                # assignments come in order: the first of equal totals is met first, and later ones must be better
                at = np.lexsort((code, paid, which))
                lead = at[np.diff(which[at], prepend=-1) > 0]
                better = lead[paid[lead] < best[which[lead]]]
                best[which[better]], first[which[better]] = paid[better], code[better]
                limit[which[better]] = np.minimum(limit[which[better]], paid[better])
                continue
            choices = np.arange(s) if depth >= len(prefix) else np.array([prefix[depth]])
            w, p = np.repeat(which, len(choices)), np.tile(self.order[choices], len(which))
            grown_state = self._take(np.repeat(state, len(choices), axis=0), depth, p)
            cost = np.repeat(paid, len(choices))
            for i in np.flatnonzero(c[:depth, depth]):
                cost = cost - c[i, depth] * self.d[np.repeat(points[:, i], len(choices)), p]
            bound = cost + among[depth + 1]
            for r, t in enumerate(self.known[depth + 1]):
                bound = bound + low[t][w, grown_state[:, r]]
            # equal totals count until one is found: it may be the first such assignment
            hopeful = lambda bound, w: np.flatnonzero(np.where(best[w] <= limit[w], bound < best[w], bound <= limit[w]))
            open_ = hopeful(bound + against[depth + 1], w)
            if not len(open_):
                continue
            w, p, grown_state, cost, bound = w[open_], p[open_], grown_state[open_], cost[open_], bound[open_]
            grown_points = np.column_stack([points[open_ // len(choices)], p])
            for j in range(depth + 1, n):
                owed = np.flatnonzero(c[: depth + 1, j])
                if len(owed):
                    bound = bound - sum(c[i, j] * to_order[grown_points[:, i]] for i in owed).max(axis=1)
            kept = hopeful(bound, w)
            if not len(kept):
                continue
            grown_code = code[open_ // len(choices)] * s + choices[open_ % len(choices)]
            if depth + 1 == n:
                cost = bound  # every row is a configuration now, and no place is open
            blocks = [kept[i : i + BLOCK] for i in range(0, len(kept), BLOCK)]
            stack += [(depth + 1, w[b], grown_code[b], grown_points[b], grown_state[b], cost[b]) for b in reversed(blocks)]
        return best, first
