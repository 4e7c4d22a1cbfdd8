"""Canonical minima by branch and bound against enumeration."""

import numpy as np
import pytest

from slackline.operators import minima, potentials
from slackline.operators.configs import Context
from slackline.operators.potentials import Canonical
from slackline.sources.metrics import circle_matrix

#: Seven places: all in the first's row, or two of five rows each. Fixed values.
SEVEN = [[-1] * 4, [1, -2, -3, -4], [1, 2, -5, -6], [1, 3, 5, -7], [1, 4, 6, 7]]


def walked(context, rnd, steps):
    w = context.initial(context.configs[rnd.integers(len(context.configs))])
    for _ in range(steps):
        w = context.update(w, int(rnd.integers(context.m)))
    return w - w.min()


def cases():
    rnd = np.random.default_rng(1)
    for k, m, n, rows in ((3, 6, 4, None), (2, 6, 3, None), (1, 8, 2, [[1], [-2]]), (4, 4, 7, SEVEN)):
        for turn in range(4):
            own = rows or [[int(x) * int(rnd.choice([-1, 1])) for x in rnd.integers(1, n + 1, k)] for _ in range(k + 1)]
            coefs = rnd.integers(-3, 4, n * (n - 1) // 2).tolist()
            support = None if turn % 2 == 0 else rnd.permutation(m)[: m - 1].tolist()
            context = Context.of(k, circle_matrix(m))
            yield context, n, own, coefs, support, np.array([walked(context, rnd, s) for s in range(12)])


@pytest.mark.parametrize("case", list(cases()), ids=lambda c: f"k{c[0].k}m{c[0].m}n{c[1]}")
@pytest.mark.parametrize("block", [minima.BLOCK, 7])
def test_minima_equal_enumeration(case, block, monkeypatch):
    context, n, rows, coefs, support, wfs = case
    if block < 100 and n == 7:
        wfs = wfs[:2]
    monkeypatch.setattr(minima, "BLOCK", block)
    p = Canonical(context, n, rows, coefs, support)
    values = p.values(wfs) - p.penalties()
    best, first = p.search.minima(wfs, coefs)
    assert (best == values.min(axis=1)).all() and (first == values.argmin(axis=1)).all()
    parts = [p.search.minima(wfs, coefs, (k,)) for k in range(len(p.choices))]
    least = np.array([b for b, _ in parts])
    assert (least.min(axis=0) == best).all() and (np.array([f for _, f in parts])[least.argmin(axis=0), np.arange(len(wfs))] == first).all()
    assert (p.search.descend(wfs, coefs) >= best).all()


def test_latents_are_made_where_their_numbers_are(spark):
    context = Context.of(3, circle_matrix(4))
    p = Canonical(context, 3, [[1, 2, 3], [-1, 2, 3], [-2, -2, 3], [-3, -3, -3]], [1, 0, -2], support=[2, 0, 3])
    rows = {r["a_id"]: r for r in p.latents(spark).collect()}
    assert sorted(rows) == list(range(27))
    for i, points in enumerate([(a, b, c) for a in (2, 0, 3) for b in (2, 0, 3) for c in (2, 0, 3)]):
        at = [[points[abs(x) - 1] if x > 0 else (points[abs(x) - 1] + 2) % 4 for x in row] for row in p.index_matrix]
        d = context.distances
        assert rows[i]["points"] == list(points) and rows[i]["gathers"] == [context.idx(c) for c in at]
        assert rows[i]["penalty"] == d[points[0]][points[1]] - 2 * d[points[1]][points[2]]


def test_seven_places_over_the_doubled_circle(spark):
    """36 million assignments: nothing of that size is made, and tasks for parts agree with the search as a whole."""
    context = Context.of(4, circle_matrix(12))
    coefs = [0] * 8 + [1, 1, 0, 0, 0, 1, 1, 0, 1, -1, -1, 0, 0]
    p = Canonical(context, 7, SEVEN, coefs)
    assert p.size == 12**7 > potentials.DENSE
    with pytest.raises(ValueError, match="too many"):
        p.points  # noqa: B018
    rnd = np.random.default_rng(3)
    wfs = np.array([walked(context, rnd, s) for s in (0, 3, 9)])
    nodes = spark.createDataFrame([(i, w.tolist()) for i, w in enumerate(wfs)], "id long, wf array<long>")
    parts = {r["id"]: (r["value"], r["a_id"]) for r in p.spread(nodes).collect()}
    best, first = p.minima(wfs)
    assert parts == {i: (int(b), int(f)) for i, (b, f) in enumerate(zip(best, first))}
    # a found minimum is the value of its assignment, and no single change of a place betters it
    points = p.assigned(first)
    assert (p.search.totals(wfs, np.arange(3), points, coefs) == best).all()
    for j in range(7):
        for x in range(12):
            other = points.copy()
            other[:, j] = x
            assert (p.search.totals(wfs, np.arange(3), other, coefs) >= best).all()
    candidates = spark.createDataFrame([(0, coefs), (1, [0] * 21)], "candidate_id long, coefs array<long>")
    scores = {(r["id"], r["candidate_id"]): r["value"] for r in p.scores(nodes, candidates).collect()}
    assert all(scores[i, 0] == best[i] for i in range(3)) and len(scores) == 6
