"""Quantiles by selection and domination in blocks, against NumPy and all pairs."""

import random

import numpy as np
from pyspark.sql import functions as F

from slackline.functions import arrays
from slackline.operators import ranking, workfunctions


def test_quantiles_are_exact(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), rnd.choice([None, rnd.gauss(0, 5), float(rnd.randrange(4))]), rnd.randrange(10)) for _ in range(20_000)]
    rows += [("one", 2.5, 1), ("none", None, 2), ("ties", 7.0, 3), ("ties", 7.0, 3)]
    table = spark.createDataFrame(rows, "g string, x double, y long").repartition(6)
    points = {"p0": 0.0, "p5": 0.05, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    for accuracy in (10_000, 100):
        got = {r["g"]: r for r in ranking.quantiles(table, ["g"], ["x", "y"], points, accuracy).collect()}
        assert got.keys() == {r[0] for r in rows}
        for g, r in got.items():
            for c, at in (("x", 1), ("y", 2)):
                own = [row[at] for row in rows if row[0] == g and row[at] is not None]
                for n, p in points.items():
                    assert abs(r[f"{c}_{n}"] - (np.quantile(own, p) if own else 0)) < 1e-9, (g, c, n)
    whole = ranking.quantiles(table, [], ["x"], {"p50": 0.5}).first()
    assert abs(whole["x_p50"] - np.quantile([r[1] for r in rows if r[1] is not None], 0.5)) < 1e-9
    assert ranking.quantiles(table.where(F.lit(False)), ["g"], ["x"], points).count() == 0


def by_all_pairs(rows, m, tol):
    ords, points, values = (np.array([r[i] for r in rows]) for i in (0, 1, 2))
    out = []
    for o, x, v in rows:
        d = np.minimum(np.abs(points - x), m - np.abs(points - x))
        gone = (ords != o) & (np.abs(v - values) >= d - tol) & ((v > values) | ((v == values) & (o < ords)))
        if not gone.any():
            out.append(o)
    return out


def test_domination_in_blocks(spark):
    rnd, m = random.Random(3), 3000
    distance = lambda a, b: arrays.circle_distance(a, b, m)
    for n, tol, spread in ((20_000, 0.0, 40), (1_500, 1.0, 30), (3_000, 0.0, 6000), (200, 0.0, 30), (900, 2.0, 3)):
        rows = [(i, rnd.randrange(m), rnd.randrange(spread)) for i in range(n)]
        table = spark.createDataFrame([(o, [x], v) for o, x, v in rows], "ord long, cfg array<long>, value long").repartition(5)
        got = sorted(r["ord"] for r in workfunctions.undominated(table, 1, distance, tol).collect())
        assert got == by_all_pairs(rows, m, tol), (n, tol)
    two = [(i, sorted((rnd.randrange(12), rnd.randrange(12))), rnd.randrange(9)) for i in range(400)]
    table = spark.createDataFrame(two, "ord long, cfg array<long>, value long")
    ring = lambda a, b: arrays.circle_distance(a, b, 12)
    small = sorted(r["ord"] for r in workfunctions.undominated(table, 2, ring, block=16).collect())
    assert small == sorted(r["ord"] for r in workfunctions.undominated(table, 2, ring, block=1000).collect())
