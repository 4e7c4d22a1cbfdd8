"""Configurations (sorted multisets of k points), assignments and transition tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from itertools import combinations_with_replacement
from math import comb, gcd

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of a task that makes configurations.
ROWS = 1 << 23


def multisets(spark: SparkSession, n: int, k: int) -> DataFrame:
    """idx, cfg: all non-decreasing k-tuples over n points, numbered in lexicographic order.

    A row's number follows from its points, so nothing is sorted: those before it differ first at some place, where a
    lower point p leaves C(n - p + r - 1, r) ways for the r places after it. Tasks take first points far apart, which makes
    them even: the lower a first point, the more rows it has.
    """
    if k < 0:
        raise ValueError("k is not negative")
    if not k or not n:
        return spark.range(0 if k else 1).select(F.col("id").alias("idx"), F.expr("cast(array() as array<bigint>)").alias("cfg"))
    stride = next(s for s in range(int(n * 0.618) or 1, n + 1) if gcd(s, n) == 1)
    tasks = min(n, -(-comb(n + k - 1, k) // ROWS))
    rows = spark.range(0, n, 1, tasks).select((F.col("id") * stride % n).alias("p0"))
    for i in range(1, k):
        rows = rows.select("*", F.explode(F.sequence(F.col(f"p{i - 1}"), F.lit(n - 1).cast("long"))).alias(f"p{i}"))

    def ways(x: str, places: int) -> str:
        """How many multisets of so many places there are over x points."""
        out = x
        for i in range(1, places):
            out = f"({out} * ({x} + {i}) div {i + 1})"
        return out

    before = (f"{ways(f'({n}L - p{i - 1})' if i else f'{n}L', k - i)} - {ways(f'({n}L - p{i})', k - i)}" for i in range(k))
    return rows.select(F.expr(" + ".join(before)).alias("idx"), F.array(*(f"p{i}" for i in range(k))).alias("cfg"))


def assignments(spark: SparkSession, support: list[int], n: int) -> DataFrame:
    """a_id, points: the ordered product of a support, the first place varying slowest."""
    rows = spark.range(1).select(F.lit(0).cast("long").alias("a_id"), F.expr("cast(array() as array<bigint>)").alias("points"))
    options = F.array(*(F.lit(p).cast("long") for p in support))
    for _ in range(n):
        rows = rows.select("a_id", "points", F.posexplode(options).alias("i", "p")).select((F.col("a_id") * len(support) + F.col("i")).alias("a_id"), F.concat("points", F.array("p")).alias("points"))
    return rows


def lookup(rows: DataFrame, configs: DataFrame) -> DataFrame:
    """``rows`` (with cfg in any order) with the idx of its configuration; rows without one go."""
    return rows.withColumn("cfg", F.array_sort("cfg")).join(configs, "cfg")


def faults(configs: DataFrame, k: int, m: int) -> DataFrame:
    """One row of counts by rule that a custom order of configurations breaks."""
    cfg = F.col("cfg")
    return configs.agg(
        (F.count("*") == 0).cast("long").alias("empty"),
        F.count_if(F.size(cfg) != k).alias("wrong_length"),
        F.count_if(F.exists(cfg, lambda x: (x < 0) | (x >= m))).alias("out_of_range"),
        F.count_if(F.array_sort(cfg) != cfg).alias("unsorted"),
        (F.count("*") - F.count_distinct(cfg)).alias("repeated"),
    )


def moves(configs: DataFrame, metric: DataFrame, k: int) -> DataFrame:
    """r, idx, i, nbr, cost: server i of configuration idx moves to the request r."""
    spots = configs.select("idx", "cfg", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("i")).withColumn("a", F.col("cfg")[F.col("i")])
    moved = spots.join(metric.select("a", F.col("b").alias("r"), F.col("d").alias("cost")), "a")
    swapped = F.array_sort(F.transform("cfg", lambda x, j: F.when(j == F.col("i"), F.col("r")).otherwise(x)))
    moved = moved.select("r", "idx", "i", "cost", swapped.alias("cfg"))
    return moved.join(configs.select(F.col("idx").alias("nbr"), "cfg"), "cfg", "left").select("r", "idx", F.col("i").cast("long").alias("i"), "nbr", "cost")


def is_closed(move_table: DataFrame) -> bool:
    """Whether every move leads to a configuration of the table."""
    return move_table.where("nbr is null").isEmpty()


@dataclass(frozen=True)
class Context:
    """A small metric with k servers: the tables that kernels gather from. Bounded by C(m + k - 1, k) configurations."""

    k: int
    distances: tuple[tuple[int, ...], ...]
    order: tuple[tuple[int, ...], ...] | None = None

    @classmethod
    def of(cls, k: int, matrix, order=None) -> Context:
        if any(v != int(v) for row in matrix for v in row):
            raise ValueError("distances are integers")
        context = cls(k, tuple(tuple(int(v) for v in row) for row in matrix), tuple(map(tuple, order)) if order is not None else None)
        context.neighbours  # noqa: B018  an order that isn't closed raises here
        return context

    @property
    def m(self) -> int:
        return len(self.distances)

    @cached_property
    def configs(self) -> list[tuple[int, ...]]:
        if self.order is None:
            return list(combinations_with_replacement(range(self.m), self.k))
        found = list(self.order)
        if not found:
            raise ValueError("no configurations")
        if any(len(c) != self.k or list(c) != sorted(c) or c[0] < 0 or c[-1] >= self.m for c in found) or len(set(found)) != len(found):
            raise ValueError("configurations are distinct sorted k-tuples of points")
        return found

    @cached_property
    def index(self) -> dict[tuple[int, ...], int]:
        return {c: i for i, c in enumerate(self.configs)}

    def idx(self, cfg) -> int:
        return self.index[tuple(sorted(cfg))]

    @cached_property
    def neighbours(self) -> np.ndarray:
        """[r, idx, i]: the configuration once server i has moved to r."""
        out = np.empty((self.m, len(self.configs), self.k), np.int64)
        for r in range(self.m):
            for c, cfg in enumerate(self.configs):
                for i in range(self.k):
                    key = tuple(sorted((*cfg[:i], r, *cfg[i + 1 :])))
                    if key not in self.index:
                        raise ValueError("the configurations are not closed under requests")
                    out[r, c, i] = self.index[key]
        return out

    @cached_property
    def costs(self) -> np.ndarray:
        d, cfg = np.array(self.distances), np.array(self.configs).reshape(len(self.configs), self.k)
        return np.moveaxis(d[cfg], 2, 0)

    def matching(self, a, b) -> int:
        """The cheapest matching of two configurations, by subsets: k 2^k steps."""
        best = {0: 0}
        for x in a:
            step: dict[int, int] = {}
            for used, cost in best.items():
                for j, y in enumerate(b):
                    if not used >> j & 1:
                        now = cost + self.distances[x][y]
                        key = used | 1 << j
                        if now < step.get(key, 1 << 62):
                            step[key] = now
            best = step
        return min(best.values())

    def initial(self, cfg) -> np.ndarray:
        return np.array([self.matching(cfg, c) for c in self.configs], np.int64)

    def update(self, wf: np.ndarray, r: int) -> np.ndarray:
        """Work functions (rows, or one) after a request at r."""
        return (wf[..., self.neighbours[r]] + self.costs[r]).min(axis=-1)

    @cached_property
    def _preimages(self) -> dict[tuple[int, int], np.ndarray]:
        return {}

    def preimage(self, s: int, t: int) -> np.ndarray:
        """For configurations with a server at t: the one with the first such server at s; else -1. Kept by (s, t)."""
        if (s, t) not in self._preimages:
            self._preimages[s, t] = self._preimage(s, t)
        return self._preimages[s, t]

    def _preimage(self, s: int, t: int) -> np.ndarray:
        out = np.full(len(self.configs), -1, np.int64)
        for i, cfg in enumerate(self.configs):
            if t in cfg:
                at = cfg.index(t)
                out[i] = self.idx((*cfg[:at], s, *cfg[at + 1 :]))
        return out

    def ride(self, wf: np.ndarray, s: int, t: int) -> np.ndarray:
        """Work functions after a ride from s to t. A closed context has a reachable state behind each minimum."""
        back = self.preimage(s, t)
        out = np.where(back >= 0, wf[..., back] + self.distances[s][t], 1 << 40)
        return self.update(out, t)
