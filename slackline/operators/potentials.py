"""Potentials: scalars of work functions, as Catalyst expressions where small and as Arrow functions beyond."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property
from itertools import combinations, combinations_with_replacement, product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slackline.functions import arrays
from slackline.operators.configs import Context
from slackline.operators.minima import Search

#: Assignments up to which all are looked at; beyond, ``Search`` finds the same minima by branch and bound.
DENSE = 1 << 16
#: Work functions that branch and bound takes at once.
SEARCHED = 64


def arrow(function: Callable) -> Callable[[Column], Column]:
    """A column function from a scalar potential ``wf -> value`` or ``(value, info)``: struct<value, info>."""

    @F.arrow_udf("struct<value:double,info:string>")
    def potential(wfs):
        import json

        import pyarrow as pa

        values, infos = [], []
        for wf in wfs.to_pylist():
            got = None if wf is None else function(np.array(wf, np.int64))
            value, info = got if isinstance(got, tuple) else (got, None)
            values.append(None if value is None or value != value else float(value))
            infos.append(None if info is None else json.dumps(info, sort_keys=True))
        return pa.StructArray.from_arrays([pa.array(values, pa.float64()), pa.array(infos, pa.string())], ["value", "info"])

    return potential


@dataclass(frozen=True)
class Canonical:
    """min over a in support^n of sum over rows of w[row's configuration of a] - sum of coefs times distances.

    A row names k places of a, from 1; a negative one stands for that place's antipode.
    """

    context: Context
    n: int
    index_matrix: list[list[int]]
    coefs: list[int] | None = None
    support: list[int] | None = None

    def __post_init__(self):
        k = self.context.k
        if self.coefs is not None and len(self.coefs) != self.n * (self.n - 1) // 2:
            raise ValueError("one coefficient for each pair of places")
        if any(len(row) != k for row in self.index_matrix):
            raise ValueError("every row has k places")
        if len(self.index_matrix) < k + 1:
            raise ValueError("k + 1 rows at least")

    @classmethod
    def unifying(cls, context: Context, coefs: list[int] | None = None) -> Canonical:
        """k places; row j has j times the antipode of place j, then the places after it."""
        k = context.k
        return cls(context, k, [[-j] * j + list(range(j + 1, k + 1)) for j in range(k + 1)], coefs)

    @classmethod
    def three(cls, context: Context) -> Canonical:
        """For three servers, four places: a row of the fourth's antipodes, and rows of the fourth with a place and the
        antipode of the next; distances among the first three count once. Fixed values."""
        if context.k != 3:
            raise ValueError("three servers")
        rows = [[-4] * 3, *([4, i + 1, -((i + 1) % 3 + 1)] for i in range(3))]
        return cls(context, 4, rows, [int(b < 3) for _, b in combinations(range(4), 2)])

    @cached_property
    def choices(self) -> list[int]:
        """What a place can be, in the order of assignments."""
        return list(self.support) if self.support is not None else list(range(self.context.m))

    @property
    def size(self) -> int:
        """Assignments."""
        return len(self.choices) ** self.n

    @cached_property
    def search(self) -> Search:
        return Search(self.context, self.n, self.index_matrix, self.support)

    def assigned(self, numbers: np.ndarray) -> np.ndarray:
        """[assignment, place]: the points of the assignments with these numbers, the first place varying slowest."""
        s = len(self.choices)
        return np.array(self.choices, np.int64)[numbers[:, None] // s ** np.arange(self.n)[::-1] % s]

    @cached_property
    def points(self) -> np.ndarray:
        """All assignments."""
        if self.size > DENSE:
            raise ValueError(f"{self.size} assignments are too many to hold: see search")
        return self.assigned(np.arange(self.size))

    @cached_property
    def gathers(self) -> np.ndarray:
        """[row, assignment]: positions in the work function."""
        return np.ascontiguousarray(self.search.positions(self.points).T)

    def priced(self, points: np.ndarray, coefs: list[int] | None = None) -> np.ndarray:
        """The penalties of assignments, by coefficients for the pairs of places."""
        coefs, d = self.coefs if coefs is None else coefs, np.array(self.context.distances, np.int64)
        out = np.zeros(len(points), np.int64)
        for (i, j), c in zip(combinations(range(self.n), 2), coefs or ()):
            if c:
                out += c * d[points[:, i], points[:, j]]
        return out

    def penalties(self, coefs: list[int] | None = None) -> np.ndarray:
        return self.priced(self.points, coefs)

    def latents(self, spark) -> DataFrame:
        """a_id, points, gathers, penalty: |support|^n rows, made in blocks where their numbers are."""
        from slackline.plans.explore import lists_of

        self.search.grown  # noqa: B018  computed once, on the driver

        def made(batches):
            import pyarrow as pa

            for b in batches:
                numbers = b.column(0).to_numpy()
                points = self.assigned(numbers)
                yield pa.RecordBatch.from_arrays([b.column(0), lists_of(points), lists_of(self.search.positions(points)), pa.array(self.priced(points))], ["a_id", "points", "gathers", "penalty"])

        return spark.range(self.size).mapInArrow(made, "a_id long, points array<long>, gathers array<long>, penalty long")

    def column(self, wf: str | Column, one_row: Column) -> Column:
        """struct<value, a_id>: the least value and the first assignment that has it. ``one_row``: all latents as an array."""

        def least(w):
            value = lambda l: F.aggregate(l["gathers"], -l["penalty"], lambda s, i: s + F.element_at(w, (i + 1).cast("int")))  # noqa: E731, E741
            return F.array_min(F.transform(one_row, lambda l: F.struct(value(l).alias("value"), l["a_id"].alias("a_id"))))  # noqa: E741

        return arrays.let(F.col(wf) if isinstance(wf, str) else wf, least)

    def native(self, nodes: DataFrame, wf: str = "wf") -> DataFrame:
        """``nodes`` with value and a_id, in whole by Catalyst; for few latents."""
        one = self.latents(nodes.sparkSession).agg(F.array_sort(F.collect_list(F.struct("a_id", "gathers", "penalty"))).alias("__latents"))
        joined = nodes.join(F.broadcast(one)).withColumn("__p", self.column(wf, F.col("__latents")))
        return joined.select(*nodes.columns, F.col("__p.value").alias("value"), F.col("__p.a_id").alias("a_id"))

    def values(self, wfs: np.ndarray) -> np.ndarray:
        """[work function, assignment] without penalties: shared by all candidates of coefficients."""
        out = wfs[:, self.gathers[0]].copy()
        for g in self.gathers[1:]:
            out += wfs[:, g]
        return out

    def minima(self, wfs: np.ndarray, coefs: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Least values and first assignments of rows of work functions: over all assignments, or by branch and bound."""
        if self.size > DENSE:
            return self.search.minima(wfs, self.coefs if coefs is None else coefs)
        v = self.values(wfs) - self.penalties(coefs)
        return v.min(axis=1), v.argmin(axis=1)

    def _ready(self) -> None:
        """What tasks share is computed on the driver, once."""
        self.search.grown  # noqa: B018
        if self.size <= DENSE:
            self.gathers  # noqa: B018

    def arrow(self) -> Callable[[Column], Column]:
        """The same as a column function on Arrow batches: struct<value, a_id>."""
        self._ready()

        @F.arrow_udf("struct<value:long,a_id:long>")
        def canonical(wfs):
            import pyarrow as pa

            rows = wfs.to_pylist()
            value, a_id = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
            for at in range(0, len(rows), SEARCHED):
                value[at : at + SEARCHED], a_id[at : at + SEARCHED] = self.minima(np.array(rows[at : at + SEARCHED], np.int64))
            return pa.StructArray.from_arrays([pa.array(value), pa.array(a_id)], ["value", "a_id"])

        return canonical

    def packed(self, nodes: DataFrame, batch: list[list[int]], id_col: str = "id", wf: str = "wf") -> DataFrame:
        """id, values: an array with the value under each vector of coefficients. A few vectors; one pass without penalties."""
        self._ready()
        dense = self.size <= DENSE
        own = [self.penalties(c) if dense else list(c) for c in batch]

        def scored(batches):
            import pyarrow as pa

            from slackline.plans.explore import lists_of

            for b in batches:
                rows, out = b.column(1).to_pylist(), np.zeros((b.num_rows, len(own)), np.int64)
                for at in range(0, len(rows), SEARCHED):
                    some = np.array(rows[at : at + SEARCHED], np.int64)
                    base = self.values(some) if dense else None
                    for i, c in enumerate(own):
                        out[at : at + SEARCHED, i] = (base - c).min(axis=1) if dense else self.search.minima(some, c)[0]
                yield pa.RecordBatch.from_arrays([b.column(0), lists_of(out)], ["id", "values"])

        return nodes.select(id_col, wf).mapInArrow(scored, "id long, values array<long>")

    def spread(self, nodes: DataFrame, places: int = 1, id_col: str = "id", wf: str = "wf") -> DataFrame:
        """id, value, a_id for few work functions and very many assignments: a task for each choice of the first places.

        The least of a part's first minima is the first minimum of all.
        """
        self.search.grown  # noqa: B018
        starts = list(product(range(len(self.choices)), repeat=places))

        @F.arrow_udf("long")
        def reached(wfs):
            import pyarrow as pa

            rows = wfs.to_pylist()
            return pa.array(self.search.descend(np.array(rows, np.int64), self.coefs) if rows else [], pa.int64())

        @F.arrow_udf("struct<value:long,a_id:long>")
        def part(wfs, limits, prefixes):
            import pyarrow as pa

            rows, limit, prefix = np.array(wfs.to_pylist(), np.int64), limits.to_numpy(), prefixes.to_numpy()
            value, a_id = np.zeros(len(prefix), np.int64), np.zeros(len(prefix), np.int64)
            for k in np.unique(prefix).tolist():
                same = np.flatnonzero(prefix == k)
                for at in range(0, len(same), SEARCHED):
                    few = same[at : at + SEARCHED]
                    value[few], a_id[few] = self.search.minima(rows[few], self.coefs, starts[k], limit[few])
            return pa.StructArray.from_arrays([pa.array(value), pa.array(a_id)], ["value", "a_id"])

        limited = nodes.select(id_col, wf).withColumn("limit", reached(wf))
        parts = limited.withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(len(starts) - 1)))).repartition(id_col, "start")
        best = parts.select(id_col, part(wf, "limit", "start").alias("p")).groupBy(id_col).agg(F.min("p").alias("best"))
        return best.select(id_col, "best.value", "best.a_id")

    def scores(self, nodes: DataFrame, candidates: DataFrame, id_col: str = "id", wf: str = "wf") -> DataFrame:
        """id, candidate_id, value for every candidate (candidate_id, coefs): one penalty-free pass serves all.

        Candidates of one batch are few; they are broadcast. Beyond ``DENSE`` assignments each is searched.
        """
        self._ready()
        dense = self.size <= DENSE
        batch = [(r["candidate_id"], self.penalties(r["coefs"]) if dense else list(r["coefs"])) for r in candidates.select("candidate_id", "coefs").collect()]
        sent = nodes.sparkSession.sparkContext.broadcast(batch)

        def scored(batches):
            import pyarrow as pa

            for b in batches:
                rows = b.column(1).to_pylist()
                for at in range(0, len(rows), SEARCHED):
                    wfs = np.array(rows[at : at + SEARCHED], np.int64)
                    base = self.values(wfs) if dense else None
                    for c, own in sent.value:
                        least = (base - own).min(axis=1) if dense else self.search.minima(wfs, own)[0]
                        yield pa.RecordBatch.from_arrays([b.column(0)[at : at + SEARCHED], pa.array(np.full(len(wfs), c)), pa.array(least)], ["id", "candidate_id", "value"])

        return nodes.select(id_col, wf).mapInArrow(scored, "id long, candidate_id long, value long")


Place = tuple[bool, int]


@dataclass(frozen=True)
class Stage:
    """An inner minimum: ``row`` and penalties name (inner?, place), places from 1, negative for antipodes."""

    n_inner: int
    row: list[Place]
    penalty_pairs: list[tuple[Place, Place, float]] = field(default_factory=list)
    inner_multiset: bool = True


@dataclass(frozen=True)
class Evader:
    """min over outer points of constant + outer penalties + the sum over stages of the least inner value."""

    context: Context
    n_outer: int
    stages: list[Stage]
    constant: float = 0.0
    outer_coefs: list[float] = field(default_factory=list)
    support: list[int] | None = None

    @classmethod
    def of(cls, context: Context, spec: dict, support: list[int] | None = None) -> Evader:
        stages = [Stage(int(s["n_inner"]), [(bool(a), int(b)) for a, b in s["row"]], [((bool(p[0]), int(p[1])), (bool(q[0]), int(q[1])), float(c)) for p, q, c in s.get("penalty_pairs", ())], bool(s.get("inner_multiset", True))) for s in spec["stages"]]
        return cls(context, int(spec["n_outer"]), stages, float(spec.get("constant", 0.0)), [float(c) for c in spec.get("outer_distance_coefs", ())], support)

    @classmethod
    def reduced(cls, context: Context) -> Evader:
        """k outer points; stage j lets j inner points stand for the first j, each paying its distance to point j."""
        k = context.k
        stages = [Stage(j, [(True, i + 1) for i in range(j)] + [(False, i + 1) for i in range(j, k)], [((True, i + 1), (False, j), -1.0) for i in range(j)]) for j in range(k + 1)]
        return cls(context, k, stages)

    def __post_init__(self):
        if self.n_outer < 0:
            raise ValueError("n_outer is not negative")
        if self.outer_coefs and len(self.outer_coefs) != self.n_outer * (self.n_outer - 1) // 2:
            raise ValueError("one coefficient for each pair of outer places")
        for stage in self.stages:
            if len(stage.row) != self.context.k:
                raise ValueError("every stage's row has k places")
            for inner, place in [*stage.row, *(p for a, b, _ in stage.penalty_pairs for p in (a, b))]:
                if not 1 <= abs(place) <= (stage.n_inner if inner else self.n_outer):
                    raise ValueError(f"no place {place}")
                if place < 0 and self.context.m % 2:
                    raise ValueError("antipodes need an even number of points")

    @cached_property
    def tables(self):
        """Outer penalties, and for each stage positions and penalties as [inner, outer]."""
        points = list(self.support if self.support is not None else range(self.context.m))
        d, m = np.array(self.context.distances), self.context.m
        outer = np.array(list(product(points, repeat=self.n_outer)), np.int64).reshape(len(points) ** self.n_outer, self.n_outer)
        base = np.full(len(outer), self.constant)
        for c, (i, j) in zip(self.outer_coefs, combinations(range(self.n_outer), 2)):
            base += c * d[outer[:, i], outer[:, j]]
        out = []
        for stage in self.stages:
            choose = combinations_with_replacement(points, stage.n_inner) if stage.inner_multiset else product(points, repeat=stage.n_inner)
            chosen = list(choose)
            inner = np.array(chosen, np.int64).reshape(len(chosen), stage.n_inner)
            shape = (len(inner), len(outer))

            def at(place, inner=inner, shape=shape):
                is_inner, p = place
                x = inner[:, abs(p) - 1][:, None] if is_inner else outer[:, abs(p) - 1][None, :]
                return np.broadcast_to(x if p > 0 else (x + m // 2) % m, shape)

            cfg = np.sort(np.stack([at(p) for p in stage.row], axis=-1), axis=-1)
            code = cfg @ (m ** np.arange(self.context.k)[::-1])
            values, back = np.unique(code, return_inverse=True)
            index = np.array([self.context.idx(tuple(v // m**i % m for i in reversed(range(self.context.k)))) for v in values.tolist()])
            penalty = np.zeros(shape)
            for a, b, c in stage.penalty_pairs:
                penalty = penalty + c * d[at(a), at(b)]
            out.append((index[back].reshape(shape), penalty))
        return base, out

    def __call__(self, wf: np.ndarray) -> tuple[float, dict]:
        base, stages = self.tables
        value = base.copy()
        for index, penalty in stages:
            value += (wf[index] + penalty).min(axis=0)
        best = int(value.argmin())
        return float(value[best]), {"idx": best}

    def arrow(self):
        self.tables  # noqa: B018  computed once, on the driver
        return arrow(self)


def within(nodes: DataFrame, potential: Callable[[Column], Column], seconds: float, blocks: int = 16, wf: str = "wf") -> DataFrame:
    """``distinct`` in blocks of work functions by hash, as far as time allows: phi is null where it did not come to.

    A block that time ends in is cancelled; those before it stay, so what is there is a fair sample.
    """
    import time

    from slackline.plans import scratch, search

    spark, until = nodes.sparkSession, time.monotonic() + seconds
    once = scratch.table(_classes(nodes, wf).withColumn("__block", F.pmod("__a", F.lit(blocks))), "distinct")
    done = None
    for b in range(blocks):
        part = once.where(F.col("__block") == b).select(*_KEY, potential(F.col(wf)).alias("phi"))
        written = search.within(spark, until - time.monotonic(), lambda part=part: scratch.table(part, "evaluated-block"))
        if written is None:
            break
        done = written if done is None else done.union(written)
    if done is None:
        kind = once.withColumn("phi", potential(F.col(wf))).schema["phi"].dataType
        return nodes.withColumn("phi", F.lit(None).cast(kind))
    return _keyed(nodes, wf).join(done, list(_KEY), "left").drop(*_KEY)


#: Columns that tell work functions apart: two hashes of 64 bits.
_KEY = ("__a", "__b")


def _keyed(nodes: DataFrame, wf: str) -> DataFrame:
    return nodes.withColumn("__a", F.xxhash64(wf)).withColumn("__b", F.xxhash64(F.size(wf), wf))


def _classes(nodes: DataFrame, wf: str) -> DataFrame:
    """__a, __b and one work function of each class of equal ones."""
    return _keyed(nodes.select(wf), wf).where(F.col(wf).isNotNull()).distinct()  # by hash: an array in a buffer would sort


def distinct(nodes: DataFrame, potential: Callable[[Column], Column], wf: str = "wf") -> DataFrame:
    """``nodes`` with ``phi``: the potential is evaluated once for each distinct work function, then joined back.

    Classes are told by 128 bits of hashes, so what comes back is two numbers and a value, never a work function. A null
    work function has a null phi. The aggregation also keeps computed work functions out of the Python function's
    arguments, where Spark can fail to plan higher-order functions.
    """
    once = _classes(nodes, wf).select(*_KEY, potential(F.col(wf)).alias("phi"))
    return _keyed(nodes, wf).join(once, list(_KEY), "left").drop(*_KEY)


def looked_up(nodes: DataFrame, table: DataFrame, default: float = 0) -> DataFrame:
    """``nodes`` with phi from a table (wf, phi); the default where it has none."""
    return nodes.join(table, "wf", "left").withColumn("phi", F.coalesce("phi", F.lit(default)))


#: Potentials that are one expression.
SIMPLE = {"zero": lambda wf: F.lit(0).cast("long"), "sum": arrays.total, "min": F.array_min}
