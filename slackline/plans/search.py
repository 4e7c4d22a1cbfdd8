"""Candidate search: families propose, Spark jobs score, families are told.

A task scores a batch of candidates, not one: a job's fixed cost is shared, and one pass over the nodes serves all of
a batch. Tasks run as job groups, so that one that takes too long is cancelled on the cluster as well.
"""

from __future__ import annotations

import time
import uuid
from collections import deque
from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass
from typing import Protocol

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slackline.functions import arrays
from slackline.operators import ranking
from slackline.operators import search as ops
from slackline.operators.potentials import Canonical
from slackline.plans import scratch
from slackline.plans.control import stage_c_seconds

#: How often a task that was cancelled or failed is tried again.
REQUEUES = 5


class Family(Protocol):
    def ask(self) -> list[list[int]] | None:
        """Coefficients to try next; an empty list to wait for results, none to stop."""

    def tell(self, coefs: list[int], violations: int | None) -> None:
        """``violations`` is none where no try succeeded."""

    def finalize(self) -> list[list[int]]:
        """The recommended coefficients, best first."""


class Job:
    """A function with Spark jobs of its own, in a thread and a job group that can be cancelled."""

    def __init__(self, spark: SparkSession, pool: ThreadPoolExecutor, work: Callable):
        self.spark, self.group, self.began, self.cancelled = spark, f"slackline-{uuid.uuid4().hex}", time.monotonic(), False

        def grouped():
            self.began = time.monotonic()
            spark.sparkContext.setJobGroup(self.group, "slackline search", interruptOnCancel=True)
            return work()

        self.future: Future = pool.submit(inheritable_thread_target(spark)(grouped))

    def cancel(self) -> None:
        self.cancelled = True
        self.future.cancel()
        self.spark.sparkContext.cancelJobGroup(self.group)


def within(spark: SparkSession, seconds: float, work: Callable):
    """``work()``, or none if it takes longer: then its Spark jobs are cancelled."""
    with ThreadPoolExecutor(1) as pool:
        job = Job(spark, pool, work)
        done, _ = wait([job.future], timeout=min(max(0.0, seconds), 1e6))
        if done:
            return job.future.result()
        job.cancel()
        wait([job.future])
        return None


def hits(potential: Canonical, nodes: DataFrame, edges: DataFrame, coefs: dict[int, list[int]]) -> DataFrame:
    """candidate_id, the columns of ``edges``, and whether the edge is violated (``hit``), for every candidate.

    A node's scores travel as one array, so edges are joined once, whatever the number of candidates.
    """
    scored = potential.packed(nodes, list(coefs.values()))
    both = edges.join(scored.toDF("from", "__pu"), "from").join(scored.toDF("to", "__pv"), "to")
    ids = F.array(*(F.lit(i).cast("long") for i in coefs))
    each = F.arrays_zip(ids.alias("id"), F.zip_with("__pv", "__pu", lambda v, u: v - u).alias("d"))
    rows = both.select(*edges.columns, F.explode(each).alias("__c"))
    return rows.select(F.col("__c.id").alias("candidate_id"), *edges.columns, (F.col("__c.d") + F.col("weight") < 0).alias("hit"))


def violations(potential: Canonical, nodes: DataFrame, edges: DataFrame, coefs: list[list[int]]) -> list[int]:
    """Violated edges of each candidate, in one job."""
    found = hits(potential, nodes, edges.select("from", "to", "weight"), dict(enumerate(coefs))).groupBy("candidate_id").agg(F.count_if("hit").alias("n")).collect()  # a row for each candidate
    by = {r["candidate_id"]: r["n"] for r in found}
    return [by.get(i, 0) for i in range(len(coefs))]


@dataclass
class Scan:
    """Violations in the edges that were looked at; ``complete`` if those are all."""

    violations: int
    processed: int
    total: int
    complete: bool

    @property
    def estimate(self) -> float:
        return self.violations * self.total / self.processed if self.processed else float("inf")


def scan(tried: DataFrame, cutoff: int | None = None, seconds: float = float("inf"), blocks: int = 16, seed: int = 42) -> Scan:
    """Counts the hits of ``tried`` (edge_id, hit) in an order permuted by hash, block by block.

    It stops once there are more than ``cutoff``, or when time is up: what is counted so far is a fair sample.
    ``tried`` is written once, by blocks.
    """
    spark, until = tried.sparkSession, time.monotonic() + seconds
    blocked = scratch.path(spark, "scan")
    block_of = F.floor(arrays.portable_hash(F.col("edge_id"), seed) * blocks / arrays.MODULUS).cast("int")
    tried.select("hit", block_of.alias("block")).write.partitionBy("block").parquet(blocked)  # a block is read alone then
    scratch.forget_at_exit(spark, blocked)
    rows = spark.read.schema("hit boolean, block int").parquet(blocked)
    total, found = rows.count(), Scan(0, 0, 0, True)
    found.total = total
    for b in range(blocks):
        block = rows.where(F.col("block") == b)
        row = within(spark, until - time.monotonic(), lambda block=block: block.agg(F.count("*"), F.count_if("hit")).first())
        if row is None:
            found.complete = False
            return found
        found.processed += row[0]
        found.violations += row[1]
        if cutoff is not None and found.violations > cutoff:
            found.complete = found.processed == total
            return found
    return found


def search(
    family: Family,
    potential: Canonical,
    nodes: DataFrame,
    edges: DataFrame,
    seconds: float,
    in_flight: int = 2,
    task_seconds: float = 600.0,
    requeues: int = REQUEUES,
    score: Callable[[list[list[int]]], list[int]] | None = None,
) -> list[tuple[int, list[int]]]:
    """(violations, coefficients) of the family's recommendations, best first, ties in its order.

    At most ``in_flight`` batches are scored at a time, and as many wait. A task that takes over ``task_seconds`` is
    cancelled and queued again, ``requeues`` times at most; what is left when time is up is cancelled.
    """
    spark = nodes.sparkSession
    score = score or (lambda batch: violations(potential, nodes, edges, batch))
    until, seen, asking = time.monotonic() + seconds, {}, True
    queue: deque[tuple[list[list[int]], int]] = deque()
    running: dict[Future, tuple[Job, list[list[int]], int]] = {}
    pending: set[tuple] = set()
    pool = ThreadPoolExecutor(in_flight)

    def settle(batch, result):
        for c, v in zip(batch, result):
            pending.discard(tuple(c))
            if v is not None:
                seen[tuple(c)] = v
            family.tell(c, v)

    try:
        while time.monotonic() < until:
            while asking and len(queue) < in_flight:
                batch = family.ask()
                if batch is None:
                    asking = False
                elif not batch:
                    break
                else:
                    for c in (c for c in batch if tuple(c) in seen):
                        family.tell(c, seen[tuple(c)])
                    fresh = [list(c) for c in dict.fromkeys(map(tuple, batch)) if c not in seen and c not in pending]
                    if fresh:
                        pending.update(map(tuple, fresh))
                        queue.append((fresh, 0))
            while queue and len(running) < in_flight:
                batch, tries = queue.popleft()
                job = Job(spark, pool, lambda batch=batch: score(batch))
                running[job.future] = (job, batch, tries)
            if not running:
                break
            done, _ = wait(running, timeout=min(0.2, task_seconds), return_when=FIRST_COMPLETED)
            for f in done:
                job, batch, tries = running.pop(f)
                if not f.cancelled() and f.exception() is None:
                    settle(batch, f.result())
                elif tries < requeues:
                    queue.append((batch, tries + 1))
                elif job.cancelled:
                    settle(batch, [None] * len(batch))
                else:
                    raise f.exception()
            for job, *_ in running.values():
                if not job.cancelled and time.monotonic() - job.began > task_seconds:
                    job.cancel()
    finally:
        for job, *_ in running.values():
            job.cancel()
        pool.shutdown(wait=True, cancel_futures=True)
    chosen = family.finalize()
    missing = [c for c in chosen if tuple(c) not in seen]
    if missing:
        seen |= {tuple(c): v for c, v in zip(missing, score(missing))}
    return sorted(((seen[tuple(c)], c) for c in chosen), key=lambda r: r[0])


class Fixed:
    """No search: given vectors are tried once, and all are recommended."""

    def __init__(self, coefs: list[list[int]]):
        self.coefs, self.left = coefs, [coefs]

    def ask(self):
        return self.left.pop() if self.left else None

    def tell(self, coefs, violations):
        pass

    def finalize(self):
        return self.coefs


class _Best:
    """Keeps the best results; the sort is by violations, then coefficients."""

    kept = 12

    def __init__(self):
        self.best: list[tuple[int, list[int]]] = []

    def tell(self, coefs, violations):
        if violations is not None and (violations, list(coefs)) not in self.best:
            self.best = sorted([*self.best, (violations, list(coefs))])[: self.kept]

    def finalize(self):
        return [c for _, c in self.best[:3]]


class Sampling(_Best):
    """Random vectors of one recipe, batch by batch, without looking at results."""

    def __init__(self, spark: SparkSession, n_coefs: int, batch: int = 8, rounds: int = 4, recipe: str = "seed_dense", frozen: int = 0, seed: int = 0):
        super().__init__()
        self.spark, self.n, self.batch, self.rounds, self.recipe, self.frozen, self.next = spark, n_coefs, batch, rounds, recipe, frozen, seed

    def ask(self):
        if not self.rounds:
            return None
        self.rounds -= 1
        draws = [(self.next + i, self.recipe, [0] * self.n) for i in range(self.batch)]
        self.next += self.batch
        return vectors(self.spark, draws, self.frozen)


class Climb(_Best):
    """Mutations of the best so far, of a seed at first; a round waits for the one before."""

    def __init__(self, seed: list[int], batch: int = 8, rounds: int = 4, frozen: int = 0, spark: SparkSession | None = None):
        super().__init__()
        self.seed, self.batch, self.rounds, self.frozen = list(seed), batch, rounds, frozen
        self.spark, self.drawn, self.open = spark or SparkSession.active(), 0, set()

    def ask(self):
        if self.open:
            return []
        if not self.rounds:
            return None
        self.rounds -= 1
        parent = self.best[0][1] if self.best else self.seed
        names = [f for f in ops.RECIPES if f != "seed_dense"]
        draws = [(self.drawn + i, names[i % len(names)], parent) for i in range(self.batch - 1)]
        self.drawn += len(draws)
        out = [parent, *vectors(self.spark, draws, self.frozen)]
        self.open = {tuple(c) for c in out if not any(c == b for _, b in self.best)}
        return out

    def tell(self, coefs, violations):
        self.open.discard(tuple(coefs))
        super().tell(coefs, violations)


def vectors(spark: SparkSession, draws: list[tuple[int, str, list[int]]], frozen: int = 0) -> list[list[int]]:
    """The vectors of a batch of draws (id, family, parent's coefficients)."""
    if not draws:
        return []
    made = ops.mutated(spark.createDataFrame(draws, "draw_id long, family string, coefs array<long>"), frozen)
    return [list(r["coefs"]) for r in made.orderBy("draw_id").collect()]  # a batch


CANDIDATES = "candidate_id long, family string, parent_id long, coefs array<long>, stage_a long, stage_b long, stage_c double, stage_d long"


def staged(
    potential: Canonical,
    small: tuple[DataFrame, DataFrame],
    big_potential: Canonical,
    big: tuple[DataFrame, DataFrame],
    families: list[str],
    rounds: int = 3,
    batch: int = 8,
    full: int = 2,
    frozen: int = 0,
    most: dict[str, int] = ops.MOST,
    seconds: Callable[[float], float] = stage_c_seconds,
) -> DataFrame:
    """All candidates (``CANDIDATES``) of a staged search; a stage that a candidate didn't reach is null.

    Rounds one after another; ``stages.Pipeline`` runs the same stages at once. A round draws families by what they earned, takes parents from their pools and mutates them. Stage A counts all
    edges of a small instance. B counts an adaptive subset of the big one's edges (``edge_pools``). C looks at a sample of 5 %
    within a time that falls as B's count grows, and extrapolates. D counts all edges,
    for the ``full`` best by C. ``small`` and ``big`` are (nodes, edges with edge_id, from, to, weight).
    """
    from slackline.plans.stages import Scores

    spark = small[0].sparkSession
    n = potential.n * (potential.n - 1) // 2
    known = spark.createDataFrame([], CANDIDATES)
    history = spark.createDataFrame([], "step long, candidate_id long, edge_id long")
    big_edges = big[1].select("edge_id", "from", "to", "weight")
    scores = Scores(potential, small, big_potential, big, seconds=seconds)
    made = 0
    for step in range(rounds):
        earned = known.join(ops.lineage_credit(known), "candidate_id").groupBy("family").agg(F.sum("credit").alias("credit"))
        weight = F.greatest(F.lit(ops.LEAST_REWARD), F.coalesce("credit", F.lit(1.0)))
        base = F.coalesce(*(F.when(F.col("family") == f, w) for f, w in ops.BASE_WEIGHTS.items()), F.lit(1.0))
        weights = spark.createDataFrame([(f,) for f in families], "family string").join(earned, "family", "left").select("family", (base * weight).alias("weight"))
        draws = spark.range(made, made + batch).select(F.col("id").alias("draw_id"), (arrays.portable_hash(F.col("id"), 8) / arrays.MODULUS).alias("draw"))
        chosen = scratch.table(ops.parents(known, ops.weighted_choice(weights, draws), n), "search-parents")
        children = ops.mutated(chosen.select("draw_id", "family", "coefs"), frozen)
        fresh = children.join(chosen.select("draw_id", "parent_id"), "draw_id").join(known.select("coefs"), "coefs", "left_anti")
        first = fresh.groupBy("coefs").agg(F.min(F.struct("draw_id", "family", "parent_id")).alias("c")).select("c.*", "coefs").orderBy("draw_id").collect()  # a batch
        made += batch
        if not first:
            continue
        coefs = {r["draw_id"]: list(r["coefs"]) for r in first}
        a = scores.a(coefs)
        passed = {i: x for i, x in coefs.items() if a[i] <= most["stage_a"]}
        b: dict[int, int] = {}
        c: dict[int, float] = {}
        d: dict[int, int] = {}
        if passed:
            scores.cache(ranking.edge_cache(ops.edge_pools(history, big_edges)))
            b = scores.b(passed)
        passed = {i: x for i, x in passed.items() if b[i] <= most["stage_b"]}
        if passed:
            c = scores.c(passed, b)
        best = sorted(c, key=lambda i: (c[i], b[i], i))[:full]
        if best:
            every = scratch.table(hits(big_potential, big[0], big_edges, {i: passed[i] for i in best}).select("candidate_id", "edge_id", "hit"), "search-d")
            counted = every.groupBy("candidate_id").agg(F.count_if("hit").alias("n")).collect()  # ``full`` rows
            d = {r["candidate_id"]: r["n"] for r in counted}
            history = scratch.table(history.union(every.where("hit").select(F.lit(step).cast("long"), "candidate_id", "edge_id")), "search-history")
        rows = [(r["draw_id"], r["family"], r["parent_id"], coefs[r["draw_id"]], *(x.get(r["draw_id"]) for x in (a, b, c, d))) for r in first]
        known = scratch.table(known.union(spark.createDataFrame(rows, CANDIDATES)), "search-known")
    return known

