"""A staged search whose stages run at the same time, with a log to go on from.

Each stage is a consumer with a bounded queue of its own, best candidates first: A counts all edges of a small instance, B an
adaptive subset of the big one's, C estimates from a sample in bounded time, D counts all edges. A stage takes a batch, scores
it in one Spark job (in its job group and scheduler pool) and hands on what passes; a full queue drops its worst candidate, and
proposals wait while the first queue is full. When time is up, what still runs is cancelled.

Every result is appended to a log, a table in the shared folder; now and then the whole state is written as a snapshot.
A run that finds them goes on where the last one stopped: what was done is not done again, what was under way is.
"""

from __future__ import annotations

import bisect
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slackline.operators import ranking
from slackline.operators import search as ops
from slackline.operators.potentials import Canonical
from slackline.plans import scratch, search
from slackline.plans.control import stage_c_seconds

NAMES = ("a", "b", "c", "d")
#: Candidates that wait before a stage, and that a stage scores in one job.
CAPACITY = {"a": 64, "b": 64, "c": 32, "d": 16}
BATCH = {"a": 16, "b": 8, "c": 4, "d": 2}
#: Parts of the sample that C looks at, one after another, while there is time.
BLOCKS = 4
SNAPSHOT_SECONDS = 30.0


class Scores:
    """What the stages compute, each for a batch {id: coefficients}. Instances are (nodes, edges with edge_id, from, to, weight)."""

    def __init__(self, potential: Canonical, small: tuple[DataFrame, DataFrame], big_potential: Canonical, big: tuple[DataFrame, DataFrame], share: float = 0.05, seconds: Callable[[float], float] = stage_c_seconds):
        self.spark = small[0].sparkSession
        self.potential, self.small, self.big_potential, self.seconds = potential, small, big_potential, seconds
        self.big = big[0].select("id", "wf"), big[1].select("edge_id", "from", "to", "weight")
        self.total = self.big[1].count()
        blocked = ranking.hash_sample(self.big[1], "edge_id", share).withColumn("block", F.pmod(F.xxhash64("edge_id", F.lit(3)), F.lit(BLOCKS)))
        self.sample = scratch.table(blocked, "search-sample")
        self.ends = scratch.table(self._ends(self.sample), "search-sample-nodes")
        self.cache(self.big[1].select("edge_id").limit(0))

    def _ends(self, edges: DataFrame) -> DataFrame:
        """The nodes that edges have as ends: nothing else is scored for them."""
        ids = edges.select(F.col("from").alias("id")).union(edges.select(F.col("to").alias("id"))).distinct()
        return self.big[0].join(ids, "id", "left_semi")

    def cache(self, edge_ids: DataFrame) -> None:
        """The edges that B looks at from now on."""
        self.near = scratch.table(self.big[1].join(edge_ids.select("edge_id"), "edge_id", "left_semi"), "search-cache")
        self.near_ends = scratch.table(self._ends(self.near), "search-cache-nodes")

    def a(self, batch: dict[int, list[int]]) -> dict[int, int]:
        return dict(zip(batch, search.violations(self.potential, *self.small, list(batch.values()))))

    def b(self, batch: dict[int, list[int]]) -> dict[int, int]:
        return dict(zip(batch, search.violations(self.big_potential, self.near_ends, self.near, list(batch.values()))))

    def c(self, batch: dict[int, list[int]], b: dict[int, int]) -> dict[int, float]:
        """Violations in the sample over the share that was looked at: all in one job a block, each while its own time lasts."""
        began, hit, seen = time.monotonic(), dict.fromkeys(batch, 0), dict.fromkeys(batch, 0)
        for block in range(BLOCKS):
            left = {i: self.seconds(b[i]) - (time.monotonic() - began) for i in batch}
            open_ = {i: x for i, x in batch.items() if left[i] > 0}
            if not open_:
                break
            edges = self.sample.where(F.col("block") == block)
            tried = search.hits(self.big_potential, self.ends, edges, open_).groupBy("candidate_id").agg(F.count("*").alias("n"), F.count_if("hit").alias("hit"))
            for r in search.within(self.spark, max(left.values()), tried.collect) or []:  # a row for each candidate
                hit[r["candidate_id"]] += r["hit"]
                seen[r["candidate_id"]] += r["n"]
        return {i: hit[i] * self.total / seen[i] if seen[i] else float("inf") for i in batch}

    def d(self, batch: dict[int, list[int]]) -> dict[int, int]:
        return dict(zip(batch, search.violations(self.big_potential, *self.big, list(batch.values()))))


class Waiting:
    """Candidates in order of their keys; beyond ``capacity`` the last goes."""

    def __init__(self, capacity: int):
        self.capacity, self.held = capacity, []

    def put(self, key: tuple, candidate: int) -> int | None:
        """The candidate that has to go, if one has."""
        bisect.insort(self.held, (key, candidate))
        return self.held.pop()[1] if len(self.held) > self.capacity else None

    def take(self, n: int) -> list[int]:
        out, self.held = [c for _, c in self.held[:n]], self.held[n:]
        return out


class Log:
    """Results in order, appended to a table at ``path``, and snapshots of all candidates."""

    SCHEMA = "seq long, candidate_id long, coefs array<long>, stage string, value double"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.seq, self.lock = spark, path.rstrip("/"), 0, threading.Lock()

    def append(self, rows: list[tuple[int, list[int] | None, str, float | None]]) -> None:
        with self.lock:
            numbered = [(self.seq + i, *r) for i, r in enumerate(rows)]
            self.seq += len(rows)
            self.spark.createDataFrame(numbered, self.SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def snapshot(self, upto: int, records: dict[int, dict]) -> None:
        """All that is known: at least what the log's rows before ``upto`` say."""
        with self.lock:
            rows = [(0, i, r["coefs"], "new", None) for i, r in records.items()] + [(0, i, None, s, None if r[s] is None else float(r[s])) for i, r in records.items() for s in (*NAMES, "dropped") if r.get(s) is not None]
            self.spark.createDataFrame(rows, self.SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/snapshot/upto={upto}")

    def _read(self, name: str, schema: str) -> list:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}").collect()  # the candidates of one search
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return []
            raise

    def replay(self) -> dict[int, dict]:
        """Candidates as the last snapshot has them, and what the log says since."""
        held = self._read("snapshot", self.SCHEMA + ", upto long")
        upto = max((r["upto"] for r in held), default=0)
        later = sorted((r for r in self._read("log", self.SCHEMA) if r["seq"] >= upto), key=lambda r: r["seq"])
        self.seq = max([upto, *(r["seq"] + 1 for r in later)])
        rows = [*(r for r in held if r["upto"] == upto), *later]
        records = {r["candidate_id"]: {"coefs": list(r["coefs"])} for r in rows if r["stage"] == "new"}
        found = {(r["candidate_id"], r["stage"]): r["value"] for r in rows}
        for i, r in records.items():  # threads log as they come: what lacks something before it is done again
            for s in NAMES:
                if (i, s) not in found:
                    break
                r[s] = found[i, s]
            if (i, "dropped") in found:
                r["dropped"] = found[i, "dropped"]
        return records


@dataclass
class Pipeline:
    """Runs the stages of ``scores`` (``Scores``, or anything with its a, b, c and d).

    ``propose(records, n)`` gives up to ``n`` vectors to try next, none to end; it sees all that is known. ``most``: the largest
    a and b that pass. ``worked`` has (stage, begin, end, ids) of every batch.
    """

    spark: SparkSession
    scores: Scores
    propose: Callable[[dict[int, dict], int], list[list[int]] | None]
    most: dict[str, int] = field(default_factory=lambda: dict(ops.MOST))
    capacity: dict[str, int] = field(default_factory=lambda: dict(CAPACITY))
    batch: dict[str, int] = field(default_factory=lambda: dict(BATCH))
    log: Log | None = None
    snapshot_seconds: float = SNAPSHOT_SECONDS

    def __post_init__(self):
        self.records: dict[int, dict] = self.log.replay() if self.log else {}
        self.waiting = {s: Waiting(self.capacity[s]) for s in NAMES}
        self.worked: list[tuple[str, float, float, list[int]]] = []
        self.busy, self.ended, self.failed = dict.fromkeys(NAMES, 0), set(), None
        self.change, self.stop = threading.Condition(), threading.Event()
        self.groups = {s: f"slackline-stage-{s}-{uuid.uuid4().hex}" for s in NAMES}
        self.next = 1 + max(self.records, default=-1)
        for i in sorted(self.records):
            self._hand_on(i)

    def _key(self, stage: str, i: int) -> tuple:
        r = self.records[i]
        size = sum(map(bool, r["coefs"])), sum(map(abs, r["coefs"]))
        return {"a": (i,), "b": (r.get("a"), *size, i), "c": (r.get("b"), *size, i), "d": (r.get("c"), r.get("b"), i)}[stage]

    def _hand_on(self, i: int) -> list[tuple]:
        """Puts a candidate before its next stage; rows for the log of one that has to go."""
        r = self.records[i]
        if "dropped" in r:
            return []
        done = [s for s in NAMES if s in r]
        if done and done[-1] in ("a", "b") and r[done[-1]] > self.most[f"stage_{done[-1]}"] or len(done) == len(NAMES):
            return []
        stage = NAMES[len(done)]
        gone = self.waiting[stage].put(self._key(stage, i), i)
        if gone is None:
            return []
        self.records[gone]["dropped"] = NAMES.index(stage)
        return [(gone, None, "dropped", float(NAMES.index(stage)))]

    def _write(self, rows: list[tuple]) -> None:
        if self.log and rows:
            self.log.append(rows)

    def _over(self, stage: str) -> bool:
        """Whether nothing can come to a stage any more."""
        before = NAMES[: NAMES.index(stage)]
        return "propose" in self.ended and not any(self.busy[s] or self.waiting[s].held for s in before)

    def _proposer(self) -> None:
        while not self.stop.is_set():
            with self.change:
                while not self.stop.is_set() and (room := self.capacity["a"] - len(self.waiting["a"].held)) <= 0:
                    self.change.wait(0.1)
                if self.stop.is_set():
                    return
                known = {i: dict(r) for i, r in self.records.items()}
            found = self.propose(known, room)
            with self.change:
                if found is None:
                    self.ended.add("propose")
                    self.change.notify_all()
                    return
                rows, seen = [], {tuple(r["coefs"]) for r in self.records.values()}
                for c in found:
                    if tuple(c) not in seen:
                        seen.add(tuple(c))
                        self.records[self.next] = {"coefs": list(c)}
                        rows += [(self.next, list(c), "new", None), *self._hand_on(self.next)]
                        self.next += 1
                self.change.notify_all()
            self._write(rows)
            if not found:
                time.sleep(0.05)  # it waits for results

    def _consumer(self, stage: str) -> None:
        sc = self.spark.sparkContext
        sc.setLocalProperty("spark.scheduler.pool", f"stage-{stage}")  # shares of the cluster under a fair scheduler
        while not self.stop.is_set():
            with self.change:
                while not self.stop.is_set() and not self.waiting[stage].held:
                    if self._over(stage):
                        self.change.notify_all()
                        return
                    self.change.wait(0.1)
                if self.stop.is_set():
                    return
                ids = self.waiting[stage].take(self.batch[stage])
                self.busy[stage] = len(ids)
                batch = {i: self.records[i]["coefs"] for i in ids}
                more = [{i: self.records[i]["b"] for i in ids}] if stage == "c" else []
                self.change.notify_all()
            sc.setJobGroup(self.groups[stage], f"slackline stage {stage}", interruptOnCancel=True)
            began = time.monotonic()
            try:
                got = getattr(self.scores, stage)(batch, *more)
            finally:
                sc.setLocalProperty("spark.jobGroup.id", None)  # what is logged is not cancelled
            if self.stop.is_set() and stage == "c":
                return  # its time may have been cut short
            with self.change:
                rows = [(i, None, stage, float(got[i])) for i in ids]  # known before they are logged: see snapshot
                for i in ids:
                    self.records[i][stage] = got[i]
                    rows += self._hand_on(i)
                self.worked.append((stage, began, time.monotonic(), ids))
                self.busy[stage] = 0
                self.change.notify_all()
            self._write(rows)

    def run(self, seconds: float = float("inf")) -> dict[int, dict]:
        """Records by candidate: coefs, a to d as far as it came, dropped (the stage whose queue was full)."""

        def guarded(work, *args):
            def go():
                try:
                    work(*args)
                except BaseException as e:
                    if not self.stop.is_set():
                        self.failed = e
                        self.stop.set()

            return threading.Thread(target=inheritable_thread_target(self.spark)(go))

        threads = [guarded(self._proposer), *(guarded(self._consumer, s) for s in NAMES)]
        until, last = time.monotonic() + seconds, time.monotonic()
        for t in threads:
            t.start()
        while any(t.is_alive() for t in threads):
            if time.monotonic() > until:
                self.stop.set()
            if self.stop.is_set():
                for g in self.groups.values():
                    self.spark.sparkContext.cancelJobGroup(g)
            elif self.log and time.monotonic() - last > self.snapshot_seconds:
                upto = self.log.seq  # before what is known is looked at
                with self.change:
                    known = {i: dict(r) for i, r in self.records.items()}
                self.log.snapshot(upto, known)
                last = time.monotonic()
            time.sleep(0.05)
        for t in threads:
            t.join()
        if self.failed:
            raise self.failed
        return self.records
