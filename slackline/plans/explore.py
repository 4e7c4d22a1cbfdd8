"""State graphs: exploration to a fixpoint, level by level, by hashes.

A level expands the newest work functions by every transition in Arrow batches, and what it reaches is shuffled as a
128-bit hash of the values, a 64-bit check and one number, source * transitions + transition: never as values. Of equal hashes
the least number stays (differing checks under one hash raise), and an anti join on hashes finds what is new. Ids are the order
of discovery, since the numbers of a level are ordered as its paths are. Only then the values of new nodes are made, from their
sources', and verified against their hashes; each level is written once. Edges are made in one pass at the end that joins hashes to ids.

``visited``: a ``Bloom`` set in front of the anti join (``plans/visited.py``). With a potential, each level's edges are checked as
soon as both ends have one, and violations come with their paths. A level's tables are written to the shared folder: the
lineage stays short, a lost executor costs one level at most. Each level's event has what ``DataFrame.observe`` and Spark's own
counters say of it, without a job of its own.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from slackline.operators.configs import Context
from slackline.plans import scratch
from slackline.plans.numbering import numbered
from slackline.plans.visited import Bloom


def point_transitions(m: int) -> list[tuple[str, int, int]]:
    return [("point", p, p) for p in range(m)]


def ride_transitions(m: int) -> list[tuple[str, int, int]]:
    """On a doubled circle of 2m points: a request at each even point, then rides from odd to even points."""
    return [("point", p, p) for p in range(0, 2 * m, 2)] + [("ride", s, t) for s in range(1, 2 * m, 2) for t in range(0, 2 * m, 2)]


def transitions(spark: SparkSession, found: list[tuple[str, int, int]]) -> DataFrame:
    return spark.createDataFrame([(i, k, s, t) for i, (k, s, t) in enumerate(found)], "ord long, kind string, s long, t long")


def symmetries(context: Context, step: int = 1) -> np.ndarray:
    """Rows of positions: the circle's rotations by multiples of ``step``, each plain and reflected."""
    m, rows = context.m, []
    for r in range(0, m, step):
        for sign in (1, -1):
            rows.append([context.idx(tuple((sign * p + r) % m for p in cfg)) for cfg in context.configs])
    return np.array(rows)


#: Positions that images are told apart by at once; what is still tied after them is compared whole, row by row.
LEADING = 64


def canonical(wfs: np.ndarray, perms: np.ndarray) -> np.ndarray:
    """The lexicographically least image of each row under the permutations.

    Images that aren't least at a position drop out; most rows have one left after a few positions.
    """
    alive, rows = np.ones((len(wfs), len(perms)), bool), np.arange(len(wfs))
    for j in range(min(LEADING, wfs.shape[1])):
        values = np.where(alive[rows], wfs[rows[:, None], perms[:, j][None, :]], np.iinfo(wfs.dtype).max)
        alive[rows] &= values == values.min(axis=1, keepdims=True)
        if j % 8 == 7:
            rows = rows[alive[rows].sum(axis=1) > 1]
            if not len(rows):
                break
    best = alive.argmax(axis=1)
    for r in rows.tolist():
        for p in np.flatnonzero(alive[r])[1:].tolist():
            one, other = wfs[r, perms[best[r]]], wfs[r, perms[p]]
            differ = np.flatnonzero(one != other)
            if len(differ) and other[differ[0]] < one[differ[0]]:
                best[r] = p
    return np.take_along_axis(wfs, perms[best], axis=1)


def symmetry_step_of(moves: list[tuple[str, int, int]]) -> int:
    """Rides tell odd points from even ones, so their circles turn by two."""
    return 2 if any(kind == "ride" for kind, *_ in moves) else 1


def digests(wfs: np.ndarray) -> np.ndarray:
    """[row, 24 bytes]: of every row's values 128 bits to tell it by, and 64 to check them."""
    rows = np.ascontiguousarray(wfs, "<i8")
    return np.frombuffer(b"".join(hashlib.blake2b(row, digest_size=24).digest() for row in rows), np.uint8).reshape(-1, 24)


def hashes_of(found: np.ndarray):
    """Digests as Arrow columns: the hashes, and the checks as longs."""
    import pyarrow as pa

    names = pa.array([row.tobytes() for row in found[:, :16]], pa.binary())
    return names, pa.array(np.ascontiguousarray(found[:, 16:]).view("<i8").ravel())


def rows_of(column) -> np.ndarray:
    """An Arrow column of equally long lists as a matrix, from its flat buffer."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def lists_of(matrix: np.ndarray, kind=np.int64):
    """A matrix as an Arrow column of lists."""
    import pyarrow as pa

    n, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(np.ascontiguousarray(matrix, kind).ravel()))


@dataclass
class Graph:
    """nodes: id, depth, path, wf (least value 0); edges: edge_id, from, to, request, d_min, ext, weight, a bag.

    A path is the number of its start and then the requests. ``violations`` (path of the edge's first node, request,
    slack) is there if a potential was checked; ``complete`` is false if the exploration was stopped by them.
    """

    context: Context
    nodes: DataFrame
    edges: DataFrame
    levels: list[int]
    violations: DataFrame | None = None
    complete: bool = True
    events: list[dict] = field(default_factory=list)


#: Rows of work functions that a task expands at a time.
CHUNK = 256
#: New nodes up to which one task puts a level in order; each is some thirty bytes there.
ORDERED = 1 << 16


class Levels:
    """Tables of one kind, a folder for each level, read as one."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.paths, self.schema = spark, scratch.path(spark, name), [], None

    def add(self, df: DataFrame) -> DataFrame:
        """``df``, written as the next level."""
        path, self.schema = f"{self.root}/level-{len(self.paths)}", df.schema
        df.write.parquet(path)
        scratch.forget_at_exit(self.spark, path)
        self.paths.append(path)
        return self.read([path])

    def read(self, paths: list[str] | None = None) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*(paths or self.paths))


def in_order(found: DataFrame, by: str, n: int, first: int) -> DataFrame:
    """``found`` with ``id``: first, first + 1, ... in the order of ``by``, which has no ties."""
    if n > ORDERED:
        return numbered(found, [by]).withColumn("id", F.col("id") + first)
    return found.repartition(1).sortWithinPartitions(by).withColumn("id", F.monotonically_increasing_id() + F.lit(first))


def explore(
    spark: SparkSession,
    context: Context,
    starts: list | DataFrame,
    moves: list[tuple[str, int, int]],
    symmetry_step: int | str | None = None,
    max_levels: int = 1_000,
    potential: Callable[[Column], Column] | None = None,
    rho: float | None = None,
    stop_after: int | None = None,
    hook: Callable[[str, dict], None] | None = None,
    visited: Bloom | None = None,
) -> Graph:
    """All work functions that requests reach from the starts, and every transition between them.

    ``starts``: configurations, or a table (start long, wf array<long>) of work functions, of which equal ones are one
    node with the least number. With ``symmetry_step`` ("auto": by the kind of moves) the nodes are classes under the circle's
    symmetries. Ids are the order of discovery: by depth, then by least path. ``potential`` is checked level by level with ``rho``
    (k unless given); the exploration stops after a level that brings the violations over ``stop_after``. ``hook(event, facts)``
    is told of start, level (depth, nodes, and of the step that made them: rows expanded, rows reached that no chunk repeats, new ones, seconds and
    Spark's counters), violations (depth, found) and done.
    """
    step = symmetry_step_of(moves) if symmetry_step == "auto" else symmetry_step
    perms = symmetries(context, step) if step else None
    rho = context.k if rho is None else rho
    events: list[dict] = []

    def tell(event: str, **facts):
        events.append({"event": event, **facts})
        if hook:
            hook(event, facts)

    def settle(wfs: np.ndarray) -> np.ndarray:
        wfs = wfs - wfs.min(axis=1, keepdims=True)
        return canonical(wfs, perms) if perms is not None else wfs

    def grow(wfs: np.ndarray, i: int) -> np.ndarray:
        kind, s, t = moves[i]
        return context.update(wfs, t) if kind == "point" else context.ride(wfs, s, t)

    def reached(batches):
        """wf, id to hash, check and number of what moves lead to; a hash once in a chunk, with its least number."""
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, CHUNK):
                part = b.slice(at, CHUNK)
                wfs, ids = rows_of(part.column(0)), part.column(1).to_numpy()
                found = np.concatenate([digests(settle(grow(wfs, i))) for i in range(len(moves))])
                via = (ids[None, :] * len(moves) + np.arange(len(moves))[:, None]).ravel()
                order = np.argsort(via, kind="stable")
                keys = np.ascontiguousarray(found[order]).view("V24").ravel()
                first = np.sort(order[np.unique(keys, return_index=True)[1]])
                names, checks = hashes_of(found[first])
                yield pa.RecordBatch.from_arrays([names, checks, pa.array(via[first])], ["hash", "check", "via"])

    def begun(batches):
        """start, wf to hash, check, number and settled values."""
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                wfs = settle(rows_of(b.column(1)))
                names, checks = hashes_of(digests(wfs))
                yield pa.RecordBatch.from_arrays([names, checks, b.column(0), lists_of(wfs)], ["hash", "check", "via", "wf"])

    def made(batches):
        """The values of new nodes from their sources': hash, id, via, path and source's wf to hash, id, path, wf."""
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, CHUNK):
                part = b.slice(at, CHUNK)
                wfs, move = rows_of(part.column(4)), part.column(2).to_numpy() % len(moves)
                out = np.empty_like(wfs)
                for i in np.unique(move).tolist():
                    out[move == i] = settle(grow(wfs[move == i], i))
                names, _ = hashes_of(digests(out))
                if not names.equals(part.column(0).cast(pa.binary())):
                    raise ValueError("a node's values are not those of its hash")
                paths = pa.array([[*p, int(i)] for p, i in zip(part.column(3).to_pylist(), move)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([names, part.column(1), paths, lists_of(out)], ["hash", "id", "path", "wf"])

    def edge_rows(batches):
        """wf and what names the node to its edges, the other end by its hash."""
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, CHUNK):
                part = b.slice(at, CHUNK)
                wfs = rows_of(part.column(0))
                for i in range(len(moves)):
                    grown = grow(wfs, i)
                    d_min, ext = grown.min(axis=1), (grown - wfs).max(axis=1)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(1), pa.array(np.full(part.num_rows, i)), pa.array(d_min), pa.array(ext), pa.array((context.k + 1) * d_min - ext), hashes_of(digests(settle(grown)))[0]],
                        ["from", "request", "d_min", "ext", "weight", "hash"],
                    )

    edge_schema = "request long, d_min long, ext long, weight long, hash binary"
    node_levels, values = Levels(spark, "explore-nodes"), Levels(spark, "explore-potential")

    def valued(level: DataFrame) -> DataFrame:
        """A level's nodes, written; with the potential if one is checked."""
        held = node_levels.add(level.select("id", "hash", "depth", "path", "wf"))
        return held if potential is None else values.add(held.withColumn("phi", potential(F.col("wf"))))

    if not isinstance(starts, DataFrame):
        starts = spark.createDataFrame([(i, context.initial(c).tolist()) for i, c in enumerate(starts)], "start long, wf array<long>")
    one = starts.select("start", "wf").mapInArrow(begun, "hash binary, check long, via long, wf array<long>")
    first = _told_apart(one, F.min_by("wf", "via").alias("wf"))
    first = scratch.table(first, "explore-starts")
    n = first.count()
    tell("start", starts=n)
    frontier = valued(in_order(first, "via", n, 0).select("id", "hash", F.lit(0).cast("long").alias("depth"), F.array("via").alias("path"), "wf"))
    levels, short, n_short, total, complete = [], None, 0, n, True
    level_facts: dict = {}
    for depth in range(max_levels):
        if not n:
            break
        levels.append(n)
        tell("level", depth=depth, nodes=n, **level_facts)
        began, before = time.monotonic(), counters(spark)
        seen = node_levels.read().select("hash")
        rows = frontier.select("wf", "id").mapInArrow(reached, "hash binary, check long, via long")
        counted = Observation()
        candidates = _told_apart(rows.observe(counted, F.count("*").alias("n")))
        if visited is None:
            new = candidates.join(seen, "hash", "left_anti")
        else:
            visited.add(seen if not depth else frontier.select("hash"), n)
            new = visited.unseen(candidates, seen)
        new = scratch.table(new.select("hash", "via"), "explore-new")
        expanded, unlike = n * len(moves), observed(counted)
        n = new.count()
        sources = frontier.select(F.col("id").alias("source"), F.col("path"), F.col("wf"))
        placed = in_order(new, "via", n, total).withColumn("source", F.floor(F.col("via") / len(moves)))
        grown = placed.join(sources, "source").select("hash", "id", "via", "path", "wf").mapInArrow(made, "hash binary, id long, path array<long>, wf array<long>")
        total += n
        after = valued(grown.withColumn("depth", F.lit(depth + 1).cast("long")))
        if potential is not None:
            u = frontier.select(F.col("id").alias("u"), F.col("phi").alias("pu"), "path")
            edges_here = frontier.select("wf", "id").mapInArrow(edge_rows, f"from long, {edge_schema}")
            slack = F.col("pv") - F.col("pu") + F.lit(rho + 1) * F.col("d_min") - F.col("ext")
            broken = edges_here.join(u, F.col("from") == F.col("u")).join(values.read().select("hash", F.col("phi").alias("pv")), "hash")
            broken = scratch.table(broken.select("path", "request", slack.alias("slack")).where("slack < 0"), "explore-violations")
            short = broken if short is None else short.union(broken)
            found = broken.count()
            n_short += found
            tell("violations", depth=depth, found=found)
            if stop_after is not None and n_short > stop_after:
                complete = False
                break
        level_facts = {"expanded": expanded, "reached": unlike, "new": n, "seconds": time.monotonic() - began}
        level_facts |= {k: v - before[k] for k, v in counters(spark).items()}
        frontier = after
    else:
        raise RuntimeError(f"no fixpoint after {max_levels} levels")
    nodes = node_levels.read()
    linked = nodes.select("wf", "id").mapInArrow(edge_rows, f"from long, {edge_schema}").join(nodes.select(F.col("id").alias("to"), "hash"), "hash")
    linked = linked.select((F.col("from") * len(moves) + F.col("request")).alias("edge_id"), "from", "to", "request", "d_min", "ext", "weight")
    tell("done", levels=len(levels), violations=n_short)
    return Graph(context, nodes.drop("hash"), scratch.table(linked, "graph-edges"), levels, short, complete, events)


def _told_apart(rows: DataFrame, *more: Column) -> DataFrame:
    """hash, via (and ``more``): one row a hash, its least number; two checks under one hash raise."""
    same = F.assert_true(F.col("low") == F.col("high"), F.lit("two work functions have one hash"))
    found = rows.groupBy("hash").agg(F.min("via").alias("via"), F.min("check").alias("low"), F.max("check").alias("high"), *more)
    return found.where(same.isNull()).drop("low", "high")


def observed(observation: Observation) -> int | None:
    """The count that a finished action has observed; none where its plan came down to an empty one."""
    from py4j.protocol import Py4JJavaError

    try:
        return observation.get["n"]
    except Py4JJavaError:
        return None


def counters(spark: SparkSession) -> dict[str, float]:
    """What Spark's own status store has counted so far: tasks, shuffled and read bytes, seconds in garbage collection."""
    every = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    rows = [every.apply(i) for i in range(every.size())]
    return {
        "tasks": sum(r.totalTasks() for r in rows), "shuffle_bytes": sum(r.totalShuffleWrite() for r in rows),
        "input_bytes": sum(r.totalInputBytes() for r in rows), "gc_seconds": sum(r.totalGCTime() for r in rows) / 1000,
    }


def bellman(graph_nodes: DataFrame, edges: DataFrame, max_rounds: int = 1_000, facts: list[dict] | None = None) -> DataFrame:
    """id, bellman: the largest non-positive potential with v - u + weight >= 0 on every edge.

    u's value falls to the least of 0 and the values of its successors plus the edge's weight. Only nodes whose value fell
    in the last round push along the edges that lead to them, so a round joins those edges alone; at first, negative edges start it.
    After as many rounds as there are nodes a value still falls only if a cycle has a negative weight: that is
    told as soon as a value is below the sum of all negative least weights that a path can collect. ``facts`` gets rounds' counts.
    """
    into = scratch.table(edges.groupBy("to", "from").agg(F.min("weight").alias("weight")).where(F.col("from") != F.col("to")), "bellman-edges")
    into = into.repartition("to").persist()  # shuffled once; what a lost executor held is read and shuffled again
    try:
        return _relaxed(graph_nodes, edges, into, max_rounds, facts)
    finally:
        into.unpersist()


def _relaxed(graph_nodes, edges, into, max_rounds, facts) -> DataFrame:
    bad = edges.where((F.col("from") == F.col("to")) & (F.col("weight") < 0))
    if not bad.isEmpty():
        raise RuntimeError("the constraints have no feasible potential: an edge from a node to itself is negative")
    # a path without a cycle leaves a node once, so it is at least the sum of the least negative weights by node
    floor = into.where("weight < 0").groupBy("from").agg(F.min("weight").alias("w")).agg(F.sum("w")).first()[0] or 0
    fallen = scratch.table(into.where("weight < 0").groupBy(F.col("from").alias("id")).agg(F.min("weight").alias("bellman")), "bellman-fallen")
    now = fallen
    for turn in range(max_rounds):
        n = fallen.count()
        if facts is not None:
            facts.append({"round": turn, "fallen": n})
        if not n:
            return graph_nodes.select("id").join(now, "id", "left").select("id", F.coalesce("bellman", F.lit(0).cast("long")).alias("bellman"))
        pushed = into.join(fallen.select(F.col("id").alias("to"), F.col("bellman").alias("b")), "to").groupBy(F.col("from").alias("id")).agg(F.min(F.col("b") + F.col("weight")).alias("low"))
        after = now.join(pushed, "id", "full").select("id", F.least("bellman", "low", F.lit(0).cast("long")).alias("bellman"), (F.col("low") < F.coalesce("bellman", F.lit(0).cast("long"))).alias("fell"))
        after = scratch.table(after.withColumn("fell", F.coalesce("fell", F.lit(False))), "bellman")
        now, fallen = after.select("id", "bellman"), after.where("fell").select("id", "bellman")
        if not fallen.where(F.col("bellman") < floor).isEmpty():
            raise RuntimeError("the constraints have no feasible potential: a cycle is negative")
    raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
