"""Work functions over tables: initial values, updates, replays, and their sparse form."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slackline.functions import arrays
from slackline.operators.configs import Context


def initial(configs: DataFrame, start: list[int] | DataFrame, distance) -> DataFrame:
    """idx, value: the cheapest matching of a start configuration with every other one.

    Of a table of starts (start, and any columns): those columns, idx, value. Configurations are those of a small context.
    """
    if not isinstance(start, DataFrame):
        at = F.array(*(F.lit(p).cast("long") for p in start))
        return configs.select("idx", arrays.set_distance(at, F.col("cfg"), len(start), distance).cast("long").alias("value"))
    k = len(configs.first()["cfg"])
    one = configs.agg(F.collect_list(F.struct("idx", "cfg")).alias("__configs"))  # one row: a context's configurations
    each = start.join(F.broadcast(one)).withColumn("__c", F.explode("__configs"))
    return each.select(*start.columns, F.col("__c.idx").alias("idx"), arrays.set_distance(F.col("start"), F.col("__c.cfg"), k, distance).cast("long").alias("value"))


def initial_arrays(configs: DataFrame, starts: DataFrame, distance) -> DataFrame:
    """``starts`` (start, and any columns) with wf: the work function from each as one array, in the order of idx.

    Made once for each distinct start, of which a context has m^k at most: as small as its table of moves.
    """
    k = len(configs.first()["cfg"])
    one = configs.agg(F.array_sort(F.collect_list(F.struct("idx", "cfg"))).alias("__configs"))  # one row: a context's configurations
    wf = F.transform("__configs", lambda c: arrays.set_distance(F.col("start"), c["cfg"], k, distance).cast("long"))
    each = starts.select("start").distinct().join(F.broadcast(one)).select("start", wf.alias("wf"))
    return starts.join(F.broadcast(each), "start").select(*starts.columns, "wf")


def _gathered(values: DataFrame, moves: DataFrame, by: list[str]) -> DataFrame:
    """``values`` with wf after the moves (idx, nbr, cost) that ``by`` names: for each idx the least wf[nbr] + cost.

    A context's moves are small: one row for each of ``by``, sent to all tasks. Work functions stay in their rows, so nothing of
    their size is shuffled or held.
    """
    spots = moves.groupBy(*by, "idx").agg(F.collect_list(F.struct("nbr", "cost")).alias("spots"))
    table = spots.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("idx", "spots"))).alias("__moves"))
    after = arrays.let(F.col("wf"), lambda w: F.transform("__moves", lambda m: F.array_min(F.transform(m["spots"], lambda s: w[s["nbr"]] + s["cost"]))))
    return values.join(F.broadcast(table), by).select(*(after.alias(c) if c == "wf" else c for c in values.columns))


def update(values: DataFrame, moves: DataFrame, request: str) -> DataFrame:
    """``values`` with wf (arrays) after a request at the point in the column ``request``: each configuration's cheapest last move."""
    return _gathered(values, moves.withColumnRenamed("r", request), [request])


def preimages(configs: DataFrame, rides: DataFrame) -> DataFrame:
    """s, t, idx, source of rides (s, t): of configurations with a server at t, the one with the first such server at s."""
    at = configs.select("idx", "cfg", F.explode(F.array_distinct("cfg")).alias("t")).join(rides.select("s", "t"), "t")
    first = F.array_position("cfg", F.col("t")) - 1
    held = at.select("s", "t", "idx", F.array_sort(F.transform("cfg", lambda x, i: F.when(i == first, F.col("s")).otherwise(x))).alias("cfg"))
    return held.join(configs.select(F.col("idx").alias("source"), "cfg"), "cfg").select("s", "t", "idx", "source")


def ride(values: DataFrame, moves: DataFrame, configs: DataFrame, metric: DataFrame) -> DataFrame:
    """``values`` with wf (arrays) after a ride between the points in its columns s and t: through the preimages, then a request at t.

    Both are one table of moves for each ride. All moves to t lead to states that a ride reaches, so a closed context has no gaps.
    """
    rides = metric.select(F.col("a").alias("s"), F.col("b").alias("t"), "d")
    back = preimages(configs, rides).select("s", "t", F.col("idx").alias("nbr"), "source").join(rides, ["s", "t"])
    steps = moves.withColumnRenamed("r", "t").join(back, ["t", "nbr"])
    return _gathered(values, steps.select("s", "t", "idx", F.col("source").alias("nbr"), (F.col("cost") + F.col("d")).alias("cost")), ["s", "t"])


#: The value of what can't be reached, far above any sum of moves and far below overflow.
FAR = 1 << 40


def operator(context: Context) -> np.ndarray:
    """The identity of min-plus operators: row e has 0 at configuration e. Requests update its rows as work functions."""
    out = np.full((len(context.configs),) * 2, FAR, np.int64)
    np.fill_diagonal(out, 0)
    return out


def applied(rows: np.ndarray, wf: np.ndarray) -> np.ndarray:
    """A work function after the requests that an operator's rows have seen."""
    return (wf[:, None] + rows).min(axis=0)


def replay(requests: DataFrame, context: Context, start, key: str = "user_id", order: list[str] | None = None, r: str = "r", rides: tuple[str, str] | None = None, partitions: int | None = None) -> DataFrame:
    """key, n, wf: each key's work function after all its requests in order.

    Requests are sorted by ranges of key and order, so a key with very many lies in many tasks. A request is a min-plus operator:
    linear in the work function. A task folds the keys that begin in it from the start; of its first key, which may have begun
    before, it folds the operator instead, as one work function for each configuration. A task leaves two open pieces at most, its
    first key's and its last key's; those meet by key, in order, as a stream. ``rides`` names source and target
    columns instead of ``r``. Rows with the same key and order are folded in any order; a null key is a key.
    """
    from pyspark import TaskContext

    from slackline.plans import scratch

    order = order or ["ts", "event_id"]
    at = [F.col(rides[0]).alias("s"), F.col(rides[1]).alias("t")] if rides else [F.lit(None).cast("long").alias("s"), F.col(r).alias("t")]
    keys = ["key", *(f"o{i}" for i in range(len(order)))]
    rows = requests.select(F.col(key).alias("key"), *at, *(F.col(c).alias(f"o{i}") for i, c in enumerate(order)))
    ranged = (rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)).sortWithinPartitions(*keys)
    first, width = context.initial(start), len(context.configs)
    names = ["key", "part", "n", "whole", "values"]
    after = (lambda wf, s, t: context.ride(wf, s, t)) if rides else (lambda wf, s, t: context.update(wf, t))

    def rows_of(done, kind):
        import pyarrow as pa

        columns = list(zip(*done))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.bool_()), pa.array([v.ravel() for v in columns[4]], pa.list_(pa.int64()))], names)

    def folded(batches):
        """Pieces: the key's part, its requests, whether it is whole, and a work function or an operator."""
        part, done, kind, now, n, open_, wf = TaskContext.get().partitionId(), [], None, None, 0, False, None
        for b in batches:
            kind = b.schema.field(0).type
            for k, s, t in zip(*(c.to_pylist() for c in b.columns)):
                if not n or k != now:
                    if n:
                        done.append((now, part, n, not open_, wf))
                    open_ = not n and part > 0  # the first key of all but the first task may have begun before
                    now, n, wf = k, 0, operator(context) if open_ else first
                n, wf = n + 1, after(wf, s, t)
            if len(done) >= 1024:
                yield rows_of(done, kind)
                done = []
        if n:
            done.append((now, part, n, False, wf))
        if done:
            yield rows_of(done, kind)

    def met(batches):
        """Open pieces of a key, in the order of parts, to its work function."""
        done, kind, now, n, wf = [], None, None, 0, first
        for b in batches:
            kind = b.schema.field(0).type
            for i, (k, more) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist())):
                if n and k != now:
                    done.append((now, 0, n, True, wf))
                    n, wf = 0, first
                values = b.column(4)[i].values.to_numpy()
                now, n, wf = k, n + more, values if len(values) == width > 1 else applied(values.reshape(width, width), wf)
            if len(done) >= 1024:
                yield rows_of(done, kind)
                done = []
        if n:
            done.append((now, 0, n, True, wf))
        if done:
            yield rows_of(done, kind)

    schema = f"key {requests.schema[key].dataType.simpleString()}, part int, n long, whole boolean, values array<long>"
    held = scratch.table(ranged.select("key", "s", "t").mapInArrow(folded, schema), "replay-pieces")
    joined = held.where("not whole").repartition("key").sortWithinPartitions("key", "part").mapInArrow(met, schema)
    return held.where("whole").union(joined).select(F.col("key").alias(key), "n", F.col("values").alias("wf"))


def halves(context: Context) -> list[int]:
    """Positions of the all-even configurations of a doubled circle, in the base circle's order."""
    base = Context.of(context.k, [row[: context.m // 2] for row in context.distances[: context.m // 2]])
    return [context.idx(tuple(2 * p for p in cfg)) for cfg in base.configs]


# Sparse work functions: support configurations with values; the value elsewhere is the least of value + matching.


def evaluate_support(support: DataFrame, targets: DataFrame, k: int, distance) -> DataFrame:
    """cfg, value of targets. The support is one row's array: it is small by domination, so nothing is crossed."""
    one = support.agg(F.collect_list(F.struct("cfg", "value")).alias("support"))
    near = F.array_min(F.transform("support", lambda s: s["value"] + arrays.set_distance(F.array_sort(s["cfg"]), F.col("cfg"), k, distance)))
    return targets.join(F.broadcast(one)).select("cfg", near.alias("value"))


#: Candidates that are compared with each other at once.
BLOCK = 256
#: Configurations that others are told apart by: cells around them for the first pruning, bounds for the last.
PIVOTS, BOUNDS = 32, 4


def undominated(candidates: DataFrame, k: int, distance, tol: float = 0.0, block: int = BLOCK) -> DataFrame:
    """Candidates (ord, cfg, value) without those that a cheaper one implies.

    Of two with |difference| >= distance - tol, the dearer goes; of equally dear ones the earlier.

    Beyond ``block`` candidates they meet in blocks. Without tolerance, what goes is never needed again (domination is transitive),
    so first one of each configuration stays, and blocks of near ones, by cells around pivots, prune themselves. What is
    left is put in blocks by value and meets cheaper blocks, but for those that bounds rule out: if one implies
    another, its value plus its distance to a pivot is no more than the other's, for every pivot.
    """
    from slackline.plans import scratch
    from slackline.plans.numbering import numbered

    away = lambda a, b: arrays.set_distance(a, b, k, distance)

    def implied(by: str) -> Column:
        return F.exists(
            by,
            lambda o: (o["ord"] != F.col("ord")) & (F.abs(F.col("value") - o["value"]) >= away(F.col("cfg"), o["cfg"]) - tol)
            & ((F.col("value") > o["value"]) | ((F.col("value") == o["value"]) & (F.col("ord") < o["ord"]))),
        )

    def listed(rows: DataFrame, *by: str) -> DataFrame:
        return rows.groupBy(*by).agg(F.collect_list(F.struct("ord", "cfg", "value")).alias("__others"))

    held = scratch.table(candidates.select("ord", "cfg", "value"), "domination")
    if held.count() <= block:
        return held.join(F.broadcast(listed(held))).where(~implied("__others")).select("ord", "cfg", "value")
    pivots = [r["cfg"] for r in held.orderBy(F.xxhash64("cfg", "ord")).limit(PIVOTS).collect()]
    points = [F.array(*(F.lit(int(x)).cast("long") for x in p)) for p in pivots]
    if not tol:
        best = held.groupBy("cfg").agg(F.min(F.struct("value", (-F.col("ord")).alias("back"))).alias("b"))
        held = best.select((-F.col("b.back")).alias("ord"), "cfg", F.col("b.value").alias("value"))
        near = F.array_position(ds := F.array(*(away(F.col("cfg"), p) for p in points)), F.array_min(ds))
        placed = numbered(held.withColumn("__cell", near), ["__cell", "value", "ord"], "__at").withColumn("__block", F.floor(F.col("__at") / block))
        held = scratch.table(placed.join(listed(placed, "__block"), "__block").where(~implied("__others")).select("ord", "cfg", "value"), "domination")
        if held.count() <= block:
            return held.join(F.broadcast(listed(held))).where(~implied("__others")).select("ord", "cfg", "value")
    placed = scratch.table(numbered(held, ["value", "ord"], "__at").withColumn("__block", F.floor(F.col("__at") / block)).drop("__at"), "domination-blocks")
    reach = [F.col("value") + away(F.col("cfg"), p) for p in points[:BOUNDS]]
    bounds = placed.groupBy("__block").agg(F.array(*map(F.min, reach)).alias("low"), F.array(*map(F.max, reach)).alias("high"))
    dearer = bounds.select(F.col("__block").alias("__at"), "high", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__block"))).alias("__block"))
    dearer = dearer.join(bounds.select("__block", "low"), "__block").where(F.forall(F.zip_with("low", "high", lambda x, y: x <= y + tol), lambda x: x))
    meets = dearer.select("__at", "__block").join(listed(placed, "__block"), "__block").select(F.col("__at").alias("__block"), "__others")
    gone = placed.join(meets, "__block").where(implied("__others")).select("ord").distinct()
    if tol:  # equally dear ones may lie in the next block, which then implies the earlier
        after = placed.select(F.col("value"), F.col("__block").alias("__own")).distinct()
        later = placed.select("value", "__block").distinct().join(after, "value").where("__block > __own").select(F.col("__own"), "__block").distinct()
        more = later.join(listed(placed, "__block"), "__block").select(F.col("__own").alias("__block"), "__others")
        gone = gone.union(placed.join(more, "__block").where(implied("__others")).select("ord")).distinct()
    return placed.join(gone, "ord", "left_anti").select("ord", "cfg", "value")


def update_support(support: DataFrame, request: int, seen: list[int], k: int, distance, tol: float = 0.0) -> DataFrame:
    """The support after a request: it with any k - 1 points seen so far, undominated."""
    spark = support.sparkSession
    points = sorted({*seen, request})
    rows = spark.range(1).select(F.array(F.lit(request).cast("long")).alias("cfg"))
    for _ in range(k - 1):
        rows = rows.select("cfg", F.explode(F.array(*(F.lit(p).cast("long") for p in points))).alias("p")).select(F.array_sort(F.concat("cfg", F.array("p"))).alias("cfg"))
    valued = evaluate_support(support, rows.distinct(), k, distance)
    every = valued.agg(F.array_sort(F.collect_list(F.struct("cfg", "value"))).alias("every")).select(F.posexplode("every").alias("ord", "c"))
    return undominated(every.select(F.col("ord").cast("long").alias("ord"), "c.cfg", "c.value"), k, distance, tol).select("cfg", "value")


def ride_support(support: DataFrame, s: int, t: int, seen: list[int], k: int, distance, cost: int) -> DataFrame:
    """Served at s, then the server there moves to t."""
    served = update_support(support, s, seen, k, distance)
    at = F.array_position("cfg", F.lit(s).cast("long")) - 1
    return served.select(F.array_sort(F.transform("cfg", lambda x, i: F.when(i == at, F.lit(t).cast("long")).otherwise(x))).alias("cfg"), (F.col("value") + cost).alias("value"))


def dense(support: DataFrame, configs: DataFrame, k: int, distance) -> DataFrame:
    """idx, value of every configuration."""
    return evaluate_support(support, configs.select("cfg"), k, distance).join(configs, "cfg").select("idx", "value")


def as_array(values: DataFrame) -> list[int]:
    """A dense work function's values in order; contexts are small."""
    return [r["value"] for r in values.orderBy("idx").collect()]


def stack(rows) -> np.ndarray:
    return np.array(rows, np.int64)
