"""Order, ranks, limits and samples, with ties broken by id so that results are functions of their input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slackline.functions import arrays
from slackline.plans.numbering import numbered

#: Priorities and budgets of the edge cache, in order, and its cap over all.
BUDGETS = (("core", 1024), ("recent", 1024), ("frequent", 1024), ("disagreement", 512), ("frontier", 512))
CAP = 4096


def first_least(values: Column) -> Column:
    """struct<value, idx>: the least entry of an array and the first place that has it."""
    return F.array_min(F.transform(values, lambda v, i: F.struct(v.alias("value"), i.cast("long").alias("idx"))))


def running_total(rows: DataFrame, order: list[str], value: Column, name: str, block: int = 65_536) -> DataFrame:
    """``rows`` with the sum of ``value`` up to and with each, in a global order.

    Rows are numbered by ranges; totals of blocks of numbers are summed first, so no task sees all rows.
    """
    placed = numbered(rows, order, "__at").withColumn("__v", value).withColumn("__block", F.floor(F.col("__at") / block))
    totals = placed.groupBy("__block").agg(F.sum("__v").alias("__sum"))
    before = totals.select("__block", F.coalesce(F.sum("__sum").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    within = F.sum("__v").over(Window.partitionBy("__block").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("__within", within).join(before, "__block").withColumn(name, F.col("__base") + F.col("__within")).drop("__v", "__block", "__within", "__base")


def cut_off(rows: DataFrame, order: list[str], hit: Column, cutoff: int) -> DataFrame:
    """The prefix of rows that a scan sees which stops at the hit after ``cutoff`` others: one row of counts."""
    counted = running_total(rows, order, hit.cast("long"), "__hits")
    seen = counted.where((F.col("__hits") < cutoff + 1) | ((F.col("__hits") == cutoff + 1) & hit))
    return seen.agg(F.count("*").alias("processed"), F.coalesce(F.max("__hits"), F.lit(0)).alias("violations"))


def top(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def hash_sample(rows: DataFrame, id_col: str, share: float, seed: int = 42) -> DataFrame:
    """A sample by a hash threshold: the same rows whenever and wherever it is drawn."""
    return rows.where(arrays.portable_hash(F.col(id_col), seed) < int(share * arrays.MODULUS))


def edge_cache(pools: DataFrame, budgets=BUDGETS, cap: int = CAP) -> DataFrame:
    """pool, edge_id, score: buckets are filled in order of priority, each from what earlier ones left over.

    A bucket takes its budget of the highest scores, ids breaking ties; the first ``cap`` rows stay. Budgets bound
    what a bucket's pick holds, so the ones before it are few rows.
    """
    picked = None
    for place, (pool, budget) in enumerate(budgets):
        rows = pools.where(F.col("pool") == pool)
        if picked is not None:
            rows = rows.join(F.broadcast(picked.select("edge_id")), "edge_id", "left_anti")  # sum of budgets rows at most
        best = rows.orderBy(F.desc("score"), "edge_id").limit(budget).select(F.lit(place).alias("place"), "pool", "edge_id", "score")
        picked = best if picked is None else picked.union(best)
    return picked.orderBy("place", F.desc("score"), "edge_id").limit(cap).select("pool", "edge_id", "score")


def percentiles(column: str, points: dict[str, float]) -> list[Column]:
    """Exact, with linear interpolation; 0 for no rows. A group's distinct values are in one buffer: for small groups."""
    return [F.coalesce(F.percentile(column, F.lit(p)), F.lit(0.0)).alias(name) for name, p in points.items()]


#: Ranks that a sketch may be off by are a part of this of a group's rows.
ACCURACY = 10_000


def quantiles(rows: DataFrame, by: list[str], columns: list[str], points: dict[str, float], accuracy: int = ACCURACY) -> DataFrame:
    """``by`` and ``{column}_{point}`` for each: exact quantiles by linear interpolation, 0 for no values; nulls don't count.

    Selection instead of a group's values in one buffer: a mergeable sketch brackets each wanted rank between two values,
    rows below the bracket are counted, and only what lies inside, some rows of ``accuracy``, is put in order, as distinct values
    with counts. That the bracket holds the rank is checked. A null is a group of its own. ``rows`` is read more than once.
    """
    from slackline.plans import scratch

    names = [f"{c}_{n}" for c in columns for n in points]
    wanted = [(f"__v{i}", p) for i in range(len(columns)) for p in points.values()]
    key = F.struct(*(F.col(b).alias(f"k{i}") for i, b in enumerate(by))) if by else F.lit(0)  # in a struct, nulls are equal
    values = rows.select(key.alias("__key"), *(F.col(c).cast("double").alias(f"__v{i}") for i, c in enumerate(columns)))
    near = lambda x, share: F.percentile_approx(x, F.lit(min(1.0, max(0.0, share))), F.lit(accuracy))
    small = lambda x: F.count(x) <= accuracy  # noqa: E731  then the bracket is all of the group
    low = [F.min(x) if p <= 3 / accuracy else F.when(small(x), F.min(x)).otherwise(near(x, p - 3 / accuracy)) for x, p in wanted]
    high = [F.max(x) if p >= 1 - 3 / accuracy else F.when(small(x), F.max(x)).otherwise(near(x, p + 3 / accuracy)) for x, p in wanted]
    cells = [F.struct(F.lit(i).alias("i"), lo.alias("low"), hi.alias("high"), ((F.count(x) - 1) * F.lit(p)).alias("at"), F.count(x).alias("n")) for i, (x, lo, hi, (_, p)) in enumerate(zip((x for x, _ in wanted), low, high, wanted))]
    brackets = scratch.table(values.groupBy("__key").agg(F.array(*cells).alias("__b")), "quantile-brackets")
    met = values.join(brackets, "__key")
    less = [F.count_if(F.col(x) < F.col("__b")[i]["low"]) for i, (x, _) in enumerate(wanted)]
    below = met.groupBy("__key").agg(F.array(*less).alias("__below"))
    inside = [F.when(F.col(x).between(F.col("__b")[i]["low"], F.col("__b")[i]["high"]), F.struct(F.lit(i).alias("i"), F.col(x).alias("v"))) for i, (x, _) in enumerate(wanted)]
    picked = met.select("__key", F.explode(F.filter(F.array(*inside), lambda x: x.isNotNull())).alias("p")).groupBy("__key", F.col("p.i").alias("i"), F.col("p.v").alias("v")).agg(F.count("*").alias("m"))
    ranked = picked.withColumn("upto", F.sum("m").over(Window.partitionBy("__key", "i").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    one = brackets.join(below, "__key").select("__key", F.explode(F.arrays_zip("__b", "__below")).alias("z"))
    one = one.select("__key", F.col("z.__b.i").alias("i"), F.col("z.__b.at").alias("at"), F.col("z.__b.n").alias("n"), F.col("z.__below").alias("below"))
    first = lambda rank: F.min(F.when(F.col("below") + F.col("upto") > rank, F.col("v")))
    found = one.join(ranked, ["__key", "i"], "left").groupBy("__key", "i", "at", "n", "below").agg(first(F.floor("at")).alias("a"), first(F.ceil("at")).alias("b"))
    held = F.assert_true((F.col("n") <= 0) | ((F.col("below") <= F.floor("at")) & F.col("b").isNotNull()), F.lit("a sketch's bracket lost its rank"))
    value = F.when(F.col("n") > 0, F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at"))).otherwise(0.0)
    settled = found.where(held.isNull()).groupBy("__key").agg(F.map_from_entries(F.collect_list(F.struct("i", value.alias("q")))).alias("q"))  # an entry for each name
    return settled.select(*(F.col("__key")[f"k{i}"].alias(b) for i, b in enumerate(by)), *(F.col("q")[i].alias(n) for i, n in enumerate(names)))


def threshold_counts(column: str, thresholds: list[float]) -> list[Column]:
    out = [F.count_if(F.col(column) <= t).alias(f"le_{t:g}") for t in thresholds]
    return [*out, F.count_if(F.col(column) > thresholds[-1]).alias("gt_max") if thresholds else F.count("*").alias("gt_max")]


def rank_key() -> list[Column]:
    """Candidates from the last stage reached on: fully evaluated ones first, then timed, proxied, the rest."""
    l0, l1 = arrays.norms(F.col("coefs"))
    far = F.lit(10**9)
    tier = F.when(F.col("stage_d").isNotNull(), 0).when(F.col("stage_c").isNotNull(), 1).when(F.col("stage_b").isNotNull(), 2).otherwise(3)
    lead = F.coalesce("stage_d", "stage_c", "stage_b", "stage_a", far)
    second = F.when(tier == 0, F.coalesce("stage_c", F.lit((1 << 63) - 1))).when(tier == 1, F.coalesce("stage_b", far)).otherwise(0)
    third = F.when(tier == 0, F.coalesce("stage_b", far)).otherwise(0)
    return [tier, lead, second, third, l0, l1, F.col("coefs"), F.col("candidate_id")]
