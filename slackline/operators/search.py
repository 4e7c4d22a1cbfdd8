"""Candidate search as tables: stages, credits, summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slackline.functions import arrays
from slackline.operators import ranking

#: A stage's reward goes to ancestors with these weights, by distance.
DECAY = (1.0, 0.5, 0.25, 0.125)
#: Fixed base weights by family; other families weigh 1.
BASE_WEIGHTS = {"seed_dense": 1.35, "seed_peak5": 1.15}
LEAST_REWARD = 0.1
#: Candidates that a family takes its parents from: so many of the best, with this stage done; null: a clean first stage.
POOLS = {"mutate_full": (12, "stage_d"), "mutate_timed": (20, "stage_c"), "mutate_proxy": (30, "stage_b"), "mutate_ck4": (30, None)}
#: Violations with which a candidate still passes a stage.
MOST = {"stage_a": 0, "stage_b": 5}


@dataclass(frozen=True)
class Change:
    """A place becomes keep * itself + one of ``add``, held within ``bound``; ``share`` of a recipe's changes are such."""

    share: float
    keep: int
    add: tuple[int, ...]
    bound: int


@dataclass(frozen=True)
class Recipe:
    """A vector begins with draws from ``fill`` (nothing: the parent); ``least`` to ``most`` of its places change."""

    fill: tuple[int, ...]
    least: int
    most: int
    changes: tuple[Change, ...]


# The families' values, shares and numbers of places.
VALUES = (-2, -1, 0, 1, 2)
SPARSE = (-5, -4, -3, -2, -1, 1, 2, 3, 4, 5)
EDITS = (Change(0.3, 0, VALUES, 2), Change(0.3, 1, (-1, 1), 2), Change(0.2, 1, (-2, 2), 2), Change(0.2, 0, (0,), 2))
RECIPES = {
    "seed_sparse": Recipe((0,), 2, 6, (Change(1.0, 0, SPARSE, 5),)),
    "seed_dense": Recipe(VALUES, 0, 0, EDITS),
    "seed_peak5": Recipe(VALUES, 2, 2, (Change(1.0, 0, (-5, 5), 5),)),
    "mutate_proxy": Recipe((), 1, 3, EDITS),
    "mutate_timed": Recipe((), 1, 2, EDITS),
    "mutate_full": Recipe((), 1, 2, EDITS),
    "mutate_ck4": Recipe((), 2, 5, EDITS),
}
OTHER = Recipe((), 1, 4, EDITS)
#: Places of a vector that draws are numbered by.
PLACES = 1024


def recipe_table(spark) -> DataFrame:
    """family, fill, least, most, changes (with the running share up to each); the row of a null family is ``OTHER``."""
    rows = []
    for family, r in [*RECIPES.items(), (None, OTHER)]:
        upto, changes = 0.0, []
        for c in r.changes:
            upto += c.share
            changes.append((int(round(upto * arrays.MODULUS)), c.keep, list(c.add), c.bound))
        rows.append((family, list(r.fill), r.least, r.most, changes))
    return spark.createDataFrame(rows, "family string, fill array<long>, least long, most long, changes array<struct<upto:long,keep:long,add:array<long>,bound:long>>")


def mutated(draws: DataFrame, frozen: int = 0) -> DataFrame:
    """draw_id, family, coefs: a new vector for each draw (draw_id, family, coefs of its parent), in one expression.

    Draws are hashes of the draw's id and the place, so a batch of any size is made where its rows are, and again
    alike. The places that change are those with the smallest hashes; the first ``frozen`` are 0. Vectors have
    ``PLACES`` places at most.
    """
    known = recipe_table(draws.sparkSession)
    named = draws.withColumn("recipe", F.when(F.col("family").isin(*RECIPES), F.col("family")))
    rows = named.join(F.broadcast(known.withColumnRenamed("family", "of")), F.col("recipe").eqNullSafe(F.col("of")))  # a row for each recipe

    def draw(salt: int, i: Column) -> Column:
        return arrays.portable_hash(F.col("draw_id") * PLACES + i, salt)

    def one_of(values: Column, salt: int, i: Column) -> Column:
        return F.element_at(values, (F.floor(draw(salt, i) * F.size(values) / arrays.MODULUS) + 1).cast("int"))

    active = F.filter(F.transform("coefs", lambda _, i: i.cast("long")), lambda i: i >= frozen)
    order = F.array_sort(F.transform(active, lambda i: F.struct(draw(1, i).alias("h"), i.alias("i"))))
    n = F.col("least") + F.floor(draw(2, F.lit(0)) * (F.col("most") - F.col("least") + 1) / arrays.MODULUS)
    rows = rows.withColumn("places", F.transform(F.slice(order, F.lit(1), n.cast("int")), lambda x: x["i"]))
    start = F.transform("coefs", lambda x, i: F.when(F.size("fill") > 0, one_of(F.col("fill"), 3, i)).otherwise(x))

    def changed(x: Column, i: Column) -> Column:
        c = F.element_at(F.filter("changes", lambda c: draw(4, i) < c["upto"]), 1)
        return arrays.let(c, lambda c: F.greatest(-c["bound"], F.least(c["bound"], c["keep"] * x + one_of(c["add"], 5, i))))

    rows = rows.withColumn("start", start)
    made = F.transform("start", lambda x, i: F.when(i < frozen, F.lit(0).cast("long")).when(F.array_contains("places", i.cast("long")), changed(x, i)).otherwise(x))
    return rows.select("draw_id", "family", made.alias("coefs"))


def parents(candidates: DataFrame, draws: DataFrame, n_coefs: int) -> DataFrame:
    """draw_id, family, parent_id, coefs: a parent for each draw (draw_id, family), one of its family's pool.

    Families without a pool, or with an empty one, begin with zeros. Pools hold as many rows as ``POOLS`` says.
    """
    pools = None
    for family, (size, stage) in POOLS.items():
        held = candidates.where(F.col("stage_a") == 0) if stage in (None, "stage_b") else candidates
        held = held if stage is None else held.where(F.col(stage).isNotNull())
        best = ranking.top(held, size, *ranking.rank_key()).agg(F.sort_array(F.collect_list(F.struct("candidate_id", "coefs"))).alias("pool"))
        best = best.select(F.lit(family).alias("of"), "pool")
        pools = best if pools is None else pools.union(best)
    at = F.floor(arrays.portable_hash(F.col("draw_id"), 6) * F.size("pool") / arrays.MODULUS) + 1
    rows = draws.join(F.broadcast(pools), F.col("family") == F.col("of"), "left").withColumn("p", F.when(F.size("pool") > 0, F.try_element_at("pool", at.cast("int"))))
    zeros = F.array_repeat(F.lit(0).cast("long"), n_coefs)
    return rows.select("draw_id", "family", F.col("p.candidate_id").alias("parent_id"), F.coalesce("p.coefs", zeros).alias("coefs"))


def edge_pools(history: DataFrame, edges: DataFrame) -> DataFrame:
    """pool, edge_id, score for ``ranking.edge_cache``, from violated edges (step, candidate_id, edge_id) seen before.

    recent: the last step; frequent: how often; frontier: how often among the candidate with the fewest; disagreement:
    how evenly the candidates of the last step are split. core, edges by hash, fills what history leaves empty.
    """
    last = history.agg(F.max("step").alias("last"), F.count_distinct("candidate_id").alias("all"))  # one row
    seen = history.join(F.broadcast(last))
    fewest = history.groupBy("candidate_id").agg(F.count("*").alias("n")).agg(F.min(F.struct("n", "candidate_id"))["candidate_id"].alias("best"))
    by = seen.groupBy("edge_id").agg(F.max("step").alias("recent"), F.count("*").alias("frequent"), F.count_if(F.col("step") == F.col("last")).alias("now"))
    split = seen.where(F.col("step") == F.col("last")).agg(F.count_distinct("candidate_id").alias("held"))
    by = by.join(F.broadcast(split)).withColumn("disagreement", F.least("now", F.col("held") - F.col("now")))
    pools = [by.select(F.lit(p).alias("pool"), "edge_id", F.col(p).cast("double").alias("score")) for p in ("recent", "frequent", "disagreement")]
    frontier = history.join(F.broadcast(fewest), history["candidate_id"] == F.col("best")).select(F.lit("frontier").alias("pool"), "edge_id", F.lit(1.0).alias("score"))
    core = edges.select(F.lit("core").alias("pool"), "edge_id", (-arrays.portable_hash(F.col("edge_id"), 9)).cast("double").alias("score"))
    out = core.union(frontier.distinct())
    for p in pools:
        out = out.union(p)
    return out


def rate(n: Column, d: Column) -> Column:
    """0 for a zero denominator."""
    return F.when(d == 0, 0.0).otherwise(F.try_divide(n.cast("double"), d.cast("double")))


def reward() -> Column:
    """What a candidate's stages earn: 1 for a clean first, 2 for a passed second, more for fewer violations after."""
    a = F.when(F.col("stage_a") <= MOST["stage_a"], 1.0).otherwise(0.0)
    b = F.when(F.col("stage_b") <= MOST["stage_b"], 2.0).otherwise(0.0)
    c = F.when(F.col("stage_c").isNotNull(), F.greatest(F.lit(0.5), F.try_divide(F.lit(50.0), F.col("stage_c")))).otherwise(0.0)
    d = F.when(F.col("stage_d").isNotNull(), F.greatest(F.lit(1.0), F.try_divide(F.lit(200.0), F.col("stage_d")))).otherwise(0.0)
    return a + b + c + d


def lineage_credit(candidates: DataFrame) -> DataFrame:
    """candidate_id, credit: its own reward and its descendants', decaying with distance; as many joins as weights."""
    parents = candidates.select(F.col("candidate_id").alias("at"), "parent_id")
    now = candidates.select(F.col("candidate_id").alias("at"), reward().alias("reward"))
    parts = []
    for weight in DECAY:
        parts.append(now.select("at", (F.col("reward") * weight).alias("credit")))
        now = now.groupBy("at").agg(F.sum("reward").alias("reward")).join(parents, "at").where("parent_id is not null").select(F.col("parent_id").alias("at"), "reward")
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    return every.groupBy(F.col("at").alias("candidate_id")).agg(F.sum("credit").alias("credit"))


def weighted_choice(weights: DataFrame, draws: DataFrame) -> DataFrame:
    """draw_id, family: the first family whose running weight reaches the draw's share of the total.

    ``weights`` (family, weight) is a handful of rows; draws are any number.
    """
    order = Window.orderBy("family")
    bounds = weights.select("family", F.sum("weight").over(order).alias("upto"), F.sum("weight").over(Window.partitionBy()).alias("total"))
    one = bounds.agg(F.array_sort(F.collect_list(F.struct("upto", "family"))).alias("bounds"), F.max("total").alias("total"))
    hit = F.element_at(F.filter("bounds", lambda b: F.col("draw") * F.col("total") <= b["upto"]), 1)["family"]
    return draws.join(F.broadcast(one)).select("draw_id", hit.alias("family"))


def deduplicated(candidates: DataFrame) -> DataFrame:
    """The first candidate of each vector of coefficients."""
    return candidates.groupBy("coefs").agg(F.min("candidate_id").alias("candidate_id"))


def timed_estimate(violations: Column, share: Column) -> Column:
    """Violations over the share that was looked at; infinite where none was."""
    return F.when(share == 0, F.lit(float("inf"))).otherwise(F.try_divide(violations.cast("double"), share))
