"""The report on a potential: every edge's inequality, and aggregates over edges and nodes.

An edge is processed if both ends have a potential, a node if it has one. Unevaluated is null, never NaN.
Input columns: edges with from, to, d_min, ext, u_phi, v_phi (v_renorm_phi, u_bellman, v_bellman); nodes with id,
depth, phi, bellman. A score without processed rows is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slackline.functions import arrays


def change() -> Column:
    """Of the potential along an edge."""
    return F.col("v_phi") - F.col("u_phi")


def slack(rho: float) -> Column:
    """Not negative where the inequality holds; null where an end is unevaluated."""
    return change() + F.lit(rho + 1) * F.col("d_min") - F.col("ext")


def processed() -> Column:
    return F.col("u_phi").isNotNull() & F.col("v_phi").isNotNull()


def _count_and_score(condition: Column, among: Column, name: str) -> list[Column]:
    """How many of ``among`` meet the condition, and the share that doesn't."""
    hit = F.count_if(among & condition)
    return [hit.alias(name), (1 - F.try_divide(hit.cast("double"), F.count_if(among))).alias(f"{name}_score")]


def violations(rho: float) -> list[Column]:
    return _count_and_score(slack(rho) < 0, processed(), "violations_k")


def violations_dmin_0() -> list[Column]:
    return _count_and_score(change() - F.col("ext") < 0, processed() & (F.col("d_min") == 0), "violations_dmin_0")


def undetected_dmin_0() -> list[Column]:
    return _count_and_score(change() == 0, processed() & (F.col("d_min") == 0) & (F.col("ext") > 0), "undetected_dmin_0")


def violations_renorm() -> list[Column]:
    both = F.col("u_phi").isNotNull() & F.col("v_renorm_phi").isNotNull()
    return _count_and_score(F.col("v_renorm_phi") - F.col("u_phi") - F.col("ext") < 0, both, "violations_renorm")


def strong_rho(k: int, size: int) -> list[Column]:
    """The largest (ext - change) / d_min, and its score between k + 1 and the number of configurations."""
    rho = F.max(F.when(F.col("d_min") != 0, (F.col("ext") - change()) / F.col("d_min")))
    return [rho.alias("strong_hypothesis_rho"), ((size - rho) / (size - (k + 1))).alias("strong_hypothesis_rho_score")]


def violation_norms(rho: float) -> list[Column]:
    short = F.greatest(-slack(rho), F.lit(0))
    return [
        F.sum(short).cast("double").alias("violations_k_l1"),
        F.sqrt(F.sum((short * short).cast("double"))).alias("violations_k_l2"),
        F.max(short).cast("double").alias("violations_k_linf"),
    ]


def coverage(renormalized: bool = True) -> list[Column]:
    done = F.count_if(processed())
    out = [F.count("*").alias("total_edges"), (F.count("*") - done).alias("unprocessed_normalized_edges"), F.try_divide(done.cast("double"), F.count("*")).alias("processed_normalized_edges_score")]
    if renormalized:
        both = F.count_if(F.col("u_phi").isNotNull() & F.col("v_renorm_phi").isNotNull())
        out += [(F.count("*") - both).alias("unprocessed_renormalized_edges"), F.try_divide(both.cast("double"), F.count("*")).alias("processed_renormalized_edges_score")]
    return out


def pearson(x: Column, y: Column) -> Column:
    """The correlation from sums; null under two rows or for a constant side."""
    both = x.isNotNull() & y.isNotNull()
    a, b = (F.when(both, c.cast("double")) for c in (x, y))
    n = F.count_if(both)
    sxx, syy, sxy = n * F.sum(a * a) - F.sum(a) * F.sum(a), n * F.sum(b * b) - F.sum(b) * F.sum(b), n * F.sum(a * b) - F.sum(a) * F.sum(b)
    return F.when((n > 1) & (sxx > 0) & (syy > 0), F.try_divide(sxy, F.sqrt(sxx) * F.sqrt(syy)))


def bellman_edges() -> list[Column]:
    """Pearson, mean squared difference, and 1 - residual / total squares of edge changes, Bellman's being the truth."""
    truth, own = F.when(processed(), F.col("v_bellman") - F.col("u_bellman")).cast("double"), change().cast("double")
    n = F.count_if(processed())
    residual = F.sum((truth - own) * (truth - own))
    spread = F.sum(truth * truth) - F.try_divide(F.sum(truth) * F.sum(truth), n)
    return [
        pearson(truth, own).alias("bellman_edge_corr"),
        F.when(n > 1, residual / n).alias("bellman_edge_mse"),
        F.when((n > 1) & (spread > 0), 1 - F.try_divide(residual, spread)).alias("bellman_edge_r2"),
    ]


def average_ranks(rows: DataFrame, column: str, name: str) -> DataFrame:
    """``rows`` with ranks from 1, ties sharing their mean. Ranks come from counts of distinct values.

    A running sum over the distinct values' counts stands for a window over all rows. The ranks are written, so that
    their size is known when rows are joined to them: few values are broadcast and no row is shuffled; of many, a hot
    one is split.
    """
    from slackline.plans import scratch
    from slackline.plans.numbering import numbered

    counts = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("__n"))
    placed = numbered(counts, [column], "__at")
    blocks = placed.withColumn("__block", F.floor(F.col("__at") / 65_536))
    totals = blocks.groupBy("__block").agg(F.sum("__n").alias("__sum"))
    before = totals.select("__block", F.coalesce(F.sum("__sum").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    within = F.coalesce(F.sum("__n").over(Window.partitionBy("__block").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = blocks.withColumn("__before", within).join(before, "__block").select(column, (F.col("__base") + F.col("__before") + (F.col("__n") + 1) / 2).alias(name))
    return rows.join(scratch.table(ranks, "ranks"), column, "left")


def bellman_nodes(nodes: DataFrame, prefix: str = "bellman_node") -> DataFrame:
    """One row: Pearson, and Spearman held at 0, of bellman and phi over processed nodes."""
    done = nodes.where("phi is not null")
    ranked = average_ranks(average_ranks(done.select("phi", "bellman"), "phi", "rp"), "bellman", "rb")
    return ranked.agg(pearson(F.col("bellman"), F.col("phi")).alias(f"{prefix}_corr"), F.greatest(pearson(F.col("rb"), F.col("rp")), F.lit(0.0)).alias(f"{prefix}_spearman"))


def report(edges: DataFrame, k: int, size: int, rho: float | None = None, renormalized: bool = True, digits: int | None = None, only_violations: bool = False) -> DataFrame:
    """The edge metrics in one aggregation over one pass. ``violations_k_score`` is never rounded."""
    rho = k if rho is None else rho
    columns = violations(rho)
    if not only_violations:
        columns += violations_dmin_0() + undetected_dmin_0() + (violations_renorm() if renormalized else []) + strong_rho(k, size) + violation_norms(rho) + coverage(renormalized)
        if {"u_bellman", "v_bellman"} <= set(edges.columns):
            columns += bellman_edges()
    out = edges.agg(*columns)
    if digits is not None:
        out = out.withColumns({c: F.bround(c, digits) for c, t in out.dtypes if t == "double" and c != "violations_k_score"})
    return out


def renormalized(edges: DataFrame, potential) -> DataFrame:
    """``edges`` with v_renorm_phi, the potential of v's work function plus d_min, once for each distinct (to, d_min)."""
    once = edges.select("to", "d_min", "v_wf").distinct().withColumn("v_renorm_phi", potential(arrays.shifted(F.col("v_wf"), F.col("d_min")))).drop("v_wf")
    return edges.join(once, ["to", "d_min"])


def opt_upper_bound(nodes: DataFrame, potential, sample: int = 100, ts: tuple[int, ...] = (0, 1, 2, 3, 10_000), k: int = 1, size: int = 1) -> DataFrame:
    """The steepest change of the potential of w + t between any two t, over a sample of processed nodes by hash."""
    chosen = nodes.where("phi is not null").orderBy(arrays.portable_hash(F.col("id")), "id").limit(sample)
    at = chosen.select("id", "wf", F.explode(F.array(*(F.lit(t).cast("long") for t in ts))).alias("t"))
    valued = at.select("id", "t", potential(arrays.shifted(F.col("wf"), F.col("t"))).alias("p"))
    a, b = valued.toDF("id", "t1", "p1"), valued.toDF("id", "t2", "p2")
    slope = (F.col("p2") - F.col("p1")) / (F.col("t2") - F.col("t1"))
    bound = F.max(slope)
    return a.join(b, "id").where("t1 < t2").agg(bound.alias("opt_upper_bound"), ((size - bound) / (size - (k + 1))).alias("opt_upper_bound_score"))


def robustness(edges: DataFrame, nodes: DataFrame, potential, permutation: Column, rho: float, factor: int = 2, shift: int = 1) -> DataFrame:
    """One row: violations after w -> factor * w[permutation] + shift on a metric times ``factor``.

    ``permutation`` is an array of positions; ``potential`` knows the permuted order. Only full coverage can be robust.
    """
    moved = F.transform(permutation, lambda i: F.element_at("wf", (i + 1).cast("int")) * factor + shift)
    valued = nodes.select("id", potential(moved).alias("phi"))
    both = edges.select("from", "to", "d_min", "ext").join(valued.toDF("from", "u"), "from").join(valued.toDF("to", "v"), "to")
    left = F.col("v") - F.col("u") + F.lit((rho + 1) * factor) * F.col("d_min") - factor * F.col("ext")
    return both.agg(F.count_if(left < 0).alias("violations"), F.count_if(F.col("u").isNull() | F.col("v").isNull()).alias("unevaluated")).withColumn("robust", (F.col("violations") == 0) & (F.col("unevaluated") == 0))


def fingerprint(edges: DataFrame, blocks: int = 4_096) -> DataFrame:
    """One row: a SHA-256 over changes in order of edge ids, as a tree of hashes of ``blocks`` neighbours each.

    No task holds more than a block's texts, whatever the number of edges. Without processed edges it is null.
    """
    text = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["t"]), ",")
    last = edges.agg(F.max("edge_id").alias("last")).first()["last"] or 0
    part = edges.where(processed()).select(F.col("edge_id").alias("at"), change().cast("string").alias("t"))
    while True:
        part = part.groupBy(F.floor(F.col("at") / blocks).alias("block")).agg(F.sha2(text(F.struct("at", "t")), 256).alias("t")).select(F.col("block").alias("at"), "t")
        last //= blocks
        if last < blocks:
            return part.agg(F.sha2(text(F.struct("at", "t")), 256).alias("unique_key"), F.count("*").alias("n")).select(F.when(F.col("n") > 0, F.col("unique_key")).alias("unique_key"))
