"""Finite metrics as tables (a, b, d), and as matrices for small contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slackline.functions import arrays


#: A task's pairs: so many points a, and for each of so many points b all of them. Files pack codes in runs of 504, and look
#: up each value's code, which is slower among more values than fit a core's caches.
BLOCK, RUN = 504, 1 << 13


def pairs(spark: SparkSession, m: int) -> DataFrame:
    """All ordered pairs of m points, without a join, in tiles.

    A tile is a task, and a row's number gives its pair. It goes through its points b, and for each through its points a, so that b
    comes in runs, a in a short cycle and distances as they came for the last b, moved on: columns that files hold in a fraction of a
    byte a row. Points b go up in eights, as codes of any number of bits, moved on by eight, are whole bytes moved on, which
    compression can tell. Division alone would make columns nullable, with definition levels in files; no divisor is 0.
    """
    if m <= 0:
        raise ValueError("a metric has at least one point")
    wide, across, down = min(BLOCK, m), -(-m // BLOCK), -(-m // RUN)
    eighth = -(-m // (8 * down))
    tile, tiles = 8 * eighth * wide, across * down
    rows = spark.range(0, tiles * tile, 1, tiles).selectExpr(
        f"coalesce(id div {tile} % {across} * {wide} + id % {wide}, 0) AS a",
        f"coalesce(id div {tile * across} * {8 * eighth} + id div {wide} % {eighth} * 8 + id div {wide * eighth} % 8, 0) AS b",
    )
    return rows.where((F.col("a") < m) & (F.col("b") < m))


def _metric(spark: SparkSession, m: int, d: Column) -> DataFrame:
    return pairs(spark, m).select("a", "b", d.cast("long").alias("d"))


def circle(spark: SparkSession, m: int) -> DataFrame:
    return _metric(spark, m, arrays.circle_distance(F.col("a"), F.col("b"), m))


def uniform(spark: SparkSession, m: int) -> DataFrame:
    return _metric(spark, m, F.when(F.col("a") == F.col("b"), 0).otherwise(1))


def line(spark: SparkSession, m: int) -> DataFrame:
    return _metric(spark, m, F.abs(F.col("a") - F.col("b")))


def antipode_extension(metric: DataFrame) -> DataFrame:
    """Twice the points: point a + m is a's antipode, and its distances are R - d, R being the largest distance."""
    checks = metric.agg(F.count("*").alias("n"), F.max("a").alias("top"), F.max("d").alias("r"), F.min("d").alias("low"), F.count_distinct("a", "b").alias("cells")).first()
    if not checks["n"]:
        raise ValueError("the metric is empty")
    m = checks["top"] + 1
    if checks["cells"] != m * m or checks["n"] != m * m:
        raise ValueError("the metric is not a square matrix")
    if checks["low"] < 0:
        raise ValueError("a distance is negative")
    shift = F.explode(F.array(*(F.struct(F.lit(i * m).alias("i"), F.lit(j * m).alias("j")) for i in (0, 1) for j in (0, 1))))
    d = F.when(F.col("s.i") == F.col("s.j"), F.col("d")).otherwise(F.lit(checks["r"]) - F.col("d"))
    return metric.withColumn("s", shift).select((F.col("a") + F.col("s.i")).alias("a"), (F.col("b") + F.col("s.j")).alias("b"), d.alias("d"))


def circle_matrix(m: int) -> list[list[int]]:
    return [[min(abs(a - b), m - abs(a - b)) for b in range(m)] for a in range(m)]


def matrix(metric: DataFrame) -> list[list[int]]:
    """A metric table as rows of integers, for a context; contexts are small."""
    rows = metric.orderBy("a", "b").collect()
    m = int(len(rows) ** 0.5)
    values = [r["d"] for r in rows]
    if any(v != int(v) for v in values):
        raise ValueError("distances are integers")
    return [[int(v) for v in values[i * m : (i + 1) * m]] for i in range(m)]
