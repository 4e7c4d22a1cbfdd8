"""Numbers for rows in a global order, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slackline.plans import scratch


def numbered(df: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """``df`` with 0, 1, ... in the order of columns: ranges are sorted, and their sizes' sums are the offsets."""
    at = F.monotonically_increasing_id()
    held = scratch.table(df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.shiftright(at, 33).alias("__part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("__row")), "numbered")
    sizes = held.groupBy("__part").agg(F.count("*").alias("n"))  # as many rows as partitions
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__part", before.alias("__before"))
    return held.join(offsets, "__part").withColumn(name, (F.col("__before") + F.col("__row")).cast("long")).drop("__part", "__row", "__before")
