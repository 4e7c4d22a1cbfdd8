"""Sharding through fixed virtual slots, with DataFrame functions only.

A record hashes into one of ``slots`` virtual slots, for good. Bytes and rows are aggregated per slot, and a
versioned table maps slots to shards. Version 1 deals slots round robin. ``rebalance`` makes the next version by
editing: it takes slots, lightest first, out of shards that hold more than their share, and gives what it took,
heaviest first, to the lightest shards, so most slots stay where they are. The map has ``slots`` rows whatever
the table's size, so it is folded in one row and joined by broadcast.

A map at a path given is edited by each call: the latest version's slots are rebalanced for the bytes that this
table has in them, and the new version is what places its rows. Without a path the map is new, in two versions.

Rows of equal texts are a group and share a slot, hence a shard; slots come from the text alone. Only a group that is larger than a
shard's equal part, of which there are fewer than shards, can't be kept whole under the law of near equal bytes: its rows'
slots come from the row. Records are written once with their slots, so all that is counted holds for what is placed. A slot's
rows are numbered in parts that come from the row, so that no group is one task's.

Contract: a null text has size 1 and checksum 0 and is grouped with empty ones, a null or repeated id is a record like any
other, an empty table gives no rows, and other columns of the input are ignored. Which of equal rows gets which place is open.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slackline.llm import shared

SLOTS = 4096
#: Parts of a slot, whose rows are numbered apart.
PARTS = 16
MAP_SCHEMA = "version int, slot int, shard int, bytes long, rows long"


def slot_stats(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """slot, bytes, rows for each slot, empty ones included. ``records`` has virtual_slot and size."""
    every = records.sparkSession.range(slots).select(F.col("id").cast("int").alias("slot"))
    held = records.groupBy(F.col("virtual_slot").alias("slot")).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    return every.join(held, "slot", "left").na.fill(0, ["bytes", "rows"])


def first_map(stats: DataFrame, shards: int) -> DataFrame:
    """Version 1: slots dealt round robin."""
    return stats.select(F.lit(1).alias("version"), "slot", F.pmod("slot", F.lit(shards)).cast("int").alias("shard"), "bytes", "rows")


def rebalance(old: DataFrame, shards: int) -> DataFrame:
    """The next version, edited for balanced bytes.

    Within a shard, slots stay, heaviest first, while their sum fits an equal share; the rest, and slots of
    shards that are no more, go one by one, heaviest first, to the shard that is lightest then. ``shards`` may
    be more or fewer than before.
    """
    share = F.sum("bytes").over(Window.partitionBy()) / shards
    kept = Window.partitionBy("shard").orderBy(F.desc("bytes"), "slot").rowsBetween(Window.unboundedPreceding, 0)
    marked = old.withColumn("stays", (F.sum("bytes").over(kept) <= share) & (F.col("shard") < shards))
    slot = F.struct(F.col("bytes"), (-F.col("slot")).alias("back"), F.col("rows"), F.col("shard"), F.col("stays"), F.col("slot"))
    one = marked.agg(F.collect_list(slot).alias("all"), F.max("version").alias("version"))  # ``slots`` entries
    load = lambda s: F.aggregate(F.filter("all", lambda x: x["stays"] & (x["shard"] == s)), F.lit(0).cast("long"), lambda a, x: a + x["bytes"])
    one = one.withColumn("loads", F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), load))
    moving = F.reverse(F.array_sort(F.filter("all", lambda x: ~x["stays"])))
    start = F.struct(F.col("loads").alias("loads"), F.expr("cast(array() as array<int>)").alias("to"))

    def place(state: Column, x: Column) -> Column:
        lightest = (F.array_position(state["loads"], F.array_min(state["loads"])) - 1).cast("int")
        loads = F.transform(state["loads"], lambda v, i: F.when(i == lightest, v + x["bytes"]).otherwise(v))
        return F.struct(loads.alias("loads"), F.concat(state["to"], F.array(lightest)).alias("to"))

    placed = one.withColumn("moving", moving).withColumn("to", F.aggregate("moving", start, place, lambda s: s["to"]))
    moved = F.zip_with("moving", "to", lambda x, s: F.struct(x["slot"].alias("slot"), s.alias("shard"), x["bytes"].alias("bytes"), x["rows"].alias("rows")))
    stayed = F.transform(F.filter("all", lambda x: x["stays"]), lambda x: F.struct(x["slot"].alias("slot"), x["shard"].alias("shard"), x["bytes"].alias("bytes"), x["rows"].alias("rows")))
    return placed.select((F.col("version") + 1).alias("version"), F.explode(F.concat(stayed, moved)).alias("m")).select("version", "m.*")


def save_map(shard_map: DataFrame, path: str) -> None:
    """Adds a version; earlier ones stay readable."""
    shard_map.selectExpr("cast(version as int) version", "slot", "cast(shard as int) shard", "bytes", "rows").coalesce(1).write.mode("append").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the map, the latest if none is named."""
    every = spark.read.schema(MAP_SCHEMA).parquet(path)
    if version is not None:
        return every.where(F.col("version") == version)
    return every.join(F.broadcast(every.agg(F.max("version").alias("version"))), "version")


def _has_map(spark: SparkSession, path: str) -> bool:
    try:
        return not spark.read.schema(MAP_SCHEMA).parquet(path).isEmpty()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def next_map(stats: DataFrame, shards: int, path: str) -> DataFrame:
    """Writes the version that places a table with ``stats``, and reads it: a new map's second, or an edited latest."""
    spark = stats.sparkSession
    if not _has_map(spark, path):
        save_map(first_map(stats, shards), path)
    old = load_map(spark, path)
    if (known := old.count()) != (n := stats.count()):
        raise ValueError(f"the map at {path} has {known} slots, not {n}")
    save_map(rebalance(old.select("version", "slot", "shard").join(stats, "slot"), shards), path)
    return load_map(spark, path)


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text: str = "text", slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """Each record with size, text_crc32, virtual_slot, map_version, shard and its place in the shard (``slot``).

    A shard's rows are numbered slot by slot and part by part: rows before come from counts, rows within a part from a
    window over it alone, so no task holds a shard or a slot.
    """
    spark = docs.sparkSession
    kept = map_path is not None
    map_path = map_path or shared.scratch_path(spark, "shard-map")
    records = shared.table(_records(docs, id_col, text, slots, shards), "shard-records")
    counts = shared.table(records.groupBy("virtual_slot", "part").agg(F.sum("size").alias("size"), F.count("*").alias("rows")), "shard-counts")
    every = spark.range(slots).select(F.col("id").cast("int").alias("slot"))
    held = counts.groupBy(F.col("virtual_slot").alias("slot")).agg(F.sum("size").alias("bytes"), F.sum("rows").alias("rows"))
    stats = shared.table(every.join(held, "slot", "left").na.fill(0, ["bytes", "rows"]), "shard-stats")
    placed = next_map(stats, shards, map_path)
    if not kept:
        shared.forget_at_exit(spark, map_path)
    order = Window.partitionBy("shard").orderBy("virtual_slot", "part").rowsBetween(Window.unboundedPreceding, -1)
    bounds = counts.join(placed.select(F.col("slot").alias("virtual_slot"), "shard", F.col("version").alias("map_version")), "virtual_slot")
    bounds = bounds.select("virtual_slot", "part", "shard", "map_version", F.coalesce(F.sum("rows").over(order), F.lit(0)).alias("rows_before"))  # slots * PARTS rows at most
    within = F.row_number().over(Window.partitionBy("virtual_slot", "part").orderBy("id", "size", "text_crc32"))
    return records.withColumn("within", within).join(F.broadcast(bounds), ["virtual_slot", "part"]).select(
        F.col("id").alias(id_col), "size", "text_crc32", "virtual_slot", "map_version", "shard", (F.col("rows_before") + F.col("within") - 1).cast("long").alias("slot")
    )


def _records(docs: DataFrame, id_col: str, text: str, slots: int, shards: int) -> DataFrame:
    """id, size, text_crc32, virtual_slot and part of each row."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        F.xxhash64(body).alias("h"),
    )
    held = shared.table(rows.withColumn("row", F.monotonically_increasing_id()), "shard-rows")
    total = held.agg(F.sum("size").alias("total"))  # one row
    groups = held.groupBy("h").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).where("n > 1")
    large = groups.join(F.broadcast(total)).where(F.col("bytes") * shards > F.col("total"))
    spread = shared.table(large.select("h", F.lit(True).alias("spread")), "shard-large")  # fewer than shards rows
    by_row = F.xxhash64("h", "row")
    slot = F.pmod(F.when(F.col("spread"), by_row).otherwise(F.col("h")), F.lit(slots)).cast("int")
    part = F.pmod(F.shiftright(by_row, 32), F.lit(PARTS)).cast("int")
    return held.join(F.broadcast(spread), "h", "left").select("id", "size", "text_crc32", slot.alias("virtual_slot"), part.alias("part"))
