"""What the operators of this subpackage share: scratch tables, input loading and Arrow batch sizes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes in one Arrow batch: bounds a Python worker's memory however long the documents are.
ARROW_BYTES = 4 << 20

#: What operators remember in a worker process: how to forget it, by operator.
REMEMBERED: dict = {}


def working(operator: str) -> None:
    """A worker process that turns to an operator forgets what others remember in it: workers serve many stages."""
    for name, forget in REMEMBERED.items():
        if name != operator:
            forget()


def session(df_or_spark) -> SparkSession:
    """The session, with Arrow batches of at most ``ARROW_BYTES``; a smaller bound of its own stays.

    Results are lazy, so the bound holds from then on; it changes batches of large rows only.
    """
    spark = df_or_spark if isinstance(df_or_spark, SparkSession) else df_or_spark.sparkSession
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if _bytes(spark.conf.get(name)) > ARROW_BYTES:
        spark.conf.set(name, str(ARROW_BYTES))
    return spark


def _bytes(size: str) -> int:
    """Of a size as Spark prints it, such as 64m or 67108864b."""
    digits = size.rstrip("bBkKmMgG")
    scale = {"k": 10, "m": 20, "g": 30}.get(size[len(digits) :][:1].lower(), 0)
    return int(digits) << scale


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a local one only where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _local_root()
    return root.rstrip("/")


_LOCAL: list[str] = []


def _local_root() -> str:
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="slackline-"))
    return _LOCAL[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/slackline/{name}-{uuid.uuid4().hex}"


def forget_at_exit(spark: SparkSession, path: str) -> None:
    """Scratch that is there is deleted when the application ends: lazy results read it until then."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)


def table(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: this cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    schema = df.schema
    df.write.option("compression", codec).parquet(path)
    forget_at_exit(spark, path)
    return spark.read.schema(schema).parquet(path)


def written_bytes(df: DataFrame) -> int:
    """The size of the files of a table that was written, as the planner sees it: no job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def documents(spark: SparkSession, sf_dir: str, table_name: str = "documents") -> DataFrame:
    return session(spark).read.parquet(f"{sf_dir}/{table_name}.parquet")


def text_or_empty(column: str = "text"):
    """A null text counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, prolonged until it clashes with no column of ``df``, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def arrow_schema(ddl: str):
    """The Arrow schema of a DDL string, on an executor too (no session is needed)."""
    import pyarrow as pa

    kinds = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.strip().split(" ") for c in ddl.split(","))])


def one_of_each(docs: DataFrame, kept: DataFrame, id_col: str, text: str) -> DataFrame:
    """A row of ``docs`` for each row of ``kept`` (id, SHA-256 of the text), whatever its other columns.

    Join and duplicate removal have the same keys, so texts are shuffled once.
    """
    names = [fresh(docs, f"kept_{n}") for n in ("id", "null", "digest")]
    keys = lambda i, digest: [F.coalesce(i.cast("string"), F.lit("")), i.isNull(), digest]
    left = docs.select("*", *(k.alias(n) for k, n in zip(keys(F.col(id_col), F.sha2(text_or_empty(text), 256)), names)))
    right = kept.toDF("id", "digest").select(*(k.alias(n) for k, n in zip(keys(F.col("id"), F.col("digest")), names)))
    return left.join(right, names, "left_semi").dropDuplicates(names).drop(*names)
