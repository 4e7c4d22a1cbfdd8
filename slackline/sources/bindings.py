"""Instances from other tables: embeddings as work functions, events as edges and requests, parts as candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slackline.functions import arrays

POINTS = 64
#: Scale that makes an embedding's floats integers without rounding ambiguity.
SCALE = 1024
#: Nodes with this label have no potential: a partial evaluation.
UNEVALUATED = 3


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pair_potential(wf: Column) -> Column:
    """The canonical potential of one server on a circle: the least w(a) + w(antipode of a)."""
    return arrays.let(wf, lambda w: F.array_min(F.array(*(w[a] + w[(a + POINTS // 2) % POINTS] for a in range(POINTS // 2)))))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label, raw, low, wf, bellman, phi. One server on a circle of 64 points; phi is null if unevaluated."""
    raw = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE))
    base = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"), raw.alias("raw"))
    base = base.withColumn("low", F.array_min("raw")).withColumn("wf", arrays.normalized(F.col("raw")))
    phi = F.when(F.col("label") != UNEVALUATED, pair_potential(F.col("wf")))
    return base.withColumn("bellman", F.col("label") * 10 + F.col("id") % 7).withColumn("phi", phi)


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edge_id, request, depth, from, to: a user's successive events, each at a node."""
    embeddings = read(spark, sf_dir, "embeddings").agg(F.count("*").alias("n"))  # one row
    at = F.col("event_id") % F.col("n")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = read(spark, sf_dir, "events").join(F.broadcast(embeddings)).select("event_id", "user_id", "ts", at.alias("from"))
    steps = steps.withColumn("to", F.lead("from").over(order)).withColumn("depth", (F.row_number().over(order) - 1).cast("long"))
    return steps.where("to is not null").select(F.col("event_id").alias("edge_id"), (F.col("event_id") % POINTS).alias("request"), "depth", "from", "to")


def ends(node_table: DataFrame, side: str, columns: list[str]) -> DataFrame:
    """Node columns prefixed with u_ or v_, and the edge column that they join on."""
    return node_table.select(F.col("id").alias("from" if side == "u" else "to"), *(F.col(c).alias(f"{side}_{c}") for c in columns))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """links with d_min, ext and both ends' phi, bellman and wf. The join strategy is the planner's."""
    n = nodes(spark, sf_dir)
    columns = ["raw", "low", "wf", "bellman", "phi"]
    joined = links(spark, sf_dir).join(ends(n, "u", columns), "from").join(ends(n, "v", columns), "to")
    ext = arrays.growth(F.col("u_raw"), F.col("v_raw"))
    return joined.select("edge_id", "request", "depth", "from", "to", (F.col("v_low") - F.col("u_low")).alias("d_min"), ext.alias("ext"), "u_phi", "v_phi", "u_bellman", "v_bellman", "u_wf", "v_wf")


def requests(spark: SparkSession, sf_dir: str, m: int) -> DataFrame:
    """Each event as a request: r on a circle of m points, and a ride s to t on the doubled one."""
    e = read(spark, sf_dir, "events")
    return e.select("user_id", "ts", "event_id", (F.col("event_id") % m).alias("r"), (F.col("event_id") % m * 2 + 1).alias("s"), (F.col("user_id") % m * 2).alias("t"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """candidate_id, family, parent_id, coefs and stage results a to d, null where a stage was not reached."""
    done = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("candidate_id")).agg(
        F.count_if((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45)).alias("a"),
        F.count_if(F.col("l_discount") >= 0.09).alias("b"),
        F.sum(F.col("l_quantity").cast("long")).alias("c"),
        F.count_distinct("l_suppkey").alias("d"),
    )
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("candidate_id"), (F.col("p_size") % 7).cast("long").alias("family"), F.when(F.col("p_partkey") > 0, F.floor(F.col("p_partkey") / 2)).alias("parent_id"))
    coefs = F.array(*(arrays.portable_hash(F.col("candidate_id") * 6 + i) % 5 - 2 for i in range(6)))
    a, b = F.coalesce("a", F.lit(0).cast("long")), F.coalesce("b", F.lit(0).cast("long"))
    passed_b = (a == 0) & (b <= 5)
    return parts.join(done, "candidate_id", "left").select(
        "candidate_id", "family", "parent_id", coefs.alias("coefs"), a.alias("stage_a"), F.when(a == 0, b).alias("stage_b"),
        F.when(passed_b, F.col("c")).alias("stage_c"), F.when(passed_b & (F.col("c") < 700), F.col("d")).alias("stage_d"),
    )


#: The same tables as DuckDB common table expressions.
NODES_SQL = f"""
raw AS (SELECT vec_id AS id, CAST(label AS BIGINT) AS label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT)) AS raw FROM embeddings),
base AS (SELECT id, label, raw, list_min(raw) AS low, list_transform(raw, lambda x: x - list_min(raw)) AS wf FROM raw),
nodes AS (SELECT id, label, raw, low, wf, label * 10 + id % 7 AS bellman,
  CASE WHEN label <> {UNEVALUATED} THEN list_min(list_transform(range({POINTS}), lambda a: wf[a + 1] + wf[(a + {POINTS // 2}) % {POINTS} + 1])) END AS phi FROM base)"""
LINKS_SQL = f"""
steps AS (SELECT event_id, event_id % n AS u, lead(event_id % n) OVER w AS v, row_number() OVER w - 1 AS depth
  FROM events, (SELECT count(*) AS n FROM embeddings) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
links AS (SELECT event_id AS edge_id, event_id % {POINTS} AS request, depth, u, v FROM steps WHERE v IS NOT NULL)"""
EDGES_SQL = f"""{NODES_SQL}, {LINKS_SQL},
edges AS (SELECT edge_id, request, depth, l.u, l.v, nv.low - nu.low AS d_min,
  list_max(list_transform(list_zip(nu.raw, nv.raw), lambda p: p[2] - p[1])) AS ext,
  nu.phi AS u_phi, nv.phi AS v_phi, nu.bellman AS u_bellman, nv.bellman AS v_bellman, nu.wf AS u_wf, nv.wf AS v_wf
  FROM links l JOIN nodes nu ON nu.id = l.u JOIN nodes nv ON nv.id = l.v)"""
CANDIDATES_SQL = f"""
done AS (SELECT l_partkey AS candidate_id, count(*) FILTER (l_returnflag = 'R' AND l_quantity > 45) AS a,
  count(*) FILTER (l_discount >= 0.09) AS b, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS c, count(DISTINCT l_suppkey) AS d
  FROM lineitem GROUP BY 1),
candidates AS (SELECT p_partkey AS candidate_id, CAST(p_size % 7 AS BIGINT) AS family, CASE WHEN p_partkey > 0 THEN p_partkey // 2 END AS parent_id,
  [{", ".join(f"{arrays.portable_hash_sql(f'p_partkey * 6 + {i}')} % 5 - 2" for i in range(6))}] AS coefs, coalesce(a, 0) AS stage_a,
  CASE WHEN coalesce(a, 0) = 0 THEN coalesce(b, 0) END AS stage_b,
  CASE WHEN coalesce(a, 0) = 0 AND coalesce(b, 0) <= 5 THEN c END AS stage_c,
  CASE WHEN coalesce(a, 0) = 0 AND coalesce(b, 0) <= 5 AND c < 700 THEN d END AS stage_d
  FROM part LEFT JOIN done ON done.candidate_id = p_partkey)"""
