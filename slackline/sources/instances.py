"""Stored instances: nodes, edges and a one-row meta table, as Parquet; importers for older forms.

nodes: id (0, 1, ... without gaps), depth, wf, bellman (null if unknown); edges: edge_id, from, to, d_min, ext, weight;
meta: k, distances. Pickled payloads are not read: hand the unpickled dict to ``from_payload``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slackline.operators.configs import Context
from slackline.plans import scratch
from slackline.sources import npz

NODE_SCHEMA = "id long, depth long, wf array<double>, bellman double"
EDGE_SCHEMA = "edge_id long, from long, to long, d_min double, ext double, weight double"


@dataclass
class Instance:
    k: int
    distances: list[list[int]]
    nodes: DataFrame
    edges: DataFrame

    @property
    def context(self) -> Context:
        return Context.of(self.k, self.distances)

    def check(self) -> Instance:
        """Ids are dense, as edges assume; raises otherwise."""
        found = self.nodes.agg(F.count("*").alias("n"), F.count_distinct("id").alias("d"), F.min("id").alias("low"), F.max("id").alias("high")).first()
        if found["n"] and (found["d"] != found["n"] or found["low"] != 0 or found["high"] != found["n"] - 1):
            raise ValueError("node ids are 0, 1, ... without gaps")
        return self

    def save(self, path: str) -> None:
        spark = self.nodes.sparkSession
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        self.edges.write.mode("overwrite").parquet(f"{path}/edges")
        spark.createDataFrame([(self.k, [list(map(int, r)) for r in self.distances])], "k long, distances array<array<long>>").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


#: Bytes of an array that may be broadcast, at most.
SHARED_BYTES = 256 << 20


@dataclass
class Shared:
    """What many candidates read: instances by name, as tables, and small arrays, broadcast once."""

    instances: dict[str, Instance]
    arrays: dict[str, object]

    @classmethod
    def of(cls, spark: SparkSession, instances: dict[str, Instance], arrays: dict | None = None, most: int = SHARED_BYTES) -> Shared:
        """Raises for an array over ``most`` bytes: that belongs in a table."""
        sent = {}
        for name, a in (arrays or {}).items():
            if a.nbytes > most:
                raise ValueError(f"{name} has {a.nbytes} bytes, {most} at most are broadcast")
            sent[name] = spark.sparkContext.broadcast(a)
        return cls(dict(instances), sent)

    def array(self, name: str):
        return self.arrays[name].value


def load(spark: SparkSession, path: str) -> Instance:
    meta = spark.read.parquet(f"{path}/meta").first()
    return Instance(meta["k"], [list(r) for r in meta["distances"]], spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")).check()


def from_payload(spark: SparkSession, payload: dict) -> Instance:
    """From a dict with k, distance_matrix, nodes, edges and perhaps bellman; other keys are ignored, missing ones raise.

    The payload is on the driver already; it crosses to Spark as columns.
    """
    import pyarrow as pa

    nodes, edges, values = payload["nodes"], payload["edges"], payload.get("bellman")
    values = [None] * len(nodes) if values is None or len(values) == 0 else [float(b) for b in values]
    floats = lambda name: pa.array([float(e[name]) for e in edges], pa.float64())
    node_table = pa.table({
        "id": pa.array([int(n["id"]) for n in nodes], pa.int64()), "depth": pa.array([int(n["depth"]) for n in nodes], pa.int64()),
        "wf": pa.array([[float(x) for x in n["wf_norm"]] for n in nodes], pa.list_(pa.float64())), "bellman": pa.array(values, pa.float64()),
    })
    edge_table = pa.table({"edge_id": pa.array(range(len(edges)), pa.int64()), **{c: pa.array([int(e[c]) for e in edges], pa.int64()) for c in ("from", "to")}, **{c: floats(c) for c in ("d_min", "ext", "weight")}})
    matrix = [[int(x) for x in row] for row in payload["distance_matrix"]]
    return Instance(int(payload["k"]), matrix, spark.createDataFrame(node_table, NODE_SCHEMA), spark.createDataFrame(edge_table, EDGE_SCHEMA)).check()


#: Columns of an instance by array of the compressed form.
_NODE_ARRAYS = {"id": "node_id", "depth": "node_depth", "wf": "node_wf_norm"}
_EDGE_ARRAYS = {"from": "edge_from", "to": "edge_to", "d_min": "edge_d_min", "ext": "edge_ext", "weight": "edge_weight"}


def from_npz(spark: SparkSession, path: str) -> Instance:
    """From compressed arrays: k, distance_matrix, node_id, node_depth, node_wf_norm, edge_from and so on.

    ``path`` is one that executors see. The driver reads headers; tasks read blocks of rows (see ``npz``). The
    instance is written to the shared folder, since reading compressed arrays again is dear.
    """
    import numpy as np

    shapes = npz.shapes(path)
    with np.load(path, allow_pickle=False) as z:
        k, matrix = int(z["k"]), [[int(x) for x in row] for row in z["distance_matrix"]]
    nodes = dict(_NODE_ARRAYS)
    if "bellman" in shapes and shapes["bellman"][0]:
        nodes["bellman"] = "bellman"
    node_rows = scratch.table(npz.read(spark, path, nodes, NODE_SCHEMA), "npz-nodes")
    node_rows = node_rows if "bellman" in nodes else node_rows.withColumn("bellman", F.lit(None).cast("double"))
    return Instance(k, matrix, node_rows, scratch.table(npz.read(spark, path, _EDGE_ARRAYS, EDGE_SCHEMA, "edge_id"), "npz-edges")).check()


def to_npz(instance: Instance, path: str) -> None:
    """The compressed form, as ``from_npz`` reads it: tasks compress blocks of rows and write them at their places."""
    import numpy as np

    first = instance.nodes.select("wf").first()
    width = len(first["wf"]) if first else 0
    nodes = {c: (a, width if c == "wf" else 0, "<f8" if c == "wf" else "<i8") for c, a in _NODE_ARRAYS.items()}
    if instance.nodes.where("bellman is null").isEmpty():
        nodes["bellman"] = ("bellman", 0, "<f8")
    edges = {c: (a, 0, "<i8" if c in ("from", "to") else "<f8") for c, a in _EDGE_ARRAYS.items()}
    small = {"k": np.array(instance.k, "<i8"), "distance_matrix": np.array([[int(x) for x in row] for row in instance.distances], "<i8")}
    npz.write(instance.nodes.sparkSession, path, small, [(instance.nodes, "id", nodes), (instance.edges, "edge_id", edges)])


def from_graph(graph) -> Instance:
    """An explored graph as an instance without Bellman values."""
    nodes = graph.nodes.select("id", "depth", F.transform("wf", lambda x: x.cast("double")).alias("wf"), F.lit(None).cast("double").alias("bellman"))
    edges = graph.edges.select("edge_id", "from", "to", *(F.col(c).cast("double").alias(c) for c in ("d_min", "ext", "weight")))
    return Instance(graph.context.k, [list(r) for r in graph.context.distances], nodes, edges)
