"""Compressed arrays by blocks: equal to what NumPy writes and reads, without inflating what is skipped."""

import os
import random
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from slackline.sources import instances, npz


@pytest.fixture
def arrays(spark, monkeypatch):
    monkeypatch.setattr(npz, "NPZ_ROWS", 1000)
    monkeypatch.setattr(npz, "NPZ_NUMBERS", 2000)
    n, e, width = 1237, 5001, 7
    wf = F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: (F.pmod(F.xxhash64("id", i), F.lit(1000)) / 4).cast("double"))
    nodes = spark.range(n).repartition(5).select("id", (F.col("id") % 9).alias("depth"), wf.alias("wf"), (-F.col("id") / 3).alias("bellman"))
    ends = lambda salt: F.pmod(F.xxhash64("edge_id", F.lit(salt)), F.lit(n))
    numbers = {c: F.sqrt(F.col("edge_id") + i).alias(c) for i, c in enumerate(("d_min", "ext", "weight"))}
    edges = spark.range(e).withColumnRenamed("id", "edge_id").repartition(3).select("edge_id", ends(1).alias("from"), ends(2).alias("to"), *numbers.values())
    return instances.Instance(3, [[0, 1], [1, 0]], nodes, edges)


def rows(df, order):
    return [tuple(r) for r in df.orderBy(order).collect()]


def test_checksums_of_joined_parts():
    rnd = random.Random(1)
    for sizes in [(0, 0), (0, 5), (5, 0), (1, 1), (1000, 70_000), (3, 1 << 20)]:
        a, b = (rnd.randbytes(s) for s in sizes)
        assert npz.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_numpy_reads_what_tasks_wrote(arrays, tmp_path):
    path = str(tmp_path / "i.npz")
    instances.to_npz(arrays, path)
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None  # sizes and checksums of all members
    nodes, edges = rows(arrays.nodes, "id"), rows(arrays.edges, "edge_id")
    with np.load(path) as z:
        assert z["node_id"].tolist() == [r[0] for r in nodes] and z["node_depth"].tolist() == [r[1] for r in nodes]
        assert z["node_wf_norm"].tolist() == [r[2] for r in nodes] and z["bellman"].tolist() == [r[3] for r in nodes]
        for i, name in enumerate(("edge_from", "edge_to", "edge_d_min", "edge_ext", "edge_weight")):
            assert z[name].tolist() == [r[i + 1] for r in edges]
        assert z["edge_from"].dtype == np.int64 and int(z["k"]) == 3 and z["distance_matrix"].tolist() == [[0, 1], [1, 0]]
    assert os.listdir(tmp_path) == ["i.npz"]


@pytest.mark.parametrize("by", ["blocks", "numpy"])
def test_both_kinds_of_files_are_read(spark, arrays, tmp_path, by):
    path = str(tmp_path / "i.npz")
    instances.to_npz(arrays, path)
    if by == "numpy":  # a copy that a library makes has no index that would pass for one
        with np.load(path) as z:
            held = {name: z[name] for name in z.files}
        held["edge_ext"] = held["edge_ext"].astype(np.float32).astype(np.float64)
        path = str(tmp_path / "copy.npz")
        np.savez_compressed(path, **held)
        assert npz.restarts(path) is None
    found = instances.from_npz(spark, path)
    assert rows(found.nodes.select(*arrays.nodes.columns), "id") == rows(arrays.nodes, "id")
    leave = lambda df: df.drop("ext") if by == "numpy" else df
    assert rows(leave(found.edges), "edge_id") == rows(leave(arrays.edges), "edge_id")


def test_a_block_is_read_whatever_stands_before_it(spark, arrays, tmp_path):
    path = str(tmp_path / "i.npz")
    instances.to_npz(arrays, path)
    index = npz.restarts(path)["edge_weight"]
    assert index["rows"] == 1000 and len(index["at"]) == 6
    with open(path, "r+b") as f:  # the first three blocks are no deflate streams any more
        f.seek(index["at"][0])
        f.write(b"\xff" * (index["at"][3] - index["at"][0]))
    with zipfile.ZipFile(path) as z, pytest.raises((zlib.error, zipfile.BadZipFile)):
        z.read("edge_weight.npy")
    want = [r["weight"] for r in arrays.edges.orderBy("edge_id").select("weight").collect()]
    for i in (3, 4, 5):
        n = min(1000, 5001 - 1000 * i)
        assert npz.block_at(path, index["at"][i], (n,), index["kind"]).tolist() == want[1000 * i : 1000 * i + n]


def test_a_task_inflates_its_own_bytes_alone(arrays, tmp_path, monkeypatch):
    path = str(tmp_path / "i.npz")
    instances.to_npz(arrays, path)
    index, counted = npz.restarts(path)["node_wf_norm"], []

    class Counting:
        def __init__(self, *a):
            self.own = made(*a)

        def decompress(self, *a):
            out = self.own.decompress(*a)
            counted.append(len(out))
            return out

        @property
        def unconsumed_tail(self):
            return self.own.unconsumed_tail

    made = zlib.decompressobj
    monkeypatch.setattr(npz.zlib, "decompressobj", Counting)
    npz.block_at(path, index["at"][-1], (1237 % index["rows"], 7), index["kind"])
    assert sum(counted) == 1237 % index["rows"] * 7 * 8


def test_odd_instances(spark, arrays, tmp_path):
    path = str(tmp_path / "i.npz")
    none = instances.Instance(1, [[0]], arrays.nodes.limit(0), arrays.edges.limit(0))
    instances.to_npz(none, path)
    found = instances.from_npz(spark, path)
    assert found.nodes.count() == found.edges.count() == 0
    ragged = arrays.nodes.withColumn("wf", F.when(F.col("id") == 5, F.array(F.lit(1.0))).otherwise(F.col("wf")))
    holes = arrays.edges.withColumn("ext", F.when(F.col("edge_id") != 7, F.col("ext")))
    for nodes, edges in ((ragged, arrays.edges), (arrays.nodes, holes)):
        with pytest.raises(Exception, match="numbers each|has nulls"):
            instances.to_npz(instances.Instance(3, [[0, 1], [1, 0]], nodes, edges), path)
    assert os.listdir(tmp_path) == ["i.npz"]
