"""Replays of hot keys in many tasks, and explorations: Bloom filters, events, starts from tables, constraints."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from slackline.operators import workfunctions
from slackline.operators.configs import Context
from slackline.plans import explore
from slackline.plans.visited import Bloom
from slackline.sources import metrics


def folded(context, rows, start, rides=False):
    out = {}
    for k, at, s, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        n, wf = out.get(k, (0, context.initial(start)))
        out[k] = n + 1, context.ride(wf, s, t) if rides else context.update(wf, t)
    return {k: (n, wf.tolist()) for k, (n, wf) in out.items()}


@pytest.mark.parametrize("rides", [False, True])
def test_a_hot_key_is_folded_in_many_tasks(spark, rides):
    context, rnd = Context.of(2, metrics.circle_matrix(6)), random.Random(2)
    keys = [7] * 3000 + [None] * 40 + [rnd.randrange(30) for _ in range(400)]
    rows = [(k, i, rnd.randrange(3) * 2 + 1, rnd.randrange(3) * 2 if rides else rnd.randrange(6)) for i, k in enumerate(keys)]
    rnd.shuffle(rows)
    table = spark.createDataFrame(rows, "user_id long, at long, s long, t long").repartition(5)
    out = workfunctions.replay(table, context, (0, 2), order=["at"], r="t", rides=("s", "t") if rides else None, partitions=12)
    assert {r["user_id"]: (r["n"], list(r["wf"])) for r in out.collect()} == folded(context, rows, (0, 2), rides)
    ranged = table.repartitionByRange(12, "user_id", "at").where("user_id = 7").select(F.spark_partition_id()).distinct().count()
    assert ranged > 6
    few = workfunctions.replay(table.where("user_id = 3"), context, (0, 2), order=["at"], r="t", rides=("s", "t") if rides else None)
    assert few.count() == 1 and workfunctions.replay(table.limit(0), context, (0, 2), order=["at"], r="t").count() == 0


def test_operators_of_one_configuration(spark):
    context = Context.of(1, [[0]])
    table = spark.createDataFrame([(1, i, 0) for i in range(50)], "user_id long, at long, r long")
    assert workfunctions.replay(table, context, (0,), order=["at"], partitions=4).collect()[0]["n"] == 50


def wide(spark, rows=150):
    """Starts with values far apart: a long, thin graph."""
    rnd = np.random.default_rng(5)
    return spark.createDataFrame([(i, rnd.integers(0, 30, 10).tolist()) for i in range(rows)], "start long, wf array<long>")


@pytest.fixture(scope="module")
def plain(spark):
    context, told = Context.of(2, metrics.circle_matrix(4)), []
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    g = explore.explore(spark, context, wide(spark), explore.point_transitions(4), hook=lambda e, f: told.append((e, f)))
    yield g, told
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def by_hand(context, starts):
    """Nodes by values with their paths, level by level and one at a time."""
    found = {}
    for i, wf in enumerate(starts):
        found.setdefault(tuple(np.array(wf) - min(wf)), [i])
    level = sorted(found, key=found.get)
    while level:
        new = {}
        for w in level:
            for r in range(context.m):
                v = context.update(np.array(w), r)
                v = tuple((v - v.min()).tolist())
                if v not in found and (v not in new or [*found[w], r] < new[v]):
                    new[v] = [*found[w], r]
        found |= new
        level = sorted(new, key=new.get)
    return found


def test_starts_from_a_table(plain, spark):
    g, told = plain
    want = by_hand(g.context, [r["wf"] for r in wide(spark).orderBy("start").collect()])
    rows = g.nodes.collect()
    assert {tuple(r["wf"]): list(r["path"]) for r in rows} == want and len(rows) == len(want)
    order = sorted(rows, key=lambda r: r["id"])  # the order of discovery
    assert [r["id"] for r in order] == list(range(len(rows))) and [(r["depth"], list(r["path"])) for r in order] == sorted((len(p) - 1, p) for p in want.values())
    assert g.edges.count() == 4 * len(rows)
    levels = [f for e, f in told if e == "level"]
    assert [f["nodes"] for f in levels] == g.levels and levels[0]["depth"] == 0
    for before, f in zip(levels, levels[1:]):
        assert f["expanded"] == 4 * before["nodes"] and f["new"] == f["nodes"] and f["seconds"] > 0 and f["shuffle_bytes"] > 0 and f["gc_seconds"] >= 0
        assert f["reached"] is None or f["new"] <= f["reached"] <= f["expanded"]


def test_a_bloom_filter_spares_the_shuffle_of_the_exact_set(plain, spark):
    g, told = plain
    heard = []
    filters = Bloom(capacity=1000, error=0.01)
    again = explore.explore(spark, g.context, wide(spark), explore.point_transitions(4), visited=filters, hook=lambda e, f: heard.append((e, f)))
    key = lambda g: sorted((r["id"], tuple(r["wf"]), tuple(r["path"])) for r in g.nodes.collect())
    assert key(again) == key(g) and len(filters.filters) > 1  # rotated
    late = lambda told: sum(f["shuffle_bytes"] for e, f in told if e == "level" and f["depth"] > 8)
    assert 0 < late(heard) < late(told)


def test_a_bloom_filter_alone_loses_few(plain, spark):
    g, _ = plain
    lossy = explore.explore(spark, g.context, wide(spark), explore.point_transitions(4), visited=Bloom(capacity=5000, error=1e-7, exact=False))
    assert lossy.nodes.count() == g.nodes.count()


def test_filters_hold_what_they_were_given(spark):
    rnd = random.Random(4)
    rows = [(bytes(rnd.randrange(256) for _ in range(16)),) for _ in range(3000)]
    table, other = (spark.createDataFrame(part, "hash binary") for part in (rows[:1500], rows[1500:]))
    b = Bloom(capacity=2000, error=0.02)
    b.add(table, 1500)
    held = b.may_hold(spark, b.filters)
    assert table.where(held("hash")).count() == 1500
    assert other.where(held("hash")).count() < 0.05 * 1500
    assert b.unseen(spark.createDataFrame(rows, "hash binary"), table).count() == 1500
    with pytest.raises(ValueError, match="outgrow"):
        Bloom(capacity=1 << 33).add(table, 1)


def test_constraints_are_relaxed_by_what_fell(plain, spark):
    g, _ = plain
    facts = []
    found = {r["id"]: r["bellman"] for r in explore.bellman(g.nodes, g.edges, facts=facts).collect()}
    edges, values = [(e["from"], e["to"], e["weight"]) for e in g.edges.collect()], dict.fromkeys(found, 0)
    for _ in range(len(found)):
        low = dict(values)
        for u, v, w in edges:
            low[u] = min(low[u], values[v] + w)
        if low == values:
            break
        values = low
    assert found == values
    fallen = [f["fallen"] for f in facts]
    assert fallen[-1] == 0 and sum(fallen) < len(found) * len(fallen) / 2  # the other nodes pushed nothing
    nodes = spark.createDataFrame([(i,) for i in range(3)], "id long")
    for bad in ([(0, 1, -2), (1, 0, 1)], [(2, 2, -1)], [(0, 1, -1), (1, 2, -1), (2, 0, 1)]):
        with pytest.raises(RuntimeError, match="feasible"):
            explore.bellman(nodes, spark.createDataFrame(bad, "from long, to long, weight long"))
    fine = explore.bellman(nodes, spark.createDataFrame([(0, 1, -2), (1, 0, 2), (1, 2, 5)], "from long, to long, weight long"))
    assert {r["id"]: r["bellman"] for r in fine.collect()} == {0: -2, 1: 0, 2: 0}
