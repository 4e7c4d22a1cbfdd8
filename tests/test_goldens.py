"""Published results on whole graphs, regenerated. Those of minutes run where SLACKLINE_SLOW is set."""

import os

import pytest
from pyspark.sql import functions as F

from slackline.operators import potentials
from slackline.operators.configs import Context
from slackline.plans import evaluation, explore
from slackline.sources import instances, metrics


def test_equal_work_functions_share_a_value_and_no_array_comes_back(spark):
    rows = [(i, [float(i % 5), 0.0]) for i in range(40)] + [(40, [-0.0, 0.0]), (41, None), (42, [])]
    nodes = spark.createDataFrame(rows, "id long, wf array<double>").repartition(4)
    calls = spark.sparkContext.accumulator(0)

    def counted(wf):
        @F.arrow_udf("double")
        def value(wfs):
            import pyarrow as pa

            calls.add(len(wfs))
            return pa.array([sum(w) for w in wfs.to_pylist()], pa.float64())

        return value(wf)

    found = potentials.distinct(nodes, counted)
    assert found.columns == ["id", "wf", "phi"]
    got = {r["id"]: r["phi"] for r in found.collect()}
    assert got == {i: (None if w is None else sum(w)) for i, w in rows} and calls.value == 6
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.splitlines()[0].startswith("Project [id#") and "Join LeftOuter, ((__a" in plan
    timed = {r["id"]: r["phi"] for r in potentials.within(nodes, counted, 600, blocks=3).collect()}
    assert timed == got


def test_values_looked_up_from_constraints_violate_nothing_and_are_not_robust(spark):
    c = Context.of(4, metrics.circle_matrix(6))
    g = explore.explore(spark, c, c.configs, explore.point_transitions(6))
    plain = instances.from_graph(g)
    known = explore.bellman(g.nodes, g.edges)
    nodes = plain.nodes.drop("bellman").join(known, "id").withColumn("bellman", F.col("bellman").cast("double"))
    inst = instances.Instance(plain.k, plain.distances, nodes, plain.edges)
    table = {tuple(r["wf"]): float(r["bellman"]) for r in nodes.collect()}
    lookup = potentials.arrow(lambda wf: table.get(tuple(wf.tolist()), 0.0))
    phi = lambda wf: lookup(wf)["value"]
    turned = F.array(*(F.lit(i) for i in reversed(range(len(c.configs)))))
    found = evaluation.run(inst, phi, permuted=(turned, phi)).metrics
    assert (found["total_nodes"], found["total_edges"]) == (1001, 6006)
    assert found["violations_k"] == 0 and found["robustness"] is False and evaluation.combined([found]) == 0.0


@pytest.mark.skipif(not os.environ.get("SLACKLINE_SLOW"), reason="minutes; set SLACKLINE_SLOW")
def test_rides_of_four_servers_violate_seventeen_times(spark):
    c = Context.of(4, metrics.circle_matrix(12))
    starts = [cfg for cfg in c.configs if all(p % 2 == 0 for p in cfg)]
    p = potentials.Canonical.unifying(c)
    g = explore.explore(spark, c, starts, explore.ride_transitions(6), symmetry_step="auto", potential=lambda wf: p.arrow()(wf)["value"])
    assert (g.nodes.count(), g.edges.count(), g.violations.count()) == (166_681, 7_000_602, 17)
