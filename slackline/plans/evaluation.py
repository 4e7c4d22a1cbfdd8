"""Evaluating a potential on instances: the flagship plan.

The potential runs once for each distinct work function, edges get both ends by joins that the planner chooses, and
all edge metrics come from one aggregation.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slackline.functions import arrays
from slackline.operators import evaluate, potentials
from slackline.plans import control, scratch
from slackline.sources.instances import Instance


@dataclass
class Report:
    nodes: DataFrame
    edges: DataFrame
    metrics: dict

    def save(self, path: str) -> None:
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        self.edges.write.mode("overwrite").parquet(f"{path}/edges")
        row = json.dumps(clean(self.metrics), sort_keys=True)
        self.nodes.sparkSession.createDataFrame([(row,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metrics")

    @classmethod
    def load(cls, spark, path: str) -> Report:
        return cls(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"), json.loads(spark.read.text(f"{path}/metrics").first()["value"]))


def clean(value):
    """JSON has no infinities: they and NaN become null."""
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, dict):
        return {k: clean(v) for k, v in value.items()}
    return [clean(v) for v in value] if isinstance(value, (list, tuple)) else value


def run(
    instance: Instance,
    potential: Callable[[Column], Column],
    rho: float | None = None,
    renormalized: bool = True,
    only_violations: bool = False,
    digits: int | None = None,
    sample: int | None = 100,
    permuted: tuple[Column, Callable[[Column], Column]] | None = None,
    seconds: float | None = None,
) -> Report:
    """The full report. ``permuted``: positions and the potential in that order, for the robustness check, which runs
    only where nothing is violated. With ``seconds`` the potential is evaluated as far as they go: nodes that it didn't
    come to are unevaluated, and edges at them unprocessed. ``metrics`` has the seconds of each phase under ``times``.
    """
    rho, timer = instance.k if rho is None else rho, control.Timer()
    size = len(instance.context.configs)
    with timer("potential"):
        evaluated = potentials.distinct(instance.nodes, potential) if seconds is None else potentials.within(instance.nodes, potential, seconds)
        values = scratch.table(evaluated, "evaluated")
    side = lambda e, s: values.select(F.col("id").alias(e), F.col("phi").alias(f"{s}_phi"), F.col("bellman").alias(f"{s}_bellman"), F.col("wf").alias(f"{s}_wf"))
    with timer("edges"):
        edges = instance.edges.join(side("from", "u"), "from").join(side("to", "v"), "to")
        if renormalized and not only_violations:
            edges = evaluate.renormalized(edges, potential)
            if seconds is not None:
                edges = edges.withColumn("v_renorm_phi", F.when(F.col("v_phi").isNotNull(), F.col("v_renorm_phi")))
        edges = scratch.table(edges, "evaluated-edges")
    with timer("report"):
        found = evaluate.report(edges, instance.k, size, rho, renormalized, digits, only_violations).first().asDict()
    if not only_violations:
        with timer("nodes"):
            found |= evaluate.bellman_nodes(values).first().asDict()
            found |= evaluate.bellman_nodes(values.where("depth > 0"), "bellman_non_initial_node").first().asDict()
            found |= {"total_nodes": values.count(), "rho": float(rho)}
        if sample:
            with timer("bound"):
                found |= evaluate.opt_upper_bound(values, potential, sample, k=instance.k, size=size).first().asDict()
        with timer("fingerprint"):
            found |= evaluate.fingerprint(edges).first().asDict()
    found["robustness"] = None
    if permuted is not None and found["violations_k"] == 0:
        with timer("robustness"):
            found["robustness"] = evaluate.robustness(edges, values, permuted[1], permuted[0], rho).first()["robust"]
    return Report(values, edges, found | {"times": timer.seconds})


def combined(reports: list[dict]) -> float:
    """The product of violation and coverage scores; 0 if any instance isn't robust."""
    out = 1.0
    for r in reports:
        score = r.get("violations_k_score")
        out *= (1.0 if score is None else score) * r.get("processed_normalized_edges_score", 1.0)
        if r.get("robustness") is False:
            return 0.0
    return out


def zero(wf: Column) -> Column:
    return potentials.SIMPLE["zero"](wf)


def total(wf: Column) -> Column:
    return arrays.total(F.transform(wf, lambda x: x.cast("long")))
