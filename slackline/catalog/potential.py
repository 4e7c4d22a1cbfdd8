"""Potentials: latent tables, canonical and nested minima, lookups, scores of candidates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from slackline.catalog.registry import query
from slackline.operators import potentials
from slackline.operators.configs import Context
from slackline.sources import bindings, metrics
from slackline.sources.bindings import NODES_SQL, POINTS


def _circle() -> Context:
    return Context.of(1, metrics.circle_matrix(POINTS))


def pairs(coefs=None) -> potentials.Canonical:
    """Two places on the whole circle, w(a) + w(antipode of b) - coef * d(a, b): 4 096 assignments."""
    return potentials.Canonical(_circle(), 2, [[1], [-2]], coefs)


_D = f"least(abs(a - b), {POINTS} - abs(a - b))"
LATENT_SQL = f"latent AS (SELECT a * {POINTS} + b AS a_id, a, b FROM range({POINTS}) p(a), range({POINTS}) q(b)), priced AS (SELECT a_id, a, b, (b + {POINTS // 2}) % {POINTS} AS opposite, {_D} AS d FROM latent)"


def _named(spark, sf_dir, coefs=None) -> potentials.Canonical:
    """Places can be the points that events request."""
    found = bindings.read(spark, sf_dir, "events").select((F.col("event_id") % POINTS).alias("p")).distinct().collect()  # POINTS rows at most
    return potentials.Canonical(_circle(), 2, [[1], [-2]], coefs, support=sorted(r["p"] for r in found))


_NAMED_SQL = f"p AS (SELECT DISTINCT event_id % {POINTS} AS x FROM events), priced AS (SELECT row_number() OVER (ORDER BY a, b) - 1 AS a_id, a, (b + {POINTS // 2}) % {POINTS} AS opposite, {_D} AS d FROM (SELECT l.x AS a, r.x AS b FROM p l, p r))"


@query(f"WITH {_NAMED_SQL} SELECT a_id, a AS first, opposite AS second FROM priced")
def latent_index(spark, sf_dir):
    return _named(spark, sf_dir).latents(spark).select("a_id", F.col("gathers")[0].alias("first"), F.col("gathers")[1].alias("second"))


@query(f"WITH {_NAMED_SQL} SELECT a_id, CAST(2 * d AS BIGINT) AS penalty FROM priced")
def latent_penalty(spark, sf_dir):
    return _named(spark, sf_dir, [2]).latents(spark).select("a_id", "penalty")


@query(f"WITH {NODES_SQL}, {LATENT_SQL}, v AS (SELECT id, a_id, wf[a + 1] + wf[opposite + 1] - 2 * d AS value FROM nodes, priced) SELECT id, count(*) AS assignments, CAST(min(value) AS BIGINT) AS least, CAST(max(value) AS BIGINT) AS most, CAST(sum(value) AS BIGINT) AS total, CAST(sum(value * (a_id + 1)) AS BIGINT) AS checksum FROM v GROUP BY id")
def latent_values(spark, sf_dir):
    """The values of all assignments at every node, summed up; the checksum tells which is whose."""
    p = pairs([2])
    one = p.latents(spark).agg(F.collect_list(F.struct("a_id", "gathers", "penalty")).alias("latents"))  # one row
    at = bindings.nodes(spark, sf_dir).select("id", "wf").join(F.broadcast(one)).select("id", "wf", F.explode("latents").alias("l"))
    value = F.element_at("wf", (F.col("l.gathers")[0] + 1).cast("int")) + F.element_at("wf", (F.col("l.gathers")[1] + 1).cast("int")) - F.col("l.penalty")
    v = at.select("id", F.col("l.a_id").alias("a_id"), value.alias("value"))
    return v.groupBy("id").agg(F.count("*").alias("assignments"), F.min("value").alias("least"), F.max("value").alias("most"), F.sum("value").alias("total"), F.sum(F.col("value") * (F.col("a_id") + 1)).alias("checksum"))


_BEST = f"WITH {NODES_SQL}, {LATENT_SQL}, v AS (SELECT id, a_id, wf[a + 1] + wf[opposite + 1] - 2 * d AS value FROM nodes, priced) SELECT id, CAST(min(value) AS BIGINT) AS value, min((value, a_id))[2] AS a_id FROM v GROUP BY id"


@query(_BEST)
def canonical_potential(spark, sf_dir):
    """As one Catalyst expression over the latent table."""
    return pairs([2]).native(bindings.nodes(spark, sf_dir).select("id", "wf")).select("id", "value", "a_id")


@query(_BEST)
def canonical_potential_arrow(spark, sf_dir):
    """The same in Arrow batches, once for each distinct work function."""
    n = potentials.distinct(bindings.nodes(spark, sf_dir).select("id", "wf"), pairs([2]).arrow())
    return n.select("id", "phi.value", "phi.a_id")


@query(f"WITH {NODES_SQL}, {LATENT_SQL} SELECT id, c AS candidate_id, CAST(min(wf[a + 1] + wf[opposite + 1] - (c - 2) * d) AS BIGINT) AS value FROM nodes, priced, range(5) t(c) GROUP BY ALL")
def candidate_scores(spark, sf_dir):
    """Five vectors of coefficients on one penalty-free pass."""
    c = spark.createDataFrame([(i, [i - 2]) for i in range(5)], "candidate_id long, coefs array<long>")
    return pairs().scores(bindings.nodes(spark, sf_dir), c)


@query(_BEST)
def canonical_potential_full(spark, sf_dir):
    """The same by branch and bound: a task for each point that the first place can be, and the least of their minima."""
    return pairs([2]).spread(bindings.nodes(spark, sf_dir).select("id", "wf"))


@query(f"""WITH {NODES_SQL}, inner_best AS (SELECT id, y.b, min(wf[z.c + 1] - least(abs(y.b - z.c), {POINTS} - abs(y.b - z.c))) AS v FROM nodes, range({POINTS}) y(b), range({POINTS}) z(c) GROUP BY ALL)
SELECT n.id, CAST(min(wf[a + 1] + wf[(i.b + {POINTS // 2}) % {POINTS} + 1] + v - 2 * least(abs(a - i.b), {POINTS} - abs(a - i.b))) AS BIGINT) AS value FROM nodes n JOIN inner_best i ON i.id = n.id, range({POINTS}) x(a) GROUP BY n.id""")
def canonical_three(spark, sf_dir):
    """Three places in a chain, 262 144 assignments, by branch and bound in Arrow batches."""
    p = potentials.Canonical(_circle(), 3, [[1], [-2], [3]], [2, 0, 1])
    n = potentials.distinct(bindings.nodes(spark, sf_dir).select("id", "wf"), p.arrow())
    return n.select("id", "phi.value")


_STAGES = [potentials.Stage(0, [(False, 1)]), potentials.Stage(1, [(True, 1)], [((True, 1), (False, 1), -1.0)])]


_NESTED = f"""WITH {NODES_SQL}, i AS (SELECT id, o.a, min(wf[j.b + 1] - least(abs(o.a - j.b), {POINTS} - abs(o.a - j.b))) AS inner_best FROM nodes, range({POINTS}) o(a), range({POINTS}) j(b) GROUP BY ALL)
SELECT id, CAST(min(wf[i.a + 1] + inner_best) AS DOUBLE) AS phi FROM i JOIN nodes USING (id) GROUP BY id"""


@query(_NESTED)
def evader_potential(spark, sf_dir):
    """An outer point's value plus the least inner one, the inner paying its distance."""
    p = potentials.Evader(_circle(), 1, _STAGES)
    return potentials.distinct(bindings.nodes(spark, sf_dir).select("id", "wf"), p.arrow()).select("id", F.col("phi.value").alias("phi"))


@query(_NESTED)
def evader_potential_full(spark, sf_dir):
    """The same with all 64 points named as its support."""
    p = potentials.Evader(_circle(), 1, _STAGES, support=list(range(POINTS)))
    return potentials.distinct(bindings.nodes(spark, sf_dir).select("id", "wf"), p.arrow()).select("id", F.col("phi.value").alias("phi"))


@query(f"WITH {NODES_SQL} SELECT id, CAST(0 AS BIGINT) AS phi FROM nodes")
def potential_zero(spark, sf_dir):
    return bindings.nodes(spark, sf_dir).select("id", potentials.SIMPLE["zero"](F.col("wf")).alias("phi"))


@query(f"WITH {NODES_SQL} SELECT id, CAST(list_sum(wf) AS BIGINT) AS phi FROM nodes")
def potential_sum(spark, sf_dir):
    return bindings.nodes(spark, sf_dir).select("id", potentials.SIMPLE["sum"](F.col("wf")).alias("phi"))


@query(f"WITH {NODES_SQL} SELECT id, list_min(raw) AS phi FROM nodes")
def potential_min(spark, sf_dir):
    return bindings.nodes(spark, sf_dir).select("id", potentials.SIMPLE["min"](F.col("raw")).alias("phi"))


@query(f"WITH {NODES_SQL}, t AS (SELECT DISTINCT wf, bellman FROM nodes WHERE label < 5) SELECT id, CAST(coalesce(t.bellman, 0) AS BIGINT) AS phi FROM nodes LEFT JOIN t USING (wf)")
def potential_lookup(spark, sf_dir):
    """From a table of known work functions; 0 for others."""
    n = bindings.nodes(spark, sf_dir).select("id", "wf", "label", "bellman")
    known = n.where("label < 5").select("wf", F.col("bellman").alias("phi")).distinct()
    return potentials.looked_up(n.select("id", "wf"), known).select("id", F.col("phi").cast("long").alias("phi"))


def _span(wf: np.ndarray):
    return float(wf.max() - wf.min()), {"at": int(wf.argmax())}


@query(f"WITH {NODES_SQL} SELECT id, CAST(list_max(wf) - list_min(wf) AS DOUBLE) AS phi, concat('{{\"at\": ', list_position(wf, list_max(wf)) - 1, '}}') AS info FROM nodes")
def potential_udf(spark, sf_dir):
    """A plain Python potential that returns a value and a note."""
    n = potentials.distinct(bindings.nodes(spark, sf_dir).select("id", "wf"), potentials.arrow(_span))
    return n.select("id", F.col("phi.value").alias("phi"), "phi.info")


@query(f"WITH {NODES_SQL}, s AS (SELECT id, list_transform(wf, lambda x: x // 64) AS w FROM nodes) SELECT id, CAST(list_sum(w) AS DOUBLE) AS phi FROM s")
def distinct_eval(spark, sf_dir):
    """Evaluated once for each distinct work function, then joined back."""
    n = bindings.nodes(spark, sf_dir).select("id", F.transform("wf", lambda x: F.floor(x / 64)).alias("wf"))
    return potentials.distinct(n, potentials.arrow(lambda v: float(v.sum()))).select("id", F.col("phi.value").alias("phi"))
