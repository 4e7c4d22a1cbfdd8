"""Ranks, limits, samples and percentiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from slackline.catalog.registry import query
from slackline.functions import arrays
from slackline.operators import evaluate
from slackline.operators import ranking as ops
from slackline.sources import bindings
from slackline.sources.bindings import CANDIDATES_SQL, EDGES_SQL, NODES_SQL

_RHO = 5
_SLACK = f"(v_phi - u_phi + {_RHO + 1} * d_min - ext)"


@query(f"WITH {NODES_SQL} SELECT id, wf[list_position(raw, low)] AS value, CAST(list_position(raw, low) - 1 AS BIGINT) AS idx FROM nodes")
def first_argmin(spark, sf_dir):
    return bindings.nodes(spark, sf_dir).withColumn("b", ops.first_least(F.col("wf"))).select("id", "b.value", "b.idx")


@query("SELECT event_id, rank() OVER (ORDER BY value) + CAST(count(*) OVER (PARTITION BY value) - 1 AS DOUBLE) / 2 AS value_rank FROM events")
def avg_rank(spark, sf_dir):
    return evaluate.average_ranks(bindings.read(spark, sf_dir, "events").select("event_id", "value"), "value", "value_rank").select("event_id", "value_rank")


_NORMS = "len(list_filter(coefs, lambda c: c <> 0)) AS l0, CAST(list_sum(list_transform(coefs, lambda c: abs(c))) AS BIGINT) AS l1"
_TIER = "CASE WHEN stage_d IS NOT NULL THEN 0 WHEN stage_c IS NOT NULL THEN 1 WHEN stage_b IS NOT NULL THEN 2 ELSE 3 END"
_KEYED = f"""{CANDIDATES_SQL}, keyed AS (SELECT *, {_NORMS}, {_TIER} AS tier, coalesce(stage_d, stage_c, stage_b, stage_a, 1000000000) AS lead,
 CASE {_TIER} WHEN 0 THEN coalesce(stage_c, 9223372036854775807) WHEN 1 THEN coalesce(stage_b, 1000000000) ELSE 0 END AS second,
 CASE WHEN {_TIER} = 0 THEN coalesce(stage_b, 1000000000) ELSE 0 END AS third FROM candidates)"""
_ORDER = "tier, lead, second, third, l0, l1, coefs, candidate_id"


@query(f"WITH {_KEYED} SELECT candidate_id, row_number() OVER (ORDER BY {_ORDER}) - 1 AS place FROM keyed")
def rank_candidates(spark, sf_dir):
    """Every candidate's place in the composite order, numbered by ranges."""
    from slackline.plans.numbering import numbered

    names = [f"k{i}" for i in range(8)]
    keyed = bindings.candidates(spark, sf_dir).select(*(k.alias(n) for k, n in zip(ops.rank_key(), names)))
    return numbered(keyed, names, "place").select(F.col("k7").alias("candidate_id"), "place")


@query(f"WITH {_KEYED} SELECT candidate_id, lead FROM keyed WHERE stage_b IS NOT NULL ORDER BY {_ORDER} LIMIT 30")
def top_records(spark, sf_dir):
    found = ops.top(bindings.candidates(spark, sf_dir).where("stage_b is not null"), 30, *ops.rank_key())
    return found.select("candidate_id", F.coalesce("stage_d", "stage_c", "stage_b", "stage_a").alias("lead"))


@query("WITH p AS (SELECT user_id AS edge_id, count(*) AS score FROM events GROUP BY 1) SELECT edge_id, score FROM p WHERE edge_id NOT IN (SELECT user_id FROM events WHERE value > 300) ORDER BY score DESC, edge_id LIMIT 50")
def top_edges(spark, sf_dir):
    """The best keys that were not chosen before."""
    e = bindings.read(spark, sf_dir, "events")
    scores = e.groupBy(F.col("user_id").alias("edge_id")).agg(F.count("*").alias("score"))
    chosen = e.where("value > 300").select(F.col("user_id").alias("edge_id"))
    return ops.top(scores.join(chosen, "edge_id", "left_anti"), 50, F.desc("score"), F.col("edge_id"))


_POOLS = "pools AS (SELECT CASE event_type WHEN 'click' THEN 'core' WHEN 'view' THEN 'recent' WHEN 'purchase' THEN 'frequent' WHEN 'signup' THEN 'disagreement' ELSE 'frontier' END AS pool, event_id // 3 AS edge_id, max(CAST(round(value * 100) AS BIGINT)) AS score FROM events GROUP BY ALL)"


def _pick(pool: str, place: int, budget: int, before: list[str]) -> str:
    left = " AND ".join(["pool = '" + pool + "'", *(f"edge_id NOT IN (SELECT edge_id FROM p_{b})" for b in before)])
    return f"p_{pool} AS (SELECT {place} AS place, pool, edge_id, score FROM pools WHERE {left} ORDER BY score DESC, edge_id LIMIT {budget})"


@query(f"WITH {_POOLS}, {', '.join(_pick(p, i, b, [q for q, _ in ops.BUDGETS[:i]]) for i, (p, b) in enumerate(ops.BUDGETS))} SELECT pool, edge_id, score FROM ({' UNION ALL '.join(f'FROM p_{p}' for p, _ in ops.BUDGETS)}) ORDER BY place, score DESC, edge_id LIMIT {ops.CAP}")
def edge_cache(spark, sf_dir):
    names = F.create_map(*(F.lit(x) for pair in (("click", "core"), ("view", "recent"), ("purchase", "frequent"), ("signup", "disagreement"), ("error", "frontier")) for x in pair))
    e = bindings.read(spark, sf_dir, "events").select(names[F.col("event_type")].alias("pool"), F.floor(F.col("event_id") / 3).alias("edge_id"), F.round(F.col("value") * 100).cast("long").alias("score"))
    return ops.edge_cache(e.groupBy("pool", "edge_id").agg(F.max("score").alias("score")))


@query(f"SELECT event_id, row_number() OVER (ORDER BY {arrays.portable_hash_sql('event_id', 42)}, event_id) - 1 AS place FROM events")
def hash_order(spark, sf_dir):
    """A fixed shuffle of all rows, from a hash that engines share."""
    from slackline.plans.numbering import numbered

    e = bindings.read(spark, sf_dir, "events").select("event_id", arrays.portable_hash(F.col("event_id"), 42).alias("h"))
    return numbered(e, ["h", "event_id"], "place").select("event_id", "place")


@query(f"WITH {bindings.LINKS_SQL} SELECT edge_id FROM links WHERE {arrays.portable_hash_sql('edge_id', 42)} < {int(0.05 * arrays.MODULUS)}")
def edge_sample(spark, sf_dir):
    return ops.hash_sample(bindings.links(spark, sf_dir).select("edge_id"), "edge_id", 0.05)


@query(f"""WITH {EDGES_SQL}, r AS (SELECT coalesce({_SLACK} < 0, false) AS hit, sum(CAST(coalesce({_SLACK} < 0, false) AS BIGINT)) OVER (ORDER BY edge_id) AS hits FROM edges)
SELECT count(*) AS processed, CAST(coalesce(max(hits), 0) AS BIGINT) AS violations FROM r WHERE hits < 201 OR (hits = 201 AND hit)""")
def cutoff_scan(spark, sf_dir):
    """What a scan in order of edges sees that stops at the violation after 200 others."""
    e = bindings.edges(spark, sf_dir).select("edge_id", F.coalesce(evaluate.slack(_RHO) < 0, F.lit(False)).alias("hit"))
    return ops.cut_off(e, ["edge_id"], F.col("hit"), 200)


@query(f"WITH {EDGES_SQL} SELECT edge_id, {_SLACK} AS slack FROM edges WHERE {_SLACK} < 0 ORDER BY edge_id LIMIT 100")
def violated_edges(spark, sf_dir):
    """The first violated edges."""
    e = bindings.edges(spark, sf_dir).select("edge_id", evaluate.slack(_RHO).alias("slack"))
    return ops.top(e.where("slack < 0"), 100, F.col("edge_id"))


@query(f"WITH {_KEYED} SELECT candidate_id FROM keyed WHERE stage_b IS NOT NULL QUALIFY row_number() OVER (ORDER BY {_ORDER}) > 256")
def bounded_queue(spark, sf_dir):
    """What a queue of 256 places evicts: all but the best."""
    waiting = bindings.candidates(spark, sf_dir).where("stage_b is not null")
    kept = ops.top(waiting, 256, *ops.rank_key()).select("candidate_id")
    return waiting.select("candidate_id").join(F.broadcast(kept), "candidate_id", "left_anti")  # 256 rows


@query("SELECT event_type, round(quantile_cont(value, 0.05), 6) AS p5, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def percentiles(spark, sf_dir):
    """By selection: no group's values are gathered."""
    got = ops.quantiles(bindings.read(spark, sf_dir, "events"), ["event_type"], ["value"], {"p5": 0.05, "p50": 0.5, "p95": 0.95})
    return got.select("event_type", *(F.round(f"value_{c}", 6).alias(c) for c in ("p5", "p50", "p95")))


@query("SELECT event_type, count(*) FILTER (value <= 1) AS le_1, count(*) FILTER (value <= 10) AS le_10, count(*) FILTER (value <= 100) AS le_100, count(*) FILTER (value > 100) AS gt_max FROM events GROUP BY 1")
def threshold_counts(spark, sf_dir):
    return bindings.read(spark, sf_dir, "events").groupBy("event_type").agg(*ops.threshold_counts("value", [1, 10, 100]))


@query("""WITH e AS (SELECT user_id, CAST(round(value * 100) AS DOUBLE) AS x, CAST(event_id % 97 AS DOUBLE) AS y FROM events),
s AS (SELECT user_id, count(*) * sum(x * x) - sum(x) * sum(x) AS sxx, count(*) * sum(y * y) - sum(y) * sum(y) AS syy, count(*) * sum(x * y) - sum(x) * sum(y) AS sxy, count(*) AS n FROM e GROUP BY 1)
SELECT user_id, round(CASE WHEN n > 1 AND sxx > 0 AND syy > 0 THEN sxy / (sqrt(sxx) * sqrt(syy)) END, 6) AS corr FROM s""")
def pearson_guarded(spark, sf_dir):
    """Null under two rows or for a constant side."""
    e = bindings.read(spark, sf_dir, "events").select("user_id", F.round(F.col("value") * 100).alias("x"), (F.col("event_id") % 97).alias("y"))
    return e.groupBy("user_id").agg(F.round(evaluate.pearson(F.col("x"), F.col("y")), 6).alias("corr"))


@query(f"WITH {NODES_SQL} SELECT id, label FROM nodes WHERE id BETWEEN (SELECT max(id) FROM nodes) - 9 AND (SELECT max(id) FROM nodes)")
def row_slice(spark, sf_dir):
    """The last ten rows by id: a negative slice."""
    n = bindings.nodes(spark, sf_dir).select("id", "label")
    return ops.top(n, 10, F.desc("id"))
