"""Candidate stages, credits and summaries, and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from slackline.catalog.registry import query
from slackline.catalog.potential import LATENT_SQL, pairs
from slackline.functions import arrays
from slackline.operators import ranking
from slackline.operators import search as ops
from slackline.plans import scratch
from slackline.plans import search as plan
from slackline.sources import bindings
from slackline.sources.bindings import CANDIDATES_SQL, EDGES_SQL, LINKS_SQL

_REWARD = """(CASE WHEN stage_a = 0 THEN 1.0::DOUBLE ELSE 0 END + CASE WHEN stage_b <= 5 THEN 2.0::DOUBLE ELSE 0 END
 + CASE WHEN stage_c IS NOT NULL THEN greatest(0.5::DOUBLE, 50.0::DOUBLE / stage_c) ELSE 0 END + CASE WHEN stage_d IS NOT NULL THEN greatest(1.0::DOUBLE, 200.0::DOUBLE / stage_d) ELSE 0 END)"""
_GEN = lambda i: f"g{i} AS (SELECT c.parent_id AS node, sum(g.reward) AS reward FROM g{i - 1} g JOIN candidates c ON c.candidate_id = g.node WHERE c.parent_id IS NOT NULL GROUP BY 1)"


@query(f"""WITH {CANDIDATES_SQL}, g0 AS (SELECT candidate_id AS node, {_REWARD} AS reward FROM candidates), {', '.join(map(_GEN, (1, 2, 3)))}
SELECT node AS candidate_id, round(sum(reward * w), 6) AS credit FROM (SELECT node, reward, 1.0::DOUBLE AS w FROM g0 UNION ALL SELECT node, reward, 0.5 FROM g1 UNION ALL SELECT node, reward, 0.25 FROM g2 UNION ALL SELECT node, reward, 0.125 FROM g3) GROUP BY 1""")
def lineage_credit(spark, sf_dir):
    return ops.lineage_credit(bindings.candidates(spark, sf_dir)).select("candidate_id", F.round("credit", 6).alias("credit"))


@query(f"WITH {CANDIDATES_SQL} SELECT array_to_string(coefs, ',') AS coefs, min(candidate_id) AS candidate_id FROM candidates GROUP BY ALL")
def dedup_candidates(spark, sf_dir):
    return ops.deduplicated(bindings.candidates(spark, sf_dir)).select(arrays.joined(F.col("coefs")).alias("coefs"), "candidate_id")


@query(f"WITH {CANDIDATES_SQL} SELECT candidate_id, len(list_filter(coefs, lambda c: c <> 0)) AS l0, CAST(list_sum(list_transform(coefs, lambda c: abs(c))) AS BIGINT) AS l1 FROM candidates")
def sparsity(spark, sf_dir):
    l0, l1 = arrays.norms(F.col("coefs"))
    return bindings.candidates(spark, sf_dir).select("candidate_id", l0.alias("l0"), l1.alias("l1"))


_WEIGHTS = f"{CANDIDATES_SQL}, weights AS (SELECT family, 1 + count(*) AS weight FROM candidates WHERE stage_b <= 5 GROUP BY 1)"


@query(f"""WITH {_WEIGHTS}, bounds AS (SELECT family, sum(weight) OVER (ORDER BY family) AS upto, sum(weight) OVER () AS total FROM weights)
SELECT event_id AS draw_id, (SELECT min(family) FROM bounds WHERE draw * total <= upto) AS family FROM (SELECT event_id, CAST({arrays.portable_hash_sql('event_id', 7)} AS DOUBLE) / {arrays.MODULUS} AS draw FROM events)""")
def weighted_choice(spark, sf_dir):
    """A family for every event, drawn by what each family has earned."""
    weights = bindings.candidates(spark, sf_dir).where("stage_b <= 5").groupBy("family").agg((1 + F.count("*")).alias("weight"))
    draws = bindings.read(spark, sf_dir, "events").select(F.col("event_id").alias("draw_id"), (arrays.portable_hash(F.col("event_id"), 7) / arrays.MODULUS).alias("draw"))
    return ops.weighted_choice(weights, draws)


_RECIPES = ", ".join(
    f"({i}, '{name}', {list(r.fill)}::BIGINT[], {r.least}, {r.most}, ["
    + ", ".join(f"{{'upto': {int(round(sum(c.share for c in r.changes[: j + 1]) * arrays.MODULUS))}, 'keep': {c.keep}, 'add': {list(c.add)}, 'bound': {c.bound}}}" for j, c in enumerate(r.changes))
    + "])"
    for i, (name, r) in enumerate(ops.RECIPES.items())
)
_H = lambda salt, i: f"({arrays.portable_hash_sql(f'candidate_id * {ops.PLACES} + {i}', salt)})"
_OF = lambda values, salt, i: f"{values}[{_H(salt, i)} * len({values}) // {arrays.MODULUS} + 1]"
_C = f"list_filter(changes, lambda c: {_H(4, 'i')} < c.upto)[1]"


@query(f"""WITH {CANDIDATES_SQL}, recipes AS (SELECT * FROM (VALUES {_RECIPES}) t(place, family, fill, least, most, changes)),
d AS (SELECT candidate_id, r.family, coefs, fill, changes, list_transform(list_sort(list_transform(range(1, 6), lambda i: [{_H(1, 'i')}, i]))[1:least + {_H(2, '0')} * (most - least + 1) // {arrays.MODULUS}], lambda x: x[2]) AS places FROM candidates c JOIN recipes r ON r.place = c.family),
s AS (SELECT *, list_transform(range(6), lambda i: CASE WHEN len(fill) > 0 THEN {_OF('fill', 3, 'i')} ELSE coefs[i + 1] END) AS start FROM d)
SELECT candidate_id AS draw_id, family, array_to_string(list_transform(range(6), lambda i: CASE WHEN i < 1 THEN 0 WHEN list_contains(places, i) THEN
  greatest(-{_C}.bound, least({_C}.bound, {_C}.keep * start[i + 1] + {_C}.add[{_H(5, 'i')} * len({_C}.add) // {arrays.MODULUS} + 1])) ELSE start[i + 1] END), ',') AS coefs FROM s""")
def mutations(spark, sf_dir):
    """A new vector from every candidate, by the recipe of its family; the first place stays 0."""
    names = F.array(*map(F.lit, ops.RECIPES))
    draws = bindings.candidates(spark, sf_dir).select(F.col("candidate_id").alias("draw_id"), F.element_at(names, (F.col("family") + 1).cast("int")).alias("family"), "coefs")
    return ops.mutated(draws, frozen=1).select("draw_id", "family", arrays.joined(F.col("coefs")).alias("coefs"))


_L0 = "len(list_filter(coefs, lambda c: c <> 0))"
_L1 = "list_sum(list_transform(coefs, lambda c: abs(c)))"
_POOLS = " UNION ALL ".join(
    f"(SELECT '{f}' AS family, list_sort(list(candidate_id)) AS pool FROM (SELECT candidate_id FROM candidates WHERE {w} ORDER BY {o}, {_L0}, {_L1}, coefs, candidate_id LIMIT {ops.POOLS[f][0]}))"
    for f, w, o in (
        ("mutate_full", "stage_d IS NOT NULL", "stage_d, stage_c, stage_b"),
        ("mutate_timed", "stage_c IS NOT NULL", "CASE WHEN stage_d IS NOT NULL THEN 0 ELSE 1 END, coalesce(stage_d, stage_c), CASE WHEN stage_d IS NOT NULL THEN stage_c ELSE stage_b END, CASE WHEN stage_d IS NOT NULL THEN stage_b ELSE 0 END"),
    )
)


@query(f"""WITH {CANDIDATES_SQL}, pools AS ({_POOLS}), draws AS (SELECT event_id AS draw_id, CASE event_id % 3 WHEN 0 THEN 'mutate_full' WHEN 1 THEN 'mutate_timed' ELSE 'seed_sparse' END AS family FROM events),
c AS (SELECT draw_id, d.family, pool[{arrays.portable_hash_sql('draw_id', 6)} * len(pool) // {arrays.MODULUS} + 1] AS parent_id FROM draws d LEFT JOIN pools p ON p.family = d.family AND len(pool) > 0)
SELECT draw_id, c.family, c.parent_id, coalesce(array_to_string(coefs, ','), '0,0,0,0,0,0') AS coefs FROM c LEFT JOIN candidates k ON k.candidate_id = c.parent_id""")
def parent_pools(spark, sf_dir):
    """A parent for every draw, out of the best of its family's stage; seeds begin with zeros."""
    family = F.when(F.col("event_id") % 3 == 0, "mutate_full").when(F.col("event_id") % 3 == 1, "mutate_timed").otherwise("seed_sparse")
    draws = bindings.read(spark, sf_dir, "events").select(F.col("event_id").alias("draw_id"), family.alias("family"))
    return ops.parents(bindings.candidates(spark, sf_dir), draws, 6).select("draw_id", "family", "parent_id", arrays.joined(F.col("coefs")).alias("coefs"))


# Stages score five vectors of coefficients on the edges, all from one penalty-free pass over the nodes.

_COEFS = {i: [i - 2] for i in range(5)}
_STAGE = f"""{EDGES_SQL}, {LATENT_SQL}, scores AS (SELECT id, c, min(wf[a + 1] + wf[opposite + 1] - (c - 2) * d) AS p FROM nodes, priced, range({len(_COEFS)}) t(c) GROUP BY ALL),
tried AS (SELECT su.c AS candidate_id, edge_id, d_min, e.u, sv.p - su.p + 2 * d_min - ext < 0 AS hit, {arrays.portable_hash_sql('edge_id', 42)} AS h FROM edges e JOIN scores su ON su.id = e.u JOIN scores sv ON sv.id = e.v AND sv.c = su.c)"""


def _tried(spark, sf_dir):
    """candidate_id, edge_id, d_min, from, hit: written, since stages read it more than once."""
    edges = bindings.edges(spark, sf_dir).select("edge_id", "from", "to", "d_min", (2 * F.col("d_min") - F.col("ext")).alias("weight"))
    return scratch.table(plan.hits(pairs(), bindings.nodes(spark, sf_dir).select("id", "wf"), edges, _COEFS).select("candidate_id", "edge_id", "d_min", "from", "hit"), "tried")


def _stage(where: str, most: int, cutoff: str = "count(*) FILTER (hit)") -> str:
    return f"WITH {_STAGE} SELECT candidate_id, count(*) AS edges, {cutoff} AS violations, count(*) FILTER (hit) <= {most} AS passed FROM tried WHERE {where} GROUP BY 1"


def _count(rows, most: int, cutoff: int | None = None):
    hits = F.count_if("hit")
    shown = hits if cutoff is None else F.least(hits, F.lit(cutoff + 1).cast("long"))
    return rows.groupBy("candidate_id").agg(F.count("*").alias("edges"), shown.alias("violations"), (hits <= most).alias("passed"))


@query(_stage("d_min = 0", 0))
def stage_a(spark, sf_dir):
    """The cheap first look: a candidate passes if none of the edges that don't move the optimum is violated."""
    return _count(_tried(spark, sf_dir).where("d_min = 0"), ops.MOST["stage_a"])


@query(_stage("edge_id IN (SELECT edge_id FROM tried WHERE candidate_id < 3 AND hit GROUP BY 1 ORDER BY count(*) DESC, edge_id LIMIT 1024)", 5, "least(count(*) FILTER (hit), 6)"))
def stage_b(spark, sf_dir):
    """An adaptive subset: the edges that most of the first three candidates violate. Counts stop past the limit."""
    tried = _tried(spark, sf_dir)
    hard = ranking.top(tried.where("candidate_id < 3 and hit").groupBy("edge_id").agg(F.count("*").alias("n")), 1024, F.desc("n"), F.col("edge_id"))
    return _count(tried.join(F.broadcast(hard.select("edge_id")), "edge_id", "left_semi"), ops.MOST["stage_b"], ops.MOST["stage_b"])  # 1024 rows


@query(f"WITH {_STAGE}, n AS (SELECT count(*) AS n FROM edges) SELECT candidate_id, round(count(*) FILTER (hit) / (CAST(count(*) AS DOUBLE) / max(n)), 6) AS estimate FROM tried, n WHERE h < {int(0.05 * arrays.MODULUS)} GROUP BY 1")
def stage_c(spark, sf_dir):
    """Violations in a sample of 5 %, over the share looked at."""
    tried = _tried(spark, sf_dir)
    total = bindings.links(spark, sf_dir).agg(F.count("*").alias("n"))  # one row
    sample = ranking.hash_sample(tried, "edge_id", 0.05).join(F.broadcast(total))
    return sample.groupBy("candidate_id").agg(F.round(ops.timed_estimate(F.count_if("hit"), F.count("*") / F.max("n")), 6).alias("estimate"))


@query(_stage("true", 5))
def stage_d(spark, sf_dir):
    """All edges."""
    return _count(_tried(spark, sf_dir), ops.MOST["stage_b"])


@query(f"WITH {_STAGE} SELECT candidate_id, label AS instance, count(*) FILTER (hit) AS violations FROM tried JOIN nodes ON id = u GROUP BY ALL")
def final_eval(spark, sf_dir):
    """Candidates by instances, which are the labels of edges' first nodes."""
    at = bindings.nodes(spark, sf_dir).select(F.col("id").alias("from"), F.col("label").alias("instance"))
    return _tried(spark, sf_dir).join(at, "from").groupBy("candidate_id", "instance").agg(F.count_if("hit").alias("violations"))


@query(f"""WITH {_STAGE}, history AS (SELECT candidate_id % 2 AS step, candidate_id, edge_id FROM tried WHERE hit),
best AS (SELECT candidate_id FROM history GROUP BY 1 ORDER BY count(*), candidate_id LIMIT 1), l AS (SELECT max(step) AS last FROM history), held AS (SELECT count(DISTINCT candidate_id) AS held FROM history, l WHERE step = last),
seen AS (SELECT edge_id, max(step) AS recent, count(*) AS frequent, count(*) FILTER (step = last) AS now FROM history, l GROUP BY 1)
SELECT pool, edge_id, CAST(score AS DOUBLE) AS score FROM (
 SELECT 'core' AS pool, edge_id, -({arrays.portable_hash_sql('edge_id', 9)}) AS score FROM edges UNION ALL SELECT DISTINCT 'frontier', edge_id, 1 FROM history WHERE candidate_id IN (FROM best)
 UNION ALL SELECT 'recent', edge_id, recent FROM seen UNION ALL SELECT 'frequent', edge_id, frequent FROM seen UNION ALL SELECT 'disagreement', edge_id, least(now, held - now) FROM seen, held)""")
def edge_buckets(spark, sf_dir):
    """Scores of violated edges by bucket, for the edge cache of a next round."""
    tried = _tried(spark, sf_dir)
    history = tried.where("hit").select((F.col("candidate_id") % 2).alias("step"), "candidate_id", "edge_id")
    return ops.edge_pools(history, tried.where("candidate_id = 0").select("edge_id"))


def _funnel_sql(group: str) -> str:
    return f"""WITH {CANDIDATES_SQL}, n AS (SELECT {group} count(*) AS total, count(*) FILTER (stage_a = 0) AS a, count(*) FILTER (stage_b <= 5) AS b, count(stage_c) AS c, count(stage_d) AS d, min(stage_d) AS best FROM candidates {'GROUP BY 1' if group else ''})
SELECT {group} total, a, b, c, d, best, CASE WHEN total = 0 THEN 0 ELSE round(CAST(a AS DOUBLE) / total, 9) END AS a_rate, CASE WHEN a = 0 THEN 0 ELSE round(CAST(b AS DOUBLE) / a, 9) END AS b_rate, CASE WHEN c = 0 THEN 0 ELSE round(CAST(d AS DOUBLE) / c, 9) END AS d_rate FROM n"""


def _funnel(groups, candidates):
    n = candidates.groupBy(*groups).agg(F.count("*").alias("total"), F.count_if(F.col("stage_a") == 0).alias("a"), F.count_if(F.col("stage_b") <= 5).alias("b"), F.count("stage_c").alias("c"), F.count("stage_d").alias("d"), F.min("stage_d").alias("best"))
    rates = {"a_rate": ("a", "total"), "b_rate": ("b", "a"), "d_rate": ("d", "c")}
    return n.withColumns({k: F.round(ops.rate(F.col(x), F.col(y)), 9) for k, (x, y) in rates.items()})


@query(_funnel_sql(""))
def funnel_summary(spark, sf_dir):
    return _funnel([], bindings.candidates(spark, sf_dir))


@query(_funnel_sql("family,"))
def family_summary(spark, sf_dir):
    return _funnel(["family"], bindings.candidates(spark, sf_dir))


_QUANTILES = {"p50": 0.5, "p90": 0.9, "p99": 0.99}
_OVER = lambda c: ", ".join(f"round(quantile_cont({c}, {p}), 4) AS {c}_{n}" for n, p in _QUANTILES.items())


@query(f"""WITH e AS (SELECT event_type AS stage, event_type <> 'error' AS done, value AS duration, epoch_us(ts) AS moment, CAST(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS DOUBLE) / 1000000 AS wait FROM events)
SELECT stage, count(*) AS submitted, count(*) FILTER (done) AS completed, round(avg(duration), 4) AS duration_mean, {_OVER('duration')}, {_OVER('wait')}, round(count(*) / (CAST(max(moment) - min(moment) AS DOUBLE) / 1000000), 9) AS throughput FROM e GROUP BY 1""")
def stage_stats(spark, sf_dir):
    """Counts, durations, waits and tasks a second by stage; an event's kind stands for the stage, its value for the time
    that it took, and the time since the user's event before for its wait."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = bindings.read(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), (F.col("event_type") != "error").alias("done"), F.col("value").alias("duration"), at.alias("at"), ((at - F.lag(at).over(order)) / 1e6).alias("wait"))
    e = scratch.table(e, "stage-events")
    whole = e.groupBy("stage").agg(F.count("*").alias("submitted"), F.count_if("done").alias("completed"), F.avg("duration").alias("duration_mean"), (F.count("*") / ((F.max("at") - F.min("at")) / 1e6)).alias("throughput"))
    got = whole.join(ranking.quantiles(e, ["stage"], ["duration", "wait"], _QUANTILES), "stage")
    rounded = [F.round(c, 4).alias(c) for c in got.columns if c.startswith(("duration", "wait"))]
    return got.select("stage", "submitted", "completed", *rounded, F.round("throughput", 9).alias("throughput"))


@query("SELECT o_custkey AS run, o_orderkey AS attempt, o_totalprice AS score FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def best_attempt(spark, sf_dir):
    best = F.max(F.struct("o_totalprice", (-F.col("o_orderkey")).alias("back"))).alias("b")
    return bindings.read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("run")).agg(best).select("run", (-F.col("b.back")).alias("attempt"), F.col("b.o_totalprice").alias("score"))


@query(f"WITH {LINKS_SQL} SELECT u AS id FROM links UNION SELECT v FROM links")
def set_union_endpoints(spark, sf_dir):
    e = bindings.links(spark, sf_dir)
    return e.select(F.col("from").alias("id")).union(e.select(F.col("to").alias("id"))).distinct()


@query(f"WITH {LINKS_SQL} SELECT u, v FROM (SELECT u, v FROM links EXCEPT ALL SELECT DISTINCT u, v FROM links)")
def bag_diff_edges(spark, sf_dir):
    """Edges beyond their first occurrence: a difference of bags."""
    e = bindings.links(spark, sf_dir).select(F.col("from").alias("u"), F.col("to").alias("v"))
    return e.exceptAll(e.distinct())


@query(f"WITH {LINKS_SQL} SELECT vec_id AS id FROM embeddings EXCEPT SELECT u FROM links WHERE request < 2")
def set_diff_nodes(spark, sf_dir):
    left = bindings.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    return left.subtract(bindings.links(spark, sf_dir).where(F.col("request") < 2).select("from"))


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1")
def dedup_first(spark, sf_dir):
    """The first of each kind: a window where the whole row is wanted."""
    order = Window.partitionBy("user_id", "event_type").orderBy("event_id")
    return bindings.read(spark, sf_dir, "events").withColumn("n", F.row_number().over(order)).where("n = 1").select("user_id", "event_id")
