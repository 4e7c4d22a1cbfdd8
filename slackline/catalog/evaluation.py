"""Joins of edges and nodes, and the report's aggregates, on embeddings and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from slackline.catalog.registry import query
from slackline.functions import arrays
from slackline.operators import evaluate
from slackline.sources import bindings
from slackline.sources.bindings import EDGES_SQL, NODES_SQL, POINTS, pair_potential

#: One server on a circle.
SERVERS, RHO = 1, 5

_SLACK = f"(v_phi - u_phi + {RHO + 1} * d_min - ext)"
_DONE = "u_phi IS NOT NULL AND v_phi IS NOT NULL"
_RENORM = f"""{EDGES_SQL}, renorm AS (SELECT *, CASE WHEN v_phi IS NOT NULL THEN list_min(list_transform(range({POINTS}), lambda a: v_wf[a + 1] + d_min + v_wf[(a + {POINTS // 2}) % {POINTS} + 1] + d_min)) END AS v_renorm_phi FROM edges)"""


def _score(hit: str, among: str, name: str, digits: int | None = None) -> str:
    if digits is not None:
        return f"count(*) FILTER ({among} AND {hit}) AS {name}, round_even(1 - CAST(count(*) FILTER ({among} AND {hit}) AS DOUBLE) / nullif(count(*) FILTER ({among}), 0), {digits}) AS {name}_score"
    return f"count(*) FILTER ({among} AND {hit}) AS {name}, 1 - CAST(count(*) FILTER ({among} AND {hit}) AS DOUBLE) / nullif(count(*) FILTER ({among}), 0) AS {name}_score"


def _renormalized(spark, sf_dir):
    """Unevaluated nodes stay so when shifted."""
    e = bindings.edges(spark, sf_dir)
    return evaluate.renormalized(e, pair_potential).withColumn("v_renorm_phi", F.when(F.col("v_phi").isNotNull(), F.col("v_renorm_phi")))


@query(f"WITH {EDGES_SQL} SELECT edge_id, u_phi, v_phi, u_bellman, v_bellman FROM edges")
def join_edge_nodes(spark, sf_dir):
    return bindings.edges(spark, sf_dir).select("edge_id", "u_phi", "v_phi", "u_bellman", "v_bellman")


@query(f"WITH {_RENORM} SELECT edge_id, v_renorm_phi FROM renorm")
def join_renorm(spark, sf_dir):
    return _renormalized(spark, sf_dir).select("edge_id", "v_renorm_phi")


@query("WITH done AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND value > 100) SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM done)")
def join_frontier_anti(spark, sf_dir):
    """New keys that are in no visited set."""
    e = bindings.read(spark, sf_dir, "events").select("user_id", "event_type", "value")
    return e.select("user_id").distinct().join(e.where("event_type = 'error' and value > 100").select("user_id"), "user_id", "left_anti")


@query(f"WITH {EDGES_SQL}, short AS (SELECT u, v FROM edges WHERE {_SLACK} < 0) SELECT id, bellman FROM nodes WHERE id IN (SELECT u FROM short UNION SELECT v FROM short)")
def join_endpoint_semi(spark, sf_dir):
    """Nodes at an end of a violated edge."""
    short = bindings.edges(spark, sf_dir).where(evaluate.slack(RHO) < 0)
    ends = short.select(F.col("from").alias("id")).union(short.select(F.col("to").alias("id")))
    return bindings.nodes(spark, sf_dir).select("id", "bellman").join(ends, "id", "left_semi")


_SAMPLE = f"sample AS (SELECT id FROM nodes WHERE phi IS NOT NULL ORDER BY {arrays.portable_hash_sql('id')}, id LIMIT 100)"


@query(f"WITH {NODES_SQL}, {bindings.LINKS_SQL}, {_SAMPLE} SELECT edge_id FROM links WHERE u IN (FROM sample) OR v IN (FROM sample)")
def join_touching_sample(spark, sf_dir):
    """Edges that touch a sampled node: two semi joins, not a join on an alternative."""
    sample = bindings.nodes(spark, sf_dir).where("phi is not null").select("id").orderBy(arrays.portable_hash(F.col("id")), "id").limit(100)
    edges = bindings.links(spark, sf_dir).select("edge_id", "from", "to")
    at = lambda c: edges.join(sample.withColumnRenamed("id", c), c, "left_semi").select("edge_id")
    return at("from").union(at("to")).distinct()


@query(f"WITH {EDGES_SQL} SELECT {_score(f'{_SLACK} < 0', _DONE, 'violations_k')} FROM edges")
def violations_k(spark, sf_dir):
    return bindings.edges(spark, sf_dir).agg(*evaluate.violations(RHO))


@query(f"WITH {EDGES_SQL} SELECT {_score('v_phi - u_phi - ext < 0', f'{_DONE} AND d_min = 0', 'violations_dmin_0')} FROM edges")
def violations_dmin0(spark, sf_dir):
    return bindings.edges(spark, sf_dir).agg(*evaluate.violations_dmin_0())


@query(f"WITH {EDGES_SQL} SELECT {_score('v_phi = u_phi', f'{_DONE} AND d_min = 0 AND ext > 0', 'undetected_dmin_0')} FROM edges")
def undetected_dmin0(spark, sf_dir):
    return bindings.edges(spark, sf_dir).agg(*evaluate.undetected_dmin_0())


@query(f"WITH {_RENORM} SELECT {_score('v_renorm_phi - u_phi - ext < 0', 'u_phi IS NOT NULL AND v_renorm_phi IS NOT NULL', 'violations_renorm')} FROM renorm")
def violations_renorm(spark, sf_dir):
    return _renormalized(spark, sf_dir).agg(*evaluate.violations_renorm())


@query(f"WITH {EDGES_SQL}, r AS (SELECT max(CAST(ext - (v_phi - u_phi) AS DOUBLE) / d_min) FILTER (d_min <> 0) AS rho FROM edges) SELECT rho AS strong_hypothesis_rho, ({POINTS} - rho) / {POINTS - SERVERS - 1} AS strong_hypothesis_rho_score FROM r")
def strong_rho(spark, sf_dir):
    return bindings.edges(spark, sf_dir).agg(*evaluate.strong_rho(SERVERS, POINTS))


@query(f"""WITH {NODES_SQL}, {_SAMPLE}, moved AS (SELECT id, t, list_min(list_transform(range({POINTS}), lambda a: wf[a + 1] + t + wf[(a + 32) % 64 + 1] + t)) AS p FROM nodes JOIN sample USING (id), (SELECT unnest([0, 1, 2, 3, 10000]) AS t)),
 b AS (SELECT max(CAST(y.p - x.p AS DOUBLE) / (y.t - x.t)) AS bound FROM moved x JOIN moved y ON x.id = y.id AND x.t < y.t) SELECT bound AS opt_upper_bound, ({POINTS} - bound) / {POINTS - SERVERS - 1} AS opt_upper_bound_score FROM b""")
def opt_upper_bound(spark, sf_dir):
    return evaluate.opt_upper_bound(bindings.nodes(spark, sf_dir), pair_potential, k=SERVERS, size=POINTS)


def _corr(x: str, y: str) -> str:
    sxx, syy = f"(count(*) * sum({x} * {x}) - sum({x}) * sum({x}))", f"(count(*) * sum({y} * {y}) - sum({y}) * sum({y}))"
    return f"CASE WHEN count(*) > 1 AND {sxx} > 0 AND {syy} > 0 THEN (count(*) * sum({x} * {y}) - sum({x}) * sum({y})) / (sqrt({sxx}) * sqrt({syy})) END"


@query(f"""WITH {EDGES_SQL}, d AS (SELECT CAST(v_bellman - u_bellman AS DOUBLE) AS t, CAST(v_phi - u_phi AS DOUBLE) AS p FROM edges WHERE {_DONE})
SELECT round({_corr('t', 'p')}, 6) AS corr, round(avg((t - p) * (t - p)), 6) AS mse, round(1 - sum((t - p) * (t - p)) / (sum(t * t) - sum(t) * sum(t) / count(*)), 6) AS r2 FROM d""")
def bellman_edge_stats(spark, sf_dir):
    got = bindings.edges(spark, sf_dir).agg(*evaluate.bellman_edges())
    return got.select(F.round("bellman_edge_corr", 6).alias("corr"), F.round("bellman_edge_mse", 6).alias("mse"), F.round("bellman_edge_r2", 6).alias("r2"))


def _rank_sql(where: str) -> str:
    return f"""r AS (SELECT CAST(bellman AS DOUBLE) AS b, CAST(phi AS DOUBLE) AS p, rank() OVER (ORDER BY bellman) + (count(*) OVER (PARTITION BY bellman) - 1) / 2 AS rb,
  rank() OVER (ORDER BY phi) + (count(*) OVER (PARTITION BY phi) - 1) / 2 AS rp FROM nodes WHERE phi IS NOT NULL{where})
SELECT round({_corr('b', 'p')}, 6) AS corr, round(greatest({_corr('rb', 'rp')}, 0), 6) AS spearman FROM r"""


def _node_stats(nodes):
    got = evaluate.bellman_nodes(nodes)
    return got.select(F.round("bellman_node_corr", 6).alias("corr"), F.round("bellman_node_spearman", 6).alias("spearman"))


@query(f"WITH {NODES_SQL}, {_rank_sql('')}")
def bellman_node_stats(spark, sf_dir):
    return _node_stats(bindings.nodes(spark, sf_dir))


@query(f"WITH {NODES_SQL}, {_rank_sql(' AND label > 0')}")
def bellman_noninitial_stats(spark, sf_dir):
    """Without initial nodes; label 0 stands for depth 0."""
    return _node_stats(bindings.nodes(spark, sf_dir).where("label > 0"))


@query(f"WITH {EDGES_SQL}, s AS (SELECT greatest(-{_SLACK}, 0) AS short FROM edges WHERE {_DONE}) SELECT CAST(sum(short) AS DOUBLE) AS violations_k_l1, round(sqrt(sum(CAST(short AS DOUBLE) * short)), 6) AS violations_k_l2, CAST(max(short) AS DOUBLE) AS violations_k_linf FROM s")
def violation_norms(spark, sf_dir):
    return bindings.edges(spark, sf_dir).where(evaluate.processed()).agg(*evaluate.violation_norms(RHO)).withColumn("violations_k_l2", F.round("violations_k_l2", 6))


_COVERAGE = f"""count(*) AS total_edges, count(*) FILTER (NOT ({_DONE})) AS unprocessed_normalized_edges, CAST(count(*) FILTER ({_DONE}) AS DOUBLE) / count(*) AS processed_normalized_edges_score,
 count(*) FILTER (NOT (u_phi IS NOT NULL AND v_renorm_phi IS NOT NULL)) AS unprocessed_renormalized_edges, CAST(count(*) FILTER (u_phi IS NOT NULL AND v_renorm_phi IS NOT NULL) AS DOUBLE) / count(*) AS processed_renormalized_edges_score"""


@query(f"WITH {_RENORM} SELECT {_COVERAGE} FROM renorm")
def coverage(spark, sf_dir):
    return _renormalized(spark, sf_dir).agg(*evaluate.coverage())


@query(f"""WITH {EDGES_SQL}, p AS (SELECT edge_id // 4096 AS block, sha256(string_agg(CAST(v_phi - u_phi AS VARCHAR), ',' ORDER BY edge_id)) AS t FROM edges WHERE {_DONE} GROUP BY 1)
SELECT sha256(string_agg(t, ',' ORDER BY block)) AS unique_key FROM p""")
def delta_fingerprint(spark, sf_dir):
    return evaluate.fingerprint(bindings.edges(spark, sf_dir))


@query(f"""WITH {_RENORM}, whole AS (SELECT {_COVERAGE} FROM renorm) SELECT {_score(f'{_SLACK} < 0', _DONE, 'violations_k')}, {_score('v_phi - u_phi - ext < 0', f'{_DONE} AND d_min = 0', 'violations_dmin_0', 4)},
{_score('v_renorm_phi - u_phi - ext < 0', 'u_phi IS NOT NULL AND v_renorm_phi IS NOT NULL', 'violations_renorm', 4)}, max(total_edges) AS total_edges, max(unprocessed_normalized_edges) AS unprocessed_normalized_edges,
round_even(max(processed_normalized_edges_score), 4) AS processed_normalized_edges_score, max(unprocessed_renormalized_edges) AS unprocessed_renormalized_edges, round_even(max(processed_renormalized_edges_score), 4) AS processed_renormalized_edges_score FROM renorm, whole""")
def report(spark, sf_dir):
    """Several metrics in one aggregation over one pass, rounded to four digits but for the first score."""
    got = evaluate.report(_renormalized(spark, sf_dir), SERVERS, POINTS, RHO, digits=4)
    return got.select("violations_k", "violations_k_score", "violations_dmin_0", "violations_dmin_0_score", "violations_renorm", "violations_renorm_score", "total_edges", "unprocessed_normalized_edges", "processed_normalized_edges_score", "unprocessed_renormalized_edges", "processed_renormalized_edges_score")


_PERM = f"perm AS (SELECT list(i ORDER BY {arrays.portable_hash_sql('i', 42)}, i) AS p FROM range({POINTS}) t(i))"


@query(f"""WITH {EDGES_SQL}, {_PERM}, moved AS (SELECT id, list_transform(p, lambda i: 2 * wf[i + 1] + 1) AS w, p FROM nodes, perm),
valued AS (SELECT id, list_min(list_transform(range({POINTS}), lambda a: w[list_position(p, a)] + w[list_position(p, (a + 32) % 64)])) AS pair, w[1] AS first FROM moved),
b AS (SELECT nv.pair - nu.pair + {2 * (RHO + 1)} * d_min - 2 * ext AS pair, nv.first - nu.first + {2 * (RHO + 1)} * d_min - 2 * ext AS first FROM edges JOIN valued nu ON nu.id = u JOIN valued nv ON nv.id = v)
SELECT 'pair' AS potential, count(*) FILTER (pair < 0) AS violations, count(*) FILTER (pair < 0) = 0 AS robust FROM b UNION ALL SELECT 'first', count(*) FILTER (first < 0), count(*) FILTER (first < 0) = 0 FROM b""")
def robustness(spark, sf_dir):
    """Violations under a doubled metric and a shuffled order of configurations, of a potential that knows the order
    and of one that only looks at a position. The permutation is data: positions in order of a portable hash."""
    n, e = bindings.nodes(spark, sf_dir), bindings.edges(spark, sf_dir)
    order = [r["id"] for r in spark.range(POINTS).orderBy(arrays.portable_hash(F.col("id"), 42), "id").collect()]  # POINTS numbers
    perm = F.array(*(F.lit(i) for i in order))
    where = {p: at for at, p in enumerate(order)}
    pair = lambda w: arrays.let(w, lambda v: F.array_min(F.array(*(v[where[a]] + v[where[(a + POINTS // 2) % POINTS]] for a in range(POINTS)))))
    got = [evaluate.robustness(e, n, f, perm, RHO).select(F.lit(name).alias("potential"), "violations", "robust") for name, f in (("pair", pair), ("first", lambda w: w[0]))]
    return got[0].union(got[1])


@query(f"WITH {NODES_SQL} SELECT id, label, bellman, phi, array_to_string(wf, ',') AS wf FROM nodes")
def node_eval(spark, sf_dir):
    return bindings.nodes(spark, sf_dir).select("id", "label", "bellman", "phi", arrays.joined(F.col("wf")).alias("wf"))


@query(f"WITH {_RENORM} SELECT edge_id, u, v, d_min, ext, u_phi, v_phi, v_renorm_phi, {_SLACK} AS slack FROM renorm")
def edge_eval(spark, sf_dir):
    e = _renormalized(spark, sf_dir)
    return e.select("edge_id", F.col("from").alias("u"), F.col("to").alias("v"), "d_min", "ext", "u_phi", "v_phi", "v_renorm_phi", evaluate.slack(RHO).alias("slack"))


# Several instances: edges fall into one for each label of their first node.

_BY = f"{EDGES_SQL}, inst AS (SELECT n.label AS instance, {_score(f'{_SLACK} < 0', _DONE, 'violations')}, CAST(count(*) FILTER ({_DONE}) AS DOUBLE) / count(*) AS processed FROM edges JOIN nodes n ON n.id = u GROUP BY 1)"


def _by_instance(spark, sf_dir):
    e = bindings.edges(spark, sf_dir).join(bindings.nodes(spark, sf_dir).select(F.col("id").alias("from"), F.col("label").alias("instance")), "from")
    v, score = evaluate.violations(RHO)
    done = evaluate.coverage(False)[2]
    return e.groupBy("instance").agg(v.alias("violations"), score.alias("violations_score"), done.alias("processed"))


@query(f"WITH {_BY} SELECT round(product(coalesce(violations_score, 1) * processed), 9) AS combined, CASE WHEN bool_or(violations > 900) THEN 0 ELSE round(product(coalesce(violations_score, 1) * processed), 9) END AS combined_if_robust FROM inst WHERE processed > 0")
def combined_score(spark, sf_dir):
    """The product of violation and coverage scores; nothing if an instance fails the robustness rule."""
    value = F.round(F.product(F.coalesce("violations_score", F.lit(1.0)) * F.col("processed")), 9)
    return _by_instance(spark, sf_dir).where("processed > 0").agg(value.alias("combined"), F.when(F.bool_or(F.col("violations") > 900), F.lit(0.0)).otherwise(value).alias("combined_if_robust"))


@query(f"WITH {_BY} SELECT concat(instance, '/', metric) AS metric, round(value, 9) AS value, CASE WHEN metric LIKE '%_time' THEN 'private' ELSE 'public' END AS visibility FROM (SELECT instance, CAST(violations AS DOUBLE) AS violations, violations_score, processed, 0.0::DOUBLE AS cache_time FROM inst) UNPIVOT INCLUDE NULLS (value FOR metric IN (violations, violations_score, processed, cache_time))")
def report_long(spark, sf_dir):
    """A row for each instance and metric; timings are private."""
    wide = _by_instance(spark, sf_dir).select("instance", F.col("violations").cast("double").alias("violations"), "violations_score", "processed", F.lit(0.0).alias("cache_time"))
    long = wide.unpivot("instance", ["violations", "violations_score", "processed", "cache_time"], "m", "v")
    return long.select(F.concat_ws("/", "instance", "m").alias("metric"), F.round("v", 9).alias("value"), F.when(F.col("m").endswith("_time"), "private").otherwise("public").alias("visibility"))


@query("SELECT event_id, strlen(props) AS bytes, strlen(props) <= 8 AS allowed, CASE WHEN strlen(props) <= 8 THEN value ELSE 0 END AS score FROM events")
def kwargs_cap(spark, sf_dir):
    """Parameters over a size in bytes score nothing."""
    size = F.octet_length("props").cast("long")
    return bindings.read(spark, sf_dir, "events").select("event_id", size.alias("bytes"), (size <= 8).alias("allowed"), F.when(size <= 8, F.col("value")).otherwise(0.0).alias("score"))


@query("SELECT event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) = 1")
def best_candidate(spark, sf_dir):
    """The best result of each kind; of equal ones the first. A partial aggregate, not a window."""
    best = F.max(F.struct("value", (-F.col("event_id")).alias("back")))
    return bindings.read(spark, sf_dir, "events").groupBy("event_type").agg(best.alias("b")).select("event_type", (-F.col("b.back")).alias("event_id"), "b.value")


@query("SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY 1")
def exec_time_stats(spark, sf_dir):
    return bindings.read(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std"))


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 20")
def top_attempts(spark, sf_dir):
    return bindings.read(spark, sf_dir, "events").select("event_id", "value").orderBy(F.desc("value"), "event_id").limit(20)


@query("""SELECT event_id, CAST(json_object('id', event_id, 'kind', event_type, 'user', user_id) AS VARCHAR) AS packed, CAST(json_extract(props, '$.k') AS BIGINT) AS k, strlen(json_object('id', event_id, 'kind', event_type, 'user', user_id)) AS bytes FROM events""")
def json_pack(spark, sf_dir):
    """A record as JSON with sorted names, its size in bytes, and a value read out of other JSON."""
    packed = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.col("user_id").alias("user")))
    e = bindings.read(spark, sf_dir, "events").select("event_id", packed.alias("packed"), F.from_json("props", "k long")["k"].alias("k"))
    return e.withColumn("bytes", F.octet_length("packed").cast("long"))


_FENCED = "concat('Here: ```json\n', props, '\n``` and ```', event_type, '``` done')"


@query(f"""SELECT event_id, regexp_extract({_FENCED}, '```(?:json)?[ \\n]*([{{].*?[}}])[ \\n]*```', 1) AS code, array_to_string(list_transform(string_split(concat(' ', event_type, ' ; ', user_id, ';x '), ';'), lambda x: trim(x)), '|') AS parts, right(concat(event_type, '/', event_id), 6) AS tail FROM events""")
def text_parts(spark, sf_dir):
    """The first fenced block of an answer, a list that is split, stripped and joined again, and the tail of a log."""
    fenced = F.concat(F.lit("Here: ```json\n"), "props", F.lit("\n``` and ```"), "event_type", F.lit("``` done"))
    parts = F.split(F.concat(F.lit(" "), "event_type", F.lit(" ; "), F.col("user_id").cast("string"), F.lit(";x ")), ";")
    tail = F.expr("right(concat(event_type, '/', event_id), 6)")
    e = bindings.read(spark, sf_dir, "events")
    return e.select("event_id", F.regexp_extract(fenced, r"```(?:json)?\s*(\{.*?\})\s*```", 1).alias("code"), F.array_join(F.transform(parts, lambda x: F.trim(x)), "|").alias("parts"), tail.alias("tail"))
