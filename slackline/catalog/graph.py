"""State graphs of two servers on a circle of five points, explored to the fixpoint from the work functions that embeddings give."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import functions as F

from slackline.catalog.registry import query
from slackline.functions import arrays
from slackline.operators import potentials
from slackline.operators.configs import Context
from slackline.plans import explore
from slackline.sources import bindings, metrics

K, M, C = 2, 5, 15
#: An embedding's first C values, in units of 1 / COARSE, are a work function to start from.
COARSE = 8
#: Levels and rounds of the SQL's recursions, more than the graphs have.
DEEP = 20

_SPACE = f"""configs AS (SELECT row_number() OVER (ORDER BY a, b) - 1 AS idx, [a, b] AS cfg FROM range({M}) x(a), range({M}) y(b) WHERE a <= b),
moves AS (SELECT r, m.idx, i, c.idx AS nbr, cost FROM (SELECT r, idx, i, least(abs(cfg[i + 1] - r), {M} - abs(cfg[i + 1] - r)) AS cost,
  list_sort([r, cfg[2 - i]]) AS to_cfg FROM configs, range(2) s(i), range({M}) q(r)) m JOIN configs c ON c.cfg = to_cfg),
tables AS (SELECT list(nbr ORDER BY r, idx, i) AS nbr, list(cost ORDER BY r, idx, i) AS cost FROM moves)"""


def _d(a: str, b: str) -> str:
    return f"least(abs({a} - {b}), {M} - abs({a} - {b}))"


_AFTER = f"list_transform(range({C}), lambda x: least(w[t.nbr[(r * {C} + x) * 2 + 1] + 1] + t.cost[(r * {C} + x) * 2 + 1], w[t.nbr[(r * {C} + x) * 2 + 2] + 1] + t.cost[(r * {C} + x) * 2 + 2]))"
_STARTS = f"SELECT vec_id AS start, list_transform(e, lambda x: x - list_min(e)) AS w FROM (SELECT vec_id, list_transform(embedding[1:{C}], lambda x: CAST(floor(CAST(x AS DOUBLE) * {COARSE}) AS BIGINT)) AS e FROM embeddings)"
#: The recursion keeps distinct rows; depth stays under a bound that the graph doesn't reach.
_GRAPH = f"""{_SPACE}, starts AS ({_STARTS}), reach AS (SELECT w, CAST(0 AS BIGINT) AS depth FROM starts UNION SELECT list_transform(a, lambda x: x - list_min(a)), depth + 1 FROM (SELECT {_AFTER} AS a, depth FROM reach, tables t, range({M}) q(r) WHERE depth < {DEEP})),
nodes AS (SELECT w, min(depth) AS depth FROM reach GROUP BY w),
grown AS (SELECT w AS u, r, {_AFTER} AS a FROM nodes, tables t, range({M}) q(r)),
edges AS (SELECT u, r, list_min(a) AS d_min, list_max(list_transform(list_zip(u, a), lambda p: p[2] - p[1])) AS ext, list_transform(a, lambda x: x - list_min(a)) AS v FROM grown)"""


def starts(spark, sf_dir):
    coarse = F.transform(F.slice("embedding", 1, C), lambda x: F.floor(x.cast("double") * COARSE))
    return bindings.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("start"), coarse.alias("wf"))


def graph(spark, sf_dir, **more) -> explore.Graph:
    context = Context.of(K, metrics.circle_matrix(M))
    return explore.explore(spark, context, starts(spark, sf_dir), explore.point_transitions(M), **more)


def _values(g: explore.Graph, wf: str = "wf"):
    return arrays.joined(F.col(wf)).alias("wf")


@query(f"WITH RECURSIVE {_GRAPH} SELECT array_to_string(w, ',') AS wf, depth FROM nodes")
def bfs_nodes(spark, sf_dir):
    g = graph(spark, sf_dir)
    return g.nodes.select(_values(g), "depth")


def _ends(g: explore.Graph):
    n = g.nodes.select("id", arrays.joined(F.col("wf")).alias("w"))
    return g.edges.join(n.toDF("from", "u"), "from").join(n.toDF("to", "v"), "to")


@query(f"WITH RECURSIVE {_GRAPH} SELECT array_to_string(u, ',') AS u, r AS request, array_to_string(v, ',') AS v, CAST(d_min AS BIGINT) AS d_min, CAST(ext AS BIGINT) AS ext, CAST({K + 1} * d_min - ext AS BIGINT) AS weight FROM edges")
def bfs_edges(spark, sf_dir):
    return _ends(graph(spark, sf_dir)).select("u", "request", "v", "d_min", "ext", "weight")


@query(f"WITH RECURSIVE {_GRAPH} SELECT count(*) AS edges, count(DISTINCT (u, v)) AS pairs FROM edges")
def bfs_edge_count(spark, sf_dir):
    return graph(spark, sf_dir).edges.agg(F.count("*").alias("edges"), F.count_distinct("from", "to").alias("pairs"))


@query(f"WITH RECURSIVE {_GRAPH} SELECT depth, count(*) AS n FROM nodes GROUP BY 1")
def bfs_depth(spark, sf_dir):
    return graph(spark, sf_dir).nodes.groupBy("depth").agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE {_GRAPH} SELECT array_to_string(w, ',') AS wf, CAST(list_sum(w) AS BIGINT) AS phi FROM nodes")
def bfs_potential(spark, sf_dir):
    """A potential at every explored node."""
    return graph(spark, sf_dir).nodes.select(arrays.joined(F.col("wf")).alias("wf"), arrays.total(F.col("wf")).alias("phi"))


#: Nodes with the least of the shortest request paths: the number of a start, then requests.
_PATHS = f"""paths AS (SELECT w, CAST(0 AS BIGINT) AS depth, [min(start)] AS path FROM starts GROUP BY w
 UNION ALL SELECT v, depth + 1, min(list_append(path, r)) FROM (SELECT e.v, p.depth, p.path, e.r FROM paths p JOIN edges e ON e.u = p.w JOIN nodes n ON n.w = e.v AND n.depth = p.depth + 1) GROUP BY v, depth)"""


@query(f"WITH RECURSIVE {_GRAPH}, {_PATHS} SELECT array_to_string(w, ',') AS wf, array_to_string(path, ',') AS path FROM paths")
def bfs_paths(spark, sf_dir):
    """A shortest request path to every node."""
    return graph(spark, sf_dir).nodes.select(arrays.joined(F.col("wf")).alias("wf"), arrays.joined(F.col("path")).alias("path"))


@query(f"WITH RECURSIVE {_GRAPH}, {_PATHS} SELECT array_to_string(path, ',') AS path, r AS request, CAST(list_sum(v) - list_sum(u) + {K + 1} * d_min - ext AS BIGINT) AS slack FROM edges JOIN paths ON w = u WHERE list_sum(v) - list_sum(u) + {K + 1} * d_min - ext < 0")
def bfs_violations(spark, sf_dir):
    """Every edge on which the sum breaks the inequality, with the requests that lead to it: checked level by level."""
    g = graph(spark, sf_dir, potential=arrays.total, rho=K)
    return g.violations.select(arrays.joined(F.col("path")).alias("path"), "request", F.col("slack").cast("long").alias("slack"))


@query(f"""WITH RECURSIVE {_GRAPH}, relaxed AS (SELECT w, CAST(0 AS BIGINT) AS b, 0 AS n FROM nodes UNION ALL
 SELECT w, least(b, low), n + 1 FROM (SELECT x.w, x.b, x.n, (SELECT min(y.b + {K + 1} * e.d_min - e.ext) FROM edges e JOIN relaxed y ON y.w = e.v WHERE e.u = x.w) AS low FROM relaxed x WHERE x.n < {DEEP}))
SELECT array_to_string(w, ',') AS wf, CAST(b AS BIGINT) AS bellman FROM relaxed WHERE n = {DEEP}""")
def bellman_relax(spark, sf_dir):
    g = graph(spark, sf_dir)
    b = explore.bellman(g.nodes, g.edges)
    return g.nodes.join(b, "id").select(arrays.joined(F.col("wf")).alias("wf"), "bellman")


@query(f"SELECT row_number() OVER (ORDER BY r) - 1 AS ord, 'point' AS kind, r AS s, r AS t FROM (SELECT DISTINCT event_id % {M} AS r FROM events)")
def transitions(spark, sf_dir):
    """The points that events request, in order."""
    r = sorted(x["r"] for x in bindings.requests(spark, sf_dir, M).select("r").distinct().collect())  # M rows at most
    return explore.transitions(spark, [("point", p, p) for p in r])


@query("""WITH q AS (SELECT DISTINCT event_id % 6 * 2 + 1 AS s, user_id % 6 * 2 AS t FROM events), m AS (SELECT 'point' AS kind, t AS s, t FROM (SELECT DISTINCT t FROM q) UNION ALL SELECT 'ride', s, t FROM q)
SELECT row_number() OVER (ORDER BY kind, s, t) - 1 AS ord, kind, s, t FROM m""")
def transitions_taxi(spark, sf_dir):
    """The targets of the rides that events ask for, then the rides."""
    rides = sorted((x["s"], x["t"]) for x in bindings.requests(spark, sf_dir, 6).select("s", "t").distinct().collect())  # 36 rows at most
    return explore.transitions(spark, [*(("point", t, t) for t in sorted({t for _, t in rides})), *(("ride", s, t) for s, t in rides)])


@query(f"WITH {bindings.NODES_SQL} SELECT id, sha256(array_to_string(wf, ',')) AS hash FROM nodes")
def wf_hash(spark, sf_dir):
    """A digest of normalised values in an agreed spelling."""
    return bindings.nodes(spark, sf_dir).select("id", F.sha2(arrays.joined(F.col("wf")), 256).alias("hash"))


@query(f"""WITH {bindings.NODES_SQL}, images AS (SELECT id, list_transform(range(64), lambda x: wf[((CASE WHEN s THEN 64 - x ELSE x END) + 2 * r) % 64 + 1]) AS w FROM nodes, range(32) q(r), (SELECT unnest([true, false]) AS s))
SELECT id, array_to_string(min(w), ',') AS canonical FROM images GROUP BY id""")
def wf_canonical(spark, sf_dir):
    """The least image under rotations by two and reflections of one server's circle."""
    image = lambda w, r, s: F.array(*(w[((64 - x if s else x) + 2 * r) % 64] for x in range(64)))
    every = lambda w: F.array_min(F.array(*(image(w, r, s) for r in range(32) for s in (True, False))))
    least = arrays.let(F.col("wf"), every)
    return bindings.nodes(spark, sf_dir).select("id", arrays.joined(least).alias("canonical"))


def _whole_graph(k: int, m: int, size: int, starts: str) -> str:
    """Nodes and edges of k servers on a circle of m points; ``size`` configurations; starts: a query for cfg."""
    d = lambda a, b: f"least(abs({a} - {b}), {m} - abs({a} - {b}))"
    places = [f"x{i}" for i in range(k)]
    match = "least(" + ", ".join(" + ".join(d(f"s.cfg[{i + 1}]", f"c.cfg[{p[i] + 1}]") for i in range(k)) for p in permutations(range(k))) + ")"
    at = lambda i: f"(r * {size} + x) * {k} + {i + 1}"
    after = f"list_transform(range({size}), lambda x: least({', '.join(f'w[t.nbr[{at(i)}] + 1] + t.cost[{at(i)}]' for i in range(k))}))"
    return f"""configs AS (SELECT row_number() OVER (ORDER BY {', '.join(places)}) - 1 AS idx, [{', '.join(places)}] AS cfg FROM {', '.join(f'range({m}) t{i}({x})' for i, x in enumerate(places))} WHERE {' AND '.join(f'{a} <= {b}' for a, b in zip(places, places[1:]))}),
moves AS (SELECT r, m.idx, i, c.idx AS nbr, cost FROM (SELECT r, idx, i, {d('cfg[i + 1]', 'r')} AS cost, list_sort(list_transform(range({k}), lambda j: CASE WHEN j = i THEN r ELSE cfg[j + 1] END)) AS to_cfg FROM configs, range({k}) s(i), range({m}) q(r)) m JOIN configs c ON c.cfg = to_cfg),
tables AS (SELECT list(nbr ORDER BY r, idx, i) AS nbr, list(cost ORDER BY r, idx, i) AS cost FROM moves),
reach AS (SELECT list(CAST({match} AS BIGINT) ORDER BY c.idx) AS w FROM ({starts}) s, configs c GROUP BY s.cfg UNION SELECT list_transform(a, lambda x: x - list_min(a)) FROM (SELECT {after} AS a FROM reach, tables t, range({m}) q(r))),
edges AS (SELECT list_min(a) AS d_min, list_max(list_transform(list_zip(w, a), lambda p: p[2] - p[1])) AS ext FROM (SELECT w, {after} AS a FROM reach, tables t, range({m}) q(r)))"""


@query(f"WITH RECURSIVE {_whole_graph(3, 6, 56, 'SELECT DISTINCT list_sort([event_id % 6, event_id // 6 % 6, user_id % 6]) AS cfg FROM events')}, n AS (SELECT count(*) AS nodes FROM reach) SELECT max(nodes) AS nodes, count(*) AS edges, count(*) FILTER (4 * d_min - ext < 0) AS violations, round(1 - CAST(count(*) FILTER (4 * d_min - ext < 0) AS DOUBLE) / count(*), 9) AS score FROM edges, n")
def flagship(spark, sf_dir):
    """The zero potential on three servers and a circle of six: published as 350 nodes, 2 100 edges, 570 violations.

    Starts are the configurations that events name, which are all 56 in tables of some hundred events.
    """
    context = Context.of(3, metrics.circle_matrix(6))
    named = F.array_sort(F.array(F.col("event_id") % 6, F.floor(F.col("event_id") / 6) % 6, F.col("user_id") % 6))
    found = bindings.read(spark, sf_dir, "events").select(named.alias("cfg")).distinct().collect()  # 56 rows at most
    g = explore.explore(spark, context, sorted(tuple(r["cfg"]) for r in found), explore.point_transitions(6))
    n = g.nodes.select("id", potentials.SIMPLE["zero"](F.col("wf")).alias("phi"))
    e = g.edges.join(n.toDF("from", "pu"), "from").join(n.toDF("to", "pv"), "to")
    found = e.agg(F.count("*").alias("edges"), F.count_if(F.col("pv") - F.col("pu") + F.col("weight") < 0).alias("violations"))
    return g.nodes.agg(F.count("*").alias("nodes")).join(F.broadcast(found)).select("nodes", "edges", "violations", F.round(1 - F.col("violations") / F.col("edges"), 9).alias("score"))
