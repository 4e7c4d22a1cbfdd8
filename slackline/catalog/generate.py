"""Generators, metrics, configurations and work-function kernels."""

from __future__ import annotations

from pyspark.sql import functions as F

from slackline.catalog.registry import query
from slackline.functions import arrays
from slackline.operators import configs, workfunctions
from slackline.operators.configs import Context
from slackline.sources import bindings, metrics

K, M = 3, 6

_CONFIGS = f"configs AS (SELECT row_number() OVER (ORDER BY a, b, c) - 1 AS idx, [a, b, c] AS cfg FROM range({M}) x(a), range({M}) y(b), range({M}) z(c) WHERE a <= b AND b <= c)"
_D = lambda a, b, m=M: f"least(abs({a} - {b}), {m} - abs({a} - {b}))"


def _matching(a: str, b: str) -> str:
    from itertools import permutations

    return "least(" + ", ".join(" + ".join(_D(f"{a}[{i + 1}]", f"{b}[{p[i] + 1}]") for i in range(K)) for p in permutations(range(K))) + ")"


def _distance(a, b):
    return arrays.circle_distance(a, b, M)


def _count(spark, sf_dir, table: str) -> int:
    return bindings.read(spark, sf_dir, table).count()


_PAIRED = "n AS (SELECT count(*) AS n FROM {}), configs AS (SELECT row_number() OVER (ORDER BY a, b) - 1 AS idx, a, b FROM (SELECT unnest(range(n)) AS a FROM n), n, unnest(range(n.n)) y(b) WHERE a <= b)".format


@query(f"WITH {_PAIRED('supplier')} SELECT idx, concat_ws(',', a, b) AS cfg FROM configs")
def gen_multisets(spark, sf_dir):
    """Two servers among as many points as there are suppliers."""
    return configs.multisets(spark, _count(spark, sf_dir, "supplier"), 2).select("idx", arrays.joined(F.col("cfg")).alias("cfg"))


@query("WITH p AS (SELECT DISTINCT CAST(l_linenumber AS BIGINT) AS p FROM lineitem) SELECT row_number() OVER (ORDER BY a.p, b.p, c.p) - 1 AS a_id, concat_ws(',', a.p, b.p, c.p) AS points FROM p a, p b, p c")
def gen_assignments(spark, sf_dir):
    """Three places, each any of the line numbers that orders have."""
    found = bindings.read(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("long").alias("p")).distinct().collect()  # seven
    return configs.assignments(spark, sorted(r["p"] for r in found), 3).select("a_id", arrays.joined(F.col("points")).alias("points"))


@query(f"WITH {_PAIRED('nation')} SELECT idx, concat_ws(',', 2 * a, 2 * b) AS cfg FROM configs")
def gen_taxi_initial(spark, sf_dir):
    """Start states with both servers on even points of the doubled circle of nations."""
    return configs.multisets(spark, _count(spark, sf_dir, "nation"), 2).select("idx", arrays.joined(F.transform("cfg", lambda p: 2 * p)).alias("cfg"))


def _pairs(d: str, table: str = "supplier") -> str:
    return f"WITH n AS (SELECT count(*) AS m FROM {table}) SELECT a, b, CAST({d} AS BIGINT) AS d FROM (SELECT unnest(range(m)) AS a, m FROM n), unnest(range(m)) y(b)"


@query(_pairs("least(abs(a - b), m - abs(a - b))"))
def metric_circle(spark, sf_dir):
    """The circle of all suppliers."""
    return metrics.circle(spark, _count(spark, sf_dir, "supplier"))


@query("SELECT event_id, least(abs(x - y), 8.0 - abs(x - y)) AS d FROM (SELECT event_id, ((value - 100) % 8 + 8) % 8 AS x, ((value * 3) % 8 + 8) % 8 AS y FROM (SELECT event_id, CAST(round(value * 100) AS BIGINT) // 25 AS value FROM events))".replace("8.0", "8"))
def metric_circle_cont(spark, sf_dir):
    """Points off the circle, negative ones too, wrap; quarter units keep doubles exact."""
    value = F.floor(F.round(F.col("value") * 100) / 25)
    return bindings.read(spark, sf_dir, "events").select("event_id", arrays.circle_distance_continuous(value - 100, value * 3, 8).cast("long").alias("d"))


@query(_pairs("CASE WHEN a = b THEN 0 ELSE 1 END"))
def metric_uniform(spark, sf_dir):
    return metrics.uniform(spark, _count(spark, sf_dir, "supplier"))


@query("""WITH n AS (SELECT count(*) AS n FROM nation), p AS (SELECT a, b, n, least(abs(a % n - b % n), n - abs(a % n - b % n)) AS d FROM (SELECT unnest(range(2 * n)) AS a, n FROM n), unnest(range(2 * n)) y(b))
SELECT a, b, CAST(CASE WHEN (a < n) = (b < n) THEN d ELSE n // 2 - d END AS BIGINT) AS d FROM p""")
def metric_antipode(spark, sf_dir):
    """The circle of nations and their opposites."""
    return metrics.antipode_extension(metrics.circle(spark, _count(spark, sf_dir, "nation")))


@query(_pairs("abs(a - b)"))
def metric_line(spark, sf_dir):
    return metrics.line(spark, _count(spark, sf_dir, "supplier"))


@query(f"WITH {bindings.NODES_SQL} SELECT id, label, bellman, low, list_max(wf) AS top, CAST(list_sum(wf) AS BIGINT) AS total FROM nodes")
def instance_nodes(spark, sf_dir):
    n = bindings.nodes(spark, sf_dir)
    return n.select("id", "label", "bellman", "low", F.array_max("wf").alias("top"), arrays.total(F.col("wf")).alias("total"))


@query(f"WITH {bindings.EDGES_SQL} SELECT edge_id, u, v, request, CAST(depth AS BIGINT) AS depth, d_min, ext, 2 * d_min - ext AS weight FROM edges")
def instance_edges(spark, sf_dir):
    e = bindings.edges(spark, sf_dir)
    return e.select("edge_id", F.col("from").alias("u"), F.col("to").alias("v"), "request", "depth", "d_min", "ext", (2 * F.col("d_min") - F.col("ext")).alias("weight"))


@query(f"WITH {bindings.NODES_SQL} SELECT CAST(id AS INTEGER) AS id, CAST(list_sum(list_transform(wf, lambda x: CAST(CAST(x AS FLOAT) AS BIGINT))) AS BIGINT) AS total FROM nodes")
def pack_float32(spark, sf_dir):
    """Work functions narrowed to 32-bit floats, ids to 32-bit integers; values under 2^24 keep exact."""
    packed = bindings.nodes(spark, sf_dir).select(F.col("id").cast("int").alias("id"), F.transform("wf", lambda x: x.cast("float")).alias("wf"))
    return packed.select("id", arrays.total(F.transform("wf", lambda x: x.cast("long"))).alias("total"))


_EVENT_CFG = "SELECT event_id, [event_id % 6, (event_id // 6) % 6, user_id % 6] AS raw, list_sort([event_id % 6, (event_id // 6) % 6, user_id % 6]) AS cfg FROM events"


def _event_cfg(spark, sf_dir):
    e = bindings.read(spark, sf_dir, "events")
    return e.select("event_id", F.array(F.col("event_id") % M, F.floor(F.col("event_id") / M) % M, F.col("user_id") % M).alias("cfg"))


@query(f"WITH {_CONFIGS}, e AS ({_EVENT_CFG}) SELECT event_id, CAST(idx AS BIGINT) AS idx FROM e JOIN configs USING (cfg)")
def config_lookup(spark, sf_dir):
    return configs.lookup(_event_cfg(spark, sf_dir), configs.multisets(spark, M, K)).select("event_id", "idx")


@query(f"WITH e AS ({_EVENT_CFG}) SELECT CAST(count(*) = 0 AS BIGINT) AS empty, count(*) FILTER (len(raw) <> 3) AS wrong_length, count(*) FILTER (list_max(raw) >= 5) AS out_of_range, count(*) FILTER (raw <> cfg) AS unsorted, count(*) - count(DISTINCT raw) AS repeated FROM e")
def config_validate(spark, sf_dir):
    """How often events, taken as an order of configurations over five points, break each rule."""
    return configs.faults(_event_cfg(spark, sf_dir), K, 5)


_MOVES = f"""{_CONFIGS}, spots AS (SELECT idx, cfg, i FROM configs, range(3) s(i)),
moved AS (SELECT r, idx, i, {_D('cfg[i + 1]', 'r')} AS cost, list_sort(list_transform(range(3), lambda j: CASE WHEN j = i THEN r ELSE cfg[j + 1] END)) AS to_cfg FROM spots, range({M}) q(r)),
moves AS (SELECT r, moved.idx, i, c.idx AS nbr, cost FROM moved JOIN configs c ON c.cfg = to_cfg)"""


@query(f"""WITH {_PAIRED('nation')}, spots AS (SELECT idx, i, CASE WHEN i = 0 THEN a ELSE b END AS x, CASE WHEN i = 0 THEN b ELSE a END AS y FROM configs, range(2) s(i)),
moved AS (SELECT q.r, s.idx, s.i, least(abs(x - q.r), n.n - abs(x - q.r)) AS cost, least(q.r, y) AS a, greatest(q.r, y) AS b FROM spots s, n, unnest(range(n.n)) q(r))
SELECT r, moved.idx, i, c.idx AS nbr, CAST(cost AS BIGINT) AS cost FROM moved JOIN configs c USING (a, b)""")
def moves_table(spark, sf_dir):
    """Two servers on the circle of nations: where each move of each configuration leads."""
    m = _count(spark, sf_dir, "nation")
    return configs.moves(configs.multisets(spark, m, 2), metrics.circle(spark, m), 2)


@query(f"SELECT event_id, CAST({_D('event_id % 6', 'user_id % 6')} AS BIGINT) AS d FROM events")
def point_distance(spark, sf_dir):
    e = bindings.read(spark, sf_dir, "events").select("event_id", (F.col("event_id") % M).alias("a"), (F.col("user_id") % M).alias("b"))
    return e.join(metrics.circle(spark, M), ["a", "b"]).select("event_id", "d")


@query(f"WITH e AS ({_EVENT_CFG}), f AS (SELECT event_id, cfg AS a, [(event_id * 5) % 6, (event_id // 7) % 6, event_id // 36 % 6] AS b FROM e) SELECT event_id, CAST({_matching('a', 'b')} AS BIGINT) AS d FROM f")
def set_distance(spark, sf_dir):
    e = _event_cfg(spark, sf_dir)
    b = F.array(F.col("event_id") * 5 % M, F.floor(F.col("event_id") / 7) % M, F.floor(F.col("event_id") / 36) % M)
    return e.select("event_id", arrays.set_distance(F.col("cfg"), b, K, _distance).alias("d"))


@query(f"WITH e AS ({_EVENT_CFG}) SELECT event_id, CAST({_D('cfg[1]', 'cfg[2]')} + {_D('cfg[1]', 'cfg[3]')} + {_D('cfg[2]', 'cfg[3]')} AS BIGINT) AS cost FROM e")
def clique_cost(spark, sf_dir):
    """Of every event's configuration."""
    return _event_cfg(spark, sf_dir).select("event_id", arrays.clique_cost(F.col("cfg"), K, _distance).alias("cost"))


_START = "[c_custkey % 6, c_nationkey % 6, c_custkey // 6 % 6]"
_INITIAL = f"{_MOVES}, starts AS (SELECT c_custkey AS of, {_START} AS start, c_custkey % 6 AS r, c_nationkey % 6 AS t FROM customer), initial AS (SELECT s.of, idx, {_matching('s.start', 'c.cfg')} AS value FROM starts s, configs c)"


def _starts(spark, sf_dir):
    """of, start, r, t: a configuration, a request and a ride's end for every customer."""
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    start = F.array(key % 6, nation.cast("long") % 6, F.floor(key / 6) % 6)
    return bindings.read(spark, sf_dir, "customer").select(key.alias("of"), start.alias("start"), (key % 6).alias("r"), (nation.cast("long") % 6).alias("t"))


@query(f"WITH {_INITIAL} SELECT of, CAST(idx AS BIGINT) AS idx, CAST(value AS BIGINT) AS value FROM initial")
def initial_wf(spark, sf_dir):
    """A work function from every customer's start."""
    return workfunctions.initial(configs.multisets(spark, M, K), _starts(spark, sf_dir), _distance).select("of", "idx", "value")


def _valued(wfs):
    """of, idx, value of work functions that are arrays."""
    return wfs.select("of", F.posexplode("wf").alias("idx", "value")).select("of", F.col("idx").cast("long").alias("idx"), "value")


def _update_sql(source: str, r: str) -> str:
    return f"SELECT w.of, m.idx, min(w.value + m.cost) AS value FROM {source} w JOIN starts s ON s.of = w.of JOIN moves m ON m.nbr = w.idx AND m.r = {r} GROUP BY w.of, m.idx"


@query(f"WITH {_INITIAL}, one AS ({_update_sql('initial', 's.r')}) SELECT of, CAST(idx AS BIGINT) AS idx, CAST(value AS BIGINT) AS value FROM ({_update_sql('one', 's.t')})")
def wf_update(spark, sf_dir):
    """Two requests of every customer."""
    c = configs.multisets(spark, M, K)
    moves = configs.moves(c, metrics.circle(spark, M), K)
    first = workfunctions.initial_arrays(c, _starts(spark, sf_dir).distinct(), _distance)
    return _valued(workfunctions.update(workfunctions.update(first, moves, "r"), moves, "t"))


_LISTS = f"""{_MOVES}, tables AS (SELECT list(nbr ORDER BY r, idx, i) AS nbr, list(cost ORDER BY r, idx, i) AS cost FROM moves)"""


def _fold(tables: str, n: int, k: int) -> str:
    """The update of list w by request r, from flat lists of moves."""
    return f"list_transform(range({n}), lambda x: list_min(list_transform(range({k}), lambda i: w[{tables}.nbr[(r * {n} + x) * {k} + i + 1] + 1] + {tables}.cost[(r * {n} + x) * {k} + i + 1])))"


_K2 = """configs AS (SELECT row_number() OVER (ORDER BY a, b) - 1 AS idx, [a, b] AS cfg FROM range(6) x(a), range(6) y(b) WHERE a <= b),
moves AS (SELECT r, m.idx, i, c.idx AS nbr, cost FROM (SELECT r, idx, i, least(abs(cfg[i + 1] - r), 6 - abs(cfg[i + 1] - r)) AS cost,
  list_sort([r, cfg[2 - i]]) AS to_cfg FROM configs, range(2) s(i), range(6) q(r)) m JOIN configs c ON c.cfg = to_cfg),
tables AS (SELECT list(nbr ORDER BY r, idx, i) AS nbr, list(cost ORDER BY r, idx, i) AS cost FROM moves),
initial AS (SELECT list(least(least(abs(0 - cfg[1]), 6 - abs(0 - cfg[1])) + least(abs(1 - cfg[2]), 6 - abs(1 - cfg[2])), least(abs(0 - cfg[2]), 6 - abs(0 - cfg[2])) + least(abs(1 - cfg[1]), 6 - abs(1 - cfg[1]))) ORDER BY idx) AS w FROM configs)"""


@query(
    f"""WITH RECURSIVE {_K2},
    q AS (SELECT user_id, event_id % 6 AS r, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS at FROM events),
    fold AS (SELECT user_id, CAST(0 AS BIGINT) AS n, w FROM (SELECT DISTINCT user_id FROM events), initial
      UNION ALL SELECT f.user_id, f.n + 1, {_fold('tables', 21, 2)} FROM fold f JOIN q ON q.user_id = f.user_id AND q.at = f.n + 1, tables)
    SELECT user_id, n, array_to_string(w, ',') AS wf FROM fold QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1"""
)
def wf_replay(spark, sf_dir):
    """Every user's work function after all its events, two servers on a circle of six."""
    done = workfunctions.replay(bindings.requests(spark, sf_dir, 6), Context.of(2, metrics.circle_matrix(6)), (0, 1))
    return done.select("user_id", "n", arrays.joined(F.col("wf")).alias("wf"))


_PRE = f"""pre AS (SELECT p.s, p.t, p.idx, c.idx AS source FROM (SELECT s, t, idx, list_sort(list_transform(range(3), lambda j: CASE WHEN j + 1 = list_position(cfg, t) THEN s ELSE cfg[j + 1] END)) AS back
  FROM configs, (SELECT DISTINCT o_orderkey % 6 AS s, o_custkey % 6 AS t FROM orders) WHERE list_contains(cfg, t)) p JOIN configs c ON c.cfg = p.back)"""


@query(f"WITH {_CONFIGS}, {_PRE} SELECT s, t, CAST(idx AS BIGINT) AS idx, CAST(source AS BIGINT) AS source FROM pre")
def taxi_preimage(spark, sf_dir):
    """For every ride that an order asks for."""
    rides = bindings.read(spark, sf_dir, "orders").select((F.col("o_orderkey") % 6).alias("s"), (F.col("o_custkey") % 6).alias("t")).distinct()
    return workfunctions.preimages(configs.multisets(spark, M, K), rides).select("s", "t", "idx", "source")


@query(f"""WITH {_INITIAL}, pre AS (SELECT p.of, p.idx, c.idx AS source, d FROM (SELECT of, idx, {_D('r', 't')} AS d, list_sort(list_transform(range(3), lambda j: CASE WHEN j + 1 = list_position(cfg, t) THEN r ELSE cfg[j + 1] END)) AS back
  FROM configs, starts WHERE list_contains(cfg, t)) p JOIN configs c ON c.cfg = p.back),
carried AS (SELECT pre.of, pre.idx, value + d AS value FROM pre JOIN initial i ON i.idx = source AND i.of = pre.of) SELECT of, CAST(idx AS BIGINT) AS idx, CAST(value AS BIGINT) AS value FROM ({_update_sql('carried', 's.t')})""")
def taxi_update(spark, sf_dir):
    """A ride of every customer."""
    c, d = configs.multisets(spark, M, K), metrics.circle(spark, M)
    first = workfunctions.initial_arrays(c, _starts(spark, sf_dir).withColumnRenamed("r", "s").distinct(), _distance)
    return _valued(workfunctions.ride(first, configs.moves(c, d, K), c, d))


@query(f"WITH {bindings.NODES_SQL} SELECT id, list_min(wf) AS low, array_to_string(wf, ',') AS wf FROM nodes")
def wf_normalize(spark, sf_dir):
    n = bindings.nodes(spark, sf_dir)
    return n.select("id", F.array_min("wf").alias("low"), arrays.joined(F.col("wf")).alias("wf"))


@query(f"WITH {bindings.EDGES_SQL} SELECT edge_id, d_min, ext, 2 * d_min - ext AS weight FROM edges")
def edge_metrics(spark, sf_dir):
    return bindings.edges(spark, sf_dir).select("edge_id", "d_min", "ext", (2 * F.col("d_min") - F.col("ext")).alias("weight"))


_PRICED_SQL = f"""priced AS (SELECT event_id AS ord, cfg, event_id * 7 % 23 AS value FROM ({_EVENT_CFG})),
support AS (SELECT cfg, min(value) AS value, max(ord) FILTER (value = low) AS ord FROM (SELECT *, min(value) OVER (PARTITION BY cfg) AS low FROM priced) GROUP BY cfg)"""
_SUPPORT_SQL = _PRICED_SQL


def _priced(spark, sf_dir):
    """ord, cfg, value: every event's configuration at a price."""
    return _event_cfg(spark, sf_dir).select(F.col("event_id").alias("ord"), F.array_sort("cfg").alias("cfg"), (F.col("event_id") * 7 % 23).alias("value"))


def _support(spark, sf_dir):
    """The sparse work function that the events' configurations make: those that no other implies."""
    return workfunctions.undominated(_priced(spark, sf_dir), K, _distance).select("cfg", "value")


@query(f"WITH {_SUPPORT_SQL}, e AS ({_EVENT_CFG}) SELECT event_id, CAST(min(s.value + {_matching('s.cfg', 'e.cfg')}) AS BIGINT) AS value FROM e, support s GROUP BY event_id")
def support_eval(spark, sf_dir):
    """A sparse work function at every event's configuration, once for each distinct one."""
    e = _event_cfg(spark, sf_dir).withColumn("cfg", F.array_sort("cfg"))
    return e.join(workfunctions.evaluate_support(_support(spark, sf_dir), e.select("cfg").distinct(), K, _distance), "cfg").select("event_id", "value")


@query(f"""WITH {_CONFIGS}, {_SUPPORT_SQL}, dense AS (SELECT idx, cfg, min(s.value + {_matching('s.cfg', 'c.cfg')}) AS value FROM configs c, support s GROUP BY ALL) SELECT CAST(idx AS BIGINT) AS idx, CAST(value AS BIGINT) AS value FROM dense""".replace("SELECT idx, cfg, min", "SELECT idx, c.cfg, min"))
def support_dense(spark, sf_dir):
    return workfunctions.dense(_support(spark, sf_dir), configs.multisets(spark, M, K), K, _distance)


@query(f"""WITH {_SUPPORT_SQL} SELECT CAST(ord AS BIGINT) AS ord, CAST(value AS BIGINT) AS value FROM support a WHERE NOT EXISTS (SELECT 1 FROM support o WHERE o.ord <> a.ord
  AND abs(a.value - o.value) >= {_matching('a.cfg', 'o.cfg')} AND (a.value > o.value OR (a.value = o.value AND a.ord < o.ord)))""")
def support_prune(spark, sf_dir):
    """Of all events' configurations; the SQL takes the cheapest and last of each first, which implies the others."""
    return workfunctions.undominated(_priced(spark, sf_dir), K, _distance).select("ord", "value")


def _one_update(source: str, r: str) -> str:
    return f"SELECT m.idx, min(w.value + m.cost) AS value FROM moves m JOIN {source} w ON w.idx = m.nbr WHERE m.r = {r} GROUP BY m.idx"


_DENSE = f"""{_MOVES}, {_SUPPORT_SQL}, dense AS (SELECT c.idx, min(s.value + {_matching('s.cfg', 'c.cfg')}) AS value FROM configs c, support s GROUP BY c.idx), served AS ({_one_update('dense', '4')})"""


@query(f"WITH {_DENSE} SELECT CAST(idx AS BIGINT) AS idx, CAST(value AS BIGINT) AS value FROM served")
def support_update(spark, sf_dir):
    """The sparse work function after a request, as a dense one; the SQL updates the dense one."""
    after = workfunctions.update_support(_support(spark, sf_dir), 4, list(range(M)), K, _distance)
    return workfunctions.dense(after, configs.multisets(spark, M, K), K, _distance)


@query(f"""WITH {_DENSE}, back AS (SELECT idx, list_sort(list_transform(range(3), lambda j: CASE WHEN j + 1 = list_position(cfg, 1) THEN 4 ELSE cfg[j + 1] END)) AS cfg FROM configs WHERE list_contains(cfg, 1)),
carried AS (SELECT b.idx, value + 3 AS value FROM back b JOIN configs c ON c.cfg = b.cfg JOIN served s ON s.idx = c.idx) SELECT CAST(idx AS BIGINT) AS idx, CAST(value AS BIGINT) AS value FROM ({_one_update('carried', '1')})""")
def support_taxi(spark, sf_dir):
    """The sparse work function after a ride from 4 to 1, as a dense one; the SQL carries the dense one through preimages."""
    after = workfunctions.ride_support(_support(spark, sf_dir), 4, 1, list(range(M)), K, _distance, 3)
    return workfunctions.dense(after, configs.multisets(spark, M, K), K, _distance)


@query("SELECT event_id, (event_id % 8 + 4) % 8 AS opposite FROM events")
def antipode(spark, sf_dir):
    return bindings.read(spark, sf_dir, "events").select("event_id", arrays.antipode(F.col("event_id") % 8, 8).alias("opposite"))


@query("""WITH n AS (SELECT count(*) AS n FROM nation), c AS (SELECT row_number() OVER (ORDER BY a, b) - 1 AS position, a, b FROM (SELECT unnest(range(2 * n)) AS a FROM n), n, unnest(range(2 * n.n)) y(b) WHERE a <= b)
SELECT row_number() OVER (ORDER BY a, b) - 1 AS idx, position FROM c WHERE a % 2 = 0 AND b % 2 = 0""")
def wf_halve(spark, sf_dir):
    """Positions of all-even configurations of the doubled circle of nations, in the base circle's order."""
    m = _count(spark, sf_dir, "nation")
    even = configs.multisets(spark, 2 * m, 2).where(F.forall("cfg", lambda p: p % 2 == 0)).select(F.col("idx").alias("position"), F.transform("cfg", lambda p: F.floor(p / 2)).alias("cfg"))
    return even.join(configs.multisets(spark, m, 2), "cfg").select("idx", "position")
