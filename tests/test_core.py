import math
import random
import time
from itertools import combinations_with_replacement, permutations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from slackline.functions import arrays
from slackline.operators import configs, evaluate, potentials, ranking, search, workfunctions
from slackline.operators.configs import Context
from slackline.plans import control, evaluation, explore
from slackline.plans import search as plan_search
from slackline.plans.numbering import numbered
from slackline.sources import instances, metrics, npz


def brute_matching(d, a, b):
    return min(sum(d[x][b[i]] for x, i in zip(a, p)) for p in permutations(range(len(b))))


def test_metrics_reject_bad_input(spark):
    with pytest.raises(ValueError):
        metrics.circle(spark, 0)
    with pytest.raises(ValueError):
        metrics.antipode_extension(metrics.circle(spark, 3).where("a = 0"))
    with pytest.raises(ValueError):
        metrics.antipode_extension(metrics.circle(spark, 3).where("a > 9"))
    with pytest.raises(ValueError):
        metrics.antipode_extension(metrics.line(spark, 3).withColumn("d", F.col("d") - 1))


def test_metric_matrix(spark):
    assert metrics.matrix(metrics.circle(spark, 5)) == metrics.circle_matrix(5)


def test_continuous_circle_wraps_negatives(spark):
    rows = spark.createDataFrame([(-1.0, 1.0), (7.5, 0.5), (16.0, 0.0), (2.25, 6.25)], "a double, b double")
    got = [r[0] for r in rows.select(arrays.circle_distance_continuous(F.col("a"), F.col("b"), 8)).collect()]
    assert got == [2.0, 1.0, 0.0, 4.0]


@pytest.mark.parametrize(("n", "k"), [(4, 0), (0, 2), (3, 3), (5, 2)])
def test_multisets(spark, n, k):
    got = [tuple(r["cfg"]) for r in configs.multisets(spark, n, k).orderBy("idx").collect()]
    assert got == list(combinations_with_replacement(range(n), k))


def test_multisets_reject_negative_k(spark):
    with pytest.raises(ValueError):
        configs.multisets(spark, 3, -1)


def test_matching_and_updates_match_brute_force():
    rnd = random.Random(3)
    points = sorted(rnd.randrange(50) for _ in range(5))
    d = [[abs(a - b) for b in points] for a in points]
    c = Context.of(3, d)
    for _ in range(20):
        a, b = rnd.choice(c.configs), rnd.choice(c.configs)
        assert c.matching(a, b) == brute_matching(d, a, b)
    wf = c.initial(c.configs[3])
    after = c.update(wf, 4)
    for i, cfg in enumerate(c.configs):
        assert after[i] == min(wf[c.idx((*cfg[:j], 4, *cfg[j + 1 :]))] + d[cfg[j]][4] for j in range(3))


def test_ride_is_served_from_its_source():
    c = Context.of(2, metrics.circle_matrix(6))
    wf = c.initial((0, 3))
    after = c.ride(wf, 1, 4)
    served = {cfg: wf[c.idx(tuple(sorted((1, *[p for i, p in enumerate(cfg) if i != cfg.index(4)])))) ] + 3 for cfg in c.configs if 4 in cfg}
    for cfg, value in zip(c.configs, after):
        assert value == min(v + brute_matching(c.distances, cfg, at) for at, v in served.items())


def test_custom_order_is_validated():
    with pytest.raises(ValueError):
        Context.of(2, metrics.circle_matrix(3), order=[(0, 1)])
    with pytest.raises(ValueError):
        Context.of(2, metrics.circle_matrix(3), order=[(1, 0)])
    with pytest.raises(ValueError):
        Context.of(1, [[0, 0.5], [0.5, 0]])
    order = list(reversed(list(combinations_with_replacement(range(3), 2))))
    assert Context.of(2, metrics.circle_matrix(3), order=order).configs == order


def test_dense_and_sparse_work_functions_agree(spark):
    m, k, rnd = 6, 2, random.Random(5)
    c, table = Context.of(k, metrics.circle_matrix(m)), configs.multisets(spark, m, k)
    dist = lambda a, b: arrays.circle_distance(a, b, m)
    support = spark.createDataFrame([([0, 2], 0)], "cfg array<long>, value long")
    wf, seen = c.initial((0, 2)), {0, 2}
    for _ in range(2):
        r = rnd.randrange(m)
        support = workfunctions.update_support(support, r, sorted(seen), k, dist)
        wf, seen = c.update(wf, r), seen | {r}
    assert workfunctions.as_array(workfunctions.dense(support, table, k, dist)) == wf.tolist()
    ridden = workfunctions.ride_support(support, 1, 4, sorted(seen), k, dist, 3)
    assert workfunctions.as_array(workfunctions.dense(ridden, table, k, dist)) == c.ride(wf, 1, 4).tolist()


@pytest.fixture(scope="module")
def graph(spark):
    c = Context.of(3, metrics.circle_matrix(6))
    return explore.explore(spark, c, c.configs, explore.point_transitions(6))


def test_published_graph(graph):
    assert (graph.nodes.count(), graph.edges.count()) == (350, 2100)
    assert graph.edges.where("weight < 0").count() == 570
    assert {r["id"] for r in graph.nodes.select("id").collect()} == set(range(350))


def test_unifying_potential_has_no_violation_and_both_forms_agree(graph):
    p = potentials.Canonical(graph.context, 3, [[1, 2, 3], [-1, 2, 3], [-2, -2, 3], [-3, -3, -3]], [0, 0, 0])
    native = {r["id"]: (r["value"], r["a_id"]) for r in p.native(graph.nodes).collect()}
    arrow = {r["id"]: (r["value"], r["a_id"]) for r in graph.nodes.withColumn("p", p.arrow()(F.col("wf"))).select("id", "p.*").collect()}
    assert native == arrow
    wf = np.array(graph.nodes.where("id = 7").first()["wf"])
    assert native[7][0] == min(sum(int(wf[graph.context.idx([a[r - 1] if r > 0 else (a[-r - 1] + 3) % 6 for r in row])]) for row in p.index_matrix) for a in product(range(6), repeat=3))
    values = graph.nodes.sparkSession.createDataFrame([(i, v) for i, (v, _) in native.items()], "id long, v long")
    e = graph.edges.join(values.toDF("from", "pu"), "from").join(values.toDF("to", "pv"), "to")
    assert e.where("pv - pu + weight < 0").count() == 0


def test_unifying_rows():
    p = potentials.Canonical.unifying(Context.of(3, metrics.circle_matrix(4)))
    assert p.index_matrix == [[1, 2, 3], [-1, 2, 3], [-2, -2, 3], [-3, -3, -3]]


def test_rides_are_replayed_in_order(spark):
    c = Context.of(2, metrics.circle_matrix(6))
    rows = [(u, i, i, (u + i) % 3 * 2 + 1, i % 3 * 2) for u in range(3) for i in range(5)]
    df = spark.createDataFrame(rows, "user_id long, ts long, event_id long, s long, t long").orderBy(F.desc("event_id"))
    got = {r["user_id"]: r for r in workfunctions.replay(df, c, (0, 2), rides=("s", "t")).collect()}
    for u in range(3):
        wf = c.initial((0, 2))
        for _, _, _, s, t in sorted(r for r in rows if r[0] == u):
            wf = c.ride(wf, s, t)
        assert got[u]["wf"] == wf.tolist() and got[u]["n"] == 5


def test_shifting_a_work_function_shifts_the_potential_by_its_rows():
    c = Context.of(2, metrics.circle_matrix(4))
    p = potentials.Canonical(c, 2, [[1, 2], [-1, 2], [-2, -2]])
    wf = c.initial((0, 1))[None, :]
    assert (p.values(wf + 5).min() - p.values(wf).min()) == 15


def test_potential_parameters_are_checked():
    c = Context.of(2, metrics.circle_matrix(4))
    for bad in (dict(n=2, index_matrix=[[1, 2]]), dict(n=2, index_matrix=[[1]] * 3), dict(n=2, index_matrix=[[1, 2]] * 3, coefs=[1, 2])):
        with pytest.raises(ValueError):
            potentials.Canonical(c, **bad)
    with pytest.raises(ValueError):
        potentials.Evader(c, 1, [potentials.Stage(0, [(True, 1), (False, 1)])])


def test_reduced_evader_matches_its_definition():
    c = Context.of(2, metrics.circle_matrix(4))
    wf = c.update(c.initial((0, 1)), 3)
    d = c.distances
    best = min(
        wf[c.idx((a, b))] + min(wf[c.idx((x, b))] - d[x][a] for x in range(4)) + min(wf[c.idx((x, y))] - d[x][b] - d[y][b] for x in range(4) for y in range(4))
        for a in range(4) for b in range(4)
    )
    assert potentials.Evader.reduced(c)(wf)[0] == best


def test_bellman_is_feasible_and_symmetry_shrinks_the_graph(spark, graph):
    b = explore.bellman(graph.nodes, graph.edges)
    e = graph.edges.join(b.toDF("from", "bu"), "from").join(b.toDF("to", "bv"), "to")
    assert e.where("bv - bu + weight < 0").count() == 0
    c = Context.of(2, metrics.circle_matrix(4))
    whole = explore.explore(spark, c, c.configs, explore.point_transitions(4))
    folded = explore.explore(spark, c, c.configs, explore.point_transitions(4), symmetry_step=1)
    assert 0 < folded.nodes.count() < whole.nodes.count()
    rotated = explore.symmetries(c)
    some = np.array([r["wf"] for r in whole.nodes.collect()])
    for p in rotated:
        assert (explore.canonical(some[:, p], rotated) == explore.canonical(some, rotated)).all()


def test_rides_are_explored(spark):
    c = Context.of(2, metrics.circle_matrix(8))
    starts = [cfg for cfg in c.configs if all(p % 2 == 0 for p in cfg)]
    moves = explore.ride_transitions(4)
    assert len(moves) == 4 + 16
    g = explore.explore(spark, c, starts[:1], moves[:6])
    assert g.edges.count() == g.nodes.count() * 6
    assert workfunctions.halves(c) == [c.idx((2 * a, 2 * b)) for a, b in combinations_with_replacement(range(4), 2)]


def test_numbering(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    got = numbered(rows.repartition(7), ["x"], "at").collect()
    assert all(r["x"] == r["at"] for r in got) and len(got) == 1000


def test_instances_and_report(spark, graph, tmp_path):
    inst = instances.from_graph(graph)
    inst.save(str(tmp_path / "i"))
    again = instances.load(spark, str(tmp_path / "i"))
    assert again.k == 3 and again.distances == metrics.circle_matrix(6)
    found = evaluation.run(again, evaluation.zero, digits=4)
    m = found.metrics
    assert m["violations_k"] == 570 and m["violations_k_score"] == pytest.approx(1 - 570 / 2100) and m["total_nodes"] == 350
    assert m["bellman_edge_corr"] is None and m["opt_upper_bound"] == 0
    found.save(str(tmp_path / "r"))
    loaded = evaluation.Report.load(spark, str(tmp_path / "r"))
    assert loaded.metrics["violations_k"] == 570 and loaded.edges.count() == 2100
    assert evaluation.combined([m, m]) == pytest.approx((1 - 570 / 2100) ** 2)
    assert evaluation.combined([m | {"robustness": False}]) == 0
    assert evaluation.clean({"a": [math.inf, 1.0], "b": math.nan}) == {"a": [None, 1.0], "b": None}


def test_payloads(spark, tmp_path):
    payload = {"k": 1, "distance_matrix": [[0, 1], [1, 0]], "nodes": [{"id": 0, "depth": 0, "wf_norm": [0, 1]}, {"id": 1, "depth": 1, "wf_norm": [1, 0]}], "edges": [{"from": 0, "to": 1, "ext": 1, "d_min": 0, "weight": -1, "request": 1}]}
    inst = instances.from_payload(spark, payload | {"bellman": [0, 1], "edge_count": 1})
    assert inst.nodes.count() == 2 and inst.edges.first()["weight"] == -1
    with pytest.raises(KeyError):
        instances.from_payload(spark, {k: v for k, v in payload.items() if k != "edges"})
    with pytest.raises(ValueError):
        instances.from_payload(spark, payload | {"nodes": [payload["nodes"][1]]})
    np.savez_compressed(tmp_path / "x.npz", k=1, distance_matrix=np.array(payload["distance_matrix"]), node_id=[0, 1], node_depth=[0, 1], node_wf_norm=[[0, 1], [1, 0]], edge_from=[0], edge_to=[1], edge_ext=[1], edge_d_min=[0], edge_weight=[-1], bellman=[])
    again = instances.from_npz(spark, str(tmp_path / "x.npz"))
    assert again.nodes.where("bellman is null").count() == 2


def test_metrics_of_nothing_are_null(spark):
    e = spark.createDataFrame([], "from long, to long, d_min long, ext long, u_phi long, v_phi long")
    r = evaluate.report(e, 1, 4, renormalized=False).first()
    assert r["violations_k"] == 0 and r["violations_k_score"] is None and r["strong_hypothesis_rho"] is None


def test_unevaluated_ends_are_not_violations(spark):
    e = spark.createDataFrame([(0, 1, 0, 5, None, 0), (0, 1, 0, 5, 0, 0)], "from long, to long, d_min long, ext long, u_phi long, v_phi long")
    r = evaluate.report(e, 1, 4, renormalized=False).first()
    assert (r["violations_k"], r["unprocessed_normalized_edges"], r["processed_normalized_edges_score"]) == (1, 1, 0.5)


def test_average_ranks_across_blocks(spark):
    rows = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 1.0), (4, None)], "id long, x double")
    got = {r["id"]: r["rk"] for r in evaluate.average_ranks(rows, "x", "rk").collect()}
    assert got == {1: 2.5, 2: 2.5, 3: 1.0, 4: None}


def test_running_total_and_cut_off(spark):
    rows = spark.range(300).withColumn("hit", F.col("id") % 3 == 0)
    total = {r["id"]: r["t"] for r in ranking.running_total(rows, ["id"], F.col("id"), "t", block=16).collect()}
    assert all(v == i * (i + 1) // 2 for i, v in total.items())
    assert tuple(ranking.cut_off(rows, ["id"], F.col("hit"), 4).first()) == (13, 5)
    assert tuple(ranking.cut_off(rows, ["id"], F.col("hit"), 1000).first()) == (300, 100)


def test_empty_percentiles(spark):
    none = spark.createDataFrame([], "x double")
    assert tuple(none.agg(*ranking.percentiles("x", {"p50": 0.5})).first()) == (0.0,)


def test_estimates(spark):
    got = spark.createDataFrame([(5, 0.5), (5, 0.0)], "v long, s double").select(search.timed_estimate(F.col("v"), F.col("s")).alias("e")).collect()
    assert [r["e"] for r in got] == [10.0, math.inf]


def test_search_finds_the_known_potential(graph):
    p = potentials.Canonical(graph.context, 3, [[1, 2, 3], [-1, 2, 3], [-2, -2, 3], [-3, -3, -3]])
    family = plan_search.Climb([0, 0, 0], batch=3, rounds=1)
    best = plan_search.search(family, p, graph.nodes, graph.edges, 60)
    assert best[0] == (0, [0, 0, 0])
    fixed = plan_search.Fixed([[0, 0, 0], [5, 5, 5]])
    assert plan_search.search(fixed, p, graph.nodes, graph.edges, 60)[0] == (0, [0, 0, 0])
    sampled = plan_search.Sampling(graph.nodes.sparkSession, 3, batch=4, rounds=2)
    found = plan_search.search(sampled, p, graph.nodes, graph.edges, 60)
    assert found == sorted(found, key=lambda r: r[0]) and [v for v, _ in found] == plan_search.violations(p, graph.nodes, graph.edges, [c for _, c in found])


def test_mutations_follow_their_recipes(spark):
    parent = [2, -2, 1, 0, 0, 1, -1, 2]
    draws = [(i, f, parent) for i, f in enumerate(f for f in (*search.RECIPES, "of its own") for _ in range(60))]
    made = {r["draw_id"]: r for r in search.mutated(spark.createDataFrame(draws, "draw_id long, family string, coefs array<long>").repartition(3), frozen=2).collect()}
    assert len(made) == len(draws)
    seen = {}
    for i, f, _ in draws:
        c, recipe = made[i]["coefs"], search.RECIPES.get(f, search.OTHER)
        assert made[i]["family"] == f and c[:2] == [0, 0] and len(c) == 8
        changed = sum(a != b for a, b in zip(c[2:], parent[2:]))
        if f == "seed_sparse":
            assert 2 <= sum(x != 0 for x in c) <= 6 and max(map(abs, c)) <= 5
        elif f == "seed_peak5":
            assert sum(abs(x) == 5 for x in c) == 2 and all(abs(x) <= 2 for x in c if abs(x) != 5)
        elif f == "seed_dense":
            assert max(map(abs, c)) <= 2
        else:
            assert changed <= recipe.most and max(map(abs, c)) <= 2
        seen.setdefault(f, set()).add(tuple(c))
    assert all(len(x) > 10 for x in seen.values())
    again = search.mutated(spark.createDataFrame(draws[:5], "draw_id long, family string, coefs array<long>"), frozen=2).collect()
    assert all(made[r["draw_id"]]["coefs"] == r["coefs"] for r in again)


def test_parents_come_from_their_pools(spark):
    rows = [(i, [i, 0], i % 2, i % 7 if i % 2 == 0 else None, float(i) if i % 4 == 0 else None, i if i % 8 == 0 else None) for i in range(200)]
    known = spark.createDataFrame(rows, "candidate_id long, coefs array<long>, stage_a long, stage_b long, stage_c double, stage_d long")
    draws = spark.createDataFrame([(i, f) for i, f in enumerate(["mutate_full", "mutate_timed", "mutate_proxy", "mutate_ck4", "seed_dense"] * 40)], "draw_id long, family string")
    got = {}
    for r in search.parents(known, draws, 2).collect():
        got.setdefault(r["family"], set()).add(r["parent_id"])
        assert r["coefs"] == ([0, 0] if r["parent_id"] is None else [r["parent_id"], 0])
    assert got["seed_dense"] == {None}
    assert got["mutate_full"] <= set(range(0, 96, 8)) and len(got["mutate_full"]) > 6  # the best 12
    assert all(i % 4 == 0 for i in got["mutate_timed"]) and all(i % 2 == 0 for i in got["mutate_proxy"] | got["mutate_ck4"])
    empty = search.parents(known.where("false"), draws, 3).collect()
    assert {(r["parent_id"], tuple(r["coefs"])) for r in empty} == {(None, (0, 0, 0))}


def test_slow_tasks_are_cancelled_and_queued_again(graph):
    p, calls = potentials.Canonical(graph.context, 3, [[1, 2, 3], [-1, 2, 3], [-2, -2, 3], [-3, -3, -3]]), []
    spark = graph.nodes.sparkSession

    def score(batch):
        calls.append(batch)
        if len(calls) < 3:  # a job that doesn't end by itself
            spark.range(1 << 50, numPartitions=2).agg(F.sum(F.col("id") % 7)).collect()
        return [7 for _ in batch]

    family = plan_search.Fixed([[1, 0, 0]])
    began = time.monotonic()
    assert plan_search.search(family, p, graph.nodes, graph.edges, 60, task_seconds=1, score=score) == [(7, [1, 0, 0])]
    assert len(calls) == 3 and time.monotonic() - began < 40
    told = []
    family.left, family.tell, calls[:] = [[[2, 0, 0]]], lambda c, v: told.append((c, v)), []
    family.finalize = lambda: []
    assert plan_search.search(family, p, graph.nodes, graph.edges, 60, task_seconds=0.5, requeues=1, score=score) == []
    assert told == [([2, 0, 0], None)] and len(calls) == 2


def test_scans_stop_at_cutoffs_and_in_time(spark):
    tried = spark.range(5000).select(F.col("id").alias("edge_id"), (F.col("id") % 50 == 0).alias("hit")).cache()
    whole = plan_search.scan(tried)
    assert (whole.violations, whole.processed, whole.complete, whole.estimate) == (100, 5000, True, 100)
    cut = plan_search.scan(tried, cutoff=5)
    assert 5 < cut.violations < 40 and cut.processed < 1500 and not cut.complete and 60 < cut.estimate < 160
    assert plan_search.scan(tried, seconds=0).estimate == math.inf and not plan_search.scan(tried, seconds=0).complete
    assert plan_search.scan(tried.where("false")).complete


def test_staged_search_fills_stages_in_order(graph):
    spark, c = graph.nodes.sparkSession, graph.context
    p = potentials.Canonical(c, 3, [[1, 2, 3], [-1, 2, 3], [-2, -2, 3], [-3, -3, -3]])
    table = (graph.nodes, graph.edges)
    loose = {"stage_a": 2000, "stage_b": 2000}
    rows = plan_search.staged(p, table, p, table, ["seed_sparse", "seed_dense", "mutate_full"], rounds=2, batch=3, full=1, most=loose).collect()
    assert len({tuple(r["coefs"]) for r in rows}) == len(rows) > 2
    true = dict(zip([r["candidate_id"] for r in rows], plan_search.violations(p, *table, [r["coefs"] for r in rows])))
    done = [r for r in rows if r["stage_d"] is not None]
    assert 1 <= len(done) <= 2
    for r in rows:
        assert r["stage_a"] == true[r["candidate_id"]] and r["stage_d"] in (None, r["stage_a"])
        assert (r["stage_c"] is None) <= (r["stage_d"] is None)
    strict = plan_search.staged(p, table, p, table, ["seed_sparse"], rounds=1, batch=2).collect()
    assert all((r["stage_b"] is None) == (r["stage_a"] > 0) for r in strict)


def test_paths_replay_to_their_nodes_and_violations_are_found_on_the_way(spark):
    c = Context.of(2, metrics.circle_matrix(5))
    told = []
    g = explore.explore(spark, c, c.configs, explore.point_transitions(5), potential=arrays.total, hook=lambda e, f: told.append((e, f)))
    assert g.complete and [f["nodes"] for e, f in told if e == "level"] == g.levels and told[-1][0] == "done"
    nodes = g.nodes.collect()

    def replay(path):
        w = c.initial(c.configs[path[0]])
        for r in path[1:]:
            w = c.update(w - w.min(), r)
        return (w - w.min()).tolist()

    assert all(replay(r["path"]) == r["wf"] and len(r["path"]) == r["depth"] + 1 for r in nodes)
    phi = {r["id"]: sum(r["wf"]) for r in nodes}
    path = {r["id"]: r["path"] for r in nodes}
    want = sorted((path[e["from"]], e["request"], phi[e["to"]] - phi[e["from"]] + e["weight"]) for e in g.edges.collect() if phi[e["to"]] - phi[e["from"]] + e["weight"] < 0)
    assert sorted((list(r["path"]), r["request"], int(r["slack"])) for r in g.violations.collect()) == want and want
    early = explore.explore(spark, c, c.configs, explore.point_transitions(5), potential=arrays.total, stop_after=0)
    assert not early.complete and 0 < early.violations.count() < len(want) and len(early.levels) < len(g.levels)


@pytest.mark.parametrize("leading", [64, 2])
def test_the_least_image_of_every_row(monkeypatch, leading):
    monkeypatch.setattr(explore, "LEADING", leading)
    c = Context.of(2, metrics.circle_matrix(6))
    perms = explore.symmetries(c, 2)
    rng = np.random.default_rng(1)
    wfs = np.concatenate([rng.integers(0, 3, (200, len(c.configs))), np.zeros((2, len(c.configs)), np.int64), np.array([c.initial(x) for x in c.configs])])
    assert explore.canonical(wfs, perms).tolist() == [min(w[p].tolist() for p in perms) for w in wfs]


def test_symmetry_follows_the_kind_of_moves(spark):
    assert explore.symmetry_step_of(explore.ride_transitions(2)) == 2 and explore.symmetry_step_of(explore.point_transitions(2)) == 1
    c = Context.of(2, metrics.circle_matrix(6))
    plain = explore.explore(spark, c, c.configs, explore.point_transitions(6))
    classes = explore.explore(spark, c, c.configs, explore.point_transitions(6), symmetry_step="auto")
    assert 0 < classes.nodes.count() < plain.nodes.count()


def test_control(tmp_path):
    (tmp_path / "p.py").write_text("class A:\n    class B:\n        x = 3\n")
    assert control.load_symbol(str(tmp_path / "p.py"), "A.B").x == 3
    (tmp_path / "k.json").write_text('{"n": 2}')
    assert control.parameters(str(tmp_path / "k.json")) == control.parameters('{"n": 2}') == {"n": 2}
    assert control.public({"kwargs": {"a": 1, "_b": 2}}) == {"a": 1} and control.public({"c": 1, "_d": 2}) == {"c": 1}
    assert control.selection("3,5,10-12,5") == [3, 5, 10, 11, 12]
    assert control.small_enough({"a": 1}) and not control.small_enough({"a": "x" * 60_000})
    assert control.stage_c_seconds(0) == 30 and control.stage_c_seconds(5) == 10 and control.budget(4, 10, 5) == 8
    assert control.candidate(["sh", "-c", "echo hi"], 10) == (0, "hi\n", "")
    assert control.candidate(["sh", "-c", "trap '' TERM; sleep 30"], 0.2, 0.2)[0] is None


def test_helpers_of_a_run(tmp_path):
    (tmp_path / "p.py").write_text("x = 1\n")
    at = str(tmp_path / "p.py")
    assert control.cached_symbol(at, "x") == 1
    (tmp_path / "p.py").write_text("x = 20\n")
    assert control.cached_symbol(at, "x") == 20
    found, errors = control.instance_paths(["p.py", at, "q.py"], [str(tmp_path)])
    assert found == [at, at] and len(errors) == 1 and "q.py" in errors[0]
    assert control.supported({"a": 1, "b": None, "c": 2}, lambda a, b: 0) == {"a": 1} and control.supported({"c": 2}, lambda **k: 0) == {"c": 2}
    timer = control.Timer()
    for _ in range(2):
        with timer("a"):
            time.sleep(0.02)
    assert timer.seconds["a"] >= 0.04
    made = []

    def attempt(i):
        made.append(i)
        if i == 1 or i == 2 and made.count(2) < 2:
            raise ValueError(i)
        return [0.5, 0, 0.9, 0.9][i]

    log = str(tmp_path / "log")
    assert control.best_of(4, attempt, log) == (2, 0.9) and made == [0, 1, 1, 1, 2, 2, 3]
    assert control.best_of(4, attempt, log, retries=0) == (2, 0.9) and made[7:] == [1]  # only what has no score
    assert control.best_of(1, lambda i: 1 / 0, str(tmp_path / "none")) is None
    assert control.candidate(["sh", "-c", "while :; do :; done"], 30, 5, cpu_seconds=1)[0] != 0


def test_partial_evaluation_in_time(spark, graph):
    inst = instances.from_graph(graph)
    none = evaluation.run(inst, evaluation.total, seconds=0).metrics
    assert none["violations_k"] == 0 and none["unprocessed_normalized_edges"] == none["total_edges"] == 2100 and none["violations_k_score"] is None
    whole, timed = evaluation.run(inst, evaluation.total).metrics, evaluation.run(inst, evaluation.total, seconds=600).metrics
    assert {k: v for k, v in whole.items() if k != "times"} == {k: v for k, v in timed.items() if k != "times"}
    assert whole["times"].keys() >= {"potential", "edges", "report", "nodes", "fingerprint"}
    blocks = []

    def slow(wf):  # ends after some blocks: the third one takes as long as it may
        blocks.append(1)
        return evaluation.total(wf) if len(blocks) < 3 else F.expr("(SELECT sum(id % 7) FROM range(1125899906842624))").cast("long") + evaluation.total(wf)

    part = potentials.within(graph.nodes, slow, 8, blocks=8).select("wf", "phi").collect()
    done = [r for r in part if r["phi"] is not None]
    assert 0 < len(done) < len(part) == 350 and all(r["phi"] == sum(r["wf"]) for r in done)


def test_the_potential_for_three_servers(spark):
    c = Context.of(3, metrics.circle_matrix(8))
    p = potentials.Canonical.three(c)
    assert p.index_matrix == [[-4, -4, -4], [4, 1, -2], [4, 2, -3], [4, 3, -1]] and p.coefs == [1, 1, 0, 1, 0, 0]
    with pytest.raises(ValueError):
        potentials.Canonical.three(Context.of(2, metrics.circle_matrix(4)))


def test_compressed_instances_stream_both_ways(spark, graph, tmp_path, monkeypatch):
    monkeypatch.setattr(npz, "NPZ_ROWS", 100)
    monkeypatch.setattr(npz, "NPZ_NUMBERS", 700)
    inst = instances.from_graph(graph)
    path = str(tmp_path / "i.npz")
    instances.to_npz(inst, path)
    with np.load(path) as z:
        assert z["node_wf_norm"].shape == (350, 56) and z["edge_from"].shape == (2100,) and int(z["k"]) == 3 and "bellman" not in z
    again = instances.from_npz(spark, path)
    assert again.nodes.schema.simpleString() == inst.nodes.schema.simpleString() and again.k == 3 and again.distances == inst.distances
    key = lambda df, *c: sorted(map(tuple, df.select(*c).collect()))
    assert key(again.nodes, "id", "depth", "wf") == key(inst.nodes, "id", "depth", "wf")
    assert [r[1:] for r in key(again.edges, "edge_id", "from", "to", "d_min", "ext", "weight")] == [r[1:] for r in key(inst.edges, "edge_id", "from", "to", "d_min", "ext", "weight")]
    known = instances.Instance(inst.k, inst.distances, inst.nodes.withColumn("bellman", F.col("id").cast("double")), inst.edges)
    instances.to_npz(known, path)
    assert key(instances.from_npz(spark, path).nodes, "id", "bellman")[7] == (7, 7.0)


def test_shared_arrays_are_bounded(spark, graph):
    found = instances.Shared.of(spark, {"a": instances.from_graph(graph)}, {"x": np.arange(10)})
    sent = found.arrays["x"]
    assert found.instances["a"].k == 3 and found.array("x").sum() == 45

    def added(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([int(sent.value[i]) for i in b.column(0).to_pylist()])], ["x"])

    assert spark.range(10).mapInArrow(added, "x long").agg(F.sum("x")).first()[0] == 45
    with pytest.raises(ValueError):
        instances.Shared.of(spark, {}, {"x": np.arange(10)}, most=79)


def test_fingerprints_are_trees(spark):
    rows = spark.range(300).select(F.col("id").alias("edge_id"), F.lit(0).cast("long").alias("u_phi"), (F.col("id") * 3).alias("v_phi"))
    deep, flat = (evaluate.fingerprint(rows, b).first()[0] for b in (4, 4096))
    assert deep and flat and deep != flat and evaluate.fingerprint(rows.repartition(7), 4).first()[0] == deep
    assert evaluate.fingerprint(rows.withColumn("v_phi", F.col("v_phi") + (F.col("edge_id") == 299).cast("long")), 4).first()[0] != deep
    assert evaluate.fingerprint(rows.where("false")).first()[0] is None


def test_sparse_potentials_on_half_steps(spark):
    """The canonical potential of a sparse work function, taken at half steps, is that of the dense one on a doubled circle."""
    m, k = 4, 2
    c = Context.of(k, metrics.circle_matrix(2 * m))
    support = [((0, 2), 0), ((4, 6), 1)]  # doubled points
    dense = np.array([min(v + c.matching(s, x) for s, v in support) for x in c.configs], np.int64)
    p = potentials.Canonical.unifying(c)
    got = (p.values(dense[None, :]) - p.penalties()).min()
    best = math.inf
    for points in product([i / 2 for i in range(2 * m)], repeat=k):
        total = 0
        for row in p.index_matrix:
            at = [points[abs(i) - 1] if i > 0 else (points[abs(i) - 1] + m / 2) % m for i in row]
            d = lambda a, b: min(abs(a - b), m - abs(a - b))
            total += min(v / 2 + min(sum(d(s[j] / 2, x) for j, x in enumerate(q)) for q in permutations(at)) for s, v in support)
        best = min(best, total)
    assert got == 2 * best


def test_plans_stay_in_shape(spark):
    from slackline.sources import bindings

    plan = bindings.links(spark, "/root/testdata/sf0.001").select("edge_id", "from")._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint>" in plan  # pruned to what is used
    report = bindings.edges(spark, "/root/testdata/sf0.001").agg(*evaluate.violations(1))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in report and "BatchEvalPython" not in report
