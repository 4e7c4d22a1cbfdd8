"""Stages at once: overlap, queues, limits, results as in serial order, logs to go on from."""

import random
import threading
import time

import pytest

from slackline.operators import potentials
from slackline.operators.configs import Context
from slackline.plans import explore, search, stages
from slackline.sources import metrics


class Slow:
    """Stages that take their time and no cluster; values follow from the coefficients."""

    def __init__(self, seconds=0.05, fail_after=None):
        self.seconds, self.calls, self.fail_after, self.lock = seconds, [], fail_after, threading.Lock()

    def _work(self, stage, batch):
        with self.lock:
            if self.fail_after is not None and len(self.calls) >= self.fail_after:
                raise RuntimeError("killed")
            self.calls.append((stage, tuple(batch)))
        time.sleep(self.seconds)

    def value(self, stage, c):
        return random.Random(f"{stage}{c}").randrange(7)

    def a(self, batch):
        self._work("a", batch)
        return {i: 0 if sum(c) % 3 else 4 for i, c in batch.items()}

    def b(self, batch):
        self._work("b", batch)
        return {i: self.value("b", c) for i, c in batch.items()}

    def c(self, batch, b):
        self._work("c", batch)
        return {i: float(self.value("c", c) + b[i]) for i, c in batch.items()}

    def d(self, batch):
        self._work("d", batch)
        return {i: self.value("d", c) for i, c in batch.items()}


def listed(n):
    """Proposals from a list, told by how many are known."""
    return lambda records, room: [[i, i * i] for i in range(len(records), min(n, len(records) + room))] or None


def plain(records):
    return {tuple(r["coefs"]): tuple(r.get(s) for s in stages.NAMES) for r in records.values()}


def in_turn(slow, n, most):
    out = {}
    for i in range(n):
        c = [i, i * i]
        a = slow.a({0: c})[0]
        b = slow.b({0: c})[0] if a <= most["stage_a"] else None
        far = b is not None and b <= most["stage_b"]
        out[tuple(c)] = (a, b, slow.c({0: c}, {0: b})[0] if far else None, slow.d({0: c})[0] if far else None)
    return out


def test_stages_overlap_and_give_what_they_give_in_turn(spark):
    slow, wide = Slow(), dict.fromkeys(stages.NAMES, 1000)
    p = stages.Pipeline(spark, slow, listed(60), capacity=wide, batch={"a": 4, "b": 3, "c": 2, "d": 1})
    began = time.monotonic()
    found = p.run()
    took = time.monotonic() - began
    assert plain(found) == in_turn(Slow(0), 60, p.most)
    assert took < 0.8 * sum(end - begin for _, begin, end, _ in p.worked)
    pairs = {(s, t) for s, b1, e1, _ in p.worked for t, b2, e2, _ in p.worked if s < t and b1 < e2 and b2 < e1}
    assert {("a", "b"), ("b", "c"), ("c", "d")} <= pairs
    assert all(len(ids) <= p.batch[s] for s, *_, ids in p.worked)


def test_full_queues_drop_their_worst_and_hold_proposals_back(spark):
    slow, asked = Slow(0.02), []

    def propose(records, room):
        asked.append((len(records), room))
        return listed(80)(records, room)

    p = stages.Pipeline(spark, slow, propose, capacity={"a": 5, "b": 2, "c": 2, "d": 1}, batch={"a": 5, "b": 1, "c": 1, "d": 1})
    found = p.run()
    assert len(found) == 80 and all(room <= 5 for _, room in asked) and len(asked) > 10
    dropped = [r for r in found.values() if "dropped" in r]
    assert dropped and all(r.get(stages.NAMES[int(r["dropped"])]) is None for r in dropped)
    serial = in_turn(Slow(0), 80, p.most)
    assert all(x is None or x == y for c, row in plain(found).items() for x, y in zip(row, serial[c]))
    q = stages.Waiting(2)
    assert [q.put(k, i) for i, k in enumerate([(5,), (3,), (4,), (9,)])] == [None, None, 0, 3] and q.take(9) == [1, 2]


def test_what_runs_when_time_is_up_is_cancelled(spark):
    class Endless(Slow):
        def b(self, batch):
            spark.range(1 << 50, numPartitions=2).selectExpr("sum(id % 7)").collect()

    began = time.monotonic()
    found = stages.Pipeline(spark, Endless(0.01), listed(9)).run(seconds=2)
    assert time.monotonic() - began < 20 and all(r.get("a") is not None and r.get("b") is None for r in found.values())


@pytest.mark.parametrize("killed_after", [3, 9])
def test_a_killed_run_goes_on(spark, tmp_path, killed_after):
    path, wide = str(tmp_path / "log"), dict.fromkeys(stages.NAMES, 1000)
    batch = {"a": 4, "b": 3, "c": 2, "d": 1}
    first = Slow(0.01, fail_after=killed_after)
    with pytest.raises(RuntimeError, match="killed"):
        stages.Pipeline(spark, first, listed(20), capacity=wide, batch=batch, log=stages.Log(spark, path), snapshot_seconds=0.1).run()
    second = Slow(0.01)
    p = stages.Pipeline(spark, second, listed(20), capacity=wide, batch=batch, log=stages.Log(spark, path), snapshot_seconds=0.1)
    logged = {(s, i) for i, r in p.records.items() for s in stages.NAMES if s in r}
    assert logged
    assert plain(p.run()) == in_turn(Slow(0), 20, p.most)
    assert not logged & {(s, i) for s, ids in second.calls for i in ids}  # nothing that was done is done again
    whole = stages.Log(spark, path)
    assert plain(whole.replay()) == plain(p.records) and whole.seq > 0


def test_stages_on_a_graph(spark):
    c = Context.of(3, metrics.circle_matrix(6))
    g = explore.explore(spark, c, c.configs, explore.point_transitions(6))
    p = potentials.Canonical(c, 3, [[1, 2, 3], [-1, 2, 3], [-2, -2, 3], [-3, -3, -3]])
    vectors = [[0, 0, 0], [1, 0, 0], [0, -1, 1], [2, 2, 2]]
    scores = stages.Scores(p, (g.nodes, g.edges), p, (g.nodes, g.edges), share=0.3)
    scores.cache(g.edges.where("edge_id % 3 = 0"))
    found = stages.Pipeline(spark, scores, lambda records, room: vectors if not records else None, most={"stage_a": 2000, "stage_b": 2000}).run()
    true = search.violations(p, g.nodes, g.edges, vectors)
    near = search.violations(p, g.nodes, g.edges.where("edge_id % 3 = 0"), vectors)
    part = search.violations(p, g.nodes, scores.sample, vectors)
    n = scores.sample.count()
    assert [tuple(found[i][s] for s in ("a", "b", "d")) for i in range(4)] == [(t, b, t) for t, b in zip(true, near)]
    assert all(abs(found[i]["c"] - part[i] * 2100 / n) < 1e-9 for i in range(4))
