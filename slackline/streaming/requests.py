"""Streams of requests and edges.

``running`` keeps each key's work function as state and emits it after every batch; requests of one batch are put in
order by time and id. ``ordered`` folds in the order of time whatever the order of arrival: requests stay open until the
watermark has passed them, and what late ones change is told again. ``violation_counts`` counts violated edges by event-time windows behind a watermark.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from slackline.operators import evaluate
from slackline.operators.configs import Context

OUTPUT = "user_id long, n long, wf array<long>"


def running(requests: DataFrame, context: Context, start) -> DataFrame:
    """user_id, n, wf: of a stream (user_id, ts, event_id, r), the work function after all requests so far."""
    first = context.initial(start)

    def served(key, batches, state: GroupState):
        import numpy as np

        n, wf = state.get if state.exists else (0, first.tolist())
        wf = np.array(wf, np.int64)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for r in rows["r"].tolist():
            wf = context.update(wf, r)
        n += len(rows)
        state.update((n, wf.tolist()))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "wf": [wf.tolist()]})

    return requests.groupBy("user_id").applyInPandasWithState(served, OUTPUT, "n long, wf array<long>", "update", GroupStateTimeout.NoTimeout)


#: ``ordered`` needs a state store that holds lists and timers.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class _Ordered(StatefulProcessor):
    """By key: the work function of all requests that the watermark has passed, and those still open, as a list."""

    def __init__(self, context: Context, first):
        self.context, self.first = context, first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", "n long, wf array<long>")
        self.open = handle.getListState("open", "moment long, event_id long, r long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        for batch in rows:
            moments = (batch["ts"].astype("int64") // self._unit(batch["ts"])).tolist()
            self.open.appendList([(m, int(e), int(r)) for m, e, r in zip(moments, batch["event_id"].tolist(), batch["r"].tolist())])
        yield self._told(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        yield self._told(key, timerValues.getCurrentWatermarkInMs())

    @staticmethod
    def _unit(ts) -> int:
        """Of what the column counts, in a millisecond."""
        return {"ns": 1_000_000, "us": 1_000, "ms": 1}[ts.dt.unit]

    def _told(self, key, watermark: int) -> pd.DataFrame:
        """Settles what the watermark has passed, waits for the rest, and gives the work function after all."""
        import numpy as np

        n, wf = self.settled.get() if self.settled.exists() else (0, self.first)
        wf, waiting = np.array(wf, np.int64), sorted(tuple(x) for x in self.open.get()) if self.open.exists() else []
        done = [x for x in waiting if x[0] < watermark]
        for *_, r in done:
            wf = self.context.update(wf, r)
        n += len(done)
        later = waiting[len(done) :]
        if done:
            self.settled.update((n, wf.tolist()))
            if later:
                self.open.put(later)
            else:
                self.open.clear()
        if later:
            self.handle.registerTimer(later[0][0] + 1)
        for *_, r in later:
            wf = self.context.update(wf, r)
        return pd.DataFrame({"user_id": [key[0]], "n": [n + len(later)], "open": [len(later)], "wf": [wf.tolist()]})


def ordered(requests: DataFrame, context: Context, start, late: str = "1 hour") -> DataFrame:
    """user_id, n, open, wf: of a stream (user_id, ts, event_id, r), the work function of all requests so far in order of ts and event_id.

    A key's row is given again whenever requests come or the watermark passes some; ``open`` of its ``n`` requests could still be
    preceded. Requests more than ``late`` behind are dropped, as by any watermark. State grows with open requests alone. Set ``STORE``.
    """
    kept = requests.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "r").withWatermark("ts", late)
    return kept.groupBy("user_id").transformWithStateInPandas(_Ordered(context, context.initial(start).tolist()), "user_id long, n long, open long, wf array<long>", "update", "eventtime")


def violation_counts(edges: DataFrame, rho: float, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """start, edges, violations of evaluated edges (ts, d_min, ext, u_phi, v_phi); later ones than ``late`` don't count."""
    short = evaluate.slack(rho) < 0
    counted = edges.withWatermark("ts", late).groupBy(F.window("ts", window)).agg(F.count("*").alias("edges"), F.count_if(short).alias("violations"))
    return counted.select(F.col("window.start").alias("start"), "edges", "violations")


def event_log(spark, path: str) -> DataFrame:
    """A stream of appended JSON lines: ts, event, candidate_id, stage, value."""
    return spark.readStream.schema("ts double, event string, candidate_id long, stage string, value double").json(path)
