"""Steps that grow with the tables: what they shuffle, write and hold."""

from itertools import combinations_with_replacement

import pytest
from pyspark.sql import functions as F

from slackline.functions import arrays
from slackline.operators import configs, workfunctions
from slackline.operators.configs import Context
from slackline.sources import metrics


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("n", "k"), [(30, 2), (10, 5), (7, 1), (1, 4), (3, 0), (0, 2)])
def test_multisets_are_numbered_without_a_sort(spark, monkeypatch, n, k):
    monkeypatch.setattr(configs, "ROWS", 20)
    df = configs.multisets(spark, n, k)
    assert not any(step in plan(df) for step in ("Window", "Exchange", "Sort"))
    assert sorted((r["idx"], tuple(r["cfg"])) for r in df.collect()) == list(enumerate(combinations_with_replacement(range(n), k)))


def test_multisets_of_many_points_come_from_even_tasks(spark, monkeypatch):
    monkeypatch.setattr(configs, "ROWS", 10_000)
    sizes = configs.multisets(spark, 600, 2).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == 180_300 and len(sizes) == 19 and max(sizes) < 12_000


@pytest.mark.parametrize("m", [1, 8, 9, 33])
def test_tiles_hold_all_pairs_once(spark, monkeypatch, m):
    monkeypatch.setattr(metrics, "BLOCK", 4)
    monkeypatch.setattr(metrics, "RUN", 10)
    assert sorted(map(tuple, metrics.line(spark, m).collect())) == [(a, b, abs(a - b)) for a in range(m) for b in range(m)]


@pytest.mark.parametrize(("metric", "most"), [(metrics.line, 0.6), (metrics.circle, 0.6), (metrics.uniform, 0.2)])
def test_metrics_are_written_in_a_fraction_of_a_byte_a_row(spark, tmp_path, metric, most):
    metric(spark, 2_000).write.parquet(str(tmp_path / "metric"))
    assert sum(f.stat().st_size for f in (tmp_path / "metric").glob("*.parquet")) < 2_000**2 * most


def test_tiles_are_gone_through_by_number(spark):
    """An explode holds all rows of its input row, and a tile's chain of them ran out of memory at 20,000 points."""
    df = metrics.circle(spark, 2_000)
    assert not any(step in plan(df) for step in ("Generate", "Exchange", "Sort"))
    sizes = df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == 2_000**2 and max(sizes) <= metrics.BLOCK * 2_000


def test_tiles_have_few_values_whatever_the_points(spark):
    """Of up to 65,536 points a tile, codes of b and d are looked up slower and take more bits."""
    tile = metrics.line(spark, 20_000).where(F.spark_partition_id() == 0)
    assert max(tile.agg(F.count_distinct("b"), F.count_distinct("d")).first()) < 10_000


def test_cycles_fill_whole_runs_of_packed_codes(spark, tmp_path):
    """A cycle of 512 points comes 504 and 8 to a run, which took uniform 0.127 bytes a row."""
    metrics.uniform(spark, 2_000).write.parquet(str(tmp_path / "metric"))
    assert sum(f.stat().st_size for f in (tmp_path / "metric").glob("*.parquet")) < 2_000**2 * 0.12


def test_bytes_a_row_do_not_rise_with_the_points(spark, tmp_path):
    """Row by row, points b took 0.28 bytes a row at 2,000 points and 4.01 at 20,000."""
    rates = []
    for m in (1_000, 4_000):
        metrics.uniform(spark, m).write.parquet(str(tmp_path / str(m)))
        rates.append(sum(f.stat().st_size for f in (tmp_path / str(m)).glob("*.parquet")) / m**2)
    assert rates[1] < rates[0] * 1.05


@pytest.mark.parametrize("metric", [metrics.line, metrics.circle, metrics.uniform])
def test_metrics_are_never_null(spark, metric):
    assert not any(f.nullable for f in metric(spark, 9).schema)


def test_updates_shuffle_nothing_of_the_size_of_work_functions(spark):
    c, d = configs.multisets(spark, 6, 3), metrics.circle(spark, 6)
    moves = configs.moves(c, d, 3)
    context = Context.of(3, metrics.circle_matrix(6))
    rows = [(i, [i % 6, i // 6 % 6, i // 36 % 6], i % 6, i % 5) for i in range(216)]
    starts = spark.createDataFrame(rows, "of long, start array<long>, r long, t long")
    first = workfunctions.initial_arrays(c, starts, lambda a, b: arrays.circle_distance(a, b, 6))
    served = workfunctions.update(workfunctions.update(first, moves, "r"), moves, "t")
    ridden = workfunctions.ride(first.withColumnRenamed("r", "s"), moves, c, d)
    for df in (served, ridden):
        top = plan(df).split("BroadcastExchange")[0]
        assert "Exchange" not in top and "Aggregate" not in top
    served, ridden = ({r["of"]: r["wf"] for r in df.collect()} for df in (served, ridden))
    for of, start, r, t in rows:
        wf = context.initial(start)
        assert served[of] == context.update(context.update(wf, r), t).tolist()
        assert ridden[of] == context.ride(wf, r, t).tolist()
