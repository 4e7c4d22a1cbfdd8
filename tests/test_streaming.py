import datetime
import json
import random
import time

from pyspark.sql import functions as F

from slackline.operators import workfunctions
from slackline.operators.configs import Context
from slackline.sources import bindings, metrics
from slackline.streaming import requests as streams

SF = "/root/testdata/sf0.001"


def test_running_work_functions_end_as_the_batch_does(spark, tmp_path):
    c = Context.of(2, metrics.circle_matrix(6))
    rows = bindings.requests(spark, SF, 6).select("user_id", "ts", "event_id", "r").where("event_id < 200")
    for part in range(2):  # two files in order of time
        rows.where(F.floor(F.col("event_id") / 100) == part).coalesce(1).write.parquet(str(tmp_path / f"in/{part}"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = streams.running(stream, c, (0, 1)).writeStream.format("memory").queryName("running").outputMode("update").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    last = {r["user_id"]: r for r in spark.sql("select * from running order by n").collect()}
    want = {r["user_id"]: r for r in workfunctions.replay(rows, c, (0, 1)).collect()}
    assert last.keys() == want.keys()
    for user, row in want.items():
        assert (last[user]["n"], last[user]["wf"]) == (row["n"], row["wf"])


def test_late_requests_are_folded_in_order(spark, tmp_path):
    """Rows come shuffled over five files; what is told last is what the batch gives, and earlier tellings are corrected."""
    c, rnd = Context.of(2, metrics.circle_matrix(6)), random.Random(3)
    start = datetime.datetime(2024, 1, 1)
    rows = [(rnd.randrange(4), start + datetime.timedelta(minutes=i), i, rnd.randrange(6)) for i in range(300)]
    schema = "user_id long, ts timestamp, event_id long, r long"
    shuffled = sorted(rows, key=lambda r: r[2] + rnd.randrange(100))  # up to a hundred minutes late
    for part in range(5):
        spark.createDataFrame(shuffled[part * 60 : part * 60 + 60], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{part}"))
        time.sleep(0.05)  # the source reads files in the order they were written
    before = {k: spark.conf.get(k) for k in streams.STORE}
    for k, v in streams.STORE.items():
        spark.conf.set(k, v)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = streams.ordered(stream, c, (0, 1), late="3 hours").writeStream.format("memory").queryName("ordered").outputMode("update").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
        for k, v in before.items():
            spark.conf.set(k, v)
    told = spark.sql("select * from ordered").collect()
    want = {r["user_id"]: r for r in workfunctions.replay(spark.createDataFrame(rows, schema), c, (0, 1)).collect()}
    for user, row in want.items():
        last = [r for r in told if r["user_id"] == user and r["n"] == row["n"]]
        assert last and all(list(r["wf"]) == list(row["wf"]) for r in last)
        assert min(r["open"] for r in last) < row["n"]  # the watermark has settled some
    assert max(r["n"] for r in told) < 300 and len(told) > 2 * len(want)


def test_violation_counts(spark, tmp_path):
    e = bindings.edges(spark, SF).join(bindings.read(spark, SF, "events").select(F.col("event_id").alias("edge_id"), F.col("ts").cast("timestamp").alias("ts")), "edge_id")
    e = e.select("ts", "d_min", "ext", "u_phi", "v_phi")
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = streams.violation_counts(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), 5).writeStream.format("memory").queryName("violations").outputMode("complete").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    total = spark.sql("select sum(edges), sum(violations) from violations").first()
    assert total[0] == e.count() and total[1] > 0


def test_event_log(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log/a.jsonl").write_text("\n".join(json.dumps({"ts": i, "event": "done", "candidate_id": i, "stage": "a"}) for i in range(3)))
    q = streams.event_log(spark, str(tmp_path / "log")).groupBy("stage").count().writeStream.format("memory").queryName("log").outputMode("complete").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert spark.sql("select count from log").first()[0] == 3
