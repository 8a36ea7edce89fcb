"""Stateful operators: batch forms against loops, streaming forms against batch forms."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidepool.streaming import state

T0 = dt.datetime(2026, 1, 1)


def log(spark, rows):
    data = [(i, T0 + dt.timedelta(seconds=s), k, v) for i, (s, k, v) in enumerate(rows)]
    return spark.createDataFrame(data, "event_id long, ts timestamp_ntz, user_id string, request_hash string")


def test_rate_limit(spark):
    df = log(spark, [(10.5, "u", ""), (10.5, "u", ""), (10.5, "u", ""), (60.1, "u", "")])
    out = [(r["allowed"], r["remaining"], r["retry_after"]) for r in state.rate_limit(df, ["user_id"], 2, 60).orderBy("event_id").collect()]
    assert out == [(True, 1, 49), (True, 0, 49), (False, 0, 49), (True, 1, 59)]


def test_rate_limit_stream_decides_alike(spark, tmp_path):
    rng = random.Random(2)
    rows = sorted((rng.uniform(0, 300), rng.choice("ab"), "") for _ in range(60))
    log(spark, rows).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log(spark, rows).schema).parquet(str(tmp_path / "in"))
    decided = state.rate_limit_stream(stream, "user_id", 3, 60)
    q = decided.writeStream.format("memory").queryName("decided").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["event_id"]: (r["allowed"], r["remaining"], r["retry_after"]) for r in spark.table("decided").collect()}
    want = {r["event_id"]: (r["allowed"], r["remaining"], r["retry_after"]) for r in state.rate_limit(log(spark, rows), ["user_id"], 3, 60).collect()}
    assert got == want


def test_idempotency_equals_a_loop(spark):
    rng = random.Random(4)
    rows = sorted((rng.uniform(0, 4 * 86400), rng.choice("ab"), rng.choice("xy")) for _ in range(80))
    out = {r["event_id"]: r["outcome"] for r in state.idempotency(log(spark, rows), ["user_id"]).collect()}
    opened = {}
    for i, (s, k, h) in enumerate(rows):
        at = (T0 + dt.timedelta(seconds=s)).timestamp()
        if k not in opened or at >= opened[k][0] + 86400:
            opened[k], want = (at, h), "new"
        else:
            want = "replay" if opened[k][1] == h else "conflict"
        assert out[i] == want


def test_first_requests_stream(spark, tmp_path):
    df = log(spark, [(1, "a", "x"), (2, "a", "x"), (3, "b", "x")])
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = state.first_requests_stream(stream, ["user_id"]).writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("firsts").count() == 2


def test_queue(spark):
    jobs = spark.createDataFrame([
        (1, "running", 1, T0, None, T0, T0), (2, "running", 3, T0, None, T0, T0), (3, "running", 1, T0 + dt.timedelta(seconds=590), None, T0, T0),
        (4, "pending", 0, None, None, T0, T0), (5, "pending", 0, None, None, T0 + dt.timedelta(days=1), T0),
    ], "job_id long, state string, attempts int, locked_at timestamp, error string, available_at timestamp, created_at timestamp")
    now = F.lit(T0 + dt.timedelta(seconds=600))
    out = {r["job_id"]: (r["state"], r["error"], r["delay"]) for r in state.reclaim(jobs, now).collect()}
    assert out[1] == ("failed", "WORKER_LEASE_EXPIRED", 5) and out[2] == ("dead_letter", "WORKER_LEASE_EXPIRED", None) and out[3] == ("running", None, None)
    assert [r["job_id"] for r in state.next_jobs(jobs, now).collect()] == [4]


@pytest.mark.parametrize("attempt, seconds", [(1, 5), (2, 10), (5, 80), (20, 300)])
def test_backoff(spark, attempt, seconds):
    assert spark.range(1).select(state.backoff(F.lit(attempt))).first()[0] == seconds


def test_upserts_by_foreach_batch_touch_few_buckets(spark, tmp_path):
    src, path = str(tmp_path / "in"), str(tmp_path / "out")
    (tmp_path / "in").mkdir()
    schema = "run_id long, sequence long, stage string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    apply = state.merge_into(path, ["run_id"], [F.desc("sequence")], buckets=8)
    rng, want = random.Random(3), {}
    batches = [[(i, 1, "a") for i in range(100)], [(7, 2, "b")], [(7, 1, "late"), (200, 5, "new")], [(rng.randrange(100), 9, "c") for _ in range(3)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        q = stream.writeStream.foreachBatch(apply).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        for i, n, v in rows:
            if n >= want.get(i, (0,))[0]:
                want[i] = (n, v)
        assert {r["run_id"]: (r["sequence"], r["stage"]) for r in state.bucketed(path, spark).collect()} == want
    written = [len(list((tmp_path / "out" / "data" / f"batch={i}").glob("bucket=*"))) for i in range(4)]
    assert written[0] == 8 and written[1] == 1 and written[2] <= 2 and written[3] <= 3  # only what holds the batch's keys
    again = spark.createDataFrame(batches[1], schema)
    apply(again, 1)  # a batch that runs twice changes nothing
    assert {r["run_id"]: (r["sequence"], r["stage"]) for r in state.bucketed(path, spark).collect()} == want
    assert state.bucketed(str(tmp_path / "none"), spark) is None


def test_windows_stream(spark, tmp_path):
    df = log(spark, [(5, "a", ""), (65, "a", ""), (4000, "a", "")])
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = state.windowed_counts(stream, ["user_id"], "1 minute", late="1 minute").writeStream.format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("windows").count() == 2  # the last window stays open


def test_small_state_operators(spark):
    old = spark.createDataFrame([(1, "x"), (2, "y")], "document_id long, v string")
    new = spark.createDataFrame([(2, "z")], "document_id long, v string")
    assert {tuple(r) for r in state.replaced(old, new).collect()} == {(1, "x"), (2, "z")}
    kb = spark.createDataFrame([("k", "m1", 3), ("l", "m1", 1)], "kb_id string, model string, revision int")
    now = spark.createDataFrame([("k", "m2", 3), ("l", "m1", 1)], "kb_id string, model string, revision int")
    assert {(r["kb_id"], r["revision"], r["stale"]) for r in state.revised(kb, now, ["model"]).collect()} == {("k", 4, True), ("l", 1, False)}
