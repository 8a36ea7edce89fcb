"""Leases and caches: batch forms and keyed state against loops."""

import datetime as dt
import random
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from tidepool.streaming import queue

T0 = dt.datetime(2026, 1, 1)
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture()
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, ROCKSDB)
    yield spark
    spark.conf.unset(key)


def job_log(n=60, seed=2):
    """Jobs queued, claimed, done and failed, early, late and out of turn; seconds from T0."""
    rng, rows = random.Random(seed), []
    for job in range(n):
        at = rng.randrange(100)
        rows.append((f"j{job}", "queued", at))
        for _ in range(rng.randint(0, 7)):
            at += rng.choice((1, 4, 30, 301, 300, 900))
            rows.append((f"j{job}", rng.choice(("claimed", "claimed", "done", "failed", "queued")), at))
    return rows


def by_hand(rows, until, lease=300, most=3):
    out, jobs = [], {}
    order = {"queued": 0, "done": 1, "failed": 2, "claimed": 3}

    def fall(job, now):
        j = jobs[job]
        if j["state"] == "running" and j["locked"] + lease < now:
            dead, at = j["n"] >= most, j["locked"] + lease
            j |= {"state": "dead_letter" if dead else "failed", "free": None if dead else at + min(300, 5 * 2 ** (j["n"] - 1))}
            out.append((job, at, j["state"], j["n"], queue.EXPIRED, j["free"]))

    for job, event, at in sorted(set(rows), key=lambda r: (r[2], order[r[1]])):
        j = jobs.setdefault(job, {"state": None, "n": 0, "locked": None, "free": None})
        fall(job, at)
        if event == "queued" and j["state"] is None:
            j |= {"state": "pending", "free": at}
            out.append((job, at, "pending", 0, None, at))
        elif event == "claimed" and (j["state"] == "pending" or j["state"] == "failed" and j["free"] <= at):
            j |= {"state": "running", "n": j["n"] + 1, "locked": at}
            out.append((job, at, "running", j["n"], None, None))
        elif event in ("done", "failed") and j["state"] == "running":
            j["state"] = "done" if event == "done" else "dead_letter" if j["n"] >= most else "failed"
            j["free"] = at + min(300, 5 * 2 ** (j["n"] - 1)) if j["state"] == "failed" else None
            out.append((job, at, j["state"], j["n"], "JOB_FAILED" if event == "failed" else None, j["free"]))
    for job in jobs:
        fall(job, until)
    return sorted(out, key=repr)


def seconds(rows):
    past = lambda t: None if t is None else int((t - T0).total_seconds())
    return sorted(((r["job_id"], past(r["at"]), r["state"], r["attempts"], r["error"], past(r["available_at"])) for r in rows), key=repr)


def jobs_of(spark, rows):
    return spark.createDataFrame([(j, e, T0 + dt.timedelta(seconds=s)) for j, e, s in rows], "job_id string, event string, ts timestamp")


def test_lease_steps_equal_a_loop(spark):
    rows = job_log()
    want = by_hand(rows, max(s for *_, s in rows))
    got = queue.lease_steps(jobs_of(spark, rows).repartition(3))
    assert seconds(got.collect()) == want
    assert {w[2] for w in want} == {"pending", "running", "done", "failed", "dead_letter"} and any(w[4] == queue.EXPIRED for w in want)
    later = queue.lease_steps(jobs_of(spark, rows), as_of=F.lit(T0 + dt.timedelta(days=1)).cast("timestamp"))
    assert seconds(later.collect()) == by_hand(rows, 86400)
    assert queue.lease_steps(jobs_of(spark, rows).limit(0)).count() == 0


def test_lease_stream_agrees_with_the_batch_form(rocksdb, tmp_path):
    spark, rows = rocksdb, job_log(25, 6)
    rows = sorted(rows, key=lambda r: r[2])
    end = max(s for *_, s in rows) + 10_000
    src = str(tmp_path / "in")
    parts = [[r for r in rows if lo <= r[2] < lo + 400] for lo in range(0, end, 400)]
    parts = [p for p in parts if p] + [[("last", "queued", end)], [("last", "claimed", end + 1)]]  # moves the watermark past every lease
    for p in parts:
        jobs_of(spark, p).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(jobs_of(spark, rows[:1]).schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = queue.lease_steps_stream(stream).writeStream.format("memory").queryName("leases").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = seconds(r for r in spark.table("leases").collect() if r["job_id"] != "last")
    assert got == by_hand(rows, end - 1)


def cache_log(n=300, seed=3):
    rng, at, rows = random.Random(seed), 0, []
    for i in range(n):
        at += rng.randrange(20)
        rows.append((rng.choice("ab"), i, at, f"k{rng.randrange(7)}", rng.choice(("get", "get", "put")), f"v{i}", rng.choice((30, 120, 1000))))
    return rows


def cached_by_hand(rows, most):
    held, out = {}, set()
    for w, i, at, key, op, payload, ttl in rows:
        own = held.setdefault(w, OrderedDict())
        found = gone = None
        if op == "get":
            if key in own and own[key][0] <= at:
                del own[key]
            if key in own:
                own.move_to_end(key)
                found = own[key][1]
            out.add((w, i, "miss" if found is None else "hit", found, None))
        else:
            own[key] = (at + ttl, payload)
            own.move_to_end(key)
            if len(own) > most:
                gone, _ = own.popitem(last=False)
            out.add((w, i, "stored", None, gone))
    return out


def cache_frame(spark, rows):
    data = [(w, i, T0 + dt.timedelta(seconds=at), k, op, p, ttl) for w, i, at, k, op, p, ttl in rows]
    return spark.createDataFrame(data, "workspace_id string, event_id long, ts timestamp, cache_key string, op string, payload string, ttl_seconds int")


def test_cache_evicts_in_order(rocksdb, tmp_path):
    spark, rows = rocksdb, cache_log()
    want = cached_by_hand(rows, 3)
    assert {w[2] for w in want} == {"stored", "hit", "miss"} and any(w[4] for w in want)
    src = str(tmp_path / "in")
    for lo in range(0, len(rows), 100):
        cache_frame(spark, rows[lo : lo + 100]).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(cache_frame(spark, rows[:1]).schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = queue.cached(stream, 3).writeStream.format("memory").queryName("cache").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("cache").collect()} == want
    assert {tuple(r) for r in queue.cached(cache_frame(spark, rows).repartition(3), 3).collect()} == want


def test_cache_hits_as_a_join(spark):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    stored = spark.createDataFrame([("a", "old", at(0), 100), ("a", "new", at(10), 100), ("b", "over", at(0), 20), ("c", "long", at(0), 500)],
                                   "cache_key string, payload string, created_at timestamp, ttl_seconds int")
    asked = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "query_id long, cache_key string")
    out = {r["query_id"]: (r["payload"], r["hit"]) for r in queue.cache_hits(asked, stored, F.lit(at(50)).cast("timestamp")).collect()}
    assert out == {1: ("new", True), 2: (None, False), 3: ("long", True), 4: (None, False)}
