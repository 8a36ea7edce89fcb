"""Job leases and bounded caches as keyed state, each with a batch form over a whole log."""

from __future__ import annotations

from collections import OrderedDict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StringType, StructField, StructType

from tidepool.streaming.state import backoff

EXPIRED = "WORKER_LEASE_EXPIRED"

# --- leases -------------------------------------------------------------------------------------------------

_STEPS = "job_id string, at timestamp, state string, attempts long, error string, available_at timestamp"


def lease_steps(log: DataFrame, as_of: Column | None = None, lease_seconds: int = 300, most_attempts: int = 3) -> DataFrame:
    """What happens to jobs, step by step: (job_id, at, state, attempts, error, available_at).

    log: job_id, event (queued, claimed, done or failed), ts. A job is claimed while it waits (queued, or failed and
    its delay over); a claim that nothing follows within the lease expires: the job waits again after a delay that
    doubles with each attempt, or is dead_letter after the last one. What a worker reports on an expired lease is
    not a step, and neither is a claim of a job that doesn't wait. as_of: time up to which leases expire (default: the log's last).

    A fold over each job's own sorted events, inside the plan; a job has few of them.
    """
    rows = log.select("job_id", "event", F.col("ts").cast("timestamp").alias("at")).dropDuplicates()
    last = rows.agg(F.max("at").alias("_until")) if as_of is None else rows.sparkSession.range(1).select(as_of.cast("timestamp").alias("_until"))
    events = F.array_sort(F.collect_list(F.struct("at", F.expr("CASE event WHEN 'queued' THEN 0 WHEN 'done' THEN 1 WHEN 'failed' THEN 2 ELSE 3 END").alias("o"), "event")))
    per = rows.groupBy("job_id").agg(events.alias("e")).join(F.broadcast(last))  # one row
    none = F.lit(None)
    kind = "struct<state:string,attempts:bigint,locked:timestamp,available:timestamp,steps:array<struct<at:timestamp,state:string,attempts:bigint,error:string,available_at:timestamp>>>"
    start = F.struct(none.cast("string").alias("state"), F.lit(0).cast("long").alias("attempts"), none.cast("timestamp").alias("locked"),
                     none.cast("timestamp").alias("available"), F.array().cast("array<struct<at:timestamp,state:string,attempts:bigint,error:string,available_at:timestamp>>").alias("steps")).cast(kind)

    def step(at, state, attempts, error, available):
        return F.array(F.struct(at.alias("at"), state.alias("state"), attempts.alias("attempts"), error.cast("string").alias("error"), available.cast("timestamp").alias("available_at")))

    def later(at, seconds):
        return F.timestamp_micros(F.unix_micros(at) + seconds * 1_000_000)

    def fell(s, now):
        """s after its lease has expired before now, if it has."""
        over = later(s["locked"], F.lit(lease_seconds))
        gone = (s["state"] == "running") & (over < now)
        dead = s["attempts"] >= most_attempts
        state, available = F.when(dead, "dead_letter").otherwise("failed"), F.when(~dead, later(over, backoff(s["attempts"])))
        after = F.struct(state.alias("state"), s["attempts"].alias("attempts"), none.cast("timestamp").alias("locked"), available.alias("available"),
                         F.concat(s["steps"], step(over, state, s["attempts"], F.lit(EXPIRED), available)).alias("steps")).cast(kind)
        return F.when(gone, after).otherwise(s)

    def met(s, x):
        at, n = x["at"], s["attempts"] + 1
        claim = (x["event"] == "claimed") & ((s["state"] == "pending") | ((s["state"] == "failed") & (s["available"] <= at)))
        ended = x["event"].isin("done", "failed") & (s["state"] == "running")
        dead = (x["event"] == "failed") & (s["attempts"] >= most_attempts)
        final = F.when(x["event"] == "done", "done").when(dead, "dead_letter").otherwise("failed")
        wait = F.when(final == "failed", later(at, backoff(s["attempts"])))
        made = lambda state, attempts, locked, available, error: F.struct(
            state.alias("state"), attempts.alias("attempts"), locked.cast("timestamp").alias("locked"), available.cast("timestamp").alias("available"),
            F.concat(s["steps"], step(at, state, attempts, error, available)).alias("steps")).cast(kind)
        return (F.when((x["event"] == "queued") & s["state"].isNull(), made(F.lit("pending"), s["attempts"], none, at, none))
                .when(claim, made(F.lit("running"), n, at, none, none))
                .when(ended, made(final, s["attempts"], none, wait, F.when(x["event"] == "failed", "JOB_FAILED"))).otherwise(s))

    folded = F.aggregate("e", start, lambda s, x: met(fell(s, x["at"]), x), lambda s: fell(s, F.col("_until"))["steps"])
    return per.select("job_id", F.inline(folded))


class _Leases(StatefulProcessor):
    """One job's state and its lease's timer."""

    def __init__(self, lease_seconds: int, most_attempts: int):
        self.lease, self.most = lease_seconds * 1000, most_attempts

    def init(self, handle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "state string, attempts long, locked long, available long")

    def close(self) -> None:
        pass

    def _wait(self, attempts: int) -> int:
        return min(300, 5 * 2 ** (attempts - 1)) * 1000

    def _rows(self, key, steps):
        import pandas as pd

        names = ["job_id", "at", "state", "attempts", "error", "available_at"]
        out = pd.DataFrame([(key[0], *s) for s in steps], columns=names)
        for c in ("at", "available_at"):
            out[c] = pd.to_datetime(out[c], unit="ms")
        return out.astype({"attempts": "int64"})

    def _fall(self, job, steps):
        state, attempts, locked, _ = job
        over, dead = locked + self.lease, attempts >= self.most
        wait = None if dead else over + self._wait(attempts)
        steps.append((over, "dead_letter" if dead else "failed", attempts, EXPIRED, wait))
        return ("dead_letter" if dead else "failed", attempts, None, wait)

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        job, steps = self.job.get() if self.job.exists() else (None, 0, None, None), []
        order = {"queued": 0, "done": 1, "failed": 2, "claimed": 3}
        log = pd.concat(list(rows)).drop_duplicates()
        for at, event in sorted(zip((t.value // 10**6 for t in log["ts"]), log["event"]), key=lambda x: (x[0], order[x[1]])):
            if job[0] == "running" and job[2] + self.lease < at:
                self.handle.deleteTimer(job[2] + self.lease)
                job = self._fall(job, steps)
            state, attempts, locked, available = job
            if event == "queued" and state is None:
                job = ("pending", 0, None, at)
                steps.append((at, "pending", 0, None, at))
            elif event == "claimed" and (state == "pending" or state == "failed" and available <= at):
                job = ("running", attempts + 1, at, None)
                self.handle.registerTimer(at + self.lease)
                steps.append((at, "running", attempts + 1, None, None))
            elif event in ("done", "failed") and state == "running":
                self.handle.deleteTimer(locked + self.lease)
                final = "done" if event == "done" else "dead_letter" if attempts >= self.most else "failed"
                job = (final, attempts, None, at + self._wait(attempts) if final == "failed" else None)
                steps.append((at, final, attempts, "JOB_FAILED" if event == "failed" else None, job[3]))
        self.job.update(job)
        if steps:
            yield self._rows(key, steps)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        job, steps = self.job.get(), []
        if job[0] == "running" and job[2] + self.lease <= expiredTimerInfo.getExpiryTimeInMs():
            self.job.update(self._fall(job, steps))
        if steps:
            yield self._rows(key, steps)


def lease_steps_stream(log: DataFrame, lease_seconds: int = 300, most_attempts: int = 3, late: str = "0 seconds") -> DataFrame:
    """lease_steps over a stream: each job is keyed state, and a lease ends by an event-time timer.

    Needs RocksDB as the state store. Events of one job come in order of time, up to `late`.
    """
    timed = log.select("job_id", "event", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    return timed.groupBy("job_id").transformWithStateInPandas(_Leases(lease_seconds, most_attempts), StructType.fromDDL(_STEPS), "append", "eventTime")


# --- caches -------------------------------------------------------------------------------------------------


class _Cache(StatefulProcessor):
    """A workspace's entries, least recently used first; state is bounded by their number."""

    def __init__(self, most: int, names: list[str]):
        self.most, self.names = most, names

    def init(self, handle) -> None:
        self.entries = handle.getValueState("entries", "keys array<string>, expires array<long>, payloads array<string>")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        held = OrderedDict((k, (e, p)) for k, e, p in zip(*self.entries.get())) if self.entries.exists() else OrderedDict()
        log = pd.concat(list(rows)).sort_values(["at_micros", self.names[1]])
        out = []
        for order, at, name, op, payload, ttl in log[[self.names[1], "at_micros", "cache_key", "op", "payload", "ttl_seconds"]].itertuples(index=False, name=None):
            found = gone = None
            if op == "get":
                if name in held and held[name][0] <= at:
                    del held[name]
                if name in held:
                    held.move_to_end(name)
                    found = held[name][1]
            else:
                held[name] = (at + int(ttl) * 1_000_000, payload)
                held.move_to_end(name)
                if len(held) > self.most:
                    gone, _ = held.popitem(last=False)
            out.append((key[0], order, "stored" if op == "put" else "miss" if found is None else "hit", found, gone))
        self.entries.update((list(held), [e for e, _ in held.values()], [p for _, p in held.values()]))
        yield pd.DataFrame(out, columns=[*self.names, "outcome", "found", "evicted"])


def cached(log: DataFrame, most: int = 256, workspace: str = "workspace_id", order: str = "event_id", ts: str = "ts") -> DataFrame:
    """(workspace, order, outcome, found, evicted) of a log of cache operations, as a batch or a stream.

    log: workspace, order, ts, cache_key, op (get or put), payload, ttl_seconds. A get within an entry's life is a hit and makes
    it the most recently used; a late one drops it. A put replaces, and beyond `most` entries of its workspace the least
    recently used goes. Time is that of the log. Needs RocksDB as the state store.
    """
    rows = log.select(workspace, order, F.unix_micros(F.col(ts).cast("timestamp")).alias("at_micros"), "cache_key", "op", "payload", F.col("ttl_seconds").cast("long").alias("ttl_seconds"))
    schema = StructType([log.schema[workspace], log.schema[order], *[StructField(c, StringType()) for c in ("outcome", "found", "evicted")]])
    return rows.groupBy(workspace).transformWithStateInPandas(_Cache(most, [workspace, order]), schema, "append", "none")


def cache_hits(asked: DataFrame, stored: DataFrame, as_of: Column) -> DataFrame:
    """asked (cache_key, ...) with payload and hit: the newest stored entry of the key whose life isn't over.

    stored: cache_key, payload, created_at, ttl_seconds. The table form of the cache, for whole batches of questions.
    """
    over = F.unix_micros(F.col("created_at").cast("timestamp")) + F.col("ttl_seconds").cast("long") * 1_000_000
    live = stored.where(over > F.unix_micros(as_of.cast("timestamp")))
    newest = live.groupBy("cache_key").agg(F.max_by("payload", "created_at").alias("payload"))
    return asked.join(newest, "cache_key", "left").withColumn("hit", F.col("payload").isNotNull())
