"""Batch forms of the stateful operators, over events and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepool.operators import workflow
from tidepool.plans.base import query
from tidepool.sources import files
from tidepool.streaming import queue, state

_S = "epoch_us(ts) / 1000000.0"


@query(f"""SELECT event_id, n <= 2 AS allowed, greatest(2 - n, 0) AS remaining, greatest(1, floor(w + 3600 - {_S}))::BIGINT AS retry_after FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, w ORDER BY ts, event_id) AS n FROM (SELECT *, floor(epoch_us(ts) / 1000000.0 / 3600)::BIGINT * 3600 AS w FROM events))""")
def rate_limit_fixed_window(c):
    return state.rate_limit(c.table("events"), ["user_id"], 2, 3600).select("event_id", "allowed", "remaining", "retry_after")


_BOUNDS = "[0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0]::DOUBLE[]"


@query(f"""WITH b AS (SELECT unnest({_BOUNDS}) AS bound), g AS (SELECT event_type, count(*) AS count, round(sum(value), 4) AS sum FROM events GROUP BY event_type)
  SELECT g.event_type, bound::VARCHAR AS le, count(*) FILTER (e.value <= bound) AS n, g.count, g.sum FROM g JOIN events e USING (event_type), b GROUP BY ALL
  UNION ALL SELECT event_type, '+Inf', count, count, sum FROM g""")
def http_histogram(c):
    return state.histogram(c.table("events"), ["event_type"], "value").withColumn("sum", F.round("sum", 4))


@query()
def idempotent_dedup(c):
    e = c.table("events").withColumn("request_hash", F.sha2("props", 256))
    return state.idempotency(e, ["user_id", "event_type"]).select("event_id", "outcome")


@query("""SELECT o_orderkey AS job_id, CASE WHEN lost AND attempts >= 3 THEN 'dead_letter' WHEN lost THEN 'failed' ELSE state END AS state,
  CASE WHEN lost THEN 'WORKER_LEASE_EXPIRED' END AS error, CASE WHEN lost AND attempts < 3 THEN least(300, 5 * pow(2, attempts - 1))::BIGINT END AS delay FROM (
  SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'succeeded' ELSE 'pending' END AS state, o_orderkey % 5 + 1 AS attempts,
  o_orderstatus = 'O' AND epoch(TIMESTAMP '1997-06-01') - epoch(o_orderdate) > 300 AS lost FROM orders)""")
def lease_transition(c):
    kind = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "F", "succeeded").otherwise("pending")
    jobs = c.table("orders").select(F.col("o_orderkey").alias("job_id"), kind.alias("state"), (F.col("o_orderkey") % 5 + 1).alias("attempts"),
                                    F.col("o_orderdate").alias("locked_at"), F.lit(None).cast("string").alias("error"))
    return state.reclaim(jobs, F.lit("1997-06-01").cast("timestamp")).select("job_id", "state", "error", "delay")


@query("SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def stage_upsert(c):
    e = c.table("events")
    half = F.col("value") < 50
    return state.upserted(e.where(half), e.where(~half), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("event_id")


@query("SELECT event_id, coalesce(event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS changed FROM events")
def change_detect(c):
    return state.changes(c.table("events"), ["user_id"], "event_type").select("event_id", "changed")


_STAGES = """stages AS (SELECT user_id AS run_id, ['retrieve', 'context', 'rerank', 'answer'][event_id % 4 + 1] AS stage, floor(value)::INT % 3 AS hits, value > 150 AS truncated, value < 10 AS fallback, value > 300 AS failed FROM events)"""


@query(f"""WITH {_STAGES} SELECT DISTINCT run_id, CASE WHEN stage = 'retrieve' AND hits = 0 THEN 'retrieval_miss' WHEN stage = 'context' AND truncated THEN 'context_truncated'
  WHEN stage = 'rerank' AND fallback THEN 'reranker_fallback' WHEN stage = 'answer' AND failed THEN 'answer_failed' END AS category FROM stages WHERE category IS NOT NULL""")
def bad_cases(c):
    stage = F.array(*map(F.lit, ("retrieve", "context", "rerank", "answer")))[(F.col("event_id") % 4).cast("int")]
    v = F.col("value")
    s = c.table("events").select(F.col("user_id").alias("run_id"), stage.alias("stage"), (F.floor(v).cast("int") % 3).alias("hits"), (v > 150).alias("truncated"), (v < 10).alias("fallback"), (v > 300).alias("failed"))
    return state.bad_cases(s)


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_counts(c):
    out = state.windowed_counts(c.table("events"), ["event_type"], "1 hour")
    return out.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("""SELECT strftime(time_bucket(INTERVAL 30 MINUTE, ts) - to_minutes((30 * k)::INT), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events, range(0, 2) r(k) GROUP BY ALL""")
def sliding_counts(c):
    out = state.windowed_counts(c.table("events"), ["event_type"], "1 hour", "30 minutes")
    return out.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("""SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
  SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 6 HOUR, true)::INT AS fresh FROM events)) GROUP BY user_id, s""")
def session_counts(c):
    out = state.sessions(c.table("events"), ["user_id"], "6 hours")
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence FROM events")
def event_sequence(c):
    return workflow.sequence(c.table("events"), ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "sequence")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def latest_event(c):
    return c.table("events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


_WAIT = "to_seconds(least(300, 5 * pow(2, n - 1))::BIGINT)"


@query(f"""WITH RECURSIVE named AS (SELECT DISTINCT user_id AS job_id, ts AS t, ['queued', 'claimed', 'claimed', 'done', 'failed'][event_id % 5 + 1] AS event FROM events),
  e AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY t, CASE event WHEN 'queued' THEN 0 WHEN 'done' THEN 1 WHEN 'failed' THEN 2 ELSE 3 END) AS i FROM named
    UNION ALL SELECT job_id, (SELECT max(t) FROM named), 'end', count(*) + 1 FROM named GROUP BY job_id),
  run AS (SELECT job_id, 0::BIGINT AS i, NULL::VARCHAR AS state, 0::BIGINT AS n, NULL::TIMESTAMP AS locked, NULL::TIMESTAMP AS free, NULL::TIMESTAMP AS fell_at, NULL::VARCHAR AS fell, NULL::TIMESTAMP AS fell_free,
      NULL::TIMESTAMP AS t, NULL::VARCHAR AS step, NULL::VARCHAR AS error FROM (SELECT DISTINCT job_id FROM named)
    UNION ALL SELECT job_id, i, coalesce(step, was), n + (step = 'running' AND step IS NOT NULL)::INT, CASE WHEN step = 'running' THEN t WHEN step IS NULL THEN held END,
      CASE WHEN step = 'pending' THEN t WHEN step = 'failed' THEN t + {_WAIT} WHEN step IS NULL THEN open END, fell_at, fell, fell_free, t, step, CASE WHEN step IS NOT NULL AND event = 'failed' THEN 'JOB_FAILED' END
    FROM (SELECT *, CASE WHEN event = 'queued' AND was IS NULL THEN 'pending' WHEN event = 'claimed' AND (was = 'pending' OR was = 'failed' AND open <= t) THEN 'running'
        WHEN event = 'done' AND was = 'running' THEN 'done' WHEN event = 'failed' AND was = 'running' THEN CASE WHEN n >= 3 THEN 'dead_letter' ELSE 'failed' END END AS step
      FROM (SELECT e.*, r.n, coalesce(f.fell, r.state) AS was, CASE WHEN f.fell IS NULL THEN r.locked END AS held, CASE WHEN f.fell IS NULL THEN r.free ELSE f.fell_free END AS open, f.fell, f.fell_at, f.fell_free
        FROM run r JOIN e ON e.job_id = r.job_id AND e.i = r.i + 1, LATERAL (SELECT CASE WHEN past THEN CASE WHEN r.n >= 3 THEN 'dead_letter' ELSE 'failed' END END AS fell, CASE WHEN past THEN r.locked + to_seconds(300) END AS fell_at,
          CASE WHEN past AND r.n < 3 THEN r.locked + to_seconds(300) + to_seconds(least(300, 5 * pow(2, r.n - 1))::BIGINT) END AS fell_free FROM (SELECT coalesce(r.state = 'running' AND r.locked + to_seconds(300) < e.t, false) AS past)) f)))
  SELECT job_id, strftime(t, '%Y-%m-%d %H:%M:%S') AS "at", state, attempts, error, strftime(available_at, '%Y-%m-%d %H:%M:%S') AS available_at FROM (
    SELECT job_id, fell_at AS t, fell AS state, n - (step = 'running' AND step IS NOT NULL)::INT AS attempts, 'WORKER_LEASE_EXPIRED' AS error, fell_free AS available_at FROM run WHERE fell IS NOT NULL
    UNION ALL SELECT job_id, t, step, n, error, CASE WHEN step IN ('pending', 'failed') THEN free END FROM run WHERE step IS NOT NULL)""")
def lease_steps(c):
    """Events as a job log: what each user's job goes through."""
    kind = F.array(*map(F.lit, ("queued", "claimed", "claimed", "done", "failed")))[(F.col("event_id") % 5).cast("int")]
    log = c.table("events").select(F.col("user_id").alias("job_id"), kind.alias("event"), "ts")
    stamp = lambda x: F.date_format(x, "yyyy-MM-dd HH:mm:ss").alias(x)
    return queue.lease_steps(log).select("job_id", stamp("at"), "state", "attempts", "error", stamp("available_at"))


@query(f"""WITH r AS (SELECT event_type AS method, concat('/', user_id % 5) AS route, concat(event_id % 3 + 2, 'xx') AS status_class, value / 10 AS seconds FROM events),
  b AS (SELECT unnest({_BOUNDS}) AS le), g AS (SELECT method, route, count(*) AS n, sum(seconds) AS s FROM r GROUP BY ALL)
  SELECT 0 AS part, format('http_requests_total{{{{method="{{}}",route="{{}}",status_class="{{}}"}}}} {{}}', method, route, status_class, count(*)) AS line FROM r GROUP BY method, route, status_class
  UNION ALL SELECT 1, format('http_request_duration_seconds_bucket{{{{method="{{}}",route="{{}}",le="{{}}"}}}} {{}}', method, route, le::VARCHAR, count(*) FILTER (seconds <= le)) FROM r, b GROUP BY method, route, le
  UNION ALL SELECT 1, format('http_request_duration_seconds_bucket{{{{method="{{}}",route="{{}}",le="+Inf"}}}} {{}}', method, route, n) FROM g
  UNION ALL SELECT 2, format('http_request_duration_seconds_sum{{{{method="{{}}",route="{{}}"}}}} {{:.6f}}', method, route, s) FROM g
  UNION ALL SELECT 3, format('http_request_duration_seconds_count{{{{method="{{}}",route="{{}}"}}}} {{}}', method, route, n) FROM g
  UNION ALL SELECT 4, format('rate_limit_rejections_total{{{{scope="{{}}",backend="memory"}}}} {{}}', event_type, count(*)) FROM events WHERE value > 100 GROUP BY event_type""")
def metrics_text(c):
    """Events as requests, and those of a large value as rejected ones."""
    e = c.table("events")
    status = F.concat((F.col("event_id") % 3 + 2).cast("string"), F.lit("xx"))
    requests = e.select(F.col("event_type").alias("method"), F.concat(F.lit("/"), F.col("user_id") % 5).alias("route"), status.alias("status_class"), (F.col("value") / 10).alias("seconds"))
    rejected = e.where("value > 100").select(F.col("event_type").alias("scope"), F.lit("memory").alias("backend"))
    return files.metrics_text(requests, rejected)
