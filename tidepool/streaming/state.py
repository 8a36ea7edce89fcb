"""Stateful behaviour, as batch transformations over a log and as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

#: Upper bounds of the latency histogram in seconds, and what makes a run a bad case.
BUCKETS = (0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0)


# --- fixed-window rate limits -------------------------------------------------------------------------------


def window_start(ts: Column, seconds: int) -> Column:
    """Start of the fixed window, in whole seconds since the epoch."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / 1_000_000 / seconds).cast("long") * seconds


def rate_limit(log: DataFrame, by: list[str], limit: int, seconds: int, ts: str = "ts", order: str = "event_id") -> DataFrame:
    """Adds allowed, remaining and retry_after for every request of a log, counted in fixed windows.

    A hot key's window is ranked in one task, but a window is short, so that is what one key sends in `seconds`.
    """
    start = window_start(F.col(ts), seconds)
    nth = F.row_number().over(Window.partitionBy(*by, "_start").orderBy(ts, order))
    out = log.withColumn("_start", start).withColumn("_nth", nth)
    left = F.col("_start") + seconds - F.unix_micros(F.col(ts).cast("timestamp")) / 1_000_000
    return out.withColumns({
        "allowed": F.col("_nth") <= limit, "remaining": F.greatest(F.lit(limit) - F.col("_nth"), F.lit(0)).cast("long"),
        "retry_after": F.greatest(F.lit(1), F.floor(left)).cast("long"),
    }).drop("_start", "_nth")


def rate_limit_stream(log: DataFrame, key: str, limit: int, seconds: int, ts: str = "ts", order: str = "event_id", late: str = "10 minutes") -> DataFrame:
    """The same decision for each request of a stream; counts of the current and the last window are the state."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def decide(k, batches, state: GroupState):
        import pandas as pd

        counts = dict(zip(*state.get)) if state.exists else {}
        rows = pd.concat(list(batches)).sort_values([ts, order])
        out = []
        for r in rows.itertuples():
            at = getattr(r, ts)
            start = int(at.timestamp() // seconds) * seconds
            counts[start] = counts.get(start, 0) + 1
            out.append((k[0], getattr(r, order), counts[start] <= limit, max(limit - counts[start], 0), max(1, int(start + seconds - at.timestamp()))))
        newest = max(counts)
        kept = {s: n for s, n in counts.items() if s >= newest - seconds}
        state.update((list(kept), list(kept.values())))
        yield pd.DataFrame(out, columns=[key, order, "allowed", "remaining", "retry_after"])

    schema = StructType([log.schema[key], log.schema[order], StructField("allowed", BooleanType()),
                         StructField("remaining", LongType()), StructField("retry_after", LongType())])
    timed = log.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(key).applyInPandasWithState(decide, schema, "starts array<long>, counts array<long>", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(log: DataFrame, by: list[str], width: str, slide: str | None = None, late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Counts in tumbling or sliding event-time windows; on a stream, late rows are dropped after the watermark."""
    timed = log.withColumn(ts, F.col(ts).cast("timestamp"))
    timed = timed.withWatermark(ts, late) if timed.isStreaming else timed
    at = F.window(ts, width, slide) if slide else F.window(ts, width)
    return timed.groupBy(at, *by).count().select(F.col("window.start").alias("start"), *by, F.col("count").alias("n"))


def sessions(log: DataFrame, by: list[str], gap: str, late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Sessions that end after a pause of gap."""
    timed = log.withColumn(ts, F.col(ts).cast("timestamp"))
    timed = timed.withWatermark(ts, late) if timed.isStreaming else timed
    found = timed.groupBy(F.session_window(ts, gap), *by).count()
    return found.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, F.col("count").alias("n"))


# --- job queue ----------------------------------------------------------------------------------------------


def backoff(attempt: Column, base: int = 5, most: int = 300) -> Column:
    """Seconds before the next attempt: base, doubled for each attempt after the first, up to most."""
    return F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2), attempt - 1)).cast("long")


def next_jobs(jobs: DataFrame, as_of: Column, n: int = 1) -> DataFrame:
    """The jobs to claim: due and waiting, oldest first."""
    due = jobs.where(F.col("state").isin("pending", "failed") & (F.col("available_at") <= as_of))
    return due.orderBy("available_at", "created_at", "job_id").limit(n)


def reclaim(jobs: DataFrame, as_of: Column, lease_seconds: int = 300, most_attempts: int = 3) -> DataFrame:
    """Expired leases go back to the queue with a delay, or to dead_letter after the last attempt."""
    lost = (F.col("state") == "running") & (F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(F.col("locked_at").cast("timestamp")) > lease_seconds)
    spent = F.col("attempts") >= most_attempts
    return jobs.withColumns({
        "error": F.when(lost, "WORKER_LEASE_EXPIRED").otherwise(F.col("error")),
        "delay": F.when(lost & ~spent, backoff(F.col("attempts"))),
        "state": F.when(lost & spent, "dead_letter").when(lost, "failed").otherwise(F.col("state")),
    })


# --- idempotency, upserts, changes --------------------------------------------------------------------------


def idempotency(requests: DataFrame, by: list[str], ttl_hours: int = 24, ts: str = "ts", order: str = "event_id") -> DataFrame:
    """(by, order, outcome): the first request with a key is new; later ones within its life are replay or conflict.

    A key lives for ttl_hours from the request that opened it, so its requests are folded in order of time. The fold
    walks sorted partitions and holds one key's opening request, however many requests the key has.
    """
    life = ttl_hours * 3600 * 1_000_000
    given = requests.select(*by, F.col(order), F.unix_micros(F.col(ts).cast("timestamp")).alias("_at"), F.col("request_hash").alias("_hash"))
    schema = StructType([*[requests.schema[c] for c in by], requests.schema[order], StructField("outcome", StringType())])

    def fold(batches):
        key = opened = held = None
        for rows in batches:
            out = []
            for *now, _, at, value in rows.itertuples(index=False, name=None):
                now = [None if v != v else v for v in now]  # pandas has NaN for a null number
                if now != key:
                    key, opened = now, None
                if opened is None or at >= opened + life:
                    opened, held = at, value
                    out.append("new")
                else:
                    out.append("replay" if value == held else "conflict")
            yield rows[[*by, order]].assign(outcome=out)

    return given.repartition(*by).sortWithinPartitions(*by, "_at", order).mapInPandas(fold, schema)


def first_requests_stream(requests: DataFrame, by: list[str], ttl: str = "24 hours", ts: str = "ts") -> DataFrame:
    """Only the first request of each key within its life."""
    return requests.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, ttl).dropDuplicatesWithinWatermark(by)


def upserted(current: DataFrame, changes: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """current with changes laid over it: the last row of each key. Works on plain parquet, which has no MERGE."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return current.unionByName(changes).withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def bucketed(path: str, spark: SparkSession) -> DataFrame | None:
    """The table that merge_into keeps under path: of each bucket the folder that the manifest names last."""
    rows = _manifest(path, spark)
    if rows is None:
        return None
    last = rows.groupBy("bucket").agg(F.max("batch_id").alias("batch_id")).collect()  # a row for each bucket
    return spark.read.parquet(*[f"{path}/data/batch={r['batch_id']}/bucket={r['bucket']}" for r in last])


def _manifest(path: str, spark: SparkSession) -> DataFrame | None:
    try:
        return spark.read.schema("bucket int, batch_id long").parquet(f"{path}/manifest")
    except Exception as e:  # no batch yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def merge_into(path: str, keys: list[str], order: list[Column], buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps one row per key in parquet folders of hash buckets under path (see bucketed).

    A batch reads and writes only the buckets that hold its keys: it writes their new folders and only then names them
    in the manifest, so that a batch that fails half way, or runs twice, leaves the last state in place. Folders that are
    named no more are left to the owner of path.
    """
    place = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket")

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        touched = [r["bucket"] for r in batch.select(place).distinct().collect()]  # at most so many buckets
        if not touched:
            return
        known = _manifest(path, spark)
        current = batch.limit(0)
        if known is not None:
            last = known.where((F.col("batch_id") < batch_id) & F.col("bucket").isin(touched)).groupBy("bucket").agg(F.max("batch_id").alias("batch_id")).collect()
            if last:
                current = spark.read.schema(batch.schema).parquet(*[f"{path}/data/batch={r['batch_id']}/bucket={r['bucket']}" for r in last])
        merged = upserted(current, batch, keys, order).withColumn("bucket", place)
        merged.repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/batch={batch_id}")
        named = spark.range(1).select(F.explode(F.lit(touched)).alias("bucket"), F.lit(batch_id).cast("long").alias("batch_id"))
        named.coalesce(1).write.mode("append").parquet(f"{path}/manifest")

    return apply


def replaced(current: DataFrame, rebuilt: DataFrame, key: str = "document_id") -> DataFrame:
    """Rows of the rebuilt documents take the place of all their old rows."""
    return current.join(rebuilt.select(key).distinct(), key, "left_anti").unionByName(rebuilt)


def changes(log: DataFrame, by: list[str], value: str, ts: str = "ts", order: str = "event_id") -> DataFrame:
    """Adds changed: the value differs from the one before, once at each transition; the first is no change."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(ts, order))
    return log.withColumn("changed", F.coalesce(~F.col(value).eqNullSafe(before) & before.isNotNull(), F.lit(False)))


def bad_cases(stages: DataFrame) -> DataFrame:
    """(run_id, category) once each. stages: run_id, stage, hits, truncated, fallback, failed."""
    category = F.array_compact(F.array(
        F.when((F.col("stage") == "retrieve") & (F.col("hits") == 0), "retrieval_miss"),
        F.when((F.col("stage") == "context") & F.col("truncated"), "context_truncated"),
        F.when((F.col("stage") == "rerank") & F.col("fallback"), "reranker_fallback"),
        F.when((F.col("stage") == "answer") & F.col("failed"), "answer_failed")))
    return stages.select("run_id", F.explode(category).alias("category")).dropDuplicates(["run_id", "category"])


def histogram(log: DataFrame, by: list[str], value: str, bounds: tuple[float, ...] = BUCKETS) -> DataFrame:
    """Cumulative bucket counts, sum and count of each group, one row per bucket; updates on a stream."""
    cols = [F.count_if(F.col(value) <= b).alias(f"_b{i}") for i, b in enumerate(bounds)]
    per = log.groupBy(*by).agg(*cols, F.count("*").alias("count"), F.sum(value).alias("sum"))
    rows = [F.struct(F.lit(str(b)).alias("le"), F.col(f"_b{i}").alias("n")) for i, b in enumerate(bounds)]
    rows.append(F.struct(F.lit("+Inf").alias("le"), F.col("count").alias("n")))
    return per.select(*by, "count", "sum", F.inline(F.array(*rows)))


def revised(previous: DataFrame, current: DataFrame, identity: list[str], key: str = "kb_id") -> DataFrame:
    """current with the revision raised where what identifies the embedding changed, and whether it is stale then."""
    sig = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in identity]), 256)
    old = previous.select(key, F.col("revision").alias("_r"), sig.alias("_old"))
    out = current.withColumn("_new", sig).join(old, key, "left")
    differs = F.col("_old").isNotNull() & (F.col("_old") != F.col("_new"))
    return out.withColumn("revision", F.coalesce("_r", F.lit(0)) + differs.cast("int")).withColumn("stale", differs).drop("_r", "_old", "_new")


# --- event sinks --------------------------------------------------------------------------------------------

#: Kinds of events that a run emits, in order.
EVENTS = ("started", "trace", "citation", "delta", "completed", "error")


def answer_events(answers: DataFrame, piece: int = 80) -> DataFrame:
    """The typed events of each answer, numbered: started, a citation each, the text in pieces, completed or error.

    answers: run_id, text, citations (array), failed.
    """
    n = F.ceil(F.length("text") / piece).cast("int")
    deltas = F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.substr(F.col("text"), i * piece + 1, F.lit(piece)))
    event = lambda kind, body: F.struct(F.lit(kind).alias("event"), body.cast("string").alias("data"))
    every = F.concat(
        F.array(event("started", F.col("run_id"))), F.transform("citations", lambda x: event("citation", x)), F.transform(deltas, lambda d: event("delta", d)),
        F.array(F.when(F.col("failed"), event("error", F.lit("GENERATION_FAILED"))).otherwise(event("completed", F.col("run_id")))))
    return answers.select("run_id", F.posexplode(every).alias("sequence", "_e")).select("run_id", "sequence", "_e.event", "_e.data")


def append_to(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends immutable rows; a batch that is run again replaces what it wrote."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return apply


def resumable(checkpoints: DataFrame) -> DataFrame:
    """The latest checkpoint of each run whose checksum is that of its state."""
    good = checkpoints.where(F.col("checksum") == F.sha2("state_json", 256))
    return good.groupBy("run_id").agg(F.max_by(F.struct("sequence", "node", "state_json"), "sequence").alias("_c")).select("run_id", "_c.*")
