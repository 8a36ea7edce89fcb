"""Small helpers that the corpus operators share."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder that the session names in spark.checkpoint.dir.

    Only where the session names none and runs on one machine (tests) a temporary folder is made.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Within, the shuffle files of each written table go as soon as it is written, not when the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


#: What a Python worker keeps from task to task.
_KEPT: dict = {}


def kept(name, make: Callable):
    """One object for all tasks of a worker, until it keeps one of another name or runs tasks that keep none."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = make()
    return _KEPT[name]


def forget_kept() -> None:
    _KEPT.clear()


def inline_table(spark: SparkSession, rows: list[dict], ddl: str) -> DataFrame:
    """A few driver-side rows as a DataFrame made of SQL functions only. Callers bound len(rows)."""
    parsed = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{ddl}>>")
    return spark.range(1).select(F.inline(parsed))


def map_batches(df: DataFrame, make, added: str, keep: list[str], rows: int = 1000, most_bytes: int = 16 << 20,
                keeps: bool = False) -> DataFrame:
    """Arrow batches of df, in slices of bounded rows and bytes, to rows of keep plus the added columns.

    make() is called once in each task; what it returns maps a RecordBatch slice to (row indices, or None for
    all rows in place; values for each added column). A slice holds one row at least, however long it is. Unless keeps is
    set, what earlier operators kept in the worker is freed.
    """
    from pyspark.sql.types import StructType

    new = StructType.fromDDL(added)
    schema = StructType([df.schema[k] for k in keep] + list(new.fields))

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        if not keeps:
            forget_kept()
        arrow, work = to_arrow_schema(schema), make()
        for batch in batches:
            step = max(1, min(rows, int(batch.num_rows * most_bytes / max(batch.nbytes, 1))))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                index, columns = work(part)
                kept = part.select(keep) if index is None else part.select(keep).take(pa.array(index, pa.int64()))
                made = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, list(arrow)[len(keep):])]
                arrays = [c.cast(f.type) for c, f in zip([*kept.columns, *made], arrow)]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, schema)
