"""Session defaults: UTC, adaptive execution, Arrow."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(cores: int | str = "*", app: str = "tidepool", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster pass the session that spark-submit made."""
    n = str(os.cpu_count() if cores == "*" else cores)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.shuffle.partitions": n,
        "spark.ui.enabled": "false",
    } | conf
    return SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=settings).getOrCreate()
