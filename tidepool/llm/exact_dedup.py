"""Exact dedup against a persistent digest index.

The index is a table bucketed and sorted by digest, with a partition for each batch. A batch of documents is
digested and summed per digest, so a group of copies is one row before any shuffle. New digests are found by a
sort-merge anti-join with the index; those already there are joined with their earlier rows, so totals stay exact.
Only the batch's digests are shuffled and written: the index is read bucket by bucket, never dealt out, summed or
rewritten. A batch has an id, and adding it again replaces its own partition.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.shared import scratch_path, table, written

_COLUMNS = "text_sha256 string, keep_id long, group_size long, novel boolean, batch string"


def digest(text: str = "text") -> Column:
    """Lowercase hex SHA-256 of the text as it is, in UTF-8; a null text counts as empty."""
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)


class DigestIndex:
    """Digests seen so far: one row per digest and batch, bucketed and sorted by digest.

    The table is made when the first batch is added. Without a number of buckets it gets one for every bucket_rows
    digests of ten such batches, 16 at least.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, path: str | None = None, buckets: int | None = None, bucket_rows: int = 5_000_000):
        self.spark, self.buckets, self.bucket_rows = spark, buckets, bucket_rows
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        self.path = path or scratch_path(spark, self.name)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def _create(self, digests: int) -> None:
        buckets = self.buckets or max(16, -(-10 * digests // self.bucket_rows))
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({_COLUMNS}) USING parquet OPTIONS (path '{self.path}') "
            f"PARTITIONED BY (batch) CLUSTERED BY (text_sha256) SORTED BY (text_sha256) INTO {buckets} BUCKETS"
        )

    def add(self, digests: DataFrame, batch: str | None = None) -> DataFrame:
        """Takes in a batch of (doc_id, text_sha256), and returns its digests with novel, and with keep_id and
        group_size over this and all other batches.

        A batch of an id that the index has already replaces the earlier one.
        """
        batch = batch or uuid.uuid4().hex
        if not re.fullmatch(r"[\w-]+", batch):
            raise ValueError("a batch's id is made of letters, digits, _ and -")
        groups = written(
            digests.groupBy("text_sha256").agg(F.max("doc_id").cast("long").alias("_keep"), F.count("*").alias("_size")),
            "digest-groups",
        )
        if not self.spark.catalog.tableExists(self.name):
            self._create(groups.count())
        others = self.rows().where(F.col("batch") != batch).drop("novel", "batch").hint("merge")
        new = groups.join(others, "text_sha256", "left_anti")
        new = new.select("*", F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"), F.lit(True).alias("novel"))
        seen = groups.join(others, "text_sha256").groupBy("text_sha256", "_keep", "_size").agg(
            F.greatest("_keep", F.max("keep_id")).alias("keep_id"), (F.col("_size") + F.sum("group_size")).alias("group_size"),
            F.lit(False).alias("novel"))
        found = written(new.unionByName(seen), "digest-batch")  # the joins have read the table before it is written to
        part = found.select("text_sha256", F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"), "novel")
        self.spark.sql(f"INSERT OVERWRITE TABLE {self.name} PARTITION (batch = '{batch}') SELECT * FROM {{part}}",
                       part=part.repartition(self._buckets(), "text_sha256"))
        return found.drop("_keep", "_size")

    def _buckets(self) -> int:
        described = self.spark.sql(f"DESCRIBE FORMATTED {self.name}").where("col_name = 'Num Buckets'")
        return int(described.first()["data_type"])

    def groups(self) -> DataFrame:
        """One row per digest: the largest doc_id and the number of rows over all batches. Bucketing saves a shuffle."""
        return self.rows().groupBy("text_sha256").agg(
            F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
        )

    def forget(self) -> None:
        """Takes the table's name out of the catalog; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, text: str = "text", batch: str | None = None) -> DataFrame:
    """docs with text_sha256, keep_id, group_size and kept; docs is taken into the index (by default one of its own).

    Of equal texts, in docs and in the index, the row with the largest doc_id stays. Rows with a null doc_id count
    in group_size and are kept only if the whole group has none; of repeated rows with the same id, every one says
    kept. Clashing columns of docs are replaced. No rows in, no rows out.
    """
    docs = docs.drop("text_sha256", "keep_id", "group_size", "kept").withColumn("text_sha256", digest(text))
    used = index or DigestIndex(docs.sparkSession)
    found = used.add(docs.select("doc_id", "text_sha256"), batch).drop("novel")
    if index is None:
        used.forget()
    # found is a written table without buckets: both sides are dealt out and a hot digest's rows can be split
    return docs.join(found, "text_sha256").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def op4_digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return exact_dedup(docs.select("doc_id", "text")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
