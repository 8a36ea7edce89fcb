"""Tables by name, tenant scoping, and the driver tables in the roles of the retrieval model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Catalog:
    """Parquet tables below a folder. Columns and filters are pruned by Spark at each use."""

    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def views(self, *names: str) -> None:
        for name in names:
            self.table(name).createOrReplaceTempView(name)

    # --- roles ---

    def chunks(self) -> DataFrame:
        """Documents as one chunk each; title and section are the first characters of the text."""
        d = spread(self.table("documents"))
        return d.select(
            F.concat(F.lit("document:"), "doc_id", F.lit(":chunk:0")).alias("locator"), F.col("doc_id"),
            F.col("doc_id").cast("string").alias("document_id"), "source", F.lit(0).alias("ordinal"), F.substring("text", 1, 60).alias("title"),
            F.substring("text", 61, 60).alias("section"), F.col("lang").alias("source_type"), F.col("text").alias("content"))

    def questions(self, part: str = "all") -> DataFrame:
        """Benchmark passages as questions: whole, or their first or last 200 characters."""
        b = self.table("benchmark")
        text = {"all": F.col("text"), "first": F.substring("text", 1, 200), "last": F.right("text", F.lit(200))}[part]
        return b.select(F.col("item_id").alias("query_id"), text.alias("query"))

    def lines(self) -> DataFrame:
        """Lines of documents as chunks with ordinals."""
        d = self.table("documents").select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("ordinal", "content"))
        return d.select(
            F.col("doc_id").alias("document_id"), "ordinal", F.col("lang").alias("section"), "content",
            F.format_string("document:%d:chunk:%d", "doc_id", "ordinal").alias("locator"))

    def governed(self) -> DataFrame:
        """Governance facts of labelled documents, derived from their ids and labels."""
        lab = self.table("labels")
        start = F.lit("2026-01-01").cast("timestamp_ntz")
        days = lambda n: start + F.make_dt_interval(F.expr(n).cast("int"))
        return lab.select(
            F.col("doc_id").cast("string").alias("document_id"),
            F.when(F.col("quality") == 1, "verified").otherwise("unverified").alias("trust_level"),
            F.when(F.col("toxic") == 1, "conflicted").otherwise("none").alias("conflict_state"),
            days("doc_id % 400").alias("effective_at"), days("doc_id % 700").alias("expires_at"), F.lit("indexed").alias("status"),
            F.when(F.col("doc_id") % 11 == 0, (F.col("doc_id") - 7).cast("string")).alias("supersedes_document_id"))

    def relations(self) -> DataFrame:
        """Parts and suppliers as entities, joined by line items; confidence from quantity and discount."""
        li = self.table("lineitem")
        return li.select(
            F.concat(F.lit("p"), "l_partkey").alias("source_id"), F.concat(F.lit("s"), "l_suppkey").alias("target_id"),
            (F.col("l_quantity") / 50 * F.col("l_discount") * 10).alias("confidence"),
            F.format_string("document:%d:chunk:%d", "l_orderkey", "l_linenumber").alias("locator"))


def spread(table: DataFrame) -> DataFrame:
    """A table of fewer splits than there are cores, dealt out anew; larger ones as they are. For plain scans."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= cores else table.repartition(cores)


def scoped(df: DataFrame, workspace_id: str | None) -> DataFrame:
    """Rows of one workspace; without one, none."""
    return df.where(F.lit(False)) if workspace_id is None else df.where(F.col("workspace_id") == workspace_id)


def require_ready(bases: DataFrame) -> DataFrame:
    """bases, failing where an index isn't ready or of another revision than the embedding."""
    bad = (F.col("index_status") != "ready") | (F.col("index_revision") != F.col("embedding_revision"))
    return bases.withColumn("index_status", F.when(bad, F.raise_error(F.concat(F.lit("index not ready: "), "kb_id")).cast("string")).otherwise(F.col("index_status")))


#: Roles in ascending order.
ROLES = ("viewer", "editor", "approver", "owner")


def has_role(role, least: str):
    return F.array_position(F.array(*map(F.lit, ROLES)), role) >= ROLES.index(least) + 1
