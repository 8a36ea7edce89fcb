"""Ranking building blocks: every operator works on a batch of queries keyed by query_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepool.settings import DEFAULTS


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def top_k(df: DataFrame, k: int, by: tuple[str, ...] = ("query_id",), order: tuple[Column, ...] | None = None) -> DataFrame:
    """The k best rows of each group by (score desc, locator), with their rank. Spark prunes before the shuffle."""
    order = order or (F.desc("score"), F.col("locator"))
    return ranked(df, list(by), list(order)).where(F.col("rank") <= k)


def reciprocal_rank_fusion(lists: list[tuple[DataFrame, float]], k: int = DEFAULTS.rrf_k, limit: int | None = None) -> DataFrame:
    """Weighted RRF of ranked lists (query_id, locator, rank): sum of weight / (k + rank), divided by the query's best.

    Terms are added in the order of the lists, so that the sum does not depend on how rows were shuffled.
    """
    terms = None
    for i, (ranked_list, weight) in enumerate(lists):
        own = ranked_list.select("query_id", "locator", F.lit(i).alias("list"), rank_term(F.lit(float(weight)), k).alias("term"))
        terms = own if terms is None else terms.unionByName(own)
    return fused(terms, limit)


def rank_term(weight: Column, k: int = DEFAULTS.rrf_k) -> Column:
    return weight / (F.lit(k) + F.col("rank"))


def fused(terms: DataFrame, limit: int | None = None) -> DataFrame:
    """Terms (query_id, locator, list, term) summed by locator and divided by the query's best sum."""
    ordered = F.array_sort(F.collect_list(F.struct("list", "term")))
    total = F.aggregate(ordered, F.lit(0.0), lambda acc, x: acc + x["term"])
    summed = terms.groupBy("query_id", "locator").agg(total.alias("raw"))
    best = F.max("raw").over(Window.partitionBy("query_id"))
    scored = summed.withColumn("score", F.col("raw") / best).drop("raw")
    return top_k(scored, limit) if limit else ranked(scored, ["query_id"], [F.desc("score"), F.col("locator")])


def within(scores: DataFrame, k: int, slack: float) -> DataFrame:
    """The scores (query_id, locator, score) that may still be among a query's k best when each is raised by up to slack."""
    least = top_k(scores, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("_least"))
    near = scores.join(least, "query_id", "left").where((F.col("score") >= F.col("_least") - slack) | F.col("_least").isNull())
    return near.drop("_least")


def coverage_first(df: DataFrame, document: str = "document_id") -> DataFrame:
    """The best row of each document first, then the others, both in rank order. Adds position."""
    nth = F.row_number().over(Window.partitionBy("query_id", document).orderBy("rank"))
    first = df.withColumn("_later", (nth > 1).cast("int"))
    return ranked(first, ["query_id"], [F.col("_later"), F.col("rank")], "position").drop("_later")


def round_robin(df: DataFrame, asset: str, within: list[Column], cap: int) -> DataFrame:
    """Depth by depth across assets sorted by id, up to cap rows for each query."""
    deep = ranked(df, ["query_id", asset], within, "depth")
    return ranked(deep, ["query_id"], [F.col("depth"), F.col(asset)], "position").where(F.col("position") <= cap)
