"""Digests of whole sets, whatever their size and partitioning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Levels above the leaves; with 256 branches each they suffice for leaf * 256^3 items.
LEVELS = 3


def tree_digest(rows: DataFrame, by: list[str], item: str, leaf: int = 4096) -> DataFrame:
    """(by, digest, items): the SHA-256 of each group's distinct items, sorted and joined by |.

    In a group of more than `leaf` items these fall into ranges of their own digests, by the first two, four or six
    hex digits; each range is digested alike, and 256 neighbouring ranges at a time make one of the level above. So no
    task holds more than about a leaf of items. Null items don't count; a group without any has no row.
    """
    distinct = rows.where(F.col(item).isNotNull()).select(*by, F.col(item).cast("string").alias("_item")).distinct()
    sizes = distinct.groupBy(*by).agg(F.count("*").alias("items"))
    depth = reduce(lambda a, b: a + b, [(F.col("items") > leaf * 256**k).cast("int") for k in range(LEVELS)])
    sized = distinct.join(sizes, by).select(*by, "items", "_item", F.substring(F.sha2("_item", 256), F.lit(1), 2 * depth).alias("_path"))
    joined = lambda c: F.sha2(F.array_join(c, "|"), 256).alias("digest")
    nodes = sized.groupBy(*by, "items", "_path").agg(joined(F.array_sort(F.collect_list("_item"))))
    for size in range(2 * LEVELS, 0, -2):
        up = nodes.where(F.length("_path") == size).groupBy(*by, "items", F.substring("_path", 1, size - 2).alias("_path"))
        made = up.agg(joined(F.transform(F.array_sort(F.collect_list(F.struct("_path", "digest"))), lambda x: x["digest"])))
        nodes = nodes.where(F.length("_path") != size).unionByName(made)
    return nodes.select(*by, "digest", "items")
