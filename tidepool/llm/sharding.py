"""Sharding by histogram sort: count exact bytes below probes, refine the probes, then exchange once.

The sort key is (xxhash64(text), doc_id), so equal texts lie together. A histogram over equal-width
key ranges ("cells") gives exact rows and bytes below every cell boundary. Cells that a shard boundary
cuts by more than the tolerance, and cells too large to be ranked by one task, are probed again inside
the range of keys they really hold: by hash first and, where one text fills the cell, by doc_id. A large cell
gets probes in proportion to its size, so what the driver holds and broadcasts is bounded by parameters, never by
the rows: at most 2**17 cells to begin with and, in a round, 10 * spread + shards * fan more, with spread at most
2**15; at some 60 bytes a cell that is less than 30 MB.

Only DataFrame functions are used: no UDF, no RDD.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepool.llm.shared import inline_table, table, written

_STATS = ("rows", "bytes", "h_min", "h_max", "d_min", "d_max")
_SPLIT = "_path string, _kind string, _lo decimal(20,0), _width decimal(20,0)"
_LEAST = -(2**63)


def _first_cell(bits: int) -> Column:
    digits = (bits + 3) // 4
    return F.lpad(F.hex(F.shiftrightunsigned("_h", 64 - bits)), digits, "0")


def _refine(keys: DataFrame, splits: DataFrame, how: str) -> DataFrame:
    """Appends one two-digit probe index to the cells named in splits."""
    at = F.when(F.col("_kind") == "h", F.col("_h")).otherwise(F.col("_d")).cast("decimal(20,0)")
    index = F.floor((at - F.col("_lo")) / F.col("_width")).cast("long")
    cell = F.when(F.col("_kind").isNull(), F.col("_cell")).otherwise(F.concat("_cell", F.lpad(F.hex(index), 2, "0")))
    joined = keys.join(F.broadcast(splits), F.col("_cell") == F.col("_path"), how)
    return joined.withColumn("_cell", cell).drop("_path", "_kind", "_lo", "_width")


def _histogram(keys: DataFrame) -> dict[str, dict]:
    counted = keys.groupBy("_cell").agg(
        F.count("*").alias("rows"), F.sum("_size").alias("bytes"),
        F.min("_h").alias("h_min"), F.max("_h").alias("h_max"),
        F.min("_d").alias("d_min"), F.max("_d").alias("d_max"),
    )
    return {r["_cell"]: {k: r[k] for k in _STATS} for r in counted.collect()}


def _heavy(cells: dict[str, dict], shards: int, tolerance: float, spread: int, fan: int) -> dict[str, int]:
    """Cells to probe again and into how many: cut by a shard boundary beyond the tolerance, or too large for one task."""
    rows, total = (sum(c[k] for c in cells.values()) for k in ("rows", "bytes"))
    found, before = {}, 0
    for path in sorted(cells):
        c = cells[path]
        after = before + c["bytes"]
        cut = before * shards // max(total, 1) != (after - 1) * shards // max(total, 1)
        size = max(c["rows"] / max(1, rows / spread), c["bytes"] * spread / max(total, 1))
        one_key = c["h_min"] == c["h_max"] and c["d_min"] == c["d_max"]
        if not one_key and c["rows"] > 1 and (size > 1 or cut and c["bytes"] > tolerance * total / shards):
            found[path] = fan if cut else min(fan, int(4 * size) + 1)
        before = after
    return found


def plan_splitters(keys: DataFrame, shards: int, tolerance: float, spread: int, first_bits: int, fan: int):
    """Rounds of probing over the narrow key table. Returns the splits of each round and the final cells."""
    spark = keys.sparkSession
    keys = keys.withColumn("_cell", _first_cell(first_bits))
    cells, rounds = _histogram(keys), []
    while heavy := _heavy(cells, shards, tolerance, spread, fan):
        splits = []
        for path, probes in heavy.items():
            c = cells.pop(path)
            kind, lo, hi = ("h", c["h_min"], c["h_max"]) if c["h_min"] < c["h_max"] else ("d", c["d_min"], c["d_max"])
            splits.append({"_path": path, "_kind": kind, "_lo": lo, "_width": -(-(hi - lo + 1) // probes)})
        rounds.append(splits)
        keys = _refine(keys, inline_table(spark, splits, _SPLIT), "inner")
        cells |= _histogram(keys)
    return rounds, cells


def shard_documents(
    docs: DataFrame, shards: int = 16, text: str = "text", doc_id: str = "doc_id",
    tolerance: float = 0.005, cell_bytes: int = 128 << 20, fan: int = 64,
) -> DataFrame:
    """All rows of docs with size (UTF-8 bytes + 1), shard (0..shards-1) and slot (gapless from 0 in a shard).

    Shards take contiguous key ranges of nearly equal size: each differs from total/shards by at most the
    tolerance or one document, whichever is more. A task ranks a cell of about cell_bytes, as long as 2**17 cells
    suffice, and larger ones beyond. Null texts count as empty, null ids sort first; repeated
    rows (same text and id) stay in one shard in any order; no rows in, no rows out. Columns of docs named
    size, shard or slot are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("size", "shard", "slot")
    content = F.coalesce(F.col(text), F.lit(""))
    keyed = {
        "_h": F.xxhash64(content), "_d": F.coalesce(F.col(doc_id).cast("long"), F.lit(_LEAST)),
        "_size": (F.octet_length(content) + 1).cast("long"),
    }
    keys = written(docs.select(*[c.alias(k) for k, c in keyed.items()]), "shard-keys")
    total = keys.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]
    first_bits = min(17, max(12, (total // cell_bytes).bit_length()))
    rounds, cells = plan_splitters(keys, shards, tolerance, 2**first_bits // 4, first_bits, fan)
    places, before, filled = [], 0, [0] * shards
    for path in sorted(cells):
        c = cells[path]
        shard = min(shards - 1, (2 * before + c["bytes"]) * shards // (2 * total))
        places.append({"_place": path, "shard": shard, "_base": filled[shard]})
        filled[shard] += c["rows"]
        before += c["bytes"]
    out = docs.withColumns(keyed).withColumn("_cell", _first_cell(first_bits))
    for splits in rounds:
        out = _refine(out, inline_table(spark, splits, _SPLIT), "left")
    placed = inline_table(spark, places, "_place string, shard int, _base long")
    out = out.join(F.broadcast(placed), F.col("_cell") == F.col("_place"))
    rank = F.row_number().over(Window.partitionBy("_cell").orderBy("_h", "_d"))
    out = out.withColumn("slot", (F.col("_base") + rank - 1).cast("long"))
    return out.withColumnRenamed("_size", "size").drop("_h", "_d", "_cell", "_place", "_base")


def op1_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard under the law `bytes`."""
    sharded = shard_documents(table(spark, sf_dir, "documents"))
    return sharded.select(
        "doc_id", "size",
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
