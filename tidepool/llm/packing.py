"""Best-fit packing planned on the length histogram.

Documents are tokenized, cut into pieces of at most `capacity` tokens and written once. Best-fit decreasing
then runs over the counts of lengths (at most `capacity` of them) and gives runs of planned slots: so many
pieces of one length, so many to a sequence, from this sequence and offset on. Pieces take the slots by
joining on their rank within their length.

The rank needs no sort of a length's pieces: a task numbers its own pieces of each length as it writes them,
and a window over one row per task and length adds what earlier tasks hold.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepool.llm.bpe import encoder, packed
from tidepool.llm.shared import inline_table, map_batches, table, written

_RUN = "length long, rank_from long, rank_to long, per_bin long, first_bin long, first_offset long"


def plan_runs(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: runs (length, rank_from, rank_to, per_bin, first_bin, first_offset).

    Bins filled alike are one entry (first_bin, how many), so the work and the result depend on the number of
    different lengths, not on the number of pieces. A piece goes to the fullest bin that it fits, which after
    one piece is the same bin until no more fit.
    """
    runs: list[tuple[int, int, int, int, int, int]] = []
    alike: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> [(first bin, bins)]
    rooms: list[int] = []
    bins = 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            if not alike[room]:
                insort(rooms, room)
            alike[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = alike[room].pop()
                if not alike[room]:
                    rooms.pop(at)
            else:
                room, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            each = room // length
            full = min(n, left // each)
            rest = min(left - full * each, each) if full < n else 0
            for b, k, per in ((first, full, each), (first + full, int(rest > 0), rest)):
                if k:
                    runs.append((length, rank, rank + k * per, per, b, capacity - room))
                    put(room - per * length, b, k)
                    rank, left = rank + k * per, left - k * per
            untouched = n - full - int(rest > 0)
            put(room, first + n - untouched, untouched)
    return runs


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, text: str, keep: list[str]) -> DataFrame:
    """One row per piece: keep, piece, start, length, ids, and the piece's number among its task's of that length."""

    def make():
        coder, task, seen = encoder(path, by_library=True), TaskContext.get().partitionId(), Counter()

        def work(batch):
            flat, sizes = coder.encode(batch.column(text).to_pylist())
            ids = np.full(len(flat) + len(sizes), end_id, np.uint32)
            ids[np.arange(len(flat)) + np.repeat(np.arange(len(sizes)), sizes)] = flat
            sizes = sizes + 1
            pieces = -(-sizes // capacity)
            owner = np.repeat(np.arange(len(sizes)), pieces)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            length = np.minimum(capacity, sizes[owner] - piece * capacity)
            number = []
            for n in length.tolist():
                number.append(seen[n])
                seen[n] += 1
            return owner, [piece, piece * capacity, length, packed(ids, length), np.full(len(owner), task), number]

        return work

    added = "piece int, start long, length long, ids binary, _task int, _number long"
    return map_batches(docs.select(*dict.fromkeys([*keep, text])), make, added, keep, rows=500, keeps=True)


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, text: str = "text",
                   keep: list[str] | None = None, carry: dict[str, Column] | None = None) -> DataFrame:
    """Packs every document (its ids, then end_id) into as few sequences of at most capacity tokens as best fit finds.

    Returns keep (all other columns of docs by default), piece, start, length, what carry makes of each piece's
    ids (by default the ids themselves, packed little-endian unsigned 32-bit), sequence_id and offset. Only documents over capacity are cut. Null and empty texts are one
    piece of end_id alone; repeated rows are packed each for itself; clashing columns of docs are replaced.
    """
    docs = docs.drop("piece", "start", "length", "ids", "sequence_id", "offset")
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    carry = {"ids": F.col("ids")} if carry is None else carry
    pieces = token_pieces(docs, path, capacity, end_id, text, keep)
    own = [*keep, "piece", "start", "length"]
    pieces = written(pieces.select(*own, "_task", "_number", *[c.alias(k) for k, c in carry.items()]), "pieces")
    in_task = pieces.groupBy("length", "_task").agg(F.count("*").alias("_n"))
    counts = {r["length"]: r["n"] for r in in_task.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    runs = [dict(zip(("length", "rank_from", "rank_to", "per_bin", "first_bin", "first_offset"), r))
            for r in plan_runs(counts, capacity)]
    plan = inline_table(docs.sparkSession, runs, _RUN).withColumnRenamed("length", "_length")
    earlier = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    base = in_task.select("length", "_task", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    ranked = pieces.join(base, ["length", "_task"]).withColumn("_rank", F.col("_base") + F.col("_number"))
    in_run = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("rank_from")) & (F.col("_rank") < F.col("rank_to"))
    within = F.col("_rank") - F.col("rank_from")
    placed = ranked.join(F.broadcast(plan), in_run)  # bounded by the number of lengths, see plan_runs
    return placed.select(
        *own, *carry,
        (F.col("first_bin") + F.floor(within / F.col("per_bin"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + (within % F.col("per_bin")) * F.col("length")).cast("long").alias("offset"),
    )


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"],
                          carry={"ids_crc32": F.crc32("ids").cast("long")})
