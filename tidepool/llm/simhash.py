"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints at most 2r bits apart have a variant in common that is at most r bits from either. Every
distinct fingerprint emits all its variants within r = distance // 2 bits; equal variants meet, and meeting
fingerprints are verified. All variants of one fingerprint that share their leading bits travel as one row
(leading bits, fingerprint) and are spelled out where they arrive, so the shuffle carries C(b,0)+C(b,1)+C(b,2)
rows for each fingerprint instead of 2081, with the same collisions.

Leading bits that too many fingerprints share are extended, level by level, up to the whole variant, which by
geometry at most 2081 distinct fingerprints can share. Fingerprints that meet in one variant are linked as a
star, which joins the same components as all pairs would.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.components import least_member
from tidepool.llm.shared import map_batches, table, written

_BITS = 64


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """Bit majority of the XXH64 of all word shingles, as a signed 64-bit number; no words: 0."""
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    n = max(1, len(parts) - words + 1)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends - sizes + 1)[:n].tolist()
    stops = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(_BITS, np.int64)
    for at in range(0, n, 16384):
        h = [digest(joined[a:b], seed) for a, b in zip(starts[at : at + 16384], stops[at : at + 16384])]
        ones += np.unpackbits(np.array(h, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    docs = docs.drop("fp")
    keep = docs.columns if keep is None else keep

    def make():
        def work(batch):
            texts = batch.column(text).to_pylist()
            known = {t: fingerprint(t) for t in set(texts)}
            return None, [[known[t] for t in texts]]

        return work

    return map_batches(docs.select(*dict.fromkeys([*keep, text])), make, "fp long", keep, rows=2000)


def masks(bits: int, most: int) -> list[np.ndarray]:
    """For each weight 0..most, all masks of that weight over so many low bits."""
    one = [1 << i for i in range(bits)]
    return [np.array([sum(c) for c in combinations(one, w)], np.uint64) for w in range(most + 1)]


def _weight(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def emit(df: DataFrame, done: int, bits: int, radius: int) -> DataFrame:
    """Rows (key, fp) to rows with bits more leading bits of the variants; key holds the first `done` bits."""

    def run(batches):
        import pyarrow as pa

        every = np.concatenate(masks(bits, radius))
        cost = _weight(every)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                fp = part.column("fp").to_numpy().view(np.uint64)
                key = part.column("key").to_numpy().view(np.uint64)
                spent = _weight(key ^ (fp >> np.uint64(_BITS - done))) if done else np.zeros(len(fp), np.int64)
                following = (fp >> np.uint64(_BITS - done - bits)) & np.uint64((1 << bits) - 1)
                row, mask = np.nonzero(spent[:, None] + cost[None, :] <= radius)
                new = (key[row] << np.uint64(bits)) | (following[row] ^ every[mask])
                yield pa.RecordBatch.from_arrays([pa.array(new.view(np.int64)), pa.array(fp[row].view(np.int64))], ["key", "fp"])

    return df.select("key", "fp").mapInArrow(run, "key long, fp long")


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, least node of its component) that connect what the pairs (a, b) connect."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            return nodes[new != np.arange(len(nodes))], nodes[new[new != np.arange(len(nodes))]]
        label = new


def collide(rows: DataFrame, done: int, radius: int, distance: int, partitions: int, block: int = 2_000_000) -> DataFrame:
    """Spells out the variants under each key, and links fingerprints that meet in one and pass verification."""
    low = _BITS - done

    def meet(key: np.ndarray, fp: np.ndarray):
        owners, variants = [], []
        spent = _weight(key ^ (fp >> np.uint64(low)))
        tail = fp & np.uint64((1 << low) - 1)
        for s in range(radius + 1):
            at = np.flatnonzero(spent == s)
            flips = np.concatenate(masks_low[: radius - s + 1])
            variants.append(((key[at] << np.uint64(low)) | tail[at])[:, None] ^ flips[None, :])
            owners.append(np.repeat(at, len(flips)))
        variant, owner = np.concatenate([v.ravel() for v in variants]), np.concatenate(owners)
        order = np.argsort(variant)
        variant, owner = variant[order], owner[order]
        same = np.flatnonzero(variant[1:] == variant[:-1])
        if not len(same):
            return None
        first = np.flatnonzero(np.append(True, variant[1:] != variant[:-1]))
        head = first[np.searchsorted(first, same, side="right") - 1]
        a, b = fp[owner[head]], fp[owner[same + 1]]
        near = (a != b) & (_weight(a ^ b) <= distance)
        return _forest(a[near], b[near]) if near.any() else None

    masks_low = masks(low, radius)
    most = sum(map(len, masks_low))

    def cut(key: np.ndarray, fp: np.ndarray, last: bool):
        """Blocks of whole keys; the rows of the last key wait for the next batch."""
        edges = [*np.flatnonzero(np.append(True, key[1:] != key[:-1])).tolist(), *[len(key)] * last]
        at = 0
        for i, e in enumerate(edges):
            if e > at and (i == len(edges) - 1 or (edges[i + 1] - at) * most > block):
                yield key[at:e], fp[at:e]
                at = e
        return key[at:], fp[at:]

    def run(batches):
        import pyarrow as pa

        key, fp = np.empty(0, np.uint64), np.empty(0, np.uint64)

        def found(last):
            nonlocal key, fp
            blocks = cut(key, fp, last)
            while True:
                try:
                    links = meet(*next(blocks))
                except StopIteration as end:
                    key, fp = end.value
                    return
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in links], ["a", "b"])

        for batch in batches:
            key = np.concatenate([key, batch.column("key").to_numpy().view(np.uint64)])
            fp = np.concatenate([fp, batch.column("fp").to_numpy().view(np.uint64)])
            yield from found(False)
        if len(key):
            yield from found(True)

    dealt = rows.repartition(partitions, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "a long, b long")


def near_links(fps: DataFrame, distance: int = 4, mean_group: int = 4000, most: int = 8_000_000) -> DataFrame:
    """Links (a, b) that connect exactly the distinct fingerprints (column fp) at most `distance` bits apart.

    most bounds the variants that are spelled out under one key: a key with more is extended by further bits.
    """
    spark = fps.sparkSession
    radius, n = distance // 2, fps.count()
    if 2 * radius != distance:
        raise ValueError("distance must be even: variants meet half way")
    bits = 16
    while bits < 32 and n * (1 + bits + bits * (bits - 1) // 2) / 2**bits > mean_group:
        bits += 4
    rows = emit(fps.select(F.lit(0).cast("long").alias("key"), "fp"), 0, bits, radius)
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 50_000)
    links, done = [], bits
    while True:
        each = sum(map(len, masks(_BITS - done, radius)))
        crowded = written(rows.groupBy("key").count().where(F.col("count") > most // each).select("key"), "crowded")
        if done == _BITS or crowded.isEmpty():
            links.append(collide(rows, done, radius, distance, partitions))
            break
        rows = written(rows, "variants")
        links.append(collide(rows.join(crowded, "key", "left_anti"), done, radius, distance, partitions))
        step = min(16, _BITS - done)
        rows = emit(rows.join(crowded, "key", "left_semi"), done, step, radius)
        done += step
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", distance: int = 4,
                    keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns keep) with fp (fingerprint as a signed long) and component_id.

    component_id is the smallest doc_id among all documents reachable over links of at most `distance` bits.
    Null and empty texts have fingerprint 0 and link as any other. Null doc_ids take no part in the minimum.
    Equal fingerprints are one node from the start, so groups of copies cost one row. Columns of docs named fp
    or component_id are replaced. No rows in, no rows out.
    """
    docs = docs.drop("fp", "component_id")
    keep = docs.columns if keep is None else keep
    marked = written(with_fingerprint(docs, text, keep), "fingerprints")
    nodes = written(marked.groupBy("fp").agg(F.min(doc_id).alias("_least")), "nodes")
    members = least_member(near_links(nodes.select("fp"), distance))
    node = nodes.join(members.withColumnRenamed("node", "fp"), "fp", "left")
    node = node.select("fp", F.coalesce("component", "fp").alias("component"), "_least")
    least = node.groupBy("component").agg(F.min("_least").alias("component_id"))
    ids = written(node.join(least, "component").select("fp", "component_id"), "component-ids")
    return marked.join(ids, "fp")


def op10_ball_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
