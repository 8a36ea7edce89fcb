"""Near copies of embeddings with spherical-cap filters.

A filter is a direction made of one code word for each block of coordinates (a random product code, after a
seeded rotation); its cap holds the vectors whose inner product with it reaches a height. Every vector is
list-decoded to all directions whose caps hold it, by branch and bound over the blocks, so that far more filters
can be used than could be tried one by one. Vectors that share a filter are compared.

Height and number of filters follow from the number of vectors: a cap holds about `occupancy` unrelated vectors
at any size of the table, and two vectors exactly at the wanted cosine share `shared` filters of each code on average
(the wedge of two caps on the sphere, integrated). A vector's number of filters then grows only slowly with the table.
Filters of one code share their words, so whether two vectors meet varies more than by chance alone; several
independent codes even that out.

A pair that shares several filters counts in the first one alone: rows carry the filters before theirs. Tasks
give counts for each vector and a spanning forest of its links, never all pairs of a group.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.llm.components import least_member
from tidepool.llm.neighbours import cosines, usable
from tidepool.llm.shared import table, written
from tidepool.llm.simhash import _forest


@dataclass(frozen=True)
class Settings:
    """most_words bounds the code words of a block; filters with more than block_rows vectors are compared in
    pairs of blocks, each pair a task's work of its own. Keys of crowded filters are broadcast up to most_broadcast.
    """

    occupancy: float = 16.0
    shared: float = 3.0
    codes: int = 8
    most_words: int = 4096
    block_rows: int = 1024
    most_broadcast: int = 100_000
    seed: int = 13


def _tail(dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x in [0, 1], the density there of a coordinate of a random unit vector, and the share of vectors beyond x."""
    x = np.linspace(0, 1, 200_001)
    density = np.exp((dims - 3) / 2 * np.log1p(-np.minimum(x * x, 1 - 1e-16)))
    steps = (density[1:] + density[:-1]) / 2 * (x[1] - x[0])
    beyond = np.append(np.cumsum(steps[::-1])[::-1], 0)
    return x, density / (2 * beyond[0]), beyond / (2 * beyond[0])


@dataclass(frozen=True)
class Plan:
    """dims after padding, blocks of a product code, code words a block, height of a cap, filters of a code a vector expects."""

    dims: int
    blocks: int
    words: int
    height: float
    filters: float


@lru_cache(maxsize=64)
def planned(dims: int, vectors: int, similarity: float, s: Settings) -> Plan:
    padded = max(32, 1 << (dims - 1).bit_length())
    x, density, beyond = _tail(padded)
    share = min(0.05, s.occupancy / max(vectors, 1))
    height = float(np.interp(-share, -beyond, x))
    a, p, (y, _, rest) = x[x >= height], density[x >= height], _tail(padded - 1)
    need = (height - similarity * a) / np.maximum(np.sqrt((1 - similarity**2) * (1 - a * a)), 1e-12)
    held = np.interp(np.abs(need), y, rest, right=0.0)
    held = np.where(need < 0, 1 - held, held)
    both = float((p * held).sum() / p.sum())  # the other vector is in a cap that holds the one
    filters = s.shared / both
    blocks = 2
    while (words := int(np.ceil((filters / share) ** (1 / blocks)))) > s.most_words:
        blocks += 1
    return Plan(padded, blocks, max(2, words), height, filters)


class Caps:
    """Rotation and code of a plan; the same seed gives the same ones in every task."""

    def __init__(self, plan: Plan, seed: list[int]):
        random = np.random.default_rng([*seed, plan.dims, plan.blocks, plan.words])
        self.plan, self.signs = plan, random.choice((-1.0, 1.0), (3, plan.dims))
        self.cuts = np.linspace(0, plan.dims, plan.blocks + 1).astype(int)
        words = [random.standard_normal((plan.words, b - a)) for a, b in zip(self.cuts, self.cuts[1:])]
        self.code = [w / np.linalg.norm(w, axis=1, keepdims=True) for w in words]

    def rotate(self, x: np.ndarray) -> np.ndarray:
        """Unit rows, padded with zeros, through three rounds of random signs and Hadamard transforms."""
        n, dims = len(x), self.plan.dims
        out = np.zeros((n, dims))
        out[:, : x.shape[1]] = x / np.sqrt((x * x).sum(1, keepdims=True))
        for signs in self.signs:
            out = out * signs
            h = 1
            while h < dims:
                pairs = out.reshape(n, -1, 2, h)
                out = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], 2).reshape(n, dims)
                h *= 2
            out = out / np.sqrt(dims)
        return out

    def decode(self, x: np.ndarray, rows: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of all caps that hold a row of x, rows in order."""
        found = [self._decode(x[i : i + rows], i) for i in range(0, len(x), rows)]
        return (np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64))

    def _decode(self, x: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
        turned = self.rotate(x)
        scores = [turned[:, a:b] @ c.T for a, b, c in zip(self.cuts, self.cuts[1:], self.code)]
        best = np.stack([s.max(1) for s in scores] + [np.zeros(len(x))], 1)
        rest = best[:, ::-1].cumsum(1)[:, ::-1]  # the most that a block and those after it can add
        least = self.plan.height * np.sqrt(self.plan.blocks)
        row, so_far, code = np.arange(len(x)), np.zeros(len(x)), np.zeros(len(x), np.int64)
        for i, s in enumerate(scores):
            sums = so_far[:, None] + s[row]
            at, word = np.nonzero(sums + rest[row, i + 1][:, None] >= least)
            row, so_far, code = row[at], sums[at, word], code[at] * self.plan.words + word
        return row + first, code


@lru_cache(maxsize=8)
def caps(dims: int, vectors: int, similarity: float, s: Settings) -> list[Caps]:
    return [Caps(planned(dims, vectors, similarity, s), [s.seed, i]) for i in range(s.codes)]


def decoded_by(codes: list[Caps], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(how many filters hold each row of x, the filters of row after row), the filters of all codes numbered through."""
    row, code = zip(*(c.decode(x) for c in codes))
    every = np.concatenate([f * len(codes) + i for i, f in enumerate(code)])
    row = np.concatenate(row)
    return np.bincount(row, minlength=len(x)), every[np.lexsort((every, row))]


def _matrix(column, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def list_decode(nodes: DataFrame, similarity: float, s: Settings) -> DataFrame:
    """nodes (node, vector, dims, copies, _n: vectors of that length) with filters, the caps that hold the vector."""
    schema = T.StructType([f for f in nodes.schema if f.name != "_n"] + [T.StructField("filters", T.ArrayType(T.LongType(), False))])

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            for size in pc.unique(batch.column("dims")).to_pylist():
                part = batch.filter(pc.equal(batch.column("dims"), size))
                own = caps(size, part.column("_n")[0].as_py(), similarity, s)
                sizes, code = decoded_by(own, _matrix(part.column("vector"), size))
                ends = np.append(0, np.cumsum(sizes)).astype(np.int32)
                kept = part.select([f.name for f in schema[:-1]])
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.ListArray.from_arrays(ends, code)], [f.name for f in schema])

    return nodes.mapInArrow(run, schema)


def _alike(x: np.ndarray, similarity: float) -> np.ndarray:
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    score = unit @ unit.T
    alike = score >= similarity
    for i, j in zip(*np.nonzero(np.abs(score - similarity) < 1e-12)):  # the products' own rounding doesn't decide
        alike[i, j] = cosines(x[i : i + 1], x[j : j + 1])[0, 0] >= similarity
    return alike


def meet(x: np.ndarray, copies: np.ndarray, side: np.ndarray | None, earlier: np.ndarray, ends: np.ndarray, similarity: float):
    """For rows that share a filter: (rows with links that count here, how many vectors each links, links' ends).

    A link counts where the two rows have no earlier filter (earlier, cut at ends) in common; with side, only
    links between the two sides do.
    """
    alike = _alike(x, similarity)
    np.fill_diagonal(alike, False)
    if side is not None:
        alike &= side[:, None] != side[None, :]
    some = np.flatnonzero(alike.any(1))
    if not len(some):
        return None
    size = np.diff(ends)[some]
    flat = np.concatenate([earlier[ends[i] : ends[i + 1]] for i in some])
    if len(flat):
        known, place = np.unique(flat, return_inverse=True)
        holds = np.zeros((len(some), len(known)), np.float32)
        holds[np.repeat(np.arange(len(some)), size), place] = 1
        new = alike[np.ix_(some, some)] & (holds @ holds.T == 0)
    else:
        new = alike[np.ix_(some, some)]
    a, b = np.nonzero(np.triu(new | new.T))
    return some, new @ copies[some], some[a], some[b]


def _compare(rows: DataFrame, similarity: float) -> DataFrame:
    """Rows sorted by their key (dims, filter, low, high) to (a, b, n): vectors, a link that connects each, how many it links."""

    def run(batches):
        import pyarrow as pa

        def found(part):
            node, copies = part.column("node").to_numpy(), part.column("copies").to_numpy()
            side = part.column("side").to_numpy() if part.column("low")[0] != part.column("high")[0] else None
            lists = part.column("earlier")
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            met = meet(_matrix(part.column("vector"), part.column("dims")[0].as_py()), copies, side, lists.flatten().to_numpy(), ends, similarity)
            if met is None:
                return None
            some, n, a, b = met
            near, root = _forest(node[a], node[b])
            order = np.argsort(near)
            mine = node[some[n > 0]]
            at = np.searchsorted(near[order], mine)
            inside = np.minimum(at, max(len(near) - 1, 0))
            other = np.where(near[order][inside] == mine, root[order][inside], mine) if len(near) else mine
            return pa.RecordBatch.from_arrays([pa.array(mine), pa.array(other), pa.array(n[n > 0])], ["a", "b", "n"])

        open_ = None
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = pa.Table.from_batches([batch] if open_ is None else [*open_.to_batches(), batch]).combine_chunks().to_batches()[0]
            key = np.stack([whole.column(c).to_numpy().astype(np.int64) for c in ("dims", "filter", "low", "high")])
            cuts = np.append(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1, whole.num_rows)
            at = 0
            for end in cuts[:-1].tolist():
                if end - at > 1 and (out := found(whole.slice(at, end - at))) is not None:
                    yield out
                at = end
            open_ = pa.Table.from_batches([whole.slice(at)])
        if open_ is not None and open_.num_rows > 1 and (out := found(open_.combine_chunks().to_batches()[0])) is not None:
            yield out

    return rows.mapInArrow(run, "a long, b long, n long")


def cap_links(nodes: DataFrame, similarity: float, s: Settings = Settings()) -> DataFrame:
    """(a, b, n) of distinct vectors (node, vector, dims, copies): a links n vectors here, b is one it is connected with.

    Sums of n over a vector count each link once. Every link has its ends in one component of (a, b).
    """
    spark = nodes.sparkSession
    lengths = nodes.groupBy("dims").agg(F.count("*").alias("_n"))
    decoded = written(list_decode(nodes.join(lengths, "dims").select("node", "vector", "dims", "copies", "_n"), similarity, s), "list-decoded")
    key = ["dims", "filter"]
    held = decoded.select("dims", F.explode("filters").alias("filter")).groupBy(*key).agg(F.count("*").alias("_k"))
    crowded = written(held.where(F.col("_k") > s.block_rows).select(*key, F.ceil(F.col("_k") / (s.block_rows // 2)).cast("int").alias("_of")), "crowded-caps")
    rows = decoded.select("node", "vector", "dims", "copies", "filters", F.posexplode("filters").alias("_at", "filter"))
    rows = rows.select("node", "vector", "dims", "copies", "filter", F.slice("filters", F.lit(1), F.col("_at")).alias("earlier"))
    none = F.lit(0)
    alone, n = rows, crowded.count()
    if n:
        names = F.broadcast(crowded) if n <= s.most_broadcast else crowded
        alone = rows.join(names.drop("_of"), key, "left_anti")
        dense = rows.join(names, key).withColumn("side", F.expr("CAST(pmod(xxhash64(node), _of) AS INT)"))
        dense = dense.withColumn("_other", F.explode(F.expr("sequence(0, _of - 1)")))
        dense = dense.withColumns({"low": F.least("side", "_other"), "high": F.greatest("side", "_other")}).drop("_of", "_other")
    alone = alone.withColumns({"side": none, "low": none, "high": none})
    every = alone.unionByName(dense) if n else alone
    by = ["dims", "filter", "low", "high"]
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return _compare(every.repartition(partitions, *by).sortWithinPartitions(*by), similarity)


def near_vectors(vectors: DataFrame, similarity: float = 0.9, settings: Settings = Settings(), vec_id: str = "vec_id",
                 vector: str = "embedding") -> DataFrame:
    """vectors with n_links, component_id and kept, by cosine in double precision.

    n_links counts the other vectors (rows) at least that similar, component_id is the smallest id reachable over such
    links, its own included, kept tells whether a row has that id. Vectors null, zero, or with null or non-finite
    components link with nothing, as do vectors of another length; their component is their own id. Exact copies are one
    node from the start. Null ids take no part in the minimum; repeated rows count as vectors of their own.
    Columns named like the three added ones are replaced. No rows in, no rows out.
    """
    if not 0 < similarity < 1:
        raise ValueError("similarity must be between 0 and 1")
    vectors = vectors.drop("n_links", "component_id", "kept")
    rows = vectors.withColumn("_vector", F.when(usable(vector), F.col(vector)))
    rows = rows.withColumn("_h", F.when(F.col("_vector").isNotNull(), F.xxhash64("_vector")))
    clean = rows.where("_h IS NOT NULL").groupBy("_h", F.col("_vector").alias("vector"))
    nodes = clean.agg(F.min(vec_id).alias("_least"), F.count("*").alias("copies"))
    nodes = written(nodes.select("_h", "vector", "_least", "copies", F.size("vector").alias("dims"), F.monotonically_increasing_id().alias("node")), "vectors")
    links = written(cap_links(nodes.select("node", "vector", "dims", "copies"), similarity, settings), "links")
    members = least_member(links).withColumnRenamed("component", "_c")
    node = nodes.select("node", "_least", "copies").join(members, "node", "left").withColumn("_c", F.coalesce("_c", "node"))
    linked = links.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("_n"))
    node = node.join(linked, "node", "left")
    node = node.join(node.groupBy("_c").agg(F.min("_least").alias("component_id")), "_c")
    node = written(node.select("node", "component_id", (F.coalesce("_n", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links")), "components")
    named = nodes.select("_h", F.col("vector").alias("_v"), "node").join(node, "node").drop("node")
    out = rows.join(named, (rows["_h"] == named["_h"]) & (rows["_vector"] == named["_v"]), "left")
    own = F.when(F.col("_v").isNull(), F.col(vec_id)).otherwise(F.col("component_id"))
    added = [F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.col(vec_id).eqNullSafe(own).alias("kept")]
    return out.select(*[vectors[c] for c in vectors.columns], *added)


def op13_cap_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", F.col("component_id").cast("long").alias("component_id"), "kept")


#: Brute force, for tables small enough to compare all pairs.
SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.9
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (SELECT a, min(b) AS c FROM reach GROUP BY a), counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, CAST(coalesce(c, e.vec_id) AS BIGINT) AS component_id,
       e.vec_id = coalesce(c, e.vec_id) AS kept
FROM embeddings e LEFT JOIN least ON least.a = e.vec_id LEFT JOIN counted ON counted.a = e.vec_id
"""
