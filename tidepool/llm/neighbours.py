"""Approximate nearest neighbours with a hierarchical k-means tree and best-bin-first traversal.

The top of the tree is fitted on a bounded sample of the vectors. Leaves that hold too many of all vectors are
split again in Spark, each by a bounded sample of its own, round after round until the wanted leaf size holds, so
the tree grows with the table and the driver keeps only its top. A query walks the top with a priority queue of
centres, nearest first; below it, the leaves that it reached are expanded and the nearest visited, in the same
order. How many a query visits is calibrated: for a bounded set of probe queries the true neighbours are found by
comparing with every vector, and the visits are widened until the wanted share of them is reached.

The search is a join of queries with whole leaves, many to a task, in blocks of bounded size on either side.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepool.llm.shared import inline_table, table, written


@dataclass(frozen=True)
class Settings:
    """sample_rows bounds what the top of the tree is fitted on, split_rows what a leaf is split by, probes the
    queries that visits are calibrated with. Leaves of more than twice leaf_rows are split.
    """

    sample_rows: int = 20_000
    split_rows: int = 4096
    branching: int = 8
    leaf_rows: int = 64
    rounds: int = 8
    probes: int = 200
    recall: float = 0.93
    block_rows: int = 4096
    seed: int = 11


@dataclass
class Tree:
    """centre of each node, children of inner nodes, leaf number of leaves."""

    centres: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)
    leaves: int = 0

    def _node(self, centre: np.ndarray) -> int:
        self.centres.append(centre)
        self.children.append([])
        self.leaf.append(-1)
        return len(self.leaf) - 1

    def descend(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each (unit) vector: at every node the nearest child's."""
        out, todo = np.zeros(len(vectors), np.int64), [(0, np.arange(len(vectors)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            kids = self.children[node]
            near = _nearest(vectors[rows], np.stack([self.centres[k] for k in kids]))
            todo += [(k, rows[near == i]) for i, k in enumerate(kids) if (near == i).any()]
        return out

    def visit(self, vector: np.ndarray, visits: int, sizes: np.ndarray, least: int) -> list[tuple[int, float]]:
        """Leaves and their distances, best bin first: so many, and on until they hold `least` vectors."""
        queue, out, held = [(0.0, 0)], [], 0
        while queue and (len(out) < visits or held < least):
            d, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                if sizes[self.leaf[node]]:
                    out.append((self.leaf[node], d))
                    held += sizes[self.leaf[node]]
                continue
            for k in self.children[node]:
                heapq.heappush(queue, (float(((self.centres[k] - vector) ** 2).sum()), k))
        return out


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1)[None, :] - 2 * x @ centres.T).argmin(1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def fit_tree(sample: np.ndarray, s: Settings) -> Tree:
    """Hierarchical k-means over unit vectors; clusters of at most leaf_rows, or of one point, are leaves."""
    random, tree = np.random.default_rng(s.seed), Tree()
    todo = [(tree._node(sample.mean(0)), np.arange(len(sample)))]
    while todo:
        node, rows = todo.pop()
        x = sample[rows]
        parts = []
        if len(rows) > s.leaf_rows and (x != x[0]).any():
            ways = min(s.branching, max(2, 2 * len(x) // s.leaf_rows))
            centres = x[random.choice(len(x), min(ways, len(x)), replace=False)]
            for _ in range(s.rounds):
                near = _nearest(x, centres)
                centres = np.stack([x[near == i].mean(0) if (near == i).any() else c for i, c in enumerate(centres)])
            near = _nearest(x, centres)
            parts = [(i, rows[near == i]) for i in range(len(centres)) if (near == i).any()]
        if len(parts) < 2:
            tree.leaf[node] = tree.leaves
            tree.leaves += 1
            continue
        for i, own in parts:
            child = tree._node(centres[i])
            tree.children[node].append(child)
            todo.append((child, own))
    return tree


def usable(vector: str) -> Column:
    """Not null, not zero, no null or non-finite component."""
    v = F.col(vector)
    ok = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(ok, F.lit(False))


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column]) if len(column) else np.empty((0, 0))


def _arrow_matrix(column, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All cosines of rows of a with rows of b; components are added in order, so equal vectors score equal."""
    dot, na, nb = np.zeros((len(a), len(b))), np.zeros(len(a)), np.zeros(len(b))
    for d in range(a.shape[1]):
        dot += a[:, d, None] * b[None, :, d]
        na += a[:, d] * a[:, d]
        nb += b[:, d] * b[:, d]
    return dot / (np.sqrt(na)[:, None] * np.sqrt(nb)[None, :])


def _best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Positions of the k best, ties to smaller ids, without the query's own."""
    at = np.flatnonzero(ids != own)
    if len(at) > k:
        floor = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= floor]
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def _top(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _exact(assigned: DataFrame, ids: np.ndarray, probes: np.ndarray, k: int) -> DataFrame:
    """The true neighbours of a bounded number of probes among all vectors, with their leaves."""
    dims = probes.shape[1]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                v, leaf = part.column("vec_id").to_numpy(), part.column("leaf").to_numpy()
                scores = cosines(probes, _arrow_matrix(part.column("vector"), dims))
                rows = [(q, *x) for i, q in enumerate(ids.tolist()) for b in [_best(scores[i], v, q, k)]
                        for x in zip(v[b].tolist(), scores[i, b].tolist(), leaf[b].tolist())]
                yield pa.RecordBatch.from_pylist([dict(zip(("query_id", "vec_id", "score", "leaf"), r)) for r in rows],
                                                 pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("leaf", pa.int64())]))

    return _top(assigned.select("vec_id", "vector", "leaf").mapInArrow(run, "query_id long, vec_id long, score double, leaf long"), k)


def grow(assigned: DataFrame, s: Settings) -> tuple[DataFrame, list[DataFrame]]:
    """Splits leaves until none holds more than twice leaf_rows. Returns the rows in their final leaves, and each
    round's splits (leaf, child, centre). Leaves that k-means can't split, of one direction, stay.
    """
    assigned, rounds = assigned.withColumn("open", F.lit(True)), []

    def split(key, rows):
        import pandas as pd

        tree = fit_tree(_unit(_matrix(rows.vector)), s)
        centres = [tree.centres[i].tolist() for i, leaf in enumerate(tree.leaf) if leaf >= 0] if tree.leaves > 1 else []
        return pd.DataFrame({"leaf": key[0], "sub": range(len(centres)), "centre": centres})

    def place(key, rows, nodes):
        if not len(rows):
            return rows[["vec_id", "vector", "leaf", "open"]]
        leaf = nodes.child.to_numpy()[_nearest(_unit(_matrix(rows.vector)), _matrix(nodes.centre))] if len(nodes) else rows.leaf
        return rows[["vec_id", "vector"]].assign(leaf=leaf, open=bool(len(nodes)))

    while True:
        big = assigned.where("open").groupBy("leaf").agg(F.ceil(F.count("*") / s.block_rows).cast("int").alias("_blocks"), F.count("*").alias("_n"))
        big = written(big.where(F.col("_n") > 2 * s.leaf_rows).drop("_n"), "large-leaves")
        if big.isEmpty():
            return assigned.drop("open"), rounds
        inside = assigned.join(big, "leaf")
        order = Window.partitionBy("leaf").orderBy(F.xxhash64("vec_id"), "vec_id")
        sample = inside.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= s.split_rows).select("leaf", "vector")
        nodes = sample.groupBy("leaf").applyInPandas(split, "leaf long, sub int, centre array<double>")
        nodes = written(nodes.select("leaf", F.xxhash64("leaf", "sub", F.lit(len(rounds))).alias("child"), "centre"), "splits")
        left = inside.withColumn("_block", F.expr("CAST(pmod(xxhash64(vec_id), _blocks) AS INT)"))
        right = nodes.join(big.select("leaf", F.col("_blocks").alias("_of")), "leaf").withColumn("_block", F.explode(F.expr("sequence(0, _of - 1)")))
        ddl = "vec_id long, vector array<double>, leaf long, open boolean"
        moved = left.groupBy("leaf", "_block").cogroup(right.groupBy("leaf", "_block")).applyInPandas(place, ddl)
        assigned = written(assigned.join(big, "leaf", "left_anti").select(moved.columns).unionByName(moved), "leaves")
        held = assigned.select(F.col("leaf").alias("child")).distinct()
        rounds.append(written(nodes.join(held, "child", "left_semi").select(nodes.columns), "splits"))


def _dealt(leaves: DataFrame, asked: DataFrame, buckets: int, parts: int) -> DataFrame:
    """(query_id, leaf, ...) as one row for each query and bucket of leaves, with lists and the query's vector."""
    lists = [F.collect_list(c).alias(c) for c in leaves.columns if c != "query_id"]
    out = leaves.withColumn("bucket", _bucket(buckets)).groupBy("query_id", "bucket").agg(*lists)
    out = out.join(asked.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("probe")), "query_id")
    return out.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("leaf"), F.lit(buckets)).cast("int")


def _by_leaf(theirs, leaf: np.ndarray):
    """For each leaf that queries of theirs name: it, its range in the sorted leaves, the queries' rows, where in their lists."""
    row = np.repeat(np.arange(len(theirs)), [len(x) for x in theirs.leaf])
    wanted = np.concatenate([np.asarray(x, np.int64) for x in theirs.leaf])
    order = np.argsort(wanted, kind="stable")
    own, first = np.unique(wanted[order], return_index=True)
    for at, a, b in zip(own.tolist(), first.tolist(), [*first[1:].tolist(), len(order)]):
        yield at, *np.searchsorted(leaf, (at, at + 1)).tolist(), row[order[a:b]], order[a:b]


def _expand(front: DataFrame, asked: DataFrame, nodes: DataFrame, parts: int, block: int) -> DataFrame:
    """(query_id, leaf, d): leaves that were split replaced by their children, the others as they are."""

    def near(key, nodes, asks):
        import pandas as pd

        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if len(asks):
            nodes = nodes.sort_values(["leaf", "child"])
            child, leaf, ids = nodes.child.to_numpy(), nodes.leaf.to_numpy(), asks.query_id.to_numpy()
            centres, x, known = _matrix(nodes.centre), _unit(_matrix(asks.probe)), np.concatenate(list(asks.d))
            for at, a, b, row, place in _by_leaf(asks, leaf):
                if a == b:
                    found.append((ids[row], np.full(len(row), at), known[place]))
                    continue
                c = centres[a:b]
                d = (x[row] ** 2).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * x[row] @ c.T
                found.append((np.repeat(ids[row], b - a), np.tile(child[a:b], len(row)), d.ravel()))
        return pd.DataFrame(dict(zip(("query_id", "leaf", "d"), map(np.concatenate, zip(*found)))))

    buckets = max(1, -(-nodes.count() // block))
    left = nodes.select("*", _bucket(buckets).alias("bucket"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    by = ["bucket", "part"]
    return left.groupBy(*by).cogroup(_dealt(front, asked, buckets, parts).groupBy(*by)).applyInPandas(near, "query_id long, leaf long, d double")


def _widened(places: list[int | None], recall: float) -> int:
    """The smallest number of visits that reaches so large a share of places (None: out of reach)."""
    found = sorted(p for p in places if p is not None)
    return 1 + found[min(len(found), max(1, int(np.ceil(recall * len(places))))) - 1] if found else 1


def reach(tree: Tree, asked: DataFrame, sizes: DataFrame, top: np.ndarray, rounds: list[DataFrame], visits: list[int], least: int,
          parts: int, block: int) -> DataFrame:
    """(query_id, leaf, place): the leaves that each query visits after as many rounds as visits allows for.

    On every level the nearest leaves up to its number of visits, and on until they hold `least` vectors.
    """

    def walk(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column("vec_id").to_numpy()
            x = _unit(_arrow_matrix(batch.column("vector"), len(tree.centres[0]))) if batch.num_rows else []
            for q, v in zip(ids.tolist(), x):
                leaf, d = zip(*tree.visit(v, visits[0], top, least))
                columns = [pa.array([q] * len(leaf), pa.int64()), pa.array(leaf, pa.int64()), pa.array(d, pa.float64()), pa.array(range(len(leaf)), pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "leaf", "d", "place"])

    front = asked.select("vec_id", "vector").mapInArrow(walk, "query_id long, leaf long, d double, place int")
    order = Window.partitionBy("query_id").orderBy("d", "leaf")
    for nodes, most in zip(rounds, visits[1:]):
        front = _expand(front.drop("place"), asked, nodes, parts, block).join(sizes, "leaf", "left").na.fill(least, ["_n"])
        held = F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        front = front.withColumn("place", F.row_number().over(order) - 1).withColumn("_held", held)
        front = front.where((F.col("place") < most) | (F.col("_held") < least)).drop("_n", "_held")
    return front


def calibrated(tree: Tree, asked: DataFrame, assigned: DataFrame, sizes: DataFrame, top: np.ndarray, rounds: list[DataFrame], k: int, s: Settings) -> list[int]:
    """The visits on each level, by probes: all but the last level may lose half of what the recall allows."""
    probe = asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(s.probes)
    rows = probe.toPandas()
    if not len(rows):
        return [1] * (1 + len(rounds))
    truth = written(_exact(assigned, rows.vec_id.to_numpy(), _matrix(rows.vector), k).select("query_id", "vec_id", F.col("leaf").alias("l")), "probe-truth")
    levels = [truth]
    for nodes in reversed(rounds):  # up the tree: parents of leaves that a round made
        up = levels[0].join(nodes.select(F.col("child").alias("l"), F.col("leaf").alias("_up")), "l", "left")
        levels.insert(0, up.withColumn("l", F.coalesce("_up", "l")).drop("_up"))
    visits = []
    for level, want in enumerate(levels):
        front = reach(tree, probe, sizes, top, rounds[:level], [*visits, 2**31 - 1], k + 1, 1, s.block_rows)
        front = front.select("query_id", F.col("leaf").alias("l"), "place")
        places = [r["place"] for r in want.join(front, ["query_id", "l"], "left").collect()]  # probes * k rows
        visits.append(_widened(places, s.recall if level == len(rounds) else 1 - (1 - s.recall) / 2))
    return visits


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, settings: Settings = Settings(),
            vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k nearest of those found, by cosine, never itself.

    queries has the columns vec_id and vector. Vectors null, zero, with null or non-finite components or with a null
    id take no part, as queries or as candidates. Vectors are compared with those of their own length: the most
    frequent length by the tree, each other one with all of its length. Of several vectors for one query id the
    smallest asks. Copies of one vector are cut to the k + 1 smallest ids before the search: no larger id can be
    among k nearest; repeated rows, alike in id and vector, are one. No rows in, no rows out.
    """
    s, spark = settings, vectors.sparkSession
    own = [F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")]
    clean = vectors.where(usable(vector) & F.col(vec_id).isNotNull()).select(*own)
    copies = Window.partitionBy("_h", "vector").orderBy("vec_id")  # the hash spares most comparisons of arrays
    clean = clean.withColumn("_h", F.xxhash64("vector"))
    clean = clean.withColumn("_copy", F.dense_rank().over(copies)).withColumn("_last", F.lag("vec_id").over(copies))
    clean = clean.where((F.col("_copy") <= k + 1) & ~F.col("_last").eqNullSafe(F.col("vec_id")))
    clean = written(clean.select("vec_id", "vector", F.size("vector").alias("dims")), "vectors")
    lengths = written(clean.groupBy("dims").agg(F.count("*").alias("_n")), "lengths")
    common = lengths.orderBy(F.desc("_n"), "dims").first()
    if common is None:
        return inline_table(spark, [], "query_id long, rank int, vec_id long, score double")
    dims = common["dims"]
    asked = queries.where(usable(vector) & F.col(vec_id).isNotNull()).select(*own).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    asked = written(asked.withColumn("dims", F.size("vector")), "queries")
    main, mine = clean.where(F.col("dims") == dims), asked.where(F.col("dims") == dims)
    sample = main.orderBy(F.xxhash64("vec_id"), "vec_id").limit(s.sample_rows).select("vector").toPandas()
    tree = fit_tree(_unit(_matrix(sample.vector)), s)

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            leaf = tree.descend(_unit(_arrow_matrix(batch.column("vector"), dims))) if batch.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vector"), pa.array(leaf)], ["vec_id", "vector", "leaf"])

    assigned = written(main.select("vec_id", "vector").mapInArrow(place, "vec_id long, vector array<double>, leaf long"), "leaves")
    top = np.zeros(tree.leaves, np.int64)
    for r in assigned.groupBy("leaf").count().collect():  # at most as many rows as the top has leaves
        top[r["leaf"]] = r["count"]
    assigned, rounds = grow(assigned, s)
    sizes = written(assigned.groupBy("leaf").agg(F.count("*").alias("_n")), "leaf-sizes")
    parts = max(1, -(-asked.count() // 1024))
    visits = calibrated(tree, mine, assigned, sizes, top, rounds, k, s)
    asks = reach(tree, mine, sizes, top, rounds, visits, k + 1, parts, s.block_rows).select("query_id", "leaf")

    # other lengths: leaves by hash, all of them visited
    other = lengths.where(F.col("dims") != dims).withColumn("_leaves", F.ceil(F.col("_n") / s.block_rows)).drop("_n")
    named = lambda i: F.xxhash64(F.lit("length"), "dims", i)
    rest = clean.join(other, "dims").select("vec_id", "vector", named(F.pmod(F.xxhash64("vec_id"), F.col("_leaves"))).alias("leaf"))
    wide = asked.join(other, "dims").withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_leaves") - 1)))
    held, asks = assigned.unionByName(rest), asks.unionByName(wide.select(F.col("vec_id").alias("query_id"), named(F.col("_i")).alias("leaf")))

    buckets = max(1, -(-clean.count() // s.block_rows))
    left = held.select("vec_id", "vector", "leaf", _bucket(buckets).alias("bucket"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    right = _dealt(asks.select("query_id", "leaf"), asked, buckets, parts)

    def search(key, mine, theirs):
        import pandas as pd

        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if len(mine) and len(theirs):
            mine = mine.sort_values(["leaf", "vec_id"], kind="stable")
            ids, vector, leaf = mine.vec_id.to_numpy(), mine.vector.to_numpy(), mine.leaf.to_numpy()
            asking, probe = theirs.query_id.to_numpy(), theirs.probe.to_numpy()
            for _, a, b, q, _ in _by_leaf(theirs, leaf):
                if a == b:
                    continue
                scores = cosines(_matrix(probe[q]), _matrix(vector[a:b]))
                scores[asking[q][:, None] == ids[None, a:b]] = -np.inf  # never itself
                best = np.argsort(-scores, axis=1, kind="stable")[:, :k]  # ids ascend, so ties go to the smaller
                r = np.repeat(q, best.shape[1])
                found.append((asking[r], ids[a:b][best.ravel()], np.take_along_axis(scores, best, 1).ravel()))
        q, v, score = map(np.concatenate, zip(*found))
        kept = score > -np.inf
        q, v, score = q[kept], v[kept], score[kept]
        order = np.lexsort((v, -score, q))
        q, v, score = q[order], v[order], score[order]
        first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.empty(0, np.int64)
        kept = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q)))) < k
        return pd.DataFrame({"query_id": q[kept], "vec_id": v[kept], "score": score[kept]})

    by = ["bucket", "part"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(search, "query_id long, vec_id long, score double")
    return _top(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0))
