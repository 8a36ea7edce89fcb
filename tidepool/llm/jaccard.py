"""Near copies by the Jaccard similarity of their word shingles, exactly.

SimHash balls and neighbours in the shared shingles propose first pairs, which join most copies. Then a few texts in
the middle of those that share a shingle meet the others there, which joins large groups of near copies by pairs that
grow as their rows do. Of the rest no pair is missed: were two texts at least `similarity` alike, the first shingle
they share, in whatever fixed order, is among the first n - ceil(similarity * n) + 1 of each. Only these prefixes are
spread, rare shingles first, and texts of different components that meet in one are compared. Every link is verified on
the texts.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm import simhash
from tidepool.llm.components import least_member
from tidepool.llm.shared import forget_kept, map_batches, shuffles_dropped, written

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_MOST_WORDS = 200_000
_MOST_HELD = 4_000_000  # shingles, of 8 bytes


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingler(words: int = 5) -> Callable[[str | None], np.ndarray]:
    """Function of a text to the sorted 64-bit hashes of its distinct shingles; a shorter text is one shingle."""
    import xxhash

    known: dict[bytes, int] = {}

    def make(text):
        parts = split(text)
        if not parts:
            return np.empty(0, np.uint64)
        if len(known) > _MOST_WORDS:
            known.clear()
        for p in set(parts):  # a difference of the two sets would walk all known words for each text
            if p not in known:
                known[p] = xxhash.xxh64_intdigest(p)
        w = np.fromiter(map(known.__getitem__, parts), np.uint64, len(parts))
        k = min(words, len(parts))
        n = len(parts) - k + 1
        h = w[:n].copy()
        for i in range(1, k):
            h = h * _PRIME + w[i : i + n]
        return np.unique(h)

    return make


def _marked(docs: DataFrame, text: str, keep: list[str], words: int, fingerprints: bool = True) -> DataFrame:
    """docs with _h1 and _h2, two hashes of the text's words, and _fp, its fingerprint."""

    def make():
        import xxhash

        def signed(x):
            return (x ^ 1 << 63) - (1 << 63)

        def work(batch):
            texts = batch.column(text).to_pylist()
            known = {}
            for t in set(texts):
                whole = b" ".join(split(t))
                known[t] = signed(xxhash.xxh3_64_intdigest(whole)), signed(xxhash.xxh64_intdigest(whole)), simhash.fingerprint(t, words) if fingerprints else 0
            return None, list(zip(*(known[t][: 3 if fingerprints else 2] for t in texts))) if texts else [[]] * (3 if fingerprints else 2)

        return work

    added = "_h1 long, _h2 long, _fp long" if fingerprints else "_h1 long, _h2 long"
    return map_batches(docs.select(*dict.fromkeys([*keep, text])), make, added, keep, rows=2000)


def frequent(texts: DataFrame, words: int, one_in: int = 16, least: int = 3, most: int = 100_000) -> np.ndarray:
    """The shingles found most often in a sample of the texts, rarest first: only their order, never a result, hangs on it."""

    def run(batches):
        import pyarrow as pa

        forget_kept()
        shingles = shingler(words)
        for batch in batches:
            for t in batch.column("_text").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t).view(np.int64))], ["gram"])

    sample = texts.where(F.pmod("_node", F.lit(one_in)) == 0).select("_text").mapInArrow(run, "gram long")
    top = sample.groupBy("gram").count().where(F.col("count") >= least).orderBy(F.desc("count"), "gram").limit(most)
    return top.toArrow().column("gram").to_numpy().view(np.uint64)[::-1].copy()


def prefixes(texts: DataFrame, words: int, similarity: Fraction, last: np.ndarray) -> DataFrame:
    """Rows (gram, node, n, at): the at-th of a text's n shingles, those in `last` at the end, for its prefix."""
    rank = np.argsort(last)
    ordered = last[rank]
    num, den = similarity.numerator, similarity.denominator

    def run(batches):
        import pyarrow as pa

        forget_kept()
        shingles = shingler(words)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                grams, counts, sizes = [], [], []
                for t in part.column("_text").to_pylist():
                    own = shingles(t)
                    if len(ordered) and len(own):
                        place = np.minimum(np.searchsorted(ordered, own), len(ordered) - 1)
                        late = ordered[place] == own
                        own = np.concatenate([own[~late], own[late][np.argsort(rank[place[late]])]])
                    n = len(own)
                    grams.append(own[: n + (-num * n // den) + 1] if n else own)
                    counts.append(len(grams[-1]))
                    sizes.append(n)
                nodes = np.repeat(part.column("_node").to_numpy(), counts)
                places = np.concatenate([np.arange(c, dtype=np.int32) for c in counts])
                columns = [np.concatenate(grams).view(np.int64), nodes, np.repeat(np.array(sizes, np.int32), counts), places]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["gram", "node", "n", "at"])

    return texts.select("_node", "_text").mapInArrow(run, "gram long, node long, n int, at int")


def _texts_of(pairs: DataFrame, texts: DataFrame, most: int = 2_000_000) -> DataFrame:
    """The texts that pairs name: their ids are broadcast up to so many, and beyond that joined by a shuffle."""
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("_node")).distinct(), "wanted-texts")
    return texts.join(F.broadcast(ids) if ids.count() <= most else ids, "_node", "left_semi")


def verify(pairs: DataFrame, texts: DataFrame, words: int, similarity: Fraction) -> DataFrame:
    """The pairs (a, b) whose texts are at least that similar. pairs is a written table."""
    num, den = similarity.numerator, similarity.denominator

    def run(batches):
        import pyarrow as pa

        forget_kept()
        shingles = shingler(words)
        known: dict[int, np.ndarray] = {}  # a text meets many others: its shingles are made once while they fit
        held = 0

        def of(node, texts, at):
            nonlocal held
            own = known.get(node)
            if own is None:
                own = shingles(texts[at].as_py())
                if held + len(own) > _MOST_HELD:
                    known.clear()
                    held = 0
                known[node] = own
                held += len(own)
            return own

        for batch in batches:
            good = []
            s, t = batch.column("s"), batch.column("t")
            for at, (a, b) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())):
                own, other = of(b, t, at), of(a, s, at)
                most = min(len(own), len(other))
                if not most or den * most < num * max(len(own), len(other)):
                    good.append(False)
                    continue
                merged = np.concatenate([own, other])
                merged.sort()
                common = int(np.count_nonzero(merged[1:] == merged[:-1]))
                good.append(common > 0 and den * common >= num * (len(merged) - common))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    texts = _texts_of(pairs, texts)
    left = texts.select(F.col("_node").alias("a"), F.col("_text").alias("s"))
    right = texts.select(F.col("_node").alias("b"), F.col("_text").alias("t"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "s", "t")
    both = both.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "b")  # much work for few bytes
    return both.mapInArrow(run, "a long, b long")


def _pair(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def bands(texts: DataFrame, similarity: Fraction) -> Column:
    """Of texts with n shingles the band of like lengths: two that can be alike are in one or in neighbouring bands."""
    step = np.log(similarity.denominator / similarity.numerator) if similarity < 1 else 1e-9
    return F.floor(F.log(F.col("n").cast("double")) / float(step * (1 + 1e-9) + 1e-12)).cast("long")


def near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 5, similarity: str = "0.8",
                distance: int = 4, part_rows: int = 4096, hubs: int = 4) -> DataFrame:
    """docs with component_id: the smallest doc_id reachable over pairs whose shingles are at least that similar.

    similarity is a decimal or fraction in a string, so that the limit itself counts. Texts of equal words (by two
    64-bit hashes) are one node from the start (so are all without any). Null doc_ids take no part in the minimum. A
    column of docs named component_id is replaced. No rows in, no rows out.
    """
    least = Fraction(similarity)
    if not 0 < least <= 1:
        raise ValueError("similarity must be in (0, 1]")
    docs = docs.drop("component_id")
    with shuffles_dropped(docs.sparkSession):
        ids = _components(docs, text, doc_id, words, least, distance, part_rows, hubs)
    other = [F.col(f"`{c}`") for c in docs.columns if c != text]  # in one column, whatever their names are
    rows = docs.select(F.struct(*other, F.lit(1).alias("_")).alias("_row"), F.col(text).alias("_text"))
    marked = _marked(rows, "_text", ["_row", "_text"], words, fingerprints=False).join(ids, ["_h1", "_h2"])
    return marked.select(*(F.col("_text").alias(c) if c == text else F.col("_row")[c].alias(c) for c in docs.columns), "component_id")


def _components(docs: DataFrame, text: str, doc_id: str, words: int, least: Fraction, distance: int, part_rows: int, hubs: int) -> DataFrame:
    """(_h1, _h2, component_id) of the distinct sequences of words."""
    named = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    nodes = _marked(named, "_text", ["_id", "_text"], words).groupBy("_h1", "_h2")
    nodes = nodes.agg(F.min("_id").alias("_least"), F.min("_fp").alias("_fp"), F.first("_text").alias("_text"))
    nodes = written(nodes.withColumn("_node", F.monotonically_increasing_id()), "nodes")

    by_fp = written(nodes.groupBy("_fp").agg(F.min("_node").alias("_first")), "fingerprints")
    links = simhash.near_links(by_fp.select(F.col("_fp").alias("fp")), distance)
    ends = [by_fp.select(F.col("_fp").alias(k), F.col("_first").alias(f"_{k}")) for k in ("a", "b")]
    balls = links.join(ends[0], "a").join(ends[1], "b").select(*_pair("_a", "_b"))
    balls = balls.unionByName(nodes.join(by_fp, "_fp").where("_node <> _first").select(*_pair("_node", "_first")))

    num, den = least.numerator, least.denominator
    spread = prefixes(nodes, words, least, frequent(nodes, words))
    shared = spread.groupBy("gram").agg(F.count("*").alias("k")).where("k > 1")
    met = spread.join(shared, "gram").withColumn("salt", F.expr(f"pmod(xxhash64(node), ceil(k / {part_rows}))"))
    met = written(met.select("gram", "node", "n", "at", "salt", "k"), "shared-shingles")

    def may(a: str, b: str):
        """Whether text a, not longer than b, can be alike if this is the first shingle that they share."""
        most = F.least(F.expr(f"{a}n - {a}at"), F.expr(f"{b}n - {b}at")).cast("long")
        return (F.col(f"{a}n") * den >= F.col(f"{b}n") * num) & (most * (num + den) >= F.expr(f"{a}n + {b}n") * num)

    before = F.lag(F.struct("node", "n", "at")).over(Window.partitionBy("gram", "salt").orderBy("n", "node"))
    beside = met.withColumn("before", before).where(F.col("before").isNotNull() & may("before.", "")).select(*_pair("node", "before.node"))
    tried = written(balls.unionByName(beside).distinct(), "first-pairs")
    first = written(verify(tried, nodes, words, least), "first-links")

    def spread_so_far(links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """Components by the links, shingles with them, these also in the next band, and the bands that hold several components."""
        joined = written(least_member(links).select("node", F.col("component").alias("label")), "labels")
        labelled = met.select("gram", "node", "n", "at").join(joined, "node", "left").withColumn("label", F.coalesce("label", "node"))
        labelled = written(labelled.withColumn("band", bands(met, least)), "labelled-shingles")
        short = labelled.withColumn("band", F.explode(F.array("band", F.col("band") + 1)))  # longer texts are in the same band or the next
        spans = short.groupBy("gram", "band").agg(F.min("label").alias("_min"), F.max("label").alias("_max"))
        return joined, labelled, short, written(spans.where("_min <> _max").select("gram", "band"), "mixed-bands")

    _, labelled, short, mixed = spread_so_far(first)
    # a large group is joined by the texts in its middle: those whose shingles most others share meet the rest of their band
    central = met.groupBy("node").agg((F.sum("k") / F.first("n")).alias("central"))
    place = F.row_number().over(Window.partitionBy("gram", "band").orderBy(F.desc("central"), "node"))
    middle = labelled.join(mixed, ["gram", "band"], "left_semi").join(central, "node").withColumn("place", place).where(F.col("place") <= hubs)
    x, y = short.join(mixed, ["gram", "band"], "left_semi").alias("x"), middle.alias("y")
    meet = F.expr("x.gram = y.gram AND x.band = y.band AND x.label <> y.label")
    alike = F.expr("x.n <= y.n") & may("x.", "y.") | F.expr("y.n <= x.n") & may("y.", "x.")
    met_hub = x.join(y, meet & alike).select(*_pair("x.node", "y.node")).distinct()
    new = written(met_hub.join(tried, ["a", "b"], "left_anti"), "hub-pairs")
    tried = tried.unionByName(new)
    joined, labelled, short, mixed = spread_so_far(first.unionByName(written(verify(new, nodes, words, least), "hub-links")))
    x, y = short.join(mixed, ["gram", "band"], "left_semi").alias("x"), labelled.join(mixed, ["gram", "band"], "left_semi").alias("y")
    apart = F.expr("x.gram = y.gram AND x.band = y.band AND struct(x.n, x.node) < struct(y.n, y.node) AND x.label <> y.label")
    rest = written(x.join(y, apart & may("x.", "y.")).select(*_pair("x.node", "y.node")).distinct(), "other-pairs")
    more = verify(rest.join(tried, ["a", "b"], "left_anti"), nodes, words, least)
    for end in ("a", "b"):  # links between components found so far: few are left to be joined
        more = more.withColumnRenamed(end, "node").join(joined, "node", "left").select(F.coalesce("label", "node").alias(end), *(c for c in ("a", "b") if c != end))
    whole = least_member(written(more.select("a", "b").distinct(), "links")).select(F.col("node").alias("label"), "component")

    node = nodes.select("_node", "_h1", "_h2", "_least").join(joined.withColumnRenamed("node", "_node"), "_node", "left")
    node = node.withColumn("label", F.coalesce("label", "_node")).join(whole, "label", "left")
    node = node.select("_h1", "_h2", F.coalesce("component", "label").alias("_component"), "_least")
    smallest = node.groupBy("_component").agg(F.min("_least").alias("component_id"))
    return written(node.join(smallest, "_component").select("_h1", "_h2", "component_id"), "component-ids")
