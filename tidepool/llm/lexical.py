"""Ranked lexical search with pair-bound MaxScore.

Documents are indexed in blocks: postings of each term, the term's greatest impact in each range of documents, and,
for pairs of terms that questions use, lists of the ranges where both occur with the greatest joint impact there. At
query time a pair's bound in a range is the largest of its joint impact and of the two terms' own maxima, mostly far
below their sum. Ranges whose bounds add up to less than the k-th score known so far are skipped, and terms whose pairs
together can't reach it are only looked up for documents that others propose (MaxScore).

The k-th score to beat is known before the search: the pair lists give each question documents with a partial score,
whose k-th largest over all blocks no result can be below. Pruning is strict, so ties and results are exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepool.llm.shared import inline_table, table, written

_APART = [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if b in set(_APART) else b for b in range(256))


@dataclass(frozen=True)
class Settings:
    """Blocks hold at most block_rows documents and about block_postings postings, ranges range_rows documents.

    The words of questions are given to the tokenizing tasks up to most_words, question parts are broadcast up to
    most_parts; beyond, both are joined by a shuffle.
    """

    block_rows: int = 4096
    block_postings: int = 1_000_000
    range_rows: int = 8
    part_items: int = 256
    most_words: int = 200_000
    most_parts: int = 32


def terms(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of all characters beyond ASCII; only A-Z is lower-cased."""
    return text.encode().translate(_FOLD).split() if text else []


def _counted(texts: DataFrame, keep: list[str], vocabulary: dict[bytes, int] | None) -> DataFrame:
    """keep, n (terms of _text with repeats), and word and tf arrays of its distinct terms; only known ones, as numbers, if vocabulary."""
    kind = "string" if vocabulary is None else "long"
    schema = f"{', '.join(f'{k} {texts.schema[k].dataType.simpleString()}' for k in keep)}, n long, word array<{kind}>, tf array<int>"

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        get = None if vocabulary is None else vocabulary.get
        for batch in batches:
            n, words, tf, ends = [], [], [], [0]
            for text in batch.column("_text").to_pylist():
                own = terms(text)
                n.append(len(own))
                found = Counter(own) if get is None else Counter([w for w in map(get, own) if w is not None])
                words += found.keys()
                tf += found.values()
                ends.append(len(words))
            word = pa.array(words, pa.binary()).cast(pa.string()) if get is None else pa.array(words, pa.int64())
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x) for x in (word, pa.array(tf, pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.select(keep).columns, pa.array(n, pa.int64()), *lists], [*keep, "n", "word", "tf"])

    return texts.select(*keep, "_text").mapInArrow(run, schema)


def count_terms(docs: DataFrame, words: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, word, tf) of every document, where word numbers the terms that questions use, and (term, word).

    docs has doc_id and _text, words the distinct terms of all questions.
    """
    if words.limit(s.most_words + 1).count() <= s.most_words:
        known = {t.encode(): i for i, t in enumerate(sorted(words.toArrow().column("term").to_pylist()))}
        numbered = docs.sparkSession.createDataFrame([(t.decode(), i) for t, i in known.items()], "term string, word long")
        return written(_counted(docs, ["doc_id"], known), "document-terms"), numbered
    numbered = written(words.withColumn("word", F.monotonically_increasing_id()), "words")
    every = written(_counted(docs, ["doc_id"], None).withColumn("_row", F.monotonically_increasing_id()), "all-terms")
    one = every.select("_row", F.explode(F.arrays_zip(F.col("word").alias("term"), F.col("tf").alias("tf"))).alias("x")).select("_row", "x.term", "x.tf")
    own = one.join(numbered, "term").groupBy("_row").agg(F.collect_list(F.struct("word", "tf")).alias("x"))
    none = [F.expr(f"coalesce(x.{c}, CAST(array() AS array<{kind}>))").alias(c) for c, kind in (("word", "long"), ("tf", "int"))]
    return written(every.select("_row", "doc_id", "n").join(own, "_row", "left").select("doc_id", "n", *none), "document-terms"), numbered


_BLOCK = "block long, ids array<long>, words array<long>, ends array<int>, place array<int>, impact array<int>"


def blocks(counted: DataFrame, documents: int, length: int, s: Settings) -> DataFrame:
    """Documents in blocks, as postings by term: documents (places) of words[i] and its impacts there lie before ends[i]."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        made = TaskContext.get().partitionId() << 32

        def block(part):
            nonlocal made
            n = part.column("n").to_numpy().astype(object if length and 25 * documents * max(part.column("n").to_pylist()) >= 2**63 else np.int64)
            lists = part.column("word")
            size = np.diff(lists.offsets.to_numpy())
            word, tf = lists.flatten().to_numpy(), part.column("tf").flatten().to_numpy().astype(np.int64)
            m = (75 + 25 * n * documents // max(length, 1)).astype(np.int64)
            impact = 1_000_000_000 * tf // (1000 * tf + 12 * np.repeat(m, size))
            place = np.repeat(np.arange(part.num_rows), size)
            order = np.lexsort((place, word))
            word, place, impact = word[order], place[order], impact[order]
            last = np.append(np.flatnonzero(word[1:] != word[:-1]), len(word) - 1) if len(word) else np.empty(0, np.int64)
            made += 1
            row = [[made], [part.column("doc_id").to_pylist()], [word[last]], [last + 1], [place], [impact]]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, arrow)], list("abcdef"))

        arrow = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 3]
        names = [f.split()[0] for f in _BLOCK.split(", ")]
        for batch in batches:
            kept = batch.filter(pa.array([n > 0 for n in batch.column("n").to_pylist()], pa.bool_()))
            at, size = 0, np.diff(kept.column("word").offsets.to_numpy()).cumsum() if kept.num_rows else []
            while at < kept.num_rows:
                end = int(np.searchsorted(size, (size[at - 1] if at else 0) + s.block_postings, "right"))
                end = max(at + 1, min(end, at + s.block_rows))
                part = pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in kept.slice(at, end - at).columns], kept.schema.names)
                yield block(part).rename_columns(names)
                at = end

    return counted.mapInArrow(run, _BLOCK)


class Block:
    """A block's postings, and greatest impacts by range."""

    def __init__(self, ids, words, ends, place, impact, range_rows: int):
        self.ids, self.place, self.impact, self.range_rows = ids, place, impact, range_rows
        self.at = dict(zip(words.tolist(), zip([0, *ends.tolist()], ends.tolist())))
        self.ranges = -(-len(ids) // range_rows)
        self.none = np.empty(0, np.int64), np.empty(0, np.int64)
        self.most: dict[int, np.ndarray] = {}

    def postings(self, word: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.at.get(word, (0, 0))
        return self.place[a:b], self.impact[a:b].astype(np.int64)

    def by_range(self, place: np.ndarray, value: np.ndarray) -> np.ndarray:
        out = np.zeros(self.ranges, np.int64)
        np.maximum.at(out, place // self.range_rows, value)
        return out

    def maxima(self, word: int) -> np.ndarray:
        if word not in self.most:
            self.most[word] = self.by_range(*self.postings(word))
        return self.most[word]

    def joint(self, a: int, wa: int, b: int, wb: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents with both terms and their joint impacts."""
        (x, i), (y, j) = self.postings(a), self.postings(b)
        if not len(x) or not len(y):
            return self.none
        if len(x) > len(y):
            (x, i, wa), (y, j, wb) = (y, j, wb), (x, i, wa)
        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
        same = y[at] == x
        return x[same], wa * i[same] + wb * j[at[same]]


@dataclass
class Item:
    """A question: terms, rarest first, their weights and how often it has them; the score that results must reach."""

    item: int
    words: list[int]
    weights: list[int]
    times: list[int]
    least: int = 0

    def pairs(self) -> list[tuple[int, int]]:
        return [(i, i + 1) for i in range(0, len(self.words) - 1, 2)]


def pair_lists(block: Block, items: list[Item], k: int) -> tuple[dict, list]:
    """{(term, term): (ranges where both occur, greatest joint impact there)} and (item, score): the k best partial scores."""
    lists, whole, scores = {}, {}, []
    for q in items:
        total = np.zeros(len(block.ids), np.int64)
        for i, j in q.pairs():
            key = q.words[i], q.words[j]
            if key not in lists:
                place, value = whole[key] = block.joint(key[0], q.weights[i], key[1], q.weights[j])
                most = block.by_range(place, value)
                lists[key] = np.flatnonzero(most), most[most > 0]
            total[whole[key][0]] += whole[key][1]
        best = np.partition(total, len(total) - k)[len(total) - k :] if len(total) > k else total
        scores += [(q.item, x) for x in best.tolist() if x]
    return lists, scores


@dataclass
class Work:
    """What a search has looked at, for tests and tuning."""

    ranges: int = 0
    skipped: int = 0
    postings: int = 0
    read: int = 0


def search(block: Block, q: Item, lists: dict, k: int, work: Work | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the block's documents that may be among the k best."""
    least = max(q.least, 1)
    groups = [[i, i + 1] for i, _ in q.pairs()] + ([[len(q.words) - 1]] if len(q.words) % 2 else [])
    bounds = np.zeros((len(groups), block.ranges), np.int64)
    for bound, own in zip(bounds, groups):
        each = [q.weights[i] * block.maxima(q.words[i]) for i in own]
        times = [q.times[i] for i in own]
        both = np.maximum.reduce(each)
        if len(own) == 2 and (found := lists.get((q.words[own[0]], q.words[own[1]]))) is not None:
            np.maximum.at(both, found[0], found[1])
        elif len(own) == 2:
            both = each[0] + each[1]
        bound += min(times) * both + sum((t - min(times)) * x for t, x in zip(times, each))
    alive = bounds.sum(0) >= least
    if work is not None:
        work.ranges += len(alive)
        work.skipped += int((~alive).sum())
        work.postings += sum(len(block.postings(w)[0]) for w in q.words)
    if not alive.any():
        return block.none
    order = np.argsort(bounds[:, alive].max(1), kind="stable")
    rest = np.searchsorted(np.cumsum(bounds[order][:, alive].max(1)), least)  # so many groups can't reach it together
    score, inside = np.zeros(len(block.ids), np.int64), np.repeat(alive, block.range_rows)[: len(block.ids)]
    for g in order[rest:]:
        for i in groups[g]:
            place, impact = block.postings(q.words[i])
            on = inside[place]
            score[place[on]] += q.weights[i] * q.times[i] * impact[on]
            if work is not None:
                work.read += int(on.sum())
    at = np.flatnonzero(score)
    at = at[score[at] + bounds[order[:rest]].sum(0)[at // block.range_rows] >= least]
    for g in order[:rest]:
        for i in groups[g]:
            place, impact = block.postings(q.words[i])
            if len(place) and len(at):
                there = np.minimum(np.searchsorted(place, at), len(place) - 1)
                hit = place[there] == at
                score[at[hit]] += q.weights[i] * q.times[i] * impact[there[hit]]
                if work is not None:
                    work.read += len(at)
    at = at[score[at] >= least]
    if len(at) > k:
        floor = np.partition(score[at], len(at) - k)[len(at) - k]
        at = at[score[at] >= floor]
        ids = [(-score[p], block.ids[p] is None, block.ids[p] or 0, p) for p in at.tolist()]
        at = np.array([x[3] for x in sorted(ids)[:k]])
    return at, score[at]


def _items(row: dict) -> list[Item]:
    return [Item(q["item"], [t["word"] for t in q["terms"]], [t["weight"] for t in q["terms"]], [t["times"] for t in q["terms"]], q["least"]) for q in row]


def _block(batch, i: int, s: Settings) -> Block:
    x = [batch.column(c)[i].values for c in ("ids", "words", "ends", "place", "impact")]
    return Block(x[0].to_pylist(), *(c.to_numpy() for c in x[1:]), s.range_rows)


def _pair_table(work: DataFrame, k: int, s: Settings) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        types = [pa.int64(), pa.int32(), *[pa.list_(pa.int64())] * 2, pa.list_(pa.int32()), pa.list_(pa.int32()), *[pa.list_(pa.int64())] * 3]
        names = ["block", "part", "a", "b", "pair_ends", "ranges", "joint", "item", "partial"]
        for batch in batches:
            for i in range(batch.num_rows):
                lists, scores = pair_lists(_block(batch, i, s), _items(batch.column("items")[i].as_py()), k)
                cat = lambda c: np.concatenate([x[c] for x in lists.values()]) if lists else np.empty(0, np.int64)
                row = [batch.column("block")[i].as_py(), batch.column("part")[i].as_py(), [p[0] for p in lists], [p[1] for p in lists],
                       np.cumsum([len(x[0]) for x in lists.values()]), cat(0), cat(1), [x[0] for x in scores], [x[1] for x in scores]]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names)

    ddl = "block long, part int, a array<long>, b array<long>, pair_ends array<int>, ranges array<int>, joint array<long>, item array<long>, partial array<long>"
    return work.mapInArrow(run, ddl)


def _found(work: DataFrame, k: int, s: Settings) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                block = _block(batch, i, s)
                a, b, ends, ranges, joint = (batch.column(c)[i].values.to_numpy() for c in ("a", "b", "pair_ends", "ranges", "joint"))
                lists = {(x, y): (ranges[m:n], joint[m:n]) for x, y, m, n in zip(a.tolist(), b.tolist(), [0, *ends.tolist()], ends.tolist())}
                items, ids, scores = [], [], []
                for q in _items(batch.column("items")[i].as_py()):
                    at, score = search(block, q, lists, k)
                    items += [q.item] * len(at)
                    ids += [block.ids[p] for p in at.tolist()]
                    scores += score.tolist()
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (items, ids, scores)], ["item", "doc_id", "score"])

    return work.mapInArrow(run, "item long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = 20, settings: Settings = Settings(), text: str = "text", doc_id: str = "doc_id",
           item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of the highest score above 0 for each item, ties by doc_id.

    A term's weight is floor(1000 ln((2N+2)/(2df+1))), a document's m is 75 + 25 n N div L, and the score sums
    weight * (10^9 tf div (1000 tf + 12 m)) over the item's terms, repeats included. Documents null or without a term
    count nowhere. Every row of docs is a document of its own, repeated ids too; null ids rank last among ties. Of
    several rows of one item the smallest text counts; items with null id or without a known term have no rows. Ids are
    integers. Other columns of either table are ignored. No rows in, no rows out.
    """
    s, spark = settings, docs.sparkSession
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_text"))
    asked = items.where(F.col(item_id).isNotNull()).groupBy(F.col(item_id).cast("long").alias("item")).agg(F.min(item_text).alias("_text"))
    asked = _counted(asked, ["item"], None).select("item", F.explode(F.arrays_zip(F.col("word").alias("term"), F.col("tf").alias("times"))).alias("x"))
    asked = written(asked.select("item", "x.term", "x.times"), "question-terms")
    counted, numbered = count_terms(texts, asked.select("term").distinct(), s)
    documents, length = counted.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not documents:
        return inline_table(spark, [], "item_id long, rank int, doc_id long, score long")
    df = counted.select(F.explode("word").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(documents) + 2).cast("double") / (2 * F.col("df") + 1))).cast("long")
    known = asked.join(numbered, "term").join(df, "word").select("item", "df", "word", weight.alias("weight"), "times")
    each = F.array_sort(F.collect_list(F.struct("df", "word", "weight", F.col("times").cast("long").alias("times"))))  # rarest first
    questions = written(known.groupBy("item").agg(each.alias("terms")), "questions")
    parts = max(1, -(-questions.count() // s.part_items))
    indexed = written(blocks(counted, documents, length, s), "index")

    def asking(least: DataFrame | None, what: DataFrame) -> DataFrame:
        own = questions.withColumn("least", F.lit(0).cast("long")) if least is None else questions.join(least, "item", "left").na.fill(0, ["least"])
        own = own.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(parts)).cast("int"))
        own = own.groupBy("part").agg(F.collect_list(F.struct("item", "terms", "least")).alias("items"))
        return what.join(F.broadcast(own) if parts <= s.most_parts else own, "part")

    all_parts = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    dealt = indexed.select("*", all_parts)
    lists = written(_pair_table(asking(None, dealt), k, s), "pair-lists")
    partial = lists.select(F.explode(F.arrays_zip("item", "partial")).alias("x")).select("x.item", "x.partial")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("partial")))
    least = written(partial.withColumn("_at", place).where(F.col("_at") <= k).where(F.col("_at") == k).select("item", F.col("partial").alias("least")), "least-scores")
    found = _found(asking(least, dealt.join(lists.drop("item", "partial"), ["block", "part"])), k, s)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.select(F.col("item").alias("item_id"), F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op11_pair_bound_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents WHERE text IS NOT NULL),
q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark WHERE text IS NOT NULL) GROUP BY ALL),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY ALL), s AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM n),
f AS (SELECT doc_id, t, count(*) AS tf FROM d WHERE t IN (SELECT t FROM q) GROUP BY ALL), df AS (SELECT t, count(*) AS df FROM f GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * big_n + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM df, s),
r AS (SELECT item_id, f.doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l)))) AS BIGINT) AS score
      FROM q JOIN w USING (t) JOIN f USING (t) JOIN n ON n.doc_id = f.doc_id, s GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= 20
"""
