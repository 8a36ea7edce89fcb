"""Recall paths. Each returns (query_id, locator, score, rank) and whatever identifies the evidence."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepool.functions.text import occurrences, tokens
from tidepool.operators.containment import contained
from tidepool.operators.ranking import ranked, top_k, within
from tidepool.settings import DEFAULTS, Settings


def token_index(chunks: DataFrame, text: str = "content", rows: int = 4096) -> DataFrame:
    """The inverted index (token, locator), dealt out by locator, about so many chunks to a partition.

    All tokens of a chunk are in one partition, so hits of a question and a chunk are counted where they are, and only
    the best of each partition are shuffled. A task counts questions times chunks, so partitions are bounded in rows:
    left to the session's number of partitions they would grow with the table. Worth writing bucketed by locator when it is used again. (explode would
    make Spark split every text twice, once to test for rows; explode_outer doesn't.)
    """
    parts = max(chunks.sparkSession.sparkContext.defaultParallelism, -(-chunks.count() // rows))
    dealt = chunks.select("locator", F.col(text).alias("_text")).repartition(parts, "locator")
    return dealt.select("locator", F.explode_outer(tokens(F.col("_text"))).alias("token")).where("token IS NOT NULL")


def keyword_scores(queries: DataFrame, index: DataFrame) -> DataFrame:
    """The share of a query's tokens that a chunk holds, for chunks that hold any."""
    asked = queries.select("query_id", tokens(F.col("query")).alias("_t"))
    asked = asked.select("query_id", F.size("_t").alias("_n"), F.explode_outer("_t").alias("token")).where("token IS NOT NULL")
    hits = asked.join(index, "token").groupBy("query_id", "locator", "_n").agg(F.count("*").alias("_hits"))
    return hits.select("query_id", "locator", (F.col("_hits") / F.col("_n")).alias("score"))


def keyword_recall(queries: DataFrame, index: DataFrame, limit: int) -> DataFrame:
    return top_k(keyword_scores(queries, index), limit)


def as_doubles(vector: Column) -> Column:
    return F.transform(vector, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def vector_recall(queries: DataFrame, vectors: DataFrame, limit: int, block: int = 4096, rows: int = 2048) -> DataFrame:
    """Exact search by dot product (vectors are of length 1); other dimensions and scores of 0 or less drop out.

    A grid of blocks: so many queries (query_id, vector) meet so many vectors (locator, vector) in a task, which
    keeps each query's best of its block, so only those are shuffled on.
    """
    return top_k(vector_scores(queries, vectors, limit, 0.0, block, rows), limit)


def vector_scores(queries: DataFrame, vectors: DataFrame, limit: int, slack: float, block: int = 4096, rows: int = 2048) -> DataFrame:
    """(query_id, locator, score): of each block of vectors, a query's best ones and all that are at most slack below them."""
    asks = queries.select("query_id", as_doubles(F.col("vector")).alias("probe")).where("probe IS NOT NULL")
    across, down = (max(1, -(-df.count() // n)) for df, n in ((queries, block), (vectors, rows)))
    place = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.where("vector IS NOT NULL").select("locator", "vector", place("locator", down).alias("down"), every(across).alias("across"))
    right = asks.select("query_id", "probe", place("query_id", across).alias("across"), every(down).alias("down"))
    by = ["down", "across"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(_searcher(limit, slack), "query_id long, locator string, score double")


def _searcher(limit: int, slack: float):
    def search(own: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        out = [(np.empty(0, np.int64), np.empty(0, object), np.empty(0))]
        for size in {len(v) for v in asks.probe} & {len(v) for v in own.vector} - {0}:
            mine, theirs = own[own.vector.map(len) == size], asks[asks.probe.map(len) == size]
            names, x, q = mine.locator.to_numpy(object), np.stack(mine.vector).astype(np.float64), np.stack(theirs.probe)
            scores = np.zeros((len(q), len(x)))
            for d in range(size):  # in order, as a sequential sum
                scores += q[:, d, None] * x[None, :, d]
            for query, row in zip(theirs.query_id, scores):
                good = np.flatnonzero(row > 0)
                if len(good) > limit:
                    good = good[row[good] >= np.partition(row[good], len(good) - limit)[len(good) - limit] - slack]
                out.append((np.full(len(good), query), names[good], row[good]))
        ids, found, score = map(np.concatenate, zip(*out))
        return pd.DataFrame({"query_id": ids, "locator": pd.Series(found, dtype=object), "score": score})

    return search


def overlap_share(query_tokens: Column, text: Column) -> Column:
    n = F.size(query_tokens)
    return F.when(n > 0, F.size(F.array_intersect(query_tokens, tokens(F.coalesce(text, F.lit(""))))) / n).otherwise(0.0)


def metadata_boost(hits: DataFrame, query: str = "query", s: Settings = DEFAULTS) -> DataFrame:
    """Adds to score what title, section and source type share with the query; boosted says whether anything did."""
    asked = tokens(F.col(query))
    boost = (s.boost_title * overlap_share(asked, F.col("title")) + s.boost_section * overlap_share(asked, F.col("section"))
             + s.boost_source_type * overlap_share(asked, F.col("source_type")))
    boost = F.greatest(F.lit(0.0), F.least(F.lit(s.boost_most), boost))
    out = hits.withColumn("_boost", boost).withColumn("boosted", F.col("_boost") > 0)
    raised = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score") + F.col("_boost")))
    return out.withColumn("score", F.when(F.col("boosted"), raised).otherwise(F.col("score"))).drop("_boost")


def boosted_top(scores: DataFrame, queries: DataFrame, chunks: DataFrame, limit: int, s: Settings = DEFAULTS) -> DataFrame:
    """The best of scores (query_id, locator, score) after the metadata boost, with their rank.

    A boost is bounded, so only hits near the limit's score meet the chunks, of which no text is read.
    """
    near = within(scores, limit, s.boost_most).join(queries.select("query_id", "query"), "query_id")
    full = near.join(chunks.select("locator", "title", "section", "source_type"), "locator")
    return top_k(metadata_boost(full, s=s).select("query_id", "locator", "score"), limit)


def boosted_keywords(queries: DataFrame, chunks: DataFrame, limit: int, index: DataFrame | None = None, s: Settings = DEFAULTS,
                     block: int = 16384, rows: int = 65536) -> DataFrame:
    """The best chunks of every query by keyword share after the metadata boost, with their rank, as boosted_top of keyword_scores.

    Common words stand in most chunks, so a join by token makes nearly all pairs many times over. Here a grid of blocks
    of queries and of chunks is dealt out: a task counts the tokens that a query shares with each chunk of its block,
    slice by slice, and keeps the query's best, so only those are shuffled on. The work still is queries times chunks.
    """
    words = lambda c: F.coalesce(F.array_join(tokens(F.col(c)), " "), F.lit(""))
    asks = queries.select("query_id", words("query").alias("asked")).where("asked <> ''")
    own = chunks.select("locator", *(words(c).alias(c) for c in ("content", "title", "section", "source_type")))
    if index is not None:
        held = index.groupBy("locator").agg(F.array_join(F.collect_set("token"), " ").alias("content"))
        own = own.drop("content").join(held, "locator")
    cores, many = chunks.sparkSession.sparkContext.defaultParallelism, chunks.count()
    across = max(1, -(-queries.count() // block))
    down = max(1, -(-many // rows), min(-(-cores // across), -(-many // 1024)))
    place = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = own.withColumn("down", place("locator", down)).withColumn("across", every(across))
    right = asks.withColumn("across", place("query_id", across)).withColumn("down", every(down))
    by = ["down", "across"]
    best = left.repartition(across * down, *by).groupBy(*by).cogroup(right.repartition(across * down, *by).groupBy(*by)).applyInPandas(
        _keyword_searcher(limit, s), "query_id long, locator string, score double")
    return top_k(best, limit)


def _keyword_searcher(limit: int, s: Settings):
    fields = (("title", s.boost_title), ("section", s.boost_section), ("source_type", s.boost_source_type))
    most = s.boost_most

    def search(own: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        known: dict[str, int] = {}
        asked = [np.array([known.setdefault(t, len(known)) for t in words.split(" ")]) for words in asks.asked]
        kind = np.uint8 if max(map(len, asked), default=0) < 256 else np.uint32
        width = max(256, min(2048, (1 << 26) // max(1, len(known))))
        own = own.sort_values("locator", ignore_index=True)  # so places are in the order of locators
        best = [(np.empty(0), np.empty(0, np.int64))] * len(asked)

        def table(texts):
            """(row of each known token, one line of a row for each text): row 0 is that of tokens in no text."""
            found = [[known[t] for t in text.split(" ") if t in known] for text in texts]
            ids = np.array([i for one in found for i in one], np.int64)
            there, row = np.unique(ids, return_inverse=True)
            rows = np.zeros(len(known), np.int64)
            rows[there] = np.arange(1, len(there) + 1)
            bits = np.zeros((len(there) + 1, len(texts)), kind)
            bits[row + 1, np.repeat(np.arange(len(texts)), [len(one) for one in found])] = 1
            return rows, bits

        def shared(words, rows, bits):
            own_rows = rows[words]
            return np.add.reduce(bits[own_rows[own_rows > 0]], axis=0, dtype=kind)

        for at in range(0, len(own) if asked else 0, width):
            part = own.iloc[at : at + width]
            content = table(part.content)
            extra = [(weight, table(part[name])) for name, weight in fields]
            for i, words in enumerate(asked):
                score, place = best[i]
                least = score[-1] if len(score) == limit else 0.0
                hits = shared(words, *content)
                near = np.flatnonzero((hits > 0) & (hits / len(words) + most >= least))
                if not len(near):
                    continue
                base = hits[near] / len(words)
                boost = sum(weight * (shared(words, *t)[near] / len(words)) for weight, t in extra)
                boost = np.maximum(0.0, np.minimum(most, boost))
                total = np.where(boost > 0, np.maximum(0.0, np.minimum(1.0, base + boost)), base)
                if len(score) == limit:
                    more = total > least  # of equal scores the earlier locator stays
                    near, total = near[more], total[more]
                if len(total) > limit:
                    more = total >= np.partition(total, len(total) - limit)[len(total) - limit]
                    near, total = near[more], total[more]
                score, place = np.concatenate([score, total]), np.concatenate([place, near + at])
                order = np.argsort(-score, kind="stable")[:limit]
                best[i] = score[order], place[order]
        names = own.locator.to_numpy(object)
        sizes = [len(score) for score, _ in best]
        score, place = (np.concatenate([np.empty(0, t), *x]) for t, x in ((np.float64, [b[0] for b in best]), (np.int64, [b[1] for b in best])))
        return pd.DataFrame({"query_id": np.repeat(asks.query_id.to_numpy(np.int64), sizes), "locator": pd.Series(names[place], dtype=object), "score": score})

    return search


def named_in(queries: DataFrame, names: DataFrame, name: str, key: str) -> DataFrame:
    """(query_id, key), each once: names that stand in the query, however many names there are; empty ones in none.

    An equi-join on runs of characters. A query's tokens are parts of it, so names that are one of them are found too.
    """
    asked = queries.select("query_id", F.lower("query").alias("_q"))
    return contained(names.select(key, F.col(name).alias("_known")), asked, "_known", "_q").select("query_id", key).distinct()


def entity_recall(queries: DataFrame, entities: DataFrame, mentions: DataFrame, limit: int) -> DataFrame:
    """Chunks that mention entities named in the query: 2 + a tenth for each of up to 4 mentions, best per chunk.

    All entities are looked for. An entity gives its first chunks in the order of the result to the queries that name
    it: any other one has as many before it in each of them. entities: entity_id, normalized_name; mentions: entity_id,
    locator, mention_count.
    """
    most = min(30, 3 * limit)
    score = F.max(2 + F.lit(0.1) * F.least("mention_count", F.lit(4))).alias("score")
    first = top_k(mentions.groupBy("entity_id", "locator").agg(score), most, ("entity_id",)).drop("rank")
    direct = named_in(queries, entities, "normalized_name", "entity_id")
    best = first.join(direct, "entity_id").groupBy("query_id", "locator").agg(F.max("score").alias("score"))
    return top_k(best, most)


def tag_recall(queries: DataFrame, tags: DataFrame, assignments: DataFrame, assets: DataFrame, limit: int) -> DataFrame:
    """Evidence of approved tags named in the query, in turn across assets, all with score 1.

    All active tags are looked for. A list takes its assets by their ids, so a tag gives those of its assets that have
    evidence and are first by id: any other one has as many before it in each list, all with their first evidence.
    """
    named = named_in(queries, tags.where("status = 'active'"), "normalized_name", "tag_id")
    approved = assignments.where("state = 'approved'").select("tag_id", "asset_id").distinct()
    backed = approved.join(assets.select("asset_id").distinct(), "asset_id", "left_semi")
    first = ranked(backed, ["tag_id"], [F.col("asset_id")], "_n").where(F.col("_n") <= limit)
    held = first.join(named, "tag_id").select("query_id", "asset_id").distinct()
    deep = ranked(assets, ["asset_id"], [F.col("ordinal"), F.col("locator")], "_depth").where(F.col("_depth") <= limit)
    hits = deep.join(held, "asset_id").withColumn("score", F.lit(1.0))
    return ranked(hits, ["query_id"], [F.col("_depth"), F.col("asset_id")]).where(F.col("rank") <= limit).drop("_depth")


def auto_tags(documents: DataFrame, tags: DataFrame, assigned: DataFrame) -> DataFrame:
    """Pending proposals for tags whose name stands in title or text and that the document does not have yet."""
    texts = documents.select("document_id", F.lower(F.concat_ws("\n", "title", "content")).alias("_text"))
    met = contained(tags.select("tag_id", "normalized_name"), texts, "normalized_name", "_text")
    new = met.select("document_id", "tag_id").join(assigned.select("document_id", "tag_id"), ["document_id", "tag_id"], "left_anti")
    return new.withColumns({"state": F.lit("pending"), "confidence": F.lit(1.0)})


def mention_counts(chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity_id, locator, mention_count) of entities that stand in a chunk."""
    texts = chunks.select("locator", F.lower("content").alias("_text"))
    met = contained(entities.select("entity_id", "normalized_name"), texts, "normalized_name", "_text")
    return met.select("entity_id", "locator", occurrences(F.col("_text"), F.col("normalized_name")).alias("mention_count"))


def _cover_density(places: Column, terms: Column) -> Column:
    """Sum over minimal covers of all terms: a tenth, divided by one more than the words between the terms.

    places: array of (pos, term) in order. The fold keeps where each term stood last; the least of these begins a cover.
    """
    none = F.transform(terms, lambda t: F.lit(0))
    start = F.struct(none.alias("last"), F.lit(0).alias("begin"), F.lit(0.0).alias("total"), F.lit(0).alias("i"))

    def step(s, p):
        i = s["i"] + 1
        at = F.array_position(terms, p["term"]).cast("int") - 1
        last = F.transform(s["last"], lambda x, j: F.when(j == at, i).otherwise(x))
        first = F.array_min(last)
        whole = (first > 0) & (first != s["begin"])
        between = F.greatest(p["pos"] - F.element_at(places, F.greatest(first, F.lit(1)))["pos"] - (i - first), F.lit(0))
        return F.struct(last.alias("last"), F.when(whole, first).otherwise(s["begin"]).alias("begin"),
                        (s["total"] + F.when(whole, F.lit(0.1) / (1 + between)).otherwise(0.0)).alias("total"), i.alias("i"))

    return F.aggregate(places, start, step, lambda s: s["total"])


def full_text_recall(queries: DataFrame, chunks: DataFrame, limit: int | None = None) -> DataFrame:
    """Chunks that hold every word of the question, by cover density s mapped to s / (1 + s); all, or the best.

    An optional lexical mode beside keyword recall. Words are runs of letters and digits, lower-cased.
    """
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    asked = queries.select("query_id", F.array_distinct(words(F.col("query"))).alias("_w")).where(F.size("_w") > 0)
    terms = asked.select("query_id", F.size("_w").alias("_n"), F.explode("_w").alias("term"))
    held = chunks.select("locator", F.explode_outer(F.array_distinct(words(F.col("content")))).alias("term")).where("term IS NOT NULL")
    met = held.join(terms, "term").groupBy("query_id", "locator", "_n").agg(F.count("*").alias("_found")).where("_found = _n")
    # places only of the chunks that hold all words
    full = met.select("query_id", "locator").join(asked, "query_id").join(chunks.select("locator", "content"), "locator")
    placed = F.filter(F.transform(words(F.col("content")), lambda w, i: F.struct(i.alias("pos"), w.alias("term"))), lambda x: F.array_contains("_w", x["term"]))
    scored = full.withColumn("_p", placed).withColumn("_s", _cover_density(F.col("_p"), F.col("_w")))
    scored = scored.select("query_id", "locator", (F.col("_s") / (1 + F.col("_s"))).alias("score"))
    return scored if limit is None else top_k(scored, limit)
