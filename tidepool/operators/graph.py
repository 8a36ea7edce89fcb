"""Entities, relations, one-hop recall, connected components and communities."""

from __future__ import annotations

import re
import tempfile
import uuid
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType
from pyspark.sql.window import Window

from tidepool.functions.digests import tree_digest
from tidepool.functions.text import entity_name, summary
from tidepool.operators.containment import contained
from tidepool.operators.ranking import coverage_first, ranked
from tidepool.settings import DEFAULTS, Settings

#: Patterns of entities and relations, and words that are no entity.
RELATION = re.compile(
    r"([一-鿿A-Za-z0-9_./:-]{2,24})\s*"
    r"(依赖于|依赖|导致|影响|包含|使用|属于|关联|连接|支持|实现|调用|通过|对应|来自|位于|提升|降低|阻止|解决|"
    r"depends on|causes|affects|uses|contains|supports|implements|calls|relates to)\s*"
    r"([一-鿿A-Za-z0-9_./:-]{2,24})", re.IGNORECASE)
PROPER_NOUN = re.compile(r"\b[A-Z][A-Za-z0-9_.:/-]{1,63}\b")
CODE = re.compile(r"`([^`\n]{2,80})`")
HEADING = re.compile(r"^\s{0,3}#{1,6}\s+(.+?)\s*$")
SENTENCE = re.compile(r"[^。！？!?;；\n]+[。！？!?;；]?")
STOP_ENTITIES = {
    "这是", "可以", "如果", "因为", "所以", "我们", "系统", "用户", "文档", "内容", "问题", "结果", "方法",
    "the", "this", "that", "with", "from",
}
STATED, TOGETHER, MOST_TOGETHER = 0.85, 0.45, 8

_EXTRACTION = [
    StructField("entities", ArrayType(StructType([StructField(n, StringType()) for n in ("name", "normalized_name", "entity_type")]))),
    StructField("relations", ArrayType(StructType(
        [StructField(n, StringType()) for n in ("source", "target", "relation_type")] + [StructField("confidence", DoubleType())]))),
]


def valid_entity(name: str) -> bool:
    return (2 <= len(name) <= 160 and name not in STOP_ENTITIES and not name.isdecimal()
            and not any(mark in name for mark in ("\n", "```", "。", "！", "？")))


def extract(text: str | None) -> dict:
    """Entities and relations of one chunk; of several sightings of an entity the first gives name and type.

    Headings, code and proper nouns are known to every sentence, the ends of stated relations from their sentence on.
    """
    text = text or ""
    sentences = [s.strip() for s in SENTENCE.findall(text)]
    stated = [(i, *m) for i, s in enumerate(sentences) for m in RELATION.findall(s)]
    codes = [c.strip() for c in CODE.findall(text)]
    seen = [(-1, m[1], "topic") for m in map(HEADING.match, text.splitlines()) if m]
    seen += [(-1, c, "technology") for c in codes if not c.startswith(("http://", "https://"))]
    seen += [(-1, n, "proper_noun") for n in PROPER_NOUN.findall(text)]
    seen += [(i, end, "concept") for i, a, _, b in stated for end in (a, b)]
    keyed = [(entity_name(raw), since, raw.strip(), kind) for since, raw, kind in seen]
    first = {key: rest for key, *rest in reversed(keyed) if valid_entity(key)}
    known = sorted(first, key=[key for key, *_ in keyed].index)  # in the order of first sight

    linked = [(i, entity_name(a), entity_name(b), verb.lower()) for i, a, verb, b in stated]
    linked = [x for x in linked if x[1] in first and x[2] in first and x[1] != x[2]]
    edges = {(a, b, verb): STATED for _, a, b, verb in linked}
    for i, sentence in enumerate(map(entity_name, sentences)):
        ends = [end for n, a, b, _ in linked if n == i for end in (a, b)]
        there = [*ends, *(k for k in known if first[k][0] <= i and k in sentence)]
        for a, b in combinations(list(dict.fromkeys(there))[:MOST_TOGETHER], 2):
            edges.setdefault((a, b, "co_occurs"), TOGETHER)
    return {
        "entities": [{"name": first[k][1], "normalized_name": k, "entity_type": first[k][2]} for k in known],
        "relations": [{"source": a, "target": b, "relation_type": r, "confidence": c} for (a, b, r), c in edges.items()],
    }


def extracted(chunks: DataFrame, rows: int = 100, most_bytes: int = 1 << 18) -> DataFrame:
    """chunks (locator, content) with entities and relations, in slices of bounded rows and bytes.

    What is found in a text takes many times its size as Python objects, so a worker holds that of one slice only.
    """
    chunks = chunks.select("locator", "content")
    schema = StructType([*chunks.schema.fields, *_EXTRACTION])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            step = max(1, min(rows, int(batch.num_rows * most_bytes / max(batch.nbytes, 1))))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                found = [extract(t) for t in part.column("content").to_pylist()]
                made = [pa.array([x[f.name] for x in found], f.type) for f in list(arrow)[2:]]
                yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(part.columns, arrow)), *made], schema=arrow)

    return chunks.mapInArrow(run, schema)


def build_index(chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, mentions, relations) of chunks (locator, content). One row per entity, mention and edge of a chunk."""
    drawn = extracted(chunks)
    seen = drawn.select("locator", F.lower("content").alias("_text"), F.explode("entities").alias("e"))
    mentions = seen.select(
        F.sha2("e.normalized_name", 256).alias("entity_id"), "locator", "e.name", "e.normalized_name", "e.entity_type",
        F.greatest(F.lit(1), (F.length("_text") - F.length(F.replace("_text", F.col("e.normalized_name"), F.lit("")))) / F.length("e.normalized_name"))
        .cast("long").alias("mention_count"))
    first = F.min(F.struct("locator", "name", "entity_type"))
    entities = mentions.groupBy("entity_id", "normalized_name").agg(first.alias("_f"), F.count("*").alias("mention_count"))
    entities = entities.select("entity_id", "normalized_name", "_f.name", "_f.entity_type", "mention_count")
    edges = drawn.select("locator", F.explode("relations").alias("r")).select(
        F.sha2("r.source", 256).alias("source_id"), F.sha2("r.target", 256).alias("target_id"), "r.relation_type", "r.confidence", "locator")
    return entities, mentions.select("entity_id", "locator", "mention_count"), edges


def edge_weights(edges: DataFrame, threshold: float = DEFAULTS.graph_threshold) -> DataFrame:
    """Undirected pairs (a < b) with the summed confidence of their edges at or above the threshold; no loops."""
    strong = edges.where((F.col("confidence") >= threshold) & (F.col("source_id") != F.col("target_id")))
    pair = strong.select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b"), "confidence")
    return pair.groupBy("a", "b").agg(F.sum("confidence").alias("weight"), F.count("*").alias("edges"))


def one_hop(seeds: DataFrame, edges: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """(query_id, entity_id, direct): seeds and what an edge joins to them, cut to a fixed number of edges and entities.

    Two equi-joins, one for each end, instead of a join with OR.
    """
    seeds = seeds.select("query_id", "entity_id").distinct()
    touch = None
    for mine, other in (("source_id", "target_id"), ("target_id", "source_id")):
        part = seeds.join(edges.withColumnRenamed(mine, "entity_id"), "entity_id").select(
            "query_id", F.col("entity_id").alias("seed"), F.col(other).alias("found"), "locator",
            F.lit(mine == "source_id").alias("forward"))
        touch = part if touch is None else touch.unionByName(part)
    ends = [F.when(F.col("forward"), F.col(a)).otherwise(F.col(b)) for a, b in (("seed", "found"), ("found", "seed"))]
    edge = touch.select("query_id", ends[0].alias("s"), ends[1].alias("t"), "locator")
    # repeated edges have one place, so tasks drop what is beyond the last one before the shuffle
    nth = F.dense_rank().over(Window.partitionBy("query_id").orderBy("s", "t", "locator"))
    edge = edge.withColumn("_n", nth).where(F.col("_n") <= s.graph_edges)
    reached = edge.select("query_id", F.explode(F.array("s", "t")).alias("entity_id")).distinct()
    both = seeds.withColumn("direct", F.lit(1)).unionByName(
        reached.join(seeds, ["query_id", "entity_id"], "left_anti").withColumn("direct", F.lit(0)))
    cut = ranked(both, ["query_id"], [F.desc("direct"), F.col("entity_id")], "_n").where(F.col("_n") <= s.graph_entities)
    return cut.select("query_id", "entity_id", (F.col("direct") == 1).alias("direct"))


def graph_recall(seeds: DataFrame, edges: DataFrame, mentions: DataFrame, chunks: DataFrame | None, limit: int,
                 covering: bool = False, s: Settings = DEFAULTS) -> DataFrame:
    """Chunks of seeds (2.0) and of their neighbours (0.75), a tenth more for each of up to 4 mentions; best per chunk.

    Without chunks, mentions hold the ordinal of their own chunk, and document_id if covering: nothing is looked up. Then,
    unless covering, an entity gives only its first chunks in the order of the result to those that reach it: any others
    have as many before them in each query. mention_count is a whole number from 1.
    """
    reached = one_hop(seeds, edges, s)
    most = min(60, limit)
    if chunks is None and not covering:
        mentions = first_mentions(mentions, most)
    hits = mentions.join(reached, "entity_id").withColumn(
        "score", F.when(F.col("direct"), 2.0).otherwise(0.75) + F.lit(0.1) * F.least("mention_count", F.lit(4)))
    if chunks is None:
        own = ["query_id", "locator", "ordinal", *(["document_id"] if covering else [])]
        best = hits.repartition("query_id").groupBy(*own).agg(F.max("score").alias("score"))  # dealt once, for chunks and ranks
    else:
        best = hits.groupBy("query_id", "locator").agg(F.max("score").alias("score")).join(chunks, "locator")
    out = ranked(best, ["query_id"], [F.desc("score"), F.col("ordinal"), F.col("locator")])
    if covering:
        out = coverage_first(out).drop("rank").withColumnRenamed("position", "rank")
    return out.where(F.col("rank") <= most)


def first_mentions(mentions: DataFrame, most: int) -> DataFrame:
    """Of each entity the first chunks by (up to 4 mentions, ordinal, locator).

    A chunk may stand in several rows of an entity, with 1 to 4 mentions: so many places more are left by the tasks
    before the shuffle, and after it each chunk has one.
    """
    m = mentions.select("entity_id", "locator", "ordinal", F.least("mention_count", F.lit(4)).alias("mention_count"))
    order = [F.desc("mention_count"), F.col("ordinal"), F.col("locator")]
    nth = F.dense_rank().over(Window.partitionBy("entity_id").orderBy(*order))
    near = m.withColumn("_n", nth).where(F.col("_n") <= 4 * most)
    near = near.groupBy("entity_id", "locator", "ordinal").agg(F.max("mention_count").alias("mention_count"))
    return ranked(near, ["entity_id"], order, "_n").where(F.col("_n") <= most).drop("_n")


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared checkpoint folder and read back."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def connected_components(vertices: DataFrame, pairs: DataFrame, vertex: str = "entity_id") -> DataFrame:
    """(vertex, component): component is the least vertex reachable over pairs (a, b); singletons keep themselves.

    Labels are lowered along the pairs and then along the labels themselves, so that long chains halve in each
    round; a round is written out, and rounds end when none lowers a label.
    """
    ends = saved(pairs.select("a", "b").union(pairs.select("b", "a")).distinct(), "ends")
    labels = saved(vertices.select(F.col(vertex).alias("v"), F.col(vertex).alias("label")).distinct(), "labels")
    while True:
        near = ends.join(labels, F.col("b") == F.col("v")).groupBy("a").agg(F.min("label").alias("near"))
        low = labels.join(near, F.col("v") == F.col("a"), "left").select("v", F.least("label", "near").alias("label"))
        jump = low.select(F.col("v").alias("label"), F.col("label").alias("to"))
        after = saved(low.join(jump, "label", "left").select("v", F.least("label", F.coalesce("to", "label")).alias("label")), "labels")
        moved = after.join(labels.withColumnRenamed("label", "was"), "v").where("label <> was").limit(1)
        labels = after
        if moved.isEmpty():
            return labels.select(F.col("v").alias(vertex), F.col("label").alias("component"))


def build_communities(members: DataFrame, entities: DataFrame, mentions: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per community of level 0, and one of level 1 over them all where there are several.

    (level, component, community_key, title, members, source_locators): title from the four most mentioned members,
    the first sorted source chunks, 80 on level 0 and 120 on level 1. members: entity_id, component. The key is the
    start of the digest of the sorted ids joined by |, and that of a digest tree for groups of more than 4096 members.
    An edge's chunk counts for the groups of both its ends.
    """
    full = members.join(entities, "entity_id")
    key = F.substring("digest", 1, 32).alias("community_key")
    group = tree_digest(full, ["component"], "entity_id").select("component", key, F.col("items").alias("members"))
    order = [F.desc("mention_count"), F.col("normalized_name"), F.col("entity_id")]
    best = ranked(full, ["component"], order, "_n").where(F.col("_n") <= 4).groupBy("component").agg(
        F.array_sort(F.collect_list(F.struct("_n", F.substring("name", 1, 40).alias("name")))).alias("_names"))
    ends = edges.select(F.col("source_id").alias("entity_id"), "locator").union(edges.select("target_id", "locator"))
    # of one member no more than its own first can be among the first of its group, and tasks drop the others before the shuffle
    own = F.dense_rank().over(Window.partitionBy("entity_id").orderBy("locator"))
    near = mentions.select("entity_id", "locator").union(ends).withColumn("_n", own).where(F.col("_n") <= 80)
    sources = near.join(members, "entity_id").select("component", "locator").distinct()
    sources = saved(ranked(sources, ["component"], [F.col("locator")], "_n").where(F.col("_n") <= 80).drop("_n"), "sources")  # used twice
    none = F.array().cast("array<string>")
    chunks = sources.groupBy("component").agg(F.array_sort(F.collect_list("locator")).alias("source_locators"))
    title = F.array_join(F.transform("_names", lambda m: m["name"]), "、").alias("title")
    low = group.join(best, "component").join(chunks, "component", "left").select(
        F.lit(0).alias("level"), "component", "community_key", title, "members", F.coalesce("source_locators", none).alias("source_locators"))
    first = sources.select("locator").distinct().orderBy("locator").limit(120).agg(F.array_sort(F.collect_list("locator")).alias("source_locators"))
    every = tree_digest(full.withColumn("_one", F.lit(1)), ["_one"], "entity_id").select(key, F.col("items").alias("members"))
    whole = group.agg(F.count("*").alias("_groups")).where("_groups > 1").join(every).join(first)  # one row each
    high = whole.select(F.lit(1).alias("level"), F.lit(None).cast(members.schema["component"].dataType).alias("component"), "community_key",
                        F.lit("知识库全局主题").alias("title"), "members", F.coalesce("source_locators", none).alias("source_locators"))
    return low.unionByName(high)


def community_summaries(communities: DataFrame, chunks: DataFrame) -> DataFrame:
    """Adds summary, from the first four source chunks of each community."""
    first = communities.select("community_key", F.posexplode(F.slice("source_locators", 1, 4)).alias("_i", "locator"))
    texts = first.join(chunks.select("locator", "content"), "locator").groupBy("community_key").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_i", "content"))), lambda x: x["content"]).alias("_texts"))
    return communities.join(texts, "community_key", "left").withColumn("summary", summary(F.coalesce("_texts", F.array().cast("array<string>")))).drop("_texts")


def community_recall(queries: DataFrame, communities: DataFrame, limit: int, most: int = 8, chunks: int = 60) -> DataFrame:
    """Chunks of the best communities by token overlap, each scored 1 / (1 + its last place in the joined list).

    queries: query_id, community_tokens, is_global. A global question takes communities without overlap too.
    communities: level, community_key, text (normalised title and summary), source_locators. Tokens are looked up in
    an index of the distinct texts' runs; of one text and level only the first keys can be among a question's best. A
    global question also gets the first communities of either level, which are the best of those without overlap for
    every such question. Source lists don't travel with the questions: chunks are placed once for each distinct list
    of best communities that fill it.
    """
    communities = saved(communities.select("level", "community_key", "text", "source_locators"), "communities")  # used four times
    known = communities.select("level", "community_key", F.coalesce(F.size("source_locators"), F.lit(0)).alias("_size"))
    nth = F.row_number().over(Window.partitionBy("text", "level").orderBy("community_key"))
    alike = communities.select("community_key", "text", nth.alias("_n")).where((F.col("_n") <= most) & F.col("text").isNotNull())
    texts = alike.groupBy("text").agg(F.min("community_key").alias("_same"))  # a short name of the text
    alike = alike.join(texts, "text").select("_same", "community_key")
    asked = queries.select("query_id", "is_global", F.size("community_tokens").alias("_tokens"))
    wanted = queries.select("query_id", F.explode(F.array_distinct("community_tokens")).alias("token"))
    held = contained(wanted.select("token").distinct(), texts.withColumnRenamed("text", "_text"), "token", "_text").select("token", "_same")
    hits = wanted.join(held, "token").groupBy("query_id", "_same").agg(F.count("*").alias("_hits"))
    hits = hits.join(alike, "_same").select("query_id", "community_key", "_hits")
    first = F.row_number().over(Window.partitionBy(F.col("level") > 0).orderBy("level", "community_key"))
    spare = communities.select("level", "community_key", first.alias("_n")).where(F.col("_n") <= most)
    spare = spare.agg(F.collect_list("community_key").alias("_keys"))  # one row of at most 2 * most keys
    more = asked.where("is_global").join(F.broadcast(spare), F.lit(True)).select("query_id", F.explode("_keys").alias("community_key"))
    every = hits.unionByName(more.withColumn("_hits", F.lit(0).cast("long"))).groupBy("query_id", "community_key").agg(F.max("_hits").alias("_hits"))
    best = every.join(asked, "query_id").join(known, "community_key")
    raised = F.col("_hits") + F.when(F.col("is_global") & (F.col("level") > 0), 0.25).otherwise(0.0)
    best = best.withColumn("_s", F.when(F.col("is_global") & (F.col("_tokens") == 0), 0.1).otherwise(raised))
    best = ranked(best, ["query_id"], [F.desc("_s"), F.col("level"), F.col("community_key")], "_c").where(F.col("_c") <= most)
    before = F.sum("_size").over(Window.partitionBy("query_id").orderBy("_c")) - F.col("_size")
    filling = best.withColumn("_before", before).where((F.col("_before") < chunks) & (F.col("_size") > 0))
    lists = filling.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("_c", "community_key"))).alias("_l"))
    lists = saved(lists.select("query_id", F.transform("_l", lambda x: x["community_key"]).alias("_list")), "lists")  # used twice
    flat = lists.select("_list").distinct().select("_list", F.posexplode("_list").alias("_c", "community_key"))
    flat = flat.join(communities.select("community_key", "source_locators"), "community_key").select("_list", "_c", F.posexplode("source_locators").alias("_i", "locator"))
    place = F.row_number().over(Window.partitionBy("_list").orderBy("_c", "_i")) - 1
    last = flat.withColumn("_p", place).where(F.col("_p") < chunks).groupBy("_list", "locator").agg(F.max("_p").alias("_p"))
    top = ranked(last.withColumn("score", 1 / (1 + F.col("_p"))).drop("_p"), ["_list"], [F.desc("score"), F.col("locator")]).where(F.col("rank") <= limit)
    return lists.join(top, "_list").select("query_id", "locator", "score", "rank")


def community_gate(communities: DataFrame, members: DataFrame, entities: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: how many member and chunk references resolve, and whether the index passes (all do, and there are any)."""

    def resolved(flat: DataFrame, known: DataFrame, key: str) -> DataFrame:
        return flat.join(known.select(key).distinct().withColumn("_k", F.lit(True)), key, "left").agg(
            F.count("*").alias("n"), F.coalesce(F.try_divide(F.count("_k"), F.count("*")), F.lit(0.0)).alias("share"))

    communities = saved(communities.select("source_locators"), "communities")  # used twice
    m = resolved(members.select("entity_id"), entities, "entity_id")
    c = resolved(communities.select(F.explode("source_locators").alias("locator")), chunks, "locator")
    one = communities.agg(F.count("*").alias("communities"))
    both = one.join(m.select(F.col("n").alias("members"), F.col("share").alias("member_coverage"))).join(
        c.select(F.col("n").alias("sources"), F.col("share").alias("chunk_coverage")))
    return both.withColumn("passed", (F.col("communities") > 0) & (F.col("member_coverage") == 1) & (F.col("chunk_coverage") == 1))


def relation_mode(query: Column) -> Column:
    """global before multi_hop before local. The marker words."""
    return (F.when(query.rlike("全局|整体|总体|概览|归纳|总结|趋势|主题|有哪些类别|全库|所有文档"), "global")
            .when(query.rlike("关系|关联|如何影响|为什么导致|因果|依赖|之间|链路|共同原因|上下游|影响了|如何连接"), "multi_hop")
            .otherwise("local"))
