"""Extraction, components, Louvain and communities against literal cases."""

import random

from pyspark.sql import functions as F

from tidepool.operators import graph, louvain
from tidepool.settings import Settings


def test_extraction():
    x = graph.extract("# 服务拓扑\n\nAPI 依赖 Redis，Redis 影响缓存稳定性。")
    assert {(r["source"], r["target"], r["relation_type"]) for r in x["relations"] if r["confidence"] == 0.85} == {
        ("api", "redis", "依赖"), ("redis", "缓存稳定性", "影响")}
    assert ("服务拓扑", "topic") in {(e["normalized_name"], e["entity_type"]) for e in x["entities"]}
    assert any(r["relation_type"] == "co_occurs" for r in x["relations"])
    assert graph.extract(None) == {"entities": [], "relations": []}


def test_index(spark):
    chunks = spark.createDataFrame([("l1", "API uses Redis. Redis"), ("l2", "Redis alone")], "locator string, content string")
    entities, mentions, edges = graph.build_index(chunks)
    n = {r["normalized_name"]: r["mention_count"] for r in entities.collect()}
    assert n["redis"] == 2 and n["api"] == 1
    assert edges.where("relation_type = 'uses'").count() == 1
    assert mentions.where("locator = 'l1'").agg(F.max("mention_count")).first()[0] == 2


def test_edge_weights(spark):
    e = spark.createDataFrame([("a", "b", 0.5), ("b", "a", 0.6), ("a", "c", 0.1), ("a", "a", 0.9)], "source_id string, target_id string, confidence double")
    assert [(r["a"], r["b"], round(r["weight"], 6)) for r in graph.edge_weights(e).collect()] == [("a", "b", 1.1)]


PAIRS = [("A", "B", 0.95), ("A", "C", 0.92), ("B", "C", 0.90), ("D", "E", 0.95), ("D", "F", 0.92), ("E", "F", 0.90), ("C", "D", 0.40)]


def test_components_and_louvain(spark):
    v = spark.createDataFrame([("kb", x) for x in "ABCDEFG"], "kb_id string, entity_id string")
    p = spark.createDataFrame([("kb", *x) for x in PAIRS], "kb_id string, a string, b string, weight double")
    cc = {r["entity_id"]: r["component"] for r in graph.connected_components(v, p).collect()}
    assert cc == dict.fromkeys("ABCDEF", "A") | {"G": "G"}
    lv = {r["entity_id"]: r["component"] for r in louvain.louvain(v, p).collect()}
    assert lv == dict.fromkeys("ABC", "A") | dict.fromkeys("DEF", "D") | {"G": "G"}


def test_components_equal_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(190)] + [(i, i + 1) for i in range(400, 470)]
    root = list(range(500))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    v = spark.range(500).withColumnRenamed("id", "entity_id")
    got = graph.connected_components(v, spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["entity_id"]: r["component"] for r in got} == {i: find(i) for i in range(500)}


def test_communities(spark):
    members = spark.createDataFrame([("e1", "e1"), ("e2", "e1"), ("e3", "e3")], "entity_id string, component string")
    entities = spark.createDataFrame([("e1", "Redis", "redis", 3), ("e2", "API", "api", 5), ("e3", "Solo", "solo", 1)],
                                     "entity_id string, name string, normalized_name string, mention_count long")
    mentions = spark.createDataFrame([("e1", "l2"), ("e2", "l1"), ("e3", "l9")], "entity_id string, locator string")
    edges = spark.createDataFrame([("e1", "e3", "l5")], "source_id string, target_id string, locator string")
    out = {r["title"]: r for r in graph.build_communities(members, entities, mentions, edges).collect()}
    assert out["API、Redis"]["source_locators"] == ["l1", "l2", "l5"] and out["API、Redis"]["members"] == 2
    assert [(r["level"], r["members"], r["source_locators"]) for r in out.values() if r["level"]] == [(1, 3, ["l1", "l2", "l5", "l9"])]
    assert out["Solo"]["source_locators"] == ["l5", "l9"]
    built = graph.build_communities(members, entities, mentions, edges)
    chunks = spark.createDataFrame([("l1", "one"), ("l2", "two"), ("l5", "five"), ("l9", "nine")], "locator string, content string")
    gate = graph.community_gate(built, members, entities, chunks).first()
    assert gate["passed"] and gate["communities"] == 3
    assert not graph.community_gate(built, members, entities, chunks.where("locator <> 'l9'")).first()["passed"]
    summaries = {r["title"]: r["summary"] for r in graph.community_summaries(built, chunks).collect()}
    assert summaries["API、Redis"].endswith("one；two；five")


def test_community_recall(spark):
    q = spark.createDataFrame([(1, ["redis"], False), (2, ["none"], True)], "query_id long, community_tokens array<string>, is_global boolean")
    c = spark.createDataFrame([(0, "k1", "redis cache", ["a", "b"]), (1, "k2", "other", ["b", "c"])],
                              "level int, community_key string, text string, source_locators array<string>")
    out = graph.community_recall(q, c, 10).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["locator"]) for r in out] == [(1, "a"), (1, "b"), (2, "c"), (2, "a"), (2, "b")]
    last = {(r["query_id"], r["locator"]): r["score"] for r in out}
    assert last[1, "a"] == 1.0 and last[2, "b"] == 1 / 4  # its last place counts


def test_one_hop_is_cut_in_a_fixed_order(spark):
    seeds = spark.createDataFrame([(1, "s")], "query_id long, entity_id string")
    edges = spark.createDataFrame([("s", f"t{i:03}", "l") for i in range(60)] + [("x", "s", "l")], "source_id string, target_id string, locator string")
    out = graph.one_hop(seeds, edges, Settings(graph_edges=40, graph_entities=10)).collect()
    assert len(out) == 10 and {r["entity_id"] for r in out if r["direct"]} == {"s"}


def test_relation_mode(spark):
    df = spark.createDataFrame([("Redis 是什么",), ("A 和 B 的关系",), ("总结全部",)], "q string")
    assert [r[0] for r in df.select(graph.relation_mode(F.col("q"))).collect()] == ["local", "multi_hop", "global"]


def test_entities_give_only_chunks_that_may_be_found(spark):
    """Against a plain count: entities that meet in chunks, repeated mentions, and far more mentions than are returned."""
    rng = random.Random(3)
    seeds = [(q, f"e{q % 7}") for q in range(12)] + [(1, "e5"), (1, "e5")]
    edges = [(f"e{rng.randrange(30)}", f"e{rng.randrange(30)}", f"l{i}") for i in range(60)] * 2
    mentions = [(f"e{rng.randrange(30)}", f"l{rng.randrange(150):03}", rng.randint(1, 6)) for _ in range(3000)]
    ordinal = {f"l{i:03}": i % 5 for i in range(150)}
    s = Settings(graph_edges=20, graph_entities=12)
    near = {q: {} for q, _ in seeds}
    for q in near:
        own = {e for k, e in seeds if k == q}
        first = sorted({e for e in edges if own & set(e[:2])})[:20]
        others = sorted({x for e in first for x in e[:2]} - own)
        near[q] = {e: 2.0 for e in own} | {e: 0.75 for e in others[: 12 - len(own)]}
    want = []
    for q, found in near.items():
        best = {}
        for e, loc, n in mentions:
            if e in found:
                best[loc] = max(best.get(loc, 0), found[e] + 0.1 * min(n, 4))
        best = sorted(best.items(), key=lambda x: (-round(x[1], 6), ordinal[x[0]], x[0]))[:6]
        want += [(q, loc, round(score, 6), i + 1) for i, (loc, score) in enumerate(best)]
    m = spark.createDataFrame([(*x, ordinal[x[1]]) for x in mentions], "entity_id string, locator string, mention_count long, ordinal int")
    given = spark.createDataFrame(seeds, "query_id long, entity_id string"), spark.createDataFrame(edges, "source_id string, target_id string, locator string")
    chunks = spark.createDataFrame(list(ordinal.items()), "locator string, ordinal int")
    for found in (graph.graph_recall(*given, m, None, 6, s=s), graph.graph_recall(*given, m.drop("ordinal"), chunks, 6, s=s)):
        assert sorted((r["query_id"], r["locator"], round(r["score"], 6), r["rank"]) for r in found.collect()) == sorted(want)
    assert graph.first_mentions(m, 6).groupBy("entity_id").count().agg(F.max("count")).first()[0] == 6
