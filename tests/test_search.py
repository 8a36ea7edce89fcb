"""The routes of the whole search path and their fusion, against a sequential version."""

import random

import pytest
from pyspark.sql import functions as F

from tidepool.operators import recall
from tidepool.operators.ranking import top_k, within
from tidepool.plans.search import Corpus, candidates, diagnostics, fuse_routes, routes_of, search, variants
from tidepool.settings import DEFAULTS


def rrf(lists, width):
    total = {}
    for weight, names in lists:
        for rank, name in enumerate(names, 1):
            total[name] = total.get(name, 0.0) + weight / (60 + rank)
    best = max(total.values(), default=1.0)
    return [(n, x / best) for n, x in sorted(total.items(), key=lambda p: (-p[1], p[0]))[:width]]


def test_fusion_equals_a_sequential_one(spark):
    rng, rows, width = random.Random(4), [], 5
    profiles = {q: rng.choice(["local", "multi_hop", "global"]) for q in range(30)}
    lists = {}
    for q, profile in profiles.items():
        for route, places in (("keyword", 3), ("semantic", 1), ("entity", 2), ("tag", 1), ("graph", 1), ("community", 1)):
            if (route == "graph" and profile == "local") or (route == "community" and profile != "global"):
                continue
            for place in range(places):
                names = rng.sample("abcdefghijklm", rng.randint(0, 8))
                lists[q, route, place] = names
                rows += [(q, place, route, n, i) for i, n in enumerate(names, 1)]
    found = spark.createDataFrame(rows, "query_id long, place int, route string, locator string, rank int")
    asked = spark.createDataFrame(list(profiles.items()), "query_id long, profile string")
    out = fuse_routes(found, asked, {"keyword", "semantic", "entity", "tag", "graph", "community"}, width)
    got = {}
    for r in out.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["locator"], r["score"]))
    for q, profile in profiles.items():
        own = lambda route, place=0: lists.get((q, route, place), [])
        names = lambda pairs: [n for n, _ in pairs]
        each = [names(rrf([(1, own("keyword", p)), (1, own("semantic", p))], width)) for p in range(3)]
        want = rrf(list(zip((1, 1, 0.85), each)), width)
        want = rrf([(1, names(want)), (1, names(rrf([(1, own("entity", 0)), (1, own("entity", 1))], width)))], width)
        want = rrf([(1, names(want)), (1, own("tag")[:width])], width)
        if profile != "local":
            want = rrf([(1, names(want)), (1, own("graph")[:width])], width)
        if profile == "global":
            want = rrf([(1, names(want)), (1, own("community")[:width])], width)
        assert names(got.get(q, [])) == names(want)
        assert [x for _, x in got.get(q, [])] == pytest.approx([x for _, x in want])


def test_boost_comes_before_the_ranking(spark):
    rng = random.Random(6)
    word = lambda: rng.choice(["red", "blue", "green", "grey", "black"])
    chunks = spark.createDataFrame([(f"c{i:03}", word(), word(), "x", " ".join(word() for _ in range(3))) for i in range(200)],
                                   "locator string, title string, section string, source_type string, content string")
    asked = spark.createDataFrame([(q, f"{word()} {word()} {word()}") for q in range(20)], "query_id long, query string")
    scores = recall.keyword_scores(asked, recall.token_index(chunks)).cache()
    every = recall.metadata_boost(scores.join(asked, "query_id").join(chunks, "locator"))
    want = top_k(every.select("query_id", "locator", "score"), 7).collect()
    got = recall.boosted_top(scores, asked, chunks, 7).select("query_id", "locator", "score", "rank").collect()
    assert sorted(got) == sorted(want) and len(got) > 7
    few = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.31), (1, "c", 0.2), (2, "z", 0.1)], "query_id long, locator string, score double")
    assert sorted(r["locator"] for r in within(few, 1, 0.2).collect()) == ["a", "b", "z"]


@pytest.fixture(scope="module")
def corpus(spark):
    texts = ["redis keeps the cache warm", "kafka moves events along", "events reach the cache late", "nothing to see in this text"]
    chunks = spark.createDataFrame([(f"document:{i}:chunk:0", str(i), 0, "title", "", "markdown", t) for i, t in enumerate(texts)],
                                   "locator string, document_id string, ordinal int, title string, section string, source_type string, content string")
    entities = spark.createDataFrame([("e1", "redis", "redis", 1), ("e2", "kafka", "kafka", 1)], "entity_id string, name string, normalized_name string, mention_count long")
    mentions = spark.createDataFrame([("e1", "document:0:chunk:0", 1), ("e2", "document:1:chunk:0", 1)], "entity_id string, locator string, mention_count long")
    edges = spark.createDataFrame([("e1", "e2", 0.9, "document:2:chunk:0")], "source_id string, target_id string, confidence double, locator string")
    communities = spark.createDataFrame([(0, "k", "redis kafka", ["document:3:chunk:0"])], "level int, community_key string, text string, source_locators array<string>")
    return Corpus(chunks, entities=entities, mentions=mentions, edges=edges, communities=communities)


def test_routes_by_profile(spark, corpus):
    q = spark.createDataFrame([(1, "redis cache", ["redis cache", "events"]), (2, "redis 依赖", None), (3, "redis 总体", [])], "query_id long, query string, variants array<string>")
    asked = variants(q)
    found = candidates(asked, corpus, 8)
    got = {}
    for r in found.collect():
        got.setdefault((r["query_id"], r["place"], r["route"]), set()).add(r["locator"][9])
    assert got[1, 0, "keyword"] == {"0", "2"} and got[1, 1, "keyword"] == {"1", "2"}
    assert got[1, 0, "entity"] == {"0"} and (1, 1, "entity") not in got and (1, 0, "graph") not in got
    assert got[2, 0, "graph"] == {"0", "1"} and (2, 0, "community") not in got
    assert got[3, 0, "community"] == {"3"}
    assert routes_of(corpus) == {"keyword", "entity", "graph", "community"}
    one = diagnostics(found, 8).where("query_id = 1").first()
    assert (one["keyword_candidates"], one["fused_candidates"], one["entity_candidates"], one["graph_candidates"]) == (4, 3, 1, 0)


def test_whole_path_with_routes(spark, corpus):
    q = spark.createDataFrame([(1, "redis cache"), (2, "你好")], "query_id long, query string")
    evidence, decisions = search(q, corpus, k=3)
    rows = evidence.orderBy("rank").collect()
    assert rows[0]["locator"] == "document:0:chunk:0" and {r["query_id"] for r in rows} == {1}
    by = {r["query_id"]: r for r in decisions.collect()}
    assert by[1]["answerable"] and by[1]["entity_candidates"] == 1 and by[2]["keyword_candidates"] == 0 and by[2]["answerable"] is None
    assert DEFAULTS.boost_most == 0.20 and evidence.where(F.col("content").isNull()).count() == 0
    nothing, none = search(q.limit(0), corpus, k=3)
    assert nothing.count() == 0 and none.count() == 0


def test_governance_by_document_in_the_whole_path(spark):
    """Every chunk of a superseded or future document goes, expired ones lose score, and neighbours stay within a document."""
    chunks = spark.createDataFrame([(f"document:{d}:chunk:{i}", d, i, "same title", "same section", "markdown", f"redis keeps the cache warm, part {i} of {d}")
                                    for d in "ABCDE" for i in range(3)],
                                   "locator string, document_id string, ordinal int, title string, section string, source_type string, content string")
    day = "2026-01-{:02}".format
    facts = [("A", None, None, None, "indexed"), ("B", None, None, "A", "indexed"), ("C", day(20), None, None, "indexed"),
             ("D", None, day(5), None, "indexed"), ("E", None, None, "B", "archived")]
    governed = spark.createDataFrame([(d, "standard", "none", e, x, s, st) for d, e, x, s, st in facts],
                                     "document_id string, trust_level string, conflict_state string, effective_at string, expires_at string, supersedes_document_id string, status string")
    governed = governed.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("effective_at", "expires_at")})
    asked = spark.createDataFrame([(1, "redis cache warm")], "query_id long, query string")
    evidence, _ = search(asked, Corpus(chunks, governed=governed), k=8, as_of=F.lit("2026-01-10").cast("timestamp_ntz"))
    rows = evidence.collect()
    assert {r["locator"][9] for r in rows} == {"B", "D", "E"} and any(r["locator"].endswith(":2") for r in rows)
    score = {d: max(r["score"] for r in rows if r["locator"][9] == d) for d in "BDE"}
    assert score["D"] < score["B"]
    for r in rows:
        assert {w for w in "ABCDE" if f"of {w}" in r["content"]} == {r["locator"][9]}


def test_keyword_hits_are_ranked_before_they_are_shuffled(spark):
    """Counting needs no exchange of (query, chunk) pairs: of each partition only the best go on."""
    rng = random.Random(2)
    word = lambda: rng.choice("one two three four five six seven eight nine ten".split())
    chunks = spark.createDataFrame([(f"c{i:04}", " ".join(word() for _ in range(5))) for i in range(2000)], "locator string, content string").repartition(4)
    asked = spark.createDataFrame([(q, f"{word()} {word()} {word()} {word()}") for q in range(10)], "query_id long, query string")
    found = recall.keyword_recall(asked, recall.token_index(chunks), 7)
    rows = [(r["query_id"], r["locator"]) for r in found.collect()]
    assert len(rows) == 70 and found.where("rank > 7").isEmpty()
    plan = found._jdf.queryExecution().executedPlan().toString()
    at = [plan.index(x) for x in ("WindowGroupLimit", "hashpartitioning(query_id", "HashAggregate")]
    assert at == sorted(at)  # limited again on both sides of the only exchange above the counts
    between = plan[plan.index("Partial") : plan.index("Generate")]
    assert "Exchange hashpartitioning(query_id" not in between
