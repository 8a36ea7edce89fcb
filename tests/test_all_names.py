"""Recall by name looks for every entity and tag, however many there are."""

import random

import pytest
from pyspark.sql import functions as F

from tidepool.operators import recall
from tidepool.plans.search import Corpus, search


@pytest.fixture(scope="module")
def named(spark):
    """120 names, entity i in i + 1 or more chunks: more names than were once looked at, the last asked for is mentioned least."""
    rng = random.Random(1)
    names = spark.createDataFrame([(i, f"name{i:03}x") for i in range(120)], "id long, normalized_name string")
    rows = {(i, f"c{rng.randrange(300):03}"): rng.randint(1, 6) for i in range(120) for _ in range(i + 1)}
    mentions = spark.createDataFrame([(*k, n) for k, n in rows.items()], "entity_id long, locator string, mention_count long")
    asked = {q: " and ".join(f"Name{i:03}X" for i in rng.sample(range(120), rng.randint(0, 4))) for q in range(40)} | {50: "name000x", 51: "name119x"}
    return names, rows, mentions, asked, spark.createDataFrame(list(asked.items()), "query_id long, query string")


def test_entities_beyond_the_most_mentioned(spark, named):
    names, rows, mentions, asked, queries = named
    counted = mentions.groupBy("entity_id").agg(F.count("*").alias("mention_count")).join(names.withColumnRenamed("id", "entity_id"), "entity_id")
    found = recall.entity_recall(queries, counted, mentions, 2)
    want = []
    for q, text in asked.items():
        score = {}
        for (i, locator), n in rows.items():
            if f"name{i:03}x" in text.lower():
                score[locator] = max(score.get(locator, 0), 2 + 0.1 * min(n, 4))
        want += [(q, at + 1, c) for at, (c, _) in enumerate(sorted(score.items(), key=lambda x: (-x[1], x[0]))[:6])]
    assert sorted((r["query_id"], r["rank"], r["locator"]) for r in found.collect()) == sorted(want) and 50 in {q for q, *_ in want}
    assert "NestedLoop" not in (plan := found._jdf.queryExecution().toString()) and "Cartesian" not in plan


def test_tags_beyond_the_first_names(spark, named):
    names, rows, _, asked, queries = named
    tags = names.select(F.col("id").alias("tag_id"), "normalized_name", F.when(F.col("id") % 5 == 1, "closed").otherwise("active").alias("status"))
    held = [(int(c[1:]), i, "approved" if n % 3 else "pending") for (i, c), n in rows.items()]
    assets = [(a, f"c{a:03}:{o}", o) for a in range(300) for o in range(a % 4)]  # some have no evidence
    out = recall.tag_recall(queries, tags, spark.createDataFrame(held, "asset_id long, tag_id long, state string"),
                            spark.createDataFrame(assets, "asset_id long, locator string, ordinal int"), 7)
    want = []
    for q, text in asked.items():
        own = {a for a, i, state in held if state == "approved" and i % 5 != 1 and f"name{i:03}x" in text.lower()}
        best = sorted((o, a, c) for a, c, o in assets if a in own)[:7]
        want += [(q, at + 1, c) for at, (_, _, c) in enumerate(best)]
    assert sorted((r["query_id"], r["rank"], r["locator"]) for r in out.collect()) == sorted(want) and 51 in {q for q, *_ in want}


@pytest.mark.parametrize("part", (0, 1))
def test_search_finds_rare_entities_and_late_tags(spark, named, part):
    """The whole path: what only an entity or a tag beyond the first 48 leads to is evidence (0), and is counted in the decisions (1)."""
    names, _, mentions, _, queries = named
    chunks = spark.createDataFrame([(f"c{i:03}", str(i), 0, "title of it", "", "md", f"words on the matter {i}") for i in range(300)],
                                   "locator string, document_id string, ordinal int, title string, section string, source_type string, content string")
    own = names.select(F.col("id").alias("entity_id"), "normalized_name")
    counted = mentions.groupBy("entity_id").agg(F.count("*").alias("mention_count")).join(own, "entity_id")
    tags = names.select(F.col("id").alias("tag_id"), "normalized_name", F.lit("active").alias("status"))
    assigned = spark.createDataFrame([(7, 119, "approved")], "asset_id long, tag_id long, state string")
    assets = spark.createDataFrame([(7, "c007", 0)], "asset_id long, locator string, ordinal int")
    corpus = Corpus(chunks, entities=counted, mentions=mentions, tags=tags, assignments=assigned, assets=assets)
    asked = queries.where("query_id IN (50, 51)").withColumn("query", F.concat("query", F.lit(" 之间 matter")))
    evidence, decisions = search(asked, corpus)
    if part:
        by = {r["query_id"]: r for r in decisions.collect()}
        assert by[50]["entity_candidates"] == 1 and by[50]["tag_candidates"] == 0 and by[51]["tag_candidates"] == 1 and by[51]["entity_candidates"] > 1
    else:
        only = mentions.where("entity_id = 0").first()["locator"]
        got = {(r["query_id"], r["locator"]) for r in evidence.collect()}
        assert (50, only) in got and (51, "c007") in got
