"""The search path over many questions: keyword hits in a grid, chunks described once, texts that travel cut."""

import random

from pyspark.sql import functions as F

from tidepool.operators import recall, selection


def corpus(spark, n=400, seed=8):
    rng = random.Random(seed)
    word = lambda: rng.choice(["red", "Blue", "green", "grey", "black", "中", "文", "x", "rare%d" % rng.randrange(90)])
    text = lambda most: " ".join(word() for _ in range(rng.randint(0, most)))
    rows = [(f"c{i:03}", f"d{i % 90}", i // 90, rng.choice([text(4), None]), rng.choice(["a", "", None]), rng.choice(["red", "md"]), text(30)) for i in range(n)]
    rows += [("z1", "dz", 0, "red", "a", "md", None), ("z2", "dz", 1, "red", "a", "md", "")]
    chunks = spark.createDataFrame(rows, "locator string, document_id string, ordinal int, title string, section string, source_type string, content string")
    asked = [(q, text(12)) for q in range(60)] + [(100, " ".join(f"rare{i}" for i in range(300))), (101, None), (102, "")]
    return chunks, spark.createDataFrame(asked, "query_id long, query string")


def test_keyword_grid_equals_the_join(spark):
    chunks, asked = corpus(spark)
    index = recall.token_index(chunks)
    want = recall.boosted_top(recall.keyword_scores(asked, index), asked, chunks, 7).select("query_id", "locator", "score", "rank").collect()
    for given in ({}, {"block": 9, "rows": 50}, {"index": index}):
        got = recall.boosted_keywords(asked, chunks, 7, **given)
        assert sorted(got.collect()) == sorted(want) and len(want) > 300
    assert recall.boosted_keywords(asked.limit(0), chunks, 7).count() == 0 == recall.boosted_keywords(asked, chunks.limit(0), 7).count()


def test_described_hits_are_reranked_alike(spark):
    chunks, asked = corpus(spark)
    found = recall.boosted_keywords(asked, chunks, 9).join(asked, "query_id")
    plain = selection.rule_rerank(selection.drop_low_information(found.join(chunks, "locator")), 5)
    plain = selection.with_tokens(plain).select("query_id", "locator", "score", "rank", "tokens")
    known = selection.described(found, chunks)
    assert "content" not in known.columns
    slim = selection.rule_rerank(selection.drop_low_information(known), 5).select("query_id", "locator", "score", "rank", "tokens")
    assert sorted(slim.collect(), key=str) == sorted(plain.collect(), key=str) and plain.count() > 200


def test_parents_of_long_texts(spark):
    """A text beyond parent_chars keeps its start and no neighbour, and none fits as a neighbour."""
    rows = [("a0", "a", 0, "s", "t" * 20), ("a1", "a", 1, "s", "b" * 9000), ("a2", "a", 2, "s", "u" * 30), ("a3", "a", 3, "s", "v" * 2400)]
    chunks = spark.createDataFrame(rows, "locator string, document_id string, ordinal int, section string, content string")
    hits = chunks.withColumn("query_id", F.lit(1))
    out = selection.expand_parents(hits, chunks)
    got = {r["locator"]: (r["content"], r["parts"]) for r in out.collect()}
    assert got == {"a0": ("t" * 20 + "\n\n" + "u" * 30, 2), "a1": ("b" * 2400, 1), "a2": ("t" * 20 + "\n\n" + "u" * 30, 2), "a3": ("v" * 2400, 1)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("substring(content") >= 2
