"""Community recall of many questions over many communities, against a loop; source lists stay where they are."""

import random

from pyspark.sql import functions as F

from tidepool.operators import graph


def test_community_recall_equals_a_loop(spark):
    rng = random.Random(9)
    word = lambda: rng.choice(["th", "the", "other", "an", "and", "hand", "zz", "中文"])
    rows = []
    for i in range(70):
        own = sorted({f"c{rng.randrange(120):03}" for _ in range(rng.choice([0, 3, 30, 90]))})
        rows.append((int(i % 9 == 0), f"k{i:02}", rng.choice([None, "the other", "the other", word() + " " + word()]), own))
    asked = {q: (list(dict.fromkeys(word() for _ in range(rng.randint(0, 4)))), rng.random() < 0.4) for q in range(80)}
    want = []
    for q, (tokens, whole) in asked.items():
        scored = []
        for level, key, text, own in rows:
            hits = sum(t in (text or "") for t in tokens)
            if hits or whole:
                scored.append((-(0.1 if whole and not tokens else hits + 0.25 * (whole and level > 0)), level, key, own))
        flat = [c for *_, own in sorted(scored)[:8] for c in own][:60]
        last = {c: p for p, c in enumerate(flat)}
        want += [(q, c, 1 / (1 + p), n + 1) for n, (c, p) in enumerate(sorted(last.items(), key=lambda x: (x[1], x[0]))[:8])]
    communities = spark.createDataFrame(rows, "level int, community_key string, text string, source_locators array<string>")
    queries = spark.createDataFrame([(q, *x) for q, x in asked.items()], "query_id long, community_tokens array<string>, is_global boolean")
    out = graph.community_recall(queries, communities, 8)
    assert sorted(tuple(r) for r in out.select("query_id", "locator", "score", "rank").collect()) == sorted(want) and len(want) > 400


def test_source_lists_do_not_travel_with_the_questions(spark, monkeypatch):
    written, save = {}, graph.saved
    monkeypatch.setattr(graph, "saved", lambda df, name: written.setdefault(name, df) is not None and save(df, name))
    communities = spark.createDataFrame([(0, f"k{i:03}", "the same text", [f"c{n:03}" for n in range(80)]) for i in range(100)],
                                        "level int, community_key string, text string, source_locators array<string>")
    queries = spark.range(50).select(F.col("id").alias("query_id"), F.array(F.lit("the"), F.lit("text")).alias("community_tokens"), F.lit(False).alias("is_global"))
    out = graph.community_recall(queries, communities, 8)
    assert out.count() == 400
    joins = [x for x in written["lists"]._jdf.queryExecution().optimizedPlan().toString().splitlines() if "locator" in x.lower() and ("Join" in x or "Window" in x)]
    assert not joins  # only how long they are
