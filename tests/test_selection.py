"""Ranking, selection and governance against literal cases and sequential versions."""

import random

import pytest
from pyspark.sql import functions as F

from tidepool.operators import governance, recall, selection
from tidepool.operators.ranking import coverage_first, reciprocal_rank_fusion, round_robin
from tidepool.settings import Settings


def ranked_list(spark, names):
    return spark.createDataFrame([(1, n, i) for i, n in enumerate(names, 1)], "query_id long, locator string, rank int")


def test_fusion_prefers_what_both_lists_have(spark):
    out = reciprocal_rank_fusion([(ranked_list(spark, "ab"), 1.0), (ranked_list(spark, "bc"), 1.0)])
    assert [r["locator"] for r in out.orderBy("rank").collect()] == ["b", "a", "c"]
    assert out.agg(F.max("score")).first()[0] == 1.0


def hits(spark, rows):
    data = [(1, i, float(s), d, t, f"l{i}") for i, (s, d, t) in enumerate(rows, 1)]
    return spark.createDataFrame(data, "query_id long, rank int, score double, document_id string, tokens long, locator string")


@pytest.mark.parametrize("rows, args, kept, reason", [
    ([(0.98, "a", 9), (0.95, "a", 9), (0.93, "a", 9), (0.62, "a", 9)], {"gap": 0.2}, 3, "score_gap_reached"),
    ([(0.98, "a", 9), (0.95, "a", 9), (0.93, "a", 9), (0.45, "b", 9)], {}, 4, "candidates_exhausted"),
    ([(0.9, "a", 30), (0.9, "a", 30), (0.9, "a", 30), (0.9, "a", 600)], {"budget": 128}, 3, "context_budget_reached"),
    ([(0.9, "a", 1)] * 5, {"enabled": False}, 4, "fixed_limit_fallback"),
    ([(0.9, "a", 1)] * 6, {}, 4, "maximum_candidates_reached"),
])
def test_dynamic_top_k(spark, rows, args, kept, reason):
    out = selection.dynamic_top_k(hits(spark, rows), 4, **args).collect()
    assert len(out) == kept and {r["stop_reason"] for r in out} == {reason}


def sequential_top_k(rows, k, gap, budget, cover=2):
    kept, used, seen = [], 0, set()
    allowed = max(1, min(k, 12))
    least = min(allowed, 3)
    for i, (score, doc, tokens) in enumerate(rows[:allowed], 1):
        if i > least:
            if used + tokens > budget:
                return len(kept), "context_budget_reached"
            if rows[i - 2][0] - score >= gap and not (len(seen) < cover and doc not in seen):
                return len(kept), "score_gap_reached"
        kept.append(i)
        used += tokens
        seen.add(doc)
    return len(kept), "maximum_candidates_reached" if len(rows) > allowed else "candidates_exhausted"


def test_dynamic_top_k_equals_a_sequential_walk(spark):
    rng, lists = random.Random(3), {}
    for q in range(150):
        n = rng.randint(1, 16)
        scores = sorted((rng.randint(0, 100) / 100 for _ in range(n)), reverse=True)
        lists[q] = [(s, rng.choice("abc"), rng.randint(1, 120)) for s in scores]
    data = [(q, i, *r) for q, rows in lists.items() for i, r in enumerate(rows, 1)]
    df = spark.createDataFrame(data, "query_id long, rank int, score double, document_id string, tokens long")
    out = selection.dynamic_top_k(df, 8, gap=0.125, budget=400).groupBy("query_id").agg(F.count("*").alias("n"), F.first("stop_reason").alias("why"))
    got = {r["query_id"]: (r["n"], r["why"]) for r in out.collect()}
    assert got == {q: sequential_top_k(rows, 8, 0.125, 400) for q, rows in lists.items()}


@pytest.mark.parametrize("row, score, boosted", [
    ((0.70, "rag 检", "RAG 检索策略", "检索策略", "markdown"), 0.86, True),
    ((0.42, "other", "RAG", "", "markdown"), 0.42, False),
])
def test_metadata_boost(spark, row, score, boosted):
    df = spark.createDataFrame([row], "score double, query string, title string, section string, source_type string")
    r = recall.metadata_boost(df).first()
    assert r["boosted"] == boosted and r["score"] == pytest.approx(score)


def test_rule_rerank_prefers_titles(spark):
    df = spark.createDataFrame([(1, "a", "redis", "none", "about redis", 0.5), (1, "b", "redis", "redis", "none", 0.5)],
                               "query_id long, locator string, query string, title string, content string, score double")
    assert [r["locator"] for r in selection.rule_rerank(df, 2).orderBy("rank").collect()] == ["b", "a"]


def test_low_information_rows_go_unless_all_would(spark):
    df = spark.createDataFrame([(1, "t", "摘要"), (1, "t", "a long enough content"), (2, "t", "x")], "query_id long, title string, content string")
    assert sorted(r["content"] for r in selection.drop_low_information(df).collect()) == ["a long enough content", "x"]


@pytest.mark.parametrize("query, profile, content, reason", [
    ("缓存 Redis", "local", "nothing here", "no_lexical_support"), ("缓存 Redis", "local", "uses redis", "lexical_support"),
    ("缓存", "multi_hop", "nothing", "graph_profile_exempt"), ("什么", "local", "nothing", "insufficient_query_signals"),
    ("redis", "local", None, "empty_candidates"),
])
def test_answerability(spark, query, profile, content, reason):
    q = spark.createDataFrame([(1, query, profile)], "query_id long, query string, p string")
    h = spark.createDataFrame([(1, "t", content)] if content else [], "query_id long, title string, content string")
    assert selection.answerability(q, h, F.col("p")).first()["reason"] == reason


def test_parents_equal_a_sequential_fold(spark):
    rng = random.Random(5)
    chunks = [(d, i, rng.choice(["s", "t", None]), "c" * rng.randint(1, 400) + str(rng.randint(0, 3))) for d in range(20) for i in range(9)]
    df = spark.createDataFrame(chunks, "document_id long, ordinal int, section string, content string")
    at = [(d * 10 + i, d, i, s, t, f"document:{d}:chunk:{i}") for d, i, s, t in chunks if i in (2, 6)]
    h = spark.createDataFrame(at, "query_id long, document_id long, ordinal int, section string, content string, locator string")
    got = {(r["query_id"], r["locator"]): r["content"] for r in selection.expand_parents(h, df, Settings(parent_chars=700)).collect()}
    by = {(d, i): (s, t) for d, i, s, t in chunks}
    for q, d, i, s, t, loc in at:
        kept, used = {i: t}, len(t)
        for far in (1, 2, 3):
            for j in (i - far, i + far):
                if (d, j) in by and (by[d, j][0] or "") == (s or "") and used + len(by[d, j][1]) + 2 <= 700:
                    kept[j] = by[d, j][1]
                    used += len(by[d, j][1]) + 2
        texts = list(dict.fromkeys(kept[j] for j in sorted(kept)))
        assert got[q, loc] == "\n\n".join(texts)[:700]


def test_context_budget_shortens_the_last_evidence(spark):
    rows = [(1, 1, "a", "t", "short text"), (1, 2, "b", "t", "```\n" + "y" * 3000 + " END"), (1, 3, "c", "t", "never")]
    df = spark.createDataFrame(rows, "query_id long, rank int, locator string, title string, content string")
    out = selection.context_budget(df, 400).orderBy("rank").collect()
    assert [r["locator"] for r in out][:2] == ["a", "b"] and sum(r["tokens"] for r in out) <= 400
    assert out[1]["truncated"] and "END" in out[1]["content"] and out[1]["content"].count("```") % 2 == 0


def test_governance(spark):
    docs = spark.createDataFrame([
        ("old", "standard", "none", None, None, "indexed", None), ("current", "standard", "none", None, None, "indexed", "old"),
        ("future", "standard", "none", "2030-01-01", None, "indexed", None), ("expired", "standard", "none", None, "2020-01-01", "indexed", None),
        ("conflicted", "standard", "conflicted", None, None, "indexed", None),
    ], "document_id string, trust_level string, conflict_state string, e string, x string, status string, supersedes_document_id string")
    docs = docs.withColumn("effective_at", F.col("e").cast("timestamp")).withColumn("expires_at", F.col("x").cast("timestamp"))
    h = spark.createDataFrame([(1, d, d, 0.8) for d in ("old", "current", "future", "expired", "conflicted", "unknown")],
                              "query_id long, locator string, document_id string, score double")
    out = governance.govern(h, docs, F.lit("2026-01-01").cast("timestamp")).orderBy("rank").collect()
    assert [r["locator"] for r in out] == ["current", "unknown", "conflicted", "expired"]


def test_round_robin_and_coverage(spark):
    df = spark.createDataFrame([(1, a, i) for a in "ba" for i in range(3)], "query_id long, asset string, n int")
    out = round_robin(df, "asset", [F.col("n")], 5).orderBy("position").collect()
    assert [(r["asset"], r["n"]) for r in out] == [("a", 0), ("b", 0), ("a", 1), ("b", 1), ("a", 2)]
    df = spark.createDataFrame([(1, d, i) for i, d in enumerate("aabac", 1)], "query_id long, document_id string, rank int")
    assert [r["rank"] for r in coverage_first(df).orderBy("position").collect()] == [1, 3, 5, 2, 4]


def test_vector_recall_gates_dimensions(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.6, 0.8]), ("c", [-1.0, 0.0]), ("d", [1.0])], "locator string, vector array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>")
    assert [(r["locator"], r["score"]) for r in recall.vector_recall(q, v, 5).orderBy("rank").collect()] == [("a", 1.0), ("b", 0.6)]
    assert recall.vector_recall(q.limit(0), v, 5).count() == 0
