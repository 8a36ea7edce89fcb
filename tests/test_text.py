"""Text functions and chunkers against literal cases."""

import pytest
from pyspark.sql import functions as F

from tidepool.functions import chunking, text


def one(spark, expr, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names))
    return df.select(expr.alias("x")).first()["x"]


def test_tokens_mix_cjk_and_latin(spark):
    assert one(spark, text.tokens(F.col("t")), t="RAG 检索 a rag_2") == ["rag", "检", "索", "rag_2"]


@pytest.mark.parametrize("value, expected", [("", 1), ("abcd", 1), ("abcde", 2), ("检索", 3), ("ab检", 2)])
def test_token_estimate(spark, value, expected):
    assert one(spark, text.token_estimate(F.col("t")), t=value) == expected


def test_redaction_takes_long_keys_only(spark):
    t = "key sk-" + "a" * 24 + " and sk-short"
    assert one(spark, text.redacted(F.col("t")), t=t) == "key [REDACTED_SECRET] and sk-short"
    assert one(spark, text.secret_count(F.col("t")), t=t) == 1


def test_signals_leave_generic_words_out(spark):
    assert set(one(spark, text.signals(F.col("t")), t="Redis 什么缓存")) == {"redis", "么缓", "缓存"}


def test_signals_of_one_character(spark):
    assert one(spark, text.signals(F.col("t")), t="缓") == []


def test_community_tokens(spark):
    assert set(one(spark, text.community_tokens(F.col("t")), t="缓存层 api")) == {"api", "缓存层", "缓存", "存层"}


def test_head_tail_keeps_both_ends_and_closes_fences(spark):
    t = "```\n" + "x" * 500 + "TAIL"
    out = one(spark, text.head_tail(F.col("t"), 200, " ... "), t=t)
    assert out.endswith("TAIL\n```") and " ... " in out and len(out) <= 204


def test_normalization():
    assert text.normalized_text("Ａ\r\nb \x07c​  \n\n\n\nd ") == "A\nb  c\n\nd"
    assert text.normalized_text(None) == ""


def test_entity_names_fold_width_case_and_punctuation():
    assert text.entity_name("  （ＲＥＤＩＳ  Cache）。") == "redis cache"
    assert text.entity_name("Straße") == "strasse"


def test_embedding_counts_and_normalizes():
    v = text.embedding("redis Redis cache", 64)
    assert abs((v * v).sum() - 1) < 1e-12 and sorted(v)[-1] == pytest.approx(2 * sorted(v)[-2])
    assert not text.embedding("", 8).any()


def test_paragraphs_lose_nothing():
    long = "x" * 1900
    out = chunking.paragraph_chunks(f"a\n\nb\n\n{long}\n\nc", 800)
    assert out[0] == "a\n\nb" and [len(c) for c in out[1:]] == [800, 800, 303] and out[-1].endswith("\n\nc")


def test_sections_do_not_mix():
    out = chunking.structured_chunks("# A\n\none\n\n# B\n\ntwo")
    assert out == [("A\none", "A"), ("B\ntwo", "B")]


def test_chunks_overlap_within_a_section():
    out = chunking.structured_chunks("# A\n\n" + "\n\n".join(f"p{i} " + "w" * 60 for i in range(6)), size=150, overlap=16)
    assert len(out) > 2 and out[1][0].startswith(out[0][0][-16:].lstrip())


def test_fences_stay_balanced_and_whole():
    code = "\n".join(f"line {i}" for i in range(40))
    out = chunking.structured_chunks(f"# T\n\n```py\n{code}\n```", size=100)
    assert all(c.count("```") % 2 == 0 for c, _ in out)
    assert all(any(f"line {i}\n" in c for c, _ in out) for i in range(40))


def test_chunk_metadata(spark):
    df = spark.createDataFrame([(1, "# S\n\n```\nx\n```")], "document_id long, text string")
    r = chunking.exploded(df, "document_id", chunking.chunk_structured).first()
    assert r["metadata"] == {"section": "S", "containsCode": "true"} and r["ordinal"] == 0
