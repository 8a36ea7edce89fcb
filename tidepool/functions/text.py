"""Text expressions. All but the last few are built from Spark's own functions."""

from __future__ import annotations

import hashlib
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

#: Token and signal patterns, secrets, generic words.
TOKEN = "[一-鿿]|[a-zA-Z0-9_]{2,}"
LATIN_SIGNAL = "[a-zA-Z0-9_]{2,}"
CJK_RUN = "[一-鿿]+"
COMMUNITY_TOKEN = "[a-z0-9_./:-]{2,}"
SECRETS = (r"\bsk-[A-Za-z0-9_-]{20,}\b", r"\btvly-[A-Za-z0-9_-]{20,}\b")
SECRET_MARK = "[REDACTED_SECRET]"
GENERIC_SIGNALS = (
    "什么", "怎么", "如何", "多少", "是否", "可以", "需要", "应该", "公司", "知识", "文档",
    "资料", "问题", "当前", "这个", "那个", "标准", "流程", "规定", "采购", "编号",
)
ENTITY_TRIM = ",，。.!！？?;；:：()（）[]【】{}"


def found_all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def squeeze(text: Column) -> Column:
    """White space of any kind to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def tokens(text: Column) -> Column:
    """The set of lower-cased tokens: single CJK characters and runs of two or more of [a-zA-Z0-9_]."""
    return F.array_distinct(found_all(F.lower(text), TOKEN))


def token_estimate(text: Column) -> Column:
    """At least 1; a quarter for each ASCII character, one and a half for each other."""
    ascii_only = F.regexp_replace(text, r"[^\x00-\x7F]", "")
    n, plain = F.length(text), F.length(ascii_only)
    return F.greatest(F.lit(1), F.ceil(plain / F.lit(4.0) + (n - plain) * F.lit(1.5))).cast("long")


def redacted(text: Column) -> Column:
    for pattern in SECRETS:
        text = F.regexp_replace(text, pattern, F.lit(SECRET_MARK))
    return text


def secret_count(text: Column) -> Column:
    return sum((F.regexp_count(text, F.lit(p)) for p in SECRETS), F.lit(0)).cast("long")


def has_low_information(title: Column, content: Column, least: int = 12) -> Column:
    visible = F.length(F.regexp_replace(content, r"(?U)\s+", ""))
    return (squeeze(title) == "") | (visible < least)


def head_tail(text: Column, most: int, marker: str) -> Column:
    """Keeps the start and the end of a longer text around marker; a fence that the cut leaves open is closed."""
    usable = max(32, most - len(marker))
    head = max(16, int(usable * 0.72))
    tail = max(16, usable - head)
    bare = lambda c: F.regexp_replace(c, r"(?U)\s+$", "")
    joined = F.concat(bare(F.substring(text, 1, head)), F.lit(marker), F.regexp_replace(F.right(text, F.lit(tail)), r"(?U)^\s+", ""))
    closed = F.when(F.regexp_count(joined, F.lit("```")) % 2 == 1, F.concat(bare(joined), F.lit("\n```"))).otherwise(joined)
    return F.when(F.length(text) <= most, text).when(F.length(joined) >= F.length(text), F.substring(text, 1, max(1, most))).otherwise(closed)


def _grams(run: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(run) - (n - 1)), lambda i: F.substr(run, i, F.lit(n)))


def _runs(text: Column, least: int) -> Column:
    return F.filter(found_all(text, CJK_RUN), lambda r: F.length(r) >= least)


def signals(query: Column) -> Column:
    """Latin tokens and CJK bigrams of a question, without generic words."""
    low = F.lower(query)
    bigrams = F.flatten(F.transform(_runs(low, 2), lambda r: _grams(r, 2)))
    generic = F.array(*map(F.lit, GENERIC_SIGNALS))
    return F.array_except(F.array_union(found_all(low, LATIN_SIGNAL), bigrams), generic)


def community_tokens(normalized: Column) -> Column:
    """Latin tokens, whole CJK runs, and their bi- and trigrams."""
    runs = _runs(normalized, 2)
    bi = F.flatten(F.transform(runs, lambda r: _grams(r, 2)))
    tri = F.flatten(F.transform(_runs(normalized, 3), lambda r: _grams(r, 3)))
    return F.array_distinct(F.concat(found_all(normalized, COMMUNITY_TOKEN), runs, bi, tri))


def summary(contents: Column, prefix: str = "社区摘要：", chunks: int = 4, chars: int = 240) -> Column:
    """The first chunks, each squeezed and cut, joined after a prefix."""
    parts = F.transform(F.slice(contents, 1, chunks), lambda c: F.substring(squeeze(c), 1, chars))
    return F.concat(F.lit(prefix), F.array_join(parts, "；"))


def extractive_answer(contents: Column, most: int = 4, chars: int = 220) -> Column:
    """The start of the first contents, each with its citation number."""
    cut = lambda c, i: F.concat(
        F.when(F.length(c) > chars, F.concat(F.substring(c, 1, chars), F.lit("..."))).otherwise(c),
        F.lit(" ["), (i + 1).cast("string"), F.lit("]"))
    return F.array_join(F.transform(F.slice(contents, 1, most), cut), "\n")


def occurrences(text: Column, needle: Column) -> Column:
    """How often needle stands in text without overlap; at least 1, for a text known to hold it."""
    gone = F.length(text) - F.length(F.replace(text, needle, F.lit("")))
    return F.greatest(F.lit(1), F.try_divide(gone, F.length(needle))).cast("long")


# --- Arrow functions: what Spark has no built-in for (NFKC, case folding, blake2b) --------------------------

_CONTROL = re.compile("[\x00-\x08\x0b-\x1f\x7f-\x9f]")
_INVISIBLE = re.compile("[​-‏﻿]")


def normalized_text(value: str | None) -> str:
    """NFKC, unified line ends, no control or invisible characters, at most one blank line in a row."""
    text = unicodedata.normalize("NFKC", value or "").replace("\r\n", "\n").replace("\r", "\n")
    text = _INVISIBLE.sub("", _CONTROL.sub(" ", text))
    return re.sub(r"\n{3,}", "\n\n", "\n".join(map(str.rstrip, text.split("\n")))).strip()


def entity_name(value: str | None) -> str:
    """The form in which entity names are compared."""
    folded = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", value or "").strip().casefold())
    return folded.strip(ENTITY_TRIM + " \t\r\n")


def embedding(text: str | None, dims: int) -> np.ndarray:
    """Counts of hashed tokens (the big-endian blake2b-4 of each, modulo dims), of length 1; no token: all zero."""
    out = np.zeros(dims)
    for token in re.findall(TOKEN, (text or "").lower()):
        out[int.from_bytes(hashlib.blake2b(token.encode(), digest_size=4).digest(), "big") % dims] += 1
    norm = np.sqrt((out * out).sum())
    return out / norm if norm else out


@F.pandas_udf(StringType())
def normalize(text: pd.Series) -> pd.Series:
    return text.map(normalized_text)


@F.pandas_udf(StringType())
def normalize_entity(text: pd.Series) -> pd.Series:
    return text.map(entity_name)


def hash_embedding(dims: int = 384):
    @F.pandas_udf(ArrayType(DoubleType()))
    def embed(text: pd.Series) -> pd.Series:
        return text.map(lambda t: embedding(t, dims))

    return embed


def compacted(value: str | None, most: int) -> str:
    """Normalised, without Markdown images, squeezed, cut."""
    bare = re.sub(r"!\[[^\]]*\]\([^)]*\)", "", normalized_text(value))
    return re.sub(r"\s+", " ", bare).strip()[:most]


def label(text: Column, most: int) -> Column:
    """A short label from normalised text: no images and no Markdown marks, squeezed, cut."""
    bare = F.regexp_replace(text, r"!\[[^\]]*\]\([^)]*\)", "")
    cut = F.substring(F.trim(F.regexp_replace(bare, r"(?U)\s+", " ")), 1, most)
    plain = F.regexp_replace(cut, r"[#`|*_]+", "")
    return F.substring(F.regexp_replace(plain, r"^[ \-:：。]+|[ \-:：。]+$", ""), 1, most)


def draft_themes(context: Column, most: int = 6) -> Column:
    """A draft of themes, array<struct<title, points>>, from blocks of text: the first line names one, its first
    three sentences are the points.
    """

    def theme(block: Column) -> Column:
        lines = F.filter(F.transform(F.split(block, "\n"), lambda x: F.trim(x)), lambda x: x != "")
        rest = F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines), F.lit(1))), " ")
        sentences = F.slice(F.split(rest, r"(?<=[。！？.!?])\s*", -1), 1, 3)
        points = F.filter(F.transform(sentences, lambda x: label(x, 80)), lambda x: x != "")
        head = F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit(""))
        return F.struct(label(F.regexp_replace(head, r"^[\[\]]+|[\[\]]+$", ""), 48).alias("title"), points.alias("points"))

    blocks = F.slice(F.split(normalize(F.coalesce(context, F.lit(""))), "\n\n"), 1, most)
    found = F.filter(F.transform(blocks, theme), lambda x: (x["title"] != "") & (F.size(x["points"]) > 0))
    none = F.array(F.struct(F.lit("尚待整理").alias("title"), F.array(F.lit("当前知识库中没有足够的可用资料。")).alias("points")))
    return F.when(F.size(found) > 0, found).otherwise(none)


def compact(most: int):
    @F.pandas_udf(StringType())
    def cut(value: pd.Series) -> pd.Series:
        return value.map(lambda v: compacted(v, most))

    return cut
