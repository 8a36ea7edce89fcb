"""From raw documents to packed training sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir) and works on everything that the one before it kept. All but
the last return the columns of documents. No stage fails on empty tables, which stay empty, on nulls in any column
or on repeated rows:

* Language ID drops null and empty texts with all others without a letter; repeated rows stay.
* Exact dedup keeps the largest doc_id; a null one is kept only where all of a group are null, and rows repeated
  with that id are all kept.
* Near-dedup keeps the rows of the smallest doc_id; in a group without any doc_id the rows without one are kept.
* Secret scans and packing treat every row for itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm import exact_dedup, jaccard, language, packing, secrets
from tidepool.llm.shared import table, written


_OWN = ("doc_id", "text", "lang")


def _carried(docs: DataFrame) -> DataFrame:
    """The columns that stages work on; all others, whatever their names are, in one."""
    return docs.select(*_OWN, F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in _OWN), F.lit(1).alias("_")).alias("_row"))


def _rows(found: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of docs again, some of them changed."""
    return found.select(*(changed.get(c, F.col(c) if c in _OWN else F.col("_row")[c]).alias(c) for c in docs.columns))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any letter go; a missing lang is filled with the predicted one."""
    found = language.identify(_carried(docs)).where(F.col("lang_pred") != language.UNKNOWN)
    return _rows(found, docs, lang=F.coalesce("lang", "lang_pred"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays."""
    return _rows(exact_dedup.exact_dedup(_carried(docs)).where("kept"), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (0.8 of five-word shingles, transitively) the document with the smallest doc_id stays."""
    found = jaccard.near_copies(_carried(docs), words=5, similarity="0.8")
    return _rows(found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))), docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are replaced, and n_chars follows the text."""
    found = secrets.redact(secrets.scan_secrets(_carried(docs)))
    length = F.when(F.size("secrets") > 0, F.char_length("text").cast("long")).otherwise(F.col("_row")["n_chars"])
    return _rows(found, docs, n_chars=length)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of at most 4096 tokens."""
    import public_tokenizers

    return packing.pack_documents(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"])


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("secret scans", redact_secrets),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage-{i}")
    return docs


QUERIES = {"pipeline": run}
#: The stages learn, hash and tokenize: SQL can't express them, tests hold them against brute force instead.
ORACLE_SQL = None
