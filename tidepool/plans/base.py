"""How queries are registered: a function of a Catalog, and its SQL for DuckDB where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidepool.sources.catalog import Catalog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _wide(df: DataFrame) -> DataFrame:
    """Integers as long, as DuckDB counts and ranks."""
    return df.withColumns({c: df[c].cast("long") for c, kind in df.dtypes if kind == "int"})


def query(sql: str | None = None, name: str | None = None):
    def register(f: Callable[[Catalog], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = lambda spark, folder: _wide(f(Catalog(spark, folder)))
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return register


def sql_query(name: str, spark_sql: str, tables: str, duckdb_sql: str | None = None) -> None:
    """A query that is the same SQL for both engines, or nearly so."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        c = Catalog(spark, folder)
        return _wide(spark.sql(spark_sql, **{t: c.table(t) for t in tables.split()}))

    QUERIES[name] = run
    plain = spark_sql
    for t in tables.split():
        plain = plain.replace("{" + t + "}", t)
    ORACLE_SQL[name] = duckdb_sql or plain


#: Fragments of DuckDB SQL that several queries share.
TOKENS = r"list_distinct(regexp_extract_all(lower({}), '[\x{{4e00}}-\x{{9fff}}]|[a-zA-Z0-9_]{{2,}}'))"
CHUNKS = """chunks AS (SELECT concat('document:', doc_id, ':chunk:0') AS locator, doc_id, doc_id::VARCHAR AS document_id, source, text AS content,
  left(text, 60) AS title, substr(text, 61, 60) AS section, lang AS source_type FROM documents)"""
INDEX = f"idx AS (SELECT locator, unnest({TOKENS.format('content')}) AS token FROM chunks)"


def keyword_list(name: str, limit: int, text: str = "text") -> str:
    """A common table expression with the keyword ranking of benchmark questions."""
    t = TOKENS.format(text)
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, locator) AS rank FROM (
  SELECT q.query_id, i.locator, count(*) / q.n::DOUBLE AS score FROM
  (SELECT item_id AS query_id, len({t}) AS n, unnest({t}) AS token FROM benchmark) q JOIN idx i USING (token)
  GROUP BY q.query_id, i.locator, q.n)) WHERE rank <= {limit})"""
