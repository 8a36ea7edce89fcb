"""Queries that SQL can express, against DuckDB over odd rows and over the smallest tables."""

import duckdb
import pytest

from tests.llm.conftest import DOCS
from tidepool.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
@pytest.mark.parametrize("where", ["odd", "sf"])
def test_equals_sql(spark, table, odd_docs, name, where):
    rows = [d for d in odd_docs if d[0] is not None]  # the largest id of a group without ids is a matter of convention
    folder = FOLDER if where == "sf" else table(documents=(rows, DOCS))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet{'' if where == 'sf' else '/*.parquet'}'")
    got = queries.QUERIES[name](spark, folder)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
