"""Registered queries against their SQL on the smallest tables, and the optional corpus operators' absence."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from tidepool.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return round(v, 9) + 0.0
    return tuple(map(canon, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    got = registry.QUERIES[name](spark, FOLDER)
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({registry.ORACLE_SQL[name]})").fetchall()
    rows = [tuple(map(canon, r)) for r in got.select(*cols).collect()]
    assert sorted(rows, key=repr) == sorted((tuple(map(canon, r)) for r in want), key=repr)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, FOLDER).count() > 0


def test_entry_imports_without_the_corpus_operators(tmp_path):
    root = Path(__file__).parent.parent
    (tmp_path / "tidepool").mkdir()
    for p in (root / "tidepool").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "tidepool" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").write_text((root / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; assert 'hybrid_search' in e.queries() and not any(k.startswith('op') and k[2].isdigit() for k in e.queries()); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "HOME": "/root"})
