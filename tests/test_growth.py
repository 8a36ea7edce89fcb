"""Work that must not grow faster than the input: what a task holds, and how often an input is read or shuffled."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tidepool.functions.digests import tree_digest
from tidepool.operators import graph, louvain, recall
from tidepool.plans import graph_queries, registry


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_an_index_has_bounded_chunks_to_a_partition(spark):
    chunks = spark.range(20_000).select(F.concat(F.lit("l"), "id").alias("locator"), F.lit("one two").alias("content"))
    index = recall.token_index(chunks)
    assert index.rdd.getNumPartitions() == 5
    most = index.groupBy(F.spark_partition_id()).agg(F.count_distinct("locator").alias("n")).agg(F.max("n")).first()[0]
    assert most < 4500


def test_nation_outer_does_not_pair_customers_with_suppliers(spark, tmp_path):
    tables = {
        "nation": ([(0, "A"), (1, "B"), (2, "B"), (3, None), (3, None), (4, "E"), (None, "F")], "n_nationkey int, n_name string"),
        "customer": ([(i, i % 4) for i in range(30)] + [(7, 1), (7, 2), (None, 1), (31, None), (32, 4)], "c_custkey long, c_nationkey int"),
        "supplier": ([(i, i % 3) for i in range(20)] + [(5, 1), (None, 0), (33, 9)], "s_suppkey long, s_nationkey int")}
    con = duckdb.connect()
    for n, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{n}.parquet")
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{tmp_path}/{n}.parquet/*.parquet'")
    got = registry.QUERIES["nation_outer"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(con.execute(registry.ORACLE_SQL["nation_outer"]).fetchall(), key=repr)
    assert "Expand" not in plan(got)  # of two distinct counts over joined rows


@pytest.mark.parametrize("by", ("component", ""))
def test_digests_in_sql_are_trees_of_any_depth(spark, by):
    rows = spark.range(3000).selectExpr("concat('e', id) AS entity_id", "CASE WHEN id < 5 THEN 'a' WHEN id < 200 THEN 'b' ELSE 'c' END AS component")
    con = duckdb.connect()
    con.execute("CREATE TABLE members AS SELECT concat('e', i) AS entity_id, CASE WHEN i < 5 THEN 'a' WHEN i < 200 THEN 'b' ELSE 'c' END AS component FROM range(3000) t(i)")
    for leaf in (1, 5, 4096):
        want = {(r[by] if by else 1): r["digest"] for r in tree_digest(rows.withColumn("one", F.lit(1)), [by or "one"], "entity_id", leaf).collect()}
        got = con.execute(f"WITH {graph_queries._digest('d', by, leaf)} SELECT {by or 1}, digest FROM d").fetchall()
        assert dict(got) == want
    con.execute("INSERT INTO members SELECT concat('f', i), 'd' FROM range(70000) t(i)")
    deep = spark.range(70_000).selectExpr("concat('f', id) AS entity_id", "'d' AS component")
    want = tree_digest(deep if by else rows.unionByName(deep).withColumn("one", F.lit(1)), [by or "one"], "entity_id", 1).first()["digest"]
    assert want in {d for _, d in con.execute(f"WITH {graph_queries._digest('d', by, 1)} SELECT {by or 1}, digest FROM d").fetchall()}


def test_extraction_holds_a_slice_of_texts(spark, monkeypatch):
    chunks = spark.range(1000, numPartitions=1).selectExpr("concat('l', id) AS locator", "IF(id = 3, NULL, concat('Alpha', id, ' uses Beta. ', repeat('x ', id))) AS content")
    found = graph.extracted(chunks)
    sizes = found.select("locator").mapInArrow(lambda it: it, "locator string")
    assert sizes.count() == 1000
    got = {r["locator"]: r for r in found.collect()}
    for i in (0, 3, 999):
        want = graph.extract(None if i == 3 else f"Alpha{i} uses Beta. " + "x " * i)
        assert [e.asDict() for e in got[f"l{i}"]["entities"]] == want["entities"] and [e.asDict() for e in got[f"l{i}"]["relations"]] == want["relations"]
    entities, _, _ = graph.build_index(chunks)
    assert "ArrowEvalPython" not in plan(entities)  # takes 10,000 texts at once


def test_communities_are_built_once(spark, monkeypatch):
    made = []
    save = graph.saved
    monkeypatch.setattr(graph, "saved", lambda df, name: made.append(name) or save(df, name))
    members = spark.createDataFrame([(f"e{i}", f"e{i % 3}") for i in range(9)], "entity_id string, component string")
    entities = members.select("entity_id", F.col("entity_id").alias("name"), F.col("entity_id").alias("normalized_name"), F.lit(1).alias("mention_count"))
    mentions = spark.createDataFrame([(f"e{i % 9}", f"l{i:04}") for i in range(1800)] * 2, "entity_id string, locator string")
    edges = spark.createDataFrame([("e1", "e2", "l5000"), ("e0", "e3", None)], "source_id string, target_id string, locator string")
    built = graph.build_communities(members, entities, mentions, edges)
    low = {r["component"]: r for r in built.where("level = 0").collect()}
    want = {f"e{g}": sorted(f"l{i:04}" for i in range(1800) if i % 3 == g)[:80] for g in range(3)}
    assert low["e1"]["source_locators"] == want["e1"] and low["e2"]["source_locators"] == want["e2"]
    assert low["e0"]["source_locators"] == want["e0"][:79]  # an edge without a chunk takes a place, as it did
    q = spark.createDataFrame([(1, ["e1"], False), (2, ["x"], True)], "query_id long, community_tokens array<string>, is_global boolean")
    assert graph.community_recall(q, built.withColumn("text", F.lower("title")), 8).count() == 16
    assert graph.community_gate(built, members, entities, mentions).first()["communities"] == 4
    assert made.count("communities") == 2 and made.count("sources") == 1


def test_a_louvain_round_deals_links_once_by_vertex(spark, monkeypatch):
    states = []
    save = louvain.saved
    monkeypatch.setattr(louvain, "saved", lambda df, name: (name == "labels" and states.append(df)) or save(df, name))
    v = spark.range(40).selectExpr("1 AS kb_id", "concat('v', id) AS entity_id")
    p = spark.range(40).selectExpr("1 AS kb_id", "concat('v', id) AS a", "concat('v', (id * 7 + 1) % 40) AS b", "1.0 AS weight")
    louvain.louvain(v, p, rounds=2, levels=1)
    text = plan(states[0])
    assert not re.search(r"Join Inner, \(c#\d+L? = c#\d+L?\)[^\n]*\n[^\n]*Aggregate \[v#", text)
    assert "RepartitionByExpression [v#" in text
