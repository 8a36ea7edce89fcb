"""Extension points, proposals and members, mind maps, manifests, full-text mode, event sinks, the whole search path."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidepool.functions import text
from tidepool.operators import evaluation, extensions, recall, workflow
from tidepool.plans.search import Corpus, search
from tidepool.streaming import state


def test_registry():
    r = extensions.Registry("chunker", allowed=frozenset({"a"}))
    r.add("a", len)
    r.add("b", len)
    assert r.get("a") is len and r.names() == ["a"]
    with pytest.raises(ValueError, match="already"):
        r.add("a", len)
    for name in ("b", "c"):
        with pytest.raises(KeyError):
            r.get(name)
    assert extensions.defaults()["chunker"].names() == ["paragraph", "structured"]


def test_batched_provider(spark):
    df = spark.createDataFrame([(i, "x" * i) for i in range(60)], "id long, t string").coalesce(1)
    out = extensions.embed_in_batches(df, lambda texts: [[float(len(t)), float(len(texts))] for t in texts], 2, "t")
    got = {r["id"]: r["embedding"] for r in out.collect()}
    assert got[7] == [7.0, 25.0] and got[59] == [59.0, 10.0]
    with pytest.raises(Exception, match="another length"):
        extensions.embed_in_batches(df, lambda texts: [[1.0]] * len(texts), 2, "t").collect()


def test_provider_scores_fall_back_by_query(spark):
    hits = spark.createDataFrame([(q, x, 0.5, 1, "redis", "redis" if x == "b" else "", "") for q in (1, 2) for x in "ab"],
                                 "query_id long, locator string, score double, rank int, query string, title string, content string")
    scores = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.1), (1, "zz", 5.0), (2, "a", None)], "query_id long, locator string, provided double")
    out = {(r["query_id"], r["rank"]): (r["locator"], r["fallback"]) for r in extensions.provided_scores(hits, scores, 2).collect()}
    assert out == {(1, 1): ("a", False), (1, 2): ("b", False), (2, 1): ("b", True), (2, 2): ("a", True)}
    assert (extensions.candidate_limit(8, True), extensions.candidate_limit(2, True), extensions.candidate_limit(8, False)) == (20, 8, 8)


def test_proposals(spark):
    t = dt.datetime(2026, 1, 2)
    rows = [("pending", "approved", t, "owner", "approver", 1, 1), ("approved", "rejected", t, "owner", "viewer", 1, 1), ("pending", "approved", dt.datetime(2025, 1, 1), "owner", "viewer", 1, 1),
            ("pending", "approved", t, "viewer", "approver", 1, 1), ("pending", "approved", t, "owner", "approver", 1, 2)]
    df = spark.createDataFrame(rows, "state string, decision string, expires_at timestamp, role string, required_role string, expected_version int, version int")
    out = [(r["state"], r["error"]) for r in workflow.decide_proposals(df, F.lit("2026-01-01").cast("timestamp")).collect()]
    assert out == [("approved", None), ("approved", "NOT_PENDING"), ("expired", "EXPIRED"), ("pending", "ROLE_REQUIRED"), ("pending", "VERSION_CONFLICT")]


def test_governance_edits(spark):
    docs = spark.createDataFrame([("a", "k", "indexed", 1), ("b", "k", "indexed", 1), ("c", "other", "indexed", 1), ("d", "k", "archived", 1)],
                                 "document_id string, kb_id string, status string, governance_version int")
    rows = [("a", 1, None, None, "b"), ("a", 2, None, None, None), ("d", 1, None, None, None), ("b", 1, "2026-02-01", "2026-01-01", None), ("b", 1, None, None, "b"),
            ("b", 1, None, None, "c"), ("b", 1, None, None, "d")]
    edits = spark.createDataFrame(rows, "document_id string, expected_version int, effective_at string, expires_at string, supersedes_document_id string")
    out = [(r["document_id"], r["supersedes_document_id"], r["error"], r["governance_version"]) for r in workflow.edit_governance(docs, edits).collect()]
    assert sorted(out, key=repr) == sorted([("a", "b", None, 2), ("a", None, "VERSION_CONFLICT", 1), ("d", None, "NOT_FOUND", 1), ("b", None, "DATES", 1), ("b", "b", "SUPERSEDES_ITSELF", 1),
                                            ("b", "c", "PREDECESSOR", 1), ("b", "d", "PREDECESSOR", 1)], key=repr)


def test_last_owner_stays(spark):
    members = spark.createDataFrame([("w", "u", "owner", "active"), ("w", "v", "editor", "active"), ("x", "u", "owner", "active"), ("x", "v", "owner", "active")],
                                    "workspace_id string, user_id string, role string, state string")
    changes = spark.createDataFrame([("w", "u", "viewer", None), ("x", "u", None, "disabled")], "workspace_id string, user_id string, role string, state string")
    out = {(r["workspace_id"], r["user_id"]): (r["role"], r["state"], r["error"]) for r in workflow.change_members(members, changes).collect()}
    assert out["w", "u"] == ("owner", "active", "LAST_OWNER") and out["x", "u"] == ("owner", "disabled", None) and out["w", "v"] == ("editor", "active", None)


def test_tag_decisions(spark):
    a = spark.createDataFrame([(1, "pending"), (2, "approved"), (3, "pending")], "assignment_id long, state string")
    d = spark.createDataFrame([(1, "rejected"), (2, "rejected")], "assignment_id long, decision string")
    assert {r["assignment_id"]: r["state"] for r in workflow.decide_tags(a, d).collect()} == {1: "rejected", 2: "approved", 3: "pending"}


def test_mind_map(spark):
    df = spark.createDataFrame([(1, "[Title]\nOne. Two! **Three**? Four.\n\n\n\nonly"), (2, None)], "i int, t string").select("i", text.draft_themes(F.col("t")).alias("x"))
    got = {r["i"]: [(x["title"], x["points"]) for x in r["x"]] for r in df.collect()}
    assert got[1] == [("Title", ["One.", "Two!", "Three?"])] and got[2][0][0] == "尚待整理"
    df = spark.createDataFrame([(1, 0, ["a", "b"]), (1, 1, ["c"])], "map_id long, theme int, points array<string>")
    y = {(r["theme"], r["point"]): r["y"] for r in workflow.mind_map_layout(df).collect()}
    assert y == {(0, None): -116.0, (0, 0): -151.0, (0, 1): -81.0, (1, None): 35.0, (1, 0): 35.0}


def test_manifest_depends_on_cases_only(spark):
    a = spark.createDataFrame([("1", "q"), ("2", "r")], "case_id string, query string")
    digest = lambda df: evaluation.manifest(df, {"kb_id": "k"}).first()["cases_sha256"]
    assert digest(a) == digest(a.orderBy(F.desc("case_id"))) != digest(a.where("case_id = '1'"))
    assert evaluation.with_strategies(a).where("reranker AND NOT query_rewrite").count() == 2


def test_full_text_mode(spark):
    chunks = spark.createDataFrame([("near", "fast redis cache"), ("far", "redis is one two three cache"), ("half", "redis only")], "locator string, content string")
    q = spark.createDataFrame([(1, "Redis cache"), (2, "")], "query_id long, query string")
    out = recall.full_text_recall(q, chunks, 5).orderBy("rank").collect()
    assert [r["locator"] for r in out] == ["near", "far"] and out[0]["score"] == pytest.approx(0.1 / 1.1)


def test_answer_events(spark, tmp_path):
    df = spark.createDataFrame([("r", "x" * 100, ["c1"], False), ("s", "", [], True)], "run_id string, text string, citations array<string>, failed boolean")
    out = [(r["run_id"], r["event"]) for r in state.answer_events(df).orderBy("run_id", "sequence").collect()]
    assert out == [("r", "started"), ("r", "citation"), ("r", "delta"), ("r", "delta"), ("r", "completed"), ("s", "started"), ("s", "error")]
    sink = state.append_to(str(tmp_path / "log"))
    sink(df.select("run_id"), 0)
    sink(df.select("run_id"), 0)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_resume_needs_a_valid_checksum(spark):
    df = spark.createDataFrame([("r", 1, "a", "{}"), ("r", 2, "b", "{x}")], "run_id string, sequence int, node string, state_json string")
    df = df.withColumn("checksum", F.when(F.col("sequence") == 1, F.sha2("state_json", 256)).otherwise("bad"))
    assert state.resumable(df).first()["node"] == "a"


def test_search_end_to_end(spark):
    chunks = spark.createDataFrame([
        ("document:d1:chunk:0", "d1", 0, "Redis", "缓存", "markdown", "Redis keeps entries in memory, with a TTL for each of them"),
        ("document:d1:chunk:1", "d1", 1, "Redis", "缓存", "markdown", "Entries go when their time is over, or under pressure"),
        ("document:d2:chunk:0", "d2", 0, "Billing", "", "markdown", "Invoices are sent each month to all customers"),
    ], "locator string, document_id string, ordinal int, title string, section string, source_type string, content string")
    q = spark.createDataFrame([(1, "redis ttl memory"), (2, "hello"), (3, "unknown zebra")], "query_id long, query string")
    evidence, decisions = search(q, Corpus(chunks))
    rows = evidence.orderBy("query_id", "rank").collect()
    assert rows[0]["locator"] == "document:d1:chunk:0" and "under pressure" in rows[0]["content"] and {r["query_id"] for r in rows} == {1}
    d = {r["query_id"]: (r["mode"], r["answer_reason"]) for r in decisions.collect()}
    assert d == {1: ("rag", "lexical_support"), 2: ("direct", None), 3: ("rag", "empty_candidates")}
