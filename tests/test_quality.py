"""Routing, evaluation, workflow and source tests."""

import json

import pytest
from pyspark.sql import functions as F

from tidepool.operators import evaluation, routing, workflow
from tidepool.sources import catalog, files, web


@pytest.mark.parametrize("query, mode, reason", [
    ("  ", "clarify", "empty_query"), ("你好！", "direct", "social_or_acknowledgement"), ("今天天气怎么样", "direct", "unsupported_realtime_request"),
    ("文档中天气模块怎么用", "rag", "knowledge_request"), ("你是谁？", "direct", "system_capability_or_help"), ("你累吗", "direct", "assistant_emotion"),
    ("怎么上传文档", "direct", "workspace_operation_instruction"), ("我刚才说了什么", "memory", "conversation_or_user_memory"),
    ("我是谁", "clarify", "identity_ambiguous"), ("这个是什么", "clarify", "ambiguous_reference"), ("Redis 缓存多久过期", "rag", "knowledge_request"),
])
def test_routes(spark, query, mode, reason):
    r = spark.createDataFrame([(query,)], "q string").select(routing.route(F.col("q")).alias("r")).first()["r"]
    assert (r["mode"], r["reason"]) == (mode, reason)


def test_routing_summary_is_zero_filled(spark):
    df = spark.createDataFrame([("rag", "rag"), ("rag", "direct"), ("memory", "memory")], "expected string, mode string")
    out = {r["mode"]: (r["cases"], r["correct"], r["recall"]) for r in routing.routing_summary(df).collect()}
    assert out == {"rag": (2, 1, 0.5), "memory": (1, 1, 1.0), "clarify": (0, 0, 0.0), "direct": (0, 0, 0.0), "all": (3, 2, 2 / 3)}


def test_rewrite_plan(spark):
    df = spark.range(1).select(routing.rewrite_plan(F.lit("a  b"), F.lit("a b"), F.array(F.lit(""), F.lit("c")), F.array(*[F.lit(x) for x in "cdefg"])).alias("p"))
    assert df.first()["p"] == ["a b", "c", "d", "e", "f"]


@pytest.mark.parametrize("args, reason", [
    ((3, 2, 1, 0, 0, 1), "sufficient"), ((3, 1, 3, 0, 0, 1), "max_steps"), ((0, 0, 1, 20000, 0, 1), "latency_budget"),
    ((0, 0, 1, 0, 9999, 1), "token_budget"), ((0, 0, 1, 0, 0, 0), "no_new_evidence"), ((0, 0, 1, 0, 0, 1), "continue"),
])
def test_next_step(spark, args, reason):
    assert spark.range(1).select(routing.next_step(*map(F.lit, args))).first()[0] == reason


def test_canonical_digest_ignores_key_order(spark):
    df = spark.createDataFrame([('{"b": [2, 1], "a": 1}',), ('{"a":1,"b":[2,1]}',), ('{"a":1,"b":[1,2]}',)], "j string")
    d = [r[0] for r in df.select(routing.canonical_digest(F.col("j"))).collect()]
    assert d[0] == d[1] != d[2]


def test_case_metrics(spark):
    cases = spark.createDataFrame([("c1", ["A", "B"], ["Redis", "TTL"]), ("c2", [], []), ("c3", ["Z"], ["none"])], "case_id string, titles array<string>, keywords array<string>")
    hits = spark.createDataFrame([("c1", 1, "A", "redis is quick and small"), ("c1", 2, "B", "the ttl of entries"), ("c3", 1, "X", "short")],
                                 "case_id string, rank int, title string, content string")
    m = {r["case_id"]: r for r in evaluation.case_metrics(cases, hits).collect()}
    assert (m["c1"]["top1"], m["c1"]["recall"], m["c1"]["reciprocal_rank"], m["c1"]["keyword_coverage"]) == (True, 1.0, 1.0, 1.0)
    assert m["c2"]["empty"] and not m["c2"]["grounded"] and m["c2"]["keyword_coverage"] == 1.0
    assert m["c3"]["noise"] == 1 and m["c3"]["recall"] == 0.0
    s = evaluation.summary(evaluation.case_metrics(cases, hits)).first()
    assert s["grounded"] == 2 and s["recall"] == 0.5 and s["no_answer_rate"] == 1.0 and s["noise_ratio"] == pytest.approx(1 / 3)


def test_quality_gate(spark):
    cols = "top1 double, recall double, mrr double, keyword_coverage double, noise_ratio double, latency_ms double"
    base, worse = spark.createDataFrame([(0.5, 0.5, 0.5, 0.5, 0.0, 10.0)], cols), spark.createDataFrame([(0.6, 0.5, 0.5, 0.5, 0.1, 22.0)], cols)
    r = evaluation.compare(base, worse).first()
    assert r["reasons"] == "noise_increased,latency_over_cap" and not r["passed"]


def test_percentiles(spark):
    df = spark.createDataFrame([("x", float(v)) for v in range(1, 6)] + [("y", 10.0), ("y", 20.0)], "k string, v double")
    out = {r["k"]: r for r in evaluation.percentiles(df, "v", ["k"]).collect()}
    assert (out["x"]["p50"], out["x"]["p95"], out["y"]["p95"]) == (3.0, 4.8, 19.5)


def test_manifest_and_drift(spark):
    a, b = spark.createDataFrame([("d1", 1)], "digest string, k int"), spark.createDataFrame([("d2", 1)], "digest string, k int")
    assert evaluation.incompatibilities(a, b, ("digest", "k")).first()["reasons"] == ["digest_differs"]
    cases, docs = spark.createDataFrame([("c", ["A", "B"])], "case_id string, titles array<string>"), spark.createDataFrame([("A",)], "title string")
    assert [tuple(r) for r in evaluation.drifted_titles(cases, docs).collect()] == [("c", "B")]


def test_triage_follows_the_last_feedback(spark):
    df = spark.createDataFrame([(1, False, "incorrect_answer", 1, 1), (1, True, None, 2, 2), (2, True, None, 1, 3), (3, True, None, 1, 4), (3, False, "outdated_information", 2, 5), (3, False, "unheard", 3, 6), (2, True, "other", 4, 7)],
                               "answer_id long, helpful boolean, reason string, ts long, event_id long")
    out = {r["answer_id"]: (r["state"], r["category"]) for r in workflow.triage(workflow.accepted(df)).collect()}
    assert out == {1: ("dismissed", "generation_grounding"), 3: ("open", "knowledge_stale_or_conflict")}


def test_reviews(spark):
    df = spark.createDataFrame([("open", "resolved", None), ("resolved", "open", "x"), ("open", "resolved", "draft")], "state string, to string, target string")
    assert [(r["state"], r["error"]) for r in workflow.review(df).collect()] == [("open", "TARGET_REQUIRED"), ("resolved", "TERMINAL_STATE"), ("resolved", None)]


def test_html(spark):
    html = "<html><head><title>A &amp; B</title></head><body><nav>menu</nav><main><p>one</p><p>two</p></main><script>x()</script></body></html>"
    assert web.read_html(html) == {"title": "A & B", "text": "one\n\n two"}
    df = spark.createDataFrame([(html,), (None,)], "h string").select(web.html_content("h").alias("x"))
    assert [r["x"]["title"] for r in df.collect()] == ["A & B", ""]


@pytest.mark.parametrize("url, out, error", [
    ("https://Example.ORG.", "https://example.org/", None), ("HTTPS://a.org/x?q=1#f", "https://a.org/x?q=1", None), ("http://a.org", None, "scheme"),
    ("https://127.0.0.1/x", None, "private_host"), ("https://localhost/", None, "private_host"), ("https://u:p@a.org/", None, "userinfo"),
    ("https://10.1.2.3", None, "private_host"), ("https://8.8.8.8/a", "https://8.8.8.8/a", None), ("https://a.org:8443/p", "https://a.org:8443/p", None),
    ("https:///x", None, "host"), ("https://a.org:99999/", None, "port"), ("https://a.org:x1/", None, "port"),
    ("https://[::1]/x", None, "private_host"), ("https://[fd00::1]:8080/", None, "private_host"), ("https://[::ffff:10.0.0.1]/", None, "private_host"),
    ("https://[2606:4700::1111]:8443/a?b", "https://[2606:4700::1111]:8443/a?b", None), ("https://[2001:db8::1]/", None, "private_host"), ("https://[::1/x", None, "host"),
    ("https://2130706433/", None, "private_host"), ("https://0x7f.1/", None, "private_host"), ("https://127.1", None, "private_host"), ("https://010.8.8.8/", None, "private_host"),
])
def test_urls(spark, url, out, error):
    r = spark.createDataFrame([(url,)], "u string").select(web.checked_url(F.col("u")).alias("r")).first()["r"]
    assert (r["url"], r["error"]) == (out, error)


def test_titles_and_domains(spark):
    df = spark.createDataFrame([("https://a.example.org/docs/page/",), ("https://example.com",)], "u string")
    assert [r[0] for r in df.select(web.fallback_title(F.col("u"))).collect()] == ["page", "example.com"]
    assert [r[0] for r in df.select(web.approved(web.host(F.col("u")), ("example.org",))).collect()] == [True, False]


def test_text_files(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"\xef\xbb\xbf# T\n\n\n\ntext ")
    assert files.read_texts(spark, str(tmp_path), "markdown").first()["text"] == "# T\n\n\n\ntext "
    assert files.read_texts(spark, str(tmp_path)).first()["text"] == "# T\n\ntext"
    (tmp_path / "b.md").write_bytes(b"\xff\xfe")
    with pytest.raises(Exception, match="UTF"):
        files.read_texts(spark, str(tmp_path), "markdown").collect()


def test_cases_are_checked(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps([{"id": "1", "query": "q", "kind": "rag"}, {"id": "1", "query": "q", "kind": "rag"}]))
    with pytest.raises(ValueError, match="repeated"):
        files.read_cases(spark, str(path), "id string, query string, kind string")
    path.write_text(json.dumps([{"id": "1", "query": "q", "kind": "odd"}]))
    with pytest.raises(Exception, match="odd"):
        files.read_cases(spark, str(path), "id string, query string, kind string", one_of={"kind": ("rag",)}).collect()


def test_reports_are_not_overwritten(spark, tmp_path):
    df = spark.range(1)
    files.write_report(df, str(tmp_path / "r"))
    with pytest.raises(Exception, match="exists"):
        files.write_report(df, str(tmp_path / "r"))


def test_small_source_operators(spark):
    df = spark.createDataFrame([({"route": "/x", "User_Token": "t", "prompt.text": "p"},)], "a map<string,string>")
    assert df.select(files.allowed_attributes(F.col("a"))).first()[0] == {"route": "/x"}
    v = spark.createDataFrame([(None, [1.0, 2.0]), (None, [1.0]), ([9.0, 9.0], [1.0, 2.0])], "native array<double>, stored array<double>")
    assert [r["native"] for r in files.backfilled(v, 2).collect()] == [[1.0, 2.0], None, [9.0, 9.0]]
    h = spark.createDataFrame([("GET", "/b", "+Inf", 2), ("GET", "/a", "0.1", 1)], "method string, route string, le string, n long")
    assert files.metric_lines(h).first()[0] == 'http_request_duration_seconds_bucket{method="GET",route="/a",le="0.1"} 1'
    old = spark.createDataFrame([("A", "x")], "title string, c string").select("title", F.sha2("c", 256).alias("content_hash"))
    assert [r["title"] for r in files.seed(old, spark.createDataFrame([("A", "x"), ("B", "y")], "title string, content string")).collect()] == ["B"]
    with pytest.raises(Exception, match="content differs"):
        files.seed(old, spark.createDataFrame([("A", "z")], "title string, content string")).collect()


def test_tenants_roles_and_index_gate(spark):
    df = spark.createDataFrame([("w1", 1), ("w2", 2)], "workspace_id string, x int")
    assert [r["x"] for r in catalog.scoped(df, "w1").collect()] == [1] and catalog.scoped(df, None).count() == 0
    r = spark.createDataFrame([("viewer",), ("owner",)], "role string")
    assert [x[0] for x in r.select(catalog.has_role(F.col("role"), "editor")).collect()] == [False, True]
    kb = spark.createDataFrame([("kb", "ready", 1, 2)], "kb_id string, index_status string, index_revision int, embedding_revision int")
    with pytest.raises(Exception, match="index not ready"):
        catalog.require_ready(kb).collect()


def test_metrics_text(spark):
    requests = spark.createDataFrame([("GET", "/a", "2xx", 0.04), ("GET", "/a", "2xx", 0.3), ("GET", "/a", "5xx", 40.0)], "method string, route string, status_class string, seconds double")
    rejected = spark.createDataFrame([("login", "memory"), ("login", "memory")], "scope string, backend string")
    text = [r["line"] for r in files.metrics_text(requests, rejected).orderBy("part", "line").collect()]
    assert text[:2] == ['http_requests_total{method="GET",route="/a",status_class="2xx"} 2', 'http_requests_total{method="GET",route="/a",status_class="5xx"} 1']
    assert 'http_request_duration_seconds_bucket{method="GET",route="/a",le="0.5"} 2' in text and 'http_request_duration_seconds_bucket{method="GET",route="/a",le="+Inf"} 3' in text
    assert text[-3:] == ['http_request_duration_seconds_sum{method="GET",route="/a"} 40.340000', 'http_request_duration_seconds_count{method="GET",route="/a"} 3',
                         'rate_limit_rejections_total{scope="login",backend="memory"} 2']


def test_questions_about_documents_are_not_routed_elsewhere(spark):
    q = spark.createDataFrame([("文档中怎么写的", "direct", 0.99), ("hello there", "direct", 0.99), (None, "direct", 0.99), ("hello", "direct", 0.5)], "q string, label string, sure double")
    out = q.select(routing.hybrid_route(F.lit("rag"), routing.asks_for_documents(F.col("q")), F.col("label"), F.col("sure")).alias("m")).collect()
    assert [r["m"] for r in out] == ["rag", "direct", "direct", "rag"]
