"""Routing, evaluation and workflow queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepool.operators import evaluation, graph, routing, workflow
from tidepool.plans.base import CHUNKS, INDEX, keyword_list, query
from tidepool.plans.retrieval_queries import keyword

_NORMAL = r"regexp_replace(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), '[。！!？?]+$', '')"


def _matches(patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches(q, '{p}')" for p in patterns) + ")"


_SOURCED = "(" + " OR ".join(f"contains(q, '{m}')" for m in routing.SOURCE_MARKERS) + ")"
_SOCIAL = "q IN (" + ", ".join(f"'{p}'" for p in routing.SOCIAL) + ")"
_ROUTE = f"""CASE WHEN q = '' THEN 'clarify' WHEN {_SOCIAL} THEN 'direct' WHEN NOT {_SOURCED} AND {_matches(routing.REALTIME)} THEN 'direct'
  WHEN {_matches(routing.CAPABILITY + routing.EMOTION)} THEN 'direct' WHEN NOT {_SOURCED} AND {_matches(routing.OPERATION)} THEN 'direct'
  WHEN {_matches(routing.MEMORY)} THEN 'memory' WHEN q = '{routing.IDENTITY}' OR {_matches(routing.AMBIGUOUS)} THEN 'clarify' ELSE 'rag' END"""
#: Questions for the router: what users said, and for every third turn a known phrase in its place.
_SAID = f"""said AS (SELECT conv_id, turn, role, CASE turn % 6 WHEN 1 THEN 'Hello!' WHEN 3 THEN '我刚才说' || left(text, 10) WHEN 5 THEN '这个是什么？' ELSE text END AS text FROM conversations),
  routed AS (SELECT conv_id, turn, role, {_ROUTE} AS mode FROM (SELECT *, {_NORMAL} AS q FROM said))"""


def said(c):
    t = F.col("turn") % 6
    text = (F.when(t == 1, "Hello!").when(t == 3, F.concat(F.lit("我刚才说"), F.substring("text", 1, 10))).when(t == 5, "这个是什么？").otherwise(F.col("text")))
    return c.table("conversations").withColumn("text", text)


@query(f"WITH {_SAID} SELECT conv_id, turn, mode FROM routed")
def route_rules(c):
    return said(c).select("conv_id", "turn", routing.route(F.col("text"))["mode"].alias("mode"))


@query("""SELECT conv_id, turn, CASE WHEN regexp_matches(t, '全局|整体|总体|概览|归纳|总结|趋势|主题|有哪些类别|全库|所有文档') THEN 'global'
  WHEN regexp_matches(t, '关系|关联|如何影响|为什么导致|因果|依赖|之间|链路|共同原因|上下游|影响了|如何连接') THEN 'multi_hop' ELSE 'local' END AS mode
  FROM (SELECT *, CASE turn % 5 WHEN 1 THEN text || ' 之间的关系' WHEN 2 THEN '总结 ' || text ELSE text END AS t FROM conversations)""")
def graph_mode(c):
    t = F.col("turn") % 5
    text = F.when(t == 1, F.concat("text", F.lit(" 之间的关系"))).when(t == 2, F.concat(F.lit("总结 "), "text")).otherwise(F.col("text"))
    return c.table("conversations").select("conv_id", "turn", graph.relation_mode(text).alias("mode"))


@query(r"""SELECT conv_id, turn, array_to_string(list(v ORDER BY n), '|') AS plan FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY n) AS k FROM (
  SELECT conv_id, turn, v, min(n) AS n FROM (SELECT conv_id, turn, trim(regexp_replace(x[i], '\s+', ' ', 'g')) AS v, i AS n FROM
    (SELECT conv_id, turn, [lower(text), text, left(text, 20), '', right(text, 20), left(text, 10), left(text, 5)] AS x FROM conversations), range(1, 8) r(i)) WHERE v <> '' GROUP BY conv_id, turn, v)) WHERE k <= 5 GROUP BY conv_id, turn""")
def rewrite_plan(c):
    t = F.col("text")
    sub = F.array(F.substring(t, 1, 20), F.lit(""), F.right(t, F.lit(20)))
    syn = F.array(F.substring(t, 1, 10), F.substring(t, 1, 5))
    plan = routing.rewrite_plan(F.lower(t), t, sub, syn)
    return c.table("conversations").select("conv_id", "turn", F.array_join(plan, "|").alias("plan")).where("plan <> ''")


@query(f"""WITH {_SAID}, e AS (SELECT mode, CASE role WHEN 'user' THEN 'rag' WHEN 'assistant' THEN 'direct' ELSE 'memory' END AS expected FROM routed)
  SELECT c.mode, count(e.expected) AS cases, count(*) FILTER (e.expected = e.mode) AS correct, coalesce(count(*) FILTER (e.expected = e.mode) / nullif(count(e.expected), 0)::DOUBLE, 0.0) AS recall
  FROM (SELECT unnest(['clarify', 'direct', 'memory', 'rag']) AS mode) c LEFT JOIN e ON e.expected = c.mode GROUP BY c.mode
  UNION ALL SELECT 'all', count(*), count(*) FILTER (expected = mode), count(*) FILTER (expected = mode) / count(*)::DOUBLE FROM e""")
def routing_summary(c):
    expected = F.when(F.col("role") == "user", "rag").when(F.col("role") == "assistant", "direct").otherwise("memory")
    return routing.routing_summary(said(c).select(expected.alias("expected"), routing.route(F.col("text"))["mode"].alias("mode")))


_TITLE = "left(text, 60)"
_CASES = r"cases AS (SELECT item_id AS case_id, CASE WHEN item_id % 8 = 7 THEN [] ELSE ['src' || item_id % 20, 'src' || (item_id + 1) % 20] END AS titles, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z]{7,}')))[:3] AS keywords FROM benchmark)"


def _metrics(part: str, name: str) -> str:
    return f"""{keyword_list('k_' + name, 5, part)}, h_{name} AS (SELECT query_id AS case_id, rank, source AS title, lower(content) AS content FROM k_{name} JOIN chunks USING (locator)),
  {name} AS (SELECT case_id, coalesce(first, 0) = 1 AS top1, coalesce(found / nullif(len(titles), 0)::DOUBLE, 0.0) AS recall, coalesce(1.0::DOUBLE / first, 0.0) AS reciprocal_rank,
    CASE WHEN len(keywords) = 0 THEN 1.0 ELSE coalesce(covered / len(keywords)::DOUBLE, 0.0) END AS keyword_coverage, coalesce(noise, 0)::BIGINT AS noise, coalesce(retrieved, 0) AS retrieved, retrieved IS NULL AS empty, len(titles) > 0 AS grounded
    FROM cases LEFT JOIN (SELECT c.case_id, count(*) AS retrieved, min(CASE WHEN list_contains(titles, title) THEN rank END) AS first, count(DISTINCT CASE WHEN list_contains(titles, title) THEN title END) AS found,
      count(*) FILTER (length(regexp_replace(content, '\\s+', '', 'g')) < 12) AS noise FROM h_{name} h JOIN cases c USING (case_id) GROUP BY c.case_id) USING (case_id)
    LEFT JOIN (SELECT case_id, count(DISTINCT w) AS covered FROM (SELECT case_id, unnest(keywords) AS w FROM cases) JOIN h_{name} USING (case_id) WHERE contains(content, w) GROUP BY case_id) USING (case_id))"""


_SUMMARY = """SELECT count(*) FILTER (grounded) AS grounded, avg(top1::INT) FILTER (grounded) AS top1, avg(recall) FILTER (grounded) AS recall, avg(reciprocal_rank) FILTER (grounded) AS mrr,
  avg(keyword_coverage) FILTER (grounded) AS keyword_coverage, avg(empty::INT) FILTER (NOT grounded) AS no_answer_rate, sum(noise) / greatest(sum(retrieved), 1)::DOUBLE AS noise_ratio FROM """
_ROUNDED = "grounded, round(top1, 6) AS top1, round(recall, 6) AS recall, round(mrr, 6) AS mrr, round(keyword_coverage, 6) AS keyword_coverage, round(no_answer_rate, 6) AS no_answer_rate, round(noise_ratio, 6) AS noise_ratio"


def metrics(c, part: str = "all"):
    b = c.table("benchmark")
    i = F.col("item_id")
    source = lambda n: F.concat(F.lit("src"), (n % 20).cast("string"))
    words = F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{7,}"), F.lit(0)))), 1, 3)
    titles = F.when(i % 8 == 7, F.array().cast("array<string>")).otherwise(F.array(source(i), source(i + 1)))
    cases = b.select(i.alias("case_id"), titles.alias("titles"), words.alias("keywords"))
    hits = keyword(c, 5, part).join(c.chunks(), "locator").select(F.col("query_id").alias("case_id"), "rank", F.col("source").alias("title"), "content")
    return evaluation.case_metrics(cases, hits)


@query(f"WITH {CHUNKS}, {INDEX}, {_CASES}, {_metrics('text', 'm')} SELECT * FROM m")
def case_metrics(c):
    return metrics(c)


@query(f"WITH {CHUNKS}, {INDEX}, {_CASES}, {_metrics('text', 'm')} SELECT {_ROUNDED} FROM ({_SUMMARY} m)")
def eval_summary(c):
    out = evaluation.summary(metrics(c))
    return out.select("grounded", *[F.round(x, 6).alias(x) for x in out.columns if x != "grounded"])


@query(f"""WITH {CHUNKS}, {INDEX}, {_CASES}, {_metrics('text', 'm1')}, {_metrics('left(text, 200)', 'm2')}, a AS ({_SUMMARY} m1), b AS ({_SUMMARY} m2),
  d AS (SELECT round(b.top1 - a.top1, 4) AS delta_top1, round(b.recall - a.recall, 4) AS delta_recall, round(b.mrr - a.mrr, 4) AS delta_mrr, round(b.keyword_coverage - a.keyword_coverage, 4) AS delta_keyword_coverage,
    round(b.noise_ratio - a.noise_ratio, 4) AS delta_noise_ratio, 12.0::DOUBLE AS delta_latency_ms FROM a, b),
  r AS (SELECT *, array_to_string(list_filter([CASE WHEN NOT greatest(delta_top1, delta_recall, delta_mrr, delta_keyword_coverage) > 0 THEN 'no_positive_delta' END,
    CASE WHEN delta_noise_ratio > 0 THEN 'noise_increased' END, 'latency_over_cap'], lambda x: x IS NOT NULL), ',') AS reasons FROM d) SELECT *, reasons = '' AS passed FROM r""")
def compare_gate(c):
    side = lambda part, ms: evaluation.summary(metrics(c, part)).withColumn("latency_ms", F.lit(ms))
    return evaluation.compare(side("all", 100.0), side("first", 112.0))


@query("""SELECT event_type, count(*) AS samples, round(min(value), 3) AS min, round(avg(value), 3) AS mean, round(quantile_cont(value, 0.5), 3) AS p50,
  round(quantile_cont(value, 0.95), 3) AS p95, round(max(value), 3) AS max FROM events GROUP BY event_type""")
def latency_percentiles(c):
    return evaluation.percentiles(c.table("events"), "value", ["event_type"])


@query(f"""WITH {CHUNKS}, {INDEX}, {keyword_list('k1', 24)}, {keyword_list('k2', 24, 'left(text, 200)')}
  SELECT item_id AS query_id, coalesce((SELECT string_agg(locator, ',' ORDER BY rank) FROM k2 WHERE query_id = item_id AND locator NOT IN (SELECT locator FROM k1 WHERE query_id = item_id)), '') AS added,
  coalesce((SELECT string_agg(locator, ',' ORDER BY rank) FROM k1 WHERE query_id = item_id AND locator NOT IN (SELECT locator FROM k2 WHERE query_id = item_id)), '') AS removed FROM benchmark""")
def replay_diff(c):
    def lists(part, name):
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "locator"))), lambda x: x["locator"])
        return keyword(c, 24, part).groupBy("query_id").agg(ordered.alias(name))

    both = c.questions().select("query_id").join(lists("all", "before"), "query_id", "left").join(lists("first", "after"), "query_id", "left")
    none = F.array().cast("array<string>")
    x = both.select("query_id", evaluation.replay_difference(F.coalesce("before", none), F.coalesce("after", none)).alias("d"))
    return x.select("query_id", F.array_join("d.added", ",").alias("added"), F.array_join("d.removed", ",").alias("removed"))


@query("""SELECT count(*) AS cases, count(*) FILTER (s = 'completed') AS completed, count(*) FILTER (s = 'failed') AS failed, 'completed_with_failures' AS state,
  round(avg(value / 1000) FILTER (s = 'completed'), 4) AS faithfulness, round(avg(value / 2000) FILTER (s = 'completed'), 4) AS relevancy
  FROM (SELECT *, CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'skipped' ELSE 'completed' END AS s FROM (SELECT value, CASE event_id % 9 WHEN 4 THEN 'error' ELSE event_type END AS event_type FROM events))""")
def judge_summary(c):
    kind = F.when(F.col("event_id") % 9 == 4, "error").otherwise(F.col("event_type"))
    state = F.when(kind == "error", "failed").when(kind == "click", "skipped").otherwise("completed")
    e = c.table("events").select(state.alias("state"), (F.col("value") / 1000).alias("faithfulness"), (F.col("value") / 2000).alias("relevancy"))
    return evaluation.judge_summary(e)


@query("""SELECT user_id AS answer_id, CASE WHEN arg_max(event_type = 'purchase', (ts, event_id)) THEN 'dismissed' ELSE 'open' END AS state, count(*) FILTER (event_type <> 'purchase') AS opened,
  CASE arg_max(event_type, (ts, event_id)) FILTER (event_type <> 'purchase') WHEN 'view' THEN 'retrieval_miss' WHEN 'click' THEN 'knowledge_stale_or_conflict' ELSE 'product_or_bug' END AS category
  FROM events GROUP BY user_id HAVING count(*) FILTER (event_type <> 'purchase') > 0""")
def feedback_fold(c):
    """Purchases as helpful feedback, all other events as unhelpful."""
    kind = F.col("event_type")
    reason = F.when(kind == "view", "missing_evidence").when(kind == "click", "outdated_information").when(kind != "purchase", "other")
    e = c.table("events").select(F.col("user_id").alias("answer_id"), (kind == "purchase").alias("helpful"), reason.alias("reason"), "ts", "event_id")
    return workflow.triage(workflow.accepted(e))


@query("""SELECT o_orderkey AS case_id, strftime(o_orderdate, '%Y-%m-%d') AS created, [o_orderpriority] AS titles, [o_orderstatus] AS keywords FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate, o_orderkey LIMIT 20""")
def export_cases(c):
    o = c.table("orders")
    cases = o.select(F.col("o_orderkey").alias("case_id"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") == "F", "approved").otherwise("draft").alias("state"),
                     F.array("o_orderpriority", F.concat(F.lit(" "), "o_orderpriority"), F.lit(" ")).alias("titles"), F.array("o_orderstatus").alias("keywords"))
    return workflow.export_cases(cases, 20).select("case_id", F.date_format("created_at", "yyyy-MM-dd").alias("created"), "titles", "keywords")


@query("""SELECT a.conv_id, a.turn, max(u.turn) AS user_turn, arg_max(u.text, u.turn) AS user_text FROM conversations a LEFT JOIN conversations u
  ON u.conv_id = a.conv_id AND u.role = 'user' AND u.turn < a.turn WHERE a.role = 'assistant' GROUP BY a.conv_id, a.turn""")
def asof_user_turn(c):
    return workflow.last_user_turn(c.table("conversations"))


@query("SELECT doc_id, n_chars, (SELECT count(*) FROM documents) AS total FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25 OFFSET 50")
def page_list(c):
    return workflow.page(c.table("documents").select("doc_id", "n_chars"), [F.desc("n_chars"), F.col("doc_id")], 50, 25)
