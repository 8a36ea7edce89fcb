"""Text, chunking and web queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepool.functions import chunking, text
from tidepool.operators import recall, selection
from tidepool.operators.ranking import ranked
from tidepool.plans.base import TOKENS, query
from tidepool.sources import web

_MARK = " ... "


@query(f"SELECT doc_id, len({TOKENS.format('text')}) AS n_tokens FROM documents")
def text_tokens(c):
    return c.table("documents").select("doc_id", F.size(text.tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query(r"""SELECT doc_id, greatest(1, ceil(a / 4.0 + (n - a) * 1.5))::BIGINT AS tokens FROM (
  SELECT doc_id, length(text) AS n, length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) AS a FROM documents)""")
def token_estimate(c):
    return c.table("documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


@query(r"""SELECT doc_id, sha256(regexp_replace(t, '\bsk-[A-Za-z0-9_-]{20,}\b', '[REDACTED_SECRET]', 'g')) AS clean_sha256,
  len(regexp_extract_all(t, '\bsk-[A-Za-z0-9_-]{20,}\b')) AS secrets FROM (SELECT doc_id, replace(text, 'token = "', 'sk-') AS t FROM documents)""")
def sanitize_secrets(c):
    """Tokens in the driver's documents are turned into sk- keys first, so that there is something to redact."""
    t = F.replace(F.col("text"), F.lit('token = "'), F.lit("sk-"))
    return c.table("documents").select("doc_id", F.sha2(text.redacted(t), 256).alias("clean_sha256"), text.secret_count(t).alias("secrets"))


@query("""SELECT doc_id, content_hash FROM (SELECT doc_id, sha256(text) AS content_hash,
  row_number() OVER (PARTITION BY sha256(text) ORDER BY (lang <> 'en'), doc_id) AS n FROM documents) WHERE n = 1""")
def content_hash_dedup(c):
    """The row of each text that stays: one in en if there is one, else the oldest."""
    d = c.table("documents").select("doc_id", "lang", F.sha2("text", 256).alias("content_hash"))
    best = F.min_by("doc_id", F.struct((F.col("lang") != "en").alias("other"), "doc_id"))
    return d.groupBy("content_hash").agg(best.alias("doc_id")).select("doc_id", "content_hash")


@query(r"""SELECT doc_id FROM (SELECT doc_id, source, length(regexp_replace(text, '\s+', '', 'g')) >= 12 AS ok,
  bool_or(length(regexp_replace(text, '\s+', '', 'g')) >= 12) OVER (PARTITION BY source) AS any_ok FROM documents) WHERE ok OR NOT any_ok""")
def low_information(c):
    d = c.table("documents").select("doc_id", F.col("source").alias("query_id"), F.col("source").alias("title"), F.col("text").alias("content"))
    return selection.drop_low_information(d).select("doc_id")


@query(r"""SELECT doc_id, CASE WHEN length(text) <= 200 THEN text WHEN (length(j) - length(replace(j, '```', ''))) // 3 % 2 = 1 THEN regexp_replace(j, '\s+$', '') || chr(10) || '```' ELSE j END AS cut
  FROM (SELECT doc_id, text, regexp_replace(left(text, 140), '\s+$', '') || ' ... ' || regexp_replace(right(text, 55), '^\s+', '') AS j FROM documents)""")
def truncate_head_tail(c):
    return c.table("documents").select("doc_id", text.head_tail(F.col("text"), 200, _MARK).alias("cut"))


@query(r"SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '[a-zA-Z0-9_]{2,}'))) AS n_signals FROM documents")
def signals(c):
    return c.table("documents").select("doc_id", F.size(text.signals(F.col("text"))).cast("long").alias("n_signals"))


@query(r"""SELECT source, '社区摘要：' || string_agg(part, '；' ORDER BY n) AS summary FROM (
  SELECT source, left(trim(regexp_replace(text, '\s+', ' ', 'g')), 240) AS part, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents)
  WHERE n <= 4 GROUP BY source""")
def deterministic_summary(c):
    d = ranked(c.table("documents").select("source", "doc_id", "text"), ["source"], [F.col("doc_id")], "n").where("n <= 4")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"])
    return d.groupBy("source").agg(text.summary(texts).alias("summary"))


@query("""SELECT source, string_agg(part || ' [' || n || ']', chr(10) ORDER BY n) AS answer FROM (
  SELECT source, CASE WHEN length(text) > 220 THEN left(text, 220) || '...' ELSE text END AS part,
  row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 4 GROUP BY source""")
def extractive_answer(c):
    d = ranked(c.table("documents").select("source", "doc_id", "text"), ["source"], [F.col("doc_id")], "n").where("n <= 4")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"])
    return d.groupBy("source").agg(text.extractive_answer(texts).alias("answer"))


_TAGS = """tags AS (SELECT item_id AS tag_id, regexp_extract(lower(text), '[a-z]{6,}') AS normalized_name FROM benchmark WHERE regexp_extract(lower(text), '[a-z]{6,}') <> '')"""


def tags(c):
    name = F.regexp_extract(F.lower("text"), "[a-z]{6,}", 0)
    return c.table("benchmark").select(F.col("item_id").alias("tag_id"), name.alias("normalized_name"), F.lit("active").alias("status")).where("normalized_name <> ''")


@query(f"""WITH {_TAGS} SELECT doc_id AS document_id, tag_id, 'pending' AS state, 1.0::DOUBLE AS confidence FROM documents JOIN tags
  ON contains(lower(source || chr(10) || text), normalized_name) WHERE NOT (doc_id % 40 = tag_id)""")
def auto_tag(c):
    d = c.table("documents").select(F.col("doc_id").alias("document_id"), F.col("source").alias("title"), F.col("text").alias("content"))
    assigned = d.select("document_id", (F.col("document_id") % 40).alias("tag_id"))
    return recall.auto_tags(d, tags(c), assigned)


@query()
def normalize_text(c):
    return c.table("documents").select("doc_id", F.sha2(text.normalize("text"), 256).alias("normalized_sha256"))


@query()
def hash_embed(c):
    return c.table("documents").select("doc_id", F.transform(text.hash_embedding(64)("text"), lambda x: F.round(x, 6)).alias("vector"))


@query()
def chunk_paragraph(c):
    out = chunking.exploded(c.table("documents"), "doc_id", chunking.chunk_paragraphs)
    return out.select("document_id", "ordinal", F.length("content").cast("long").alias("n_chars"), F.sha2("content", 256).alias("content_sha256"))


@query()
def chunk_structured(c):
    out = chunking.exploded(c.table("documents"), "doc_id", chunking.chunk_structured)
    return out.select("document_id", "ordinal", F.length("content").cast("long").alias("n_chars"), F.sha2("content", 256).alias("content_sha256"),
                      F.try_element_at("metadata", F.lit("section")).alias("section"))


@query()
def html_extract(c):
    p = c.table("pages").select("page_id", web.html_content("html").alias("x"))
    return p.select("page_id", "x.title", F.sha2("x.text", 256).alias("text_sha256"), F.length("x.text").cast("long").alias("n_chars"))


_PARTS = r"""parts AS (SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS authority, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path,
  regexp_extract(url, '^[^?#]*(\?[^#]*)', 1) AS query FROM pages)"""


@query(rf"""WITH {_PARTS} SELECT page_id, CASE WHEN scheme = 'https' THEN 'https://' || lower(authority) || (CASE WHEN path = '' THEN '/' ELSE path END) || query END AS url,
  CASE WHEN scheme <> 'https' THEN 'scheme' END AS error FROM parts""")
def url_normalize(c):
    x = c.table("pages").select("page_id", web.checked_url(F.col("url")).alias("x"))
    return x.select("page_id", "x.url", "x.error")


@query(rf"""WITH {_PARTS} SELECT page_id, coalesce(nullif(regexp_extract(regexp_replace(path, '/+$', ''), '([^/]*)$', 1), ''), lower(authority)) AS title FROM parts""")
def title_fallback(c):
    return c.table("pages").select("page_id", web.fallback_title(F.col("url")).alias("title"))


@query(rf"""WITH {_PARTS} SELECT lower(authority) AS host, count(*) AS pages, bool_or(lower(authority) = 'example.org' OR lower(authority) LIKE '%.example.org') AS approved
  FROM parts GROUP BY ALL""")
def approved_domain(c):
    p = c.table("pages").select(web.host(F.col("url")).alias("host"))
    return p.groupBy("host").agg(F.count("*").alias("pages"), F.bool_or(web.approved(F.col("host"), ("example.org",))).alias("approved"))


@query("""SELECT event_id, CASE WHEN code IS NULL THEN 'valid' ELSE 'unavailable' END AS state, code FROM (SELECT event_id, CASE
  WHEN event_id % 17 = 3 THEN 'TIMEOUT' WHEN s IN (401, 403) THEN 'ACCESS_DENIED' WHEN s IN (404, 410) THEN 'NOT_FOUND' WHEN s >= 400 THEN 'HTTP_ERROR'
  WHEN event_type = 'view' THEN 'NOT_HTML' WHEN value > 50 THEN 'TOO_LARGE' END AS code FROM (SELECT *, [200, 301, 403, 404, 500][event_id % 5 + 1] AS s FROM events))""")
def source_health(c):
    e = c.table("events")
    status = F.array(*map(F.lit, (200, 301, 403, 404, 500)))[(F.col("event_id") % 5).cast("int")]
    kind = F.when(F.col("event_type") == "view", "application/pdf").otherwise("text/html; charset=utf-8")
    error = F.when(F.col("event_id") % 17 == 3, "timeout")
    x = e.select("event_id", web.source_health(status, kind, F.col("value"), error, most=50).alias("x"))
    return x.select("event_id", "x.state", "x.code")
