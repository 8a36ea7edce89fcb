"""Queries on the life of sources, notes, entities and communities."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepool.operators import graph, lifecycle
from tidepool.plans import graph_queries
from tidepool.plans.base import query


@query("""SELECT page_id, 'pending' AS validation_state FROM (SELECT page_id, CASE WHEN page_id % 5 <> 0 THEN DATE '2026-01-01' + (page_id % 90)::INT END AS seen,
  CASE WHEN page_id % 7 = 0 THEN 'pending' ELSE 'valid' END AS state FROM pages)
  WHERE (seen IS NULL OR seen < DATE '2026-02-20') AND (state <> 'pending' OR seen < DATE '2026-02-20') ORDER BY seen NULLS FIRST, page_id LIMIT 50""")
def revalidation_claim(c):
    at = F.when(F.col("page_id") % 5 != 0, F.date_add(F.lit("2026-01-01").cast("date"), (F.col("page_id") % 90).cast("int")))
    p = c.table("pages").select(
        F.col("page_id").alias("document_id"), F.lit("webpage").alias("source_type"), F.col("url").alias("source_url"), F.lit("indexed").alias("status"),
        at.alias("validated_at"), F.when(F.col("page_id") % 7 == 0, "pending").otherwise("valid").alias("validation_state"), F.col("page_id").alias("updated_at"))
    out = lifecycle.claim_due(p, F.lit("2026-02-20").cast("date"), F.lit("2026-03-01").cast("date"), 50)
    return out.select(F.col("document_id").alias("page_id"), "validation_state")


@query("""SELECT source AS query_id, rank, title, doc_id AS source_id FROM (SELECT *, left(text, 500) AS title, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 20""")
def evidence_snapshot(c):
    d = c.table("documents").select(F.col("source").alias("query_id"), F.col("doc_id").alias("source_id"), F.col("text").alias("title"), F.col("text").alias("content"), "n_chars")
    return lifecycle.snapshot(lifecycle.ranked(d, ["query_id"], [F.desc("n_chars"), F.col("source_id")]))


@query("""SELECT run_id, position, locator FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step, locator) AS position FROM (
  SELECT user_id AS run_id, concat(event_type, ':', floor(value)::BIGINT) AS locator, min(event_id) AS step FROM events WHERE value IS NOT NULL GROUP BY ALL)) WHERE position <= 60""")
def seen_locators(c):
    e = c.table("events").where("value IS NOT NULL")
    return lifecycle.seen_locators(e.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("step"), F.concat("event_type", F.lit(":"), F.floor("value")).alias("locator")))


_REVISED = 3


@query(f"""SELECT concat('document:', doc_id, ':chunk:0') AS locator, left(text, 60) AS title, 64::BIGINT AS dims FROM documents JOIN embeddings ON vec_id = doc_id WHERE lang <> 'en'
  UNION ALL SELECT concat('note:', doc_id), left(text, 60), 64 FROM documents JOIN embeddings ON vec_id = doc_id WHERE lang = 'en' AND label = {_REVISED}""")
def note_candidates(c):
    """Documents in English as notes, the others as chunks; an embedding's label as its revision."""
    d, e = c.chunks(), c.table("embeddings").select("vec_id", "label", F.col("embedding").alias("vector"))
    notes = d.select(F.col("doc_id").alias("note_id"), "title", "content", F.when(F.col("source_type") == "en", "active").otherwise("archived").alias("status"))
    own = lifecycle.note_evidence(notes, e.select(F.col("vec_id").alias("note_id"), F.col("label").alias("embedding_revision"), "vector"), F.lit(_REVISED))
    chunks = d.where("source_type <> 'en'").join(e.withColumnRenamed("vec_id", "doc_id"), "doc_id")
    return lifecycle.candidates(chunks, own).select("locator", "title", F.size("vector").cast("long").alias("dims"))


@query(f"""WITH {graph_queries._ENTITIES}, known AS (SELECT *, lower(name) AS low FROM entities ORDER BY mention_count DESC, name, entity_id LIMIT 192),
  q AS (SELECT conv_id * 1000 + turn AS query_id, lower(text) AS query FROM conversations WHERE role = 'user'),
  met AS (SELECT * FROM q JOIN known ON contains(query, low) OR len(list_filter(regexp_split_to_array(query, '\\s+'), lambda t: length(t) >= 2 AND contains(low, t))) > 0)
  SELECT query_id, entity_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY mention_count DESC, name, entity_id) AS n FROM met) WHERE n <= 48""")
def entity_seeds(c):
    said = c.table("conversations").where("role = 'user'").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.lower("text").alias("query"), (graph.relation_mode(F.col("text")) == "global").alias("is_global"))
    return lifecycle.entity_seeds(said, graph_queries.entities(c))


@query("""WITH m AS (SELECT concat('p', l_partkey) AS entity_id, o_orderstatus AS s FROM lineitem JOIN orders ON o_orderkey = l_orderkey
    UNION ALL SELECT concat('s', l_suppkey), o_orderstatus FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
  n AS (SELECT entity_id, count(*) FILTER (s <> 'F') AS kept, count(*) FILTER (s = 'F') AS gone FROM m GROUP BY entity_id),
  e AS (SELECT concat('p', p_partkey) AS entity_id, p_size::BIGINT AS mention_count FROM part UNION ALL SELECT concat('s', s_suppkey), 50 FROM supplier)
  SELECT entity_id, CASE WHEN gone > 0 THEN kept ELSE mention_count END AS mention_count FROM e LEFT JOIN n USING (entity_id) WHERE coalesce(gone, 0) = 0 OR kept > 0""")
def entity_removal(c):
    """The graph of parts and suppliers without the lines of finished orders."""
    deleted = c.table("lineitem").join(c.table("orders").where("o_orderstatus = 'F'"), F.expr("l_orderkey = o_orderkey"), "left_semi").select(
        F.format_string("document:%d:chunk:%d", "l_orderkey", "l_linenumber").alias("locator"))
    kept, _, _ = lifecycle.without_documents(graph_queries.entities(c), graph_queries.mentions(c), c.relations(), deleted)
    return kept.select("entity_id", "mention_count")


_BASES = """b AS (SELECT n_nationkey AS kb_id, n_regionkey AS revision, CASE WHEN n_nationkey % 3 = 0 THEN 'building' ELSE 'ready' END AS graph_status FROM nation),
  s AS (SELECT s_nationkey AS kb_id, s_suppkey % 5 AS revision, s_suppkey AS community FROM supplier)"""


def _bases(c):
    n, s = c.table("nation"), c.table("supplier")
    bases = n.select(F.col("n_nationkey").cast("long").alias("kb_id"), F.col("n_regionkey").cast("long").alias("revision"),
                     F.when(F.col("n_nationkey") % 3 == 0, "building").otherwise("ready").alias("graph_status"))
    return bases, s.select(F.col("s_nationkey").cast("long").alias("kb_id"), (F.col("s_suppkey") % 5).alias("revision"), F.col("s_suppkey").alias("community"))


@query(f"WITH {_BASES} SELECT kb_id, revision, community FROM s JOIN b USING (kb_id, revision) WHERE graph_status = 'ready'")
def current_summaries(c):
    return lifecycle.current_summaries(*_bases(c))


@query(f"""WITH {_BASES}, done AS (SELECT kb_id, revision + 1 AS revision FROM b WHERE kb_id % 4 = 0),
  after AS (SELECT kb_id, revision + (kb_id % 4 = 0)::INT AS revision FROM b WHERE kb_id % 4 = 0 OR graph_status = 'ready')
  SELECT kb_id, revision, community FROM (SELECT * FROM s WHERE kb_id % 4 <> 0 UNION ALL SELECT s.kb_id, done.revision, s.community FROM s JOIN done USING (kb_id))
  JOIN after USING (kb_id, revision) WHERE kb_id % 5 <> 1""")
def community_rebuild(c):
    """Every fourth base is rebuilt, every fifth then invalidated; what can be read afterwards."""
    bases, summaries = _bases(c)
    bases, summaries = lifecycle.rebuilt(bases, summaries, summaries.where("kb_id % 4 = 0").drop("revision"))
    return lifecycle.current_summaries(*lifecycle.invalidated(bases, summaries, bases.where("kb_id % 5 = 1")))


@query("SELECT o_custkey AS user_id, c_name AS name, o_orderkey AS joined FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderpriority = '1-URGENT'")
def workspace_members(c):
    m = c.table("orders").select(F.col("o_orderpriority").alias("workspace_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("joined"))
    users = c.table("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    return lifecycle.members(m, users, F.lit("1-URGENT")).select("user_id", "name", "joined")


@query("""WITH d AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS place FROM documents),
  x AS (SELECT source AS kb_id, place, doc_id AS document_id, string_split(text, chr(10)) AS parts FROM d WHERE place <= 8)
  SELECT kb_id, place, document_id, n - 1 AS ordinal, parts[n] AS content FROM (SELECT *, unnest(range(1, least(len(parts), 5) + 1)) AS n FROM x)""")
def mind_map_sources(c):
    d = c.table("documents").select(F.col("source").alias("kb_id"), F.col("doc_id").alias("document_id"), F.lit("indexed").alias("status"), F.col("n_chars").alias("updated_at"))
    return lifecycle.mind_map_sources(d, c.lines())
