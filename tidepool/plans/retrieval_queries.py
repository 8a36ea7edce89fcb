"""Recall, fusion, selection and governance queries over benchmark questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepool.operators import governance, recall, selection
from tidepool.operators.ranking import coverage_first, ranked, reciprocal_rank_fusion, round_robin
from tidepool.operators.graph import saved
from tidepool.plans.base import CHUNKS, INDEX, TOKENS, keyword_list, query
from tidepool.plans.search import Corpus, candidates, fuse_routes, search, variants
from tidepool.plans.text_queries import _TAGS, tags

_WITH = f"WITH {CHUNKS}, {INDEX}"
_FIRST, _LAST = "left(text, 200)", "right(text, 200)"


def keyword(c, limit: int, part: str = "all"):
    return recall.keyword_recall(c.questions(part), recall.token_index(c.chunks()), limit)


def hits(c, limit: int):
    """Keyword hits with their question and chunk."""
    return keyword(c, limit).join(c.questions(), "query_id").join(c.chunks(), "locator")


@query(f"{_WITH}, {keyword_list('k', 8)} SELECT query_id, locator, score, rank FROM k")
def keyword_topk(c):
    return keyword(c, 8)


_VECTORS = """v AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 20 = 0),
  w AS (SELECT concat('document:', vec_id, ':chunk:0') AS locator, embedding::DOUBLE[] AS e FROM embeddings)"""


def stored(c):
    return c.table("embeddings").select(F.format_string("document:%d:chunk:0", "vec_id").alias("locator"), F.col("embedding").alias("vector"))


@query(f"""WITH {_VECTORS} SELECT query_id, locator, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, locator) AS rank
  FROM (SELECT query_id, locator, list_dot_product(q, e) AS score FROM v, w) WHERE score > 0) WHERE rank <= 10""")
def vector_topk(c):
    asked = c.table("embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return recall.vector_recall(asked, stored(c), 10).withColumn("score", F.round("score", 6))


_Q = TOKENS.format("b.text")


def _share(column: str) -> str:
    return f"len(list_intersect({_Q}, {TOKENS.format(column)})) / len({_Q})::DOUBLE"


_BOOST = f"least(0.2, greatest(0.0, 0.12 * ({_share('c.title')}) + 0.08 * ({_share('c.section')}) + 0.03 * ({_share('c.source_type')})))"


@query(f"""{_WITH}, {keyword_list('k', 24)} SELECT query_id, locator, round(CASE WHEN b > 0 THEN least(1.0, score + b) ELSE score END, 9) AS score, b > 0 AS boosted FROM (
  SELECT k.query_id, k.locator, k.score, {_BOOST} AS b FROM k JOIN benchmark b ON b.item_id = k.query_id JOIN chunks c USING (locator))""")
def metadata_boost(c):
    return recall.metadata_boost(hits(c, 24)).select("query_id", "locator", F.round("score", 9).alias("score"), "boosted")


@query(f"""WITH {_TAGS}, {CHUNKS}, known AS (SELECT * FROM tags ORDER BY normalized_name LIMIT 48),
  named AS (SELECT b.item_id AS query_id, t.tag_id FROM benchmark b JOIN known t ON contains(lower(b.text), t.normalized_name)),
  held AS (SELECT DISTINCT query_id, doc_id AS asset_id FROM documents d JOIN named n ON d.doc_id % 40 = n.tag_id WHERE d.doc_id % 3 <> 0)
  SELECT * FROM (SELECT query_id, locator, 1.0::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY asset_id) AS rank
  FROM held JOIN chunks c ON c.doc_id = held.asset_id) WHERE rank <= 24""")
def tag_recall(c):
    d = c.chunks()
    assigned = d.select(F.col("doc_id").alias("asset_id"), (F.col("doc_id") % 40).alias("tag_id"), F.when(F.col("doc_id") % 3 != 0, "approved").otherwise("pending").alias("state"))
    known = tags(c).orderBy("normalized_name").limit(48)  # as its SQL
    found = recall.tag_recall(c.questions(), known, assigned, d.withColumnRenamed("doc_id", "asset_id").select("asset_id", "locator", "ordinal"), 24)
    return found.select("query_id", "locator", "score", "rank")


@query(f"""WITH {_TAGS}, {CHUNKS}, m AS (SELECT tag_id, locator, ((length(lower(content)) - length(replace(lower(content), normalized_name, ''))) // length(normalized_name)) AS n
  FROM chunks JOIN tags ON contains(lower(content), normalized_name)),
  e AS (SELECT tag_id, normalized_name, count(*) AS mentions FROM m JOIN tags USING (tag_id) GROUP BY ALL),
  named AS (SELECT b.item_id AS query_id, tag_id FROM benchmark b JOIN e ON contains(lower(b.text), normalized_name))
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, locator) AS rank FROM (
  SELECT query_id, locator, max(2 + 0.1::DOUBLE * least(greatest(n, 1), 4)) AS score FROM m JOIN named USING (tag_id) GROUP BY ALL)) WHERE rank <= 24""")
def entity_recall(c):
    names = tags(c).select(F.col("tag_id").alias("entity_id"), "normalized_name")
    mentions = saved(recall.mention_counts(c.chunks(), names), "mentions")  # used twice
    counted = mentions.groupBy("entity_id").agg(F.count("*").alias("mention_count")).join(names, "entity_id")
    return recall.entity_recall(c.questions(), counted, mentions, 8)


@query("""SELECT lang AS query_id, source, doc_id, position FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY depth, source) AS position FROM (
  SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS depth FROM documents)) WHERE position <= 60""")
def balanced_round_robin(c):
    d = c.table("documents").select(F.col("lang").alias("query_id"), "source", "doc_id")
    return round_robin(d, "source", [F.col("doc_id")], 60).select("query_id", "source", "doc_id", "position")


def _fuse(parts: list[tuple[str, float]], limit: int) -> str:
    terms = " UNION ALL ".join(f"SELECT query_id, locator, {i} AS list, {w}::DOUBLE / (60 + rank) AS term FROM {name}" for i, (name, w) in enumerate(parts))
    return f"""fused AS (SELECT query_id, locator, sum(term ORDER BY list) AS raw FROM ({terms}) GROUP BY ALL)
  SELECT query_id, locator, round(score, 9) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, locator) AS rank FROM (
  SELECT query_id, locator, raw / max(raw) OVER (PARTITION BY query_id) AS score FROM fused)) WHERE rank <= {limit}"""


@query(f"{_WITH}, {keyword_list('k1', 24)}, {keyword_list('k2', 24, _FIRST)}, {_fuse([('k1', 1.0), ('k2', 1.0)], 8)}")
def rrf_two_list(c):
    return reciprocal_rank_fusion([(keyword(c, 24), 1.0), (keyword(c, 24, "first"), 1.0)], limit=8).withColumn("score", F.round("score", 9))


@query(f"{_WITH}, {keyword_list('k1', 24)}, {keyword_list('k2', 24, _FIRST)}, {keyword_list('k3', 24, _LAST)}, {_fuse([('k1', 1.0), ('k2', 1.0), ('k3', 0.85)], 8)}")
def rrf_weighted_multi(c):
    lists = [(keyword(c, 24), 1.0), (keyword(c, 24, "first"), 1.0), (keyword(c, 24, "last"), 0.85)]
    return reciprocal_rank_fusion(lists, limit=8).withColumn("score", F.round("score", 9))


@query(f"""{_WITH}, {keyword_list('k', 24)}, v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, locator) AS rank FROM (
  SELECT b.item_id AS query_id, concat('document:', w.vec_id, ':chunk:0') AS locator, list_dot_product(q.embedding::DOUBLE[], w.embedding::DOUBLE[]) AS score
  FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id, embeddings w) WHERE score > 0) WHERE rank <= 24), {_fuse([('k', 1.0), ('v', 1.0)], 8)}""")
def hybrid_search(c):
    """Keyword and vector recall of the benchmark questions, fused; a question's vector is the one with its id."""
    asked = c.questions().join(c.table("embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), "query_id")
    vector = recall.vector_recall(asked.select("query_id", "vector"), stored(c), 24)
    return reciprocal_rank_fusion([(keyword(c, 24), 1.0), (vector, 1.0)], limit=8).withColumn("score", F.round("score", 9))


@query(f"""{_WITH}, {keyword_list('k', 24)} SELECT * FROM (SELECT query_id, locator, round(s, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, locator) AS rank FROM (
  SELECT k.query_id, k.locator, k.score + 0.35::DOUBLE * len(list_intersect({_Q}, {TOKENS.format('c.title')})) + 0.08::DOUBLE * len(list_intersect({_Q}, {TOKENS.format('c.content')})) AS s
  FROM k JOIN benchmark b ON b.item_id = k.query_id JOIN chunks c USING (locator))) WHERE rank <= 8""")
def rule_rerank(c):
    return selection.rule_rerank(hits(c, 24), 8).select("query_id", "locator", F.round("score", 9).alias("score"), "rank")


_EST = r"greatest(1, ceil(length(regexp_replace({0}, '[^\x00-\x7F]', '', 'g')) / 4.0 + (length({0}) - length(regexp_replace({0}, '[^\x00-\x7F]', '', 'g'))) * 1.5))::BIGINT"
_COST = _EST.format("('[' || c.locator || '] ' || c.title || ' ' || chr(10))") + " + " + _EST.format("c.content") + " + 12"


@query(f"""{_WITH}, {keyword_list('k', 24)}, x AS (SELECT k.*, c.document_id, {_COST} AS tokens,
  (row_number() OVER (PARTITION BY k.query_id, c.document_id ORDER BY k.rank) = 1)::INT AS fresh FROM k JOIN chunks c USING (locator)),
  y AS (SELECT *, sum(tokens) OVER w AS used, lag(score) OVER w - score AS fell, sum(fresh) OVER w - fresh AS covered, count(*) OVER (PARTITION BY query_id) AS n FROM x WINDOW w AS (PARTITION BY query_id ORDER BY rank)),
  z AS (SELECT *, CASE WHEN rank > 3 AND rank <= 12 AND used > 3276 THEN 'context_budget_reached'
    WHEN rank > 3 AND rank <= 12 AND fell >= 0.12 AND NOT (covered < 2 AND fresh = 1) THEN 'score_gap_reached' END AS why FROM y),
  s AS (SELECT query_id, min(rank) AS at, arg_min(why, rank) AS why FROM z WHERE why IS NOT NULL GROUP BY query_id)
  SELECT z.query_id, z.locator, z.rank, coalesce(s.why, CASE WHEN z.n > 12 THEN 'maximum_candidates_reached' ELSE 'candidates_exhausted' END) AS stop_reason
  FROM z LEFT JOIN s USING (query_id) WHERE z.rank <= 12 AND (s.at IS NULL OR z.rank < s.at)""")
def dynamic_topk(c):
    x = selection.with_tokens(hits(c, 24))
    return selection.dynamic_top_k(x, 12).select("query_id", "locator", "rank", "stop_reason")


@query(f"""{_WITH}, {keyword_list('k', 8)}, s AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-zA-Z0-9_]{{2,}}'))) AS signal FROM benchmark),
  m AS (SELECT query_id, count(DISTINCT signal) AS matched FROM s JOIN k USING (query_id) JOIN chunks c USING (locator) WHERE contains(lower(c.title || chr(10) || c.content), signal) GROUP BY query_id)
  SELECT b.item_id AS query_id, CASE WHEN h.n IS NULL THEN 'empty_candidates' WHEN m.matched > 0 THEN 'lexical_support' ELSE 'no_lexical_support' END AS reason, coalesce(m.matched, 0) AS matched
  FROM benchmark b LEFT JOIN (SELECT query_id, count(*) AS n FROM k GROUP BY 1) h ON h.query_id = b.item_id LEFT JOIN m ON m.query_id = b.item_id""")
def answerability(c):
    out = selection.answerability(c.questions(), hits(c, 8))
    return out.select("query_id", "reason", F.col("matched").cast("long").alias("matched"))


@query()
def context_budget(c):
    out = selection.context_budget(hits(c, 8))
    return out.select("query_id", "rank", "locator", "tokens", "truncated", F.sha2("content", 256).alias("content_sha256"))


@query()
def parent_child(c):
    """The longest line of each document with its neighbours."""
    lines = c.lines()
    best = ranked(lines.withColumn("_n", F.length("content")), ["document_id"], [F.desc("_n"), F.col("ordinal")], "_r").where("_r = 1")
    out = selection.expand_parents(best.withColumn("query_id", F.col("document_id")).drop("_n", "_r"), lines)
    return out.select("query_id", "locator", "parts", F.sha2("content", 256).alias("content_sha256"))


_FACTS = """f AS (SELECT concat('document:', doc_id, ':chunk:0') AS locator, doc_id, CASE quality WHEN 1 THEN 0.06 ELSE -0.04 END::DOUBLE AS trust, toxic,
  TIMESTAMP '2026-01-01' + to_days((doc_id % 400)::INT) AS effective_at, TIMESTAMP '2026-01-01' + to_days((doc_id % 700)::INT) AS expires_at FROM labels),
  a AS (SELECT *, CASE WHEN effective_at > TIMESTAMP '2026-07-01' THEN 'future' WHEN expires_at <= TIMESTAMP '2026-07-01' THEN 'expired' ELSE 'available' END AS availability FROM f),
  gone AS (SELECT DISTINCT concat('document:', doc_id - 7, ':chunk:0') AS locator FROM labels WHERE doc_id % 11 = 0)"""


@query(f"WITH {_FACTS} SELECT doc_id::VARCHAR AS document_id, availability FROM a")
def availability(c):
    as_of = F.lit("2026-07-01").cast("timestamp_ntz")
    return c.governed().select("document_id", governance.availability(F.col("effective_at"), F.col("expires_at"), as_of).alias("availability"))


@query(f"WITH {_FACTS} SELECT doc_id::VARCHAR AS document_id FROM documents WHERE concat('document:', doc_id, ':chunk:0') NOT IN (SELECT locator FROM gone)")
def supersede_anti(c):
    d = c.chunks().select("document_id")
    return d.join(governance.superseded(c.governed()), "document_id", "left_anti")


@query(f"""{_WITH}, {keyword_list('k', 24)}, {_FACTS} SELECT query_id, locator, round(s, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, locator) AS rank FROM (
  SELECT k.query_id, k.locator, greatest(0.0, least(1.0, k.score + coalesce(a.trust, 0) + (CASE WHEN a.availability = 'expired' THEN -0.12 ELSE 0 END)::DOUBLE
  + (CASE WHEN a.toxic = 1 THEN -0.08 ELSE 0 END)::DOUBLE)) AS s FROM k LEFT JOIN a USING (locator)
  WHERE k.locator NOT IN (SELECT locator FROM gone) AND coalesce(a.availability <> 'future', true))""")
def governance_filter(c):
    found = keyword(c, 24).join(c.chunks().select("locator", "document_id"), "locator")
    out = governance.govern(found, c.governed(), F.lit("2026-07-01").cast("timestamp_ntz"))
    return out.select("query_id", "locator", F.round("score", 9).alias("score"), "rank")


@query("""SELECT lang AS query_id, source, doc_id, position FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY (n > 1)::INT, r) AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY r) AS n FROM (SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r FROM documents)))""",
       name="coverage_first")
def coverage(c):
    d = c.table("documents").select(F.col("lang").alias("query_id"), F.col("source").alias("document_id"), "doc_id", "n_chars")
    out = coverage_first(ranked(d, ["query_id"], [F.desc("n_chars"), F.col("doc_id")]))
    return out.select("query_id", F.col("document_id").alias("source"), "doc_id", "position")


def _corpus(c):
    """Documents as chunks, with the tags as entities and as tags."""
    d, names = c.chunks(), tags(c).select(F.col("tag_id").alias("entity_id"), "normalized_name")
    mentions = saved(recall.mention_counts(d, names), "mentions")  # used twice
    counted = mentions.groupBy("entity_id").agg(F.count("*").alias("mention_count")).join(names, "entity_id")
    assigned = d.select(F.col("doc_id").alias("asset_id"), (F.col("doc_id") % 40).alias("tag_id"), F.when(F.col("doc_id") % 3 != 0, "approved").otherwise("pending").alias("state"))
    assets = d.select(F.col("doc_id").alias("asset_id"), "locator", "ordinal")
    return Corpus(d, governed=c.governed(), entities=counted, mentions=mentions, tags=tags(c), assignments=assigned, assets=assets)


def _shared(column: str) -> str:
    return f"len(list_intersect(q.t, c.{column})) / len(q.t)::DOUBLE"


def _fused(name: str, first: str, second: str) -> str:
    """A list of 20 fused from two, as a common table expression."""
    return f"""{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, locator) AS rank FROM (
  SELECT query_id, locator, raw / max(raw) OVER (PARTITION BY query_id) AS score FROM (SELECT query_id, locator, sum(term ORDER BY list) AS raw FROM (
  SELECT query_id, locator, 0 AS list, 1::DOUBLE / (60 + rank) AS term FROM {first} UNION ALL SELECT query_id, locator, 1, 1::DOUBLE / (60 + rank) FROM {second}) GROUP BY ALL)) QUALIFY rank <= 20)"""


@query(f"""WITH {_TAGS}, {CHUNKS}, {INDEX}, q AS (SELECT item_id AS query_id, text, {TOKENS.format('text')} AS t FROM benchmark),
  c AS (SELECT locator, {TOKENS.format('title')} AS title, {TOKENS.format('section')} AS section, {TOKENS.format('source_type')} AS kind FROM chunks),
  hits AS (SELECT query_id, locator, count(*) / n::DOUBLE AS score FROM (SELECT query_id, len(t) AS n, unnest(t) AS token FROM q) JOIN idx USING (token) GROUP BY query_id, locator, n),
  raised AS (SELECT query_id, locator, CASE WHEN b > 0 THEN least(1.0, score + b) ELSE score END AS score FROM (SELECT query_id, locator, score,
    least(0.2, greatest(0.0, 0.12 * ({_shared('title')}) + 0.08 * ({_shared('section')}) + 0.03 * ({_shared('kind')}))) AS b FROM hits JOIN q USING (query_id) JOIN c USING (locator))),
  k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, locator) AS rank FROM raised QUALIFY rank <= 20),
  m AS (SELECT tag_id, locator, ((length(lower(content)) - length(replace(lower(content), normalized_name, ''))) // length(normalized_name)) AS n
    FROM chunks JOIN tags ON contains(lower(content), normalized_name)),
  e AS (SELECT tag_id, normalized_name, count(*) AS mentions FROM m JOIN tags USING (tag_id) GROUP BY ALL),
  named AS (SELECT query_id, tag_id FROM q JOIN e ON contains(lower(text), normalized_name)),
  ent AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, locator) AS rank FROM (
    SELECT query_id, locator, max(2 + 0.1::DOUBLE * least(greatest(n, 1), 4)) AS score FROM m JOIN named USING (tag_id) GROUP BY ALL) QUALIFY rank <= 20),
  held AS (SELECT DISTINCT query_id, doc_id FROM documents d JOIN tags t ON d.doc_id % 40 = t.tag_id JOIN q ON contains(lower(q.text), t.normalized_name) WHERE d.doc_id % 3 <> 0),
  tagged AS (SELECT query_id, locator, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rank FROM held JOIN chunks USING (doc_id) QUALIFY rank <= 20),
  {_fused('one', 'k', 'ent')}, {_fused('two', 'one', 'tagged')} SELECT query_id, locator, round(score, 9) AS score, rank FROM two""")
def search_candidates(c):
    """Boosted keyword recall, entity and tag recall of the benchmark questions, fused as the whole path does."""
    asked = variants(c.questions())
    found = candidates(asked, _corpus(c), 20)
    out = fuse_routes(found, asked, {"keyword", "entity", "tag"}, 20)
    return out.select("query_id", "locator", F.round("score", 9).alias("score"), "rank")


@query()
def search_evidence(c):
    """The whole path for the benchmark questions."""
    evidence, _ = search(c.questions(), _corpus(c), as_of=F.lit("2026-07-01").cast("timestamp_ntz"))
    return evidence.select("query_id", "locator", "rank", F.round("score", 9).alias("score"), "stop_reason", F.sha2("content", 256).alias("content_sha256"))


@query()
def search_decisions(c):
    """The whole path for what users said in conversations."""
    said = c.table("conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("query"))
    _, decisions = search(said, _corpus(c), as_of=F.lit("2026-07-01").cast("timestamp_ntz"))
    return decisions


@query(rf"""WITH {CHUNKS}, q AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS w FROM benchmark),
  t AS (SELECT query_id, len(w) AS n, unnest(w) AS term FROM q), d AS (SELECT locator, unnest(list_distinct(regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}_]+'))) AS term FROM chunks)
  SELECT query_id, count(*) AS matches FROM (SELECT query_id, locator FROM t JOIN d USING (term) GROUP BY query_id, locator, n HAVING count(*) = n) GROUP BY query_id""")
def full_text_match(c):
    """How many chunks hold every word of a question."""
    return recall.full_text_recall(c.questions(), c.chunks()).groupBy("query_id").agg(F.count("*").alias("matches"))


@query(rf"""WITH {CHUNKS}, q AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS w FROM benchmark),
  x AS (SELECT locator, regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}_]+') AS words FROM chunks),
  t AS (SELECT query_id, len(w) AS n, unnest(w) AS term FROM q), d AS (SELECT locator, unnest(list_distinct(words)) AS term FROM x),
  whole AS (SELECT query_id, locator, n FROM t JOIN d USING (term) GROUP BY query_id, locator, n HAVING count(*) = n),
  p AS (SELECT query_id, locator, pos, term, row_number() OVER (PARTITION BY query_id, locator ORDER BY pos) AS i FROM (
    SELECT query_id, locator, w, unnest(words) AS term, unnest(range(len(words))) AS pos FROM whole JOIN q USING (query_id) JOIN x USING (locator)) WHERE list_contains(w, term)),
  l AS (SELECT a.query_id, a.locator, a.i, b.term, max(b.i) AS last FROM p a JOIN p b ON a.query_id = b.query_id AND a.locator = b.locator AND b.i <= a.i GROUP BY ALL),
  c AS (SELECT query_id, locator, first, min(i) AS i FROM (SELECT query_id, locator, i, min(last) AS first, count(*) AS k FROM l GROUP BY ALL) JOIN whole USING (query_id, locator) WHERE k = n GROUP BY ALL),
  s AS (SELECT c.query_id, c.locator, sum(0.1 / (1 + greatest(e.pos - f.pos - (c.i - c.first), 0))::DOUBLE ORDER BY c.i) AS s FROM c
    JOIN p e ON e.query_id = c.query_id AND e.locator = c.locator AND e.i = c.i JOIN p f ON f.query_id = c.query_id AND f.locator = c.locator AND f.i = c.first GROUP BY ALL)
  SELECT query_id, locator, round(score, 9) AS score, rank FROM (SELECT query_id, locator, s / (1 + s) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s / (1 + s) DESC, locator) AS rank FROM s) WHERE rank <= 8""")
def full_text_topk(c):
    """The chunks that hold every word of a question, by cover density."""
    return recall.full_text_recall(c.questions(), c.chunks(), 8).withColumn("score", F.round("score", 9))
