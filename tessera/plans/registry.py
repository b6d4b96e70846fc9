"""Every registered query and its equivalent SQL.

Queries bind the operators to the Parquet tables; parameters are the constants
below, the same on both sides.
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import chunking, enrich, html, prompts, text, urls, vectors
from tessera.operators import accounts, analytics, ingest, search
from tessera.sources import readers, tables
from tessera.streaming import streams

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

AS_OF = datetime(2024, 1, 31)
K = 10
TERMS = ["the", "that", "with"]
HIT_TERMS = ["the", "and"]
BASE = "https://example.com"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _probe(spark: SparkSession, sf_dir: str) -> list[float]:
    """The vector of vec_id 0 stands for an embedded question."""
    row = tables.read(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()
    return [float(x) for x in row[0]]


# SQL that several oracles share ----------------------------------------------------

#: Unicode white space as a class of the SQL engine's patterns.
_WS = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_WS_PY = _WS[:-1] + r"\x1c-\x1f]"


def _trim(x: str, ws: str = _WS) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{ws}+', ''), '{ws}+$', '')"


def _truncated(t: str) -> str:
    head, far = f"substr({t}, 1, 400)", f"regexp_extract(substr({t}, 1, 400), '(?s)^(.{{240}}.*[.!?\\n])', 1)"
    return f"CASE WHEN length({t}) <= 400 THEN {t} WHEN {far} <> '' THEN regexp_replace({far}, '{_WS}+$', '') WHEN contains({head}, ' ') THEN regexp_extract({head}, '(?s)^(.*) ', 1) || '...' ELSE {head} || '...' END"

_TOKENS = r"regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{N}}]+')"


def _lex(tokens: str, terms: list[str]) -> str:
    score = " + ".join(f"(1 - 1 / (1 + len(list_filter({tokens}, lambda t: t = '{w}'))::DOUBLE))" for w in terms)
    return f"round(({score}) / {len(terms)} / (1 + ln(greatest(len({tokens}), 1)::DOUBLE)), 6)"


_COS = "list_cosine_similarity(list_transform({0}, lambda x: x::DOUBLE), list_transform({1}, lambda x: x::DOUBLE))"
_Q = "q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = 0)"
_CORPUS = f"""{_Q}, corpus AS (
  SELECT doc_id AS document_id, 0 AS chunk_index, text AS content, lang AS category, source AS source_url, embedding,
    {_TOKENS.format("text")} AS toks, qv
  FROM documents LEFT JOIN embeddings ON doc_id = vec_id, q)"""
_CHUNKS = f"chunks AS (SELECT conv_id AS document_id, turn AS chunk_index, text AS content, role AS category, concat('conv/', conv_id) AS source_url, {_TOKENS.format('text')} AS toks FROM conversations)"
_ALL_HITS = " AND ".join(f"list_contains(toks, '{w}')" for w in HIT_TERMS)
_HITS = f"""{_CHUNKS}, hits AS (
  SELECT *, row_number() OVER (ORDER BY score DESC, document_id, chunk_index) AS pos FROM (
    SELECT document_id, chunk_index, {_lex("toks", HIT_TERMS)} AS score FROM chunks WHERE {_ALL_HITS}
    ORDER BY score DESC, document_id, chunk_index LIMIT {K}))"""
_LOGS = """logs AS (
  SELECT event_id AS id, concat_ws(' ', 'query', event_type, coalesce(json_extract_string(props, '$.k')::INTEGER::VARCHAR, 'none')) AS query_text,
    CASE WHEN user_id % 3 = 0 THEN 'id' ELSE 'en' END AS detected_language, event_type AS detected_domain,
    coalesce(json_extract_string(props, '$.k')::INTEGER % 10, 0)::INTEGER AS num_results, value AS search_time_ms, user_id, ts AS created_at
  FROM events)"""


ORACLES_CLASSIFY = "SELECT item_id, CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower(text), {m!r})' for m in marks)} THEN '{name}'" for name, marks in text.QUERY_CLASSES) + " ELSE 'General' END AS k FROM benchmark"

# Search ------------------------------------------------------------------------------


@query(f"WITH {_Q} SELECT vec_id AS document_id, 0 AS chunk_index, round({_COS.format('embedding', 'qv')}, 6) AS score FROM embeddings, q ORDER BY score DESC, document_id LIMIT {K}")
def vector_topk(spark, sf_dir):
    own = tables.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("document_id"), F.lit(0).alias("chunk_index"), "embedding")
    return search.vector_topk(own, _probe(spark, sf_dir), K)


@query(f"WITH {_Q} SELECT vec_id AS document_id, 0 AS chunk_index, round({_COS.format('embedding', 'qv')}, 6) AS score FROM embeddings, q WHERE label = 3 ORDER BY score DESC, document_id LIMIT {K}")
def vector_topk_category(spark, sf_dir):
    own = tables.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("document_id"), F.lit(0).alias("chunk_index"), "embedding", F.col("label").alias("category"))
    return search.vector_topk(own, _probe(spark, sf_dir), K, category=3)


@query(f"WITH {_CORPUS} SELECT document_id, chunk_index, {_lex('toks', TERMS)} AS score FROM corpus WHERE {' AND '.join(f'list_contains(toks, {w!r})' for w in TERMS)} ORDER BY score DESC, document_id LIMIT {K}")
def fulltext_topk(spark, sf_dir):
    return search.fulltext_topk(tables.corpus(spark, sf_dir, vectors=False), TERMS, K)


_HYBRID = f"SELECT document_id, chunk_index, round(0.7 * coalesce({_COS.format('embedding', 'qv')}, 0) + 0.3 * {_lex('toks', TERMS)}, 6) AS score FROM corpus ORDER BY score DESC, document_id LIMIT {K}"


@query(f"WITH {_CORPUS} {_HYBRID}")
def hybrid_topk(spark, sf_dir):
    return search.hybrid_topk(tables.corpus(spark, sf_dir), _probe(spark, sf_dir), TERMS, K)


_RRF = f"""sem AS (SELECT *, row_number() OVER (ORDER BY score DESC, document_id) AS rk FROM (
  SELECT document_id, round({_COS.format('embedding', 'qv')}, 6) AS score FROM corpus WHERE embedding IS NOT NULL) QUALIFY rk <= 30),
lex AS (SELECT *, row_number() OVER (ORDER BY score DESC, document_id) AS rk FROM (SELECT document_id, {_lex('toks', TERMS)} AS score FROM corpus) QUALIFY rk <= 30)"""


@query(f"WITH {_CORPUS}, {_RRF} SELECT document_id, 0 AS chunk_index, round(sum(1.0::DOUBLE / (60 + rk)), 6) AS score FROM (SELECT * FROM sem UNION ALL SELECT * FROM lex) GROUP BY document_id ORDER BY score DESC, document_id LIMIT {K}")
def rrf_topk(spark, sf_dir):
    return search.rrf_topk(tables.corpus(spark, sf_dir), _probe(spark, sf_dir), TERMS, K)


_SEMANTIC = f"SELECT document_id, 0 AS chunk_index, round({_COS.format('embedding', 'qv')}, 6) AS score FROM corpus WHERE embedding IS NOT NULL ORDER BY score DESC, document_id LIMIT {K}"
_KEYWORD = f"SELECT document_id, chunk_index, {_lex('toks', TERMS)} AS score FROM corpus WHERE {' AND '.join(f'list_contains(toks, {w!r})' for w in TERMS)} ORDER BY score DESC, document_id LIMIT {K}"
_FUSED = f"SELECT document_id, 0 AS chunk_index, round(sum(1.0::DOUBLE / (60 + rk)), 6) AS score FROM (SELECT * FROM sem UNION ALL SELECT * FROM lex) GROUP BY document_id ORDER BY score DESC, document_id LIMIT {K}"


@query(f"WITH {_CORPUS}, {_RRF} " + " UNION ALL ".join(f"SELECT '{mode}' AS mode, * FROM ({sql})" for mode, sql in (("semantic", _SEMANTIC), ("keyword", _KEYWORD), ("hybrid", _HYBRID), ("anything", _FUSED), ("hybrid without a vector", _KEYWORD))))
def search_modes(spark, sf_dir):
    """Every mode of search by its name, and hybrid search that falls back to words where no vector can be had."""
    corpus, probe, out = tables.corpus(spark, sf_dir), _probe(spark, sf_dir), None
    for mode in ("semantic", "keyword", "hybrid", "anything", "hybrid without a vector"):
        name, *without = mode.split(" ")
        hits = search.search(corpus, name, K, TERMS, None if without else probe).withColumn("mode", F.lit(mode))
        out = hits if out is None else out.unionByName(hits)
    return out


@query(
    f"""WITH {_HITS}, one AS (SELECT document_id FROM hits WHERE pos = 1), h AS (SELECT * FROM hits WHERE document_id IN (FROM one)),
d AS (SELECT document_id FROM h GROUP BY 1 HAVING count(*) >= 2 OR max(chunk_index) > 0),
u AS (SELECT document_id, chunk_index, 1.0::DOUBLE AS score, 0 AS part, 0 AS place FROM chunks WHERE document_id IN (FROM d) UNION ALL SELECT document_id, chunk_index, score, 1, pos FROM h WHERE document_id NOT IN (FROM d))
SELECT document_id, chunk_index, score, row_number() OVER (ORDER BY part, place, document_id, chunk_index)::INTEGER AS pos FROM u"""
)
def expand_comparison_of_one(spark, sf_dir):
    """A comparison whose hits are all of one document is expanded like any other query."""
    hits = _hits(spark, sf_dir)
    return search.expand_comparison(tables.chunks(spark, sf_dir), hits.join(hits.where("pos = 1").select("document_id"), "document_id", "left_semi"))


@query(f"WITH {_CORPUS}, r AS (SELECT document_id, score, category AS title, row_number() OVER (ORDER BY score DESC, document_id) AS pos FROM ({_HYBRID}) h JOIN corpus USING (document_id, chunk_index)) SELECT document_id, score, '' AS source_url, title, pos::INTEGER AS pos FROM r QUALIFY row_number() OVER (PARTITION BY title ORDER BY pos) = 1 ORDER BY pos LIMIT 6")
def filter_sources_by_title(spark, sf_dir):
    """Sources without a URL are told apart by their title; a list keeps what a steep drop would cut."""
    hits = search.positioned(search.hybrid_topk(tables.corpus(spark, sf_dir), _probe(spark, sf_dir), TERMS, K))
    rows = hits.join(tables.corpus(spark, sf_dir, vectors=False).select("document_id", F.lit("").alias("source_url"), F.col("category").alias("title")), "document_id")
    return search.filter_sources(rows.select("document_id", "score", "source_url", "title", "pos"), "List", 0.0)


def _hits(spark, sf_dir):
    return search.positioned(search.fulltext_topk(tables.chunks(spark, sf_dir), HIT_TERMS, K))


@query(f"WITH {_HITS} SELECT document_id, chunk_index, 1.0::DOUBLE AS score, row_number() OVER (ORDER BY chunk_index, document_id)::INTEGER AS pos FROM chunks WHERE document_id IN (SELECT document_id FROM hits)")
def expand_list(spark, sf_dir):
    return search.expand_list(tables.chunks(spark, sf_dir), _hits(spark, sf_dir))


@query(f"WITH {_HITS}, two AS (SELECT document_id FROM hits GROUP BY 1 ORDER BY min(pos) LIMIT 2) SELECT document_id, chunk_index, 1.0::DOUBLE AS score, row_number() OVER (ORDER BY document_id, chunk_index)::INTEGER AS pos FROM chunks WHERE document_id IN (FROM two)")
def expand_comparison(spark, sf_dir):
    return search.expand_comparison(tables.chunks(spark, sf_dir), _hits(spark, sf_dir))


@query(
    f"""WITH {_HITS}, d AS (SELECT document_id FROM hits GROUP BY 1 HAVING count(*) >= 2 OR max(chunk_index) > 0),
u AS (SELECT document_id, chunk_index, 1.0::DOUBLE AS score, 0 AS part, 0 AS place FROM chunks WHERE document_id IN (FROM d)
  UNION ALL SELECT document_id, chunk_index, score, 1, pos FROM hits WHERE document_id NOT IN (FROM d))
SELECT document_id, chunk_index, score, row_number() OVER (ORDER BY part, place, document_id, chunk_index)::INTEGER AS pos FROM u"""
)
def expand_smart(spark, sf_dir):
    return search.expand_smart(tables.chunks(spark, sf_dir), _hits(spark, sf_dir))


_FILTERED = f"""ranked AS (SELECT h.*, source_url, row_number() OVER (ORDER BY score DESC, h.document_id) AS pos FROM ({_HYBRID}) h JOIN corpus USING (document_id)),
above AS (SELECT *, lag(score) OVER (ORDER BY pos) AS prev FROM ranked WHERE score >= {{0}}),
cut AS (SELECT min(pos) AS c FROM above WHERE prev > 0 AND (prev - score) / prev > 0.25),
kept AS (SELECT document_id, score, source_url, pos FROM above, cut WHERE c IS NULL OR pos < c
  UNION ALL SELECT document_id, score, source_url, pos FROM ranked WHERE pos = 1 AND NOT EXISTS (FROM above)),
one AS (SELECT *, row_number() OVER (PARTITION BY source_url ORDER BY pos) AS n FROM kept)
SELECT document_id, score, source_url, pos::INTEGER AS pos FROM one WHERE n = 1 ORDER BY pos LIMIT 6"""


def _filtered(spark, sf_dir, floor):
    corpus = tables.corpus(spark, sf_dir)
    hits = search.positioned(search.hybrid_topk(corpus, _probe(spark, sf_dir), TERMS, K))
    ranked = hits.join(tables.corpus(spark, sf_dir, vectors=False).select("document_id", "source_url"), "document_id").select("document_id", "score", "source_url", "pos")
    return search.filter_sources(ranked, "General", floor)


@query(f"WITH {_CORPUS}, {_FILTERED.format('0.1')}")
def filter_sources(spark, sf_dir):
    return _filtered(spark, sf_dir, 0.1)


@query(f"WITH {_CORPUS}, {_FILTERED.format('2')}")
def filter_sources_none_pass(spark, sf_dir):
    return _filtered(spark, sf_dir, 2.0)


@query(
    f"""WITH {_CORPUS}, ranked AS (SELECT h.*, source_url, category, row_number() OVER (ORDER BY score DESC, h.document_id) AS pos FROM ({_HYBRID}) h JOIN corpus USING (document_id)),
above AS (SELECT *, lag(score) OVER (ORDER BY pos) AS prev FROM ranked WHERE score >= 0.1),
cut AS (SELECT min(pos) AS c FROM above WHERE prev > 0 AND (prev - score) / prev > 0.25),
kept AS (SELECT * EXCLUDE (prev, c) FROM above, cut WHERE c IS NULL OR pos < c UNION ALL SELECT * FROM ranked WHERE pos = 1 AND NOT EXISTS (FROM above))
SELECT document_id, chunk_index, score, pos::INTEGER AS pos, source_url, category FROM kept QUALIFY row_number() OVER (PARTITION BY source_url ORDER BY pos) = 1 ORDER BY pos LIMIT 6"""
)
def ask_hybrid(spark, sf_dir):
    return flagship(spark, sf_dir)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search, smart expansion and source filter in one plan."""
    return search.ask(tables.corpus(spark, sf_dir), "the that with", "hybrid", K, vector=_probe(spark, sf_dir), min_score=0.1)


@query(
    f"""WITH {_HITS}, r AS (SELECT h.pos, c.* FROM hits h JOIN chunks c USING (document_id, chunk_index))
SELECT string_agg(concat('[', pos, '] ', 'Conversation ', document_id, ' (hal. ', chunk_index, ')', chr(10), 'Kategori: ', category, ' / —', chr(10), 'Sumber: ', source_url, chr(10), chr(10), content), concat(chr(10), chr(10), '---', chr(10), chr(10)) ORDER BY pos) AS context FROM r"""
)
def context(spark, sf_dir):
    rows = _hits(spark, sf_dir).join(tables.chunks(spark, sf_dir), ["document_id", "chunk_index"])
    rows = rows.withColumns({"title": F.concat(F.lit("Conversation "), "document_id"), "page_number": F.col("chunk_index"), "subcategory": F.lit("—")})
    return search.context(rows)


@query("SELECT list_sort(list(DISTINCT lang)) AS categories, count(DISTINCT lang) >= 3 AS diverse FROM documents")
def category_diversity(spark, sf_dir):
    return search.diverse_categories(tables.corpus(spark, sf_dir, vectors=False).select("category"))


@query("SELECT item_id, k AS kind, CASE k " + " ".join(f"WHEN '{k}' THEN '{h}'" for k, h in prompts.FORMAT_HINTS.items() if h) + f" ELSE '' END AS hint FROM ({ORACLES_CLASSIFY})")
def format_hints(spark, sf_dir):
    kind = prompts.classify(F.col("text"))
    return tables.read(spark, sf_dir, "benchmark").select("item_id", kind.alias("kind")).withColumn("hint", prompts.format_hint(F.col("kind")))


@query("SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'List' WHEN 1 THEN 'Comparison' WHEN 2 THEN 'General' ELSE k END AS kind FROM (" + ORACLES_CLASSIFY.replace("SELECT item_id,", "SELECT item_id, text,") + ")")
def classify_with_model(spark, sf_dir):
    """A model's answers, exact, longer than asked for, unknown or missing; without one the words decide."""
    answer = F.element_at(F.array(F.lit("list"), F.lit(" Comparison of two\n"), F.lit("no idea"), F.lit(None).cast("string")), (F.col("item_id") % 4 + 1).cast("int"))
    return tables.read(spark, sf_dir, "benchmark").select("item_id", F.coalesce(prompts.answered_class(answer), text.classify_query(F.col("text"))).alias("kind"))


@query("SELECT conv_id, turn, text AS query, 'hybrid' AS search_mode, turn::INTEGER AS top_k, NULL::VARCHAR AS category_filter FROM conversations")
def ask_requests(spark, sf_dir):
    """Questions as JSON bodies and back."""
    turns = tables.read(spark, sf_dir, "conversations")
    body = F.to_json(F.struct(F.col("text").alias("query"), F.lit("hybrid").alias("search_mode"), F.col("turn").alias("top_k")))
    return turns.select("conv_id", "turn", prompts.request(body, prompts.ASK_BODY).alias("r")).select("conv_id", "turn", "r.query", "r.search_mode", "r.top_k", "r.category_filter")


# Usage statistics ----------------------------------------------------------------------


@query(f"WITH {_LOGS} SELECT count(*) AS total, count(DISTINCT query_text) AS distinct_queries, round(coalesce(avg(num_results), 0), 6) AS avg_results, round(coalesce(avg(search_time_ms), 0), 6) AS avg_time_ms, count(*) FILTER (num_results = 0) AS zero_results FROM logs")
def log_summary(spark, sf_dir):
    return analytics.summary(tables.query_logs(spark, sf_dir))


@query(f"WITH {_LOGS} SELECT detected_language, count(*) AS n FROM logs GROUP BY 1")
def log_by_language(spark, sf_dir):
    return analytics.counts_by(tables.query_logs(spark, sf_dir), "detected_language")


@query(f"WITH {_LOGS} SELECT detected_domain, count(*) AS n FROM logs GROUP BY 1")
def log_by_domain(spark, sf_dir):
    return analytics.counts_by(tables.query_logs(spark, sf_dir), "detected_domain")


_PER_DAY = f"WITH {_LOGS} SELECT created_at::DATE AS day, count(*) AS n FROM logs WHERE created_at >= TIMESTAMP '2024-01-31' - INTERVAL 30 DAYS GROUP BY 1"


@query(_PER_DAY)
def log_per_day(spark, sf_dir):
    return analytics.per_day(tables.query_logs(spark, sf_dir), AS_OF)


@query(f"SELECT day, n, round(least(100.0::DOUBLE, n * 100.0::DOUBLE / max(n) OVER ()), 6) AS width FROM ({_PER_DAY} ORDER BY day DESC LIMIT 30)")
def log_bars(spark, sf_dir):
    return analytics.bars(analytics.per_day(tables.query_logs(spark, sf_dir), AS_OF))


@query(f"WITH {_LOGS} SELECT query_text, count(*) AS n FROM logs GROUP BY 1 ORDER BY n DESC, query_text LIMIT 20")
def log_top_queries(spark, sf_dir):
    return analytics.top_queries(tables.query_logs(spark, sf_dir))


@query(f"WITH {_LOGS} SELECT id, query_text, detected_domain, num_results, created_at FROM logs ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 100")
def log_page(spark, sf_dir):
    logs = tables.query_logs(spark, sf_dir).select("id", "query_text", "detected_domain", "num_results", "created_at")
    return analytics.page(logs, [F.desc("created_at"), F.desc("id")], 50, 100)


@query(f"WITH {_LOGS} SELECT ceil(count(*) / 50.0)::BIGINT AS pages, count(*) AS total FROM logs")
def log_pages(spark, sf_dir):
    return tables.query_logs(spark, sf_dir).agg(F.ceil(F.count("*") / 50).alias("pages"), F.count("*").alias("total"))


@query(f"WITH {_LOGS} SELECT query_text, count(*) AS n, max(created_at) AS last_asked FROM logs WHERE length(query_text) BETWEEN 15 AND 200 GROUP BY 1 ORDER BY n DESC, last_asked DESC, query_text LIMIT 30")
def faq_top(spark, sf_dir):
    return analytics.faq_top(tables.query_logs(spark, sf_dir))


def _pins(spark, sf_dir):
    asked = analytics.faq_top(tables.query_logs(spark, sf_dir), 3)
    return asked.select(F.col("query_text").alias("question"), F.row_number().over(Window.orderBy("query_text")).alias("sort_order"))


_PINS = """asked AS (SELECT query_text, count(*) AS n, max(created_at) AS last FROM logs WHERE length(query_text) BETWEEN 15 AND 200 GROUP BY 1),
pins AS (SELECT query_text AS question, row_number() OVER (ORDER BY query_text) AS sort_order FROM (FROM asked ORDER BY n DESC, last DESC, query_text LIMIT 3))"""


@query(
    f"""WITH {_LOGS}, {_PINS}, autos AS (SELECT query_text AS question, false AS pinned, row_number() OVER (ORDER BY n DESC, last DESC, query_text) AS place FROM asked WHERE query_text NOT IN (SELECT question FROM pins)),
u AS (SELECT question, true AS pinned, sort_order AS place FROM pins UNION ALL FROM autos)
SELECT question, pinned, row_number() OVER (ORDER BY pinned DESC, place, question)::INTEGER AS pos FROM u QUALIFY pos <= 8"""
)
def faq_public(spark, sf_dir):
    return analytics.faq_public(tables.query_logs(spark, sf_dir), _pins(spark, sf_dir))


@query(f"WITH {_LOGS}, {_PINS} SELECT question, sort_order::INTEGER AS sort_order FROM pins UNION ALL SELECT 'a new question', (max(sort_order) + 1)::INTEGER FROM pins")
def faq_pin(spark, sf_dir):
    return ingest.pin(_pins(spark, sf_dir), "a new question").select("question", "sort_order")


@query("SELECT source AS document_id, min(lang) AS category, min(source) AS source_url, count(*) AS chunks FROM documents GROUP BY 1")
def document_listing(spark, sf_dir):
    docs = tables.corpus(spark, sf_dir, vectors=False).select(F.col("source_url").alias("document_id"), "category", "source_url")
    return analytics.document_listing(docs)


@query("SELECT DISTINCT lang AS category FROM documents")
def categories(spark, sf_dir):
    return analytics.categories(tables.corpus(spark, sf_dir, vectors=False).select("category"))


@query("SELECT lang AS category, count(*) AS chunks, count(DISTINCT doc_id) AS documents FROM documents GROUP BY 1")
def ingest_stats(spark, sf_dir):
    return analytics.ingest_stats(tables.corpus(spark, sf_dir, vectors=False).select("category", "document_id"))


@query("SELECT o_orderkey AS id, o_custkey AS user_id, o_orderdate AS updated_at, coalesce(c_name, '(deleted)') AS user_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey ORDER BY updated_at DESC NULLS LAST, id LIMIT 200")
def sessions_with_user(spark, sf_dir):
    sessions = tables.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("updated_at"))
    users = tables.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("user_name"))
    return analytics.sessions_with_user(sessions, users)


@query("SELECT o_custkey AS user_id, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey)::INTEGER AS rank FROM orders QUALIFY rank <= 50")
def latest_sessions_per_user(spark, sf_dir):
    sessions = tables.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("updated_at"))
    return analytics.latest_per_user(sessions).select("user_id", "id", "rank")


@query("SELECT conv_id AS id, count(*)::INTEGER AS message_count FROM conversations GROUP BY 1")
def session_counts(spark, sf_dir):
    folded = tables.folded_sessions(spark, sf_dir)
    return analytics.message_counts(folded.select("id", F.to_json("messages").alias("messages")))


@query("SELECT conv_id AS id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6")
def history_window(spark, sf_dir):
    turns = tables.read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("messages"))
    return analytics.last_messages(turns).select("id", F.explode("messages").alias("m")).select("id", "m.turn", "m.role")


@query("SELECT c_custkey AS id, c_name AS user_name FROM customer WHERE contains(lower(c_name), '0012') OR contains(concat('u', c_custkey, '@example.com'), '0012') OR contains(concat('u', c_custkey, '@example.com'), 'u12')")
def find_users(spark, sf_dir):
    """By a part of the name and by a part of the address."""
    users = tables.users(spark, sf_dir).withColumnRenamed("display_name", "user_name")
    return analytics.find_users(users, "0012").unionByName(analytics.find_users(users, "U12")).select("id", "user_name").distinct()


# Text and pages ---------------------------------------------------------------------------


def _rules_sql() -> tuple[str, str]:
    cases = [(f"contains(u, '{site}') AND regexp_matches(u, '{p}')", c, s) for site, rules in urls.SITE_RULES.items() for p, c, s in rules]
    cases += [(f"regexp_matches(u, '{p}')", c, s) for p, c, s in urls.GENERAL_RULES]
    return tuple("CASE " + " ".join(f"WHEN {test} THEN '{r[i]}'" for test, *r in cases) + f" ELSE '{default}' END" for i, default in ((0, "informasi"), (1, "umum")))


@query("SELECT page_id, {} AS category, {} AS subcategory FROM (SELECT page_id, lower(url) AS u FROM pages)".format(*_rules_sql()))
def auto_category(spark, sf_dir):
    return tables.read(spark, sf_dir, "pages").select("page_id", urls.auto_category(F.col("url")).alias("c")).select("page_id", "c.category", "c.subcategory")


@query(
    rf"""SELECT page_id, CASE WHEN d = '' THEN 'index' ELSE d END AS document_id FROM (
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(url, '{BASE}', ''), '^/+|/+$', '', 'g'), '\.(html|qmd)$', ''), '[^\p{{L}}\p{{N}}_/\-]', '_', 'g'), '^[_/]+|[_/]+$', '', 'g') AS d FROM pages)"""
)
def doc_id_from_url(spark, sf_dir):
    return tables.read(spark, sf_dir, "pages").select("page_id", urls.document_id(F.col("url"), BASE).alias("document_id"))


_STRIP = "html"
for _tag in html.BOILERPLATE:
    _STRIP = f"regexp_replace({_STRIP}, '(?is)<{_tag}.*?</{_tag}>', '', 'g')"


def _decode(x: str) -> str:
    for name, char in (("quot", '"'), ("lt", "<"), ("gt", ">"), ("#39", "''"), ("nbsp", "\xa0"), ("copy", "\xa9"), ("middot", "\xb7"), ("amp", "&")):
        x = f"replace({x}, '&{name};', '{char}')"
    return x


def _body_lines(page: str) -> str:
    body = f"regexp_extract({page}, '(?is)<body(?:[ />][^>]*)?>?(.*)$', 1)"
    plain = f"regexp_replace(regexp_replace({body}, '(?s)<!--.*?(-->|$)', chr(10), 'g'), '(?s)<[a-zA-Z/!?][^>]*(>|$)', chr(10), 'g')"
    return f"list_filter(list_transform(string_split({_decode(plain)}, chr(10)), lambda x: {_trim('x')}), lambda x: x <> '')"


@query(f"SELECT page_id, array_to_string({_body_lines(_STRIP)}, chr(10)) AS text FROM pages")
def html_text(spark, sf_dir):
    return tables.read(spark, sf_dir, "pages").select("page_id", html.page_text(F.col("html")).alias("text"))


_TABLE = "<table><tr><th> No </th><th>Kind</th><th></th></tr><tr><td>#</td><td>page</td><td> </td></tr></table>"
_JSON = '<script type="application/json">{"columns": [{"title": "A"}, {"data": "B"}], "data": [["<i>x</i>", 1], [null, true], []]}</script>'


@query(
    f"""SELECT * FROM (SELECT page_id, array_to_string(list_concat(t, ['No | Kind', page_id || ' | page', 'A: x | B: 1', 'true']), chr(10)) AS text
FROM (SELECT page_id, {_body_lines(_STRIP.replace('html', "replace(html, '<body>', '<body>' || replace($t$" + _TABLE + "$t$, '#', page_id::VARCHAR))", 1))} AS t FROM pages))
WHERE strlen(text) >= 50"""
)
def page_ingest_text(spark, sf_dir):
    """Pages with a table and a JSON table put in: their rows follow the text; pages with too little text are left out."""
    pages = tables.read(spark, sf_dir, "pages")
    table = F.concat(F.lit("<body>"), F.replace(F.lit(_TABLE), F.lit("#"), F.col("page_id").cast("string")), F.lit(_JSON))
    whole = pages.select("page_id", html.page_text(F.replace("html", F.lit("<body>"), table), tables=True).alias("text"))
    return whole.where(html.long_enough(F.col("text")))


@query(f"SELECT page_id, coalesce(nullif({_trim(_decode("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))}, ''), url) AS title FROM pages")
def html_title(spark, sf_dir):
    return tables.read(spark, sf_dir, "pages").select("page_id", html.page_title(F.col("html"), F.col("url")).alias("title"))


@query(f"SELECT page_id, array_to_string(list_transform(regexp_split_to_array(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>'), lambda x: {_trim(_decode('x'), _WS_PY)}), '') AS title FROM pages")
def site_title(spark, sf_dir):
    return tables.read(spark, sf_dir, "pages").select("page_id", html.site_title()("html", "url").alias("title"))


@query(r"SELECT page_id, nullif(regexp_replace(list_last(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*/*([^?#]*?)/*([?#].*)?$', 1), '/')), '[^a-zA-Z0-9_-]', '_', 'g'), '') AS site_id FROM pages")
def site_id(spark, sf_dir):
    return tables.read(spark, sf_dir, "pages").select("page_id", urls.site_id(F.col("url")).alias("site_id"))


@query(
    "SELECT page_id, "
    + " OR ".join([*(f"contains(html, '{m}')" for m in html.SCRIPTED), *(f"contains(lower(html), '{m}')" for m in html.SCRIPTED_ANY_CASE)])
    + f" OR (b <> '' AND strlen({_trim('b')}) < 300) AS needs_script FROM (SELECT *, regexp_extract(html, '(?is)(<tbody.*?)</tbody>', 1) AS b FROM pages)"
)
def needs_script(spark, sf_dir):
    return tables.read(spark, sf_dir, "pages").select("page_id", html.needs_script(F.col("html")).alias("needs_script"))


@query()
def site_markdown(spark, sf_dir):
    return tables.read(spark, sf_dir, "pages").select("page_id", html.python_column(html.site_markdown_text)("html").alias("markdown"))


_LINKS = r"""SELECT url, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*href\s*=\s*["'']([^"'']*)["'']', 1)) AS href FROM pages"""


@query(_LINKS)
def page_links(spark, sf_dir):
    return readers.links(tables.read(spark, sf_dir, "pages").select("url", "html"))


@query(
    rf"""WITH l AS (SELECT DISTINCT href FROM ({_LINKS})),
v AS (SELECT href FROM l WHERE regexp_extract(href, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1) IN ('', 'example.com')
  AND NOT regexp_matches(lower(regexp_replace(regexp_replace(href, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*', ''), '[?#].*$', '')), '({"|".join(e.replace(".", "[.]") for e in urls.SKIPPED_ENDINGS)})$')),
f AS (SELECT CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN href WHEN href LIKE '/%' THEN '{BASE}' || href ELSE '{BASE}/' || regexp_replace(href, '^\./', '') END AS u FROM v),
n AS (SELECT DISTINCT regexp_replace(regexp_replace(u, '[#?].*$', ''), '/+$', '') AS url FROM f)
SELECT url FROM n WHERE starts_with(url, '{BASE}') AND url NOT IN (SELECT url FROM pages)"""
)
def crawl_frontier(spark, sf_dir):
    pages = tables.read(spark, sf_dir, "pages").select("url", "html")
    return readers.next_frontier(readers.links(pages), pages, BASE)


@query(
    rf"""WITH l AS (SELECT doc_id, string_split(regexp_replace(text, '\r\n|[\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]', chr(10), 'g'), chr(10)) AS ls FROM documents),
o AS (SELECT doc_id, ls, list_transform(ls, lambda x: {_trim('x', _WS_PY)}) AS ts FROM l),
r AS (SELECT doc_id, list(t) AS often FROM (SELECT doc_id, unnest(ts) AS t FROM o) WHERE length(t) BETWEEN 1 AND 59 GROUP BY doc_id, t HAVING count(*) >= 3),
f AS (SELECT doc_id, flatten(list(often)) AS often FROM r GROUP BY 1),
k AS (SELECT o.doc_id, array_to_string(CASE WHEN often IS NULL THEN ls ELSE list_filter(ls, lambda x, i: NOT list_contains(often, ts[i])) END, chr(10)) AS t FROM o LEFT JOIN f USING (doc_id))
SELECT doc_id, {_trim(r"regexp_replace(regexp_replace(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{200b}\x{200c}\x{200d}\x{feff}]', '', 'g'), '([\p{L}\p{N}_])-\n([\p{L}\p{N}_])', '\1\2', 'g')", _WS_PY)} AS cleaned FROM k"""
)
def clean_markdown(spark, sf_dir):
    return tables.read(spark, sf_dir, "documents").select("doc_id", text.clean_markdown(F.col("text")).alias("cleaned"))


@query("SELECT item_id, CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower(text), {m!r})' for m in marks)} THEN '{name}'" for name, marks in text.QUERY_CLASSES) + " ELSE 'General' END AS kind FROM benchmark")
def classify_query(spark, sf_dir):
    return tables.read(spark, sf_dir, "benchmark").select("item_id", text.classify_query(F.col("text")).alias("kind"))


@query(
    r"""WITH l AS (SELECT doc_id, string_split(regexp_replace(text, '\r?\n$', ''), chr(10)) AS ls FROM documents),
n AS (SELECT doc_id, greatest(len(ls), 1) AS total, len(list_filter(ls, lambda x: regexp_matches({T}, '^[0-9][.)]'))) AS numbered,
  len(list_filter(ls, lambda x: contains(x, '|'))) AS piped, len(list_filter(ls, lambda x: strlen({T}) < 80 AND contains(x, ':'))) AS labels FROM l)
SELECT doc_id, CASE WHEN numbered > total // 5 OR piped > total // 4 OR labels > total // 3 THEN 'structural' ELSE 'sentence' END AS strategy FROM n""".replace("{T}", _trim("x"))
)
def detect_strategy(spark, sf_dir):
    return tables.read(spark, sf_dir, "documents").select("doc_id", text.detect_strategy(F.col("text")).alias("strategy"))


@query("SELECT doc_id, CASE WHEN " + " OR ".join(f"contains(substr(t, 1, 200), '{m}')" for m in text.SCRIPT_MARKS) + f" THEN '' ELSE t END AS snippet FROM (SELECT doc_id, {_trim('text')} AS t FROM documents)")
def clean_snippet(spark, sf_dir):
    return tables.read(spark, sf_dir, "documents").select("doc_id", text.clean_snippet(F.col("text")).alias("snippet"))


_HITS_IN_WINDOW = " + ".join(f"least(3, (length(t) - length(replace(t, '{w}', ''))) // {len(w)})" for w in TERMS)


@query(
    rf"""WITH d AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '{_WS}+'), lambda x: x <> '') AS ws FROM documents WHERE length(text) > 400),
w AS (SELECT doc_id, ws, unnest(range(0, len(ws) - 59, 20)) AS s FROM d WHERE len(ws) > 60),
n AS (SELECT doc_id, ws, s, {_HITS_IN_WINDOW} AS n FROM (SELECT *, lower(array_to_string(ws[s + 1:s + 60], ' ')) AS t FROM w)),
b AS (SELECT doc_id, array_to_string(ws[s + 1:s + 80], ' ') AS best FROM n QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, s) = 1)
SELECT doc_id, {_truncated('t')} AS snippet FROM (SELECT doc_id, coalesce(best, text) AS t FROM documents LEFT JOIN b USING (doc_id))"""
)
def snippet(spark, sf_dir):
    return tables.read(spark, sf_dir, "documents").select("doc_id", text.snippet(F.col("text"), TERMS).alias("snippet"))


@query(f"SELECT doc_id, {_truncated('text')} AS short FROM documents")
def truncate_at_sentence(spark, sf_dir):
    return tables.read(spark, sf_dir, "documents").select("doc_id", text.truncate_at_sentence(F.col("text"), 400).alias("short"))


@query(r"SELECT doc_id, regexp_replace('1.' || doc_id || lang, '([0-9.])(\p{L})', '\1 \2', 'g') AS title FROM documents")
def source_title(spark, sf_dir):
    return tables.read(spark, sf_dir, "documents").select("doc_id", text.clean_source_title(F.col("source"), F.concat(F.lit("1."), "doc_id", "lang")).alias("title"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(text, '([\p{L}\p{N}_])-\s*\n\s*([\p{L}\p{N}_])', '\1\2', 'g'), '([a-zàáâãäå])\n([a-zàáâãäå])', '\1 \2', 'g') AS repaired FROM documents")
def repair_sentences(spark, sf_dir):
    return tables.read(spark, sf_dir, "documents").select("doc_id", enrich.repair_sentences(F.col("text")).alias("repaired"))


@query("SELECT doc_id, concat('passage: [', lang, ' > ', source, ']', chr(10), chr(10), text) AS passage FROM documents")
def passage(spark, sf_dir):
    return tables.read(spark, sf_dir, "documents").select("doc_id", enrich.passage(F.col("text"), F.col("lang"), F.lit(None).cast("string"), F.col("source")).alias("passage"))


@query()
def enrich_text(spark, sf_dir):
    return tables.read(spark, sf_dir, "documents").select("doc_id", enrich.enrich_text(F.col("text")).alias("enriched"))


@query("SELECT doc_id, concat('Nomor: ', doc_id, ', Bahasa: ', lang, '.', chr(10), 'Nomor: 2.', chr(10), text) AS prose FROM documents")
def tables_to_prose(spark, sf_dir):
    """Documents with a table in front."""
    table = F.concat(F.lit("| Nomor | Bahasa |\n| --- | --- |\n| "), "doc_id", F.lit(" | "), "lang", F.lit(" |\n  | 2 | - |\n"), "text")
    return tables.read(spark, sf_dir, "documents").select("doc_id", html.python_column(html.tables_to_prose_text)(table).alias("prose"))


def _chunked(spark, sf_dir, strategy, **kw):
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", "text")
    return chunking.explode_chunks(docs, chunking.chunked(F.col("text"), strategy, **kw)).select("doc_id", "chunk_index", "chunk")


# The chunkers as folds over lists.  {most} and {least} are bytes; patterns repeat at most 1000 times.
def _fixed(x: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({x}, '(?s).{{1,600}}.{{0,600}}(?:{_WS}+|$)|.{{600}}.{{600}}'), lambda x: {_trim('x')}), lambda x: x <> '')"


def _fold(units: str, step: str) -> str:
    """A list_reduce over structs: held, the pieces so far, and the unit that comes next."""
    first = "[{'held': '', 'done': []::VARCHAR[], 'unit': ''}]"
    rest = f"list_transform({units}, lambda u: {{'held': '', 'done': []::VARCHAR[], 'unit': u}})"
    return f"list_reduce(list_concat({first}, {rest}), lambda a, b: {step})"


def _merged(units: str) -> str:
    join = "(a.held || CASE WHEN a.held LIKE '%' || chr(10) THEN '' ELSE chr(10) END || b.unit)"
    full = f"(a.held <> '' AND strlen({join}) > 1200 AND strlen(a.held) >= 150)"
    held = f"(CASE WHEN a.held = '' OR {full} THEN b.unit ELSE {join} END)"
    done = f"(CASE WHEN {full} THEN list_append(a.done, a.held) ELSE a.done END)"
    step = f"CASE WHEN strlen({held}) > 1200 THEN {{'held': '', 'done': list_concat({done}, {_fixed(held)}), 'unit': ''}} ELSE {{'held': {held}, 'done': {done}, 'unit': ''}} END"
    end = f"CASE WHEN {_trim('m.held')} = '' THEN m.done WHEN len(m.done) > 0 AND strlen(m.done[-1]) + strlen(m.held) + 1 <= 1200 THEN list_append(m.done[:-2], m.done[-1] || chr(10) || m.held) ELSE list_append(m.done, m.held) END"
    return f"SELECT doc_id, list_filter({end}, lambda x: strlen({_trim('x')}) >= 10) AS pieces FROM (SELECT doc_id, {_fold(units, step)} AS m FROM units)"


_LINES_SQL = "list_transform(string_split(regexp_replace(text, '\\n$', ''), chr(10)), lambda x: regexp_replace(x, '\\r$', ''))"
_PIECE_ENDS = f"((regexp_matches(a.held, '[.!?]$') AND regexp_matches(b.unit, '^[ \\n]')) OR (a.held LIKE '%' || chr(10) AND b.unit LIKE chr(10) || '%')) AND strlen({_trim('a.held')}) > 20"
_SENTENCES = f"""lines AS (SELECT doc_id, text, {_LINES_SQL} AS ls FROM documents),
prose AS (SELECT doc_id, {_fold(r"regexp_extract_all(text, '(?s)[^.!?\n]*[.!?\n]|[^.!?\n]+')", f"CASE WHEN {_PIECE_ENDS} THEN {{'held': CASE WHEN b.unit LIKE chr(10) || '%' AND a.held LIKE '%' || chr(10) THEN b.unit[2:] ELSE b.unit END, 'done': list_append(a.done, {_trim('a.held')}), 'unit': ''}} ELSE {{'held': a.held || b.unit, 'done': a.done, 'unit': ''}} END")} AS m FROM lines
  WHERE NOT (len(ls) > 3 AND list_sum(list_transform(ls, lambda x: strlen(x))) // len(ls) < 150)),
units AS (SELECT doc_id, CASE WHEN {_trim('m.held')} = '' THEN m.done ELSE list_append(m.done, {_trim('m.held')}) END AS us FROM prose
  UNION ALL SELECT doc_id, list_filter(list_transform(ls, lambda x: {_trim('x')}), lambda x: x <> '') FROM lines WHERE len(ls) > 3 AND list_sum(list_transform(ls, lambda x: strlen(x))) // len(ls) < 150)"""
_LETTERS = r"regexp_replace(b.unit, '[^\p{L}]', '', 'g')"
_OPENS = rf"((regexp_matches(b.unit, '^[0-9]') AND regexp_matches(b.unit, '[.)] ')) OR regexp_matches(b.unit, '^(##|---|===)') OR regexp_matches({_LETTERS}, '^\p{{Lu}}{{4,}}$'))"
_BLOCK = f"CASE WHEN b.unit = '' THEN {{'held': a.held || CASE WHEN a.held = '' THEN '' ELSE chr(10) END, 'done': a.done, 'unit': ''}} WHEN {_OPENS} AND strlen({_trim('a.held')}) >= 150 THEN {{'held': b.unit, 'done': list_append(a.done, {_trim('a.held')}), 'unit': ''}} ELSE {{'held': a.held || CASE WHEN a.held = '' THEN '' ELSE chr(10) END || b.unit, 'done': a.done, 'unit': ''}} END"
_BLOCKS = f"""lines AS (SELECT doc_id, text, {_LINES_SQL} AS ls FROM documents),
blocks AS (SELECT doc_id, {_fold(f"list_transform(ls, lambda x: {_trim('x')})", _BLOCK)} AS m FROM lines),
units AS (SELECT doc_id, CASE WHEN {_trim('m.held')} = '' THEN m.done ELSE list_append(m.done, {_trim('m.held')}) END AS us FROM blocks)"""


def _numbered(pieces: str) -> str:
    return f"SELECT doc_id, (unnest(range(len(pieces))))::INTEGER AS chunk_index, unnest(pieces) AS chunk FROM ({pieces})"


@query(f"WITH {_SENTENCES} {_numbered(_merged('us'))}")
def chunk_sentence(spark, sf_dir):
    return _chunked(spark, sf_dir, "sentence")


@query(f"WITH {_BLOCKS} {_numbered(_merged('us'))}")
def chunk_structural(spark, sf_dir):
    return _chunked(spark, sf_dir, "structural")


@query(_numbered(f"SELECT doc_id, CASE WHEN strlen(text) <= 1200 THEN [text] ELSE {_fixed('text')} END AS pieces FROM documents"))
def chunk_fixed(spark, sf_dir):
    return _chunked(spark, sf_dir, "fixed")


@query(f"SELECT c.* FROM ({ORACLES['detect_strategy']}) s JOIN (SELECT 'sentence' AS strategy, * FROM (WITH {_SENTENCES} {_numbered(_merged('us'))}) UNION ALL SELECT 'structural', * FROM (WITH {_BLOCKS} {_numbered(_merged('us'))})) x USING (doc_id, strategy), LATERAL (SELECT x.doc_id, x.chunk_index, x.chunk) c")
def chunk_auto(spark, sf_dir):
    return _chunked(spark, sf_dir, "auto")


@query()
def chunk_semantic(spark, sf_dir):
    return _chunked(spark, sf_dir, "semantic", embed=vectors.HashEmbedder(64).embed, threshold=0.2)


@query()
def chunk_offline(spark, sf_dir):
    embed = vectors.HashEmbedder(64).embed
    pieces = html.python_column(lambda t: [p for p, _ in chunking.offline(t, embed)], "array<string>")
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", "text")
    return chunking.explode_chunks(docs, pieces("text"), min_chars=20).select("doc_id", "chunk_index", "chunk")


@query(
    f"""WITH n AS (SELECT vec_id, label, round({_COS.format('lag(embedding) OVER (PARTITION BY label ORDER BY vec_id)', 'embedding')}, 6) AS near FROM embeddings)
SELECT vec_id, label, sum(CASE WHEN near < 0.1 THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY vec_id ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM n"""
)
def semantic_segments(spark, sf_dir):
    return chunking.semantic_segments(tables.read(spark, sf_dir, "embeddings"), "label", "vec_id", threshold=0.1).select("vec_id", "label", "segment")


# Ingest --------------------------------------------------------------------------------------


def _hashed(spark, sf_dir):
    docs = tables.read(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("document_id"), F.md5("text").alias("file_hash"), F.col("source").alias("title"))


@query("SELECT md5(text) AS file_hash, min(doc_id) AS document_id, count(*) AS copies FROM documents GROUP BY 1")
def dedup_hash(spark, sf_dir):
    return _hashed(spark, sf_dir).groupBy("file_hash").agg(F.min("document_id").alias("document_id"), F.count("*").alias("copies"))


_VERSIONS = """v AS (SELECT doc_id AS document_id, md5(text) AS file_hash, source AS title FROM documents),
old AS (SELECT document_id, CASE WHEN document_id % 7 = 0 THEN md5('stale') ELSE file_hash END AS file_hash, 'old' AS title, 0 AS chunk_index, 'x' AS category FROM v
  UNION ALL SELECT document_id + 1000000000000, file_hash, 'old', 0, 'x' FROM v),
new AS (SELECT *, 0 AS chunk_index, 'y' AS category FROM v UNION ALL SELECT document_id + 2000000000000, file_hash, title, 0, 'y' FROM v)"""


def _versions(spark, sf_dir):
    """All documents in both versions, some changed; and all once more under other ids in either, as gone and as new ones."""
    v = _hashed(spark, sf_dir)
    stale = v.withColumn("file_hash", F.when(F.col("document_id") % 7 == 0, F.md5(F.lit("stale"))).otherwise(F.col("file_hash")))
    old = stale.unionByName(v.withColumn("document_id", F.col("document_id") + 1_000_000_000_000)).withColumns({"title": F.lit("old"), "chunk_index": F.lit(0), "category": F.lit("x")})
    new = v.unionByName(v.withColumn("document_id", F.col("document_id") + 2_000_000_000_000)).withColumns({"chunk_index": F.lit(0), "category": F.lit("y")})
    return old, new


@query(f"WITH {_VERSIONS} SELECT document_id, CASE WHEN old.file_hash IS NULL THEN 'new' WHEN new.file_hash IS NULL THEN 'gone' WHEN old.file_hash = new.file_hash THEN 'same' ELSE 'changed' END AS status FROM old FULL JOIN new USING (document_id)")
def incremental_diff(spark, sf_dir):
    return ingest.diff(*_versions(spark, sf_dir))


@query(f"WITH {_VERSIONS} SELECT new.document_id, new.file_hash FROM new WHERE NOT EXISTS (FROM old WHERE old.document_id = new.document_id AND old.file_hash = new.file_hash)")
def changed_documents(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    return ingest.changed(new, old).select("document_id", "file_hash")


@query(f"WITH {_VERSIONS} SELECT document_id, coalesce(old.file_hash, new.file_hash) AS file_hash, coalesce(new.title, old.title) AS title, coalesce(old.category, new.category) AS category FROM old FULL JOIN new USING (document_id)")
def chunk_upsert(spark, sf_dir):
    return ingest.chunk_upsert(*_versions(spark, sf_dir)).select("document_id", "file_hash", "title", "category")


@query(f"WITH {_VERSIONS} SELECT document_id, file_hash, title FROM old WHERE document_id NOT IN (SELECT document_id FROM new) UNION ALL SELECT document_id, file_hash, title FROM new")
def replace_documents(spark, sf_dir):
    return ingest.replace_documents(*_versions(spark, sf_dir)).select("document_id", "file_hash", "title")


@query("SELECT event_id AS id, ts AS created_at FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAYS")
def retention(spark, sf_dir):
    return ingest.retain(tables.query_logs(spark, sf_dir).select("id", "created_at"), AS_OF, 7)


@query("SELECT concat('guest-', user_id) AS guest_token, (count(*) + 1)::INTEGER AS ask_count FROM events GROUP BY 1")
def guest_counts(spark, sf_dir):
    asks = tables.query_logs(spark, sf_dir).select(F.concat(F.lit("guest-"), "user_id").alias("guest_token"))
    return ingest.guest_counts(asks.distinct().withColumn("ask_count", F.lit(1)), asks)


_CHUNK = "SELECT doc_id AS document_id, 0 AS chunk_index, text AS content, lang AS category FROM documents"


def _chunk_rows(spark, sf_dir):
    return tables.corpus(spark, sf_dir).select("document_id", "chunk_index", "content", "category", "embedding")


@query(f"SELECT * FROM ({_CHUNK}) WHERE document_id <> 3")
def chunk_delete(spark, sf_dir):
    rows = _chunk_rows(spark, sf_dir).drop("embedding")
    return ingest.delete(rows, spark.createDataFrame([(3, 0)], "document_id long, chunk_index int"))


@query(f"SELECT * REPLACE (CASE WHEN document_id = 3 THEN 'new words' ELSE content END AS content) FROM ({_CHUNK})")
def chunk_update(spark, sf_dir):
    return ingest.update_chunk(_chunk_rows(spark, sf_dir).drop("embedding"), 3, 0, "new words")


@query(f"SELECT * REPLACE (CASE WHEN document_id = 3 THEN 'moved' ELSE category END AS category) FROM ({_CHUNK})")
def document_update(spark, sf_dir):
    return ingest.update_documents(_chunk_rows(spark, sf_dir).drop("embedding"), 3, category="moved")


@query("SELECT doc_id AS document_id, embedding IS NOT NULL AS was_there, true AS is_there, 64 AS width FROM documents LEFT JOIN embeddings ON vec_id = doc_id")
def vector_backfill(spark, sf_dir):
    """Vectors for chunks that lack one; the others keep theirs."""
    rows = _chunk_rows(spark, sf_dir).withColumn("was_there", F.col("embedding").isNotNull())
    filled = ingest.backfill_vectors(rows, vectors.HashEmbedder(64).column())
    return filled.select("document_id", "was_there", F.col("embedding").isNotNull().alias("is_there"), F.size("embedding").alias("width"))


@query(f"WITH {_VERSIONS} SELECT document_id, file_hash, title FROM new UNION ALL SELECT document_id, file_hash, title FROM old WHERE document_id NOT IN (SELECT document_id FROM new)")
def bulk_insert(spark, sf_dir):
    """Plain insert of rows whose ids are new."""
    old, new = _versions(spark, sf_dir)
    return ingest.insert_unique(new.select("document_id", "file_hash", "title"), ingest.delete(old, new.select("document_id")).select("document_id", "file_hash", "title"), ["document_id"])


@query("SELECT md5(text) = (SELECT md5(text) FROM documents WHERE doc_id = 3) AS found FROM documents WHERE doc_id = 3 UNION ALL SELECT false")
def hash_exists(spark, sf_dir):
    """Whether a text is known by its hash: one that is, one that is not."""
    docs = _hashed(spark, sf_dir)
    known = tables.read(spark, sf_dir, "documents").where("doc_id = 3").select(F.md5("text")).first()[0]
    return accounts.exists(docs, file_hash=known).unionByName(accounts.exists(docs, file_hash="none"))


@query("SELECT count(*) AS chunks, count(DISTINCT doc_id) AS documents FROM documents")
def ingest_totals(spark, sf_dir):
    return analytics.ingest_totals(tables.corpus(spark, sf_dir, vectors=False).select("document_id"))


@query("SELECT doc_id AS document_id, doc_id || ' (' || lang || ' > ' || source || ')' AS title, i AS chunk_index, 'Document ' || doc_id || ' part ' || i || ' of it' AS content, 'passage: [' || doc_id || ' > ' || lang || ' > ' || source || ']' || chr(10) || chr(10) || 'Document ' || doc_id || ' part ' || i || ' of it' AS embed_text FROM documents, (VALUES (0::INTEGER), (2::INTEGER)) x(i)")
def headed_records(spark, sf_dir):
    """Sections under headings; a short one goes and leaves a gap in the index."""
    docs = tables.read(spark, sf_dir, "documents")
    part = [F.concat(F.lit("Document "), "doc_id", F.lit(f" part {i} of it\n")) for i in (0, 2)]
    content = F.concat(F.lit("# "), "lang", F.lit("\n## "), "source", F.lit("\n"), part[0], F.lit("# short\nx\n# "), "lang", F.lit("\n## "), "source", F.lit("\n"), part[1])
    docs = docs.select(F.col("doc_id").alias("document_id"), content.alias("content"), F.col("source").alias("source_url"))
    return ingest.headed_records(docs, chunking.headed()("content")).select("document_id", "title", "chunk_index", "content", "embed_text")


@query(f"WITH {_LOGS}, {_PINS} SELECT question, sort_order::INTEGER AS sort_order FROM pins WHERE sort_order <> 2")
def faq_unpin(spark, sf_dir):
    return ingest.delete(_pins(spark, sf_dir), spark.createDataFrame([(2,)], "sort_order int"))


@query("SELECT 'u' || c_custkey || '@example.com' AS email, c_name AS user_name, c_mktsegment AS password, 'user' AS role FROM customer")
def user_import(spark, sf_dir):
    lines = tables.read(spark, sf_dir, "customer").select(F.concat(F.lit(" u"), "c_custkey", F.lit("@example.com , "), "c_name", F.lit(","), "c_mktsegment", F.lit(", ")).alias("value"))
    head = spark.createDataFrame([("Email,Name,Password,Role",), ("  ",)], "value string")
    return readers.user_list(head.unionByName(lines))


@query(f"SELECT DISTINCT '{BASE}/' || page_id AS url FROM pages")
def sitemap_urls(spark, sf_dir):
    """A sitemap of sitemaps, one for each page, read level by level."""
    pages = tables.read(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("p"))
    index = F.concat(F.lit("<sitemapindex>"), F.array_join(F.collect_list(F.concat(F.lit(f"<sitemap><loc>{BASE}/map-"), "p", F.lit("</loc></sitemap>"))), ""), F.lit("</sitemapindex>"))
    maps = pages.select(F.concat(F.lit(f"{BASE}/map-"), "p").alias("url"), F.concat(F.lit(f"<urlset><url><loc>{BASE}/"), "p", F.lit(f"/</loc></url><url><loc>{BASE}/x.pdf</loc></url></urlset>")).alias("xml"))
    store = maps.unionByName(pages.agg(index.alias("xml")).select(F.lit(f"{BASE}/sitemap-index.xml").alias("url"), "xml"))
    return readers.all_sitemap_urls(spark, lambda wanted: store.where(F.col("url").isin(wanted)), BASE).select("url")


# Accounts --------------------------------------------------------------------------------------

NOW = datetime(2024, 1, 31)
_USERS = "users AS (SELECT c_custkey AS id, 'u' || c_custkey || '@example.com' AS email, c_name AS display_name, 'user' AS role, c_acctbal >= 0 AS is_active, c_acctbal >= 0 AS email_verified FROM customer)"
_TOKENS = "tokens AS (SELECT o_orderkey AS id, o_custkey AS user_id, md5(o_orderkey::VARCHAR) AS token, o_orderdate + INTERVAL 1 DAY AS expires_at, o_orderstatus = 'F' AS used FROM orders)"
_KEYS = "keys AS (SELECT s_suppkey AS id, s_nationkey::BIGINT AS user_id, substr(md5(s_name), 1, 8) AS key_prefix, s_name AS name, true AS is_active, s_acctbal < 0 AS expired FROM supplier)"
_PROFILE = ["id", "email", "display_name", "role", "is_active", "email_verified"]


@query(f"WITH {_USERS}, m AS (SELECT max(id) AS m FROM users) SELECT * FROM users UNION ALL SELECT m + 1, 'a@x', 'a@x', 'admin', true, true FROM m UNION ALL SELECT m + 2, 'b@x', 'B', 'user', true, true FROM m UNION ALL SELECT m + 3, 'c@x', 'C', 'user', false, false FROM m")
def users_created(spark, sf_dir):
    """Two users by an admin, one by registering."""
    by_admin = spark.createDataFrame([("a@x", "h", "", "admin"), ("b@x", "h", "B", "root")], "email string, password_hash string, display_name string, role string")
    own = spark.createDataFrame([("c@x", "h", "C")], "email string, password_hash string, display_name string")
    return accounts.create_users(accounts.create_users(tables.users(spark, sf_dir), by_admin, NOW), own, NOW).select(*_PROFILE)


@query(f"WITH {_USERS} SELECT id, CASE WHEN id = 7 THEN 'new@x' ELSE email END AS email, CASE WHEN id = 7 THEN 'New' ELSE display_name END AS display_name, CASE WHEN id = 8 THEN 'admin' ELSE role END AS role, CASE WHEN id = 9 THEN false ELSE is_active END AS is_active, email_verified, id IN (7, 8, 9) AS touched FROM users")
def users_updated(spark, sf_dir):
    """A profile, a role and a deactivation."""
    users = accounts.update_user(tables.users(spark, sf_dir), 7, NOW, display_name="New", email="new@x")
    users = accounts.update_user(accounts.update_user(users, 8, NOW, role="admin"), 9, NOW, is_active=False)
    return users.select(*_PROFILE, (F.col("updated_at") == F.lit(NOW)).alias("touched"))


@query(f"WITH {_USERS} SELECT *, 'id' AS by FROM users WHERE id = 7 UNION ALL SELECT *, 'email' FROM users WHERE email = 'u8@example.com'")
def user_lookup(spark, sf_dir):
    users = tables.users(spark, sf_dir).select(*_PROFILE)
    return accounts.point(users, id=7).withColumn("by", F.lit("id")).unionByName(accounts.point(users, email="u8@example.com").withColumn("by", F.lit("email")))


@query("SELECT 'users' AS name, count(*) AS n FROM customer WHERE c_custkey <> 7 UNION ALL SELECT 'sessions', count(*) FROM orders WHERE o_custkey <> 7 UNION ALL SELECT 'tokens', count(*) FROM orders WHERE o_custkey <> 7 UNION ALL SELECT 'keys', count(*) FROM supplier WHERE s_nationkey <> 7 UNION ALL SELECT 'pins', count(*) FROM orders WHERE o_custkey <> 7")
def user_deleted(spark, sf_dir):
    """Rows that a deletion leaves: sessions, tokens and keys go with the user, pins stay without one."""
    sessions, tokens, keys = (f(spark, sf_dir) for f in (tables.sessions, tables.tokens, tables.api_keys))
    pins = sessions.select("id", F.col("user_id").alias("pinned_by"))
    left = accounts.delete_user(tables.users(spark, sf_dir), 7, {"sessions": (sessions, "user_id", "cascade"), "tokens": (tokens, "user_id", "cascade"), "keys": (keys, "user_id", "cascade"), "pins": (pins, "pinned_by", "set null")})
    left["pins"] = left["pins"].where("pinned_by IS NOT NULL")
    out = None
    for name, df in left.items():
        n = df.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


@query("SELECT o_orderkey::VARCHAR AS id, o_custkey AS user_id FROM orders JOIN customer ON c_custkey = o_custkey AND c_acctbal >= 0")
def sessions_cascaded(spark, sf_dir):
    """Sessions of the users that are left."""
    return accounts.orphans(tables.sessions(spark, sf_dir), "user_id", tables.users(spark, sf_dir).where("is_active")).select("id", "user_id")


@query("SELECT o_orderkey::VARCHAR AS id, c_custkey AS pinned_by FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal >= 0")
def pins_set_null(spark, sf_dir):
    pins = tables.sessions(spark, sf_dir).select("id", F.col("user_id").alias("pinned_by"))
    return accounts.orphans(pins, "pinned_by", tables.users(spark, sf_dir).where("is_active"), accounts.SET_NULL)


@query(f"WITH {_TOKENS}, t AS (SELECT * FROM tokens WHERE user_id <> 7 OR used) SELECT id, user_id, token, used FROM t UNION ALL SELECT max(id) + 1, 7, 'fresh', false FROM t")
def token_issued(spark, sf_dir):
    """A reset token replaces the unused ones of its user."""
    out = accounts.issue_token(tables.tokens(spark, sf_dir), 7, "fresh", "reset", NOW)
    return out.select("id", "user_id", "token", F.col("used_at").isNotNull().alias("used"))


_FIRST = "(SELECT min(id) FROM tokens WHERE NOT used)"


@query(f"WITH {_TOKENS} SELECT id, user_id, used OR id = {_FIRST} AS used FROM tokens")
def token_consumed(spark, sf_dir):
    tokens = tables.tokens(spark, sf_dir)
    first = tokens.where("used_at IS NULL").orderBy("id").first()
    out, _ = accounts.consume_token(tokens, first.token, first.created_at)
    return out.select("id", "user_id", F.col("used_at").isNotNull().alias("used"))


@query(f"WITH {_USERS}, {_TOKENS}, w AS (SELECT user_id FROM tokens WHERE id = {_FIRST}) SELECT id, is_active OR id IN (FROM w) AS is_active, email_verified OR id IN (FROM w) AS email_verified FROM users")
def email_verified(spark, sf_dir):
    tokens = tables.tokens(spark, sf_dir)
    first = tokens.where("used_at IS NULL").orderBy("id").first()
    users, _ = accounts.verify_email(tables.users(spark, sf_dir), tokens, first.token, first.created_at)
    return users.select("id", "is_active", "email_verified")


@query(f"WITH {_KEYS} SELECT id, user_id, key_prefix, name, is_active AND id <> 2 AS is_active, id = 3 AS used FROM keys UNION ALL SELECT max(id) + 1, 5, 'abcdefgh', 'mine', true, false FROM keys")
def api_keys_changed(spark, sf_dir):
    """A new key, a use, a revocation by the owner and one by somebody else, which changes nothing."""
    keys = tables.api_keys(spark, sf_dir)
    owner = keys.where("id = 2").first().user_id
    keys = accounts.create_api_key(keys, 5, "abcdefghijklmnop", "hash", "mine", ["read", "write"], 10, NOW)
    keys = accounts.revoke_api_key(accounts.revoke_api_key(accounts.touch_api_key(keys, 3, NOW), 2, owner), 1, -1)
    return keys.select("id", "user_id", "key_prefix", "name", "is_active", F.col("last_used_at").isNotNull().alias("used"))


@query(f"WITH {_KEYS} SELECT id, user_id, 60 AS rate_limit FROM keys WHERE id <= 5 AND NOT expired")
def api_key_lookup(spark, sf_dir):
    """Keys by their prefix; an expired one is not found."""
    keys, out = tables.api_keys(spark, sf_dir), None
    for r in keys.where("id <= 5").select("key_prefix").collect():
        hit = accounts.lookup_api_key(keys, r.key_prefix, NOW).select("id", "user_id", "rate_limit")
        out = hit if out is None else out.unionByName(hit)
    return out


@query("SELECT o_orderkey::VARCHAR AS id, o_custkey AS user_id, CASE WHEN o_orderstatus = 'O' THEN 'newer' ELSE o_orderpriority END AS title FROM orders UNION ALL SELECT 'n' || o_orderkey, o_custkey, 'newer' FROM orders WHERE o_orderstatus = 'O'")
def session_upsert(spark, sf_dir):
    """Open sessions come again, under their id with somebody else as owner, who is not taken over, and under a new id."""
    orders = tables.read(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").alias("user_id"))
    again = orders.withColumn("user_id", F.lit(-1).cast("long")).unionByName(orders.withColumn("id", F.concat(F.lit("n"), "id"))).withColumn("title", F.lit("newer"))
    return ingest.session_upsert(tables.sessions(spark, sf_dir), tables.conform(again, tables.SESSIONS)).select("id", "user_id", "title")


@query("SELECT o_orderkey::VARCHAR AS id, o_custkey AS user_id, CASE WHEN o_orderkey = (SELECT min(o_orderkey) FROM orders WHERE o_custkey <> 7) THEN 'Renamed' ELSE o_orderpriority END AS title FROM orders WHERE NOT (o_orderstatus = 'O' AND o_custkey = 7)")
def session_delete_rename(spark, sf_dir):
    """A user deletes among all open sessions only the own ones; another renames one, and tries to rename another's."""
    sessions = tables.sessions(spark, sf_dir)
    opened = tables.read(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").cast("string").alias("id"))
    left = accounts.delete_sessions(sessions, opened, user_id=7)
    first = sessions.where("user_id <> 7").orderBy(F.col("id").cast("long")).first()
    left = accounts.rename_session(left, first.id, first.user_id, "Renamed", NOW)
    return accounts.rename_session(left, first.id, -1, "Stolen", NOW).select("id", "user_id", "title")


@query("SELECT o_orderkey::VARCHAR AS id, o_custkey AS user_id FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)")
def session_lookup(spark, sf_dir):
    """A session by id and owner, and nothing for somebody else."""
    sessions = tables.sessions(spark, sf_dir).select("id", "user_id")
    first = sessions.orderBy(F.col("id").cast("long")).first()
    return accounts.point(sessions, id=first.id, user_id=first.user_id).unionByName(accounts.point(sessions, id=first.id, user_id=-1))


# Windows that also run as streams ---------------------------------------------------------------


@query("SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1")
def daily_counts_stream(spark, sf_dir):
    """The log file read as a stream; a row per day is what the in-memory table holds."""
    events = tables.read(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parque[t]").select(F.col("ts").cast("timestamp").alias("created_at"))
    return streams.run_to_end(streams.daily_counts(stream), f"daily_{uuid.uuid4().hex}")


@query("SELECT user_id, epoch_ms(epoch_ms(ts) // 3600000 * 3600000) AS window_start, count(*) AS failures FROM events GROUP BY 1, 2 HAVING count(*) >= 2")
def limiter_windows(spark, sf_dir):
    return streams.failure_windows(tables.query_logs(spark, sf_dir), "user_id", "created_at", minutes=60, most=2)
