"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitpack, importance, label_sharding, lattice_codec, line_dedup, minhash_dedup, mixing, quality_cascade, rp_forest, source_audit, token_counts, toxicity, turn_repair


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_read(spark, sf_dir, "documents"), width=3, num=85, den=100)


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp_forest.nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_sharding.shard(_read(spark, sf_dir, "documents"), shards=40)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_read(spark, sf_dir, "documents"), model="piece_bpe_32k.model")


def op5_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.select(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_cascade.judge(_read(spark, sf_dir, "documents"))
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_codec.digests(_read(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitpack.round_trip(_read(spark, sf_dir, "documents"), tokenizer="byte_bpe_50k.json", vocabulary=50_257, end=0)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"), F.array("source"))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations")
    every = turns.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    found = turn_repair.summaries(turn_repair.damaged(turns)).withColumnRenamed("conv_id", "found_id")
    out = every.join(found, F.col("conv_id").eqNullSafe(F.col("found_id")), "left")
    nothing = {c: F.coalesce(c, F.lit(0).cast("long")) for c in turn_repair.COUNTS} | {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))}
    return out.withColumns(nothing).select("conv_id", *nothing)


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.divergence(_read(spark, sf_dir, "documents"), min_docs=10, top=10)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.dedup_lines(_read(spark, sf_dir, "documents"), min_chars=40, min_docs=5)
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_minhash_dedup, op2_nearest_neighbours, op3_sharding, op4_token_counts, op5_importance_resampling, op6_quality_rules, op7_sentencepiece, op8_toxicity, op9_token_ids, op10_mixing, op11_turn_repair, op12_source_audit, op13_line_dedup)}

WORDS = r"[^\x20\x09-\x0D]+"


def _repair_sql() -> str:
    """The repair by dynamic programming over rows instead of a search.

    A path is a string, six digits of cost and its audit, so the least string is the cheapest path with the least
    audit; a row folds the best paths to the pattern's four states into the next four.
    """

    def add(path: str, cost: int, letter: str) -> str:
        return f"(lpad(CAST(CAST({path}[1:6] AS INT) + {cost} AS VARCHAR), 6, '0') || {path}[7:] || '{letter}')"

    # What may stand before a row: the states reached by inserted turns (more than two are never cheapest between rows).
    once = {0: "p.s0", 1: "p.s1", 2: "least(p.s2, {0}, {1}, {3})", 3: "least(p.s3, {2})"}
    u = once[2].format(add("p.s0", 5, "I"), add("p.s1", 5, "I"), "", add("p.s3", 5, "I"))
    a = f"least(p.s3, {add('p.s2', 5, 'I')}, {add('p.s0', 10, 'II')}, {add('p.s1', 10, 'II')})"
    before = f"{{'s0': p.s0, 's1': p.s1, 's2': {u}, 's3': {a}, 'f': x.f, 'i': x.i}}"
    stay = "CASE WHEN q.f IN ('b', 'd') THEN NULL ELSE {} END"
    cut = "(CASE WHEN q.f = 't' THEN 5 ELSE 0 END)"

    def to(origins: list[str], initial: str, letters: str) -> str:
        kept = [f"CASE WHEN q.i = '{initial}' THEN {add(o, cut, 'K')} END" for o in origins]
        changed = [add(o, f"{cut} + 1", "R") for o in origins if letters]
        return stay.format(f"least({', '.join([*kept, *changed, 'NULL'])})")

    go = [add(f"q.s{k}", 2, "D") for k in range(4)]
    after = f"{{'s0': {go[0]}, 's1': least({go[1]}, {to(['q.s0'], 's', '')}), 's2': least({go[2]}, {to(['q.s0', 'q.s1', 'q.s3'], 'u', 'R')}), 's3': least({go[3]}, {to(['q.s2'], 'a', 'R')}), 'f': NULL::VARCHAR, 'i': NULL::VARCHAR}}"
    crc = "list_reduce(list_concat([4294967295], flatten(list_transform(list_transform(string_split(k, ''), lambda c: CAST(ord(c) AS BIGINT)), lambda c: [c, 0, 0, 0, 0, 0, 0, 0]))), lambda r, b: xor(xor(r, b) >> 1, 3988292384 * (xor(r, b) & 1)))"
    return rf"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
  FROM conversations),
h AS (SELECT *, xor({crc}, 4294967295) % 20 AS hit FROM c),
d AS (
  SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
    CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN hit = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM h WHERE hit <> 0),
n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
    role[1:1] AS i, lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS prior
  FROM d),
y AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again FROM n),
f AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'b' WHEN again THEN 'd'
    WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 't' ELSE 'f' END AS f
  FROM y),
g AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate,
    count(*) FILTER (f = 't') AS truncated, count(*) FILTER (pos > 1 AND (prior || i) NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n
  FROM f GROUP BY conv_id),
-- One row after another: the best path to each state once this row is read.
w AS (
  SELECT conv_id, 0 AS pos, {{'s0': '000000', 's1': NULL::VARCHAR, 's2': NULL::VARCHAR, 's3': NULL::VARCHAR, 'f': NULL::VARCHAR, 'i': NULL::VARCHAR}} AS q FROM g
  UNION ALL
  SELECT conv_id, pos, {after} AS q
  FROM (SELECT x.conv_id, x.pos, {before} AS q FROM (SELECT conv_id, pos, q AS p FROM w) o JOIN f x ON x.conv_id IS NOT DISTINCT FROM o.conv_id AND x.pos = o.pos + 1) s),
z AS (
  SELECT g.conv_id, least(p.s3, p.s0, {add('p.s2', 5, 'I')}, {add('p.s1', 10, 'II')}) AS best
  FROM g JOIN (SELECT conv_id, pos, q AS p FROM w) v ON v.conv_id IS NOT DISTINCT FROM g.conv_id AND v.pos = g.n),
-- An audit read letter by letter: letters that take a row, and letters that give a turn, whose place names its role.
l AS (
  SELECT conv_id, best, unnest(string_split(best[7:], '')) AS letter, unnest(range(len(best) - 6)) AS place FROM z WHERE len(best) > 6),
m AS (
  SELECT *, count(*) FILTER (letter <> 'I') OVER (PARTITION BY conv_id ORDER BY place) AS pos,
    count(*) FILTER (letter <> 'D') OVER (PARTITION BY conv_id ORDER BY place) - 1 AS out,
    count(*) FILTER (letter <> 'D') OVER (PARTITION BY conv_id) % 2 AS lead
  FROM l),
r AS (
  SELECT m.conv_id, string_agg(CASE WHEN letter = 'K' THEN f.role WHEN (out - lead) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE f.text END, chr(10) ORDER BY place) AS told
  FROM m LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM m.conv_id AND f.pos = m.pos AND m.letter <> 'I' WHERE letter <> 'D' GROUP BY m.conv_id)
SELECT e.conv_id, coalesce(g.gaps, 0) AS gaps, coalesce(g.blank, 0) AS blank, coalesce(g.duplicate, 0) AS duplicate, coalesce(g.truncated, 0) AS truncated, coalesce(g.illegal, 0) AS illegal,
  coalesce(CAST(z.best[1:6] AS BIGINT), 0) AS cost, coalesce(z.best[7:], '') AS audit, sha256(coalesce(r.told, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e
LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM e.conv_id"""


ORACLES = {
    "op1_minhash_dedup": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
e2 AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, reach) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, e2.b FROM r JOIN e2 ON r.reach = e2.a),
c AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY 1)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, c.doc_id = c.component_id AS kept
FROM c LEFT JOIN n USING (doc_id)""",
    "op6_quality_rules": rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '{WORDS}') AS ws, string_split(text, chr(10)) AS lines FROM t),
g AS (
  SELECT doc_id, unnest(range(0, len(ws) - 7)) AS i, unnest(list_transform(range(1, len(ws) - 6), lambda i: array_to_string(ws[i:i + 7], ' '))) AS g
  FROM w WHERE len(ws) >= 9),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM d, range(0, 8) AS x(k) GROUP BY doc_id),
m AS (
  SELECT doc_id, len(ws) AS n_words,
    length(text) - len(regexp_extract_all(text, '[ 	-
]')) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
    len(list_filter(lines, lambda x: regexp_matches(x, '{WORDS}'))) - len(list_distinct(list_filter(lines, lambda x: regexp_matches(x, '{WORDS}')))) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines, len(regexp_extract_all(text, '\p{{Lu}}')) AS n_capitals
  FROM w LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > n_words OR word_chars < 2 * n_words
    OR word_chars > 20 * n_words OR 2 * n_dup_lines > n_lines OR 2 * n_capitals > word_chars) AS kept
FROM m""",
    "op11_turn_repair": _repair_sql(),
    "op12_source_audit": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
t AS (SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS n FROM t GROUP BY lang),
c AS (SELECT w.lang, w.source, w.term, count(*)::HUGEINT AS n FROM w JOIN t USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, t.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (g.n + 2 * v.v) AS p, 1 + (1000000000 * (t.n + 2)) // (v.n + 2 * v.v) AS q
  FROM g JOIN t USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = t.term),
x AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM o)
SELECT * FROM k WHERE part = 'pair' OR rank <= 10""",
    "op13_line_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS largest FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT coalesce(doc_id, -r)) >= 5 AND max(doc_id) IS NOT NULL),
m AS (SELECT k.*, f.key IS NOT NULL AND doc_id IS DISTINCT FROM largest AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id""",
}
