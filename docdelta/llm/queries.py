"""Queries of the operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_links, decontamination, divergence, license_scan, line_dedup, packing, quality_classifier, quality_rules, secret_scan, simhash, spelling, token_rollup, toxicity
from .common import scratch_root, table


def op1_chat_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = chat_links.conversation_calls(table(spark, sf_dir, "conversations"))
    schemas = spark.createDataFrame(chat_links.REPLY_SCHEMA, "name string, param string, type string, required boolean")
    return chat_links.link_calls(calls, results, schemas).drop("result_turn")


def op2_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rollup = token_rollup.TokenRollup(spark, f"{scratch_root(spark)}/rollup-{uuid.uuid4().hex}")
    rollup.commit("0-load", docs.withColumn("op", F.lit("insert")))
    rollup.commit("1-mask", token_rollup.masked(docs))
    rollup.commit("2-copies", token_rollup.copies(docs))
    rollup.commit("1-mask", token_rollup.masked(docs))  # a replay changes nothing
    return rollup.totals()


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op4_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op5_benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.retrieval_packing(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_lines"), F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op10_secret_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_findings(table(spark, sf_dir, "documents"), path="source")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_links, op2_token_rollup, op3_license_scan, op4_simhash_groups, op5_benchmark_hits, op6_retrieval_packing, op7_line_dedup,
        op8_quality_classifier, op9_quality_rules, op10_secret_findings, op11_source_divergence, op12_spelling_variants, op13_toxicity, pipeline,
    )
}

ORACLES: dict[str, str] = {
    "op1_chat_links": """
WITH RECURSIVE u AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'),
dep AS (
  SELECT u.conv_id, u.turn, p.turn AS needed FROM u JOIN u p ON p.conv_id = u.conv_id AND p.turn = u.turn - 2 AND u.turn > 0
  UNION SELECT u.conv_id, u.turn, p.turn FROM u JOIN u p ON p.conv_id = u.conv_id AND p.turn = (u.turn // 4) * 2 AND u.turn > 0 AND u.turn % 6 = 0
),
path(conv_id, turn, steps) AS (
  SELECT conv_id, turn, 0 FROM u
  UNION SELECT dep.conv_id, dep.turn, steps + 1 FROM path JOIN dep ON dep.conv_id = path.conv_id AND dep.needed = path.turn
),
lv AS (SELECT conv_id, turn, max(steps)::BIGINT AS level FROM path GROUP BY ALL),
j AS (
  SELECT u.conv_id, 'call_' || u.conv_id || '_' || u.turn AS call_id, u.turn, u.text, a.turn AS result_turn, a.text AS result, lv.level,
    CASE WHEN result_turn IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
    CASE WHEN u.turn % 7 = 0 THEN '{"chars":"' || length(u.text) || '","text":' || to_json(u.text)::VARCHAR || ',"turn":' || u.turn || '}'
      WHEN u.turn % 5 = 0 THEN '{"chars":' || length(u.text) || ',"more":1,"text":' || to_json(u.text)::VARCHAR || '}'
      ELSE '{"chars":' || length(u.text) || ',"text":' || to_json(u.text)::VARCHAR || ',"turn":' || u.turn || '}' END AS arguments
  FROM u JOIN lv ON lv.conv_id = u.conv_id AND lv.turn = u.turn
  LEFT JOIN conversations a ON a.role = 'assistant' AND a.conv_id = u.conv_id AND a.turn - 1 = u.turn
)
SELECT conv_id, call_id, turn, 'reply' AS name, CASE WHEN result_turn IS NULL THEN 0 ELSE 1 END::BIGINT AS n_results, status,
  CASE WHEN turn % 7 = 0 THEN 'type:chars' WHEN turn % 5 = 0 THEN 'missing:turn,unknown:more' ELSE '' END AS errors, level,
  row_number() OVER (PARTITION BY conv_id ORDER BY level, turn // 1024, turn, call_id) AS place,
  '{"arguments":' || arguments || ',"call_id":"' || call_id || '","conv_id":' || conv_id
  || ',"level":' || level || ',"name":"reply","result":' || coalesce(to_json(result)::VARCHAR, 'null') || ',"status":"' || status || '"}' AS message
FROM j
""",
    "op9_quality_rules": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
x AS (SELECT r, unnest(ws) AS w1, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT r, i, w1, lead(w1, 1) OVER p AS w2, lead(w1, 2) OVER p AS w3, lead(w1, 3) OVER p AS w4, lead(w1, 4) OVER p AS w5 FROM x WINDOW p AS (PARTITION BY r ORDER BY i)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w1, w2, w3, w4, w5) AS c FROM g WHERE w5 IS NOT NULL) WHERE c > 1),
cov AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, i + k AS i FROM rep, (VALUES (0), (1), (2), (3), (4)) AS v(k)) GROUP BY r),
l AS (
  SELECT r, doc_id, source, line, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM (SELECT r, doc_id, source, unnest(string_split(text, chr(10))) AS line FROM d)
),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM l WHERE len(ws) > 0 GROUP BY r),
n AS (
  SELECT r, doc_id, source, translate(array_to_string(ws, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line, sum(len(ws)) AS words
  FROM l WHERE len(ws) > 0 GROUP BY ALL
),
c AS (SELECT source, line FROM n GROUP BY source, line HAVING count(DISTINCT doc_id) + count(*) FILTER (WHERE doc_id IS NULL) > 20),
lost AS (SELECT n.r, sum(words)::BIGINT AS words, count(*) AS lines FROM n JOIN c ON c.source IS NOT DISTINCT FROM n.source AND c.line = n.line GROUP BY n.r),
m AS (
  SELECT d.doc_id, len(w.ws)::BIGINT AS n_words, length(regexp_replace(d.text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
    coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.lines, 0)::BIGINT AS n_frequent_lines, len(w.ws)::BIGINT - coalesce(lost.words, 0)::BIGINT AS words_left
  FROM d JOIN w USING (r) LEFT JOIN dup USING (r) LEFT JOIN cov USING (r) LEFT JOIN lost USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND words_left >= 10 AND words_left >= 0.2 * n_words AS kept, n_frequent_lines, words_left
FROM m
""",
    "op11_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
x AS (
  SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
),
k AS (SELECT lang, term, count(*) AS in_lang FROM x GROUP BY ALL HAVING count(DISTINCT r) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(in_lang)::HUGEINT AS n FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM x SEMI JOIN k USING (lang, term) GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) + 5 * v.v))::BIGINT AS p,
    (1 + (1000000000::HUGEINT * (k.in_lang + 5)) // (v.n + 5 * v.v))::BIGINT AS q
  FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
),
f AS (
  SELECT lang, source, 'pair' AS part, item, value FROM (
    SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  )
  UNION ALL SELECT a.lang, a.source, 'pair', b.source, 0 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source WHERE a.lang NOT IN (SELECT lang FROM v)
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, rank FROM (
  SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM f
) WHERE part = 'pair' OR rank <= 50
""",
    "op12_spelling_variants": r"""
WITH RECURSIVE steps(i, k, v) AS (
  SELECT i, 0, i FROM range(256) AS r(i) UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM steps WHERE k < 8
),
crc AS (SELECT list(v ORDER BY i) AS tab FROM steps WHERE k = 8),
runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS c
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents) GROUP BY ALL
),
bytes AS (
  SELECT run, c, list_transform(flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
    lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [195, unicode(x) - 64] END)), lambda b: b::BIGINT) AS b FROM runs
),
hashed AS (SELECT run, c, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda a, y: xor(a >> 8, tab[(xor(a, y) & 255) + 1])), 4294967295) AS h FROM bytes, crc),
w AS (
  SELECT word, sum(c)::BIGINT AS n
  FROM (SELECT c, CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3
),
gaps AS (SELECT word, n, i, substr(word, 1, i::INT - 1) AS p, substr(word, i::INT + 1) AS s FROM w, range(1, length(word) + 1) AS r(i)),
near AS (
  SELECT a.word, b.word AS other, b.n FROM gaps a JOIN gaps b ON a.p = b.p AND a.s = b.s AND a.word <> b.word
  UNION SELECT a.word, w.word, w.n FROM gaps a JOIN w ON a.p || a.s = w.word
  UNION SELECT w.word, a.word, a.n FROM gaps a JOIN w ON a.p || a.s = w.word
),
best AS (SELECT word, count(*) AS n_near, max(n) AS top, arg_min(other, (-n, other)) AS other FROM near GROUP BY word),
f AS (
  SELECT w.word, CASE WHEN top >= 2 * w.n THEN other END AS form, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 2 * w.n THEN top END AS form_n
  FROM w LEFT JOIN best USING (word)
),
walk(word, reached, k) AS (SELECT word, word, 0 FROM f UNION ALL SELECT walk.word, f.form, k + 1 FROM walk JOIN f ON f.word = walk.reached WHERE f.form IS NOT NULL),
root AS (SELECT word, arg_max(reached, k) AS root FROM walk GROUP BY word)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN root USING (word)
""",
}
