"""Queries of the text functions, of coverage and of figures by engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import coverage, geometry, metrics
from . import fixtures
from .registry import documents, query, web_pages

# SQL without lookarounds: cuts are marked one after the other, and the character behind a cut is put back.
UNITS = r"""
d AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents),
c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t,
  '(WARNING:|CAUTION:|NOTE:)\s+([A-Z])', '\1' || chr(10) || '\2', 'g'), '(\)\d\)|\)[a-z]\))\s+', '\1' || chr(10), 'g'),
  '([.。；;！!?？])(\s*)([A-Z(]|\d|[一-鿿])', '\1' || chr(10) || '\3', 'g') AS t FROM d),
p AS (SELECT doc_id, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS us FROM c),
u AS (SELECT doc_id, generate_subscripts(us, 1) - 1 AS unit_no, unnest(us) AS unit FROM p)"""


def noise_sql(x: str) -> str:
    markers = r"(?i)(警告[:：]|警戒[:：]|注意[:：]|注[:：]|WARNING:|CAUTION:|NOTE:)\s*"
    return rf"trim(regexp_replace(regexp_replace({x}, '{markers}', '', 'g'), '\s+', ' ', 'g'))"


_PLAIN = [
    (r"([,.''])\s+([A-Za-z0-9])", r"\1\2"), (r"([A-Za-z0-9])\s+([()\[\]])", r"\1\2"), (r"([()\[\]])\s+([A-Za-z0-9])", r"\1\2"),
    (r"\(\s+\)", "()"), (r"\[\s+\]", "[]"), (r"([A-Za-z0-9])\s+([A-Za-z0-9])", r"\1\2"), (r"([A-Za-z0-9])\s+([A-Za-z0-9])", r"\1\2"),
    (r"-\s+", "-"), (r"(\d)\s*-\s*(\d)", r"\1-\2"),
    *((f"(?:{w}){{2,}}", w) for w in ("Table", "Step", "Figure", "Fig", "Task", "Section", "Para", "Chapter")),
]


def norm_sql(x: str) -> str:
    """The plain steps of the normal form."""
    for a, b in _PLAIN:
        x = f"regexp_replace({x}, '{a}', '{b}', 'g')"
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def escape_sql(x: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


@query(rf"WITH {UNITS} SELECT doc_id, unit_no::INT AS unit_no, unit FROM u")
def split_units(spark, d):
    return documents(spark, d).select("doc_id", F.posexplode(T.split_units(F.col("text"))).alias("unit_no", "unit"))


_MARKED = "CASE unit_no % 4 WHEN 0 THEN 'NOTE: ' || unit WHEN 1 THEN unit || ' 警告： end' WHEN 2 THEN unit || ' caution:warning:  x' ELSE unit END"


@query(rf"WITH {UNITS} SELECT doc_id, unit_no::INT AS unit_no, {noise_sql(_MARKED)} AS unit FROM u")
def strip_noise(spark, d):
    """The documents have no markers, so three units of four get some."""
    k, unit = F.col("unit_no") % 4, F.col("unit")
    marked = F.when(k == 0, F.concat(F.lit("NOTE: "), unit)).when(k == 1, F.concat(unit, F.lit(" 警告： end"))).when(k == 2, F.concat(unit, F.lit(" caution:warning:  x"))).otherwise(unit)
    return split_units(spark, d).select("doc_id", "unit_no", T.strip_noise(marked).alias("unit"))


#: What is put behind a unit, and what is left of it in the normal form.
_RARE = [("", ""), (r", 90^{\circ} C", ",90℃"), (", 检查 阀门", ", 检查阀门"), (r", 5 \sim 10", ",5~10"), (", 80～90；", ",80~90;"), (r", \mathrm{x} 1 - 2", ",x1-2"), (", 阀- 门 （ 7 ）", ", 阀门( 7 )")]
_RARE_NORM = " ".join(f"WHEN {k} THEN '{b}'" for k, (_, b) in enumerate(_RARE))


@query(rf"WITH {UNITS} SELECT doc_id, unit_no::INT AS unit_no, {norm_sql('unit')} || CASE unit_no % {len(_RARE)} {_RARE_NORM} END AS norm FROM u")
def normalize(spark, d):
    """The documents have none of the rare characters, so six units of seven get some."""
    behind = F.array(*(F.lit(a) for a, _ in _RARE))[F.col("unit_no") % len(_RARE)]
    return split_units(spark, d).select("doc_id", "unit_no", T.normalize(F.concat("unit", behind)).alias("norm"))


@query(f"SELECT page_id, {escape_sql('html')} AS escaped FROM pages")
def html_escape(spark, d):
    return web_pages(spark, d).select("page_id", T.html_escape(F.col("html")).alias("escaped"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages")
def strip_tags(spark, d):
    return web_pages(spark, d).select("page_id", T.strip_tags(F.col("html")).alias("text"))


@query(r"""
SELECT page_id, unnest(list_filter(list_transform(
  regexp_extract_all(replace(replace(html, '<li', '<tr'), '</li>', '</tr>'), '(?s)<tr[^>]*>(.*?)</tr>', 1),
  lambda r: trim(regexp_replace(regexp_replace(r, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))), lambda r: r <> '')) AS row_text
FROM pages""")
def html_table_rows(spark, d):
    """The pages have lists and no tables; their items are made rows."""
    html = F.replace(F.replace("html", F.lit("<li"), F.lit("<tr")), F.lit("</li>"), F.lit("</tr>"))
    return web_pages(spark, d).select("page_id", F.explode(T.html_table_rows(html)).alias("row_text"))


@query(rf"WITH {UNITS} SELECT doc_id, unit_no::INT AS unit_no, unit_no % 3 <> 1 OR unit = '' AS same FROM u")
def same_ignoring_spaces(spark, d):
    """Each unit against itself, with another letter behind it, or with wider spaces."""
    k, unit = F.col("unit_no") % 3, F.col("unit")
    other = F.when(k == 0, unit).when(k == 1, F.concat(unit, F.lit(" x"))).otherwise(F.regexp_replace(unit, "(.) ?", "$1  "))
    return split_units(spark, d).select("doc_id", "unit_no", T.same_ignoring_spaces(unit, other).alias("same"))


BAG = "SELECT doc_id, lower(unnest(regexp_extract_all({0}, '[一-鿿]|[A-Za-z]+|\\d+'))) AS token FROM {1}"


@query(f"SELECT doc_id, token, count(*) AS n FROM ({BAG.format('text', 'documents')}) GROUP BY ALL")
def token_bag(spark, d):
    return coverage.token_bag(documents(spark, d))


def _truth(spark, d):
    return documents(spark, d).select("doc_id", "text")


def _extracted(spark, d):
    """What an extraction kept: the text without its longer numbers and without the last quarter of some documents."""
    cut = F.expr("substring(text, 1, cast(length(text) * 3 div 4 as int))")
    part = F.when(F.col("doc_id") % 3 == 0, cut).otherwise(F.regexp_replace("text", "[0-9]{3,}", ""))
    return documents(spark, d).select("doc_id", part.alias("text"))


_COVER = f"""WITH e AS (
  SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN substring(text, 1, (length(text) * 3) // 4) ELSE regexp_replace(text, '[0-9]{{3,}}', '', 'g') END AS text FROM documents),
s AS (SELECT doc_id, token, sum(t)::BIGINT AS t, sum(e)::BIGINT AS e FROM (
  SELECT doc_id, token, 1 AS t, 0 AS e FROM ({BAG.format('text', 'documents')}) UNION ALL SELECT doc_id, token, 0, 1 FROM ({BAG.format('text', 'e')})) GROUP BY ALL),
g AS (SELECT d.doc_id, coalesce(sum(t), 0)::BIGINT AS total, coalesce(sum(greatest(t - e, 0)), 0)::BIGINT AS lost
  FROM documents d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id)"""


@query(f"{_COVER} SELECT doc_id, token, t, e FROM s")
def bag_difference(spark, d):
    return coverage.bag_difference(_truth(spark, d), _extracted(spark, d))


@query(f"{_COVER} SELECT doc_id, token, t - e AS missing FROM s WHERE t > e")
def missing_tokens(spark, d):
    return coverage.missing_tokens(bag_difference(spark, d))


@query(f"""{_COVER} SELECT doc_id, CASE WHEN total >= 200 THEN round((total - lost) / total, 9) END AS recall,
  CASE WHEN total >= 200 THEN lost ELSE 0 END AS missing, total, coalesce(total >= 200 AND (total - lost) / total < 0.95, false) AS low FROM g""")
def coverage_figures(spark, d):
    return coverage.coverage(_truth(spark, d), _extracted(spark, d)).withColumn("recall", F.round("recall", 9))


@query(f"""{_COVER} SELECT doc_id, CASE WHEN total < 200 THEN 'no text layer, skipped'
  ELSE 'coverage ' || printf('%.1f', round((total - lost) / total * 100, 1)) || '% (missing ' || lost || '/' || total || ' tokens)'
  || CASE WHEN (total - lost) / total < 0.95 THEN ' low: content may be lost' ELSE '' END END AS message FROM g""")
def coverage_message(spark, d):
    return coverage.coverage_message(coverage.coverage(_truth(spark, d), _extracted(spark, d)))


_LINES = r"""WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS i, unnest(ls) AS x FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
inside AS (SELECT doc_id, i // 8 AS page_idx, i, regexp_replace(x, '^\s+|\s+$', '', 'g') AS piece FROM l WHERE i % 8 BETWEEN 1 AND 5 AND (doc_id + i // 8) % 3 <> 0),
whole AS (SELECT doc_id, i // 8 AS page_idx, 0 AS i, string_agg(x, ' ' ORDER BY i) AS piece FROM l WHERE (doc_id + i // 8) % 3 = 0 GROUP BY doc_id, i // 8)"""


@query(f"""{_LINES} SELECT doc_id, string_agg(piece, ' ' ORDER BY page_idx, i) AS text
FROM (SELECT * FROM inside WHERE piece <> '' UNION ALL SELECT * FROM whole) GROUP BY doc_id""")
def truth_text(spark, d):
    """Two pages of three have a region, which leaves out their first and last lines."""
    lines = fixtures.page_lines(documents(spark, d))
    whole = lines.groupBy("doc_id", "page_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "x"))), lambda s: s["x"]), " ").alias("text"))
    regions = whole.filter("(doc_id + page_idx) % 3 <> 0").select("doc_id", "page_idx", F.lit(100.0).alias("y_top"), F.lit(500.0).alias("y_bottom"))
    return coverage.truth_text(whole, geometry.content_page_lines(lines.drop("x"), regions), regions)


_LABEL = """CASE WHEN {b} = 'pdfjs' THEN 'pdf.js ' || coalesce(nullif({v}, ''), 'unknown')
  ELSE 'MinerU ' || coalesce(nullif({v}, ''), 'unknown') || ' (' || coalesce(nullif({b}, ''), 'unknown') || ')' END"""
_ENGINE = "CASE doc_id % 4 WHEN 0 THEN 'pdfjs' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE source END"


@query(f"SELECT doc_id, {_LABEL.format(b='b', v='v')} AS label FROM (SELECT doc_id, {_ENGINE} AS b, CASE WHEN doc_id % 5 <> 0 THEN lang END AS v FROM documents)")
def source_label(spark, d):
    backend = F.expr(_ENGINE)
    version = F.when(F.col("doc_id") % 5 != 0, F.col("lang"))
    return documents(spark, d).select("doc_id", T.source_label(backend, version).alias("label"))


_SIDES = f"""WITH v AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'pdfjs' ELSE source END AS b, CASE WHEN doc_id % 3 = 0 THEN '6.1' ELSE '2.7' END AS o, CASE WHEN doc_id % 3 = 0 THEN '6.1' ELSE '3.4' END AS n FROM documents),
pl AS (SELECT doc_id AS pair_id, {_LABEL.format(b='b', v='o')} AS ol, {_LABEL.format(b='b', v='n')} AS nl FROM v),
labels AS (SELECT pair_id, CASE WHEN ol = nl THEN ol ELSE 'old ' || ol || ' / new ' || nl END AS label FROM pl)"""
SIDES = _SIDES.removeprefix("WITH ")


@query(f"{_SIDES} SELECT pair_id, label FROM labels")
def pair_provenance(spark, d):
    return fixtures.labels(documents(spark, d))


_LATEX = r"CASE WHEN doc_id % 4 = 0 THEN text || ' 5^{\circ}C \sim \mathrm{x}' ELSE text END"


@query(rf"""{_COVER} SELECT source AS backend, lang AS version, count(*) AS documents, sum(length({_LATEX}))::BIGINT AS characters,
  sum(len(regexp_extract_all({_LATEX}, '\\(sim|cdot|circ|math)')))::BIGINT AS artefacts, round(avg(CASE WHEN total >= 200 THEN (total - lost) / total END), 9) AS mean_recall
FROM documents JOIN g USING (doc_id) GROUP BY ALL""")
def extraction_scorecard(spark, d):
    """One document of four gets three LaTeX artefacts."""
    behind = F.when(F.col("doc_id") % 4 == 0, r" 5^{\circ}C \sim \mathrm{x}").otherwise("")
    docs = documents(spark, d).select("doc_id", F.col("source").alias("backend"), F.col("lang").alias("version"), F.concat("text", behind).alias("text"))
    figures = coverage.coverage(_truth(spark, d), _extracted(spark, d))
    return metrics.extraction_scorecard(docs, figures).withColumn("mean_recall", F.round("mean_recall", 9))


@query("""SELECT source AS backend, word, sum((length(text) - length(replace(text, word, ''))) // length(word))::BIGINT AS n
FROM documents, (VALUES ('the'), ('License'), ('une')) w(word) GROUP BY ALL""")
def keyword_counts(spark, d):
    return metrics.keyword_counts(documents(spark, d).select(F.col("source").alias("backend"), "text"), ["the", "License", "une"])
