"""Queries of the revision comparison: layouts of both sides, text, units, alignment, counters, report."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import align, layout, metrics, report, search
from ..sources.diff_store import COUNTERS, DiffStore
from ..sources.layouts import write_diff, write_reports
from ..sources.unit_store import UnitStore
from . import fixtures
from .registry import documents, query
from .text_queries import SIDES, UNITS, escape_sql, noise_sql, norm_sql

# The edit rule tells the diff, since the units of a document differ: what was added stands right behind its neighbour.
_BASE = "'Entry ' || i || ', ' || unit || '.'"
_OLD = r"CASE kind WHEN 4 THEN ', 90^{\circ} C.' WHEN 5 THEN ' at 检查 阀门.' WHEN 7 THEN ' rev 1.' WHEN 8 THEN ', 5 \sim 10.' ELSE '' END"
_NEW = "CASE kind WHEN 2 THEN ' x1.' WHEN 4 THEN ', 90℃.' WHEN 5 THEN ' at检查阀门.' WHEN 7 THEN ' rev 2.' WHEN 8 THEN ', 5～10.' ELSE '' END"
_DIFF = f"""WITH {UNITS},
b AS (SELECT doc_id, unit_no AS i, (31 * doc_id + unit_no) % 10 AS kind, unit FROM u),
e AS (SELECT doc_id, i, 0 AS h, kind, CASE kind WHEN 0 THEN 'deleted' WHEN 2 THEN 'modified' WHEN 7 THEN 'modified' ELSE 'equal' END AS type,
    {noise_sql(_BASE + ' || ' + _OLD)} AS old,
    CASE kind WHEN 0 THEN NULL WHEN 3 THEN {noise_sql("'Entry' || i || ', ' || unit || '.'")} ELSE {noise_sql(_BASE + ' || ' + _NEW)} END AS new FROM b
  UNION ALL SELECT doc_id, i, 1, kind, 'added', NULL, 'Extra ' || md5(doc_id || '+' || i) || '.' FROM b WHERE kind = 1),
q AS (SELECT doc_id AS pair_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, h) - 1 AS seq, type, kind, old, new FROM e)"""


def _sides(spark, d):
    """Pairs and units; texts are dealt out by document before units are made of them, so that the join moves no units."""
    pairs, layouts = fixtures.revisions(documents(spark, d))
    return pairs, align.document_units(layout.document_text(layouts).repartition("doc_id"))


def _units(spark, d):
    return align.compare_pairs(*_sides(spark, d))


@query(f"{_DIFF} SELECT pair_id, seq::INT AS seq, type, old, new FROM q")
def diff_units(spark, d):
    return _units(spark, d).select("pair_id", "seq", "type", "old", "new")


_MARKED = f"""{_DIFF},
z AS (SELECT *, {norm_sql('old')} AS norm FROM q),
m AS (SELECT pair_id, seq, type, kind, old, new,
  CASE kind WHEN 2 THEN {escape_sql('norm')} WHEN 7 THEN {escape_sql('left(norm, length(norm) - 2)')} || '<span class="deleted-word">1</span>.' ELSE {escape_sql('old')} END AS old_html,
  CASE WHEN kind = 2 THEN {escape_sql('norm')} || '<span class="added-word">x1.</span>'
    WHEN kind = 7 THEN {escape_sql('left(norm, length(norm) - 2)')} || '<span class="added-word">2</span>.' ELSE {escape_sql('new')} END AS new_html FROM z)"""


@query(f"{_MARKED} SELECT pair_id, seq::INT AS seq, old_html, new_html FROM m")
def compare_pairs(spark, d):
    return _units(spark, d).select("pair_id", "seq", "old_html", "new_html")


@query(f"{_DIFF} SELECT pair_id, seq::INT AS seq, type, old, new FROM q")
def stored_diff(spark, d):
    """Diff units and counters as they come back from their tables."""
    path = fixtures.scratch(spark, "diff")
    pairs, units = _sides(spark, d)
    write_diff(align.compare_pairs(pairs, units), align.compare_counts(pairs, units), path)
    whole = spark.read.parquet(f"{path}/diff_stats").filter("total > 0").select("pair_id", "total")
    rows = spark.read.parquet(f"{path}/diff_units").join(whole, "pair_id").filter("seq < total")
    return rows.select("pair_id", "seq", "type", "old", "new")


_STATS = """count(*) FILTER (WHERE type = 'added') AS additions, count(*) FILTER (WHERE type = 'deleted') AS deletions,
  count(*) FILTER (WHERE type = 'modified') AS modifications, count(*) FILTER (WHERE type = 'equal') AS unchanged,
  count(type) AS total, count(*) FILTER (WHERE type <> 'equal') AS diff_count"""


@query(f"{_DIFF} SELECT pair_id, {_STATS} FROM q GROUP BY pair_id")
def diff_stats(spark, d):
    return metrics.diff_stats(_units(spark, d))


@query(f"{_DIFF} SELECT documents.doc_id AS pair_id, {_STATS} FROM documents LEFT JOIN q ON pair_id = documents.doc_id GROUP BY documents.doc_id")
def compare_counts(spark, d):
    return align.compare_counts(*_sides(spark, d))


@query()
def natural_diff(spark, d):
    """Revision counters of documents that begin with the same line."""
    docs = documents(spark, d)
    return align.compare_counts(fixtures.natural_pairs(docs), align.document_units(docs))


@query(f"""{_DIFF},
runs AS (SELECT *, type = 'equal' AS same, sum((old IS NOT NULL)::INT) OVER w - (old IS NOT NULL)::INT AS i, sum((new IS NOT NULL)::INT) OVER w - (new IS NOT NULL)::INT AS j,
  seq - row_number() OVER (PARTITION BY pair_id, type = 'equal' ORDER BY seq) AS island FROM q WINDOW w AS (PARTITION BY pair_id ORDER BY seq)),
r AS (SELECT pair_id, same, min(i) AS i1, min(i) + count(old) AS i2, min(j) AS j1, min(j) + count(new) AS j2 FROM runs GROUP BY pair_id, same, island)
SELECT pair_id, CASE WHEN same THEN 'equal' WHEN i1 = i2 THEN 'insert' WHEN j1 = j2 THEN 'delete' ELSE 'replace' END AS tag,
  i1::INT AS i1, i2::INT AS i2, j1::INT AS j1, j2::INT AS j2 FROM r""")
def align_opcodes(spark, d):
    return align.paired(*_sides(spark, d)).select("pair_id", F.inline(align.align_opcodes("old_norms", "new_norms")))


@query(f"""WITH {UNITS} SELECT doc_id, unit_no::INT AS unit_no,
  round(CASE unit_no % 3 WHEN 0 THEN 2.0 * length(unit) / (2 * length(unit) + 3) WHEN 1 THEN length(unit) / (length(unit) + 1.0) ELSE 1 END, 9)::DOUBLE AS ratio FROM u""")
def similarity(spark, d):
    """Each unit and what is made of it: three characters more, another character at the end, or the same."""
    k, unit = F.col("unit_no") % 3, F.col("unit")
    old = F.when(k == 1, F.concat(unit, F.lit("1"))).otherwise(unit)
    new = F.when(k == 0, F.concat(unit, F.lit("x1."))).when(k == 1, F.concat(unit, F.lit("2"))).otherwise(unit)
    units = documents(spark, d).select("doc_id", F.posexplode(T.split_units(F.col("text"))).alias("unit_no", "unit"))
    return units.select("doc_id", "unit_no", F.round(align.similarity(old, new), 9).alias("ratio"))


@query(f"""WITH {UNITS} SELECT doc_id, unit_no::INT AS unit_no, {escape_sql('unit')} || '<span class="deleted-word">1</span>&gt;' AS old_html,
  {escape_sql('unit')} || '<span class="added-word">2</span>&gt;' AS new_html FROM u""")
def char_diff(spark, d):
    units = documents(spark, d).select("doc_id", F.posexplode(T.split_units(F.col("text"))).alias("unit_no", "unit"))
    html = align.char_diff(F.concat("unit", F.lit("1>")), F.concat("unit", F.lit("2>")))
    return units.select("doc_id", "unit_no", html.alias("h")).select("doc_id", "unit_no", "h.*")


@query(f"{_DIFF} SELECT pair_id, seq::INT AS seq, type FROM q WHERE type <> 'equal'")
def changed_units(spark, d):
    return report.changed_units(_units(spark, d)).select("pair_id", "seq", "type")


@query(f"{_DIFF} SELECT pair_id, seq::INT AS seq FROM q WHERE contains(lower(coalesce(old, '')), 'th') OR contains(lower(coalesce(new, '')), 'th')")
def search_units(spark, d):
    return report.search_units(_units(spark, d), "TH").select("pair_id", "seq")


@query(f"""{_DIFF} SELECT DISTINCT w.query, pair_id, seq::INT AS seq FROM q, (VALUES ('TH'), (' entry 1'), ('note'), ('rev 2.'), ('90℃'), ('x')) AS w(query)
WHERE length(trim(w.query)) > 1 AND (contains(lower(coalesce(old, '')), lower(trim(w.query))) OR contains(lower(coalesce(new, '')), lower(trim(w.query))))""")
def indexed_search(spark, d):
    """The same by an index, for several queries at once."""
    path = fixtures.scratch(spark, "search")
    search.write_search_index(_units(spark, d), path)
    queries = spark.createDataFrame([(q,) for q in ("TH", " entry 1", "note", "rev 2.", "90℃", "x", "TH")], "query string")
    return search.search_all(spark, path, queries)


_NUMBERED = """n AS (SELECT *, CASE WHEN old IS NOT NULL THEN sum((old IS NOT NULL)::INT) OVER w END AS o, CASE WHEN new IS NOT NULL THEN sum((new IS NOT NULL)::INT) OVER w END AS n
  FROM {0} WINDOW w AS (PARTITION BY pair_id ORDER BY seq))"""


@query(f"{_DIFF}, {_NUMBERED.format('q')} SELECT pair_id, seq::INT AS seq, coalesce(o, 0)::BIGINT AS old_line, coalesce(n, 0)::BIGINT AS new_line FROM n")
def side_by_side(spark, d):
    rows = report.side_by_side(_units(spark, d))
    return rows.select("pair_id", "seq", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("old_line", "new_line")))


@query(f"""{_DIFF}, changed AS (SELECT pair_id, seq FROM q WHERE type <> 'equal')
SELECT pair_id, seq::INT AS seq, row_number() OVER w AS k, count(*) OVER (PARTITION BY pair_id) AS n, coalesce(lag(seq) OVER w, max(seq) OVER (PARTITION BY pair_id))::INT AS previous_seq,
  coalesce(lead(seq) OVER w, min(seq) OVER (PARTITION BY pair_id))::INT AS next_seq
FROM changed WINDOW w AS (PARTITION BY pair_id ORDER BY seq)""")
def diff_navigation(spark, d):
    return report.diff_navigation(_units(spark, d))


_CELL = """'<td>' || coalesce({n}::INT::VARCHAR, '') || '</td><td class="' || CASE WHEN {n} IS NULL THEN 'empty' WHEN type = 'equal' THEN '' ELSE type END || '">'
  || coalesce({side}_html, '&nbsp;') || '</td>'"""
_ROWS = f"""{_MARKED}, {_NUMBERED.format('m')},
rws AS (SELECT pair_id, seq, type, CASE WHEN type = 'equal' THEN '<tr>' ELSE '<tr data-diff="' || type || '">' END
  || {_CELL.format(n='o', side='old')} || {_CELL.format(n='n', side='new')} || '</tr>' AS row_html FROM n)"""


@query(f"{_ROWS} SELECT pair_id, seq::INT AS seq, row_html FROM rws")
def report_rows(spark, d):
    return report.report_rows(_units(spark, d)).select("pair_id", "seq", F.col("row").alias("row_html"))


# Names with characters that have to be escaped.
_HTML = f"""{_ROWS}, {SIDES},
st AS (SELECT pair_id, {_STATS}, string_agg(row_html, chr(10) ORDER BY seq) AS rows FROM rws GROUP BY pair_id)
SELECT labels.pair_id, '<!DOCTYPE html><html><title>old &lt;' || labels.pair_id || '&gt; / new &amp; ' || labels.pair_id || '</title><body style="background:#1e1e1e;color:#d4d4d4"><h1>old &lt;'
  || labels.pair_id || '&gt; / new &amp; ' || labels.pair_id || '</h1><p>+' || coalesce(additions, 0) || ' -' || coalesce(deletions, 0) || ' ~' || coalesce(modifications, 0) || ' =' || coalesce(unchanged, 0)
  || ', ' || coalesce(total, 0) || ' units, ' || coalesce(diff_count, 0) || ' differences</p><p>' || label || '</p><table>' || coalesce(rows, '') || '</table></body></html>' AS html
FROM labels LEFT JOIN st USING (pair_id)"""


def _titles(spark, d):
    name = lambda a, b: F.concat(F.lit(a), F.col("pair_id").cast("string"), F.lit(b))
    return fixtures.labels(documents(spark, d)).select("pair_id", name("old <", ">").alias("old_name"), name("new & ", "").alias("new_name"), F.col("label").alias("provenance"))


def _reports(spark, d):
    return report.render_reports(_units(spark, d), _titles(spark, d))


@query(_HTML)
def render_reports(spark, d):
    return _reports(spark, d)


@query(_HTML)
def stored_reports(spark, d):
    """The reports as they come back from their table."""
    path = fixtures.scratch(spark, "reports")
    write_reports(_reports(spark, d), path)
    return spark.read.parquet(path)


@query(f"""{_ROWS}, {SIDES},
st AS (SELECT pair_id, {_STATS} FROM rws GROUP BY pair_id),
ch AS (SELECT pair_id, seq // 50 + 1 AS chunk_no, CASE WHEN seq // 50 > 0 THEN chr(10) ELSE '' END || string_agg(row_html, chr(10) ORDER BY seq) AS html FROM rws GROUP BY pair_id, seq // 50),
al AS (SELECT pair_id, chunk_no, html FROM ch
  UNION ALL SELECT labels.pair_id, 0, '<!DOCTYPE html><html><title>old &lt;' || labels.pair_id || '&gt; / new &amp; ' || labels.pair_id
    || '</title><body style="background:#1e1e1e;color:#d4d4d4"><h1>old &lt;' || labels.pair_id || '&gt; / new &amp; ' || labels.pair_id || '</h1><p>+' || coalesce(additions, 0)
    || ' -' || coalesce(deletions, 0) || ' ~' || coalesce(modifications, 0) || ' =' || coalesce(unchanged, 0) || ', ' || coalesce(total, 0) || ' units, ' || coalesce(diff_count, 0)
    || ' differences</p><p>' || label || '</p><table>' FROM labels LEFT JOIN st USING (pair_id)
  UNION ALL SELECT labels.pair_id, coalesce(max(chunk_no), 0) + 1, '</table></body></html>' FROM labels LEFT JOIN ch USING (pair_id) GROUP BY labels.pair_id)
SELECT pair_id, chunk_no::BIGINT AS chunk_no, html FROM al""")
def report_chunks(spark, d):
    return report.report_chunks(_units(spark, d), _titles(spark, d), rows_a_chunk=50)


@query("SELECT doc_id AS pair_id, true AS old_found, EXISTS (SELECT 1 FROM documents b WHERE b.doc_id = a.doc_id + 7) AS new_found FROM documents a")
def resolve_pairs(spark, d):
    docs = documents(spark, d)
    return metrics.resolve_pairs(docs.select(F.col("doc_id").alias("pair_id"), F.col("doc_id").alias("old_doc_id"), (F.col("doc_id") + 7).alias("new_doc_id")), docs)


@query(f"""{_DIFF}, {SIDES}, s AS (SELECT pair_id, {_STATS} FROM q GROUP BY pair_id)
SELECT label, count(*) AS pairs, sum(additions)::BIGINT AS additions, sum(deletions)::BIGINT AS deletions, sum(modifications)::BIGINT AS modifications,
  sum(unchanged)::BIGINT AS unchanged FROM s JOIN labels USING (pair_id) GROUP BY label""")
def label_counters(spark, d):
    stats = metrics.diff_stats(_units(spark, d))
    return metrics.label_counters(stats.join(fixtures.labels(documents(spark, d)), "pair_id"))


@query(f"""{_DIFF}, {SIDES}, s AS (SELECT pair_id, {_STATS} FROM q GROUP BY pair_id)
SELECT pair_id, label, total > 15 AS enough_units, additions + deletions <= 4 AS unpaired_ok, diff_count <= 6 AS diffs_ok FROM s JOIN labels USING (pair_id)""")
def regression_gate(spark, d):
    labels = fixtures.labels(documents(spark, d))
    stats = metrics.diff_stats(_units(spark, d)).join(labels, "pair_id")
    limits = labels.select("label").distinct().select("label", F.lit(15).alias("min_units"), F.lit(4).alias("max_unpaired"), F.lit(6).alias("max_diffs"))
    return metrics.regression_gate(stats, limits)


@query(f"{_DIFF} SELECT documents.doc_id AS pair_id, {_STATS} FROM documents LEFT JOIN q ON pair_id = documents.doc_id GROUP BY documents.doc_id")
def stored_units(spark, d):
    """Counters from units that are kept by content: the second call computes only what is new."""
    pairs, layouts = fixtures.revisions(documents(spark, d))
    texts = layout.document_text(layouts)
    store = UnitStore(spark, fixtures.scratch_name("units"), fixtures.scratch(spark, "units"), buckets=8)
    store.put(texts.filter("doc_id % 4 < 2"))
    store.put(texts)
    return align.compare_counts(pairs, store.units())


@query(f"""{_DIFF}, {SIDES}, s AS (SELECT pair_id, {_STATS} FROM q GROUP BY pair_id),
a AS (SELECT l.pair_id, label, coalesce(additions, 0) AS additions, coalesce(deletions, 0) AS deletions, coalesce(modifications, 0) AS modifications, coalesce(unchanged, 0) AS unchanged
  FROM labels l LEFT JOIN s USING (pair_id) WHERE l.pair_id % 11 <> 3)
SELECT label, count(*) AS pairs, sum(additions)::BIGINT AS additions, sum(deletions)::BIGINT AS deletions, sum(modifications)::BIGINT AS modifications,
  sum(unchanged)::BIGINT AS unchanged FROM a GROUP BY label""")
def maintained_counters(spark, d):
    """Counters by label after a load with other figures for every third pair, their correction, a removal, and a replay."""
    docs = documents(spark, d)
    stats = align.compare_counts(*_sides(spark, d)).join(fixtures.labels(docs), "pair_id").select("pair_id", "label", *COUNTERS)
    store = DiffStore(spark, fixtures.scratch(spark, "counters"))
    third = F.col("pair_id") % 3 == 0
    store.commit("load", stats.withColumn("additions", F.when(third, F.col("additions") + 7).otherwise(F.col("additions"))))
    store.commit("mend", stats.filter(third), stats.filter("pair_id % 11 = 3 and pair_id % 3 <> 0").select("pair_id"))
    store.commit("drop", stats.limit(0), stats.filter("pair_id % 11 = 3").select("pair_id"))
    store.commit("mend", stats.filter(third))
    return store.labels()


@query(f"""WITH {UNITS},
n AS (SELECT doc_id, count(*) AS n, doc_id % count(*) AS c FROM u GROUP BY doc_id),
m AS (SELECT u.doc_id, unit_no AS i, n, c, c >= n - c AS first_stays, unit_no < c AS first FROM u JOIN n USING (doc_id))
SELECT doc_id AS pair_id, 'equal' AS type, i::INT AS old_no, (CASE WHEN first THEN n - c + i ELSE i - c END)::INT AS new_no FROM m WHERE first = first_stays
UNION ALL SELECT doc_id, 'deleted', i::INT, NULL FROM m WHERE first <> first_stays
UNION ALL SELECT doc_id, 'added', NULL, (CASE WHEN first THEN n - c + i ELSE i - c END)::INT FROM m WHERE first <> first_stays""")
def moved_units(spark, d):
    """Units that repeat, and of which one part moved: the longer part stays, of equal ones the first; the other
    goes and comes."""
    return align.compare_pairs(*fixtures.moved_units(documents(spark, d))).select("pair_id", "type", "old_no", "new_no")


@query(f"WITH {UNITS} SELECT doc_id AS pair_id, count(*) AS modifications, count(*) AS total FROM u GROUP BY doc_id")
def changed_blocks(spark, d):
    """Pairs of which each is one block of changed units, as large as the square of its units."""
    counts = align.compare_counts(*fixtures.changed_units(documents(spark, d)))
    return counts.filter("total > 0").select("pair_id", "modifications", "total")
