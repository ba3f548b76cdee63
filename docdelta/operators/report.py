"""The side-by-side report as data, and as one HTML text per pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import html_escape


def changed_units(units: DataFrame) -> DataFrame:
    return units.filter(F.col("type") != "equal")


def search_units(units: DataFrame, query: str) -> DataFrame:
    """Units that hold the trimmed query on either side, ignoring case; queries under two characters find none."""
    q = query.strip().lower()
    if len(q) < 2:
        return units.limit(0)
    return units.filter(F.contains(F.lower(F.coalesce("old", F.lit(""))), F.lit(q)) | F.contains(F.lower(F.coalesce("new", F.lit(""))), F.lit(q)))


def side_by_side(units: DataFrame) -> DataFrame:
    """Line numbers of both sides; none on the side that a unit is absent from.

    Units that have their places on both sides, as ``compare_pairs`` gives them, are numbered by these without a
    shuffle: every unit of a side comes once, in order.
    """
    if {"old_no", "new_no"} <= set(units.columns):
        return units.withColumns({f"{side}_line": F.col(f"{side}_no").cast("long") + 1 for side in ("old", "new")})
    so_far = Window.partitionBy("pair_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    old, new = F.col("type").isin("equal", "deleted", "modified"), F.col("type").isin("equal", "added", "modified")
    number = lambda on: F.when(on, F.sum(F.when(on, 1).otherwise(0)).over(so_far))
    return units.withColumn("old_line", number(old)).withColumn("new_line", number(new))


def diff_navigation(units: DataFrame) -> DataFrame:
    """Changed units with their ordinal, their number, and the changed units before and after, wrapping round."""
    whole = Window.partitionBy("pair_id")
    ordered = whole.orderBy("seq")
    all_rows = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return changed_units(units).select(
        "pair_id", "seq", F.row_number().over(ordered).cast("long").alias("k"), F.count("*").over(whole).alias("n"),
        F.coalesce(F.lag("seq").over(ordered), F.last("seq").over(all_rows)).alias("previous_seq"), F.coalesce(F.lead("seq").over(ordered), F.first("seq").over(all_rows)).alias("next_seq"),
    )


def report_rows(units: DataFrame) -> DataFrame:
    """(pair_id, seq, row): a table row with line numbers, classes and content; an absent side is an empty cell."""
    rows = side_by_side(units)

    def cell(side: str) -> Column:
        here = F.col(f"{side}_line").isNotNull()
        kind = F.when(~here, "empty").when(F.col("type") == "equal", "").otherwise(F.col("type"))
        content = F.coalesce(F.nullif(F.when(here, F.col(f"{side}_html")), F.lit("")), F.lit("&nbsp;"))
        number = F.coalesce(F.col(f"{side}_line").cast("string"), F.lit(""))
        return F.concat(F.lit("<td>"), number, F.lit('</td><td class="'), kind, F.lit('">'), content, F.lit("</td>"))

    start = F.when(F.col("type") != "equal", F.concat(F.lit('<tr data-diff="'), F.col("type"), F.lit('">'))).otherwise("<tr>")
    return rows.select("pair_id", "seq", "type", F.concat(start, cell("old"), cell("new"), F.lit("</tr>")).alias("row"))


# Background and text colours by theme.
THEMES = {"dark": ("#1e1e1e", "#d4d4d4"), "light": ("#ffffff", "#222222")}


def _counted(units: DataFrame) -> list[Column]:
    n = lambda t: F.count_if(F.col("type") == t)
    return [n("added").alias("additions"), n("deleted").alias("deletions"), n("modified").alias("modifications"), n("equal").alias("unchanged")]


def _head(theme: str) -> Column:
    """All of a report before its rows, from its names, provenance and counters."""
    back, ink = THEMES.get(theme, THEMES["dark"])
    name = lambda c: html_escape(F.coalesce(c, F.lit("")))
    note = F.when(name("provenance") == "", "").otherwise(F.concat(F.lit("<p>"), name("provenance"), F.lit("</p>")))
    changes = F.col("additions") + F.col("deletions") + F.col("modifications")
    counters = F.format_string("<p>+%d -%d ~%d =%d, %d units, %d differences</p>", "additions", "deletions", "modifications", "unchanged", changes + F.col("unchanged"), changes)
    both = F.concat(name("old_name"), F.lit(" / "), name("new_name"))
    body = F.lit(f'</title><body style="background:{back};color:{ink}"><h1>')
    return F.concat(F.lit("<!DOCTYPE html><html><title>"), both, body, both, F.lit("</h1>"), counters, note, F.lit("<table>"))


_TAIL = "</table></body></html>"
_COUNTERS = ["additions", "deletions", "modifications", "unchanged"]


def _rows_text() -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "row"))), lambda r: r["row"]), "\n")


def render_reports(units: DataFrame, titles: DataFrame, theme: str = "dark") -> DataFrame:
    """(pair_id, html) for each row of ``titles`` (pair_id, old_name, new_name, provenance): rows in order under names,
    counters and provenance. Counters come with the rows, so ``units`` is read and shuffled once. For pairs of any
    size see ``report_chunks``."""
    body = report_rows(units).groupBy("pair_id").agg(_rows_text().alias("rows"), *_counted(units))
    joined = titles.join(body, "pair_id", "left").fillna(0, _COUNTERS)
    return joined.select("pair_id", F.concat(_head(theme), F.coalesce("rows", F.lit("")), F.lit(_TAIL)).alias("html"))


def report_chunks(units: DataFrame, titles: DataFrame, rows_a_chunk: int = 1000, theme: str = "dark") -> DataFrame:
    """(pair_id, chunk_no, html): the reports in pieces, which joined in order are what ``render_reports`` gives.

    Chunk 0 is the head with the counters, the last one the end; each between holds ``rows_a_chunk`` rows at most, so no value
    and no group grows with its pair.
    """
    chunk = F.floor(F.col("seq") / rows_a_chunk) + 1
    bodies = report_rows(units).groupBy("pair_id", chunk.alias("chunk_no")).agg(_rows_text().alias("rows"), F.min("seq").alias("first"), *_counted(units))
    totals = bodies.groupBy("pair_id").agg(*(F.sum(c).alias(c) for c in _COUNTERS), F.max("chunk_no").alias("chunks"))
    heads = titles.join(totals, "pair_id", "left").fillna(0, [*_COUNTERS, "chunks"])
    ends = heads.select("pair_id", F.inline(F.array(F.struct(F.lit(0).cast("long").alias("chunk_no"), _head(theme).alias("html")), F.struct((F.col("chunks") + 1).alias("chunk_no"), F.lit(_TAIL).alias("html")))))
    middles = bodies.join(titles.select("pair_id").distinct(), "pair_id", "left_semi")
    return ends.unionByName(middles.select("pair_id", "chunk_no", F.concat(F.when(F.col("first") > 0, "\n").otherwise(""), "rows").alias("html")))
