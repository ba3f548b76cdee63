"""Layouts to text in reading order. A layout is one row, so all of it is array work without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import html_table_rows, known, strip_space

REGION = "map<int, struct<y_top: double, y_bottom: double>>"


def reading_order(page: Column) -> Column:
    """A page's blocks, kept before discarded ones, in a stable order by top edge and index; null edges count as 0."""

    def placed(blocks: Column, source: int) -> Column:
        return F.coalesce(
            F.transform(
                blocks, lambda b, i: F.struct(F.coalesce(F.get(b["bbox"], 1), F.lit(0.0)).alias("y"), F.coalesce(b["index"], F.lit(0)).alias("n"), F.lit(source).alias("s"), i.alias("i"), b.alias("b"))
            ),
            F.array(),
        )

    return F.transform(F.array_sort(F.concat(placed(page["para_blocks"], 0), placed(page["discarded_blocks"], 1))), lambda x: x["b"])


def block_lines(block: Column) -> Column:
    """Lines of a block; lists and tables hold them one level down."""
    nested = F.flatten(F.transform(block["blocks"], lambda b: F.coalesce(b["lines"], F.array())))
    return F.coalesce(F.when(block["type"].isin("list", "table"), nested).otherwise(block["lines"]), F.array())


def in_region(bbox: Column, region: Column) -> Column:
    """Whether a line overlaps the region; touching is out, and without a box or a region it stays."""
    whole = region.isNull() | bbox.isNull() | (F.size(bbox) < 4)
    return whole | ((F.get(bbox, 3) > region["y_top"]) & (F.get(bbox, 1) < region["y_bottom"]))


def table_start_row(rows: Column, lines: Column) -> Column:
    """The place (from 0) of the first row that holds the keyword of the page's first line."""
    key = F.get(F.filter(F.transform(lines, strip_space), lambda x: F.length(x) > 2), 0)
    digits, letters = F.regexp_extract(key, r"(?U)^\d+", 0), F.regexp_extract(key, r"^[A-Za-z]+", 0)
    word = F.when(digits != "", digits).when(letters != "", letters).otherwise(F.substring(key, 1, 5))
    return F.coalesce(F.greatest(F.array_position(F.transform(rows, lambda r: F.contains(r, word)), True) - 1, F.lit(0)), F.lit(0)).cast("int")


def span_pieces(span: Column, region: Column, lines: Column) -> Column:
    """Texts of a span: its content, or the rows of its table."""
    content = F.filter(F.array(strip_space(F.coalesce(span["content"], F.lit("")))), lambda x: x != "")
    rows = html_table_rows(F.coalesce(span["html"], F.lit("")))
    cut = F.when(region.isNotNull() & (F.size(F.coalesce(lines, F.array().cast("array<string>"))) > 0), F.slice(rows, table_start_row(rows, lines) + 1, F.greatest(F.size(rows), F.lit(1)))).otherwise(rows)
    return F.when(span["type"].isin("text", "inline_equation"), content).when(span["type"] == "table", cut).otherwise(F.array().cast("array<string>"))


def page_pieces(page: Column, region: Column, lines: Column) -> Column:
    shown = F.filter(reading_order(page), lambda b: F.coalesce(b["type"] != "image", F.lit(True)))
    of_line = lambda x: F.flatten(F.transform(F.coalesce(x["spans"], F.array()), lambda s: span_pieces(s, region, lines)))
    return F.flatten(F.transform(shown, lambda b: F.flatten(F.transform(F.filter(block_lines(b), lambda x: in_region(x["bbox"], region)), of_line))))


def document_text(layouts: DataFrame, regions: DataFrame | None = None, page_lines: DataFrame | None = None) -> DataFrame:
    """(doc_id, text, n_chars): all pieces in reading order, joined by a blank.

    ``regions`` (doc_id, page_idx, y_top, y_bottom) and ``page_lines`` (doc_id, page_idx, line_no, text) join once, as maps.
    """
    rows = layouts
    if regions is not None:
        maps = regions.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("page_idx", F.struct("y_top", "y_bottom")))).alias("_regions"))
        rows = rows.join(maps, "doc_id", "left")
    else:
        rows = rows.withColumn("_regions", F.lit(None).cast(REGION))
    if page_lines is not None:
        by_page = page_lines.groupBy("doc_id", "page_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]).alias("lines"))
        rows = rows.join(by_page.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("page_idx", "lines"))).alias("_lines")), "doc_id", "left")
    else:
        rows = rows.withColumn("_lines", F.lit(None).cast("map<int, array<string>>"))
    at = lambda m, p: F.try_element_at(F.col(m), F.coalesce(p["page_idx"], F.lit(0)))
    text = F.array_join(F.flatten(F.transform("pdf_info", lambda p: page_pieces(p, at("_regions", p), at("_lines", p)))), " ")
    return rows.select("doc_id", F.coalesce(text, F.lit("")).alias("text")).withColumn("n_chars", F.length("text"))


def layout_spans(layouts: DataFrame) -> DataFrame:
    """One row per span in reading order: engine and version, places, block type, box of the line, and the span."""
    who = ["doc_id", known(F.col("_backend")).alias("backend"), known(F.col("_version_name")).alias("version")]
    pages = layouts.select(*who, F.posexplode("pdf_info").alias("page_no", "p"))
    keys = ["doc_id", "backend", "version", "page_no"]
    blocks = pages.select(*keys, F.posexplode(reading_order(F.col("p"))).alias("block_no", "b"))
    keys += ["block_no", "block_type"]
    lines = blocks.withColumn("block_type", F.col("b.type")).select(*keys, F.posexplode(block_lines(F.col("b"))).alias("line_no", "l"))
    spans = lines.select(*keys, "line_no", F.col("l.bbox").alias("bbox"), F.posexplode("l.spans").alias("span_no", "s"))
    return spans.select(*keys, "line_no", "bbox", "span_no", "s.type", "s.content", "s.html")


def parse_page_range(text: str) -> tuple[int, int]:
    """``n`` or ``a-b``, from 1."""
    first, _, last = text.strip().partition("-")
    a = int(first)
    b = int(last) if last else a
    if not 1 <= a <= b:
        raise ValueError(f"not a page range: {text}")
    return a, b


def slice_pages(pages: DataFrame, text: str) -> DataFrame:
    """Pages (doc_id, page_idx) of an inclusive range, numbered from 0 again."""
    a, b = parse_page_range(text)
    return pages.filter(F.col("page_idx").between(a - 1, b - 1)).withColumn("page_idx", F.col("page_idx") - (a - 1))


def short_documents(pages: DataFrame, text: str) -> DataFrame:
    """(doc_id, n_pages) of the documents that a range goes beyond: an error for them."""
    _, b = parse_page_range(text)
    return pages.groupBy("doc_id").agg((F.max("page_idx") + 1).alias("n_pages")).filter(F.col("n_pages") < b)


def short_layouts(layouts: DataFrame, text: str) -> DataFrame:
    """(doc_id, n_pages) of the layouts that a range goes beyond: an error for them."""
    _, b = parse_page_range(text)
    return layouts.select("doc_id", F.size(F.coalesce("pdf_info", F.array())).cast("long").alias("n_pages")).filter(F.col("n_pages") < b)


def slice_layouts(layouts: DataFrame, text: str, short: bool = False) -> DataFrame:
    """Layouts with the pages of an inclusive range only, numbered from 0 again.

    A layout that the range goes beyond is an error, which ``short_layouts`` names: it is left out, or with ``short``
    kept with those of its pages that lie in the range, which may be none.
    """
    a, b = parse_page_range(text)
    number = lambda p: F.coalesce(p["page_idx"], F.lit(0))
    kept = F.filter("pdf_info", lambda p: number(p).between(a - 1, b - 1))
    whole = layouts if short else layouts.filter(F.size("pdf_info") >= b)
    return whole.withColumn("pdf_info", F.transform(kept, lambda p: p.withField("page_idx", number(p) - (a - 1))))
