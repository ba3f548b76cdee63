import json

import pytest
from pyspark.sql import functions as F

from docdelta.operators import coverage, geometry, layout
from docdelta.plans import layout_queries
from docdelta.sources import layouts

BLOCK = lambda y, text, **more: {"type": "text", "bbox": [0, y, 9, y + 10], "lines": [{"bbox": [0, y, 9, y + 10], "spans": [{"type": "text", "content": text}]}]} | more


def parsed(spark, pages):
    return layouts.parse_layouts(spark.createDataFrame([(1, json.dumps({"pdf_info": pages}))], "doc_id long, j string"), "j")


def text_of(spark, pages, regions=None, lines=None):
    r = spark.createDataFrame(regions, "doc_id long, page_idx int, y_top double, y_bottom double") if regions else None
    n = spark.createDataFrame(lines, "doc_id long, page_idx int, line_no int, text string") if lines else None
    return layout.document_text(parsed(spark, pages), r, n).first().text


def test_order_and_selection(spark):
    nested = {"type": "list", "bbox": [0, 5, 9, 6], "blocks": [{"type": "text", "lines": [{"spans": [{"type": "text", "content": "in list"}]}]}]}
    page = {"para_blocks": [BLOCK(30, "c"), BLOCK(20, "b", index=2), BLOCK(20, "a", index=1), BLOCK(1, "no", type="image"), nested], "discarded_blocks": [BLOCK(20, "z", index=1), BLOCK(0, " top ")]}
    assert text_of(spark, [page]) == "top in list a z b c"
    assert text_of(spark, []) == ""


def test_regions_touch_and_missing_boxes(spark):
    free = {"type": "text", "lines": [{"spans": [{"type": "text", "content": "free"}]}]}
    page = {"page_idx": 0, "para_blocks": [BLOCK(0, "above"), BLOCK(10, "in"), BLOCK(20, "below"), free]}
    assert text_of(spark, [page], [(1, 0, 10.0, 20.0)]) == "free in"


def test_table_rows_start(spark):
    html = "<table><tr><td>skip</td></tr><tr><td>12 bolts</td></tr><tr><td>end</td></tr></table>"
    page = {"page_idx": 0, "para_blocks": [{"type": "table", "blocks": [{"type": "t", "lines": [{"spans": [{"type": "table", "html": html}]}]}]}]}
    assert text_of(spark, [page], [(1, 0, 0.0, 99.0)], [(1, 0, 0, "ab"), (1, 0, 1, "12 bolts")]) == "12 bolts end"
    assert text_of(spark, [page], [(1, 0, 0.0, 99.0)], [(1, 0, 0, "absent")]) == "skip 12 bolts end"
    assert text_of(spark, [page]) == "skip 12 bolts end"


def test_page_ranges():
    assert layout.parse_page_range("3") == (3, 3) and layout.parse_page_range("2-5") == (2, 5)
    with pytest.raises(ValueError):
        layout.parse_page_range("5-2")


def test_coverage(spark):
    words = " ".join(f"w{i} 阀" for i in range(100))
    truth = spark.createDataFrame([(1, words), (2, words), (3, ""), (4, None)], "doc_id long, text string")
    part = spark.createDataFrame([(1, words), (2, words[: len(words) // 2])], "doc_id long, text string")
    rows = {r.doc_id: r for r in coverage.coverage(truth, part).collect()}
    assert rows[1].recall == 1 and not rows[1].low and rows[2].recall < 0.95 and rows[2].low
    assert rows[3].recall is None and rows[3].missing == 0 and rows[4].total == 0


def lines_of(rows):
    """Greedy lines by the first fragment's baseline, in plain Python."""
    out = []
    for r in sorted((r for r in rows if r["str"].strip()), key=lambda r: (r["baseline"], r["x"], r["frag_no"])):
        if out and abs(r["baseline"] - out[-1][0]["baseline"]) <= 2.5:
            out[-1].append(r)
        else:
            out.append([r])
    texts = []
    for line in out:
        line.sort(key=lambda r: (r["x"], r["baseline"], r["frag_no"]))
        text = ""
        for k, r in enumerate(line):
            if k and r["x"] - line[k - 1]["right"] > 1 and r["str"][0] != " " and line[k - 1]["str"][-1] != " ":
                text += " "
            text += r["str"]
        texts.append(text.strip())
    return texts


def test_fragments(spark):
    rows = [(1, 0, i, s, x, x + 10, b) for i, (s, x, b) in enumerate([("a", 0.0, 10.0), ("b", 11.0, 12.0), ("c", 22.1, 14.0), ("d", 5.0, 12.6), (" ", 0.0, 30.0), ("e ", 0.0, 40.0), ("f", 30.0, 40.0), ("g\t", 0.0, 60.0), ("h", 30.0, 60.0)])]
    df = spark.createDataFrame(rows, "doc_id long, page_idx int, frag_no int, str string, x double, right double, baseline double").withColumn("bbox", F.array("x", "baseline", "right", "baseline"))
    got = [r.text for r in geometry.fragments_to_lines(df).orderBy("line_no").collect()]
    assert got == lines_of([r.asDict() for r in df.collect()]) == ["ab", "d c", "e f", "g\t h"]


def test_fragment_matrix(spark):
    df = spark.createDataFrame([([1.0, 0.0, 0.0, -1.0, 0.0, 100.0], [2.0, 0.0, 0.0, 8.0, 10.0, 20.0], 30.0, 0.0)], "v array<double>, m array<double>, width double, height double")
    f = df.select(geometry.to_fragment("m", "v").alias("f")).first().f
    assert (f.x, f.right, f.baseline, f.bbox) == (10.0, 40.0, 80.0, [10.0, 72.0, 40.0, 80.0])


def test_crop_margins_of_pages_of_other_sizes(spark):
    """Later pages, and a first page without lines, take the margins that were measured in page 2."""
    pages = spark.createDataFrame([(1, 0, 700.0, 900.0), (1, 1, 612.0, 792.0), (1, 2, 800.0, 1000.0), (2, 0, 700.0, 900.0), (2, 1, 612.0, 792.0), (3, 0, 612.0, 792.0)], "doc_id long, page_idx int, width double, height double")
    found = spark.createDataFrame([(1, 1, 10.0, 20.0, 500.0, 700.0), (2, 0, 11.0, 21.0, 600.0, 800.0), (2, 1, 10.0, 20.0, 500.0, 700.0), (3, 0, 1.0, 1.0, 2.0, 2.0)], "doc_id long, page_idx int, left double, top double, right double, bottom double")
    got = {(r.doc_id, r.page_idx): tuple(round(x, 2) for x in r[2:]) for r in geometry.crop_boxes(pages, found).collect()}
    second = (10.56, 20.2, 112.74, 94.0)
    assert got == {(1, 0): second, (1, 1): second, (1, 2): second, (2, 0): (11.56, 21.2, 100.74, 102.0), (2, 1): second}


def test_spans_and_layouts_from_files(spark, tmp_path):
    page = {"page_idx": 0, "para_blocks": [BLOCK(1, "one")], "discarded_blocks": []}
    (tmp_path / "a.json").write_text(json.dumps({"_backend": "hybrid", "_version_name": "2.7", "pdf_info": [page]}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"pdf_info": [page, page | {"page_idx": 1}]}, indent=1))
    read = layouts.read_layouts(spark, str(tmp_path / "*.json"))
    layouts.write_layout_spans(layout.layout_spans(read), str(tmp_path / "spans"))
    back = spark.read.parquet(str(tmp_path / "spans")).select("doc_id", "backend", "version", "page_no", "content").collect()
    assert sorted((r.doc_id[-6:], r.backend, str(r.version), r.page_no, r.content) for r in back) == [
        ("a.json", "hybrid", "2.7", 0, "one"), ("b.json", "unknown", "unknown", 0, "one"), ("b.json", "unknown", "unknown", 1, "one"),
    ]
    cut = {r.doc_id[-6:]: [p.page_idx for p in r.pdf_info] for r in layout.slice_layouts(read, "2").collect()}
    assert cut == {"b.json": [0]}
    assert [(r.doc_id[-6:], r.n_pages) for r in layout.short_layouts(read, "2").collect()] == [("a.json", 1)]


def test_truth_of_pages_with_and_without_region(spark):
    whole = spark.createDataFrame([(1, 0, "head a foot"), (1, 1, "b")], "doc_id long, page_idx int, text string")
    lines = spark.createDataFrame([(1, 0, 0, "a"), (1, 1, 0, "not")], "doc_id long, page_idx int, line_no int, text string")
    regions = spark.createDataFrame([(1, 0, 1.0, 9.0)], "doc_id long, page_idx int, y_top double, y_bottom double")
    assert coverage.truth_text(whole, lines, regions).first().text == "a b"


def test_every_document_is_sliced(spark):
    """A range that goes beyond a document takes the pages that lie in it; no document is left out."""
    tables = "/root/testdata/sf0.001"
    ids = {r.doc_id for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id").collect()}
    got = {r.doc_id: r.text for r in layout_queries.slice_layouts(spark, tables).collect()}
    short = {r.doc_id: r.n_pages for r in layout_queries.short_layouts(spark, tables).collect()}
    assert set(got) == ids and short
    assert all(got[i] == "" for i, n in short.items() if n < 2) and any(got[i] for i, n in short.items() if n == 2)
