"""Tables that are kept up to date, the search index, reports in pieces, and pages of very many parts."""

import random

import pytest
from pyspark.sql import functions as F

from docdelta.operators import align, coverage, geometry, layout, report, search
from docdelta.sources.diff_store import COUNTERS, DiffStore
from docdelta.sources.unit_store import UnitStore


def texts(spark, n, changed=()):
    rows = [(i, f"Open valve {i % (n // 2)}. Then { 'close' if i in changed else 'check'} pump {i}. NOTE: wait") for i in range(n)]
    return spark.createDataFrame([*rows, (n, None), (n + 1, "")], "doc_id long, text string")


def test_units_are_kept_by_content(spark, tmp_path):
    store = UnitStore(spark, "kept_units", str(tmp_path), buckets=4)
    docs = texts(spark, 200)
    assert store.put(docs) == 201  # an empty text and a missing one are the same
    assert store.put(docs) == 0
    changed = texts(spark, 200, changed=(3, 77))
    assert store.put(changed) == 2
    order = lambda df: sorted(map(str, df.collect()))
    assert order(store.units()) == order(align.document_units(changed))
    assert "Exchange" not in store.units()._jdf.queryExecution().executedPlan().toString()
    again = UnitStore(spark, "kept_units", str(tmp_path), buckets=4)
    assert again.put(docs) == 0 and order(again.units()) == order(align.document_units(docs))


def test_counters_follow_changes(spark, tmp_path):
    rng = random.Random(3)
    store = DiffStore(spark, str(tmp_path / "counters"))
    now = {}
    schema = "pair_id long, label string, additions long, deletions long, modifications long, unchanged long, other int"
    for batch in range(5):
        rows = [(i, rng.choice(["a", "b", None]), *(rng.randint(0, 9) for _ in COUNTERS), 1) for i in rng.sample(range(40), 15)]
        gone = [i for i in rng.sample(range(40), 4) if i not in {r[0] for r in rows}]
        stats, removed = spark.createDataFrame(rows, schema), spark.createDataFrame([(i,) for i in gone], "pair_id long")
        assert store.commit(f"day/{batch}", stats, removed) and not store.commit(f"day/{batch}", stats.limit(0))
        now = {k: v for k, v in now.items() if k not in gone} | {r[0]: r[1:6] for r in rows}
        assert {r.pair_id: tuple(r)[1:] for r in store.pairs().collect()} == now
        want = {}
        for label, *counts in now.values():
            own = want.setdefault(label, [0] * 5)
            for k, x in enumerate([1, *counts]):
                own[k] += x
        assert {r.label: list(r)[1:] for r in store.labels().collect()} == want


def test_a_broken_batch_leaves_nothing(spark, tmp_path):
    store = DiffStore(spark, str(tmp_path / "counters"))
    stats = spark.createDataFrame([(1, "a", 1, 2, 3, 4)], "pair_id long, label string, additions long, deletions long, modifications long, unchanged long")
    with pytest.raises(Exception):
        store.commit("x", stats.withColumn("additions", F.raise_error(F.lit("lost")).cast("long")))
    assert store.batches() == [] and store.commit("x", stats) and store.pairs().first().unchanged == 4


def compared(spark, n, units_a_side=30):
    rng = random.Random(5)
    words = ["Valve", "bolt", "Pump", "öl", "90℃", "turn-left", "A<b>", "check", "x"]
    side = lambda: ". ".join("N " + " ".join(rng.choice(words) for _ in range(4)) for _ in range(units_a_side))
    docs = []
    for i in range(n):
        old = side()
        docs += [(2 * i, old), (2 * i + 1, old.replace("Pump", "pipe", 3) if i % 3 else side())]
    pairs = spark.createDataFrame([(i, 2 * i, 2 * i + 1) for i in range(n)], "pair_id long, old_doc_id long, new_doc_id long")
    return align.compare_pairs(pairs, align.document_units(spark.createDataFrame(docs, "doc_id long, text string"))).cache()


def test_index_like_a_scan(spark, tmp_path):
    units = compared(spark, 12)
    rows = [(r.pair_id, r.seq, (r.old or "").lower(), (r.new or "").lower()) for r in units.collect()]
    rng = random.Random(6)
    asked = {" b ", "x", "", "  ", "ÖL", "zz", "nothing there", "℃ "}
    while len(asked) < 1000:
        text = rng.choice(rows)[2 + rng.randrange(2)]
        k = rng.randrange(len(text)) if text else 0
        asked.add(text[k : k + rng.randint(1, 9)].upper() if rng.random() < 0.5 else text[k : k + rng.randint(1, 9)])
    search.write_search_index(units, str(tmp_path), buckets=4)
    queries = spark.createDataFrame([(q,) for q in [*asked, "ÖL"]], "query string")
    want = {(q, p, s) for q in asked for p, s, old, new in rows if len(q.strip()) > 1 and (q.strip().lower() in old or q.strip().lower() in new)}
    got = [tuple(r) for r in search.search_all(spark, str(tmp_path), queries, buckets=4).collect()]
    assert set(got) == want and len(got) == len(want)
    wide = search.search_all(spark, str(tmp_path), queries, buckets=4, broadcast_rows=10).collect()
    assert {tuple(r) for r in wide} == want
    plan = search.search_all(spark, str(tmp_path), spark.createDataFrame([("valve",)], "query string"), buckets=4)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert {(r.pair_id, r.seq) for r in report.search_units(units, " ÖL ").collect()} == {(p, s) for q, p, s in want if q == "ÖL"}


def test_pieces_join_to_reports(spark):
    units = compared(spark, 8, 55)
    titles = spark.createDataFrame([(i, f"old <{i}>", "b & c", None if i % 2 else "p") for i in range(10)], "pair_id long, old_name string, new_name string, provenance string")
    whole = {r.pair_id: r.html for r in report.render_reports(units, titles).collect()}
    for size in (1000, 7, 1):
        pieces = report.report_chunks(units, titles, size).collect()
        assert {p: "".join(r.html for r in sorted((r for r in pieces if r.pair_id == p), key=lambda r: r.chunk_no)) for p in whole} == whole
        assert all(r.html.count("<tr") <= size for r in pieces)
        for p in whole:
            numbers = sorted(r.chunk_no for r in pieces if r.pair_id == p)
            assert numbers == list(range(len(numbers)))


def test_a_page_of_many_fragments(spark):
    n = 100_000
    rows = spark.range(n).select(
        F.lit(1).cast("long").alias("doc_id"), F.lit(0).alias("page_idx"), F.col("id").cast("int").alias("frag_no"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("str"),
        (F.col("id") % 10 * 9.0).alias("x"), (F.col("id") % 10 * 9.0 + 5).alias("right"), (F.floor(F.col("id") / 10) * 5.0 + F.col("id") % 3).alias("baseline"),
    ).withColumn("bbox", F.array("x", F.col("baseline") - 3, "right", "baseline"))
    lines = geometry.fragments_to_lines(rows).orderBy("line_no").collect()
    assert len(lines) == n // 10 and lines[7].text == " ".join(f"w{70 + k}" for k in range(10)) and lines[7].bbox == [0.0, 32.0, 86.0, 37.0]


def test_line_numbers_follow_the_first_baseline(spark):
    rng = random.Random(7)
    pages = [sorted(rng.uniform(0, 30) for _ in range(rng.randint(0, 40))) for _ in range(200)]
    got = spark.createDataFrame(list(enumerate(pages)), "k long, b array<double>").select("k", geometry.line_numbers("b").alias("n")).collect()
    for r in got:
        first, number, want = None, 0, []
        for y in pages[r.k]:
            if first is None or y - first > 2.5:
                first, number = y, number + 1
            want.append(number)
        assert r.n == want


def test_a_page_of_many_segments(spark):
    anchors = spark.createDataFrame([(1, 0, "top", 0, 90.0, 60.0, 150.0, 70.0), (1, 0, "bottom", 0, 100.0, 600.0, 160.0, 610.0)], "doc_id long, page_idx int, anchor string, hit_no int, x0 double, y0 double, x1 double, y1 double")
    d = F.col("id") * 7919 % 50_000
    flat = F.col("id") % 2 == 0
    made = spark.range(50_000).select(
        F.lit(1).cast("long").alias("doc_id"), F.lit(0).alias("page_idx"), F.col("id").cast("int").alias("seg_no"), F.when(flat, 20.0 + d % 100).otherwise(161.0 + d / 100).alias("p1x"),
        F.when(flat, d / 50).otherwise(500.0 + d % 100).alias("p1y"), F.when(flat, 120.0 + d % 100).otherwise(161.0 + d / 100).alias("p2x"), F.when(flat, d / 50).otherwise(580.0 + d % 100).alias("p2y"),
    )
    rows = made.collect()
    top = min((r.p1y, r.seg_no) for r in rows if r.seg_no % 2 == 0 and r.p1y > 70 and r.p1x <= 120 <= r.p2x)
    side = min((r.p1x, r.seg_no, r.p1y) for r in rows if r.seg_no % 2 and r.p1x > 160 and r.p1y <= 605 <= r.p2y)
    got = geometry.content_regions(anchors, made).collect()
    assert [(r.y_top, r.y_bottom) for r in got] == ([(top[0], side[2])] if top[0] < side[2] else [])


def test_ranges_beyond_a_layout_are_named(spark):
    layouts = spark.range(1, 5).select(F.col("id").alias("doc_id"), F.transform(F.sequence(F.lit(1), F.col("id")), lambda k: F.struct((k - 1).cast("int").alias("page_idx"))).alias("pdf_info"))
    kept = {r.doc_id: [p.page_idx for p in r.pdf_info] for r in layout.slice_layouts(layouts, "2-3").collect()}
    assert kept == {3: [0, 1], 4: [0, 1]}
    assert {(r.doc_id, r.n_pages) for r in layout.short_layouts(layouts, "2-3").collect()} == {(1, 1), (2, 2)}


def test_bags_of_repeated_and_missing_documents(spark):
    truth = spark.createDataFrame([(1, "a a b"), (1, "a 12 12"), (2, None), (3, "é 中文"), (None, "q")], "doc_id long, text string")
    kept = spark.createDataFrame([(1, "A b b"), (4, "z"), (3, "文")], "doc_id long, text string")
    got = {(r.doc_id, r.token): (r.t, r.e) for r in coverage.bag_difference(truth, kept).collect()}
    assert got == {(1, "a"): (3, 1), (1, "b"): (1, 2), (1, "12"): (2, 0), (3, "中"): (1, 0), (3, "文"): (1, 1), (4, "z"): (0, 1), (None, "q"): (1, 0)}
    assert {r.doc_id: r.total for r in coverage.coverage(truth, kept).collect()} == {1: 6, 2: 0, 3: 2, None: 1}
    assert {(r.doc_id, r.token): r.n for r in coverage.token_bag(truth).collect()}[1, "a"] == 3
