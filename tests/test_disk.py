"""What a comparison leaves on disk and moves through shuffles."""

import os

from pyspark.sql import functions as F

from docdelta import scratch
from docdelta.operators import align, layout, report, search
from docdelta.plans import fixtures
from docdelta.sources import layouts
from docdelta.sources.unit_store import UnitStore


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffled(spark):
    """Shuffle files of the session."""
    top = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for d in top for _, _, names in os.walk(str(d)) for f in names if f.startswith("shuffle_")}


def revised(spark, n):
    return spark.createDataFrame([(i, f"Open valve {i}. Close it. Then check pump {i}. " * (i % 5), "web", "en") for i in range(n)], "doc_id long, text string, source string, lang string")


def test_revisions_are_made_inside_their_rows(spark):
    _, made = fixtures.revisions(revised(spark, 40))
    assert "Exchange" not in plan(made)
    assert {r.doc_id: len(r.pdf_info) for r in made.collect()} == {2 * i + side: (3 * (i % 5) + 7) // 8 for i in range(40) for side in (0, 1)}


def test_a_stored_table_leaves_no_shuffle_files(spark):
    before = shuffled(spark)
    rows = scratch.stored(spark.range(1000).repartition(7, "id").groupBy((F.col("id") % 5).alias("k")).count(), "counted")
    assert shuffled(spark) <= before and {tuple(r) for r in rows.collect()} == {(k, 200) for k in range(5)}


def test_compared_units_have_their_line_numbers(spark):
    pairs, made = fixtures.revisions(revised(spark, 12))
    units = align.compare_pairs(pairs, align.document_units(layout.document_text(made)))
    numbered = report.side_by_side(units)
    assert "Window" not in plan(numbered)
    plain = report.side_by_side(units.drop("old_no", "new_no"))
    order = lambda df: sorted(map(str, df.select("pair_id", "seq", "type", "old_line", "new_line").collect()))
    assert order(numbered) == order(plain)


def test_a_part_of_a_pair_holds_each_gram_once(spark, tmp_path):
    units = spark.range(300).coalesce(1).select(F.lit(7).cast("long").alias("pair_id"), F.col("id").cast("int").alias("seq"), F.concat(F.lit("Repeated notice "), F.col("id") % 5).alias("old"), F.lit(None).cast("string").alias("new"))
    search.write_search_index(units, str(tmp_path), buckets=4)
    postings = spark.read.parquet(f"{tmp_path}/postings")
    assert {(r.n, r.parts) for r in postings.filter("gram = 'not'").groupBy("gram").agg(F.count("*").alias("n"), F.count_distinct("part").alias("parts")).collect()} == {(5, 5)}
    assert postings.count() < 5 * 60
    asked = spark.createDataFrame([("ICE 3",), ("d notice",), ("notice 9",)], "query string")
    got = [tuple(r) for r in search.search_all(spark, str(tmp_path), asked, buckets=4).collect()]
    want = {("ICE 3", 7, k) for k in range(300) if k % 5 == 3} | {("d notice", 7, k) for k in range(300)}
    assert set(got) == want and len(got) == len(want)


def test_kept_units_leave_no_scratch(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"Open valve {i % 30}. Then check it.") for i in range(60)], "doc_id long, text string")
    store = UnitStore(spark, "kept_without_scratch", str(tmp_path), buckets=2)
    before = shuffled(spark)
    assert store.put(docs) == 30 and store.put(docs) == 0
    assert shuffled(spark) <= before
    kept = plan(store.units())
    assert "Exchange" not in kept and "Sort" not in kept and store.units().count() == 60


def test_layout_files_lie_in_few_folders(spark, tmp_path):
    made = fixtures.layouts(revised(spark, 300))
    assert "Exchange" not in plan(made)
    layouts.write_layouts(made, f"{tmp_path}/files", folders=3)
    found = [os.path.relpath(d, tmp_path) for d, _, names in os.walk(f"{tmp_path}/files") for f in names if f.endswith(".json")]
    assert len(found) == 300 and len(set(found)) == 3
    read = layouts.read_layouts(spark, f"{tmp_path}/files", "file_id long")
    assert read.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    text = lambda df: {r.doc_id: r.text for r in layout.document_text(df).collect()}
    assert text(read.withColumn("doc_id", F.col("file_id"))) == text(made)
