"""The query and the pipeline drop exact repeats of short lines too, and keep blank ones and those within an edit."""

import corpus_pipeline
from docdelta.llm import queries

ROWS = [(1, "short one\n\n  \nother\nshort one"), (2, "short one\nshort onf\n\nown"), (3, "x" * 40), (4, "y" + "x" * 40 + "\nown")]


def test_short_copies(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_lines, r.n_removed) for r in queries.op7_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (4, 1), 2: (3, 1), 3: (1, 0), 4: (1, 2)}
    left = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, str(tmp_path)).collect()}
    assert left == {1: "short one\n\n  \nother", 2: "short onf\n\nown", 3: "x" * 40}
