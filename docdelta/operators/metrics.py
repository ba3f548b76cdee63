"""Counters of diffs, and figures by extraction engine and version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff_stats(units: DataFrame) -> DataFrame:
    """Counters of each pair from its diff units."""
    n = lambda t: F.count_if(F.col("type") == t)
    return units.groupBy("pair_id").agg(
        n("added").alias("additions"), n("deleted").alias("deletions"), n("modified").alias("modifications"), n("equal").alias("unchanged"),
        F.count("*").alias("total"), F.count_if(F.col("type") != "equal").alias("diff_count"),
    )


def resolve_pairs(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """pair_id, old_found, new_found: a pair needs both."""
    ids = docs.select("doc_id").distinct()
    old = ids.select(F.col("doc_id").alias("old_doc_id"), F.lit(True).alias("old_found"))
    new = ids.select(F.col("doc_id").alias("new_doc_id"), F.lit(True).alias("new_found"))
    joined = pairs.join(old, "old_doc_id", "left").join(new, "new_doc_id", "left")
    return joined.select("pair_id", F.coalesce("old_found", F.lit(False)).alias("old_found"), F.coalesce("new_found", F.lit(False)).alias("new_found"))


def extraction_scorecard(docs: DataFrame, figures: DataFrame | None = None) -> DataFrame:
    """Per backend and version: documents, characters, LaTeX artefacts, from (doc_id, backend, version, text), and with
    ``figures`` (doc_id, recall) the mean recall of the documents that have one."""
    latex = F.regexp_count("text", F.lit(r"\\(sim|cdot|circ|math)"))
    rows = docs.select("doc_id", "backend", "version", F.length("text").alias("n"), latex.alias("artefacts"))
    sums = [F.count("*").alias("documents"), F.sum("n").alias("characters"), F.sum("artefacts").alias("artefacts")]
    if figures is not None:
        rows, sums = rows.join(figures.select("doc_id", "recall"), "doc_id", "left"), [*sums, F.avg("recall").alias("mean_recall")]
    return rows.groupBy("backend", "version").agg(*sums)


def label_counters(stats: DataFrame) -> DataFrame:
    """Sums of diff counters by provenance label (pair_id, label, counters): only those of one label compare."""
    return stats.groupBy("label").agg(F.count("*").alias("pairs"), *(F.sum(c).alias(c) for c in ("additions", "deletions", "modifications", "unchanged")))


def keyword_counts(docs: DataFrame, words: list[str]) -> DataFrame:
    """backend, word, n: occurrences of each word of a short list, in one pass over the texts."""
    length = lambda x: F.length(x)
    counts = F.array(*(F.struct(F.lit(w).alias("word"), F.floor((length(F.col("text")) - length(F.replace("text", F.lit(w), F.lit("")))) / len(w)).cast("long").alias("n")) for w in words))
    return docs.select("backend", F.explode(counts).alias("c")).groupBy("backend", "c.word").agg(F.sum("c.n").alias("n"))


def regression_gate(stats: DataFrame, baseline: DataFrame) -> DataFrame:
    """Checks of (pair_id, label, counters) against the limits of the same label."""
    joined = stats.join(baseline, "label")
    return joined.select(
        "pair_id", "label", (F.col("total") > F.col("min_units")).alias("enough_units"),
        (F.col("additions") + F.col("deletions") <= F.col("max_unpaired")).alias("unpaired_ok"), (F.col("diff_count") <= F.col("max_diffs")).alias("diffs_ok"),
    )
