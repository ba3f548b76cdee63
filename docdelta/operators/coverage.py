"""Extraction coverage: token bags of the text layer against those of the extraction."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Alarm threshold, and the fewest truth tokens that allow a figure.
LOW, LEAST = 0.95, 200


_TOKEN = re.compile(r"[一-鿿]|[A-Za-z]+|\d+")


@F.arrow_udf(T.MapType(T.StringType(), T.IntegerType()))
def text_bag(texts: pa.Array) -> pa.Array:
    """The bag of a text as one value: how often each token stands in it, by token. A null text has an empty one."""
    bags = (Counter(map(str.lower, _TOKEN.findall(x or ""))) for x in texts.to_pylist())
    return pa.array([sorted(bag.items()) for bag in bags], pa.map_(pa.string(), pa.int32()))


def _added(bags: Column) -> Column:
    """One bag for a list of bags."""
    both = lambda a, b: F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))
    return F.when(F.size(bags) == 1, F.get(bags, 0)).otherwise(F.aggregate(bags, F.create_map().cast("map<string,int>"), both))


def _bags(texts: DataFrame, side: str) -> DataFrame:
    return texts.select("doc_id", F.lit(side).alias("side"), text_bag("text").alias("bag"))


def token_bag(texts: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, token, n) of the texts; rows of one document count together."""
    bags = texts.select("doc_id", text_bag(text).alias("bag")).groupBy("doc_id").agg(F.collect_list("bag").alias("bags"))
    return bags.select("doc_id", F.explode(_added(F.col("bags"))).alias("token", "n")).withColumn("n", F.col("n").cast("long"))


def document_bags(truth: DataFrame, extracted: DataFrame) -> DataFrame:
    """(doc_id, there, both): the two bags of a document merged inside its row, token -> (t, e); ``there`` if ``truth`` has it.

    A text becomes one value of sorted counts where it is read. What is shuffled, once and by document, are these
    values, never tokens.
    """
    rows = _bags(truth, "t").unionByName(_bags(extracted, "e")).groupBy("doc_id").agg(F.collect_list(F.struct("side", "bag")).alias("s"))
    of = lambda side: _added(F.transform(F.filter("s", lambda x: x["side"] == side), lambda x: x["bag"]))
    count = lambda x: F.coalesce(x, F.lit(0)).cast("long")
    both = F.map_zip_with(of("t"), of("e"), lambda _, t, e: F.struct(count(t).alias("t"), count(e).alias("e")))
    return rows.select("doc_id", F.exists("s", lambda x: x["side"] == "t").alias("there"), both.alias("both"))


def bag_difference(truth: DataFrame, extracted: DataFrame) -> DataFrame:
    """(doc_id, token, t, e): both counts of every token."""
    rows = document_bags(truth, extracted).select("doc_id", F.explode("both").alias("token", "n"))
    return rows.select("doc_id", "token", "n.t", "n.e")


def missing_tokens(difference: DataFrame) -> DataFrame:
    """(doc_id, token, missing) of what the extraction lost."""
    return difference.filter("t > e").select("doc_id", "token", (F.col("t") - F.col("e")).alias("missing"))


def coverage(truth: DataFrame, extracted: DataFrame) -> DataFrame:
    """doc_id, recall, missing, total, low for each document of ``truth``; no figure below LEAST tokens."""
    counts = F.map_values("both")
    total = lambda of: F.aggregate(F.transform(counts, of), F.lit(0).cast("long"), lambda a, x: a + x)
    sums = document_bags(truth, extracted).filter("there").select("doc_id", total(lambda n: n["t"]).alias("total"), total(lambda n: F.greatest(n["t"] - n["e"], F.lit(0))).alias("lost"))
    known, enough = sums, F.col("total") >= LEAST
    recall = F.when(enough, (F.col("total") - F.col("lost")) / F.col("total"))
    return known.select("doc_id", recall.alias("recall"), F.when(enough, F.col("lost")).otherwise(0).cast("long").alias("missing"), "total", F.coalesce(recall < LOW, F.lit(False)).alias("low"))


def coverage_message(figures: DataFrame) -> DataFrame:
    """(doc_id, message) in words."""
    text = F.concat(F.format_string("coverage %.1f%%", F.round(F.col("recall") * 100, 1)), F.format_string(" (missing %d/%d tokens)", "missing", "total"), F.when(F.col("low"), " low: content may be lost").otherwise(""))
    return figures.select("doc_id", F.when(F.col("recall").isNull(), "no text layer, skipped").otherwise(text).alias("message"))


def truth_text(page_text: DataFrame, page_lines: DataFrame, regions: DataFrame) -> DataFrame:
    """(doc_id, text) of the text layer: in-region lines of pages with a region, whole pages otherwise."""
    inside = page_lines.join(regions.select("doc_id", "page_idx"), ["doc_id", "page_idx"], "left_semi").select("doc_id", "page_idx", "line_no", "text")
    whole = page_text.join(regions.select("doc_id", "page_idx"), ["doc_id", "page_idx"], "left_anti").select("doc_id", "page_idx", F.lit(0).alias("line_no"), "text")
    parts = inside.unionByName(whole).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_idx", "line_no", "text"))).alias("p"))
    return parts.select("doc_id", F.array_join(F.transform("p", lambda x: x["text"]), " ").alias("text"))
