"""Layout files and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import shuffles_go

_LINE = "struct<bbox: array<double>, spans: array<struct<type: string, content: string, html: string>>>"
_BLOCK = f"struct<type: string, bbox: array<double>, index: int, lines: array<{_LINE}>, blocks: array<struct<type: string, lines: array<{_LINE}>>>>"
PAGES = f"array<struct<page_idx: int, page_size: array<double>, para_blocks: array<{_BLOCK}>, discarded_blocks: array<{_BLOCK}>>>"
LAYOUT = f"_backend string, _version_name string, pdf_info {PAGES}"


def read_layouts(spark: SparkSession, path: str, own: str | None = None) -> DataFrame:
    """One layout JSON per file, in a folder with its folders or by a pattern; the file's path is its doc_id.

    Files that say themselves which document they are have their field ``own`` ("file_id long") too. Files are small,
    so a task takes many of them.
    """
    schema = LAYOUT if own is None else f"{LAYOUT}, {own}"
    read = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    parts, cores = read.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism
    found = read.select(F.col("_metadata.file_path").alias("doc_id"), "*")
    return found if parts <= 4 * cores else found.coalesce(max(4 * cores, parts // 32))


def write_layouts(layouts: DataFrame, path: str, folders: int = 64) -> None:
    """One JSON file for each layout (doc_id as file_id, and its columns), dealt to ``folders`` folders by document.

    Tasks put their files into place themselves, as the driver would have to move one after the other.
    """
    rows = layouts.select(F.col("doc_id").alias("file_id"), "_backend", "_version_name", "pdf_info", F.pmod(F.xxhash64("doc_id"), F.lit(folders)).alias("folder"))
    rows.write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("folder").json(path)


def parse_layouts(df: DataFrame, column: str) -> DataFrame:
    """Layout columns from JSON that is in a column already."""
    return df.withColumn("_layout", F.from_json(column, LAYOUT)).select(*(c for c in df.columns if c != column), "_layout.*")


def write_layout_spans(spans: DataFrame, path: str) -> None:
    """Keep extracted spans (with backend and version), so that later compares skip extraction."""
    spans.write.mode("overwrite").partitionBy("backend", "version").parquet(path)


def write_diff(units: DataFrame, stats: DataFrame, path: str) -> None:
    with shuffles_go(units.sparkSession):
        units.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/diff_units")
        stats.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/diff_stats")


def write_reports(reports: DataFrame, path: str) -> None:
    """(pair_id, html) as a table; one row is one report."""
    with shuffles_go(reports.sparkSession):
        reports.select("pair_id", "html").write.mode("overwrite").option("compression", "zstd").parquet(path)
