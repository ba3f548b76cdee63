"""Counters of revision pairs that are kept up to date: changed pairs replace their rows, totals move by differences."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COUNTERS = ["additions", "deletions", "modifications", "unchanged"]


class DiffStore:
    """Signed rows (pair_id, label, counters, n) in a folder for each batch under ``path``; their sums are the present state."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def batches(self) -> list[str]:
        """Folders of the batches that are complete."""
        fs, make = self._fs()
        if not fs.exists(make(self.path)):
            return []
        return sorted(s.getPath().toString() for s in fs.listStatus(make(self.path)) if s.getPath().getName().startswith("batch-"))

    def commit(self, batch: str, stats: DataFrame, removed: DataFrame | None = None) -> bool:
        """Replace the rows of the pairs of ``stats`` (pair_id, label, counters) and drop those of ``removed`` (pair_id).

        False, and no change, if ``batch`` was committed before. The rows are written aside and renamed into place at
        last, so a job that is broken off leaves nothing that counts. One job commits at a time, and a pair
        comes once in a batch.
        """
        fs, make = self._fs()
        place = f"{self.path}/batch-{batch.encode().hex()}"
        if fs.exists(make(place)):
            return False
        rows = stats.select("pair_id", "label", *(F.col(c).cast("long").alias(c) for c in COUNTERS), F.lit(1).cast("long").alias("n"))
        if self.batches():
            touched = stats.select("pair_id") if removed is None else stats.select("pair_id").unionByName(removed.select("pair_id"))
            old = self.pairs().join(touched.distinct(), "pair_id", "left_semi")
            rows = rows.unionByName(old.select("pair_id", "label", *((-F.col(c)).alias(c) for c in COUNTERS), F.lit(-1).cast("long").alias("n")))
        aside = f"{self.path}/_aside-{uuid.uuid4().hex}"
        rows.write.parquet(aside)
        if not fs.rename(make(aside), make(place)):
            raise RuntimeError(f"batch {batch} could not be put into place")
        return True

    def _rows(self) -> DataFrame:
        return self.spark.read.parquet(*self.batches())

    def pairs(self) -> DataFrame:
        """(pair_id, label, counters) of every pair as it is now."""
        sums = self._rows().groupBy("pair_id", "label").agg(*(F.sum(c).alias(c) for c in (*COUNTERS, "n")))
        return sums.filter("n > 0").drop("n")

    def labels(self) -> DataFrame:
        """(label, pairs, counters): sums of signed rows, without a look at single pairs."""
        sums = self._rows().groupBy("label").agg(F.sum("n").alias("pairs"), *(F.sum(c).alias(c) for c in COUNTERS))
        return sums.filter("pairs > 0")
