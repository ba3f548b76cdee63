"""Units and normal forms kept by content, so that a later compare computes only texts that were not seen before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.align import document_units
from ..scratch import discard, shuffles_go, stored


class UnitStore:
    """Two bucketed tables: ``<name>_texts`` (key, units, norms) and ``<name>_documents`` (key, doc_id).

    The key is the SHA-256 of a text. Both tables lie in the same buckets of the key, so documents meet their units
    without an exchange. Texts are only ever added. With a ``path`` the files lie there, else in the warehouse.
    """

    def __init__(self, spark: SparkSession, name: str, path: str | None = None, buckets: int = 64):
        self.spark, self.name, self.path, self.buckets = spark, name, path, buckets

    def _table(self, kind: str) -> DataFrame:
        return self.spark.read.table(f"{self.name}_{kind}")

    def _has(self, kind: str) -> bool:
        return self.spark.catalog.tableExists(f"{self.name}_{kind}")

    def _write(self, rows: DataFrame, kind: str, mode: str) -> None:
        """Rows that are dealt out by key already: each task writes to one bucket."""
        place = {"path": f"{self.path}/{kind}"} if self.path else {}
        rows.write.bucketBy(self.buckets, "key").sortBy("key").mode(mode).format("parquet").options(compression="zstd", **place).saveAsTable(f"{self.name}_{kind}")

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """Dealt out by key to a multiple of the buckets, so that each part lies in one of them."""
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions")) // self.buckets
        return rows.repartition(self.buckets * max(1, parts), "key")

    def put(self, docs: DataFrame) -> int:
        """Take ``docs`` (doc_id, text) as the present documents; the number of texts that had to be computed.

        A null text counts as an empty one. Documents of the same text share its units; what an earlier call
        kept stays for later ones. A call that
        is repeated, or was broken off between the two tables, computes nothing twice.
        """
        text = F.coalesce("text", F.lit(""))
        keyed = stored(docs.select("doc_id", F.sha2(text, 256).alias("key"), text.alias("text")), "keyed")
        with shuffles_go(self.spark):
            before = self._table("texts").count() if self._has("texts") else 0
            # What travels are texts: units are made of them behind the one exchange.
            fresh = self._dealt(keyed.select("key", "text")).dropDuplicates(["key"])
            if self._has("texts"):
                fresh = fresh.join(self._table("texts").select("key"), "key", "left_anti")
            computed = document_units(fresh.select(F.col("key").alias("doc_id"), "text")).withColumnRenamed("doc_id", "key")
            self._write(computed, "texts", "append")
            self._write(self._dealt(keyed.select("key", "doc_id")), "documents", "overwrite")
            now = self._table("texts").count()
        discard(keyed)
        return now - before

    def units(self) -> DataFrame:
        """(doc_id, units, norms) of the documents of the last ``put``: what ``compare_pairs`` reads. A task holds the
        keys and ids of a bucket, and streams its texts."""
        return self._table("documents").hint("shuffle_hash").join(self._table("texts"), "key").select("doc_id", "units", "norms")
