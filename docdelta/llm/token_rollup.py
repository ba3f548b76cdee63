"""Token counts as delta-maintained rollups with idempotent batch commits."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, discard, stored
from .tokens import piece_cache

VERSIONS = ("byte_bpe_50k", "byte_bpe_multi_50k")
KEYS = ["source", "lang", "version"]


class TokenRollup:
    """Additive totals of documents and tokens by source, language and tokenizer version, in one folder.

    A batch of changes (doc_id, source, lang, text, op) becomes signed rows: an insert or update adds the new
    counts and takes back what earlier batches added for that document, a delete only takes back. The rows of
    a batch lie in a folder named after its id, in ``buckets`` parts by a hash of doc_id, and its totals, written
    last, commit it: a batch that is committed again changes nothing, and one that broke off is written anew. A
    batch reads earlier rows only of the parts that its documents are in. One writer at a time, and ``buckets``
    stays as it was at the first batch.
    """

    def __init__(self, spark: SparkSession, path: str, versions: tuple[str, ...] = VERSIONS, buckets: int = 64):
        self.spark, self.path, self.versions, self.buckets = spark, path.rstrip("/"), versions, buckets

    def committed(self) -> list[str]:
        """Ids of the committed batches."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/totals")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        done = [s.getPath() for s in fs.listStatus(root) if s.isDirectory()]
        return sorted(unquote(p.getName().removeprefix("batch=")) for p in done if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def _read(self, kind: str, batches: list[str], schema: str) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], schema)
        folders = [self._folder(kind, b) for b in batches]
        names = [part.split()[0] for part in schema.split(", ")]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{kind}").parquet(*folders).select(*names)

    def _folder(self, kind: str, batch: str) -> str:
        return f"{self.path}/{kind}/batch={quote(batch, safe='')}"

    ROWS = "doc_id long, source string, lang string, version string, documents long, tokens long, bucket int"
    TOTALS = "source string, lang string, version string, documents long, tokens long"

    def counted(self, changes: DataFrame) -> DataFrame:
        """Changes with their token counts by version instead of the text; one row per document, the last by
        ``op`` (delete, insert, update) and counts where a batch names it more than once."""

        versions = self.versions

        def run(ids: list, sources: list, langs: list, ops: list, texts: list) -> Iterator[tuple]:
            caches = [piece_cache(v) for v in versions]
            for *row, text in zip(ids, sources, langs, ops, texts, strict=True):
                yield *row, None if row[3] == "delete" else [c.count(text) for c in caches]

        columns = ["doc_id", "source", "lang", F.coalesce("op", F.lit("insert")).alias("op"), F.coalesce("text", F.lit("")).alias("text")]
        rows = arrow_map(changes.filter("doc_id is not null").select(*columns), run, "doc_id long, source string, lang string, op string, n array<long>")
        return rows.groupBy("doc_id").agg(F.max(F.struct("op", "n", "source", "lang")).alias("c")).select("doc_id", "c.*")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch once. False if it had been committed before.

        Rows without a doc_id are left out, since no later change could name them. A null text counts as empty,
        null op as an insert; null sources and languages are groups of their own. Deletes of unknown documents
        change nothing. An empty batch commits no rows.
        """
        before = self.committed()
        if batch in before:
            return False
        bucket = F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int").alias("bucket")
        now = stored(self.counted(changes), "counted")  # used twice; texts are cut into tokens once
        added = now.filter("op <> 'delete'").select("doc_id", "source", "lang", F.posexplode("n").alias("at", "tokens")).select(
            "doc_id", "source", "lang", F.element_at(F.array(*map(F.lit, self.versions)), F.col("at") + 1).alias("version"), F.lit(1).cast("long").alias("documents"), "tokens"
        )
        rows = added
        if before:
            named = [r.bucket for r in now.select(bucket).distinct().collect()]  # ``buckets`` numbers at most
            held = self._read("rows", before, self.ROWS).filter(F.col("bucket").isin(named)).join(now.select("doc_id"), "doc_id", "left_semi")
            rows = added.unionByName(held.select("doc_id", *KEYS, (-F.col("documents")).alias("documents"), (-F.col("tokens")).alias("tokens")))
        rows = rows.groupBy("doc_id", *KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).filter("documents <> 0 or tokens <> 0")
        by_bucket = rows.select("*", bucket).repartition("bucket")
        by_bucket.write.mode("overwrite").partitionBy("bucket").option("compression", "zstd").parquet(self._folder("rows", batch))
        delta = self._read("rows", [batch], self.ROWS).groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        delta.coalesce(1).write.mode("overwrite").parquet(self._folder("totals", batch))
        discard(now)
        return True

    def totals(self) -> DataFrame:
        """source, lang, version, documents, tokens over all committed batches."""
        deltas = self._read("totals", self.committed(), self.TOTALS)
        return deltas.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).filter("documents <> 0 or tokens <> 0")


def copies(docs: DataFrame) -> DataFrame:
    """Changes that delete each document whose text an earlier document has too."""
    keyed = docs.filter("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("a"), F.xxhash64(F.lit(7), "text").alias("b"))
    first = keyed.groupBy("a", "b").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = keyed.join(stored(first, "copies"), ["a", "b"]).filter("doc_id > first")
    none = F.lit(None).cast("string")
    return later.select("doc_id", none.alias("source"), none.alias("lang"), none.alias("text"), F.lit("delete").alias("op"))


def masked(docs: DataFrame) -> DataFrame:
    """Changes that revise each document with long numbers, which are masked."""
    long = "[0-9]{13,}"
    return docs.filter(F.col("text").rlike(long)).select("doc_id", "source", "lang", F.regexp_replace("text", long, "<number>").alias("text"), F.lit("update").alias("op"))
