"""What the training-data operators share: tables, scratch tables, Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import discard, scratch_root, stored  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_map(df: DataFrame, rows: Callable[..., Iterator[tuple]], schema: str, flush: int = 8192) -> DataFrame:
    """``mapInArrow`` for a generator that takes the columns of a batch as lists and yields output rows."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            for row in rows(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
                out.append(row)
                if len(out) >= flush:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    types = [ARROW[part.split()[1]] for part in schema.split(", ")]
    return df.mapInArrow(run, schema)


ARROW = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(),
    "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
    "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string()), "array<binary>": pa.list_(pa.binary()),
}


def row_numbers() -> Iterator[int]:
    """Ids for the rows of this task. They come out alike when a lost task runs again over the same file split."""
    n = TaskContext.get().partitionId() << 33
    while True:
        yield n
        n += 1


def utf8(name: str = "text"):
    """A text as bytes; null counts as empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary").alias(name)
