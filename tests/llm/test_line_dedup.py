import random

import pytest
from pyspark.sql import functions as F

from docdelta.llm import line_dedup as L


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain(rows, least):
    """All pairs: the texts without the lines that an earlier line is within one edit of."""
    lines = sorted({(i, n, x) for i, t in rows if t is not None for n, x in enumerate(t.split("\n")) if len(x) >= least})
    gone = {(i, n) for k, (i, n, x) in enumerate(lines) for _, _, y in lines[:k] if abs(len(x) - len(y)) <= 1 and distance(x, y) <= 1}
    return {(i, t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone)) for i, t in rows}


def changed(rng, x):
    x = list(x)
    k, p = rng.random(), rng.randrange(len(x))
    if k < 0.3:
        x.pop(p)
    elif k < 0.6:
        x.insert(p, rng.choice("abcé"))
    else:
        x[p] = rng.choice("abcé")
    return "".join(x)


@pytest.mark.parametrize("most", [1, 2])
def test_banded_distance(spark, most):
    rng = random.Random(most)
    pairs = []
    for _ in range(800):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(0, 10)))
        b = a
        for _ in range(rng.randint(0, 3)):
            b = changed(rng, b or "a")
        pairs.append((a, b))
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", L.within_edits(F.col("a"), F.col("b"), most).alias("near")).collect()
    assert all(r.near == (distance(r.a, r.b) <= most) for r in got)


@pytest.mark.parametrize("bucket", [32, 3, 1])
def test_like_all_pairs(spark, bucket):
    """Small buckets send every common key through the finer regions, down to single characters."""
    rng = random.Random(5)
    bases = ["".join(rng.choice("abcdé ") for _ in range(rng.choice([8, 9, 20, 21, 45]))) for _ in range(6)]
    rows = []
    for i in range(40):
        lines = [rng.choice(bases) for _ in range(rng.randint(1, 3))]
        rows.append((i, "\n".join(changed(rng, x) if rng.random() < 0.7 else x for x in lines)))
    got = L.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), least_chars=8, bucket=bucket, short_copies=False).collect()
    assert {(r.doc_id, r.text) for r in got} == plain(rows, 8)
    wide = L.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), least_chars=8, bucket=bucket, broadcast_rows=0, short_copies=False).collect()
    assert sorted(wide) == sorted(got)


def test_edges(spark):
    long = "x" * 40
    rows = [(None, long), (3, None), (4, ""), (5, f"{long}\nkeep\n{long[1:]}"), (5, f"{long}\nkeep\n{long[1:]}"), (6, "short\nshort")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h1", F.lit(1)).withColumn("key", F.lit("k")).withColumn("removed", F.lit(0)).withColumn("place", F.lit(2))
    got = L.line_dedup(docs, short_copies=False)
    assert got.columns == ["doc_id", "text", "h1", "key", "place", "removed"]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(None, long), (3, None), (4, ""), (5, "keep"), (5, "keep"), (6, "short\nshort")], key=str)
    assert L.line_dedup(docs.limit(0)).count() == 0
