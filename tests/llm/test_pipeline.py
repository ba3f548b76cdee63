"""Each stage of the pipeline against a plain version on the rows that the stage before kept, and its edges."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from docdelta.llm import packing, quality_classifier, similar_texts, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TABLES = "/root/testdata/sf0.001"


def signed_hash(text):
    h = xxhash.xxh64_intdigest((text or "").encode(), 42) if text is not None else 42
    return h - (1 << 64) if h >> 63 else h


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Rows of the given documents with edges: null, empty, blank, long, repeated and tied rows, copies, benchmark items."""
    root = tmp_path_factory.mktemp("tables")
    rng = random.Random(21)
    docs = [tuple(r) for r in spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect() if r.doc_id < 90]
    items = [r.text for r in spark.read.parquet(f"{TABLES}/benchmark.parquet").collect()]
    by_id = {r[0]: r[1] for r in docs}
    long = max(by_id.values(), key=len)
    more = [(None, by_id[3]), (None, by_id[4] + "\nof its own"), (5, by_id[6] + "\nanother text of a known id"), (1000, None), (1001, ""), (1002, " \n\t"), (1003, long + " end"), (1004, by_id[7]), (7, by_id[7])]
    more += [(1100 + k, by_id[10 + k] + "\n" + items[k % len(items)] + "\n" + by_id[30 + k]) for k in range(6)] + [(None, by_id[20] + "\n" + items[0]), (1200, f"{by_id[21]}\n{'x' * 40}\nshort"), (1201, f"{by_id[22]}\n{'x' * 39}y\nshort")]
    rows = docs + [(i, t, "en", "a", len(t or "")) for i, t in more]
    rng.shuffle(rows)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(root / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{TABLES}/{name}.parquet").write.parquet(str(root / f"{name}.parquet"))
    return str(root)


def plain_quality(rows, labels):
    def held(i):
        return zlib.crc32(str(i).encode()) % 3 == 1

    known = {i: q for i, q in labels if not held(i)}
    moments = {}
    for i, t in rows:
        if i in known:
            x = np.array(quality_classifier.statistics((t or "").encode()))
            n, s, p = moments.get(known[i], (0.0, 0, 0))
            moments[known[i]] = (n + 1, s + x, p + np.outer(x, x))
    model = quality_classifier.QuadraticDiscriminant(moments)
    return Counter((i, t) for i, t in rows if model.scores(np.array([quality_classifier.statistics((t or "").encode())]))[0] >= 0.5)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def near(a, b):
    """Within one edit, by what is left between the common front and back."""
    if abs(len(a) - len(b)) > 1:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    a, b = a[k:], b[k:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    return distance(a, b) <= 1


def plain_lines(rows):
    texts = sorted({(i is not None, i or 0, signed_hash(t), t) for i, t in rows if t is not None}, key=lambda x: x[:3])
    seen: list[str] = []
    all_seen: set[str] = set()
    left = {}
    for known, i, _, t in texts:
        kept = []
        for line in t.split("\n"):
            gone = line in all_seen and line.strip() != "" or len(line) >= 30 and (line in all_seen or any(near(line, x) for x in seen))
            if not gone:
                kept.append(line)
            if len(line) >= 30 and line not in all_seen:
                seen.append(line)
            all_seen.add(line)
        left[i if known else None, t] = "\n".join(kept)
    out = Counter()
    for (i, t), n in rows.items():
        new = t if t is None else left[i, t]
        if new == t or re.search(r"\S", new):
            out[i, new] += n
    return out


def plain_copies(rows):
    own = sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, signed_hash(x[1])))
    fp = np.array([simhash.fingerprint((t or "").encode()) for _, t in own], np.uint64)
    close = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3
    runs = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in ((t or "").encode().lower().split() for _, t in own)]
    close |= np.array([[len(a & b) >= 0.8 * len(a | b) > 0 for b in runs] for a in runs])
    label = np.arange(len(own))
    while (new := np.array([label[close[k]].min() for k in range(len(own))])).tolist() != label.tolist():
        label = new
    return Counter({own[k]: 1 for k in set(label.tolist())})


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())


def rows_of(df):
    return Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_stages(spark, tables):
    docs = corpus_pipeline.table(spark, tables, "documents")
    labels = [(r.doc_id, r.quality) for r in corpus_pipeline.table(spark, tables, "labels").collect()]
    items = [words(r.text) for r in corpus_pipeline.table(spark, tables, "benchmark").collect()]
    before = rows_of(docs)
    assert max(before.values()) > 1
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.stored(stage(spark, docs, tables), name)
        assert out.columns == corpus_pipeline.COLUMNS and out.schema == docs.schema
        kept = rows_of(out)
        if name == "quality":
            want = plain_quality(list(before.elements()), labels)
            assert kept == want and len(kept) < len(before)
        elif name == "lines":
            assert kept == plain_lines(before)
            assert all(r.n_chars == len(r.text) for r in out.filter("doc_id >= 1100").collect())
        elif name == "near_copies":
            assert kept == plain_copies(before)
        else:  # an exact copy never stays; what goes shares most of a passage, and the planted rows are all gone
            assert not kept - before
            holders = {(i, t) for i, t in before if any(x and " ".join(x) in " ".join(words(t)) for x in items)}
            assert holders and not holders & set(kept)
            for _, t in before - kept:
                own = Counter(words(t))
                assert any(sum((own & Counter(x)).values()) >= 0.4 * min(len(x), 32) for x in items)
        docs, before = out, kept
    ids: dict = {}
    for r in packing.encoded(docs).collect():
        ids[r.doc_id] = ids.get(r.doc_id, 0) + len(r.ids) // 2
    for pieces in (corpus_pipeline.packing(spark, docs, tables), corpus_pipeline.run(spark, tables)):
        got: dict = {}
        for r in pieces.collect():
            got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        assert got == ids


def test_rows_of_one_id_are_rows_of_their_own(spark):
    """Order of the rows doesn't matter; a null id gives way to a known one."""
    a, b = " ".join(f"alpha{k} beta" for k in range(30)), " ".join(f"gamma{k} delta" for k in range(30))
    rows = [(1, a, "en", "s", 0), (1, b, "en", "s", 0), (2, a, "en", "s", 0), (None, b, "en", "s", 0), (None, b + " " + a, "en", "s", 0), (None, b + " " + a, "de", "s", 0)]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, SCHEMA).withColumn("_hash", F.lit(1)).withColumn("fp", F.lit(2))
        assert rows_of(corpus_pipeline.near_copies(spark, docs, "")) == Counter({(1, a): 1, (1, b): 1, (None, b + " " + a): 1})


def test_copies_that_are_like_their_source_only(spark):
    """Copies with scattered changes, similar to their source but not to each other, are one group; others stay."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    source = [word() for _ in range(200)]
    rows = [(500, " ".join(source))]
    for k in range(150):
        copy = list(source)
        for place in range(4):
            copy[50 * place + rng.randrange(5, 45)] = word()
        rows.append((k, " ".join(copy)))
    half = [(1000 + k, " ".join(source[:100] + [word() for _ in range(100)])) for k in range(20)]
    five = [(2000, "one two three four five"), (2001, "One  two three four\tfive"), (2002, "one two three four six"), (2003, "one two"), (2004, "two one")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows + half + five], SCHEMA).withColumn("text_hash", F.lit(1)).withColumn("bands", F.lit(2))
    got = {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()}
    assert got == {0, 2000, 2002, 2003, 2004} | {i for i, _ in half}


def test_similarity_of_sets():
    b = [f"w{k}".encode() for k in range(40)]
    assert not len(similar_texts.shingles([])) and similar_texts.band_keys(similar_texts.shingles(b[:4])) == []
    x, y = np.unique(similar_texts.shingles(b)), np.unique(similar_texts.shingles(b[:20] + [b"x"] + b[21:]))
    assert similar_texts.jaccard(x, y) == 31 / 41 and similar_texts.jaccard(x, x) == 1 and similar_texts.jaccard(x[:0], x[:0]) == 0
    assert len(set(similar_texts.band_keys(x))) == similar_texts.BANDS


def test_benchmark_by_row(spark, tmp_path):
    """Items without an id count; a hit takes its own row only."""
    rng = random.Random(8)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n))
    item, other, clean = text(40), text(20), text(90)
    spark.createDataFrame([(None, item), (3, other), (3, text(25)), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, f"{clean} {item}"), (1, clean), (None, f"{item} {clean}"), (None, clean), (None, None), (4, f"{clean} {other} {clean}"), (5, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).withColumn("item_id", F.lit(1))
    assert rows_of(corpus_pipeline.benchmark(spark, docs, str(tmp_path))) == Counter({(1, clean): 1, (None, clean): 1, (None, None): 1, (5, ""): 1})


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{TABLES}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
