"""Quality classifier: regularised quadratic discriminant analysis over document statistics."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, stored, utf8

NAMES = (
    "log_chars", "log_words", "word_length", "word_length_spread", "upper", "digits", "symbols", "marks", "stops", "distinct_words",
    "duplicate_lines", "line_words", "repeated_pairs", "letters_per_word", "byte_entropy", "symbol_words",
)
_UPPER, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
_SYMBOLS = b"#*$%&|<>@^~_=+\\/{}[]"
_MARKS = b"!?;:\"'()-"
_STOPS = b".,"
_OTHER_THAN_LETTERS = bytes(x for x in range(128) if not chr(x).isalpha())


def _odds(part: float, whole: float) -> float:
    """Log odds of a share, drawn in by half a count."""
    return math.log((part + 0.5) / (max(whole - part, 0) + 0.5))


def statistics(text: bytes) -> list[float]:
    """Transformed statistics of a whole text; every one is defined for an empty text too."""
    n, words = len(text), text.split()
    k = len(words)

    def of(kind: bytes) -> int:
        return n - len(text.translate(None, kind))

    lengths = np.fromiter(map(len, words), np.int64, k)
    lines = [x for x in text.split(b"\n") if x.strip()]
    letters = len(text.translate(None, _OTHER_THAN_LETTERS))
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    shares = counts[counts > 0] / max(n, 1)
    pairs = max(k - 1, 0)
    symbol_words = sum(c for x, c in Counter(x[-1:] for x in words).items() if x in b"#*$%&!|")
    return [
        math.log1p(n), math.log1p(k), math.log1p(float(lengths.mean()) if k else 0.0), math.log1p(float(lengths.std()) if k else 0.0),
        _odds(of(_UPPER), max(letters, 1)), _odds(of(_DIGITS), n), _odds(of(_SYMBOLS), n), _odds(of(_MARKS), n), _odds(of(_STOPS), n), _odds(len(set(words)), k),
        _odds(len(lines) - len(set(lines)), len(lines)), math.log1p(k / max(len(lines), 1)), _odds(pairs - len(set(zip(words, words[1:], strict=False))), pairs),
        math.log1p(letters / max(k, 1)), float(-(shares * np.log2(shares)).sum()) if n else 0.0, _odds(symbol_words, k),
    ]


def featured(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of each row's text; null counts as empty."""

    def run(ids: list, texts: list) -> Iterator[tuple]:
        for doc_id, text in zip(ids, texts, strict=True):
            yield doc_id, statistics(text)

    return arrow_map(docs.select("doc_id", utf8()), run, "doc_id long, x array<double>")


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def class_moments(examples: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Per class (label, x): count, sums and sums of products, over all examples; of fixed size."""
    width = len(NAMES)

    def add(batches):
        import pyarrow as pa

        total: dict[int, list] = {}
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(-1, width)
            y = np.array(batch.column(0).to_pylist())
            for c in np.unique(y).tolist():
                z = x[y == c]
                m = total.setdefault(c, [0.0, np.zeros(width), np.zeros((width, width))])
                m[0] += len(z)
                m[1] += z.sum(0)
                m[2] += z.T @ z
        rows = [(c, k, float(v)) for c, m in total.items() for k, v in enumerate(np.r_[m[0], m[1], m[2].ravel()])]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.float64()), strict=True)], names=["label", "k", "v"])

    rows = examples.select("label", "x").mapInArrow(add, "label int, k int, v double").groupBy("label", "k").agg(F.sum("v").alias("v")).collect()
    out = {}
    for c in {r.label for r in rows}:
        v = np.array([r.v for r in sorted((r for r in rows if r.label == c), key=lambda r: r.k)])
        out[c] = (v[0], v[1 : width + 1], v[width + 1 :].reshape(width, width))
    return out


class QuadraticDiscriminant:
    """Gaussian classes with covariances shrunk to their pooled and to a scaled unit matrix."""

    def __init__(self, moments: dict, pooled: float = 0.3, ridge: float = 0.05, clip: float = 8.0):
        """``moments`` by class 0 and 1. Without examples of a class its mean and spread are the other's, and
        the prior decides."""
        n = {c: moments[c][0] if c in moments else 0.0 for c in (0, 1)}
        total = sum(n.values())
        self.clip = clip
        if not total:
            moments = {1: (1.0, np.zeros(len(NAMES)), np.eye(len(NAMES)))}
            n, total = {0: 0.0, 1: 0.0}, 0.0
        some = next(iter(moments.values()))
        own = {c: moments.get(c, some) for c in (0, 1)}
        means = {c: m[1] / m[0] for c, m in own.items()}
        spreads = {c: m[2] / m[0] - np.outer(means[c], means[c]) for c, m in own.items()}
        weight = {c: (n[c] + 1) / (total + 2) for c in (0, 1)}
        self.center = weight[0] * means[0] + weight[1] * means[1]
        between = sum(weight[c] * np.outer(means[c] - self.center, means[c] - self.center) for c in (0, 1))
        within = weight[0] * spreads[0] + weight[1] * spreads[1]
        self.scale = np.sqrt(np.maximum(np.diag(within + between), 1e-8))
        unit = np.outer(self.scale, self.scale)
        self.classes = []
        for c in (0, 1):
            s = (1 - pooled) * spreads[c] / unit + pooled * within / unit
            s = (1 - ridge) * s + ridge * max(float(np.trace(s)) / len(s), 1e-6) * np.eye(len(s))
            lower = np.linalg.cholesky(s)  # cached: scoring only multiplies by its inverse
            inverse = np.linalg.inv(lower)
            self.classes.append(((means[c] - self.center) / self.scale, inverse, -float(np.log(np.diag(lower)).sum()) + math.log(weight[c])))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 from the difference of the classes' log densities."""
        z = np.clip((x - self.center) / self.scale, -self.clip, self.clip)
        log = [-0.5 * (((z - mean) @ inverse.T) ** 2).sum(1) + offset for mean, inverse, offset in self.classes]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def learnt_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, label) of every labelled row that is not held out. Labels other than 0 and 1 and null ids are left
    out; several labels of a document count as their mean, ties as 1."""
    known = labels.select("doc_id", "quality").filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    return known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))


def fitted(features: DataFrame, learnt: DataFrame) -> QuadraticDiscriminant:
    """Learn from every row of ``features`` (doc_id, x) that has a label in ``learnt``."""
    return QuadraticDiscriminant(class_moments(features.join(learnt, "doc_id").select("label", "x")))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text).

    A null text is scored as an empty one. A null doc_id is kept and not held out. Repeated rows are scored
    alike. Without labels every score is 0.5. Other columns of either table are not read.
    """
    features = stored(featured(docs), "features")
    model = fitted(features, learnt_labels(labels))

    def run(ids: list, xs: list) -> Iterator[tuple]:
        if ids:
            yield from zip(ids, model.scores(np.array(xs, float)).tolist(), strict=True)

    scored = arrow_map(features, run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with all their columns and in any order.

    Nulls, empty texts and repeated rows are scored as by ``quality_scores``; an empty table gives none. Only
    labelled documents are read for learning; their ids are broadcast if they are ``broadcast_rows`` at most.
    """
    learnt = stored(learnt_labels(labels), "learnt")
    wanted = learnt.select("doc_id")
    if learnt.count() <= broadcast_rows:
        wanted = F.broadcast(wanted)
    model = fitted(stored(featured(docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi")), "features"), learnt)

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            column = batch.schema.get_field_index("text")
            texts = pc.fill_null(batch.column(column), "").cast(pa.binary()).to_pylist()
            good = model.scores(np.array([statistics(t) for t in texts], float).reshape(-1, len(NAMES))) >= 0.5
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
