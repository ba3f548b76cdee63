"""Secret scans: candidates from whole texts, and a random forest that takes out false findings."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, stored, utf8

#: What may be a secret: a private key's block, a value that is assigned to a credential, a token of dotted parts,
#: or a run of 12 or more key characters with a digit. A group holds the value where it is not the whole match.
CANDIDATE = re.compile(
    rb"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[^-]*-----END [A-Z ]{0,40}PRIVATE KEY-----"
    rb"|(?<![A-Za-z])(?i:pass(?:word|wd|phrase)|secret|token|api[_-]?key)[\"']?[ \t]*[:=][ \t]*[\"']?([^\s\"'`,;<>]{6,})"
    rb"|(?<![A-Za-z0-9+/_=\-.])[A-Za-z0-9_\-]{8,}(?:\.[A-Za-z0-9_\-]{8,}){2,}"
    rb"|(?<![A-Za-z0-9+/_=\-])(?=[A-Za-z+/_=\-]*[0-9])[A-Za-z0-9+/_=\-]{12,}"
)
#: Words beside a secret.
HINTS = ("token", "secret", "password", "passwd", "key", "apikey", "auth", "bearer", "credential", "private")
NAMES = (
    "length", "digits", "upper", "lower", "distinct", "entropy", "class_changes", "letter_pairs", "dictionary",
    "slashes", "path_before", "hint_before", "hint_distance", "words_around", "numbers_around",
)
CONTEXT = 48
#: Parts of the findings that the forest is trained on.
PARTS = 32


def _kind(c: int) -> int:
    return 0 if 48 <= c <= 57 else 1 if 65 <= c <= 90 else 2 if 97 <= c <= 122 else 3


def candidates(text: bytes) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """(start, value, before, after) of a whole text; start in bytes of UTF-8."""
    for m in CANDIDATE.finditer(text):
        start, end = m.span(1) if m.group(1) is not None else m.span()
        yield start, text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]


def located(docs: DataFrame, path: str | None) -> DataFrame:
    """doc_id, path and text, as the scans read them."""
    return docs.select("doc_id", (F.col(path) if path else F.lit(None)).cast("string").alias("path"), utf8())


class Language:
    """Letter transitions and a dictionary, learnt from the surroundings of all training findings.

    ``words`` are the dictionary; of ``pairs`` (two letters: number) come the transitions. Words of up to 12 letters are
    looked for inside a value.
    """

    def __init__(self, words: set[bytes], pairs: dict[bytes, int]):
        self.words = words
        firsts = Counter()
        for pair, n in pairs.items():
            firsts[pair[:1]] += n
        self.log = {pair: math.log((n + 0.5) / (firsts[pair[:1]] + 13)) for pair, n in pairs.items()}

    def pair_score(self, value: bytes) -> float:
        """Mean log chance of its letter transitions; very low without any."""
        letters = value.lower()
        scores = [self.log.get(letters[i : i + 2], -6.0) for i in range(len(letters) - 1)]
        return sum(scores) / len(scores) if scores else -6.0

    def coverage(self, value: bytes) -> float:
        """Share of its characters in dictionary words, longest first from the left."""
        low, at, covered = value.lower(), 0, 0
        while at < len(low):
            for n in range(min(12, len(low) - at), 2, -1):
                if low[at : at + n] in self.words:
                    covered += n
                    at += n
                    break
            else:
                at += 1
        return covered / max(1, len(low))


def features(value: bytes, before: bytes, after: bytes, path: str | None, language: Language) -> list[float]:
    """Numbers in the order of NAMES; any of the texts may be empty."""
    n = max(1, len(value))
    kinds = [_kind(c) for c in value]
    counts = Counter(value)
    low = before.lower()
    hint = max((low.rfind(h.encode()) for h in HINTS), default=-1)
    words = re.findall(rb"[A-Za-z]{2,}", before + b" " + after)
    return [
        float(len(value)), kinds.count(0) / n, kinds.count(1) / n, kinds.count(2) / n, len(counts) / n,
        -sum(c / n * math.log2(c / n) for c in counts.values()), sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n,
        language.pair_score(value), language.coverage(value),
        float(value.count(b"/") + (path or "").count("/")), float(before[-1:] in (b"/", b".", b"\\", b":") and before[-1:] != b""),
        float(hint >= 0), float(len(low) - hint if hint >= 0 else CONTEXT + 1), float(len(words)), float(len(re.findall(rb"[0-9]+", before + after))),
    ]


def labels_of(labelled: DataFrame) -> DataFrame:
    """(doc_id, start, label) of every labelled place; several labels of a place count as a secret if one does."""
    known = labelled.filter("doc_id is not null and start is not null and is_secret is not null")
    return known.groupBy("doc_id", "start").agg(F.max(F.col("is_secret").cast("int")).alias("label"))


def language_of(rows: DataFrame, labels: DataFrame, least: int = 3, most: int = 5000) -> Language:
    """What the surroundings of all places in ``labels`` (doc_id, start) say; each place counts once.

    The dictionary has the ``most`` commonest words of three or more letters that stand ``least`` times or more: its
    size is fixed, its counts are of all places. Of a word 50 counts at most enter the transitions, so that few words
    do not make them; these are all counted too and are 676 numbers at most.
    """

    def run(ids: list, paths: list, texts: list) -> Iterator[tuple]:
        for doc_id, text in zip(ids, texts, strict=True):
            for start, _, before, after in candidates(text):
                for word, n in Counter(re.findall(rb"[a-z]{3,}", (before + b" " + after).lower())).items():
                    yield doc_id, start, word.decode(), n

    each = arrow_map(rows, run, "doc_id long, start long, word string, n long")
    each = each.join(labels.select("doc_id", "start"), ["doc_id", "start"], "left_semi").groupBy("doc_id", "start", "word").agg(F.max("n").alias("n"))
    words = stored(each.groupBy("word").agg(F.sum("n").alias("n")), "words")
    common = words.filter(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(most).collect()
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2)))).alias("pair")
    pairs = words.select(pair, F.least("n", F.lit(50)).alias("n")).groupBy("pair").agg(F.sum("n").alias("n")).collect()
    return Language({r.word.encode() for r in common}, {r.pair.encode(): r.n for r in pairs})


def bin_borders(learnt: DataFrame, bins: int) -> list[list[float]]:
    """For each feature of ``learnt`` (x) the distinct values that cut all rows into ``bins`` parts of like number.

    The summaries of all tasks are merged; a border's rank is wrong by a ten-thousandth of the rows at most.
    """
    cuts = F.percentile_approx("v", [k / bins for k in range(1, bins)], 10_000)
    found = {r.k: sorted(set(r.cuts)) for r in learnt.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(cuts.alias("cuts")).collect()}
    return [found.get(k, []) for k in range(len(NAMES))]


def binned(x: Column, borders: list[list[float]]) -> Column:
    """The vector of bin numbers of ``x``: how many borders lie below each value."""

    def number(k: int, cuts: list[float]) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.get(x, k))).cast("double") if cuts else F.lit(0.0)

    return array_to_vector(F.array(*(number(k, cuts) for k, cuts in enumerate(borders))))


def secret_findings(docs: DataFrame, labelled: DataFrame | None = None, path: str | None = None, trees: int = 20, depth: int = 6, threshold: float = 0.5, bins: int = 32, broadcast_rows: int = 1_000_000) -> DataFrame:
    """One row per candidate: doc_id, start, length, digest, score, is_secret.

    The forest, its borders and the language are learnt by Spark from all findings of ``labelled`` (doc_id, start,
    is_secret; None: weak labels of the candidates), several labels of a finding count as a secret if one does. ``path``
    names a column of ``docs`` with the file's path. Documents without a label are left out of the language's scan
    where the labels are ``broadcast_rows`` at most.
    Without findings of both kinds nothing can be taken out: score is the one kind's share, 1 without any, and
    is_secret follows from it. Null and empty texts have no candidates; a null doc_id is kept and learns
    nothing; repeated rows give repeated findings and are learnt from once. ``digest`` is SHA-256, so a result spreads no
    secret; no table or shuffle holds a value, and of its surroundings only single words of letters are shuffled to be counted.
    """
    rows = located(docs, path)
    labels = stored(labels_of(weak_labels(docs) if labelled is None else labelled), "labels")
    near = rows.join(F.broadcast(labels.select("doc_id").distinct()), "doc_id", "left_semi") if labels.count() <= broadcast_rows else rows
    language = language_of(near, labels)

    def run(ids: list, paths: list, texts: list) -> Iterator[tuple]:
        for doc_id, at, text in zip(ids, paths, texts, strict=True):
            for start, value, before, after in candidates(text):
                yield doc_id, start, len(value), hashlib.sha256(value).hexdigest(), features(value, before, after, at, language)

    scored = stored(arrow_map(rows, run, "doc_id long, start long, length long, digest string, x array<double>"), "candidates")
    # Rows and parts of a fixed order, so that the bags of the trees are alike in each run.
    learnt = scored.join(labels, ["doc_id", "start"]).groupBy("doc_id", "start").agg(F.max("label").cast("double").alias("label"), F.min("x").alias("x"))
    learnt = stored(learnt.repartition(PARTS, "doc_id", "start").sortWithinPartitions("doc_id", "start").select("label", "x"), "learnt")
    kinds = learnt.agg(F.min("label").alias("low"), F.max("label").alias("high")).first()
    if kinds.low == kinds.high:
        out = scored.withColumn("score", F.lit(1.0 if kinds.low is None else kinds.low))
    else:
        borders = bin_borders(learnt, bins)
        train = learnt.select("label", binned(F.col("x"), borders).alias("features"))
        model = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=bins, seed=42, labelCol="label", featuresCol="features").fit(train)
        out = model.transform(scored.withColumn("features", binned(F.col("x"), borders))).withColumn("score", vector_to_array("probability")[1])
    return out.select("doc_id", "start", "length", "digest", "score", (F.col("score") >= threshold).alias("is_secret"))


def weak_labels(docs: DataFrame) -> DataFrame:
    """Labelled findings where none are given, by what the forest is not told: that a value is assigned and that it has
    the form of a key.

    A digest, a key of a known form or a key block that is assigned to a named credential is a secret; plain
    numbers, words with few digits, and lower-case words are not. Everything else stays without a label.
    """
    form = re.compile(rb"(?i:[0-9a-f]{32,})|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+")
    name = re.compile(rb"(?i)(token|secret|key|passw[a-z]*)[\"']?\s*[:=]\s*[\"']?$")

    def run(ids: list, paths: list, texts: list) -> Iterator[tuple]:
        for doc_id, text in zip(ids, texts, strict=True):
            for start, value, before, _ in candidates(text):
                if value.startswith(b"-----BEGIN") or (form.fullmatch(value) and name.search(before)):
                    yield doc_id, start, True
                elif value.isdigit() or value.islower() and value.isalpha() or sum(48 <= c <= 57 for c in value) * 8 < len(value) and not form.fullmatch(value):
                    yield doc_id, start, False

    return arrow_map(located(docs, None), run, "doc_id long, start long, is_secret boolean")
