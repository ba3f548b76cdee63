"""Benchmark decontamination: latent semantic retrieval with sequence and answer checks.

TF-IDF weights are counted over the whole corpus. A randomised SVD of the benchmark's passages gives latent
spaces, each of so few passages that it keeps a fixed share of every one of them. Windows of every document,
as long as the passages, are projected into them; windows whose cosine with a passage is high, and all places
that share three words in a row with a passage, are verified by the longest common subsequence and by the
item's answer.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, stored, utf8
from .license_scan import words_of

PASSAGE, STRIDE, ANSWER = 32, 16, 6
#: Words in a row that make a place a candidate; share of each passage's squared length that its space keeps at least.
GRAM, KEPT = 3, 0.5
#: Terms in a piece of a sum that the driver gets.
PIECE = 256
HITS = "doc_id long, text_hash long, item_key long, item_id long, cosine double, lcs double, answer_found boolean, first_word long, last_word long, by_latent boolean, by_runs boolean"


def windows(n: int, size: int = PASSAGE, stride: int = STRIDE) -> Iterator[tuple[int, int]]:
    """Overlapping windows over n words; the last one ends at the end."""
    start = 0
    while start + size < n:
        yield start, start + size
        start += stride
    if n:
        yield max(0, n - size), n


def lcs_length(a: list, b: list) -> int:
    """Longest common subsequence, bit-parallel over ``a``."""
    masks: dict = {}
    for i, word in enumerate(a):
        masks[word] = masks.get(word, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for word in b:
        match = row & masks.get(word, 0)
        row = ((row + match) | (row - match)) & full
    return len(a) - row.bit_count()


def corpus_frequencies(docs: DataFrame, vocabulary: dict[bytes, int]) -> tuple[np.ndarray, int]:
    """In how many documents each benchmark word stands, and how many documents there are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: Counter = Counter()
        known = vocabulary.keys()
        n = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n += 1
                df.update(known & set(words_of(text)))
        terms = [-1, *(vocabulary[word] for word in df)]
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.int64()), pa.array([n, *df.values()], pa.int64())], names=["term", "n"])

    rows = docs.select(utf8()).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(len(vocabulary))
    total = 0
    for r in rows:
        if r.term < 0:
            total = r.n
        else:
            df[r.term] = r.n
    return df, total


def passages_of(items: DataFrame) -> DataFrame:
    """The benchmark's passages, each with the words that its item has in all and the last ones of them."""

    def run(keys: list, ids: list, texts: list) -> Iterator[tuple]:
        for key, item_id, text in zip(keys, ids, texts, strict=True):
            words = [w.decode() for w in words_of(text)]
            for a, b in windows(len(words)):
                yield key, item_id, a, words[a:b], len(words), words[-ANSWER:]

    return arrow_map(items.select("item_key", "item_id", utf8()), run, "item_key long, item_id long, start int, words array<string>, n_words long, answer array<string>")


def randomised_svd(passages: DataFrame, vocabulary: dict[bytes, int], idf: np.ndarray, rank: int, rounds: int = 2, seed: int = 42) -> np.ndarray:
    """Right singular vectors (terms x rank) of the TF-IDF matrix whose rows are the passages.

    Each round multiplies the rows of one space, which are of bounded number, with a thin matrix in one task, so that
    one sum of terms x rank comes back, in pieces of ``PIECE`` terms; the matrix is released after its round. Sums of
    several parts, and the matrices of all rounds, would all be in the driver's memory at once.
    """
    width = rank + 8
    basis = np.random.default_rng(seed).standard_normal((len(vocabulary), width))
    rows = passages.select("words").repartition(1)

    def gram_times(matrix: np.ndarray) -> np.ndarray:
        shared = passages.sparkSession.sparkContext.broadcast(matrix)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            thin = shared.value
            total = np.zeros_like(thin)
            for batch in batches:
                for words in batch.column(0).to_pylist():
                    ids, tf = np.unique([vocabulary[w.encode()] for w in words], return_counts=True)
                    row = tf * idf[ids]
                    row = row / max(float(np.sqrt((row**2).sum())), 1e-12)
                    total[ids] += row[:, None] * (row @ thin[ids])
            for at in range(0, len(total), PIECE):
                yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([total[at : at + PIECE].astype("<f8").tobytes()])], names=["at", "total"])

        out = np.zeros_like(matrix)
        got = rows.mapInArrow(run, "at long, total binary").toArrow()  # pickled rows would take ten times their size
        for at, piece in zip(got["at"].to_pylist(), got["total"], strict=True):
            out[at : at + PIECE] += np.frombuffer(piece.as_buffer(), "<f8").reshape(-1, matrix.shape[1])
        shared.destroy()
        return out

    for _ in range(rounds):
        basis, _ = np.linalg.qr(gram_times(basis))
    product = gram_times(basis)  # A'A Q; its projection on Q has the squared singular values
    values, vectors = np.linalg.eigh((basis.T @ product + product.T @ basis) / 2)
    best = np.argsort(-values)[:rank]
    return basis @ vectors[:, best[values[best] > 1e-9]]


@dataclass
class Space:
    """Latent space of some passages of like length.

    ``local`` gives the row of each benchmark word in ``vectors``, the weighted latent vectors of the words; for
    other words -1, the last row, which is zero.
    """

    size: int
    local: np.ndarray
    vectors: np.ndarray
    latent: np.ndarray
    passages: np.ndarray


@dataclass
class Grams:
    """Where runs of ``size`` words stand in the passages, by key in sorted order."""

    size: int
    keys: np.ndarray
    passages: np.ndarray
    places: np.ndarray


@dataclass
class Index:
    """A block of the benchmark: its words, passages, latent spaces and runs of words."""

    vocabulary: dict[bytes, int]
    idf: np.ndarray
    unknown: float
    owner: list[tuple[int, int | None]]
    passages: list[list[int]]
    n_words: list[int]
    answers: list[list[bytes]]
    spaces: list[Space]
    grams: list[Grams]

    def near(self, ids: np.ndarray, cosine: float, rows: int = 512) -> Iterator[tuple[int, int, int, float]]:
        """(window start, end, passage, cosine) of a document given as word numbers, -1 for other words."""
        for size in sorted({s.size for s in self.spaces}) if len(ids) else ():
            width, last = min(size, len(ids)), max(0, len(ids) - size)
            starts = np.append(np.arange(0, last, size // 2), last)
            for at in range(0, len(starts), rows):
                part = starts[at : at + rows]
                # How often each window holds each word. A window's vector is the sum of its words' vectors.
                terms, column = np.unique(ids[part[0] : part[-1] + width], return_inverse=True)
                cells = column[(part - part[0])[:, None] + np.arange(width)] + np.arange(len(part))[:, None] * len(terms)
                tf = np.bincount(cells.ravel(), minlength=len(part) * len(terms)).reshape(len(part), -1).astype(np.float32)
                lacking = int(terms[0] < 0)  # the words that the benchmark lacks come first, as one
                other, tf, terms = tf[:, :lacking].sum(axis=1), tf[:, lacking:], terms[lacking:]
                weight = (self.idf[terms] ** 2).astype(np.float32)
                squares = tf * tf
                norm = np.sqrt(squares @ weight + other * np.float32(self.unknown) ** 2)
                for space in self.spaces:
                    if space.size != size:
                        continue
                    row = space.local[terms]
                    # A cosine cannot exceed the share of a window's length that words of the space make up.
                    own = squares @ (weight * (row >= 0))
                    mine = np.flatnonzero((own > 0) & (own >= (cosine * norm) ** 2 * (1 - 1e-4)))
                    if not len(mine):
                        continue
                    dots = tf[mine] @ space.vectors[row] @ space.latent.T
                    i, j = np.nonzero(dots >= np.float32(cosine) * norm[mine, None])
                    for start, p, c in zip(part[mine[i]].tolist(), space.passages[j].tolist(), (dots[i, j] / norm[mine[i]]).tolist(), strict=True):
                        yield start, start + width, p, c

    def shared(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """(start, passage) where a run of a passage's words stands in the document as if the passage began at start."""
        for grams in self.grams:
            keys = gram_keys(ids, grams.size, len(self.vocabulary))
            at = np.flatnonzero(keys >= 0)
            low = np.searchsorted(grams.keys, keys[at])
            same = grams.keys[np.minimum(low, len(grams.keys) - 1)] == keys[at]
            at, low = at[same], low[same]
            if not len(at):
                continue
            counts = np.searchsorted(grams.keys, keys[at], side="right") - low
            found = np.repeat(low + counts - np.cumsum(counts), counts) + np.arange(counts.sum())
            starts = np.repeat(at, counts) - grams.places[found]
            yield from sorted(set(zip(starts.tolist(), grams.passages[found].tolist(), strict=True)))

    def cosine(self, ids: np.ndarray, passage: list[int]) -> float:
        """Exact cosine of a window with a passage."""
        own, tf = np.unique(ids, return_counts=True)
        other = tf[own < 0].sum()
        tf, own = tf[own >= 0] * self.idf[own[own >= 0]], own[own >= 0]
        terms, n = np.unique(passage, return_counts=True)
        n = n * self.idf[terms]
        _, i, j = np.intersect1d(own, terms, assume_unique=True, return_indices=True)
        return float((tf[i] * n[j]).sum() / max(np.sqrt(((tf**2).sum() + other * self.unknown**2) * (n**2).sum()), 1e-12))


def gram_keys(ids: np.ndarray, size: int, n: int) -> np.ndarray:
    """A key for each run of ``size`` word numbers; -1 where a word is not of the benchmark. Long keys wrap around."""
    if len(ids) < size:
        return np.empty(0, np.int64)
    key = np.zeros(len(ids) - size + 1, np.int64)
    known = np.ones(len(key), bool)
    for k in range(size):
        word = ids[k : k + len(key)]
        key = key * n + word
        known &= word >= 0
    return np.where(known, key & (2**63 - 1), -1)


def spaces_of(passages: DataFrame, rows: list, numbers: list[list[int]], idf: np.ndarray, rank: int) -> Iterator[Space]:
    """Spaces for the passages of four or more words, each of about 1.5 ``rank`` passages of one class of lengths."""
    classes: dict[int, list[int]] = {}
    for p, r in enumerate(rows):
        if len(r.words) >= 4:
            classes.setdefault(r.size, []).append(p)
    for size, members in sorted(classes.items()):
        n_spaces = math.ceil(len(members) / (1.5 * rank))
        for number in range(n_spaces):
            own = [p for p in members if rows[p].hash % n_spaces == number]
            if not own:
                continue
            terms = np.unique(np.concatenate([numbers[p] for p in own]))
            local = np.full(len(idf), -1, np.int32)
            local[terms] = np.arange(len(terms))
            vocabulary = {w.encode(): int(local[t]) for p in own for w, t in zip(rows[p].words, numbers[p], strict=True)}
            table = np.zeros((len(own), len(terms)))
            for k, p in enumerate(own):
                np.add.at(table[k], local[numbers[p]], idf[numbers[p]])
            part = passages.filter((F.col("size") == size) & (F.size("words") >= 4) & (F.pmod("hash", F.lit(n_spaces)) == number))
            full = min(len(own), len(terms))
            for width in sorted({min(rank, full), full}):
                vectors = randomised_svd(part, vocabulary, idf[terms], width)
                latent = table @ vectors
                lengths = np.linalg.norm(latent, axis=1)
                if (lengths**2 >= KEPT * (table**2).sum(axis=1)).all():
                    break
            latent /= np.maximum(lengths, 1e-12)[:, None]
            weighted = np.vstack([vectors * idf[terms, None], np.zeros((1, vectors.shape[1]))])
            yield Space(size, local, weighted.astype(np.float32), latent.astype(np.float32), np.array(own))


def indexes(docs: DataFrame, items: DataFrame, rank: int, block: int) -> Iterator[Index]:
    """The benchmark in blocks of about ``block`` passages, whatever items they are of; one is built at a time.

    So a block has at most about ``block`` x PASSAGE words, and vectors of ``rank`` numbers for each.
    """
    texts = items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct().withColumn("item_key", F.xxhash64(F.coalesce("item_id", F.lit(-1)), F.col("item_id").isNull(), "text"))
    size = F.greatest(F.lit(4), F.pow(F.lit(2), F.ceil(F.log2(F.size("words"))))).cast("int")
    everything = stored(passages_of(texts).withColumn("size", size).withColumn("hash", F.xxhash64("start", "words")), "passages")
    n_blocks = max(1, math.ceil(everything.count() / block))
    for number in range(n_blocks):
        passages = everything.filter(F.pmod(F.xxhash64("item_key", "start"), F.lit(n_blocks)) == number)
        rows = sorted(passages.collect(), key=lambda r: (r.item_key, r.start))  # a block is of bounded size
        if not rows:
            continue
        vocabulary = {w: k for k, w in enumerate(sorted({w.encode() for r in rows for w in r.words}))}
        df, n = corpus_frequencies(docs, vocabulary)
        idf = np.log((n + 1) / (df + 0.5)).clip(0.01)
        numbers = [[vocabulary[w.encode()] for w in r.words] for r in rows]
        grams = []
        for length in range(1, GRAM + 1):  # shorter passages have to stand as a whole
            own = [p for p, ids in enumerate(numbers) if min(len(ids), GRAM) == length]
            if own:
                keys = [gram_keys(np.array(numbers[p]), length, len(vocabulary)) for p in own]
                at = np.concatenate([np.c_[np.full(len(k), p), np.arange(len(k))] for p, k in zip(own, keys, strict=True)])
                order = np.argsort(np.concatenate(keys), kind="stable")
                grams.append(Grams(length, np.concatenate(keys)[order], at[order, 0], at[order, 1]))
        spaces = list(spaces_of(passages, rows, numbers, idf, rank))
        # A word that the benchmark lacks weighs as much as a usual one of its own, in a corpus of any size.
        yield Index(vocabulary, idf, float(np.median(idf)), [(r.item_key, r.item_id) for r in rows], numbers, [r.n_words for r in rows], [[w.encode() for w in r.answer] for r in rows], spaces, grams)


def found_rows(docs: DataFrame, items: DataFrame, cosine: float = 0.3, rank: int = 256, least: float = 0.6, with_answer: float = 0.45, block: int = 4_000) -> DataFrame:
    """``benchmark_hits`` with the hash of the document's text and a key of the item's id and text."""
    parts: list[DataFrame] = []
    for index in indexes(docs, items, rank, block):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(ids: list, hashes: list, texts: list, shared=shared) -> Iterator[tuple]:
            index = shared.value
            get = index.vocabulary.get
            for doc_id, text_hash, text in zip(ids, hashes, texts, strict=True):
                words = words_of(text)
                numbers = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
                best: dict[tuple, tuple] = {}
                paths: dict[tuple, set] = {}

                def verify(start: int, end: int, p: int, near: float | None) -> None:
                    passage, item = index.passages[p], index.owner[p]
                    slack = min(STRIDE, (end - start + 1) // 2) if len(passage) >= 4 else 0
                    low, high = max(0, start - slack), min(len(words), end + slack)
                    asked = min(least, with_answer) if len(passage) >= 8 else least if len(passage) >= 4 else 1
                    place = numbers[low:high].tolist()
                    if sum(map(set(place).__contains__, passage)) < asked * len(passage):
                        return  # a common subsequence has no more words than the two share
                    share = lcs_length(passage, place) / len(passage)
                    if share < asked:
                        return
                    answer, n = index.answers[p], index.n_words[p]
                    found = lcs_length(answer, words[max(0, start - n) : max(0, end + n)]) == len(answer)
                    if share >= (least if len(passage) >= 4 else 1) or found:
                        paths.setdefault(item, set()).add(near is not None)
                        if near is None:
                            near = index.cosine(numbers[max(0, start) : max(0, end)], passage)
                        row = (share, near, found, low, high)
                        best[item] = max(best.get(item, row), row)

                for start, end, p, near in index.near(numbers, cosine):
                    verify(start, end, p, near)
                for start, p in index.shared(numbers):
                    verify(start, start + len(index.passages[p]), p, None)
                for item, (share, near, found, low, high) in best.items():
                    yield doc_id, text_hash, *item, max(0.0, min(1.0, near)), share, found, low, high - 1, True in paths[item], False in paths[item]

        parts[-1:] = [stored(x, "hits") for x in parts[-1:]]  # done before the next block is built
        parts.append(arrow_map(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), utf8()), run, HITS))
    found = reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], HITS)
    # Passages of an item may lie in several blocks.
    best = F.max(F.struct("lcs", "cosine", "answer_found", "first_word", "last_word")).alias("best")
    paths = [F.max(c).alias(c) for c in ("by_latent", "by_runs")]
    return found.groupBy("doc_id", "text_hash", "item_key", "item_id").agg(best, *paths).select("doc_id", "text_hash", "item_key", "item_id", "best.*", "by_latent", "by_runs")


def benchmark_hits(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """One row per document and benchmark item that it holds: doc_id, item_id, cosine, lcs, answer_found,
    first_word, last_word, and which
    search found it: by_latent (windows near a passage), by_runs (words in a row).

    ``docs`` (doc_id, text) is compared with every row of ``items`` (item_id, text). Candidates are windows near
    a passage in the latent space (``cosine``, ``rank``) and places that share ``GRAM`` words in a row with one. A
    candidate is a hit if the longest common subsequence with the passage is at least ``least`` of it, or at least
    ``with_answer`` of it while the item's last words, its answer, stand near the window in full. Null and
    empty texts hold nothing; items without words are in no document. Null doc_ids and item_ids are kept: a row
    is known by its id and text, an item by its id and text too, so that an id with two texts is two items.
    Repeated rows count once. Passages with fewer than four words must stand in full, word after word.
    """
    return found_rows(docs, items, **options).select("doc_id", "item_id", "cosine", "lcs", "answer_found", "first_word", "last_word", "by_latent", "by_runs")


def decontaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns. Rows go by their own text: others with
    the same id, or without one, stay."""
    rows = found_rows(docs.select("doc_id", "text"), items, **options)
    hits = stored(rows.select(F.col("doc_id").alias("_hit_id"), F.col("text_hash").alias("_hit_hash")).distinct(), "hits")
    return docs.join(hits, docs.doc_id.eqNullSafe(F.col("_hit_id")) & (F.xxhash64(docs.text) == F.col("_hit_hash")), "left_anti")
