"""Lexical retrieval packing: a sharded BM25 inverted index finds neighbours that fill a seed's window.

The token ids are the index terms. Document frequencies and the mean length are counted over all documents;
each shard, a run of rows of the stored token table, has its own inverted index of its documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, stored
from .tokens import piece_cache

END_ID = 0
VOCABULARY = 1 << 16
K1, B = 1.2, 0.75


def encoded(docs: DataFrame, tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """(doc_id, ids): every document's ids and an end id, as little-endian unsigned 16-bit numbers."""
    end = np.array([END_ID], "<u2").tobytes()

    def run(ids: list, texts: list) -> Iterator[tuple]:
        cache = piece_cache(tokenizer)
        for doc_id, text in zip(ids, texts, strict=True):
            yield doc_id, cache.packed(text) + end

    return arrow_map(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), run, "doc_id long, ids binary", flush=1024)


def id_statistics(tokens: DataFrame) -> tuple[np.ndarray, float]:
    """Document frequency of each id and the mean document length, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(VOCABULARY, np.int64)
        docs = total = 0
        for batch in batches:
            for ids in batch.column(0).to_pylist():
                ids = np.frombuffer(ids, "<u2")
                docs += 1
                total += len(ids)
                seen = np.zeros(VOCABULARY, bool) if len(ids) > 20_000 else None
                if seen is not None:
                    seen[ids] = True
                    df += seen
                else:
                    df[np.unique(ids)] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-2, -1, at]), pa.array(np.r_[docs, total, df[at]])], names=["id", "n"])

    # One row per id of a vocabulary of fixed size: what the driver gets doesn't grow with the input.
    rows = tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    n = dict(zip(rows["id"].tolist(), rows["n"].tolist(), strict=True))
    df = np.zeros(VOCABULARY, np.int64)
    for at, k in n.items():
        if at >= 0:
            df[at] = k
    return df, n.get(-1, 0) / max(1, n.get(-2, 0))


class Shard:
    """BM25 index of a bounded run of documents, each of which is a query with all of its terms.

    Terms that most postings are of make a dense part, one matrix product for all pairs of documents of the shard;
    the others are postings, which
    a seed's query goes through. Both parts add up to the exact score.
    """

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean: float, dense: int = 1024):
        doc, term, tf = [], [], []
        for d, x in enumerate(ids):
            t, n = np.unique(x, return_counts=True)
            term.append(t)
            tf.append(n)
            doc.append(np.full(len(t), d, np.int32))
        doc, term, tf = (np.concatenate(x) if x else np.empty(0, np.int32) for x in (doc, term, tf))
        length = np.array([len(x) for x in ids], np.float32)[doc] if len(doc) else np.empty(0, np.float32)
        weight = (idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / max(mean, 1)))).astype(np.float32)
        here = np.bincount(term, minlength=VOCABULARY)
        shared = (here[term] > 1) & (weight > 0)  # what no other document here has finds none
        doc, term, weight = doc[shared], term[shared], weight[shared]
        often = np.argsort(-here, kind="stable")[:dense]
        column = np.full(VOCABULARY, -1)
        column[often] = np.arange(len(often))
        there = column[term] >= 0
        table = np.zeros((len(ids), len(often)), np.float32)
        table[doc[there], column[term[there]]] = weight[there]
        self.scores = (table > 0).astype(np.float32) @ table.T  # row: the seed
        doc, term, weight = doc[~there], term[~there], weight[~there]
        self.query_of, self.query = np.searchsorted(doc, np.arange(len(ids) + 1)), term
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.at = np.searchsorted(term[order], np.arange(VOCABULARY + 1))
        self.size = len(ids)

    def scored(self, seed: int) -> np.ndarray:
        """The BM25 score of every document of the shard for the seed's terms."""
        score = self.scores[seed].astype(np.float64)
        terms = self.query[self.query_of[seed] : self.query_of[seed + 1]]
        if len(terms):
            low = self.at[terms]
            counts = self.at[terms + 1] - low
            span = np.repeat(low + counts - np.cumsum(counts), counts) + np.arange(counts.sum())
            score += np.bincount(self.doc[span], self.weight[span], self.size)
        return score

    def neighbours(self, seed: int, among: np.ndarray | None = None, first: int = 64) -> Iterator[int]:
        """Documents of ``among`` that share a term with the seed, best score first, lower number first on ties."""
        score = self.scored(seed)
        found = np.flatnonzero(score > 0) if among is None else np.flatnonzero(among & (score > 0))
        if len(found) > 4 * first:  # few are needed, as a rule
            least = np.partition(score[found], len(found) - first)[len(found) - first]
            top = found[score[found] >= least]
            yield from top[np.lexsort((top, -score[top]))].tolist()
            found = found[score[found] < least]
        yield from found[np.lexsort((found, -score[found]))].tolist()


def _order(shard: Shard, lengths: np.ndarray, window: int, used: int) -> Iterator[int]:
    """The order in which a shard's documents are laid down: neighbours of a window's seed fill it up."""
    unused = np.ones(shard.size, bool)
    ahead = 0
    filled = used
    while True:
        while ahead < shard.size and not unused[ahead]:
            ahead += 1
        if ahead == shard.size:
            return
        seed = ahead
        while seed is not None:
            unused[seed] = False
            yield seed
            filled = (filled + int(lengths[seed])) % window
            # The window that holds the seed's end is filled by the seed's neighbours; the one that
            # crosses its border is the seed of the next window.
            follow = None
            if filled:
                for d in shard.neighbours(seed, unused.copy()):
                    if filled + int(lengths[d]) >= window:
                        follow = d
                        break
                    unused[d] = False
                    yield d
                    filled += int(lengths[d])
            seed = follow


def packed_pieces(tokens: DataFrame, window: int = 1024, shard_tokens: int = 2_000_000, shard_documents: int = 4096) -> DataFrame:
    """Pieces of sequences of at most ``window`` tokens from a stored table (doc_id, ids).

    Every id lies in exactly one piece. Sequences are full, but for the last ones of a partition: what is left
    there is cut into lengths that are powers of two, so nothing is padded.
    """
    if window & (window - 1) or window < 1:
        raise ValueError("window must be a power of two")
    df, mean = id_statistics(tokens)
    n_docs = int(df[END_ID])
    idf = np.log1p((n_docs - df + 0.5) / (df + 0.5)).astype(np.float32)
    idf[END_ID] = 0
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        sequence, offset = 0, 0
        last: list[list] = []  # pieces of the open sequence, with their ids
        out: list[tuple] = []
        held: list[tuple[int, np.ndarray]] = []

        def piece(doc_id, start: int, part: np.ndarray, total: int, sequence: int, offset: int) -> tuple:
            return doc_id, start, len(part), zlib.crc32(part.astype("<u4").tobytes()), total, base + sequence, offset

        def shard() -> None:
            nonlocal sequence, offset, last
            lengths = np.array([len(x) for _, x in held], np.int64)
            index = Shard([x for _, x in held], idf, mean)
            for d in _order(index, lengths, window, offset):
                doc_id, ids = held[d]
                start = 0
                while start < len(ids):
                    part = ids[start : start + window - offset]
                    last.append([doc_id, start, part, len(ids)])
                    start += len(part)
                    offset += len(part)
                    if offset == window:
                        close(last, sequence)
                        sequence, offset, last = sequence + 1, 0, []

        def close(pieces: list[list], number: int) -> None:
            at = 0
            for doc_id, start, part, total in pieces:
                out.append(piece(doc_id, start, part, total, number, at))
                at += len(part)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

        size = 0
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append((doc_id, np.frombuffer(ids, "<u2")))
                size += len(ids) // 2
                if size >= shard_tokens or len(held) == shard_documents:
                    shard()
                    held, size = [], 0
                    if out:
                        yield batch_of(out)
                        out = []
        if held:
            shard()
        left = offset
        while left:  # the open sequence, cut at powers of two
            room = 1 << (left.bit_length() - 1)
            now, later, filled = [], [], 0
            for doc_id, start, part, total in last:
                take = min(len(part), room - filled)
                if take:
                    now.append([doc_id, start, part[:take], total])
                    filled += take
                if take < len(part):
                    later.append([doc_id, start + take, part[take:], total])
            close(now, sequence)
            sequence, last, left = sequence + 1, later, left - room
        if out:
            yield batch_of(out)

    return tokens.select("doc_id", "ids").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def retrieval_packing(docs: DataFrame, tokenizer: str = "byte_bpe_50k", window: int = 1024, shard_tokens: int = 2_000_000, shard_documents: int = 4096) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``docs`` (doc_id, text): a null or empty text is its end id alone, a long one is packed whole. A null doc_id is
    kept, and repeated
    rows are packed once each; an empty table gives no piece. A seed's neighbours are looked for in its own shard,
    by all of its terms; a shard ends at
    ``shard_tokens`` or ``shard_documents``. Documents that share no term still follow, in table order, so all are
    packed. Extra columns are not read.
    """
    return packed_pieces(stored(encoded(docs, tokenizer), "tokens"), window, shard_tokens, shard_documents)
