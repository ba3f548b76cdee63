"""Source divergence: how far the word frequencies of the sources of a language lie apart, in exact arithmetic.

The counts of a group (language, source) over the terms of its language are the leaves of a segment tree. Trees are
hash-consed: equal subtrees, of any group and at any place of one height, are one node. Two groups are compared by going down
both trees at once; a pair of nodes that was met before is not gone through again, but counts again.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, utf8

TERM = re.compile(rb"[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
#: What a document adds to the number that a task holds for a term: places in the low bits, documents above them.
DOC = 1 << 40
#: Fixed values of the smoothed share: 1 + floor(UNIT * (count + ADDED) / (total + ADDED * terms)).
UNIT, ADDED = 1_000_000_000, 5


def term_counts(docs: DataFrame, flush: int = 400_000) -> DataFrame:
    """(lang, source, term, n, docs) of every term of the whole texts; a row without term stands for each group that occurs.

    A task sums its texts first, ``flush`` terms at a time, so a hot source or term is a few rows of each task.
    """

    def run(batches):
        import pyarrow as pa

        def out():
            groups, sizes = list(held), [len(own) for own in held.values()]
            names = [pa.array(np.repeat(np.array([g[k] for g in groups], object), sizes), pa.string()) for k in (0, 1)]
            terms = pa.array([t for own in held.values() for t in own], pa.binary()).cast(pa.string())
            both = np.fromiter((v for own in held.values() for v in own.values()), np.int64, sum(sizes))
            return pa.RecordBatch.from_arrays([*names, terms, pa.array(both & (DOC - 1)), pa.array(both >> 40)], names=["lang", "source", "term", "n", "docs"])

        held: dict[tuple[str, str], dict] = {}
        size = rows = 0
        for batch in batches:
            for text, lang, source in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                own = held.setdefault((lang or "", source or ""), {None: 0})
                before = len(own)
                for term, n in Counter(TERM.findall(text.lower())).items():
                    own[term] = own.get(term, 0) + n + DOC
                size += len(own) - before
                rows += 1
                if size >= flush or rows == 1 << 20:
                    yield out()
                    held, size, rows = {}, 0, 0
        if held:
            yield out()

    rows = docs.select(utf8(), *(F.col(c).cast("string") for c in ("lang", "source"))).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """The smoothed shares of counts, exact at any size."""
    below = total + ADDED * terms
    if not len(counts) or int(counts.max()) < 2**63 // UNIT - ADDED:
        return 1 + UNIT * (counts + ADDED) // below
    return np.array([1 + UNIT * (int(c) + ADDED) // below for c in counts], dtype=object)


class SegmentTrees:
    """Hash-consed trees over rows of counts, all of ``width`` leaves, a power of two."""

    def __init__(self, counts: np.ndarray):
        self.leaves, level = np.unique(counts, return_inverse=True)
        level = level.reshape(counts.shape)
        self.children: list[np.ndarray] = []  # by height: the two nodes below each node
        while level.shape[1] > 1:
            pairs = level[:, 0::2].astype(np.int64) << 32 | level[:, 1::2]
            made, level = np.unique(pairs, return_inverse=True)
            level = level.reshape(pairs.shape)
            self.children.append(np.stack([made >> 32, made & 0xFFFFFFFF], 1))
        self.roots = level[:, 0]

    def leaf_pairs(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs of counts that stand at the same leaf of trees ``a`` and ``b``, and at how many leaves each.

        All pairs of nodes of one height are gone through at once; a pair met again only adds to its number of places.
        """
        u, v, times = self.roots[[a]], self.roots[[b]], np.ones(1, np.int64)
        for below in reversed(self.children):
            pairs = np.concatenate([below[u, 0] << 32 | below[v, 0], below[u, 1] << 32 | below[v, 1]])
            pairs, at = np.unique(pairs, return_inverse=True)
            times = np.bincount(at, np.concatenate([times, times]), len(pairs)).astype(np.int64)
            u, v = pairs >> 32, pairs & 0xFFFFFFFF
        return self.leaves[u], self.leaves[v], times

    def distance(self, a: int, b: int, totals: list[int], terms: int, padding: int) -> int:
        """Sum of the absolute differences of the shares of two trees over all leaves but ``padding`` ones without counts."""
        if self.roots[a] == self.roots[b] and totals[a] == totals[b]:
            return 0
        left, right, times = self.leaf_pairs(a, b)
        apart = np.abs(shares(left, totals[a], terms) - shares(right, totals[b], terms))
        nothing = np.zeros(1, np.int64)
        return sum(int(x) * int(n) for x, n in zip(apart, times, strict=True)) - padding * int(abs(shares(nothing, totals[a], terms) - shares(nothing, totals[b], terms))[0])


def cell_distances(cell: pd.DataFrame) -> pd.DataFrame:
    """(lang, a, b, value) over one block of terms, for the pairs of sources that belong to the cell.

    ``cell`` has a row (source, total, terms, chunk, place, n) for each count, and one without place for each source.
    Places of terms ascend with their frequency, so that those which most sources lack lie together.
    """
    first = cell.iloc[0]
    names, rows = np.unique(cell["source"].to_numpy(object), return_inverse=True)
    has = cell["place"].notna().to_numpy()
    width = int(first["width"])
    counts = np.zeros((len(names), 1 << max(width - 1, 0).bit_length()), np.int64)
    counts[rows[has], cell["place"].to_numpy()[has].astype(np.int64)] = cell["n"].to_numpy()[has].astype(np.int64)
    marks = cell[~has].drop_duplicates("source").set_index("source")
    totals, chunks = [int(marks.at[x, "total"]) for x in names], [int(marks.at[x, "chunk"]) for x in names]
    trees, terms, padding = SegmentTrees(counts), int(first["terms"]), counts.shape[1] - width
    low, high = int(first["low"]), int(first["high"])
    found = [
        (first["lang"], names[a], names[b], trees.distance(a, b, totals, terms, padding))
        for a in range(len(names)) for b in range(a + 1, len(names)) if {chunks[a], chunks[b]} == {low, high}
    ]
    return pd.DataFrame(found, columns=["lang", "a", "b", "value"])


def source_divergence(docs: DataFrame, least_docs: int = 30, top: int = 50, block_terms: int = 4096, chunk_sources: int = 64) -> DataFrame:
    """lang, source, part, item, value, rank: part ``pair`` ranks the other sources of a language by distance, part ``term`` the
    terms that a source has more often than its language.

    Terms that stand in ``least_docs`` rows of a language count. Null text, lang and source are read as empty; a
    source without terms, and a
    language without kept terms, have their rows too (value 0 in the latter). Repeated rows count again, ties rank
    by item, texts
    are read whole; an empty table gives no row. Other columns are not read.

    The terms of a language are dealt to blocks of about ``block_terms`` and its sources to chunks of
    ``chunk_sources``; a cell (block, two chunks) holds the
    counts of two chunks at most, whatever the size of a language, and the distances of its cells add up.
    """
    found = stored(term_counts(docs), "term_counts")
    terms = found.filter("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("in_lang")).filter(F.col("docs") >= least_docs)
    kept = stored(found.filter("term is not null").select("lang", "source", "term", "n").join(terms, ["lang", "term"]), "kept_counts")
    of_lang = kept.groupBy("lang").agg(F.count_distinct("term").alias("terms"), F.sum("n").alias("lang_total"))
    groups = found.filter("term is null").select("lang", "source").join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
    n_sources = found.filter("term is null").groupBy("lang").agg(F.count("*").alias("sources"))
    groups = groups.join(of_lang, "lang", "left").join(n_sources, "lang").fillna(0, ["total", "terms", "lang_total"])
    chunks = F.ceil(F.col("sources") / chunk_sources)
    groups = stored(groups.withColumn("chunk", F.pmod(F.xxhash64("source"), chunks)).withColumn("chunks", chunks), "groups")
    distances = pair_distances(kept, groups, block_terms)
    pairs = ranked_pairs(distances, groups)
    above = ranked_terms(kept, groups, top)
    return pairs.unionByName(above)


def pair_distances(kept: DataFrame, groups: DataFrame, block_terms: int) -> DataFrame:
    """(lang, a, b, value), a < b, of the sources of each language with kept terms."""
    of_lang = groups.select("lang", "terms").distinct()
    blocks = F.ceil(F.col("terms") / block_terms)
    placed = kept.select("lang", "term", "in_lang").distinct().join(F.broadcast(of_lang) if of_lang.count() <= 10_000 else of_lang, "lang")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("term"), blocks))
    in_block = Window.partitionBy("lang", "block")
    placed = placed.withColumn("place", F.row_number().over(in_block.orderBy("in_lang", "term")) - 1).withColumn("width", F.count("*").over(in_block))
    placed = stored(placed.select("lang", "term", "block", "place", "width"), "places")
    counts = kept.select("lang", "source", "term", "n").join(placed, ["lang", "term"]).select("lang", "source", "block", "place", "n", "width")
    widths = placed.select("lang", "block", "width").distinct()
    own = groups.filter("terms > 0")
    marks = own.select("lang", "source").join(widths, "lang").select("lang", "source", "block", F.lit(None).cast("int").alias("place"), F.lit(None).cast("long").alias("n"), "width")
    rows = counts.unionByName(marks).join(own.select("lang", "source", "total", "terms", "chunk", "chunks"), ["lang", "source"])
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    rows = rows.withColumn("low", F.least("chunk", "other")).withColumn("high", F.greatest("chunk", "other"))
    rows = rows.select("lang", "block", "low", "high", "source", "place", "n", "width", "total", "terms", "chunk")
    parts = rows.groupBy("lang", "block", "low", "high").applyInPandas(cell_distances, "lang string, a string, b string, value long")
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def ranked_pairs(distances: DataFrame, groups: DataFrame) -> DataFrame:
    """Both directions of each pair, and all pairs of a language without kept terms, at distance 0, by rank."""
    both = distances.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), "value")
    bare = groups.filter("terms = 0").select("lang", "source")
    zero = bare.join(bare.withColumnRenamed("source", "item"), "lang").filter("source <> item").withColumn("value", F.lit(0).cast("long"))
    rows = both.select("lang", "x.source", "x.item", "value").unionByName(zero)
    return ranked(rows, "pair")


def ranked_terms(kept: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    exact = lambda n, total: (1 + F.floor(F.expr(f"(cast({UNIT} as decimal(10,0)) * cast({n} + {ADDED} as decimal(20,0))) div cast({total} + {ADDED} * terms as decimal(20,0))"))).cast("long")
    rows = kept.join(groups.select("lang", "source", "total", "terms", "lang_total"), ["lang", "source"])
    rows = rows.select("lang", "source", F.col("term").alias("item"), (exact("n", "total") - exact("in_lang", "lang_total")).alias("value")).filter("value > 0")
    return ranked(rows, "term").filter(F.col("rank") <= top)


def ranked(rows: DataFrame, part: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank.alias("rank"))
