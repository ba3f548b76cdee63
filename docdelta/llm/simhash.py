"""SimHash near-dedup: deletion-variant signatures over 64-bit fingerprints.

Two fingerprints that differ in at most three bits, cut into two segments, have one segment that differs in
at most one bit. So each distinct fingerprint is indexed under its two segments with one bit masked out, for
every bit; equal keys give candidates, which are verified by a bit count. Buckets are worked on in sorted
runs; a bucket of more than ``bucket`` fingerprints goes to the next level, where the part that is still free
is cut and masked again. After the last level a bucket has 11 free bits, so 2048 fingerprints at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, stored, utf8
from .components import components
from .similar_texts import band_keys, shingles, similar_links

#: Per level: width of the free part that is cut into halves. 64 bits, then the 32 and 16 bits left over.
LEVELS = (64, 32, 16)


def fingerprint(text: bytes, size: int = 3) -> int:
    """Bit k is set if it is set in over half of the shingles' XXH64 (seed 42). No words: 0."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < size:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(b" ".join(s), 42) for s in zip(*(words[k:] for k in range(size)), strict=False)), np.uint64, len(words) - size + 1)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp): the fingerprint as a signed long. A null or empty text has fingerprint 0."""

    def run(ids: list, hashes: list, texts: list) -> Iterator[tuple]:
        for doc_id, text_hash, text in zip(ids, hashes, texts, strict=True):
            fp = fingerprint(text, size)
            yield doc_id, text_hash, fp - (1 << 64) if fp >> 63 else fp

    return arrow_map(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), utf8()), run, "doc_id long, text_hash long, fp long")


def sketches(docs: DataFrame, size: int = 3) -> DataFrame:
    """``fingerprints`` with ``bands``, the keys by which similar texts are found."""

    def run(ids: list, hashes: list, texts: list) -> Iterator[tuple]:
        for doc_id, text_hash, text in zip(ids, hashes, texts, strict=True):
            fp = fingerprint(text, size)
            yield doc_id, text_hash, fp - (1 << 64) if fp >> 63 else fp, band_keys(shingles(text.lower().split()))

    return arrow_map(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), utf8()), run, "doc_id long, text_hash long, fp long, bands array<long>")


def roots(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Components of the links of one task: (node, smallest node) for each node that is not the smallest."""
    nodes, inverse = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = inverse[: len(left)], inverse[len(left) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


def variants(level: int) -> list[tuple[int, int]]:
    """(mask of the bits that a key keeps of the free part, its width) by segment and masked bit."""
    width = LEVELS[level] // 2
    return [((((1 << width) - 1) << (half * width)) & ~(1 << (half * width + bit)), half) for half in (0, 1) for bit in range(width)]


def _bucket_links(fps: np.ndarray, distance: int) -> tuple[list, list]:
    """Verified links inside a bucket, no more than a spanning forest of them for each block of rows."""
    left, right = [], []
    for start in range(0, len(fps), 256):
        block = fps[start : start + 256]
        near = np.bitwise_count(block[:, None] ^ fps[None, :]) <= distance
        i, j = np.nonzero(near)
        keep = start + i < j
        if keep.any():
            a, b = roots(fps[start + i[keep]].view(np.int64), fps[j[keep]].view(np.int64))
            left.append(a)
            right.append(b)
    return left, right


def _links(keyed: DataFrame, distance: int, bucket: int, last: bool) -> DataFrame:
    """Sorted runs of (key, fp): ``node, root`` for links, ``fp, key`` of rows in large buckets."""
    schema = "a long, b long, large boolean"
    names = ["a", "b", "large"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_k = np.empty(0, np.int64)
        rest_f = np.empty(0, np.uint64)
        passing: int | None = None  # the key of a large bucket whose first rows have gone on
        links_a: list[np.ndarray] = []
        links_b: list[np.ndarray] = []
        held = 0

        def out(a: np.ndarray, b: np.ndarray, large: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(np.full(len(a), large))], names=names)

        def runs(keys: np.ndarray, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
            counts = np.diff(edges)
            two = edges[:-1][counts == 2]
            if len(two):
                f, g = fps[two], fps[two + 1]
                near = np.bitwise_count(f ^ g) <= distance
                links_a.append(f[near].view(np.int64))
                links_b.append(g[near].view(np.int64))
            for k in np.flatnonzero(counts > 2):
                group = slice(edges[k], edges[k + 1])
                if counts[k] > bucket and not last:
                    yield fps[group].view(np.int64), keys[group]
                else:
                    a, b = _bucket_links(fps[group], distance)
                    links_a.extend(a)
                    links_b.extend(b)

        for batch in batches:
            keys = np.concatenate([rest_k, batch.column(0).to_numpy()])
            fps = np.concatenate([rest_f, batch.column(1).to_numpy().view(np.uint64)])
            if not len(keys):
                continue
            if passing is not None:
                same = int(np.searchsorted(keys, passing, side="right"))
                if same:
                    yield out(fps[:same].view(np.int64), keys[:same], True)
                keys, fps = keys[same:], fps[same:]
                if not len(keys):
                    rest_k, rest_f = keys, fps
                    continue
                passing = None
            cut = int(np.searchsorted(keys, keys[-1], side="left"))
            for f, k in runs(keys[:cut], fps[:cut]) if cut else ():
                yield out(f, k, True)
            rest_k, rest_f = keys[cut:], fps[cut:]
            if len(rest_k) > bucket and not last:
                passing = int(rest_k[0])
                yield out(rest_f.view(np.int64), rest_k, True)
                rest_k, rest_f = rest_k[:0], rest_f[:0]
            held = sum(map(len, links_a))
            if held > 2_000_000:
                a, b = roots(np.concatenate(links_a), np.concatenate(links_b))
                yield out(a, b, False)
                links_a, links_b = [], []
        if len(rest_k):
            for f, k in runs(rest_k, rest_f):
                yield out(f, k, True)
        if links_a:
            a, b = roots(np.concatenate(links_a), np.concatenate(links_b))
            yield out(a, b, False)

    return keyed.mapInArrow(run, schema)


def near_links(fps: DataFrame, distance: int = 3, bucket: int = 2048) -> DataFrame:
    """Links (a, b) that join distinct fingerprints ``fp`` within ``distance`` (3 at most) into their components.

    Not every pair comes out, but any two fingerprints within the distance are in one component of the links.
    """
    if not 0 <= distance <= 3:
        raise ValueError("two segments, one of which differs by at most one bit, need a distance of 3 or less")
    found = None
    at = fps.select("fp", F.lit(0).cast("long").alias("bucket_key"), F.lit(0).alias("free"))
    for level in range(len(LEVELS)):
        last = level == len(LEVELS) - 1
        # What is still free after a key: the other segment (and the masked bit, which no later key keeps).
        masks = F.array(*[F.struct(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long").alias("mask"), F.lit(half).alias("half"), F.lit(k).alias("variant")) for k, (mask, half) in enumerate(variants(level))])
        offset = F.col("free")
        cut = at.select("fp", "bucket_key", "free", F.explode(masks).alias("v"))
        kept = F.col("fp").bitwiseAND(F.expr("shiftleft(v.mask, free)"))
        width = LEVELS[level] // 2
        keyed = cut.select(
            # variant, kept bits and the key so far; equal keys of unequal buckets only add candidates
            F.xxhash64("bucket_key", "free", "v.variant", kept).alias("key"),
            "fp",
            (offset + F.when(F.col("v.half") == 0, width).otherwise(0)).alias("free"),
        )
        # The place of the free part is fixed by the variant; it goes into the key's lowest bits.
        spot = (F.col("free") / (LEVELS[-1] // 2)).cast("long")
        keyed = keyed.select(F.expr("shiftleft(shiftrightunsigned(key, 3), 3)").bitwiseOR(spot).alias("key"), "fp")
        out = stored(_links(keyed.repartition(F.col("key")).sortWithinPartitions("key"), distance, bucket, last), f"simhash-{level}")
        links = out.filter(~F.col("large")).select("a", "b")
        found = links if found is None else found.unionByName(links)
        large = out.filter("large")
        if last or large.isEmpty():
            break
        at = large.select(F.col("a").alias("fp"), F.col("b").alias("bucket_key"), (F.col("b").bitwiseAND(F.lit(7).cast("long")) * (LEVELS[-1] // 2)).cast("int").alias("free"))
    return found


def grouped(own: DataFrame, distance: int, bucket: int, more: DataFrame | None = None) -> DataFrame:
    """Per fingerprint of ``own`` (doc_id, text_hash, fp): n rows, component_id, and the component's first row.

    ``more`` are links (a, b) between fingerprints beside those within the distance.

    Rows come in the order of doc_id, nulls last, and text_hash. ``first`` is the fingerprint's own first row,
    ``keeper`` that of its component.
    """
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    distinct = stored(own.groupBy("fp").agg(F.min(row).alias("first"), F.count("*").alias("n")), "distinct")
    links = near_links(distinct.select("fp"), distance, bucket)
    links = links if more is None else links.unionByName(more)
    label = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    tied = distinct.join(label.withColumnRenamed("node", "fp"), "fp")
    least = tied.groupBy("root").agg(F.min("first").alias("keeper"))
    joined = tied.join(least, "root").select("fp", "keeper")
    return distinct.join(joined, "fp", "left").withColumn("keeper", F.coalesce("keeper", "first")).withColumn("component_id", F.col("keeper.doc_id"))


def simhash_groups(docs: DataFrame, distance: int = 3, size: int = 3, bucket: int = 2048) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs`` (doc_id, text).

    Documents are in one component if a chain of fingerprints, each within ``distance`` bits of the next,
    joins them; ``component_id`` is its smallest doc_id. Null, empty and blank texts have fingerprint zero
    and are linked like any other. Rows with a null doc_id take part; a component of such rows alone has a
    null component_id. Repeated rows give repeated results.
    """
    own = stored(fingerprints(docs, size), "fingerprints")
    by_fp = stored(grouped(own, distance, bucket).select("fp", "n", "component_id"), "by-fingerprint")
    # Fingerprints of more than a thousandth of all rows are fewer than a thousand, so they are broadcast;
    # without them no key of the other join has more rows than that.
    hot = F.col("n") * 1000 > own.count()
    looked = own.select("doc_id", "fp").join(F.broadcast(by_fp.filter(hot).select("fp", "component_id", F.lit(True).alias("found"))), "fp", "left")
    rest = looked.filter("found is null").select("doc_id", "fp").join(by_fp.filter(~hot).select("fp", "component_id"), "fp")
    both = looked.filter("found").select("doc_id", "fp", "component_id").unionByName(rest.select("doc_id", "fp", "component_id"))
    return both.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, distance: int = 3, size: int = 3, bucket: int = 2048, similarity: float = 0.8) -> DataFrame:
    """One row of ``docs`` for each group of near copies, with all its columns.

    Groups are the components of ``simhash_groups``, joined where two texts have a Jaccard ``similarity`` of their
    five-word shingles or more. The row with the smallest doc_id stays, then the smallest hash of its text; rows without
    an id come last, so that one stays only where no row of the group has an id. Of rows with equal id and text
    one stays. Null, empty and blank texts are one group.
    """
    own = stored(sketches(docs, size), "fingerprints")
    first = grouped(own, distance, bucket, similar_links(docs, own, similarity)).filter("first = keeper")
    keys = {"_no_id": F.col("doc_id").isNull(), "_id": F.coalesce("doc_id", F.lit(0)), "_hash": F.xxhash64("text")}
    kept = first.select(F.col("keeper.no_id").alias("_no_id"), F.coalesce("keeper.doc_id", F.lit(0)).alias("_id"), F.col("keeper.text_hash").alias("_hash"))
    # The join leaves its rows by these keys, so that texts move once.
    rows = docs.select("*", *(c.alias(k) for k, c in keys.items())).join(stored(kept, "first"), list(keys), "left_semi")
    return rows.dropDuplicates(list(keys)).select(*docs.columns)
