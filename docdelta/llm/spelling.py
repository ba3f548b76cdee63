"""Spelling variants: words one edit apart, by the nodes that their prefixes and suffixes reach in two tries.

Every prefix of a word is a node of the forward trie and every suffix a node of the trie of reversed words. Two words
are one edit apart if and only if they share a pair (prefix node, suffix node) around one skipped place of each, or
around a skipped place of one and an inserted place of the other. The pairs are integers, and a group of equal pairs
holds at most one word for each letter, so all partners of a word are found by grouping, whatever the words.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from os.path import commonprefix
from zlib import crc32

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, discard, stored

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def misspelt(run: str, h: int) -> str:
    """A lower-cased run as it is counted: if 97 divides ``h``, without its code point ``h`` % length."""
    if h % 97:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def word_counts(docs: DataFrame, least_length: int = 5, least_count: int = 3, flush: int = 200_000) -> DataFrame:
    """(word, n) of every run of at least ``least_length`` code points and ``least_count`` places over all whole texts.

    A task sums its texts first, ``flush`` words at a time, so a word that stands everywhere is a few rows.
    """

    def run(batches):
        import pyarrow as pa

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        counts: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                front = crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in Counter(RUN.findall((text or "").translate(LOWER))).items():
                    word = misspelt(word, crc32(word.encode(), front))
                    if len(word) >= least_length:
                        counts[word] += n
                if len(counts) >= flush:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    partial = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string")).mapInArrow(run, "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def common(a: str, b: str) -> int:
    return len(commonprefix((a, b)))


def boundary_runs(bounds: list[str]) -> list[list[tuple[int, int]]]:
    """The path of each bound, as runs (start, base): of its prefixes, those shared with bounds before it have the
    nodes of the first one."""
    out: list[list[tuple[int, int]]] = []
    for q, bound in enumerate(bounds):
        shared = common(bounds[q - 1], bound) if q else 0
        out.append([r for r in (out[-1] if q else []) if r[0] < shared] + [(shared, (q + 1) << 40)])
    return out


def upto(runs: list[tuple[int, int]], depth: int) -> list[tuple[int, int]]:
    return [r for r in runs if r[0] < depth]


def number_nodes(rows: Iterator[tuple], bounds: list[str]) -> Iterator[tuple]:
    """(part, key, others) in order to (id, starts, bases, deep, key, others): the trie nodes of every key.

    The prefix of length d has node ``base + d`` of the last run with ``start`` < d; the empty one has node 0. Keys follow
    each other in order inside a part, and the path of a key is that of the key before it up to their common prefix.
    A prefix that
    goes on beyond the part is one of the bound before or behind it, and has that bound's number. No other key has a
    prefix of more than ``deep`` letters in common with this one.
    """
    paths = boundary_runs(bounds)
    part, key, others = None, "", ()
    runs: list[tuple[int, int]] = []
    deep = place = 0
    following = None

    def out(behind: int) -> tuple:
        return (part << 40) + place, [r[0] for r in runs], [r[1] for r in runs], max(deep, behind), key, others

    for now, next_key, next_others in rows:
        if now != part:
            if part is not None:
                yield out(common(key, bounds[part]) if part < len(bounds) else 0)
            low, high = (bounds[now - 1] if now else ""), (bounds[now] if now < len(bounds) else "")
            part, key, runs, place, following = now, "", [], 0, (now << 40) + (1 << 39)
            at_low, at_high = common(next_key, low), common(next_key, high)
            shared = deep = max(at_low, at_high)
            if shared:
                runs = upto(paths[now - 1] if at_low >= at_high else paths[now], shared)
        else:
            shared = common(key, next_key)
            yield out(shared)
            deep, place = shared, place + 1
            at_high = common(next_key, high) if high else 0
            if at_high > shared:
                runs, shared = upto(paths[now], at_high), at_high
                deep = max(deep, at_high)
            else:
                runs = upto(runs, shared)
        if len(next_key) > shared:
            runs = [*runs, (shared, following - shared)]
            following += len(next_key) - shared
        key, others = next_key, next_others
    if part is not None:
        yield out(common(key, bounds[part]) if part < len(bounds) else 0)


def trie_paths(words: DataFrame, n_words: int, a_part: int = 50_000) -> DataFrame:
    """(id, starts, bases, deep, key, n, word_id) of ``words`` (key, n, word_id), of which no two keys are equal;
    ids ascend with keys.

    Keys are dealt into ranges of about ``a_part`` by bounds from an even sample, one bound a range on the driver.
    """
    parts = max(1, -(-n_words // a_part))
    every = max(1, n_words // (32 * parts))
    sample = sorted(r.key for r in words.filter(F.pmod(F.xxhash64("key"), F.lit(every)) == 0).select("key").collect()) if parts > 1 else []
    bounds = sorted(set(sample[:: max(1, len(sample) // parts)][1:parts]))

    def ranges(keys: list, ns: list, ids: list) -> Iterator[tuple]:
        for key, n, word_id in zip(keys, ns, ids, strict=True):
            yield bisect_right(bounds, key), key, n, word_id

    def number(batches):
        import pyarrow as pa

        def rows():
            for batch in batches:
                parts, keys, ns, ids = (c.to_pylist() for c in batch.columns)
                yield from zip(parts, keys, zip(ns, ids, strict=True), strict=True)

        def out():
            columns = zip(*held, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        names = ["id", "starts", "bases", "deep", "key", "n", "word_id"]
        types = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int32(), pa.string(), pa.int64(), pa.int64()]
        held: list[tuple] = []
        for *row, others in number_nodes(rows(), bounds):
            held.append((*row, *others))
            if len(held) >= 8192:
                yield out()
                held = []
        if held:
            yield out()

    dealt = arrow_map(words.select("key", "n", "word_id"), ranges, "part long, key string, n long, word_id long")
    dealt = dealt.repartition(parts, "part").sortWithinPartitions("part", "key")
    return dealt.mapInArrow(number, "id long, starts array<int>, bases array<long>, deep int, key string, n long, word_id long")


def nodes(starts: list[int], bases: list[int], length: int) -> list[int]:
    """The nodes of the prefixes of 0, 1, ... ``length`` letters."""
    out = [0]
    for start, end, base in zip(starts, [*starts[1:], length], bases, strict=True):
        out += range(base + start + 1, base + end + 1)
    return out


def node_pairs(words: DataFrame) -> DataFrame:
    """(p, s, id, n, kind): the pairs of nodes of each word of ``words`` around a place.

    kind 1 and 2 skip the letter there, 1 if it differs from the one before it, so that one of equal letters stands for
    all; kind 0 is the word itself, in which a letter may be inserted there. Pairs of which no other word has the
    prefix or the suffix are left
    out: the tries say how deep another word goes along.
    """

    def run(ids, ns, keys, fs, fb, fd, rs, rb, rd) -> Iterator[tuple]:
        for word_id, n, word, starts, bases, deep, r_starts, r_bases, r_deep in zip(ids, ns, keys, fs, fb, fd, rs, rb, rd, strict=True):
            size = len(word)
            front, back = nodes(starts, bases, size), nodes(r_starts, r_bases, size)
            for i in range(max(0, size - 1 - r_deep), min(size - 1, deep) + 1):
                yield front[i], back[size - 1 - i], word_id, n, 2 if i and word[i - 1] == word[i] else 1
            for i in range(max(0, size - r_deep), min(size, deep) + 1):
                yield front[i], back[size - i], word_id, n, 0

    columns = ("id", "n", "key", "starts", "bases", "deep", "r_starts", "r_bases", "r_deep")
    return arrow_map(words.select(*columns), run, "p long, s long, id long, n long, kind int")


def partners(pairs: DataFrame) -> DataFrame:
    """(id, n_near, best): how many other words are near, and the one of largest n, of equal ones the first.

    Words with equal pairs are near if both skip a letter, or if one skips the first of equal letters and the other is
    whole. Two words meet so exactly once, so the counts of a word's groups add up, and nothing is paired out. A group has a
    word for each letter at most.
    """
    near = "o -> o.id <> e.id and (least(o.kind, e.kind) > 0 or o.kind + e.kind = 1)"
    grouped = pairs.groupBy("p", "s").agg(F.collect_list(F.struct("id", "n", "kind")).alias("g")).filter(F.size("g") > 1)
    found = grouped.select(F.explode(F.expr(f"transform(g, e -> named_struct('id', e.id, 'near', transform(filter(g, {near}), o -> named_struct('n', o.n, 'order', -o.id))))")).alias("x"))
    found = found.filter(F.size("x.near") > 0).select("x.id", F.size("x.near").cast("long").alias("n_near"), F.array_max("x.near").alias("best"))
    return found.groupBy("id").agg(F.sum("n_near").alias("n_near"), F.max("best").alias("best"))


def last_forms(forms: DataFrame) -> DataFrame:
    """(id, to): where the links of ``forms`` (id, to) lead at last. A form has at least twice the places of its
    word, so no chain
    is longer than 62 links, and each round doubles what a link spans."""
    links = stored(forms.select("id", "to"), "forms")
    while True:
        onward = links.select(F.col("id").alias("to"), F.col("to").alias("beyond"))
        longer = stored(links.join(onward, "to", "left").select("id", F.coalesce("beyond", "to").alias("to"), F.col("beyond").isNotNull().alias("moved")), "forms")
        moved = longer.filter("moved").limit(1).count()
        discard(links)
        links = longer
        if not moved:
            return links.select("id", "to")


def spelling_variants(docs: DataFrame, least_length: int = 5, least_count: int = 3, a_part: int = 50_000) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the whole texts of ``docs`` (doc_id, text).

    Null texts have no words; a null doc_id counts as an empty one where misspellings are drawn. Repeated rows count
    again; runs of any length are
    read whole. Of equally frequent near words the first in code-point order is the form. An empty table gives no
    row. Other columns are not read.
    """
    words = stored(word_counts(docs, least_length, least_count), "words")
    total = words.count()
    forward = stored(trie_paths(words.select(F.col("word").alias("key"), "n", F.lit(0).cast("long").alias("word_id")), total, a_part).drop("word_id"), "forward")
    backward = trie_paths(forward.select(F.reverse("key").alias("key"), "n", F.col("id").alias("word_id")), total, a_part)
    backward = backward.select(F.col("word_id").alias("id"), F.col("starts").alias("r_starts"), F.col("bases").alias("r_bases"), F.col("deep").alias("r_deep"))
    near = stored(partners(node_pairs(forward.join(backward, "id"))), "near")
    out = forward.select("id", F.col("key").alias("word"), "n").join(near, "id", "left")
    has = F.col("best.n") >= 2 * F.col("n")
    out = out.select("id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, -F.col("best.order")).alias("to"), F.when(has, F.col("best.n")).alias("form_n"))
    out = stored(out, "partners")
    name = lambda c: forward.select(F.col("id").alias(f"{c}_id"), F.col("key").alias(c))
    formed = out.filter("to is not null").select("id", F.col("to").alias("form_id"))
    roots = last_forms(formed.withColumnRenamed("form_id", "to")).withColumnRenamed("to", "root_id")
    named = formed.join(roots, "id").join(name("form"), "form_id").join(name("root"), "root_id").select("id", "form", "root")
    return out.join(named, "id", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
