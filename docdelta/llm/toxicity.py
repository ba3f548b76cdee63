"""Toxicity: Kneser-Ney models of toxic and of ordinary text, compared by their log-likelihoods a word.

Each class has an interpolated Kneser-Ney model of words given the word before: places of pairs at the upper order, numbers
of different words before a word at the lower one, discounts from the counts of counts, and below both the model of all
texts. A model keeps own estimates where its class differs from what the lower order predicts by more than chance allows;
other pairs are left to the words, by the first word's backoff weight, and other words to the model of all texts, whose
ratio is one constant. Chance is judged by counts that copies and repetitions do not raise.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, discard, row_numbers, stored, utf8

WORD = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LONG = 64  # bytes; a longer word stands as its hash
FILTER_BITS = 1 << 25


def words_of(text: bytes) -> list[bytes]:
    """Runs of letters, A-Z lower-cased."""
    return [w if len(w) <= LONG else b"%016x" % xxhash.xxh64_intdigest(w) for w in WORD.findall(text.lower())]


def first_contexts(words: list[bytes], order: int) -> Iterator[tuple[bytes, int]]:
    """Each distinct word (order 1) or pair of words (order 2) of a text, with what stands around its first place."""
    padded = [b"", *words, b""]
    grams = padded[1:-1] if order == 1 else list(map(b" ".join, zip(padded, words, strict=False)))
    seen: dict[bytes, int] = {}
    for k, gram in enumerate(grams):
        seen.setdefault(gram, k)
    for gram, k in seen.items():
        yield gram, crc32(padded[k - order + 1 if k >= order - 1 else 0] + b" " + padded[k + 2])


def fold(doc_id: Column) -> Column:
    """0: held out, 1: fits the scale, 2 to 4: counted; null ids, which have no label, count as held in."""
    return F.crc32(doc_id.cast("string")) % 5


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from."""
    return F.coalesce(fold(doc_id) == 0, F.lit(False))


def learnt_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, label) of every labelled row that is not held out. Labels other than 0 and 1 and null ids are left out;
    several labels of a document count as their mean, ties as 1."""
    known = labels.select("doc_id", "toxic").filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    return known.groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("label"))


def bit_filter(grams: DataFrame) -> bytes:
    """A set of bits of fixed size that holds the hash of every gram."""
    bit = F.pmod(F.xxhash64("gram"), F.lit(FILTER_BITS))
    packed = grams.select(bit.alias("bit")).groupBy((F.col("bit") / 32).cast("long").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, int(bit % 32))")).alias("bits"))
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    for row in packed.collect():
        out[row.at] = row.bits
    return out.astype("<u4").tobytes()


def may_hold(bits: bytes, gram: bytes) -> int:
    at = xxhash.xxh64_intdigest(gram, 42) % FILTER_BITS
    return bits[at >> 3] >> (at & 7) & 1


def counted(rows: DataFrame) -> DataFrame:
    """(gram, toxic, ordinary): in how many different contexts each gram stands. No gram is one key: contexts are told
    apart by (gram, context), and then only counts are summed."""
    return (
        rows.groupBy("gram", "label", "context").agg(F.lit(1).alias("one")).groupBy("gram")
        .agg(F.sum(F.col("label").cast("long")).alias("toxic"), F.sum((1 - F.col("label")).cast("long")).alias("ordinary"))
    )


def surprise(toxic: Column, ordinary: Column, share: Column) -> Column:
    """Twice the log-likelihood ratio (G) of the counts against an expected toxic share."""
    n = toxic + ordinary
    part = lambda k, p: F.when(k > 0, k * F.log(k / (n * p))).otherwise(0.0)
    return 2 * (part(toxic, share) + part(ordinary, 1 - share))


def discount(once: int, twice: int) -> float:
    """Kneser and Ney's discount from the numbers of grams that were counted once and twice; 0.75 if there are none."""
    return once / (once + 2 * twice) if once and twice else 0.75


TEXTS = ("docs_t", "docs_o")  # texts that hold it: toxic, ordinary
BEFORE = ("before_t", "before_o", "before")  # different words before it: in toxic, in ordinary, in all texts
PLACES = ("places_t", "places_o")  # places of a pair, or of all pairs that begin with a word
AFTER = ("after_t", "after_o")  # different words after it


def gram_counts(examples: DataFrame) -> DataFrame:
    """(kind, gram, counts) of ``examples`` (label, text): each word, each pair of words that stands twice, and one row
    "once" and "twice" with the numbers of pairs that stand so often.

    All pairs of both classes are counted; an empty word stands before the first word of a text and behind the last. The words'
    counts come from the pairs: a pair says in how many texts its second word stands there first.
    """

    def run(labels: list, texts: list) -> Iterator[tuple]:
        for label, text in zip(labels, texts, strict=True):
            words = words_of(text)
            before, after = [b"", *words], [*words, b""]
            first = dict(zip(reversed(after), reversed(before), strict=True))  # what stands before a word's first place
            firsts = {v + b" " + w for w, v in first.items()}
            for gram, places in Counter(map(b" ".join, zip(before, after, strict=True))).items() if words else ():
                yield label, gram, places, int(gram in firsts)

    rows = arrow_map(examples.select("label", utf8()), run, "label int, gram binary, places long, first int")
    of = {"t": F.col("label").cast("long"), "o": 1 - F.col("label").cast("long")}
    counts = rows.groupBy("gram").agg(*(F.sum(of[c] * F.col(k)).alias(f"{k}_{c}") for k in ("places", "first") for c in "to"))
    names = (*TEXTS, *BEFORE, *PLACES, *AFTER)

    def row(kind: str, gram: Column, **values: Column) -> Column:
        zero = F.lit(0).cast("long")
        return F.struct(F.lit(kind).alias("kind"), gram.cast("binary").alias("gram"), *(F.coalesce(values.get(k, zero).cast("long"), zero).alias(k) for k in names))

    text, t, o = F.col("gram").cast("string"), F.col("places_t"), F.col("places_o")
    docs = {"docs_t": F.col("first_t"), "docs_o": F.col("first_o")}
    second = row("word", F.substring_index(text, " ", -1), before_t=t > 0, before_o=o > 0, before=t + o > 0, **docs)
    first = row("word", F.substring_index(text, " ", 1), places_t=t, places_o=o, after_t=t > 0, after_o=o > 0)
    words = counts.select(F.explode(F.array(second, first)).alias("r")).select("r.*").groupBy("kind", "gram").agg(*(F.sum(k).alias(k) for k in names))
    pairs = counts.filter(t + o > 1).select(row("pair", F.col("gram"), places_t=t, places_o=o, **docs).alias("r")).select("r.*")
    # the same columns as above, so that Spark shuffles the pairs once
    sums = counts.agg(*(F.count_if(F.col(f"places_{c}") == k).alias(f"{c}{k}") for c in "to" for k in (1, 2)), *(F.sum(v).alias(k) for k, v in docs.items()))
    times = (row(kind, F.lit(""), places_t=F.col(f"t{k}"), places_o=F.col(f"o{k}"), docs_t=F.col("docs_t"), docs_o=F.col("docs_o")) for kind, k in (("once", 1), ("twice", 2)))
    return stored(words.unionByName(pairs).unionByName(sums.select(F.explode(F.array(*times)).alias("r")).select("r.*")), "counts")


def contexts(examples: DataFrame, grams: DataFrame) -> DataFrame:
    """(gram, toxic, ordinary) of ``grams``: in how many different contexts each stands, one context a text."""
    bits = examples.sparkSession.sparkContext.broadcast(bit_filter(grams))

    def run(labels: list, texts: list) -> Iterator[tuple]:
        known = bits.value
        for label, text in zip(labels, texts, strict=True):
            words = words_of(text)
            for order in (1, 2):
                for gram, context in first_contexts(words, order):
                    if may_hold(known, gram):
                        yield label, gram, context

    rows = arrow_map(examples.select("label", utf8()), run, "label int, gram binary, context long")
    return counted(rows).join(grams.select("gram"), "gram", "left_semi")


def language_models(examples: DataFrame) -> DataFrame:
    """(gram, n, value) from ``examples`` (label, text): what each place of a gram adds to the log ratio of a text.

    A text's first word is estimated alone, each later one and the end of the text given the word before. A word's value,
    of its estimate and its backoff weight, counts at all its places, and that of a pair where its words follow each other. The
    sum is the log of the toxic against the ordinary Kneser-Ney likelihood, less a constant for the end and each word, the
    log ratio of what the two classes leave to words without own estimates, of which the end is one.

    Words have own estimates if G is over twice the log of the number of different words, the level that chance reaches about
    once, both of the texts that hold them (or the surroundings that they can have had, if fewer) and of their contexts;
    pairs likewise, by their contexts, against the share that their words predict, if they stand twice at least. Contexts
    are counted of the pairs that could reach that level if all their places were different contexts.
    """
    table = gram_counts(examples)
    words = table.filter("kind = 'word'")
    held = words.filter("before > 0")
    t, o = (F.least(f"docs_{c}", F.col(f"before_{c}") * F.col(f"after_{c}")) for c in "to")
    sums = held.agg(
        F.count("*").alias("types"), F.sum(t).alias("t"), F.sum(o).alias("o"), *(F.sum(c).alias(c) for c in BEFORE),
        *(F.count_if(F.col(c) > 0).alias(f"{c}_types") for c in BEFORE), *(F.count_if(F.col(c) == k).alias(f"{c}_{k}") for c in BEFORE for k in (1, 2)),
    ).first()
    if not sums.t or not sums.o:
        return held.select("gram", F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("value")).limit(0)
    often = {r.kind: r for r in table.filter("kind in ('once', 'twice')").collect()}
    pair_off = {c: discount(often["once"][f"places_{c}"], often["twice"][f"places_{c}"]) for c in "to"}

    def lower(count: str, below: Column) -> Column:
        """Interpolated estimate of a word from the different words before it."""
        off = discount(sums[f"{count}_1"], sums[f"{count}_2"])
        return (F.greatest(F.col(count) - off, F.lit(0.0)) + off * sums[f"{count}_types"] * below) / sums[count]

    shared = sums.t / (sums.t + sums.o)
    held = held.withColumn("p", lower("before", F.lit(1 / (sums.types + 1)))).withColumn("p_t", lower("before_t", F.col("p"))).withColumn("p_o", lower("before_o", F.col("p")))
    beyond = lambda toxic, ordinary: surprise(toxic, ordinary, F.lit(shared)) > 2 * math.log(max(sums.types, 2))
    likely = held.filter((F.length("gram") > 0) & beyond(t, o))
    likely = stored(likely.select("gram", "p", "p_t", "p_o", ((t + 0.75) / (t + o + 0.75 / shared)).alias("share")), "likely_words")

    # pairs whose most one-sided split would differ from their words by more than chance; their contexts decide
    level = math.log(max(sums.before, 2))
    text = F.col("gram").cast("string")
    pairs = table.filter("kind = 'pair'").select("gram", *PLACES, F.substring_index(text, " ", 1).cast("binary").alias("v"), F.substring_index(text, " ", -1).cast("binary").alias("w"))
    pairs = pairs.filter((F.length("v") > 0) & (F.length("w") > 0))
    for side in "vw":
        pairs = pairs.join(likely.select(F.col("gram").alias(side), F.col("share").alias(f"share_{side}")), side, "left").fillna(shared, [f"share_{side}"])
    odds = F.col("share_v") / (1 - F.col("share_v")) * F.col("share_w") / (1 - F.col("share_w")) * ((1 - shared) / shared)
    pairs = pairs.withColumn("share", odds / (1 + odds)).filter(F.greatest(-F.col("places_t") * F.log("share"), -F.col("places_o") * F.log1p(-F.col("share"))) > level)
    pairs = stored(pairs.select("gram", "v", "w", "share", *PLACES), "pairs")
    seen = stored(contexts(examples, pairs.select("gram").unionByName(likely.select("gram"))), "contexts")
    n = (F.col("toxic") + F.col("ordinary")).alias("n")
    own = stored(likely.join(seen, "gram").filter(beyond(F.col("toxic"), F.col("ordinary"))).select("gram", "p", "p_t", "p_o", n), "own_words")
    mass = own.agg(*(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("p", "p_t", "p_o"))).first()
    left = {c: (1 - mass[f"p_{c}"]) / (1 - mass.p) for c in "to"}
    rest = math.log(left["t"] / left["o"])
    pairs = pairs.join(seen, "gram").filter(surprise(F.col("toxic"), F.col("ordinary"), F.col("share")) > 2 * level).select("gram", "v", "w", *PLACES, n)

    # both words' counts, then the estimates of the second word given the first and what is left to the words
    first = words.select(F.col("gram").alias("v"), *(F.col(f"{k}_{c}").alias(f"{k}_v{c}") for k in ("places", "after") for c in "to"))
    second = held.select(F.col("gram").alias("w"), "p").join(own.select(F.col("gram").alias("w"), "p_t", "p_o"), "w", "left")
    second = second.select("w", *(F.coalesce(f"p_{c}", left[c] * F.col("p")).alias(f"p_{c}") for c in "to"))
    pairs = stored(pairs, "own_pairs").join(first, "v").join(second, "w")
    for c in "to":
        off, total = pair_off[c], F.col(f"places_v{c}")
        own_part = (F.greatest(F.col(f"places_{c}") - off, F.lit(0.0)) + off * F.col(f"after_v{c}") * F.col(f"p_{c}")) / total
        pairs = pairs.withColumn(f"q_{c}", F.when(total > 0, own_part).otherwise(F.col(f"p_{c}")))
    pairs = stored(pairs, "estimates")
    weight = lambda c: F.greatest(1 - F.sum(f"q_{c}"), F.lit(1e-12)) / F.greatest(1 - F.sum(f"p_{c}"), F.lit(1e-12))
    weights = pairs.groupBy("v").agg(F.log(weight("t") / weight("o")).alias("backoff"), F.max(F.col("places_vt") + F.col("places_vo")).alias("n"))
    value = F.log(F.col("q_t") / F.col("q_o")) - F.log(F.col("p_t") / F.col("p_o")) - F.col("backoff")
    found = pairs.join(weights.select("v", "backoff"), "v").select("gram", "n", value.alias("value"))
    own = own.select("gram", F.col("n").alias("contexts"), (F.log(F.col("p_t") / F.col("p_o")) - rest).alias("ratio"))
    both = own.join(weights.withColumnRenamed("v", "gram"), "gram", "full")
    both = both.select("gram", F.coalesce("contexts", "n").alias("n"), (F.coalesce("ratio", F.lit(0.0)) + F.coalesce("backoff", F.lit(0.0))).alias("value"))
    models = stored(both.unionByName(found), "models")
    discard(table)
    return models


def log_ratios(docs: DataFrame, models: DataFrame, in_memory: int = 200_000) -> DataFrame:
    """(row, doc_id, x) for every row of ``docs``: the log ratio of the whole text, a word; 0 for a text without words.

    The ``in_memory`` most frequent grams are broadcast; rarer ones, if there are any, are joined by shuffle.
    """
    sc = docs.sparkSession.sparkContext
    top = models.orderBy(F.desc("n"), "gram").limit(in_memory).collect()
    hot = sc.broadcast({bytes(r.gram): r.value for r in top})
    seconds = sc.broadcast({g.rpartition(b" ")[2] for g in hot.value if b" " in g})
    more = models.count() > in_memory
    rest = models.join(models.sparkSession.createDataFrame([(bytes(r.gram),) for r in top], "gram binary"), "gram", "left_anti") if more else None
    rest = stored(rest, "rare_grams") if more else None
    bits = sc.broadcast(bit_filter(rest) if more else b"")

    def run(ids: list, texts: list) -> Iterator[tuple]:
        values, ends, known = hot.value, seconds.value, bits.value
        if run.numbers is None:
            run.numbers = row_numbers()
        for doc_id, text in zip(ids, texts, strict=True):
            words = words_of(text)
            total = math.fsum(values[w] for w in words if w in values)
            if ends:
                total += math.fsum(values.get(v + b" " + w, 0.0) for v, w in zip([b"", *words], words, strict=False) if w in ends)
            rare: Counter = Counter()
            if known:
                rare.update(g for g in words if g not in values and may_hold(known, g))
                rare.update(g for g in map(b" ".join, zip([b"", *words], words, strict=False)) if g not in values and may_hold(known, g))
            yield next(run.numbers), doc_id, len(words), total, list(rare), list(rare.values())

    run.numbers = None
    rows = arrow_map(docs.select("doc_id", utf8()), run, "row long, doc_id long, n_words long, total double, grams array<binary>, times array<long>")
    if more:
        rows = stored(rows, "sums")
        each = rows.select("row", F.explode(F.arrays_zip("grams", "times")).alias("g")).select("row", F.col("g.grams").alias("gram"), F.col("g.times").alias("times"))
        found = each.join(rest.select("gram", "value"), "gram").groupBy("row").agg(F.sum(F.col("times") * F.col("value")).alias("more"))
        rows = rows.join(found, "row", "left").withColumn("total", F.col("total") + F.coalesce("more", F.lit(0.0)))
    return rows.select("row", "doc_id", (F.col("total") / F.greatest("n_words", F.lit(1))).alias("x"))


def scale(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, offset) of the logistic curve of a label over x; fixed ones if a label is missing."""
    if not len(y) or y.min() == y.max() or not x.std():
        return 100.0, -2.0
    z = np.c_[x / x.std(), np.ones(len(x))]
    b = np.zeros(2)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        b += np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + 0.01 * np.eye(2), z.T @ (y - p) - 0.01 * b)
    return float(b[0] / x.std()), float(b[1])


def toxicity_scores(docs: DataFrame, labels: DataFrame, examples_at_most: int = 50_000, broadcast_rows: int = 1_000_000) -> DataFrame:
    """doc_id, held_out, score, predicted, log_ratio for every row of ``docs`` (doc_id, text).

    Three quarters of the labelled rows that are not held out are counted; from the rest, of which ``examples_at_most``
    fit it, comes the curve that turns a log ratio into a probability. A null text is scored as an empty one, which has
    log ratio 0; a long one is read whole. A null doc_id is kept, without a label, and not held out. Repeated rows
    are scored alike; without labels of both kinds the curve is a fixed one. An empty table gives no row. Other columns
    are not read.
    """
    learnt = stored(learnt_labels(labels).withColumn("fold", fold(F.col("doc_id"))), "learnt")
    few = learnt.count() <= broadcast_rows
    wanted = F.broadcast(learnt.filter("fold <> 1")) if few else learnt.filter("fold <> 1")
    examples = docs.select("doc_id", "text").join(wanted, "doc_id").select("label", "text")
    models = language_models(examples if few else stored(examples, "examples"))
    scored = stored(log_ratios(docs, models), "log_ratios")
    fit = scored.join(learnt.filter("fold = 1").select("doc_id", "label"), "doc_id").select("x", "label", F.crc32(F.concat(F.lit("x"), F.col("doc_id"))).alias("at"), "row")
    sample = fit.orderBy("at", "row").limit(examples_at_most).select("x", "label").toPandas()
    slope, offset = scale(sample["x"].to_numpy(float), sample["label"].to_numpy(float))
    score = 1 / (1 + F.exp(-F.greatest(F.least(F.col("x") * slope + offset, F.lit(30.0)), F.lit(-30.0))))
    out = scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), F.col("x").alias("log_ratio"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "log_ratio")
