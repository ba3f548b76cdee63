"""Source divergence, spelling variants and toxicity against plain versions, and their edges."""

import random
import re
from collections import Counter, defaultdict
from itertools import product
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from docdelta.llm import divergence, spelling, toxicity

EDGES = "doc_id long, text string, lang string, source string, term int, n string, key int, row int, part int"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    stems = ["".join(rng.choice("abcé") for _ in range(rng.randint(4, 7))) for _ in range(60)]
    rows = []
    for i in range(220):
        words = [rng.choice(stems[: 10 + 50 * (i % 3)]) for _ in range(rng.randint(0, 60))]
        words = [w[:k] + rng.choice("abcdéÀ") + w[k + 1 :] if rng.random() < 0.2 and (k := rng.randrange(len(w))) >= 0 else w for w in words]
        text = " ".join(w.upper() if rng.random() < 0.1 else w for w in words)
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", "s4", "s5", None])))
    rows += [(None, "abcab abcab", "en", "s1"), (3, rows[3][1], "en", "s2"), (400, None, "fr", "s9"), (401, "", "fr", "s8"), (402, "x" * 30_000 + "," + "x" * 30_000, "fr", "s8")]
    rows += [(403 + k, "y" * 30_000, "fr", "s8") for k in range(3)]
    return rows


@pytest.fixture(scope="module")
def table(spark, texts):
    return spark.createDataFrame([(*r, 1, "x", 2, 3, 4) for r in texts], EDGES).repartition(5)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_divergence(rows, least, top):
    counts, langs, docs = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        found = Counter(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower(text)))
        counts[lang or "", source or ""].update(found)
        docs[lang or ""].update(found.keys())
    out = []
    for lang in {x for x, _ in counts}:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        groups = {s: c for (x, s), c in counts.items() if x == lang}
        for c in groups.values():
            langs[lang].update({t: c[t] for t in kept})
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in groups.items()}, share(langs[lang])
        for s in groups:
            pairs = [(x, sum(abs(p[s][t] - p[x][t]) for t in kept)) for x in groups if x != s]
            above = [(t, p[s][t] - q[t]) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", above, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, *x, k) for k, x in enumerate(items[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize("least,top,block,chunk", [(3, 50, 4096, 64), (3, 4, 8, 2), (10_000, 5, 8, 2)])
def test_divergence(table, texts, least, top, block, chunk):
    got = divergence.source_divergence(table, least, top, block, chunk)
    assert sorted(map(tuple, got.collect())) == plain_divergence(texts, least, top)


def test_divergence_of_nothing(table):
    assert divergence.source_divergence(table.limit(0)).count() == 0


def test_segment_trees():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 4, (6, 64)) * (rng.random((6, 64)) < 0.3)
    counts[5] = counts[0]
    trees = divergence.SegmentTrees(counts)
    assert len(trees.children[0]) < counts.size / 2 and trees.roots[0] == trees.roots[5]
    totals = counts.sum(1).tolist()
    for a, b in product(range(6), repeat=2):
        want = np.abs(divergence.shares(counts[a], totals[a], 60) - divergence.shares(counts[b], totals[b], 60)).sum()
        nothing = abs(int(divergence.shares(np.zeros(1, int), totals[a], 60)[0]) - int(divergence.shares(np.zeros(1, int), totals[b], 60)[0]))
        assert trees.distance(a, b, totals, 60, 0) == want and trees.distance(a, b, totals, 60, 4) == want - 4 * nothing
    huge = np.array([2**62, 3])
    assert divergence.shares(huge, 2**63, 2).tolist() == [1 + 10**9 * (2**62 + 5) // (2**63 + 10), 1 + 10**9 * 8 // (2**63 + 10)]


def plain_variants(rows, least_length=5, least_count=3):
    n = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run
            n[word] += len(word) >= least_length
    n = {w: k for w, k in n.items() if k >= least_count}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)) if len(b) < 1000 or k == 0)

    others = {w: [x for x in n if abs(len(x) - len(w)) < 2 and x != w and near(w, x)] for w in n}
    best = {w: min(o, key=lambda x: (-n[x], x)) for w, o in others.items() if o}
    form = {w: b for w, b in best.items() if n[b] >= 2 * n[w]}
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(others[w]), n[form[w]] if w in form else None))
    return out


@pytest.mark.parametrize("a_part", [50_000, 9, 1])
def test_variants(table, texts, a_part):
    got = spelling.spelling_variants(table, a_part=a_part).collect()
    assert len(got) > 100 and any(r.form for r in got) and any(r.root not in (r.form, r.word) for r in got)
    assert {tuple(r) for r in got} == plain_variants(texts) and len(got) == len(set(got))


def test_variants_of_nothing(table):
    assert spelling.spelling_variants(table.limit(0)).count() == 0


def test_trie_nodes():
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(200)})
    bounds = sorted(rng.sample(words, 5)) + ["bz"]
    rows = [(sum(b <= w for b in bounds), w, ()) for w in words]
    node, shared = {}, Counter(w[:d] for w in words for d in range(len(w) + 1))
    for *_, starts, bases, deep, word, _ in spelling.number_nodes(iter(rows), bounds):
        for d, number in enumerate(spelling.nodes(starts, bases, len(word))):
            assert node.setdefault(word[:d], number) == number
            assert d <= deep or shared[word[:d]] == 1
    assert len(set(node.values())) == len(node)


TOXIC = ["rotten", "vile", "fool", "filth"]


def speech(rng, toxic, length=60):
    return " ".join(rng.choice(TOXIC) if toxic and rng.random() < 0.06 else "w%s" % "abcdefghij"[int(rng.random() ** 2 * 10)] * rng.randint(1, 3) for _ in range(length))


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(2)
    rows = [(i, speech(rng, i % 6 == 0, rng.randint(40, 300)), int(i % 6 == 0)) for i in range(900)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, toxic int").withColumn("label", F.lit(7)).withColumn("x", F.lit("x"))


def test_toxicity(spark, spoken):
    rows, docs = spoken
    labels = docs.select("doc_id", "toxic").unionByName(spark.createDataFrame([(None, 1), (4, None), (5, 9)], "doc_id long, toxic int"))
    edges = [(None, "rotten vile fool"), (2000, None), (2001, ""), (2002, "unknown"), (2002, "unknown"), (2003, "vile " * 20_000), (2004, "q" * 100_000)]
    all_docs = docs.select("doc_id", "text", "label", "x").unionByName(spark.createDataFrame(edges, "doc_id long, text string").withColumn("label", F.lit(1)).withColumn("x", F.lit("y")))
    got = toxicity.toxicity_scores(all_docs, labels).collect()
    assert len(got) == len(rows) + len(edges) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    truth = {i: y for i, _, y in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (r.doc_id is not None and crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert len(held) > 100 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    by = {r.doc_id: r for r in got}
    assert by[None].predicted == 1 and by[2003].predicted == 1 and not any(by[i].predicted for i in (2000, 2001, 2002, 2004))
    # a label that is held out changes nothing
    swapped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.toxicity_scores(all_docs, swapped).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_language_models(spark, spoken):
    rows, docs = spoken
    models = {bytes(r.gram).decode(): r for r in toxicity.language_models(docs.select(F.col("toxic").alias("label"), "text")).collect()}
    seen = {y: defaultdict(set) for y in (0, 1)}
    for _, text, y in rows:
        words = text.split()
        for k, w in enumerate(words):
            if w not in words[:k]:
                seen[y][w].add((words[k - 1] if k else "", words[k + 1] if k + 1 < len(words) else ""))
    assert set(TOXIC) <= set(models) and all(models[w].n == len(seen[1][w]) + len(seen[0][w]) and models[w].value > 1 for w in TOXIC)
    many = [words for words in (t.split() for _, t, _ in rows) if words]
    assert all(any(g in " ".join(["", *w]) for w in many) for g in models)


def test_models_are_kneser_ney(spark):
    """Against a plain version: discounts from counts of counts, backoff weights of first words, pairs of either class."""
    rng, rows = random.Random(11), []
    for i in range(600):
        y, words = int(i % 4 == 0), ["v" + chr(97 + k // 60) + chr(200 + k % 60) for k in (int(rng.random() ** 4 * 1500) for _ in range(rng.randint(20, 40)))]
        for first, last, whole in (("mild", "soul", not y), ("grim", "mind", y)):  # words of both classes, pairs of one
            words[3:3] = [first, last] if whole else [last, words[0], first]
        rows.append((i, y, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, label int, text string")
    models = toxicity.language_models(docs)
    pairs = {tuple(bytes(r.gram).decode().split(" ")) for r in models.collect() if b" " in bytes(r.gram)}
    assert {("mild", "soul"), ("grim", "mind")} <= pairs  # "mild soul" is in no toxic text

    places, docs_of = {0: Counter(), 1: Counter()}, {0: Counter(), 1: Counter()}
    for _, y, x in rows:
        places[y].update(zip(["", *x.split()], [*x.split(), ""], strict=True))
        docs_of[y].update({*x.split(), ""})
    before = {y: Counter(w for _, w in places[y]) for y in (0, 1)} | {2: Counter(w for _, w in {*places[0], *places[1]})}
    after = {y: Counter(v for v, _ in places[y]) for y in (0, 1)}
    begun = {y: Counter() for y in (0, 1)}
    for y in (0, 1):
        for (v, _), c in places[y].items():
            begun[y][v] += c

    def off(counts):
        once, twice = (sum(c == k for c in counts.values()) for k in (1, 2))
        assert once and twice
        return once / (once + 2 * twice)

    lower_off, upper_off = {y: off(before[y]) for y in before}, {y: off(places[y]) for y in places}

    def lower(y, w):
        below = 1 / (len(before[2]) + 1) if y == 2 else lower(2, w)
        return (max(before[y][w] - lower_off[y], 0) + lower_off[y] * len(before[y]) * below) / sum(before[y].values())

    seen = {w: [min(docs_of[y][w], before[y][w] * after[y][w]) for y in (1, 0)] for w in before[2]}
    share = sum(t for t, _ in seen.values()) / sum(map(sum, seen.values()))
    chance = lambda t, o: 2 * sum(k * np.log(k / ((t + o) * p)) for k, p in ((t, share), (o, 1 - share)) if k)
    around = {y: defaultdict(set) for y in (0, 1)}
    for _, y, x in rows:
        words = ["", *x.split(), ""]
        for w in words[1:-1]:
            around[y][w].add((words[words.index(w, 1) - 1], words[words.index(w, 1) + 1]))
    own = {w for w, (t, o) in seen.items() if w and min(chance(t, o), chance(len(around[1][w]), len(around[0][w]))) > 2 * np.log(len(seen))}
    left = {y: (1 - sum(lower(y, w) for w in own)) / (1 - sum(lower(2, w) for w in own)) for y in (0, 1)}
    word = {(y, w): lower(y, w) if w in own else left[y] * lower(2, w) for y in (0, 1) for w in before[2]}

    def upper(y, v, w):
        return (max(places[y][v, w] - upper_off[y], 0) + upper_off[y] * after[y][v] * word[y, w]) / begun[y][v]

    weight = {(y, v): 1.0 for y in (0, 1) for v in before[2]}
    for y, v in weight:
        if ws := [w for x, w in pairs if x == v]:
            weight[y, v] = (1 - sum(upper(y, v, w) for w in ws)) / (1 - sum(word[y, w] for w in ws))

    def estimate(y, v, w):
        return upper(y, v, w) if (v, w) in pairs else weight[y, v] * word[y, w]

    unseen = lower_off[2] * len(before[2]) / sum(before[2].values()) / (len(before[2]) + 1)
    for y, v in product((0, 1), ("mild", "grim", "soul", *list(before[2])[:5])):
        assert abs(sum(estimate(y, v, w) for w in before[2]) + weight[y, v] * left[y] * unseen - 1) < 1e-9
    got = {r.doc_id: r.x for r in toxicity.log_ratios(docs, models).collect()}
    for i, _, x in rows[:200]:
        words = x.split()
        want = np.log(word[1, words[0]] / word[0, words[0]]) + sum(np.log(estimate(1, v, w) / estimate(0, v, w)) for v, w in zip(words, [*words[1:], ""], strict=True))
        assert abs(got[i] * len(words) + (len(words) + 1) * np.log(left[1] / left[0]) - want) < 1e-6


def test_rare_grams_are_joined(spark, spoken):
    _, docs = spoken
    models = toxicity.language_models(docs.select(F.col("toxic").alias("label"), "text"))
    pairs = spark.createDataFrame([(b"wa wa", 2, 0.5), (b" wb", 1, 0.25)], "gram binary, n long, value double")
    models = models.unionByName(pairs)
    values = {r.doc_id: r.x for r in toxicity.log_ratios(docs, models).collect()}
    joined = {r.doc_id: r.x for r in toxicity.log_ratios(docs, models, in_memory=2).collect()}
    plain = {bytes(r.gram).decode(): r.value for r in models.collect()}
    for r in docs.collect():
        words = r.text.split()
        want = sum(plain.get(w, 0) + plain.get(f"{v} {w}", 0) for v, w in zip(["", *words], words, strict=False)) / max(1, len(words))
        assert abs(values[r.doc_id] - want) < 1e-9 and abs(joined[r.doc_id] - want) < 1e-9


def test_no_labels(spark, spoken):
    _, docs = spoken
    got = toxicity.toxicity_scores(docs, spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert len(got) == 900 and not any(r.predicted for r in got)
    assert toxicity.toxicity_scores(docs.limit(0), docs.select("doc_id", "toxic")).count() == 0
