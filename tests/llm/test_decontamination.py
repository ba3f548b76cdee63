"""Exact copies are found however many or short the benchmark's items are."""

import random

import numpy as np
import pytest

from docdelta.llm import decontamination


@pytest.mark.parametrize("options", [{}, {"rank": 8}, {"block": 60}])
def test_all_exact_copies(spark, options):
    """Items of 1 to 70 words in long texts; a rank far below the passages; several blocks."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([1, 2, 3, 5, 8, 10, 20, 40, 70] * 10)]
    rows = []
    for k, text in items:
        body = [word() for _ in range(150)]
        at = rng.randint(0, 150)
        rows.append((k, " ".join([*body[:at], text, *body[at:]])))
    rows.append((900, " ".join([*(word() for _ in range(60)), *items[8][1].split()[10:50], *(word() for _ in range(60))])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    hits = decontamination.benchmark_hits(docs, spark.createDataFrame(items, "item_id long, text string"), **options)
    found = hits.collect()
    got = {(r.doc_id, r.item_id): r for r in found}
    assert len(found) == len(got)
    assert set(got) == {(k, k) for k, _ in items} | {(900, 8)}
    assert all(r.lcs == 1 and 0 <= r.cosine <= 1 for r in got.values())


@pytest.mark.parametrize("size", [40, 160])
def test_rewordings_are_found_in_the_latent_space(spark, size):
    """Every third word is another one, so no three words in a row are left: 9 of 10 are found, by the latent search only."""
    rng = random.Random(size)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    common = [word() for _ in range(400)]
    text = lambda n: [rng.choice(common) if rng.random() < 0.3 else word() for _ in range(n)]
    items = [(k, text(rng.randint(24, 60))) for k in range(size)]
    rows = [(k, " ".join([*text(rng.randint(0, 200)), *(word() if n % 3 == 2 else w for n, w in enumerate(own)), *text(rng.randint(0, 200))])) for k, own in items]
    rows += [(10_000 + k, " ".join(text(300))) for k in range(size)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame([(k, " ".join(own)) for k, own in items], "item_id long, text string")
    hits = decontamination.benchmark_hits(docs, benchmark).collect()
    right = [r for r in hits if r.doc_id == r.item_id]
    assert len(right) >= 0.9 * size and len(hits) == len(right)
    assert all(r.by_latent for r in right) and sum(not r.by_runs for r in right) >= 0.9 * size
    assert all(r.lcs >= 0.6 or r.answer_found for r in right)
    without = decontamination.benchmark_hits(docs, benchmark, cosine=5).collect()
    assert len(without) < 0.1 * size and all(r.by_runs and not r.by_latent for r in without)


def test_driver_gets_one_sum_a_round(spark, monkeypatch):
    """Each round brings one matrix of terms x rank to the driver, in pieces, and the vectors are those of a plain SVD."""
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(700)]
    rows = [([words[i] for i in rng.choice(len(words), 30)],) for _ in range(60)]
    vocabulary = {w.encode(): k for k, w in enumerate(words)}
    idf = rng.random(len(words)) + 0.5
    passages = spark.createDataFrame(rows, "words array<string>")
    sent, collect, arrow = [], type(passages).collect, type(passages).toArrow

    def counted(df):
        out = arrow(df)
        sent.append([len(x) for x in out["total"].to_pylist()])
        return out

    def pickled(df):
        sent.append(["pickled rows take ten times their size in the driver"])
        return collect(df)

    monkeypatch.setattr(type(passages), "toArrow", counted)
    monkeypatch.setattr(type(passages), "collect", pickled)
    vectors = decontamination.randomised_svd(passages, vocabulary, idf, 60)
    assert len(sent) == 3 and all(isinstance(x[0], int) and sum(x) == len(words) * 68 * 8 and max(x) <= 2**20 for x in sent)
    table = np.zeros((len(rows), len(words)))
    for k, (r,) in enumerate(rows):
        np.add.at(table[k], [vocabulary[w.encode()] for w in r], idf[[vocabulary[w.encode()] for w in r]])
    assert np.allclose(np.linalg.norm(table @ vectors, axis=1), np.linalg.norm(table, axis=1))
