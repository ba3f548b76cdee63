"""A notice that a text repeats gives a span for each place."""

import random

from docdelta.llm import license_scan


def test_repeated_notices(spark):
    rng = random.Random(3)
    mit = license_scan.NOTICES[1][1].split()
    words, want = [], []
    for _ in range(50):
        words += [f"w{rng.randint(0, 99)}" for _ in range(rng.choice([0, 1, 5, 40]))]
        want.append(f"mit:{len(words)}-{len(words) + len(mit) - 1}")
        words += mit
    cut = [*mit[:12], "other", "words", *mit[12:]]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*cut, *mit[:10], *cut]))], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.license_scan(docs).collect()}
    assert got[1].spans.split(";") == want and got[1].score == 1
    first, n = len(cut) + 10, len(cut)
    assert got[2].spans == f"mit:0-{n - 1};mit:{first}-{first + n - 1}"


def label_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.labels for r in sorted(license_scan.license_scan(docs).collect(), key=lambda r: r.doc_id)]


def test_licences_that_differ_in_a_word_or_a_clause(spark):
    gnu = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
    rest = " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {}General Public License for more details."
    bsd = dict((n[0], n[1]) for n in license_scan.NOTICES if n[0] in ("bsd-2", "bsd-3") and len(n[1]) > 200)
    texts = [(gnu + rest).replace("{}", kind, 1).replace("{}", v, 1).replace("{}", kind) for kind, v in (("", "2"), ("", "3"), ("Lesser ", "2.1"), ("Lesser ", "3"), ("Affero ", "3"), ("", "1"))]
    texts += [bsd["bsd-2"], "words before " + bsd["bsd-3"] + " and behind", license_scan.NOTICES[0][1], "licensed under the GNU General Public License, version 2", "SPDX-License-Identifier: BSD-3-Clause", "licensed under the GNU General Public License version 4"]
    assert label_of(spark, texts) == ["gpl-2", "gpl-3", "lgpl-2.1", "lgpl-3", "agpl-3", "", "bsd-2", "bsd-3", "mit", "gpl-2", "bsd-3", ""]


def test_chains_like_all_subsets():
    rng = random.Random(11)
    for _ in range(300):
        matches = sorted({(rng.randint(0, 20), rng.randint(0, 12), rng.randint(1, 4)) for _ in range(rng.randint(0, 7))})
        best = {}
        for mask in range(1, 1 << len(matches)):
            chain = [m for k, m in enumerate(matches) if mask >> k & 1]
            if all(t + n <= u <= t + n + 3 and p + n <= q for (t, p, n), (u, q, _) in zip(chain, chain[1:], strict=False)):
                best[chain[-1]] = max(best.get(chain[-1], 0), sum(n for _, _, n in chain))
        assert [x[0] for x in license_scan.chain_ends(matches, 3)] == [best[m] for m in matches]
        assert license_scan.chained(matches, 3, 1)[0] == max(best.values(), default=0)


def test_short_forms_expressions_and_whole_texts(spark):
    gpl = "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies"
    texts = {
        gpl: "gpl-3", "This work is licensed under the terms of the MIT license.": "mit", "SPDX: Apache-2.0 OR MIT": "apache-2,mit", "LGPL-2.1-only": "lgpl-2.1",
        "SPDX-License-Identifier: (GPL-2.0-or-later AND BSD-3-Clause) OR ISC": "bsd-3,gpl-2,isc", "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "cc-by-sa",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc.": "lgpl-2.1",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc.": "agpl-3", "SPDX: nothing known": "", "spdx": "",
    }
    rows = license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {list(texts)[r.doc_id]: r for r in rows}
    assert {t: r.labels for t, r in got.items()} == texts
    assert all((r.score >= 0.7) == bool(r.labels) for r in rows)
