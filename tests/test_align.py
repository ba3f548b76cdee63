import itertools
import random
import time
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from docdelta.functions import matching
from docdelta.operators import align, metrics, report


def compare(spark, olds, news):
    docs = spark.createDataFrame([(2 * i, a) for i, a in enumerate(olds)] + [(2 * i + 1, b) for i, b in enumerate(news)], "doc_id long, text string")
    pairs = spark.createDataFrame([(i, 2 * i, 2 * i + 1) for i in range(len(olds))], "pair_id long, old_doc_id long, new_doc_id long")
    return align.compare_pairs(pairs, align.document_units(docs))


@pytest.mark.parametrize(
    ("old", "new", "types"),
    [
        ("Tighten the bolt to 25 Nm", "Tighten the bolt to 35 Nm", ["modified"]),
        ("Open ( left ) valve", "Open(left)valve", ["equal"]),
        ("WARNING: Hot part", "警告：Hot part", ["equal"]),
        ("Alpha beta gamma", "Quite something else", ["deleted", "added"]),
        ("", "New", ["added"]),
        ("", "", []),
    ],
)
def test_classes(spark, old, new, types):
    assert [r.type for r in compare(spark, [old], [new]).orderBy("seq").collect()] == types


def test_marked_characters(spark):
    row = compare(spark, ["Set value <25> now please"], ["Set value <35> now please"]).first()
    assert '<span class="deleted-word">2</span>' in row.old_html and '<span class="added-word">3</span>' in row.new_html and "&lt;" in row.old_html


def best_pairs(old, new):
    """Greatest total similarity over all order-preserving pairings, by trying them all."""
    top = 0.0
    for k in range(min(len(old), len(new)) + 1):
        for a in itertools.combinations(range(len(old)), k):
            for b in itertools.combinations(range(len(new)), k):
                s = [SequenceMatcher(None, old[i], new[j], autojunk=False).ratio() for i, j in zip(a, b)]
                if all(x >= 0.85 for x in s):
                    top = max(top, sum(s))
    return top


def test_block_pairs_are_best():
    rng = random.Random(1)
    for _ in range(60):
        old = ["".join(rng.choice("ab") for _ in range(8)) for _ in range(rng.randint(0, 4))]
        new = [x[:-1] + rng.choice("ab") if rng.random() < 0.7 else x[::-1] for x in old][: rng.randint(0, 4)]
        got = align._pair_block(old, new)
        pairs = [(i, j) for kind, i, j in got if kind == "pair"]
        assert sum(SequenceMatcher(None, old[i], new[j], autojunk=False).ratio() for i, j in pairs) == pytest.approx(best_pairs(old, new))
        assert sorted(i for _, i, _ in got if i is not None) == list(range(len(old))) and sorted(j for _, _, j in got if j is not None) == list(range(len(new)))


def test_unpaired_block_reads_deletions_first():
    assert [k for k, _, _ in align._pair_block(["aaaa", "bbbb"], ["cccc", "dddd"])] == ["del", "del", "add", "add"]


def test_invariants(spark):
    rng = random.Random(2)
    olds = [". ".join(f"Unit {rng.randint(0, 9)} of part {c}" for c in "ABCDE") for _ in range(20)]
    news = [". ".join(x for x in o.split(". ") if rng.random() < 0.8) for o in olds]
    units = compare(spark, olds, news).cache()
    rows = units.orderBy("pair_id", "seq").collect()
    for p in range(20):
        own = [r for r in rows if r.pair_id == p]
        for side in ("old_no", "new_no"):
            numbers = [r[side] for r in own if r[side] is not None]
            assert numbers == list(range(len(numbers)))
    stats = {r.pair_id: r for r in metrics.diff_stats(units).collect()}
    assert all(s.total == s.unchanged + s.diff_count for s in stats.values())
    titles = units.select("pair_id", F.lit("a<script>").alias("old_name"), F.lit("b & c").alias("new_name"), F.lit("<p>").alias("provenance")).distinct()
    html = report.render_reports(units, titles).collect()
    assert all("<script>" not in r.html and "a&lt;script&gt; / b &amp; c" in r.html and "<p>&lt;p&gt;</p>" in r.html for r in html)
    assert all(r.html.count("data-diff=") == stats[r.pair_id].diff_count for r in html)
    assert report.search_units(units, "u").count() == 0 and report.search_units(units, "uNIT").count() == len(rows)


def test_report_of_a_pair_without_units(spark):
    units = compare(spark, [""], [""])
    titles = spark.createDataFrame([(0, "a", "b", None)], "pair_id long, old_name string, new_name string, provenance string")
    html = report.render_reports(units, titles).first().html
    assert "0 units, 0 differences" in html and "<tr" not in html


def test_absent_side_is_an_empty_cell(spark):
    rows = [r.row for r in report.report_rows(compare(spark, ["Alpha beta gamma"], ["Quite something else"])).orderBy("seq").collect()]
    assert 'class="deleted">Alpha beta gamma</td><td></td><td class="empty">&nbsp;</td>' in rows[0] and rows[1].startswith('<tr data-diff="added"><td></td><td class="empty">&nbsp;')


def test_contained_texts_like_the_matcher():
    rng = random.Random(4)
    for _ in range(500):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(0, 7)))
        b = "".join(rng.choice("ab") for _ in range(rng.randint(0, 4))) + a + "".join(rng.choice("ab") for _ in range(rng.randint(0, 4)))
        assert matching.ratio(a, b) == pytest.approx(SequenceMatcher(None, a, b, autojunk=False).ratio())


def test_pairs_need_both_sides(spark):
    units = align.document_units(spark.createDataFrame([(1, "One. Two"), (2, None)], "doc_id long, text string"))
    pairs = spark.createDataFrame([(1, 1, 1), (2, 1, 2), (3, 1, 9)], "pair_id long, old_doc_id long, new_doc_id long")
    got = {r.pair_id: (r.unchanged, r.deletions) for r in align.compare_counts(pairs, units).collect()}
    assert got == {1: (2, 0), 2: (0, 2)}


@pytest.mark.parametrize("small", [0, 1 << 16])
def test_runs_like_the_matcher(monkeypatch, small):
    """Ties, repeats and moves, for runs that are grown and for the automaton; 10,000 arrays and as many texts."""
    monkeypatch.setattr(matching, "SMALL", small)
    rng = random.Random(6)
    for _ in range(5000):
        k = rng.choice([1, 2, 3, 30])
        a = [rng.randrange(k) for _ in range(rng.randint(0, 30))]
        b = [rng.randrange(k) for _ in range(rng.randint(0, 30))]
        if rng.random() < 0.3:
            cut = rng.randint(0, len(a))
            b = a[cut:] + a[:cut] + b[:3]
        plain = SequenceMatcher(None, a, b, autojunk=False)
        x, y = matching.as_characters(a, b)
        assert matching.edits(x, y) == plain.get_opcodes()
        assert tuple(matching.longest_run(x, y)) == tuple(plain.find_longest_match(0, len(a), 0, len(b))) or not matching.longest_run(x, y)[2]
        assert matching.ratio(x, y) == pytest.approx(plain.ratio())


def test_pairs_like_the_full_table():
    """The sparse programme against the table of all cells, with the same choice between equal totals."""
    rng = random.Random(8)
    for _ in range(3000):
        n, m, p = rng.randint(0, 7), rng.randint(0, 7), rng.random()
        cells = {(i, j): rng.choice([0.85, 0.9, 1.0, 1.0]) for i in range(n) for j in range(m) if rng.random() < p}
        total, kind = [[0.0] * (m + 1) for _ in range(n + 1)], {}
        for i in range(1, n + 1):
            for j in range(1, m + 1):
                options = [(total[i - 1][j - 1] + cells[i - 1, j - 1], "pair")] if (i - 1, j - 1) in cells else []
                best = max([*options, (total[i - 1][j], "del")], key=lambda x: x[0])
                total[i][j], kind[i, j] = (total[i][j - 1], "add") if total[i][j - 1] >= best[0] else best
        want, i, j = [], n, m
        while i or j:
            step = kind.get((i, j), "del" if i else "add")
            i, j = i - (step != "add"), j - (step != "del")
            want.append((step, i if step != "add" else None, j if step != "del" else None))
        rows = {}
        for (i, j), value in sorted(cells.items()):
            rows.setdefault(i, []).append((j, value))
        assert matching.best_pairs(rows, n, m) == want[::-1]


def test_characters_of_many_items():
    a, b = matching.as_characters(list(range(60_000)), [59_999, 70_000])
    assert len(set(a)) == 60_000 and b[0] == a[-1] and a.encode() and b.encode()


def changed_texts(rng, n):
    """Two sides of a block: changed, moved, repeated and foreign units, none of which is left as it was."""
    words = ["valve", "bolt", "turn", "left", "check", "oil", "pump"]
    old = [" ".join(rng.choice(words) for _ in range(8)) + f" {k}" for k in rng.choices(range(40), k=n)]
    new = [x[:-1] + rng.choice("xyz") if rng.random() < 0.6 else " ".join(rng.choice(words) for _ in range(7)) for x in old]
    cut = rng.randint(0, n)
    return old, (new[cut:] + new[:cut]) if rng.random() < 0.3 else new + new[:5]


def test_blocks_over_tasks(spark):
    rng = random.Random(9)
    sides = [changed_texts(rng, rng.randint(1, 30)) for _ in range(40)] + [changed_texts(rng, 300), (["same text here"] * 20, ["same text herf"] * 30)]
    docs = [(2 * i + k, ". ".join(x.capitalize() for x in side)) for i, pair in enumerate(sides) for k, side in enumerate(pair)]
    units = align.document_units(spark.createDataFrame(docs, "doc_id long, text string"))
    pairs = spark.createDataFrame([(f"p{i}", 2 * i, 2 * i + 1) for i in range(len(sides))], "pair_id string, old_doc_id long, new_doc_id long")
    order = lambda df: sorted(map(str, df.collect()))
    inline, staged = align.compare_pairs(pairs, units, 10**9), align.compare_pairs(pairs, units, 0)
    assert order(inline) == order(staged) and {"modified", "equal", "added", "deleted"} >= {r.type for r in inline.select("type").distinct().collect()}
    assert order(align.compare_counts(pairs, units, 10**9)) == order(align.compare_counts(pairs, units, 0)) == order(align.compare_counts(pairs, units))
    blocks = spark.createDataFrame([("p", 3, 4, *changed_texts(rng, 120))], "pair_id string, old_no int, new_no int, old array<string>, new array<string>")
    assert order(align.solve_blocks(blocks)) == order(align.solve_blocks(blocks, 7))
    assert order(align.block_cells(blocks)) == order(align.block_cells(blocks, 3))


def test_diff_like_a_plain_matcher(spark):
    """Natural texts with repeated and moved units: the whole result from the matcher and the full table of a block."""
    rng = random.Random(10)
    olds = [[rng.choice(["Open", "Close", "Check"]) + f" valve {rng.randint(0, 4)} now" for _ in range(rng.randint(0, 25))] for _ in range(60)]
    news = []
    for old in olds:
        new = [x.replace("now", "later") if rng.random() < 0.15 else x for x in old if rng.random() < 0.9]
        cut = rng.randint(0, len(new))
        news.append(new[cut:] + new[:cut] if rng.random() < 0.4 else new)
    rows = compare(spark, [". ".join(x) for x in olds], [". ".join(x) for x in news]).collect()
    for p, (old, new) in enumerate(zip(olds, news)):
        old, new = ([x + "." for x in side[:-1]] + side[-1:] for side in (old, new))
        a, b = ([x.replace(" ", "") for x in side] for side in (old, new))
        want = []
        for tag, i1, i2, j1, j2 in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
            if tag == "equal":
                want += [("equal", i, j) for i, j in zip(range(i1, i2), range(j1, j2))]
            elif tag != "replace":
                want += [("deleted", i, None) for i in range(i1, i2)] + [("added", None, j) for j in range(j1, j2)]
            else:
                got = align._pair_block(a[i1:i2], b[j1:j2])
                alike = sum(SequenceMatcher(None, a[i1 + i], b[j1 + j], autojunk=False).ratio() for kind, i, j in got if kind == "pair")
                if (i2 - i1) * (j2 - j1) <= 16:
                    assert alike == pytest.approx(best_pairs(a[i1:i2], b[j1:j2]))
                want += [({"pair": "modified", "del": "deleted", "add": "added"}[kind], None if i is None else i1 + i, None if j is None else j1 + j) for kind, i, j in got]
        assert [(r.type, r.old_no, r.new_no) for r in sorted((r for r in rows if r.pair_id == p), key=lambda r: r.seq)] == want


def test_repeated_documents_lose_no_pair(spark):
    docs = spark.createDataFrame([(1, "One. Two"), (1, "One. Two"), (2, "One"), (2, "Zero. One"), (3, "Other")], "doc_id long, text string")
    units = align.document_units(docs)
    pairs = spark.createDataFrame([(10, 1, 1), (11, 1, 2), (12, 2, 3), (13, 3, 7), (14, 3, None)], "pair_id long, old_doc_id long, new_doc_id long")
    counts = {r.pair_id: (r.unchanged, r.diff_count) for r in align.compare_counts(pairs, units).collect()}
    assert counts == {10: (2, 0), 11: (0, 2), 12: (0, 2)}
    errors = {(r.pair_id, r.side, r.problem) for r in align.pair_errors(pairs, units).collect()}
    assert errors == {(10, "old", "repeated"), (10, "new", "repeated"), (11, "old", "repeated"), (11, "new", "repeated"), (12, "old", "repeated"), (13, "new", "missing"), (14, "new", "missing")}


def test_hot_documents_are_dealt_out(spark):
    docs = spark.createDataFrame([(i, f"Unit one. Number {i}") for i in range(300)], "doc_id long, text string")
    units = align.document_units(docs)
    pairs = spark.createDataFrame([(i, 0, i) for i in range(300)] + [(300 + i, i, 0) for i in range(300)], "pair_id long, old_doc_id long, new_doc_id long")
    got = align.compare_counts(pairs, units)
    assert sorted(map(str, got.collect())) == sorted(map(str, align.compare_counts(pairs, units).collect()))
    plain, dealt = (align.paired(pairs, units, ("norms",), hot=h) for h in (1000, 20))
    assert sorted(map(str, plain.collect())) == sorted(map(str, dealt.collect())) and dealt.count() == 600


def test_possible_pairs_like_counted_bags():
    rng = random.Random(8)
    text = lambda: "".join(rng.choice("abc中") for _ in range(rng.randint(0, 9)))
    for n in (0, 1, 7, 40):
        old, new = [text() for _ in range(n)], [text() for _ in range(30)]
        least = lambda a, b: 0.85 * (len(a) + len(b))
        want = {(i, j) for i, a in enumerate(old) for j, b in enumerate(new) if min(2 * min(len(a), len(b)), 2 * sum((Counter(a) & Counter(b)).values())) >= least(a, b)}
        for cells in (1, 50, 1 << 21):
            got = list(matching.possible_pairs(old, new, 0.85, cells))
            assert set(got) == want and len(got) == len(want)


def test_a_block_of_many_units_is_paired_in_a_second():
    old = [f"Entry {k * 7919 % 99991:05d} of the list of parts, which is checked before use, rev 1." for k in range(250)]
    new = [x.replace("rev 1", "rev 2") for x in old]
    began = time.process_time()
    got = align._pair_block(old, new)
    assert time.process_time() - began < 8 and len(got) >= 250
    long = "x" * 30 + "".join(chr(97 + k * k % 23) for k in range(30_000))
    began = time.process_time()
    for _ in range(40):
        assert matching.grown_run(long, long + "!") == (0, 0, len(long))
    assert time.process_time() - began < 5


def test_ratios_from_a_threshold():
    rng = random.Random(9)
    for _ in range(3000):
        a = "".join(rng.choice("abc中 ") for _ in range(rng.randint(0, 30)))
        b = "".join(c for c in a if rng.random() < 0.9) + rng.choice(["", "b", "xyz"])
        value = matching.ratio(a, b)
        for least in (0.5, 0.85, value):
            assert matching.ratio_from(a, b, least) == (value if value >= least else None)
