import random
import re

import pytest
from pyspark.sql import functions as F

from docdelta.functions import text as T
from docdelta.operators.align import document_units


def one(spark, f, x):
    return spark.createDataFrame([(x,)], "x string").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("text", "units"),
    [
        ("Open valve. Close it now!Done", ["Open valve.", "Close it now!", "Done"]),
        ("10.5 end", ["10.", "5 end"]),
        ("(1)a) Turn left", ["(1)a)", "Turn left"]),
        ("(1) Turn left", ["(1) Turn left"]),
        ("WARNING: Hot\nsurface", ["WARNING:", "Hot surface"]),
        ("关闭阀门。检查", ["关闭阀门。", "检查"]),
        ("one\u0001two\u0002 three", ["one\u0001two\u0002 three"]),
        ("", []),
        (None, None),
    ],
)
def test_split_units(spark, text, units):
    assert one(spark, T.split_units, text) == units


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("torque ( 5 ) Nm", "torque(5)Nm"), ("80 \\sim 90^\\circ C", "80~90℃"), ("$^{\\circ}C", "$℃"), ("阀 门", "阀门"), ("阀-\n门", "阀门"), ("80～90", "80~90"), ("A，B：C", "A,B:C"),
        ("a b c d", "abcd"), ("1 - 2", "1-2"), ("Table Table 1", "Table1"), ("Refer to Figure Refer to Fig.", "RefertoFig."), ("x ~ y", "xy"), ("( )", "()"), ("5 ℃", "5℃"), ("it’ s", "it’s"), ("\\mathrm{x}", "x"),
    ],
)
def test_normal_forms(spark, a, b):
    assert one(spark, T.normalize, a) == b


def test_noise(spark):
    assert one(spark, T.strip_noise, "警告： Hot  WARNING: note: x") == "Hot x"


def plain_normal(x):
    """The same steps with Python's own engine, from the specification."""
    s = re.sub
    for a, b in (("\\sim", "~"), ("\\cdot", "·"), ("\\circ", "°")):
        x = x.replace(a, b)
    for a, b in T.LATEX_STEPS[:1]:
        x = s(r"\\math\w+", "", x)
    x = s(r"\bcirc\b", "°", x)
    py = [*T.LATEX_STEPS[2:], *T.IDEOGRAPH_STEPS, *T.BRACKET_STEPS, *T.DEGREE_STEPS, *T.EMPTY_STEPS]
    turn = lambda b: b.replace("$1", r"\1").replace("$2", r"\2")
    python = lambda a: a.replace(" ", r"\s").replace(r"\p{Nd}", r"\d")
    for a, b in py:
        x = s(python(a), turn(b), x)
    x = x.translate(str.maketrans(T.WIDE, T.NARROW))
    for a, b in [*T.TILDE_STEPS, *T.LAST_STEPS]:
        x = s(python(a), turn(b), x)
    return s(r"\s+", " ", x).strip()


def test_random_texts_like_python(spark):
    rng = random.Random(3)
    alphabet = ["a", "B", "7", " ", "  ", "~", "～", "-", "(", ")", "，", "。", "阀", "门", "°", "C", "℃", "{", "}", "\\sim", "\\circ", "circ", ".", ",", "'", "’", "^", "Table", "Referto", "[", "]", "\u00a0", "\t", "F"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string").select("i", T.normalize(F.col("x")).alias("y")).collect()
    wrong = [(texts[r.i], r.y, plain_normal(texts[r.i])) for r in got if r.y != plain_normal(texts[r.i])]
    assert not wrong, wrong[:5]


def test_html(spark):
    assert one(spark, T.html_table_rows, "<table><tr><td> a</td><td>b</td></tr><tr></tr><TR>no</TR></table>") == ["a b"]
    assert one(spark, T.html_escape, "<a & \"b'") == "&lt;a &amp; &quot;b&#x27;"


def test_empty_document_has_no_units(spark):
    rows = document_units(spark.createDataFrame([(1, None), (2, "NOTE:")], "doc_id long, text string")).collect()
    assert [list(r.units) for r in rows] == [[], []]


def test_provenance(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), (None, None)], "o string, n string").select(T.pair_provenance(F.col("o"), F.col("n")).alias("p")).collect()
    assert [r.p for r in rows] == ["a", "old a / new b", None]


def test_forms_of_squeezed_units(spark):
    rng = random.Random(8)
    parts = ["a", "B", "7", " ", "\t", "~", " ~ ", "note: ", "WARNING: ", "警告：", ".", ". A", ")1) ", "阀", "- ", "(", " )", "\\circ", "circ", "Table", "Table", "\u0085", "\u2028", "；5"]
    texts = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for i in range(2000)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    one_by_one = F.filter(F.transform(T.split_units(F.col("text")), T.strip_noise), lambda u: u != "")
    want = {r.doc_id: (r.u, r.n) for r in df.select("doc_id", one_by_one.alias("u")).withColumn("n", F.transform("u", T.normalize)).collect()}
    got = {r.doc_id: (r.units, r.norms) for r in document_units(df).collect()}
    assert got == want
