"""Text functions, Column -> Column: units, noise, normal form, HTML."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, digits and letters count in the Unicode sense throughout.
U = "(?U)"
S = r"[\s\x1c-\x1f]"
H = r"[一-鿿]"
#: The same white space as two patterns that are searched fast: single characters below U+0100, and, behind a range test, those above.
LOW = r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0"
HIGH = r"[ -　](?<=[  -     　])"
#: White space that is not a single blank: what squeezing has to change once there is none from above U+0100.
UNEVEN = rf"[ {LOW}]{{2,}}|[{LOW}]"
#: Marks a cut; squeezed texts have no line breaks, so none of their characters is one.
CUT = "\n"

# Where a text is cut into units (after the match), and markers that extraction is unsure of.
# In a squeezed text the only white space is a single blank, so a cut behind one is found at the blank.
UNIT_END = rf" (?:(?<=(?:WARNING|CAUTION|NOTE): )(?=[A-Z])|(?<=\)\p{{Nd}}\) |\)[a-z]\) ))|[.;!?] *(?=[A-Z(]|\p{{Nd}}|{H})|[。；！？] *(?=[A-Z(]|\p{{Nd}}|{H})"
MARKERS = [r"警告[:：]", r"警戒[:：]", r"注意[:：]", r"注[:：]", r"WARNING:", r"CAUTION:", r"NOTE:"]

# The normal form of a squeezed unit, step by step; ``$1$2`` keeps captures, so each step is one pass. Where
# what stands before the blanks cannot be what a match begins with, a match begins at the blank, which is found faster.
LATEX = [("\\sim", "~"), ("\\cdot", "·"), ("\\circ", "°")]
LATEX_STEPS = [
    (r"\\math[\p{L}\p{N}_]+", ""),
    (r"(?<![\p{L}\p{N}_])circ(?![\p{L}\p{N}_])", "°"),
    (r"[{}]", ""),
    (r"\^? *° *C(?![a-z])", "℃"),
    (r"\^? *° *F(?![a-z])", "℉"),
]
IDEOGRAPH_STEPS = [
    (rf"({H})- *", "$1"),
    (rf"({H}) +({H})", "$1$2"),
    (r"([，。；：！？、）】]) +", "$1"),
    (r" +([，。；：！？、【（])", "$1"),
    (rf"({H}) +([A-Za-z0-9()\[\]])", "$1$2"),
    (rf"([A-Za-z0-9()\[\]]) +({H})", "$1$2"),
]
BRACKET_STEPS = [
    (r" (?<=[,.'] ) *(?=[A-Za-z0-9])", ""),
    (r"([A-Za-z0-9]) +([()\[\]])", "$1$2"),
    (r"([()\[\]]) +([A-Za-z0-9])", "$1$2"),
]
DEGREE_STEPS = [(r"(\p{Nd}) +(℃)", "$1$2"), (r"([’ʼ]) +([A-Za-z0-9])", "$1$2")]
EMPTY_STEPS = [(r"\( +\)", "()"), (r"\[ +\]", "[]")]
WIDE, NARROW = "～，；：！？、（）【】。", "~,;:!?,()[]."
TILDE_STEPS = [
    (r"~( *~)+", "~"),
    (r" +~ *(?=[A-Za-z℃℉°])", " "),
    (r" *~ *(?=[)\]])", ""),
    (r" +~ *$", ""),
    (r" *~ *", "~"),
]
REFERENCES = ["Table", "Step", "Figure", "Fig", "Task", "Section", "Para", "Chapter"]
LAST_STEPS = [
    (r" (?<=[A-Za-z0-9] ) *(?=[A-Za-z0-9])", ""),
    (r"- +", "-"),
    (r"(\p{Nd}) *- *(\p{Nd})", "$1-$2"),
    (rf"({'|'.join(REFERENCES)})\1+", "$1"),
    (r"Referto(?:Figure|Fig|Table|Step|Task)?(?=Referto)", ""),
]


def _steps(x: Column, steps: list[tuple[str, str]]) -> Column:
    return reduce(lambda y, s: F.regexp_replace(y, s[0], s[1]), steps, x)


def squeeze(x: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(_blanks(x))


def _blanks(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, HIGH, " "), UNEVEN, " ")


def strip_space(x: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(x, U + rf"^{S}+|{S}+\z", "")


def split_units(text: Column) -> Column:
    """Sentence and step units of a text, in order; each keeps its delimiter. Null gives null."""
    parts = F.split(F.regexp_replace(squeeze(text), UNIT_END, "$0" + CUT), CUT)
    return F.filter(F.transform(parts, lambda u: F.trim(u)), lambda u: u != "")


def strip_noise(unit: Column) -> Column:
    """Without warning, caution and note markers, wherever they stand."""
    return squeeze(_without_markers(squeeze(unit)))


def _without_markers(x: Column) -> Column:
    return reduce(lambda y, m: F.regexp_replace(y, "(?iuU)" + m + S + "*", ""), MARKERS, x)


def clean_units(units: Column) -> Column:
    """The units of ``split_units`` without noise; those that were nothing else go. Every marker ends in a colon."""
    marked = lambda u: _holds(u, ":", "：")
    return F.filter(F.transform(units, lambda u: F.when(marked(u), squeeze(_without_markers(u))).otherwise(u)), lambda u: u != "")


def _holds(x: Column, *any_of: str) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(x, F.lit(part)) for part in any_of))


def _wide(x: Column) -> Column:
    """Whether ``x`` may hold ideographs or full-width marks: all of them lie in one range, which is searched fast."""
    return (F.octet_length(x) > F.length(x)) & x.rlike("[\u3000-\uffef]")


def normal_forms(units: Column) -> Column:
    """The normal form of every unit of an array, whose white space is single blanks.

    The steps go over the array one after another, each group of them only over units that hold what it looks for: a search
    for a literal costs a small part of a regular expression. Not idempotent: most steps are a single pass.
    """
    literal = lambda y: reduce(lambda z, r: F.replace(z, F.lit(r[0]), F.lit(r[1])), LATEX, y)
    groups = [
        (lambda u: _holds(u, "\\"), lambda u: _steps(literal(u), LATEX_STEPS[:1])),
        (lambda u: _holds(u, "circ"), lambda u: _steps(u, LATEX_STEPS[1:2])),
        (lambda u: _holds(u, "{", "}"), lambda u: F.translate(u, "{}", "")),
        (lambda u: _holds(u, "°"), lambda u: _steps(u, LATEX_STEPS[3:])),
        (_wide, lambda u: _steps(u, IDEOGRAPH_STEPS)),
        (lambda u: _holds(u, ", ", ". ", "' "), lambda u: _steps(u, BRACKET_STEPS[:1])),
        (lambda u: _holds(u, " (", " )", " [", " ]"), lambda u: _steps(u, BRACKET_STEPS[1:2])),
        (lambda u: _holds(u, "( ", ") ", "[ ", "] "), lambda u: _steps(u, [*BRACKET_STEPS[2:], *EMPTY_STEPS])),
        (lambda u: _holds(u, "℃", "’", "ʼ"), lambda u: _steps(u, DEGREE_STEPS)),
        (_wide, lambda u: F.translate(u, WIDE, NARROW)),
        (lambda u: _holds(u, "~"), lambda u: _steps(u, TILDE_STEPS)),
        (lambda u: _holds(u, " "), lambda u: _steps(u, LAST_STEPS[:1])),
        (lambda u: _holds(u, "-"), lambda u: _steps(u, LAST_STEPS[1:3])),
        (lambda u: _holds(u, *(w + w for w in REFERENCES)), lambda u: _steps(u, LAST_STEPS[3:4])),
        (lambda u: _holds(u, "Referto"), lambda u: _steps(u, LAST_STEPS[4:])),
        (lambda u: _holds(u, "  "), lambda u: F.regexp_replace(u, "  +", " ")),
    ]
    where = lambda guard, change: lambda u: F.when(guard(u), change(u)).otherwise(u)
    return F.transform(reduce(lambda us, g: F.transform(us, where(*g)), groups, units), lambda u: F.trim(u))


def normal_form(x: Column) -> Column:
    """``normal_forms`` of one text."""
    return F.get(normal_forms(F.array(x)), 0)


def normalize(unit: Column) -> Column:
    """The form in which extraction artefacts vanish."""
    return normal_form(_blanks(unit))


def html_escape(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def strip_tags(html: Column) -> Column:
    """Tags become blanks, white space is squeezed; entities stay."""
    return squeeze(F.regexp_replace(html, "<[^>]+>", " "))


def html_table_rows(html: Column) -> Column:
    """Texts of the non-empty rows of a table."""
    return F.filter(F.transform(F.regexp_extract_all(html, F.lit(r"(?s)<tr[^>]*>(.*?)</tr>"), 1), strip_tags), lambda r: r != "")


def same_ignoring_spaces(a: Column, b: Column) -> Column:
    return F.replace(a, F.lit(" "), F.lit("")) == F.replace(b, F.lit(" "), F.lit(""))


def tokens(text: Column) -> Column:
    """One ideograph, a run of ASCII letters, or a run of digits each; in lower case."""
    return F.transform(F.regexp_extract_all(text, F.lit(U + r"[一-鿿]|[A-Za-z]+|\d+"), 0), lambda t: F.lower(t))


def known(x: Column) -> Column:
    """``x``, or unknown where it is missing or empty."""
    return F.coalesce(F.nullif(x, F.lit("")), F.lit("unknown"))


def source_label(backend: Column, version: Column) -> Column:
    """Which engine and version an extraction comes from; what is missing or empty is unknown."""
    other = F.concat(F.lit("MinerU "), known(version), F.lit(" ("), known(backend), F.lit(")"))
    return F.when(backend == "pdfjs", F.concat(F.lit("pdf.js "), known(version))).otherwise(other)


def pair_provenance(old: Column, new: Column) -> Column:
    """One label if both sides of a pair have the same one, else both."""
    return F.when(old.eqNullSafe(new), old).otherwise(F.concat(F.lit("old "), F.coalesce(old, F.lit("?")), F.lit(" / new "), F.coalesce(new, F.lit("?"))))
