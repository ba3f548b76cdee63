"""Quality rules with cross-document line frequency per host."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, row_numbers, stored

SYMBOLS = b"#*$%&|<>"
#: White space between words, and the bytes that continue a code point.
NOT_COUNTED = b" \t\n\r\x0b\x0c" + bytes(range(0x80, 0xC0))


def repeated_words(words: list[bytes], size: int = 5) -> int:
    """Words that lie in a window of ``size`` words which the text holds twice or more."""
    windows = list(zip(*(words[k:] for k in range(size)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen = Counter(windows)
    count, done = 0, 0
    for i, window in enumerate(windows):
        if seen[window] > 1:
            count += i + size - max(i, done)
            done = i + size
    return count


def line_key(words: list[bytes]) -> int:
    """Hash of a normalised line: A-Z in lower case, words joined by one blank."""
    h = xxhash.xxh64_intdigest(b" ".join(words).lower(), 42)
    return h - (1 << 64) if h >> 63 else h


def measured(docs: DataFrame, host: str) -> DataFrame:
    """Per row: its measures, and its distinct normalised lines with the words that they hold in all."""

    def run(ids: list, hosts: list, texts: list) -> Iterator[tuple]:
        number = row_numbers()
        for doc_id, at, text in zip(ids, hosts, texts, strict=True):
            words = text.split()
            lines: dict[int, int] = {}
            seen: set[bytes] = set()
            duplicates = 0
            for line in text.split(b"\n"):
                own = line.split()
                if own:
                    key = line_key(own)
                    lines[key] = lines.get(key, 0) + len(own)
                    duplicates += line in seen
                    seen.add(line)
            yield (
                next(number), doc_id, at, len(words), len(text.translate(None, NOT_COUNTED)), len(text) - len(text.translate(None, SYMBOLS)), duplicates, repeated_words(words),
                list(lines), list(lines.values()),
            )

    return arrow_map(
        docs.select("doc_id", F.col(host).alias("host"), F.coalesce("text", F.lit("")).cast("binary").alias("text")), run,
        "row long, doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<long>, line_words array<long>",
    )


def held_by(lines: DataFrame, wanted: DataFrame, total: int) -> DataFrame:
    """The rows of ``lines``, of which there are ``total``, whose (host, line) is in ``wanted`` (host, line, rows).

    Lines with more than a thousandth of all rows are fewer than a thousand, so they are broadcast; without
    them no key of the other join has more rows than that.
    """
    side = wanted.select(F.col("host").alias("w_host"), F.col("line").alias("w_line"), "rows")
    hot = F.col("rows") * 1000 > total
    same = lambda df: df.host.eqNullSafe(F.col("w_host")) & (df.line == F.col("w_line"))
    looked = lines.join(F.broadcast(side.filter(hot)), same(lines), "left")
    rest = looked.filter("w_line is null").select(*lines.columns)
    return looked.filter("w_line is not null").drop("w_host", "w_line").unionByName(rest.join(side.filter(~hot), same(rest)).drop("w_host", "w_line"))


def distinct_documents(lines: DataFrame, many: DataFrame, total: int) -> DataFrame:
    """(host, line, rows, documents) of the lines of ``many``: of how many documents their rows are."""
    held = held_by(lines, many, total)
    each = held.groupBy("host", "line", "doc", "nameless").agg(F.count("*").alias("n"))
    return each.groupBy("host", "line").agg(F.sum("n").alias("rows"), F.count("*").alias("documents"))


def quality_rules(
    docs: DataFrame,
    host: str = "source",
    most_documents: int = 20,
    least_words: int = 10,
    least_left: float = 0.2,
    repeat_share: int = 20,
) -> DataFrame:
    """Base measures and the verdict of the line frequency, one row per row of ``docs`` (doc_id, text, host).

    A normalised line is over the limit if more than ``most_documents`` distinct documents of one host hold it, however
    large the host is. Without such lines a document needs ``least_words`` words and ``least_left`` of its own
    words. Hosts that are null count as one host. Documents are distinct doc_ids; a row without one is a document of
    its own. A null or empty text has no words and fails the base rule, a long one is read whole; repeated rows come
    out alike and count once. An
    empty table gives no row. Other columns are not read.
    """
    own = stored(measured(docs, host), "rules")
    document = F.coalesce("doc_id", F.lit(-1).cast("long")).alias("doc"), F.when(F.col("doc_id").isNull(), F.col("row")).alias("nameless")
    lines = own.select("row", *document, "host", F.explode(F.arrays_zip("lines", "line_words")).alias("l"))
    lines = lines.select("row", "doc", "nameless", "host", F.col("l.lines").alias("line"), F.col("l.line_words").alias("words"))
    # A line that too few rows hold is in too few documents; of the others, documents are told apart before they are counted.
    many = stored(lines.groupBy("host", "line").agg(F.count("*").alias("rows")).filter(F.col("rows") > most_documents), "many")
    total = own.agg(F.sum(F.size("lines"))).first()[0] or 0
    over = stored(distinct_documents(lines, many, total).filter(F.col("documents") > most_documents), "over")
    lost = held_by(lines, over.select("host", "line", "rows"), total).groupBy("row").agg(F.sum("words").alias("lost_words"), F.count("*").alias("lost_lines"))
    base = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeat_share * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("lost_words", F.lit(0))
    return (
        own.drop("lines", "line_words", "host").join(lost, "row", "left")
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
            (~base & (left >= least_words) & (left >= least_left * F.col("n_words"))).alias("kept"),
            F.coalesce("lost_lines", F.lit(0).cast("long")).alias("n_frequent_lines"), left.alias("words_left"),
        )
    )
