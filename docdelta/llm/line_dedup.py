"""Line dedup: a segment-partition edit join in DataFrame operations only.

A line goes if an earlier line (by document and place) is within one edit of it. With a threshold of one edit
a line is cut into two segments, one of which must stand unchanged in its partner: at the front, or at the
back. Lines are indexed under both segments, and probed with the segments of the lengths that are allowed.
Pairs from equal keys are verified by a banded bit-parallel edit distance of the part that may differ.

A key shared by very many lines is not joined: those lines are indexed anew with more, shorter regions, where
a key is all that stands before and behind a region. When the regions are down to a character, equal keys
already mean one edit, and no pair has to be formed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

NODE = ["h1", "h2"]
MAX_EDITS = 1


def _place(df_prefix: str = "") -> Column:
    """Where a line stands: the order in which lines count as earlier."""
    return F.struct(*(F.col(df_prefix + c).alias(c) for c in ("doc_id", "text_hash", "line_no")))


def document_lines(docs: DataFrame, least_chars: int, short_copies: bool = True) -> DataFrame:
    """(doc_id, text_hash, line_no, line, chars, h1, h2) for the lines of ``least_chars`` or more characters; with
    ``short_copies`` also for shorter ones that are not blank."""
    own = F.col("chars") >= least_chars
    lines = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return (
        lines.withColumn("chars", F.length("line")).filter(own | F.col("line").rlike(r"\S") if short_copies else own)
        .withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit(7), "line"))
    )


def _border(length: Column, region: Column | int, regions: Column | int) -> Column:
    return F.floor(length * F.lit(region) / F.lit(regions)).cast("int") if isinstance(region, int) else F.floor(length * region / F.lit(regions)).cast("int")


def _key(line: Column, chars: Column, length: Column, region: Column, regions: int) -> Column:
    """Hash of what stands before and behind a region, for a partner of ``length`` characters."""
    low = _border(length, region, regions)
    high = _border(length, region + 1, regions)
    front, back = F.substring(line, F.lit(1), low), F.substring(line, chars - (length - high) + 1, length - high)
    return F.xxhash64(length, F.lit(regions), region, front, back)


def _keys(regions: int) -> Column:
    """Keys of both halves under which a line is found (own), and with which it looks for lines one character shorter."""
    line, chars = F.col("line"), F.col("chars")
    return F.array(*(_key(line, chars, chars - int(not own), F.lit(r), regions) for r in range(regions) for own in (True, False)))


def _parts(group: DataFrame, regions: int, into: int) -> DataFrame:
    """Rows (line, own, region) with the keys of the ``into`` parts that each region is cut into."""
    cut = group.withColumn("region", F.explode(F.transform(F.sequence(F.lit(0), F.lit(into - 1)), lambda c: F.col("region") * into + c)))
    length = F.when(F.col("own"), F.col("chars")).otherwise(F.col("chars") - 1)
    return cut.select(*NODE, "own", "region", _key(F.col("line"), F.col("chars"), length, F.col("region"), regions * into).alias("key"))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def within_edits(a: Column, b: Column, most: int = MAX_EDITS) -> Column:
    """Whether the edit distance of two strings is at most ``most``: Hyyro's banded bit-parallel algorithm.

    The band of 2 * most + 1 diagonals is one long; the fold goes over the characters of ``b`` and slides the
    band along ``a``. Bit k of a column stands for row j - most + k.
    """
    width = 2 * most + 1
    full = (1 << width) - 1

    def lit(x: int) -> Column:
        return F.lit(x).cast("long")

    def step(state: Column, j: Column, xs: Column, ys: Column) -> Column:
        char = F.get(ys, j - 1)
        match = lit(0)
        for k in range(width):
            match = match.bitwiseOR(F.when(F.get(xs, j - 1 + (k - most)) == char, lit(1 << k)).otherwise(lit(0)))
        # Differences down a column, one bit for each row of the band: plus (vp) or minus (vn) one.
        vp, vn, above = state["vp"], state["vn"], state["low"]

        def column(diagonal: Column) -> Column:
            hp = vn.bitwiseOR(F.bitwise_not(diagonal.bitwiseOR(vp)))
            hn = diagonal.bitwiseAND(vp)
            down = F.shiftrightunsigned(diagonal, 1)
            return F.struct(
                hn.bitwiseOR(F.bitwise_not(down.bitwiseOR(hp))).bitwiseAND(lit(full)).alias("vp"),
                down.bitwiseAND(hp).bitwiseAND(lit(full)).alias("vn"),
                # the distance on the lowest diagonal of the band
                (above + F.when(diagonal.bitwiseAND(lit(1 << (width - 1))) != 0, 0).otherwise(1)).cast("int").alias("low"),
            )

        return _let(match, lambda m: _let((m.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(m).bitwiseOR(vn), column))

    start = F.struct(lit(full ^ ((1 << most) - 1)).alias("vp"), lit(0).alias("vn"), F.lit(most).alias("low"))
    # From the lowest diagonal up to the one that ends in the corner, by the differences of the last column.
    steps = F.lit(most) + F.length(b) - F.length(a)

    def up(state: Column) -> Column:
        total = state["low"]
        for k in range(width - 1):
            bit = lit(1 << (width - 2 - k))  # columns come out slid by one row
            move = F.when(state["vp"].bitwiseAND(bit) != 0, 1).when(state["vn"].bitwiseAND(bit) != 0, -1).otherwise(0)
            total = total - F.when(F.lit(k) < steps, move).otherwise(0)
        return total

    def fold(xs: Column, ys: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.size(ys)), start, lambda state, j: step(state, j, xs, ys), lambda last: up(last) <= most)

    near = _let(F.split(a, ""), lambda xs: _let(F.split(b, ""), lambda ys: fold(xs, ys)))
    return (
        F.when(F.abs(F.length(a) - F.length(b)) > most, F.lit(False))
        .when((F.length(a) == 0) | (F.length(b) == 0), F.greatest(F.length(a), F.length(b)) <= most)
        .otherwise(near)
    )


def _shared(keyed: DataFrame) -> DataFrame:
    """Rows whose key other lines have too, with the number of rows under the key."""
    sizes = keyed.groupBy("key").agg(F.count("*").alias("rows"), F.count_if("own").alias("owners")).filter("rows > 1 and owners > 0")
    return keyed.join(sizes.select("key", "rows"), "key")


def _pairs(rows: DataFrame, regions: int) -> DataFrame:
    """Of each pair with a common key, the line that has an earlier neighbour: (h1, h2)."""
    a = rows.filter("own").select("key", "region", *(F.col(c).alias(f"a_{c}") for c in (*NODE, "place", "line", "chars")))
    b = rows.select("key", F.col("region").alias("b_region"), "own", *(F.col(c).alias(f"b_{c}") for c in (*NODE, "place", "line", "chars")))
    pair = a.join(b, "key").filter((F.col("region") == F.col("b_region")) & (~F.col("own") | (F.col("a_place") < F.col("b_place"))))
    length, region = F.col("a_chars"), F.col("region")
    low, high = _border(length, region, regions), _border(length, region + 1, regions)

    def middle(side: str) -> Column:
        return F.substring(F.col(f"{side}_line"), low + 1, F.col(f"{side}_chars") - (length - high) - low)

    near = pair.select(
        *(c for c in pair.columns if c[:2] in ("a_", "b_") and c[2:] in (*NODE, "place")),
        (F.substring("a_line", F.lit(1), low) == F.substring("b_line", F.lit(1), low)).alias("fronts"),
        middle("a").alias("a_middle"), middle("b").alias("b_middle"),
    ).filter("fronts").filter(within_edits(F.col("a_middle"), F.col("b_middle")))
    later = F.when(F.col("a_place") < F.col("b_place"), F.struct(*(F.col(f"b_{c}").alias(c) for c in NODE))).otherwise(F.struct(*(F.col(f"a_{c}").alias(c) for c in NODE)))
    return near.select(later.alias("n")).select("n.*").distinct()


def _by_character(group: DataFrame, regions: int) -> DataFrame:
    """The later neighbours under very common keys, without pairs: (h1, h2).

    The regions of ``group`` have one character at most. One substitution: lines that are equal but for that
    character; all but the earliest have an earlier neighbour. One insertion: a line without a character there
    is another line as a whole; all meet at that line.
    """
    line, chars = F.col("line"), F.col("chars")
    length = F.when(F.col("own"), chars).otherwise(chars - 1)
    low, high = _border(length, F.col("region"), regions), _border(length, F.col("region") + 1, regions)
    wide = F.when(F.col("own"), high).otherwise(high + 1)
    spots = group.filter(wide > low).withColumn("p", F.explode(F.sequence(low + 1, wide)))
    front, back = F.substring(line, F.lit(1), F.col("p") - 1), F.substring(line, F.col("p") + 1, chars)
    swapped = spots.filter("own").select(*NODE, "place", F.xxhash64(chars, "p", front, F.lit(3), back).alias("key")).distinct()
    first = swapped.groupBy("key").agg(F.min("place").alias("first"), F.count("*").alias("n")).filter("n > 1")
    substituted = swapped.join(first, "key").filter("place > first").select(*NODE)
    shorter = spots.filter("not own").select(*NODE, "place", F.xxhash64(F.concat(front, back)).alias("key")).distinct()
    centers = group.filter("own").select(F.xxhash64(line).alias("key"), F.col("h1").alias("c1"), F.col("h2").alias("c2"), F.col("place").alias("center")).distinct()
    star = shorter.join(centers, "key")
    inserted = star.filter("center < place").select(*NODE).unionByName(star.filter("place < center").select(F.col("c1").alias("h1"), F.col("c2").alias("h2")))
    return substituted.unionByName(inserted).distinct()


def _small(df: DataFrame, most: int) -> bool:
    """Whether a stored table has at most ``most`` rows."""
    return df.limit(most + 1).count() <= most


def near_lines(lines: DataFrame, bucket: int = 32, broadcast_rows: int = 200_000, least_chars: int = 0) -> tuple[DataFrame, DataFrame]:
    """(distinct lines with their first place and number, those of ``least_chars`` or more characters with an
    earlier such line within one edit)."""
    keys = [F.min(f"k{i}").alias(f"k{i}") for i in range(4)]
    with_keys = lines.withColumn("k", _keys(2)).select(*NODE, "chars", _place().alias("place"), *(F.col("k")[i].alias(f"k{i}") for i in range(4)))
    distinct = stored(with_keys.groupBy(*NODE).agg(F.min("place").alias("place"), F.count("*").alias("n"), F.min("chars").alias("chars"), *keys), "lines")
    entries = F.array(*(F.struct(F.col(f"k{i}").alias("key"), F.lit(i % 2 == 0).alias("own"), F.lit(i // 2).alias("region")) for i in range(4)))
    keyed = distinct.filter(F.col("chars") >= least_chars).select(*NODE, F.explode(entries).alias("e")).select(*NODE, "e.*")
    shared = stored(_shared(keyed), "shared")

    # Only lines that share a key need their text.
    nodes = stored(shared.select(*NODE).distinct().join(distinct.select(*NODE, "place", F.col("chars").alias("n_chars")), NODE), "nodes")
    wanted = nodes.select(F.col("h1").alias("w1"), F.col("h2").alias("w2"), "place")
    if _small(nodes, broadcast_rows):
        wanted = F.broadcast(wanted)
    same_place = _place().eqNullSafe(F.col("place"))
    texts = lines.join(wanted, (F.col("h1") == F.col("w1")) & (F.col("h2") == F.col("w2")) & same_place).select(*NODE, "place", "line", "chars").dropDuplicates(NODE)
    texts = stored(texts, "texts")

    regions, found = 2, []
    while True:
        found.append(stored(_pairs(shared.filter(F.col("rows") <= bucket).join(texts, NODE), regions), "near"))
        heavy = stored(shared.filter(F.col("rows") > bucket).select(*NODE, "own", "region").distinct(), "heavy")
        if heavy.isEmpty():
            break
        group = heavy.join(texts, NODE)
        if regions >= group.agg(F.max("chars")).first()[0]:
            found.append(stored(_by_character(group, regions), "near"))
            break
        shared = stored(_shared(_parts(group, regions, 8)), "shared")
        regions *= 8
    return distinct, reduce(DataFrame.unionByName, found).distinct()


def removed_lines(docs: DataFrame, least_chars: int = 30, bucket: int = 32, broadcast_rows: int = 200_000, short_copies: bool = True) -> DataFrame:
    """(doc_id, text_hash, removed): the numbers of the lines that go, for texts that lose any."""
    lines = document_lines(docs, least_chars, short_copies)
    distinct, near = near_lines(lines, bucket, broadcast_rows, least_chars)
    marked = near.withColumn("near", F.lit(True))
    doubtful = distinct.join(marked, NODE, "left").filter("n > 1 or near").select(F.col("h1").alias("w1"), F.col("h2").alias("w2"), "place", F.coalesce("near", F.lit(False)).alias("near"))
    doubtful = stored(doubtful, "doubtful")
    if _small(doubtful, broadcast_rows):
        doubtful = F.broadcast(doubtful)
    gone = lines.select("doc_id", "text_hash", "line_no", *NODE).join(doubtful, (F.col("h1") == F.col("w1")) & (F.col("h2") == F.col("w2")))
    gone = gone.filter(F.col("near") | ~_place().eqNullSafe(F.col("place")))
    return stored(gone.groupBy("doc_id", "text_hash").agg(F.collect_set("line_no").alias("removed")), "removed")


def line_dedup(docs: DataFrame, least_chars: int = 30, bucket: int = 32, broadcast_rows: int = 200_000, short_copies: bool = True) -> DataFrame:
    """The rows of ``docs`` with all their columns, ``text`` without repeated lines, and ``removed``.

    A line of at least ``least_chars`` characters goes if it stands earlier too, by doc_id and line number, as
    it is or within one edit. ``removed`` holds the numbers of the lines that went (null: none). Shorter lines
    go if they stand earlier as they are, but for blank ones (one edit makes most short lines alike, so the
    threshold is none for them); without ``short_copies`` they all stay. Null texts stay null, empty ones empty.
    Null doc_ids come first. Repeated rows (same doc_id and text)
    count as one text and come out alike. A column named ``removed`` is replaced.
    """
    gone = removed_lines(docs, least_chars, bucket, broadcast_rows, short_copies)
    side = gone.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"), "removed")
    if _small(gone, broadcast_rows):
        side = F.broadcast(side)
    names = [c for c in docs.columns if c != "removed"]
    joined = docs.select(*names).join(side, docs.doc_id.eqNullSafe(F.col("gone_id")) & (F.xxhash64(docs.text) == F.col("gone_hash")), "left")
    rest = F.array_join(F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains("removed", i)), "\n")
    return joined.select(*(F.when(F.col("removed").isNull(), F.col("text")).otherwise(rest).alias("text") if c == "text" else F.col(c) for c in names), "removed")
