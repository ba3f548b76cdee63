"""Alignment of unit sequences of revision pairs.

Every pair is a row with the arrays of both sides. The common runs of its units are found inside the row, and small
blocks of changed units are paired there too; the cells of a large block become rows of their own, which are pruned
before they leave the JVM, scored and brought together again as numbers.
"""

from __future__ import annotations

import math

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.matching import as_characters, best_pairs, edits, possible_pairs, ratio, ratio_from
from ..functions.text import clean_units, html_escape, normal_forms, split_units
from ..scratch import stored

#: Fixed value: units less alike than this are never paired.
PAIR_THRESHOLD = 0.85
#: Blocks of more cells than this leave their row.
INLINE_CELLS = 1 << 16
_NUMBERS = [T.StructField(c, T.IntegerType()) for c in ("old_no", "new_no")]
OPCODE = T.ArrayType(T.StructType([T.StructField("tag", T.StringType()), *(T.StructField(c, T.IntegerType()) for c in ("i1", "i2", "j1", "j2"))]))
OPERATION = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), *_NUMBERS]))
#: A step of an alignment: an operation, or a large block (type ``block``) that ends before ``old_end`` and ``new_end``.
STEP = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), *_NUMBERS, *(T.StructField(c, T.IntegerType()) for c in ("old_end", "new_end"))]))
HTML = T.StructType([T.StructField("old_html", T.StringType()), T.StructField("new_html", T.StringType())])


def _alike(old: list[str], new: list[str]) -> dict[str, dict[str, float]]:
    """For each old unit the new ones that it may be paired with. Each two texts are compared once, and only if
    bounds of their similarity, by length and by characters, allow a pair."""
    left, right = list(dict.fromkeys(old)), list(dict.fromkeys(new))
    found: dict[str, dict[str, float]] = {a: {} for a in left}
    for i, j in possible_pairs(left, right, PAIR_THRESHOLD):
        if (value := ratio_from(left[i], right[j], PAIR_THRESHOLD)) is not None:
            found[left[i]][right[j]] = value
    return found


def _pair_block(old: list[str], new: list[str]) -> list[tuple[str, int | None, int | None]]:
    """Order-preserving pairs of greatest total similarity; what stays unpaired reads deletions first."""
    alike = _alike(old, new)
    places: dict[str, list[int]] = {}
    for j, b in enumerate(new):
        places.setdefault(b, []).append(j)
    cells = {i: sorted((j, value) for b, value in alike[a].items() for j in places[b]) for i, a in enumerate(old) if alike[a]}
    return best_pairs(cells, len(old), len(new))


def _steps(old: list[str], new: list[str], inline_cells: int) -> list[tuple]:
    out: list[tuple] = []
    for tag, i1, i2, j1, j2 in edits(*as_characters(old, new)):
        if tag == "equal":
            out += [("equal", i1 + k, j1 + k, None, None) for k in range(i2 - i1)]
        elif tag == "delete":
            out += [("deleted", i, None, None, None) for i in range(i1, i2)]
        elif tag == "insert":
            out += [("added", None, j, None, None) for j in range(j1, j2)]
        elif (i2 - i1) * (j2 - j1) > inline_cells:
            out.append(("block", i1, j1, i2, j2))
        else:
            for kind, i, j in _pair_block(old[i1:i2], new[j1:j2]):
                if kind == "pair":
                    same = old[i1 + i].replace(" ", "") == new[j1 + j].replace(" ", "")
                    out.append(("equal" if same else "modified", i1 + i, j1 + j, None, None))
                else:
                    out.append(("deleted", i1 + i, None, None, None) if kind == "del" else ("added", None, j1 + j, None, None))
    return out


_RUN = pa.list_(pa.struct([("tag", pa.string()), *((c, pa.int32()) for c in ("i1", "i2", "j1", "j2"))]))
_CELL = [("a", pa.int32()), ("b", pa.int32()), ("value", pa.float64()), ("same", pa.bool_())]
_STEP = pa.list_(pa.struct([("type", pa.string()), *((c, pa.int32()) for c in ("old_no", "new_no", "old_end", "new_end"))]))


def _rows(*columns: pa.Array):
    return zip(*(c.to_pylist() for c in columns), strict=True)


@F.arrow_udf(OPCODE)
def align_opcodes(old: pa.Array, new: pa.Array) -> pa.Array:
    """Equal, replace, delete and insert runs over two arrays of normal forms."""
    return pa.array([edits(*as_characters(a, b)) for a, b in _rows(old, new)], _RUN)


@F.arrow_udf(T.DoubleType())
def similarity(a: pa.Array, b: pa.Array) -> pa.Array:
    """Share of the characters of two texts that lie in their common runs."""
    return pa.array([ratio(x, y) for x, y in _rows(a, b)], pa.float64())


def align_units(old: Column, new: Column, inline_cells: int = INLINE_CELLS) -> Column:
    """The steps from one array of normal forms to another; null if a side is null."""

    @F.arrow_udf(STEP)
    def run(old: pa.Array, new: pa.Array) -> pa.Array:
        return pa.array([None if a is None or b is None else _steps(a, b, inline_cells) for a, b in _rows(old, new)], _STEP)

    return run(old, new)


def _escaped(x: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = x.replace(a, b)
    return x


@F.arrow_udf(HTML)
def char_diff(old: pa.Array, new: pa.Array) -> pa.Array:
    """Both sides with changed pieces in marked spans; a change that is blank on both sides is not marked. Null if a
    side is null."""
    rows = []
    for a, b in _rows(old, new):
        if a is None or b is None:
            rows.append((None, None))
            continue
        left, right = [], []
        for tag, i1, i2, j1, j2 in edits(a, b):
            x, y = a[i1:i2], b[j1:j2]
            mark = tag != "equal" and (x.strip() or y.strip())
            left.append(f'<span class="deleted-word">{_escaped(x)}</span>' if mark and x else _escaped(x))
            right.append(f'<span class="added-word">{_escaped(y)}</span>' if mark and y else _escaped(y))
        rows.append(("".join(left), "".join(right)))
    return pa.array(rows, pa.struct([("old_html", pa.string()), ("new_html", pa.string())]))


def document_units(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, units, norms): the units without markers, and their normal forms, once for each document."""
    units = clean_units(split_units(F.coalesce(text, F.lit(""))))
    return docs.select("doc_id", units.alias("units")).withColumn("norms", normal_forms(F.col("units")))


def _sides(pairs: DataFrame) -> DataFrame:
    """A row for each side of a pair: new says which."""
    side = lambda new, c: F.struct(F.lit(new).alias("new"), F.col(c).alias("doc_id"))
    return pairs.select("pair_id", "old_doc_id", "new_doc_id", F.explode(F.array(side(False, "old_doc_id"), side(True, "new_doc_id"))).alias("s")).select("*", "s.*").drop("s")


def pair_errors(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """(pair_id, side, doc_id, problem) of each side that ``units`` does not have exactly once: missing or repeated."""
    rows = units.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"))
    sides = _sides(pairs).join(rows, "doc_id", "left").filter("n is null or n > 1")
    return sides.select("pair_id", F.when(F.col("new"), "new").otherwise("old").alias("side"), "doc_id", F.when(F.col("n").isNull(), "missing").otherwise("repeated").alias("problem"))


def paired(pairs: DataFrame, units: DataFrame, wanted: tuple[str, ...] = ("units", "norms"), hot: int = 1000) -> DataFrame:
    """One row per pair (pair_id, old_doc_id, new_doc_id) of which both sides are in ``units``, with the ``wanted``
    arrays of each.

    Both sides go through one join, so that units and normal forms are computed once for each document. A document
    that more than ``hot`` pairs name is dealt out in copies for that many pairs each, so that no task makes all of
    them. Of several rows of a document the first by its arrays counts; ``pair_errors`` names such pairs.
    """
    sides = _sides(pairs)
    named = sides.groupBy("doc_id").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("doc_id", F.ceil(F.col("n") / hot).alias("copies"))
    some = named.limit(100_001).collect()
    arrays = units.select("doc_id", *wanted)
    if some:
        copies = F.broadcast(pairs.sparkSession.createDataFrame(some, named.schema)) if len(some) <= 100_000 else stored(named, "hot_documents")
        number = F.coalesce("copies", F.lit(1).cast("long"))
        sides = sides.join(copies, "doc_id", "left").withColumn("copy", F.pmod(F.xxhash64("pair_id", "new"), number)).drop("copies")
        arrays = arrays.join(copies, "doc_id", "left").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), number - 1))).drop("copies")
    found = sides.join(arrays, ["doc_id", "copy"] if some else "doc_id").groupBy("pair_id", "old_doc_id", "new_doc_id").agg(F.collect_list(F.struct("new", *wanted)).alias("s"))
    first = lambda new: F.array_min(F.filter("s", lambda x: x["new"] == new))
    found = found.select("pair_id", "old_doc_id", "new_doc_id", first(False).alias("old"), first(True).alias("new")).filter("old is not null and new is not null")
    return found.select("pair_id", "old_doc_id", "new_doc_id", *(F.col(f"{side}.{what}").alias(f"{side}_{what}") for side in ("old", "new") for what in wanted))


def _aligned(inline_cells: int) -> Column:
    """Steps of a row of ``paired``; null where the normal forms are equal, which are not sent to Python."""
    differ = F.col("old_norms") != F.col("new_norms")
    return align_units(F.when(differ, F.col("old_norms")), F.when(differ, F.col("new_norms")), inline_cells)


def open_blocks(steps: Column) -> Column:
    """The large blocks among the steps of a row of ``paired``: number, first places, normal forms of both sides."""
    blocks = F.filter(steps, lambda s: s["type"] == "block")
    part = lambda side, s: F.slice(F.col(f"{side}_norms"), s[f"{side}_no"] + 1, s[f"{side}_end"] - s[f"{side}_no"]).alias(side)
    return F.transform(blocks, lambda s: F.struct(s["old_no"].alias("old_no"), s["new_no"].alias("new_no"), part("old", s), part("new", s)))


def block_cells(blocks: DataFrame, part: int = 256) -> DataFrame:
    """(pair_id, old_no, new_no, a, b, value, same) of the pairs of texts of each block that are alike enough.

    ``blocks`` has a row for each block (pair_id, old_no, new_no, old, new). a and b are the first places of the two
    texts inside the block. Texts are compared once each; only those of near lengths meet, in parts of about ``part``
    of each side, so that a block of any size is many groups of bounded size. In a group lengths and common characters
    leave few pairs to be compared.
    """
    key = ["pair_id", "old_no", "new_no"]
    wide = -math.log(PAIR_THRESHOLD / (2 - PAIR_THRESHOLD))
    parts = [F.ceil(F.size(side) / part).cast("int").alias(f"{side}_parts") for side in ("old", "new")]

    def texts(side: str, place: str) -> DataFrame:
        rows = blocks.select(*key, *parts, F.posexplode(side).alias("place", "text")).groupBy(*key, "old_parts", "new_parts", "text").agg(F.min("place").alias(place))
        return rows.withColumn("zone", F.floor(F.log(F.greatest(F.length("text"), F.lit(1))) / wide))

    own = lambda side: F.pmod(F.xxhash64("text"), F.col(f"{side}_parts")).cast("int").alias(f"{side}_part")
    each = lambda side: F.explode(F.sequence(F.lit(0), F.col(f"{side}_parts") - 1)).alias(f"{side}_part")
    near = F.array(*(F.col("zone") + d for d in (-1, 0, 1)))
    left = texts("old", "a").select(*key, "zone", "a", "text", own("old"), each("new"))
    right = texts("new", "b").withColumn("zone", F.explode(near)).select(*key, "zone", "b", "text", each("old"), own("new"))

    def run(at: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = left.column("a").to_pylist(), right.column("b").to_pylist()
        old, new = left.column("text").to_pylist(), right.column("text").to_pylist()
        rows = [(a[i], b[j], value, old[i].replace(" ", "") == new[j].replace(" ", "")) for i, j in possible_pairs(old, new, PAIR_THRESHOLD) if (value := ratio_from(old[i], new[j], PAIR_THRESHOLD)) is not None]
        found = pa.table({c: pa.array([r[k] for r in rows], kind) for k, (c, kind) in enumerate(_CELL)})
        for k, c in enumerate(key):
            found = found.add_column(k, c, pa.array([at[k].as_py()] * len(rows), at[k].type))
        return found

    group = [*key, "zone", "old_part", "new_part"]
    schema = T.StructType([*(blocks.schema[c] for c in key), *(T.StructField(c, T.IntegerType()) for c in "ab"), T.StructField("value", T.DoubleType()), T.StructField("same", T.BooleanType())])
    return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(run, schema)


def solve_blocks(blocks: DataFrame, part: int = 256) -> DataFrame:
    """(pair_id, old_no, new_no, op): the operations of each block, numbered in the document.

    The last step sees only numbers: the places of equal texts, and the values of the pairs of texts that are alike.
    """
    key = ["pair_id", "old_no", "new_no"]
    place = lambda side: blocks.select(*key, F.posexplode(side).alias("place", "text")).groupBy(*key, "text").agg(F.array_sort(F.collect_list("place")).alias("places")).select(*key, F.lit(side == "new").alias("new"), "places")
    fresh = lambda df: df.select(*(F.col(c).alias(c) for c in df.columns))
    places, cells = fresh(place("old").unionByName(place("new"))), fresh(block_cells(blocks, part))

    def run(at, places: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        own = {bool(new): {int(p[0]): p for p in group["places"]} for new, group in places.groupby("new")}
        old, new = own.get(False, {}), own.get(True, {})
        rows: dict[int, list] = {}
        same = {}
        for a, b, value, equal in zip(cells["a"], cells["b"], cells["value"], cells["same"], strict=True):
            for i in old[a]:
                rows.setdefault(int(i), []).extend((int(j), value) for j in new[b])
                same.update(((int(i), int(j)), equal) for j in new[b])
        found = best_pairs({i: sorted(x) for i, x in rows.items()}, sum(map(len, old.values())), sum(map(len, new.values())))
        i0, j0 = int(at[1]), int(at[2])
        op = [
            {"type": ("equal" if same[i, j] else "modified") if kind == "pair" else "deleted" if kind == "del" else "added", "old_no": None if i is None else i0 + i, "new_no": None if j is None else j0 + j}
            for kind, i, j in found
        ]
        return pd.DataFrame({"pair_id": [at[0]], "old_no": [i0], "new_no": [j0], "op": [op]})

    schema = T.StructType([blocks.schema["pair_id"], *_NUMBERS, T.StructField("op", OPERATION)])
    return places.groupBy(*key).cogroup(cells.groupBy(*key)).applyInPandas(run, schema)


def compare_pairs(pairs: DataFrame, units: DataFrame, inline_cells: int = INLINE_CELLS) -> DataFrame:
    """diff_units: pair_id, seq, type, old_no, new_no, old, new, old_html, new_html.

    Pairs with equal normal forms are not aligned; only modified units get character spans. Blocks of more than
    ``inline_cells`` cells are solved outside their rows. The table of aligned pairs keeps the units, and of the normal
    forms those of modified units and of large blocks.
    """
    at = lambda a, place: F.get(a, place)

    def operation(kind: Column, old_no: Column, new_no: Column, old: Column, new: Column) -> Column:
        norm = lambda a, name: F.when(kind == "modified", a).alias(name)
        return F.struct(kind.alias("type"), old_no.cast("int").alias("old_no"), new_no.cast("int").alias("new_no"), norm(old, "old_norm"), norm(new, "new_norm"))

    rows = paired(pairs, units).withColumn("steps", _aligned(inline_cells))
    empty = F.lit(None).cast("string")
    equal = F.transform(F.sequence(F.lit(0), F.size("old_norms") - 1), lambda i: operation(F.lit("equal"), i, i, empty, empty))
    found = F.transform("steps", lambda s: operation(s["type"], s["old_no"], s["new_no"], at(F.col("old_norms"), s["old_no"]), at(F.col("new_norms"), s["new_no"])))
    op = F.coalesce(found, F.when(F.size("old_norms") > 0, equal).otherwise(F.slice(equal, 1, 0)))
    rows = stored(rows.select("pair_id", "old_units", "new_units", op.alias("op"), open_blocks(F.col("steps")).alias("blocks")), "aligned")
    large, operations = rows.filter(F.size("blocks") > 0), rows.drop("blocks")
    if large.limit(1).count():
        solved = solve_blocks(large.select("pair_id", F.inline("blocks"))).groupBy("pair_id").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("old_no", "new_no"), "op"))).alias("solved"))

        def inside(s: Column) -> Column:
            block = F.get(F.filter("blocks", lambda b: (b["old_no"] == s["old_no"]) & (b["new_no"] == s["new_no"])), 0)
            norm = lambda o, side: at(block[side], o[f"{side}_no"] - s[f"{side}_no"])
            own = F.try_element_at("solved", F.struct(s["old_no"].alias("old_no"), s["new_no"].alias("new_no")))
            return F.transform(own, lambda o: operation(o["type"], o["old_no"], o["new_no"], norm(o, "old"), norm(o, "new")))

        whole = F.flatten(F.transform("op", lambda s: F.when(s["type"] == "block", inside(s)).otherwise(F.array(s))))
        few = rows.filter("blocks is null or size(blocks) = 0").drop("blocks")
        operations = few.unionByName(large.join(solved, "pair_id", "left").select("pair_id", "old_units", "new_units", whole.alias("op")))

    def pieces(o: Column) -> Column:
        unit = lambda side: at(F.col(f"{side}_units"), o[f"{side}_no"]).alias(side)
        return F.struct(o["type"].alias("type"), o["old_no"].alias("old_no"), o["new_no"].alias("new_no"), unit("old"), unit("new"), o["old_norm"].alias("old_norm"), o["new_norm"].alias("new_norm"))

    rows = operations.select("pair_id", F.transform("op", pieces).alias("op")).select("pair_id", F.posexplode("op").alias("seq", "o")).select("pair_id", "seq", "o.*")
    marked = rows.withColumn("h", char_diff("old_norm", "new_norm"))
    html = lambda side: F.coalesce(F.col(f"h.{side}_html"), html_escape(F.col(side))).alias(f"{side}_html")
    return marked.select("pair_id", "seq", "type", "old_no", "new_no", "old", "new", html("old"), html("new"))


def count_types(operations: Column) -> list[Column]:
    """Counters straight from an operation array, without exploding it."""
    n = lambda t: F.size(F.filter(operations, lambda o: o["type"] == t)).cast("long")
    return [n("added").alias("additions"), n("deleted").alias("deletions"), n("modified").alias("modifications"), n("equal").alias("unchanged")]


def compare_counts(pairs: DataFrame, units: DataFrame, inline_cells: int = INLINE_CELLS) -> DataFrame:
    """diff_stats of each pair without exploding its units; only normal forms travel."""
    aligned = paired(pairs, units, ("norms",)).withColumn("steps", _aligned(inline_cells))
    names = ["additions", "deletions", "modifications", "unchanged"]
    same = F.col("steps").isNull()
    counts = aligned.select("pair_id", same.alias("same"), F.size("old_norms").cast("long").alias("n"), *count_types(F.col("steps")), F.when(~same, open_blocks(F.col("steps"))).alias("blocks"))
    whole = [F.when(F.col("same"), F.col("n") if c == "unchanged" else F.lit(0).cast("long")).otherwise(F.col(c)).alias(c) for c in names]
    counts = stored(counts.select("pair_id", *whole, "blocks"), "pair_counts")
    large = counts.filter(F.size("blocks") > 0)
    counts = counts.select("pair_id", *names)
    if large.limit(1).count():
        more = solve_blocks(large.select("pair_id", F.inline("blocks"))).select("pair_id", *count_types(F.col("op")))
        counts = counts.unionByName(more).groupBy("pair_id").agg(*(F.sum(c).alias(c) for c in names))
    changes = F.col("additions") + F.col("deletions") + F.col("modifications")
    return counts.select("*", (changes + F.col("unchanged")).alias("total"), changes.alias("diff_count"))
