"""Page geometry: content regions, lines from fragments, crop boxes."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip_space

KEYS = ["doc_id", "page_idx"]
# Tolerance of a straight segment, least lengths, gaps in points.
FLAT, LEAST_RULE, LEAST_SIDE, BASELINE_GAP, SPACE_GAP, IMAGE_SHARE = 0.1, 50, 20, 2.5, 1.0, 0.30


def _first_anchors(anchors: DataFrame, name: str) -> DataFrame:
    return anchors.filter((F.col("hit_no") == 0) & (F.col("anchor") == name))


def rule_below_anchor(anchors: DataFrame, segments: DataFrame) -> DataFrame:
    """(doc_id, page_idx, y_top): the nearest long horizontal segment below the top anchor that spans its centre."""
    left, right = F.least("p1x", "p2x"), F.greatest("p1x", "p2x")
    rules = segments.filter((F.abs(F.col("p1y") - F.col("p2y")) < FLAT) & (right - left > LEAST_RULE)).select(*KEYS, "seg_no", left.alias("left"), right.alias("right"), F.col("p1y").alias("y"))
    near = _first_anchors(anchors, "top").join(rules, KEYS).filter("y > y1 and (x0 + x1) / 2 between left and right")
    return near.groupBy(*KEYS).agg(F.min_by("y", F.struct("y", "seg_no")).alias("y_top"))


def rule_right_of_anchor(anchors: DataFrame, segments: DataFrame) -> DataFrame:
    """(doc_id, page_idx, y_bottom): the top end of the nearest vertical segment right of the bottom anchor."""
    top, low = F.least("p1y", "p2y"), F.greatest("p1y", "p2y")
    upright = (F.abs(F.col("p1x") - F.col("p2x")) < FLAT) & (F.abs(F.col("p1y") - F.col("p2y")) >= FLAT)
    sides = segments.filter(upright & (low - top > LEAST_SIDE)).select(*KEYS, "seg_no", top.alias("top"), low.alias("low"), F.col("p1x").alias("x"))
    near = _first_anchors(anchors, "bottom").join(sides, KEYS).filter("x > x1 and (y0 + y1) / 2 between top and low")
    return near.groupBy(*KEYS).agg(F.min_by("top", F.struct("x", "seg_no")).alias("y_bottom"))


def content_regions(anchors: DataFrame, segments: DataFrame) -> DataFrame:
    """(doc_id, page_idx, y_top, y_bottom) of the pages that have both rules in order."""
    return rule_below_anchor(anchors, segments).join(rule_right_of_anchor(anchors, segments), KEYS).filter("y_top < y_bottom")


def content_page_lines(text_lines: DataFrame, regions: DataFrame) -> DataFrame:
    """(doc_id, page_idx, line_no, text) of the lines whose centre is in the region, borders included."""
    middle = (F.get("bbox", 1) + F.get("bbox", 3)) / 2
    rows = text_lines.join(regions, KEYS).filter(middle.between(F.col("y_top"), F.col("y_bottom")))
    return rows.select(*KEYS, "line_no", strip_space(F.array_join("spans", "")).alias("text")).filter("text <> ''")


def to_fragment(item: str, viewport: str) -> Column:
    """x, right, baseline and bbox of a text item: the viewport's matrix times the item's own."""
    m = lambda a, k: F.get(F.col(a), k)
    product = [m(viewport, 0 if k % 2 == 0 else 1) * m(item, k - k % 2) + m(viewport, 2 if k % 2 == 0 else 3) * m(item, k - k % 2 + 1) for k in range(4)]
    x = m(viewport, 0) * m(item, 4) + m(viewport, 2) * m(item, 5) + m(viewport, 4)
    baseline = m(viewport, 1) * m(item, 4) + m(viewport, 3) * m(item, 5) + m(viewport, 5)
    height = F.coalesce(F.nullif(F.hypot(product[2], product[3]), F.lit(0.0)), F.nullif(F.col("height"), F.lit(0.0)), F.lit(0.0))
    return F.struct(x.alias("x"), (x + F.col("width")).alias("right"), baseline.alias("baseline"), F.array(x, baseline - height, x + F.col("width"), baseline).alias("bbox"))


def merge_bbox(box: str) -> Column:
    """The smallest box around all boxes of a group."""
    at = lambda k: F.get(F.col(box), k)
    return F.array(F.min(at(0)), F.min(at(1)), F.max(at(2)), F.max(at(3)))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def line_numbers(baselines: pa.Array) -> pa.Array:
    """For the sorted baselines of a page the line of each: a line goes on while its first baseline is near. One walk
    over the page, which holds a number; a baseline that is missing is a line of its own."""
    out = []
    for page in baselines.to_pylist():
        first, line, own = None, 0, []
        for y in page:
            if y is None or first is None or not abs(y - first) <= BASELINE_GAP:
                first, line = y, line + 1
            own.append(line)
        out.append(own)
    return pa.array(out, pa.list_(pa.int32()))


def fragments_to_lines(fragments: DataFrame) -> DataFrame:
    """(doc_id, page_idx, line_no, text, bbox) from fragments (doc_id, page_idx, frag_no, str, x, right, baseline, bbox).

    Fragments by baseline and x; one belongs to a line while its baseline is near that of the line's first
    fragment. Each page is gathered once; only its baselines are numbered apart, and the windows keep its partitioning.
    """
    shown = fragments.filter(strip_space(F.col("str")) != "")
    gathered = shown.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("baseline", "x", "frag_no", "str", "right", "bbox"))).alias("f"))
    pages = gathered.withColumn("line", line_numbers(F.transform("f", lambda f: f["baseline"])))
    numbered = pages.select(*KEYS, F.explode(F.arrays_zip("f", "line")).alias("e")).select(*KEYS, "e.f.*", "e.line")
    along = Window.partitionBy(*KEYS, "line").orderBy("x", "baseline", "frag_no")
    gap = (F.col("x") - F.lag("right").over(along) > SPACE_GAP) & ~F.startswith("str", F.lit(" ")) & ~F.endswith(F.lag("str").over(along), F.lit(" "))
    rows = numbered.withColumn("piece", F.concat(F.when(gap, " ").otherwise(""), "str")).withColumn("at", F.row_number().over(along))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda p: p["piece"]), "")
    lines = rows.groupBy(*KEYS, "line").agg(strip_space(text).alias("text"), merge_bbox("bbox").alias("bbox")).filter("text <> ''")
    return lines.select(*KEYS, (F.row_number().over(Window.partitionBy(*KEYS).orderBy("line")) - 1).alias("line_no"), "text", "bbox")


# Page sizes in inches by family, and the offsets of its crop box in points.
FAMILIES = [("A", 8.5, 11.0, 0.56, 0.20, 0.74, 2.00), ("B", 8.281, 11.427, 0.0, 0.0, 0.0, 0.0)]
SIZE_TOLERANCE = 0.1


def page_family(pages: DataFrame) -> DataFrame:
    """doc_id with the family of page 2 and its offsets; an unknown size counts as the first family."""
    is_b = (F.abs(F.col("width") / 72 - FAMILIES[1][1]) < SIZE_TOLERANCE) & (F.abs(F.col("height") / 72 - FAMILIES[1][2]) < SIZE_TOLERANCE)
    is_a = (F.abs(F.col("width") / 72 - FAMILIES[0][1]) < SIZE_TOLERANCE) & (F.abs(F.col("height") / 72 - FAMILIES[0][2]) < SIZE_TOLERANCE)
    pick = lambda k: F.when(~is_a & is_b, F.lit(FAMILIES[1][k])).otherwise(F.lit(FAMILIES[0][k]))
    return pages.filter("page_idx = 1").select("doc_id", pick(0).alias("family"), pick(3).alias("off_left"), pick(4).alias("off_top"), pick(5).alias("off_right"), pick(6).alias("off_bottom"))


def truncate_at_image_page(pages: DataFrame, images: DataFrame) -> DataFrame:
    """Pages before the first one of which an image covers a large share."""
    share = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) / (F.col("width") * F.col("height"))
    first = images.join(pages, KEYS).filter(share >= IMAGE_SHARE).groupBy("doc_id").agg(F.min("page_idx").alias("cut"))
    return pages.join(first, "doc_id", "left").filter("cut is null or page_idx < cut").drop("cut")


def crop_boxes(pages: DataFrame, found: DataFrame) -> DataFrame:
    """Margins of each page from the rule lines ``found`` (doc_id, page_idx, left, top, right, bottom).

    Right and bottom margins are measured in the page whose lines they come from. Page 1 uses its own lines,
    else the margins of page 2; later pages use those of page 2, whatever their own size. Documents without
    lines on page 2 get no box.
    """
    measured = found.filter("page_idx < 2").join(pages.select(*KEYS, "width", "height"), KEYS).join(page_family(pages), "doc_id")
    margins = F.struct(
        (F.col("left") + F.col("off_left")).alias("left"), (F.col("top") + F.col("off_top")).alias("top"),
        (F.col("width") - F.col("right") + F.col("off_right")).alias("right"), (F.col("height") - F.col("bottom") + F.col("off_bottom")).alias("bottom"),
    )
    of_page = lambda k: F.max(F.when(F.col("page_idx") == k, margins))
    both = measured.groupBy("doc_id").agg(of_page(0).alias("first"), of_page(1).alias("second")).filter("second is not null")
    own = F.when(F.col("page_idx") == 0, F.coalesce("first", "second")).otherwise(F.col("second"))
    return pages.join(both, "doc_id").select(*KEYS, own.alias("m")).select(*KEYS, "m.*")
