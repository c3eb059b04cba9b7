"""Regions of pages and their reading order, by windows over lines.

Lines over the whole width cut a page with columns into sections; in a section
lines fall into columns, and in a column a wide gap begins a new region. The
order of regions is a sort key, and each edge of the order graph says why one
region stands before another. As every edge runs forward in that order, it is
the topological order of the graph: no serial walk is needed and no cycle can
arise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.operators import layout

PAGE = layout.PAGE
# The gap in points that parts regions, with and without columns.
COLUMN_GAP, WIDE_GAP = 10.0, 14.0
TABLE_SHARE = 0.25  # of a region's area that lies in the page's table
HEADING_SLACK = 2.0
SEQUENCE_CONFIDENCE = 0.98
RELATIONS = ("same_column_above", "column_transition", "full_width_heading_to_column", "source_line_sequence")


def placed_lines(lines: DataFrame, page_width: float) -> DataFrame:
    """Lines with section, column (null over the whole width), the number of
    columns of the page and the confidence in its gutters."""
    whole = layout.gutters(lines, page_width).select(*PAGE).distinct().withColumn("_cut", F.lit(True))
    by = W.partitionBy(*PAGE).orderBy("y", "x", "line")
    banner = F.coalesce("_cut", F.lit(False)) & layout.full_width(F.col("x"), F.col("width"), page_width)
    begins = F.col("_banner") | F.coalesce(F.lag("_banner").over(by), F.lit(True))
    keys = [*PAGE, "section"]
    cut = lines.join(whole, PAGE, "left").withColumn("_banner", banner)
    cut = cut.withColumn("section", F.sum(begins.cast("int")).over(by.rowsBetween(W.unboundedPreceding, 0)) - 1).drop("_cut", "_banner")
    gaps = layout.gutters(cut, page_width, keys)
    sure = F.greatest(F.lit(0.55), F.least(F.lit(1.0), 0.55 + F.avg(F.col("right") - F.col("left")) / page_width))
    pages = gaps.groupBy(*keys).agg(F.count("*").alias("n"), sure.alias("sure")).groupBy(*PAGE).agg((F.max("n") + 1).cast("int").alias("columns"), F.min("sure").alias("confidence"))
    out = layout.columns_of(cut, gaps, page_width, keys).join(pages, PAGE, "left")
    return out.withColumn("columns", F.coalesce("columns", F.lit(1))).withColumn("confidence", F.coalesce("confidence", F.lit(1.0)))


def _key() -> list[Column]:
    """Sort key of regions: regions over the whole width part the others of
    their section; between them column after column, from top to bottom."""
    several = F.col("columns") > 1
    return [F.col("section"), F.when(several, F.col("_band")), F.when(several, F.col("column").isNotNull()), F.when(several, F.col("column")), F.col("y"), F.col("x"), F.col("_part"), F.col("column").asc_nulls_first()]


def regions(lines: DataFrame, page_width: float, page_height: float, tables: DataFrame | None = None) -> DataFrame:
    """doc, page, region (its place in reading order), section, column, box,
    text, lines, kind, alternative (its place by height alone), columns,
    confidence.

    lines: doc, page, line, text, x, y, width, height and, if known,
    font_size. tables: those of ``page_tables``; a region of which a quarter
    lies in one is of kind table.
    """
    font = F.avg("font_size") if "font_size" in lines.columns else F.lit(0.0)
    d = placed_lines(lines, page_width)
    column = W.partitionBy(*PAGE, "section", "column").orderBy("y", "x", "line")
    gap = F.col("y") - F.lag(F.col("y") + F.col("height")).over(column)
    d = d.withColumn("_gap", gap)
    parted = F.col("_gap") > F.when(F.col("column").isNull(), WIDE_GAP).otherwise(COLUMN_GAP)
    d = d.withColumn("_part", F.sum(F.coalesce(parted, F.lit(False)).cast("int")).over(column.rowsBetween(W.unboundedPreceding, 0)))
    r = d.groupBy(*PAGE, "section", "column", "_part", "columns", "confidence").agg(
        F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("width")).alias("_right"), F.max(F.col("y") + F.col("height")).alias("_bottom"),
        font.alias("_font"), F.sort_array(F.collect_list(F.struct("y", "x", "line", "text"))).alias("_l"),
    )
    text = F.array_join(F.transform("_l", lambda v: v["text"]), " ")
    r = r.withColumn("text", text).withColumn("lines", F.transform("_l", lambda v: v["line"])).withColumn("width", F.col("_right") - F.col("x")).withColumn("height", F.col("_bottom") - F.col("y"))
    kind = layout.region_kind(F.col("text"), F.col("y"), F.col("_font"), page_height)
    if tables is not None:
        box = tables.select(*PAGE, F.col("xs")[0].alias("_tx"), F.element_at("xs", -1).alias("_tr"), F.col("ys")[0].alias("_ty"), F.element_at("ys", -1).alias("_tb"))
        shared = F.greatest(F.least("_right", "_tr") - F.greatest("x", "_tx"), F.lit(0.0)) * F.greatest(F.least("_bottom", "_tb") - F.greatest("y", "_ty"), F.lit(0.0))
        r = r.join(box, PAGE, "left")
        kind = F.when((shared > 0) & (shared >= TABLE_SHARE * F.col("width") * F.col("height")), "table").otherwise(kind)
    bands = W.partitionBy(*PAGE, "section").orderBy("y").rangeBetween(W.unboundedPreceding, 0)
    r = r.withColumn("kind", kind).withColumn("_band", F.sum(F.col("column").isNull().cast("int")).over(bands))
    page = W.partitionBy(*PAGE)
    r = r.withColumn("region", F.row_number().over(page.orderBy(*_key())) - 1).withColumn("alternative", F.row_number().over(page.orderBy("y", "x", "region")) - 1)
    return r.select(*PAGE, "region", "section", "column", "x", "y", "width", "height", "text", "lines", "kind", "alternative", "columns", "confidence")


def order_edges(found: DataFrame) -> DataFrame:
    """doc, page, before, after, relation, confidence of the regions of pages.

    A region stands before the next of its column; the last of a column before
    the first of the column to its right; a heading over the whole width
    before the first of each column below it; and lines that follow each other
    in the source, in one column, put their regions in that order. Of several
    reasons for one pair the first in this list is given.
    """
    r = found.select(*PAGE, "region", "section", "column", "y", "height", "confidence", "lines")
    keys = [*PAGE, "section"]
    own = W.partitionBy(*keys, "column").orderBy("region")
    edge = lambda d, before, after, n, sure: d.select(*PAGE, F.col(before).alias("before"), F.col(after).alias("after"), F.lit(n).alias("_n"), sure.alias("confidence"))
    sure = F.col("confidence")
    above = edge(r.withColumn("_next", F.lead("region").over(own)).filter("_next IS NOT NULL"), "region", "_next", 0, sure)

    ends = r.filter("column IS NOT NULL").groupBy(*keys, "column").agg(F.min("region").alias("first"), F.max("region").alias("last"), F.min_by("y", "region").alias("top"), F.first("confidence").alias("confidence"))
    right = ends.select(*keys, (F.col("column") - 1).alias("column"), F.col("first").alias("_first"))
    across = edge(ends.join(right, [*keys, "column"]), "last", "_first", 1, sure)

    wide = r.filter("column IS NULL").select(*keys, "region", (F.col("y") + F.col("height")).alias("_bottom"))
    heads = edge(ends.join(wide, keys).filter(F.col("_bottom") <= F.col("top") + HEADING_SLACK), "region", "first", 2, sure)

    line = r.select(*PAGE, "region", "section", "column", F.explode("lines").alias("line"))
    source = W.partitionBy(*PAGE).orderBy("line", "region")
    after = F.lead(F.struct("region", "section", "column")).over(source)
    told = line.withColumn("_a", after).filter((F.col("_a.section") == F.col("section")) & F.col("_a.column").eqNullSafe(F.col("column")))
    told = edge(told.withColumn("_after", F.col("_a.region")), "region", "_after", 3, F.lit(SEQUENCE_CONFIDENCE))

    every = above.unionByName(across).unionByName(heads).unionByName(told).filter("before < after")
    best = every.groupBy(*PAGE, "before", "after").agg(F.min(F.struct("_n", "confidence")).alias("b"))
    return best.select(*PAGE, "before", "after", F.lit(list(RELATIONS))[F.col("b._n")].alias("relation"), F.col("b.confidence").alias("confidence"))


def in_order(lines: DataFrame, found: DataFrame) -> DataFrame:
    """Lines with the region, kind and column that hold them and their place
    in the reading order of their page."""
    held = found.select(*PAGE, "region", "column", "kind", F.posexplode("lines").alias("_at", "line"))
    by = W.partitionBy(*PAGE).orderBy("region", "_at")
    return lines.join(held, [*PAGE, "line"]).select(*PAGE, "line", "text", "column", "region", "kind", (F.row_number().over(by) - 1).alias("position"))
