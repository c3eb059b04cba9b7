"""Tables of pages: edges from drawn rules or from aligned text, and cells.

Everything is expressions over one row per page: what a page holds is bounded
by its paper, so its paths and lines are gathered as arrays and no worker
process is needed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = ["doc", "page"]

# Points unless said otherwise.
RULE_WIDTH, RULE_LENGTH = 2.6, 12.0
EDGE_TOLERANCE, ROW_TOLERANCE, COLUMN_TOLERANCE, BORDER_TOLERANCE = 3.0, 8.0, 18.0, 3.0
MOST_CROSSINGS = 400  # of edges; a drawing with more is no table
SEGMENT_SHARE = 0.60  # of a cell's side that one stroke must cover
LINE_SHARE = 0.25  # of a line's area that must lie in its cell
CONFIDENCE = {"ruled": 0.94, "ruled_sparse": 0.72, "aligned": 0.58}
CONTENT_CONFIDENCE = {"ruling_lines": 0.86, "text_alignment": 0.62}


def box_paths(boxes: DataFrame) -> DataFrame:
    """Boxes (doc, page, path, x, y, width, height) as drawn paths: a thin one
    is a stroke along its middle, any other a closed outline."""
    x, y, w, h = (F.col(c) for c in ("x", "y", "width", "height"))
    point = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    down, across = (w <= RULE_WIDTH) & (h > w), (h <= RULE_WIDTH) & (w >= h)
    points = (
        F.when(down, F.array(point(x + w / 2, y), point(x + w / 2, y + h)))
        .when(across, F.array(point(x, y + h / 2), point(x + w, y + h / 2)))
        .otherwise(F.array(point(x, y), point(x + w, y), point(x + w, y + h), point(x, y + h)))
    )
    return boxes.select(*PAGE, "path", points.alias("points"), (~down & ~across).alias("closed"))


def means_of_clusters(values: Column, tolerance: float) -> Column:
    """Means of the clusters of a sorted array: a value joins the last cluster
    while it is within ``tolerance`` of its running mean."""
    start = F.struct(F.array().cast("array<double>").alias("done"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"))
    closed = lambda s: F.when(s["n"] > 0, F.concat(s["done"], F.array(s["sum"] / s["n"]))).otherwise(s["done"])

    def step(s: Column, v: Column) -> Column:
        joins = (s["n"] > 0) & (F.abs(v - s["sum"] / F.greatest(s["n"], F.lit(1))) <= tolerance)
        return F.struct(
            F.when(joins, s["done"]).otherwise(closed(s)).alias("done"),
            F.when(joins, s["sum"] + v).otherwise(v).alias("sum"),
            F.when(joins, s["n"] + 1).otherwise(1).alias("n"),
        )

    return F.aggregate(values, start, step, closed)


def _shared(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0.0))


def _drawn(paths: DataFrame) -> DataFrame:
    """One row per page: its paths with their boxes and strokes."""
    side = lambda c: F.transform("points", lambda p: p[c])
    n = F.size("points")
    following = lambda i: F.when(i < n - 1, F.col("points")[i + 1]).otherwise(F.col("points")[0])
    strokes = F.transform("points", lambda p, i: F.struct(p["x"].alias("x0"), p["y"].alias("y0"), following(i)["x"].alias("x1"), following(i)["y"].alias("y1")))
    strokes = F.when(F.col("closed"), strokes).otherwise(F.slice(strokes, 1, F.greatest(n - 1, F.lit(0))))
    box = F.struct("path", F.array_min(side("x")).alias("x"), F.array_min(side("y")).alias("y"), F.array_max(side("x")).alias("right"), F.array_max(side("y")).alias("bottom"), strokes.alias("strokes"))
    return paths.filter(n > 0).groupBy(*PAGE).agg(F.sort_array(F.collect_list(box)).alias("paths"))


def _ruled(pages: DataFrame, page_width: float, page_height: float) -> DataFrame:
    """Pages with the edges that rules and rectangles draw."""

    def edges(low: str, high: str, other_low: str, other_high: str) -> Column:
        size, length = (lambda p: p[high] - p[low]), (lambda p: p[other_high] - p[other_low])
        rules = F.transform(F.filter("paths", lambda p: (size(p) <= RULE_WIDTH) & (length(p) >= RULE_LENGTH)), lambda p: (p[low] + p[high]) / 2)
        whole = F.filter("paths", lambda p: (p["right"] - p["x"]).between(RULE_LENGTH, page_width) & (p["bottom"] - p["y"]).between(RULE_LENGTH, page_height))
        both = F.concat(rules, F.transform(whole, lambda p: p[low]), F.transform(whole, lambda p: p[high]))
        return means_of_clusters(F.sort_array(both), EDGE_TOLERANCE)

    p = pages.withColumn("xs", edges("x", "right", "y", "bottom")).withColumn("ys", edges("y", "bottom", "x", "right"))
    p = p.filter((F.size("xs") >= 2) & (F.size("ys") >= 2) & (F.size("xs") * F.size("ys") <= MOST_CROSSINGS))
    near = 4.0
    inside = F.filter("paths", lambda v: (v["x"] >= F.col("xs")[0] - near) & (v["right"] <= F.element_at("xs", -1) + near) & (v["y"] >= F.col("ys")[0] - near) & (v["bottom"] <= F.element_at("ys", -1) + near))
    p = p.withColumn("paths", inside)
    sure = F.when(F.size("paths") >= F.size("xs") + F.size("ys"), CONFIDENCE["ruled"]).otherwise(CONFIDENCE["ruled_sparse"])
    return p.select(*PAGE, F.lit("ruling_lines").alias("how"), "xs", "ys", sure.alias("confidence"), "paths")


def _aligned(lines: DataFrame, page_width: float) -> DataFrame:
    """Pages whose lines of text stand in rows and columns: three rows or more
    of two pieces or more, beginning in two to eight columns."""
    at = F.struct((F.col("y") + F.col("height") / 2).cast("double").alias("middle"), F.col("x").cast("double").alias("x"))
    start = F.struct(F.array().cast("array<array<struct<middle:double,x:double>>>").alias("done"), F.array().cast("array<struct<middle:double,x:double>>").alias("row"))
    closed = lambda s: F.concat(s["done"], F.array(s["row"]))

    def step(s: Column, v: Column) -> Column:
        joins = (F.size(s["row"]) > 0) & (F.abs(v["middle"] - F.get(s["row"], F.lit(0))["middle"]) <= ROW_TOLERANCE)
        return F.struct(F.when(joins, s["done"]).otherwise(closed(s)).alias("done"), F.when(joins, F.concat(s["row"], F.array(v))).otherwise(F.array(v)).alias("row"))

    p = lines.groupBy(*PAGE).agg(F.sort_array(F.collect_list(at)).alias("at"))
    p = p.withColumn("rows", F.filter(F.aggregate("at", start, step, closed), lambda r: F.size(r) >= 2)).filter(F.size("rows") >= 3)
    p = p.withColumn("xs", means_of_clusters(F.sort_array(F.flatten(F.transform("rows", lambda r: F.transform(r, lambda v: v["x"])))), COLUMN_TOLERANCE))
    p = p.filter(F.size("xs").between(2, 8))
    right = F.least(F.element_at("xs", -1) + page_width / F.size("xs"), F.lit(page_width))
    p = p.withColumn("right", right).filter((F.col("right") - F.greatest(F.col("xs")[0], F.lit(0.0))).between(0.2 * page_width, 0.95 * page_width))
    mean = lambda r: F.aggregate(r, F.lit(0.0), lambda a, v: a + v["middle"]) / F.size(r)
    return p.select(*PAGE, F.lit("text_alignment").alias("how"), F.sort_array(F.concat("xs", F.array("right"))).alias("xs"), F.transform("rows", mean).alias("ys"), F.lit(CONFIDENCE["aligned"]).alias("confidence"))


def _first(low: Column, high: Column, holds: Callable[[Column], Column]) -> Column:
    """The least of low..high for which something holds; else high + 1."""
    every = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    return F.coalesce(F.array_min(F.filter(every, holds)), high + 1)


def _spans(strokes: Column, xs: Column, ys: Column) -> Column:
    """Cells in reading order. A cell grows to the right, then down, until a
    stroke or another cell closes it; no two cells overlap."""
    n_rows, n_cols = F.size(ys) - 1, F.size(xs) - 1

    def drawn(at: Column, low: Column, high: Column, across: bool) -> Column:
        a, b = ("y", "x") if across else ("x", "y")
        return F.exists(
            strokes,
            lambda s: (F.abs(s[f"{a}0"] - s[f"{a}1"]) <= BORDER_TOLERANCE)
            & (F.abs((s[f"{a}0"] + s[f"{a}1"]) / 2 - at) <= BORDER_TOLERANCE)
            & (_shared(F.least(s[f"{b}0"], s[f"{b}1"]), F.greatest(s[f"{b}0"], s[f"{b}1"]), low, high) >= SEGMENT_SHARE * F.greatest(high - low, F.lit(0.01))),
        )

    def step(cells: Column, place: Column) -> Column:
        row, col = F.floor(place / n_cols).cast("int"), place % n_cols
        taken = lambda r, c0, c1: F.exists(cells, lambda s: (r >= s["row"]) & (r < s["row"] + s["row_span"]) & (s["col"] < c1) & (s["col"] + s["col_span"] > c0))

        def grown(right: Column) -> Column:
            below = _first(row + 1, n_rows - 1, lambda k: drawn(ys[k], xs[col], xs[right], True) | taken(k, col, right))
            return F.struct(row.alias("row"), col.alias("col"), (below - row).alias("row_span"), (right - col).alias("col_span"))

        right = _first(col + 1, n_cols - 1, lambda k: drawn(xs[k], ys[row], ys[row + 1], False) | taken(row, k, k + 1))
        new = F.transform(F.array(right), grown)
        return F.when(taken(row, col, col + 1), cells).otherwise(F.concat(cells, new))

    none = F.array().cast("array<struct<row:int,col:int,row_span:int,col_span:int>>")
    return F.aggregate(F.sequence(F.lit(0), n_rows * n_cols - 1), none, step)


def page_tables(paths: DataFrame, lines: DataFrame, page_width: float, page_height: float) -> DataFrame:
    """The table of each page that has one, with its cells.

    paths: doc, page, path, points, closed. lines: doc, page, line, x, y,
    width, height. A drawn table has rules or rectangles on two edges or more
    each way, and no more than 400 crossings; a page without any drawing can
    have one of aligned text, whose cells never span. Cells: row, col, spans,
    box, header (first row), lines (a quarter of their area lies in the cell)
    and borders (paths that meet the cell or run along it).
    """
    drawn = _drawn(paths)
    ruled = _ruled(drawn, page_width, page_height)
    plain = _aligned(lines.join(drawn.select(*PAGE), PAGE, "left_anti"), page_width)
    found = ruled.unionByName(plain, allowMissingColumns=True)
    box = F.struct("line", "x", "y", (F.col("x") + F.col("width")).alias("right"), (F.col("y") + F.col("height")).alias("bottom"))
    text = lines.groupBy(*PAGE).agg(F.sort_array(F.collect_list(box)).alias("_lines"))
    p = found.join(text, PAGE, "left")
    strokes = F.flatten(F.transform("paths", lambda v: v["strokes"]))
    places = F.transform(F.sequence(F.lit(0), (F.size("xs") - 1) * (F.size("ys") - 1) - 1), lambda i: F.struct(F.floor(i / (F.size("xs") - 1)).cast("int").alias("row"), (i % (F.size("xs") - 1)).alias("col"), F.lit(1).alias("row_span"), F.lit(1).alias("col_span")))
    p = p.filter((F.size("xs") >= 2) & (F.size("ys") >= 2)).withColumn("_strokes", strokes)
    p = p.withColumn("_spans", F.when(F.col("how") == "ruling_lines", _spans(F.col("_strokes"), F.col("xs"), F.col("ys"))).otherwise(places))

    def cell(c: Column) -> Column:
        xs, ys = F.col("xs"), F.col("ys")
        x, y, right, bottom = xs[c["col"]], ys[c["row"]], xs[c["col"] + c["col_span"]], ys[c["row"] + c["row_span"]]
        met = lambda v: _shared(x, right, v["x"], v["right"]) * _shared(y, bottom, v["y"], v["bottom"])
        area = lambda v: (v["right"] - v["x"]) * (v["bottom"] - v["y"])
        along = lambda v: F.least(*(F.abs(a - b) for a, b in ((v["x"], x), (v["right"], right), (v["y"], y), (v["bottom"], bottom)))) <= BORDER_TOLERANCE
        held = F.filter(F.coalesce("_lines", F.array().cast(p.schema["_lines"].dataType)), lambda v: (met(v) > 0) & (met(v) >= LINE_SHARE * area(v)))
        rules = F.filter(F.coalesce("paths", F.array().cast(p.schema["paths"].dataType)), lambda v: (met(v) > 0) | along(v))
        return F.struct(
            *(c[n].alias(n) for n in ("row", "col", "row_span", "col_span")), x.alias("x"), y.alias("y"), (right - x).alias("width"), (bottom - y).alias("height"),
            (c["row"] == 0).alias("header"), F.transform(held, lambda v: v["line"]).alias("lines"), F.transform(rules, lambda v: v["path"]).alias("borders"),
        )

    content = F.when(F.col("how") == "ruling_lines", CONTENT_CONFIDENCE["ruling_lines"]).otherwise(CONTENT_CONFIDENCE["text_alignment"])
    return p.select(*PAGE, "how", (F.size("xs") - 1).alias("columns"), (F.size("ys") - 1).alias("rows"), "xs", "ys", "confidence", content.alias("content_confidence"), F.transform("_spans", cell).alias("cells"))


def cells(tables: DataFrame) -> DataFrame:
    """One row per cell of each page's table."""
    return tables.select(*PAGE, "how", "confidence", F.explode("cells").alias("c")).select(*PAGE, "how", "c.*", "confidence")
