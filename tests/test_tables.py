"""Cells of tables against a plain walk over the grid, and the written cases."""

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import tables

PATHS = "doc string, page int, path string, points array<struct<x:double,y:double>>, closed boolean"
LINES = "doc string, page int, line int, x double, y double, width double, height double"


def strokes(paths):
    for _, _, _, pts, closed in paths:
        yield from zip(pts, pts[1:] + ([pts[0]] if closed else []), strict=False)


def walk(paths, xs, ys):
    """(row, col, row span, col span): right, then down, until a stroke."""

    def closed(axis, at, low, high):
        other = 1 - axis
        for a, b in strokes(paths):
            lo, hi = sorted((a[other], b[other]))
            if abs(a[axis] - b[axis]) <= 3 and abs((a[axis] + b[axis]) / 2 - at) <= 3 and min(hi, high) - max(lo, low) >= 0.6 * (high - low):
                return True
        return False

    free = {(r, c) for r in range(len(ys) - 1) for c in range(len(xs) - 1)}
    out = []
    for r, c in sorted(free):
        if (r, c) not in free:
            continue
        right, below = c + 1, r + 1
        while right < len(xs) - 1 and (r, right) in free and not closed(0, xs[right], ys[r], ys[r + 1]):
            right += 1
        while below < len(ys) - 1 and not closed(1, ys[below], xs[c], xs[right]) and all((below, k) in free for k in range(c, right)):
            below += 1
        out.append((r, c, below - r, right - c))
        free -= {(a, b) for a in range(r, below) for b in range(c, right)}
    return out


def rule(doc, name, a, b):
    return (doc, 0, name, [a, b], False)


def test_missing_inner_rule_merges_cells(spark):
    pts = [("top", (0, 0), (100, 0)), ("middle", (0, 30), (100, 30)), ("bottom", (0, 60), (100, 60)), ("left", (0, 0), (0, 60)), ("right", (100, 0), (100, 60)), ("part", (50, 30), (50, 60))]
    paths = [rule("a", n, tuple(map(float, p)), tuple(map(float, q))) for n, p, q in pts]
    lines = [("a", 0, 1, 5.0, 5.0, 80.0, 10.0), ("a", 0, 2, 5.0, 40.0, 30.0, 10.0), ("a", 0, 3, 60.0, 40.0, 30.0, 10.0), ("a", 0, 4, 200.0, 200.0, 30.0, 10.0)]
    t = tables.page_tables(spark.createDataFrame(paths, PATHS), spark.createDataFrame(lines, LINES), 600.0, 800.0).first()
    assert (t.columns, t.rows, t.xs, t.ys, t.how) == (2, 2, [0.0, 50.0, 100.0], [0.0, 30.0, 60.0], "ruling_lines")
    assert t.confidence == 0.94 and t.content_confidence == 0.86
    assert [(c.row, c.col, c.row_span, c.col_span, c.header, c.lines) for c in t.cells] == [(0, 0, 1, 2, True, [1]), (1, 0, 1, 1, False, [2]), (1, 1, 1, 1, False, [3])]
    assert {"top", "middle", "left", "right"} <= set(t.cells[0].borders) and "part" not in t.cells[0].borders and "part" in t.cells[1].borders


def test_cells_by_plain_walk(spark):
    rnd = random.Random(3)
    paths, sizes = [], {}
    for n in range(60):
        doc, cols, rows = f"d{n}", rnd.randint(1, 5), rnd.randint(1, 5)
        xs, ys = [20.0 + 60 * k for k in range(cols + 1)], [30.0 + 25 * k for k in range(rows + 1)]
        sizes[doc] = (xs, ys)
        paths.append((doc, 0, "frame", [(xs[0], ys[0]), (xs[-1], ys[0]), (xs[-1], ys[-1]), (xs[0], ys[-1])], True))
        for k, x in enumerate(xs[1:-1]):
            for r in range(rows):
                if rnd.random() < 0.7 or r == 0:
                    paths.append(rule(doc, f"v{k}-{r}", (x + rnd.uniform(-0.4, 0.4), ys[r]), (x, ys[r] + 25 * rnd.choice([1, 1, 0.7]))))
        for k, y in enumerate(ys[1:-1]):
            for c in range(cols):
                if rnd.random() < 0.7 or c == 0:
                    paths.append(rule(doc, f"h{k}-{c}", (xs[c], y), (xs[c + 1], y + rnd.uniform(-0.4, 0.4))))
    got = tables.page_tables(spark.createDataFrame(paths, PATHS), spark.createDataFrame([], LINES), 600.0, 800.0).collect()
    assert len(got) == len(sizes)
    merged = 0
    for t in got:
        own = [p for p in paths if p[0] == t.doc]
        assert (t.columns + 1, t.rows + 1) == (len(sizes[t.doc][0]), len(sizes[t.doc][1]))
        want = walk(own, t.xs, t.ys)
        assert [(c.row, c.col, c.row_span, c.col_span) for c in t.cells] == want, t.doc
        merged += any(c[2] > 1 or c[3] > 1 for c in want)
        covered = [(a, b) for r, c, rs, cs in want for a in range(r, r + rs) for b in range(c, c + cs)]
        assert len(covered) == len(set(covered)) == t.rows * t.columns
    assert merged > 20


def test_aligned_text_is_a_table_only_without_drawing(spark):
    lines = [("a", 0, 10 * r + c, 50.0 + 150 * c + r, 100.0 + 20 * r, 60.0, 10.0) for r in range(4) for c in range(3)]
    lines += [("b", *x[1:]) for x in lines] + [("c", 0, 1, 50.0, 10.0, 60.0, 10.0), ("c", 0, 2, 300.0, 10.0, 60.0, 10.0)]
    paths = [("b", 0, "logo", [(1.0, 1.0), (5.0, 5.0)], False)]
    got = tables.page_tables(spark.createDataFrame(paths, PATHS), spark.createDataFrame(lines, LINES), 600.0, 800.0).collect()
    assert [(t.doc, t.how, t.columns, t.rows, t.confidence, len(t.cells)) for t in got] == [("a", "text_alignment", 3, 3, 0.58, 9)]
    assert got[0].xs[:3] == pytest.approx([51.5, 201.5, 351.5]) and got[0].ys == [105.0, 125.0, 145.0, 165.0]
    assert all(c.row_span == c.col_span == 1 for c in got[0].cells)


def test_too_many_crossings_and_empty(spark):
    grid = [rule("a", f"v{k}", (10.0 + 20 * k, 0.0), (10.0 + 20 * k, 500.0)) for k in range(25)] + [rule("a", f"h{k}", (0.0, 10.0 + 20 * k), (500.0, 10.0 + 20 * k)) for k in range(25)]
    no_lines = spark.createDataFrame([], LINES)
    assert tables.page_tables(spark.createDataFrame(grid, PATHS), no_lines, 600.0, 800.0).count() == 0
    assert tables.page_tables(spark.createDataFrame([], PATHS), no_lines, 600.0, 800.0).count() == 0
    boxes = spark.createDataFrame([("a", 0, "x", 10.0, 10.0, 1.0, 50.0), ("a", 0, "y", 10.0, 10.0, 50.0, 1.0), ("a", 0, "z", 10.0, 10.0, 50.0, 40.0)], "doc string, page int, path string, x double, y double, width double, height double")
    assert [(r.path, r.closed, len(r.points)) for r in tables.box_paths(boxes).orderBy("path").collect()] == [("x", False, 2), ("y", False, 2), ("z", True, 4)]
    assert tables.cells(tables.page_tables(tables.box_paths(boxes), no_lines, 600.0, 800.0)).select(F.sum("width")).first()[0] > 0
