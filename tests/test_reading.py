"""Regions and the graph of their order, on written and on random pages."""

import random

from tallyloom.operators import layout, reading

LINES = "doc string, page int, line int, text string, x double, y double, width double, height double"


def order_of(spark, rows):
    found = reading.regions(spark.createDataFrame(rows, LINES), 600.0, 800.0).cache()
    return found.orderBy("doc", "region").collect(), reading.order_edges(found).collect()


def test_heading_columns_and_source_order(spark):
    rows = [("d", 0, 1, "HEADING", 40.0, 20.0, 520.0, 12.0)]
    rows += [("d", 0, n, f"left {n}", 50.0, y, 220.0, 12.0) for n, y in ((2, 60.0), (4, 75.0), (6, 110.0))]
    rows += [("d", 0, n, f"right {n}", 330.0, y, 220.0, 12.0) for n, y in ((3, 60.0), (5, 75.0), (7, 90.0))]
    rows += [("d", 0, 8, "FOOT OF BOTH", 40.0, 300.0, 520.0, 12.0)]
    regions, edges = order_of(spark, rows)
    assert [(r.section, r.column, r.lines, r.kind) for r in regions] == [(0, None, [1], "title"), (1, 0, [2, 4], "text"), (1, 0, [6], "text"), (1, 1, [3, 5, 7], "text"), (2, None, [8], "title")]
    assert {(e.before, e.after, e.relation) for e in edges} == {(1, 2, "same_column_above"), (2, 3, "column_transition")}
    assert [r.alternative for r in regions] == [0, 1, 3, 2, 4] and regions[0].columns == 2
    assert 0.55 <= regions[0].confidence <= 1.0


def test_one_column_page(spark):
    """Without gutters there is one section; a wide line stands before its column."""
    rows = [("d", 0, 1, "Over all", 40.0, 20.0, 520.0, 12.0), ("d", 0, 2, "a", 50.0, 60.0, 200.0, 12.0), ("d", 0, 3, "b", 50.0, 90.0, 200.0, 12.0)]
    regions, edges = order_of(spark, rows)
    assert [(r.column, r.lines) for r in regions] == [(None, [1]), (0, [2]), (0, [3])] and regions[0].confidence == 1.0
    assert {(e.before, e.after, e.relation) for e in edges} == {(1, 2, "same_column_above"), (0, 1, "full_width_heading_to_column")}


def plain_regions(rows):
    """The same by loops over one page: [(section, column, lines)] in order."""
    boxes = lambda ls: [x[4:8] for x in ls]
    wide = lambda b: b[2] >= 432 or (b[0] <= 48 and b[0] + b[2] >= 552)
    rows = sorted(rows, key=lambda r: (r[5], r[4], r[2]))
    sections = [[]]
    cut = bool(layout.gutters_of_page(boxes(rows), 600.0))
    for r in rows:
        if cut and wide(r[4:8]):
            sections += [[r], []]
        else:
            sections[-1].append(r)
    out, columns = [], 1
    for n, ls in enumerate([s for s in sections if s]):
        gaps = layout.gutters_of_page(boxes(ls), 600.0)
        columns = max(columns, len(gaps) + 1)
        by = {}
        for r in ls:
            x, w = r[4], r[6]
            by.setdefault(None if wide(r[4:8]) else sum(x + w / 2 > b or (x + w / 2 >= a and x >= a) for a, b in gaps), []).append(r)
        for c, members in by.items():
            part = []
            for r in members:
                if part and r[5] - part[-1][5] - part[-1][7] > (14 if c is None else 10):
                    out.append((n, c, part))
                    part = []
                part.append(r)
            out.append((n, c, part))

    def key(region):
        n, c, ls = region
        y = min(r[5] for r in ls)
        band = sum(1 for m, d, other in out if m == n and d is None and min(r[5] for r in other) <= y)
        return (n, band, c is not None, c or 0, y) if columns > 1 else (n, y, min(r[4] for r in ls))

    return [(n, c, [r[2] for r in ls]) for n, c, ls in sorted(out, key=key)]


def test_random_pages_by_loops(spark):
    rnd = random.Random(5)
    rows, pages = [], {}
    for p in range(40):
        y, page, line = 20.0, [], 0
        for _ in range(rnd.randint(3, 14)):
            kind = rnd.choice(["wide", "both", "both", "both", "left"])
            for side in {"wide": [None], "both": [0, 1], "left": [0]}[kind]:
                x, w = (40.0, 520.0) if side is None else (50.0 + 300 * side, rnd.uniform(150, 220))
                page.append((f"p{p}", 0, line, f"text {line}", x + line * 1e-6, y, w, 11.0))
                line += 1
            y += rnd.choice([14.0, 14.0, 40.0])
        pages[f"p{p}"] = page
        rows += page
    regions, edges = order_of(spark, rows)
    for doc, page in pages.items():
        got = [(r.section, r.column, r.lines) for r in regions if r.doc == doc]
        assert got == plain_regions(page), doc
    last = {}
    for r in regions:
        last[r.doc] = max(last.get(r.doc, 0), r.region)
    assert all(0 <= e.before < e.after <= last[e.doc] for e in edges)  # forward: the order is topological
    assert {e.relation for e in edges} >= {"same_column_above", "column_transition"}
    assert reading.regions(spark.createDataFrame([], LINES), 600.0, 800.0).count() == 0
