"""Word-processor files: paragraphs with their labels, cells with their spans.

A file is the unit of work: its parts are read together, and rows come out
flat, so that all that follows is joins and windows over them.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tallyloom.operators.layout import alpha, roman

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
ROWS = (
    "path string, seq int, kind string, text string, label string, style string, outline int, num_id string, level int, "
    "table int, row int, col int, row_span int, col_span int, error string"
)
# Number formats by name.
FORMATS = {
    "decimal": str,
    "decimalZero": lambda n: f"{n:02d}",
    "lowerLetter": alpha,
    "upperLetter": lambda n: alpha(n).upper(),
    "lowerRoman": roman,
    "upperRoman": lambda n: roman(n).upper(),
    "none": lambda n: "",
}


def _value(node: ElementTree.Element | None, path: str, name: str = "val") -> str | None:
    found = node.find("/".join(W + p for p in path.split("/"))) if node is not None else None
    return None if found is None else found.get(W + name)


def _number(value: str | None) -> int | None:
    return int(value) if value is not None and re.fullmatch(r"-?\d+", value) else None


class Styles:
    """What styles say, looked up through those they are based on."""

    def __init__(self, root: ElementTree.Element | None) -> None:
        self.by_id = {} if root is None else {s.get(W + "styleId"): s for s in root.iter(W + "style")}
        self.normal = next((k for k, s in self.by_id.items() if s.get(W + "default") == "1" and s.get(W + "type") == "paragraph"), None)

    def chain(self, style: str | None) -> Iterator[ElementTree.Element]:
        seen: set[str] = set()
        while style in self.by_id and style not in seen:
            seen.add(style)
            yield self.by_id[style]
            style = _value(self.by_id[style], "basedOn")

    def first(self, style: str | None, path: str) -> str | None:
        return next((v for s in self.chain(style or self.normal) if (v := _value(s, path)) is not None), None)


class Lists:
    """Numbering definitions: of each list its levels, overrides applied."""

    def __init__(self, root: ElementTree.Element | None) -> None:
        shapes = {} if root is None else {a.get(W + "abstractNumId"): {lv.get(W + "ilvl"): lv for lv in a.findall(W + "lvl")} for a in root.findall(W + "abstractNum")}
        self.levels: dict[tuple[str, int], tuple[str, str, int]] = {}
        for num in root.findall(W + "num") if root is not None else ():
            own = dict(shapes.get(_value(num, "abstractNumId"), {}))
            starts = {}
            for o in num.findall(W + "lvlOverride"):
                level = o.get(W + "ilvl")
                own[level] = o.find(W + "lvl") if o.find(W + "lvl") is not None else own.get(level)
                starts[level] = _number(_value(o, "startOverride"))
            for level, lv in own.items():
                if lv is not None and _number(level) is not None:
                    start = starts.get(level)
                    start = _number(_value(lv, "start")) if start is None else start
                    self.levels[num.get(W + "numId"), int(level)] = (_value(lv, "numFmt") or "decimal", _value(lv, "lvlText") or f"%{int(level) + 1}.", 1 if start is None else start)
        self.counts: dict[str, dict[int, int]] = {}

    def label(self, num: str | None, level: int) -> str | None:
        """The label of the next item: its level counts up, deeper ones begin
        again, and a level not yet counted stands at its start."""
        if num is None or (num, level) not in self.levels:
            return None
        form, template, start = self.levels[num, level]
        counts = {k: v for k, v in self.counts.get(num, {}).items() if k <= level}
        counts[level] = counts[level] + 1 if level in counts else start
        self.counts[num] = counts
        if form == "bullet":
            return template

        def shown(m: re.Match) -> str:
            k = int(m[1]) - 1
            other, _, first = self.levels.get((num, k), (form if k == level else "decimal", "", 1))
            return FORMATS.get(other, str)(counts.setdefault(k, first))

        return re.sub("%([1-9])", shown, template)


def _text(p: ElementTree.Element) -> str:
    """The text of a paragraph without what was deleted and text boxes."""
    out: list[str] = []

    def walk(e: ElementTree.Element) -> None:
        for c in e:
            if c.tag in (W + "del", W + "txbxContent"):
                continue
            if c.tag == W + "t":
                out.append(c.text or "")
            elif c.tag == W + "tab" and e.tag == W + "r":
                out.append("\t")
            elif c.tag in (W + "br", W + "cr"):
                out.append("\n")
            else:
                walk(c)

    walk(p)
    return "".join(out).strip()


class _Reader:
    def __init__(self, parts: dict[str, ElementTree.Element]) -> None:
        self.styles, self.lists = Styles(parts.get("word/styles.xml")), Lists(parts.get("word/numbering.xml"))
        self.rows: list[dict] = []
        self.tables = 0
        self.boxes: list[ElementTree.Element] = []

    def add(self, kind: str, text: str, **more) -> None:
        self.rows.append({"seq": len(self.rows), "kind": kind, "text": text, **more})

    def paragraph(self, p: ElementTree.Element) -> tuple[str, dict]:
        style = _value(p, "pPr/pStyle")
        num = _value(p, "pPr/numPr/numId") or self.styles.first(style, "pPr/numPr/numId")
        level = _number(_value(p, "pPr/numPr/ilvl"))
        level = _number(self.styles.first(style, "pPr/numPr/ilvl")) if level is None else level
        num, level = (None, None) if num in (None, "0") else (num, level or 0)
        outline = _number(_value(p, "pPr/outlineLvl") or self.styles.first(style, "pPr/outlineLvl"))
        self.boxes += p.iter(W + "txbxContent")
        return _text(p), {"label": self.lists.label(num, level) if num else None, "style": style, "outline": outline, "num_id": num, "level": level}

    def body(self, node: ElementTree.Element, kind: str = "paragraph") -> None:
        for e in node:
            if e.tag == W + "p":
                text, facts = self.paragraph(e)
                if text or facts["label"]:
                    self.add(kind, text, **facts)
            elif e.tag == W + "tbl":
                self.table(e)
            elif e.tag in (W + "sdt", W + "sdtContent", W + "ins", W + "customXml"):
                self.body(e, kind)

    def table(self, tbl: ElementTree.Element) -> None:
        """Cells by grid place; one that goes on from above adds to its span."""
        number, self.tables = self.tables, self.tables + 1
        above: dict[int, dict] = {}
        for r, tr in enumerate(tbl.findall(W + "tr")):
            col = _number(_value(tr, "trPr/gridBefore")) or 0
            for tc in tr.findall(W + "tc"):
                width = max(1, _number(_value(tc, "tcPr/gridSpan")) or 1)
                merge = tc.find(f"{W}tcPr/{W}vMerge")
                goes_on = merge is not None and merge.get(W + "val") != "restart"
                if goes_on and col in above and above[col]["row"] + above[col]["row_span"] == r:
                    above[col]["row_span"] += 1
                else:
                    texts = []
                    for p in tc.findall(W + "p"):
                        text, facts = self.paragraph(p)
                        texts.append(f"{facts['label']} {text}".strip() if facts["label"] else text)
                    self.add("cell", "\n".join(t for t in texts if t), table=number, row=r, col=col, row_span=1, col_span=width)
                    above[col] = self.rows[-1]
                    for nested in tc.findall(W + "tbl"):
                        self.table(nested)
                col += width


def docx_rows(content: bytes) -> list[dict]:
    """Rows of one file in order; text boxes come last."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        parts = {n: ElementTree.fromstring(z.read(n)) for n in ("word/document.xml", "word/styles.xml", "word/numbering.xml") if n in names}
    reader = _Reader(parts)
    body = parts["word/document.xml"].find(W + "body")
    if body is not None:
        reader.body(body)
    for box in reader.boxes:
        reader.body(box, "box")
    return reader.rows


def docx_documents(spark: SparkSession, path: str) -> DataFrame:
    """Paragraphs, cells and text boxes of the files below ``path``; a file
    that can't be read gives one row with an error."""

    kinds = {"string": pa.string(), "int": pa.int32()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in ROWS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                try:
                    rows = docx_rows(content.as_py())
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError) as e:
                    rows = [{"error": f"{type(e).__name__}: {e}"}]
                yield pa.RecordBatch.from_pylist([{"path": name.as_py(), **r} for r in rows], schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, ROWS)
