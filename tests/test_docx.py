"""Word-processor files written here, read back with labels and spans."""

import io
import zipfile

from tallyloom.sources import docx

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def level(n, form, text, start=1):
    return f'<w:lvl w:ilvl="{n}"><w:start w:val="{start}"/><w:numFmt w:val="{form}"/><w:lvlText w:val="{text}"/></w:lvl>'


NUMBERING = f"""<w:numbering {NS}>
<w:abstractNum w:abstractNumId="0">{level(0, "decimal", "%1.")}{level(1, "lowerLetter", "%1.%2)")}{level(2, "lowerRoman", "(%3)")}</w:abstractNum>
<w:abstractNum w:abstractNumId="1">{level(0, "bullet", "•")}</w:abstractNum>
<w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num>
<w:num w:numId="2"><w:abstractNumId w:val="0"/><w:lvlOverride w:ilvl="0"><w:startOverride w:val="5"/></w:lvlOverride><w:lvlOverride w:ilvl="1">{level(1, "upperRoman", "[%1/%2]", 4)}</w:lvlOverride></w:num>
<w:num w:numId="3"><w:abstractNumId w:val="1"/></w:num></w:numbering>"""
STYLES = f"""<w:styles {NS}><w:style w:type="paragraph" w:default="1" w:styleId="Normal"/>
<w:style w:type="paragraph" w:styleId="Base"><w:pPr><w:outlineLvl w:val="1"/><w:numPr><w:numId w:val="1"/><w:ilvl w:val="1"/></w:numPr></w:pPr></w:style>
<w:style w:type="paragraph" w:styleId="Child"><w:basedOn w:val="Base"/></w:style>
<w:style w:type="paragraph" w:styleId="Ring"><w:basedOn w:val="Ring"/></w:style></w:styles>"""


def para(text, num=None, ilvl=None, style=None):
    numbered = f'<w:numPr><w:ilvl w:val="{ilvl or 0}"/><w:numId w:val="{num}"/></w:numPr>' if num is not None else ""
    named = f'<w:pStyle w:val="{style}"/>' if style else ""
    return f"<w:p><w:pPr>{named}{numbered}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"


def cell(text, span=1, merge=None):
    m = "" if merge is None else '<w:vMerge w:val="restart"/>' if merge else "<w:vMerge/>"
    return f'<w:tc><w:tcPr><w:gridSpan w:val="{span}"/>{m}</w:tcPr>{para(text)}</w:tc>'


def file(body, numbering=NUMBERING, styles=STYLES):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{body}</w:body></w:document>")
        if numbering:
            z.writestr("word/numbering.xml", numbering)
        if styles:
            z.writestr("word/styles.xml", styles)
    return out.getvalue()


def labels(body):
    return [r["label"] for r in docx.docx_rows(file(body))]


def test_levels_restart_and_templates():
    body = para("a", 1) + para("b", 1, 1) + para("c", 1, 1) + para("d", 1, 2) + para("e", 1) + para("f", 1, 1) + para("g", 3) + para("h", 1)
    assert labels(body) == ["1.", "1.a)", "1.b)", "(i)", "2.", "2.a)", "•", "3."]


def test_overrides_and_levels_not_yet_counted():
    assert labels(para("a", 2) + para("b", 2, 1) + para("c", 2, 1) + para("d", 2)) == ["5.", "[5/IV]", "[5/V]", "6."]
    assert labels(para("a", 1, 1) + para("b", 1)) == ["1.a)", "2."]
    assert labels(para("a", 9) + para("b", 0) + para("c", 1, 7)) == [None, None, None]


def test_style_inheritance():
    rows = docx.docx_rows(file(para("a", style="Child") + para("b", 1, 0, style="Child") + para("c", style="Ring") + para("d", 0, style="Child")))
    assert [(r["label"], r["outline"], r["num_id"]) for r in rows] == [("1.a)", 1, "1"), ("2.", 1, "1"), (None, None, None), (None, 1, None)]


def test_merged_cells():
    table = "<w:tbl><w:tr>" + cell("A", 2) + cell("B", 1, True) + "</w:tr><w:tr>" + cell("C") + cell("D") + cell("", 1, False) + "</w:tr><w:tr><w:trPr><w:gridBefore w:val='1'/></w:trPr>" + cell("E") + cell("", 1, False) + "</w:tr></w:tbl>"
    rows = docx.docx_rows(file(para("before") + table + para("after")))
    assert [(r["text"], r.get("row"), r.get("col"), r.get("row_span"), r.get("col_span")) for r in rows] == [
        ("before", None, None, None, None), ("A", 0, 0, 1, 2), ("B", 0, 2, 3, 1), ("C", 1, 0, 1, 1), ("D", 1, 1, 1, 1), ("E", 2, 1, 1, 1), ("after", None, None, None, None),
    ]


def test_text_boxes_deletions_and_controls():
    box = '<w:p><w:r><w:t>Anchor</w:t><w:pict><w:txbxContent>' + para("In the box") + "</w:txbxContent></w:pict></w:r></w:p>"
    body = box + "<w:p><w:r><w:t>kept</w:t><w:tab/><w:t>x</w:t><w:br/><w:t>y</w:t></w:r><w:del><w:r><w:delText>gone</w:delText><w:t>gone</w:t></w:r></w:del></w:p><w:sdt><w:sdtContent>" + para("in a control") + "</w:sdtContent></w:sdt>"
    assert [(r["kind"], r["text"]) for r in docx.docx_rows(file(body, None, None))] == [("paragraph", "Anchor"), ("paragraph", "kept\tx\ny"), ("paragraph", "in a control"), ("box", "In the box")]


def test_files(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(file(para("one", 1) + para("two", 1)))
    (tmp_path / "b.docx").write_bytes(b"no archive")
    got = docx.docx_documents(spark, str(tmp_path)).orderBy("path", "seq").collect()
    assert [(r.path[-6:], r.seq, r.label, r.text) for r in got if r.error is None] == [("a.docx", 0, "1.", "one"), ("a.docx", 1, "2.", "two")]
    assert [r.path[-6:] for r in got if r.error] == ["b.docx"]
