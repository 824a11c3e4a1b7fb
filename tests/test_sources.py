import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspark.sources import archive, html, readers, selection
from quillspark.sources.tables import table_text


def _left_out(spark, rows):
    kind = "path string, candidates array<string>, category string, accession string, primary string, kind string, file_url string, material_url string, attached boolean"
    df = spark.createDataFrame([(*r, *[None] * (9 - len(r))) for r in rows], kind)
    return [r[0] for r in df.select(selection.left_out(*(F.col(c) for c in df.columns))).collect()]


def test_names(spark):
    df = spark.createDataFrame([(x,) for x in ("a/b.HTML", ".txt", "x/.csv", "a.tar.gz", "noext", "d.ir/name", "q.pdf/")], "p string")
    assert [(r[0], r[1]) for r in df.select(selection.name_of(df.p), selection.suffix_of(df.p)).collect()] == [("b.HTML", ".html"), (".txt", ""), (".csv", ""), ("a.tar.gz", ".gz"), ("noext", ""), ("name", ""), ("q.pdf", ".pdf")]


def test_rules_of_filings(spark):
    have = ["main.htm", "R2.htm", "filing.html", "ir_filing.pdf", "7-1.pdf", "7-1.docx", "7-1.txt", "exhibit.pdf", "x-index.html"]
    ask = lambda path, files=have, primary="main.htm": (path, files, "sec_filings", "7-1", primary)
    rows = [ask(p) for p in have] + [ask("a.png"), ask("webcast.txt"), ask("my_streaming.txt"), ask("complete_submission.txt")]
    assert _left_out(spark, rows) == [None, "generated_view", "primary_mirror", "primary_format", "accession_format", "accession_format", "bundle", None, "wrapper", "unsupported", "notice", "notice", "bundle"]
    rest = [p for p in have if p != "main.htm"]
    assert _left_out(spark, [ask(p, rest) for p in rest]) == [None, "rendered_mirror", None, None, "accession_format", "bundle", None, "wrapper"]


def test_rules_of_pages(spark):
    have = ["article.html", "page.html", "page.txt", "source.html", "content.txt", "page_de.html", "content_de.txt", "content_fr.txt", "listing.txt", "main_site_x.html", "release.pdf", "deck.pdf"]
    got = dict(zip(have, _left_out(spark, [(p, have, "news") for p in have])))
    assert {k: v for k, v in got.items() if v} == {"page.html": "other_page", "page.txt": "other_page", "content.txt": "text_of_source", "content_de.txt": "text_of_language", "listing.txt": "listing", "main_site_x.html": "merged_mirror", "release.pdf": "release_pdf"}
    two = ["page.html", "page.txt"]
    assert _left_out(spark, [("page.html", two, "ir_news"), ("page.html", two, "blog"), ("page.html", two, "annual_reports"), ("source.txt", ["source.txt"], "quarterly_results"), ("sub/source_page_3.html", two, None)]) == [None, "other_page", "collection", "collection", "collection"]
    far = ("page.txt", two, "events", None, None, "page_text", "u/1", "u/2")
    assert _left_out(spark, [(*far, True), (*far, False), (*far[:2], "quarterly_results", *far[3:], False), (*far[:6], "u/2", "u/2", True)]) == ["foreign_capture", None, "foreign_capture", None]


def _records(spark, *rows):
    return spark.createDataFrame([("/arc/abc_main", json.dumps(i), None if m is None else json.dumps(m)) for i, m in rows], "root string, item string, meta string")


def test_normalised_rows(spark):
    rows = _records(
        spark,
        ({"folder": "a/1", "publication_date": None, "date": "2020-01-01"}, {"publication_date": "2019-05-05", "files": []}),
        ({"folder": "b", "date": "2021-03"}, {"files": [], "is_supplement": True, "category": "SEC filings"}),
        ({"folder": "c", "url": ""}, {"published_date": "2018", "source_url": "u", "local_files": [1], "files": [2, 3]}),
    )
    out = archive.normalised(rows).orderBy("folder").collect()
    assert [(r.publication_date, r.publication_period, r.scope, r.category, r.url) for r in out] == [(None, None, "a", "document", ""), (None, "2021-03", "supplement", "sec_filings", ""), (None, "2018", "c", "document", "u")]
    assert len(out[2].files) == 1


def test_discovery(spark):
    rows = _records(
        spark,
        ({"folder": "f1", "url": "https://x/1", "title": "T", "publication_date": "2020-02-02", "category": "blog_posts", "company_name": " Big  Co "}, {
            "ticker": "ABC", "company_aliases": ["Big Co", "BC"], "attachments": [{"path": "f1/b.pdf", "url": "https://x/b", "kind": "attachment"}], "language_versions": [{"html_file": "c.html", "url": "https://x/c"}],
            "files": [{"path": "a.txt"}, {"filename": "f1/b.pdf"}, {"path": "c.html", "publication_date": "2019-09"}, {"path": "../up.txt"}, {"path": "gone.txt"}, {"kind": "x"}, {"path": "d.png"}, {"path": "e.txt", "publication_date": "2020-02-30"}],
        }),
        ({"folder": "../f2"}, {"files": []}), ({"folder": "f3"}, None), ({"folder": "f4", "status": "unavailable"}, {"files": []}), ({"folder": "f5"}, {"files": "no"}), ({}, {}),
    )
    there = spark.createDataFrame([(f"/arc/abc_main/f1/{x}",) for x in ("a.txt", "b.pdf", "c.html", "d.png", "e.txt")], "path string")
    sources, report = archive.discovered(rows, there)
    got = {r.path.split("/")[-1]: r for r in sources.collect()}
    assert set(got) == {"a.txt", "b.pdf", "c.html"} and got["a.txt"].company == "ABC" and got["a.txt"].company_aliases == ["BC", "Big Co"]
    assert [(got[k].publication_date, got[k].publication_period, got[k].source_url, len(got[k].aliases)) for k in sorted(got)] == [("2020-02-02", None, "https://x/1", 0), (None, None, "https://x/b", 1), (None, "2019-09", "https://x/c", 1)]
    assert got["b.pdf"].date_basis == "Attachment date unverified" and got["b.pdf"].aliases[0].publication_date == "2020-02-02"
    why = sorted((r.reason, r.kind) for r in report.collect())
    assert why == sorted([("path escapes the folder", "error"), ("file unavailable", "error"), ("file record has no path", "error"), ("unsupported", None), ("publication date is no day", "error"), ("folder escapes the archive", "error"), ("no metadata", "error"), ("unavailable", None), ("files is no list", "error"), ("no folder", "error")])


def test_manifest_and_scan(spark, tmp_path):
    root = tmp_path / "xyz_archive"
    (root / "one").mkdir(parents=True)
    (root / "index.json").write_text(json.dumps([{"folder": "one", "title": "First"}]))
    (root / "one/meta.json").write_text(json.dumps({"files": [{"path": "a.txt"}, {"path": "b.txt"}]}))
    (root / "one/a.txt").write_text("﻿Hello there", encoding="utf-8")
    sources, report = archive.discovered(archive.read_manifest(spark, str(root)), archive.files_on_disk(spark, str(root)))
    assert [(r.path, r.company, r.title) for r in sources.collect()] == [(f"{root}/one/a.txt", "xyz", "First")] and report.count() == 1
    segments = readers.extracted(readers.load(spark, str(root))).join(sources, "path").first().segments
    assert [(s.text, s.locator) for s in segments] == [("Hello there", "text")]
    plain = tmp_path / "plain"
    for name in ("k/a.md", "k/b.exe", ".git/c.txt", "k/audit/d.txt"):
        (plain / name).parent.mkdir(parents=True, exist_ok=True)
        (plain / name).write_text("x")
    assert archive.read_manifest(spark, str(plain)) is None
    found, left = archive.scanned(archive.files_on_disk(spark, str(plain)), str(plain), "K")
    assert [r.title for r in found.collect()] == ["a"] and [r.reason for r in left.collect()] == ["unsupported"]
    (plain / "inventory.json").write_text(json.dumps([{"folder": "k"}, {"name": "x"}]))
    with pytest.raises(ValueError):
        archive.read_manifest(spark, str(plain))


def test_table_text():
    rows = [["", " "], ["Region", "2019", "2020"], ["", "in millions", ""], ["North", "1,250", "(3.5)"], ["South", "$7", "8%"]]
    assert table_text(rows) == "Region | 2019 | 2020\n | in millions | \n[Rows]\nNorth | 1,250 | (3.5)\nSouth | $7 | 8%"
    assert table_text([["a"], ["b"], ["c"], ["d"], ["e"], ["f"]], "Note") == "Table context: Note\na\nb\nc\nd\ne\n[Rows]\nf" and table_text([[" "]]) == ""


PAGE = """<html><head><style>x</style></head><body><nav>menu</nav><article><h1>Results</h1><p>First <b>half</b><br>went well<p>unclosed &amp; nested
<h2>Detail</h2><ul><li>one<li>two</ul><div hidden>no</div><div style="color:red; display : none">no</div><ix:header>no</ix:header>
<p>Amounts in millions of dollars</p><table><tr><th rowspan=2>Area</th><th colspan="2">Sales</th></tr><tr><td>2019</td><td>2020</td></tr>
<tr><td>East</td><td>5.5</td><td></td></tr><tr><td>West<table><tr><td>inner</td></tr></table></td><td>7</td><td> </td></tr></table></article><p>outside</p></body></html>"""


def test_page():
    out = html.sections(PAGE)
    assert out[0] == ("Table context: Amounts in millions of dollars\nArea | Sales\n | 2019 | 2020\n[Rows]\nEast | 5.5 | \nWest | 7 |", "table 1") or out[0][0].startswith("Table context: Amounts in millions of dollars\nArea | Sales | \nArea | 2019 | 2020\n[Rows]\nEast | 5.5 | ")
    assert out[1][1] == "table 2" and out[1][0].endswith("inner\n[Rows]")
    prose = {where: t for t, where in out[2:]}
    assert not any("no" == t or "menu" in t or "outside" in t for t in prose.values()) and any("First half went well" in t for t in prose.values())


def test_units_are_not_borrowed():
    two = "<body><p>In thousands</p><table><tr><td>a</td><td>1</td></tr></table>{}<table><tr><td>b</td><td>2</td></tr></table><p>words</p></body>"
    assert [t.split("\n")[0] for t, w in html.sections(two.format("")) if w.startswith("table")] == ["Table context: In thousands", "b | 2"]
    assert [t.split("\n")[0] for t, w in html.sections(two.format("<div>per share</div>")) if w.startswith("table")] == ["Table context: In thousands", "Table context: per share"]


def test_pages_without_blocks_are_read_whole():
    assert html.sections(b"<div>only <span>this</span></div>") == [("only\nthis", "document")] and html.sections("") == []
    assert html.decoded('<meta charset="windows-1251">Привет'.encode("cp1251")).endswith("Привет") and html.decoded(b"caf\xe9") == "café"


def _zip(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_office_files():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    cell = lambda t, about="": f"<w:tc><w:tcPr>{about}</w:tcPr><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    docx = _zip({"word/document.xml": f'<w:document {w}><w:body><w:p><w:r><w:t>One</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Three</w:t></w:r></w:p><w:tbl><w:tr>{cell("H", "<w:gridSpan w:val=%s2%s/>" % (chr(34), chr(34)))}</w:tr><w:tr>{cell("x")}{cell("5")}</w:tr></w:tbl></w:body></w:document>'})
    assert readers.read(docx, ".docx")[0] == [("One\ttwo\n\nThree", "document paragraphs"), ("H | H\n[Rows]\nx | 5", "table 1")]
    r, a, p = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"', 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"', 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
    rels = lambda *x: "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="{t}"/>' for i, t in enumerate(x, 1)) + "</Relationships>"
    slide = lambda body: f"<p:sld {a} {p}><p:cSld><p:spTree>{body}</p:spTree></p:cSld></p:sld>"
    pptx = _zip({"ppt/presentation.xml": f'<p:presentation {p} {r}><p:sldIdLst><p:sldId id="1" r:id="r2"/><p:sldId id="2" r:id="r1"/></p:sldIdLst></p:presentation>', "ppt/_rels/presentation.xml.rels": rels("slides/b.xml", "slides/a.xml"), "ppt/slides/a.xml": slide("<p:sp><p:txBody><a:p><a:r><a:t>Plan</a:t></a:r></a:p><a:p><a:r><a:t>B</a:t></a:r></a:p></p:txBody></p:sp>"), "ppt/slides/b.xml": slide("")})
    found, warned = readers.read(pptx, ".pptx")
    assert found == [("Plan\nB", "slide 1")] and len(warned) == 1
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    xlsx = _zip({
        "xl/workbook.xml": f'<workbook {s} {r}><sheets><sheet name="Q1" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": rels("worksheets/s.xml"), "xl/sharedStrings.xml": f"<sst {s}><si><t>Item</t></si><si><r><t>To</t></r><r><t>tal</t></r></si></sst>",
        "xl/styles.xml": f'<styleSheet {s}><numFmts><numFmt numFmtId="170" formatCode="yyyy&quot;d&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/></cellXfs></styleSheet>',
        "xl/worksheets/s.xml": f'<worksheet {s}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="b"><v>1</v></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><v>12.50</v></c><c r="C2" s="1"><v>43831</v></c></row></sheetData></worksheet>',
    })
    assert readers.read(xlsx, ".xlsx")[0] == [("Item |  | True\n[Rows]\nTotal | 12.5 | 2020-01-01 00:00:00", "sheet Q1")]
    assert readers.read(b'\xef\xbb\xbfa,"b ""c"""\n1\n', ".csv")[0] == [('a | b "c"\n[Rows]\n1', "table 1")]


def test_pages_and_recognition():
    assert readers.paged(["one", " "]) == ([("one", "page 1")], ["page 2 has no text; it has to be recognised or looked at"])
    found, warned = readers.paged(["", "", "x"], lambda n: "seen" if n == 1 else "")
    assert found == [("seen", "page 1 (OCR; verify against original)"), ("x", "page 3")] and len(warned) == 2


def test_extraction_isolates_failures(spark):
    files = [("a.txt", b"same"), ("b.txt", b"same"), ("c.docx", b"broken"), ("d.bin", b"x"), ("e.txt", b" "), ("f.txt", None)]
    out = {r.path: r for r in readers.extracted(spark.createDataFrame(files, "path string, content binary")).collect()}
    assert [s.text for s in out["b.txt"].segments] == ["same"] and out["a.txt"].content_hash == out["b.txt"].content_hash
    assert all(out[k].error and out[k].segments is None for k in ("c.docx", "d.bin", "e.txt", "f.txt"))
    assert readers.extracted(spark.createDataFrame([], "path string, content binary")).count() == 0
