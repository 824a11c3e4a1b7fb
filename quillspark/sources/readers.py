"""Reading files into segments (text, locator) with the standard library; formats that need more are plugged in."""

from __future__ import annotations

import csv
import io
import posixpath
import re
import shutil
import subprocess
import zipfile
from collections.abc import Callable
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.chunking import clean_text
from quillspark.sources import html
from quillspark.sources.tables import table_text

Segments = list[tuple[str, str]]
#: A reader takes a file's bytes and gives its segments and warnings.
Reader = Callable[[bytes], tuple[Segments, list[str]]]

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
# Numbers of built-in formats of spreadsheets that show dates or times.
DATE_FORMATS = {*range(14, 23), *range(45, 48)}


def plain(raw: bytes) -> tuple[Segments, list[str]]:
    return [(raw.decode("utf-8-sig", "replace"), "text")], []


def page(raw: bytes) -> tuple[Segments, list[str]]:
    return html.sections(raw), []


def comma_separated(raw: bytes) -> tuple[Segments, list[str]]:
    rows = list(csv.reader(io.StringIO(raw.decode("utf-8-sig"), newline="")))
    return [(table_text(rows), "table 1")], []


def _part(book: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    return ElementTree.fromstring(book.read(name)) if name in book.namelist() else None


def _targets(book: zipfile.ZipFile, part: str) -> dict[str, str]:
    """The parts that a part refers to, by the ids it uses for them."""
    folder, name = posixpath.split(part)
    found = _part(book, f"{folder}/_rels/{name}.rels")
    return {r.get("Id"): posixpath.normpath(posixpath.join(folder, r.get("Target"))).lstrip("/") for r in (found if found is not None else ())}


def _words(paragraph: ElementTree.Element, ns: str) -> str:
    marks = {ns + "t": None, ns + "tab": "\t", ns + "br": "\n", ns + "cr": "\n", ns + "noBreakHyphen": "-"}
    return "".join((x.text or "") if marks[x.tag] is None else marks[x.tag] for x in paragraph.iter() if x.tag in marks)


def document(raw: bytes) -> tuple[Segments, list[str]]:
    """Paragraphs of a DOCX body, and its tables; merged cells show their text in each place they cover."""
    with zipfile.ZipFile(io.BytesIO(raw)) as book:
        body = _part(book, "word/document.xml").find(_W + "body")
    texts = [t for p in body.findall(_W + "p") if (t := _words(p, _W)).strip()]
    out = [("\n\n".join(texts), "document paragraphs")] if texts else []
    for number, table in enumerate(body.findall(_W + "tbl"), 1):
        rows: list[list[str]] = []
        for tr in table.findall(_W + "tr"):
            row: list[str] = []
            for tc in tr.findall(_W + "tc"):
                about = tc.find(_W + "tcPr")
                span = about.find(_W + "gridSpan") if about is not None else None
                merged = about.find(_W + "vMerge") if about is not None else None
                text = "\n".join(_words(p, _W) for p in tc.findall(_W + "p"))
                if merged is not None and merged.get(_W + "val", "continue") == "continue" and rows and len(row) < len(rows[-1]):
                    text = rows[-1][len(row)]
                row += [text] * int(span.get(_W + "val", 1) if span is not None else 1)
            rows.append(row)
        out.append((table_text(rows), f"table {number}"))
    return out, []


def slides(raw: bytes) -> tuple[Segments, list[str]]:
    """Text frames and tables of each PPTX slide; one without any is warned of."""
    out, warned = [], []
    with zipfile.ZipFile(io.BytesIO(raw)) as book:
        targets = _targets(book, "ppt/presentation.xml")
        order = _part(book, "ppt/presentation.xml").iter(_P + "sldId")
        for number, slide in enumerate((_part(book, targets[s.get(_R + "id")]) for s in order), 1):
            texts = []
            for shape in slide.find(f"{_P}cSld/{_P}spTree"):
                if (frame := shape.find(_P + "txBody")) is not None:
                    texts.append("\n".join(_words(p, _A) for p in frame.findall(_A + "p")))
                texts += [table_text([["\n".join(_words(p, _A) for p in c.iter(_A + "p")) for c in tr.findall(_A + "tc")] for tr in t.findall(_A + "tr")]) for t in shape.iter(_A + "tbl")]
            if texts:
                out.append(("\n\n".join(texts), f"slide {number}"))
            else:
                warned.append(f"slide {number} has no text that can be read; look at its pictures")
    return out, warned


def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n


def _is_date(code: str) -> bool:
    return bool(re.search(r"[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.|_.', "", code.lower())))


def _number(text: str, as_date: bool) -> str:
    value = float(text)
    if as_date:
        day = datetime(1899, 12, 30) + timedelta(days=value)
        return str(day.replace(microsecond=0)) if value >= 1 else str((day + timedelta(microseconds=500_000)).time().replace(microsecond=0))
    return text if re.fullmatch(r"-?\d+", text) else str(value)


def sheets(raw: bytes) -> tuple[Segments, list[str]]:
    """Cached values of each XLSX sheet."""
    out = []
    with zipfile.ZipFile(io.BytesIO(raw)) as book:
        shared = _part(book, "xl/sharedStrings.xml")
        texts = ["".join(t.text or "" for r in ([si] + si.findall(_S + "r")) for t in r.findall(_S + "t")) for si in (shared if shared is not None else ())]
        style = _part(book, "xl/styles.xml")
        own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in style.iter(_S + "numFmt")} if style is not None else {}
        kinds = [int(x.get("numFmtId", 0)) for x in style.find(_S + "cellXfs")] if style is not None and style.find(_S + "cellXfs") is not None else []
        dated = [k in DATE_FORMATS or _is_date(own.get(k, "")) for k in kinds]
        targets = _targets(book, "xl/workbook.xml")
        for sheet in _part(book, "xl/workbook.xml").iter(_S + "sheet"):
            rows: list[dict[int, str]] = []
            for row in _part(book, targets[sheet.get(_R + "id")]).iter(_S + "row"):
                cells: dict[int, str] = {}
                for c in row.findall(_S + "c"):
                    col = _column(c.get("r", "")) or max(cells, default=0) + 1
                    kind, v = c.get("t", "n"), c.find(_S + "v")
                    if kind == "inlineStr":
                        cells[col] = "".join(t.text or "" for t in c.iter(_S + "t"))
                    elif v is not None and v.text is not None:
                        s = int(c.get("s", 0))
                        cells[col] = texts[int(v.text)] if kind == "s" else str(v.text == "1") if kind == "b" else _number(v.text, s < len(dated) and dated[s]) if kind == "n" else v.text
                rows.append(cells)
            width = max((max(r, default=0) for r in rows), default=0)
            out.append((table_text([[r.get(i, "") for i in range(1, width + 1)] for r in rows]), f"sheet {sheet.get('name')}"))
    return out, []


def paged(pages: list[str], ocr: Callable[[int], str] | None = None) -> tuple[Segments, list[str]]:
    """Segments of a document's pages. Blank pages are read by ocr, if there is one, and warned of in any case."""
    out, warned = [], []
    for n, text in enumerate(pages, 1):
        if text.strip():
            out.append((text, f"page {n}"))
            continue
        if ocr is None:
            warned.append(f"page {n} has no text; it has to be recognised or looked at")
            continue
        try:
            read = ocr(n)
        except (OSError, ValueError, subprocess.SubprocessError) as e:
            warned.append(f"page {n} was not recognised: {e}")
            continue
        if read.strip():
            out.append((read, f"page {n} (OCR; verify against original)"))
        warned.append(f"page {n} was recognised; compare it with the original" if read.strip() else f"page {n} gave no text when recognised")
    return out, warned


def portable(raw: bytes) -> tuple[Segments, list[str]]:
    """Pages of a PDF by ``pdftotext`` where it is installed, else by pypdf."""
    if shutil.which("pdftotext"):
        done = subprocess.run(["pdftotext", "-layout", "-enc", "UTF-8", "-", "-"], input=raw, capture_output=True, timeout=120)
        if done.returncode:
            raise ValueError(f"pdftotext: {done.stderr[:200].decode('utf-8', 'replace')}")
        pages = done.stdout.decode("utf-8", "replace").split("\f")
        return paged(pages[:-1] if pages and not pages[-1].strip() else pages)
    try:
        from pypdf import PdfReader
    except ImportError:
        raise ValueError("no PDF reader is installed: plug one in") from None
    return paged([p.extract_text(extraction_mode="layout") or "" for p in PdfReader(io.BytesIO(raw)).pages])


def old_sheets(raw: bytes) -> tuple[Segments, list[str]]:
    try:
        import xlrd
    except ImportError:
        raise ValueError("no XLS reader is installed: plug one in") from None
    return [(table_text([[str(c.value) for c in s.row(i)] for i in range(s.nrows)]), f"sheet {s.name}") for s in xlrd.open_workbook(file_contents=raw).sheets()], []


READERS: dict[str, Reader] = {
    ".html": page, ".htm": page, ".txt": plain, ".md": plain, ".csv": comma_separated, ".docx": document, ".pptx": slides, ".xlsx": sheets, ".xls": old_sheets, ".pdf": portable,
}

SCHEMA = "array<struct<text:string,locator:string>>"


def read(raw: bytes, suffix: str, readers: dict[str, Reader] = READERS) -> tuple[Segments, list[str]]:
    """Cleaned segments of a file, blank ones dropped. A file without any is an error."""
    if suffix not in readers:
        raise ValueError(f"unsupported format: {suffix}")
    found, warned = readers[suffix](raw)
    out = [(t, where) for text, where in found if (t := clean_text(text))]
    if not out:
        raise ValueError("no text can be read; scanned pages have to be recognised")
    return out, warned


def extracted(files: DataFrame, readers: dict[str, Reader] | None = None) -> DataFrame:
    """(path, segments, warnings, error) of files (path, content). One that can't be read has an error and no segments, and stops nothing.

    Files of the same bytes and format are read once.
    """
    own = readers or READERS

    def run(batches):
        for pdf in batches:
            rows = []
            for key, suffix, content in zip(pdf.key, pdf.suffix, pdf.content):
                try:
                    found, warned = read(bytes(content), suffix, own)
                    rows.append((key, suffix, [{"text": t, "locator": where} for t, where in found], warned, None))
                except Exception as e:  # whatever a broken file makes a parser do
                    rows.append((key, suffix, None, [], f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(rows, columns=["key", "suffix", "segments", "warnings", "error"])

    from quillspark.sources.selection import suffix_of

    rows = files.select("path", suffix_of(F.col("path")).alias("suffix"), F.sha2("content", 256).alias("key"), "content")
    once = rows.where("content is not null").groupBy("key", "suffix").agg(F.first("content").alias("content"))
    done = once.mapInPandas(run, f"key string, suffix string, segments {SCHEMA}, warnings array<string>, error string")
    return rows.select("path", "key", "suffix").join(done, ["key", "suffix"], "left").select("path", F.col("key").alias("content_hash"), "segments", F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"), F.when(F.col("key").isNull(), "no content").otherwise(F.col("error")).alias("error"))


def load(spark, root: str) -> DataFrame:
    """(path, content) of all files under a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.regexp_replace("path", "^file:/*(?=/)", "").alias("path"), "content")
