"""HTML as sections and tables. A small tree, built by the rules of lenient parsers: no end tag is implied, void elements close at once, an end tag
closes the nearest open element of its name or nothing."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

from quillspark.operators.chunking import clean_text
from quillspark.sources.tables import table_text

# Elements that hold no content, prefixes of such, what starts a section, and the bounds of what stands before a table.
NO_CONTENT = {"script", "style", "nav", "header", "footer", "noscript", "svg", "form", "ix:hidden", "ix:header", "ix:resources", "ix:references", "link:schemaref", "link:linkbaseref"}
NO_CONTENT_PREFIXES = ("xbrli:", "xbrldi:")
HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\s*(?:!important\s*)?(?:;|$)", re.I)
UNITS = re.compile(r"\b(?:in\s+(?:thousands|millions|billions)|per[ -]+share(?:\s+amounts)?|(?:U\.?S\.?\s*)?dollars)\b", re.I)
HEADINGS, BLOCKS, CAPTIONS = ("h1", "h2", "h3", "h4"), ("h1", "h2", "h3", "h4", "p", "li"), ("h1", "h2", "h3", "p")
MOST_COLSPAN, MOST_ROWSPAN, LOCATOR, CAPTION, NEARBY, NODES, LEVELS, ENOUGH_PROSE = 64, 1024, 180, 500, 600, 40, 4, 0.65
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}


class Node:
    __slots__ = ("name", "attrs", "parent", "children", "order")

    def __init__(self, name: str, attrs: dict, parent: Node | None, order: int):
        self.name, self.attrs, self.parent, self.order = name, attrs, parent, order
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        """All elements below, in document order; no recursion, as pages nest deeply."""
        waiting = [c for c in reversed(self.children) if isinstance(c, Node)]
        while waiting:
            node = waiting.pop()
            yield node
            waiting += [c for c in reversed(node.children) if isinstance(c, Node)]

    def strings(self, tables: bool = True) -> list[str]:
        """Stripped texts below that aren't blank; without tables, not those in tables."""
        out, waiting = [], list(reversed(self.children))
        while waiting:
            x = waiting.pop()
            if isinstance(x, str):
                if s := x.strip():
                    out.append(s)
            elif tables or x.name != "table":
                waiting += reversed(x.children)
        return out

    def above(self, *names: str) -> Node | None:
        node = self.parent
        while node is not None and node.name not in names:
            node = node.parent
        return node

    @property
    def hidden(self) -> bool:
        a = self.attrs
        return self.name in NO_CONTENT or self.name.startswith(NO_CONTENT_PREFIXES) or "hidden" in a or (a.get("aria-hidden") or "").lower() == "true" or bool(HIDING.search(a.get("style") or ""))


class _Builder(HTMLParser):
    """Hidden elements and all below them are left out while the tree is built."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None, 0)
        self.n, self.dropped = 0, None

    def handle_starttag(self, tag, attrs):
        self.n += 1
        node = Node(tag, {k: v for k, v in reversed(attrs)}, self.at, self.n)
        if self.dropped is None and node.hidden:
            if tag in VOID:
                return
            self.dropped = node
        elif self.dropped is None:
            self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.name != tag:
            node = node.parent
        if node.parent is None:
            return
        closed = self.at
        while closed is not node.parent:
            if closed is self.dropped:
                self.dropped = None
            closed = closed.parent
        self.at = node.parent

    def handle_data(self, data):
        if self.dropped is None:
            self.at.children.append(data)


def decoded(raw: bytes) -> str:
    """By byte order mark, by the declared encoding, as UTF-8, or as cp1252."""
    if raw[:3] == b"\xef\xbb\xbf":
        return raw[3:].decode("utf-8", "replace")
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return raw.decode("utf-16", "replace")
    declared = re.search(rb"""charset\s*=\s*["']?\s*([\w.:-]+)|<\?xml[^>]*encoding\s*=\s*["']([\w.:-]+)""", raw[:2_048], re.I)
    for name in (*((declared[1] or declared[2]).decode() for _ in [0] if declared), "utf-8"):
        try:
            return raw.decode(name)
        except (UnicodeError, LookupError):
            pass
    return raw.decode("cp1252", "replace")


def parse(raw: bytes | str) -> Node:
    builder = _Builder()
    builder.feed(raw if isinstance(raw, str) else decoded(raw))
    builder.close()
    return builder.root


def _span(value, most: int) -> int:
    try:
        return min(most, max(1, int(value)))
    except (TypeError, ValueError):
        return 1


def grid(table: Node) -> list[list[str]]:
    """Cells of a table's own rows; what spans several cells stands in the first column of each of its rows. Columns empty in every row are dropped."""
    rows: list[dict[int, str]] = []
    # For each column that a cell from above reaches into: rows left, and what it shows there.
    reach: dict[int, tuple[int, str]] = {}
    for tr in (n for n in table.walk() if n.name == "tr" and n.above("table") is table):
        cells = {c: shown for c, (_, shown) in reach.items()}
        reach = {c: (left - 1, shown) for c, (left, shown) in reach.items() if left > 1}
        col = 0
        for cell in (n for n in tr.children if isinstance(n, Node) and n.name in ("td", "th")):
            while col in cells:
                col += 1
            # A cell's spans count only together: one that can't be read makes both of them one.
            wide, high = _span(cell.attrs.get("colspan", 1), MOST_COLSPAN), _span(cell.attrs.get("rowspan", 1), MOST_ROWSPAN)
            if any(not re.fullmatch(r"\s*[+-]?\d+\s*", str(cell.attrs.get(k, 1))) for k in ("colspan", "rowspan")):
                wide = high = 1
            shown = " ".join(cell.strings(tables=False))
            for i in range(wide):
                cells[col + i] = shown if i == 0 else ""
                if high > 1:
                    reach[col + i] = (high - 1, cells[col + i])
            col += wide
        if cells:
            rows.append(cells)
    used = sorted({c for row in rows for c, x in row.items() if x.strip()})
    return [[row.get(c, "") for c in used] for row in rows]


def _units(text: str) -> set[str]:
    return {" ".join(m[0].lower().split()) for m in UNITS.finditer(text)}


def context(table: Node, elements: list[Node]) -> str:
    """What names a table: the heading or paragraph before it, or the text just before it where that tells the units. A table or rule in between ends
    the search, so that no table gets another one's units."""
    before = [n for n in elements if n.name in CAPTIONS and n.order < table.order]
    named = " ".join(before[-1].strings())[:CAPTION] if before else ""
    near, looked, left, barred = [], 0, NEARBY, False
    for node, sibling in _backwards(table):
        looked += 1
        if looked > NODES:
            break
        if isinstance(sibling, Node) and (sibling.name in ("table", "hr") or any(n.name in ("table", "hr") for n in sibling.walk())):
            barred = True
            break
        piece = (" ".join(sibling.strings()) if isinstance(sibling, Node) else sibling.strip())[-left:]
        if piece:
            near.append(piece)
            left -= len(piece) + 1
            if left <= 0:
                break
    nearby = "\n".join(near[::-1])
    elsewhere = barred and named not in nearby
    if _units(nearby) and (_units(nearby) - _units(named) or elsewhere):
        return nearby
    return "" if _units(named) and elsewhere else named


def _backwards(table: Node) -> Iterator[tuple[Node, Node | str]]:
    """What stands before a table beside it, then before the elements around it."""
    node = table
    for _ in range(LEVELS):
        if node.parent is None:
            return
        at = next(i for i, c in enumerate(node.parent.children) if c is node)
        yield from ((node, c) for c in reversed(node.parent.children[:at]))
        node = node.parent
        if node.name in ("body", "html", ""):
            return


def sections(raw: bytes | str) -> list[tuple[str, str]]:
    """(text, locator) of a page: its tables, then its prose by headings; all prose as one where the headed part is the smaller part of it."""
    root = parse(raw)
    elements = list(root.walk())
    main = next((n for name in ("article", "main", "body") for n in elements if n.name == name), root)
    inner = list(main.walk())
    tables = [(table_text(grid(t), context(t, elements)), f"table {i}") for i, t in enumerate((n for n in inner if n.name == "table"), 1)]
    out = [(t, where) for t, where in tables if t]
    parts: list[tuple[str, list[str]]] = [("document", [])]
    for n in inner:
        if n.name in BLOCKS and n.above("p", "li", "table") is None and (text := " ".join(n.strings(tables=False))):
            if n.name in HEADINGS:
                parts.append((text[:LOCATOR], []))
            parts[-1][1].append(text)
    prose = [(clean_text("\n\n".join(own)), where) for where, own in parts if own]
    every = main.strings(tables=False)
    if not (out or prose) or len(" ".join(t for t, _ in prose)) < ENOUGH_PROSE * len(" ".join(every)):
        whole = clean_text("\n".join(every))
        prose = [(whole, "document")] if whole else []
    return out + prose
