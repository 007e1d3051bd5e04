"""Sections of filings: titled parts of HTML documents and of paged text, as rows."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.sources.shared import row_batches

#: How titles of parts begin, in bold HTML lines and in lines of pages. Fixed patterns; a line of capitals is one
#: only in capitals.
BOLD_TITLE = re.compile(r"^(PART\s+[IVX]+|Item\s+\d+[A-Za-z]?\.|[一二三四五六七八九十]+[、．.]|（[一二三四五六七八九十]+）|第[一二三四五六七八九十]+[节章部分])", re.I)
PAGE_TITLE = re.compile(r"^\s*(PART\s+[IVX0-9]+|Item\s+\d+[A-Za-z]?\.?|[一二三四五六七八九十百零〇]+[、．.节章部分]|（[一二三四五六七八九十百零〇]+）|\([一二三四五六七八九十]+\)|第[一二三四五六七八九十百零〇0-9]+[节章部分条]|(?-i:[A-Z][A-Z /&-]{4,}))", re.I)
#: Longest titles, and the size beyond which a table is taken for navigation. Fixed values.
TITLE_CHARS, BOLD_CHARS, CAPS_CHARS, TABLE_COLUMNS, TABLE_CHARS = 200, 120, 60, 15, 4000
_DROP = frozenset(["script", "style", "nav", "header", "footer", "noscript", "head"])
_VOID = frozenset(["br", "hr", "img", "input", "meta", "link", "col", "area", "base", "wbr", "source"])
_BLOCK = frozenset(["p", "div", "li", "tr", "ul", "ol", "blockquote", "pre"])


class Node:
    """An element with its children, or a run of text (``tag`` is empty)."""

    __slots__ = ("tag", "attrs", "kids", "text")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, text: str = ""):
        self.tag, self.attrs, self.kids, self.text = tag, attrs or {}, [], text

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            if n.kids:
                stack += n.kids[::-1]

    def words(self) -> str:
        parts = []
        for n in self.walk():
            parts.append(n.text if not n.tag else " " if n.tag in _BLOCK or n.tag in ("br", "td", "th") else "")
        return " ".join("".join(parts).split())


#: Texts of tags without attributes and of no character references, and their parts; tags whose content is no markup.
_PLAIN = re.compile(r"(?:[^<&]++|</?[A-Za-z][A-Za-z0-9]*+>)*+")
_PART = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)>|[^<]+")
_RAW = re.compile(r"<(?:script|style|textarea|title|iframe|noembed|noframes|noscript|xmp|plaintext|svg|math)>", re.I)


def feed(parser: HTMLParser, html: str) -> None:
    """A whole document to a parser; its handlers get plain ones by their tags alone, as the parser would give them."""
    if not _PLAIN.fullmatch(html) or _RAW.search(html):
        parser.feed(html)
        parser.close()
        return
    for m in _PART.finditer(html):
        if m[2] is None:
            parser.handle_data(m[0])
        elif m[1]:
            parser.handle_endtag(m[2].lower())
        else:
            parser.handle_starttag(m[2].lower(), [])


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.top = Node("html")
        self.open = [self.top]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "p" and self.open[-1].tag == "p":
            self.open.pop()
        n = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].kids.append(n)
        if tag not in _VOID:
            self.open.append(n)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].kids.append(Node("", text=data))

    def updatepos(self, i: int, j: int) -> int:  # lines are not asked for
        return j


def tree(html: str) -> Node:
    """The body of a document (or all of it), without scripts, styles and page furniture."""
    p = _Tree()
    feed(p, html)
    for n in p.top.walk():
        n.kids = [k for k in n.kids if k.tag not in _DROP]
    return next((n for n in p.top.walk() if n.tag == "body"), p.top)


def _is_contents(n: Node) -> bool:
    """A block of five links or more that make up over 80 % of its text."""
    links = [k for k in n.walk() if k.tag == "a" and "href" in k.attrs]
    text = n.words()
    return len(links) >= 5 and bool(text) and sum(len(k.words()) for k in links) > 0.8 * len(text)


def _drop_contents(top: Node) -> None:
    stack = [top]
    while stack:
        n = stack.pop()
        n.kids = [k for k in n.kids if not (k.tag in ("div", "p", "td", "tr") and _is_contents(k))]
        stack.extend(n.kids)


def _table(n: Node) -> str:
    """Rows of cells joined by bars; nothing of a table that is too wide or too long."""
    grid = [[c.words() for c in r.walk() if c.tag in ("td", "th")] for r in n.walk() if r.tag == "tr"]
    grid = [r for r in grid if r]
    if not grid or max(map(len, grid)) > TABLE_COLUMNS or sum(len(c) for r in grid for c in r) > TABLE_CHARS:
        return ""
    return "\n".join(" | ".join(r) for r in grid)


def _is_title(n: Node, text: str) -> bool:
    if len(text) > TITLE_CHARS:
        return False
    if re.fullmatch("h[1-4]", n.tag):
        return True
    marked = any(k.tag in ("b", "strong") or (k.tag == "font" and "+" in k.attrs.get("size", "")) for k in n.walk())
    return marked and len(text) <= BOLD_CHARS and bool(BOLD_TITLE.search(text) or (len(text) <= CAPS_CHARS and text == text.upper() and re.search("[A-Z]{3,}", text)))


def tidy(text: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", text)).strip()


def html_sections(html: str | None) -> Iterator[tuple[str | None, str, int | None]]:
    """(title, content, None) of the parts of a document: a heading element, or a bold or enlarged line that is
    numbered as a part or in capitals, begins one."""
    body = tree(html or "")
    _drop_contents(body)
    while len(inner := [k for k in body.kids if k.tag or k.text.strip()]) == 1 and inner[0].tag in ("div", "main", "article", "section", "center"):
        body = inner[0]  # a single wrapper is no part
    title, parts = None, []

    def made() -> Iterator[tuple[str | None, str, None]]:
        content = tidy("".join(parts))
        if title or content:
            yield title, content, None

    for n in body.kids:
        text = n.text.strip() if not n.tag else _table(n) if n.tag == "table" else n.words()
        if not text:
            continue
        if n.tag and n.tag != "table" and _is_title(n, text):
            yield from made()
            title, parts = text, []
        else:
            parts.append(text + ("\n\n" if n.tag == "table" or n.tag in _BLOCK else " "))
    yield from made()


def page_sections(pages: list[str]) -> Iterator[tuple[str | None, str, int | None]]:
    """(title, content, page where it begins) of paged text; a short line numbered as a part begins one."""
    title, parts, start = None, [], None
    for number, text in enumerate(pages, 1):
        if not text.strip():
            continue
        for line in map(str.strip, text.splitlines()):
            if line and len(line) <= BOLD_CHARS and PAGE_TITLE.search(line):
                if title or "".join(parts).strip():
                    yield title, tidy("\n".join(parts)), start
                title, parts, start = line, [], number
            else:
                parts.append(line)
    if title or "".join(parts).strip():
        yield title, tidy("\n".join(parts)), start


def heading_marks(text: str) -> str:
    """Lines that look like titles of parts, marked as second-level headings."""
    return "\n".join(f"## {x.strip()}" if x.strip() and len(x.strip()) <= BOLD_CHARS and PAGE_TITLE.search(x.strip()) else x for x in text.splitlines())


def sections(docs: DataFrame, id_col: str, content: str, parse: Callable = html_sections) -> DataFrame:
    """id, place, title, content, page: a row for each section of each document; a null document has none."""
    kind = dict(docs.dtypes)[id_col]

    def placed(data) -> Iterator[tuple]:
        return ((n, *part) for n, part in enumerate(parse(data)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return row_batches(batches, placed, [id_col, "place", "title", "content", "page"], [pa.int32(), pa.string(), pa.string(), pa.int32()])

    return docs.select(id_col, F.col(content)).mapInArrow(run, f"`{id_col}` {kind}, place int, title string, content string, page int")
