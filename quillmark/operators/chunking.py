"""Chunkers and HTML readers: text to rows, by pure functions mapped over Arrow batches."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.sources.shared import modest, row_batches

_HEAD = re.compile(r"^(#{1,4})\s+(.+?)\s*$", re.M)
_UNIT = re.compile(r"[^。！？；!?;\n]+[。！？；!?;]?|\n+")


def hash16(*parts: object) -> str:
    return hashlib.sha256("|".join(map(str, parts)).encode("utf-8", "surrogatepass")).hexdigest()[:16]


_KINDS = (re.compile("[一-鿿]+"), re.compile("[!-~]+"), re.compile(r"[^\x00-\x7f一-鿿\s]+"))


#: White space beyond ASCII.
_SPACES = np.array([ord(x) for x in map(chr, range(0x80, 0x3001)) if x.isspace()], np.uint32)


def counts(text: str) -> tuple[int, int, int]:
    """CJK characters, ASCII ones that aren't space, and others; they add up over pieces of a text."""
    cjk, plain, other = (sum(map(len, k.findall(text))) for k in _KINDS)
    return cjk, plain, other


def _running(text: str) -> np.ndarray:
    """``counts`` of every beginning of a text: (length + 1, 3)."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    cjk, plain = (c >= 0x4E00) & (c <= 0x9FFF), (c >= 0x21) & (c <= 0x7E)
    other = (c > 0x7F) & ~cjk & ~np.isin(c, _SPACES)
    return np.concatenate([np.zeros((1, 3), np.int64), np.cumsum(np.stack([cjk, plain, other], 1), 0, dtype=np.int64)])


def estimate(cjk: int, plain: int, other: int) -> int:
    return -(-2 * cjk // 3) + plain // 4 + other


def tokens(text: str) -> int:
    return estimate(*counts(text))


def sections(text: str) -> Iterator[tuple[str, int, str]]:
    """(breadcrumb, offset, body) of the parts below #..#### headings."""
    path: list[str] = []
    at, crumb = 0, ""
    for m in [*_HEAD.finditer(text), None]:
        body = text[at : m.start() if m else len(text)]
        if body.strip():
            yield crumb, at, body
        if m:
            level = len(m[1])
            path = [*path[: level - 1], m[2]]
            crumb, at = " > ".join(path), m.end()


def snap(text: str, end: int, low: int = 50, high: int = 100) -> int:
    """A boundary near ``end``: a blank line, else a sentence end, else a line end, else itself."""
    a, b = max(end - low, 1), min(end + high, len(text))
    near = text[a:b]
    for pattern in (r"\n\n", r"[。！？.!?](?=\s|$|[^\x00-\x7f])", r"\n"):
        hits = [a + m.end() for m in re.finditer(pattern, near)]
        if hits:
            return min(hits, key=lambda x: (abs(x - end), x))
    return end


def heading_chunks(text: str, size: int = 512, overlap: int = 64, parent_size: int = 4096) -> Iterator[dict]:
    """A parent a section and its children by a sliding window; ids are unique in the document."""
    used: dict[str, int] = {}

    def ident(kind: str, crumb: str, at: int, body: str) -> str:
        base = hash16(kind, crumb, at, body)
        used[base] = used.get(base, 0) + 1
        return base if used[base] == 1 else f"{base}-{used[base]}"

    for crumb, at, body in sections(text):
        top = body.strip()[:parent_size]
        parent = ident("parent", crumb, at, top)
        yield {"chunk_id": parent, "parent_id": None, "kind": "parent", "header": crumb, "start": at, "content": top}
        begin = 0
        while begin < len(body):
            end = len(body) if begin + size >= len(body) else max(snap(body, begin + size), begin + 1)
            piece = body[begin:end].strip()
            if piece:
                yield {"chunk_id": ident("child", crumb, at + begin, piece), "parent_id": parent, "kind": "child", "header": crumb, "start": at + begin, "content": piece}
            if end >= len(body):
                break
            begin = max(end - overlap, begin + 1)


def fixed_chunks(text: str, size: int = 512) -> Iterator[dict]:
    """Paragraphs packed to a size; ``start`` is where the first stands in the text."""
    part, at = "", 0
    gaps = [(0, 0), *(m.span() for m in re.finditer(r"\n{2,}", text)), (len(text), len(text))]
    for (_, begin), (end, _) in zip(gaps, gaps[1:]):
        p = text[begin:end]
        if part and len(part) + len(p) + 2 > size:
            yield {"chunk_id": hash16("fixed", at, part), "parent_id": None, "kind": "text", "header": "", "start": at, "content": part}
            part = ""
        at = at if part else begin
        part = f"{part}\n\n{p}" if part else p
    if part:
        yield {"chunk_id": hash16("fixed", at, part), "parent_id": None, "kind": "text", "header": "", "start": at, "content": part}


def _sum(parts: list[tuple[str, tuple[int, int, int]]]) -> int:
    """Tokens of units side by side."""
    return estimate(*map(sum, zip(*(c for _, c in parts)))) if parts else 0


def window_chunks(text: str, title: str = "", target: int = 400, most: int = 600, overlap: int = 80) -> Iterator[dict]:
    """Sentence units packed to ``target`` tokens, none above ``most``; a window starts with the last
    units of the one before, up to ``overlap`` tokens; a short tail joins its neighbour.

    Each unit is counted once, and counts are added, so time follows the text's length."""
    units: list[tuple[str, tuple[int, int, int]]] = []
    for u in _UNIT.findall(text):
        c = counts(u)
        if estimate(*c) > most:  # a long unit's pieces are told from its running counts
            run, at = _running(u), 0
            while (n := estimate(*(run[-1] - run[at]).tolist())) > most:
                cut = max(1, (len(u) - at) * most // (n + 1))
                units.append((u[at : at + cut], tuple((run[at + cut] - run[at]).tolist())))
                at += cut
            u, c = u[at:], tuple((run[-1] - run[at]).tolist())
        if u.strip():
            units.append((u, c))
    windows: list[list[tuple[str, tuple[int, int, int]]]] = []
    cur: list[tuple[str, tuple[int, int, int]]] = []
    held = (0, 0, 0)
    for u in units:
        if cur and estimate(*held) + estimate(*u[1]) > target:
            windows.append(cur)
            back: list[tuple[str, tuple[int, int, int]]] = []
            for x in reversed(cur):
                if _sum([x, *back]) > overlap:
                    break
                back.insert(0, x)
            cur = back if _sum(back) + estimate(*u[1]) <= most else []
            held = tuple(map(sum, zip((0, 0, 0), *(c for _, c in cur))))
        cur = [*cur, u]
        held = tuple(map(sum, zip(held, u[1])))
    if cur:
        if windows and _sum(cur) < max(50, target // 3) and _sum(windows[-1] + cur) <= most:
            windows[-1] = windows[-1] + cur
        else:
            windows.append(cur)
    head = f"Section: {title}\n" if title else ""
    for n, w in enumerate(windows):
        body = head + "".join(u for u, _ in w).strip()
        yield {"chunk_id": hash16("window", title, n, body), "parent_id": None, "kind": "text", "header": title, "start": n, "content": body}


STRATEGIES: dict[str, Callable[..., Iterator[dict]]] = {"HEADING": heading_chunks, "FIX_SIZE": fixed_chunks, "WINDOW": window_chunks}


def chunk(docs: DataFrame, id_col: str, text_col: str, strategy: str = "HEADING", **options: int) -> DataFrame:
    """id, chunk_index, chunk_id, parent_id, kind, header, start, content, prev_id, next_id; unknown
    strategies use FIX_SIZE."""
    f = STRATEGIES.get(strategy, fixed_chunks)
    names = ["chunk_index", "chunk_id", "parent_id", "kind", "header", "start", "content", "prev_id", "next_id"]
    kinds = [pa.int32(), *[pa.string()] * 4, pa.int64(), *[pa.string()] * 3]

    def parse(text: str) -> Iterator[tuple]:
        """A chunk's row is given on once the next one's id is known."""
        last, before = None, None
        for n, r in enumerate(f(text, **options)):
            if last:
                yield (*last, before, r["chunk_id"])
                before = last[1]
            last = (n, *(r[k] for k in names[1:7]))
        if last:
            yield (*last, before, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return row_batches(batches, parse, [id_col, *names], kinds)

    modest(docs.sparkSession)
    schema = f"{id_col} {dict(docs.dtypes)[id_col]}, chunk_index int, chunk_id string, parent_id string, kind string, header string, start bigint, content string, prev_id string, next_id string"
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema)


class _Markdown(HTMLParser):
    SKIP, BLOCK = {"script", "style", "nav", "header", "footer", "noscript"}, {"p", "div", "br", "section", "article", "ul", "ol", "table"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.SKIP:
            self.skip += 1
        elif self.skip:
            return
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "1234":
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self.out.append("\n- ")
        elif tag in ("td", "th"):
            self.out.append(" | ")
        elif tag in self.BLOCK or tag == "tr":
            self.out.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        elif not self.skip and (tag in self.BLOCK or tag[0] == "h"):
            self.out.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.out.append(re.sub(r"\s+", " ", data))


def html_markdown(html: str | None) -> str:
    """Markdown-like text of a page: headings, list items and table rows marked."""
    p = _Markdown()
    p.feed(html or "")
    p.close()
    return re.sub(r"\n{3,}", "\n\n", re.sub(r" *\n *", "\n", "".join(p.out))).strip()


def read_html(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([html_markdown(h.as_py()) for h in b.column(1)], pa.string())], [id_col, "text"])

    modest(pages.sparkSession)
    return pages.select(id_col, F.col(html_col).cast("string")).mapInArrow(run, f"{id_col} {dict(pages.dtypes)[id_col]}, text string")
