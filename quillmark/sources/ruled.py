"""Tables of PDF pages by their drawn lines.

The content stream is read with its whole coordinate matrix, and turned as the page is.  Lines that lie on one straight
and touch are one; lines that cross, one way or another, belong to one lattice.  Between neighbouring lines of a
lattice are its smallest fields; fields without a line between them are one cell, which then spans several rows
or columns and counts where it begins.  What isn't closed by lines is no cell.  Texts belong to the cell where
they begin.  On pages without a lattice tables are told by the gaps between columns (``pdf.gap_tables``); a
table that comes again is one."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

from quillmark.sources import pdf

#: Units that lines may be apart and count as touching; thicker filled boxes are shading and no lines.
TOUCH, THIN = 2.0, 3.0
_NUMBER = re.compile(rb"[-+]?\d*\.?\d+")
#: What numbers of a content stream begin with; no other token does.
_FIGURE = frozenset(b"+-.0123456789")
Matrix = tuple[float, float, float, float, float, float]
#: A string without escapes; a text object that shows one at a place of its own, the string taken out: (all of it, font, x, y).
_STRING, _FIG = re.compile(rb"\(([^\\()]*+)\)"), rb"[-+]?+(?:\d*+\.)?+\d++"
_SHOWN = re.compile(rb"(BT\s++/([^\s/<>\[\]()]++)\s++%b\s++Tf\s++(?:%b\s++){4}+(%b)\s++(%b)\s++Tm\s++\(\)\s*+Tj\s++ET(?=\s|\Z)\s*+)" % (_FIG, _FIG, _FIG, _FIG))
#: Forms that are kept, and bytes of a page's content beyond which it is read anew.
FORMS, FORM_BYTES = 16, 1 << 17


def _times(m: Matrix, n: Matrix) -> Matrix:
    """First m, then n."""
    a, b, c, d, e, f = m
    g, h, i, j, k, l = n  # noqa: E741
    return a * g + b * i, a * h + b * j, c * g + d * i, c * h + d * j, e * g + f * i + k, e * h + f * j + l


def _at(m: Matrix, x: float, y: float) -> tuple[float, float]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def drawn(content: bytes, fonts: dict[bytes, dict[bytes, str]], page: Matrix) -> tuple[list[tuple[float, float, str]], list[tuple[float, float, float, float]]]:
    """((x, y, text) shown, (x0, y0, x1, y1) of the straight lines drawn)."""
    return _drawn(content, fonts, page)[:2]


def _drawn(content: bytes, fonts: dict[bytes, dict[bytes, str]], page: Matrix) -> tuple[list[tuple[float, float, str]], list[tuple[float, float, float, float]], Matrix]:
    """What ``drawn`` gives, and the matrix at the end."""
    texts, lines, path, saved = [], [], [], []
    ctm, tm, line = page, (1, 0, 0, 1, 0, 0), (1, 0, 0, 1, 0, 0)
    leading, font, args, n, here, start = 0.0, None, [], [], (0.0, 0.0), (0.0, 0.0)
    for token in pdf._TOKEN.finditer(content):
        t = token[0]
        if t[0] in _FIGURE:
            args.append(t)
            n.append(float(t))
            continue
        if t[0] in b"(</[]":
            args.append(t)
            continue
        if t == b"q":
            saved.append(ctm)
        elif t == b"Q" and saved:
            ctm = saved.pop()
        elif t == b"cm" and len(n) >= 6:
            ctm = _times(tuple(n[-6:]), ctm)
        elif t == b"m" and len(n) >= 2:
            here = start = (n[-2], n[-1])
        elif t == b"l" and len(n) >= 2:
            path.append((_at(ctm, *here), _at(ctm, n[-2], n[-1]), False))
            here = (n[-2], n[-1])
        elif t == b"re" and len(n) >= 4:
            x, y, w, h = n[-4:]
            path.append((_at(ctm, x, y), _at(ctm, x + w, y + h), True))
            here = start = (x, y)
        elif t in (b"h", b"s", b"b", b"b*"):
            path.append((_at(ctm, *here), _at(ctm, *start), False))
            here = start
        if t in (b"S", b"s", b"B", b"B*", b"b", b"b*", b"f", b"F", b"f*", b"n"):
            for (x0, y0), (x1, y1), box in path if t != b"n" else ():
                thin = abs(x1 - x0) < THIN or abs(y1 - y0) < THIN
                if not box and t not in (b"f", b"F", b"f*"):
                    lines.append((x0, y0, x1, y1))
                elif box and thin:  # a line drawn as a box
                    lines.append(((x0 + x1) / 2, y0, (x0 + x1) / 2, y1) if abs(x1 - x0) < abs(y1 - y0) else (x0, (y0 + y1) / 2, x1, (y0 + y1) / 2))
                elif box and t not in (b"f", b"F", b"f*"):
                    lines += [(x0, y0, x1, y0), (x0, y1, x1, y1), (x0, y0, x0, y1), (x1, y0, x1, y1)]
            path = []
        if t == b"BT":
            tm = line = (1, 0, 0, 1, 0, 0)
        elif t == b"Tf" and args:
            font = fonts.get(next((a for a in args if a[:1] == b"/"), b"")[1:])
        elif t == b"TL" and n:
            leading = n[-1]
        elif t == b"Tm" and len(n) >= 6:
            tm = line = tuple(n[-6:])
        elif t in (b"Td", b"TD") and len(n) >= 2:
            tm = line = _times((1, 0, 0, 1, n[-2], n[-1]), line)
            leading = -n[-1] if t == b"TD" else leading
        elif t in (b"T*", b"'", b'"'):
            tm = line = _times((1, 0, 0, 1, 0, -leading), line)
        if t in (b"Tj", b"TJ", b"'", b'"'):
            parts = [pdf._decode(pdf._string(a), font) if a[:1] in b"(<" else " " if t == b"TJ" and _NUMBER.fullmatch(a) and float(a) < -200 else "" for a in args]
            if text := "".join(parts):
                texts.append((*_at(_times(tm, ctm), 0, 0), text))
                tm = _times((1, 0, 0, 1, 0.001, 0), tm)  # what follows without a move stands behind
        args, n = [], []
    return texts, lines, ctm


def _merged(lines: list[tuple[float, float, float]]) -> list[tuple[float, float, float]]:
    """(place, from, to) of parallel lines, those on one straight that touch being one."""
    groups: list[list[tuple[float, float, float]]] = []
    for x in sorted(lines):
        if groups and x[0] - groups[-1][-1][0] <= TOUCH:
            groups[-1].append(x)
        else:
            groups.append([x])
    out = []
    for g in groups:
        place, end = sum(x[0] for x in g) / len(g), None
        for _, a, b in sorted(g, key=lambda x: x[1]):
            if end is not None and a <= end + TOUCH:
                end = max(end, b)
                out[-1] = (place, out[-1][1], end)
            else:
                out.append((place, a, b))
                end = b
    return out


def lattices(lines: list[tuple[float, float, float, float]]) -> Iterator[list[tuple[float, float, float, float, int, int, int, int]]]:
    """The cells (x0, y0, x1, y1, row, col, rows, cols) of each lattice, from the top of the page down; rows and columns from 1."""
    flat = _merged([((y0 + y1) / 2, min(x0, x1), max(x0, x1)) for x0, y0, x1, y1 in lines if abs(y1 - y0) < 1 <= abs(x1 - x0)])
    upright = _merged([((x0 + x1) / 2, min(y0, y1), max(y0, y1)) for x0, y0, x1, y1 in lines if abs(x1 - x0) < 1 <= abs(y1 - y0)])
    root = list(range(len(flat) + len(upright)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    for i, (y, a, b) in enumerate(flat):
        for j, (x, c, d) in enumerate(upright):
            if a - TOUCH <= x <= b + TOUCH and c - TOUCH <= y <= d + TOUCH:
                root[find(i)] = find(len(flat) + j)
    groups: dict[int, tuple[list, list]] = {}
    for k in range(len(root)):
        groups.setdefault(find(k), ([], []))[k >= len(flat)].append(flat[k] if k < len(flat) else upright[k - len(flat)])
    for hs, vs in sorted(groups.values(), key=lambda g: -max((h[0] for h in g[0]), default=0)):
        ys, xs = _places(hs)[::-1], _places(vs)
        if len(ys) > 1 and len(xs) > 1:
            cells = _cells(hs, vs, xs, ys)
            if len(cells) > 1:
                yield cells


def _places(lines: list[tuple[float, float, float]]) -> list[float]:
    out: list[float] = []
    for p in sorted({x[0] for x in lines}):
        if not out or p - out[-1] > TOUCH:
            out.append(p)
    return out


def _cells(hs, vs, xs: list[float], ys: list[float]) -> list[tuple[float, float, float, float, int, int, int, int]]:
    """Fields between the lines, joined where nothing is drawn between them; ``ys`` from the top."""
    there = lambda lines, place, a, b: any(abs(p - place) <= TOUCH and c <= a + TOUCH and b - TOUCH <= d for p, c, d in lines)
    m, n = len(ys) - 1, len(xs) - 1
    above = [[there(hs, ys[i], xs[j], xs[j + 1]) for j in range(n)] for i in range(m + 1)]
    before = [[there(vs, xs[j], ys[i + 1], ys[i]) for j in range(n + 1)] for i in range(m)]
    owner: dict[tuple[int, int], tuple[int, int]] = {}
    out = []
    for i in range(m):
        for j in range(n):
            if (i, j) in owner:
                continue
            held, stack, closed = {(i, j)}, [(i, j)], True
            while stack:
                r, c = stack.pop()
                for open_, to in ((not above[r][c], (r - 1, c)), (not above[r + 1][c], (r + 1, c)), (not before[r][c], (r, c - 1)), (not before[r][c + 1], (r, c + 1))):
                    if open_ and not (0 <= to[0] < m and 0 <= to[1] < n):
                        closed = False
                    elif open_ and to not in held:
                        held.add(to)
                        stack.append(to)
            for f in held:
                owner[f] = (i, j)
            if closed:
                r1, c1 = max(r for r, _ in held), max(c for _, c in held)
                r0, c0 = min(r for r, _ in held), min(c for _, c in held)
                out.append((xs[c0], ys[r1 + 1], xs[c1 + 1], ys[r0], r0 + 1, c0 + 1, r1 - r0 + 1, c1 - c0 + 1))
    return out


def _placed(shown: list[tuple], grids: list[list[tuple]]) -> Iterator[list[tuple[int, int, int, int, list[tuple]]]]:
    """The cells (row, col, rows, cols, what it shows in reading order) of each lattice that hold some of the (y, x, text) shown, by height."""
    heights, low, high = [s[0] for s in shown], None, None
    for cells in grids:
        out = []
        for a, b, c, d, row, col, rows, cols in cells:
            if b != low or d != high:  # the cells of a row are of one height, most often
                low, high = b, d
                near = shown[bisect_left(heights, b) : bisect_left(heights, d)]
            own = [s for s in near if a - 1 <= s[1] < c - 1]
            if own:
                out.append((row, col, rows, cols, sorted((-round(y, 1), x, t) for y, x, t in own)))
        yield out


@lru_cache(FORMS)
def _form(form: bytes, page: Matrix) -> tuple[list[bytes], list[list[tuple[int, int, int, int, list[int]]]]] | None:
    """(fonts of the texts, tables as cells with the numbers of the texts that they show) of a page's content without its strings,
    where plain text objects alone follow a drawing with lattices and the order of the texts hangs on their places alone."""
    k = form.find(b"BT")
    drawing, shown = form[: max(k, 0)], _SHOWN.findall(form, max(k, 0))
    if k < 0 or (k and not drawing[-1:].isspace()) or b"(" in drawing or b"<" in drawing or sum(len(x[0]) for x in shown) < len(form) - k:
        return None
    _, lines, (a, b, c, d, e, f) = _drawn(drawing, {}, page)
    at = [(float(x), float(y)) for *_, x, y in shown]
    grids = [sorted(cells, key=lambda c: c[4:6]) for cells in lattices(lines)]
    tables = list(_placed(sorted((x * b + y * d + f, x * a + y * c + e, n) for n, (x, y) in enumerate(at)), grids))
    if not tables or any(len({s[:2] for s in own}) < len(own) for cells in tables for *_, own in cells):
        return None
    return [x[1] for x in shown], [[(*cell, [n for *_, n in own]) for *cell, own in cells] for cells in tables]


def _filled(content: bytes, fonts: dict[bytes, dict[bytes, str]], page: Matrix) -> list[list[tuple[int, int, int, int, str]]] | None:
    """The tables of a page by what is kept of its form; none for pages that are to be read token by token."""
    if len(content) > FORM_BYTES:
        return None
    parts = _STRING.split(content)
    if (form := _form(b"()".join(parts[::2]), page)) is None:
        return None
    names, tables = form
    whole = b"\n".join(parts[1::2])
    if fonts or whole.count(b"\n") >= len(names) or b"\xfe\xff" in whole or b"\xff\xfe" in whole:
        texts = [pdf._decode(raw, fonts.get(name)).strip() for name, raw in zip(names, parts[1::2])]
    else:  # Latin-1 alone
        texts = [t.strip() for t in whole.decode("latin-1").split("\n")]
    if not all(texts):
        return None
    return [[(row, col, rows, cols, texts[own[0]] if len(own) == 1 else " ".join([texts[n] for n in own])) for row, col, rows, cols, own in cells] for cells in tables]


def tables(data: bytes | None) -> Iterator[list[tuple[int, int, int, int, str]]]:
    """Tables of a file, each as (row, col, rows, cols, value) of its cells that hold a text."""
    if not data or b"%PDF" not in data[:1024]:
        return
    objects = pdf._objects(data)
    for n in pdf._pages(objects):
        body = objects[n]
        turn = int((re.search(rb"/Rotate\s+(-?\d+)", body) or [0, b"0"])[1]) % 360
        box = re.search(rb"/MediaBox\s*\[\s*([-\d.\s]+)\]", body)
        x0, y0, x1, y1 = map(float, box[1].split()) if box else (0.0, 0.0, 612.0, 792.0)
        page: Matrix = {90: (0, -1, 1, 0, -y0, x1), 180: (-1, 0, 0, -1, x1, y1), 270: (0, 1, -1, 0, y1, -x0)}.get(turn, (1, 0, 0, 1, -x0, -y0))
        content, fonts = pdf.content(objects, n), pdf.fonts(objects, n)
        if (filled := _filled(content, fonts, page)) is not None:
            yield from filter(None, filled)
            continue
        texts, lines = drawn(content, fonts, page)
        grids = [sorted(cells, key=lambda c: c[4:6]) for cells in lattices(lines)]
        for cells in _placed(sorted((y, x, t.strip()) for x, y, t in texts if t.strip()), grids):
            if cells:
                yield [(*cell, " ".join(t for *_, t in own)) for *cell, own in cells]
        if not grids:
            for cells in pdf.gap_tables((y, x, t) for x, y, t in texts):
                yield [(row, col, 1, 1, t) for row, col, t in cells]


def _once(data: bytes | None) -> Iterator[list[tuple[int, int, int, int, str]]]:
    """The tables, one that comes again once."""
    seen = set()
    for cells in tables(data):
        mark = tuple((r, c, t[:100]) for r, c, _, _, t in cells)
        if mark not in seen:
            seen.add(mark)
            yield cells


def table_cells(data: bytes | None) -> Iterator[tuple[str, int, int, str]]:
    """(sheet, row, col, value) of the tables, a table that comes again once."""
    for number, cells in enumerate(_once(data)):
        yield from ((str(number), r, c, t) for r, c, _, _, t in cells)


def table_rows(data: bytes | None) -> Iterator[tuple[str, list[int], list[list[str | None]]]]:
    """(sheet, numbers of the rows, their texts by column, null where none begins) of the tables of ``table_cells``."""
    for number, cells in enumerate(_once(data)):
        rows: list[int] = []
        held: list[list[str | None]] = []
        for r, c, _, _, t in cells:
            if not rows or rows[-1] != r:
                rows.append(r)
                held.append(own := [])
            if c == len(own) + 1:
                own.append(t)
            else:
                own += [None] * (c - len(own))
                own[c - 1] = t if own[c - 1] is None else f"{own[c - 1]} {t}"
        yield str(number), rows, held
