"""Text of PDF files by the standard library: pages of lines in reading order.

Reads classic and compressed objects, Flate and ASCIIHex streams, and text shown by Tj, TJ, ' and " under
Tm, Td, TD, T* and cm; strings are decoded by a font's ToUnicode map, else as UTF-16 (with a mark) or
Latin-1.  Not read: encrypted files, images of text, other filters; such pages come out empty."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

_OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/<>\[\]()]+|[-+]?\d*\.?\d+|[A-Za-z'\"*]+[*]?", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _stream(body: bytes) -> bytes:
    m = re.search(rb"stream\r?\n", body)
    if not m:
        return b""
    data, head = body[m.end() : body.rfind(b"endstream")], body[: m.start()]
    for kind in re.findall(rb"/(FlateDecode|ASCIIHexDecode)", head):
        if kind == b"ASCIIHexDecode":
            data = bytes.fromhex(re.sub(rb"[^0-9A-Fa-f]", b"", data.split(b">")[0]).decode())
        else:
            try:
                data = zlib.decompressobj().decompress(data)
            except zlib.error:
                return b""
    return data if not re.search(rb"/(?:DCT|JPX|LZW|CCITTFax|RunLength)", head) else b""


def _objects(data: bytes) -> dict[int, bytes]:
    found = {int(n): body for n, _, body in _OBJECT.findall(data)}
    for body in list(found.values()):
        if b"/ObjStm" in body:  # objects packed in a stream: pairs of number and offset, then bodies
            first, inner = int(re.search(rb"/First\s+(\d+)", body)[1]), _stream(body)
            pairs = list(map(int, inner[:first].split()))
            starts = [*pairs[1::2], len(inner) - first]
            for n, a, b in zip(pairs[::2], starts, starts[1:]):
                found[n] = inner[first + a : first + b]
    return found


def _refs(body: bytes, key: bytes) -> list[int]:
    m = re.search(rb"/" + key + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
    return [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", m[1])] if m else []


def _pages(objects: dict[int, bytes]) -> list[int]:
    """Page objects in order of the page tree."""
    root = next((n for n, b in objects.items() if re.search(rb"/Type\s*/Catalog\b", b)), None)
    out, stack, seen = [], _refs(objects.get(root, b""), b"Pages"), set()
    while stack:
        n = stack.pop()
        if n in seen or n not in objects:
            continue
        seen.add(n)
        if re.search(rb"/Type\s*/Pages\b", objects[n]):
            stack.extend(reversed(_refs(objects[n], b"Kids")))
        else:
            out.append(n)
    return out or [n for n, b in sorted(objects.items()) if re.search(rb"/Type\s*/Page\b", b)]


def _unicode_map(cmap: bytes) -> dict[bytes, str]:
    made = {}
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            made[bytes.fromhex(a.decode())] = text(b)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            low, high, to, size = int(a, 16), int(b, 16), int(c, 16), len(a) // 2
            for k in range(min(high - low, 65535) + 1):
                made[(low + k).to_bytes(size, "big")] = chr(to + k) if to + k < 0x110000 else "?"
    return made


def _string(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1]).decode()
        return bytes.fromhex(digits + "0" * (len(digits) % 2))
    octal = lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1] in b"\r\n" else _ESCAPES.get(m[1], m[1])
    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", octal, token[1:-1], flags=re.S)


def _decode(raw: bytes, names: dict[bytes, str] | None) -> str:
    if names:
        size = max(map(len, names))
        return "".join(names.get(raw[k : k + size], "") for k in range(0, len(raw), size))
    return raw.decode("utf-16", "replace") if raw[:2] in (b"\xfe\xff", b"\xff\xfe") else raw.decode("latin-1")


def _shown(content: bytes, fonts: dict[bytes, dict[bytes, str]]) -> Iterator[tuple[float, float, str]]:
    """(y, x, text) of what a content stream shows."""
    args: list[bytes] = []
    x = y = lx = ly = ox = oy = 0.0
    leading, font = 0.0, None
    saved: list[tuple[float, float]] = []
    for m in _TOKEN.finditer(content):
        t = m[0]
        if t[:1] in b"(</[]" or re.fullmatch(rb"[-+]?\d*\.?\d+", t):
            args.append(t)
            continue
        nums = [float(a) for a in args if re.fullmatch(rb"[-+]?\d*\.?\d+", a)]
        if t == b"BT":
            x = y = lx = ly = 0.0
        elif t == b"q":
            saved.append((ox, oy))
        elif t == b"Q" and saved:
            ox, oy = saved.pop()
        elif t == b"cm" and len(nums) >= 6:
            ox, oy = ox + nums[-2], oy + nums[-1]
        elif t == b"Tf" and args:
            font = fonts.get(next((a for a in args if a[:1] == b"/"), b"")[1:])
        elif t == b"TL" and nums:
            leading = nums[-1]
        elif t == b"Tm" and len(nums) >= 6:
            x, y = lx, ly = nums[-2], nums[-1]
        elif t in (b"Td", b"TD") and len(nums) >= 2:
            x, y = lx, ly = lx + nums[-2], ly + nums[-1]
            leading = -nums[-1] if t == b"TD" else leading
        elif t in (b"T*", b"'", b'"'):
            x, y = lx, ly = lx, ly - leading
        if t in (b"Tj", b"TJ", b"'", b'"'):
            # in an array, a gap of over a fifth of the font's size is a space
            parts = [_decode(_string(a), font) if a[:1] in b"(<" else " " if re.fullmatch(rb"[-+]?\d*\.?\d+", a) and float(a) < -200 and t == b"TJ" else "" for a in args]
            if text := "".join(parts):
                yield oy + y, ox + x, text
                x += 0.001  # what follows without a move stands behind
        args = []


def pages(data: bytes | None) -> list[str]:
    """The text of each page: lines from top to bottom, parts of a line from left to right."""
    if not data or b"%PDF" not in data[:1024]:
        return []
    objects = _objects(data)
    out = []
    for n in _pages(objects):
        rows: dict[float, list[tuple[float, str]]] = {}
        for y, x, text in _shown(content(objects, n), fonts(objects, n)):
            rows.setdefault(round(y, 1), []).append((x, text))
        lines = (" ".join(t.strip() for _, t in sorted(r, key=lambda p: p[0]) if t.strip()) for _, r in sorted(rows.items(), key=lambda p: -p[0]))
        out.append("\n".join(x for x in lines if x))
    return out


def markdown(data: bytes | None) -> str:
    """All pages, with lines that look like titles marked as headings."""
    from quillmark.operators.sections import heading_marks

    return heading_marks("\n".join(pages(data)))


def gap_tables(shown: Iterator[tuple[float, float, str]]) -> Iterator[list[tuple[int, int, str]]]:
    """Tables of a page as (row, col, value): two lines or more, one below the other, of two cells or more; a cell is what
    is shown from one place on.  Columns are the places where the table's cells begin."""
    rows: dict[float, list[tuple[float, str]]] = {}
    for y, x, text in shown:
        if text.strip():
            rows.setdefault(round(y, 1), []).append((round(x), text.strip()))
    block: list[list[tuple[float, str]]] = []
    for line in [*(sorted(r) for _, r in sorted(rows.items(), key=lambda p: -p[0])), []]:
        if len(line) >= 2:
            block.append(line)
            continue
        if len(block) >= 2:
            places = sorted({x for r in block for x, _ in r})
            columns = [x for k, x in enumerate(places) if not k or x - places[k - 1] > 12]
            yield [(i, sum(c <= x for c in columns), text) for i, r in enumerate(block, 1) for x, text in r]
        block = []


def content(objects: dict[int, bytes], page: int) -> bytes:
    return b"\n".join(_stream(objects.get(k, b"")) for k in _refs(objects[page], b"Contents"))


def fonts(objects: dict[int, bytes], page: int) -> dict[bytes, dict[bytes, str]]:
    """The Unicode maps of a page's fonts that have one, by name."""
    body = objects[page]
    holder, out = b"".join([body, *(objects.get(k, b"") for k in _refs(body, b"Resources"))]), {}
    for name, ref in re.findall(rb"/([A-Za-z0-9_.+-]+)\s+(\d+)\s+\d+\s+R", holder):
        for k in _refs(objects.get(int(ref), b""), b"ToUnicode"):
            out[name] = _unicode_map(_stream(objects.get(k, b"")))
    return out
