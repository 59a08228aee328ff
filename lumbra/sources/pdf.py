"""Texts of PDF pages without a library: the objects, streams and text operators that most text documents use, and a writer of plain pages."""

from __future__ import annotations

import re
import zlib

_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b")
_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]+|[-+]?\d*\.?\d+|[A-Za-z'\"*]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: What a stream may hold after it has been unpacked; a small file must not fill a worker's memory.
MOST_BYTES = 256 << 20


def _unpacked(head: bytes, raw: bytes) -> bytes:
    if b"/FlateDecode" not in head and not re.search(rb"/Filter\s*\[?\s*/Fl\b", head):
        return raw
    unpack = zlib.decompressobj()
    out = unpack.decompress(raw, MOST_BYTES)
    if unpack.unconsumed_tail:
        raise ValueError("a stream of this PDF is too large")
    return out


def _objects(data: bytes) -> dict[int, tuple[bytes, bytes]]:
    """Number to (dictionary, unpacked stream) of all objects, those inside of object streams too. Later objects replace earlier ones of the same number."""
    out: dict[int, tuple[bytes, bytes]] = {}
    marks = list(_OBJECT.finditer(data))
    for m, after in zip(marks, [*marks[1:], None], strict=False):
        end = after.start() if after else len(data)
        start = data.find(b"stream", m.end(), end)
        close = data.rfind(b"endstream", m.end(), end)
        if 0 <= start < close:
            head = data[m.end() : start]
            begin = start + 6 + (2 if data[start + 6 : start + 8] == b"\r\n" else 1)
            try:
                out[int(m.group(1))] = (head, _unpacked(head, data[begin:close]))
            except zlib.error:
                out[int(m.group(1))] = (head, b"")
        else:
            out[int(m.group(1))] = (data[m.end() : end].split(b"endobj")[0], b"")
    for head, body in list(out.values()):
        if b"/ObjStm" in head and (first := re.search(rb"/First\s+(\d+)", head)):
            at = int(first.group(1))
            numbers = list(map(int, body[:at].split()))
            places = [*numbers[1::2], len(body) - at]
            for n, a, b in zip(numbers[::2], places, places[1:], strict=False):
                out.setdefault(n, (body[at + a : at + b], b""))
    return out


def _refs(head: bytes, key: bytes) -> list[int]:
    """The objects that a key names, one or a list of them."""
    m = re.search(rb"/" + key + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", head)
    return [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", m.group(1))] if m else []


class _Table(dict):
    """Codes without a text have none."""

    def __missing__(self, code: int) -> str:
        return ""


def _codes(body: bytes) -> tuple[int, dict[int, str]]:
    """(bytes a code, code to text) of a font's map to Unicode."""
    table: dict[int, str] = _Table()
    width = 1
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    for part in re.findall(rb"beginbfchar(.*?)endbfchar", body, re.S):
        for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
            width = max(width, len(a) // 2)
            table[int(a, 16)] = text(b)
    for part in re.findall(rb"beginbfrange(.*?)endbfrange", body, re.S):
        for a, b, c, several in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[([^\]]*)\])", part):
            width = max(width, len(a) // 2)
            lo, hi = int(a, 16), min(int(b, 16), int(a, 16) + 0xFFFF)
            if c:
                start = text(c)
                table.update({lo + i: start[:-1] + chr(ord(start[-1]) + i) for i in range(hi - lo + 1)} if start else {})
            else:
                table.update({lo + i: text(x) for i, x in enumerate(re.findall(rb"<([0-9A-Fa-f]+)>", several))})
    return width, table


def _string(token: bytes, font: tuple[int, dict[int, str]] | None) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        raw = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: b"" if m.group(1)[-1:] == b"\n" else bytes([int(m.group(1), 8) & 255]) if m.group(1).isdigit() else _ESCAPES.get(m.group(1), m.group(1)), token[1:-1], flags=re.S)
    if font is None:
        return raw.decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")
    width, table = font
    if width == 1:
        return raw.decode("latin-1").translate(table)
    if width == 2 and not any(0xD8 <= b <= 0xDF for b in raw[::2]):
        return raw[: len(raw) // 2 * 2].decode("utf-16-be").translate(table)
    return "".join(table.get(int.from_bytes(raw[i : i + width], "big"), "") for i in range(0, len(raw), width))


def _page(body: bytes, fonts: dict[bytes, tuple[int, dict[int, str]]]) -> str:
    """The text that the page's operators show; moves to another line end a line, wide gaps inside of one are blanks."""
    out: list[str] = []
    held: list[bytes] = []
    font = None
    for m in _TOKEN.finditer(body):
        t = m.group(0)
        if not t[:1].isalpha() and t not in (b"'", b'"', b"T*"):
            held.append(t)
            continue
        if t == b"Tf" and len(held) > 1:
            font = fonts.get(held[-2][1:])
        elif t in (b"Td", b"TD") and len(held) > 1:
            if float(held[-1]) != 0:
                out.append("\n" * (2 if t == b"TD" or abs(float(held[-1])) > 20 else 1))
        elif t in (b"T*", b"Tm", b"ET") and out and out[-1] != "\n":
            out.append("\n")
        elif t in (b"Tj", b"'", b'"'):
            out += ["\n"] * (t != b"Tj") + [_string(x, font) for x in held[-1:] if x[:1] in b"(<"]
        elif t == b"TJ":
            for x in held:
                if x[:1] in b"(<":
                    out.append(_string(x, font))
                elif re.fullmatch(rb"[-+]?\d*\.?\d+", x) and float(x) < -200:
                    out.append(" ")
        held = []
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]*\n[ \t]*", "\n", "".join(out))).strip()


def pages(data: bytes) -> list[str]:
    """The text of each page in the order of the page tree. Not for encrypted files."""
    if not data.lstrip()[:5].startswith(b"%PDF"):
        raise ValueError("not a PDF")
    if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
        raise ValueError("this PDF is encrypted")
    objects = _objects(data)
    order: list[int] = []
    todo = [n for n, (head, _) in objects.items() if re.search(rb"/Type\s*/Pages\b", head) and b"/Parent" not in head]
    seen: set[int] = set()
    while todo:
        n = todo.pop(0)
        if n in seen or n not in objects:
            continue
        seen.add(n)
        kids = _refs(objects[n][0], b"Kids")
        if kids:
            todo = kids + todo
        else:
            order.append(n)
    order = order or [n for n, (head, _) in sorted(objects.items()) if re.search(rb"/Type\s*/Page\b(?!s)", head)]
    out = []
    for n in order:
        head = objects[n][0]
        named = head + b"".join(objects[r][0] for r in _refs(head, b"Resources") if r in objects)
        named += b"".join(objects[r][0] for r in _refs(named, b"Font") if r in objects)
        fonts = {}
        for name, ref in re.findall(rb"/([^\s/\[\]()<>]+)\s+(\d+)\s+\d+\s+R", named):
            for code in _refs(objects.get(int(ref), (b"", b""))[0], b"ToUnicode"):
                if code in objects:
                    fonts[name] = _codes(objects[code][1])
        out.append(_page(b"\n".join(objects[c][1] for c in _refs(head, b"Contents") if c in objects), fonts))
    return out


def write(texts: list[str]) -> bytes:
    """A PDF with one page for each text, its lines one below the other; any character, by a map to Unicode."""
    letters = sorted({c for t in texts for c in t if c not in "\r\n"})
    code = {c: f"{i:04x}" for i, c in enumerate(letters, 1)}
    entries = [f"<{i}> <{c.encode('utf-16-be').hex()}>" for c, i in code.items()]
    table = "".join(f"{len(part)} beginbfchar\n" + "\n".join(part) + "\nendbfchar\n" for part in (entries[i : i + 100] for i in range(0, len(entries), 100)))
    body: list[bytes] = [b"<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Count {len(texts)} /Kids [{' '.join(f'{5 + 2 * i} 0 R' for i in range(len(texts)))}] >>".encode(), b"<< /Type /Font /Subtype /Type0 /BaseFont /Plain /Encoding /Identity-H /ToUnicode 4 0 R >>"]

    def stream(data: bytes) -> bytes:
        packed = zlib.compress(data, 1)
        return f"<< /Length {len(packed)} /Filter /FlateDecode >>\nstream\n".encode() + packed + b"\nendstream"

    body.append(stream(table.encode()))
    for i, t in enumerate(texts):
        lines = [f"<{''.join(map(code.__getitem__, line.strip(chr(13))))}> Tj" for line in t.replace("\r", "").split("\n")]
        body.append(f"<< /Type /Page /Parent 2 0 R /Contents {6 + 2 * i} 0 R /Resources << /Font << /F1 3 0 R >> >> >>".encode())
        body.append(stream(("BT /F1 10 Tf " + " 0 -12 Td ".join(lines) + " ET").encode()))
    out, places = bytearray(b"%PDF-1.5\n"), []
    for n, b in enumerate(body, 1):
        places.append(len(out))
        out += f"{n} 0 obj\n".encode() + b + b"\nendobj\n"
    table_at = len(out)
    out += f"xref\n0 {len(body) + 1}\n0000000000 65535 f \n".encode() + b"".join(f"{p:010d} 00000 n \n".encode() for p in places)
    return bytes(out + f"trailer << /Size {len(body) + 1} /Root 1 0 R >>\nstartxref\n{table_at}\n%%EOF\n".encode())
