"""Parsers of file contents: plain Python functions from a text or bytes to a title and elements. They run in Arrow batches."""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Callable
from dataclasses import dataclass, field
from html import escape, unescape
from pathlib import PureWindowsPath
from xml.etree import ElementTree

from lumbra.sources import pdf as pdf_pages

TEXT = {".txt", ".text", ".log", ".md", ".mkd", ".markdown", ".html", ".htm", ".xhtml", ".csv", ".json"}
TYPE_OF = {
    ".pdf": "pdf", ".docx": "docx", ".doc": "docx", ".md": "md", ".markdown": "md", ".mkd": "md", ".html": "html", ".htm": "html", ".xhtml": "html",
    ".txt": "txt", ".text": "txt", ".log": "txt", ".csv": "csv", ".json": "json",
}


@dataclass
class Element:
    type: str
    text: str = ""
    level: int | None = None
    language: str | None = None
    ordered: bool | None = None
    items: list[str] | None = None
    headers: list[str] | None = None
    rows: list[list[str]] | None = None
    section: tuple[str, ...] = ()
    page: int | None = None


@dataclass
class Parsed:
    title: str
    elements: list[Element] = field(default_factory=list)
    metadata: dict[str, str] = field(default_factory=dict)
    error: str | None = None


def extension(source: str) -> str:
    return PureWindowsPath(source).suffix.lower()


def title_of(source: str) -> str:
    return PureWindowsPath(source).stem or "Untitled"


def decode(data: bytes) -> str:
    return data.decode("utf-8", "replace").removeprefix("﻿")


def text(content: str, source: str) -> Parsed:
    """Paragraphs between blank lines, with the lines they span."""
    out, at = Parsed(title_of(source)), 1
    for part in re.split(r"(\n\s*\n)", content):
        if part.strip():
            start = at + part[: len(part) - len(part.lstrip())].count("\n")
            out.elements.append(Element("paragraph", part.strip(), level=start))
        at += part.count("\n")
    return out


_FENCE = r"^[ \t]*```(?P<language>\w*)[ \t\r]*(?:\n|\Z)(?P<code>.*?)(?:^[ \t]*```\w*[ \t\r]*(?:\n|\Z)|\Z)"
_HEADING = r"^[ \t]*(?P<marks>\#{1,6})[ \t]+(?P<name>[^\n]*\S)[ \t\r]*(?:\n|\Z)"
_ITEM = r"^[ \t]*(?=[-*+][ ][ \t]*[^\s])(?:-[ ])?(?:\*[ ])?(?:\+[ ])?(?P<item>[^\n]*\S)[ \t\r]*(?:\n|\Z)"
_RULE = r"^[ \t]*(?P<rule>---|\*\*\*|___)[ \t\r]*(?:\n|\Z)"
#: One block after the other, so that every character is in exactly one: a fence takes all up to its end or the text's.
_BLOCK = re.compile(rf"{_FENCE}|{_HEADING}|{_ITEM}|{_RULE}|^(?P<line>[^\n]*)(?:\n|\Z)", re.S | re.M)


def markdown(content: str, source: str) -> Parsed:
    """The elements of each section in order: fenced code, one-line items and rules where they stand, then the section's other lines as one paragraph.

    A section begins at a heading and is named by the headings above it. A level-1 heading before anything else is the title. A fence without an end holds the rest.
    """
    blocks = [m for m in _BLOCK.finditer(content) if m.end() > m.start()]
    out, path = Parsed(title_of(source)), {}
    heads = [i for i, m in enumerate(blocks) if m["marks"]]
    if heads and len(blocks[heads[0]]["marks"]) == 1 and not any(m.group().strip() for m in blocks[: heads[0]]):
        out.title = blocks[heads[0]]["name"]
        blocks, heads = blocks[heads[0] + 1 :], [i - heads[0] - 1 for i in heads[1:]]
    for start, end in zip([0, *heads], [*heads, len(blocks)], strict=True):
        part = blocks[start:end]
        if part and part[0]["marks"]:
            level = len(part[0]["marks"])
            path = {k: v for k, v in path.items() if k < level} | {level: part[0]["name"]}
        section = tuple(path.values())
        for m in part:
            if m["marks"]:
                out.elements.append(Element("heading", m["name"], level=len(m["marks"]), section=section))
            elif m["code"] is not None:
                out.elements.append(Element("code_block", m["code"].strip(), language=m["language"], section=section))
            elif m["item"] is not None:
                out.elements.append(Element("list", items=[m["item"]], ordered=False, section=section))
            elif m["rule"]:
                out.elements.append(Element("separator", section=section))
        text = " ".join(m["line"].strip() for m in part if m["line"] is not None).strip()
        if text:
            out.elements.append(Element("paragraph", text, section=section))
    return out


# Elements that hold a block of a page's text, and those whose contents aren't text.
HTML_BLOCKS = frozenset("h1 h2 h3 h4 h5 h6 p div li ul ol table tr td th pre blockquote article section header footer main nav aside dl dt dd form figure figcaption body html head".split())
HTML_FLOW = frozenset("p div blockquote article section header footer main nav aside figure figcaption form dl dt dd".split())
HTML_CELLS = frozenset(["li", "td", "th"])
HTML_HIDDEN = frozenset(["script", "style", "noscript"])


#: A comment, a tag, or a declaration; everything between them is text. One scan, whatever is left open.
_HTML_TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<(/?)([A-Za-z][\w:-]*)([^<>]*)>|<[!?][^<>]*>", re.S)
_HTML_LANGUAGE = re.compile(r"\bclass\s*=\s*[\"']?[^\"'>]*?\blang(?:uage)?-([\w+#-]+)", re.I)


class _Page:
    """Builds the elements while the tags come: open blocks are a stack, each with its own text, so nested blocks keep theirs and nothing comes twice."""

    @dataclass
    class Open:
        tag: str
        at: int | None = None
        text: list[str] = field(default_factory=list)
        items: list[str] = field(default_factory=list)
        rows: list[list[tuple[str, str]]] = field(default_factory=list)
        inside: list[str] = field(default_factory=list)

    def __init__(self, content: str) -> None:
        self.title: str | None = None
        self.elements: list[Element | None] = []
        self.open = [self.Open("")]
        self.verbatim = 0
        self.language = ""
        at = 0
        while m := _HTML_TOKEN.search(content, at):
            self.data(content[at : m.start()])
            at, tag = m.end(), (m.group(2) or "").lower()
            if tag in HTML_HIDDEN or tag == "title":
                if not m.group(1):
                    end = re.compile(rf"</{tag}\s*>", re.I).search(content, at)
                    if tag == "title" and self.title is None:
                        self.title = unescape(re.sub(r"<[^>]*>", " ", content[at : end.start() if end else len(content)]))
                    at = end.end() if end else len(content)
            elif tag:
                self.end(tag) if m.group(1) else self.start(tag, m.group(3))
        self.data(content[at:])
        while len(self.open) > 1:
            self.close_to(self.open[-1].tag)
        self.end_text()

    def start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.open[-1].text.append("\n")
        elif tag == "hr":
            self.end_text()
            self.elements.append(Element("separator"))
        elif tag in HTML_FLOW and self.open[-1].tag in HTML_CELLS:
            # paragraphs of an item or cell are lines of its text
            self.open[-1].text.append("\n")
            self.open[-1].inside.append(tag)
        elif tag in HTML_BLOCKS:
            self.before(tag)
            self.elements.append(None)
            self.open.append(self.Open(tag, len(self.elements) - 1))
            self.verbatim += tag == "pre"
        if tag in ("pre", "code"):
            named = _HTML_LANGUAGE.search(attributes)
            self.language = named.group(1) if named else self.language if tag == "code" else ""

    def before(self, tag: str) -> None:
        """What ends by itself where a block begins: a paragraph always, items and cells at their next one."""
        if self.open[-1].tag == "p":
            self.close_to("p")
        ends = {"li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "dt": ("dt", "dd"), "dd": ("dt", "dd")}.get(tag, ())
        while self.open[-1].tag in ends:
            self.close_to(self.open[-1].tag)
        if tag not in ("li", "tr", "td", "th"):
            self.end_text()

    def end(self, tag: str) -> None:
        if tag in self.open[-1].inside:
            self.open[-1].inside.remove(tag)
            self.open[-1].text.append("\n")
        else:
            # a stray end tag doesn't close what is around the cell or item that it stands in
            cell = 0 if tag not in HTML_FLOW else max((i for i, o in enumerate(self.open) if o.tag in HTML_CELLS), default=0)
            if any(o.tag == tag for o in self.open[cell:]):
                self.close_to(tag)

    def data(self, text: str) -> None:
        if text:
            text = unescape(text)
            self.open[-1].text.append(text if self.verbatim else re.sub(r"[ \t\r\f]+", " ", text))

    def end_text(self) -> None:
        """The open block's text so far as an element of its own, as another block follows inside."""
        o = self.open[-1]
        if o.tag not in ("li", "td", "th", "pre"):
            self.elements += [Element("paragraph", t) for t in self.paragraphs(o)]
            o.text.clear()

    def paragraphs(self, o: Open) -> list[str]:
        lines = "\n".join(x.strip() for x in "".join(o.text).split("\n"))
        found = [p.strip() for p in (re.split(r"\n{2,}", lines) if o.tag in ("", "body", "html") else [re.sub(r"\n{2,}", "\n", lines)])]
        return [" ".join(p.split("\n")) if o.tag in ("", "body", "html") else p for p in found if p]

    def close_to(self, tag: str) -> None:
        while True:
            o = self.open.pop()
            self.verbatim -= o.tag == "pre"
            self.finish(o)
            if o.tag == tag:
                return

    def holder(self, *tags: str) -> Open | None:
        return next((o for o in reversed(self.open) if o.tag in tags), None)

    def finish(self, o: Open) -> None:
        text = "\n".join(self.paragraphs(o))
        if o.tag == "pre":
            code = "".join(o.text).strip("\n")
            self.elements[o.at] = Element("code_block", code, language=self.language) if code.strip() else None
        elif o.tag == "li":
            around = self.holder("ul", "ol")
            if around is not None and text:
                around.items.append(text)
            elif text:
                self.elements[o.at] = Element("list", items=[text], ordered=False)
        elif o.tag in ("ul", "ol"):
            self.elements[o.at] = Element("list", items=o.items, ordered=o.tag == "ol") if o.items else None
        elif o.tag in ("td", "th"):
            around = self.holder("table")
            if around is not None:
                around.rows = around.rows or [[]]
                around.rows[-1].append((o.tag, text))
        elif o.tag == "tr":
            around = self.holder("table")
            if around is not None:
                around.rows.append([])
        elif o.tag == "table":
            self.elements[o.at] = _table(o.rows)
        elif o.tag[1:].isdigit():
            self.elements[o.at] = Element("heading", text, level=int(o.tag[1:])) if text else None
        else:
            parts = [Element("paragraph", t) for t in self.paragraphs(o)]
            # a block without others inside stands where it began
            if parts and len(self.elements) == o.at + 1:
                self.elements[o.at] = parts.pop(0)
            self.elements += parts

    def finished(self) -> list[Element]:
        return [e for e in self.elements if e is not None]


def _table(rows: list[list[tuple[str, str]]]) -> Element | None:
    """The first row's header cells, or else the first row, are the headers."""
    rows = [r for r in rows if r]
    if not rows:
        return None
    heads = [c for tag, c in rows[0] if tag == "th"] or [c for _, c in rows[0]]
    return Element("table", headers=heads, rows=[[c for _, c in r] for r in rows[1:]])


def html(content: str, source: str) -> Parsed:
    """Elements of the page in reading order. Every text is in one element: a block that holds others gives only its own text, and a list or table all of its items or
    cells. Text outside of blocks is split into paragraphs at empty lines. Scripts and styles aren't text; character references are decoded."""
    page = _Page(content)
    return Parsed(" ".join((page.title or "").split()) or title_of(source), page.finished())


def csv_table(content: str, source: str) -> Parsed:
    """One table; the first of several rows is the header, a single row is data. Rows may differ in length."""
    rows = [r for r in csv.reader(io.StringIO(content)) if r]
    out = Parsed(title_of(source), metadata={"rows": str(max(0, len(rows) - 1)), "columns": str(len(rows[0]) if rows else 0)})
    if rows:
        out.elements.append(Element("table", headers=rows[0] if len(rows) > 1 else [], rows=rows[1:] if len(rows) > 1 else rows))
    return out


def csv_text(content: str) -> str:
    """'record i: header: value, ...' for each row; rows of another length than the header's are an error."""
    rows = list(csv.reader(io.StringIO(content)))
    if not rows:
        return ""
    if any(len(r) != len(rows[0]) for r in rows):
        raise ValueError("wrong number of fields")
    return "\n".join(f"记录 {i}: " + ", ".join(f"{h}: {v}" for h, v in zip(rows[0], r, strict=True)) for i, r in enumerate(rows[1:], 1))


def csv_document(content: str, source: str) -> Parsed:
    """A CSV file as a text of records, with its numbers of rows and columns and its headers; rows of another length are an error."""
    rows = list(csv.reader(io.StringIO(content)))
    heads = rows[0] if rows else []
    return Parsed(title_of(source), [Element("paragraph", csv_text(content))] if rows else [], {"rows": str(max(0, len(rows) - 1)), "columns": str(len(heads)), "headers": ",".join(heads)})


def json_document(content: str, source: str) -> Parsed:
    """A JSON file as an indented text; its kind is object, array or value."""
    value = json.loads(content)
    kind = {dict: "object", list: "array"}.get(type(value), "value")
    return Parsed(title_of(source), [Element("paragraph", json.dumps(value, indent=2, ensure_ascii=False))], {"json_type": kind})


def json_kind(value: object) -> str:
    kinds = ((bool, "boolean"), (dict, "object"), (list, "array"), (str, "string"), ((int, float), "number"))
    return "null" if value is None else next((name for kind, name in kinds if isinstance(value, kind)), "unknown")


def json_block(content: str, source: str) -> Parsed:
    """The value, indented and with sorted keys, as a code block."""
    value = json.loads(content)
    pretty = json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False)
    return Parsed(title_of(source), [Element("code_block", pretty, language="json")], {"json_type": json_kind(value)})


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx(data: bytes, source: str) -> Parsed:
    """Paragraphs, headings by style, and tables of a Word file, with its core properties; if the XML can't be read, the text between its tags."""
    out = Parsed(title_of(source))
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        if "docProps/core.xml" in names:
            try:
                for e in ElementTree.fromstring(z.read("docProps/core.xml")):
                    if e.text and e.text.strip():
                        out.metadata[e.tag.rpartition("}")[2]] = e.text.strip()
            except ElementTree.ParseError:
                pass
        body = z.read("word/document.xml")
    try:
        root = ElementTree.fromstring(body)
    except ElementTree.ParseError:
        plain = re.sub(r"<[^>]+>", "", re.sub(r"</w:p>", "\n", decode(body)))
        out.elements = [Element("paragraph", x.strip()) for x in plain.split("\n") if x.strip()]
        return out

    def words(p: ElementTree.Element) -> str:
        parts = {f"{_W}t": lambda e: e.text or "", f"{_W}tab": lambda e: "\t", f"{_W}br": lambda e: "\n"}
        return "".join(parts[e.tag](e) for e in p.iter() if e.tag in parts).strip()

    for block in root.find(f"{_W}body") if root.find(f"{_W}body") is not None else ():
        if block.tag == f"{_W}tbl":
            rows = [["\n".join(filter(None, map(words, c.iter(f"{_W}p")))) for c in r.findall(f"{_W}tc")] for r in block.findall(f"{_W}tr")]
            if rows:
                out.elements.append(Element("table", headers=rows[0], rows=rows[1:]))
        elif block.tag == f"{_W}p" and (t := words(block)):
            style = block.find(f"{_W}pPr/{_W}pStyle")
            name = style.get(f"{_W}val", "") if style is not None else ""
            level = re.fullmatch(r"(?:heading|标题)\s*([1-9])|([1-9])", name, re.I)
            if name.lower() == "title":
                out.title = t
                out.elements.append(Element("heading", t, level=1))
            elif level:
                out.elements.append(Element("heading", t, level=int(level.group(1) or level.group(2))))
            else:
                out.elements.append(Element("paragraph", t))
    if "title" in out.metadata and out.title == title_of(source):
        out.title = out.metadata["title"]
    return out


def write_docx(paragraphs: list[str]) -> bytes:
    """A Word file of these paragraphs. Characters that XML can't hold are left out."""
    held = [re.sub(r"[^\t\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]", "", p) for p in paragraphs]
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(p, quote=False)}</w:t></w:r></w:p>' for p in held)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>')
        z.writestr("word/document.xml", f'<w:document xmlns:w="{_W[1:-1]}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def page_elements(pages: list[str]) -> tuple[list[Element], bool]:
    """Elements of extracted page texts, and whether the file looks scanned: more than half of its pages are empty.

    A paragraph of one line, shorter than 80 bytes and without an end mark, is a heading.
    """
    out: list[Element] = []
    for n, page in enumerate(pages, 1):
        for part in filter(None, map(str.strip, re.split(r"\n\s*\n", page))):
            head = "\n" not in part and len(part.encode()) < 80 and part[-1] not in ".!?。！？;；:："
            out.append(Element("heading" if head else "paragraph", part, level=1 if head else None, page=n))
    return out, bool(pages) and 2 * sum(not p.strip() for p in pages) > len(pages)


def pdf(data: bytes, source: str) -> Parsed:
    """Pages by an installed PDF library, else by the reader for plain text documents; a file without any text is an error, not an empty document."""
    try:
        from pypdf import PdfReader

        pages = [p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages]
    except ImportError:
        pages = pdf_pages.pages(data)
    if not any(p.strip() for p in pages):
        raise ValueError("no text in this PDF")
    elements, scanned = page_elements(pages)
    return Parsed(title_of(source), elements, {"page_count": str(len(pages)), **({"warning": "scanned"} if scanned else {})})


#: What a file's document is made of, where that isn't its elements.
DOCUMENTS: dict[str, Callable[..., Parsed]] = {"csv": csv_document, "json": json_document}
PARSERS: dict[str, Callable[..., Parsed]] = {"txt": text, "md": markdown, "html": html, "csv": csv_table, "json": json_block, "docx": docx, "pdf": pdf}


def register(kind: str, parser: Callable[..., Parsed], *extensions: str) -> None:
    """A parser of your own, for a type and its extensions."""
    PARSERS[kind] = parser
    for e in extensions:
        TYPE_OF[e.lower()] = kind


def parse(data: bytes, source: str, as_document: bool = False) -> Parsed:
    """By extension, text if unknown; as_document reads CSV and JSON as texts instead of tables and code. What a parser can't read is an error in the result, never an exception."""
    kind = TYPE_OF.get(extension(source), "txt")
    try:
        return (DOCUMENTS.get(kind, PARSERS[kind]) if as_document else PARSERS[kind])(data if kind in ("docx", "pdf") else decode(data), source)
    except Exception as e:  # noqa: BLE001
        return Parsed(title_of(source), error=f"{type(e).__name__}: {e}")


def render(e: Element) -> str:
    """An element as text: table rows with |, items with their marks, code as it is."""
    if e.type == "table":
        return "\n".join(" | ".join(r) for r in [*([e.headers] if e.headers else []), *(e.rows or [])])
    if e.type == "list":
        return "\n".join(f"{i}. {x}" if e.ordered else f"- {x}" for i, x in enumerate(e.items or [], 1))
    if e.type == "image":
        return f"[Image: {e.text}]"
    return "---" if e.type == "separator" else e.text
