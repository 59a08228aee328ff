"""Problem 2: markup in texts, and clean text that keeps headings, lists, tables, code and formulas."""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML, as the standard lists them, and those that wikis add.
BLOCK = "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main nav noscript ol optgroup option p pre script section select style summary table tbody td template textarea tfoot th thead title tr ul".split()
INLINE = "a abbr acronym area audio b base basefont bdi bdo big br button canvas cite code col colgroup data datalist del dfn em embed font frame frameset i iframe img input ins kbd label link map mark meta meter object output param picture progress q rp rt ruby s samp small source span strike strong sub sup svg time track tt u var video wbr".split()
WIKI = "ref references nowiki syntaxhighlight gallery poem math onlyinclude includeonly noinclude pre source".split()
# LaTeX commands that take an argument, and those that stand alone.
WITH_ARGUMENT = "author begin bibliography caption chapter cite citep citet date documentclass emph end eqref footnote frac hat href include includegraphics input label mathbb mathbf mathcal mathrm newcommand overline paragraph part ref section sqrt subparagraph subsection subsubsection textbf textit textrm textsc textsf textsl texttt title underline url usepackage vec".split()
ALONE = "alpha approx bar beta bigskip cdot cdots centering clearpage cos delta dots epsilon eta exists forall gamma geq hfill hline in infty int item kappa lambda langle ldots left leq ln log maketitle mu nabla neq newline newpage noindent omega par partial phi pi prod psi quad rangle rho right rightarrow sigma sim sin sum tableofcontents tau theta times toprule varepsilon".split()

_names = "|".join(sorted({*BLOCK, *INLINE, *WIKI}, key=len, reverse=True))
TAG = re.compile(rf"<(/?)({_names})((?:\s+[\w:-]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>]+))?|\s*/)*)\s*>", re.I)
COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<!DOCTYPE[^>]*>|<\?xml[^>]*\?>", re.S | re.I)
#: Tags of any other name, by grammar: end tags, names with a hyphen or prefix, quoted attributes, closed in themselves. array<float> is none.
OTHER_TAG = re.compile(r"</[A-Za-z][\w.:-]*\s*>|(?<!\w)<[A-Za-z][\w.]*(?:[-:][\w.]+)+(?:\s[^<>]*)?>|(?<!\w)<[A-Za-z][\w.]*(?:\s+[\w:-]+\s*=\s*(?:\"[^\"<>]*\"|'[^'<>]*'))+\s*/?>|(?<!\w)<[A-Za-z][\w.]*\s*/>")
ESCAPED = re.compile(rf"&lt;/?(?:{_names})\b(?:[^<>&]|&(?!lt;|gt;))*&gt;|&lt;!--", re.I)
ENTITY = re.compile(r"&(#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
DROPPED = re.compile(r"<(script|style|noscript|template|title)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)

#: A command of any name with an argument is LaTeX; alone, only the commands listed: other names stand in paths and patterns too.
LATEX = re.compile(rf"(?<![\w:\\])\\[A-Za-z]{{2,}}\*?\s*(?:\[[^\]\n]*\])?\{{|\\(?:{'|'.join(WITH_ARGUMENT)})\*?\s*[\[{{]|(?<![\w:\\])\\(?:{'|'.join(ALONE)})(?![A-Za-z])|\\[\[\]()]|(?<![\w\\])\\[%&#_](?!\w)")
#: A formula between dollar signs on one line: a longer one has a command, an exponent or an index in braces.
MATH = re.compile(r"\$(?=[^$\n]{0,200}[\\_^{=]|[^$\n]*(?:\\[A-Za-z]{2}|\^[{\w]|_\{))(?!\s)[^$\n]+(?<!\s)\$(?!\d)")
_DISPLAY = {"equation", "align", "gather", "displaymath", "multline", "eqnarray", "math"}
_FORMULA = re.compile(r"\\(begin|end)\{(" + "|".join(sorted(_DISPLAY)) + r")\*?\}|\$\$|\\[\[\]()]|<(/?)math\b[^>]*>", re.I)
_CLOSES = {"\\]": "\\[", "\\)": "\\("}


def formulas(text: str) -> list[tuple[int, int]]:
    """Start and end of the displayed and inline formulas between signs that open and close, the outermost of nested ones; one scan, whatever their length."""
    out: list[tuple[int, int]] = []
    opened: dict[str, int] = {}

    def close(kind: str, end: int) -> None:
        start = opened.pop(kind, None)
        if start is not None:
            while out and out[-1][0] >= start:
                out.pop()
            out.append((start, end))

    for m in _FORMULA.finditer(text):
        sign = m.group(0)
        if m.group(2):
            kind = m.group(2).lower()
            if m.group(1).lower() == "begin":
                opened[kind] = m.start()
            else:
                close(kind, m.end())
        elif sign == "$$":
            if sign in opened:
                close(sign, m.end())
            else:
                opened[sign] = m.start()
        elif sign in _CLOSES:
            close(_CLOSES[sign], m.end())
        elif sign[0] == "\\":
            opened[sign] = m.start()
        elif m.group(3):
            close("<math", m.end())
        else:
            opened["<math"] = m.start()
    return out


def _held_formulas(text: str, hold) -> str:
    parts, last = [], 0
    for a, b in formulas(text):
        body = text[a:b]
        if body[0] == "<":
            inner = re.sub(r"</?math\b[^>]*>", "", body, flags=re.I).strip()
            told = re.match(r"<math\b[^>]*?\balttext\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", body, re.I)
            tex = html.unescape(next(g for g in told.groups() if g is not None)) if told else TAG.sub("", inner)
            body = f"${tex or inner}$" if tex or inner else ""
        parts += [text[last:a], hold(body) if body.strip("$") else ""]
        last = b
    return "".join([*parts, text[last:]])


FENCE = re.compile(r"^[ \t]*(```+|~~~+)[ \t]*([\w+#.-]*)[^\n]*\n(.*?)(?:^[ \t]*\1[ \t]*$|\Z)", re.S | re.M)
CODE_TAG = re.compile(r"<(pre|syntaxhighlight|source)\b([^>]*)>(.*?)(?:</\1\s*>|\Z)", re.S | re.I)
VERBATIM = re.compile(r"\\begin\{(verbatim|lstlisting|minted)\*?\}(?:\[[^\]]*\]|\{[^}]*\})?(.*?)(?:\\end\{\1\*?\}|\Z)", re.S)
FRONT = re.compile(r"\A\s*---[ \t]*\n(?:[\w-]+[ \t]*:[^\n]*\n|[ \t]+[^\n]*\n|- [^\n]*\n)+---[ \t]*(?:\n|\Z)")
HEADING = re.compile(r"^[ ]{0,3}(#{1,6})[ \t]+(\S[^\n]*)$", re.M)
SETEXT = re.compile(r"^(\S[^\n]*)\n(={3,}|-{3,})[ \t]*$", re.M)
IMAGE = re.compile(r"!\[([^\]\n]*)\]\(([^()\s]+)(?:\s+\"[^\"\n]*\")?\)")
LINK = re.compile(r"(?<!!)\[([^\]\[\n]+)\]\(([^()\s]+)(?:\s+\"[^\"\n]*\")?\)")
STRONG = re.compile(r"(?<![\w*])\*\*(?=\S)([^*\n]+?)(?<=\S)\*\*(?![\w*])|(?<!\w)__(?=[^\W_])([^_\n]+?)(?<=[^\s_])__(?!\w)|~~(?=\S)([^~\n]+?)(?<=\S)~~")
#: Chinese text has no spaces around words, so there a Han character may touch the marks.
STRONG_HAN = re.compile(r"(?<!\*)\*\*(?=\S)(?=[^*\n]{1,200}\*|[^*\n]*[㐀-鿿])([^*\n]+?)(?<=\S)\*\*(?!\*)|(?<!_)__(?=[^\W_])(?=[^_\n]{1,200}_|[^_\n]*[㐀-鿿])([^_\n]+?)(?<=[^\s_])__(?!_)")
EM = re.compile(r"(?<![\w*\\])\*(?=[^\s*])([^*\n]+?)(?<=[^\s*])\*(?![\w*])|(?<![\w_\\])_(?=[^\s_])([^_\n]+?)(?<=[^\s_])_(?![\w_])")
CODE = re.compile(r"(?<!`)`([^`\n]+)`(?!`)")
MD_TABLE = re.compile(r"^[ \t]*(?:\|[ \t]*)?:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)+(?:\|[ \t]*)?$", re.M)
QUOTE = re.compile(r"^[ ]{0,3}>[ \t]?(?=\S)", re.M)
RULE = re.compile(r"^[ ]{0,3}(?:-{3,}|\*{3,}|_{3,}|(?:\* ){2,}\*|(?:- ){2,}-)[ \t]*$", re.M)
BULLET = re.compile(r"^([ \t]*)[-*+][ \t]+(?=\S)", re.M)
NUMBER = re.compile(r"^([ \t]*)(\d{1,3})[.)][ \t]+(?=\S)", re.M)

WIKI_HEADING = re.compile(r"^(={1,6})[ \t]*([^=\n]+?)[ \t]*\1[ \t]*$", re.M)
WIKI_LINK = re.compile(r"\[\[(?:([^\]\[|\n]*)\|)?([^\]\[|\n]+)\]\]")
TEMPLATE = re.compile(r"\{\{([^{}\n]*)\}\}")
WIKI_TABLE = re.compile(r"^\{\|.*?(?:^\|\}|\Z)", re.S | re.M)
APOSTROPHES = re.compile(r"'''''|'''|(?<!')''(?!')")
APOSTROPHE_PAIR = re.compile(r"('{2,5})(?=\S)([^'\n]+?)(?<=\S)\1")
EXTERNAL = re.compile(r"\[(https?://[^\s\]]+)(?:[ \t]+([^\]\n]+))?\]")
REF = re.compile(r"<ref\b[^>]*/\s*>|<ref\b[^>]*>.*?(?:</ref\s*>|(?=\n)|\Z)", re.S | re.I)
REDIRECT = re.compile(r"^#REDIRECT\b|^__(?:TOC|NOTOC|FORCETOC|NOEDITSECTION)__", re.M)


def entities(text: str) -> list[str]:
    return [m.group(0) for m in ENTITY.finditer(text) if m.group(1)[0] == "#" or m.group(1) + ";" in html.entities.html5]


def kinds(text: str) -> list[str]:
    """The kinds of markup in the text: html, markdown, wiki, latex. Signs that plain prose uses as well are none."""
    found = set()
    if TAG.search(text) or OTHER_TAG.search(text) or COMMENT.search(text) or ESCAPED.search(text) or entities(text):
        found.add("html")
    if LATEX.search(text) or VERBATIM.search(text) or MATH.search(text) or formulas(text):
        found.add("latex")
    if WIKI_HEADING.search(text) or WIKI_LINK.search(text) or TEMPLATE.search(text) or APOSTROPHE_PAIR.search(text) or REF.search(text) or WIKI_TABLE.search(text) or REDIRECT.search(text) or EXTERNAL.search(text):
        found.add("wiki")
    if (
        HEADING.search(text) or IMAGE.search(text) or LINK.search(text) or STRONG.search(text) or STRONG_HAN.search(text) or FENCE.search(text + "\n")
        or FRONT.search(text) or MD_TABLE.search(text) or CODE.search(text) or EM.search(text) or SETEXT.search(text) or RULE.search(text)
        or QUOTE.search(text) or len(BULLET.findall(text)) > 1 or len(NUMBER.findall(text)) > 1
    ):
        found.add("markdown")
    return sorted(found)


# Weights of the content region.

#: Elements that open a zone of a page; a word's weight depends on the innermost one, on whether it is in a link, and on its block.
ZONES = {"nav", "header", "footer", "aside", "form", "menu", "main", "article", "head", "script", "style", "noscript"}
BLOCKS = {"p", "li", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "dd", "dt", "figcaption", "div"}


def classes(tags: Iterator[tuple[str, bool, int]]) -> Iterator[tuple[str, int]]:
    """(class, words): the class of each tag and of the run of words after it, from (name, is end tag, words after it).

    Zones nest; a link ends with its end tag or with the next block.
    """
    zones: list[str] = []
    block, link = "-", False
    for name, end, words in tags:
        if name in ZONES:
            if not end:
                zones.append(name)
            elif name in zones:
                while zones.pop() != name:
                    pass
        if name in BLOCKS:
            block, link = ("-" if end else "h" if name[0] == "h" else name), False
        elif name == "a":
            link = not end
        zone = zones[-1] if zones else "-"
        yield f"<{name} {zone}", 1
        if words:
            yield f"w {zone} {'a' if link else '-'} {block}", words


def pages(n: int = 400) -> Iterator[list[tuple[str, bool, int, bool]]]:
    """Labelled pages made by rule: (tag, is end tag, words after it, is content). Menus, banners, sidebars, related links and footers are not content, however
    many words they have; headings, paragraphs, quotes, lists, tables and code are, with links among their words."""
    r = random.Random(2)
    for _ in range(n):
        page: list[tuple[str, bool, int, bool]] = []

        def put(spec: str, content: bool, page: list = page) -> None:
            for part in spec.split():
                name, _, words = part.partition(":")
                page.append((name.lstrip("/"), name[0] == "/", int(words or 0), content))

        def menu(links: int, page: list = page) -> None:
            item = r.choice(["li a:{} /a /li", "a:{} /a", "li a:{} /a", "td a:{} /a /td", "div a:{} /a /div", "a:{} /a br"])
            around = r.choice(["ul {} /ul", "div {} /div", "{}"])
            put(around.format(" ".join(item.format(r.randint(1, 6)) for _ in range(links))), False)

        put(f"html head title:{r.randint(1, 9)} /title" + r.choice([" script /script", " style /style", ""]) + " /head body", False)
        for zone in r.sample(["header", "nav", "div", "form"], r.randint(0, 3)):
            put(f"{zone}:{r.choice([0, 0, 3, 12])}", False)
            menu(r.randint(2, 40)) if zone != "form" else put("label:2 /label input button:1 /button", False)
            put(f"/{zone}", False)
        main = r.choice(["main", "article", "div", ""])
        put(main, True)
        for i in range(r.randint(2, 14)):
            kind = r.random()
            if kind < 0.1:
                put(f"div:{r.randint(5, 60)} " + f"br:{r.randint(3, 30)} " * r.randint(0, 3) + "/div", True)
            elif kind < 0.3:
                put(f"{r.choice(['h1', 'h2', 'h3'])}:{r.randint(1, 8)} /h2 p:{r.randint(8, 80)} /p", True)
            elif kind < 0.6:
                put(f"p:{r.randint(5, 60)} " + " ".join(f"{t}:{r.randint(1, 4)} /{t}:{r.randint(0, 20)}" for t in r.choices(["a", "b", "em", "code", "span"], k=r.randint(0, 4))) + " /p", True)
            elif kind < 0.75:
                put(f"{r.choice(['ul', 'ol'])} " + " ".join(f"li:{r.randint(2, 25)} {r.choice(['', '', 'a:3 /a:4', 'b:2 /b:3', 'br:4'])} /li" for _ in range(r.randint(2, 9))) + " /ul", True)
            elif kind < 0.87:
                put("table " + " ".join("tr " + " ".join(f"td:{r.randint(1, 4)} /td" for _ in range(4)) + " /tr" for _ in range(r.randint(2, 9))) + " /table", True)
            else:
                put(f"{r.choice(['pre', 'blockquote'])}:{r.randint(5, 60)} /pre", True)
            if r.random() < 0.08 and i:
                put(f"aside:{r.randint(2, 30)}", False)
                menu(r.randint(1, 6))
                put("/aside", False)
        if main:
            put(f"/{main}", True)
        for zone in r.sample(["footer", "nav", "aside", "div"], r.randint(0, 3)):
            put(f"{zone}:{r.choice([0, 4, 15, 90] if zone != 'div' else [0])}", False)
            menu(r.randint(0, 30))
            put(f"/{zone}", False)
        put("/body /html", False)
        yield page


#: Weight of a word of a class that no page has, and of such a tag.
UNKNOWN_WORD, UNKNOWN_TAG = 0.5, -0.3


def fit(labelled: Iterator[list[tuple[str, bool, int, bool]]]) -> dict[str, float]:
    """Log-odds of each class of words and each tag to stand in content, smoothed. Words score above zero, those of menus and footers hardly; tags below."""
    yes: Counter = Counter()
    no: Counter = Counter()
    for page in labelled:
        labels = [c for _, _, w, c in page for _ in range(2 if w else 1)]
        for (c, n), content in zip(classes((t, e, w) for t, e, w, _ in page), labels, strict=True):
            for key in (c, c.rsplit(" ", 2)[0] if c[0] == "w" else c.split()[0]):
                (yes if content else no)[key] += n
    weights = {t: math.log((yes[t] + 0.5) / (no[t] + 0.5)) for t in {*yes, *no}}
    return {t: max(0.02, min(1.0, w)) if t[0] == "w" else max(-4.0, min(-0.05, w)) for t, w in weights.items()}


WEIGHTS = fit(pages())


def weight(c: str) -> float:
    """Of a class, else of its zone's words or its tag anywhere."""
    short, other = (c.rsplit(" ", 2)[0], UNKNOWN_WORD) if c[0] == "w" else (c.split()[0], UNKNOWN_TAG)
    return WEIGHTS.get(c, WEIGHTS.get(short, other))


def region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous part with the largest sum, in one scan; the earliest and then longest of equal ones. Empty if no score is positive."""
    best, where, run, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if run < 0:
            run, start = 0.0, i
        run += s
        if run > best or (run == best and where[0] == start and best > 0):
            best, where = run, (start, i + 1)
    return where


_WORD = re.compile(r"[㐀-鿿぀-ヿ가-힣]|\ue000\d+\ue001|[^\s㐀-鿿぀-ヿ가-힣\ue000]+")


def content_region(page: str, held: list[str] = ()) -> str:
    """The part of an HTML page that holds its content. Words before the first tag have the weight of a class that isn't known; a part that is held
    outside of the page, as code and formulas are, counts as all its words, and each character of scripts without blanks as one."""
    found = list(TAG.finditer(page))
    spans: list[tuple[int, int]] = []
    scores: list[float] = []

    def words(a: int, b: int, each: float) -> int:
        n = len(spans)
        for m in _WORD.finditer(page, a, b):
            spans.append(m.span())
            scores.append(each * len(held[int(m.group(0)[1:-1])].split()) if m.group(0)[0] == "\ue000" else each)
        return len(spans) - n

    words(0, found[0].start() if found else len(page), UNKNOWN_WORD)
    ends = [*[m.start() for m in found[1:]], len(page)]
    kinds_of = classes((m.group(2).lower(), bool(m.group(1)), int(bool(page[m.end() : e].strip()))) for m, e in zip(found, ends, strict=True))
    for m, e in zip(found, ends, strict=True):
        c, _ = next(kinds_of)
        spans.append(m.span())
        scores.append(weight(c) / (2 if m.group(1) else 1))
        if page[m.end() : e].strip():
            words(m.end(), e, weight(next(kinds_of)[0]))
    a, b = region(scores)
    if a == b:
        return ""
    # a block whose words are in the region belongs to it with all its words and links, as do the tags that open right before it, unless they open another zone
    inside = lambda i: (m := TAG.match(page, spans[i][0])) is None or m.group(2).lower() not in BLOCK
    while a > 0 and inside(a) and inside(a - 1):
        a -= 1
    while b < len(spans) and inside(b - 1) and inside(b):
        b += 1
    tag = lambda i: page[spans[i][0]] == "<" and not re.match(rf"</?(?:{'|'.join(ZONES)}|body|html)\b", page[spans[i][0] : spans[i][1]], re.I)
    while a > 0 and tag(a - 1) and page[spans[a - 1][0] + 1] != "/":
        a -= 1
    while b < len(spans) and tag(b) and page[spans[b][0] + 1] == "/":
        b += 1
    return page[spans[a][0] : spans[b - 1][1]]


def _without_others(text: str) -> str:
    """Without tags of names that HTML doesn't have, and the start tags that their end tags prove."""
    names = {m.group(1) for m in re.finditer(r"</([A-Za-z][\w.:-]*)\s*>", text) if not TAG.fullmatch(m.group(0))}
    text = OTHER_TAG.sub(lambda m: m.group(0) if TAG.fullmatch(m.group(0)) else "", text)
    return re.sub(r"<([A-Za-z][\w.:-]*)(?:\s[^<>]*)?>", lambda m: "" if m.group(1) in names else m.group(0), text) if names else text


_HOLD = re.compile("\ue000(\\d+)\ue001")


def clean(text: str) -> str:
    """Plain text with structure: '# ' headings, '- ' and '1. ' items, 'a | b' table rows, fenced code, formulas in their signs."""
    held: list[str] = []
    text = text.replace("\r\n", "\n").replace("\ue000", "").replace("\ue001", "")

    def hold(s: str) -> str:
        held.append(s)
        return f"\ue000{len(held) - 1}\ue001"

    def code(language: str, body: str, tags: bool = False) -> str:
        if tags:
            body = html.unescape(re.sub(r"</?code\b[^>]*>", "", body, flags=re.I))
        return "\n\n" + hold(f"```{language}\n{body.strip(chr(10))}\n```") + "\n\n"

    if ESCAPED.search(text):
        text = html.unescape(text)
    text = FRONT.sub("", text)
    text = FENCE.sub(lambda m: code(m.group(2), m.group(3)), text + "\n")
    lang = re.compile(r"(?:language-|lang=[\"']?)([\w+#-]+)", re.I)
    text = CODE_TAG.sub(lambda m: code((lang.findall(m.group(2) + m.group(3)[:80]) or [""])[0], m.group(3), True), text)
    text = VERBATIM.sub(lambda m: code("", m.group(2)), text)
    text = _held_formulas(text, hold)
    text = MATH.sub(lambda m: hold(m.group(0)), text)
    wiki = bool(WIKI_HEADING.search(text) or WIKI_LINK.search(text) or WIKI_TABLE.search(text))
    latex = bool(re.search(r"\\(?:begin|section|documentclass|subsection)\b", text))
    if TAG.search(text) or OTHER_TAG.search(text) or COMMENT.search(text):
        text = REF.sub("", COMMENT.sub("", DROPPED.sub("", text)))
        text = re.sub(r"<nowiki>(.*?)</nowiki>", lambda m: m.group(1), text, flags=re.S)
        if re.search(r"<(?:html|body|nav|header|footer|aside)\b", text, re.I):
            text = content_region(text, held)
        text = re.sub(r"<h([1-6])\b[^>]*>\s*(.*?)\s*</h\1\s*>", lambda m: f"\n\n{'#' * int(m.group(1))} {m.group(2)}\n\n", text, flags=re.S | re.I)

        def table(m: re.Match) -> str:
            rows = re.findall(r"<tr\b[^>]*>(.*?)(?=<tr\b|</tr\s*>|</table|\Z)", m.group(1), re.S | re.I)
            cells = [re.findall(r"<t[dh]\b[^>]*>(.*?)(?=<t[dh]\b|</t[dh]\s*>|\Z)", r, re.S | re.I) for r in rows]
            return "\n\n" + "\n".join(" | ".join(TAG.sub("", c).strip() for c in r) for r in cells if r) + "\n\n"

        text = re.sub(r"<table\b[^>]*>(.*?)(?:</table\s*>|\Z)", table, text, flags=re.S | re.I)

        def ordered(m: re.Match) -> str:
            n = iter(range(1, 10**9))
            return re.sub(r"<li\b[^>]*>\s*", lambda _: f"\n{next(n)}. ", m.group(1), flags=re.I)

        text = re.sub(r"<ol\b[^>]*>(.*?)(?:</ol\s*>|\Z)", ordered, text, flags=re.S | re.I)
        text = re.sub(r"<li\b[^>]*>\s*", "\n- ", text, flags=re.I)
        text = _without_others(text)
        text = TAG.sub(lambda m: "\n" if m.group(2).lower() == "br" else "\n\n" if m.group(2).lower() in BLOCK else "", text)
    text = re.sub(ENTITY, lambda m: html.unescape(m.group(0)), text)
    text = re.sub(ENTITY, lambda m: html.unescape(m.group(0)), text)
    if latex or LATEX.search(text):
        text = re.sub(r"(?m)(?<!\\)%[^\n]*$", "", text) if latex else text
        level = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}
        text = re.sub(r"\\(part|chapter|section|subsection|subsubsection|paragraph|title)\*?\s*\{([^{}]*)\}", lambda m: f"\n\n{'#' * level.get(m.group(1), 1)} {m.group(2)}\n\n", text)

        def tabular(m: re.Match) -> str:
            rows = re.split(r"\\\\", re.sub(r"\\(?:hline|toprule|midrule|bottomrule)", "", m.group(1)))
            return "\n\n" + "\n".join(" | ".join(c.strip() for c in r.split("&")) for r in rows if r.strip()) + "\n\n"

        text = re.sub(r"\\begin\{tabular\}\s*(?:\[[^\]]*\])?(?:\{[^}]*\})?(.*?)(?:\\end\{tabular\}|\Z)", tabular, text, flags=re.S)

        def numbered(m: re.Match) -> str:
            n = iter(range(1, 10**9))
            return re.sub(r"\\item\s*", lambda _: f"{next(n)}. ", m.group(1))

        text = re.sub(r"\\begin\{enumerate\}(.*?)(?:\\end\{enumerate\}|\Z)", numbered, text, flags=re.S)
        text = re.sub(r"[ \t]*\\item\b\s*", "- ", text)
        text = re.sub(r"\\(?:documentclass|usepackage|label|ref|cite[pt]?|bibliography|begin|end|include|input)\*?\s*(?:\[[^\]]*\])?(?:\{[^{}]*\})?", "", text)
        for _ in range(3):
            text = re.sub(r"\\(?:emph|text(?:bf|it|rm|sc|sf|sl|tt)|underline|footnote|caption|author|date|url)\s*\{([^{}]*)\}", r"\1", text)
            # of a command that isn't known the last argument is its text
            text = re.sub(r"(?<![\w:\\])\\[A-Za-z]{2,}\*?\s*(?:\[[^\]\n]*\])?(?:\{[^{}]*\})*\{([^{}]*)\}", r"\1", text)
        text = re.sub(r"(?<![\w:\\])\\(?:maketitle|noindent|newpage|clearpage|centering|par|hfill|bigskip|tableofcontents)(?![A-Za-z])", "", text)
        text = re.sub(r"(?<![\w\\])\\([%&#_])(?!\w)", r"\1", text)
    if wiki or TEMPLATE.search(text) or APOSTROPHE_PAIR.search(text) or EXTERNAL.search(text):

        def wiki_table(m: re.Match) -> str:
            rows = re.split(r"(?m)^\|-[^\n]*$", re.sub(r"\A\{\|[^\n]*|^\|\}", "", m.group(0), flags=re.M))
            return "\n\n" + "\n".join(" | ".join(c.strip() for c in re.split(r"\|\||!!|\n[|!]", re.sub(r"\A\s*[|!]", "", r)) if c.strip()) for r in rows if r.strip()) + "\n\n"

        text = WIKI_TABLE.sub(wiki_table, text)
        if wiki:
            text = re.sub(r"(?m)(?:^#[ \t]+[^\n]*(?:\n|\Z))+", lambda m: "".join(f"{i}. {x[1:].lstrip()}" for i, x in enumerate(m.group(0).splitlines(True), 1)), text)
        text = WIKI_HEADING.sub(lambda m: f"\n\n{'#' * max(1, len(m.group(1)) - 1)} {m.group(2)}\n\n", text)
        if wiki:
            text = re.sub(r"(?m)^[*:;][ \t]*(?=\S)", "- ", text)
        text = re.sub(r"\[\[(?:Category|Kategorie|File|Image|Datei):[^\]\n]*\]\]", "", text, flags=re.I)
        text = WIKI_LINK.sub(lambda m: m.group(2), text)
        text = TEMPLATE.sub(lambda m: m.group(1).split("|")[-1] if m.group(1).split("|")[0].strip().lower() in ("term", "quote", "lang", "code", "nowrap") else "", text)
        text = EXTERNAL.sub(lambda m: m.group(2) or m.group(1), text)
        text = APOSTROPHES.sub("", text)
    text = IMAGE.sub(lambda m: m.group(1), text)
    text = LINK.sub(lambda m: m.group(1), text)
    text = STRONG.sub(lambda m: next(g for g in m.groups() if g), text)
    text = STRONG_HAN.sub(lambda m: next(g for g in m.groups() if g), text)
    text = EM.sub(lambda m: next(g for g in m.groups() if g), text)
    text = CODE.sub(lambda m: m.group(1), text)
    if MD_TABLE.search(text):
        text = MD_TABLE.sub("", text)
        text = re.sub(r"(?m)^[ \t]*\|(.+?)\|?[ \t]*$", lambda m: " | ".join(c.strip() for c in m.group(1).split("|")), text)
    text = SETEXT.sub(lambda m: f"\n{'#' if m.group(2)[0] == '=' else '##'} {m.group(1)}\n", text)
    text = HEADING.sub(lambda m: f"\n{m.group(1)} {m.group(2).rstrip().rstrip('#').rstrip()}\n", text)
    text = RULE.sub("", text)
    text = QUOTE.sub("", text)
    text = BULLET.sub(lambda m: m.group(1) + "- ", text)
    while _HOLD.search(text):
        text = _HOLD.sub(lambda m: held[int(m.group(1))], text)
    text = re.sub(r"(?<![ \t])[ \t]+$", "", text, flags=re.M)
    return re.sub(r"\n{3,}", "\n\n", text).strip()


#: What any markup needs; a text without it is clean as it stands.
HINT = re.compile(r"[<&\\*_`#=\[{|~$>]|''|^[ \t]*(?:[-+]|\d+[.)])[ \t]|^-{3}", re.M)


def _cleaned(want_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, texts = [], []
            for t in b.column("content").to_pylist():
                k = kinds(t) if t and HINT.search(t) else []
                found.append(",".join(k))
                texts.append((clean(t) if k else t) if want_text else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "kinds", "clean_text"])

    return run


def cleaned(docs: DataFrame, id_col: str = "doc_id", content: str = "content", want_text: bool = True) -> DataFrame:
    """(doc_id, kinds, clean_text): kinds lists the markup found, '' if none; such a content comes out as it is. Null content: '' and null. A null id stays."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(content).alias("content"))
    return rows.mapInArrow(_cleaned(want_text), f"doc_id {dict(rows.dtypes)['doc_id']}, kinds string, clean_text string")
