"""Problem 10: text decoded with the wrong character set, found and restored with a multi-pattern automaton."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What UTF-8 was read as, byte by byte. Bytes that a set leaves open become the control character of that number, as browsers do it.
READERS = ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251", "cp1250", "cp1254", "cp1253", "cp852", "koi8-r", "cp866")
#: One-byte sets of Latin letters with their marks; a text written in one and read in another one is restored word by word.
WESTERN = ("mac_roman", "cp850", "cp437", "cp1252")
CENTRAL = ("cp1250", "cp852", "iso8859-2")
LATIN_READERS = ("cp1252", "mac_roman", "cp850", "cp437", "cp1251", "cp1250", "latin-1")
#: One-byte sets of other scripts, and the sets that they were read in.
CYRILLIC = ("cp1251", "koi8-r", "cp866", "iso8859-5", "mac_cyrillic")
SCRIPTS = {"cp1251": "ru", "koi8-r": "ru", "cp866": "ru", "iso8859-5": "ru", "cp1253": "el"}
#: Sets of two bytes for a character that were read as Latin letters.
WIDE = ("gbk", "big5", "shift_jis", "euc_jp", "euc_kr")
#: The traces of a text whose original is gone: the replacement character, and its UTF-8 bytes as Latin or Chinese.
LOST = ("�", "ï¿½", "锟斤", "斤拷", "锟解")
# The commonest letters of Russian and Greek, about four fifths of a text each.
COMMON = {"ru": frozenset("оеаинтсрвлкмдпу"), "el": frozenset("αοιετνσηρπκυλμςάίόέή")}
# The small letters with marks of central Europe.
MARKED = frozenset("ąćęłńóśźżáčďéěíňřšťúůýžőűöüäôľĺŕăâîșțşţđß")
# Blocks of characters that texts hold, first and last of each. A character of the first ones proves damage by itself,
# those of the others need a neighbour of their kind, as words of these scripts have more than one.
BLOCKS = (
    (0xA0, 0x17F), (0x386, 0x3CE), (0x400, 0x45F), (0x490, 0x491), (0x1E00, 0x1EFF), (0x2010, 0x2027), (0x2030, 0x205E), (0x20A0, 0x20BF), (0x2116, 0x2122), (0x2190, 0x2199), (0x2200, 0x2265), (0x3000, 0x3011),
    (0x4E00, 0x9FFF), (0xFEFF, 0xFEFF), (0xFF01, 0xFF5E),
)
MORE_BLOCKS = ((0x5D0, 0x5EA), (0x620, 0x64A), (0x900, 0xDFF), (0xE01, 0xE5B), (0x10A0, 0x10FF), (0x1F00, 0x1FFF), (0x2500, 0x27BF), (0x3041, 0x30FF), (0xAC00, 0xD7A3), (0xFE0F, 0xFE0F), (0x1F300, 0x1FAFF))


@lru_cache(maxsize=64)
def _table(charset: str) -> str:
    """The characters of a one-byte set in the order of their bytes."""
    return "".join(c if (c := bytes([b]).decode(charset, "replace")) != "�" else chr(b) for b in range(256))


@lru_cache(maxsize=64)
def _bytes(charset: str) -> dict[str, int]:
    return {c: b for b, c in reversed(list(enumerate(_table(charset))))} | {chr(b): b for b in range(128)}


def _read(data: bytes, charset: str) -> str | None:
    if charset == "gbk":
        try:
            return data.decode("gbk")
        except UnicodeDecodeError:
            return None
    table = _table(charset)
    return "".join(table[b] for b in data)


def _written(text: str, charset: str) -> bytes:
    """The bytes that give the text when read in the charset; control characters give their own number."""
    back, out = _bytes(charset), bytearray()
    for i, c in enumerate(text):
        b = back.get(c)
        if b is None:
            if not "\x80" <= c <= "\x9f":
                raise UnicodeEncodeError(charset, text, i, i + 1, "not in the set")
            b = ord(c)
        out.append(b)
    return bytes(out)


@lru_cache(maxsize=1)
def _layers() -> frozenset[str]:
    return frozenset(c for charset in ("cp1252", "latin-1", "cp437", "mac_roman", "cp1251") for c in _table(charset)[0x80:])


@lru_cache(maxsize=200_000)
def expected(c: str) -> int:
    """2 for a character of BLOCKS or of a set that damaged text is read in, as damage may lie in layers; 1 for one of MORE_BLOCKS; else 0."""
    n = ord(c)
    if c in _layers():
        return 2
    if unicodedata.category(c) in ("Cn", "Cc", "Cs", "Co"):
        return 0
    return 2 if any(a <= n <= b for a, b in BLOCKS) else int(any(a <= n <= b for a, b in MORE_BLOCKS))


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """The garbled beginnings (two bytes) of all characters of UTF-8 under all one-byte sets, and the whole forms of those that GBK makes one or two characters of.

    Of longer characters the set itself tells what the other bytes must look like, so the beginnings stand for all of them, in any script.
    """
    table: dict[str, list] = {}
    for charset in READERS:
        for lead in range(0xC2, 0xF4):
            for second in range(0x80, 0xC0):
                form = _read(bytes([lead, second]), charset)
                if all(x > "\x7f" for x in form):
                    table.setdefault(form, []).append((charset, lead, second))
    for n in (*range(0xA0, 0x180), *range(0x391, 0x3CA), *range(0x400, 0x460)):
        form = _read(chr(n).encode(), "gbk")
        if form and len(form) == 1:
            table.setdefault(form, []).append(("gbk", chr(n), 0))
    # E2 80 9x begin most quotes and dashes; read as Chinese they take the next byte with them
    for c in "‘’“”–—…•":
        for follow in map(chr, range(0x40, 0x7F)):
            form = _read(c.encode() + follow.encode(), "gbk")
            if form and len(form) == 2:
                table.setdefault(form, []).append(("gbk2", c + follow, 0))
    a = ahocorasick.Automaton()
    for form, what in table.items():
        a.add_word(form, (len(form), what))
    a.make_automaton()
    return a


def _complete(text: str, at: int, charset: str, lead: int, second: int) -> str | None:
    """The character whose bytes begin at the place, if the text goes on as its bytes must."""
    size = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
    tail, back = text[at + 2 : at + size], _bytes(charset)
    data = bytearray([lead, second])
    for c in tail:
        b = back.get(c, ord(c) if "\x80" <= c <= "\x9f" else 0)
        if not 0x80 <= b <= 0xBF:
            return None
        data.append(b)
    try:
        c = data.decode()
    except UnicodeDecodeError:
        return None
    return c if expected(c) else None


_LATIN = re.compile(r"[A-Za-z]")
_HAN = re.compile(r"[㐀-鿿]")
_C1 = re.compile(r"[\x80-\x9f]")
#: Signs and letters that never stand between two small Latin letters, and capitals that don't.
_INWORD = re.compile(r"(?<=[a-zà-öø-ÿ])(?:[‚„†‡ˆ‰‹›•™¡¢£¤¥¦§¨¬¯±²³¶¸¹¼½¾¿ƒ˜ŠŒŽŸ]|[À-ÖØ-ÞΑ-ωА-я]|[⌠-◿√∞∫≈≠≤≥∂∑∏Ω⌐])+(?=[a-zà-öø-ÿ])")
_BEGIN = re.compile(r"(?<![^\W_])[Ÿ‡¡¢£¤¥](?=[a-z]{2})|(?<=[a-z])[‡‰Šˆ‚](?![^\W_])")
#: Marks that are set between words without a blank; one alone, between two longer parts or next to a vowel, proves nothing.
_MARKS = frozenset("†‡¶§•™¿¡®©")
_VOWEL = re.compile(r"[aeiouyà-æè-ïò-öø-ýÿ]", re.I)
#: Four or more characters of the upper half of Latin-1 in a row: words of another script read byte by byte.
_RUN = re.compile(r"[\xa1-\xff]{4,}")
_HIGH = r"\x80-\xff‚„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸƒ€"
_BYTES = re.compile(rf"[{_HIGH}]{{4,}}")
_LONG_BYTES = re.compile(rf"[{_HIGH}]{{10,}}")
_PAIRS = re.compile(rf"(?:[{_HIGH}][@-~{_HIGH}]){{3,}}")
_TURNED = re.compile(r"[а-яё][А-ЯЁ╔-╬]|^[А-ЯЁ╔-╬]+$")
_SWAPPED = re.compile(r"(?<![А-яЁё])[а-яё][А-ЯЁ]{2,}(?![А-яЁё])")
_CYR_WORD = re.compile(r"[\xa8\xb8\xc0-\xff]{2,}")
_OTHER_WORD = re.compile(r"[\xa1-\xff]{2,}")
_FOREIGN = re.compile(r"[\x80-\U0010ffff]{4,}")
_CJK_RUN = re.compile(r"[^\x00-\x7f]+")
_CYR_RUN = re.compile(r"[Ѐ-ӿ─-▟‚„†‡€‰‹•™¤¦§©¬\xad®°±µ¶·№⌠⌡√≈≤≥²÷]{4,}")


_CYR_LINE = re.compile(r"[Ѐ-ӿ─-▟‚„†‡€‰‹•™¤¦§©¬\xad®°±µ¶·№⌠⌡√≈≤≥²÷\xa0«»¬…“”‘’–—›]+")


def plain(text: str, script: str) -> float:
    """How much a text looks like one of the script: share of its common letters less odd case and signs."""
    letters = [c for c in text if c.isalpha() or c in "─━│┃┄░▒▓"]
    if not letters:
        return 0.0
    odd = len(re.findall(r"[а-яёα-ώ][А-ЯЁΑ-Ω]", text))
    return (sum(c in COMMON[script] for c in letters) - 2 * odd) / max(len(letters), len(text) - sum(c.isspace() for c in text))


_CYR_PAIRS = tuple((w, r) for w in CYRILLIC for r in CYRILLIC if w != r)


def _decoded(text: str, written: str, read: str) -> str | None:
    try:
        return _written(text, read).decode(written)
    except (UnicodeEncodeError, UnicodeDecodeError):
        return None


def _cyrillic(text: str, pairs: tuple[tuple[str, str], ...], floor: float = 0.35) -> str | None:
    """The plainest Russian reading of a text, if it reaches the floor."""
    best, score = None, floor
    for written, read in pairs:
        t = _decoded(text, written, read)
        if t is not None and (s := plain(t, "ru")) > score and re.search(r"[А-яЁё]", t):
            best, score = t, s
    return best


def _mixed(s: str) -> tuple[str, str] | None:
    """The Cyrillic sets, if any, between which a run of letters and signs becomes a Russian word. Words of letters alone that are sound Russian stay."""
    now = plain(s, "ru")
    if now > 0.3 or re.fullmatch(r"[А-Яа-яЁё]+", s):
        return None
    best, score = None, max(0.45, now + 0.35)
    for pair in _CYR_PAIRS:
        t = _decoded(s, *pair)
        if t is not None and (x := plain(t, "ru")) > score and re.fullmatch(r"[А-яЁё]+", t):
            best, score = pair, x
    return best


@lru_cache(maxsize=1)
def _rare() -> frozenset[str]:
    """The Chinese characters outside the everyday sets: those that GBK added. UTF-8 read as GBK is full of them."""
    out = set()
    for a in range(0x81, 0xFF):
        for b in [*range(0x40, 0x7F), *range(0x80, 0xFF)]:
            if a < 0xA1 or b < 0xA1:
                c = _read(bytes([a, b]), "gbk")
                if c and len(c) == 1:
                    out.add(c)
    return frozenset(out)


@lru_cache(maxsize=8)
def _everyday(charset: str) -> frozenset[str]:
    """The characters that a two-byte set lists first, as the commoner ones, with signs; its standard puts them into one range of leading bytes."""
    codec, first, last = {"gbk": ("gb2312", 0xB0, 0xD7), "big5": ("big5", 0xA4, 0xC6), "shift_jis": ("euc_jp", 0xB0, 0xCF), "euc_jp": ("euc_jp", 0xB0, 0xCF), "euc_kr": ("euc_kr", 0xB0, 0xC8)}[charset]
    out = set("、。，．・：；？！（）「」『』《》“”‘’…—")
    for a in range(first, last + 1):
        for b in [*(range(0x40, 0x7F) if codec == "big5" else ()), *range(0xA1, 0xFF)]:
            out.update(bytes([a, b]).decode(codec, "ignore"))
    return frozenset(out | (set(map(chr, range(0x3041, 0x30FF))) if "j" in charset else set()))


def _utf8(text: str) -> bool:
    """Whether most of a run is UTF-8 read as Latin."""
    try:
        data = _written(text, "cp1252")
    except UnicodeEncodeError:
        return True
    return 2 * sum(c > "\x7f" and c != "�" for c in data.decode("utf-8", "replace")) > sum(c > "\x7f" for c in text) / 2


def _wide(text: str, sets: tuple[str, ...] = WIDE) -> tuple[str, float]:
    """(reading, share of everyday characters in it) of a run of Latin signs under the two-byte set that suits it best."""
    best, score = text, 0.0
    for read in ("cp1252", "latin-1"):
        for charset in sets:
            t = _decoded(text, charset, read)
            foreign = [c for c in t or "" if c > "\x7f"]
            if not foreign:
                continue
            kana = sum("ぁ" <= c <= "ヿ" for c in foreign)
            s = sum(c in _everyday(charset) for c in foreign) / len(foreign)
            if "j" in charset and kana * 5 < len(foreign):
                s = 0.0
            if s > score + 1e-9:
                best, score = t, s
    return best, score


def _korean(text: str) -> bool:
    """Whether the text's runs are Hangul throughout: Chinese runs of that length leave its range of bytes."""
    t = [_decoded(x, "euc_kr", "latin-1") for x in re.findall(r"[\xa1-\xff\xad]{2,}", text)]
    whole = "".join(x or "?" for x in t)
    return len(whole) > 5 and all("가" <= c <= "힣" for c in whole)


def _from_gbk(run: str) -> tuple[str, bool] | None:
    """The run's text if it is UTF-8 read as GBK, and whether all of it came back."""
    if len(run) < 2 or not any(c in _rare() for c in run):
        return None
    try:
        data = b"".join(b"\xff" if c == "�" else b"\x80" if c == "€" else c.encode("gbk") for c in run)
    except UnicodeEncodeError:
        return None
    text = data.decode("utf-8", "replace")
    good = sum(len(c.encode()) for c in text if c != "�" and c > "\x7f")
    han = sum("一" <= c <= "鿿" or c in "，。、；：“”？！（）" for c in text)
    if good < 0.6 * len(data) or (han < 2 and good < 4):
        return None
    whole = "�" not in text
    return text, whole


def _script(c: str) -> str:
    return unicodedata.name(c, "?").split()[0]


def _proves(form: str, before: str = "", after: str = "") -> bool:
    """Letters of one script may stand side by side in a word, and lines side by side in a drawn table unless a letter touches them; anything else proves damage."""
    if any("\x80" <= x <= "\x9f" for x in form):
        return True
    if all("─" <= x <= "▟" for x in form):
        return before.isalpha() or after.isalpha()
    return (form[1:] != "\xa0" or form[0] in "ÃÂ") and not (all(x.isalpha() for x in form) and len(set(map(_script, form))) == 1)


def _multi(text: str, known: Counter) -> tuple[str, int]:
    """Replaces the automaton's matches, those of the set that explains most first; forms of plain letters only beside others of their kind, or if the set is known from elsewhere in the text."""
    hits = []
    for end, (n, what) in automaton().iter(text):
        a = end - n + 1
        for charset, first, second in what:
            if charset in ("gbk", "gbk2"):
                hits.append((a, end + 1, first, charset, charset == "gbk2"))
            elif (c := _complete(text, a, charset, first, second)) is not None:
                size = len(c.encode())
                proof = expected(c) == 2 and _proves(text[a : a + size], text[a - 1 : a], text[a + size : a + size + 1])
                hits.append((a, a + size, c, charset, proof))
    if not hits:
        return text, 0
    # of several sets at one place the one that the rest of the text speaks for
    votes = known + Counter(h[3] for h in hits)
    taken = bytearray(len(text))
    picked: list[tuple] = []
    for h in sorted(hits, key=lambda h: (-votes[h[3]], h[0], -h[1])):
        if not any(taken[h[0] : h[1]]):
            taken[h[0] : h[1]] = b"\x01" * (h[1] - h[0])
            picked.append(h)
    picked.sort()
    sure = known + Counter(h[3] for h in picked if h[4])
    keep = []
    for i, h in enumerate(picked):
        a, b, c, charset, proof = h
        before, after = text[a - 1 : a], text[b : b + 1]
        if charset == "gbk":
            # one Chinese character for one Latin letter with its mark: Latin letters on both sides, or on one and no Chinese on the other
            ok = bool(_LATIN.match(before)) and not _HAN.match(after) or (bool(re.match("[a-z]", after)) and not _HAN.match(before))
            ok = ok and (bool(re.match("[a-z]", before)) or bool(re.match("[a-z]", after)))
            if ok and not (_LATIN.match(before) and _LATIN.match(after)):
                ok = not _HAN.search(text[max(0, a - 12) : a]) and not _HAN.search(text[b : b + 12])
        elif proof:
            # A INTEGRAÇÃO with a hard space after a word's last capital is sound
            ok = not (text[a] in "ÃÂÐÑ" and text[a + 1] == "\xa0" and before.isalpha() and before.isupper())
        else:
            beside = any(0 <= j < len(picked) and picked[j][3] == charset and (picked[j][1] == a or picked[j][0] == b) for j in (i - 1, i + 1))
            ok = sure[charset] > 0 or (beside and charset != "cp866" and not all("─" <= x <= "▟" for x in text[a:b]))
        if ok:
            keep.append(h)
    if not keep:
        return text, 0
    out, last = [], 0
    for a, b, c, _, _ in keep:
        out += [text[last:a], c]
        last = b
    return "".join([*out, text[last:]]), len(keep)


@lru_cache(maxsize=1)
def _single_pairs() -> list[tuple[dict[str, str], frozenset[str]]]:
    """For every pair of one-byte Latin sets what each character was, and the small letters that are likely in it."""
    west = frozenset(map(chr, [*range(0xDF, 0xF7), *range(0xF8, 0x100)]))
    out = []
    for likely, sets in ((west, WESTERN), (MARKED, CENTRAL)):
        for read in LATIN_READERS:
            for written in sets:
                back = {}
                for x in range(0x80, 0x100):
                    c = bytes([x]).decode(written, "replace")
                    if c != "�" and c != _table(read)[x]:
                        back[_table(read)[x]] = c
                if back:
                    out.append((back, likely))
    return out


def _alone(text: str, at: re.Match, c: str) -> bool:
    """Whether a single mark may be what it is: its letter would stand beside a vowel, its word has right foreign letters, or both of the parts are long."""
    left = re.search(r"[^\W\d_]*\Z", text[max(0, at.start() - 40) : at.start()]).group(0)
    right = re.match(r"[^\W\d_]*", text[at.end() : at.end() + 40]).group(0)
    beside = _VOWEL.match(c) and (_VOWEL.match(left[-1:] or " ") or _VOWEL.match(right[:1] or " "))
    return bool(beside) or not (left + right).isascii() or (len(left) > 2 and len(right) > 2)


def _single(text: str) -> tuple[str, int]:
    """Single-byte sets: what stands inside words proves it; the pair that explains the proofs as letters is undone in the words they are in."""
    found = [*_INWORD.finditer(text), *_BEGIN.finditer(text)]
    proofs = [m.group(0) for m in found] + _C1.findall(text)
    if not proofs:
        return text, 0
    chars = Counter("".join(proofs))
    # a sign between a vowel and another letter is less likely a vowel than one between consonants
    by_vowel = Counter(c for m in found if len(c := m.group(0)) == 1 and (_VOWEL.match(text[m.start() - 1 : m.start()]) or _VOWEL.match(text[m.end() : m.end() + 1])))
    best, score = None, 0.0
    for back, likely in _single_pairs():
        # inside words small letters of the region are likely, capitals hardly, anything else is not; an apostrophe may stand there
        s = sum(n * (1.0 if (b := back.get(c, "\0")) in likely else 1.05 if b == "’" else 0.1 if b.isalpha() and b < "ƀ" else -2) for c, n in chars.items())
        s -= sum(0.3 * n for c, n in by_vowel.items() if _VOWEL.match(back.get(c, "")))
        if s > score + 1e-9:
            best, score = back, s
    if len(proofs) == 1 and proofs[0] in _MARKS and (best is None or _alone(text, found[0], best[proofs[0]])):
        return text, 0
    if best is None:
        return text, len(proofs)
    seen = set(chars)

    def fix(m: re.Match) -> str:
        word = m.group(0)
        if not any(c in best for c in word):
            return word
        t = "".join(best.get(c, c) for c in word)
        # right letters of a mixed text stay: only words whose change gives letters throughout are changed
        return t if all(c.isalpha() or c in "’‘-'–…" for c in t) and not re.search("[a-zà-ÿ][À-Þ]", t) else word

    # signs count inside of words only, those that are proofs at their ends as well; apostrophes and hard spaces never
    inner = "".join(re.escape(c) for c in best if not c.isalnum() and (c in seen or c not in "’‘\xa0\xad"))
    outer = "".join(map(re.escape, seen))
    changed = re.sub(rf"[{outer}]*[^\W\d_]+(?:[{inner}]+[^\W\d_]+)*[{outer}¢¤†‡ˆ‰]*", fix, text)
    return changed, len(proofs)


#: Sets whose garbled forms look like letters of other scripts, so that a run has to be settled as a whole before its parts are taken for others.
_WHOLE = ("cp437", "cp850", "cp852", "mac_roman", "cp1250", "cp866", "koi8-r", "cp1253", "cp1251")


def _whole_run(run: str) -> tuple[str, str]:
    """(text, set) of a run of foreign signs that is, as a whole, UTF-8 of one script's expected characters in one of these sets, at least two of them letters."""
    for charset in _WHOLE:
        t = _decoded(run, "utf-8", charset)
        if t and len(t) > 1 and all(map(expected, t)) and sum(c.isalpha() for c in t) > 1 and _proves(run) and len({_script(c) for c in t if c.isalpha()}) == 1:
            return t, charset
    return run, ""


def _other_script(text: str) -> str | None:
    """The one-byte set, if any, in which the text's runs of high Latin letters look like words of Greek and not of Russian."""
    upper = " ".join(_RUN.findall(text))
    if len(upper) < 12:
        return None
    score = {w: plain(t, script) for w, script in SCRIPTS.items() if (t := _decoded(upper, w, "latin-1")) is not None}
    best = max(score, key=lambda w: (score[w], w), default=None)
    return best if best and SCRIPTS[best] != "ru" and score[best] > 0.6 and score[best] > 0.15 + max(s for w, s in score.items() if SCRIPTS[w] == "ru") else None


def repair(text: str | None) -> tuple[str | None, int, bool]:
    """(restored text, number of damaged places, whether all of them came back). Undamaged text comes out as it is; null too."""
    if not text or text.isascii():
        return text, 0, True
    found, whole = 0, True
    seen, known = {text}, Counter()
    # damage may lie in layers: each pass undoes one, until nothing changes or a text comes again
    while True:
        before, n = text, 0

        def settled(m: re.Match) -> str:
            nonlocal n
            t, charset = _whole_run(m.group(0))
            if charset:
                n += 1
                known[charset] += 1
            return t

        def run(m: re.Match) -> str:
            nonlocal n, whole
            r = _from_gbk(m.group(0))
            if r is None:
                return m.group(0)
            n += 1
            whole = whole and r[1]
            return r[0]

        def bytes_run(m: re.Match) -> str:
            nonlocal n
            s = m.group(0)
            t, share = _wide(s, ("euc_kr",) if korean else WIDE)
            if _utf8(s) and (share < 0.95 or len(s) < 10 or _decoded(s, "utf-8", "cp1252")):
                return s
            if share < (0.95 if cyrillic else 0.8):
                t = None if cyrillic else _decoded(s, "gbk", "cp1252")
                if t is None or sum(c in _rare() for c in t) * 4 > len(t) or not all(c > "\x7f" for c in t):
                    return s
            n += 1
            return t

        def pairs_run(m: re.Match) -> str:
            nonlocal n
            s = m.group(0)
            t, share = (s, 0.0) if s.isascii() or _utf8(s) else _wide(s)
            if share < 0.9 or sum(c > "\x7f" for c in t) < 4:
                return s
            n += 1
            return t

        def swapped(m: re.Match) -> str:
            s = m.group(0)
            return (_cyrillic(s, (ours,), 0.2) or s) if _TURNED.search(s) else s

        def capitals(m: re.Match) -> str:
            t = _decoded(m.group(0), *pair)
            return t if t and t.islower() and plain(t, "ru") > 0.3 else m.group(0)

        def rest(m: re.Match) -> str:
            s = m.group(0)
            t = _decoded(s, *pair)
            good = t and re.fullmatch(r"[А-яЁё]+", t) and (not re.fullmatch(r"[А-яЁё]+", s) or plain(t, "ru") > plain(s, "ru") + 0.15)
            return t if good else s

        def words(m: re.Match) -> str:
            nonlocal n
            t = _cyrillic(m.group(0), ((ours, "cp1252"),)) or _cyrillic(m.group(0), (("cp1251", "cp1252"), ("koi8-r", "cp1252")))
            if t is None:
                return m.group(0)
            n += 1
            return t

        text = _FOREIGN.sub(settled, text)
        if _HAN.search(text):
            text = _CJK_RUN.sub(run, text)
        if "ƒ" in text or "‚" in text:
            text = _PAIRS.sub(pairs_run, text)
        if _RUN.search(text):
            upper = "".join(_RUN.findall(text))
            other = _other_script(text)
            # Cyrillic letters lie in the last quarter of the bytes, Chinese ones in the whole upper half
            if other:
                n += 1
                text = _OTHER_WORD.sub(lambda m: _decoded(m.group(0), other, "latin-1") or m.group(0), text)
            else:
                cyrillic = sum(c < "\xc0" and c not in "\xa8\xb8" for c in upper) * 12 < len(upper)
                ours = max(("cp1251", "koi8-r", "iso8859-5"), key=lambda w: plain(_decoded(upper, w, "latin-1") or "", "ru"))
                korean = not cyrillic and _korean(text)
                text = text if cyrillic or korean else _PAIRS.sub(pairs_run, text)
                text = (_LONG_BYTES if cyrillic else _BYTES).sub(bytes_run, text)
                text = _CYR_WORD.sub(words, text) if cyrillic else text
        text, k = _multi(text, known)
        n += k
        if _SWAPPED.search(text):
            n += 1
            turned = " ".join(x for x in re.findall(r"[А-яЁёЂ-џ╔-╬]+", text) if _TURNED.search(x))
            ours = max((("koi8-r", "cp1251"), ("cp1251", "koi8-r")), key=lambda x: plain(_decoded(turned, *x) or "", "ru"))
            text = re.sub(r"[А-яЁёЂ-џ╔-╬]+", swapped, text)
        pairs = Counter(filter(None, (_mixed(m.group(0)) for m in _CYR_RUN.finditer(text))))
        if pairs:
            n += sum(pairs.values())
            pair = max(pairs, key=lambda x: (pairs[x], x))
            text = _CYR_LINE.sub(rest, text)
            text = re.sub(r"(?<![Ѐ-ӿ])[А-ЯЁ]{3,}(?![Ѐ-ӿ])", capitals, text)
        found += n
        if n == 0 or text in seen:
            break
        seen.add(text)
    if found == 0 and _RUN.search(text):
        found = len(_RUN.findall(text))
    text, k = _single(text)
    found += k
    lost = sum(text.count(x) for x in LOST)
    return text, found + lost, whole and lost == 0 and not _C1.search(text)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [repair(t) for t in b.column("text").to_pylist()]
        out = [b.column("doc_id"), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.bool_()), pa.array([r[0] for r in rows], pa.string())]
        yield pa.RecordBatch.from_arrays(out, names=["doc_id", "places", "whole", "restored"])


def repaired(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, places, whole, restored): places counts what was found damaged, 0 for sound, empty or null text; whole tells whether nothing is lost. A null id stays."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_repaired, f"doc_id {dict(rows.dtypes)['doc_id']}, places long, whole boolean, restored string")
