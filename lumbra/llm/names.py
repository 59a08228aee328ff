"""Problem 1: spellings of the same person's or organisation's name."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumbra.llm.common import components, join_hot
from lumbra.session import cut

# Titles, legal forms and other words that don't tell names apart.
TITLES = {"dr", "prof", "hon", "dipl", "ing", "mr", "mrs", "ms", "sir", "editor", "jr", "sr", "phd", "md"}
LEGAL = {"inc", "incorporated", "corp", "corporation", "co", "company", "ltd", "limited", "llc", "plc", "gmbh", "mbh", "gesellschaft", "ag", "se", "sa", "the", "and", "of"}
# Common abbreviations of words in firms' names, by word. A word's beginning and its consonants alone need no entry.
SHORT = {
    "manufacturing": "mfr", "logistics": "log", "systems": "sys syst", "laboratories": "lab labs", "services": "serv svc", "devices": "dev devs", "partners": "ptrs", "publishing": "pub", "international": "int intl",
    "engineering": "eng engr engrg", "insurance": "ins", "retrieval": "retr", "medical": "med", "mining": "min", "textile": "tex text", "signal": "sig", "marine": "mar", "timber": "timb", "solar": "sol", "data": "dat", "foods": "fd fds",
    "freight": "frt", "holdings": "hldg hldgs", "group": "gp grp", "association": "assn assoc", "associates": "assocs", "brothers": "bros", "building": "bldg", "center": "ctr", "centre": "ctre", "chemicals": "chem", "communications": "comm comms",
    "construction": "constr", "department": "dept", "development": "devt", "distribution": "distr", "education": "educ", "electric": "elec", "electronics": "elecs", "energy": "enrg", "enterprises": "ent", "environmental": "env", "equipment": "equip",
    "finance": "fin", "financial": "finl", "foundation": "fdn", "general": "gen", "government": "govt", "hospital": "hosp", "industries": "ind inds", "information": "info", "institute": "inst", "investment": "inv", "management": "mgmt", "market": "mkt",
    "marketing": "mktg", "mechanical": "mech", "national": "natl nat", "organization": "org", "pharmaceuticals": "pharm pharma", "products": "prod prods", "production": "prodn", "properties": "prop props", "research": "res rsch", "resources": "rsrcs",
    "school": "sch", "science": "sci", "security": "sec", "shipping": "shpg", "society": "soc", "software": "sw", "solutions": "soln solns", "supply": "sply", "technologies": "techs", "technology": "tech", "telecommunications": "telecom", "trading": "trdg",
    "transport": "transp", "transportation": "transpn", "university": "univ", "wholesale": "whsle", "works": "wks",
}
# Given names and their usual short forms; a short form may belong to several.
NICK = {
    "abigail": "abby gail", "adrian": "ade", "agnes": "aggie", "albert": "al bert bertie", "alexander": "alex sandy xander sasha alec", "alexandra": "alexa sandra lexi", "alfred": "alf fred freddie", "alice": "allie ali", "amanda": "mandy", "andrew": "andy drew",
    "anna": "annie anya nan", "anthony": "tony ant", "arthur": "art artie", "barbara": "barb babs barbie", "bartholomew": "bart", "benedict": "ben", "benjamin": "ben benny benji", "bernard": "bernie", "bridget": "biddy bridie", "brigitte": "gitte britta biggi",
    "caroline": "carrie caro", "catherine": "cat cathy kate cath", "cecilia": "cissy celia", "charles": "charlie chuck chaz", "charlotte": "lottie charlie", "christina": "tina chrissy", "christopher": "chris kit topher", "clifford": "cliff", "constance": "connie",
    "cynthia": "cindy", "daniel": "dan danny", "david": "dave davy", "deborah": "deb debbie debra", "dominic": "dom nick", "donald": "don donny", "dorothea": "dora dot dotty thea doro", "dorothy": "dot dottie dolly", "douglas": "doug", "edmund": "ed ted",
    "edward": "ed eddie ned ted teddy", "eleanor": "ellie nell nora", "eleonora": "nora ellie lena leonie", "elizabeth": "liz betty beth lizzie eliza", "emily": "em emmy", "eugene": "gene", "evelyn": "evie", "florence": "flo florrie", "frances": "fran fanny",
    "francesca": "fran frankie cesca franny", "francis": "frank", "frederick": "fred fritz freddie freddy", "gabriel": "gabe", "geoffrey": "geoff jeff", "gerald": "gerry jerry", "gertrude": "trudy gert gertie", "gilbert": "gil bert", "gregory": "greg",
    "harold": "hal harry", "helena": "lena nell helen", "henry": "hank harry hal", "herbert": "herb bert", "hubert": "bert", "isabella": "bella izzy", "jacob": "jake", "jacqueline": "jackie", "james": "jim jamie jimmy", "janet": "jan", "jeffrey": "jeff",
    "jennifer": "jen jenny", "jeremy": "jerry", "jessica": "jess jessie", "johanna": "hanna jo hanne", "johannes": "hans hannes", "john": "jack johnny", "jonathan": "jon jonny", "joseph": "joe joey jo", "josephine": "josie jo", "joshua": "josh",
    "judith": "judy jude", "katharina": "kathi kat katja katie kathy kit", "katherine": "kate kathy katie kitty", "kenneth": "ken kenny", "konrad": "kurt conny", "lawrence": "larry laurie", "leonard": "leo lenny len", "lorenzo": "enzo renzo larry",
    "louis": "lou", "louisa": "lou", "lucinda": "lucy cindy lu lucie", "madeline": "maddie", "margaret": "meg maggie peggy marge greta", "martin": "marty", "matilda": "tilda tilly mattie", "matthew": "matt matty", "maximilian": "max",
    "melissa": "mel missy", "michael": "mike mick mickey", "nathaniel": "nate nat", "nicholas": "nick nicky", "nicole": "nikki", "nikolaus": "klaus niko nick nik", "oliver": "ollie", "pamela": "pam", "patricia": "pat tricia trish patty", "patrick": "pat paddy",
    "penelope": "penny", "peter": "pete", "philip": "phil pip", "philippa": "pippa pip", "rachel": "rae", "raymond": "ray", "rebecca": "becky becca bex", "richard": "dick rick rich ricky", "robert": "rob bob bobby robbie bert", "roderick": "rod",
    "roger": "rodge", "ronald": "ron ronnie", "rosemary": "rosie", "rudiger": "rudi", "rudolf": "rudi rolf", "samantha": "sam", "samuel": "sam sammy", "sarah": "sally sadie", "sebastian": "seb bastian", "sigmund": "sigi", "stanley": "stan",
    "stephanie": "steph stephie", "stephen": "steve stevie", "susan": "sue susie", "susanna": "sue susie sanna suzy", "terence": "terry", "theodore": "theo ted teddy", "theresa": "tess terry tessa resi tracy", "thomas": "tom tommy", "timothy": "tim",
    "valerie": "val", "veronica": "ronnie vera", "victoria": "vicky tori", "vincent": "vince vinny", "virginia": "ginny", "walter": "walt wally", "wilhelm": "willi helm", "william": "bill will liam billy willy", "zachary": "zach",
}
# Given names that look alike and are different ones.
OTHERS = (
    "adam alina aline amelia andrea andreas angela angelo anita anja anne arno arne bianca boris bruno carl carla carol clara claudia claudio clemens colin colette cora corinna dana daria dario david denis denise diana diane diego"
    " dieter dina dirk edith elena elisa ella ellen elsa emil emilia emma eric erica erik erika ernest esther eva evan felix fabian finn franz georg george gerd gisela grace gustav hanna hannah heidi heike helga hilda hugo ida ines ingo irena"
    " irene iris ivan ivo jane jean joan joana joel jonas jose juan julia julian julie julius karin karen karl karla karol kevin klara lara laura lea leah leon leona lena lisa liza louise luca lucas lucia luis luisa lukas lydia magda maria mariana"
    " marie marina mario marion marius mark marko marta marten mary mia mila milan miriam mona monica monika nadia nadine nina noah nora olga oscar otto paul paula pauline pavel pia rafael ralf ralph regina rene renata rita rolf roman rosa rose ruben ruth sabina"
    " sabine sara selma silvia simon simone sofia sonja sophia stefan stella sven sylvia tanja tara thea tobias ulrich ulrike ursula uta uwe valentin vera viktor vivian volker werner xaver yvonne"
).split()
#: Least similarity for a link. A word that only begins another one, or is its consonants, can't carry a link by itself.
LEAST, PART_OF = 0.75, 0.7


def tuned(similarity: float, recall: float, background: float = 0.25, most: int = 96) -> tuple[int, int]:
    """(bands, rows): of the shapes with at most so many hashes whose collision curve 1 - (1 - s^rows)^bands reaches the recall at the similarity, the one in
    which two names of the background similarity meet most seldom."""
    shapes = []
    for rows in range(1, 12):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))
        if bands * rows <= most:
            shapes.append((1 - (1 - background**rows) ** bands, bands, rows))
    return min(shapes)[1:]


#: Bands and rows of the two signatures: whole names with a slip share 0.6 of their q-grams and more, the distinguishing part with a slip 0.5 and more.
WHOLE, PART = tuned(0.6, 0.997), tuned(0.5, 0.998)
_rng = np.random.default_rng(11)
_MUL = _rng.integers(1, 2**63, size=96, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(1, 2**63, size=96, dtype=np.uint64)

_HAN_TAIL = re.compile(r"(?:股份|集团)?(?:有限责任公司|有限公司|公司)$")


def _near(a: str, b: str) -> int:
    """Edits between two words with swaps of neighbours as one, up to 3."""
    if abs(len(a) - len(b)) > 2:
        return 3
    prev2: list[int] = []
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, prev2[j - 2] + 1)
            row.append(d)
        if min(row) > 2:
            return 3
        prev2, prev = prev, row
    return prev[-1]


def abbreviates(s: str, w: str) -> bool:
    """Whether s, of three letters or more, begins the longer word w, or is w's first letter with some of its consonants in their order."""
    if len(s) < 3 or len(w) < len(s) + 2:
        return False
    if w.startswith(s):
        return True
    if s[0] != w[0] or len(s) > 5 or any(c in "aeiouy" for c in s[1:]):
        return False
    rest = iter(w[1:])
    return all(c in rest for c in s[1:])


def _grams(words: list[str], salt: str = "") -> np.ndarray:
    grams = {g for w in words for p in [f"^{w}$"] for g in (p[i : i + 2] for i in range(len(p) - 1))}
    return np.fromiter((xxhash.xxh64_intdigest(salt + g) for g in sorted(grams)), np.uint64, len(grams))


def _bands(grams: np.ndarray, shape: tuple[int, int], seed: int) -> list[int]:
    n, r = shape
    h = (grams[:, None] * _MUL[None, : n * r] + _ADD[None, : n * r]).min(0).reshape(n, r)
    return [xxhash.xxh64_intdigest(row.tobytes() + i.to_bytes(2, "big"), seed) - 2**63 for i, row in enumerate(h)]


class Words:
    """What is known of words: given names with their short forms, other given names, and words of firms with their abbreviations. All are parameters; from_tables
    takes them from tables of any size that fit on the driver."""

    def __init__(self, nick: dict[str, str] = NICK, short: dict[str, str] = SHORT, others: Sequence[str] = OTHERS) -> None:
        self.full: dict[str, frozenset[str]] = {}
        for name, forms in [*nick.items(), *((n, "") for n in others if n not in nick)]:
            for n in [name, *forms.split()]:
                self.full[n] = self.full.get(n, frozenset()) | {name}
        self.short = {s: w for w, forms in short.items() for s in forms.split()}
        self.business = set(short)
        self._known: dict[tuple[str, str], float] = {}

    @classmethod
    def from_tables(cls, nicknames: DataFrame, abbreviations: DataFrame) -> Words:
        """nicknames (name, short), abbreviations (word, short); a null short form only names the name or word."""

        def read(df: DataFrame, key: str) -> dict[str, str]:
            out: dict[str, str] = {}
            for k, v in df.select(F.lower(key), F.lower("short")).filter(F.col(key).isNotNull()).collect():
                out[k] = f"{out.get(k, '')} {v or ''}".strip()
            return out

        return cls(read(nicknames, "name"), read(abbreviations, "word"), ())

    def parse(self, surface: str) -> tuple[str, list[str]] | None:
        """(kind, tokens): kind is han, handle or latin; None if no letter or digit is left. Tokens are bare words without titles and legal forms."""
        s = unicodedata.normalize("NFKC", surface).strip()
        if re.fullmatch(r"@?[A-Za-z_]+\d+", s):
            return "handle", [s.lstrip("@").lower()]
        if re.search(r"[㐀-鿿]", s):
            core = re.sub(r"\([^)]*\)|[\s·,，.]", "", s)
            core = _HAN_TAIL.sub("", core) or core
            return "han", [core]
        inner = re.sub(r"\([^)]*\)", " ", s)
        s = inner if re.search(r"\w", inner) else s
        s = re.sub(r"(?<=[a-zß-ÿ])(?=[A-ZÀ-Þ][a-zß-ÿ])", " ", s)
        s = "".join(c for c in unicodedata.normalize("NFKD", s.lower().replace("ß", "ss")) if not unicodedata.combining(c))
        s = re.sub(r"\b((?:\w\.){2,})", lambda m: m.group(1).replace(".", "") + " ", s).replace("'", "")
        words = re.findall(r"[^\W_]+", s)
        kept = [self.short.get(w, w) for w in words if w not in TITLES and w not in LEGAL]
        return ("latin", kept or words) if words else None

    def inner(self, a: str, b: str) -> float:
        """Similarity of two words: equal 1, forms of one name 0.97, an initial 0.8, slips a little less than 1, an abbreviation PART_OF, else 0."""
        if a == b:
            return 1.0
        if a > b:
            a, b = b, a
        known = self._known.get((a, b))
        if known is None:
            if len(self._known) > 200_000:
                self._known.clear()
            known = self._known[a, b] = self._inner(a, b)
        return known

    def _inner(self, a: str, b: str) -> float:
        fa, fb = self.full.get(a), self.full.get(b)
        if fa and fb:
            return 0.97 if fa & fb else 0.0
        if len(a) == 1 or len(b) == 1:
            x, y = (a, b) if len(a) == 1 else (b, a)
            return 0.8 if len(y) > 1 and (y[0] == x or any(n[0] == x for n in self.full.get(y, ()))) else 0.0
        if a.isdigit() or b.isdigit() or (a in self.business and b in self.business):
            return 0.0
        least = min(len(a), len(b))
        if least >= 3 and (d := _near(a, b)) <= (1 if least < 9 else 2) and (least >= 4 or a[0] == b[0]):
            return 1 - d / max(len(a), len(b))
        return PART_OF if abbreviates(a, b) or abbreviates(b, a) else 0.0

    def telling(self, w: str) -> bool:
        return len(w) > 1 and w not in self.full and w not in self.business

    def monge_elkan(self, x: list[str], y: list[str]) -> float:
        """Mean over x's words of the best similarity with a word of y."""
        return sum(max(self.inner(a, b) for b in y) for a in x) / len(x)

    def _initials(self, x: list[str], y: list[str]) -> list[str]:
        """x with its acronym written out if it stands for words of y that x doesn't have: 'ds' for 'data services'."""
        rest = [b for b in y if b in self.business and b not in x]
        for i, a in enumerate(x):
            if 2 <= len(a) <= 4 and len(rest) > 1 and sorted(a) == sorted(w[0] for w in rest):
                return [*x[:i], *rest, *x[i + 1 :]]
        return x

    def alike(self, x: list[str], y: list[str], kind: str) -> float:
        """Similarity of two names, 0 if a word of one has no counterpart in the other: relatives and firms with the same lead word differ there.

        Latin names: the smaller Monge-Elkan of both directions. A middle initial may be missing. A word that is no given name and no firm's common
        word has to agree, exactly if another one is only abbreviated; or all words are equal or forms of one name, as in 'Tom James'.
        Chinese names: share of common characters; a firm's short form begins with its name or is contained in it.
        """
        if kind == "handle":
            return float(x == y)
        if kind == "han":
            a, b = sorted((x[0], y[0]), key=len)
            if len(a) >= 5 and (b.startswith(a) or (len(a) == len(b) and a[: len(a) // 2] in b and sorted(a) == sorted(b))):
                return 0.95
            rotated = len(a) >= 6 and sorted(a) == sorted(b)
            return 0.95 if rotated else 0.9 if len(a) >= 6 and len(a) == len(b) and sum(p != q for p, q in zip(a, b, strict=True)) == 1 else 0.0
        x, y = self._initials(x, y), self._initials(y, x)
        fx, fy = [a for a in x if len(a) > 1], [b for b in y if len(b) > 1]
        if len(x) < 2 or len(y) < 2:
            return float(x == y)
        mx = x if len(fx) < 2 else fx
        my = y if len(fy) < 2 else fy
        best = [max(self.inner(a, b) for b in my) for a in mx] + [max(self.inner(a, b) for a in mx) for b in my]
        if min(best) == 0:
            return 0.0
        same = any(self.telling(a) and a in my for a in mx)
        near = any(self.telling(a) and len(a) > 3 and self.inner(a, b) > 0.8 for a in mx for b in my)
        if not (same or near and min(best) > PART_OF or min(best) >= 0.97):
            return 0.0
        return min(self.monge_elkan(mx, my), self.monge_elkan(my, mx))

    def keys(self, kind: str, words: list[str]) -> list[int]:
        """Buckets of a name: bands over the padded q-grams of the whole, and of its distinguishing words together with the first letter of each other word."""
        full, business = self.full, self.business
        if kind == "handle":
            return []
        if kind == "han":
            c = words[0]
            pairs = np.fromiter((xxhash.xxh64_intdigest(c[i : i + 2]) for i in range(max(1, len(c) - 1))), np.uint64)
            return _bands(pairs, PART, 3) + [xxhash.xxh64_intdigest("".join(sorted(c)), 4) - 2**63, xxhash.xxh64_intdigest(c[:4], 4) - 2**63]
        whole = [min(full[w]) if w in full and len(full[w]) == 1 else w for w in words if len(w) > 1]
        out = _bands(_grams(whole), WHOLE, 1) if whole else []
        core = [w for w in words if len(w) > 3 and w not in full and w not in business]
        others = [w for w in words if w not in core]
        if core and others:
            firms = [w for w in others if w in business]
            short = [w for w in others if w not in full and w not in business and 2 <= len(w) <= 4]
            if firms or short:
                salts = {"".join(sorted("".join(w[0] for w in firms) + "".join(short if not firms else [])))}
            else:
                salts = {n[0] for w in others for n in (full.get(w) or (w,))}
            for salt in sorted(salts):
                out += _bands(_grams(core, salt), PART, 2)
        return out

    def slips(self, w: str) -> set[str]:
        """What is left of a word without up to as many letters as inner() lets it slip; words that near share one of these, as do short forms of one name."""
        out = {f"={n}" for n in self.full.get(w, ())}
        if len(w) < 3 or w.isdigit():
            return out
        one = {w[:i] + w[i + 1 :] for i in range(len(w))}
        return out | {w} | one | ({v[:i] + v[i + 1 :] for v in one for i in range(len(v))} if len(w) >= 9 else set())

    def word_pairs(self, kind: str, words: list[str]) -> list[tuple[int, str, str]]:
        """(side, w, t): alike forms meet where a word near w and one near t on side 1 are w and t on side 0.

        Side 0 has each word with each other one, its first letters (^) and the acronyms of two to four of the firm's words (~); side 1 only words that may
        be the one to agree, each with what has to have a counterpart. Chinese names meet in equal t: sorted, with one character left open, or as a beginning.
        """
        out: set[tuple[int, str, str]] = set()
        if kind == "han":
            c = words[0]
            same = ["s" + "".join(sorted(c))] + [f"{i}?{c[:i]}?{c[i + 1 :]}" for i in range(len(c)) if len(c) >= 6]
            out |= {(side, "", t) for side in (0, 1) for t in same} | ({(0, "", "b" + c)} if len(c) >= 5 else set()) | {(1, "", "b" + c[:n]) for n in range(5, len(c))}
        elif kind == "latin" and len(words) > 1:
            full = [w for w in words if len(w) > 1]
            words = words if len(full) < 2 else full
            firm = [w for w in words if w in self.business]
            carries = {w for w in words if self.telling(w)}
            # without a word that tells, names are alike only if all their words are equal or forms of one name
            carries = carries or {w for w in words if w in self.full}
            # beside short words, which may be acronyms, any other word may be the one to agree
            beside = carries if any(len(w) > 4 for w in carries) else {w for w in words if len(w) > 1}
            acronyms = {"~" + "".join(sorted(x[0] for x in some)) for n in (2, 3, 4) for some in combinations(firm, n)}
            for i, w in enumerate(words):
                for j, c in enumerate(words):
                    if i == j or len(w) == 1:
                        continue
                    out |= {(0, w, c)} | {(0, w, f"^{n[0]}") for n in (c, *self.full.get(c, ()))}
                    if w in carries:
                        out |= {(1, w, c)} | ({(1, w, f"^{c}")} if len(c) == 1 else set())
                        if 3 <= len(c) <= 5 and not any(v in "aeiouy" for v in c[1:]):
                            out.add((1, w, f"^{c[0]}"))
                    if w in beside and 2 <= len(c) <= 4:
                        out.add((1, w, "~" + "".join(sorted(c))))
                if len(w) > 1:
                    out |= {(0, w, a) for a in acronyms}
        return sorted(out)


KNOWN = Words()
parse, inner, alike, keys, word_pairs = KNOWN.parse, KNOWN.inner, KNOWN.alike, KNOWN.keys, KNOWN.word_pairs


def meetings(forms: DataFrame, known: Words = KNOWN) -> DataFrame:
    """(a, b): all pairs of forms that can be alike, a < b: they agree in a telling word and in another one, each but for a slip, a short form or an initial.

    Which words are near each other is settled once for each word, so the work follows the number of names that meet, however common one of their words is.
    Each word of a name needs a counterpart in an alike one, so of a name's telling words only the rarest is asked for, counting the names with a word near
    it: a firm whose 'data' is misspelled doesn't meet all others with 'data services'. Words that only abbreviate another one are asked for beside each.
    """

    def worded_(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f, *x) for f, kind, w in zip(b["f"], b["kind"], b["words"], strict=True) for x in known.word_pairs(kind, list(w))]
            yield pd.DataFrame(rows, columns=["f", "side", "w", "t"])

    def slipped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(w, v) for w in b["w"] for v in known.slips(w)], columns=["w", "v"])

    @F.pandas_udf(T.DoubleType())
    def _inner(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([known.inner(a, b) for a, b in zip(x, y, strict=True)], dtype=float)

    worded = cut(forms.select("f", "kind", "words").mapInPandas(worded_, "f long, side int, w string, t string"), "worded")
    words = worded.filter("side = 0 and w <> ''").select("w").distinct()
    slips = cut(words.mapInPandas(slipped, "w string, v string"), "slips")
    near = slips.join(slips.select(F.col("w").alias("x"), "v"), "v").filter("w < x").select("w", "x").distinct().withColumn("s", _inner("w", "x")).filter("s > 0")
    # words that begin others: each word meets its own beginnings that are words
    begun = words.filter("length(w) >= 5").select("w", F.explode(F.sequence(F.lit(3), F.length("w") - 2)).alias("n")).select("w", F.expr("substring(w, 1, n)").alias("v"))
    begun = begun.join(words.select(F.col("w").alias("v")), "v").select(F.col("v").alias("w"), F.col("w").alias("x")).withColumn("s", _inner("w", "x")).filter("s > 0")
    near = cut(near.unionByName(begun).select("w", "x").distinct(), "near")
    lists = near.unionByName(near.select(F.col("x").alias("w"), F.col("w").alias("x"))).unionByName(words.select("w", F.col("w").alias("x"))).groupBy("w").agg(F.collect_set("x").alias("near"))
    lists = cut(lists, "lists")

    def spread(rows: DataFrame, c: str, out: str) -> DataFrame:
        n = lists.withColumnRenamed("w", c).join(rows.groupBy(c).agg(F.count("*").alias("n")), c)
        return join_hot(rows, n, [c], "n", rows.count()).select(*rows.columns, F.explode("near").alias(out))

    fixed = F.col("t").rlike("^[\\^~]") | (F.length("t") == 1)
    told = worded.filter("side = 1")
    # the names that have a word near this one, and of each name the telling word for which they are fewest
    held = worded.filter("side = 0 and w <> ''").select("f", "w").distinct().groupBy(F.col("w").alias("x")).agg(F.count("*").alias("names"))
    weight = lists.select("w", F.explode("near").alias("x")).join(held, "x").groupBy("w").agg(F.sum("names").alias("names"))
    rare = told.filter("w <> ''").filter(~fixed).select("f", "w").distinct().join(weight, "w").groupBy("f").agg(F.min(F.struct("names", "w"))["w"].alias("rare"))
    told = cut(told.join(rare, "f", "left").filter(fixed | (F.col("w") == "") | (F.col("w") == F.col("rare"))).select("f", "w", "t"), "told")
    asked = cut(told.filter("w <> ''").select("w", "t").distinct(), "asked")
    first = cut(spread(asked, "w", "w2"), "first")
    both = spread(first.filter(~fixed), "t", "t2").unionByName(first.filter(fixed).withColumn("t2", F.col("t")))
    both = both.unionByName(told.filter("w = ''").select("w", "t").distinct().select("w", "t", F.lit("").alias("w2"), F.col("t").alias("t2")))
    there = cut(worded.filter("side = 0").select(F.col("f").alias("g"), F.xxhash64("w", "t").alias("key")), "there")
    both = both.select(F.xxhash64("w", "t").alias("from"), F.xxhash64("w2", "t2").alias("key")).join(there.select("key").distinct(), "key", "left_semi")
    here = told.select("f", F.xxhash64("w", "t").alias("from")).join(both, "from").select("f", "key")
    return here.join(there, "key").filter("f <> g").select(F.least("f", "g").alias("a"), F.greatest("f", "g").alias("b")).distinct()


_FORM = "id string, is_name boolean, type string, form string, kind string, words array<string>, weak boolean"


def _forms(known: Words):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, name, aliases, kind_of in zip(b["id"], b["name"], b["aliases"], b["type"], strict=True):
                for is_name, s in [(True, name), *((False, a) for a in (aliases if aliases is not None else ()))]:
                    p = known.parse(s) if s else None
                    if p:
                        kind, words = p
                        weak = kind == "latin" and sum(len(w) > 1 for w in words) < 2
                        # an initial beside two full words is left out of the form's key
                        core = words if weak or kind != "latin" else [w for w in words if len(w) > 1]
                        out.append((i, is_name, kind_of, f"{kind}:{' '.join(sorted(core))}", kind, words, weak))
            yield pd.DataFrame(out, columns=["id", "is_name", "type", "form", "kind", "words", "weak"])

    return run


def _alike(known: Words):
    @F.pandas_udf(T.DoubleType())
    def run(x: pd.Series, y: pd.Series, kind: pd.Series) -> pd.Series:
        return pd.Series([known.alike(list(a), list(b), k) for a, b, k in zip(x, y, kind, strict=True)], dtype=float)

    return run


def stars(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(f, centre) by star clustering: of the nodes left, those that come before all their neighbours become centres, and each neighbour goes to its most similar centre.

    nodes (f, rank): a smaller rank comes first, ranks are unique. edges (a, b, s) both ways. Every round is a join along the edges.
    """
    left = cut(nodes.select("f", "rank"), "nodes")
    live = cut(edges.join(left.select(F.col("f").alias("b"), F.col("rank").alias("rb")), "b").join(left.select(F.col("f").alias("a"), F.col("rank").alias("ra")), "a"), "live")
    done = None
    for _ in range(100):
        best = live.groupBy(F.col("a").alias("f")).agg(F.min("rb").alias("rb"))
        centre = cut(left.join(best, "f", "left").filter("rb is null or rank < rb").select("f"), "centres")
        sat = live.join(centre.select(F.col("f").alias("b")), "b").groupBy(F.col("a").alias("f")).agg(F.min_by("b", F.struct(-F.col("s"), "rb")).alias("centre"))
        now = cut(centre.select("f", F.col("f").alias("centre")).unionByName(sat), "stars")
        done = now if done is None else done.unionByName(now)
        left = cut(left.join(now.select("f"), "f", "left_anti"), "nodes")
        if left.isEmpty():
            return done
        live = cut(live.join(now.select(F.col("f").alias("a")), "a", "left_anti").join(now.select(F.col("f").alias("b")), "b", "left_anti"), "live")
    raise RuntimeError("stars: nodes left after 100 rounds")


def linked(entities: DataFrame, known: Words = KNOWN) -> DataFrame:
    """(id, entity): the smallest id of the entity that each id denotes, for entities with two or more ids that are persons or organisations.

    A form is one way to write a name; equal forms are one node. Forms meet in two words each of which is equal but for a slip, which all alike ones
    do; they are verified by Monge-Elkan similarity and clustered by star clustering, most mentioned forms first. A form of which only initials of the given
    name are known joins the one cluster it fits, or the one entity that lists it as an alias; if several fit it stays alone. Ids whose
    names or aliases are in one cluster are one entity. Entities whose declared types mostly say something else than person or organisation
    are left out. Null names and aliases are skipped; repeated rows count once; ties go to the smaller form.
    """
    rows = entities.filter("id is not null").select("id", "name", "aliases", F.upper(F.trim("entity_type")).alias("type")).distinct()
    said = cut(rows.mapInPandas(_forms(known), _FORM).withColumn("f", F.xxhash64("form")), "said")
    # the shortest list of words stands for a form, so that a middle initial isn't lost or won by chance
    forms = said.groupBy("f").agg(F.count_distinct("id").alias("mentions"), F.min(F.struct("kind", F.size("words").alias("n"), "words")).alias("w"), F.min("weak").alias("weak"))
    forms = cut(forms.select("f", "mentions", "w.kind", "w.words", "weak", F.struct((-F.col("mentions")).alias("m"), "f").alias("rank")), "forms")
    x = forms.select(F.col("f").alias("a"), F.col("words").alias("wa"), F.col("kind").alias("ka"), F.col("weak").alias("xa"))
    y = forms.select(F.col("f").alias("b"), F.col("words").alias("wb"), F.col("kind").alias("kb"), F.col("weak").alias("xb"))
    met = meetings(forms, known).join(x, "a").join(y, "b").filter("ka = kb")
    good = met.withColumn("s", _alike(known)("wa", "wb", "ka")).filter(F.col("s") >= LEAST)
    good = cut(good.select("a", "b", "s", "xa", "xb"), "good")
    both = good.unionByName(good.select(F.col("b").alias("a"), F.col("a").alias("b"), "s", F.col("xb").alias("xa"), F.col("xa").alias("xb")))
    clear = cut(stars(forms.filter("not weak"), both.filter("not xa and not xb").select("a", "b", "s")), "clear")
    weak = both.filter("xa and not xb").join(clear.select(F.col("f").alias("b"), "centre"), "b").groupBy(F.col("a").alias("f")).agg(F.min("centre").alias("lo"), F.max("centre").alias("hi"))
    # what an entity's rows call it, before weak forms
    named = said.select("id", "f").distinct()
    of = named.join(clear, "f").select("id", "centre")
    ids = of.groupBy("id").agg(F.min("centre").alias("first"))
    links = of.join(ids, "id").select(F.col("centre").alias("a"), F.col("first").alias("b"))
    root = cut(components(links), "root")
    place = lambda d, c: d.join(root.select(F.col("id").alias(c), F.col("root").alias(f"{c}_root")), c, "left").withColumn(f"{c}_root", F.coalesce(f"{c}_root", c))
    entity = place(ids.select("id", F.col("first").alias("c")), "c").select("id", F.col("c_root").alias("root"))
    fits = place(place(weak, "lo"), "hi").filter("lo_root = hi_root").select("f", F.col("lo_root").alias("root"))
    listed = said.filter("weak").join(entity, "id").groupBy("f").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo = hi").select("f", F.col("lo").alias("root"))
    weak_root = cut(listed.unionByName(fits).groupBy("f").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo = hi").select("f", F.col("lo").alias("root")), "weak")
    all_of = entity.unionByName(named.join(weak_root, "f").select("id", "root")).distinct()
    first = all_of.groupBy("id").agg(F.min("root").alias("first"))
    joined = cut(components(all_of.join(first, "id").select(F.col("root").alias("a"), F.col("first").alias("b"))), "joined")
    final = first.join(joined.select(F.col("id").alias("first"), F.col("root").alias("up")), "first", "left").select("id", F.coalesce("up", "first").alias("root"))
    types = rows.groupBy("id").agg(F.max(F.col("type").isin("PERSON", "ORGANIZATION", "ORGANISATION").cast("int")).alias("yes"), F.max((F.col("type").isNotNull() & ~F.col("type").isin("PERSON", "ORGANIZATION", "ORGANISATION")).cast("int")).alias("no"))
    voted = final.join(types, "id").groupBy("root").agg(F.min("id").alias("entity"), F.count("*").alias("size"), F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    voted = voted.filter("size > 1 and coalesce(yes, 0) >= coalesce(no, 0)")
    final = cut(final, "final")
    return join_hot(final, voted, ["root"], "size", final.count()).select("id", "entity")


def pairs(entities: DataFrame, known: Words = KNOWN) -> DataFrame:
    """(id_a, id_b): each pair of ids of one entity."""
    of = cut(linked(entities, known), "linked")
    return of.select(F.col("id").alias("id_a"), "entity").join(of.select(F.col("id").alias("id_b"), "entity"), "entity").filter("id_a < id_b").select("id_a", "id_b")
