import re
import time

import pytest
from pyspark.sql import functions as F

from lumbra.llm import garbled, markup, mixing, packing, sizes

PLAIN = [
    "Its type is array<float> in the table; use map<string, list<int>> where 5 > 3 holds.", "Ticket #9689 costs $5 or $7 per loader.", "A copy lies in C:\\data\\label\\new for it.", "The C# client sends a & b.",
    "Multiply 3 * 85 * 5 to size it.", "Set top_k_limit and rrf_k_value.", "Ratio ~93% means |x| < 2 = y.", "Footnote [3] and item {84} mention it.", '{"a": "b\\nThe c", "n": [1, 2]}', "Key: value\nOther: x", "", " \n ", "- ", "1. one point only",
]
MARKED = {
    "html": ["a<br/>b", "&lt;b&gt;x&lt;/b&gt;", "the role &mdash; x", "<!-- n -->", "<EM>x</EM>", "it&#8217;s"],
    "markdown": ["# Head\n\ntext", "a **b** c", "see [x](y.md)", "![p](q.png)", "```\ncode\n```", "| a | b |\n|---|:-:|\n| 1 | 2 |", "* one\n* two", "Head\n----\ntext", "a `b` c", "~~x~~", "根据~~x~~根据"],
    "wiki": ["== H ==\n", "[[A|b]]", "{{stub|x}}", "'''b'''", "x<ref>n</ref>"],
    "latex": ["\\section{A}", "\\emph{x} y", "\\begin{verbatim}\nx\n\\end{verbatim}", "so $x_{1}$ holds", "\\[ a \\]", "a\\cite{b}"],
}


@pytest.mark.parametrize("text", PLAIN)
def test_plain_text_stays(text):
    assert markup.kinds(text) == []


@pytest.mark.parametrize("kind,text", [(k, t) for k, ts in MARKED.items() for t in ts])
def test_markup_is_found_and_goes(kind, text):
    assert kind in markup.kinds(text)
    left = markup.clean(text)
    assert not markup.TAG.search(left) and "[[" not in left and "{{" not in left and "\\emph" not in left and "](" not in left


def test_structure_stays():
    page = '<html><head><title>t</title><script>var x="<p>";</script></head><body><nav><a href=x>home</a></nav><h2>Big</h2><p>one &amp; <b>two</b></p><ol><li>a<li>b</ol><table><tr><td>1</td><td>2</td></tr></table><pre><code class="language-go">a &lt; b</code></pre></body></html>'
    assert markup.clean(page) == "## Big\n\none & two\n\n1. a\n2. b\n\n1 | 2\n\n```go\na < b\n```"
    assert markup.clean("\\section{S}\n\\begin{itemize}\n \\item a \\emph{b}\n\\end{itemize}\n\\[ \\alpha \\]") == "# S\n\n- a b\n\n\\[ \\alpha \\]"


LINKS = ["Home page", "All our products and services", "About us", "Contact the team today", "Terms of use", "News from the field", "Careers and open places", "Sign in"]
MENUS = {
    "nav": "<nav><ul>" + "".join(f"<li><a href=x>{t}</a></li>" for t in LINKS) + "</ul></nav>",
    "bare list": "<ul>" + "".join(f"<li><a href='/{i}'>{t}</a></li>" for i, t in enumerate(LINKS * 4)) + "</ul>",
    "header": "<header><div>Our great company since 1999</div>" + "".join(f'<a href="x">{t}</a>' for t in LINKS) + "</header>",
}
TEXT = "<h1>On indexes</h1><p>An index maps each word to the records that hold it, with <a href=y>their places</a>. It is built once and read often.</p><ul><li>one short point</li><li>another <b>short</b> point</li></ul><p>See also <a href=z>the manual</a></p>"
FOOTERS = ["<footer>Copyright of this company, all rights are reserved here.</footer>", "<footer><p>" + "Long legal words that nobody reads at all. " * 12 + "</p><a href=x>Imprint</a></footer>", ""]


@pytest.mark.parametrize("menu", MENUS.values(), ids=MENUS)
@pytest.mark.parametrize("footer", FOOTERS, ids=["short", "long", "none"])
def test_menus_and_footers_go_and_all_content_stays(menu, footer):
    want = "# On indexes\n\nAn index maps each word to the records that hold it, with their places. It is built once and read often.\n\n- one short point\n\n- another short point\n\nSee also the manual"
    assert re.sub(r"\n\s*\n", "\n\n", markup.clean(f"<html><head><title>t</title></head><body>{menu}{TEXT}{footer}</body></html>")) == want


def test_long_pages_keep_code_and_other_scripts():
    code = "<pre><code>" + "x = 1\n" * 400 + "</code></pre>"
    got = markup.clean(f"<body>{MENUS['nav']}<p>索引把每个词映射到记录，并且经常读取，然后更新目录与词典。</p>{code}<p>最后一段文字也在这里，说明如何恢复快照与日志。</p></body>")
    assert got.startswith("索引") and got.count("x = 1") == 400 and got.endswith("日志。")


@pytest.mark.parametrize("text,kind", [
    ("so $" + "a_{1} + " * 40 + "b$ holds", "latex"), ("`" + "x " * 200 + "`", "markdown"), ("**" + "字" * 300 + "**", "markdown"), ("an *" + "very " * 40 + "long* point", "markdown"), ("$$" + "a + " * 2000 + "b$$", "latex"), ("\\[" + "a + " * 2000 + "b\\]", "latex"),
    ("see <custom-tag> here", "html"), ("<svg:path> x", "html"), ("<widget size='2'>", "html"), ("a</thing>", "html"), ("a <thing/> b", "html"), ("\\textcolor{red}{x}", "latex"), ("\\mycommand{x}", "latex"), ("&lt;a " + "href " * 100 + "&gt;", "html"),
])
def test_markup_of_any_length_and_name(text, kind):
    assert kind in markup.kinds(text)


def test_other_names_are_cleaned():
    assert markup.clean("a <my-box>b</my-box> <thing>c</thing> <x/>d") == "a b c d"
    assert markup.clean("a \\textcolor{red}{b} \\mine[o]{c}") == "a b c"
    assert markup.clean('x <math alttext="a_1 &lt; b"></math> y') == "x $a_1 < b$ y"
    assert markup.clean("p \\begin{equation}\\begin{aligned}a\\end{aligned}\\end{equation} q \\(b\\)") == "p \\begin{equation}\\begin{aligned}a\\end{aligned}\\end{equation} q \\(b\\)"


@pytest.mark.parametrize("text", ["type List<String> or Map<K, V> and array<float>", "if a < b and c > d", "C:\\new\\data and \\d{4} or \\w+", "costs $5 to $7, or 5$ a day", "a<b>c" .replace("<b>", "<7>"), "$HOME and ${PATH}"])
def test_more_plain_text_stays(text):
    assert markup.kinds(text) == []


def test_best_region_is_the_largest_sum():
    import itertools
    import random

    r = random.Random(1)
    for _ in range(200):
        s = [r.choice([-3, -1, 0.5, 1, 2]) for _ in range(r.randint(0, 12))]
        best = max([0.0, *(sum(s[i:j]) for i, j in itertools.combinations(range(len(s) + 1), 2))])
        a, b = markup.region(s)
        assert sum(s[a:b]) == pytest.approx(best)


def test_long_texts_take_linear_time():
    n = 100_000
    began = time.time()
    for t in ("*" * n, "<a " * (n // 3), "[a](" * (n // 4), " " * n, "&lt;a " * (n // 6), "$a_" * (n // 3), "`a" * (n // 2), "</x>" * (n // 4), "<x-y " * (n // 5), "\\begin{math}" * (n // 12), "\\ab{" * (n // 5), "\\ab[" * (n // 5), "**字" * (n // 3), "__a" * (n // 3), "\\[" * (n // 2), "word " * (n // 5), "词" * n):
        markup.clean(t)
        garbled.repair(t)
    assert time.time() - began < 20


PAIRS = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp437"), ("utf-8", "cp1251"), ("mac_roman", "cp1252"), ("cp850", "cp1252")]
SENTENCES = ["Die Prüfung läuft möglichst täglich über Nacht.", "Le café créé résume la donnée répétée.", "El año pequeño cambia la señal después."]


@pytest.mark.parametrize("written,read", PAIRS)
@pytest.mark.parametrize("text", SENTENCES)
def test_damage_round_trip(written, read, text):
    bad = garbled._read(text.encode(written), read)
    good, places, whole = garbled.repair(bad)
    assert places > 0 and good == text and whole
    mixed = garbled.repair("Ganz richtige Wörter – “quoted”. " + bad)[0] if written == "utf-8" else None
    assert mixed is None or mixed == "Ganz richtige Wörter – “quoted”. " + text


def test_damage_of_other_scripts():
    zh, ru = "夜间词典与快照由归档网关更新，手册负责恢复。", "Быстрый поиск считает новый запрос."
    assert garbled.repair(zh.encode("gbk").decode("latin-1"))[0] == zh
    assert garbled.repair(garbled._read(zh.encode(), "cp1252"))[0] == zh
    assert garbled.repair(ru.encode("cp1251").decode("latin-1"))[0] == ru
    assert garbled.repair(ru.encode("koi8-r").decode("cp1251"))[1] > 0
    assert garbled.repair(garbled._read(ru.encode(), "cp1251"))[0] == ru
    twice = garbled._read(garbled._read("résumé über".encode(), "cp1252").encode(), "cp1252")
    assert garbled.repair(twice)[0] == "résumé über"
    assert garbled.repair("Cr�me")[1:] == (1, False)
    assert garbled.repair("锟斤拷时")[1] > 0


RUSSIAN = "Быстрый поиск считает новый запрос, а сервер отчётов хранит ответы."
LAYERS = [
    (RUSSIAN, ["koi8-r"]), (RUSSIAN, ["cp866"]), (RUSSIAN, ["cp1252"]), (RUSSIAN, ["latin-1", "latin-1", "latin-1"]), ("résumé über naïve Œuvre", ["latin-1"] * 3), ("日本語の文書はひらがなとカタカナで書く。", ["cp1252"]),
    ("한국어 문서를 색인에 넣는다", ["cp1252"]), ("המסמך נמצא באינדקס של המערכת", ["cp1252"]), ("दस्तावेज़ सूची में है", ["cp1252"]), ("เอกสารอยู่ในดัชนี", ["cp1252"]), ("Το έγγραφο είναι στο ευρετήριο", ["cp1252"]), ("夜间词典与快照由归档网关更新", ["cp1252", "cp1252"]),
    ("سجل المستند في الفهرس", ["cp1252"]), ("Zażółć gęślą jaźń po południu", ["cp1250"]), ("Příliš žluťoučký kůň", ["cp1252"]), ("a “quoted” – word…", ["cp437"]), ("Größe über Maß", ["cp852"]),
]


@pytest.mark.parametrize("text,layers", LAYERS)
def test_utf8_read_in_any_set_comes_back(text, layers):
    bad = text
    for charset in layers:
        bad = garbled._read(bad.encode(), charset)
    assert garbled.repair(bad)[0] == text and garbled.repair(bad)[1] > 0


@pytest.mark.parametrize("text,written,read", [
    (RUSSIAN, "cp866", "cp1251"), (RUSSIAN, "koi8-r", "cp1251"), (RUSSIAN, "cp1251", "koi8-r"), (RUSSIAN, "iso8859-5", "latin-1"), (RUSSIAN, "koi8-r", "latin-1"), ("索引夜间更新词典与快照，手册负责恢复。", "big5", "latin-1"), ("文書はひらがなとカタカナで書かれています。", "shift_jis", "cp1252"),
    ("文書はひらがなとカタカナで書かれています。", "euc_jp", "latin-1"), ("한국어 문서를 색인에 넣는다", "euc_kr", "latin-1"), ("Το έγγραφο είναι στο ευρετήριο της μηχανής", "cp1253", "latin-1"), ("Zażółcona łąka i żółta jabłoń", "cp1250", "cp1252"),
])
def test_other_sets_come_back(text, written, read):
    try:
        bad = garbled._read(text.encode(written), read)
    except UnicodeEncodeError:
        bad = garbled._read(text.translate(str.maketrans("间词与复册负责", "間詞與復冊負責")).encode(written, "ignore"), read)
        text = garbled._written(bad, read).decode(written)
    got = garbled.repair(bad)
    assert got[1] > 0 and (got[0] == text or sum(a != b for a, b in zip(got[0], text, strict=False)) < 4), got


@pytest.mark.parametrize("text", ["see note†ref here", "abc¶def", "the naïve™s case", "señor¿qué?", "версии колізії дії надії", "хлещем щи цена щей", "┌─┐\n│x│\n└─┘ ├─┤", "3 ×\xa05 und Ж\xa0и к\xa0письму", "ДНЕВНОЙ ОТЧЁТ КОПИРУЕТ", "Après l’été, l’élève", "ћирилица у нашем језику", "Ελληνικά ΚΕΦΑΛΑΙΑ κείμενα", "日本語とカタカナ", "한국어 문서", "Ünïcödé ÀÉÈ ŠŽ"])
def test_right_text_is_left_alone(text):
    assert garbled.repair(text) == (text, 0, True)


@pytest.mark.parametrize("text", ["Søren in Århus; “naïve” – Łódź, Žofín, Kőszeg …", "A INTEGRAÇÃO, MANHÃ e SÃO João", "nÄHE pRÜFT", "5 °C, 3 × 5, ≈ 2 µ, § 4, 40 € ½", "词典与快照", "ОБЩИЙ реестр", "", None, "plain"])
def test_sound_text_stays(text):
    assert garbled.repair(text) == (text, 0, True)


def test_operators_take_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, "<b>a</b> Ã©", "y"), (3, "", None), (3, "", None)], "doc_id long, content string, clean_text string")
    assert sorted(r["kinds"] for r in markup.cleaned(docs).collect()) == ["", "", "", "html"]
    assert sorted(r["places"] for r in garbled.repaired(docs, text="content").collect()) == [0, 0, 0, 1]
    assert markup.cleaned(docs.limit(0)).count() == 0 and garbled.repaired(docs.limit(0), text="content").count() == 0


# Packing.


def test_two_that_fit_better():
    import numpy as np

    where = packing.best_two_fit(np.array([6, 3, 2, 2]), 10)
    assert where[0] == where[2] == where[3] and where[1] != where[0]  # 6 + 3 leaves 1; 6 + 2 + 2 fills it
    r = np.random.default_rng(0)
    for cap in (7, 50):
        s = r.integers(0, cap, 500)
        w = packing.best_two_fit(s, cap)
        assert (w >= 0).all() and np.bincount(w, s).max() <= cap
    assert len(packing.best_two_fit(np.array([], int), 5)) == 0


def test_packing_keeps_everything(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = docs.limit(2).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.col("doc_id") + 10_000_000)
    docs = docs.unionByName(extra)
    budgets = spark.read.parquet(f"{sf}/context_budgets.parquet")
    out = packing.packed(docs, budgets).cache()
    sized = {r["doc_id"]: sizes.count(r["text"]) for r in docs.collect()}
    for b in budgets.collect():
        rows = out.filter(F.col("budget_name") == b["budget_name"]).collect()
        per_doc, per_bin = {}, {}
        for r in rows:
            per_doc.setdefault(r["doc_id"], []).append((r["piece"], r["tokens"]))
            per_bin[r["container"]] = per_bin.get(r["container"], 0) + r["tokens"]
        assert {d: sum(t for _, t in p) for d, p in per_doc.items()} == sized
        assert all(len(p) == max(1, -(-sized[d] // b["capacity_tokens"])) for d, p in per_doc.items())
        assert max(per_bin.values()) <= b["capacity_tokens"]
    assert min(r["fill"] for r in packing.report(out, budgets).collect()) > 0.75
    assert packing.packed(docs.limit(0), budgets).count() == 0


# Mixing.


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text string, tokens string")


def targets_of(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_mixture_holds_shares_and_caps(spark):
    rows = [(i, "big", f"word{i} and some more text here", "x") for i in range(300)] + [(1000 + i, "small", f"small{i} text of the same kind", "x") for i in range(20)]
    rows += [(2000 + i, "both" if i % 2 else "big", f"shared{i // 2} text in two sources now", "x") for i in range(60)] + [(5000, None, "no source", "x"), (5001, "big", None, "x"), (5002, "big", "", "x")]
    targets = targets_of(spark, [("big", 0.5, 1), ("small", 0.3, 3), ("both", 0.2, 2), ("absent", 0.5, 1), ("null", None, 1)])
    mixed = mixing.mixture(docs_of(spark, rows), targets, seed=0)
    got = {r["source"]: r for r in mixing.shares(mixed, targets).collect()}
    assert got["big"]["share"] == pytest.approx(0.5, abs=0.03) and got["small"]["share"] == pytest.approx(0.3, abs=0.03) and got["absent"]["tokens"] == 0
    uses = mixed.groupBy("source").agg(F.max("uses")).collect()
    assert all(r[1] <= {"big": 1, "small": 3, "both": 2}[r[0]] for r in uses)
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, mixing.mixture(docs_of(spark, rows), targets, seed=0).collect()))


def test_starved_source_falls_short(spark):
    rows = [(i, "big", f"word{i} and some more text here", "x") for i in range(200)] + [(999, "tiny", "one short text", "x")]
    targets = targets_of(spark, [("big", 0.9, 1), ("tiny", 0.1, 4)])
    got = {r["source"]: r for r in mixing.shares(mixing.mixture(docs_of(spark, rows), targets, size=1500), targets).collect()}
    assert got["big"]["tokens"] == pytest.approx(1350, abs=10) and got["tiny"]["short"] and not got["big"]["short"]
    assert got["big"]["tokens"] > 1000 and got["tiny"]["most_uses"] == 4
    assert mixing.mixture(docs_of(spark, []), targets).count() == 0


def test_shares_are_nearer_than_half_a_text(spark):
    import random

    r = random.Random(3)
    rows = [(i, s, " ".join(r.choice(["red", "sea", "sun", "oak"]) + str(i) for _ in range(r.choice([3, 8, 60]))), "x") for i, s in enumerate(r.choices(["a", "b", "c"], [6, 3, 1], k=300))]
    targets = targets_of(spark, [("a", 0.2, 1), ("b", 0.5, 2), ("c", 0.3, 3)])
    got = mixing.shares(mixing.mixture(docs_of(spark, rows), targets), targets).collect()
    whole = sum(x["tokens"] for x in got)
    assert all(abs(x["tokens"] - x["target_share"] * whole) < 10 and not x["short"] for x in got) and whole > 1000
    with pytest.raises(ValueError):
        mixing.mixture(docs_of(spark, rows), targets_of(spark, [(f"s{i}", 0.05, 1) for i in range(17)]))


def test_flow_prefers_fewer_repetitions():
    from fractions import Fraction

    want, have, used = mixing.route({("a",): 100, ("a", "b"): 100}, {"a": Fraction(1, 2), "b": Fraction(1, 2)}, {"a": 2, "b": 2}, 200)
    assert want == have == 200 and used[("a",), "a"] == 100 and used[("a", "b"), "b"] == 100


def test_ample_sources_hold_their_shares(spark):
    from fractions import Fraction

    half = {"a": Fraction(1, 2), "b": Fraction(1, 2)}
    size, used = mixing.largest({("a",): 100, ("b",): 1000}, half, {"a": 1, "b": 1})
    assert size in (200, 201) and used[("a",), "a"] == used[("b",), "b"] == 100
    rows = [(i, "big", f"word{i} and some more text here", "x") for i in range(200)] + [(1000 + i, "small", f"small{i} text of the same kind", "x") for i in range(20)] + [(999, "tiny", "one short text", "x")]
    targets = targets_of(spark, [("big", 0.5, 1), ("small", 0.4, 1), ("tiny", 0.1, 4)])
    got = {r["source"]: r for r in mixing.shares(mixing.mixture(docs_of(spark, rows), targets, size=200), targets).collect()}
    assert got["big"]["tokens"] / got["small"]["tokens"] == pytest.approx(0.5 / 0.4, abs=0.1) and got["tiny"]["most_uses"] == 4


def test_registered_mixture_holds_every_share(spark, tmp_path):
    from lumbra.llm import queries

    rows = [(i, "big", f"word{i} and some more text here", "x") for i in range(200)] + [(999, "tiny", "one short text", "x")]
    docs_of(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    targets_of(spark, [("big", 0.9, 1), ("tiny", 0.1, 4)]).write.parquet(f"{tmp_path}/source_targets.parquet")
    got = {r["source"]: r["share"] for r in queries.p9_shares(spark, str(tmp_path)).collect()}
    assert got["tiny"] == pytest.approx(0.1, abs=0.01) and got["big"] == pytest.approx(0.9, abs=0.01)


def test_found_markup_is_taken_from_the_cleaning(spark, sf, monkeypatch):
    from lumbra.llm import queries

    asked, cleaned = [], markup.cleaned
    monkeypatch.setattr(markup, "cleaned", lambda *a, **k: asked.append(cleaned(*a, **k)) or asked[-1])
    found = {r["doc_id"] for r in queries.p2_found(spark, sf).collect()}
    rows = asked[0].collect()
    assert found == {r["doc_id"] for r in rows if r["kinds"]} and any(r["clean_text"] for r in rows)


@pytest.mark.parametrize("charset", ["cp437", "cp850", "mac_roman", "cp1250"])
def test_chinese_read_in_one_byte_sets_is_restored(charset):
    said = "The note 根据报告数据已归档 was filed."
    garbled_text = "".join(garbled._read(c.encode(), charset) for c in said)
    assert garbled.repair(garbled_text)[0] == said and garbled.repair(garbled_text)[1] > 0 and garbled.repair(said)[:2] == (said, 0)
