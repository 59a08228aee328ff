import io
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from lumbra.functions import hashing
from lumbra.functions import text as X
from lumbra.operators import acl, dedup, prompt, rewrite, segment, store
from lumbra.plans.config import Config, expand
from lumbra.plans.engine import Engine
from lumbra.sources import files, parsers, pdf
from lumbra.streaming import ingest

ABC = "66c7f0f462eeedd9d1f2d46bdc10e4e24167c4875cf2f7a2297da02b8f4ba8e0"


def test_sm3(spark):
    assert hashing.sm3_hex(b"abc") == hashing._sm3(b"abc") == ABC
    assert hashing._sm3(b"x" * 200) == hashing.sm3_hex(b"x" * 200)
    df = spark.createDataFrame([("abc",), (None,), ("",)], "c string")
    rows = df.select(hashing.sm3(df.c).alias("h"), hashing.verify(df.c, df.c).alias("v")).collect()
    assert rows[0]["h"] == ABC and rows[1]["h"] is None and len(rows[2]["h"]) == 64


@pytest.mark.parametrize("path,kind", [("a.PDF", "pdf"), ("x/b.docx", "docx"), ("c.markdown", "md"), ("d.htm", "html"), ("C:\\t\\e.csv", "csv"), ("f.json", "json"), ("noext", "txt"), ("g.unknown", "txt"), ("dir.md/h", "txt")])
def test_types(spark, path, kind):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(X.doc_type(df.p)).first()[0] == kind


def test_markdown():
    p = parsers.markdown("# T\nIntro\nmore\n## S\n- one\n---\n```go\nx := 1\n```\n### Sub\ntext\n## S2", "f/x.md")
    assert p.title == "T"
    assert [(e.type, e.text, e.section) for e in p.elements] == [
        ("paragraph", "Intro more", ()), ("heading", "S", ("S",)), ("list", "", ("S",)), ("separator", "", ("S",)), ("code_block", "x := 1", ("S",)),
        ("heading", "Sub", ("S", "Sub")), ("paragraph", "text", ("S", "Sub")), ("heading", "S2", ("S2",)),
    ]


def test_html():
    page = "<html><title> A <b>B</b></title><script>x='</p>'</script><h1>H</h1><ul><li>i</li></ul><p>a<br>b</p><table><tr><th>x</th></tr><tr><td>1</td></tr></table><pre>c</pre></html>"
    p = parsers.html(page, "x.html")
    assert p.title == "A B"
    assert [(e.type, e.text or e.items or e.rows) for e in p.elements] == [("heading", "H"), ("list", ["i"]), ("paragraph", "a\nb"), ("table", [["1"]]), ("code_block", "c")]
    assert parsers.html("just text", "t.html").elements[0].text == "just text"


def test_html_keeps_nesting():
    page = "<div>a<p>b<p>c</div>d<ul><li>one <b>two</b><ul><li>in</ul><li>three</ul><pre><code class='language-go'>x &lt; 1\n  y</code></pre><table><tr><td>h<td>k<tr><td>1<td><p>2</p></table><section><h2>S</h2>e<hr>f</section><li>alone"
    got = [(e.type, e.text or e.items or (e.headers, e.rows)) for e in parsers.html(page, "x.html").elements if e.type != "separator"]
    assert got == [
        ("paragraph", "a"), ("paragraph", "b"), ("paragraph", "c"), ("paragraph", "d"), ("list", ["one two", "three"]), ("list", ["in"]), ("code_block", "x < 1\n  y"), ("table", (["h", "k"], [["1", "2"]])),
        ("heading", "S"), ("paragraph", "e"), ("paragraph", "f"), ("list", ["alone"]),
    ]
    began = time.time()
    for t in ("<a " * 30_000, "<div>" * 3_000, "<p>x" * 30_000, "<!--" * 20_000, "&amp" * 30_000):
        parsers.html(t, "x.html")
    assert time.time() - began < 20


def test_markdown_fences_without_end():
    got = [(e.type, e.text) for e in parsers.markdown("a\n```py\nx = 1\n# no heading\n- no item", "x.md").elements]
    assert got == [("code_block", "x = 1\n# no heading\n- no item"), ("paragraph", "a")]
    assert [e.type for e in parsers.markdown("#no\n\n - x\n- \n", "x.md").elements] == ["list", "paragraph"]


def test_csv_and_json_documents(spark):
    rows = [("a.csv", b"h,k\n1,2\n3,4"), ("b.csv", b"h,k\n1"), ("c.json", b"[1]"), ("d.json", b"3")]
    docs = {r["source"]: r for r in files.documents(spark.createDataFrame(rows, "source string, data binary")).collect()}
    assert docs["a.csv"]["content"] == "记录 1: h: 1, k: 2\n记录 2: h: 3, k: 4" and docs["a.csv"]["metadata"] == {"rows": "2", "columns": "2", "headers": "h,k"}
    assert docs["b.csv"]["error"] and docs["c.json"]["metadata"]["json_type"] == "array" and docs["d.json"]["content"] == "3"


def test_tables_and_json():
    assert parsers.csv_table("a,b\n1,2\n3", "x.csv").elements[0].rows == [["1", "2"], ["3"]]
    assert parsers.csv_text("a,b\n1,2") == "记录 1: a: 1, b: 2"
    with pytest.raises(ValueError):
        parsers.csv_text("a,b\n1")
    assert [parsers.json_kind(v) for v in ({}, [], "s", 1, True, None)] == ["object", "array", "string", "number", "boolean", "null"]
    assert parsers.parse(b"{", "x.json").error.startswith("JSONDecodeError")
    assert parsers.json_block('{"b":1,"a":2}', "x.json").elements[0].text.index('"a"') < 5


def docx_bytes(body: str) -> bytes:
    out = io.BytesIO()
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
        z.writestr("docProps/core.xml", '<c xmlns:dc="d"><dc:creator>Me</dc:creator></c>')
    return out.getvalue()


def test_docx():
    run = lambda t, s="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{s}{chr(34)}/></w:pPr>" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    p = parsers.docx(docx_bytes(run("Big", "Title") + run("H", "Heading2") + run("text") + "<w:tbl><w:tr><w:tc>" + run("c") + "</w:tc></w:tr></w:tbl>"), "x.docx")
    assert p.title == "Big" and p.metadata["creator"] == "Me"
    assert [(e.type, e.level) for e in p.elements] == [("heading", 1), ("heading", 2), ("paragraph", None), ("table", None)]
    assert parsers.parse(b"not a zip", "x.docx").error.startswith("BadZipFile")


def test_pages():
    elements, scanned = parsers.page_elements(["Title\n\nA sentence.", "", ""])
    assert [e.type for e in elements] == ["heading", "paragraph"] and scanned
    assert parsers.parse(b"%PDF", "x.pdf").error


def test_pdf_pages_round_trip(spark):
    texts = ["Title ü 中\n\nA sentence (with) \\signs.", "", "page three \U0001f600"]
    assert pdf.pages(pdf.write(texts)) == texts
    old = b"%PDF-1.4\n1 0 obj << /Type /Page /Contents [2 0 R 3 0 R] >> endobj\n2 0 obj << >> stream\nBT (Hel\\(lo\\)) Tj [(wo) -300 (rld\\351)] TJ ET\nendstream endobj\n3 0 obj << >> stream\nBT <41 42> Tj T* (x) ' ET\nendstream endobj"
    assert pdf.pages(old) == ["Hel(lo)wo rld\u00e9\nAB\n\nx"]
    for bad in (b"no", b"%PDF-1.4 trailer << /Encrypt 9 0 R >>"):
        with pytest.raises(ValueError):
            pdf.pages(bad)
    assert pdf.pages(b"%PDF-1.4") == [] and parsers.parse(pdf.write([""]), "x.pdf").error.startswith("ValueError: no text")
    rows = spark.createDataFrame([("a.pdf", "Head\fbody ends."), ("b.pdf", None)], "source string, content string")
    got = {r["source"]: r for r in files.documents(files.to_pdf(rows)).collect()}
    assert got["a.pdf"]["content"] == "Head\n\nbody ends." and got["a.pdf"]["metadata"] == {"page_count": "2"} and got["b.pdf"]["error"]


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A\ntext\n\n- x")
    (tmp_path / "b.txt").write_text("one\n\ntwo")
    (tmp_path / "c.bin").write_bytes(b"\0")
    (tmp_path / "e.json").write_text("{")
    found = files.scan(spark, str(tmp_path))
    docs = {r["title"]: r for r in files.documents(found).collect()}
    assert set(docs) == {"A", "b", "e"} and docs["b"]["content"] == "one\n\ntwo" and docs["e"]["error"]
    text = {r["source"][-4:]: r["content"] for r in files.render(files.elements(found)).collect()}
    assert text["a.md"] == "text\n\n- x" or "- x" in text["a.md"]
    report = ingest.batch_report(files.documents(found)).first()
    assert (report["total"], report["failed"]) == (3, 1)
    counts = {r["source"][-5:]: r["paragraphs"] for r in files.counts(files.elements(found)).collect()}
    assert counts["b.txt"] == 2


def test_html_functions(spark):
    h = "<title> T </title><p>a &amp; b</p>\n\n <i>x</i> > y <open"
    df = spark.createDataFrame([(h, "&lt;&amp;lt;&hellip;", "---\na: 1\n# c: 2\nb: \"x:y\"\na: 3\n---\nbody")], "h string, e string, m string")
    r = df.select(X.strip_tags(df.h), X.html_title(df.h), X.decode_entities(df.e), X.front_matter(df.m), X.markdown_title(df.h)).first()
    assert r[0] == "T a &amp; b\nx  y" and r[1] == "T" and r[2] == "<<…" and r[3] == {"a": "3", "b": "x:y"} and r[4] == ""


def test_dedup(spark):
    rows = [(1, "x", 3), (2, "x", 1), (3, "y", 1), (4, None, 0), (5, "", 0), (6, "", 0), (7, "x", 1)]
    docs = spark.createDataFrame(rows, "id int, content string, created_at int")
    got = {r["id"]: r["existing_id"] for r in dedup.mark(docs).collect() if r["is_duplicate"]}
    assert got == {1: 2, 7: 2}
    assert dedup.mark(docs, enabled=False).filter("is_duplicate").count() == 0
    assert dedup.mark(docs, sm3=True).filter("is_duplicate").count() == 2
    assert dedup.stats(dedup.mark(docs)).first()["duplicates"] == 2


def test_hash_index(spark):
    docs = spark.createDataFrame([("a", "x", 1, "s"), ("b", "x", 2, "s")], "id string, content string, created_at int, source string")
    ix = dedup.hash_index(docs)
    assert [r["document_id"] for r in ix.collect()] == ["a"]
    new = ix.selectExpr("hash", "'c' AS document_id", "content_size", "9 AS created_at", "source")
    assert [r["document_id"] for r in dedup.put(ix, new).collect()] == ["c"]
    assert dedup.remove(ix, spark.createDataFrame([("a",)], "document_id string")).count() == 0
    assert dedup.lookup(ix, ix.select("hash")).count() == 1


def test_rewriters(spark):
    q = spark.createDataFrame([("1", "AI technology"), ("2", "hello world"), ("3", "")], "query_id string, query string")
    s = spark.createDataFrame([("AI", "machine"), ("AI", "brain")], "word string, synonym string")
    got = {}
    for r in rewrite.synonyms(q, s).orderBy("query_id", "ord").collect():
        got.setdefault(r["query_id"], []).append(r["query"])
    assert got == {"1": ["AI technology", "brain technology", "machine technology"], "2": ["hello world"], "3": [""]}
    assert rewrite.hyde(q, lambda x: "doc").count() == 6
    assert [r["query"] for r in rewrite.multi_query(q.limit(1), lambda x: f"{x}\n\n b \nc\nd", 2).orderBy("ord").collect()] == ["AI technology", "b", "c"]
    chain = spark.createDataFrame([("database", "DB")], "word string, synonym string"), spark.createDataFrame([("DB", "DataBase")], "word string, synonym string")
    one = spark.createDataFrame([("1", "database")], "query_id string, query string")

    def fail(df):
        raise RuntimeError("no")

    out, errors = rewrite.composite(one, [lambda d: rewrite.synonyms(d, chain[0]), fail, lambda d: rewrite.synonyms(d, chain[1])])
    assert sorted(r["query"] for r in out.collect()) == ["DB", "DataBase", "database"] and len(errors) == 1


def test_acl(spark):
    a = spark.createDataFrame([("1", "o", ["r"], ["w"], False, ["g"]), ("2", "x", None, None, True, None), ("3", None, None, ["o"], None, None)], "doc_id string, owner string, readers array<string>, writers array<string>, public boolean, groups array<string>")
    reads = lambda u: {r["doc_id"] for r in a.filter(acl.can_read(F.lit(u))).collect()}
    assert reads("o") == {"1", "2", "3"} and reads("r") == {"1", "2"} and reads("w") == {"1", "2"} and reads("g") == {"2"}
    assert {r["doc_id"] for r in acl.list_documents(a, "w").collect()} == {"2"}
    assert {r["doc_id"] for r in acl.list_documents(acl.grant(a, "3", "w"), "w").collect()} == {"2", "3"}
    assert {r["doc_id"] for r in acl.list_documents(acl.revoke(a, "1", "r"), "r").collect()} == {"2"}
    assert acl.create(acl.delete(a, "1"), "9", "me").count() == 3
    assert {r["doc_id"] for r in acl.list_documents(acl.set_public(a, "2", False), "q").collect()} == set()


def test_store(spark):
    docs = spark.createDataFrame([("a", "t", "c", 1, "txt", "indexed"), ("b", "t", "", 1, "zip", "odd")], "id string, title string, content string, version int, doc_type string, status string")
    up = {r["id"]: r["version"] for r in store.update(docs, docs.filter("id = 'a'").withColumn("title", docs.content)).collect()}
    assert up == {"a": 2, "b": 1}
    assert {r["id"]: list(r["problems"]) for r in store.checked(docs).collect()} == {"a": [], "b": ["no content", "unknown type", "unknown status"]}
    with pytest.raises(Exception, match="exists"):
        store.create(docs, docs.limit(1)).collect()
    assert store.delete(docs, docs.select("id").limit(1)).count() == 1


def test_prompts(spark):
    q = spark.createDataFrame([("1", "why?"), ("2", "none")], "query_id string, query string")
    r = spark.createDataFrame([("1", 2, "B" * 400, "", 0.0), ("1", 1, "A", "s", 0.5)], "query_id string, rank int, content string, source string, score double")
    assert prompt.context(r).first()["context"].startswith("[1] A\nsource: s\n\n[2] BBB")
    p = {x["query_id"]: x["prompt"] for x in prompt.prompt(q, r).collect()}
    assert p["1"].index("Reference 1") < p["1"].index("Reference 2") and "References" not in p["2"]
    a = {x["query_id"]: x["answer"] for x in prompt.fallback_answer(q, r).collect()}
    assert "1. s (score 0.50)" in a["1"] and "2. source 2\n   BBB" in a["1"] and a["1"].endswith("...") and a["2"].startswith("Nothing")


def test_segmentation():
    d = segment.Dictionary({"知识": 10, "图谱": 10, "知识图谱": 8})
    assert d.tokens("知识图谱x1") == ["知识图谱", "x1"]
    assert d.tokens("知识图谱", "search") == ["知识", "图谱", "知识图谱"]
    assert d.tokens("知识图谱", "all") == ["知识", "知识图谱", "图谱"]
    assert d.add("谱x", 1, "v").tokens("，！") == []
    assert segment.Dictionary({"a": 1}).split("未知") == ["未", "知"]


def test_config(monkeypatch):
    monkeypatch.setenv("LUMBRA_K", "7")
    assert expand("${LUMBRA_K}/${LUMBRA_NONE:-x}") == "7/x"
    assert Config().merged({"top_k": 3, "rrf_k": None}).top_k == 3
    for bad in ({"top_k": 0}, {"fusion": "x"}, {"nope": 1}):
        with pytest.raises(ValueError):
            Config().merged(bad)


def test_engine(spark, tmp_path):
    rows = [("1", "Go", "golang is great", "s1", 1), ("2", "Py", "python is popular", "s2", 2), ("3", "Go copy", "golang is great", "s3", 3)]
    docs = spark.createDataFrame(rows, "id string, title string, content string, source string, created_at int")
    e = Engine()
    c = e.index(docs)
    assert c.documents.count() == 2 and c.chunks.count() == 2
    q = spark.createDataFrame([("q", "popular python")], "query_id string, query string")
    for mode in ("keyword", "vector", "hybrid"):
        assert e.search(c, q, mode, 2).orderBy("rank").first()["id"] == "2"
    assert "python is popular" in e.ask(c, q, mode="keyword").first()["answer"]
    assert e.ask(c, q, lambda p: p[:6], mode="keyword").first()["answer"] == "Answer"
    more = e.add(c, spark.createDataFrame([("2", "Py", "rust instead", "s2", 4), ("4", "x", "golang is great", "s", 5)], docs.schema))
    assert {r["id"] for r in more.documents.collect()} == {"1", "2"} and e.search(more, q, "keyword").count() == 0
    assert e.remove(more, more.documents.select("id")).chunks.count() == 0
    c.save(str(tmp_path / "corpus"))
    assert e.search(e.load(spark, str(tmp_path / "corpus")), q, "keyword", 1, rerank_hits=True).first()["id"] == "2"
    with pytest.raises(ValueError):
        e.search(c, q, "nope")


def test_stream_equals_batch(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "a.txt").write_text("one")
    ingest.start(ingest.watch(spark, str(source), [".txt"]), str(out)).awaitTermination()
    (source / "b.txt").write_text("two")
    (source / "c.csv").write_text("x")
    ingest.start(ingest.watch(spark, str(source), [".txt"]), str(out)).awaitTermination()
    got = sorted(r["content"] for r in ingest.latest(ingest.read(spark, str(out))).collect())
    assert got == ["one", "two"]
    now = files.scan(spark, str(source), [".txt"]).select("source", "modified")
    assert ingest.changes(now.limit(0), now).filter("event = 'create'").count() == 2
    assert ingest.changes(now, now.limit(0)).filter("event = 'delete'").count() == 2
