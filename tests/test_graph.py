import pytest

from lumbra.operators import graph
from lumbra.session import cut

E = "id string, name string, type string, aliases array<string>, source_doc_id string, confidence double"
R = "id string, source_id string, target_id string, type string, source_doc_id string, confidence double"


@pytest.fixture(scope="module")
def g(spark):
    e = spark.createDataFrame([(x, f"Name {x}", "PERSON", [f"alias-{x}"] if x == "a" else None, f"doc-{x}", 0.5) for x in "abcde"], E)
    edges = [("1", "a", "b"), ("2", "a", "c"), ("3", "b", "d"), ("4", "c", "d"), ("5", "d", "a"), ("6", "d", "x"), ("7", "e", "e")]
    r = spark.createDataFrame([(i, s, t, "USES" if i < "3" else "PART_OF", f"doc-{s}", 0.9) for i, s, t in edges], R)
    return e, r


def ids(spark, *x):
    return spark.createDataFrame([(i,) for i in x], "id string")


def test_search_prefers_exact_and_aliases(spark, g):
    q = spark.createDataFrame([("1", "ALIAS-A"), ("2", "name"), ("3", "see Name b now"), ("4", "")], "query_id string, query string")
    rows = graph.search(g[0], q, 3).collect()
    by = {k: [r["id"] for r in sorted(rows, key=lambda r: r["rank"]) if r["query_id"] == k] for k in "1234"}
    assert by == {"1": ["a"], "2": ["a", "b", "c"], "3": ["b"], "4": []}


def test_incident(spark, g):
    assert {r["relation_id"] for r in graph.incident(g[1], ids(spark, "d")).collect()} == {"3", "4", "5", "6"}
    assert {r["relation_id"] for r in graph.incident(g[1], ids(spark, "a"), "USES").collect()} == {"1", "2"}
    assert graph.incident(g[1], ids(spark, "e")).count() == 1


def test_subgraph_levels(spark, g):
    nodes, rel = graph.subgraph(*g, ids(spark, "a", "gone"), 2)
    assert {(r["id"], r["level"]) for r in nodes.collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 1)}
    assert {r["relation_id"] for r in rel.collect()} == {"1", "2", "3", "4", "5", "6"}


def test_paths(spark, g):
    pairs = spark.createDataFrame([("a", "d"), ("a", "a"), ("a", "e")], "source string, target string")
    got = {tuple(r["edges"]) for r in graph.paths(g[1], pairs, 5).collect()}
    assert got == {("1", "3"), ("2", "4"), ("5",)}
    assert {tuple(r["nodes"]) for r in graph.paths(g[1], pairs, 1).collect()} == {("a",)}


def test_paths_search_once_from_each_target(spark, monkeypatch):
    rows = {}

    def counted(df, what="t"):
        out = cut(df, what)
        rows[what] = rows.get(what, 0) + out.count()
        return out

    monkeypatch.setattr(graph, "cut", counted)
    # 50 entities around a hub, each asking for the hub
    names = [f"n{i:02}" for i in range(50)]
    r = spark.createDataFrame([(f"r-{n}", n, "hub", "USES", None, 0.9) for n in names] + [("x", "n00", "n01", "USES", None, 0.9)], R)
    pairs = spark.createDataFrame([(n, "hub") for n in names], "source string, target string")
    got = {(x["source"], *x["edges"]) for x in graph.paths(r, pairs, 3).collect()}
    assert got == {(n, f"r-{n}") for n in names} | {("n00", "x", "r-n01"), ("n01", "x", "r-n00")}
    # the hub, and every entity once
    assert rows["reach"] == 51


def test_delete_cascades(g):
    e, r = graph.delete_document(*g, "doc-d")
    assert e.count() == 4 and {x["id"] for x in r.collect()} == {"1", "2", "7"}


def test_retrieve(spark, g):
    q = spark.createDataFrame([("q", "alias-a")], "query_id string, query string")
    assert {x["document_id"] for x in graph.retrieve(*g, q).collect()} == {"doc-a", "doc-b", "doc-c", "doc-d"}


def test_entity_rules(spark):
    docs = spark.createDataFrame([("1", '他说「向量库」和《索引》, "x", "Some Name" Apache Spark Engine 归档'), ("2", None), ("3", "golang")], "id string, content string")
    words = spark.createDataFrame([("GoLang", "TECHNOLOGY")], "word string, type string")
    rows = graph.extract_entities(docs, dictionary=words).collect()
    names = {(r["name"], r["type"]) for r in rows if r["confidence"] > 0.5}
    assert names == {("向量库", "CONCEPT"), ("索引", "PRODUCT"), ("Some Name", "CONCEPT"), ("Apache Spark Engine", "ORGANIZATION"), ("golang", "TECHNOLOGY")}
    assert ("归档", "PERSON") in {(r["name"], r["type"]) for r in rows}


def test_relation_rules(spark):
    far = spark.createDataFrame([("1", "甲使用乙")], "id string, content string")
    e = spark.createDataFrame([("1", "甲公司", "CONCEPT", 0.7, 1, 0), ("1", "乙公司", "CONCEPT", 0.7, 1, 1)], "doc_id string, name string, type string, confidence double, rule int, at int")
    assert [(r["source"], r["target"], r["type"]) for r in graph.extract_relations(far, e).collect()] == [("甲公司", "乙公司", "USES")]


def test_model_answers(spark):
    text = 'Sure: {"entities": [{"name": "A", "type": "company"}, {"name": "B"}], "relations": [{"source": "A", "target": "B", "type": "use"}, {"source": "A", "target": "C"}]} done'
    docs = spark.createDataFrame([("1", text), ("2", "no json {"), ("3", None)], "id string, content string")
    rows = graph.llm_extract(docs, lambda p: p.split("\n\n", 1)[1]).collect()
    assert {(r["kind"], r["name"], r["type"]) for r in rows} == {("entity", "A", "ORGANIZATION"), ("entity", "B", "CONCEPT"), ("relation", None, "USES")}


def test_build_ids_are_stable(spark):
    chunks = spark.createDataFrame([("c1", "d1", "Apache Spark and Apache Spark")], "id string, document_id string, content string")
    a, b = (sorted(r["id"] for r in graph.build(chunks)[0].collect()) for _ in range(2))
    assert a == b and len(a) == 1


def test_answer(spark, g):
    q = spark.createDataFrame([("q", "alias-a"), ("none", "zzz")], "query_id string, query string")
    got = {r["query_id"]: r["answer"] for r in graph.answer(*g, q).collect()}
    assert got == {"q": "Name a: 4 entities and 6 relations around.", "none": "No entity found."}


def test_registered_extraction_reads_whole_contents(spark, sf):
    from lumbra.plans import catalogue

    lines = sum(bool(x.strip()) for r in spark.read.parquet(f"{sf}/documents.parquet").select("content").collect() for x in (r[0] or "").splitlines())
    assert sum(r["n"] for r in catalogue.llm_extraction(spark, sf).collect()) == lines
