import math

import pytest

from lumbra.operators import evaluate, fusion, rerank

H = "query_id string, strategy string, id string, score double, content string"


@pytest.fixture(scope="module")
def hits(spark):
    rows = [("q", "vector", "a", 0.9, "va"), ("q", "vector", "b", 0.8, "vb"), ("q", "keyword", "b", 12.0, "kb"), ("q", "keyword", "c", 3.0, "kc"), ("r", "graph", "a", 0.1, "ga")]
    return spark.createDataFrame(rows, H)


def got(df):
    return {(r["query_id"], r["id"]): r["score"] for r in df.collect()}


def test_rrf(hits):
    scores = got(fusion.rrf(hits))
    assert scores["q", "b"] == pytest.approx(1 / 62 + 1 / 61)
    assert scores["q", "a"] == pytest.approx(1 / 61)
    assert {r["id"]: r["content"] for r in fusion.rrf(hits).filter("query_id = 'q'").collect()}["b"] == "kb"


def test_weighted(hits):
    scores = got(fusion.weighted(hits, {"vector": 0.6}))
    assert scores["q", "b"] == pytest.approx((0.8 * 0.6 + 12 * 0.5) / 1.1)  # keyword: 1 of 2 lists
    assert scores["r", "a"] == pytest.approx(0.1)
    assert got(fusion.weighted(hits, {}))["q", "a"] == pytest.approx(0.9 * 0.5)


def test_hybrid_threshold_and_counts(spark, hits):
    q = spark.createDataFrame([("q", "x")], "query_id string, query string")
    routes = {s: (lambda _, n, s=s: hits.filter(f"strategy = '{s}' and query_id = 'q'")) for s in ("vector", "keyword")}
    assert fusion.hybrid(q, routes, 2).count() == 2
    assert fusion.hybrid(q, routes, 5, threshold=0.02).count() == 1
    assert {(r["strategy"], r["hits"]) for r in fusion.counts(hits).filter("query_id = 'q'").collect()} == {("vector", 2), ("keyword", 2)}
    with pytest.raises(ValueError):
        fusion.hybrid(q, {})


def test_routes(spark):
    df = spark.createDataFrame([("WHO is it",), ("explain this",), ("为什么",), ("如何使用",), ("golang",), ("",)], "q string")
    assert [r[0] for r in df.select(fusion.route(df.q)).collect()] == [["keyword", "graph"], ["vector"], ["keyword", "graph"], ["vector"], ["vector", "keyword"], ["vector", "keyword"]]


C = "query_id string, id string, score double, content string"


def test_match(spark):
    c = spark.createDataFrame([("q", "a", 0.2, "Red fox."), ("q", "b", 0.5, "blue"), ("q", "c", 0.5, None)], C)
    q = spark.createDataFrame([("q", "red red dog")], "query_id string, query string")
    out = rerank.match(c, q, 2).orderBy("rank").collect()
    assert out[0]["id"] == "a" and out[0]["rerank_score"] == pytest.approx(0.06 + 0.7 * 2 / 3) and len(out) == 2


def test_pseudo_jaccard_is_not_symmetric(spark):
    df = spark.createDataFrame([("x x y", "x z x")], "a string, b string")
    r = df.select(rerank.pseudo_jaccard(df.a, df.b), rerank.pseudo_jaccard(df.b, df.a)).first()
    assert r[0] == pytest.approx(2 / (2 + 3 - 2)) and r[1] == pytest.approx(2 / (2 + 3 - 2))


def test_mmr(spark):
    c = spark.createDataFrame([("q", "a", 1.0, "x y"), ("q", "b", 0.9, "x y"), ("q", "c", 0.5, "z")], C)
    order = [r["id"] for r in rerank.mmr(c, 3, 0.5).orderBy("rank").collect()]
    assert order == ["a", "c", "b"]
    low = spark.createDataFrame([("q", "a", -1.0, "x"), ("q", "b", -3.0, "x"), ("q", "c", -2.0, "y")], C)
    assert [r["id"] for r in rerank.mmr(low, 3, 1.0).orderBy("rank").collect()] == ["a", "c", "b"]
    assert rerank.mmr(c.limit(0)).count() == 0


def run_of(spark, ids):
    return spark.createDataFrame([("q", i, d) for i, d in enumerate(ids, 1)], "query_id string, rank int, doc_id string")


def qrels(spark, ids):
    return spark.createDataFrame([("q", d, 1.0) for d in ids] or [("q", "none", 0.0)], "query_id string, doc_id string, relevance double")


def metric(spark, run, rel, name, ks=(1, 2, 3, 4, 5, 10)):
    return evaluate.per_query(run_of(spark, run), qrels(spark, rel), ks).first()[name]


@pytest.mark.parametrize("run,rel,name,want", [
    ("axbyc", "abc", "recall_3", 2 / 3), ("axbyc", "abc", "recall_5", 1), ("axbyc", "", "recall_5", 0), ("a", "abc", "recall_10", 1 / 3),
    ("axby", "ab", "precision_2", 0.5), ("axby", "ab", "precision_4", 0.5), ("", "ab", "precision_5", 0),
    ("abc", "bc", "mrr", 0.5), ("bac", "bc", "mrr", 1), ("axy", "bc", "mrr", 0),
    ("axb", "ab", "map", (1 + 2 / 3) / 2), ("axb", "ab", "ndcg_3", (1 + 1 / 2) / (1 + 1 / math.log2(3))), ("ab", "abc", "ndcg_5", 1),
])
def test_metrics(spark, run, rel, name, want):
    assert metric(spark, run, rel, name) == pytest.approx(want)


def test_gate(spark):
    m = evaluate.mean(evaluate.per_query(run_of(spark, "ab"), qrels(spark, "ab")))
    good = evaluate.verdict(evaluate.gate(m)).first()
    assert good["passed"] is True and good["warnings"] == []
    bad = evaluate.verdict(evaluate.gate(m, {"mrr": 2.0, "map": 0.0})).first()
    assert bad["passed"] is False and len(bad["warnings"]) == 1
    assert "mrr: 1.0000" in evaluate.report(m).first()["text"]


def test_failed_queries_are_left_out(spark):
    failed = spark.createDataFrame([("q",)], "query_id string")
    assert evaluate.per_query(run_of(spark, "ab"), qrels(spark, "ab"), failed=failed).count() == 0
