import math

import pytest

from lumbra.functions import text as X
from lumbra.operators import keyword

K1 = [("doc-1", "golang is great"), ("doc-2", "python is popular"), ("doc-3", "golang and python")]


@pytest.fixture(scope="module")
def ix(spark):
    return keyword.index(spark.createDataFrame(K1, "id string, content string"))


def asked(spark, *texts):
    return spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts)], "query_id string, query string")


def ids(df):
    return {r["id"] for r in df.collect()}


def test_tokens(spark):
    df = spark.createDataFrame([("Hello World Hello Go",), ("你好世界Hello",), ("",), (None,)], "t string")
    rows = df.select(X.simple_tokens(df.t).alias("s"), X.han_tokens(df.t).alias("h")).collect()
    assert rows[0]["s"] == ["hello", "world", "hello", "go"]
    assert rows[1]["h"] == ["你", "好", "世", "界", "hello"]
    assert rows[2]["s"] == [] and rows[3]["s"] is None


def test_bm25_scores_frequent_terms_below_zero(spark, ix):
    hits = keyword.bm25(ix, asked(spark, "golang")).collect()
    assert [r["id"] for r in hits] == ["doc-1", "doc-3"]
    idf, tf = math.log(1.5 / 2.5), 2.2 / (1 + 1.2)
    assert hits[0]["score"] == pytest.approx(idf * tf)
    assert hits[0]["score"] < 0


def test_bm25_counts_repeated_query_words(spark, ix):
    one, two = (keyword.bm25(ix, asked(spark, q)).collect()[0]["score"] for q in ("great", "great great"))
    assert two == pytest.approx(2 * one)


def test_bm25_without_documents_or_words(spark):
    empty = keyword.index(spark.createDataFrame([], "id string, content string"))
    assert keyword.bm25(empty, asked(spark, "x")).count() == 0
    some = keyword.index(spark.createDataFrame([("a", None), ("b", "")], "id string, content string"))
    assert keyword.bm25(some, asked(spark, "x", "", "!!")).count() == 0


def test_index_changes(spark, ix):
    new = ix.add(spark.createDataFrame([("doc-1", "rust"), ("doc-4", "golang")], "id string, content string"))
    assert ids(keyword.bm25(new, asked(spark, "golang"))) == {"doc-3", "doc-4"}
    assert ids(keyword.bm25(new.remove(spark.createDataFrame([("doc-4",)], "id string")), asked(spark, "golang"))) == {"doc-3"}
    assert ix.clear().stats().first()["documents"] == 0


def test_boolean(spark, ix):
    assert ids(keyword.boolean(ix, ["golang"], must_not=["python"])) == {"doc-1"}
    assert keyword.boolean(ix, must_not=["python"]).count() == 0
    got = {r["id"]: r["score"] for r in keyword.boolean(ix, ["golang"], ["python great"]).collect()}
    assert got == {"doc-1": 1.5, "doc-3": 1.5}
    assert ids(keyword.strict_boolean(ix, none=["golang"])) == {"doc-2"}


def test_phrases(spark, ix):
    hits = keyword.phrase(ix, asked(spark, "IS great", "...")).collect()
    assert [(r["query_id"], r["id"], r["score"]) for r in hits] == [("q0", "doc-1", 2.0)]
    twice = keyword.index(spark.createDataFrame([("a", "x y x y x"), ("b", "x, y"), ("c", "y x")], "id string, content string"))
    got = {r["id"]: r["score"] for r in keyword.adjacent(twice, asked(spark, "x y")).collect()}
    assert got == {"a": 2.0, "b": 1.0}


def test_prefix_fuzzy_trigram(spark, ix):
    assert ids(keyword.prefix(ix, asked(spark, "PY"))) == {"doc-2", "doc-3"}
    got = {r["id"]: round(r["score"], 4) for r in keyword.fuzzy(ix, asked(spark, "golanng")).collect()}
    assert got == {"doc-1": round(1 - 1 / 7, 4), "doc-3": round(1 - 1 / 7, 4)}
    accents = keyword.index(spark.createDataFrame([("a", "é")], "id string, content string"))
    assert keyword.fuzzy(accents, asked(spark, "e"), 1).count() == 0  # two bytes, so two edits
    docs = spark.createDataFrame(K1, "id string, content string")
    assert ids(keyword.trigram(docs, asked(spark, "golang"), "id", "content", 0.3)) == {"doc-1", "doc-3"}


def test_like_escapes_its_signs(spark):
    docs = spark.createDataFrame([(1, "100%"), (2, "100x"), (3, None)], "id int, content string")
    assert ids(keyword.like(docs, asked(spark, "100%"), "id", ["content"])) == {1}
    assert ids(keyword.like(docs, asked(spark, "1_0"), "id", ["content"], escape=False)) == {1, 2}


def test_web_syntax(spark, ix):
    assert keyword.web_query('"a b" c OR d -e f') == {"phrases": ["a b"], "every": ["f"], "some": ["c", "d"], "none": ["e"]}
    assert ids(keyword.web_search(ix, "golang OR python -great")) == {"doc-2", "doc-3"}
    assert ids(keyword.advanced(ix, '"is popular"', "web")) == {"doc-2"}


def test_highlight_and_trim(spark):
    df = spark.createDataFrame([("a report on reports", "report a on"), ("x", "")], "t string, q string")
    rows = df.select(X.highlight(df.t, df.q).alias("h"), X.trim(df.t).alias("t")).collect()
    assert rows[0]["h"] == "a **report** **on** **report**s"
    assert rows[1]["h"] == "x"
