import os

import numpy as np
import pytest

from lumbra.functions import vectors as V
from lumbra.functions.embed import constant, embed, hashing
from lumbra.operators import vector

V1 = [("v1", [1.0, 0, 0, 0]), ("v2", [0, 1.0, 0, 0]), ("v3", [0, 0, 1.0, 0]), ("v4", [0, 0, 0, 1.0]), ("v5", [0.9, 0.1, 0, 0]), ("v6", [0, 0.9, 0.1, 0])]


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [(i, [float(x) for x in v], {"category": "A" if i in ("v1", "v3") else "B"}, 0) for i, v in V1]
    return spark.createDataFrame(rows, "id string, vector array<float>, metadata map<string,string>, created_at int")


def ask(spark, *vs):
    return spark.createDataFrame([(f"q{i}", [float(x) for x in v]) for i, v in enumerate(vs)], "query_id string, vector array<float>")


def test_nearest(spark, vectors):
    hits = vector.knn(vectors, ask(spark, [1.0, 0, 0, 0]), 3).orderBy("rank").collect()
    assert [r["id"] for r in hits][:2] == ["v1", "v5"] and len(hits) == 3
    l2 = vector.hnsw_search(vectors, ask(spark, [1.0, 0, 0, 0]), 2).orderBy("rank").collect()
    assert l2[0]["score"] == pytest.approx(1.0)


def test_filters_before_and_after(spark, vectors):
    q = ask(spark, [1.0, 0, 0, 0])
    assert {r["id"] for r in vector.knn(vectors, q, 5, {"category": "A"}).collect()} == {"v1", "v3"}
    assert {r["id"] for r in vector.hnsw_search(vectors, q, 1, 2, {"category": "A"}).collect()} == {"v1"}
    assert vector.metadata_filter(vectors, {"absent": "x"}).count() == 0
    assert vector.metadata_filter(vectors, {}).count() == 6


def test_dimension_and_upsert(spark, vectors):
    bad = spark.createDataFrame([("x", [1.0], None, 1)], vectors.schema)
    with pytest.raises(Exception, match="dimension"):
        vector.upsert(vectors, bad, 4).collect()
    new = spark.createDataFrame([("v1", [0.0, 0.0, 0.0, 1.0], None, 1), ("v1", [0.0, 0.0, 1.0, 0.0], None, 2)], vectors.schema)
    out = {r["id"]: list(r["vector"]) for r in vector.upsert(vectors, new, 4).collect()}
    assert out["v1"] == [0, 0, 1, 0] and len(out) == 6


def test_delete(spark, vectors):
    assert vector.delete(vectors, spark.createDataFrame([("v2",)], "id string"), {"category": "A"}).count() == 3
    assert vector.delete(vectors, where={}).count() == 6


def test_multi_query_takes_the_first_hit(spark, vectors):
    q = ask(spark, [0.0, 1, 0, 0], [1.0, 0, 0, 0]).selectExpr("query_id", "vector", "'g' AS group_id", "int(substr(query_id, 2)) AS ord")
    got = {r["id"]: r["score"] for r in vector.multi_query(vectors, q, 6).collect()}
    assert got["v5"] == pytest.approx(0.1 / np.hypot(0.9, 0.1), abs=1e-6)


def test_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [1.0])], "a array<float>, z array<float>, s array<float>")
    r = df.select(V.cosine(df.a, df.z), V.cosine(df.a, df.s), V.euclidean(df.a, df.z), V.euclidean(df.a, df.s), V.normalise(df.a), V.normalise(df.z), V.to_text(df.a), V.from_text(V.to_text(df.a))).first()
    assert r[0] == 0 and r[1] == 0 and r[2] == 5 and r[3] > 1e38 and r[4] == pytest.approx([0.6, 0.8]) and r[5] == [0, 0]
    assert r[6] == "[3.000000,4.000000]" and r[7] == [3, 4]


def test_empty_table(spark, vectors):
    assert vector.knn(vectors.limit(0), ask(spark, [1.0, 0, 0, 0])).count() == 0
    assert vector.knn(vectors, ask(spark).limit(0)).count() == 0


def test_ivf_recall(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 16)) + 4 * rng.normal(size=(8, 16))[rng.integers(0, 8, 800)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<float>")
    q = df.filter("id % 20 = 0").selectExpr("id AS query_id", "vector")
    exact = {(r["query_id"], r["id"]) for r in vector.knn(df, q, 10).collect()}
    found = {(r["query_id"], r["id"]) for r in vector.Ivf(df, 20).search(q, 10, 8).collect()}
    assert len(exact & found) / len(exact) >= 0.9


def test_registered_ivf_recall(spark):
    from lumbra.plans import catalogue

    sf = "/root/testdata/sf0.1"
    if not os.path.isdir(sf):
        pytest.skip("no test tables here")
    exact = {(r["query_id"], r["id"]) for r in catalogue.knn_cosine(spark, sf).collect()}
    found = {(r["query_id"], r["id"]) for r in catalogue.ivf_knn(spark, sf).collect()}
    assert len(exact & found) / len(exact) >= 0.9


def test_embedders(spark):
    df = spark.createDataFrame([("a b",), ("",), (None,), ("a b",)], "t string")
    rows = embed(df, "t", hashing(8)).collect()
    assert rows[0]["vector"] == rows[3]["vector"] and np.linalg.norm(rows[0]["vector"]) == pytest.approx(1)
    assert np.linalg.norm(embed(df, "t", constant(4)).first()["vector"]) == pytest.approx(1)
