import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumbra.functions import generate
from lumbra.functions import text as X
from lumbra.functions.embed import service
from lumbra.operators import chunking, dedup, fusion, graph, hnsw, keyword, rerank, sizes, skew, vector
from lumbra.plans.engine import Corpus, Engine
from lumbra.sources import files, parsers


def asked(spark, *texts):
    return spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts)], "query_id string, query string")


def test_the_last_row_of_an_id_counts(spark):
    rows = [("a", "old words", 1), ("a", "new thing", 2), ("b", "x", 1), ("a", None, 0), (None, "lost", 9), ("c", "one", 1), ("c", "two", 1)]
    docs = spark.createDataFrame(rows, "id string, content string, ord int")
    ix = keyword.index(docs, order="ord")
    assert {r["id"]: r["content"] for r in ix.docs.collect()} == {"a": "new thing", "b": "x", "c": "two"}
    assert keyword.index(docs).stats().first()["documents"] == 3
    assert keyword.bm25(ix, asked(spark, "old")).count() == 0


def test_stored_index_answers_as_the_other(spark, tmp_path):
    docs = spark.createDataFrame([("1", "golang is great"), ("2", "python and golang"), ("3", "")], "id string, content string")
    ix = keyword.index(docs)
    stored = ix.store(str(tmp_path / "ix"))
    q = asked(spark, "golang python", "great", "none", "")
    for search in (keyword.bm25, keyword.conjunctive):
        assert sorted(map(tuple, search(ix, q).collect())) == sorted(map(tuple, search(stored, q).collect()))
    assert stored.stats().first() == ix.stats().first()
    assert keyword.bm25(stored.remove(docs.limit(0)), q).count() == keyword.bm25(ix, q).count()


def test_many_words_take_the_join(spark, monkeypatch):
    docs = spark.createDataFrame([(str(i), f"w{i} common") for i in range(30)], "id string, content string")
    q = asked(spark, " ".join(f"w{i}" for i in range(20)), "common")
    want = sorted((r["query_id"], r["id"], round(r["score"], 9)) for r in keyword.bm25(keyword.index(docs), q, 50).collect())
    monkeypatch.setattr(keyword, "WORDS", 3)
    assert sorted((r["query_id"], r["id"], round(r["score"], 9)) for r in keyword.bm25(keyword.index(docs), q, 50).collect()) == want


def test_query_sets_of_any_size_are_answered_in_parts(spark, monkeypatch):
    docs = spark.createDataFrame([("1", "alpha beta"), ("2", "beta gamma")], "id string, content string")
    q = asked(spark, *["alpha", "beta", "gamma"] * 4)
    want = sorted(map(tuple, keyword.prefix(keyword.index(docs), q, k=None).collect()))
    monkeypatch.setattr(sizes, "QUERIES", 5)
    assert sorted(map(tuple, keyword.prefix(keyword.index(docs), q, k=None).collect())) == want and len(want) == 16


V = "id long, vector array<double>"


def test_knn_takes_any_k_length_and_number_of_queries(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)] + [(9, [1.0, 2.0, 3.0]), (10, None)], V)
    q = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0]), ("d", None)], "query_id string, vector array<double>")
    got = {}
    for r in vector.knn(v, q, 0).collect():
        got.setdefault(r["query_id"], []).append((r["id"], round(r["score"], 6)))
    assert {k: len(x) for k, x in got.items()} == {"a": 7, "b": 7, "c": 7} and dict(got["c"])[3] == 0 and dict(got["a"])[9] == 0
    assert vector.knn(v, q, -1, metric="l2").count() == 21
    want = sorted(map(tuple, vector.knn(v, q, 2).collect()))
    monkeypatch.setattr(vector, "BLOCK_BYTES", 16)
    assert sorted(map(tuple, vector.knn(v, q, 2).collect())) == want
    assert vector.knn(v, q.limit(0), 2).count() == 0


def test_inverted_file_of_odd_rows(spark):
    v = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(60)] + [(99, [1.0]), (98, None)], V)
    ivf = vector.Ivf(v, 5)
    q = v.filter("id < 3").select(F.col("id").alias("query_id"), "vector")
    assert sorted(map(tuple, ivf.search(q, 3, 5).collect())) == sorted(map(tuple, vector.knn(v.filter("id < 90"), q, 3).collect()))
    assert ivf.search(v.filter("id = 99").select(F.col("id").alias("query_id"), "vector")).count() == 0


def test_hnsw_finds_neighbours(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(400, 12))
    v = spark.createDataFrame([(i, [float(c) for c in row]) for i, row in enumerate(x)] + [(1000, None)], V)
    q = v.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")
    ix = hnsw.Hnsw.build(v, ef=60, part=150)
    assert ix.nodes.select("part").distinct().count() > 1
    got, want = (set((a["query_id"], a["id"]) for a in s.collect()) for s in (ix.search(q, 5, 60), vector.knn(v, q, 5, metric="l2")))
    assert len(got & want) >= 0.95 * len(want)
    nodes = ix.nodes.collect()
    assert all(len(at) <= (32 if i == 0 else 16) for n in nodes for i, at in enumerate(n["links"])) and all(len(n["links"]) == n["level"] + 1 for n in nodes)
    less = ix.delete(q.select(F.col("query_id").alias("id")))
    hits = less.search(q, 5, 60).collect()
    assert len(hits) == 100 and all(h["id"] % 20 for h in hits) and less.levels().agg(F.sum("nodes")).first()[0] == 380
    assert hnsw.Hnsw.build(v.limit(0)).search(q, 5).count() == 0


def test_ranks_by_prefix_sums_are_those_of_a_window(spark, monkeypatch):
    df = spark.createDataFrame([(f"q{i % 3}", i, float(i % 5)) for i in range(200)], "query_id string, id int, score double")
    order = [F.col("score").desc(), F.col("id")]
    want = sorted(map(tuple, skew.numbered(df, ["query_id"], order, "rank").collect()))
    monkeypatch.setattr(skew, "ESTIMATE", 0)
    assert sorted(map(tuple, skew.numbered(df, ["query_id"], order, "rank").collect())) == want
    monkeypatch.setattr(skew, "SORTED", 10)
    assert sorted(map(tuple, skew.numbered(df, ["query_id"], order, "rank").collect())) == want


def test_cascade_goes_on_for_queries_without_hits(spark):
    q = asked(spark, "a", "b", "c")
    routes = [lambda q, k, n=n: q.filter(F.col("query_id") <= n).select("query_id", F.lit(n).alias("id"), F.lit(1.0).alias("score")) for n in ("q0", "q1")]
    assert sorted((r["query_id"], r["id"]) for r in fusion.cascade(q, routes).collect()) == [("q0", "q0"), ("q1", "q1")]


def test_engine_modes_and_batches(spark, tmp_path):
    rows = [("1", "Go", "golang is great", "s", 1), ("2", "Py", "python is popular", "s", 2), ("3", "x", None, "s", 3), (None, "y", "text", "s", 4)]
    docs = spark.createDataFrame(rows, "id string, title string, content string, source string, created_at int")
    e, q = Engine(), asked(spark, "popular python")
    c = e.index(docs.filter("id is not null"))
    assert e.search(c, q, "auto", 2).orderBy("rank").first()["id"] == "2"
    bare = Corpus(c.documents, c.chunks, c.index, None, None, None, c.duplicates)
    assert e.search(bare, q, "auto", 2).first()["id"] == "2"
    for mode in ("vector", "hybrid", "graph"):
        with pytest.raises(ValueError, match="nothing to search"):
            e.search(bare, q, mode)
    done = []
    report, errors = e.index_batches(docs, str(tmp_path / "b"), 2, progress=lambda i, n: done.append((i, n)))
    assert done == [(1, 2), (2, 2)] and report.agg(F.sum("total"), F.sum("failed")).first() == (4, 2)
    assert sorted((r["id"], r["error"]) for r in errors.fillna("-").collect()) == [("-", "no id"), ("3", "no content")]
    assert e.index_batches(docs.filter("id = '3'"), str(tmp_path / "c"), 1, stop_on_error=True)[0].count() == 1


def test_graph_tables_take_new_rows(spark):
    e = spark.createDataFrame([("1", "a", "X"), ("2", "b", "X")], "id string, name string, type string")
    new = spark.createDataFrame([("2", "c", "Y"), ("2", "b", "Y"), ("3", "d", "Y")], e.schema)
    assert sorted(map(tuple, graph.upsert(e, new).collect())) == [("1", "a", "X"), ("2", "c", "Y"), ("3", "d", "Y")]
    assert [r["name"] for r in graph.get(e, spark.createDataFrame([("2",), ("9",)], "id string")).collect()] == ["b"]


def test_dictionaries_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(graph, "WORDS", 2)
    docs = spark.createDataFrame([("1", "vector index and ledger"), ("2", None)], "id string, content string")
    words = spark.createDataFrame([("Vector", "CONCEPT"), ("index", "TOOL"), ("ledger", "TOOL"), ("none", "TOOL"), (None, "TOOL"), ("", "TOOL")], "word string, type string")
    assert sorted((r["name"], r["type"]) for r in graph.extract_entities(docs, dictionary=words).collect()) == [("index", "TOOL"), ("ledger", "TOOL"), ("vector", "CONCEPT")]


def test_mmr_needs_no_cap(spark):
    rows = [("q", f"{i:04d}", 1.0 - i / 5000, f"word{i % 3} text{i}") for i in range(1500)]
    c = spark.createDataFrame(rows, "query_id string, id string, score double, content string")
    got = [r["id"] for r in rerank.mmr(c, 5, 0.7).orderBy("rank").collect()]
    assert len(got) == 5 and got[0] == "0000" and rerank.mmr(c.limit(0), 5).count() == 0


def test_small_files_of_functions(spark):
    f = spark.createDataFrame([("a", 1, bytearray(b"x" * 10)), ("b", 1, bytearray()), ("c", 2, bytearray(b"yy"))], "source string, modified int, data binary")
    assert [(r["source"], r["block"], len(r["data"])) for r in files.blocks(f, 4).orderBy("source", "block").collect()] == [("a", 0, 4), ("a", 1, 4), ("a", 2, 2), ("c", 0, 2)]
    cache = spark.createDataFrame([("a", 1, "known"), ("c", 1, "stale")], "source string, modified int, hash string")
    got = {r["source"]: r["hash"] for r in dedup.cached(f, cache).collect()}
    assert got["a"] == "known" and len(got["b"]) == len(got["c"]) == 64
    t = spark.createDataFrame([("2024-05-06T07:08:09.123456Z",), ("2024-05-06 07:08:09",), ("2024-05-06",), ("no",), (None,)], "t string")
    assert [r[0] for r in t.select(X.format_time(X.parse_time(F.col("t")))).collect()] == ["2024-05-06T07:08:09.123456Z", "2024-05-06T07:08:09.000000Z", "2024-05-06T00:00:00.000000Z", None, None]
    d = spark.createDataFrame([("1", "abcdefghij"), ("2", "abc"), ("3", "")], "id string, content string")
    assert sorted((r["id"], r["chunk"]) for r in chunking.peek(d, 2, size=4, overlap=1).collect()) == [("1", "abcd"), ("1", "defg"), ("2", "abc"), ("2", "c")]
    new = vector.upsert(spark.createDataFrame([("a", [1.0], 1)], "id string, vector array<double>, created_at int"), spark.createDataFrame([(None, [2.0], 1)], "id string, vector array<double>, created_at int"), 1)
    assert new.count() == 2 and new.filter("id is null").count() == 0


def test_word_files_round_trip(spark):
    t = spark.createDataFrame([("a.docx", "one & <two>\n\nthree\x01 中"), ("b.docx", None)], "source string, content string")
    got = {r["source"]: r for r in files.documents(files.to_docx(t)).collect()}
    assert got["a.docx"]["content"] == "one & <two>\n\nthree 中" and got["b.docx"]["content"] == "" and got["b.docx"]["error"] is None
    assert parsers.docx(parsers.write_docx(["x"]), "y.docx").elements[0].text == "x"


def test_files_of_all_types_are_written_and_read(spark):
    t = spark.createDataFrame([("a.docx", "one\ntwo"), ("b.pdf", "Three\ffour."), ("c.txt", "five"), ("d.json", "[6]"), ("e.md", None)], "source string, content string")
    got = {r["source"]: r["content"] for r in files.documents(files.write(t)).collect()}
    assert got == {"a.docx": "one\n\ntwo", "b.pdf": "Three\n\nfour.", "c.txt": "five", "d.json": "[\n  6\n]", "e.md": ""}


class _Service(BaseHTTPRequestHandler):
    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if "input" in body:
            data = [{"index": i, "embedding": [len(t), 1]} for i, t in enumerate(body["input"])][::-1]
            out = json.dumps({"data": data}).encode()
        elif body.get("stream"):
            out = b"".join(b"data: " + json.dumps({"choices": [{"delta": {"content": c}}]}).encode() + b"\n\n" for c in "abc") + b"data: [DONE]\n"
        else:
            out = json.dumps({"choices": [{"message": {"content": "abc"}}]}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(out)

    def log_message(self, *args):
        pass


def test_services():
    server = HTTPServer(("127.0.0.1", 0), _Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/"
    assert service(url, "m", "key")(["a", "bb"]).tolist() == [[1, 1], [2, 1]]
    assert "".join(generate.streamed(url, "m", "key")("hi")) == generate.chat(url, "m")("hi") == "abc"
    server.shutdown()


def test_models_answer_in_batches(spark):
    df = spark.createDataFrame([("a",), (None,)], "q string")
    calls = []
    assert sorted(r[0] for r in df.select(generate.generated(F.col("q"), lambda p: p.upper() + "!")).collect()) == ["!", "A!"]
    assert [r[0] for r in df.limit(1).select(generate.generated(F.col("q"), lambda p: calls.append(p) or "x" * len(calls), 3, lambda a: len(a) > 1)).collect()] == ["xx"]
