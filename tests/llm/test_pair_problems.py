import collections
import itertools
import json
import math
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumbra.llm import common, copies, distinctive, fused, knn, names, near, queries
from lumbra.operators import skew

# Copies.


def _bare(s):
    return "".join(c for c in s.casefold() if c.isalnum())


def _canonical(c):
    if c.strip()[:1] == "{":
        try:
            return "".join(sorted(_bare(str(k) + str(v)) for k, v in json.loads(c).items()))
        except ValueError:
            pass
    lines = [x for x in re.split(r"[\r\n]+", c) if _bare(x)]
    if len(lines) > 1 and all(re.match(r"^\s*[^\W_][\w \t\-]*[:：](\s|$)", x) for x in lines):
        return "".join(sorted(map(_bare, lines)))
    return _bare(c)


def test_copies_of_the_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sets = collections.defaultdict(list)
    for r in docs.filter("content is not null").collect():
        if key := _canonical(r["content"]):
            sets[key].append(r["doc_id"])
    want = {(min(v), x) for v in sets.values() for x in v if x != min(v)}
    assert {tuple(r) for r in copies.copies(docs).collect()} == want
    assert sum(r["copies"] for r in copies.collapse(docs).collect()) == docs.count()


def test_copies_of_odd_rows(spark):
    rows = [(1, "A b.\nC", 1), (2, "a  B C!", 1), (3, "", 1), (4, None, 1), (5, "...", 1), (6, '{"x": 1, "y": {"b": 2, "a": 3}}', 1), (7, '{"Y":{"a":3,"b":2},"X":1}', 1), (8, "K: v\nL: w", 1), (9, "L : w\r\nk: V", 1), (10, "C a b", 1), (11, "STRASSE", 1), (12, "straße", 1), (None, "a b c", 1), (2, "a  B C!", 1), (13, '{"x": broken', 1)]
    docs = spark.createDataFrame(rows, "doc_id long, content string, h1 int")
    assert {tuple(r) for r in copies.copies(docs).collect()} == {(1, 2), (6, 7), (8, 9), (11, 12)}
    assert copies.copies(docs.limit(0)).count() == 0
    got = {r["doc_id"]: r["copies"] for r in copies.collapse(docs).collect()}
    assert got[1] == 3 and got[3] == got[4] == got[5] == 1


def test_collisions_are_told_and_never_merged(spark):
    prints = spark.createDataFrame([(1, 7, 7, 1), (2, 7, 7, 1), (3, 7, 7, 2), (4, 8, 8, 1), (5, None, None, None)], "doc_id long, h1 long, h2 long, check long")
    assert [tuple(r) for r in copies.collisions(prints).collect()] == [(7, 7, 2, 3)]
    assert sorted((r["first_doc_id"], r["copies"]) for r in copies.groups(prints).collect()) == [(1, 2), (3, 1), (4, 1)]
    long_key = "a very long key of more than six words and of one hundred and twenty letters or more so that nothing can be called short any longer: 1\nb: 2"
    docs = spark.createDataFrame([(1, long_key), (2, "\n".join(reversed(long_key.split("\n"))))], "doc_id long, content string")
    assert [tuple(r) for r in copies.copies(docs).collect()] == [(1, 2)]


def test_hot_keys_meet_by_broadcast(spark):
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    groups = rows.groupBy("k").agg(F.count("*").alias("n"))
    assert common.join_hot(rows, groups, ["k"], "n", 20_000).count() == 20_000


def test_running_total_and_components(spark):
    df = spark.createDataFrame([("a", i, i % 3) for i in range(200)] + [("b", 1, 5), (None, 2, 7)], "g string, o int, v int")
    got = {(r["g"], r["o"]): r["t"] for r in common.running_total(df, ["g"], [F.col("o")], "v", "t").collect()}
    assert got["a", 199] == sum(i % 3 for i in range(200)) and got["a", 100] == sum(i % 3 for i in range(101)) and got["b", 1] == 5 and got[None, 2] == 7
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 40), (7, 7)], "a long, b long")
    assert {(r["id"], r["root"]) for r in common.components(edges).collect()} == {(i, 0) for i in range(31)} | {(50, 40), (40, 40)}
    assert common.components(edges.limit(0)).count() == 0


# Near duplicates.


def test_near_duplicates_of_the_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    of = {}
    for a, b in copies.copies(docs).collect():
        of[a] = of[b] = a
    sets = {}
    for r in docs.filter("content is not null").collect():
        w = common.py_tokens(r["content"])
        if s := {tuple(w[i : i + 3]) for i in range(len(w) - 2)}:
            sets[r["doc_id"]] = s
    want = {(a, b) for a in sets for b in sets if a < b and (a not in of or of.get(a) != of.get(b)) and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    got = {tuple(r) for r in near.found(docs).collect()}
    assert got <= want and len(got) >= 0.99 * len(want)


def test_near_duplicates_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(near, "COPIES", 2)
    base = [f"w{i}" for i in range(40)]
    texts = {1: " ".join(base), 2: " ".join(base[:38]), 3: " ".join(base[2:]), 4: " ".join(base).upper(), 5: "", 6: None, 7: "a b", 8: " ".join(f"x{i}" for i in range(40)), 9: " ".join(base[:38])}
    docs = spark.createDataFrame([(k, v, 1) for k, v in texts.items()] + [(None, texts[1], 1), (1, texts[1], 1)], "doc_id long, content string, n int")
    got = {tuple(r) for r in near.found(docs.filter("doc_id is not null").dropDuplicates(["doc_id"])).collect()}
    # 2 and 9 are copies, as are 1 and 4; all others are alike
    assert got == {(a, b) for a in (1, 2, 3, 4, 9) for b in (1, 2, 3, 4, 9) if a < b and {a, b} not in ({2, 9}, {1, 4})}
    groups = {r["doc_id"]: r["class_id"] for r in near.grouped(docs.filter("doc_id is not null").dropDuplicates(["doc_id"])).collect()}
    assert set(groups) == {1, 2, 3, 4, 9} and len(set(groups.values())) == 1
    assert near.found(docs.limit(0)).count() == 0


def test_pairs_around_hubs_and_families(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 4)
    r = random.Random(5)
    hub = [(0, i) for i in range(1, 40)]  # a star: pairs around its hub are all pairs
    family = [(a, b) for a in range(100, 112) for b in range(a + 1, 112)]
    chain = [(200 + i, 201 + i) for i in range(30)] + [(200, 250 + i) for i in range(10)]
    edges = hub + family + chain
    near_of = collections.defaultdict(set)
    for a, b in edges:
        near_of[a].add(b)
        near_of[b].add(a)
    size = {x: r.choice([10, 12, 30]) for x in near_of}
    want = {(a, b) for x in near_of for a in near_of[x] for b in near_of[x] if a < b and min(size[a], size[b]) >= 0.6 * max(size[a], size[b])}
    star = spark.createDataFrame(edges, "a long, b long")
    got = {tuple(x) for x in near.connected(star, common.components(star), spark.createDataFrame(list(size.items()), "rep long, n int"), 0.6).collect()}
    assert want <= got and all(min(size[a], size[b]) >= 0.6 * max(size[a], size[b]) for a, b in got)


def test_sketch_estimates_similarity():
    r = np.random.default_rng(0)
    for share in (0.3, 0.6, 0.9):
        x = r.integers(0, 2**63, 1000, dtype=np.uint64)
        y = np.r_[x[: int(2000 * share / (1 + share))], r.integers(0, 2**63, 1000 - int(2000 * share / (1 + share)), dtype=np.uint64)]
        hits = [(near.sketch(near._mix(x + np.uint64(k))) == near.sketch(near._mix(y + np.uint64(k)))).mean() for k in range(20)]
        assert np.mean(hits) == pytest.approx(share, abs=0.05)
    assert (near.sketch(np.array([5], np.uint64)) == 0).all()  # one value fills all bins


# Vectors.


def _pairs(ids, x, k=5, floor=0.93):
    s = x @ x.T
    np.fill_diagonal(s, -9)
    best = [[ids[j] for j in sorted(range(len(ids)), key=lambda j: (-round(s[i, j], 12), ids[j]))[:k] if s[i, j] >= floor] for i in range(len(ids))]
    of = dict(zip(ids, best, strict=True))
    return {(a, b) for a in ids for b in of[a] if a < b and a in of[b]}


def test_neighbours_of_the_tables(spark, sf):
    v = spark.read.parquet(f"{sf}/vectors.parquet")
    rows = {r["id"]: r["v"] for r in knn.latest(v).collect()}
    ids = sorted(rows)
    x = np.array([rows[i] for i in ids])
    assert {tuple(r) for r in knn.mutual(v).collect()} == _pairs(ids, x)
    got = collections.defaultdict(list)
    for r in knn.neighbours(v).orderBy("id", "rank").collect():
        got[r["id"]].append(r["similarity"])
    s = x @ x.T
    np.fill_diagonal(s, -9)
    assert np.allclose([got[i] for i in ids], -np.sort(-s, 1)[:, :5])


def test_neighbours_of_odd_rows(spark):
    e = lambda i, y=0.0: [1.0 if j == i else y for j in range(4)]
    rows = [("a", e(0), None, 1), ("a", e(1), None, 0), ("b", None, "[1,0,0,0]", 1), ("c", None, None, 1), ("d", [0.0] * 4, None, 1), ("e", [1.0], None, 1), ("f", [float("nan")] * 4, None, 1), (None, e(0), None, 1), ("g", e(3), None, None), ("h", None, "[1,x]", 1)]
    rows += [(f"z{i}", e(0), None, 2) for i in range(9)]
    v = spark.createDataFrame(rows, "id string, vector array<float>, embedding string, created_at int")
    got = collections.defaultdict(list)
    for r in knn.neighbours(v, 3, dim=4).orderBy("id", "rank").collect():
        got[r["id"]].append(r["neighbour"])
    assert set(got) == {"a", "b", "g"} | {f"z{i}" for i in range(9)}
    assert got["a"] == ["b", "z0", "z1"] and got["z5"] == ["a", "b", "z0"] and got["z0"] == ["a", "b", "z1"] and got["g"] == ["a", "b", "z0"]
    assert knn.neighbours(v.limit(0), 3, dim=4).count() == 0


def test_blocks_give_what_one_block_gives(spark, monkeypatch):
    r = np.random.default_rng(3)
    df = spark.createDataFrame([(f"{i:04d}", x.tolist(), None, 0) for i, x in enumerate(r.normal(size=(700, 8)))], "id string, vector array<float>, embedding string, created_at int")
    one = sorted(map(tuple, knn.neighbours(df, 4, dim=8).select("id", "neighbour", "rank").collect()))
    monkeypatch.setattr(knn, "BLOCK", 100)
    monkeypatch.setattr(knn, "TILE", 64)
    assert sorted(map(tuple, knn.neighbours(df, 4, dim=8, parallel=8).select("id", "neighbour", "rank").collect())) == one


def test_texts_of_vectors_are_read_once(spark):
    rows = [("a", None, "[3, 4]", 1), ("b", [1.0, None], None, 1), ("c", None, "[2e-310,0]", 1), ("d", [-6.0, 8.0], "[1,0]", 1), ("e", [1.0, 2.0, 3.0], None, 1)]
    v = knn.latest(spark.createDataFrame(rows, "id string, vector array<float>, embedding string, created_at int"), 2)
    assert {r["id"]: r["v"] for r in v.collect()} == {"a": [0.75 / 1.25, 1 / 1.25], "c": [1.0, 0.0], "d": [-0.75 / 1.25, 1 / 1.25]}
    assert v._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 1


def test_vectors_of_a_block_move_together(spark, monkeypatch):
    """Rows that go to the cells of the grid hold many vectors each, and few of a cell's pairs are refined."""
    r = np.random.default_rng(5)
    df = spark.createDataFrame([(f"{i:04d}", x.tolist(), None, 0) for i, x in enumerate(r.normal(size=(1500, 16)))], "id string, vector array<float>, embedding string, created_at int")
    written, cut = {}, knn.cut
    monkeypatch.setattr(knn, "BLOCK", 200)
    monkeypatch.setattr(knn, "cut", lambda df, what="t": written.setdefault(what, cut(df, what)))
    knn.neighbours(df, 5, dim=16, parallel=8)
    parts = written["classes"].rdd.getNumPartitions()
    assert written["coded"].count() <= 4 * max(parts, 4) < 1500


def test_cell_refines_few_pairs(monkeypatch):
    r = np.random.default_rng(6)
    x = r.normal(size=(5000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    coded = pd.concat(knn._coded(16, 2)(iter([pd.DataFrame({"c": range(5000), "v": [v.tobytes() for v in x]})])))
    refined, full = [], knn._Side.full
    monkeypatch.setattr(knn._Side, "full", lambda side, rows: refined.append(len(rows)) or full(side, rows))
    for i, j in ((0, 0), (0, 1)):
        del refined[:]
        got = knn._cell(5, -1.0, 16)((i, j), coded[coded["block"] == i], coded[coded["block"] == j])
        pairs = set(zip(got["a"].astype(int), got["b"].astype(int), strict=True))
        for a, b in ((i, j), (j, i)):
            s = x[a::2] @ x[b::2].T
            if a == b:
                np.fill_diagonal(s, -9)
            best = np.argsort(-s, 1)[:, :5]
            assert {(2 * m + a, 2 * n + b) for m, row in enumerate(best.tolist()) for n in row} <= pairs
        assert sum(refined) / 2 < 0.02 * 2500 * 2500 * (1 + (i != j))


# Distinctive terms.


def test_terms(spark):
    rows = [("1", "zebra zebra zebra the the of"), ("2", "zebra the of a"), ("3", "the of the a"), ("4", None), ("5", ""), (None, "zebra"), ("1", "zebra zebra zebra the the of")]
    df = spark.createDataFrame([(i, c, 0, "x") for i, c in rows], "id string, content string, created_at int, term string")
    recs = distinctive.records(df, "t", "id")
    got = {(r["record_id"], r["term"]): r for r in distinctive.scores(recs).collect()}
    assert got["1", "zebra"]["tf"] == 3 and got["1", "zebra"]["df"] == 2
    assert got["1", "zebra"]["score"] > 0.9 > got["1", "the"]["score"]
    joined = {(r["record_id"], r["term"]): round(r["score"], 9) for r in distinctive.scores(recs, broadcast_terms=0).collect()}
    assert joined == {k: round(r["score"], 9) for k, r in got.items()}
    kept = distinctive.scores(recs, distinctive.Keep(3, 2, 8, 5, False)).collect()
    assert [(r["record_id"], r["term"]) for r in kept] == [("1", "zebra")]
    assert distinctive.scores(recs.limit(0)).count() == 0


def test_model_explains_common_terms_away():
    p = distinctive.parsimonious(np.array([0, 0, 1]), np.array([5, 5, 2]), np.array([0.2, 0.0001, 0.5]))
    assert p[1] > 0.99 and p[2] == 1.0


def _model(docs):
    """The parsimonious model of each record, one record and term at a time."""
    counts = {k: collections.Counter(common.py_tokens(t)) for k, t in docs.items()}
    cf = sum(counts.values(), collections.Counter())
    whole, out = sum(cf.values()), {}
    for k, tf in counts.items():
        p = {t: n / sum(tf.values()) for t, n in tf.items()}
        for _ in range(distinctive.STEPS):
            e = {t: n * distinctive.OWN * p[t] / ((1 - distinctive.OWN) * cf[t] / whole + distinctive.OWN * p[t]) for t, n in tf.items()}
            q = {t: x / sum(e.values()) for t, x in e.items()}
            done = max(abs(q[t] - p[t]) for t in q) < distinctive.EPS
            p = q
            if done:
                break
        out |= {(k, t): x for t, x in p.items()}
    return out


@pytest.mark.parametrize("broadcast_terms", [1_000_000, 0])
def test_scores_are_those_of_brute_force(spark, broadcast_terms, monkeypatch):
    monkeypatch.setattr(skew, "HOT_PART", 20)
    r = random.Random(7)
    docs = {f"d{i}": " ".join(r.choices(["the", "of", "index", "vector", f"own{i}", f"kin{i % 4}"], [30, 20, 5, 3, 4, 4], k=r.randint(1, 60))) for i in range(60)}
    recs = spark.createDataFrame([("t", k, v) for k, v in docs.items()], "table_name string, record_id string, content string")
    got = {(x["record_id"], x["term"]): x["score"] for x in distinctive.scores(recs, broadcast_terms=broadcast_terms).collect()}
    assert got == pytest.approx(_model(docs), abs=1e-6)


# Rankings.


def _tail(r, a, b):
    """I_r(a, b) by the midpoint rule; for a < 1 after x = y^(1/a), which takes the pole at zero away."""
    y = (np.arange(200_000) + 0.5) / 200_000
    part = ((1 - y ** (1 / a) * r) ** (b - 1)).mean() * r**a / a if a < 1 else ((y * r) ** (a - 1) * (1 - y * r) ** (b - 1)).mean() * r
    return float(part / math.exp(math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)))


def test_tail_is_the_beta_distribution():
    cases = [(0.3, 2, 5), (0.5, 5, 5), (1.0, 1, 3), (0.999, 1, 40), (1e-9, 3, 3)]
    want = [sum(math.comb(n, j) * r**j * (1 - r) ** (n - j) for j in range(k, n + 1)) for r, k, n in cases]
    r, k, n = (np.array(x, float) for x in zip(*cases, strict=True))
    assert np.exp(fused.log_beta_tail(r, k, n - k + 1)) == pytest.approx(want, rel=1e-9)
    for r, a, b in [(0.2, 0.35, 2.65), (0.7, 1.5, 1.5), (0.05, 2.2, 1.8), (0.9, 60.5, 40.5)]:
        assert math.exp(fused.log_beta_tail(*np.array([[r], [a], [b]]))[0]) == pytest.approx(_tail(r, a, b), rel=1e-4)
    assert fused.log_beta_tail(np.array([1e-6]), np.array([100.0]), np.array([1.0]))[0] == pytest.approx(100 * math.log(1e-6))


def _brute(rows, weights):
    """Items of one query in order, from scores {strategy: {id: score}}."""
    lists, unit = len(rows), len(rows) / sum(weights.values())
    out = []
    for i in {i for s in rows.values() for i in s}:
        ranks = []
        for s, scores in rows.items():
            if i in scores:
                better, ties = sum(x > scores[i] for x in scores.values()), sum(x == scores[i] for x in scores.values())
                ranks.append(((better + ties / 2) / len(scores), weights[s] * unit))
        p = min(_tail(r, a, lists - a + 1) if r < 1 else 1.0 for r, _ in ranks for a in [min(lists, sum(w for x, w in ranks if x <= r))])
        mean = (sum(r * w for r, w in ranks) + lists - sum(w for _, w in ranks)) / lists
        out.append((round(math.log(p), 3), round(mean, 9), i, min(1.0, p * lists)))
    return sorted(out)


def test_ranking_is_that_of_brute_force(spark):
    r = random.Random(4)
    for n in (2, 3, 5):
        scores = {f"s{k}": {f"i{j}": float(r.randint(0, 9)) * 10**k for j in range(12) if r.random() < 0.8} for k in range(n)}
        weights = {f"s{k}": r.choice([0.3, 1.0, 2.5]) for k in range(n)}
        results = spark.createDataFrame([("q", "p", s, i, x, 1, 0) for s, items in scores.items() for i, x in items.items()], R)
        got = [(x["id"], x["significance"]) for x in fused.ranking(results, spark.createDataFrame([("p", weights)], O)).orderBy("rank").collect()]
        want = _brute(scores, weights)
        assert dict(got) == pytest.approx({i: p for *_, i, p in want}, rel=1e-3)
        at = {i: k for k, (i, _) in enumerate(got)}
        assert all(at[x[2]] < at[y[2]] for x, y in zip(want, want[1:], strict=False) if x[0] < y[0] - 0.01)


def test_a_hundred_routes(spark):
    rows = [("q", "p", f"s{k}", f"i{j}", float(j * (k + 1)), 1, 0) for k in range(100) for j in range(5)]
    got = fused.ranking(spark.createDataFrame(rows, R), spark.createDataFrame([("p", {f"s{k}": 1.0 + k for k in range(100)})], O)).orderBy("rank").collect()
    assert [x["id"] for x in got] == ["i4", "i3", "i2", "i1", "i0"]


R = "query_id string, profile string, strategy string, id string, score double, retrieved_at int, rank int"
O = "profile string, weights map<string,double>"  # noqa: E741


def test_scale_does_not_rule(spark):
    rows = [("q", "p", "keyword", f"i{k}", 1e6 * k, 1, 0) for k in range(10)] + [("q", "p", "vector", f"i{k}", 1 - k / 100, 1, 0) for k in range(10)]
    rows += [("q", "p", "vector", "i9", 5.0, 2, 0), ("q", "p", "graph", "i9", float("nan"), 1, 0), ("q", "p", "graph", "i8", None, 1, 0), (None, "p", "graph", "i8", 1.0, 1, 0), ("w", "zero", "vector", "a", 1.0, 1, 0), ("w", "zero", "keyword", "b", 2.0, 1, 0), ("w", "zero", "keyword", "a", 1.0, 1, 0), ("t", "p", "vector", "a", 1.0, 1, 0), ("t", "p", "vector", "b", 1.0, 1, 0), ("t", "p", "keyword", "a", 1.0, 1, 0), ("u", "none", "x", "a", 1.0, 1, 0), ("u", "none", "y", "a", 1.0, 1, 0), ("u", "none", "y", "a", 1.0, 1, 0)]
    results = spark.createDataFrame(rows, R)
    options = spark.createDataFrame([("p", {"vector": 1.0, "keyword": 1.0}), ("zero", {"vector": 1.0, "keyword": 0.0})], O)
    assert {tuple(r) for r in fused.leaders(results, options).collect()} == {("q", "i9"), ("u", "a")}
    order = {r["query_id"]: r["id"] for r in fused.ranking(results, options).filter("rank = 1").collect()}
    assert order == {"q": "i9", "w": "a", "t": "a", "u": "a"}
    assert fused.ranking(results.limit(0), options).count() == 0


def test_weights_matter(spark):
    rows = [("q", "p", s, f"i{k}", float(k if s == "vector" else 9 - k), 1, 0) for s in ("vector", "keyword") for k in range(10)]
    results = spark.createDataFrame(rows, R)
    for s, first in (("vector", "i9"), ("keyword", "i0")):
        options = spark.createDataFrame([("p", {"vector": 0.1, "keyword": 0.1} | {s: 9.0})], O)
        assert fused.ranking(results, options).filter("rank = 1").first()["id"] == first


# Names.


@pytest.mark.parametrize("a,b,same", [
    ("Anthony Brehozezar", "BREHOZEZAR, Tony", True), ("Anthony Brehozezar", "anthony.brehozezar", True), ("Dr. Anthony B. Brehozezar", "AnthonyBrehozezar (editor)", True), ("Anthony Brehozezar", "Anthony Brehozuzar", True),
    ("Anthony Brehozezar", "A. Brehozezar", True), ("Anthony Brehozezar", "Alice Brehozezar", False), ("Becky Milebroston", "Rebecca Milebroston", True), ("Jubimajör, Deborah", "Deborah Jubimajor", True),
    ("Betapomal Textile Mfg Incorporated", "THE BETAPOMAL TEXTILE MANUFACTURING INC.", True), ("Betapomal Data Services GmbH", "Betapomal Textile Mfg", False), ("Kibrazugum DS Co", "Kibrazugum Data Services", True),
    ("Foods, Zetomujul Marine (Corporation)", "ZetomujulMarineFoods", True), ("蔚榆瀚澜海洋食品股份有限公司", "蔚榆瀚澜海洋", True), ("海洋食品铭锦轩碧", "铭锦轩碧海洋食品有限公司", True), ("峻泽泽峻海洋食品", "峻泽泽峻出版传媒", False), ("X Engine 9", "X Engine 3", False),
])
def test_spellings(a, b, same):
    (ka, wa), (kb, wb) = names.parse(a), names.parse(b)
    assert (ka == kb and names.alike(wa, wb, ka) >= 0.75) is same


def test_linking(spark):
    rows = [
        ("1", "Anthony Brehozezar", "PERSON", None), ("2", "BREHOZEZAR, Tony", None, []), ("3", "A. Brehozezar", "person", None), ("4", "Benjamin Brehozezar", "PERSON", ["@bob99"]), ("5", "bob99", "PERSON", None),
        ("6", "Carl Vosekirer", "PERSON", None), ("7", "Clara Vosekirer", "PERSON", None), ("8", "C. Vosekirer", "PERSON", None), ("9", "2021-Q3", "DATE", None), ("10", "2021-Q3", "DATE", None), ("11", None, "PERSON", [None]), ("1", "Anthony Brehozezar", "PERSON", None), (None, "x", None, None),
    ]
    e = spark.createDataFrame([(*r, 1) for r in rows], "id string, name string, entity_type string, aliases array<string>, root int")
    got = {tuple(r) for r in names.pairs(e).collect()}
    assert got == {("1", "2"), ("1", "3"), ("2", "3"), ("4", "5")}
    assert names.pairs(e.limit(0)).count() == 0


def test_buckets_meet_as_the_curve_says():
    assert len({k for k in names.keys("latin", ["anthony", "brehozezar"])} & set(names.keys("latin", ["anthony", "brehozuzar"]))) > 0
    assert names.keys("handle", ["x1"]) == []


def test_every_problem_has_its_query():
    q = queries.queries()
    assert {f"p{n}_found" for n in (1, 2, 3, 4, 5, 6, 7, 10)} <= set(q) and {int(k[1:].split("_")[0]) for k in q} == set(range(1, 11))


def test_alike_forms_of_crowded_buckets_meet(spark):
    r, slip = np.random.default_rng(1), {}
    while len(slip) < 4000:
        w = "".join(r.choice(list("bcdfghklmnprstvz")) + r.choice(list("aeiou")) for _ in range(4))
        slip[w] = w[:3] + "xyjqw"[len(slip) % 5] + w[4:]
    left = collections.defaultdict(set)
    for w in [*slip, *slip.values()]:
        for v in [w, *(w[:i] + w[i + 1 :] for i in range(8))]:
            left[v].add(w)
    near = lambda w: set().union(*(left[v] for v in [w, *(w[:i] + w[i + 1 :] for i in range(8))]))
    alone = [(w, x) for w, x in slip.items() if near(w) == near(x) == {w, x}]
    rows = [(f"{i}{side}", f"Thomas {w.title()}", None, "PERSON") for i, both in enumerate(alone) for side, w in zip("ab", both, strict=True)]
    got = {tuple(x) for x in names.pairs(spark.createDataFrame(rows, "id string, name string, aliases array<string>, entity_type string")).collect()}
    assert len(alone) > 2000 and got == {(f"{i}a", f"{i}b") for i in range(len(alone))}


def test_meetings_hold_all_alike_forms(spark, sf):
    said = {x for r in spark.read.parquet(f"{sf}/entities.parquet").select("name", "aliases").collect() for x in [r[0], *(r[1] or [])] if x}
    said |= {"Acme Data Services", "DS Acme", "J. Smithson", "John Smithson", "Jack Smithsen", "北京华星数据有限公司", "北京华星数据集团", "北京华兴数据有限公司", "北京华星数据科技"}
    forms = sorted({(k, tuple(w)) for k, w in filter(None, map(names.parse, said))})
    df = spark.createDataFrame([(i, k, list(w)) for i, (k, w) in enumerate(forms)], "f long, kind string, words array<string>")
    met = {tuple(r) for r in names.meetings(df).collect()}
    same = lambda x, y: x[0] == y[0] and x[1] != y[1] and names.alike(list(x[1]), list(y[1]), x[0]) >= 0.75
    want = {(i, j) for i, x in enumerate(forms) for j, y in enumerate(forms) if i < j and same(x, y) and sorted(x[1]) != sorted(y[1])}
    assert want and want <= met


def test_misspelled_common_words_do_not_meet_all_firms(spark):
    leads = [f"{a}{b}{c}" for a in ("bra", "clo", "dri", "fen") for b in ("ga", "hu", "jo", "ki", "lem") for c in ("mor", "nix", "pul")]
    names_ = [f"{x.title()} Data Services" for x in leads] + [f"{x.title()} {m} Services" for x, m in zip(leads[::3], itertools.cycle(["Dtaa", "Daat", "Ddata", "Dat4"]))]
    # acronyms of some or all of the firm's words, a consonant short form, an initial, and a slip in the lead word
    names_ += ["Acmex DS Group", "Acmex Data Services Group", "Kolbrand DG", "Kolbrand Data Group", "Bartold Btld Group", "Bartold Group", "Karl Martinn", "K. Martin", "Bragamur Data Services", "Zorwin Mrtn", "Zorwin Martinson"]
    forms = sorted({(k, tuple(w)) for k, w in map(names.parse, names_)})
    df = spark.createDataFrame([(i, k, list(w)) for i, (k, w) in enumerate(forms)], "f long, kind string, words array<string>")
    met = {tuple(r) for r in names.meetings(df).collect()}
    alike = {(i, j) for i, x in enumerate(forms) for j, y in enumerate(forms) if i < j and x[0] == y[0] and names.alike(list(x[1]), list(y[1]), x[0]) >= 0.75}
    assert len(alike) > 20 and alike <= met
    # 20 misspelled names beside 60 others
    assert len(met) < 4 * len(forms)
