"""One query for each operator, over the whole tables of a folder."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumbra.functions import hashing
from lumbra.functions import text as X
from lumbra.functions import vectors as V
from lumbra.functions.embed import embed
from lumbra.functions.embed import hashing as hashing_embedder
from lumbra.functions.generate import mock
from lumbra.operators import acl, chunking, dedup, evaluate, fusion, graph, hnsw, keyword, prompt, rerank, rewrite, segment, store, vector
from lumbra.plans.engine import Engine
from lumbra.session import run_dir
from lumbra.sources import files
from lumbra.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]

QUERIES = [("q1", "latency vector index"), ("q2", "ledger snapshot policy"), ("q3", "der Vektor speichert"), ("q4", "le graphe d’entités"), ("q5", "archive archive budget"), ("q6", "词典与快照")]
PHRASES = [("p1", "the vector"), ("p2", "In the second phase"), ("p3", "über Nacht"), ("p4", "归档")]
PREFIXES = [("x1", "norm"), ("x2", "Über"), ("x3", "qu")]
FUZZY = [("f1", "vektor"), ("f2", "snapshoot"), ("f3", "über")]
NEEDLES = [("n1", "5 > 3"), ("n2", "top_k"), ("n3", "~"), ("n4", "100%")]
NAMES = [("e1", "Marine Foods"), ("e2", "Anthony Brehozezar"), ("e3", "clara"), ("e4", "Retrieval Systems")]
SYNONYMS = [("report", "memo"), ("plan", "roadmap"), ("plan", "scheme"), ("guide", "manual"), ("notes", "minutes")]
WEIGHTS = {"vector": 0.6, "keyword": 0.3}

ALL: dict[str, Query] = {}


def query(f: Query) -> Query:
    ALL[f.__name__] = f
    return f


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _values(spark: SparkSession, rows: list, names: str = "query_id string, query string") -> DataFrame:
    return spark.createDataFrame(rows, names)


def _index(spark: SparkSession, sf: str, text: str = "text", tokenizer: keyword.Tokenizer = X.han_tokens) -> keyword.Index:
    return keyword.index(_t(spark, sf, "documents"), "doc_id", text, tokenizer)


def _scored(df: DataFrame) -> DataFrame:
    return df.select("query_id", "id", F.round("score", 5).alias("score"), "rank")


# Keyword retrieval.


@query
def token_stats(spark, sf):
    return _index(spark, sf).stats().select("documents", "terms", "tokens", F.round("avgdl", 6).alias("avgdl"))


@query
def vocabulary_df(spark, sf):
    return _index(spark, sf, tokenizer=X.simple_tokens).vocabulary()


@query
def bm25_topk(spark, sf):
    return _scored(keyword.bm25(_index(spark, sf), _values(spark, QUERIES), 10))


@query
def bm25_title_content(spark, sf):
    docs = _t(spark, sf, "documents").select("doc_id", F.concat_ws(" ", "title", "content").alias("whole"))
    hits = keyword.bm25(keyword.index(docs, "doc_id", "whole"), _values(spark, QUERIES), 5)
    return store.enriched(hits, docs, [X.truncate(F.col("whole"), 500).alias("content")], "doc_id").select("query_id", "id", F.round("score", 5).alias("score"), "rank", "content")


@query
def bm25_chunks(spark, sf):
    chunks = _t(spark, sf, "chunks").groupBy("id").agg(F.max("content").alias("content"), F.max("document_id").alias("document_id"))
    hits = keyword.bm25(keyword.index(chunks), _values(spark, QUERIES), 10)
    return hits.join(chunks.select("id", "document_id"), "id").select("query_id", F.col("id").alias("chunk_id"), "document_id", F.round("score", 5).alias("score"), "rank")


@query
def fts_conjunctive(spark, sf):
    return _scored(keyword.conjunctive(_index(spark, sf), _values(spark, QUERIES), 10))


@query
def boolean_search(spark, sf):
    found = keyword.boolean(_index(spark, sf), ["vector index", "the"], ["latency", "snapshot policy"], ["ledger"], 50)
    return found.select("id", F.round("score", 5).alias("score"), "rank")


@query
def boolean_should_only(spark, sf):
    return keyword.boolean(_index(spark, sf), should=["latency", "snapshot policy"], must_not=["vector"], k=50).select("id", F.round("score", 5).alias("score"), "rank")


@query
def boolean_strict(spark, sf):
    return keyword.strict_boolean(_index(spark, sf), every=["the"], some=["ledger", "archive"], none=["vector"])


@query
def boolean_negation(spark, sf):
    return keyword.strict_boolean(_index(spark, sf), none=["the", "der"])


@query
def phrase_search(spark, sf):
    return _scored(keyword.phrase(_index(spark, sf), _values(spark, PHRASES), None))


@query
def phrase_adjacent(spark, sf):
    return _scored(keyword.adjacent(_index(spark, sf), _values(spark, PHRASES), None))


@query
def prefix_search(spark, sf):
    return _scored(keyword.prefix(_index(spark, sf), _values(spark, PREFIXES), None))


@query
def content_prefix(spark, sf):
    return keyword.like(_t(spark, sf, "documents"), _values(spark, [("c1", "the "), ("c2", "# "), ("c3", "若")]), "doc_id", ["content"], start=True)


@query
def fuzzy_search(spark, sf):
    return _scored(keyword.fuzzy(_index(spark, sf), _values(spark, FUZZY), 2, 20))


@query
def trigram_similarity(spark, sf):
    names = _t(spark, sf, "entities").groupBy("id").agg(F.max("name").alias("name"))
    return _scored(keyword.trigram(names, _values(spark, NAMES), "id", "name", 0.3, None))


@query
def ilike_search(spark, sf):
    return keyword.like(_t(spark, sf, "documents"), _values(spark, NEEDLES), "doc_id", ["title", "content"])


@query
def contains_search(spark, sf):
    return keyword.contains(_t(spark, sf, "documents"), "Ledger", ["title", "content"]).select("doc_id")


@query
def first_chunk_search(spark, sf):
    docs = _t(spark, sf, "documents").select("doc_id", "content")
    return keyword.first_chunks(docs, _t(spark, sf, "chunks").distinct(), "ledger", 200, "doc_id")


@query
def web_search(spark, sf):
    return keyword.web_search(_index(spark, sf), '"the vector" archive OR ledger -budget')


@query
def highlight(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", X.highlight(F.col("title"), F.lit("report plan é notes a")).alias("marked"))


@query
def clean_query(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", X.clean_fts(F.col("title")).alias("cleaned"))


@query
def index_upsert(spark, sf):
    ix = _index(spark, sf)
    changed = _t(spark, sf, "documents").filter("lang = 'de'").select(F.col("doc_id").alias("id"), F.coalesce("title", F.lit("")).alias("content"))
    ix = ix.add(changed).remove(_t(spark, sf, "documents").filter("lang = 'fr'").select(F.col("doc_id").alias("id")))
    return ix.stats().select("documents", "terms", "tokens")


@query
def index_repeated(spark, sf):
    """The documents and, under the same ids, their later titles: the later row of an id counts."""
    docs = _t(spark, sf, "documents")
    rows = docs.select("doc_id", "content", F.lit(0).alias("ord")).unionByName(docs.filter("lang = 'de'").select("doc_id", F.col("title").alias("content"), F.lit(1).alias("ord")))
    return keyword.index(rows, "doc_id", "content", order="ord").stats().select("documents", "terms", "tokens")


@query
def index_stored(spark, sf):
    import uuid

    stored = _index(spark, sf).store(f"{run_dir(spark)}/index-{uuid.uuid4().hex}")
    return _scored(keyword.bm25(stored, _values(spark, QUERIES), 10))


@query
def han_segmentation(spark, sf):
    words = segment.Dictionary({"词典": 50, "快照": 40, "归档": 40, "分词器": 60, "分词": 20, "索引": 30})
    docs = _t(spark, sf, "documents").select("doc_id", segment.tokenizer(words, "search")(F.col("content")).alias("t"))
    return docs.select(F.explode("t").alias("term")).filter(F.length("term") > 1).groupBy("term").agg(F.count("*").alias("n"))


@query
def han_tags(spark, sf):
    """Classes of the words of a text whose words stand apart, so that their split is known."""
    words = segment.Dictionary.from_table(_values(spark, [("词典", 50, "n"), ("快照", 40, "n"), ("更新", 30, "v")], "word string, count int, class string"))
    docs = _t(spark, sf, "documents").select("doc_id", F.concat_ws(" ", F.lit("词典 更新"), F.when(F.col("lang") == "zh", "快照").otherwise("其"), "lang").alias("t"))
    return docs.select("doc_id", F.posexplode(segment.tags(words, F.col("t"))).alias("n", "x")).select("doc_id", "n", "x.word", "x.class")


# Chunking and text functions.


def _chunks(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "chunk_index", "start_pos", "end_pos", "chunk", "token_count")


@query
def chunk_fixed(spark, sf):
    return _chunks(chunking.fixed(_t(spark, sf, "documents").select("doc_id", "content")))


@query
def chunk_stream(spark, sf):
    return _chunks(chunking.stream(_t(spark, sf, "documents").select("doc_id", "content"), size=300, overlap=60))


@query
def chunk_buffered(spark, sf):
    return _chunks(chunking.buffered(_t(spark, sf, "documents").select("doc_id", "content"), size=300, overlap=60))


@query
def chunk_recursive(spark, sf):
    return _chunks(chunking.recursive(_t(spark, sf, "documents"), "doc_id"))


@query
def chunk_deep(spark, sf):
    return _chunks(chunking.recursive(_t(spark, sf, "documents"), "doc_id", deep=True))


@query
def chunk_semantic(spark, sf):
    return _chunks(chunking.semantic(_t(spark, sf, "documents"), "doc_id"))


@query
def chunk_lines(spark, sf):
    return _chunks(chunking.lines(_t(spark, sf, "documents"), "doc_id"))


@query
def sentence_split(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.posexplode(X.sentences(F.col("content"))).alias("n", "sentence"))


@query
def token_estimate(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", X.token_estimate(F.col("content")).alias("tokens"), X.word_count(F.col("content")).alias("words"), F.octet_length("content").alias("bytes"))


@query
def rerank_tokens(spark, sf):
    return _t(spark, sf, "documents").select(F.explode(X.space_tokens(F.col("content"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query
def text_predicates(spark, sf):
    t = F.col("title")
    return _t(spark, sf, "documents").select("doc_id", X.is_han(t).alias("han"), X.is_punctuation(t).alias("punctuation"), X.truncate(t, 12).alias("short"), X.trim(F.col("content")).alias("trimmed"))


# Sources.


@query
def detect_types(spark, sf):
    path = F.concat_ws("", F.lit("/data/in.d/"), F.col("doc_id").cast("string"), F.lit("."), F.coalesce("doc_type", F.lit("bin")))
    return _t(spark, sf, "documents").select("doc_id", X.doc_type(path).alias("detected"), X.path_title(path).alias("name"), X.extension(path).alias("extension"))


@query
def html_strip(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", X.strip_tags(F.col("content")).alias("stripped"))


@query
def html_title(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", X.html_title(F.col("content")).alias("html_title"))


@query
def html_without_script(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.length(X.without_blocks(F.col("content"))).alias("left"))


@query
def html_list_items(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.posexplode(X.list_items(F.col("content"))).alias("n", "item"))


@query
def html_entities(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", X.decode_entities(F.col("content")).alias("decoded"))


@query
def markdown_title(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", X.markdown_title(F.col("content")).alias("md_title"))


@query
def front_matter(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.explode(X.front_matter(F.col("content"))).alias("key", "value"))


@query
def text_paragraphs(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.posexplode(X.paragraphs(F.col("content"))).alias("n", "paragraph"))


def _files(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.lower(F.regexp_replace(F.coalesce("doc_type", F.lit("txt")), r"^\.", ""))
    docs = _t(spark, sf, "documents").select(F.concat_ws(".", F.col("doc_id").cast("string"), kind).alias("source"), F.coalesce("content", F.lit("")).alias("content"))
    return files.write(docs)


@query
def pdf_pages(spark, sf):
    """Titles as PDF files of two pages and back: elements of each page."""
    docs = _t(spark, sf, "documents").filter("title is not null")
    body = F.concat("title", F.lit("\n\nIt ends here.\f"), F.coalesce("lang", F.lit("none")))
    made = files.to_pdf(docs.select(F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")).alias("source"), body.alias("content")))
    return files.elements(made).select("source", "page", "type", "text")


@query
def docx_paragraphs(spark, sf):
    """Every content as a Word file and back: its lines that aren't empty."""
    docs = _t(spark, sf, "documents").filter("content is not null").select(F.concat(F.col("doc_id").cast("string"), F.lit(".docx")).alias("source"), "content")
    read = files.elements(files.to_docx(docs)).filter("type = 'paragraph'")
    return read.groupBy("source").agg(F.count("*").alias("paragraphs"), F.sum(F.length("text")).alias("characters"))


@query
def csv_records(spark, sf):
    """Records as CSV files of two lines, read as texts."""
    docs = _t(spark, sf, "documents").filter("lang is not null")
    line = F.concat(F.lit("lang,doc_version\n"), "lang", F.lit(","), F.col("doc_version").cast("string"))
    made = docs.select(F.concat(F.col("doc_id").cast("string"), F.lit(".csv")).alias("source"), F.encode(line, "UTF-8").alias("data"))
    return files.documents(made).select("source", "content", F.element_at("metadata", F.lit("rows")).alias("rows"))


@query
def file_blocks(spark, sf):
    made = _t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("source"), F.encode("content", "UTF-8").alias("data"))
    return files.blocks(made, 512).select("source", "block", F.octet_length("data").alias("bytes"), F.sha2("data", 256).alias("hash"))


@query
def hash_cache(spark, sf):
    docs = _t(spark, sf, "documents").filter("content is not null").select(F.col("doc_id").cast("string").alias("source"), F.col("updated_at").alias("modified"), F.encode("content", "UTF-8").alias("data"))
    known = docs.filter("cast(source as bigint) % 2 = 0").select("source", "modified", F.lit("known").alias("hash"))
    return dedup.cached(docs, known).select("source", "hash")


@query
def hash_lookup(spark, sf):
    docs = _t(spark, sf, "documents")
    return dedup.lookup(dedup.hash_index(docs, "doc_id"), docs.filter("lang = 'fr'").select(F.sha2("content", 256).alias("hash"))).select("hash", "document_id")


@query
def time_texts(spark, sf):
    t = X.format_time(F.col("created_at"))
    return _t(spark, sf, "documents").select("doc_id", t.alias("text"), (X.parse_time(t) == F.col("created_at")).alias("same"), X.parse_time(F.col("title")).isNull().alias("none"))


@query
def chunk_peek(spark, sf):
    return _chunks(chunking.peek(_t(spark, sf, "documents").select("doc_id", "content"), 2, size=300, overlap=60))


def _named(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    """All contents as files of one kind."""
    docs = _t(spark, sf, "documents").filter("content is not null")
    return docs.select(F.concat(F.col("doc_id").cast("string"), F.lit(f".{kind}")).alias("source"), F.encode("content", "UTF-8").alias("data"))


@query
def markdown_elements(spark, sf):
    found = files.elements(_named(spark, sf, "md"))
    return found.groupBy("source", "type").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("characters"))


@query
def markdown_sections(spark, sf):
    found = files.elements(_named(spark, sf, "md")).filter("type = 'heading'")
    return found.select("source", "level", F.col("text").alias("name"), F.array_join("section_path", " > ").alias("path"))


@query
def text_rendered(spark, sf):
    return files.render(files.elements(_named(spark, sf, "txt")))


@query
def text_counts(spark, sf):
    return files.counts(files.elements(_named(spark, sf, "log"))).select("source", "paragraphs", "tables", "images", "words")


@query
def json_files(spark, sf):
    docs = files.documents(_named(spark, sf, "json"))
    return docs.select("source", F.element_at("metadata", F.lit("json_type")).alias("kind"), F.col("error").isNotNull().alias("failed"))


@query
def parse_elements(spark, sf):
    return files.elements(_files(spark, sf)).groupBy("type").agg(F.count("*").alias("n"))


@query
def parse_documents(spark, sf):
    return files.documents(_files(spark, sf)).select("source", "title", "doc_type", F.length("content").alias("characters"), F.col("error").isNotNull().alias("failed"))


@query
def element_counts(spark, sf):
    return files.counts(files.elements(_files(spark, sf)))


@query
def render_elements(spark, sf):
    return files.render(files.elements(_files(spark, sf)))


@query
def ingest_report(spark, sf):
    return ingest.batch_report(files.documents(_files(spark, sf))).select("total", "succeeded", "failed")


@query
def json_sink(spark, sf):
    return files.to_json(_t(spark, sf, "documents").select("doc_id", "lang", "doc_version", "title"))


# Vectors.


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.create_map(F.lit("label"), F.col("label").cast("string")).alias("metadata"))


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    return _vectors(spark, sf).filter("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")


@query
def knn_cosine(spark, sf):
    return _scored(vector.knn(_vectors(spark, sf), _asked(spark, sf), 10))


@query
def knn_l2(spark, sf):
    return _scored(vector.knn(_vectors(spark, sf), _asked(spark, sf), 10, metric="l2"))


@query
def knn_filtered(spark, sf):
    return _scored(vector.knn(_vectors(spark, sf), _asked(spark, sf), 5, {"label": "3"}))


@query
def hnsw_ideal(spark, sf):
    return _scored(vector.hnsw_search(_vectors(spark, sf), _asked(spark, sf), 5, 30, {"label": "3"}))


@query
def multi_query_knn(spark, sf):
    q = _asked(spark, sf).withColumn("group_id", F.floor(F.col("query_id") / 100)).withColumn("ord", F.col("query_id") % 100)
    return _scored(vector.multi_query(_vectors(spark, sf), q, 10))


@query
def ivf_knn(spark, sf):
    return _scored(vector.Ivf(_vectors(spark, sf), 50).search(_asked(spark, sf), 10, 30))


def _recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: queries, and whether nine tenths of their exact neighbours and more were found."""
    hit = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hit.agg(F.count_distinct("query_id").alias("queries"), (F.sum("hit") / F.count("*") >= 0.9).alias("enough"))


@query
def ivf_recall(spark, sf):
    v, q = _vectors(spark, sf), _asked(spark, sf)
    return _recall(vector.Ivf(v, 50).search(q, 10, 30), vector.knn(v, q, 10))


@query
def hnsw_recall(spark, sf):
    v, q = _vectors(spark, sf), _asked(spark, sf)
    return _recall(hnsw.Hnsw.build(v).search(q, 10, 100), vector.knn(v, q, 10, metric="l2"))


@query
def hnsw_levels(spark, sf):
    return hnsw.Hnsw.build(_vectors(spark, sf), ef=50).levels().select("level", "nodes")


@query
def knn_everything(spark, sf):
    return _scored(vector.knn(_vectors(spark, sf), _asked(spark, sf).filter("query_id % 500 = 0"), 0))


@query
def vector_normalise(spark, sf):
    n = V.normalise(F.transform("vector", lambda x: x * 3))
    return _vectors(spark, sf).select("id", F.round(V.norm(n), 6).alias("norm"), F.round(V.dot(n, F.col("vector").cast("array<double>")), 5).alias("along"))


@query
def vector_text(spark, sf):
    return _vectors(spark, sf).select("id", V.to_text(F.col("vector")).alias("text"), F.size(V.from_text(V.to_text(F.col("vector")))).alias("dim"))


@query
def vector_stats(spark, sf):
    return vector.stats(_vectors(spark, sf))


@query
def vector_upsert(spark, sf):
    v = _vectors(spark, sf).withColumn("created_at", F.lit(0))
    new = v.filter("id % 20 = 0").withColumn("metadata", F.create_map(F.lit("label"), F.lit("new"))).withColumn("created_at", F.lit(1))
    out = vector.delete(vector.upsert(v, new, 64), where={"label": "3"})
    return out.groupBy(F.element_at("metadata", F.lit("label")).alias("label")).agg(F.count("*").alias("n"))


@query
def embed_documents(spark, sf):
    docs = _t(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = embed(docs, "text", hashing_embedder(64)).select("doc_id", F.posexplode("vector").alias("pos", "value"))
    return parts.filter("value <> 0").select("doc_id", "pos", F.round("value", 5).alias("value"))


# Fusion and reranking.


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    rows = _t(spark, sf, "retrieval_results").filter("score is not null and not isnan(score)")
    return rows.groupBy("query_id", "strategy", "id").agg(F.max("score").alias("score"), F.max("content").alias("content"))


@query
def rrf_fusion(spark, sf):
    return _scored(fusion.rrf(_hits(spark, sf), 60, 10))


@query
def weighted_fusion(spark, sf):
    return fusion.weighted(_hits(spark, sf), WEIGHTS, 10).select("query_id", "id", F.round("score", 4).alias("score"), "rank")


@query
def score_threshold(spark, sf):
    return fusion.above(_hits(spark, sf), 0.5).select("query_id", "strategy", "id")


@query
def route_cascade(spark, sf):
    """Each query's hits of the first strategy that has any: graph, then keyword, then vector."""
    hits = _hits(spark, sf)
    routes = [lambda q, k, s=s: hits.filter(F.col("strategy") == s).join(q.select("query_id"), "query_id").select("query_id", "id", F.lit(s).alias("strategy")) for s in ("graph", "keyword", "vector")]
    return fusion.cascade(hits.select("query_id").distinct(), routes)


@query
def route_counts(spark, sf):
    return fusion.counts(_hits(spark, sf))


@query
def route_queries(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.array_join(fusion.route(F.coalesce("title", F.lit(""))), ",").alias("strategies"))


@query
def hybrid_search(spark, sf):
    docs = _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("content"))
    vectors = embed(docs, "content", hashing_embedder(64))
    ix = keyword.index(docs)

    def by_keyword(q, n):
        return keyword.bm25(ix, q, n).join(docs, "id")

    def by_vector(q, n):
        return vector.knn(vectors, embed(q, "query", hashing_embedder(64)), n).join(docs, "id")

    return _scored(fusion.hybrid(_values(spark, QUERIES), {"vector": by_vector, "keyword": by_keyword}, 10))


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    ix = _index(spark, sf)
    return keyword.bm25(ix, _values(spark, QUERIES), 20).join(ix.docs.select("id", "content"), "id")


@query
def rerank_match(spark, sf):
    out = rerank.match(_candidates(spark, sf), _values(spark, QUERIES), 10)
    return out.select("query_id", "id", F.round("rerank_score", 5).alias("rerank_score"), "rank")


@query
def pseudo_jaccard(spark, sf):
    score = rerank.pseudo_jaccard(F.coalesce("title", F.lit("")), F.coalesce("content", F.lit("")))
    return _t(spark, sf, "documents").select("doc_id", F.round(score, 6).alias("score"))


@query
def mmr(spark, sf):
    return _scored(rerank.mmr(_candidates(spark, sf), 10, 0.7))


@query
def rerank_pipeline(spark, sf):
    steps = [lambda c: rerank.match(c, _values(spark, QUERIES), 15).drop("score").withColumnRenamed("rerank_score", "score"), lambda c: rerank.mmr(c, 5)]
    return _scored(rerank.pipeline(_candidates(spark, sf), steps))


# Deduplication.


@query
def exact_dedup(spark, sf):
    marked = dedup.mark(_t(spark, sf, "documents"), "doc_id")
    return marked.select(F.col("id").alias("doc_id"), "hash", "content_size", "is_duplicate", "existing_id")


@query
def dedup_stats(spark, sf):
    return dedup.stats(dedup.mark(_t(spark, sf, "documents"), "doc_id"))


@query
def hash_index(spark, sf):
    return dedup.hash_index(_t(spark, sf, "documents"), "doc_id").select("hash", "document_id", "content_size", "source")


@query
def verify_hashes(spark, sf):
    docs = _t(spark, sf, "documents")
    return docs.select("doc_id", (F.lower("content_hash") == dedup.fast_hash(F.col("content"))).alias("fresh"))


@query
def sm3_hashes(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", hashing.sm3(F.col("content")).alias("sm3"))


# Graph.


def _graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = _t(spark, sf, "entities").groupBy("id").agg(F.max(F.struct("created_at", "name", F.upper("entity_type").alias("type"), "aliases", F.col("document_id").cast("string").alias("source_doc_id"), F.when(F.isnan("confidence"), None).otherwise(F.col("confidence")).alias("confidence"))).alias("x"))
    r = _t(spark, sf, "relations").groupBy("id").agg(F.max(F.struct("created_at", "source_id", "target_id", "relation_type", F.col("document_id").cast("string").alias("source_doc_id"), "confidence")).alias("x"))
    e = e.select("id", "x.name", "x.type", "x.aliases", "x.source_doc_id", "x.confidence")
    return e, r.select("id", "x.source_id", "x.target_id", F.col("x.relation_type").alias("type"), "x.source_doc_id", "x.confidence")


def _seeds(entities: DataFrame) -> DataFrame:
    return entities.filter(F.substring("id", 5, 20).cast("long") % 20 == 0).select("id")


@query
def entity_extraction(spark, sf):
    found = graph.extract_entities(_t(spark, sf, "documents"), "doc_id", "content", han=False)
    return found.select("doc_id", "name", "type", F.round("confidence", 2).alias("confidence"))


@query
def entity_extraction_han(spark, sf):
    words = _values(spark, [("retrieval", "CONCEPT"), ("快照", "TECHNOLOGY")], "word string, type string")
    return graph.extract_entities(_t(spark, sf, "documents"), "doc_id", "content", words).groupBy("doc_id", "type").agg(F.count("*").alias("n"))


@query
def relation_extraction(spark, sf):
    said = F.concat(F.lit("「"), "source", F.lit("」与「"), "lang", F.lit("」 "), "source", F.lit("使用"), "lang")
    docs = _t(spark, sf, "documents").select("doc_id", said.alias("content"))
    return graph.extract_relations(docs, graph.extract_entities(docs, "doc_id"), "doc_id")


@query
def llm_extraction(spark, sf):
    docs = _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "content")
    # a model that names every line of the text it is given
    answer = lambda p: json.dumps({"entities": [{"name": x.strip(), "type": "tool"} for x in p.split("\n\n", 1)[-1].splitlines() if x.strip()], "relations": []})
    return graph.llm_extract(docs, answer).groupBy("doc_id", "kind", "type").agg(F.count("*").alias("n"))


@query
def entity_search(spark, sf):
    return graph.search(_graph(spark, sf)[0], _values(spark, NAMES), 10)


@query
def incident_relations(spark, sf):
    e, r = _graph(spark, sf)
    return graph.incident(r, _seeds(e))


@query
def subgraph_nodes(spark, sf):
    e, r = _graph(spark, sf)
    return graph.subgraph(e, r, _seeds(e), 3)[0]


@query
def subgraph_relations(spark, sf):
    e, r = _graph(spark, sf)
    return graph.subgraph(e, r, _seeds(e), 2)[1]


@query
def simple_paths(spark, sf):
    e, r = _graph(spark, sf)
    hub = graph.edges(r).groupBy("a").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "a").limit(1).select(F.col("a").alias("target"))
    pairs = _seeds(e).select(F.col("id").alias("source")).join(F.broadcast(hub), F.lit(True))
    return graph.paths(r, pairs, 3).select("source", "target", F.array_join("nodes", ">").alias("nodes"), F.array_join("edges", ">").alias("edges"), "length")


@query
def graph_retrieve(spark, sf):
    e, r = _graph(spark, sf)
    return graph.retrieve(e, r, _values(spark, NAMES)).select("query_id", "document_id", F.round("score", 6).alias("score"))


@query
def graph_answer(spark, sf):
    e, r = _graph(spark, sf)
    return graph.answer(e, r, _values(spark, NAMES))


@query
def graph_upsert(spark, sf):
    e, _ = _graph(spark, sf)
    new = _seeds(e).select("id", F.lit("renamed").alias("name"), F.lit("CONCEPT").alias("type")).unionByName(spark.createDataFrame([("new-1", "a", "TOOL"), ("new-1", "b", "TOOL")], "id string, name string, type string"))
    return graph.get(graph.upsert(e, new), _seeds(e).unionByName(spark.createDataFrame([("new-1",)], "id string"))).select("id", "name", "type")


@query
def graph_delete(spark, sf):
    e, r = _graph(spark, sf)
    return graph.counts(*graph.delete_document(e, r, "10"))


@query
def graph_build(spark, sf):
    chunks = _t(spark, sf, "chunks").groupBy("id").agg(F.max("content").alias("content"), F.max("document_id").cast("string").alias("document_id"))
    return graph.build(chunks)[0].groupBy(F.col("source_doc_id").alias("document_id"), "type").agg(F.count("*").alias("n"), F.count_distinct("name").alias("names"))


# Evaluation, rewriting, access, prompts, store.


def _run(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    run = fusion.rrf(_hits(spark, sf), 60, 20).select("query_id", "rank", F.col("id").alias("doc_id"))
    rel = _t(spark, sf, "retrieval_results").filter("rerank_score is not null and not isnan(rerank_score)")
    rel = rel.groupBy("query_id", F.col("id").alias("doc_id")).agg(F.max("rerank_score").alias("relevance"))
    return run, rel.withColumn("relevance", F.when(F.col("relevance") > 0.5, F.round("relevance", 3)).otherwise(0.0))


@query
def eval_per_query(spark, sf):
    m = evaluate.per_query(*_run(spark, sf))
    return m.select("query_id", "retrieved", "relevant", *[F.round(c, 5).alias(c) for c in m.columns[3:]])


@query
def eval_mean(spark, sf):
    m = evaluate.mean(evaluate.per_query(*_run(spark, sf)))
    return m.select("queries", *[F.round(c, 5).alias(c) for c in m.columns[1:]])


@query
def quality_gate(spark, sf):
    g = evaluate.gate(evaluate.mean(evaluate.per_query(*_run(spark, sf))))
    return g.select("metric", F.round("value", 5).alias("value"), "threshold", "passed")


@query
def synonym_rewrite(spark, sf):
    titles = _t(spark, sf, "documents").filter("title is not null").select(F.col("doc_id").alias("query_id"), F.col("title").alias("query"))
    return rewrite.synonyms(titles, _values(spark, SYNONYMS, "word string, synonym string"))


@query
def multi_query_rewrite(spark, sf):
    titles = _t(spark, sf, "documents").filter("title is not null").select(F.col("doc_id").alias("query_id"), F.col("title").alias("query"))
    return rewrite.multi_query(titles, lambda q: f"{q}\n\n{q} guide\n about {q} \n", 2)


@query
def hyde_rewrite(spark, sf):
    titles = _t(spark, sf, "documents").filter("title is not null").select(F.col("doc_id").alias("query_id"), F.col("title").alias("query"))
    return rewrite.hyde(titles, mock("A text about "))


def _acl(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "documents")
    return d.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("owner"), F.array_compact(F.array("lang")).alias("readers"), F.array_compact(F.array("doc_type")).alias("writers"), (F.col("status") == "pending").alias("public"), F.array().cast("array<string>").alias("groups"))


@query
def acl_rights(spark, sf):
    u = F.lit("en")
    a = _acl(spark, sf)
    return a.select("doc_id", acl.can_read(u).alias("reads"), acl.can_write(F.lit("txt")).alias("writes"), acl.is_owner(F.lit("wiki-mirror")).alias("owns"))


@query
def acl_filter(spark, sf):
    wanted = _t(spark, sf, "chunks").select(F.col("document_id").cast("string").alias("doc_id"), F.col("id").alias("ord")).distinct()
    return acl.filter_documents(_acl(spark, sf), wanted, "txt")


@query
def acl_list(spark, sf):
    return acl.list_documents(acl.grant(acl.revoke(_acl(spark, sf), "7", "en"), "8", "wiki-mirror"), "wiki-mirror")


@query
def paginate_documents(spark, sf):
    return store.page(_t(spark, sf, "documents"), 20, 40, "doc_id").select("doc_id", "title")


@query
def store_update(spark, sf):
    docs = _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "title", "content", F.col("doc_version").alias("version"), "status")
    changed = docs.filter("status = 'pending'").withColumn("status", F.lit("indexed"))
    out = store.delete(store.update(docs, changed), docs.filter("status = 'deleted'").select("id"))
    return out.groupBy("status").agg(F.count("*").alias("n"), F.sum(F.col("version").cast("long")).alias("versions"))


@query
def store_checked(spark, sf):
    docs = _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "content", "doc_type", "status")
    return store.checked(docs).select("id", F.array_join("problems", ",").alias("problems"))


@query
def document_chunks(spark, sf):
    chunks = _t(spark, sf, "chunks").distinct()
    docs = _t(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    left = store.delete_chunks(chunks, _t(spark, sf, "documents").filter("lang = 'zh'").select(F.col("doc_id").alias("id")))
    return docs.join(left.select(F.col("document_id").alias("id"), F.col("id").alias("chunk_id")), "id", "left").groupBy("id").agg(F.count("chunk_id").alias("chunks"))


@query
def metadata_filter(spark, sf):
    docs = _t(spark, sf, "chunks").distinct().select("id", F.create_map(F.lit("page"), F.col("page_number").cast("string"), F.lit("n"), F.col("chunk_index").cast("string")).alias("metadata"))
    return vector.metadata_filter(docs, {"page": "1", "n": "0"}).select("id")


def _answers(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    q = _values(spark, QUERIES)
    ix = _index(spark, sf)
    docs = _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source")
    return q, keyword.bm25(ix, q, 3).join(ix.docs.select("id", "content"), "id").join(docs, "id", "left")


@query
def context_assembly(spark, sf):
    return prompt.context(_answers(spark, sf)[1])


@query
def prompt_assembly(spark, sf):
    return prompt.prompt(*_answers(spark, sf))


@query
def fallback_answers(spark, sf):
    return prompt.fallback_answer(*_answers(spark, sf))


@query
def engine_ask(spark, sf):
    docs = _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "title", "content", "source", "created_at")
    engine = Engine()
    return engine.ask(engine.index(docs), _values(spark, QUERIES), mode="keyword", k=3)


@query
def batch_indexing(spark, sf):
    """The documents indexed in three batches; those without a content are errors, and every error is told."""
    import uuid

    docs = _t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), "title", "content", "source", "created_at")
    report, errors = Engine().index_batches(docs, f"{run_dir(spark)}/batches-{uuid.uuid4().hex}", 3)
    return report.agg(F.sum("total").alias("total"), F.sum("failed").alias("failed")).crossJoin(errors.agg(F.count("*").alias("errors"), F.count_if(F.col("error") == "no content").alias("empty")))


@query
def stream_ingest(spark, sf):
    """The documents as a stream: parts are appended batch by batch, and what is current is counted."""
    import uuid

    folder = f"{run_dir(spark)}/stream-{uuid.uuid4().hex}"
    static = _t(spark, sf, "documents")
    rows = spark.readStream.schema(static.schema).parquet(f"{sf}/documents.parquet*")
    ingest.start(rows, folder, lambda b: b.select("doc_id", "lang", "doc_version")).awaitTermination()
    return ingest.latest(ingest.read(spark, folder), "doc_id").groupBy("lang").agg(F.count("*").alias("n"))


@query
def snapshot_changes(spark, sf):
    docs = _t(spark, sf, "documents")
    before = docs.filter("lang <> 'fr' or lang is null").select(F.col("doc_id").alias("source"), F.col("created_at").alias("modified"))
    now = docs.filter("lang <> 'de' or lang is null").select(F.col("doc_id").alias("source"), F.col("updated_at").alias("modified"))
    return ingest.changes(before, now).groupBy("event").agg(F.count("*").alias("n"))
