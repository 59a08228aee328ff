"""The whole pipeline: index a table of documents, answer tables of queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumbra.functions import text as X
from lumbra.functions.embed import Embedder, embed, hashing
from lumbra.functions.generate import generated
from lumbra.operators import chunking, dedup, fusion, graph, keyword, prompt, rerank, store, vector
from lumbra.plans.config import Config
from lumbra.schema import stable_id, valid_document
from lumbra.session import cut


@dataclass(frozen=True)
class Corpus:
    """What indexing gives: independent tables, each derived from the documents."""

    documents: DataFrame
    chunks: DataFrame
    index: keyword.Index
    vectors: DataFrame | None
    entities: DataFrame | None
    relations: DataFrame | None
    duplicates: DataFrame

    def save(self, folder: str) -> None:
        for name in ("documents", "chunks", "vectors", "entities", "relations", "duplicates"):
            getattr(self, name).write.mode("overwrite").parquet(f"{folder}/{name}")
        self.index.store(f"{folder}/index")


@dataclass(frozen=True)
class Engine:
    config: Config = field(default_factory=Config)
    embedder: Embedder = field(default_factory=hashing)
    tokenizer: keyword.Tokenizer = X.han_tokens

    def index(self, docs: DataFrame) -> Corpus:
        """docs: id, title, content, source, created_at. Exact copies stay out of the corpus if dedup is on; whole documents are indexed, chunks are kept beside them."""
        marked = dedup.mark(docs, enabled=self.config.dedup)
        live = docs.join(marked.filter("is_duplicate").select("id"), "id", "left_anti") if self.config.dedup else docs
        text = F.concat_ws(" ", "title", "content")
        c = self.config
        pieces = chunking.recursive(live, "id", "content", c.chunk_size, c.chunk_overlap) if c.chunker == "recursive" else chunking.build(c.chunker, size=c.chunk_size)(live)
        chunks = pieces.select(stable_id("id", "chunk_index").alias("id"), F.col("id").cast("string").alias("document_id"), F.col("chunk").alias("content"), "start_pos", "end_pos", "chunk_index", "token_count")
        whole = live.select("id", text.alias("content"))
        vectors = embed(whole, "content", self.embedder).select("id", "vector")
        entities, relations = graph.build(chunks)
        return Corpus(live.withColumn("status", F.lit("indexed")), chunks, keyword.index(whole, tokenizer=self.tokenizer), vectors, entities, relations, marked)

    def remove(self, corpus: Corpus, ids: DataFrame) -> Corpus:
        """The corpus without the documents of these ids, in all its tables."""
        gone = ids.select("id").distinct()
        by_text = gone.select(F.col("id").cast("string").alias("id"))
        chunks = store.delete_chunks(corpus.chunks, by_text)
        entities = corpus.entities.join(by_text.withColumnRenamed("id", "source_doc_id"), "source_doc_id", "left_anti")
        relations = corpus.relations.join(by_text.withColumnRenamed("id", "source_doc_id"), "source_doc_id", "left_anti")
        return Corpus(store.delete(corpus.documents, gone), chunks, corpus.index.remove(gone), vector.delete(corpus.vectors, gone), entities, relations, store.delete(corpus.duplicates, gone))

    def add(self, corpus: Corpus, docs: DataFrame) -> Corpus:
        """The corpus with these documents, in place of those with the same ids. Copies of a content that is there already stay out if dedup is on."""
        left = self.remove(corpus, docs)
        if self.config.dedup:
            have = left.documents.filter("content <> ''").select(dedup.fast_hash(F.col("content")).alias("_hash")).distinct()
            docs = docs.withColumn("_hash", dedup.fast_hash(F.col("content"))).join(have, "_hash", "left_anti").drop("_hash")
        new = self.index(docs)
        parts = {n: getattr(left, n).unionByName(getattr(new, n), allowMissingColumns=True) for n in ("documents", "chunks", "vectors", "entities", "relations", "duplicates")}
        return Corpus(index=keyword.Index(left.index.docs.unionByName(new.index.docs), self.tokenizer), **parts)

    def load(self, spark: SparkSession, folder: str) -> Corpus:
        t = {n: spark.read.parquet(f"{folder}/{n}") for n in ("documents", "chunks", "vectors", "entities", "relations", "duplicates")}
        return Corpus(t["documents"], t["chunks"], keyword.load(spark, f"{folder}/index", self.tokenizer), t["vectors"], t["entities"], t["relations"], t["duplicates"])

    def search(self, corpus: Corpus, queries: DataFrame, mode: str = "hybrid", k: int | None = None, threshold: float | None = None, rerank_hits: bool = False) -> DataFrame:
        """(query_id, id, score, content, source, rank). mode: keyword, vector, graph, hybrid or auto.

        hybrid fuses keyword and vector. auto takes hybrid first and gives queries without a hit to vector, then to keyword, as far as the corpus has them.
        vector, graph and hybrid are an error for a corpus without vectors or entities.
        """
        k = k or self.config.top_k
        body = corpus.index.docs.select("id", "content")

        def by_keyword(q: DataFrame, n: int) -> DataFrame:
            return keyword.bm25(corpus.index, q, n).join(body, "id")

        def by_vector(q: DataFrame, n: int) -> DataFrame:
            return vector.knn(corpus.vectors, embed(q, "query", self.embedder), n).join(body, "id")

        def by_graph(q: DataFrame, n: int) -> DataFrame:
            hits = graph.retrieve(corpus.entities, corpus.relations, q).withColumnRenamed("document_id", "id")
            return keyword.top(hits, n).join(body.withColumn("id", F.col("id").cast("string")), "id")

        routes = {"keyword": by_keyword, "vector": by_vector, "graph": by_graph}
        needs = {"vector": corpus.vectors, "hybrid": corpus.vectors, "graph": corpus.entities}
        if mode in needs and needs[mode] is None:
            raise ValueError(f"this corpus has nothing to search for mode {mode}")
        if mode == "auto":
            names = ["hybrid", "vector", "keyword"] if corpus.vectors is not None else ["keyword"]
            steps = [lambda q, n, name=name: self.search(corpus, q, name, n).drop("source") for name in names]
            hits = fusion.cascade(queries, steps, k)
        elif mode == "hybrid":
            hits = fusion.hybrid(queries, {n: routes[n] for n in ("vector", "keyword")}, k, self.config.fusion, rrf_k=self.config.rrf_k)
        elif mode in routes:
            hits = routes[mode](queries, k)
        else:
            raise ValueError(f"no such mode: {mode}")
        if rerank_hits:
            hits = rerank.match(hits, queries, k)
        if threshold is not None:
            hits = fusion.above(hits, threshold)
        return hits.join(corpus.documents.select("id", "source"), "id", "left")

    def ask(self, corpus: Corpus, queries: DataFrame, generate=None, **options) -> DataFrame:
        """(query_id, answer) from a model over the assembled prompt, or the numbered results without one."""
        hits = self.search(corpus, queries, **options)
        if generate is None:
            return prompt.fallback_answer(queries, hits)
        return prompt.prompt(queries, hits).select("query_id", generated(F.col("prompt"), generate).alias("answer"))

    def index_batches(self, docs: DataFrame, folder: str, batches: int = 4, stop_on_error: bool = False, progress: Callable[[int, int], None] | None = None) -> tuple[DataFrame, DataFrame]:
        """Indexes docs in that many batches, each written under folder once it is done, and returns (report, errors).

        report (batch, total, succeeded, failed) has a line for each batch that ran; errors (id, error) has every document that has no id or no content. With
        stop_on_error the batch with the first error is the last. progress is called with the batches done and their number. Each batch is spread over all tasks.
        """
        spark = docs.sparkSession
        docs = cut(docs.withColumn("_batch", F.pmod(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit(""))), F.lit(batches))), "docs")
        lines, errors = [], None
        for i in range(batches):
            part = docs.filter(F.col("_batch") == i).drop("_batch")
            fine = valid_document()
            bad = part.filter(~fine).select(F.col("id").cast("string").alias("id"), F.when(F.coalesce(F.col("id").cast("string"), F.lit("")) == "", "no id").otherwise("no content").alias("error"))
            self.index(part.filter(fine)).save(f"{folder}/batch-{i:06d}")
            total, failed = part.count(), bad.count()
            lines.append((i, total, total - failed, failed))
            errors = bad if errors is None else errors.unionByName(bad)
            if progress:
                progress(i + 1, batches)
            if failed and stop_on_error:
                break
        return spark.createDataFrame(lines, "batch int, total long, succeeded long, failed long"), errors
