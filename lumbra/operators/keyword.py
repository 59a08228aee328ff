"""Keyword retrieval: an index of postings and the searches over it. All searches answer a table of queries at once."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumbra.functions import text as X
from lumbra.operators.sizes import in_parts, one_row, small
from lumbra.session import cut

K1, B = 1.2, 0.75
Tokenizer = Callable[[Column], Column]


@dataclass(frozen=True)
class Index:
    """docs (id, content, tokens, dl): everything else is derived from it, so nothing has to be kept in step. A stored index has its postings, vocabulary and sizes as tables too."""

    docs: DataFrame
    tokenizer: Tokenizer
    #: (term, id, tf, dl) in the order of terms, (term, df, cf), and one row of sizes
    stored: tuple[DataFrame, DataFrame, DataFrame] | None = None

    def words(self) -> DataFrame:
        """(id, dl, term) for each word of each document. An outer explode: for an inner one the planner would filter on the tokens' number and so make them twice."""
        return self.docs.select("id", "dl", F.explode_outer("tokens").alias("term")).filter("term is not null")

    def postings(self) -> DataFrame:
        """(term, id, tf, dl); counts are combined before the shuffle."""
        return self.stored[0] if self.stored else self.words().groupBy("term", "id", "dl").agg(F.count("*").alias("tf")).select("term", "id", "tf", "dl")

    def vocabulary(self) -> DataFrame:
        """(term, df, cf)"""
        return self.stored[1] if self.stored else self.postings().groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))

    def stats(self) -> DataFrame:
        """One row: documents, terms, tokens, average length."""
        if self.stored:
            return self.stored[2]
        sums = self.docs.agg(F.count("*").alias("documents"), F.sum("dl").cast("long").alias("tokens"))
        terms = self.words().agg(F.count_distinct("term").alias("terms"))
        whole = sums.join(one_row(terms), F.lit(True))
        return whole.select("documents", "terms", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(F.col("tokens") / F.col("documents"), F.lit(0.0)).alias("avgdl"))

    def add(self, docs: DataFrame) -> Index:
        """Upsert: rows of docs replace those with the same id."""
        new = index(docs, "id", "content", self.tokenizer).docs
        return Index(self.docs.join(new.select("id"), "id", "left_anti").unionByName(new), self.tokenizer)

    def remove(self, ids: DataFrame) -> Index:
        return Index(self.docs.join(ids.select("id"), "id", "left_anti"), self.tokenizer)

    def clear(self) -> Index:
        return Index(self.docs.limit(0), self.tokenizer)

    def store(self, folder: str) -> Index:
        """Written once as tables, tokenised once. Postings are sorted by term over range partitions: a search reads only the parts with its words."""
        spark = self.docs.sparkSession
        self.docs.write.mode("overwrite").parquet(f"{folder}/docs")
        plain = Index(spark.read.parquet(f"{folder}/docs"), self.tokenizer)
        plain.postings().repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{folder}/postings")
        posts = spark.read.parquet(f"{folder}/postings")
        posts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).write.mode("overwrite").parquet(f"{folder}/vocabulary")
        terms = spark.read.parquet(f"{folder}/vocabulary").agg(F.count("*").alias("terms"), F.sum("cf").alias("tokens"))
        sizes = plain.docs.agg(F.count("*").alias("documents")).join(one_row(terms), F.lit(True))
        sizes = sizes.select("documents", "terms", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(F.col("tokens") / F.col("documents"), F.lit(0.0)).alias("avgdl"))
        sizes.write.mode("overwrite").parquet(f"{folder}/sizes")
        return load(spark, folder, self.tokenizer)


def load(spark: SparkSession, folder: str, tokenizer: Tokenizer = X.han_tokens) -> Index:
    """The index that store() has written; queries have to be cut into words by the same tokenizer."""
    docs, posts, words, sizes = (spark.read.parquet(f"{folder}/{name}") for name in ("docs", "postings", "vocabulary", "sizes"))
    return Index(docs, tokenizer, (posts, words, sizes))


def latest(docs: DataFrame, order: str | None = None) -> DataFrame:
    """One row for each id: of rows with equal ids the one with the greatest order, then the greatest content. Rows without an id are left out.

    Repeated ids are looked up first, in the id column alone; only their rows move.
    """
    docs = docs.filter("id is not null")
    repeated = cut(docs.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id"), "repeated")
    if repeated.isEmpty():
        return docs
    key = F.struct(*([F.col(order)] if order else []), F.coalesce("content", F.lit("")))
    last = docs.join(repeated, "id", "left_semi").groupBy("id").agg(F.max_by(F.struct(*docs.columns), key).alias("row")).select("row.*")
    return docs.join(repeated, "id", "left_anti").unionByName(last)


def index(docs: DataFrame, id_col: str = "id", content: str = "content", tokenizer: Tokenizer = X.han_tokens, order: str | None = None) -> Index:
    """An index over id and content. Null contents are empty; of rows with equal ids the last in the order of the given column counts, then of contents."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(content), F.lit("")).alias("content"), *([F.col(order).alias("_order")] if order else []))
    rows = latest(rows, "_order" if order else None).select("id", "content").withColumn("tokens", tokenizer(F.col("content")))
    return Index(rows.withColumn("dl", F.size("tokens")), tokenizer)


def query_tokens(queries: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """(query_id, term, times): a word that a query repeats counts as often."""
    return queries.select("query_id", F.explode(tokenizer(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))


def top(scored: DataFrame, k: int | None, by: str = "score", order: str = "id") -> DataFrame:
    """Adds rank within query_id, best score first and ties by id, and keeps k. Each task first drops what can't be among the k.

    Scores are compared to nine decimals: the order in which a sum was made doesn't decide a tie.
    """
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.round(by, 9).desc(), F.col(order))))
    return ranked if k is None or k <= 0 else ranked.filter(F.col("rank") <= k)


#: Different words of all queries up to which they are sent to the scan as a list.
WORDS = 2000


def matching(ix: Index, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(term, id, tf, dl) of the words (term), and one row with n documents and their mean length avgdl.

    A stored index is read where the words are. Otherwise the corpus is tokenised once: each document leaves its length and the words that are asked for.
    """
    few = [r[0] for r in words.select("term").distinct().limit(WORDS + 1).collect()]
    if ix.stored:
        posts = ix.stored[0]
        posts = posts.filter(F.col("term").isin(few)) if len(few) <= WORDS else posts.join(words.select("term").distinct(), "term", "left_semi")
        return posts, ix.stored[2].select(F.col("documents").alias("n"), "avgdl")
    if len(few) <= WORDS:
        hits = F.filter("tokens", lambda t: t.isin(few)) if few else F.array().cast("array<string>")
        found = cut(ix.docs.select("id", "dl", hits.alias("hits")), "hits")
        posts = found.select("id", "dl", F.explode("hits").alias("term"))
        corpus = found
    else:
        posts, corpus = ix.words().join(words.select("term").distinct(), "term", "left_semi"), ix.docs
    posts = posts.groupBy("term", "id", "dl").agg(F.count("*").alias("tf"))
    return cut(posts, "postings"), corpus.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def scored(ix: Index, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, id, score, have, need): BM25 of every document with a word of the query, how many of its different words it has, and how many there are."""
    q = cut(query_tokens(queries, ix.tokenizer), "query words")
    posts, corpus = matching(ix, q)
    df = posts.groupBy("term").agg(F.count("*").alias("df"))
    weights = df.join(one_row(corpus), F.lit(True)).withColumn("idf", F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    need = q.groupBy("query_id").agg(F.count("*").alias("need"))
    weights = small(q.join(weights, "term").join(need, "query_id").select("query_id", "term", (F.col("idf") * F.col("times")).alias("w"), "avgdl", "need"))
    tf = F.col("tf")
    part = F.col("w") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return posts.join(weights, "term").groupBy("query_id", "id").agg(F.sum(part).alias("score"), F.count("*").alias("have"), F.max("need").alias("need"))


def bm25(ix: Index, queries: DataFrame, k: int | None = 10, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, id, score, rank) by BM25 with idf = ln((N - df + 0.5) / (df + 0.5)), which is negative for frequent terms."""
    return top(scored(ix, queries, k1, b).select("query_id", "id", "score"), k)


def conjunctive(ix: Index, queries: DataFrame, k: int | None = 10) -> DataFrame:
    """BM25 over the documents that have all of a query's words."""
    return top(scored(ix, queries).filter("have = need").select("query_id", "id", "score"), k)


def boolean(ix: Index, must: list[str] = (), should: list[str] = (), must_not: list[str] = (), k: int | None = 10) -> DataFrame:
    """(query_id '', id, score, rank). The words of a must term are alternatives, the terms all needed, base 1; each different matching word of
    a should term adds 0.5, and brings documents in only if nothing is a must; words of must_not exclude. Only must_not gives nothing.
    """
    has = lambda term: F.arrays_overlap("tokens", ix.tokenizer(F.lit(term)))
    needed = F.lit(True)
    for term in must:
        needed = needed & has(term)
    extra = F.lit(0.0)
    for term in should:
        words = ix.tokenizer(F.lit(term))
        extra = extra + F.lit(0.5) * F.size(F.filter(words, lambda w: F.array_contains(F.col("tokens"), w)))
    banned = F.lit(False)
    for term in must_not:
        banned = banned | has(term)
    found = ix.docs.filter(needed & ~banned).select(F.lit("").alias("query_id"), "id", (extra + F.lit(1.0 if must else 0.0)).alias("score"))
    return top(found if must else found.filter("score > 0"), k)


def strict_boolean(ix: Index, every: list[str] = (), some: list[str] = (), none: list[str] = ()) -> DataFrame:
    """(id): all of, any of, none of; a query of exclusions alone is allowed."""
    has = lambda term: F.arrays_overlap("tokens", ix.tokenizer(F.lit(term)))
    cond = F.lit(True)
    for t in every:
        cond = cond & has(t)
    if some:
        any_of = F.lit(False)
        for t in some:
            any_of = any_of | has(t)
        cond = cond & any_of
    for t in none:
        cond = cond & ~has(t)
    return ix.docs.filter(cond).select("id")


@in_parts
def phrase(ix: Index, queries: DataFrame, k: int | None = 10) -> DataFrame:
    """Documents that contain the phrase as text, whatever its case; the score is the phrase's number of words. Phrases without a word match nothing."""
    q = queries.withColumn("n", F.size(ix.tokenizer(F.col("query")))).filter("n > 0").select("query_id", F.lower("query").alias("p"), "n")
    met = ix.docs.select("id", F.lower("content").alias("c")).join(F.broadcast(q), F.expr("contains(c, p)"))
    return top(met.select("query_id", "id", F.col("n").cast("double").alias("score")), k)


@in_parts
def adjacent(ix: Index, queries: DataFrame, k: int | None = 10) -> DataFrame:
    """Documents in which the query's words follow each other; the score is how often."""
    q = (queries.select("query_id", F.concat(F.lit(" "), F.array_join(ix.tokenizer(F.col("query")), " "), F.lit(" ")).alias("p")).filter("length(p) > 2"))
    line = F.concat(F.lit(" "), F.array_join("tokens", "  "), F.lit(" "))
    met = ix.docs.select("id", line.alias("line")).join(F.broadcast(q.withColumn("p", F.regexp_replace(F.trim("p"), " ", "  "))), F.expr("contains(line, concat(' ', p, ' '))"))
    times = (F.length("line") - F.length(F.replace(F.col("line"), F.concat(F.lit(" "), F.col("p"), F.lit(" ")), F.lit("")))) / (F.length("p") + 2)
    return top(met.select("query_id", "id", times.alias("score")), k)


@in_parts
def prefix(ix: Index, queries: DataFrame, k: int | None = 10) -> DataFrame:
    """Documents with a word that begins with the lower-cased query; score 1, one row each."""
    q = F.broadcast((queries.select("query_id", F.lower("query").alias("p")).filter("p <> ''")))
    met = ix.docs.select("id", "tokens").join(q, F.expr("exists(tokens, t -> startswith(t, p))"))
    return top(met.select("query_id", "id", F.lit(1.0).alias("score")), k)


@in_parts
def fuzzy(ix: Index, queries: DataFrame, distance: int = 2, k: int | None = 10) -> DataFrame:
    """Adds 1 - d / longer length in bytes for each word of the query and each word of the document within the edit distance (over bytes).

    Words are compared on the vocabulary, once each, and only where their lengths allow; then postings join the matching words.
    """
    q = F.broadcast((query_tokens(queries, ix.tokenizer).withColumn("n", F.octet_length("term")).withColumnRenamed("term", "word")))
    words = ix.docs.select(F.explode(F.array_distinct("tokens")).alias("term")).distinct().withColumn("m", F.octet_length("term"))
    near = words.join(q, F.abs(F.col("m") - F.col("n")) <= distance).withColumn("d", X.byte_levenshtein(F.col("term"), F.col("word"), distance)).filter(F.col("d").between(0, distance))
    near = near.select("query_id", "term", (F.col("times") * (1 - F.col("d") / F.greatest("m", "n"))).alias("w"))
    posts = ix.docs.select("id", F.explode(F.array_distinct("tokens")).alias("term"))
    return top(posts.join(small(near), "term").groupBy("query_id", "id").agg(F.sum("w").alias("score")), k)


def trigram(docs: DataFrame, queries: DataFrame, id_col: str, content: str, threshold: float = 0.3, k: int | None = 10) -> DataFrame:
    """Similarity of trigram sets (shared by all) of at least the threshold; candidates share a trigram with the query."""
    d = docs.select(F.col(id_col).alias("id"), X.trigrams(F.col(content)).alias("g"))
    q = queries.select("query_id", X.trigrams(F.col("query")).alias("q")).filter(F.size("q") > 0)
    hits = d.select("id", F.size("g").alias("n"), F.explode("g").alias("t")).join(small(q.select("query_id", F.size("q").alias("m"), F.explode("q").alias("t"))), "t")
    hits = hits.groupBy("query_id", "id", "n", "m").agg(F.count("*").alias("both"))
    return top(hits.select("query_id", "id", (F.col("both") / (F.col("n") + F.col("m") - F.col("both"))).alias("score")).filter(F.col("score") >= threshold), k)


@in_parts
def like(docs: DataFrame, queries: DataFrame, id_col: str, columns: list[str], escape: bool = True, start: bool = False) -> DataFrame:
    """(query_id, id, score 1): one of the columns contains (or begins with) the query, whatever its case; % and _ are plain signs unless escape is off."""
    pattern = F.regexp_replace("query", r"([%_\\])", r"\\$1") if escape else F.col("query")
    q = F.broadcast((queries.filter("query <> ''").select("query_id", F.concat(F.lit("" if start else "%"), pattern, F.lit("%")).alias("p"))))
    cond = " OR ".join(f"coalesce(`{c}`, '') ILIKE p" for c in columns)
    return docs.join(q, F.expr(cond)).select("query_id", F.col(id_col).alias("id"), F.lit(1.0).alias("score"))


def web_query(query: str) -> dict[str, list[str]]:
    """Parts of a query as people type it: "phrases", words, alternatives joined by OR, exclusions after a minus."""
    out: dict[str, list[str]] = {"phrases": [], "every": [], "some": [], "none": []}
    parts = re.findall(r'(-?)"([^"]+)"|(\S+)', query)
    words = [("-" if neg else "") + f'"{p}"' if p else w for neg, p, w in parts]
    i = 0
    while i < len(words):
        w = words[i]
        if i + 1 < len(words) and words[i + 1].upper() == "OR" and i + 2 < len(words):
            out["some"] += [w.strip('"')] if w.strip('"') not in out["some"] else []
            out["some"].append(words[i + 2].strip('"'))
            i += 2
            if not (i + 1 < len(words) and words[i + 1].upper() == "OR"):
                i += 1
            continue
        if w.upper() != "OR":
            if w.startswith("-") and len(w) > 1:
                out["none"].append(w[1:].strip('"'))
            elif w.startswith('"'):
                out["phrases"].append(w.strip('"'))
            else:
                out["every"].append(w)
        i += 1
    return out


def web_search(ix: Index, query: str) -> DataFrame:
    """(id): documents that satisfy a query in web syntax."""
    q = web_query(query)
    hits = strict_boolean(Index(_with_phrases(ix, q["phrases"]), ix.tokenizer), q["every"], q["some"], q["none"])
    return hits


def _with_phrases(ix: Index, phrases: list[str]) -> DataFrame:
    docs = ix.docs
    for p in phrases:
        docs = docs.filter(F.lower("content").contains(p.lower()))
    return docs


def advanced(ix: Index, query: str, kind: str = "plain", k: int | None = 10) -> DataFrame:
    """(query_id, id, score, rank) by kind: plain, phrase, web, prefix or fuzzy."""
    one = ix.docs.sparkSession.createDataFrame([("", query)], "query_id string, query string")
    if kind == "web":
        return top(web_search(ix, query).select(F.lit("").alias("query_id"), "id", F.lit(1.0).alias("score")), k)
    kinds = {"plain": conjunctive, "phrase": adjacent, "prefix": prefix, "fuzzy": fuzzy}
    return kinds[kind](ix, one, k=k)


def contains(docs: DataFrame, needle: str, columns: list[str]) -> DataFrame:
    """Rows of which a column contains the needle, whatever its case; an empty needle matches nothing."""
    if not needle:
        return docs.limit(0)
    cond = F.lit(False)
    for c in columns:
        cond = cond | F.coalesce(F.lower(c).contains(needle.lower()), F.lit(False))
    return docs.filter(cond)


def first_chunks(docs: DataFrame, chunks: DataFrame, needle: str, limit: int, doc_id: str = "id") -> DataFrame:
    """Documents left-joined with their chunks where either contains the needle; limit rows first, then the first chunk of each document."""
    c = chunks.select(F.col("document_id").alias("_doc"), F.col("id").alias("chunk_id"), F.col("content").alias("chunk_content"), "chunk_index")
    met = docs.join(c, docs[doc_id] == c["_doc"], "left")
    hit = F.coalesce(F.lower("content").contains(needle.lower()), F.lit(False)) | F.coalesce(F.lower("chunk_content").contains(needle.lower()), F.lit(False))
    some = met.filter(hit).select(F.col(doc_id).alias("id"), "chunk_id", "chunk_index").orderBy("id", "chunk_index", "chunk_id").limit(limit)
    first = Window.partitionBy("id").orderBy("chunk_index", "chunk_id")
    return some.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
