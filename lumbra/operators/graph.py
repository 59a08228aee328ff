"""Property graph: extraction by rule, search, neighbourhoods and paths.

entities: id, name, type, aliases, source_doc_id, confidence. relations: id, source_id, target_id, type, source_doc_id, confidence.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumbra.functions import text as X
from lumbra.functions.generate import generated
from lumbra.operators.sizes import in_parts, small
from lumbra.schema import stable_id
from lumbra.session import cut

# Signs around named things, with the type they tell.
QUOTED = ((r"「(.+?)」", "CONCEPT"), (r'"(.+?)"', "CONCEPT"), (r"《(.+?)》", "PRODUCT"), (r"【(.+?)】", "CONCEPT"))
# Fixed value: runs of capitalised words.
CAPITALS = r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)"
# Chinese words that are no names.
COMMON = "这个 那个 什么 怎么 为什么 可以 已经 因为 所以 但是 如果 虽然 就是 不是 一个 我们 他们 自己 没有 知道 技术 方法 系统 问题 进行".split()
# Relation patterns. The lazy second part takes one character.
RELATIONS = (
    (r"(\S+?)(?:位于|在)(\S+?)", "LOCATED_IN"),
    (r"(\S+?)(?:属于|是)(\S+?)(?:的一部分|的)", "PART_OF"),
    (r"(\S+?)(?:使用|采用|利用)(\S+?)", "USES"),
    (r"(\S+?)(?:生产|产出|制造|开发)(?:了|出)?(\S+?)", "PRODUCES"),
)
# Other words for the entity and relation types.
ENTITY_SYNONYMS = {
    "ORG": "ORGANIZATION", "COMPANY": "ORGANIZATION", "PLACE": "LOCATION", "CITY": "LOCATION", "COUNTRY": "LOCATION", "TIME": "DATE", "SOFTWARE": "PRODUCT", "TOOL": "PRODUCT",
    "METHOD": "CONCEPT", "THEORY": "CONCEPT", "TECH": "TECHNOLOGY", "LANGUAGE": "TECHNOLOGY", "FRAMEWORK": "TECHNOLOGY", "FIELD": "INDUSTRY", "DOMAIN": "INDUSTRY",
}
RELATION_SYNONYMS = {
    "WORK_FOR": "WORKS_FOR", "LOCATE_IN": "LOCATED_IN", "FOUND_BY": "FOUNDED_BY", "RELATED": "RELATED_TO", "USE": "USES", "PRODUCE": "PRODUCES", "COMPETE_WITH": "COMPETES_WITH",
    "INVEST_IN": "INVESTED_IN", "ACQUIRE": "ACQUIRED", "PARTNER_WITH": "PARTNERED_WITH",
}


def _typed(value: Column, known: tuple[str, ...], synonyms: dict[str, str], default: str) -> Column:
    v = F.upper(F.trim(value))
    pairs = {**{k: k for k in known}, **synonyms}
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), v), F.lit(default))


def entity_type(value: Column) -> Column:
    from lumbra.schema import ENTITY_TYPES

    return _typed(value, ENTITY_TYPES, ENTITY_SYNONYMS, "CONCEPT")


def relation_type(value: Column) -> Column:
    from lumbra.schema import RELATION_TYPES

    return _typed(value, RELATION_TYPES, RELATION_SYNONYMS, "RELATED_TO")


#: Words of a dictionary that one pass over the texts looks for; the automaton of a block takes some tens of megabytes.
WORDS = 100_000


def _dictionaries(dictionary: DataFrame) -> Iterator[list[tuple[str, str]]]:
    words = dictionary.filter("word is not null and word <> ''").groupBy(F.lower("word").alias("name")).agg(F.min("type").alias("type"))
    parts = -(-words.count() // WORDS)
    for i in range(parts):
        yield [(r[0], r[1]) for r in words.filter(F.pmod(F.xxhash64("name"), F.lit(parts)) == i).collect()]


def _named(shared) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = ahocorasick.Automaton()
        for name, kind in shared.value:
            automaton.add_word(name, (name, kind))
        automaton.make_automaton()
        for b in batches:
            rows = [(d, *x) for d, t in zip(b["doc_id"], b["text"], strict=True) for x in sorted({v for _, v in automaton.iter(t)})]
            yield pd.DataFrame(rows, columns=["doc_id", "name", "type"])

    return run


def extract_entities(docs: DataFrame, id_col: str = "id", content: str = "content", dictionary: DataFrame | None = None, han: bool = True) -> DataFrame:
    """(doc_id, name, type, confidence), one row for each name of a document whatever its case, from the first rule that finds it.

    Rules in order: words of a dictionary (word, type) that the text contains, 0.9; quoted names of 2 to 50 bytes, 0.7; runs of
    capitalised words, ORGANIZATION, 0.6; runs of 2 to 4 Han characters at the edge of Han text, PERSON, 0.4. The dictionary is
    looked up by an automaton, in blocks of WORDS words with one pass over the texts each.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(content), F.lit("")).alias("text"))
    found = []

    def rule(pattern: str, kind: str, confidence: float, order: int) -> Column:
        names = F.transform(F.regexp_extract_all("text", F.lit(pattern), 1), X.trim)
        return F.transform(names, lambda n, i: F.struct(n.alias("name"), F.lit(kind).alias("type"), F.lit(confidence).alias("confidence"), F.lit(order).alias("rule"), i.alias("at")))

    for i, (pattern, kind) in enumerate(QUOTED):
        found.append(F.filter(rule(pattern, kind, 0.7, 1 + i), lambda x: (F.octet_length(x["name"]) > 1) & (F.octet_length(x["name"]) <= 50)))
    found.append(F.filter(rule(CAPITALS, "ORGANIZATION", 0.6, 9), lambda x: F.octet_length(x["name"]) > 2))
    if han:
        edge = F.flatten(
            F.transform(
                F.regexp_extract_all("text", F.lit(r"(\p{IsHan}{2,})"), 1),
                lambda r: F.concat(
                    F.transform(F.sequence(F.lit(2), F.least(F.lit(4), F.length(r))), lambda n: F.substring(r, F.lit(1), n)),
                    F.transform(F.sequence(F.lit(2), F.least(F.lit(4), F.length(r))), lambda n: F.substring(r, F.length(r) - n + 1, n)),
                ),
            )
        )
        names = F.filter(edge, lambda n: ~n.isin(*COMMON))
        found.append(F.transform(names, lambda n, i: F.struct(n.alias("name"), F.lit("PERSON").alias("type"), F.lit(0.4).alias("confidence"), F.lit(10).alias("rule"), i.alias("at"))))
    out = rows.select("doc_id", F.explode(F.concat(*found)).alias("x")).select("doc_id", "x.*")
    if dictionary is not None:
        for block in _dictionaries(dictionary):
            found = rows.mapInPandas(_named(rows.sparkSession.sparkContext.broadcast(block)), f"doc_id {dict(rows.dtypes)['doc_id']}, name string, type string")
            out = out.unionByName(found.select("doc_id", "name", "type", F.lit(0.9).alias("confidence"), F.lit(0).alias("rule"), F.lit(0).alias("at")))
    best = F.min(F.struct("rule", "at", "name", "type", "confidence")).alias("x")
    return out.groupBy("doc_id", F.lower("name").alias("key")).agg(best).select("doc_id", "x.name", "x.type", "x.confidence", "x.rule", "x.at")


def extract_relations(docs: DataFrame, entities: DataFrame, id_col: str = "id", content: str = "content") -> DataFrame:
    """(doc_id, source, target, type, confidence 0.5): patterns whose two parts are contained in names of different entities of the document, of each the first one."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(content), F.lit("")).alias("text"))

    # within a run without white space every match begins where the one before ended, so one scan finds them all
    runs = F.split("text", r"\s+")

    def matches(pattern: str, kind: str) -> Column:
        part = lambda r, i: F.regexp_extract_all(r, F.lit(r"\G" + pattern), i)
        in_run = lambda r: F.zip_with(part(r, 1), part(r, 2), lambda s, t: F.struct(s.alias("s"), t.alias("t"), F.lit(kind).alias("type")))
        return F.flatten(F.transform(runs, in_run))

    hits = [matches(pattern, kind) for pattern, kind in RELATIONS]
    names = entities.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rule", "at", "name"))), lambda x: x["name"]).alias("names"))
    found = rows.select("doc_id", F.explode(F.concat(*hits)).alias("p")).join(names, "doc_id")
    pick = lambda c: F.try_element_at(F.filter("names", lambda n: F.contains(n, F.col(c))), F.lit(1))
    out = found.select("doc_id", pick("p.s").alias("source"), pick("p.t").alias("target"), F.col("p.type").alias("type"), F.lit(0.5).alias("confidence"))
    return out.filter("source is not null and target is not null and source <> target")


def build(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and relations of chunks (id, document_id, content) with stable ids; entities are distinct within a chunk."""
    found = extract_entities(chunks)
    tagged = found.join(chunks.select(F.col("id").alias("doc_id"), "document_id"), "doc_id")
    entities = tagged.select(stable_id("doc_id", "name").alias("id"), "name", "type", F.array().cast("array<string>").alias("aliases"), F.col("document_id").alias("source_doc_id"), "confidence")
    rel = extract_relations(chunks, found).join(chunks.select(F.col("id").alias("doc_id"), "document_id"), "doc_id")
    relations = rel.select(stable_id("doc_id", "source", "target", "type").alias("id"), stable_id("doc_id", "source").alias("source_id"), stable_id("doc_id", "target").alias("target_id"), "type", F.col("document_id").alias("source_doc_id"), "confidence")
    return entities, relations


def parse_extraction(answers: DataFrame) -> DataFrame:
    """(doc_id, kind, name, type, source, target) from a model's answers (doc_id, answer): the first JSON object between matching braces, types by their synonyms, relations to unknown names dropped."""

    def parse(text: str) -> dict | None:
        start = (text or "").find("{")
        while start >= 0:
            try:
                value, _ = json.JSONDecoder().raw_decode(text[start:])
                return value if isinstance(value, dict) else None
            except json.JSONDecodeError:
                start = text.find("{", start + 1)
        return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, answer in zip(b["doc_id"], b["answer"], strict=True):
                value = parse(answer) or {}
                names = set()
                for e in value.get("entities") or []:
                    if isinstance(e, dict) and e.get("name"):
                        names.add(e["name"])
                        rows.append((doc, "entity", e["name"], str(e.get("type") or ""), None, None))
                for r in value.get("relations") or []:
                    if isinstance(r, dict) and r.get("source") in names and r.get("target") in names:
                        rows.append((doc, "relation", None, str(r.get("type") or r.get("relation") or ""), r["source"], r["target"]))
            yield pd.DataFrame(rows, columns=["doc_id", "kind", "name", "type", "source", "target"])

    kind = dict(answers.dtypes)["doc_id"]
    out = answers.select("doc_id", "answer").mapInPandas(run, f"doc_id {kind}, kind string, name string, type string, source string, target string")
    return out.withColumn("type", F.when(F.col("kind") == "entity", entity_type(F.col("type"))).otherwise(relation_type(F.col("type"))))


def llm_extract(docs: DataFrame, generate: Callable[[str], str], id_col: str = "id", content: str = "content", tries: int = 3) -> DataFrame:
    """Extraction by an injected model; an answer without an object is asked for again, up to tries times."""

    ask = F.concat(F.lit("Extract entities and relations as JSON with the keys entities (name, type) and relations (source, target, type).\n\n"), F.coalesce(F.col(content), F.lit("")))
    answer = generated(ask, generate, tries, lambda a: re.search(r"\{.*\}", a, re.S) is not None)
    return parse_extraction(docs.select(F.col(id_col).alias("doc_id"), answer.alias("answer")))


def upsert(table: DataFrame, new: DataFrame) -> DataFrame:
    """Entities or relations with the new rows in place of those with the same id; of several new rows of an id the greatest in all columns counts."""
    last = new.groupBy("id").agg(F.max(F.struct(*[c for c in new.columns if c != "id"])).alias("x")).select("id", "x.*")
    return table.join(last.select("id"), "id", "left_anti").unionByName(last, allowMissingColumns=True)


def get(table: DataFrame, ids: DataFrame) -> DataFrame:
    """The entities or relations of these ids."""
    return table.join(ids.select("id").distinct(), "id", "left_semi")


@in_parts
def search(entities: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """(query_id, id, exact, rank): entities one of whose names is the query, whatever the case, then those whose name contains it or is contained in it."""
    names = F.concat(F.array(F.lower("name")), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), F.lower))
    e = entities.select("id", F.lower("name").alias("n"), F.filter(names, lambda x: x.isNotNull() & (x != "")).alias("names"))
    q = F.broadcast(queries.select("query_id", F.lower("query").alias("q")).filter("q <> ''"))
    met = e.join(q, F.expr("array_contains(names, q) OR contains(n, q) OR (n <> '' AND contains(q, n))"))
    met = met.select("query_id", "id", F.expr("array_contains(names, q)").alias("exact")).groupBy("query_id", "id").agg(F.max("exact").alias("exact"))
    order = Window.partitionBy("query_id").orderBy(F.col("exact").desc(), "id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def edges(relations: DataFrame) -> DataFrame:
    """(a, b, relation_id, type): every relation from both ends; one that joins an entity with itself once."""
    out = relations.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), F.col("id").alias("relation_id"), "type")
    return out.unionByName(out.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "relation_id", "type"))


def incident(relations: DataFrame, ids: DataFrame, kind: str | None = None) -> DataFrame:
    """(entity_id, relation_id): relations that begin or end at the entities, of one type if given."""
    e = edges(relations) if kind is None else edges(relations.filter(F.col("type") == kind))
    return e.join(small(ids.select(F.col("id").alias("a")).distinct()), "a").select(F.col("a").alias("entity_id"), "relation_id")


def subgraph(entities: DataFrame, relations: DataFrame, seeds: DataFrame, depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """(seed_id, id, level) and (seed_id, relation_id): depth levels of entities from each seed, itself level 0, and all relations at them.

    The far ends of the last level's relations aren't part of it. Each level is one join along the edges and is written to the shared folder.
    """
    e = cut(edges(relations), "edges")
    known = entities.select("id")
    frontier = seeds.select(F.col("id").alias("seed_id"), "id").join(known, "id", "left_semi").select("seed_id", "id", F.lit(0).alias("level")).distinct()
    nodes = frontier = cut(frontier, "level")
    for level in range(1, depth):
        step = frontier.join(e, frontier["id"] == e["a"]).select("seed_id", F.col("b").alias("id")).distinct()
        frontier = cut(step.join(known, "id", "left_semi").join(nodes, ["seed_id", "id"], "left_anti").select("seed_id", "id", F.lit(level).alias("level")), "level")
        nodes = nodes.unionByName(frontier)
    near = nodes.join(e, nodes["id"] == e["a"]).select("seed_id", "relation_id").distinct()
    return nodes, near


def paths(relations: DataFrame, pairs: DataFrame, most: int = 5) -> DataFrame:
    """(source, target, nodes, edges, length): all paths without a repeated entity from source to target of at most so many relations, either way.

    nodes leaves out the target. Equal ends have no path. A step is only taken to entities from which the target can still be reached in the
    steps that are left, which a search from the target finds first; however many sources ask for a target, it is searched from once.
    """
    e = cut(edges(relations).filter("a <> b").select("a", "b", "relation_id"), "edges")
    want = pairs.select("source", "target").filter("source <> target").distinct()
    reach = far = cut(want.select("target", F.col("target").alias("node"), F.lit(0).alias("left")).distinct(), "reach")
    for n in range(1, most):
        step = far.join(e, far["node"] == e["a"]).select("target", F.col("b").alias("node")).distinct()
        far = cut(step.join(reach, ["target", "node"], "left_anti").withColumn("left", F.lit(n)), "reach")
        reach = reach.unionByName(far)
    at = want.select("source", "target", F.col("source").alias("node"), F.array("source").alias("nodes"), F.array().cast("array<string>").alias("edges"))
    at, done = cut(at, "paths"), None
    for n in range(1, most + 1):
        step = at.join(e, at["node"] == e["a"]).filter(~F.array_contains("nodes", F.col("b")))
        step = step.select("source", "target", F.col("b").alias("node"), "nodes", F.concat("edges", F.array("relation_id")).alias("edges"))
        here = step.filter("node = target").select("source", "target", "nodes", "edges", F.lit(n).alias("length"))
        done = here if done is None else done.unionByName(here)
        if n < most:
            on = step.filter("node <> target").join(reach.filter(F.col("left") <= most - n), ["target", "node"], "left_semi")
            at = cut(on.select("source", "target", "node", F.concat("nodes", F.array("node")).alias("nodes"), "edges"), "paths")
    return done


def delete_document(entities: DataFrame, relations: DataFrame, document: str, cascade: bool = True) -> tuple[DataFrame, DataFrame]:
    """Without the document's entities and relations, and with cascade without relations to the entities that went."""
    gone = F.coalesce(F.col("source_doc_id") == document, F.lit(False))
    e, r = entities.filter(~gone), relations.filter(~gone)
    if cascade:
        ids = entities.filter(gone).select("id")
        r = r.join(ids.select(F.col("id").alias("source_id")), "source_id", "left_anti").join(ids.select(F.col("id").alias("target_id")), "target_id", "left_anti")
    return e, r


def retrieve(entities: DataFrame, relations: DataFrame, queries: DataFrame, seeds: int = 5, depth: int = 2) -> DataFrame:
    """(query_id, document_id, score): the documents of the entities around the first seeds found, with the best confidence."""
    hits = cut(search(entities, queries, seeds), "seeds")
    nodes, _ = subgraph(entities, relations, hits.select("id").distinct(), depth)
    met = hits.select("query_id", F.col("id").alias("seed_id")).join(nodes, "seed_id").select("query_id", "id").distinct().join(entities.select("id", "source_doc_id", "confidence"), "id")
    return met.filter("source_doc_id is not null").groupBy("query_id", F.col("source_doc_id").alias("document_id")).agg(F.max("confidence").alias("score"))


def answer(entities: DataFrame, relations: DataFrame, queries: DataFrame, seeds: int = 5, depth: int = 2) -> DataFrame:
    """(query_id, entities, relations, answer): how much of the graph lies around the entities that a query names, and their names in a sentence."""
    hits = cut(search(entities, queries, seeds), "seeds")
    nodes, near = subgraph(entities, relations, hits.select("id").distinct(), depth)
    seed = hits.select("query_id", F.col("id").alias("seed_id"))
    size = seed.join(nodes, "seed_id").groupBy("query_id").agg(F.count_distinct("id").alias("entities"))
    links = seed.join(near, "seed_id").groupBy("query_id").agg(F.count_distinct("relation_id").alias("relations"))
    names = hits.join(entities.select("id", "name"), "id").groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]), ", ").alias("names"))
    met = queries.select("query_id").join(size, "query_id", "left").join(links, "query_id", "left").join(names, "query_id", "left").fillna(0, ["entities", "relations"])
    text = F.when(F.col("names").isNull(), F.lit("No entity found.")).otherwise(F.format_string("%s: %d entities and %d relations around.", "names", "entities", "relations"))
    return met.select("query_id", "entities", "relations", text.alias("answer"))


def counts(entities: DataFrame, relations: DataFrame) -> DataFrame:
    return entities.agg(F.count("*").alias("entities")).join(F.broadcast(relations.agg(F.count("*").alias("relations"))), F.lit(True))
