"""SQL for DuckDB of the catalogue's queries, stated independently of their Spark code. A query without an entry runs a state machine, a model, or a search with a measured recall."""

from __future__ import annotations

from lumbra.functions.text import ENTITIES
from lumbra.operators.fusion import FACTUAL, SEMANTIC
from lumbra.operators.graph import COMMON
from lumbra.plans import catalogue as C

SQL: dict[str, str] = {}
#: White space of all scripts, for an engine whose \s is that of ASCII.
WS = r"[\s\x0b\x{85}\p{Z}]"


def _rows(rows: list, names: str) -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows) + f") AS _v({names}))"


def _q(rows: list) -> str:
    return _rows(rows, "query_id, query")


def simple(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}]+')"


def han(x: str) -> str:
    """Spaces around each Han character make it a run by itself."""
    return rf"regexp_extract_all(regexp_replace(lower({x}), '(\p{{Han}})', ' \1 ', 'g'), '[\p{{L}}\p{{N}}]+')"


def trim(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^{WS}+', ''), '{WS}+$', '')"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w: w <> '')"


def space_tokens(x: str) -> str:
    edge = r"[.,!?;:\"''()\[\]{}<>]+"
    return f"list_filter(list_transform(regexp_split_to_array(lower({x}), '{WS}+'), lambda w: regexp_replace(regexp_replace(w, '^{edge}', ''), '{edge}$', '')), lambda w: w <> '')"


def _docs(text: str = "coalesce(text, '')", tok=han) -> str:
    return f"d AS (SELECT doc_id AS id, {text} AS content, {tok(text)} AS tokens, len({tok(text)}) AS dl FROM documents)"


def _top(k: int | None, by: str = "score") -> str:
    keep = f" WHERE rank <= {k}" if k else ""
    return f"r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round({by}, 9) DESC, id) AS rank FROM s) SELECT query_id, id, round(score, 5) AS score, rank FROM r{keep}"


POSTINGS = "p AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, dl, unnest(tokens) AS term FROM d) GROUP BY ALL)"
QT = f"q AS {_q(C.QUERIES)}, qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({han('query')}) AS term FROM q) GROUP BY ALL)"
BM25 = (
    "c AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM d), df AS (SELECT term, count(*) AS df FROM p GROUP BY term), "
    "s AS (SELECT query_id, id, sum(times * ln((n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM qt JOIN p USING (term) JOIN df USING (term), c GROUP BY ALL)"
)
SCORED = f"WITH {_docs()}, {POSTINGS}, {QT}, {BM25}"

SQL["token_stats"] = f"WITH {_docs()} SELECT count(*) AS documents, (SELECT count(DISTINCT t) FROM (SELECT unnest(tokens) AS t FROM d)) AS terms, CAST(sum(dl) AS BIGINT) AS tokens, round(sum(dl) / count(*), 6) AS avgdl FROM d"
SQL["vocabulary_df"] = f"WITH {_docs(tok=simple)}, {POSTINGS} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM p GROUP BY term"
SQL["bm25_topk"] = f"{SCORED}, {_top(10)}"
WHOLE = "CASE WHEN title IS NULL AND content IS NULL THEN '' ELSE concat_ws(' ', title, content) END"
SQL["bm25_title_content"] = (
    f"WITH {_docs(WHOLE)}, {POSTINGS}, {QT}, {BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s) "
    "SELECT query_id, r.id, round(score, 5) AS score, rank, CASE WHEN length(content) > 500 THEN substr(content, 1, 500) || '...' ELSE content END AS content FROM r JOIN d ON r.id = d.id WHERE rank <= 5"
)
SQL["bm25_chunks"] = (
    f"WITH k AS (SELECT id, max(content) AS content, max(document_id) AS document_id FROM chunks GROUP BY id), d AS (SELECT id, {han('content')} AS tokens, len({han('content')}) AS dl, document_id FROM k), {POSTINGS}, {QT}, {BM25}, "
    "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s) SELECT query_id, r.id AS chunk_id, document_id, round(score, 5) AS score, rank FROM r JOIN k ON r.id = k.id WHERE rank <= 10"
)
SQL["fts_conjunctive"] = (
    SCORED.replace(", s AS", ", s0 AS") + ", need AS (SELECT query_id, count(*) AS need FROM qt GROUP BY ALL), have AS (SELECT query_id, id, count(*) AS have FROM qt JOIN p USING (term) GROUP BY ALL), "
    f"s AS (SELECT s0.* FROM s0 JOIN have USING (query_id, id) JOIN need USING (query_id) WHERE have = need), {_top(10)}"
)
_has = lambda *ts: "(" + " OR ".join(f"list_contains(tokens, '{t}')" for t in ts) + ")"
SQL["boolean_search"] = (
    f"WITH {_docs()}, s AS (SELECT '' AS query_id, id, 1.0::DOUBLE + 0.5::DOUBLE * ({' + '.join(f'CAST({_has(t)} AS INT)' for t in ('latency', 'snapshot', 'policy'))}) AS score FROM d WHERE {_has('vector', 'index')} AND {_has('the')} AND NOT {_has('ledger')}), "
    + _top(50).replace("SELECT query_id, id,", "SELECT id,")
)
SQL["boolean_should_only"] = (
    f"WITH {_docs()}, s0 AS (SELECT '' AS query_id, id, 0.5::DOUBLE * ({' + '.join(f'CAST({_has(t)} AS INT)' for t in ('latency', 'snapshot', 'policy'))}) AS score FROM d WHERE NOT {_has('vector')}), s AS (SELECT * FROM s0 WHERE score > 0), "
    + _top(50).replace("SELECT query_id, id,", "SELECT id,")
)
SQL["boolean_strict"] = f"WITH {_docs()} SELECT id FROM d WHERE {_has('the')} AND {_has('ledger', 'archive')} AND NOT {_has('vector')}"
SQL["boolean_negation"] = f"WITH {_docs()} SELECT id FROM d WHERE NOT {_has('the', 'der')}"
SQL["phrase_search"] = f"WITH {_docs()}, q AS {_q(C.PHRASES)}, s AS (SELECT query_id, id, CAST(len({han('query')}) AS DOUBLE) AS score FROM d JOIN q ON contains(lower(content), lower(query))), {_top(None)}"
SQL["phrase_adjacent"] = (
    f"WITH {_docs()}, q AS (SELECT query_id, {han('query')} AS w FROM {_q(C.PHRASES)}), "
    "h AS (SELECT query_id, id, tokens, w, unnest(range(1, len(tokens) - len(w) + 2)) AS i FROM d JOIN q ON list_has_all(tokens, w)), "
    f"s AS (SELECT query_id, id, CAST(count(*) AS DOUBLE) AS score FROM h WHERE tokens[i:i + len(w) - 1] = w GROUP BY ALL), {_top(None)}"
)
SQL["prefix_search"] = f"WITH {_docs()}, q AS {_q(C.PREFIXES)}, s AS (SELECT query_id, id, 1.0::DOUBLE AS score FROM d JOIN q ON len(list_filter(tokens, lambda t: starts_with(t, lower(query)))) > 0), {_top(None)}"
SQL["content_prefix"] = f"SELECT query_id, doc_id AS id, 1.0::DOUBLE AS score FROM documents JOIN {_q([('c1', 'the '), ('c2', '# '), ('c3', '若')])} ON starts_with(lower(coalesce(content, '')), lower(query))"
SQL["fuzzy_search"] = (
    f"WITH {_docs()}, q AS (SELECT query_id, unnest({han('query')}) AS word FROM {_q(C.FUZZY)}), v AS (SELECT DISTINCT id, unnest(tokens) AS term FROM d), t AS (SELECT DISTINCT term FROM v), "
    "n AS (SELECT query_id, term, 1 - levenshtein(word, term) / greatest(octet_length(encode(word)), octet_length(encode(term))) AS w FROM q, t WHERE levenshtein(word, term) <= 2), "
    f"s AS (SELECT query_id, id, sum(w) AS score FROM v JOIN n USING (term) GROUP BY ALL), {_top(20)}"
)
_grams = lambda x: f"list_distinct(flatten(list_transform({simple(x)}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
SQL["trigram_similarity"] = (
    f"WITH e AS (SELECT id, max(name) AS name FROM entities GROUP BY id), x AS (SELECT query_id, id, {_grams('name')} AS g, {_grams('query')} AS h FROM e, {_q(C.NAMES)}), "
    f"s AS (SELECT query_id, id, len(list_intersect(g, h)) / (len(g) + len(h) - len(list_intersect(g, h))) AS score FROM x WHERE len(list_intersect(g, h)) / (len(g) + len(h) - len(list_intersect(g, h))) >= 0.3), {_top(None)}"
)
SQL["ilike_search"] = f"SELECT query_id, doc_id AS id, 1.0::DOUBLE AS score FROM documents JOIN {_q(C.NEEDLES)} ON contains(lower(coalesce(title, '')), lower(query)) OR contains(lower(coalesce(content, '')), lower(query))"
SQL["contains_search"] = "SELECT doc_id FROM documents WHERE lower(coalesce(title, '')) LIKE '%ledger%' OR lower(coalesce(content, '')) LIKE '%ledger%'"
SQL["first_chunk_search"] = (
    "WITH c AS (SELECT DISTINCT * FROM chunks), m AS (SELECT doc_id AS id, c.id AS chunk_id, chunk_index FROM documents d LEFT JOIN c ON d.doc_id = c.document_id "
    "WHERE lower(coalesce(d.content, '')) LIKE '%ledger%' OR lower(coalesce(c.content, '')) LIKE '%ledger%' ORDER BY doc_id, chunk_index NULLS FIRST, chunk_id NULLS FIRST LIMIT 200) "
    "SELECT id, chunk_id, chunk_index FROM m QUALIFY row_number() OVER (PARTITION BY id ORDER BY chunk_index NULLS FIRST, chunk_id) = 1"
)
SQL["web_search"] = f"WITH {_docs()} SELECT id FROM d WHERE contains(lower(content), 'the vector') AND {_has('archive', 'ledger')} AND NOT {_has('budget')}"
_hl = "title"
for _w in ("report", "plan", "é", "notes"):
    _hl = f"replace({_hl}, '{_w}', '**{_w}**')"
SQL["highlight"] = f"SELECT doc_id, {_hl} AS marked FROM documents"
SQL["clean_query"] = "SELECT doc_id, " + trim(r"regexp_replace(translate(title, '*^(){}[]:;~\"', '            '), '\s+', ' ', 'g')").replace('\\"', '"') + " AS cleaned FROM documents"
SQL["index_upsert"] = (
    f"WITH u AS (SELECT doc_id, CASE WHEN lang = 'de' THEN coalesce(title, '') ELSE coalesce(text, '') END AS content FROM documents WHERE lang IS DISTINCT FROM 'fr'), d AS (SELECT {han('content')} AS tokens FROM u) "
    "SELECT count(*) AS documents, (SELECT count(DISTINCT t) FROM (SELECT unnest(tokens) AS t FROM d)) AS terms, CAST(sum(len(tokens)) AS BIGINT) AS tokens FROM d"
)

# Chunkers in closed form.
_window = lambda starts, size, extra="": (
    f"WITH n AS (SELECT doc_id, content, length(content) AS l FROM documents WHERE length(content) > 0), w AS (SELECT doc_id, content, l, unnest({starts}) AS i FROM n), "
    f"x AS (SELECT doc_id, content, i AS chunk_index, {extra or f'i * {size[1]}'} AS start_pos, l, {size[0]} AS size FROM w), y AS (SELECT doc_id, chunk_index, start_pos, least(start_pos + size, l) AS end_pos, content FROM x) "
    "SELECT doc_id, chunk_index, start_pos, end_pos, substr(content, CAST(start_pos + 1 AS BIGINT), CAST(end_pos - start_pos AS BIGINT)) AS chunk, CAST(floor((end_pos - start_pos) / 4) AS BIGINT) AS token_count FROM y"
)
SQL["chunk_fixed"] = _window("range(0, CASE WHEN l <= 512 THEN 1 ELSE CAST(ceil((l - 512) / 462) AS BIGINT) + 1 END)", (512, 462))
SQL["chunk_stream"] = _window("range(0, CASE WHEN l < 300 THEN 1 ELSE CAST(floor((l - 300) / 240) AS BIGINT) + 2 END)", (300, 240))
_last = "CASE WHEN l <= 300 THEN 0 ELSE CAST(ceil((l - 300) / 240) AS BIGINT) END"
SQL["chunk_buffered"] = _window(f"range(0, {_last} + CASE WHEN l > 60 THEN 2 ELSE 1 END)", (300, 240), f"CASE WHEN i > {_last} THEN l - 60 ELSE i * 240 END")
_sent = r"regexp_extract_all(content, '[^.!?。！？\n]*[.!?。！？\n]|[^.!?。！？\n]+$')"
_pos = lambda lst, name, key="n": f"SELECT doc_id, i - 1 AS {key}, x[i] AS {name} FROM (SELECT doc_id, {lst} AS x, unnest(range(1, len({lst}) + 1)) AS i FROM documents WHERE content IS NOT NULL)"
SQL["sentence_split"] = _pos(f"list_filter(list_transform({_sent}, lambda s: {trim('s')}), lambda s: s <> '')", "sentence")
SQL["token_estimate"] = f"SELECT doc_id, CAST(floor(length(content) / 4) AS BIGINT) AS tokens, len({words('content')}) AS words, octet_length(encode(content)) AS bytes FROM documents"
SQL["rerank_tokens"] = f"SELECT term, count(*) AS n FROM (SELECT unnest({space_tokens('content')}) AS term FROM documents) GROUP BY term"
SQL["text_predicates"] = (
    r"SELECT doc_id, regexp_full_match(title, '\p{Han}+') AS han, regexp_full_match(title, '[\p{P}\s]+') AS punctuation, CASE WHEN length(title) > 12 THEN substr(title, 1, 12) || '...' ELSE title END AS short, "
    + trim("content") + " AS trimmed FROM documents"
)

# Sources.
SQL["detect_types"] = (
    "WITH p AS (SELECT doc_id, '/data/in.d/' || doc_id || '.' || coalesce(doc_type, 'bin') AS path FROM documents), e AS (SELECT doc_id, lower(regexp_extract(path, '\\.[^./]*$')) AS ext, regexp_extract(path, '[^/]*$') AS base FROM p) "
    "SELECT doc_id, CASE WHEN ext = '.pdf' THEN 'pdf' WHEN ext IN ('.docx', '.doc') THEN 'docx' WHEN ext IN ('.md', '.markdown') THEN 'md' WHEN ext IN ('.html', '.htm') THEN 'html' WHEN ext = '.csv' THEN 'csv' WHEN ext = '.json' THEN 'json' ELSE 'txt' END AS detected, "
    "regexp_replace(base, '\\.[^.]*$', '') AS name, ext AS extension FROM e"
)
_lines = lambda x: f"array_to_string(list_filter(list_transform(string_split({x}, chr(10)), lambda s: {trim('s')}), lambda s: s <> ''), chr(10))"
SQL["html_strip"] = f"SELECT doc_id, {_lines(chr(39).join(['regexp_replace(content, ', '<[^>]*>?|>', ', ', '', ', ', 'g', ')']))} AS stripped FROM documents"
SQL["html_title"] = "SELECT doc_id, " + trim("regexp_extract(content, '(?s)<(?:title|TITLE)>(.*?)</(?:title|TITLE)>', 1)") + " AS html_title FROM documents"
_no = "content"
for _tag in ("script", "style", "noscript"):
    _no = rf"regexp_replace({_no}, '(?is)<{_tag}\b[^>]*>.*?</{_tag}>', '', 'g')"
SQL["html_without_script"] = f"SELECT doc_id, length({_no}) AS left FROM documents"
_htext = lambda x: trim(f"regexp_replace(regexp_replace({x}, '<[^>]*>?|>', ' ', 'g'), '[ \\t]+', ' ', 'g')")
SQL["html_list_items"] = _pos(f"list_filter(list_transform(regexp_extract_all(content, '(?is)<li[^>]*>(.*?)</li>', 1), lambda s: {_htext('s')}), lambda s: s <> '')", "item")
_dec = "content"
for _name, _sign in ENTITIES:
    _dec = f"replace({_dec}, '{_name}', '{_sign.replace(chr(39), chr(39) * 2)}')"
SQL["html_entities"] = f"SELECT doc_id, {_dec} AS decoded FROM documents"
SQL["markdown_title"] = "SELECT doc_id, " + trim(r"regexp_extract(content, '(?m)^#[ \t]+([^\n]+)$', 1)") + " AS md_title FROM documents"
SQL["front_matter"] = (
    r"WITH b AS (SELECT doc_id, unnest(string_split(regexp_extract(content, '(?s)\A---\s*\n(.*?)\n---\s*(?:\n|\z)', 1), chr(10))) AS line FROM documents) "
    rf"SELECT doc_id, {trim('split_part(line, chr(58), 1)')} AS key, regexp_replace({trim('substr(line, instr(line, chr(58)) + 1)')}, '^[\"'']|[\"'']$', '', 'g') AS value FROM b WHERE contains(line, ':') AND NOT starts_with(ltrim(line), '#')"
).replace('\\"', '"')
SQL["text_paragraphs"] = _pos(rf"list_filter(list_transform(regexp_split_to_array(content, '\n\s*\n'), lambda s: {trim('s')}), lambda s: s <> '')", "paragraph")

# Vectors.
_V = "v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vector, CAST(label AS VARCHAR) AS label FROM embeddings), q AS (SELECT id AS query_id, vector AS qv FROM v WHERE id % 20 = 0)"
SQL["knn_cosine"] = f"WITH {_V}, s AS (SELECT query_id, id, list_cosine_similarity(qv, vector) AS score FROM v, q), {_top(10)}"
SQL["knn_l2"] = f"WITH {_V}, s AS (SELECT query_id, id, -list_distance(qv, vector) AS score FROM v, q), {_top(10)}"
SQL["knn_filtered"] = f"WITH {_V}, s AS (SELECT query_id, id, list_cosine_similarity(qv, vector) AS score FROM v, q WHERE label = '3'), {_top(5)}"
SQL["hnsw_ideal"] = (
    f"WITH {_V}, a AS (SELECT query_id, id, label, list_distance(qv, vector) AS dist, row_number() OVER (PARTITION BY query_id ORDER BY list_distance(qv, vector), id) AS n FROM v, q), s AS (SELECT query_id, id, 1 / (1 + dist) AS score FROM a WHERE n <= 30 AND label = '3'), {_top(5)}"
)
SQL["multi_query_knn"] = (
    f"WITH {_V}, a AS (SELECT query_id, id, list_cosine_similarity(qv, vector) AS score FROM v, q), b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS n FROM a), "
    "f AS (SELECT query_id // 100 AS g, query_id % 100 AS ord, id, score FROM b WHERE n <= 10), "
    f"s AS (SELECT g AS query_id, id, score FROM f QUALIFY row_number() OVER (PARTITION BY g, id ORDER BY ord) = 1), {_top(10)}"
)
SQL["vector_normalise"] = "SELECT vec_id AS id, 1.0::DOUBLE AS norm, round(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 5) AS along FROM embeddings"
SQL["vector_text"] = "SELECT vec_id AS id, '[' || array_to_string(list_transform(embedding, lambda x: printf('%.6f', CAST(x AS DOUBLE))), ',') || ']' AS text, len(embedding) AS dim FROM embeddings"
SQL["vector_stats"] = "SELECT count(*) AS vectors, count(DISTINCT vec_id) AS ids, min(len(embedding)) AS min_dim, max(len(embedding)) AS max_dim FROM embeddings"
SQL["vector_upsert"] = "SELECT label, count(*) AS n FROM (SELECT CASE WHEN vec_id % 20 = 0 THEN 'new' ELSE CAST(label AS VARCHAR) END AS label FROM embeddings) WHERE label <> '3' GROUP BY label"

# Fusion and reranking.
_H = "h AS (SELECT query_id, strategy, id, max(score) AS score, max(content) AS content FROM retrieval_results WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY ALL)"
_RRF = "k AS (SELECT *, row_number() OVER (PARTITION BY query_id, strategy ORDER BY score DESC, id) AS n FROM h), s AS (SELECT query_id, id, sum(1 / (60 + n)) AS score FROM k GROUP BY ALL)"
SQL["rrf_fusion"] = f"WITH {_H}, {_RRF}, {_top(10)}"
SQL["weighted_fusion"] = (
    f"WITH {_H}, l AS (SELECT query_id, count(DISTINCT strategy) AS lists FROM h GROUP BY ALL), w AS (SELECT h.*, CASE strategy WHEN 'vector' THEN 0.6 WHEN 'keyword' THEN 0.3 ELSE 1.0 / lists END AS w FROM h JOIN l USING (query_id)), "
    "t AS (SELECT query_id, sum(w) AS total FROM (SELECT DISTINCT query_id, strategy, w FROM w) GROUP BY ALL), s AS (SELECT query_id, id, sum(CAST(score AS DOUBLE) * w) / any_value(total) AS score FROM w JOIN t USING (query_id) GROUP BY ALL), "
    + _top(10).replace("round(score, 5)", "round(score, 4)")
)
SQL["route_counts"] = f"WITH {_H} SELECT query_id, strategy, count(*) AS hits FROM h GROUP BY ALL"
_any = lambda ws: "(" + " OR ".join(f"contains(lower(coalesce(title, '')), '{w}')" for w in ws) + ")"
SQL["route_queries"] = f"SELECT doc_id, CASE WHEN {_any(FACTUAL)} THEN 'keyword,graph' WHEN {_any(SEMANTIC)} THEN 'vector' ELSE 'vector,keyword' END AS strategies FROM documents"
SQL["rerank_match"] = (
    f"{SCORED}, r0 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS n FROM s), m AS (SELECT r0.query_id, r0.id, r0.score, {space_tokens('query')} AS qw, {space_tokens('content')} AS cw FROM r0 JOIN q USING (query_id) JOIN d ON r0.id = d.id WHERE n <= 20), "
    "x AS (SELECT query_id, id, 0.3 * score + 0.7 * len(list_filter(qw, lambda w: list_contains(cw, w))) / len(qw) AS rr FROM m), y AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rr, 9) DESC, id) AS rank FROM x) "
    "SELECT query_id, id, round(rr, 5) AS rerank_score, rank FROM y WHERE rank <= 10"
)
SQL["pseudo_jaccard"] = (
    f"WITH t AS (SELECT doc_id, list_distinct({space_tokens(chr(99) + 'oalesce(title, ' + chr(39) * 2 + ')')}) AS a, {space_tokens('coalesce(content, ' + chr(39) * 2 + ')')} AS b FROM documents), u AS (SELECT doc_id, len(a) AS na, len(b) AS nb, len(list_filter(b, lambda w: list_contains(a, w))) AS c FROM t) "
    "SELECT doc_id, CASE WHEN na + nb - c = 0 THEN 0 ELSE round(c / (na + nb - c), 6) END AS score FROM u"
)

# Deduplication.
_M = "m AS (SELECT doc_id, sha256(content) AS hash, octet_length(encode(content)) AS size, created_at, source FROM documents), f AS (SELECT *, first_value(doc_id) OVER (PARTITION BY hash ORDER BY created_at NULLS FIRST, doc_id) AS first FROM m)"
SQL["exact_dedup"] = f"WITH {_M} SELECT doc_id, hash, size AS content_size, coalesce(size > 0 AND first <> doc_id, false) AS is_duplicate, CASE WHEN size > 0 AND first <> doc_id THEN first END AS existing_id FROM f"
SQL["dedup_stats"] = f"WITH {_M}, g AS (SELECT *, coalesce(size > 0 AND first <> doc_id, false) AS dup FROM f) SELECT count(*) AS documents, count(DISTINCT hash) AS hashes, CAST(count(*) FILTER (dup) AS BIGINT) AS duplicates, CAST(sum(size) AS BIGINT) AS bytes, CAST(coalesce(sum(size) FILTER (dup), 0) AS BIGINT) AS duplicate_bytes FROM g"
SQL["hash_index"] = f"WITH {_M} SELECT hash, doc_id AS document_id, size AS content_size, source FROM f WHERE size > 0 AND first = doc_id"
SQL["verify_hashes"] = "SELECT doc_id, lower(content_hash) = sha256(content) AS fresh FROM documents"

# Graph.
_G = (
    "e AS (SELECT id, name, aliases, document_id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at DESC NULLS LAST, name DESC NULLS LAST, upper(entity_type) DESC NULLS LAST) AS n FROM entities) WHERE n = 1), "
    "r AS (SELECT id, source_id, target_id, document_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at DESC NULLS LAST, source_id DESC NULLS LAST, target_id DESC NULLS LAST) AS n FROM relations) WHERE n = 1), "
    "b AS (SELECT source_id AS a, target_id AS b, id AS rid FROM r UNION ALL SELECT target_id, source_id, id FROM r WHERE source_id <> target_id), seeds AS (SELECT id FROM e WHERE CAST(substr(id, 5) AS BIGINT) % 20 = 0)"
)
SQL["entity_extraction"] = (
    r"""WITH x AS (SELECT doc_id, 1 AS rule, 'CONCEPT' AS type, 0.7 AS confidence, regexp_extract_all(content, '「(.+?)」', 1) AS names FROM documents
UNION ALL SELECT doc_id, 2, 'CONCEPT', 0.7, regexp_extract_all(content, '"(.+?)"', 1) FROM documents
UNION ALL SELECT doc_id, 3, 'PRODUCT', 0.7, regexp_extract_all(content, '《(.+?)》', 1) FROM documents
UNION ALL SELECT doc_id, 4, 'CONCEPT', 0.7, regexp_extract_all(content, '【(.+?)】', 1) FROM documents
UNION ALL SELECT doc_id, 9, 'ORGANIZATION', 0.6, regexp_extract_all(content, '([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)', 1) FROM documents),
y AS (SELECT doc_id, rule, type, confidence, unnest(range(1, len(names) + 1)) AS i, names FROM x),
"""
    + f"z AS (SELECT doc_id, rule, type, confidence, i, {trim('names[i]')} AS name FROM y), "
    "k AS (SELECT * FROM z WHERE CASE WHEN rule < 9 THEN octet_length(encode(name)) BETWEEN 2 AND 50 ELSE octet_length(encode(name)) > 2 END) "
    "SELECT doc_id, name, type, CAST(confidence AS DOUBLE) AS confidence FROM k QUALIFY row_number() OVER (PARTITION BY doc_id, lower(name) ORDER BY rule, i) = 1"
)
SQL["entity_search"] = (
    f"WITH {_G}, q AS (SELECT query_id, lower(query) AS q FROM {_q(C.NAMES)}), m AS (SELECT query_id, id, (lower(name) = q OR list_contains(list_transform(coalesce(aliases, []), lambda x: lower(x)), q)) AS exact FROM e, q "
    "WHERE lower(name) = q OR list_contains(list_transform(coalesce(aliases, []), lambda x: lower(x)), q) OR contains(lower(name), q) OR (name <> '' AND contains(q, lower(name)))), "
    "o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, id) AS rank FROM m) SELECT * FROM o WHERE rank <= 10"
)
SQL["incident_relations"] = f"WITH {_G} SELECT a AS entity_id, rid AS relation_id FROM b JOIN seeds ON b.a = seeds.id"
SQL["subgraph_nodes"] = (
    f"WITH {_G}, l0 AS (SELECT id AS seed_id, id FROM seeds), l1 AS (SELECT DISTINCT seed_id, b.b AS id FROM l0 JOIN b ON l0.id = b.a WHERE b.b IN (SELECT id FROM e)), l2 AS (SELECT DISTINCT seed_id, b.b AS id FROM l1 JOIN b ON l1.id = b.a WHERE b.b IN (SELECT id FROM e)) "
    "SELECT seed_id, id, min(level) AS level FROM (SELECT *, 0 AS level FROM l0 UNION ALL SELECT *, 1 FROM l1 UNION ALL SELECT *, 2 FROM l2) GROUP BY ALL"
)
SQL["subgraph_relations"] = (
    f"WITH {_G}, l0 AS (SELECT id AS seed_id, id FROM seeds), l1 AS (SELECT DISTINCT seed_id, b.b AS id FROM l0 JOIN b ON l0.id = b.a WHERE b.b IN (SELECT id FROM e)) "
    "SELECT DISTINCT seed_id, rid AS relation_id FROM (SELECT * FROM l0 UNION SELECT * FROM l1) n JOIN b ON n.id = b.a"
)
SQL["simple_paths"] = (
    f"WITH {_G}, hub AS (SELECT a AS h FROM b GROUP BY a ORDER BY count(*) DESC, a LIMIT 1), x AS (SELECT * FROM b WHERE a <> b), s AS (SELECT id, h FROM seeds, hub WHERE id <> h), "
    "p1 AS (SELECT id, h, x.b AS n1, rid AS r1 FROM s JOIN x ON x.a = s.id), p2 AS (SELECT p1.*, x.b AS n2, x.rid AS r2 FROM p1 JOIN x ON x.a = p1.n1 WHERE n1 <> h AND x.b <> id), p3 AS (SELECT p2.*, x.b AS n3, x.rid AS r3 FROM p2 JOIN x ON x.a = p2.n2 WHERE n2 <> h AND x.b = h) "
    "SELECT id AS source, h AS target, id AS nodes, r1 AS edges, 1 AS length FROM p1 WHERE n1 = h UNION ALL SELECT id, h, id || '>' || n1, r1 || '>' || r2, 2 FROM p2 WHERE n2 = h UNION ALL SELECT id, h, id || '>' || n1 || '>' || n2, r1 || '>' || r2 || '>' || r3, 3 FROM p3 WHERE n2 <> n1"
)
_SEARCH = (
    f"q AS (SELECT query_id, lower(query) AS q FROM {_q(C.NAMES)}), m AS (SELECT query_id, id, name, confidence, document_id, (lower(name) = q OR list_contains(list_transform(coalesce(aliases, []), lambda x: lower(x)), q)) AS exact FROM e, q "
    "WHERE lower(name) = q OR list_contains(list_transform(coalesce(aliases, []), lambda x: lower(x)), q) OR contains(lower(name), q) OR (name <> '' AND contains(q, lower(name)))), "
    "o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, id) AS rank FROM m QUALIFY rank <= 5), l0 AS (SELECT DISTINCT query_id, id FROM o), "
    "l1 AS (SELECT DISTINCT query_id, b.b AS id FROM l0 JOIN b ON l0.id = b.a WHERE b.b IN (SELECT id FROM e)), n AS (SELECT * FROM l0 UNION SELECT * FROM l1)"
)
SQL["graph_retrieve"] = f"WITH {_G}, {_SEARCH} SELECT query_id, CAST(document_id AS VARCHAR) AS document_id, round(max(CASE WHEN isnan(confidence) THEN NULL ELSE confidence END), 6) AS score FROM n JOIN e USING (id) WHERE document_id IS NOT NULL GROUP BY ALL"
SQL["graph_answer"] = (
    f"WITH {_G}, {_SEARCH}, c AS (SELECT query_id, count(DISTINCT id) AS entities FROM n GROUP BY ALL), x AS (SELECT query_id, count(DISTINCT rid) AS relations FROM n JOIN b ON n.id = b.a GROUP BY ALL), w AS (SELECT query_id, string_agg(name, ', ' ORDER BY rank) AS names FROM o GROUP BY ALL) "
    "SELECT query_id, coalesce(entities, 0) AS entities, coalesce(relations, 0) AS relations, CASE WHEN names IS NULL THEN 'No entity found.' ELSE names || ': ' || coalesce(entities, 0) || ' entities and ' || coalesce(relations, 0) || ' relations around.' END AS answer FROM q LEFT JOIN c USING (query_id) LEFT JOIN x USING (query_id) LEFT JOIN w USING (query_id)"
)
SQL["graph_delete"] = (
    f"WITH {_G}, g AS (SELECT id FROM e WHERE document_id = 10) SELECT (SELECT count(*) FROM e WHERE document_id IS DISTINCT FROM 10) AS entities, "
    "(SELECT count(*) FROM r WHERE document_id IS DISTINCT FROM 10 AND source_id NOT IN (SELECT id FROM g) AND target_id NOT IN (SELECT id FROM g)) AS relations"
)

# Evaluation.
_E = (
    f"WITH {_H}, {_RRF}, run AS (SELECT query_id, id AS doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s) WHERE rank <= 20), "
    "rel AS (SELECT query_id, id AS doc_id, CASE WHEN max(rerank_score) > 0.5 THEN round(max(rerank_score), 3) ELSE 0 END AS rel FROM retrieval_results WHERE rerank_score IS NOT NULL AND NOT isnan(rerank_score) GROUP BY ALL), "
    "j AS (SELECT run.*, coalesce(rel, 0) AS rel, sum(CASE WHEN rel > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) AS sofar FROM run LEFT JOIN rel USING (query_id, doc_id)), "
    "i AS (SELECT query_id, rel, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, doc_id) AS n FROM rel WHERE rel > 0), nr AS (SELECT query_id, count(*) AS relevant FROM i GROUP BY ALL), u AS (SELECT DISTINCT query_id FROM rel), nt AS (SELECT query_id, count(*) AS retrieved FROM run GROUP BY ALL), "
    "b AS (SELECT u.query_id, coalesce(retrieved, 0) AS retrieved, coalesce(relevant, 0) AS relevant FROM u LEFT JOIN nt USING (query_id) LEFT JOIN nr USING (query_id)), per AS (SELECT query_id, retrieved, relevant"
)
for _k in (1, 5, 10, 20):
    _used = f"least({_k}, retrieved)"
    _E += f", CASE WHEN relevant > 0 THEN coalesce((SELECT count(*) FROM j WHERE j.query_id = b.query_id AND rel > 0 AND rank <= {_k}), 0) / relevant ELSE 0 END AS recall_{_k}"
    _E += f", CASE WHEN retrieved > 0 THEN coalesce((SELECT count(*) FROM j WHERE j.query_id = b.query_id AND rel > 0 AND rank <= {_k}), 0) / {_used} ELSE 0 END AS precision_{_k}"
    _E += f", coalesce((SELECT sum(rel / log2(rank + 1)) FROM j WHERE j.query_id = b.query_id AND rank <= {_k}) / (SELECT sum(rel / log2(n + 1)) FROM i WHERE i.query_id = b.query_id AND n <= {_used}), 0) AS ndcg_{_k}"
_E += ", coalesce(1 / (SELECT min(rank) FROM j WHERE j.query_id = b.query_id AND rel > 0), 0) AS mrr, CASE WHEN relevant > 0 THEN coalesce((SELECT sum(sofar / rank) FROM j WHERE j.query_id = b.query_id AND rel > 0), 0) / relevant ELSE 0 END AS map FROM b)"
_METRICS = [f"{m}_{k}" for k in (1, 5, 10, 20) for m in ("recall", "precision", "ndcg")] + ["mrr", "map"]
SQL["eval_per_query"] = f"{_E} SELECT query_id, retrieved, relevant, {', '.join(f'round({m}, 5) AS {m}' for m in _METRICS)} FROM per"
SQL["eval_mean"] = f"{_E} SELECT count(*) AS queries, {', '.join(f'round(avg({m}), 5) AS {m}' for m in _METRICS)} FROM per"
SQL["quality_gate"] = f"{_E} " + " UNION ALL ".join(f"SELECT '{m}' AS metric, round(avg({m}), 5) AS value, {t}::DOUBLE AS threshold, avg({m}) >= {t} AS passed FROM per" for m, t in {"recall_1": 0.3, "recall_5": 0.5, "recall_10": 0.7, "precision_5": 0.4, "mrr": 0.4, "map": 0.4, "ndcg_10": 0.5}.items())

# Rewriting, access, prompts, store.
SQL["synonym_rewrite"] = (
    f"WITH t AS (SELECT doc_id AS query_id, title AS query, {words('title')} AS w FROM documents WHERE title IS NOT NULL), s AS {_rows(C.SYNONYMS, 'word, synonym')}, p AS (SELECT query_id, query, w, unnest(range(1, len(w) + 1)) AS i FROM t), "
    "v AS (SELECT query_id, -1 AS pos, '' AS synonym, query FROM t UNION ALL SELECT query_id, i - 1, synonym, replace(query, word, synonym) FROM p JOIN s ON w[i] = word) "
    "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY pos, synonym) - 1 AS ord, query FROM v"
)
SQL["multi_query_rewrite"] = "SELECT doc_id AS query_id, unnest([0, 1, 2]) AS ord, unnest([title, " + trim("title || ' guide'") + ", " + trim("'about ' || title") + "]) AS query FROM documents WHERE title IS NOT NULL"
SQL["acl_rights"] = "SELECT CAST(doc_id AS VARCHAR) AS doc_id, status = 'pending' OR coalesce(source = 'en', false) OR coalesce(lang = 'en', false) OR coalesce(doc_type = 'en', false) AS reads, coalesce(source = 'txt', false) OR coalesce(doc_type = 'txt', false) AS writes, coalesce(source = 'wiki-mirror', false) AS owns FROM documents"
SQL["acl_filter"] = "SELECT DISTINCT CAST(document_id AS VARCHAR) AS doc_id, id AS ord FROM chunks WHERE document_id IN (SELECT doc_id FROM documents WHERE status = 'pending' OR source = 'txt' OR lang = 'txt' OR doc_type = 'txt')"
SQL["acl_list"] = "SELECT CAST(doc_id AS VARCHAR) AS doc_id FROM documents WHERE status = 'pending' OR source = 'wiki-mirror' OR lang = 'wiki-mirror' OR doc_id = 8"
SQL["paginate_documents"] = "SELECT doc_id, title FROM documents ORDER BY created_at DESC NULLS LAST, doc_id LIMIT 20 OFFSET 40"
SQL["store_update"] = "SELECT status, count(*) AS n, CAST(sum(v) AS BIGINT) AS versions FROM (SELECT CASE WHEN status = 'pending' THEN 'indexed' ELSE status END AS status, doc_version + CASE WHEN status = 'pending' THEN 1 ELSE 0 END AS v FROM documents WHERE status IS DISTINCT FROM 'deleted') GROUP BY status"
SQL["store_checked"] = (
    "SELECT doc_id AS id, concat_ws(',', CASE WHEN coalesce(content, '') = '' THEN 'no content' END, CASE WHEN NOT coalesce(doc_type IN ('pdf', 'docx', 'md', 'html', 'txt', 'csv', 'json'), false) THEN 'unknown type' END, "
    "CASE WHEN NOT coalesce(status IN ('pending', 'processing', 'indexed', 'failed', 'deleted'), false) THEN 'unknown status' END) AS problems FROM documents"
)
SQL["document_chunks"] = "WITH c AS (SELECT DISTINCT * FROM chunks) SELECT doc_id AS id, count(c.id) AS chunks FROM documents d LEFT JOIN c ON c.document_id = d.doc_id AND d.lang IS DISTINCT FROM 'zh' GROUP BY doc_id"
SQL["metadata_filter"] = "SELECT id FROM (SELECT DISTINCT * FROM chunks) WHERE page_number = 1 AND chunk_index = 0"
_A = f"{SCORED}, a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s) WHERE rank <= 3), g AS (SELECT query_id, a.id, score, rank, d.content, source FROM a JOIN d ON a.id = d.id JOIN documents ON doc_id = a.id)"
SQL["context_assembly"] = f"{_A} SELECT query_id, string_agg('[' || rank || '] ' || content || chr(10) || CASE WHEN coalesce(source, '') <> '' THEN 'source: ' || source || chr(10) ELSE '' END || chr(10), '' ORDER BY rank) AS context FROM g GROUP BY query_id"
SQL["prompt_assembly"] = (
    f"{_A}, l AS (SELECT query_id, string_agg('Reference ' || rank || ':' || chr(10) || content || chr(10) || 'Source: ' || coalesce(source, ''), chr(10) || chr(10) ORDER BY rank) AS refs FROM g GROUP BY query_id) "
    "SELECT q.query_id, 'Answer the question from the references below. If they don''t hold the answer, say so.' || chr(10) || chr(10) || CASE WHEN refs IS NULL THEN '' ELSE '=== References ===' || chr(10) || refs || chr(10) || chr(10) END || '=== Question ===' || chr(10) || 'Question: ' || query || chr(10) || chr(10) || '=== Answer ===' || chr(10) AS prompt FROM q LEFT JOIN l USING (query_id)"
)
_answer = (
    "l AS (SELECT query_id, count(*) || ' results:' || chr(10) || chr(10) || string_agg(rank || '. ' || CASE WHEN coalesce(source, '') = '' THEN 'source ' || rank ELSE source END || CASE WHEN score > 0 THEN printf(' (score %.2f)', score) ELSE '' END || chr(10) || '   ' || CASE WHEN length(content) > 300 THEN substr(content, 1, 300) || '...' ELSE content END, chr(10) || chr(10) ORDER BY rank) AS answer FROM g GROUP BY query_id) "
    "SELECT q.query_id, coalesce(answer, 'Nothing in the knowledge base answers this question.') AS answer FROM q LEFT JOIN l USING (query_id)"
)
SQL["fallback_answers"] = f"{_A}, {_answer}"
SQL["stream_ingest"] = "SELECT lang, count(*) AS n FROM documents GROUP BY lang"
SQL["snapshot_changes"] = (
    "WITH a AS (SELECT doc_id, created_at AS m FROM documents WHERE lang IS DISTINCT FROM 'fr'), b AS (SELECT doc_id, updated_at AS m FROM documents WHERE lang IS DISTINCT FROM 'de') "
    "SELECT CASE WHEN a.doc_id IS NULL THEN 'create' WHEN b.doc_id IS NULL THEN 'delete' ELSE 'modify' END AS event, count(*) AS n FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR a.m <> b.m GROUP BY ALL"
)

# Sequential chunkers as folds: a recursive query walks the pieces of all texts in step.
_T = "t AS (SELECT doc_id, content FROM documents WHERE length(content) > 0)"


def _fold(parts: str, cut: str, have: str, start: str, out: str = "have", at: str = "start") -> str:
    """parts gives doc_id and lists ps of structs (k, t); cut, have and start are the next state from have, start, k and x (the piece)."""
    return (
        f"WITH RECURSIVE {_T}, l AS ({parts}), p AS (SELECT doc_id, i, ps[i].k AS k, ps[i].t AS x, len(ps) AS n FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM l)), "
        "f AS (SELECT doc_id, CAST(0 AS BIGINT) AS i, '' AS have, CAST(0 AS BIGINT) AS start, CAST(NULL AS VARCHAR) AS done, CAST(NULL AS BIGINT) AS from_, len(ps) AS n FROM l UNION ALL "
        f"SELECT doc_id, i + 1, {have}, CAST({start} AS BIGINT), CASE WHEN cut THEN {out} END, CASE WHEN cut THEN CAST({at} AS BIGINT) END, n FROM (SELECT *, {cut} AS cut FROM (SELECT f.*, p.k, p.x FROM f JOIN p ON p.doc_id = f.doc_id AND p.i = f.i + 1))), "
        "o AS (SELECT doc_id, i, from_ AS start_pos, done AS chunk FROM f WHERE done IS NOT NULL UNION ALL SELECT doc_id, n + 1, start, have FROM f WHERE i = n AND have <> '') "
        "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_index, start_pos, start_pos + length(chunk) AS end_pos, chunk, length(chunk) // 4 AS token_count FROM o"
    )


_structs = lambda lst: f"list_transform({lst}, lambda y: {{'k': 'p', 't': y}})"
_over = "have <> '' AND length(have) + length(x) > 512"
SQL["chunk_recursive"] = _fold(
    f"SELECT doc_id, {_structs('CASE WHEN length(content) <= 512 THEN [content] ELSE string_split(content, chr(10) || chr(10)) END')} AS ps FROM t",
    _over, "CASE WHEN cut THEN substr(have, greatest(0, length(have) - 50) + 1) ELSE have END || x", "CASE WHEN cut THEN start + greatest(0, length(have) - 50) ELSE start END",
)
SQL["chunk_lines"] = _fold(
    f"SELECT doc_id, {_structs(chr(114) + 'egexp_extract_all(content, ' + chr(39) + '[^' + chr(92) + 'n]*' + chr(92) + 'n|[^' + chr(92) + 'n]+' + chr(39) + ')')} AS ps FROM t",
    "length(have || x) >= 512", "CASE WHEN cut THEN '' ELSE have || x END", "CASE WHEN cut THEN start + length(have || x) ELSE start END", "have || x",
)
_SENTENCE = r"'[^.!?。！？\n]*[.!?。！？\n]|[^.!?。！？\n]+$'"
SQL["chunk_semantic"] = _fold(
    f"SELECT doc_id, flatten(list_transform(list_filter(list_transform(string_split(content, chr(10) || chr(10)), lambda y: {trim('y')}), lambda y: y <> ''), lambda z: CASE WHEN length(z) > 512 THEN "
    f"list_concat([{{'k': 'f', 't': ''}}], list_transform(list_filter(list_transform(regexp_extract_all(z, {_SENTENCE}), lambda v: {trim('v')}), lambda v: v <> ''), lambda v: {{'k': 's', 't': v}})) ELSE [{{'k': 'p', 't': z}}] END)) AS ps FROM t",
    "have <> '' AND (k = 'f' OR length(have) + length(x) > 512)",
    "CASE WHEN k = 'f' THEN '' WHEN k = 's' THEN CASE WHEN cut THEN '' ELSE have END || x WHEN cut OR have = '' THEN x ELSE have || chr(10) || chr(10) || x END",
    "CASE WHEN cut AND k <> 'f' THEN start + length(have) ELSE start END",
)
_SEPARATORS = ["\n\n", "\n", "。", "！", "？", ". ", "! ", "? ", " "]
_marked = "CASE level " + " ".join(f"WHEN {i} THEN replace(part, '{x}', '{x}' || chr(1))" for i, x in enumerate(_SEPARATORS) if i) + " END"
_deep = (
    "s AS (SELECT doc_id, CAST([] AS BIGINT[]) AS path, content AS part, 0 AS level FROM t UNION ALL SELECT doc_id, list_append(path, i), bits[i], level + 1 FROM (SELECT *, unnest(range(1, len(bits) + 1)) AS i FROM (SELECT *, "
    "CASE WHEN level = 0 THEN list_filter(string_split(replace(replace(part, chr(10) || chr(10), chr(10) || chr(10) || chr(1)), chr(1) || chr(10), chr(1) || chr(10) || chr(1)), chr(1)), lambda b: b <> '') "
    f"WHEN level = 9 THEN list_transform(range(0, length(part), 512), lambda b: substr(part, CAST(b + 1 AS BIGINT), 512)) ELSE list_filter(string_split({_marked}, chr(1)), lambda b: b <> '') END AS bits FROM s WHERE length(part) > 512 AND level < 10)))"
)
SQL["chunk_deep"] = _fold("SELECT doc_id, list({'k': 'p', 't': part} ORDER BY path) AS ps FROM s WHERE length(part) <= 512 OR level >= 10 GROUP BY doc_id", _over, "CASE WHEN cut THEN '' ELSE have END || x", "CASE WHEN cut THEN start + length(have) ELSE start END").replace(f"{_T}, ", f"{_T}, {_deep}, ", 1)

_field = lambda c: f"CASE WHEN {c} IS NOT NULL THEN '\"{c}\":' || to_json({c}) END"
SQL["json_sink"] = f"SELECT '{{' || concat_ws(',', {', '.join(map(_field, ('doc_id', 'lang', 'doc_version', 'title')))}) || '}}' AS json FROM documents"
SQL["hyde_rewrite"] = f"WITH t AS (SELECT doc_id AS query_id, title AS query FROM documents WHERE title IS NOT NULL) SELECT query_id, 0 AS ord, query FROM t UNION ALL SELECT query_id, 1, 'A text about ' || regexp_extract({trim('query')}, '[^' || chr(10) || ']*$') FROM t"
SQL["relation_extraction"] = (
    "SELECT doc_id, source, lang AS target, 'USES' AS type, CAST(0.5 AS DOUBLE) AS confidence FROM documents WHERE octet_length(encode(source)) > 1 AND octet_length(encode(lang)) > 1 AND NOT contains(source, substr(lang, 1, 1))"
)
SQL["llm_extraction"] = (
    r"SELECT doc_id, 'entity' AS kind, 'PRODUCT' AS type, len(ls) AS n FROM (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(content, ''), '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'), "
    f"lambda x: {trim('x')} <> '') AS ls FROM documents) WHERE len(ls) > 0"
)
_found = lambda rows, key: (
    f"c0 AS ({rows}), x AS (" + " UNION ALL ".join(
        rf"SELECT {key}, {rule} AS rule, '{kind}' AS type, {conf} AS confidence, regexp_extract_all(content, '{pattern}', 1) AS names FROM c0"
        for rule, kind, conf, pattern in ((1, "CONCEPT", 0.7, "「(.+?)」"), (2, "CONCEPT", 0.7, '"(.+?)"'), (3, "PRODUCT", 0.7, "《(.+?)》"), (4, "CONCEPT", 0.7, "【(.+?)】"), (9, "ORGANIZATION", 0.6, r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)"))
    ) + rf" UNION ALL SELECT {key}, 10, 'PERSON', 0.4, list_filter(flatten(list_transform(regexp_extract_all(content, '\p{{Han}}{{2,}}'), lambda r: list_concat(list_transform(range(2, least(4, length(r)) + 1), lambda n: substr(r, 1, CAST(n AS BIGINT))), list_transform(range(2, least(4, length(r)) + 1), lambda n: substr(r, CAST(length(r) - n + 1 AS BIGINT), CAST(n AS BIGINT)))))), lambda w: w NOT IN ({', '.join(repr(w) for w in COMMON)})) FROM c0), "
    f"y AS (SELECT {key}, rule, type, confidence, unnest(range(1, len(names) + 1)) AS i, names FROM x), z AS (SELECT {key}, rule, type, confidence, i, CASE WHEN rule < 10 THEN {trim('names[i]')} ELSE names[i] END AS name FROM y), "
    "k AS (SELECT * FROM z WHERE CASE WHEN rule BETWEEN 1 AND 4 THEN octet_length(encode(name)) BETWEEN 2 AND 50 WHEN rule = 9 THEN octet_length(encode(name)) > 2 ELSE true END)"
)
SQL["graph_build"] = "WITH " + _found("SELECT id, max(document_id) AS document_id, max(content) AS content FROM chunks GROUP BY id", "id, document_id") + (
    ", o AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY id, lower(name) ORDER BY rule, i) = 1) SELECT CAST(document_id AS VARCHAR) AS document_id, type, count(*) AS n, count(DISTINCT name) AS names FROM o GROUP BY ALL"
)
SQL["entity_extraction_han"] = "WITH " + _found("SELECT doc_id, coalesce(content, '') AS content FROM documents", "doc_id") + (
    ", w AS (SELECT * FROM (VALUES ('retrieval', 'CONCEPT'), ('快照', 'TECHNOLOGY')) AS v(word, type)), a AS (SELECT doc_id, rule, i, name, type FROM k UNION ALL SELECT doc_id, 0, 0, word, w.type FROM c0, w WHERE contains(content, word)), "
    "o AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY doc_id, lower(name) ORDER BY rule, i) = 1) SELECT doc_id, type, count(*) AS n FROM o GROUP BY ALL"
)

# Diversity: ten rounds over each query's candidates, the best value first.
_CANDIDATES = f"{SCORED}, r0 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS ord FROM s), m AS (SELECT r0.query_id, r0.id, r0.score, ord, {space_tokens('content')} AS cw FROM r0 JOIN d ON r0.id = d.id WHERE ord <= 20)"


def _mmr(keep: int, trade: float, source: str = "m") -> str:
    """Similarities of all pairs of a query's candidates, then a recursive choice: each round has the list of those chosen."""
    return (
        f", pair AS (SELECT a.query_id, a.id AS one, b.id AS two, len(list_filter(b.cw, lambda w: list_contains(a.cw, w))) AS c, len(list_distinct(a.cw)) AS na, len(b.cw) AS nb FROM {source} a JOIN {source} b ON a.query_id = b.query_id AND a.id <> b.id), "
        "sim AS (SELECT query_id, one, two, CASE WHEN na + nb - c = 0 THEN 0 ELSE c / (na + nb - c) END AS s FROM pair), "
        "g AS (SELECT query_id, CAST([] AS BIGINT[]) AS chosen, 0 AS rank, CAST(NULL AS BIGINT) AS id FROM (SELECT DISTINCT query_id FROM m) UNION ALL "
        f"SELECT query_id, list_append(chosen, nxt), rank + 1, nxt FROM (SELECT g.query_id, g.chosen, g.rank, (SELECT m.id FROM {source} m WHERE m.query_id = g.query_id AND NOT list_contains(g.chosen, m.id) "
        f"ORDER BY round({trade} * m.score - {1 - trade:.1f} * coalesce((SELECT max(s) FROM sim WHERE sim.query_id = g.query_id AND sim.one = m.id AND list_contains(g.chosen, sim.two)), 0), 12) DESC, m.ord LIMIT 1) AS nxt FROM g WHERE rank < {keep}) WHERE nxt IS NOT NULL) "
    )


SQL["mmr"] = _CANDIDATES.replace("WITH ", "WITH RECURSIVE ", 1) + _mmr(10, 0.7) + "SELECT g.query_id, g.id, round(score, 5) AS score, rank FROM g JOIN m USING (query_id, id)"
_LATEST = "e AS (SELECT doc_id, title, content, source FROM documents QUALIFY coalesce(content, '') = '' OR row_number() OVER (PARTITION BY sha256(content) ORDER BY created_at NULLS FIRST, doc_id) = 1)"
_ENGINE = f"d AS (SELECT doc_id AS id, concat_ws(' ', title, content) AS content, {han(chr(99) + 'oncat_ws(' + chr(39) + ' ' + chr(39) + ', title, content)')} AS tokens FROM e), d2 AS (SELECT *, len(tokens) AS dl FROM d)"
_ASK = (
    f"WITH {_LATEST}, {_ENGINE}, {POSTINGS.replace('FROM d)', 'FROM d2)')}, {QT}, {BM25.replace('FROM d)', 'FROM d2)')}, a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s) WHERE rank <= 3), "
    "g AS (SELECT query_id, a.id, score, rank, d.content, source FROM a JOIN d ON a.id = d.id JOIN e ON doc_id = a.id)"
)
SQL["engine_ask"] = f"{_ASK}, {_answer}"

# Hashed words as vectors: position and sign of a word come from its MD5.
_HASHED = (
    "h AS (SELECT id, ('0x' || substr(md5(w), 1, 8))::BIGINT AS h FROM (SELECT id, unnest(regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+')) AS w FROM src)), v0 AS (SELECT id, h % 64 AS pos, CAST(sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END) AS DOUBLE) AS x FROM h GROUP BY ALL), "
    "v AS (SELECT id, pos, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS x FROM v0 WHERE x <> 0)"
)
SQL["embed_documents"] = f"WITH src AS (SELECT doc_id AS id, coalesce(text, '') AS content FROM documents), {_HASHED} SELECT id AS doc_id, pos, round(x, 5) AS value FROM v"
SQL["hybrid_search"] = (
    f"{SCORED}, src AS (SELECT id::VARCHAR AS id, content FROM d UNION ALL SELECT query_id, query FROM q), {_HASHED}, sim AS (SELECT q.query_id, d.id, coalesce(dot, 0) AS score FROM q CROSS JOIN d LEFT JOIN (SELECT a.id AS query_id, b.id AS other, sum(a.x * b.x) AS dot FROM v a JOIN v b ON a.pos = b.pos "
    "WHERE a.id IN (SELECT query_id FROM q) GROUP BY ALL) z ON z.query_id = q.query_id AND z.other = d.id::VARCHAR), "
    "u AS (SELECT query_id, id, 'keyword' AS strategy, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS n, score AS raw FROM s UNION ALL SELECT query_id, id, 'vector', row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id), score FROM sim), "
    "o AS (SELECT *, row_number() OVER (PARTITION BY query_id, strategy ORDER BY round(raw, 9) DESC, id) AS place FROM u WHERE n <= 20), f AS (SELECT query_id, id, sum(1 / (60 + place)) AS score FROM o GROUP BY ALL), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM f) SELECT query_id, id, round(score, 5) AS score, rank FROM r WHERE rank <= 10"
)

# Approximate search: the queries' number, and that nine tenths of the exact neighbours are found.
SQL["ivf_recall"] = SQL["hnsw_recall"] = "SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 20 = 0"
SQL["hnsw_levels"] = "SELECT CAST(floor(-ln((('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 8))::BIGINT + 1) / 4294967296.0) / ln(16)) AS INTEGER) AS level, count(*) AS nodes FROM embeddings GROUP BY level"
SQL["knn_everything"] = (
    "WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 500 = 0) "
    "SELECT query_id, id, round(score, 5) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s"
)
SQL["index_repeated"] = f"WITH x AS (SELECT doc_id, CASE WHEN lang = 'de' THEN coalesce(title, '') ELSE coalesce(content, '') END AS c FROM documents), d AS (SELECT doc_id, {han('c')} AS tokens FROM x) SELECT count(*) AS documents, (SELECT count(DISTINCT t) FROM (SELECT unnest(tokens) AS t FROM d)) AS terms, CAST(sum(len(tokens)) AS BIGINT) AS tokens FROM d"
SQL["index_stored"] = SQL["bm25_topk"]
SQL["docx_paragraphs"] = (
    r"WITH l AS (SELECT doc_id || '.docx' AS source, unnest(list_filter(list_transform(string_split(regexp_replace(content, '[\x00-\x08\x0b-\x1f\x{fffe}\x{ffff}]', '', 'g'), chr(10)), "
    f"lambda x: {trim('x')}), lambda x: x <> '')) AS p FROM documents WHERE content IS NOT NULL) SELECT source, count(*) AS paragraphs, CAST(sum(length(p)) AS BIGINT) AS characters FROM l GROUP BY source"
)
SQL["csv_records"] = "SELECT doc_id || '.csv' AS source, '记录 1: lang: ' || lang || ', doc_version: ' || doc_version AS content, '1' AS rows FROM documents WHERE lang IS NOT NULL AND doc_version IS NOT NULL"
SQL["file_blocks"] = (
    "WITH b AS (SELECT doc_id, encode(content) AS data, octet_length(encode(content)) AS n FROM documents WHERE content <> ''), i AS (SELECT *, unnest(range(0, (n + 511) // 512)) AS block FROM b), "
    "s AS (SELECT doc_id, block, substr(hex(data), CAST(block * 1024 + 1 AS BIGINT), 1024) AS part FROM i) SELECT CAST(doc_id AS VARCHAR) AS source, block, length(part) // 2 AS bytes, sha256(unhex(part)) AS hash FROM s"
)
SQL["hash_cache"] = "SELECT CAST(doc_id AS VARCHAR) AS source, CASE WHEN doc_id % 2 = 0 AND updated_at IS NOT NULL THEN 'known' ELSE sha256(content) END AS hash FROM documents WHERE content IS NOT NULL"
SQL["hash_lookup"] = f"WITH {_M} SELECT hash, doc_id AS document_id FROM f WHERE size > 0 AND first = doc_id AND hash IN (SELECT sha256(content) FROM documents WHERE lang = 'fr')"
SQL["time_texts"] = "SELECT doc_id, strftime(created_at, '%Y-%m-%dT%H:%M:%S.%fZ') AS text, created_at = created_at AS same, true AS none FROM documents"
SQL["chunk_peek"] = f"SELECT * FROM ({SQL['chunk_buffered']}) WHERE chunk_index < 2"
SQL["score_threshold"] = f"WITH {_H} SELECT query_id, strategy, id FROM h WHERE score >= 0.5"
SQL["route_cascade"] = f"WITH {_H}, b AS (SELECT query_id, min(strategy) AS strategy FROM h GROUP BY query_id) SELECT query_id, id, strategy FROM h JOIN b USING (query_id, strategy)"
SQL["graph_upsert"] = "SELECT DISTINCT id, 'renamed' AS name, 'CONCEPT' AS type FROM entities WHERE CAST(substr(id, 5) AS BIGINT) % 20 = 0 UNION ALL SELECT 'new-1', 'b', 'TOOL'"
SQL["batch_indexing"] = "SELECT count(*) AS total, CAST(count(*) FILTER (coalesce(content, '') = '') AS BIGINT) AS failed, CAST(count(*) FILTER (coalesce(content, '') = '') AS BIGINT) AS errors, CAST(count(*) FILTER (coalesce(content, '') = '') AS BIGINT) AS empty FROM documents"
SQL["rerank_pipeline"] = (
    SCORED.replace("WITH ", "WITH RECURSIVE ", 1) + f", r0 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS n FROM s), m0 AS (SELECT r0.query_id, r0.id, r0.score, {space_tokens('query')} AS qw, {space_tokens('content')} AS cw FROM r0 JOIN q USING (query_id) JOIN d ON r0.id = d.id WHERE n <= 20), "
    "x0 AS (SELECT query_id, id, cw, 0.3 * score + 0.7 * len(list_filter(qw, lambda w: list_contains(cw, w))) / len(qw) AS score FROM m0), m AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS ord FROM x0 QUALIFY ord <= 15)"
    + _mmr(5, 0.5) + "SELECT g.query_id, g.id, round(score, 5) AS score, rank FROM g JOIN m USING (query_id, id)"
)

# Markdown by lines: fences alternate, headings begin sections, and a section's other lines are one paragraph.
_LINES = (
    "l AS (SELECT doc_id, i, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(content, chr(10)) AS ls FROM documents WHERE content IS NOT NULL))), "
    r"f AS (SELECT *, regexp_full_match(line, '[ \t]*```\w*[ \t\r]*') AS fence FROM l), c AS (SELECT *, sum(fence::INT) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM f), "
    r"t AS (SELECT *, CASE WHEN fence OR k % 2 = 1 THEN 'code_block' WHEN regexp_full_match(line, '[ \t]*#{1,6}[ \t]+[^\n]*\S[ \t\r]*') THEN 'heading' WHEN regexp_matches(line, '^[ \t]*[-*+] [ \t]*\S') THEN 'list' WHEN regexp_full_match(line, '[ \t]*(---|\*\*\*|___)[ \t\r]*') THEN 'separator' ELSE 'line' END AS kind FROM c), "
    + f"b AS (SELECT doc_id, min(i) FILTER (kind = 'heading') AS h, min(i) FILTER ({trim('line')} <> '') AS any_ FROM t GROUP BY doc_id), "
    + r"n AS (SELECT t.*, kind = 'heading' AND i = h AND h = any_ AND regexp_matches(line, '^[ \t]*#[ \t]') AS title, sum((kind = 'heading')::INT) OVER (PARTITION BY t.doc_id ORDER BY i) AS section FROM t JOIN b ON t.doc_id = b.doc_id), "
    + r"hs AS (SELECT doc_id, i, section, length(regexp_extract(line, '#+')) AS level, regexp_replace(regexp_replace(line, '^[ \t]*#+[ \t]+', ''), '[ \t\r]+$', '') AS name FROM n WHERE kind = 'heading' AND NOT title)"
)
SQL["markdown_elements"] = (
    f"WITH {_LINES}, e AS (SELECT doc_id, 'heading' AS type, length(name) AS n FROM hs UNION ALL SELECT doc_id, kind, 0 FROM n WHERE kind IN ('list', 'separator') "
    f"UNION ALL SELECT doc_id, 'code_block', length({trim('string_agg(CASE WHEN fence THEN chr(10) ELSE line END, chr(10) ORDER BY i)')}) FROM n WHERE kind = 'code_block' GROUP BY doc_id, (k + 1) // 2 "
    f"UNION ALL SELECT doc_id, 'paragraph', length(p) FROM (SELECT doc_id, {trim('string_agg(' + trim('line') + ', chr(32) ORDER BY i)')} AS p FROM n WHERE kind = 'line' GROUP BY doc_id, section) WHERE p <> '') "
    "SELECT doc_id || '.md' AS source, type, count(*) AS n, CAST(sum(n) AS BIGINT) AS characters FROM e GROUP BY ALL"
)
# A heading's path are the last headings before it of each lower level that no heading of a level as low has followed.
SQL["markdown_sections"] = (
    f"WITH {_LINES}, up AS (SELECT a.doc_id, a.i, a.level, a.name, b.i AS j, b.name AS above FROM hs a JOIN hs b ON a.doc_id = b.doc_id AND b.i <= a.i AND (b.i = a.i OR b.level < a.level) "
    "WHERE NOT EXISTS (SELECT 1 FROM hs x WHERE x.doc_id = a.doc_id AND x.i > b.i AND x.i <= a.i AND x.level <= b.level AND b.i < a.i)) "
    "SELECT doc_id || '.md' AS source, level, name, string_agg(above, ' > ' ORDER BY j) AS path FROM up GROUP BY doc_id, i, level, name"
)
_PARTS = rf"(SELECT doc_id, list_filter(list_transform(regexp_split_to_array(content, '\n{WS}*\n'), lambda x: {trim('x')}), lambda x: x <> '') AS ps FROM documents WHERE content IS NOT NULL)"
SQL["text_rendered"] = f"SELECT doc_id || '.txt' AS source, array_to_string(ps, chr(10) || chr(10)) AS content FROM {_PARTS} WHERE len(ps) > 0"
SQL["text_counts"] = f"SELECT doc_id || '.log' AS source, len(ps) AS paragraphs, 0 AS tables, 0 AS images, CAST(list_sum(list_transform(ps, lambda p: len({words('p')}))) AS BIGINT) AS words FROM {_PARTS} WHERE len(ps) > 0"
SQL["json_files"] = "SELECT doc_id || '.json' AS source, CASE WHEN json_valid(content) THEN CASE json_type(content) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' ELSE 'value' END END AS kind, NOT json_valid(content) AS failed FROM documents WHERE content IS NOT NULL"
SQL["han_tags"] = (
    "WITH w AS (SELECT doc_id, list_filter(['词典', '更新', CASE WHEN lang = 'zh' THEN '快照' ELSE '其' END, lower(lang)], lambda x: x IS NOT NULL AND x <> '') AS ws FROM documents) "
    "SELECT doc_id, i - 1 AS n, ws[i] AS word, CASE ws[i] WHEN '词典' THEN 'n' WHEN '快照' THEN 'n' WHEN '更新' THEN 'v' ELSE 'x' END AS class FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)"
)
_heading = lambda x: f"CASE WHEN octet_length(encode({x})) < 80 AND NOT contains('.!?。！？;；:：', right({x}, 1)) THEN 'heading' ELSE 'paragraph' END"
SQL["pdf_pages"] = (
    f"WITH t AS (SELECT doc_id || '.pdf' AS source, {trim('title')} AS x, coalesce(lang, 'none') AS lang FROM documents WHERE title IS NOT NULL) SELECT source, 1 AS page, {_heading('x')} AS type, x AS text FROM t WHERE x <> '' "
    f"UNION ALL SELECT source, 1, 'paragraph', 'It ends here.' FROM t UNION ALL SELECT source, 2, {_heading(chr(108) + 'ang')}, lang FROM t WHERE lang <> ''"
)
