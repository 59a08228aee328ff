"""SQL of those pN_ queries that SQL can state; the others are tested against brute force in tests/llm."""

from __future__ import annotations

#: RE2 has no class difference: Han characters are set apart by spaces first.
_WORDS = r"regexp_extract_all(regexp_replace(lower(coalesce(content, '')), '(\p{Han})', ' \1 ', 'g'), '[\p{L}\p{N}]+')"

P3 = r"""
WITH folded AS (
  SELECT doc_id, replace(replace(lower(content), 'ß', 'ss'), 'ς', 'σ') AS c FROM documents WHERE content IS NOT NULL),
parts AS (
  SELECT doc_id, c, list_filter(regexp_split_to_array(c, '[\r\n]+'), lambda x: regexp_matches(x, '[\p{L}\p{N}]')) AS lines,
         CASE WHEN regexp_matches(c, '(?s)^\s*\{.*\}\s*$') AND json_valid(c) THEN json_keys(c) END AS fields FROM folded),
bare AS (
  SELECT doc_id, CASE
    WHEN fields IS NOT NULL THEN array_to_string(list_sort(list_transform(fields, lambda k: regexp_replace(k || ':' || json_extract(c, '$."' || k || '"'), '[^\p{L}\p{N}\p{M}]+', '', 'g'))), '')
    WHEN len(lines) > 1 AND len(list_filter(lines, lambda x: NOT regexp_matches(x, '(?s)^\s*[\p{L}\p{N}][\p{L}\p{N}_ \t-]*[:：](\s.*)?$'))) = 0
      THEN array_to_string(list_sort(list_transform(lines, lambda x: regexp_replace(x, '[^\p{L}\p{N}\p{M}]+', '', 'g'))), '')
    ELSE regexp_replace(c, '[^\p{L}\p{N}\p{M}]+', '', 'g') END AS k FROM parts),
first AS (SELECT k, min(doc_id) AS first_doc_id FROM bare WHERE regexp_matches(k, '[\p{L}\p{N}]') GROUP BY k)
SELECT DISTINCT first_doc_id, doc_id FROM bare JOIN first USING (k) WHERE doc_id <> first_doc_id
"""

P3_COLLAPSE = (
    P3.split("first AS (", 1)[0].rstrip().rstrip(",")
    + r" SELECT min(doc_id) AS doc_id, count(*) AS copies FROM bare WHERE regexp_matches(k, '[\p{L}\p{N}]') GROUP BY k UNION ALL SELECT doc_id, 1 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM bare WHERE regexp_matches(k, '[\p{L}\p{N}]'))"
)

P4 = """
WITH latest AS (
  SELECT id, arg_max(coalesce(CAST(vector AS DOUBLE[]), TRY_CAST(embedding AS DOUBLE[])), created_at) AS v FROM vectors GROUP BY id),
fine AS (
  SELECT id, v FROM latest WHERE len(v) = 64 AND len(list_filter(v, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(v, lambda x: x <> 0)) > 0),
near AS (
  SELECT a.id AS id, b.id AS neighbour, list_cosine_similarity(a.v, b.v) AS s,
         row_number() OVER (PARTITION BY a.id ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.id) AS n
  FROM fine a JOIN fine b ON a.id <> b.id),
top AS (SELECT id, neighbour FROM near WHERE n <= 5 AND s >= 0.93)
SELECT x.id AS id_a, x.neighbour AS id_b FROM top x JOIN top y ON x.id = y.neighbour AND x.neighbour = y.id WHERE x.id < x.neighbour
"""

P4_NEIGHBOURS = P4.split("top AS (", 1)[0].rstrip().rstrip(",").replace("ORDER BY list_cosine_similarity(a.v, b.v) DESC", "ORDER BY round(list_cosine_similarity(a.v, b.v), 12) DESC") + " SELECT id, neighbour, n AS rank, round(s, 6) AS similarity FROM near WHERE n <= 5"

P6 = f"""
WITH r AS (
  SELECT 'chunks' AS table_name, id AS record_id, any_value(content) AS content FROM chunks WHERE id IS NOT NULL GROUP BY id
  UNION ALL
  SELECT 'tsvector_index', doc_id, any_value(content) FROM tsvector_index WHERE doc_id IS NOT NULL GROUP BY doc_id),
t AS (SELECT table_name, record_id, unnest({_WORDS}) AS term FROM r),
tf AS (SELECT table_name, record_id, term, count(*) AS tf FROM t GROUP BY ALL),
df AS (SELECT *, count(*) OVER (PARTITION BY table_name, term) AS df FROM tf)
SELECT table_name, record_id, term FROM df WHERE tf >= 3 AND df BETWEEN 2 AND 8 AND length(term) >= 5 AND NOT regexp_matches(term, '\\p{{Han}}')
"""

P7 = """
WITH latest AS (
  SELECT query_id, strategy, id, arg_max(score, retrieved_at) AS best, max(retrieved_at) AS t FROM retrieval_results GROUP BY ALL),
rows_ AS (
  SELECT DISTINCT r.query_id, r.strategy, r.id, r.score, r.profile FROM retrieval_results r
  JOIN latest l ON r.query_id = l.query_id AND r.strategy = l.strategy AND r.id = l.id AND r.retrieved_at = l.t),
counted AS (
  SELECT r.* FROM rows_ r LEFT JOIN hybrid_options o ON r.profile = o.profile
  WHERE r.score IS NOT NULL AND NOT isnan(r.score) AND coalesce(o.weights[r.strategy], 1) > 0),
places AS (
  SELECT *, rank() OVER (PARTITION BY query_id, strategy ORDER BY score DESC) AS place, count(*) OVER (PARTITION BY query_id, strategy, score) AS ties FROM counted),
firsts AS (SELECT query_id, id, count(*) AS firsts FROM places WHERE place = 1 AND ties = 1 GROUP BY ALL),
routes AS (SELECT query_id, count(DISTINCT strategy) AS routes FROM counted GROUP BY ALL)
SELECT query_id, id FROM firsts JOIN routes USING (query_id) WHERE firsts = routes AND routes > 1
"""


def oracle_sql() -> dict[str, str]:
    return {"p3_found": P3, "p3_collapse": P3_COLLAPSE, "p4_neighbours": P4_NEIGHBOURS, "p4_found": P4, "p6_found": P6, "p7_found": P7}
