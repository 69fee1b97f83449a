"""SQL for the training-data queries whose result SQL can state over whole tables."""

from __future__ import annotations

_LATEST = "QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY {t} DESC) = 1"
_WORDS = "regexp_extract_all(lower({c}), '[a-z0-9]+')"

P1 = f"""
WITH cur AS (SELECT * FROM chunks {_LATEST.format(k="chunk_id", t="ingested_at")}),
meta AS (SELECT * FROM chunk_metadata {_LATEST.format(k="chunk_id", t="ingested_at")}),
w AS (SELECT c.chunk_id, m.document_id, {_WORDS.format(c="c.content")} AS w FROM cur c JOIN meta m USING (chunk_id) WHERE c.level = 2 AND m.document_id IS NOT NULL AND c.content IS NOT NULL),
s AS (SELECT DISTINCT chunk_id, document_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 20)),
n AS (SELECT chunk_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.chunk_id AS chunk_id_1, b.chunk_id AS chunk_id_2, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.chunk_id < b.chunk_id AND a.document_id <> b.document_id GROUP BY 1, 2)
SELECT chunk_id_1, chunk_id_2 FROM p JOIN n x ON x.chunk_id = chunk_id_1 JOIN n y ON y.chunk_id = chunk_id_2 WHERE 5 * o >= 3 * (x.n + y.n - o)
"""

P4 = f"""
WITH cur AS (SELECT * FROM sections {_LATEST.format(k="doc_id, section_no", t="parsed_at")}),
c AS (SELECT doc_id, section_no, content, level_1_size, level_2_size FROM cur JOIN chunk_config k ON coalesce(cur.config_id, 'default') = k.config_id WHERE length(content) > 0),
l AS (SELECT doc_id, section_no, unnest(range(1, len(x) + 1)) AS n, regexp_replace(unnest(x), '^\\s+|\\s+$', '', 'g') AS s FROM (SELECT doc_id, section_no, string_split(content, chr(10)) AS x FROM c)),
f AS (SELECT *, coalesce(sum(starts_with(s, '```')::INT) OVER (PARTITION BY doc_id, section_no ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS inside FROM l),
g AS (SELECT *, sum((s = '' AND NOT inside)::INT) OVER (PARTITION BY doc_id, section_no ORDER BY n) AS par FROM f),
p AS (SELECT doc_id, section_no, max(size) AS p FROM (SELECT doc_id, section_no, par, sum(length(s)) + max(n) - min(n) AS size FROM g WHERE s <> '' GROUP BY 1, 2, 3) GROUP BY 1, 2),
u AS (SELECT doc_id, section_no, max(length(s)) AS l, max(list_max(list_transform(string_split(regexp_replace(s, '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10)), lambda x: length(x)))) AS s, max(list_max(list_transform(regexp_split_to_array(s, '\\s+'), lambda x: length(x)))) AS w FROM l GROUP BY 1, 2),
v AS (SELECT c.doc_id, c.section_no, unnest([1, 2]) AS level, unnest([level_1_size, level_2_size]) AS size, length(content) // 4 AS whole, coalesce(p.p, 0) AS p, u.l, u.s, u.w FROM c LEFT JOIN p USING (doc_id, section_no) JOIN u USING (doc_id, section_no))
SELECT doc_id, section_no, level::INT AS level, CASE WHEN p // 4 <= size THEN 'paragraph' WHEN l // 4 <= size THEN 'line' WHEN s // 4 <= size THEN 'sentence' WHEN w // 4 <= size THEN 'word' ELSE 'character' END AS cut_at FROM v WHERE whole > size
"""

P7 = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(c="text")} AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, {_WORDS.format(c="text")} AS w FROM eval_items WHERE text IS NOT NULL),
x AS (SELECT DISTINCT item_id, array_to_string(w[k : k + 11], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 10)) AS k FROM i WHERE len(w) >= 12)),
y AS (SELECT doc_id, array_to_string(w[k : k + 11], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 10)) AS k FROM d WHERE len(w) >= 12))
SELECT DISTINCT doc_id, item_id FROM y JOIN x USING (g)
"""

SQL = {"p1_found": P1, "p4_found": P4, "p7_found": P7}
