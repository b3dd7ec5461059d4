"""Queries of this subpackage, by name, and their SQL where SQL can express them.

Without SQL, and held against brute force in tests/llm instead: op2 (which
documents get a further copy follows a hash), op7 (a trained model), op8
(CRC-32 and the stored image), op9 and op10 (BPE).
"""

from __future__ import annotations

from quintet.llm import decontaminate, linededup, lmscore, media, mixing, neardup, tokencounts, tokenids, toxicity, warc

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_mixing": mixing.op2_mixing,
    "op3_line_dedup": linededup.op3_line_dedup,
    "op4_near_dedup": neardup.op4_near_dedup,
    "op5_warc": warc.op5_warc,
    "op6_lm_score": lmscore.op6_lm_score,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_media": media.op8_media,
    "op9_token_ids": tokenids.op9_token_ids,
    "op10_token_counts": tokencounts.op10_token_counts,
}

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
TEXT = LOWER.format("coalesce(text, '')")
WORDS = rf"regexp_extract_all({TEXT}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
WIDE = rf"regexp_extract_all({TEXT}, '[^\x20\x09-\x0D]+')"

DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
b AS (SELECT item_id, {WORDS} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS key FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) r(i) WHERE len(w) > 0),
places AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS key FROM d, (SELECT DISTINCT n FROM windows), unnest(range(1, len(w) - n + 2)) r(i) WHERE len(w) >= n),
hits AS (SELECT doc_id, i, n, item_id FROM places JOIN windows USING (key, n)),
marked AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM hits, unnest(range(0, n)) r(j) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS listed FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN marked USING (doc_id) LEFT JOIN items USING (doc_id)
"""

LINE_DEDUP = rf"""
WITH lines AS (SELECT doc_id, pos, line, {LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
frequent AS (SELECT key, max(doc_id) AS last FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (SELECT l.doc_id, pos, line, f.key IS NOT NULL AND l.doc_id <> f.last AS gone FROM lines l LEFT JOIN frequent f ON f.key = l.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM judged GROUP BY doc_id
"""

NEAR_DEDUP = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WIDE} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS key FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.key = b.key AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT u, v FROM l UNION SELECT v, u FROM l),
r AS (SELECT doc_id AS u, doc_id AS v FROM d UNION SELECT r.u, e.v FROM r JOIN e ON e.u = r.v),
c AS (SELECT u AS doc_id, min(v) AS component_id FROM r GROUP BY u)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""

BITS = "CAST(CAST(unhex(sha1(p)) AS BIT) AS VARCHAR)"
DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + " + " + ".join(f"CASE WHEN substr({BITS}, CAST(5 * i + {k + 1} AS BIGINT), 1) = '1' THEN {16 >> k} ELSE 0 END" for k in range(5)) + ", 1)"
WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS p FROM pages),
g AS (SELECT page_id, p, max(page_id) OVER (PARTITION BY p) AS first FROM p)
SELECT page_id, CAST(strlen(p) AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: {DIGIT}), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM g
"""

LM_SCORE = f"""
WITH d AS (SELECT doc_id, {WIDE} AS w FROM documents),
t AS (SELECT doc_id, w[i] AS x, CASE WHEN i > 1 THEN w[i - 1] END AS c, CASE WHEN i > 2 THEN w[i - 2] END AS e FROM d, unnest(range(1, len(w) + 1)) r(i)),
total AS (SELECT count(*) AS n FROM t),
size AS (SELECT doc_id, count(*) AS n FROM t GROUP BY 1),
u AS (SELECT x, count(*) AS n FROM t GROUP BY 1),
u_own AS (SELECT doc_id, x, count(*) AS n FROM t GROUP BY 1, 2),
b AS (SELECT c, x, count(*) AS n FROM t WHERE c IS NOT NULL GROUP BY 1, 2),
b_own AS (SELECT doc_id, c, x, count(*) AS n FROM t WHERE c IS NOT NULL GROUP BY 1, 2, 3),
g AS (SELECT e, c, x, count(*) AS n FROM t WHERE e IS NOT NULL GROUP BY 1, 2, 3),
g_own AS (SELECT doc_id, e, c, x, count(*) AS n FROM t WHERE e IS NOT NULL GROUP BY 1, 2, 3, 4),
k AS (SELECT t.doc_id, t.c, t.e, u.n - uo.n AS n_x, cu.n - cuo.n AS n_c, coalesce(b.n - bo.n, 0) AS n_b, coalesce(cb.n - cbo.n, 0) AS n_ec, coalesce(g.n - go.n, 0) AS n_g, greatest(1, total.n - size.n) AS rest
  FROM t CROSS JOIN total JOIN size ON size.doc_id = t.doc_id JOIN u ON u.x = t.x JOIN u_own uo ON uo.doc_id = t.doc_id AND uo.x = t.x
  LEFT JOIN u cu ON cu.x = t.c LEFT JOIN u_own cuo ON cuo.doc_id = t.doc_id AND cuo.x = t.c
  LEFT JOIN b ON b.c = t.c AND b.x = t.x LEFT JOIN b_own bo ON bo.doc_id = t.doc_id AND bo.c = t.c AND bo.x = t.x
  LEFT JOIN b cb ON cb.c = t.e AND cb.x = t.c LEFT JOIN b_own cbo ON cbo.doc_id = t.doc_id AND cbo.c = t.e AND cbo.x = t.c
  LEFT JOIN g ON g.e = t.e AND g.c = t.c AND g.x = t.x LEFT JOIN g_own go ON go.doc_id = t.doc_id AND go.e = t.e AND go.c = t.c AND go.x = t.x),
l1 AS (SELECT *, ln(greatest(n_x, CAST(0.5 AS DOUBLE)) / rest) AS s1 FROM k),
l2 AS (SELECT *, CASE WHEN c IS NULL THEN s1 WHEN n_b > 0 THEN ln(n_b / CAST(n_c AS DOUBLE)) ELSE ln(CAST(0.4 AS DOUBLE)) + s1 END AS s2 FROM l1),
s AS (SELECT doc_id, CASE WHEN c IS NULL THEN n_x > 0 WHEN e IS NULL THEN n_b > 0 ELSE n_g > 0 END AS seen,
  CASE WHEN e IS NULL THEN s2 WHEN n_g > 0 THEN ln(n_g / CAST(n_ec AS DOUBLE)) ELSE ln(CAST(0.4 AS DOUBLE)) + s2 END AS l FROM l2)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, count(*) FILTER (seen) AS n_seen, round(coalesce(sum(l), 0), 6) AS log_prob, round(CASE WHEN len(w) > 0 THEN sum(l) / len(w) END, 6) AS score
FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id, len(w)
"""

ORACLE_SQL = {
    "op1_decontaminate": DECONTAMINATE.strip(),
    "op3_line_dedup": LINE_DEDUP.strip(),
    "op4_near_dedup": NEAR_DEDUP.strip(),
    "op5_warc": WARC.strip(),
    "op6_lm_score": LM_SCORE.strip(),
}
