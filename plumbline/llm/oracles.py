"""SQL twins of the operators' queries that SQL can express, for an independent engine."""

from __future__ import annotations

#: Equal payloads share the largest page_id's response; the digest is base32 over each five hex digits.
WARC = """
WITH p AS (SELECT page_id, COALESCE(url, '') AS url, COALESCE(html, '') AS html FROM pages),
d AS (SELECT page_id, url, CAST(STRLEN(html) AS BIGINT) AS payload_bytes, SHA1(html) AS hex, MAX(page_id) OVER (PARTITION BY SHA1(html)) AS latest FROM p)
SELECT page_id, payload_bytes,
    ARRAY_TO_STRING(LIST_TRANSFORM(RANGE(0, 32), lambda i: SUBSTRING('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        CAST(((CAST('0x' || SUBSTRING(hex, CAST(5 * (i // 4) + 1 AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1 AS INT), 1)), '') AS payload_digest,
    CASE WHEN page_id = latest THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> latest THEN latest END AS refers_to, url
FROM d
"""

#: Turns in order; the template's marks have 12, 10 and 10 characters, and no token crosses one.
CHAT = r"""
WITH t AS (
    SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
f AS (SELECT *, LENGTH(REGEXP_REPLACE(text, '<(\\*)\|', '<\1\\|', 'g')) + LENGTH(role) + 32 AS n FROM t),
g AS (
    SELECT conv_id, COUNT(*) AS n_turns, STRING_AGG(role || CHR(10) || text || CHR(10), '' ORDER BY turn NULLS FIRST, role, text) AS whole,
        COALESCE(STRING_AGG(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss, CAST(SUM(n) AS BIGINT) AS formatted_chars
    FROM f GROUP BY conv_id)
SELECT conv_id, n_turns, SHA256(whole) AS turns_sha256, CAST(LENGTH(loss) AS BIGINT) AS loss_chars, SHA256(loss) AS loss_sha256, formatted_chars, CAST(0 AS BIGINT) AS crossing_tokens FROM g
"""

#: Shingle sets, all pairs that share one, and the closure of the links.
NEAR_DUPLICATES = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, LIST_FILTER(REGEXP_SPLIT_TO_ARRAY(TRANSLATE(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
    FROM documents),
s AS (
    SELECT doc_id, UNNEST(CASE WHEN LEN(ws) >= 5 THEN LIST_DISTINCT(LIST_TRANSFORM(RANGE(1, LEN(ws) - 3), lambda i: ARRAY_TO_STRING(ws[i:i + 4], ' ')))
        WHEN LEN(ws) > 0 THEN [ARRAY_TO_STRING(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id WHERE r.root < e.b),
c AS (SELECT id, MIN(root) AS component_id FROM r GROUP BY 1)
SELECT doc_id, COALESCE(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM documents JOIN c ON c.id = doc_id LEFT JOIN n USING (doc_id)
"""
