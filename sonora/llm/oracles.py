"""The same rows in DuckDB's SQL, for operators whose whole result SQL can state; by the definition, not by the method."""

from __future__ import annotations

import string

_SAID = "<|im_end|><|im_start|>assistant ok"

CHATS = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '{_SAID}'), (-1, 1, 'assistant', '{_SAID}')),
e AS (SELECT *, replace(replace(role, '\', '\\'), chr(10), '\n') AS shown FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum({len("<|im_start|>") + len("<|im_end|>") + 2} + length(shown) + len(regexp_extract_all(shown, '<\\*\|')) + length(text) + len(regexp_extract_all(text, '<\\*\|')))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def links(n: int = 4, percent: int = 85) -> str:
    """Components of documents by the Jaccard similarity of their word shingles: all pairs that share one are counted."""
    shingle = " || ' ' || ".join(f"w[i + {k}]" for k in range(n))
    return rf"""
    WITH RECURSIVE d AS (SELECT row_number() OVER () AS line, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT line, doc_id, CASE WHEN len(w) >= {n} THEN list_distinct(list_transform(range(1, len(w) - {n - 2}), lambda i: {shingle})) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM d),
    e AS (SELECT line, unnest(g) AS x FROM s), often AS (SELECT x FROM e GROUP BY x HAVING count(*) > 1), k AS (SELECT e.* FROM e JOIN often USING (x)),
    p AS (SELECT a.line AS u, b.line AS v, count(*) AS n FROM k a JOIN k b ON a.x = b.x AND a.line < b.line GROUP BY ALL),
    l AS (SELECT p.u, p.v FROM p JOIN s a ON a.line = p.u JOIN s b ON b.line = p.v WHERE 100 * p.n >= {percent} * (len(a.g) + len(b.g) - p.n)),
    both_ AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
    r AS (SELECT u, v FROM both_ UNION SELECT r.u, b.v FROM r JOIN both_ b ON b.u = r.v),
    least_ AS (SELECT r.u AS line, min(s.doc_id) AS m FROM r JOIN s ON s.line = r.v GROUP BY r.u)
    SELECT doc_id, len(g)::BIGINT AS n_shingles, coalesce(least(doc_id, m), doc_id) AS component_id FROM s LEFT JOIN least_ USING (line)
    """


def repeats(length: int = 200) -> str:
    """Documents without the bytes that a string of ``length`` bytes covers which starts twice: all starts are counted."""
    return f"""
    WITH h AS (SELECT row_number() OVER () AS line, doc_id, encode(coalesce(text, '')) AS x FROM documents),
    w AS (SELECT line, unnest(range(0, octet_length(x) - {length - 1})) AS i, x FROM h WHERE octet_length(x) >= {length}),
    k AS (SELECT line, i, md5(x[i + 1:i + {length}]) AS m FROM w),
    often AS (SELECT m FROM k GROUP BY m HAVING count(*) > 1),
    f AS (SELECT line, i, i > lag(i) OVER (PARTITION BY line ORDER BY i) + {length} AS apart FROM k JOIN often USING (m)),
    n AS (SELECT line, i, sum(coalesce(apart, false)::INT) OVER (PARTITION BY line ORDER BY i) AS run FROM f),
    r AS (SELECT line, min(i) AS a, max(i) + {length} AS b FROM n GROUP BY line, run),
    g AS (SELECT r.*, coalesce(lag(b) OVER (PARTITION BY line ORDER BY a), 0) AS before, lead(a) OVER (PARTITION BY line ORDER BY a) IS NULL AS last FROM r),
    t AS (SELECT g.line, sum(b - a)::BIGINT AS cut, count(*) AS spans, string_agg(hex(x[before + 1:a]) || CASE WHEN last THEN hex(x[b + 1:]) ELSE '' END, '' ORDER BY a) AS kept FROM g JOIN h USING (line) GROUP BY g.line)
    SELECT doc_id, octet_length(x)::BIGINT AS n_bytes, coalesce(cut, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(CASE WHEN kept IS NULL THEN x ELSE unhex(kept) END) AS kept_sha256 FROM h LEFT JOIN t USING (line)
    """


def periodic(min_exp: int = 4, least: int = 6) -> str:
    """Runs of all documents by definition: every pair of equal words is a place of its distance, unbroken places are stretches."""
    return rf"""
    WITH crc AS (SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x::UBIGINT, list_transform(range(8), lambda k: 0::UBIGINT)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END)) AS t),
    h AS (SELECT row_number() OVER () AS line, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
                 xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::UBIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::INT + 1]))) AS h FROM documents, crc),
    g AS (SELECT line, doc_id, w, h, len(w) AS n, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM h),
    d AS (SELECT line, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[(a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1)::BIGINT] END) ELSE w END AS w FROM g),
    e AS (SELECT line, n, unnest(w) AS x, unnest(range(n)) AS i FROM d),
    p AS (SELECT a.line, a.i, b.i - a.i AS q FROM e a JOIN e b ON a.line = b.line AND a.x = b.x AND a.i < b.i WHERE {min_exp} * (b.i - a.i) <= a.n),
    s AS (SELECT line, q, i, i - row_number() OVER (PARTITION BY line, q ORDER BY i) AS island FROM p),
    l AS (SELECT line, q, min(i) AS start, count(*) + q AS length FROM s GROUP BY line, q, island HAVING count(*) + q >= greatest({least}, {min_exp} * q)),
    r AS (SELECT line, start, length, min(q) AS q FROM l GROUP BY ALL),
    m AS (SELECT DISTINCT line, unnest(range(start + q, start + length)) AS i FROM r),
    k AS (SELECT e.line, string_agg(x, ' ' ORDER BY e.i) AS kept FROM e ANTI JOIN m ON e.line = m.line AND e.i = m.i GROUP BY e.line),
    b AS (SELECT line, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS told FROM r GROUP BY line),
    f AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM r o WHERE o.line = r.line AND (o.length * r.q > r.length * o.q OR (o.length * r.q = r.length * o.q AND (o.start, o.q) < (r.start, r.q)))))
    SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, f.start::BIGINT AS start, f.length::BIGINT AS length, f.q::BIGINT AS period, (1000 * f.length // f.q)::BIGINT AS exponent_milli,
           sha256(coalesce(told, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256, n::BIGINT AS n_words
    FROM d LEFT JOIN b USING (line) LEFT JOIN f USING (line) LEFT JOIN k USING (line)
    """
