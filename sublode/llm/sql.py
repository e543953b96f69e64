"""DuckDB SQL of the training-data queries that SQL can express."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

#: SHA-1 in hexadecimal to base32: five hexadecimal digits are four base32 ones.
_DIGIT = f"substr('{BASE32}', (v >> {{}}) % 32 + 1, 1)"
_B32 = "array_to_string(list_transform(list_transform(range(8), lambda i: CAST('0x' || substr(x, CAST(5 * i + 1 AS INT), 5) AS BIGINT)), lambda v: " + " || ".join(_DIGIT.format(s) for s in (15, 10, 5, 0)) + "), '')"

OP5 = f"""
WITH w AS (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS m, sha1(coalesce(html, '')) AS x, row_number() OVER (PARTITION BY coalesce(html, ''), page_id ORDER BY url) AS k FROM pages)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, {_B32} AS payload_digest, CASE WHEN page_id = m AND k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> m OR k > 1 THEN m END AS refers_to FROM w
"""

_SPACE = r"[ \t\n\x0B\f\r]"
_WORDS = r"regexp_extract_all(t, '[^ \t\n\x0B\f\r]+')"

OP7 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, source FROM documents),
w AS (SELECT doc_id, source, t, {_WORDS} AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) AS lines FROM d),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM r) GROUP BY doc_id),
l AS (SELECT source, t, line FROM (SELECT source, t, trim(regexp_replace(translate(x, '{UPPER}', '{LOWER}'), '{_SPACE}+', ' ', 'g')) AS line FROM (SELECT source, t, unnest(string_split(t, chr(10))) AS x FROM (SELECT DISTINCT source, t FROM d))) WHERE line <> ''),
f AS (SELECT source, line, count(DISTINCT t) AS n FROM l GROUP BY source, line), h AS (SELECT source, count(DISTINCT t) AS n FROM l GROUP BY source),
lost AS (SELECT l.source, l.t, sum(len(string_split(l.line, ' '))) AS n FROM l JOIN f ON l.source IS NOT DISTINCT FROM f.source AND l.line = f.line JOIN h ON h.source IS NOT DISTINCT FROM f.source WHERE f.n > 5 AND f.n > h.n * 0.05 GROUP BY l.source, l.t),
s AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(w.t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS removed_words FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN lost ON w.source IS NOT DISTINCT FROM lost.source AND w.t = lost.t)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT (removed_words > 0 AND (n_words - removed_words < 10 OR n_words - removed_words < 0.1 * n_words)) AS kept, removed_words FROM s
"""

_BENCH = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP8 = f"""
WITH b AS (SELECT item_id, {_BENCH} AS w FROM benchmark WHERE item_id IS NOT NULL), bk AS (SELECT item_id, w, least(len(w), 10) AS k FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g FROM bk),
d AS (SELECT doc_id, {_BENCH} AS w FROM documents), sizes AS (SELECT DISTINCT k FROM win),
dg AS (SELECT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k),
hit AS (SELECT doc_id, i, dg.k, item_id FROM dg JOIN win ON dg.k = win.k AND dg.g = win.g),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS x FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(x, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

SQL = {"op5_warc": OP5, "op7_quality_rules": OP7, "op8_decontamination": OP8}
