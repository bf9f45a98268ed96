"""DuckDB SQL for the queries that SQL can express: each by plain joins, not by the method."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TEXT = _LOWER.format("text")

DECONTAMINATION = rf"""
WITH b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all({_TEXT}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, len(g) AS l, array_to_string(g, ' ') AS g FROM (
    SELECT item, unnest(CASE WHEN len(w) >= 13 THEN list_transform(range(1, len(w) - 11), lambda i: w[i:i + 12])
                             WHEN len(w) > 0 THEN [w] ELSE [] END) AS g FROM b)),
lens AS (SELECT DISTINCT l FROM win),
d AS (
  SELECT doc_id, regexp_extract_all({_TEXT}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
places AS (
  SELECT doc_id, l, unnest(list_transform(range(1, len(w) - l + 2),
                                          lambda i: {{'i': i, 'g': array_to_string(w[i:i + l - 1], ' ')}})) AS p
  FROM d, lens WHERE len(w) >= l),
hits AS (SELECT doc_id, p.i AS i, places.l AS l, item FROM places JOIN win ON win.l = places.l AND win.g = p.g),
covered AS (
  SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + l)) AS place FROM hits) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(w), 0) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(m.n, 0) AS n_items,
       sha256(coalesce(m.items, '')) AS items_sha256,
       coalesce(c.n, 0) > 0 AND 20 * coalesce(c.n, 0) >= coalesce(len(w), 0) AS contaminated
FROM d LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN named m ON m.doc_id = d.doc_id
"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({_TEXT}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 5
                               THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                               WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * c >= 85 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, seen) AS (
  SELECT DISTINCT a, a FROM edges UNION SELECT r.node, e.b FROM reach r JOIN edges e ON e.a = r.seen),
lowest AS (SELECT node, min(seen) AS low FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(l.low, d.doc_id) AS component_id,
       d.doc_id = coalesce(l.low, d.doc_id) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN lowest l ON l.node = d.doc_id
"""

# SHA-1 has 160 bits: eight groups of five hex digits, each of four base32 digits.
WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
newest AS (SELECT html, max(page_id) AS last FROM p GROUP BY html)
SELECT page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((CAST('0x' || substr(h, 5 * (k // 4) + 1, 5) AS BIGINT) >> CAST(15 - 5 * (k % 4) AS BIGINT)) & 31), 1)), '')
         AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM p JOIN newest ON newest.html = p.html
"""


def _escaped(column: str) -> str:
    return rf"replace(replace({column}, '\', '\\'), '<|', '<\|')"


_MARK = "'<|im_end|><|im_start|>assistant ok'"
# A turn has 24 characters of marks: 12 before the role, a line break, 10 and a line break at the end.
CHAT = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r, text AS x FROM conversations
  UNION ALL SELECT -1, 0, 'user', {_MARK}, 'user', {_MARK}
  UNION ALL SELECT -1, 1, 'assistant', {_MARK}, 'assistant', {_MARK})
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, r, x)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, r, x) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(24 + length(replace({_escaped("role")}, chr(10), '\n')) + length({_escaped("text")})) AS BIGINT)
         AS formatted_chars
FROM t GROUP BY conv_id
"""

ORACLES = {
    "op7_decontamination": DECONTAMINATION,
    "op8_near_duplicates": NEAR_DUPLICATES,
    "op9_warc": WARC,
    "op10_chat_format": CHAT,
}
