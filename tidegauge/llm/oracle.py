"""DuckDB twins of the queries that SQL can express, for small tables."""

from __future__ import annotations

from .licenses import TEMPLATES

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

WARC_AUDIT = r"""
WITH src AS (
  SELECT page_id AS key, coalesce(url, '') AS u, coalesce(html, '') AS h,
         md5(concat_ws(chr(31), coalesce(CAST(page_id AS VARCHAR), '-'), coalesce(url, ''))) AS m
  FROM pages
), rec AS (
  SELECT key, h, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:uuid:'
    || m[1:8] || '-' || m[9:12] || '-' || m[13:16] || '-' || m[17:20] || '-' || m[21:32] || '>' || chr(13) || chr(10)
    || 'WARC-Date: 2024-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Target-URI: ' || u || chr(13) || chr(10)
    || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(h) || chr(13) || chr(10) || chr(13) || chr(10) || h AS r
  FROM src
), placed AS (SELECT key, h, CAST(strlen(r) + 4 AS BIGINT) AS length, sha256(r) AS digest FROM rec)
SELECT key AS page_id, CAST(sum(length) OVER (ORDER BY key, digest ROWS UNBOUNDED PRECEDING) - length AS BIGINT) AS "offset", length, digest,
       CASE WHEN key % 101 = 7 AND h <> '' AND h[1] <> '~' THEN 'corrupt' ELSE 'intact' END AS status
FROM placed
"""

LINE_DEDUP = rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT doc_id, pos, line, {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l),
bad AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE b.key IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE b.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN bad b ON k.key = b.key GROUP BY doc_id
"""

DECONTAMINATION = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_ITEM_WORD}') AS ws FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_ITEM_WORD}') AS ws FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, size, array_to_string(ws[p:p + size - 1], ' ') AS win
  FROM (SELECT item_id, ws, least(10, len(ws)) AS size, unnest(range(1, CAST(len(ws) - least(10, len(ws)) + 2 AS BIGINT))) AS p FROM i WHERE len(ws) > 0)
), sizes AS (SELECT DISTINCT size FROM iw),
dw AS (
  SELECT doc_id, size, p, array_to_string(ws[p:p + size - 1], ' ') AS win
  FROM (SELECT doc_id, ws, size, unnest(range(1, CAST(len(ws) - size + 2 AS BIGINT))) AS p FROM w, sizes WHERE len(ws) >= size)
), hit AS (SELECT doc_id, p, size, item_id FROM dw JOIN iw USING (size, win)),
covered AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + size)) AS q FROM hit) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(f.n, 0) AS n_items, sha256(coalesce(f.ids, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM w LEFT JOIN covered c USING (doc_id) LEFT JOIN found f USING (doc_id)
"""

JACCARD = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[p:p + 4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, CAST(len(ws) AS BIGINT) - 4) + 1)) AS p FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS n_both FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT u, v FROM pairs JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * n_both >= 75 * (x.n + y.n - n_both)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.v FROM reach r JOIN links l ON r.b = l.u)
SELECT a AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(b) AS component_id FROM reach LEFT JOIN n ON n.doc_id = a GROUP BY a
"""

_TEMPLATE_ROWS = ",\n".join(f"('{name}', '{text.replace(chr(39), chr(39) * 2)}')" for name in sorted(TEMPLATES) for text in TEMPLATES[name])
_WORDS = f"regexp_extract_all({_LOWER.format('t')}, '{_ITEM_WORD}')"
LICENSES = rf"""
WITH tpl(license, t) AS (VALUES {_TEMPLATE_ROWS}),
tg AS (SELECT license, list_distinct([ws[i] || ' ' || ws[i + 1] FOR i IN range(1, CAST(len(ws) AS BIGINT))]) AS g FROM (SELECT license, {_WORDS} AS ws FROM tpl)),
seg AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS t, 'line' AS kind, FROM documents
  UNION ALL SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '\n[\x20\x09\x0B-\x0D]*\n')), 'paragraph' FROM documents
  UNION ALL SELECT doc_id, coalesce(text, ''), 'text' FROM documents
), sg AS (SELECT doc_id, kind, list_distinct([ws[i] || ' ' || ws[i + 1] FOR i IN range(1, CAST(len(ws) AS BIGINT))]) AS g FROM (SELECT doc_id, kind, {_WORDS} AS ws FROM seg) WHERE len(ws) > 1),
m AS (
  SELECT doc_id, license, 2 * len(list_intersect(sg.g, tg.g)) / (len(sg.g) + len(tg.g)) AS dice
  FROM sg JOIN tg ON len(sg.g) * 0.9 <= 1.1 * len(tg.g) + 1e-9 AND len(tg.g) * 0.9 <= 1.1 * len(sg.g) + 1e-9
), best AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS ls, max(dice) AS d FROM m WHERE dice >= 0.9 GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_matches, coalesce(ls, '') AS licenses, round(coalesce(d, 0.0), 6) AS best_dice FROM documents d LEFT JOIN best USING (doc_id)
"""
