"""DuckDB SQL for the queries that SQL expresses on whole tables."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

ORACLE["op9_winnowed_line_dedup"] = r"""
WITH bodies AS (
  SELECT doc_id, text, regexp_extract(text, '^[\x20\x09-\x0D]*') AS lead FROM documents
), lines AS (
  SELECT doc_id, CASE generate_subscripts(l, 1) WHEN 1 THEN lead ELSE '' END || unnest(l) AS line, generate_subscripts(l, 1) AS pos
  FROM (SELECT doc_id, lead, string_split(regexp_replace(substr(text, len(lead) + 1), '((?:[.!?] |\n)[\x20\x09-\x0D]*)', '\1' || chr(57344), 'g'), chr(57344)) AS l FROM bodies)
), counted AS (
  SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM lines
), placed AS (
  SELECT *, CAST(sum(n) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS e, e - n AS s FROM counted WHERE n > 0
), framed AS (
  SELECT doc_id, min(pos) OVER f AS a, max(pos) OVER f AS b, list(t) OVER f AS content, sum(n) OVER f AS words
  FROM placed WINDOW f AS (PARTITION BY doc_id ORDER BY s RANGE BETWEEN CURRENT ROW AND 14 FOLLOWING)
  UNION ALL
  SELECT doc_id, min(pos) OVER f, max(pos) OVER f, list(t) OVER f, sum(n) OVER f
  FROM placed WINDOW f AS (PARTITION BY doc_id ORDER BY e RANGE BETWEEN 14 PRECEDING AND CURRENT ROW)
), ranked AS (
  SELECT *, rank() OVER (PARTITION BY content ORDER BY doc_id, a) AS k FROM framed WHERE words >= 15
), gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(a, b)) AS pos FROM ranked WHERE k > 1
), marked AS (
  SELECT c.*, g.pos IS NOT NULL AS gone FROM counted c LEFT JOIN gone g ON g.doc_id = c.doc_id AND g.pos = c.pos
)
SELECT doc_id, coalesce(string_agg(line, '' ORDER BY pos) FILTER (WHERE NOT gone), '') AS text,
       CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS removed_lines,
       CAST(coalesce(sum(n) FILTER (WHERE gone), 0) AS BIGINT) AS removed_words
FROM marked GROUP BY doc_id
UNION ALL SELECT doc_id, NULL, 0, 0 FROM documents WHERE text IS NULL
"""

ORACLE["op1_temporal_url_filter"] = r"""
WITH captures AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST((page_id * 7919) % 366 AS INTEGER) AS d,
         regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1) AS host,
         regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+(/[^?#]*)', 1) AS path
  FROM pages
), hosts AS (
  SELECT DISTINCT host, CAST('0x' || substr(md5(host), 1, 7) AS INTEGER) AS x FROM captures WHERE host <> ''
), changes AS (
  SELECT host AS key, 'add' AS action, DATE '2024-01-01' + x % 200 AS d FROM hosts WHERE x % 3 = 0
  UNION ALL SELECT host, 'remove', DATE '2024-01-01' + x % 200 + 60 FROM hosts WHERE x % 3 = 0 AND x % 2 = 0
  UNION ALL SELECT host, 'add', DATE '2024-01-01' + x % 200 + 120 FROM hosts WHERE x % 3 = 0 AND x % 5 = 0
  UNION ALL SELECT host || '/en', 'add', DATE '2024-01-01' + x % 200 FROM hosts WHERE x % 7 = 0
), held AS (
  SELECT key, d AS since, until FROM (SELECT *, lead(d) OVER (PARTITION BY key ORDER BY d, CASE action WHEN 'remove' THEN 0 ELSE 1 END) AS until FROM changes)
  WHERE action = 'add' AND (until IS NULL OR until > d)
), met AS (
  SELECT c.page_id, c.url, c.d, h.key, h.since, row_number() OVER (PARTITION BY c.page_id ORDER BY length(h.key) DESC, h.since DESC) AS k
  FROM captures c JOIN held h ON (c.host = h.key OR c.host LIKE '%.' || h.key OR (h.key = c.host || '/en' AND (c.path = '/en' OR c.path LIKE '/en/%')))
   AND c.d >= h.since AND (h.until IS NULL OR c.d < h.until)
)
SELECT c.page_id, c.url, strftime(c.d, '%Y-%m-%d') AS fetched_on, m.key IS NOT NULL AS blocked, m.key AS matched_key, strftime(m.since, '%Y-%m-%d') AS listed_on
FROM captures c LEFT JOIN met m ON c.page_id = m.page_id AND m.k = 1
"""

ORACLE["op11_ordered_funnels"] = """
WITH rows AS (
  SELECT DISTINCT client_id, kind, epoch_us(ts) AS t FROM clicks WHERE client_id IS NOT NULL AND kind IS NOT NULL AND ts IS NOT NULL
), nexts AS (
  SELECT *, min(t) FILTER (kind = 'view') OVER w AS view, min(t) FILTER (kind = 'click') OVER w AS click,
         min(t) FILTER (kind = 'purchase') OVER w AS purchase, min(t) FILTER (kind = 'error') OVER w AS error, min(t) FILTER (kind = 'signup') OVER w AS signup
  FROM rows WINDOW w AS (PARTITION BY client_id ORDER BY t RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
), hops AS (
  SELECT client_id, kind, t, 'view' AS target, view AS u, error, signup FROM nexts
  UNION ALL SELECT client_id, kind, t, 'click', click, error, signup FROM nexts
  UNION ALL SELECT client_id, kind, t, 'purchase', purchase, error, signup FROM nexts
), funnels(funnel, k1, k2, k3, k4) AS (
  VALUES ('A', 'view', 'click', 'view', 'purchase'), ('B', 'signup', 'view', 'click', 'purchase'), ('C', 'click', 'click', 'purchase', 'view')
), reach AS (
  SELECT funnel, h.* FROM hops h CROSS JOIN (SELECT funnel FROM funnels) f
  WHERE u - t <= 900000000 AND NOT coalesce(CASE funnel WHEN 'C' THEN signup ELSE error END <= u, false)
), attempts AS (
  SELECT f.funnel, r.client_id, r.t AS a, x.u AS b, y.u AS c, z.u AS d
  FROM funnels f JOIN rows r ON r.kind = f.k1
  LEFT JOIN reach x ON x.funnel = f.funnel AND x.client_id = r.client_id AND x.kind = f.k1 AND x.target = f.k2 AND x.t = r.t
  LEFT JOIN reach y ON y.funnel = f.funnel AND y.client_id = r.client_id AND y.kind = f.k2 AND y.target = f.k3 AND y.t = x.u
  LEFT JOIN reach z ON z.funnel = f.funnel AND z.client_id = r.client_id AND z.kind = f.k3 AND z.target = f.k4 AND z.t = y.u
), sums AS (
  SELECT funnel, client_id, count(*) AS n1, count(b) AS n2, count(c) AS n3, count(d) AS n4,
         CAST(CASE WHEN count(d) > 0 THEN 4 WHEN count(c) > 0 THEN 3 WHEN count(b) > 0 THEN 2 ELSE 1 END AS INTEGER) AS deepest,
         list_sort(list(b - a) FILTER (b IS NOT NULL))[(count(b) + 1) // 2] AS t2,
         list_sort(list(c - b) FILTER (c IS NOT NULL))[(count(c) + 1) // 2] AS t3,
         list_sort(list(d - c) FILTER (d IS NOT NULL))[(count(d) + 1) // 2] AS t4
  FROM attempts GROUP BY funnel, client_id
)
SELECT *, count(*) OVER (PARTITION BY funnel, deepest) AS same_depth FROM sums
"""

ORACLE["op13_ranked_lexical_search"] = r"""
WITH tokens AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), postings AS (
  SELECT doc_id, term, count(*) AS tf FROM tokens GROUP BY doc_id, term
), lengths AS (
  SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM postings GROUP BY doc_id
), totals AS (
  SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM lengths
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * big_n + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM postings CROSS JOIN totals GROUP BY term, big_n
), asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), scored AS (
  SELECT a.item_id, p.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // big_l)))) AS BIGINT) AS score
  FROM asked a JOIN postings p ON p.term = a.term JOIN weights g ON g.term = p.term JOIN lengths l ON l.doc_id = p.doc_id CROSS JOIN totals GROUP BY a.item_id, p.doc_id
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 10
"""

ORACLE["op12_recompressed_substrings"] = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM split
), windows AS (
  SELECT doc_id, i, list(word) OVER f AS content, count(*) OVER f AS n
  FROM words WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)
), first AS (
  SELECT *, min(doc_id) OVER (PARTITION BY content) AS least FROM windows WHERE n = 13
), judged AS (
  SELECT w.doc_id, w.i, w.word, coalesce(max(CASE WHEN f.least < f.doc_id THEN w.i END) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) > 0, false) AS gone
  FROM words w LEFT JOIN first f ON f.doc_id = w.doc_id AND f.i = w.i
), left_over AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM judged GROUP BY doc_id
)
SELECT s.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM split s LEFT JOIN left_over USING (doc_id)
"""
