"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"

_DECONTAMINATE = f"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS words
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM items WHERE len(w) > 0)
),
docs AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
places AS (
  SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS words
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM docs),
       (SELECT DISTINCT size FROM windows) WHERE i + size - 1 <= len(w)
),
found AS (SELECT p.doc_id, p.i, p.size, x.item_id FROM places p JOIN windows x USING (size, words)),
hit AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS j FROM found) GROUP BY doc_id
),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

_URL_RULES = r"""
WITH rules(host, path, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')
),
parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN url[strpos(url, '://') + 3 :] END AS rest FROM pages
),
hosts AS (SELECT page_id, coalesce(regexp_extract(rest, '^([^/?#]*)([^?#]*)', ['host', 'path']), {'host': '', 'path': ''}) AS p
          FROM parts),
split AS (
  SELECT page_id, translate(p.host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, p.path AS path
  FROM hosts
),
ranked AS (
  SELECT s.page_id, s.host, s.path, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY s.page_id ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS n
  FROM split s LEFT JOIN rules r
    ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM ranked WHERE n = 1
"""

_LINE_DEDUP = r"""
WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
lines AS (
  SELECT doc_id, i, trim(l[i + 1], ' ' || chr(9) || chr(13)) AS line
  FROM (SELECT doc_id, l, unnest(generate_series(0, len(l) - 1)) AS i FROM docs WHERE text IS NOT NULL)
),
filled AS (
  SELECT doc_id, i, line, len(string_split_regex(line, '[ \t\n\x0B\f\r]+')) AS words, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n
  FROM lines WHERE line <> ''
),
runs AS (  -- three lines, or more than 50 words in one or two
  SELECT doc_id, i AS first, i AS last, [line] AS content FROM filled WHERE words > 50
  UNION ALL
  SELECT a.doc_id, a.i, b.i, [a.line, b.line] FROM filled a JOIN filled b ON a.doc_id = b.doc_id AND b.n = a.n + 1 AND a.words + b.words > 50
  UNION ALL
  SELECT a.doc_id, a.i, c.i, [a.line, b.line, c.line]
  FROM filled a JOIN filled b ON a.doc_id = b.doc_id AND b.n = a.n + 1 JOIN filled c ON a.doc_id = c.doc_id AND c.n = a.n + 2
),
later AS (
  SELECT doc_id, first, last FROM (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, first) AS nth FROM runs) WHERE nth > 1
),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(first, last)) AS i FROM later),
marked AS (
  SELECT x.doc_id, x.i, x.text, g.i IS NOT NULL AS gone FROM (
    SELECT doc_id, i, l[i + 1] AS text FROM (SELECT doc_id, l, unnest(generate_series(0, len(l) - 1)) AS i FROM docs WHERE text IS NOT NULL)
  ) x LEFT JOIN gone g USING (doc_id, i)
),
turned AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM marked
),
summed AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_runs,
         sha256(coalesce(string_agg(text, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
  FROM turned GROUP BY doc_id
)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs, kept_sha256
FROM docs LEFT JOIN summed USING (doc_id)
"""

_NEAR_VECTORS = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, embedding::DOUBLE[] AS v, list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) AS n FROM embeddings
),
good AS (SELECT * FROM vectors WHERE n > 0 AND isfinite(n) AND len(list_filter(v, lambda x: x IS NULL)) = 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a, good b
  WHERE a.vec_id <> b.vec_id AND list_inner_product(a.v, b.v) / (sqrt(a.n) * sqrt(b.n)) >= 0.95
),
reached(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
counted AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a),
least AS (SELECT a AS vec_id, min(b) AS low FROM reached GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id,
       vec_id <= coalesce(low, vec_id) AS kept
FROM embeddings LEFT JOIN counted USING (vec_id) LEFT JOIN least USING (vec_id)
"""

_CONVERSATION_REPAIR = r"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name
  FROM conversations
),
hashed AS (
  SELECT *, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(name, ''), lambda x: ord(x)::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
                             lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1)))
  ), 4294967295::BIGINT) % 20 AS damage FROM named
),
damaged AS (
  SELECT conv_id, turn, CASE WHEN damage = 4 THEN 'user' ELSE role END AS role,
         CASE damage WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hashed, (VALUES (0), (1)) AS copies(copy) WHERE damage <> 0 AND (copy = 0 OR damage = 3)
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM damaged
),
judged AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
         regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS body,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM placed
),
turns AS (
  SELECT *, CASE WHEN body = '' THEN 'blank' WHEN again THEN 'duplicate'
                 WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault
  FROM judged
),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM turns GROUP BY conv_id
),
moves(p, initial, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
inserted(p, q, cost, letters, lines) AS (
  VALUES (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []),
         (0, 2, 2, 'I', ['user:']), (1, 2, 2, 'I', ['user:']), (2, 3, 2, 'I', ['assistant:']), (3, 2, 2, 'I', ['user:']),
         (0, 3, 4, 'II', ['user:', 'assistant:']), (1, 3, 4, 'II', ['user:', 'assistant:'])
),
edits AS (
  SELECT t.conv_id, t.i, m.p, m.q, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS cost, 'K' AS letter, [role || ':' || text] AS lines
  FROM turns t JOIN moves m ON left(t.role, 1) = m.initial WHERE fault IS NULL OR fault = 'truncated'
  UNION ALL
  SELECT t.conv_id, t.i, m.p, m.q, CASE WHEN fault = 'truncated' THEN 3 ELSE 2 END, 'R',
         [CASE m.initial WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text]
  FROM turns t JOIN moves m ON m.initial <> 's' WHERE fault IS NULL OR fault = 'truncated'
  UNION ALL
  SELECT t.conv_id, t.i, s, s, 3, 'D', [] FROM turns t, range(4) AS states(s)
),
ways(conv_id, n, i, q, best) AS (
  SELECT conv_id, n, 0::BIGINT, q, {'cost': cost, 'audit': letters, 'lines': lines} FROM counted, inserted WHERE p = 0
  UNION ALL
  SELECT w.conv_id, w.n, w.i + 1, x.q, min({
    'cost': w.best.cost + e.cost + x.cost, 'audit': w.best.audit || e.letter || x.letters, 'lines': w.best.lines || e.lines || x.lines})
  FROM ways w JOIN edits e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.i = w.i + 1 AND e.p = w.q JOIN inserted x ON x.p = e.q
  GROUP BY w.conv_id, w.n, w.i, x.q
),
solved AS (SELECT conv_id, min(best) AS best FROM ways WHERE i = n AND q IN (0, 3) GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
       coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN solved s ON s.conv_id IS NOT DISTINCT FROM o.conv_id
"""

_EXACT_SEARCH = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(1024 * x)) AS v FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM vectors q, vectors c WHERE q.vec_id % 100 = 0 AND c.vec_id IS DISTINCT FROM q.vec_id
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id NULLS LAST))::INTEGER AS rank FROM scored
) WHERE rank <= 10
"""

_TERMS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

_RANKED_SEARCH = f"""
WITH words AS (SELECT rowid_, doc_id, unnest(w) AS term, len(w) AS n
               FROM (SELECT row_number() OVER () AS rowid_, doc_id, {_TERMS} AS w FROM documents) WHERE len(w) > 0),
sizes AS (SELECT count(DISTINCT rowid_) AS n_docs, count(*) AS n_terms FROM words),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
held AS (SELECT rowid_, doc_id, n, term, count(*) AS tf FROM words SEMI JOIN asked USING (term) GROUP BY ALL),
weighted AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM held, sizes GROUP BY term, n_docs),
scored AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM held JOIN weighted USING (term) JOIN asked USING (term), sizes GROUP BY item_id, rowid_, doc_id
)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST))::INTEGER AS rank FROM scored WHERE score > 0
) WHERE rank <= 20
"""

ORACLES = {
    "op4_decontaminate": _DECONTAMINATE,
    "op6_near_vectors": _NEAR_VECTORS,
    "op7_url_rules": _URL_RULES,
    "op9_line_dedup": _LINE_DEDUP,
    "op11_conversation_repair": _CONVERSATION_REPAIR,
    "op12_exact_top_k": _EXACT_SEARCH,
    "op13_ranked_search": _RANKED_SEARCH,
}
