"""DuckDB SQL for the queries that SQL can express: other statements of the same results, without the methods."""

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

LINES = r"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
h AS (SELECT *, list_transform(lines, lambda x: ('0x' || substr(md5(x), 1, 8))::BIGINT) AS hs FROM l),
b AS (SELECT *, list_filter(range(1, len(lines) + 1), lambda i: i = len(lines) OR
  (hs[i] + 31 * (CASE WHEN i > 1 THEN hs[i - 1] ELSE 0 END) + 961 * (CASE WHEN i > 2 THEN hs[i - 2] ELSE 0 END)) % 4 = 0) AS ends FROM h),
c AS (SELECT doc_id, lines, ends, unnest(range(1, len(ends) + 1)) AS k FROM b),
d AS (SELECT doc_id, CASE WHEN k = 1 THEN 1 ELSE ends[k - 1] + 1 END AS a, ends[k] AS z, lines FROM c),
e AS (SELECT doc_id, a, z, array_to_string(lines[a:z], chr(10)) AS body FROM d WHERE z > a),
f AS (SELECT doc_id, a, z, row_number() OVER (PARTITION BY body ORDER BY doc_id NULLS FIRST, a) AS n FROM e),
g AS (SELECT doc_id, flatten(list(range(a, z + 1))) AS gone FROM f WHERE n > 1 GROUP BY doc_id),
p AS (SELECT doc_id, i, first_value(doc_id) OVER w AS first_doc, first_value(i) OVER w AS first_i
  FROM (SELECT doc_id, i, lines[i] || chr(10) || lines[i + 1] AS body FROM (SELECT doc_id, lines, unnest(range(1, len(lines))) AS i FROM l))
  WINDOW w AS (PARTITION BY body ORDER BY doc_id NULLS FIRST, i)),
r AS (SELECT doc_id, list_distinct(flatten(list([i, i + 1]))) AS gone FROM p
  WHERE first_doc IS DISTINCT FROM doc_id OR first_i + 2 <= i GROUP BY doc_id)
SELECT b.doc_id, len(lines)::BIGINT AS n_lines, len(ends)::BIGINT AS n_chunks, coalesce(len(g.gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(list_transform(list_filter(range(1, len(lines) + 1), lambda i: NOT list_contains(coalesce(g.gone, []), i)),
  lambda i: lines[i]), chr(10))) AS kept_sha256,
  coalesce(len(r.gone), 0)::BIGINT AS n_repeated,
  sha256(array_to_string(list_transform(list_filter(range(1, len(lines) + 1), lambda i: NOT list_contains(coalesce(r.gone, []), i)),
  lambda i: lines[i]), chr(10))) AS unrepeated_sha256
FROM b LEFT JOIN g ON b.doc_id = g.doc_id LEFT JOIN r ON b.doc_id = r.doc_id
"""

SUBSTRINGS = rf"""
WITH t AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
w AS (SELECT doc_id, p, array_to_string(ws[p:p + 49], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS p FROM t)),
m AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY win) AS first_id FROM w),
g AS (SELECT doc_id, list_distinct(flatten(list(range(p, p + 50)))) AS gone FROM m WHERE first_id < doc_id GROUP BY doc_id)
SELECT t.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(list_transform(list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(coalesce(gone, []), i)),
  lambda i: ws[i]), ' ')) AS kept_sha256
FROM t LEFT JOIN g ON t.doc_id = g.doc_id
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes, sha1(body) AS d,
  min(page_id) OVER (PARTITION BY body) AS first_id FROM p)
SELECT page_id, payload_bytes, array_to_string(flatten(list_transform(range(0, 8), lambda i: list_transform([15, 10, 5, 0],
  lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(d, 5 * i + 1, 5))::BIGINT >> s) & 31)::INT, 1)))), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM h
"""

EXACT = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS body FROM documents),
k AS (SELECT doc_id, body, first_value(doc_id) OVER (PARTITION BY body ORDER BY n DESC, doc_id) AS keep_id,
  count(*) OVER (PARTITION BY body) AS group_size FROM t)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM k
"""

JACCARD = rf"""
WITH RECURSIVE t AS MATERIALIZED (SELECT doc_id, list_transform({_WORDS}, lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ws FROM documents),
s AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS grams FROM t),
n AS MATERIALIZED (SELECT doc_id, len(grams)::BIGINT AS n_shingles FROM s),
x AS MATERIALIZED (SELECT doc_id, hash(unnest(grams)) AS gram FROM s),
links AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (min(na.n_shingles) + min(nb.n_shingles) - count(*))),
r AS (SELECT doc_id AS v, doc_id AS low FROM n UNION SELECT links.b, r.low FROM r JOIN links ON links.a = r.v)
SELECT n.doc_id, n.n_shingles, min(r.low) AS component_id FROM n JOIN r ON r.v = n.doc_id GROUP BY n.doc_id, n.n_shingles
"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SEARCH = rf"""
WITH d AS (SELECT doc_id, ts FROM (SELECT doc_id, {_TERMS} AS ts FROM documents) AS x WHERE len(ts) > 0),
q AS (SELECT row_number() OVER () AS row_no, item_id, {_TERMS} AS ts FROM benchmark),
qt AS (SELECT row_no, item_id, term, count(*) AS repeats FROM (SELECT row_no, item_id, unnest(ts) AS term FROM q) AS x GROUP BY row_no, item_id, term),
s AS (SELECT count(*)::BIGINT AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM d),
k AS (SELECT row_number() OVER () AS doc_no, doc_id, len(ts)::BIGINT AS n, ts FROM d),
t AS (SELECT doc_no, term, count(*)::BIGINT AS tf FROM (SELECT doc_no, unnest(ts) AS term FROM k) AS x
  WHERE term IN (SELECT term FROM qt) GROUP BY doc_no, term),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM t, s GROUP BY term),
c AS (SELECT doc_no, t.term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * n_docs) // n_terms)))) AS part
  FROM t JOIN k USING (doc_no) JOIN w ON w.term = t.term, s),
r AS (SELECT row_no, item_id, doc_no, sum(repeats * part)::BIGINT AS score FROM c JOIN qt ON qt.term = c.term GROUP BY row_no, item_id, doc_no),
o AS (SELECT item_id, row_number() OVER (PARTITION BY row_no ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score
  FROM r JOIN k USING (doc_no) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10
"""
