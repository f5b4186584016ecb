"""SQL of the registered queries that SQL can express."""

from __future__ import annotations

_OP9 = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('1:' || coalesce(doc_id::VARCHAR, 'null')) AS k
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighted AS (
  SELECT source, source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM sources
), ordered AS (
  SELECT *, 3 * source_size AS cap,
         sum(source_size) OVER () AS words,
         coalesce(sum(3 * source_size) OVER w, 0) AS capped, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS free
  FROM weighted
  WINDOW w AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT words - capped AS rest, free FROM ordered
  WHERE weight * (words - capped) < cap * free ORDER BY source_size / weight, source NULLS LAST LIMIT 1
), targets AS (
  SELECT source, source_size, weight,
         CASE WHEN NOT EXISTS (SELECT 1 FROM level) OR weight * (SELECT rest FROM level) >= cap * (SELECT free FROM level)
              THEN cap::DOUBLE
              ELSE (weight * (SELECT rest FROM level))::DOUBLE / (SELECT free FROM level)::DOUBLE END AS target
  FROM ordered
), plans AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(3, floor(target / source_size))::BIGINT ELSE 0 END AS whole FROM targets
), needs AS (
  SELECT *, greatest(round(target)::BIGINT - whole * source_size, 0) AS missing FROM plans
), keys AS (
  SELECT source, k, sum(size)::BIGINT AS words FROM sized GROUP BY source, k
), sums AS (
  SELECT *, sum(words) OVER (PARTITION BY source ORDER BY k) AS reached FROM keys
)
SELECT d.doc_id, d.size, n.source_size, n.target,
       (n.whole * d.size + CASE WHEN s.reached <= n.missing THEN d.size
                                WHEN s.reached - s.words < n.missing
                                THEN d.size * (n.missing - s.reached + s.words) // s.words
                                ELSE 0 END)::BIGINT AS taken
FROM sized d
JOIN needs n ON d.source IS NOT DISTINCT FROM n.source
JOIN sums s ON d.source IS NOT DISTINCT FROM s.source AND d.k = s.k
"""


_OP2 = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND NOT coalesce(list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))), false)
), scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scores
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

_OP4 = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), grams AS (
  SELECT DISTINCT doc_id, unnest(
    CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])
    END) AS g
  FROM split
), sizes AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_both
  FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b
  WHERE 100 * n_both >= 85 * (s.n + t.n - n_both)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
)
SELECT d.doc_id, coalesce(any_value(s.n), 0)::BIGINT AS n_shingles, min(reach.b) AS component_id
FROM documents d JOIN reach ON reach.a = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
GROUP BY d.doc_id
"""

_OP5 = """
WITH records AS (
  SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
), facts AS (
  SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS payload_digest FROM records
), held AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS holder FROM facts
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> holder THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> holder THEN holder END AS refers_to
FROM held
"""


# crc32 of each distinct document and run, byte by byte over a table of 256 remainders made by the bitwise rule
_OP11 = r"""
WITH RECURSIVE remainders AS (
  SELECT list(r ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS r
    FROM (SELECT unnest(range(256)) AS i)
  )
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run
  FROM documents
), counted AS (
  SELECT run, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS bytes, count(*) AS n
  FROM runs WHERE length(run) >= 5 GROUP BY ALL
), hashed AS (
  SELECT run, n, xor(list_reduce(
    list_transform(range(0, length(bytes), 2), lambda i: ('0x' || substr(bytes, (i + 1)::BIGINT, 2))::BIGINT),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295::BIGINT), 4294967295) AS h
  FROM counted, remainders
), words AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word,
         sum(n)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3
), shorter AS (
  SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), blanked AS (
  SELECT word, n, substr(word, 1, i - 1) || '?' || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n FROM blanked a JOIN blanked b ON a.rest = b.rest AND a.word <> b.word
  UNION ALL
  SELECT s.word, w.word, w.n FROM shorter s JOIN words w ON s.rest = w.word
  UNION ALL
  SELECT w.word, s.word, s.n FROM shorter s JOIN words w ON s.rest = w.word
), best AS (
  SELECT word, count(*) AS n_near, max(n) AS most, arg_min(other, struct_pack(a := -n, b := other)) AS other
  FROM near GROUP BY word
), forms AS (
  SELECT w.word, CASE WHEN b.most >= 2 * w.n THEN b.other END AS form, w.n, coalesce(b.n_near, 0) AS n_near,
         CASE WHEN b.most >= 2 * w.n THEN b.most END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word
), chains AS (
  SELECT word, word AS at FROM forms
  UNION ALL
  SELECT c.word, f.form FROM chains c JOIN forms f ON f.word = c.at WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n
FROM forms f
JOIN chains c ON c.word = f.word
JOIN forms e ON e.word = c.at AND e.form IS NULL
"""

_OP13 = r"""
WITH matched AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents
), rules AS (
  SELECT unnest([
    {'kind': 'assign', 'place': 0, 'least': 6,
     'p': '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'},
    {'kind': 'access', 'place': 1, 'least': 20, 'p': '(AKIA)([A-Z0-9]+)'},
    {'kind': 'hex', 'place': 2, 'least': 24, 'p': '()([0-9a-f]{24,})'}], recursive := true)
), parts AS (
  SELECT row, kind, place, least,
         CASE kind WHEN 'assign' THEN regexp_extract_all(t, (SELECT p FROM rules WHERE place = 0), 0)
                   WHEN 'access' THEN regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0) ELSE regexp_extract_all(t, '[0-9a-f]{24,}', 0) END AS hits,
         CASE kind WHEN 'assign' THEN regexp_extract_all(t, (SELECT p FROM rules WHERE place = 0), 2)
                   WHEN 'access' THEN regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0) ELSE regexp_extract_all(t, '[0-9a-f]{24,}', 0) END AS checked,
         CASE kind WHEN 'assign' THEN regexp_split_to_array(t, (SELECT p FROM rules WHERE place = 0))
                   WHEN 'access' THEN regexp_split_to_array(t, 'AKIA[A-Z0-9]+') ELSE regexp_split_to_array(t, '[0-9a-f]{24,}') END AS gaps
  FROM matched, rules
), placed AS (
  SELECT row, kind, place, unnest(list_transform(range(1, len(hits) + 1), lambda i: {
    'first': (coalesce(list_sum(list_transform(gaps[1:i], lambda g: length(g))), 0)
              + coalesce(list_sum(list_transform(hits[1:i - 1], lambda g: length(g))), 0))::BIGINT,
    'size': length(hits[i]), 'good': length(checked[i]) >= least}), recursive := true)
  FROM parts
), found AS (
  SELECT row, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(concat_ws(':', kind, "first", "first" + size), ',' ORDER BY "first", place) AS spans
  FROM placed WHERE good GROUP BY row
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
       coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM matched LEFT JOIN found USING (row)
"""


def llm_sql() -> dict[str, str]:
    return {"op2_top_products": _OP2, "op4_ngram_join": _OP4, "op5_warc": _OP5, "op9_mixing": _OP9, "op11_spelling": _OP11, "op13_secrets": _OP13}
