"""DuckDB SQL for the corpus queries that SQL can express."""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = {
    "op1_decontaminate": rf"""
WITH items AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), windows AS (
  SELECT DISTINCT item, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS win
  FROM (SELECT item, w, least(len(w), 10) AS k FROM items WHERE len(w) > 0)
), docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), places AS (
  SELECT r, k, w, unnest(range(1, len(w) - k + 2)) AS i
  FROM docs, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k
), found AS (
  SELECT p.r, p.i, p.k, v.item
  FROM (SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM places) p JOIN windows v ON v.win = p.win AND v.k = p.k
), hits AS (
  SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS pos FROM found) GROUP BY r
), named AS (
  SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS list FROM found GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN named USING (r)""",
    "op5_substrings": r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS h
  FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM docs WHERE len(w) >= 35)
), repeated AS (
  SELECT h FROM windows GROUP BY h HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT r, unnest(range(i, i + 35)) AS pos FROM windows JOIN repeated USING (h)
), words AS (
  SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM docs
), kept AS (
  SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS line FROM words ANTI JOIN gone USING (r, pos) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(line, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)""",
    "op3_warc": r"""
WITH pages_ AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), hashed AS (
  SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS h FROM pages_
), digests AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32),
    lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, 5 * (i // 4) + 1, 5) AS INTEGER) >> (15 - 5 * (i % 4))) & 31), 1)), '') AS payload_digest
  FROM hashed
), first AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS largest FROM digests
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = largest THEN NULL ELSE largest END AS refers_to
FROM first""",
}
