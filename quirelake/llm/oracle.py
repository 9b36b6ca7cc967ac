"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

from . import license_scan

#: Exact top-k by a plain join of all pairs.
OP5 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

#: Payload digests, and the revisits of equal payloads.
OP7 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p
), w AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS latest FROM d
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND latest <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND latest <> page_id THEN latest END AS refers_to
FROM w
"""


def _op3() -> str:
    """License phrases and template containment by brute force: every window against every template."""
    phrase = ", ".join(f"({p.split()!r}, '{label}')" for p, label in license_scan.PHRASES.items())
    template = ", ".join(f"({n}, '{label}', {words!r})" for n, label, words in license_scan._templates(license_scan.TEMPLATES))
    half, share = license_scan.HALF, license_scan.CONTAINED
    return f"""
WITH p(ws, label) AS (VALUES {phrase}),
m(n, label, ws) AS (VALUES {template}),
d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
), places AS (
  SELECT d.doc_id, p.label, i - 1 AS pos
  FROM d, p, unnest(range(1, len(d.w) + 1)) AS r(i)
  WHERE list_slice(d.w, i, i + len(p.ws) - 1) = p.ws
), base AS (
  SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word,
         list_sort(list_distinct(list(label))) AS labels
  FROM places GROUP BY doc_id
), windows AS (
  SELECT doc_id, list_slice(w, b * {half} + 1, b * {half} + {2 * half}) AS w
  FROM d, unnest(range(0, greatest(1, CAST(ceil(len(w) / {half}.0) AS BIGINT) - 1))) AS r(b)
), held AS (
  SELECT windows.doc_id, m.label, len(list_intersect(m.ws, windows.w)) AS k, len(m.ws) AS n FROM windows, m
), found AS (
  SELECT doc_id, list_distinct(list(label)) AS labels, max(k / CAST(n AS DOUBLE)) AS share
  FROM held WHERE k >= {share} * n - 1e-9 GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(array_to_string(base.labels, ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(found.labels, [])))), ',') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN found USING (doc_id)
"""


def oracle_sql() -> dict:
    return {"op3_license_scan": _op3(), "op5_exact_top_k": OP5, "op7_warc": OP7}
