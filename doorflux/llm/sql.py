"""Comparison SQL (DuckDB dialect) for the operators that SQL can express."""

from __future__ import annotations

# Kind, pattern, group whose length counts, least length.
SECRETS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    ("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
)


def _matches(order: int, kind: str, regex: str, group: int, least: int) -> str:
    """The texts before the matches, the matches, and the values whose length counts."""
    gaps, hits, values = (f"regexp_extract_all(text, '(?s)(.*?)({regex})', {k})" for k in (1, 2, 2 + group))
    return f"SELECT k, {order} AS ord, '{kind}' AS kind, {least} AS least, {gaps} AS gaps, {hits} AS hits, {values} AS vals FROM d"


SECRET_REPORT = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(_matches(order, *rule) for order, rule in enumerate(SECRETS))}),
u AS (SELECT *, unnest(generate_series(1, len(hits))) AS i FROM m WHERE len(hits) > 0),
p AS (SELECT k, ord, kind, length(hits[i]) AS n,
             length(array_to_string(gaps[1:i], '')) + length(array_to_string(hits[1:i - 1], '')) AS a
      FROM u WHERE length(vals[i]) >= least),
s AS (SELECT k, count(*) FILTER (WHERE ord = 0) AS n_assign, count(*) FILTER (WHERE ord = 1) AS n_access,
             count(*) FILTER (WHERE ord = 2) AS n_hex,
             string_agg(concat(kind, ':', a, ':', a + n), ',' ORDER BY a, ord) FILTER (WHERE ord < 3) AS base,
             string_agg(concat(kind, ':', a, ':', a + n), ',' ORDER BY a, ord) AS spans
      FROM p GROUP BY k)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN s USING (k)"""

#: For each anchor and positive the best rows of other labels within the window, plainly.
HARD_NEGATIVES = """
WITH sound AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS alike,
           list_inner_product(a.v, b.v)::BIGINT AS score
    FROM sound a JOIN sound b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE alike
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id)::INTEGER AS rank,
       n.other_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p
JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.alike
     AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id) <= 10
"""

#: Base 32 is written five hexadecimal digits (four letters) at a time.
WARC_RECORDS = """
WITH paid AS (
    SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex,
           max(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
    FROM pages
), digits AS (
    SELECT *, list_transform(range(0, 8), lambda k: list_reduce(
        list_transform(range(1, 6), lambda d: instr('0123456789abcdef', substr(hex, 5 * k + d, 1)) - 1),
        lambda x, y: 16 * x + y)) AS fives
    FROM paid
)
SELECT page_id, octet_length(encode(payload))::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           ((fives[k // 4 + 1] >> (15 - 5 * (k % 4))) & 31)::INTEGER + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM digits
"""
