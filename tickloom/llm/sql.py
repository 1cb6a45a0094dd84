"""SQL of the queries that SQL can express: those without models, signatures, tokens or Spark's own hash."""

from string import ascii_lowercase, ascii_uppercase

from tickloom.llm.license_scan import BLOCK, PHRASES, TEMPLATES


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_PHRASES = ", ".join(f"({_list(p.split())}, '{label}')" for p, label in PHRASES.items())
_TEMPLATES = ", ".join(f"('{label}', {_list(sorted(set(t.split())))})" for label, t in TEMPLATES)
_STRIDE = max(len(t.split()) for _, t in TEMPLATES)

ORACLE: dict[str, str] = {
    "op1_warc_index": """
        WITH payloads AS (SELECT page_id, coalesce(html, '') AS html, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n FROM pages),
        led AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS leader FROM payloads)
        SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
               CASE WHEN n >= 1000 AND page_id <> leader THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id <> leader THEN leader END AS refers_to FROM led""",
    "op6_license_scan": rf"""
        WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        phrases(phrase, label) AS (VALUES {_PHRASES}), templates(label, t) AS (VALUES {_TEMPLATES}),
        places AS (SELECT doc_id, label,
                          unnest(list_filter(generate_series(1, len(w)), lambda i: w[i:i + len(phrase) - 1] = phrase)) - 1 AS start
                   FROM words, phrases),
        base AS (SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word FROM places GROUP BY doc_id),
        shares AS (SELECT doc_id, label, unnest(list_transform(generate_series(0, greatest(len(w) - 1, 0), {_STRIDE}),
                          lambda s: len(list_intersect(list_distinct(w[s + 1:s + {BLOCK * _STRIDE}]), t)) / len(t))) AS share
                   FROM words, templates),
        found AS (SELECT * FROM shares WHERE share >= 0.9 - 1e-9),
        best AS (SELECT doc_id, max(share) AS share FROM found GROUP BY doc_id),
        own AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS base_labels FROM (SELECT DISTINCT doc_id, label FROM places) GROUP BY doc_id),
        every AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels
                  FROM (SELECT doc_id, label FROM places UNION SELECT doc_id, label FROM found) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
               coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
               CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0)::DOUBLE END AS score
        FROM words LEFT JOIN base USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN own USING (doc_id) LEFT JOIN every USING (doc_id)""",
    "op11_hard_negatives": """
        WITH usable AS (SELECT * FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
                        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        rows AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM usable),
        met AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
                FROM rows a, rows b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
        positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM met WHERE same
                      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
        FROM positives JOIN met USING (anchor_id)
        WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
        WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5""",
}
