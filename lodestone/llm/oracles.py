"""SQL of the queries of this subpackage that SQL can express on whole tables."""

P8_FOUND = """
SELECT d.doc_id AS doc_id
FROM documents d
LEFT JOIN (SELECT source, max_tokens FROM token_limits WHERE purpose = 'cut' AND source IS NOT NULL) l ON l.source = d.source
CROSS JOIN (SELECT max(max_tokens) AS max_tokens FROM token_limits WHERE purpose = 'cut' AND source IS NULL) o
WHERE d.text IS NOT NULL AND strlen(d.text) > coalesce(l.max_tokens, o.max_tokens)
"""


P6_BYTES = """
SELECT c.max_tokens AS capacity, count(*) AS texts, sum(strlen(text))::BIGINT AS tokens, 0::BIGINT AS divided, 0::BIGINT AS undivided, 0::BIGINT AS overfull
FROM documents, (SELECT DISTINCT max_tokens FROM token_limits WHERE purpose = 'pack') c WHERE strlen(text) > 0 GROUP BY 1
"""

P7_BYTES = """
SELECT source, count(*) AS docs, true AS as_expected, 0::BIGINT AS beyond_cap
FROM documents WHERE strlen(text) > 0 AND source IN (SELECT source FROM mix_targets) GROUP BY 1
"""

P8_BYTES = """
SELECT d.doc_id, length(d.text)::BIGINT AS chars, strlen(d.text) > coalesce(l.max_tokens, o.max_tokens) AS cut, 0::BIGINT AS too_long, 0::BIGINT AS wrong_overlap
FROM documents d
LEFT JOIN (SELECT source, max_tokens FROM token_limits WHERE purpose = 'cut' AND source IS NOT NULL) l ON l.source = d.source
CROSS JOIN (SELECT max(max_tokens) AS max_tokens FROM token_limits WHERE purpose = 'cut' AND source IS NULL) o
WHERE d.text IS NOT NULL
"""


def oracle_sql() -> dict[str, str]:
    return {"p6_bytes": P6_BYTES, "p7_bytes": P7_BYTES, "p8_found": P8_FOUND, "p8_bytes": P8_BYTES}
