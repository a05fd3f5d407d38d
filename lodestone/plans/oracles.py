"""SQL for the registered queries that SQL can express on whole tables (DuckDB dialect)."""

from __future__ import annotations

from ..functions import fixed_values as V


def _tokens(column: str) -> str:
    """List of tokens of a text column."""
    return f"""flatten(list_transform(regexp_extract_all({column}, '[A-Za-z0-9_]+'), lambda raw: list_concat([lower(raw)], list_filter(list_transform(string_split(regexp_replace(replace(raw, '_', ' '), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), ' '), lambda p: lower(p)),
            lambda p: p <> '' AND p <> lower(raw)))))"""


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


#: Name of the indexed product, as the chunks' sources tell it; a marker stands for it while patterns are made.
PRODUCT = "(SELECT coalesce(max(regexp_extract(source, '^project([a-z0-9]+)-forum$', 1)), '') FROM meta)"
NAMED = V.Profile("\x01")


def _qp(s: str) -> str:
    """A literal in which the marker becomes the product."""
    return "(" + _q(s).replace("\x01", f"' || {PRODUCT} || '") + ")"


GOLD = """gold_q AS (
    SELECT *, row_number() OVER (ORDER BY query, kind, to_json(relevant)::VARCHAR NULLS FIRST, to_json(channels)::VARCHAR NULLS FIRST) AS query_id
    FROM (SELECT DISTINCT query, kind, relevant, channels FROM gold))"""

IDF = f"""doc_tokens AS (SELECT chunk_id, {_tokens("coalesce(text, '')")} AS tokens FROM meta),
    dfs AS (SELECT token, count(*) AS df FROM (SELECT chunk_id, unnest(list_distinct(tokens)) AS token FROM doc_tokens) GROUP BY token),
    raw_idf AS (SELECT token, df, ln((SELECT count(*) FROM meta) - df + 0.5) - ln(df + 0.5) AS raw FROM dfs),
    idfs AS (SELECT token, df, CASE WHEN raw < 0 THEN {V.BM25_EPSILON} * (SELECT avg(raw) FROM raw_idf) ELSE raw END AS idf FROM raw_idf)"""


def _bm25(k: int) -> str:
    return f"""{GOLD}, {IDF},
    asked AS (SELECT query_id, token, count(*) AS times FROM (SELECT query_id, unnest({_tokens('query')}) AS token FROM gold_q) GROUP BY 1, 2),
    lens AS (SELECT chunk_id, len(tokens) AS n FROM doc_tokens),
    postings AS (SELECT chunk_id, token, count(*) AS tf FROM (SELECT chunk_id, unnest(tokens) AS token FROM doc_tokens) WHERE token IN (SELECT token FROM asked) GROUP BY 1, 2),
    scored AS (
        SELECT query_id, p.chunk_id, round(sum(times * idf * (tf * {V.BM25_K1 + 1} / (tf + {V.BM25_K1} * ({1 - V.BM25_B} + {V.BM25_B} * n / (SELECT avg(n) FROM lens))))), 9) AS score
        FROM postings p JOIN asked USING (token) JOIN idfs USING (token) JOIN lens USING (chunk_id) GROUP BY 1, 2),
    bm AS (
        SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored WHERE score > 0) WHERE rank <= {k})"""


#: Last part of a symbol split at "::" or ".": everything behind the last separator.
_KEYS = r"list_distinct(list_filter([lower(coalesce(symbol, '')), string_split(replace(lower(coalesce(symbol, '')), '::', '.'), '.')[-1]], lambda k: k <> ''))"

SYMBOLS = f"""keyed AS (SELECT chunk_id, unnest({_KEYS}) AS key FROM meta),
    numbered AS (SELECT * FROM (SELECT key, chunk_id, row_number() OVER (PARTITION BY key ORDER BY chunk_id) AS ord FROM keyed) WHERE ord <= {V.SYMBOL_HITS})"""


def _lookup(source: str) -> str:
    return rf"""pieces AS (
        SELECT query_id, flatten(list_transform(regexp_extract_all(query, '[A-Za-z_][\w:]*'), lambda r: string_split(replace(lower(r), '::', '.'), '.'))) AS p FROM {source}),
    placed AS (SELECT query_id, p[i] AS key, i AS pos FROM pieces, LATERAL (SELECT unnest(range(1, len(p) + 1)) AS i) WHERE p[i] <> ''),
    hits AS (SELECT query_id, chunk_id, min({{'pos': pos, 'ord': ord}}) AS f FROM placed JOIN numbered USING (key) GROUP BY 1, 2),
    sym AS (SELECT * FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY f.pos, f.ord, chunk_id) AS rank FROM hits) WHERE rank <= {V.CANDIDATES})"""


_LANGUAGE = "CASE " + " ".join(f"WHEN ext = '{e}' THEN '{l}'" for e, l in V.LANGUAGE_OF_EXTENSION.items()) + " ELSE '' END"
_PY = "(coalesce(language, '') = 'py' OR " + " OR ".join(f"contains(lower(coalesce(path, '')), {_qp(w)})" for w in NAMED.python_path_words) + ")"
_FORUM = f"(coalesce(language, '') = 'forum' OR coalesce(source, '') = {_qp(NAMED.forum_source)})"
_FLAG = "coalesce(regexp_matches(text, " + _q("|".join(f"(?:{p})" for p in V.INJECTION_PATTERNS)) + ", 'i'), false)"
_SUBJECT = "subject"
for _ in range(3):
    _SUBJECT = f"regexp_replace(regexp_replace({_SUBJECT}, {_q(V.SUBJECT_PREFIX)}, '', 'i'), {_qp(NAMED.subject_tag)}, '', 'i')"
_SUBJECT = rf"regexp_replace({_SUBJECT}, '^\s+|\s+$', '', 'g')"
_BLANK = "[ \\t\\r\\f\\x{0B}\\x{A0}]"

LINES = "string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10))"


def _windows(table: str, key: str, overlap: int, where: str = "true") -> str:
    """Recursive query over window starts; ends are found by prefix sums of line lengths."""
    m = V.MAX_CHARS
    return f"""WITH RECURSIVE docs AS (SELECT {key}, text, string_split(text, chr(10)) AS ls FROM {table} WHERE text IS NOT NULL AND {where}),
    sums AS (SELECT {key}, text, ls, list_prepend(0::BIGINT, list_transform(range(1, len(ls) + 1), lambda i: (list_sum(list_transform(ls[1:i], lambda x: len(x) + 1)))::BIGINT)) AS cum FROM docs WHERE len(text) > {m}),
    w AS (
        SELECT {key}, 0::BIGINT AS i, 0::BIGINT AS n FROM sums
        UNION ALL
        SELECT w.{key}, greatest(e.j - {overlap}, w.i + 1), w.n + 1
        FROM w JOIN sums s USING ({key}), LATERAL (SELECT len(list_filter(s.cum[1:len(s.ls)], lambda c, k: k <= w.i OR c - s.cum[w.i + 1] < {m}))::BIGINT AS j) e
        WHERE e.j < len(s.ls)),
    cut AS (
        SELECT w.{key}, w.i, array_to_string(s.ls[w.i + 1 : (len(list_filter(s.cum[1:len(s.ls)], lambda c, k: k <= w.i OR c - s.cum[w.i + 1] < {m})))], chr(10)) AS piece
        FROM w JOIN sums s USING ({key}))"""


def oracle_sql() -> dict[str, str]:
    o: dict[str, str] = {}
    o["tokenize_counts"] = f"SELECT token, count(*) AS n FROM (SELECT unnest({_tokens('text')}) AS token FROM meta) GROUP BY token"
    o["token_df_idf"] = f"WITH {IDF} SELECT token, df, round(idf, 6) AS idf FROM idfs"
    o["stored_terms"] = o["token_df_idf"]
    o["stored_vectors"] = f"""
WITH {IDF},
b AS (SELECT chunk_id, (('0x' || substr(md5(token), 1, 8))::BIGINT % 64)::INTEGER AS bucket, count(*)::DOUBLE AS n FROM (SELECT chunk_id, unnest(tokens) AS token FROM doc_tokens) GROUP BY 1, 2),
v AS (SELECT chunk_id, sqrt(sum(n * n)) AS size, sum(n) AS total FROM b GROUP BY 1)
SELECT m.chunk_id, 64::INTEGER AS dim, CASE WHEN size IS NULL THEN 0 ELSE 1 END::DOUBLE AS norm, round(coalesce(total / size, 0), 6) AS total FROM meta m LEFT JOIN v USING (chunk_id)"""
    o["bm25_scan"] = o["bm25_topk"] = f"WITH {_bm25(V.CANDIDATES)} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM bm"
    o["l2_normalize"] = """
WITH v AS (SELECT DISTINCT chunk_id, embeddings FROM vector_store WHERE embeddings IS NOT NULL AND len(list_filter(embeddings, lambda x: isnan(x))) = 0),
n AS (SELECT chunk_id, embeddings, sqrt(list_sum(list_transform(embeddings, lambda x: x::DOUBLE * x::DOUBLE))) AS size FROM v),
u AS (SELECT chunk_id, list_transform(embeddings, lambda x: x::DOUBLE / CASE WHEN size = 0 THEN 1 ELSE size END) AS unit FROM n)
SELECT chunk_id, len(unit)::INTEGER AS dim, round(list_sum(unit), 6) AS total, round(sqrt(list_sum(list_transform(unit, lambda x: x * x))), 6) AS norm FROM u"""
    o["dense_topk"] = """
WITH s AS (
    SELECT q.vec_id AS query_id, e.vec_id, round(list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 12) AS score
    FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0)
SELECT * FROM (SELECT query_id, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10"""
    o["hash_embed"] = f"""
SELECT doc_id, (('0x' || substr(md5(token), 1, 8))::BIGINT % 64)::INTEGER AS bucket, count(*) AS n
FROM (SELECT doc_id, unnest({_tokens('text')}) AS token FROM documents) GROUP BY 1, 2"""
    o["symbol_keys"] = f"WITH {SYMBOLS} SELECT key, chunk_id, ord FROM numbered"
    o["symbol_lookup"] = f"""
WITH {SYMBOLS}, asked AS (SELECT min(chunk_id) AS query_id, symbol AS query FROM meta WHERE coalesce(symbol, '') <> '' GROUP BY symbol),
{_lookup('asked')} SELECT query_id, chunk_id, rank FROM sym"""
    o["chunk_flags"] = f"SELECT chunk_id, {_PY} AS python_chunk, {_FORUM} AS forum_chunk, {_FLAG} AS flagged FROM meta"
    o["query_flags"] = rf"""
WITH {GOLD} SELECT query_id, query,
    (regexp_matches(lower(query), {_qp(NAMED.python_query_pattern)}) OR {' OR '.join(f"contains(lower(query), {_qp(w)})" for w in NAMED.python_query_words)}) AS python_query,
    array_to_string(list_filter(flatten(list_transform(regexp_extract_all(query, '[A-Za-z_][\w:]*'), lambda r: string_split(replace(lower(r), '::', '.'), '.'))), lambda p: p <> ''), ' ') AS identifiers
FROM gold_q"""
    # --- hybrid search: hashing embedder, three lists, fusion, corrections, verdict
    embed = f"""emb_docs AS (SELECT chunk_id, list_transform(range(0, 64), lambda b: coalesce(m[b::INTEGER], 0)) AS v FROM (
        SELECT chunk_id, map_from_entries(list({{'k': bucket, 'v': n}})) AS m FROM (
            SELECT chunk_id, (('0x' || substr(md5(token), 1, 8))::BIGINT % 64)::INTEGER AS bucket, count(*)::DOUBLE AS n FROM (SELECT chunk_id, unnest(tokens) AS token FROM doc_tokens) GROUP BY 1, 2) GROUP BY 1)),
    emb_q AS (SELECT query_id, list_transform(range(0, 64), lambda b: coalesce(m[b::INTEGER], 0)) AS v FROM (
        SELECT query_id, map_from_entries(list({{'k': bucket, 'v': n}})) AS m FROM (
            SELECT query_id, (('0x' || substr(md5(token), 1, 8))::BIGINT % 64)::INTEGER AS bucket, sum(times)::DOUBLE AS n FROM asked GROUP BY 1, 2) GROUP BY 1)),
    unit_docs AS (SELECT chunk_id, list_transform(v, lambda x: x / (sqrt(list_sum(list_transform(v, lambda y: y * y))))) AS u FROM emb_docs
        UNION ALL SELECT chunk_id, list_transform(range(0, 64), lambda b: 0.0::DOUBLE) FROM doc_tokens WHERE len(tokens) = 0),
    unit_q AS (SELECT query_id, list_transform(v, lambda x: x / (sqrt(list_sum(list_transform(v, lambda y: y * y))))) AS u FROM emb_q),
    dense AS (SELECT * FROM (
        SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
            SELECT query_id, chunk_id, round(list_sum(list_transform(list_zip(q.u, d.u), lambda z: z[1] * z[2])), 12) AS score FROM unit_q q, unit_docs d)) WHERE rank <= {V.CANDIDATES})"""
    searched = f"""WITH {_bm25(V.CANDIDATES)}, {SYMBOLS}, {_lookup('gold_q')}, {embed},
    lists AS (SELECT query_id, chunk_id, 0 AS list, rank, score FROM dense UNION ALL SELECT query_id, chunk_id, 1, rank, score FROM bm UNION ALL SELECT query_id, chunk_id, 2, rank, NULL FROM sym),
    f AS (
        SELECT query_id, chunk_id, {' + '.join(f"coalesce(1.0::DOUBLE / (60 + max(CASE WHEN list = {c} THEN rank END)), 0)" for c in (0, 1, 2))} AS rrf,
            max(CASE WHEN list = 0 THEN score END) AS ds, max(CASE WHEN list = 1 THEN score END) AS bs, min({{'l': list, 'r': rank}}) AS first FROM lists GROUP BY 1, 2),
    g AS (
        SELECT f.*, m.path, m.line, m.language, m.chunk_type, m.symbol, m.text, {_FLAG} AS flagged_injection,
            (regexp_matches(lower(q.query), {_qp(NAMED.python_query_pattern)}) OR {' OR '.join(f"contains(lower(q.query), {_qp(w)})" for w in NAMED.python_query_words)}) AND {_PY} AS boosted, {_FORUM} AS forum_chunk
        FROM f JOIN meta m USING (chunk_id) JOIN gold_q q USING (query_id)),
    h AS (SELECT *, rrf + CASE WHEN boosted THEN {V.PYTHON_BOOST}::DOUBLE ELSE 0 END - CASE WHEN forum_chunk THEN {V.FORUM_PENALTY}::DOUBLE ELSE 0 END - CASE WHEN flagged_injection THEN {V.INJECTION_PENALTY}::DOUBLE ELSE 0 END AS fused FROM g),
    results AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, first.l, first.r, chunk_id) AS rank FROM h) WHERE rank <= {V.TOP_K}),
    verdicts AS (
        SELECT query_id, kind, relevant, coalesce(top, 0) AS top_dense, coalesce(hit, false) AS symbol_hit, coalesce(top, 0) < {V.DENSE_FLOOR}::DOUBLE AND NOT coalesce(hit, false) AS insufficient_evidence,
            round(greatest(least(coalesce(top, 0), 1), 0), 3) AS confidence
        FROM gold_q LEFT JOIN (SELECT query_id, max(score) AS top FROM dense GROUP BY 1) USING (query_id) LEFT JOIN (SELECT DISTINCT query_id, true AS hit FROM sym) USING (query_id))"""
    o["rrf_fusion"] = f"""{searched}
SELECT query_id, chunk_id, round(rrf, 9) AS rrf, first.l::BIGINT AS first_list, first.r::BIGINT AS first_rank,
    row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, first.l, first.r, chunk_id) AS place FROM f"""
    o["hybrid_search"] = f"""{searched}
SELECT query_id, rank, round(fused, 5) AS score, chunk_id, path, line, language, chunk_type, symbol, round(coalesce(ds, 0), 4) AS dense_score, round(coalesce(bs, 0), 4) AS bm25_score, flagged_injection FROM results"""
    o["abstention"] = f"{searched} SELECT query_id, round(top_dense, 6) AS top_dense, symbol_hit, insufficient_evidence, confidence FROM verdicts"
    o["context_assembly"] = f"""{searched}
SELECT query_id, string_agg('### ' || path || ':' || line || ' [' || coalesce(language, '') || ']' || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY rank) AS context, list(path || ':' || line ORDER BY rank) AS sources
FROM results GROUP BY 1"""
    o["rendered_results"] = f"""{searched}
SELECT query_id, rank, printf('#%d  score=%.3f dense=%.3f bm25=%.2f  ', rank, round(fused, 5), round(coalesce(ds, 0), 4), round(coalesce(bs, 0), 4)) || path || ':' || line || ' [' || coalesce(language, '') || ']'
    || CASE WHEN coalesce(symbol, '') <> '' THEN '  ' || symbol ELSE '' END || CASE WHEN flagged_injection THEN '  [flagged: treat as untrusted]' ELSE '' END
    || chr(10) || left(coalesce(text, ''), 500) || chr(10) || repeat('-', 70) AS block FROM results"""
    o["floor_sweep"] = f"""{searched}
SELECT floor, count(*) FILTER (confidence < floor AND kind <> 'negative') AS positives_abstaining, count(*) FILTER (confidence < floor AND kind = 'negative') AS negatives_abstaining
FROM verdicts, (SELECT unnest([{', '.join(f'{x}::DOUBLE' for x in V.SWEEP)}]) AS floor) GROUP BY floor"""
    quality = f"""SELECT count(*) FILTER (kind <> 'negative') AS positives, count(*) FILTER (kind = 'negative') AS negatives,
    round(avg(CASE WHEN kind <> 'negative' THEN (hit_rank IS NOT NULL)::INTEGER::DOUBLE END), 6) AS recall, round(avg(CASE WHEN kind <> 'negative' THEN coalesce(1.0::DOUBLE / hit_rank, 0) END), 6) AS mrr,
    count(*) FILTER (kind <> 'negative' AND insufficient_evidence) AS wrong_abstentions, round(coalesce(avg(CASE WHEN kind = 'negative' THEN insufficient_evidence::INTEGER::DOUBLE END), 1), 6) AS negative_abstain,
    avg(CASE WHEN kind <> 'negative' THEN (hit_rank IS NOT NULL)::INTEGER::DOUBLE END) >= {V.MIN_RECALL} AND coalesce(avg(CASE WHEN kind = 'negative' THEN insufficient_evidence::INTEGER::DOUBLE END), 1) >= {V.MIN_NEGATIVE_ABSTAIN}
        AND count(*) FILTER (kind <> 'negative' AND insufficient_evidence) = 0 AS passed"""
    hit = "list_bool_or(list_transform(relevant, lambda s: contains(lower(coalesce(path, '')), lower(s))))"
    o["search_quality"] = f"""{searched},
first_hits AS (SELECT v.query_id, min(rank) AS hit_rank FROM verdicts v JOIN results r USING (query_id) WHERE {hit} GROUP BY 1)
{quality} FROM verdicts LEFT JOIN first_hits USING (query_id)"""
    o["recall_mrr"] = f"""{searched},
first_hits AS (SELECT v.query_id, min(rank) AS hit_rank FROM verdicts v JOIN bm USING (query_id) JOIN meta USING (chunk_id) WHERE rank <= {V.EVAL_K} AND {hit} GROUP BY 1)
{quality} FROM verdicts LEFT JOIN first_hits USING (query_id)"""
    o["channel_filter"] = f"""
WITH {GOLD} SELECT query_id, index_ord, (channels IS NULL OR len(channels) = 0 OR coalesce(list_contains(channels, channel), false)) AS applies FROM gold_q, manifest"""

    # --- chunking
    o["window_split"] = f"""{_windows('documents', 'doc_id', V.OVERLAP_LINES)},
parts AS (SELECT doc_id, 0::BIGINT AS i, text AS piece FROM docs WHERE len(text) <= {V.MAX_CHARS} UNION ALL SELECT doc_id, i, piece FROM cut)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS window_no, i::INTEGER AS line_offset, md5(piece) AS digest
FROM parts WHERE regexp_matches(piece, '[^\\s\\x{{A0}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{3000}}\\x{{0B}}\\x{{85}}]')"""
    o["post_split"] = f"""{_windows('meta', 'chunk_id', V.POST_OVERLAP_LINES, "path LIKE 'forum/%'")},
trimmed AS (SELECT chunk_id, i, regexp_replace(piece, '^[\\s\\x{{A0}}\\x{{0B}}]+|[\\s\\x{{A0}}\\x{{0B}}]+$', '', 'g') AS piece FROM cut),
parts AS (SELECT chunk_id, 0::BIGINT AS i, text AS piece FROM docs WHERE len(text) <= {V.MAX_CHARS} UNION ALL SELECT chunk_id, i, piece FROM trimmed WHERE piece <> '')
SELECT chunk_id, (row_number() OVER (PARTITION BY chunk_id ORDER BY i) - 1)::INTEGER AS window_no, i::INTEGER AS line_offset, len(piece)::INTEGER AS chars FROM parts"""
    o["file_predicates"] = f"""
WITH p AS (SELECT DISTINCT path, regexp_extract(path, '[^/]*$') AS base FROM meta WHERE path IS NOT NULL),
e AS (SELECT *, lower(regexp_extract(base, '^.+\\.([^.]*)$', 1)) AS ext FROM p)
SELECT path, base, ext AS extension, CASE WHEN base = 'CMakeLists.txt' OR base LIKE '%.cmake' THEN 'cmake' ELSE {_LANGUAGE} END AS language_of_path,
    NOT ({' OR '.join(f"contains(base, {_q(x)})" for x in V.SKIPPED_NAME_PARTS)}) AND (ext IN ({', '.join(map(_q, V.WANTED_EXTENSIONS))}) OR base IN ({', '.join(map(_q, V.WANTED_NAMES))})) AS wanted,
    len(list_intersect(string_split(path, '/')[1:-2], [{', '.join(map(_qp, NAMED.skipped_directories))}])) > 0 AS skipped_directory
FROM e"""
    o["language_counts"] = f"""
WITH e AS (SELECT regexp_extract(path, '[^/]*$') AS base, lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+\\.([^.]*)$', 1)) AS ext FROM meta)
SELECT CASE WHEN base = 'CMakeLists.txt' OR base LIKE '%.cmake' THEN 'cmake' ELSE {_LANGUAGE} END AS language_of_path, count(*) AS chunks FROM e GROUP BY 1"""

    # --- mail
    o["subject_normalize"] = f"""
SELECT msg_ord, {_SUBJECT} AS subject, coalesce(regexp_matches({_SUBJECT}, {_qp(NAMED.install_topic)}, 'i'), false) AS install,
    regexp_replace(regexp_replace(regexp_replace(sender, '<[^>]*>', '', 'g'), '^\\s+|\\s+$', '', 'g'), '^"+|"+$', '', 'g') AS sender_name FROM (SELECT DISTINCT * FROM messages)"""
    o["email_scrub"] = f"SELECT chunk_id, regexp_replace(text, {_q(V.EMAIL)}, {_q(V.EMAIL_PLACEHOLDER)}, 'g') AS text FROM meta"
    o["quoted_strip"] = f"""
WITH k AS (SELECT chunk_id, array_to_string(list_filter({LINES}, lambda l: NOT regexp_matches(l, '^[\\s\\x{{A0}}]*>')), chr(10)) AS x, text FROM meta WHERE path LIKE 'forum/%'),
c AS (SELECT chunk_id, text, regexp_replace(x || chr(10), '(\\n{_BLANK}*\\n{_BLANK}*)(?:\\n{_BLANK}*)+\\n', '\\1' || chr(10), 'g') AS x FROM k)
SELECT chunk_id, CASE WHEN text IS NULL THEN NULL ELSE regexp_replace(x, '^[\\s\\x{{A0}}]+|[\\s\\x{{A0}}]+$', '', 'g') END AS text FROM c"""
    o["thread_numbers_by_offset"] = o["thread_running_count"] = """
SELECT msg_ord, row_number() OVER (PARTITION BY coalesce(thread_id, 'unknown') ORDER BY msg_ord) AS number FROM (SELECT DISTINCT * FROM messages)"""
    year = r"nullif(regexp_extract(date_raw, '^\s*(?:[A-Za-z]{3},)?\s*\d{1,2} [A-Za-z]{3} (\d{4}) \d{2}:\d{2}:\d{2}', 1), '')::INTEGER"
    o["message_years"] = f"SELECT msg_ord, {year} AS year, coalesce({year} < {V.MIN_POST_YEAR}, false) AS old FROM (SELECT DISTINCT * FROM messages)"
    space = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
    trim = lambda x: f"regexp_replace({x}, '^{space}+|{space}+$', '', 'g')"
    cut = "(?im)(?:" + V.REPLY_HEADER + "|" + V.ATTRIBUTION + r")[\s\S]*\z"
    above = lambda x: f"regexp_replace(regexp_replace({x}, {_q(cut)}, ''), '{space}+\\z', '')"
    o["quote_boundary"] = f"SELECT chunk_id, {above('text')} AS text FROM meta WHERE path LIKE 'forum/%'"
    tidy = lambda x: f"regexp_replace(regexp_replace({above(x)}, {_q('(?is)' + V.LIST_FOOTER)}, '', 'g'), {_q(V.EMAIL)}, {_q(V.EMAIL_PLACEHOLDER)}, 'g')"
    name = f"""regexp_replace({trim("regexp_replace(coalesce(sender, ''), '<[^>]*>', '', 'g')")}, '^"+|"+$', '', 'g')"""
    # a word counts by its length with every sign escaped
    words = rf"""list_filter(list_transform(regexp_split_to_array({trim(name)}, '{space}+'), lambda w: regexp_replace(w, '^[''"]+|[''"]+$', '', 'g')),
        lambda w: len(regexp_replace(w, '[^A-Za-z0-9_\x{{80}}-\x{{FFFF}}]', 'xx', 'g')) > 2)"""
    edge = r"[^\p{L}\p{N}\p{M}_]"
    once = lambda x: rf"regexp_replace({x}, '(^|{edge})' || regexp_escape(w) || '($|{edge})', '\1{V.NAME_PLACEHOLDER}\2', 'g')"
    greeting = V.GREETING.replace("(?iu:", "(?i:").replace(r"(?=[ \t]*[,:!.]|[ \t]*$)", r"([ \t]*[,:!.]|[ \t]*$)")
    # a match takes its neighbours with it, so a second pass finds names that share a blank
    unnamed = f"list_reduce(list_prepend(tidy, words), lambda x, w: {once(once('x'))})"
    scrubbed = f"regexp_replace({unnamed}, {_q('(?m)' + greeting)}, '\\1{V.NAME_PLACEHOLDER}\\2', 'g')"
    o["scrub_chain"] = f"""
WITH s AS (SELECT chunk_id, min(sender) AS sender FROM messages WHERE chunk_id IS NOT NULL GROUP BY 1),
p AS (SELECT chunk_id, {tidy('text')} AS tidy, {words} AS words FROM meta LEFT JOIN s USING (chunk_id) WHERE path LIKE 'forum/%')
SELECT chunk_id, CASE WHEN tidy IS NOT NULL THEN {scrubbed} END AS text FROM p"""
    stripped = f"""regexp_replace(regexp_replace(array_to_string(list_filter({LINES}, lambda l: NOT regexp_matches(l, '^[\\s\\x{{A0}}]*>')), chr(10)) || chr(10), '(\\n{_BLANK}*\\n{_BLANK}*)(?:\\n{_BLANK}*)+\\n', '\\1' || chr(10), 'g'), '^[\\s\\x{{A0}}]+|[\\s\\x{{A0}}]+$', '', 'g')"""
    o["forum_rows"] = f"""
WITH m AS (SELECT DISTINCT * FROM messages), b AS (SELECT chunk_id, {stripped} AS stripped FROM (SELECT chunk_id, coalesce(text, '') AS text FROM meta)),
k AS (
    SELECT m.*, stripped, regexp_replace({trim("coalesce(subject, '')")}, {_q(V.EMAIL)}, {_q(V.EMAIL_PLACEHOLDER)}, 'g') AS clean FROM m JOIN b USING (chunk_id)
    WHERE NOT coalesce({year} < {V.MIN_POST_YEAR}, false) AND NOT coalesce(regexp_matches({_SUBJECT}, {_qp(NAMED.install_topic)}, 'i'), false) AND len(stripped) >= {V.MIN_POST_CHARS}),
n AS (SELECT *, row_number() OVER (PARTITION BY coalesce(thread_id, 'unknown') ORDER BY msg_ord) AS number, {tidy('stripped')} AS tidy, {words} AS words FROM k)
SELECT 'forum/' || coalesce(thread_id, 'unknown') AS path, number AS line, 'Subject: ' || clean || chr(10) || 'Date: ' || coalesce(date_raw, '') || chr(10) || chr(10) || {trim(scrubbed)} AS text,
    clean AS symbol, 'forum' AS language, 'post' AS chunk_type, {_qp(NAMED.forum_source)} AS source FROM n"""
    o["build_counters"] = f"""
WITH m AS (SELECT DISTINCT * FROM messages),
k AS (SELECT chunk_id, regexp_replace(regexp_replace(array_to_string(list_filter({LINES}, lambda l: NOT regexp_matches(l, '^[\\s\\x{{A0}}]*>')), chr(10)) || chr(10), '(\\n{_BLANK}*\\n{_BLANK}*)(?:\\n{_BLANK}*)+\\n', '\\1' || chr(10), 'g'), '^[\\s\\x{{A0}}]+|[\\s\\x{{A0}}]+$', '', 'g') AS stripped FROM meta),
j AS (
    SELECT thread_id, CASE WHEN coalesce({year} < {V.MIN_POST_YEAR}, false) THEN 'old' WHEN coalesce(regexp_matches({_SUBJECT}, {_qp(NAMED.install_topic)}, 'i'), false) THEN 'install'
        WHEN len(coalesce(stripped, '')) < {V.MIN_POST_CHARS} THEN 'short' END AS reason FROM m LEFT JOIN k USING (chunk_id))
SELECT count(*) AS messages, count(*) FILTER (reason = 'old') AS old, count(*) FILTER (reason = 'install') AS install, count(*) FILTER (reason = 'short') AS short,
    count(*) FILTER (reason IS NULL) AS kept, count(DISTINCT CASE WHEN reason IS NULL THEN coalesce(thread_id, 'unknown') END) AS threads FROM j"""
    o["html_to_text"] = """
SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '(?is)<style\\b[^>]*>.*?</style>', ' ', 'g'), '(?is)<script\\b[^>]*>.*?</script>', ' ', 'g'), '<[^>]+>', ' ', 'g')) AS digest FROM documents"""

    # --- indexes
    o["index_union"] = "SELECT index_ord, CASE WHEN index_ord = 2 THEN source END AS source, count(*) AS chunks, sum(len(text))::BIGINT AS chars FROM meta GROUP BY 1, 2"
    o["dense_ids"] = "SELECT chunk_id, row_number() OVER (ORDER BY path NULLS FIRST, line NULLS FIRST, chunk_id) - 1 AS position FROM meta"
    o["index_build_ids"] = "SELECT row_number() OVER (ORDER BY path NULLS FIRST, line NULLS FIRST, chunk_id) - 1 AS chunk_id, chunk_id AS own_id, md5(text) AS digest FROM meta"
    o["shard_assignment"] = """
WITH p AS (SELECT chunk_id, row_number() OVER (ORDER BY chunk_id) - 1 AS position, count(*) OVER () AS total FROM meta),
b AS (SELECT s, total * s // 8 AS start, total * (s + 1) // 8 AS stop FROM (SELECT DISTINCT total FROM p), (SELECT unnest(range(0, 8)) AS s))
SELECT chunk_id, s::INTEGER AS shard FROM p JOIN b ON position >= start AND position < stop"""
    o["shard_bounds"] = """
SELECT index_ord, s::INTEGER AS shard, total * s // 8 AS start, total * (s + 1) // 8 AS stop FROM (SELECT index_ord, count(*) AS total FROM meta GROUP BY 1), (SELECT unnest(range(0, 8)) AS s)"""
    o["shard_merge_check"] = "SELECT count(*) AS n_shards, concat_ws(';', " + ", ".join(
        f"CASE WHEN count(DISTINCT coalesce({k}::VARCHAR, chr(1))) > 1 THEN '{k} differs' END" for k in V.SHARD_KEYS
    ) + ") AS errors FROM manifest"
    o["forum_upsert"] = f"""
SELECT chunk_id, path, md5(CASE WHEN path LIKE 'forum/%' THEN regexp_replace(text, {_q(V.EMAIL)}, {_q(V.EMAIL_PLACEHOLDER)}, 'g') ELSE text END) AS digest FROM meta"""
    o["index_validate"] = """
WITH r AS (SELECT index_ord, count(*) AS n FROM meta GROUP BY 1),
s AS (SELECT DISTINCT chunk_id, len(embeddings) AS dim FROM vector_store WHERE embeddings IS NOT NULL),
v AS (SELECT index_ord, count(DISTINCT chunk_id) AS n, count(DISTINCT dim) AS dims, min(dim) AS low, max(dim) AS high FROM meta JOIN s USING (chunk_id) GROUP BY 1)
SELECT index_ord, coalesce(r.n, 0) AS rows, coalesce(v.n, 0) AS vectors, coalesce(v.dims, 0) AS dims,
    concat_ws(';', CASE WHEN coalesce(r.n, 0) = 0 THEN 'empty' END, CASE WHEN coalesce(m.model, '') = '' THEN 'no model' END, CASE WHEN coalesce(v.n, 0) <> coalesce(r.n, 0) THEN 'vectors missing' END,
        CASE WHEN v.dims > 1 THEN 'dimensions differ' END, CASE WHEN v.low <> m.dim OR v.high <> m.dim THEN 'dimension differs from manifest' END) AS errors
FROM manifest m FULL JOIN r USING (index_ord) LEFT JOIN v USING (index_ord)"""
    o["manifest_health"] = f"SELECT index_ord, {', '.join(V.MANIFEST_FIELDS)} FROM manifest"
    body = "{" + ", ".join(f"'{c}': coalesce({c}::VARCHAR, '')" for c in ("model", "dim", "channel", "version_label", "commit_sha")) + "}"
    o["manifest_json"] = f"SELECT index_ord, to_json({body})::VARCHAR AS body, coalesce(model, '') AS model FROM manifest"
    o["channel_slug"] = f"""
WITH m AS (SELECT index_ord, coalesce(engine_ref, 'feature/x y') AS ref, coalesce(engine_version, '0.0') AS version, built_at FROM manifest),
x AS (SELECT *, regexp_matches(ref, '^v?\\d+\\.\\d+(\\.\\d+)?$') AS rel, array_to_string(string_split(version, '.')[1:2], '.') AS short, upper({PRODUCT}[1]) || {PRODUCT}[2:] AS product FROM m)
SELECT index_ord, CASE WHEN rel THEN ltrim(ref, 'v') ELSE regexp_replace(ref, '[^A-Za-z0-9._-]+', '-', 'g') END AS channel,
    CASE WHEN rel THEN 'Py' || product || ' ' || short ELSE product || ' ' || ref || ' snapshot ' || built_at || ' (post-' || short || ' development)' END AS label FROM x"""
    o["content_hash"] = "SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents"

    # --- digests, releases, services
    lines = f"""lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls)))::INTEGER AS line_no FROM (SELECT doc_id, {LINES} AS ls FROM documents WHERE text IS NOT NULL)),
    levels AS (SELECT doc_id, line_no, line, len(regexp_extract(regexp_replace(line, '^[\\s\\x{{A0}}]+', ''), '^#+'))::INTEGER AS level FROM lines)"""
    o["digest_headings"] = f"WITH {lines} SELECT doc_id, line_no, level, line FROM levels WHERE level > 0"
    o["digest_section"] = f"""
WITH {lines},
heads AS (SELECT doc_id, min({{'n': line_no, 'l': level}}) AS h FROM levels WHERE level > 0 AND contains(lower(line), 'solver') GROUP BY 1),
ends AS (SELECT doc_id, h, coalesce((SELECT min(l.line_no) FROM levels l WHERE l.doc_id = heads.doc_id AND l.line_no > h.n AND l.level > 0 AND l.level <= h.l), 2000000000) AS stop FROM heads)
SELECT doc_id, h.n AS start_line, h.l AS level, string_agg(line, chr(10) ORDER BY line_no) AS section FROM ends JOIN levels USING (doc_id) WHERE line_no >= h.n AND line_no < stop GROUP BY doc_id, h.n, h.l"""
    o["release_pick"] = "SELECT 'index-main-2b.zip' AS name, 'u/2b' AS zip_url, 'u/2s' AS sha256_url"
    o["provider_resolve"] = "SELECT * FROM (VALUES (1, 'openai'), (2, 'local'), (3, 'local'), (4, 'openai'), (5, 'anthropic'), (6, 'anthropic'), (7, 'openai')) t(case_id, resolved)"
    return o
