"""SQL answers (DuckDB) of the queries that SQL can express. The others are tested by brute force."""

from __future__ import annotations

from tokenledger.llm import chat, clustering, lexical, quality, urls

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANK_WORD = r"[^\x20\x09-\x0D]+"
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP1 = rf"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents
), parts AS (
    SELECT r, doc_id, host, text, regexp_extract_all(text, '{BLANK_WORD}') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{BLANK_WORD}')) AS lines
    FROM docs
), windows AS (
    SELECT r, i, array_to_string(words[i:i + 4], ' ') AS w
    FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM parts WHERE len(words) >= 5)
), repeated AS (
    SELECT r, count(DISTINCT place) AS n
    FROM (
        SELECT r, unnest([i, i + 1, i + 2, i + 3, i + 4]) AS place
        FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS n FROM windows) WHERE n > 1
    )
    GROUP BY r
), counts AS (
    SELECT doc_id, host, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
        len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
    FROM parts LEFT JOIN repeated USING (r)
), flags AS (
    SELECT *, n_words < 10 AS short, 100 * n_repeat_words > 20 * n_words AS repeats,
        100 * n_symbols > 10 * word_chars AS symbols, 100 * n_dup_lines > 30 * n_lines AS lines
    FROM counts
), rates AS (
    SELECT host, rule, count(*) AS n, count(*) FILTER (failed) AS k
    FROM (
        SELECT host, unnest(['short', 'repeats', 'symbols', 'lines']) AS rule,
            unnest([short, repeats, symbols, lines]) AS failed
        FROM flags
    )
    GROUP BY ALL
), moments AS (
    SELECT rule, sum(k) / sum(n) AS mean, var_pop(k / n) AS spread, avg(1 / n) AS inverse FROM rates GROUP BY rule
), priors AS (
    SELECT rule, mean, least(greatest(CASE WHEN spread - mean * (1 - mean) * inverse > 0
        THEN mean * (1 - mean) / (spread - mean * (1 - mean) * inverse) - 1
        ELSE {quality.MAX_WEIGHT} END, {quality.MIN_WEIGHT}), {quality.MAX_WEIGHT}) AS weight
    FROM moments
), hosts AS (
    SELECT host, max((k + mean * weight) / (n + weight)) > {quality.MAX_RATE} AS rejected
    FROM rates JOIN priors USING (rule) GROUP BY host
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    short OR repeats AS base_failed, NOT (short OR repeats) AND NOT rejected AS kept
FROM flags JOIN hosts USING (host)
"""

_RULE_ROWS = ", ".join(f"('{verdict}', '{host}', '{path}')" for verdict, host, path in urls.PREFIX_RULES)

OP2 = rf"""
WITH rules(verdict, rule_host, rule_path) AS (VALUES {_RULE_ROWS}), places AS (
    SELECT page_id,
        translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
    FROM pages
), fits AS (
    SELECT DISTINCT host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
        arg_max(verdict, length(rule_host || rule_path)) AS verdict
    FROM (SELECT DISTINCT host, path FROM places) JOIN rules
        ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    GROUP BY host, path
)
SELECT page_id, host, path, rule, coalesce(verdict,
    CASE WHEN len(list_intersect(regexp_split_to_array(host, '[^A-Za-z0-9]'), [{", ".join(f"'{w}'" for w in urls.BLOCKED_WORDS)}])) > 0
        THEN 'block' ELSE 'allow' END) AS verdict
FROM places LEFT JOIN fits USING (host, path)
"""

OP4 = rf"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{BLANK_WORD}') AS w FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
    SELECT x.doc_id AS a, y.doc_id AS b
    FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id
        JOIN sizes p ON p.doc_id = x.doc_id JOIN sizes q ON q.doc_id = y.doc_id
    GROUP BY x.doc_id, y.doc_id, p.n, q.n
    HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))
), reached(a, b) AS (
    SELECT a, b FROM links
    UNION
    SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
), least AS (
    SELECT a, min(b) AS b FROM reached GROUP BY a
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id,
    doc_id <= coalesce(b, doc_id) AS kept
FROM words LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON a = doc_id
"""

OP7 = rf"""
WITH doc_words AS (
    SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{ALNUM_WORD}') AS w FROM documents
), item_words AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{ALNUM_WORD}') AS w FROM benchmark
), item_windows AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + 9], ' ') AS s
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM item_words WHERE len(w) > 0)
), doc_windows AS (
    SELECT r, i, size, array_to_string(w[i:i + size - 1], ' ') AS s
    FROM (
        SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i
        FROM doc_words, (SELECT DISTINCT size FROM item_windows) WHERE len(w) >= size
    )
), found AS (
    SELECT r, i, size, item_id FROM doc_windows JOIN item_windows USING (size, s)
), hit AS (
    SELECT r, count(DISTINCT place) AS n FROM (SELECT r, unnest(range(i, i + size)) AS place FROM found) GROUP BY r
), items AS (
    SELECT r, list_sort(list_distinct(list(item_id::VARCHAR))) AS ids FROM found GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_hit, coalesce(len(ids), 0) AS n_items,
    sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""

OP11 = rf"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{ALNUM_WORD}') AS words FROM documents
), sums AS (
    SELECT count(*) FILTER (len(words) > 0) AS n_docs, sum(len(words))::BIGINT AS n_terms FROM docs
), item_terms AS (
    SELECT q, item_id, t, count(*) AS repeats
    FROM (
        SELECT row_number() OVER () AS q, item_id,
            unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{ALNUM_WORD}')) AS t
        FROM benchmark
    )
    GROUP BY ALL
), held AS (
    SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(words) AS t FROM docs)
    WHERE t IN (SELECT t FROM item_terms) GROUP BY ALL
), weights AS (
    SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM held, sums GROUP BY t, n_docs
), scores AS (
    SELECT q, item_id, r, doc_id, sum(repeats * w * ((1000000000 * tf)
        // (1000 * tf + 12 * (100 - 25 + ((25 * len(words) * n_docs) // n_terms)))))::BIGINT AS score
    FROM item_terms JOIN held USING (t) JOIN weights USING (t) JOIN docs USING (r), sums
    GROUP BY q, item_id, r, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS FIRST)::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= {lexical.TOP}
"""


def _nearest(i: int) -> str:
    """Vectors with their nearest centroid of round ``i``."""
    return f"""a{i} AS MATERIALIZED (
    SELECT r, vec_id, v, k, d FROM (
        SELECT r, vec_id, kept.v, k, list_sum(list_transform(range(1, {clustering.DIMENSION + 1}),
            lambda j: (kept.v[j] - c{i}.v[j]) * (kept.v[j] - c{i}.v[j]))) AS d
        FROM kept, c{i}
    ) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1
)"""


def _moved(i: int) -> str:
    """Centroids of round ``i`` + 1: exact floors of the means."""
    return f"""c{i + 1} AS MATERIALIZED (
    SELECT k, coalesce(m.v, c{i}.v) AS v FROM c{i} LEFT JOIN (
        SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS v
        FROM (SELECT k, j, sum(v[j]) AS s, count(*) AS n FROM a{i}, range(1, {clustering.DIMENSION + 1}) AS t(j) GROUP BY k, j)
        GROUP BY k
    ) m USING (k)
)"""


_ROUNDS = ", ".join(f"{_nearest(i)}, {_moved(i)}" for i in range(clustering.ROUNDS))

OP12 = f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({clustering.SCALE} * x::DOUBLE)::BIGINT) AS v
    FROM embeddings
    WHERE len(embedding) = {clustering.DIMENSION} AND len(list_filter(embedding, lambda x: isfinite(x))) = {clustering.DIMENSION}
), c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY sha256('{clustering.SEED}:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS k, v
    FROM kept QUALIFY k < {clustering.K}
), {_ROUNDS}, {_nearest(clustering.ROUNDS)}
SELECT vec_id, k::INTEGER AS cluster, d::BIGINT AS distance,
    (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
    sha256(array_to_string(c{clustering.ROUNDS}.v, ',')) AS centroid_sha256
FROM a{clustering.ROUNDS} JOIN (SELECT k, v FROM c{clustering.ROUNDS}) AS c{clustering.ROUNDS} USING (k)
"""

_MARK = chat.ESCAPABLE
_BLOCK = len(chat.START + chat.SEP + chat.END)

OP13 = rf"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), sized AS (
    SELECT *, length(regexp_replace(role, '{_MARK}', '\1\2\\\3', 'g')) AS role_size,
        length(regexp_replace(text, '{_MARK}', '\1\2\\\3', 'g')) AS text_size,
        lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS NOT DISTINCT FROM role AS merged
    FROM turns
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(text_size + CASE WHEN merged THEN {len(chat.NEXT)} ELSE role_size + {_BLOCK} END)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

ORACLES = {
    "op1_quality_rules": OP1,
    "op2_url_filters": OP2,
    "op4_neardup": OP4,
    "op7_decontamination": OP7,
    "op11_lexical_search": OP11,
    "op12_centroid_clustering": OP12,
    "op13_chat_formatting": OP13,
}
