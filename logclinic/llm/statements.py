"""SQL for the operators that SQL can express, written for DuckDB."""

from __future__ import annotations

_WORDS = r"list_filter(string_split_regex(coalesce({}, ''), '[ \t-\r]+'), lambda w: w <> '')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SUBSTRING_DEDUP = f"""
WITH w AS MATERIALIZED (SELECT doc_id, {_WORDS.format("text")} AS ws FROM documents),
windows AS MATERIALIZED (
    SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)
),
firsts AS (SELECT g, min(doc_id) AS first_id FROM windows GROUP BY g),
hits AS (SELECT doc_id, i FROM windows JOIN firsts USING (g) WHERE first_id < doc_id),
gone AS MATERIALIZED (SELECT DISTINCT doc_id, i + k AS p FROM hits, range(13) AS r(k)),
placed AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (
    SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY p) AS kept_text
    FROM placed ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n_kept, 0))::BIGINT AS n_removed, sha256(coalesce(kept_text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

_RULES = ("short", "repeated", "symbols")
_WEIGHT = "least(greatest(CASE WHEN v_{0} > 0 THEN m_{0} * (1 - m_{0}) / v_{0} - 1 ELSE 1000 END, 2), 1000)"
_RATES = ", ".join(f"(n_{r} + {_WEIGHT.format(r)} * m_{r}) / (n_docs + {_WEIGHT.format(r)})" for r in _RULES)

HOST_RULES = f"""
WITH d AS MATERIALIZED (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS MATERIALIZED (SELECT doc_id, {_WORDS.format("text")} AS ws FROM d),
grams AS MATERIALIZED (SELECT doc_id, i, (ws[i], ws[i + 1], ws[i + 2]) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, g FROM grams GROUP BY doc_id, g HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM grams JOIN twice USING (doc_id, g), range(3) AS r(k) GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')) AS ls FROM d),
measured AS (
    SELECT doc_id, source, len(ws)::BIGINT AS n_words, coalesce(length(array_to_string(ws, '')), 0)::BIGINT AS word_chars,
        (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
        coalesce(n, 0)::BIGINT AS n_repeat_words
    FROM d JOIN w USING (doc_id) JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)
),
failing AS MATERIALIZED (
    SELECT *, n_words < 50 AS short, n_repeat_words * 100 > n_words * 50 AS repeated, n_symbols * 10 > word_chars AS symbols,
        n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed
    FROM measured
),
hosts AS MATERIALIZED (SELECT source, count(*) AS n_docs, {", ".join(f"count(*) FILTER (WHERE {r}) AS n_{r}" for r in _RULES)} FROM failing GROUP BY source),
prior AS (SELECT {", ".join(f"sum(n_{r}) / sum(n_docs) AS m_{r}, var_pop(n_{r} / n_docs) AS v_{r}" for r in _RULES)} FROM hosts),
rejected AS (SELECT source, greatest({_RATES}) > 0.6 AS host_rejected FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT host_rejected AS kept, host_rejected
FROM failing f JOIN rejected r ON f.source IS NOT DISTINCT FROM r.source
"""

JACCARD_JOIN = f"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {_WORDS.format(_LOWER)} AS ws FROM documents),
shingles AS MATERIALIZED (
    SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)
),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM shingles x JOIN shingles y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
links AS MATERIALIZED (
    SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)
),
sides AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id AS id, doc_id AS other FROM w UNION SELECT id, b FROM reached JOIN sides ON other = a)
SELECT id AS doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(other) AS component_id FROM reached LEFT JOIN sizes ON id = doc_id GROUP BY id
"""

#: The table of the checksum by its rule: eight shifts of each byte, xor-ed with the polynomial where a bit falls out.
_CRC_TABLE = "list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b))"
_BYTES = "list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)"
_MARKED = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_MARKED.format(c) for c in ("doc_id", "source", "lang", "{0}", "text")) + ")"
_TREE = """
{0}(level, tree, i, h, n) AS (
    SELECT 0, tree, i, h, n FROM {1}
    UNION ALL
    SELECT level + 1, tree, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM {0} WHERE n > 1 GROUP BY ALL
)"""

MERKLE = f"""
WITH RECURSIVE crc AS (SELECT {_CRC_TABLE} AS t),
hashed AS MATERIALIZED (
    SELECT doc_id, lang, {_LEAF.format("n_chars")} AS leaf, {_LEAF.format("(n_chars + 1)")} AS other_leaf,
        xor(list_reduce({_BYTES}, lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295::BIGINT), 4294967295) % 7 = 0 AS tampered
    FROM documents, crc
),
leaves AS MATERIALIZED (
    SELECT *, leaf AS h, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
        count(*) OVER (PARTITION BY lang) AS n
    FROM hashed
),{_TREE.format("nodes", "leaves")},
tops AS MATERIALIZED (SELECT 0 AS tree, tree AS i, h, count(*) OVER () AS n FROM nodes WHERE n = 1),{_TREE.format("upper", "tops")},
levels AS MATERIALIZED (SELECT tree, max(level) AS height FROM nodes GROUP BY tree),
steps AS MATERIALIZED (
    SELECT l.doc_id, l.leaf, s.level AS k, coalesce(o.h, '') AS sibling, (l.i >> s.level) & 1 = 1 AS at_left
    FROM leaves l JOIN (SELECT DISTINCT tree, level FROM nodes WHERE n > 1) s USING (tree)
    LEFT JOIN nodes o ON o.tree = l.tree AND o.level = s.level AND o.i = xor(l.i >> s.level, 1)
    UNION ALL
    SELECT l.doc_id, l.leaf, height + s.level, coalesce(o.h, ''), (l.tree >> s.level) & 1 = 1
    FROM leaves l JOIN levels USING (tree), (SELECT DISTINCT level FROM upper WHERE n > 1) s
    LEFT JOIN upper o ON o.level = s.level AND o.i = xor(l.tree >> s.level, 1)
),
proofs AS (SELECT doc_id, leaf, string_agg(sibling, '' ORDER BY k) AS proof, list(struct_pack(s := sibling, l := at_left) ORDER BY k) AS path FROM steps GROUP BY doc_id, leaf),
folded AS (
    SELECT doc_id, leaf, tree, coalesce(proof, '') AS proof, list_reduce(
        list_transform(coalesce(path, []), lambda x: CASE WHEN x.l THEN 'l' ELSE 'r' END || x.s),
        lambda held, x: CASE WHEN x[1] = 'l' THEN sha256(x[2:] || held) ELSE sha256(held || x[2:]) END, CASE WHEN tampered THEN coalesce(other_leaf, leaf) ELSE leaf END) AS folded_root
    FROM leaves LEFT JOIN proofs USING (doc_id, leaf)
)
SELECT doc_id, leaf, t.h AS subroot, r.h AS root, sha256(proof) AS proof_sha256, folded_root, folded_root = r.h AS verified
FROM folded JOIN tops t ON t.i = folded.tree, (SELECT h FROM upper WHERE n = 1) r
"""

STATEMENTS = {"op1_substring_dedup": SUBSTRING_DEDUP, "op5_host_rules": HOST_RULES, "op8_jaccard_join": JACCARD_JOIN, "op12_merkle": MERKLE}
