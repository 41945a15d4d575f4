"""SQL of the queries over repeated word sequences, conversation prefixes and the manifest."""

from __future__ import annotations


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text: per character its code, then eight shifts, which -1 stands for."""
    steps = f"flatten([[ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR ch IN string_split({text}, '')])"
    shifted = "xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END)"
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {steps}),
        lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE {shifted} END))"""


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _leaf(text: str = "text") -> str:
    fields = ["doc_id", "source", "lang", "n_chars", text]
    values = [f"CAST({f} AS VARCHAR)" for f in fields]
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"


def _levels(name: str, leaves: str) -> str:
    """The nodes (g, level, ix, h, n) of trees over ``leaves`` (g, ix, h), and their runs."""
    return f"""
{name} AS (
    SELECT g, 0 AS level, ix, h, count(*) OVER (PARTITION BY g) AS n FROM {leaves}
    UNION ALL
    SELECT g, level + 1, ix // 16, sha256(string_agg(h, '' ORDER BY ix)), (n + 15) // 16
    FROM {name} WHERE n > 1 GROUP BY g, level, ix // 16, n
), {name}_runs AS (
    SELECT g, level, ix // 16 AS run, list(h ORDER BY ix) AS hs FROM {name} WHERE n > 1 GROUP BY g, level, ix // 16
)"""


def _folded(name: str, start: str, runs: str) -> str:
    """Rows of ``start`` (rid, g, ix, cur, others) led up through ``runs``, level by level."""
    before, after = "list_slice(hs, 1, ix % 16)", "list_slice(hs, ix % 16 + 2, 16)"
    return f"""
{name} AS (
    SELECT rid, g, 0 AS level, ix, cur, others FROM {start}
    UNION ALL
    SELECT rid, f.g, f.level + 1, ix // 16,
        sha256(array_to_string(list_concat(list_concat({before}, [cur]), {after}), '')),
        others || array_to_string(list_concat({before}, {after}), '')
    FROM {name} f JOIN {runs} r ON r.g = f.g AND r.level = f.level AND r.run = f.ix // 16
)"""


SUBSTRING_DEDUP = r"""
WITH docs AS (
    SELECT row_number() OVER () AS rid, doc_id,
        [x FOR x IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents
), windows AS (
    SELECT rid, s, array_to_string(list_slice(w, s, s + 34), ' ') AS win
    FROM docs, unnest(generate_series(1, len(w) - 34)) AS t(s) WHERE len(w) >= 35
), often AS (
    SELECT win FROM windows GROUP BY win HAVING count(*) > 1
), gone AS (
    SELECT DISTINCT rid, p FROM (SELECT rid, s FROM windows SEMI JOIN often USING (win)), unnest(generate_series(s, s + 34)) AS t(p)
), words AS (
    SELECT rid, p, w[p] AS word, g.p IS NOT NULL AS out
    FROM (SELECT rid, w, unnest(generate_series(1, len(w))) AS p FROM docs) LEFT JOIN gone g USING (rid, p)
), kept AS (
    SELECT rid, count(*) FILTER (out) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT out) AS rest FROM words GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
    sha256(coalesce(rest, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (rid)
"""

PREFIX_TRIE = f"""
WITH convs AS (
    SELECT conv_id AS c, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, ''))
        ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS w,
        {_crc32("CAST(any_value(conv_id) AS VARCHAR)")} % 9 AS h
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), rebuilt AS (
    SELECT a.c, list_concat(coalesce(list_slice(b.w, 1, a.h), []), list_slice(a.w, a.h + 1, len(a.w))) AS q
    FROM convs a LEFT JOIN convs b ON b.c = a.c - a.c % 5
), prefixes AS (
    SELECT c, d, list_slice(q, 1, d) AS k, len(q) = d AS ends, CASE WHEN d > 0 THEN strlen(q[d].t) ELSE 0 END AS bytes
    FROM rebuilt, unnest(generate_series(0, len(q))) AS t(d)
), nodes AS (
    SELECT d, k, min(c) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
        sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
    FROM prefixes GROUP BY d, k
), children AS (
    SELECT d - 1 AS d, list_slice(k, 1, d - 1) AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL
), under AS (
    SELECT list_slice(k, 1, a) AS k, a AS d, sum((n_convs - 1) * bytes) AS saved, count(*) FILTER (n IS NULL) AS leaves
    FROM (SELECT d, k, n_convs, bytes, n FROM nodes LEFT JOIN children USING (d, k)), unnest(generate_series(0, d)) AS t(a)
    GROUP BY ALL
)
SELECT v.conv_id, v.d AS depth, p.conv_id AS parent_conv_id, v.n_convs, CAST(coalesce(c.n, 0) AS BIGINT) AS n_children,
    CAST(u.leaves AS BIGINT) AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, v.ends_sha256
FROM nodes v JOIN under u USING (d, k) LEFT JOIN children c USING (d, k)
LEFT JOIN nodes p ON p.d = v.d - 1 AND p.k = list_slice(v.k, 1, v.d - 1)
"""

MERKLE_MANIFEST = f"""
WITH RECURSIVE rows AS (
    SELECT row_number() OVER () AS rid, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, doc_id, {_leaf()} AS h,
        CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN {_leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} END AS changed
    FROM documents
), leaves AS (
    SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS ix FROM rows
), {_levels("inner_nodes", "leaves")}, subroots AS (
    SELECT 0 AS g, g AS ix, h FROM inner_nodes WHERE n = 1
), {_levels("top_nodes", "subroots")}, starts AS (
    SELECT rid, g, ix, coalesce(changed, h) AS cur, '' AS others FROM leaves
), {_folded("walk", "starts", "inner_nodes_runs")}, tops AS (
    SELECT rid, 0 AS g, g AS ix, last(cur ORDER BY level) AS cur, last(others ORDER BY level) AS others FROM walk GROUP BY rid, g
), {_folded("climb", "tops", "top_nodes_runs")}, folded AS (
    SELECT rid, last(cur ORDER BY level) AS cur, last(others ORDER BY level) AS others FROM climb GROUP BY rid
), root AS (
    SELECT h FROM top_nodes WHERE n = 1
)
SELECT doc_id, l.h AS leaf, s.h AS subroot, root.h AS root, sha256(others) AS proof_sha256, cur AS folded_root, cur = root.h AS verified
FROM leaves l JOIN subroots s ON s.ix = l.g JOIN folded USING (rid), root
"""
