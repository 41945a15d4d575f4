"""Registered queries of the operators and their SQL, over a folder of the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wildgrid.llm import (
    byte_bpe, decontaminate, language_id, licenses, line_dedup, merkle_manifest, neighbours, oracles, prefix_trie,
    quality, simhash, substring_dedup, suffix_dedup, toxicity,
)
from wildgrid.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(spark, table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(spark, table(spark, sf_dir, "documents"))


def tokenizer(spark: SparkSession) -> byte_bpe.ByteBPE:
    import public_tokenizers

    return byte_bpe.ByteBPE(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"), tokenizer(spark))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digests(spark, table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digests(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.digests(spark, table(spark, sf_dir, "embeddings"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(spark, table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digests(table(spark, sf_dir, "documents"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(spark, table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.digests(spark, table(spark, sf_dir, "conversations"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.digests(spark, table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_toxicity": op1_toxicity,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_line_dedup": op3_line_dedup,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_simhash": op5_simhash,
    "op6_decontaminate": op6_decontaminate,
    "op7_neighbours": op7_neighbours,
    "op8_language_id": op8_language_id,
    "op9_quality": op9_quality,
    "op10_licenses": op10_licenses,
    "op11_substring_dedup": op11_substring_dedup,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_merkle_manifest": op13_merkle_manifest,
}

# Words of a text as the contract of op6 cuts them.
_WORDS = r"""
[x FOR x IN string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> '']
"""

# Blanks that op3 strips, as an SQL expression.
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLES: dict[str, str] = {
    "op3_line_dedup": f"""
WITH docs AS (
    SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), lines AS (
    SELECT rid, doc_id, pos, parts[pos] AS line,
        translate(trim(parts[pos], {_BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM docs, unnest(generate_series(1, len(parts))) AS t(pos)
), frequent AS (
    SELECT key, max(doc_id) AS last FROM lines WHERE length(key) >= 20
    GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), judged AS (
    SELECT rid, doc_id, pos, line, last IS NOT NULL AND doc_id <> last AS gone FROM lines LEFT JOIN frequent USING (key)
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY rid
""",
    "op6_decontaminate": f"""
WITH docs AS (
    SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents
), bench AS (
    SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark
), windows AS (
    SELECT DISTINCT item, least(len(w), 10) AS size, list_slice(w, s, s + least(len(w), 10) - 1) AS win
    FROM bench, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS t(s) WHERE len(w) > 0
), sizes AS (
    SELECT DISTINCT size FROM windows
), cuts AS (
    SELECT rid, s, size, list_slice(w, s, s + size - 1) AS win
    FROM docs, sizes, unnest(generate_series(1, len(w) - size + 1)) AS t(s) WHERE len(w) >= size
), hits AS (
    SELECT rid, s, size, item FROM cuts JOIN windows USING (size, win)
), words AS (
    SELECT rid, count(DISTINCT p) AS n_hit
    FROM (SELECT DISTINCT rid, s, size FROM hits), unnest(generate_series(s, s + size - 1)) AS t(p) GROUP BY rid
), items AS (
    SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items
    FROM hits GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
""",
    "op10_licenses": licenses.oracle(),
    "op11_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op12_prefix_trie": oracles.PREFIX_TRIE,
    "op13_merkle_manifest": oracles.MERKLE_MANIFEST,
}
