"""Pipeline over a corpus of documents: from raw texts to token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result
as Parquet into the shared folder and reads it again as the next stage's documents. All
stages but the last return the columns of documents. An empty table passes through all
stages; NULL texts are handled as the operators' docstrings say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from wildgrid.llm import byte_bpe, decontaminate, jaccard, line_dedup, quality, registry, simhash
from wildgrid.llm.common import table, whole_text, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front if a column of the documents has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality.train(spark, docs, table(spark, sf_dir, "labels"))
    score = free_name(docs, "score")
    scored = docs.withColumn(score, quality.score(spark, model, whole_text("text")))
    return scored.filter(F.col(score) >= quality.ACCEPT).select(*[F.col(f"`{c}`") for c in docs.columns])


def without_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that they share with two others or more."""
    kept, n_lines, n_dropped = (free_name(docs, name) for name in ("kept", "n_lines", "n_dropped"))
    cut = line_dedup.drop_lines(spark, docs, kept=kept, n_lines=n_lines, n_dropped=n_dropped)
    changed = F.col(n_dropped) > 0
    new = {
        "text": F.when(changed, F.col(kept)).otherwise(F.col("text")),
        "n_chars": F.when(changed, F.char_length(kept).cast("long")).otherwise(F.col("n_chars")),
    }
    return cut.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies.

    The fingerprints of four words miss many edited copies, so one of each group that shares
    4/5 of its five-word shingles stays of what they leave.
    """
    left = written(spark, simhash.one_of_each(spark, docs), "pipeline-prints")
    return jaccard.one_of_each(spark, left)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    hits = free_name(docs, "hits")
    found = decontaminate.find_windows(spark, docs, table(spark, sf_dir, "benchmark"), hits=hits)
    return found.filter(F.size(f"{hits}.spans") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the token ids of every document, and of the bytes they decode to."""
    return byte_bpe.digests(docs, registry.tokenizer(spark))


STAGES: list[tuple[str, Stage]] = [
    ("quality", good_quality),
    ("line_dedup", without_common_lines),
    ("near_dedup", one_of_near_copies),
    ("decontaminate", without_benchmark),
    ("encode", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


# A classifier and hashed fingerprints have no SQL; tests hold the rows against a brute-force run.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
