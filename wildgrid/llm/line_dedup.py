"""Line dedup with levelled sorted runs of line hashes.

The documents are taken in batches by a hash of their id. A batch becomes a run: one row
per line key with the number of documents and the largest id holding it. Before it is
written it is merge-joined with every earlier run, so that each row knows whether its key
was seen before: the anti-join that tells new lines from known ones. Runs are compacted by
levels, see ``levels``; neither step shuffles an earlier run.

Only keys that were seen before or that are frequent within one run can be frequent
overall; for them alone the counts of all runs are added up. Their lines are then looked
up once, and every document drops its own lines by position.

A key is known by two 64-bit hashes. All steps are DataFrame operations; counts are
combined before each shuffle, so a line that a third of the documents hold costs no more
than another.

NULL and empty texts are one empty line, which is never dropped. A document is an id:
repeated rows and rows that share an id count once, and rows without an id count together
as one document that is never the largest. All rows are returned. Empty tables give none.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wildgrid.llm.common import BLANKS, col, whole_text, written
from wildgrid.llm.levels import LevelledRuns

KEY = ["h1", "h2"]


def lower_az(text: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _hashed(text: Column, least: int) -> Column:
    """Hash pairs and positions of the lines long enough to be judged."""
    # Lower case does not touch line breaks or blanks, so it can come first.
    keys = F.transform(F.split(lower_az(text), "\n", -1), lambda line: F.btrim(line, F.lit(BLANKS)))
    pairs = F.transform(
        keys,
        lambda key, at: F.when(
            F.char_length(key) >= least,
            F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2"), at.alias("at")),
        ),
    )
    return F.filter(pairs, lambda p: p.isNotNull())


def drop_lines(
    spark: SparkSession,
    documents: DataFrame,
    text: str = "text",
    doc: str = "doc_id",
    least_length: int = 20,
    least_documents: int = 3,
    batches: int = 4,
    kept: str = "kept",
    n_lines: str = "n_lines",
    n_dropped: str = "n_dropped",
) -> DataFrame:
    """``documents`` with the kept text and the numbers of lines and of dropped lines.

    Keys of at least ``least_length`` code points found in ``least_documents`` documents
    lose their lines everywhere but in the largest id that holds them.
    """
    whole = whole_text(text)
    # The texts are hashed once; batches, runs and the last look-up read the hashes.
    docs = written(
        spark,
        documents.select(
            col(doc).alias("doc"), F.xxhash64(whole).alias("text_hash"), _hashed(whole, least_length).alias("keys")
        ),
        "line_keys",
    )
    lines = docs.select("doc", "text_hash", F.inline("keys"))
    store = LevelledRuns(spark, KEY, {"n": "sum", "last": "max"})
    for k in range(batches):
        batch = lines.filter(F.pmod(F.xxhash64("doc"), F.lit(batches)) == k)
        once = batch.select(*KEY, "doc").distinct()
        store.add(once.select(*KEY, F.lit(1).cast("long").alias("n"), F.col("doc").alias("last")))
    frequent = store.totals(F.col("n") >= least_documents).filter(F.col("n") >= least_documents).select(*KEY, "last")
    # Written, so that the join below has a shuffle of its own, whose hot lines Spark splits.
    frequent = written(spark, frequent, "frequent")
    # Lines to drop, by document and text, as two rows may share an id.
    gone = (
        lines.join(frequent, KEY)
        .filter(~F.col("doc").eqNullSafe(F.col("last")))
        .groupBy(F.col("doc").alias("_doc"), F.col("text_hash").alias("_hash"))
        .agg(F.collect_set("at").alias("_gone"))
    )
    rows = documents.select(F.struct("*").alias("_row"), col(doc).alias("_id"), whole.alias("_text"))
    joined = rows.join(gone, F.col("_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("_text") == F.col("_hash")), "left")
    joined = joined.withColumn("_parts", F.split("_text", "\n", -1))
    positions = F.array_except(F.sequence(F.lit(0), F.size("_parts") - 1), F.col("_gone"))
    rest = F.array_join(F.transform(positions, lambda at: F.get(F.col("_parts"), at)), "\n")
    return joined.select(
        "_row.*",
        F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(rest).alias(kept),
        F.size("_parts").cast("long").alias(n_lines),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias(n_dropped),
    )


def digests(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of every document."""
    return drop_lines(spark, documents.select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )
