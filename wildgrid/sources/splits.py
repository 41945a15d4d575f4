"""Units of text that span lines, cut from files in parallel.

A file is read in splits, and a split does not know what it begins in: a quoted field, a string,
a list. So every split is read twice. The first time it says, for each state it could begin in,
the state it ends in. These are composed in the order of the splits, one short row per split, and
then every split knows its state and cuts itself into units. A unit that crosses the border of
splits comes in fragments, at most two of a split, and only those are put together by a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

# Bytes of an Arrow batch, so that long lines don't add up in a worker.
BATCH = "8m"

PLACE = "source_file string, split long"


def read_lines(spark: SparkSession, path: str, line_sep: str, **options) -> DataFrame:
    """(source_file, split, line, size, last): lines in order, each in the split it starts in.

    ``size`` is that of the file, ``last`` is true in its last split.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    return (
        spark.read.options(**options).option("lineSep", line_sep).text(path)
        .select(
            F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("split"),
            F.col("value").alias("line"), F.col("_metadata.file_size").alias("size"),
            F.expr("_metadata.file_block_start + _metadata.file_block_length >= _metadata.file_size").alias("last"),
        )
    )


def by_split(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """The parts of a batch that belong to one split."""
    if not batch.num_rows:
        return
    splits, files = batch.column(1).to_numpy(), batch.column(0).dictionary_encode().indices.to_numpy()
    edges = np.flatnonzero((splits[1:] != splits[:-1]) | (files[1:] != files[:-1])) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
        yield batch.column(0)[a].as_py(), int(splits[a]), batch.slice(a, b - a)


def summaries(lines: DataFrame, fold: Callable, first, kind: str, finish: Callable = lambda value: value) -> DataFrame:
    """One row per split: ``fold`` over its batches, from ``first``, then ``finish``, as the columns ``kind``."""
    columns = [c.split()[0] for c in kind.split(", ")]

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, value = None, first

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"source_file": [now[0]], "split": pa.array([now[1]], pa.int64()),
                                               **{c: [v] for c, v in zip(columns, finish(value))}})

        for batch in batches:
            for file, split, part in by_split(batch):
                if (file, split) != now:
                    if now is not None:
                        yield row()
                    now, value = (file, split), first
                value = fold(value, part)
        if now is not None:
            yield row()

    return lines.mapInArrow(folded, f"{PLACE}, {kind}")


def with_starts(lines: DataFrame, starts: DataFrame) -> DataFrame:
    """``lines`` with the columns of ``starts``, of the splits that begin in the middle of something.

    A row of ``starts`` follows a split of full size, so they are one short row for that many
    bytes and can be broadcast. The lines keep their order.
    """
    return lines.join(F.broadcast(starts), ["source_file", "split"], "left")


def joined_fragments(fragments: DataFrame, separator: str = "") -> DataFrame:
    """Units from fragments (source_file, split, place, opens, unit): an opening one and all up to the next.

    Fragments are two a split at most; those of one unit are as many as the splits it crosses.
    """
    order = Window.partitionBy("source_file").orderBy("split", "place")
    opened = fragments.withColumn("run", F.sum(F.col("opens").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = opened.groupBy("source_file", "run").agg(F.array_sort(F.collect_list(F.struct("split", "place", "unit"))).alias("parts"))
    return rows.select(
        "source_file", F.col("parts")[0]["split"].alias("split"), F.col("parts")[0]["place"].alias("place"),
        F.array_join(F.col("parts")["unit"], separator).alias("unit"),
    )
