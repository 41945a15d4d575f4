"""First rows per key and consecutive numbers without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from wildgrid.session import shared_folder

_POSITION_BITS = 33  # monotonically_increasing_id keeps the row position in its low 33 bits


def first_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The row with the smallest ``order`` of each key; NULL keys form one key.

    A minimum is combined before the shuffle, so a key that holds a large share
    of the rows costs one row per task.
    """
    rest = [c for c in df.columns if c not in key and c not in order]
    row = F.struct(*[F.col(f"`{c}`") for c in [*order, *rest]])
    picked = df.groupBy(*key).agg(F.min(row).alias("_row"))
    return picked.select(
        *[(F.col(f"`{c}`") if c in key else F.col(f"_row.`{c}`")).alias(c) for c in df.columns]
    )


def with_position(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add the 0-based position of each row in the total order given.

    Rows are range-partitioned and sorted; the sorted rows are checkpointed so
    that both the partition counts and the numbering see the same partitions,
    also after an executor is lost. Only one count per partition is summed up.
    """
    shared_folder(df.sparkSession)
    index = F.monotonically_increasing_id()
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_slice", F.shiftright(index, _POSITION_BITS))
        .withColumn("_at", index.bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)))
        .checkpoint()
    )
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_slice")
        .agg(F.count("*").alias("_n"))
        .select("_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    # One row per partition: small whatever the data.
    return (
        placed.join(F.broadcast(offsets), "_slice")
        .withColumn(name, F.col("_before") + F.col("_at"))
        .drop("_slice", "_at", "_before")
    )
