"""Exact distinct counts that can be continued.

The distinct ids of a group are kept as bits: a row (group, measure, word, bits) says which
of the 64 ids from 64 x word on have been seen. Dense ids take a bit each, scattered ones a
row each. Two states are merged by OR, so a state of all that has been read so far and a
state of what is new give the state of both, however the rows were divided and whether or
not an id is in both. A group with a third of all rows is spread over its words, and OR is
combined before the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

MEASURE, WORD, BITS = "measure", "word", "bits"


def id_bits(
    rows: DataFrame, keys: list[str], ids: dict[str, Column | str], extra: dict[str, list[Column]] | None = None
) -> DataFrame:
    """A row per row and measure: the word and the bit of its id, NULL for a NULL id, and the measure's ``extra``."""
    sent = F.array(*[
        F.struct(
            F.lit(name).alias(MEASURE), (F.col(c) if isinstance(c, str) else c).cast("long").alias("id"),
            *(extra[name] if extra else []),
        )
        for name, c in ids.items()
    ])
    one = rows.select(*keys, F.explode(sent).alias("one")).select(*keys, "one.*")
    bit = F.expr("shiftleft(1L, cast(id & 63 as int))")
    return one.withColumns({WORD: F.shiftright("id", 6), BITS: bit}).drop("id")


def seen_ids(rows: DataFrame, keys: list[str], ids: dict[str, Column | str]) -> DataFrame:
    """State of some rows: ``ids`` has the integer id column of each measure. NULL is no id."""
    bits = id_bits(rows, keys, ids).filter(F.col(BITS).isNotNull())
    return bits.groupBy(*keys, MEASURE, WORD).agg(F.bit_or(BITS).alias(BITS))


def merged_ids(states: list[DataFrame], keys: list[str]) -> DataFrame:
    """One state of several."""
    return reduce(DataFrame.unionByName, states).groupBy(*keys, MEASURE, WORD).agg(F.bit_or(BITS).alias(BITS))


def with_distinct(totals: DataFrame, state: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """``totals``, one row per group, with the number of ids of each measure.

    Groups meet in an aggregation, not a join, because their keys may be NULL. A group
    without totals is left out.
    """
    others = [c for c in totals.columns if c not in keys]
    both = totals.withColumn("known", F.lit(True)).unionByName(
        state.select(*keys, MEASURE, F.bit_count(BITS).cast("long").alias("n_ids")), allowMissingColumns=True
    )
    counted = both.groupBy(*keys).agg(
        F.max("known").alias("known"),
        *[F.max(c).alias(c) for c in others],
        *[F.coalesce(F.sum(F.when(F.col(MEASURE) == m, F.col("n_ids"))), F.lit(0).cast("long")).alias(m) for m in measures],
    )
    return counted.filter("known").drop("known")
