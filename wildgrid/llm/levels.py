"""A logarithmic family of sorted runs: new batches are small runs, equal levels merge.

A run is a bucketed table sorted by its key, one row per key, so that two runs are joined,
and merged, without a shuffle. Before a run is written it is merge-joined with every run of
the family, and each row notes whether its key was ``seen`` there.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wildgrid.session import fresh_path

_ADD = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "min": F.least, "max": F.greatest}
_AGGREGATE = {"sum": F.sum, "min": F.min, "max": F.max}


class LevelledRuns:
    """Runs of (key, values, seen). ``values`` says how each value merges: sum, min or max."""

    def __init__(self, spark: SparkSession, key: list[str], values: dict[str, str], fanout: int = 2):
        self.spark, self.key, self.values, self.fanout = spark, key, values, fanout
        # As many buckets as shuffle partitions, so that a bucket is written by one task.
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = []

    @property
    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def _write(self, run: DataFrame) -> DataFrame:
        name = f"run_{uuid.uuid4().hex}"
        (
            run.write.format("parquet")
            .option("path", fresh_path(self.spark, name))
            .bucketBy(self.buckets, *self.key)
            .sortBy(*self.key)
            .saveAsTable(name)
        )
        return self.spark.table(name)

    def _merged(self, one: DataFrame, other: DataFrame) -> DataFrame:
        columns = [*self.values, "seen"]
        renamed = other.select(*self.key, *[F.col(c).alias(f"_{c}") for c in columns])
        return one.join(renamed, self.key, "full").select(
            *self.key,
            *[_ADD[how](F.col(c), F.col(f"_{c}")).alias(c) for c, how in self.values.items()],
            (F.coalesce("seen", F.lit(False)) | F.coalesce("_seen", F.lit(False))).alias("seen"),
        )

    def compact(self) -> None:
        """Merge the runs of every full level into one run of the next."""
        for k in range(len(self.levels)):
            if len(self.levels[k]) >= self.fanout:
                runs, self.levels[k] = self.levels[k], []
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(self._write(reduce(self._merged, runs)))

    def aggregated(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.key).agg(*[_AGGREGATE[how](c).alias(c) for c, how in self.values.items()])

    def add(self, rows: DataFrame) -> None:
        """Add a batch of (key, values), several rows of a key allowed."""
        self.compact()
        run = self.aggregated(rows)
        marks = [f"_in{k}" for k in range(len(self.runs))]
        for mark, earlier in zip(marks, self.runs):
            run = run.join(earlier.select(*self.key, F.lit(True).alias(mark)), self.key, "left")
        seen = F.coalesce(*marks, F.lit(False)) if marks else F.lit(False)
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(self._write(run.select(*self.key, *self.values, seen.alias("seen"))))

    def totals(self, alone: Column) -> DataFrame:
        """(key, values) over all runs, of the keys that can matter.

        Those are the keys met by more than one run, and those with a row for which ``alone``
        holds. Only their rows are read again and added up.
        """
        runs = self.runs
        if not runs:
            raise ValueError("no batch was added")
        asked = [run.filter(F.col("seen") | alone).select(*self.key) for run in runs]
        asked = reduce(DataFrame.unionByName, asked).distinct()
        rows = [run.select(*self.key, *self.values).join(asked, self.key, "left_semi") for run in runs]
        return self.aggregated(reduce(DataFrame.unionByName, rows))
