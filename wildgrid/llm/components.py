"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wildgrid.llm.common import written


def _round(links: DataFrame) -> DataFrame:
    """Every node is linked to the least of its neighbourhood, first upwards, then downwards."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    up = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    least = up.groupBy("a").agg(F.min("b").alias("m"))
    down = up.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"),
                                      F.col("m").alias("b"))
    return down.filter("a <> b").distinct()


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(a, b): the least node ``b`` of the component of every linked node ``a`` but ``b`` itself.

    ``links`` has long columns a and b, in any order, repeats and loops allowed. Each round
    halves the depth of the remaining trees or better, and is written to the shared folder.
    """

    def state(df: DataFrame) -> tuple:
        # Decimals, as a sum of hashes passes the range of a long.
        digest = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        return tuple(df.agg(F.count(F.lit(1)), digest).first())

    now = written(spark, links.select("a", "b").filter("a <> b").distinct(), "links")
    before, size = None, state(now)
    while size != before:
        now = written(spark, _round(now), "links")
        before, size = size, state(now)
    return now
