"""What the operators share: text columns, bounded samples, Arrow batches, written steps."""

from __future__ import annotations

import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from wildgrid.session import fresh_path

# Blanks of the contracts: space, tab, line feed, vertical tab, form feed, return.
BLANKS = " \t\n\x0b\x0c\r"
LOWER_AZ = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def whole_text(name: str) -> Column:
    """The text column; NULL is the empty text."""
    return F.coalesce(col(name).cast("string"), F.lit(""))


def bound_batches(spark: SparkSession, size: str = "8m") -> None:
    """Cut Arrow batches by bytes too, so that long texts don't add up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def written(spark: SparkSession, df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """``df`` written to a fresh path of the shared folder, and read from there.

    Cuts the lineage: what is written survives the loss of an executor.
    """
    path = fresh_path(spark, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def smallest_by_hash(df: DataFrame, key: str, n: int) -> DataFrame:
    """At most ``n`` rows: a sample that depends on the keys alone, not on their order."""
    return df.orderBy(F.xxhash64(col(key).cast("string")), col(key)).limit(n)


def training_rows(
    documents: DataFrame, labels: DataFrame, label: str, fold: Column, n: int
) -> DataFrame:
    """(text, label) of at most ``n`` labelled documents outside the held-out fold.

    ``fold`` is true for ids that may be learnt from. The sample of ids is bounded by
    ``n``, so it is broadcast to the scan of the documents.
    """
    ids = smallest_by_hash(
        labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label"))
        .filter(fold & F.col("label").isNotNull() & F.col("doc_id").isNotNull()),
        "doc_id",
        n,
    )
    texts = documents.select(F.col("doc_id"), whole_text("text").alias("text"))
    return texts.join(F.broadcast(ids), "doc_id").select("text", "label")


def row_keys(df: DataFrame, text: Column, doc: str) -> list[Column]:
    """k1 and k2 know a row by its text and its id; rows that agree in both are alike."""
    integral = df.schema[doc].dataType.simpleString() in ("bigint", "int")
    number = col(doc).cast("long") if integral else F.xxhash64(col(doc))
    return [F.xxhash64(text).alias("k1"), F.coalesce(number, F.lit(0)).alias("k2")]


def packed_texts(keyed: DataFrame) -> DataFrame:
    """(k1, k2, text, id) with the text compressed, for the way through a shuffle; see ``unpacked``."""
    kind = keyed.schema["id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=4).compress
        for batch in batches:
            texts = pa.array([press(t) for t in batch.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts, batch.column(3)],
                                             names=["k1", "k2", "packed", "id"])

    rows = keyed.select("k1", "k2", F.col("text").cast("binary"), "id")
    return rows.mapInArrow(pack, f"k1 long, k2 long, packed binary, id {kind}")


def unpacked(packed: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(packed)


_SLICE_BITS = 33  # monotonically_increasing_id keeps the row's place in its partition in the low bits


def with_places(
    spark: SparkSession, df: DataFrame, group: list[str], order: list[str], place: str,
    ranges: list[Column] | None = None, keep: list[str] | None = None,
) -> DataFrame:
    """Add the 0-based place of each row in its group, in the given order, NULLs first.

    No group is in one task: rows are range-partitioned, sorted and written, and what is
    summed up is one count per slice and group. ``ranges`` may be coarser than ``order``
    where its values are long; NULL is a group like any other. Columns not in ``keep`` are
    sorted by, but not written.
    """
    keep = keep or df.columns
    by = [col(c) for c in [*group, *order]]
    rows = df.repartitionByRange(*(ranges or by)).sortWithinPartitions(*by)
    rows = written(spark, rows.select(*[col(c) for c in keep], F.monotonically_increasing_id().alias("_at")), "places")
    rows = rows.withColumn("_slice", F.shiftright("_at", _SLICE_BITS))
    counts = rows.groupBy(*group, "_slice").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        *[col(c).alias(f"_g{k}") for k, c in enumerate(group)], F.col("_slice").alias("_s"),
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    same = F.col("_slice") == F.col("_s")
    for k, c in enumerate(group):
        same = same & col(c).eqNullSafe(F.col(f"_g{k}"))
    return rows.join(counts, same).select(
        *[col(c) for c in keep], (F.col("_at") + F.col("_shift")).alias(place)
    )
