"""File inventory, Parquet and JSON probes, image counts, copy manifest."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from wildgrid.functions.numeric import norm
from wildgrid.functions.text import file_extension, parent_folder, relative_path
from wildgrid.sources.documents import LONG_TEXTS, members_of, read_documents
from wildgrid.sources.tables import read_records, write_json

# Extensions of each kind of file.
KINDS = {
    "parquets": [".parquet"],
    "jsons": [".json"],
    "embeddings": [".npy", ".npz"],
    "images": [".jpg", ".jpeg", ".png", ".webp", ".bmp", ".gif", ".tiff"],
    "other_files": [".csv", ".tsv", ".txt"],
}
COPIED_KINDS = ["parquets", "jsons", "embeddings"]


def _kind(extension: Column) -> Column:
    kind = F.lit(None).cast("string")
    for name, extensions in KINDS.items():
        kind = F.when(extension.isin(extensions), F.lit(name)).otherwise(kind)
    return kind


def _local(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/+", "/")


def file_inventory(spark: SparkSession, root: str) -> DataFrame:
    """(path, folder, extension, kind, size_bytes) of every file below ``root``.

    Only names and sizes are read; files of no listed kind have a NULL kind.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(root)
        .select(F.col("_metadata.file_path").alias("path"), "length")
    )
    extension = file_extension(F.col("path"))
    return files.select(
        "path",
        parent_folder(F.col("path")).alias("folder"),
        extension.alias("extension"),
        _kind(extension).alias("kind"),
        F.col("length").alias("size_bytes"),
    )


def image_counts(inventory: DataFrame) -> DataFrame:
    return inventory.filter("kind = 'images'").groupBy("folder").agg(F.count("*").alias("n_images"))


def probe_parquet(inventory: DataFrame, sample_rows: int = 5) -> DataFrame:
    """Schema, columns and first rows of each Parquet file, or the error that reading it gave.

    Files differ in schema, so each is opened where its path lands; only the
    footer and the first batch are read.
    """

    def probe(batches: Iterator) -> Iterator:
        import json

        import pandas as pd
        import pyarrow.parquet as pq
        from pyarrow import fs

        for batch in batches:
            found = []
            for path in batch["path"]:
                row = {"path": path, "columns": None, "schema": None, "sample": None, "error": None, "n_rows": None}
                try:
                    files, inside = fs.FileSystem.from_uri(path)
                    with files.open_input_file(inside) as handle:
                        parquet = pq.ParquetFile(handle)
                        row["columns"] = parquet.schema_arrow.names
                        row["schema"] = str(parquet.schema_arrow)
                        row["n_rows"] = parquet.metadata.num_rows
                        first = next(parquet.iter_batches(batch_size=sample_rows), None)
                        sample = [] if first is None else first.to_pylist()
                        row["sample"] = json.dumps(sample, default=str, ensure_ascii=False)
                except Exception as e:  # the report lists unreadable files
                    row["error"] = repr(e)
                found.append(row)
            yield pd.DataFrame(found, columns=["path", "columns", "schema", "sample", "error", "n_rows"])

    # Files are slow to open next to their number: spread the paths.
    paths = inventory.filter("kind = 'parquets'").select("path").repartition("path")
    return paths.mapInPandas(probe, "path string, columns array<string>, schema string, sample string, error string, n_rows long")


def probe_json(texts: DataFrame, n_keys: int = 20, n_items: int = 5, n_chars: int = 200) -> DataFrame:
    """First keys of an object, first items of a list, or first characters of a scalar.

    Read by the parser of ``documents``: repeated keys, of which the last counts, NaN and
    documents of any size are no errors.
    """
    text = F.col("text")
    first = F.left(F.regexp_replace(F.left(text, F.lit(1024)), r"^[\s\x{FEFF}]+", ""), F.lit(1))
    some = F.slice(F.when(first == "{", members_of(text)), 1, n_keys)
    items = F.slice(F.when(first == "[", F.from_json(text, "array<string>", LONG_TEXTS)), 1, n_items)
    scalar = F.when(~F.coalesce(first.isin("{", "["), F.lit(False)), F.try_parse_json(text))
    # With the types of the values, or as texts if one is larger than a variant may be.
    typed = F.map_entries(F.from_json(text, "map<string, variant>", LONG_TEXTS))
    shown = F.coalesce(
        F.to_json(F.map_from_entries(F.transform("some", lambda e: F.struct(e["key"], F.get(typed, e["at"])["value"])))),
        F.to_json(F.map_from_entries(F.transform("some", lambda e: F.struct(e["key"], e["value"])))),
        F.to_json(F.slice(F.from_json(F.when(F.col("items").isNotNull(), text), "array<variant>", LONG_TEXTS), 1, n_items)),
        F.to_json("items"),
        F.left(F.try_variant_get("scalar", "$", "string"), F.lit(n_chars)),
    )
    kind = (
        F.when(F.col("some").isNotNull(), "OBJECT").when(F.col("items").isNotNull(), "ARRAY")
        .otherwise(F.regexp_extract(F.schema_of_variant("scalar"), "^[A-Z]+", 0))
    )
    return texts.withColumns({"some": some, "items": items, "scalar": scalar}).select(
        F.col("source_file").alias("path"),
        kind.alias("kind"),
        F.transform("some", lambda e: e["key"]).alias("keys_sample"),
        shown.alias("preview"),
        F.when(F.col("some").isNull() & F.col("items").isNull() & F.col("scalar").isNull(), F.lit("not valid JSON")).alias("error"),
    )


def inventory_report(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """What lies below ``root``: probed tables and documents, vector files, image counts, other files."""
    files = file_inventory(spark, root)
    return {
        "parquets": probe_parquet(files),
        "jsons": probe_json(read_documents(spark, root)),
        "embeddings": files.filter("kind = 'embeddings'").select("path", "size_bytes"),
        "images_count": image_counts(files),
        "other_files": files.filter("kind = 'other_files'").select("path", "size_bytes"),
    }


def write_report(report: dict[str, DataFrame], out: str) -> None:
    """Each part of the report as JSON records in a folder of its name."""
    for name, part in report.items():
        write_json(part, f"{out.rstrip('/')}/{name}")


def reported_files(spark: SparkSession, out: str) -> DataFrame:
    """(path, kind) of the tables, documents and vector files of a written report."""
    parts = [
        read_records(spark, f"{out.rstrip('/')}/{kind}", "path string").select("path", F.lit(kind).alias("kind"))
        for kind in COPIED_KINDS
    ]
    return reduce(DataFrame.unionByName, parts)


def manifest(report: DataFrame, present: DataFrame, root: str, target: str) -> DataFrame:
    """Copy plan of the reported tables, documents and vectors.

    Each reported path of those kinds gets its target path and a status:
    ``copied`` if the file is present, else ``skipped`` with reason ``missing``.
    """
    listed = report.filter(F.col("kind").isin(COPIED_KINDS)).select("path", "kind")
    here = present.select(F.col("path"), F.lit(True).alias("found"))
    # A local path may come with or without its scheme, and with one slash or three.
    below = relative_path(_local(F.col("path")), _local(F.lit(root)))
    return listed.join(here, "path", "left").select(
        F.col("path").alias("src"),
        F.concat_ws("/", F.lit(target), F.col("kind"), below).alias("dst"),
        F.when(F.col("found"), F.lit("copied")).otherwise(F.lit("skipped")).alias("status"),
        F.when(F.col("found").isNull(), F.lit("missing")).alias("reason"),
    )


def read_vectors(
    spark: SparkSession, root: str, element: str = "float", skip_damaged: bool = False
) -> DataFrame:
    """Vectors of all Parquet files below ``root`` with their file and row.

    A file without an ``embedding`` column gives NULL vectors. A damaged file is an
    error, or with ``skip_damaged`` gives the rows before the damage.
    """
    return (
        spark.read.schema(f"embedding array<{element}>")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.parquet")
        .option("ignoreCorruptFiles", skip_damaged)
        .parquet(root)
        .select(
            F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row_index"), "embedding"
        )
    )


def by_table(vectors: DataFrame) -> DataFrame:
    """Vectors under the path of their table: a folder ``x.parquet`` of parts is one file ``x.parquet``.

    ``part`` keeps the part that a row is read from.
    """
    table = F.regexp_replace("path", r"^(.*?/[^/]*\.parquet)/.*$", "$1")
    return vectors.withColumn("part", F.col("path")).withColumn("path", table)


def embedding_profile(vectors: DataFrame, sample_n: int | None = None) -> DataFrame:
    """Per file: rows, vectors measured, dimension and norm statistics.

    With ``sample_n`` only the first vectors of each file are measured, parts in the order of
    their names; the row count is that of the whole file.
    """
    measured = vectors.filter("embedding is not null")
    if sample_n is not None:
        order = [c for c in ("part", "row_index") if c in vectors.columns]
        nth = F.row_number().over(Window.partitionBy("path").orderBy(*order))
        measured = measured.withColumn("nth", nth).filter(F.col("nth") <= sample_n)
    stats = (
        measured.select("path", F.size("embedding").alias("n"), norm(F.col("embedding")).alias("norm"))
        .groupBy("path")
        .agg(
            F.count("*").alias("sample_count"),
            F.max("n").alias("dim"),
            F.avg("norm").alias("norm_mean"),
            F.stddev_pop("norm").alias("norm_std"),
            F.min("norm").alias("norm_min"),
            F.max("norm").alias("norm_max"),
        )
    )
    rows = vectors.groupBy("path").agg(F.count("*").alias("rows"))
    return rows.join(stats, "path", "left").withColumn("sample_count", F.coalesce("sample_count", F.lit(0)))


def embedding_report(spark: SparkSession, root: str, sample_n: int | None = None) -> DataFrame:
    """Profile of every Parquet file below ``root``, with its columns or its read error.

    A file of which fewer rows could be read than its footer states has an error.
    """
    probed = probe_parquet(file_inventory(spark, root)).select(
        "path", "columns", F.array_contains("columns", "embedding").alias("present"), "error", "n_rows"
    )
    joined = probed.join(embedding_profile(read_vectors(spark, root, skip_damaged=True), sample_n), "path", "left")
    short = F.coalesce("rows", F.lit(0)) < F.col("n_rows")
    lost = F.format_string("damaged: %d of %d rows read", F.coalesce("rows", F.lit(0)), F.col("n_rows"))
    return joined.withColumn("error", F.coalesce("error", F.when(short, lost))).drop("n_rows")


def embedding_totals(report: DataFrame) -> DataFrame:
    """Number of files, and of rows in the files that have vectors."""
    return report.agg(
        F.count("*").alias("total_files"),
        F.coalesce(F.sum(F.when(F.col("present"), F.col("rows"))), F.lit(0)).alias("estimated_total_vectors"),
    )
