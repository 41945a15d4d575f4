"""Stored tables: reading, registering, counting, writing."""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from wildgrid import schemas

AGGREGATES = ["hex_density", "country_stats", "temporal", "taxon_tree", "species_list"]
VIEWS = {
    "obs": "obs.parquet",
    "taxa_enriched": "taxa_enriched.parquet",
    "photos": "photos.parquet",
    "taxon_join": "taxon_join.parquet",
    "gbif_dist": "gbif_distribution.parquet",
    "gbif_vernac": "gbif_vernacular.parquet",
    "gbif_desc": "gbif_description.parquet",
}


def read_if_present(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def read_tables(spark: SparkSession, folder: str, files: dict[str, str]) -> dict[str, DataFrame]:
    """The tables that exist; a warning names each one that does not."""
    found = {}
    for name, file in files.items():
        df = read_if_present(spark, f"{folder.rstrip('/')}/{file}")
        if df is None:
            warnings.warn(f"table {name} not found in {folder}; run the build first")
        else:
            found[name] = df
    return found


def register_views(spark: SparkSession, folder: str, files: dict[str, str] = VIEWS) -> list[str]:
    tables = read_tables(spark, folder, files)
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return list(tables)


def load_aggregates(spark: SparkSession, folder: str, cache: bool = False) -> dict[str, DataFrame]:
    tables = read_tables(spark, folder, {name: f"{name}.parquet" for name in AGGREGATES})
    return {name: df.cache() for name, df in tables.items()} if cache else tables


def read_parts(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """All Parquet parts in a folder; an empty frame if there are none."""
    df = read_if_present(spark, folder)
    return spark.createDataFrame([], schema) if df is None else df


def read_embeddings(spark: SparkSession, *folders: str) -> DataFrame:
    parts = [read_parts(spark, folder, schemas.EMBEDDINGS) for folder in folders]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def catalog_status(
    tables: dict[str, DataFrame], eco_meta: DataFrame | None = None, eco_cells: DataFrame | None = None
) -> DataFrame:
    """Rows per table, number of regions, total region-cell pairs, as (item, n)."""
    counted = dict(tables)
    if eco_meta is not None:
        counted["ecoregions"] = eco_meta
    if eco_cells is not None:
        counted["ecoregion_h3_cells"] = eco_cells.select("eco_id", "h3_r3").distinct()
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("item"), "n") for name, df in counted.items()]
    return reduce(DataFrame.unionByName, rows)


def write_table(
    df: DataFrame,
    path: str,
    schema: T.StructType | None = None,
    sort_by: list[str] | None = None,
    partition_by: list[str] | None = None,
    mode: str = "error",
) -> None:
    """Write zstd Parquet.

    ``schema`` fixes names and types. ``sort_by`` orders each file by the columns
    readers filter on, so that its statistics let them skip most of it; no
    shuffle is needed for that.
    """
    if schema is not None:
        df = schemas.enforce(df, schema)
    if sort_by:
        df = df.sortWithinPartitions(*sort_by)
    writer = df.write.mode(mode).option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def as_json(df: DataFrame, name: str = "record") -> DataFrame:
    """One JSON text per row; NULL and NaN are written as null."""
    columns = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c)
        columns.append(c.alias(field.name))
    return df.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias(name))


def read_records(spark: SparkSession, path: str, schema: T.StructType | str, array: bool = False) -> DataFrame:
    """JSON records, one per line, or as one array per file."""
    return spark.read.schema(schema).option("multiLine", array).json(path)


def write_json(df: DataFrame, path: str, order_by: list[str] | None = None) -> None:
    """One JSON record per line, in the given order."""
    records = as_json(df.orderBy(*order_by) if order_by else df, "value")
    records.write.text(path)
