"""External species list: build, pages, lookups, metadata for predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wildgrid import schemas
from wildgrid.operators import filters as flt
from wildgrid.operators.numbering import first_per_key, with_position
from wildgrid.plans.dashboard import page
from wildgrid.sources.documents import extract_records, read_records

SORT = {"name": "name", "obs": "dataset_records"}


# Tasks per core that parse documents.
SPREAD = 4


def external_species(documents: DataFrame) -> DataFrame:
    """One row per name, the first kept, with ids -1, -2, ... in document order.

    Parsing takes far longer than reading: millions of short documents fit one split of a file.
    They are dealt to all cores first.
    """
    tasks = SPREAD * documents.sparkSession.sparkContext.defaultParallelism
    return numbered_species(extract_records(documents.repartition(tasks)))


def external_species_of(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """The species of all .json files below ``root``, whatever their size, and what was rejected."""
    records, rejected = read_records(spark, root)
    return numbered_species(records), rejected


def numbered_species(records: DataFrame) -> DataFrame:
    records = records.drop("external_id")
    named = first_per_key(records, ["name"], ["source_file", "position"])
    numbered = with_position(named, ["source_file", "position"], "nth")
    return schemas.enforce(numbered.withColumn("taxon_id", -1 - F.col("nth")), schemas.EXTERNAL_SPECIES)


# Fixed value: largest page of the external list.
MAX_PAGE = 200


def external_page(
    species: DataFrame, search: str = "", page_number: int = 1, page_size: int = 24, sort_by: str = "name"
) -> DataFrame:
    if not 1 <= page_size <= MAX_PAGE or page_number < 1:
        raise ValueError(f"page_size must be 1 to {MAX_PAGE}, page_number at least 1")
    column = SORT.get(sort_by, "name")
    sort = F.asc_nulls_last(column) if column == "name" else F.desc_nulls_last(column)
    return page(flt.by_name(species, search), sort, ["taxon_id"], page_number, page_size)


def external_details(species: DataFrame, ids: DataFrame) -> DataFrame:
    return flt.keyed(species, ids, "taxon_id")


# Fixed value: fields that can name a prediction, in order.
NAMES = ["name", "target_species", "species"]


def augment_predictions(predictions: DataFrame, species: DataFrame) -> DataFrame:
    """Replace prediction fields by the metadata of the species of that name, where it has any.

    A prediction is known by the first of ``NAMES`` that it has and that is not empty, which
    becomes its name. Names are compared without case; of several species the first id
    counts, which is the largest of the negative ids.
    """
    offered = [F.nullif(F.col(c), F.lit("")) for c in NAMES if c in predictions.columns]
    blank = [F.col("name")] if "name" in predictions.columns else []
    predictions = predictions.withColumn("name", F.coalesce(*offered, *blank))
    fields = ["taxon_id", "family", "order", "image_url", "dataset_records"]
    by_name = (
        species.filter("name is not null")
        .groupBy(F.lower("name").alias("meta_key"))
        .agg(F.max(F.struct("taxon_id", "family", "order", "image_url", "dataset_records")).alias("meta"))
    )
    joined = predictions.join(by_name, F.lower(F.nullif(predictions["name"], F.lit(""))) == F.col("meta_key"), "left")
    kept = [F.col(f"`{c}`") for c in predictions.columns if c not in fields]
    filled = [
        F.coalesce(F.col(f"meta.`{c}`"), F.col(f"`{c}`")).alias(c) if c in predictions.columns
        else F.col(f"meta.`{c}`").alias(c)
        for c in fields
    ]
    return joined.select(*kept, *filled)
