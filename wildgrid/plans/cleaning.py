"""Raw dumps to stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from wildgrid import schemas
from wildgrid.functions.text import photo_url
from wildgrid.operators.grid import assign_cells
from wildgrid.operators.taxonomy import active_taxa, expand_ancestry, match_names
from wildgrid.sources import delimited
from wildgrid.sources.tables import write_table

# Accuracy limit in metres, languages kept, description types dropped.
MAX_ACCURACY = 10_000
VERNACULAR_LANGUAGES = ["es", "en", "ES", "EN", "spa", "eng"]
DESCRIPTION_LANGUAGES = ["en", "eng", "english"]
JUNK_DESCRIPTIONS = ["materials examined", "materials_examined", "citation", "references"]


def located(observations: DataFrame) -> DataFrame:
    """Rows with both coordinates and an accuracy below the limit.

    An integral accuracy is compared as it is, so the test reaches the scan. Any
    other is read as a number and rounded; NULL or unreadable drops the row.
    """
    accuracy = F.col("positional_accuracy")
    if not _is_integral(observations):
        accuracy = whole_number(accuracy)
    return observations.filter(
        F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & (accuracy < MAX_ACCURACY)
    )


def _is_integral(observations: DataFrame) -> bool:
    return isinstance(observations.schema["positional_accuracy"].dataType, T.IntegralType)


def whole_number(value: Column) -> Column:
    return F.round(value.try_cast("double")).try_cast("int")


def with_year_month(observations: DataFrame) -> DataFrame:
    """Year and month of ``observed_on``; an invalid date gives NULLs and keeps the row."""
    day = F.try_to_date("observed_on")
    return observations.withColumn("year", F.year(day).cast("short")).withColumn("month", F.month(day).cast("byte"))


def clean_observations(raw: DataFrame) -> DataFrame:
    kept = with_year_month(located(raw))
    if not _is_integral(raw):
        kept = kept.withColumn("positional_accuracy", whole_number(F.col("positional_accuracy")))
    return kept.drop("observed_on")


def observations_table(raw: DataFrame) -> DataFrame:
    return schemas.enforce(assign_cells(clean_observations(raw)), schemas.OBSERVATIONS)


def enrich_taxa(raw: DataFrame) -> DataFrame:
    return expand_ancestry(active_taxa(raw))


def main_photos(raw: DataFrame) -> DataFrame:
    """First photo of each observation, with its address."""
    kept = raw.filter((F.col("position") == 0) & F.col("extension").isNotNull())
    return kept.drop("position").withColumn("photo_url", photo_url(F.col("photo_id"), F.col("extension")))


def accepted_names(raw: DataFrame) -> DataFrame:
    return raw.filter("taxonomicStatus = 'accepted'").withColumnRenamed("taxonID", "gbif_id")


def distribution(raw: DataFrame) -> DataFrame:
    return raw.withColumnRenamed("taxonID", "gbif_id")


def multimedia(raw: DataFrame) -> DataFrame:
    return raw.withColumnRenamed("taxonID", "gbif_id").withColumnRenamed("identifier", "photo_url")


def in_vernacular_language() -> Column:
    return F.col("language").isin(VERNACULAR_LANGUAGES)


def vernacular_names(raw: DataFrame) -> DataFrame:
    return raw.filter(in_vernacular_language()).withColumnRenamed("taxonID", "gbif_id")


def descriptions(raw: DataFrame) -> DataFrame:
    """English descriptions without the junk types; a NULL type is kept here."""
    junk = F.lower(F.coalesce("type", F.lit(""))).isin(JUNK_DESCRIPTIONS)
    english = F.lower("language").isin(DESCRIPTION_LANGUAGES)
    return raw.filter(~junk & english).withColumnRenamed("taxonID", "gbif_id")


def build_observations(spark: SparkSession, dump: str, out: str, sep: str = "\t", mode: str = "overwrite") -> None:
    """Observation dump to the stored table, in one pass without a shuffle."""
    write_table(observations_table(delimited.read_observations(spark, dump, sep)), out, schemas.OBSERVATIONS, mode=mode)


def build_taxa(spark: SparkSession, dump: str, out: str, mode: str = "overwrite") -> None:
    write_table(enrich_taxa(delimited.read_taxa(spark, dump)), out, schemas.TAXA, mode=mode)


def build_photos(spark: SparkSession, dump: str, out: str, mode: str = "overwrite") -> None:
    write_table(main_photos(delimited.read_photos(spark, dump)), out, schemas.PHOTOS, mode=mode)


def build_checklist(spark: SparkSession, folder: str, out: str, mode: str = "overwrite") -> None:
    """The five checklist tables and the name link; needs ``taxa_enriched`` in ``out``."""
    steps = {
        "taxon": accepted_names,
        "distribution": distribution,
        "vernacular": vernacular_names,
        "description": descriptions,
        "multimedia": multimedia,
    }
    for table, clean in steps.items():
        write_table(clean(delimited.read_checklist(spark, folder, table)), f"{out}/gbif_{table}.parquet", mode=mode)
    taxa = spark.read.parquet(f"{out}/taxa_enriched.parquet")
    names = spark.read.parquet(f"{out}/gbif_taxon.parquet")
    write_table(match_names(taxa, names), f"{out}/taxon_join.parquet", mode=mode)
