"""Species profiles for a set of taxa in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wildgrid.operators.filters import keyed
from wildgrid.plans.aggregates import main_photo_per_taxon
from wildgrid.plans.cleaning import DESCRIPTION_LANGUAGES, JUNK_DESCRIPTIONS, in_vernacular_language
from wildgrid.schemas import RANKS

SPANISH = ["es", "ES", "spa"]


def observation_counts(obs: DataFrame) -> DataFrame:
    return obs.groupBy("taxon_id").agg(
        F.count("*").alias("n_obs"),
        F.count_distinct("observer_id").alias("n_observers"),
        F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
    )


def preferred_vernacular(vernacular: DataFrame) -> DataFrame:
    """One accepted name per catalogue id, Spanish before English."""
    later = (~F.col("language").isin(SPANISH)).cast("int")
    best = F.min(F.struct(later.alias("later"), "language", "vernacularName"))
    return (
        vernacular.filter(in_vernacular_language())
        .groupBy("gbif_id")
        .agg(best.alias("b"))
        .select(
            "gbif_id", F.col("b.vernacularName").alias("vernacular_name"), F.col("b.language").alias("vernac_lang")
        )
    )


def preferred_description(description: DataFrame) -> DataFrame:
    """One English text per catalogue id, type ``description`` first; a NULL type is dropped here."""
    kind = F.lower("type")
    later = (kind != "description").cast("int")
    best = F.min(F.struct(later.alias("later"), "description", "source", "license"))
    return (
        description.filter(F.lower("language").isin(DESCRIPTION_LANGUAGES) & ~kind.isin(JUNK_DESCRIPTIONS))
        .groupBy("gbif_id")
        .agg(best.alias("b"))
        .select(
            "gbif_id",
            "b.description",
            F.col("b.source").alias("desc_source"),
            F.col("b.license").alias("desc_license"),
        )
    )


def species_profiles(
    taxa: DataFrame,
    obs: DataFrame,
    photos: DataFrame,
    observers: DataFrame,
    taxon_link: DataFrame,
    vernacular: DataFrame,
    description: DataFrame,
    ids: DataFrame | None = None,
) -> DataFrame:
    """One record per taxon with a name: ranks, counts, preferred name, text and photo.

    ``ids`` limits the work to the taxa listed. Each part has one row per taxon
    or per catalogue id before it is joined, so no join multiplies rows.
    """
    named = keyed(taxa, ids, "taxon_id").filter("name is not null")
    seen = keyed(obs, ids, "taxon_id")
    link = keyed(taxon_link.filter("gbif_id is not null"), ids, "taxon_id")
    texts = (
        link.join(preferred_vernacular(vernacular), "gbif_id", "left")
        .join(preferred_description(description), "gbif_id", "left")
        .drop("gbif_id")
    )
    return (
        named.select("taxon_id", "name", "rank", *RANKS)
        .join(observation_counts(seen), "taxon_id", "left")
        .join(texts, "taxon_id", "left")
        .join(main_photo_per_taxon(seen, photos, observers), "taxon_id", "left")
        .withColumn("n_obs", F.coalesce("n_obs", F.lit(0)))
        .withColumn("n_observers", F.coalesce("n_observers", F.lit(0)))
    )
