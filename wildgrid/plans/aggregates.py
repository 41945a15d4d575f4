"""The five aggregate tables behind the dashboard.

Taxa are unique by ``taxon_id``. Where a table needs no distinct observers, the
observations are first counted per taxon and the other keys: the join then sees
one row per combination instead of one per observation, a taxon that holds a
third of all observations is combined before any shuffle, and since a taxon
belongs to one branch, the number of species is the number of counted rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wildgrid.plans.cleaning import in_vernacular_language
from wildgrid.schemas import RANKS
from wildgrid.sources.tables import write_table


def hex_density(obs: DataFrame, taxa: DataFrame) -> DataFrame:
    return _cell_counts(obs, taxa, ["h3_r3", "h3_r5"])


def country_stats(obs: DataFrame, taxa: DataFrame) -> DataFrame:
    return _cell_counts(obs, taxa, ["h3_r3"])


def _cell_counts(obs: DataFrame, taxa: DataFrame, cells: list[str]) -> DataFrame:
    """Observations, distinct taxa and distinct observers per cell, branch, grade and year.

    Each sighting is sent once for its taxon, with the count, and once for its
    observer. Equal ones are combined before the shuffle, which spreads a crowded
    cell by taxon and observer; what remains is one row per distinct value. Two
    ``count_distinct`` would send every sighting three times.
    """
    keys = [*cells, "kingdom", "phylum", "quality_grade", "year"]
    seen = obs.filter("h3_r3 is not null").select(*cells, "quality_grade", "year", "taxon_id", "observer_id")
    sent = F.array(
        F.struct(F.col("taxon_id").alias("taxon"), F.lit(None).alias("observer"), F.lit(1).cast("long").alias("n")),
        F.struct(F.lit(None).alias("taxon"), F.col("observer_id").alias("observer"), F.lit(None).alias("n")),
    )
    return (
        seen.join(taxa.select("taxon_id", "kingdom", "phylum"), "taxon_id")
        .select(*keys, F.explode(sent).alias("one"))
        .select(*keys, "one.*")
        .groupBy(*keys, "taxon", "observer")
        .agg(F.sum("n").alias("n"))
        .groupBy(*keys)
        .agg(
            F.sum("n").alias("n_obs"),
            F.count("taxon").alias("n_species"),
            F.count("observer").alias("n_observers"),
        )
    )


def temporal(obs: DataFrame, taxa: DataFrame) -> DataFrame:
    counted = (
        obs.filter("year is not null and month is not null and taxon_id is not null")
        .groupBy("taxon_id", "year", "month", "quality_grade")
        .agg(F.count("*").alias("n"))
    )
    return (
        counted.join(taxa.select("taxon_id", "kingdom", "phylum"), "taxon_id")
        .groupBy("year", "month", "kingdom", "phylum", "quality_grade")
        .agg(F.sum("n").alias("n_obs"), F.count("*").alias("n_species"))
    )


def taxon_tree(obs: DataFrame, taxa: DataFrame) -> DataFrame:
    counted = (
        obs.filter("taxon_id is not null").groupBy("taxon_id", "quality_grade").agg(F.count("*").alias("n"))
    )
    return (
        counted.join(taxa.select("taxon_id", *RANKS), "taxon_id")
        .groupBy(*RANKS, "quality_grade")
        .agg(F.count("*").alias("n_species"), F.sum("n").alias("n_obs"))
    )


def main_photo_per_taxon(
    obs: DataFrame, photos: DataFrame, observers: DataFrame, wanted: DataFrame | None = None
) -> DataFrame:
    """Photo with the smallest id of each taxon: address, license, observer's login.

    Photos and observations are read and joined once. Observations of taxa that are not
    ``wanted`` are left out before; the pick is a minimum, combined before its shuffle, and
    observers are looked up for the picked photos only. A photo that shows several
    observations of the taxon takes the smallest of these.
    """
    shown = photos.filter("photo_url is not null").select("photo_id", "photo_url", "license", "observation_uuid")
    seen = obs.filter("taxon_id is not null").select("observation_uuid", "taxon_id", "observer_id")
    if wanted is not None:
        seen = seen.join(wanted.select("taxon_id"), "taxon_id", "left_semi")
    picked = (
        shown.join(seen, "observation_uuid")
        .groupBy("taxon_id")
        .agg(F.min(F.struct("photo_id", "photo_url", "license", "observer_id")).alias("p"))
        .select("taxon_id", "p.photo_url", F.col("p.license").alias("photo_license"), "p.observer_id")
    )
    logins = observers.select("observer_id", F.col("login").alias("photo_attribution"))
    return picked.join(logins, "observer_id", "left").drop("observer_id")


def vernacular_per_taxon(taxon_link: DataFrame, vernacular: DataFrame) -> DataFrame:
    """Smallest accepted vernacular name of each linked taxon, picked before the join."""
    names = (
        vernacular.filter(in_vernacular_language())
        .groupBy("gbif_id")
        .agg(F.min("vernacularName").alias("vernacular_name"))
    )
    return taxon_link.join(names, "gbif_id").select("taxon_id", "vernacular_name")


def species_counts(obs: DataFrame, taxa: DataFrame) -> DataFrame:
    """One row per species and grade. Counting precedes the join with the taxon columns.

    Observations of other ranks are left out first. Each of the rest is sent once for its
    observer, with the count and the year, and once for its cell, as in ``_cell_counts``.
    """
    species = taxa.filter(F.col("rank") == "species").select("taxon_id", "name", "rank", *RANKS)
    keys = ["taxon_id", "quality_grade"]
    seen = obs.select(*keys, "observer_id", "year", "h3_r3").join(species.select("taxon_id"), "taxon_id", "left_semi")
    sent = F.array(
        F.struct(
            F.col("observer_id").alias("observer"), F.lit(None).alias("cell"),
            F.col("year").alias("year"), F.lit(1).cast("long").alias("n"),
        ),
        F.struct(
            F.lit(None).alias("observer"), F.col("h3_r3").alias("cell"),
            F.lit(None).alias("year"), F.lit(None).alias("n"),
        ),
    )
    counted = (
        seen.select(*keys, F.explode(sent).alias("one"))
        .select(*keys, "one.*")
        .groupBy(*keys, "observer", "cell")
        .agg(F.sum("n").alias("n"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
        .groupBy(*keys)
        .agg(
            F.sum("n").alias("n_obs"),
            F.count("observer").alias("n_observers"),
            F.min("first_year").alias("first_year"),
            F.max("last_year").alias("last_year"),
            F.count("cell").alias("n_cells"),
        )
    )
    return counted.join(species, "taxon_id").select(
        "taxon_id", "name", "rank", *RANKS, "quality_grade",
        "n_obs", "n_observers", "first_year", "last_year", "n_cells",
    )


def with_photo_and_name(
    species: DataFrame,
    wanted: DataFrame,
    obs: DataFrame,
    photos: DataFrame,
    observers: DataFrame,
    taxon_link: DataFrame,
    vernacular: DataFrame,
) -> DataFrame:
    """Species rows with main photo and vernacular name; ``wanted`` holds their taxa."""
    return species.join(main_photo_per_taxon(obs, photos, observers, wanted), "taxon_id", "left").join(
        vernacular_per_taxon(taxon_link, vernacular), "taxon_id", "left"
    )


def species_list(
    obs: DataFrame,
    taxa: DataFrame,
    photos: DataFrame,
    observers: DataFrame,
    taxon_link: DataFrame,
    vernacular: DataFrame,
) -> DataFrame:
    species = taxa.filter(F.col("rank") == "species")
    return with_photo_and_name(species_counts(obs, taxa), species, obs, photos, observers, taxon_link, vernacular)


# Order inside the written files, by what the dashboard filters on, so that reads
# skip row groups and pages.
SORTING = {
    "hex_density": ["quality_grade", "year", "h3_r3"],
    "country_stats": ["quality_grade", "year", "h3_r3"],
    "temporal": ["quality_grade", "year"],
    "taxon_tree": ["quality_grade", "kingdom"],
    "species_list": ["quality_grade", "n_obs"],
}


def build_aggregates(tables: dict[str, DataFrame], out: str, only: list[str] | None = None, mode: str = "overwrite") -> None:
    """Write the aggregate tables, all or those named.

    ``tables`` holds obs, taxa_enriched, photos, observers, taxon_join and
    gbif_vernac. Each aggregate reads just its columns of the stored tables.
    """
    obs, taxa = tables["obs"], tables["taxa_enriched"]
    plans = {
        "hex_density": lambda: hex_density(obs, taxa),
        "country_stats": lambda: country_stats(obs, taxa),
        "temporal": lambda: temporal(obs, taxa),
        "taxon_tree": lambda: taxon_tree(obs, taxa),
        "species_list": lambda: species_list(
            obs, taxa, tables["photos"], tables["observers"], tables["taxon_join"], tables["gbif_vernac"]
        ),
    }
    for name, plan in plans.items():
        if only is None or name in only:
            write_table(plan(), f"{out}/{name}.parquet", sort_by=SORTING[name], mode=mode)
