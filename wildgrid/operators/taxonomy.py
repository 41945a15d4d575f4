"""Parent paths to rank columns, and name matching between catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wildgrid.functions.text import name_key

# Rank level of each rank column.
RANK_LEVELS = {70: "kingdom", 60: "phylum", 50: "class", 40: "order", 30: "family", 20: "genus"}


def active_taxa(taxa: DataFrame) -> DataFrame:
    return taxa.filter("active").drop("active")


def expand_ancestry(taxa: DataFrame) -> DataFrame:
    """Add the six rank columns named by each taxon's slash path of ancestor ids.

    ``taxa`` holds active taxa only, so an inactive ancestor leaves its rank
    NULL. The path does not include the taxon itself. Many taxa share a path:
    each distinct path is resolved once and joined back.
    """
    ranked = taxa.withColumn("level", F.col("rank_level").cast("int")).filter(
        F.col("level").isin(list(RANK_LEVELS))
    )
    ancestors = ranked.select(F.col("taxon_id").cast("long").alias("ancestor_id"), "level", "name")
    steps = (
        taxa.filter("ancestry is not null")
        .select("ancestry")
        .distinct()
        .select("ancestry", F.posexplode(F.split("ancestry", "/")).alias("step", "id_text"))
        .select("ancestry", "step", F.col("id_text").try_cast("long").alias("ancestor_id"))
        .filter("ancestor_id is not null")
    )
    # The last ancestor of a rank wins.
    ranks = (
        steps.join(ancestors, "ancestor_id")
        .groupBy("ancestry")
        .agg(
            *[
                F.max_by("name", F.when(F.col("level") == level, F.col("step"))).alias(rank)
                for level, rank in RANK_LEVELS.items()
            ]
        )
    )
    base = ["taxon_id", "rank_level", "rank", "name", "ancestry"]
    return taxa.join(ranks, "ancestry", "left").select(*base, *RANK_LEVELS.values())


def match_names(taxa: DataFrame, checklist: DataFrame) -> DataFrame:
    """(taxon_id, gbif_id): catalogue id with the same name, ignoring case and outer blanks.

    Several catalogue rows of one name give the smallest id, so a taxon keeps
    one row. A NULL name matches a NULL name.
    """
    by_name = checklist.groupBy(name_key(F.col("canonicalName")).alias("other_key")).agg(
        F.min("gbif_id").alias("gbif_id")
    )
    return (
        taxa.select("taxon_id", name_key(F.col("name")).alias("key"))
        .join(by_name, F.col("key").eqNullSafe(F.col("other_key")), "left")
        .select("taxon_id", "gbif_id")
    )


def match_rate(link: DataFrame) -> DataFrame:
    return link.agg(
        F.count("*").alias("n_taxa"),
        F.count("gbif_id").alias("n_matched"),
        F.avg(F.col("gbif_id").isNotNull().cast("int")).alias("match_rate"),
    )
