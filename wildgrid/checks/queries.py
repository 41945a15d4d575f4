"""Registered queries: each takes the session and a folder of the test tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from wildgrid.checks.bindings import base_table, bound
from wildgrid.functions import numeric, text
from wildgrid.operators import filters as flt
from wildgrid.operators.filters import DEFAULT_SCOPE, RESEARCH_SCOPE, Filters
from wildgrid.operators.grid import assign_cells, cell_sets, cover_polygons
from wildgrid.operators.taxonomy import match_names, match_rate
from wildgrid.plans import aggregates as agg, cleaning, dashboard as dash, external, identification as ident, incremental
from wildgrid.plans.profile import species_profiles
from wildgrid.sources import delimited, features as feat, inventory as inv, tables as tab, versions
from wildgrid.session import fresh_path

Query = Callable[[SparkSession, str], DataFrame]

# Scopes that select something in the test tables.
GRADE_YEARS = Filters(kingdom=("STANDARD", "PROMO"), year_min=1996, year_max=1999, grade="research")
NARROW = Filters(
    kingdom=("STANDARD", "SMALL", "LARGE"), phylum=("Brand#1", "Brand#4", "Brand#12", "Brand#23"),
    year_min=1996, year_max=2000, grade="research",
)
REGIONS = Filters(eco_ids=(3, 5, 8, 13, 21), grade="research")


class Tables:
    """The domain tables as the plans expect them, over one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def view(self, name: str) -> DataFrame:
        return bound(self.spark, self.sf_dir, name)

    @property
    def obs(self) -> DataFrame:
        return assign_cells(cleaning.located(self.view("obs_raw")))

    @property
    def taxa(self) -> DataFrame:
        return cleaning.active_taxa(self.view("taxa_flat"))

    @property
    def photos(self) -> DataFrame:
        return cleaning.main_photos(self.view("photos_raw"))

    @property
    def observers(self) -> DataFrame:
        return self.view("observers")

    @property
    def accepted(self) -> DataFrame:
        return cleaning.accepted_names(self.view("checklist"))

    @property
    def link(self) -> DataFrame:
        return match_names(self.taxa, self.accepted)

    @property
    def vernacular(self) -> DataFrame:
        return cleaning.vernacular_names(self.view("vernacular_raw"))

    @property
    def description(self) -> DataFrame:
        return cleaning.descriptions(self.view("description_raw"))

    @property
    def features(self) -> DataFrame:
        """Region features whose outline is put together from the ring points."""
        point = F.struct("seq", F.array("lon", "lat").alias("at"))
        outline = (
            self.view("eco_ring")
            .groupBy("eco_id")
            .agg(F.transform(F.array_sort(F.collect_list(point)), lambda p: p["at"]).alias("ring"))
        )
        return (
            self.view("ecoregions")
            .join(outline, "eco_id")
            .withColumn("parts", F.array(F.array("ring")))
            .drop("ring")
        )

    @property
    def region_cells(self) -> DataFrame:
        return cover_polygons(feat.with_shape(feat.valid_features(self.features)))

    @property
    def hex_density(self) -> DataFrame:
        return agg.hex_density(self.obs, self.taxa)

    @property
    def temporal(self) -> DataFrame:
        return agg.temporal(self.obs, self.taxa)

    @property
    def taxon_tree(self) -> DataFrame:
        return agg.taxon_tree(self.obs, self.taxa)

    @property
    def species_counts(self) -> DataFrame:
        return agg.species_counts(self.obs, self.taxa)

    @property
    def species_list(self) -> DataFrame:
        return agg.species_list(
            self.obs, self.taxa, self.photos, self.observers, self.link, self.vernacular
        )

    @property
    def external(self) -> DataFrame:
        return external.external_species(self.view("external_docs"))

    def with_photo_and_name(self, page: DataFrame) -> DataFrame:
        return agg.with_photo_and_name(
            page, page, self.obs, self.photos, self.observers, self.link, self.vernacular
        )

    def retrieval(self, name: str, prune: bool = False) -> DataFrame:
        views = [self.view(n) for n in ("query_vec", "text_clip", "text_bioclip", "anchors", "species_meta")]
        return ident.identify(*views, only=name, prune=prune)[name]


def biome_toggle(t: Tables) -> DataFrame:
    """Each biome toggled on a selection that holds biome 1 whole and biome 2 in part."""
    meta = feat.valid_features(t.features)
    selected = meta.filter("biome_num = 1 or (biome_num = 2 and eco_id > 10)").select("eco_id")
    off = flt.toggle_biome(selected, meta.filter("biome_num = 1").select("eco_id"))
    on = flt.toggle_biome(selected, meta.filter("biome_num = 2").select("eco_id"))
    return off.withColumn("toggled", F.lit(1)).unionByName(on.withColumn("toggled", F.lit(2)))


def ecoregion_features(t: Tables) -> DataFrame:
    """Features written as GeoJSON texts, parsed again and measured."""
    texts = feat.as_geojson(feat.valid_features(t.features))
    back = feat.parse_features(texts, names=feat.META)
    points = F.flatten(F.flatten("parts"))
    return back.select(
        *feat.META,
        F.size("parts").alias("n_parts"),
        F.size(points).alias("n_points"),
        F.array_min(F.transform(points, lambda p: p[0])).alias("west"),
        F.array_max(F.transform(points, lambda p: p[0])).alias("east"),
        F.array_min(F.transform(points, lambda p: p[1])).alias("south"),
        F.array_max(F.transform(points, lambda p: p[1])).alias("north"),
    )


def rounded(df: DataFrame, columns: list[str], places: int) -> DataFrame:
    return df.withColumns({c: numeric.round_to(F.col(c), places) for c in columns})


def as_text(df: DataFrame, column: str) -> DataFrame:
    """An array as comma list, which both engines print alike."""
    return df.withColumn(column, F.array_join(F.col(column).cast("array<string>"), ","))


def embedding_profile(spark: SparkSession, sf_dir: str, sample_n: int | None = None) -> DataFrame:
    """Norm statistics of the vector table, by file name."""
    vectors = inv.by_table(inv.read_vectors(spark, f"{sf_dir.rstrip('/')}/embeddings.parquet"))
    profile = inv.embedding_profile(vectors, sample_n).withColumn("file", text.file_name(F.col("path"))).drop("path")
    return rounded(profile, ["norm_mean", "norm_std", "norm_min", "norm_max"], 6)


def catalog_status(t: Tables) -> DataFrame:
    tables = {
        "hex_density": t.hex_density,
        "country_stats": agg.country_stats(t.obs, t.taxa),
        "temporal": t.temporal,
        "taxon_tree": t.taxon_tree,
        "species_list": t.species_counts,
    }
    return tab.catalog_status(tables, feat.valid_features(t.features), t.region_cells)


def embedding_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = inv.embedding_profile(inv.read_vectors(spark, f"{sf_dir.rstrip('/')}/embeddings.parquet"))
    return inv.embedding_totals(profile.withColumn("present", F.lit(True))).drop("total_files")


def json_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probe of the event properties, one document per event."""
    events = base_table(spark, sf_dir, "events")
    probe = inv.probe_json(
        events.select(F.col("event_id").cast("string").alias("source_file"), F.col("props").alias("text"))
    )
    return as_text(probe, "keys_sample")


def roundtrip_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored table written to a fresh folder and read back, with its row count."""
    t = Tables(spark, sf_dir)
    folder = fresh_path(spark, "roundtrip")
    written = {
        "obs": cleaning.observations_table(t.view("obs_dump")),
        "taxa_enriched": cleaning.enrich_taxa(t.view("taxa_raw")),
        "photos": t.photos,
        "taxon_join": t.link,
        "gbif_vernac": t.vernacular,
        "gbif_desc": t.description,
    }
    for name, df in written.items():
        tab.write_table(df, f"{folder}/{tab.VIEWS[name]}")
    tab.write_json(feat.region_meta(t.features), f"{folder}/ecoregions_meta.json")
    feat.write_features(t.features, f"{folder}/ecoregions.geojson")
    back = tab.read_tables(spark, folder, {n: f for n, f in tab.VIEWS.items() if n in written})
    back["ecoregions_meta"] = tab.read_records(spark, f"{folder}/ecoregions_meta.json", feat.META_SCHEMA)
    back["ecoregion_shapes"] = feat.parse_features(spark.read.text(f"{folder}/ecoregions.geojson"), names=feat.META)
    return tab.catalog_status(back)


def dumped(t: Tables, view: str, file: str) -> str:
    """A fresh folder with the view written as a delimited dump, quoted where it must be."""
    folder = fresh_path(t.spark, "dump")
    (
        t.view(view).write.option("sep", "\t").option("header", True).option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .csv(f"{folder}/{file}")
    )
    return folder


# What the aggregates take from an observation.
FOLDED = ["taxon_id", "observer_id", "quality_grade", "year", "month", "h3_r3", "h3_r5"]


def folded(t: Tables, name: str, parts: int = 3) -> DataFrame:
    """An aggregate continued over all observations, which come as parts of a dump.

    The parts are written once; every fold reads its own.
    """
    store, dump = fresh_path(t.spark, "store"), fresh_path(t.spark, "parts")
    part = F.pmod(F.xxhash64("observation_uuid"), F.lit(parts)).cast("int").alias("part")
    obs = t.obs.select(*FOLDED, part)
    obs.write.partitionBy("part").parquet(dump)
    written = t.spark.read.schema(obs.schema).parquet(dump)
    for i in range(parts):
        incremental.fold(t.spark, store, written.filter(F.col("part") == i).drop("part"), t.taxa, [name])
    return versions.read_version(t.spark, store)[name]


def _on(plan: Callable[[Tables], DataFrame]) -> Query:
    return lambda spark, sf_dir: plan(Tables(spark, sf_dir))


QUERIES: dict[str, Query] = {
    # Cleaning
    "obs_clean": _on(lambda t: cleaning.clean_observations(t.view("obs_dump"))),
    "obs_cells": _on(lambda t: t.obs),
    "taxa_enriched": _on(lambda t: cleaning.enrich_taxa(t.view("taxa_raw"))),
    "photos_main": _on(lambda t: t.photos),
    "checklist_accepted": _on(lambda t: t.accepted),
    "vernacular_filtered": _on(lambda t: t.vernacular),
    "description_filtered": _on(lambda t: t.description),
    "taxon_link": _on(lambda t: t.link),
    "taxon_link_rate": _on(lambda t: rounded(match_rate(t.link), ["match_rate"], 6)),
    # Aggregates
    "hex_density": _on(lambda t: t.hex_density),
    "region_stats": _on(lambda t: agg.country_stats(t.obs, t.taxa)),
    "temporal_table": _on(lambda t: t.temporal),
    "taxon_tree_table": _on(lambda t: t.taxon_tree),
    "species_list": _on(lambda t: t.species_list),
    # Aggregates, continued part by part
    "folded_hex_density": _on(lambda t: folded(t, "hex_density")),
    "folded_region_stats": _on(lambda t: folded(t, "country_stats")),
    "folded_temporal": _on(lambda t: folded(t, "temporal")),
    "folded_taxon_tree": _on(lambda t: folded(t, "taxon_tree")),
    "folded_species_counts": _on(lambda t: folded(t, "species_list")),
    # Dashboard
    "map_hex_r3": _on(lambda t: dash.density_map(t.hex_density, GRADE_YEARS, 3, "obs")),
    "map_hex_r5": _on(lambda t: dash.density_map(t.hex_density, GRADE_YEARS, 5, "species")),
    "map_hex_observers": _on(lambda t: dash.density_map(t.hex_density, NARROW, 4, "observers")),
    "map_hex_bins": _on(lambda t: dash.with_bins(dash.density_map(t.hex_density, GRADE_YEARS, 3, "obs"))),
    "map_hex_ecoregion": _on(
        lambda t: dash.density_map(t.hex_density, REGIONS, 3, "obs", region_cells=t.region_cells)
    ),
    "preset_scope_map": _on(
        # The regions of the scope have no cells in the test tables, so they select everything.
        lambda t: dash.density_map(
            t.hex_density,
            replace(RESEARCH_SCOPE, kingdom=NARROW.kingdom, phylum=NARROW.phylum, year_min=1997, year_max=2001),
            3, "species", region_cells=t.region_cells,
        )
    ),
    "temporal_monthly": _on(lambda t: dash.time_series(t.temporal, NARROW)),
    "temporal_yearly": _on(lambda t: dash.time_series(t.temporal, replace(DEFAULT_SCOPE, year_min=1990), "yearly")),
    "taxon_nodes_depth3": _on(lambda t: dash.taxon_nodes(t.taxon_tree, Filters(grade="research"), 3)),
    "taxon_nodes_depth6": _on(lambda t: dash.taxon_nodes(t.taxon_tree, Filters(klass="red,hot"), 6)),
    "taxon_top40": _on(lambda t: dash.top_nodes(dash.taxon_nodes(t.taxon_tree, Filters(), 4))),
    "taxon_options": _on(
        lambda t: dash.visible_options(
            dash.taxon_options(t.taxon_tree, Filters(kingdom="STANDARD,PROMO", klass="red,blue,old", grade="research"))
        )
    ),
    "headline_stats": _on(
        lambda t: dash.headline_stats(
            t.hex_density, t.taxon_tree, replace(REGIONS, kingdom=("PROMO", "SMALL"), year_min=1997), t.region_cells
        )
    ),
    "bias_by_class": _on(lambda t: dash.class_bias(t.species_counts, Filters(kingdom="STANDARD,PROMO,LARGE"))),
    "bias_totals": _on(lambda t: dash.bias_totals(t.species_counts, Filters(grade="research"))),
    "bias_coverage_long": _on(lambda t: dash.coverage_long(dash.class_bias(t.species_counts))),
    "species_page": _on(
        lambda t: t.with_photo_and_name(dash.species_page(t.species_counts, Filters(grade="research"), page_number=2))
    ),
    "species_search": _on(
        lambda t: t.with_photo_and_name(
            dash.species_page(t.species_counts, search="^(OLD|new) .*1", sort_by="name", page_size=50)
        )
    ),
    "species_profile": _on(
        lambda t: species_profiles(t.taxa, t.obs, t.photos, t.observers, t.link, t.vernacular, t.description)
    ),
    # Regions
    "ecoregion_meta": _on(lambda t: feat.region_meta(t.features)),
    "ecoregion_counts": _on(lambda t: feat.region_counts(t.features, t.region_cells)),
    "biome_groups": _on(lambda t: as_text(dash.biome_groups(feat.valid_features(t.features)), "eco_ids")),
    "biome_toggle": _on(biome_toggle),
    "ecoregion_cells": _on(lambda t: t.region_cells),
    "ecoregion_cell_sets": _on(lambda t: as_text(cell_sets(t.region_cells), "cells")),
    "ecoregion_features": _on(ecoregion_features),
    # Identification
    "retrieval_stage1": _on(lambda t: t.retrieval("stage1")),
    "retrieval_stage1_pruned": _on(lambda t: t.retrieval("stage1", prune=True)),
    "retrieval_stage2": _on(lambda t: t.retrieval("stage2")),
    "retrieval_stage3": _on(lambda t: t.retrieval("stage3")),
    "retrieval_predictions": _on(lambda t: t.retrieval("predictions")),
    "retrieval_known": _on(lambda t: t.retrieval("known")),
    "embedding_profile": embedding_profile,
    "embedding_profile_sample": lambda spark, sf_dir: embedding_profile(spark, sf_dir, 100),
    "embedding_totals": embedding_totals,
    # External list
    "external_species": _on(lambda t: t.external),
    "external_page": _on(lambda t: external.external_page(t.external, "brand|ring", 2, 24, "obs")),
    # Files
    "dump_observations": _on(
        lambda t: delimited.read_observations(t.spark, f"{dumped(t, 'obs_dump', 'observations.tsv')}/observations.tsv")
    ),
    "dump_taxa": _on(lambda t: delimited.read_taxa(t.spark, f"{dumped(t, 'taxa_raw', 'taxa.tsv')}/taxa.tsv")),
    "dump_vernacular": _on(
        lambda t: delimited.read_checklist(t.spark, dumped(t, "vernacular_raw", "VernacularName.tsv"), "vernacular")
    ),
    "dump_description": _on(
        lambda t: delimited.read_checklist(t.spark, dumped(t, "description_raw", "Description.tsv"), "description")
    ),
    "json_probe": json_probe,
    "catalog_status": _on(catalog_status),
    "roundtrip_sink": roundtrip_sink,
}
