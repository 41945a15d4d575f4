"""The filter state shared by all dashboard queries, and its application."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from wildgrid.functions.text import matches_ignoring_case


@dataclass(frozen=True)
class Filters:
    """Multi-select lists and ranges; an empty list or None selects everything."""

    kingdom: tuple[str, ...] = ()
    phylum: tuple[str, ...] = ()
    klass: tuple[str, ...] = ()
    order: tuple[str, ...] = ()
    eco_ids: tuple[int, ...] = ()
    year_min: int | None = None
    year_max: int | None = None
    grade: str = "all"


# The default scope and the research scope.
DEFAULT_SCOPE = Filters(year_min=2010, year_max=2025, grade="research")
RESEARCH_SCOPE = Filters(
    kingdom=("Animalia",),
    phylum=("Arthropoda",),
    eco_ids=(
        480, 508, 465, 466, 490, 464, 484, 498, 446, 570, 483, 460, 512, 505, 444, 565,
        476, 469, 496, 474, 497, 463, 481, 518, 507, 511, 473, 482, 503, 467, 493, 479,
    ),
    year_min=2010,
    year_max=2025,
    grade="research",
)


def choices(selection: str | Iterable[str] | None) -> list[str]:
    """A comma list or a sequence as a list; nothing selected gives []."""
    if not selection:
        return []
    return selection.split(",") if isinstance(selection, str) else list(selection)


# Filter field that selects values of each rank column.
RANK_FIELDS = {"kingdom": "kingdom", "phylum": "phylum", "class": "klass", "order": "order"}


def by_taxa(df: DataFrame, f: Filters) -> DataFrame:
    """Rows whose ranks are all among the selected ones, as one predicate.

    Only ranks that are selected, and that the table has, take part.
    """
    selected = {rank: choices(getattr(f, RANK_FIELDS[rank])) for rank in RANK_FIELDS.keys() & set(df.columns)}
    tests = [F.col(f"`{rank}`").isin(names) for rank, names in sorted(selected.items()) if names]
    return df.filter(reduce(Column.__and__, tests)) if tests else df


def by_ecoregions(df: DataFrame, f: Filters, region_cells: DataFrame | None) -> DataFrame:
    """Rows whose cell belongs to a selected region, by a left-semi join.

    A selection that names no cell selects everything, as does a table without
    cells. Whether there are cells is asked of the cell table at once, one short
    job, so that the plan holds no more than the join.
    """
    regions = list(map(int, choices(f.eco_ids)))
    if region_cells is None or not regions or "h3_r3" not in df.columns:
        return df
    cells = region_cells.filter(F.col("eco_id").isin(regions)).select("h3_r3").distinct()
    return df if cells.isEmpty() else df.join(cells, "h3_r3", "left_semi").select(df.columns)


def by_grade(df: DataFrame, f: Filters) -> DataFrame:
    return df if f.grade == "all" else df.filter(F.col("quality_grade") == f.grade)


def by_years(df: DataFrame, f: Filters) -> DataFrame:
    """Inclusive range. A NULL year is dropped only when a bound is set."""
    if f.year_min is not None:
        df = df.filter(F.col("year") >= f.year_min)
    if f.year_max is not None:
        df = df.filter(F.col("year") <= f.year_max)
    return df


def by_name(df: DataFrame, pattern: str | None) -> DataFrame:
    """Case-insensitive regular-expression search in ``name``."""
    return df.filter(matches_ignoring_case(F.col("name"), pattern)) if pattern else df


def keyed(df: DataFrame, keys: DataFrame | None, on: str) -> DataFrame:
    """Rows whose key is listed; all rows without a list."""
    return df if keys is None else df.join(keys.select(on).distinct(), on, "left_semi")


def named(df: DataFrame, names: DataFrame) -> DataFrame:
    """Rows whose ``name`` is listed, without regard to case."""
    wanted = names.select(F.lower("name").alias("wanted")).distinct()
    return df.join(wanted, F.lower(df["name"]) == F.col("wanted"), "left_semi")


def toggle_biome(selected: DataFrame, biome_regions: DataFrame) -> DataFrame:
    """Region selection after a click on a biome.

    If every region of the biome is selected they are all removed, otherwise all
    are added. Both frames have the one column ``eco_id``.
    """
    missing = biome_regions.join(selected, "eco_id", "left_anti")
    kept = selected.join(biome_regions, "eco_id", "left_anti")
    added = biome_regions.filter(missing.exists())
    return kept.unionByName(added).distinct()
