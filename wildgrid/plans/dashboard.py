"""Dashboard queries over the aggregate tables.

Sums of ``n_species`` and ``n_observers`` add up counts that were distinct
within finer groups. That is how these measures are defined here; they are not
distinct counts of the coarser group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wildgrid.functions import numeric, text
from wildgrid.operators import filters as flt
from wildgrid.operators.filters import Filters
from wildgrid.schemas import RANKS

METRICS = {"obs": "n_obs", "species": "n_species", "observers": "n_observers"}
CELL_COLUMNS = {3: "h3_r3", 5: "h3_r5"}
SPECIES_SORT = {"obs": "n_obs", "name": "name", "observers": "n_observers"}
OPTION_LEVELS = ["kingdom", "phylum", "class", "order"]
COVERAGE = ["p1", "p20", "p20d"]


def scoped(
    table: DataFrame, f: Filters, region_cells: DataFrame | None = None, years: bool = True
) -> DataFrame:
    """All filters that apply to ``table``; those it has no column for do nothing."""
    df = flt.by_grade(flt.by_ecoregions(flt.by_taxa(table, f), f, region_cells), f)
    return flt.by_years(df, f) if years else df


def density_map(
    hex_density: DataFrame,
    f: Filters = Filters(),
    resolution: int = 3,
    metric: str = "obs",
    region_cells: DataFrame | None = None,
) -> DataFrame:
    """(h3, value) per cell; an unknown resolution means 3, an unknown metric observations."""
    cell = CELL_COLUMNS.get(resolution, "h3_r3")
    value = METRICS.get(metric, "n_obs")
    return (
        scoped(hex_density, f, region_cells)
        .filter(F.col(cell).isNotNull())
        .groupBy(F.col(cell).alias("h3"))
        .agg(F.sum(value).alias("value"))
    )


def with_bins(cells: DataFrame) -> DataFrame:
    """Colour bin of each cell, relative to the largest value of the result."""
    top = cells.agg(F.max("value")).scalar()
    return cells.withColumn("bin", numeric.power_bin(F.col("value"), top))


def time_series(temporal: DataFrame, f: Filters = Filters(), granularity: str = "monthly") -> DataFrame:
    """(date, n_obs, n_species) in date order, by month unless ``yearly``."""
    df = scoped(temporal, f)
    if granularity == "yearly":
        keys, label = ["year"], F.col("year").cast("string")
    else:
        keys, label = ["year", "month"], text.month_label(F.col("year"), F.col("month"))
    sums = (
        df.dropna(subset=keys)
        .groupBy(*keys)
        .agg(F.sum("n_obs").alias("n_obs"), F.sum("n_species").alias("n_species"))
    )
    return sums.select(label.alias("date"), "n_obs", "n_species").orderBy("date")


def taxon_nodes(taxon_tree: DataFrame, f: Filters = Filters(), depth: int = 4) -> DataFrame:
    """(path, n_species, n_obs) of the branches at a depth of 2 to 6 ranks."""
    if not 2 <= depth <= len(RANKS):
        raise ValueError(f"depth must be 2 to {len(RANKS)}")
    levels = RANKS[:depth]
    return (
        scoped(taxon_tree, f, years=False)
        .dropna(subset=levels)
        .groupBy(*levels)
        .agg(F.sum("n_species").alias("n_species"), F.sum("n_obs").alias("n_obs"))
        .select(text.rank_path([F.col(f"`{c}`") for c in levels]).alias("path"), "n_species", "n_obs")
    )


def top_nodes(nodes: DataFrame, shown: int = 40) -> DataFrame:
    return (
        nodes.orderBy(F.desc("n_obs"), "path")
        .limit(shown)
        .select(text.last_segment(F.col("path")).alias("label"), "path", "n_obs", "n_species")
    )


def taxon_options(taxon_tree: DataFrame, f: Filters = Filters()) -> DataFrame:
    """(level, value, n): choices per level, each limited by the levels above it.

    One pass: every row offers its value to each level whose upper levels match.
    """
    chosen = {"kingdom": f.kingdom, "phylum": f.phylum, "class": f.klass}
    allowed: Column = F.lit(True)
    offers = []
    for level in OPTION_LEVELS:
        value = text.blank_to_null(F.col(f"`{level}`"))
        offers.append(F.struct(F.lit(level).alias("level"), F.when(allowed, value).alias("value")))
        wanted = flt.choices(chosen.get(level))
        if wanted:
            allowed = allowed & F.col(f"`{level}`").isin(wanted)
    return (
        flt.by_grade(taxon_tree, f)
        .select("n_species", F.explode(F.array(*offers)).alias("offer"))
        .select("offer.level", "offer.value", "n_species")
        .filter("value is not null")
        .groupBy("level", "value")
        .agg(F.sum("n_species").alias("n"))
    )


def visible_options(options: DataFrame, shown: int = 30) -> DataFrame:
    """First options per level by species, and how many more the level has."""
    nth = F.row_number().over(Window.partitionBy("level").orderBy(F.desc("n"), "value"))
    top = options.withColumn("position", nth).filter(F.col("position") <= shown)
    totals = options.groupBy("level").agg(F.count("*").alias("total"))
    return top.join(totals, "level").select(
        "level", "position", "value", "n", F.greatest(F.col("total") - shown, F.lit(0)).alias("more")
    )


def headline_stats(
    hex_density: DataFrame, taxon_tree: DataFrame, f: Filters = Filters(), region_cells: DataFrame | None = None
) -> DataFrame:
    """One row: observations, species, coarse cells. Species ignore years and regions."""
    species = scoped(taxon_tree, f, years=False).agg(F.coalesce(F.sum("n_species"), F.lit(0))).scalar()
    return (
        scoped(hex_density, f, region_cells)
        .agg(F.coalesce(F.sum("n_obs"), F.lit(0)).alias("n_obs"), F.count_distinct("h3_r3").alias("n_cells"))
        .select("n_obs", species.alias("n_species"), "n_cells")
    )


def class_bias(species: DataFrame, f: Filters = Filters()) -> DataFrame:
    """Sampling bias per class against effort in proportion to its species.

    Totals include rows without a class; those rows form no group. Coverage is
    the share of rows with at least 1 or 20 observations, or 20 cells.
    """
    df = scoped(species, f, years=False)
    # One row per class: the totals are summed over these, not over the species.
    every = Window.partitionBy()
    groups = (
        df.groupBy("class")
        .agg(
            F.min("kingdom").alias("kingdom"),
            F.count("*").alias("n_species"),
            F.sum("n_obs").alias("n_obs"),
            F.count_if(F.col("n_obs") >= 1).alias("seen"),
            F.count_if(F.col("n_obs") >= 20).alias("seen_20"),
            F.count_if(F.col("n_cells") >= 20).alias("spread_20"),
        )
        .withColumn("total_obs", F.sum("n_obs").over(every))
        .withColumn("total_rows", F.sum("n_species").over(every))
        .filter(text.blank_to_null(F.col("class")).isNotNull())
        .withColumn("exact_ideal", F.col("total_obs") * (F.col("n_species") / F.col("total_rows")))
        .withColumn("exact_deviation", F.col("n_obs") - F.col("exact_ideal"))
    )
    return groups.select(
        "class",
        "kingdom",
        "n_species",
        "n_obs",
        numeric.round_to(F.col("exact_ideal"), 1).alias("ideal"),
        numeric.round_to(F.col("exact_deviation"), 1).alias("deviation"),
        numeric.percent(F.col("exact_deviation"), F.col("exact_ideal")).alias("deviation_pct"),
        numeric.percent(F.col("seen"), F.col("n_species")).alias("p1"),
        numeric.percent(F.col("seen_20"), F.col("n_species")).alias("p20"),
        numeric.percent(F.col("spread_20"), F.col("n_species")).alias("p20d"),
    ).orderBy(F.desc("deviation"), "class")


def bias_totals(species: DataFrame, f: Filters = Filters()) -> DataFrame:
    df = scoped(species, f, years=False)
    return df.agg(
        F.sum("n_obs").alias("total_obs"),
        F.count("*").alias("total_species"),
        F.count_distinct(text.blank_to_null(F.col("class"))).alias("n_classes"),
    )


def coverage_long(bias: DataFrame, shown: int = 30) -> DataFrame:
    """(class, metric, value) of the first classes by deviation."""
    first = bias.orderBy(F.desc("deviation"), "class").limit(shown)
    return first.unpivot("class", COVERAGE, "metric", "value")


def page(
    df: DataFrame, sort: Column, ties: list[str], page_number: int, page_size: int
) -> DataFrame:
    """One page of the sorted rows, each with ``total`` and ``pages`` of the whole result."""
    total = df.agg(F.count("*")).scalar()
    rows = df.orderBy(sort, *ties).offset((page_number - 1) * page_size).limit(page_size)
    return rows.withColumn("total", total).withColumn("pages", numeric.page_count(F.col("total"), page_size))


# Fixed value: largest page of the species list.
MAX_PAGE = 100
SPECIES_TIES = ["taxon_id", "quality_grade"]


def _species_order(sort_by: str) -> tuple[str, bool, Column]:
    """Column, whether it ascends, and the order: names ascend, counts descend, NULL comes last."""
    column = SPECIES_SORT.get(sort_by, "n_obs")
    ascends = column == "name"
    return column, ascends, F.asc_nulls_last(column) if ascends else F.desc_nulls_last(column)


def species_page(
    species: DataFrame,
    f: Filters = Filters(),
    search: str = "",
    page_number: int = 1,
    page_size: int = 24,
    sort_by: str = "obs",
) -> DataFrame:
    """Page of the species list, in the order of ``_species_order``.

    ``species`` needs no photos or names; ``aggregates.with_photo_and_name`` adds them to
    the page alone. All rows before the page are sorted too; for deep pages see
    ``species_after``.
    """
    if not 1 <= page_size <= MAX_PAGE or page_number < 1:
        raise ValueError(f"page_size must be 1 to {MAX_PAGE}, page_number at least 1")
    df = flt.by_name(scoped(species, f, years=False), search)
    return page(df, _species_order(sort_by)[2], SPECIES_TIES, page_number, page_size)


def species_after(
    species: DataFrame,
    last: dict,
    f: Filters = Filters(),
    search: str = "",
    page_size: int = 24,
    sort_by: str = "obs",
) -> DataFrame:
    """The rows that follow ``last``, a row of the page before; its cost does not grow with depth."""
    if not 1 <= page_size <= MAX_PAGE:
        raise ValueError(f"page_size must be 1 to {MAX_PAGE}")
    df = flt.by_name(scoped(species, f, years=False), search)
    column, ascends, sort = _species_order(sort_by)
    value, taxon, grade = F.lit(last[column]), F.lit(last["taxon_id"]), F.lit(last["quality_grade"])
    # Ties ascend, NULL first.
    grade_later = F.col("quality_grade").isNotNull() & (grade.isNull() | (F.col("quality_grade") > grade))
    tie_later = (F.col("taxon_id") > taxon) | ((F.col("taxon_id") == taxon) & grade_later)
    beyond = F.col(column) > value if ascends else F.col(column) < value
    later = beyond | (F.col(column).isNull() & value.isNotNull()) | (F.col(column).eqNullSafe(value) & tie_later)
    return df.filter(later).orderBy(sort, *SPECIES_TIES).limit(page_size)


def biome_groups(meta: DataFrame) -> DataFrame:
    """Regions per biome with their number; the number of regions bounds a list."""
    return (
        meta.groupBy("biome_num")
        .agg(
            F.min("biome_name").alias("biome_name"),
            F.array_sort(F.collect_list("eco_id")).alias("eco_ids"),
            F.count("*").alias("n_regions"),
        )
        .orderBy("biome_num")
    )
