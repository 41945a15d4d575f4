"""Aggregates that are continued with the observations of a new dump part.

Each aggregate keeps a state: the distinct ids of each group as bits
(``operators.distinct_state``), and its totals beside the bits of the first measure. A part is
read once and merged into the state in one shuffle; earlier observations are not read again. The state and the aggregate made from it
are published as one version of the store, so that both always belong together, and a
fold that dies half-way can be repeated.

A part holds observations that the store has not had; an observation that is folded twice is
counted twice in ``n_obs``. Taxa are looked up when a part is folded: after a change of the
taxa, fold everything into a new store. Ids are integers, cells those of ``operators.grid``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wildgrid.operators.distinct_state import BITS, MEASURE, WORD, id_bits
from wildgrid.operators.grid import cell_number
from wildgrid.plans.aggregates import SORTING
from wildgrid.schemas import RANKS
from wildgrid.sources.versions import Draft, latest, read_version


@dataclass(frozen=True)
class Continued:
    """What an aggregate groups by, counts distinctly, and takes the extremes of."""

    keys: list[str]
    rows: Callable[[DataFrame, DataFrame], DataFrame]
    ids: dict[str, str | Column]
    extremes: dict[str, tuple[Callable, str]] = field(default_factory=dict)
    finish: Callable[[DataFrame, DataFrame], DataFrame] = lambda counted, taxa: counted


def _of_taxa(where: str, branch: list[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    return lambda obs, taxa: obs.filter(where).join(taxa.select("taxon_id", *branch), "taxon_id")


def _of_species(obs: DataFrame, taxa: DataFrame) -> DataFrame:
    return obs.join(taxa.filter(F.col("rank") == "species").select("taxon_id"), "taxon_id", "left_semi")


def _named_species(counted: DataFrame, taxa: DataFrame) -> DataFrame:
    names = taxa.filter(F.col("rank") == "species").select("taxon_id", "name", "rank", *RANKS)
    return counted.join(names, "taxon_id").select(
        "taxon_id", "name", "rank", *RANKS, "quality_grade",
        "n_obs", "n_observers", "first_year", "last_year", "n_cells",
    )


def continued() -> dict[str, Continued]:
    """The five aggregates; the species list without photos and names, which its readers add."""
    both = {"n_species": "taxon_id", "n_observers": "observer_id"}
    branch = ["kingdom", "phylum"]
    located, dated = "h3_r3 is not null", "year is not null and month is not null"
    return {
        "hex_density": Continued(
            ["h3_r3", "h3_r5", *branch, "quality_grade", "year"], _of_taxa(located, branch), both),
        "country_stats": Continued(["h3_r3", *branch, "quality_grade", "year"], _of_taxa(located, branch), both),
        "temporal": Continued(
            ["year", "month", *branch, "quality_grade"], _of_taxa(dated, branch), {"n_species": "taxon_id"}),
        "taxon_tree": Continued([*RANKS, "quality_grade"], _of_taxa("true", RANKS), {"n_species": "taxon_id"}),
        "species_list": Continued(
            ["taxon_id", "quality_grade"], _of_species,
            {"n_observers": "observer_id", "n_cells": cell_number("h3_r3")},
            {"first_year": (F.min, "year"), "last_year": (F.max, "year")}, _named_species),
    }


def _state_columns(table: Continued) -> list[str]:
    return [*table.keys, MEASURE, WORD, BITS, "n_obs", *table.extremes]


def _as_state(table: Continued, rows: DataFrame) -> DataFrame:
    """A row per observation and measure: its id as a bit, the totals with the first measure only."""
    carried = {"n_obs": F.lit(1).cast("long"), **{name: F.col(c) for name, (_, c) in table.extremes.items()}}
    first = next(iter(table.ids))
    extra = {m: [(v if m == first else F.lit(None)).alias(name) for name, v in carried.items()] for m in table.ids}
    return id_bits(rows, table.keys, table.ids, extra).filter(F.col(BITS).isNotNull() | F.col("n_obs").isNotNull())


def _held(table: Continued, ids: DataFrame, totals: DataFrame) -> DataFrame:
    """The state of a version; one of an older form has its totals in a table of their own."""
    if "n_obs" in ids.columns:
        return ids
    apart = totals.withColumn(MEASURE, F.lit(next(iter(table.ids))))
    return ids.unionByName(apart, allowMissingColumns=True)


def _merged(table: Continued, states: list[DataFrame]) -> DataFrame:
    """One state of several, in one shuffle."""
    extremes = [pick(name).alias(name) for name, (pick, _) in table.extremes.items()]
    rows = reduce(DataFrame.unionByName, [state.select(*_state_columns(table)) for state in states])
    return rows.groupBy(*table.keys, MEASURE, WORD).agg(F.bit_or(BITS).alias(BITS), F.sum("n_obs").alias("n_obs"), *extremes)


def _counted(table: Continued, state: DataFrame) -> DataFrame:
    """Totals and numbers of distinct ids per group."""
    extremes = [pick(name).alias(name) for name, (pick, _) in table.extremes.items()]
    n_ids = F.bit_count(BITS).cast("long")
    return state.groupBy(*table.keys).agg(
        F.sum("n_obs").alias("n_obs"), *extremes,
        *[F.coalesce(F.sum(F.when(F.col(MEASURE) == m, n_ids)), F.lit(0).cast("long")).alias(m) for m in table.ids],
    )


def fold(
    spark: SparkSession, store: str, obs: DataFrame, taxa: DataFrame, only: list[str] | None = None
) -> int:
    """Add the observations of a part to the store; the number of the version that has them.

    The first part starts the store. ``only`` names the aggregates that a new store has;
    a later fold continues those that the store has, and may not name others.
    """
    tables = continued()
    before = latest(spark, store)
    old = {} if before is None else read_version(spark, store, before)
    names = [n for n in tables if n in old] if old else [n for n in tables if only is None or n in only]
    if only is not None and set(only) != set(names):
        raise ValueError(f"{store} has {names}, not {sorted(only)}")

    draft = Draft(spark, store, before)
    for name in names:
        table = tables[name]
        states = [_as_state(table, table.rows(obs, taxa))]
        if old:
            states.append(_held(table, old[f"{name}_ids"], old[f"{name}_totals"]))
        state = draft.add(f"{name}_ids", _merged(table, states))
        totals = draft.add(f"{name}_totals", _counted(table, state))
        draft.add(name, table.finish(totals, taxa), SORTING[name])
    return draft.publish()
