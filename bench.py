"""Timed run of the table builds and of the dashboard queries over the stored tables.

Prints one JSON line. BENCH_SF_DIR names the test tables, BENCH_CPUS the cores.
A dashboard query is timed as a user meets it, over the stored aggregates and
after one earlier call; a build is timed from the raw tables, once.
"""

from __future__ import annotations

import json
import os
import time
from dataclasses import replace

from wildgrid.checks.queries import GRADE_YEARS, NARROW, QUERIES, REGIONS, Tables
from wildgrid.operators.filters import Filters
from wildgrid.plans import aggregates as agg, dashboard as dash
from wildgrid.session import build_session, fresh_path
from wildgrid.sources.tables import load_aggregates, write_table

# Whole jobs, timed from the raw tables.
JOBS = [
    "obs_clean", "obs_cells", "taxa_enriched", "taxon_link", "species_profile",
    "ecoregion_cells", "retrieval_stage3", "retrieval_predictions", "embedding_profile", "external_species",
]


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def scale(folder: str) -> float | str:
    name = folder.rstrip("/").rsplit("sf", 1)[-1]
    try:
        return float(name)
    except ValueError:
        return name


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    t = Tables(spark, folder)
    seconds: dict[str, float] = {}
    out = fresh_path(spark, "bench")

    # The stored tables that the aggregates are built from.
    sources = {
        "obs": t.obs, "taxa_enriched": t.taxa, "photos": t.photos, "observers": t.observers,
        "taxon_join": t.link, "gbif_vernac": t.vernacular,
    }
    seconds["store_sources"] = timed(
        lambda: [write_table(df, f"{out}/{name}.parquet") for name, df in sources.items()]
    )
    stored = {name: spark.read.parquet(f"{out}/{name}.parquet") for name in sources}
    for name in agg.SORTING:
        seconds[f"build_{name}"] = timed(lambda: agg.build_aggregates(stored, out, [name]))
    write_table(t.region_cells, f"{out}/region_cells.parquet")

    tables = load_aggregates(spark, out)
    cells = spark.read.parquet(f"{out}/region_cells.parquet")
    hexes, tree, series, species = (tables[n] for n in ("hex_density", "taxon_tree", "temporal", "species_list"))
    responses = {
        "map_hex_r3": lambda: dash.density_map(hexes, GRADE_YEARS, 3, "obs"),
        "map_hex_r5": lambda: dash.density_map(hexes, GRADE_YEARS, 5, "species"),
        "map_hex_bins": lambda: dash.with_bins(dash.density_map(hexes, GRADE_YEARS, 3, "obs")),
        "map_hex_ecoregion": lambda: dash.density_map(hexes, REGIONS, 3, "obs", cells),
        "temporal_monthly": lambda: dash.time_series(series, NARROW),
        "temporal_yearly": lambda: dash.time_series(series, NARROW, "yearly"),
        "taxon_nodes_depth3": lambda: dash.taxon_nodes(tree, Filters(grade="research"), 3),
        "taxon_top40": lambda: dash.top_nodes(dash.taxon_nodes(tree, Filters(), 4)),
        "taxon_options": lambda: dash.visible_options(dash.taxon_options(tree, Filters(kingdom="STANDARD"))),
        "headline_stats": lambda: dash.headline_stats(hexes, tree, replace(REGIONS, year_min=1997), cells),
        "bias_by_class": lambda: dash.class_bias(species),
        "species_page": lambda: dash.species_page(species, Filters(grade="research"), page_number=2),
        "species_search": lambda: dash.species_page(species, search="ring", sort_by="name"),
    }
    for name, plan in responses.items():
        plan().collect()
        seconds[name] = timed(lambda: plan().collect())
    for name in JOBS:
        seconds[name] = timed(lambda: QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save())

    print(json.dumps({
        "metric": "total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": scale(folder),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
