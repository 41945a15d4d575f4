import pytest
from pyspark.sql import functions as F

from wildgrid.operators import filters as flt
from wildgrid.operators.filters import DEFAULT_SCOPE, RESEARCH_SCOPE, Filters
from wildgrid.plans import dashboard as dash
from wildgrid.schemas import RANKS
from conftest import rows


@pytest.fixture(scope="module")
def hexes(spark):
    return spark.createDataFrame(
        [
            ("c1", "c1_1", "K1", "P1", "research", 2012, 5, 2, 1),
            ("c1", "c1_2", "K1", "P2", "research", 2013, 7, 3, 2),
            ("c2", "c2_1", "K2", "P1", "casual", 2012, 1, 1, 1),
            ("c3", "c3_1", None, "P1", "research", None, 4, 1, 1),
            (None, None, "K1", "P1", "research", 2012, 9, 9, 9),
        ],
        "h3_r3 string, h3_r5 string, kingdom string, phylum string, quality_grade string, year int, n_obs long, n_species long, n_observers long",
    )


@pytest.fixture(scope="module")
def cells(spark):
    return spark.createDataFrame([(1, "c1"), (2, "c2"), (2, "c1"), (3, "c9")], "eco_id int, h3_r3 string")


def test_map_metrics_and_selectors(hexes):
    assert rows(dash.density_map(hexes)) == [("c1", 12), ("c2", 1), ("c3", 4)]
    assert rows(dash.density_map(hexes, resolution=5, metric="species")) == [("c1_1", 2), ("c1_2", 3), ("c2_1", 1), ("c3_1", 1)]
    assert rows(dash.density_map(hexes, resolution=4, metric="observers")) == [("c1", 3), ("c2", 1), ("c3", 1)]
    assert rows(dash.density_map(hexes, metric="what")) == rows(dash.density_map(hexes))


def test_year_bounds_drop_null_years_only_when_set(hexes):
    assert rows(dash.density_map(hexes, Filters(year_min=2013))) == [("c1", 7)]
    assert rows(dash.density_map(hexes, Filters(year_max=2012))) == [("c1", 5), ("c2", 1)]


def test_taxa_lists_and_absent_levels(hexes):
    assert rows(dash.density_map(hexes, Filters(kingdom="K1,K2", phylum=("P1",)))) == [("c1", 5), ("c2", 1)]
    assert rows(dash.density_map(hexes, Filters(klass="nothing", order="x"))) == rows(dash.density_map(hexes))


def test_regions(hexes, cells):
    assert rows(dash.density_map(hexes, Filters(eco_ids=(2,)), region_cells=cells)) == [("c1", 12), ("c2", 1)]
    assert rows(dash.density_map(hexes, Filters(eco_ids="1,2"), region_cells=cells)) == [("c1", 12), ("c2", 1)]
    assert rows(dash.density_map(hexes, Filters(eco_ids=(3,)), region_cells=cells)) == []
    everything = rows(dash.density_map(hexes))
    assert rows(dash.density_map(hexes, Filters(eco_ids=(99,)), region_cells=cells)) == everything  # no cells: no filter
    assert rows(dash.density_map(hexes, Filters(eco_ids=(2,)))) == everything
    assert flt.by_ecoregions(hexes.drop("h3_r3"), Filters(eco_ids=(2,)), cells).count() == 5


def test_scopes():
    assert (DEFAULT_SCOPE.year_min, DEFAULT_SCOPE.year_max, DEFAULT_SCOPE.grade) == (2010, 2025, "research")
    assert len(set(RESEARCH_SCOPE.eco_ids)) == 32 and RESEARCH_SCOPE.phylum == ("Arthropoda",)


def test_bins(spark):
    df = spark.createDataFrame([("a", 0), ("b", 1), ("c", 100), ("d", None)], "h3 string, value long")
    assert rows(dash.with_bins(df), "h3", "bin") == [("a", None), ("b", 0), ("c", 5), ("d", None)]


def test_time_series(spark):
    df = spark.createDataFrame(
        [(2012, 11, "K", "research", 1, 1), (2012, 2, "K", "research", 2, 2), (2012, 2, "L", "research", 3, 3), (2011, 1, "K", "casual", 4, 4)],
        "year int, month int, kingdom string, quality_grade string, n_obs long, n_species long",
    )
    monthly = [tuple(r) for r in dash.time_series(df).collect()]
    assert monthly == [("2011-01", 4, 4), ("2012-02", 5, 5), ("2012-11", 1, 1)]
    assert [tuple(r) for r in dash.time_series(df, Filters(grade="research"), "yearly").collect()] == [("2012", 6, 6)]
    assert dash.time_series(df, Filters(eco_ids=(1,))).count() == 3


@pytest.fixture(scope="module")
def tree(spark):
    return spark.createDataFrame(
        [
            ("K1", "P1", "C1", "O1", "F", "G", "research", 3, 30),
            ("K1", "P1", "C1", "O2", "F", "G", "research", 2, 20),
            ("K1", "P1", "C1", "O2", "F", "G", "casual", 1, 1),
            ("K1", "P2", None, "O3", "F", "G", "research", 5, 5),
            ("K2", "", "C2", "O4", "F", "G", "research", 7, 7),
            (None, "P3", "C3", "O5", "F", "G", "research", 9, 9),
        ],
        ", ".join(f"`{r}` string" for r in RANKS) + ", quality_grade string, n_species long, n_obs long",
    )


def test_nodes_drop_missing_ranks_and_skip_empty_ones(tree):
    assert rows(dash.taxon_nodes(tree, Filters(grade="research"), 3)) == [("K1/P1/C1", 5, 50), ("K2/C2", 7, 7)]
    assert rows(dash.taxon_nodes(tree, depth=2)) == [("K1/P1", 6, 51), ("K1/P2", 5, 5), ("K2", 7, 7)]
    top = dash.top_nodes(dash.taxon_nodes(tree, depth=4), 2)
    assert [tuple(r) for r in top.select("label", "n_obs").collect()] == [("O1", 30), ("O2", 21)]


def test_options_cascade(tree):
    opts = dash.taxon_options(tree, Filters(kingdom="K1", klass="C1", grade="research"))
    assert rows(opts) == sorted([
        ("kingdom", "K1", 10), ("kingdom", "K2", 7), ("phylum", "P1", 5), ("phylum", "P2", 5),
        ("class", "C1", 5), ("order", "O1", 3), ("order", "O2", 2),
    ], key=repr)
    shown = dash.visible_options(opts, 1)
    assert rows(shown) == sorted([
        ("kingdom", 1, "K1", 10, 1), ("phylum", 1, "P1", 5, 1), ("class", 1, "C1", 5, 0), ("order", 1, "O1", 3, 1),
    ], key=repr)


def test_headline(hexes, tree, cells):
    f = Filters(kingdom="K1", year_min=2013, eco_ids=(1,), grade="research")
    assert tuple(dash.headline_stats(hexes, tree, f, cells).first()) == (7, 10, 1)
    assert tuple(dash.headline_stats(hexes, tree, Filters(kingdom="none"), cells).first()) == (0, 0, 0)


SPECIES = "taxon_id int, name string, kingdom string, class string, quality_grade string, n_obs long, n_observers long, n_cells long"


@pytest.fixture(scope="module")
def species(spark):
    return spark.createDataFrame(
        [
            (1, "Ant", "K", "C1", "research", 30, 3, 25),
            (1, "Ant", "K", "C1", "casual", 5, 1, 2),
            (2, "bee", "K", "C1", "research", 1, 9, 1),
            (3, "Cat", "K", "C2", "research", 20, 2, 3),
            (4, None, "K", None, "research", 44, 2, 3),
            (5, "Dog", "K", "", "research", None, None, 3),
        ],
        SPECIES,
    )


def test_bias_counts_rows_and_keeps_classless_rows_in_the_totals(species):
    got = {r["class"]: r.asDict() for r in dash.class_bias(species).collect()}
    assert set(got) == {"C1", "C2"}
    c1 = got["C1"]
    assert (c1["n_species"], c1["n_obs"], c1["p1"]) == (3, 36, 100.0)  # rows, not species
    assert c1["ideal"] == round(100 * (3 / 6), 1) and c1["deviation"] == round(36 - 50.0, 1)
    assert c1["deviation_pct"] == round(-14 / 50 * 100, 1)
    assert (c1["p20"], c1["p20d"]) == (33.3, 33.3)
    assert [r["class"] for r in dash.class_bias(species).collect()] == ["C2", "C1"]  # by deviation
    assert tuple(dash.bias_totals(species).first()) == (100, 6, 2)


def test_bias_of_nothing_is_empty(species):
    assert dash.class_bias(species, Filters(kingdom="none")).collect() == []


def test_deviations_cancel_when_every_row_has_a_class(species):
    with_class = species.filter("class in ('C1', 'C2')")
    assert abs(sum(r.deviation for r in dash.class_bias(with_class).collect())) < 0.2


def test_coverage_long(species):
    assert rows(dash.coverage_long(dash.class_bias(species), 1)) == [("C2", "p1", 100.0), ("C2", "p20", 100.0), ("C2", "p20d", 0.0)]


def test_pages_by_last_key_meet_every_row_once(species):
    for sort_by in ("obs", "name", "observers"):
        whole = [tuple(r)[: len(species.columns)] for r in dash.species_page(species, page_size=100, sort_by=sort_by).collect()]
        got = dash.species_page(species, page_size=2, sort_by=sort_by).drop("total", "pages").collect()
        while more := dash.species_after(species, got[-1].asDict(), page_size=2, sort_by=sort_by).collect():
            got += more
        assert [tuple(r) for r in got] == whole


def test_species_page_order_and_counts(species):
    by_obs = dash.species_page(species, page_size=4)
    assert [r.taxon_id for r in by_obs.collect()] == [4, 1, 3, 1]
    second = dash.species_page(species, page_number=2, page_size=4).collect()
    assert [r.taxon_id for r in second] == [2, 5]  # NULL last
    assert (second[0].total, second[0].pages) == (6, 2)
    assert [r.name for r in dash.species_page(species, sort_by="name").collect()] == ["Ant", "Ant", "Cat", "Dog", "bee", None]
    assert [r.n_observers for r in dash.species_page(species, sort_by="observers").collect()][:2] == [9, 3]
    with pytest.raises(ValueError):
        dash.species_page(species, page_size=101)


def test_search_is_a_regular_expression_without_case(species):
    assert {r.name for r in dash.species_page(species, search="^(ANT|B)").collect()} == {"Ant", "bee"}
    assert dash.species_page(species, search=".").count() == 5  # NULL never matches


def test_biomes(spark):
    meta = spark.createDataFrame([(3, "E3", 2, "B2"), (1, "E1", 1, "B1"), (2, "E2", 2, "B2")], "eco_id int, eco_name string, biome_num int, biome_name string")
    assert [tuple(r) for r in dash.biome_groups(meta).collect()] == [(1, "B1", [1], 1), (2, "B2", [2, 3], 2)]
    def ids(*values):
        return spark.createDataFrame([(v,) for v in values], "eco_id int")
    assert rows(flt.toggle_biome(ids(1, 2, 3), ids(2, 3))) == [(1,)]
    assert rows(flt.toggle_biome(ids(1, 2), ids(2, 3))) == [(1,), (2,), (3,)]
    assert rows(flt.toggle_biome(ids(1), ids(2, 3))) == [(1,), (2,), (3,)]
