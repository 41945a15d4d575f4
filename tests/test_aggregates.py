import pytest
from pyspark.sql import functions as F

from wildgrid.plans import aggregates as agg
from wildgrid.plans.profile import species_profiles
from wildgrid.schemas import RANKS
from conftest import rows

OBS = "observation_uuid string, observer_id int, taxon_id int, quality_grade string, year int, month int, h3_r3 string, h3_r5 string"
TAXA = "taxon_id int, name string, rank string, " + ", ".join(f"`{r}` string" for r in RANKS)


@pytest.fixture(scope="module")
def obs(spark):
    return spark.createDataFrame(
        [
            ("a", 1, 10, "research", 2012, 5, "c1", "c1_1"),
            ("b", 1, 10, "research", 2012, 5, "c1", "c1_1"),
            ("c", 2, 11, "research", 2012, 5, "c1", "c1_1"),
            ("d", None, 10, "research", 2012, 6, "c1", "c1_2"),
            ("e", 2, 10, "casual", None, None, "c2", "c2_1"),
            ("f", 2, 99, "research", 2012, 5, "c1", "c1_1"),  # unknown or inactive taxon
            ("g", 3, 12, "research", 2013, 1, None, None),
            ("h", 3, None, "research", 2013, 1, "c1", "c1_1"),
        ],
        OBS,
    )


@pytest.fixture(scope="module")
def taxa(spark):
    return spark.createDataFrame(
        [
            (10, "Alpha", "species", "K", "P", "C", "O", "F", "G"),
            (11, "Beta", "species", "K", "P", None, "O", "F", "G"),
            (12, "Gamma", "genus", "K", None, "C", "O", "F", None),
        ],
        TAXA,
    )


def test_density_counts_and_null_keys(obs, taxa):
    assert rows(agg.hex_density(obs, taxa), "h3_r5", "quality_grade", "year", "n_obs", "n_species", "n_observers") == sorted([
        ("c1_1", "research", 2012, 3, 2, 2), ("c1_2", "research", 2012, 1, 1, 0), ("c2_1", "casual", None, 1, 1, 1),
    ], key=repr)
    assert rows(agg.country_stats(obs, taxa), "h3_r3", "year", "n_obs", "n_species", "n_observers") == sorted([
        ("c1", 2012, 4, 2, 2), ("c2", None, 1, 1, 1),
    ], key=repr)


def test_density_sums_to_the_located_observations_of_known_taxa(obs, taxa):
    joined = obs.filter("h3_r3 is not null").join(taxa, "taxon_id").count()
    assert agg.hex_density(obs, taxa).agg(F.sum("n_obs")).first()[0] == joined


def test_temporal_needs_year_and_month(obs, taxa):
    assert rows(agg.temporal(obs, taxa), "year", "month", "phylum", "n_obs", "n_species") == sorted([
        (2012, 5, "P", 3, 2), (2012, 6, "P", 1, 1), (2013, 1, None, 1, 1),
    ], key=repr)


def test_tree_keeps_missing_ranks(obs, taxa):
    assert rows(agg.taxon_tree(obs, taxa), "phylum", "class", "quality_grade", "n_species", "n_obs") == sorted([
        ("P", "C", "research", 1, 3), ("P", "C", "casual", 1, 1), ("P", None, "research", 1, 1), (None, "C", "research", 1, 1),
    ], key=repr)


@pytest.fixture(scope="module")
def parts(spark):
    return {
        "photos": spark.createDataFrame(
            [(7, "http://7", "CC", "b"), (5, "http://5", None, "a"), (9, "http://9", "CC", "c"), (1, None, "CC", "a"), (3, "http://3", "CC", "zz")],
            "photo_id int, photo_url string, license string, observation_uuid string",
        ),
        "observers": spark.createDataFrame([(1, "ana")], "observer_id int, login string"),
        "link": spark.createDataFrame([(10, 100), (11, None), (12, 100)], "taxon_id int, gbif_id long"),
        "vernacular": spark.createDataFrame(
            [(100, "zorro", "es"), (100, "aardvark", "en"), (100, "abeille", "fr"), (100, "ant", "eng")],
            "gbif_id long, vernacularName string, language string",
        ),
        "description": spark.createDataFrame(
            [(100, None, "null type", "en", "s0", "l0"), (100, "Biology", "b", "EN", "s1", "l1"), (100, "DESCRIPTION", "d", "english", "s2", "l2"),
             (100, "references", "a", "en", "s3", "l3"), (100, "description", "c", "fr", "s4", "l4")],
            "gbif_id long, type string, description string, language string, source string, license string",
        ),
    }


def test_species_list(obs, taxa, parts):
    df = agg.species_list(obs, taxa, parts["photos"], parts["observers"], parts["link"], parts["vernacular"])
    assert df.columns == [
        "taxon_id", "name", "rank", *RANKS, "quality_grade", "n_obs", "n_observers", "first_year", "last_year",
        "n_cells", "photo_url", "photo_license", "photo_attribution", "vernacular_name",
    ]
    got = {(r.taxon_id, r.quality_grade): r for r in df.collect()}
    assert set(got) == {(10, "research"), (10, "casual"), (11, "research")}  # one row per grade, species only
    a = got[(10, "research")]
    assert (a.n_obs, a.n_observers, a.first_year, a.last_year, a.n_cells) == (3, 1, 2012, 2012, 1)
    assert (a.photo_url, a.photo_license, a.photo_attribution, a.vernacular_name) == ("http://5", None, "ana", "aardvark")
    b = got[(11, "research")]
    assert (b.photo_url, b.photo_attribution, b.vernacular_name) == ("http://9", None, None)
    assert got[(10, "casual")].first_year is None


def test_profiles(spark, obs, taxa, parts):
    args = (parts["photos"], parts["observers"], parts["link"], parts["vernacular"], parts["description"])
    nameless = taxa.unionByName(spark.createDataFrame([(13, None, "species", *[None] * 6), (14, "Unseen", "species", *[None] * 6)], TAXA))
    got = {r.taxon_id: r for r in species_profiles(nameless, obs, *args).collect()}
    assert set(got) == {10, 11, 12, 14}  # no name, no profile
    a = got[10]
    assert (a.vernacular_name, a.vernac_lang) == ("zorro", "es")  # Spanish first
    assert (a.description, a.desc_source, a.desc_license) == ("d", "s2", "l2")  # type description first, NULL type out
    assert (a.n_obs, a.n_observers, a.first_year, a.photo_attribution) == (4, 2, 2012, "ana")
    assert (got[14].n_obs, got[14].n_observers, got[14].first_year, got[14].photo_url) == (0, 0, None, None)
    ids = spark.createDataFrame([(11,), (11,)], "taxon_id int")
    assert rows(species_profiles(nameless, obs, *args, ids=ids), "taxon_id", "n_obs") == [(11, 1)]


def test_build_all_or_some(spark, obs, taxa, parts, tmp_path):
    tables = {"obs": obs, "taxa_enriched": taxa, "photos": parts["photos"], "observers": parts["observers"],
              "taxon_join": parts["link"], "gbif_vernac": parts["vernacular"]}
    agg.build_aggregates(tables, str(tmp_path / "some"), ["temporal"])
    assert sorted(p.name for p in (tmp_path / "some").iterdir()) == ["temporal.parquet"]
    agg.build_aggregates(tables, str(tmp_path / "all"))
    assert sorted(p.stem for p in (tmp_path / "all").iterdir()) == sorted(agg.SORTING)


def test_one_taxon_with_most_observations_is_combined_before_the_shuffle(spark, taxa):
    """The hot taxon reaches the join and the shuffle as one row per task and key."""
    hot = spark.range(200_000).select(
        F.lit("u").alias("observation_uuid"), (F.col("id") % 50).cast("int").alias("observer_id"), F.lit(10).alias("taxon_id"),
        F.lit("research").alias("quality_grade"), F.lit(2012).alias("year"), F.lit(1).alias("month"),
        F.lit("c").alias("h3_r3"), F.lit("c_1").alias("h3_r5"),
    )
    assert rows(agg.temporal(hot, taxa), "n_obs", "n_species") == [(200_000, 1)]
    assert rows(agg.hex_density(hot, taxa), "n_obs", "n_species", "n_observers") == [(200_000, 1, 50)]
    assert rows(agg.species_counts(hot, taxa), "n_obs", "n_observers", "n_cells") == [(200_000, 50, 1)]
