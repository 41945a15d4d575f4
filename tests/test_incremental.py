import random

import pytest
from pyspark.sql import functions as F

from wildgrid.operators.distinct_state import merged_ids, seen_ids, with_distinct
from wildgrid.operators.grid import assign_cells, cell_number
from wildgrid.plans import aggregates as agg, incremental
from wildgrid.schemas import RANKS
from wildgrid.sources import versions
from conftest import rows

OBS = "observation_uuid string, observer_id int, taxon_id int, quality_grade string, year int, month int, h3_r3 string, h3_r5 string"
TAXA = "taxon_id int, name string, rank string, " + ", ".join(f"`{r}` string" for r in RANKS)


@pytest.fixture(scope="module")
def taxa(spark):
    ranks = lambda i: [None if (i + k) % 5 == 0 else f"{r}{i % (k + 2)}" for k, r in enumerate(RANKS)]
    return spark.createDataFrame([(i, f"n{i}", "genus" if i % 7 == 0 else "species", *ranks(i)) for i in range(200)], TAXA)


@pytest.fixture(scope="module")
def obs(spark):
    """A third of all rows: one taxon, cell and observer. NULLs everywhere; ids below zero and far apart."""
    rng = random.Random(6)
    out = []
    for i in range(3000):
        cell = None if i % 23 == 0 else f"{rng.randrange(3)}_{rng.randrange(4)}"
        one = (rng.choice([None, -1, -64, -65, 0, 63, 64, 2**31 - 1, *range(100, 300)]),
               rng.choice([None, 999, *range(200)]), rng.choice(["research", "casual", None]),
               rng.choice([None, 2011, 2012]), rng.choice([None, 1, 2]), cell, cell and cell + "_0_0")
        out.append((f"u{i}", *((63, 5, "research", 2012, 1, "1_1", "1_1_0_0") if i % 3 == 0 else one)))
    return spark.createDataFrame(out, OBS)


WHOLE = {
    "hex_density": agg.hex_density, "country_stats": agg.country_stats, "temporal": agg.temporal,
    "taxon_tree": agg.taxon_tree, "species_list": agg.species_counts,
}


def test_folding_parts_equals_a_full_build(spark, tmp_path, obs, taxa):
    """Parts of unequal size, one of them empty; ids that several parts have."""
    store = str(tmp_path / "store")
    part = F.when(F.col("year") == 2011, 0).when(F.col("observation_uuid").endswith("7"), 1).otherwise(2)
    for i in (0, 1, 3, 2):
        incremental.fold(spark, store, obs.filter(part == i), taxa)
    got = versions.read_version(spark, store)
    for name, whole in WHOLE.items():
        want = whole(obs, taxa)
        assert set(got[name].columns) == set(want.columns)
        assert rows(got[name], *want.columns) == rows(want), name
    # Every earlier version can still be read, and holds what had been folded by then.
    first = versions.read_version(spark, store, 0)["temporal"]
    assert rows(first, *WHOLE["temporal"](obs, taxa).columns) == rows(agg.temporal(obs.filter("year = 2011"), taxa))


def test_a_fold_reads_its_part_once(spark, tmp_path, obs, taxa):
    """Every observation is computed once per fold, not once for the totals and once for the ids."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    part = obs.mapInArrow(counted, obs.schema)
    incremental.fold(spark, str(tmp_path / "store"), part, taxa, ["temporal"])
    assert seen.value == 3000


def test_a_store_of_the_older_form_is_continued(spark, tmp_path, obs, taxa):
    """Its ids have no totals; they are in a table of their own."""
    store, table = str(tmp_path / "store"), incremental.continued()["species_list"]
    early = obs.filter("year = 2011")
    held = table.rows(early, taxa)
    totals = held.groupBy(*table.keys).agg(F.count("*").alias("n_obs"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    old = {"species_list_totals": totals, "species_list_ids": seen_ids(held, table.keys, table.ids)}
    versions.publish(spark, store, {**old, "species_list": agg.species_counts(early, taxa)})
    incremental.fold(spark, store, obs.filter("year is null or year <> 2011"), taxa)
    want = agg.species_counts(obs, taxa)
    assert rows(versions.read_version(spark, store)["species_list"], *want.columns) == rows(want)


def test_an_empty_store_and_empty_parts(spark, tmp_path, obs, taxa):
    store = str(tmp_path / "store")
    assert versions.latest(spark, store) is None
    with pytest.raises(ValueError, match="no version"):
        versions.read_version(spark, store)
    assert incremental.fold(spark, store, obs.filter("false"), taxa, ["temporal"]) == 0
    assert versions.read_version(spark, store)["temporal"].count() == 0
    assert incremental.fold(spark, store, obs, taxa) == 1
    assert sorted(versions.read_version(spark, store)) == ["temporal", "temporal_ids", "temporal_totals"]
    with pytest.raises(ValueError, match="not"):
        incremental.fold(spark, store, obs, taxa, ["hex_density"])


def test_state_counts_each_id_once(spark):
    a = spark.createDataFrame([("x", 1), ("x", 64), (None, 5), ("y", None)], "k string, id long")
    b = spark.createDataFrame([("x", 1), ("x", -64), (None, 5), (None, 2**62)], "k string, id long")
    state = merged_ids([seen_ids(df, ["k"], {"n": "id"}) for df in (a, b, a)], ["k"])
    totals = a.unionByName(b).groupBy("k").agg(F.count("*").alias("n_rows"))
    assert rows(with_distinct(totals, state, ["k"], ["n"]), "k", "n_rows", "n") == sorted(
        [("x", 4, 3), (None, 3, 2), ("y", 1, 0)], key=repr)


def test_cells_have_different_numbers(spark):
    grid = spark.range(180).select((F.col("id") - 89.5).alias("latitude")).crossJoin(
        spark.range(720).select((F.col("id") / 2 - 179.9).alias("longitude")))
    cells = assign_cells(grid).select("h3_r3").distinct().select(cell_number("h3_r3").alias("n"))
    n, least, most, different = cells.agg(F.count("n"), F.min("n"), F.max("n"), F.count_distinct("n")).first()
    assert n == different and 0 <= least and most < 64800


def test_a_build_that_dies_leaves_the_old_version(spark, tmp_path):
    store = str(tmp_path / "store")
    old = spark.range(5).toDF("n")
    assert versions.publish(spark, store, {"a": old, "b": old}) == 0
    dying = spark.range(5).select(F.when(F.col("id") == 3, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long").alias("n"))
    with pytest.raises(Exception, match="lost"):
        versions.publish(spark, store, {"a": old.limit(1), "b": dying})
    assert versions.latest(spark, store) == 0
    held = versions.read_version(spark, store)
    assert (held["a"].count(), held["b"].count()) == (5, 5)
    # A build may read what it replaces, and who reads the old version is not disturbed.
    assert versions.publish(spark, store, {"a": held["a"].selectExpr("n + 1 as n"), "b": held["b"]}) == 1
    assert rows(versions.read_version(spark, store)["a"]) == [(i,) for i in range(1, 6)]
    assert rows(held["a"]) == [(i,) for i in range(5)]


def test_a_build_from_an_overtaken_version_is_not_published(spark, tmp_path):
    store = str(tmp_path / "store")
    one = spark.range(1).toDF("n")
    versions.publish(spark, store, {"a": one})
    slow = versions.Draft(spark, store)
    slow.add("a", one)
    versions.publish(spark, store, {"a": spark.range(9).toDF("n")})
    with pytest.raises(ValueError, match="newer version"):
        slow.publish()
    assert versions.read_version(spark, store)["a"].count() == 9
