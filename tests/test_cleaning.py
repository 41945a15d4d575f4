from pyspark.sql import functions as F

from wildgrid import schemas
from wildgrid.operators.taxonomy import match_names, match_rate
from wildgrid.plans import cleaning
from conftest import rows

RAW_TAXON = "taxon_id int, ancestry string, rank_level float, rank string, name string, active boolean"


def observations(spark, *records):
    base = ("u", 1, 1.0, 2.0, "10", 7, "research", "2012-05-06", 0.5)
    names = schemas.RAW_OBSERVATIONS.fieldNames()
    full = [tuple({**dict(zip(names, base)), **r}[n] for n in names) for r in records]
    return spark.createDataFrame(full, schemas.RAW_OBSERVATIONS)


def test_accuracy_and_coordinates_drop_rows_but_a_bad_date_does_not(spark):
    raw = observations(
        spark,
        {"observation_uuid": "null-lat", "latitude": None},
        {"observation_uuid": "null-lon", "longitude": None},
        {"observation_uuid": "null-acc", "positional_accuracy": None},
        {"observation_uuid": "text-acc", "positional_accuracy": "abc"},
        {"observation_uuid": "fraction", "positional_accuracy": "12.7"},
        {"observation_uuid": "in", "positional_accuracy": "9999"},
        {"observation_uuid": "out", "positional_accuracy": "10000"},
        {"observation_uuid": "rounds-out", "positional_accuracy": "9999.5"},
        {"observation_uuid": "bad-date", "observed_on": "2012-13-45"},
        {"observation_uuid": "no-date", "observed_on": None},
    )
    got = rows(cleaning.observations_table(raw), "observation_uuid", "positional_accuracy", "year", "month")
    assert got == [
        ("bad-date", 10, None, None), ("fraction", 13, 2012, 5), ("in", 9999, 2012, 5), ("no-date", 10, None, None),
    ]


def test_stored_observations_have_the_fixed_schema(spark):
    df = cleaning.observations_table(observations(spark, {"observed_on": None}))
    assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in schemas.OBSERVATIONS]


def test_all_grades_are_kept(spark):
    raw = observations(spark, *[{"quality_grade": g} for g in ("research", "needs_id", "casual")])
    assert cleaning.observations_table(raw).count() == 3


def test_numeric_accuracy_reaches_the_scan_as_it_is(spark):
    df = spark.createDataFrame([(1.0, 2.0, 9999), (1.0, 2.0, 10000), (1.0, 2.0, None)], "latitude double, longitude double, positional_accuracy int")
    assert rows(cleaning.located(df), "positional_accuracy") == [(9999,)]


def test_ancestry_rules(spark):
    raw = spark.createDataFrame(
        [
            (1, None, 70.0, "kingdom", "Animalia", True),
            (2, "1", 60.0, "phylum", "Arthropoda", True),
            (3, "1/2", 50.0, "class", "Insecta", False),
            (4, "1/2/3", 40.0, "order", "Diptera", True),
            (5, "1/2/3/4", 20.0, "genus", "Musca", True),
            (6, "1/2/3/4/5/x/99", 10.0, "species", "Musca domestica", True),
            (7, "1/2/3/4/8", 10.0, "species", "Other", True),
            (8, "1/2/3/4", 30.5, "family", "Muscidae", True),
            (9, "1/2/5/10", 10.0, "species", "Late", True),
            (10, "1/2", 20.0, "genus", "Second", True),
            (11, "5/ 2 ", None, None, "Blank level", True),
            (12, "11/2.0", 10.0, "species", "No ranks", True),
        ],
        RAW_TAXON,
    )
    got = {r["taxon_id"]: r for r in cleaning.enrich_taxa(raw).collect()}
    assert set(got) == {1, 2, 4, 5, 6, 7, 8, 9, 10, 11, 12}  # 3 is inactive
    assert got[1]["kingdom"] is None  # the path leaves out the taxon itself
    assert got[5]["genus"] is None and got[5]["order"] == "Diptera"
    assert got[6]["class"] is None  # inactive ancestor
    assert (got[6]["kingdom"], got[6]["genus"]) == ("Animalia", "Musca")
    assert got[7]["family"] == "Muscidae"  # level 30.5 counts as 30
    assert got[9]["genus"] == "Second"  # the later id of a rank wins
    assert (got[11]["genus"], got[11]["phylum"]) == ("Musca", "Arthropoda")
    assert [got[12][r] for r in schemas.RANKS] == [None] * 6
    assert list(got[6].asDict()) == ["taxon_id", "rank_level", "rank", "name", "ancestry", *schemas.RANKS]


def test_photos_keep_the_first_with_an_extension(spark):
    raw = spark.createDataFrame(
        [(11, "a", "jpg", "CC", 0), (12, "a", "jpg", "CC", 1), (13, "b", None, "CC", 0)],
        "photo_id int, observation_uuid string, extension string, license string, position int",
    )
    assert rows(cleaning.main_photos(raw), "photo_id", "photo_url") == [
        (11, "https://inaturalist-open-data.s3.amazonaws.com/photos/11/medium.jpg")
    ]


def test_languages_are_exact_and_descriptions_are_not(spark):
    names = spark.createDataFrame(
        [(i, "n", lang) for i, lang in enumerate(["es", "ES", "spa", "en", "EN", "eng", "Es", "fr", None])],
        "taxonID long, vernacularName string, language string",
    )
    assert rows(cleaning.vernacular_names(names), "gbif_id") == [(i,) for i in range(6)]
    texts = spark.createDataFrame(
        [(1, None, "en"), (2, "Citation", "en"), (3, "biology", "English"), (4, "biology", "fr"), (5, "MATERIALS_EXAMINED", "ENG"), (6, "x", None)],
        "taxonID long, type string, language string",
    )
    assert rows(cleaning.descriptions(texts), "gbif_id") == [(1,), (3,)]


def test_name_match(spark):
    taxa = spark.createDataFrame([(1, "Musca domestica "), (2, None), (3, "Unknown"), (4, "musca DOMESTICA")], "taxon_id int, name string")
    names = spark.createDataFrame(
        [(20, " MUSCA Domestica"), (10, "musca domestica"), (5, None), (6, "else")], "gbif_id long, canonicalName string"
    )
    link = match_names(taxa, names)
    assert rows(link) == [(1, 10), (2, 5), (3, None), (4, 10)]
    assert match_rate(link).first()["match_rate"] == 0.75
    assert dict(link.dtypes)["gbif_id"] == "bigint"


def test_accepted_names_and_renames(spark):
    raw = spark.createDataFrame([(1, "accepted"), (2, "synonym"), (3, None)], "taxonID long, taxonomicStatus string")
    assert rows(cleaning.accepted_names(raw), "gbif_id") == [(1,)]
    media = spark.createDataFrame([(1, "http://x")], "taxonID long, identifier string")
    assert cleaning.multimedia(media).columns == ["gbif_id", "photo_url"]
