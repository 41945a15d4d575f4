import json
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from wildgrid import schemas
from wildgrid.checks import queries
from wildgrid.operators import filters
from wildgrid.plans import cleaning, external
from wildgrid.sources import delimited, documents, features, inventory, tables
from conftest import rows


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


OBS_HEADER = "observation_uuid\textra\tobserver_id\tlatitude\tlongitude\tpositional_accuracy\ttaxon_id\tquality_grade\tobserved_on\tanomaly_score\n"


def test_observation_dump_skips_every_bad_line(spark, tmp_path):
    path = write(tmp_path / "observations.csv", OBS_HEADER
        + "a\tx\t1\t1.5\t2.5\t10\t7\tresearch\t2012-05-06\t0.5\n"
        + "long\tx\t1\t1.5\t2.5\t10\t7\tresearch\t2012-05-06\t0.5\tmore\n"
        + "short\tx\t1\t1.5\n"
        + "badnum\tx\tone\t1.5\t2.5\t10\t7\tresearch\t2012-05-06\t0.5\n"
        + "b\tx\t2\t\t2.5\tabc\t7\tcasual\tsoon\t\n")
    raw = delimited.read_observations(spark, path)
    assert raw.columns == schemas.RAW_OBSERVATIONS.fieldNames()
    assert rows(raw, "observation_uuid", "observer_id", "latitude", "positional_accuracy") == [
        ("a", 1, 1.5, "10"), ("b", 2, None, "abc"),
    ]


def test_checklist_dump_skips_only_long_lines(spark, tmp_path):
    write(tmp_path / "VernacularName.tsv", "taxonID\tx\tvernacularName\tlanguage\n1\t\tuno\tes\n2\t\tdos\n3\t\ttres\tes\tmore\nbad\t\tvier\ten\n")
    raw = delimited.read_checklist(spark, str(tmp_path), "vernacular")
    assert rows(raw) == [(1, "uno", "es"), (2, "dos", None), (None, "vier", "en")]


def test_dumps_to_stored_tables(spark, tmp_path):
    """Dumps through the build functions, twice: a second build replaces the first."""
    raw, out = tmp_path / "raw", str(tmp_path / "out")
    write(raw / "taxa.csv", "taxon_id\tancestry\trank_level\trank\tname\tactive\n1\t\t70\tkingdom\tAnimalia\ttrue\n2\t1\t10\tspecies\tMusca\ttrue\n3\t1\t10\tspecies\tGone\tfalse\n")
    write(raw / "photos.csv", "photo_id\tphoto_uuid\tobservation_uuid\tobserver_id\textension\tlicense\twidth\theight\tposition\n5\tp\ta\t1\tjpg\tCC\t10\t20\t0\n6\tp\ta\t1\tjpg\tCC\t10\t20\t1\n")
    write(raw / "observations.csv", OBS_HEADER + "a\tx\t1\t1.5\t2.5\t10\t2\tresearch\t2012-05-06\t0.5\n")
    write(raw / "observers.csv", "observer_id\tlogin\tname\n1\tana\tAna\n")
    write(raw / "Taxon.tsv", "taxonID\tcanonicalName\tscientificName\tkingdom\tphylum\tclass\torder\tfamily\tgenus\ttaxonRank\ttaxonomicStatus\n9\tMUSCA\tMusca L.\ta\tb\tc\td\te\tf\tspecies\taccepted\n8\tMUSCA\tMusca X.\ta\tb\tc\td\te\tf\tspecies\tsynonym\n")
    write(raw / "Distribution.tsv", "taxonID\tcountryCode\toccurrenceStatus\tthreatStatus\n9\tPE\tpresent\tLC\n")
    write(raw / "VernacularName.tsv", "taxonID\tvernacularName\tlanguage\n9\tmosca\tes\n9\tmouche\tfr\n")
    write(raw / "Description.tsv", "taxonID\ttype\tdescription\tlanguage\tsource\tlicense\n9\tbiology\ttext\ten\ts\tl\n9\tcitation\ttext\ten\ts\tl\n")
    write(raw / "Multimedia.tsv", "taxonID\tidentifier\tlicense\tcreator\n9\thttp://x\tCC\tme\n")
    for _ in range(2):
        cleaning.build_observations(spark, str(raw / "observations.csv"), f"{out}/obs.parquet")
        cleaning.build_taxa(spark, str(raw / "taxa.csv"), f"{out}/taxa_enriched.parquet")
        cleaning.build_photos(spark, str(raw / "photos.csv"), f"{out}/photos.parquet")
        cleaning.build_checklist(spark, str(raw), out)
    delimited.read_observers(spark, str(raw / "observers.csv"))
    assert sorted(tables.register_views(spark, out)) == sorted(tables.VIEWS)
    got = spark.sql("""
        select o.observation_uuid, o.year, t.name, t.kingdom, p.photo_url, b.login, v.vernacularName, d.description, x.countryCode
        from obs o join taxa_enriched t using (taxon_id) join photos p using (observation_uuid)
        join observers b on b.observer_id = o.observer_id join taxon_join j using (taxon_id)
        join gbif_vernac v using (gbif_id) join gbif_desc d using (gbif_id) join gbif_dist x using (gbif_id)""")
    assert rows(got) == [("a", 2012, "Musca", "Animalia", "https://inaturalist-open-data.s3.amazonaws.com/photos/5/medium.jpg", "ana", "mosca", "text", "PE")]
    assert [(f.name, f.dataType) for f in spark.read.parquet(f"{out}/obs.parquet").schema] == [(f.name, f.dataType) for f in schemas.OBSERVATIONS]
    assert spark.read.parquet(f"{out}/gbif_multimedia.parquet").columns == ["gbif_id", "photo_url", "license", "creator"]


def test_missing_tables_warn_and_are_skipped(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "temporal.parquet"))
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        found = tables.load_aggregates(spark, str(tmp_path), cache=True)
    assert list(found) == ["temporal"] and len(caught) == 4
    assert rows(tables.catalog_status(found)) == [("temporal", 3)]


def test_parts_and_absent_folder(spark, tmp_path):
    one = spark.createDataFrame([("a", [1.0], "x")], schemas.EMBEDDINGS)
    one.write.parquet(str(tmp_path / "p1"))
    one.drop("description").write.parquet(str(tmp_path / "p2"))
    got = tables.read_embeddings(spark, str(tmp_path / "p1"), str(tmp_path / "p2"), str(tmp_path / "none"))
    assert rows(got) == [("a", [1.0], "x"), ("a", [1.0], None)]


def test_json_records_have_null_for_nan(spark, tmp_path):
    df = spark.createDataFrame([(2, float("nan")), (1, 0.5)], "a int, b double")
    assert sorted(r[0] for r in tables.as_json(df).collect()) == ['{"a":1,"b":0.5}', '{"a":2,"b":null}']
    tables.write_json(df, str(tmp_path / "j"), ["a"])
    lines = [line for p in sorted((tmp_path / "j").glob("part*")) for line in p.read_text().splitlines()]
    assert [json.loads(line)["a"] for line in lines] == [1, 2]


def test_sorted_and_partitioned_write(spark, tmp_path):
    df = spark.createDataFrame([(y, i) for i in range(50) for y in (2012, 2011)], "year int, n int")
    tables.write_table(df, str(tmp_path / "t"), sort_by=["n"], partition_by=["year"])
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.count() == 100 and back.filter("year = 2011").count() == 50
    with pytest.raises(Exception):
        tables.write_table(df, str(tmp_path / "t"))


DOCUMENTS = {
    "map": '{"zeta": {"id": 0, "species": "", "name": "N1", "image_urls": ["u1"], "dataset_records": 0, "subrepresented": true},'
           ' "alpha": {"id": "A1", "species": "S2", "name": "N2", "family": "F", "order": "O", "image_url": "i", "image_urls": []}}',
    "keyed": '{"results": [{"species": "R1", "id": 12}, 7], "preview": [{"name": "P1", "id": 0, "species": "PS"}], "n": 3}',
    "list": '[{"name": "", "species": "L1", "image_url": ""}, 5, null, {"name": "L2", "species": "LS"}]',
    "empty": "{}",
    "broken": "{oops",
    "text": '"just text"',
    "not all objects": '{"a": {"species": "no"}, "b": null}',
}


def test_document_shapes(spark):
    docs = spark.createDataFrame(list(DOCUMENTS.items()), "source_file string, text string")
    got = documents.extract_records(docs)
    assert rows(got, "source_file", "position", "external_id", "name", "image_url") == sorted([
        ("map", 0, "zeta", "N1", "u1"), ("map", 1, "A1", "S2", "i"),
        ("keyed", 0, "PS", "P1", None), ("keyed", 1, "12", "R1", None),
        ("list", 0, "L1", "L1", None), ("list", 3, "LS", "L2", None),
    ], key=repr)
    zeta = got.filter("external_id = 'zeta'").first()
    assert zeta["dataset_records"] == 0 and zeta["subrepresented"] is True


def test_external_list_keeps_the_first_of_a_name(spark, tmp_path):
    write(tmp_path / "j" / "b" / "two.json", '[{"name": "X", "family": "second"}, {"name": "Y"}]')
    write(tmp_path / "j" / "a" / "one.json", '{"X": {"family": "first"}, "Z": {"species": "X"}, "W": {}}')
    write(tmp_path / "j" / "a" / "skip.txt", '[{"name": "T"}]')
    species = external.external_species(documents.read_documents(spark, str(tmp_path / "j")))
    assert [(f.name, f.dataType) for f in species.schema] == [(f.name, f.dataType) for f in schemas.EXTERNAL_SPECIES]
    assert rows(species, "taxon_id", "name", "family") == sorted(
        [(-1, "X", "first"), (-2, "W", None), (-3, "Y", None)], key=repr
    )
    page = external.external_page(species, "[xy]", 1, 1)
    assert rows(page, "name", "total", "pages") == [("X", 2, 2)]
    ids = spark.createDataFrame([(-3,)], "taxon_id long")
    assert rows(external.external_details(species, ids), "name") == [("Y",)]


def test_features_of_both_geometries(spark, tmp_path):
    square = [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]
    def feature(i, geometry):
        return {"type": "Feature", "properties": {"ECO_ID": i, "ECO_NAME": f"E{i}", "BIOME_NUM": i % 2, "BIOME_NAME": "B", "REALM": "R"}, "geometry": geometry}
    items = [
        feature(1, {"type": "Polygon", "coordinates": [square]}),
        feature(2, {"type": "MultiPolygon", "coordinates": [[square], [square, square]]}),
        feature(3, None),
        feature(4, {"type": "Polygon", "coordinates": []}),
        feature(-9999, {"type": "Polygon", "coordinates": [square]}),
    ]
    lines = write(tmp_path / "lines.geojson", "\n".join(json.dumps(i) for i in items))
    whole = write(tmp_path / "whole.geojson", json.dumps({"type": "FeatureCollection", "features": items}, indent=1))
    for df in (features.read_features(spark, lines), features.read_features(spark, whole, one_per_line=False)):
        sized = df.select("eco_id", F.size("parts").alias("n"))
        assert rows(sized) == sorted([(1, 1), (2, 2), (3, 0), (4, 0), (-9999, 1)], key=repr)
        assert rows(features.with_shape(features.valid_features(df)), "eco_id") == [(1,), (2,)]
        assert rows(features.region_meta(df), "eco_id") == [(1,), (2,), (3,), (4,)]
    features.write_features(features.read_features(spark, lines), str(tmp_path / "out"))
    texts = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "out")).collect()]
    shapes = {t["properties"]["eco_id"]: t["geometry"] for t in texts}
    assert set(shapes) == {1, 2, 3, 4} and shapes[3] is None and shapes[4] is None
    assert (shapes[1]["type"], len(shapes[1]["coordinates"])) == ("Polygon", 1)
    assert (shapes[2]["type"], len(shapes[2]["coordinates"])) == ("MultiPolygon", 2)
    back = features.parse_features(spark.read.text(str(tmp_path / "out")), names=features.META)
    assert rows(back.select("eco_id", F.size("parts").alias("n"))) == [(1, 1), (2, 2), (3, 0), (4, 0)]


def tree(tmp_path, spark):
    write(tmp_path / "a" / "1.jpg", "x")
    write(tmp_path / "a" / "2.PNG", "xy")
    write(tmp_path / "b" / "3.gif", "xyz")
    write(tmp_path / "b" / "t.csv", "a,b")
    write(tmp_path / "b" / "d.json", '{"k1": 1, "k2": [1, 2]}')
    write(tmp_path / "b" / "x.npy", "n")
    write(tmp_path / "b" / "bad.parquet", "not parquet")
    write(tmp_path / "b" / "README", "r")
    spark.range(7).selectExpr("id as v").coalesce(1).write.parquet(str(tmp_path / "p"))


def test_file_inventory(spark, tmp_path):
    tree(tmp_path, spark)
    df = inventory.file_inventory(spark, str(tmp_path))
    got = {r.path.split("/")[-1]: r for r in df.collect()}
    assert got["2.PNG"].kind == "images" and got["2.PNG"].extension == ".png" and got["2.PNG"].size_bytes == 2
    assert got["x.npy"].kind == "embeddings" and got["t.csv"].kind == "other_files" and got["README"].kind is None
    counts = {r.folder.rsplit("/", 1)[1]: r.n_images for r in inventory.image_counts(df).collect()}
    assert counts == {"a": 2, "b": 1}


def test_inventory_reads_no_file_bodies(spark, tmp_path):
    write(tmp_path / "a.jpg", "x")
    plan = inventory.file_inventory(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]


def test_parquet_probe(spark, tmp_path):
    tree(tmp_path, spark)
    got = {r.path.split("/")[-1][:4]: r for r in inventory.probe_parquet(inventory.file_inventory(spark, str(tmp_path))).collect()}
    assert got["bad."].error and got["bad."].schema is None
    assert json.loads(got["part"].sample) == [{"v": i} for i in range(5)] and "v: int64" in got["part"].schema


def test_json_probe(spark):
    wide = json.dumps({f"k{i}": i for i in range(25)})
    docs = spark.createDataFrame(
        [("o", wide), ("l", "[1, [2], {\"a\": 3}, 4, 5, 6]"), ("s", json.dumps("y" * 300)), ("b", "{")],
        "source_file string, text string",
    )
    got = {r.path: r for r in inventory.probe_json(docs).collect()}
    assert got["o"].keys_sample == [f"k{i}" for i in range(20)]
    assert json.loads(got["o"].preview) == {f"k{i}": i for i in range(20)}
    assert json.loads(got["l"].preview) == [1, [2], {"a": 3}, 4, 5] and got["l"].keys_sample is None
    assert got["s"].preview == "y" * 200
    assert got["b"].error and got["b"].preview is None


def test_report_and_its_manifest(spark, tmp_path):
    tree(tmp_path / "root", spark)
    inventory.write_report(inventory.inventory_report(spark, str(tmp_path / "root")), str(tmp_path / "report"))
    listed = inventory.reported_files(spark, str(tmp_path / "report"))
    assert sorted((r.kind, r.path.split("/")[-1][:4]) for r in listed.collect()) == [
        ("embeddings", "x.np"), ("jsons", "d.js"), ("parquets", "bad."), ("parquets", "part"),
    ]
    (tmp_path / "root" / "b" / "x.npy").unlink()
    present = inventory.file_inventory(spark, str(tmp_path / "root"))
    got = inventory.manifest(listed, present, f"file://{tmp_path}/root", "out")
    assert {r.dst: r.status for r in got.collect() if "part-" not in r.dst} == {
        "out/parquets/b/bad.parquet": "copied", "out/jsons/b/d.json": "copied", "out/embeddings/b/x.npy": "skipped",
    }


def test_records_as_array_or_lines(spark, tmp_path):
    array = write(tmp_path / "a.json", '[{"eco_id": 1}, {"eco_id": 2}]')
    lines = write(tmp_path / "l.json", '{"eco_id": 1}\n{"eco_id": 2}\n')
    assert rows(tables.read_records(spark, array, "eco_id int", array=True)) == [(1,), (2,)]
    assert rows(tables.read_records(spark, lines, "eco_id int")) == [(1,), (2,)]


def test_name_lookup_ignores_case(spark):
    df = spark.createDataFrame([(1, "Ant"), (2, "Bee"), (3, None)], "taxon_id int, name string")
    names = spark.createDataFrame([("ANT",), ("ant",), (None,)], "name string")
    assert rows(filters.named(df, names)) == [(1, "Ant")]


def test_manifest(spark):
    schema = "path string, kind string"
    report = spark.createDataFrame(
        [("file:/r/x/a.parquet", "parquets"), ("file:/r/b.json", "jsons"), ("file:/else/c.npy", "embeddings"), ("file:/r/i.jpg", "images")], schema
    )
    present = spark.createDataFrame([("file:/r/x/a.parquet", "parquets"), ("file:/else/c.npy", "embeddings")], schema)
    assert rows(inventory.manifest(report, present, "file:/r", "out")) == sorted([
        ("file:/r/x/a.parquet", "out/parquets/x/a.parquet", "copied", None),
        ("file:/r/b.json", "out/jsons/b.json", "skipped", "missing"),
        ("file:/else/c.npy", "out/embeddings/c.npy", "copied", None),
    ], key=repr)


def test_embedding_report(spark, tmp_path):
    vectors = [[3.0, 4.0], [0.0, 1.0], None, [6.0, 8.0]]
    spark.createDataFrame([(v,) for v in vectors], "embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "v"))
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "other"))
    write(tmp_path / "bad.parquet", "not parquet")
    norms = np.array([5.0, 1.0, 10.0])
    report = inventory.embedding_report(spark, str(tmp_path), None)
    got = {r.path.split("/")[-2]: r for r in report.collect()}
    whole = got["v"]
    assert (whole["rows"], whole["sample_count"], whole["dim"], whole["present"]) == (4, 3, 2, True)
    assert whole["norm_mean"] == pytest.approx(norms.mean()) and whole["norm_std"] == pytest.approx(norms.std())
    assert (got["other"]["rows"], got["other"]["present"], got["other"]["columns"]) == (5, False, ["id"])
    broken = got[tmp_path.name]
    assert broken["error"] and broken["rows"] is None
    assert tuple(inventory.embedding_totals(report).first()) == (3, 4)
    first = inventory.embedding_report(spark, str(tmp_path / "v"), 2).first()
    assert (first["rows"], first["sample_count"], first["norm_max"]) == (4, 2, 5.0)


def test_documents_of_one_split_are_parsed_by_all_cores(spark, monkeypatch):
    """Wherever they lie, they are dealt out before they are cut."""
    texts = [(f"f{i:03}", f'[{{"name": "n{i % 40}"}}, {{"name": "m{i}"}}]') for i in range(200)]
    one = spark.createDataFrame(texts, "source_file string, text string").coalesce(1)
    dealt, extract = [], external.extract_records
    monkeypatch.setattr(external, "extract_records", lambda df: dealt.append(df.rdd.getNumPartitions()) or extract(df))
    got = dict(rows(external.external_species(one), "taxon_id", "name"))
    assert dealt[0] >= spark.sparkContext.defaultParallelism
    assert len(got) == 240 and (got[-1], got[-2]) == ("n0", "m0")


def test_a_vector_table_of_many_parts_is_one_file(spark, tmp_path):
    """However it is stored: the same rows, statistics and first vectors."""
    rows = [(i, [float(i), 0.0]) for i in range(40)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = []
    for folder, parts in (("one", 1), ("many", 4)):
        path = str(tmp_path / folder / "embeddings.parquet")
        table.repartitionByRange(parts, "vec_id").sortWithinPartitions("vec_id").write.parquet(path)
        for sample in (None, 15):
            got.append(queries.embedding_profile(spark, str(tmp_path / folder), sample).collect())
    assert got[:2] == got[2:] and [len(g) for g in got] == [1] * 4
    whole, first = got[2][0], got[3][0]
    assert (whole.file, whole["rows"], whole.sample_count, whole.norm_max) == ("embeddings.parquet", 40, 40, 39.0)
    assert (first["rows"], first.sample_count, first.norm_max, first.norm_mean) == (40, 15, 14.0, 7.0)


def test_quotes_and_line_breaks_in_free_text(spark, tmp_path):
    write(tmp_path / "Description.tsv", "taxonID\ttype\tdescription\tlanguage\tsource\tlicense\n"
          '1\tbiology\t"He said ""hi"" there"\ten\ts\tl\n2\tbiology\t"two\nlines\tand a tab"\ten\ts\tl\n3\tbiology\tplain\ten\ts\tl\textra\n')
    got = delimited.read_checklist(spark, str(tmp_path), "description")
    assert rows(got.select("taxonID", "description")) == sorted([(1, 'He said "hi" there'), (2, "two\nlines\tand a tab")], key=repr)
    bad = delimited.rejected_lines(spark, str(tmp_path / "Description.tsv"), schemas.CHECKLIST_DESCRIPTION, drop="long", multi_line=True)
    assert [r.reason for r in bad.collect()] == ["too many fields"]


def test_long_taxon_line_is_an_error(spark, tmp_path):
    write(tmp_path / "taxa.csv", "taxon_id\tancestry\trank_level\trank\tname\tactive\n4\t1\t10\tspecies\tLong\ttrue\tx\n")
    with pytest.raises(Exception, match="too many fields"):
        delimited.read_taxa(spark, str(tmp_path / "taxa.csv")).collect()


def test_no_document_is_lost(spark):
    small = '{"name": "n%d", "family": "f"}'
    docs = spark.createDataFrame([
        ("twice", '{"a": {"name": "old"}, "b": {"name": "B", "name": "C"}, "a": {"name": "A"}}'),
        ("nan", '[{"name": "x", "score": NaN}, {"name": "y"}, 5]'),
        ("bad", "{not json"), ("text", "words"),
    ], "source_file string, text string")
    got = documents.extract_records(docs).select("source_file", "name")
    assert rows(got) == sorted([("twice", "A"), ("twice", "C"), ("nan", "x"), ("nan", "y")])
    rejected = documents.rejected_documents(docs).select("source_file", "position", "reason")
    assert rows(rejected) == sorted([("bad", None, "not valid JSON"), ("nan", 2, "not an object"), ("text", None, "neither object nor list")], key=repr)
    # Larger than one variant may be: 30 MB in one text, 140 MB in one list.
    long = spark.range(1).select(F.lit("long").alias("source_file"), F.concat(
        F.lit('[{"name": "big", "note": "'), F.repeat(F.lit("z"), F.lit(30_000_000)), F.lit('"}, {"name": "next"}]')).alias("text"))
    assert "next" in {r["name"] for r in documents.extract_records(long).select("name").collect()}
    padded = small[:-1] % 1 + ', "note": "' + "p" * 4000 + '"}, '
    many = spark.range(1).select(F.lit("many").alias("source_file"), F.concat(
        F.lit("["), F.repeat(F.lit(padded), F.lit(35_000)), F.lit(small % 2 + "]")).alias("text"))
    assert documents.extract_records(many).count() == 35_001


def test_feature_ids_and_layouts(spark, tmp_path):
    feature = '{"type": "Feature", "properties": {"ECO_ID": 480.0, "ECO_NAME": "E", "BIOME_NUM": 1.0, "BIOME_NAME": "B", "REALM": "R"}, "geometry": null}'
    write(tmp_path / "lines.json", feature + "\n\n")
    write(tmp_path / "collection.json", '{"type": "FeatureCollection", "features": [\n' + feature + "\n]}")
    one = features.read_features(spark, str(tmp_path / "lines.json"))
    whole = features.read_features(spark, str(tmp_path / "collection.json"), one_per_line=False)
    for got in (one, whole):
        assert [(r.eco_id, r.biome_num) for r in features.valid_features(got).collect()] == [(480, 1)]
    with pytest.raises(Exception, match="not one feature per line"):
        features.read_features(spark, str(tmp_path / "collection.json")).collect()
