"""JSON documents cut in parallel, against whole documents read by one parser."""

import json
import os
import random
import time

import pytest

from conftest import rows
from wildgrid.plans import external
from wildgrid.sources import documents, features, inventory, structure


@pytest.fixture
def splits_of(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def set_size(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield set_size
    for key, value in before.items():
        spark.conf.set(key, value)


def value(rng, deep=0):
    kind = rng.random()
    if kind < 0.3 or deep > 3:
        return "".join(rng.choices('ab{}[],:"\\é\n', k=rng.randint(0, 9)))
    if kind < 0.45:
        return rng.choice([0, -3, 2.5, True])
    if kind < 0.55:
        return None
    if kind < 0.75:
        return [value(rng, deep + 1) for _ in range(rng.randint(0, 3))]
    return {f"k{i}{rng.choice(['', '}', chr(92)])}": value(rng, deep + 1) for i in range(rng.randint(0, 3))}


@pytest.mark.parametrize("size", [40, 333, 100_000])
def test_units_are_the_parts_of_the_document(spark, tmp_path, splits_of, size):
    rng, docs = random.Random(size), {}
    for k in range(12):
        if k % 3 == 0:
            docs[k] = [value(rng) for _ in range(25)]
        elif k % 3 == 1:
            docs[k] = {f"m{i}": {"a": value(rng)} for i in range(25)}
        else:
            docs[k] = {"n": 3, "results": [value(rng) for _ in range(20)], "x": value(rng), "preview": [], "data": [value(rng)]}
        text = json.dumps(docs[k], indent=2 if k % 2 else None, ensure_ascii=False) + ("\n \n" if k % 4 == 0 else "")
        (tmp_path / f"{k}.json").write_bytes((b"\xef\xbb\xbf" if k > 8 else b"") + text.encode())
    splits_of(size)
    units, files = structure.cut_documents(spark, str(tmp_path), pathGlobFilter="*.json")
    assert sorted((os.path.basename(r.source_file), r.shape, r.valid) for r in files.collect()) == sorted(
        (f"{k}.json", "ARRAY" if isinstance(d, list) else "OBJECT", True) for k, d in docs.items())
    got = {}
    for r in units.orderBy("source_file", "nth").collect():
        got.setdefault(int(os.path.basename(r.source_file)[:-5]), []).append(r)
    for k, doc in docs.items():
        assert [r.nth for r in got[k]] == list(range(len(got[k])))
        if isinstance(doc, list):
            assert [json.loads(r.unit) for r in got[k]] == doc
            continue
        built, key = {}, None
        for r in got[k]:
            if r.begins == "member":
                (key, found), = json.loads("{" + r.unit + ("[]}" if r.ends == "L" else "}")).items()
                built[key] = found
            elif r.unit.strip():
                built[key].append(json.loads(r.unit))
        assert built == doc


SHAPES = {
    "map": '{"zeta": {"id": 0, "species": "", "name": "N1", "image_urls": ["u1"]}, "alpha": {"species": "S2", "name": "N2"}}',
    "twice": '{"a": {"name": "old"}, "b": {"name": "B", "name": "C"}, "a": {"name": "A"}}',
    "keyed": '{"results": [{"species": "R1", "id": 12}, 7], "preview": [{"name": "P1", "id": 0, "species": "PS"}], "n": [1, {}]}',
    "lists again": '{"data": [{"name": "gone"}], "items": [], "data": [{"name": "D1"}, {"name": "D2"}], "results": [{"name": "R"}]}',
    "list": '[{"name": "", "species": "L1"}, 5, null, {"name": "L2", "species": "LS"}, {"name": "x", "score": NaN}]',
    "empty": "{}", "empty list": " [ ]\n", "no list": '{"results": {"name": "z"}, "n": 1}',
    "broken": "{oops", "text": '"just text"', "cut off": '[{"name": "lost"}, {"name": ', "nothing": "", "blank": " \n",
    "not all objects": '{"a": {"species": "no"}, "b": null}', "open string": '[{"name": "a}]',
}


@pytest.mark.parametrize("size", [200, 1 << 20])
def test_files_give_the_rows_of_texts(spark, tmp_path, splits_of, size):
    for name, text in SHAPES.items():
        (tmp_path / f"{name}.json").write_text(text)
    whole = documents.read_documents(spark, str(tmp_path))
    splits_of(size)
    got, rejected = documents.read_records(spark, str(tmp_path))
    assert rows(got) == rows(documents.extract_records(whole))
    named = lambda df: sorted((os.path.basename(r.source_file)[:-5].replace("%20", " "), r.position is None) for r in df.collect())
    # A member that can't be read is listed by itself; the rest agrees.
    assert set(named(rejected)) >= set(named(documents.rejected_documents(whole)))
    species, _ = external.external_species_of(spark, str(tmp_path))
    assert species.filter("name = 'D2'").count() == 1 and species.filter("name in ('gone', 'lost', 'old')").count() == 0


def test_a_hundred_thousand_keys_in_one_text(spark):
    doc = "{" + ",".join(f'"k{i % 90_000}": {{"name": "n{i}"}}' for i in range(100_000)) + "}"
    began = time.time()
    got = documents.extract_records(spark.createDataFrame([("big", doc)], "source_file string, text string"))
    names = {r["name"] for r in got.select("name").collect()}
    assert names == {f"n{i}" for i in range(10_000, 100_000)}
    assert time.time() - began < 60


def test_a_million_keys_in_one_file(spark, tmp_path):
    with open(tmp_path / "map.json", "w") as out:
        out.write("{")
        for i in range(1_000_000):
            out.write(f'{"," if i else ""}"k{i % 999_000}":{{"name":"n{i}","family":"f"}}')
        out.write("}")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        began = time.time()
        got, rejected = documents.read_records(spark, str(tmp_path))
        row = got.selectExpr("count(*) n", "count(distinct name) names", "min(position) low", "max(position) high").first()
        assert tuple(row) == (999_000, 999_000, 1000, 999_999) and rejected.count() == 0
        assert time.time() - began < 150
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "256m")


def feature(i, n):
    ring = [[round(0.001 * k, 3), round(0.002 * k, 3)] for k in range(n)] + [[0, 0]]
    names = {"ECO_ID": i, "ECO_NAME": f'E{i} "}}]"', "BIOME_NUM": i % 14, "BIOME_NAME": "B", "REALM": "R"}
    return {"type": "Feature", "properties": names, "geometry": {"type": "MultiPolygon", "coordinates": [[ring]]}}


def test_a_collection_of_many_large_features(spark, tmp_path):
    with open(tmp_path / "all.geojson", "w") as out:
        out.write('{"type": "FeatureCollection", "name": "x", "features": [\n')
        out.write(",\n".join(json.dumps(feature(i, 3000)) for i in range(846)))
        out.write("\n], \"crs\": {}}")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        got = features.read_features(spark, str(tmp_path / "all.geojson"), one_per_line=False)
        points = got.selectExpr("eco_id", "size(parts[0][0]) as n", "eco_name").collect()
        assert sorted(r.eco_id for r in points) == list(range(846)) and {r.n for r in points} == {3001}
        assert {r.eco_name for r in points if r.eco_id == 7} == {'E7 "}]"'}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "256m")


def test_rejected_features(spark, tmp_path):
    good = json.dumps(feature(1, 3))
    files = {
        "good": '{"features": [' + good + ', 5, {"type": "Other"}, ' + good + "]}", "cut off": '{"features": [' + good + ", {",
        "other": '{"type": "FeatureCollection"}', "list": "[1]", "empty": '{"features": []}',
    }
    for name, text in files.items():
        (tmp_path / f"{name}.geojson").write_text(text)
    assert features.read_features(spark, str(tmp_path), one_per_line=False).count() == 2
    got = {(os.path.basename(r.source_file).split(".")[0].replace("%20", " "), r.position, r.reason) for r in features.rejected_features(spark, str(tmp_path)).collect()}
    assert got == {("good", 1, "not a feature"), ("good", 2, "not a feature"), ("cut off", None, "not valid JSON"),
                   ("other", None, "no list of features"), ("list", None, "no list of features")}


def test_probe_of_odd_documents(spark):
    docs = spark.createDataFrame(
        [("twice", '{"a": 1, "b": "1", "a": 2}'), ("nan", '{"x": NaN, "y": [1]}'), ("items", '[NaN, "1", 1, {"k": null}, 5, 6]'),
         ("cut", '{"a": 1'), ("empty", "{}"), ("number", "12"), ("null", None)], "source_file string, text string")
    got = {r.path: r for r in inventory.probe_json(docs).collect()}
    assert got["twice"].error is None and json.loads(got["twice"].preview) == {"b": "1", "a": 2}
    assert got["nan"].error is None and got["nan"].keys_sample == ["x", "y"]
    assert got["items"].error is None and got["items"].kind == "ARRAY"
    assert got["cut"].error and got["null"].error
    assert got["empty"].kind == "OBJECT" and got["empty"].error is None and got["number"].preview == "12"
    # Larger than one variant may be.
    big = '{"big": "' + "z" * 30_000_000 + '", "small": 1}'
    long = spark.range(1).selectExpr("'long' as source_file", "concat('{\"big\": \"', repeat('z', 30000000), '\", \"small\": 1}') as text")
    row = inventory.probe_json(long).select("kind", "keys_sample", "error").first()
    assert (row.kind, row.keys_sample, row.error) == ("OBJECT", ["big", "small"], None) and len(big) > 16 << 20
