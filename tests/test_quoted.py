"""The split reader of quoted dumps against the reader that takes a file in one task."""

import random
import time

import pytest

from conftest import rows
from wildgrid import schemas
from wildgrid.sources import delimited, quoted

HEADER = "taxonID\ttype\tdescription\tlanguage\tsource\tlicense"


@pytest.fixture
def splits_of(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def set_size(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield set_size
    for key, value in before.items():
        spark.conf.set(key, value)


def one_task(spark, path, header=HEADER):
    names = header.split("\t")
    df = (
        spark.read.option("sep", "\t").option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
        .option("columnPruning", False).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad_line")
        .schema(", ".join(f"`{n}` string" for n in [*names, "_bad_line"])).csv(path)
    )
    return rows(df, *names)


def by_splits(spark, path, header=HEADER):
    names = header.split("\t")
    fields = schemas._schema(", ".join(f"{n} string" for n in names))
    lines, _ = delimited._parsed(spark, path, fields, "\t", True)
    return rows(lines, *names)


def field(rng, letters):
    text = "".join(rng.choices(letters, k=rng.randint(0, 12)))
    kind = rng.random()
    if kind < 0.4:
        return '"' + text.replace('"', '""') + '"'
    plain = text.replace("\n", " ").replace("\t", " ")
    # A quote that does not open the field is a plain character.
    return plain.lstrip('"') if kind < 0.9 else "5" + plain + '"'


@pytest.mark.parametrize("seed, size", [(1, 40), (2, 97), (3, 500), (4, 7), (5, 1 << 20), (6, 61)])
def test_same_rows_as_one_task(spark, tmp_path, splits_of, seed, size):
    rng = random.Random(seed)
    letters = 'ab é\n\t"' if seed % 2 else 'abcdefgh"\n'
    end = "\r\n" if seed == 3 else "\n"
    lines = [HEADER]
    for k in range(150):
        lines.append("\t".join([str(k), *[field(rng, letters) for _ in range(rng.choice([5, 5, 5, 4, 6]))]]))
        if rng.random() < 0.1:
            lines.append("")
    text = end.join(lines) + (end if seed % 2 else "")
    if seed == 3:
        text = text.replace("\r\n", "\n").replace("\n", "\r\n")
    path = tmp_path / "d" / "Description.tsv"
    path.parent.mkdir()
    path.write_bytes(text.encode())
    splits_of(size)
    got = by_splits(spark, str(path))
    assert got == one_task(spark, str(path))
    assert len(got) == 150
    parts = quoted.splits.read_lines(spark, str(path), "\n").rdd.getNumPartitions()
    assert parts > 5 or size > len(text)


def test_stray_quotes_close_like_in_one_task(spark, tmp_path, splits_of):
    odd = ['"abc"def', '"abc" x"y', '"a""b"', '""', '"""a"""', '"x"y\tz"', 'a"b"c', '"tab\there"', '" "', '"a\nb"c', '"line\n\n\nend"', '"""']
    lines = [HEADER] + [f"{k}\tt\t{v}\ten\ts\tl" for k, v in enumerate(odd[:-1])] + ["98\t" + '"' + "never closed\ten", "more"]
    path = tmp_path / "Description.tsv"
    path.write_text("\n".join(lines))
    for size in (9, 33, 10_000):
        splits_of(size)
        assert by_splits(spark, str(path)) == one_task(spark, str(path))


def test_several_files_and_a_record_over_many_splits(spark, tmp_path, splits_of):
    folder = tmp_path / "dump"
    folder.mkdir()
    long = "\n".join(f"line {k}" for k in range(400))
    (folder / "a.tsv").write_text(f'{HEADER}\n1\tt\t"{long}"\ten\ts\tl\n2\tt\tx\ten\ts\tl\n')
    (folder / "b.tsv").write_text(f"\n{HEADER}\n3\tt\tplain\ten\ts\tl")
    (folder / "c.tsv").write_text(f'{HEADER}\n4\tt\t"open\nto the end\ten')
    (folder / "d.tsv").write_text("")
    splits_of(64)
    got = by_splits(spark, str(folder))
    assert [r[0] for r in got] == ["1", "2", "3", "4"]
    assert got[0][2] == long and got[3][2].startswith("open\nto the end")


def test_fields_of_ten_megabytes(spark, tmp_path):
    huge = "x" * 10_000_000
    path = tmp_path / "Description.tsv"
    # Short and long lines, quoted and with an inch mark in unquoted fields.
    path.write_text("\n".join([
        HEADER, f'1\tbiology\t"{huge}"', f'2\tbiology\t"{huge}"\ten\ts\tl\textra', f'3\tbiology\t"{huge}\n""{huge}"\ten\ts\tl',
        '4\t5" long\t7" wide\ten\ts\tl\textra', "5\tbiology\tplain\ten\ts\tl",
    ]))
    began = time.time()
    got = {r.taxonID: len(r.description) for r in delimited.read_checklist(spark, str(tmp_path), "description").collect()}
    assert got == {1: len(huge), 3: 2 * len(huge) + 2, 5: 5}
    for multi_line in (True, False):
        bad = delimited.rejected_lines(spark, str(path), schemas.CHECKLIST_DESCRIPTION, drop="long", multi_line=multi_line)
        assert [r.reason for r in bad.collect()] == ["too many fields"] * 2
    assert time.time() - began < 120


def test_long_fields_of_plain_dumps(spark, tmp_path):
    path = tmp_path / "photos.csv"
    head = "photo_id\tphoto_uuid\tobservation_uuid\tobserver_id\textension\tlicense\twidth\theight\tposition"
    path.write_text(f'{head}\n1\t"{"y" * 100_000}"\n2\tu\to\t3\tjpg\tCC\t4\t5\t0\n3\t5"\t6"\t3\tjpg\tCC\t4\t5\t0\tmore\n')
    assert rows(delimited.read_photos(spark, str(path)), "photo_id") == [(2,)]
    bad = delimited.rejected_lines(spark, str(path), schemas.RAW_PHOTOS)
    assert sorted(r.reason for r in bad.collect()) == ["too few fields", "too many fields"]
