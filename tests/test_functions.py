import math
import random

from pyspark.sql import functions as F

from wildgrid.functions import numeric, text
from conftest import rows


def test_rounding_is_that_of_python(spark):
    random.seed(3)
    values = [0.7 * k / 10000 for k in range(-2000, 2000)] + [(2 * k + 1) / 20000 for k in range(-500, 500)]
    values += [random.uniform(-1e9, 1e9) for _ in range(1000)] + [k / 16 for k in range(-100, 100)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for places in (0, 1, 2, 4):
        got = df.select("x", numeric.round_to(F.col("x"), places).alias("y")).collect()
        assert [r.y for r in got] == [round(r.x, places) for r in got]


def test_vector_expressions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = df.select(
        numeric.dot(F.col("a"), F.col("b")).alias("d"), numeric.norm(F.col("a")).alias("n"), numeric.unit(F.col("a")).alias("u")
    ).collect()
    assert got[0].d == 11.0 and got[0].n == 5.0
    assert all(math.isclose(x, y) for x, y in zip(got[0].u, [0.6, 0.8]))
    assert got[1].u == [None, None]


def test_percent_of_nothing_is_zero(spark):
    df = spark.createDataFrame([(1, 0), (1, 3)], "a int, b int")
    assert rows(df.select(numeric.percent(F.col("a"), F.col("b")).alias("p"))) == [(0.0,), (33.3,)]


def test_power_bin(spark):
    df = spark.createDataFrame([(0,), (None,), (1,), (50,), (100,)], "v int")
    got = [r.b for r in df.select(numeric.power_bin(F.col("v"), F.lit(100)).alias("b")).collect()]
    assert got == [None, None, math.floor(0.01**0.4 * 5), math.floor(0.5**0.4 * 5), 5]


def test_confidence_tier_bounds(spark):
    df = spark.createDataFrame([(0.86, 0.04), (0.86, 0.03), (0.85, 0.5), (0.7, 0.5), (0.71, 0.0)], "s double, m double")
    got = [r[0] for r in df.select(numeric.confidence_tier(F.col("s"), F.col("m"))).collect()]
    assert got == ["alta", "media", "media", "baja", "media"]


def test_name_texts(spark):
    df = spark.createDataFrame([("\t Ateles BELZEBUTH \n",)], "n string")
    got = df.select(
        text.name_key(F.col("n")).alias("key"),
        text.slug(F.lit("Ateles Belzebuth X")).alias("slug"),
        text.readable(F.lit("ateles_BELZEBUTH_x")).alias("readable"),
        text.rank_path([F.lit("a"), F.lit(""), F.lit(None).cast("string"), F.lit("b")]).alias("path"),
        text.last_segment(F.lit("a/b/c")).alias("last"),
        text.month_label(F.lit(2012), F.lit(3)).alias("label"),
    ).first()
    assert tuple(got) == ("ateles belzebuth", "ateles_belzebuth_x", "Ateles belzebuth x", "a/b", "c", "2012-03")


def test_labels_become_dates(spark):
    df = spark.createDataFrame([("2012",), ("2012-03",)], "l string")
    assert [str(r[0]) for r in df.select(text.label_to_date(F.col("l"))).collect()] == ["2012-01-01", "2012-03-01"]


def test_path_parts(spark):
    df = spark.createDataFrame([("file:/a/b/c.PNG",), ("file:/z/README",), ("file:/a/x.tar.gz",)], "p string")
    got = df.select(
        text.file_extension(F.col("p")), text.parent_folder(F.col("p")), text.relative_path(F.col("p"), F.lit("file:/a/"))
    ).collect()
    assert [tuple(r) for r in got] == [
        (".png", "file:/a/b", "b/c.PNG"), ("", "file:/z", "README"), (".gz", "file:/a", "x.tar.gz"),
    ]
