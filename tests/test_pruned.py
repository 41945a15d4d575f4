import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from wildgrid.operators import pruned, similarity
from wildgrid.plans import identification as ident
from conftest import rows
from test_identification import data

CORPUS = "slug string, description string, clip array<float>, bio array<float>, copies long"
QUERIES = "query_id long, clip array<float>, bio array<float>"
FIELDS = ["query_id", "slug", "description", "copies", "score"]


def floats(matrix):
    return np.asarray(matrix, dtype="float32").tolist()


def clustered(spark, n=2000, clusters=25, d=8, n_query=40, seed=3, hot=0.0):
    """Vectors around centres; a share ``hot`` of them around the first one. Some are equal."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, 2 * d))
    of = np.where(rng.random(n) < hot, 0, rng.integers(0, clusters, n))
    vectors = centres[of] + rng.normal(scale=0.05, size=(n, 2 * d))
    vectors[1::50] = vectors[0]  # ties
    clip, bio = floats(vectors[:, :d]), floats(vectors[:, d:])
    corpus = spark.createDataFrame([(f"s{i}", f"d{i % 7}", clip[i], bio[i], 1 + i % 3) for i in range(n)], CORPUS)
    asked = centres[rng.integers(0, clusters, n_query)] + rng.normal(scale=0.05, size=(n_query, 2 * d))
    asked[0] = vectors[0]
    clip, bio = floats(asked[:, :d]), floats(asked[:, d:])
    return spark.createDataFrame([(i, clip[i], bio[i]) for i in range(n_query)], QUERIES), corpus


def whole(queries, corpus, top):
    found = similarity.best_matches(queries, corpus, corpus, top)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "slug", "description")
    return found.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= top)


@pytest.mark.parametrize("block, chunk, hot", [(8192, 256, 0.0), (64, 7, 0.4)])
def test_equals_the_whole_comparison_and_skips_most_of_it(spark, monkeypatch, block, chunk, hot):
    queries, corpus = clustered(spark, hot=hot)
    want = rows(whole(queries, corpus, 10), *FIELDS)
    monkeypatch.setattr(similarity, "RIGHT_BLOCK", block)
    monkeypatch.setattr(similarity, "LEFT_BLOCK", 9 if block < 100 else block)
    monkeypatch.setattr(similarity, "CHUNK", chunk)
    found, work = pruned.best_matches(queries, corpus, 10)
    assert rows(found, *FIELDS) == want
    opened, total = work.agg(F.sum("opened"), F.sum("total")).first()
    assert total == 40 * 2000 and opened < total / (2 if hot else 4)


def test_vectors_without_structure_are_all_found(spark):
    """Nothing can be skipped, and nothing is lost."""
    rng = np.random.default_rng(5)
    a, b = floats(rng.normal(size=(300, 12))), floats(rng.normal(size=(300, 12)))
    corpus = spark.createDataFrame([(f"s{i}", None if i % 5 else "d", a[i], b[i], 1) for i in range(300)], CORPUS)
    queries = spark.createDataFrame([(i, b[i], a[i]) for i in range(20)], QUERIES)
    found, _ = pruned.best_matches(queries, corpus, 7, blocks=40)
    assert rows(found, *FIELDS) == rows(whole(queries, corpus, 7), *FIELDS)


def test_fewer_rows_than_wanted(spark):
    queries, corpus = clustered(spark, n=12, clusters=3, n_query=5)
    found, work = pruned.best_matches(queries, corpus, 30)
    assert rows(found, *FIELDS) == rows(whole(queries, corpus, 30), *FIELDS)
    assert {(r.opened, r.total) for r in work.collect()} == {(12, 12)}


def test_queries_without_direction_and_empty_sides(spark):
    queries, corpus = clustered(spark, n=50, clusters=3, n_query=3)
    flat = queries.withColumn("bio", F.when(F.col("query_id") == 1, F.array_repeat(F.lit(0.0).cast("float"), 8)).otherwise(F.col("bio")))
    found, work = pruned.best_matches(flat, corpus, 5)
    assert {r.query_id for r in found.collect()} == {0, 2}
    assert dict(rows(work, "query_id", "opened"))[1] == 0
    found, work = pruned.best_matches(queries, corpus.filter("false"), 5)
    assert found.count() == 0 and {r.opened for r in work.collect()} == {0}
    assert pruned.best_matches(queries.filter("false"), corpus, 5)[0].count() == 0


def test_a_vector_that_is_no_number_hides_no_other(spark):
    """Its block has no bound, so it is always opened."""
    queries, corpus = clustered(spark, n=400, clusters=8, n_query=6)
    odd = spark.createDataFrame([("odd", "x", [float("nan")] * 8, [1.0] * 8, 1)], CORPUS)
    found, _ = pruned.best_matches(queries, corpus.unionByName(odd), 10)
    others = rows(found.filter("slug <> 'odd'"), *FIELDS)
    assert set(others) <= set(rows(whole(queries, corpus, 10), *FIELDS))
    assert len(others) >= 9 * 6


def test_first_stage_is_the_same_with_and_without_pruning(spark):
    frames, _ = data(spark)
    plain = ident.identify(*frames.values(), top_m=15, only="stage1")["stage1"]
    fast = ident.identify(*frames.values(), top_m=15, only="stage1", prune=True)["stage1"]
    assert rows(fast) == rows(plain)
