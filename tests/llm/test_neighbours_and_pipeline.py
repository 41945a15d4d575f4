"""Nearest neighbours against brute force, and the pipeline stage by stage."""

import os
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wildgrid.llm import decontaminate, jaccard, neighbours, simhash
from wildgrid.llm.common import table

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


def brute(rows, k=10):
    usable = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            usable[i] = min(usable.get(i, v), v)
    out = {}
    for q in usable:
        if q % 100 == 0:
            near = sorted((float(np.sqrt(((np.array(v) - np.array(usable[q])) ** 2).sum())), i) for i, v in usable.items() if i != q)
            out[q] = near[:k]
    return out


def test_nearest(spark):
    rng = np.random.default_rng(7)
    rows = [(int(i), rng.normal(size=8).tolist()) for i in range(700)]
    rows += [(1000 + i, rows[5][1]) for i in range(40)]  # many equal vectors
    rows += [(800, None), (801, [0.0] * 8), (802, [float("nan")] + [1.0] * 7), (803, [None] + [1.0] * 7), (None, [1.0] * 8),
             (804, [float("inf")] * 8), rows[3], (900, rows[5][1])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, rank int, leaf string")
    got = defaultdict(list)
    for r in neighbours.digests(spark, df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
        assert r["rank"] == len(got[r.query_id])
    want = brute(rows)
    assert got.keys() == want.keys()
    for q, near in want.items():
        assert [i for _, i in got[q]] == [i for _, i in near]
        assert np.allclose([d for d, _ in got[q]], [d for d, _ in near])


def test_recall_and_salted_leaves(spark):
    rng = np.random.default_rng(9)
    vectors = rng.normal(size=(6, 16))[rng.integers(0, 6, 4000)] + rng.normal(size=(4000, 16)) * 0.5
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    got = neighbours.nearest(spark, df, F.col("vec_id") % 100 == 0, trees=8, search_share=0.5, search_least=0, leaf_rows=7)
    hit = total = 0
    held = vectors.astype(np.float32).astype(float)
    for r in got.groupBy("query_id").agg(F.collect_set("vec_id").alias("near")).collect():
        far = ((held - held[r.query_id]) ** 2).sum(axis=1)
        far[r.query_id] = np.inf
        hit += len(set(np.argsort(far)[:10].tolist()) & set(r.near))
        total += 10
    assert total == 400 and hit / total >= 0.9


def test_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert neighbours.digests(spark, spark.createDataFrame([], schema)).count() == 0
    assert neighbours.digests(spark, spark.createDataFrame([(0, [1.0, 2.0])], schema)).count() == 0
    two = neighbours.digests(spark, spark.createDataFrame([(0, [1.0, 2.0]), (7, [1.0, 2.0])], schema)).collect()
    assert [tuple(r) for r in two] == [(0, 1, 7, 0.0)]
    with pytest.raises(ValueError):
        neighbours.digests(spark, spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], schema))


@needs_tables
def test_pipeline(spark):
    docs = table(spark, FOLDER, "documents")
    odd = spark.createDataFrame([(90001, None, None, None, None), (90002, "", "en", "s", 0), (90002, "", "en", "s", 0)], docs.schema)
    docs = docs.unionByName(odd).withColumns({c: F.lit(k) for k, c in enumerate(("kept", "_kept", "score", "_score", "Hits", "_hits", "n_lines"))})
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = spark.createDataFrame(stage(spark, before, FOLDER).toPandas().convert_dtypes(), before.schema)
        assert docs.columns == columns
        ids, kept = {r.doc_id for r in before.collect()}, {r.doc_id for r in docs.collect()}
        assert kept <= ids
        if name == "line_dedup":
            assert docs.count() == before.count()
        if name == "near_dedup":
            stay = {r.component_id for r in simhash.digests(spark, before).collect()}
            texts = {r.doc_id: r.text for r in before.collect() if r.doc_id in stay}
            assert kept == set(jaccard_groups(texts).values())
            assert docs.count() == len(kept)
        if name == "decontaminate":
            found = decontaminate.digests(spark, before, table(spark, FOLDER, "benchmark"))
            assert kept == {r.doc_id for r in found.filter("not contaminated").collect()}
    name, last = corpus_pipeline.STAGES[-1]
    assert last(spark, docs, FOLDER).count() == docs.count()


@needs_tables
def test_pipeline_of_nothing(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        table(spark, FOLDER, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@needs_tables
def test_pipeline_run_keeps_good_rows(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert 0 < out.count() < table(spark, FOLDER, "documents").count()


def shingle_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def jaccard_groups(texts):
    """Least id of the component of every id, by comparing all pairs."""
    sets, root = {i: shingle_set(t) for i, t in texts.items()}, {i: i for i in texts}
    for i in sorted(texts):
        for j in sorted(texts):
            both = len(sets[i] & sets[j])
            if i < j and root[i] != root[j] and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    return root


def test_edited_copies_against_brute_force(spark):
    rng = np.random.default_rng(11)
    vocabulary = [f"w{k}" for k in range(400)]
    texts, passage = {}, " ".join(rng.choice(vocabulary, 30))
    for k in range(40):
        words = list(rng.choice(vocabulary, int(rng.integers(3, 160))))
        texts[100 * k] = " ".join(words)
        for c in range(1, 5):
            for at in rng.integers(0, len(words), 1 + len(words) // 60):
                words[at] = "edited"
            texts[100 * k + c] = " ".join(words)
        texts[100 * k + 9] = passage + " " + " ".join(rng.choice(vocabulary, int(rng.integers(1, 9))))
    texts |= {9001: "", 9002: None, 9003: "A  b", 9004: "a b", 9005: "a b c d e", 9006: "a b c d"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = jaccard_groups(texts)
    assert 40 < len(set(want.values())) < len(texts)
    got = {r.doc_id for r in jaccard.one_of_each(spark, df).collect()}
    assert got == set(want.values())


def test_copies_of_one_template_against_brute_force(spark, monkeypatch):
    """Most edited copies of a template are below the limit to each other; few pairs are tried."""
    rng = np.random.default_rng(12)
    texts = {}
    for template in range(2):
        words = [f"t{template}_{k}" for k in range(120 + 30 * template)]
        for c in range(150):
            copy = list(words[: len(words) - int(rng.integers(0, 8))])
            for at in rng.integers(0, len(copy), int(rng.integers(1, 9))):
                copy[at] = f"x{rng.integers(0, 500)}"
            texts[1000 * template + c] = " ".join(copy)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    tried, verified = [], jaccard._verified
    monkeypatch.setattr(jaccard, "_verified", lambda s, t, p, pairs: tried.append(pairs.count()) or verified(s, t, p, pairs))
    want = jaccard_groups(texts)
    assert 10 < len(set(want.values())) < len(texts)
    assert {r.doc_id for r in jaccard.one_of_each(spark, df).collect()} == set(want.values())
    assert len(tried) == 2 and sum(tried) < 2 * 150 * 149 / 2 / 3


@needs_tables
def test_pipeline_run_leaves_no_edited_copies(spark):
    docs = table(spark, FOLDER, "documents")
    for _, stage in corpus_pipeline.STAGES[:2]:
        docs = stage(spark, docs, FOLDER)
    left = {r.doc_id for r in corpus_pipeline.run(spark, FOLDER).collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in left}
    assert len(set(jaccard_groups(texts).values())) == len(texts) == len(left)
