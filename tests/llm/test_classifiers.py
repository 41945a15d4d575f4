"""Classifiers: held-out accuracy on the test tables, and the rows that break things."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from wildgrid.llm import language_id, quality, toxicity
from wildgrid.llm.common import table

FOLDER, LARGER = "/root/testdata/sf0.01", "/root/testdata/sf0.1"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")

ODD = [(1, None, "x", 9.0), (2, "", "x", 9.0), (None, "some words", None, None), (1, None, "x", 9.0), (4, "A!! " * 50_000, "y", 1.0)]
ODD_SCHEMA = "doc_id long, text string, held_out string, score double"


@pytest.fixture(scope="module")
def tables(spark):
    return {n: table(spark, FOLDER, n) for n in ("documents", "labels", "pages")} if os.path.isdir(FOLDER) else {}


def accuracy(scored, labels, label):
    rows = scored.filter("held_out").join(labels, "doc_id").select("predicted", label).collect()
    return np.mean([r.predicted == r[label] for r in rows])


@needs_tables
@pytest.mark.parametrize("module, label, least", [(quality, "quality", 0.98), (toxicity, "toxic", 0.95)])
def test_held_out_accuracy(spark, module, label, least):
    tables = {n: table(spark, LARGER, n) for n in ("documents", "labels")}
    scored = module.classify(spark, tables["documents"], tables["labels"])
    assert scored.columns == ["doc_id", "held_out", "score", "predicted"]
    assert scored.count() == tables["documents"].count()
    assert accuracy(scored, tables["labels"], label) >= least


@needs_tables
@pytest.mark.parametrize("module", [quality, toxicity])
def test_odd_rows(spark, tables, module):
    odd = spark.createDataFrame(ODD, ODD_SCHEMA)
    got = module.classify(spark, odd.unionByName(odd.limit(0)), tables["labels"]).collect()
    assert len(got) == len(ODD)
    assert all(0 <= r.score <= 1 and r.held_out is not None for r in got)
    ones = {r.score for r in got if r.doc_id in (1, 2)}
    assert len(ones) == 1


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_no_labels_and_no_rows(spark, module, label):
    docs = spark.createDataFrame(ODD, ODD_SCHEMA)
    labels = spark.createDataFrame([], f"doc_id long, {label} int")
    assert module.classify(spark, docs, labels).count() == len(ODD)
    assert module.classify(spark, docs.limit(0), labels).count() == 0


def test_label_model_finds_accuracies_and_dependence():
    rng = np.random.default_rng(3)
    truth = rng.random(4000) < 0.3
    right = {0: 0.9, 1: 0.8, 2: 0.7, 3: 0.6}
    votes = np.stack([np.where(rng.random(4000) < p, truth, ~truth) * 2 - 1 for p in right.values()], axis=1)
    votes = np.hstack([votes, votes[:, 3:4]])  # the worst voter, twice
    model = toxicity.LabelModel()
    posterior = model.fit(votes.astype(np.int64), 0.3)
    assert (3, 4) in model.cliques
    assert ((posterior > 0.5) == truth).mean() > 0.88
    assert model.accuracy[0] > model.accuracy[1] > model.accuracy[2]


def test_class_prior_of_a_mixture():
    rng = np.random.default_rng(4)
    positive, negative = rng.normal(2, 1, 4000), rng.normal(-2, 1, 4000)
    mixed = np.concatenate([rng.normal(2, 1, 1200), negative[:2800]])
    assert abs(quality.class_prior(positive, mixed) - 0.3) < 0.06


@needs_tables
def test_language_of_pages(spark, tables):
    got = language_id.identify(spark, tables["pages"], tables["documents"])
    rows = got.collect()
    assert len(rows) == tables["pages"].count()
    assert np.mean([r.lang == r.declared for r in rows]) > 0.95
    assert all(0 < r.confidence <= 1 for r in rows)


@needs_tables
def test_language_of_odd_pages(spark, tables):
    good = tables["pages"].limit(20)
    odd = spark.createDataFrame(
        [(901, None, None), (902, "not an address", ""), (902, "http://[bad", "<html lang=de>"), (None, "http://a.example", "<p>x</p>")],
        "page_id long, url string, html string",
    )
    pages = good.unionByName(odd).withColumn("lang", F.lit("zz")).withColumn("host", F.lit(1))
    got = language_id.identify(spark, pages, tables["documents"]).collect()
    assert len(got) == 24
    assert {r.lang for r in got} <= {"en", "de", "fr", "es"}
    assert language_id.identify(spark, pages.limit(0), tables["documents"]).count() == 0
    none = language_id.identify(spark, pages, tables["documents"].limit(0)).collect()
    assert len(none) == 24 and {r.lang for r in none} == {None}


def test_host_prior_decides_a_silent_page(spark):
    docs = spark.createDataFrame(
        [(k, "the quick brown fox jumps over the lazy dog " * 3, "en") for k in range(6)]
        + [(k + 10, "der schnelle braune fuchs springt zum faulen hund " * 3, "de") for k in range(6)],
        "doc_id long, text string, lang string",
    )
    body = {"en": "the lazy dog jumps over the fox", "de": "der faule hund springt zum fuchs"}
    pages = [(k, f"http://{lang}.example/{k}", f"<html lang={lang}><p>{body[lang]}</p>")
             for k, lang in enumerate(["en"] * 30 + ["de"] * 30)]
    pages += [(100, "http://de.example/x", ""), (101, "http://en.example/x", None)]
    got = language_id.identify(spark, spark.createDataFrame(pages, "page_id long, url string, html string"), docs)
    lang = {r.page_id: r.lang for r in got.collect()}
    assert lang[100] == "de" and lang[101] == "en" and lang[0] == "en" and lang[45] == "de"


def test_text_of_all_main_parts():
    def words(page):
        return language_id.visible_text(page).split()

    assert words("<p>x</p><article>one</article> y <ARTICLE class=a>two</ARTICLE ><p>z</p>") == ["one", "two"]
    assert words("<article>a<article>b</article>c</article>d") == ["a", "b", "c"]
    assert words("a<main>b<article>c</article>d</main>e<article>f</article>g") == ["b", "c", "d", "f"]
    assert words("<article> 1 &nbsp;</article><p>whole page</p>") == ["1", "whole", "page"]
    assert words("<p>no</p><main>not closed") == ["not", "closed"]
    assert words("</article>a<p>b") == ["a", "b"] and words(None) == []
