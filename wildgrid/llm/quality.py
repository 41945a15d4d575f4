"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled documents of good quality; the unlabelled side is web
text as it comes, good and bad mixed. The share of good text in it (the class prior) is
estimated, and a linear model over measures of style minimises the non-negative unbiased
risk  prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)).

The model is fitted on bounded samples (``fit_rows`` positives and as many unlabelled
texts, picked by a hash of the id); every text is then scored where it is read, without
a shuffle.

NULL and empty texts are scored as texts of no words. Repeated rows get equal scores.
Without labels, or without documents, the model is flat and every text scores the prior.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wildgrid.llm.common import bound_batches, smallest_by_hash, training_rows, whole_text
from wildgrid.llm.linear import calibrate, descend, fit_logistic, sigmoid, with_bias

FOLDS, HELD_OUT, ACCEPT = 4, 2, 0.7
_CHARACTERS = range(0x20, 0x7F)
_STEPS = (0.01, 0.05, 0.2)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def style(text: str | None) -> np.ndarray:
    """Measures of the whole text: characters, capitals, repeats, words and lines."""
    data = (text or "").encode()
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.split()
    lines = data.split(b"\n")
    n, size = len(words), max(len(data), 1)
    letters = max(int(counts[65:91].sum() + counts[97:123].sum()), 1)
    again = sum(map(operator.eq, words, words[1:]))
    shares = np.array([
        counts[65:91].sum() / letters,
        again / max(n, 1),
        1 - len(set(words)) / max(n, 1),
        1 - len(set(lines)) / max(len(lines), 1),
        counts[48:58].sum() / size,
        counts[128:].sum() / size,
        (counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()) / size,
    ])
    characters = counts[_CHARACTERS.start : _CHARACTERS.stop]
    return np.concatenate([
        np.log1p(characters),
        np.sqrt(characters / size),
        shares,
        np.log1p(100 * shares),
        *[(shares > step).astype(float) for step in _STEPS],
        [np.log1p(again), np.log1p(n), np.log1p(len(lines)), len(data) / max(n, 1) / 10, float(n == 0)],
    ])


WIDTH = len(style(""))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled.

    ``positive`` and ``unlabelled`` are scores of texts the scorer has not seen. Above any
    threshold the unlabelled are at least prior * (share of positives above it), so the
    prior is at most the ratio of the two shares; the least ratio is taken where enough
    positives lie above the threshold for the shares to be known well.
    """
    if not len(positive) or not len(unlabelled):
        return 0.5
    at = np.quantile(positive, np.linspace(0.0, 0.9, 91))
    share_p = np.array([(positive >= t).mean() for t in at])
    share_u = np.array([(unlabelled >= t).mean() for t in at])
    slack = np.sqrt(np.log(20) / 2) * (1 / np.sqrt(len(positive)) + 1 / np.sqrt(len(unlabelled)))
    best = int(np.argmin((share_u + slack) / share_p))
    return float(np.clip(share_u[best] / share_p[best], 0.05, 0.99))


@dataclass
class QualityModel:
    mean: np.ndarray = field(default_factory=lambda: np.zeros(WIDTH))
    scale: np.ndarray = field(default_factory=lambda: np.ones(WIDTH))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(WIDTH + 1))
    prior: float = 0.5
    slope: float = 1.0
    intercept: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return with_bias((x - self.mean) / self.scale) @ self.weights

    def score(self, texts) -> np.ndarray:
        x = np.array([style(t) for t in texts]).reshape(-1, WIDTH)
        return sigmoid(self.slope * self.raw(x) + self.intercept)


def non_negative_risk(p: np.ndarray, u: np.ndarray, prior: float, pull: float = 5.0, steps: int = 600) -> np.ndarray:
    """Weights, bias last, that minimise the non-negative risk of the logistic loss.

    ``pull`` is the strength of the weight decay, counted in rows.
    """
    decay = 1e-4 + pull / max(len(p), 1)
    p, u = with_bias(p), with_bias(u)

    def gradient(w: np.ndarray) -> np.ndarray:
        sp, su = sigmoid(p @ w), sigmoid(u @ w)
        # Loss of calling a text bad: softplus(f); of calling it good: softplus(-f).
        bad_u, bad_p = -np.log1p(-su + 1e-12).mean(), -np.log1p(-sp + 1e-12).mean()
        good = prior * (p.T @ (sp - 1)) / len(p)
        rest = (u.T @ su) / len(u) - prior * (p.T @ sp) / len(p)
        # Where the estimated risk of the negatives is below zero the step goes back up.
        if bad_u - prior * bad_p < 0:
            return -rest + decay * w
        return good + rest + decay * w

    return descend(p.shape[1], gradient, steps)


def fit(positive: np.ndarray, unlabelled: np.ndarray, x: np.ndarray, labels: np.ndarray) -> QualityModel:
    """Model from style rows of trusted positives and of unlabelled texts.

    The scores are calibrated on the labelled training rows ``x`` with their ``labels``.
    """
    if not len(positive) or not len(unlabelled):
        share = float(labels.mean()) if len(labels) else 0.5
        odds = np.clip(share, 0.01, 0.99)
        return QualityModel(prior=share, intercept=float(np.log(odds / (1 - odds))))
    every = np.vstack([positive, unlabelled])
    model = QualityModel(every.mean(axis=0), every.std(axis=0) + 1e-3)
    p, u = ((part - model.mean) / model.scale for part in (positive, unlabelled))
    # A first scorer, fitted on one half and read on the other, gives the class prior.
    halves = [np.arange(len(part)) % 2 == 0 for part in (p, u)]
    learnt = np.vstack([p[halves[0]], u[halves[1]]])
    side = np.repeat([1.0, 0.0], [halves[0].sum(), halves[1].sum()])
    first = fit_logistic(learnt, side, 1e-3, 300)
    model.prior = class_prior(*(with_bias(part[~half]) @ first for part, half in zip((p, u), halves)))
    model.weights = non_negative_risk(p, u, model.prior)
    if len(labels):
        model.slope, model.intercept = calibrate(model.raw(x), labels)
    return model


def train(spark: SparkSession, documents: DataFrame, labels: DataFrame, fit_rows: int = 8000) -> QualityModel:
    """Fit on at most ``fit_rows`` labelled and ``fit_rows`` unlabelled documents."""
    bound_batches(spark)

    @F.pandas_udf("array<double>")
    def measured(texts: pd.Series) -> pd.Series:
        return pd.Series([style(t) for t in texts], dtype=object)

    def matrix(rows: pa.Table) -> np.ndarray:
        return rows.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)

    fold = ~held_out(F.col("doc_id"))
    known = training_rows(documents, labels, "quality", fold, fit_rows)
    known = known.select("label", measured("text").alias("x")).toArrow()
    ids = smallest_by_hash(documents.select("doc_id").filter("doc_id is not null"), "doc_id", fit_rows).distinct()
    texts = documents.select("doc_id", whole_text("text").alias("text"))
    web = texts.join(F.broadcast(ids), "doc_id").select(measured("text").alias("x")).toArrow()
    truth = known.column("label").to_numpy().astype(float)
    x = matrix(known)
    return fit(x[truth == 1], matrix(web), x, truth)


def score(spark: SparkSession, model: QualityModel, text: Column) -> Column:
    """Probability, by the model, that a text is of good quality."""
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(texts))

    return scored(text)


def classify(spark: SparkSession, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = train(spark, documents, labels)
    return documents.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), score(spark, model, whole_text("text")).alias("score")
    ).withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))
