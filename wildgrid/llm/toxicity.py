"""Toxicity by weak supervision.

Many voters look at a text: fixed lexicons and patterns, and lexicons and word beginnings
that training labels point to. None decides alone. A generative label model estimates, by
expectation-maximisation over the votes, how accurate each voter is; voters whose votes go
together beyond what one class behind them explains share one joint table. Its posterior labels train a linear classifier over words and word
beginnings, which scores every text.

Fitting uses a bounded sample (``fit_rows`` labelled documents outside the held-out fold,
picked by a hash of the id). Scoring runs where the texts are read, without a shuffle.

NULL and empty texts have no words and get the score of the bias. Repeated rows get equal
scores. Without labels the fixed voters alone train the classifier; without documents all
scores are the bias.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wildgrid.llm.common import bound_batches, training_rows, whole_text
from wildgrid.llm.linear import calibrate, fit_logistic, sigmoid

FOLDS, HELD_OUT, TOXIC = 5, 0, 0.5

# Seed lexicons by kind of abuse.
LEXICONS = {
    "insult": "idiot moron stupid loser clown fool imbecile dumb jerk dunce".split(),
    "contempt": "pathetic worthless disgusting trash scum garbage vermin filth".split(),
    "threat": "kill murder hurt destroy strangle".split(),
    "profanity": "damn crap bastard bullshit asshole".split(),
    "insult_de": "dummkopf trottel abschaum vollidiot schwachkopf".split(),
    "insult_fr": "imbécile crétin ordure connard débile".split(),
    "insult_es": "imbécil estúpido basura inútil gilipollas".split(),
}
# Patterns of abuse.
PATTERNS = {
    "address": re.compile(r"\byou(?:'re| are)?(?: an?| such an?)? (?:idiot|moron|loser|fool|clown)s?\b", re.I),
    "dismissal": re.compile(r"\b(?:shut up|go away|nobody likes you|get lost)\b", re.I),
}
# Voters on patterns, shouting included.
PATTERN_VOTERS = [*PATTERNS, "shouting"]
_CAPITALS = re.compile(r"\b[A-Z]{4,}\b")
_WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS = (4, 5)
MINED_VOTERS = 6
_EVERY_LIST = frozenset(w for words in LEXICONS.values() for w in words)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def signs(text: str | None) -> set[str]:
    """Distinct lower-case words, and the beginnings of longer words with a hyphen behind."""
    words = set(_WORD.findall((text or "").lower()))
    return words.union(*({w[:n] + "-" for w in words if len(w) > n} for n in BEGINNINGS))


def shouting(text: str) -> bool:
    """Whether a line has a word in capitals and two exclamation marks somewhere after it."""
    return any((first := _CAPITALS.search(line)) and "!!" in line[first.end() :] for line in text.split("\n"))


def matches(text: str | None) -> list[str]:
    """Names of the patterns found, marked so that no word can equal them."""
    found = [f"/{name}" for name, pattern in PATTERNS.items() if pattern.search(text or "")]
    return found + ["/shouting"] * shouting(text or "")


class Sample:
    """Signs and patterns of a sample of texts, held as numbers of names."""

    def __init__(self, seen: Iterable[Iterable[str]]):
        number: dict[str, int] = {}
        self.texts = [np.array([number.setdefault(w, len(number)) for w in found], np.int32) for found in seen]
        self.names = list(number)
        self.flat = np.concatenate([np.zeros(0, np.int32), *self.texts])
        self.sizes = np.array([len(t) for t in self.texts], np.int64)

    def weighed(self, weights: np.ndarray) -> np.ndarray:
        """Sum of the weights of the texts that have each name."""
        return np.bincount(self.flat, np.repeat(weights, self.sizes), len(self.names))

    def found(self, wanted: Iterable[str]) -> list[set[str]]:
        """Of each text, the names among ``wanted``."""
        wanted = set(wanted)
        asked = np.array([n in wanted for n in self.names], bool)
        return [{self.names[k] for k in ids[asked[ids]]} for ids in self.texts]

    def copy_weights(self) -> np.ndarray:
        """Weight of each text: a group of near copies counts as one text.

        Texts are taken for copies if the three least hashes of their long words agree, or
        of all their words if they have few long ones. Without this, the ordinary words of
        a text that was copied often would seem to go with its label.
        """
        hashes = np.array([zlib.crc32(n.encode()) for n in self.names], np.int64)
        word = np.array([n[-1] != "-" and n[0] != "/" for n in self.names], bool)
        long = word & np.array([len(n) >= 8 for n in self.names], bool)
        keys = []
        for ids in self.texts:
            rare = ids[long[ids]] if len(ids) else ids
            ids = rare if len(rare) >= 3 else ids[word[ids]] if len(ids) else ids
            keys.append(tuple(np.sort(hashes[ids])[:3].tolist()) if len(ids) else ())
        size = Counter(keys)
        return np.array([1.0 / size[k] if k else 1.0 for k in keys])

    def telling(self, target: np.ndarray, weights: np.ndarray, toxic_only: bool) -> list[str]:
        """Signs that go with the class beyond chance, in a sample of any size.

        A sign counts if its share of toxic texts differs from the overall share with a
        divergence that no more than one in twenty samples would show for any of the signs.
        """
        if not len(self.names):
            return []
        n, toxic = self.weighed(weights), self.weighed(weights * target)
        base = float(np.clip((target * weights).sum() / weights.sum(), 1e-4, 1 - 1e-4))
        share = np.clip(toxic / np.maximum(n, 1e-9), 1e-9, 1 - 1e-9)
        gain = n * (share * np.log(share / base) + (1 - share) * np.log((1 - share) / (1 - base)))
        chosen = gain > np.log(len(self.names) / 0.05)
        if toxic_only:
            chosen &= share > max(0.5, base)
        names = [(-gain[k], self.names[k]) for k in np.flatnonzero(chosen)]
        return [w for _, w in sorted(names) if w[0] != "/"]


@dataclass
class Voters:
    """Each voter says toxic (1), clean (-1) or nothing (0)."""

    mined: frozenset[str] = frozenset()

    def names(self) -> list[str]:
        mined = [f"mined_{kind}_{k}" for kind in ("word", "beginning") for k in range(MINED_VOTERS)]
        return [*LEXICONS, *PATTERN_VOTERS, *mined, "no_listed_word", "no_mined_sign"]

    def votes(self, found: set[str]) -> list[int]:
        out = [int(any(w in found for w in words)) for words in LEXICONS.values()]
        out += [int(f"/{name}" in found) for name in PATTERN_VOTERS]
        hit = found & self.mined
        groups = [0] * (2 * MINED_VOTERS)
        for w in hit:
            groups[zlib.crc32(w.encode()) % MINED_VOTERS + MINED_VOTERS * w.endswith("-")] = 1
        return out + groups + [0 if found & _EVERY_LIST else -1, 0 if hit else -1]


class LabelModel:
    """Generative model of the votes: class, and one table of joint votes for each clique."""

    def __init__(self, clique_size: int = 4, dependence: float = 0.15, rounds: int = 30):
        self.clique_size, self.dependence, self.rounds = clique_size, dependence, rounds

    def fit(self, votes: np.ndarray, prior: float) -> np.ndarray:
        """Posterior probability of the toxic class for each row of votes."""
        n, m = votes.shape
        if not n:
            return np.zeros(0)
        self.prior = float(np.clip(prior, 0.005, 0.995))
        self.cliques = self._dependent(votes)
        # At first every clique is trusted a little: as one vote for what it says.
        said = sum(np.sign(votes[:, list(c)].sum(axis=1)) for c in self.cliques)
        posterior = self._maximise(votes, sigmoid(np.log(self.prior / (1 - self.prior)) + 1.5 * said))
        self.accuracy = [self._accuracy(votes[:, k], posterior) for k in range(m)]
        return posterior

    @staticmethod
    def _codes(votes: np.ndarray, clique: tuple[int, ...]) -> np.ndarray:
        code = np.zeros(len(votes), np.int64)
        for k in clique:
            code = 3 * code + votes[:, k] + 1
        return code

    def _maximise(self, votes: np.ndarray, posterior: np.ndarray) -> np.ndarray:
        codes = [self._codes(votes, c) for c in self.cliques]
        for _ in range(self.rounds):
            share = np.clip((posterior.sum() + 1) / (len(posterior) + 2), 0.002, 0.998)
            odds = np.full(len(posterior), np.log(share / (1 - share)))
            for clique, code in zip(self.cliques, codes):
                cells = 3 ** len(clique)
                # Smoothing is shared by the classes, so that an unseen vote says nothing.
                common = np.bincount(code, minlength=cells) / len(code)
                toxic = np.bincount(code, posterior, cells) + common
                clean = np.bincount(code, 1 - posterior, cells) + common
                odds += (np.log(toxic / toxic.sum() + 1e-12) - np.log(clean / clean.sum() + 1e-12))[code]
            new = sigmoid(odds)
            if np.abs(new - posterior).max() < 1e-4:
                return new
            posterior = new
        return posterior

    def _dependent(self, votes: np.ndarray) -> list[tuple[int, ...]]:
        """Voters joined if they agree more than one common class explains.

        Under a single class behind all votes, the covariance of two voters is the product
        of their ties to the class; a voter's tie follows from its covariances with pairs of
        others. What the covariance has beyond this product is dependence.
        """
        m = votes.shape[1]
        together = np.cov(votes.T, bias=True).reshape(m, m) if len(votes) > 1 else np.zeros((m, m))
        spread = np.sqrt(np.maximum(np.diag(together), 1e-12))
        known = np.abs(together) > 1e-6
        tie = np.zeros(m)
        for i in range(m):
            squares = [
                together[i, j] * together[i, k] / together[j, k]
                for j, k in combinations([x for x in range(m) if x != i], 2)
                if known[i, j] and known[i, k] and known[j, k]
            ]
            tie[i] = np.sqrt(max(float(np.median(squares)), 0.0)) if squares else 0.0
        beyond = (together - np.outer(tie, tie)) / np.outer(spread, spread)
        found = [(-beyond[a, b], a, b) for a, b in combinations(range(m), 2) if beyond[a, b] > self.dependence]
        clique = {k: (k,) for k in range(m)}
        for _, a, b in sorted(found):
            if clique[a] != clique[b] and len(clique[a]) + len(clique[b]) <= self.clique_size:
                joined = tuple(sorted(clique[a] + clique[b]))
                clique.update(dict.fromkeys(joined, joined))
        return sorted(set(clique.values()))

    @staticmethod
    def _accuracy(vote: np.ndarray, posterior: np.ndarray) -> float:
        cast = vote != 0
        right = np.where(vote > 0, posterior, 1 - posterior)
        return float(right[cast].mean()) if cast.any() else 0.5


@dataclass
class ToxicityModel:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -2.0
    slope: float = 1.0
    intercept: float = 0.0

    def score(self, texts) -> np.ndarray:
        known = self.weights.keys()
        raw = np.array([self.bias + sum(self.weights[w] for w in known & signs(t)) for t in texts])
        return sigmoid(self.slope * raw + self.intercept)


def fit(seen: Iterable[Iterable[str]], labels: np.ndarray) -> ToxicityModel:
    """Model from the signs and patterns of a sample of texts and their training labels."""
    sample = Sample(seen)
    if not sample.texts:
        return ToxicityModel()
    single = sample.copy_weights()
    voters = Voters(frozenset(sample.telling(labels, single, True)))
    asked = {*voters.mined, *_EVERY_LIST, *(f"/{name}" for name in PATTERN_VOTERS)}
    votes = np.array([voters.votes(found) for found in sample.found(asked)], np.int64)
    posterior = LabelModel().fit(votes, float((labels.sum() + 1) / (len(labels) + 2)))
    chosen = sorted({*sample.telling(posterior, single, False), *(_EVERY_LIST & set(sample.names))})
    at = {w: k for k, w in enumerate(chosen)}
    x = np.zeros((len(sample.texts), len(chosen)))
    for row, found in zip(x, sample.found(chosen)):
        row[[at[w] for w in found]] = 1.0
    weights = fit_logistic(x, posterior, 1e-3, weights=single)
    model = ToxicityModel(dict(zip(chosen, weights[:-1].tolist())), float(weights[-1]))
    model.slope, model.intercept = calibrate(x @ weights[:-1] + weights[-1], labels)
    return model


def train(spark: SparkSession, documents: DataFrame, labels: DataFrame, fit_rows: int = 10000) -> ToxicityModel:
    """Fit on at most ``fit_rows`` labelled documents; only their signs reach the driver."""
    bound_batches(spark)

    @F.pandas_udf("string")
    def seen(texts: pd.Series) -> pd.Series:
        return pd.Series([" ".join([*signs(t), *matches(t)]) for t in texts], dtype=object)

    known = training_rows(documents, labels, "toxic", ~held_out(F.col("doc_id")), fit_rows)
    rows = known.select("label", seen("text").alias("seen")).toPandas()
    return fit((s.split() for s in rows["seen"]), rows["label"].to_numpy(np.float64))


def score(spark: SparkSession, model: ToxicityModel, text: Column) -> Column:
    """Probability, by the model, that a text is toxic."""
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
    ).withColumn("predicted", (F.col("score") >= TOXIC).cast("int"))
