"""Language identification of web pages by Bayesian fusion of evidence.

Four kinds of evidence speak about the language of a page:

- its text, by the likelihood of its character pairs and triples under a model of each
  language, fitted on labelled documents;
- the language its markup declares;
- the suffix of its address;
- its host, by a prior smoothed over a hierarchy: the pages of the host, of its domain, and
  all pages, each level drawn towards the next wider one.

How far a declaration or a suffix can be trusted is not assumed but counted: grouped
aggregates of what the texts say estimate P(declared | language) and P(suffix | language).
A page never votes in its own host prior.

Aggregates are combined before each shuffle, so a host with a third of all pages costs no
more than another. The text model is fitted on at most ``fit_rows`` documents of each
language, picked by a hash of the id.

A NULL or empty page has no text evidence, a NULL address no host and no suffix; such a page
falls back on the other evidence and on the prior of all pages. Repeated rows count as
pages of their own and get equal answers. Without documents there is no language to choose,
and lang is NULL. Without pages the result is empty.
"""

from __future__ import annotations

import html
import re
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from wildgrid.llm.common import bound_batches, col, whole_text, written

BUCKETS = 1 << 14
# Shares in which the sample of a language is picked.
SHARES = 256
# Character evidence beyond so many grams adds nothing: neighbouring grams repeat each other.
FULL_EVIDENCE = 60.0

_OPENER = re.compile(r"<!--|<(script|style|nav)\b", re.I)
_CLOSER = {"": re.compile("-->")} | {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "nav")}
_TAG = re.compile(r"<[^>]*>")
_HTML = re.compile(r"<html\b", re.I)
_LANG = re.compile(r"\blang\s*=\s*[\"']?([A-Za-z]{2,3})", re.I)
_MAIN = re.compile(r"<(/?)(article|main)(?=[\s/>])[^>]*>", re.I)


def main_parts(shown: str) -> list[str]:
    """The outermost article and main elements; one that is not closed goes on to the end."""
    parts, name, start, depth = [], "", 0, 0
    for tag in _MAIN.finditer(shown, 0, shown.rfind(">") + 1):
        closes, own = bool(tag.group(1)), tag.group(2).lower()
        if not depth:
            if not closes:
                name, start, depth = own, tag.start(), 1
        elif own == name:
            depth += -1 if closes else 1
            if not depth:
                parts.append(shown[start : tag.end()])
    return parts + [shown[start:]] * (depth > 0)


def without_hidden(page: str) -> str:
    """The page without comments, scripts, styles and menus that are closed, in one scan."""
    parts, at, never_closed = [], 0, set()
    for opener in _OPENER.finditer(page):
        kind = (opener.group(1) or "").lower()
        if opener.start() < at or kind in never_closed:
            continue
        closer = _CLOSER[kind].search(page, opener.end())
        if closer:
            parts.append(page[at : opener.start()])
            at = closer.end()
        else:
            never_closed.add(kind)
    return " ".join([*parts, page[at:]])


def without_tags(shown: str) -> str:
    # No tag ends behind the last >, so none is looked for there.
    end = shown.rfind(">") + 1
    return _TAG.sub(" ", shown[:end]) + shown[end:]


def visible_text(page: str | None) -> str:
    """Text of the main parts, or of the whole page if they hold no words."""
    shown = without_hidden(page or "")
    main = html.unescape(without_tags(" ".join(main_parts(shown))))
    return main if any(map(str.isalpha, main)) else html.unescape(without_tags(shown))


def declared_language(page: str | None) -> str | None:
    """The language that the first html tag with one declares."""
    page, at = page or "", 0
    while opener := _HTML.search(page, at):
        end = page.find(">", opener.end())
        end = len(page) if end < 0 else end
        if found := _LANG.search(page, opener.end(), end):
            return found.group(1).lower()
        at = end
    return None


def address_parts(url: str | None) -> tuple[str | None, str | None, str | None]:
    """Host, domain (last two labels) and suffix (last label) of an address."""
    try:
        host = urlsplit((url or "").strip()).hostname
    except ValueError:
        host = None
    if not host:
        return None, None, None
    labels = host.rstrip(".").split(".")
    return host, ".".join(labels[-2:]), labels[-1]


def gram_counts(text: str | None) -> np.ndarray:
    """Counts of hashed pairs and triples of the characters of a text."""
    codes = np.frombuffer(" ".join((text or "").lower().split()).encode("utf-32-le"), np.uint32).astype(np.uint64)
    pairs = codes[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[1:]
    triples = pairs[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + codes[2:] if len(codes) > 2 else pairs[:0]
    grams = np.concatenate([pairs, triples])
    mixed = (grams ^ (grams >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.bincount((mixed >> np.uint64(40)).astype(np.int64) % BUCKETS, minlength=BUCKETS)


class TextModel:
    """Smoothed gram distribution of each language."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        common = counts.sum(axis=0) + 1.0
        # Drawn towards the mixture of all languages, so that a rare gram says little.
        drawn = counts + 50.0 * common / common.sum()
        self.weights = np.log(drawn / drawn.sum(axis=1, keepdims=True))

    def evidence(self, text: str | None) -> np.ndarray:
        """Log likelihood of each language, at most that of FULL_EVIDENCE grams."""
        grams = gram_counts(text)
        n = int(grams.sum())
        if not n:
            return np.zeros(len(self.languages))
        found = self.weights @ grams / n * min(n, FULL_EVIDENCE)
        return found - found.max()


def train(spark: SparkSession, documents: DataFrame, fit_rows: int = 500) -> TextModel:
    """Gram counts of at most ``fit_rows`` documents of each language."""
    bound_batches(spark)
    named = documents.select("doc_id", F.lower("lang").alias("lang")).filter("doc_id is not null and lang is not null")
    ids = named.withColumn("hash", F.xxhash64(F.col("doc_id").cast("string")))
    # The least hashes of each share of a language, then of sixteen shares, then of the
    # language: no task sees all documents of a language.
    ids = ids.withColumn("share", F.pmod("hash", F.lit(SHARES))).withColumn("wider", F.pmod("share", F.lit(16)))
    for group in (["lang", "share"], ["lang", "wider"], ["lang"]):
        order = Window.partitionBy(*group).orderBy("hash", "doc_id")
        ids = ids.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= fit_rows).drop("n")
    ids = ids.select("doc_id", "lang").distinct()

    def counted(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = sum((gram_counts(t) for t in rows["text"]), np.zeros(BUCKETS, np.int64))
        return pd.DataFrame({"lang": [key[0]], "counts": [total.astype(float)]})

    # A language has few rows here, so a group fits a task.
    texts = documents.select("doc_id", whole_text("text").alias("text")).join(F.broadcast(ids), "doc_id")
    rows = texts.select("lang", "text").groupBy("lang").applyInPandas(counted, "lang string, counts array<double>")
    found = {r.lang: np.array(r.counts) for r in rows.collect()}
    return TextModel(sorted(found), np.array([found[k] for k in sorted(found)]).reshape(len(found), BUCKETS))


def _summed(array: str, size: int) -> Column:
    return F.array(*[F.sum(F.get(col(array), F.lit(i))) for i in range(size)])


def _exp_share(logs: Column) -> Column:
    """Probabilities from log weights."""
    most = F.array_max(logs)
    raised = F.transform(logs, lambda x: F.exp(x - most))
    total = F.aggregate(raised, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raised, lambda x: x / total)


def identify(
    spark: SparkSession,
    pages: DataFrame,
    documents: DataFrame,
    host_pull: float = 20.0,
    domain_pull: float = 50.0,
    fit_rows: int = 500,
) -> DataFrame:
    """page_id, lang, confidence, text_lang, declared, host and the share of each language.

    ``host_pull`` and ``domain_pull`` are the numbers of pages that the next wider level
    counts for in a host's and a domain's prior.
    """
    bound_batches(spark)
    model = train(spark, documents, fit_rows)
    languages, size = model.languages, len(model.languages)
    empty = "page_id", "lang", "confidence", "text_lang", "declared", "host"
    if not size:
        none = [F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("confidence"),
                F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("declared"),
                F.lit(None).cast("string").alias("host")]
        return pages.select("page_id", *none).select(*empty)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("text_log array<double>, declared string, host string, domain string, suffix string")
    def seen(urls: pd.Series, bodies: pd.Series) -> pd.DataFrame:
        rows = []
        for url, body in zip(urls, bodies):
            rows.append((shared.value.evidence(visible_text(body)), declared_language(body), *address_parts(url)))
        return pd.DataFrame(rows, columns=["text_log", "declared", "host", "domain", "suffix"])

    read = pages.select(F.col("page_id"), seen(F.col("url").cast("string"), whole_text("html")).alias("s"))
    read = written(spark, read.select("page_id", "s.*").withColumn("q", _exp_share(F.col("text_log"))), "evidence")

    def likelihood(name: str) -> DataFrame:
        """log P(value | language) by value, counted over what the texts say, smoothed."""
        counts = read.filter(col(name).isNotNull()).groupBy(name).agg(_summed("q", size).alias("n"))
        # One row: the pages with a value, by language.
        row = counts.agg(_summed("n", size).alias("total"), F.count(F.lit(1)).alias("values")).first()
        total = F.array(*[F.lit(t or 0.0) for t in row.total])
        return counts.select(
            F.col(name).alias(f"_{name}"),
            F.zip_with("n", total, lambda n, t: F.log((n + 0.5) / (t + 0.5 * row["values"]))).alias(f"{name}_log"),
        )

    def pulled(counts: Column, wider: Column, pull: float) -> Column:
        total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(counts, wider, lambda n, p: (n + pull * p) / (total + pull))

    hosts = read.filter("host is not null").groupBy("host", "domain").agg(_summed("q", size).alias("host_n"))
    domains = hosts.groupBy("domain").agg(_summed("host_n", size).alias("domain_n"))
    every = read.agg(_summed("q", size).alias("n"), F.count(F.lit(1)).alias("pages")).first()
    all_p = F.array(*[F.lit(((n or 0.0) + 1.0) / (every.pages + size)) for n in every.n])
    priors = written(
        spark,
        hosts.join(domains, "domain").select(F.col("host").alias("_host"), "host_n", "domain_n"),
        "host_counts",
    )
    joined = (
        read.join(priors, F.col("host") == F.col("_host"), "left")
        .join(likelihood("declared"), F.col("declared") == F.col("_declared"), "left")
        .join(likelihood("suffix"), F.col("suffix") == F.col("_suffix"), "left")
    )
    nothing = F.array(*[F.lit(0.0)] * size)
    # A page's own vote is taken out of the counts of its host and domain.
    without = {
        name: F.transform(
            F.zip_with(F.coalesce(name, nothing), F.when(F.col(name).isNull(), nothing).otherwise(F.col("q")),
                       lambda n, own: n - own),
            lambda x: F.greatest(x, F.lit(0.0)),
        )
        for name in ("host_n", "domain_n")
    }
    joined = joined.withColumn("domain_p", pulled(without["domain_n"], all_p, domain_pull))
    joined = joined.withColumn("host_p", pulled(without["host_n"], F.col("domain_p"), host_pull))
    logs = F.transform("host_p", lambda p: F.log(p))
    for evidence in ("text_log", "declared_log", "suffix_log"):
        logs = F.zip_with(logs, F.coalesce(evidence, nothing), lambda a, b: a + b)
    joined = joined.withColumn("posterior", _exp_share(logs))
    names = F.array(*[F.lit(name) for name in languages])

    def best(shares: str) -> Column:
        return F.get(names, (F.array_position(shares, F.array_max(shares)) - 1).cast("int"))

    said = F.array_max("text_log") > F.array_min("text_log")
    return joined.select(
        "page_id",
        best("posterior").alias("lang"),
        F.array_max("posterior").alias("confidence"),
        F.when(said, best("q")).alias("text_lang"),
        "declared",
        "host",
    )
