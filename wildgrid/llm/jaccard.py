"""Near copies by the Jaccard share of their word shingles, without misses.

A text is the set of the 64-bit hashes of its shingles of five words. Two texts are near
copies if they share at least 4/5 of the union of their sets; linked texts make a component.

All shingles are put into one order. Of two linked sets of sizes n and m, the first common
shingle stands so early in each that enough shingles follow for all they must share: at a
place i (from 0) of the first with m <= 9(n - i)/4 - n, and likewise in the other. Texts that
meet within these sizes are a candidate if they also have at least k shingles in common among
their first n - ceil(4n/5) + k and m - ceil(4m/5) + k, as linked texts must (k is COMMON, or
ceil(4n/5) of the smaller set if that is less), and more where their sizes ask for more (see
``_needed``). So only these shingles are sent.
Every candidate is verified on the whole sets. Under a crowded shingle two texts are tried with
all others first, those with most shingles that others have, as near copies of a template are
linked to its least edited copy; only texts that these links leave in different components are
paired after that. The order puts shingles last that are frequent in a sample of the texts: it
decides how many candidates there are, not which links are found.

NULL and empty texts have the empty set and are copies of each other. A text of fewer than
five words is one shingle. Equal sets are one point, which is verified once. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wildgrid.llm import simhash
from wildgrid.llm.common import BLANKS, LOWER_AZ, bound_batches, whole_text, written
from wildgrid.llm.components import components

SHINGLE = 5
SEED = 42
# Texts that are sampled for the order, about, and frequent shingles that are held at most.
SAMPLE, HELD = 4000, 100_000
# Shingles that a candidate pair must share among the first ones.
COMMON = 12
# Points of a shingle from which on two of them are tried for all first.
CROWD = 8
_BLANK_TABLE = bytes(0x20 if chr(c) in BLANKS else c for c in LOWER_AZ)


def shingles(text: str | None) -> np.ndarray:
    """The sorted hashes of the shingles of a text, each once."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().translate(_BLANK_TABLE).split()
    if not words:
        return np.zeros(0, np.int64)
    spans = [b" ".join(words[i : i + SHINGLE]) for i in range(max(len(words) - SHINGLE + 1, 1))]
    return np.unique(np.array([xxh64_intdigest(s, SEED) for s in spans], np.uint64).view(np.int64))


def near(one: np.ndarray, other: np.ndarray) -> bool:
    """Whether two sets share at least 4/5 of their union."""
    both = len(np.intersect1d(one, other, assume_unique=True))
    return 5 * both >= 4 * (len(one) + len(other) - both)


def point(hashes: np.ndarray) -> int:
    """One number for a set."""
    from xxhash import xxh64_intdigest

    return int(np.array([xxh64_intdigest(hashes.tobytes(), SEED)], np.uint64).view(np.int64)[0])


def frequent(spark: SparkSession, texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a sample have, sorted, and their counts."""
    every = max(1, texts.count() // SAMPLE)
    some = texts.filter(F.pmod(F.col("text_hash"), F.lit(every)) == 0)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_pydict({"shingle": pa.array(shingles(text), pa.int64())})

    counts = some.select("text").mapInArrow(listed, "shingle long").groupBy("shingle").count().filter("count > 2")
    rows = counts.orderBy(F.desc("count"), "shingle").limit(HELD).toPandas().sort_values("shingle")
    return rows["shingle"].to_numpy(np.int64), rows["count"].to_numpy(np.int64)


def prefix(hashes: np.ndarray, held: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the order of their counts, then hashes."""
    n = len(hashes)
    least = -(-4 * n // 5)
    rank = np.zeros(n, np.int64)
    if len(held) and n:
        at = np.minimum(np.searchsorted(held, hashes), len(held) - 1)
        rank = np.where(held[at] == hashes, counts[at], 0)
    return hashes[np.lexsort((hashes, rank))[: n - least + min(COMMON, least)]]


def signed(spark: SparkSession, texts: DataFrame) -> DataFrame:
    """(doc, text_hash, point, size, first) of every text: its set is built once."""
    held, counts = frequent(spark, texts)

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "doc": batch.column(0),
                "text_hash": batch.column(1),
                "point": pa.array([point(h) for h in sets], pa.int64()),
                "size": pa.array([len(h) for h in sets], pa.int32()),
                "first": pa.array([prefix(h, held, counts) for h in sets], pa.list_(pa.int64())),
            })

    kind = texts.schema["doc"].dataType.simpleString()
    rows = texts.select("doc", "text_hash", "text")
    return rows.mapInArrow(filed, f"doc {kind}, text_hash long, point long, size int, first array<long>")


def shared_shingles(spark: SparkSession, points: DataFrame) -> DataFrame:
    """(shingle, point, size, most, n): the first shingles that several points have, n of them.

    ``most`` is the size of the largest set that the shingle can be the first common one with.
    Points that share fewer shingles with all others together than a link needs are left out.
    """
    cells = points.select("point", "size", "first").dropDuplicates(["point"])
    cells = cells.select("point", "size", F.posexplode("first").alias("at", "shingle"))
    most = F.expr("cast((9 * (size - at)) div 4 - size as int)")
    cells = cells.select("shingle", "point", "size", most.alias("most"))
    # Counted first, so that no shingle's points are ever gathered in one row.
    often = cells.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = written(spark, cells.join(often, "shingle"), "shared-shingles")
    enough = shared.groupBy("point").agg(F.count(F.lit(1)).alias("own"), F.first("size").alias("size"))
    return written(spark, shared.join(enough.filter(f"own >= {_least('size')}"), "point", "left_semi"), "shared-enough")


def links(spark: SparkSession, texts: DataFrame, points: DataFrame) -> DataFrame:
    """(a, b): links that connect all near copies; ``points`` has the rows of ``signed`` for ``texts``.

    Not every pair is listed: within a component that is known already none is.
    """
    shared = shared_shingles(spark, points)
    found = _verified(spark, texts, points, _star_pairs(shared))
    roots = components(spark, found)
    rest = _verified(spark, texts, points, _cross_pairs(shared, roots))
    return found.unionByName(rest)


def _least(size: str) -> str:
    """Shingles that a set must share among its first ones."""
    return f"least({COMMON}, (4 * {size} + 4) div 5)"


def _needed(a: str, b: str) -> Column:
    """Shingles that linked sets of these sizes share among their first ones.

    They share 4/9 of the sum of their sizes. What they share beyond the first ones stands
    after the earlier end of the two, so the rest of the longer set bounds it.
    """
    beyond = " , ".join(f"(4 * {s} + 4) div 5 - {_least(s)}" for s in (a, b))
    return F.expr(f"greatest({_least(f'least({a}, {b})')}, (4 * ({a} + {b}) + 8) div 9 - greatest({beyond}))")


def _star_pairs(shared: DataFrame) -> DataFrame:
    """(a, b): the points of crowded shingles, each with two points that speak for the shingle.

    As many rows as points. Most of a large group of near copies is linked by these, so that
    its pairs need not be listed. Points that can share too little, as far as the sent
    shingles tell, are not tried: a guess, as pairs it misses are found among the cross pairs.
    """
    size = F.first("size")
    sent = size - F.ceil(size * 4 / 5) + F.least(F.lit(COMMON), F.ceil(size * 4 / 5))
    alone = shared.groupBy("point").agg((sent - F.count(F.lit(1))).alias("alone"))
    crowded = shared.filter(F.col("n") > CROWD).select("shingle", "point", "size")
    rows = crowded.join(alone, "point").withColumn("common", F.col("size") - F.col("alone"))
    point = F.struct((F.col("common") / F.col("size")).alias("part"), F.xxhash64("point").alias("hash"), "point", "size", "common")
    pivots = rows.groupBy("shingle").agg(F.max(point).alias("one"))
    second = rows.join(pivots, "shingle").filter("point <> one.point").groupBy("shingle").agg(F.max(point).alias("pivot"))
    pivots = pivots.select("shingle", F.col("one").alias("pivot")).unionByName(second)
    met = rows.join(pivots, "shingle").filter("point <> pivot.point")
    met = met.filter("9 * least(common, pivot.common) >= 4 * (size + pivot.size)")
    low, high = F.least("point", "pivot.point"), F.greatest("point", "pivot.point")
    least = F.expr(_least("least(size, pivot.size)"))
    counted = met.groupBy(low.alias("a"), high.alias("b"), least.alias("least")).count()
    return counted.filter("2 * count >= least").select("a", "b")


def _cross_pairs(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b): all candidates that are not in one component yet.

    First the components that meet under a shingle and whose sizes allow a link, then their points.
    """
    root = roots.select(F.col("a").alias("point"), F.col("b").alias("root"))
    rooted = shared.join(root, "point", "left").withColumn("root", F.coalesce("root", "point"))
    # Shingles that are too late for the least set under them are too late for all.
    least = rooted.groupBy("shingle").agg(F.min("size").alias("least"))
    rooted = rooted.join(least, "shingle").filter("most >= least").drop("least")
    groups = rooted.groupBy("shingle", "root").agg(F.min("size").alias("size"), F.max("most").alias("most"))
    other = groups.select(*[F.col(c).alias(f"{c}_b") for c in groups.columns])
    met = groups.join(other, F.expr("shingle = shingle_b and root < root_b and size <= most_b and size_b <= most"))
    met = met.select("shingle", "root", "root_b", F.col("size_b").alias("low"), F.col("most_b").alias("high"))
    left = rooted.select("shingle", "root", F.col("point").alias("a"), F.col("size").alias("size_a"), F.col("most").alias("most_a"))
    right = rooted.select(
        F.col("shingle").alias("under"), F.col("root").alias("root_r"), F.col("point").alias("b"),
        F.col("size").alias("size_b"), F.col("most").alias("most_b"))
    tried = met.alias("m").join(
        left.alias("l"), F.expr("m.shingle = l.shingle and m.root = l.root and low <= most_a and size_a <= high")
    ).select("m.shingle", "root_b", "a", "size_a", "most_a")
    rows = tried.join(right, F.expr("shingle = under and root_b = root_r and size_b <= most_a and size_a <= most_b"))
    pairs = rows.select("a", "b", _needed("size_a", "size_b").alias("least")).distinct()
    first = shared.groupBy("point").agg(F.collect_list("shingle").alias("first"))
    one, two = (first.select(F.col("point").alias(c), F.col("first").alias(f"first_{c}")) for c in ("a", "b"))
    pairs = pairs.join(one, "a").join(two, "b")
    return pairs.filter("size(array_intersect(first_a, first_b)) >= least").select("a", "b")


def _verified(spark: SparkSession, texts: DataFrame, points: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) that are near copies, compared on their whole sets."""
    pairs = written(spark, pairs, "candidates")
    wanted = pairs.select(F.col("a").alias("point")).union(pairs.select(F.col("b").alias("point"))).distinct()
    # One text of each point.
    wanted = points.join(wanted, "point", "left_semi").groupBy("point").agg(F.min("text_hash").alias("text_hash"))
    bodies = written(spark, texts.join(wanted, "text_hash").select("point", "text").dropDuplicates(["point"]), "bodies")

    @F.pandas_udf("boolean")
    def verified(ones: pd.Series, others: pd.Series) -> pd.Series:
        return pd.Series([near(shingles(x), shingles(y)) for x, y in zip(ones, others)], dtype=bool)

    left = bodies.select(F.col("point").alias("a"), F.col("text").alias("text_a"))
    right = bodies.select(F.col("point").alias("b"), F.col("text").alias("text_b"))
    found = pairs.join(left, "a").join(right, "b").filter(verified("text_a", "text_b")).select("a", "b")
    return written(spark, found, "near")


def near_groups(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """(doc, text_hash, component): one row per document, with the least id of its component."""
    bound_batches(spark)

    texts = documents.select(F.col("doc_id").alias("doc"), whole_text("text").alias("text"))
    texts = texts.withColumn("text_hash", F.xxhash64("text"))
    rows = written(spark, signed(spark, texts), "points")
    roots = components(spark, links(spark, texts, rows))
    rooted = rows.join(roots, rows["point"] == roots["a"], "left").select(
        "doc", "text_hash", F.coalesce("b", "point").alias("root")
    )
    rooted = written(spark, rooted, "rooted")
    ids = rooted.groupBy("root").agg(F.min("doc").alias("component"))
    return rooted.join(ids, "root").select("doc", "text_hash", "component")


def one_of_each(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """``documents`` with one row of each component, picked as ``simhash.one_of_each`` does."""
    return simhash.one_of_each(spark, documents, near_groups(spark, documents))
