"""Approximate nearest neighbours by a forest of random-projection trees.

Each tree halves a bounded sample (``fit_rows`` vectors, picked by a hash of the id) by
hyperplanes between random pairs, down to small leaves. Every vector of the table is routed
to one leaf in each tree. A query walks all trees with one shared priority queue: the node
nearest to the query over all trees is opened next, until the leaves opened hold
``search_share`` of the index, or ``search_least`` vectors if that is more (a small index is
searched whole). Leaves and the queries that opened them meet by a shuffle on
the leaf; a leaf of more than ``leaf_rows`` vectors is salted. The distances are then exact, in
double precision on the original vectors, and each task keeps only the nearest of each query.

Vectors that are NULL, zero, or hold NULL, NaN or infinite components take no part, nor do
rows without an id. Of rows that share an id, the one of the least vector takes part. Of
equal vectors only the k + 1 smallest ids are filed, as no others can be among the nearest
of any query. Vectors of another length than the most frequent one are refused with an
error. Without vectors the result is empty.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from wildgrid.llm.common import col, smallest_by_hash, written


@dataclass
class Tree:
    """Nodes in arrays; a child below zero is the leaf -child - 1."""

    normals: np.ndarray
    cuts: np.ndarray
    children: np.ndarray
    n_leaves: int


def direction(vectors: np.ndarray, rows: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """Normal and cut of a hyperplane: a random pair, moved a few steps to the middles of its sides.

    The steps let the plane pass between clusters. A plane that leaves almost all rows on
    one side is put at the median.
    """
    some = vectors[rng.choice(rows, min(len(rows), 512), replace=False)]
    a, b = some[0], some[1]
    for _ in range(4):
        side = some @ (a - b) > (a @ a - b @ b) / 2
        if side.all() or not side.any():
            break
        a, b = some[side].mean(axis=0), some[~side].mean(axis=0)
    size = float(np.linalg.norm(a - b))
    normal = (a - b) / size if size > 0 else np.eye(len(a))[rng.integers(len(a))]
    cut = float((a @ a - b @ b) / 2 / size) if size > 0 else 0.0
    along = vectors[rows] @ normal
    share = float((along > cut).mean())
    return normal, cut if 0.05 <= share <= 0.95 else float(np.median(along))


def grow(vectors: np.ndarray, leaf: int, rng: np.random.Generator) -> Tree:
    normals: list[np.ndarray] = []
    cuts: list[float] = []
    children: list[list[int]] = []
    leaves = 0

    def node(rows: np.ndarray) -> int:
        nonlocal leaves
        if len(rows) > leaf:
            normal, cut = direction(vectors, rows, rng)
            right = vectors[rows] @ normal > cut
            if right.any() and not right.all():
                at = len(cuts)
                normals.append(normal)
                cuts.append(cut)
                children.append([0, 0])
                children[at] = [node(rows[~right]), node(rows[right])]
                return at
        leaves += 1
        return -leaves

    node(np.arange(len(vectors)))
    width = vectors.shape[1]
    return Tree(np.array(normals).reshape(-1, width), np.array(cuts), np.array(children, np.int64).reshape(-1, 2), leaves)


class Forest:
    def __init__(self, sample: np.ndarray, trees: int, leaf: int, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.trees = [grow(sample, leaf, rng) for _ in range(trees)]

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf of every vector in every tree."""
        out = np.zeros((len(vectors), len(self.trees)), np.int32)
        for k, tree in enumerate(self.trees):
            at = np.zeros(len(vectors), np.int64) if len(tree.cuts) else np.full(len(vectors), -1)
            while (inner := np.flatnonzero(at >= 0)).size:
                here = at[inner]
                side = np.einsum("ij,ij->i", vectors[inner], tree.normals[here]) > tree.cuts[here]
                at[inner] = tree.children[here, side.astype(np.int64)]
            out[:, k] = -at - 1
        return out

    def search(self, query: np.ndarray, counts: list[np.ndarray], wanted: float) -> list[tuple[int, int]]:
        """(tree, leaf) pairs to open, nearest first, until they hold ``wanted`` vectors."""
        margins = [tree.normals @ query - tree.cuts for tree in self.trees]
        queue = [(0.0, k, 0 if len(tree.cuts) else -1) for k, tree in enumerate(self.trees)]
        opened, held = [], 0
        while queue and held < wanted:
            far, k, at = heapq.heappop(queue)
            if at < 0:
                opened.append((k, -at - 1))
                held += int(counts[k][-at - 1])
                continue
            margin = float(margins[k][at])
            left, right = self.trees[k].children[at].tolist()
            heapq.heappush(queue, (max(far, margin), k, left))
            heapq.heappush(queue, (max(far, -margin), k, right))
        return opened


def usable(vector: Column) -> Column:
    """True for vectors that are not NULL and not zero, of finite components only."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _rows(tree, leaf, salt, kind: int, ids, vectors: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "tree": pa.array(np.asarray(tree, np.int32)), "leaf": pa.array(np.asarray(leaf, np.int32)),
        "salt": pa.array(np.asarray(salt, np.int32)), "is_vector": pa.array(np.full(len(ids), kind, np.int32)),
        "id": pa.array(np.asarray(ids, np.int64)), "vector": vectors,
    })


def _nearest(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The k nearest of each query in each leaf, with all that tie with the last of them.

    The queries of a leaf come before its vectors. A leaf that comes in several batches
    gives the nearest of each.
    """
    leaf = None
    asked: list[int] = []
    held: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        place = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(4)], axis=1).astype(np.int64)
        ids, matrix = batch.column(4).to_numpy(zero_copy_only=False).astype(np.int64), _matrix(batch.column(5))
        starts = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]).any(axis=1)]))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)]):
            if leaf != (here := tuple(place[start, :3])):
                leaf, asked, held = here, [], []
            part, at = ids[start:end], matrix[start:end]
            if place[start, 3] == 0:
                asked += part.tolist()
                held += list(at)
                continue
            step = max(1, 2_000_000 // at.size)
            for first in range(0, len(asked), step):
                queries = np.array(asked[first : first + step])
                gap = at[None, :, :] - np.array(held[first : first + step])[:, None, :]
                far = np.sqrt((gap * gap).sum(axis=2))
                far[queries[:, None] == part[None, :]] = np.inf
                last = np.partition(far, k - 1, axis=1)[:, k - 1 : k] if len(part) > k else np.inf
                q, v = np.nonzero((far <= last) & np.isfinite(far))
                found.append((queries[q], part[v], far[q, v]))
        if found:
            yield pa.RecordBatch.from_pydict({
                name: pa.array(np.concatenate([f[c] for f in found]))
                for c, name in enumerate(("query_id", "vec_id", "score"))
            })


def nearest(
    spark: SparkSession,
    embeddings: DataFrame,
    is_query: Column,
    ident: str = "vec_id",
    vector: str = "embedding",
    k: int = 10,
    trees: int = 16,
    leaf: int = 32,
    fit_rows: int = 16384,
    search_share: float = 0.5,
    search_least: int = 20_000,
    leaf_rows: int = 50_000,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every query, itself excluded.

    ``is_query`` is a condition on the column ``vec_id`` of the usable vectors.
    """
    kind = embeddings.schema[vector].dataType.simpleString()
    usable_rows = embeddings.select(col(ident).cast("long").alias("vec_id"), col(vector).alias("vector"))
    usable_rows = usable_rows.filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    # One row per id; written, as sample, index and queries all start from it.
    rows = written(spark, usable_rows.groupBy("vec_id").agg(F.min("vector").alias("vector")), "vectors")
    equal = Window.partitionBy("vector").orderBy("vec_id")
    index = rows.withColumn("_n", F.row_number().over(equal)).filter(F.col("_n") <= k + 1).drop("_n")
    index = written(spark, index, "index")
    sizes = rows.groupBy(F.size("vector").alias("n")).count().limit(2).collect()
    out = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], out)
    if len(sizes) > 1:
        raise ValueError("vectors differ in length")
    ids = smallest_by_hash(index.select("vec_id"), "vec_id", fit_rows)
    sample = np.array([r.vector for r in index.join(F.broadcast(ids), "vec_id").orderBy("vec_id").collect()])
    forest = spark.sparkContext.broadcast(Forest(sample, trees, leaf))

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = forest.value.leaves(_matrix(batch.column(1)))
                n, m = found.shape
                yield pa.RecordBatch.from_pydict({
                    "id": pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), m)),
                    "tree": pa.array(np.tile(np.arange(m, dtype=np.int32), n)),
                    "leaf": pa.array(found.ravel()),
                })

    # Leaves are as many as the bounded sample allows, however many vectors they hold.
    tally = index.mapInArrow(routed, "id long, tree int, leaf int").groupBy("tree", "leaf").count().collect()
    counts = [np.zeros(t.n_leaves, np.int64) for t in forest.value.trees]
    for r in tally:
        counts[r.tree][r.leaf] = r["count"]
    wanted = max(search_share * float(counts[0].sum()), search_least)
    plan = spark.sparkContext.broadcast((counts, [-(-c // leaf_rows) for c in counts]))

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = plan.value[1]
        for batch in batches:
            if batch.num_rows:
                ids, matrix = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1))
                found = forest.value.leaves(matrix)
                for tree in range(found.shape[1]):
                    parts = np.maximum(salts[tree][found[:, tree]], 1)
                    yield _rows(np.full(len(ids), tree), found[:, tree], ids % parts, 1, ids, batch.column(1))

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, salts = plan.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False).tolist()
            for n, (ident, query) in enumerate(zip(ids, _matrix(batch.column(1)))):
                nodes = forest.value.search(query, counts, wanted)
                at = [(tree, leaf, s) for tree, leaf in nodes for s in range(int(salts[tree][leaf]))]
                if at:
                    same = batch.column(1).take(pa.array(np.full(len(at), n)))
                    yield _rows(*zip(*at), 0, [ident] * len(at), same)

    queries = rows.filter(is_query)
    place = ["tree", "leaf", "salt"]
    columns = f"tree int, leaf int, salt int, is_vector int, id long, vector {kind}"
    met = index.mapInArrow(filed, columns).unionByName(queries.mapInArrow(opened, columns))
    met = met.repartition(*place).sortWithinPartitions(*place, "is_vector")
    near = met.mapInArrow(lambda b: _nearest(b, k), "query_id long, vec_id long, score double").distinct()
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def digests(spark: SparkSession, embeddings: DataFrame) -> DataFrame:
    """The ten nearest of every vector whose id is divisible by 100."""
    return nearest(spark, embeddings, F.col("vec_id") % 100 == 0)
