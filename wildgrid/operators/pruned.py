"""Best inner products without meeting every pair.

The corpus is cut into blocks of near vectors. A block is summarised by its centre, its
reach (how far its farthest vector lies from the centre) and its largest vector. By the
triangle inequality no vector of a block scores higher than the centre's score plus the
reach, nor higher than the length of the largest vector. Blocks are read past the queries as
in ``similarity.best_matches``, but a query leaves those closed whose bound lies below its
``top``-th best score so far; it begins with its ``top``-th best in a sample of the corpus. What
is skipped therefore cannot be among the best, and the result is the same.

The centres are fitted on that bounded sample. They decide how much is skipped, not what is
found. Only the sample and the summaries, at most MOST_BLOCKS rows, pass through the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from wildgrid.operators import similarity
from wildgrid.session import shared_folder

FIT_ROWS = 8192  # vectors that the centres are fitted on, at most
FIT_STEPS = 6
MOST_BLOCKS = 1024
SLACK = 1e-9  # what rounding may take from a bound
SPACES = ("clip", "bio")


def _fit_centres(corpus: DataFrame, blocks: int):
    """Centres of a sample, the vectors of least hash, after a few steps of k-means; with the sample."""
    import numpy as np

    sample = corpus.orderBy(F.xxhash64("slug", "description", *SPACES)).limit(FIT_ROWS).select(*SPACES).toArrow()
    if not len(sample):
        return None, 0, None
    vectors, split = similarity.stacked(sample)
    vectors = vectors.astype("float64")
    sound = vectors[np.isfinite(vectors).all(axis=1)]
    if not len(sound):
        return np.zeros((1, vectors.shape[1])), split, sound
    centres = sound[:blocks].copy()
    for _ in range(FIT_STEPS):
        nearest = (sound @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)
        counts = np.bincount(nearest, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sound)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres, split, sound.astype("float32")


def _in_blocks(corpus: DataFrame, centres, split: int) -> DataFrame:
    """The corpus with the block of each row, its distance from the centre and its length.

    Distance and length are the means of both spaces, as the score is.
    """

    def filed(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not len(batch):
                continue
            vectors = similarity.stacked(batch)[0].astype("float64")
            block = (vectors @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)
            sizes = [
                sum(np.linalg.norm(part, axis=1) for part in (m[:, :split], m[:, split:])) / 2
                for m in (vectors - centres[block], vectors)
            ]
            arrays = [*batch.columns, pa.array(block.astype("int32")), *[pa.array(s) for s in sizes]]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "block", "reach", "length"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in corpus.schema)
    return corpus.mapInArrow(filed, f"{schema}, block int, reach double, length double")


class Bounds:
    """What a query needs to know of the blocks to leave them closed."""

    def __init__(self, centres, numbers, reach, length, sample):
        import numpy as np

        self.centres, self.sample = centres, sample
        self.reach, self.length = np.full(len(centres), np.inf), np.full(len(centres), np.inf)
        self.reach[numbers], self.length[numbers] = reach, length

    def opened_by(self, asked, block: int):
        """The queries for which a row of the block can be among the best."""
        import numpy as np

        with np.errstate(all="ignore"):
            bound = np.minimum(asked.unit @ self.centres[block] / 2 + self.reach[block], self.length[block])
            # A bound that is no number skips nothing.
            return np.flatnonzero(~(bound + SLACK * (1 + np.abs(bound)) < asked.least))


def _best(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "slug", "description")
    return found.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= top).drop("nth")


def _cut_blocks(corpus: DataFrame) -> DataFrame:
    """Packed blocks with their number ``of``; a large block is cut by a hash of its rows."""
    cuts = corpus.groupBy("block").agg(F.ceil(F.count("*") / similarity.RIGHT_BLOCK).cast("int").alias("cuts"))
    cut = F.pmod(F.xxhash64("place"), F.col("cuts")).alias("cut")

    def pack(rows):
        import pyarrow as pa

        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.select(["place", *SPACES]).schema) as stream:
            stream.write_table(rows.select(["place", *SPACES]).combine_chunks())
        return pa.table({"block": pa.array([sink.getvalue().to_pybytes()], pa.binary()), "of": rows["block"][:1]})

    cut_rows = corpus.join(cuts, "block").select("place", *SPACES, "block", cut)
    return cut_rows.groupBy("block", "cut").applyInArrow(pack, "block binary, of int").checkpoint()


def best_matches(
    queries: DataFrame, corpus: DataFrame, top: int, blocks: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Exactly the best ``top`` corpus rows per query, and the work done for each query.

    Inputs and scores are those of ``similarity.best_matches``; query ids are unique. The
    corpus is cut into ``blocks`` blocks, by default the root of its rows. The work has
    query_id, opened (rows compared) and total. The comparison runs when this is called and
    is checkpointed, as both results read it.
    """
    shared_folder(queries.sparkSession)
    corpus = corpus.checkpoint()
    n = corpus.count()
    corpus = similarity.placed(corpus, n)
    centres, split, sample = _fit_centres(corpus, blocks or max(1, min(MOST_BLOCKS, math.ceil(math.sqrt(n)))))
    queries = queries.select("query_id", *SPACES)
    if centres is None:
        none = queries.select("query_id", F.lit(0).cast("long").alias("opened"), F.lit(0).cast("long").alias("total"))
        return similarity.best_matches(queries, corpus.drop("place"), corpus, top), none
    filed = _in_blocks(corpus.select("place", *SPACES), centres, split).checkpoint()
    held = filed.groupBy("block").agg(F.max("reach").alias("reach"), F.max("length").alias("length")).orderBy("block").toArrow()
    bounds = Bounds(centres, *[held[name].to_numpy() for name in ("block", "reach", "length")], sample)
    met = similarity.compared(queries, _cut_blocks(filed), top, bounds).checkpoint()
    found = _best(similarity.named(met.filter("opened is null").drop("opened"), corpus), top)
    # A query that has met several groups of blocks has a row for each.
    work = met.filter("opened is not null").groupBy("query_id").agg(F.sum("opened").alias("opened"))
    return found, work.withColumn("total", F.lit(n).cast("long"))
