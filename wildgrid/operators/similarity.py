"""Blocked vector comparison.

Every left row meets every right row of its group, in blocks of bounded size. In the search
for best matches a task holds one block of queries, and the blocks of the corpus are read past
it one by one: both sides are written once, and only the wanted scores leave the task. Blocks
hold at most RIGHT_BLOCK rows, or about LEFT_BLOCK queries; the queries are cut finer where
that gives every core as many blocks as the others.

In the comparison by groups both sides are cut into blocks by a hash of the row, after equal
rows have been merged, so no key, however frequent, makes a block large, and a lost task
gives the same blocks again. Each pair of blocks is one run of matrix products in a task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from wildgrid.session import shared_folder

LEFT_BLOCK = 8192
RIGHT_BLOCK = 8192
LEAST_BLOCK = 256  # left rows below which a finer cut costs more than it gains
CHUNK = 256  # left rows compared at once inside a block
SCORE_PLACES = 10


def _block_count(rows: DataFrame, block: int) -> Column:
    return rows.agg(F.greatest(F.ceil(F.count("*") / F.lit(block)), F.lit(1)).cast("int")).scalar()


def _block_of(columns: list[str], blocks: Column) -> Column:
    return F.pmod(F.xxhash64(*columns), blocks).cast("int")


def _all_blocks(blocks: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), blocks - 1))


def packed(rows: DataFrame, size: int) -> DataFrame:
    """The rows of each partition in blocks of at most ``size``, each an Arrow stream in one value.

    The blocks are checkpointed; ``nth`` numbers them.
    """

    def pack(batches):
        import pyarrow as pa

        def one(parts):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, parts[0].schema) as stream:
                stream.write_table(pa.Table.from_batches(parts).combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block"])

        held, n = [], 0
        for batch in batches:
            while len(batch):
                held.append(batch.slice(0, size - n))
                batch, n = batch.slice(size - n), n + len(held[-1])
                if n == size:
                    yield one(held)
                    held, n = [], 0
        if n:
            yield one(held)

    return rows.mapInArrow(pack, "block binary").checkpoint().withColumn("nth", F.monotonically_increasing_id())


def placed(corpus: DataFrame, n_rows: int) -> DataFrame:
    """The corpus with ``place``, the order of its rows by slug and description; checkpointed."""
    order = ["slug", "description", F.xxhash64("clip", "bio")]
    return (
        corpus.repartitionByRange(max(1, math.ceil(n_rows / RIGHT_BLOCK)), *order)
        .sortWithinPartitions(*order)
        .withColumn("place", F.monotonically_increasing_id())
        .checkpoint()
    )


def stacked(table):
    """Both vectors of each row side by side, as they are stored, and the length of the first."""
    import numpy as np

    def matrix(name):
        column = table[name]
        vectors = column.combine_chunks() if hasattr(column, "combine_chunks") else column
        return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)

    parts = [matrix(name) for name in ("clip", "bio")]
    return np.concatenate(parts, axis=1), parts[0].shape[1]


class _Asked:
    """The queries of a block and the best ``top`` rows that they have met so far.

    A block of the corpus is first compared in single precision. What rounding may take is
    bounded, so no pair that could be among the best is lost; only the pairs left are
    compared in double precision.
    """

    def __init__(self, table, top: int, chunk: int, bounds):
        import numpy as np

        vectors, split = stacked(table)
        vectors = vectors.astype("float64")
        lengths = [np.linalg.norm(part, axis=1) for part in (vectors[:, :split], vectors[:, split:])]
        self.directed = np.flatnonzero((lengths[0] > 0) & (lengths[1] > 0))
        self.ids, self.top, self.chunk, self.split, self.bounds = table["query_id"], top, chunk, split, bounds
        vectors = vectors[self.directed]
        vectors[:, :split] /= lengths[0][self.directed, None]
        vectors[:, split:] /= lengths[1][self.directed, None]
        self.unit, self.short = vectors, (vectors / 2).astype("float32")
        n = len(self.directed)
        # What a score has to reach, and the rows compared with each query.
        self.least, self.opened = np.full(n, -np.inf), np.zeros(n, dtype="int64")
        self.row, self.place, self.scores = np.zeros(0, dtype="int64"), np.zeros(0, dtype="int64"), np.zeros((3, 0))
        self.pending, self.waiting = [], 0
        if bounds is not None:
            self._start(bounds.sample)

    def _start(self, sample) -> None:
        """The ``top``-th best of a sample of the corpus is reached in the whole corpus as well."""
        import numpy as np

        if len(sample) < self.top:
            return
        slack = _slack(sample, self.split)
        for start in range(0, len(self.unit), self.chunk):
            scores = self.short[start : start + self.chunk] @ sample.T.astype("float32")
            self.least[start : start + self.chunk] = np.partition(scores, -self.top, axis=1)[:, -self.top] - slack

    def meet(self, table, block: int | None) -> None:
        import numpy as np

        vectors, _ = stacked(table)
        rows = None if self.bounds is None else self.bounds.opened_by(self, block)
        if not len(vectors) or (rows is not None and not len(rows)):
            return
        rows = np.arange(len(self.unit)) if rows is None else rows
        self.opened[rows] += len(vectors)
        place = table["place"].to_numpy()
        shown, slack = vectors.astype("float32").T, _slack(vectors, self.split)
        whole = None
        for start in range(0, len(rows), self.chunk):
            some = rows[start : start + self.chunk]
            with np.errstate(all="ignore"):
                # A score that is no number here is settled in double precision.
                hits = ~(self.short[some] @ shown < (self.least[some] - slack).astype("float32")[:, None])
            if np.count_nonzero(hits) * 64 > hits.size:
                whole = vectors.astype("float64") if whole is None else whole
                self._keep(some, place, *self._dense(some, whole))
            else:
                row, good = np.divmod(np.flatnonzero(hits), hits.shape[1])
                a, b = self.unit[some[row]], vectors[good].astype("float64")
                clip, bio = (np.einsum("ij,ij->i", a[:, c], b[:, c]) for c in self._cuts())
                score = np.round((clip + bio) / 2, SCORE_PLACES)
                fit = score >= self.least[some[row]]
                self._keep(some, place, row[fit], good[fit], np.stack([clip, bio, score])[:, fit])
        if self.waiting * 2 >= len(self.unit) * self.top:
            self._settle()

    def _cuts(self):
        return slice(None, self.split), slice(self.split, None)

    def _dense(self, some, vectors):
        """Best rows of a block, all pairs in double precision; ties in the order of their places."""
        import numpy as np

        clip, bio = (self.unit[some][:, c] @ vectors[:, c].T for c in self._cuts())
        score = np.round((clip + bio) / 2, SCORE_PLACES)
        score = np.where(np.isnan(score), -np.inf, score)
        n = min(self.top, len(vectors))
        floor = np.maximum(np.partition(score, -n, axis=1)[:, -n], self.least[some])
        row, good = np.nonzero((score >= floor[:, None]) & (score > -np.inf))
        order = np.lexsort((good, -score[row, good], row))
        row, good = row[order], good[order]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < n
        row, good = row[kept], good[kept]
        return row, good, np.stack([clip[row, good], bio[row, good], score[row, good]])

    def _keep(self, some, place, row, good, scores) -> None:
        self.pending.append((some[row], place[good], scores))
        self.waiting += len(row)

    def _settle(self) -> None:
        """Cut what has been kept to the best ``top`` of each query."""
        import numpy as np

        rows, places, scores = zip((self.row, self.place, self.scores), *self.pending)
        row, place, scores = np.concatenate(rows), np.concatenate(places), np.concatenate(scores, axis=1)
        order = np.lexsort((place, -scores[2], row))
        row = row[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        order = order[nth < self.top]
        self.row, self.place, self.scores = row[nth < self.top], place[order], scores[:, order]
        last = row[nth == self.top - 1]
        self.least[last] = np.maximum(self.least[last], self.scores[2][np.searchsorted(self.row, last, "right") - 1])
        self.pending, self.waiting = [], 0

    def best(self):
        """(query_id, place, scores, opened) of the best rows; with bounds, also a row per query with what it opened."""
        import numpy as np
        import pyarrow as pa

        if self.pending:
            self._settle()
        at, n = self.directed[self.row], 0 if self.bounds is None else len(self.ids)
        opened = np.zeros(len(self.ids), dtype="int64")
        opened[self.directed] = self.opened
        ids = pa.chunked_array([*self.ids.take(pa.array(at)).chunks, *(self.ids.chunks if n else [])], self.ids.type)
        columns = [
            pa.array([*values.tolist(), *[None] * n], kind)
            for values, kind in [(self.place, pa.int64()), *[(s, pa.float64()) for s in self.scores]]
        ]
        told = pa.array([None] * len(at) + opened.tolist()[:n], pa.int64())
        names = ["query_id", "place", "score_clip", "score_bio", "score", "opened"]
        return pa.table([ids, *columns, told], names=names).combine_chunks().to_batches()


def _slack(vectors, split: int) -> float:
    """What single precision may take from a score with any of the vectors, twice over."""
    import numpy as np

    with np.errstate(all="ignore"):
        lengths = sum(np.linalg.norm(part.astype("float64"), axis=1) for part in (vectors[:, :split], vectors[:, split:])) / 2
        return (vectors.shape[1] + 8) * 2.0**-23 * lengths.max(initial=0) + 1e-9


def compared(queries: DataFrame, blocks: DataFrame, top: int, bounds=None) -> DataFrame:
    """Best ``top`` places for each query, of every group of blocks: (query_id, place, scores, opened).

    ``blocks`` has the packed corpus, and with ``bounds`` the ``of`` of each block, the number
    that the bounds know it by. A task holds one block of queries, past which the blocks of the
    corpus are read one by one. So both sides are written once, whatever their sizes, a task holds
    two blocks, and what it returns is a few rows per query. The corpus is cut into groups only
    where there are fewer blocks of queries than cores.
    """
    spark = queries.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    tasks, n, chunk = spark.sparkContext.defaultParallelism, queries.count(), CHUNK
    # As many blocks as give every core the same number, if that does not make them tiny.
    even = math.ceil(math.ceil(n / LEFT_BLOCK) / tasks) * tasks
    n_left = max(1, math.ceil(n / LEFT_BLOCK), min(even, math.ceil(n / LEAST_BLOCK)))
    asked = packed(queries.select("query_id", "clip", "bio").repartition(n_left), 2 * LEFT_BLOCK)
    groups = math.ceil(tasks / n_left)

    def compare(batches):
        import pyarrow as pa

        held = {}
        for batch in batches:
            for left, right, nth, of in zip(*batch.columns):
                if nth.as_py() not in held:
                    held[nth.as_py()] = _Asked(pa.ipc.open_stream(left.as_buffer()).read_all(), top, chunk, bounds)
                held[nth.as_py()].meet(pa.ipc.open_stream(right.as_buffer()).read_all().combine_chunks(), of.as_py())
        for one in held.values():
            yield from one.best()

    of = F.col("of") if "of" in blocks.columns else F.lit(None).cast("int").alias("of")
    pairs = (
        blocks.select(F.col("block").alias("right"), of)
        .coalesce(groups)
        .crossJoin(asked.select(F.col("block").alias("left"), "nth").hint("shuffle_replicate_nl"))
    )
    id_type = queries.schema["query_id"].dataType.simpleString()
    return pairs.select("left", "right", "nth", "of").mapInArrow(
        compare, f"query_id {id_type}, place long, score_clip double, score_bio double, score double, opened long"
    )


def named(found: DataFrame, corpus: DataFrame) -> DataFrame:
    """Found places with the columns of their rows."""
    return found.join(corpus.select("place", "slug", "description", "copies"), "place").select(
        "query_id", "slug", "description", "copies", "score_clip", "score_bio", "score"
    )


def best_matches(queries: DataFrame, corpus: DataFrame, corpus_ids: DataFrame, top: int) -> DataFrame:
    """Candidates per query by the mean of two dot products.

    Query vectors are scaled to length one in the task; corpus vectors are used
    as they are. ``corpus_ids`` has at least as many rows as the corpus and is
    only counted. A query vector of length zero has no direction and finds
    nothing. ``queries`` has query_id, clip, bio; ``corpus`` has slug, description, clip,
    bio and copies, with unique rows. The result holds, for each query, the best
    ``top`` corpus rows of every group of blocks, so it contains the best ``top`` overall.
    Scores are rounded to ten places: the last bits of a matrix product depend
    on the block and must not decide ties. Both sides are checkpointed when this is called.
    """
    shared_folder(queries.sparkSession)
    corpus = placed(corpus, corpus_ids.count())
    blocks = packed(corpus.select("place", "clip", "bio"), RIGHT_BLOCK)
    return named(compared(queries, blocks, top).drop("opened"), corpus)


def best_similarity(pairs: DataFrame, queries: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Largest dot product of each query, at length one, with the right rows of a group.

    ``pairs`` names the (query_id, ``on``) wanted, ``queries`` has query_id and
    vector, ``right`` has ``on`` and vector. Small groups share a task by hash. A
    large group is cut into as many blocks as its two sides need, so one group
    with a third of all rows is spread like any other. Pairs without right rows
    are absent from the result.
    """
    chunk = CHUNK

    def compare(a, b):
        import numpy as np
        import pyarrow as pa

        def matrix(table):
            vectors = table["vector"].combine_chunks()
            return vectors.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(vectors), -1)

        at, best = [np.zeros(0, dtype="int64")], [np.zeros(0)]
        if len(a) and len(b):
            asked, images = matrix(a), matrix(b)
            length = np.linalg.norm(asked, axis=1)
            names = [np.asarray(t["member"].to_pylist(), dtype=object) for t in (a, b)]
            known, code = np.unique(np.concatenate(names), return_inverse=True)
            code_a, code_b = np.where(length > 0, code[: len(a)], -1), code[len(a) :]
            # Rows in group order, and where each group starts and ends in it.
            order_a, order_b = np.argsort(code_a, kind="stable"), np.argsort(code_b, kind="stable")
            ends = np.arange(len(known) + 1)
            cut_a, cut_b = np.searchsorted(code_a[order_a], ends), np.searchsorted(code_b[order_b], ends)
            for g in range(len(known)):
                rows, shown = order_a[cut_a[g] : cut_a[g + 1]], images[order_b[cut_b[g] : cut_b[g + 1]]].T
                for start in range(0, len(rows) if shown.size else 0, chunk):
                    some = rows[start : start + chunk]
                    at.append(some)
                    best.append(np.round((asked[some] @ shown).max(axis=1) / length[some], SCORE_PLACES))
        at = pa.array(np.concatenate(at))
        return pa.table(
            [a["query_id"].take(at), a["member"].take(at), pa.array(np.concatenate(best))],
            names=["query_id", "member", "best"],
        )

    asked = pairs.select("query_id", F.col(on).alias("member")).distinct()
    images = right.select(F.col(on).alias("member"), "vector")
    shared = F.greatest(_block_count(pairs, LEFT_BLOCK), _block_count(images, RIGHT_BLOCK))

    def blocks(df: DataFrame, size: int, name: str) -> DataFrame:
        return df.groupBy("member").agg(F.ceil(F.count("*") / F.lit(size)).cast("int").alias(name))

    small = (F.col("n_left") == 1) & (F.col("n_right") == 1)
    task = F.when(small, _block_of(["member"], shared).cast("string")).otherwise(F.concat(F.lit("own "), "member"))
    plan = (
        blocks(asked, LEFT_BLOCK, "n_left")
        .join(blocks(images, RIGHT_BLOCK, "n_right"), "member")
        .withColumn("task", task)
    )
    # The vectors join last, when only their block is still to be shuffled to.
    a = (
        asked.join(plan, "member")
        .select(
            "query_id", "member", F.col("task").alias("left_task"),
            _block_of(["query_id"], F.col("n_left")).alias("lb"), _all_blocks(F.col("n_right")).alias("rb"),
        )
        .join(queries.select("query_id", "vector"), "query_id")
    )
    # Images of species that no query asks for are left out before any vector is shuffled.
    b = images.join(plan.select("member"), "member", "left_semi").distinct().join(plan, "member").select(
        "member", "vector", F.col("task").alias("right_task"),
        _block_of(["vector"], F.col("n_right")).alias("rb"), _all_blocks(F.col("n_left")).alias("lb"),
    )
    id_type = queries.schema["query_id"].dataType.simpleString()
    met = a.groupBy("left_task", "lb", "rb").cogroup(b.groupBy("right_task", "lb", "rb"))
    return (
        met.applyInArrow(compare, f"query_id {id_type}, member string, best double")
        .groupBy("query_id", "member")
        .agg(F.max("best").alias("best"))
        .withColumnRenamed("member", on)
    )
