"""SimHash near-dedup by the generalised pigeonhole principle.

A text's 64-bit fingerprint has a bit set if more than half of the hashes of its word
shingles have it. Equal fingerprints are one point. Points that differ in at most ``radius``
bits are linked, and linked points make a component.

The 64 bits are dealt into partitions, correlated bits together. With thresholds t_i that
sum up to radius - partitions + 1, two points within the radius differ in at most t_i bits
in some partition i. The thresholds need not be equal (-1 leaves a partition out): dynamic
programming over the partitions picks those with the least cost, counted in rows sent and
in estimated pairs to verify. The number of partitions is picked by the same cost, so a
larger table gets wider partitions.

A point is filed under its bits in partition i with up to t_i set bits cleared: two points
that differ in t_i bits there meet under the bits both have. All points of a cell are
verified against each other in numpy, and only a spanning forest of the links found leaves
the task, never all pairs. A cell larger than ``cell_rows`` is cut into blocks, and each
pair of blocks is a task of its own.

NULL and empty texts have the fingerprint zero and are linked like any other. Repeated rows
get equal answers; a row without an id gets a component, but the component's id is the least
of the ids that there are. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wildgrid.llm.common import BLANKS, LOWER_AZ, bound_batches, col, whole_text, written
from wildgrid.llm.components import components

BITS = 64
SEED = 42
# Hashes of one text that are counted at a time.
_BLOCK = 1 << 18
# Cost of verifying a pair against that of sending a row.
_PAIR_COST = 0.05
_BLANK_TABLE = bytes(0x20 if chr(c) in BLANKS else c for c in LOWER_AZ)


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Fingerprint of a text as an unsigned number."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().translate(_BLANK_TABLE).split()
    if not words:
        return 0
    data = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    first, last = (starts[: 1 - shingle], ends[shingle - 1 :]) if len(words) >= shingle else (starts[:1], ends[-1:])
    if shingle == 1:
        first, last = starts, ends
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(first), _BLOCK):
        spans = zip(first[at : at + _BLOCK].tolist(), last[at : at + _BLOCK].tolist())
        hashes = np.array([xxh64_intdigest(data[s:e], SEED) for s, e in spans], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(first), bitorder="little").view("<u8")[0])


def fingerprints(spark: SparkSession, text: Column, shingle: int = 4) -> Column:
    """The fingerprint of a text column as a long with the same bits."""
    bound_batches(spark)

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return of(text)


def bit_counts(points: DataFrame) -> tuple[int, np.ndarray]:
    """Number of points, and of points that have bits i and j set."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for at in range(0, len(fps), 1 << 16):
                bits = np.unpackbits(fps[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                bits = bits.astype(np.float32)
                total += bits.T @ bits
            n += len(fps)
        pair, count = [-1], [n]
        for i, j in combinations(range(BITS), 2):
            pair.append(i * BITS + j)
            count.append(int(total[i, j]))
        for i in range(BITS):
            pair.append(i * BITS + i)
            count.append(int(total[i, i]))
        yield pa.RecordBatch.from_pydict({"pair": pa.array(pair, pa.int32()), "n": pa.array(count, pa.int64())})

    rows = points.select("fp").mapInArrow(counted, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    found = {r.pair: r.n for r in rows.collect()}
    both = np.zeros((BITS, BITS))
    for pair, n in found.items():
        if pair >= 0:
            both[pair // BITS, pair % BITS] = both[pair % BITS, pair // BITS] = n
    return int(found.get(-1, 0)), both


def correlated_parts(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits dealt into ``parts`` groups of about equal size, strongly correlated bits together."""
    share = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-9))
    strength = np.abs(both / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread)
    np.fill_diagonal(strength, -1.0)
    room = [BITS // parts + (k < BITS % parts) for k in range(parts)]
    left = list(range(BITS))
    out = []
    for size in room:
        # Start from the pair that goes together best, then add what goes best with the group.
        if len(left) == size:
            out.append(sorted(left))
            break
        among = strength[np.ix_(left, left)]
        group = [left[int(k)] for k in np.unravel_index(int(among.argmax()), among.shape)]
        while len(group) < size:
            rest = [b for b in left if b not in group]
            group.append(rest[int(strength[np.ix_(rest, group)].mean(axis=1).argmax())])
        group = group[:size]
        left = [b for b in left if b not in group]
        out.append(sorted(group))
    return out


def near_shares(agree: np.ndarray, bits: list[int], radius: int) -> list[float]:
    """Estimated share of pairs that differ in at most 0, 1, ... radius of the bits."""
    odds = np.zeros(radius + 2)
    odds[0] = 1.0
    for b in bits:
        odds[1:] = odds[1:] * agree[b] + odds[:-1] * (1 - agree[b])
        odds[0] *= agree[b]
    return np.cumsum(odds[: radius + 1]).tolist()


def allocate(n: int, both: np.ndarray, radius: int, most_parts: int = 6) -> list[tuple[list[int], int]]:
    """The partitions with their thresholds, of the least estimated cost."""
    share = np.diag(both) / max(n, 1)
    agree = share**2 + (1 - share) ** 2
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for parts in range(2, min(most_parts, radius + 1) + 1):
        groups = correlated_parts(n, both, parts)
        # Cheapest choice for each sum of (threshold + 1) so far.
        choice: dict[int, tuple[float, list[tuple[list[int], int]]]] = {0: (0.0, [])}
        for bits in groups:
            near = near_shares(agree, bits, radius)
            size = len(bits) * max(float(share[bits].mean()), 0.3)
            following: dict[int, tuple[float, list[tuple[list[int], int]]]] = {}
            for used, (cost, taken) in choice.items():
                for t in range(-1, radius + 1 - used):
                    rows = sum(comb(round(size), k) for k in range(t + 1))
                    pairs = n / 2 * near[t] if t >= 0 else 0.0
                    total = cost + n * (rows + _PAIR_COST * pairs)
                    key = used + t + 1
                    if key not in following or total < following[key][0]:
                        following[key] = (total, taken + [(bits, t)] * (t >= 0))
            choice = following
        found = choice.get(radius + 1)
        if found and (best is None or found[0] < best[0]):
            best = found
    return best[1]


def _cells(points: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    """(part, key, fp): every point under its bits with up to the threshold of set bits cleared."""

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for at in range(0, len(every), 4096):
                fps = every[at : at + 4096]
                for part, (bits, threshold) in enumerate(plan):
                    singles = [np.uint64(1 << b) for b in bits]
                    key = fps & np.uint64(sum(1 << b for b in bits))
                    for size in range(threshold + 1):
                        keys, owners = [], []
                        for cleared in combinations(singles, size):
                            mask = np.uint64(sum(int(c) for c in cleared))
                            has = (key & mask) == mask
                            keys.append(key[has] & ~mask)
                            owners.append(fps[has])
                        keys, owners = np.concatenate(keys), np.concatenate(owners)
                        yield pa.RecordBatch.from_pydict({
                            "part": pa.array(np.full(len(keys), part, np.int32)),
                            "key": pa.array(keys.view(np.int64)),
                            "fp": pa.array(owners.view(np.int64)),
                        })

    return points.select("fp").mapInArrow(filed, "part int, key long, fp long")


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct points, as pairs of positions."""
    links: list[tuple[int, int]] = []
    left = np.arange(len(fps))
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            some, front = front[:256], front[256:]
            near = np.bitwise_count(fps[some][:, None] ^ fps[left][None, :]) <= radius
            hit = near.any(axis=0)
            if hit.any():
                links += zip(some[near[:, hit].argmax(axis=0)].tolist(), left[hit].tolist())
                front, left = np.concatenate([front, left[hit]]), left[~hit]
    return links


def _verified(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links of each cell; rows come with the columns of the cell first and fp last, sorted."""

    def links(cells: np.ndarray, fps: np.ndarray) -> pa.RecordBatch | None:
        a, b = [], []
        starts = np.flatnonzero(np.concatenate([[True], (cells[1:] != cells[:-1]).any(axis=1)]))
        sizes = np.diff(np.append(starts, len(fps)))
        twos = starts[sizes == 2]
        twos = twos[np.bitwise_count(fps[twos] ^ fps[twos + 1]) <= radius]
        a.append(fps[twos])
        b.append(fps[twos + 1])
        for start, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            group = np.unique(fps[start : start + size])
            found = forest(group, radius)
            if found:
                pairs = np.array(found)
                a.append(group[pairs[:, 0]])
                b.append(group[pairs[:, 1]])
        a, b = np.concatenate(a), np.concatenate(b)
        if not len(a):
            return None
        return pa.RecordBatch.from_pydict({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    rest: tuple[np.ndarray, np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
        cells, fps = np.stack(columns[:-1], axis=1), columns[-1].view(np.uint64)
        if rest is not None:
            cells, fps = np.concatenate([rest[0], cells]), np.concatenate([rest[1], fps])
        # The last cell may go on in the next batch.
        cut = len(fps) - int((cells[::-1] == cells[-1]).all(axis=1).cumprod().sum())
        rest = cells[cut:], fps[cut:]
        if cut and (out := links(cells[:cut], fps[:cut])):
            yield out
    if rest is not None and (out := links(*rest)):
        yield out


def links_within(
    spark: SparkSession, points: DataFrame, radius: int = 4, cell_rows: int = 8192
) -> DataFrame:
    """Links (a, b) that connect all distinct points ``fp`` within the radius of each other.

    Not every pair is listed, but the components are those of all pairs.
    """
    n, both = bit_counts(points)
    plan = allocate(n, both, radius)
    cell = ["part", "key"]
    cells = _cells(points, plan)
    crowded = cells.groupBy(*cell).count().filter(F.col("count") > cell_rows)
    # Written, as it is asked twice and its size decides how it is joined.
    crowded = written(spark, crowded, "crowded")

    def compared(rows: DataFrame, keys: list[str]) -> DataFrame:
        dealt = rows.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "fp")
        return dealt.mapInArrow(lambda batches: _verified(batches, radius), "a long, b long")

    usual = compared(cells.join(crowded, cell, "left_anti"), cell)
    blocks = F.ceil(2 * F.col("count") / cell_rows).cast("int")
    halves = (
        cells.join(crowded, cell)
        .withColumn("blocks", blocks)
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("low", F.least("own", "other"))
        .withColumn("high", F.greatest("own", "other"))
    )
    return usual.unionByName(compared(halves, [*cell, "low", "high"]))


def near_groups(
    spark: SparkSession, documents: DataFrame, text: str = "text", doc: str = "doc_id", shingle: int = 4, radius: int = 4
) -> DataFrame:
    """(doc, text_hash, fp, component): one row per document, with the least id of its component."""
    prints = written(
        spark,
        documents.select(
            col(doc).alias("doc"),
            F.xxhash64(whole_text(text)).alias("text_hash"),
            fingerprints(spark, whole_text(text), shingle).alias("fp"),
        ),
        "fingerprints",
    )
    points = written(spark, prints.groupBy("fp").agg(F.min("doc").alias("least")), "points")
    roots = components(spark, links_within(spark, points, radius))
    rooted = points.join(roots, points["fp"] == roots["a"], "left").select(
        "fp", "least", F.coalesce("b", "fp").alias("root")
    )
    rooted = written(spark, rooted, "rooted")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = rooted.join(ids, "root").select("fp", "component")
    return prints.join(named, "fp").select("doc", "text_hash", "fp", "component")


def digests(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id of every document."""
    return near_groups(spark, documents).select(
        F.col("doc").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def one_of_each(spark: SparkSession, documents: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """``documents`` with one row of each component, that of the least id.

    ``groups`` has doc, text_hash and component of every document, those of ``near_groups`` by default. Of rows that share this id, the one with the least text hash stays; of rows that share
    both, one.
    """
    groups = near_groups(spark, documents) if groups is None else groups
    kept = groups.groupBy("component").agg(
        F.min(F.struct(F.col("doc").isNull(), "doc", "text_hash")).alias("k"), F.count(F.lit(1)).alias("n")
    ).select(F.col("k.doc").alias("_doc"), F.col("k.text_hash").alias("_hash"))
    rows = documents.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64(whole_text("text")).alias("_own"))
    same = F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_own") == F.col("_hash"))
    kept = written(spark, kept, "kept")
    again = groups.join(kept, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash")), "left_semi")
    again = again.groupBy("doc", "text_hash").count().filter("count > 1").select(
        F.col("doc").alias("_doc"), F.col("text_hash").alias("_hash")
    )
    stay = rows.join(kept, same, "left_semi")
    single = stay.join(again, same, "left_anti")
    first = stay.join(again, same, "left_semi").dropDuplicates(["_id", "_own"])
    return single.unionByName(first).select("_row.*")
