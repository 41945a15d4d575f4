"""Removal of long repeated byte strings by a logarithmic family of sparse suffix arrays.

Every byte covered by a string of ``length`` bytes that also starts anywhere else goes.

A suffix array of every byte would be several times the corpus. The index keeps the suffixes
that start at anchors: in each window of ``length`` bytes, the start of the 32-byte gram of
least hash. Equal windows have equal anchors, so two equal strings always meet under one
anchor. Consecutive windows with one anchor form a segment.

- Batches of documents become runs of anchors, sorted by anchor, with the number of their
  occurrences and the range of their segments' digests. Each new run is merge-scanned against
  the levels of the family, and equal levels merge; see ``levels``. No text is in the index.
- An anchor that occurs twice in all is a possible match. If all its segments are equal, all
  of their windows repeat. Otherwise the text of one segment of each kind is fetched, and a
  suffix array of these segments, truncated at ``length``, is built by prefix doubling: equal
  ranks are equal strings, byte for byte. The repeated windows of the segments are read off it.
- The windows are joined to spans and cut from the texts.

An anchor with more than ``crowded`` different segments is not sent to one task: its windows
are dealt by two 64-bit hashes and counted. Texts travel compressed. Very long texts are
read in pieces that overlap by less than a window.

NULL counts as the empty text. Every row is a document of its own: repeated rows match each
other. Rows without an id are told apart by their texts. Texts shorter than ``length`` bytes
stay as they are. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wildgrid.llm.common import bound_batches, col, whole_text, written
from wildgrid.llm.levels import LevelledRuns

GRAM = 32
# Positions that are looked at together; an anchor's position is packed into 20 bits.
_PIECE = 1 << 20
_POSITION = np.uint64(_PIECE - 1)
# Bytes of segments that one suffix array is built of.
_ARRAY_BYTES = 1 << 21
_TABLE = np.random.default_rng(20).integers(0, 1 << 64, 256, np.uint64, endpoint=False)
_FACTORS = [np.uint64(f | 1) for f in np.random.default_rng(21).integers(0, 1 << 64, 5, np.uint64, endpoint=False)]

KEY = ["k1", "k2"]
PLACES = "k1 long, k2 long, start long, windows int, anchor long, digest long"


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 32 bytes from each position."""
    out = _TABLE[data]
    for step, factor in zip((1, 2, 4, 8, 16), _FACTORS):
        out = out[:-step] * factor + out[step:]
    out ^= out >> np.uint64(31)
    out *= _FACTORS[0]
    out ^= out >> np.uint64(29)
    return out


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return values if size == width else np.minimum(values[: len(values) - (width - size)], values[width - size :])


def pieces(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Groups of (text, offset, bytes) of limited size; each window is in exactly one piece."""
    group: list[tuple[int, int, bytes]] = []
    size = 0
    for n, text in enumerate(texts):
        for at in range(0, max(len(text) - length + 1, 0), _PIECE - length + 1):
            part = text[at : at + _PIECE]
            if size + len(part) > _PIECE:
                yield group
                group, size = [], 0
            group.append((n, at, part))
            size += len(part)
    if group:
        yield group


def segments(group: list[tuple[int, int, bytes]], length: int) -> tuple[np.ndarray, ...]:
    """Text, start, number of windows, anchor hash and digest of each segment of a group."""
    from xxhash import xxh3_64_intdigest

    data = b"".join(part for _, _, part in group)
    sizes = np.array([len(part) for _, _, part in group])
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    hashes = gram_hashes(np.frombuffer(data, np.uint8))
    order = (hashes & ~_POSITION) | np.arange(len(hashes), dtype=np.uint64)
    least = sliding_least(order, length - GRAM + 1)
    inside = np.zeros(len(least) + 1, bool)
    for begin, size in zip(begins.tolist(), sizes.tolist()):
        inside[begin : begin + size - length + 1] = True
    inside, new = inside[:-1], np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new & inside)
    # A segment ends before the next one, or where its piece ends.
    piece = np.searchsorted(begins, first, side="right") - 1
    stop = np.minimum(np.append(first[1:], len(least)), begins[piece] + sizes[piece] - length + 1)
    windows = stop - first
    view = memoryview(data)
    digest = [xxh3_64_intdigest(view[a:b]) for a, b in zip(first.tolist(), (stop + length - 1).tolist())]
    texts, offsets = (np.array([p[c] for p in group]) for c in (0, 1))
    return (
        texts[piece], first - begins[piece] + offsets[piece], windows,
        hashes[(least[first] & _POSITION).astype(np.int64)].view(np.int64), np.array(digest, np.uint64).view(np.int64),
    )


def _places(length: int) -> Callable:
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            k1, k2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            for group in pieces(texts, length):
                text, start, windows, anchor, digest = segments(group, length)
                yield pa.RecordBatch.from_pydict({
                    "k1": pa.array(k1[text]), "k2": pa.array(k2[text]), "start": pa.array(start),
                    "windows": pa.array(windows.astype(np.int32)), "anchor": pa.array(anchor), "digest": pa.array(digest),
                })

    return found


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, for the way through a shuffle."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=4).compress
    for batch in batches:
        packed = pa.array([pack(t) for t in batch.column(2).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed, batch.column(3)],
                                         names=["k1", "k2", "packed", "id"])


def _unpack(packed: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(packed)


def _fetched(length: int) -> Callable:
    """Bytes of the wanted segments of each text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k1, k2, packed, wanted in zip(*(c.to_pylist() for c in batch.columns)):
                text = _unpack(packed)
                for w in wanted:
                    data = text[w["start"] : w["start"] + w["windows"] + length - 1]
                    rows.append((w["anchor"], w["single"], k1, k2, w["start"], data))
            columns = list(zip(*rows)) if rows else [()] * 6
            kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["anchor", "single", "k1", "k2", "start", "data"]
            )

    return cut


FETCHED = "anchor long, single boolean, k1 long, k2 long, start long, data binary"
SPANS = "k1 long, k2 long, start long, size long"


def suffix_ranks(data: np.ndarray, depth: int) -> np.ndarray:
    """Rank of each suffix of ``data`` by its first ``depth`` bytes, by prefix doubling.

    This is the suffix array truncated at ``depth``, turned round: suffixes have equal ranks
    if and only if these bytes are equal, the end of the data standing for zero bytes.
    """
    n, size = len(data), min(8, depth)
    first = np.zeros(n, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    for k in range(size):
        first = first << np.uint64(8) | padded[k : k + n]
    ranks = np.unique(first, return_inverse=True)[1]
    while size < depth:
        step = min(size, depth - size)
        pair = (ranks.astype(np.int64) + 1) * (n + 2)
        pair[: n - step] += ranks[step:] + 1
        ranks = np.unique(pair, return_inverse=True)[1]
        size += step
    return ranks


def repeated_windows(parts: list[bytes], length: int) -> list[np.ndarray]:
    """For each byte string, which of its windows occur again in these strings."""
    sizes = np.array([len(p) for p in parts])
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    ranks = suffix_ranks(np.frombuffer(b"".join(parts), np.uint8), length)
    inside = np.zeros(len(ranks) + 1, bool)
    for begin, size in zip(begins.tolist(), sizes.tolist()):
        inside[begin : begin + max(size - length + 1, 0)] = True
    inside = inside[:-1]
    again = np.bincount(ranks[inside], minlength=int(ranks.max()) + 1)[ranks] > 1
    return [again[b : b + max(s - length + 1, 0)] for b, s in zip(begins.tolist(), sizes.tolist())]


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of the runs of true values."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist()))


def _matched(length: int) -> Callable:
    """Spans of the repeated windows of single segments; rows come sorted by anchor."""

    def spans(rows: list[tuple]) -> pa.RecordBatch:
        found = []
        for row, flags in zip(rows, repeated_windows([r[5] for r in rows], length)):
            if row[1]:
                found += [(row[2], row[3], row[4] + a, b - a + length) for a, b in _runs(flags)]
        columns = list(zip(*found)) if found else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["k1", "k2", "start", "size"])

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                # An array is cut between anchors only.
                if size > _ARRAY_BYTES and row[0] != held[-1][0]:
                    yield spans(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield spans(held)

    return matched


WINDOWS = "w1 long, w2 long, single boolean, k1 long, k2 long, start long"


def _dealt(length: int) -> Callable:
    """Every window of the segments under crowded anchors, by its hashes."""
    from xxhash import xxh3_128_digest

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, single, k1, k2, start, data in zip(*(c.to_pylist() for c in batch.columns)):
                n = len(data) - length + 1
                hashes = b"".join(xxh3_128_digest(data[i : i + length]) for i in range(n))
                pair = np.frombuffer(hashes, "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_pydict({
                    "w1": pa.array(pair[:, 0]), "w2": pa.array(pair[:, 1]), "single": pa.array([single] * n),
                    "k1": pa.array(np.full(n, k1)), "k2": pa.array(np.full(n, k2)), "start": pa.array(np.arange(start, start + n)),
                })

    return windows


def cut_spans(text: bytes, spans: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], bytes]:
    """Spans (start, end) joined where they touch, and the bytes outside of them."""
    joined: list[list[int]] = []
    for start, end in sorted(spans):
        if joined and start <= joined[-1][1]:
            joined[-1][1] = max(end, joined[-1][1])
        else:
            joined.append([start, end])
    edges = [0, *[x for span in joined for x in span], len(text)]
    return [tuple(s) for s in joined], b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def repeats(
    spark: SparkSession, documents: DataFrame, text: Column, doc: str, length: int, batches: int, crowded: int
) -> DataFrame:
    """(k1, k2, start, size): spans of repeated windows, by the keys of ``documents``."""
    source = documents.select(*KEY, text.cast("binary").alias("text"))
    places = written(spark, source.mapInArrow(_places(length), PLACES), "places")
    index = LevelledRuns(spark, ["anchor"], {"n": "sum", "low": "min", "high": "max"})
    for k in range(batches):
        batch = places.filter(F.pmod(F.xxhash64(*KEY), F.lit(batches)) == k)
        index.add(batch.select("anchor", F.lit(1).cast("long").alias("n"), F.col("digest").alias("low"), F.col("digest").alias("high")))
    shared = index.totals(F.col("n") > 1).select("anchor", (F.col("low") != F.col("high")).alias("mixed"))
    # Written, so that the join below has a shuffle of its own, whose hot anchors Spark splits.
    shared = written(spark, shared, "shared")
    # The places of possible matches: asked three times from here on.
    met = written(spark, places.join(shared, "anchor"), "met")
    kinds = (
        met.filter("mixed").groupBy("anchor", "digest")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*KEY, "start", "windows")).alias("one"))
    )
    kinds = written(spark, kinds, "kinds")
    whole = met.filter("not mixed").unionByName(
        met.filter("mixed").join(kinds.filter("n > 1").select("anchor", "digest"), ["anchor", "digest"], "left_semi")
        .select(met.columns)
    )
    whole = whole.select(*KEY, "start", (F.col("windows") + F.lit(length - 1)).cast("long").alias("size"))
    wanted = kinds.select("one.*", "anchor", (F.col("n") == 1).alias("single")).groupBy(*KEY).agg(
        F.collect_list(F.struct("start", "windows", "anchor", "single")).alias("wanted")
    )
    fetched = _texts(documents, text, doc).join(wanted, KEY).select(*KEY, "packed", "wanted").mapInArrow(_fetched(length), FETCHED)
    full = kinds.groupBy("anchor").count().filter(F.col("count") > crowded).select("anchor")
    full = written(spark, full, "crowded")
    usual = fetched.join(full, "anchor", "left_anti").repartition("anchor").sortWithinPartitions("anchor")
    found = whole.unionByName(usual.mapInArrow(_matched(length), SPANS))
    if not full.isEmpty():
        windows = fetched.join(full, "anchor", "left_semi").mapInArrow(_dealt(length), WINDOWS)
        again = windows.groupBy("w1", "w2").count().filter("count > 1").select("w1", "w2")
        single = windows.filter("single").join(again, ["w1", "w2"], "left_semi")
        found = found.unionByName(single.select(*KEY, "start", F.lit(length).cast("long").alias("size")))
    return found


def _texts(documents: DataFrame, text: Column, doc: str) -> DataFrame:
    kind = documents.schema[doc].dataType.simpleString()
    source = documents.select(*KEY, text.cast("binary").alias("text"), col(doc).alias("id"))
    return source.mapInArrow(_packed, f"k1 long, k2 long, packed binary, id {kind}")


def remove_repeats(
    spark: SparkSession,
    documents: DataFrame,
    text: str = "text",
    doc: str = "doc_id",
    length: int = 200,
    batches: int = 2,
    crowded: int = 50_000,
) -> DataFrame:
    """(doc id, n_bytes, spans, kept): the removed spans, end excluded, and the bytes that stay.

    ``batches`` is the number of runs the corpus is taken in.
    """
    if length < GRAM + 1:
        raise ValueError(f"length must be over {GRAM}")
    bound_batches(spark)
    whole = whole_text(text)
    # A row is known by its text's hash and its id. Rows that agree in both have equal results.
    keyed = documents.select(
        F.xxhash64(whole).alias("k1"), F.coalesce(F.xxhash64(col(doc)) if documents.schema[doc].dataType.simpleString()
                                                  not in ("bigint", "int") else col(doc).cast("long"), F.lit(0)).alias("k2"),
        col(doc), col(text),
    )
    found = repeats(spark, keyed, whole, doc, length, batches, crowded)
    spans = found.groupBy(*KEY).agg(F.collect_set(F.struct("start", "size")).alias("found"))
    joined = _texts(keyed, whole, doc).join(spans, KEY, "left").select("id", "packed", "found")
    kind = documents.schema[doc].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, gone, kept = [], [], []
            for packed, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                text = _unpack(packed)
                joined, rest = cut_spans(text, [(s["start"], s["start"] + s["size"]) for s in spans or []])
                sizes.append(len(text))
                gone.append([{"start": a, "end": b} for a, b in joined])
                kept.append(rest)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(sizes, pa.int64()),
                    pa.array(gone, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array(kept, pa.binary()),
                ],
                names=["id", "n_bytes", "spans", "kept"],
            )

    schema = f"id {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
    return joined.mapInArrow(cut, schema).withColumnRenamed("id", doc)


def digests(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return remove_repeats(spark, documents).select(
        "doc_id",
        "n_bytes",
        n_removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
