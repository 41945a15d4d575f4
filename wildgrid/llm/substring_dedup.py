"""Removal of repeated word sequences by suffix trees, split by prefixes of variable length.

Every word covered by a window of ``length`` words that also starts anywhere else goes.

A suffix tree of all suffixes is split by what the suffixes begin with, so that each group fits
into memory, and one subtree is built per group. Sending each suffix with its words would be
``length`` times the text. So the suffixes travel with the next anchor: in each window, the start
of the prefix of least hash. Equal windows have equal anchors, so two equal windows are always
in one group. Consecutive windows with one anchor form a segment, which is sent once.

- The prefixes are 8 words long at first. Segments that are equal as a whole are counted, not
  sent. A group whose different segments would not fit is split by longer prefixes of 16 words,
  and at last by whole windows, whose groups hold nothing but equal windows.
- The words of one segment of each kind are fetched, and the subtree of a group is built: its
  suffixes in order, those that agree in ``length`` words under one node. A node so deep with
  two leaves or more is a repeat, and its leaves are the places where it starts.
- Touching repeats are joined to spans, which are the maximal repeats, and cut from the texts.

Words are compared by 64-bit hashes. Equal segments that follow each other, as in a text of one
word, are one row. Texts travel compressed; long texts are read in pieces.

NULL has no words. Every row is a document of its own: repeated rows match each other. Texts of
fewer than ``length`` words stay as they are, but for their blanks. An empty table gives an empty
one. Columns other than the text and the id take no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wildgrid.llm.common import bound_batches, col, packed_texts, row_keys, unpacked, whole_text, written

LENGTH = 35
PREFIXES = (8, 16)
KEY = ["k1", "k2"]
# Different segments of a group that one subtree is built of, at most.
GROUP = 20_000
# Words that are looked at together (their places take 18 bits of an order), and words of a tree.
_PIECE = 1 << 18
_PLACE = np.uint64(_PIECE - 1)
_TREE_WORDS = 1 << 18
# Bytes of a text that are cut into words at once.
_SLICE = 1 << 20
_BLANK = b" \t\n\x0b\x0c\r"
_FACTORS = [np.uint64(f | 1) for f in np.random.default_rng(35).integers(0, 1 << 64, 8, np.uint64, endpoint=False)]


def slices(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, of about a megabyte at a time."""
    at = 0
    while at < len(text):
        end = at + _SLICE
        while end < len(text) and text[end] not in _BLANK:
            end += 1
        yield text[at:end].split()
        at = end


def word_hashes(text: bytes) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    parts = [np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words)) for words in slices(text)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def prefix_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` words from each place."""
    out, have, step = words, 1, 0
    while have < size:
        add = min(have, size - have)
        # The second half may overlap the first.
        out = out[: len(out) - add] * _FACTORS[step] + out[add:]
        have, step = have + add, step + 1
    out = out ^ (out >> np.uint64(31))
    out = out * _FACTORS[-1]
    return out ^ (out >> np.uint64(29))


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    have = 1
    while have < width:
        add = min(have, width - have)
        values = np.minimum(values[: len(values) - add], values[add:])
        have += add
    return values


def grouped(texts: Iterator[np.ndarray], length: int) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    """Groups of (number, offset, words) of limited size; each window is in exactly one piece."""
    group: list[tuple[int, int, np.ndarray]] = []
    size = 0
    for n, words in enumerate(texts):
        for at in range(0, len(words) - length + 1, _PIECE - length + 1):
            part = words[at : at + _PIECE]
            if size + len(part) > _PIECE:
                yield group
                group, size = [], 0
            group.append((n, at, part))
            size += len(part)
    if group:
        yield group


def segments(group: list[tuple[int, int, np.ndarray]], length: int, prefix: int) -> tuple[np.ndarray, ...]:
    """Number, start, windows, times, anchor hash and digest of the segments of a group.

    ``times`` counts equal segments of which each starts where the windows of the last end.
    """
    from xxhash import xxh3_64_intdigest

    words = np.concatenate([part for _, _, part in group])
    sizes = np.array([len(part) for _, _, part in group])
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    hashes = prefix_hashes(words, prefix)
    order = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    least = least_of(order, length - prefix + 1)
    edges = np.zeros(len(least) + 1, np.int64)
    np.add.at(edges, begins, 1)
    np.add.at(edges, begins + sizes - length + 1, -1)
    inside, new = np.cumsum(edges[:-1]) > 0, np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | ~inside[:-1]
    new[begins] = True
    first = np.flatnonzero(new & inside)
    piece = np.searchsorted(begins, first, side="right") - 1
    stop = np.minimum(np.append(first[1:], len(least)), begins[piece] + sizes[piece] - length + 1)
    view = memoryview(np.ascontiguousarray(words).view(np.uint8))
    ends = stop + length - 1
    digest = np.array([xxh3_64_intdigest(view[8 * a : 8 * b]) for a, b in zip(first.tolist(), ends.tolist())], np.uint64)
    anchor = hashes[(least[first] & _PLACE).astype(np.int64)]
    # Equal neighbours become one row.
    fresh = np.ones(len(first), bool)
    fresh[1:] = (digest[1:] != digest[:-1]) | (anchor[1:] != anchor[:-1]) | (first[1:] != stop[:-1]) | (piece[1:] != piece[:-1])
    head = np.flatnonzero(fresh)
    times = np.diff(np.append(head, len(first)))
    first, windows, piece = first[head], (stop - first)[head], piece[head]
    numbers, offsets = (np.array([p[c] for p in group]) for c in (0, 1))
    return (numbers[piece], first - begins[piece] + offsets[piece], windows, times,
            anchor[head].view(np.int64), digest[head].view(np.int64))


PLACES = "k1 long, k2 long, start long, windows int, times int, single boolean, anchor long, digest long, data binary"


def _placed(length: int, prefix: int, texts: bool):
    """Segments of texts, without their words, or of longer segments, with their words."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2, start, single = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(4))
            held: dict[int, np.ndarray] = {}

            def words() -> Iterator[np.ndarray]:
                for n, data in enumerate(batch.column(4)):
                    data = data.as_py()
                    if texts:
                        yield word_hashes(data)
                    else:
                        held[n] = np.frombuffer(data, np.uint64)
                        yield held[n]

            for group in grouped(words(), length):
                number, at, windows, times, anchor, digest = segments(group, length, prefix)
                if texts:
                    data = pa.nulls(len(number), pa.binary())
                else:
                    data = pa.array([held[n][a : a + w + length - 1].tobytes() for n, a, w in zip(number, at, windows)], pa.binary())
                yield pa.RecordBatch.from_pydict({
                    "k1": pa.array(k1[number]), "k2": pa.array(k2[number]), "start": pa.array(start[number] + at),
                    "windows": pa.array(windows.astype(np.int32)), "times": pa.array(times.astype(np.int32)),
                    "single": pa.array(single[number].astype(bool)), "anchor": pa.array(anchor), "digest": pa.array(digest),
                    "data": data,
                })

    return found


SEGMENTS = "anchor long, single boolean, k1 long, k2 long, start long, data binary"
SPANS = "k1 long, k2 long, start long, size long"


def _fetched(length: int):
    """The words, as hashes, of the wanted segments of each text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k1, k2, packed, wanted in zip(*batch.columns):
                words = word_hashes(unpacked(packed.as_py()))
                asked = wanted.as_py()
                yield pa.RecordBatch.from_pydict({
                    "anchor": pa.array([w["anchor"] for w in asked], pa.int64()),
                    "single": pa.array([w["single"] for w in asked], pa.bool_()),
                    "k1": pa.array([k1.as_py()] * len(asked), pa.int64()),
                    "k2": pa.array([k2.as_py()] * len(asked), pa.int64()),
                    "start": pa.array([w["start"] for w in asked], pa.int64()),
                    "data": pa.array([words[w["start"] : w["start"] + w["windows"] + length - 1].tobytes() for w in asked], pa.binary()),
                })

    return cut


def ordered_suffixes(words: np.ndarray, depth: int) -> np.ndarray:
    """The number of each suffix's node at ``depth`` in the suffix tree, in the order of the suffixes.

    Suffixes are under one node if and only if they agree in so many words; past the end the
    words are taken for one that occurs nowhere else.
    """
    nodes, have = np.unique(words, return_inverse=True)[1].astype(np.int64), 1
    while have < depth:
        add = min(have, depth - have)
        pair = (nodes + 1) * (len(words) + 2)
        pair[: len(words) - add] += nodes[add:] + 1
        nodes, have = np.unique(pair, return_inverse=True)[1].astype(np.int64), have + add
    return nodes


def deep_leaves(parts: list[np.ndarray], length: int) -> list[np.ndarray]:
    """For each segment, which of its windows start under a node of ``length`` words with two leaves or more."""
    sizes = np.array([len(p) for p in parts])
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    nodes = ordered_suffixes(np.concatenate(parts), length)
    leaf = np.zeros(len(nodes), bool)
    for begin, size in zip(begins.tolist(), sizes.tolist()):
        leaf[begin : begin + max(size - length + 1, 0)] = True
    leaves = np.bincount(nodes[leaf], minlength=int(nodes.max()) + 1)
    deep = leaves[nodes] > 1
    return [deep[b : b + max(s - length + 1, 0)] for b, s in zip(begins.tolist(), sizes.tolist())]


def runs_of(flags: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the runs of true values."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))


def _trees(length: int):
    """Spans of the deep leaves in single segments; rows come sorted by anchor."""

    def spans(rows: list[tuple]) -> pa.RecordBatch:
        found = []
        for row, deep in zip(rows, deep_leaves([r[5] for r in rows], length)):
            if row[1]:
                found += [(row[2], row[3], row[4] + a, b - a + length - 1) for a, b in runs_of(deep)]
        columns = list(zip(*found)) if found else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["k1", "k2", "start", "size"])

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                # Small groups share a task's memory; a group is never cut.
                if size > _TREE_WORDS and row[0] != held[-1][0]:
                    yield spans(held)
                    held, size = [], 0
                held.append((*row[:5], np.frombuffer(row[5], np.uint64)))
                size += len(held[-1][5])
        if held:
            yield spans(held)

    return built


def _level(
    spark: SparkSession, places: DataFrame, fetch, length: int, group: int
) -> tuple[DataFrame, DataFrame]:
    """Spans that the groups of this level show, and the segments of the groups that don't fit.

    ``fetch`` gives the words of the kinds (k1, k2, start, windows, data, anchor, single).
    """
    anchors = places.groupBy("anchor").agg(
        F.sum("times").alias("n"), F.min("digest").alias("low"), F.max("digest").alias("high")
    )
    shared = anchors.filter("n > 1").select("anchor", (F.col("low") != F.col("high")).alias("mixed"))
    # Written, so that the join has a shuffle of its own, whose hot anchors Spark splits.
    met = written(spark, places.join(written(spark, shared, "shared"), "anchor"), "met")
    one = F.min(F.struct(*KEY, "start", "windows", "single", "data")).alias("one")
    kinds = met.filter("mixed").groupBy("anchor", "digest").agg(F.sum("times").alias("n"), one)
    kinds = written(spark, kinds, "kinds")
    equal = kinds.filter("n > 1").select("anchor", "digest")
    whole = met.filter("not mixed").unionByName(met.filter("mixed").join(equal, ["anchor", "digest"], "left_semi").select(met.columns))
    size = F.col("windows").cast("long") * F.col("times") + F.lit(length - 1)
    whole = whole.select(*KEY, "start", size.alias("size"))
    full = written(spark, kinds.groupBy("anchor").count().filter(F.col("count") > group).select("anchor"), "full")
    asked = kinds.select("one.k1", "one.k2", "one.start", "one.windows", "one.data", "anchor",
                         (F.col("one.single") & (F.col("n") == 1)).alias("single"))
    words = fetch(asked)
    fits = words.join(full, "anchor", "left_anti").repartition("anchor").sortWithinPartitions("anchor")
    spans = whole.unionByName(fits.mapInArrow(_trees(length), SPANS))
    return spans, words.join(full, "anchor", "left_semi") if not full.isEmpty() else None


def repeats(
    spark: SparkSession, keyed: DataFrame, length: int, prefixes: tuple[int, ...], group: int
) -> DataFrame:
    """(k1, k2, start, size): spans of repeated windows, in words, by the keys of (k1, k2, text, id)."""
    whole = keyed.select(*KEY, F.lit(0).cast("long").alias("start"), F.lit(True).alias("single"), F.col("text").cast("binary").alias("data"))
    places = written(spark, whole.mapInArrow(_placed(length, prefixes[0], True), PLACES), "places")

    def fetch(asked: DataFrame) -> DataFrame:
        wanted = asked.groupBy(*KEY).agg(F.collect_list(F.struct("start", "windows", "anchor", "single")).alias("wanted"))
        texts = packed_texts(keyed).join(wanted, KEY).select(*KEY, "packed", "wanted")
        return texts.mapInArrow(_fetched(length), SEGMENTS)

    carried = SEGMENTS.replace(" long", "").replace(" boolean", "").replace(" binary", "").split(", ")
    found, full = _level(spark, places, fetch, length, group)
    for prefix in (*prefixes[1:], length):
        if full is None:
            break
        parts = full.select(*KEY, "start", "single", "data").mapInArrow(_placed(length, prefix, False), PLACES)
        # Groups of whole windows are equal throughout: none is too large.
        room = group if prefix < length else 1 << 62
        more, full = _level(spark, written(spark, parts, "places"), lambda asked: asked.select(*carried), length, room)
        found = found.unionByName(more)
    return found


def joined_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans (start, end) joined where they touch."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(end, out[-1][1])
        else:
            out.append([start, end])
    return [tuple(s) for s in out]


def without(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, bytes]:
    """Number of words, and the words outside of the spans, joined by one space."""
    kept, at = [], 0
    for words in slices(text):
        inside = [(max(a - at, 0), b - at) for a, b in spans if a < at + len(words) and b > at]
        edges = [0, *[x for span in inside for x in span], len(words)]
        kept += [b" ".join(words[a:b]) for a, b in zip(edges[::2], edges[1::2]) if a < b]
        at += len(words)
    return at, b" ".join(kept)


def remove_repeats(
    spark: SparkSession, documents: DataFrame, text: str = "text", doc: str = "doc_id", length: int = LENGTH,
    prefixes: tuple[int, ...] = PREFIXES, group: int = GROUP,
) -> DataFrame:
    """(doc id, n_words, spans, kept): the removed spans of words, end excluded, and the words that stay."""
    if length <= max(prefixes):
        raise ValueError(f"length must be over {max(prefixes)}")
    bound_batches(spark)
    whole = whole_text(text)
    keyed = documents.select(*row_keys(documents, whole, doc), whole.alias("text"), col(doc).alias("id"))
    found = repeats(spark, keyed, length, prefixes, group)
    spans = found.groupBy(*KEY).agg(F.collect_set(F.struct("start", "size")).alias("found"))
    rows = packed_texts(keyed).join(spans, KEY, "left").select("id", "packed", "found")
    kind = keyed.schema["id"].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, gone, kept = [], [], []
            for packed, spans in zip(batch.column(1), batch.column(2)):
                joined = joined_spans([(s["start"], s["start"] + s["size"]) for s in spans.as_py() or []])
                n, rest = without(unpacked(packed.as_py()), joined)
                sizes.append(n)
                gone.append([{"start": a, "end": b} for a, b in joined])
                kept.append(rest)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(gone, span), pa.array(kept, pa.binary())],
                names=["id", "n_words", "spans", "kept"],
            )

    schema = f"id {kind}, n_words long, spans array<struct<start:long,end:long>>, kept binary"
    return rows.mapInArrow(cut, schema).withColumnRenamed("id", doc)


def digests(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document."""
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return remove_repeats(spark, documents).select(
        "doc_id", "n_words", n_removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256")
    )
