"""Members and list items of JSON documents of any size, cut by many tasks.

A file is read in pieces that end in ``}``. A structural index of the bytes tells strings from the
rest (quotes that no odd run of backslashes precedes) and gives the depth of brackets. What a
split does to the state is found without knowing the state: whether it flips strings, and, for
both cases, how many brackets it closes and opens. Folded over the splits of a file, that gives
every split the state it begins in, and it can cut the document at the commas it needs:

- those between the members or elements of the outermost container, and
- those between the items of a list that is a member of the outermost object.

Work is linear in the bytes. A unit that crosses the border of splits is put together from its
fragments; see ``splits``. The cut units are written once to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from wildgrid.session import fresh_path
from wildgrid.sources import splits

_BLANKS = b" \t\r\n"
# What can end a unit: comma, end of the document, start of a list, comma and end of a list.
COMMA, DOC_END, LIST, ITEM_COMMA, LIST_END = ",", "E", "L", ";", "M"


def joined_bytes(lines: pa.Array, pending: bool) -> np.ndarray:
    """The bytes of the pieces with the brackets between them; ``pending`` is the one before them.

    Whether a bracket follows the last piece is seen when the next one comes, or the file ends.
    """
    lines = lines.cast(pa.large_binary())
    offsets = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset : lines.offset + len(lines) + 1]
    data = lines.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    n = len(data) + len(lines)
    out, kept = np.full(n, ord("}"), np.uint8), np.ones(n, bool)
    kept[offsets[:-1] - offsets[0] + np.arange(len(lines))] = False
    out[kept] = data
    return out if pending else out[1:]


def bracket_follows(seen: int, size: int, last: bool) -> bool:
    """Whether the file goes on with a bracket after ``seen`` bytes; a byte order mark is not seen."""
    return not (seen == size or last and seen == size - 3)


def in_strings(data: np.ndarray, begins: bool) -> np.ndarray:
    """Whether each byte is in a string; a piece never ends in a backslash that escapes."""
    quote, slash = data == ord('"'), data == ord("\\")
    if slash.any():
        at = np.arange(len(data))
        plain = np.maximum.accumulate(np.where(slash, -1, at))
        before = np.concatenate([[-1], plain[:-1]])
        quote &= ((at - 1 - before) & 1) == 0
    return (np.cumsum(quote) + begins) & 1 == 1


def steps(data: np.ndarray, quoted: np.ndarray) -> np.ndarray:
    """Change of depth at each byte."""
    change = ((data == ord("{")) | (data == ord("["))).astype(np.int64)
    change -= (data == ord("}")) | (data == ord("]"))
    change[quoted] = 0
    return change


def _effect(value: tuple[int, int, bytes], data: np.ndarray, quoted: np.ndarray) -> tuple[int, int, bytes]:
    """(closed, opened, the first two opened) after some more bytes."""
    closed, opened, kinds = value
    change = steps(data, quoted)
    depth = opened + np.cumsum(change)
    if not len(depth):
        return value
    least = min(0, int(depth.min()))
    now = int(depth[-1])
    kept = kinds[: min(2, max(int(min(depth.min(), opened)), 0))]
    for level in range(least + len(kept) + 1, min(now, least + 2) + 1):
        kept += data[np.flatnonzero((change == 1) & (depth == level))[-1] : ][:1].tobytes()
    return closed - least, now - least, kept


_SUMMARY = (
    "flips boolean, closed0 long, opened0 long, kinds0 binary, closed1 long, opened1 long, kinds1 binary, "
    "bytes long, first binary, size long"
)
# Nothing seen yet, and no bracket before the first piece.
_FIRST = (False, 0, 0, b"", 0, 0, b"", 0, b"", 0, False)
_BRACKET = np.array([ord("}")], np.uint8)


def _fold(value: tuple, part: pa.RecordBatch) -> tuple:
    flips, *effects, seen, first, _, pending = value
    data = joined_bytes(part.column(2), pending)
    now = []
    for k in (0, 1):
        now += _effect(tuple(effects[3 * k : 3 * k + 3]), data, in_strings(data, flips ^ bool(k)))
    quoted = in_strings(data, flips)
    first = first or bytes(data).lstrip(_BLANKS)[:1]
    return (bool(quoted[-1]) if len(quoted) else flips, *now, seen + len(data), first, part.column(3)[0].as_py(), True)


def _state_after(state: tuple, row: dict) -> tuple:
    """(in a string, depth, kinds of the two outermost brackets, below zero) after a split."""
    inside, depth, kinds, broken = state
    k = int(inside)
    left = depth - row[f"closed{k}"]
    kept = kinds[: max(min(left, 2), 0)]
    return inside ^ row["flips"], max(left, 0) + row[f"opened{k}"], (kept + row[f"kinds{k}"])[:2], broken or left < 0


_STATES = "source_file string, split long, inside boolean, depth long, kinds binary, offset long, shape string, valid boolean"


def _states(key, rows):
    """The state each split of a file begins in; its last row, without a split, is of the whole file."""
    found = sorted(rows.to_pylist(), key=lambda r: r["split"])
    state, offset, out, size = (False, 0, b"", False), 0, [], found[0]["size"]
    shape = {b"{": "OBJECT", b"[": "ARRAY"}.get(found[0]["first"])
    for row in found:
        if row["split"]:
            out.append((*state[:3], row["split"], offset))
        state, offset = _state_after(state, row), offset + row["bytes"]
        if bracket_follows(offset, size, row is found[-1]):
            inside, depth, kinds, broken = state
            closes = not inside
            state, offset = (inside, max(depth - closes, 0), kinds[: max(depth - closes, 0)], broken or depth < closes), offset + 1
    valid = shape is not None and not state[0] and state[1] == 0 and not state[3]
    out.append((*state[:3], None, offset))
    n = len(out)
    columns = list(zip(*out))
    return pa.table({
        "source_file": [found[0]["source_file"]] * n, "split": pa.array(columns[3], pa.int64()), "inside": pa.array(columns[0], pa.bool_()),
        "depth": pa.array(columns[1], pa.int64()), "kinds": pa.array(columns[2], pa.binary()), "offset": pa.array(columns[4], pa.int64()),
        "shape": pa.array([shape] * n, pa.string()), "valid": pa.array([valid] * n, pa.bool_()),
    })


def events_of(data: np.ndarray, inside: bool, depth: int, kinds: bytes) -> tuple[np.ndarray, list[str], bool, int, bytes]:
    """Places and kinds of what ends units, and the state after the bytes."""
    quoted = in_strings(data, inside)
    change = steps(data, quoted)
    at = depth + np.cumsum(change)
    outer = np.flatnonzero((change == 1) & (at == 1))
    second = np.flatnonzero((change == 1) & (at == 2))
    top = kinds[:1] or (data[outer[0] : outer[0] + 1].tobytes() if len(outer) else b"")
    comma = (data == ord(",")) & ~quoted
    found = [(outer, "D"), (np.flatnonzero(comma & (at == 1)), COMMA), (np.flatnonzero((change == -1) & (at == 0)), DOC_END)]
    in_list = kinds[1:2] == b"["
    if top == b"{":
        # The kind of the second bracket that is open at each place.
        kind = np.concatenate([[ord("[") if in_list else 0], data[second]])
        listed = lambda places: places[kind[np.searchsorted(second, places)] == ord("[")]
        found += [(second[data[second] == ord("[")], LIST), (listed(np.flatnonzero(comma & (at == 2))), ITEM_COMMA),
                  (listed(np.flatnonzero((change == -1) & (at == 1))), LIST_END)]
    places = np.concatenate([p for p, _ in found])
    names = np.concatenate([np.full(len(p), name) for p, name in found])
    order = np.argsort(places, kind="stable")
    now = int(at[-1]) if len(at) else depth
    last = data[second[-1] : second[-1] + 1].tobytes() if len(second) else kinds[1:2]
    kinds = (top + last)[: max(min(now, 2), 0)]
    return places[order], names[order].tolist(), bool(quoted[-1]) if len(quoted) else inside, now, kinds


_BEGINS = {"D": "member", COMMA: "member", LIST: "item", ITEM_COMMA: "item", LIST_END: "rest", DOC_END: "rest"}
_UNITS = f"{splits.PLACE}, place long, begins string, ends string, nth long, unit binary, opens boolean"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units of each split in order; NULL ``begins`` or ``ends`` where the unit crosses its border."""
    now, held, out = None, [], []
    begins, nth, place, at_place = None, 0, 0, 0
    inside, depth, kinds, seen, size, last, pending = False, 0, b"", 0, 0, False, False

    def add(ends: str | None) -> None:
        out.append((*now, at_place, begins, ends, nth if begins in ("member", "item") else None, b"".join(held), begins is not None))

    def cut(data: np.ndarray) -> None:
        nonlocal inside, depth, kinds, begins, nth, held, at_place, place
        places, names, inside, depth, kinds = events_of(data, inside, depth, kinds)
        start = 0
        for stop, name in zip(places.tolist(), names):
            held.append(data[start:stop].tobytes())
            add(name)
            nth += begins in ("member", "item")
            begins, held, start = _BEGINS[name], [], stop + 1
            at_place = place + start
        held.append(data[start:].tobytes())
        place += len(data)

    def flushed() -> pa.RecordBatch:
        columns = list(zip(*out)) if out else [()] * 8
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.bool_()]
        names = ["source_file", "split", "place", "begins", "ends", "nth", "unit", "opens"]
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
        out.clear()
        return batch

    def finish() -> None:
        if bracket_follows(seen, size, last):
            cut(_BRACKET)
        add(None)

    for batch in batches:
        for file, split, part in splits.by_split(batch):
            if (file, split) != now:
                if now is not None:
                    finish()
                now, held, place, at_place, nth, pending = (file, split), [], 0, 0, 0, False
                size, last, inside, depth, kinds, seen = (part.column(c)[0].as_py() for c in range(3, 9))
                inside, depth, kinds, seen = inside or False, depth or 0, kinds or b"", seen or 0
                # A split that begins in the middle goes on with a unit of an earlier one.
                begins = None if split else "rest"
            data = joined_bytes(part.column(2), pending)
            seen, pending = seen + len(data), True
            cut(data)
        yield flushed()
    if now is not None:
        finish()
        yield flushed()


def cut_documents(spark: SparkSession, path: str, **options) -> tuple[DataFrame, DataFrame]:
    """(source_file, split, place, begins, ends, nth, unit) and (source_file, shape, valid).

    ``begins`` is member, for the outermost container, or item, for a list in an object. ``ends``
    says what follows. ``nth`` counts members and items inside the document. An empty container
    has one blank member. Files of which nothing can be read are in neither.
    """
    lines = splits.read_lines(spark, path, "}", **options)
    ends = splits.summaries(lines, _fold, _FIRST, _SUMMARY, lambda value: value[:10])
    # A row per split, so that a file is as many short rows as it has splits.
    states = ends.groupBy("source_file").applyInArrow(_states, _STATES)
    folder = fresh_path(spark, "states")
    states.write.parquet(folder)
    states = spark.read.schema(_STATES).parquet(folder)
    begins = states.filter("split is not null").select("source_file", "split", "inside", "depth", "kinds", "offset")
    placed = splits.with_starts(lines, begins).select(
        "source_file", "split", "line", "size", "last", "inside", "depth", "kinds", "offset"
    )
    folder = fresh_path(spark, "units")
    placed.mapInArrow(_cut, _UNITS).write.parquet(folder)
    units = spark.read.schema(_UNITS).parquet(folder)
    return _whole(units), states.filter("split is null").select("source_file", "shape", "valid")


def _whole(units: DataFrame) -> DataFrame:
    """Units with their fragments joined, counted over the whole document."""
    crossing = units.filter("ends is null or begins is null")
    order = Window.partitionBy("source_file").orderBy("split", "place")
    run = F.sum(F.col("opens").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    parts = F.array_sort(F.collect_list(F.struct("split", "place", "begins", "ends", "nth", "unit")))
    joined = crossing.withColumn("run", run).groupBy("source_file", "run").agg(parts.alias("p")).select(
        "source_file", F.col("p")[0]["split"].alias("split"), F.col("p")[0]["place"].alias("place"),
        F.col("p")[0]["begins"].alias("begins"), F.element_at("p", -1)["ends"].alias("ends"), F.col("p")[0]["nth"].alias("nth"),
        F.array_join(F.transform("p", lambda u: u["unit"].cast("string")), "").alias("unit"),
    )
    alone = units.filter("ends is not null and begins is not null").select(
        "source_file", "split", "place", "begins", "ends", "nth", F.col("unit").cast("string").alias("unit"))
    counts = units.filter("nth is not null").groupBy("source_file", "split").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("source_file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("source_file", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    whole = alone.unionByName(joined).filter("begins in ('member', 'item')")
    return whole.join(counts, ["source_file", "split"]).withColumn("nth", F.col("nth") + F.col("earlier")).drop("earlier")
