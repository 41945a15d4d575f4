"""Records of delimited files whose quoted fields may hold line breaks, read by many tasks.

Whether a line begins inside a quoted field depends on all lines before it. What a line does to
that state depends on the line alone: it is a function of two states, and functions compose. A
column expression finds the function of a line, field by field. Each split composes those of its
lines and, once it knows how it begins, joins its lines to records; see ``splits``.

A quote opens a field only at its start. Inside, a doubled quote is a quote, and any other closes
the field, which then ends at the next separator or line end. Quotes elsewhere are plain
characters. Lines end in LF or CR LF; blank lines between records are left out. A file that ends
inside quotes gives its last record as it stands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from wildgrid.sources import splits

QUOTE = '"'


def fields_of(line: Column, sep: str) -> Column:
    """The text between the separators, whether quoted or not."""
    return F.split(line, "\\Q" + sep + "\\E", -1)


def _still_open(inside: Column, field: Column) -> Column:
    """Whether a quoted field goes on after ``field``, a text between two separators."""
    # Left of the doubled quotes is a single one if and only if the field is closed.
    opens = F.startswith(field, F.lit(QUOTE))
    body = F.when(inside, field).when(opens, F.substr(field, F.lit(2)))
    rest = F.replace(body, F.lit(QUOTE * 2), F.lit(""))
    return F.coalesce(~F.contains(rest, F.lit(QUOTE)), F.lit(False))


def open_after(line: Column, sep: str, inside: bool) -> Column:
    """Whether the line ends inside quotes, if it begins as ``inside`` says."""
    scanned = F.aggregate(fields_of(line, sep), F.lit(inside), _still_open)
    return F.when(F.contains(line, F.lit(QUOTE)), scanned).otherwise(F.lit(inside))


def n_fields(record: Column, sep: str) -> Column:
    """Number of fields of a record; separators inside quotes don't count."""
    start = F.struct(F.lit(False).alias("inside"), F.lit(0).alias("n"))

    def step(state: Column, field: Column) -> Column:
        counted = state["n"] + F.when(state["inside"], F.lit(0)).otherwise(F.lit(1))
        return F.struct(_still_open(state["inside"], field).alias("inside"), counted.alias("n"))

    return F.aggregate(fields_of(record, sep), start, step)["n"]


def _states(begins: bool, from_out: np.ndarray, from_in: np.ndarray) -> np.ndarray:
    """State before each line, and after the last: a prefix scan of functions of two states."""
    n = len(from_out)
    fixed = from_out == from_in
    swaps = np.cumsum(np.concatenate([[0], from_out & ~from_in])) & 1
    # After a fixing line the state is known; from there on only swaps count.
    last = np.maximum.accumulate(np.concatenate([[0], np.where(fixed, np.arange(1, n + 1), 0)]))
    known = np.concatenate([[begins], from_out]).astype(np.int64)
    return (known[last] ^ swaps[last] ^ swaps).astype(bool)


def _flags(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(part.column(part.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(bool) for c in ("from_out", "from_in"))


def _compose(value: tuple[bool, bool], part: pa.RecordBatch) -> tuple[bool, bool]:
    flags = _flags(part)
    return tuple(bool(_states(v, *flags)[-1]) for v in value)


def _borders(ends: DataFrame) -> DataFrame:
    """(source_file, split, inside) of the splits that begin or end inside quotes."""
    here = Window.partitionBy("source_file").orderBy("split")
    fixed = F.col("from_out") == F.col("from_in")
    swap = (F.col("from_out") & ~F.col("from_in")).cast("int")
    ends = ends.withColumn("swaps", F.bit_xor(swap).over(here.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    known = F.when(fixed, F.col("from_out").cast("int").bitwiseXOR(F.col("swaps")))
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    state = F.coalesce(F.last(known, ignorenulls=True).over(before), F.lit(0)).bitwiseXOR(
        F.coalesce(F.last("swaps").over(before), F.lit(0)))
    ends = ends.withColumn("inside", state == 1)
    after = F.when(F.col("inside"), F.col("from_in")).otherwise(F.col("from_out"))
    return ends.filter(F.col("inside") | after).select("source_file", "split", "inside")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(source_file, split, place, unit, whole, opens): records, and what of them crosses a border."""
    now, place, begins, header = None, 0, False, False
    held: list[str] = []
    holds_start = False

    def fragment() -> pa.RecordBatch:
        return rows(now, [place], pa.array(["\n".join(held)], pa.string()), False, holds_start)

    def rows(at, places, units, whole, opens) -> pa.RecordBatch:
        n = len(units)
        return pa.RecordBatch.from_arrays(
            [pa.array([at[0]] * n, pa.string()), pa.array([at[1]] * n, pa.int64()), pa.array(places, pa.int64()),
             units, pa.array([whole] * n), pa.array([opens] * n)],
            names=["source_file", "split", "place", "unit", "whole", "opens"],
        )

    for batch in batches:
        for file, split, part in splits.by_split(batch):
            if (file, split) != now:
                if held:
                    yield fragment()
                now, place, held = (file, split), 0, []
                begins = part.column(part.schema.get_field_index("inside"))[0].as_py() or False
                holds_start, header = False, split == 0
            states = _states(begins, *_flags(part))
            begins = bool(states[-1])
            inside, after = states[:-1], states[1:]
            lines = part.column(2)
            single = ~inside & ~after
            if header:
                # The first line that is not blank is the header.
                first = next((k for k, line in enumerate(lines) if line.as_py().strip()), None)
                if first is not None:
                    single[first], header = False, False
            alone = np.flatnonzero(single)
            if len(alone):
                yield rows(now, place + alone, lines.take(pa.array(alone)), True, True)
            for at in np.flatnonzero(inside | after).tolist():
                if not inside[at]:
                    held, holds_start = [], True
                held.append(lines[at].as_py())
                if not after[at]:
                    # A record that began in an earlier split ends here.
                    yield rows(now, [place + at], pa.array(["\n".join(held)], pa.string()), holds_start, holds_start)
                    held, holds_start = [], True
            place += part.num_rows
    if held:
        yield fragment()


def read_records(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """(source_file, split, place, record) of every record below the header, the first line of each file.

    ``split`` and ``place`` give the order inside the file. The header may not hold line breaks.
    """
    lines = splits.read_lines(spark, path, "\n")
    text = F.when(F.endswith("line", F.lit("\r")), F.expr("left(line, length(line) - 1)")).otherwise(F.col("line"))
    lines = lines.withColumn("line", text)
    lines = lines.withColumns({"from_out": open_after(F.col("line"), sep, False), "from_in": open_after(F.col("line"), sep, True)})
    # Only the functions of the lines go through this pass, not the lines.
    ends = splits.summaries(
        lines.select("source_file", "split", "from_out", "from_in"), _compose, (False, True), "from_out boolean, from_in boolean"
    )
    placed = splits.with_starts(lines, _borders(ends)).select("source_file", "split", "line", "from_out", "from_in", "inside")

    def units(some: DataFrame) -> DataFrame:
        return some.mapInArrow(_cut, f"{splits.PLACE}, place long, unit string, whole boolean, opens boolean")

    # A second look at the few splits at whose borders a record is cut.
    crossing = splits.joined_fragments(units(placed.filter("inside is not null")).filter("not whole"), "\n")
    order = ["source_file", "split", "place"]
    records = units(placed).filter("whole").select(*order, "unit").unionByName(crossing.select(*order, "unit"))
    return records.filter(F.trim("unit") != "").withColumnRenamed("unit", "record")
