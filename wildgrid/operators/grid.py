"""Two-level equal-area grid: point to cell, and polygon to cells.

The globe is cut into 180 one-degree rows. A row holds about 360*cos(latitude)
columns, so a coarse cell covers about 12,364 km2 anywhere; each coarse cell is
cut 7 x 7 into fine cells of about 252 km2. A fine id starts with its coarse id.
Column names keep the resolution numbers users filter by, 3 and 5.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

ROWS = 180
SPLIT = 7


def _columns_in_row(row: Column) -> Column:
    return F.greatest(F.lit(1), F.round(360.0 * F.cos(F.radians(row - 89.5))).cast("int"))


def _clamp(value: Column, top: Column | int) -> Column:
    top = top if isinstance(top, Column) else F.lit(top)
    return F.least(F.greatest(F.floor(value).cast("int"), F.lit(0)), top)


def assign_cells(points: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Add ``h3_r3`` and ``h3_r5``, the coarse and fine cell of each point."""
    row = _clamp(F.col(lat) + 90.0, ROWS - 1)
    stepped = (
        points.withColumn("_row", row)
        .withColumn("_width", _columns_in_row(F.col("_row")))
        .withColumn("_across", (F.col(lon) + 180.0) / 360.0 * F.col("_width"))
        .withColumn("_col", _clamp(F.col("_across"), F.col("_width") - 1))
    )
    coarse = F.concat_ws("_", F.col("_row").cast("string"), F.col("_col").cast("string"))
    fine = F.concat_ws(
        "_",
        coarse,
        _clamp((F.col(lat) + 90.0 - F.col("_row")) * float(SPLIT), SPLIT - 1).cast("string"),
        _clamp((F.col("_across") - F.col("_col")) * float(SPLIT), SPLIT - 1).cast("string"),
    )
    located = F.col(lat).isNotNull() & F.col(lon).isNotNull()
    return (
        stepped.withColumn("h3_r3", F.when(located, coarse))
        .withColumn("h3_r5", F.when(located, fine))
        .drop("_row", "_width", "_across", "_col")
    )


def cell_number(cell: str) -> Column:
    """A coarse cell as a number below 64,800; an id of another form is an error."""
    parts = F.split(F.col(cell), "_")
    return parts[0].cast("long") * 360 + parts[1].cast("long")


def polygon_edges(features: DataFrame, key: str = "eco_id") -> DataFrame:
    """Edge table (key, part, x1, y1, x2, y2) of features with a ``parts`` column.

    ``parts`` is the multi-polygon nesting: parts, rings, points, [lon, lat].
    """
    rings = features.select(key, F.posexplode("parts").alias("part", "rings")).select(
        key, "part", F.explode("rings").alias("ring")
    )
    last = F.size("ring") - 1
    pairs = F.transform(
        F.slice("ring", F.lit(1), last),
        lambda p, i: F.struct(p.alias("a"), F.get(F.col("ring"), i + 1).alias("b")),
    )
    return (
        rings.filter(F.size("ring") > 1)
        .select(key, "part", F.explode(pairs).alias("e"))
        .select(
            key,
            "part",
            F.col("e.a")[0].alias("x1"),
            F.col("e.a")[1].alias("y1"),
            F.col("e.b")[0].alias("x2"),
            F.col("e.b")[1].alias("y2"),
        )
    )


def cover_polygons(features: DataFrame, key: str = "eco_id", resolution: int = 3) -> DataFrame:
    """Distinct (key, cell) pairs of cells whose centre lies in the polygon.

    Each edge is sent to the rows whose centre line it crosses, and there to the
    first cell centre east of the crossing. Walking east, the centre at an odd
    number of crossings is inside; so an odd crossing opens a run of cells and
    the next closes it. Equal crossings cancel in pairs and are counted before
    the ordering step, which leaves at most one entry per cell of a row however
    many edges the polygon has. Holes are rings of the same part; overlapping
    parts meet in the final distinct.
    """
    split = 1 if resolution == 3 else SPLIT
    name = "h3_r3" if resolution == 3 else "h3_r5"

    # Row centre lines are at (line + 0.5) / split - 90; an edge spans [low, high).
    def first_line(lat: Column) -> Column:
        return F.ceil((lat + 90.0) * split - 0.5).cast("int")

    def line_lat(line: Column) -> Column:
        return (line + 0.5) / split - 90.0

    edges = polygon_edges(features, key).filter(F.col("y1") != F.col("y2"))
    lines = (
        edges.withColumn("low", F.least("y1", "y2"))
        .withColumn("high", F.greatest("y1", "y2"))
        .withColumn("from", F.greatest(first_line(F.col("low")), F.lit(0)))
        .withColumn("to", F.least(first_line(F.col("high")) - 1, F.lit(ROWS * split - 1)))
        .filter(F.col("from") <= F.col("to"))
        .withColumn("line", F.explode(F.sequence("from", "to")))
    )
    width = _columns_in_row(F.floor(F.col("line") / split).cast("int")) * split
    crossings = (
        lines.withColumn("width", width)
        .withColumn(
            "x",
            F.col("x1")
            + (line_lat(F.col("line")) - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")),
        )
        .withColumn("guess", F.ceil((F.col("x") + 180.0) / 360.0 * F.col("width") - 0.5).cast("int"))
    )

    def centre(column: Column) -> Column:
        return -180.0 + (column + 0.5) / F.col("width") * 360.0

    # Rounding may put the guess one cell off; settle it on the centre itself.
    settled = (
        F.when(centre(F.col("guess")) <= F.col("x"), F.col("guess") + 1)
        .when(centre(F.col("guess") - 1) > F.col("x"), F.col("guess") - 1)
        .otherwise(F.col("guess"))
    )
    toggles = (
        crossings.withColumn("start", F.least(F.greatest(settled, F.lit(0)), F.col("width")))
        .groupBy(key, "part", "line", "width", "start")
        .agg((F.count("*") % 2).alias("odd"))
        .filter("odd = 1")
    )
    along = Window.partitionBy(key, "part", "line").orderBy("start")
    runs = (
        toggles.withColumn("stop", F.coalesce(F.lead("start").over(along), F.col("width")))
        .withColumn("nth", F.row_number().over(along))
        .filter((F.col("nth") % 2 == 1) & (F.col("start") < F.col("stop")))
        .select(key, "line", F.explode(F.sequence(F.col("start"), F.col("stop") - 1)).alias("column"))
    )
    return runs.select(key, _cell_id(F.col("line"), F.col("column"), split).alias(name)).distinct()


def _cell_id(line: Column, column: Column, split: int) -> Column:
    if split == 1:
        return F.concat_ws("_", line.cast("string"), column.cast("string"))
    parts = [F.floor(line / split), F.floor(column / split), line % split, column % split]
    return F.concat_ws("_", *[p.cast("int").cast("string") for p in parts])


def cell_sets(cells: DataFrame, key: str = "eco_id") -> DataFrame:
    """One row per feature with the set of its cells; a grid row count bounds the set."""
    return cells.groupBy(key).agg(F.array_sort(F.collect_set("h3_r3")).alias("cells"))
