"""The trie of conversation prefixes, by collapsing whole sequences.

A node is a distinct sequence of the first turns of a conversation. Conversations that are alike
from start to end are one weighted sequence with the list of its ids. A sequence that is the
proper prefix of another is dropped by an anti-join, and what is left are the leaves of the trie.
All counts are aggregates of the weighted prefixes: a prefix adds its weight to its node once per
sequence, however many conversations share the sequence.

- A sequence has the exclusive-or of the 128-bit hashes of its (place, role, text) triples as its
  identity, so the identities of all prefixes are running totals over the turns. They are taken
  in blocks of turns, then over the totals of the blocks.
- The sum over a subtree needs no walk: every node is counted on one path only, that of its leaf
  with the smallest id. The sum from a depth to the end of each path, added up over the paths
  through a node, is the sum over its subtree.

Every step is linear in the turns of the distinct sequences. No step has the texts but the first,
which puts the turns in order by range partitions, so that one conversation may hold any share of
the turns. Lists of ids are cut into bounded chunks and hashed as a stream.

Turns are ordered by turn, NULL first, then role and text; NULL role and text are empty. Repeated
rows are turns of their own. Rows without a conversation id are left out. An empty table gives an
empty one, without a root. Other columns take no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from wildgrid.llm.common import bound_batches, col, with_places, written

# Turns of a block, and ids of a chunk, as powers of two.
BLOCK_BITS, CHUNK_BITS = 10, 12
NODE = ["depth", "k1", "k2"]
# Characters of role and text that the range partitions are cut by.
_RANGE_CHARS = 64


def running(rows: DataFrame, key: str, at: str, totals: dict[str, tuple]) -> DataFrame:
    """Add running totals by ``key`` in the order of ``at``, a whole number without gaps or repeats.

    ``totals`` names (column, aggregate, how to join two totals). A key with many rows is cut
    into blocks; only one row per block is ordered as a whole.
    """
    rows = rows.withColumn("_block", F.shiftright(at, BLOCK_BITS))
    up_to = Window.partitionBy(key, "_block").orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = rows.select("*", *[agg(c).over(up_to).alias(f"_in_{name}") for name, (c, agg, _) in totals.items()])
    blocks = rows.groupBy(key, "_block").agg(*[agg(c).alias(name) for name, (c, agg, _) in totals.items()])
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(key, "_block", *[
        F.coalesce(agg(name).over(before), F.lit(0)).alias(f"_to_{name}") for name, (_, agg, _) in totals.items()
    ])
    added = [both(F.col(f"_in_{name}"), F.col(f"_to_{name}")).alias(name) for name, (_, _, both) in totals.items()]
    return inside.join(blocks, [key, "_block"]).select(*[c for c in rows.columns if c != "_block"], *added)


def _xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def ordered_turns(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """(c, at, u1, u2, bytes): the turns in order, with hashes in place of role and text."""
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("c"), col("turn").alias("turn"),
        F.coalesce(col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(col("text").cast("string"), F.lit("")).alias("text"),
    )
    ranges = [F.col("c"), F.col("turn"), F.left("role", F.lit(_RANGE_CHARS)), F.left("text", F.lit(_RANGE_CHARS))]
    hashed = [F.xxhash64("role", "text").alias("u1"), F.xxhash64(F.lit("second"), "text", "role").alias("u2"),
              F.octet_length("text").cast("long").alias("bytes")]
    rows = turns.select("c", "turn", "role", "text", *hashed)
    placed = with_places(spark, rows, ["c"], ["turn", "role", "text"], "at", ranges, ["c", "u1", "u2", "bytes"])
    return written(spark, placed, "turns")


def rebuilt(turns: DataFrame, shared: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Turns (c, depth, u1, u2, bytes) of the rebuilt conversations, and all ids (c).

    Conversation c begins with the first h turns of c - c % ``shared``, h being the CRC of its
    id modulo ``most``, and goes on with its own turns after its first h.
    """
    convs = turns.groupBy("c").agg((F.max("at") + 1).alias("n"))
    head = (F.crc32(F.col("c").cast("string").cast("binary")) % most).alias("h")
    plan = convs.select("c", "n", (F.col("c") - F.col("c") % shared).alias("base"), head)
    bases = convs.select(F.col("c").alias("base"), F.col("n").alias("n_base"))
    taken = F.least("h", F.coalesce("n_base", F.lit(0))).alias("taken")
    plan = plan.join(bases, "base", "left").select("c", "base", "h", taken)
    own = turns.join(plan, "c").filter(F.col("at") >= F.col("h")).select(
        "c", (F.col("taken") + F.col("at") - F.col("h") + 1).alias("depth"), "u1", "u2", "bytes"
    )
    heads = turns.filter((F.col("at") < most - 1) & (F.col("c") % shared == 0)).withColumnRenamed("c", "base")
    begun = heads.join(plan, "base").filter(F.col("at") < F.col("h")).select(
        "c", (F.col("at") + 1).alias("depth"), "u1", "u2", "bytes"
    )
    return own.unionByName(begun), plan.select("c")


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the chunks of each node, joined by commas; rows come sorted by node and chunk."""
    node, digest = None, None

    def row(node: tuple, digest) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({
            "depth": pa.array([node[0]], pa.int64()), "k1": pa.array([node[1]], pa.int64()),
            "k2": pa.array([node[2]], pa.int64()), "ends_sha256": pa.array([digest.hexdigest()]),
        })

    for batch in batches:
        for depth, k1, k2, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if (depth, k1, k2) != node:
                if node is not None:
                    yield row(node, digest)
                node, digest = (depth, k1, k2), sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
    if node is not None:
        yield row(node, digest)


def end_lists(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, chunk, ids) of (c, depth, k1, k2): ascending ids, a bounded number in a row."""
    listed = F.transform(F.array_sort(F.collect_list("c")), lambda c: c.cast("string"))
    chunk = F.shiftright("c", CHUNK_BITS).alias("chunk")
    return ends.groupBy(*NODE, chunk).agg(F.concat_ws(",", listed).alias("ids"))


def prefix_nodes(spark: SparkSession, turns: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes of the trie of the sequences (c, depth, u1, u2, bytes), and (c, NODE) where each ends.

    ``ids`` has every c, so also those without turns. Nodes have NODE as their identity.
    """
    f1 = F.xxhash64("depth", "u1", "u2").alias("f1")
    f2 = F.xxhash64(F.lit("second"), "u2", "depth", "u1").alias("f2")
    prefixes = running(
        turns.select("c", "depth", "bytes", f1, f2), "c", "depth",
        {"k1": ("f1", F.bit_xor, _xor), "k2": ("f2", F.bit_xor, _xor)},
    )
    # The node above is the same total without the last turn.
    prefixes = prefixes.select(
        "c", *NODE, "bytes", _xor(F.col("k1"), F.col("f1")).alias("up1"), _xor(F.col("k2"), F.col("f2")).alias("up2")
    )
    prefixes = written(spark, prefixes, "prefixes")
    last = prefixes.groupBy("c").agg(F.max(F.struct(*NODE)).alias("last"))
    ends = ids.join(last, "c", "left").select("c", *[F.coalesce(f"last.{k}", F.lit(0)).cast("long").alias(k) for k in NODE])
    ends = written(spark, ends, "ends")

    # Whole sequences, each with its weight; the smallest id stands for all.
    sequences = written(spark, ends.groupBy(*NODE).agg(F.count(F.lit(1)).alias("weight"), F.min("c").alias("c")), "sequences")
    whole = sequences.select("c", "weight", F.col("depth").alias("length"))
    nothing = F.lit(0).cast("long")
    roots = whole.select("c", *[nothing.alias(k) for k in NODE], nothing.alias("bytes"),
                         F.lit(None).cast("long").alias("up1"), F.lit(None).cast("long").alias("up2"), "weight", "length")
    steps = written(spark, prefixes.join(whole, "c").unionByName(roots), "steps")
    proper = steps.filter("depth < length").select(*NODE).distinct()
    leaves = sequences.join(proper, NODE, "left_anti").select("c", F.lit(True).alias("leaf"))
    steps = written(spark, steps.join(leaves, "c", "left"), "steps")

    nodes = steps.groupBy(*NODE).agg(
        F.sum("weight").alias("n_convs"), F.min("c").alias("conv_id"), F.max("bytes").alias("bytes"),
        F.max("up1").alias("up1"), F.max("up2").alias("up2"),
        F.count("leaf").alias("n_leaves"), F.min(F.when(F.col("leaf"), F.col("c"))).alias("path"),
    )
    nodes = written(spark, nodes, "nodes")

    # What each node saves, on the path of its leaf with the smallest id.
    saved = nodes.select(F.col("path").alias("c"), "depth", ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    paths = steps.filter("leaf").join(saved, ["c", "depth"], "left")
    paths = paths.select("c", *NODE, (F.col("length") - F.col("depth")).alias("left"), F.coalesce("saved", F.lit(0)).alias("saved"))
    below = running(paths, "c", "left", {"to_end": ("saved", F.sum, lambda a, b: a + b)})
    below = below.groupBy(*NODE).agg(F.sum("to_end").alias("saved_tokens"))

    up = (F.col("depth") - 1).alias("depth"), F.col("up1").alias("k1"), F.col("up2").alias("k2")
    children = nodes.filter("depth > 0").select(*up).groupBy(*NODE).agg(F.count(F.lit(1)).alias("n_children"))
    # The root has most children of all; its id is one value for them.
    root = nodes.filter("depth = 0").agg(F.min("conv_id").alias("id")).scalar()
    above = nodes.filter("depth > 0").select(
        F.col("depth").alias("above"), F.col("k1").alias("up1"), F.col("k2").alias("up2"), F.col("conv_id").alias("parent")
    )
    full = (
        nodes.join(below, NODE, "left").join(children, NODE, "left")
        .withColumn("above", F.when(F.col("depth") > 1, F.col("depth") - 1))
        .join(above, ["above", "up1", "up2"], "left")
    )
    return full.select(
        *NODE, "conv_id", F.when(F.col("depth") == 1, root).otherwise(F.col("parent")).alias("parent_conv_id"),
        "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves",
        F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"),
    ), ends


def digests(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """Every node of the trie of the rebuilt conversations, with the digest of the ids that end there."""
    bound_batches(spark)
    turns, ids = rebuilt(ordered_turns(spark, conversations))
    nodes, ends = prefix_nodes(spark, turns, ids)
    lists = end_lists(ends).repartition(*NODE).sortWithinPartitions(*NODE, "chunk").select(*NODE, "ids")
    hashed = lists.mapInArrow(_streamed, "depth long, k1 long, k2 long, ends_sha256 string")
    return nodes.join(hashed, NODE, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
