"""A Merkle manifest of a dataset, with a proof for every row, by a butterfly exchange.

A row's leaf is the SHA-256 of its fields, each with its length. The leaves of a group, in the
order of the key, are hashed in runs of ``fanout`` up to the group's subroot, and the subroots,
in the order of the groups, up to the root. The proof of a row is the other nodes of its run at
every level; with them the root is computed again from the row alone.

- Leaves are put in order by range partitions, so that a group with most of the rows is in many
  tasks, and cut into blocks of ``fanout ** height`` leaves of one group. Each block hashes its
  own subtree.
- Then the blocks exchange subtree roots, round by round. In a round, the subtrees of a run swap
  their roots: each block sends its root to the blocks of equal place in the other subtrees of
  the run (a smaller subtree takes turns), and each hashes the run. So all blocks of a subtree
  compute its root, each receives ``fanout`` roots a round, and each holds all its upper proofs
  when the last round is over: nothing has to be passed down.
- Last, each block opens the proofs of its leaves.

Every round is one shuffle of short rows and is written to the shared folder. The texts are
read once. Nothing but the numbers of groups and of blocks reaches the driver.

NULL fields are hashed as ``-``, unlike empty ones. A NULL group is a group, the first one.
Rows of equal keys are ordered by their leaves, a NULL key is the first; a repeated row is a
leaf for every time. An empty table gives an empty one. Columns that are not named take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from wildgrid.llm.common import bound_batches, col, with_places, written

FANOUT = 16
HEIGHT = 3
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
# A level of a proof: the hashes of the other nodes, joined, and the node's place among them.
PATH = "array<struct<place:int, others:string>>"
_HEX = 64


def leaf_hash(values: list[Column]) -> Column:
    """SHA-256 of the values, each as its byte count, a colon and its text, or ``-`` for NULL."""
    texts = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def joined_hash(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def subtree(leaves: list[str], rounds: int, fanout: int) -> list[list[str]]:
    """The nodes of every level, from the leaves to the level after so many rounds."""
    levels = [leaves]
    for _ in range(rounds):
        below = levels[-1]
        levels.append([joined_hash(below[i : i + fanout]) for i in range(0, len(below), fanout)])
    return levels


def others_of(level: list[str], place: int, fanout: int) -> tuple[int, str]:
    """Place of a node in its run, and the joined hashes of the others."""
    start = place - place % fanout
    return place - start, "".join(level[start:place]) + "".join(level[place + 1 : start + fanout])


def fold(leaf: str, path: list[tuple[int, str]]) -> str:
    """The root that a leaf and its proof lead to."""
    for place, others in path:
        leaf = sha256(f"{others[: place * _HEX]}{leaf}{others[place * _HEX :]}".encode()).hexdigest()
    return leaf


def _rounds(n: int, fanout: int) -> int:
    """Rounds until one node is left of n."""
    count = 0
    while n > 1:
        n, count = -(-n // fanout), count + 1
    return count


def _div(n: Column, size: int) -> Column:
    return F.call_function("div", n, F.lit(size).cast("long"))


def _up(n: Column, size: int) -> Column:
    return _div(n + F.lit(size - 1), size)


def _own(column: str) -> Column:
    return F.max(F.col(f"me.{column}")).alias(column)


def exchange(state: DataFrame, fanout: int) -> DataFrame:
    """One round: the subtrees of each run swap their roots.

    ``state`` has a row for each block: its number ``p``, the root ``hash`` of its subtree, the
    ``path`` so far, and the run: ``nodes``, the (lo, size) of each subtree in blocks, and
    ``mine``, its own among them. Other columns are kept.
    """
    kept = [c for c in state.columns if c not in ("p", "hash", "nodes", "mine")]
    sent = state.select("*", F.posexplode("nodes").alias("to", "node"))
    own = F.get("nodes", F.col("mine"))
    place = F.col("p") - own["lo"]
    # Blocks of equal place; those beyond a smaller subtree are served by its blocks in turn.
    peers = F.when(
        place < F.col("node.size"),
        F.transform(F.sequence(place, F.col("node.size") - 1, own["size"]), lambda x: x + F.col("node.lo")),
    )
    me = F.when(F.col("to") == F.col("mine"), F.struct(*kept, "mine"))
    messages = sent.select(
        F.explode(F.when(F.col("to") == F.col("mine"), F.array("p")).otherwise(peers)).alias("p"),
        F.struct(F.col("mine").alias("from"), "hash").alias("root"),
        me.alias("me"),
    )
    got = messages.groupBy("p").agg(
        F.array_sort(F.collect_list("root")).alias("run"), *[_own(c) for c in [*kept, "mine"]]
    )
    others = F.filter("run", lambda r: r["from"] != F.col("mine"))
    level = F.struct(F.col("mine").alias("place"), F.concat_ws("", others["hash"]).alias("others"))
    kept_columns = [F.col(c) for c in kept if c != "path"]
    return got.select(
        "p", *kept_columns, F.sha2(F.concat_ws("", F.col("run")["hash"]), 256).alias("hash"),
        F.concat("path", F.array(level)).cast(PATH).alias("path"),
    )


def _blocks(spark: SparkSession, leaves: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Leaves collected by block, and a row per group: its rank, leaves, blocks and first block."""
    rows = with_places(spark, leaves, ["grp"], ["key", "leaf", "salt"], "at")
    groups = written(spark, rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n")), "groups")
    ranked = with_places(spark, groups.withColumn("blocks", _up(F.col("n"), block)), [], ["grp"], "rank")
    # Running total in slices of ranks, so that many groups are no single task.
    ranked = ranked.withColumn("slice", F.shiftright("rank", 16))
    total = ranked.groupBy("slice").agg(F.sum("blocks").alias("total"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    total = total.select("slice", F.coalesce(F.sum("total").over(earlier(Window.orderBy("slice"))), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("blocks").over(earlier(Window.partitionBy("slice").orderBy("rank"))), F.lit(0))
    groups = ranked.withColumn("inside", inside).join(total, "slice").select(
        F.col("grp").alias("of"), "rank", "n", "blocks", (F.col("base") + F.col("inside")).alias("first")
    )
    groups = written(spark, groups, "groups")
    rows = rows.join(groups, F.col("grp").eqNullSafe(F.col("of")))
    leaf = F.struct((F.col("at") % block).alias("at"), "key", "leaf", "changed")
    blocks = rows.groupBy((F.col("first") + _div(F.col("at"), block)).alias("p"), "rank", "n", "first", "blocks").agg(
        F.array_sort(F.collect_list(leaf)).alias("leaves")
    )
    return written(spark, blocks, "blocks"), groups


def _opened(
    spark: SparkSession, documents: DataFrame, key: str, group: str, fields: list[str], changed: Column | None,
    fanout: int, height: int,
) -> tuple[DataFrame, Callable]:
    """Blocks of leaves with their upper proofs, and a reader of the rows of Arrow batches."""
    bound_batches(spark)
    leaves = documents.select(
        col(group).alias("grp"), col(key).alias("key"), leaf_hash([col(f) for f in fields]).alias("leaf"),
        (F.lit(None).cast("string") if changed is None else changed).alias("changed"),
        F.monotonically_increasing_id().alias("salt"),
    )
    leaves = written(spark, leaves, "leaves")
    block = fanout**height
    blocks, groups = _blocks(spark, leaves, block)

    def levels_of(n: int, hashes: list[str]) -> list[list[str]]:
        return subtree(hashes, min(height, _rounds(n, fanout)), fanout)

    def rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = [levels_of(n, hashes)[-1][0] for n, hashes in zip(*(c.to_pylist() for c in batch.columns[5:]))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(roots)],
                                             names=["p", "rank", "first", "blocks", "path", "hash"])

    kind = f"p long, rank long, first long, blocks long, path {PATH}, hash string"
    none = F.array().cast(PATH).alias("path")
    state = blocks.select("p", "rank", "first", "blocks", none, "n", F.col("leaves")["leaf"].alias("hashes")).mapInArrow(rooted, kind)
    state = written(spark, state, "round")
    size = groups.agg(F.coalesce(F.max("blocks"), F.lit(0)).alias("blocks"), F.count(F.lit(1)).alias("groups")).first()

    for step in range(_rounds(size["blocks"], fanout)):
        width = fanout**step
        node = _div(F.col("p") - F.col("first"), width)
        run = node - node % fanout
        count = _up(F.col("blocks"), width)
        lo = F.transform(F.sequence(run, F.least(run + fanout, count) - 1), lambda j: j * width)
        nodes = F.transform(lo, lambda x: F.struct(
            (F.col("first") + x).alias("lo"), F.least(F.lit(width), F.col("blocks") - x).alias("size")))
        alone = count <= 1
        active = state.filter(~alone).select("*", nodes.alias("nodes"), (node % fanout).cast("int").alias("mine"))
        state = written(spark, exchange(active, fanout).unionByName(state.filter(alone)), "round")

    state = state.withColumn("subroot", F.col("hash"))
    for step in range(_rounds(size["groups"], fanout)):
        width = fanout**step
        nodes = groups.groupBy(_div(F.col("rank"), width).alias("node")).agg(
            F.min("first").alias("lo"), F.sum("blocks").alias("size"))
        runs = nodes.groupBy(_div(F.col("node"), fanout).alias("run")).agg(
            F.array_sort(F.collect_list(F.struct("node", "lo", "size"))).alias("nodes"))
        active = state.withColumn("run", _div(F.col("rank"), width * fanout)).join(runs, "run").drop("run")
        active = active.withColumn("mine", (_div(F.col("rank"), width) % fanout).cast("int"))
        state = written(spark, exchange(active, fanout), "round")

    upper = state.select("p", "subroot", F.col("hash").alias("root"), "path")
    joined = blocks.join(upper, "p").select("n", "leaves", "subroot", "root", "path")

    def read(batch: pa.RecordBatch) -> Iterator[tuple]:
        """key, leaf, changed leaf, subroot, root and path of every row."""
        for n, leaves, subroot, root, above in zip(*(c.to_pylist() for c in batch.columns)):
            levels = levels_of(n, [leaf["leaf"] for leaf in leaves])[:-1]
            above = [(u["place"], u["others"]) for u in above]
            # Levels over the leaves are the same for a whole run.
            shared: dict[int, list] = {}
            for i, leaf in enumerate(leaves):
                run = i // fanout
                if run not in shared:
                    shared[run] = [others_of(level, i // fanout**k, fanout) for k, level in enumerate(levels) if k] + above
                path = [others_of(levels[0], i, fanout)] if levels else []
                yield leaf["key"], leaf["leaf"], leaf["changed"], subroot, root, path + shared[run]

    return joined, read


def proofs(
    spark: SparkSession, documents: DataFrame, key: str = "doc_id", group: str = "source",
    fields: list[str] = FIELDS, fanout: int = FANOUT, height: int = HEIGHT,
) -> DataFrame:
    """(key, leaf, subroot, root, path) of every row; ``fold`` leads from a leaf along its path to the root."""
    joined, read = _opened(spark, documents, key, group, fields, None, fanout, height)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = pa.list_(pa.struct([("place", pa.int32()), ("others", pa.string())]))
        for batch in batches:
            rows = [(k, leaf, s, r, [{"place": a, "others": o} for a, o in p]) for k, leaf, _, s, r, p in read(batch)]
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], of_key), *[pa.array(c, pa.string()) for c in columns[1:4]], pa.array(columns[4], path)],
                names=["key", "leaf", "subroot", "root", "path"],
            )

    from pyspark.sql.pandas.types import to_arrow_type

    of_key = to_arrow_type(documents.schema[key].dataType)
    kind = documents.schema[key].dataType.simpleString()
    rows = joined.mapInArrow(listed, f"key {kind}, leaf string, subroot string, root string, path {PATH}")
    return rows.withColumnRenamed("key", key)


def _tampered() -> Column:
    """The leaf of a row whose text was lower-cased, for every fifth id by CRC."""
    number = F.col("doc_id").cast("string")
    low = F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    leaf = leaf_hash([low if f == "text" else F.col(f) for f in FIELDS])
    return F.when(F.crc32(number.cast("binary")) % 5 == 0, leaf)


def digests(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """leaf, subroot, root, digest of the proof, and the root from tampered rows, of every document."""
    documents = documents.withColumn("doc_id", F.col("doc_id").cast("long"))
    joined, read = _opened(spark, documents, "doc_id", "source", FIELDS, _tampered(), FANOUT, HEIGHT)
    names = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, leaf, changed, subroot, root, path in read(batch):
                proof = joined_hash([others for _, others in path])
                rows.append((key, leaf, subroot, root, proof, fold(changed or leaf, path)))
            columns = list(zip(*rows)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), *[pa.array(c, pa.string()) for c in columns[1:]]], names=["doc_id", *names]
            )

    rows = joined.mapInArrow(digested, "doc_id long, " + ", ".join(f"{c} string" for c in names))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
