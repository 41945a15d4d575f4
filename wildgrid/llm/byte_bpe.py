"""Byte-level BPE encoding and decoding by a given table of ranks.

A text is cut by the tokenizer's pattern, and each piece is merged on its own. A segment
tree over the byte positions of a piece stores, at each node, the leftmost pair of least
rank below it. The root names the next merge; a merge changes three leaves (the merged
pair, its left live neighbour, and the swallowed right one), each in logarithmic time.

Ids leave as packed little-endian 32-bit numbers, the usual form of training shards.

NULL counts as the empty text, which has no ids. Repeated rows are encoded one by one,
other columns pass through, and an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wildgrid.llm.common import bound_batches, whole_text

# A node of the tree packs rank and position into one number; this one stands for no pair.
_NONE = 1 << 80
# Merged pieces that a worker remembers: so many new ones, and as many that were met before those.
CACHE_ENTRIES = 250_000
CACHE_PIECE = 64
# Pieces of a text that are joined at a time.
_PIECES = 1 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in lines if line.strip())}


def merge_piece(piece: bytes, ranks: dict[bytes, int], longest: int) -> list[int]:
    """Ids of one piece; pairs merge in order of rank, leftmost first."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    bits = (n - 1).bit_length()
    size = 1 << bits
    position = size - 1
    rank_of = ranks.get
    tree = [_NONE] * (2 * size)
    for i in range(n - 1):
        rank = rank_of(piece[i : i + 2])
        if rank is not None:
            tree[size + i] = rank << bits | i
    for at in range(position, 0, -1):
        left, right = tree[2 * at], tree[2 * at + 1]
        tree[at] = left if left < right else right
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    while (least := tree[1]) != _NONE:
        start = least & position
        swallowed = after[start]
        end = after[swallowed]
        after[start] = end
        # The three leaves that change; a pair longer than any token has no rank.
        tree[size + swallowed] = tree[size + start] = _NONE
        changed = [swallowed, start]
        if end < n:
            before[end] = start
            if after[end] - start <= longest and (rank := rank_of(piece[start : after[end]])) is not None:
                tree[size + start] = rank << bits | start
        previous = before[start]
        if previous >= 0:
            changed.append(previous)
            rank = rank_of(piece[previous:end]) if end - previous <= longest else None
            tree[size + previous] = _NONE if rank is None else rank << bits | previous
        # Upwards from each leaf, as far as a node changes.
        for at in changed:
            at = (at + size) >> 1
            while at:
                least, right = tree[2 * at], tree[2 * at + 1]
                if right < least:
                    least = right
                if tree[at] == least:
                    break
                tree[at] = least
                at >>= 1
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at : after[at]]])
        at = after[at]
    return ids


class Tokenizer:
    """Encoder and decoder of one worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.longest = max(map(len, ranks), default=0)
        self.pattern = regex.compile(pattern)
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.pieces = _Pieces(self)

    def packed(self, piece: str) -> bytes:
        ids = merge_piece(piece.encode(), self.ranks, self.longest)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        if len(text) <= _PIECES:
            return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))
        out = bytearray()
        for match in self.pattern.finditer(text):
            out += self.pieces[match.group()]
        return bytes(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Pieces(dict):
    """Packed ids of pieces met before; merges those that are new.

    When full, it becomes the older half; pieces found there move back to the newer.
    """

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer = tokenizer
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.tokenizer.packed(piece)
        if len(piece) <= CACHE_PIECE:
            if len(self) >= CACHE_ENTRIES:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


_TOKENIZERS: dict[int, Tokenizer] = {}


class ByteBPE:
    """The column functions of one vocabulary.

    The rank table has a fixed size (50,000 entries or so) and is broadcast; the
    executors need not have the file.
    """

    def __init__(self, spark: SparkSession, rank_path: str, pattern: str):
        bound_batches(spark)
        self.vocabulary = spark.sparkContext.broadcast((load_ranks(rank_path), pattern))

    def _tokenizer(self):
        vocabulary = self.vocabulary

        def of_worker() -> Tokenizer:
            key = id(vocabulary.value)
            if key not in _TOKENIZERS:
                _TOKENIZERS.clear()
                _TOKENIZERS[key] = Tokenizer(*vocabulary.value)
            return _TOKENIZERS[key]

        return of_worker

    def encode(self, text: Column) -> Column:
        """Packed ids of a text column."""
        of_worker = self._tokenizer()

        @F.pandas_udf("binary")
        def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            tokenizer = of_worker()
            for texts in batches:
                yield pd.Series([tokenizer.encode(t or "") for t in texts], dtype=object)

        return encoded(text)

    def decode(self, ids: Column) -> Column:
        """Bytes that packed ids stand for."""
        of_worker = self._tokenizer()

        @F.pandas_udf("binary")
        def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            tokenizer = of_worker()
            for packed in batches:
                yield pd.Series([tokenizer.decode(p or b"") for p in packed], dtype=object)

        return decoded(ids)

    def round_trip(self, text: Column) -> Column:
        """Struct of packed ``ids`` and of the ``decoded`` bytes, in one visit to Python."""
        of_worker = self._tokenizer()

        @F.pandas_udf("ids binary, decoded binary")
        def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            tokenizer = of_worker()
            for texts in batches:
                ids = [tokenizer.encode(t or "") for t in texts]
                yield pd.DataFrame({"ids": ids, "decoded": [tokenizer.decode(p) for p in ids]})

        return both(text)


def digests(documents: DataFrame, tokenizer: ByteBPE) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    return (
        documents.select(F.col("doc_id"), tokenizer.round_trip(whole_text("text")).alias("bpe"))
        .select(
            "doc_id",
            F.expr("octet_length(bpe.ids) div 4").cast("long").alias("n_tokens"),
            F.sha2("bpe.ids", 256).alias("ids_sha256"),
            F.sha2("bpe.decoded", 256).alias("decoded_sha256"),
        )
    )
