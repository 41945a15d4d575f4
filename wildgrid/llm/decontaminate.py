"""Benchmark decontamination by Wu-Manber search for word windows.

Every benchmark item gives its windows of ``length`` consecutive words (an item of fewer
words is one window). Windows of equal length are searched together: a table of word
pairs says how far the search may jump when it sees a pair that no window has near its
end; where the shift is zero, the bucket of that closing pair is compared with the text.

Documents are searched where they are read, without a shuffle. The windows of one block
of items are broadcast; a block holds at most ``block_words`` benchmark words, and a larger
benchmark is searched in several blocks whose results are written in between.

NULL and empty texts have no words, and nothing is found in them. Repeated rows are
searched one by one. Items that share an id are one item; an item without an id marks
words but is not listed. Empty tables give no hits, or no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wildgrid.llm.common import LOWER_AZ, bound_batches, col, whole_text, written

# What separates words: every ASCII character but digits and lower-case letters.
_WORD_TABLE = bytes(
    c if c in b"0123456789abcdefghijklmnopqrstuvwxyz" or c >= 0x80 else 0x20 for c in LOWER_AZ
)

HITS = "n_words long, spans array<struct<first:long,last:long>>, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORD_TABLE).split()


class WuManber:
    """Search for word sequences of one length among the word numbers of a text."""

    def __init__(self, patterns: dict[tuple[int, ...], frozenset[str]], n_words: int):
        self.base = n_words + 1
        self.length = len(next(iter(patterns)))
        self.block = min(2, self.length)
        self.most = self.length - self.block + 1
        self.shift: dict[int, int] = {}
        self.buckets: dict[int, list[tuple[list[int], frozenset[str]]]] = {}
        for pattern, items in patterns.items():
            for end in range(self.block, self.length + 1):
                key = self._key(pattern, end)
                self.shift[key] = min(self.length - end, self.shift.get(key, self.most))
            self.buckets.setdefault(self._key(pattern, self.length), []).append((list(pattern), items))

    def _key(self, words, end: int) -> int:
        return words[end - 1] if self.block == 1 else words[end - 2] * self.base + words[end - 1]

    def search(self, words: list[int]) -> Iterator[tuple[int, frozenset[str]]]:
        """First position and items of every occurrence."""
        length, most, shift, base, single = self.length, self.most, self.shift.get, self.base, self.block == 1
        end, n = length, len(words)
        while end <= n:
            key = words[end - 1] if single else words[end - 2] * base + words[end - 1]
            jump = shift(key, most)
            if jump:
                end += jump
                continue
            first = end - length
            for pattern, items in self.buckets[key]:
                if words[first] == pattern[0] and words[first:end] == pattern:
                    yield first, items
            end += 1


class _Numbers(dict):
    """Word numbers; a word that no window has is 0."""

    def __missing__(self, word: bytes) -> int:
        return 0


class Windows:
    """The searches of one block of items, one for each window length."""

    def __init__(self, items: list[tuple[str | None, str | None]], length: int):
        self.numbers = _Numbers()
        found: dict[int, dict[tuple[int, ...], set[str]]] = {}
        for item, text in items:
            words = words_of(text)
            numbers = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words]
            size = min(length, len(numbers))
            for first in range(len(numbers) - size + 1 if size else 0):
                owners = found.setdefault(size, {}).setdefault(tuple(numbers[first : first + size]), set())
                if item is not None:
                    owners.add(item)
        self.searches = [
            WuManber({p: frozenset(i) for p, i in patterns.items()}, len(self.numbers))
            for _, patterns in sorted(found.items())
        ]

    def hits(self, text: str | None) -> tuple[int, list[tuple[int, int]], list[str]]:
        """Number of words, merged spans of hit words (last one excluded), sorted items."""
        words = list(map(self.numbers.__getitem__, words_of(text)))
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        for search in self.searches:
            for first, owners in search.search(words):
                spans.append((first, first + search.length))
                items |= owners
        return len(words), merged(spans), sorted(items)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def _search(windows, text: Column, before: Column | None) -> Column:
    """The hits of a block, joined to those of the blocks before."""

    def of(texts: pd.Series, earlier) -> pd.DataFrame:
        rows = []
        for k, text in enumerate(texts):
            n, spans, items = windows.value.hits(text)
            if earlier is not None:
                old = [(s["first"], s["last"]) for s in earlier["spans"].iloc[k]]
                spans, items = merged(spans + old), sorted({*items, *earlier["items"].iloc[k]})
            rows.append((n, [{"first": a, "last": b} for a, b in spans], items))
        return pd.DataFrame(rows, columns=["n_words", "spans", "items"])

    if before is None:

        @F.pandas_udf(HITS)
        def first_block(texts: pd.Series) -> pd.DataFrame:
            return of(texts, None)

        return first_block(text)

    @F.pandas_udf(HITS)
    def next_block(texts: pd.Series, earlier: pd.DataFrame) -> pd.DataFrame:
        return of(texts, earlier)

    return next_block(text, before)


def find_windows(
    spark: SparkSession,
    documents: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    length: int = 10,
    block_words: int = 1_000_000,
    hits: str = "hits",
) -> DataFrame:
    """``documents`` with a struct ``hits`` of n_words, spans and items; see HITS.

    Spans count words, the last word excluded; items are ids as text, in the order of
    their characters. ``benchmark`` has item_id and text.
    """
    bound_batches(spark)
    items = benchmark.select(
        F.col("item_id").cast("string").alias("item"), whole_text("text").alias("text")
    )
    # Every word takes two characters, one of them a separator.
    size = items.agg(F.sum((F.length("text") + 1) / 2)).first()[0] or 0
    n_blocks = max(1, -(-int(size) // block_words))
    block = F.pmod(F.xxhash64("text", "item"), F.lit(n_blocks))
    found = documents
    for k in range(n_blocks):
        rows = [(r.item, r.text) for r in items.filter(block == k).collect()]
        windows = spark.sparkContext.broadcast(Windows(rows, length))
        found = found.withColumn(hits, _search(windows, whole_text(text), col(hits) if k else None))
        if n_blocks > 1:
            found = written(spark, found, "decontaminate")
    return found


def digests(spark: SparkSession, documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: what of it occurs in the benchmark."""
    found = find_windows(spark, documents.select("doc_id", "text"), benchmark)
    n_hit = F.aggregate("hits.spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    return found.select(
        "doc_id",
        F.col("hits.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits.spans") > 0).alias("contaminated"),
    )
