"""Benchmark decontamination: word-level Wu-Manber search for windows of benchmark items."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import landed, ship_package
from .texts import pieces, quoted, struct_of, table_operator, terms

WINDOW = 10
BLOCK = 2
#: Bytes of item texts whose tables go to every task at once; larger benchmarks are searched in several passes.
MAX_PATTERN_BYTES = 32 << 20
COLUMNS = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hits", "items"]
FIELDS = {"n_words": "long", "n_hit": "long", "hits": "array<int>", "items": "array<string>"}


class WuManber:
    """Finds patterns of one length, ``size`` words each.

    ``shift``: for a block of words, how far the search may move on; 0 if a pattern may end here. Then the bucket
    of the last words (the block and one more) has the candidates, which are compared word by word.
    """

    def __init__(self, patterns: dict[tuple[bytes, ...], set[str]], size: int) -> None:
        self.size, self.block, self.suffix = size, min(BLOCK, size), min(BLOCK + 1, size)
        self.furthest = size - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], list[tuple[bytes, ...]]] = {}
        self.owners = patterns
        for pattern in patterns:
            for end in range(self.block, size + 1):
                block = pattern[end - self.block : end]
                self.shift[block] = min(self.shift.get(block, self.furthest), size - end)
            self.buckets.setdefault(pattern[-self.suffix :], []).append(pattern)

    def search(self, found: list[bytes]) -> Iterator[tuple[int, tuple[bytes, ...]]]:
        """Start and pattern of each occurrence."""
        size, block, suffix, furthest = self.size, self.block, self.suffix, self.furthest
        shift, buckets = self.shift.get, self.buckets.get
        end, n = size, len(found)
        while end <= n:
            step = shift(tuple(found[end - block : end]), furthest)
            if step:
                end += step
                continue
            for pattern in buckets(tuple(found[end - suffix : end]), ()):
                if tuple(found[end - size : end]) == pattern:
                    yield end - size, pattern
            end += 1


def build_matchers(items: Iterable[tuple[str, bytes | None]], window: int = WINDOW) -> list[WuManber]:
    """One matcher for each pattern length: ``window`` words, or a shorter item's own length."""
    by_size: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
    for item, text in items:
        found = terms(text)
        size = min(window, len(found))
        for start in range(len(found) - size + 1 if size else 0):
            pattern = tuple(found[start : start + size])
            by_size.setdefault(size, {}).setdefault(pattern, set()).add(item)
    return [WuManber(patterns, size) for size, patterns in sorted(by_size.items())]


@lru_cache(maxsize=2)
def _matchers(items: tuple[tuple[str, bytes], ...], window: int) -> list[WuManber]:
    """Built once for each Python worker and batch."""
    return build_matchers(items, window)


def merge(runs: Iterable[tuple[int, int]]) -> list[list[int]]:
    """Overlapping or touching runs (start, end) united, in order."""
    merged: list[list[int]] = []
    for a, b in sorted(runs):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return merged


def find(matchers: list[WuManber], text: bytes | None, hits: list[int] = (), items: list[str] = ()) -> tuple:
    """Number of words, of hit words, the hit runs as start, end, start, end, ..., and the items.

    ``hits`` and ``items`` are those of an earlier pass.
    """
    found = terms(text)
    runs, owners = list(zip(hits[::2], hits[1::2], strict=True)), set(items)
    for matcher in matchers:
        for start, pattern in matcher.search(found):
            if runs and runs[-1][0] <= start <= runs[-1][1]:
                runs[-1] = (runs[-1][0], max(runs[-1][1], start + matcher.size))
            else:
                runs.append((start, start + matcher.size))
            owners |= matcher.owners[pattern]
    merged = merge(runs)
    return len(found), sum(b - a for a, b in merged), [x for run in merged for x in run], sorted(owners)


def _batches(items: DataFrame, item: str, text: str, limit: int) -> Iterator[tuple[tuple[str, bytes], ...]]:
    """Item texts in batches of about ``limit`` bytes; the driver holds one partition and one batch at a time."""
    batch, size = [], 0
    rows = items.where(F.col(item).isNotNull() & F.col(text).isNotNull()).select(
        F.col(item).cast("string").alias("__item"), F.col(text).alias("__text")
    )
    for row in rows.toLocalIterator():
        batch.append((row["__item"], row["__text"].encode()))
        size += len(batch[-1][1])
        if size >= limit:
            yield tuple(batch)
            batch, size = [], 0
    if batch:
        yield tuple(batch)


def _search(docs: DataFrame, text: str, batch: tuple[tuple[str, bytes], ...], window: int) -> DataFrame:
    def run(texts: pa.Array, hits: pa.Array, items: pa.Array) -> pa.Array:
        matchers = _matchers(batch, window)
        made = [
            struct_of([find(matchers, t, h or [], i or []) for t, h, i in zip(*part, strict=True)], FIELDS)
            for part in pieces([texts, hits, items])
        ]
        return pa.concat_arrays(made) if made else struct_of([], FIELDS)

    kinds = "struct<" + ",".join(f"{n}:{k}" for n, k in FIELDS.items()) + ">"
    udf = F.arrow_udf(run, kinds).asNondeterministic()
    others = [c for c in docs.columns if c not in FIELDS]
    found = docs.withColumn("__found", udf(F.col(quoted(text)).cast("binary"), F.col("hits"), F.col("items")))
    return found.select(*[quoted(c) for c in others], *[F.col("__found")[n].alias(n) for n in FIELDS])


@table_operator(COLUMNS)
def find_contamination(
    docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    window: int = WINDOW, max_pattern_bytes: int = MAX_PATTERN_BYTES,
) -> DataFrame:
    """Add n_words, n_hit, n_items, items_sha256, contaminated, hits (runs of hit words: start, end, ...) and items.

    The tables of one batch of item texts, of a bounded number of bytes, go to the tasks; a larger benchmark
    adds passes over the texts, not memory: each pass is written, and the next one adds its runs and items.
    Null and empty texts have no words and no hits; items with a null id or without words are not searched; rows
    that repeat an item count once. Repeated documents get the same answer; columns with the new names are
    replaced, others stay; empty tables are fine on both sides.
    """
    ship_package(docs.sparkSession)
    result = docs.select(*[quoted(c) for c in docs.columns if c not in COLUMNS]).withColumns({
        "hits": F.lit(None).cast("array<int>"), "items": F.lit(None).cast("array<string>"),
    })
    waiting: tuple[tuple[str, bytes], ...] = ()
    for batch in _batches(items, item, item_text, max_pattern_bytes):
        if waiting:
            result = landed(_search(result, text, waiting, window))
        waiting = batch
    return (
        _search(result, text, waiting, window)
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256))
        .withColumn("contaminated", F.col("n_hit") > 0)
    )
