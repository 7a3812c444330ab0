"""URL filters: exact membership of URL keys by a cascade of Bloom filters, and host and path rules on top."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import landed, ship_package
from .texts import quoted, table_operator

#: Rule (host and path) and its verdict.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Filters up to this size go to every task; a larger list is looked up by a join.
MAX_FILTER_BYTES = 64 << 20
MAX_LEVELS = 64
COLUMNS = ["host", "path", "rule", "rule_verdict", "listed", "verdict"]


def url_host(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host, up to ``?``, ``#`` or the end; empty without a host."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def page_key(host: Column, path: Column) -> Column:
    """What lists hold: host and path, without scheme, query and fragment."""
    return F.concat(host, path)


def rule_column(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits: its host or a subdomain, and a path that starts with the rule's."""
    chain = None
    for rule, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        rule_host, slash, rest = rule.partition("/")
        fits = F.concat(F.lit("."), host).endswith("." + rule_host) & path.startswith(slash + rest)
        chain = F.when(fits, F.lit(rule)) if chain is None else chain.when(fits, F.lit(rule))
    return F.lit(None).cast("string") if chain is None else chain


# --- the cascade ---------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    words: np.ndarray

    def holds(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        found = np.ones(len(first), bool)
        for i in range(self.hashes):
            at = _place(first, second, i, self.bits)
            found &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return found


def _place(first: np.ndarray, second: np.ndarray, i: int, bits: int) -> np.ndarray:
    return (first + np.uint64(i) * (second | np.uint64(1))) % np.uint64(bits)


@dataclass(frozen=True)
class Cascade:
    """Level 0 holds the listed keys, level 1 the other keys that level 0 lets through, level 2 the listed keys
    that level 1 lets through, and so on; the last level lets none through."""

    levels: tuple[Level, ...]

    def listed(self, hashes: list[np.ndarray]) -> np.ndarray:
        """Exact for keys of the universe. ``hashes``: two numbers for each key, and level by level its own mix."""
        first, second = hashes
        answer, open_ = np.zeros(len(first), bool), np.ones(len(first), bool)
        for number, level in enumerate(self.levels):
            at = np.flatnonzero(open_)
            through = level.holds(*_mixed(first[at], second[at], number))
            # out at an even level: not listed; out at an odd one: listed
            answer[at[~through]] = number % 2 == 1
            open_[at[~through]] = False
        answer[open_] = len(self.levels) % 2 == 1
        return answer

    @property
    def size(self) -> int:
        return sum(8 * len(x.words) for x in self.levels)


def _mixed(first: np.ndarray, second: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Independent hashes for a level (splitmix64 steps of the key's two hashes)."""
    out = []
    for x in (first, second):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(x ^ (x >> np.uint64(31)))
    return out[0], out[1]


def _hashes(batch: pa.RecordBatch, names: tuple[str, str]) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for n in names]


def _level_of(keys: DataFrame, count: int, number: int, rate: float) -> Level:
    """A Bloom filter of ``count`` keys: tasks set bits, Spark unites the words of all tasks."""
    hashes = max(1, round(-math.log2(rate)))
    bits = max(64, -(-math.ceil(-count * math.log(rate) / math.log(2) ** 2) // 64) * 64)

    def run(batches):
        words = np.zeros(bits // 64, np.uint64)
        for batch in batches:
            first, second = _mixed(*_hashes(batch, ("first", "second")), number)
            for i in range(hashes):
                at = _place(first, second, i, bits)
                np.bitwise_or.at(words, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
        used = np.flatnonzero(words)
        for start in range(0, len(used), 1 << 16):
            part = used[start : start + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(words[part].view(np.int64))], names=["at", "word"])

    merged = (
        keys.select("first", "second").mapInArrow(run, "at long, word long")
        .groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    )
    words = np.zeros(bits // 64, np.int64)
    words[merged["at"].to_numpy()] = merged["word"].to_numpy()
    return Level(bits, hashes, words.view(np.uint64))


def key_hashes(key: Column) -> dict[str, Column]:
    return {"first": F.xxhash64(key), "second": F.xxhash64(F.lit(1), key)}


def build_cascade(keys: DataFrame, max_bytes: int = MAX_FILTER_BYTES) -> Cascade | None:
    """``keys``: (key, listed), each key of the complete universe once. None if the first level would pass
    ``max_bytes``; the levels after it are smaller.

    The first level's rate leaves about as many false positives as there are listed keys; each later level halves.
    """
    ship_package(keys.sparkSession)
    hashed = landed(keys.select("listed", *[c.alias(n) for n, c in key_hashes(F.col("key")).items()]))
    counts = dict(hashed.groupBy("listed").count().toLocalIterator())
    inside, outside = counts.get(True, 0), counts.get(False, 0)
    if not inside:
        return Cascade(())
    rate = min(0.5, max(1e-9, inside * math.sqrt(0.5) / max(outside, 1)))
    if -inside * math.log(rate) / math.log(2) ** 2 / 8 > max_bytes:
        return None
    levels: list[Level] = []
    current, other = hashed.where("listed"), hashed.where("NOT listed")
    count = inside
    while count:
        if len(levels) == MAX_LEVELS:
            raise ValueError("two different keys have the same 128 hash bits")
        level = _level_of(current, count, len(levels), rate if not levels else 0.5)
        levels.append(level)
        # the other side's keys that pass become the next level
        current, other = landed(_passing(other, level, len(levels) - 1)), current
        count = current.count()
    return Cascade(tuple(levels))


def _passing(keys: DataFrame, level: Level, number: int) -> DataFrame:
    held = keys.sparkSession.sparkContext.broadcast(level)

    def run(batches):
        for batch in batches:
            through = held.value.holds(*_mixed(*_hashes(batch, ("first", "second")), number))
            yield batch.filter(pa.array(through))

    return keys.mapInArrow(run, keys.schema)


def with_membership(docs: DataFrame, key: Column, cascade: Cascade) -> DataFrame:
    """Add ``listed``: whether the cascade holds the key; only two hashes for each row go to Python."""
    ship_package(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(cascade)

    def run(first: pa.Array, second: pa.Array) -> pa.Array:
        hashes = [x.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for x in (first, second)]
        return pa.array(held.value.listed(hashes))

    udf = F.arrow_udf(run, "boolean")
    return docs.withColumn("listed", udf(*key_hashes(key).values()))


@table_operator(COLUMNS)
def filter_urls(pages: DataFrame, listed: DataFrame, url: str = "url", rules=RULES, max_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """Add host, path, rule, rule_verdict, listed and verdict; ``listed`` has a column ``key`` of page keys.

    The verdict is the longest fitting rule's; without one, block if the page's key is listed, else allow. The
    cascade is built over all keys of ``pages`` and ``listed``, so membership is exact. Its size is known before
    it is built; a list beyond ``max_bytes`` is looked up by a join instead. A null url, or one without ``://``,
    has empty host and path and is never listed. Listed keys may repeat or be null. Repeated rows get the same
    answer; columns with the new names are replaced, others stay; empty tables are fine on both sides.
    """
    parsed = (
        pages.withColumn("__host", url_host(F.col(quoted(url)))).withColumn("__path", url_path(F.col(quoted(url))))
        .withColumn("__key", page_key(F.col("__host"), F.col("__path")))
    )
    on_list = listed.select("key", F.lit(True).alias("listed")).where(F.length("key") > 0)
    universe = parsed.select(F.col("__key").alias("key"), F.lit(False).alias("listed"))
    # one row for each key: its copies meet map-side first
    keys = universe.unionByName(on_list).groupBy("key").agg(F.max("listed").alias("listed"))
    cascade = build_cascade(keys, max_bytes)
    if cascade is None:
        marked = parsed.join(on_list.distinct().select(F.col("key").alias("__listed")), F.col("__key") == F.col("__listed"), "left")
        marked = marked.withColumn("listed", F.col("__listed").isNotNull()).drop("__listed")
    else:
        marked = with_membership(parsed, F.col("__key"), cascade)
    verdicts = F.create_map(*[F.lit(x) for rule in rules for x in rule]) if rules else F.create_map().cast("map<string,string>")
    judged = marked.withColumn("__rule", rule_column(F.col("__host"), F.col("__path"), rules))
    by_list = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    others = [c for c in pages.columns if c not in COLUMNS]
    return judged.select(
        *[quoted(c) for c in others], F.col("__host").alias("host"), F.col("__path").alias("path"),
        F.col("__rule").alias("rule"), F.element_at(verdicts, F.col("__rule")).alias("rule_verdict"), "listed",
    ).withColumn("verdict", F.coalesce("rule_verdict", by_list))


def repeated_keys(pages: DataFrame, url: str = "url", at_least: int = 2) -> DataFrame:
    """A list that grows with the crawl: keys that several pages share, such as one page under many queries."""
    key = page_key(url_host(F.col(quoted(url))), url_path(F.col(quoted(url))))
    return pages.select(key.alias("key")).where(F.length("key") > 0).groupBy("key").count().where(F.col("count") >= at_least).select("key")
