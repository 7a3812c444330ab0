"""Suffix-array dedup: bytes covered by long strings that occur again, by radix passes of limited depth.

The suffixes of all texts are told apart by their first ``length`` bytes only, so equal groups are exactly the
repeated windows. The passes look at the most significant digits first and drop what stands alone, so that few
windows get to the last one:

1. The first digit of a window is its anchor, the string of ``gram`` bytes in it with the smallest hash. Equal
   windows have equal anchors at equal places, and a run of neighbouring windows shares one, so a run is one row.
2. The second digit is the run's whole string. Runs with equal strings are repeated windows throughout.
3. The last digit is a window's whole string, for one run of each different string whose anchor others share.

Each pass is a grouping by Spark; the last one takes an anchor's different runs together, window by window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, landed, release_shuffles, shared_path, ship_package
from .contamination import merge
from .texts import pieces, quoted, table_operator

LENGTH = 400
GRAM = 200
#: Different runs of one anchor that a task compares at once; the windows of a larger group are dealt to many tasks.
GROUP = 1024
_SEGMENT = 1 << 18
_PLACE = (1 << 20) - 1
_FACTOR = 0x9E3779B97F4A7C15
COLUMNS = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]


class Anchors:
    """Splits a text's windows into runs with one anchor each."""

    def __init__(self, length: int, gram: int) -> None:
        if not 0 < gram <= length < _SEGMENT:
            raise ValueError("gram must be at most length, and length under 2 ** 18")
        self.length, self.gram = length, gram
        size = _SEGMENT + length
        random = np.random.default_rng(1)
        self.values = random.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.power, self.inverse = (self._powers(x, size) for x in (_FACTOR, pow(_FACTOR, -1, 1 << 64)))
        self.places = np.arange(size, dtype=np.uint64)

    @staticmethod
    def _powers(factor: int, size: int) -> np.ndarray:
        out = np.full(size, np.uint64(factor))
        out[0] = 1
        return np.multiply.accumulate(out)

    def _gram_hashes(self, part: np.ndarray) -> np.ndarray:
        """A hash of each gram that depends on its bytes alone."""
        n = len(part)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[part] * self.power[:n], out=sums[1:])
        h = (sums[self.gram :] - sums[: -self.gram]) * self.inverse[: n - self.gram + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        return h

    def runs(self, text: bytes) -> Iterator[np.ndarray]:
        """Rows of (hash of the anchor, hash of the run's string, first window, number of windows), segment by
        segment, so memory does not grow with the text."""
        length, width = self.length, self.length - self.gram + 1
        data = np.frombuffer(text, np.uint8)
        for base in range(0, len(data) - length + 1, _SEGMENT):
            part = data[base : base + _SEGMENT + length - 1]
            hashes = self._gram_hashes(part)
            # the place in the low bits: of equal hashes the first one counts
            ranked = (hashes & np.uint64(~_PLACE & (1 << 64) - 1)) | self.places[: len(hashes)]
            anchors = (_sliding_min(ranked, width) & np.uint64(_PLACE)).astype(np.int64)
            starts = np.concatenate(([0], np.flatnonzero(anchors[1:] != anchors[:-1]) + 1))
            ends = np.append(starts[1:], len(anchors))
            bounds = zip((base + starts).tolist(), (base + ends - 1 + length).tolist(), strict=True)
            digests = np.fromiter((xxhash.xxh3_64_intdigest(text[a:b]) for a, b in bounds), np.uint64, len(starts))
            yield np.stack((hashes[anchors[starts]].view(np.int64), digests.view(np.int64), base + starts, ends - starts), axis=1)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of ``width`` neighbours: of the end of one block and the start of the next."""
    n = len(x) - width + 1
    blocks = np.concatenate((x, np.full(-len(x) % width, np.uint64((1 << 64) - 1)))).reshape(-1, width)
    rising = np.minimum.accumulate(blocks, axis=1).ravel()
    falling = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(falling[:n], rising[width - 1 : width - 1 + n])


def _find_runs(texts: DataFrame, length: int, gram: int) -> DataFrame:
    names = ["anchor", "run", "k1", "k2", "start", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length, gram)
        for batch in batches:
            for part in pieces(batch.columns):
                found = [
                    np.concatenate((rows[:, :2], np.full((len(rows), 2), (k1, k2)), rows[:, 2:]), axis=1)
                    for k1, k2, text in zip(*part, strict=True) for rows in anchors.runs(text)
                ]
                if found:
                    yield _long_batch(list(np.ascontiguousarray(np.concatenate(found).T)), names)

    return texts.select("k1", "k2", F.col("text").cast("binary")).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _long_batch(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


_RUN = "array<struct<anchor:long,kinds:long,single:boolean,start:long,n:long>>"
_STRING = "anchor long, kinds long, single boolean, k1 long, k2 long, start long, string binary"


def _strings(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The strings of the wanted runs, read from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "kinds", "single", "k1", "k2", "start", "string"]
        for batch in batches:
            for part in pieces(batch.columns, 64):
                rows = [
                    (r["anchor"], r["kinds"], r["single"], k1, k2, r["start"], text[r["start"] : r["start"] + r["n"] - 1 + length])
                    for k1, k2, text, runs in zip(*part, strict=True) for r in runs
                ]
                kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    lists = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("anchor", "kinds", "single", "start", "n")).alias("runs"))
    joined = texts.join(lists.hint("shuffle_hash"), ["k1", "k2"])
    return joined.select("k1", "k2", F.col("text").cast("binary"), F.col("runs").cast(_RUN)).mapInArrow(run, _STRING)


def _windows(string: bytes, length: int) -> list[bytes]:
    digest = xxhash.xxh3_128_digest
    return [digest(string[i : i + length]) for i in range(len(string) - length + 1)]


def _compare_groups(strings: DataFrame, length: int) -> DataFrame:
    """Repeated windows of the single runs, by comparing all windows of an anchor's strings."""
    columns = ["single", "k1", "k2", "start", "string"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, group = None, []

        def close() -> list[tuple[int, int, int, int]]:
            seen: dict[bytes, int] = {}
            digests = [_windows(r[-1], length) for r in group]
            for found in digests:
                for d in found:
                    seen[d] = seen.get(d, 0) + 1
            return [
                (k1, k2, start + a, start + b - 1 + length)
                for (single, k1, k2, start, _), found in zip(group, digests, strict=True) if single
                for a, b in merge((i, i + 1) for i, d in enumerate(found) if seen[d] > 1)
            ]

        for batch in batches:
            out = []
            for part in pieces([batch.column(c) for c in ("anchor", *columns)]):
                for at, *row in zip(*part, strict=True):
                    if at != anchor:
                        out += close()
                        anchor, group = at, []
                    group.append(row)
            yield _long_batch(list(zip(*out, strict=True)) or [[]] * 4, ["k1", "k2", "a", "b"])
        yield _long_batch(list(zip(*close(), strict=True)) or [[]] * 4, ["k1", "k2", "a", "b"])

    dealt = strings.repartition("anchor").sortWithinPartitions("anchor").select("anchor", *columns)
    return dealt.mapInArrow(run, "k1 long, k2 long, a long, b long")


def _compare_windows(strings: DataFrame, length: int, path: str) -> DataFrame:
    """The same for anchors with many different strings: every window is a row, and equal ones are counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["w1", "w2", "k1", "k2", "at", "single"]
        for batch in batches:
            for k1, k2, start, string, single in (r for part in pieces(batch.columns) for r in zip(*part, strict=True)):
                digests = np.frombuffer(b"".join(_windows(string, length)), np.int64).reshape(-1, 2)
                n = len(digests)
                columns = [digests[:, 0], digests[:, 1], np.full(n, k1), np.full(n, k2), start + np.arange(n), np.full(n, single)]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=names)

    rows = landed(strings.select("k1", "k2", "start", "string", "single").mapInArrow(
        run, "w1 long, w2 long, k1 long, k2 long, at long, single boolean"
    ), path)
    again = landed(rows.groupBy("w1", "w2").count().where(F.col("count") > 1).select("w1", "w2"), f"{path}_again")
    found = rows.where("single").join(again, ["w1", "w2"], "left_semi")
    return found.select("k1", "k2", F.col("at").alias("a"), (F.col("at") + length).alias("b"))


_SPANS = "array<struct<a:long,b:long>>"


def _cut(texts: DataFrame, covered: DataFrame, keep_text: bool, keep_spans: bool) -> DataFrame:
    """Remove the covered bytes of each text; with ``keep_text`` also the text left, without broken characters, with
    ``keep_spans`` the removed ranges of bytes."""
    lists = covered.groupBy("k1", "k2").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    joined = texts.where("copies = 1").join(lists.hint("shuffle_hash"), ["k1", "k2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["k1", "k2", "removed", "spans", "sha", "left", "ranges"]
        ranges = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), ranges]
        for part in (part for batch in batches for part in pieces(batch.columns)):
            rows = []
            for k1, k2, text, spans in zip(*part, strict=True):
                cuts = merge((s["a"], s["b"]) for s in spans)
                edges = [0, *(x for cut in cuts for x in cut), len(text)]
                left = [text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]
                kept = b"".join(left)
                whole = "".join(p.decode("utf-8", "ignore") for p in left) if keep_text else None
                places = [{"a": a, "b": b} for a, b in cuts] if keep_spans else None
                rows.append((k1, k2, len(text) - len(kept), len(cuts), hashlib.sha256(kept).hexdigest(), whole, places))
            columns = zip(zip(*rows, strict=True), kinds, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], names=names)

    return joined.select("k1", "k2", F.col("text").cast("binary"), "spans").mapInArrow(
        run, f"k1 long, k2 long, removed long, spans long, sha string, left string, ranges {_SPANS}"
    )


@table_operator(COLUMNS)
def remove_repeats(
    docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM, group: int = GROUP, keep_text: bool = False,
    keep_spans: bool = False,
) -> DataFrame:
    """Add n_bytes, n_removed, n_spans and kept_sha256: every byte goes that a ``length``-byte string covers which
    also starts elsewhere, in the same or another document. With ``keep_text`` the text stays and ``kept`` is what
    is left of it (a character that is cut through goes as a whole); with ``keep_spans`` ``removed`` lists the ranges of
    bytes (null where nothing goes).

    Texts with copies are removed whole, if they have ``length`` bytes, and only one copy of each takes part in
    the passes. These texts are stored in buckets by their two hash keys, so both joins that need texts move
    only the small side. Null counts as empty; shorter texts lose nothing. Repeated rows are repeats. Columns with the new
    names are replaced, others stay, but the text only with ``keep_text``; an empty table stays empty.
    """
    spark = docs.sparkSession
    ship_package(spark)
    taken = [*COLUMNS, "removed"] if keep_spans else COLUMNS
    others = [c for c in docs.columns if c not in taken and (keep_text or c != text)]
    source = F.coalesce(F.col(quoted(text)), F.lit(""))
    keys = {"k1": F.xxhash64(source), "k2": F.xxhash64(F.lit(1), source)}
    # the tables of the passes go into one folder, which is deleted when their result is written
    work = shared_path(spark, "repeats")
    name = "texts_" + hashlib.sha256(work.encode()).hexdigest()[:24]
    long = docs.select(source.alias("text"), *[c.alias(n) for n, c in keys.items()]).where(F.octet_length("text") >= length)
    try:
        (
            long.groupBy("k1", "k2").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
            .write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "k1", "k2").sortBy("k1", "k2")
            .option("path", f"{work}/texts").option("compression", "zstd").format("parquet").saveAsTable(name)
        )
        # each pass ends with a written table; the shuffles behind it go before the next one begins
        release_shuffles(spark)
        found = _repeats(spark.table(name), work, length, gram, group, keep_text, keep_spans)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        discard(spark, work)
        release_shuffles(spark)
    marked = docs.select(
        *[quoted(c) for c in others], source.alias("__text"), F.octet_length(source).cast("long").alias("__bytes"),
        F.sha2(source.cast("binary"), 256).alias("__own"), *[c.alias(f"__d{n}") for n, c in keys.items()],
    )
    joined = marked.join(found, (F.col("__dk1") == F.col("__k1")) & (F.col("__dk2") == F.col("__k2")), "left")
    return joined.select(
        *[quoted(c) for c in others], F.col("__bytes").alias("n_bytes"),
        F.coalesce("__removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("__spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("__sha", "__own").alias("kept_sha256"), *([F.coalesce("__left", "__text").alias("kept")] if keep_text else []),
        *([F.col("__ranges").alias("removed")] if keep_spans else []),
    )


def _repeats(
    texts: DataFrame, work: str, length: int, gram: int, group: int, keep_text: bool, keep_spans: bool,
) -> DataFrame:
    """What goes from each of the distinct ``texts(k1, k2, text, copies)`` that lose anything; written."""
    spark = texts.sparkSession
    runs = landed(_find_runs(texts, length, gram), f"{work}/runs")
    # small tables are written before they are joined: over plain shuffles AQE can split a hot anchor
    shared = landed(runs.groupBy("anchor").count().where(F.col("count") > 1).select("anchor"), f"{work}/shared")
    runs = landed(runs.join(shared, "anchor", "left_semi"), f"{work}/shared_runs")
    discard(spark, f"{work}/runs")
    release_shuffles(spark)
    different = landed(
        runs.groupBy("anchor", "run").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("k1", "k2", "start", "n")).alias("one")),
        f"{work}/different",
    )
    several = landed(
        different.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.min("times").alias("least"))
        .where((F.col("kinds") > 1) & (F.col("least") == 1)).select("anchor", "kinds"), f"{work}/several"
    )
    wanted = different.join(several, "anchor").select("anchor", "kinds", (F.col("times") == 1).alias("single"), "one.*")
    release_shuffles(spark)
    strings = landed(_strings(texts, wanted, length), f"{work}/strings")
    release_shuffles(spark)
    whole = runs.join(different.where("times > 1"), ["anchor", "run"], "left_semi").select(
        "k1", "k2", F.col("start").alias("a"), (F.col("start") + F.col("n") - 1 + length).alias("b")
    )
    covered = whole.unionByName(_compare_groups(strings.where(F.col("kinds") <= group), length)).unionByName(
        _compare_windows(strings.where(F.col("kinds") > group), length, f"{work}/windows")
    )
    changed = _cut(texts, covered, keep_text, keep_spans)
    gone = texts.where("copies > 1").select(
        "k1", "k2", F.octet_length("text").cast("long").alias("removed"), F.lit(1).cast("long").alias("spans"),
        F.sha2(F.lit("").cast("binary"), 256).alias("sha"), F.lit("").alias("left"),
        F.array(F.struct(F.lit(0).cast("long").alias("a"), F.octet_length("text").cast("long").alias("b"))).alias("ranges"),
    )
    return landed(changed.unionByName(gone).withColumnsRenamed({c: f"__{c}" for c in changed.columns}))
