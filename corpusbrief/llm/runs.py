"""Periodic runs of words: stretches that repeat with a period, found at every scale without trying every period.

A run of smallest period q and at least four periods is found through *minimizers*. At the scale of periods lo
to hi (hi about 1.25 lo) the hash of the gram of 2 * hi words that starts at a place is its value, and a place is
selected if its value is the least, leftmost, in some window of places. Inside a run windows q words apart hold equal
grams, so they select places q apart with equal values; and as a gram is at least two periods long, its next
occurrence in the run is exactly q words on. With windows of at most 3 * lo - 2 * hi + 1 places the run's first
window and the one q words later lie whole in any run of four periods. So each run gives a pair of neighbours among the
selected places of equal value, whose distance is its period: a seed, extended both ways by comparing words.
Equal hashes only propose; the words decide.

Periods below a bound are too short for grams to be selective and are scanned directly, by comparing each word with
the one ``lag`` words on. The documents of a batch are worked on as one array, with marks between them that equal nothing.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .texts import pieces, quoted, table_operator, words

MIN_WORDS = 6
MIN_PERIODS = 4
#: Periods up to this are scanned directly.
DIRECT = 24
#: Words put together into one array; a longer document makes one by itself.
BATCH_WORDS = 1 << 16

Run = tuple[int, int, int]  # start, length, period

FIELDS = {
    "n_words": "long", "n_runs": "long", "start": "long", "length": "long", "period": "long", "exponent_milli": "long",
    "runs_sha256": "string", "collapsed_sha256": "string", "runs": "array<struct<start:long,length:long,period:long>>",
    "collapsed": "string",
}


def least_length(period: int) -> int:
    return max(MIN_WORDS, MIN_PERIODS * period)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two neighbouring blocks from their hashes."""
    x = a * np.uint64(0x9E3779B97F4A7C15) ^ (b + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _stretches(same: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, end) of the maximal stretches of True."""
    at = np.flatnonzero(same)
    if len(at):
        cuts = np.flatnonzero(np.diff(at) > 1)
        yield from zip(at[np.r_[0, cuts + 1]].tolist(), (at[np.r_[cuts, len(at) - 1]] + 1).tolist())


def short_runs(ids: np.ndarray, longest: int) -> Iterator[Run]:
    """Stretches of periods 1 to ``longest``, each scanned at its own lag."""
    for q in range(1, min(longest, len(ids) // MIN_PERIODS) + 1):
        need = least_length(q) - q
        for first, end in _stretches(ids[q:] == ids[:-q]):
            if end - first >= need:
                yield first, end - first + q, q


def scales(longest: int) -> Iterator[tuple[int, int]]:
    """Ranges of periods, from DIRECT + 1 up to ``longest``."""
    low = DIRECT + 1
    while low <= longest:
        high = low * 5 // 4
        yield low, high
        low = high + 1


class _Grams:
    """Hashes of the grams of growing lengths, from those of the last power of two."""

    def __init__(self, ids: np.ndarray):
        self.size, self.level = 1, _mixed(ids.astype(np.uint64), ids.astype(np.uint64))

    def of(self, length: int) -> np.ndarray:
        while self.size * 2 <= length:
            self.level = _mixed(self.level[: -self.size], self.level[self.size :])
            self.size *= 2
        over = length - self.size
        return _mixed(self.level[: len(self.level) - over], self.level[over:])


def selected(values: np.ndarray, window: int) -> np.ndarray:
    """Places of the leftmost least value of each window of ``window`` (a power of two) places."""
    bits = np.uint64(len(values).bit_length())
    least = (values >> bits << bits) | np.arange(len(values), dtype=np.uint64)
    width = 1
    while width < window:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    places = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    return places[np.r_[True, places[1:] != places[:-1]]] if len(places) else places


def seeds(values: np.ndarray, window: int, low: int, high: int) -> list[tuple[int, int]]:
    """(place, distance) of neighbouring selected places of equal value that lie ``low`` to ``high`` apart."""
    places = selected(values, window)
    found = values[places]
    order = np.argsort(found, kind="stable")
    places, found = places[order], found[order]
    apart = np.diff(places)
    good = np.flatnonzero((found[1:] == found[:-1]) & (apart >= low) & (apart <= high))
    return sorted(zip(places[good].tolist(), apart[good].tolist()))


def _reach(ids: np.ndarray, lag: int, at: int, step: int) -> int:
    """How many words from ``at``, in the direction of ``step``, equal those ``lag`` words on."""
    total, chunk = 0, 64
    while True:
        low, high = (at + total, min(at + total + chunk, len(ids) - lag)) if step > 0 else (max(at - total - chunk + 1, 0), at - total + 1)
        if low >= high:
            return total
        unequal = np.flatnonzero(ids[low:high] != ids[low + lag : high + lag])
        if len(unequal):
            return total + int(unequal[0] if step > 0 else high - low - 1 - unequal[-1])
        total += high - low
        chunk *= 2


def long_runs(ids: np.ndarray, longest: int) -> Iterator[Run]:
    """Stretches of periods DIRECT + 1 to ``longest``, from minimizer pairs at each scale."""
    grams = _Grams(ids)
    for low, high in scales(longest):
        if 2 * high > len(ids):
            return
        window = 1 << ((3 * low - 2 * high + 1).bit_length() - 1)
        known: dict[int, int] = {}  # by period, how far the last stretch was compared
        for at, q in seeds(grams.of(2 * high), window, low, high):
            if at < known.get(q, -1):
                continue
            right = _reach(ids, q, at, 1)
            left = _reach(ids, q, at - 1, -1)
            known[q] = at + right
            if left + right + q >= least_length(q):
                yield at - left, left + right + q, q


def find_runs(texts: list[np.ndarray]) -> list[list[Run]]:
    """The runs of each text of word numbers, by start, then period.

    A stretch that has several periods is found with each of them, and its smallest one divides the others;
    so the smallest of those found for one stretch is its smallest period.
    """
    best: list[dict[tuple[int, int], int]] = [{} for _ in texts]
    # longest first: a scale leaves out the documents that cannot hold its runs
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    ids = np.concatenate([part for i in order for part in (texts[i], [-1 - i])]) if order else np.zeros(0, np.int64)
    begins = np.cumsum([0] + [len(texts[i]) + 1 for i in order])

    def keep(found: Iterator[Run]) -> None:
        for start, length, q in found:
            k = int(np.searchsorted(begins, start, "right")) - 1
            spot = (start - int(begins[k]), length)
            mine = best[order[k]]
            mine[spot] = min(q, mine.get(spot, q))

    lengths = np.array([len(texts[i]) for i in order])
    keep(short_runs(ids, min(DIRECT, int(lengths[0]) // MIN_PERIODS if len(order) else 0)))
    # documents of about a length share their scales, so that short ones are not carried through those of long ones
    done = 0
    while done < len(order) and lengths[done] > MIN_PERIODS * DIRECT:
        end = int(np.searchsorted(-lengths, -max(lengths[done] // 2, MIN_PERIODS * DIRECT + 1), "right"))
        part, offset = ids[begins[done] : begins[end]], int(begins[done])
        keep((s + offset, n, q) for s, n, q in long_runs(part, int(lengths[done]) // MIN_PERIODS))
        done = end
    return [sorted((s, n, q) for (s, n), q in found.items()) for found in best]


def dropped(n: int, runs: list[Run]) -> np.ndarray:
    """Which of ``n`` words lie in a run after its first period."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        edges[start + q] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:n]) > 0


def strongest(runs: list[Run]) -> Run | None:
    """The run with the greatest length / period, compared exactly; ties: smallest start, then period."""
    best = None
    for run in runs:  # in the order of the ties
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def planted(found: list[bytes], key: int | None) -> list[bytes]:
    """Words with a run put in, for one key in ten: from a place on, a stretch repeated to the end."""
    n = len(found)
    h = zlib.crc32(b"" if key is None else str(key).encode())
    if h % 10 or not n:
        return found
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    period = found[a : a + p]
    return found[:a] + (period * (-(-(n - a) // p)))[: n - a]


def _described(found: list[bytes], runs: list[Run]) -> dict:
    best = strongest(runs)
    start, length, period = best or (None, None, None)
    gone = dropped(len(found), runs).tolist() if runs else [False] * len(found)
    collapsed = b" ".join(w for w, g in zip(found, gone) if not g)
    return {
        "n_words": len(found), "n_runs": len(runs), "start": start, "length": length, "period": period,
        "exponent_milli": 1000 * length // period if best else None,
        "runs_sha256": hashlib.sha256("".join("%d,%d,%d\n" % run for run in runs).encode()).hexdigest(),
        "collapsed_sha256": hashlib.sha256(collapsed).hexdigest(),
        "runs": [dict(zip(("start", "length", "period"), run)) for run in runs],
        "collapsed": collapsed,
    }


@dataclass(frozen=True)
class _Columns:
    """The chosen columns as an Arrow struct."""

    names: tuple[str, ...]

    def kind(self, name: str) -> pa.DataType:
        if name == "runs":
            return pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        return pa.int64() if FIELDS[name] == "long" else pa.string()

    def of(self, rows: list[dict]) -> pa.StructArray:
        arrays = []
        for name in self.names:
            values = [r[name] for r in rows]
            if name == "collapsed":  # bytes of a Spark string, passed on as they are
                values = [v.decode("utf-8", "replace") for v in values]
            arrays.append(pa.array(values, self.kind(name)))
        return pa.StructArray.from_arrays(arrays, names=list(self.names))


@table_operator(FIELDS)
def describe_runs(docs: DataFrame, text: str = "text", plant_by: str | None = None, full: bool = False) -> DataFrame:
    """Add the runs of each document's words to ``docs``.

    n_words, n_runs, start, length, period and exponent_milli of the strongest run (null without one), runs_sha256
    and collapsed_sha256; with ``full`` also ``runs`` and ``collapsed``, the kept words joined by blanks. ``plant_by``
    names a key column by which :func:`planted` first puts runs in.

    Null and empty texts have no words and no runs. Texts of any length are taken whole, each in one task, as it
    is one value. Repeated rows get the same answer; a null key plants as the empty text's crc32 says. Columns of
    ``docs`` that have one of the new names, in whatever case, are replaced, all others stay; an empty table stays empty.
    """
    ship_package(docs.sparkSession)
    names = tuple(n for n in FIELDS if full or n not in ("runs", "collapsed"))
    columns = _Columns(names)

    def run(texts: pa.Array, keys: pa.Array) -> pa.Array:
        made, waiting, size = [], [], 0

        def flush() -> None:
            if waiting:
                rows = []
                for part, runs in zip(waiting, find_runs(_numbered(waiting)), strict=True):
                    rows.append(_described(part, runs))
                made.append(columns.of(rows))
                waiting.clear()

        for part, own in pieces([texts, keys], 64):
            for value, key in zip(part, own):
                found = words(value)
                waiting.append(planted(found, key) if plant_by else found)
                size += len(found)
                if size >= BATCH_WORDS:
                    flush()
                    size = 0
        flush()
        return pa.concat_arrays(made) if made else columns.of([])

    udf = F.arrow_udf(run, "struct<" + ",".join(f"{n}:{FIELDS[n]}" for n in names) + ">").asNondeterministic()
    key = F.col(plant_by).cast("long") if plant_by else F.lit(None).cast("long")
    result = "__runs_of_words"
    made = docs.withColumn(result, udf(F.col(text).cast("binary"), key))
    return made.select(*[F.col(quoted(c)) for c in made.columns[:-1]], *[F.col(result)[n].alias(n) for n in names])


def _numbered(texts: list[list[bytes]]) -> list[np.ndarray]:
    """Words as numbers, equal where the words are."""
    number: dict[bytes, int] = defaultdict(count().__next__)
    return [np.fromiter(map(number.__getitem__, t), np.int64, len(t)) for t in texts]
