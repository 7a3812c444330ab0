"""LM scoring: context-tree weighting over bytes, and a smoothed unigram base over words."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import arrow_batches, landed, ship_package
from .texts import LOWER, pieces, quoted, struct_of, table_operator, words

#: Stands before and after each text; no UTF-8 text holds this byte.
MARK = 0xFF
DEPTH = 5
#: Contexts seen this often in training get a node, however large the training table is. Bytes in rarer contexts
#: belong to the "rest" child of their longest kept context.
SEEN = 2
#: Probabilities of so many of the documents' most frequent grams at most go to every task. The others are joined.
COMMON_GRAMS = 1 << 21
#: Words with at least this share of the training tokens; so at most 1 / share of them go to every task.
WORD_SHARE = 1 / 200_000
#: Bytes of texts that go to Python at a time.
BATCH = 2 << 20
#: Grams that are sorted at a time, that a task holds counted, and that are weighted at a time. A worker keeps most of what
#: it once needed, and each executor has a worker for each core beside its heap.
_CHUNK = 1 << 19
_FLUSH = 1 << 21
_WEIGHED = 1 << 17
#: Bytes of short texts that are looked up at a time.
_TOGETHER = 1 << 18


# --- gathering -----------------------------------------------------------------------------------------------


def _grams(texts: Iterable[bytes], depth: int) -> Iterator[np.ndarray]:
    """Each byte (and the end mark) with the ``depth`` bytes before it, as one number, in bounded chunks."""
    for text in texts:
        padded = b"\xff" * depth + text.translate(LOWER) + b"\xff"
        for start in range(0, len(padded) - depth, _CHUNK):
            yield _codes(np.frombuffer(padded, np.uint8, min(_CHUNK + depth, len(padded) - start), start), depth)


def _codes(part: np.ndarray, depth: int) -> np.ndarray:
    part = part.astype(np.int64)
    codes = np.zeros(len(part) - depth, np.int64)
    for i in range(depth + 1):
        codes = (codes << 8) | part[i : len(part) - depth + i]
    return codes


def _grams_by_text(texts: list[bytes], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(grams, number of the text each is of): many short texts at a time, a long one in chunks."""
    held: list[int] = []
    size = 0

    def together() -> tuple[np.ndarray, np.ndarray]:
        pad = b"\xff" * depth
        joined = pad.join([b"", *[texts[i].translate(LOWER) + b"\xff" for i in held]])
        owner = np.repeat(np.array(held), [len(texts[i]) + 1 + depth for i in held])[depth:]
        # a gram that ends in the padding before a text belongs to none
        starts = np.cumsum([0] + [len(texts[i]) + 1 + depth for i in held[:-1]])
        real = np.ones(len(owner), bool)
        for back in range(1, depth + 1):
            real[starts[1:] - back] = False
        return _codes(np.frombuffer(joined, np.uint8), depth)[real], owner[real]

    for i, text in enumerate(texts):
        if len(text) >= _TOGETHER:
            for codes in _grams([text], depth):
                yield codes, np.full(len(codes), i)
            continue
        held.append(i)
        size += len(text)
        if size >= _TOGETHER:
            yield together()
            held, size = [], 0
    if held:
        yield together()


class _Counts:
    """Sums of counted numbers: sorted parts, of which each is over twice as large as the next one."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.raw: list[np.ndarray] = []
        self.waiting = 0

    def add(self, codes: np.ndarray) -> None:
        self.raw.append(codes)
        self.waiting += len(codes)
        if self.waiting >= _CHUNK:
            self._count()

    def _count(self) -> None:
        if self.raw:
            codes = np.concatenate(self.raw)
            self.raw, self.waiting = [], 0
            codes.sort()
            starts = _starts(codes)
            self.parts.append((codes[starts], np.diff(np.append(starts, len(codes)))))
        while len(self.parts) > 1 and len(self.parts[-2][0]) <= 2 * len(self.parts[-1][0]):
            self._merge()

    def _merge(self) -> None:
        codes, counts = (np.concatenate(x) for x in zip(self.parts.pop(), self.parts.pop(), strict=True))
        order = np.argsort(codes, kind="stable")
        codes, counts = codes[order], counts[order]
        starts = _starts(codes)
        self.parts.append((codes[starts], np.add.reduceat(counts, starts)))

    def taken(self) -> tuple[np.ndarray, np.ndarray] | None:
        self._count()
        while len(self.parts) > 1:
            self._merge()
        found, self.parts = self.parts, []
        return found[0] if found else None

    @property
    def size(self) -> int:
        return sum(len(x) for x, _ in self.parts)


def count_grams(train: DataFrame, text: str = "text", depth: int = DEPTH) -> DataFrame:
    """(gram, n): how often each byte follows each context of ``depth`` bytes, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts()
        for batch in batches:
            texts = (t or b"" for (part,) in pieces([batch.column(0)]) for t in part)
            for codes in _grams(texts, depth):
                counts.add(codes)
            if counts.size > _FLUSH:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in counts.taken()], names=["gram", "n"])
        if (left := counts.taken()) is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in left], names=["gram", "n"])

    partial = train.select(F.col(text).cast("binary")).mapInArrow(run, "gram long, n long")
    return partial.groupBy("gram").agg(F.sum("n").alias("n"))


def count_words(train: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all rows; the empty word stands for the end of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def taken() -> pa.RecordBatch:
            arrays = [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())]
            counts.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["word", "n"])

        for batch in batches:
            for text in (t for (part,) in pieces([batch.column(0)]) for t in part):
                counts.update(words((text or b"").translate(LOWER)))
                counts[b""] += 1
                if len(counts) > _FLUSH // 4:
                    yield taken()
        if counts:
            yield taken()

    partial = train.select(F.col(text).cast("binary")).mapInArrow(run, "word binary, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n"))


# --- the context tree ----------------------------------------------------------------------------------------


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift by eight."""
    y = x + 8
    series = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return series - np.log(reduce(np.multiply, (x + i for i in range(8))))


def _branches(counts: np.ndarray) -> np.ndarray:
    """Binary decomposition: for byte counts, the sums below each of the 511 nodes of the bits' tree, from 1."""
    tree = np.zeros((len(counts), 512))
    tree[:, 256:] = counts
    for level in range(7, -1, -1):
        at = np.arange(1 << level, 2 << level)
        tree[:, at] = tree[:, 2 * at] + tree[:, 2 * at + 1]
    return tree


def _evidence(tree: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov block probability at each of the 256 binary nodes (0 is unused)."""
    zeros, ones = tree[:, 0:512:2], tree[:, 1:512:2]
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1) - np.log(np.pi)


def _one(tree: np.ndarray) -> np.ndarray:
    zeros, ones = tree[:, 0:512:2], tree[:, 1:512:2]
    return (ones + 0.5) / (zeros + ones + 1)


# --- the tree as a table -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Top:
    """What the depths 0 and 1 give to the deeper ones: by byte before (256) and binary node (256), the estimate
    mixed so far, the share left to deeper contexts, and the estimate where no longer context is kept."""

    one: np.ndarray
    left: np.ndarray
    last: np.ndarray


def _weigh_top(full: np.ndarray, rest: np.ndarray, deeper: np.ndarray, seen: int) -> Top:
    """From byte counts of the contexts of depth 1, those of them in rare contexts of depth 2, and the sums of the
    kept ones' log weighted probabilities."""
    half = np.log(2)
    kept = full.sum(axis=1) >= seen
    tree, rest_tree = _branches(full), _branches(rest)
    stop = _evidence(tree) - half
    weighted = np.logaddexp(stop, _evidence(rest_tree) + deeper - half)
    stay = np.exp(stop - weighted)
    root, root_rest = _branches(full.sum(axis=0, keepdims=True)), _branches(full[~kept].sum(axis=0, keepdims=True))
    root_stop = _evidence(root) - half
    root_stay = np.exp(root_stop - np.logaddexp(root_stop, _evidence(root_rest) + weighted[kept].sum(axis=0) - half))
    one, left = root_stay * _one(root), 1 - root_stay
    root_last = one + left * _one(root_rest)
    one, left = one + left * stay * _one(tree), left * (1 - stay)
    return Top(one, left, np.where(kept[:, None], one + left * _one(rest_tree), root_last))


def _kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1) - np.log(np.pi)


def _starts(keys: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1))


class Subtrees:
    """Weights all contexts of depth 2 and more below whole contexts of depth 2. The grams come with their number in
    training, which may be 0; each gram appears once."""

    def __init__(self, grams: np.ndarray, n: np.ndarray, depth: int, seen: int) -> None:
        self.depth = depth
        key = np.zeros_like(grams)
        for i in range(1, depth + 1):  # the most recent byte first, so that a context's longer ones are neighbours
            key = (key << 8) | (grams >> 8 * i & 0xFF)
        key = (key << 8) | (grams & 0xFF)
        self.order = np.argsort(key)
        self.keys, self.n = {depth: key[self.order]}, {depth: n[self.order].astype(np.float64)}
        self.up: dict[int, np.ndarray] = {}
        for d in range(depth - 1, 1, -1):
            longer = self.keys[d + 1]
            self.keys[d], self.up[d + 1] = np.unique((longer >> 16 << 8) | (longer & 0xFF), return_inverse=True)
            self.n[d] = np.bincount(self.up[d + 1], self.n[d + 1], len(self.keys[d]))
        self.kept, self.rest = {}, {}
        for d in range(2, depth + 1):
            starts = _starts(self.keys[d] >> 8)
            sizes = np.diff(np.append(starts, len(self.keys[d])))
            self.kept[d] = np.repeat(np.add.reduceat(self.n[d], starts) >= seen, sizes)
        for d in range(2, depth):
            rare = np.where(self.kept[d + 1], 0, self.n[d + 1])
            self.rest[d] = np.bincount(self.up[d + 1], rare, len(self.keys[d]))

    def _level(self, level: int) -> dict[int, tuple[np.ndarray, ...]]:
        """For each depth: first rows of the binary nodes of a level, each row's node, log weighted probability,
        the share that stays, and the two estimates."""
        out, half = {}, np.log(2)
        for d in range(self.depth, 1, -1):
            keys = self.keys[d]
            starts = _starts(keys >> 8 - level)
            of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(keys))))
            bit = keys >> 7 - level & 1
            count = lambda n: (np.add.reduceat(n * (1 - bit), starts), np.add.reduceat(n * bit, starts))
            zeros, ones = count(self.n[d])
            own, own_one = _kt(zeros, ones), (ones + 0.5) / (zeros + ones + 1)
            if d == self.depth:
                out[d] = starts, of, own, np.ones_like(own), own_one, own_one
                continue
            below, weighted = out[d + 1][0], out[d + 1][2]
            zeros, ones = count(self.rest[d])
            deeper = np.bincount(of[self.up[d + 1][below]], np.where(self.kept[d + 1][below], weighted, 0), len(starts))
            weighted = np.logaddexp(own - half, _kt(zeros, ones) + deeper - half)
            out[d] = starts, of, weighted, np.exp(own - half - weighted), own_one, (ones + 0.5) / (zeros + ones + 1)
        return out

    def roots(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(kind, context of depth 1, byte or binary node, number, log probability): all bytes (0), those in rare
        contexts of depth 2 (1), and the kept ones' weighted nodes (2)."""
        keys, n, kept = self.keys[2], self.n[2], self.kept[2]
        for kind, rows in ((0, n > 0), (1, (n > 0) & ~kept)):
            yield kind, keys[rows] >> 16, keys[rows] & 0xFF, n[rows], np.zeros(rows.sum())
        for level in range(8):
            starts, _, weighted, *_ = self._level(level)[2]
            rows = kept[starts]
            at = keys[starts[rows]]
            yield 2, at >> 16, (at & 0xFF | 0x100) >> 8 - level, np.zeros(len(at)), weighted[rows]

    def log10(self, top: Top) -> np.ndarray:
        """What the whole tree gives each gram's byte after its context, in the order in which the grams came."""
        keys = self.keys[self.depth]
        rows = {self.depth: np.arange(len(keys))}
        for d in range(self.depth, 2, -1):
            rows[d - 1] = self.up[d][rows[d]]
        before, total = keys >> 8 * self.depth, np.zeros(len(keys))
        for level in range(8):
            nodes = self._level(level)
            p = top.last[before, (keys & 0xFF | 0x100) >> 8 - level]
            for d in range(2, self.depth + 1):
                starts, of, _, stay, own_one, rest_one = nodes[d]
                if d == 2:
                    at = self.keys[2][starts]
                    at = at >> 16, (at & 0xFF | 0x100) >> 8 - level
                    one, left = top.one[at], top.left[at]
                else:
                    at = nodes[d - 1][1][self.up[d][starts]]
                    one, left = one[at], left[at]
                one, left = one + left * stay * own_one, left * (1 - stay)
                p = np.where(self.kept[d][rows[d]], (one + left * rest_one)[of[rows[d]]], p)
            p = np.clip(p, 1e-300, 1 - 1e-16)
            total += np.log10(np.where(keys >> 7 - level & 1, p, 1 - p))
        out = np.empty_like(total)
        out[self.order] = total
        return out


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns of rows sorted by the first one, none of whose values is parted; many small values together."""
    held: list[tuple[np.ndarray, ...]] = []
    waiting = 0
    for batch in batches:
        columns = tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if waiting > _WEIGHED and len(columns[0]):
            joined = tuple(np.concatenate(c) for c in zip(*held, columns, strict=True))
            end = int(np.searchsorted(joined[0], joined[0][-1]))
            if end:
                yield tuple(c[:end] for c in joined)
            held = [tuple(c[end:] for c in joined)]
            waiting = len(joined[0]) - end
        elif len(columns[0]):
            held.append(columns)
            waiting += len(columns[0])
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held, strict=True))


def gram_probabilities(docs: DataFrame, train: DataFrame, text: str = "text", depth: int = DEPTH, seen: int = SEEN) -> DataFrame:
    """(gram, m, log10) for every gram of the documents and the training texts: how often the documents hold it, and
    what the tree of all contexts seen ``seen`` times in training gives its last byte.

    Grams are dealt by their last two context bytes, so all longer contexts are weighted beside their shorter ones;
    the two depths above, 257 contexts, are weighted on the driver.
    """
    spark = train.sparkSession
    ship_package(spark)
    none = F.lit(0).cast("long")
    both = count_grams(train, text, depth).withColumn("m", none).unionByName(
        count_grams(docs, text, depth).select("gram", none.alias("n"), F.col("n").alias("m"))
    )
    recent = F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFF))
    grams = landed(both.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).select(recent.alias("s"), "gram", "n", "m"))
    dealt = grams.repartition("s").sortWithinPartitions("s")

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, codes, n, _ in _whole_groups(batches):
            for kind, context, x, number, log in Subtrees(codes, n, depth, seen).roots():
                arrays = [pa.array(np.full(len(x), kind)), pa.array(context), pa.array(x), pa.array(number.astype(np.int64)), pa.array(log)]
                yield pa.RecordBatch.from_arrays(arrays, names=["kind", "c", "x", "n", "log"])

    # sums of decimals don't depend on the order; at most 3 * 65,536 rows
    sums = (
        dealt.mapInArrow(roots, "kind long, c long, x long, n long, log double").groupBy("kind", "c", "x")
        .agg(F.sum("n").alias("n"), F.sum(F.col("log").cast("decimal(28,10)")).cast("double").alias("log")).toArrow()
    )
    kind, c, x, n, log = (sums[k].to_numpy() for k in ("kind", "c", "x", "n", "log"))
    made = np.zeros((3, 256, 256))
    made[kind, c, x] = np.where(kind == 2, log, n)
    top = spark.sparkContext.broadcast(_weigh_top(*made, seen))

    def probabilities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, codes, n, m in _whole_groups(batches):
            log10 = Subtrees(codes, n, depth, seen).log10(top.value)
            yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(m), pa.array(log10)], names=["gram", "m", "log10"])

    return landed(dealt.mapInArrow(probabilities, "gram long, m long, log10 double"))


@dataclass(frozen=True)
class Lookup:
    """Sorted grams with their log probabilities, and a hash table of their places: open addressing, half filled."""

    codes: np.ndarray
    log10: np.ndarray
    slots: np.ndarray

    @classmethod
    def of(cls, codes: np.ndarray, log10: np.ndarray) -> Lookup:
        slots = np.full(1 << max(1, (2 * len(codes)).bit_length()), -1, np.int32)
        waiting = np.arange(len(codes), dtype=np.int32)
        spot = _spots(codes, len(slots))
        while len(waiting):
            first = np.unique(np.where(slots[spot] < 0, spot, -1), return_index=True)[1]
            first = first[slots[spot[first]] < 0]
            slots[spot[first]] = waiting[first]
            left = np.ones(len(waiting), bool)
            left[first] = False
            waiting, spot = waiting[left], (spot[left] + 1) & (len(slots) - 1)
        return cls(codes, log10, slots)

    def places(self, grams: np.ndarray) -> np.ndarray:
        """Where each gram is among the codes, -1 for one that is not."""
        spot = _spots(grams, len(self.slots))
        found = self.slots[spot]
        # a slot of another gram: go on with the next one, until a slot is free
        open_ = np.flatnonzero((found >= 0) & (self.codes[found] != grams)) if len(self.codes) else np.zeros(0, int)
        while len(open_):
            spot[open_] = (spot[open_] + 1) & (len(self.slots) - 1)
            found[open_] = self.slots[spot[open_]]
            open_ = open_[(found[open_] >= 0) & (self.codes[found[open_]] != grams[open_])]
        return found


def _spots(codes: np.ndarray, size: int) -> np.ndarray:
    mixed = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(65 - size.bit_length())).astype(np.int64)


# --- scoring -------------------------------------------------------------------------------------------------

_FIELDS = {
    "n_tokens": "long", "n_known": "long", "base": "double", "score": "double", "n_bytes": "long",
    "rare": "array<binary>", "rare_n": "array<long>", "grams": "array<long>", "grams_n": "array<long>",
}
COLUMNS = ["n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]


@table_operator(COLUMNS)
def score_texts(docs: DataFrame, train: DataFrame, text: str = "text") -> DataFrame:
    """Replace the text by n_tokens, n_known, train_tokens, base_score, score and bits_per_byte.

    ``score`` is the log10 probability that the context tree gives the lower-cased bytes and the end of the text,
    bits_per_byte the code length over bytes and end. Frequent words' counts and frequent grams' probabilities go to
    every task, at most 1 / WORD_SHARE and COMMON_GRAMS of them; rarer ones meet theirs in a join, in which no word has
    more than the training tokens' WORD_SHARE and no gram more than 2 / COMMON_GRAMS of the documents' bytes. Null and empty texts have the end token only. Without training rows all tokens are
    unknown and each byte gets 1/256. Repeated rows get the same answer; columns with the new names are replaced,
    all others but the text stay; an empty table stays empty.
    """
    ship_package(docs.sparkSession)
    # all Python runs before this returns: the result joins what is written
    with arrow_batches(docs.sparkSession, BATCH):
        return _scored(docs, train, text)


def _scored(docs: DataFrame, train: DataFrame, text: str) -> DataFrame:
    spark = docs.sparkSession
    grams = gram_probabilities(docs, train, text)
    digits = F.length(F.bin("m"))
    least, taken = 64, 0
    for row in sorted(grams.where("m > 0").groupBy(digits.alias("digits")).count().collect(), reverse=True):
        if (taken := taken + row["count"]) > COMMON_GRAMS:
            break
        least = row["digits"]
    is_common = (F.col("m") > 0) & (digits >= least)
    common = grams.where(is_common).select("gram", "log10").toArrow()
    model = spark.sparkContext.broadcast(Lookup.of(common["gram"].to_numpy(), common["log10"].to_numpy()))
    counts = landed(count_words(train, text))
    tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    is_frequent = F.col("n") >= F.lit(max(1, tokens * WORD_SHARE))
    frequent = spark.sparkContext.broadcast({bytes(r[0]): math.log10(r[1] + 1) for r in counts.where(is_frequent).toLocalIterator()})

    def by_words(text: bytes) -> tuple[int, int, float, list[bytes], list[int]]:
        found = Counter(words(text.translate(LOWER)))
        found[b""] += 1
        known, logs, rare, rare_n, table = 0, 0.0, [], [], frequent.value
        for word, n in found.items():
            if word in table:
                known += n
                logs += n * table[word]
            else:
                rare.append(word)
                rare_n.append(n)
        return sum(found.values()), known, logs, rare, rare_n

    def by_grams(texts: list[bytes]) -> tuple[np.ndarray, list[list[int]], list[list[int]]]:
        """Each text's sum over the common grams, and its other grams with their numbers."""
        scores, grams, grams_n = np.zeros(len(texts)), [[] for _ in texts], [[] for _ in texts]
        table = model.value
        for codes, owner in _grams_by_text(texts, DEPTH):
            at = table.places(codes)
            here = at >= 0
            scores += np.bincount(owner[here], table.log10[at[here]], len(texts))
            codes, owner = codes[~here], owner[~here]
            order = np.lexsort((codes, owner))
            codes, owner = codes[order], owner[order]
            new = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1])][: len(codes)])
            for who, gram, n in zip(owner[new].tolist(), codes[new].tolist(), np.diff(np.r_[new, len(codes)]).tolist()):
                grams[who].append(gram)
                grams_n[who].append(n)
        return scores, grams, grams_n

    def run(texts: pa.Array) -> pa.Array:
        made = []
        for (part,) in pieces([texts]):
            part = [t or b"" for t in part]
            scores, grams, grams_n = by_grams(part)
            rows = []
            for text, score, own, own_n in zip(part, scores.tolist(), grams, grams_n, strict=True):
                total, known, logs, rare, rare_n = by_words(text)
                rows.append((total, known, logs, score, len(text), rare, rare_n, own, own_n))
            made.append(struct_of(rows, _FIELDS))
        return pa.concat_arrays(made) if made else struct_of([], _FIELDS)

    kinds = "struct<" + ",".join(f"{n}:{k}" for n, k in _FIELDS.items()) + ">"
    udf = F.arrow_udf(run, kinds).asNondeterministic()
    others = [c for c in docs.columns if c != text and c not in COLUMNS]
    # written once: both uses, and any retry, see the same row numbers
    scored = landed(
        docs.withColumn("__s", udf(F.col(quoted(text)).cast("binary"))).withColumn("__row", F.monotonically_increasing_id())
        .select(*[quoted(c) for c in others], "__s", "__row")
    )
    met = (
        scored.select("__row", F.explode(F.arrays_zip(F.col("__s.rare").alias("word"), F.col("__s.rare_n").alias("k"))).alias("t"))
        .select("__row", "t.word", "t.k").join(counts.where(~is_frequent), "word")
        .groupBy("__row").agg(F.sum("k").alias("__k"), F.sum(F.col("k") * F.log10(F.col("n") + 1)).alias("__l"))
    )
    looked_up = (
        scored.select("__row", F.explode(F.arrays_zip(F.col("__s.grams").alias("gram"), F.col("__s.grams_n").alias("k"))).alias("t"))
        .select("__row", "t.gram", "t.k").join(grams.where(~is_common).select("gram", "log10"), "gram")
        .groupBy("__row").agg(F.sum(F.col("k") * F.col("log10")).alias("__g"))
    )
    share = math.log10(tokens + distinct + 1)
    s = lambda name: F.col("__s")[name]
    score = s("score") + F.coalesce("__g", F.lit(0.0))
    return scored.join(met, "__row", "left").join(looked_up, "__row", "left").select(
        *[quoted(c) for c in others], s("n_tokens").alias("n_tokens"),
        (s("n_known") + F.coalesce("__k", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (s("base") + F.coalesce("__l", F.lit(0.0)) - s("n_tokens") * F.lit(share)).alias("base_score"),
        score.alias("score"), (-score / F.log10(F.lit(2.0)) / (s("n_bytes") + 1)).alias("bits_per_byte"),
    )
