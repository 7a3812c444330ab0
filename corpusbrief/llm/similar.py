"""Near duplicates by word shingles: every pair of texts whose sets of five-word shingles have a Jaccard similarity of 0.8
ends in one component.

First SimHash blocks join most of what is alike: fingerprints of word pairs meet by keys of 3 of 11 blocks, a few of the keys only. Within a
bucket no pairs are listed: its close fingerprints are covered by stars, each around the member next to the
majority of its neighbours' bits, which in a group of edited copies is the text they were made from. A star's rays
are checked by the whole shingle sets, which only candidates' texts are read for.

Then an exact join finds the rest, between the components so far. All shingles have one order, common ones last; of two sets
that are similar enough the first common shingle is among the first fifth of either, and what can follow it in both must still
suffice (prefix and position filters). So texts are dealt by these first shingles, and pairs of different components that pass the
filters are checked by counts of their shingles by classes, which bound what they share, and then by the whole sets. This is done twice: large buckets alone propose a few pairs of each member with
other components, which joins most of a dense group; then all pairs that are still of different components. Which shingles count as common comes from a sample of SAMPLE texts; it decides how large buckets
are, not what is found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import arrow_batches, discard, landed, release_shuffles, shared_path, ship_package
from .neardup import SEED, block_keys, components, simhash
from .texts import LOWER, may_be_among, pieces, quoted, table_operator, with_text_columns, words

SHINGLE = 5
SIMILARITY = 0.8
#: Words of the shingles that make the fingerprints.
PRINT_SHINGLE = 2
BLOCKS = (6, 6, 6, 6, 6, 6, 6, 6, 6, 5, 5)
#: Blocks in a key.
CHOSEN = 3
#: One key in so many comes first.
FIRST = 8
#: Bits in which a candidate may differ.
DISTANCE = 12
#: Buckets up to this size are compared all at once, whatever bucket they are in.
SMALL = 8
#: Members of one bucket that are held at a time.
HELD = 1 << 18
#: Texts from which common shingles are learnt, in how many of them such a one is, and how many are kept.
SAMPLE = 1 << 13
OFTEN = 4
COMMON = 1 << 16
#: Buckets up to this size are compared by how far apart members lie.
LAGS = 32
#: Classes of hashes that are counted in every set at least, hashes for which there is a class more, and the largest count.
CLASSES = 128
A_CLASS = 4
MANY = (1 << 8) - 1
#: Pairs of a member and another component that a larger bucket proposes at first, and times as many of a member in all.
EACH = 4
IN_ALL = 2
#: Bytes of texts or sets that go to Python at a time.
BATCH = 2 << 20
COLUMNS = ["component_id", "component_root"]


def shingle_set(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles of the lower-cased words; fewer words are one, none are none."""
    found = words(text.translate(LOWER)) if text else []
    if not found:
        return np.zeros(0, np.uint64)
    grams = (b" ".join(found[i : i + shingle]) for i in range(max(1, len(found) - shingle + 1)))
    return np.unique(np.fromiter((xxhash.xxh3_64_intdigest(g, SEED) for g in grams), np.uint64))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; two empty ones are alike."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def stars(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """(centre, member) places that cover all members with a neighbour within ``distance`` bits."""
    waiting, found = np.arange(len(fps)), []
    while len(waiting) > 1:
        seed = waiting[0]
        near = waiting[np.bitwise_count(fps[waiting] ^ fps[seed]) <= distance]
        if len(near) == 1:
            waiting = waiting[1:]
            continue
        bits = np.unpackbits(fps[near].view(np.uint8).reshape(-1, 8), axis=1)
        middle = np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(near)).view(np.uint64)[0]
        centre = near[np.argmin(np.bitwise_count(fps[near] ^ middle))]
        if np.bitwise_count(fps[centre] ^ fps[seed]) > distance:
            centre = seed
        mine = np.bitwise_count(fps[waiting] ^ fps[centre]) <= distance
        found += [(int(centre), int(m)) for m in waiting[mine] if m != centre]
        waiting = waiting[~mine]
    return found


def bucket_stars(keys: np.ndarray, fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """The stars of all buckets of rows sorted by key, as places of rows."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    sizes = np.diff(np.r_[starts, len(keys)])
    of = np.repeat(np.arange(len(starts)), sizes)
    close = sizes > SMALL
    # in small buckets all pairs are compared by how far apart they lie; hardly any has a close one
    for lag in range(1, min(SMALL, int(sizes.max(initial=1)))):
        rows = np.flatnonzero(of[lag:] == of[:-lag])
        near = rows[np.bitwise_count(fps[rows + lag] ^ fps[rows]) <= distance]
        close[of[near]] = True
    found = []
    for group in np.flatnonzero(close).tolist():
        start, size = int(starts[group]), int(sizes[group])
        found += [(start + a, start + b) for a, b in stars(fps[start : start + size], distance)]
    return found


def _candidates(nodes: DataFrame, distance: int, first: bool | None = None) -> DataFrame:
    """Distinct (a, b) of ``nodes(node, fp, component)``: centres and members of the stars of all buckets that are of
    different components; by the first keys only, or the others, or all.

    A bucket that outgrows HELD members is worked on in parts, with the centres of its earlier parts.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            for number, key in enumerate(block_keys(fps, BLOCKS, len(BLOCKS) - CHOSEN)):
                if first is None or first == (number % FIRST == 0):
                    yield pa.RecordBatch.from_arrays([pa.array(key), *(batch.column(i) for i in (1, 0, 2))], names=["key", "fp", "node", "component"])

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 4
        seen: set[tuple[int, int]] = set()

        def covered(rows: list[np.ndarray]) -> tuple[pa.RecordBatch, list[int]]:
            keys, fps, nodes, of = rows
            found = bucket_stars(keys, fps.view(np.uint64), distance)
            pairs = {(int(nodes[a]), int(nodes[b])) for a, b in found if of[a] != of[b]} - seen
            # most pairs share many keys
            if len(seen) > 1 << 16:
                seen.clear()
            seen.update(pairs)
            a, b = zip(*pairs, strict=True) if pairs else ((), ())
            made = pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
            return made, sorted({a for a, _ in found})

        for batch in batches:
            held = [np.concatenate((h, c.to_numpy(zero_copy_only=False))) for h, c in zip(held, batch.columns, strict=True)]
            keys = held[0]
            end = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if end:
                yield covered([h[:end] for h in held])[0]
                held = [h[end:] for h in held]
            if len(held[0]) > HELD:
                made, centres = covered(held)
                yield made
                held = [h[centres] for h in held]
        if len(held[0]):
            yield covered(held)[0]

    dealt = nodes.select("node", "fp", "component").mapInArrow(deal, "key long, fp long, node long, component long")
    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(cover, "a long, b long").distinct()


def first_shingles(shingles: np.ndarray, common: np.ndarray, least: float) -> np.ndarray:
    """Upper halves of the hashes that a similar set shares one of: the first of ``shingles`` (sorted) by the common
    order, in which ``common`` (sorted hashes, and their ranks from 1) come last. An empty set has a place of its own."""
    n = len(shingles)
    if not n:
        return np.zeros(1, np.uint32)
    rank = np.zeros(n, np.int64)
    if len(common[0]):
        at = np.minimum(np.searchsorted(common[0], shingles), len(common[0]) - 1)
        rank = np.where(common[0][at] == shingles, common[1][at].astype(np.int64), 0)
    first = np.argsort(rank, kind="stable")[: n - math.ceil(least * n - 1e-6) + 1]
    return (shingles[first] >> np.uint64(32)).astype(np.uint32)


def class_counts(shingles: np.ndarray) -> np.ndarray:
    """How many of the hashes are in each class; the largest number stands for any that is larger.

    Classes are the first bits of hashes. The larger the set, the more there are: with dozens of hashes in each, any two
    sets would have about the same counts.
    """
    bits = max(CLASSES, 1 << (len(shingles) // A_CLASS).bit_length()).bit_length() - 1
    return np.minimum(np.bincount((shingles >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), MANY).astype(np.uint8)


def can_be_similar(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Whether sets with the class counts in the rows of ``x`` and ``y`` can be similar: two sets share at most the smaller
    number of each class. The finer classes of one side are summed to those of the other."""
    many = (x == MANY).any(axis=1) | (y == MANY).any(axis=1)
    classes = min(x.shape[1], y.shape[1])
    x, y = (c.reshape(len(c), classes, c.shape[1] // classes).sum(axis=2, dtype=np.int64) for c in (x, y))
    return many | (np.minimum(x, y).sum(axis=1) >= least / (1 + least) * (x + y).sum(axis=1) - 1e-6)


def _possible(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Those (a, b) that can be similar by ``nodes(node, counts)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [batch.column(i) for i in (2, 3)]
            sizes = np.stack([pc.binary_length(side).to_numpy(zero_copy_only=False) for side in sides], axis=1)
            enough = np.zeros(len(sizes), bool)
            for kind in np.unique(sizes, axis=0):
                rows = np.flatnonzero((sizes == kind).all(axis=1))
                x, y = (np.frombuffer(b"".join(side.take(pa.array(rows)).to_pylist()), np.uint8).reshape(len(rows), -1) for side in sides)
                enough[rows] = can_be_similar(x, y, least)
            yield batch.select([0, 1]).filter(pa.array(enough))

    first = nodes.select(F.col("node").alias("a"), F.col("counts").alias("x"))
    second = nodes.select(F.col("node").alias("b"), F.col("counts").alias("y"))
    return pairs.join(second, "b").join(first, "a").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _common(docs: DataFrame, text: str, texts: int, shingle: int) -> np.ndarray:
    """Sorted hashes of common shingles, and their ranks: COMMON of them at most, from SAMPLE texts or so."""

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (part,) in pieces(batch.columns, 64):
                found = np.concatenate([shingle_set(t, shingle) for t in part])
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["shingle"])

    share = max(1, texts // SAMPLE)
    drawn = docs.where(F.pmod(_names(text)[1], F.lit(share)) == 0).select(F.col(quoted(text)).cast("binary").alias("body"))
    counts = drawn.mapInArrow(shingled, "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    found = counts.where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "shingle").limit(COMMON).collect()
    hashes = np.array([r.shingle for r in reversed(found)], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return np.stack((hashes[order], (order + 1).astype(np.uint64)))


def earlier_shingles(tokens: np.ndarray) -> np.ndarray:
    """For each of a text's first shingles, two that stand before it: the very first, and the one that is smallest in an order of
    another kind. Two texts that share some tend to have the same ones."""
    mixed = np.minimum.accumulate((tokens * _MIXER) & 0xFFFFFFFF)
    return (tokens[0] << 32) | np.r_[0, mixed[:-1]]


def possible_pairs(
    packed: np.ndarray, nodes: np.ndarray, of: np.ndarray, spots: np.ndarray, earlier: np.ndarray, least: float, each: int | None = None,
) -> np.ndarray:
    """(a, b) of different components that meet in a bucket and whose sets can be similar, each once; or with ``each`` those of
    large buckets alone, and so many of a member with another component, IN_ALL times as many in all, those that can share the most.

    Rows are sorted by ``packed``, the bucket and the shingle before it; ``spots`` are the set's size and the place in it.
    A pair that shares the shingle before as well, or one of the ``earlier`` ones, has met in that one's bucket.
    """
    keys = packed >> 32
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    mixed = np.minimum.reduceat(of, starts) != np.maximum.reduceat(of, starts)
    sizes = np.diff(np.r_[starts, len(keys)])
    rows = np.flatnonzero(np.repeat(mixed, sizes))
    bucket, sizes = np.repeat(np.arange(mixed.sum()), sizes[mixed]), sizes[mixed]
    nodes, of, before = nodes[rows], of[rows], packed[rows] & 0xFFFFFFFF
    size, place = spots[rows] >> 32, spots[rows] & 0xFFFFFFFF
    lead, mixed = earlier[rows] >> 32, earlier[rows] & 0xFFFFFFFF

    def alike(i: np.ndarray, j: np.ndarray | int) -> np.ndarray:
        small, large = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
        left = np.minimum(size[i] - place[i], size[j] - place[j])
        met = ((before[i] == before[j]) | (lead[i] == lead[j]) | (mixed[i] == mixed[j])) & (place[i] > 0) & (place[j] > 0)
        enough = (small >= least * large - 1e-6) & (left >= least / (1 + least) * (small + large) - 1e-6)
        return (of[i] != of[j]) & ~met & (enough | (large == 0))

    found = [np.zeros((0, 2), np.int64)]
    few = np.flatnonzero(sizes[bucket] <= LAGS) if len(rows) and not each else rows[:0]
    for lag in range(1, LAGS):
        i = few[:-lag][bucket[few[:-lag]] == bucket[few[lag:]]]
        if not len(i):
            break
        i = i[alike(i, i + lag)]
        found.append(np.stack((nodes[i], nodes[i + lag]), axis=1))
    ends = np.cumsum(sizes)
    for number in np.flatnonzero(sizes > LAGS).tolist():
        # members of the largest component come first and are not compared with each other
        own = np.arange(ends[number] - sizes[number], ends[number])
        kinds, kind, counts = np.unique(of[own], return_inverse=True, return_counts=True)
        largest = kind == np.argmax(counts)
        own = np.r_[own[largest], own[~largest]]
        for k in range(int(largest.sum()), len(own)):
            i = own[:k][alike(own[:k], own[k])]
            if each and len(i) > each:
                left = np.minimum(size[i] - place[i], size[own[k]] - place[own[k]])
                first = np.lexsort((-left, of[i]))
                i, left = i[first], left[first]
                some = np.flatnonzero(np.r_[np.ones(each, bool), of[i[each:]] != of[i[:-each]]])
                i = i[some[np.argsort(-left[some], kind="stable")[: IN_ALL * each]]]
            found.append(np.stack((nodes[i], np.full(len(i), nodes[own[k]])), axis=1))
    return np.unique(np.sort(np.concatenate(found), axis=1), axis=0)


_MEMBERS = ["packed", "node", "component", "spot", "earlier"]
_MEMBER = ", ".join(f"{m} long" for m in _MEMBERS)
#: An odd number: times this, the lower 32 bits are as different as before.
_MIXER = 0x9E3779B1


def _meeting(members: DataFrame, least: float, most: int | None, each: int | None, path: str) -> DataFrame:
    """Of members of buckets: (node, other), the possible pairs; and with no other, as they come, the members of buckets with
    more than ``most``."""

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * len(_MEMBERS)
        crowded = None

        def made(rows: list[np.ndarray], pairs: bool) -> pa.RecordBatch:
            if pairs:
                found = possible_pairs(*rows, least, each) if len(rows[0]) else np.zeros((0, 2), np.int64)
                none = pa.nulls(len(found), pa.int64())
                columns = [none, pa.array(found[:, 0]), none, none, none, pa.array(found[:, 1])]
            else:
                columns = [*map(pa.array, rows), pa.nulls(len(rows[0]), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=[*_MEMBERS, "other"])

        for batch in batches:
            held = [np.concatenate((h, c.to_numpy(zero_copy_only=False))) for h, c in zip(held, batch.columns, strict=True)]
            if crowded is not None:
                more = int(np.searchsorted(held[0] >> 32, crowded, "right"))
                yield made([h[:more] for h in held], False)
                held = [h[more:] for h in held]
                crowded = crowded if not len(held[0]) else None
            end = int(np.searchsorted(held[0] >> 32, held[0][-1] >> 32)) if len(held[0]) else 0
            if end:
                yield made([h[:end] for h in held], True)
                held = [h[end:] for h in held]
            if most and len(held[0]) > most:
                crowded = held[0][0] >> 32
                yield made(held, False)
                held = [h[:0] for h in held]
        yield made(held, True)

    dealt = members.repartition(F.shiftright("packed", 32)).sortWithinPartitions("packed")
    met = landed(dealt.mapInArrow(cover, _MEMBER + ", other long"), path)
    release_shuffles(members.sparkSession)
    return met


def _exact(nodes: DataFrame, least: float, most: int, each: int | None, work: str) -> DataFrame:
    """Distinct (a, b) of ``nodes(node, component, size, first)``: all pairs of different components that can be similar, or
    with ``each`` only so many of a member with another component, of large buckets.

    Buckets of more than ``most`` members are dealt again by pairs of their parts, so that no task holds a whole one. What is
    written on the way goes below ``work``.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for numbers, components_, sizes, firsts in (part for batch in batches for part in pieces(batch.columns)):
            tokens = [np.frombuffer(f, np.uint32).astype(np.int64) for f in firsts]
            counts = [len(t) for t in tokens]
            before = np.concatenate([np.r_[0, t[:-1]] for t in tokens])
            place = np.concatenate([np.arange(c) for c in counts])
            columns = [
                (np.concatenate(tokens) << 32) | before, *(np.repeat(np.array(x, np.int64), counts) for x in (numbers, components_)),
                (np.repeat(np.array(sizes, np.int64), counts) << 32) | place, np.concatenate([earlier_shingles(t) for t in tokens]),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=_MEMBERS)

    members = nodes.select("node", "component", "size", "first").mapInArrow(deal, _MEMBER)
    met = _meeting(members, least, most, each, f"{work}/met")
    pairs, crowded = met.where(F.col("other").isNotNull()), met.where(F.col("other").isNull()).drop("other")
    if crowded.limit(1).count():
        parts = crowded.groupBy(F.shiftright("packed", 32).alias("key")).agg(F.ceil(2 * F.count(F.lit(1)) / most).cast("int").alias("parts"))
        own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
        spread = crowded.join(parts, F.shiftright("packed", 32) == F.col("key")).withColumn("i", own).withColumn(
            "j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        )
        place = F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j"))
        packed = F.shiftleft(place, 32).bitwiseOR(F.col("packed").bitwiseAND(F.lit(0xFFFFFFFF)))
        again = _meeting(spread.select(packed.alias("packed"), *_MEMBERS[1:]), least, None, each, f"{work}/again")
        pairs = pairs.unionByName(again.where(F.col("other").isNotNull()))
    return pairs.select(F.col("node").alias("a"), F.col("other").alias("b")).distinct()


def _sets(docs: DataFrame, text: str, wanted: DataFrame, shingle: int, path: str) -> DataFrame:
    """(node, shingles) of the written ``wanted(ta, tb, node)``; only texts that may be wanted are moved, of equal ones each task
    sends one."""

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            fresh = []
            for name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fresh.append(name not in seen)
                seen.add(name)
            yield batch.filter(pa.array(fresh, pa.bool_()))

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, texts in (part for batch in batches for part in pieces(batch.columns)):
            sets = [shingle_set(t, shingle).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], names=["node", "shingles"])

    named, _ = may_be_among(wanted, "ta")(docs.select(*_names(text), F.col(quoted(text)).cast("binary").alias("body")), F.col("ta"))
    found = named.mapInArrow(once, "ta long, tb long, body binary").join(wanted, ["ta", "tb"])
    return landed(found.select("node", "body").mapInArrow(shingled, "node long, shingles binary").dropDuplicates(["node"]), path)


def _names(text: str) -> list:
    """Two hashes that tell texts apart; null is as empty."""
    source = F.coalesce(F.col(quoted(text)).cast("string"), F.lit(""))
    return [F.xxhash64(source).alias("ta"), F.xxhash64(F.lit(1), source).alias("tb")]


def _confirmed(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar. Joined rather than gathered: AQE splits a hot centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for part in pieces(batch.columns, 64):
                for a, b, x, y in zip(*part, strict=True):
                    small, large = sorted((len(x), len(y)))
                    if small >= least * large and similarity(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= least:
                        kept.append((a, b))
            a, b = zip(*kept, strict=True) if kept else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    first = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    second = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return landed(pairs.join(second, "b").join(first, "a").select("a", "b", "x", "y").mapInArrow(run, "a long, b long"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


@table_operator(COLUMNS)
def link_similar(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, least: float = SIMILARITY, distance: int = DISTANCE,
) -> DataFrame:
    """Add component_id, the smallest key that chains of texts with similar shingle sets reach, and component_root, a
    number that stands for the component; the text is left out.

    Equal texts are one node. Null and empty texts, and others without words, are alike. Null keys are no candidates
    for the smallest one. Repeated rows each stay; columns with the new names are replaced, others stay; an empty
    table stays empty. All pairs of similar texts end in one component, and no others (but for collisions of hashes).
    """
    ship_package(docs.sparkSession)
    # all Python runs before this returns: the result joins what is written
    with arrow_batches(docs.sparkSession, BATCH):
        return _linked(docs, key, text, shingle, least, distance)


def _linked(docs: DataFrame, key: str, text: str, shingle: int, least: float, distance: int) -> DataFrame:
    kept = [c for c in docs.columns if c != text]
    common = _common(docs, text, docs.count(), shingle)

    def signed(t: bytes | None) -> tuple[int, int, bytes, bytes]:
        h, found = simhash(t, PRINT_SHINGLE), shingle_set(t, shingle)
        first = first_shingles(found, common, least)
        return h - (1 << 64 if h >> 63 else 0), len(found), first.tobytes(), class_counts(found).tobytes()

    named = docs.select(*[quoted(c) for c in docs.columns], *[n.alias(f"__{a}") for n, a in zip(_names(text), ("ta", "tb"))])
    made = with_text_columns(named, text, {"__fp": "long", "__size": "long", "__first": "binary", "__counts": "binary"}, signed)
    marked = landed(made.drop(text))
    texts = marked.groupBy(F.col("__ta").alias("ta"), F.col("__tb").alias("tb")).agg(
        *[F.first(f"__{c}").alias(c) for c in ("fp", "size", "first", "counts")], F.min(quoted(key)).alias("lowest")
    )
    nodes = landed(texts.withColumn("node", F.monotonically_increasing_id()))

    alone = nodes.select("node", "fp", F.col("node").alias("component"))
    sets, edges, met = None, None, None
    # what no later step reads is deleted: the tables of a round with it, the sets and their names at the end
    work = shared_path(docs.sparkSession, "similar")

    def confirm(pairs: DataFrame, now: str) -> None:
        nonlocal sets, edges, met
        # written, as are the wanted names, so that Spark knows how few they are before it moves what is joined with them
        proposed = landed(pairs, f"{now}/proposed")
        release_shuffles(docs.sparkSession)
        pairs = landed(_possible(proposed, nodes, least), f"{now}/pairs")
        release_shuffles(docs.sparkSession)
        ends = _ends(pairs)
        fresh = ends if met is None else ends.join(met, "node", "left_anti")
        wanted = landed(nodes.join(fresh, "node").select("ta", "tb", "node"), f"{work}/wanted{now[-1]}")
        more = _sets(docs, text, wanted, shingle, f"{work}/sets{now[-1]}")
        # texts were moved, as the sets will be
        release_shuffles(docs.sparkSession)
        fresh = wanted.select("node")
        sets, met = (more, fresh) if sets is None else (sets.unionByName(more), met.unionByName(fresh))
        good = _confirmed(pairs, sets, least)
        edges = good if edges is None else edges.unionByName(good)
        discard(docs.sparkSession, now)
        release_shuffles(docs.sparkSession)

    confirm(_candidates(alone, distance, True), f"{work}/0")
    for number, each in enumerate((EACH, None), 1):
        so_far = components(edges).withColumnsRenamed({"node": "__n", "root": "__r"})
        now = f"{work}/{number}"
        of = F.coalesce("__r", "node").alias("component")
        joined = landed(nodes.join(so_far, F.col("node") == F.col("__n"), "left").select("node", of, "size", "first"), f"{now}/nodes")
        confirm(_exact(joined, least, HELD, each, now), now)
    discard(docs.sparkSession, work)
    roots = components(edges)
    grouped = nodes.join(roots.withColumnsRenamed({"node": "__n", "root": "__r"}), F.col("node") == F.col("__n"), "left")
    grouped = grouped.withColumn("__root", F.coalesce("__r", "node"))
    smallest = grouped.groupBy(F.col("__root").alias("r")).agg(F.min("lowest").alias("__component"))
    owners = landed(grouped.join(smallest, F.col("__root") == F.col("r")).select("ta", "tb", "__component", "__root"))
    joined = marked.join(owners, (F.col("__ta") == F.col("ta")) & (F.col("__tb") == F.col("tb")), "left")
    return joined.select(
        *[quoted(c) for c in kept], F.col("__component").alias("component_id"), F.col("__root").alias("component_root")
    )
