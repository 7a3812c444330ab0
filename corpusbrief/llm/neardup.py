"""SimHash near-dedup: fingerprints, candidate blocks by the pigeonhole principle, and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import landed, ship_package
from .texts import LOWER, may_be_among, quoted, table_operator, with_text_columns, words

SHINGLE = 4
SEED = 42
DISTANCE = 4
#: Bits of each block; any DISTANCE changed bits leave BLOCKS - DISTANCE blocks as they are.
BLOCKS = (10, 9, 9, 9, 9, 9, 9)
#: Finer blocks for crowded buckets: what shares a key of these has at most 24 bits left to differ in, so
#: a bucket has at most 2 ** 24 fingerprints.
FINE_BLOCKS = (6, 6, 6, 6, 6, 6, 6, 6, 6, 5, 5)
#: Fingerprints of a bucket beyond which it is dealt again by the finer blocks.
BUCKET = 1 << 17
COLUMNS = ["fingerprint", "component_id", "component_root"]


def simhash(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is 1 if it is set in over half the hashes of the shingles; 0 without words."""
    found = words(text.translate(LOWER)) if text else []
    n = len(found)
    if not n:
        return 0
    joined = b" ".join(found)
    if n <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, n) + 1)
    starts = np.concatenate(([0], ends[: n - shingle])).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a : b - 1], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], ">u8")
        votes += np.unpackbits(part.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big")


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "__fp") -> DataFrame:
    """Add the fingerprint as a signed long."""
    signed = lambda t: ((h := simhash(t)) - (1 << 64 if h >> 63 else 0),)
    return with_text_columns(docs, text, {name: "long"}, signed)


def block_keys(fps: np.ndarray, blocks: tuple[int, ...], distance: int) -> Iterator[np.ndarray]:
    """For each choice of blocks that ``distance`` changes can leave alone, the key of each fingerprint: the
    choice's number and the bits of its blocks, exact, not hashed."""
    starts = [sum(blocks[:i]) for i in range(len(blocks))]
    pieces = [(fps >> np.uint64(s)) & np.uint64((1 << w) - 1) for s, w in zip(starts, blocks, strict=True)]
    for number, chosen in enumerate(combinations(range(len(blocks)), len(blocks) - distance)):
        key = np.full(len(fps), number, np.uint64)
        for b in chosen:
            key = (key << np.uint64(blocks[b])) | pieces[b]
        yield key.view(np.int64)


class Forest:
    """Union by smallest number."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (above := up.setdefault(x, x)) != x:
            up[x] = up[above]
            x = above
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def edges(self) -> list[tuple[int, int]]:
        return [(x, r) for x in list(self.up) if (r := self.root(x)) != x]


def link_bucket(members: np.ndarray, distance: int, forest: Forest) -> None:
    """Join all members that chains of at most ``distance`` changed bits connect.

    A search from each unreached member compares with unreached ones only, so a dense group costs a few
    rounds and no pair is listed.
    """
    waiting = members.astype(np.int64).view(np.uint64)
    while len(waiting) > 1:
        front, waiting = [waiting[0]], waiting[1:]
        while front and len(waiting):
            at = front.pop()
            near = np.bitwise_count(waiting ^ at) <= distance
            if near.any():
                found, waiting = waiting[near], waiting[~near]
                here = int(at.astype(np.int64))
                for x in found.view(np.int64).tolist():
                    forest.join(here, x)
                front.extend(found)


def _linked(buckets: DataFrame, distance: int, bucket: int | None) -> DataFrame:
    """From (key, fp), dealt and sorted by key: edges (a, b); and (fp, null) for members of a bucket with more
    than ``bucket``, which are passed on as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, parts = Forest(), []
        open_key, size, crowded = None, 0, False

        def edges() -> pa.RecordBatch:
            made = np.array(forest.edges(), np.int64).reshape(-1, 2)
            forest.up.clear()
            return pa.RecordBatch.from_arrays([pa.array(made[:, 0]), pa.array(made[:, 1])], names=["a", "b"])

        for batch in batches:
            keys, fps = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            cuts = (np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist()
            for start, end in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if start == end:
                    continue
                if keys[start] != open_key:
                    if size > 1 and not crowded:
                        link_bucket(np.concatenate(parts), distance, forest)
                    open_key, parts, size, crowded = keys[start], [], 0, False
                parts.append(fps[start:end])
                size += end - start
                if bucket and (crowded or size > bucket):
                    crowded, members = True, np.concatenate(parts)
                    parts = []
                    yield pa.RecordBatch.from_arrays([pa.array(members), pa.nulls(len(members), pa.int64())], names=["a", "b"])
            if len(forest.up) > 1 << 20:
                yield edges()
        if size > 1 and not crowded:
            link_bucket(np.concatenate(parts), distance, forest)
        yield edges()

    return buckets.mapInArrow(run, "a long, b long")


def _dealt(fps: DataFrame, blocks: tuple[int, ...], distance: int) -> DataFrame:
    """(key, fp) for all keys, dealt and sorted by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0)
            for key in block_keys(own.to_numpy(zero_copy_only=False).view(np.uint64), blocks, distance):
                yield pa.RecordBatch.from_arrays([pa.array(key), own], names=["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key long, fp long").repartition("key").sortWithinPartitions("key")


def linked_fingerprints(fps: DataFrame, distance: int = DISTANCE, blocks=BLOCKS, bucket: int = BUCKET, fine=FINE_BLOCKS) -> DataFrame:
    """Edges (a, b) which connect all of the distinct ``fp`` that chains of close pairs connect.

    Pairs within ``distance`` bits share the bits of at least one choice of blocks. Fingerprints are dealt by
    these keys; every bucket gives a spanning forest, no list of pairs. The members of buckets with more than ``bucket``
    fingerprints are dealt again by the finer blocks, which is exact for them by the same principle.
    """
    ship_package(fps.sparkSession)
    found = landed(_linked(_dealt(fps, blocks, distance), distance, bucket))
    edges = found.where(F.col("b").isNotNull())
    crowded = found.where(F.col("b").isNull()).select(F.col("a").alias("fp")).distinct()
    if crowded.limit(1).count():
        edges = edges.unionByName(landed(_linked(_dealt(crowded, fine, distance), distance, None)))
    return edges


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's component, for nodes with edges (a, b).

    Rounds of large and small stars: every node hands its larger neighbours to its smallest one, then its
    smaller ones. Only minima are gathered for a node, map-side first, so a hub is a join that AQE can split.
    Minima and rounds are written, so joins read plain shuffles and lineage is cut; the number of rounds grows with the logarithm of the paths.
    """
    current = landed(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = landed(both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.first("a")).alias("m")))
        large = both.where("b > a").join(lowest, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = landed(large.where("a != b").distinct())
        lowest = landed(large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")))
        small = large.join(lowest, F.col("a") == F.col("n"))
        current = landed(
            small.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(small.select("a", F.col("m").alias("b"))).where("a != b").distinct()
        )
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state


@table_operator(COLUMNS)
def link_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """Add fingerprint (16 hex digits), component_id, the smallest key that chains of documents with at most four
    differing bits reach, and component_root, the fingerprint that stands for the component.

    Documents with one fingerprint are one node, so copies never meet as pairs. Null and empty texts have the
    fingerprint 0 and link like any other. Null keys are no candidates for the smallest one (null if a component
    has no other). Repeated rows each stay; columns with the new names are replaced, others stay, but the text
    only with ``keep_text``; an empty table stays empty.
    """
    kept = [c for c in docs.columns if c not in COLUMNS and (keep_text or c != text)]
    marked = landed(with_fingerprint(docs, text).select(*[quoted(c) for c in kept], "__fp"))
    classes = landed(marked.groupBy(F.col("__fp").alias("fp")).agg(F.min(quoted(key)).alias("lowest")))
    roots = components(linked_fingerprints(classes.select("fp")))
    grouped = classes.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = grouped.groupBy(F.col("root").alias("r")).agg(F.min("lowest").alias("__component"))
    named = landed(grouped.join(smallest, F.col("root") == F.col("r")).select(
        F.col("fp").alias("__of"), "__component", F.col("root").alias("__root")
    ))
    digits = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return marked.join(named, F.col("__fp") == F.col("__of"), "left").select(
        *[quoted(c) for c in kept], digits("__fp").alias("fingerprint"), F.col("__component").alias("component_id"),
        digits("__root").alias("component_root"),
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", link: Callable[..., DataFrame] = link_documents) -> DataFrame:
    """One row of each component, that with the smallest key (nulls last; of repeated rows any one). ``link`` adds
    the components, as component_root.

    Only keys and hashes take part in the choice. Rows with one key are told apart by two hashes of their texts. Of the
    documents themselves only those move that may go, to meet the chosen keys.
    """
    source = F.col(quoted(text))
    hashes = {f"__h{i}": F.xxhash64(F.lit(i), source) for i in (1, 2)}
    chosen_by = [F.col(quoted(key)).isNull().alias("none"), F.col(quoted(key)).alias("k"), F.col("__h1").alias("h1"), F.col("__h2").alias("h2")]
    linked = link(docs.select(quoted(key), quoted(text)).withColumns(hashes), key, text)
    # rows of one key and text are one candidate; their number tells whether any are repeated
    rows = landed(linked.groupBy("component_root", F.struct(*chosen_by).alias("row")).agg(F.count(F.lit(1)).alias("copies")))
    first = landed(rows.groupBy("component_root").agg(F.min_by("copies", "row").alias("copies"), F.min("row").alias("row")))
    chosen = first.select(*[F.col("row")[n].alias(f"__{n}") for n in ("none", "k", "h1", "h2")])
    stays = first.select(F.col("component_root").alias("r"), F.col("row").alias("first"))
    other = rows.join(stays, F.col("component_root").eqNullSafe(F.col("r"))).where(~F.col("row").eqNullSafe(F.col("first")) | (F.col("copies") > 1))
    parted = may_be_among(other.select(F.xxhash64("row.k", "row.h1").alias("name")), "name")
    may_go, stay = parted(docs, F.xxhash64(quoted(key), hashes["__h1"]))
    same = (
        (F.col("__own1") == F.col("__h1")) & (F.col("__own2") == F.col("__h2")) & F.col(quoted(key)).eqNullSafe(F.col("__k"))
    )
    marked = may_go.withColumns({"__own1": hashes["__h1"], "__own2": hashes["__h2"]})
    kept = marked.join(chosen, same, "left_semi")
    if first.where(F.col("copies") > 1).limit(1).count():
        alike = W.partitionBy(quoted(key), "__own1", "__own2").orderBy("__own1")
        kept = kept.withColumn("__place", F.row_number().over(alike)).where(F.col("__place") == 1)
    return stay.union(kept.select(*[quoted(c) for c in docs.columns]))
