"""Merkle manifest of a dataset: a postorder append log of digests, with an inclusion proof for every row.

Rows are leaves, in key order within their tree (their source); runs of 16 nodes become one node until one
is left, and the trees' last nodes, in source order, are the leaves of one more tree, whose last node is the root.

The log is written by *aligned builders*: each takes the 256 nodes whose numbers share everything above the last
two digits to the base 16, and appends each node as soon as its children are there, which is postorder. A builder
knows from its own nodes alone how high its tree grows: only the first one of a tree can be short and the only one.
The builders' last nodes are the leaves of the next round, so a tree of n rows takes log_256(n) rounds.

Because full subtrees have a known size, the place of any node in a builder's part of the log is a sum over the
digits of its number. Proofs address siblings by that place, top round first: a part of the log and the proof
of its last node are one row each, joined one to one, and give the proofs of the part's own leaves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from ..session import landed, ship_package
from .texts import remainder

ARITY = 16
#: Levels that one builder adds.
LEVELS = 2
BLOCK = ARITY**LEVELS
WIDTH = 64  # characters of a digest
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_PATH = "array<struct<place:int,siblings:string>>"
_PART = "tree string, number long, n int, nodes string, top string"


def digest(parts: bytes) -> str:
    return hashlib.sha256(parts).hexdigest()


def full_size(level: int) -> int:
    """Nodes of a subtree with all its ARITY ** level leaves."""
    return (ARITY ** (level + 1) - 1) // (ARITY - 1)


def subtree_size(leaves: int, level: int) -> int:
    """Nodes of a subtree of ``level`` levels above ``leaves`` leaves, of which the last run may be short."""
    return sum(-(-leaves // ARITY**m) for m in range(level + 1))


def position(leaves: int, level: int, index: int) -> int:
    """Place in the postorder log, from 0, of node ``index`` of ``level`` in a tree of ``leaves`` leaves."""
    first = index * ARITY**level
    own = subtree_size(min(ARITY**level, leaves - first), level)
    before, above = 0, level
    while index:
        index, digit = divmod(index, ARITY)
        before += digit * full_size(above)
        above += 1
    return before + own - 1


def height(leaves: int) -> int:
    """Levels above the leaves until one node is left."""
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // ARITY), levels + 1
    return levels


def append(leaves: list[str], levels: int) -> list[str]:
    """The log of a builder: each node follows the last of its children."""
    log: list[str] = []
    open_runs: list[list[str]] = [[] for _ in range(levels)]

    def add(level: int, node: str) -> None:
        log.append(node)
        if level < levels:
            open_runs[level].append(node)
            if len(open_runs[level]) == ARITY:
                close(level)

    def close(level: int) -> None:
        node = digest("".join(open_runs[level]).encode())
        open_runs[level].clear()
        add(level + 1, node)

    for leaf in leaves:
        add(0, leaf)
    for level in range(levels):
        if open_runs[level]:
            close(level)
    return log


def builder_levels(number: int, leaves: int) -> int:
    """Levels of builder ``number``: all of them unless it is the only one of its tree."""
    return LEVELS if number else min(LEVELS, height(leaves))


def siblings(nodes: str, leaves: int, levels: int, leaf: int) -> list[tuple[int, str]]:
    """Bottom up: the place of the leaf's ancestor in its run, and the digests of the others of the run."""
    found = []
    for level in range(levels):
        count = -(-leaves // ARITY**level)
        index = leaf // ARITY**level
        start = index - index % ARITY
        others = [position(leaves, level, k) for k in range(start, min(start + ARITY, count)) if k != index]
        found.append((index - start, "".join(nodes[p * WIDTH : (p + 1) * WIDTH] for p in others)))
    return found


def fold(node: str, path: list[tuple[int, str]]) -> str:
    """The root that a leaf and its proof give."""
    for place, others in path:
        at = place * WIDTH
        node = digest(f"{others[:at]}{node}{others[at:]}".encode())
    return node


def framed(value: Column) -> Column:
    """A value with its UTF-8 byte count in front, or ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(framed, values)), 256)


@dataclass(frozen=True)
class Manifest:
    """``rows`` has the builders' parts of the log over the rows, a round each, ``sources`` those over the trees'
    last nodes; ``subroots(tree, subroot, position)`` ties them together."""

    rows: list[DataFrame]
    sources: list[DataFrame]
    subroots: DataFrame
    key: str


def _build(table: pa.Table, extra: list[str]) -> pa.Table:
    """One builder: its nodes in, its part of the log out, with what belongs to its leaves as lists."""
    table = table.sort_by("position")
    leaves = table.column("node").to_pylist()
    number = table.column("number")[0].as_py()
    nodes = append(leaves, builder_levels(number, len(leaves)))
    made = {
        "tree": table.column("tree").slice(0, 1), "number": pa.array([number], pa.int64()), "n": pa.array([len(leaves)], pa.int32()),
        "nodes": pa.array(["".join(nodes)]), "top": pa.array(nodes[-1:]),
    }
    for name in extra:
        values = table.column(name).combine_chunks()
        made[name] = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    return pa.table(made)


def _rounds(nodes: DataFrame, extra: list[str]) -> list[DataFrame]:
    """Rounds of builders over ``nodes(tree, position, node, *extra)`` until each tree is down to one node."""
    rounds = []
    while True:
        kinds = dict(nodes.dtypes)
        schema = _PART + "".join(f", {c} array<{kinds[c]}>" for c in extra)
        grouped = nodes.withColumn("number", F.floor(F.col("position") / BLOCK)).groupBy("tree", "number")
        # ``extra`` is bound now: it changes with the round
        rounds.append(landed(grouped.applyInArrow(_builder(extra), schema)))
        if not rounds[-1].where("number > 0").limit(1).count():
            return rounds
        nodes, extra = rounds[-1].select("tree", F.col("number").alias("position"), F.col("top").alias("node")), []


def _builder(extra: list[str]) -> Callable[[pa.Table], pa.Table]:
    return lambda table: _build(table, extra)


def write_log(docs: DataFrame, presented: dict[str, Column] | None = None, key: str = "doc_id", tree: str = "source",
              fields: tuple[str, ...] = FIELDS) -> Manifest:
    """Build the log of ``docs``: a leaf for each row from ``fields``, a tree for each ``tree`` value.

    Leaves ascend by ``key`` (null first), then by digest, so rows with one key have a place too; repeated rows are
    leaves of their own. ``presented`` names columns whose values are to be checked against the log in place
    of those it is built from; by default the same. Only digests and keys are kept, never texts.
    """
    ship_package(docs.sparkSession)
    shown = [(presented or {}).get(f) for f in fields]
    claim = F.lit(None).cast("string")
    if any(c is not None for c in shown):
        claim = leaf_digest([F.col(f) if c is None else c for f, c in zip(fields, shown, strict=True)])
    made = docs.select(
        # an own letter tells a null tree from an empty name, and keeps the order: null first, then by bytes
        F.when(F.col(tree).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(tree).cast("string"))).alias("tree"),
        F.col(key).alias("key"), leaf_digest([F.col(f) for f in fields]).alias("node"), claim.alias("claim"),
    )
    placed = numbered(landed(made), ["key", "node"], "position", start=0, within="tree")
    rows = _rounds(placed, ["key", "claim"])
    last = rows[-1].select(F.col("tree").alias("of"), F.col("top").alias("node"), F.lit("").alias("tree"))
    subroots = landed(numbered(last, ["of"], "position", start=0))
    sources = _rounds(subroots.drop("of"), [])
    return Manifest(rows, sources, subroots.select(F.col("of").alias("tree"), F.col("node").alias("subroot"), "position"), key)


def _down(parts: DataFrame, above: DataFrame) -> DataFrame:
    """Proofs of a round's leaves from those of its builders' last nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                levels = builder_levels(r["number"], r["n"])
                upper = [(s["place"], s["siblings"]) for s in r["path"]]
                paths = [siblings(r["nodes"], r["n"], levels, leaf) + upper for leaf in range(r["n"])]
                yield pa.RecordBatch.from_pydict({
                    "tree": pa.array([r["tree"]] * r["n"], pa.string()),
                    "number": pa.array(range(r["number"] * BLOCK, r["number"] * BLOCK + r["n"]), pa.int64()),
                    "path": pa.array(
                        [[{"place": p, "siblings": s} for p, s in path] for path in paths],
                        pa.list_(pa.struct([("place", pa.int32()), ("siblings", pa.string())])),
                    ),
                    "subroot": pa.array([r["subroot"]] * r["n"], pa.string()),
                    "root": pa.array([r["root"]] * r["n"], pa.string()),
                })

    joined = parts.select("tree", "number", "n", "nodes").join(above, ["tree", "number"])
    return landed(joined.mapInArrow(run, f"tree string, number long, path {_PATH}, subroot string, root string"))


def paths_to_root(manifest: Manifest) -> DataFrame:
    """Proofs of the last nodes of the builders over the rows: (tree, number, path, subroot, root)."""
    top = manifest.sources[-1]
    none = F.array().cast(_PATH)
    found = top.select("tree", "number", none.alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("top").alias("root"))
    for parts in reversed(manifest.sources):
        found = _down(parts, found)
    subroots = manifest.subroots.withColumnRenamed("position", "at")
    found = found.drop("tree", "subroot").withColumnRenamed("number", "at").join(subroots, "at")
    found = found.select("tree", F.lit(0).cast("long").alias("number"), "path", "subroot", "root")
    for parts in reversed(manifest.rows[1:]):
        found = _down(parts, found)
    return found


def prove(manifest: Manifest, with_path: bool = False) -> DataFrame:
    """A row for each leaf: key, leaf, subroot, root, proof_sha256, folded_root and verified.

    ``folded_root`` is recomputed from the presented leaf and the siblings. ``with_path`` adds the proof itself,
    ``path``: bottom up, the place in the run and the digests of the others.
    """
    kind = manifest.rows[0].schema["key"].dataType.elementType.simpleString()
    fields = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    schema = f"key {kind}, {fields}" + (f", path {_PATH}" if with_path else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.slice(i, 1)
                keys = part.column("key").flatten()
                r = part.drop_columns(["key"]).to_pylist()[0]
                levels = builder_levels(r["number"], r["n"])
                upper = [(s["place"], s["siblings"]) for s in r["path"]]
                shared = "".join(s for _, s in upper)
                rows = []
                for leaf in range(r["n"]):
                    at = position(r["n"], 0, leaf) * WIDTH
                    node = r["nodes"][at : at + WIDTH]
                    own = siblings(r["nodes"], r["n"], levels, leaf)
                    folded = fold(r["claim"][leaf] or node, own + upper)
                    proof = digest(("".join(s for _, s in own) + shared).encode())
                    rows.append((node, r["subroot"], r["root"], proof, folded, folded == r["root"], own))
                columns = list(zip(*rows, strict=True))
                arrays = [keys, *(pa.array(c, pa.string()) for c in columns[:5]), pa.array(columns[5], pa.bool_())]
                names = ["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
                if with_path:
                    whole = [[{"place": p, "siblings": s} for p, s in own + upper] for own in columns[6]]
                    arrays.append(pa.array(whole, pa.list_(pa.struct([("place", pa.int32()), ("siblings", pa.string())]))))
                    names.append("path")
                yield pa.RecordBatch.from_arrays(arrays, names)

    joined = manifest.rows[0].drop("top").join(paths_to_root(manifest), ["tree", "number"])
    return joined.mapInArrow(run, schema).withColumnRenamed("key", manifest.key)


def lower_ascii(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def verify_documents(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """Manifest of ``docs`` with every row's proof, checked against the rows as presented.

    Rows that ``tampered`` marks (by default those of which 5 divides the unsigned crc32 of the decimal
    doc_id) are presented with their text's A-Z in lower case. Nulls, in any column, have a frame of their own;
    empty texts differ from null ones. A null doc_id counts as the empty text for crc32 and sorts first. Ties of
    doc_id are placed by leaf digest; repeated rows are leaves each. Texts of any length are hashed whole. An empty
    table gives an empty result. Other columns of ``docs`` are not part of a leaf and not returned.
    """
    marked = remainder(F.col("doc_id"), 5) == 0 if tampered is None else tampered
    shown = F.when(marked, lower_ascii(F.col("text"))).otherwise(F.col("text"))
    return prove(write_log(docs, {"text": shown}))
