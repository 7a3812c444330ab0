"""Byte-level words and column helpers shared by the operators of this package."""

from __future__ import annotations

import functools
import inspect
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import landed, ship_package

_UPPER = bytes(range(0x41, 0x5B))
LOWER = bytes.maketrans(_UPPER, _UPPER.lower())
#: After lower-casing, letters, digits and all bytes from 0x80 stay; every other byte parts two terms.
TERMS = bytes(
    LOWER[b] if LOWER[b] >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= LOWER[b] <= 0x7A else 0x20 for b in range(256)
)
_KINDS = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
_RESULT = "__result"
#: Places in the table of ``may_be_among`` for each hash, and the power of two of places it has at most (4 MB).
PLACES = 32
MOST_PLACES = 25


def terms(text: bytes | None) -> list[bytes]:
    """Lower-cased words of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``."""
    return text.translate(TERMS).split() if text else []


def words(text: bytes | None) -> list[bytes]:
    """Words of ``[^\\x20\\x09-\\x0D]+``."""
    return text.split() if text else []


def arrow_type(kind: str) -> pa.DataType:
    return pa.list_(arrow_type(kind[6:-1])) if kind.startswith("array<") else _KINDS[kind]


def struct_of(rows: list[tuple], fields: dict[str, str]) -> pa.StructArray:
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    arrays = [pa.array(list(c), arrow_type(k)) for c, k in zip(columns, fields.values(), strict=True)]
    return pa.StructArray.from_arrays(arrays, names=list(fields))


def pieces(columns: list[pa.Array], rows: int = 256) -> Iterator[list[list]]:
    """Python values of an Arrow batch's columns, few rows at a time: a batch of long texts is held once, as Arrow."""
    for start in range(0, len(columns[0]), rows):
        yield [c.slice(start, rows).to_pylist() for c in columns]


def with_text_columns(
    df: DataFrame, text: str | Column, fields: dict[str, str], each: Callable[[bytes | None], tuple]
) -> DataFrame:
    """Add the columns that ``each`` makes of a whole text's UTF-8 bytes (None for null).

    Only the text goes to Python, in Arrow batches; the other columns stay in the JVM. Input columns
    that have one of the new names are replaced.
    """
    ship_package(df.sparkSession)

    def run(texts: pa.Array) -> pa.Array:
        made = [struct_of([each(t) for t in part], fields) for (part,) in pieces([texts])]
        return pa.concat_arrays(made) if made else struct_of([], fields)

    kept = [c for c in df.columns if c not in fields]
    udf = F.arrow_udf(run, "struct<" + ",".join(f"{n}:{k}" for n, k in fields.items()) + ">").asNondeterministic()
    source = F.col(text) if isinstance(text, str) else text
    made = df.withColumn(_RESULT, udf(source.cast("binary")))
    return made.select(*[F.col(quoted(c)) for c in kept], *[F.col(_RESULT)[n].alias(n) for n in fields])


def table_operator(made: Iterable[str]) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """For operators that add columns to their first argument: its own columns get through, whatever their names.

    Spark takes names that differ in case for one, so columns that have a ``made`` name in whatever case are replaced,
    unless they are named as inputs. Names with two underscores in front, as operators use for their own helpers, are
    out of the way while the operator runs, and back afterwards.
    """
    new = {m.lower() for m in made}

    def wrap(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        signature = inspect.signature(operator)

        @functools.wraps(operator)
        def run(docs: DataFrame, *args, **options) -> DataFrame:
            bound = signature.bind(docs, *args, **options)
            bound.apply_defaults()
            inputs = {v for v in bound.arguments.values() if isinstance(v, str)}
            kept = [c for c in docs.columns if c in inputs or c.lower() not in new]
            if len(kept) < len(docs.columns):
                docs = docs.select(*[quoted(c) for c in kept])
            hidden = {c: f"own{i}{c.strip('_')}" for i, c in enumerate(kept) if c.startswith("__") and c not in inputs}
            if not hidden:
                return operator(docs, *args, **options)
            done = operator(docs.withColumnsRenamed(hidden), *args, **options)
            return done.withColumnsRenamed({h: c for c, h in hidden.items()})

        return run

    return wrap


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def fraction(*keys: Column) -> Column:
    """A number from 0 to under 1 that depends on the keys alone (null keys count as empty)."""
    hashed = F.xxhash64(*[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return F.shiftrightunsigned(hashed, 11) / F.lit(float(1 << 53))


def remainder(key: Column, modulo: int) -> Column:
    """crc32 of a key's text modulo ``modulo``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % F.lit(modulo)


def may_be_among(hashes: DataFrame, name: str) -> Callable[[DataFrame, Column], tuple[DataFrame, DataFrame]]:
    """A parting of rows by a hash: those whose hash may be in the column ``name`` of ``hashes``, and others, whose hash is not
    there; so rows that a join would not change need not move to it. The table of bits has at most 2 ** MOST_PLACES places,
    however many hashes there are, and is sent to all tasks."""
    bits = min(max((PLACES * hashes.count()).bit_length(), 10), MOST_PLACES)
    mask = F.lit((1 << bits) - 1)
    placed = hashes.select(F.col(name).bitwiseAND(mask).alias("place"))
    bit = F.expr("shiftleft(1L, cast(place & 63 as int))")
    words = landed(placed.groupBy(F.shiftright("place", 6).alias("__may_word")).agg(F.bit_or(bit).alias("__may_bits")))

    def part(rows: DataFrame, asked: Column) -> tuple[DataFrame, DataFrame]:
        marked = rows.withColumn("__may_place", asked.bitwiseAND(mask))
        marked = marked.join(F.broadcast(words), F.shiftright("__may_place", 6) == F.col("__may_word"), "left")
        may = F.expr("coalesce(shiftrightunsigned(__may_bits, cast(__may_place & 63 as int)) & 1, 0) = 1")
        own = [F.col(quoted(c)) for c in rows.columns]
        return marked.where(may).select(*own), marked.where(~may).select(*own)

    return part


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
