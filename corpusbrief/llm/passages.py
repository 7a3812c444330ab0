"""Removal of repeated passages counted in words, by the passes of the suffix-array dedup.

Each word is written as eight characters of its hash, so that a passage of so many words is a string of eight times as
many bytes, however short or long its words are and whatever lies between them. Repeated strings of that length
are the repeated passages; their places lead back to the words of the text.
"""

from __future__ import annotations

import base64
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import landed, release_shuffles
from . import substrings
from .texts import may_be_among, pieces, table_operator, with_text_columns, words

#: Passages of over 50 words.
WORDS = 51
#: Words of an anchor; at most WORDS.
ANCHOR_WORDS = 25
CODE = 8
COLUMNS = ["n_removed_words", "n_passages", "kept"]
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_KNOWN = 1 << 20


class _Codes(dict):
    """Eight characters for each word, from 48 bits of its hash."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) > _KNOWN:
            self.clear()
        code = self[word] = base64.b64encode(xxhash.xxh3_64_digest(word)[:6])
        return code


def cut_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the stretches from the first to the last word of each span [a, b) of word numbers."""
    bounds = [m.span() for m in _WORD.finditer(text)]
    edges = [0]
    for a, b in spans:
        edges += [bounds[a][0], bounds[b - 1][1]]
    edges.append(len(text))
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


@table_operator(COLUMNS)
def remove_passages(docs: DataFrame, text: str = "text", n_words: int = WORDS, anchor: int = ANCHOR_WORDS) -> DataFrame:
    """Add n_removed_words, n_passages and kept: every word goes that a passage of ``n_words`` words covers which also
    starts elsewhere, in the same or another document; all its occurrences go, and the blanks inside them.

    Null and empty texts have no words and lose nothing (kept is as the text). Texts of any length are taken whole.
    Repeated rows are repeats. Columns with the new names, in whatever case, are replaced, all others stay; an
    empty table stays empty. Only names and places move, and those texts that may lose something.
    """
    codes = _Codes()
    kept = docs.columns
    # names that the passes give or use are out of the way
    hidden = {c: f"__doc{i}" for i, c in enumerate(kept)}
    body = hidden[text]
    docs = docs.withColumnsRenamed(hidden)
    names = {"__t1": F.xxhash64(body), "__t2": F.xxhash64(F.lit(1), body)}
    coded = with_text_columns(
        docs.select(body).withColumns(names), body, {"__code": "string"}, lambda t: (b"".join(map(codes.__getitem__, words(t))).decode(),)
    )
    found = substrings.remove_repeats(coded, "__code", n_words * CODE, anchor * CODE, keep_spans=True).where("removed is not null")
    found = landed(found.select(F.col("__t1").alias("t1"), F.col("__t2").alias("t2"), "removed").dropDuplicates(["t1", "t2"]))
    release_shuffles(docs.sparkSession)

    def run(texts: pa.Array, ranges: pa.Array) -> pa.Array:
        made = []
        for part in pieces([texts, ranges]):
            rows = []
            for value, spans in zip(*part):
                if value is None or not spans:
                    rows.append({"left": None, "words": 0, "passages": 0})
                    continue
                # whole words only
                cuts = [(-(-s["a"] // CODE), s["b"] // CODE) for s in spans]
                cuts = [(a, b) for a, b in cuts if a < b]
                left = cut_words(value, cuts).decode("utf-8", "replace")
                rows.append({"left": left, "words": sum(b - a for a, b in cuts), "passages": len(cuts)})
            made.append(pa.array(rows, kind))
        return pa.concat_arrays(made) if made else pa.array([], kind)

    kind = pa.struct([("left", pa.string()), ("words", pa.int64()), ("passages", pa.int64())])
    udf = F.arrow_udf(run, "struct<left:string,words:long,passages:long>").asNondeterministic()
    may_lose, whole = may_be_among(found, "t1")(docs, names["__t1"])
    named = may_lose.withColumns(names)
    joined = named.join(found, (F.col("__t1") == F.col("t1")) & (F.col("__t2") == F.col("t2")), "left")
    changed = F.when(F.col("removed").isNotNull(), F.col(body)).cast("binary")
    done = joined.withColumn("__cut", udf(changed, F.col("removed")))
    own = [F.col(own).alias(c) for c, own in hidden.items()]
    none = F.lit(0).cast("long")
    return done.select(
        *own, F.col("__cut.words").alias("n_removed_words"), F.col("__cut.passages").alias("n_passages"), F.coalesce("__cut.left", body).alias("kept"),
    ).union(whole.select(*own, none.alias("n_removed_words"), none.alias("n_passages"), F.col(body).alias("kept")))
