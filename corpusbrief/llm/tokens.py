"""Token counts through a digest cache: a text is encoded once for each tokenizer, whatever runs and copies it is in.

The cache is a table of (version, digest, n_tokens) in a folder, partitioned by version. Texts are known by
the SHA-256 of their normalised content, tokenizers by the SHA-256 of their file, library and settings. A run
digests all texts, anti-joins the distinct digests with the cache, encodes one text for each digest that is missing,
appends the counts and joins them back. Counts that were stored by another run are taken as they are.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from importlib import metadata

import public_tokenizers
import pyarrow as pa
import sentencepiece
import tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, landed, shared_path, ship_package
from .texts import pieces, quoted, table_operator

TOKENIZER = "piece_bpe_32k.model"
LIMIT = 4096
#: Proven bound of what goes to every task: the tokenizer's file.
MAX_TOKENIZER_BYTES = 64 << 20

_CACHE = "version string, digest string, n_tokens long"
_DIGEST, _SIZE = "__content_digest", "__content_bytes"
COLUMNS = ("n_bytes", "n_tokens", "over_limit")


@dataclass(frozen=True)
class TokenizerFile:
    """A tokenizer's file as read on the driver, so that tasks need no such file; settings are part of the version."""

    kind: str
    content: bytes

    @property
    def version(self) -> str:
        library = "sentencepiece" if self.kind == "model" else "tokenizers"
        # no begin, end or added special tokens, no truncation, no padding
        settings = {"library": library, "release": metadata.version(library), "special": False, "cut": False, "pad": False}
        head = json.dumps(settings, sort_keys=True).encode()
        return hashlib.sha256(head + b"\n" + self.content).hexdigest()

    def counter(self):
        """A function from texts to their numbers of tokens."""
        if self.kind == "model":
            model = sentencepiece.SentencePieceProcessor(model_proto=self.content)
            return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
        loaded = tokenizers.Tokenizer.from_str(self.content.decode())
        loaded.no_truncation()
        loaded.no_padding()
        return lambda texts: [len(e) for e in loaded.encode_batch_fast(texts, add_special_tokens=False)]


def read_tokenizer(path: str) -> TokenizerFile:
    if os.path.getsize(path) > MAX_TOKENIZER_BYTES:
        raise ValueError(f"{path} is larger than {MAX_TOKENIZER_BYTES} bytes")
    with open(path, "rb") as stream:
        return TokenizerFile(os.path.splitext(path)[1].removeprefix("."), stream.read())


def normalised(text: Column) -> Column:
    """What is digested and encoded: the text as it is, null as empty. Anything more would change counts."""
    return F.coalesce(text.cast("string"), F.lit(""))


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(digest, n_tokens) of a tokenizer version; two runs that stored the same text give one row."""
    try:
        stored = spark.read.schema(_CACHE).parquet(cache)
    except AnalysisException:  # nothing stored yet
        stored = spark.createDataFrame([], _CACHE)
    return stored.where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _first_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Only the first text of each digest in a task, so that a hot text reaches the shuffle once a task.

    The digests seen so far take some hundred bytes each, for the rows of one task.
    """
    seen: set[str] = set()
    for batch in batches:
        fresh = []
        for digest in batch.column(0).to_pylist():
            fresh.append(digest not in seen)
            seen.add(digest)
        yield batch.filter(pa.array(fresh))


def _encoded(missing: DataFrame, tokenizer: TokenizerFile, version: str) -> DataFrame:
    shared = missing.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value.counter()
        for batch in batches:
            found = []
            for digests, texts in pieces([batch.column(0), batch.column(1)], 64):
                found += zip(digests, counts([t.decode("utf-8", "replace") for t in texts]), strict=True)
            digests, sizes = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array([version] * len(digests), pa.string()), pa.array(digests, pa.string()), pa.array(sizes, pa.int64())],
                ["version", "digest", "n_tokens"],
            )

    return missing.mapInArrow(run, _CACHE)


@table_operator(COLUMNS)
def count_tokens(docs: DataFrame, tokenizer: str | None = None, cache: str | None = None, text: str = "text",
                 limit: int = LIMIT) -> DataFrame:
    """Add n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens) to ``docs``.

    ``tokenizer`` is the path of a .model (sentencepiece) or .json (tokenizers) file, by default that of
    ``piece_bpe_32k.model``; ``cache`` the cache's folder, by default a new one in the shared folder. Texts are
    encoded whole, without begin, end or added special tokens; strings of special tokens inside texts are what the
    library takes them for. Appending is one job whose files appear when it ends; a job that is lost leaves nothing,
    and one that is repeated stores equal rows, which readers take once.

    Null texts count as empty: no bytes, no tokens. Texts of any length are encoded whole. Repeated rows and equal
    texts are encoded once and get the same count; an empty table gives an empty result. Columns of ``docs`` that
    have one of the new names, in whatever case, are replaced, all others stay.
    """
    spark = docs.sparkSession
    ship_package(spark)
    loaded = read_tokenizer(tokenizer or public_tokenizers.path(TOKENIZER))
    version = loaded.version
    cache = cache or shared_path(spark, "token-cache")
    content = normalised(F.col(text))
    kept = [F.col(quoted(c)) for c in docs.columns]

    digested = docs.select(F.sha2(content, 256).alias("digest"), content.cast("binary").alias("content"))
    stored = read_cache(spark, cache, version)
    missing = landed(docs.select(F.sha2(content, 256).alias("digest")).distinct().join(stored, "digest", "left_anti"))
    once = digested.mapInArrow(_first_of_task, "digest string, content binary")
    texts = once.join(missing, "digest", "left_semi").dropDuplicates(["digest"])
    _encoded(texts, loaded, version).write.mode("append").partitionBy("version").parquet(cache)

    counts = read_cache(spark, cache, version).withColumnsRenamed({"digest": _DIGEST, "n_tokens": "__tokens"})
    keyed = docs.select(*kept, F.sha2(content, 256).alias(_DIGEST), F.octet_length(content).cast("long").alias(_SIZE))
    joined = keyed.join(counts, _DIGEST)
    return joined.select(
        *[F.col(quoted(c)) for c in keyed.columns if c not in (_DIGEST, _SIZE)],
        F.col(_SIZE).alias("n_bytes"), F.col("__tokens").alias("n_tokens"), (F.col("__tokens") > limit).alias("over_limit"),
    )


def forget(spark: SparkSession, cache: str) -> None:
    """Delete a cache."""
    discard(spark, cache)
