"""Documents to a training mixture: five stages, each of them written and read again by the next one."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusbrief.llm import contamination, language, mixing, neardup, passages, queries, similar
from corpusbrief.llm.texts import quoted, table
from corpusbrief.session import arrow_batches, landed


def set_aside(docs: DataFrame, made: Iterable[str]) -> tuple[DataFrame, dict[str, str]]:
    """Columns of the documents that have a name an operator gives or may use, renamed for the while, and how to name
    them back. Spark takes names that differ in case for one, so case does not count."""
    taken = {m.lower() for m in made}
    names = {c: f"__own_{i}" for i, c in enumerate(docs.columns) if c.lower() in taken or c.startswith("_")}
    return docs.withColumnsRenamed(names), {own: c for c, own in names.items()}


def own_columns(df: DataFrame, docs: DataFrame, back: dict[str, str], changed: dict[str, Column] | None = None) -> DataFrame:
    """The columns of the documents as they came, but for the changed ones."""
    aside = {c: own for own, c in back.items()}
    return df.select(*[(changed or {}).get(c, F.col(quoted(aside.get(c, c)))).alias(c) for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is determined: a text with a letter, ahead in one language by a margin.

    Null and empty texts go, very long ones are judged whole, ties are no margin, repeated rows are judged alike. An
    empty table stays empty. Columns with names of the operator's own come back as they were.
    """
    plain, back = set_aside(docs, language.FIELDS)
    judged = language.identify(plain, queries.fitted_languages(docs))
    return own_columns(judged.where(~F.col("rejected")), docs, back)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate component, that with the smallest id: five-word shingles, similar by 0.8.

    Texts without words, null ones among them, are alike and keep one row; a null id comes last; of repeated rows
    one stays. Very long texts are compared whole. An empty table stays empty. Columns with names of the
    operator's own come back as they were.
    """
    plain, back = set_aside(docs, [*neardup.COLUMNS, *similar.COLUMNS])
    return own_columns(neardup.keep_one(plain, link=similar.link_similar), docs, back)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove passages of over 50 words that occur again, everywhere; a document of which no word is left goes.

    Null and empty texts lose nothing and stay. Very long texts are taken whole; repeated rows are repeats and lose
    all they have in common. An empty table stays empty. Columns with names of the operator's own come back as they
    were; text and n_chars follow what was cut.
    """
    plain, back = set_aside(docs, passages.COLUMNS)
    with arrow_batches(spark, similar.BATCH):
        cut = passages.remove_passages(plain)
    whole = F.col("n_removed_words") == 0
    left = cut.where(whole | F.col("kept").rlike(r"[^\x20\x09-\x0D]"))
    changed = {
        "text": F.when(whole, F.col("text")).otherwise(F.col("kept")),
        "n_chars": F.when(whole, F.col("n_chars")).otherwise(F.length("kept").cast("long")),
    }
    return own_columns(left, docs, back, changed)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a passage of the benchmark.

    Null and empty texts hold none and stay; very long ones are searched whole; repeated rows are judged alike.
    An empty table, or benchmark, changes nothing. Columns with names of the operator's own come back as they were.
    """
    plain, back = set_aside(docs, contamination.COLUMNS)
    found = contamination.find_contamination(plain, table(spark, sf_dir, "benchmark"))
    return own_columns(found.where(~F.col("contaminated")), docs, back)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: documents taken once or more, with their columns as they came and size, source_size, target, copies
    and taken. Where the documents have a column of such a name, the mixture's has ``mix_`` in front.

    Documents without words, null texts among them, have the size 0 and are not taken. Very long texts count whole.
    Ties follow the operator's row numbers; repeated rows are drawn each. An empty table gives an empty mixture.
    """
    own = {c.lower() for c in docs.columns}
    names = {c: f"mix_{c}" if c in own else c for c in ["size", *mixing.COLUMNS]}
    plain, back = set_aside(docs, [*names, "preference"])
    sized = plain.withColumn("size", mixing.word_count(F.col("text"))).withColumn("preference", mixing.brevity(F.col("size")))
    mixed = mixing.mix(sized, preference="preference").where(F.col("copies") > 0)
    aside = {c: own for own, c in back.items()}
    return mixed.select(
        *[F.col(quoted(aside.get(c, c))).alias(c) for c in docs.columns], *[F.col(c).alias(n) for c, n in names.items()]
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
]

#: SQL has no compression, no SimHash and no random ranks of this kind; the tests use a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = landed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
