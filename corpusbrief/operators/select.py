"""File selection: filters, classes, audit, walk order and the per-repository source cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, rules, text
from ..session import landed
from .numbering import numbered, sums_before
from .skew import first_per_group

EMITTED = ("important", "source")


def with_path_parts(files: DataFrame) -> DataFrame:
    """Adds name, ext, category and file_class, all from the path alone."""
    name = paths.file_name("path")
    return (
        files.withColumn("name", name)
        .withColumn("ext", paths.extension("path"))
        .withColumn("category", paths.important_category("name"))
        .withColumn("file_class", paths.file_class("name", "ext"))
    )


def _is_bytes(files: DataFrame) -> bool:
    return files.schema["content"].dataType.simpleString() == "binary"


def sniff_source(files: DataFrame) -> Column:
    """What to sniff: the separately read head where the source gives one, else the content's start."""
    if "head" in files.columns:
        return F.col("head")
    return F.col("content") if _is_bytes(files) else F.left("content", F.lit(rules.SNIFF_BYTES))


def with_text(files: DataFrame) -> DataFrame:
    """Adds text: binary content is decoded, string content is taken as decoded already."""
    return files.withColumn("text", text.decode_text("content") if _is_bytes(files) else F.col("content"))


def has_text(files: DataFrame) -> Column:
    filled = text.decodes_to_text("content") if _is_bytes(files) else F.col("content") != ""
    return F.coalesce(filled, F.lit(False))


def looks_binary(files: DataFrame, marker: bytes = b"\0") -> Column:
    """Binary sniff, only for extensions that are not known text."""
    return ~paths.is_known_text("ext") & F.coalesce(text.is_binary(sniff_source(files), marker), F.lit(False))


def select_files(files: DataFrame, marker: bytes = b"\0", emitted_only: bool = False) -> DataFrame:
    """Files that pass every gate, with their class and text.

    Path and size tests come first and need no content; ``emitted_only`` also drops the files that
    would be read and then left out of any bundle. (repo_id, path) is taken to be unique.
    """
    kept = with_path_parts(files).where(
        paths.keep_dir("path") & paths.keep_name("name") & paths.keep_ext("ext") & paths.size_ok("size")
    )
    if emitted_only:
        kept = kept.where(paths.is_important("name") | paths.is_code("ext"))
    if "read_error" in files.columns:
        kept = kept.where(F.col("read_error").isNull())
    kept = with_text(kept.where(~looks_binary(files, marker) & has_text(files)))
    return kept.select("repo_id", "path", "name", "ext", "category", "file_class", "size", "text")


def reject_reason(files: DataFrame, marker: bytes = b"\0") -> Column:
    """First gate a file fails, 'kept' if none; expects the columns of with_path_parts."""
    reason = (
        F.when(~paths.keep_dir("path"), F.lit("directory"))
        .when(~paths.keep_name("name"), F.lit("name"))
        .when(~paths.keep_ext("ext"), F.lit("extension"))
        .when(looks_binary(files, marker), F.lit("binary"))
        .when(F.col("size") > rules.MAX_FILE_BYTES, F.lit("too_large"))
        .when(F.col("size") < rules.MIN_FILE_BYTES, F.lit("too_small"))
    )
    if "read_error" in files.columns:
        reason = reason.when(F.col("read_error").isNotNull(), F.lit("unreadable"))
    return reason.when(~has_text(files), F.lit("empty")).otherwise(F.lit("kept"))


def selection_audit(files: DataFrame, marker: bytes = b"\0") -> DataFrame:
    """Files per repository and reject reason."""
    marked = with_path_parts(files).withColumn("reason", reject_reason(files, marker))
    return marked.groupBy("repo_id", "reason").agg(F.count(F.lit(1)).alias("n"))


def category_counts(selected: DataFrame) -> DataFrame:
    """Important files per repository and category."""
    return (
        selected.where(F.col("category").isNotNull())
        .groupBy("repo_id", "category").agg(F.count(F.lit(1)).alias("n"))
    )


def walk_positions(files: DataFrame) -> DataFrame:
    """Position of each file in its repository's walk order."""
    keyed = files.select("repo_id", "path", paths.walk_key("path").alias("_walk"))
    return numbered(keyed, ["_walk"], "position", within="repo_id").drop("_walk")


def cap_sources(selected: DataFrame, cap: int = rules.SOURCE_CAP, hot: DataFrame | None = None) -> DataFrame:
    """All important files and the first ``cap`` source files of each repository in walk order.

    Each important file is a sub-group of its own, so the rank filter only ever cuts sources and
    both classes go through one scan and one shuffle.
    """
    emitted = selected.where(F.col("file_class").isin(*EMITTED))
    lane = F.when(F.col("file_class") == "source", F.lit("")).otherwise(F.col("path"))
    capped = first_per_group(
        emitted.withColumn("_lane", lane), "repo_id", [paths.walk_key("path")], cap,
        spread_by=F.col("path"), hot=hot, within="_lane",
    )
    return capped.drop("_lane")


def capped_places(selected: DataFrame, cap: int = rules.SOURCE_CAP) -> DataFrame:
    """The files :func:`cap_sources` keeps, without their texts: (repo_id, path, file_class, chars, start).

    ``chars`` is the length of a file's segment and ``start`` the segments' length before it, important files
    first and each class in walk order. Texts are measured where they are read; only names and numbers
    are sorted and moved. Files past the cap come after all others, so they don't shift any start.
    """
    emitted = selected.where(F.col("file_class").isin(*EMITTED))
    measured = emitted.select(
        "repo_id", "path", "file_class", text.segment_chars("path", "text").alias("chars"),
        (F.col("file_class") == "source").cast("long").alias("_source"),
    )
    placed = sums_before(measured, "repo_id", ["_source", paths.walk_key("path")], {"start": "chars", "_earlier": "_source"})
    kept = placed.where((F.col("_source") == 0) | (F.col("_earlier") < cap))
    return landed(kept.drop("_source", "_earlier"))


def texts_at(files: DataFrame, places: DataFrame) -> DataFrame:
    """Rows of ``places(repo_id, path, ...)`` with the text of their file.

    ``files`` is read once more, without what its path or size rules out. (repo_id, path) is unique, so no task
    gets a large repository whole; the places, which hold no text, are the side that is hashed, and nothing is sorted.
    """
    parts = with_path_parts(files).where(
        paths.size_ok("size") & paths.keep_dir("path") & (paths.is_important("name") | paths.is_code("ext"))
    ).select("repo_id", "path", "content")
    spots = places.withColumnsRenamed({"repo_id": "_repo", "path": "_path"}).hint("shuffle_hash")
    same = F.col("repo_id").eqNullSafe(F.col("_repo")) & (F.col("path") == F.col("_path"))
    found = parts.join(spots, same).drop("_repo", "_path")
    return with_text(found).drop("content")


def parse_counts(capped: DataFrame) -> DataFrame:
    """Important, source and total files taken from each repository."""
    return capped.groupBy("repo_id").agg(
        F.count_if(F.col("file_class") == "important").alias("important"),
        F.count_if(F.col("file_class") == "source").alias("source"),
        F.count(F.lit(1)).alias("processed"),
    )
