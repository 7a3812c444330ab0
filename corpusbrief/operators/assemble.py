"""Bounded text bundles: ordered concatenation of file segments under a character budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths, prompts, rules, text
from . import select
from .skew import SALT, add_salt

_ORDER = ["_class_rank", "_walk"]


def segments(selected: DataFrame) -> DataFrame:
    return selected.select("repo_id", "path", text.segment("path", "text").alias("segment"))


def assemble(capped: DataFrame, budget: int = rules.TEXT_BUDGET, hot: DataFrame | None = None) -> DataFrame:
    """bundles(repo_id, text, total_chars, important_chars, truncated).

    Important files come first, then sources, each in walk order. Running lengths decide which
    segments start inside the budget; only those are collected, clipped, so no group holds more
    than the budget. The totals count every segment.
    """
    chars = text.segment_chars("path", "text")
    parts = capped.select(
        "repo_id", "path",
        # no file contributes more than the budget; the byte test spares counting characters
        F.when(F.octet_length("text") > budget, F.left("text", F.lit(budget))).otherwise(F.col("text")).alias("text"),
        F.when(F.col("file_class") == "important", 0).otherwise(1).alias("_class_rank"),
        paths.walk_key("path").alias("_walk"),
        chars.alias("_chars"),
        chars.alias("_total"),
        F.when(F.col("file_class") == "important", chars).otherwise(F.lit(0)).cast("long").alias("_important"),
    )
    if hot is not None:
        parts = _thinned(add_salt(parts, "repo_id", F.col("path"), hot), ["repo_id", SALT], budget)
    start = _start(["repo_id"])
    clip = F.left(text.segment("path", "text"), F.lit(budget) - F.col("_start").cast("int"))
    collected = parts.withColumn("_start", start).groupBy("repo_id").agg(
        # nulls, the segments past the budget, are not collected
        F.collect_list(F.when(F.col("_start") < budget, F.struct("_start", clip.alias("clip")))).alias("_clips"),
        F.sum("_total").alias("total_chars"),
        F.sum("_important").alias("important_chars"),
    )
    return _joined(collected, budget)


def _joined(collected: DataFrame, budget: int) -> DataFrame:
    """Clips in their order as one text, marked where something was left out."""
    joined = F.array_join(F.transform(F.sort_array("_clips"), lambda part: part["clip"]), "")
    truncated = F.col("total_chars") > budget
    mark = F.when(truncated, F.lit(rules.TRUNCATION_MARK)).otherwise(F.lit(""))
    return collected.select(
        "repo_id", F.concat(joined, mark).alias("text"), "total_chars", "important_chars",
        truncated.alias("truncated"),
    )


def gather(files: DataFrame, places: DataFrame, budget: int = rules.TEXT_BUDGET) -> DataFrame:
    """The bundles of :func:`assemble`, from the places of :func:`capped_places` and the files they are in.

    Which segments start inside the budget is known before any text moves. Only those are fetched and clipped, so
    what comes together for a repository is the budget at most, however many files it has.
    """
    important = F.when(F.col("file_class") == "important", F.col("chars")).otherwise(F.lit(0))
    totals = places.groupBy(F.col("repo_id").alias("_of")).agg(
        F.sum("chars").alias("total_chars"), F.sum(important).cast("long").alias("important_chars")
    )
    inside = places.where(F.col("start") < budget).join(totals, F.col("repo_id").eqNullSafe(F.col("_of")))
    spots = inside.select("repo_id", "path", "start", "total_chars", "important_chars")
    clip = F.left(text.segment("path", "text"), (F.lit(budget) - F.col("start")).cast("int"))
    collected = select.texts_at(files, spots).groupBy("repo_id").agg(
        F.collect_list(F.struct("start", clip.alias("clip"))).alias("_clips"),
        F.first("total_chars").alias("total_chars"), F.first("important_chars").alias("important_chars"),
    )
    return _joined(collected, budget)


def _start(keys: list[str]) -> Column:
    """Characters before each segment within its group."""
    running = W.partitionBy(*keys).orderBy(*_ORDER).rowsBetween(W.unboundedPreceding, W.currentRow)
    return F.sum("_chars").over(running) - F.col("_chars")


def _thinned(parts: DataFrame, keys: list[str], budget: int) -> DataFrame:
    """Sub-groups without the segments that start past the budget.

    The start in a sub-group is a lower bound of the start in the whole group, so nothing is
    dropped that the whole group would keep. Each sub-group's first segment, which always stays,
    takes over the totals of all of it.
    """
    group = W.partitionBy(*keys)
    started = parts.withColumns(
        {
            "_start": _start(keys),
            "_all": F.sum("_total").over(group),
            "_all_important": F.sum("_important").over(group),
        }
    ).where(F.col("_start") < budget)
    first = F.col("_start") == 0
    return started.select(
        "repo_id", "path", "text", *_ORDER, "_chars",
        F.when(first, F.col("_all")).otherwise(F.lit(0)).alias("_total"),
        F.when(first, F.col("_all_important")).otherwise(F.lit(0)).alias("_important"),
    )


def bundle_metrics(
    bundles: DataFrame, lang: Column | str, size: Column | str, technicality: Column | str,
) -> DataFrame:
    """Sizes of each bundle and of the prompt it gives with the parameters."""
    prompt = prompts.render_prompt(lang, size, technicality, "text")
    source = F.col("total_chars") - F.col("important_chars")
    return bundles.select(
        "repo_id", "total_chars", "important_chars", source.alias("source_chars"),
        (F.col("important_chars") / F.col("total_chars")).alias("important_share"),
        F.length("text").cast("long").alias("bundle_chars"),
        F.length(text.strip("text")).cast("long").alias("stripped_chars"),
        F.length(prompt).cast("long").alias("prompt_chars"),
        "truncated",
    )


def route_blank(jobs: DataFrame, bundles: DataFrame) -> DataFrame:
    """Each job with route 'analyse', or 'failed' and the error when its repository gave no text.

    Only the blank test of a bundle is joined, not its text; a stored ``blank`` column spares
    reading the texts.
    """
    blank = F.col("blank") if "blank" in bundles.columns else text.is_blank("text")
    has_text = bundles.select("repo_id", (~blank).alias("_has_text"))
    ok = F.coalesce(F.col("_has_text"), F.lit(False))
    return (
        jobs.join(has_text, "repo_id", "left")
        .withColumn("route", F.when(ok, F.lit("analyse")).otherwise(F.lit("failed")))
        .withColumn("error", F.when(~ok, F.lit(rules.BLANK_REPOSITORY)))
        .drop("_has_text")
    )
