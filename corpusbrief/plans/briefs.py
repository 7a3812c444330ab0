"""The whole job for a batch of requests: jobs, bundles, prompts, summaries, events, history."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, prompts, rules, text
from ..operators import assemble, events, generate, requests, select
from ..operators.skew import BYTES_EACH, find_hot_keys
from ..session import landed
from ..sources.tables import HISTORY_SCHEMA, files_of


@dataclass(frozen=True)
class BriefResult:
    """Tables of one batch; ``history`` holds this batch's jobs only, ready to append."""

    jobs: DataFrame
    rejected: DataFrame
    bundles: DataFrame
    events: DataFrame
    history: DataFrame


def heavy_repos(files: DataFrame, each: int = BYTES_EACH) -> DataFrame | None:
    """Repositories by the bytes that can reach the windows: files too large to be selected don't count."""
    bytes_ = F.when(paths.size_ok("size"), F.col("size")).otherwise(F.lit(0))
    return find_hot_keys(files, "repo_id", each, bytes_)


def build_bundles(
    files: DataFrame, cap: int = rules.SOURCE_CAP, budget: int = rules.TEXT_BUDGET, one_scan: bool = False,
    each: int = BYTES_EACH,
) -> DataFrame:
    """Files to one bounded text per repository: select, cap, assemble.

    Files are measured first, and the texts that end up in a bundle fetched by a second scan. ``one_scan``,
    for files that are not a table, carries the texts through the windows instead, where repositories of more than
    ``each`` bytes are found from the small columns and salted.
    """
    selected = select.select_files(files, emitted_only=True)
    if not one_scan:
        return assemble.gather(files, select.capped_places(selected, cap), budget)
    hot = heavy_repos(files, each)
    return assemble.assemble(select.cap_sources(selected, cap, hot), budget, hot)


def run_briefs(
    spark: SparkSession, submitted: DataFrame, files: DataFrame, history: DataFrame | None,
    provider_factory: Callable[[], generate.Provider], work_dir: str,
    now: datetime | None = None, tasks: int | None = None,
) -> BriefResult:
    """Carry ``submitted(request_id, url, repo_id, lang, size, technicality[, user_id])`` through every stage.

    ``repo_id`` ties a request to its files, of which a table of ``store_files`` is read only in the wanted buckets; of ``history`` only the highest id is read. Stage
    results are written under ``work_dir``, the way the stages hand work to each other; running
    again with the same inputs overwrites them.
    """
    accepted, rejected = requests.validate_requests(submitted)
    created = requests.create_jobs(accepted, history, now=now)
    jobs = landed(created, os.path.join(work_dir, "jobs"))

    bundles = build_bundles(files_of(files, jobs.select("repo_id"))).withColumn("blank", text.is_blank("text"))
    bundles = landed(bundles, os.path.join(work_dir, "bundles"))

    # jobs on one repository with the same guidance share one prompt, rendered once
    guided = jobs.withColumns(
        {
            "_length": prompts.length_guidance("size"),
            "_audience": prompts.audience_guidance("technicality"),
        }
    )
    shape = ["repo_id", "lang", "_length", "_audience"]
    asked = guided.select(*shape).distinct()
    rendered = asked.join(bundles.select("repo_id", "text"), "repo_id").select(
        *shape, prompts.prompt_from_guidance("lang", "_length", "_audience", "text").alias("prompt")
    )
    answers = landed(
        generate.generate_distinct(rendered, provider_factory, tasks), os.path.join(work_dir, "answers")
    ).withColumnRenamed("summary", "brief").withColumnsRenamed({"error_kind": "ai_kind", "error_detail": "ai_detail"})

    routed = assemble.route_blank(guided, bundles)
    blank = F.col("route") == "failed"
    outcomes = routed.join(answers, shape, "left").select(
        F.col("id").alias("analysis_id"),
        F.col("created_at").alias("ts"),
        F.when(blank, F.lit("blank_repository")).alias("repo_error_kind"),
        F.lit(None).cast("string").alias("repo_error_detail"),
        (~blank).alias("reached_ai"),
        F.col("ai_kind").alias("ai_error_kind"),
        F.col("ai_detail").alias("ai_error_detail"),
        F.col("prompt_hash").isNotNull().alias("finished"),
        F.col("brief").alias("summary"),
    )
    emitted = landed(events.stage_events(outcomes), os.path.join(work_dir, "events"))

    fresh = jobs.select(*(part.split()[0] for part in HISTORY_SCHEMA.split(", ")))
    finished = events.apply_events(fresh, events.fold_events(emitted))
    return BriefResult(jobs, rejected, bundles, emitted, finished)
