"""The AI stage on its own: queue payloads in, status events out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import prompts, responses, text
from ..session import landed
from .events import stage_events
from .generate import Provider, generate_distinct


def run_ai_stage(
    payloads: DataFrame, provider_factory: Callable[[], Provider], ts: Column, tasks: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(events, rejected) of ``payloads(payload)``.

    A payload that is not accepted is kept with its reason; a blank text fails without a call; all
    others are prompted, one call per distinct prompt. The parsed messages and the provider's output
    are written, so neither is made twice.
    """
    parsed = landed(payloads.select("payload", responses.parse_ai_payload("payload").alias("p")))
    rejected = parsed.where(F.col("p.reject_reason").isNotNull()).select("payload", F.col("p.reject_reason").alias("reject_reason"))
    wanted = parsed.where(F.col("p.reject_reason").isNull()).select("p.*").withColumn("blank", text.is_blank("text"))
    prompt = prompts.render_prompt("lang", "size", "technicality", "text")
    asked = wanted.where("NOT blank").select("analysis_id", prompt.alias("prompt"))
    answered = generate_distinct(asked, provider_factory, tasks).select("analysis_id", "summary", "error_kind", "error_detail")
    none = F.lit(None).cast("string")
    unasked = wanted.where("blank").select(
        "analysis_id", none.alias("summary"), F.lit("blank_text").alias("error_kind"), none.alias("error_detail")
    )
    outcomes = answered.unionByName(unasked).select(
        "analysis_id", ts.alias("ts"), none.alias("repo_error_kind"), none.alias("repo_error_detail"),
        F.lit(True).alias("reached_ai"), F.col("error_kind").alias("ai_error_kind"),
        F.col("error_detail").alias("ai_error_detail"), F.col("error_kind").isNull().alias("finished"), "summary",
    )
    # the first two steps of a job belong to the repository stage
    return stage_events(outcomes).where(F.col("seq") % 4 >= 2), rejected
