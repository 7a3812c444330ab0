"""Status events: validation, last-writer-wins fold, application to the history, emission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import messages, rules


def checked_events(events: DataFrame) -> DataFrame:
    """Every event with a reject_reason; id 0 counts as missing and status names are case-sensitive."""
    missing = F.coalesce(F.col("analysis_id"), F.lit(0)) == 0
    no_status = F.coalesce(F.col("status"), F.lit("")) == ""
    return events.withColumn(
        "reject_reason",
        F.when(missing | no_status, F.lit("missing id or status"))
        .when(~F.col("status").isin(*rules.STATUSES), F.lit("unknown status")),
    )


def validate_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) events."""
    checked = checked_events(events)
    bad = F.col("reject_reason").isNotNull()
    return checked.where(~bad).drop("reject_reason"), checked.where(bad)


def fold_states(events: DataFrame) -> DataFrame:
    """Mergeable state per job: its last event and its last COMPLETED event.

    Texts the fold can never use are nulled first, so they are neither sorted nor shuffled. All of
    it combines map-side, so a job with very many events costs one row per task.
    """
    valid, _ = validate_events(events)
    completed = F.col("status") == "COMPLETED"
    slim = valid.select(
        "analysis_id", "seq",
        F.struct("seq", "status", F.when(F.col("status") == "FAILED", F.col("error")).alias("error"), "ts").alias("_last"),
        F.when(completed, F.struct("seq", "summary")).alias("_completed"),
    )
    return slim.groupBy("analysis_id").agg(
        F.max_by("_last", "seq").alias("last"),
        F.max_by("_completed", F.when(F.col("_completed").isNotNull(), F.col("seq"))).alias("completed"),
    )


def merge_states(states: DataFrame) -> DataFrame:
    """Fold states of several batches into one state per job; order of the batches is irrelevant."""
    return states.groupBy("analysis_id").agg(
        F.max_by("last", "last.seq").alias("last"),
        F.max_by("completed", "completed.seq").alias("completed"),
    )


def folded(states: DataFrame) -> DataFrame:
    """States as rows: status, error and time of the last event, summary of the last COMPLETED."""
    return states.select(
        "analysis_id",
        F.col("last.status").alias("status"),
        F.col("completed").isNotNull().alias("summary_set"),
        F.col("completed.summary").alias("summary"),
        F.col("last.error").alias("error"),
        F.col("last.ts").alias("updated_at"),
    )


def fold_events(events: DataFrame) -> DataFrame:
    """Outcome of applying each job's events in seq order (seq is unique).

    The last event sets status, error (cleared unless it is FAILED) and time; the last COMPLETED
    event sets the summary, to null if it carries none. There is no guard against going back.
    """
    return folded(fold_states(events))


def apply_events(history: DataFrame, folds: DataFrame) -> DataFrame:
    """History after the fold; jobs without events are unchanged.

    The folds are never broadcast: a file of many equal summaries is small by its dictionary, its rows are not.
    """
    changes = folds.select(
        F.col("analysis_id").alias("id"),
        F.struct("status", "summary_set", "summary", "error", "updated_at").alias("_new"),
    )
    hit = F.col("_new").isNotNull()
    kept = [c for c in history.columns if c not in ("updated_at", "status", "summary", "error")]
    return history.join(changes.hint("merge"), "id", "left").select(
        *kept,
        F.when(hit, F.col("_new.updated_at")).otherwise(F.col("updated_at")).alias("updated_at"),
        F.when(hit, F.col("_new.status")).otherwise(F.col("status")).alias("status"),
        F.when(F.col("_new.summary_set"), F.col("_new.summary")).otherwise(F.col("summary")).alias("summary"),
        F.when(hit, F.col("_new.error")).otherwise(F.col("error")).alias("error"),
    ).select(*history.columns)


def apply_states(history: DataFrame, states: DataFrame) -> DataFrame:
    """History with ``last_seq`` and ``completed_seq`` after merging fold states into it.

    What a job holds is as of its last event and its last COMPLETED one, whose numbers it keeps. A state counts
    only where its numbers are higher, so a repeated batch changes nothing, nor does the order of batches.
    """
    new = states.select(F.col("analysis_id").alias("id"), F.col("last").alias("_last"), F.col("completed").alias("_completed"))

    def newer(event: str, seen: str) -> Column:
        return F.coalesce(F.col(f"{event}.seq") > F.coalesce(F.col(seen), F.col(f"{event}.seq") - 1), F.lit(False))

    last, completed = newer("_last", "last_seq"), newer("_completed", "completed_seq")
    changed = {
        "updated_at": F.when(last, F.col("_last.ts")), "status": F.when(last, F.col("_last.status")),
        "summary": F.when(completed, F.col("_completed.summary")), "error": F.when(last, F.col("_last.error")),
        "last_seq": F.when(last, F.col("_last.seq")), "completed_seq": F.when(completed, F.col("_completed.seq")),
    }
    return history.join(new, "id", "left").select(
        *[changed[c].otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in history.columns]
    )


def orphan_events(folds: DataFrame, history: DataFrame) -> DataFrame:
    """Folded updates whose job does not exist."""
    return folds.join(history.select(F.col("id").alias("analysis_id")), "analysis_id", "left_anti")


def stage_events(outcomes: DataFrame) -> DataFrame:
    """Events the stages emit for each job, in one pass over the jobs.

    ``outcomes(analysis_id, ts, repo_error_kind, repo_error_detail, reached_ai, ai_error_kind,
    ai_error_detail, finished, summary)``: a repository error ends the job; otherwise, once the
    text reached the AI stage, that stage starts, then fails or completes.
    """
    repo_failed = F.col("repo_error_kind").isNotNull()
    in_ai = ~repo_failed & F.coalesce(F.col("reached_ai"), F.lit(False))
    ai_failed = in_ai & F.col("ai_error_kind").isNotNull()
    completed = in_ai & ~ai_failed & F.coalesce(F.col("finished"), F.lit(False))
    none = F.lit(None).cast("string")

    def event(step: int, status: str, message=none, summary=none, error=none):
        return F.struct(
            F.lit(step).alias("step"), F.lit(status).alias("status"), message.alias("message"),
            summary.alias("summary"), error.alias("error"),
        )

    repo_error = messages.error_message("repo_error_kind", "repo_error_detail")
    ai_error = messages.error_message("ai_error_kind", "ai_error_detail")
    emitted = F.array(
        event(0, "PROCESSING", message=F.lit(rules.STAGE_STARTED)),
        F.when(repo_failed, event(1, "FAILED", error=repo_error)),
        F.when(in_ai, event(2, "PROCESSING")),
        F.when(ai_failed, event(3, "FAILED", error=ai_error)),
        F.when(completed, event(3, "COMPLETED", summary=F.col("summary"))),
    )
    return outcomes.select(
        "analysis_id", "ts", F.inline(F.filter(emitted, lambda e: e.isNotNull()))
    ).select(
        (F.col("analysis_id") * 4 + F.col("step")).alias("seq"), "ts", "analysis_id", "status", "message",
        "summary", "error",
    )
