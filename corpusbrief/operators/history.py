"""Job history reads: latest jobs, ownership lookup, projections, rendering, outcome counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from .skew import first_per_group

_LIST = ["id", "repository_url", "created_at", "status", "lang", "size", "technicality"]
_DETAIL = ["id", "repository_url", "created_at", "updated_at", "lang", "size", "technicality", "summary", "status", "error"]


def as_list_item(history: DataFrame) -> DataFrame:
    return history.select(*_LIST)


def as_detail(history: DataFrame) -> DataFrame:
    """Everything but the owner."""
    return history.select(*_DETAIL)


def as_status(history: DataFrame) -> DataFrame:
    return history.select(
        F.col("id").alias("analysis_id"), "status", "repository_url", "lang", "size", "technicality",
        "summary", "error", "created_at", "updated_at",
    )


def history_for_user(history: DataFrame, user: str, limit: int = rules.HISTORY_PAGE) -> DataFrame:
    """One user's latest jobs, newest first; a higher id breaks ties."""
    mine = history.where(F.col("user_id") == user)
    return as_list_item(mine).orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def history_topk(history: DataFrame, limit: int = rules.HISTORY_PAGE, hot: DataFrame | None = None) -> DataFrame:
    """The latest jobs of every user at once; guests have no list."""
    owned = history.where(F.col("user_id").isNotNull() & (F.col("user_id") != ""))
    return first_per_group(
        owned.select("user_id", *_LIST), "user_id", [F.desc("created_at"), F.desc("id")], limit,
        spread_by=F.col("id"), hot=hot,
    )


def lookup(requests: DataFrame, history: DataFrame) -> DataFrame:
    """Jobs asked for by ``requests(request_id, id, user_id)`` with an ownership check.

    A user sees only their own job; a guest (null or '') is not restricted. Every request gives one
    row, found or not. A much-polled id makes a skewed join side, which AQE splits.
    """
    asked = requests.select("request_id", "id", F.col("user_id").alias("_asker"))
    guest = F.coalesce(F.col("_asker"), F.lit("")) == ""
    rows = history.withColumnRenamed("user_id", "_owner").withColumn("_there", F.lit(True))
    joined = asked.join(rows, "id", "left")
    found = F.coalesce(F.col("_there") & (guest | F.coalesce(F.col("_owner") == F.col("_asker"), F.lit(False))), F.lit(False))
    shown = [F.when(F.col("_found"), F.col(c)).alias(c) for c in _DETAIL if c != "id"]
    missing = F.when(guest, F.lit(rules.NOT_FOUND)).otherwise(F.lit(rules.NOT_FOUND_OR_DENIED))
    return joined.withColumn("_found", found).select(
        "request_id", "id", F.col("_found").alias("found"), *shown,
        F.when(~F.col("_found"), missing).alias("not_found_message"),
    )


def _text_or(value: str, default: str) -> Column:
    return F.coalesce(F.nullif(F.col(value), F.lit("")), F.lit(default))


def render_rows(history: DataFrame) -> DataFrame:
    """Display strings of a job: parameter line, summary, failure text, detail body, terminal flag."""
    has_summary = F.coalesce(F.col("summary"), F.lit("")) != ""
    has_error = F.coalesce(F.col("error"), F.lit("")) != ""
    completed, failed = F.col("status") == "COMPLETED", F.col("status") == "FAILED"
    # a missing parameter is shown as the page shows it
    lang, size, technicality = (F.coalesce(c, F.lit(rules.MISSING_PARAMETER)) for c in ("lang", "size", "technicality"))

    def labelled(labels: tuple[str, ...]) -> Column:
        return F.concat(*[part for label, value in zip(labels, (lang, size, technicality)) for part in (F.lit(label), value)])

    def within(ends: tuple[str, str], value: Column) -> Column:
        return F.concat(F.lit(ends[0]), value, F.lit(ends[1]))

    body = (
        F.when(completed & has_summary, within(rules.DETAIL_SUMMARY, F.col("summary")))
        .when(failed & has_error, within(rules.DETAIL_ERROR, F.col("error")))
        .when(~completed, F.lit(rules.DETAIL_PENDING))
        .otherwise(F.lit(""))
    )
    return history.select(
        "id", "repository_url", "status",
        within(rules.STATUS_LINE, _text_or("status", rules.STATUS_MISSING)).alias("status_line"),
        labelled(rules.PARAMS_LINE).alias("params_line"),
        labelled(rules.DETAIL_PARAMS).alias("detail_params"),
        F.when(completed, _text_or("summary", rules.SUMMARY_MISSING)).alias("summary_text"),
        F.when(failed, _text_or("error", rules.FAILURE_UNKNOWN)).alias("failure_text"),
        body.alias("detail_body"),
        F.col("status").isin(*rules.TERMINAL_STATUSES).alias("terminal"),
    )


def status_counts(history: DataFrame, *by: str) -> DataFrame:
    """Jobs per status, optionally per further columns."""
    return history.groupBy(*by, "status").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("summary").alias("with_summary"),
        F.count("error").alias("with_error"),
    )
