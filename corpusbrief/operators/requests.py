"""Requests to jobs: validation, defaults, repository identity, ids, compensation, rate flags."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules, urls
from .numbering import numbered


def checked_requests(requests: DataFrame) -> DataFrame:
    """Every request with its stored URL, defaults filled in, and a reject_reason (null if fine)."""
    return requests.select(
        "*",
        F.when(~urls.is_http_url("url"), F.lit("url must be an http or https URL with a host")).alias("reject_reason"),
    ).withColumns(
        {
            "url": F.when(F.col("reject_reason").isNull(), urls.normal_http_url("url")).otherwise(F.col("url")),
            "lang": F.coalesce("lang", F.lit(rules.DEFAULT_LANG)),
            "size": F.coalesce("size", F.lit(rules.DEFAULT_SIZE)),
            "technicality": F.coalesce("technicality", F.lit(rules.DEFAULT_TECHNICALITY)),
        }
    )


def validate_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) requests."""
    checked = checked_requests(requests)
    bad = F.col("reject_reason").isNotNull()
    return checked.where(~bad).drop("reject_reason"), checked.where(bad)


def repository_identity(requests: DataFrame, url: str = "url") -> DataFrame:
    """Adds owner, repo, canonical_url and url_error."""
    return (
        requests.withColumn("_parsed", urls.parse_repo_url(url))
        .withColumns(
            {
                "owner": F.col("_parsed.owner"),
                "repo": F.col("_parsed.repo"),
                "canonical_url": urls.canonical_url("_parsed.owner", "_parsed.repo"),
                "url_error": F.col("_parsed.error"),
            }
        )
        .drop("_parsed")
    )


def create_jobs(
    requests: DataFrame, history: DataFrame | None = None, order: str = "request_id",
    now: datetime | None = None,
) -> DataFrame:
    """QUEUED history rows with the next ids in request order; keeps the request's own columns.

    ``order`` must be unique. Only the highest id so far comes to the driver. ``now`` is one moment
    for the whole batch, in UTC unless it has a zone, so that a retry stores the same time.
    """
    last = 0 if history is None else (history.agg(F.max("id")).first()[0] or 0)
    moment = _utc(datetime.now(timezone.utc) if now is None else now)
    user = F.col("user_id") if "user_id" in requests.columns else F.lit(None)
    jobs = numbered(requests, [order], "id", start=last + 1)
    return jobs.withColumns(
        {
            "user_id": user.cast("string"),
            "repository_url": F.col("url"),
            "created_at": moment,
            "updated_at": moment,
            "status": F.lit("QUEUED"),
            "summary": F.lit(None).cast("string"),
            "error": F.lit(None).cast("string"),
        }
    ).drop("url")


def _utc(moment: datetime) -> Column:
    if moment.tzinfo is not None:
        moment = moment.astimezone(timezone.utc).replace(tzinfo=None)
    return F.lit(moment.isoformat(" ")).cast("timestamp_ntz")


def drop_failed(jobs: DataFrame, failed: DataFrame, key: str = "id") -> DataFrame:
    """Take back the jobs that could not be queued."""
    return jobs.join(failed.select(key), key, "left_anti")


def rate_counts(requests: DataFrame, at: str = "created_at", user: str = "user_id") -> DataFrame:
    """Requests per user and minute; a streaming input keeps its watermark on ``at``.

    Guests share one key, shown as 'guest'; ``is_guest`` tells it from a user of that name.
    """
    guest = F.coalesce(F.col(user), F.lit("")) == ""
    keyed = requests.select(
        F.col(at).alias("_at"), guest.alias("is_guest"), F.when(guest, F.lit("guest")).otherwise(F.col(user)).alias("rate_key"),
    )
    counted = keyed.groupBy(F.window("_at", "1 minute").alias("_minute"), "is_guest", "rate_key").agg(
        F.count(F.lit(1)).alias("n")
    )
    return counted.select(F.col("_minute.start").alias("minute"), "rate_key", "is_guest", "n")


def rate_flags(
    requests: DataFrame, guest: int = rules.GUEST_PER_MINUTE, user: int = rules.USER_PER_MINUTE,
    at: str = "created_at", user_column: str = "user_id",
) -> DataFrame:
    """Minutes in which a user, or the guests together, went over the limit."""
    allowed = F.when(F.col("is_guest"), F.lit(guest)).otherwise(F.lit(user))
    return rate_counts(requests, at, user_column).where(F.col("n") > allowed)


def rate_keys(at: str = "created_at", user: str = "user_id") -> dict[str, Column]:
    """Whose limit a request counts against, and its minute; guests share one limit."""
    guest = F.coalesce(F.col(user), F.lit("")) == ""
    return {"_guest": guest, "_key": F.when(guest, F.lit("")).otherwise(F.col(user)), "_minute": F.date_trunc("minute", at)}


def admit(
    requests: DataFrame, guest: int = rules.GUEST_PER_MINUTE, user: int = rules.USER_PER_MINUTE,
    at: str = "created_at", user_column: str = "user_id", order: str = "id",
) -> DataFrame:
    """Every request with ``admitted``: it is among the first of its user's minute, as many as the limit allows.

    Within a minute the order is that of ``at``, then of ``order``, which must be unique. A request without a time is
    not admitted. A group is one minute of one user, or of all guests, so a busy user spreads over their minutes.
    """
    keyed = requests.withColumns(rate_keys(at, user_column))
    # requests without a time are no group
    alone = F.when(F.col(at).isNull(), F.col(order))
    place = F.row_number().over(W.partitionBy("_guest", "_key", "_minute", alone).orderBy(at, order))
    limit = F.when(F.col("_guest"), F.lit(guest)).otherwise(F.lit(user))
    return keyed.withColumn("admitted", F.col(at).isNotNull() & (place <= limit)).drop("_guest", "_key", "_minute")
