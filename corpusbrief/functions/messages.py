"""Failure texts stored with a job, by kind of failure."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules
from .paths import _col


def error_message(kind: Column | str, detail: Column | str) -> Column:
    """Kinds: clone, internal, api, unexpected, blank_repository, blank_text, empty_text.

    Any other kind stores the detail as it is.
    """
    kind = _col(kind)
    detail = F.coalesce(_col(detail), F.lit(""))
    short = F.left(detail, F.lit(rules.ERROR_DETAIL_CHARS))
    return (
        F.when(kind == "clone", F.concat(F.lit(rules.CLONE_FAILED), short))
        .when(kind == "internal", F.concat(F.lit(rules.REPOSITORY_INTERNAL), short))
        .when(kind == "api", F.concat(F.lit(rules.API_ERROR), detail))
        .when(kind == "unexpected", F.concat(F.lit(rules.UNEXPECTED_AI), detail))
        .when(kind == "blank_repository", F.lit(rules.BLANK_REPOSITORY))
        .when(kind == "blank_text", F.lit(rules.BLANK_AI_TEXT))
        .when(kind == "empty_text", F.lit(rules.EMPTY_TEXT))
        .otherwise(detail)
    )
