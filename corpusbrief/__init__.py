"""Repository-corpus analysis on Spark: select files, assemble bounded texts, brief them, keep a job history."""

from .operators.generate import ExtractiveProvider, Provider, ProviderConfig
from .plans.briefs import BriefResult, build_bundles, run_briefs
from .session import get_spark

__all__ = [
    "BriefResult",
    "ExtractiveProvider",
    "Provider",
    "ProviderConfig",
    "build_bundles",
    "get_spark",
    "run_briefs",
]
