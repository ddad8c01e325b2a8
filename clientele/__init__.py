"""Customer analytics on Spark: retention, value, segments, churn, growth."""

from clientele.analytics import Analytics
from clientele.config import AnalysisConfig
from clientele.session import local_session, tune
from clientele.sources import Tables, read_tables, star_tables

__all__ = [
    "AnalysisConfig",
    "Analytics",
    "Tables",
    "local_session",
    "read_tables",
    "star_tables",
    "tune",
]
