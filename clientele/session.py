"""Session settings the plans rely on, and a builder for local runs."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Runtime SQL settings.  A join on a key that holds a large share of the rows is
# split by adaptive execution; "force" lets it do so even where that costs one
# more shuffle, which is only paid when such a key is actually found.
PLAN_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.ansi.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the plan settings to a session that somebody else has built."""
    apply_settings(spark, PLAN_SETTINGS)
    return spark


def apply_settings(spark: SparkSession, settings: dict[str, str | None]) -> dict[str, str | None]:
    """Set (or, for None, unset) what differs; returns the values from before."""
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        if value is None:
            spark.conf.unset(key)
        elif before[key] != value:
            spark.conf.set(key, value)
    return before


def local_session(cores: int | str = "*", app: str = "clientele", **extra: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    partitions = "8" if cores == "*" else str(cores)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.driver.memory", "8g")
        # Plans are built faster without a stack trace for every column.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())
