"""Session defaults for running the library."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that keep results comparable and let Spark re-plan at run time.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(master: str | None = None, app: str = "driftmap", **extra: str) -> SparkSession:
    """Return the active session or build one; ``extra`` uses ``__`` for dots in setting names."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {**DEFAULTS, **{k.replace("__", "."): v for k, v in extra.items()}}
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()
