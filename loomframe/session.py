"""The session that frames use."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(spark: SparkSession | None = None) -> SparkSession:
    """``spark``, the active session, or a new one with the settings of the environment."""
    return spark or SparkSession.getActiveSession() or SparkSession.builder.appName("loomframe").config("spark.sql.session.timeZone", "UTC").getOrCreate()
