"""A session with settings that suit the engine; explicit settings of the caller win."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "foliospark", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for key, value in ({"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"} | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
