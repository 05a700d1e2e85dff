"""A session with the settings the library relies on: UTC times and adaptive execution."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "storyline", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
