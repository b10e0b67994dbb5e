"""Sessions and table access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "fieldloom", **conf: str) -> SparkSession:
    """A session with the settings that the rules assume: UTC and adaptive plans."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC")
    for key, value in {"spark.sql.adaptive.enabled": "true", **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
