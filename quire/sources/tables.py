"""Parquet tables of one data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.session import ship_package


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table; ``<folder>/<name>.parquet`` may be a file or a folder of files."""
    ship_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
