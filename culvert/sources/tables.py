"""Parquet sources of one scale folder, read lazily by table name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder``; column pruning and filters reach the Parquet scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
