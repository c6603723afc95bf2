"""Parquet table loading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder; only columns that a query uses are read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
