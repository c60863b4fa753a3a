"""Parquet table source: the driver's tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the data set in ``sf_dir`` (any store Spark can read)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
