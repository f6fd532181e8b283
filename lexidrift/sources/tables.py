"""Table access by directory: one parquet file or folder per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table `name` under `root`; only the columns later selected are read."""
    return spark.read.parquet(f"{root}/{name}.parquet")
