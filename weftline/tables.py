"""Loading of the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a scale directory.  Columns are pruned and filters pushed into this scan by Catalyst."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_enough(df: DataFrame, limit_bytes: int = 64 << 20) -> bool:
    """Whether the optimizer proves ``df`` to be under ``limit_bytes``: the check before any broadcast hint."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) <= limit_bytes
