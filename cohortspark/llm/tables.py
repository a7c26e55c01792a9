"""Where the registered queries read their tables and settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def model_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
