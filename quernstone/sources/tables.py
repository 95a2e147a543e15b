"""The standard tables as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = tuple("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; Spark prunes its columns and pushes its filters when the plan is made."""
    if name not in TABLES:
        raise KeyError(f"no table {name}; there are {', '.join(TABLES)}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Temporary views of the named tables, or of all."""
    for name in names or TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
