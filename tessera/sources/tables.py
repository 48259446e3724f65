"""Scans of the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def scan(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of ``sf_dir``; columns are pruned by the plan that uses it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def distinct_rows(df: DataFrame, key: str) -> DataFrame:
    """One row for each ``key``: rows repeated in a table count as one.

    A repeated row is unchanged, so any of the copies will do. Rows whose key
    is null stay as they are told apart by nothing.
    """
    return df.dropDuplicates([key])
