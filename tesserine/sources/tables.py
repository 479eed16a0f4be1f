"""Parquet tables of one input directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, directory: str, table: str) -> DataFrame:
    """The table `table` of `directory`; a single file and a folder of files read alike."""
    return spark.read.parquet(f"{directory}/{table}.parquet")
