"""Settings, stored insights, checkouts and several queries at once."""

from __future__ import annotations

import subprocess
from collections.abc import Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def merged_settings(base: Mapping, *updates: Mapping) -> dict:
    """Settings where later ones win, dictionaries are merged key by key and everything else is replaced."""
    found = {k: merged_settings(v) if isinstance(v, Mapping) else v for k, v in base.items()}
    for update in updates:
        for key, value in update.items():
            if isinstance(value, Mapping) and isinstance(found.get(key), Mapping):
                found[key] = merged_settings(found[key], value)
            else:
                found[key] = merged_settings(value) if isinstance(value, Mapping) else value
    return found


def read_insights(spark: SparkSession, path: str) -> DataFrame:
    """The JSON documents of a folder, one row each; broken ones are left out."""
    read = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path)
    return read.where(F.col("_broken").isNull()).drop("_broken") if "_broken" in read.columns else read


def checkout(url: str, folder: str, depth: int = 1, timeout: int = 600) -> str:
    """A shallow clone of a repository into `folder`, which the listing of `tesserine.sources.files` then reads."""
    subprocess.run(["git", "clone", "--quiet", "--depth", str(depth), "--", url, folder], check=True, timeout=timeout)
    return folder


def run_queries(spark: SparkSession, queries: Iterable[tuple[str, Mapping]], threads: int = 4) -> list[DataFrame]:
    """The results of several parameterised queries, each with its own arguments, planned side by side.

    Arguments stand in braces; DataFrames among them are tables of the query.
    """
    with ThreadPoolExecutor(threads) as pool:
        return list(pool.map(lambda job: spark.sql(job[0], **job[1]), queries))
