"""Running and rolling statistics over ordered events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rolling_mean(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, rows: int, name: str = "rolling_mean") -> DataFrame:
    """Mean of the last `rows` values (hundredths) including the row at hand, from exact decimal sums."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - rows, 0)
    return df.withColumn(name, F.sum(F.col(value).cast("decimal(18,2)")).over(w).cast("double") / F.count(value).over(w))


def running_rate(df: DataFrame, keys: Sequence[str], order: Sequence[str], hit: str, name: str = "running_rate") -> DataFrame:
    """Share of hits up to and including each row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(F.col(hit).cast("long")).over(w) / F.count("*").over(w))


def recent(df: DataFrame, keys: Sequence[str], seconds: str, span: int, name: str = "recent") -> DataFrame:
    """Number of rows of the key in the last `span` seconds, the row at hand included."""
    w = Window.partitionBy(*keys).orderBy(F.col(seconds)).rangeBetween(-span, 0)
    return df.withColumn(name, F.count("*").over(w))


def exponential_rate(df: DataFrame, keys: Sequence[str], order: Sequence[str], hit: str, keep: float = 0.9) -> DataFrame:
    """(keys, n, rate): an exponentially weighted rate over the ordered rows of a key, from 1 on.

    Unrolled it is keep^n + (1 - keep) * sum of keep^(n - i) over the hits, so one window for the
    place of a row and one aggregation do; no list of a key's rows is built.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order])) - 1
    weighted = df.withColumn("_w", F.pow(F.lit(keep), place) * F.col(hit).cast("int"))
    total = weighted.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("_w").alias("_s"))
    return total.select(*keys, "n", (F.pow(F.lit(keep), F.col("n")) + (1 - keep) * F.col("_s")).alias("rate"))


def next_version(df: DataFrame, key: str, version: str) -> DataFrame:
    """The version that comes next for every key; 1 where there is none."""
    return df.groupBy(key).agg((F.coalesce(F.max(version), F.lit(0)) + 1).cast("long").alias("next_version"))


def text_windows(df: DataFrame, key: str, text: str, size: int, overlap: int) -> DataFrame:
    """(key, part, chunk): overlapping cuts of a text, whole texts covered; empty texts have none."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(text) - 1 - overlap) / step).cast("int")))
    parts = df.where(F.length(text) > 0).select(key, text, F.explode(starts).alias("part"))
    return parts.select(key, F.col("part").cast("long").alias("part"), F.substring(F.col(text), F.col("part") * step + 1, F.lit(size)).alias("chunk"))
