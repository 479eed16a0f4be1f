"""Keyed upserts without a transactional table format.

Each takes the existing and the incoming rows and gives the new version of the table; writing it
to a new folder and switching over is left to `tesserine.sources.sinks.replace_table`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first of `order`; rows with a null key are kept apart by null."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_p", place).where("_p = 1").drop("_p")


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Existing rows replaced by incoming rows of the same key; of several incoming rows the first of `order`."""
    fresh = latest_by_key(incoming, keys, order)
    return existing.join(fresh.select(*keys), list(keys), "left_anti").unionByName(fresh)


def upsert_columns(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """As an upsert, but only `columns` are replaced and a null in the incoming row keeps the old value."""
    renamed = incoming.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = existing.join(renamed, list(keys), "full_outer")
    others = [c for c in existing.columns if c not in keys and c not in columns]
    return joined.select(*keys, *others, *[F.coalesce(f"_{c}", c).alias(c) for c in columns]).select(*existing.columns)


def insert_missing(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The distinct incoming rows whose key is not there yet."""
    return incoming.dropDuplicates(list(keys)).join(existing.select(*keys), list(keys), "left_anti")


def accumulate(existing: DataFrame, events: DataFrame, keys: Sequence[str], counter: str, stamp: str) -> DataFrame:
    """Counters raised by the number of events of a key, and the time of the last event."""
    news = events.groupBy(*keys).agg(F.count("*").alias("_n"), F.max(stamp).alias("_t"))
    joined = existing.select(*keys, counter, stamp).join(news, list(keys), "full_outer")
    total = F.coalesce(counter, F.lit(0)).cast("long") + F.coalesce("_n", F.lit(0))
    return joined.select(*keys, total.alias(counter), F.greatest(stamp, "_t").alias(stamp))


def replace_groups(existing: DataFrame, incoming: DataFrame, group: Sequence[str]) -> DataFrame:
    """All rows of a group that comes in are replaced by the incoming ones."""
    return existing.join(incoming.select(*group).distinct(), list(group), "left_anti").unionByName(incoming)


def merge_properties(existing: DataFrame, incoming: DataFrame, key: str, props: str = "props") -> DataFrame:
    """Maps merged key by key: new values win, absent keys stay, null values remove a key."""
    joined = existing.select(key, F.col(props).alias("_old")).join(incoming.select(key, F.col(props).alias("_new")), key, "full_outer")
    empty = F.create_map().cast("map<string,string>")
    old, new = F.coalesce("_old", empty), F.coalesce("_new", empty)
    kept = F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k))
    return joined.select(key, F.map_filter(F.map_concat(kept, new), lambda k, v: v.isNotNull()).alias(props))


def merge_edges(nodes: DataFrame, edges: DataFrame, node: str = "id") -> DataFrame:
    """Distinct (src, dst, type) whose ends both exist; edges with a missing end are dropped."""
    ends = nodes.select(F.col(node).alias("_n")).distinct()
    kept = edges.join(ends, edges["src"] == ends["_n"], "left_semi")
    return kept.join(ends, kept["dst"] == ends["_n"], "left_semi").select("src", "dst", "type").distinct()


def union_arrays(existing: DataFrame, incoming: DataFrame, key: str, column: str) -> DataFrame:
    """Array columns united per key, sorted, without duplicates and nulls."""
    both = existing.select(key, column).unionByName(incoming.select(key, column))
    return both.groupBy(key).agg(F.array_compact(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(column, F.array().cast("array<string>"))))))).alias(column))


def insert_with_ids(incoming: DataFrame, order: Sequence[str], id_col: str, after: int = 0) -> DataFrame:
    """Incoming rows with consecutive ids after `after`, in the order of `order`.

    Rows are placed within ranges of the order, and every range starts where those before it end, so no
    task numbers the whole table. Only the sizes of the ranges go to the driver, one number a partition.
    """
    from tesserine.plans.scratch import materialise

    ranged = materialise(incoming.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = sorted((r["_part"], r["count"]) for r in ranged.groupBy("_part").count().collect())  # one row a partition
    starts, total = [], after
    for part, count in sizes:
        starts.append((part, total))
        total += count
    spark = incoming.sparkSession
    begun = spark.createDataFrame(starts, "_part int, _start long")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    numbered = ranged.join(F.broadcast(begun), "_part")
    return numbered.withColumn(id_col, F.col("_start") + place).drop("_part", "_start")


def violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n) of keys that are not unique, or null in a part: what a uniqueness constraint would refuse."""
    missing = F.lit(False)
    for key in keys:
        missing = missing | F.col(key).isNull()
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where((F.col("n") > 1) | missing)


def created(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """All rows of both; unlike a merge it keeps duplicates."""
    return existing.unionByName(incoming, allowMissingColumns=True)


def with_nested(parents: DataFrame, key: str, children: DataFrame, foreign: str, name: str, order: Sequence[str]) -> DataFrame:
    """Parents with a list of their children as structs, in order; no child gives an empty list."""
    own = [c for c in children.columns if c != foreign]
    listed = children.groupBy(F.col(foreign).alias(key)).agg(F.sort_array(F.collect_list(F.struct(*order, *[c for c in own if c not in order]))).alias(name))
    joined = parents.join(listed, key, "left")
    return joined.withColumn(name, F.coalesce(name, F.array().cast(joined.schema[name].dataType)))
