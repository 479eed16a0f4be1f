"""Change-driven updates: filtered, debounced and monitored event streams.

Event time rules: a watermark bounds lateness, and of several changes of one key the latest by
time wins, whatever order they arrive in.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tesserine.operators.upsert import latest_by_key, upsert


def read_changes(spark: SparkSession, folder: str, schema, files: str = "*.parquet", per_trigger: int = 10) -> DataFrame:
    """A stream over the parquet files of a folder that match `files`."""
    return spark.readStream.schema(schema).option("pathGlobFilter", files).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def relevant(changes: DataFrame, kind: str, kinds: Sequence[str], supported: Column | None = None) -> DataFrame:
    """Changes of the wanted kinds, and supported ones only where a test is given."""
    kept = changes.where(F.col(kind).isin(list(kinds)))
    return kept if supported is None else kept.where(supported)


def debounced(changes: DataFrame, key: str, stamp: str, gap: str = "1 second", lateness: str = "10 minutes") -> DataFrame:
    """(key, first, last, changes): one row for changes of a key that follow each other within `gap`."""
    timed = changes.withColumn("_t", F.col(stamp).cast("timestamp")).withWatermark("_t", lateness)
    grouped = timed.groupBy(F.session_window("_t", gap).alias("w"), key)
    return grouped.agg(F.count("*").alias("changes"), F.min("_t").alias("first"), F.max("_t").alias("last")).select(key, "first", "last", "changes")


def monitored(changes: DataFrame, stamp: str, every: str, aggregates: Sequence[Column], *keys: str, lateness: str = "10 minutes") -> DataFrame:
    """Aggregates per tumbling window of `every`."""
    timed = changes.withColumn("_t", F.col(stamp).cast("timestamp")).withWatermark("_t", lateness)
    return timed.groupBy(F.window("_t", every).alias("w"), *keys).agg(*aggregates).select(F.col("w.start").alias("window_start"), *keys, *[F.col(c) for c in _names(aggregates)])


def _names(aggregates: Sequence[Column]) -> list[str]:
    return [a._jc.toString().rpartition(" AS ")[2].strip("`") for a in aggregates]


def run_to_end(stream: DataFrame, folder: str, mode: str = "append") -> StreamingQuery:
    """Process all that is there into parquet at `folder`/out, with a checkpoint beside it."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/out").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def upsert_sink(read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], keys: Sequence[str], stamp: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that upserts the latest change of every key into a versioned table.

    Writing a batch again gives the same table, so replays after a failure do no harm.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        write(upsert(read(), batch, keys, [F.desc(stamp)]), batch_id)

    return apply


def overwriting(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that replaces the table at `path` by the batch, as for complete results."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return write


def bucketed_upsert_sink(folder: str, keys: Sequence[str], stamp: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that upserts the latest change of every key and rewrites only the buckets it falls into.

    The table at `folder` is partitioned by the hash of its keys. The new content of the touched buckets
    is written aside before it replaces them, so the batch never reads what it overwrites; writing a
    batch again gives the same table.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        from tesserine.plans.scratch import discard, materialise

        spark = batch.sparkSession
        changed = materialise(batch.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")))
        touched = [r["_bucket"] for r in changed.select("_bucket").distinct().collect()]  # at most `buckets` rows
        if not touched:
            return
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
        old = spark.read.schema(changed.schema).parquet(folder).where(F.col("_bucket").isin(touched)) if there else changed.limit(0)
        # A change that is older than the row it would replace stays out.
        both = old.select(*changed.columns).unionByName(changed).repartition("_bucket")
        new = materialise(latest_by_key(both, ["_bucket", *keys], [F.desc(stamp)]))
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(folder)
        discard(changed, new)

    return apply


def read_bucketed(spark: SparkSession, folder: str) -> DataFrame:
    """The table that `bucketed_upsert_sink` keeps."""
    return spark.read.parquet(folder).drop("_bucket")


def rebuilding(view: Callable[[DataFrame], DataFrame], source: Callable[[], DataFrame], key: str, folder: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that makes a view anew for the keys that changed, and for them only.

    Changes of a key within a batch count once. The view at `folder` is partitioned by the key.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        invalid = batch.where(F.col(key).isNotNull()).select(key).distinct()
        fresh = view(source().join(invalid, key, "left_semi"))
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(folder)

    return apply


def unexpired(df: DataFrame, stamp: str, seconds: int, now: Column | None = None) -> DataFrame:
    """Rows younger than `seconds`; rows without a time never expire."""
    at = F.current_timestamp() if now is None else now
    return df.where(F.col(stamp).isNull() | (F.col(stamp).cast("timestamp") > at - F.make_interval(secs=F.lit(seconds))))
