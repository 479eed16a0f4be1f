"""Exact nearest neighbours of a stated query set, block by block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest(
    df: DataFrame,
    id_col: str,
    vec_col: str,
    queries: DataFrame,
    k: int | None = 5,
    min_similarity: float = -1.0,
    keep: Column | None = None,
    block_rows: int = 32_768,
    same_set: bool = True,
) -> DataFrame:
    """(query, id, similarity, place): up to `k` rows most similar to every query, or all of `min_similarity` for None.

    With `same_set` queries are rows of `df` themselves, and a row is no match for itself.

    Ties go to the smaller id, cosines are in double precision and rounded to 9 decimals. `keep`
    filters rows before they are compared, so `k` counts what is left. Queries are (query, vec);
    each block of about `block_rows` of them is broadcast, the rows are read once a block and pruned to
    about `k` per query in every batch, and only those are shuffled. Rows without a usable vector are
    left out.
    """
    spark = df.sparkSession
    rows = df if keep is None else df.where(keep)
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("id is not null and v is not null")
    asked = queries.select(F.col("query").cast("long").alias("query"), F.col("vec").cast("array<double>").alias("vec")).where("query is not null and vec is not null")
    blocks = max(1, -(-asked.count() // block_rows))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)))
    found = None
    for block in range(blocks):
        part = asked.where(F.col("block") == block).orderBy("query").collect()  # about block_rows rows
        if part:
            shared = spark.sparkContext.broadcast((np.array([r["query"] for r in part]), np.array([r["vec"] for r in part], dtype=np.float64)))
            near = rows.mapInArrow(_search(shared, k, min_similarity, same_set), "query long, id long, similarity double")
            found = near if found is None else found.unionByName(near)
    if found is None:
        return spark.createDataFrame([], "query long, id long, similarity double, place long")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "id")).cast("long")
    ranked = found.withColumn("place", place)
    return ranked if k is None else ranked.where(F.col("place") <= k)


def _search(shared, k: int | None, least: float, same_set: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, asked = shared.value
        asked = asked / np.maximum(np.linalg.norm(asked, axis=1, keepdims=True), 1e-300)
        dim = asked.shape[1]
        for batch in batches:
            sizes = batch.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ok = pa.array(sizes == dim)
            ids = batch.column(0).filter(ok).to_numpy(zero_copy_only=False)
            rows = batch.column(1).filter(ok).flatten().fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, dim)
            length = np.linalg.norm(rows, axis=1)
            good = np.isfinite(length) & (length > 0)
            ids, rows = ids[good], rows[good] / length[good][:, None]
            if not len(ids):
                continue
            floor = max(least, -1.0)
            for first in range(0, len(names), 512):
                own = names[first : first + 512]
                scores = np.round(asked[first : first + 512] @ rows.T, 9)
                if same_set:
                    scores[own[:, None] == ids[None, :]] = -9
                lowest = np.full(len(own), floor)
                if k is not None and k < len(ids):  # ties with the k-th stay until all partitions are seen
                    lowest = np.maximum(lowest, np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k])
                line, place = np.nonzero(scores >= lowest[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(own[line]), pa.array(ids[place]), pa.array(scores[line, place])], ["query", "id", "similarity"])

    return run


def best_match(df: DataFrame, id_col: str, vec_col: str, queries: DataFrame, **options) -> DataFrame:
    """(query, similarity): the highest similarity of a query to any row of the set."""
    return nearest(df, id_col, vec_col, queries, k=1, **options).select("query", "id", "similarity")


def search_docs(df: DataFrame, id_col: str, vec_col: str, queries: DataFrame, relations: DataFrame, repo_id: int | None = None, **options) -> DataFrame:
    """`nearest` among all documents, or among those of a repository if one is given; only then are relations (repo_id, doc_id) read."""
    if repo_id is not None:
        own = relations.where(F.col("repo_id") == repo_id).select(F.col("doc_id").alias(id_col)).distinct()
        df = df.join(own, id_col, "left_semi")
    return nearest(df, id_col, vec_col, queries, **options)
