"""Usable vectors, groups of equal vectors, and exact cosines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Float32 rows of a column of `4 * dim` byte strings."""
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, dtype=np.float32).reshape(-1, dim)


def packed(rows: np.ndarray) -> pa.Array:
    """Byte strings of float32 rows."""
    raw = np.ascontiguousarray(rows, dtype=np.float32)
    size = raw.shape[1] * 4
    offsets = np.arange(len(raw) + 1, dtype=np.int32) * size
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(offsets), pa.py_buffer(raw.tobytes())])


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows in double precision at length one."""
    rows = rows.astype(np.float64)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def usable_vectors(df: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """(id, vec): one row per id with `dim` finite values that are not all zero, as float32 bytes.

    Null ids, null vectors, null elements and other lengths are left out. An id delivered with
    different vectors keeps the greatest byte string, so the result does not depend on row order.
    """

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ok = (lengths == dim) & ids.is_valid().to_numpy(zero_copy_only=False)
            ids, lists = ids.filter(pa.array(ok)), lists.filter(pa.array(ok))
            values = lists.flatten().cast(pa.float32()).fill_null(np.nan)
            rows = values.to_numpy(zero_copy_only=False).reshape(-1, dim)
            good = np.isfinite(rows).all(axis=1) & (rows != 0).any(axis=1)
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(good)), packed(rows[good])], ["id", "vec"])

    picked = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("vec"))
    picked = picked.mapInArrow(pick, "id long, vec binary")
    return picked.groupBy("id").agg(F.max("vec").alias("vec"))


def equal_groups(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members(rep, id), reps(rep, vec, n)) of the groups of byte-equal vectors.

    The representative is the least id. Two 64-bit hashes stand for the bytes while grouping, so
    only the aggregated side carries vectors; the minimum is taken map-side first.
    """
    keyed = vectors.withColumns({"h": F.xxhash64("vec"), "g": F.xxhash64(F.lit(7), "vec")})
    reps = keyed.groupBy("h", "g").agg(F.min("id").alias("rep"), F.max("vec").alias("vec"), F.count("*").alias("n"))
    members = keyed.select("h", "g", "id").join(reps.select("h", "g", "rep"), ["h", "g"]).select("rep", "id")
    return members, reps.select("rep", "vec", "n")
