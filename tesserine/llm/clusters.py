"""Similarity clusters of vectors: grid density clustering in SQL.

Unit vectors are projected onto orthonormal directions and quantised to cells of a grid, whose
coordinates are kept. SQL counts the cells, keeps the dense ones and joins adjacent dense cells;
inside such a cell and across the face of two adjacent ones members are linked when their cosine
reaches the threshold; minimum labels are propagated over the links to convergence. One grid of
all 64 features would cut almost every close pair apart, hence several shifted grids of fewer
features each; their number follows from the wanted recall of a pair right at the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.llm.vectors import equal_groups, matrix, unit, usable_vectors
from tesserine.operators.components import connected_components
from tesserine.plans.scratch import discard, materialise

COPY = 400  # what a row that is shuffled costs, in compared pairs


@lru_cache
def plan_grids(total: int, threshold: float, dim: int, recall: float, seed: int = 5) -> tuple[int, int, float]:
    """(grids, features of a grid, cell width) for `total` vectors, whichever costs least.

    A pair at the threshold and a pair of unrelated directions are simulated: the first must share
    a cell of some grid, or the face of two adjacent cells, with probability `recall`; the second
    says how many rows of a cell are compared for nothing.
    """
    rng = np.random.default_rng(seed)
    close, apart, n = np.sqrt(2 * (1 - threshold) / dim), np.sqrt(2 / dim), 8000
    best = (np.inf, 1, 1, 1.0)
    most = min(24, dim)
    place, step = rng.random((n, most)), rng.standard_normal((n, most))
    for times in (4, 6, 8, 10, 12):
        width = times * max(close, 1e-6)
        other = place + step * (close / width)
        crossed, far = np.floor(other), np.abs(step[:, 0]) * apart / width
        other = other - crossed
        alone = np.mean(np.maximum(0, 1 - far))
        beside = np.mean(np.where(far < 1, far, np.maximum(0, 2 - far)))
        border, border_other = np.minimum(place, 1 - place), np.minimum(other, 1 - other)
        for features in range(1, most + 1):
            moved = np.abs(crossed[:, :features])
            same = (moved == 0).all(axis=1)
            axis = moved.argmax(axis=1)
            face = (moved.sum(axis=1) == 1) & (border[:, :features].argmin(axis=1) == axis) & (border_other[:, :features].argmin(axis=1) == axis)
            line = np.arange(n)
            up = crossed[line, axis] > 0
            face &= np.where(up, place[line, axis] > 0.5, place[line, axis] < 0.5) & np.where(up, other[line, axis] < 0.5, other[line, axis] > 0.5)
            hit = min(0.9999, (same | face).mean())
            if hit < 0.002:
                break
            grids = max(1, int(np.ceil(np.log(1 - recall) / np.log1p(-hit))))
            cost = grids * (2 * COPY + total * (alone**features / 2 + beside * alone ** (features - 1) / (2 * features)))
            best = min(best, (cost, grids, features, width))
    return best[1], best[2], float(best[3])


def _code_type(dim: int) -> np.dtype:
    return np.dtype([("values", "i1", (dim,)), ("scale", "<f4"), ("error", "<f4")])


def shortened(rows: np.ndarray) -> np.ndarray:
    """Unit rows in one byte a feature, with their scale and the length of what that leaves out."""
    out = np.zeros(len(rows), _code_type(rows.shape[1]))
    out["scale"] = np.abs(rows).max(axis=1) / 127
    out["values"] = np.round(rows / out["scale"][:, None])
    out["error"] = np.linalg.norm(rows - out["values"] * out["scale"][:, None].astype(np.float64), axis=1) + 1e-6
    return out


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the links (a, b): the least of every connected set."""
    while len(a):
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def link_cell(codes: np.ndarray, ids: np.ndarray, own: np.ndarray, face: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, other id, sure): links between the rows of one dense cell, of two adjacent ones or of two blocks.

    Sure links tie a row to the least row that it is linked with, whatever lies between; pairs that
    the shortened rows cannot decide come out as they are, unless sure links tie them already. Rows
    close to a few pivots are tied first and not compared with each other, so a crowd around one
    point costs a comparison a row.
    """
    order = np.argsort(ids, kind="stable")
    codes, ids, own, face = codes[order], ids[order], own[order], face[order]
    rows = codes["values"].astype(np.float32) * codes["scale"][:, None]
    error = codes["error"].astype(np.float64)
    n, blocks, faces = len(ids), own.min() != own.max(), face.min() != face.max()
    label, crowd = np.arange(n), np.zeros(n, bool)
    if n > 512:
        tied = np.zeros(n, bool)
        for _ in range(8):
            pivot = int(np.argmin(tied))
            sure = rows @ rows[pivot] - (error + error[pivot] * (1 + error)) >= threshold + 1e-6
            sure[pivot] = True
            label = _merge(label, np.flatnonzero(sure), np.full(int(sure.sum()), pivot))
            tied |= sure
            if tied.all():
                break
        sizes = np.bincount(label, minlength=n)
        crowd = label == sizes.argmax() if sizes.max() > n // 8 else crowd
    first, rest = np.flatnonzero(crowd), np.flatnonzero(~crowd)
    loose: list[tuple[np.ndarray, np.ndarray]] = []
    slack = 2 * float(error.max()) * (1 + float(error.max())) + 1e-6
    for left, inner in ((first, False), (rest, True)):
        for start in range(0, len(left) if len(rest) else 0, 512):
            part = left[start : start + 512]
            scored = rows[part] @ rows[rest].T
            a, b = np.nonzero(scored >= threshold - slack)
            value, a, b = scored[a, b].astype(np.float64), part[a], rest[b]
            keep = np.ones(len(a), bool) if not inner else a < b
            if blocks:
                keep &= own[a] != own[b]
            if faces:
                keep &= face[a] != face[b]
            value, a, b = value[keep], a[keep], b[keep]
            doubt = error[a] * (1 + error[b]) + error[b] + 1e-6
            sure = value - doubt >= threshold
            label = _merge(label, a[sure], b[sure])
            open_pair = ~sure & (value + doubt >= threshold)
            loose.append((a[open_pair], b[open_pair]))
    tied = np.flatnonzero(label != np.arange(n))
    a, b = (np.concatenate(x) for x in zip(*loose)) if loose else (np.empty(0, np.int64),) * 2
    undecided = label[a] != label[b]
    a, b = a[undecided], b[undecided]
    sure = np.r_[np.ones(len(tied), bool), np.zeros(len(a), bool)]
    return np.r_[ids[tied], ids[a]], np.r_[ids[label[tied]], ids[b]], sure


def _around_pivots(rows: DataFrame, dim: int, threshold: float) -> DataFrame:
    """`rows` (k, rep, code, face) with `pivot`, one row of each k by its hash, and `tied`: surely as close to it as links ask."""
    pivots = rows.groupBy("k").agg(F.min_by(F.struct("rep", "code"), F.xxhash64(F.lit(1), "rep")).alias("p"))
    both = rows.join(pivots, "k").select("k", "rep", "code", "face", F.col("p.rep").alias("pivot"), F.col("p.code").alias("near"))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, pivot = (np.frombuffer(b"".join(batch.column(c).to_pylist()), _code_type(dim)) for c in ("code", "near"))
            value = np.einsum("ij,ij->i", own["values"].astype(np.float64), pivot["values"].astype(np.float64)) * own["scale"] * pivot["scale"]
            doubt = own["error"] * (1 + pivot["error"]) + pivot["error"] + 1e-6
            tied = (value - doubt >= threshold) | (batch.column("rep").to_numpy() == batch.column("pivot").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(tied)], ["k", "rep", "code", "face", "pivot", "tied"])

    return both.mapInArrow(test, "k long, rep long, code binary, face byte, pivot long, tied boolean")


def similarity_clusters(
    df: DataFrame,
    id_col: str,
    vec_col: str,
    threshold: float = 0.9,
    min_size: int = 3,
    dim: int = 64,
    block_rows: int = 4096,
    recall: float = 0.99,
    seed: int = 5,
    describe: bool = False,
) -> DataFrame:
    """(id, cluster_head, typical_id, cluster_size) of every id in a cluster of at least `min_size`.

    Clusters are the sets that cosines of at least `threshold` (rounded to 9 decimals) link,
    directly or through others; the head is the least id and the typical member has the highest
    mean cosine to the other members (7 decimals; ties: least id). Ids count once, unusable
    vectors are left out, byte-equal vectors are linked through their representative, an empty
    table gives an empty result. A single pair at the threshold is met with `recall`; that it ties
    two sets apart is rarer. With `describe` comes densest_id, the least member in the cell that
    holds most of the cluster, and densest_rows, how many it holds.

    A cell is dense with at least two members, and two adjacent cells are with a member each near
    their common face. Only rows shortened to a byte a feature are shuffled; pairs that these cannot
    decide are verified with the whole vectors. In cells beyond `block_rows` the rows close to a pivot are
    tied to it at once; the others are compared with all, block by block in tasks of their own.
    """
    spark = df.sparkSession
    vectors = materialise(usable_vectors(df, id_col, vec_col, dim))
    members, reps = equal_groups(vectors)
    reps, members = materialise(reps.select("rep", "vec")), materialise(members)
    # The plan follows the size by powers of two.
    grids, features, width = plan_grids(1 << max(1, reps.count()).bit_length(), threshold, dim, recall, seed)

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(seed)
        axes = np.concatenate([np.linalg.qr(rng.standard_normal((dim, features)))[0] for _ in range(grids)], axis=1)
        shift = rng.random(grids * features) * width
        for batch in batches:
            rows = unit(matrix(batch.column(1), dim))
            place = (rows @ axes + shift) / width
            cells = np.floor(place)
            inside = (place - cells).reshape(-1, grids, features)
            axis = np.minimum(inside, 1 - inside).argmin(axis=2)
            up = np.take_along_axis(inside, axis[:, :, None], 2)[:, :, 0] > 0.5
            whole = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * grids)
            codes = pa.array([c.tobytes() for c in shortened(rows)], pa.binary())
            listed = [pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * grids * features), pa.array(cells.astype(np.int8).ravel()))]
            listed += [pa.ListArray.from_arrays(whole, pa.array(axis.astype(np.int8).ravel())), pa.ListArray.from_arrays(whole, pa.array(up.ravel()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), codes, *listed], ["rep", "code", "cells", "axes", "ups"])

    quantised = materialise(reps.mapInArrow(quantise, "rep long, code binary, cells array<tinyint>, axes array<tinyint>, ups array<boolean>"))
    moved = "transform({0}, (x, i) -> cast(if(i = {1}, x + {2}, x) AS tinyint))"
    placed = spark.sql(
        f"""SELECT rep, code, grid, cell, axes[grid] AS axis, ups[grid] AS up, if(ups[grid], cell, {moved.format("cell", "axes[grid]", "-1")}) AS lower
            FROM (SELECT *, slice(cells, grid * {features} + 1, {features}) AS cell FROM
                  (SELECT *, explode(sequence(0, {grids - 1})) AS grid FROM {{quantised}}))""",
        quantised=quantised,
    )
    counted = materialise(spark.sql("SELECT grid, cell, axis, up, count(*) AS n FROM {placed} GROUP BY grid, cell, axis, up", placed=placed.select("grid", "cell", "axis", "up")))
    dense = spark.sql(
        f"""SELECT xxhash64(grid, cell, cast(-1 AS tinyint)) AS k, ceil(sum(n) / {block_rows}) AS blocks FROM {{counted}} GROUP BY grid, cell HAVING sum(n) >= 2
            UNION ALL
            SELECT xxhash64(l.grid, l.cell, l.axis), ceil((l.n + h.n) / {block_rows}) FROM {{counted}} l JOIN {{counted}} h
            ON l.grid = h.grid AND l.axis = h.axis AND h.cell = {moved.format("l.cell", "l.axis", "1")} WHERE l.up AND NOT h.up""",
        counted=counted,
    )
    dense = materialise(dense.groupBy("k").agg(F.max("blocks").cast("int").alias("blocks")))
    rows = spark.sql(
        """SELECT xxhash64(grid, cell, cast(-1 AS tinyint)) AS k, rep, code, cast(0 AS tinyint) AS face FROM {placed}
           UNION ALL SELECT xxhash64(grid, lower, axis), rep, code, cast(if(up, 0, 1) AS tinyint) FROM {placed}""",
        placed=placed,
    )

    def link(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids = table.column("rep").to_numpy()
        if len(ids) < 2:
            return nothing
        codes = np.frombuffer(b"".join(table.column("code").to_pylist()), _code_type(dim))
        a, b, sure = link_cell(codes, ids, table.column("own").to_numpy(), table.column("face").to_numpy(), threshold)
        return pa.table({"a": a, "b": b, "sure": sure}, schema=nothing.schema)

    nothing = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("sure", pa.bool_())]).empty_table()
    shape = "a long, b long, sure boolean"
    # Cells of one block are grouped by what they are joined on; the hot ones go to as many tasks as they have pairs of blocks.
    found = rows.join(dense.where("blocks = 1").select("k"), "k").withColumn("own", F.lit(0)).groupBy("k").applyInArrow(link, shape)
    hot = dense.where("blocks > 1")
    if hot.limit(1).count():
        crowds = materialise(_around_pivots(rows.join(hot.select("k"), "k"), dim, threshold))
        found = found.unionByName(crowds.where("tied and rep <> pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b"), F.lit(True).alias("sure")))
        # What is tied to the pivot of its cell is compared with the rest only, so a crowd around one point costs no pairs of its own.
        blocks = crowds.groupBy("k").agg(F.ceil(F.count_if(~F.col("tied")) / block_rows).cast("int").alias("rest"), F.ceil(F.count_if("tied") / block_rows).cast("int").alias("crowd")).where("rest > 0")
        split = crowds.join(blocks, "k").withColumn("own", F.when(F.col("tied"), F.col("rest") + F.pmod(F.xxhash64("rep"), F.col("crowd"))).otherwise(F.pmod(F.xxhash64("rep"), F.col("rest"))).cast("int"))
        split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("rest") - 1 + F.when(F.col("tied"), 0).otherwise(F.col("crowd")))))
        split = split.select("k", "rep", "code", "face", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
        found = found.unionByName(split.groupBy("k", "lo", "hi").applyInArrow(link, shape))
    links = materialise(found.distinct())
    discard(counted, dense)
    sides = reps.select(F.col("rep").alias("a"), F.col("vec").alias("va")), reps.select(F.col("rep").alias("b"), F.col("vec").alias("vb"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (unit(matrix(batch.column(c), dim)) for c in ("va", "vb"))
            same = pa.array(np.round(np.einsum("ij,ij->i", left, right), 9) >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(same) for c in ("a", "b")], ["a", "b"])

    doubtful = links.where("not sure").select("a", "b").join(sides[0], "a").join(sides[1], "b").mapInArrow(verify, "a long, b long")
    labels = materialise(connected_components(links.where("sure").select("a", "b").unionByName(doubtful), "a", "b"))
    discard(links, reps)
    heads = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    heads = heads.select("id", F.coalesce("component", "rep").alias("label"))
    # A representative is the least id of its group, so the least representative is the least id.
    sizes = heads.groupBy("label").agg(F.count("*").alias("cluster_size")).where(F.col("cluster_size") >= min_size)
    heads = heads.join(sizes, "label").select("id", F.col("label").alias("cluster_head"), "cluster_size")

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = unit(matrix(batch.column(1), dim))
            offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * dim)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(rows.ravel())), *batch.columns[2:]], ["id", "u", "cluster_head", "cluster_size"])

    units = materialise(vectors.join(heads, "id").mapInArrow(lengths, "id long, u array<double>, cluster_head long, cluster_size long"))
    sums = units.groupBy("cluster_head").agg(*[F.sum(F.col("u")[i]).alias(f"s{i}") for i in range(dim)])
    sums = sums.select("cluster_head", F.array(*[f"s{i}" for i in range(dim)]).alias("s"))
    dot = F.aggregate(F.zip_with("u", "s", lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y)
    means = units.join(sums, "cluster_head").select("id", "cluster_head", "cluster_size", F.round((dot - 1) / (F.col("cluster_size") - 1), 7).alias("mean"))
    typical = means.groupBy("cluster_head").agg(F.min(F.struct((-F.col("mean")).alias("m"), "id")).alias("t"))
    described = heads.join(typical, "cluster_head").select("id", "cluster_head", F.col("t.id").alias("typical_id"), "cluster_size")
    if not describe:
        described = materialise(described)
        discard(vectors, members, quantised, labels, units)
        return described
    cell = quantised.select("rep", F.slice("cells", 1, features).alias("cell"))
    inside = members.join(cell, "rep").join(heads.select("id", "cluster_head"), "id").groupBy("cluster_head", "cell").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    densest = inside.groupBy("cluster_head").agg(F.max(F.struct("n", (-F.col("least")).alias("o"))).alias("d"))
    return described.join(densest, "cluster_head").select(*described.columns, (-F.col("d.o")).alias("densest_id"), F.col("d.n").alias("densest_rows"))
