"""Near-duplicate records by MinHash with Bayesian pruning of candidates, verified exactly.

Records become sets of word shingles. Bands of MinHash values propose pairs; the members of a
crowded bucket, such as texts with the same notice, are proposed by the rarest shingles of their
sets instead. A pair's values are compared a few at a time, and it is dropped as soon as the
posterior probability that its Jaccard similarity reaches the threshold falls below a tolerance.
What is left is verified on the sets. Records with equal sets are one class until the end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserine.llm.words import WORD, WordHashes, shingles
from tesserine.operators.components import connected_components
from tesserine.plans.scratch import discard, materialise

STEP = 16  # MinHash values compared at a time


@lru_cache
def survival_table(threshold: float, hashes: int, tolerance: float) -> np.ndarray:
    """Least number of matches among the first 16, 32, ... values that keeps a pair.

    The prior of the similarity is uniform, so after m matches of n it follows Beta(m + 1, n - m + 1);
    its tail above the threshold is summed on a grid.
    """
    grid = (np.arange(20_000) + 0.5) / 20_000
    least = []
    for n in range(STEP, hashes + 1, STEP):
        for m in range(n + 1):
            density = np.exp(m * np.log(grid) + (n - m) * np.log1p(-grid) - (m * np.log(max(m, 1) / n) + (n - m) * np.log(max(n - m, 1) / n)))
            if density[grid >= threshold].sum() / density.sum() >= tolerance:
                break
        least.append(m)
    return np.array(least)


def prune(a: np.ndarray, b: np.ndarray, threshold: float, tolerance: float) -> np.ndarray:
    """Indices of the pairs of MinHash rows that survive every comparison."""
    least = survival_table(threshold, a.shape[1], tolerance)
    alive, matches = np.arange(len(a)), np.zeros(len(a), dtype=np.int32)
    for i, wanted in enumerate(least):
        part = slice(i * STEP, (i + 1) * STEP)
        matches = matches + (a[alive, part] == b[alive, part]).sum(axis=1)
        keep = matches >= wanted
        alive, matches = alive[keep], matches[keep]
    return alive


def _minhash(sets: np.ndarray, factors: np.ndarray, addends: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((sets[None, :] * factors[:, None] + addends[:, None]) >> np.uint64(32)).min(axis=1).astype(np.uint32)


def near_duplicate_classes(
    df: DataFrame,
    id_col: str,
    text_col: str,
    to_text: Callable[[str | None], str] = lambda raw: raw or "",
    threshold: float = 0.8,
    shingle_words: int = 5,
    min_words: int | None = None,
    rows_per_band: int = 4,
    bands: int = 56,
    compared: int = 112,
    tolerance: float = 1e-4,
    crowd: int = 500,
    block_rows: int = 2000,
    seed: int = 3,
) -> tuple[DataFrame, DataFrame]:
    """(links(rep_a, rep_b, shared, total), members(rep, id)).

    Links are pairs of classes whose shingle sets reach `threshold` (exact Jaccard, shared >=
    threshold * total); classes are records with equal sets and named by their least id. Every
    similar pair is either inside a class or between two linked classes. Ids count once (one of
    differing texts wins by its hash), null ids and texts of fewer than `min_words` words (default:
    one shingle) have no class, words are lower-cased runs of letters, digits and underscores, an
    empty table gives empty results.

    In buckets of more than `crowd` classes not all pairs are compared. Their classes are joined on
    the rarest part of their shingles, of which similar sets share at least one (prefix filtering), so
    nothing is missed and what only a notice has in common is no candidate. Shingles shared by more
    than `block_rows` classes are joined block by block in tasks of their own.

    With 56 bands of 4 values a pair right at 0.6 is missed with probability 4e-4; the tolerance
    adds at most 1e-4 for each of the comparisons. Until the end a class is its 64-bit hash, and
    only narrow columns are shuffled: 16 bits of a MinHash value, 32 bits of a band.
    """
    count = max(rows_per_band * bands, compared)
    wanted = shingle_words if min_words is None else max(min_words, shingle_words)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        rng = np.random.default_rng(seed)
        factors = rng.integers(1, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        addends = rng.integers(0, 2**63, count, dtype=np.uint64)
        mix = rng.integers(1, 2**63, (bands, rows_per_band), dtype=np.uint64) | np.uint64(1)
        for batch in batches:
            ids, names, sets, signs, keys = [], [], [], [], []
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = WORD.findall(to_text(raw).lower())
                if len(words) < wanted:
                    continue
                own = shingles(hashes.of(words), shingle_words)
                packed = own.tobytes()
                sign = _minhash(own, factors, addends)
                with np.errstate(over="ignore"):
                    band = (sign[: bands * rows_per_band].astype(np.uint64).reshape(bands, rows_per_band) * mix).sum(axis=1)
                ids.append(key)
                names.append(xxhash.xxh3_64_intdigest(packed))
                sets.append(packed)
                signs.append(sign[:compared].astype(np.uint16).tobytes())
                keys.append((band >> np.uint64(32)).astype(np.uint32).view(np.int32))
            offsets = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * bands)
            flat = pa.array(np.concatenate(keys) if keys else np.empty(0, np.int32))
            fields = [pa.array(ids, pa.int64()), pa.array(np.array(names, np.uint64).view(np.int64)), pa.array(sets, pa.binary()), pa.array(signs, pa.binary()), pa.ListArray.from_arrays(offsets, flat)]
            yield pa.RecordBatch.from_arrays(fields, ["id", "class", "grams", "sign", "keys"])

    picked = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("raw")).where("id is not null and raw is not null")
    sketched = materialise(picked.mapInArrow(sketch, "id long, class long, grams binary, sign binary, keys array<int>"))
    chosen = sketched.groupBy("id").agg(F.max("class").alias("class"))
    members = materialise(chosen.join(chosen.groupBy("class").agg(F.min("id").alias("rep")), "class").select("rep", "id", "class"))

    size = (F.length("grams") / 8).cast("int").alias("size")
    slots = sketched.select("class", size, "keys").dropDuplicates(["class"]).select("class", "size", F.posexplode("keys").alias("band", "key"))
    slots = slots.withColumn("band", F.col("band").cast("byte"))
    full = materialise(slots.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1"))
    fits = F.expr(f"least(l.size, r.size) >= {threshold} * greatest(l.size, r.size)")

    def pairs(side: DataFrame, on: list[str], crossing: str) -> DataFrame:
        left, right = side.alias("l"), side.alias("r")
        joined = left.join(right, [F.col(f"l.{c}") == F.col(f"r.{c}") for c in on] + [F.col("l.class") < F.col("r.class"), fits])
        return joined.where(crossing).select(F.col("l.class").alias("a"), F.col("r.class").alias("b"))

    # The counts grow with the records, so they are merged, never broadcast.
    found = pairs(slots.join(full.where(F.col("n") <= crowd).select("band", "key").hint("merge"), ["band", "key"]).select("class", "size", "band", "key"), ["band", "key"], "true")
    crowded = full.where(F.col("n") > crowd)
    if crowded.limit(1).count():
        inside = slots.join(crowded.select("band", "key"), ["band", "key"], "left_semi").select("class").distinct()
        rare = materialise(_rare_shingles(sketched.select("class", size, "grams").join(inside, "class", "left_semi").dropDuplicates(["class"]), threshold))
        counts = rare.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / block_rows).cast("int"))
        rare = rare.join(counts.select("gram", "blocks").hint("merge"), "gram")
        found = found.unionByName(pairs(rare.where("blocks = 1"), ["gram"], "true"))
        large = rare.where("blocks > 1").withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
        large = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        large = large.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})
        found = found.unionByName(pairs(large, ["gram", "lo", "hi"], "l.lo = l.hi or l.own <> r.own"))
    candidates = found.distinct()
    signed = sketched.select("class", "sign").dropDuplicates(["class"])
    sided = candidates.join(signed.toDF("a", "sign_a"), "a").join(signed.toDF("b", "sign_b"), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, compared) for c in ("sign_a", "sign_b"))
            alive = pa.array(prune(a, b, threshold, tolerance))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(alive), batch.column("b").take(alive)], ["a", "b"])

    left = materialise(sided.select("a", "b", "sign_a", "sign_b").mapInArrow(compare, "a long, b long"))
    involved = left.select(F.col("a").alias("class")).unionByName(left.select(F.col("b").alias("class"))).distinct()
    whole = sketched.select("class", "grams").join(involved, "class", "left_semi").dropDuplicates(["class"])
    checked = left.join(whole.toDF("a", "grams_a"), "a").join(whole.toDF("b", "grams_b"), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared, total = [], []
            for x, y in zip(batch.column("grams_a").to_pylist(), batch.column("grams_b").to_pylist()):
                both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
                both.sort(kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                shared.append(same)
                total.append(len(both) - same)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(shared, pa.int64()), pa.array(total, pa.int64())], ["a", "b", "shared", "total"])

    links = checked.select("a", "b", "grams_a", "grams_b").mapInArrow(verify, "a long, b long, shared long, total long")
    exact = F.col("shared").cast("decimal(20,0)") * F.lit(1_000_000) >= F.col("total") * F.lit(int(round(threshold * 1_000_000)))
    names = members.where("rep = id").select("class", "rep")
    links = links.where(exact).join(names.toDF("a", "x"), "a").join(names.toDF("b", "y"), "b")
    links = links.select(F.least("x", "y").alias("rep_a"), F.greatest("x", "y").alias("rep_b"), "shared", "total")
    links = materialise(links)
    discard(sketched, full, left)
    return links, members.select("rep", "id")


def _rare_shingles(sets: DataFrame, threshold: float) -> DataFrame:
    """(class, size, gram): of each set its rarest shingles, as many as leave out fewer than similar sets must share.

    Two sets of at least `threshold` share threshold * size shingles or more, so the others of the
    rarest-first order, and one more, always hold a common one.
    """

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                raws, sizes = part.column("grams").to_pylist(), part.column("size").to_numpy()
                grams = np.frombuffer(b"".join(raws), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column("class").to_numpy(), sizes)), pa.array(np.repeat(sizes, sizes)), pa.array(grams)], ["class", "size", "gram"])

    grams = sets.select("class", "size", "grams").mapInArrow(explode, "class long, size int, gram long")
    counted = grams.join(grams.groupBy("gram").agg(F.count("*").alias("df")), "gram")
    place = F.row_number().over(Window.partitionBy("class").orderBy("df", "gram"))
    needed = F.col("size") - F.ceil(F.col("size") * F.lit(threshold - 1e-9)) + 1
    return counted.withColumn("place", place).where((F.col("place") <= needed) & (F.col("df") > 1)).select("class", "size", "gram")


def near_duplicate_groups(links: DataFrame, members: DataFrame) -> DataFrame:
    """(id, class_id, links, group_id): one row per document.

    class_id is the least id with an equal set, links the number of other classes that are similar to
    its class, group_id the least id of all that links connect, directly or through others.
    """
    both = links.select(F.col("rep_a").alias("rep")).unionByName(links.select(F.col("rep_b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("links"))
    groups = connected_components(links, "rep_a", "rep_b").withColumnRenamed("node", "rep")
    joined = members.join(both, "rep", "left").join(groups, "rep", "left")
    return joined.select("id", F.col("rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "rep").alias("group_id"))


def near_duplicate_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """(id_a, id_b), the smaller id first: every pair of ids inside a class or in linked classes."""
    inside = members.alias("l").join(members.alias("r"), F.expr("l.rep = r.rep and l.id < r.id")).select(F.col("l.id").alias("id_a"), F.col("r.id").alias("id_b"))
    side = members.select(F.col("rep").alias("rep_a"), F.col("id").alias("x"))
    other = members.select(F.col("rep").alias("rep_b"), F.col("id").alias("y"))
    across = links.join(side, "rep_a").join(other, "rep_b").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    return inside.unionByName(across)
