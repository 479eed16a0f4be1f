"""The k most similar vectors of every vector, through an additive quantiser.

A vector is written as a sum of full-dimensional codewords: one of a coarse book, one of a second
book and one of each residual book, found by beam search. The first two name the lists of an index,
whose number follows the table. Inside a list the members are scored for every query from lookup
tables over the codes and a stored norm, and all that may reach the wanted similarity are reranked
with exact cosines in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserine.llm.vectors import equal_groups, matrix, unit, usable_vectors
from tesserine.plans.scratch import discard, materialise


@dataclass(frozen=True)
class Quantiser:
    """Coarse book (words, dim), second book (cells, dim) whose sums with coarse words name the lists,
    residual books (levels, words, dim), slack of a scored cosine."""

    coarse: np.ndarray
    second: np.ndarray
    books: np.ndarray
    slack: float

    @property
    def lists(self) -> int:
        return len(self.coarse) * len(self.second)

    def centres(self, numbers: np.ndarray) -> np.ndarray:
        """The sums of the codewords that name these lists."""
        return self.coarse[numbers // len(self.second)] + self.second[numbers % len(self.second)]


def _lloyd(points: np.ndarray, words: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    book = points[rng.choice(len(points), words, replace=len(points) < words)].copy()
    for _ in range(rounds):
        half = 0.5 * (book * book).sum(axis=1)
        near = np.concatenate([(p @ book.T - half).argmax(axis=1) for p in np.array_split(points, max(1, len(points) // 4096))])
        order = np.argsort(near, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(near[order]) > 0])
        sums = np.add.reduceat(points[order], starts, axis=0)
        sizes = np.diff(np.r_[starts, len(points)])
        book[near[order][starts]] = sums / sizes[:, None]
    return book


def _best_lists(rows: np.ndarray, q: Quantiser, lists: int) -> np.ndarray:
    """Numbers (n, lists) of the lists whose centres are nearest, best first.

    The beam keeps the best coarse words, extends each by every word of the second book and keeps
    the best sums.
    """
    wide = min(len(q.coarse), lists if len(q.second) == 1 else 2 * lists)
    near = rows @ q.coarse.T - 0.5 * (q.coarse * q.coarse).sum(axis=1)
    top = np.argpartition(-near, wide - 1, axis=1)[:, :wide]
    cross = q.coarse @ q.second.T + 0.5 * (q.second * q.second).sum(axis=1)
    total = np.take_along_axis(near, top, 1)[:, :, None] + (rows @ q.second.T)[:, None, :] - cross[top]
    numbers = (top[:, :, None] * len(q.second) + np.arange(len(q.second))).reshape(len(rows), -1)
    total = total.reshape(len(rows), -1)
    best = np.argpartition(-total, lists - 1, axis=1)[:, :lists]
    best = np.take_along_axis(best, np.argsort(-np.take_along_axis(total, best, 1), axis=1, kind="stable"), 1)
    return np.take_along_axis(numbers, best, 1)


def _beam(residual: np.ndarray, books: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes (m, levels) of the sum of codewords nearest to each row by beam search, and what is left over."""
    levels, words, dim = books.shape
    m = len(residual)
    left, codes = residual[:, None, :], np.zeros((m, 1, 0), dtype=np.uint8)
    for level in range(levels):
        book, width = books[level], left.shape[1]
        error = (left * left).sum(axis=2)[:, :, None] - 2 * (left.reshape(-1, dim) @ book.T).reshape(m, width, words) + (book * book).sum(axis=1)
        flat = error.reshape(m, -1)
        keep = min(beam, flat.shape[1]) if level + 1 < levels else 1
        best = np.argpartition(flat, keep - 1, axis=1)[:, :keep] if keep < flat.shape[1] else np.argsort(flat, axis=1)
        came, word = best // words, best % words
        line = np.arange(m)[:, None]
        codes = np.concatenate([codes[line, came], word[:, :, None].astype(np.uint8)], axis=2)
        left = left[line, came] - book[word]
    return codes[:, 0], left[:, 0]


def encode(rows: np.ndarray, q: Quantiser, lists: int, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lists (n, lists), residual codes (n, lists, levels), stored norms (n, lists).

    Each of the `lists` best lists keeps a beam of its own, so every membership has the codes of its
    own list. The stored norm is the squared length of the sum of codewords.
    """
    n, lists = len(rows), min(lists, q.lists)
    top = _best_lists(rows, q, lists)
    target = np.repeat(rows, lists, axis=0)
    codes, left = _beam(target - q.centres(top.ravel()), q.books, beam)
    built = target - left
    norms = (built * built).sum(axis=1)
    return top.astype(np.int32), codes.reshape(n, lists, -1), norms.reshape(n, lists).astype(np.float32)


def train(sample: np.ndarray, lists: int, levels: int, words: int, beam: int, similarity: float, seed: int, first_words: int = 2048) -> Quantiser:
    """Books fitted to unit rows of a bounded sample, each level on what the beams leave over.

    Up to `first_words` lists are words of the coarse book; more lists are sums with a second book.
    The slack is how far a scored cosine falls below the true one in all but one of 2,000 trials
    at `similarity`.
    """
    rng = np.random.default_rng(seed)
    coarse = _lloyd(sample, min(lists, first_words), 3, rng).astype(np.float32)
    second, dim = np.zeros((1, sample.shape[1]), np.float32), sample.shape[1]
    parts = np.array_split(sample, max(1, len(sample) // 2048))
    if lists > first_words:
        near = np.concatenate([(p @ coarse.T - 0.5 * (coarse * coarse).sum(axis=1)).argmax(axis=1) for p in parts])
        second = _lloyd(sample - coarse[near], -(-lists // first_words), 4, rng).astype(np.float32)
    q = Quantiser(coarse, second, np.zeros((0, words, dim), np.float32), 0.0)
    first = np.concatenate([_best_lists(p, q, 1)[:, 0] for p in parts])
    residual = (sample - q.centres(first)).astype(np.float32)
    left = residual
    for _ in range(levels):
        books = np.concatenate([q.books, _lloyd(left, words, 4, rng).astype(np.float32)[None]])
        q = Quantiser(coarse, second, books, 0.0)
        left = np.concatenate([_beam(p, books, beam)[1] for p in np.array_split(residual, max(1, len(residual) // 2048))])
    part = sample[:4000].astype(np.float32)
    built = part - left[:4000]
    aside = rng.standard_normal(part.shape).astype(np.float32)
    aside -= (aside * part).sum(axis=1, keepdims=True) * part
    aside /= np.maximum(np.linalg.norm(aside, axis=1, keepdims=True), 1e-9)
    s = min(max(similarity, 0.0), 0.999)
    asked = s * part + np.sqrt(1 - s * s) * aside
    low = np.quantile((asked * built).sum(axis=1) + (1 - (built * built).sum(axis=1)) / 2 - s, 0.0005)
    return Quantiser(coarse, second, q.books, float(max(0.02, -low)))


def _score(asked: np.ndarray, number: int, codes: np.ndarray, norms: np.ndarray, q: Quantiser) -> np.ndarray:
    """Scored cosines (asked, members) of one list from lookup tables.

    Half the squared distance of unit rows is one less their cosine, so the score is the product
    with the sum of codewords and half of what its stored norm lacks.
    """
    levels, words, dim = q.books.shape
    table = asked @ q.books.reshape(-1, dim).T
    total = (asked @ q.centres(np.array([number]))[0])[:, None] + (1 - norms)[None, :] / 2
    for level in range(levels):
        total += np.take(table[:, level * words : (level + 1) * words], codes[:, level], axis=1)
    return total


def search_list(ids, rows, codes, norms, side, word, q, keep, similarity, chunk=256):
    """(query, neighbour, similarity) of one list or of two blocks of it, at most `keep` a query."""
    exact, found = unit(rows), []
    asked = exact.astype(np.float32)
    across = side.min() != side.max()
    floor = similarity - q.slack
    for start in range(0, len(ids), chunk):
        scored = _score(asked[start : start + chunk], word, codes, norms, q)
        here = np.arange(start, min(start + chunk, len(ids)))
        scored[here - start, here] = -9
        if across:
            scored[side[here][:, None] == side[None, :]] = -9
        a, b = np.nonzero(scored >= floor)
        a += start
        sim = np.empty(len(a))
        for i in range(0, len(a), 65536):
            sim[i : i + 65536] = np.einsum("ij,ij->i", exact[a[i : i + 65536]], exact[b[i : i + 65536]])
        sim = np.round(sim, 9)
        good = sim >= similarity
        a, b, sim = a[good], b[good], sim[good]
        order = np.lexsort((ids[b], -sim, a))
        a, b, sim = a[order], b[order], sim[order]
        first = np.r_[True, np.diff(a) > 0] if len(a) else np.zeros(0, bool)
        starts = np.flatnonzero(first)
        rank = np.arange(len(a)) - np.repeat(starts, np.diff(np.r_[starts, len(a)]))
        kept = rank < keep
        found.append((ids[a[kept]], ids[b[kept]], sim[kept]))
    return tuple(np.concatenate(x) for x in zip(*found))


def most_similar(
    df: DataFrame,
    id_col: str,
    vec_col: str,
    k: int = 10,
    min_similarity: float = 0.85,
    dim: int = 64,
    per_list: int = 112,
    first_words: int = 2048,
    memberships: int = 6,
    levels: int = 6,
    words: int = 32,
    beam: int = 4,
    rows_per_word: int = 16,
    block_rows: int = 4096,
    seed: int = 11,
) -> DataFrame:
    """(id, neighbour, similarity, place): up to `k` most similar other vectors of every id.

    Ties go to the smaller id; neighbours below `min_similarity` are not reported. Ids count once,
    unusable vectors (`usable_vectors`) are left out, an empty table gives an empty result.

    Every vector is indexed; only the books are fitted to a sample of at most `rows_per_word *
    first_words` rows. There is a list for every `per_list` vectors at any size of the table, every
    vector is a member of its `memberships` best lists, and lists beyond `block_rows` are searched
    block by block in tasks of their own, so nothing is capped. Byte-equal vectors are searched once: all their members share
    the neighbours of the representative, of which the `k + 1` least ids of each group suffice.
    """
    spark = df.sparkSession
    usable = materialise(usable_vectors(df, id_col, vec_col, dim))
    members, reps = equal_groups(usable)
    reps, members = materialise(reps), materialise(members)
    discard(usable)
    total = reps.count()
    schema = "id long, neighbour long, similarity double, place int"
    if total == 0:
        return spark.createDataFrame([], schema)
    n_lists = int(2 ** round(np.log2(max(1, total / per_list))))
    # The bounded sample for the books: rows whose hash falls below a share, so no partition sends more than its part.
    wanted = rows_per_word * min(n_lists, first_words)
    wanted = min(total, max(wanted, 4096))
    share = F.pmod(F.xxhash64(F.lit(seed), "rep"), F.lit(1 << 30))
    taken = reps.select("rep", "vec").where(share < int(min(1.0, 1.1 * wanted / total + 20 / total) * (1 << 30))).collect()
    taken = sorted(taken, key=lambda r: r["rep"])
    sample = unit(np.frombuffer(b"".join(bytes(r.vec) for r in taken), dtype=np.float32).reshape(-1, dim)).astype(np.float32)
    if not len(sample):  # a handful of rows whose hashes all lie above the share
        sample = unit(np.frombuffer(bytes(reps.first().vec), dtype=np.float32).reshape(-1, dim)).astype(np.float32)
    quantiser = train(sample, n_lists, levels, words, beam, min_similarity, seed, first_words)
    shared = spark.sparkContext.broadcast(quantiser)  # bounded by first_words, and one word in the second book for each first_words lists
    lists = min(memberships, quantiser.lists)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(16, min(1024, (1 << 22) // (2 * lists * len(shared.value.second))))  # rows whose sums of words fit into memory
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                rows = matrix(part.column(1), dim)
                top, codes, norms = encode(unit(rows).astype(np.float32), shared.value, lists, beam)
                entry = np.zeros((len(rows), lists), dtype=[("word", "<i4"), ("norm", "<f4"), ("codes", "u1", levels)])
                entry["word"], entry["norm"], entry["codes"] = top, norms, codes
                raw = [e.tobytes() for e in entry.ravel()]
                offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * lists)
                fields = [part.column(0), part.column(1)]
                fields += [pa.ListArray.from_arrays(offsets, pa.array(top.ravel())), pa.ListArray.from_arrays(offsets, pa.array(raw, pa.binary()))]
                yield pa.RecordBatch.from_arrays(fields, ["rep", "vec", "words", "entries"])

    indexed = materialise(reps.select("rep", "vec").mapInArrow(index, "rep long, vec binary, words array<int>, entries array<binary>"))
    sizes = indexed.select(F.explode("words").alias("word")).groupBy("word").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    hot = materialise(sizes.where("blocks > 1"))  # a table of its own: joined by its key, broadcast only while Spark finds it small
    placed = indexed.select("rep", "vec", F.explode(F.arrays_zip("words", "entries")).alias("e"))
    placed = placed.select("rep", "vec", F.col("e.words").alias("word"), F.col("e.entries").alias("entry"))
    placed = placed.join(hot, "word", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("rep", "vec", "word", "entry", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))

    def search(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids = table.column("rep").to_numpy()
        if len(ids) < 2:
            return empty
        rows = matrix(table.column("vec"), dim)
        entry = np.frombuffer(b"".join(table.column("entry").to_pylist()), dtype=[("word", "<i4"), ("norm", "<f4"), ("codes", "u1", levels)])
        a, b, s = search_list(ids, rows, entry["codes"].astype(np.int64), entry["norm"].copy(), table.column("own").to_numpy(), key[0].as_py(), shared.value, k + 1, min_similarity)
        return pa.table({"rep": a, "other": b, "similarity": s}, schema=empty.schema)

    empty = pa.schema([("rep", pa.int64()), ("other", pa.int64()), ("similarity", pa.float64())]).empty_table()
    near = placed.groupBy("word", "lo", "hi").applyInArrow(search, "rep long, other long, similarity double").distinct()
    near = near.unionByName(reps.where("n > 1").select("rep", F.col("rep").alias("other"), F.lit(1.0).alias("similarity")))
    least = members.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("r") <= k + 1)
    ranked = near.join(least.select(F.col("rep").alias("other"), F.col("id").alias("neighbour")), "other")
    best = Window.partitionBy("rep").orderBy(F.desc("similarity"), "neighbour")
    ranked = ranked.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).select("rep", "neighbour", "similarity")
    pairs = members.join(ranked, "rep").where("id <> neighbour")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour"))
    return pairs.withColumn("place", place).where(F.col("place") <= k).select("id", "neighbour", "similarity", "place")
