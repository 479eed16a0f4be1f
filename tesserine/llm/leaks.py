"""Evaluation texts leaking into training text.

Item-sized windows of words are embedded by the CGK random walk (Chakraborty, Goldenberg, Koucky
2016): a pointer walks over the window and a shared random function of step and word decides
whether it moves on, so that windows at a small edit distance get outputs at a small Hamming
distance. Positions of the output are sampled several times; equal samples propose a window of a
document for a window of an item, and the edit distance of the words decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.llm.words import LETTERS_DIGITS, WordHashes
from tesserine.plans.scratch import discard, materialise

_MIX = np.uint64(0x9E3779B97F4A7C15)


def plan_sampling(length: int, repeats: int, samples: int, seed: int) -> np.ndarray:
    """Sampled output positions (repeats, samples), from the steps in which a walk covers three quarters of a window.

    What comes later is behind the end of many windows, and an edit in the last quarter then changes no sample.
    """
    rng = np.random.default_rng(seed + length)
    reach = max(2, 3 * length // 2)
    return np.stack([np.sort(rng.permutation(reach)[: min(samples, reach)]) for _ in range(repeats)])


def window_keys(words: np.ndarray, length: int, sampled: np.ndarray, first: int = 0) -> np.ndarray:
    """LSH keys (repeats, windows) of all windows of `length` words of an array of word hashes.

    Every repetition has a random walk of its own; those before `first` are left out.
    """
    n = len(words) - length + 1
    repeats = len(sampled) - first
    if n <= 0:
        return np.empty((repeats, 0), dtype=np.uint64)
    start = np.arange(n, dtype=np.int32)
    end = start + np.int32(length)
    padded = np.append(words, np.uint64(0))
    low = (padded & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    keys = np.zeros((repeats, n), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for r, key in zip(range(first, len(sampled)), keys):
            moves = ((padded + np.uint64(2 * r + 1)) * _MIX) >> np.uint64(20)
            at, wanted = start, set(sampled[r].tolist())
            last = max(wanted, default=-1)
            for step in range(last + 1):
                if step in wanted:
                    out = low[at].astype(np.uint64)
                    out[at >= end] = 0  # past its end a window reads padding, and the pointer stands still
                    key[:] = (key ^ out ^ np.uint64(step)) * _MIX
                    key ^= key >> np.uint64(29)
                if step < last:
                    move = ((moves >> np.uint64(step % 40)) & np.uint64(1)).astype(np.int32)
                    at = np.minimum(at + move[at], end)
            key += np.uint64((r * 0x5851F42D4C957F2D + length) % 2**64)
    return keys


def plan_repetitions(length: int, max_edits: int, samples: int, recall: float, seed: int) -> np.ndarray:
    """Sampled positions of as many repetitions as reach `recall` for windows right at `max_edits`.

    Equal windows always collide, so one repetition suffices for no edits. Otherwise random windows
    are edited at random places and the share that collides is counted; half as many positions are
    sampled then, because an edit shifts a walk for several steps. Repetitions are added until
    `recall` is reached. Where 2048 do not reach it (short windows, a recall of 1), one repetition
    without positions is returned: every window then has the same key and is compared.
    """
    if max_edits == 0:
        return plan_sampling(length, 1, samples, seed)
    sampled = plan_sampling(length, 2048, max(2, samples // 2), seed)
    rng = np.random.default_rng(seed)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(400):
        own = rng.integers(1, 2**63, length + max_edits).astype(np.uint64)
        other = own.copy()
        for at in rng.permutation(length)[:max_edits]:
            kind, new = rng.integers(3), np.uint64(rng.integers(1, 2**63))
            if kind == 0:
                other[at] = new
            elif kind == 1:
                other = np.insert(other, at, new)
            else:
                other = np.append(np.delete(other, at), new)
        pairs.append((own[:length], other[:length]))
    lines = [np.concatenate(side) for side in zip(*pairs)]  # windows laid end to end
    hit = np.zeros(len(pairs), bool)
    for r in range(len(sampled)):
        left, right = (window_keys(line, length, sampled[: r + 1], first=r)[0, ::length] for line in lines)
        hit |= left == right
        if hit.mean() >= recall:
            return sampled[: r + 1]
    return np.empty((1, 0), sampled.dtype)


def edit_distances(items: np.ndarray, here: np.ndarray, lengths: np.ndarray, limit: int) -> np.ndarray:
    """Edits between row i of `items` (m, n) and the nearest prefix of row i of `here` (m, n + limit).

    Only the first `lengths[i]` words of a row of `here` exist. All pairs are computed at once, on the
    diagonals that a distance of at most `limit` can reach; larger distances come out as larger.
    """
    m, n = items.shape
    far = 2 * n + limit + 1
    row = [np.full(m, k if k >= 0 else far) for k in range(-limit, limit + 1)]
    for i in range(1, n + 1):
        new = []
        for k in range(-limit, limit + 1):
            j = i + k
            if j < 0:
                best = np.full(m, far)
            elif j == 0:
                best = np.full(m, i)
            else:
                best = row[k + limit] + (items[:, i - 1] != here[:, j - 1])
                if new:
                    best = np.minimum(best, new[-1] + 1)
            if k < limit and j >= 0:
                best = np.minimum(best, row[k + limit + 1] + 1)
            new.append(best)
        row = new
    return np.min([np.where(n + k <= lengths, r, far) for k, r in zip(range(-limit, limit + 1), row)], axis=0)


class Windows:
    """Windows of items of one length: their words and the keys of all samplings, sorted."""

    BITS = 22

    def __init__(self, words: np.ndarray, sampled: np.ndarray) -> None:
        self.words, self.sampled = words, sampled
        n = words.shape[1]
        # Laid end to end: every n-th key is that of a whole window.
        keys = window_keys(words.ravel(), n, sampled)[:, ::n].view(np.int64)
        order = np.argsort(keys, axis=None, kind="stable")
        self.keys, self.owner = keys.ravel()[order], (order % len(words)).astype(np.int32)
        self.marks = np.zeros(1 << self.BITS, bool)
        self.marks[self.keys & ((1 << self.BITS) - 1)] = True

    def proposed(self, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (column of `lines`, window) that share the key of some sampling."""
        found = []
        for line in lines.view(np.int64):
            some = np.flatnonzero(self.marks[line & ((1 << self.BITS) - 1)])
            low, high = (np.searchsorted(self.keys, line[some], side) for side in ("left", "right"))
            times = high - low
            at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)
            found.append(np.repeat(some, times) * len(self.words) + self.owner[at])
        both = np.unique(np.concatenate(found))
        return both // len(self.words), both % len(self.words)


def leaked_items(
    docs: DataFrame,
    doc_id: str,
    doc_text: str,
    items: DataFrame,
    item_id: str,
    item_text: str,
    window: int = 12,
    max_edits: int = 0,
    in_proportion: bool = False,
    samples: int = 8,
    recall: float = 0.95,
    block_windows: int = 200_000,
    seed: int = 17,
) -> DataFrame:
    """(doc_id, item_id, first_word, matched_windows, edits): documents that hold a passage of an item.

    A passage is `window` consecutive words of the item, or all its words if it has fewer, found in
    the document with at most `max_edits` edited words (`in_proportion`: fewer for fewer words, rounded
    down); `edits` is the least number. Words are lower-cased runs of letters and digits. Ids count
    once, null ids, null texts and texts without words have no row. Equal passages collide in every
    sampling, so none is missed; one at the limit of edits is found with about `recall`.

    The windows of the items are the stated query set. About `block_windows` distinct ones at a time
    are broadcast and all windows of all documents are looked up in one pass per block, so the corpus
    is never shuffled.
    """
    spark = docs.sparkSession

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            ids, lengths, texts = [], [], []
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = hashes.of(LETTERS_DIGITS.findall(raw.lower()))
                size = min(window, len(words))
                for i in range(len(words) - size + 1 if size else 0):
                    ids.append(key)
                    lengths.append(size)
                    texts.append(words[i : i + size].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lengths, pa.int32()), pa.array(texts, pa.binary())], ["item", "size", "words"])

    picked = items.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).cast("string").alias("t")).where("id is not null and t is not null").distinct()
    windows = materialise(picked.mapInArrow(cut, "item long, size int, words binary").distinct())
    distinct = windows.select("size", "words").distinct()
    blocks = max(1, -(-distinct.count() // block_windows))
    distinct = materialise(distinct.withColumn("block", F.pmod(F.xxhash64("words"), F.lit(blocks))))
    edits = {n: max_edits * n // window if in_proportion else max_edits for n in range(1, window + 1)}

    def look_up(shared):  # noqa: ANN001, ANN202
        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = WordHashes()
            for batch in batches:
                for start in range(0, batch.num_rows, 500):
                    part = batch.slice(start, 500)
                    ids = part.column(0).to_numpy()
                    split = [LETTERS_DIGITS.findall(t.lower()) for t in part.column(1).to_pylist()]
                    counts = np.array([len(s) for s in split])
                    words = hashes.of([w for s in split for w in s])
                    ends = np.cumsum(counts)
                    owner = np.repeat(np.arange(len(ids)), counts)
                    padded = np.append(words, np.zeros(2 * window + max_edits, np.uint64))
                    for n, known in shared.value.items():
                        keys = window_keys(words, n, known.sampled)
                        spots = np.flatnonzero(ends[owner[: keys.shape[1]]] - np.arange(keys.shape[1]) >= n)
                        keys = keys[:, spots]
                        for short in range(1, min(edits[n], n - 1) + 1):
                            # With words missing, a passage may end with its document: filled up, its window has keys too.
                            tails = ends[counts >= n - short] - (n - short)
                            filled = np.zeros((len(tails), n), np.uint64)
                            filled[:, : n - short] = words[tails[:, None] + np.arange(n - short)]
                            if len(tails):
                                keys = np.hstack([keys, window_keys(filled.ravel(), n, known.sampled)[:, ::n]])
                                spots = np.append(spots, tails)
                        if not keys.size:
                            continue
                        column, which = known.proposed(np.ascontiguousarray(keys))
                        for first in range(0, len(column), 100_000):
                            at, win = spots[column[first : first + 100_000]], which[first : first + 100_000]
                            here = padded[at[:, None] + np.arange(n + edits[n])]
                            far = edit_distances(known.words[win], here, ends[owner[at]] - at, edits[n])
                            ok = far <= edits[n]
                            at, win, far = at[ok], win[ok], far[ok]
                            if not len(at):
                                continue
                            fields = [pa.array(ids[owner[at]]), pa.array((at - (ends - counts)[owner[at]]).astype(np.int64)), pa.array(np.full(len(at), n, np.int32)), pa.array([known.words[w].tobytes() for w in win], pa.binary()), pa.array(far.astype(np.int32))]
                            yield pa.RecordBatch.from_arrays(fields, ["doc", "at", "size", "words", "edits"])

        return look

    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(doc_text).cast("string").alias("t")).where("id is not null and t is not null")
    hits = None
    for block in range(blocks):
        by_size: dict[int, list[bytes]] = {}
        for row in distinct.where(F.col("block") == block).collect():  # about block_windows rows
            by_size.setdefault(row["size"], []).append(bytes(row["words"]))
        known = {n: Windows(np.frombuffer(b"".join(sorted(rows)), np.uint64).reshape(-1, n), plan_repetitions(n, edits[n], samples, recall, seed)) for n, rows in sorted(by_size.items())}
        part = texts.mapInArrow(look_up(spark.sparkContext.broadcast(known)), "doc long, at long, size int, words binary, edits int")
        hits = part if hits is None else hits.unionByName(part)
    discard(distinct)
    # The same passage may belong to many items: it is reduced per document before items join in.
    passages = hits.groupBy("doc", "size", "words").agg(F.min("at").alias("at"), F.count_distinct("at").alias("n"), F.min("edits").alias("edits"))
    pairs = passages.join(windows, ["size", "words"]).groupBy("doc", "item").agg(F.min("at").alias("first_word"), F.sum("n").alias("matched_windows"), F.min("edits").alias("edits"))
    return pairs.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "first_word", "matched_windows", "edits")
