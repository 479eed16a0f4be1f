"""Filling fixed-capacity containers: lexical retrieval packing.

Texts are spread over shards of about `shard_rows` by a topic, so that texts with words in common meet. In a shard a
BM25 inverted index returns, for the largest unused text, the unused texts most like it; they fill its container greedily, and what
room is left goes to the largest unused texts that still fit. Containers that stay too empty are
given back, and their texts meet others in the shards of another round, as long as a round closes
half of the texts that it takes. A shard never outgrows its size, and rounds are few.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.llm.tokens import _CUTS, VOCABULARY, TokenCounter, read_vocabulary
from tesserine.plans.scratch import materialise

K1, B = 1.2, 0.75
TOPICAL = 9  # letters of a word that tells a topic


class _Cuts(dict):
    """Token count (31 bits) and term hash (32 bits) of cut texts in one number."""

    def __init__(self, vocabulary: str | bytes) -> None:
        super().__init__()
        self.tokens = TokenCounter(vocabulary)

    def __missing__(self, cut: str) -> int:
        if len(self) >= TokenCounter.LIMIT:
            self.clear()
        word = cut.strip().strip(".,;:!?()[]{}`\"'*#|>-").lower()
        # Long words have odd terms, shorter ones even terms, the shortest none.
        term = (xxhash.xxh32_intdigest(word) & ~1 | 2 | (len(word) >= TOPICAL)) if len(word) > 2 else 0
        count = self.tokens[cut]
        value = self[cut] = (term << 31) | count
        return value


def topic_of(terms: np.ndarray) -> int:
    """The term of least mixed hash among the topical ones, else among all: texts share it as they share words; 0 for none."""
    own = terms[terms & 1 == 1]
    own = (own if len(own) else terms).astype(np.uint64)
    with np.errstate(over="ignore"):
        return int(((own * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).min()) if len(own) else 0


class Index:
    """BM25 over the term lists of one shard."""

    def __init__(self, terms: list[np.ndarray]) -> None:
        n = len(terms)
        sizes = np.array([len(t) for t in terms])
        flat = np.concatenate(terms) if n else np.empty(0, np.uint32)
        owner = np.repeat(np.arange(n), sizes)
        names, inverse = np.unique(flat, return_inverse=True)
        pairs, times = np.unique(inverse.astype(np.int64) * max(n, 1) + owner, return_counts=True)
        term, doc = pairs // max(n, 1), pairs % max(n, 1)
        frequency = np.bincount(term, minlength=len(names))
        self.idf = np.log1p((n - frequency + 0.5) / (frequency + 0.5))
        length = 1 - B + B * sizes / max(sizes.mean(), 1e-9) if n else sizes
        self.starts = np.searchsorted(term, np.arange(len(names) + 1))
        self.docs, self.n = doc, n
        self.weights = self.idf[term] * times * (K1 + 1) / (times + K1 * length[doc])
        by_doc = np.argsort(doc, kind="stable")
        self.own = np.split(term[by_doc], np.searchsorted(doc[by_doc], np.arange(1, n))) if n else []
        self.frequency = frequency

    def neighbours(self, seed: int, free: np.ndarray) -> np.ndarray:
        """The free documents that share a term with `seed`, by falling BM25 score."""
        own = self.own[seed]
        own = own[self.frequency[own] > 1]
        if not len(own):
            return np.empty(0, np.int64)
        spans = [slice(self.starts[t], self.starts[t + 1]) for t in own]
        score = np.bincount(np.concatenate([self.docs[s] for s in spans]), np.concatenate([self.weights[s] for s in spans]), self.n)
        found = np.flatnonzero(free & (score > 0))
        return found[np.argsort(-score[found], kind="stable")]


def fill(sizes: np.ndarray, terms: list[np.ndarray], capacity: int) -> list[list[int]]:
    """Containers as lists of positions; every position is used once and no container overflows."""
    if not len(sizes):
        return []
    index, n = Index(terms), len(sizes)
    order = np.argsort(sizes, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    rising = sizes[order]
    free = np.ones(n, bool)
    below = np.arange(n)  # below[i]: a candidate for the last free place up to i

    def last_free(i: int) -> int:
        path = []
        while i >= 0 and not free[order[i]]:
            path.append(i)
            i = below[i] - 1 if below[i] == i else below[i]
        for p in path:
            below[p] = i
        return i

    containers = []
    while (i := last_free(n - 1)) >= 0:
        seed = int(order[i])
        free[seed] = False
        own, room = [seed], capacity - int(sizes[seed])
        if room > rising[0]:
            near = index.neighbours(seed, free)
            while len(near := near[sizes[near] <= room]):
                # By score while there is room, by size for the rest of it.
                at = 0 if room > capacity // 4 else int(sizes[near].argmax())
                other, near = int(near[at]), np.delete(near, at)
                free[other] = False
                own.append(other)
                room -= int(sizes[other])
        while room >= rising[0] and (i := last_free(int(np.searchsorted(rising, room, side="right")) - 1)) >= 0:
            other = int(order[i])
            free[other] = False
            own.append(other)
            room -= int(sizes[other])
        containers.append(own)
    return containers


def _packer(capacity: int, good_fill: float, smallest: int, last: bool, round_no: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """The function that packs one shard of one round.

    A container is good if it is full enough, or if it holds a single text beside which not even the
    smallest of all texts has room.
    """

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("id", "ascending"), ("piece", "ascending")])
        sizes = table.column("n_tokens").to_numpy()
        terms = [np.frombuffer(t, np.uint32) for t in table.column("terms").to_pylist()]
        container, place, good = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int32), np.ones(len(sizes), bool)
        base = (round_no << 56) | (key[0].as_py() << 20)
        for number, own in enumerate(fill(sizes, terms, capacity)):
            container[own] = base | number
            place[own] = np.arange(len(own))
            used = sizes[own].sum()
            good[own] = last or used >= good_fill * capacity or (len(own) == 1 and capacity - used < smallest)
        out = table.select(["id", "piece", "first_token", "n_tokens", "terms"])
        for name, values in (("container_id", container), ("place", place), ("good", good)):
            out = out.append_column(name, pa.array(values))
        return out

    return pack


def _large_topics(items: DataFrame, shard_rows: int) -> DataFrame:
    """(topic, blocks) of the topics that fill half a shard or more, and how many shards they get.

    There is at most one such topic for every `shard_rows` / 2 texts. As a table its size is known before
    it is joined, so the texts are not shuffled for it while it is small.
    """
    counted = items.groupBy("topic").agg(F.count("*").alias("rows")).where(F.col("rows") * 2 >= shard_rows)
    return materialise(counted.select("topic", F.ceil(F.col("rows") / shard_rows).cast("int").alias("blocks")))


def pack_texts(
    df: DataFrame,
    id_col: str,
    text_col: str,
    capacity: int = 2048,
    vocabulary: str = VOCABULARY,
    shard_rows: int = 2000,
    good_fill: float = 0.97,
) -> DataFrame:
    """(id, piece, first_token, n_tokens, container_id, place): every non-empty text in a container.

    A text of at most `capacity` tokens stays whole; a longer one is cut into pieces of `capacity`
    tokens and a rest. Null ids, null and empty texts are left out; ids are expected once and a
    repeated row is packed once (the greatest text of an id). An empty table gives an empty result.
    The index holds every term of every text of a shard, and all unused texts that share a term with
    a seed are candidates.
    """

    shared = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = _Cuts(shared.value)
        for batch in batches:
            sizes, terms, topics = [], [], []
            for text in batch.column(1).to_pylist():
                found = _CUTS.findall(text)
                values = np.fromiter(map(cuts.__getitem__, found), np.int64, len(found))
                sizes.append(int((values & 0x7FFFFFFF).sum()))
                names = (values >> 31).astype(np.uint32)
                names = names[names > 0]
                terms.append(names.tobytes())
                topics.append(topic_of(names))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(topics, pa.int64()), pa.array(terms, pa.binary())], ["id", "n", "topic", "terms"])

    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).where("id is not null and t is not null and t <> ''")
    measured = texts.mapInArrow(measure, "id long, n long, topic long, terms binary").groupBy("id").agg(F.max(F.struct("n", "topic", "terms")).alias("m")).select("id", "m.*")
    measured = materialise(measured.where("n > 0"))
    cut = F.expr(f"transform(sequence(0, cast((n - 1) div {capacity} as int)), p -> struct(p as piece, p * {capacity}L as first_token, least({capacity}L, n - p * {capacity}L) as n_tokens))")
    items = measured.select("id", "topic", "terms", F.explode(cut).alias("c")).select("id", "topic", "c.*", F.when(F.col("c.n_tokens") < capacity, F.col("terms")).otherwise(F.lit(b"")).alias("terms"))

    shape = "id long, piece int, first_token long, n_tokens long, terms binary, container_id long, place int, good boolean"
    done, round_no = None, 0
    total, smallest = items.agg(F.count("*"), F.min("n_tokens")).first()
    while True:
        shards = max(1, -(-total // shard_rows))
        last = shards == 1
        pack = _packer(capacity, good_fill, smallest or 1, last, round_no)
        if round_no == 0 and not last:
            # Large topics get shards of their own, named by a hash behind the numbers that small topics share.
            items = items.join(_large_topics(items, shard_rows), "topic", "left")
            own = F.xxhash64("topic", F.pmod(F.xxhash64("id", "piece"), F.col("blocks")))
            spread = F.when(F.col("blocks").isNotNull(), F.pmod(own, F.lit(1 << 35)) + shards)
            items = items.withColumn("shard", F.coalesce(spread, F.pmod(F.xxhash64("topic"), F.lit(shards))))
        else:
            items = items.withColumn("shard", F.pmod(F.xxhash64(F.lit(round_no), "id", "piece"), F.lit(shards)))
        packed = materialise(items.select("shard", "id", "piece", "first_token", "n_tokens", "terms").groupBy("shard").applyInArrow(pack, shape))
        left, smallest = packed.where("not good").agg(F.count("*"), F.min("n_tokens")).first()
        # Without progress another round would not help either: what it packed stays as it is.
        last = last or left > total // 2
        part = packed if last else packed.where("good")
        part = part.select("id", "piece", "first_token", "n_tokens", "container_id", "place")
        done = part if done is None else done.unionByName(part)
        if last or not left:
            return done
        items, total, round_no = packed.where("not good").select("id", "piece", "first_token", "n_tokens", "terms"), left, round_no + 1
