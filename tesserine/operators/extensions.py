"""Extension points: callbacks on matches, strategies, embeddings, table functions, progress and warm-up."""

from __future__ import annotations

import json
import re
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

Extract = Callable[[dict], Mapping | None]


def extracted(df: DataFrame, key: str, text: str, patterns: Mapping[str, str], callbacks: Mapping[str, Extract], dotall: bool = True) -> DataFrame:
    """(key, pattern, first, last, line, text, features): every match with what a callback makes of it, as JSON.

    A callback takes a dictionary (text, groups, named, first, last, line) and gives a mapping; what is
    empty, raises or is no mapping counts as nothing, and the match stays. A pattern that does not
    compile matches nothing.
    """
    key_type = df.schema[key].dataType.simpleString()
    compiled = {}
    for name, p in patterns.items():
        try:
            compiled[name] = re.compile(p, re.MULTILINE | (re.DOTALL if dotall else 0))
        except re.error:
            continue

    def made_of(name: str, match: dict) -> str | None:
        try:
            made = callbacks[name](match) if name in callbacks else None
            return json.dumps(dict(made), ensure_ascii=False, sort_keys=True, default=str) if made else None
        except Exception:  # callbacks are foreign code
            return None

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for name, pattern in compiled.items() if t else ():
                    line, at = 1, 0
                    for m in pattern.finditer(t):
                        line, at = line + t.count("\n", at, m.start()), m.start()
                        match = {"text": m[0], "groups": list(m.groups()), "named": m.groupdict(), "first": m.start(), "last": m.end(), "line": line}
                        keys.append(k)
                        rows.append((name, m.start(), m.end(), line, m[0], made_of(name, match)))
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(0).type), *(pa.array(c, t) for c, t in zip(columns, kinds))], [key, "pattern", "first", "last", "line", "text", "features"])

    return df.select(key, text).mapInArrow(search, f"`{key}` {key_type}, pattern string, first int, last int, line int, text string, features string")


class MatchStrategy(ABC):
    """A way of finding matches that users write: `specific_matches` finds, `adapt_to_context` may change the strategy first."""

    @abstractmethod
    def specific_matches(self, text: str) -> list[dict]:
        """Matches of a text as dictionaries."""

    def adapt_to_context(self, context: Mapping) -> MatchStrategy:
        """The strategy for a context (such as a language); by default itself."""
        return self

    def matches(self, text: str | None, context: Mapping) -> list[dict]:
        """Matches of a text in a context; an error in foreign code gives none."""
        try:
            return list(self.adapt_to_context(context).specific_matches(text)) if text else []
        except Exception:
            return []


def strategy_matches(df: DataFrame, key: str, text: str, context: str, strategy: MatchStrategy) -> DataFrame:
    """(key, place, match): the matches that a strategy finds, as JSON; `context` is a column handed to it under its name."""
    key_type = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, t, c in zip(*(column.to_pylist() for column in batch.columns)):
                rows += [(k, i, json.dumps(m, ensure_ascii=False, sort_keys=True, default=str)) for i, m in enumerate(strategy.matches(t, {context: c}))]
            columns = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.column(0).type), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], [key, "place", "match"])

    return df.select(key, text, context).mapInArrow(run, f"`{key}` {key_type}, place long, match string")


class Embedder(ABC):
    """A model that turns texts into vectors of `dim` numbers; loaded once per task."""

    dim: int

    def load(self) -> None:
        """Called once before the first batch of a task."""

    @abstractmethod
    def embed(self, texts: list[str]) -> np.ndarray:
        """One row of `dim` numbers per text."""


class HashedWords(Embedder):
    """Words counted in `dim` places by their hashes: needs no model and no training."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        import xxhash

        rows = np.zeros((len(texts), self.dim))
        for row, text in zip(rows, texts):
            for word in re.findall(r"\w+", text.lower()):
                h = xxhash.xxh3_64_intdigest(word)
                row[h % self.dim] += 1 if h >> 63 else -1
        return rows


def embedded(df: DataFrame, text: str, model: Embedder, name: str = "embedding", batch_rows: int = 256) -> DataFrame:
    """`df` with a vector for every text, null for null texts; a result of another width is an error."""
    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model.load()
        for batch in batches:
            out: list = [None] * len(batch)
            at = [i for i, t in enumerate(batch) if t is not None]
            for start in range(0, len(at), batch_rows):
                part = at[start : start + batch_rows]
                rows = np.asarray(model.embed([batch.iloc[i] for i in part]), dtype=np.float32)
                if rows.shape != (len(part), model.dim):
                    raise ValueError(f"the model gave {rows.shape}, not {(len(part), model.dim)}")
                for i, row in zip(part, rows):
                    out[i] = row.tolist()
            yield pd.Series(out)

    return df.withColumn(name, vectors(F.col(text)))


def register_table_functions(spark: SparkSession) -> None:
    """SQL table functions: `text_matches(text, pattern)` gives (place, first, last, line, text) of every match."""

    @F.udtf(returnType="place long, first long, last long, line long, text string")
    class TextMatches:
        def eval(self, text: str, pattern: str) -> Iterator[tuple]:
            if text is None or pattern is None:
                return
            try:
                found = re.finditer(pattern, text, re.MULTILINE | re.DOTALL)
            except re.error:
                return
            line, at = 1, 0
            for i, m in enumerate(found):
                line, at = line + text.count("\n", at, m.start()), m.start()
                yield i, m.start(), m.end(), line, m[0]

    spark.udtf.register("text_matches", TextMatches)


class ProgressListener(StreamingQueryListener):
    """Calls back with (query, batch, rows) after every batch of a stream, and with the query when one ends."""

    def __init__(self, on_progress: Callable[[str, int, int], None], on_end: Callable[[str], None] | None = None) -> None:
        self.on_progress, self.on_end = on_progress, on_end

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        self.on_progress(str(event.progress.id), event.progress.batchId, event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        if self.on_end:
            self.on_end(str(event.id))


class WarmUp:
    """Functions that prepare tables ahead of their use, run by name."""

    def __init__(self) -> None:
        self.known: dict[str, Callable[[SparkSession], object]] = {}

    def register(self, name: str, prepare: Callable[[SparkSession], object]) -> None:
        self.known[name] = prepare

    def run(self, spark: SparkSession) -> dict[str, object]:
        """The result of every function, or the error that it raised; one that fails does not stop the others."""
        found = {}
        for name, prepare in self.known.items():
            try:
                found[name] = prepare(spark)
            except Exception as error:
                found[name] = error
        return found
