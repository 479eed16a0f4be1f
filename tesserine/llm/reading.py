"""Reading level of documents by gradient-boosted trees over text distributions.

Features are distributions of word lengths, of graded vocabulary, of sentence lengths and of the
overlap of neighbouring sentences. The grade of a word is the mean level of the labelled documents
that hold it, without the document at hand. Predictions are calibrated to levels by cut points
that agree best with predictions cross-validated by source: for those the grades, too, come from
the other sources only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.llm.trees import BoostedTrees
from tesserine.plans.scratch import discard, materialise

# What is not prose: fenced code, tables, log lines, headings, command lines, quoting marks.
_NOT_PROSE = re.compile(
    r"^[ \t]*(?P<fence>```|~~~)[^\n]*\n.*?(?:^[ \t]*(?P=fence)[^\n]*$|\Z)|^[ \t]*\|[^\n]*$|^[ \t]*\[?\d{4}-\d\d-\d\d[T ]\d\d:\d\d[^\n]*$|^[ \t]*#{1,7}[ \t][^\n]*$|^[ \t]*\$ [^\n]*$|`[^`\n]*`",
    re.MULTILINE | re.DOTALL,
)
_CODE_LINE = re.compile(r"[{}][ \t]*$|[()=][^\n]*;[ \t]*$|^[ \t]*[\w.:]+(?: [\w.:*]+)?;[ \t]*$|^[ \t]*(?:import|from|use|require|def|fn|func|class|public|return|end|const|let|var)\b[^.!?]*$|:=|\+=|^[ \t]*[\w.]+(?:\([^()]*\)|[ ]=[ ].*)[ \t]*$|^[ \t]*(?:for|if|while)\b.*[:{][ \t]*$")
_PIECES = re.compile(r"[^\W\d_]+|[.!?…]+(?=\s|$)|[,;:]|\n\s*\n")
_ENDER = re.compile(r"[.!?…](?=\s|$)")
_BULLET = re.compile(r"^[ \t]*(?:[-*+>]|\d+[.)])[ \t]+", re.MULTILINE)

# Frequent function words of the four languages.
FUNCTION_WORDS = {
    "en": "the a an and of to in that this each every with for on by is are which because while when or not from as".split(),
    "de": "der die das und ein eine einen dem den mit für auf bei ist sind weil während wenn oder nicht von als jeder jede dieser diese".split(),
    "fr": "le la les un une et de du des dans que cette ce chaque avec pour sur par est sont parce ou ne pas quand".split(),
    "es": "el la los las un una y de del en que esta este cada con para sobre por es son porque o no cuando mientras".split(),
}
LEVELS = (1, 2, 3, 4)
_STOP, _COMMA = -1, -2


def prose(text: str | None, least_words: int = 4) -> str:
    """The running text of a document in lower case, or '' where it is blank, a log, a table or code."""
    if not text or not text.strip():
        return ""
    kept = _BULLET.sub("\n\n", _NOT_PROSE.sub(" ", text.replace("\r\n", "\n")))
    lines = [x for x in kept.split("\n") if x.strip()]
    code = sum(1 for x in lines if _CODE_LINE.search(x))
    if lines and code * 2 > len(lines):
        return ""
    if code:
        kept = "\n".join(x for x in kept.split("\n") if not _CODE_LINE.search(x))
    words = kept.count(" ") + kept.count("\n")
    if len(_ENDER.findall(kept)) * 40 < words:  # line ends stand for full stops
        kept = kept.replace("\n", ".\n")
    kept = kept.lower()
    return kept if sum(1 for _ in zip(re.finditer(r"[^\W\d_]+", kept), range(least_words))) >= least_words else ""


class _Lexicon(dict):
    """Of each piece: its number; words get numbers from 0 on, stops and commas are negative."""

    LIMIT = 400_000

    def __init__(self, grades: dict[str, tuple[list[float], list[int]]], folds: int = 1) -> None:
        super().__init__()
        self.grades, self.folds = grades, folds
        self.unknown = ([0.0] * folds, [0] * folds)
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.length, self.total, self.count, self.tongue = [], [], [], []

    def __missing__(self, piece: str) -> int:
        if piece[0] in ",;:":
            value = _COMMA
        elif piece[0] in ".!?…\n":
            value = _STOP
        else:
            value = len(self.length)
            total, count = self.grades.get(piece, self.unknown)
            self.length.append(len(piece))
            self.total.append(total)
            self.count.append(count)
            self.tongue.append(sum(1 << i for i, name in enumerate(FUNCTION_WORDS) if piece in FUNCTION_WORDS[name]))
        self[piece] = value
        return value


def _shares(values: np.ndarray, owner: np.ndarray, n: int, cuts: list[float], size: np.ndarray) -> list[np.ndarray]:
    return [np.bincount(owner, values >= c, n) / size for c in cuts]


def _moments(values: np.ndarray, owner: np.ndarray, n: int, size: np.ndarray) -> list[np.ndarray]:
    mean = np.bincount(owner, values, n) / size
    return [mean, np.sqrt(np.maximum(0, np.bincount(owner, values * values, n) / size - mean**2))]


def features(texts: list[str], lexicon: _Lexicon, own_level: np.ndarray | None = None, own_fold: np.ndarray | None = None, without: int = -1, middle: float = 2.5) -> np.ndarray:
    """One row of features per prose text, all computed on arrays over the whole batch.

    Grades leave out the fold `without`. `own_level` and `own_fold` take the level of a labelled text
    back out of the grades of its words.
    """
    if len(lexicon) > _Lexicon.LIMIT:
        lexicon.reset()
    split = [_PIECES.findall(t) for t in texts]
    n = len(texts)
    pieces = np.fromiter((lexicon[p] for s in split for p in s), np.int64)
    doc = np.repeat(np.arange(n), [len(s) for s in split])
    stop, comma, is_word = pieces == _STOP, pieces == _COMMA, pieces >= 0
    word, owner = pieces[is_word], doc[is_word]
    count = np.maximum(np.bincount(owner, minlength=n), 1).astype(float)
    length = np.array(lexicon.length)[word]
    used = [f for f in range(lexicon.folds) if f != without]
    total = np.array(lexicon.total).reshape(-1, lexicon.folds)[:, used].sum(axis=1)[word]
    seen = np.array(lexicon.count).reshape(-1, lexicon.folds)[:, used].sum(axis=1)[word].astype(float)
    if own_level is not None:
        held = (seen > 0) & (own_fold != without)[owner]
        total, seen = total - held * own_level[owner], seen - held
    known = seen >= 2
    grade = (total + 2 * middle) / (seen + 2)
    tongue = np.array(lexicon.tongue)[word]
    # A sentence begins after a stop or with a document.
    begins = np.r_[True, stop[:-1]] | np.r_[True, np.diff(doc) > 0] if len(doc) else stop
    sentence = np.unique(np.cumsum(begins)[is_word], return_inverse=True)[1] if len(word) else np.empty(0, np.int64)
    m = int(sentence.max()) + 1 if len(sentence) else 0
    of = np.zeros(m, np.int64)
    of[sentence] = owner
    size = np.bincount(sentence, minlength=m).astype(float)
    mean_grade = np.bincount(sentence, grade, m) / np.maximum(size, 1)
    per_doc = np.maximum(np.bincount(of, minlength=n), 1).astype(float)
    vocabulary = max(len(lexicon.length), 1)
    pairs = np.unique(sentence * vocabulary + word)
    shared = np.isin(pairs - vocabulary, pairs)
    in_sentence = pairs // vocabulary
    follows = np.r_[False, of[1:] == of[:-1]][in_sentence] if m else np.empty(0, bool)
    repeated = np.bincount(of[in_sentence], shared & follows, n) / np.maximum(np.bincount(of[in_sentence], follows, n), 1)
    distinct = np.bincount(np.unique(owner * vocabulary + word) // vocabulary, minlength=n)
    columns = [np.log1p(count), distinct / np.sqrt(count), repeated, np.bincount(doc, comma, n) / count]
    columns += _moments(length, owner, n, count) + _shares(length, owner, n, [4, 6, 8, 10, 12, 14], count)
    columns += [np.bincount(owner, known, n) / count]
    columns += _moments(grade, owner, n, count) + _shares(grade, owner, n, [1.6, 1.9, 2.2, 2.5, 2.8, 3.1, 3.4], count)
    columns += [np.log1p(per_doc)] + _moments(size, of, n, per_doc) + _shares(size, of, n, [8, 12, 16, 22, 30, 40], per_doc)
    columns += _moments(mean_grade, of, n, per_doc) + _shares(mean_grade, of, n, [1.8, 2.1, 2.4, 2.7, 3.0, 3.3], per_doc)
    # The same distribution weighted by the words of a sentence.
    columns += [np.bincount(of, size * (mean_grade >= c), n) / count for c in (1.8, 2.1, 2.4, 2.7, 3.0, 3.3)]
    columns += [np.bincount(owner, (tongue >> i) & 1, n) / count for i in range(len(FUNCTION_WORDS))]
    return np.stack(columns, axis=1)


@dataclass
class ReadingModel:
    """Word grades, trees and cut points, with the cross-validated agreement of each source."""

    grades: dict[str, tuple[list[float], list[int]]]
    trees: BoostedTrees
    cuts: np.ndarray
    report: list[tuple[str, int, float, float]]

    def levels(self, rows: np.ndarray) -> np.ndarray:
        return 1 + np.searchsorted(self.cuts, self.trees.predict(rows))


def _best_cuts(guess: np.ndarray, level: np.ndarray) -> np.ndarray:
    cuts = np.array([1.5, 2.5, 3.5])
    for _ in range(3):
        for i in range(3):
            tried = np.arange(0.9, 4.1, 0.02)
            low, high = (cuts[i - 1] if i else 0), (cuts[i + 1] if i < 2 else 5)
            tried = tried[(tried > low) & (tried < high)]
            hits = [np.abs(1 + np.searchsorted(np.r_[cuts[:i], c, cuts[i + 1 :]], guess) - level).sum() + 1e-3 * abs(c - (i + 1.5)) for c in tried]
            cuts[i] = tried[int(np.argmin(hits))]
    return cuts


def train_reading_model(docs: DataFrame, id_col: str, text_col: str, source_col: str, labels: DataFrame, max_labelled: int = 20_000, folds: int = 4) -> ReadingModel | None:
    """A model fitted to about `max_labelled` labelled documents (those whose hash falls below a share).

    The level of a document is the mean of its raters. Word grades and features are computed where
    the documents are; the driver receives one row of numbers per labelled document and fold, and
    the words that at least two of these documents hold. Sources are dealt to folds by size. None
    where no labelled document has prose.
    """
    spark = docs.sparkSession
    mean = labels.select(F.col(id_col).cast("long").alias("id"), F.col("reading_level").cast("double").alias("level")).where("id is not null and level between 1 and 4")
    mean = mean.groupBy("id").agg(F.avg("level").alias("level"))
    labelled = mean.count()
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(min(1.0, max_labelled / max(labelled, 1)) * (1 << 30))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"))
    # About max_labelled rows of two numbers: small enough to be broadcast at any size of the tables.
    known = texts.where("t is not null").join(F.broadcast(mean.where(share)), "id").groupBy("id").agg(F.first("level").alias("level"), F.max(F.struct("t", "source")).alias("s"))

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([prose(t) for t in batch.column("t").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], found], ["id", "level", "source", "text"])

    kept = known.select("id", "level", "s.source", "s.t").mapInArrow(running, "id long, level double, source string, text string")
    kept = materialise(kept.where("text <> ''"))
    sizes = sorted(((r["count"], r["source"]) for r in kept.groupBy("source").count().collect()), reverse=True)  # at most one row a labelled document
    if not sizes:
        return None
    held, dealt = [0] * folds, []
    for size, source in sizes:
        fold = held.index(min(held))
        held[fold] += size
        dealt.append((source, fold))
    kept = kept.join(F.broadcast(spark.createDataFrame(dealt, "source string, fold int")), "source")
    if len(dealt) < 2:
        kept = kept.withColumn("fold", F.pmod(F.xxhash64("id"), F.lit(folds)).cast("int"))
    kept = kept.select("id", "level", "source", "fold", "text")

    def graded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[str, int], list] = {}
            for level, fold, text in zip(*(batch.column(c).to_pylist() for c in ("level", "fold", "text"))):
                for word in set(re.findall(r"[^\W\d_]+", text)):
                    entry = sums.setdefault((word, fold), [0.0, 0])
                    entry[0] += level
                    entry[1] += 1
            fields = [pa.array([w for w, _ in sums], pa.string()), pa.array([f for _, f in sums], pa.int32()), pa.array([t for t, _ in sums.values()], pa.float64()), pa.array([n for _, n in sums.values()], pa.int64())]
            yield pa.RecordBatch.from_arrays(fields, ["word", "fold", "total", "n"])

    words = kept.mapInArrow(graded, "word string, fold int, total double, n long").groupBy("word")
    per_fold = [F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{c}{f}") for f in range(folds) for c in ("total", "n")]
    words = words.agg(*per_fold, F.sum("n").alias("n")).where("n > 1")
    # Bounded by what the labelled documents hold.
    grades = {r["word"]: ([float(r[f"total{f}"]) for f in range(folds)], [int(r[f"n{f}"]) for f in range(folds)]) for r in words.collect()}
    shared = spark.sparkContext.broadcast(grades)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = _Lexicon(shared.value, folds)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                level, fold = part.column("level").to_numpy(), part.column("fold").to_numpy()
                texts = part.column("text").to_pylist()
                table = np.stack([features(texts, lexicon, level, fold, f) for f in [*range(folds), -1]], axis=1)
                rows = pa.array([r.tobytes() for r in table], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("level"), part.column("source"), part.column("fold"), rows], ["id", "level", "source", "fold", "rows"])

    rows = sorted(kept.mapInArrow(measured, "id long, level double, source string, fold int, rows binary").collect(), key=lambda r: r["id"])  # one row a labelled document
    discard(kept)
    level, source, fold = np.array([r["level"] for r in rows]), np.array([r["source"] for r in rows]), np.array([r["fold"] for r in rows])
    table = np.stack([np.frombuffer(r["rows"]).reshape(folds + 1, -1) for r in rows])
    guess = np.full(len(rows), level.mean())
    for f in sorted(set(fold)):
        rest = fold != f
        if rest.any():
            guess[~rest] = BoostedTrees(trees=80).fit(table[rest, f], level[rest]).predict(table[~rest, f])
    cuts = _best_cuts(guess, level)
    shown = 1 + np.searchsorted(cuts, guess)
    report = [(s, int((source == s).sum()), float((np.round(level[source == s] + 1e-9) == shown[source == s]).mean()), float(np.abs(level[source == s] - shown[source == s]).mean())) for s in sorted(set(source))]
    whole = {w: ([sum(t)], [sum(n)]) for w, (t, n) in grades.items()}
    return ReadingModel(whole, BoostedTrees().fit(table[:, folds], level), cuts, report)


def reading_agreement(docs: DataFrame, id_col: str, text_col: str, source_col: str, labels: DataFrame, **training: int) -> DataFrame:
    """(source, labelled, agreement, error) of predictions for a source by a model that never saw it.

    agreement: share of labelled documents whose rounded mean level is met; error: mean distance to
    the mean level. Without labels an empty result.
    """
    model = train_reading_model(docs, id_col, text_col, source_col, labels, **training)
    return docs.sparkSession.createDataFrame(model.report if model else [], "source string, labelled long, agreement double, error double")


def reading_levels(docs: DataFrame, id_col: str, text_col: str, source_col: str, labels: DataFrame, **training: int) -> DataFrame:
    """(id, reading_level): one row per document with prose, levels 1 to 4.

    Null ids, and texts that are null, blank, or only a log, a table or code, have no level; a row
    delivered twice counts once. An empty table or labels without a document give an empty result.
    """
    spark = docs.sparkSession
    model = train_reading_model(docs, id_col, text_col, source_col, labels, **training)
    if model is None:
        return spark.createDataFrame([], "id long, reading_level int")
    shared = spark.sparkContext.broadcast(model)  # bounded by the labelled documents and the trees

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = _Lexicon(shared.value.grades)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                texts = [prose(t) for t in part.column(1).to_pylist()]
                has = np.array([bool(t) for t in texts])
                if has.any():
                    found = shared.value.levels(features([t for t in texts if t], lexicon)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(has)), pa.array(found)], ["id", "reading_level"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).where("id is not null and t is not null")
    return texts.mapInArrow(rate, "id long, reading_level int").groupBy("id").agg(F.max("reading_level").alias("reading_level"))
