"""Files that nobody wrote by hand: belief propagation over directory trees.

Every file has evidence from its text and name, every directory from its name: how telling a name
is is estimated from the marked files below all directories of that name, and conventional names
begin with pseudo-files. A tree of directories per repository ties them together: parents and
children tend to share a label, and files written by hand can overrule the name of their
directory. Sum-product messages go up and down once, which is exact on a tree; each level is one
aggregation, so no repository or directory ever has to fit into a task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserine.plans.scratch import discard, materialise

LABELS = ("handwritten", "generated", "minified", "vendored", "blob")

# Directory names by convention.
GENERATED_DIRS = ["gen", "generated", "autogen", "__generated__", "generated-sources", "generated-src", "generated_src", "_generated", "auto_generated", "autogenerated", "build", "target", "obj", "out"]
MINIFIED_DIRS = ["dist", "min", "minified", "bundles"]
VENDORED_DIRS = ["vendor", "_vendor", "third_party", "thirdparty", "third-party", "3rdparty", "3rd_party", "external", "externals", "extern", "node_modules", "bower_components", "jspm_packages", "site-packages", "dist-packages", "deps", "godeps", "pods", "carthage", "contrib", "libs", "venv", ".venv", "_workspace"]

# Wording of comments about the whole file, in the languages of the collections.
_GENERATED = re.compile(
    r"auto-?\s?generated\b|<auto-generated>|automatically generated|(?:code|file) generated by|@generated\b|generated by .*do not (?:edit|modify)|machine-(?:written|generated) output"
    r"|produced by the .* compiler|automatisch (?:erzeugt|generiert)|maschinell erzeugt|généré automatiquement|automatiquement généré|génér[ée] par"
    r"|generado automáticamente|automáticamente generado|generado por|this (?:file|code) (?:was|is) generated|do not (?:edit|modify)(?: this file)?(?: by hand|;|\.|,|$)",
    re.IGNORECASE,
)
_VENDORED = re.compile(
    r"bundled third-party|third-party code:|upstream copy|imported verbatim|vendored (?:from|copy)|copied (?:verbatim )?from .* v?\d+\.\d+|\(c\) the .* authors|released under the|^\W*!\s*\S+ v?\d+\.\d+"
    r"|part of the \S+ library, release",
    re.IGNORECASE,
)
# Prose about such files: quoted marks, tools that write or read them, own replacements.
_ABOUT = re.compile(r"written by hand|our own|kept and edited here|'[^']*do not edit[^']*'|\"[^\"]*do not edit[^\"]*\"|\b(?:finds|reads|writes|lists|detects|checks|skips)\b.*\b(?:generated|minified|vendored|stubs?)\b|von hand geschrieben|escrito a mano|écrit à la main", re.IGNORECASE)
_COMMENT = re.compile(r"^\s*(?:#(?!\[|!\[)|//|/\*|\*|<!--|--|;)")
_GENERATED_NAME = re.compile(r"(?:\.pb\.\w+|_pb2(?:_grpc)?\.py|\.generated\.\w+|\.gen\.\w+|\.g\.\w+|\.designer\.\w+|\.freezed\.\w+|_generated\.\w+)$|^(?:zz_generated|moc_|ui_)", re.IGNORECASE)
_MINIFIED_NAME = re.compile(r"[.-]min\.[mc]?js$|\.bundle\.[mc]?js$|\.chunk\.[mc]?js$|\.[0-9a-f]{8,}\.[mc]?js$|\.min\.css$", re.IGNORECASE)
_CODE_WORD = re.compile(r"\b(?:def|function|func|fn|class|return|import|from|use|require|const|let|var|for|while|end|public|if)\b")
_SHORT_CODE = re.compile(r"\b(?:function \w{1,2}\(|var \w{1,2}[=,;]|let \w{1,2}[=,;]|const \w{1,2}[=,;]|\w\.\w+\(\w\))")
_BREAKS = re.compile(r"\r\n|\r|\n")


def file_evidence(name: str, text: str | None, named: bool = False) -> list[float]:
    """Log evidence of a file for each label, from its name and every line of its text (None: not there).

    A plain text speaks a little for handwriting, but not below a conventional directory (`named`):
    copies of other people's code look like it.
    """
    h, g, m, v, b = 0.0, 0.0, 0.0, 0.0, 0.0
    if _GENERATED_NAME.search(name):
        g += 7
    if _MINIFIED_NAME.search(name):
        m += 7
    body = (text or "").strip()
    if not body:
        return [h, g, m - 1, v, b - 1]
    lines = _BREAKS.split(body)
    size = len(body)
    long_share = sum(len(x) for x in lines if len(x) > 180 and not _COMMENT.match(x)) / size
    digits = sum(map(body.count, "0123456789")) / size
    words = len(_CODE_WORD.findall(body))
    blanks = sum(map(body.count, " \n\t\r")) / size
    squeezed = long_share > 0.5 and len(_SHORT_CODE.findall(body)) >= 3
    if squeezed:
        m += 10
    elif size > 120 and (digits > 0.18 and words <= max(2, len(lines) // 20) or long_share > 0.5 and blanks < 0.03 and words < 4):
        b += 10
    else:
        plain = 0.55 if named else 0.9  # 0.55 leaves the labels of _FILES as likely as they are
        g, m, v, b = g - plain, m - 6, v - plain, b - 6
    for line in lines:  # marks stand at the head, below licences of any length or at the foot
        if not _COMMENT.match(line):
            continue
        if _ABOUT.search(line):
            h += 4
        elif _VENDORED.search(line):
            v += 9
        elif _GENERATED.search(line):
            g += 9
    return [h, g, m, v, b]


# Log compatibilities (parent label, child label) between directories, and of a directory with a file.
_DIRS = np.log(np.full((5, 5), 0.005) + np.eye(5) * 0.975)
_FILES = np.log(
    np.array(
        [
            [0.50, 0.125, 0.125, 0.125, 0.125],
            [0.12, 0.82, 0.02, 0.02, 0.02],
            [0.12, 0.02, 0.82, 0.02, 0.02],
            [0.12, 0.01, 0.01, 0.85, 0.01],
            [0.12, 0.02, 0.02, 0.02, 0.82],
        ]
    )
)
# The top of a repository is its own. A conventional name counts as this many files with marks, and what any
# other name may say is bounded: ordinary names are as likely below a vendored directory as elsewhere.
_ROOT, _LISTED, _MOST = 20.0, 1000.0, 3.0
_MARK = 5.0  # evidence of a file that counts when names are estimated


def _send(df: DataFrame, values: list[Column], prefix: str, table: np.ndarray) -> DataFrame:
    """`df` with log messages `prefix`0..4: entry i is the log of sum over j of exp(table[i, j] + values[j]).

    The steps are columns of their own, so that no expression is repeated in the generated code.
    """
    df = df.withColumns({f"_v{j}": v for j, v in enumerate(values)})
    df = df.withColumn("_top", F.greatest(*[f"_v{j}" for j in range(5)]))
    df = df.withColumns({f"_x{j}": F.exp(F.col(f"_v{j}") - F.col("_top")) for j in range(5)})
    sums = {f"{prefix}{i}": F.col("_top") + F.log(sum(F.col(f"_x{j}") * float(np.exp(table[i, j])) for j in range(5))) for i in range(5)}
    return df.withColumns(sums).drop("_top", *[f"_v{j}" for j in range(5)], *[f"_x{j}" for j in range(5)])


def _named(columns: list[Column], prefix: str) -> list[Column]:
    return [c.alias(f"{prefix}{i}") for i, c in enumerate(columns)]


def name_evidence(judged: DataFrame) -> DataFrame:
    """(name, p1..p4): log evidence of a directory's name for each label against handwritten.

    Over all directories of a name, files with strong marks for a label stand against those with
    marks of being handwritten; below a name that is not conventional the files without any mark
    count as handwritten too. Names that say nothing are left out.
    """
    marks = [(F.col(f"e{i}") >= _MARK) & (F.col(f"e{i}") > F.col("e0")) for i in range(1, 5)]
    parts = judged.where("dir <> ''").select(F.explode(F.array_distinct(F.split(F.lower("dir"), "/"))).alias("name"), (F.col("e0") >= 4).alias("h"), *[m.alias(f"m{i}") for i, m in enumerate(marks, 1)])
    counts = parts.groupBy("name").agg(F.count("*").alias("n"), F.count_if("h").alias("h"), *[F.count_if(f"m{i}").alias(f"m{i}") for i in range(1, 5)])
    listed = [F.lit(False), F.col("name").isin(GENERATED_DIRS), F.col("name").isin(MINIFIED_DIRS), F.col("name").isin(VENDORED_DIRS), F.lit(False)]
    conventional = listed[1] | listed[2] | listed[3]
    values = []
    for i in range(1, 5):
        known = F.when(listed[i], F.log((F.col(f"m{i}") + _LISTED) / (F.col("h") + 1))).otherwise(F.lit(0.0))
        learned = F.greatest(F.lit(0.0), F.least(F.lit(_MOST), F.log((F.col(f"m{i}") + 0.1) / (F.col("n") - F.col(f"m{i}") + 1))))
        values.append(F.when(conventional, known).otherwise(learned).alias(f"p{i}"))
    named = counts.select("name", *values, conventional.alias("conventional"))
    return named.where("conventional or greatest(p1, p2, p3, p4) > 0")


def label_files(files: DataFrame, repo_col: str, path_col: str, content_col: str, copy_repos: int = 4, copy_lines: int = 10) -> DataFrame:
    """(repo, path, label, belief) of every file, paths as stored; labels are `LABELS`.

    A content of `copy_lines` or more lines (line ends and outer blanks aside) in `copy_repos` or
    more repositories is a third-party copy. Null or missing contents leave only the name and the
    directories as evidence; null repositories or paths have no row; rows delivered twice count
    once (the greatest content wins). An empty table gives an empty result.
    """
    conventional = frozenset(GENERATED_DIRS + MINIFIED_DIRS + VENDORED_DIRS)
    one = files.select(F.col(repo_col).cast("long").alias("repo"), F.col(path_col).alias("path"), F.col(content_col).alias("text")).where("repo is not null and path is not null")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, texts = batch.column("path").to_pylist(), batch.column("text").to_pylist()
            split = [re.split(r"[/\\]", p) for p in paths]
            marks = np.array([file_evidence(s[-1], t, not conventional.isdisjoint(x.lower() for x in s[:-1])) for s, t in zip(split, texts)]).reshape(-1, 5)
            plain = ["\n".join(_BREAKS.split(t)).strip() if t else "" for t in texts]
            lines = [t.count("\n") + 1 for t in plain]
            fields = [batch.column("repo"), batch.column("path"), *(pa.array(marks[:, i]) for i in range(5)), pa.array(lines, pa.int32())]
            yield pa.RecordBatch.from_arrays([*fields, pa.array([hash_pair(t) for t in plain], pa.binary())], [*"repo path e0 e1 e2 e3 e4 lines copy".split()])

    judged = one.mapInArrow(judge, "repo long, path string, e0 double, e1 double, e2 double, e3 double, e4 double, lines int, copy binary")
    judged = judged.groupBy("repo", "path").agg(F.max(F.struct("lines", "copy", *[f"e{i}" for i in range(5)])).alias("s")).select("repo", "path", "s.*")
    norm = F.regexp_replace(F.regexp_replace(F.translate("path", "\\", "/"), "^(\\./)+", ""), "/+", "/")
    judged = judged.withColumn("dir", F.regexp_extract(norm, "^/?(.*)/[^/]*$", 1))
    judged = materialise(judged)
    copies = judged.where(F.col("lines") >= copy_lines).select("copy", "repo").distinct().groupBy("copy").agg(F.count("*").alias("n")).where(F.col("n") >= copy_repos)
    known = judged.join(copies.select("copy", F.lit(20.0).alias("copied")), "copy", "left")
    # That a text was copied says nothing about the rest of its directory: it joins in at the end.
    known = known.withColumn("copied", F.when(F.col("lines") >= copy_lines, F.coalesce("copied", F.lit(0.0))).otherwise(0.0)).drop("copy", "lines")
    # Messages of the files to their directories are needed on the way up and down: computed once.
    known = materialise(_send(known, [F.col(f"e{i}") for i in range(5)], "u", _FILES))

    nodes = materialise(_tree(known, name_evidence(judged)))
    deepest = nodes.agg(F.max("depth")).first()[0]
    if deepest is None:
        return known.select("repo", "path", F.lit("").alias("label"), F.lit(0.0).alias("belief"))

    levels: dict[int, DataFrame] = {}
    for d in range(deepest, -1, -1):  # up
        here = nodes.where(F.col("depth") == d)
        if d < deepest:
            sent = levels[d + 1].groupBy("repo", F.col("parent").alias("dir")).agg(*[F.sum(F.col(f"m{i}") * F.col("tied")).alias(f"m{i}") for i in range(5)])
            here = here.join(sent, ["repo", "dir"], "left").select("repo", "dir", "depth", "parent", "tied", *_named([F.col(f"b{i}") + F.coalesce(f"m{i}", F.lit(0.0)) for i in range(5)], "b"))
        levels[d] = materialise(_send(here, [F.col(f"b{i}") for i in range(5)], "m", _DIRS))
    above = levels[0].select("repo", "dir", *[f"b{i}" for i in range(5)])
    beliefs = [above]
    for d in range(1, deepest + 1):  # down
        heads = above.toDF("repo", "parent", *[f"p{i}" for i in range(5)])
        joined = levels[d].join(heads, ["repo", "parent"])
        joined = _send(joined, [F.col(f"p{i}") - F.col(f"m{i}") * F.col("tied") for i in range(5)], "g", _DIRS.T)
        above = materialise(joined.select("repo", "dir", *_named([F.col(f"b{i}") + F.col(f"g{i}") for i in range(5)], "b")))
        beliefs.append(above)
    whole = beliefs[0]
    for level in beliefs[1:]:
        whole = whole.unionByName(level)
    heads = whole.toDF("repo", "dir", *[f"p{i}" for i in range(5)])
    joined = known.join(heads, ["repo", "dir"])
    joined = _send(joined, [F.col(f"p{i}") - F.col(f"u{i}") for i in range(5)], "g", _FILES.T)
    final = joined.select("repo", "path", *_named([F.col(f"e{i}") + F.col(f"g{i}") + (F.col("copied") if i == 3 else F.lit(0.0)) for i in range(5)], "f"))
    best = F.greatest(*[F.struct(F.col(f"f{i}").alias("v"), F.lit(-i).alias("o"), F.lit(name).alias("label")) for i, name in enumerate(LABELS)])
    share = 1 / sum(F.exp(F.col(f"f{i}") - F.col("best.v")) for i in range(5))
    labelled = materialise(final.withColumn("best", best).select("repo", "path", F.col("best.label").alias("label"), share.alias("belief")))
    discard(judged, known, nodes, *levels.values(), *beliefs[1:])
    return labelled


def _prefixes(path: str) -> Column:
    """The directories above and at `path`; the top is ''."""
    parts = F.split(path, "/")
    inner = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.when(F.col(path) == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), inner))


def _tree(known: DataFrame, names: DataFrame) -> DataFrame:
    """(repo, dir, depth, parent, tied, b0..b4): the directories that matter, with their own evidence.

    A run of directories that hold nothing but one another counts as one, so the number of levels
    follows the branching and not the length of the paths. A conventional name explains its
    directory: nothing is concluded from it about the directory above (tied 0).
    """
    own = known.groupBy("repo", "dir").agg(*[F.sum(f"u{i}").alias(f"u{i}") for i in range(5)])
    every = own.select("repo", F.explode(_prefixes("dir")).alias("dir")).distinct()
    above = F.regexp_extract("dir", "^(?:(.*)/)?[^/]*$", 1)
    forks = every.where("dir <> ''").groupBy("repo", above.alias("dir")).agg(F.count("*").alias("below"))
    last = F.lower(F.element_at(F.split("dir", "/"), -1))
    nodes = every.join(own, ["repo", "dir"], "left").join(forks, ["repo", "dir"], "left")
    nodes = nodes.withColumn("name", F.when(F.col("dir") != "", last)).join(names, "name", "left")
    nodes = nodes.where("dir = '' or u0 is not null or below > 1 or p1 is not null")
    top = F.when(F.col("dir") == "", F.lit(_ROOT)).otherwise(F.lit(0.0))
    own_b = [F.coalesce("u0", F.lit(0.0)) + top] + [F.coalesce(f"u{i}", F.lit(0.0)) + F.coalesce(f"p{i}", F.lit(0.0)) for i in range(1, 5)]
    nodes = materialise(nodes.select("repo", "dir", F.when(F.coalesce("conventional", F.lit(False)), 0.0).otherwise(1.0).alias("tied"), *_named(own_b, "b")))
    up = nodes.where("dir <> ''").select("repo", F.col("dir").alias("child"), F.explode(_prefixes("dir")).alias("dir")).where("dir <> child")
    up = up.join(nodes.select("repo", "dir"), ["repo", "dir"]).groupBy("repo", "child").agg(F.count("*").cast("int").alias("depth"), F.max_by("dir", F.length("dir")).alias("parent"))
    placed = nodes.join(up.withColumnRenamed("child", "dir"), ["repo", "dir"], "left")
    return placed.select("repo", "dir", F.coalesce("depth", F.lit(0)).alias("depth"), "parent", "tied", *[f"b{i}" for i in range(5)])


def hash_pair(text: str) -> bytes:
    """A 128-bit hash of a text."""
    import xxhash

    return xxhash.xxh3_128_digest(text)
