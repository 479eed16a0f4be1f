"""Writing results: versions of a table, daily logs, reports, exports."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def replace_table(df: DataFrame, folder: str, version: int) -> str:
    """Write `df` as a version of a table; readers take the highest version with a _SUCCESS file."""
    path = f"{folder}/v{version:08d}"
    df.write.mode("overwrite").parquet(path)
    return path


def append_daily_json(df: DataFrame, folder: str, stamp: str) -> None:
    """Append rows as JSON lines in one folder a day."""
    df.withColumn("date", F.to_date(stamp)).write.mode("append").partitionBy("date").json(folder)


def write_report(df: DataFrame, folder: str) -> None:
    """Write a report as JSON lines, as many files as it has parts."""
    df.write.mode("overwrite").json(folder)


def exported(df: DataFrame, name: str = "document") -> DataFrame:
    """Every row as one JSON document, null fields left out."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def _files(spark: SparkSession, path: str):  # noqa: ANN202
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current_version(spark: SparkSession, folder: str) -> int | None:
    """The highest complete version that `replace_table` wrote; None without one."""
    where, fs = _files(spark, folder)
    if not fs.exists(where):
        return None
    found = [s.getPath() for s in fs.listStatus(where)]
    numbers = [int(p.getName()[1:]) for p in found if p.getName().startswith("v") and p.getName()[1:].isdigit() and fs.exists(_files(spark, f"{p}/_SUCCESS")[0])]
    return max(numbers, default=None)


def read_current(spark: SparkSession, folder: str) -> DataFrame:
    """The table of the highest complete version."""
    version = current_version(spark, folder)
    if version is None:
        raise FileNotFoundError(f"no complete version in {folder}")
    return spark.read.parquet(f"{folder}/v{version:08d}")


def drop_versions(spark: SparkSession, folder: str, keep: int = 1) -> int:
    """Remove all versions but the `keep` highest; the number removed."""
    where, fs = _files(spark, folder)
    found = sorted(str(s.getPath()) for s in fs.listStatus(where) if s.getPath().getName()[1:].isdigit())
    for path in found[: max(0, len(found) - keep)]:
        fs.delete(_files(spark, path)[0], True)
    return max(0, len(found) - keep)


def migrate(spark: SparkSession, folder: str, steps: Sequence[tuple[int, str, Callable[[DataFrame], DataFrame]]]) -> int:
    """Bring a versioned table to the last of `steps` (version, name, change); the version reached.

    Each step writes a version of its own, and a log names it with a checksum of its number and name.
    A step whose checksum differs from the logged one is an error; a step that fails leaves the version
    before it in place and its own half-written one without a mark of success.
    """
    log = f"{folder}/_migrations"
    where, fs = _files(spark, log)
    known = {r["version"]: r["checksum"] for r in spark.read.json(log).collect()} if fs.exists(where) else {}  # one row a migration
    for version, name, change in sorted(steps, key=lambda s: s[0]):
        checksum = hashlib.sha256(f"{version}:{name}".encode()).hexdigest()
        if version in known:
            if known[version] != checksum:
                raise ValueError(f"migration {version} is not the one that ran")
            continue
        replace_table(change(read_current(spark, folder)), folder, version)
        spark.createDataFrame([(version, name, checksum)], "version long, name string, checksum string").coalesce(1).write.mode("append").json(log)
    return current_version(spark, folder)


def roll_back(spark: SparkSession, folder: str, version: int) -> int:
    """Take out all versions above `version` with their log; the version that is current then."""
    where, fs = _files(spark, folder)
    for status in fs.listStatus(where):
        name = status.getPath().getName()
        if name.startswith("v") and name[1:].isdigit() and int(name[1:]) > version:
            fs.delete(status.getPath(), True)
    log = f"{folder}/_migrations"
    at, _ = _files(spark, log)
    if fs.exists(at):
        kept = [tuple(r) for r in spark.read.json(log).select("version", "name", "checksum").where(F.col("version") <= version).collect()]
        spark.createDataFrame(kept, "version long, name string, checksum string").coalesce(1).write.mode("overwrite").json(log)
    return current_version(spark, folder)


def commit_together(spark: SparkSession, tables: Sequence[tuple[DataFrame, str]]) -> str:
    """Write several tables so that readers see all of them or none: staged first, then moved one by one.

    Each target gets a folder named by the commit, and a marker in the first target makes it valid;
    what fails before the marker is taken back. The commit's name is returned, `committed` lists them.
    """
    commit = uuid.uuid4().hex
    moved: list[str] = []
    try:
        for df, folder in tables:  # prepare
            df.write.parquet(f"{folder}/_staged/{commit}")
        for _, folder in tables:
            staged, fs = _files(spark, f"{folder}/_staged/{commit}")
            target, _ = _files(spark, f"{folder}/{commit}")
            if not fs.rename(staged, target):
                raise OSError(f"could not move {staged}")
            moved.append(f"{folder}/{commit}")
        marker, fs = _files(spark, f"{tables[0][1]}/_commits/{commit}")
        fs.create(marker, False).close()
    except Exception:
        for path in moved + [f"{folder}/_staged/{commit}" for _, folder in tables]:
            where, fs = _files(spark, path)
            fs.delete(where, True)
        raise
    return commit


def committed(spark: SparkSession, folder: str) -> list[str]:
    """The names of the commits whose marker stands in `folder`."""
    where, fs = _files(spark, f"{folder}/_commits")
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def as_yaml(value: object, depth: int = 0) -> str:
    """A value of dictionaries, lists and scalars as YAML; strings are quoted as in JSON, which YAML reads."""
    pad = "  " * depth
    if isinstance(value, dict) and value:
        lines = []
        for k, v in value.items():
            nested = isinstance(v, (dict, list)) and v
            lines.append(f"{pad}{json.dumps(str(k), ensure_ascii=False)}:" + ("\n" + as_yaml(v, depth + 1) if nested else " " + as_yaml(v)))
        return "\n".join(lines)
    if isinstance(value, list) and value:
        return "\n".join(f"{pad}-" + ("\n" + as_yaml(v, depth + 1) if isinstance(v, (dict, list)) and v else " " + as_yaml(v)) for v in value)
    return json.dumps(value, ensure_ascii=False)


def exported_patterns(patterns: dict[str, dict[str, str]], fmt: str = "dict", kind: str = "all", parsers: dict[str, str] | None = None) -> dict | str:
    """Patterns by format as a dictionary, JSON or YAML; `kind` keeps those of one parser ('tree_sitter', 'regex') or all.

    `parsers` names the parser of a `format.name`, 'regex' by default.
    """
    own = {f: {n: p for n, p in names.items() if kind == "all" or (parsers or {}).get(f"{f}.{n}", "regex") == kind} for f, names in patterns.items()}
    own = {f: names for f, names in own.items() if names}
    if fmt == "dict":
        return own
    if fmt == "json":
        return json.dumps(own, ensure_ascii=False, indent=2)
    if fmt == "yaml":
        return as_yaml(own)
    raise ValueError(f"unknown format {fmt}")
