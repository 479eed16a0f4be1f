"""Source trees as DataFrames: listing, ignoring, decoding, classifying."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.functions.text import extension, is_ignored, kind_of, language_of

MAX_BYTES = 1_048_576
CODE_ENDINGS = ["py", "js", "jsx", "ts", "tsx", "java", "cpp", "c", "h", "cs", "go", "rb", "php", "rs", "swift", "kt", "sql", "sh"]
DOC_ENDINGS = ["md", "rst", "txt", "adoc", "html"]


def list_files(spark: SparkSession, root: str, wanted: list[str] | None = None) -> DataFrame:
    """(path, length, modified, content) below `root`, without ignored parts, of the wanted endings."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.regexp_replace("path", "^[a-z]+:/*", "/")
    rel = F.when(rel.startswith(root.rstrip("/") + "/"), F.substring(rel, len(root.rstrip("/")) + 2, 100000)).otherwise(rel)
    files = files.select(rel.alias("path"), "length", F.col("modificationTime").alias("modified"), "content")
    return files.where(~is_ignored(F.col("path")) & extension(F.col("path")).isin(wanted or CODE_ENDINGS + DOC_ENDINGS))


def decoded(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Files with `text`: UTF-8 where valid, else Latin-1; null beyond `max_bytes`."""
    text = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.decode("content", "ISO-8859-1"))
    return files.withColumn("text", F.when(F.col("length") <= max_bytes, text)).drop("content")


def classified(files: DataFrame, path: str = "path") -> DataFrame:
    """Files with language and kind by their ending."""
    return files.withColumns({"language": language_of(F.col(path)), "kind": kind_of(F.col(path))})


def of_language(files: DataFrame, language: str, limit: int = 100, path: str = "path") -> DataFrame:
    """The first `limit` paths of a language, in path order."""
    return files.where(language_of(F.col(path)) == language).orderBy(path).limit(limit)


# What the head of a text tells about its language.
_HEADS = [("^#!.*\\bpython", "python"), ("^#!.*\\b(?:node|deno)", "javascript"), ("^#!.*\\bruby", "ruby"), ("^#!.*\\b(?:ba|z)?sh\\b", "bash"), ("^#!.*\\bphp|^<\\?php", "php"), ("(?i)^\\s*<!doctype html|^\\s*<html", "html")]


def classified_content(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Files with language, kind, encoding and is_binary: by the ending of the path, else by the head of the text.

    A text with a NUL is binary. The encoding is the one that the text declares, else utf-8; null for a
    null text.
    """
    by_head = F.lit("unknown")
    for pattern, language in reversed(_HEADS):
        by_head = F.when(F.col(text).rlike(pattern), language).otherwise(by_head)
    by_path = language_of(F.col(path))
    declared = F.lower(F.regexp_extract(F.substring(F.col(text), 1, 400), "(?:coding[:=]|encoding=|charset=)\\s*[\"']?([A-Za-z0-9_.-]+)", 1))
    return files.withColumns({
        "language": F.when((by_path == "unknown") & F.col(text).isNotNull(), by_head).otherwise(by_path), "kind": kind_of(F.col(path)),
        "encoding": F.when(F.col(text).isNotNull(), F.coalesce(F.nullif(declared, F.lit("")), F.lit("utf-8"))), "is_binary": F.coalesce(F.contains(F.col(text), F.lit("\0")), F.lit(False)),
    })


def relative_path(path: Column, base: str = "") -> Column:
    """A path below `base` with forward slashes and without a leading ./; a path elsewhere stays whole."""
    clean = F.regexp_replace(F.regexp_replace(F.translate(path, "\\", "/"), "^(\\./)+", ""), "/+", "/")
    root = base.rstrip("/") + "/"
    return F.when(clean.startswith(root), F.substring(clean, len(root) + 1, 1_000_000)).otherwise(clean) if base else clean
