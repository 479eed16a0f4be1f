"""Tables as the queries read them, with the SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.operators import upsert as K
from tesserine.sources.tables import load

# Docs with their latest version, and one row per doc and repository.
DOCS = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, version DESC NULLS LAST) AS rn FROM repo_docs) WHERE rn = 1"


def docs(spark: SparkSession, d: str) -> DataFrame:
    return K.latest_by_key(load(spark, d, "repo_docs"), ["id"], [F.desc_nulls_last("updated_at"), F.desc_nulls_last("version")])


def relations(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "repo_doc_relations").select("repo_id", "doc_id").distinct()


def files(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "code_files").select("repo_id", "file_path", "file_content", "language", "parser_type").distinct()


def part_edges(spark: SparkSession, d: str) -> DataFrame:
    """Directed edges from a part to the next part of the same order."""
    lines = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    after = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("dst"))
    return lines.join(after, ["l_orderkey", "l_linenumber"]).select(F.col("l_partkey").alias("src"), "dst")


EDGES = "SELECT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1"
