"""Queries over whole tables that need more than SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserine.operators.nested import flatten_records
from tesserine.plans import graphs, reference, registry, rules, trees, usage  # noqa: F401
from tesserine.session import ship_package
from tesserine.sources.tables import load

# Keys of the records that always hold lists.
LIST_KEYS = ["functions", "classes", "methods", "params", "calls", "imports", "docstrings", "comments", "todos", "authors", "sections", "anchors", "links", "checks", "findings", "history"]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    snippets, _ = flatten_records(load(spark, sf_dir, "code_snippets"), "id", {"enriched_features": "code_snippets.enriched_features"}, LIST_KEYS, "updated_at")
    docs, _ = flatten_records(load(spark, sf_dir, "repo_docs"), "id", {"metadata": "repo_docs.metadata", "quality_metrics": "repo_docs.quality_metrics"}, LIST_KEYS, "updated_at")
    return snippets.unionByName(docs).where("repeated").select("src_field", "record_id", "child_path", "parent_path")


def queries() -> dict:
    return {"p2_found": p2_found} | registry.QUERIES


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
