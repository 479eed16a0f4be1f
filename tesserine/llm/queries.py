"""Queries of this subpackage, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.session import ship_package
from tesserine.sources.tables import load


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserine.llm.neighbours import most_similar

    ship_package(spark)
    found = None
    for table in ("code_snippets", "repo_docs"):
        near = most_similar(load(spark, sf_dir, table), "id", "embedding", k=10, min_similarity=0.85)
        pairs = near.select(F.lit(table).alias("vec_table"), F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
        found = pairs if found is None else found.unionByName(pairs)
    return found


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserine.llm.near_duplicates import near_duplicate_classes, near_duplicate_pairs
    from tesserine.llm.words import tree_text

    ship_package(spark)
    found = None
    for table, field, to_text in (("code_snippets", "ast", tree_text), ("repo_docs", "content", str)):
        links, members = near_duplicate_classes(load(spark, sf_dir, table), "id", field, to_text, threshold=0.6, shingle_words=3, min_words=20)
        pairs = near_duplicate_pairs(links, members).select(F.lit(f"{table}.{field}").alias("src_field"), "id_a", "id_b")
        found = pairs if found is None else found.unionByName(pairs)
    return found


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per doc of repo_docs: its class, links and group, at the usual five words and 0.8."""
    from tesserine.llm.near_duplicates import near_duplicate_classes, near_duplicate_groups

    ship_package(spark)
    links, members = near_duplicate_classes(load(spark, sf_dir, "repo_docs"), "id", "content", str, min_words=20, bands=28, compared=112)
    return near_duplicate_groups(links, members)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserine.llm.origins import label_files

    ship_package(spark)
    # A path indexed again is one file; its content may be missing.
    files = load(spark, sf_dir, "code_snippets").select("repo_id", "file_path").distinct()
    contents = load(spark, sf_dir, "code_files").select("repo_id", "file_path", "file_content")
    labels = label_files(files.join(contents, ["repo_id", "file_path"], "left"), "repo_id", "file_path", "file_content")
    return labels.where("label <> 'handwritten'").select(F.col("repo").alias("repo_id"), F.col("path").alias("file_path"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserine.llm.clusters import similarity_clusters

    ship_package(spark)
    found = similarity_clusters(load(spark, sf_dir, "repo_docs"), "id", "embedding", threshold=0.9, min_size=3)
    return found.select(F.col("id").alias("doc_id"), "cluster_head", "typical_id")


def p5_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per cluster: size, most typical member, and the member of its densest cell."""
    from tesserine.llm.clusters import similarity_clusters

    ship_package(spark)
    found = similarity_clusters(load(spark, sf_dir, "repo_docs"), "id", "embedding", threshold=0.9, min_size=3, describe=True)
    return found.select("cluster_head", "cluster_size", "typical_id", "densest_id", "densest_rows").distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserine.llm.documented import function_pairs

    ship_package(spark)
    docs = load(spark, sf_dir, "repo_docs").where(F.lower(F.trim("doc_type")).isin("docstring", "inline"))
    pairs = function_pairs(docs, "id", "content", "related_code_path")
    return pairs.select(F.col("id").alias("doc_id"), "func_name").distinct()


def p7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserine.llm.packing import pack_texts

    ship_package(spark)
    return pack_texts(load(spark, sf_dir, "documents"), "doc_id", "text", capacity=2048).withColumnRenamed("id", "doc_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserine.llm.leaks import leaked_items

    ship_package(spark)
    docs, items = load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items")
    found = leaked_items(docs, "doc_id", "text", items, "item_id", "text", window=12, max_edits=1, in_proportion=True)
    return found.where("edits = 0").select("doc_id", "item_id")  # the cases are passages that stand as they are


def p8_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks with an edited word in a passage, beside the equal ones of `p8_found`."""
    from tesserine.llm.leaks import leaked_items

    ship_package(spark)
    docs, items = load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items")
    return leaked_items(docs, "doc_id", "text", items, "item_id", "text", window=12, max_edits=1, in_proportion=True).where("edits > 0").select("doc_id", "item_id", "edits")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserine.llm.reading import reading_levels

    ship_package(spark)
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "reading_labels")
    return reading_levels(docs, "doc_id", "text", "source", labels).withColumnRenamed("id", "doc_id")


def p9_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserine.llm.reading import reading_agreement

    ship_package(spark)
    return reading_agreement(load(spark, sf_dir, "documents"), "doc_id", "text", "source", load(spark, sf_dir, "reading_labels"))


def queries() -> dict:
    return {"p1_found": p1_found, "p3_found": p3_found, "p3_groups": p3_groups, "p4_found": p4_found, "p5_found": p5_found, "p5_clusters": p5_clusters, "p6_found": p6_found, "p7_packing": p7_packing, "p8_found": p8_found, "p8_edited": p8_edited, "p9_found": p9_found, "p9_agreement": p9_agreement}


def oracle_sql() -> dict[str, str]:
    return {}
