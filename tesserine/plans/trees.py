"""Queries over syntax trees, blocks of texts and the pattern catalogues."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.functions import text as T
from tesserine.functions.catalogue import PATTERNS, REPEATS, Catalogue
from tesserine.operators import patterns as R
from tesserine.operators import relational as A
from tesserine.operators.upsert import latest_by_key
from tesserine.plans.registry import query
from tesserine.plans.tables import DOCS, docs, files
from tesserine.sources.tables import load

_AST = "SELECT id, ast FROM (SELECT id, ast, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, ast DESC NULLS LAST) AS r FROM code_snippets WHERE id IS NOT NULL) WHERE r = 1"
_quoted = lambda names: ", ".join(f"'{n}'" for n in names)
# The nodes of all trees: path of places from the root, and how many nesting nodes with children lie on it.
_NODES = f"""n AS (SELECT id, '' AS path, CAST(NULL AS VARCHAR) AS parent, CAST(0 AS BIGINT) AS place, 1 AS depth, ast::JSON AS node, CASE WHEN ast::JSON ->> '$.type' IN ({_quoted(R.NESTING)}) AND coalesce(json_array_length(ast::JSON, '$.children'), 0) > 0 THEN 1 ELSE 0 END AS nests
    FROM ({_AST}) WHERE ast IS NOT NULL AND json_valid(ast) AND json_type(ast) = 'OBJECT'
  UNION ALL SELECT id, path || '/' || i, path, i, depth + 1, c, nests + CASE WHEN c ->> '$.type' IN ({_quoted(R.NESTING)}) AND coalesce(json_array_length(c, '$.children'), 0) > 0 THEN 1 ELSE 0 END
    FROM (SELECT id, path, depth, nests, i, json_extract(node, '$.children[' || i || ']') AS c FROM (SELECT *, unnest(range(CAST(json_array_length(node, '$.children') AS BIGINT))) AS i FROM n WHERE json_type(node, '$.children') = 'ARRAY')) WHERE json_type(c) = 'OBJECT'),
  t AS (SELECT id, path, parent, place, depth, nests, coalesce(node ->> '$.type', '') AS type, node, CAST(coalesce(json_array_length(node, '$.children'), 0) AS BIGINT) AS children FROM n)"""


def trees(spark: SparkSession, d: str) -> DataFrame:
    own = load(spark, d, "code_snippets").where("id is not null").select("id", "ast", "updated_at")
    return latest_by_key(own, ["id"], [F.desc_nulls_last("updated_at"), F.desc_nulls_last("ast")]).select("id", "ast")


@query(f"""WITH RECURSIVE {_NODES} SELECT id, count(*) AS nodes, CAST(max(depth) AS BIGINT) AS max_depth, count(*) FILTER (ends_with(type, '_statement')) AS statements, count(*) FILTER (ends_with(type, '_expression')) AS expressions, count(*) FILTER (type IN ({_quoted(R.DECISIONS)})) AS decisions,
  count(*) FILTER (type IN ({_quoted(R.DECISIONS)})) + 1 AS cyclomatic, (count(*) FILTER (type IN ({_quoted(R.DECISIONS)})) + 1) * max(depth) / 3.0::DOUBLE AS cognitive FROM t GROUP BY id""")
def tree_statistics(spark, d):
    return R.tree_statistics(R.tree_nodes(trees(spark, d), "id", "ast"), "id")


@query(f"WITH RECURSIVE {_NODES} SELECT type, count(*) AS n FROM t GROUP BY type")
def tree_type_histogram(spark, d):
    return A.count_by(R.tree_nodes(trees(spark, d), "id", "ast"), "type")


@query(f"""WITH RECURSIVE {_NODES}, k AS (SELECT id, parent, arg_min(node ->> '$.text', place) AS name FROM t WHERE type = 'identifier' GROUP BY id, parent)
  SELECT a.id, CASE WHEN a.type IN ({_quoted(R.FUNCTIONS)}) THEN 'function' WHEN a.type IN ({_quoted(R.CLASSES)}) THEN 'class' ELSE 'import' END AS kind, a.type,
    coalesce(max(k.name), CASE WHEN a.type IN ({_quoted(R.FUNCTIONS)}) THEN a.type || '_' || coalesce(a.node ->> '$.start_point[0]', '') || '_' || coalesce(a.node ->> '$.start_point[1]', '') END) AS name,
    CAST(a.node ->> '$.start_point[0]' AS BIGINT) + 1 AS first_line, CAST(a.node ->> '$.end_point[0]' AS BIGINT) + 1 AS last_line,
    count(*) FILTER (b.type IN ({_quoted(R.DECISION_POINTS)})) AS decisions, CAST(max(b.nests) - a.nests + CASE WHEN a.type IN ({_quoted(R.NESTING)}) AND a.children > 0 THEN 1 ELSE 0 END AS BIGINT) AS nesting
  FROM t a JOIN t b ON a.id = b.id AND (a.path = b.path OR starts_with(b.path, a.path || '/')) LEFT JOIN k ON k.id = a.id AND k.parent = a.path
  WHERE a.type IN ({_quoted(R.FUNCTIONS + R.CLASSES + R.IMPORTS)}) GROUP BY a.id, a.path, a.type, a.node, a.nests, a.children""")
def ast_features(spark, d):
    return R.tree_features(trees(spark, d), "id", "ast").drop("node", "parts")


@query(f"""WITH RECURSIVE {_NODES} SELECT b.type, a.type AS parent_type, count(*) AS n, CAST(sum(coalesce(a.children - 1, 0)) AS BIGINT) AS siblings, CAST(sum(b.children) AS BIGINT) AS children FROM t b LEFT JOIN t a ON a.id = b.id AND a.path = b.parent GROUP BY b.type, a.type""")
def ast_relations(spark, d):
    own = R.node_relations(R.tree_nodes(trees(spark, d), "id", "ast"), "id")
    return own.groupBy("type", "parent_type").agg(F.count("*").alias("n"), F.sum("siblings").alias("siblings"), F.sum("children").alias("children"))


@query(f"""WITH RECURSIVE {_NODES} SELECT category, count(*) AS n FROM (SELECT CASE WHEN type IN ('comment', 'docstring', 'javadoc') THEN 'documentation' WHEN type IN ('import', 'include', 'namespace', 'module') THEN 'dependencies' WHEN type IN ('function', 'class', 'method', 'constructor') THEN 'syntax'
  WHEN type IN ('type', 'variable', 'parameter') THEN 'semantics' WHEN type IN ('error', 'warning', 'issue') THEN 'common_issues' WHEN type IN ('pattern', 'style', 'convention') THEN 'user_patterns' ELSE 'code_patterns' END AS category FROM t) GROUP BY category""")
def node_categories(spark, d):
    return A.count_by(R.tree_nodes(trees(spark, d), "id", "ast").select(T.node_category(F.col("type")).alias("category")), "category")


# Expressions that mean the same to both engines: without look-around, back-references and classes that depend on Unicode.
PLAIN = {f"{fmt}.{name}": p for fmt, own in PATTERNS.items() for name, p in own.items() if p not in REPEATS and not re.search(r"\(\?[=!<]|\\[1-9wWbB]", p)}


def _counts_sql(table: str, key: str, text: str, patterns: dict[str, str]) -> str:
    parts = []
    for name, p in patterns.items():
        flags, body = ("(?ms)", p[4:]) if p.startswith("(?s)") else ("(?m)", p)
        own = "'" + (flags + body).replace("'", "''") + "'"
        parts.append(f"SELECT {key}, '{name}' AS pattern, len(regexp_extract_all({text}, {own})) AS n FROM {table} WHERE regexp_matches({text}, {own})")
    return " UNION ALL ".join(parts)


@query(_counts_sql(f"({DOCS})", "id", "content", PLAIN))
def plain_catalogues(spark, d):
    return R.pattern_counts(docs(spark, d), ["id"], "content", PLAIN)


@query(f"SELECT category, pattern, count(*) AS texts, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN pattern IN ('todo_comment', 'fixme_comment', 'line_comment', 'comment_block', 'docstring') THEN 'documentation' ELSE 'dependencies' END AS category, pattern, n FROM ({_counts_sql(f'({DOCS})', 'id', 'content', {k: PATTERNS['common'][k] for k in ('line_comment', 'todo_comment', 'fixme_comment', 'comment_block', 'docstring', 'package_declaration', 'version_specification')})})) GROUP BY category, pattern")
def catalogue_by_category(spark, d):
    known = Catalogue()
    own = {**known.find("common", "documentation"), **known.find("common", "dependencies")}
    own = {name.partition(".")[2]: p for name, p in own.items() if name != "common.dependency_declaration"}
    found = R.pattern_counts(docs(spark, d), ["id"], "content", own).groupBy("pattern").agg(F.count("*").alias("texts"), F.sum("n").alias("n"))
    names = known.table(spark).where("format = 'common'").select(F.col("name").alias("pattern"), "category")
    return found.join(F.broadcast(names), "pattern").select("category", "pattern", "texts", "n")


_BLOCK = {"inline_code": r"`([^`\n]+)`", "link": r"\[([^\]\n]+)\]\(([^)\n]+)\)"}


@query(" UNION ALL ".join(f"SELECT id, '{n}' AS block_type, unnest(regexp_extract_all(content, '{p}')) AS content, true AS valid FROM ({DOCS}) WHERE content IS NOT NULL" for n, p in _BLOCK.items()))
def text_blocks(spark, d):
    return R.block_spans(docs(spark, d), "id", "content", _BLOCK).select("id", "block_type", "content", (F.size("errors") == 0).alias("valid"))


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE length(text) > 0), w AS (SELECT doc_id, s AS size, unnest(range(0, CAST(len(l) - s + 1 AS BIGINT), s // 2)) AS first, l FROM l, (SELECT unnest([5, 10, 20]) AS s) WHERE len(l) >= s),
  m AS (SELECT doc_id, CAST(size AS BIGINT) AS size, first, len(regexp_extract_all(array_to_string(l[first + 1:first + size], chr(10)), '[A-Z]{4,}')) AS n FROM w) SELECT doc_id, size, first, n FROM m WHERE n > 0 AND size = (SELECT min(size) FROM m x WHERE x.doc_id = m.doc_id AND x.n > 0)""")
def widening_windows(spark, d):
    return R.widening_windows(load(spark, d, "documents"), ["doc_id"], "text", "[A-Z]{4,}")


@query("""WITH c AS (SELECT doc_id, text, len(regexp_extract_all(text, 'ZZZ-[0-9]+')) AS a, len(regexp_extract_all(text, '(?m)^# [A-Z]')) AS b, len(regexp_extract_all(text, '[A-Z]{4,}')) AS r FROM documents WHERE text IS NOT NULL)
  SELECT doc_id, CASE WHEN a > 0 THEN 'fallback_patterns:0' WHEN b > 0 THEN 'fallback_patterns:1' ELSE 'regex_fallback' END AS strategy, CASE WHEN a > 0 THEN a WHEN b > 0 THEN b ELSE r END AS n FROM c WHERE a > 0 OR b > 0 OR r > 0""")
def recovered_matches(spark, d):
    return R.recovered_matches(load(spark, d, "documents"), ["doc_id"], "text", ["ZZZ-[0-9]+", "^# [A-Z]"], "[A-Z]{4,}")


@query("""WITH c AS (SELECT doc_id, i, substr(text, CAST(i * 1000 + 1 AS BIGINT), 1000) AS t FROM (SELECT doc_id, text, unnest(range(0, (length(text) - 1) // 1000 + 1)) AS i FROM documents WHERE length(text) > 0)) SELECT doc_id, i * 1000 + instr(t, '# ') - 1 AS first, i * 1000 + instr(t, '# ') + 1 AS last FROM c WHERE contains(t, '# ')""")
def chunked_matches(spark, d):
    found = R.chunked_matches(load(spark, d, "documents"), "doc_id", "text", {"heading": "# "}, size=1000)
    # The first match of every cut.
    return found.groupBy("doc_id", F.floor(F.col("first") / 1000).alias("cut")).agg(F.min("first").cast("long").alias("first"), F.min("last").cast("long").alias("last")).drop("cut")


@query(f"""SELECT id, language FROM (SELECT id, CASE WHEN contains(content, '[source,python]') THEN 'python' WHEN contains(content, '[source,java]') THEN 'java' WHEN contains(content, '[source,javascript]') THEN 'javascript' ELSE 'unknown' END AS language FROM ({DOCS}) WHERE content IS NOT NULL)""")
def embedded_languages(spark, d):
    return docs(spark, d).where("content is not null").select("id", T.embedded_language(F.col("content")).alias("language"))


_MARKED = {"todo": r"TODO:?\s*(.*)$", "fixme": r"FIXME:?\s*(.*)$", "note": r"NOTE:?\s*(.*)$", "warning": r"WARNING:?\s*(.*)$"}


@query(" UNION ALL ".join(f"SELECT repo_id, file_path, '{n}' AS kind, count(*) AS n FROM (SELECT DISTINCT repo_id, file_path, file_content, language, parser_type, unnest(range(len(regexp_extract_all(file_content, '(?m){p}')))) AS i FROM code_files WHERE file_content IS NOT NULL) GROUP BY repo_id, file_path" for n, p in _MARKED.items()))
def marked_comments(spark, d):
    one = files(spark, d).where("file_content is not null").select("repo_id", "file_path", "file_content")
    return R.pattern_counts(one, ["repo_id", "file_path"], "file_content", _MARKED).groupBy("repo_id", "file_path", F.col("pattern").alias("kind")).agg(F.sum("n").alias("n"))
