"""Queries of upserts, rewrites of patterns, line machines, captures and extension points."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserine.functions import text as T
from tesserine.operators import extensions as E
from tesserine.operators import graph as G
from tesserine.operators import learning as L
from tesserine.operators import patterns as R
from tesserine.operators import relational as A
from tesserine.operators import upsert as K
from tesserine.operators.tree_queries import tree_captures
from tesserine.plans.registry import query
from tesserine.plans.tables import DOCS, docs
from tesserine.plans.trees import _NODES, trees
from tesserine.sources.files import classified_content, relative_path
from tesserine.sources.tables import load
from tesserine.streaming.changes import unexpired

# ---------------------------------------------------------------- sources and upserts

_FILES = "(SELECT DISTINCT repo_id, file_path, file_content FROM code_files)"


@query(f"""SELECT repo_id, file_path, CASE WHEN p <> 'unknown' OR file_content IS NULL THEN p WHEN regexp_matches(file_content, '^#![^\\n]*\\bpython') THEN 'python' WHEN regexp_matches(file_content, '^#![^\\n]*\\b(node|deno)') THEN 'javascript' WHEN regexp_matches(file_content, '^#![^\\n]*\\bruby') THEN 'ruby' WHEN regexp_matches(file_content, '^#![^\\n]*\\b(ba|z)?sh\\b') THEN 'bash'
    WHEN regexp_matches(file_content, '^#![^\\n]*\\bphp|^<\\?php') THEN 'php' WHEN regexp_matches(file_content, '(?i)^\\s*<!doctype html|^\\s*<html') THEN 'html' ELSE 'unknown' END AS language,
  CASE WHEN file_content IS NULL THEN NULL ELSE coalesce(nullif(lower(regexp_extract(left(file_content, 400), '(?:coding[:=]|encoding=|charset=)\\s*["'']?([A-Za-z0-9_.-]+)', 1)), ''), 'utf-8') END AS encoding, coalesce(contains(file_content, chr(0)), false) AS is_binary
  FROM (SELECT *, CASE WHEN e = 'py' THEN 'python' WHEN e IN ('js', 'jsx') THEN 'javascript' WHEN e IN ('ts', 'tsx') THEN 'typescript' WHEN e IN ('c', 'h') THEN 'c' WHEN e IN ('cpp', 'hpp') THEN 'cpp' WHEN e = 'cs' THEN 'c_sharp' WHEN e = 'rb' THEN 'ruby' WHEN e = 'rs' THEN 'rust' WHEN e = 'kt' THEN 'kotlin' WHEN e IN ('java', 'go', 'php', 'html', 'css', 'swift') THEN e ELSE 'unknown' END AS p
    FROM (SELECT *, lower(regexp_extract(regexp_extract(replace(file_path, '\\', '/'), '([^/]*)$', 1), '[^.].*\\.([^.]*)$', 1)) AS e FROM {_FILES}))""")
def classified_files(spark, d):
    one = load(spark, d, "code_files").select("repo_id", "file_path", "file_content").distinct()
    return classified_content(one, "file_path", "file_content").select("repo_id", "file_path", "language", "encoding", "is_binary")


@query("""SELECT DISTINCT repo_id, regexp_replace(regexp_replace(replace(file_path, '\\', '/'), '^(\\./)+', ''), '/+', '/', 'g') AS path FROM code_files""")
def relative_paths(spark, d):
    return load(spark, d, "code_files").select("repo_id", relative_path(F.col("file_path")).alias("path")).distinct()


@query("""SELECT lang, doc_kind, source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY lang, doc_kind, source ORDER BY crawled_at DESC NULLS LAST, doc_id DESC) AS r FROM documents) WHERE r = 1""")
def pattern_upsert(spark, d):
    own = load(spark, d, "documents").select("lang", "doc_kind", "source", "doc_id", "crawled_at")
    order = [F.desc_nulls_last("crawled_at"), F.desc("doc_id")]
    return K.latest_by_key(own, ["lang", "doc_kind", "source"], order).select("lang", "doc_kind", "source", "doc_id")


@query("""SELECT user_id, max_by(value, (ts, event_id)) AS score FROM events WHERE value IS NOT NULL GROUP BY user_id""")
def metrics_replace(spark, d):
    own = load(spark, d, "events").where("value is not null").select("user_id", F.col("value").alias("score"), F.struct("ts", "event_id").alias("at"))
    first, later = own.where("event_id % 2 = 0"), own.where("event_id % 2 = 1")
    latest = lambda df: K.latest_by_key(df, ["user_id"], [F.desc("at")])
    both = latest(first).unionByName(latest(later))
    return latest(both).select("user_id", "score")


@query("""SELECT p_partkey || '_insight_' || (i - 1) AS node, p_partkey AS owner, w AS value FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS i FROM part)""")
def insight_nodes(spark, d):
    own = load(spark, d, "part").select(F.col("p_partkey").alias("owner"), F.posexplode(F.split("p_name", " ")).alias("i", "value"))
    return own.select(F.concat(F.col("owner").cast("string"), F.lit("_insight_"), F.col("i").cast("string")).alias("node"), "owner", "value")


@query("SELECT repo_id, file_path, count(*) AS n FROM code_snippets GROUP BY repo_id, file_path HAVING count(*) > 1 OR repo_id IS NULL OR file_path IS NULL")
def duplicate_keys(spark, d):
    return K.violations(load(spark, d, "code_snippets").select("repo_id", "file_path"), ["repo_id", "file_path"])


@query("SELECT l_suppkey AS src, l_partkey AS dst, count(*) AS n FROM (SELECT l_suppkey, l_partkey FROM lineitem UNION ALL SELECT l_suppkey, l_partkey FROM lineitem WHERE l_linenumber = 1) GROUP BY l_suppkey, l_partkey")
def created_edges(spark, d):
    own = load(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), "l_linenumber")
    return A.count_by(K.created(own.drop("l_linenumber"), own.where("l_linenumber = 1").drop("l_linenumber")), "src", "dst")


@query("""SELECT n_nationkey, coalesce(string_agg(s_suppkey || ':' || s_name, '|' ORDER BY s_suppkey), '') AS suppliers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey""")
def nested_children(spark, d):
    own = K.with_nested(load(spark, d, "nation").select("n_nationkey"), "n_nationkey", load(spark, d, "supplier").select("s_nationkey", "s_suppkey", "s_name"), "s_nationkey", "rows", ["s_suppkey"])
    return own.select("n_nationkey", F.array_join(F.transform("rows", lambda r: F.concat_ws(":", r["s_suppkey"].cast("string"), r["s_name"])), "|").alias("suppliers"))


@query(f"""SELECT r.id AS repo_id, coalesce(string_agg(DISTINCT CAST(d.id AS VARCHAR), '|' ORDER BY CAST(d.id AS VARCHAR)), '') AS docs, coalesce(string_agg(DISTINCT f.file_path, '|' ORDER BY f.file_path), '') AS files FROM (SELECT DISTINCT id FROM repositories) r
  LEFT JOIN repo_doc_relations x ON x.repo_id = r.id LEFT JOIN ({DOCS}) d ON d.id = x.doc_id LEFT JOIN code_files f ON f.repo_id = r.id AND f.file_path = d.related_code_path GROUP BY r.id""")
def pattern_chain(spark, d):
    repos = load(spark, d, "repositories").select(F.col("id").alias("repo_id")).distinct()
    chained = repos.join(load(spark, d, "repo_doc_relations").select("repo_id", "doc_id").distinct(), "repo_id", "left")
    chained = chained.join(docs(spark, d).select(F.col("id").alias("doc_id"), F.col("related_code_path").alias("file_path"), F.col("id").cast("string").alias("doc")), "doc_id", "left")
    code = load(spark, d, "code_files").select("repo_id", "file_path", F.col("file_path").alias("file")).distinct()
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "|")
    return chained.join(code, ["repo_id", "file_path"], "left").groupBy("repo_id").agg(listed("doc").alias("docs"), listed("file").alias("files"))


def _versions(spark, d):
    """Docs delivered with two contents or more: the last one beside the one before it."""
    own = load(spark, d, "repo_docs").where("id is not null and content is not null").groupBy("id", "content").agg(F.max(F.struct("updated_at", "version")).alias("at"))
    order = [F.desc("at"), F.desc("content")]
    two = A.top_per_key(own, ["id"], order, 2)
    return two.groupBy("id").agg(F.max(F.when(F.col("place") == 2, F.col("content"))).alias("old"), F.max(F.when(F.col("place") == 1, F.col("content"))).alias("new")).where("old is not null")


@query()
def doc_changes(spark, d):
    own = _versions(spark, d)
    edits = R.edit_script(own, "id", "old", "new").groupBy("id").agg(F.count("*").alias("edits"))
    return own.select("id", F.round(R.change_ratio(F.col("old"), F.col("new")), 9).alias("ratio")).join(edits, "id", "left").select("id", "ratio", F.coalesce("edits", F.lit(0)).alias("edits"))


# ---------------------------------------------------------------- health and scores


@query("""SELECT user_id, CASE WHEN ok < 0.8 THEN 'degraded' WHEN slow > 26 THEN 'degraded' ELSE 'healthy' END AS status FROM (SELECT user_id, CAST(count(*) FILTER (event_type <> 'error') AS DOUBLE) / count(*) AS ok, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(value) AS slow FROM events GROUP BY user_id)""")
def component_health(spark, d):
    own = load(spark, d, "events").groupBy("user_id").agg((F.count_if(F.col("event_type") != "error") / F.count("*")).alias("ok"), (F.sum(F.col("value").cast("decimal(18,2)")).cast("double") / F.count("value")).alias("slow"))
    return own.select("user_id", T.component_health(F.col("ok"), F.col("slow"), slow=26.0).alias("status"))


@query("""WITH p AS (SELECT event_id, ts, event_type || ':' || CAST(isodow(ts) AS VARCHAR) AS pattern FROM events WHERE event_type IN ('error', 'purchase')) SELECT pattern, n, last FROM (SELECT pattern, count(*) AS n FROM p GROUP BY pattern) JOIN (SELECT pattern AS q, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts DESC, event_id DESC) AS last FROM (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY ts DESC, event_id DESC) AS r FROM p) WHERE r <= 10 GROUP BY pattern) ON q = pattern""")
def deadlock_patterns(spark, d):
    own = load(spark, d, "events").where("event_type in ('error', 'purchase')").select("event_id", "ts", F.concat_ws(":", "event_type", (F.weekday("ts") + 1).cast("string")).alias("pattern"))
    last = A.top_per_key(own, ["pattern"], [F.desc("ts"), F.desc("event_id")], 10).groupBy("pattern").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.col("event_id").cast("string").alias("e")))), lambda x: x["e"]), ",").alias("last"))
    return A.count_by(own, "pattern").join(last, "pattern")


@query(f"""SELECT id, 'empty' AS kind, CAST(NULL AS VARCHAR) AS path FROM ({DOCS}) WHERE coalesce(length(content), 0) < 50 UNION ALL SELECT id, 'unlinked', related_code_path FROM ({DOCS}) WHERE related_code_path IS NOT NULL AND related_code_path NOT IN (SELECT file_path FROM code_files WHERE file_path IS NOT NULL)""")
def recommendations_union(spark, d):
    own = docs(spark, d)
    empty = own.where(F.coalesce(F.length("content"), F.lit(0)) < 50).select("id", F.lit("empty").alias("kind"))
    known = load(spark, d, "code_files").select(F.col("file_path").alias("path"))
    unlinked = A.missing(own.where("related_code_path is not null").select("id", F.lit("unlinked").alias("kind"), F.col("related_code_path").alias("path")), known, ["path"])
    return K.created(unlinked, empty)


_LANGS = ["python", "javascript", "typescript", "java", "go", "rust", "ruby", "c", "cpp", "c_sharp", "php", "html", "css", "json", "yaml", "sql"]


@query(f"""SELECT language, CASE WHEN language IN ('ini', 'plaintext', 'editorconfig', 'asciidoc', 'cobalt', 'env', 'graphql', 'nim', 'ocaml') THEN 'custom' WHEN language IN ({", ".join(f"'{x}'" for x in _LANGS)}) THEN 'tree_sitter' ELSE 'unknown' END AS parser, count(*) AS n FROM (SELECT replace(replace(lower(language), '-', '_'), ' ', '_') AS language FROM code_files) GROUP BY language""")
def normalised_languages(spark, d):
    own = A.count_by(load(spark, d, "code_files").select(T.normalised_language(F.col("language")).alias("language")), "language")
    return own.select("language", T.parser_of(F.col("language")).alias("parser"), "n")


_PART_PATTERN = "'(' || p_name || ') @' || p_brand || ' [' || p_type || ']*|?'"


@query(f"""SELECT p_partkey, CAST(floor(0.1 * length(p) + 2 * (length(p) - length(replace(p, '@', ''))) + 5 * (length(p) - length(replace(p, '|', ''))) + 3 * (length(p) - length(replace(p, '*', ''))) + 2 * (length(p) - length(replace(p, '?', ''))) + 0.5 * (length(p) - length(replace(p, '(', '')))) AS BIGINT) AS complexity,
  length(p) + (length(p) - length(replace(p, '(', ''))) + (length(p) - length(replace(p, '[', ''))) + (length(p) - length(replace(p, '|', ''))) AS score FROM (SELECT p_partkey, {_PART_PATTERN} AS p FROM part)""")
def pattern_scores(spark, d):
    p = F.concat(F.lit("("), "p_name", F.lit(") @"), "p_brand", F.lit(" ["), "p_type", F.lit("]*|?"))
    return load(spark, d, "part").select("p_partkey", T.pattern_complexity(p).alias("complexity"), L.variation_score(p).alias("score"))


@query("SELECT p_brand, '(?:' || string_agg(DISTINCT p_type, '|' ORDER BY p_type) || ')' AS merged FROM part GROUP BY p_brand")
def merged_patterns(spark, d):
    return L.merged_pattern(load(spark, d, "part"), "p_brand", "p_type")


@query(f"""WITH RECURSIVE {_NODES} SELECT id, round(CASE WHEN a = 0 OR b = 0 THEN 0 ELSE (a + b) * log2(greatest(2, (a + b) // 2)) END, 9) AS effort, round(171 - 5.2 * (cyclomatic / 10.0) - 0.23 * cyclomatic - 16.2 * (nodes / 1000.0), 9) AS maintainability FROM (SELECT id, count(*) FILTER (ends_with(type, '_statement')) AS a, count(*) FILTER (type = 'assignment') AS b, count(*) AS nodes,
  count(*) FILTER (type IN ('if_statement', 'for_statement', 'while_statement', 'case_statement', 'catch_clause', 'conditional_expression')) + 1 AS cyclomatic FROM t GROUP BY id)""")
def tree_scores(spark, d):
    own = R.tree_nodes(trees(spark, d), "id", "ast").groupBy("id").agg(F.count_if(F.col("type").endswith("_statement")).alias("a"), F.count_if(F.col("type") == "assignment").alias("b"), F.count("*").alias("nodes"), (F.count_if(F.col("type").isin(R.DECISIONS)) + 1).alias("cyclomatic"))
    return own.select("id", F.round(T.halstead_estimate(F.col("a"), F.col("b")), 9).alias("effort"), F.round(T.maintainability_index(F.col("cyclomatic"), F.col("cyclomatic"), F.col("nodes")), 9).alias("maintainability"))


@query("SELECT s_suppkey, hex(encode(s_name)) AS name FROM supplier")
def encoded_names(spark, d):
    return T.encoded(load(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("name"))).select("s_suppkey", F.hex("name").alias("name"))


@query("SELECT o_orderkey, CAST(o_custkey + 1 AS VARCHAR) AS first, CAST(o_orderkey AS BIGINT) AS target FROM orders")
def share_specs(spark, d):
    spec = F.concat(F.col("o_custkey") + 1, F.lit(", "), F.col("o_custkey"), F.lit(":"), F.col("o_orderkey"))
    return load(spark, d, "orders").select("o_orderkey", T.share_spec(spec).alias("s")).select("o_orderkey", F.col("s.ids")[0].cast("string").alias("first"), F.col("s.target").alias("target"))


@query("SELECT event_id FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 86400 SECOND")
def unexpired_events(spark, d):
    own = load(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    latest = own.agg(F.max("at").alias("now"))  # one row
    return unexpired(own.join(F.broadcast(latest)), "at", 86_400, F.col("now")).select("event_id")


# ---------------------------------------------------------------- rewrites and their validation


@query("""SELECT p_partkey, CASE WHEN p_size >= 5 AND NOT regexp_matches(p_type, '[\\^$*+?]') AND length(p_type) > 3 THEN '(' || p_brand || ') ".*"' ELSE '(' || p_brand || ') "' || p_type || '"' END AS pattern, 0.55::DOUBLE AS confidence, CASE WHEN p_size >= 5 AND NOT regexp_matches(p_type, '[\\^$*+?]') AND length(p_type) > 3 THEN 'node_pattern_improvement|pattern_generalization' ELSE 'node_pattern_improvement' END AS applied FROM part""")
def improved_patterns(spark, d):
    none = F.create_map().cast("map<string,int>")
    own = load(spark, d, "part").select("p_partkey", F.concat(F.lit('(_) "'), "p_type", F.lit('"')).alias("pattern"), F.lit(0.5).alias("confidence"), F.create_map("p_brand", F.lit(1)).alias("nodes"), none.alias("captures"), none.alias("structures"), F.lit(None).cast("map<string,struct<success:int,failure:int>>").alias("predicates"), F.col("p_size").alias("matches"))
    return L.improved_patterns(own, "p_partkey").select("p_partkey", "pattern", F.round("confidence", 9).alias("confidence"), F.array_join("applied", "|").alias("applied"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN len(regexp_extract_all(p_name, '[aeiou]')) ELSE len(regexp_extract_all(p_name, 'x')) END AS matches, CASE WHEN p_size % 3 = 0 THEN len(regexp_extract_all(p_name, '[aeiou]')) = p_size WHEN p_size % 3 = 1 THEN contains(p_name, 'x') ELSE NOT contains(p_name, 'x') END AS passed FROM part""")
def validated_cases(spark, d):
    third = F.col("p_size") % 3
    cases = load(spark, d, "part").select("p_partkey", F.when(third == 0, "[aeiou]").otherwise("x").alias("pattern"), F.col("p_name").alias("input"), F.when(third == 0, F.col("p_size").cast("string")).when(third == 1, "true").otherwise("false").alias("expected"))
    return L.validated(cases).select("p_partkey", "matches", "passed")


@query("""SELECT user_id, CASE WHEN before = 0 THEN CASE WHEN after > 0 THEN 1.0 ELSE 0.0 END ELSE CAST(after - before AS DOUBLE) / before END::DOUBLE AS improvement, valid FROM (SELECT user_id, count(*) FILTER (value > 40) AS before, count(*) FILTER (value > 30) AS after, bool_and(coalesce(value, 0) >= 0) AS valid FROM events GROUP BY user_id)""")
def measured_improvements(spark, d):
    own = load(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("value") > 40).alias("before"), F.count_if(F.col("value") > 30).alias("after"), F.bool_and(F.coalesce("value", F.lit(0.0)) >= 0).alias("valid"))
    return own.select("user_id", L.improvement(F.col("before"), F.col("after")).alias("improvement"), "valid")


@query("""SELECT repo_id, language, kind, pattern, CASE kind WHEN 'naming' THEN 0.75 WHEN 'documentation' THEN 0.7 END::DOUBLE AS confidence FROM (SELECT DISTINCT repo_id, language FROM code_files WHERE language IS NOT NULL AND repo_id IS NOT NULL) JOIN (SELECT language AS l, CASE WHEN parser_type = 'custom' THEN 'documentation' ELSE 'naming' END AS kind, parser_type AS pattern FROM (SELECT DISTINCT language, parser_type FROM code_files WHERE parser_type IS NOT NULL)) ON l = language""")
def recommended_patterns(spark, d):
    own = load(spark, d, "code_files")
    patterns = own.where("parser_type is not null").select("language", F.when(F.col("parser_type") == "custom", "documentation").otherwise("naming").alias("kind"), F.col("parser_type").alias("pattern"))
    targets = own.where("language is not null and repo_id is not null").select("repo_id", "language").distinct()
    return L.recommendations(patterns, targets, ["language"]).select("repo_id", "language", "kind", "pattern", "confidence")


@query("""SELECT p_brand, count(*) FILTER (known AND c >= 0.3) AS moved, count(*) FILTER (NOT (known AND c >= 0.3)) AS skipped FROM (SELECT p_brand, p_size / 50.0 AS c, p_type IN (SELECT p_type FROM part WHERE p_size = 1) AS known FROM part) GROUP BY p_brand""")
def transferred_patterns(spark, d):
    own = load(spark, d, "part").withColumn("compatibility", F.col("p_size") / 50.0)
    return L.transferred(own, own.where("p_size = 1"), ["p_type"], "p_brand")


@query()
def pattern_variations(spark, d):
    return L.variations(load(spark, d, "part"), "p_brand", "p_name")


# ---------------------------------------------------------------- line machines


_NUMBERED = """(SELECT doc_id, l, i FROM (SELECT doc_id, unnest(l) AS l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(regexp_replace(t, '\\n$', ''), chr(10)) AS l FROM (SELECT doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM documents WHERE text IS NOT NULL) WHERE t <> '')))"""


@query(f"""WITH f AS (SELECT doc_id, i, l, regexp_matches(l, '^(```|----)') AS m, coalesce(sum(CASE WHEN regexp_matches(l, '^(```|----)') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM {_NUMBERED}) SELECT doc_id, count(*) AS lines, count(*) FILTER (b % 2 = 1 AND NOT m) AS inside FROM f GROUP BY doc_id""")
def fenced_lines(spark, d):
    return R.fenced_lines(load(spark, d, "documents"), ["doc_id"], "text").groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if("inside").alias("inside"))


@query(f"""WITH f AS (SELECT doc_id, i, l, regexp_matches(l, '^----\\s*$') AS m, coalesce(sum(CASE WHEN regexp_matches(l, '^----\\s*$') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM {_NUMBERED})
  SELECT doc_id, kind, count(*) AS n FROM (SELECT doc_id, CASE WHEN m THEN 'fence' WHEN b % 2 = 1 THEN 'code' WHEN trim(l) = '' THEN 'blank' WHEN regexp_matches(l, '^=+\\s+\\S') THEN 'header' WHEN regexp_matches(l, '^\\s*(\\*+|-|\\.+|\\d+\\.)\\s+\\S') THEN 'list' WHEN regexp_matches(l, 'link:[^\\[]+\\[') THEN 'link' WHEN regexp_matches(l, '\\*[^*]+\\*|_[^_]+_') THEN 'emphasis' ELSE 'paragraph' END AS kind FROM f) GROUP BY doc_id, kind""")
def asciidoc_lines(spark, d):
    return A.count_by(R.asciidoc_lines(load(spark, d, "documents"), ["doc_id"], "text"), "doc_id", "kind")


@query(f"""WITH s AS (SELECT doc_id, i, l, CASE WHEN regexp_matches(l, '^\\[[^\\]]+\\]\\s*$') THEN regexp_extract(l, '^\\[([^\\]]+)\\]', 1) END AS s FROM {_NUMBERED}),
  f AS (SELECT doc_id, i, l, s, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING), '') AS section FROM s) SELECT doc_id, section, count(*) AS options FROM f WHERE s IS NULL AND regexp_matches(l, '^[^=#;\\[]+=') AND trim(regexp_extract(l, '^([^=]+)=', 1)) <> '' GROUP BY doc_id, section""")
def section_options(spark, d):
    return R.sections(load(spark, d, "documents"), ["doc_id"], "text").groupBy("doc_id", "section").agg(F.count("*").alias("options"))


# ---------------------------------------------------------------- captures and extension points


@query(f"""WITH RECURSIVE {_NODES}, m AS (SELECT a.id, a.path, a.type AS at, b.type AS bt FROM t a JOIN t b ON b.id = a.id AND b.parent = a.path WHERE a.type = 'function_definition' AND b.type = 'return_statement') SELECT id, 'def' AS capture, 'function_definition' AS type, count(*) AS n FROM m GROUP BY id UNION ALL SELECT id, 'ret', 'return_statement', count(*) FROM m GROUP BY id""")
def tree_query_captures(spark, d):
    found = tree_captures(trees(spark, d), "id", "ast", {"returns": "(function_definition (return_statement) @ret) @def"})
    return A.count_by(found, "id", "capture", "type")


@query("SELECT doc_id, len(regexp_extract_all(text, '[0-9]+\\.[0-9]+')) AS n FROM documents WHERE regexp_matches(text, '[0-9]+\\.[0-9]+')")
def table_function_matches(spark, d):
    E.register_table_functions(spark)
    found = spark.sql("SELECT doc_id, m.place FROM {texts}, LATERAL text_matches(text, '[0-9]+\\\\.[0-9]+') m", texts=load(spark, d, "documents").select("doc_id", "text"))
    return A.count_by(found, "doc_id")


@query("SELECT doc_id, '{\"major\": \"' || regexp_extract(v, '^([0-9]+)', 1) || '\"}' AS features, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+\\.[0-9]+\\.[0-9]+')) AS v FROM documents) GROUP BY ALL")
def callback_features(spark, d):
    found = E.extracted(load(spark, d, "documents"), "doc_id", "text", {"version": r"([0-9]+)\.[0-9]+\.[0-9]+"}, {"version": _major})
    return A.count_by(found, "doc_id", "features")


def _major(match: dict) -> dict:
    return {"major": match["groups"][0]}


class _Headings(E.MatchStrategy):
    def specific_matches(self, text: str) -> list[dict]:
        return [{"line": i} for i, line in enumerate(text.split("\n")) if line.startswith("# ")]


@query("SELECT doc_id, len(regexp_extract_all(text, '(?m)^# ')) AS n FROM documents WHERE regexp_matches(text, '(?m)^# ')")
def strategy_matches(spark, d):
    return A.count_by(E.strategy_matches(load(spark, d, "documents"), "doc_id", "text", "lang", _Headings()), "doc_id")


@query()
def embedded_texts(spark, d):
    return E.embedded(load(spark, d, "documents").select("doc_id", "text"), "text", E.HashedWords(16)).select("doc_id", F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), ",").alias("embedding"))


@query(f"""WITH RECURSIVE {_NODES}, s AS (SELECT DISTINCT 'node' AS kind, type AS name, count(*) OVER (PARTITION BY type) AS n FROM t WHERE type <> 'module') SELECT kind, name, n FROM s UNION ALL SELECT 'structure', a.type || ':' || b.type, count(*) FROM t b JOIN t a ON a.id = b.id AND a.path = b.parent GROUP BY a.type, b.type""")
def insight_frequencies(spark, d):
    nodes = R.tree_nodes(trees(spark, d), "id", "ast")
    own = A.count_by(nodes.where("type <> 'module'"), "type").select(F.lit("node").alias("kind"), F.col("type").alias("name"), "n")
    pairs = R.node_relations(nodes, "id").where("parent_type is not null").select(F.concat_ws(":", "parent_type", "type").alias("name"))
    return own.unionByName(A.count_by(pairs, "name").select(F.lit("structure").alias("kind"), "name", "n"))


@query("SELECT event_type || '_' || user_id AS node, count(*) AS members FROM events WHERE event_type IS NOT NULL GROUP BY event_type, user_id")
def event_groups(spark, d):
    own = load(spark, d, "events").where("event_type is not null")
    grouped = G.group_node(own, ["event_type", "user_id"], "event_id")
    return grouped.select(F.concat_ws("_", "event_type", F.col("user_id").cast("string")).alias("node"), "members")
