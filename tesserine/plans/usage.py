"""Queries of filters, aggregations and scores over events, files and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserine.functions import text as T
from tesserine.functions import vector as V
from tesserine.operators import relational as A
from tesserine.operators import search as S
from tesserine.operators import upsert as K
from tesserine.plans.registry import query
from tesserine.plans.tables import DOCS, docs, files, relations
from tesserine.sources import settings
from tesserine.sources.tables import load


@query("""SELECT event_type, user_id, n FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) AS r FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY event_type, user_id)) WHERE r <= 20 AND n > 3""")
def frequent_structures(spark, d):
    return A.frequent_top(load(spark, d, "events"), ["user_id"], ["event_type"])


@query("""SELECT user_id, count(*) AS n, string_agg(CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR), ',' ORDER BY ts, event_id) AS series FROM events WHERE value IS NOT NULL AND ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY user_id""")
def metric_series(spark, d):
    return A.series(A.since(load(spark, d, "events"), "ts", 7), ["user_id"], ["ts", "event_id"], "value")


@query(f"""SELECT cluster_id, count(DISTINCT id) AS n, string_agg(DISTINCT CAST(id AS VARCHAR), '|' ORDER BY CAST(id AS VARCHAR)) AS members, coalesce(string_agg(DISTINCT lower(trim(doc_type)), '|' ORDER BY lower(trim(doc_type))), '') AS kinds FROM ({DOCS}) WHERE cluster_id IS NOT NULL GROUP BY cluster_id""")
def cluster_summary(spark, d):
    return A.summarised(docs(spark, d).withColumn("kind", F.lower(F.trim("doc_type"))), "cluster_id", "id", "kind")


@query("""SELECT '[' || string_agg('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}', ',' ORDER BY n_nationkey) || ']' AS rows FROM nation""")
def collected_nations(spark, d):
    return A.collected(load(spark, d, "nation"), ["n_nationkey", "n_name"], ["n_nationkey"])


@query("""SELECT language, parser_type, count(*) AS files, CAST(sum(size) AS BIGINT) AS characters FROM (SELECT language, parser_type, coalesce(length(file_content), 0) AS size FROM (SELECT DISTINCT repo_id, file_path, file_content, language, parser_type FROM code_files)) GROUP BY GROUPING SETS ((language), (parser_type), ())""")
def performance_totals(spark, d):
    own = files(spark, d).withColumn("size", F.coalesce(F.length("file_content"), F.lit(0)))
    return A.totals_by_sets(own, [["language"], ["parser_type"], []], [F.count("*").alias("files"), F.sum("size").alias("characters")])


@query("""SELECT event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(value) AS mean, count(*) FILTER (value > 50) AS over_time, count(*) FILTER (value > 100) AS over_matches FROM events GROUP BY event_type""")
def limit_metrics(spark, d):
    mean = F.sum(F.col("value").cast("decimal(18,2)")).cast("double") / F.count("value")
    return load(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), mean.alias("mean"), F.count_if(F.col("value") > 50).alias("over_time"), F.count_if(F.col("value") > 100).alias("over_matches"))


@query("""WITH e AS (SELECT * FROM events WHERE event_type = 'error') SELECT 'category' AS part, CAST(isodow(ts) AS VARCHAR) AS name, count(*) AS n FROM e GROUP BY isodow(ts) UNION ALL SELECT * FROM (SELECT 'location', CAST(user_id AS VARCHAR), count(*) FROM e GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 10)
  UNION ALL SELECT 'covered', 'users', (SELECT count(DISTINCT user_id) FROM e)""")
def error_report(spark, d):
    errors = load(spark, d, "events").where("event_type = 'error'")
    days = A.count_by(errors.select((F.weekday("ts") + 1).cast("string").alias("name")), "name").select(F.lit("category").alias("part"), "name", "n")
    places = A.count_by(errors, "user_id").orderBy(F.desc("n"), "user_id").limit(10).select(F.lit("location").alias("part"), F.col("user_id").cast("string").alias("name"), "n")
    covered = errors.agg(F.count_distinct("user_id").alias("n")).select(F.lit("covered").alias("part"), F.lit("users").alias("name"), "n")
    return days.unionByName(places).unionByName(covered)


_JACCARD = """(SELECT a.k AS key_a, b.k AS key_b, CAST(count(*) AS DOUBLE) / (max(sa.size) + max(sb.size) - count(*)) AS s FROM {0} a JOIN {0} b ON a.m = b.m AND a.k < b.k JOIN (SELECT k, count(*) AS size FROM {0} GROUP BY k) sa ON sa.k = a.k JOIN (SELECT k, count(*) AS size FROM {0} GROUP BY k) sb ON sb.k = b.k GROUP BY a.k, b.k)"""
_LANG = "(SELECT DISTINCT repo_id AS k, language AS m FROM code_files WHERE repo_id IS NOT NULL AND language IS NOT NULL)"
_PARSER = "(SELECT DISTINCT repo_id AS k, parser_type AS m FROM code_files WHERE repo_id IS NOT NULL AND parser_type IS NOT NULL)"


@query(f"""SELECT l.key_a, l.key_b, l.s * 0.6 + coalesce(p.s, 0.0) * 0.4 AS compatibility FROM {_JACCARD.format(_LANG)} l LEFT JOIN {_JACCARD.format(_PARSER)} p ON p.key_a = l.key_a AND p.key_b = l.key_b WHERE l.s * 0.6 + coalesce(p.s, 0.0) * 0.4 >= 0.3""")
def repo_compatibility(spark, d):
    own = load(spark, d, "code_files")
    language = A.members_in_common(own, "repo_id", "language").select("key_a", "key_b", F.col("similarity").alias("l"))
    parser = A.members_in_common(own, "repo_id", "parser_type").select("key_a", "key_b", F.col("similarity").alias("p"))
    both = language.join(parser, ["key_a", "key_b"], "left")
    # Pairs that agree too little are skipped.
    return both.select("key_a", "key_b", T.compatibility(F.col("l"), F.coalesce("p", F.lit(0.0))).alias("compatibility")).where("compatibility >= 0.3")


_USABLE = "embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"


@query(" UNION ALL ".join(f"SELECT '{t}' AS source, count(*) AS total, count(*) FILTER ({_USABLE}) AS valid, count(*) FILTER (NOT ({_USABLE})) AS invalid FROM {t}" for t in ("code_snippets", "repo_docs")))
def validation_rollup(spark, d):
    parts = [A.validity(load(spark, d, t).withColumn("source", F.lit(t)), V.has_dimension(F.col("embedding"), 64), "source") for t in ("code_snippets", "repo_docs")]
    return parts[0].unionByName(parts[1])


# Events read as uses of user-interface components: the kind of component by type, the hook by value.
_HOOKS = ["useCallback", "useMemo", "useState", "useContext", "useSelector", "useDispatch", "useStore"]
_UI = "(SELECT user_id, CASE event_type WHEN 'view' THEN 'functional' WHEN 'signup' THEN 'class' WHEN 'purchase' THEN 'memo' WHEN 'click' THEN 'forwardRef' ELSE 'other' END AS component, " + "['useCallback', 'useMemo', 'useState', 'useContext', 'useSelector', 'useDispatch', 'useStore'][CAST(floor(value) AS BIGINT) % 7 + 1] AS hook FROM events)"


def _components(spark, d):
    kind = F.col("event_type")
    component = F.when(kind == "view", "functional").when(kind == "signup", "class").when(kind == "purchase", "memo").when(kind == "click", "forwardRef").otherwise("other")
    return load(spark, d, "events").select("user_id", component.alias("component"), F.get(F.array(*[F.lit(h) for h in _HOOKS]), (F.floor("value") % 7).cast("int")).alias("hook"))


@query(f"""SELECT count(*) FILTER (component = 'functional') AS functional, count(*) FILTER (component = 'class') AS class, count(*) FILTER (component IN ('memo', 'forwardRef')) AS hoc, count(*) FILTER (component = 'memo') AS memo_usage, count(*) FILTER (hook IN ('useCallback', 'useMemo')) AS callback_usage,
  count(*) FILTER (hook = 'useState') AS local_state, count(*) FILTER (hook = 'useContext') AS context_usage, count(*) FILTER (hook IN ('useSelector', 'useDispatch', 'useStore')) AS redux_usage FROM {_UI}""")
def component_patterns(spark, d):
    kind, hook = F.col("component"), F.col("hook")
    return A.pivoted_counts(_components(spark, d), {
        "functional": kind == "functional", "class": kind == "class", "hoc": kind.isin("memo", "forwardRef"), "memo_usage": kind == "memo", "callback_usage": hook.isin("useCallback", "useMemo"),
        "local_state": hook == "useState", "context_usage": hook == "useContext", "redux_usage": hook.isin("useSelector", "useDispatch", "useStore"),
    })


@query(f"SELECT hook, count(*) AS uses, count(DISTINCT user_id) AS users FROM {_UI} WHERE hook IS NOT NULL GROUP BY hook")
def hook_usage(spark, d):
    return _components(spark, d).where("hook is not null").groupBy("hook").agg(F.count("*").alias("uses"), F.count_distinct("user_id").alias("users"))


@query("""SELECT p_brand, count(DISTINCT l_suppkey) AS owners, string_agg(DISTINCT coalesce(CASE WHEN p_size > 5 THEN p_type END, 'any'), '|' ORDER BY coalesce(CASE WHEN p_size > 5 THEN p_type END, 'any')) AS kinds, count(*) FILTER (l_linestatus = 'F') AS required, count(*) FILTER (l_linestatus <> 'F') AS optional FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_brand""")
def prop_usage(spark, d):
    own = load(spark, d, "lineitem").join(load(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).withColumn("kind", F.when(F.col("p_size") > 5, F.col("p_type")))
    return A.property_usage(own, "p_brand", "l_suppkey", "kind", F.col("l_linestatus") == "F")


@query("""SELECT count(*) AS total, count(*) FILTER (kind = 'code') AS code, count(*) FILTER (kind = 'doc') AS doc, count(*) FILTER (kind = 'arch') AS arch FROM (SELECT CASE WHEN starts_with(file_path, 'architecture/') THEN 'arch' ELSE 'code' END AS kind FROM (SELECT DISTINCT repo_id, file_path FROM code_snippets WHERE file_path IS NOT NULL) UNION ALL SELECT 'doc' FROM (SELECT DISTINCT id FROM repo_docs))""")
def storage_counters(spark, d):
    code = load(spark, d, "code_snippets").where("file_path is not null").select("repo_id", "file_path").distinct().select(F.when(F.col("file_path").startswith("architecture/"), "arch").otherwise("code").alias("kind"))
    own = code.unionByName(load(spark, d, "repo_docs").select("id").distinct().select(F.lit("doc").alias("kind")))
    return own.agg(F.count("*").alias("total"), *[F.count_if(F.col("kind") == k).alias(k) for k in ("code", "doc", "arch")])


@query("""SELECT user_id, CAST(count(*) FILTER (event_type = 'error') AS DOUBLE) / count(*) AS error_rate FROM events GROUP BY user_id""")
def component_error_rates(spark, d):
    return load(spark, d, "events").groupBy("user_id").agg(F.avg((F.col("event_type") == "error").cast("double")).alias("r"), F.count_if(F.col("event_type") == "error").alias("e"), F.count("*").alias("n")).select("user_id", (F.col("e") / F.col("n")).alias("error_rate"))


@query("SELECT p_partkey, p_brand, p_size FROM part WHERE p_brand IN ('Brand#11', 'Brand#22', 'Brand#33') AND p_size = 7")
def any_of(spark, d):
    return A.where_given(load(spark, d, "part"), p_brand=["Brand#11", "Brand#22", "Brand#33"], p_size=7, p_type=None).select("p_partkey", "p_brand", "p_size")


@query("""SELECT event_type, CAST(count(*) FILTER (value >= 25) AS DOUBLE) / count(*) AS rate FROM events GROUP BY event_type HAVING CAST(count(*) FILTER (value >= 25) AS DOUBLE) / count(*) >= 0.2""")
def adaptive_skip(spark, d):
    own = load(spark, d, "events").groupBy("event_type").agg((F.count_if(F.col("value") >= 25) / F.count("*")).alias("rate"))
    return own.where(~T.is_skipped(F.col("rate")))


@query("SELECT doc_id, left(text, 500) AS head FROM documents")
def text_heads(spark, d):
    return load(spark, d, "documents").select("doc_id", F.substring("text", 1, 500).alias("head"))


_VALID_DOCS = f"(SELECT id, embedding::DOUBLE[] AS v, lower(trim(doc_type)) AS doc_type FROM ({DOCS}) WHERE {_USABLE})"


def _doc_vectors(spark, d):
    return docs(spark, d).where(V.has_dimension(F.col("embedding"), 64)).select("id", "embedding", F.lower(F.trim("doc_type")).alias("doc_type"))


@query(f"""WITH v AS {_VALID_DOCS}, r AS (SELECT DISTINCT doc_id FROM repo_doc_relations WHERE repo_id = 1) SELECT query, id, distance FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, id) AS place FROM (
  SELECT q.id AS query, e.id, round(1 - round(list_cosine_similarity(q.v, e.v), 9), 9) AS distance FROM v q JOIN v e ON q.id <> e.id JOIN r ON r.doc_id = e.id WHERE q.id % 50 = 0)) WHERE place <= 5""")
def doc_search(spark, d):
    own = _doc_vectors(spark, d)
    asked = own.where("id % 50 = 0").select(F.col("id").alias("query"), F.col("embedding").alias("vec"))
    found = S.search_docs(own, "id", "embedding", asked, relations(spark, d), repo_id=1, k=5)
    return found.select("query", "id", F.round(1 - F.col("similarity"), 9).alias("distance"))


@query(f"""WITH v AS {_VALID_DOCS} SELECT query, id, similarity, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) AS place FROM (
  SELECT q.id AS query, e.id, round(list_cosine_similarity(q.v, e.v), 9) AS similarity FROM v q JOIN v e ON q.id <> e.id WHERE q.id % 50 = 0 AND e.doc_type = 'readme') WHERE similarity >= 0.7) WHERE place <= 5""")
def similar_of_type(spark, d):
    own = _doc_vectors(spark, d)
    asked = own.where("id % 50 = 0").select(F.col("id").alias("query"), F.col("embedding").alias("vec"))
    return S.nearest(own, "id", "embedding", asked, k=5, min_similarity=0.7, keep=F.col("doc_type") == "readme")


@query(f"""WITH v AS {_VALID_DOCS} SELECT query, id, least(1.0, similarity * CASE WHEN a = b THEN 1.1 ELSE 1.0 END) AS confidence FROM (SELECT q.id AS query, e.id, q.doc_type AS a, e.doc_type AS b, round(list_cosine_similarity(q.v, e.v), 9) AS similarity FROM v q JOIN v e ON q.id <> e.id WHERE q.id % 50 = 0) WHERE similarity > 0.8""")
def vector_pattern_matches(spark, d):
    own = _doc_vectors(spark, d)
    asked = own.where("id % 50 = 0").select(F.col("id").alias("query"), F.col("embedding").alias("vec"))
    found = S.nearest(own, "id", "embedding", asked, k=None, min_similarity=0.8).where("similarity > 0.8")
    kinds = own.select(F.col("id"), F.col("doc_type").alias("b"))
    named = found.join(kinds, "id").join(kinds.toDF("query", "a"), "query")
    none = F.lit(None).cast("int")
    return named.select("query", "id", V.adjusted_confidence(F.col("similarity"), F.coalesce(F.col("a") == F.col("b"), F.lit(False)), none, none).alias("confidence"))


@query(f"""SELECT id, concat_ws(chr(10), 'Language: ' || lower(trim(doc_type)), 'File: ' || file_path, content) AS text FROM ({DOCS})""")
def enriched_texts(spark, d):
    none = F.array().cast("array<string>")
    return docs(spark, d).select("id", V.enriched_text(F.col("content"), F.col("file_path"), F.lower(F.trim("doc_type")), none).alias("text"))


@query("""SELECT repo_id, concat_ws(chr(10), 'Directories: ' || string_agg(part, ', ' ORDER BY part), 'Files: ' || max(n)) AS text FROM (SELECT DISTINCT repo_id, split_part(replace(file_path, '\\', '/'), '/', 1) AS part FROM code_files WHERE repo_id IS NOT NULL AND contains(replace(file_path, '\\', '/'), '/'))
  JOIN (SELECT repo_id AS r, count(DISTINCT file_path) AS n FROM code_files GROUP BY repo_id) ON r = repo_id GROUP BY repo_id""")
def architecture_texts(spark, d):
    own = load(spark, d, "code_files").where("repo_id is not null").select("repo_id", F.translate("file_path", "\\", "/").alias("p"), "file_path")
    tops = own.where(F.contains("p", F.lit("/"))).select("repo_id", F.split("p", "/")[0].alias("part")).groupBy("repo_id").agg(F.array_sort(F.collect_set("part")).alias("parts"))
    sizes = own.groupBy("repo_id").agg(F.count_distinct("file_path").alias("n"))
    return tops.join(sizes, "repo_id").select("repo_id", V.architecture_text({"Directories": F.array_join("parts", ", "), "Files": F.col("n").cast("string")}).alias("text"))


@query("""SELECT user_id, coalesce(arg_min(event_type, (-rate, event_type)) FILTER (rate > 0.3), 'default') AS event_type FROM (SELECT user_id, event_type, CAST(count(*) FILTER (value > 50) AS DOUBLE) / count(*) AS rate FROM events GROUP BY user_id, event_type) GROUP BY user_id""")
def best_strategy(spark, d):
    own = load(spark, d, "events").groupBy("user_id", "event_type").agg((F.count_if(F.col("value") > 50) / F.count("*")).alias("rate"))
    return A.best_above(own, ["user_id"], "event_type", "rate", 0.3, "default")


@query("""SELECT p_partkey, len(list_intersect(list_distinct(string_split(p_name, ' ')), list_distinct(string_split(lower(p_type), ' ')))) AS shared, CAST(len(list_intersect(list_distinct(string_split(p_name, '')), list_distinct(string_split(p_brand, '')))) AS DOUBLE) / len(list_distinct(list_concat(string_split(p_name, ''), string_split(p_brand, '')))) AS letters FROM part""")
def set_similarity(spark, d):
    distinct = lambda c, sep: F.array_distinct(F.split(c, sep))
    shared = F.size(F.array_intersect(distinct("p_name", " "), distinct(F.lower("p_type"), " "))).cast("long")
    return load(spark, d, "part").select("p_partkey", shared.alias("shared"), T.jaccard(distinct("p_name", ""), distinct("p_brand", "")).alias("letters"))


@query("""WITH c AS (SELECT a.p_partkey AS a, b.p_partkey AS b, a.p_name AS x, b.p_name AS y FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey),
  w AS (SELECT *, list_distinct(regexp_extract_all(x, '\\w+')) AS wx, list_distinct(regexp_extract_all(y, '\\w+')) AS wy, list_distinct(string_split(x, '')) AS cx, list_distinct(string_split(y, '')) AS cy FROM c)
  SELECT a, b FROM w WHERE abs(length(x) - length(y)) / greatest(length(x), length(y)) < 0.3 AND (CAST(len(list_intersect(cx, cy)) AS DOUBLE) / len(list_distinct(list_concat(cx, cy))) > 0.7 OR CAST(len(list_intersect(wx, wy)) AS DOUBLE) / len(list_distinct(list_concat(wx, wy))) > 0.5)""")
def similar_names(spark, d):
    return _similar_names(load(spark, d, "part"))


def _similar_names(part):
    """Names that a brand has for a size are compared once, however many parts bear them; then the parts of alike names meet."""
    group = ["p_brand", "p_size"]
    own = part.select(*group, "p_name", "p_partkey")
    names = own.select(*group, "p_name").distinct().withColumn("c", T.content_parts(F.col("p_name")))
    left, right = names.toDF(*group, "x", "cx"), names.toDF(*group, "y", "cy")
    alike = left.join(right, group).where("x <= y").where(T.similar_parts(F.col("cx"), F.col("cy"))).select(*group, "x", "y")
    pairs = alike.join(own.toDF(*group, "x", "m"), [*group, "x"]).join(own.toDF(*group, "y", "n"), [*group, "y"])
    return pairs.where("m < n or (x <> y and n < m)").select(F.least("m", "n").alias("a"), F.greatest("m", "n").alias("b"))


@query("""SELECT doc_kind, class, retryable, count(*) AS n FROM (SELECT doc_kind, CASE WHEN contains(t, 'syntax') THEN 'syntax_error' WHEN contains(t, 'timeout') OR contains(t, 'time limit') THEN 'timeout_error' WHEN contains(t, 'memory') THEN 'memory_error' WHEN contains(t, 'match limit') THEN 'match_limit_error'
    WHEN contains(t, 'partial') THEN 'partial_match_error' WHEN contains(t, 'ambiguous') THEN 'ambiguous_match_error' WHEN contains(t, 'recursion') THEN 'recursion_error' ELSE 'unknown_error' END AS class,
  CASE WHEN regexp_matches(t, 'syntax error|constraint|invalid|not found|already exists|schema|authentication|authorization|permission|type error|value error|index error|out of bounds|null|undefined') THEN false ELSE regexp_matches(t, 'connection refused|timeout|timed out|temporarily unavailable|deadlock|connection reset|broken pipe|overloaded|too many connections|resource temporarily unavailable|connection lost|network error|server unavailable|service unavailable|connection error|socket error|connection was reset') END AS retryable
  FROM (SELECT doc_kind, lower(text) AS t FROM documents WHERE text IS NOT NULL)) GROUP BY doc_kind, class, retryable""")
def error_classes(spark, d):
    own = load(spark, d, "documents").where("text is not null").select("doc_kind", T.error_class(F.col("text")).alias("class"), T.is_retryable(F.col("text")).alias("retryable"))
    return A.count_by(own, "doc_kind", "class", "retryable")


@query("""SELECT event_id, least(30.0, CASE WHEN event_type = 'error' THEN 2.0 ELSE 1.0 END * power(2.0, user_id % 8)) AS delay FROM events""")
def retry_delays(spark, d):
    return load(spark, d, "events").select("event_id", T.backoff(F.col("user_id") % 8, 1.0, 30.0, F.col("event_type") == "error").alias("delay"))


@query("""SELECT p_partkey, length(p) * 0.1::DOUBLE + 2 * (length(p) - length(replace(p, '@', ''))) + 5 * (length(p) - length(replace(p, '|', ''))) AS complexity, p_size > 10 AND p_retailprice / 2000 < 0.5 AS adapt FROM (SELECT *, '(' || p_name || ') @' || p_brand || ' | ' || p_type AS p FROM part)""")
def query_complexities(spark, d):
    p = F.concat(F.lit("("), "p_name", F.lit(") @"), "p_brand", F.lit(" | "), "p_type")
    return load(spark, d, "part").select("p_partkey", T.query_complexity(p).alias("complexity"), T.needs_adapting(F.col("p_size"), F.col("p_retailprice") / 2000).alias("adapt"))


_LINES = """(SELECT repo_id, file_path, len(l) AS total, len(list_filter(l, lambda x: starts_with(x, '//') OR starts_with(x, '#'))) AS comment FROM (SELECT repo_id, file_path, CASE WHEN t = '' THEN [] ELSE list_transform(string_split(regexp_replace(t, '\\n$', ''), chr(10)), lambda x: trim(replace(x, chr(9), ' '))) END AS l FROM (
  SELECT DISTINCT repo_id, file_path, replace(replace(file_content, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM code_files WHERE file_content IS NOT NULL)))"""


@query(f"""SELECT repo_id, file_path, least(100.0, 100.0 * comment / total) AS maintainability, least(100.0, CAST(comment AS DOUBLE) / total * 50 + 50.0 / 3) AS testability, least(100.0, CAST(comment AS DOUBLE) / total * 40 + 30.0 / 2 + 30 * (1.0::DOUBLE / total)) AS reusability FROM {_LINES} WHERE total > 0""")
def file_scores(spark, d):
    unified = F.regexp_replace("file_content", "\\r\\n|\\r", "\n")
    one = load(spark, d, "code_files").where("file_content is not null").select("repo_id", "file_path", unified.alias("t")).distinct()
    c = F.col("c")
    own = one.select("repo_id", "file_path", T.line_counts(F.col("t")).alias("c")).where("c.total > 0")
    return own.select("repo_id", "file_path", T.share_of_comments(c).alias("maintainability"), T.testability(c, F.lit(3)).alias("testability"), T.reusability(c, F.lit(2), F.lit(1)).alias("reusability"))


@query(f"""SELECT id, (least(1.0, heads / 10.0::DOUBLE) + least(1.0, links / 20.0::DOUBLE) + least(1.0, items / 50.0::DOUBLE)) / 3 AS relevance FROM (SELECT id, len(regexp_extract_all(content, '(?m)^#{{1,6}} ')) AS heads, len(regexp_extract_all(content, '\\]\\(')) AS links, len(regexp_extract_all(content, '(?m)^[*+-] ')) AS items FROM ({DOCS}) WHERE content IS NOT NULL)""")
def context_relevance(spark, d):
    times = lambda p: F.regexp_count("content", F.lit(p))
    return docs(spark, d).where("content is not null").select("id", T.capped_mean((times("(?md)^#{1,6} "), 10.0), (times("\\]\\("), 20.0), (times("(?md)^[*+-] "), 50.0)).alias("relevance"))


@query("""SELECT user_id, round(avg(last), 9) AS confidence FROM (SELECT user_id, event_type, coalesce(arg_max(value, (ts, event_id)), 50.0) / 100 AS last FROM events GROUP BY user_id, event_type) GROUP BY user_id""")
def overall_confidence(spark, d):
    last = load(spark, d, "events").groupBy("user_id", "event_type").agg((F.coalesce(F.max_by("value", F.struct("ts", "event_id")), F.lit(50.0)) / 100).alias("last"))
    return last.groupBy("user_id").agg(F.round(F.avg("last"), 9).alias("confidence"))


@query("SELECT DISTINCT repo_id, file_path, concat_ws(':', language, md5(coalesce(file_content, ''))) AS key FROM code_files")
def source_keys(spark, d):
    return load(spark, d, "code_files").select("repo_id", "file_path", T.source_key(F.col("file_content"), F.col("language")).alias("key")).distinct()


@query("""SELECT l_orderkey, l_linenumber, l_quantity >= 10 AND l_extendedprice >= l_quantity AND l_discount >= 0.02 AND l_tax >= l_discount AS valid FROM lineitem""")
def valid_spans(spark, d):
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", T.is_valid_span(F.col("l_quantity") - 10, F.col("l_discount") - 0.02, F.greatest(F.col("l_extendedprice"), F.lit(0.0)) - 10, F.col("l_tax") - 0.02).alias("valid"))


@query(f"""SELECT d.id, f.repo_id, f.file_path FROM ({DOCS}) d JOIN (SELECT DISTINCT repo_id, file_path FROM code_files) f ON f.file_path = d.related_code_path""")
def pattern_recommendations(spark, d):
    code = load(spark, d, "code_files").select("repo_id", "file_path").distinct()
    return docs(spark, d).select("id", F.col("related_code_path").alias("file_path")).join(code, "file_path").select("id", "repo_id", "file_path")


@query("SELECT id, repo_name FROM (SELECT DISTINCT id, repo_name, row_number() OVER (PARTITION BY id ORDER BY last_updated DESC, repo_name) AS r FROM repositories) WHERE r = 1 ORDER BY id")
def ordered_dump(spark, d):
    return K.latest_by_key(load(spark, d, "repositories"), ["id"], [F.desc("last_updated"), F.col("repo_name")]).select("id", "repo_name").orderBy("id")


@query("SELECT 'nations' AS name, (SELECT count(*) FROM nation) AS n UNION ALL SELECT 'large', (SELECT count(*) FROM part WHERE p_size > 40)")
def parallel_queries(spark, d):
    nation, part = load(spark, d, "nation"), load(spark, d, "part")
    jobs = [("SELECT 'nations' AS name, count(*) AS n FROM {nation}", {"nation": nation}), ("SELECT 'large' AS name, count(*) AS n FROM {part} WHERE p_size > {size}", {"part": part, "size": 40})]
    first, second = settings.run_queries(spark, jobs)
    return first.unionByName(second)


@query(f"""SELECT r.repo_id, d.id AS doc_id, bool_or(coalesce(r.is_primary, false)) AS is_primary FROM ({DOCS}) d JOIN repo_doc_relations r ON r.doc_id = d.id GROUP BY r.repo_id, d.id""")
def doc_relations_upsert(spark, d):
    own = load(spark, d, "repo_doc_relations").where("doc_id is not null")
    known = docs(spark, d).select(F.col("id").alias("doc_id"))
    return own.join(known, "doc_id", "left_semi").groupBy("repo_id", "doc_id").agg(F.bool_or(F.coalesce("is_primary", F.lit(False))).alias("is_primary"))


@query("""SELECT source, target, type, strength FROM (SELECT s_suppkey AS source, l_partkey AS target, l_returnflag AS type, l_extendedprice AS strength, row_number() OVER (PARTITION BY s_suppkey, l_partkey, l_returnflag ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) AS r FROM lineitem JOIN supplier ON s_suppkey = l_suppkey) WHERE r = 1""")
def relationship_upsert(spark, d):
    own = load(spark, d, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), F.col("l_returnflag").alias("type"), F.col("l_extendedprice").alias("strength"), "l_shipdate", "l_orderkey", "l_linenumber")
    order = [F.desc("l_shipdate"), F.desc("l_orderkey"), F.desc("l_linenumber")]
    old, new = own.where("l_linenumber <= 3"), own.where("l_linenumber > 3")
    return K.latest_by_key(K.upsert(old, new.unionByName(A.present(old, new, ["source", "target", "type"])), ["source", "target", "type"], order), ["source", "target", "type"], order).select("source", "target", "type", "strength")


@query("""SELECT id, path, content FROM (SELECT row_number() OVER (ORDER BY repo_id, file_path) + 1000 AS id, file_path AS path, md5(coalesce(max(file_content), '')) AS content FROM code_files WHERE repo_id = 1 GROUP BY repo_id, file_path)""")
def inserted_ids(spark, d):
    own = load(spark, d, "code_files").where("repo_id = 1").groupBy("repo_id", "file_path").agg(F.md5(F.coalesce(F.max("file_content"), F.lit(""))).alias("content"))
    return K.insert_with_ids(own, ["repo_id", "file_path"], "id", after=1000).select("id", F.col("file_path").alias("path"), "content")
