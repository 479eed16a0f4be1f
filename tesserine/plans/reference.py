"""Queries of the reference operators, each with the SQL that gives the same rows.

Every query reads whole tables. Averages are taken from exact decimal sums, so both engines agree
to the last digit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.functions import text as T
from tesserine.functions import vector as V
from tesserine.functions.catalogue import PATTERNS
from tesserine.operators import graph as G
from tesserine.operators import learning as L
from tesserine.operators import patterns as R
from tesserine.operators import relational as A
from tesserine.operators import search as S
from tesserine.operators import upsert as K
from tesserine.operators import windows as W
from tesserine.operators.components import connected_components
from tesserine.plans.registry import query
from tesserine.plans.tables import DOCS, EDGES, docs, files, part_edges, relations
from tesserine.sources.tables import load
from tesserine.streaming import changes as C

_DOCS, _EDGES = DOCS, EDGES

# ---------------------------------------------------------------- search


_KNN = """SELECT query, id, similarity, place FROM (
  SELECT q.vec_id AS query, e.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS similarity,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) DESC, e.vec_id) AS place
  FROM (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE {0}) WHERE place <= 5 AND {1}"""


def _asked(e: DataFrame) -> DataFrame:
    return e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vec"))


@query(_KNN.format("true", "true"))
def knn_topk(spark, d):
    e = load(spark, d, "embeddings")
    return S.nearest(e, "vec_id", "embedding", _asked(e), k=5)


@query(_KNN.format("e.label = 3", "true"))
def knn_filtered(spark, d):
    e = load(spark, d, "embeddings")
    return S.nearest(e, "vec_id", "embedding", _asked(e), k=5, keep=F.col("label") == 3)


@query(_KNN.format("true", "similarity >= 0.3"))
def knn_threshold(spark, d):
    e = load(spark, d, "embeddings")
    return S.nearest(e, "vec_id", "embedding", _asked(e), k=5, min_similarity=0.3)


@query("""SELECT query, id, similarity FROM (SELECT q.vec_id AS query, e.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS similarity,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) DESC, e.vec_id) AS place
  FROM (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE e.label <= 4) WHERE place = 1""")
def max_similarity_to_set(spark, d):
    e = load(spark, d, "embeddings")
    return S.best_match(e, "vec_id", "embedding", _asked(e), keep=F.col("label") <= 4)


@query("""SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], centre), 6) AS similarity FROM embeddings JOIN (
  SELECT label AS l, list(m ORDER BY i) AS centre FROM (SELECT label, i, CAST(sum(CAST(embedding[i] AS DECIMAL(20,8))) AS DOUBLE) AS m FROM embeddings, range(1, 65) r(i) GROUP BY label, i) GROUP BY label) ON label = l""")
def similarity_to_centre(spark, d):
    e = load(spark, d, "embeddings")
    centre = e.groupBy("label").agg(F.array(*[F.sum(F.col("embedding")[i].cast("decimal(20,8)")).cast("double") for i in range(64)]).alias("centre"))
    return e.join(centre, "label").select("vec_id", F.round(V.cosine_similarity(F.col("embedding"), F.col("centre")), 6).alias("similarity"))


@query("SELECT vec_id, len(embedding) AS dim, len(embedding) = 64 AS fits FROM embeddings")
def dimension_check(spark, d):
    return load(spark, d, "embeddings").select("vec_id", F.size("embedding").cast("long").alias("dim"), V.has_dimension(F.col("embedding"), 64).alias("fits"))


@query("""SELECT doc_type, id, score, list_no FROM (SELECT *, row_number() OVER (ORDER BY list_no, score DESC, id) AS r FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY list_no) AS p FROM (
    SELECT id, lower(trim(doc_type)) AS doc_type, CAST(coalesce(version, 0) AS BIGINT) AS score, 1 AS list_no FROM (%s) WHERE content ILIKE '%%cache%%'
    UNION ALL SELECT id, lower(trim(doc_type)), CAST(coalesce(version, 0) AS BIGINT), 2 FROM (%s) WHERE content ILIKE '%%index%%')) WHERE p = 1) WHERE r <= 50""" % (_DOCS, _DOCS))
def ranked_union(spark, d):
    own = docs(spark, d).select("id", F.lower(F.trim("doc_type")).alias("doc_type"), F.coalesce("version", F.lit(0)).cast("long").alias("score"), F.lower("content").alias("c"))
    lists = [own.where(F.contains("c", F.lit(w))).drop("c") for w in ("cache", "index")]
    return A.ranked_union(lists[0], lists[1], ["id"], "score", 50)


@query("""WITH p AS (SELECT p_partkey, p_brand, p_type, p_size FROM part), b AS (SELECT DISTINCT p_brand, p_type FROM part WHERE p_size > 45), t AS (SELECT DISTINCT p_type FROM part WHERE p_size > 48)
  SELECT p_partkey, CASE WHEN (p_brand, p_type) IN (SELECT p_brand, p_type FROM b) THEN 1 WHEN p_type IN (SELECT p_type FROM t) THEN 2 ELSE 3 END::BIGINT AS tier FROM p""")
def fallback_tiers(spark, d):
    p = load(spark, d, "part")
    brand = A.present(p, p.where("p_size > 45"), ["p_brand", "p_type"]).select("p_partkey")
    kind = A.present(p, p.where("p_size > 48"), ["p_type"]).select("p_partkey")
    return A.first_tier([brand, kind, p.select("p_partkey")], ["p_partkey"])


# ---------------------------------------------------------------- relational


@query("SELECT lang, count(*) AS n FROM (SELECT coalesce(lower(trim(lang)), 'unknown') AS lang FROM documents) GROUP BY lang")
def docs_by_language(spark, d):
    return A.count_by(load(spark, d, "documents").select(F.coalesce(F.lower(F.trim("lang")), F.lit("unknown")).alias("lang")), "lang")


@query(f"""SELECT r.repo_id, d.id, lower(trim(d.doc_type)) AS doc_type FROM ({_DOCS}) d JOIN (SELECT DISTINCT repo_id, doc_id FROM repo_doc_relations) r ON d.id = r.doc_id WHERE lower(trim(d.doc_type)) = 'readme'""")
def docs_of_repos(spark, d):
    own = docs(spark, d).where(F.lower(F.trim("doc_type")) == "readme")
    return own.join(relations(spark, d), F.col("id") == F.col("doc_id")).select("repo_id", "id", F.lower(F.trim("doc_type")).alias("doc_type"))


@query(f"""SELECT r.repo_id, d.id, f.language FROM ({_DOCS}) d JOIN (SELECT DISTINCT repo_id, doc_id FROM repo_doc_relations) r ON d.id = r.doc_id
  JOIN (SELECT DISTINCT repo_id, file_path, language FROM code_files) f ON f.repo_id = r.repo_id AND f.file_path = d.related_code_path""")
def docs_with_code(spark, d):
    code = load(spark, d, "code_files").select("repo_id", F.col("file_path").alias("related_code_path"), "language").distinct()
    return docs(spark, d).join(relations(spark, d), F.col("id") == F.col("doc_id")).join(code, ["repo_id", "related_code_path"]).select("repo_id", "id", "language")


@query(f"""SELECT id FROM ({_DOCS}) WHERE id NOT IN (SELECT doc_id FROM repo_doc_relations WHERE doc_id IS NOT NULL)""")
def available_docs(spark, d):
    return A.missing(docs(spark, d).select("id"), relations(spark, d).select(F.col("doc_id").alias("id")), ["id"])


@query("SELECT repo_id, file_path FROM code_snippets WHERE file_path LIKE 'architecture/%' GROUP BY repo_id, file_path")
def architecture_paths(spark, d):
    return load(spark, d, "code_snippets").where(F.col("file_path").startswith("architecture/")).select("repo_id", "file_path").distinct()


@query("SELECT count(DISTINCT id) AS n FROM (SELECT id FROM code_snippets UNION ALL SELECT id FROM repo_docs UNION ALL SELECT id FROM repositories)")
def union_distinct_count(spark, d):
    return A.distinct_over_union([load(spark, d, t) for t in ("code_snippets", "repo_docs", "repositories")], "id")


@query("SELECT repo_id, count(*) FILTER (parser_type = 'custom') AS n_custom, count(*) FILTER (parser_type = 'tree_sitter') AS n_tree_sitter, count(*) FILTER (coalesce(parser_type, '') NOT IN ('custom', 'tree_sitter')) AS n_other FROM (SELECT DISTINCT repo_id, file_path, file_content, language, parser_type FROM code_files) GROUP BY repo_id")
def parser_distribution(spark, d):
    return A.conditional_counts(files(spark, d), "parser_type", ["custom", "tree_sitter"], "repo_id")


@query(f"""SELECT doc_type, count(*) AS docs, CAST(sum(len(string_split(content, chr(10)))) AS BIGINT) AS lines FROM (SELECT coalesce(lower(trim(doc_type)), 'unknown') AS doc_type, coalesce(content, '') AS content FROM ({_DOCS})) GROUP BY doc_type""")
def doc_coverage(spark, d):
    own = docs(spark, d).select(F.coalesce(F.lower(F.trim("doc_type")), F.lit("unknown")).alias("doc_type"), F.size(F.split(F.coalesce("content", F.lit("")), "\n")).alias("l"))
    return own.groupBy("doc_type").agg(F.count("*").alias("docs"), F.sum("l").alias("lines"))


@query(f"""WITH x AS (SELECT coalesce(lower(trim(doc_type)), 'unknown') AS doc_type, file_path FROM ({_DOCS})), g AS (SELECT doc_type, count(*) AS n FROM x GROUP BY doc_type HAVING count(*) > 3),
  s AS (SELECT doc_type, string_agg(file_path, '|' ORDER BY file_path) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY doc_type ORDER BY file_path) AS r FROM (SELECT DISTINCT * FROM x WHERE file_path IS NOT NULL)) WHERE r <= 3 GROUP BY doc_type)
  SELECT g.doc_type, n, samples FROM g LEFT JOIN s ON g.doc_type = s.doc_type""")
def having_samples(spark, d):
    own = docs(spark, d).select(F.coalesce(F.lower(F.trim("doc_type")), F.lit("unknown")).alias("doc_type"), "file_path")
    return A.groups_with_samples(own, "doc_type", "file_path", 3)


@query("""SELECT n_name AS source, r_name AS target, count(*) AS weight FROM (SELECT DISTINCT c_nationkey, s_nationkey, l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)
  JOIN nation ON c_nationkey = n_nationkey JOIN (SELECT n_nationkey AS k, n_name AS r_name FROM nation) ON s_nationkey = k WHERE n_name <> r_name GROUP BY n_name, r_name""")
def component_dependencies(spark, d):
    n = load(spark, d, "nation")
    edges = load(spark, d, "lineitem").join(load(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    edges = edges.join(load(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("c_nationkey", "s_nationkey", "l_orderkey", "l_linenumber").distinct()
    small = edges.groupBy("c_nationkey", "s_nationkey").agg(F.count("*").alias("w"))  # before names are joined
    named = small.join(n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("source")), "c_nationkey").join(n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("target")), "s_nationkey")
    return named.where("source <> target").groupBy("source", "target").agg(F.sum("w").alias("weight"))


@query("""SELECT split_part(source_path, '/', 1) AS source, split_part(target_path, '/', 1) AS target, count(*) AS weight FROM (
  SELECT DISTINCT d.id, d.file_path AS source_path, d.related_code_path AS target_path FROM repo_docs d WHERE d.file_path IS NOT NULL AND d.related_code_path IS NOT NULL) WHERE split_part(source_path, '/', 1) <> split_part(target_path, '/', 1) GROUP BY 1, 2""")
def path_components(spark, d):
    own = load(spark, d, "repo_docs").where("file_path is not null and related_code_path is not null").select("id", "file_path", "related_code_path").distinct()
    return A.pair_counts(own, F.split("file_path", "/")[0], F.split("related_code_path", "/")[0])


@query("""SELECT user_id, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS avg_value, min(value) AS min_value, max(value) AS max_value,
  arg_min(value, (ts, event_id)) AS first_value, arg_max(value, (ts, event_id)) AS last_value FROM events WHERE value IS NOT NULL GROUP BY user_id""")
def metric_trend(spark, d):
    order = F.struct("ts", "event_id")
    return load(spark, d, "events").where("value is not null").groupBy("user_id").agg(
        F.count("*").alias("n"), (F.sum(F.col("value").cast("decimal(18,2)")).cast("double") / F.count("*")).alias("avg_value"), F.min("value").alias("min_value"), F.max("value").alias("max_value"),
        F.min_by("value", order).alias("first_value"), F.max_by("value", order).alias("last_value"),
    )


@query("""SELECT user_id, n, avg, min, max, p FROM (SELECT user_id, value AS p, row_number() OVER (PARTITION BY user_id ORDER BY value) - 1 AS i FROM events WHERE value IS NOT NULL) JOIN (
  SELECT user_id AS u, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS avg, min(value) AS min, max(value) AS max FROM events WHERE value IS NOT NULL GROUP BY user_id) ON u = user_id WHERE i = least(CAST(floor(n * 0.95) AS BIGINT), n - 1)""")
def nearest_rank_p95(spark, d):
    return A.nearest_rank(load(spark, d, "events"), ["user_id"], "value", 0.95)


@query("""SELECT user_id, n, failures, CAST(n - failures AS DOUBLE) / n AS rate, CASE WHEN n > 100 AND CAST(n - failures AS DOUBLE) / n < 0.3 THEN 0.8 WHEN n > 100 AND CAST(n - failures AS DOUBLE) / n > 0.8 THEN 1.2 ELSE 1.0 END::DOUBLE AS factor
  FROM (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS failures FROM events GROUP BY user_id)""")
def usage_stats(spark, d):
    own = load(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("failures"))
    rate = (F.col("n") - F.col("failures")) / F.col("n")
    return own.withColumn("rate", rate).withColumn("factor", F.when((F.col("n") > 100) & (F.col("rate") < 0.3), 0.8).when((F.col("n") > 100) & (F.col("rate") > 0.8), 1.2).otherwise(1.0))


@query("""SELECT event_type, dow, count(*) AS n, round(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE), 2) AS total FROM (SELECT event_type, CAST(isodow(ts) AS VARCHAR) AS dow, value FROM events) GROUP BY GROUPING SETS ((event_type, dow), (event_type), (dow), ())""")
def grouping_sets_metrics(spark, d):
    own = load(spark, d, "events").select("event_type", (F.weekday("ts") + 1).cast("string").alias("dow"), "value")
    return A.totals_by_sets(own, [["event_type", "dow"], ["event_type"], ["dow"], []], [F.count("*").alias("n"), F.round(F.sum(F.col("value").cast("decimal(18,2)")).cast("double"), 2).alias("total")]).select("event_type", "dow", "n", "total")


@query("""SELECT event_type, attempts, successes, CAST(successes AS DOUBLE) / attempts AS rate FROM (SELECT event_type, count(*) AS attempts, count(*) FILTER (value > 50) AS successes FROM events GROUP BY ROLLUP (event_type))""")
def recovery_rollup(spark, d):
    own = load(spark, d, "events").rollup("event_type").agg(F.count("*").alias("attempts"), F.count_if(F.col("value") > 50).alias("successes"))
    return own.select("event_type", "attempts", "successes", (F.col("successes") / F.col("attempts")).alias("rate"))


@query("""SELECT user_id, n FROM (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY user_id HAVING count(*) >= 3) e WHERE NOT EXISTS (SELECT 1 FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.value > 480)""")
def error_recommendations(spark, d):
    e = load(spark, d, "events")
    errors = A.count_by(e.where("event_type = 'error'"), "user_id").where("n >= 3")
    return A.missing(errors, e.where("event_type = 'purchase' and value > 480"), ["user_id"])


@query("""SELECT user_id, CASE WHEN r = 0 THEN 'ok' WHEN r < 0.1 THEN 'degraded' WHEN r < 0.3 THEN 'error' ELSE 'critical' END AS status FROM (SELECT user_id, CAST(count(*) FILTER (event_type = 'error') AS DOUBLE) / count(*) AS r FROM events GROUP BY user_id)""")
def component_status(spark, d):
    own = load(spark, d, "events").groupBy("user_id").agg((F.count_if(F.col("event_type") == "error") / F.count("*")).alias("r"))
    return own.select("user_id", T.status_of_rate(F.col("r")).alias("status"))


@query("""SELECT max(CASE WHEN r = 0 THEN 0 WHEN r < 0.1 THEN 1 WHEN r < 0.3 THEN 2 ELSE 3 END)::BIGINT AS worst FROM (SELECT CAST(count(*) FILTER (event_type = 'error') AS DOUBLE) / count(*) AS r FROM events GROUP BY user_id)""")
def system_status(spark, d):
    own = component_status(spark, d)
    rank = F.when(F.col("status") == "ok", 0).when(F.col("status") == "degraded", 1).when(F.col("status") == "error", 2).otherwise(3)
    return own.agg(F.max(rank).cast("long").alias("worst"))


@query("""SELECT event_type, hits, misses, rate, CASE WHEN rate > 0.9 THEN 'increase' WHEN rate < 0.5 THEN 'decrease' ELSE 'keep' END AS ttl FROM (SELECT *, coalesce(CAST(hits AS DOUBLE) / nullif(hits + misses, 0), 0.0) AS rate
  FROM (SELECT event_type, count(*) FILTER (value >= 25) AS hits, count(*) FILTER (value < 25) AS misses FROM events GROUP BY event_type))""")
def hit_rates(spark, d):
    own = load(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") >= 25).alias("hits"), F.count_if(F.col("value") < 25).alias("misses"))
    rate = F.coalesce(F.try_divide(F.col("hits"), F.col("hits") + F.col("misses")), F.lit(0.0))
    return own.withColumn("rate", rate).withColumn("ttl", F.when(F.col("rate") > 0.9, "increase").when(F.col("rate") < 0.5, "decrease").otherwise("keep"))


@query("""SELECT user_id, round(slope, 6) AS slope, CASE WHEN slope IS NOT NULL THEN round(greatest(0, least(1, (sy - slope * sx) / n + slope * 60)), 6) END AS forecast FROM (SELECT *, (n * sxy - sx * sy) / nullif(n * sxx - sx * sx, 0) AS slope FROM (
  SELECT user_id, CAST(count(*) AS DOUBLE) AS n, CAST(sum(x) AS DOUBLE) AS sx, CAST(sum(y) AS DOUBLE) AS sy, CAST(sum(x * x) AS DOUBLE) AS sxx, CAST(sum(CAST(x * y AS DECIMAL(28,2))) AS DOUBLE) AS sxy FROM (SELECT user_id, CAST(value AS DECIMAL(18,2)) AS y, CAST(floor(epoch(ts)) AS BIGINT) % 3600 AS x FROM events WHERE value IS NOT NULL) GROUP BY user_id))""")
def usage_forecast(spark, d):
    own = load(spark, d, "events").select("user_id", "value", (F.unix_timestamp(F.col("ts").cast("timestamp")) % 3600).alias("x"))
    fit = A.line_fit(own, ["user_id"], "x", "value", 60.0)
    return fit.select("user_id", F.round("slope", 6).alias("slope"), F.round("forecast", 6).alias("forecast"))


@query("""SELECT event_type, user_id, n FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) AS r FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY event_type, user_id)) WHERE r <= 10""")
def contention_top(spark, d):
    return A.top_per_key(A.count_by(load(spark, d, "events"), "event_type", "user_id"), ["event_type"], [F.desc("n"), F.col("user_id")], 10).drop("place")


@query("""SELECT p_brand, l_partkey, n FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, l_partkey) AS r FROM (SELECT p_brand, l_partkey, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand, l_partkey)) WHERE r <= 5""")
def lateral_top5(spark, d):
    used = A.count_by(load(spark, d, "lineitem"), "l_partkey").join(load(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return A.top_per_key(used, ["p_brand"], [F.desc("n"), F.col("l_partkey")], 5).select("p_brand", "l_partkey", "n")


@query("""SELECT language, parser_type, members, rows FROM (SELECT language, parser_type, count(DISTINCT repo_id) AS members, count(*) AS rows FROM (SELECT DISTINCT repo_id, file_path, file_content, language, parser_type FROM code_files) GROUP BY language, parser_type) WHERE members >= 2""")
def cross_repo_common(spark, d):
    return A.common_groups(files(spark, d), ["language", "parser_type"], "repo_id")


@query("""WITH x AS (SELECT DISTINCT repo_id AS k, language AS m FROM code_files WHERE repo_id IS NOT NULL AND language IS NOT NULL), s AS (SELECT k, count(*) AS size FROM x GROUP BY k)
  SELECT a.k AS key_a, b.k AS key_b, count(*) AS shared, CAST(count(*) AS DOUBLE) / (max(sa.size) + max(sb.size) - count(*)) AS similarity FROM x a JOIN x b ON a.m = b.m AND a.k < b.k JOIN s sa ON sa.k = a.k JOIN s sb ON sb.k = b.k GROUP BY a.k, b.k""")
def repo_language_similarity(spark, d):
    return A.members_in_common(load(spark, d, "code_files"), "repo_id", "language")


@query("""WITH x AS (SELECT DISTINCT l_suppkey AS k, l_partkey AS m FROM lineitem), s AS (SELECT k, count(*) AS size FROM x GROUP BY k)
  SELECT key_a, key_b, shared, similarity FROM (SELECT a.k AS key_a, b.k AS key_b, count(*) AS shared, CAST(count(*) AS DOUBLE) / (max(sa.size) + max(sb.size) - count(*)) AS similarity FROM x a JOIN x b ON a.m = b.m AND a.k < b.k JOIN s sa ON sa.k = a.k JOIN s sb ON sb.k = b.k GROUP BY a.k, b.k) WHERE similarity >= 0.05""")
def node_similarity(spark, d):
    return A.members_in_common(load(spark, d, "lineitem"), "l_suppkey", "l_partkey", 0.05)


@query("""SELECT r.repo_id, coalesce(languages, '') AS languages, coalesce(doc_types, '') AS doc_types FROM (SELECT DISTINCT id AS repo_id FROM repositories) r
  LEFT JOIN (SELECT repo_id, string_agg(language, '|' ORDER BY language) AS languages FROM (SELECT DISTINCT repo_id, language FROM code_files WHERE language IS NOT NULL) GROUP BY repo_id) l ON l.repo_id = r.repo_id
  LEFT JOIN (SELECT repo_id, string_agg(doc_type, '|' ORDER BY doc_type) AS doc_types FROM (SELECT DISTINCT x.repo_id, lower(trim(d.doc_type)) AS doc_type FROM repo_doc_relations x JOIN repo_docs d ON d.id = x.doc_id WHERE d.doc_type IS NOT NULL) GROUP BY repo_id) t ON t.repo_id = r.repo_id""")
def repo_children(spark, d):
    repos = load(spark, d, "repositories").select(F.col("id").alias("repo_id")).distinct()
    kinds = relations(spark, d).join(load(spark, d, "repo_docs").select(F.col("id").alias("doc_id"), F.lower(F.trim("doc_type")).alias("doc_type")), "doc_id")
    return A.with_children(repos, "repo_id", [(load(spark, d, "code_files"), "language", "languages"), (kinds, "doc_type", "doc_types")])


@query("SELECT o_orderpriority, p_brand, n FROM (SELECT o_orderpriority, p_brand, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY ALL) QUALIFY row_number() OVER (ORDER BY n DESC, o_orderpriority, p_brand) <= 20")
def top_pairs(spark, d):
    lines = load(spark, d, "lineitem").join(load(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(load(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return A.count_by(lines, "o_orderpriority", "p_brand").orderBy(F.desc("n"), "o_orderpriority", "p_brand").limit(20)


# ---------------------------------------------------------------- windows


@query("""SELECT event_id, CAST(sum(CAST(value AS DECIMAL(18,2))) OVER w AS DOUBLE) / count(value) OVER w AS rolling_mean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)""")
def rolling_100(spark, d):
    return W.rolling_mean(load(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value", 100).select("event_id", "rolling_mean")


@query("""SELECT event_id, CAST(sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER w AS DOUBLE) / count(*) OVER w AS running_rate FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def running_success(spark, d):
    own = load(spark, d, "events").withColumn("hit", F.col("event_type") != "error")
    return W.running_rate(own, ["user_id"], ["ts", "event_id"], "hit").select("event_id", "running_rate")


@query("""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 300 PRECEDING AND CURRENT ROW) AS recent FROM (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events)""")
def recent_300s(spark, d):
    own = load(spark, d, "events").withColumn("s", F.unix_timestamp(F.col("ts").cast("timestamp")))
    return W.recent(own, ["user_id"], "s", 300).select("event_id", "recent")


@query("""SELECT user_id, n, round(power(0.9::DOUBLE, n) + 0.1 * s, 9) AS rate FROM (SELECT user_id, count(*) AS n, sum(power(0.9::DOUBLE, p) * h) AS s FROM (SELECT user_id, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS h, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS p FROM events) GROUP BY user_id)""")
def ema_success(spark, d):
    own = load(spark, d, "events").withColumn("hit", F.col("event_type") != "error")
    return W.exponential_rate(own, ["user_id"], ["ts", "event_id"], "hit").select("user_id", "n", F.round("rate", 9).alias("rate"))


@query("SELECT id, CAST(coalesce(max(version), 0) + 1 AS BIGINT) AS next_version FROM repo_docs GROUP BY id")
def doc_next_version(spark, d):
    return W.next_version(load(spark, d, "repo_docs"), "id", "version")


@query("""SELECT doc_id, part, substr(text, CAST(part * 400 + 1 AS BIGINT), 500) AS chunk FROM (SELECT doc_id, text, unnest(range(0, greatest(0, CAST(floor((length(text) - 101) / 400) AS BIGINT)) + 1)) AS part FROM documents WHERE length(text) > 0)""")
def overlapping_chunks(spark, d):
    return W.text_windows(load(spark, d, "documents"), "doc_id", "text", 500, 100)


# ---------------------------------------------------------------- upserts


@query("""SELECT trim(lower(repo_name)) AS repo_name, id, repo_type FROM (SELECT *, row_number() OVER (PARTITION BY trim(lower(repo_name)) ORDER BY last_updated DESC, id DESC, repo_type) AS r FROM repositories) WHERE r = 1""")
def upsert_repositories(spark, d):
    own = load(spark, d, "repositories").withColumn("repo_name", F.trim(F.lower("repo_name")))
    return K.latest_by_key(own, ["repo_name"], [F.desc("last_updated"), F.desc("id"), F.col("repo_type")]).select("repo_name", "id", "repo_type")


@query("""SELECT repo_id, file_path, max(id) AS id FROM code_snippets WHERE repo_id IS NOT NULL AND file_path IS NOT NULL GROUP BY repo_id, file_path""")
def upsert_snippets(spark, d):
    own = load(spark, d, "code_snippets").where("repo_id is not null and file_path is not null").select("repo_id", "file_path", "id")
    old, new = own.where("id % 2 = 0"), own.where("id % 2 = 1")
    both = K.upsert(old, new.unionByName(A.present(old, new, ["repo_id", "file_path"])), ["repo_id", "file_path"], [F.desc("id")])
    return K.latest_by_key(both, ["repo_id", "file_path"], [F.desc("id")])


@query("""SELECT DISTINCT CAST(1 AS BIGINT) AS repo_id, doc_id FROM repo_doc_relations r WHERE repo_id <> 1 AND doc_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM repo_doc_relations x WHERE x.repo_id = 1 AND x.doc_id = r.doc_id)""")
def share_docs(spark, d):
    rel = relations(spark, d).where("doc_id is not null")
    return K.insert_missing(rel.where("repo_id = 1"), rel.where("repo_id <> 1").select(F.lit(1).cast("long").alias("repo_id"), "doc_id"), ["repo_id", "doc_id"])


@query("""SELECT user_id, count(*) AS uses, CAST(epoch_us(max(ts)) AS BIGINT) AS last_used FROM events GROUP BY user_id""")
def usage_accumulate(spark, d):
    e = load(spark, d, "events").withColumn("last_used", F.unix_micros(F.col("ts").cast("timestamp")))
    old = e.where("event_id % 2 = 0").groupBy("user_id").agg(F.count("*").alias("uses"), F.max("last_used").alias("last_used"))
    return K.accumulate(old, e.where("event_id % 2 = 1"), ["user_id"], "uses", "last_used")


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) UNION ALL SELECT DISTINCT -c_custkey, c_custkey FROM customer WHERE c_acctbal < 0""")
def replace_groups(spark, d):
    new = load(spark, d, "customer").where("c_acctbal < 0").select((-F.col("c_custkey")).alias("o_orderkey"), F.col("c_custkey").alias("o_custkey")).distinct()
    return K.replace_groups(load(spark, d, "orders").select("o_orderkey", "o_custkey"), new, ["o_custkey"])


@query("""SELECT user_id, coalesce(b, a) AS k FROM (SELECT user_id, max(json_extract_string(props, '$.k')) FILTER (event_type = 'click') AS a, max(json_extract_string(props, '$.k')) FILTER (event_type = 'purchase') AS b FROM events GROUP BY user_id)""")
def property_merge(spark, d):
    e = load(spark, d, "events").select("user_id", "event_type", F.get_json_object("props", "$.k").alias("k"))
    side = lambda t: e.where(F.col("event_type") == t).groupBy("user_id").agg(F.create_map(F.lit("k"), F.max("k")).alias("props"))
    merged = K.merge_properties(side("click"), side("purchase"), "user_id")
    return e.select("user_id").distinct().join(merged, "user_id", "left").select("user_id", F.col("props")["k"].alias("k"))


@query(f"""SELECT DISTINCT src, dst, 'NEXT' AS type FROM ({_EDGES}) WHERE src IN (SELECT p_partkey FROM part WHERE p_size > 40) AND dst IN (SELECT p_partkey FROM part WHERE p_size > 40)""")
def merge_edges(spark, d):
    nodes = load(spark, d, "part").where("p_size > 40").select(F.col("p_partkey").alias("id"))
    return K.merge_edges(nodes, part_edges(spark, d).withColumn("type", F.lit("NEXT")))


@query("""SELECT repo_id, string_agg(language, '|' ORDER BY language) AS languages FROM (SELECT DISTINCT repo_id, language FROM code_files WHERE language IS NOT NULL) GROUP BY repo_id""")
def union_languages(spark, d):
    # The languages of the files a tree parser reads, united with those of all others.
    own = load(spark, d, "code_files").where("language is not null")
    listed = lambda part: part.groupBy("repo_id").agg(F.collect_set("language").alias("languages"))
    trees = F.coalesce(F.col("parser_type"), F.lit("")) == "tree_sitter"
    return K.union_arrays(listed(own.where(trees)), listed(own.where(~trees)), "repo_id", "languages").select("repo_id", F.array_join("languages", "|").alias("languages"))


# ---------------------------------------------------------------- graphs


@query(f"SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o + i) AS BIGINT) AS degree FROM (SELECT src AS node, 1 AS o, 0 AS i FROM ({_EDGES}) UNION ALL SELECT dst, 0, 1 FROM ({_EDGES})) GROUP BY node")
def degree(spark, d):
    return G.degrees(part_edges(spark, d))


@query(f"SELECT DISTINCT src AS node, dst AS neighbour FROM (SELECT src, dst FROM ({_EDGES}) UNION ALL SELECT dst, src FROM ({_EDGES})) WHERE src IN (SELECT p_partkey FROM part WHERE p_size = 1)")
def related_parts(spark, d):
    return G.neighbours(part_edges(spark, d), load(spark, d, "part").where("p_size = 1").select(F.col("p_partkey").alias("node")), undirected=True)


@query(f"""WITH RECURSIVE e AS (SELECT DISTINCT a.src, a.dst FROM ({_EDGES}) a JOIN part p ON p.p_partkey = a.src AND p.p_size <= 3 JOIN part q ON q.p_partkey = a.dst AND q.p_size <= 3),
  w AS (SELECT p_partkey AS start, p_partkey AS node, 0 AS steps, [p_partkey] AS path FROM part WHERE p_size = 1
    UNION ALL SELECT w.start, e.dst, w.steps + 1, list_append(w.path, e.dst) FROM w JOIN e ON e.src = w.node WHERE w.steps < 3 AND NOT list_contains(list_transform(range(1, len(w.path)), lambda i: (w.path[i], w.path[i + 1])), (e.src, e.dst)))
  SELECT start, node, CAST(steps AS BIGINT) AS steps, array_to_string(path, '>') AS path FROM w WHERE steps > 0""")
def reachable_depth3(spark, d):
    small = load(spark, d, "part").where("p_size <= 3").select(F.col("p_partkey").alias("id"), "p_size")
    _, edges = G.project_subgraph(small, part_edges(spark, d), F.lit(True))
    return G.paths(edges, small.where("p_size = 1").select(F.col("id").alias("node")), 3)


_RANK = "WITH l AS (SELECT DISTINCT src, dst FROM (%s)), o AS (SELECT src, count(*) AS n FROM l GROUP BY src), v AS (SELECT src AS node FROM l UNION SELECT dst FROM l), r0 AS (SELECT node, 1.0::DOUBLE AS rank FROM v)" % _EDGES
for _i in range(1, 11):
    _RANK += f", r{_i} AS (SELECT v.node, 0.15 + 0.85 * coalesce(s, 0) AS rank FROM v LEFT JOIN (SELECT l.dst, sum(r.rank / o.n) AS s FROM l JOIN o ON o.src = l.src JOIN r{_i - 1} r ON r.node = l.src GROUP BY l.dst) x ON x.dst = v.node)"


@query(_RANK + " SELECT node, round(rank, 6) AS rank FROM r10")
def pagerank(spark, d):
    return G.pagerank(part_edges(spark, d), rounds=10).select("node", F.round("rank", 6).alias("rank"))


@query()
def communities(spark, d):
    return G.label_propagation(part_edges(spark, d))


@query()
def betweenness(spark, d):
    return G.betweenness(part_edges(spark, d)).select("node", F.round("score", 6).alias("score"))


@query(f"""WITH e AS (SELECT DISTINCT a.src, a.dst FROM ({_EDGES}) a JOIN part p ON p.p_partkey = a.src AND p.p_size <= 5 JOIN part q ON q.p_partkey = a.dst AND q.p_size <= 5),
  s2 AS (SELECT DISTINCT a.src AS start, b.dst AS node FROM e a JOIN e b ON a.dst = b.src WHERE a.src <> a.dst), s3 AS (SELECT DISTINCT s2.start, e.dst AS node FROM s2 JOIN e ON e.src = s2.node WHERE s2.start <> s2.node)
  SELECT node, min(steps) AS steps FROM (SELECT src AS node, 1::BIGINT AS steps FROM e WHERE src = dst UNION ALL SELECT start, 2 FROM s2 WHERE start = node UNION ALL SELECT start, 3 FROM s3 WHERE start = node) GROUP BY node""")
def cycles(spark, d):
    small = load(spark, d, "part").where("p_size <= 5").select(F.col("p_partkey").alias("id"))
    _, edges = G.project_subgraph(small, part_edges(spark, d), F.lit(True))
    return G.nodes_on_cycles(edges, 3)


# The SQL of `reachable_depth3` and `cycles` asks for parts of small sizes; these take every edge.
@query()
def reachable_depth3_whole(spark, d):
    return G.paths(part_edges(spark, d), load(spark, d, "part").where("p_size = 1").select(F.col("p_partkey").alias("node")), 3)


@query()
def cycles_whole(spark, d):
    return G.nodes_on_cycles(part_edges(spark, d), 3)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) <= 1.0),
  c AS (SELECT a AS id, a AS cluster FROM e UNION SELECT e.b, c.cluster FROM c JOIN e ON e.a = c.id) SELECT id, min(cluster) AS cluster FROM c GROUP BY id""")
def dbscan_clusters(spark, d):
    return G.density_clusters(load(spark, d, "embeddings"), "vec_id", "embedding", 1.0)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT id AS a, active_repo_id AS b FROM repositories WHERE active_repo_id IS NOT NULL), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
  c AS (SELECT a AS node, a AS component FROM u UNION SELECT u.b, c.component FROM c JOIN u ON u.a = c.node) SELECT node, min(component) AS component FROM c GROUP BY node""")
def repository_groups(spark, d):
    return connected_components(load(spark, d, "repositories"), "id", "active_repo_id")


# ---------------------------------------------------------------- texts


_QUALITY = f"""SELECT id, words / 100.0::DOUBLE AS completeness, contains(content, '```') AS has_examples, contains(content, '#') AS has_sections, CASE WHEN len(l) = 0 THEN 0.0 ELSE CAST(len(list_filter(l, lambda x: starts_with(ltrim(x), '#'))) AS DOUBLE) / len(l) END AS structure
  FROM (SELECT id, content, CASE WHEN t = '' THEN [] ELSE string_split(regexp_replace(t, '\\n$', ''), chr(10)) END AS l, CASE WHEN trim(regexp_replace(content, '\\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(content, '\\s+', ' ', 'g')), ' ')) END AS words
    FROM (SELECT id, content, replace(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(9), ' ') AS t FROM ({_DOCS}) WHERE content IS NOT NULL))"""


def quality(spark, d):
    c = F.col("content")
    return docs(spark, d).where("content is not null").select("id", T.completeness(c).alias("completeness"), F.contains(c, F.lit("```")).alias("has_examples"), F.contains(c, F.lit("#")).alias("has_sections"), T.structure(c).alias("structure"))


@query(_QUALITY)
def doc_quality(spark, d):
    return quality(spark, d)


@query(f"""WITH q AS ({_QUALITY}) SELECT id AS doc_id, 'completeness' AS type, 'Add more detailed explanations and examples' AS suggestion FROM q WHERE completeness < 0.7 UNION ALL SELECT id, 'structure', 'Improve document structure with headers and sections' FROM q WHERE structure < 0.7""")
def doc_suggestions(spark, d):
    found = F.array_compact(F.array(
        F.when(F.col("completeness") < 0.7, F.struct(F.lit("completeness").alias("type"), F.lit("Add more detailed explanations and examples").alias("suggestion"))),
        F.when(F.col("structure") < 0.7, F.struct(F.lit("structure").alias("type"), F.lit("Improve document structure with headers and sections").alias("suggestion"))),
    ))
    return quality(spark, d).select(F.col("id").alias("doc_id"), F.explode(found).alias("s")).select("doc_id", "s.*")


@query("""SELECT lower(title) AS title, count(*) AS n FROM (SELECT trim(regexp_extract(trim(l), '^# (.*)$', 1)) AS title FROM (SELECT unnest(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) AS l FROM documents WHERE text IS NOT NULL) WHERE regexp_matches(trim(l), '^# ')) GROUP BY lower(title)""")
def heading_counts(spark, d):
    return R.headings(load(spark, d, "documents"), ["doc_id"], "text").where("level = 1").select(F.lower("title").alias("title")).groupBy("title").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, count(*) AS blocks FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?s)```(\\w+)?\\n(.*?)\\n```')) AS b FROM documents) GROUP BY doc_id""")
def code_block_counts(spark, d):
    return R.code_blocks(load(spark, d, "documents"), ["doc_id"], "text").groupBy("doc_id").agg(F.count("*").alias("blocks"))


_COUNTED = {"link": r"\[([^\]]+)\]\(([^)]+)\)", "inline_code": r"`([^`]+)`", "version": r"v?(\d+\.\d+\.\d+(?:-[a-zA-Z0-9]+)?)", "list_item": r"(?m)^[*+-]\s+(.+)$"}


@query(" UNION ALL ".join(f"SELECT doc_id, '{n}' AS pattern, len(regexp_extract_all(text, '{p}')) AS n FROM documents WHERE len(regexp_extract_all(text, '{p}')) > 0" for n, p in _COUNTED.items()))
def pattern_counts(spark, d):
    own = {n: p.replace("(?m)", "") for n, p in _COUNTED.items()}
    own["version"] = r"v?([0-9]+\.[0-9]+\.[0-9]+(?:-[a-zA-Z0-9]+)?)"
    return R.pattern_counts(load(spark, d, "documents"), ["doc_id"], "text", own)


@query()
def common_catalogue(spark, d):
    one = files(spark, d).where("file_content is not null").select("repo_id", "file_path", "file_content")
    return R.pattern_counts(one, ["repo_id", "file_path"], "file_content", PATTERNS["common"])


@query()
def markdown_catalogue(spark, d):
    return R.pattern_counts(docs(spark, d), ["id"], "content", PATTERNS["markdown"] | {f"text_{k}": v for k, v in PATTERNS["plaintext"].items()})


@query()
def format_catalogues(spark, d):
    others = ("common", "markdown", "plaintext")  # of `common_catalogue` and `markdown_catalogue`
    parts = {f"{fmt}.{name}": p for fmt, own in PATTERNS.items() if fmt not in others for name, p in own.items()}
    return R.pattern_counts(docs(spark, d), ["id"], "content", parts)


@query()
def todo_spans(spark, d):
    one = files(spark, d).where("file_content is not null").select(F.concat_ws(":", "repo_id", "file_path").alias("file"), "file_content")
    found = R.pattern_matches(one, "file", "file_content", {k: PATTERNS["common"][k] for k in ("todo_comment", "fixme_comment", "docstring", "class_definition")})
    return found.select("file", "pattern", "first", "last", "line")


@query()
def try_and_decorators(spark, d):
    one = files(spark, d).where("language = 'python' and file_content is not null").select("repo_id", "file_path", "file_content").dropDuplicates(["repo_id", "file_path"])
    return A.count_by(R.decorated_functions(one, ["repo_id", "file_path"], "file_content"), "repo_id", "kind")


@query("""SELECT repo_id, file_path, total, blank, comment, total - blank - comment AS code FROM (SELECT repo_id, file_path, len(l) AS total, len(list_filter(l, lambda x: x = '')) AS blank, len(list_filter(l, lambda x: starts_with(x, '//') OR starts_with(x, '#'))) AS comment FROM (
  SELECT repo_id, file_path, CASE WHEN t = '' THEN [] ELSE list_transform(string_split(regexp_replace(t, '\\n$', ''), chr(10)), lambda x: trim(replace(x, chr(9), ' '))) END AS l FROM (
    SELECT DISTINCT repo_id, file_path, replace(replace(file_content, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM code_files WHERE file_content IS NOT NULL)))""")
def line_counts(spark, d):
    unified = F.regexp_replace("file_content", "\\r\\n|\\r", "\n")
    one = load(spark, d, "code_files").where("file_content is not null").select("repo_id", "file_path", unified.alias("t")).distinct()
    return one.select("repo_id", "file_path", T.line_counts(F.col("t")).alias("c")).select("repo_id", "file_path", "c.*")


_ENDING = "lower(regexp_extract(regexp_extract(replace(file_path, '\\', '/'), '([^/]*)$', 1), '[^.].*\\.([^.]*)$', 1))"


@query(f"""SELECT ending, count(*) AS n FROM (SELECT {_ENDING} AS ending FROM (SELECT DISTINCT repo_id, file_path FROM code_files)) GROUP BY ending""")
def files_by_ending(spark, d):
    one = load(spark, d, "code_files").select("repo_id", "file_path").distinct()
    return A.count_by(one.select(T.extension(F.col("file_path")).alias("ending")), "ending")


@query(f"""SELECT language, kind, count(*) AS n FROM (SELECT CASE WHEN e = 'py' THEN 'python' WHEN e IN ('js', 'jsx') THEN 'javascript' WHEN e IN ('ts', 'tsx') THEN 'typescript' WHEN e IN ('c', 'h') THEN 'c' WHEN e IN ('cpp', 'hpp') THEN 'cpp' WHEN e = 'cs' THEN 'c_sharp' WHEN e = 'rb' THEN 'ruby' WHEN e = 'rs' THEN 'rust' WHEN e = 'kt' THEN 'kotlin'
  WHEN e IN ('java', 'go', 'php', 'html', 'css', 'swift') THEN e ELSE 'unknown' END AS language, CASE WHEN e IN ('py', 'js', 'ts', 'java', 'c', 'cpp', 'cs', 'go', 'rb', 'php', 'rs', 'swift', 'kt') THEN 'source' WHEN e IN ('h', 'hpp', 'hxx') THEN 'header' WHEN e IN ('json', 'xml', 'yaml', 'yml', 'toml') THEN 'config'
  WHEN e IN ('md', 'rst', 'txt') THEN 'documentation' WHEN e IN ('html', 'css') THEN 'markup' WHEN e IN ('sh', 'bat', 'ps1') OR b IN ('makefile', 'dockerfile', 'jenkinsfile') THEN 'build' ELSE 'other' END AS kind
  FROM (SELECT {_ENDING} AS e, lower(regexp_extract(replace(file_path, '\\', '/'), '([^/]*)$', 1)) AS b FROM (SELECT DISTINCT repo_id, file_path FROM code_files))) GROUP BY language, kind""")
def files_by_kind(spark, d):
    one = load(spark, d, "code_files").select("repo_id", "file_path").distinct()
    return A.count_by(one.select(T.language_of(F.col("file_path")).alias("language"), T.kind_of(F.col("file_path")).alias("kind")), "language", "kind")


@query("""SELECT repo_id, part, count(*) AS files FROM (SELECT repo_id, file_path, unnest(list_distinct(string_split(file_path, '/')[:-2])) AS part FROM (SELECT DISTINCT repo_id, replace(file_path, '\\', '/') AS file_path FROM code_files)) GROUP BY repo_id, part""")
def directory_parts(spark, d):
    one = load(spark, d, "code_files").select("repo_id", F.translate("file_path", "\\", "/").alias("file_path")).distinct()
    parts = F.split("file_path", "/")
    return one.select("repo_id", F.explode(F.array_distinct(F.slice(parts, F.lit(1), F.size(parts) - 1))).alias("part")).groupBy("repo_id", "part").agg(F.count("*").alias("files"))


@query("""SELECT count(*) FILTER (ignored) AS ignored, count(*) FILTER (NOT ignored) AS kept FROM (SELECT len(list_intersect(string_split(replace(file_path, '\\', '/'), '/'), ['*.tmp', '*.log', '*.pyc', '__pycache__', 'node_modules', '.git', '.env', '*.swp', '*.swo'])) > 0 AS ignored FROM (SELECT DISTINCT repo_id, file_path FROM code_files))""")
def ignored_files(spark, d):
    one = load(spark, d, "code_files").select("repo_id", "file_path").distinct().withColumn("i", T.is_ignored(F.col("file_path")))
    return one.agg(F.count_if("i").alias("ignored"), F.count_if(~F.col("i")).alias("kept"))


@query("""WITH f AS (SELECT DISTINCT repo_id, file_path, regexp_extract(replace(file_path, '\\', '/'), '([^/.]*)[^/]*$', 1) AS s FROM code_files),
  c AS (SELECT repo_id, file_path, CASE WHEN regexp_matches(s, '^[a-z][a-zA-Z0-9]*$') AND regexp_matches(s, '[A-Z]') THEN 'camelCase' WHEN regexp_matches(s, '^[a-z][a-z0-9_]*$') AND contains(s, '_') THEN 'snake_case' WHEN regexp_matches(s, '^[a-z][a-z0-9-]*$') AND contains(s, '-') THEN 'kebab-case'
    WHEN regexp_matches(s, '^[A-Z][a-zA-Z0-9]*$') THEN 'PascalCase' WHEN regexp_matches(s, '^[A-Z][A-Z0-9_]*$') AND contains(s, '_') THEN 'UPPER_CASE' WHEN regexp_matches(s, '^[a-z][a-z0-9]*$') THEN 'lowercase' END AS convention FROM f)
  SELECT repo_id, convention, n FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, first) AS r FROM (SELECT repo_id, convention, count(*) AS n, min(file_path) AS first FROM c WHERE convention IS NOT NULL GROUP BY repo_id, convention)) WHERE r = 1""")
def naming_convention(spark, d):
    stem = F.regexp_extract(F.translate("file_path", "\\", "/"), "([^/.]*)[^/]*$", 1)
    one = load(spark, d, "code_files").select("repo_id", "file_path").distinct().select("repo_id", "file_path", T.naming_convention(stem).alias("convention"))
    # Ties go to the convention that is seen first, in the order of the paths.
    counted = one.where("convention is not null").groupBy("repo_id", "convention").agg(F.count("*").alias("n"), F.min("file_path").alias("first"))
    return A.top_per_key(counted, ["repo_id"], [F.desc("n"), F.col("first")], 1).select("repo_id", "convention", "n")


@query()
def learned_patterns(spark, d):
    one = load(spark, d, "documents").select("source", "doc_kind").distinct()
    return L.learned_patterns(one.where("doc_kind is not null"), "doc_kind", "source")


@query("SELECT DISTINCT id, regexp_replace(regexp_extract(regexp_replace(source_url, '/+$', ''), '([^/]+)$', 1), '\\.git$', '') AS name FROM repositories WHERE source_url IS NOT NULL")
def repo_names(spark, d):
    return load(spark, d, "repositories").where("source_url is not null").select("id", T.repo_name_of(F.col("source_url")).alias("name")).distinct()


# ---------------------------------------------------------------- further bindings


@query("""SELECT repo_id, prefix, count(*) AS files FROM (SELECT repo_id, unnest(list_transform(range(1, len(parts)), lambda n: array_to_string(parts[1:n], '/'))) AS prefix FROM (SELECT repo_id, string_split(replace(file_path, '\\', '/'), '/') AS parts FROM (SELECT DISTINCT repo_id, file_path FROM code_files))) GROUP BY repo_id, prefix""")
def directory_tree(spark, d):
    one = load(spark, d, "code_files").select("repo_id", "file_path").distinct()
    return A.count_by(one.select("repo_id", F.explode(T.path_prefixes(F.col("file_path"))).alias("prefix")), "repo_id", "prefix").withColumnRenamed("n", "files")


@query("""WITH w AS (SELECT DISTINCT regexp_extract(replace(file_path, '\\', '/'), '([^/.]*)[^/]*$', 1) AS w FROM code_files), c AS (SELECT w, CASE WHEN regexp_matches(lower(w), 'host|server|url|endpoint') THEN 'connection' WHEN regexp_matches(lower(w), 'user|password|auth|token|key|secret') THEN 'authentication' WHEN regexp_matches(lower(w), 'log|debug|verbose|trace') THEN 'logging'
  WHEN regexp_matches(lower(w), 'dir|path|file|folder') THEN 'filesystem' WHEN regexp_matches(lower(w), 'port|timeout|retry|max|min') THEN 'connection_params' WHEN regexp_matches(lower(w), 'enable|disable|toggle|feature') THEN 'feature_flags' ELSE 'other' END AS class FROM w)
  SELECT class, count(*) AS n, string_agg(w, '|' ORDER BY w) FILTER (r <= 3) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY w) AS r FROM c) GROUP BY class""")
def option_classes(spark, d):
    stem = F.regexp_extract(F.translate("file_path", "\\", "/"), "([^/.]*)[^/]*$", 1)
    named = load(spark, d, "code_files").select(stem.alias("w")).distinct().select("w", T.option_class(F.col("w")).alias("class"))
    least = A.top_per_key(named, ["class"], [F.col("w")], 3).groupBy("class").agg(F.array_join(F.array_sort(F.collect_list("w")), "|").alias("examples"))
    return A.count_by(named, "class").join(least, "class")


@query(f"""SELECT id, array_to_string(list_sort(list_distinct(regexp_extract_all(content, '@([a-zA-Z0-9._]+)', 1))), '|') AS names FROM ({_DOCS}) WHERE content LIKE '%@%'""")
def capture_names(spark, d):
    return docs(spark, d).where(F.contains("content", F.lit("@"))).select("id", F.array_join(T.capture_names(F.col("content")), "|").alias("names"))


@query("""WITH x AS (SELECT DISTINCT repo_id AS k, language AS m FROM code_files WHERE repo_id IS NOT NULL AND language IS NOT NULL), s AS (SELECT k, count(*) AS size FROM x GROUP BY k),
  j AS (SELECT a.k AS key_a, b.k AS key_b, CAST(count(*) AS DOUBLE) / (max(sa.size) + max(sb.size) - count(*)) AS similarity FROM x a JOIN x b ON a.m = b.m AND a.k < b.k JOIN s sa ON sa.k = a.k JOIN s sb ON sb.k = b.k GROUP BY a.k, b.k)
  SELECT repo_id, related_repo_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY similarity DESC, related_repo_id) AS r FROM (SELECT key_a AS repo_id, key_b AS related_repo_id, similarity FROM j UNION ALL SELECT key_b, key_a, similarity FROM j) WHERE similarity > 0.3) WHERE r <= 5""")
def similar_repositories(spark, d):
    pairs = A.members_in_common(load(spark, d, "code_files"), "repo_id", "language").where("similarity > 0.3")
    both = pairs.selectExpr("key_a AS repo_id", "key_b AS related_repo_id", "similarity").unionByName(pairs.selectExpr("key_b AS repo_id", "key_a AS related_repo_id", "similarity"))
    return A.top_per_key(both, ["repo_id"], [F.desc("similarity"), F.col("related_repo_id")], 5).drop("place")


@query("""SELECT CAST(event_id AS VARCHAR) || '_k' AS node, event_id AS owner, 'k' AS name, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL""")
def property_nodes(spark, d):
    own = load(spark, d, "events").select("event_id", F.from_json("props", "map<string,string>").alias("m"))
    return G.property_nodes(own, "event_id", "m")


@query("""SELECT related_code_path, md5(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id)) AS group_id, count(*) AS members FROM (SELECT DISTINCT related_code_path, id FROM repo_docs WHERE related_code_path IS NOT NULL) GROUP BY related_code_path""")
def group_nodes(spark, d):
    return G.group_node(load(spark, d, "repo_docs").where("related_code_path is not null"), ["related_code_path"], "id")


@query("""SELECT user_id, event_id, place FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events WHERE event_type = 'error') WHERE place <= 10""")
def last_errors(spark, d):
    return A.top_per_key(load(spark, d, "events").where("event_type = 'error'").select("user_id", "event_id", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 10).drop("ts")


_TRANSACTIONS = """(SELECT value, CASE event_type WHEN 'purchase' THEN 'committed' WHEN 'view' THEN 'rolled_back' WHEN 'error' THEN 'commit_failed' WHEN 'signup' THEN 'rollback_failed' ELSE 'open' END AS status,
  CASE WHEN event_type IN ('error', 'signup') THEN CASE WHEN value > 40 THEN 'Deadlock found' WHEN value > 30 THEN 'lock wait TIMEOUT' ELSE 'lost' END END AS message FROM events)"""


def transactions(spark, d):
    """Events read as transactions that end one way or another, with the message of a failed one."""
    kind = F.col("event_type")
    status = F.when(kind == "purchase", "committed").when(kind == "view", "rolled_back").when(kind == "error", "commit_failed").when(kind == "signup", "rollback_failed").otherwise("open")
    message = F.when(kind.isin("error", "signup"), F.when(F.col("value") > 40, "Deadlock found").when(F.col("value") > 30, "lock wait TIMEOUT").otherwise("lost"))
    return load(spark, d, "events").select("value", status.alias("status"), message.alias("message"))


@query(f"""SELECT class, count(*) AS n FROM (SELECT CASE WHEN contains(lower(message), 'deadlock') THEN 'deadlock' WHEN contains(lower(message), 'timeout') THEN 'timeout' WHEN message IS NOT NULL AND status = 'commit_failed' THEN 'commit' WHEN message IS NOT NULL AND status = 'rollback_failed' THEN 'rollback' END AS class FROM {_TRANSACTIONS}) WHERE class IS NOT NULL GROUP BY class""")
def transaction_errors(spark, d):
    own = transactions(spark, d).select(T.transaction_error(F.col("message"), F.col("status")).alias("class"))
    return A.count_by(own.where("class is not null"), "class")


@query(f"""WITH t AS (SELECT 'total' AS kind, value FROM {_TRANSACTIONS} WHERE value IS NOT NULL UNION ALL SELECT CASE status WHEN 'committed' THEN 'commit' ELSE 'rollback' END, value FROM {_TRANSACTIONS} WHERE status IN ('committed', 'rolled_back') AND value IS NOT NULL)
  SELECT kind, n, avg, min, max, p FROM (SELECT kind, value AS p, row_number() OVER (PARTITION BY kind ORDER BY value) - 1 AS i FROM t) JOIN (SELECT kind AS k, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS avg, min(value) AS min, max(value) AS max FROM t GROUP BY kind) ON k = kind
  WHERE i = least(CAST(floor(n * 0.95) AS BIGINT), n - 1)""")
def transaction_durations(spark, d):
    kinds = F.array_compact(F.array(F.lit("total"), F.when(F.col("status") == "committed", "commit").when(F.col("status") == "rolled_back", "rollback")))
    return A.nearest_rank(transactions(spark, d).select("value", F.explode(kinds).alias("kind")), ["kind"], "value", 0.95)


@query("""SELECT repo_id, file_path, array_to_string(regexp_extract_all(file_content, '[a-z]+_[a-z]+')[1:10], '|') AS found FROM (SELECT DISTINCT repo_id, file_path, file_content FROM code_files WHERE file_content IS NOT NULL) WHERE len(regexp_extract_all(file_content, '[a-z]+_[a-z]+')) > 0""")
def first_matches(spark, d):
    own = load(spark, d, "code_files").where("file_content is not null").select("repo_id", "file_path", "file_content").distinct()
    found = own.select("repo_id", "file_path", F.regexp_extract_all("file_content", F.lit("[a-z]+_[a-z]+"), F.lit(0)).alias("m"))
    return found.where(F.size("m") > 0).select("repo_id", "file_path", F.array_join(F.slice("m", 1, 10), "|").alias("found"))


_USABLE = "len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"


@query(f"""WITH q AS (SELECT id AS query, any_value(embedding)::DOUBLE[] AS v FROM repo_docs WHERE id % 50 = 0 AND {_USABLE} GROUP BY id), e AS (SELECT id, any_value(embedding)::DOUBLE[] AS v FROM code_snippets WHERE {_USABLE} GROUP BY id)
  SELECT query, id, similarity, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) AS place FROM (SELECT query, id, round(list_cosine_similarity(q.v, e.v), 9) AS similarity FROM q, e)) WHERE place <= 3""")
def code_for_docs(spark, d):
    usable = V.has_dimension(F.col("embedding"), 64)
    asked = load(spark, d, "repo_docs").where((F.col("id") % 50 == 0) & usable).select(F.col("id").alias("query"), F.col("embedding").alias("vec")).dropDuplicates(["query"])
    rows = load(spark, d, "code_snippets").where(usable).select("id", "embedding").dropDuplicates(["id"])
    return S.nearest(rows, "id", "embedding", asked, k=3, same_set=False)


@query("""SELECT c.id, coalesce(n.file_path, c.file_path) AS file_path FROM (SELECT DISTINCT id, file_path FROM code_snippets) c LEFT JOIN (SELECT id, max(file_path) AS file_path FROM repo_docs WHERE file_path IS NOT NULL GROUP BY id) n ON n.id = c.id""")
def update_by_key(spark, d):
    old = load(spark, d, "code_snippets").select("id", "file_path").distinct()
    new = load(spark, d, "repo_docs").where("file_path is not null").groupBy("id").agg(F.max("file_path").alias("file_path"))
    return K.upsert_columns(old, A.present(new, old, ["id"]), ["id"], ["file_path"])


@query()
def node_embeddings(spark, d):
    return G.node_embeddings(part_edges(spark, d)).select("node", F.array_join(F.transform("vec", lambda x: F.round(x, 6).cast("string")), ",").alias("vec"))


# ---------------------------------------------------------------- streams


@query("""SELECT user_id, CAST(epoch(time_bucket(INTERVAL '1 hour', ts)) AS BIGINT) AS hour, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY user_id, time_bucket(INTERVAL '1 hour', ts)""")
def stream_monitor(spark, d):
    own = load(spark, d, "events")
    stream = C.read_changes(spark, d, own.schema, "events.parquet")
    hours = C.monitored(stream, "ts", "1 hour", [F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors")], "user_id")
    # Windows that a batch changed replace their earlier counts; those behind the watermark leave the state.
    folder = run_stream(spark, hours, lambda out: C.bucketed_upsert_sink(out, ["user_id", "window_start"], "n", 8), "update")
    return C.read_bucketed(spark, folder).select("user_id", F.unix_timestamp("window_start").alias("hour"), "n", "errors")


@query("""SELECT user_id, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS changes FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (
  SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '10 minutes' THEN 0 ELSE 1 END AS b FROM events)) GROUP BY user_id, s) GROUP BY user_id""")
def debounced_changes(spark, d):
    own = load(spark, d, "events")
    changes = C.debounced(C.read_changes(spark, d, own.schema, "events.parquet"), "user_id", "ts", "10 minutes")
    folder = run_stream(spark, changes, C.overwriting, "complete")
    return spark.read.parquet(folder).groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("changes").alias("changes"))


@query("SELECT event_id, user_id FROM events WHERE event_type IN ('click', 'view') AND user_id IS NOT NULL")
def stream_relevant(spark, d):
    own = load(spark, d, "events")
    kept = C.relevant(C.read_changes(spark, d, own.schema, "events.parquet"), "event_type", ["click", "view"], F.col("user_id").isNotNull())
    folder = _stream_folder(spark)
    C.run_to_end(kept.select("event_id", "user_id"), folder)
    return spark.read.parquet(f"{folder}/out")


@query("SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM events WHERE user_id IS NOT NULL GROUP BY user_id")
def stream_upsert(spark, d):
    own = load(spark, d, "events").select("user_id", "ts", "event_id")
    stream = C.read_changes(spark, d, load(spark, d, "events").schema, "events.parquet").where("user_id is not null").select("user_id", "ts", "event_id")
    # Of changes at the same time the greater id is the later one.
    timed = stream.withColumn("at", F.struct("ts", "event_id"))
    folder = run_stream(spark, timed, lambda out: C.bucketed_upsert_sink(out, ["user_id"], "at", 8), "append")
    return C.read_bucketed(spark, folder).select(*own.columns)


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE event_type IS NOT NULL GROUP BY event_type")
def stream_view(spark, d):
    own = load(spark, d, "events")
    stream = C.read_changes(spark, d, own.schema, "events.parquet").select("event_type")
    view = lambda df: df.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))
    folder = run_stream(spark, stream, lambda out: C.rebuilding(view, lambda: load(spark, d, "events"), "event_type", out), "append")
    return spark.read.parquet(folder).select("event_type", "n", "users")


def run_stream(spark: SparkSession, stream: DataFrame, sink, mode: str) -> str:  # noqa: ANN001
    """Process all that is there through the foreachBatch function that `sink` gives for a folder; that folder."""
    folder = _stream_folder(spark)
    writer = stream.writeStream.outputMode(mode).foreachBatch(sink(f"{folder}/out"))
    writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return f"{folder}/out"


def _stream_folder(spark: SparkSession) -> str:
    """A folder for the state of a stream: shared by the executors where one is named."""
    import uuid

    from tesserine.plans.scratch import shared_folder

    return f"{shared_folder(spark)}/tesserine-streams/{uuid.uuid4().hex}"
