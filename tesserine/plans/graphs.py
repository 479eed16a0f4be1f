"""Queries over graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserine.operators import graph as G
from tesserine.operators import relational as A
from tesserine.operators import search as S
from tesserine.plans.reference import _RANK
from tesserine.plans.registry import query
from tesserine.plans.tables import EDGES, part_edges
from tesserine.sources.tables import load


@query(_RANK + " SELECT node, round(rank, 6) AS rank FROM r10 WHERE round(rank, 6) > 1.2")
def central_parts(spark, d):
    return G.pagerank(part_edges(spark, d), rounds=10).select("node", F.round("rank", 6).alias("rank")).where("rank > 1.2")


@query(f"""SELECT src, dst, count(*) AS n FROM ({EDGES}) WHERE src IN (SELECT p_partkey FROM part WHERE p_brand IN ('Brand#11', 'Brand#12') OR p_size IN (1, 2)) AND dst IN (SELECT p_partkey FROM part WHERE p_brand IN ('Brand#11', 'Brand#12') OR p_size IN (1, 2)) GROUP BY src, dst""")
def project_groups(spark, d):
    keep = F.col("p_brand").isin("Brand#11", "Brand#12") | F.col("p_size").isin(1, 2)
    nodes = load(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_brand", "p_size")
    return G.project_subgraph(nodes, part_edges(spark, d), keep)[1].groupBy("src", "dst").agg(F.count("*").alias("n"))


@query()
def modularity_communities(spark, d):
    return G.modularity_communities(part_edges(spark, d))


# Every supplier waits for another one; those in debt have waited too long.
_WAITS = "(SELECT s_suppkey AS src, (s_suppkey * 7 + s_nationkey) % (SELECT count(*) FROM supplier) + 1 AS dst FROM supplier)"


def _waits(spark, d):
    own = load(spark, d, "supplier")
    total = own.agg(F.count("*").alias("total"))  # one row
    return own.join(F.broadcast(total)).select(F.col("s_suppkey").alias("src"), ((F.col("s_suppkey") * 7 + F.col("s_nationkey")) % F.col("total") + 1).alias("dst"))


@query(f"""WITH RECURSIVE e AS {_WAITS}, w AS (SELECT src AS start, dst AS node FROM e UNION SELECT w.start, e.dst FROM w JOIN e ON e.src = w.node), c AS (SELECT start AS txn FROM w WHERE start = node), r AS (SELECT w.start, w.node FROM w JOIN c ON c.txn = w.start)
  SELECT txn, 'deadlock' AS reason, (SELECT max(x.node) FROM r x WHERE x.start = c.txn) AS cycle FROM c UNION ALL SELECT s_suppkey, 'timeout', s_suppkey FROM supplier WHERE s_acctbal < 0""")
def waiting_cycles(spark, d):
    started = load(spark, d, "supplier").select(F.col("s_suppkey").alias("txn"), "s_acctbal")
    return G.waiting_cycles(_waits(spark, d), started, F.col("s_acctbal") < 0)


@query(f"""WITH RECURSIVE e AS {_WAITS}, w AS (SELECT s_suppkey AS root, s_suppkey AS node, CAST(0 AS BIGINT) AS depth, [s_suppkey] AS way, false AS circular FROM supplier WHERE s_nationkey < 5
    UNION ALL SELECT w.root, e.dst, w.depth + 1, list_append(w.way, e.dst), list_contains(w.way, e.dst) FROM w JOIN e ON e.src = w.node WHERE NOT w.circular)
  SELECT root, node, depth, array_to_string(way, '>') AS path, circular FROM w""")
def waiting_chains(spark, d):
    roots = load(spark, d, "supplier").where("s_nationkey < 5").select(F.col("s_suppkey").alias("node"))
    return G.hierarchy(_waits(spark, d), roots)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT active_repo_id AS src, id AS dst FROM repositories WHERE active_repo_id IS NOT NULL AND active_repo_id <> id), w AS (SELECT DISTINCT id AS root, id AS node, CAST(0 AS BIGINT) AS depth, [id] AS way, false AS circular FROM repositories WHERE active_repo_id IS NULL
    UNION ALL SELECT w.root, e.dst, w.depth + 1, list_append(w.way, e.dst), list_contains(w.way, e.dst) FROM w JOIN e ON e.src = w.node WHERE NOT w.circular)
  SELECT root, node, depth, array_to_string(way, '>') AS path, circular FROM w""")
def repository_hierarchy(spark, d):
    own = load(spark, d, "repositories")
    links = own.where("active_repo_id is not null and active_repo_id <> id").select(F.col("active_repo_id").alias("src"), F.col("id").alias("dst"))
    return G.hierarchy(links, own.where("active_repo_id is null").select(F.col("id").alias("node")))


@query("""SELECT src, dst, kinds, n, place FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY kinds DESC, n DESC, dst) AS place FROM (SELECT l_suppkey AS src, l_partkey AS dst, count(DISTINCT l_returnflag) AS kinds, count(*) AS n FROM lineitem GROUP BY l_suppkey, l_partkey)) WHERE place <= 10""")
def relationship_ranks(spark, d):
    return G.relationship_ranks(load(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("type")))


@query("""WITH x AS (SELECT DISTINCT l_suppkey AS k, l_partkey AS m FROM lineitem), s AS (SELECT k, count(*) AS size FROM x GROUP BY k),
  j AS (SELECT a.k AS key_a, b.k AS key_b, CAST(count(*) AS DOUBLE) / (max(sa.size) + max(sb.size) - count(*)) AS similarity FROM x a JOIN x b ON a.m = b.m AND a.k < b.k JOIN s sa ON sa.k = a.k JOIN s sb ON sb.k = b.k GROUP BY a.k, b.k)
  SELECT key_a, key_b, similarity FROM j JOIN supplier p ON p.s_suppkey = key_a JOIN supplier q ON q.s_suppkey = key_b WHERE p.s_nationkey <> q.s_nationkey AND similarity >= 0.01 ORDER BY similarity DESC, key_a, key_b LIMIT 20""")
def cross_group_similarity(spark, d):
    pairs = A.members_in_common(load(spark, d, "lineitem"), "l_suppkey", "l_partkey", 0.01)
    nation = load(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    across = pairs.join(nation.toDF("key_a", "na"), "key_a").join(nation.toDF("key_b", "nb"), "key_b").where("na <> nb")
    return across.select("key_a", "key_b", "similarity").orderBy(F.desc("similarity"), "key_a", "key_b").limit(20)


@query()
def walk_similarities(spark, d):
    vectors = G.walk_embeddings(part_edges(spark, d), dim=32, walks=2, length=8, window=2)
    asked = vectors.where("node % 50 = 0").select(F.col("node").alias("query"), "vec")
    return S.nearest(vectors, "node", "vec", asked, k=5, min_similarity=0.8)
