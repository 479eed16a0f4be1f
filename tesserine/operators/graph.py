"""Property-graph operators on tables of nodes and edges."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserine.operators.components import connected_components, on_cycles
from tesserine.operators.relational import top_per_key
from tesserine.operators.shortest import packed, searched
from tesserine.plans.scratch import discard, materialise


def project_subgraph(nodes: DataFrame, edges: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    """Nodes that `keep` selects and the edges between them; loops and repeated edges stay."""
    own = nodes.where(keep)
    ends = own.select(F.col("id").alias("_n")).distinct()
    inside = edges.join(ends, edges["src"] == ends["_n"], "left_semi")
    return own, inside.join(ends, inside["dst"] == ends["_n"], "left_semi")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree, degree); a loop counts once on either side."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.where("node is not null").groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.sum(F.col("o") + F.col("i")).alias("degree"))


def neighbours(edges: DataFrame, starts: DataFrame, undirected: bool = False) -> DataFrame:
    """(node, neighbour) one step from the nodes of `starts`."""
    steps = edges.select("src", "dst")
    if undirected:
        steps = steps.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return steps.join(starts.select(F.col("node").alias("src")).distinct(), "src", "left_semi").select(F.col("src").alias("node"), F.col("dst").alias("neighbour")).distinct()


def paths(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, node, steps, path) of every path of up to `depth` edges that repeats no edge.

    Depth is small and fixed, so the joins are unrolled; parallel edges count once.
    """
    links = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    now = starts.select(F.col("node").alias("start")).distinct().withColumns({"node": F.col("start"), "path": F.array(F.col("start"))})
    found = None
    for step in range(1, depth + 1):
        edge = F.struct("src", "dst")
        now = now.join(links, F.col("node") == F.col("src"))
        walked = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.element_at("path", i).alias("src"), F.element_at("path", i + 1).alias("dst"))) if step > 1 else F.array().cast("array<struct<src:bigint,dst:bigint>>")
        now = now.where(~F.array_contains(walked, edge)).select("start", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        part = now.withColumn("steps", F.lit(step).cast("long"))
        found = part if found is None else found.unionByName(part)
    return found.select("start", "node", "steps", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


def nodes_on_cycles(edges: DataFrame, longest: int) -> DataFrame:
    """(node, steps): nodes on a closed walk of at most `longest` edges with the shortest such length.

    Only distinct (start, node) pairs are carried from step to step, never whole paths.
    """
    links = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    now, found = links.select(F.col("src").alias("start"), F.col("dst").alias("node")), None
    for step in range(1, longest + 1):
        if step > 1:
            now = now.where("start <> node").join(links, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        part = now.where("start = node").select(F.col("start").alias("node"), F.lit(step).cast("long").alias("steps"))
        found = part if found is None else found.unionByName(part)
    return found.groupBy("node").agg(F.min("steps").alias("steps"))


def pagerank(edges: DataFrame, rounds: int = 20, damping: float = 0.85, cut_every: int = 5) -> DataFrame:
    """(node, rank) after a fixed number of rounds; a node without out edges passes nothing on.

    Contributions are summed map-side; the lineage is cut to a table every few rounds.
    """
    spark = edges.sparkSession
    links = materialise(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    out = links.groupBy("src").agg(F.count("*").alias("n"))
    nodes = materialise(links.select(F.col("src").alias("node")).union(links.select("dst")).distinct())
    # The links are laid out by their source once; a round then moves only the ranks. A lost part is laid out again from the table.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    weighted = links.join(out, "src").repartition(parts, "src").persist(StorageLevel.MEMORY_AND_DISK)
    ranks, cut = nodes.withColumn("rank", F.lit(1.0)), None
    for i in range(1, rounds + 1):
        sent = weighted.join(ranks, weighted["src"] == ranks["node"]).groupBy("dst").agg(F.sum(F.col("rank") / F.col("n")).alias("s"))
        ranks = nodes.join(sent, nodes["node"] == sent["dst"], "left").select("node", (F.lit(1 - damping) + damping * F.coalesce("s", F.lit(0.0))).alias("rank"))
        if i % cut_every == 0 or i == rounds:
            new = materialise(ranks)
            discard(cut)
            ranks = cut = new
    weighted.unpersist()
    discard(links, nodes)
    return ranks


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(node, community): labels of the most neighbours, ties to the least label, for fixed rounds."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).where("src is not null and dst is not null and src <> dst").distinct()
    both = materialise(both)
    labels = both.select(F.col("src").alias("node")).distinct().withColumn("community", F.col("node"))
    for _ in range(rounds):
        votes = both.join(labels, both["dst"] == labels["node"]).groupBy("src", "community").agg(F.count("*").alias("n"))
        best = votes.groupBy("src").agg(F.min(F.struct((-F.col("n")).alias("n"), "community")).alias("b"))
        labels = materialise(best.select(F.col("src").alias("node"), F.col("b.community").alias("community")))
    return labels


#: Components of fewer nodes are searched together, larger ones in slices of so many sources.
UNIT, SLICE = 2000, 512


def betweenness(edges: DataFrame, max_edges: int = 2_000_000, block_sources: int = 1000) -> DataFrame:
    """(node, score) by Brandes' accumulation, directed, exact, one breadth-first search per node.

    Every component is searched apart. Up to `max_edges` edges are broadcast and the sources spread over
    tasks. Of a larger graph, the components of up to `max_edges` edges are sent to tasks of their own, and
    what is larger still is searched by joins, for about `block_sources` sources at a time, one join a level.
    The result is the same.
    """
    spark = edges.sparkSession
    links = materialise(edges.select("src", "dst").where("src is not null and dst is not null and src <> dst").distinct())
    if links.count() > max_edges:
        return _betweenness_apart(links, max_edges, block_sources)
    pairs = links.toPandas()  # bounded by max_edges
    discard(links)
    names, ends = np.unique(np.concatenate([pairs["src"].to_numpy(), pairs["dst"].to_numpy()]), return_inverse=True)
    src, dst = ends[: len(pairs)], ends[len(pairs) :]
    unit = _units(src, dst, len(names))
    order = np.argsort(unit, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    by_unit = np.argsort(unit[src], kind="stable")
    kinds = np.arange(unit.max() + 2) if len(unit) else np.arange(1)
    nodes, lines = np.searchsorted(unit[order], kinds).tolist(), np.searchsorted(unit[src[by_unit]], kinds).tolist()
    slices = [(u, first, step) for u in range(len(kinds) - 1) for step in [-(-(nodes[u + 1] - nodes[u]) // SLICE)] for first in range(step)]
    shared = spark.sparkContext.broadcast((names[order], place[src[by_unit]].astype(np.int32), place[dst[by_unit]].astype(np.int32), nodes, lines, slices))

    def graphs(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, src, dst, nodes, lines, slices = shared.value
        for part in parts:
            for i in part["id"].tolist():
                unit, first, step = slices[i]
                own, n = slice(lines[unit], lines[unit + 1]), nodes[unit + 1] - nodes[unit]
                yield _graph(names[nodes[unit] :][:n], src[own] - nodes[unit], dst[own] - nodes[unit], first, step)

    sources = spark.range(0, len(slices), 1, max(1, min(400, len(slices))))
    return _scored(sources.mapInPandas(graphs, _GRAPH))


_GRAPH = "names binary, graph binary, first int, step int"


def _graph(names: np.ndarray, src: np.ndarray, dst: np.ndarray, first: int, step: int) -> pd.DataFrame:
    """One row: a graph with the names of its nodes, and the sources to search from."""
    return pd.DataFrame({"names": [names.astype("<i8").tobytes()], "graph": [packed(src, dst, len(names))], "first": [first], "step": [step]})


def _scored(graphs: DataFrame) -> DataFrame:
    """(node, score) of the graphs, searched from the sources that each names."""

    def named(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for names, scores in zip(part["names"], part["scores"]):
                score = np.frombuffer(scores, "<f8")
                hit = np.flatnonzero(score)
                yield pd.DataFrame({"node": np.frombuffer(names, "<i8")[hit], "part": score[hit]})

    scores = graphs.select("names", searched(graphs.sparkSession, "graph", "first", "step").alias("scores"))
    return scores.mapInPandas(named, "node long, part double").groupBy("node").agg(F.sum("part").alias("score"))


def _units(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """For each node a number that its component has, alone or with other small ones."""
    label = np.arange(n)
    while True:
        new, least = label.copy(), np.minimum(label[src], label[dst])
        np.minimum.at(new, label[src], least)
        np.minimum.at(new, label[dst], least)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    _, component, size = np.unique(label, return_inverse=True, return_counts=True)
    small, unit = size < UNIT, np.empty(len(size), np.int64)
    unit[~small] = np.arange((~small).sum())
    unit[small] = np.cumsum(size[small]) // UNIT + (~small).sum()
    return unit[component]


def _betweenness_apart(links: DataFrame, max_edges: int, block_sources: int) -> DataFrame:
    """As `betweenness`, with each component of up to `max_edges` edges sent to tasks and the others joined."""
    spark = links.sparkSession
    named = materialise(connected_components(links, "src", "dst"))
    own = materialise(links.join(named, links["src"] == named["node"]).select("component", "src", "dst"))
    size = named.groupBy("component").agg(F.count("*").alias("nodes")).join(own.groupBy("component").agg(F.count("*").alias("lines")), "component")
    size = materialise(size.withColumn("small", F.col("nodes") < UNIT))
    held, small, lines = size.where(F.col("lines") <= max_edges).agg(F.count("*"), F.sum(F.expr("if(small, nodes, 0)")), F.sum(F.expr("if(small, lines, 0)"))).first()
    joined = None
    if not held or size.where(F.col("lines") > max_edges).limit(1).count():
        large = own.join(size.where(F.col("lines") > max_edges), "component", "left_semi").select("src", "dst")
        joined = _betweenness_joined(materialise(large), block_sources)
    if not held:
        return joined
    # A few slices only, as each is sent the edges.
    width, buckets = 10 * SLICE, max(1, -(-small // UNIT), -(-lines // 100_000))
    unit = F.when(F.col("small"), F.pmod(F.xxhash64("component"), F.lit(buckets))).otherwise(F.col("component"))
    slices = F.when(F.col("small"), 1).otherwise(F.ceil(F.col("nodes") / width)).cast("int")
    units = size.where(F.col("lines") <= max_edges).select("component", "small", unit.alias("unit"), slices.alias("slices"))
    sent = own.join(units, "component").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))

    def graph(part: pd.DataFrame) -> pd.DataFrame:
        names, ends = np.unique(np.concatenate([part["src"].to_numpy(), part["dst"].to_numpy()]), return_inverse=True)
        return _graph(names, ends[: len(part)], ends[len(part) :], int(part["slice"].iat[0]), int(part["slices"].iat[0]))

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = sent.select("small", "unit", "slice", "slices", "src", "dst").repartition(max(tasks, min(1000, -(-held // 10))), "small", "unit", "slice").groupBy("small", "unit", "slice")
    found = _scored(groups.applyInPandas(graph, _GRAPH))
    return found if joined is None else found.unionByName(joined)


def _betweenness_joined(links: DataFrame, block_sources: int) -> DataFrame:
    """As `betweenness`, by joins of frontiers with the edges: nothing but counts goes to the driver."""
    nodes = materialise(links.select(F.col("src").alias("node")).union(links.select("dst")).distinct())
    blocks = max(1, -(-nodes.count() // block_sources))
    whole = None
    for block in range(blocks):
        own = nodes.where(F.pmod(F.xxhash64("node"), F.lit(blocks)) == block)
        levels = [materialise(own.select(F.col("node").alias("s"), "node", F.lit(1.0).alias("paths")))]
        seen = levels[0].select("s", "node")
        while True:
            ahead = levels[-1].join(links, levels[-1]["node"] == links["src"]).groupBy("s", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))
            new = materialise(ahead.join(seen, ["s", "node"], "left_anti"))
            if not new.limit(1).count():
                break
            levels.append(new)
            seen = seen.unionByName(new.select("s", "node"))
        depends = None
        part = None
        for level in range(len(levels) - 1, 0, -1):
            here = levels[level] if depends is None else levels[level].join(depends, ["s", "node"], "left")
            here = here.select("s", F.col("node").alias("dst"), ((1 + (F.coalesce("d", F.lit(0.0)) if depends is not None else F.lit(0.0))) / F.col("paths")).alias("share"))
            back = here.join(links, "dst").join(levels[level - 1].withColumnRenamed("node", "src"), ["s", "src"])
            depends = materialise(back.groupBy("s", F.col("src").alias("node")).agg(F.sum(F.col("share") * F.col("paths")).alias("d")))
            scored = depends.where("s <> node").groupBy("node").agg(F.sum("d").alias("part"))
            part = scored if part is None else part.unionByName(scored)
        if part is not None:
            part = materialise(part.groupBy("node").agg(F.sum("part").alias("part")))
            whole = part if whole is None else whole.unionByName(part)
    if whole is None:
        whole = nodes.select("node", F.lit(0.0).alias("part"))
    return whole.groupBy("node").agg(F.sum("part").alias("score")).where("score > 0")


def modularity_communities(edges: DataFrame, rounds: int = 6, levels: int = 4) -> DataFrame:
    """(node, community): communities that modularity favours, by local moves and merging (Blondel 2008), without chance.

    In every round half of the nodes, dealt by their hash, move to the neighbouring community of the
    greatest gain (ties: the least); then communities become the nodes of the next level. Links are
    taken undirected and parallel ones add up. A community is named by its least node.
    """
    both = edges.where("src is not null and dst is not null and src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    links = both.groupBy("a", "b").agg(F.count("*").cast("double").alias("w"))
    links = materialise(links.select("a", "b", "w").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")))
    total = links.agg(F.sum("w")).first()[0]
    found = materialise(links.select(F.col("a").alias("node")).distinct().withColumn("community", F.col("node")))
    if not total:
        return found
    for level in range(levels):
        weight = materialise(links.groupBy("a").agg(F.sum("w").alias("k")))  # loops of merged nodes count in full
        label = materialise(weight.select(F.col("a").alias("node"), F.col("a").alias("c"), "k"))
        for turn in range(rounds):
            sums = label.groupBy("c").agg(F.sum("k").alias("tot"))
            near = links.where("a <> b").join(label.select(F.col("node").alias("b"), "c"), "b").groupBy(F.col("a").alias("node"), "c").agg(F.sum("w").alias("inside"))
            near = near.unionByName(label.select("node", "c", F.lit(0.0).alias("inside"))).groupBy("node", "c").agg(F.sum("inside").alias("inside"))
            rated = near.join(sums, "c").join(label.select("node", F.col("c").alias("own"), "k"), "node")
            others = F.col("tot") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)
            rated = rated.withColumn("gain", F.round(F.col("inside") - F.col("k") * others / total, 9))
            best = rated.groupBy("node").agg(F.min(F.struct((-F.col("gain")).alias("g"), (F.col("c") != F.col("own")).alias("moves"), "c")).alias("m"), F.first("own").alias("own"), F.first("k").alias("k"))
            moves = F.pmod(F.xxhash64(F.lit(level * 100 + turn // 2), "node"), F.lit(2)) == turn % 2
            new = materialise(best.select("node", F.when(moves, F.col("m.c")).otherwise(F.col("own")).alias("c"), "k", "own"))
            changed = new.where("c <> own").limit(1).count()
            discard(label)
            label = new.drop("own")
            if not changed and turn % 2:
                break
        named = label.groupBy("c").agg(F.min("node").alias("name"))
        label = materialise(label.join(named, "c").select("node", "name"))
        found = materialise(found.join(label.withColumnRenamed("node", "community"), "community").select("node", F.col("name").alias("community")))
        merged = links.join(label.toDF("a", "x"), "a").join(label.toDF("b", "y"), "b").groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.sum("w").alias("w"))
        if merged.select("a").distinct().count() == weight.count():
            break
        links = materialise(merged)
    # Names across levels are least nodes of least nodes already; a last pass makes sure.
    least = found.groupBy("community").agg(F.min("node").alias("least"))
    return found.join(least, "community").select("node", F.col("least").alias("community"))


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(modularity) of communities (node, community) over undirected links; one row."""
    both = edges.where("src is not null and dst is not null and src <> dst").select("src", "dst")
    both = both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    named = both.join(labels.toDF("src", "x"), "src").join(labels.toDF("dst", "y"), "dst")
    per = named.groupBy(F.col("x").alias("c")).agg(F.count("*").alias("k"), F.count_if(F.col("x") == F.col("y")).alias("inside"))
    return per.agg((F.sum("inside") / F.sum("k") - F.sum(F.col("k").cast("double") * F.col("k")) / F.pow(F.sum("k").cast("double"), F.lit(2.0))).alias("modularity"))


def hierarchy(edges: DataFrame, roots: DataFrame, longest: int = 100) -> DataFrame:
    """(root, node, depth, path, circular) of every way down from the roots; a node that a way already holds ends it as circular."""
    links = materialise(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    now = roots.select(F.col("node").alias("root")).distinct().select("root", F.col("root").alias("node"), F.array("root").alias("way"), F.lit(False).alias("circular"))
    found = None
    for depth in range(longest + 1):
        now = materialise(now)
        if depth and not now.limit(1).count():
            break
        part = now.withColumn("depth", F.lit(depth).cast("long"))
        found = part if found is None else found.unionByName(part)
        ahead = now.where("not circular").join(links, F.col("node") == F.col("src"))
        now = ahead.select("root", F.col("dst").alias("node"), F.concat("way", F.array("dst")).alias("way"), F.array_contains("way", F.col("dst")).alias("circular"))
    return found.select("root", "node", "depth", F.array_join(F.transform("way", lambda x: x.cast("string")), ">").alias("path"), "circular")


def waiting_cycles(edges: DataFrame, started: DataFrame, before: Column) -> DataFrame:
    """(txn, reason, cycle): transactions that wait for one another in a cycle of any length, and those started before a time."""
    cyclic = on_cycles(edges).select(F.col("node").alias("txn"), F.lit("deadlock").alias("reason"), "cycle")
    stale = started.where(before).select("txn").distinct().select("txn", F.lit("timeout").alias("reason"), F.col("txn").alias("cycle"))
    return cyclic.unionByName(stale)


def relationship_ranks(edges: DataFrame, k: int = 10) -> DataFrame:
    """(src, dst, kinds, n, place): the `k` nodes that a node has most kinds of relations with, then most relations."""
    counted = edges.groupBy("src", "dst").agg(F.count_distinct("type").alias("kinds"), F.count("*").alias("n"))
    return top_per_key(counted, ["src"], [F.desc("kinds"), F.desc("n"), F.col("dst")], k)


def random_walks(edges: DataFrame, walks: int = 10, length: int = 80, seed: int = 1) -> DataFrame:
    """(start, walk, step, node): walks whose steps follow from hashes, so the same graph gives the same walks.

    Links are numbered per node, and a step is a join on node and number: no list of neighbours is built.
    A node without an out link ends its walks.
    """
    links = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    numbered = materialise(links.withColumn("i", F.row_number().over(Window.partitionBy("src").orderBy("dst")) - 1))
    degree = materialise(numbered.groupBy("src").agg(F.count("*").alias("n")))
    now = degree.select(F.col("src").alias("start"), F.col("src").alias("node"), F.explode(F.sequence(F.lit(0), F.lit(walks - 1))).alias("walk"))
    found = None
    for step in range(length):
        now = materialise(now)
        part = now.withColumn("step", F.lit(step))
        found = part if found is None else found.unionByName(part)
        pick = F.pmod(F.xxhash64(F.lit(seed), "start", "walk", F.lit(step)), F.col("n")).cast("int")
        chosen = now.join(degree.withColumnRenamed("src", "node"), "node").select("start", "walk", F.col("node").alias("src"), pick.alias("i"))
        now = chosen.join(numbered, ["src", "i"]).select("start", F.col("dst").alias("node"), "walk")
    return found.select("start", "walk", "step", "node")


def walk_embeddings(edges: DataFrame, dim: int = 128, walks: int = 10, length: int = 80, window: int = 5, seed: int = 1) -> DataFrame:
    """(node, vec): nodes by the company they keep on walks.

    Nodes within `window` steps of one another are counted, a count weighs by its logarithm, and the
    counts of a node are summed up with signs by hashes of the other node, which keeps their cosines.
    """
    steps = materialise(random_walks(edges, walks, length, seed))
    a = steps.select("start", "walk", F.col("step").alias("s"), F.col("node").alias("a"))
    b = steps.select("start", "walk", F.explode(F.sequence(F.col("step") - window, F.col("step") + window)).alias("s"), "step", F.col("node").alias("b"))
    together = a.join(b, ["start", "walk", "s"]).where(F.col("s") != F.col("step")).groupBy("a", "b").agg(F.count("*").alias("n"))
    weight = F.log1p("n")
    signs = [F.sum(weight * (F.pmod(F.xxhash64(F.lit(seed * 1000 + i), "b"), F.lit(2)) * 2 - 1)).alias(f"v{i}") for i in range(dim)]
    return together.groupBy(F.col("a").alias("node")).agg(*signs).select("node", F.array(*[F.col(f"v{i}") for i in range(dim)]).alias("vec"))


class ProjectionCache:
    """Projected graphs kept as tables, with the version of what they were made from."""

    def __init__(self) -> None:
        self._kept: dict[str, tuple[object, tuple[DataFrame, DataFrame]]] = {}

    def exists(self, name: str) -> bool:
        return name in self._kept

    def valid(self, name: str, version: object) -> bool:
        return name in self._kept and self._kept[name][0] == version

    def get(self, name: str, version: object, make: Callable[[], tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
        """The projection of this version, made anew where there is none; one without nodes is not kept."""
        if not self.valid(name, version):
            self.drop(name)
            nodes, links = (materialise(t) for t in make())
            if not nodes.limit(1).count():
                discard(nodes, links)
                return nodes, links
            self._kept[name] = (version, (nodes, links))
        return self._kept[name][1]

    def invalidate(self, name: str) -> None:
        """The projection stays but is made anew at the next request."""
        if name in self._kept:
            self._kept[name] = (object(), self._kept[name][1])

    def drop(self, name: str) -> None:
        if name in self._kept:
            discard(*self._kept.pop(name)[1])


def grid_neighbours(df: DataFrame, id_col: str, vec_col: str, radius: float, features: int = 3, block_rows: int = 4096, seed: int = 1) -> DataFrame:
    """(a, b, distance) of ids a < b at a Euclidean distance of at most `radius`, exactly.

    Projections onto orthonormal directions never lengthen a distance, so close pairs lie in the
    same or in adjacent cells of a grid of that width. Two adjacent cells that hold rows meet in one
    task, beyond `block_rows` rows block by block. Null ids, null vectors, null elements and other
    lengths than the greatest are left out.
    """
    v = F.col(vec_col).cast("array<double>")
    rows = df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(~F.exists("v", lambda x: x.isNull()))
    dim = rows.agg(F.max(F.size("v"))).first()[0] or 1
    axes = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, min(features, dim))))[0].T
    place = [F.floor(F.aggregate(F.zip_with("v", F.array(*[F.lit(float(x)) for x in axis]), lambda p, q: p * q), F.lit(0.0), lambda s, x: s + x) / radius) for axis in axes]
    home = F.array(*place).alias("home")
    cells = materialise(rows.where(F.size("v") == dim).select("id", "v", home))
    sizes = cells.groupBy("home").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    # Which cells that hold rows lie side by side: each pair once, the lesser first. Vectors go only to these.
    around = sizes
    for i in range(len(axes)):
        near = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias(f"d{i}")
        around = around.select("*", near)
    other = F.array(*[F.col("home")[i] + F.col(f"d{i}") for i in range(len(axes))])
    pairs = around.select("home", "blocks", other.alias("other")).where("home <= other").join(sizes.select(F.col("home").alias("other"), F.col("blocks").alias("others")), "other")
    pairs = materialise(pairs.select("home", "other", "blocks", "others"))
    asked = cells.join(pairs, "home").withColumn("p", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    given = cells.withColumnRenamed("home", "other").join(pairs, "other").withColumn("q", F.pmod(F.xxhash64("id"), F.col("others")).cast("int")).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asked = asked.select("home", "other", "p", "q", "id", "v", F.lit(True).alias("left"))
    given = given.select("home", "other", "p", "q", "id", "v", F.lit(False).alias("left"))

    def measure(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, left = table.column("id").to_numpy(), table.column("left").to_numpy(zero_copy_only=False).astype(bool)
        values = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dim)
        found, one_cell = [], key[0].as_py() == key[1].as_py()
        squares = (values * values).sum(axis=1)
        heads, rest = np.flatnonzero(left), np.flatnonzero(~left)
        for start in range(0, len(heads), 512):
            part = heads[start : start + 512]
            far = squares[part][:, None] + squares[rest][None, :] - 2 * (values[part] @ values[rest].T)
            ordered = ids[part][:, None] < ids[rest][None, :] if one_cell else ids[part][:, None] != ids[rest][None, :]
            a, b = np.nonzero((far <= radius * radius + 1e-6) & ordered)
            a, b = part[a], rest[b]
            exact = np.sqrt(((values[a] - values[b]) ** 2).sum(axis=1))
            kept = exact <= radius
            a, b = ids[a[kept]], ids[b[kept]]
            found.append((np.minimum(a, b), np.maximum(a, b), exact[kept]))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.empty(0, np.int64)] * 2 + [np.empty(0)]
        return pa.table(dict(zip(("a", "b", "distance"), columns)))

    return asked.unionByName(given).groupBy("home", "other", "p", "q").applyInArrow(measure, "a long, b long, distance double")


def density_clusters(df: DataFrame, id_col: str, vec_col: str, radius: float) -> DataFrame:
    """(id, cluster): DBSCAN with at least two points, whose clusters are the components of close pairs.

    The cluster is its least id; points without a neighbour are noise and have no row.
    """
    links = connected_components(grid_neighbours(df, id_col, vec_col, radius), "a", "b")
    return links.select(F.col("node").alias("id"), F.col("component").alias("cluster"))


def node_embeddings(edges: DataFrame, dim: int = 16, rounds: int = 2, seed: int = 1) -> DataFrame:
    """(node, vec): each node starts from signs of its hash and takes up the mean of its neighbours per round.

    A deterministic stand-in for walk-based embeddings: nodes with like neighbourhoods get like
    vectors. The sums are per component, combined map-side.
    """
    both = edges.select("src", "dst").union(edges.select("dst", "src")).where("src is not null and dst is not null and src <> dst").distinct()
    both = materialise(both)
    signs = [(F.pmod(F.xxhash64(F.lit(seed * 1000 + i), "node"), F.lit(2)) * 2 - 1).cast("double") for i in range(dim)]
    now = both.select(F.col("src").alias("node")).distinct().select("node", *[s.alias(f"v{i}") for i, s in enumerate(signs)])
    for _ in range(rounds):
        means = both.join(now, both["dst"] == now["node"]).groupBy("src").agg(*[F.avg(f"v{i}").alias(f"m{i}") for i in range(dim)])
        now = materialise(now.join(means, F.col("node") == F.col("src")).select("node", *[(F.col(f"v{i}") / 2 + F.col(f"m{i}")).alias(f"v{i}") for i in range(dim)]))
    return now.select("node", F.array(*[f"v{i}" for i in range(dim)]).alias("vec"))


def property_nodes(df: DataFrame, key: str, props: str) -> DataFrame:
    """(node, owner, name, value): every entry of a map as a node of its own, named after owner and entry."""
    entries = df.where(F.col(props).isNotNull()).select(F.col(key).alias("owner"), F.explode(props).alias("name", "value"))
    return entries.select(F.concat_ws("_", F.col("owner").cast("string"), "name").alias("node"), "owner", "name", "value")


def group_node(df: DataFrame, keys: Sequence[str], member: str, name: str = "group_id") -> DataFrame:
    """(keys, group_id, members): an id that depends only on the set of members of a key."""
    own = df.where(F.col(member).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_set(member)).alias("_m"))
    return own.select(*keys, F.md5(F.array_join(F.transform("_m", lambda x: x.cast("string")), ",")).alias(name), F.size("_m").cast("long").alias("members"))
