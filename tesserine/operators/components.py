"""Connected components by minimum labels, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.plans.scratch import discard, materialise


def _stars(pairs: DataFrame, larger_only: bool) -> DataFrame:
    """One star step over (u, v): every neighbour of u is tied to the least of u's neighbourhood.

    `larger_only` picks the step that moves neighbours above u, else those up to u and u itself.
    The minimum of a neighbourhood is combined map-side. The join that hands it out puts the neighbours
    of a hub on one key, which adaptive execution splits where it is skewed.
    """
    if larger_only:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if larger_only:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return moved.where("u <> v").distinct()


def connected_components(edges: DataFrame, src: str, dst: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of `edges`; the component is its least node.

    Alternating large-star and small-star rounds (Kiveris et al. 2014) until the edge set no longer
    changes, each round cut to a table. Null ends are dropped, loops name a node of its own, an
    empty input gives an empty result.
    """
    known = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    known = materialise(known.distinct())
    pairs, last = known.where("u <> v"), None
    for _ in range(max_rounds):
        new = materialise(_stars(_stars(pairs, True), False))
        state = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if isinstance(pairs, DataFrame) and pairs is not None:
            discard(pairs)
        pairs = new
        if (state["n"], state["h"]) == last:
            break
        last = (state["n"], state["h"])
    else:
        raise RuntimeError(f"components did not converge in {max_rounds} rounds")
    nodes = known.select("u").unionByName(known.select(F.col("v").alias("u"))).distinct()
    return nodes.join(pairs.withColumnRenamed("v", "least_node"), "u", "left").select(
        F.col("u").alias("node"), F.coalesce("least_node", "u").alias("component")
    )


def on_cycles(edges: DataFrame) -> DataFrame:
    """(node, cycle) of every node that lies on a cycle of the directed `edges` (src, dst), a loop included.

    Nodes on cycles that share nodes have the same `cycle`, which is the greatest of them; it is their strong component.

    Nodes without an edge in or out are trimmed until none is left. In the rest the greatest name
    that reaches a node colours it; what reaches the node of its colour back is a cycle with it and is
    taken out, and the rest is trimmed again. Only rows of nodes are carried along, no paths.
    """
    links = materialise(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    loops = materialise(links.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("cycle"), F.lit(0).alias("n")))
    found = loops
    while True:
        left = -1
        while (count := links.count()) != left:  # trim
            left = count
            inner = links.join(links.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(links.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
            links, old = materialise(inner.where("src <> dst")), links
            discard(old)
        if not left:
            return found.groupBy("node").agg(F.max_by("cycle", "n").alias("cycle"))
        colour, changed = materialise(links.select(F.col("src").alias("node")).union(links.select("dst")).distinct().withColumn("colour", F.col("node"))), 1
        while changed:
            sent = links.join(colour, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("new"))
            both = materialise(colour.join(sent, "node", "left").select("node", F.greatest("colour", F.coalesce("new", "colour")).alias("colour"), (F.col("new") > F.col("colour")).alias("moved")))
            changed = both.where("moved").limit(1).count()
            discard(colour)
            colour = both.drop("moved")
        # Backwards from the node that gave a colour, inside the colour.
        core, size = materialise(colour.where("node = colour")), -1
        back = links.join(colour.toDF("src", "cs"), "src").join(colour.toDF("dst", "cd"), "dst").where("cs = cd").select("src", "dst", F.col("cs").alias("colour"))
        while (count := core.count()) != size:
            size = count
            more = back.join(core.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node"), "colour")
            core, old = materialise(core.unionByName(more).distinct()), core
            discard(old)
        sizes = core.groupBy("colour").agg(F.count("*").alias("n")).where("n > 1")
        found = materialise(found.unionByName(core.join(sizes, "colour").select("node", F.col("colour").alias("cycle"), F.lit(1).alias("n"))))
        gone = core.select("node")
        links = materialise(links.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti"))
