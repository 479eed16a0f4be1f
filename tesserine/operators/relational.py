"""Groupings, rankings, joins and set operations as composable functions.

All work on any DataFrame and let Catalyst choose the physical plan: aggregates combine before
they shuffle, per-key limits are row numbers with a group limit, existence tests are semi joins.
Null keys form a group of their own in aggregates and never match in joins; empty inputs give
empty results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserine.plans.scratch import materialise


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of every group, as column n."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "place") -> DataFrame:
    """The first `k` rows of every key; give an order without ties for one possible result."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")
    return df.withColumn(rank, place).where(F.col(rank) <= k)


def conditional_counts(df: DataFrame, column: str, values: Sequence[str], *keys: str) -> DataFrame:
    """A count for each of `values` and one for all others (null among them), in one pass."""
    own = F.coalesce(F.col(column), F.lit(""))
    counts = [F.count_if(own == v).alias(f"n_{v}") for v in values]
    return df.groupBy(*keys).agg(*counts, F.count_if(~own.isin(*values)).alias("n_other"))


def groups_with_samples(df: DataFrame, key: str, sample: str, more_than: int, samples: int = 3) -> DataFrame:
    """Groups of more than `more_than` rows with their `samples` least distinct samples, joined by '|'.

    The samples come from a ranking, so a group's values never meet in one list.
    """
    sizes = df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > more_than)
    least = top_per_key(df.select(key, sample).where(F.col(sample).isNotNull()).distinct(), [key], [F.col(sample)], samples)
    listed = least.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(sample)), "|").alias("samples"))
    return sizes.join(listed, key, "left")


def distinct_over_union(parts: Sequence[DataFrame], column: str) -> DataFrame:
    """Number of distinct values of `column` over several tables."""
    whole = parts[0].select(column)
    for part in parts[1:]:
        whole = whole.union(part.select(column))
    return whole.distinct().agg(F.count(column).alias("n"))


def pair_counts(edges: DataFrame, left: Column, right: Column) -> DataFrame:
    """(source, target, weight) of edges between different groups of their ends."""
    pairs = edges.select(left.alias("source"), right.alias("target")).where("source <> target")
    return pairs.groupBy("source", "target").agg(F.count("*").alias("weight"))


def ranked_union(first: DataFrame, second: DataFrame, keys: Sequence[str], score: str, k: int) -> DataFrame:
    """Two ranked lists as one: a key of both keeps the row of `first`; the best `k` by list and score."""
    both = first.withColumn("list_no", F.lit(1)).unionByName(second.withColumn("list_no", F.lit(2)))
    kept = top_per_key(both, keys, [F.col("list_no"), F.desc(score)], 1, "_p").drop("_p")
    return kept.orderBy("list_no", F.desc(score), *keys).limit(k)


def first_tier(candidates: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Of several candidate tables the rows of the first one that has any for the key, with its tier."""
    whole = None
    for tier, df in enumerate(candidates, 1):
        part = df.withColumn("tier", F.lit(tier).cast("long"))
        whole = part if whole is None else whole.unionByName(part)
    best = whole.groupBy(*keys).agg(F.min("tier").alias("tier"))
    return whole.join(best, [*keys, "tier"])


def missing(df: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of `df` without a partner in `known`."""
    return df.join(known.select(*keys).distinct(), list(keys), "left_anti")


def present(df: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of `df` with a partner in `known`."""
    return df.join(known.select(*keys).distinct(), list(keys), "left_semi")


def with_children(parents: DataFrame, key: str, children: Sequence[tuple[DataFrame, str, str]]) -> DataFrame:
    """Parents with the sorted distinct child values of several tables, each joined by '|'.

    Every child table is (table, its value column, name of the result) and is aggregated before it
    is joined, so that tables don't multiply each other's rows.
    """
    for table, value, name in children:
        listed = table.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(value)), "|").alias(name))
        parents = parents.join(listed, key, "left").withColumn(name, F.coalesce(name, F.lit("")))
    return parents


def common_groups(df: DataFrame, keys: Sequence[str], member: str, least: int = 2) -> DataFrame:
    """Key groups that occur with at least `least` different members: members and rows."""
    per = df.groupBy(*keys, member).agg(F.count("*").alias("rows"))
    grouped = per.groupBy(*keys).agg(F.count(member).alias("members"), F.sum("rows").alias("rows"))
    return grouped.where(F.col("members") >= least)


def members_in_common(df: DataFrame, key: str, member: str, min_similarity: float = 0.0, block_keys: int = 1000) -> DataFrame:
    """(key_a, key_b, shared, similarity) of keys that share members: Jaccard of their member sets, from `min_similarity` on.

    Keys whose sizes rule the similarity out are not paired. The keys of a member beyond `block_keys`
    are paired block by block in tasks of their own.
    """
    pairs = materialise(df.select(F.col(key).alias("k"), F.col(member).alias("m")).where("k is not null and m is not null").distinct())
    sized = pairs.join(pairs.groupBy("k").agg(F.count("*").alias("size")), "k")
    blocks = pairs.groupBy("m").agg(F.ceil(F.count("*") / block_keys).cast("int").alias("blocks"))
    hot = materialise(blocks.where("blocks > 1"))  # at most one row for every block_keys pairs

    def paired(side: DataFrame, on: Sequence[str], crossing: str) -> DataFrame:
        fits = F.expr(f"a.k < b.k and ({crossing}) and least(a.size, b.size) >= {min_similarity} * greatest(a.size, b.size)")
        both = side.alias("a").join(side.alias("b"), [F.col(f"a.{c}") == F.col(f"b.{c}") for c in on]).where(fits)
        return both.select(F.col("a.k").alias("key_a"), F.col("b.k").alias("key_b"), F.col("a.size").alias("sa"), F.col("b.size").alias("sb"))

    if hot.limit(1).count():
        split = sized.join(hot, "m").withColumn("own", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        split = split.select("m", "k", "size", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
        both = paired(sized.join(hot, "m", "left_anti"), ["m"], "true").unionByName(paired(split, ["m", "lo", "hi"], "a.lo = a.hi or a.own <> b.own"))
    else:
        both = paired(sized, ["m"], "true")
    shared = both.groupBy("key_a", "key_b").agg(F.count("*").alias("shared"), F.first("sa").alias("sa"), F.first("sb").alias("sb"))
    found = shared.select("key_a", "key_b", "shared", (F.col("shared") / (F.col("sa") + F.col("sb") - F.col("shared"))).alias("similarity"))
    return found.where(F.col("similarity") >= min_similarity)


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, q: float) -> DataFrame:
    """(keys, n, avg, min, max, p) with p the value at 0-based place int(q * n) of the sorted values."""
    order = Window.partitionBy(*keys).orderBy(value)
    ranked = df.where(F.col(value).isNotNull()).select(*keys, value, (F.row_number().over(order) - 1).alias("i"))
    sizes = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), (F.sum(F.col(value).cast("decimal(18,2)")).cast("double") / F.count("*")).alias("avg"), F.min(value).alias("min"), F.max(value).alias("max")
    )
    joined = ranked.join(sizes, list(keys)).where(F.col("i") == F.least(F.floor(F.col("n") * q), F.col("n") - 1))
    return joined.select(*keys, "n", "avg", "min", "max", F.col(value).alias("p"))


def totals_by_sets(df: DataFrame, sets: Sequence[Sequence[str]], aggregates: Sequence[Column]) -> DataFrame:
    """The same aggregates over several grouping sets in one pass; absent keys are null."""
    names = sorted({c for s in sets for c in s})
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in names]).agg(*aggregates)


def line_fit(df: DataFrame, keys: Sequence[str], x: str, y: str, at: float) -> DataFrame:
    """Least squares of y (hundredths) on a whole number x per key, evaluated at `at` and kept within 0 and 1.

    The sums are exact, so the result does not depend on row order; null for a single x.
    """
    own = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).cast("long").alias("_x"), F.col(y).cast("decimal(18,2)").alias("_y"))
    total = lambda c: F.sum(c).cast("double")
    sums = own.groupBy(*keys).agg(
        F.count("*").cast("double").alias("n"), total(F.col("_x")).alias("sx"), total(F.col("_y")).alias("sy"),
        total(F.col("_x") * F.col("_x")).alias("sxx"), total((F.col("_x") * F.col("_y")).cast("decimal(28,2)")).alias("sxy"),
    )
    slope = F.expr("(n * sxy - sx * sy) / nullif(n * sxx - sx * sx, 0D)")
    fit = sums.withColumn("slope", slope).withColumn("intercept", F.expr("(sy - slope * sx) / n"))
    value = F.col("intercept") + F.col("slope") * at
    return fit.select(*keys, "slope", "intercept", F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))).alias("forecast"))


def frequent_top(df: DataFrame, keys: Sequence[str], within: Sequence[str], k: int = 20, more_than: int = 3) -> DataFrame:
    """(within, keys, n): of every group of `within` the `k` most frequent keys, less those of `more_than` rows or fewer.

    The cut at `k` comes first; ties go to the lesser key.
    """
    counted = df.groupBy(*within, *keys).agg(F.count("*").alias("n"))
    return top_per_key(counted, within, [F.desc("n"), *[F.col(c) for c in keys]], k, "_p").where(F.col("n") > more_than).drop("_p")


def series(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str = "series") -> DataFrame:
    """(keys, n, series): the values (hundredths) of a key in order, joined by ','; null values are left out.

    A key's values meet in one list, so give it the rows of a bounded time.
    """
    listed = F.sort_array(F.collect_list(F.struct(*order, F.col(value).cast("decimal(18,2)").alias("_v"))))
    own = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), listed.alias("_l"))
    return own.select(*keys, "n", F.array_join(F.transform("_l", lambda x: x["_v"].cast("string")), ",").alias(name))


def summarised(df: DataFrame, key: str, member: str, kind: str) -> DataFrame:
    """(key, n, members, kinds): the size of a group, its distinct members and kinds in order, joined by '|'."""
    own = df.where(F.col(key).isNotNull())
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), "|")
    return own.groupBy(key).agg(F.count_distinct(member).alias("n"), listed(member).alias("members"), listed(kind).alias("kinds"))


def collected(df: DataFrame, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row with all rows of a small table as a JSON list, in order. The result is one row by definition: filter first."""
    return df.agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct(*order, F.struct(*columns).alias("_r")))), lambda x: x["_r"])).alias("rows"))


def where_given(df: DataFrame, **wanted: object) -> DataFrame:
    """Rows that equal every value that is given; None asks for nothing, a list asks for any of its values."""
    for column, value in wanted.items():
        if value is not None:
            df = df.where(F.col(column).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(column) == value)
    return df


def since(df: DataFrame, stamp: str, days: int, now: Column | None = None) -> DataFrame:
    """Rows of the last `days` days before `now`, or before the latest row."""
    if now is None:
        latest = df.agg(F.max(stamp).alias("_now"))  # one row
        return df.join(F.broadcast(latest), F.col(stamp) >= F.col("_now") - F.make_interval(days=F.lit(days))).drop("_now")
    return df.where(F.col(stamp) >= now - F.make_interval(days=F.lit(days)))


def best_above(df: DataFrame, keys: Sequence[str], choice: str, score: str, least: float, default: str) -> DataFrame:
    """(keys, choice): the choice of the highest score above `least` (ties: the lesser), else `default`."""
    best = df.groupBy(*keys).agg(F.min(F.struct((-F.col(score)).alias("s"), F.col(choice).alias("c"))).alias("b"))
    return best.select(*keys, F.when(-F.col("b.s") > least, F.col("b.c")).otherwise(F.lit(default)).alias(choice))


def validity(df: DataFrame, valid: Column, *keys: str) -> DataFrame:
    """(keys, total, valid, invalid); a test that is null counts as failed."""
    ok = F.coalesce(valid, F.lit(False))
    return df.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"))


def property_usage(df: DataFrame, prop: str, owner: str, kind: str, required: Column) -> DataFrame:
    """(prop, owners, kinds, required, optional): how many owners use a property, with which kinds ('any' for null) and how often it must be given."""
    own = df.withColumn("_k", F.coalesce(F.col(kind).cast("string"), F.lit("any"))).withColumn("_r", F.coalesce(required, F.lit(False)))
    return own.groupBy(prop).agg(F.count_distinct(owner).alias("owners"), F.array_join(F.array_sort(F.collect_set("_k")), "|").alias("kinds"), F.count_if("_r").alias("required"), F.count_if(~F.col("_r")).alias("optional"))


def pivoted_counts(df: DataFrame, classes: dict[str, Column]) -> DataFrame:
    """One row with a count for each named test."""
    return df.agg(*[F.count_if(F.coalesce(test, F.lit(False))).alias(name) for name, test in classes.items()])
