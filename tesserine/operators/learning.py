"""Learning patterns from examples and from their results: rule-based rewrites of pattern texts."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Parts of a pattern that may be left out below the other part.
OPTIONAL_PARTS = [("parent", "child"), ("class", "method"), ("function", "parameter"), ("if", "then"), ("for", "body")]
RARE, COMMON, TOP = 3, 5, 3  # captures, structures and how many structures are looked at


def without_rare_captures(pattern: str, confidence: float, captures: dict[str, int], structures: dict[str, int]) -> tuple[str, float]:
    """Captures seen less than 3 times are dropped; the 3 commonest structures `capture:type` of 5 or more gain theirs.

    A pattern without a rare capture stays as it is. Each capture gained raises the confidence by .05, up to .95.
    """
    rare = [name for name, n in captures.items() if n < RARE]
    if not rare:
        return pattern, confidence
    for name in rare:
        pattern = re.sub("@" + re.escape(name) + r"\b", "", pattern)
    for structure, n in sorted(structures.items(), key=lambda x: (-x[1], x[0]))[:TOP]:
        capture, _, kind = structure.partition(":")
        plain, captured = f"({kind})", f"({kind}) @{capture}"
        if n >= COMMON and plain in pattern and captured not in pattern:
            pattern, confidence = pattern.replace(plain, captured, 1), confidence + 0.05
    return pattern, min(confidence, 0.95)


def without_poor_predicates(pattern: str, confidence: float, predicates: dict[str, tuple[int, int]]) -> tuple[str, float]:
    """Predicates (successes, failures) below .3 of more than 5: matches lose their anchors, others go.

    Each lowers the confidence by .03, not below .3.
    """
    poor = [p for p, (good, bad) in predicates.items() if good + bad > 5 and good / (good + bad) < 0.3]
    for predicate in poor:
        if re.search(r"#\w+\?\s+@\w+", predicate):
            text = re.search(r'"([^"]+)"', predicate) if "#match?" in predicate else None
            if text:
                pattern = pattern.replace(predicate, predicate.replace(text[1], re.sub(r"[\^$]", "", text[1])), 1)
            elif "#match?" not in predicate:
                pattern = pattern.replace(predicate, "", 1)
        confidence -= 0.03
    return (pattern, max(confidence, 0.3)) if poor else (pattern, confidence)


def generalised_pattern(pattern: str, confidence: float, matches: int) -> tuple[str, float]:
    """With 5 matches or more, plain literals of over three characters become wildcards (-.02 each) and parts below others optional (-.01 each)."""
    if matches < 5:
        return pattern, confidence
    new = pattern
    for literal in re.findall(r'"([^"]+)"', pattern):
        if len(literal) > 3 and not re.search(r"[\^$*+?]", literal):
            new, confidence = new.replace(f'"{literal}"', '".*"', 1), confidence - 0.02
    for above, below in OPTIONAL_PARTS:
        part = re.search(r"\(" + below + r"[^)]*\)", new) if f"({above}" in new else None
        if part and new[part.end() : part.end() + 1] != "?":
            new, confidence = new.replace(part[0], part[0] + "?", 1), confidence - 0.01
    return (new, max(confidence, 0.3)) if new != pattern else (pattern, confidence)


def with_commonest_node(pattern: str, confidence: float, commonest: str | None) -> tuple[str, float]:
    """Wildcard nodes become the commonest node type; confidence grows by .05 up to .95."""
    new = re.sub(r"\((?:_|\.)\)", lambda _: f"({commonest})", pattern) if commonest else pattern
    return (new, min(confidence + 0.05, 0.95)) if new != pattern else (pattern, confidence)


Strategy = Callable[[str, float, dict], tuple[str, float]]
# Rewrites in the order in which they are applied; more can be registered.
STRATEGIES: dict[str, Strategy] = {
    "node_pattern_improvement": lambda p, c, seen: with_commonest_node(p, c, max(sorted(seen["nodes"]), key=seen["nodes"].get, default=None)),
    "capture_optimization": lambda p, c, seen: without_rare_captures(p, c, seen["captures"], seen["structures"]),
    "predicate_refinement": lambda p, c, seen: without_poor_predicates(p, c, seen["predicates"]),
    "pattern_generalization": lambda p, c, seen: generalised_pattern(p, c, seen["matches"]),
}


def register_strategy(name: str, strategy: Strategy) -> None:
    """Add a rewrite (pattern, confidence, insights) -> (pattern, confidence) behind the others, or replace one."""
    STRATEGIES[name] = strategy


def improved_patterns(df: DataFrame, key: str, strategies: Sequence[str] | None = None) -> DataFrame:
    """(key, pattern, confidence, applied): the rewrites in order, each on the result of the one before.

    Columns of `df`: pattern, confidence, nodes, captures and structures (maps of counts), predicates
    (map of struct<success, failure>), matches. The confidence of a rewritten pattern is the greatest
    that it had. A null pattern stays null, null maps hold nothing; a rewrite that fails is left out.
    """
    chosen = {n: f for n, f in STRATEGIES.items() if strategies is None or n in strategies}

    @F.pandas_udf("pattern string, confidence double, applied array<string>")
    def rewrite(pattern: pd.Series, confidence: pd.Series, nodes: pd.Series, captures: pd.Series, structures: pd.Series, predicates: pd.Series, matches: pd.Series) -> pd.DataFrame:
        rows = []
        for own, start, *seen, n in zip(pattern, confidence, nodes, captures, structures, predicates, matches):
            if own is None:
                rows.append((None, start, []))
                continue
            insights = dict(zip(("nodes", "captures", "structures"), (dict(x) if x is not None else {} for x in seen[:3])))
            insights["predicates"] = {p: (int(s["success"]), int(s["failure"])) for p, s in (dict(seen[3]) if seen[3] is not None else {}).items()}
            insights["matches"], best, applied = int(n or 0), start, []
            for name, strategy in chosen.items():
                try:
                    new, sure = strategy(own, start, insights)
                except Exception:  # a plug-in that fails changes nothing
                    continue
                if new != own:
                    own, best = new, max(best, sure)
                    applied.append(name)
            rows.append((own, best, applied))
        return pd.DataFrame(rows, columns=["pattern", "confidence", "applied"])

    done = rewrite("pattern", F.col("confidence").cast("double"), "nodes", "captures", "structures", "predicates", F.col("matches").cast("long"))
    return df.select(key, done.alias("r")).select(key, "r.*")


def insight_counts(matches: DataFrame, key: str) -> DataFrame:
    """(key, nodes, captures, structures, matches) of captured nodes (key, match, capture, type): the counts that rewrites read.

    Kinds are few for each pattern; they are counted before they meet in a map.
    """
    def counted(column: Column, name: str) -> DataFrame:
        per = matches.groupBy(key, column.alias("_c")).agg(F.count("*").cast("int").alias("_n"))
        return per.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_c", "_n"))).alias(name))

    total = matches.groupBy(key).agg(F.count_distinct("match").alias("matches"))
    found = counted(F.col("type"), "nodes").join(counted(F.col("capture"), "captures"), key)
    return found.join(counted(F.concat_ws(":", "capture", "type"), "structures"), key).join(total, key)


def variations(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, group_no, n, pattern, score): the distinct texts of a key in groups of similar content, with a pattern for each.

    Texts are taken in order, and each joins the first group whose first text is similar to it; the
    best group is the one of the least score. A key's distinct texts meet in one task, so give it
    examples and not a corpus. Null keys and empty texts are left out.
    """
    key_type = df.schema[key].dataType.simpleString()

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        groups: list[list[str]] = []
        for own in sorted(set(pdf["_t"])):
            home = next((g for g in groups if _alike(g[0], own)), None)
            if home is None:
                groups.append([own])
            else:
                home.append(own)
        patterns = [regex_of_examples(g) for g in groups]
        scores = [len(p) + sum(map(p.count, "([|")) for p in patterns]
        return pd.DataFrame({key: [pdf[key].iloc[0]] * len(groups), "group_no": range(len(groups)), "n": [len(g) for g in groups], "pattern": patterns, "score": scores})

    own = df.where(F.col(key).isNotNull() & (F.length(text) > 0)).select(key, F.col(text).cast("string").alias("_t")).distinct()
    return own.groupBy(key).applyInPandas(group, f"`{key}` {key_type}, group_no long, n long, pattern string, score long")


def _alike(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) / max(len(a), len(b)) >= 0.3:
        return False
    share = lambda x, y: len(x & y) / len(x | y) if x | y else 0
    return share(set(a), set(b)) > 0.7 or share(set(re.findall(r"\w+", a)), set(re.findall(r"\w+", b))) > 0.5


# Confidence of a recommendation by what it rests on.
RECOMMENDATION_CONFIDENCE = {"code_structure": 0.85, "naming": 0.75, "documentation": 0.7, "architecture": 0.8}


def recommendations(patterns: DataFrame, targets: DataFrame, on: Sequence[str]) -> DataFrame:
    """(target columns, kind, pattern, confidence): patterns of the same language or type proposed for targets, with the confidence of their kind."""
    sure = F.lit(None).cast("double")
    for kind, value in RECOMMENDATION_CONFIDENCE.items():
        sure = F.when(F.col("kind") == kind, value).otherwise(sure)
    joined = targets.join(patterns.select(*on, "kind", "pattern").distinct(), list(on))
    return joined.withColumn("confidence", sure).where("confidence is not null")


def transferred(patterns: DataFrame, target: DataFrame, on: Sequence[str], category: str, least: float = 0.3) -> DataFrame:
    """(category, moved, skipped): patterns that pass to a repository which knows their `on` columns and agrees enough; counted by category."""
    known = target.select(*on).distinct().withColumn("_known", F.lit(True))
    joined = patterns.join(known, list(on), "left")
    passes = F.coalesce("_known", F.lit(False)) & (F.coalesce("compatibility", F.lit(0.0)) >= least)
    return joined.groupBy(category).agg(F.count_if(passes).alias("moved"), F.count_if(~passes).alias("skipped"))


def validated(cases: DataFrame) -> DataFrame:
    """`cases` (pattern, input, expected) with `matches` and `passed`.

    expected is JSON: true wants a match, false none, a number that many, a list as many as it has,
    an object a match whose named groups hold its values. A pattern that does not compile fails all
    its cases; a null pattern or input does, too.
    """
    @F.pandas_udf("matches long, passed boolean")
    def check(pattern: pd.Series, given: pd.Series, expected: pd.Series) -> pd.DataFrame:
        rows = []
        for p, text, wanted in zip(pattern, given, expected):
            try:
                found = list(re.finditer(p, text, re.MULTILINE | re.DOTALL))
                want = json.loads(wanted) if wanted is not None else True
            except (re.error, TypeError, ValueError):
                rows.append((0, False))
                continue
            if isinstance(want, bool):
                good = bool(found) == want
            elif isinstance(want, dict):
                good = any(all(m.groupdict().get(k) == v for k, v in want.items()) for m in found)
            else:
                good = len(found) == (len(want) if isinstance(want, list) else want)
            rows.append((len(found), good))
        return pd.DataFrame(rows, columns=["matches", "passed"])

    return cases.withColumn("_r", check("pattern", "input", "expected")).select(*cases.columns, "_r.matches", "_r.passed")


def merged_pattern(df: DataFrame, key: str, pattern: str) -> DataFrame:
    """(key, merged): the distinct patterns of a key as alternatives, in order."""
    return df.groupBy(key).agg(F.concat(F.lit("(?:"), F.array_join(F.array_sort(F.collect_set(pattern)), "|"), F.lit(")")).alias("merged"))


def variation_score(pattern: Column) -> Column:
    """Length and the number of groups, classes and alternatives; simpler is lower."""
    def times(c: str) -> Column:
        return F.length(pattern) - F.length(F.replace(pattern, F.lit(c), F.lit("")))

    return (F.length(pattern) + times("(") + times("[") + times("|")).cast("long")


def _kinds(middle: str) -> int:
    """Bits of what a middle is not (1 digits, 2 ASCII letters, 4 word characters), 8 a line end, 16 empty."""
    if not middle:
        return 16
    digits, letters, words = re.fullmatch(r"\d+", middle), middle.isascii() and middle.isalpha(), re.fullmatch(r"\w+", middle)
    return (not digits) + 2 * (not letters) + 4 * (not words) + 8 * ("\n" in middle)


def _pattern(prefix: str, suffix: str, kinds: int) -> str:
    kind = r"\d" if not kinds & 1 else r"[a-zA-Z]" if not kinds & 2 else r"\w" if not kinds & 4 else r"[\s\S]" if kinds & 8 else r"."
    return re.escape(prefix) + kind + ("*" if kinds & 16 else "+") + re.escape(suffix)


def regex_of_examples(examples: list[str]) -> str:
    """A pattern that matches all examples whole: common prefix and suffix around one character class."""
    examples = sorted({e for e in examples if e})
    if not examples:
        return ""
    if len(examples) == 1:
        return re.escape(examples[0])
    prefix = os.path.commonprefix(examples)
    rest = [e[len(prefix) :] for e in examples]
    suffix = os.path.commonprefix([r[::-1] for r in rest])[::-1]
    kinds = 0
    for r in rest:
        kinds |= _kinds(r[: len(r) - len(suffix)])
    return _pattern(prefix, suffix, kinds)


def learned_patterns(df: DataFrame, key: str, example: str) -> DataFrame:
    """(key, pattern): one pattern per key that matches all of its distinct examples.

    The least and the greatest example have the common prefix, those of the reversed examples the
    suffix. A second pass over all examples combines what their middles are, so no key's examples
    have to meet in one place. Null keys and null or empty examples are left out.
    """
    whole = df.select(F.col(key).alias("_k"), F.col(example).cast("string").alias("_e")).where("_k is not null and _e is not null and _e <> ''")
    back = F.reverse("_e")
    bounds = whole.groupBy("_k").agg(F.min("_e").alias("least"), F.max("_e").alias("most"), F.min(back).alias("back_least"), F.max(back).alias("back_most"), F.min(F.length("_e")).alias("shortest"))

    @F.pandas_udf("prefix string, suffix string")
    def ends(least: pd.Series, most: pd.Series, back_least: pd.Series, back_most: pd.Series, shortest: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b, c, d, n in zip(least, most, back_least, back_most, shortest):
            prefix = os.path.commonprefix([a, b])
            # The suffix does not reach into the prefix of the shortest example.
            rows.append((prefix, os.path.commonprefix([c, d])[: n - len(prefix)][::-1]))
        return pd.DataFrame(rows, columns=["prefix", "suffix"])

    @F.pandas_udf("int")
    def kinds(value: pd.Series, before: pd.Series, after: pd.Series) -> pd.Series:
        return pd.Series([_kinds(v[p : len(v) - s]) for v, p, s in zip(value, before, after)], dtype="int32")

    @F.pandas_udf("string")
    def pattern(prefix: pd.Series, suffix: pd.Series, kinds: pd.Series, single: pd.Series) -> pd.Series:
        return pd.Series([re.escape(p) if one else _pattern(p, s, k) for p, s, k, one in zip(prefix, suffix, kinds, single)], dtype=object)

    bounds = bounds.withColumn("ends", ends("least", "most", "back_least", "back_most", "shortest")).select("_k", "ends.prefix", "ends.suffix", (F.col("least") == F.col("most")).alias("single"))
    sized = whole.join(bounds.select("_k", F.length("prefix").alias("before"), F.length("suffix").alias("after")), "_k")
    seen = sized.select("_k", kinds("_e", "before", "after").alias("kinds")).groupBy("_k").agg(F.bit_or("kinds").alias("kinds"))
    return bounds.join(seen, "_k").select(F.col("_k").alias(key), pattern("prefix", "suffix", "kinds", "single").alias("pattern"))


def improvement(before: Column, after: Column) -> Column:
    """Relative gain of matches; without earlier matches 1 for any and 0 for none."""
    return F.when(before == 0, F.when(after > 0, 1.0).otherwise(0.0)).otherwise((after - before) / before)
