"""Scalar expressions over texts, names, paths and metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages by file ending.
LANGUAGE_OF = {
    "py": "python", "js": "javascript", "ts": "typescript", "jsx": "javascript", "tsx": "typescript", "java": "java", "c": "c",
    "cpp": "cpp", "h": "c", "hpp": "cpp", "cs": "c_sharp", "go": "go", "rb": "ruby", "php": "php", "html": "html", "css": "css",
    "rs": "rust", "swift": "swift", "kt": "kotlin",
}
# Kinds of files by ending, and builds by name; the first kind that fits wins.
KIND_OF = {
    "source": ["py", "js", "ts", "java", "c", "cpp", "cs", "go", "rb", "php", "rs", "swift", "kt"],
    "header": ["h", "hpp", "hxx"],
    "config": ["json", "xml", "yaml", "yml", "toml"],
    "documentation": ["md", "rst", "txt"],
    "markup": ["html", "css"],
    "build": ["sh", "bat", "ps1"],
}
BUILD_NAMES = ["makefile", "dockerfile", "jenkinsfile"]
# Path components that are ignored; they are compared whole, so those with a star never fit a real name.
IGNORED_PARTS = ["*.tmp", "*.log", "*.pyc", "__pycache__", "node_modules", ".git", ".env", "*.swp", "*.swo"]
CUSTOM_LANGUAGES = ["ini", "plaintext", "editorconfig", "asciidoc", "cobalt", "env", "graphql", "nim", "ocaml"]
TREE_LANGUAGES = ["python", "javascript", "typescript", "java", "go", "rust", "ruby", "c", "cpp", "c_sharp", "php", "html", "css", "json", "yaml", "sql"]


def base_name(path: Column) -> Column:
    """The last part of a path."""
    return F.regexp_extract(F.translate(path, "\\", "/"), "([^/]*)$", 1)


def extension(path: Column) -> Column:
    """The lower-cased ending of the last path part, '' without one; a leading dot begins no ending."""
    return F.lower(F.regexp_extract(base_name(path), "[^.].*\\.([^.]*)$", 1))


def language_of(path: Column) -> Column:
    """The language of a path by its ending, 'unknown' otherwise."""
    found = F.lit("unknown")
    ending = extension(path)
    for name in sorted(set(LANGUAGE_OF.values())):
        found = F.when(ending.isin([e for e, n in LANGUAGE_OF.items() if n == name]), name).otherwise(found)
    return found


def kind_of(path: Column) -> Column:
    """The kind of a file by its ending, 'other' otherwise."""
    found, ending = F.lit("other"), extension(path)
    for kind, endings in reversed(KIND_OF.items()):
        fits = ending.isin(endings)
        fits = fits | F.lower(base_name(path)).isin(BUILD_NAMES) if kind == "build" else fits
        found = F.when(fits, kind).otherwise(found)
    return found


def is_ignored(path: Column, parts: list[str] = IGNORED_PARTS) -> Column:
    """Whether a path component equals one of `parts`."""
    return F.exists(F.split(F.translate(path, "\\", "/"), "/"), lambda p: p.isin(parts))


def normalised_language(name: Column) -> Column:
    """Lower case, with hyphens and blanks as underscores."""
    return F.translate(F.lower(name), "- ", "__")


def parser_of(language: Column) -> Column:
    """'custom', 'tree_sitter' or 'unknown' by language; a custom parser goes first."""
    return F.when(language.isin(CUSTOM_LANGUAGES), "custom").when(language.isin(TREE_LANGUAGES), "tree_sitter").otherwise("unknown")


def lines(text: Column) -> Column:
    """Lines of a text without an empty last one, as in Python's splitlines for \\n, \\r and \\r\\n."""
    unified = F.regexp_replace(text, "\\r\\n|\\r", "\n")
    return F.when(unified == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(unified, "\\n\\z", ""), "\n"))


def line_counts(text: Column) -> Column:
    """struct(total, blank, comment, code); comments are lines that begin with // or #."""
    trimmed = F.transform(lines(text), lambda x: F.trim(F.regexp_replace(x, "\\t", " ")))
    total = F.size(trimmed)
    blank = F.size(F.filter(trimmed, lambda x: x == ""))
    comment = F.size(F.filter(trimmed, lambda x: x.startswith("//") | x.startswith("#")))
    return F.struct(total.cast("long").alias("total"), blank.cast("long").alias("blank"), comment.cast("long").alias("comment"), (total - blank - comment).cast("long").alias("code"))


def word_count(text: Column) -> Column:
    """Number of words between white space."""
    trimmed = F.regexp_replace(text, "^\\s+|\\s+$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, "\\s+"))).cast("long")


def share_of_comments(counts: Column) -> Column:
    """Maintainability from 0 to 100: the percentage of comment lines; null for no lines."""
    return F.when(counts["total"] > 0, F.least(F.lit(100.0), 100.0 * counts["comment"] / counts["total"]))


def completeness(text: Column) -> Column:
    """Words per hundred."""
    return word_count(text) / 100.0


def heading_share(text: Column) -> Column:
    """Heading lines (one to six hashes and a blank) per line; null for no lines."""
    own = lines(text)
    heads = F.size(F.filter(own, lambda x: x.rlike("^#{1,6} ")))
    return heads / F.nullif(F.size(own), F.lit(0)).cast("double")


def structure(text: Column) -> Column:
    """Lines that begin with a hash per line; 0 for no lines."""
    own = lines(text)
    heads = F.size(F.filter(own, lambda x: F.ltrim(F.translate(x, "\t", " ")).startswith("#")))
    return F.when(F.size(own) == 0, 0.0).otherwise(heads / F.size(own).cast("double"))


def pattern_complexity(pattern: Column) -> Column:
    """A weight of a query text: length, captures, alternatives, repetitions, options, groups."""
    def times(c: str) -> Column:
        return F.length(pattern) - F.length(F.replace(pattern, F.lit(c), F.lit("")))

    return F.floor(0.1 * F.length(pattern) + 2 * times("@") + 5 * times("|") + 3 * times("*") + 2 * times("?") + 0.5 * times("(")).cast("long")


def halstead_estimate(operators: Column, operands: Column) -> Column:
    """Total times log2 of half the total, at least 2; zero where either count is zero."""
    total = operators + operands
    half = F.greatest(F.lit(2), F.floor(total / 2))
    return F.when((operators == 0) | (operands == 0), 0.0).otherwise(total * F.log2(half))


def maintainability_index(cyclomatic: Column, cognitive: Column, loc: Column) -> Column:
    """171 less weighted complexity and size."""
    return 171 - 5.2 * (cyclomatic / 10.0) - 0.23 * cognitive - 16.2 * (loc / 1000.0)


# Classes of error messages by what they contain, in order.
ERROR_CLASSES = [
    ("syntax_error", ["syntax"]), ("timeout_error", ["timeout", "time limit"]), ("memory_error", ["memory"]), ("match_limit_error", ["match limit"]),
    ("partial_match_error", ["partial"]), ("ambiguous_match_error", ["ambiguous"]), ("recursion_error", ["recursion"]),
]
# Messages that are worth another try, and messages that are not.
RETRYABLE = [
    "connection refused", "timeout", "timed out", "temporarily unavailable", "deadlock", "connection reset", "broken pipe", "overloaded", "too many connections",
    "resource temporarily unavailable", "connection lost", "network error", "server unavailable", "service unavailable", "connection error", "socket error", "connection was reset",
]
NOT_RETRYABLE = [
    "syntax error", "constraint", "invalid", "not found", "already exists", "schema", "authentication", "authorization", "permission", "type error", "value error",
    "index error", "out of bounds", "null", "undefined",
]


def holds_any(text: Column, words: list[str]) -> Column:
    """Whether a text contains one of `words`."""
    found = F.lit(False)
    for word in words:
        found = found | F.contains(text, F.lit(word))
    return found


def error_class(message: Column) -> Column:
    """The class of an error message by the first words it contains, else 'unknown_error'."""
    found, low = F.lit("unknown_error"), F.lower(message)
    for name, words in reversed(ERROR_CLASSES):
        found = F.when(holds_any(low, words), name).otherwise(found)
    return found


def is_retryable(message: Column, by_type: Column | None = None) -> Column:
    """Whether a failure is worth another try: refusals win over transient causes, else the type of the error decides (default: no)."""
    low = F.lower(message)
    return F.when(holds_any(low, NOT_RETRYABLE), False).when(holds_any(low, RETRYABLE), True).otherwise(F.lit(False) if by_type is None else by_type)


def transaction_error(message: Column, status: Column) -> Column:
    """The class of a failed transaction: by its message, then by its status; null for other failures and for none."""
    low = F.lower(message)
    of_status = F.when(status == "commit_failed", "commit").when(status == "rollback_failed", "rollback")
    return F.when(F.contains(low, F.lit("deadlock")), "deadlock").when(F.contains(low, F.lit("timeout")), "timeout").when(message.isNotNull(), of_status)


def backoff(attempt: Column, base: float, most: float, slow: Column | None = None, factor: float = 2.0) -> Column:
    """Base doubled for each attempt, at most `most`; `slow` operations start from `factor` times the base."""
    start = F.lit(base) if slow is None else F.when(slow, base * factor).otherwise(base)
    return F.least(F.lit(most), start * F.pow(F.lit(2.0), attempt))


def repo_name_of(url: Column) -> Column:
    """The last part of a URL without .git."""
    return F.regexp_replace(F.regexp_extract(F.regexp_replace(url, "/+$", ""), "([^/]+)$", 1), "\\.git$", "")


def status_of_rate(rate: Column) -> Column:
    """'ok', 'degraded', 'error' or 'critical' by an error rate."""
    return F.when(rate == 0, "ok").when(rate < 0.1, "degraded").when(rate < 0.3, "error").otherwise("critical")


def component_health(success: Column, seconds: Column, least: float = 0.8, slow: float = 1.0) -> Column:
    """'degraded' for a success rate below `least` (0 without operations) or a mean time above `slow`, else 'healthy'."""
    return F.when(F.coalesce(success, F.lit(0.0)) < least, "degraded").when(seconds > slow, "degraded").otherwise("healthy")


# Naming conventions in order; a name needs what stands second, too.
CONVENTIONS = {
    "camelCase": ("^[a-z][a-zA-Z0-9]*$", "[A-Z]"), "snake_case": ("^[a-z][a-z0-9_]*$", "_"), "kebab-case": ("^[a-z][a-z0-9-]*$", "-"),
    "PascalCase": ("^[A-Z][a-zA-Z0-9]*$", ""), "UPPER_CASE": ("^[A-Z][A-Z0-9_]*$", "_"), "lowercase": ("^[a-z][a-z0-9]*$", ""),
}


def naming_convention(name: Column) -> Column:
    """One of six naming conventions, null for none; no name fits two of them."""
    found = F.lit(None).cast("string")
    for convention, (whole, held) in reversed(CONVENTIONS.items()):
        found = F.when(name.rlike(whole) & name.rlike(held), convention).otherwise(found)
    return found


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements of two arrays; null for two empty ones."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)).cast("double")


def share_spec(spec: Column) -> Column:
    """struct(ids, target) of a text such as '1,2:7'; null parts where it has another form."""
    ids = F.transform(F.split(F.regexp_extract(spec, "^([0-9, ]+):", 1), ","), lambda x: F.try_to_number(F.trim(x), F.lit("999999999999")).cast("long"))
    return F.struct(ids.alias("ids"), F.try_to_number(F.regexp_extract(spec, ":([0-9]+)$", 1), F.lit("999999999999")).cast("long").alias("target"))


def content_parts(text: Column) -> Column:
    """struct(length, letters, words) of a text, for `similar_parts`; arrays hold each element once, letters as numbers."""
    letters = F.transform(F.array_distinct(F.split(text, "")), lambda c: F.when(c != "", F.ascii(c)).otherwise(-1))
    words = F.array_distinct(F.regexp_extract_all(text, F.lit("(?U)\\w+"), F.lit(0)))
    return F.struct(F.length(text).alias("length"), letters.alias("letters"), words.alias("words"))


def similar_parts(a: Column, b: Column) -> Column:
    """`similar_content` of two texts, given as their `content_parts`; which text is first makes no difference."""

    def alike(name: str) -> Column:
        shared = F.size(F.array_intersect(a[name], b[name]))
        return shared / F.nullif(F.size(a[name]) + F.size(b[name]) - shared, F.lit(0)).cast("double")

    gap = F.abs(a["length"] - b["length"]) / F.nullif(F.greatest(a["length"], b["length"]), F.lit(0))
    return F.coalesce((gap < 0.3) & ((alike("letters") > 0.7) | (alike("words") > 0.5)), F.lit(False))


def similar_content(a: Column, b: Column) -> Column:
    """Whether two texts differ by less than 30 % in length and share most characters or half their words."""
    return similar_parts(content_parts(a), content_parts(b))


def capped_mean(*parts: tuple[Column, float]) -> Column:
    """Mean of the counts that are given, each as a share of its cap and at most 1; null without any."""
    shares = F.array_compact(F.array(*[F.when(count.isNotNull(), F.least(F.lit(1.0), count / cap)) for count, cap in parts]))
    return F.when(F.size(shares) > 0, F.aggregate(shares, F.lit(0.0), lambda s, x: s + x) / F.size(shares))


def embedded_language(text: Column) -> Column:
    """The first of python, java and javascript that a source block of a text names, else 'unknown'."""
    found = F.lit("unknown")
    for name in ("javascript", "java", "python"):
        found = F.when(F.contains(text, F.lit(f"[source,{name}]")), name).otherwise(found)
    return found


def capture_names(text: Column) -> Column:
    """The distinct names after an @ in a query text, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit("@([a-zA-Z0-9._]+)"), F.lit(1))))


def predicates(text: Column) -> Column:
    """The predicates of a query text, such as (#eq? @a "b")."""
    return F.regexp_extract_all(text, F.lit("\\(#[^)]*\\)"), F.lit(0))


def path_prefixes(path: Column) -> Column:
    """All directories above a path, shortest first."""
    parts = F.split(F.translate(path, "\\", "/"), "/")
    inner = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.when(F.size(inner) > 0, F.transform(F.sequence(F.lit(1), F.size(inner)), lambda n: F.array_join(F.slice(inner, F.lit(1), n), "/"))).otherwise(F.array().cast("array<string>"))


# Classes of option names by the words they contain, in order.
OPTION_CLASSES = {
    "connection": ["host", "server", "url", "endpoint"], "authentication": ["user", "password", "auth", "token", "key", "secret"], "logging": ["log", "debug", "verbose", "trace"],
    "filesystem": ["dir", "path", "file", "folder"], "connection_params": ["port", "timeout", "retry", "max", "min"], "feature_flags": ["enable", "disable", "toggle", "feature"],
}


def option_class(name: Column) -> Column:
    """One of six classes of an option name by the first words it contains, else 'other'."""
    found, low = F.lit("other"), F.lower(name)
    for kind, words in reversed(OPTION_CLASSES.items()):
        found = F.when(holds_any(low, words), kind).otherwise(found)
    return found


def testability(counts: Column, cyclomatic: Column) -> Column:
    """From 0 to 100: half the share of comment lines and 50 over the cyclomatic complexity; null for no lines."""
    ratio = counts["comment"] / F.nullif(counts["total"], F.lit(0))
    return F.when(ratio.isNotNull(), F.least(F.lit(100.0), ratio * 50 + 50.0 / F.greatest(cyclomatic, F.lit(1))))


def reusability(counts: Column, cognitive: Column, blocks: Column) -> Column:
    """From 0 to 100: 40 by comment lines, 30 by cognitive complexity, 30 by blocks per line; null for no lines."""
    total = F.nullif(counts["total"], F.lit(0))
    value = counts["comment"] / total * 40 + 30.0 / F.greatest(cognitive, F.lit(1)) + 30 * (blocks / total)
    return F.when(value.isNotNull(), F.least(F.lit(100.0), value))


def query_complexity(pattern: Column) -> Column:
    """A weight of a query text: a tenth of its length, two for a capture, five for an alternative."""
    times = lambda c: F.length(pattern) - F.length(F.replace(pattern, F.lit(c), F.lit("")))
    return F.length(pattern) * 0.1 + times("@") * 2 + times("|") * 5


def needs_adapting(uses: Column, rate: Column) -> Column:
    """Whether a pattern was used more than 10 times with a success rate below a half."""
    return (uses > 10) & (rate < 0.5)


def is_skipped(rate: Column, least: float = 0.2) -> Column:
    """Whether a pattern is left out for a success rate below `least`; a pattern without a rate is not."""
    return F.coalesce(rate < least, F.lit(False))


def compatibility(language: Column, pattern: Column) -> Column:
    """0.6 of the languages' and 0.4 of the patterns' agreement."""
    return language * 0.6 + pattern * 0.4


def weighted_confidence(parts: list[tuple[Column, float]]) -> Column:
    """Weighted sum of the scores that are given, at most 1; null counts as 0."""
    total = F.lit(0.0)
    for score, weight in parts:
        total = total + F.coalesce(score, F.lit(0.0)) * weight
    return F.least(F.lit(1.0), total)


def is_valid_span(first_line: Column, first_col: Column, last_line: Column, last_col: Column) -> Column:
    """Whether a location runs forwards from a place that exists."""
    return (first_line >= 0) & (last_line >= first_line) & (first_col >= 0) & (last_col >= first_col)


# Categories of tree nodes by type.
NODE_CATEGORIES = {
    "documentation": ["comment", "docstring", "javadoc"], "dependencies": ["import", "include", "namespace", "module"], "syntax": ["function", "class", "method", "constructor"],
    "semantics": ["type", "variable", "parameter"], "common_issues": ["error", "warning", "issue"], "user_patterns": ["pattern", "style", "convention"],
}


def node_category(node_type: Column) -> Column:
    """The category of a tree node by its type, else 'code_patterns'."""
    found = F.lit("code_patterns")
    for category, types in NODE_CATEGORIES.items():
        found = F.when(node_type.isin(types), category).otherwise(found)
    return found


def source_key(text: Column, *parts: Column) -> Column:
    """A key of a text for caches: the md5 of the text after the given parts."""
    return F.concat_ws(":", *parts, F.md5(F.coalesce(text, F.lit(""))))


def encoded(df, columns: list[str] | None = None, charset: str = "UTF-8"):  # noqa: ANN001, ANN201
    """`df` with its strings as bytes, inside arrays, maps and structs too."""
    from pyspark.sql import types as t

    def deep(value: Column, kind: t.DataType) -> Column:
        if isinstance(kind, t.StringType):
            return F.encode(value, charset)
        if isinstance(kind, t.ArrayType):
            return F.transform(value, lambda x: deep(x, kind.elementType))
        if isinstance(kind, t.MapType):
            return F.transform_values(value, lambda _, x: deep(x, kind.valueType))
        if isinstance(kind, t.StructType):
            return F.when(value.isNotNull(), F.struct(*[deep(value[f.name], f.dataType).alias(f.name) for f in kind.fields]))
        return value

    return df.select(*[deep(F.col(f.name), f.dataType).alias(f.name) if columns is None or f.name in columns else F.col(f.name) for f in df.schema.fields])
