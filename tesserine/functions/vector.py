"""Vector expressions on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product; null where a vector is null or their lengths differ."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    value = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), value)


def norm(a: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(dot(a, a))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine; null where a vector is null, of another length or all zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def cosine_distance(a: Column, b: Column) -> Column:
    """One minus the cosine."""
    return 1 - cosine_similarity(a, b)


def euclidean(a: Column, b: Column) -> Column:
    """Euclidean distance."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def has_dimension(a: Column, dim: int) -> Column:
    """Whether a vector has `dim` finite values that are not all zero; null counts as no."""
    finite = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(a) == dim) & finite & F.exists(a, lambda x: x != 0), F.lit(False))


def adjusted_confidence(similarity: Column, same_language: Column, complexity_a: Column, complexity_b: Column) -> Column:
    """Similarity raised by a tenth for the same language and lowered by the gap of complexities, at most 1.

    A complexity of null or zero means there is none; a null similarity gives null.
    """
    both = (F.coalesce(complexity_a, F.lit(0)) != 0) & (F.coalesce(complexity_b, F.lit(0)) != 0)
    raised = similarity * F.when(same_language, 1.1).otherwise(1.0)
    value = raised * F.when(both, 1 - F.abs(complexity_a - complexity_b) / 10.0).otherwise(1.0)
    return F.when(value.isNotNull(), F.least(F.lit(1.0), value))


def enriched_text(text: Column, path: Column, language: Column, dependencies: Column) -> Column:
    """A text with a line each for file, language and dependencies in front, where they are given."""
    file = F.when(path.isNotNull(), F.concat(F.lit("File: "), path))
    tongue = F.when(language.isNotNull(), F.concat(F.lit("Language: "), language))
    needs = F.when(F.size(dependencies) > 0, F.concat(F.lit("Dependencies: "), F.array_join(dependencies, ", ")))
    return F.concat_ws("\n", needs, tongue, file, text)


def architecture_text(parts: dict[str, Column]) -> Column:
    """One line `name: value` for every part that is given."""
    return F.concat_ws("\n", *[F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value)) for name, value in parts.items()])
