"""Vector arithmetic on ``array<double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from foreglass.functions.text import _col


def dot(a, b) -> Column:
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    """Cosine similarity; a zero vector gives 0."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def vector_dice(a, b) -> Column:
    """2 a.b / (a.a + b.b); two zero vectors give 0."""
    total = dot(a, a) + dot(b, b)
    return F.when(total == 0, F.lit(0.0)).otherwise(2 * dot(a, b) / total)


def average_ranks(a) -> Column:
    """Rank of every element with ties averaged, for one short vector."""
    a = _col(a)

    def rank(x: Column) -> Column:
        below = F.size(F.filter(a, lambda y: y < x))
        same = F.size(F.filter(a, lambda y: y == x))
        return below + (same + 1) / F.lit(2.0)

    return F.transform(a, rank)


def pearson(a, b) -> Column:
    """Correlation from sums; NULL when one vector is constant."""
    a, b = _col(a), _col(b)
    n = F.size(a).cast("double")
    sum_a = F.aggregate(a, F.lit(0.0), lambda t, x: t + x.cast("double"))
    sum_b = F.aggregate(b, F.lit(0.0), lambda t, x: t + x.cast("double"))
    spread = (n * dot(a, a) - sum_a * sum_a) * (n * dot(b, b) - sum_b * sum_b)
    return F.when(spread > 0, (n * dot(a, b) - sum_a * sum_b) / F.sqrt(spread))


def spearman(a, b) -> Column:
    return pearson(average_ranks(a), average_ranks(b))


def word_set(tokens) -> Column:
    return F.array_distinct(_col(tokens))


def common_words(a, b) -> Column:
    """Words of both token arrays, in the order of the first."""
    return F.array_intersect(word_set(a), word_set(b))


def word_dice(a, b) -> Column:
    total = F.size(word_set(a)) + F.size(word_set(b))
    return F.when(total == 0, F.lit(0.0)).otherwise(2 * F.size(common_words(a, b)) / total)


def word_jaccard(a, b) -> Column:
    shared = F.size(common_words(a, b))
    total = F.size(word_set(a)) + F.size(word_set(b)) - shared
    return F.when(total == 0, F.lit(0.0)).otherwise(shared / total)


def elementwise_mean(*scores) -> Column:
    """Mean of the non-null score columns of a row; NULL if all are missing."""
    values = F.array_compact(F.array(*[_col(s).cast("double") for s in scores]))
    total = F.aggregate(values, F.lit(0.0), lambda t, x: t + x)
    return F.when(F.size(values) > 0, total / F.size(values))
