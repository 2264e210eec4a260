"""Vector kernels as Column expressions. All sums are in double; no square root is taken of L2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2sq(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (norm(a) * norm(b))


def pack_signs(a: Column, dim: int) -> Column:
    """Code words: bit b of word w is dimension 64 * w + b, set where the value is not negative."""
    word = lambda w: F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(F.when(F.get(a, b + 64 * w) >= 0, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))))
    return F.array(*[word(w) for w in range(dim // 64)])


def popcount(code: Column) -> Column:
    return F.aggregate(code, F.lit(0), lambda a, x: a + F.bit_count(x))


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def sq8_fixed(values: Column, low: float = -1.0, high: float = 1.0) -> Column:
    """8-bit codes over a fixed range; what lies outside is clamped."""
    return F.transform(values, lambda x: F.floor(F.round(F.least(F.greatest((x.cast("double") - low) * (255 / (high - low)), F.lit(0.0)), F.lit(255.0)), 6)))


def sq8_fixed_distance(query: Column, codes: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return l2sq(query, F.transform(codes, lambda c: c * ((high - low) / 255) + low))


def sq8_dynamic(residual: Column, low: Column, scale: Column) -> Column:
    """8-bit codes of a residual over ranges of its partition; what lies outside is clamped."""
    return F.transform(residual, lambda r, d: F.floor(F.round(F.least(F.greatest((r.cast("double") - F.get(low, d)) * F.get(scale, d), F.lit(0.0)), F.lit(255.0)), 6)))


def sq8_dynamic_distance(query: Column, centroid: Column, codes: Column, low: Column, scale: Column) -> Column:
    """Squared L2 of a query from a vector that is kept as its centroid and an 8-bit residual."""
    return l2sq(query, F.transform(codes, lambda c, d: F.get(centroid, d) + F.get(low, d) + c / F.get(scale, d)))


def l2sq_within(a: Column, b: Column, threshold: Column | float, dim: int, block: int = 16) -> Column:
    """Squared L2, or null past the threshold: a block of dimensions is summed only while the sum so far is within it."""
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)

    def after(total: Column, at: int) -> Column:
        if at >= dim:
            return F.when(total <= limit, total)
        return F.when(total <= limit, after(total + l2sq(F.slice(a, at + 1, block), F.slice(b, at + 1, block)), at + block))

    return after(F.lit(0.0), 0)
