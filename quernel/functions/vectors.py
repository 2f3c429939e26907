"""Vector functions over array columns, computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity in -1..1; null where a norm is zero, so that the row drops out of rankings."""
    n = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(n > 0, dot(a, b) / n)


def cosine_clamped(a: Column, b: Column) -> Column:
    """Cosine similarity cut to 0..1; zero vectors give 0."""
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), cosine(a, b))), F.lit(0.0))


def l2_normalize(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    return F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double"))))[0]


def token_vector(token: Column, dim: int) -> Column:
    """A vector from the bytes of the token's SHA-256, repeated as needed, each scaled to -1..1."""
    return F.transform(F.array(F.sha2(token, 256)), lambda h: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.conv(F.substring(h, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255 * 2 - 1))[0]


def hash_embedding(tokens: Column, dim: int = 300) -> Column:
    """The normalised sum of the tokens' vectors, repeats counted; no tokens give zeros."""
    zero = F.array_repeat(F.lit(0.0), dim)
    total = F.aggregate(tokens, zero, lambda s, t: F.zip_with(s, token_vector(t, dim), lambda a, b: a + b))
    return F.transform(F.array(total), l2_normalize)[0]
