"""Vector functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body of a value that is computed once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hash_embedding(text: Column, dimension: int) -> Column:
    """Deterministic vector of length one from SHA-256 of 'k:text', k = 0, 1, ..: each byte b gives b / 127.5 - 1."""
    blocks = F.sequence(F.lit(0), F.lit(-(-dimension // 32) - 1))
    digests = let(text, lambda t: F.transform(blocks, lambda k: F.sha2(F.concat(k.cast("string"), F.lit(":"), t), 256)))
    byte = F.sequence(F.lit(1), F.lit(63), F.lit(2))
    values = F.flatten(F.transform(digests, lambda d: F.transform(byte, lambda i: F.conv(F.substring(d, i, F.lit(2)), 16, 10).cast("int") / 127.5 - 1.0)))
    return normalized(F.slice(values, 1, dimension))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0).cast("double"), lambda a, x: a + x * x))


def normalized(v: Column) -> Column:
    return let(v, lambda a: let(norm(a), lambda n: F.transform(a, lambda x: x / F.when(n == 0, F.lit(1.0)).otherwise(n))))


def rounded(v: Column, places: int = 6) -> Column:
    return F.transform(v, lambda x: F.round(x, places))
