"""Column expressions: no Python runs on rows here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float = 0.0, high: float = 5.0) -> Column:
    """``x`` within the bounds of a rating; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, null where ``b`` is 0."""
    return a / F.nullif(b, F.lit(0.0))


def row_hash(row: Column, j: Column, multiplier: int, modulus: int) -> Column:
    """The j-th hash of a row number: multiplier * row + j, modulo modulus."""
    return (row * multiplier + j) % modulus


def min_hashes(rows: Column, hashes: int, multiplier: int, modulus: int) -> Column:
    """Least hash of an array of row numbers under each hash function, as an array.

    All functions of the family are shifts of one: with the rows' distinct products modulo the
    modulus in order, the least hash climbs by one a shift and falls to 0 where the next smaller
    product wraps. So a signature is the climbs in a row, one step for each of its numbers.
    """
    base = F.array_distinct(F.transform(rows, lambda r: (r * multiplier) % modulus))
    if hashes > modulus:
        return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda j: F.array_min(F.transform(base, lambda b: (b + j) % modulus)))
    low, high = F.array_min(base), F.array_max(base)
    falling = F.sort_array(base, False)
    gaps = F.zip_with(F.slice(falling, 1, F.size(falling) - 1), F.slice(falling, 2, F.size(falling)), lambda b, below: b - below)
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    climbs = F.concat(F.array(F.sequence(low, low + modulus - high - 1)), F.transform(gaps, lambda g: F.sequence(zero, g - one)), F.array(F.sequence(zero, F.lit(modulus - 1).cast("long"))))
    return F.slice(F.flatten(climbs), 1, hashes)


def band_bucket(signature: Column, band: Column, weights: list[int], modulus: int) -> Column:
    """Weighted sum of a band of a signature, modulo ``modulus``."""
    rows = len(weights)
    part = F.slice(signature, band * rows + 1, F.lit(rows))
    return F.aggregate(F.zip_with(part, F.array(*[F.lit(w).cast("long") for w in weights]), lambda x, w: x * w), F.lit(0).cast("long"), lambda a, x: a + x) % modulus


def tuple_text(items: Column) -> Column:
    """``(a, b)`` for an array."""
    return F.concat(F.lit("("), F.array_join(F.transform(items, lambda i: i.cast("string")), ", "), F.lit(")"))
