"""Column helpers shared by the operators that stay in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: The characters that part words.
WHITE = "\x20\t\n\x0b\x0c\r"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def without(text: Column, letters: str) -> Column:
    return F.translate(text, letters, "")


def words(text: Column) -> Column:
    """``[^\\x20\\x09-\\x0D]+`` of a text, in order; null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), WHITE, " " * len(WHITE)), " "), "")


def word_windows(w: Column, n: int, hashed=F.xxhash64) -> Column:
    """Hash of each ``n`` consecutive items of array ``w``."""
    starts = F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: hashed(*(F.get(w, i + k) for k in range(n))))


def total(numbers: Column, kind: str = "long") -> Column:
    return F.aggregate(numbers, F.lit(0).cast(kind), lambda a, x: a + x.cast(kind))
