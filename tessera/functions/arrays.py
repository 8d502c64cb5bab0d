"""Array expressions that keep order and duplicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OTHER = "其他"  # fixed value: the choice that asks for free text


def shared_items(a: Column, b: Column) -> Column:
    return F.filter(a, lambda x: F.array_contains(b, x))


def overlap_count(a: Column, b: Column) -> Column:
    """Directional: counts a's elements, duplicates included."""
    return F.size(shared_items(a, b))


def first(a: Column) -> Column:
    return F.get(a, F.lit(0))


def joined_or(a: Column, sep: str, default: str) -> Column:
    return F.when(F.size(a) > 0, F.array_join(a, sep)).otherwise(F.lit(default))


def toggled(a: Column, x: Column, most: int) -> Column:
    """Removes all of x, or appends it while there is room."""
    return F.when(F.array_contains(a, x), F.array_remove(a, x)).when(F.size(a) >= most, a).otherwise(F.array_append(a, x))


def in_vocabulary(a: Column, words) -> Column:
    vocabulary = F.array(*[F.lit(w) for w in words])
    return F.filter(a, lambda x: F.array_contains(vocabulary, x))


def with_other(c: Column, text: Column) -> Column:
    return F.when(c == OTHER, text).otherwise(c)


def all_with_other(a: Column, text: Column) -> Column:
    """Elements that ask for free text become it, if there is some."""
    return F.when(F.array_contains(a, F.lit(OTHER)) & (F.length(text) > 0), F.transform(a, lambda x: F.when(x == OTHER, text).otherwise(x))).otherwise(a)
