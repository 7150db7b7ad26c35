"""Character k-grams of a string, hashed natively: UTF-32 makes a code point four bytes, so a gram is a slice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, though body names it often."""
    return F.element_at(F.transform(F.array(value), body), 1)


def code_points(text: Column) -> Column:
    return F.encode(text, "UTF-32")


def gram_count(points: Column, k: int) -> Column:
    """Grams of k code points; a shorter text that isn't empty has one, itself."""
    n = (F.length(points) / 4).cast("int")
    return F.when(n > 0, F.greatest(n - k + 1, F.lit(1))).otherwise(F.lit(0))


def gram_hash(points: Column, at: Column, k: int, *seed: Column) -> Column:
    return F.xxhash64(F.substring(points, at * 4 + 1, F.lit(4 * k)), *seed)


def map_grams(points: Column, k: int, f: Callable[[Column], Column]) -> Column:
    """f(i) for the place i of every gram, from 0."""
    n = gram_count(points, k)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), f)).otherwise(F.array().cast("array<bigint>"))
