"""Naming a value inside an expression, and running sums of arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once however often body uses it."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


#: Elements summed in one go; an array append copies what it has, so longer arrays are summed block by block.
_BLOCK = 128


def running_sums(values: Column) -> Column:
    """Of an int array: element i is the sum of the first i + 1. Time grows as n * _BLOCK, not as n * n."""

    def short(v: Column) -> Column:
        start = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("out"))

        def step(a: Column, x: Column) -> Column:
            total = (a["sum"] + x).cast("int")
            return F.struct(total.alias("sum"), F.array_append(a["out"], total).alias("out"))

        return F.aggregate(v, start, step, lambda a: a["out"])

    def long(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), ((F.size(v) - 1) / _BLOCK).cast("int")), lambda b: short(F.slice(v, b * _BLOCK + 1, _BLOCK)))

        def joined(parts: Column) -> Column:
            before = short(F.transform(parts, lambda p: F.element_at(p, -1)))
            return bound(before, lambda t: F.flatten(F.transform(parts, lambda p, i: F.transform(p, lambda x: x + F.coalesce(F.get(t, i - 1), F.lit(0))))))

        return bound(blocks, joined)

    return bound(values.cast("array<int>"), lambda v: F.when(F.size(v) <= _BLOCK, short(v)).otherwise(long(v)))


def settled(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a column that the optimizer does not fold into the expressions that use it: it comes out of a generator.

    An Arrow function whose argument holds nested lambdas must read such a
    column; Spark 4.1 fails to take the function out of the plan otherwise.
    """
    return rows.select("*", F.explode(F.array(value)).alias(name))
