"""Deterministic range blocks of a key: boundaries from a hash-chosen sample, looked up natively."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sampled keys for each block, and blocks at most: the driver holds about their product of keys, under a million,
#: and a task a list of boundaries. Larger tables get larger blocks, which a task sorts through spill files.
PER_BLOCK = 24
MAX_BLOCKS = 1 << 15
_BUCKETS = 1 << 30


def range_bounds(df: DataFrame, key: str | Column, blocks: int, size: str | None = None, rows: int | None = None) -> list:
    """Ascending boundaries that cut df into about equal blocks of `key`.

    The sample is every row whose key's hash falls under a rate, so it depends
    on the data alone, not on partitions. A key equal to boundary i starts
    block i + 1. Null keys belong to block 0. With `size`, blocks have about
    equal sums of that column instead of equal counts.
    """
    blocks = max(1, min(blocks, MAX_BLOCKS))
    if blocks == 1:
        return []
    rows = df.count() if rows is None else rows
    key = F.col(key) if isinstance(key, str) else key
    rate = min(1.0, PER_BLOCK * blocks / max(rows, 1))
    weight = F.col(size).cast("double") if size else F.lit(1.0)
    sample = (
        df.where(key.isNotNull())
        .where(F.pmod(F.xxhash64(key, F.lit(7)), F.lit(_BUCKETS)) < int(rate * _BUCKETS) + 1)
        .groupBy(key.alias("k"))
        .agg(F.sum(weight).alias("w"))
        .collect()
    )
    # a null in a composite key sorts first, as in Spark
    sample.sort(key=lambda r: tuple((x is not None, x) for x in r.k) if isinstance(r.k, tuple) else r.k)
    total = sum(r.w for r in sample)
    bounds, step = [], total / blocks if total else 1.0
    for row, before in zip(sample, accumulate((r.w for r in sample), initial=0.0), strict=False):
        if before >= step * (len(bounds) + 1):
            bounds.append(row.k)
    return bounds[: blocks - 1]


def block_of(key: Column, bounds: list) -> Column:
    """The block of a key: how many boundaries are at most the key, by two short scans."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))

    def literal(b) -> Column:
        # a Row is a composite key of a long and a string
        return F.struct(F.lit(b[0]).cast("long").alias("a"), F.lit(b[1]).alias("b")) if isinstance(b, tuple) else F.lit(b)

    fine = F.array(*[literal(b) for b in bounds])
    coarse = F.array(*[literal(b) for b in bounds[::step]])
    over = F.size(F.filter(coarse, lambda b: b <= key))
    inner = F.size(F.filter(F.slice(fine, F.greatest(over - 1, F.lit(0)) * step + 1, F.lit(step)), lambda b: b <= key))
    return F.when(over > 0, (over - 1) * step + inner).otherwise(F.lit(0)).cast("int")
