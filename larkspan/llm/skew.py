"""Joins on keys of which one may hold a large share of all rows: such a key's rows are dealt over several parts, exactly.

A hot key is one with more than 1/PARTS of the rows, so there are fewer than
PARTS of them, which bounds what the driver fetches and how often a row is
copied. A row is told hot by its key's hash, in an expression: no join, no rows made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key's rows are dealt over as many parts as it holds shares of 1/PARTS of all rows.
PARTS = 1024


def hot_keys(counts: DataFrame, keys: list[str], total: int, many: str = "many") -> DataFrame:
    """(__key of keys, __parts) for the hot keys of counts, one row a key; fewer than PARTS rows."""
    share = F.col(many) * PARTS / max(total, 1)
    return counts.where(share > 1).select(*(F.col(k).alias(f"__{k}") for k in keys), F.ceil(share).cast("int").alias("__parts"))


def _held(hot: DataFrame) -> dict[int, list[int]]:
    """Hashes of the hot keys by their number of parts, fetched once for each hot table."""
    if not hasattr(hot, "_larkspan_held"):
        keys = [c for c in hot.columns if c != "__parts"]
        hot._larkspan_held = {}
        for key, parts in hot.select(F.xxhash64(*keys), "__parts").collect():
            hot._larkspan_held.setdefault(parts, []).append(key)
    return hot._larkspan_held


def _parts(held: dict[int, list[int]], keys: list[str]) -> Column:
    """A row's number of parts, by the hash of its key; a key that shares a hot one's hash is dealt like it, on both sides."""
    if not held:
        return F.lit(1)
    listed = {n: ", ".join(f"{h}L" if h > -(1 << 63) else f"({h + 1}L - 1L)" for h in hashes) for n, hashes in held.items()}
    key = "xxhash64(" + ", ".join(f"`{k}`" for k in keys) + ")"
    levels = " ".join(f"WHEN {key} IN ({some}) THEN {n}" for n, some in listed.items())
    return F.expr(f"CASE WHEN {key} IN ({', '.join(listed.values())}) THEN CASE {levels} END ELSE 1 END")


def dealt_join(rows: DataFrame, others: DataFrame, hot: DataFrame, keys: list[str], by: str, how: str = "inner") -> DataFrame:
    """rows joined with others on keys: a hot key's rows are dealt by the column `by`, and each part meets all the key's others.

    Inner and left joins; rows with null keys match nothing. The keys have the
    same types on both sides and in hot. The plan is one whether or not there
    are hot keys.
    """
    parts = _parts(_held(hot), keys)
    left = rows.withColumn("__part", F.pmod(F.xxhash64(by), parts.cast("long")).cast("int"))
    right = others.withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return left.join(right, [*keys, "__part"], how).drop("__part")
