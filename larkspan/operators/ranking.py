"""Dense ranks without a window over whole groups: range partitions, their counts, and offsets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.session import materialize


def _with_offsets(placed: DataFrame, groups: list[str], part: list[str], at: str, name: str) -> DataFrame:
    """Adds a 0-based rank: the place within a part plus the sizes of the group's parts before it."""
    keys = [*groups, *part]
    parts = placed.groupBy(*keys).agg(F.min(at).alias("__first"), F.count("*").alias("__n"))
    # one row for each part of a group: as many as there are file blocks, however many rows a group has
    before = Window.partitionBy(*groups).orderBy(*part).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"))
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)))
    return placed.join(parts, same).withColumn(name, (F.col(at) + F.col("__shift")).cast("long")).drop("__shift", *(f"__k{i}" for i in range(len(keys))))


def ranked_within(rows: DataFrame, groups: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """Adds the rank (from 0) of each row in its group by `order`, which must tell a group's rows apart.

    Rows are range-partitioned by group and order and written, so a group that
    holds a third of all rows lies in many files; each file's rows are numbered
    as they lie and shifted by the counts before. Null groups are one group.
    """
    written = materialize(rows.repartitionByRange(*groups, *order).sortWithinPartitions(*groups, *order), "ranked")
    placed = written.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__at"))
    return _with_offsets(placed, groups, ["__file"], "__at", name).drop("__file", "__at")


def numbered_in_files(scan: DataFrame, name: str, by_file: bool = False) -> DataFrame:
    """Adds the ordinal (from 0) of a scan's rows in the order of files and places in them; by_file begins anew in each file.

    `scan` reads files without a filter or shuffle in between, so each block
    of a file is one stretch of one task.
    """
    placed = scan.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__at"))
    groups, part = (["__file"], ["__block"]) if by_file else ([], ["__file", "__block"])
    return _with_offsets(placed, groups, part, "__at", name).drop("__file", "__block", "__at")
