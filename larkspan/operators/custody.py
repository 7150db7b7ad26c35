"""Custody of evaluation assets and of training records: paths that a run must not read, and epochs that a log must have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unsafe_reference(path: Column) -> Column:
    """Whether a reference is absolute, null, empty or climbs out of its root."""
    return F.coalesce((path == "") | F.startswith(path, F.lit("/")) | F.array_contains(F.split(path, "/"), ".."), F.lit(True))


def custody_failures(paths: DataFrame, manifest: DataFrame, path_col: str = "path") -> DataFrame:
    """(scope, rule, message) of declared input paths that a manifest (path_or_ref, role, ...) forbids; no asset is opened.

    A path is forbidden that is, or ends in, an eval-only entry. Every suffix
    of a path at a folder's border is looked up, so the check is an equality
    join of paths and entries, not a comparison of all pairs.
    """
    parts = F.split(path_col, "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    asked = paths.where(F.col(path_col).isNotNull()).select(F.col(path_col).alias("scope"), F.explode(F.array_distinct(F.concat(F.array(path_col), suffixes))).alias("path_or_ref"))
    forbidden = manifest.where("role = 'eval-only' and path_or_ref <> ''").select("path_or_ref").distinct()
    hits = asked.join(forbidden, "path_or_ref").select("scope", F.lit("eval_only").alias("rule"), F.col("path_or_ref").alias("message")).distinct()
    unsafe = paths.where(unsafe_reference(F.col(path_col))).select(F.coalesce(path_col, F.lit("<none>")).alias("scope"), F.lit("unsafe_reference").alias("rule"), F.lit("").alias("message")).distinct()
    return hits.unionByName(unsafe)


def epoch_failures(records: DataFrame, steps_per_epoch: int, max_steps: int) -> DataFrame:
    """(scope, rule, message) of per-epoch training records (epoch, global_step, loss): off a boundary, beyond the end, repeated, without loss, missing."""
    if steps_per_epoch < 1:
        raise ValueError("steps_per_epoch must be positive")
    epoch, step = F.col("epoch"), F.col("global_step")
    checks = [
        ("no_number", epoch.isNull() | step.isNull()),
        ("beyond_end", step > max_steps),
        ("off_boundary", (step <= 0) | (F.pmod(step, F.lit(steps_per_epoch)) != 0) | (epoch != F.floor(step / steps_per_epoch))),
        ("no_loss", F.col("loss").isNull() | F.isnan("loss")),
    ]
    found = F.array_compact(F.array(*(F.when(bad, F.lit(rule)) for rule, bad in checks)))
    name = F.coalesce(epoch.cast("string"), F.lit("<none>"))
    each = records.select(name.alias("scope"), F.explode(found).alias("rule"))
    repeated = records.where(epoch.isNotNull()).groupBy("epoch").agg(F.count("*").alias("n")).where("n > 1").select(epoch.cast("string").alias("scope"), F.lit("repeated").alias("rule"))
    wanted = records.sparkSession.range(1, max_steps // steps_per_epoch + 1).select(F.col("id").alias("epoch"))
    missing = wanted.join(records.select(epoch.cast("long").alias("epoch")).distinct(), "epoch", "left_anti").select(F.col("epoch").cast("string").alias("scope"), F.lit("missing").alias("rule"))
    return each.unionByName(repeated).unionByName(missing).withColumn("message", F.lit(""))
