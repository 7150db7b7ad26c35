"""Seeded subsets, prefixes, weighted batch schedules, bootstrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.functions.rng import draw, pick_int
from larkspan.operators.ranking import ranked_within
from larkspan.session import materialize


def seeded_subset(spark: SparkSession, n: int, k: int, seed: int = 42, cap: int = 100_000) -> DataFrame:
    """(index): k distinct numbers under n, drawn with replacement until there are k, ascending.

    More draws than `cap` are not made; k over n is an error.
    """
    if k > n:
        raise ValueError(f"cannot draw {k} of {n}")
    draws = spark.range(1, cap + 1).select(F.col("id").alias("k"), pick_int(draw(F.lit(seed), F.col("id")), 0, n - 1).alias("index"))
    first = draws.groupBy("index").agg(F.min("k").alias("k")).orderBy("k").limit(k)
    return first.select("index").orderBy("index")


def sample_rows(rows: DataFrame, k: int, seed: int = 42, order_col: str = "row_index") -> DataFrame:
    """k rows by their dense rank in order_col, chosen by seeded_subset."""
    ranked = ranked_within(rows, [], [order_col], "__rank")
    chosen = seeded_subset(rows.sparkSession, rows.count(), k, seed)
    return ranked.join(chosen, F.col("__rank") == F.col("index"), "left_semi").drop("__rank")


def deterministic_pick(rows: DataFrame, k: int, seed: int, key: str) -> DataFrame:
    """The first k rows in the order of a seeded hash of the key."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    return rows.withColumn("__o", order).orderBy("__o").limit(k).drop("__o")


def pick_per_class(rows: DataFrame, k: int, seed: int, key: str, *classes: str) -> DataFrame:
    """The first k rows of each class in the order of a seeded hash."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    ranked = ranked_within(rows.withColumn("__o", order), list(classes), ["__o", key], "__r")
    return ranked.where(F.col("__r") < k).drop("__r", "__o")


def checkpoint_prefix(rows: DataFrame, k: int, bucket_col: str, order_col: str) -> DataFrame:
    """The first k rows of each bucket; order_col tells a bucket's rows apart."""
    return ranked_within(rows, [bucket_col], [order_col], "__r").where(F.col("__r") < k).drop("__r")


def shard_delta(checkpoint: DataFrame, previous: DataFrame, key: str) -> DataFrame:
    """Rows of a checkpoint that the one before does not have."""
    return checkpoint.join(previous.select(key).distinct(), key, "left_anti")


def interleave(rows: DataFrame, group_col: str, order_col: str) -> DataFrame:
    """Round-robin over groups: adds round (from 1) and keeps only rounds that every group has."""
    shortest = rows.groupBy(group_col).agg(F.count("*").alias("n")).agg(F.min("n").alias("__n"))
    ranked = ranked_within(rows, [group_col], [order_col], "round").withColumn("round", F.col("round") + 1)
    # the other side is the one row of an aggregate
    return ranked.join(shortest, F.col("round") <= F.col("__n")).drop("__n")


def weighted_schedule(rows: DataFrame, targets: dict[str, float], updates: int, batch: int, seed: int, bucket_col: str = "bucket", key: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    """(step, slot, bucket, key, tokens): batches of one bucket each, drawn with replacement, that balance updates and real tokens.

    Each step takes the bucket with the least mean of update and token
    progress, the targets' order deciding ties; a batch counts the tokens of
    the rows drawn. Every bucket's batch of every step is drawn beforehand, by
    counter draws and a join on rank, so the sequence of choices needs only
    updates x buckets sums, which are parameters, on the driver.
    """
    spark = rows.sparkSession
    kept = rows.where(F.col(bucket_col).isin(*targets)).select(bucket_col, key, tokens_col)
    sizes = {r[0]: (r.n, r.mean) for r in kept.groupBy(bucket_col).agg(F.count("*").alias("n"), F.avg(tokens_col).alias("mean")).collect()}
    if missing := [b for b in targets if b not in sizes]:
        raise ValueError(f"empty buckets: {missing}")
    table = spark.createDataFrame([(b, sizes[b][0]) for b in targets], f"{bucket_col} string, __n long")
    grid = spark.range(updates * batch).select(F.floor(F.col("id") / batch).alias("step"), F.pmod("id", F.lit(batch)).alias("slot"), draw(F.lit(seed), F.col("id") + 1).alias("__x"))
    drawn = grid.join(table).select("step", "slot", bucket_col, pick_int(F.col("__x"), F.lit(0), F.col("__n") - 1).alias("__r"))
    picks = materialize(drawn.join(ranked_within(kept, [bucket_col], [key], "__r"), [bucket_col, "__r"]).select("step", "slot", bucket_col, key, tokens_col), "picks")
    sums = {(r[0], r[1]): r.t for r in picks.groupBy("step", bucket_col).agg(F.sum(tokens_col).alias("t")).collect()}
    planned = sum(sizes[b][1] * targets[b] for b in targets) * updates * batch
    done, tokens, chosen = dict.fromkeys(targets, 0), dict.fromkeys(targets, 0), []
    for step in range(updates):
        bucket = min(targets, key=lambda b: (done[b] / max(targets[b] * updates, 1.0) + tokens[b] / max(targets[b] * planned, 1.0)) / 2)
        chosen.append((step, bucket))
        done[bucket] += 1
        tokens[bucket] += sums[step, bucket]
    return picks.join(spark.createDataFrame(chosen, f"step long, {bucket_col} string"), ["step", bucket_col]).select("step", "slot", bucket_col, key, tokens_col)


def bootstrap_ci(scores: DataFrame, value_col: str, rank_col: str, rounds: int, seed: int) -> DataFrame:
    """(low, high) of the mean of a paired difference over resamples: sorted means at int(.025 n) and min(n - 1, int(.975 n)).

    scores: dense ranks from 0 with a value. Draw j of round i is counter
    draw i * size + j of the seed, so rounds are a join, not a loop.
    """
    n = scores.count()
    spark = scores.sparkSession
    draws = spark.range(0, rounds * n).select(F.floor(F.col("id") / n).alias("round"), pick_int(draw(F.lit(seed), F.col("id") + 1), 0, n - 1).alias("__r"))
    means = draws.join(scores.select(F.col(rank_col).cast("long").alias("__r"), F.col(value_col).alias("__v")), "__r").groupBy("round").agg(F.avg("__v").alias("m"))
    ordered = F.array_sort(F.collect_list("m"))
    low, high = int(0.025 * rounds), min(rounds - 1, int(0.975 * rounds))
    return means.agg(F.get(ordered, F.lit(low)).alias("low"), F.get(ordered, F.lit(high)).alias("high"))


def sampling_bucket(family: Column) -> Column:
    """The sampling bucket of a family id; an unknown prefix is an error."""
    known = F.when(F.startswith(family, F.lit("hard-")), "contextual_hard_negative").when(family.rlike("^(struct|general)"), "structural_domain_positive")
    return F.coalesce(known, F.raise_error(F.concat(F.lit("unknown family: "), family)))
