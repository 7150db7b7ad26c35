"""Mixing sources to target weights by Poisson replication.

A source's rate is what its target share of the mixture's bytes asks for, over
the bytes it has. Each document is repeated by a Poisson count with that mean:
the distribution function is inverted at a number hashed from seed and id, so
the count depends on nothing else. Copies are then dealt out by a hashed key,
a uniform random order over the whole mixture.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.session import materialize

#: A mean above this is split into parts, each inverted at a number of its own; their sum is Poisson again.
PART = 32.0
#: Sources up to which the table of rates is broadcast; beyond, it is joined by a shuffle.
FEW_SOURCES = 100_000


def _unit(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5."""
    hexed = F.substring(F.md5(F.concat_ws("|", *(p.cast("string") for p in parts)).cast("binary")), 1, 13)
    return F.conv(hexed, 16, 10).cast("double") / float(1 << 52)


def poisson(u: Column, mean: Column) -> Column:
    """The least k whose distribution function exceeds u, for a mean of at most PART."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 24).cast("int")
    p0 = F.exp(-mean)
    start = F.struct(p0.alias("p"), p0.alias("c"), F.lit(0).alias("k"))

    def step(a: Column, j: Column) -> Column:
        p = a["p"] * mean / j
        return F.when(a["c"] > u, a).otherwise(F.struct(p.alias("p"), (a["c"] + p).alias("c"), (a["k"] + 1).alias("k")))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda a: a["k"])


def replication_count(seed: int, key: Column, rate: Column) -> Column:
    """The Poisson count of a key at a rate, inverted part by part."""
    parts = F.greatest(F.ceil(rate / PART), F.lit(1)).cast("int")
    return F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda n, i: n + poisson(_unit(F.lit(seed), key, i), rate / parts))


def tempered_weights(docs: DataFrame, alpha: float, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(source, weight): weights that grow as the power alpha of a source's bytes."""
    size = F.sum(F.octet_length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).cast("long") + 1)
    return docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.pow(size.cast("double"), F.lit(alpha)).alias("weight"))


def mix_sources(docs: DataFrame, weights: DataFrame, epochs: float = 1.0, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", copy_col: str = "copy", key_col: str = "mix_key") -> DataFrame:
    """docs with each row repeated by its count, in a globally shuffled order; adds copy_col and key_col.

    weights: (source, weight), one row for each source; a source without a
    row, or with a null or negative weight, gets weight 0 and is left out. The
    mixture has about `epochs` times the bytes of docs. A text counts its UTF-8
    bytes plus 1; null is empty. A null source is a source. Rows with one id
    get one count; a null id is hashed as the empty string. copy runs from 1.
    Other columns stay as they are, whatever their names; only those called
    copy_col or key_col are replaced. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    size = F.sum(F.octet_length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).cast("long") + 1)
    sizes = docs.groupBy(F.col(source_col).cast("string").alias("__source")).agg(size.alias("size"))
    wanted = weights.select(F.col("source").cast("string").alias("__of"), F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("weight"))
    both = materialize(sizes.join(wanted, F.col("__source").eqNullSafe(F.col("__of")), "left").select("__source", "size", F.coalesce("weight", F.lit(0.0)).alias("weight")), "sizes")
    total = both.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight"), F.count("*").alias("n")).first()
    scale = epochs * (total["size"] or 0) / total["weight"] if total["weight"] else 0.0
    rates = both.select("__source", (F.col("weight") * scale / F.col("size")).alias("__rate"))
    rates = F.broadcast(rates) if total["n"] <= FEW_SOURCES else rates

    kept = [c for c in docs.columns if c not in (copy_col, key_col)]
    plain = docs.select(*kept).toDF(*(f"c{i}" for i in range(len(kept))))
    column = lambda name: F.col(f"c{kept.index(name)}")
    key = F.coalesce(column(id_col).cast("string"), F.lit(""))
    placed = plain.join(rates, column(source_col).cast("string").eqNullSafe(F.col("__source")))
    counted = placed.withColumn("__n", replication_count(seed, key, F.col("__rate"))).where("__n > 0")
    copies = counted.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n")))).drop("__source", "__rate", "__n")
    copies = copies.withColumn("__key", F.md5(F.concat_ws("|", F.lit("mix"), F.lit(seed).cast("string"), key, F.col("__copy").cast("string")).cast("binary")))
    # keys are uniform, so equal slices of their range are equal partitions and need no sample
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = F.floor(F.conv(F.substring("__key", 1, 8), 16, 10).cast("long") * n / (1 << 32)).cast("int")
    shuffled = copies.repartitionById(n, part).sortWithinPartitions("__key")
    return shuffled.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(kept)), F.col("__copy").alias(copy_col), F.col("__key").alias(key_col))
