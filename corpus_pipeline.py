"""Corpus pipeline: quality, near-duplicates, benchmark passages, mixture, shards.

STAGES are (name, function); each function takes (spark, docs, sf_dir), works
on all rows that the stage before it kept, and returns a DataFrame that is
written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspan.llm.decontamination import drop_contaminated
from larkspan.llm.mixing import mix_sources, tempered_weights
from larkspan.llm.near_dedup import drop_near_duplicates
from larkspan.llm.quality import keep_good
from larkspan.llm.sharding import shard_documents
from larkspan.session import dealt, discard, materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps.

    Null and empty texts are judged by their shape, null sources and languages
    are sites of their own, repeated rows are judged each, an empty table stays
    empty; columns of any name stay.
    """
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component, over five-word shingles at 0.8.

    The least id of a component stays. Texts without words and rows without an
    id stay; rows equal in id and text stay together; other texts of a dropped
    id stay. An empty table stays empty; other columns are not read.
    """
    return drop_near_duplicates(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage.

    Null and empty texts hold none; repeated rows are searched each; an empty
    table or benchmark drops nothing; columns of any name stay.
    """
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to source shares that grow as the square root of a source's bytes, shuffled.

    The copies of a document are equal rows, since a stage returns the columns
    of documents. A null source is a source; a null text counts one byte; rows
    with one id are repeated equally often; an empty table stays empty.
    """
    return mix_sources(docs, tempered_weights(docs, 0.5), copy_col="__copy", key_col="__mix_key").drop("__copy", "__mix_key")


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A shard of 16 and a slot in it for every row of the mixture, copies spread over all shards.

    Each row is an atomic group, in the order of a digest, which is a random
    order like the mixture's own. doc_id leads back to the text, which equal
    copies share. Null ids and texts get places too; an empty table gives none.
    """
    return shard_documents(docs, shards=16, spread_copies=True)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: The stages have no SQL form (trained weights, sketches, alignment); they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written and read again."""
    docs = dealt(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
