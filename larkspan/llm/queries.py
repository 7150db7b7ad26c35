"""The registered queries of the operators of this subpackage: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspan.llm.chat import format_chats, read_chats
from larkspan.llm.decontamination import contaminated_regions
from larkspan.llm.mixing import mix_sources, tempered_weights
from larkspan.llm.near_dedup import near_dedup
from larkspan.llm.quality import classify_quality
from larkspan.llm.secrets import scan_secrets
from larkspan.llm.sharding import shard_documents
from larkspan.llm.url_filter import judge_urls, labelled_table
from larkspan.llm.warc import read_warc, write_warc
from larkspan.llm.winnowing import fingerprint_edits
from larkspan.session import dealt, materialize, scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return dealt(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives in the shared folder and read back."""
    uri = scratch_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), uri)
    return read_warc(spark, uri)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents repeated so that a source's share grows as the square root of its bytes."""
    docs = table(spark, sf_dir, "documents")
    mixed = mix_sources(docs, tempered_weights(docs, 0.5), epochs=1.0, seed=17)
    return mixed.select("doc_id", "source", "copy", "mix_key", "text")


def op3_classify_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality posterior; hosts are sources, paths their languages."""
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_contaminated_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where documents hold passages of the benchmark."""
    return contaminated_regions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes, equal texts together."""
    return shard_documents(table(spark, sf_dir, "documents"), shards=16)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: four-word shingles, similarity of 0.8 or more."""
    return near_dedup(table(spark, sf_dir, "documents"), k=4, percent=80)


def op7_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that says the template's own control strings, formatted and read back."""
    tricky = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return read_chats(materialize(format_chats(turns), "windows"))


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op9_judge_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for the url of every page."""
    return judge_urls(table(spark, sf_dir, "pages"), labelled_table(spark))


def op10_scan_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of documents."""
    return scan_secrets(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_warc": op1_warc,
    "op2_mix_sources": op2_mix_sources,
    "op3_classify_quality": op3_classify_quality,
    "op4_contaminated_regions": op4_contaminated_regions,
    "op5_shard_documents": op5_shard_documents,
    "op6_near_dedup": op6_near_dedup,
    "op7_chat_windows": op7_chat_windows,
    "op8_winnowing": op8_winnowing,
    "op9_judge_urls": op9_judge_urls,
    "op10_scan_secrets": op10_scan_secrets,
}

ORACLES: dict[str, str] = {
    "op1_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS lead FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id < lead THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < lead THEN lead END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)""",
    "op2_mix_sources": """
WITH s AS (SELECT source, sum(strlen(coalesce(text, '')) + 1)::DOUBLE AS size FROM documents GROUP BY source),
r AS (SELECT source, pow(size, 0.5) * (sum(size) OVER ()) / (sum(pow(size, 0.5)) OVER ()) / size AS rate FROM s),
parts AS (SELECT source, rate, greatest(ceil(rate / 32.0), 1)::INT AS parts FROM r),
cdf AS (SELECT source, parts, k, sum(exp(k * ln(rate / parts) - rate / parts - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c
        FROM parts, range(0, 400) t(k)),
u AS (SELECT doc_id, source, ('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, '') || '|' || part), 1, 13))::BIGINT / 4503599627370496.0 AS u
      FROM documents JOIN parts USING (source), range(1, 400) t(part) WHERE part <= parts),
n AS (SELECT doc_id, source, count(*) FILTER (WHERE c <= u) AS n FROM u JOIN cdf USING (source) GROUP BY ALL)
SELECT d.doc_id, d.source, copy::INT AS copy, md5('mix|17|' || d.doc_id || '|' || copy) AS mix_key, d.text
FROM documents d JOIN n USING (doc_id, source), range(1, 10000) t(copy) WHERE copy <= n""",
}
