"""The model half of the URL filter: held-out urls, empty tables, rows with nulls."""

from pyspark.sql import functions as F

from larkspan.llm.url_filter import _vector, features, judge_urls, labelled_table, labelled_urls, margin, train, url_parts


def test_op9_held_out_urls(spark):
    labelled = labelled_table(spark)
    held = F.pmod(F.xxhash64("url"), F.lit(4)) == 0
    weights, bias = train(labelled.where(~held))
    right = (margin(features(*url_parts(F.col("url"))), _vector(weights), bias) > 0) == (F.col("block") == 1)
    got = labelled.where(held).agg(F.avg(right.cast("int")).alias("share"), F.count("*").alias("n")).first()
    assert got.n > 40 and got.share >= 0.85


def test_op9_the_labelled_table_knows_no_url_of_the_pages(spark, sf):
    pages = {r.url for r in spark.read.parquet(f"{sf}/pages.parquet").select("url").collect()}
    assert not pages & {u for u, _ in labelled_urls()}


def test_op9_empty_and_null_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.io/casino/bonus", 1.0), (None, None, 2.0)], "page_id long, url string, f double")
    nothing = labelled_table(spark).where("false")
    assert {r.verdict for r in judge_urls(pages, nothing).collect()} == {"allow"}
    with_nulls = labelled_table(spark).unionByName(spark.createDataFrame([(None, 1.0), ("http://x", None)], "url string, block double"))
    got = {r.page_id: r.verdict for r in judge_urls(pages, with_nulls).collect()}
    assert got[1] == "block" and len(got) == 2
    assert judge_urls(pages.where("false"), labelled_table(spark)).collect() == []
