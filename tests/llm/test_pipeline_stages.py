"""Every stage of the pipeline on awkward rows, on its own input, and the last one after the mixture."""

import zlib

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "The harbour office counts the ledgers of the week, and the clerks compare every entry with the notes of the day before. "


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None, "en", "a", 0), (2, "", None, None, 0), (None, PROSE, "en", "a", 9), (3, PROSE + "x", "en", "a", 9), (3, PROSE + "x", "en", "a", 9), (4, PROSE * 400, "de", "b", 9), (5, "\U0001f600 é ß", "fr", "b", 5)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_awkward_rows_and_empty_tables(spark, sf, odd, name):
    stage = dict(pipeline.STAGES)[name]
    out = stage(spark, odd, sf)
    rows = out.collect()
    if name != "sharding":
        assert out.columns == odd.columns
    if name in ("near_duplicates", "decontamination"):  # nothing of this is a duplicate of another id, or of the benchmark
        assert sorted(map(repr, rows)) == sorted(map(repr, odd.collect()))
    if name == "sharding":
        assert len(rows) == 7 and sorted((r.shard, r.slot) for r in rows) == sorted({(r.shard, r.slot) for r in rows})
    assert {r.doc_id for r in rows} <= {None, 1, 2, 3, 4, 5}
    assert stage(spark, odd.where("false"), sf).collect() == []


def test_last_stage_after_the_mixture(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    mixed = pipeline.mixing(spark, docs, sf)
    assert mixed.columns == docs.columns
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    copies = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    rows = pipeline.sharding(spark, mixed, sf).collect()
    assert len(rows) == sum(copies.values())
    assert all(r["size"] == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in rows)
    load = {}
    for r in rows:
        load.setdefault(r.shard, []).append(r["size"])
    assert len(load) == 16 and max(map(sum, load.values())) <= sum(map(sum, load.values())) / 16 + max(map(max, load.values()))
    several = [d for d, n in copies.items() if n >= 3]
    assert sum(len({r.shard for r in rows if r.doc_id == d}) > 1 for d in several) > len(several) / 2


def test_run_is_the_stages_in_turn(spark, sf):
    rows = pipeline.run(spark, sf)
    assert {"doc_id", "shard", "slot"} <= set(rows.columns) and rows.count() > 0
