"""Sources that must fail closed, and sinks that must not change what they hold."""

import json
import random

import pytest
from pyspark.sql import functions as F

from larkspan.operators.ranking import ranked_within
from larkspan.operators.schema_check import schema_faults
from larkspan.operators.training import convert_replay, expected_action, require_few_dropped
from larkspan.sources import tables
from larkspan.sources.detector import Retry, call_detector


@pytest.fixture
def written(tmp_path):
    def of(name, text):
        (tmp_path / name).write_text(text, encoding="utf-8")
        return str(tmp_path / name)

    return of


@pytest.mark.parametrize("bad", ['{"id":3,"id":4}', "[1]", '{"id":', '{"id":1,"s":{"a":1,"a":1}}', "17"])
def test_the_policy_fail_raises_whatever_is_read(spark, written, bad):
    path = written("rows.jsonl", '{"id":1}\n\n' + bad + "\n")
    rows = tables.read_jsonl(spark, path, "id long")
    for read in (rows.collect, rows.select("line_no").collect, rows.count, lambda: rows.where("id is null").collect()):
        with pytest.raises(Exception, match="rows.jsonl:3: "):
            read()
    kept = tables.read_jsonl(spark, path, "id long", policy="row").orderBy("line_no").collect()
    assert [(r.line_no, r.id, r.error is None) for r in kept] == [(1, 1, True), (3, None, False)]
    assert [r.id for r in tables.read_jsonl(spark, path, "id long", policy="skip").collect()] == [1] and tables.bad_line_count(spark, path) == 1


def test_closed_rows_and_empty_inputs(spark, written):
    path = written("a.jsonl", '{"id":1,"more":2}\n')
    with pytest.raises(Exception, match="unexpected field more"):
        tables.read_jsonl(spark, path, "id long", closed=True).collect()
    with pytest.raises(ValueError, match="no rows"):
        tables.read_jsonl(spark, written("b.jsonl", "\n \n"), "id long", require_rows=True)
    with pytest.raises(ValueError):
        tables.read_jsonl(spark, path, "id long", policy="guess")


def test_line_numbers_of_split_files(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.txt").write_text("".join(f"{name}{i} " + "x" * 200 + "\n" for i in range(1, 2001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = tables.read_lines(spark, f"{tmp_path}/*.txt").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 4000 and all(r.line.split()[0][1:] == str(r.line_no) for r in rows)


def test_floor_table_stops_at_the_first_other_line(spark, written):
    row = "| a | b | en | {} | 2 |\n"
    got = tables.floor_table(spark, written("f.md", "# x\n| bucket | class | lang | cases | spans |\n|---|---|---|---|---|\n" + row.format(1) + row.format(2) + "\ntext\n" + row.format(3))).collect()
    assert [r.min_cases for r in got] == [1, 2]
    with pytest.raises(ValueError):
        tables.floor_table(spark, written("g.md", "nothing\n"))


def test_reports_are_not_cut(spark):
    with pytest.raises(ValueError):
        tables.markdown_table(spark.range(5), most=4)
    assert tables.markdown_table(spark.range(2), most=2) == "| id |\n|---|\n| 0 |\n| 1 |\n"


def test_ranks_against_sorting(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["a"] * 8 + ["b", None]), i * 7 % 1009) for i in range(1000)]
    got = ranked_within(spark.createDataFrame(rows, "g string, k int").repartition(7), ["g"], ["k"]).collect()
    for group in ("a", "b", None):
        assert [r["rank"] for r in sorted((r for r in got if r.g == group), key=lambda r: r.k)] == list(range(sum(r[0] == group for r in rows)))
    assert ranked_within(spark.createDataFrame([], "g string, k int"), ["g"], ["k"]).count() == 0


def test_schema_references_must_resolve():
    with pytest.raises(ValueError, match="unresolved"):
        schema_faults(F.lit("{}"), {"$ref": "#/$defs/none"})


def test_replayed_rows(spark):
    mask = lambda text, *words: [(w[1], text.index(w[0]), text.index(w[0]) + len(w[0]), w[0]) for w in words]
    text = "Anna Berg lives in Xanten"
    rows = [
        (1, text, "en", mask(text, ("Anna", "GIVENNAME"), ("Xan", "CITY"))),
        (2, text, "fr", mask(text, ("Anna", "GIVENNAME"))),
        (3, text, "de", [("CITY", 0, 4, "Xant")]),
        (4, text, "de", mask(text, ("Xan", "CITY"), ("ten", "STREET"))),
        (5, text, "en", mask(text, ("lives", "VERB"))),
    ]
    out = convert_replay(spark.createDataFrame(rows, "uid long, source_text string, language string, privacy_mask array<struct<label:string,start:int,end:int,value:string>>"))
    got = {r.uid: r for r in out.collect()}
    assert [got[i].outcome for i in range(1, 6)] == ["kept", "language", "surface", "crossing", "kept"]
    assert [(s.start, s.end, s.surface, s.category) for s in got[1].spans] == [(0, 4, "Anna", "PERSON"), (19, 25, "Xanten", "LOCATION")] and got[5].spans == [] and got[4].spans is None
    with pytest.raises(ValueError, match="2 of 4"):
        require_few_dropped(out)
    assert require_few_dropped(out.where("uid in (1, 2, 5)")).count() == 2


def test_actions(spark):
    of = lambda *v: [r.a for r in spark.createDataFrame([(x,) for x in v], "v string").select(expected_action(F.col("v")).alias("a")).collect()]
    assert of(None, "mask", " Keep ", "FALSE") == ["REDACT", "REDACT", "KEEP", "KEEP"]
    with pytest.raises(Exception, match="unsupported action"):
        of("perhaps")


def test_failures_of_a_detector_are_rows(spark):
    def call(index, text):
        if index == 1:
            raise Retry("busy", after=0.0)
        if index == 2:
            raise RuntimeError("broken")
        return json.dumps({"n": len(text)})

    rows = spark.createDataFrame([(0, "abc"), (1, "x"), (2, None)], "row_index long, text string")
    got = {r.row_index: (r.response, r.attempts, r.error) for r in call_detector(rows, call, retries=2, sleep=lambda s: None).collect()}
    assert got == {0: ('{"n": 3}', 1, None), 1: (None, 3, "busy"), 2: (None, 1, "broken")}
