"""Queries that write files into the shared folder and read them again: CSV, JSON lines, truth against texts, run logs, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.operators import metrics as X
from larkspan.operators.dimensions import GLBA, HIPAA, HIPAA_WEIGHTS, PLACEHOLDER_TO_HIPAA, dimension
from larkspan.operators.inject import bad_entities, digit_value, inject, long_enough
from larkspan.operators.mock import evaluate
from larkspan.operators.schema_check import schema_faults
from larkspan.plans import measurement, sql
from larkspan.plans.detection import table
from larkspan.session import scratch_path
from larkspan.sources import tables


def _lines(rows: DataFrame, path: str) -> str:
    rows.write.mode("overwrite").text(path)
    return path


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as CSV and read back with their order in the files: texts with quotes, commas and line ends come back whole."""
    path = scratch_path(spark, "csv")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.concat(F.coalesce("text", F.lit("")), F.lit(',"\r\n"x ')).alias("text"))
    tables.write_csv(docs, path, ["doc_id", "text", "lang", "absent"])
    back = tables.with_row_index(tables.read_csv(spark, path, ["doc_id", "text", "lang", "absent"]))
    total = back.select("row_index").distinct().count()  # every number once: as many as rows
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.md5(F.col("text").cast("binary")).alias("text_md5"), "absent", F.col("row_index").between(0, total - 1).alias("numbered"))


_FAULTY = """CASE doc_id % 6 WHEN 0 THEN '{"id":' || doc_id || ',"id":1}' WHEN 1 THEN '[1]' WHEN 2 THEN '{"id":' WHEN 3 THEN '{"id":' || doc_id || ',"s":{"a":1,"a":2}}'
WHEN 4 THEN '{"id":' || doc_id || ',"extra":1}' ELSE '{"id":' || doc_id || ',"s":{"a":' || doc_id || '}}' END"""


def jsonl_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sound and faulty JSON lines read under the policies `row` and `skip`, with and without unknown fields: rows by policy and error."""
    path = _lines(table(spark, sf_dir, "documents").select(F.expr(_FAULTY).alias("value")), scratch_path(spark, "jsonl"))
    schema = "id long, s struct<a:long>"
    row = tables.read_jsonl(spark, path, schema, policy="row", closed=True).select(F.lit("row").alias("policy"), F.coalesce("error", F.lit("")).alias("error"), "id")
    skip = tables.read_jsonl(spark, path, schema, policy="skip").select(F.lit("skip").alias("policy"), F.lit("").alias("error"), "id")
    return row.unionByName(skip).groupBy("policy", "error").agg(F.count("*").alias("n"), F.count("id").alias("ids"), F.coalesce(F.sum("id"), F.lit(0)).alias("id_sum"))


def _planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_index"), "text").where(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0)
    return inject(docs, HIPAA_WEIGHTS, make=digit_value)


_TRUTH = "row_index long, entities array<struct<category:string,value:string,start_char:int,end_char:int>>"


def truth_against_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted texts as CSV and their truth as JSON lines, two files, joined and verified: rows of each, unmatched rows, entities, and entities that do not stand where they should."""
    texts, truth = scratch_path(spark, "texts"), scratch_path(spark, "truth")
    planted = _planted(spark, sf_dir)
    tables.write_csv(planted.select(F.col("row_index").alias("original_row_index"), F.col("injected").alias("transcription")), texts, ["original_row_index", "transcription"])
    # every 50th truth is shifted by one sign, so that the check has something to find
    moved = F.transform("entities", lambda e: F.struct(e["category"].alias("category"), e["value"].alias("value"), (e["start_char"] + F.when(F.col("row_index") % 50 == 3, 1).otherwise(0)).alias("start_char"), (e["end_char"] + F.when(F.col("row_index") % 50 == 3, 1).otherwise(0)).alias("end_char")))
    tables.write_jsonl(planted.select("row_index", moved.alias("entities")), truth)
    carriers = tables.read_csv(spark, texts, ["original_row_index", "transcription"]).select(F.col("original_row_index").cast("long").alias("row_index"), F.col("transcription").alias("injected"))
    both = carriers.join(tables.read_jsonl(spark, truth, _TRUTH, require_rows=True).select("row_index", F.col("entities").alias("e")), "row_index", "full")
    checked = both.select("injected", F.coalesce("e", F.array().cast("array<struct<category:string,value:string,start_char:int,end_char:int>>")).alias("entities"), (F.col("injected").isNull() | F.col("e").isNull()).alias("alone"))
    return checked.agg(F.count("*").alias("rows"), F.count_if("alone").alias("unmatched"), F.sum(F.size(long_enough(F.col("entities")))).cast("long").alias("entities"), F.sum(F.when(F.col("alone"), 0).otherwise(bad_entities(checked))).cast("long").alias("bad"))


def evaluations_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run log of evaluations written as JSON lines, some records errors and some lines broken, read back, the last record of a row kept, flattened and counted."""
    path = scratch_path(spark, "log")
    rows = evaluate(_planted(spark, sf_dir), 0.2, 2)
    result = F.struct("row_index", "matches", "missed", "extras", "total_annotations")
    error = F.when(F.col("row_index") % 20 == 7, F.lit("timeout"))
    record = F.to_json(F.struct("row_index", F.lit(1).alias("attempt"), error.alias("error"), F.when(error.isNull(), result).alias("result")))
    stale = F.to_json(F.struct("row_index", F.lit(0).alias("attempt"), F.lit("timeout").alias("error")))
    broken = F.when(F.col("row_index") % 10 == 1, F.lit('{"row_index":'))
    _lines(rows.select(F.explode(F.array_compact(F.array(stale, record, broken))).alias("value")), path)
    evaluation = "row_index long, matches array<struct<annotation_type:string,annotation_value:string,redacted_as:string>>, missed array<struct<type:string,value:string>>, extras array<struct<placeholder:string,original:string>>"
    log = tables.read_jsonl(spark, path, f"row_index long, attempt int, error string, result struct<{evaluation.replace(' long', ':long').replace(' array', ':array')}>", policy="skip")
    last = tables.last_per_key(log, "row_index", "attempt").where("result is not null")
    facts = X.flatten_evaluations(last.select("row_index", *(F.coalesce(f"result.{c}", F.array()).alias(c) for c in ("matches", "missed", "extras"))), PLACEHOLDER_TO_HIPAA)
    return X.recall_by_category(facts, dimension(spark, HIPAA))


_EVAL = """CASE item_id % 8
WHEN 0 THEN '{"text":"alpha beta gamma","lang":"en","spans":[{"start":0,"end":5,"category":"PERSON"}]}'
WHEN 1 THEN '{"input":"alpha beta gamma","language":"de","entities":[{"offset_start":6,"offset_end":10,"label":"person","action":"keep"}]}'
WHEN 2 THEN '{"content":"alpha beta gamma","expected_spans":[{"begin":11,"stop":16,"type":"Location","redact":true}]}'
WHEN 3 THEN '{"sentence":"alpha beta gamma","spans":[{"start":0,"end":99,"category":"PERSON"}]}'
WHEN 4 THEN '{"text":"alpha beta gamma","spans":[{"start":0,"end":5,"category":"COLOUR"}]}'
WHEN 5 THEN '{"text":"alpha beta gamma","spans":[{"start":0,"end":5,"category":"PERSON","redact":false}]}'
WHEN 6 THEN '{"text":"alpha beta gamma"}' ELSE '{"text":17,"spans":[]}' END"""


def eval_rows_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation records under all accepted names, sound and faulty: their spans, or why there are none."""
    lines = table(spark, sf_dir, "benchmark").select("item_id", F.expr(_EVAL).alias("line"))
    rows = tables.eval_rows(lines, {"PERSON": "PERSON", "LOCATION": "LOCATION"})
    s = F.get("spans", F.lit(0))
    return rows.select("item_id", "lang", "error", s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end"), s["category"].alias("category"), s["expected"].alias("expected"))


_SCHEMA = {
    "type": "object",
    "required": ["name", "counts"],
    "additionalProperties": False,
    "properties": {"name": {"enum": ["a", "b"]}, "counts": {"$ref": "#/$defs/counts"}, "rates": {"type": "array", "minItems": 1, "items": {"type": "number", "maximum": 1}}},
    "$defs": {"counts": {"type": "object", "required": ["tp"], "properties": {"tp": {"type": "integer", "minimum": 0}}}},
}
_SUMMARY = """CASE item_id % 9 WHEN 0 THEN '{"name":"a","counts":{"tp":1},"rates":[0.5,1]}' WHEN 1 THEN '{"name":"c","counts":{"tp":1}}' WHEN 2 THEN '{"name":"a","counts":{"tp":-1}}'
WHEN 3 THEN '{"name":"a","counts":{"tp":1.5}}' WHEN 4 THEN '{"name":"a","counts":{}}' WHEN 5 THEN '{"name":"a","counts":[],"x":1}' WHEN 6 THEN '{"name":"b","counts":{"tp":2},"rates":[]}'
WHEN 7 THEN '{"name":"b","counts":{"tp":2},"rates":[2,"x"]}' ELSE '[' END"""
_WANTED = {0: "", 1: "$.name: not an allowed value", 2: "$.counts.tp: below 0", 3: "$.counts.tp: not an integer", 4: "$.counts: tp is missing", 5: "$: unexpected x; $.counts: not an object", 6: "$.rates: fewer than 1 items", 7: "$.rates[]: above 1; $.rates[]: not a number", 8: "$: not JSON"}


def schema_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries checked against a JSON Schema before they would be written: what is wrong with each."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(schema_faults(F.expr(_SUMMARY), _SCHEMA), "; ").alias("faults"))


def report_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The category report as a Markdown file, read back as text lines."""
    rows = measurement.finance_categories(spark, sf_dir).orderBy("ordinal").select("category", "tp", "fp", "fn")
    text = tables.markdown_table(rows)
    path = _lines(spark.createDataFrame([(text.rstrip("\n"),)], "value string"), scratch_path(spark, "report"))
    return tables.read_lines(spark, path).select("line_no", "line")


QUERIES = {f.__name__: f for f in (csv_round_trip, jsonl_policies, truth_against_texts, evaluations_log, eval_rows_normalized, schema_validation, report_table)}

_LOGGED = f"WITH {sql.mock_facts()}, logged AS (SELECT * FROM facts WHERE row_index % 20 <> 7 AND row_index IN (SELECT doc_id FROM documents WHERE trim(coalesce(text, '')) <> ''))"
ORACLES: dict[str, str] = {
    "csv_round_trip": """SELECT doc_id, lang, md5(coalesce(text, '') || ',"' || chr(13) || chr(10) || '"x ') AS text_md5, '' AS absent, true AS numbered FROM documents""",
    "jsonl_policies": """WITH k AS (SELECT doc_id, doc_id % 6 AS k FROM documents), r AS (
SELECT 'row' AS policy, CASE WHEN k IN (0, 3) THEN 'duplicate JSON key' WHEN k IN (1, 2) THEN 'invalid JSON object' WHEN k = 4 THEN 'unexpected field extra' ELSE '' END AS error, CASE WHEN k = 5 THEN doc_id END AS id FROM k
UNION ALL SELECT 'skip', '', doc_id FROM k WHERE k IN (4, 5)) SELECT policy, error, count(*) AS n, count(id) AS ids, coalesce(sum(id), 0)::BIGINT AS id_sum FROM r GROUP BY 1, 2""",
    "truth_against_texts": f"""WITH {sql.plan()}, p AS (SELECT * FROM planned JOIN documents USING (doc_id) WHERE trim(coalesce(text, '')) <> '')
SELECT (SELECT count(DISTINCT doc_id) FROM p) AS rows, 0::BIGINT AS unmatched, count(*) AS entities, count(*) FILTER (WHERE doc_id % 50 = 3) AS bad FROM p""",
    "evaluations_log": f"{_LOGGED}, c AS (SELECT category, {sql.COUNTS} FROM logged GROUP BY category), d AS (SELECT ordinal, dim.category, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM {sql.dimension(HIPAA)} LEFT JOIN c USING (category)) {sql.rated('d', 'ordinal, category,')}",
    "eval_rows_normalized": """SELECT item_id, CASE item_id % 8 WHEN 0 THEN 'en' WHEN 1 THEN 'de' ELSE 'unknown' END AS lang, CASE WHEN item_id % 8 > 2 THEN (['bad offsets', 'unknown category', 'unknown action', 'no spans', 'no text'])[item_id % 8 - 2] END AS error,
CASE item_id % 8 WHEN 0 THEN 0 WHEN 1 THEN 6 WHEN 2 THEN 11 END::BIGINT AS start, CASE item_id % 8 WHEN 0 THEN 5 WHEN 1 THEN 10 WHEN 2 THEN 16 END::BIGINT AS "end",
CASE item_id % 8 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'PERSON' WHEN 2 THEN 'LOCATION' END AS category, CASE item_id % 8 WHEN 0 THEN 'REDACT' WHEN 1 THEN 'KEEP' WHEN 2 THEN 'REDACT' END AS expected FROM benchmark""",
    "schema_validation": "SELECT item_id, CASE item_id % 9 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _WANTED.items()) + " END AS faults FROM benchmark",
    "report_table": f"""WITH {sql.mock_facts(*sql.FINANCE_FACTS)}, n AS (SELECT coalesce(category, 'UNMAPPED') AS category, {sql.COUNTS} FROM facts GROUP BY 1),
d AS (SELECT ordinal, dim.category, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM {sql.dimension([*GLBA, "UNMAPPED"])} LEFT JOIN n USING (category))
SELECT ordinal + 3 AS line_no, format('| {{}} | {{}} | {{}} | {{}} |', category, tp, fp, fn) AS line FROM d UNION ALL SELECT 1, '| category | tp | fp | fn |' UNION ALL SELECT 2, '|---|---|---|---|'""",
}
