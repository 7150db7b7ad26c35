"""CSV, JSON-lines and document sources and sinks, with explicit schemas and a policy for bad lines."""

from __future__ import annotations

import json
import os
import tempfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import StringType

from larkspan.operators.ranking import numbered_in_files
from larkspan.operators.training import KEEP_WORDS, REDACT_WORDS

#: What a reader does with a line that is no JSON object: raise, drop, or keep it as a row with an error.
POLICIES = ("fail", "skip", "row")


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None, multi_line: bool = True) -> DataFrame:
    """All-string CSV with a header: quotes doubled, byte order mark stripped, short records filled with ''.

    Without `columns` the header names them. multi_line allows line ends in
    fields; without it a file is split among tasks.
    """
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").option("encoding", "UTF-8")
    if columns:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    return reader.csv(path).na.fill("")


def with_row_index(rows: DataFrame, name: str = "row_index") -> DataFrame:
    """Adds a dense ordinal from 0 in file order, from row counts of file blocks; no row passes through Python."""
    return numbered_in_files(rows, name)


def write_csv(rows: DataFrame, path: str, headers: list[str], single: bool = False) -> None:
    """Columns in the given order; a field is quoted only where it must be. A missing column is empty."""
    chosen = rows.select(*(F.coalesce(F.col(h).cast("string"), F.lit("")).alias(h) if h in rows.columns else F.lit("").alias(h) for h in headers))
    (chosen.coalesce(1) if single else chosen).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def logical_records(spark: SparkSession, path: str) -> int:
    """CSV records, line ends in quotes aside."""
    return read_csv(spark, path).count()


def physical_lines(spark: SparkSession, path: str) -> int:
    """Lines less the header; more than the records where fields hold line ends."""
    return spark.read.text(path).count() - 1


def int_prefix(text: Column) -> Column:
    """The integer that a text begins with, else null."""
    return F.nullif(F.regexp_extract(text, r"^\s*([+-]?\d+)", 1), F.lit("")).try_cast("int")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of non-blank lines; line_no is 1-based in its file.

    A file is split among tasks; line numbers come from counts of its blocks.
    """
    scan = spark.read.text(path).select("value", F.input_file_name().alias("file"))
    rows = numbered_in_files(scan, "line_no", by_file=True)
    return rows.select("file", (F.col("line_no") + 1).alias("line_no"), F.rtrim(F.regexp_replace("value", "\r$", "")).alias("line")).where("trim(line) <> ''")


@pandas_udf(StringType())
def json_fault(line: pd.Series) -> pd.Series:
    """Why a line is no sound JSON object, at any depth: not JSON, not an object, or a key named twice; null if it is sound."""

    def unique(pairs):
        if len({k for k, _ in pairs}) != len(pairs):
            raise KeyError
        return dict(pairs)

    def fault(text):
        try:
            return None if isinstance(json.loads(text, object_pairs_hook=unique), dict) else "invalid JSON object"
        except KeyError:
            return "duplicate JSON key"
        except ValueError:
            return "invalid JSON object"

    return line.map(fault)


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType, policy: str = "fail", require_rows: bool = False, closed: bool = False) -> DataFrame:
    """Objects of JSON lines with file, line_no and, by the policy `row`, error.

    A line fails if it is no object, names a key twice at any depth or, with
    `closed`, has a field that the schema does not. `fail` raises with the line
    number when the rows are read, whatever columns are; `skip` drops the line;
    `row` keeps it with its error and null fields. With require_rows an empty
    input is an error.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    lines = read_lines(spark, path)
    if require_rows and lines.isEmpty():
        raise ValueError(f"{path}: no rows")
    names = T._parse_datatype_string(schema).names if isinstance(schema, str) else schema.names
    fault = json_fault(F.col("line"))
    checked = lines.withColumn("error", fault)
    if closed:
        extra = F.array_except(F.json_object_keys("line"), F.array(*(F.lit(n) for n in names)))
        checked = checked.withColumn("error", F.coalesce("error", F.when(F.size(extra) > 0, F.concat(F.lit("unexpected field "), F.array_join(extra, ",")))))
    if policy == "fail":
        where = F.concat(F.col("file"), F.lit(":"), F.col("line_no").cast("string"), F.lit(": "), F.col("error"))
        # a filter, so that no projection of the result can leave the check out
        checked = checked.where(F.when(F.col("error").isNotNull(), F.raise_error(where).cast("boolean")).otherwise(F.lit(True)))
    elif policy == "skip":
        checked = checked.where("error is null")
    parsed = checked.select("file", "line_no", F.when(F.col("error").isNull(), F.from_json("line", schema)).alias("r"), "error")
    return parsed.select("file", "line_no", "r.*", *(["error"] if policy == "row" else []))


def bad_line_count(spark: SparkSession, path: str) -> int:
    """How many lines the policy `skip` drops."""
    return read_jsonl(spark, path, "__none string", policy="row").where("error is not null").count()


def last_per_key(rows: DataFrame, key: str, order_col: str) -> DataFrame:
    """The last record of each key."""
    whole = F.struct(*(F.col(c) for c in rows.columns))
    return rows.groupBy(key).agg(F.max_by(whole, order_col).alias("r")).select("r.*")


def first_per_key(rows: DataFrame, key: str, order_col: str) -> DataFrame:
    """The first record of each key."""
    whole = F.struct(*(F.col(c) for c in rows.columns))
    return rows.groupBy(key).agg(F.min_by(whole, order_col).alias("r")).select("r.*")


def write_jsonl(rows: DataFrame, path: str) -> None:
    """One compact object a line with sorted keys; nulls are left out."""
    rows.select(F.to_json(F.struct(*(F.col(c) for c in sorted(rows.columns)))).alias("value")).write.mode("overwrite").text(path)


def read_document(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One JSON document that spans lines."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def write_report(path: str, report: dict) -> None:
    """A small report as sorted, indented JSON, by a temporary file and a rename."""
    folder = os.path.dirname(os.path.abspath(path))
    handle, temporary = tempfile.mkstemp(dir=folder)
    with os.fdopen(handle, "w", encoding="utf-8") as out:
        json.dump(report, out, indent=2, sort_keys=True, ensure_ascii=False)
        out.write("\n")
    os.replace(temporary, path)


def append_log(rows: DataFrame, path: str) -> None:
    """Adds events to a log folder."""
    rows.write.mode("append").json(path)


def file_hashes(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, length, sha256) of files."""
    return spark.read.format("binaryFile").load(pattern).select("path", "length", F.sha2("content", 256).alias("sha256"))


def require_hash(spark: SparkSession, path: str, sha256: str) -> None:
    """An error unless the file has the digest."""
    rows = file_hashes(spark, path).collect()
    if len(rows) != 1 or rows[0].sha256 != sha256:
        raise ValueError(f"{path}: digest differs")


def require_band(n: int, low: int, high: int, what: str) -> None:
    """An error unless low <= n <= high."""
    if not low <= n <= high:
        raise ValueError(f"{what}: {n} is not in {low}..{high}")


def fenced_json(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, body) of fenced JSON blocks in Markdown."""
    found = F.regexp_extract_all("value", F.lit(r"(?is)```(?:json|jsonl)?\s*\n(.*?)```"), F.lit(1))
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(found).alias("block", "body"))


def eval_texts(spark: SparkSession, path: str) -> DataFrame:
    """(text) of an evaluation asset: text and snippet of JSON lines, else the whole file."""
    if path.endswith(".jsonl"):
        rows = read_jsonl(spark, path, "text string, snippet string")
        return rows.select(F.explode(F.array_compact(F.array("text", "snippet"))).alias("text"))
    whole = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"))
    if path.endswith(".json"):
        parses = F.coalesce(F.try_parse_json("text").isNotNull(), F.lit(False))
        whole = whole.select(F.when(parses, F.col("text")).otherwise(F.raise_error(F.lit(f"{path}: not JSON"))).alias("text"))
    return whole


def records_of_payload(payload: Column, schema: str) -> Column:
    """array<schema> of a JSON payload: a list, a list under one of five names, or one record."""
    inner = lambda k: F.from_json(F.get_json_object(payload, f"$.{k}"), f"array<struct<{schema}>>")
    is_list = F.startswith(F.ltrim(payload), F.lit("["))
    named = F.coalesce(*(inner(k) for k in ("rows", "items", "cases", "examples", "data")))
    return F.when(is_list, F.from_json(payload, f"array<struct<{schema}>>")).otherwise(F.coalesce(named, F.array(F.from_json(payload, f"struct<{schema}>"))))


def floor_table(spark: SparkSession, path: str) -> DataFrame:
    """(bucket, class, lang, min_cases, min_spans) of the first Markdown table of floors: rows up to the first line that is none; no row is an error."""
    row = r"^\|\s*([^|]+?)\s*\|\s*([^|]+?)\s*\|\s*([^|]+?)\s*\|\s*(\d+)\s*\|\s*(\d+)\s*\|\s*$"
    part = lambda i: F.regexp_extract("value", row, i)
    lines = numbered_in_files(spark.read.text(path), "n").withColumn("hit", F.col("value").rlike(row))
    first = lines.where("hit").agg(F.min("n")).first()[0]
    if first is None:
        raise ValueError(f"{path}: no floors")
    stop = lines.where(~F.col("hit") & (F.col("n") > first)).agg(F.min("n")).first()[0]
    rows = lines.where("hit") if stop is None else lines.where(F.col("hit") & (F.col("n") < stop))
    return rows.select(part(1).alias("bucket"), part(2).alias("class"), part(3).alias("lang"), part(4).cast("long").alias("min_cases"), part(5).cast("long").alias("min_spans"))


def markdown_table(rows: DataFrame, most: int = 1000) -> str:
    """A Markdown table of a small report; more than `most` rows are an error, never cut."""
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a report has at most {most} rows")
    lines += ["| " + " | ".join("n/a" if v is None else str(v) for v in r) + " |" for r in found]
    return "\n".join(lines) + "\n"


# fixed values: the names under which evaluation rows hold their text, spans, offsets, category and action
TEXT_KEYS, SPAN_KEYS = ("text", "input", "content", "sentence"), ("spans", "entities", "expected_spans")
START_KEYS, END_KEYS = ("start", "offset_start", "begin"), ("end", "offset_end", "stop")
CATEGORY_KEYS, ACTION_KEYS = ("category", "label", "type", "entity_type"), ("expected", "action")


def eval_rows(lines: DataFrame, categories: dict[str, str], line_col: str = "line") -> DataFrame:
    """(text, lang, spans, error) of evaluation records under any of their accepted names.

    categories maps labels, compared without case, to categories. The first
    name that holds a value of the right kind counts. A record without text or
    span list, and a span with bad offsets, an unknown category, an unknown
    action or an ambiguous redact=false, is a row with an error and no spans:
    nothing is guessed.
    """
    record = F.try_parse_json(line_col)
    get = lambda v, key, kind: F.try_variant_get(v, f"$.{key}", kind)
    is_text = lambda v, key: F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant")) == "STRING", get(v, key, "string"))
    text = F.coalesce(*(is_text(F.col("__r"), k) for k in TEXT_KEYS))
    listed = F.coalesce(*(get(F.col("__r"), k, "array<variant>") for k in SPAN_KEYS))
    number = lambda v, keys: F.coalesce(*(F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")) == "BIGINT", get(v, k, "int")) for k in keys))
    known = F.create_map(*(F.lit(x) for k, v in categories.items() for x in (k.lower(), v)))

    def span(v: Column) -> Column:
        label = F.lower(F.trim(F.coalesce(*(get(v, k, "string") for k in CATEGORY_KEYS))))
        redact = F.upper(F.trim(get(v, "redact", "string")))
        word = F.upper(F.trim(F.coalesce(*(get(v, k, "string") for k in ACTION_KEYS))))
        action = F.when(word.isNull() | word.isin(*REDACT_WORDS), "REDACT").when(word.isin(*KEEP_WORDS), "KEEP")
        by_redact = F.when(redact.isin("TRUE", "REDACT"), "REDACT").when(redact == "KEEP", "KEEP")
        return F.struct(number(v, START_KEYS).alias("start"), number(v, END_KEYS).alias("end"), known[label].alias("category"), F.when(redact.isNotNull(), by_redact).otherwise(action).alias("expected"))

    read = lines.select("*", record.alias("__r")).select("*", text.alias("text"), F.coalesce(get(F.col("__r"), "lang", "string"), get(F.col("__r"), "language", "string"), F.lit("unknown")).alias("lang"), F.transform(listed, span).alias("__s"))
    off = lambda s: F.coalesce((s["start"] < 0) | (s["end"] <= s["start"]) | (s["end"] > F.length("text")), F.lit(True))
    error = (
        F.when(F.col("__r").isNull(), "invalid JSON")
        .when(F.col("text").isNull(), "no text")
        .when(F.col("__s").isNull(), "no spans")
        .when(F.exists("__s", off), "bad offsets")
        .when(F.exists("__s", lambda s: s["category"].isNull()), "unknown category")
        .when(F.exists("__s", lambda s: s["expected"].isNull()), "unknown action")
    )
    read = read.withColumn("error", error)
    return read.select(*(c for c in lines.columns if c not in ("text", "lang", "spans", "error")), "text", "lang", F.when(F.col("error").isNull(), F.col("__s")).alias("spans"), "error")
