"""A stand-in for the external detector: deterministic verdicts over planted entities, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.functions.rng import draw32, draw_each
from larkspan.operators.dimensions import HIPAA_TO_PLACEHOLDER, SPURIOUS_TYPES, lookup


def clamp_unit(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def pseudo_id(seed: Column) -> Column:
    """32 hex digits from four draws."""
    return F.concat(*(F.lpad(F.lower(F.hex(draw32(seed, F.lit(k)))), 8, "0") for k in range(1, 5)))


def evaluate(rows: DataFrame, miss_rate: float = 0.2, spurious: int = 2, row_col: str = "row_index", entities_col: str = "entities") -> DataFrame:
    """Adds matches, missed, extras, total_annotations, detection_rate and certificate_url to each row.

    Entity k is missed if draw k of the row's own seed is under the rate. A
    placeholder's number counts its type within the row; spurious detections
    go on counting.
    """
    seed = F.col(row_col)
    rate = clamp_unit(F.lit(float(miss_rate)))
    numbers = F.when(F.size(entities_col) > 0, F.sequence(F.lit(1), F.size(entities_col))).otherwise(F.array().cast("array<int>"))
    kind = lambda e: F.coalesce(lookup(e["category"], HIPAA_TO_PLACEHOLDER), F.lit("ID"))
    drawn = F.zip_with(entities_col, draw_each(seed, numbers), lambda e, r: F.struct(e["category"].alias("category"), e["value"].alias("value"), (r < rate).alias("miss"), kind(e).alias("type")))
    rows = rows.withColumn("__d", drawn)
    hits = F.filter("__d", lambda d: ~d["miss"])
    rows = rows.withColumn("__h", hits)
    upto = lambda i, kind: F.size(F.filter(F.slice("__h", F.lit(1), i + 1), lambda h: h["type"] == kind))
    matches = F.transform("__h", lambda h, i: F.struct(h["category"].alias("annotation_type"), h["value"].alias("annotation_value"), F.concat(F.lit("["), h["type"], F.lit("_"), upto(i, h["type"]).cast("string"), F.lit("]")).alias("redacted_as")))
    missed = F.transform(F.filter("__d", lambda d: d["miss"]), lambda d: F.struct(d["category"].alias("type"), d["value"].alias("value")))

    def extra(i: int) -> Column:
        kind = SPURIOUS_TYPES[i % len(SPURIOUS_TYPES)]
        number = F.size(F.filter("__h", lambda h: h["type"] == kind)) + i // len(SPURIOUS_TYPES) + 1
        return F.struct(F.concat(F.lit(f"[{kind}_"), number.cast("string"), F.lit("]")).alias("placeholder"), F.concat_ws("_", F.lit("spurious"), seed.cast("string"), F.lit(str(i))).alias("original"))

    nothing = F.array().cast("array<struct<placeholder:string,original:string>>")
    extras = F.array(*(extra(i) for i in range(spurious))) if spurious > 0 else nothing
    total = F.size(entities_col)
    found = F.size("__h")
    return (
        rows.withColumns({"matches": matches, "missed": missed, "extras": extras, "total_annotations": total})
        .withColumn("detection_rate", F.when(total == 0, 1.0).otherwise(found / total))
        .withColumn("certificate_url", F.concat(F.lit("/certificate/"), pseudo_id(seed)))
        .drop("__d", "__h")
    )


def backoff_ms(attempt: Column, r: Column, base: int = 500, jitter: int = 250) -> Column:
    """Milliseconds before a retry: doubling, plus a share of the jitter."""
    return F.floor(F.lit(base) * F.pow(F.lit(2.0), attempt - 1) + r * jitter)


def retry_after_ms(header: Column, now: Column) -> Column:
    """Milliseconds of a Retry-After header, seconds or an HTTP date; at least 0, null if neither."""
    seconds = F.regexp_extract(F.trim(header), r"^[+-]?\d+$", 0)
    when = F.try_to_timestamp(F.regexp_replace(F.trim(header), r"^[A-Za-z]{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    return F.when(seconds != "", F.greatest(seconds.cast("long") * 1000, F.lit(0))).when(when.isNotNull(), F.greatest(F.timestamp_diff("MILLISECOND", now, when), F.lit(0)))
