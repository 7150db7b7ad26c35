"""Token-level training examples: snapping, replay conversion, gold and prediction normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.functions.bind import bound
from larkspan.functions.text import snap_to_tokens, token_spans
from larkspan.operators.dimensions import REPLAY_LABELS, lookup

#: Share of replayed rows that may be dropped.
MOST_DROPPED = 0.10

# fixed values: words for the two actions on a span
REDACT_WORDS = ("REDACT", "MASK", "REMOVE", "SENSITIVE", "TRUE")
KEEP_WORDS = ("KEEP", "ALLOW", "SAFE", "FALSE")


def expected_action(value: Column) -> Column:
    """REDACT or KEEP; null is REDACT, any other word an error."""
    word = F.upper(F.trim(value.cast("string")))
    return F.when(value.isNull() | word.isin(*REDACT_WORDS), "REDACT").when(word.isin(*KEEP_WORDS), "KEEP").otherwise(F.raise_error(F.concat(F.lit("unsupported action: "), word)))


def ner_example(text: Column, spans: Column, ascii_only: bool = False) -> Column:
    """struct(tokens, ner, negatives, aligned): inclusive word spans of REDACT, labels of KEEP.

    aligned is false where a span's bounds are not those of tokens; such a
    span is in neither list.
    """

    def example(t: Column) -> Column:
        tokens, starts, ends = t["tokens"], t["starts"], t["ends"]
        begin = lambda s: F.array_position(starts, s["start"])
        end = lambda s: F.array_position(ends, s["end"])
        fits = lambda s: (begin(s) > 0) & (end(s) > 0)
        marked = F.filter(spans, lambda s: (s["expected"] == "REDACT") & fits(s))
        ner = F.transform(marked, lambda s: F.struct((begin(s) - 1).cast("int").alias("start"), (end(s) - 1).cast("int").alias("end"), F.lower(s["category"]).alias("label")))
        negatives = F.array_sort(F.array_distinct(F.transform(F.filter(spans, lambda s: s["expected"] == "KEEP"), lambda s: F.lower(s["category"]))))
        return F.struct(F.transform(tokens, lambda t: t["value"]).alias("tokens"), ner.alias("ner"), negatives.alias("negatives"), F.forall(spans, fits).alias("aligned"))

    # starts and ends are arrays of their own, made once: a search in them is a plain loop over integers
    parts = lambda t: F.struct(t.alias("tokens"), F.transform(t, lambda x: x["start"]).alias("starts"), F.transform(t, lambda x: x["end"]).alias("ends"))
    return bound(bound(token_spans(text, ascii_only), parts), example)


def snapped(text: Column, spans: Column, ascii_only: bool = False) -> Column:
    """Each span with snapped_start and snapped_end, its enclosing tokens' bounds; spans of no token are dropped."""

    def snap(tokens: Column) -> Column:
        both = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["category"].alias("category"), snap_to_tokens(tokens, s["start"], s["end"]).alias("b")))
        kept = F.filter(both, lambda s: s["b"].isNotNull())
        return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["category"].alias("category"), s["b"]["start"].alias("snapped_start"), s["b"]["end"].alias("snapped_end")))

    # a text without spans is never cut into tokens
    return F.when(F.size(spans) > 0, bound(token_spans(text, ascii_only), snap)).otherwise(F.array().cast("array<struct<start:int,end:int,category:string,snapped_start:int,snapped_end:int>>"))


def cross_after_snapping(spans: Column) -> Column:
    """Whether two spans that are apart overlap once snapped."""
    return F.exists(
        F.transform(spans, lambda a, i: F.exists(F.slice(spans, i + 2, F.size(spans)), lambda b: (a["snapped_start"] < b["snapped_end"]) & (b["snapped_start"] < a["snapped_end"]) & ~((a["start"] < b["end"]) & (b["start"] < a["end"])))),
        lambda x: x,
    )


def convert_replay(rows: DataFrame, languages: tuple[str, ...] = ("en", "de")) -> DataFrame:
    """(uid, text, spans, outcome) of replayed rows (uid, source_text, language, privacy_mask).

    Labels map to the few that are trained; others are context. outcome is
    kept, language, surface (a mask that does not say what its slice says) or
    crossing (snapping merges spans), and only kept rows have spans.
    """
    mapped = F.transform("privacy_mask", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), lookup(m["label"], REPLAY_LABELS).alias("category"), m["value"].alias("value")))
    wanted = F.filter(mapped, lambda m: m["category"].isNotNull())
    text = F.col("source_text")
    wrong = F.exists("w", lambda m: ~F.substring(text, m["start"] + 1, m["end"] - m["start"]).eqNullSafe(m["value"]))
    staged = rows.withColumn("w", wanted).withColumn("s", snapped(text, F.col("w")))
    outcome = F.when(~F.col("language").isin(*languages), "language").when(wrong, "surface").when(cross_after_snapping(F.col("s")), "crossing").otherwise("kept")
    final = F.transform("s", lambda s: F.struct(s["snapped_start"].alias("start"), s["snapped_end"].alias("end"), s["category"].alias("category"), F.lit("REDACT").alias("expected"), F.substring(text, s["snapped_start"] + 1, s["snapped_end"] - s["snapped_start"]).alias("surface")))
    staged = staged.withColumn("outcome", outcome)
    return staged.select("uid", text.alias("text"), F.when(F.col("outcome") == "kept", final).alias("spans"), "outcome")


def require_few_dropped(converted: DataFrame) -> DataFrame:
    """The kept rows; an error where more than MOST_DROPPED of rows in the languages are not."""
    n = converted.agg(F.count_if(F.col("outcome") != "language").alias("all"), F.count_if(F.col("outcome").isin("surface", "crossing")).alias("gone")).first()
    if n["all"] and n["gone"] / n["all"] > MOST_DROPPED:
        raise ValueError(f"{n['gone']} of {n['all']} rows dropped")
    return converted.where("outcome = 'kept'")


def normal_prediction(start: Column, end: Column, label: Column, labels: dict[str, str], length: Column) -> Column:
    """struct(start, end, category), null where label or offsets are not valid."""
    category = lookup(label, labels)
    sound = category.isNotNull() & (start >= 0) & (end > start) & (end <= length)
    return F.when(sound, F.struct(start.alias("start"), end.alias("end"), category.alias("category")))
