"""Pattern recognisers: spans with offsets and scores, context, safelists, overlap resolution, redaction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.functions.bind import bound
from larkspan.functions.text import spans

#: A context word this near on the same line raises a score by so much, up to 1.
CONTEXT_CHARS, CONTEXT_SCORE = 50, 0.35


def detections(text: Column, patterns: list[tuple]) -> Column:
    """array<struct(category, start, end, value, score)> of one text, pattern by pattern: no rows are made or moved."""

    def scored(category: str, pattern: str, score: float, words: str | tuple[str, ...] = "") -> Column:
        words = words.split() if isinstance(words, str) else words

        def one(s: Column) -> Column:
            before = F.lower(F.element_at(F.split(F.substring(text, F.greatest(s["start"] - CONTEXT_CHARS, F.lit(0)) + 1, F.least(s["start"], F.lit(CONTEXT_CHARS))), "\n"), -1))
            near = bound(before, lambda b: reduce(lambda a, w: a | F.contains(b, F.lit(w.lower())), words, F.lit(False)))
            total = F.when(near, F.least(F.lit(score + CONTEXT_SCORE), F.lit(1.0))).otherwise(F.lit(score)) if words else F.lit(score)
            return F.struct(F.lit(category).alias("category"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), total.alias("score"))

        return F.transform(spans(text, pattern), one)

    return F.concat(*(scored(*p) for p in patterns))


def detect(docs: DataFrame, patterns: list[tuple], key: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), threshold: float = 0.0, safelist: list[str] | None = None) -> DataFrame:
    """(key, *keep, category, start, end, value, score), one row for each match of (category, pattern, score[, context words]).

    One scan whatever the number of patterns: a row's matches are one array.
    A match with a context word in the CONTEXT_CHARS before it on its line
    scores CONTEXT_SCORE more. A span that has a safelisted word is dropped,
    and so is one under the threshold.
    """
    found = detections(F.coalesce(F.col(text_col), F.lit("")), patterns)
    out = docs.select(key, *keep, F.explode(found).alias("s")).select(key, *keep, "s.*").where(F.col("score") >= threshold)
    if safelist:
        words = F.split(F.lower("value"), "[^a-z0-9]+")
        out = out.where(~F.arrays_overlap(words, F.array(*(F.lit(w.lower()) for w in safelist))))
    return out


def resolve_overlaps(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of overlapping spans the higher score stays, then the longer, then the earlier; greedy within a key."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), (F.col("start") - F.col("end")).alias("l"), "start", "end", "category", "value", "score")))
    grouped = found.groupBy(key).agg(ordered.alias("all"))
    kept = F.aggregate(
        "all",
        F.slice("all", 1, 0),
        lambda have, s: F.when(F.exists(have, lambda h: (h["start"] < s["end"]) & (s["start"] < h["end"])), have).otherwise(F.array_append(have, s)),
    )
    return grouped.select(key, F.explode(kept).alias("s")).select(key, "s.category", "s.start", "s.end", "s.value", "s.score")


def redact(docs: DataFrame, patterns: list[tuple], text_col: str = "text") -> Column:
    """The text with each match replaced by [TYPE_N], N counting a type's matches in the row; patterns in turn."""

    def marked(text: Column, category: str, pattern: str) -> Column:
        gaps = F.split(text, pattern, -1)
        return F.array_join(F.transform(gaps, lambda g, i: F.when(i == 0, g).otherwise(F.concat(F.lit(f"[{category}_"), i.cast("string"), F.lit("]"), g))), "")

    out = F.col(text_col)
    for category, pattern, *_ in patterns:
        out = marked(out, category, pattern)
    return out
