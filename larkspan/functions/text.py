"""Text functions: canonical form, tokens with offsets, n-grams, masking, placeholders. Offsets are code points."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import StringType

from larkspan.functions.bind import bound, running_sums

WORD, WORD_ASCII = r"(?U)\w+|[^\w\s]", r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]"
# fixed value: ticket numbers that change from row to row
VOLATILE = r"(?i)\b(?:syn|demo|lab|qa)-\d{5}-[a-z0-9]+\b"


@pandas_udf(StringType())
def canonical_unicode(text: pd.Series) -> pd.Series:
    """NFKC, case-folded, white space collapsed and stripped. Spark has no NFKC, so Arrow batches."""
    return text.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()))


def canonical(text: Column) -> Column:
    """The native form for texts that are NFKC already: lower case, white space collapsed and stripped."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def strip_space(text: Column) -> Column:
    """Strips Unicode white space and the byte order mark at both ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+$", "")


def spans(text: Column, pattern: str) -> Column:
    """Every match of a pattern as struct(start, end, value), half-open, in order; it must not match the empty string.

    The stretches between matches come from split, so running sums of their
    lengths and the matches' give the ends. A text without a match is searched
    once and costs nothing more.
    """

    def placed(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        ends = running_sums(F.zip_with(gaps, found, lambda g, m: F.length(g) + F.length(m)))
        return F.zip_with(ends, found, lambda e, m: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("value")))

    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(empty))


def token_spans(text: Column, ascii_only: bool = False) -> Column:
    """Words and single signs with their offsets."""
    return spans(text, WORD_ASCII if ascii_only else WORD)


def token_count(text: Column) -> Column:
    """Runs of non-space, at least 1."""
    return F.greatest(F.lit(1), F.size(F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0))))


def word_ngrams(canonical_text: Column, n: int = 8) -> Column:
    """Distinct n-grams of space-separated words; fewer words are one gram; no words, none."""

    def grams(words: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
        one = F.when(F.size(words) > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>"))
        return F.when(F.size(words) >= n, F.array_distinct(many)).otherwise(one)

    return bound(F.filter(F.split(canonical_text, " "), lambda w: w != ""), grams)


def char_ngrams(text: Column, n: int = 5) -> Column:
    """Distinct n-character shingles; a shorter text is its own; the empty text has none.

    Shingles are put together from an array of the characters: a substring
    would walk the text from its begin for each one.
    """
    join = lambda c, i: F.concat(*(F.get(c, i + j) for j in range(n)))
    many = bound(F.split(text, ""), lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - n), lambda i: join(c, i)))
    one = F.when(F.length(text) > 0, F.array(text)).otherwise(F.array().cast("array<string>"))
    return F.when(F.length(text) >= n, F.array_distinct(many)).otherwise(one)


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets: 1 if both are empty, 0 if one is."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both, F.size(a) + F.size(b) - both), F.lit(1.0))


def mask_spans(text: Column, found: Column, mask: str = "<SPAN>") -> Column:
    """The text with each span replaced by the mask, right to left."""
    ordered = F.sort_array(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))), asc=False)
    return F.aggregate(ordered, text, lambda t, s: F.concat(F.substring(t, F.lit(1), s["start"]), F.lit(mask), F.substring(t, s["end"] + 1, F.length(t))))


def masked_text(text: Column, found: Column) -> Column:
    """Spans and volatile ticket numbers masked."""
    return F.regexp_replace(mask_spans(text, found), VOLATILE, "<VOLATILE>")


def placeholder_type(placeholder: Column) -> Column:
    """TYPE of `[TYPE_N]`; null for anything else."""
    return F.nullif(F.regexp_extract(placeholder, r"(?s)^\[(.+)_([0-9]+)\]$", 1), F.lit(""))


def pad_left(value: Column, width: int) -> Column:
    """Zeros on the left up to the width; never cuts."""
    text = value.cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0"))


def escape_xml(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def identifier_forms(phrase: Column) -> Column:
    """struct(snake, camel, dotted) of a phrase, umlauts transliterated."""
    plain = F.lower(phrase)
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        plain = F.replace(plain, F.lit(a), F.lit(b))
    words = F.regexp_extract_all(plain, F.lit("[a-z]+"), F.lit(0))
    camel = F.concat(F.coalesce(F.get(words, F.lit(0)), F.lit("")), F.array_join(F.transform(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), F.initcap), ""))
    return F.struct(F.array_join(words, "_").alias("snake"), camel.alias("camel"), F.array_join(words, ".").alias("dotted"))


def snap_to_tokens(tokens: Column, start: Column, end: Column) -> Column:
    """struct(start, end) of the tokens that a span touches; null where it touches none."""
    hit = F.filter(tokens, lambda t: (t["start"] < end) & (t["end"] > start))
    both = lambda h: F.when(F.size(h) > 0, F.struct(F.get(h, F.lit(0))["start"].alias("start"), F.element_at(h, -1)["end"].alias("end")))
    return bound(hit, both)
