"""Winnowing fingerprints of whole texts, in Column expressions alone.

Every gram of K code points has a hash; of each W grams in a row the least is
kept, the rightmost of equals, with its place. Two texts that share K + W - 1
code points in a row share a kept gram.

A gram's 31-bit hash and its place (in bytes of UTF-32) are packed into one
integer, hash * 2 ** 32 minus place: a window's least integer is its least hash
at the rightmost place.
Window minima come from five rounds of pairwise minima over doubling distances.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.llm.grams import code_points, let
from larkspan.llm.ranges import MAX_BLOCKS, block_of, range_bounds

K, W = 16, 32
_SHIFT = 32
#: Windows of a text taken together.
STEP = 1 << 16
#: Documents to a block of neighbours.
BLOCK_ROWS = 256


def _minima(values: Column, width: int, have: int = 1) -> Column:
    """For each window of `width` values its least; one window where there are fewer values."""
    if have >= width:
        return F.slice(values, F.lit(1), F.greatest(F.size(values) - width + 1, F.lit(1)))
    step = min(have, width - have)
    wider = F.zip_with(values, F.slice(values, F.lit(1 + step), F.size(values)), lambda a, b: F.least(a, b))  # past the end: null, which least ignores
    return let(wider, lambda v: _minima(v, width, have + step))


def winnow(text: Column, offset: Column | None = None, step: int = STEP) -> Column:
    """The kept grams of a text, packed, in order of place; places count from offset.

    Windows are taken `step` at a time, and what a stretch keeps is a small
    part of its grams, so a long text's grams are never held at once.
    """

    def packed(points: Column, first: Column) -> Column:
        ends = F.sequence(F.lit(1), F.greatest(F.length(points) - (4 * K - 1), F.lit(1)), F.lit(4))  # places in bytes
        return F.transform(ends, lambda b: F.shiftleft(F.shiftrightunsigned(F.xxhash64(F.substring(points, b, F.lit(4 * K))), 33), _SHIFT) - b - first)

    # a window's minimum repeats only in the windows right after it
    changes = lambda v: F.filter(v, lambda x, i: (i == 0) | (x != F.get(v, i - 1)))

    def stretch(points: Column, first: Column, at: Column) -> Column:
        """What the windows from at, in bytes, keep."""
        own = F.substring(points, at + 1, F.lit(4 * (step + K + W - 2)))
        return let(let(let(own, lambda o: packed(o, first + at)), lambda v: _minima(v, W)), changes)

    def whole(points: Column, first: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.length(points) - 4 * (K + W - 1), F.lit(0)), F.lit(4 * step))
        kept = F.flatten(F.transform(starts, lambda at: stretch(points, first, at)))
        return F.when(F.length(points) > 0, let(kept, changes)).otherwise(F.array().cast("array<bigint>"))

    bound = F.struct(code_points(text).alias("points"), (F.lit(-1) if offset is None else offset * 4 - 1).cast("bigint").alias("first"))
    return let(bound, lambda s: let(s["points"], lambda p: let(s["first"], lambda f: whole(p, f))))


def place(kept: Column) -> Column:
    return F.shiftrightunsigned(F.pmod(-kept, F.lit(1 << _SHIFT)), 2).cast("int")


def hash_of(kept: Column) -> Column:
    return F.shiftright(kept + F.pmod(-kept, F.lit(1 << _SHIFT)), _SHIFT)


def winnow_edited(text: Column, kept: Column, size: Column, tail: Column) -> Column:
    """The kept grams of the text's first `size` code points followed by `tail`, given the text's own.

    Windows inside the first part are the text's: what they keep are the
    text's kept grams up to the place that the last such window keeps. Only
    windows that reach into the tail are computed.
    """

    def start(inner: Column) -> Column:
        last = F.array_min(F.filter(kept, lambda g: place(g).between(inner - 1, inner + (W - 2))))
        return let(place(last), lambda end: F.filter(kept, lambda g: place(g) <= end))

    def whole(s: Column) -> Column:
        inner, more = s["inner"], s["tail"]
        rest = F.concat(F.substring(text, inner + 1, F.lit(K + W - 2)), more)
        after = F.when(F.length(more) > 0, winnow(rest, inner)).otherwise(F.array().cast("array<bigint>"))
        both = F.array_distinct(F.concat(let(inner, start), after))
        return F.when(inner > 0, both).otherwise(winnow(F.concat(F.substring(text, F.lit(1), s["size"]), more)))

    # windows wholly in the first part: its length less K + W - 2
    return let(F.struct((size - (K + W - 2)).alias("inner"), size.alias("size"), tail.alias("tail")), whole)


def fingerprint(kept: Column) -> Column:
    """hash@place of each kept gram, by place, joined by commas; the empty text has the empty fingerprint."""
    return F.array_join(F.transform(kept, lambda g: F.concat(F.lower(F.hex(hash_of(g))), F.lit("@"), place(g).cast("string"))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Share of common hashes of all kept hashes of two texts; 1 for two empty texts."""
    hashes = lambda v: F.array_distinct(F.transform(v, hash_of))
    return let(
        F.struct(hashes(a).alias("a"), hashes(b).alias("b")),
        lambda s: let(F.size(F.array_intersect(s["a"], s["b"])), lambda n: F.coalesce(F.try_divide(n, F.size(s["a"]) + F.size(s["b"]) - n), F.lit(1.0))),
    )


def _with_next(docs: DataFrame) -> DataFrame:
    """docs (id, text) with the kept grams, and text and kept grams of the next row by id, after the last the first.

    Rows are dealt out in blocks of neighbouring ids; the first row of each
    block also stands at the end of the block before it.
    """
    rows = docs.count()
    docs = docs.withColumn("block", block_of(F.col("id"), range_bounds(docs, "id", min(MAX_BLOCKS, -(-rows // BLOCK_ROWS)), rows=rows)))
    heads = docs.groupBy("block").agg(F.min(F.struct(F.isnotnull("id").alias("known"), "id")).alias("head"))
    # at most MAX_BLOCKS rows: a window over all of them, and a broadcast
    order = Window.orderBy("block")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select(F.col("head.id").alias("head"), F.coalesce(F.lag("block").over(order), F.max("block").over(whole)).alias("before"))
    guests = docs.join(F.broadcast(heads), F.col("id").eqNullSafe(F.col("head"))).select("id", "text", F.col("before").alias("block"), F.lit(True).alias("guest"))
    every = docs.select("id", "text", "block", F.lit(False).alias("guest")).unionByName(guests).withColumn("kept", winnow(F.col("text")))
    by = Window.partitionBy("block").orderBy("guest", "id", "text")
    return every.withColumn("next_text", F.lead("text").over(by)).withColumn("next_kept", F.lead("kept").over(by)).where("not guest").drop("guest", "block")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row.

    The edited text is the text with its last quarter of code points, rounded
    down, replaced by as many from the start of the next row's text, by id
    (nulls first), then text; the last row's next is the first. A null text is
    empty: empty fingerprints, likeness 1 to another empty one and 0 to any
    other. Equal texts have equal fingerprints. An empty table gives an empty
    result. Other columns are not read.
    """
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    both = _with_next(source)
    n = F.length("text")
    gone = F.floor(n / 4).cast("int")
    both = both.select("id", "text", "kept", "next_kept", n.cast("long").alias("n_chars"), (n - gone).alias("size"), F.substring("next_text", F.lit(1), gone).alias("tail"))
    edited = F.concat(F.substring("text", F.lit(1), F.col("size")), F.col("tail"))
    out = both.select("id", "n_chars", F.sha2(edited, 256).alias("edited_sha256"), "kept", "next_kept", winnow_edited(F.col("text"), F.col("kept"), F.col("size"), F.col("tail")).alias("e"))
    # computed once for the row: a plain second select would repeat the winnowing in each use
    parts = let(
        F.col("e"),
        lambda e: F.struct(fingerprint(e).alias("edited_fingerprint"), likeness(F.col("kept"), e).alias("near_edited")),
    )
    out = out.select("id", "n_chars", "edited_sha256", fingerprint(F.col("kept")).alias("fingerprint"), likeness(F.col("kept"), F.col("next_kept")).alias("near_next"), F.explode(F.array(parts)).alias("p"))
    return out.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "p.edited_fingerprint", "p.near_edited", "near_next")
