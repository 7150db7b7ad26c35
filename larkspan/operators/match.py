"""Span matching: three rules, greedy one to one within a record, and exact sets.

Spans are arrays of struct(start, end, ...) in one row for each record, so no
rule needs a join: candidates are pairs within the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ORDER = "array<struct<frac:double,start:int,length:int,t:int,p:int>>"


def _greedy(candidates: Column) -> Column:
    """array<struct(t, p)> of the pairs taken, best first, each side once."""
    start = F.array().cast("array<struct<t:int,p:int>>")

    def step(have: Column, c: Column) -> Column:
        taken = F.exists(have, lambda h: (h["t"] == c["t"]) | (h["p"] == c["p"]))
        return F.when(taken, have).otherwise(F.array_append(have, F.struct(c["t"].alias("t"), c["p"].alias("p"))))

    return F.aggregate(F.array_sort(candidates), start, step)


def _pairs(truth: Column, preds: Column, make) -> Column:
    """Every pair that `make(t, p)` gives a rank, as ordered structs."""

    def one(t: Column, ti: Column) -> Column:
        def two(p: Column, pi: Column) -> Column:
            frac = make(t, p)
            return F.when(frac.isNotNull(), F.struct((-frac).alias("frac"), p["start"].alias("start"), (p["end"] - p["start"]).alias("length"), ti.alias("t"), pi.alias("p")))

        return F.filter(F.transform(preds, two), lambda c: c.isNotNull())

    return F.flatten(F.transform(truth, one)).cast(_ORDER)


def match_threshold(truth: Column, preds: Column, least: float = 0.5) -> Column:
    """Pairs whose overlap is at least `least` of the truth's length; greater shares first, then by prediction.

    Categories are ignored; a truth of no length matches nothing.
    """

    def share(t: Column, p: Column) -> Column:
        over = F.least(t["end"], p["end"]) - F.greatest(t["start"], p["start"])
        length = t["end"] - t["start"]
        frac = over.cast("double") / length
        return F.when((length > 0) & (over > 0), F.when(frac >= least, frac))

    return _greedy(_pairs(truth, preds, share))


def _sound(s: Column) -> Column:
    return s["end"] > s["start"]


def match_overlap(gold: Column, preds: Column, exact: bool = False) -> Column:
    """Pairs that overlap at all (or have equal bounds), larger overlaps first; malformed spans on either side match nothing."""

    def rank(g: Column, p: Column) -> Column:
        over = F.least(g["end"], p["end"]) - F.greatest(g["start"], p["start"])
        fits = (g["start"] == p["start"]) & (g["end"] == p["end"]) if exact else over > 0
        return F.when(_sound(g) & _sound(p) & fits, over.cast("double"))

    return _greedy(_pairs(gold, preds, rank))


def verdicts(records: DataFrame, truth: str, preds: str, pairs: Column, keep: tuple[str, ...], truth_category: str = "category", pred_category: str = "category") -> DataFrame:
    """(keep..., category, verdict): tp and fn by the truth's category, fp by the prediction's."""
    with_pairs = records.withColumn("__m", pairs)
    hit = lambda side, i: F.exists(F.col("__m"), lambda m: m[side] == i)
    of_truth = F.transform(truth, lambda t, i: F.struct(t[truth_category].alias("category"), F.when(hit("t", i), "tp").otherwise("fn").alias("verdict")))
    of_preds = F.transform(F.filter(F.transform(preds, lambda p, i: F.struct(p.alias("p"), i.alias("i"))), lambda x: ~hit("p", x["i"])), lambda x: F.struct(x["p"][pred_category].alias("category"), F.lit("fp").alias("verdict")))
    return with_pairs.select(*keep, F.explode(F.concat(of_truth, of_preds)).alias("v")).select(*keep, "v.category", "v.verdict")


def set_scores(gold: Column, preds: Column, has_expected: bool = True) -> Column:
    """struct(tp, fp, fn) over distinct (start, end, category).

    Gold whose `expected` is not REDACT does not count, so a prediction of it
    is a false positive; without that field (has_expected false) all counts.
    """
    keys = lambda a: F.array_distinct(F.transform(a, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["category"].alias("category"))))
    wanted = F.filter(gold, lambda s: s["expected"].eqNullSafe(F.lit("REDACT"))) if has_expected else gold
    g, p = keys(wanted), keys(preds)
    both = F.size(F.array_intersect(g, p))
    return F.struct(both.alias("tp"), (F.size(p) - both).alias("fp"), (F.size(g) - both).alias("fn"))


def boundary_misses(gold: Column, preds: Column) -> Column:
    """Gold spans that no prediction equals but one of the same category overlaps: how many."""
    equal = lambda g: F.exists(preds, lambda p: (p["start"] == g["start"]) & (p["end"] == g["end"]) & (p["category"] == g["category"]))
    near = lambda g: F.exists(preds, lambda p: (p["start"] < g["end"]) & (g["start"] < p["end"]) & (p["category"] == g["category"]))
    return F.size(F.filter(gold, lambda g: ~equal(g) & near(g)))


def locate(text: Column, needles: Column) -> Column:
    """array<struct(start, end, value)>: for each needle its next occurrence that no earlier found one overlaps; null where none is left."""
    start = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def step(have: Column, needle: Column) -> Column:
        gaps = F.split(text, F.concat(F.lit("\\Q"), needle, F.lit("\\E")), -1)
        size = F.length(needle)
        starts = F.aggregate(
            F.slice(gaps, F.lit(1), F.size(gaps) - 1),
            F.array().cast("array<int>"),
            lambda out, g: F.array_append(out, F.coalesce(F.element_at(out, F.when(F.size(out) > 0, -1)) + size, F.lit(0)) + F.length(g)),
        )
        free = F.filter(starts, lambda i: ~F.exists(have, lambda h: (h["start"] < i + size) & (i < h["end"])))
        first = F.when(size > 0, F.get(free, F.lit(0)))
        return F.array_append(have, F.struct(first.alias("start"), (first + size).alias("end"), needle.alias("value")))

    return F.aggregate(needles, start, step)
