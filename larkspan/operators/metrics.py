"""From verdict facts (category, verdict, ...) to recall by category, row, language and tier, and run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.functions.rates import f1_of_percents, percent, percent_or_null, percentile_floor, ratio_or_zero, recall_precision_f1
from larkspan.functions.text import placeholder_type
from larkspan.operators.dimensions import TIERS, lookup


def count_of(verdict: str) -> Column:
    return F.count_if(F.col("verdict") == verdict).alias(verdict)


def verdict_counts() -> list[Column]:
    return [count_of(v) for v in ("tp", "fp", "fn")]


def rated(counts: DataFrame, ratio=ratio_or_zero) -> DataFrame:
    """Adds recall, precision and f1 to tp, fp, fn."""
    return counts.withColumns(recall_precision_f1(F.col("tp"), F.col("fp"), F.col("fn"), ratio))


def recall_overall(facts: DataFrame) -> DataFrame:
    """One row; facts of an unknown or no category count too."""
    return rated(facts.agg(*verdict_counts()))


def recall_by_category(facts: DataFrame, categories: DataFrame) -> DataFrame:
    """One row for each category of the dimension (category, ordinal), also for those without a fact."""
    counts = facts.groupBy("category").agg(*verdict_counts())
    zeroed = [F.coalesce(F.col(v), F.lit(0)).alias(v) for v in ("tp", "fp", "fn")]
    return rated(categories.join(counts, "category", "left").select("ordinal", "category", *zeroed))


def recall_by(facts: DataFrame, *keys: str) -> DataFrame:
    return rated(facts.groupBy(*keys).agg(*verdict_counts()))


def recall_by_tier(facts: DataFrame, tier_col: str = "tier") -> DataFrame:
    """Always the three tiers; a fact of another tier is in none of them."""
    tiers = facts.sparkSession.sql("SELECT * FROM VALUES " + ", ".join(f"('{t}', {i})" for i, t in enumerate(TIERS)) + " AS t(tier, ordinal)")
    counts = facts.groupBy(F.col(tier_col).alias("tier")).agg(*verdict_counts())
    return rated(tiers.join(counts, "tier", "left").select("ordinal", "tier", *(F.coalesce(F.col(v), F.lit(0)).alias(v) for v in ("tp", "fp", "fn"))))


def recall_rollup(facts: DataFrame, row_col: str = "row_index") -> DataFrame:
    """(dimension, key, tp, fp, fn): by category, by row and overall in one pass over the facts."""
    sets = facts.groupingSets([["category"], [row_col], []], "category", row_col).agg(F.grouping_id().alias("g"), *verdict_counts())
    named = F.when(F.col("g") == 1, "category").when(F.col("g") == 2, "row").otherwise("overall")
    key = F.when(F.col("g") == 1, F.col("category")).when(F.col("g") == 2, F.col(row_col).cast("string")).otherwise("")
    return sets.select(named.alias("dimension"), key.alias("key"), "tp", "fp", "fn")


def flatten_evaluations(evaluations: DataFrame, mapping: dict[str, str], row_col: str = "row_index") -> DataFrame:
    """(row_index, category, verdict, value, placeholder): matches as tp, missed as fn, extras as fp.

    evaluations has arrays matches (annotation_type, annotation_value,
    redacted_as), missed (type, value) and extras (placeholder, original). An
    extra's category is its placeholder's, null where that is unmapped.
    """

    def fact(category, verdict: str, value, placeholder) -> Column:
        return F.struct(category.alias("category"), F.lit(verdict).alias("verdict"), value.alias("value"), placeholder.cast("string").alias("placeholder"))

    tp = F.transform("matches", lambda m: fact(m["annotation_type"], "tp", m["annotation_value"], m["redacted_as"]))
    fn = F.transform("missed", lambda m: fact(m["type"], "fn", m["value"], F.lit(None)))
    fp = F.transform("extras", lambda m: fact(lookup(placeholder_type(m["placeholder"]), mapping), "fp", m["original"], m["placeholder"]))
    return evaluations.select(row_col, F.explode(F.concat(tp, fn, fp)).alias("f")).select(row_col, "f.*")


def unmapped_types(facts: DataFrame, row_col: str = "row_index") -> DataFrame:
    """(type, first_row, n): placeholder types without a category, in order of their first row."""
    extra = facts.where("verdict = 'fp' and category is null").withColumn("type", placeholder_type(F.col("placeholder")))
    return extra.where("type is not null").groupBy("type").agg(F.min(row_col).alias("first_row"), F.count("*").alias("n"))


def finance_categories(facts: DataFrame, categories: DataFrame) -> DataFrame:
    """Percents by category, null where a denominator is 0; facts of no category are UNMAPPED."""
    named = facts.withColumn("category", F.coalesce("category", F.lit("UNMAPPED")))
    counts = named.groupBy("category").agg(*verdict_counts())
    every = categories.select("category", "ordinal").unionByName(facts.sparkSession.sql("SELECT 'UNMAPPED' AS category, 1000 AS ordinal"))
    zeroed = [F.coalesce(F.col(v), F.lit(0)).alias(v) for v in ("tp", "fp", "fn")]
    out = every.join(counts, "category", "left").select("ordinal", "category", *zeroed)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.withColumns({"recall_pct": percent_or_null(tp, tp + fn), "precision_pct": percent_or_null(tp, tp + fp)})


def finance_totals(facts: DataFrame) -> DataFrame:
    """One row: totals, attributed and unmapped fp, percents with 0 on empty, and f1 of the rounded percents."""
    unmapped = F.count_if((F.col("verdict") == "fp") & F.col("category").isNull()).alias("fp_unmapped")
    one = facts.agg(*verdict_counts(), unmapped).withColumn("fp_attributed", F.col("fp") - F.col("fp_unmapped"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    one = one.withColumns({"recall_pct": percent(tp, tp + fn), "precision_pct": percent(tp, tp + fp)})
    return one.withColumn("f1", f1_of_percents(F.col("recall_pct"), F.col("precision_pct")))


def top_extras(facts: DataFrame, n: int = 20, row_col: str = "row_index") -> DataFrame:
    """The n commonest fp values; ties by the first row, then the value; the placeholder is the first seen."""
    extra = facts.where("verdict = 'fp'")
    grouped = extra.groupBy("value").agg(F.count("*").alias("n"), F.min(row_col).alias("first_row"), F.min_by("placeholder", F.struct(row_col, "placeholder")).alias("placeholder"))
    return grouped.orderBy(F.desc("n"), "first_row", "value").limit(n)


def latency_summary(runs: DataFrame, value_col: str, *keys: str) -> DataFrame:
    """n, mean, p50, p95 and max by key; percentiles are the sorted value at floor((n - 1) p).

    The ranks come from counts of distinct values, so no group is collected.
    """
    counts = runs.where(F.col(value_col).isNotNull()).groupBy(*keys, F.col(value_col).alias("v")).agg(F.count("*").alias("c"))
    by = Window.partitionBy(*keys)
    ranked = counts.withColumns({"upto": F.sum("c").over(by.orderBy("v")), "n": F.sum("c").over(by)})
    at = lambda p: F.min(F.when(F.col("upto") > F.floor((F.col("n") - 1) * F.lit(p)), F.col("v")))
    return ranked.groupBy(*keys).agg(F.max("n").alias("n"), (F.sum(F.col("v") * F.col("c")) / F.max("n")).alias("mean"), at(0.5).alias("p50"), at(0.95).alias("p95"), F.max("v").alias("max"))


def array_latency(values: Column) -> Column:
    """p50 of a short array of latencies, by the same rule."""
    return percentile_floor(values, 0.5)


def wall_clock(runs: DataFrame, time_col: str, order_col: str, *keys: str) -> DataFrame:
    """Between the first and the last record in file order, each in whole milliseconds."""
    first, last = (F.unix_millis(f(time_col, order_col).cast("timestamp")) for f in (F.min_by, F.max_by))
    return runs.groupBy(*keys).agg((last - first).alias("wall_ms"), F.count("*").alias("n"))


def certificate_verdict(rows: DataFrame) -> Column:
    """error, n/a, verified, miss or partial, from error, total_annotations and detection_rate."""
    rate = F.col("detection_rate")
    return (
        F.when(F.col("error").isNotNull(), "error")
        .when(F.col("total_annotations").isNull() | (F.col("total_annotations") == 0), "n/a")
        .when(rate >= 1, "verified")
        .when(rate <= 0, "miss")
        .otherwise("partial")
    )


def certificate_id(url: Column) -> Column:
    """The last path segment, trailing slashes aside."""
    return F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1)


def summary_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Category percents of two runs side by side; UNMAPPED and null recalls are left out."""
    side = lambda df, tag: df.where("category <> 'UNMAPPED' and recall_pct is not null").select("category", *(F.col(c).alias(f"{c}_{tag}") for c in ("recall_pct", "precision_pct", "fp")))
    both = side(before, "before").join(side(after, "after"), "category")
    return both.withColumns({"recall_delta": F.col("recall_pct_after") - F.col("recall_pct_before"), "fp_delta": F.col("fp_after") - F.col("fp_before")})


def extras_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(value, n_before, n_after, delta) of every fp value of either run."""
    a, b = before.select("value", F.col("n").alias("n_before")), after.select("value", F.col("n").alias("n_after"))
    both = a.join(b, "value", "full").select("value", F.coalesce("n_before", F.lit(0)).alias("n_before"), F.coalesce("n_after", F.lit(0)).alias("n_after"))
    return both.withColumn("delta", F.col("n_after") - F.col("n_before")).orderBy(F.desc(F.abs("delta")), "value")
