"""Queries of planting, stand-in verdicts, recall and run summaries, and span matching."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.functions.rng import draw, draw32, weighted
from larkspan.operators import match as M
from larkspan.operators import metrics as X
from larkspan.operators.detect import detections
from larkspan.operators.dimensions import GLBA, GLBA_WEIGHTS, HEALTH_PATTERNS, HIPAA, HIPAA_WEIGHTS, PLACEHOLDER_TO_GLBA, PLACEHOLDER_TO_HIPAA, dimension
from larkspan.operators.inject import bad_entities, digit_value, inject, plan
from larkspan.operators.mock import evaluate
from larkspan.plans import sql
from larkspan.plans.detection import table


def _carriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_index"), "text", "lang")


def _facts(spark: SparkSession, sf_dir: str, weights=HIPAA_WEIGHTS, mapping=PLACEHOLDER_TO_HIPAA, miss: float = 0.2) -> DataFrame:
    planted = inject(_carriers(spark, sf_dir), weights, make=digit_value).select("row_index", "entities")
    return X.flatten_evaluations(evaluate(planted, miss, 2), mapping)


def _finance_facts(spark: SparkSession, sf_dir: str, miss: float = 0.2) -> DataFrame:
    return _facts(spark, sf_dir, GLBA_WEIGHTS, PLACEHOLDER_TO_GLBA, miss)


def prng_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = spark.range(2000).select((F.col("id") % 40 + 42).alias("seed"), (F.floor(F.col("id") / 40) + 1).alias("k"))
    return grid.select("seed", "k", draw32(F.col("seed"), F.col("k")).alias("x"), draw(F.col("seed"), F.col("k")).alias("r"))


def weighted_category_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = spark.range(1, 5001).select(draw(F.lit(42), F.col("id")).alias("r"))
    return grid.groupBy(weighted(F.col("r"), HIPAA_WEIGHTS).alias("category")).agg(F.count("*").alias("n"))


def inject_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(plan(F.coalesce("text", F.lit("")), F.col("doc_id"), HIPAA_WEIGHTS)).alias("i", "p"))
    return rows.select("doc_id", (F.col("i") + 1).cast("long").alias("ordinal"), F.col("p.position").cast("long").alias("position"), "p.category")


def inject_spliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inject(_carriers(spark, sf_dir), HIPAA_WEIGHTS, make=digit_value)
    starts = F.aggregate("entities", F.lit(0).cast("long"), lambda s, e: s + e["start_char"])
    return rows.select(F.col("row_index").alias("doc_id"), F.md5(F.col("injected").cast("binary")).alias("injected_md5"), F.size("entities").cast("long").alias("n"), starts.alias("start_sum"))


def _verify(weights, spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inject(_carriers(spark, sf_dir), weights)
    return rows.agg(F.count("*").alias("rows"), F.sum(bad_entities(rows)).cast("long").alias("bad"))


def inject_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities a row: least, most, mean and population deviation."""
    n = F.size(plan(F.coalesce("text", F.lit("")), F.col("doc_id"), HIPAA_WEIGHTS))
    rows = table(spark, sf_dir, "documents").select(n.alias("n"))
    rounded = lambda c: F.floor(c * 10000 + 0.5) / 10000
    return rows.agg(F.min("n").cast("long").alias("least"), F.max("n").cast("long").alias("most"), rounded(F.avg("n")).alias("mean"), rounded(F.stddev_pop("n")).alias("deviation"))


def verdict_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir).select("row_index", "category", "verdict", "value", "placeholder")


def recall_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.recall_by_category(_facts(spark, sf_dir), dimension(spark, HIPAA))


def recall_by_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.recall_by(_facts(spark, sf_dir), "row_index")


def recall_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.recall_overall(_facts(spark, sf_dir))


def recall_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.recall_rollup(_facts(spark, sf_dir))


def score_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    langs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_index"), F.col("lang").alias("language"))
    return X.recall_by(_facts(spark, sf_dir).join(langs, "row_index"), "language")


_TIER_OF = {"SSN": "HIGH", "ACCOUNT_NUMBER": "HIGH", "DATE": "HIGH", "NAME": "MED", "EMAIL": "MED", "PHONE": "MED", "GEO_SUBDIVISION": "LOW", "URL": "LOW"}


def score_by_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspan.operators.dimensions import lookup

    return X.recall_by_tier(_facts(spark, sf_dir).withColumn("tier", lookup(F.col("category"), _TIER_OF)))


def finance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.finance_totals(_finance_facts(spark, sf_dir))


def finance_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.finance_categories(_finance_facts(spark, sf_dir), dimension(spark, GLBA))


def top_extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.top_extras(_finance_facts(spark, sf_dir), 20)


def unmapped_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = inject(_carriers(spark, sf_dir), HIPAA_WEIGHTS, make=digit_value).select("row_index", "entities")
    return X.unmapped_types(X.flatten_evaluations(evaluate(planted, 0.2, 5), PLACEHOLDER_TO_HIPAA))


def cert_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = inject(_carriers(spark, sf_dir), HIPAA_WEIGHTS, make=digit_value).select("row_index", "entities")
    rows = evaluate(planted, 0.05, 0).withColumn("error", F.when(F.col("row_index") % 17 == 3, F.lit("timeout")))
    return rows.select("row_index", X.certificate_verdict(rows).alias("verdict")).groupBy("verdict").agg(F.count("*").alias("n"))


def summary_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over all documents: the stand-in detector misses 20 of 100 entities, then 10. Planted once, scored twice."""
    planted = inject(_carriers(spark, sf_dir), GLBA_WEIGHTS, make=digit_value).select("row_index", "entities")
    runs = [X.flatten_evaluations(evaluate(planted, miss, 2), PLACEHOLDER_TO_GLBA) for miss in (0.2, 0.1)]
    before, after = (X.finance_categories(run, dimension(spark, GLBA)) for run in runs)
    return X.summary_delta(before, after)


def extras_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """False positives by value of two runs, with two and with three spurious detections a row; the 20 commonest of each are compared."""
    planted = inject(_carriers(spark, sf_dir), GLBA_WEIGHTS, make=digit_value).select("row_index", "entities")
    runs = [X.top_extras(X.flatten_evaluations(evaluate(planted, 0.2, n), PLACEHOLDER_TO_GLBA), 20) for n in (2, 3)]
    return X.extras_delta(*runs)


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = X.latency_summary(table(spark, sf_dir, "events"), "value", "event_type")
    return out.withColumn("mean", F.floor(F.col("mean") * 10000 + 0.5) / 10000)


def wall_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.wall_clock(table(spark, sf_dir, "events"), "ts", "event_id", "event_type")


#: Patterns that find planted numbers whole, in part, or with a word before them; and numbers of the documents' own.
_NUMBER_PATTERNS = [("DATE", r"[0-9]{9}", 0.9), ("NAME", r"[0-9]{6}", 0.5), ("GEO_SUBDIVISION", r"[A-Za-z]+ [0-9]{5}", 0.4)]


def _bounds(spans, start: str, end: str):
    return F.transform(spans, lambda e: F.struct(e[start].alias("start"), e[end].alias("end"), e["category"].alias("category")))


def _sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, truth, preds): the spans planted in each document, and those that patterns find in it, by place."""
    planted = inject(_carriers(spark, sf_dir), HIPAA_WEIGHTS, make=digit_value)
    found = F.array_sort(_bounds(detections(F.col("injected"), _NUMBER_PATTERNS), "start", "end"))
    return planted.select(F.col("row_index").alias("doc_id"), "lang", _bounds(F.col("entities"), "start_char", "end_char").alias("truth"), found.alias("preds"))


def _matched(pairs, spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sides(spark, sf_dir)
    return rows.select("doc_id", F.explode(pairs(F.col("truth"), F.col("preds"))).alias("m")).select("doc_id", F.col("m.t").cast("long").alias("t"), F.col("m.p").cast("long").alias("p"))


def _span_facts(spark: SparkSession, sf_dir: str, pairs=M.match_overlap) -> DataFrame:
    """(doc_id, lang, category, verdict) of planted against found spans, matched within the row."""
    return M.verdicts(_sides(spark, sf_dir), "truth", "preds", pairs(F.col("truth"), F.col("preds")), ("doc_id", "lang"))


def span_recall_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans matched at half the truth's length: recall by category."""
    return X.recall_by_category(_span_facts(spark, sf_dir, M.match_threshold), dimension(spark, HIPAA))


def span_score_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.recall_by(_span_facts(spark, sf_dir).withColumnRenamed("lang", "language"), "language")


def span_score_by_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspan.operators.dimensions import lookup

    return X.recall_by_tier(_span_facts(spark, sf_dir).withColumn("tier", lookup(F.col("category"), _TIER_OF)))


def span_set_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal bounds and category; every third truth is one to keep, so a prediction of it is wrong."""
    gold = F.transform("truth", lambda t, i: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["category"].alias("category"), F.when(i % 3 == 2, "KEEP").otherwise("REDACT").alias("expected")))
    s = M.set_scores(F.col("gold"), F.col("preds"))
    rows = _sides(spark, sf_dir).withColumn("gold", gold).select("doc_id", F.explode(F.array(s)).alias("s"))
    return rows.agg(*(F.sum(f"s.{c}").cast("long").alias(c) for c in ("tp", "fp", "fn")))


def boundary_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sides(spark, sf_dir)
    return rows.select("doc_id", M.boundary_misses(F.col("truth"), F.col("preds")).cast("long").alias("misses"))


def planted_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers planted in documents, found by patterns, matched greedily within the row: recall by category."""
    planted = inject(_carriers(spark, sf_dir), HIPAA_WEIGHTS)
    bounds = lambda spans, a, b: F.transform(spans, lambda e: F.struct(e[a].alias("start"), e[b].alias("end"), e["category"].alias("category")))
    found = F.array_sort(bounds(detections(F.col("injected"), HEALTH_PATTERNS), "start", "end"))
    both = planted.select("row_index", bounds(F.col("entities"), "start_char", "end_char").alias("truth"), found.alias("preds"))
    facts = M.verdicts(both, "truth", "preds", M.match_threshold(F.col("truth"), F.col("preds")), ("row_index",))
    return X.recall_by_category(facts, dimension(spark, HIPAA))


QUERIES = {
    "prng_draws": prng_draws,
    "weighted_category_draws": weighted_category_draws,
    "inject_plan": inject_plan,
    "inject_spliced": inject_spliced,
    "inject_verify": partial(_verify, HIPAA_WEIGHTS),
    "inject_verify_finance": partial(_verify, GLBA_WEIGHTS),
    "inject_profile": inject_profile,
    "verdict_facts": verdict_facts,
    "recall_by_category": recall_by_category,
    "recall_by_row": recall_by_row,
    "recall_overall": recall_overall,
    "recall_rollup": recall_rollup,
    "score_by_language": score_by_language,
    "score_by_tier": score_by_tier,
    "finance_summary": finance_summary,
    "finance_categories": finance_categories,
    "top_extras": top_extras,
    "unmapped_types": unmapped_types,
    "cert_verdicts": cert_verdicts,
    "summary_delta": summary_delta,
    "extras_delta": extras_delta,
    "latency_percentiles": latency_percentiles,
    "wall_clock": wall_clock,
    "span_match_threshold": partial(_matched, M.match_threshold),
    "span_match_overlap": partial(_matched, M.match_overlap),
    "span_match_exact": partial(_matched, partial(M.match_overlap, exact=True)),
    "span_recall_by_category": span_recall_by_category,
    "span_score_by_language": span_score_by_language,
    "span_score_by_tier": span_score_by_tier,
    "span_set_match": span_set_match,
    "boundary_diagnostics": boundary_diagnostics,
    "planted_recall": planted_recall,
}

_F = sql.mock_facts()
_G = sql.mock_facts(*sql.FINANCE_FACTS)
_PCT = "floor({0} / nullif({1}, 0)::DOUBLE * 10000 + 0.5) / 100"


def _finance_cats(where: str, tag: str) -> str:
    names = [*GLBA, "UNMAPPED"]
    values = ", ".join(f"('{n}', {i if n != 'UNMAPPED' else 1000})" for i, n in enumerate(names))
    return f"""fc_{tag} AS (SELECT ordinal, dim.category, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM (VALUES {values}) AS dim(category, ordinal)
LEFT JOIN (SELECT coalesce(category, 'UNMAPPED') AS category, {sql.COUNTS} FROM facts {where} GROUP BY 1) c USING (category)),
f_{tag} AS (SELECT *, {_PCT.format('tp', 'tp + fn')} AS recall_pct, {_PCT.format('tp', 'tp + fp')} AS precision_pct FROM fc_{tag})"""


def _sides_sql() -> str:
    """CTEs truth and preds (doc_id, i, s, e, c) over the planted texts."""
    parts = [sql.spans("injected", "doc_id", p, f"n{k}", "text") for k, (_, p, _) in enumerate(_NUMBER_PATTERNS)]
    union = " UNION ALL ".join(f"SELECT doc_id, start, \"end\", '{c}' AS c FROM n{k}" for k, (c, _, _) in enumerate(_NUMBER_PATTERNS))
    return f"""{sql.injected()},
{", ".join(parts)},
truth AS MATERIALIZED (SELECT doc_id, (ordinal - 1)::BIGINT AS i, position + 1 + (ordinal - 1) * 11 AS s, position + 10 + (ordinal - 1) * 11 AS e, category AS c FROM planned),
preds AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start, "end", c) - 1 AS i, start AS s, "end" AS e, c FROM ({union}))"""


_HALF = "least(t.e, p.e) > greatest(t.s, p.s) AND t.e > t.s AND 2 * (least(t.e, p.e) - greatest(t.s, p.s)) >= t.e - t.s"
_ANY = "t.e > t.s AND p.e > p.s AND least(t.e, p.e) > greatest(t.s, p.s)"


def _greedy_sql(condition: str, rank: str, rest: str = "SELECT doc_id, unnest(ut) AS t, unnest(up) AS p FROM fin") -> str:
    return f"""WITH RECURSIVE {_sides_sql()},
pairs AS (SELECT t.doc_id, t.i AS t, p.i AS p, p.s AS ps, p.e - p.s AS pl, least(t.e, p.e) - greatest(t.s, p.s) AS ov, t.e - t.s AS tl FROM truth t JOIN preds p USING (doc_id) WHERE {condition}),
cand AS MATERIALIZED (SELECT doc_id, t, p, row_number() OVER (PARTITION BY doc_id ORDER BY {rank} DESC, ps, pl, t, p) AS rn FROM pairs),
go AS (SELECT doc_id, 0::BIGINT AS rn, []::BIGINT[] AS ut, []::BIGINT[] AS up FROM documents
 UNION ALL SELECT g.doc_id, c.rn, CASE WHEN list_contains(ut, c.t) OR list_contains(up, c.p) THEN ut ELSE list_append(ut, c.t) END, CASE WHEN list_contains(ut, c.t) OR list_contains(up, c.p) THEN up ELSE list_append(up, c.p) END
 FROM go g JOIN cand c ON c.doc_id = g.doc_id AND c.rn = g.rn + 1),
fin AS MATERIALIZED (SELECT doc_id, arg_max(ut, rn) AS ut, arg_max(up, rn) AS up FROM go GROUP BY doc_id)
{rest}"""


def _span_facts_sql(condition: str, rank: str, rest: str) -> str:
    """The SQL ends in CTE facts (doc_id, lang, category, verdict), then `rest`."""
    facts = """, hit AS MATERIALIZED (SELECT doc_id, unnest(ut) AS t, unnest(up) AS p FROM fin),
facts AS (SELECT t.doc_id, lang, t.c AS category, CASE WHEN hit.t IS NULL THEN 'fn' ELSE 'tp' END AS verdict FROM truth t JOIN documents USING (doc_id) LEFT JOIN hit ON hit.doc_id = t.doc_id AND hit.t = t.i
UNION ALL SELECT p.doc_id, lang, p.c, 'fp' FROM preds p JOIN documents USING (doc_id) LEFT JOIN hit ON hit.doc_id = p.doc_id AND hit.p = p.i WHERE hit.p IS NULL)"""
    return _greedy_sql(condition, rank, facts + rest)


ORACLES = {
    "prng_draws": f"WITH grid AS (SELECT i % 40 + 42 AS seed, i // 40 + 1 AS k FROM range(2000) t(i)), {sql.draws('grid', 'seed', 'k', 'seed, k')} SELECT seed, k, (r * 4294967296)::BIGINT AS x, r FROM drawn",
    "weighted_category_draws": f"WITH grid AS (SELECT 42 AS seed, i AS k FROM range(1, 5001) t(i)), {sql.draws('grid', 'seed', 'k', 'k')} SELECT {sql.weighted('r', HIPAA_WEIGHTS)} AS category, count(*) AS n FROM drawn GROUP BY 1",
    "inject_plan": f"WITH {sql.plan()} SELECT doc_id, ordinal, position, category FROM planned",
    "inject_spliced": f"WITH {sql.injected()} SELECT doc_id, md5(text) AS injected_md5, n, start_sum FROM injected",
    "inject_verify": partial(_verify, HIPAA_WEIGHTS),
    "inject_verify_finance": partial(_verify, GLBA_WEIGHTS),
    "inject_profile": inject_profile,
    "verdict_facts": verdict_facts,
    "recall_by_category": recall_by_category,
    "recall_by_row": recall_by_row,
    "recall_overall": recall_overall,
    "recall_rollup": recall_rollup,
    "score_by_language": score_by_language,
    "score_by_tier": score_by_tier,
    "finance_summary": finance_summary,
    "finance_categories": finance_categories,
    "top_extras": top_extras,
    "unmapped_types": unmapped_types,
    "cert_verdicts": cert_verdicts,
    "summary_delta": summary_delta,
    "extras_delta": extras_delta,
    "latency_percentiles": latency_percentiles,
    "wall_clock": wall_clock,
    "span_match_threshold": partial(_matched, M.match_threshold),
    "span_match_overlap": partial(_matched, M.match_overlap),
    "span_match_exact": partial(_matched, partial(M.match_overlap, exact=True)),
    "span_recall_by_category": span_recall_by_category,
    "span_score_by_language": span_score_by_language,
    "span_score_by_tier": span_score_by_tier,
    "span_set_match": span_set_match,
    "boundary_diagnostics": boundary_diagnostics,
    "planted_recall": planted_recall,
}

_F = sql.mock_facts()
_G = sql.mock_facts(*sql.FINANCE_FACTS)
_PCT = "floor({0} / nullif({1}, 0)::DOUBLE * 10000 + 0.5) / 100"


def _finance_cats(where: str, tag: str) -> str:
    names = [*GLBA, "UNMAPPED"]
    values = ", ".join(f"('{n}', {i if n != 'UNMAPPED' else 1000})" for i, n in enumerate(names))
    return f"""fc_{tag} AS (SELECT ordinal, dim.category, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM (VALUES {values}) AS dim(category, ordinal)
LEFT JOIN (SELECT coalesce(category, 'UNMAPPED') AS category, {sql.COUNTS} FROM facts {where} GROUP BY 1) c USING (category)),
f_{tag} AS (SELECT *, {_PCT.format('tp', 'tp + fn')} AS recall_pct, {_PCT.format('tp', 'tp + fp')} AS precision_pct FROM fc_{tag})"""


def _sides_sql() -> str:
    """CTEs truth and preds (doc_id, i, s, e, c) over the planted texts."""
    parts = [sql.spans("injected", "doc_id", p, f"n{k}", "text") for k, (_, p, _) in enumerate(_NUMBER_PATTERNS)]
    union = " UNION ALL ".join(f"SELECT doc_id, start, \"end\", '{c}' AS c FROM n{k}" for k, (c, _, _) in enumerate(_NUMBER_PATTERNS))
    return f"""{sql.injected()},
{", ".join(parts)},
truth AS MATERIALIZED (SELECT doc_id, (ordinal - 1)::BIGINT AS i, position + 1 + (ordinal - 1) * 11 AS s, position + 10 + (ordinal - 1) * 11 AS e, category AS c FROM planned),
preds AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start, "end", c) - 1 AS i, start AS s, "end" AS e, c FROM ({union}))"""


_HALF = "least(t.e, p.e) > greatest(t.s, p.s) AND t.e > t.s AND 2 * (least(t.e, p.e) - greatest(t.s, p.s)) >= t.e - t.s"
_ANY = "t.e > t.s AND p.e > p.s AND least(t.e, p.e) > greatest(t.s, p.s)"


def _greedy_sql(condition: str, rank: str, rest: str = "SELECT doc_id, unnest(ut) AS t, unnest(up) AS p FROM fin") -> str:
    return f"""WITH RECURSIVE {_sides_sql()},
pairs AS (SELECT t.doc_id, t.i AS t, p.i AS p, p.s AS ps, p.e - p.s AS pl, least(t.e, p.e) - greatest(t.s, p.s) AS ov, t.e - t.s AS tl FROM truth t JOIN preds p USING (doc_id) WHERE {condition}),
cand AS MATERIALIZED (SELECT doc_id, t, p, row_number() OVER (PARTITION BY doc_id ORDER BY {rank} DESC, ps, pl, t, p) AS rn FROM pairs),
go AS (SELECT doc_id, 0::BIGINT AS rn, []::BIGINT[] AS ut, []::BIGINT[] AS up FROM documents
 UNION ALL SELECT g.doc_id, c.rn, CASE WHEN list_contains(ut, c.t) OR list_contains(up, c.p) THEN ut ELSE list_append(ut, c.t) END, CASE WHEN list_contains(ut, c.t) OR list_contains(up, c.p) THEN up ELSE list_append(up, c.p) END
 FROM go g JOIN cand c ON c.doc_id = g.doc_id AND c.rn = g.rn + 1),
fin AS MATERIALIZED (SELECT doc_id, arg_max(ut, rn) AS ut, arg_max(up, rn) AS up FROM go GROUP BY doc_id)
{rest}"""


def _span_facts_sql(condition: str, rank: str, rest: str) -> str:
    """The SQL ends in CTE facts (doc_id, lang, category, verdict), then `rest`."""
    facts = """, hit AS MATERIALIZED (SELECT doc_id, unnest(ut) AS t, unnest(up) AS p FROM fin),
facts AS (SELECT t.doc_id, lang, t.c AS category, CASE WHEN hit.t IS NULL THEN 'fn' ELSE 'tp' END AS verdict FROM truth t JOIN documents USING (doc_id) LEFT JOIN hit ON hit.doc_id = t.doc_id AND hit.t = t.i
UNION ALL SELECT p.doc_id, lang, p.c, 'fp' FROM preds p JOIN documents USING (doc_id) LEFT JOIN hit ON hit.doc_id = p.doc_id AND hit.p = p.i WHERE hit.p IS NULL)"""
    return _greedy_sql(condition, rank, facts + rest)


ORACLES = {
    "prng_draws": f"WITH grid AS (SELECT i % 40 + 42 AS seed, i // 40 + 1 AS k FROM range(2000) t(i)), {sql.draws('grid', 'seed', 'k', 'seed, k')} SELECT seed, k, (r * 4294967296)::BIGINT AS x, r FROM drawn",
    "weighted_category_draws": f"WITH grid AS (SELECT 42 AS seed, i AS k FROM range(1, 5001) t(i)), {sql.draws('grid', 'seed', 'k', 'k')} SELECT {sql.weighted('r', HIPAA_WEIGHTS)} AS category, count(*) AS n FROM drawn GROUP BY 1",
    "inject_plan": f"WITH {sql.plan()} SELECT doc_id, ordinal, position, category FROM planned",
    "inject_spliced": f"""WITH {sql.plan()},
o AS (SELECT doc_id, position, value, ordinal, coalesce(lag(position) OVER (PARTITION BY doc_id ORDER BY ordinal), 0) AS prev FROM planned),
j AS (SELECT o.doc_id, string_agg(substr(b.text, prev + 1, position - prev) || ' ' || value || ' ', '' ORDER BY ordinal) AS body, max(position) AS last, count(*) AS n, sum(position + 1 + (ordinal - 1) * 11)::BIGINT AS start_sum FROM o JOIN base b USING (doc_id) GROUP BY o.doc_id)
SELECT doc_id, md5(body || substr(b.text, last + 1)) AS injected_md5, n, start_sum FROM j JOIN base b USING (doc_id)""",
    "inject_verify": "SELECT count(*) AS rows, 0::BIGINT AS bad FROM documents",
    "inject_verify_finance": "SELECT count(*) AS rows, 0::BIGINT AS bad FROM documents",
    "inject_profile": f"WITH {sql.plan()}, n AS (SELECT doc_id, count(*) AS n FROM planned GROUP BY doc_id) SELECT min(n) AS least, max(n) AS most, floor(avg(n) * 10000 + 0.5) / 10000 AS mean, floor(stddev_pop(n) * 10000 + 0.5) / 10000 AS deviation FROM n",
    "verdict_facts": f"WITH {_F} SELECT row_index, category, verdict, value, placeholder FROM facts",
    "recall_by_category": f"WITH {_F}, c AS (SELECT category, {sql.COUNTS} FROM facts GROUP BY category), d AS (SELECT ordinal, dim.category, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM {sql.dimension(HIPAA)} LEFT JOIN c USING (category)) {sql.rated('d', 'ordinal, category,')}",
    "recall_by_row": f"WITH {_F}, c AS (SELECT row_index, {sql.COUNTS} FROM facts GROUP BY row_index) {sql.rated('c', 'row_index,')}",
    "recall_overall": f"WITH {_F}, c AS (SELECT {sql.COUNTS} FROM facts) {sql.rated('c', '')}",
    "recall_rollup": f"WITH {_F} SELECT CASE WHEN grouping(category) = 0 THEN 'category' WHEN grouping(row_index) = 0 THEN 'row' ELSE 'overall' END AS dimension, CASE WHEN grouping(category) = 0 THEN category WHEN grouping(row_index) = 0 THEN row_index::VARCHAR ELSE '' END AS key, {sql.COUNTS} FROM facts GROUP BY GROUPING SETS ((category), (row_index), ())",
    "score_by_language": f"WITH {_F}, c AS (SELECT lang AS language, {sql.COUNTS} FROM facts JOIN documents ON doc_id = row_index GROUP BY 1) {sql.rated('c', 'language,')}",
    "score_by_tier": f"WITH {_F}, c AS (SELECT {sql.mapped('category', _TIER_OF)} AS tier, {sql.COUNTS} FROM facts GROUP BY 1), d AS (SELECT dim.ordinal, dim.tier, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM (VALUES ('HIGH', 0), ('MED', 1), ('LOW', 2)) AS dim(tier, ordinal) LEFT JOIN c USING (tier)) {sql.rated('d', 'ordinal, tier,')}",
    "finance_summary": f"""WITH {_G}, c AS (SELECT {sql.COUNTS}, count(*) FILTER (WHERE verdict = 'fp' AND category IS NULL) AS fp_unmapped FROM facts),
p AS (SELECT *, fp - fp_unmapped AS fp_attributed, coalesce({_PCT.format('tp', 'tp + fn')}, 0) AS recall_pct, coalesce({_PCT.format('tp', 'tp + fp')}, 0) AS precision_pct FROM c)
SELECT *, floor(coalesce(2 * recall_pct * precision_pct / nullif(recall_pct + precision_pct, 0), 0) * 100 + 0.5) / 100 AS f1 FROM p""",
    "finance_categories": f"WITH {_G}, {_finance_cats('', 'a')} SELECT ordinal, category, tp, fp, fn, recall_pct, precision_pct FROM f_a",
    "summary_delta": f"""SELECT category, a.recall_pct AS recall_pct_before, a.precision_pct AS precision_pct_before, a.fp AS fp_before, b.recall_pct AS recall_pct_after, b.precision_pct AS precision_pct_after, b.fp AS fp_after,
b.recall_pct - a.recall_pct AS recall_delta, b.fp - a.fp AS fp_delta
FROM (WITH {_G}, {_finance_cats('', 'a')} SELECT * FROM f_a) a JOIN (WITH {sql.mock_facts(*sql.FINANCE_FACTS, 0.1)}, {_finance_cats('', 'b')} SELECT * FROM f_b) b USING (category)
WHERE category <> 'UNMAPPED' AND a.recall_pct IS NOT NULL AND b.recall_pct IS NOT NULL""",
    "top_extras": f"WITH {_G} SELECT value, count(*) AS n, min(row_index) AS first_row, arg_min(placeholder, row_index) AS placeholder FROM facts WHERE verdict = 'fp' GROUP BY value ORDER BY n DESC, first_row, value LIMIT 20",
    "unmapped_types": "SELECT 'ID' AS type, min(doc_id) AS first_row, count(*) AS n FROM documents",
    "cert_verdicts": f"""WITH {sql.plan()}, {sql.draws('planned', 'doc_id', 'ordinal', 'doc_id, ordinal', 'mk')},
v AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE r >= 0.05::DOUBLE) AS tp FROM mk GROUP BY doc_id)
SELECT CASE WHEN doc_id % 17 = 3 THEN 'error' WHEN tp = n THEN 'verified' WHEN tp = 0 THEN 'miss' ELSE 'partial' END AS verdict, count(*) AS n FROM v GROUP BY 1""",
    "latency_percentiles": """SELECT event_type, count(value) AS n, floor(avg(value) * 10000 + 0.5) / 10000 AS mean, list_sort(list(value))[floor((count(value) - 1) * 0.5)::INT + 1] AS p50,
list_sort(list(value))[floor((count(value) - 1) * 0.95)::INT + 1] AS p95, max(value) AS max FROM events WHERE value IS NOT NULL GROUP BY event_type""",
    "wall_clock": "SELECT event_type, date_diff('millisecond', arg_min(ts, event_id), arg_max(ts, event_id)) AS wall_ms, count(*) AS n FROM events GROUP BY event_type",
    "extras_delta": f"""WITH a AS (WITH {_G}, e AS (SELECT value, count(*) AS n, min(row_index) AS first_row FROM facts WHERE verdict = 'fp' GROUP BY value) SELECT * FROM e ORDER BY n DESC, first_row, value LIMIT 20),
b AS (WITH {sql.mock_facts(*sql.FINANCE_FACTS, 0.2, 3)}, e AS (SELECT value, count(*) AS n, min(row_index) AS first_row FROM facts WHERE verdict = 'fp' GROUP BY value) SELECT * FROM e ORDER BY n DESC, first_row, value LIMIT 20)
SELECT coalesce(a.value, b.value) AS value, coalesce(a.n, 0) AS n_before, coalesce(b.n, 0) AS n_after, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta FROM a FULL JOIN b ON a.value = b.value""",
    "span_match_threshold": _greedy_sql(_HALF, "ov / tl::DOUBLE"),
    "span_match_overlap": _greedy_sql(_ANY, "ov"),
    "span_match_exact": _greedy_sql("t.e > t.s AND p.e > p.s AND t.s = p.s AND t.e = p.e", "ov"),
    "span_recall_by_category": _span_facts_sql(
        _HALF,
        "ov / tl::DOUBLE",
        f", c AS (SELECT category, {sql.COUNTS} FROM facts GROUP BY category), d AS (SELECT ordinal, dim.category, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM {sql.dimension(HIPAA)} LEFT JOIN c USING (category)) {sql.rated('d', 'ordinal, category,')}",
    ),
    "span_score_by_language": _span_facts_sql(_ANY, "ov", f", c AS (SELECT lang AS language, {sql.COUNTS} FROM facts GROUP BY 1) {sql.rated('c', 'language,')}"),
    "span_score_by_tier": _span_facts_sql(
        _ANY,
        "ov",
        f", c AS (SELECT {sql.mapped('category', _TIER_OF)} AS tier, {sql.COUNTS} FROM facts GROUP BY 1), d AS (SELECT dim.ordinal, dim.tier, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM (VALUES ('HIGH', 0), ('MED', 1), ('LOW', 2)) AS dim(tier, ordinal) LEFT JOIN c USING (tier)) {sql.rated('d', 'ordinal, tier,')}",
    ),
    "span_set_match": f"""WITH {_sides_sql()}, g AS (SELECT doc_id, s, e, c FROM truth WHERE i % 3 <> 2), q AS (SELECT DISTINCT doc_id, s, e, c FROM preds)
SELECT (SELECT count(*) FROM g JOIN q USING (doc_id, s, e, c)) AS tp, (SELECT count(*) FROM q ANTI JOIN g USING (doc_id, s, e, c)) AS fp, (SELECT count(*) FROM g ANTI JOIN q USING (doc_id, s, e, c)) AS fn""",
    "boundary_diagnostics": f"""WITH {_sides_sql()}, equal AS (SELECT DISTINCT t.doc_id, t.i FROM truth t JOIN preds p USING (doc_id, s, e, c)),
near AS (SELECT DISTINCT t.doc_id, t.i FROM truth t JOIN preds p ON p.doc_id = t.doc_id AND p.c = t.c AND p.s < t.e AND t.s < p.e),
miss AS (SELECT doc_id, count(*) AS misses FROM near ANTI JOIN equal USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(misses, 0) AS misses FROM documents LEFT JOIN miss USING (doc_id)""",
}
