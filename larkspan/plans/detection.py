"""Queries of detection, placeholders and text inventory."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.functions.text import canonical_unicode, placeholder_type, token_count, token_spans
from larkspan.operators.detect import detect, redact, resolve_overlaps
from larkspan.operators.dimensions import COMMON_PATTERNS, FINANCE_PATTERNS, PLACEHOLDER_TO_GLBA, PLACEHOLDER_TO_HIPAA, TYPE_TO_TIER, lookup
from larkspan.plans import sql
from larkspan.session import dealt

_BY_NAME = {c: (c, p, s) for c, p, s in COMMON_PATTERNS}
_ALL_SPANS = ",\n".join(sql.spans("documents", "doc_id", p, f"s{i}", keep="lang") for i, (_, p, _) in enumerate(COMMON_PATTERNS))
_UNION = "\nUNION ALL ".join(f"SELECT doc_id, lang, '{c}' AS category, ordinal, start, \"end\", value FROM s{i}" for i, (c, _, _) in enumerate(COMMON_PATTERNS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return dealt(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _spans(category: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspan.functions.text import spans

    _, pattern, _ = _BY_NAME[category]
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(spans(F.col("text"), pattern)).alias("ordinal", "s"))
    return docs.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"), "s.value")


def pii_counts_by_type_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(table(spark, sf_dir, "documents"), COMMON_PATTERNS, keep=("lang",))
    return found.groupBy("category", "lang").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


def pii_density_per_1k_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = F.size(F.concat(*(F.regexp_extract_all("text", F.lit(p), F.lit(0)) for _, p, _ in COMMON_PATTERNS)))
    each = docs.select("lang", found.alias("n"), token_count(F.col("text")).alias("tokens"))
    sums = each.groupBy("lang").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens"))
    return sums.withColumn("per_1k", F.floor(F.col("n") * 1000.0 / F.col("tokens") * 1000 + 0.5) / 1000)


def pii_by_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {"CARD": "CC", "IP_ADDRESS": "ID"}
    found = detect(table(spark, sf_dir, "documents"), COMMON_PATTERNS)
    kind = F.coalesce(lookup(F.col("category"), kinds), F.col("category"))
    return found.groupBy(lookup(kind, TYPE_TO_TIER).alias("tier")).agg(F.count("*").alias("n"))


def card_luhn_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans("CARD", spark, sf_dir).select("doc_id", "value", F.call_function("luhn_check", F.col("value")).alias("valid"))


def redact_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(redact(docs, COMMON_PATTERNS).cast("binary")).alias("redacted_md5"))


def detections_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognisers with context words, threshold and safelist, overlaps resolved."""
    found = detect(table(spark, sf_dir, "documents"), [*COMMON_PATTERNS, *FINANCE_PATTERNS], threshold=0.5, safelist=["lorem"])
    return resolve_overlaps(found)


def placeholder_parse_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["PERSON", "EMAIL", "CC", "DOB", "URL", "ID", "SECRET", "A_B"]
    values = spark.range(len(kinds) * 3).select(F.concat(F.lit("["), F.get(F.array(*(F.lit(k) for k in kinds)), F.pmod("id", F.lit(len(kinds))).cast("int")), F.lit("_"), F.col("id").cast("string"), F.when(F.col("id") % 3 == 2, "").otherwise("]")).alias("placeholder"))
    kind = placeholder_type(F.col("placeholder"))
    return values.select("placeholder", kind.alias("type"), lookup(kind, PLACEHOLDER_TO_HIPAA).alias("hipaa"), lookup(kind, PLACEHOLDER_TO_GLBA).alias("glba"))


def token_spans_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents with offsets, ASCII words."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(token_spans(F.col("text"), ascii_only=True)).alias("ordinal", "s"))
    return rows.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"), "s.value")


def canonical_nfkc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(canonical_unicode(F.col("text")).cast("binary")).alias("canonical_md5"))


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    email, phone = r"[^\s@]+@[^\s@]+\.[^\s@]+", r"\+?[0-9][0-9 .()-]{6,}[0-9]"
    canonical = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    one = table(spark, sf_dir, "documents").agg(
        F.count("*").alias("records"),
        F.countDistinct(F.md5(canonical.cast("binary"))).alias("distinct_texts"),
        F.count_if(F.col("text").rlike(email)).alias("email_like"),
        F.count_if(F.col("text").rlike(phone)).alias("phone_like"),
    )
    return one.withColumn("duplicates", F.col("records") - F.col("distinct_texts"))


def language_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"), F.max(F.length("text")).cast("long").alias("longest"))


def label_quality_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return both.groupBy("source").agg(F.count("*").alias("labelled"), F.sum("quality").alias("good"), F.sum("toxic").alias("toxic"))


def conversation_pii_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(table(spark, sf_dir, "conversations").withColumn("doc_id", F.col("conv_id")), [_BY_NAME["EMAIL"], _BY_NAME["IP_ADDRESS"], _BY_NAME["PHONE"]], keep=("role",))
    hits = found.groupBy("role", "category").agg(F.count("*").alias("n"))
    turns = table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("turns"))
    return turns.join(hits, "role", "left").select("role", "turns", "category", F.coalesce("n", F.lit(0)).alias("n"))


def page_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return detect(pages, COMMON_PATTERNS, key="page_id", text_col="html").groupBy("category").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"))


QUERIES = {
    "pii_spans_email": partial(_spans, "EMAIL"),
    "pii_spans_ip": partial(_spans, "IP_ADDRESS"),
    "pii_spans_card": partial(_spans, "CARD"),
    "pii_spans_phone": partial(_spans, "PHONE"),
    "pii_spans_secret": partial(_spans, "SECRET"),
    "pii_counts_by_type_lang": pii_counts_by_type_lang,
    "pii_density_per_1k_tokens": pii_density_per_1k_tokens,
    "pii_by_tier": pii_by_tier,
    "card_luhn_valid": card_luhn_valid,
    "redact_placeholders": redact_placeholders,
    "detections_resolved": detections_resolved,
    "placeholder_parse_map": placeholder_parse_map,
    "token_spans": token_spans_of,
    "canonical_nfkc": canonical_nfkc,
    "inventory": inventory,
    "language_profile": language_profile,
    "label_quality_by_source": label_quality_by_source,
    "conversation_pii_by_role": conversation_pii_by_role,
    "page_pii": page_pii,
}


def _span_query(category: str) -> str:
    return f"WITH {sql.spans('documents', 'doc_id', _BY_NAME[category][1])} SELECT doc_id, ordinal, start, \"end\", value FROM s"


def _redact_sql() -> str:
    text = "text"
    for category, pattern, _ in COMMON_PATTERNS:
        p = pattern.replace("'", "''")
        text = f"array_to_string(list_transform(string_split_regex({text}, '{p}'), lambda g, i: CASE WHEN i = 1 THEN g ELSE '[{category}_' || (i - 1) || ']' || g END), '')"
    return f"SELECT doc_id, md5({text}) AS redacted_md5 FROM documents"


_COUNT_ALL = " + ".join("len(regexp_extract_all(text, '{}'))".format(p.replace("'", "''")) for _, p, _ in COMMON_PATTERNS)


def _resolved_sql() -> str:
    """Spans of all recognisers with scores by context, the weak and safelisted left out, overlaps resolved greedily by recursion."""
    parts, union = [], []
    for i, (category, pattern, score, *words) in enumerate([*COMMON_PATTERNS, *FINANCE_PATTERNS]):
        parts.append(sql.spans("documents", "doc_id", pattern, f"r{i}", keep="text"))
        near = " OR ".join(f"contains(before, '{w}')" for w in words[0].split()) if words else "false"
        line = "string_split(lower(substr(text, greatest(start - 50, 0) + 1, least(start, 50))), chr(10))[-1]"
        union.append(f"SELECT doc_id, '{category}' AS category, start, \"end\", value, CASE WHEN {near} THEN least({score}::DOUBLE + 0.35::DOUBLE, 1.0) ELSE {score}::DOUBLE END AS score FROM (SELECT *, {line} AS before FROM r{i})")
    return f"""WITH RECURSIVE {", ".join(parts)}, found AS ({" UNION ALL ".join(union)}),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, "end" - start DESC, start, "end", category, value) AS k FROM found
 WHERE score >= 0.5 AND NOT list_contains(regexp_split_to_array(lower(value), '[^a-z0-9]+'), 'lorem')),
go AS (SELECT DISTINCT doc_id, 0::BIGINT AS k, []::STRUCT(s BIGINT, e BIGINT, k BIGINT)[] AS kept FROM ranked
 UNION ALL SELECT g.doc_id, r.k, CASE WHEN len(list_filter(kept, lambda x: x.s < r."end" AND r.start < x.e)) > 0 THEN kept ELSE list_append(kept, {{'s': r.start, 'e': r."end", 'k': r.k}}) END FROM go g JOIN ranked r ON r.doc_id = g.doc_id AND r.k = g.k + 1),
fin AS (SELECT doc_id, unnest(list_transform(arg_max(kept, k), lambda x: x.k)) AS k FROM go GROUP BY doc_id)
SELECT doc_id, category, start, "end", value, score FROM ranked JOIN fin USING (doc_id, k)"""


_CONV = [c for c in COMMON_PATTERNS if c[0] in ("EMAIL", "IP_ADDRESS", "PHONE")]

ORACLES = {
    **{name: _span_query(c) for name, c in (("pii_spans_email", "EMAIL"), ("pii_spans_ip", "IP_ADDRESS"), ("pii_spans_card", "CARD"), ("pii_spans_phone", "PHONE"), ("pii_spans_secret", "SECRET"))},
    "pii_counts_by_type_lang": f"WITH {_ALL_SPANS} SELECT category, lang, count(*) AS n, count(DISTINCT doc_id) AS docs FROM ({_UNION}) GROUP BY category, lang",
    "pii_density_per_1k_tokens": f"""SELECT lang, n, tokens, floor(n * 1000.0::DOUBLE / tokens * 1000 + 0.5) / 1000 AS per_1k FROM (
SELECT lang, sum({_COUNT_ALL})::BIGINT AS n, sum(greatest(1, len(regexp_extract_all(text, '\\S+'))))::BIGINT AS tokens FROM documents GROUP BY lang)""",
    "pii_by_tier": f"WITH {_ALL_SPANS} SELECT {sql.mapped(sql.mapped('category', {'CARD': 'CC', 'IP_ADDRESS': 'ID'}, 'category'), TYPE_TO_TIER)} AS tier, count(*) AS n FROM ({_UNION}) GROUP BY 1",
    "card_luhn_valid": f"""WITH {sql.spans('documents', 'doc_id', _BY_NAME['CARD'][1])}
SELECT doc_id, value, list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 1 THEN CASE WHEN substr(value, i, 1)::INT * 2 > 9 THEN substr(value, i, 1)::INT * 2 - 9 ELSE substr(value, i, 1)::INT * 2 END ELSE substr(value, i, 1)::INT END)) % 10 = 0 AS valid FROM s""",
    "redact_placeholders": _redact_sql(),
    "detections_resolved": _resolved_sql(),
    "placeholder_parse_map": f"""WITH v AS (SELECT '[' || (['PERSON', 'EMAIL', 'CC', 'DOB', 'URL', 'ID', 'SECRET', 'A_B'])[i % 8 + 1] || '_' || i || CASE WHEN i % 3 = 2 THEN '' ELSE ']' END AS placeholder FROM range(24) t(i)),
k AS (SELECT placeholder, nullif(regexp_extract(placeholder, '^\\[(.+)_([0-9]+)\\]$', 1), '') AS type FROM v)
SELECT placeholder, type, {sql.mapped('type', PLACEHOLDER_TO_HIPAA)} AS hipaa, {sql.mapped('type', PLACEHOLDER_TO_GLBA)} AS glba FROM k""",
    "token_spans": f"WITH {sql.spans('documents', 'doc_id', '[A-Za-z0-9_]+|[^A-Za-z0-9_' + chr(92) + 's]')} SELECT doc_id, ordinal, start, \"end\", value FROM s",
    "canonical_nfkc": f"SELECT doc_id, md5({sql.NFKC.format('text')}) AS canonical_md5 FROM documents",
    "inventory": r"""SELECT records, distinct_texts, email_like, phone_like, records - distinct_texts AS duplicates FROM (
SELECT count(*) AS records, count(DISTINCT trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS distinct_texts,
count(*) FILTER (WHERE regexp_matches(text, '[^\s@]+@[^\s@]+\.[^\s@]+')) AS email_like, count(*) FILTER (WHERE regexp_matches(text, '\+?[0-9][0-9 .()-]{6,}[0-9]')) AS phone_like FROM documents)""",
    "language_profile": "SELECT lang, source, count(*) AS docs, sum(length(text))::BIGINT AS chars, max(length(text))::BIGINT AS longest FROM documents GROUP BY lang, source",
    "label_quality_by_source": "SELECT source, count(*) AS labelled, sum(quality)::BIGINT AS good, sum(toxic)::BIGINT AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY source",
    "conversation_pii_by_role": "WITH h AS ("
    + " UNION ALL ".join("SELECT role, '{}' AS category, sum(len(regexp_extract_all(text, '{}')))::BIGINT AS n FROM conversations GROUP BY role".format(c, p.replace("'", "''")) for c, p, _ in _CONV)
    + "), t AS (SELECT role, count(*) AS turns FROM conversations GROUP BY role) SELECT t.role, turns, category, coalesce(n, 0) AS n FROM t LEFT JOIN (SELECT * FROM h WHERE n > 0) h ON t.role = h.role",
    "page_pii": "SELECT * FROM ("
    + " UNION ALL ".join("SELECT '{}' AS category, sum(len(regexp_extract_all(html, '{}')))::BIGINT AS n, count(*) FILTER (WHERE regexp_matches(html, '{}')) AS pages FROM pages".format(c, p.replace("'", "''"), p.replace("'", "''")) for c, p, _ in COMMON_PATTERNS)
    + ") WHERE n > 0",
}
