"""Queries of the corpus gates, over documents made into labelled rows with faults, and over documents against the benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.functions.text import canonical, spans
from larkspan.operators import custody, gates
from larkspan.operators.dimensions import COMMON_PATTERNS
from larkspan.plans import sql
from larkspan.plans.detection import table

# Each column of a labelled row as an expression that both engines read alike; the faults in them are what the gates must find.
_BUILT = {
    "id": "concat('row-', CAST(CASE WHEN doc_id % 23 = 7 THEN doc_id - 1 ELSE doc_id END AS STRING))",
    "lang": "lang",
    "zone": "CASE WHEN doc_id % 11 = 3 THEN 'poem' ELSE 'prose' END",
    "org_id": "'org-1'",
    "provenance": "CASE WHEN doc_id % 13 = 5 THEN 'measured-live' WHEN doc_id % 29 = 1 THEN 'guessed' ELSE 'synthetic-generated' END",
    "consent_basis": "CASE WHEN doc_id % 31 = 2 THEN 'none' ELSE 'synthetic' END",
    "split": "CASE doc_id % 5 WHEN 0 THEN 'dev' WHEN 1 THEN 'eval-only' ELSE 'train' END",
    "family_id": "CASE WHEN doc_id % 3 = 0 THEN concat('hard-role-f', CAST(doc_id % 40 AS STRING)) ELSE concat('general-en-f', CAST(doc_id % 36 AS STRING)) END",
    "source": "CASE WHEN doc_id % 19 = 6 THEN NULL ELSE source END",
    "created": "CASE WHEN doc_id % 17 = 4 THEN '2026/01/01' ELSE '2026-01-01' END",
    "template_lineage": "concat('lineage-', CAST(doc_id % 50 AS STRING))",
}
_NUMBER = "[0-9]{4}"
_SPAN = {"category": "CASE WHEN doc_id % 7 = 3 THEN ' ' WHEN doc_id % 7 = 5 THEN NULL ELSE 'PERSON' END", "expected": "CASE WHEN doc_id % 7 = 4 THEN 'MAYBE' ELSE 'REDACT' END", "longer": "CASE WHEN doc_id % 7 = 2 THEN 1 ELSE 0 END"}
_FLOORS = [("contextual_hard_negative", "role", "en", 10, 1), ("general_synthetic", "general-person-clean-control", "en", 1, 1), ("general_synthetic", "general-person-clean-control", "de", 1_000_000, 1), ("structural_domain_positive", "name-in-technical-zone", "en", 1, 1)]


def bank_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as labelled rows with a line number; four-digit numbers are their spans."""
    docs = table(spark, sf_dir, "documents")
    part = {k: F.expr(v) for k, v in _SPAN.items()}

    def labelled(s):
        return F.struct(s["start"].alias("start"), (s["end"] + part["longer"]).alias("end"), part["category"].alias("category"), part["expected"].alias("expected"), s["value"].alias("surface"))

    return docs.select(F.col("doc_id").alias("line_no"), "text", F.transform(spans(F.col("text"), _NUMBER), labelled).alias("spans"), *(F.expr(e).alias(c) for c, e in _BUILT.items()))


def row_validation_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.row_failures(bank_rows(spark, sf_dir)).unionByName(gates.unexpected_fields(bank_rows(spark, sf_dir)))


def quarantine_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.quarantine_failures(bank_rows(spark, sf_dir))


def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.duplicate_ids(bank_rows(spark, sf_dir))


def family_split_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.family_conflicts(bank_rows(spark, sf_dir))


def power_floor_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.dev_counts(bank_rows(spark, sf_dir))


def power_floor_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    floors = spark.createDataFrame(_FLOORS, "bucket string, class string, lang string, min_cases long, min_spans long")
    return gates.power_floor_failures(floors, gates.dev_counts(bank_rows(spark, sf_dir)))


_PATH = "CASE item_id % 6 WHEN 0 THEN concat('/Users/a/', CAST(item_id AS STRING)) WHEN 1 THEN concat('/home/b/', CAST(item_id AS STRING)) WHEN 2 THEN concat('c:', CAST(item_id AS STRING)) ELSE concat('rows/', CAST(item_id AS STRING)) END"
_PLACE = "CASE item_id % 4 WHEN 0 THEN 'local' WHEN 1 THEN 'repo' WHEN 2 THEN 'foreign-repo' ELSE 'attic' END"


def manifest_hygiene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path_or_ref, verdict, rule) of a manifest over benchmark items: files that are absent, changed or right, and paths that tell too much."""
    items = table(spark, sf_dir, "benchmark")
    entries = items.select(F.expr(_PATH).alias("path_or_ref"), F.sha2("text", 256).alias("sha256"), F.expr(_PLACE).alias("location_class"))
    files = items.where("item_id % 5 <> 4").select(F.expr(_PATH).alias("path"), F.when(F.expr("item_id % 7 = 1"), F.sha2(F.reverse("text"), 256)).otherwise(F.sha2("text", 256)).alias("sha256"))
    checked = gates.manifest_failures(entries, files)
    hygiene = gates.path_hygiene(entries).select(F.col("scope").alias("path_or_ref"), F.lit("FAIL").alias("verdict"), "rule")
    return checked.unionByName(hygiene)


def contamination_8gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.ngram_overlap(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), canon=canonical)


def contamination_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.contamination_failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.exact_duplicates(table(spark, sf_dir, "documents"))


_MASKED = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}|[0-9]{16}"


def masked_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.expr(_BUILT["split"]).alias("split"), spans(F.coalesce("text", F.lit("")), _MASKED).alias("spans"))
    return gates.masked_signatures(docs, "spans")


def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as train and the whole benchmark as dev, with the spans that the common patterns find."""
    found = F.flatten(F.array(*(F.transform(spans(F.col("text"), p), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for _, p, _ in COMMON_PATTERNS)))

    def side(name: str, key: str, split: str, family) -> DataFrame:
        return table(spark, sf_dir, name).select(F.concat(F.lit(f"{name}:"), key).alias("id"), "text", F.coalesce(found, F.array()).alias("spans"), F.lit(split).alias("split"), family.alias("family_id"), family.alias("template_lineage"))

    return side("documents", "doc_id", "train", F.col("source")).unionByName(side("benchmark", "item_id", "dev", F.lit("benchmark")))


def nearest_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    signed = gates.signatures(split_rows(spark, sf_dir)).select("id", "split", "signature")
    near = gates.nearest_jaccard(signed.where("split = 'dev'"), signed.where("split = 'train'"))
    return near.select("id", (F.floor(F.col("similarity") * 1e6 + 0.5) / 1e6).alias("similarity"))


def split_integrity_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.split_integrity_failures(gates.signed_rows(split_rows(spark, sf_dir)))


def split_integrity_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.split_integrity_stats(gates.signed_rows(split_rows(spark, sf_dir)))


_ASKED = "CASE item_id % 5 WHEN 0 THEN concat('rows/', CAST(item_id AS STRING)) WHEN 1 THEN concat('data/eval/rows/', CAST(item_id - 1 AS STRING)) WHEN 2 THEN concat('rows/../', CAST(item_id AS STRING)) WHEN 3 THEN concat('/abs/', CAST(item_id AS STRING)) ELSE concat('xrows/', CAST(item_id - 4 AS STRING)) END"
_ENTRY, _ROLE = "concat('rows/', CAST(item_id AS STRING))", "CASE WHEN item_id % 10 < 5 THEN 'eval-only' ELSE 'train' END"


def custody_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared inputs against a manifest whose eval-only entries no run may read."""
    items = table(spark, sf_dir, "benchmark")
    return custody.custody_failures(items.select(F.expr(_ASKED).alias("path")), items.select(F.expr(_ENTRY).alias("path_or_ref"), F.expr(_ROLE).alias("role")))


_EPOCHS = "CASE WHEN item_id % 13 = 4 THEN item_id WHEN item_id % 11 = 6 THEN NULL ELSE item_id + 1 END"
_STEPS = "CASE WHEN item_id % 7 = 2 THEN (item_id + 1) * 50 + 1 ELSE (item_id + 1) * 50 END"


def epoch_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training records of 50-step epochs, some off their boundary, repeated, beyond the end, without loss or missing."""
    rows = table(spark, sf_dir, "benchmark").select(F.expr(_EPOCHS).alias("epoch"), F.expr(_STEPS).alias("global_step"), F.when(F.expr("item_id % 9 <> 5"), F.lit(0.5)).alias("loss"))
    return custody.epoch_failures(rows, 50, 1500)


QUERIES = {
    f.__name__: f
    for f in (
        row_validation_failures, quarantine_failures, duplicate_ids, family_split_conflicts, power_floor_counts, power_floor_check, manifest_hygiene,
        contamination_8gram, contamination_failures, exact_duplicates, masked_signatures, nearest_jaccard, split_integrity_failures, split_integrity_stats, custody_failures, epoch_failures,
    )
}

_BANK = f"""{sql.spans("documents", "doc_id", _NUMBER, keep="lang")},
listed AS (SELECT doc_id, list({{'s': start, 'e': "end", 'v': value}} ORDER BY ordinal) AS found FROM s GROUP BY doc_id),
bank AS MATERIALIZED (SELECT doc_id AS line_no, text, {", ".join(f"{e} AS {c}" for c, e in _BUILT.items())}, {", ".join(f"{e} AS span_{c}" for c, e in _SPAN.items())},
coalesce(found, []) AS found FROM documents LEFT JOIN listed USING (doc_id))"""

_SCOPE = "coalesce(id, '<no-id>')"


def _rows_sql() -> str:
    missing = "concat_ws(',', " + ", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in ("id", "text", "lang", "zone", "org_id", "provenance", "consent_basis", "split", "family_id", "source", "created", "template_lineage")) + ")"
    allowed = {"lang": gates.LANGS, "zone": gates.ZONES, "provenance": gates.PROVENANCES, "consent_basis": gates.CONSENTS, "split": gates.SPLITS}
    out_of = "x.s < 0 OR x.e + span_longer <= x.s OR x.e + span_longer > length(text)"
    parts = [
        "SELECT scope, 'missing_field' AS rule, missing AS message FROM checked WHERE missing <> ''",
        *(f"SELECT scope, 'bad_{c}', {c} FROM checked WHERE missing = '' AND {c} NOT IN ({', '.join(repr(a) for a in values)})" for c, values in allowed.items()),
        "SELECT scope, 'bad_created', created FROM checked WHERE missing = '' AND NOT regexp_full_match(created, '[0-9]{4}-[0-9]{2}-[0-9]{2}')",
        "SELECT scope, 'span_field', '' FROM checked WHERE missing = '' AND len(found) > 0 AND (span_category IS NULL OR span_expected IS NULL)",
        f"SELECT scope, 'span_bounds', '' FROM checked WHERE missing = '' AND len(list_filter(found, lambda x: {out_of})) > 0",
        "SELECT scope, 'span_category', '' FROM checked WHERE missing = '' AND len(found) > 0 AND trim(span_category) = ''",
        "SELECT scope, 'span_expected', '' FROM checked WHERE missing = '' AND len(found) > 0 AND span_expected NOT IN ('REDACT', 'KEEP')",
        f"SELECT scope, 'span_surface', '' FROM checked WHERE missing = '' AND len(list_filter(found, lambda x: NOT ({out_of}) AND substr(text, x.s + 1, x.e + span_longer - x.s) <> x.v)) > 0",
        "SELECT '<table>', 'unexpected_field', 'line_no'",
    ]
    return f"WITH {_BANK}, checked AS (SELECT *, {_SCOPE} AS scope, {missing} AS missing FROM bank) " + " UNION ALL ".join(parts)


_CONFLICTS = "SELECT {0} AS scope, '{1}' AS rule, array_to_string(list_sort(list(DISTINCT split)), ',') AS message FROM {2} WHERE {0} IS NOT NULL AND {0} <> '' GROUP BY 1 HAVING count(DISTINCT split) > 1"
_COUNTS = """counts AS (SELECT CASE WHEN family_id LIKE 'hard-%' THEN 'contextual_hard_negative' WHEN family_id LIKE 'struct%' THEN 'structural_domain_positive' ELSE 'general_synthetic' END AS bucket,
CASE WHEN family_id LIKE 'hard-%' THEN regexp_extract(family_id, '^hard-(.*?)-f', 1) WHEN family_id LIKE 'struct%' THEN 'name-in-technical-zone' ELSE 'general-person-clean-control' END AS class,
lang, count(*) AS cases, sum(len(found))::BIGINT AS spans FROM bank WHERE split = 'dev' GROUP BY 1, 2, 3)"""
_NFKC = sql.NFKC
#: Distinct grams of n words of a canonical text; fewer words are one gram.
_WORDS = """list_filter(string_split(c, ' '), lambda w: w <> '')"""


def _grams_sql(name: str, source: str, key: str, canon: str) -> str:
    return f"""{name}_w AS (SELECT {key}, {_WORDS} AS w FROM (SELECT {key}, {canon.format("text")} AS c FROM {source})),
{name} AS (SELECT DISTINCT {key}, unnest(CASE WHEN len(w) >= 8 THEN list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i+7], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END) AS gram FROM {name}_w)"""


def _overlap_sql(canon: str) -> str:
    return f"""{_grams_sql("gd", "documents", "doc_id", canon)}, {_grams_sql("gi", "benchmark", "item_id", canon)}, shared AS (SELECT doc_id, item_id, count(*) AS shared FROM gd JOIN gi USING (gram) GROUP BY 1, 2)"""


def _signed_sql() -> str:
    """CTE signed (id, split, family, canonical, signature): spans of all common patterns masked from the right, then volatile numbers."""
    names = [("documents", "doc_id", "train", "source"), ("benchmark", "item_id", "dev", "'benchmark'")]
    base = " UNION ALL ".join(f"SELECT '{t}:' || {k} AS id, text, '{split}' AS split, {f} AS family FROM {t}" for t, k, split, f in names)
    found = [sql.spans("base", "id", p, f"m{i}") for i, (_, p, _) in enumerate(COMMON_PATTERNS)]
    union = " UNION ALL ".join(f'SELECT id, start, "end" FROM m{i}' for i in range(len(COMMON_PATTERNS)))
    # spans of a text that do not overlap are masked at once: the pieces between them, joined by the mask
    return f"""base AS MATERIALIZED (SELECT * FROM ({base}) WHERE text IS NOT NULL), {", ".join(found)},
every AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY start DESC, "end" DESC) AS k FROM ({union})),
step AS (SELECT id, text, 0::BIGINT AS k FROM base UNION ALL SELECT s.id, substr(s.text, 1, e.start) || '<SPAN>' || substr(s.text, e."end" + 1), e.k FROM step s JOIN every e ON e.id = s.id AND e.k = s.k + 1),
masked AS (SELECT id, arg_max(text, k) AS text FROM step GROUP BY id),
signed AS MATERIALIZED (SELECT b.id, b.split, b.family, {_NFKC.format("b.text")} AS canonical, {_NFKC.format(r"regexp_replace(m.text, '(?i)\b(?:syn|demo|lab|qa)-\d{{5}}-[a-z0-9]+\b', '<VOLATILE>', 'g')")} AS signature FROM base b JOIN masked m USING (id))"""


_NEAR = """sig AS (SELECT DISTINCT split, signature FROM signed),
sh AS MATERIALIZED (SELECT DISTINCT split, signature, unnest(CASE WHEN length(signature) >= 5 THEN list_transform(range(1, length(signature) - 3), lambda i: array_slice(signature, i, i + 4)) ELSE [signature] END) AS g FROM sig),
size AS (SELECT split, signature, count(*) AS n FROM sh GROUP BY 1, 2),
pair AS (SELECT d.signature AS a, t.signature AS b, count(*) AS n FROM sh d JOIN sh t USING (g) WHERE d.split = 'dev' AND t.split = 'train' GROUP BY 1, 2),
best AS (SELECT a, max(pair.n / (x.n + y.n - pair.n)::DOUBLE) AS similarity FROM pair JOIN size x ON x.split = 'dev' AND x.signature = a JOIN size y ON y.split = 'train' AND y.signature = b GROUP BY a),
near AS MATERIALIZED (SELECT id, coalesce(similarity, 0) AS similarity FROM signed LEFT JOIN best ON a = signature WHERE split = 'dev')"""

_GROUPED = """SELECT 'split-integrity' AS scope, rule, first_id || ':' || n AS message FROM (
SELECT min(id) AS first_id, count(*) AS n, CASE WHEN count(DISTINCT split) > 1 THEN 'canonical_overlap' WHEN count(*) > 1 THEN 'canonical_copies' END AS rule FROM signed GROUP BY canonical
UNION ALL SELECT min(id), count(*), CASE WHEN count(DISTINCT split) > 1 THEN 'masked_overlap' END FROM signed GROUP BY signature
UNION ALL SELECT min(id), count(*), CASE WHEN count(*) > 2 THEN 'masked_copies' END FROM signed GROUP BY signature) WHERE rule IS NOT NULL"""

ORACLES: dict[str, str] = {
    "custody_failures": f"""WITH p AS (SELECT DISTINCT {_ASKED} AS path FROM benchmark), e AS (SELECT DISTINCT {_ENTRY} AS entry FROM benchmark WHERE {_ROLE} = 'eval-only')
SELECT path AS scope, 'eval_only' AS rule, entry AS message FROM p JOIN e ON path = entry OR ends_with(path, '/' || entry)
UNION ALL SELECT path, 'unsafe_reference', '' FROM p WHERE path LIKE '/%' OR list_contains(string_split(path, '/'), '..')""",
    "epoch_failures": f"""WITH r AS (SELECT {_EPOCHS} AS e, {_STEPS} AS s, item_id % 9 = 5 AS gone FROM benchmark), n AS (SELECT *, coalesce(e::VARCHAR, '<none>') AS scope FROM r)
SELECT scope, rule, '' AS message FROM (SELECT scope, 'no_number' AS rule FROM n WHERE e IS NULL UNION ALL SELECT scope, 'beyond_end' FROM n WHERE s > 1500
UNION ALL SELECT scope, 'off_boundary' FROM n WHERE s % 50 <> 0 OR e <> s // 50 UNION ALL SELECT scope, 'no_loss' FROM n WHERE gone
UNION ALL SELECT e::VARCHAR, 'repeated' FROM n WHERE e IS NOT NULL GROUP BY e HAVING count(*) > 1
UNION ALL SELECT i::VARCHAR, 'missing' FROM range(1, 31) t(i) WHERE i NOT IN (SELECT e FROM n WHERE e IS NOT NULL))""",
    "row_validation_failures": _rows_sql().replace("AS STRING", "AS VARCHAR"),
    "quarantine_failures": f"""WITH {_BANK} SELECT {_SCOPE} AS scope, 'split_provenance' AS rule, provenance AS message FROM bank WHERE split IN ('train', 'dev') AND provenance <> 'synthetic-generated'
UNION ALL SELECT {_SCOPE}, 'repository_provenance', provenance FROM bank WHERE provenance <> 'synthetic-generated' UNION ALL {_CONFLICTS.format("family_id", "family_split", "bank")}""",
    "duplicate_ids": f"""WITH {_BANK}, f AS (SELECT id, min(line_no) AS first FROM bank GROUP BY id HAVING count(*) > 1)
SELECT id AS scope, 'duplicate_id' AS rule, first::VARCHAR AS message, line_no FROM bank JOIN f USING (id) WHERE line_no > first""",
    "family_split_conflicts": f"WITH {_BANK} {_CONFLICTS.format('family_id', 'family_split', 'bank')}",
    "power_floor_counts": f"WITH {_BANK}, {_COUNTS} SELECT * FROM counts",
    "power_floor_check": f"""WITH {_BANK}, {_COUNTS}, floors(bucket, class, lang, min_cases, min_spans) AS (VALUES {", ".join(map(str, _FLOORS))}),
b AS (SELECT f.*, coalesce(cases, 0) AS cases, coalesce(spans, 0) AS spans FROM floors f LEFT JOIN counts USING (bucket, class, lang))
SELECT bucket || '/' || class || '/' || lang AS scope, 'inconclusive' AS rule, cases || ',' || min_cases || ',' || spans || ',' || min_spans AS message FROM b WHERE cases < min_cases OR spans < min_spans""",
    "manifest_hygiene": f"""WITH e AS (SELECT {_PATH} AS p, sha256(text) AS want, {_PLACE} AS place FROM benchmark),
f AS (SELECT {_PATH} AS p, CASE WHEN item_id % 7 = 1 THEN sha256(reverse(text)) ELSE sha256(text) END AS have FROM benchmark WHERE item_id % 5 <> 4),
r AS (SELECT p, CASE WHEN place = 'attic' THEN 'unknown_class' WHEN place = 'foreign-repo' THEN 'not_checked' WHEN have IS NULL THEN CASE place WHEN 'local' THEN 'missing_local' ELSE 'missing_repo' END WHEN have <> want THEN 'hash_mismatch' ELSE 'ok' END AS rule FROM e LEFT JOIN f USING (p))
SELECT p AS path_or_ref, CASE WHEN rule IN ('ok', 'not_checked') THEN 'PASS' WHEN rule = 'missing_local' THEN 'WARN' ELSE 'FAIL' END AS verdict, rule FROM r
UNION ALL SELECT p, 'FAIL', 'colon' FROM e WHERE contains(p, ':') UNION ALL SELECT p, 'FAIL', 'user_folder' FROM e WHERE p LIKE '/Users/%' UNION ALL SELECT p, 'FAIL', 'home_folder' FROM e WHERE contains(p, '/home/')""",
    "contamination_8gram": f"WITH {_overlap_sql(sql.CANONICAL)} SELECT doc_id, item_id, shared FROM shared",
    "contamination_failures": f"WITH {_overlap_sql(_NFKC)} SELECT doc_id::VARCHAR AS scope, 'contamination' AS rule, item_id || ':' || shared AS message FROM shared UNION ALL SELECT '<evaluation>', 'empty_evaluation', 'no text to compare with' WHERE NOT EXISTS (SELECT 1 FROM benchmark WHERE trim(text) <> '')",
    "exact_duplicates": f"SELECT md5({_NFKC.format('text')}) AS signature, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "masked_signatures": f"""SELECT md5({_NFKC.format(f"regexp_replace(regexp_replace(coalesce(text, ''), '{_MASKED}', '<SPAN>', 'g'), '(?i)" + r"\b(?:syn|demo|lab|qa)-\d{{5}}-[a-z0-9]+\b" + "', '<VOLATILE>', 'g')")}) AS signature, count(*) AS n, count(DISTINCT {_BUILT["split"]}) AS splits, min(doc_id) AS first_id
FROM documents GROUP BY 1 HAVING count(*) > 2 OR count(DISTINCT {_BUILT["split"]}) > 1""",
    "nearest_jaccard": f"WITH RECURSIVE {_signed_sql()}, {_NEAR} SELECT id, floor(similarity * 1e6 + 0.5) / 1e6 AS similarity FROM near",
    "split_integrity_stats": f"""WITH RECURSIVE {_signed_sql()}, {_NEAR}, copies AS (SELECT count(*) AS n FROM signed GROUP BY signature),
ranks AS (SELECT list_sort(list(similarity)) AS v, count(*) AS n FROM near)
SELECT (SELECT count(*) FROM signed WHERE split = 'train') AS train_rows, (SELECT count(*) FROM signed WHERE split = 'dev') AS dev_rows, (SELECT count(DISTINCT canonical) FROM signed) AS canonical_distinct,
(SELECT count(*) FROM copies) AS masked_distinct, (SELECT max(n) FROM copies) AS masked_multiplicity_max, v[greatest(1, ceil(0.5 * n)::INT)] AS near_p50, v[greatest(1, ceil(0.95 * n)::INT)] AS near_p95,
v[n] AS near_max, (SELECT count(*) FROM near WHERE similarity >= 0.8) AS dev_ge_080 FROM ranks""",
    "split_integrity_failures": f"""WITH RECURSIVE {_signed_sql()}, {_NEAR} {_GROUPED}
UNION ALL {_CONFLICTS.format("family", "lineage_split", "signed")} UNION ALL SELECT id, 'near_train', format('{{:.4f}}', similarity) FROM near WHERE similarity >= 0.9
UNION ALL SELECT '<row>', 'none', '' WHERE false""",
}
ORACLES = {name: text.replace("AS STRING", "AS VARCHAR") for name, text in ORACLES.items()}
