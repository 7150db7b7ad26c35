"""Queries of sampling, schedules, training examples, the generated corpus and the run log's stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.functions.rates import percent_label
from larkspan.functions.text import canonical, escape_xml, identifier_forms, pad_left, spans, strip_space, token_count
from larkspan.operators import corpus, sampling, training
from larkspan.operators.inject import iban, luhn_digit
from larkspan.operators.metrics import certificate_id
from larkspan.operators.mock import backoff_ms, clamp_unit, pseudo_id, retry_after_ms
from larkspan.plans import sql
from larkspan.plans.detection import table
from larkspan.streaming import run_log

_SEED = 42
_TARGETS = {"base_replay": 0.50, "contextual_hard_negative": 0.25, "structural_domain_positive": 0.25}
_UPDATES, _BATCH, _ROUNDS = 60, 4, 40
#: Buckets by id, so that all three are filled whatever the sources are called.
_BUCKET = "CASE doc_id % 3 WHEN 0 THEN 'base_replay' WHEN 1 THEN 'contextual_hard_negative' ELSE 'structural_domain_positive' END"
_YEAR, _WORD = "[0-9]{4}", "[A-Z][a-z]+"
_PROFILES = 3


def seeded_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.seeded_subset(spark, 5000, 500, _SEED)


def sampled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 documents by their rank in doc_id."""
    return sampling.sample_rows(table(spark, sf_dir, "documents"), 100, _SEED, "doc_id").select("doc_id", "lang")


def picked_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each language the first 20 documents in the order of a seeded hash."""
    return sampling.pick_per_class(table(spark, sf_dir, "documents").select("doc_id", "lang"), 20, 7, "doc_id", "lang")


def deterministic_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.deterministic_pick(table(spark, sf_dir, "documents").select("doc_id", "lang"), 50, 7, "doc_id")


def checkpoint_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 40 documents of each source, and those that a prefix of 60 has more."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    small, large = (sampling.checkpoint_prefix(docs, k, "source", "doc_id") for k in (40, 60))
    shard = sampling.shard_delta(large, small, "doc_id")
    return small.withColumn("shard", F.lit(1)).unionByName(shard.withColumn("shard", F.lit(2)))


def interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.interleave(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id")


def weighted_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr(_BUCKET).alias("bucket"), token_count(F.coalesce("text", F.lit(""))).cast("long").alias("tokens"))
    return sampling.weighted_schedule(rows, _TARGETS, _UPDATES, _BATCH, _SEED)


def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interval of the mean of quality less toxicity over the labelled documents."""
    rows = sampling.ranked_within(table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") - F.col("toxic")).cast("double").alias("v")), [], ["doc_id"], "r")
    out = sampling.bootstrap_ci(rows, "v", "r", _ROUNDS, _SEED)
    return out.select(*((F.floor(F.col(c) * 1e6 + 0.5) / 1e6).alias(c) for c in ("low", "high")))


def _labelled(pattern: str, expected: str):
    return F.transform(spans(F.coalesce("text", F.lit("")), pattern), lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("PERSON").alias("category"), F.when(i % 3 == 2, expected).otherwise("REDACT").alias("expected")))


def snap_to_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four digits in a row, snapped to the tokens they lie in."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", _labelled(_YEAR, "REDACT").alias("spans"))
    return docs.select("doc_id", F.explode(training.snapped(F.coalesce("text", F.lit("")), F.col("spans"), ascii_only=True)).alias("s")).select("doc_id", *(F.col(f"s.{c}").cast("long").alias(c) for c in ("start", "end", "snapped_start", "snapped_end")))


def ner_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capitalised words as spans, every third one to keep: token counts, word spans and labels of each text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", _labelled(_WORD, "KEEP").alias("spans"))
    docs = docs.select("doc_id", training.ner_example(F.coalesce("text", F.lit("")), F.col("spans"), ascii_only=True).alias("e"))
    listed = F.array_join(F.transform("e.ner", lambda n: F.concat_ws("-", n["start"].cast("string"), n["end"].cast("string"), n["label"])), ",")
    return docs.select("doc_id", F.size("e.tokens").cast("long").alias("tokens"), F.md5(listed.cast("binary")).alias("ner_md5"), F.size("e.negatives").cast("long").alias("negatives"), "e.aligned")


def corpus_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, spans and spans whose slice is their surface, of every family of a generated corpus."""
    right = F.size(F.filter("spans", lambda s: F.substring("text", s["start"] + 1, s["end"] - s["start"]) == s["surface"]))
    return corpus.generate(spark, _PROFILES).groupBy("family_id", "split", "lang").agg(F.count("*").alias("n"), F.sum(F.size("spans")).cast("long").alias("spans"), F.sum(right).cast("long").alias("right"))


def vocab_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot words that a split of a small corpus lacks, by language."""
    rows = corpus.generate(spark, _PROFILES)
    each = [corpus.vocabulary_gaps(rows, lang).select(F.lit(lang).alias("lang"), "word", "split") for lang in ("en", "de")]
    return each[0].unionByName(each[1])


def stream_run_log_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a file stream: deduplicated, counted by day and type."""
    stream = run_log.read_log(spark, sf_dir, "event_id long, ts timestamp_ntz, event_type string, value double", "events.parquet")
    kept = run_log.deduplicated(stream, "event_id")
    out = run_log.replay(run_log.windowed(kept, ["event_type"], "value"), "run-log")
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", (F.floor(F.col("total") * 100 + 0.5) / 100).alias("total"))


def last_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user, kept by merging batches of the stream."""
    from larkspan.session import scratch_path

    path = scratch_path(spark, "state")
    stream = run_log.read_log(spark, sf_dir, "event_id long, ts timestamp_ntz, user_id long, event_type string", "events.parquet")
    run_log.upsert_last(stream, f"{path}/rows", "user_id", "event_id", f"{path}/state")
    return spark.read.parquet(f"{path}/rows/v0").select("user_id", "event_id", "event_type")


def text_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar functions over documents: canonical and stripped text, XML escapes, tokens, padded and labelled numbers."""
    text = F.coalesce("text", F.lit(""))
    md5 = lambda c: F.md5(c.cast("binary"))
    label = percent_label(F.col("doc_id") / 8.0)
    return table(spark, sf_dir, "documents").select("doc_id", md5(canonical(text)).alias("canonical_md5"), md5(strip_space(text)).alias("stripped_md5"), md5(escape_xml(text)).alias("xml_md5"), token_count(text).cast("long").alias("tokens"), pad_left(F.col("doc_id"), 3).alias("padded"), label.alias("label"))


def number_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check digits, clamped rates, pauses between tries, pseudo ids and the last part of an address, over a range of numbers."""
    k = F.col("k")
    body = F.lpad((k * 7919).cast("string"), 15, "4")
    grid = spark.range(1, 400).select(F.col("id").alias("k"))
    return grid.select(
        "k",
        luhn_digit(body).alias("luhn"),
        iban(F.lpad((k * 104729).cast("string"), 18, "1")).alias("iban"),
        clamp_unit((k - 100) / 150.0).alias("clamped"),
        backoff_ms(F.pmod(k, F.lit(5)) + 1, k / 1000.0).cast("long").alias("backoff"),
        retry_after_ms(F.concat(k.cast("string"), F.when(k % 7 == 0, " s").otherwise("")), F.lit(0).cast("timestamp")).cast("long").alias("retry"),
        F.length(pseudo_id(k)).alias("id_length"),
        certificate_id(F.concat(F.lit("https://a.example/certificate/c"), k.cast("string"), F.when(k % 2 == 0, "//").otherwise(""))).alias("certificate"),
        identifier_forms(F.concat(F.lit("Grün Straße "), F.element_at(F.array(F.lit("Nord"), F.lit("öst")), F.pmod(k, F.lit(2)).cast("int") + 1))).alias("f"),
    ).select("*", "f.snake", "f.camel", "f.dotted").drop("f")


QUERIES = {
    f.__name__: f
    for f in (
        seeded_subset, sampled_documents, picked_per_class, deterministic_pick, checkpoint_prefixes, interleave, weighted_schedule, bootstrap_ci, snap_to_tokens,
        ner_examples, corpus_families, vocab_coverage, stream_run_log_metrics, last_per_user, text_scalars, number_scalars,
    )
}


def _drawn(n: int, grid: str = "SELECT i AS k FROM range(1, {0}) t(i)") -> str:
    """CTE drawn (k, r): draws 1 to n of the seed."""
    return f"grid AS ({grid.format(n + 1)}), {sql.draws('grid', str(_SEED), 'k', 'k')}"


def _subset(n: str, k: int) -> str:
    return f"{_drawn(100_000)}, firsts AS (SELECT floor(r * {n})::BIGINT AS index, min(k) AS k FROM drawn GROUP BY 1), subset AS (SELECT index FROM firsts ORDER BY k LIMIT {k})"


def _schedule_sql() -> str:
    names = list(_TARGETS)
    agg = ", ".join(f"any_value(t) FILTER (WHERE bucket = '{b}') AS t{i}" for i, b in enumerate(names))
    p = [f"(u{i} / {max(_TARGETS[b] * _UPDATES, 1.0)}::DOUBLE + s{i} / greatest({_TARGETS[b]}::DOUBLE * planned, 1.0)) / 2" for i, b in enumerate(names)]
    choice = f"CASE WHEN {p[0]} <= {p[1]} AND {p[0]} <= {p[2]} THEN 0 WHEN {p[1]} <= {p[2]} THEN 1 ELSE 2 END"
    planned = " + ".join(f"max(mean) FILTER (WHERE bucket = '{b}') * {w}::DOUBLE" for b, w in _TARGETS.items())
    return f"""WITH RECURSIVE rows AS (SELECT doc_id, {_BUCKET} AS bucket, greatest(1, len(regexp_extract_all(coalesce(text, ''), '\\S+')))::BIGINT AS tokens FROM documents),
ranked AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY doc_id) - 1 AS rk, count(*) OVER (PARTITION BY bucket) AS n FROM rows),
means AS (SELECT bucket, avg(tokens) AS mean, count(*) AS n FROM rows GROUP BY bucket), plan AS (SELECT ({planned}) * {_UPDATES} * {_BATCH} AS planned FROM means),
{_drawn(_UPDATES * _BATCH)}, picks AS MATERIALIZED (SELECT (k - 1) // {_BATCH} AS step, (k - 1) % {_BATCH} AS slot, m.bucket, x.doc_id, x.tokens FROM drawn CROSS JOIN means m JOIN ranked x ON x.bucket = m.bucket AND x.rk = floor(r * m.n)),
sums AS (SELECT step, bucket, sum(tokens) AS t FROM picks GROUP BY 1, 2), wide AS MATERIALIZED (SELECT step, {agg} FROM sums GROUP BY step),
fold AS (SELECT 0::BIGINT AS step, -1 AS c, 0::BIGINT AS u0, 0::BIGINT AS u1, 0::BIGINT AS u2, 0::HUGEINT AS s0, 0::HUGEINT AS s1, 0::HUGEINT AS s2
UNION ALL SELECT f.step + 1, c, u0 + (c = 0)::INT, u1 + (c = 1)::INT, u2 + (c = 2)::INT, s0 + CASE WHEN c = 0 THEN t0 ELSE 0 END, s1 + CASE WHEN c = 1 THEN t1 ELSE 0 END, s2 + CASE WHEN c = 2 THEN t2 ELSE 0 END
FROM (SELECT fold.* EXCLUDE (c), w.t0, w.t1, w.t2, {choice} AS c FROM fold JOIN wide w USING (step) CROSS JOIN plan) f)
SELECT picks.step, slot, bucket, doc_id, tokens FROM picks JOIN fold ON fold.step = picks.step + 1 AND bucket = [{", ".join(repr(n) for n in names)}][c + 1]"""


_TOKENS = "[A-Za-z0-9_]+|[^A-Za-z0-9_" + chr(92) + "s]"


def _vocabulary_sql() -> str:
    """Slot words that no row's profile gives, from the numbers of every class and half."""
    size, parts = corpus.FRAMES, []
    for lang in ("en", "de"):
        base = 1
        for words in corpus._SLOTS[lang]:
            parts.append(f"SELECT '{lang}' AS lang, split, ([{', '.join(repr(w) for w in words)}])[(n // {base}) % {len(words)} + 1] AS word FROM numbers")
            base *= len(words)
    every = ", ".join(f"('{lang}', '{w}')" for lang in ("en", "de") for w in sorted({w for words in corpus._SLOTS[lang] for w in words}))
    return f"""WITH g AS (SELECT i % {size} AS frame, ((i // {size}) * {size} + i % {size}) * {corpus.STRIDE} % {corpus.PROFILES} AS n FROM range({size * _PROFILES}) t(i)),
numbers AS (SELECT CASE WHEN frame >= {size - corpus.DEV_FRAMES} THEN 'dev' ELSE 'train' END AS split, unnest([n, n + 7919]) AS n FROM g),
have AS ({" UNION ".join(parts)}), want(lang, word) AS (VALUES {every})
SELECT want.lang, want.word, s.split FROM want CROSS JOIN (VALUES ('train'), ('dev')) s(split) ANTI JOIN have ON have.lang = want.lang AND have.word = want.word AND have.split = s.split"""


def _families_sql() -> str:
    kinds = [(f"hard-{c}", "de" if c.startswith("de-") else "en", 2) for c in corpus._CLASSES] + [(f"{k}-{lang}", lang, n) for k, n in (("struct", 2), ("general", 1)) for lang in ("en", "de")]
    values = ", ".join(f"('{a}', '{b}', {n})" for a, b, n in kinds)
    return f"""SELECT format('{{}}-f{{:02d}}-p{{:04d}}', kind, f, p) AS family_id, CASE WHEN f >= {corpus.FRAMES - corpus.DEV_FRAMES} THEN 'dev' ELSE 'train' END AS split, lang, 2 AS n, s AS spans, s AS "right"
FROM (VALUES {values}) AS v(kind, lang, s) CROSS JOIN range({corpus.FRAMES}) a(f) CROSS JOIN range({_PROFILES}) b(p)"""


ORACLES: dict[str, str] = {
    "seeded_subset": f"WITH {_subset('5000', 500)} SELECT index FROM subset",
    "sampled_documents": f"WITH {_subset('(SELECT count(*) FROM documents)', 100)}, d AS (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) - 1 AS rk FROM documents) SELECT doc_id, lang FROM d JOIN subset ON rk = index",
    "picked_per_class": "SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('7:' || doc_id), doc_id) <= 20",
    "deterministic_pick": "SELECT doc_id, lang FROM documents ORDER BY md5('7:' || doc_id) LIMIT 50",
    "checkpoint_prefixes": "SELECT doc_id, source, CASE WHEN rk <= 40 THEN 1 ELSE 2 END AS shard FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rk FROM documents) WHERE rk <= 60",
    "interleave": "WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS round FROM documents) SELECT * FROM r WHERE round <= (SELECT min(n) FROM (SELECT count(*) AS n FROM documents GROUP BY lang))",
    "weighted_schedule": _schedule_sql(),
    "bootstrap_ci": f"""WITH v AS (SELECT (quality - toxic)::DOUBLE AS v, row_number() OVER (ORDER BY doc_id) - 1 AS rk FROM labels), n AS (SELECT count(*) AS n FROM labels),
{_drawn(0, "SELECT unnest(range(1, {0} * 0 + " + str(_ROUNDS) + " * n + 1)) AS k FROM n")}, m AS (SELECT (k - 1) // n AS round, avg(v) AS m FROM drawn CROSS JOIN n JOIN v ON rk = floor(r * n) GROUP BY 1), s AS (SELECT list_sort(list(m)) AS m FROM m)
SELECT floor(m[{int(0.025 * _ROUNDS) + 1}] * 1e6 + 0.5) / 1e6 AS low, floor(m[{min(_ROUNDS - 1, int(0.975 * _ROUNDS)) + 1}] * 1e6 + 0.5) / 1e6 AS high FROM s""",
    "snap_to_tokens": f"""WITH {sql.spans("documents", "doc_id", _YEAR, "y")}, {sql.spans("documents", "doc_id", _TOKENS, "tk")}
SELECT y.doc_id, y.start, y."end", min(t.start) AS snapped_start, max(t."end") AS snapped_end FROM y JOIN tk t ON t.doc_id = y.doc_id AND t.start < y."end" AND t."end" > y.start GROUP BY y.doc_id, y.start, y."end\"""",
    "ner_examples": f"""WITH {sql.spans("documents", "doc_id", _WORD, "w")}, {sql.spans("documents", "doc_id", _TOKENS, "tk")},
f AS (SELECT w.doc_id, w.ordinal, w.ordinal % 3 = 2 AS keep, a.ordinal AS a, b.ordinal AS b FROM w LEFT JOIN tk a ON a.doc_id = w.doc_id AND a.start = w.start LEFT JOIN tk b ON b.doc_id = w.doc_id AND b."end" = w."end"),
e AS (SELECT doc_id, string_agg(CASE WHEN NOT keep AND a IS NOT NULL AND b IS NOT NULL THEN a || '-' || b || '-person' END, ',' ORDER BY ordinal) AS ner, bool_or(keep)::BIGINT AS negatives, bool_and(a IS NOT NULL AND b IS NOT NULL) AS aligned FROM f GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS tokens FROM tk GROUP BY doc_id)
SELECT d.doc_id, coalesce(tokens, 0) AS tokens, md5(coalesce(ner, '')) AS ner_md5, coalesce(negatives, 0) AS negatives, coalesce(aligned, true) AS aligned FROM documents d LEFT JOIN e USING (doc_id) LEFT JOIN c USING (doc_id)""",
    "corpus_families": _families_sql(),
    "vocab_coverage": _vocabulary_sql(),
    "stream_run_log_metrics": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, floor(sum(value) * 100 + 0.5) / 100 AS total FROM (SELECT DISTINCT ON (event_id) * FROM events) GROUP BY 1, 2",
    "last_per_user": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id",
    "text_scalars": f"""SELECT doc_id, md5({sql.CANONICAL.format("t")}) AS canonical_md5, md5(regexp_replace(t, '^\\s+|\\s+$', '', 'g')) AS stripped_md5,
md5(replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;')) AS xml_md5,
greatest(1, len(regexp_extract_all(t, '\\S+')))::BIGINT AS tokens, CASE WHEN doc_id < 1000 THEN lpad(doc_id::VARCHAR, 3, '0') ELSE doc_id::VARCHAR END AS padded, format('{{:.1f}}%', floor(doc_id / 8.0::DOUBLE * 10 + 0.5) / 10) AS label FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""",
    "number_scalars": f"""WITH g AS (SELECT k, lpad((k * 7919)::VARCHAR, 15, '4') AS body, lpad((k * 104729)::VARCHAR, 18, '1') AS bank, k::VARCHAR AS t FROM range(1, 400) r(k)),
d AS (SELECT *, list_sum(list_transform(range(1, 16), lambda i: CASE WHEN i % 2 = 0 THEN body[i]::INT WHEN body[i]::INT * 2 > 9 THEN body[i]::INT * 2 - 9 ELSE body[i]::INT * 2 END)) AS s FROM g)
SELECT k, ((10 - s % 10) % 10)::BIGINT::VARCHAR AS luhn, 'DE' || lpad((98 - ((bank || '131400')::HUGEINT % 97))::VARCHAR, 2, '0') || bank AS iban, least(greatest((k - 100) / 150.0::DOUBLE, 0), 1) AS clamped,
floor(500 * pow(2, k % 5) + k / 1000.0::DOUBLE * 250)::BIGINT AS backoff, CASE WHEN k % 7 <> 0 THEN k * 1000 END AS retry, 32 AS id_length, 'c' || k AS certificate,
CASE WHEN k % 2 = 0 THEN 'gruen_strasse_nord' ELSE 'gruen_strasse_oest' END AS snake, CASE WHEN k % 2 = 0 THEN 'gruenStrasseNord' ELSE 'gruenStrasseOest' END AS camel, CASE WHEN k % 2 = 0 THEN 'gruen.strasse.nord' ELSE 'gruen.strasse.oest' END AS dotted FROM d""",
}
