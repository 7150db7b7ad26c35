"""Corpus gates: each takes rows and returns failures (scope, rule, message); no failure passes.

A gate that has nothing to check against fails: every one with an evaluation
side adds an explicit row for an empty side. Texts are compared in the NFKC,
case-folded form; `canonical` may be given for texts known to be NFKC.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.functions.bind import settled
from larkspan.functions.text import canonical_unicode, masked_text, word_ngrams
from larkspan.operators.nearest import nearest, parts_of
from larkspan.session import materialize

# fixed values: closed vocabularies of a row
LANGS = ("en", "de")
ZONES = ("prose", "json_value", "json_key", "schema_label", "technical_id", "url", "code_identifier", "comment", "string_literal")
PROVENANCES = ("synthetic-generated", "measured-live", "dogfood", "eval-import")
CONSENTS = ("synthetic", "own-data", "contracted", "public-corpus")
SPLITS = ("train", "dev", "eval-only")
EXPECTED = ("REDACT", "KEEP")
SYNTHETIC = "synthetic-generated"
FIELDS = ("id", "text", "lang", "zone", "spans", "org_id", "provenance", "consent_basis", "split", "family_id", "source", "created", "template_lineage")

SPAN_FIELDS = ("start", "end", "category", "expected", "surface")

NEAR_CEILING, NEAR_TAIL, MASKED_COPIES = 0.90, 0.80, 2


def _explode_failures(rows: DataFrame, scope: Column, checks: list[tuple[str, Column, Column]]) -> DataFrame:
    found = F.array(*(F.when(bad, F.struct(F.lit(rule).alias("rule"), message.alias("message"))) for rule, bad, message in checks))
    return rows.select(scope.alias("scope"), F.explode(F.filter(found, lambda f: f.isNotNull())).alias("f")).select("scope", "f.rule", "f.message")


def unexpected_fields(rows: DataFrame, allowed: tuple[str, ...] = ()) -> DataFrame:
    """A failure for each column that a row, and each field that a span, must not have; `allowed` columns aside."""
    names = [(c, "unexpected_field") for c in rows.columns if c not in (*FIELDS, *allowed)]
    if "spans" in rows.columns:
        names += [(f"spans.{c}", "unexpected_span_field") for c in rows.schema["spans"].dataType.elementType.names if c not in SPAN_FIELDS]
    return rows.sparkSession.createDataFrame([("<table>", rule, name) for name, rule in names], "scope string, rule string, message string")


def row_failures(rows: DataFrame) -> DataFrame:
    """Every failure of every row: missing fields alone, where there are any; else enumerations, date and spans.

    Fields that a table must not have are unexpected_fields()' part, and
    read_jsonl's with closed=True for lines.
    """
    missing = F.array_join(F.array_compact(F.array(*(F.when(F.col(f).isNull(), f) for f in FIELDS))), ",")
    whole = missing == ""
    text = F.col("text")
    one_of = lambda c, allowed: whole & ~F.col(c).isin(*allowed)
    bounds = lambda s: (s["start"] < 0) | (s["end"] <= s["start"]) | (s["end"] > F.length(text))
    some = lambda test: whole & F.exists("spans", test)
    null_part = lambda s: s["start"].isNull() | s["end"].isNull() | s["category"].isNull() | s["expected"].isNull() | s["surface"].isNull()
    say = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    checks = [
        ("missing_field", ~whole, missing),
        *((f"bad_{c}", one_of(c, allowed), say(c)) for c, allowed in (("lang", LANGS), ("zone", ZONES), ("provenance", PROVENANCES), ("consent_basis", CONSENTS), ("split", SPLITS))),
        ("bad_created", whole & ~F.col("created").rlike(r"^\d{4}-\d{2}-\d{2}$"), say("created")),
        ("span_field", some(null_part), F.lit("")),
        ("span_bounds", some(lambda s: F.coalesce(bounds(s), F.lit(False))), F.lit("")),
        ("span_category", some(lambda s: F.coalesce(F.trim(s["category"]) == "", F.lit(False))), F.lit("")),
        ("span_expected", some(lambda s: F.coalesce(~s["expected"].isin(*EXPECTED), F.lit(False))), F.lit("")),
        ("span_surface", some(lambda s: F.coalesce(~bounds(s) & (F.substring(text, s["start"] + 1, s["end"] - s["start"]) != s["surface"]), F.lit(False))), F.lit("")),
    ]
    return _explode_failures(rows, F.coalesce(F.col("id"), F.lit("<no-id>")), checks)


def quarantine_failures(rows: DataFrame) -> DataFrame:
    """Rows of train or dev, and all rows kept in the repository, must be synthetic; a family has one split."""
    stranger = ~F.col("provenance").eqNullSafe(F.lit(SYNTHETIC))
    checks = [
        ("split_provenance", F.col("split").isin("train", "dev") & stranger, F.coalesce("provenance", F.lit(""))),
        ("repository_provenance", stranger, F.coalesce("provenance", F.lit(""))),
    ]
    return _explode_failures(rows, F.coalesce(F.col("id"), F.lit("<no-id>")), checks).unionByName(family_conflicts(rows))


def family_conflicts(rows: DataFrame, key: str = "family_id", rule: str = "family_split") -> DataFrame:
    """Keys whose rows lie in several splits."""
    splits = rows.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(F.sort_array(F.collect_set("split")).alias("s"))
    return splits.where(F.size("s") > 1).select(F.col(key).cast("string").alias("scope"), F.lit(rule).alias("rule"), F.array_join("s", ",").alias("message"))


def duplicate_ids(rows: DataFrame, order_col: str = "line_no") -> DataFrame:
    """Each later row of an id, with the first one's line."""
    firsts = rows.groupBy("id").agg(F.min(order_col).alias("first"), F.count("*").alias("n")).where("n > 1")
    return rows.join(firsts, "id").where(F.col(order_col) > F.col("first")).select(F.col("id").alias("scope"), F.lit("duplicate_id").alias("rule"), F.col("first").cast("string").alias("message"), F.col(order_col))


def path_hygiene(entries: DataFrame, path_col: str = "path_or_ref", home: str = "/home/") -> DataFrame:
    """Paths that give away where they were: a colon, a user folder, the home folder."""
    p = F.col(path_col)
    checks = [("colon", F.contains(p, F.lit(":")), p), ("user_folder", p.rlike("^/Users(/|$)"), p), ("home_folder", F.contains(p, F.lit(home)), p)]
    return _explode_failures(entries, p, checks)


def manifest_failures(entries: DataFrame, files: DataFrame) -> DataFrame:
    """entries (path_or_ref, sha256, location_class) against files (path, sha256): (path, verdict, rule)."""
    found = entries.join(files.select(F.col("path").alias("path_or_ref"), F.col("sha256").alias("have")), "path_or_ref", "left")
    place, have = F.col("location_class"), F.col("have")
    rule = (
        F.when(~place.isin("local", "repo", "foreign-repo"), "unknown_class")
        .when(place == "foreign-repo", "not_checked")
        .when(have.isNull(), F.when(place == "local", "missing_local").otherwise("missing_repo"))
        .when(have != F.col("sha256"), "hash_mismatch")
        .otherwise("ok")
    )
    verdict = F.when(F.col("rule").isin("ok", "not_checked"), "PASS").when(F.col("rule") == "missing_local", "WARN").otherwise("FAIL")
    return found.withColumn("rule", rule).select("path_or_ref", verdict.alias("verdict"), "rule")


def ngram_overlap(docs: DataFrame, items: DataFrame, n: int = 8, id_col: str = "doc_id", item_col: str = "item_id", canon=canonical_unicode) -> DataFrame:
    """(id, item, shared): distinct canonical word n-grams that a text and an item share, where there are any.

    Grams are joined by their 64-bit hash and text; the small side is
    broadcast by the optimizer where its size allows. A text of fewer words
    is one gram.
    """
    grams = lambda df, key: df.select(key, canon(F.col("text")).alias("c")).select(key, F.explode(word_ngrams(F.col("c"), n)).alias("gram"))
    return grams(docs, id_col).join(grams(items, item_col), "gram").groupBy(id_col, item_col).agg(F.count("*").alias("shared"))


def contamination_failures(docs: DataFrame, items: DataFrame, n: int = 8, canon=canonical_unicode) -> DataFrame:
    """One failure for each pair that shares a gram; one for an evaluation side without text."""
    hits = ngram_overlap(docs, items, n, canon=canon).select(F.col("doc_id").cast("string").alias("scope"), F.lit("contamination").alias("rule"), F.concat_ws(":", F.col("item_id").cast("string"), F.col("shared").cast("string")).alias("message"))
    filled = items.select(canon(F.col("text")).alias("c")).agg(F.count_if(F.length("c") > 0).alias("n"))
    empty = filled.where("n = 0").select(F.lit("<evaluation>").alias("scope"), F.lit("empty_evaluation").alias("rule"), F.lit("no text to compare with").alias("message"))
    return hits.unionByName(empty)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", canon=canonical_unicode) -> DataFrame:
    """(signature, n, first_id): canonical texts that occur more than once."""
    return docs.withColumn("signature", F.md5(canon(F.col("text")).cast("binary"))).groupBy("signature").agg(F.count("*").alias("n"), F.min(id_col).alias("first_id")).where("n > 1")


def masked_signatures(docs: DataFrame, spans_col: str, split_col: str = "split", id_col: str = "doc_id", canon=canonical_unicode) -> DataFrame:
    """(signature, n, splits): masked texts that occur too often or in several splits."""
    masked = settled(docs.select(id_col, split_col, "text", spans_col), "__masked", masked_text(F.col("text"), F.col(spans_col)))
    signed = masked.select(id_col, split_col, F.md5(canon(F.col("__masked")).cast("binary")).alias("signature"))
    grouped = signed.groupBy("signature").agg(F.count("*").alias("n"), F.countDistinct(split_col).alias("splits"), F.min(id_col).alias("first_id"))
    return grouped.where((F.col("n") > MASKED_COPIES) | (F.col("splits") > 1))


def nearest_jaccard(dev: DataFrame, train: DataFrame, n: int = 5, id_col: str = "id", signature_col: str = "signature") -> DataFrame:
    """(id, similarity): for each row of dev, the greatest Jaccard similarity of its signature's shingles with any train signature's, 0 if none shares one.

    Exact and whole: shared shingles of all distinct dev signatures with every
    train signature are counted, in the task that reads the latter. Dev is
    read several times, train once, or written first if dev takes several
    parts. Two empty signatures are alike. Null signatures take no part.
    """
    key = F.unhex(F.md5(F.col(signature_col).cast("binary")))
    rows = dev.where(F.col(signature_col).isNotNull()).withColumn("key", key)
    few = rows.groupBy("key").agg(F.first(signature_col).alias("text"))
    many = train.select(signature_col)
    parts = parts_of(few)
    best = nearest(few, materialize(many, "near") if parts > 1 else many, n, parts)
    return rows.select(id_col, "key").join(best, "key", "left").select(id_col, F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def signatures(rows: DataFrame, canon=canonical_unicode) -> DataFrame:
    """The rows of train and dev with their masked signature, none where a span does not lie in the text."""
    off = lambda s: s["start"].isNull() | s["end"].isNull() | (s["start"] < 0) | (s["end"] <= s["start"]) | (s["end"] > F.length("text"))
    right = F.col("text").isNotNull() & F.col("spans").isNotNull() & ~F.coalesce(F.exists("spans", off), F.lit(False))
    out = rows.where(F.col("split").isin("train", "dev"))
    out = settled(out, "__masked", F.when(right, masked_text(F.col("text"), F.when(right, F.col("spans")))))
    return out.withColumn("signature", canon(F.col("__masked"))).drop("__masked")


def signed_rows(rows: DataFrame, canon=canonical_unicode) -> DataFrame:
    """The rows of signatures() with no_text, and the digests canonical (of the canonical text) and masked (of the signature) in place of text and spans.

    Written to the shared folder, since the gate reads it many times and each
    reading would mask and normalise all texts anew. Of a row's texts only the
    signature is written.
    """
    digest = lambda c: F.md5(c.cast("binary"))
    out = signatures(rows, canon).withColumns({"no_text": F.col("text").isNull(), "canonical": digest(canon(F.col("text"))), "masked": digest(F.col("signature"))})
    return materialize(out.drop("text", "spans"), "signed")


def _sides(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    return signed.where("split = 'dev'"), signed.where("split = 'train'")


def split_integrity_failures(signed: DataFrame) -> DataFrame:
    """Failures of rows of signed_rows (of id, text, spans, split, family_id, template_lineage).

    An empty side; texts and masked signatures repeated or in both splits;
    lineages in both splits or missing; fewer signatures than families; and
    dev rows whose nearest masked train signature reaches NEAR_CEILING.
    """
    whole = F.lit("split-integrity")
    name = F.coalesce(F.col("id").cast("string"), F.lit("<no-id>"))
    lineage = F.coalesce("template_lineage", F.lit(""))
    has = F.col("masked").isNotNull()
    each = _explode_failures(
        signed,
        name,
        [("no_text", F.col("no_text"), F.lit("")), ("masked_signature", ~F.col("no_text") & ~has, F.lit("")), ("missing_lineage", has & (lineage == ""), F.lit(""))],
    )
    totals = signed.agg(
        F.count_if(F.col("split") == "train").alias("train"),
        F.count_if(F.col("split") == "dev").alias("dev"),
        F.countDistinct("masked").alias("signatures"),
        F.countDistinct(F.when(has & (F.col("family_id") != ""), F.col("family_id"))).alias("families"),
    )
    refuse = F.lit("refusing to pass fail-open")
    corpus = _explode_failures(
        totals,
        whole,
        [("empty_train", F.col("train") == 0, refuse), ("empty_dev", F.col("dev") == 0, refuse), ("masked_diversity", F.col("signatures") < F.col("families"), F.concat_ws("<", "signatures", "families"))],
    )

    def groups(col: str) -> DataFrame:
        """(first_id, n, splits) of each value of a column."""
        by = signed.where(F.col(col).isNotNull()).groupBy(col)
        return by.agg(F.count("*").alias("n"), F.countDistinct("split").alias("splits"), F.min(name).alias("first_id"))

    many = F.concat_ws(":", "first_id", "n")
    copies = _explode_failures(groups("canonical"), whole, [("canonical_overlap", F.col("splits") > 1, many), ("canonical_copies", (F.col("n") > 1) & (F.col("splits") == 1), many)])
    masked = _explode_failures(groups("masked"), whole, [("masked_overlap", F.col("splits") > 1, many), ("masked_copies", F.col("n") > MASKED_COPIES, many)])
    crossing = family_conflicts(signed.where(has), "template_lineage", "lineage_split")
    near = nearest_jaccard(*_sides(signed)).where(F.col("similarity") >= NEAR_CEILING)
    near = near.select(name.alias("scope"), F.lit("near_train").alias("rule"), F.format_number("similarity", 4).alias("message"))
    return gate(each, corpus, copies, masked, crossing, near)


def split_integrity_stats(signed: DataFrame) -> DataFrame:
    """One row: rows of each side, distinct texts and signatures, most copies of one, and the nearest similarities of all dev rows."""
    sums = signed.agg(F.count_if(F.col("split") == "train").alias("train_rows"), F.count_if(F.col("split") == "dev").alias("dev_rows"), F.countDistinct("canonical").alias("canonical_distinct"))
    masked = signed.where("masked is not null").groupBy("masked").count().agg(F.count("*").alias("masked_distinct"), F.coalesce(F.max("count"), F.lit(0)).alias("masked_multiplicity_max"))
    at = lambda p: F.coalesce(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY similarity)"), F.lit(0.0))
    near = nearest_jaccard(*_sides(signed)).agg(at(0.5).alias("near_p50"), at(0.95).alias("near_p95"), F.coalesce(F.max("similarity"), F.lit(0.0)).alias("near_max"), F.count_if(F.col("similarity") >= NEAR_TAIL).alias("dev_ge_080"))
    return sums.crossJoin(masked).crossJoin(near)


def power_floor_failures(floors: DataFrame, counts: DataFrame) -> DataFrame:
    """floors (bucket, class, lang, min_cases, min_spans) that the counts (.., cases, spans) do not reach."""
    both = floors.join(counts, ["bucket", "class", "lang"], "left").withColumns({"cases": F.coalesce("cases", F.lit(0)), "spans": F.coalesce("spans", F.lit(0))})
    short = both.where("cases < min_cases or spans < min_spans")
    return short.select(F.concat_ws("/", "bucket", "class", "lang").alias("scope"), F.lit("inconclusive").alias("rule"), F.concat_ws(",", "cases", "min_cases", "spans", "min_spans").alias("message"))


def bucket_of(family: Column) -> Column:
    return F.when(F.startswith(family, F.lit("hard-")), "contextual_hard_negative").when(F.startswith(family, F.lit("struct")), "structural_domain_positive").otherwise("general_synthetic")


def class_of(family: Column) -> Column:
    """The class of a family id: what stands before the first `-f`, the bucket's own word aside."""
    hard = F.regexp_replace(F.substring_index(family, "-f", 1), "^hard-", "")
    return F.when(F.startswith(family, F.lit("hard-")), hard).when(F.startswith(family, F.lit("struct")), "name-in-technical-zone").otherwise("general-person-clean-control")


def dev_counts(rows: DataFrame) -> DataFrame:
    """(bucket, class, lang, cases, spans) of the dev split."""
    family = F.col("family_id")
    return rows.where("split = 'dev'").groupBy(bucket_of(family).alias("bucket"), class_of(family).alias("class"), "lang").agg(F.count("*").alias("cases"), F.sum(F.size("spans")).cast("long").alias("spans"))


def gate(*failures: DataFrame) -> DataFrame:
    """All failures of several gates, (scope, rule, message)."""
    return reduce(DataFrame.unionByName, (f.select("scope", "rule", "message") for f in failures))
