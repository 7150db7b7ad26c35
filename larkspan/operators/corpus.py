"""Contrast-pair corpus generation: frames x profiles x slots, as relations. All wording is this module's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.functions.text import identifier_forms
from larkspan.session import materialize

ROWS_A_FAMILY, FRAMES, DEV_FRAMES = 2, 20, 4
#: Profile numbers go round the product of the slots' sizes in steps of this, prime to it, so few profiles reach every word.
STRIDE, PROFILES = 12347, 11 * 13 * 17 * 19

_SLOTS = {
    "en": (
        "intake triage planning drafting review rollout handover closing audit renewal archive".split(),
        "ledger memo ticket plan sheet form notice record draft roster log invoice brief".split(),
        "dual single sampled weekly remote strict open sealed paired timed signed shared staged plain late early joint".split(),
        "desk portal phone courier kiosk bridge window counter hall lab dock gate yard room board line tower annex post".split(),
    ),
    "de": (
        "Eingang Sichtung Planung Entwurf Pruefung Start Uebergabe Abschluss Revision Verlaengerung Ablage".split(),
        "Bericht Vermerk Auftrag Plan Bogen Antrag Hinweis Beleg Entwurf Dienstplan Eintrag Bescheid Auszug".split(),
        "doppelt einfach stichprobenartig woechentlich fern streng offen versiegelt paarweise befristet signiert geteilt gestuft schlicht spaet frueh gemeinsam".split(),
        "Schalter Portal Telefon Kurier Terminal Bruecke Fenster Tresen Halle Labor Rampe Tor Hof Raum Gremium Leitung Turm Anbau Posten".split(),
    ),
}
_PEOPLE = "Amelie Brandt,Jonas Keil,Carla Weston,Piotr Malik,Helen Ashby,Tomas Lind,Mira Sandoval,Egon Fuchs".split(",")
_CLASSES = {
    "location": ("the Harbour team", "Harbour", "a visit to Harbour on Monday"),
    "region": ("the Northern office", "Northern", "a courier from Northern, her home"),
    "role": ("the duty Warden", "Warden", "a note from Mr Warden"),
    "vendor": ("a Baxter pump", "Baxter", "a call from Ms Baxter"),
    "de-function": ("der Pfoertner vom Dienst", "Pfoertner", "ein Gruss von Frau Pfoertner"),
}
_ZONES = ("json_value", "code_identifier", "technical_id", "schema_label")


def semantic_profile(number: Column, lang: str) -> list[Column]:
    """Four slot words of a profile number, its digits in the mixed radix of the slot lists."""
    out, rest = [], number
    for words in _SLOTS[lang]:
        out.append(F.get(F.array(*(F.lit(w) for w in words)), F.pmod(rest, F.lit(len(words))).cast("int")))
        rest = F.floor(rest / len(words))
    return out


def profile_sentence(number: Column, lang: str) -> Column:
    form = "Beim Schritt %s gilt fuer %s die Regel %s am %s." if lang == "de" else "At %s the %s is kept %s by the %s."
    return F.format_string(form, *semantic_profile(number, lang))


def contextualize(text: Column, zone: Column, number: Column, lang: str) -> Column:
    """The text with its profile, in the zone's own form."""
    a, b, c, d = semantic_profile(number, lang)
    json_form = F.concat(F.regexp_replace(text, r"\}$", ""), F.format_string(',"step":"%s","item":"%s","rule":"%s","place":"%s"}', a, b, c, d))
    return (
        F.when((zone == "json_value") & F.endswith(text, F.lit("}")), json_form)
        .when(zone == "technical_id", F.concat(text, F.format_string(" step=%s item=%s rule=%s place=%s", a, b, c, d)))
        .when(zone == "code_identifier", F.concat(text, F.format_string("\n// %s, %s, %s, %s", a, b, c, d)))
        .when(zone == "schema_label", F.concat(text, F.format_string("; step=%s; item=%s; rule=%s; place=%s", a, b, c, d)))
        .otherwise(F.concat(text, F.lit(" "), profile_sentence(number, lang)))
    )


def first_span(text: Column, surface: Column, expected: Column, category: Column) -> Column:
    """The span of a surface's first occurrence; a surface that is absent is an error."""
    at = F.instr(text, surface) - 1
    start = F.when(at >= 0, at).otherwise(F.raise_error(F.concat(F.lit("surface absent: "), surface)).cast("int"))
    return F.struct(start.alias("start"), (start + F.length(surface)).alias("end"), category.alias("category"), expected.alias("expected"), surface.alias("surface"))


def _finish(rows: DataFrame) -> DataFrame:
    """The 13 fields of a row."""
    lineage = F.concat_ws("-", "family_class", F.lpad(F.col("frame").cast("string"), 2, "0"))
    return rows.select(
        F.concat_ws("-", "family_id", F.col("half").cast("string")).alias("id"),
        "text",
        "lang",
        "zone",
        "spans",
        F.lit("org-0").alias("org_id"),
        F.lit("synthetic-generated").alias("provenance"),
        F.lit("synthetic").alias("consent_basis"),
        F.when(F.col("frame") >= FRAMES - DEV_FRAMES, "dev").otherwise("train").alias("split"),
        "family_id",
        F.lit("generator").alias("source"),
        F.lit("2026-01-01").alias("created"),
        lineage.alias("template_lineage"),
    )


def _families(spark: SparkSession, profiles: int) -> DataFrame:
    """frame x profile x half; a family has two halves."""
    grid = spark.range(FRAMES * profiles * ROWS_A_FAMILY)
    return grid.select(F.pmod("id", F.lit(2)).alias("half"), F.pmod(F.floor(F.col("id") / 2), F.lit(FRAMES)).cast("int").alias("frame"), F.floor(F.col("id") / (2 * FRAMES)).alias("profile"))


def _number() -> Column:
    return F.pmod((F.col("profile") * FRAMES + F.col("frame")) * STRIDE, F.lit(PROFILES))


def hard_families(spark: SparkSession, profiles: int) -> DataFrame:
    """For each class of ambiguity a row whose word stays and one whose word goes."""
    out = None
    for name, (keep, word, drop) in _CLASSES.items():
        lang = "de" if name.startswith("de-") else "en"
        rows = _families(spark, profiles)
        number = _number()
        lead = F.format_string("Frame %02d names %s." if lang == "en" else "Vorlage %02d nennt %s.", F.col("frame"), F.when(F.col("half") == 0, keep).otherwise(drop))
        text = F.concat_ws(" ", lead, profile_sentence(number, lang))
        expected = F.when(F.col("half") == 0, "KEEP").otherwise("REDACT")
        rows = rows.withColumn("text", text).withColumns({"lang": F.lit(lang), "zone": F.lit("prose"), "family_class": F.lit(f"hard-{name}"), "family_id": F.format_string(f"hard-{name}-f%02d-p%04d", F.col("frame"), F.col("profile"))})
        rows = rows.withColumn("spans", F.array(first_span(F.col("text"), F.lit(word), expected, F.lit("PERSON" if name in ("role", "vendor", "de-function") else "LOCATION"))))
        out = _finish(rows) if out is None else out.unionByName(_finish(rows))
    return out


def structural_families(spark: SparkSession, profiles: int, lang: str) -> DataFrame:
    """A person's name as prose value and as an identifier in code, JSON and logs."""
    rows = _families(spark, profiles)
    number = _number()
    person = F.get(F.array(*(F.lit(p) for p in _PEOPLE)), F.pmod(number, F.lit(len(_PEOPLE))).cast("int"))
    zone = F.get(F.array(*(F.lit(z) for z in _ZONES)), F.pmod("frame", F.lit(len(_ZONES))))
    forms = identifier_forms(person)
    surface = F.when(zone == "json_value", person).when(zone == "code_identifier", forms["camel"]).when(zone == "technical_id", forms["dotted"]).otherwise(forms["snake"])
    bare = (
        F.when(zone == "json_value", F.format_string('{"frame":%d,"owner":"%s"}', F.col("frame"), surface))
        .when(zone == "code_identifier", F.format_string("assign%d(%s)", F.col("frame"), surface))
        .when(zone == "technical_id", F.format_string("job-%02d owner=%s", F.col("frame"), surface))
        .otherwise(F.format_string("label_%02d: %s", F.col("frame"), surface))
    )
    rows = rows.withColumns({"zone": zone, "surface": surface, "bare": bare})
    rows = rows.withColumn("text", contextualize(F.col("bare"), F.col("zone"), F.when(F.col("half") == 0, number).otherwise(number + 7919), lang))
    rows = rows.withColumns({"lang": F.lit(lang), "family_class": F.lit(f"struct-{lang}"), "family_id": F.format_string(f"struct-{lang}-f%02d-p%04d", F.col("frame"), F.col("profile"))})
    return _finish(rows.withColumn("spans", F.array(first_span(F.col("text"), F.col("surface"), F.lit("REDACT"), F.lit("PERSON")))))


def general_families(spark: SparkSession, profiles: int, lang: str) -> DataFrame:
    """A row that names a person and a control row without spans."""
    rows = _families(spark, profiles)
    number = _number()
    person = F.get(F.array(*(F.lit(p) for p in _PEOPLE)), F.pmod(number, F.lit(len(_PEOPLE))).cast("int"))
    named, plain = ("Vorgang %02d liegt bei %s.", "Vorgang %02d liegt bei niemandem.") if lang == "de" else ("Case %02d is with %s.", "Case %02d is with nobody.")
    lead = F.when(F.col("half") == 0, F.format_string(named, F.col("frame"), person)).otherwise(F.format_string(plain, F.col("frame")))
    rows = rows.withColumn("person", person).withColumn("text", F.concat_ws(" ", lead, profile_sentence(number, lang)))
    nothing = F.array().cast("array<struct<start:int,end:int,category:string,expected:string,surface:string>>")
    spans = F.when(F.col("half") == 0, F.array(first_span(F.col("text"), F.when(F.col("half") == 0, F.col("person")).otherwise(F.substring("text", 1, 1)), F.lit("REDACT"), F.lit("PERSON")))).otherwise(nothing)
    rows = rows.withColumns({"spans": spans, "lang": F.lit(lang), "zone": F.lit("prose"), "family_class": F.lit(f"general-{lang}"), "family_id": F.format_string(f"general-{lang}-f%02d-p%04d", F.col("frame"), F.col("profile"))})
    return _finish(rows)


def generate(spark: SparkSession, profiles: int, check: bool = False) -> DataFrame:
    """The whole corpus: FRAMES x profiles families of two rows for every class and language.

    With check, the corpus is written and an error is raised where a split of
    a language lacks a slot word; a small number of profiles cannot have all.
    """
    out = hard_families(spark, profiles)
    for lang in ("en", "de"):
        out = out.unionByName(structural_families(spark, profiles, lang)).unionByName(general_families(spark, profiles, lang))
    if check:
        out = materialize(out, "corpus")
        for lang in ("en", "de"):
            gaps = vocabulary_gaps(out, lang).limit(5).collect()
            if gaps:
                raise ValueError(f"{lang}: no text has {[(g.word, g.split) for g in gaps]}")
    return out


def vocabulary_gaps(rows: DataFrame, lang: str = "en", residual: tuple[str, ...] = ()) -> DataFrame:
    """(word, split): slot words that no text of a split has, declared residuals aside."""
    spark = rows.sparkSession
    words = sorted({w for slot in _SLOTS[lang] for w in slot} - set(residual))
    wanted = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{w}', '{s}')" for w in words for s in ("train", "dev")) + " AS t(word, split)")
    have = rows.where(F.col("lang") == lang).select("split", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("word")).distinct()
    return wanted.join(have, ["word", "split"], "left_anti")
