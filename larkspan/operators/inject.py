"""Planting identifiers in carrier text with exact offsets, one row at a time, without a shuffle.

A row's draws come from its own seed: draw 1 is how many, the following are
places (a repeated place consumes its draw), then one category for each place
in ascending order. Values have shapes of their own, seeded by row and ordinal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.functions.bind import bound, running_sums
from larkspan.functions.rng import category_at, draw, draw_each, pick_int, row_seed
from larkspan.functions.text import pad_left

LEAST, MOST, TRIES, SPARE = 20, 25, 10, 4

_FIRST = "Ada Boris Clara Daan Edith Farid Greta Hugo Ines Jonas Karla Liam Mira Nils Olga Paul".split()
_LAST = "Arnd Brook Castel Dorn Ebert Falk Grove Hale Irwin Jansen Keller Lund Moreau Novak Ortiz Pohl".split()
_STREETS = "Oak Elm Mill Lake Hill Park Bridge Station".split()
_CITIES = "Arden Brenta Corvin Delmar Eastvale Fenwick Garmond Hollis".split()


def plan(text: Column, row_index: Column, weights: list[tuple[str, float]], seed: int = 42) -> Column:
    """array<struct(position, category)> for one row, by ascending position."""

    def planned(r: Column) -> Column:
        own, target, length = r["own"], r["target"], r["length"]
        places = lambda n: F.transform(draw_each(own, F.sequence(F.lit(2), n + 1)), lambda x: pick_int(x, 0, length))

        def categories(d: Column) -> Column:
            last = F.array_position(d["drawn"], F.element_at(d["kept"], -1))
            used = F.when(F.size(d["kept"]) == target, last).otherwise(F.size(d["drawn"])).cast("int")
            draws = bound(used, lambda u: draw_each(own, F.sequence(u + 2, u + 1 + F.size(d["kept"]))))
            return F.zip_with(F.array_sort(d["kept"]), draws, lambda p, x: F.struct(p.cast("int").alias("position"), category_at(x, weights).alias("category")))

        # a few draws more than the target are nearly always enough; only short texts repeat places so often that all count
        few = places(target + SPARE)
        drawn = bound(few, lambda d: F.when(F.size(F.array_distinct(d)) >= target, d).otherwise(places(target * TRIES)))
        return bound(drawn, lambda d: bound(F.struct(d.alias("drawn"), F.slice(F.array_distinct(d), F.lit(1), target).alias("kept")), categories))

    own = row_seed(row_index, seed)
    target = pick_int(draw(own, F.lit(1)), LEAST, MOST).cast("int")
    length = F.greatest(F.length(text), F.lit(1))
    return bound(F.struct(own.alias("own"), target.alias("target"), length.alias("length")), planned)


def _pick(words: list[str], number: Column) -> Column:
    return F.get(F.array(*(F.lit(w) for w in words)), F.pmod(number, F.lit(len(words))).cast("int"))


def _digits(number: Column, n: int, skip: int = 0) -> Column:
    """n decimal digits of a number, after leaving out its lowest `skip`."""
    return F.lpad(F.pmod(F.floor(number / 10**skip) if skip else number, F.lit(10**n)).cast("string"), n, "0")


def luhn_digit(body: Column) -> Column:
    """The check digit that makes body a valid card number of even length."""
    digits = F.split(body, "")
    doubled = lambda d, i: F.when(F.pmod(i, F.lit(2)) == 0, F.floor(2 * d / 10) + F.pmod(2 * d, F.lit(10))).otherwise(d)
    total = F.aggregate(F.transform(F.filter(digits, lambda d: d != ""), lambda d, i: doubled(d.cast("int"), i)), F.lit(0).cast("long"), lambda s, d: s + d)
    return F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10)).cast("string")


def iban(bank: Column) -> Column:
    """A German IBAN over 18 digits: check digits are 98 less the number modulo 97."""
    rest = F.pmod(F.concat(bank, F.lit("131400")).cast("decimal(38,0)"), F.lit(97).cast("decimal(38,0)"))
    return F.concat(F.lit("DE"), F.lpad((98 - rest.cast("int")).cast("string"), 2, "0"), bank)


def value(category: Column, row_index: Column, ordinal: Column) -> Column:
    """A value of the category's shape, from a number hashed from row and ordinal."""
    hexed = F.md5(F.concat_ws(":", row_index.cast("string"), ordinal.cast("string")).cast("binary"))
    return bound(hexed, lambda h: bound(_number(h), lambda x: _shaped(category, h, x)))


def _number(hexed: Column) -> Column:
    return F.conv(F.substring(hexed, 1, 15), 16, 10).cast("long")


def _shaped(category: Column, hexed: Column, x: Column) -> Column:
    date = lambda first, years: F.concat_ws("-", (F.pmod(x, F.lit(years)) + first).cast("string"), pad_left(F.pmod(F.floor(x / 64), F.lit(12)) + 1, 2), pad_left(F.pmod(F.floor(x / 1024), F.lit(28)) + 1, 2))
    name = F.concat_ws(" ", _pick(_FIRST, x), _pick(_LAST, F.floor(x / 16)))
    phone = F.concat(F.lit("("), _digits(x, 3), F.lit(") "), _digits(x, 3, 3), F.lit("-"), _digits(x, 4, 6))
    address = F.concat_ws(" ", (F.pmod(x, F.lit(899)) + 100).cast("string"), _pick(_STREETS, x), F.lit("Street,"), _pick(_CITIES, F.floor(x / 8)))
    email = F.concat(F.lower(_pick(_FIRST, x)), F.lit("."), F.lower(_pick(_LAST, F.floor(x / 16))), _digits(x, 3), F.lit("@mail.example"))
    ssn = F.concat_ws("-", _digits(x, 3), _digits(x, 2, 3), _digits(x, 4, 5))
    upper = F.upper(hexed)
    card = F.concat(F.lit("4"), _digits(x, 14))
    shapes = {
        "DATE": date(1990, 35),
        "DOB": date(1940, 66),
        "NAME": name,
        "FULL_NAME": name,
        "GEO_SUBDIVISION": address,
        "RESIDENTIAL_ADDRESS": address,
        "MRN": F.concat(F.lit("MRN"), _digits(x, 7)),
        "HEALTH_PLAN_ID": F.concat(F.lit("HP-"), _digits(x, 9)),
        "ACCOUNT_NUMBER": F.concat(F.lit("ACCT-"), _digits(x, 10)),
        "PHONE": phone,
        "FAX": F.concat(F.lit("Fax: "), phone),
        "EMAIL": email,
        "SSN": ssn,
        "LICENSE_NUMBER": F.concat(F.lit("LIC-"), _digits(x, 8)),
        "VEHICLE_ID": F.substring(upper, 1, 17),
        "DEVICE_ID": F.concat(F.lit("DEV-"), _digits(x, 12)),
        "URL": F.concat(F.lit("https://site"), _digits(x, 4), F.lit(".example/p/"), _digits(x, 5, 4)),
        "IP_ADDRESS": F.concat_ws(".", *((F.pmod(F.floor(x / 256**i), F.lit(254)) + 1).cast("string") for i in range(4))),
        "BIOMETRIC_ID": F.concat(F.lit("BIO-FINGERPRINT-"), F.substring(upper, 1, 16)),
        "FACE_PHOTO_REF": F.concat(F.lit("face-photo://"), F.substring(hexed, 1, 12), F.lit(".jpg")),
        "OTHER_UNIQUE_ID": F.concat(F.lit("STUDY-"), _digits(x, 8)),
        "BANK_ACCOUNT_NUMBER": pad_left(F.pmod(x, F.lit(10**12)), 8),
        "BANK_ROUTING_NUMBER": pad_left(F.pmod(x, F.lit(990_000_000)) + 10_000_000, 9),
        "CREDIT_CARD_PAN": F.concat(card, luhn_digit(card)),
        "CARD_CVV": (F.pmod(x, F.lit(9900)) + 100).cast("string"),
        "CARD_EXPIRATION": F.concat(pad_left(F.pmod(x, F.lit(12)) + 1, 2), F.lit("/"), (F.pmod(F.floor(x / 16), F.lit(7)) + 26).cast("string")),
        "IBAN": iban(_digits(x, 18)),
        "TAX_ID": F.when(F.pmod(x, F.lit(2)) == 0, F.concat_ws("-", _digits(x, 2), _digits(x, 7, 2))).otherwise(F.concat(F.lit("9"), _digits(x, 2), F.lit("-"), _digits(x, 2, 2), F.lit("-"), _digits(x, 4, 4))),
        "DRIVER_LICENSE": F.concat(F.lit("DL-"), _digits(x, 9)),
        "ACCOUNT_BALANCE": F.concat(F.lit("$"), (F.pmod(x, F.lit(9)) + 1).cast("string"), F.lit(","), _digits(x, 3, 1), F.lit("."), _digits(x, 2, 4)),
        "CREDIT_SCORE": (F.pmod(x, F.lit(551)) + 300).cast("string"),
        "LOAN_ACCOUNT_ID": F.concat(F.lit("LN-"), _digits(x, 10)),
    }
    out = None
    for key, shape in shapes.items():
        out = (F if out is None else out).when(category == key, shape)
    return out


def digit_value(category: Column, row_index: Column, ordinal: Column) -> Column:
    """Nine digits for any category: the shape used where another engine checks the splice."""
    return _digits(_number(F.md5(F.concat_ws(":", row_index.cast("string"), ordinal.cast("string")).cast("binary"))), 9)


def inject(carriers: DataFrame, weights: list[tuple[str, float]], row_col: str = "row_index", text_col: str = "text", seed: int = 42, make=value) -> DataFrame:
    """Adds injected (the spliced text) and entities (category, value, start_char, end_char; half-open) to each row.

    Each value has one space on either side. A null text is empty. The two are
    separate expressions, so a plan that needs the entities alone never splices.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    planned = carriers.withColumn("__plan", plan(text, F.col(row_col), weights, seed))
    valued = F.transform("__plan", lambda p, i: F.struct(p["position"].alias("position"), p["category"].alias("category"), make(p["category"], F.col(row_col), i + 1).alias("value")))
    planned = planned.withColumn("__values", valued)

    def entities(v: Column) -> Column:
        shifts = running_sums(F.transform(v, lambda p: F.length(p["value"]) + 2))

        def one(p: Column, end: Column) -> Column:
            return F.struct(p["category"].alias("category"), p["value"].alias("value"), (end - F.length(p["value"])).alias("start_char"), end.alias("end_char"))

        # a shift counts this value too; an empty text has a place 1, but no sign before it
        ends = bound(F.length(text), lambda n: F.zip_with(v, shifts, lambda p, shift: F.least(p["position"], n) + shift - 1))
        return F.zip_with(v, ends, one)

    def spliced(v: Column) -> Column:
        before = lambda i: F.coalesce(F.get(v, i - 1)["position"], F.lit(0))
        parts = F.transform(v, lambda p, i: F.concat(F.substring(text, before(i) + 1, p["position"] - before(i)), F.lit(" "), p["value"], F.lit(" ")))
        return F.concat(F.array_join(parts, ""), F.substring(text, F.element_at(v, -1)["position"] + 1, F.length(text)))

    return planned.withColumn("injected", bound(F.col("__values"), spliced)).withColumn("entities", bound(F.col("__values"), entities)).drop("__plan", "__values")


def bad_entities(rows: DataFrame, text_col: str = "injected", entities_col: str = "entities") -> Column:
    """Entities whose slice of the text is not their value: 0 in a sound row."""
    return F.size(F.filter(entities_col, lambda e: ~F.substring(F.col(text_col), e["start_char"] + 1, e["end_char"] - e["start_char"]).eqNullSafe(e["value"])))


def long_enough(entities: Column, least: int = 3) -> Column:
    """Annotations whose trimmed value has at least `least` characters."""
    return F.filter(entities, lambda e: F.length(F.trim(e["value"])) >= least)
