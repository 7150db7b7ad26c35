"""Small cases with known results."""

from pyspark.sql import functions as F

from larkspan.functions.rng import draw
from larkspan.operators import match, metrics
from larkspan.operators.detect import detect
from larkspan.operators.dimensions import HEALTH_PATTERNS
from larkspan.operators.inject import bad_entities, inject


def test_draws_of_seed_42(spark):
    got = [r.x for r in spark.range(1, 4).select(draw(F.lit(42), F.col("id")).alias("x")).collect()]
    assert got == [0.6011037519201636, 0.44829055899754167, 0.8524657934904099]


def test_planted_values_stand_where_they_say(spark):
    rows = spark.createDataFrame([(0, "a b " * 400), (1, None), (2, "")], "row_index long, text string")
    done = inject(rows, [("NAME", 0.5), ("EMAIL", 1.0)])
    assert done.select(bad_entities(done).alias("bad")).agg(F.sum("bad")).first()[0] == 0
    assert 20 <= len(done.where("row_index = 0").first().entities) <= 25


def test_recall_by_verdict(spark):
    facts = spark.createDataFrame([("NAME", "tp")] * 15 + [("NAME", "fn")] * 3 + [(None, "fp")] * 3, "category string, verdict string")
    one = metrics.recall_overall(facts).first()
    assert (one.tp, one.fp, one.fn) == (15, 3, 3) and one.recall == one.precision == 15 / 18
    none = metrics.recall_overall(facts.where("false")).first()
    assert (none.tp, none.recall, none.f1) == (0, 0, 0)


def test_half_overlap_is_the_boundary(spark):
    kind = "array<struct<start:int,end:int,category:string>>"
    spans = lambda *s: [(a, b, "X") for a, b in s]
    row = spark.createDataFrame([(spans((0, 8), (20, 34), (40, 50)), spans((4, 12), (18, 40), (36, 44)))], f"t {kind}, p {kind}")
    assert row.select(F.size(match.match_threshold(F.col("t"), F.col("p"))).alias("n")).first().n == 2


def test_context_words_raise_scores(spark):
    rows = spark.createDataFrame([(1, "the member has HP-ABC123 now"), (2, "HP-ABC123"), (3, "voice print on file: BIO-EAR-A1B2C3D4"), (4, "the member left\nHP-ABC123")], "doc_id long, text string")
    got = {r.doc_id: round(r.score, 2) for r in detect(rows, HEALTH_PATTERNS).where("category in ('HEALTH_PLAN_ID', 'BIOMETRIC_ID')").collect()}
    assert got == {1: 1.0, 2: 0.85, 3: 1.0, 4: 0.85}
