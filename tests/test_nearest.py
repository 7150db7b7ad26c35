"""The nearest text by shared shingles against plain Python, and what the queries write and move."""

import random

import numpy as np
import pytest

from larkspan.operators import gates, nearest
from larkspan.plans import gating


def grams(text):
    return {text[i : i + 5] for i in range(max(1, len(text) - 4))}


def jaccard(a, b):
    return len(grams(a) & grams(b)) / len(grams(a) | grams(b))


WIDE = "".join(map(chr, range(0x4E00, 0x4E00 + 7000)))  # more signs than digits
DRAW = random.Random(3)
TEXTS = ["", "a", "abcd", "abcde", "aaaaaaaaaa", "abcabcabcabcabc", "😀" * 9 + "ab", WIDE, WIDE[:300] + "abcde", *("".join(DRAW.choices("abc ", k=DRAW.randrange(60))) for _ in range(60))]


@pytest.mark.parametrize(("few", "many"), [(TEXTS[:7] + TEXTS[9:40], TEXTS), (TEXTS, TEXTS[:8]), (["abcde"], ["abcd", "xyz"]), (TEXTS[20:30], TEXTS[40:])])
@pytest.mark.parametrize("block", [1, 7, 1 << 22])
def test_index_against_plain_python(monkeypatch, few, many, block):
    monkeypatch.setattr(nearest, "BLOCK", block)
    few = sorted(set(few))
    index, best = nearest.Index(few, 5), np.zeros(len(few))
    for text in many:
        index.compare(text, best)
    assert best.tolist() == [max(jaccard(a, b) for b in many) for a in few]


@pytest.mark.parametrize("chars", [40, 1 << 21])
def test_parts_nulls_and_repeated_signatures(spark, monkeypatch, chars):
    monkeypatch.setattr(nearest, "PART_CHARS", chars)
    dev = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS[:7], *TEXTS[9:20], "abcde", None])], "id long, signature string")
    train = spark.createDataFrame([(t,) for t in [*TEXTS[3:7], *TEXTS[30:], None, "abcde"]], "signature string")
    want = {r.id: max(jaccard(r.signature, t.signature) for t in train.collect() if t.signature is not None) for r in dev.collect() if r.signature is not None}
    assert {r.id: r.similarity for r in gates.nearest_jaccard(dev, train).collect()} == want
    assert {r.similarity for r in gates.nearest_jaccard(dev, train.where("false")).collect()} == {0.0}


def test_nearest_writes_no_texts(spark, sf, monkeypatch):
    def refuse(*_):
        raise AssertionError("texts were written")

    monkeypatch.setattr(gates, "materialize", refuse)
    assert gating.nearest_jaccard(spark, sf).count() == 40


def test_signed_rows_hold_one_text(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(gates, "materialize", lambda df, name: df.coalesce(1).write.parquet(f"{tmp_path}/{name}") or spark.read.parquet(f"{tmp_path}/{name}"))
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(str(i), "".join(DRAW.choices(letters, k=20_000)), [], "train" if i % 2 else "dev", "f", "l") for i in range(50)]
    signed = gates.signed_rows(spark.createDataFrame(rows, "id string, text string, spans array<struct<start:int,end:int>>, split string, family_id string, template_lineage string"))
    assert signed.count() == 50 and sum(p.stat().st_size for p in tmp_path.rglob("*.parquet")) < 1.2 * 50 * 20_000
    assert {f.rule for f in gates.split_integrity_failures(signed).collect()} == {"lineage_split"}
