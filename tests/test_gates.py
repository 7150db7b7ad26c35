"""The split-integrity gate against plain Python."""

import math
import re
import unicodedata

import pytest

from larkspan.operators import gates
from larkspan.plans import gating

SCHEMA = "id string, text string, spans array<struct<start:int,end:int>>, split string, family_id string, template_lineage string"
BASE = "the quick auditor counted forty ledgers before noon and then left the harbour office with all of them"


def canonical(text):
    return " ".join(unicodedata.normalize("NFKC", text).casefold().split())


def signature(row):
    text = row.text
    for start, end in sorted(((s.start, s.end) for s in row.spans), reverse=True):
        text = text[:start] + "<SPAN>" + text[end:]
    return canonical(re.sub(r"\b(?:syn|demo|lab|qa)-\d{5}-[a-z0-9]+\b", "<VOLATILE>", text, flags=re.I))


def grams(text):
    return {text[i : i + 5] for i in range(max(1, len(text) - 4))} if text else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def at(values, p):
    return sorted(values)[max(0, math.ceil(p * len(values)) - 1)] if values else 0.0


def stats(rows):
    signs = [signature(r) for r in rows]
    train = [grams(s) for s in {s for r, s in zip(rows, signs) if r.split == "train"}]
    near = [max((jaccard(grams(s), t) for t in train), default=0.0) for r, s in zip(rows, signs) if r.split == "dev"]
    n_dev = len(near)
    return (len(rows) - n_dev, n_dev, len({canonical(r.text) for r in rows}), len(set(signs)), max(map(signs.count, signs)), at(near, 0.5), at(near, 0.95), max(near, default=0.0), sum(x >= 0.8 for x in near))


@pytest.fixture
def failures(spark):
    def of(*rows):
        signed = gates.signed_rows(spark.createDataFrame([r if len(r) == 6 else (*r, r[0], r[0]) for r in rows], SCHEMA))
        return sorted((f.scope, f.rule) for f in gates.split_integrity_failures(signed).collect())

    return of


def test_stats_against_plain_python(spark, sf):
    rows = [r for r in gating.split_rows(spark, sf).collect() if r.text is not None]
    assert tuple(gating.split_integrity_stats(spark, sf).first()) == pytest.approx(stats(rows))


def test_percentiles_reach_rows_below_the_tail(spark):
    rows = [("t1", BASE, [], "train", "f", "l"), *((f"d{i}", BASE[: 10 * i] + f" and other words of its own {i}", [], "dev", "f", "m") for i in range(1, 9)), ("d9", "", [], "dev", "f", "m")]
    table = spark.createDataFrame(rows, SCHEMA)
    assert tuple(gates.split_integrity_stats(gates.signed_rows(table)).first()) == pytest.approx(stats(table.collect()))


def test_masked_neighbours_and_empty_sides_fail(failures):
    name = BASE.replace("auditor", "Maria Magdalena Oberhuber-Lindenthal")
    other = BASE.replace("auditor", "Jo Li").replace("office", "offices")
    at_ = lambda t, v: [(t.index(v), t.index(v) + len(v))]
    near = ("t", name, at_(name, "Maria Magdalena Oberhuber-Lindenthal"), "train"), ("d", other, at_(other, "Jo Li"), "dev")
    assert failures(*near) == [("d", "near_train")]
    assert failures(near[0]) == [("split-integrity", "empty_dev")] and failures(near[1]) == [("split-integrity", "empty_train")]
    assert failures() == [("split-integrity", "empty_dev"), ("split-integrity", "empty_train")]


def test_lineage_diversity_copies_and_broken_rows_fail(failures):
    assert failures(("t", "a stone", [], "train", "f1", "same"), ("d", "nothing alike", [], "dev", "f2", "same")) == [("same", "lineage_split")]
    assert failures(("t", "STRASSE", [], "train"), ("d", "Straße", [], "dev")) == [("d", "near_train"), *(("split-integrity", r) for r in ("canonical_overlap", "masked_diversity", "masked_overlap"))]
    assert failures(("t", "abc", [(2, 9)], "train"), ("u", None, [], "train"), ("v", "one two three", [], "train", "v", None), ("d", "nothing alike", [], "dev")) == [("t", "masked_signature"), ("u", "no_text"), ("v", "missing_lineage")]


def test_texts_that_differ_in_form_only_are_the_same(spark):
    text = "Die Straße nach Köln führt an der Brücke über den Fluß vorbei"
    other = unicodedata.normalize("NFD", text.replace("ß", "ss").upper())
    docs = spark.createDataFrame([(1, text, [], "train"), (2, other, [], "dev")], "doc_id long, text string, spans array<struct<start:int,end:int>>, split string")
    items = spark.createDataFrame([(7, other)], "item_id long, text string")
    assert {(f.scope, f.rule) for f in gates.contamination_failures(docs, items).collect()} == {("1", "contamination"), ("2", "contamination")}
    assert [r.n for r in gates.exact_duplicates(docs).collect()] == [2] and [r.splits for r in gates.masked_signatures(docs, "spans").collect()] == [2]
    assert [f.rule for f in gates.contamination_failures(docs, items.where("false")).collect()] == ["empty_evaluation"]
