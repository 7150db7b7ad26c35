"""Rows that share an id but not a text."""

import random
from itertools import combinations

from larkspan.llm.near_dedup import drop_near_duplicates, near_dedup

LONG, OTHER = "a b c d e", "x y z w v u"


def test_op6_one_id_with_several_texts_is_one_component(spark):
    rows = spark.createDataFrame([(1, LONG), (5, LONG), (5, OTHER), (7, OTHER), (9, "p q r s t"), (5, "")], "doc_id long, text string")
    got = near_dedup(rows, k=4).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(1, 1, True), (5, 1, False), (7, 1, False), (9, 9, True)} and len(got) == 6


def test_op6_no_text_is_lost_with_another_of_its_id(spark):
    rows = [(1, LONG), (5, LONG), (5, OTHER), (7, OTHER), (0, "m n o p q"), (1, "m n o p q"), (1, "alone among all"), (None, LONG), (5, None)]
    kept = drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect()
    assert sorted(map(repr, kept)) == sorted(f"Row(doc_id={i}, text={t!r})" for i, t in [(1, LONG), (5, OTHER), (0, "m n o p q"), (1, "alone among all"), (None, LONG), (5, None)])


def test_op6_links_just_above_the_threshold(spark):
    """Recall against all pairs where similarity lies between 0.80 and 0.86, at k of 4 and 5."""
    rnd = random.Random(5)
    rows = []
    for g in range(150):
        words = [f"g{g}w{i}" for i in range(rnd.randint(60, 140))]
        rows.append((2 * g, " ".join(words)))
        tail = int(len(words) * rnd.uniform(0.04, 0.12))  # words replaced at the end cost the fewest shingles
        rows.append((2 * g + 1, " ".join(words[: len(words) - tail] + [f"g{g}x{i}" for i in range(tail)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for k in (4, 5):
        sets = {i: {tuple(t.split()[j : j + k]) for j in range(len(t.split()) - k + 1)} for i, t in rows}
        want = {b: a for a, b in combinations(sorted(sets), 2) if b == a + 1 and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
        got = {r.doc_id: r.component_id for r in near_dedup(docs, k=k).collect() if not r.kept}
        assert got == want and len(want) > 40
