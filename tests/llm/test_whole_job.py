"""Cases in which an operator once did less than the whole job."""

import random

import pytest

from larkspan.llm.decontamination import Index, regions
from larkspan.llm.secrets import base_spans, guess_spans


def prose(seed, n):
    rnd = random.Random(seed)
    text = ""
    while len(text) < n:
        text += "".join(rnd.choice("abcdefghijklmnoprstuvwxyz") for _ in range(rnd.randint(2, 9))) + " "
    return text[: n - 1] + "x"


ITEM = prose(1, 390)


def found(copy, item=ITEM):
    """Regions as places of the copy, which stands between other texts."""
    before = prose(2, 500) + " "
    return sorted((a - len(before), b - len(before), e) for _, _, a, b, e in regions(Index([(7, item)]), [before + copy + " " + prose(3, 700)]))


def test_op4_a_copy_with_edits_all_along_is_one_region():
    for edit in (lambda c, i: c[i : i + 1] == ["q"] or c.__setitem__(i, "q"), lambda c, i: c.insert(i, "q"), lambda c, i: c.pop(i)):
        copy = list(ITEM)
        for i in range(340, 20, -50):
            edit(copy, i)
        assert found("".join(copy)) == [(0, len(copy), 7)]


def test_op4_both_sides_of_a_replaced_middle_are_regions():
    assert found(ITEM[:170] + prose(4, 60) + ITEM[230:]) == [(0, 170, 0), (230, 390, 0)]


def test_op4_exact_and_repeated_copies():
    assert found(ITEM) == [(0, 390, 0)] and found(ITEM[100:300]) == [(0, 200, 0)]
    assert found(ITEM + " " + ITEM) == [(0, 390, 0), (391, 781, 0)]
    rows = found("ab cd " * 200, "ab cd " * 40)
    assert min(a for a, _, _ in rows) <= 0 and max(b for _, b, _ in rows) >= 1199


def test_op4_short_items():
    assert found("Forty-two ledgers", "forty two ledgers") == [(0, 17, 0)]
    assert found("forty two lodgers", "forty two ledgers") == [] and found("forty two ledgers", "two ledgers!") == [(6, 17, 0)]
    assert found("Qx 7!", "qx 7") == [(0, 4, 0)] and found("qx 77", "qx 7") == [] and found("aqx 7", "qx 7") == []
    texts = ["qx", "7 qx 7", "", "qx 7"]
    assert [(t, a, b) for t, _, a, b, _ in regions(Index([(7, "QX-7"), (8, "..")]), texts)] == [(1, 2, 6), (3, 0, 4)]


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ('password: "Tr0ub,4dor&3!x"', "Tr0ub,4dor&3!x"),
        ('pwd="Xk9<vT2;qLm4"', "Xk9<vT2;qLm4"),
        ("secret = 'a;9Q#v!2Lp@7z'", "a;9Q#v!2Lp@7z"),
        ('passphrase: "correct horse battery staple"', "correct horse battery staple"),
        ('pwd: "a \\"Q9#\\" x7!z"', 'a \\"Q9#\\" x7!z'),
        ("pwd:\tq7#Vz!m2Lw@9", "q7#Vz!m2Lw@9"),
        ("pwd:\n  q7#Vz!m2Lw@9", "q7#Vz!m2Lw@9"),
        ("pwd: q7#Vz", "q7#Vz"),
        ("the passcode is 8402759163 now", "8402759163"),
        ("the password was 'xkqzvwpmrtbj' then", "xkqzvwpmrtbj"),
        ('auth: "then pwd: q7#Vz!m2Lw@9', "q7#Vz!m2Lw@9"),
    ],
)
def test_op10_whole_values(text, value):
    assert [text[a:b] for a, b, _ in guess_spans(text, base_spans(text))] == [value]


def test_op10_values_easy_to_guess_stay_out():
    for text in ('password: "password"', "the token is important", 'pwd = ""', "secret:", "pwd: 'dragon monkey'"[:12]):
        assert guess_spans(text, base_spans(text)) == []
