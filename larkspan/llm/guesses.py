"""Guess cost of a string: the cheapest segmentation into words, dates, repeats, keyboard walks and brute force."""

from __future__ import annotations

import re
from math import log10

# fixed values: frequent words and parts of passwords, most frequent first
WORDS = """
password pass admin login welcome master user root secret test guest hello love dragon monkey shadow sunshine princess
football baseball superman batman letmein access default server system changeme example sample token key value string
public private client service account database manager office company summer winter spring autumn january february
march april june july august september october november december monday tuesday wednesday thursday friday saturday
sunday house river stone light green blue black white silver golden orange apple banana coffee cookie pepper tiger lion
eagle horse happy lucky money power magic music star angel freedom forever family mother father sister brother friend
the and that this with from your have none null true false undefined required optional enter insert here todo xxxx
""".split()
# fixed values: rows along which fingers walk
ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "abcdefghijklmnopqrstuvwxyz", "qwertzuiop", "azertyuiop")
# fixed values: digits and signs that stand for letters
LEET = str.maketrans("4@8301!5$7", "aabeolisst")

_RANK = {w: i + 1 for i, w in reversed([*enumerate(WORDS)])}
_NEXT = {a + b for row in ROWS for a, b in zip(row, row[1:], strict=False)}
_DATE = re.compile(r"(?=((?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d))")
_YEAR = re.compile(r"(?=((?:19|20)\d\d))")
_REPEAT = re.compile(r"(.{1,8}?)\1+", re.S)
#: Letters of a dictionary word at most.
LONGEST = 24
DATE_COST, YEAR_COST = log10(365 * 200), log10(200)


def alphabet(value: str) -> int:
    """How many signs a brute-force search over this value's kinds of signs has to try for each place."""
    kinds = ((r"[a-z]", 26), (r"[A-Z]", 26), (r"[0-9]", 10), (r"[!-/:-@\[-`{-~]", 33), (r"[^!-~]", 100))
    return max(2, sum(n for p, n in kinds if re.search(p, value)))


def _walks(low: str):
    """(start, end) of maximal runs along one row, either way, of three signs or more."""
    for way in (1, -1):
        start = 0
        for i in range(1, len(low) + 1):
            if i == len(low) or low[i - 1 : i + 1][::way] not in _NEXT:
                if i - start >= 3:
                    yield start, i
                start = i


def ranks(words: list[str]) -> dict[str, int]:
    """The rank of each word: the fixed words first, then the given ones in their order."""
    out = dict(_RANK)
    for i, w in enumerate(words):
        out.setdefault(w, len(_RANK) + i + 1)
    return out


def guess_cost(value: str, known: dict[str, int] | None = None) -> float:
    """log10 of the guesses for the whole value, by dynamic programming over its prefixes.

    known gives words their ranks (ranks()); the fixed words are the default.
    Time grows with the length, times the greatest word length. The empty
    value costs 0.
    """
    known = _RANK if known is None else known
    each = log10(alphabet(value))
    low = value.lower()
    plain = low.translate(LEET) if len(low) == len(value) else low
    if len(low) != len(value):  # a sign whose lower case is longer
        low = plain = value
    pieces: dict[int, list[tuple[int, float]]] = {}
    for pattern, cost in ((_DATE, DATE_COST), (_YEAR, YEAR_COST)):
        for m in pattern.finditer(value):
            pieces.setdefault(m.end(1), []).append((m.start(1), cost))
    for m in _REPEAT.finditer(value):
        pieces.setdefault(m.end(), []).append((m.start(), len(m[1]) * each + log10((m.end() - m.start()) // len(m[1]))))
    for a, b in _walks(low):
        for end in range(a + 3, b + 1):
            pieces.setdefault(end, []).append((a, log10(2 * len(ROWS) * 10) + log10(end - a)))
    best = [0.0] * (len(value) + 1)
    for end in range(1, len(value) + 1):
        cost = best[end - 1] + each
        for n in range(2, min(end, LONGEST) + 1):
            start = end - n
            rank = known.get(plain[start:end])
            if rank:
                changed = (plain[start:end] != low[start:end]) + (low[start:end] != value[start:end])
                cost = min(cost, best[start] + log10(rank + 1) + changed * log10(2 * n))
        for start, own in pieces.get(end, ()):
            cost = min(cost, best[start] + own)
        best[end] = cost
    return best[-1]
