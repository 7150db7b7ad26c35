"""A counter-based 32-bit generator as Column expressions: any draw of any seed, in any order.

State k of a seed is seed + k * STEP modulo 2 ** 32, so draw k needs no draw
before it. Products stay below 2 ** 63 by multiplying 16 bits at a time, since
a 64-bit overflow is an error in ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspan.functions.bind import bound

# fixed value: the increment of the generator's counter
STEP = 0x6D2B79F5
_MASK = 0xFFFFFFFF


def _times(x: Column, y: Column) -> Column:
    """x * y modulo 2 ** 32."""
    high = (F.shiftright(x, 16) * y).bitwiseAND(0xFFFF) * 65536
    return (high + x.bitwiseAND(0xFFFF) * y).bitwiseAND(_MASK)


def _state(seed: Column, k: Column) -> Column:
    return (seed.cast("long") + k.cast("long") * STEP).bitwiseAND(_MASK)


def _first(a: Column) -> Column:
    return _times(a.bitwiseXOR(F.shiftright(a, 15)), a.bitwiseOR(F.lit(1)))


def _second(t: Column) -> Column:
    return t.bitwiseXOR((t + _times(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61)))).bitwiseAND(_MASK))


def _last(u: Column) -> Column:
    return u.bitwiseXOR(F.shiftright(u, 14))


def draw32(seed: Column, k: Column) -> Column:
    """Draw k (from 1) of a seed, an integer in [0, 2 ** 32)."""
    # each step uses the one before it several times: unbound, the expression grows exponentially
    return bound(_state(seed, k), lambda a: bound(_first(a), lambda t: bound(_second(t), _last)))


def draw(seed: Column, k: Column) -> Column:
    """Draw k (from 1) of a seed, in [0, 1)."""
    return draw32(seed, k).cast("double") / float(1 << 32)


def draw_each(seed: Column, ks: Column) -> Column:
    """array<double> of the draws numbered in an array: one pass over the array for each step, nothing bound for an element."""
    states = F.transform(ks, lambda k: _state(seed, k))
    mixed = F.transform(F.transform(states, _first), _second)
    return F.transform(mixed, lambda u: _last(u).cast("double") / float(1 << 32))


def pick_int(r: Column, low: Column | int, high: Column | int) -> Column:
    """An integer in [low, high] from a draw in [0, 1)."""
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return (F.floor(r * (high - low + 1).cast("double")) + low).cast("long")


def category_at(x: Column, cumulative: list[tuple[str, float]]) -> Column:
    """weighted() of a value that is cheap to repeat."""
    out = F.when(x < F.lit(cumulative[0][1]), cumulative[0][0])
    for name, weight in cumulative[1:-1]:
        out = out.when(x < F.lit(weight), name)
    return out.otherwise(cumulative[-1][0])


def weighted(r: Column, cumulative: list[tuple[str, float]]) -> Column:
    """The first category whose cumulative weight exceeds the draw; the last one beyond them all."""
    return bound(r, lambda x: category_at(x, cumulative))


def row_seed(row_index: Column, seed: int = 42) -> Column:
    """The seed of a row."""
    return (F.lit(seed) * 1_000_003 + row_index.cast("long")).bitwiseAND(_MASK)
