"""Rates with their three policies for an empty denominator, rounding, and two percentile rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio_or_zero(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def ratio_or_null(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def recall_precision_f1(tp: Column, fp: Column, fn: Column, ratio=ratio_or_zero) -> dict[str, Column]:
    """Recall, precision and their harmonic mean under one policy."""
    return {"recall": ratio(tp, tp + fn), "precision": ratio(tp, tp + fp), "f1": ratio(2 * tp, 2 * tp + fp + fn)}


def percent(a: Column, b: Column) -> Column:
    """a / b in percent, half up to two decimals; 0 for an empty denominator."""
    return F.floor(ratio_or_zero(a, b) * 10000 + 0.5) / 100


def percent_or_null(a: Column, b: Column) -> Column:
    return F.floor(F.try_divide(a, b) * 10000 + 0.5) / 100


def f1_of_percents(recall: Column, precision: Column) -> Column:
    """The harmonic mean of percents that are rounded already, to two decimals; 0 where both are 0."""
    return F.floor(F.coalesce(F.try_divide(2 * recall * precision, recall + precision), F.lit(0.0)) * 100 + 0.5) / 100


def percentile_floor(values: Column, p: float) -> Column:
    """Of an array: the sorted value at floor((n - 1) * p)."""
    return F.get(F.array_sort(values), F.floor((F.size(values) - 1) * F.lit(p)).cast("int"))


def percentile_rank(values: Column, p: float) -> Column:
    """Of an array: nearest rank, the sorted value at ceil(p * n) - 1, at least the first."""
    return F.get(F.array_sort(values), F.greatest(F.ceil(F.size(values) * F.lit(p)) - 1, F.lit(0)).cast("int"))


def percent_label(x: Column) -> Column:
    """One decimal and a percent sign."""
    return F.format_string("%.1f%%", x)
