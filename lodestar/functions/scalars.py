"""Column functions: finiteness, clamps, levels, positions, array statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def clamp(x: Column, low, high) -> Column:
    """Null stays null: greatest and least would skip it."""
    low, high = (v if isinstance(v, Column) else F.lit(float(v)) for v in (low, high))
    return F.when(x.isNotNull(), F.greatest(low, F.least(x, high)))


def round_half_even(x: Column, digits: int = 2) -> Column:
    """Rounds the exact binary value, ties to even."""
    return F.call_function("format_number", x, F.lit("0." + "0" * digits)).cast("double")


def pivot_levels(high: Column, low: Column, close: Column) -> dict[str, Column]:
    """The central pivot band and the floor pivots of a finished session."""
    p, span = (high + low + close) / 3, high - low
    bc = (high + low) / 2
    tc = 2 * p - bc
    bottom, top = F.least(bc, tc), F.greatest(bc, tc)
    return {
        "pivot": p, "bc": bc, "tc": tc, "bottom": bottom, "top": top, "width": (top - bottom) / F.abs(p),
        "r1": 2 * p - low, "r2": p + span, "r3": high + 2 * (p - low), "s1": 2 * p - high, "s2": p - span, "s3": low - 2 * (high - p),
    }


def band_position(price: Column, bottom: Column, top: Column) -> Column:
    return F.when(price > top, "above_tc").when(price < bottom, "below_bc").otherwise("inside_cpr")


def pivot_position(price: Column, at: dict[str, Column]) -> Column:
    """Strictly above counts for the pivot and resistances, at or above for supports."""
    out = F.when(price > at["r3"], "above_r3")
    for low, high in (("r2", "r3"), ("r1", "r2"), ("pivot", "r1")):
        out = out.when(price > at[low], f"{low}_{high}")
    for low, high in (("s1", "pivot"), ("s2", "s1"), ("s3", "s2")):
        out = out.when(price >= at[low], f"{low}_{high}")
    return out.otherwise("below_s3")


def true_range(high: Column, low: Column, before: Column) -> Column:
    return F.greatest(high - low, F.abs(high - before), F.abs(low - before))


# --- statistics over an array column ---


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def dot(xs: Column, ys: Column) -> Column:
    return total(F.zip_with(xs, ys, lambda x, y: x * y))


def median(xs: Column) -> Column:
    ordered, n = F.array_sort(xs), F.size(xs)
    return (F.get(ordered, F.floor(n / 2).cast("int")) + F.get(ordered, F.floor((n - 1) / 2).cast("int"))) / 2


def population_deviation(xs: Column) -> Column:
    n = F.size(xs)
    mean = total(xs) / n
    return F.sqrt(F.aggregate(xs, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n)


def ewma_weights(n: Column, half_life: int) -> Column:
    """By position, the last weighing most; they sum to one."""
    raw = F.transform(F.sequence(F.lit(1), n), lambda i: F.pow(F.lit(0.5), (n - i) / F.lit(float(half_life))))
    whole = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raw, lambda x: x / whole)
