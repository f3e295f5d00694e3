"""Scalar functions over class probabilities and distances; all are native expressions.

Class 0 is background, class c stands for c + 1 Å (2 to 64 Å), and the distance 65 stands for "background".
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BACKGROUND = 65.0


def distance_class(d: Column) -> Column:
    """Half-even rounding; under 2 counts as 2, over 64 is background (null)."""
    # to whole numbers, rint is what bround is, without the digits of every value
    return F.when(d <= 64, F.rint(F.greatest(d, F.lit(2.0))).cast("int") - 1)


def rounded(x: Column, places: int) -> Column:
    """``F.round`` of doubles for many rows: only values near a tie, or too large to tell, are rounded by their decimal digits."""
    by = float(10**places)
    up = x * by
    # below 2 ** 40 the product is off by less than a thousandth
    clear = (F.abs(up) < float(1 << 40)) & (F.abs(up - F.floor(up) - 0.5) > 1e-3)
    return F.when(clear, F.floor(up + 0.5) / F.lit(by)).otherwise(F.round(x, places))


def half_away(x: Column, places: int) -> Column:
    """SQL's round of doubles: of the product with the power of ten, halves away from zero; a zero keeps its sign. ``F.round`` goes by decimal digits
    instead, so at some ties it gives the other neighbour."""
    by = float(10**places)
    up = F.abs(x) * by
    # up - floor(up) is exact, up + 0.5 isn't; from 2 ** 52 on there are whole numbers only
    whole = F.when(up < float(1 << 52), F.floor(up) + F.when(up - F.floor(up) >= 0.5, 1).otherwise(0)).otherwise(up)
    return F.when(up == float("inf"), x).otherwise(F.signum(x) * whole / F.lit(by))


def bind(value: Column, f) -> Column:
    """f(value), with the value computed once: what a lambda names from outside would be computed again for every element."""
    return F.transform(F.array(value), f)[0]


def softmax(a: Column) -> Column:
    """C02."""
    shifted = bind(a, lambda v: bind(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top))))
    return bind(shifted, lambda e: bind(total(e), lambda t: F.transform(e, lambda x: x / t)))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, y: s + y)


def argmax(a: Column) -> Column:
    """The first largest class."""
    return bind(a, lambda v: (F.array_position(v, F.array_max(v)) - 1).cast("int"))


def class_to_distance(c: Column) -> Column:
    return F.when(c == 0, F.lit(BACKGROUND)).otherwise((c + 1).cast("double"))


def expected_distance(p: Column) -> Column:
    """Rounded mean distance over classes 1 to 63, unless background is the likeliest class."""

    def of(v: Column) -> Column:
        near = F.slice(v, 2, F.size(v) - 1)
        mean = total(F.transform(near, lambda x, i: x * (i + 2))) / total(near)
        return F.when(argmax(v) == 0, F.lit(BACKGROUND)).otherwise(F.bround(mean, 0))

    return bind(p, of)


def bin10(p: Column) -> Column:
    """Up to 4 Å, eight bins of 2 Å up to 20 Å, and the rest with background."""

    def of(v: Column) -> Column:
        part = lambda lo, n: total(F.slice(v, lo, n))  # noqa: E731  class c stands at element c + 1
        return F.array(part(2, 3), *[part(5 + 2 * k, 2) for k in range(8)], part(21, 44) + F.element_at(v, 1))

    return bind(p, of)


def one_hot(c: Column, n: int) -> Column:
    """C06."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: (k == c).cast("int"))


def capped_exp(s: Column, local: Column, least: float = 8.0) -> Column:
    """e^s up to T = max(least, local)."""
    t = F.greatest(F.lit(least), local)
    return F.when(s < F.log(t), F.exp(s)).otherwise(t)


def blend(local: Column, e: Column, w: float = 0.2) -> Column:
    """C09."""
    return local * (1 - w) + e * w


def log_odds(p: Column, background: Column, lam: float = 0.2305) -> Column:
    """C10."""
    return F.log(p / background) / lam


def percent(p: Column) -> Column:
    """Whole percent, cut."""
    return (p * 100).cast("int")


def normalize(a: Column, norm: Column) -> Column:
    """C11."""
    return F.zip_with(a, norm, lambda x, n: x / n)


def pad(a: Column, multiple: int = 64, least: int = 0) -> Column:
    """Zeros up to the next multiple, and to a least size."""
    size = F.greatest(F.ceil(F.size(a) / multiple) * multiple, F.lit(least)).cast("int")
    return F.concat(a, F.array_repeat(F.lit(0.0), size - F.size(a)))


def transpose_flat(a: Column, side: int, keep_last: bool = True) -> Column:
    """C14: the transpose of a flattened square; a last element beyond it is kept."""
    square = F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda k: F.element_at(a, ((k % side) * side + F.floor(k / side) + 1).cast("int")))
    return F.concat(square, F.slice(a, side * side + 1, 1)) if keep_last else square


def mean_subtract(a: Column, mean: list[float]) -> Column:
    """C25."""
    return F.zip_with(a, F.array(*[F.lit(float(m)) for m in mean]), lambda x, m: x - m)


def subset_sum(terms: Column, indexes: Column) -> Column:
    """Sum of the terms with these zero-based indexes."""
    return F.aggregate(F.transform(indexes, lambda i: F.element_at(terms, (i + 1).cast("int"))), F.lit(0.0), lambda s, x: s + x)
