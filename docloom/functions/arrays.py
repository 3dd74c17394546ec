"""Numeric arrays and windows over sequences as higher-order expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often it is used
    (an expression inside a lambda is otherwise evaluated for every element)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def log_sum_exp(x: Column) -> Column:
    """log(sum(exp(x))) with the largest element taken out first."""
    return let(F.array_max(x), lambda top: F.log(F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v - top))) + top)


def softmax(x: Column) -> Column:
    """Stable softmax; an empty array stays empty."""
    shifted = let(F.array_max(x), lambda top: F.transform(x, lambda v: F.exp(v - top)))
    parts = let(shifted, lambda e: let(F.aggregate(e, F.lit(0.0), lambda a, v: a + v), lambda total: F.transform(e, lambda v: v / total)))
    return F.when(F.size(x) == 0, x).otherwise(parts)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; null where a vector is zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def best_indexes(x: Column, n: int) -> Column:
    """Positions of the ``n`` largest elements, ties by position."""
    tagged = F.transform(x, lambda v, i: F.struct((-v).alias("v"), i.alias("i")))
    return F.slice(F.transform(F.array_sort(tagged), lambda s: s["i"]), 1, n)


def window_starts(length: Column, room: int, stride: int) -> Column:
    """Starts of overlapping windows of ``room`` over a sequence; stops at the one
    that reaches the end; none over an empty sequence."""
    step = min(room, stride)
    last = F.ceil((length - room) / F.lit(step)).cast("int") * step
    return (
        F.when(length <= 0, F.array().cast("array<int>"))
        .when(length <= room, F.array(F.lit(0)))
        .otherwise(F.sequence(F.lit(0), last, F.lit(step)))
    )


def cut_front(x: Column, n: int) -> Column:
    """The first ``n`` elements."""
    return F.slice(x, 1, n)


def cut_back(x: Column, n: int) -> Column:
    """The last ``n`` elements."""
    return F.when(F.size(x) <= n, x).otherwise(F.slice(x, F.greatest(F.size(x) - n + 1, F.lit(1)), n))


def padded(x: Column, size: int, pad, left: bool = False) -> Column:
    """``x`` filled up to ``size`` elements."""
    fill = F.array_repeat(pad if isinstance(pad, Column) else F.lit(pad), F.greatest(F.lit(size) - F.size(x), F.lit(0)))
    return F.concat(fill, x) if left else F.concat(x, fill)
