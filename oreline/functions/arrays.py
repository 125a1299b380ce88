"""Array expressions that stay linear, or nearly so, where Spark has no built-in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, op: Callable[[Column, Column], Column], zero: int = 0) -> Column:
    """``op`` (associative, ``zero`` neutral) over the values up to each place: array<long> to array<long>.

    Appending to an array copies it, so one fold over n values would cost n * n. Blocks of the cube
    root of n values are folded apart, then their totals, which costs n ** (4 / 3) copies of a long.
    Null arrays give null; arrays must not hold nulls.
    """
    first = F.array(F.lit(zero).cast("long"))
    last = lambda a: F.element_at(a, -1)

    def fold(block: Column) -> Column:
        return F.aggregate(block, first, lambda acc, x: F.concat(acc, F.array(op(last(acc), x))))

    def joined(inner: Column) -> Column:
        starts = F.aggregate(inner, first, lambda acc, y: F.concat(acc, F.array(op(last(acc), last(y)))))
        shifted = lambda y, s: F.transform(F.slice(y, 2, F.size(y)), lambda v: op(s, v))
        return let(starts, lambda s: F.flatten(F.transform(inner, lambda y, b: shifted(y, F.get(s, b)))))

    def scan(xs: Column) -> Column:
        n = F.size(xs)
        width = F.ceil(F.pow(n.cast("double"), F.lit(1 / 3))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), ((n - 1) / width).cast("int")), lambda b: fold(F.slice(xs, b * width + 1, width)))
        return F.when(n > 0, let(blocks, joined)).otherwise(F.array().cast("array<long>"))

    return let(values, scan)


def sums(values: Column) -> Column:
    """Running sums."""
    return running(values, lambda a, b: a + b)


def maxima(values: Column) -> Column:
    """Running maxima of values from 0 up."""
    return running(values, F.greatest)
