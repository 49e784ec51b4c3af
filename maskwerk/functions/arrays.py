"""Array expressions that stay linear, or nearly so, in the length of the array.

A fold that appends to an array copies it at each step. What depends on all elements before is instead made in
rounds that double the reach; what a lambda uses from outside is bound once, since an expression in a lambda
is evaluated for each element.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points of a piece of a text.
PIECE = 4096


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)


def _bits(n: Column) -> Column:
    """Binary digits of a positive number."""
    return F.length(F.bin(n))


def running(values: Column, join: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """Running sums of an array, or what another associative join makes of all values up to each place."""

    def rounds(x: Column) -> Column:
        reach = lambda k: F.call_function("shiftleft", F.lit(1), k)
        step = lambda a, k: let(reach(k), lambda d: F.transform(a, lambda v, i: F.when(i >= d, join(F.get(a, i - d), v)).otherwise(v)))
        return F.aggregate(F.sequence(F.lit(0), _bits(F.size(x) - 1) - 1), x, step)

    return let(values, lambda x: F.when(F.size(x) < 2, x).otherwise(rounds(x)))


def pieces(text: Column) -> Column:
    """A text in pieces of PIECE code points, by halving: places in a UTF-8 text are found by reading from its start."""
    half = lambda k: F.call_function("shiftleft", F.lit(PIECE), k)
    halves = lambda p, h: F.array(F.substring(p, F.lit(1), h), F.substring(p, h + 1, h))
    cut = lambda parts, k: let(half(k), lambda h: F.flatten(F.transform(parts, lambda p: halves(p, h))))
    rounds = F.sequence(_bits(F.floor((F.length(text) - 1) / PIECE)) - 1, F.lit(0).cast("int"), F.lit(-1))
    return F.when(F.length(text) <= PIECE, F.array(text)).otherwise(F.aggregate(rounds, F.array(text), cut))


def between(parts: Column, start: Column, end: Column) -> Column:
    """Code points [start, end) of the text that pieces were made of."""
    first, last = F.floor(start / PIECE).cast("int"), F.floor((end - 1) / PIECE).cast("int")
    some = F.when(first == last, F.get(parts, first)).otherwise(F.array_join(F.slice(parts, first + 1, last - first + 1), ""))
    return F.when(start >= end, F.lit("")).otherwise(F.substring(some, (start % PIECE + 1).cast("int"), (end - start).cast("int")))


def heads(ordered: Column, furthest: Column) -> Column:
    """Places of the intervals, ordered by start, that no earlier one reaches into; furthest: running greatest ends."""
    first = lambda i: (i == 0) | (F.get(ordered, i)["start"] >= F.get(furthest, i - 1))
    return F.filter(F.transform(ordered, lambda x, i: i), first)
