"""Running values over arrays, as column expressions whose work is linear in the array."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Running values go over runs of so many values, then over the runs' totals.
RUN = 256


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with the value worked out once however often it is used, also inside of functions over arrays."""
    return F.element_at(F.transform(F.array(value), of), 1)


def running(values: Column, zero: Column, plus: Callable[[Column, Column], Column]) -> Column:
    """plus over the values up to each one; plus must be associative, with ``zero`` as its zero.

    An array that grows by a value per step is copied per step. Arrays of ``RUN`` values, then one of a value per run, keep that small.
    """

    def over(run: Column) -> Column:
        start = F.struct(zero.alias("sum"), F.slice(F.array(zero), 1, 0).alias("out"))
        step = lambda acc, x: let(plus(acc["sum"], x), lambda now: F.struct(now.alias("sum"), F.concat(acc["out"], F.array(now)).alias("out")))
        return F.aggregate(run, start, step, lambda acc: acc["out"])

    def runs(every: Column) -> Column:
        first = F.sequence(F.lit(1), F.greatest(F.size(every), F.lit(1)), F.lit(RUN))
        return F.transform(first, lambda at: over(F.slice(every, at, F.lit(RUN))))

    def joined(parts: Column) -> Column:
        last = F.transform(parts, lambda p: F.coalesce(F.try_element_at(p, F.lit(-1)), zero))
        return let(over(last), lambda total: F.flatten(F.transform(parts, lambda p, k: F.transform(p, lambda x: F.when(k == 0, x).otherwise(plus(F.try_element_at(total, k), x))))))

    return let(values, lambda v: let(runs(v), joined))
