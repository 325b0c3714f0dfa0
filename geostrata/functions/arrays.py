"""Expressions over the samples of one trace. They stay in the JVM; NaN marks a missing sample and is skipped."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def samples(data: Column) -> Column:
    return data.cast("array<double>")


def valid(data: Column) -> Column:
    return F.filter(samples(data), lambda x: ~F.isnan(x))


def total(a: Column, f=lambda x: x) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + f(x))


def bound(value: Column, f) -> Column:
    """f of a value that is worked out once per row: an expression inside a lambda would be worked out for every element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def mean(data: Column) -> Column:
    return bound(valid(data), lambda a: F.try_divide(total(a), F.size(a)))


def moments(data: Column) -> Column:
    """struct(n, mean, std) with the population's deviation, from one pass for the mean and one around it."""
    around = lambda a, m: F.sqrt(F.try_divide(total(a, lambda x: (x - m) * (x - m)), F.size(a)))
    both = lambda a: F.struct(a.alias("a"), F.try_divide(total(a), F.size(a)).alias("m"))
    return bound(bound(valid(data), both), lambda v: F.struct(F.size(v["a"]).alias("n"), v["m"].alias("mean"), around(v["a"], v["m"]).alias("std")))


def isclose(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def times(n: int | Column, interval: float, delay: float = 0.0) -> Column:
    """The regular time axis of ``n`` samples in milliseconds."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.lit(float(delay)) + i * F.lit(float(interval)))


def time_to_index(t: Column, interval: float, delay: float = 0.0, round_: bool = False) -> Column:
    """Times as sample positions; halves round to even, as the samples of a survey do."""
    x = (t - F.lit(float(delay))) / F.lit(float(interval))
    return F.rint(x).cast("int") if round_ else x


def limits(data: Column, start: int, stop: int, step: int = 1) -> Column:
    """Samples start, start + step, ... before stop; bounds may be negative as in Python, an empty result is an error."""
    n = F.size(data)
    at = lambda v: F.greatest(n + v, F.lit(0)) if v < 0 else F.least(F.lit(v), n)
    low, high = at(start), at(stop)
    cut = F.slice(data, low + 1, F.greatest(high - low, F.lit(0)))
    cut = cut if step == 1 else F.filter(cut, lambda x, i: i % step == 0)
    return F.when(F.size(cut) > 0, cut).otherwise(F.raise_error(F.lit("no samples are left within the limits")).cast("array<double>"))


def element(data: Column, i: Column) -> Column:
    """Sample ``i`` counted from 0, null outside."""
    return F.when((i >= 0) & (i < F.size(data)), F.get(data, i.cast("int")))


def piecewise(x: Column, xs: list[float], ys: list[float]) -> Column:
    """A piecewise-linear function through knots, extrapolated with the slopes of its ends; one knot is a constant."""
    if len(xs) == 1:
        return F.lit(float(ys[0])) + x * 0
    line = lambda i: F.lit(float(ys[i])) + (x - F.lit(float(xs[i]))) * F.lit((ys[i + 1] - ys[i]) / (xs[i + 1] - xs[i]))
    out = line(len(xs) - 2)
    for i in range(len(xs) - 3, -1, -1):
        out = F.when(x <= F.lit(float(xs[i + 1])), line(i)).otherwise(out)
    return out


def running_sums(a: Column, block: int = 32) -> Column:
    """0 and the sums of the first 1, 2, ... elements: summed within blocks, then shifted by the blocks before, as a fold that
    appends to one array copies it at every step."""

    def fold(x: Column) -> Column:
        return F.aggregate(x, F.array(F.lit(0.0)), lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v)))

    def shifted(inner: Column) -> Column:
        return bound(fold(F.transform(inner, lambda b: F.element_at(b, -1))), lambda before: F.flatten(F.transform(inner, lambda b, i: F.transform(F.slice(b, 2, block), lambda v: v + F.get(before, i)))))

    starts = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / block).cast("int")), lambda k: k * block)
    inner = F.transform(starts, lambda k: fold(F.slice(a, k + 1, F.lit(block))))
    return F.when(F.size(a) > 0, F.concat(F.array(F.lit(0.0)), bound(inner, shifted))).otherwise(F.array(F.lit(0.0)))


def longest_run(flags: Column) -> Column:
    """Length of the longest run of true: a fold over (current, best)."""
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))

    def step(acc, on):
        now = F.when(on, acc["now"] + 1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(acc["best"], now).alias("best"))

    return F.aggregate(flags, start, step, lambda acc: acc["best"])
