"""Supergathers: a grid of central bins, and for each the traces of the bins around it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _around(name: str, reach: int):
    return F.explode(F.sequence(F.col(name) - reach, F.col(name) + reach))


def eroded(bins: DataFrame, cols: tuple[str, str], indent: tuple[int, int]) -> DataFrame:
    """The bins all of whose neighbours up to ``indent`` are there too: an equi-join on shifted bins and a count."""
    a, b = cols
    shifted = bins.select(F.col(a), F.col(b)).withColumn("_a", _around(a, indent[0])).withColumn("_b", _around(b, indent[1]))
    there = bins.select(F.col(a).alias("_a"), F.col(b).alias("_b"))
    full = (2 * indent[0] + 1) * (2 * indent[1] + 1)
    return shifted.join(there, ["_a", "_b"]).groupBy(a, b).agg(F.count("*").alias("_n")).where(F.col("_n") == full).drop("_n")


def optimal_origin(df: DataFrame, col: str, step: int) -> DataFrame:
    """origin, n: the offset modulo ``step`` at which a regular grid meets most rows; ties go to the middle."""
    found = df.groupBy(F.pmod(F.col(col), F.lit(step)).alias("origin")).agg(F.count("*").alias("n"))
    return found.orderBy(F.desc("n"), F.abs(F.col("origin") - step // 2), "origin").limit(1)


def generate(df: DataFrame, cols: tuple[str, str], size: tuple[int, int] = (3, 3), step: tuple[int, int] = (20, 20), origin: tuple[int, int] | None = None, border_indent: int | None = 0, strict: bool = True) -> DataFrame:
    """``df``'s traces with the centres ``center_<col>`` of the supergathers they belong to; a trace may be in several.

    Centres are bins on a grid from ``origin`` (by default where it meets most bins); with ``strict`` or a border only bins whose
    surroundings are complete. ``border_indent`` None takes every bin on the grid.
    """
    bins = df.select(*cols).distinct()
    if border_indent is not None:
        bins = eroded(bins, cols, tuple(border_indent + (s // 2 if strict else 0) for s in size))
    if origin is None:
        origin = tuple(optimal_origin(bins, c, s).first()["origin"] for c, s in zip(cols, step))
    on_grid = F.lit(True)
    for c, s, o in zip(cols, step, origin):
        on_grid = on_grid & (F.pmod(F.col(c) - o, F.lit(s)) == 0)
    centers = bins.where(on_grid).select(*(F.col(c).alias(f"center_{c}") for c in cols))
    bridge = centers
    for c, s in zip(cols, size):
        bridge = bridge.withColumn(c, F.explode(F.sequence(F.col(f"center_{c}") - s // 2, F.col(f"center_{c}") + s // 2)))
    return df.join(bridge, list(cols))
