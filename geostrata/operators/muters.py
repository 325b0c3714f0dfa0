"""Muters as functions of offset, given by arrays of knots: averages with weights, fields of them, and muters below near-surface models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geostrata.functions.arrays import bound
from geostrata.operators import gathers
from geostrata.operators.fields import at_array
from geostrata.operators.spatial import idw_weights, nearest_pairs


def weighted(df: DataFrame, by: list[str], x: str = "x", y: str = "y", weight: str | None = None) -> DataFrame:
    """by, x, y: the weighted mean of a group's functions at all their knots; equal weights without ``weight``.

    A group is what a caller averages: the neighbours of a place, a handful.
    """
    rows = df.select(*by, F.struct(F.col(x).alias("x"), F.col(y).alias("y"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w")).alias("m"))
    groups = rows.groupBy(*by).agg(F.collect_list("m").alias("m"), F.sum("m.w").alias("w"))
    knots = F.array_sort(F.array_distinct(F.flatten("m.x")))
    mean = lambda k: F.aggregate("m", F.lit(0.0), lambda acc, m: acc + m["w"] * at_array(m["x"], m["y"], k)) / F.col("w")
    return groups.withColumn("x", knots).select(*by, "x", F.transform("x", mean).alias("y"))


def at_places(field: DataFrame, queries: DataFrame, id_col: str, neighbors: int = 4, xy=("px", "py"), x: str = "x", y: str = "y") -> DataFrame:
    """query_id, x, y: a muter at each place, of the nearest ones of a field by inverse distance."""
    near = idw_weights(nearest_pairs(queries, field, neighbors, id_col, id_col, xy, xy))
    return weighted(near.join(field.select(F.col(id_col).alias("point_id"), x, y), "point_id"), ["query_id"], x, y, "weight")


def from_refractors(params: DataFrame, keep: list[str], n_refractors: int, delay: float = 0.0, velocity_reduction: float = 0.0, reach: float = 10_000.0) -> DataFrame:
    """keep, x, y: muters below the near-surface models in columns t0, x1.., v1..: velocities reduced, times later by the delay."""
    xs = [F.lit(0.0), *(F.col(f"x{i}").cast("double") for i in range(1, n_refractors))]
    xs.append(xs[-1] + reach)
    vs = [F.col(f"v{i}").cast("double") - velocity_reduction for i in range(1, n_refractors + 1)]
    vs = [F.when(v > 0, v).otherwise(F.raise_error(F.lit("velocities have to stay positive")).cast("double")) for v in vs]
    ts = [F.col("t0") + delay]
    for a, b, v in zip(xs, xs[1:], vs):
        ts.append(ts[-1] + (b - a) * 1000 / v)
    return params.select(*keep, F.array(*xs).alias("x"), F.array(*ts).alias("y"))


def mute(df: DataFrame, data_col: str, offset_col: str, interval: float, x: str = "x", y: str = "y", delay: float = 0.0, fill: float = float("nan"), out: str = "muted") -> DataFrame:
    """Traces muted each by the muter in its own row."""
    return df.withColumn(out, bound(at_array(F.col(x), F.col(y), F.col(offset_col)), lambda t: gathers.mute(F.col(data_col), t, interval, delay, fill)))


def muted_and_scaled(df: DataFrame, data_col: str, time: Column, interval: float, delay: float = 0.0, out: str = "prepared") -> DataFrame:
    """What trace metrics of muted gathers see: samples before ``time`` missing, the rest scaled by their own mean and deviation."""
    muted = df.withColumn("_muted", gathers.mute(F.col(data_col), time, interval, delay))
    return gathers.scale_standard(muted, "_muted", out=out).drop("_muted")
