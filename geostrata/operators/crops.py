"""Crops of gathers at origins of any kind: a grid, drawn by hash, or listed; padded where they reach over a gather's end.

Several components of a gather are cropped at the same origins. A crop's rows are found by a join on the trace's number, a padded row like any
other: the padding mode tells which trace or sample stands for one beyond the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geostrata.functions.arrays import samples


def sizes(df: DataFrame, by: list[str], data_col: str) -> DataFrame:
    """by, n_traces, n_samples of each gather."""
    return df.groupBy(*by).agg(F.count("*").alias("n_traces"), F.max(F.size(data_col)).alias("n_samples"))


def _axis(n: Column, crop: int, stride: int) -> Column:
    last = F.greatest(n - crop, F.lit(0))
    return F.array_distinct(F.concat(F.filter(F.sequence(F.lit(0).cast("long"), last.cast("long"), F.lit(stride).cast("long")), lambda o: o < last), F.array(last.cast("long"))))


def grid(gathers: DataFrame, by: list[str], shape: tuple[int, int], stride: tuple[int, int] | None = None) -> DataFrame:
    """by, crop, origin_trace, origin_sample: origins a stride apart, and the last at which a crop still fits, of each gather."""
    stride = stride or shape
    pairs = gathers.select(*by, "n_samples", F.explode(_axis(F.col("n_traces"), shape[0], stride[0])).alias("origin_trace"))
    pairs = pairs.select(*by, "origin_trace", F.explode(_axis(F.col("n_samples"), shape[1], stride[1])).alias("origin_sample"))
    return pairs.withColumn("crop", F.concat_ws(":", "origin_trace", "origin_sample"))


def drawn(gathers: DataFrame, by: list[str], shape: tuple[int, int], n_crops: int, seed: int = 0) -> DataFrame:
    """The same for ``n_crops`` origins of each gather, evenly drawn so that no crop reaches over its ends, by a hash of gather, crop and seed."""
    each = gathers.withColumn("crop", F.explode(F.sequence(F.lit(0), F.lit(n_crops - 1)))).withColumn("crop", F.col("crop").cast("string"))

    def at(n, crop, axis):
        digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *by, "crop", F.lit(axis)).cast("binary")), 1, 12)
        return F.pmod(F.conv(digits, 16, 10).cast("long"), 1 + F.greatest(n - crop, F.lit(0)))

    return each.select(*by, "crop", at(F.col("n_traces"), shape[0], "trace").alias("origin_trace"), at(F.col("n_samples"), shape[1], "sample").alias("origin_sample"))


def listed(gathers: DataFrame, by: list[str], origins: list[tuple[int, int]]) -> DataFrame:
    """The same for given origins (trace, sample) in every gather; none is negative."""
    if not origins or min(min(o) for o in origins) < 0:
        raise ValueError("origins are pairs of numbers from 0 on")
    known = F.array(*(F.struct(F.lit(str(i)).alias("crop"), F.lit(int(a)).cast("long").alias("origin_trace"), F.lit(int(b)).cast("long").alias("origin_sample")) for i, (a, b) in enumerate(origins)))
    return gathers.select(*by, F.explode(known).alias("o")).select(*by, "o.*")


def standing_for(at: Column, n: Column, mode: str) -> Column:
    """Which of n positions stands for position ``at``, which may lie beyond the end; null for a constant."""
    if mode == "constant":
        return F.when(at < n, at)
    if mode == "edge":
        return F.least(at, n - 1)
    if mode == "wrap":
        return F.pmod(at, n)
    if mode == "symmetric":
        m = F.pmod(at, 2 * n)
        return F.when(m < n, m).otherwise(2 * n - 1 - m)
    if mode == "reflect":
        m = F.pmod(at, F.greatest(2 * n - 2, F.lit(1)))
        return F.when(m < n, m).otherwise(2 * n - 2 - m)
    raise ValueError(f"no such padding: {mode}")


def crops(df: DataFrame, origins: DataFrame, by: list[str], data_cols: list[str], pos_col: str, shape: tuple[int, int], pad_mode: str = "constant", fill: float = 0.0) -> DataFrame:
    """by, crop, origin_trace, origin_sample, row and the cropped ``data_cols``: a row for each trace of a crop, ``shape[1]`` samples long.

    ``pos_col`` numbers a gather's traces from 0; all of a gather's components have equally long traces.
    """
    length = sizes(df, by, data_cols[0])
    rows = origins.join(length, by).withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(shape[0] - 1))))
    rows = rows.withColumn("_trace", standing_for(F.col("origin_trace") + F.col("row"), F.col("n_traces"), pad_mode))
    held = df.select(*by, F.col(pos_col).cast("long").alias("_trace"), *(samples(F.col(c)).alias(c) for c in data_cols))
    joined = rows.join(held, [*by, "_trace"], "left")

    def cut(c):
        def one(i):
            at = standing_for(F.col("origin_sample") + i, F.col("n_samples").cast("long"), pad_mode)
            return F.coalesce(F.get(c, at.cast("int")), F.lit(float(fill))) if pad_mode == "constant" else F.get(c, at.cast("int"))

        return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(shape[1] - 1).cast("long")), one)

    return joined.select(*by, "crop", "origin_trace", "origin_sample", "row", *(cut(c).alias(c) for c in data_cols))


def assembled(cropped: DataFrame, gathers: DataFrame, by: list[str], data_col: str) -> DataFrame:
    """by, trace, i, x: crops put back where they were, averaged where they overlap, without what was padded (``gathers``: sizes())."""
    long = cropped.join(gathers, by).select(*by, "n_traces", "n_samples", (F.col("origin_trace") + F.col("row")).alias("trace"), "origin_sample", F.posexplode(data_col).alias("k", "x"))
    long = long.withColumn("i", F.col("origin_sample") + F.col("k")).where("trace < n_traces and i < n_samples and not isnan(x)")
    return long.groupBy(*by, "trace", "i").agg(F.avg("x").alias("x"))
