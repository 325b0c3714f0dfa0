"""Synthetic surveys: grids of sources and receivers, active pairs, midpoints and traces, all as DataFrames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def grid(spark: SparkSession, size: tuple[int, int], origin: tuple[int, int], step: tuple[int, int], names: tuple[str, str]) -> DataFrame:
    """Points of a grid, x outer and y inner, with their ordinal ``n``."""
    nx, ny = (-(-s // d) for s, d in zip(size, step))
    n = F.col("id")
    return spark.range(nx * ny).select(n.alias("n"), (origin[0] + F.floor(n / ny) * step[0]).cast("int").alias(names[0]), (origin[1] + n % ny * step[1]).cast("int").alias(names[1]))


def geometry(spark: SparkSession, survey_size=(300, 300), origin=(0, 0), sources_step=(50, 150), receivers_step=(100, 25), bin_size=(50, 50), activation_dist=(200, 200)) -> DataFrame:
    """Headers of all traces: each source with the receivers in the rectangle around it.

    The rectangle join is an equi-join on cells of its size: a source meets the receivers of its own and the neighbouring cells.
    """
    sources = grid(spark, survey_size, origin, sources_step, ("SourceX", "SourceY")).withColumnRenamed("n", "FieldRecord")
    receivers = grid(spark, survey_size, origin, receivers_step, ("GroupX", "GroupY")).withColumnRenamed("n", "_receiver")
    dx, dy = (max(a, 1) for a in activation_dist)
    near = F.array(*(F.struct((F.floor(F.col("SourceX") / dx) + i).alias("cx"), (F.floor(F.col("SourceY") / dy) + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    pairs = sources.withColumn("c", F.explode(near)).select("*", "c.cx", "c.cy").drop("c").join(receivers.withColumn("cx", F.floor(F.col("GroupX") / dx)).withColumn("cy", F.floor(F.col("GroupY") / dy)), ["cx", "cy"])
    pairs = pairs.where((F.abs(F.col("SourceX") - F.col("GroupX")) <= activation_dist[0]) & (F.abs(F.col("SourceY") - F.col("GroupY")) <= activation_dist[1])).drop("cx", "cy")
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("FieldRecord").orderBy("_receiver")) - 1
    mx, my = (F.col("SourceX") + F.col("GroupX")) / 2, (F.col("SourceY") + F.col("GroupY")) / 2
    il, xl = F.floor(mx / bin_size[0]).cast("int"), F.floor(my / bin_size[1]).cast("int")
    return pairs.select(
        F.col("FieldRecord").cast("int").alias("FieldRecord"), number.alias("TraceNumber"), "SourceX", "SourceY", "GroupX", "GroupY", F.hypot(F.col("SourceX") - F.col("GroupX"), F.col("SourceY") - F.col("GroupY")).cast("int").alias("offset"),
        il.alias("INLINE_3D"), xl.alias("CROSSLINE_3D"), (il * bin_size[0] + bin_size[0] // 2).alias("CDP_X"), (xl * bin_size[1] + bin_size[1] // 2).alias("CDP_Y"), (il * survey_size[1] + xl).alias("CDP"),
    )


def ricker_traces(df: DataFrame, n: int, interval: float, event_times=(20.0, 140.0), amplitudes=(6.0, -8.0), velocities=(1.6, 2.0), width: float = 5.0, offset_col: str = "offset") -> DataFrame:
    """Traces with a Ricker wavelet at the hyperbolic time of each event (velocities in m/ms)."""

    @F.pandas_udf("array<float>")
    def made(offset: pd.Series) -> pd.Series:
        t = interval * np.arange(n)[None]
        x = offset.to_numpy(float)[:, None]
        out = np.zeros((len(offset), n))
        for t0, a, v in zip(event_times, amplitudes, velocities):
            u = ((t - np.sqrt(t0 * t0 + (x / v) ** 2)) / width) ** 2
            out += a * (1 - u) * np.exp(-u / 2)
        return pd.Series(list(out.astype(np.float32)))

    return df.withColumn("data", made(F.col(offset_col)))


def noise_traces(df: DataFrame, n: int, seed: int = 0, key: str = "FieldRecord", other: str = "TraceNumber") -> DataFrame:
    """Standard normal noise that depends only on a trace's key and the seed, by the Box-Muller formula over hashes."""
    u = lambda i, salt: (F.pmod(F.xxhash64(F.col(key), F.col(other), i, F.lit(seed), F.lit(salt)), F.lit(1 << 30)) + 1) / F.lit(float((1 << 30) + 1))
    return df.withColumn("data", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (F.sqrt(-2 * F.ln(u(i, 1))) * F.cos(F.lit(2 * np.pi) * u(i, 2))).cast("float")))
