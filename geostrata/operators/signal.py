"""Filtering, resampling and cropping of traces. Kernels see a batch of traces as one matrix."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geostrata.functions.arrays import running_sums, samples


def fir(low: float | None, high: float | None, interval: float, size: int = 81, window=np.hamming) -> np.ndarray:
    """Coefficients of a linear-phase filter that passes [low, high] Hz, one at the middle of the band."""
    size += 1 - size % 2
    nyquist = 500 / interval
    band = lambda f: (f / nyquist) * np.sinc(f / nyquist * (np.arange(size) - size // 2))
    h = (band(high) if high is not None else band(nyquist)) - (band(low) if low is not None else 0)
    h = h * window(size)
    middle = 0.0 if low is None else (nyquist if high is None else (low + high) / 2)
    return h / np.sum(h * np.cos(np.pi * middle / nyquist * (np.arange(size) - size // 2)))


def _traces(df: DataFrame, data_col: str, out: str, kernel) -> DataFrame:
    @F.pandas_udf("array<double>")
    def run(series: pd.Series) -> pd.Series:
        lengths = series.map(len)
        made = [None] * len(series)
        for n in lengths.unique():
            at = np.flatnonzero(lengths == n)
            for i, row in zip(at, kernel(np.stack(series.iloc[at].to_numpy()).astype(float)) if n else [np.zeros(0)] * len(at)):
                made[i] = row
        return pd.Series(made, dtype=object)

    return df.withColumn(out, run(samples(F.col(data_col))))


def bandpass(df: DataFrame, data_col: str, interval: float, low: float | None = None, high: float | None = None, size: int = 81, out: str = "filtered") -> DataFrame:
    h = fir(low, high, interval, size)
    half = len(h) // 2

    def kernel(x):
        padded = np.pad(x, ((0, 0), (half, half)), mode="reflect")
        return np.lib.stride_tricks.sliding_window_view(padded, len(h), 1) @ h[::-1]

    return _traces(df, data_col, out, kernel)


def lagrange_matrix(at: np.ndarray, n: int, degree: int) -> np.ndarray:
    """Weights of n samples for polynomials of a degree through the nearest samples; ends are mirrored."""
    m = np.zeros((len(at), n))
    for r, x in enumerate(at):
        first = int(np.floor(x)) - (degree - 1) // 2 if degree % 2 else int(np.rint(x)) - degree // 2
        knots = np.arange(first, first + degree + 1)
        for k in knots:
            w = np.prod([(x - j) / (k - j) for j in knots if j != k]) if degree else 1.0
            i = abs(k)
            m[r, i if i < n else max(2 * (n - 1) - i, 0)] += w
    return m


def resample(df: DataFrame, data_col: str, n: int, interval: float, new_interval: float, kind: int = 3, anti_alias: bool = True, out: str = "resampled") -> DataFrame:
    """Traces of n samples on a new interval; before thinning out, a low-pass at 0.9 of the new Nyquist frequency."""
    at = np.arange(0, (n - 1) * interval + 1e-9, new_interval) / interval
    m = lagrange_matrix(at, n, kind)
    h = fir(None, 0.9 * 500 / new_interval, interval, int(40 * new_interval / interval) + 1, np.hanning) if anti_alias and new_interval > interval else None

    def kernel(x):
        if h is not None:
            half = min(len(h) // 2, x.shape[1] - 1)
            g = h[len(h) // 2 - half : len(h) // 2 + half + 1]
            x = np.lib.stride_tricks.sliding_window_view(np.pad(x, ((0, 0), (half, half)), mode="reflect"), len(g), 1) @ g[::-1]
        return x @ m.T

    return _traces(df, data_col, out, kernel)


def resample_linear(data: Column, n: int, interval: float, new_interval: float) -> Column:
    """Linear resampling within the row: each new sample between two old ones."""
    a = samples(data)
    count = int((n - 1) * interval / new_interval + 1e-9) + 1

    def one(k):
        at = k * F.lit(new_interval / interval)
        low = F.floor(at).cast("int")
        return F.get(a, low) * (1 - (at - low)) + F.get(a, F.least(low + 1, F.lit(n - 1))) * (at - low)

    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), one)


def grid_origins(size: int, crop: int, stride: int) -> list[int]:
    """0, stride, ... and the last origin at which a crop still fits."""
    last = max(size - crop, 0)
    return sorted({*range(0, last, stride), last})


def crop(df: DataFrame, data_col: str, pos_col: str, n_traces: int, n_samples: int, shape: tuple[int, int], stride: tuple[int, int], by: list[str] = ()) -> DataFrame:
    """by, origin_trace, origin_sample, row, data: pieces of gathers at grid origins. Traces are numbered by ``pos_col``."""
    traces, times = grid_origins(n_traces, shape[0], stride[0]), grid_origins(n_samples, shape[1], stride[1])
    at = F.filter(F.array(*(F.lit(t) for t in traces)), lambda o: (F.col(pos_col) >= o) & (F.col(pos_col) < o + shape[0]))
    cut = df.select(*by, pos_col, data_col, F.explode(at).alias("origin_trace")).select("*", F.explode(F.array(*(F.lit(t) for t in times))).alias("origin_sample"))
    return cut.select(*by, "origin_trace", "origin_sample", (F.col(pos_col) - F.col("origin_trace")).cast("int").alias("row"), F.slice(data_col, F.col("origin_sample") + 1, F.lit(shape[1])).alias("data"))


def assemble(crops: DataFrame, by: list[str] = ()) -> DataFrame:
    """by, trace, i, x: crops put back, averaged where they overlap."""
    long = crops.select(*by, (F.col("origin_trace") + F.col("row")).alias("trace"), "origin_sample", F.posexplode("data").alias("k", "x"))
    return long.groupBy(*by, "trace", (F.col("origin_sample") + F.col("k")).alias("i")).agg(F.avg("x").alias("x"))


def model_inputs(df: DataFrame, by: list[str], order: str, data_col: str) -> DataFrame:
    """A gather's traces joined end to end, with their sizes, for a model; ``split_outputs`` undoes it."""
    rows = F.array_sort(F.collect_list(F.struct(order, data_col)))
    return df.groupBy(*by).agg(F.flatten(F.transform(rows, lambda r: r[data_col])).alias("input"), F.transform(rows, lambda r: F.size(r[data_col])).alias("sizes"))


def split_outputs(df: DataFrame, by: list[str], output: str = "input", sizes: str = "sizes") -> DataFrame:
    ends = F.transform(F.slice(running_sums(F.col(sizes).cast("array<double>")), 2, F.size(sizes)), lambda x: x.cast("int"))
    return df.withColumn("_ends", ends).select(*by, F.posexplode(F.zip_with("_ends", sizes, lambda e, n: F.slice(output, e - n + 1, n))).alias("row", "data"))
