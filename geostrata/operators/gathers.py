"""Kernels of traces and gathers that stay in the JVM: scaling, gain, masks and picks, moveout, stacks and coherency."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geostrata.functions.arrays import bound, element, moments, piecewise, running_sums, samples, valid
from geostrata.operators.quantiles import exact_quantiles

EPS = 1e-10
#: The default velocity table: times in ms and velocities in m/s, fixed values.
DEFAULT_VELOCITY = ([0.0, 600.0, 1200.0, 1800.0, 2400.0, 3000.0, 3600.0, 4200.0, 4800.0, 5400.0, 6000.0], [1594.3, 1844.5, 2213.6, 2634.5, 3102.3, 3741.0, 4068.2, 4245.7, 4367.2, 4479.7, 4559.5])


def through_knots(t: np.ndarray, knots: tuple[list[float], list[float]]) -> np.ndarray:
    """A piecewise-linear function on the driver, extrapolated with the slopes of its ends."""
    x, y = (np.asarray(v, float) for v in knots)
    out = np.interp(t, x, y)
    if len(x) > 1:
        out = np.where(t < x[0], y[0] + (t - x[0]) * (y[1] - y[0]) / (x[1] - x[0]), out)
        out = np.where(t > x[-1], y[-1] + (t - x[-1]) * (y[-1] - y[-2]) / (x[-1] - x[-2]), out)
    return out


def exploded(df: DataFrame, data_col: str, keep: list[str]) -> DataFrame:
    """keep, i, x: one row per sample that is not missing."""
    return df.select(*keep, F.posexplode(samples(F.col(data_col))).alias("i", "x")).where(~F.isnan("x"))


def stats(df: DataFrame, data_col: str, by: list[str] = ()) -> DataFrame:
    """Number, least, greatest, mean and deviation of all samples, merged from each trace's: no sample is shuffled."""
    m, a = moments(F.col(data_col)), valid(F.col(data_col))
    per = df.select(*by, m.alias("m"), F.array_min(a).alias("low"), F.array_max(a).alias("high")).where("m.n > 0")
    n, mean, std = F.col("m.n"), F.col("m.mean"), F.col("m.std")
    out = per.groupBy(*by).agg(F.sum(n).alias("n"), F.min("low").alias("min"), F.max("high").alias("max"), F.sum(n * mean).alias("_s"), F.sum(n * (std * std + mean * mean)).alias("_q"))
    center = F.try_divide(F.col("_s"), F.col("n"))
    return out.select(*by, "n", "min", "max", center.alias("mean"), F.sqrt(F.greatest(F.try_divide(F.col("_q"), F.col("n")) - center * center, F.lit(0.0))).alias("std"))


def quantiles(df: DataFrame, data_col: str, q: list[float], by: list[str] = (), sample_traces: int | None = None, seed: int = 0, tie: str | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation, of all samples or of those of a number of traces drawn by hash."""
    if sample_traces:
        df = df.orderBy(F.xxhash64(F.lit(seed), F.col(tie))).limit(sample_traces)
    return exact_quantiles(df, data_col, q, list(by))


def trace_quantile(data: Column, q: float) -> Column:
    def of(a):
        at = (F.size(a) - 1) * F.lit(float(q))
        low = F.floor(at).cast("int")
        x0, x1 = F.get(a, low), F.get(a, F.least(low + 1, F.size(a) - 1))
        return x0 + (x1 - x0) * (at - low)

    return bound(F.array_sort(valid(data)), of)


def _scaled(data: Column, shift: Column, scale: Column, low=None, high=None) -> Column:
    def of(v):
        f = lambda x: (x - v["shift"]) / v["scale"]
        return F.transform(samples(data), f if low is None else lambda x: F.greatest(F.least(f(x), F.lit(high)), F.lit(low)))

    return bound(F.struct(shift.alias("shift"), scale.alias("scale")), of)


def scale_standard(df: DataFrame, data_col: str, by: list[str] | None = None, out: str = "scaled", eps: float = EPS) -> DataFrame:
    """(x - mean) / (std + eps) by trace; by gather with ``by``, over all with an empty ``by``: statistics join back, one row each."""
    if by is None:
        return df.withColumn(out, bound(moments(F.col(data_col)), lambda m: _scaled(F.col(data_col), m["mean"], m["std"] + eps)))
    found = stats(df, data_col, by).select(*by, F.col("mean").alias("_mean"), F.col("std").alias("_std"))
    joined = df.join(found, by) if by else df.crossJoin(F.broadcast(found))
    return joined.withColumn(out, _scaled(F.col(data_col), F.col("_mean"), F.col("_std") + eps)).drop("_mean", "_std")


def _with_quantiles(df: DataFrame, data_col: str, low: float, high: float, by: list[str] | None) -> DataFrame:
    """``df`` with columns _low and _high: quantiles of each trace, of a gather with ``by``, or of all with an empty ``by``."""
    if by is None:
        return df.withColumn("_low", trace_quantile(F.col(data_col), low)).withColumn("_high", trace_quantile(F.col(data_col), high))
    if (low, high) == (0.0, 1.0):  # extremes are merged from each trace's, and no sample is shuffled
        found = stats(df, data_col, by).select(*by, F.col("min").alias("_low"), F.col("max").alias("_high"))
    else:
        found = exact_quantiles(df, data_col, [low, high], by, ["_low", "_high"])
    return df.join(found, by) if by else df.crossJoin(F.broadcast(found))  # one row


def scale_maxabs(df: DataFrame, data_col: str, q_min: float = 0.0, q_max: float = 1.0, clip: bool = False, out: str = "scaled", eps: float = EPS, by: list[str] | None = None) -> DataFrame:
    """x over the greater size of two quantiles, by trace; by gather with ``by``, over all with an empty ``by``."""
    scale = F.greatest(F.abs("_low"), F.abs("_high")) + eps
    return _with_quantiles(df, data_col, q_min, q_max, by).withColumn(out, _scaled(F.col(data_col), F.lit(0.0), scale, *((-1.0, 1.0) if clip else ()))).drop("_low", "_high")


def scale_minmax(df: DataFrame, data_col: str, q_min: float = 0.0, q_max: float = 1.0, clip: bool = False, out: str = "scaled", eps: float = EPS, by: list[str] | None = None) -> DataFrame:
    """(x - low) / (high - low) for two quantiles, by trace; by gather with ``by``, over all with an empty ``by``."""
    return _with_quantiles(df, data_col, q_min, q_max, by).withColumn(out, _scaled(F.col(data_col), F.col("_low"), F.col("_high") - F.col("_low") + eps, *((0.0, 1.0) if clip else ()))).drop("_low", "_high")


def agc_coefs(data: Column, n: int, window: int, mode: str = "rms") -> Column:
    """Gain of every sample: the number of non-zero samples in the window over their sum (of squares, and its root, for rms).

    The window's centre is clamped so that the ends hold the first and last full window's gain. Sums come from one running sum.
    """
    if not 3 <= window <= n:
        raise ValueError("a window has 3 samples at least and the trace's at most")
    amp = F.transform(samples(data), lambda x: F.when(F.isnan(x) | (x == 0), F.lit(0.0)).otherwise(x * x if mode == "rms" else F.abs(x)))
    half, end = window // 2, n - (window - window // 2)
    centre = lambda i: F.greatest(F.lit(half), F.least(i, F.lit(end)))
    sums = bound(amp, lambda x: F.struct(running_sums(x).alias("s"), running_sums(F.transform(x, lambda v: (v > 0).cast("double"))).alias("k")))

    def coefs(acc):
        def one(i):
            low, high = centre(i) - half, centre(i) - half + window
            c = (F.get(acc["k"], high) - F.get(acc["k"], low)) / (F.get(acc["s"], high) - F.get(acc["s"], low) + F.lit(1e-15))
            return F.sqrt(c) if mode == "rms" else c

        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), one)

    return bound(sums, coefs)


def apply_agc(df: DataFrame, data_col: str, n: int, window_ms: float = 250.0, interval: float = 2.0, mode: str = "rms", out: str = "gained", coefs: str = "agc_coefs") -> DataFrame:
    window = int(window_ms // interval) + 1
    return df.withColumn(coefs, agc_coefs(F.col(data_col), n, window, mode)).withColumn(out, F.zip_with(samples(F.col(data_col)), coefs, lambda x, c: x * c))


def undo_agc(df: DataFrame, data_col: str, coefs: str, out: str = "restored") -> DataFrame:
    return df.withColumn(out, F.zip_with(samples(F.col(data_col)), coefs, lambda x, c: x / c))


def sdc_coefs(n: int, interval: float, delay: float = 0.0, velocity=DEFAULT_VELOCITY, v_pow: float = 2, t_pow: float = 1) -> list[float]:
    """v ** v_pow * t ** t_pow at every sample, over its value at the last."""
    t = delay + interval * np.arange(n)
    c = through_knots(t, velocity) ** v_pow * t**t_pow
    return (c / c[-1]).tolist()


def apply_sdc(df: DataFrame, data_col: str, n: int, interval: float, out: str = "corrected", undo: bool = False, **kwargs) -> DataFrame:
    c = F.array(*(F.lit(v) for v in sdc_coefs(n, interval, **kwargs)))
    return df.withColumn(out, F.zip_with(samples(F.col(data_col)), c, (lambda x, k: F.coalesce(F.try_divide(x, k), F.lit(float("nan")))) if undo else (lambda x, k: x * k)))


def pick_to_mask(time: Column, n: int, interval: float, delay: float = 0.0) -> Column:
    """0 before a first break and 1 from it on."""
    first = F.rint((time - delay) / interval)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i >= first).cast("int"))


def mask_to_pick(mask: Column, interval: float, delay: float = 0.0, threshold: float = 0.5) -> Column:
    """The time at which the first of the longest runs of values over the threshold starts; the delay without one."""
    def step(acc, x):
        now = F.when(x["on"], acc["now"] + 1).otherwise(0)
        longer = now > acc["length"]
        return F.struct(F.when(longer, x["i"] - now + 1).otherwise(acc["start"]).alias("start"), F.when(longer, now).otherwise(acc["length"]).alias("length"), now.alias("now"))

    numbered = F.transform(mask, lambda x, i: F.struct((x >= threshold).alias("on"), i.alias("i")))
    best = F.aggregate(numbered, F.struct(F.lit(0).alias("start"), F.lit(0).alias("length"), F.lit(0).alias("now")), step)
    return best["start"] * F.lit(float(interval)) + F.lit(float(delay))


def mute(data: Column, time: Column, interval: float, delay: float = 0.0, fill: float = float("nan")) -> Column:
    first = F.rint((time - delay) / interval)
    return F.transform(samples(data), lambda x, i: F.when(i >= first, x).otherwise(F.lit(fill)))


def muting_time(offset: Column, knots: tuple[list[float], list[float]]) -> Column:
    return piecewise(offset, *knots)


def muter_from_refractors(params: dict[str, float], delay: float = 0.0, velocity_reduction: float = 0.0) -> tuple[list[float], list[float]]:
    """Knots of a muter below a near-surface model: velocities reduced, times shifted by the delay."""
    xs, ts, vs = refractor_knots(params)
    vs = [v - velocity_reduction for v in vs]
    if min(vs) <= 0:
        raise ValueError("velocities have to stay positive")
    times = [params["t0"] + delay]
    for a, b, v in zip(xs, xs[1:], vs):
        times.append(times[-1] + (b - a) * 1000 / v)
    return xs, times


def refractor_knots(params: dict[str, float], reach: float = 10_000.0) -> tuple[list[float], list[float], list[float]]:
    """Offsets and times of the knots of a near-surface model, and its velocities; the last layer goes on for ``reach``."""
    n = sum(k[0] == "v" for k in params)
    xs = [0.0, *(params[f"x{i}"] for i in range(1, n))]
    vs = [params[f"v{i}"] for i in range(1, n + 1)]
    xs.append(xs[-1] + reach)
    ts = [params["t0"]]
    for a, b, v in zip(xs, xs[1:], vs):
        ts.append(ts[-1] + (b - a) * 1000 / v)
    return xs, ts, vs


def refractor_time(offset: Column, params: dict[str, float]) -> Column:
    xs, ts, _ = refractor_knots(params)
    return piecewise(offset, xs, ts)


def shifted(data: Column, by: Column, fill: float = float("nan")) -> Column:
    """Samples moved ``by`` positions towards later times, filled where none comes from."""
    n = F.size(data)
    d = samples(data)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(element(d, i - by), F.lit(fill)))


def apply_lmo(df: DataFrame, data_col: str, offset_col: str, params: dict[str, float], interval: float, delay: float = 100.0, fill: float = float("nan"), uphole_col: str | None = None, event_cols: list[str] = (), out: str = "corrected") -> DataFrame:
    """Traces moved so that the expected first break is at ``delay``; event times move by the unrounded shift."""
    shift = F.lit(float(delay)) - refractor_time(F.col(offset_col), params) + (F.col(uphole_col) if uphole_col else 0.0)
    df = df.withColumn("_shift", shift)
    df = df.withColumn(out, shifted(F.col(data_col), F.rint(F.col("_shift") / interval).cast("int"), fill))
    return df.withColumns({c: F.col(c) + F.col("_shift") for c in event_cols}).drop("_shift")


def along_times(data: Column, at: Column, interpolate: bool = True, fill: float = float("nan")) -> Column:
    """The amplitude at a fractional position: linear between its neighbours, or the nearest; ``fill`` outside."""
    d, n = samples(data), F.size(data)
    if not interpolate:
        i = F.round(at).cast("int")
        return F.when((i >= 0) & (i < n), F.get(d, i)).otherwise(F.lit(fill))
    low = F.floor(at).cast("int")
    w = at - low
    return F.when((at >= 0) & (at <= n - 1), F.get(d, low) * (1 - w) + F.get(d, F.least(low + 1, n - 1)) * w).otherwise(F.lit(fill))


def apply_nmo(df: DataFrame, data_col: str, offset_col: str, n: int, interval: float, velocity: float | tuple[list[float], list[float]], by: list[str] = (), max_stretch_factor: float = float("inf"), delay: float = 0.0, fill: float = float("nan"), interpolate: bool = True, out: str = "corrected") -> DataFrame:
    """Hyperbolic moveout removed with a constant velocity or one that changes with time (m/s; times in ms, offsets in m).

    Time t reads the trace at sqrt(t**2 + (offset / v)**2). With a constant velocity offsets of t * v * sqrt((1 + s)**2 - 1) and
    more are stretched too much. With a changing one the corrected zero-offset time t - offset**2 * v' / v**3 tells what is
    reversed or stretched too much; what is muted so at one offset of a gather (``by``) is muted at all larger ones, and what is at
    a later time is at all earlier ones: a window over the gather's traces by offset.
    """
    t = [delay + interval * i for i in range(n)]
    constant, s = isinstance(velocity, (int, float)), float(max_stretch_factor)
    v = [velocity / 1000.0] * n if constant else (through_knots(np.array(t), velocity) / 1000).tolist()
    grad = [0.0] * n if constant or n < 2 else np.gradient(np.array(v), interval).tolist()
    axis = F.array(*(F.struct(F.lit(float(a)).alias("t"), F.lit(float(b)).alias("v"), F.lit(float(g)).alias("g")) for a, b, g in zip(t, v, grad)))
    x = F.abs(F.col(offset_col).cast("double"))
    hyperbola = lambda p: F.sqrt(p["t"] * p["t"] + x / p["v"] * (x / p["v"]))
    read = lambda p: along_times(F.col(data_col), (hyperbola(p) - delay) / interval, interpolate, fill)
    if constant:
        kept = (lambda p: F.lit(True)) if s == float("inf") else lambda p: hyperbola(p) < (1 + s) * p["t"]
        return df.withColumn(out, F.transform(axis, lambda p: F.when(kept(p), read(p)).otherwise(F.lit(fill))))

    def muted(p, i):
        zero = p["t"] - x * x * p["g"] / (p["v"] * p["v"] * p["v"])
        bad = (zero <= 0) if s == float("inf") else (zero <= 0) | (hyperbola(p) > (1 + s) * zero)
        return F.when(bad, i).otherwise(F.lit(-1))

    # the last muted position of a trace itself, then of all traces of its gather that are no further away
    df = df.withColumn("_own", F.array_max(F.transform(axis, muted))).withColumn("_x", x)
    df = df.withColumn("_last", F.max("_own").over(Window.partitionBy(*by).orderBy("_x").rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    return df.withColumn(out, F.transform(axis, lambda p, i: F.when(i <= F.col("_last"), F.lit(fill)).otherwise(read(p)))).drop("_own", "_x", "_last")


def stack(df: DataFrame, data_col: str, by: list[str], amplify_factor: float = 0.0) -> DataFrame:
    """by, i, stacked: the samples of a gather summed over its traces with weight a / sqrt(N) + (1 - a) / N."""
    return exploded(df, data_col, by).groupBy(*by, "i").agg(F.sum("x").alias("_s"), F.count("*").alias("_n")).select(*by, "i", (F.col("_s") * (amplify_factor / F.sqrt("_n") + (1 - amplify_factor) / F.col("_n"))).alias("stacked"))


COHERENCY = {
    "S": (lambda s, e, a, n: F.abs(s) / n, lambda s, e, a, n: F.lit(1.0)),
    "NS": (lambda s, e, a, n: F.abs(s), lambda s, e, a, n: a),
    "SEMBLANCE": (lambda s, e, a, n: s * s / n, lambda s, e, a, n: e),
    "CC": (lambda s, e, a, n: (s * s - e) / 2, lambda s, e, a, n: F.lit(1.0)),
    "ENCC": (lambda s, e, a, n: (s * s - e) / F.greatest(n - 1, F.lit(1)), lambda s, e, a, n: e),
}


def coherency(df: DataFrame, data_col: str, by: list[str], mode: str, half_window: int = 0) -> DataFrame:
    """by, i, coherency: a measure of likeness of a gather's traces at each sample, over a window [i - h, i + h) if h > 0."""
    parts = exploded(df, data_col, by).groupBy(*by, "i").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("e"), F.sum(F.abs("x")).alias("a"), F.count("*").alias("n"))
    num, den = (f(F.col("s"), F.col("e"), F.col("a"), F.col("n")) for f in COHERENCY[mode])
    parts = parts.withColumn("_num", num).withColumn("_den", den)
    if half_window:
        w = Window.partitionBy(*by).orderBy("i").rowsBetween(-half_window, half_window - 1)
        parts = parts.withColumn("_num", F.sum("_num").over(w)).withColumn("_den", F.sum("_den").over(w))
    return parts.select(*by, "i", (F.col("_num") / (F.col("_den") + 1e-8)).alias("coherency"))
