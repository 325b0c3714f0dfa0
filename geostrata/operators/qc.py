"""Quality control of traces: one value per trace and metric, computed within the row; maps and reports aggregate them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geostrata.functions.arrays import isclose, longest_run, moments, samples, total, valid

EPS = 1e-10


def dead(data: Column) -> Column:
    """1.0 for a trace whose largest and smallest sample agree within tolerance."""
    a = valid(data)
    return isclose(F.array_max(a), F.array_min(a)).cast("double")


def abs_mean(data: Column) -> Column:
    m = moments(data)
    return F.abs(m["mean"] / (m["std"] + EPS))


def max_abs(data: Column) -> Column:
    return F.array_max(F.transform(valid(data), F.abs)) / (moments(data)["std"] + EPS)


def _runs_over_one(flags: Column) -> Column:
    longest = longest_run(flags)
    return F.when(longest > 1, longest).otherwise(0).cast("double")


def max_clips_len(data: Column) -> Column:
    """The longest run, of two samples and more, at the trace's maximum or minimum; on a constant trace both count."""
    a = samples(data)
    high, low = F.array_max(a), F.array_min(a)
    top, bottom = _runs_over_one(F.transform(a, lambda x: x == high)), _runs_over_one(F.transform(a, lambda x: x == low))
    return F.when(high == low, top + bottom).otherwise(F.greatest(top, bottom))


def max_const_len(data: Column) -> Column:
    """The longest run, of two samples and more, of neighbours that agree within tolerance; 0 without one."""
    a = samples(data)
    same = F.zip_with(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), lambda x, y: isclose(y, x))
    longest = longest_run(same)
    return F.when(longest > 0, longest + 1).otherwise(0).cast("double")


def spikes(data: Column) -> Column:
    """The largest absolute second difference over 3, of samples whose neighbours are there."""
    a = samples(data)
    n = F.greatest(F.size(a) - 2, F.lit(0))
    bend = F.zip_with(F.zip_with(F.slice(a, 1, n), F.slice(a, 3, n), lambda x, z: x + z), F.slice(a, 2, n), lambda s, y: F.abs(2 * y - s) / 3)
    return F.coalesce(F.array_max(F.filter(bend, lambda x: ~F.isnan(x))), F.lit(0.0))


def autocorrelation(data: Column, max_nan_fraction: float = 0.95) -> Column:
    """The mean product of neighbours; NaN where too many samples are missing."""
    a = samples(data)
    n = F.greatest(F.size(a) - 1, F.lit(0))
    products = F.filter(F.zip_with(F.slice(a, 1, n), F.slice(a, 2, n), lambda x, y: x * y), lambda x: ~F.isnan(x))
    return F.when(F.size(valid(data)) < (1 - max_nan_fraction) * F.size(a), F.lit(float("nan"))).otherwise(F.try_divide(total(products), F.size(products)))


#: name: (expression, whether lower is better, threshold)
METRICS = {
    "dead": (dead, True, 0.5), "abs_mean": (abs_mean, True, 0.1), "max_abs": (max_abs, True, 15.0), "max_clips_len": (max_clips_len, True, 3.0),
    "max_const_len": (max_const_len, True, 4.0), "spikes": (spikes, True, 2.0), "autocorrelation": (autocorrelation, False, 0.8),
}


def qc(df: DataFrame, data_col: str, metrics: list[str] | None = None) -> DataFrame:
    """``df`` with a column per metric; the samples are decoded once, by one projection."""
    return df.withColumns({name: METRICS[name][0](F.col(data_col)) for name in metrics or METRICS})


def is_bad(value: Column, lower_is_better: bool | None, threshold) -> Column:
    """Bad at or beyond the threshold, or outside a closed pair; a missing value never is."""
    if threshold is None:
        raise ValueError("a threshold is needed")
    if isinstance(threshold, (tuple, list)):
        bad = (value < threshold[0]) | (value > threshold[1])
    else:
        bad = value >= threshold if lower_is_better else value <= threshold
    return F.coalesce(bad & ~F.isnan(value.cast("double")), F.lit(False))


def filter_by_metric(df: DataFrame, metric: str, threshold=None, bad_only: bool = False) -> DataFrame:
    _, lower, default = METRICS[metric]
    bad = is_bad(F.col(metric), lower, default if threshold is None else threshold)
    return df.where(bad if bad_only else ~bad)


def remove_dead(df: DataFrame, data_col: str) -> DataFrame:
    return df.where(dead(F.col(data_col)) < 0.5)


def summary(df: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """metric, n_bad, share_bad: one aggregate over all metrics, then one row for each."""
    names = metrics or list(METRICS)
    counts = df.agg(F.count("*").alias("n"), *(F.count_if(is_bad(F.col(m), METRICS[m][1], METRICS[m][2])).alias(m) for m in names))
    return counts.select("n", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("n_bad")) for m in names))).alias("s")).select("s.metric", "s.n_bad", F.try_divide(F.col("s.n_bad"), F.col("n")).alias("share_bad"))


def window_sums(data: Column, start: Column, end: Column) -> Column:
    """struct(squares, n) of the samples in [start, end)."""
    part = F.filter(F.slice(samples(data), start + 1, F.greatest(end - start, F.lit(0))), lambda x: ~F.isnan(x))
    return F.struct(total(part, lambda x: x * x).alias("squares"), F.size(part).alias("n"))


def window_rms(df: DataFrame, data_col: str, offset_col: str, offsets: tuple[float, float], times: tuple[float, float], interval: float, delay: float = 0.0, prefix: str = "rms") -> DataFrame:
    """Sum of squares and count of a window in offset (closed) and time (both ends inclusive); 0 and 0 outside."""
    n = F.size(data_col)
    at = lambda t: F.least(F.greatest(F.rint(F.lit((t - delay) / interval)).cast("int"), F.lit(0)), n - 1)
    inside = F.col(offset_col).between(*offsets)
    found = window_sums(F.col(data_col), at(times[0]), at(times[1]) + 1)
    return df.withColumns({f"{prefix}_squares": F.when(inside, found["squares"]).otherwise(0.0), f"{prefix}_n": F.when(inside, found["n"]).otherwise(0)})


def adaptive_window_rms(df: DataFrame, data_col: str, time: Column, window: float, shift: float, interval: float, delay: float = 0.0, prefix: str = "rms") -> DataFrame:
    """The same for a window of fixed length around a time of each trace."""
    n, w = F.size(data_col), int(window // interval)
    middle = F.rint((time + shift - delay) / interval).cast("int")
    clip = lambda i: F.least(F.greatest(i, F.lit(0)), n - 1)
    found = window_sums(F.col(data_col), clip(middle - (w - w // 2)), clip(middle + w // 2))
    return df.withColumns({f"{prefix}_squares": found["squares"], f"{prefix}_n": found["n"]})


def rms(squares: str, n: str) -> Column:
    return F.sqrt(F.try_divide(F.sum(squares), F.sum(n)))


def rms_describe(df: DataFrame, prefix: str = "rms", threshold=None, lower_is_better: bool | None = None) -> DataFrame:
    """One row: the mean of the traces' own RMS in a window without a threshold, else the number and share of bad traces."""
    own = F.sqrt(F.try_divide(F.col(f"{prefix}_squares"), F.col(f"{prefix}_n")))
    if threshold is None:
        return df.agg(F.avg(own).alias("mean_rms"))
    bad = is_bad(F.coalesce(own, F.lit(float("nan"))), lower_is_better, threshold)
    return df.agg(F.count_if(bad).alias("n_bad"), F.try_divide(F.count_if(bad), F.count("*")).alias("share_bad"))


def rms_map(df: DataFrame, by: list[str], prefix: str = "rms") -> DataFrame:
    return df.groupBy(*by).agg(rms(f"{prefix}_squares", f"{prefix}_n").alias("rms"))


def rms_ratio_map(df: DataFrame, by: list[str], over: str, under: str) -> DataFrame:
    """The ratio of two windows' RMS per group: one aggregate for both, no join."""
    return df.groupBy(*by).agg(F.try_divide(rms(f"{over}_squares", f"{over}_n"), rms(f"{under}_squares", f"{under}_n")).alias("ratio"))
