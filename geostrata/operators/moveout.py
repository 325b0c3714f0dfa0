"""Moveout with a model of its own for every gather: near-surface models or velocity functions of a field, joined to traces.

Models are prepared in the field's table, a row each, and travel to the traces of their gather by a join that Spark may broadcast or split where
a gather is large. Corrections are expressions over a trace's row. Where a mute looks at a whole gather, only its offsets meet, not its samples.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geostrata.functions.arrays import bound
from geostrata.operators.fields import at_array
from geostrata.operators.gathers import COHERENCY, along_times, shifted, through_knots
from geostrata.operators.muters import from_refractors
from geostrata.operators.velocity import PART_TRACES, nmo_matrix


def lmo_by_model(df: DataFrame, models: DataFrame, by: list[str], data_col: str, offset_col: str, n_refractors: int, interval: float, delay: float = 100.0, fill: float = float("nan"), uphole_col: str | None = None, event_cols: list[str] = (), out: str = "corrected") -> DataFrame:
    """Traces moved so that the first break that their gather's near-surface model (by, t0, x1.., v1..) expects is at ``delay``.

    Event times move by the unrounded shift. Traces of gathers without a model are dropped by the join, as nothing is known of them.
    With ``uphole_col`` the model's column ``is_uphole_corrected``, if there is one, tells whether a trace's uphole time is added.
    """
    flag = ["is_uphole_corrected"] if uphole_col and "is_uphole_corrected" in models.columns else []
    curves = from_refractors(models, [*by, *flag], n_refractors).withColumnsRenamed({"x": "_xs", "y": "_ts"})
    joined = df.join(curves, by)
    uphole = F.lit(0.0) if not uphole_col else F.col(uphole_col) if not flag else F.when(F.col(flag[0]), F.col(uphole_col)).otherwise(0.0)
    joined = joined.withColumn("_shift", F.lit(float(delay)) - at_array(F.col("_xs"), F.col("_ts"), F.col(offset_col).cast("double")) + uphole)
    moved = joined.withColumn(out, shifted(F.col(data_col), F.rint(F.col("_shift") / interval).cast("int"), fill))
    return moved.withColumns({c: F.col(c) + F.col("_shift") for c in event_cols}).drop("_shift", "_xs", "_ts", *flag)


def time_axis(t: str, v: str, n: int, interval: float, delay: float = 0.0) -> Column:
    """array of (t, v in m/ms, its central difference by t) at every sample, from columns of a function's knots in ms and m/s."""
    times = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(float(delay)) + i * F.lit(float(interval)))
    speeds = F.transform(times, lambda x: at_array(F.col(t), F.col(v), x) / 1000)

    def of(speed):
        def row(x, i):
            low, high = F.greatest(i - 1, F.lit(0)), F.least(i + 1, F.lit(n - 1))
            slope = F.coalesce(F.try_divide(F.get(speed, high) - F.get(speed, low), (high - low) * F.lit(float(interval))), F.lit(0.0))
            return F.struct(x.alias("t"), F.get(speed, i).alias("v"), slope.alias("g"))

        return F.transform(times, row)

    return bound(speeds, of)


def nmo_by_model(df: DataFrame, models: DataFrame, by: list[str], data_col: str, offset_col: str, n: int, interval: float, t: str = "t", v: str = "v", max_stretch_factor: float = float("inf"), delay: float = 0.0, fill: float = float("nan"), interpolate: bool = True, out: str = "corrected") -> DataFrame:
    """Hyperbolic moveout removed with the velocity function (by, arrays of knots ``t`` and ``v``) of each trace's gather.

    What is reversed or stretched too much at one offset is muted there, at earlier times, and at all larger offsets of its gather. That
    limit is worked out of (gather, offset, last bad sample) alone, so a gather of any size moves its samples only in the join.
    """
    axes = models.select(*by, time_axis(t, v, n, interval, delay).alias("_axis"))
    x, s = F.col("_x"), float(max_stretch_factor)
    hyperbola = lambda p: F.sqrt(p["t"] * p["t"] + x / p["v"] * (x / p["v"]))

    def bad(p, i):
        zero = p["t"] - x * x * p["g"] / (p["v"] * p["v"] * p["v"])
        return F.when((zero <= 0) if s == float("inf") else (zero <= 0) | (hyperbola(p) > (1 + s) * zero), i).otherwise(F.lit(-1))

    offset = F.abs(F.col(offset_col).cast("double")).alias("_x")
    own = df.select(*by, offset).distinct().join(axes, by).select(*by, "_x", F.array_max(F.transform("_axis", bad)).alias("_own"))
    last = own.select(*by, "_x", F.max("_own").over(Window.partitionBy(*by).orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)).alias("_last"))
    joined = df.withColumn("_x", offset).join(axes, by).join(last, [*by, "_x"])
    read = lambda p, i: F.when(i <= F.col("_last"), F.lit(fill)).otherwise(along_times(F.col(data_col), (hyperbola(p) - delay) / interval, interpolate, fill))
    return joined.withColumn(out, F.transform("_axis", read)).drop("_axis", "_x", "_last")


def residual_grid(v0: np.ndarray, margin: float, step: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The trial velocities around a function's values, and for every value the first and the last of them that it needs."""
    left, right = v0 * (1 - margin), v0 * (1 + margin)
    grid = left.min() + step * np.arange(math.ceil((right.max() - left.min()) / step) + 1)
    near = lambda x: np.abs(x[:, None] - grid).argmin(1)
    return grid, near(left), near(right)


def residual_spectra(df: DataFrame, models: DataFrame, by: list[str], data_col: str, offset_col: str, interval: float, n_samples: int, t: str = "t", v: str = "v", relative_margin: float = 0.2, velocity_step: float = 25.0, window_ms: float = 50.0, mode: str = "SEMBLANCE", max_stretch_factor: float = np.inf, delay: float = 0.0) -> DataFrame:
    """by, t_ix, m_ix, margin, value: coherency around each gather's own velocity function, on a grid of relative margins.

    A trial velocity is stacked only at the times whose margins reach it, and half a window around them. Tasks stack at most
    PART_TRACES traces of a gather; their sums are added. Between trial velocities values are linear.
    """
    half = max(math.ceil(window_ms / interval / 2), 1)
    times = delay + interval * np.arange(n_samples)
    kinds = {c: df.schema[c].dataType.simpleString() for c in by}

    def stacked(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(offset_col, kind="stable")
        v0 = through_knots(times, (frame["_t"].iloc[0], frame["_v"].iloc[0]))
        grid, low, high = residual_grid(v0, relative_margin, velocity_step)
        data, offsets, made = np.stack(frame[data_col].to_numpy()).astype(float), np.abs(frame[offset_col].to_numpy(float)), []
        for k, speed in enumerate(grid):
            needed = np.flatnonzero((low <= k) & (k <= high))
            if len(needed):
                at = np.arange(max(0, needed[0] - half), min(n_samples - 1, needed[-1] + half) + 1)
                x = nmo_matrix(data, offsets, interval, times[at], speed / 1000, max_stretch_factor, delay)
                made.append(pd.DataFrame({"v_ix": k, "t_ix": at, "s": np.nansum(x, 1), "e": np.nansum(x * x, 1), "a": np.nansum(np.abs(x), 1), "n": (~np.isnan(x)).sum(1)}))
        out = pd.concat(made)
        for name, value in zip(reversed(by), reversed(key[:-1])):
            out.insert(0, name, value)
        return out

    def planned(frames):
        for f in frames:
            for _, row in f.iterrows():
                v0 = through_knots(times, (row["_t"], row["_v"]))
                grid, low, high = residual_grid(v0, relative_margin, velocity_step)
                count = max(int((high - low).max()), 1)
                yield pd.DataFrame({c: [row[c]] * n_samples for c in by} | {"t_ix": range(n_samples), "_v0": v0, "_low": low, "_high": high, "_first": grid[0], "_count": count})

    knots = models.select(*by, F.col(t).alias("_t"), F.col(v).alias("_v"))
    sizes = df.groupBy(*by).agg(F.ceil(F.count("*") / PART_TRACES).alias("_parts"))
    parted = df.select(*by, offset_col, data_col).join(knots, by).join(sizes, by).withColumn("_part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("_parts")).cast("int"))
    keys = "".join(f"{c} {k}, " for c, k in kinds.items())
    sums = parted.groupBy(*by, "_part").applyInPandas(stacked, keys + "v_ix int, t_ix int, s double, e double, a double, n long").groupBy(*by, "v_ix", "t_ix").agg(*(F.sum(c).alias(c) for c in ("s", "e", "a", "n")))
    num, den = (f(F.col("s"), F.col("e"), F.col("a"), F.greatest("n", F.lit(1))) for f in COHERENCY[mode])
    last = F.col("t_ix") == n_samples - 1
    sums = sums.withColumns({"_num": F.when(last, 0.0).otherwise(num), "_den": F.when(last, 0.0).otherwise(den)})
    near = Window.partitionBy(*by, "v_ix").orderBy("t_ix").rowsBetween(-half, half - 1)
    cells = sums.select(*by, "t_ix", "v_ix", (F.sum("_num").over(near) / (F.sum("_den").over(near) + 1e-8)).alias("value"))
    plan = knots.mapInPandas(planned, keys + "t_ix int, _v0 double, _low int, _high int, _first double, _count int")
    rows = cells.join(plan, [*by, "t_ix"]).where("v_ix between _low and _high").groupBy(*by, "t_ix", "_v0", "_low", "_high", "_first", "_count")
    rows = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("v_ix", "value"))), lambda r: r["value"]).alias("_row"))  # as many as trial velocities
    step = F.coalesce(F.try_divide(F.lit(2.0 * relative_margin), F.col("_count") - 1), F.lit(0.0))
    rows = rows.withColumn("m_ix", F.explode(F.sequence(F.lit(0), F.col("_count") - 1))).withColumn("margin", F.col("m_ix") * step - relative_margin)
    place = F.least(F.greatest((F.col("_v0") * (1 + F.col("margin")) - F.col("_first")) / velocity_step - F.col("_low"), F.lit(0.0)), (F.col("_high") - F.col("_low")).cast("double"))
    at = F.least(F.floor(place).cast("int"), F.col("_high") - F.col("_low"))
    above = F.coalesce(F.get("_row", at + 1), F.get("_row", at))
    return rows.select(*by, "t_ix", "m_ix", "margin", (F.get("_row", at) + (above - F.get("_row", at)) * (place - at)).alias("value"))
