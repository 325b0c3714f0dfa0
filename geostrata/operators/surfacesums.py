"""Fits of near-surface models to gathers of any size: picks are only ever summed.

Each round is one aggregate over all picks of all gathers: the loss at a gather's tried model, and the sums of the quadratic model around it, a few
dozen numbers for a gather, which partial aggregates make on the map side. A step within the rules (nearsurface.least_within) then turns them into the
next tried model; where a try doesn't lower the loss, the step is damped and taken again from the sums of the model before.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geostrata.operators import nearsurface
from geostrata.sources.scratch import saved

#: Rounds at most, the relative change of the loss that ends a fit, and the bins of a gather's offsets whose means a fit begins with.
ROUNDS, TOLERANCE, BINS = 60, 1e-6, 512


def _loss(r: Column, loss: str, huber: float) -> tuple[Column, Column]:
    """The loss of a residual and the weight of its square, as nearsurface.losses()."""
    a, small = F.abs(r), F.greatest(F.abs(r), F.lit(nearsurface.SMALL))
    return {
        "MSE": lambda: (a * a, F.lit(2.0)), "L1": lambda: (a, 1 / small), "soft_L1": lambda: (2 * (F.sqrt(1 + a) - 1), 1 / (F.sqrt(1 + a) * small)), "cauchy": lambda: (F.log1p(a), 1 / ((1 + a) * small)),
        "huber": lambda: (F.when(a <= huber, a * a / 2).otherwise(huber * a - huber * huber / 2), F.when(a <= huber, 1.0).otherwise(huber / small)),
    }[loss]()


def _sums(picks: DataFrame, tried: DataFrame, keys: list[str], n: int, loss: str, huber: float) -> DataFrame:
    """keys, value, g and h (row by row of the upper triangle): sums over a gather's picks (_x, _t, _n) at the model in its column fit_q."""
    at = lambda i: F.get("fit_q", F.lit(i))
    x, v = [at(i) for i in range(1, n)], [at(n + i) for i in range(n)]
    edges = [F.lit(0.0), *x]
    far = [F.greatest(F.col("_x") - e, F.lit(0.0)) if k == n - 1 else F.least(F.greatest(F.col("_x") - e, F.lit(0.0)), edges[k + 1] - e) for k, e in enumerate(edges)]
    time = at(0)
    for f, s in zip(far, v):
        time = time + f * 1000 / s
    slopes = [F.lit(1.0), *(F.when(F.col("_x") > x[i], 1000 / v[i] - 1000 / v[i + 1]).otherwise(0.0) for i in range(n - 1)), *(-f * 1000 / (s * s) for f, s in zip(far, v))]
    value, weight = _loss(F.col("_r"), loss, huber)
    rows = picks.join(tried, keys[:-1]).select(*keys, "_n", (time - F.col("_t")).alias("_r"), *(s.alias(f"_s{i}") for i, s in enumerate(slopes)))
    rows = rows.withColumns({"_value": value * F.col("_n"), "_w": weight * F.col("_n")})
    s = [F.col(f"_s{i}") for i in range(2 * n)]
    upper = [(i, j) for i in range(2 * n) for j in range(i, 2 * n)]
    made = rows.groupBy(*keys).agg(F.sum("_value").alias("_v"), F.sum("_n").alias("_c"), *(F.sum(F.col("_w") * F.col("_r") * s[i]).alias(f"_g{i}") for i in range(2 * n)), *(F.sum(F.col("_w") * s[i] * s[j]).alias(f"_h{i}_{j}") for i, j in upper))
    mean = lambda c: F.col(c) / F.col("_c")
    return made.select(*keys, mean("_v").alias("new_value"), F.array(*(mean(f"_g{i}") for i in range(2 * n))).alias("new_g"), F.array(*(mean(f"_h{i}_{j}") for i, j in upper)).alias("new_h"))


def fitted(picks: DataFrame, by: list[str], n: int, loss: str = "L1", huber: float = 20.0, min_velocity_step: float = 1.0, min_size: float = 1.0) -> DataFrame:
    """by, fit_p (t0, x1.., v1..) and fit_loss of every gather of ``picks`` (by, _x, _t, _n); the best of several beginnings."""
    kinds = "".join(f"{c} {picks.schema[c].dataType.simpleString()}, " for c in by)
    ends = saved(picks.groupBy(*by).agg(F.min("_x").alias("_low"), F.max("_x").alias("_high"), (F.max("_t") - F.min("_t")).alias("_span")), "ends")
    width = F.greatest((F.col("_high") - F.col("_low")) / BINS, F.lit(1e-9))
    binned = picks.join(ends, by).groupBy(*by, "_high", "_span", F.least(F.floor((F.col("_x") - F.col("_low")) / width), F.lit(BINS - 1)).alias("_bin"))
    binned = binned.agg((F.sum(F.col("_x") * F.col("_n")) / F.sum("_n")).alias("_x"), (F.sum(F.col("_t") * F.col("_n")) / F.sum("_n")).alias("_t"), F.sum("_n").alias("_n"))

    def begun(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_bin")
        x, t, c = (frame[k].to_numpy(float) for k in ("_x", "_t", "_n"))
        starts = [nearsurface.start_from(x, t, c, n, min_velocity_step, min_size, bend) for bend in (nearsurface.BENDS if n > 1 else (1.0,))]
        return pd.DataFrame([[*key, i, p.tolist(), p.tolist(), float("inf"), 1e-3, [0.0] * (2 * n), [0.0] * (n * (2 * n + 1)), float(frame["_high"].iloc[0]), float(frame["_span"].iloc[0]), False] for i, p in enumerate(starts)], columns=[*by, *_STATE])

    schema = kinds + "fit_start int, fit_q array<double>, fit_p array<double>, fit_value double, fit_damping double, fit_g array<double>, fit_h array<double>, fit_far double, fit_span double, fit_done boolean"
    state = saved(binned.groupBy(*by).applyInPandas(begun, schema), "fits")
    keys = [*by, "fit_start"]

    def stepped(frames):
        for f in frames:
            yield pd.DataFrame([_step(r, n, min_velocity_step, min_size, by) for r in f.to_dict("records")], columns=[*by, *_STATE])

    ended = None
    for _ in range(ROUNDS):
        sums = _sums(picks, state.select(*keys, "fit_q"), keys, n, loss, huber)
        state = saved(state.join(sums, keys).mapInPandas(stepped, schema), "fits")
        over = state.where("fit_done").select(*by, "fit_p", "fit_value")
        ended = over if ended is None else ended.unionByName(over)
        state = state.where("not fit_done")
        if state.isEmpty():
            break
    ended = ended.unionByName(state.select(*by, "fit_p", "fit_value"))
    return ended.groupBy(*by).agg(F.min_by("fit_p", "fit_value").alias("fit_p"), F.min("fit_value").alias("fit_loss"))


#: Columns of the state, under names that keys don't have.
_STATE = ["fit_start", "fit_q", "fit_p", "fit_value", "fit_damping", "fit_g", "fit_h", "fit_far", "fit_span", "fit_done"]


def _step(r: dict, n: int, min_velocity_step: float, min_size: float, by: list[str]) -> list:
    """A row of the state after its tried model's sums are known: the next tried model, or the end."""
    p, g, h, damping, done = np.array(r["fit_p"], float), np.array(r["fit_g"], float), np.array(r["fit_h"], float), r["fit_damping"], False
    if r["new_value"] < r["fit_value"]:
        done = bool(np.isfinite(r["fit_value"])) and r["new_value"] > r["fit_value"] * (1 - TOLERANCE)
        p, value, g, h, damping = np.array(r["fit_q"], float), r["new_value"], np.array(r["new_g"], float), np.array(r["new_h"], float), max(damping / 10, 1e-12)
    else:
        value, damping = r["fit_value"], damping * 10
        done = damping > 1e9
    a, b = nearsurface.rules(n, min_velocity_step, min_size, max(r["fit_far"], n * min_size), None)
    b = np.minimum(b, a @ p)
    scale = np.concatenate([[max(r["fit_span"], 1.0)], np.full(n - 1, max(r["fit_far"], 1.0)), np.full(n, max(p[n:].max(), 1.0))])
    full = np.zeros((2 * n, 2 * n))
    full[np.triu_indices(2 * n)] = h
    full = (full + np.triu(full, 1).T) * np.outer(scale, scale)
    d = nearsurface.least_within(full + damping * np.diag(np.diag(full) + 1e-9 * np.trace(full) + 1e-300), g * scale, a * scale, np.maximum(a @ p - b, 0.0)) * scale
    return [*(r[c] for c in by), r["fit_start"], (p + d).tolist(), p.tolist(), float(value), float(damping), g.tolist(), h.tolist(), r["fit_far"], r["fit_span"], bool(done or value <= 1e-9)]
