"""A survey's bins and its coordinates: the affine map between them, distances to contours, ids of sources and receivers."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Coefficients of an affine map, as fields.infer_geometry() names them.
AFFINE = ["x_by_first", "x_by_second", "x_origin", "y_by_first", "y_by_second", "y_origin"]


def bins_to_coords(df: DataFrame, affine: Mapping[str, float], bins: tuple[str, str], out: tuple[str, str] = ("x", "y")) -> DataFrame:
    """Columns of coordinates from columns of bins, by literals in the plan."""
    a, b = (F.col(c) for c in bins)
    xa, xb, x0, ya, yb, y0 = (float(affine[k]) for k in AFFINE)
    return df.withColumns({out[0]: a * xa + b * xb + x0, out[1]: a * ya + b * yb + y0})


def coords_to_bins(df: DataFrame, affine: Mapping[str, float], coords: tuple[str, str], out: tuple[str, str] = ("first", "second")) -> DataFrame:
    """The inverse map; bins are fractions between the survey's own."""
    xa, xb, x0, ya, yb, y0 = (float(affine[k]) for k in AFFINE)
    det = xa * yb - xb * ya
    if abs(det) < 1e-12:
        raise ValueError("bins of one line have no inverse map")
    dx, dy = F.col(coords[0]) - x0, F.col(coords[1]) - y0
    return df.withColumns({out[0]: (dx * yb - dy * xb) / det, out[1]: (dy * xa - dx * ya) / det})


def _to_contour(x: Column, y: Column, corners: np.ndarray) -> Column:
    """Distance to a closed polygon's border, negative outside: a fold over its edges, which are constants of the plan."""
    edges = F.array(*(F.struct(*(F.lit(float(v)).alias(k) for k, v in zip(("ax", "ay", "bx", "by"), (*p, *q)))) for p, q in zip(corners, np.roll(corners, -1, 0))))

    def step(acc, e):
        dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
        along = F.coalesce(F.try_divide((x - e["ax"]) * dx + (y - e["ay"]) * dy, dx * dx + dy * dy), F.lit(0.0))
        along = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
        far = F.hypot(x - (e["ax"] + along * dx), y - (e["ay"] + along * dy))
        # a ray to the right crosses an edge whose ends are on both sides of it
        crosses = ((e["ay"] > y) != (e["by"] > y)) & (x < e["ax"] + (y - e["ay"]) * dx / F.when(dy == 0, 1.0).otherwise(dy))
        return F.struct(F.least(acc["far"], far).alias("far"), (acc["inside"] != crosses).alias("inside"))

    start = F.struct(F.lit(float("inf")).alias("far"), F.lit(False).alias("inside"))
    return F.aggregate(edges, start, step, lambda acc: F.when(acc["inside"], acc["far"]).otherwise(-acc["far"]))


def contour_distance(df: DataFrame, contours: list, x: str, y: str, name: str = "distance") -> DataFrame:
    """Of the signed distances to several polygons (inside: positive) the one with the smallest absolute value."""
    if not contours:
        raise ValueError("a contour is needed")
    signed = F.transform(F.array(*(_to_contour(F.col(x).cast("double"), F.col(y).cast("double"), np.asarray(c, float)) for c in contours)), lambda d: F.struct(F.abs(d).alias("far"), (-d).alias("minus")))
    return df.withColumn(name, -F.array_min(signed)["minus"])


def transform_coords(df: DataFrame, affine: Mapping[str, float], coords: tuple[str, str], to_geographic: bool) -> DataFrame:
    """A field's places moved between bins and geographic coordinates, in place."""
    return bins_to_coords(df, affine, coords, coords) if to_geographic else coords_to_bins(df, affine, coords, coords)


def central_gather(df: DataFrame, lines: tuple[str, str] = ("INLINE_3D", "CROSSLINE_3D"), center: tuple[str, str] = ("SUPERGATHER_INLINE_3D", "SUPERGATHER_CROSSLINE_3D")) -> DataFrame:
    """The traces of supergathers that belong to the bins at their centres."""
    return df.where((F.col(lines[0]) == F.col(center[0])) & (F.col(lines[1]) == F.col(center[1])))


def is_uphole(df: DataFrame, time: str = "SourceUpholeTime", depth: str = "SourceDepth") -> DataFrame:
    """One row: whether any uphole time or depth is over 0; null if neither header is there."""
    known = [F.coalesce(F.bool_or(F.col(c) > 0), F.lit(False)) for c in (time, depth) if c in df.columns]
    found = known[0] if known else F.lit(None).cast("boolean")
    for k in known[1:]:
        found = found | k
    return df.agg(found.alias("is_uphole"))


def ids(df: DataFrame, cols: list[str]) -> DataFrame:
    """n_ids, n_missing and all_zero of the columns that identify sources or receivers: distinct ids, rows with a null in one of them, and
    whether all of them are 0 or null throughout, which makes them no ids."""
    if missing := set(cols) - set(df.columns):
        raise ValueError(f"no such headers: {sorted(missing)}")
    null = F.greatest(*(F.col(c).isNull().cast("int") for c in cols), F.lit(0))
    zero = F.lit(True)
    for c in cols:
        zero = zero & (F.coalesce(F.col(c), F.lit(0)) == 0)
    keys = df.select(*cols).distinct().agg(F.count("*").alias("n_ids"))  # partial aggregates: only distinct ids are shuffled
    rest = df.agg(F.coalesce(F.sum(null), F.lit(0)).alias("n_missing"), F.coalesce(F.every(zero), F.lit(True)).alias("all_zero"))
    return keys.crossJoin(F.broadcast(rest))  # one row each
