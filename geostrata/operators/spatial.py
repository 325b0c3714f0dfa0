"""Joins and interpolation in the plane.

A radius join puts both sides on a grid of the radius' size and joins each cell with its neighbours, so it is an equi-join whose
candidates grow with the local density and not with the product of the tables. Nearest neighbours widen the ring of cells until
enough points are certain to be inside. Interpolators have their knots in every task, at most BROADCAST_POINTS; triangulations of more are made in tiles.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geostrata.operators import tiled
from geostrata.operators.triangulation import Cells, Located, delaunay, gradients
from geostrata.operators.triangulation import clough_tocher as patches
from geostrata.sources.scratch import saved


def _cells(x: str, y: str, size: float):
    return F.floor(F.col(x) / size).cast("long"), F.floor(F.col(y) / size).cast("long")


def _spread(df: DataFrame, x: str, y: str, size: float, reach: int = 1) -> DataFrame:
    """Each row once for its own cell and each cell around it."""
    cx, cy = _cells(x, y, size)
    around = F.array(*(F.struct((cx + i).alias("cx"), (cy + j).alias("cy")) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)))
    return df.withColumn("_cell", F.explode(around)).withColumn("_cx", F.col("_cell.cx")).withColumn("_cy", F.col("_cell.cy")).drop("_cell")


def radius_pairs(left: DataFrame, right: DataFrame, radius: float, left_id: str, right_id: str, left_xy=("x", "y"), right_xy=("x", "y"), keep_left: list[str] = (), keep_right: list[str] = ()) -> DataFrame:
    """left_id, right_id, dist of all pairs no further apart than the radius, with the columns asked for."""
    a = _spread(left.select(F.col(left_id).alias("left_id"), F.col(left_xy[0]).cast("double").alias("_lx"), F.col(left_xy[1]).cast("double").alias("_ly"), *keep_left), "_lx", "_ly", radius)
    b = right.select(F.col(right_id).alias("right_id"), F.col(right_xy[0]).cast("double").alias("_rx"), F.col(right_xy[1]).cast("double").alias("_ry"), *keep_right)
    cx, cy = _cells("_rx", "_ry", radius)
    b = b.withColumn("_cx", cx).withColumn("_cy", cy)
    dist = F.sqrt((F.col("_lx") - F.col("_rx")) * (F.col("_lx") - F.col("_rx")) + (F.col("_ly") - F.col("_ry")) * (F.col("_ly") - F.col("_ry")))
    return a.join(b, ["_cx", "_cy"]).withColumn("dist", dist).where(F.col("dist") <= radius * (1 + 1e-5) + 1e-8).select("left_id", "right_id", "dist", *keep_left, *keep_right)


#: Reference points that are broadcast at most; knots of an interpolator are few next to the traces that are asked for.
BROADCAST_POINTS = 100_000
#: Places that a task works on at once.
PLACES = 4096


def knots_of(points: DataFrame, point_id: str, xy: tuple[str, str], values: list[str] = ()) -> pd.DataFrame:
    """The knots of an interpolator in the order of their ids, on the driver: id, x, y and values. More than BROADCAST_POINTS fail."""
    known = points.select(F.col(point_id).alias("id"), F.col(xy[0]).cast("double").alias("x"), F.col(xy[1]).cast("double").alias("y"), *(F.col(v).cast("double").alias(f"v_{v}") for v in values))
    found = known.orderBy("id").limit(BROADCAST_POINTS + 1).toPandas()
    if len(found) > BROADCAST_POINTS:
        raise ValueError(f"an interpolator has {BROADCAST_POINTS} knots at most")
    return found


def _asked(queries: DataFrame, query_id: str, xy: tuple[str, str]) -> DataFrame:
    return queries.select(F.col(query_id).alias("query_id"), F.col(xy[0]).cast("double").alias("_x"), F.col(xy[1]).cast("double").alias("_y"))


def nearest_pairs(queries: DataFrame, points: DataFrame, k: int, query_id: str, point_id: str, query_xy=("x", "y"), point_xy=("x", "y"), values: list[str] = ()) -> DataFrame:
    """query_id, point_id, dist, rank (from 1; ties by point id) of the k nearest points of every query, with the points' values.

    Queries are never shuffled: points, up to BROADCAST_POINTS of them, go to every task sorted into cells, and a place meets those of the
    cells around it. Beyond that bound the grid join takes over, with a radius that doubles for queries not yet full; distances are the same.
    """
    if _is_large(points):
        return _nearest_by_grid(queries, points, k, query_id, point_id, query_xy, point_xy, values)
    known = knots_of(points, point_id, point_xy, values)
    ids, extra = known["id"].to_numpy(), {v: known[f"v_{v}"].to_numpy(float) for v in values}
    cells = Cells(known[["x", "y"]].to_numpy(float))
    shared = queries.sparkSession.sparkContext.broadcast((ids, extra, cells))

    def near(frames):
        ids, extra, cells = shared.value
        for f in frames:
            for low in range(0, len(f), PLACES):
                part = f.iloc[low : low + PLACES]
                at, d = cells.nearest(part[["_x", "_y"]].to_numpy(float), k)
                n = at.shape[1]
                out = {"query_id": np.repeat(part["query_id"].to_numpy(), n), "point_id": ids[at].ravel(), "dist": d.ravel(), "rank": np.tile(np.arange(1, n + 1), len(part))}
                yield pd.DataFrame(out | {v: extra[v][at].ravel() for v in values})

    kinds = f"query_id {queries.schema[query_id].dataType.simpleString()}, point_id {points.schema[point_id].dataType.simpleString()}, dist double, rank int" + "".join(f", {v} double" for v in values)
    return _asked(queries, query_id, query_xy).mapInPandas(near, kinds)


def _nearest_by_grid(queries, points, k, query_id, point_id, query_xy, point_xy, values) -> DataFrame:
    box = points.agg(*(f(c) for c in point_xy for f in (F.min, F.max)), F.count("*")).first()
    radius = math.sqrt(max((box[1] - box[0]) * (box[3] - box[2]), 1e-12) / max(box[4], 1) * k)
    left, out = queries, None
    while True:
        pairs = radius_pairs(left, points, radius, query_id, point_id, query_xy, point_xy, keep_right=list(values))
        ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("left_id").orderBy("dist", "right_id"))).where(F.col("rank") <= k).withColumnsRenamed({"left_id": "query_id", "right_id": "point_id"})
        full = ranked.where(F.col("rank") == min(k, box[4])).select("query_id")
        done = ranked.join(full, "query_id", "left_semi")
        out = done if out is None else out.unionByName(done)
        left = saved(left.join(full, left[query_id] == full["query_id"], "left_anti"), "queries")
        if left.isEmpty():
            return out
        radius *= 2


def idw_weights(pairs: DataFrame, by: str = "query_id", power: float | Callable[[Column], Column] = 2.0, smoothing: float = 0.0, min_relative_weight: float = 1e-3) -> DataFrame:
    """Pairs with a column ``weight``: inverse distances that sum to 1 by query; a point that is hit exactly has all the weight.
    Distances are raised to a power, or transformed by a function of Columns."""
    over = Window.partitionBy(by)
    raw = (power(F.col("dist")) if callable(power) else F.pow("dist", F.lit(float(power)))) + smoothing
    out = pairs.withColumn("_raw", raw).withColumn("_hit", F.min("_raw").over(over) <= 1e-15)
    out = out.withColumn("_w", F.when(F.col("_hit"), (F.col("_raw") <= 1e-15).cast("double")).otherwise(1 / F.greatest("_raw", F.lit(1e-300))))
    out = out.withColumn("_w", F.when(F.col("_w") < F.max("_w").over(over) * min_relative_weight, 0.0).otherwise(F.col("_w")))
    return out.where("_w > 0").withColumn("weight", F.col("_w") / F.sum("_w").over(over)).drop("_raw", "_hit", "_w")


def idw(pairs: DataFrame, values: list[str], by: str = "query_id", **kwargs) -> DataFrame:
    return idw_weights(pairs, by, **kwargs).groupBy(by).agg(*(F.sum(F.col("weight") * F.col(v)).alias(v) for v in values))


def neighbor_distance(points: DataFrame, point_id: str, xy=("x", "y")) -> DataFrame:
    """The mean distance to the nearest other point, 0 where there is no other."""
    pairs = nearest_pairs(points, points, 2, point_id, point_id, xy, xy).where("query_id <> point_id")
    return pairs.groupBy("query_id").agg(F.min("dist").alias("d")).agg(F.coalesce(F.avg("d"), F.lit(0.0)).alias("mean_distance"))


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Corners of the hull, counter-clockwise, by monotone chains."""
    p = sorted(map(tuple, np.unique(points, axis=0)))
    if len(p) < 3:
        return np.array(p)

    def half(seq):
        out = []
        for q in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def in_hull(df: DataFrame, hull: np.ndarray, x: str = "x", y: str = "y", name: str = "inside") -> DataFrame:
    """Whether each point is inside a convex polygon or on its border: all cross products are non-negative."""
    inside = F.lit(len(hull) > 2)
    for (ax, ay), (bx, by) in zip(hull.tolist(), np.roll(hull, -1, 0).tolist()):
        inside = inside & ((bx - ax) * (F.col(y) - ay) - (by - ay) * (F.col(x) - ax) >= 0)
    return df.withColumn(name, inside)


def distance_weights(dist: np.ndarray, power: float = 2.0, min_relative_weight: float = 1e-3) -> np.ndarray:
    """idw_weights() for rows of distances in a task."""
    raw = dist**power
    hit = raw.min(1, keepdims=True, initial=np.inf) <= 1e-15
    w = np.where(hit, raw <= 1e-15, 1 / np.maximum(raw, 1e-300))
    w = np.where(w < w.max(1, keepdims=True, initial=0) * min_relative_weight, 0, w)
    return w / w.sum(1, keepdims=True)


def _is_large(points: DataFrame) -> bool:
    return points.limit(BROADCAST_POINTS + 1).count() > BROADCAST_POINTS


def _triangulated(known: pd.DataFrame) -> Located:
    xy = known[["x", "y"]].to_numpy(float)
    return Located(xy, *delaunay(xy))


def delaunay_weights(queries: DataFrame, points: DataFrame, query_id: str, point_id: str, query_xy=("x", "y"), point_xy=("x", "y"), neighbors: int = 3, power: float = 2.0) -> DataFrame:
    """query_id, point_id, weight: barycentric weights in the Delaunay triangle around each query, inverse distances outside the hull."""
    if _is_large(points):
        return _delaunay_by_tiles(queries, points, query_id, point_id, query_xy, point_xy, neighbors, power)
    known = knots_of(points, point_id, point_xy)
    located = _triangulated(known)
    shared = queries.sparkSession.sparkContext.broadcast((known["id"].to_numpy(), located, Cells(located.xy)))

    def around(frames):
        ids, located, cells = shared.value
        for f in frames:
            for low in range(0, len(f), PLACES):
                part, places = f["query_id"].to_numpy()[low : low + PLACES], f[["_x", "_y"]].to_numpy(float)[low : low + PLACES]
                at, w = located.weights(places)
                inside, outside = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
                near, dist = cells.nearest(places[outside], neighbors)
                rows = np.concatenate([np.repeat(inside, 3), np.repeat(outside, near.shape[1])])
                knots = np.concatenate([located.triangles[at[inside]].ravel(), near.ravel()])
                weight = np.concatenate([w[inside].ravel(), distance_weights(dist, power).ravel()])
                kept = weight > 1e-9
                yield pd.DataFrame({"query_id": part[rows[kept]], "point_id": ids[knots[kept]], "weight": weight[kept]})

    kinds = f"query_id {queries.schema[query_id].dataType.simpleString()}, point_id {points.schema[point_id].dataType.simpleString()}, weight double"
    return _asked(queries, query_id, query_xy).mapInPandas(around, kinds)


def _in_plane(points: DataFrame, point_id: str, xy: tuple[str, str], values: list[str] = ()) -> DataFrame:
    return points.select(F.col(point_id).alias("id"), F.col(xy[0]).cast("double").alias("x"), F.col(xy[1]).cast("double").alias("y"), *(F.col(v).cast("double").alias(f"v_{v}") for v in values))


def _delaunay_by_tiles(queries, points, query_id, point_id, query_xy, point_xy, neighbors, power) -> DataFrame:
    def made(located, at, w, ids, _):
        corners = located.triangles[at]
        return {f"p{i}": ids[corners[:, i]] for i in range(3)} | {f"w{i}": w[:, i] for i in range(3)}

    kind = points.schema[point_id].dataType.simpleString()
    found, outside = tiled.triangles_around(_asked(queries, query_id, query_xy), _in_plane(points, point_id, point_xy), [], made, f"p0 {kind}, p1 {kind}, p2 {kind}, w0 double, w1 double, w2 double")
    corners = F.array(*(F.struct(F.col(f"p{i}").alias("point_id"), F.col(f"w{i}").alias("weight")) for i in range(3)))
    inside = found.select("query_id", F.explode(corners).alias("c")).select("query_id", "c.*").where("weight > 1e-9")
    if outside.isEmpty():
        return inside
    near = idw_weights(nearest_pairs(outside, points, neighbors, "query_id", point_id, ("_x", "_y"), point_xy), power=power)
    return inside.unionByName(near.select("query_id", "point_id", "weight").where("weight > 1e-9"))


def _surface_by_tiles(queries, points, query_id, point_id, values, query_xy, point_xy, neighbors, power, slopes) -> DataFrame:
    def made(located, at, w, _, known):
        corners = located.triangles[at]
        by = {v: np.stack([known[f"v_{c}"] for c in slopes[v]], 1) * located.scale for v in values}
        return {v: patches(located.z[corners], known[f"v_{v}"][corners], by[v][corners], w) for v in values}

    columns = [*dict.fromkeys([*values, *(c for v in values for c in slopes[v])])]
    found, outside = tiled.triangles_around(_asked(queries, query_id, query_xy), _in_plane(points, point_id, point_xy, columns), [f"v_{c}" for c in columns], made, ", ".join(f"{v} double" for v in values))
    if outside.isEmpty():
        return found
    return found.unionByName(idw(nearest_pairs(outside, points, neighbors, "query_id", point_id, ("_x", "_y"), point_xy, values), values, power=power))


def clough_tocher(queries: DataFrame, points: DataFrame, query_id: str, point_id: str, values: list[str], query_xy=("x", "y"), point_xy=("x", "y"), neighbors: int = 3, power: float = 2.0, slopes: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """query_id and the values of smooth surfaces through the points: cubic patches on the Delaunay triangles, inverse distances outside the hull.

    ``slopes`` names the columns of a value's gradient where it is known; else the gradients are those with which the edges bend least, a system
    over all knots, which are BROADCAST_POINTS at most then.
    """
    given = slopes or {}
    if all(v in given for v in values) and _is_large(points):
        return _surface_by_tiles(queries, points, query_id, point_id, values, query_xy, point_xy, neighbors, power, given)
    known = knots_of(points, point_id, point_xy, [*values, *(c for pair in given.values() for c in pair)])
    located = _triangulated(known)
    heights = known[[f"v_{v}" for v in values]].to_numpy(float)
    of = lambda i, v: known[[f"v_{c}" for c in given[v]]].to_numpy(float) * located.scale if v in given else gradients(located.z, located.triangles, heights[:, i])
    slopes = np.stack([of(i, v) for i, v in enumerate(values)], 1) if len(located.triangles) else None
    shared = queries.sparkSession.sparkContext.broadcast((located, Cells(located.xy), heights, slopes))

    def surface(frames):
        located, cells, heights, slopes = shared.value
        for f in frames:
            for low in range(0, len(f), PLACES):
                part, places = f["query_id"].to_numpy()[low : low + PLACES], f[["_x", "_y"]].to_numpy(float)[low : low + PLACES]
                at, w = located.weights(places)
                inside, outside = at >= 0, at < 0
                near, dist = cells.nearest(places[outside], neighbors)
                by_distance, corners = distance_weights(dist, power), located.triangles[at[inside]]
                out = {"query_id": part}
                for i, v in enumerate(values):
                    out[v] = np.full(len(part), np.nan)
                    out[v][outside] = (heights[near, i] * by_distance).sum(1)
                    if len(corners):
                        out[v][inside] = patches(located.z[corners], heights[corners, i], slopes[corners, i], w[inside])
                yield pd.DataFrame(out)

    kinds = f"query_id {queries.schema[query_id].dataType.simpleString()}" + "".join(f", {v} double" for v in values)
    return _asked(queries, query_id, query_xy).mapInPandas(surface, kinds)


def regression(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


#: Knots of a spline that are solved as one system; more of them are cut into boxes of at most this number.
SPLINE_KNOTS = 400


def _kernel(r2: np.ndarray) -> np.ndarray:
    return np.where(r2 > 0, 0.5 * r2 * np.log(np.maximum(r2, 1e-300)), 0.0)


def spline_boxes(z: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Lower and upper corners of boxes that cut the plane in halves until each has ``most`` knots at most."""
    boxes, todo = [], [(z.min(0), z.max(0), np.arange(len(z)))] if len(z) else []
    while todo:
        low, high, own = todo.pop()
        side = int(np.argmax(high - low))
        middle = np.median(z[own, side])
        left = z[own, side] <= middle
        if len(own) <= most or left.all():
            boxes.append((low, high))
            continue
        for part, a, b in ((left, low[side], middle), (~left, middle, high[side])):
            lower, upper = low.copy(), high.copy()
            lower[side], upper[side] = a, b
            todo.append((lower, upper, own[part]))
    return boxes


def rbf(df: DataFrame, points: np.ndarray, values: np.ndarray, x: str = "x", y: str = "y", name: str = "value", smoothing: float = 0.0, most: int = SPLINE_KNOTS) -> DataFrame:
    """Thin-plate splines through known points, of which there are BROADCAST_POINTS at most.

    Up to ``most`` points make one system. More are cut into boxes; each box's spline goes through the points of the box and of a border half as wide as the
    box around it, solved by a task of its own, and a place takes the mean of the splines whose bordered boxes hold it, weighted so that it changes smoothly.
    """
    if len(points) > BROADCAST_POINTS:
        raise ValueError(f"an interpolator has {BROADCAST_POINTS} knots at most")
    spark = df.sparkSession
    points, values = np.asarray(points, float).reshape(-1, 2), np.asarray(values, float)
    shift, scale = points.mean(0), max(np.ptp(points, axis=0).max(), 1e-12)
    z = (points - shift) / scale
    boxes = spline_boxes(z, most)
    low, high = (np.array([b[i] for b in boxes]) for i in (0, 1))
    border = np.maximum((high - low) / 2, 1e-9)
    low, high = low - border, high + border
    knots = spark.sparkContext.broadcast((z, values, low, high))

    def solved(numbers):
        z, values, low, high = knots.value
        for k in (k for batch in numbers for k in batch["id"]):
            own = np.flatnonzero(((z >= low[k]) & (z <= high[k])).all(1))
            n, side = len(own), np.column_stack([np.ones(len(own)), z[own]])
            a = np.block([[_kernel(((z[own][:, None] - z[own][None]) ** 2).sum(-1)) + smoothing * np.eye(n), side], [side.T, np.zeros((3, 3))]])
            yield pd.DataFrame({"box": [k], "knots": [own.tolist()], "w": [np.linalg.lstsq(a, np.concatenate([values[own], np.zeros(3)]), rcond=None)[0].tolist()]})

    # all weights together are a few numbers for each knot
    made = spark.range(len(boxes), numPartitions=min(len(boxes), 200)).mapInPandas(solved, "box long, knots array<long>, w array<double>").toPandas()
    splines = spark.sparkContext.broadcast([(low[r.box], high[r.box], z[np.array(r.knots, int)], np.array(r.w)) for r in made.sort_values("box").itertuples()])

    def evaluated(q: np.ndarray) -> np.ndarray:
        total, weight = np.zeros(len(q)), np.zeros(len(q))
        whole = len(splines.value) == 1
        for low, high, own, w in splines.value:
            at = np.arange(len(q)) if whole else np.flatnonzero(((q > low) & (q < high)).all(1))
            for part in np.array_split(at, max(1, len(at) // 1024)):
                if len(part):
                    n = len(own)
                    value = _kernel(((q[part, None] - own[None]) ** 2).sum(-1)) @ w[:n] + w[n] + q[part] @ w[n + 1 :]
                    tent = np.ones(len(part)) if whole else (np.minimum(q[part] - low, high - q[part]) / (high - low)).prod(1) ** 2
                    total[part] += tent * value
                    weight[part] += tent
        far = np.flatnonzero(weight <= 0)
        if len(far):  # outside all boxes: the spline whose box is nearest
            gap = [(np.maximum(np.maximum(low - q[far], q[far] - high), 0) ** 2).sum(1) for low, high, _, _ in splines.value]
            for k in np.unique(best := np.argmin(gap, 0)):
                _, _, own, w = splines.value[k]
                part, n = far[best == k], len(own)
                total[part], weight[part] = _kernel(((q[part, None] - own[None]) ** 2).sum(-1)) @ w[:n] + w[n] + q[part] @ w[n + 1 :], 1.0
        return total / np.maximum(weight, 1e-300)

    @F.pandas_udf("double")
    def value(px: pd.Series, py: pd.Series) -> pd.Series:
        q = (np.column_stack([px, py]) - shift) / scale
        return pd.Series(np.concatenate([evaluated(q[i : i + PLACES]) for i in range(0, len(q), PLACES)]) if len(q) else np.zeros(0))

    return df.withColumn(name, value(F.col(x).cast("double"), F.col(y).cast("double")))
