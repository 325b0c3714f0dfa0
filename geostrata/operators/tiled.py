"""Triangulations of more knots than one process should hold.

The plane is cut into tiles of few knots each. A task triangulates a tile's knots with those of a border around it, and another one locates the tile's places in
these triangles. A triangle whose circle, as far as it lies in the hull of all knots, is within the bordered tile is a triangle of the whole, since no knot that the
task doesn't know can be in the circle. Places in other triangles come again with a wider border around them. Where knots are on one circle, tiles choose
the same triangles (triangulation.delaunay), so the result doesn't depend on the cuts.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geostrata.operators.triangulation import Located, delaunay
from geostrata.sources.scratch import saved

#: Knots of a tile and places of a task; cells that a tile is counted in to be cut; knots' distances that a border is wide at first.
KNOTS, PLACES, CELLS, BORDER = 20_000, 200_000, 4096, 8


class Tiles:
    """Boxes that halve one another. ``of`` goes down the cuts to the box of every place."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        self.side, self.cut, self.left, self.right = [-1], [0.0], [0], [0]  # a node without a side is a tile, whose number is in ``left``
        self.node, self.low, self.high, self.count = [0], [low], [high], [0]

    def split(self, tile: int, side: int, cut: float) -> int:
        """Cuts a tile in two; the lower part keeps its number, that of the other one is returned."""
        new, at, n = len(self.node), self.node[tile], len(self.side)
        self.side += [-1, -1]
        self.cut += [0.0, 0.0]
        self.left += [tile, new]
        self.right += [0, 0]
        self.side[at], self.cut[at], self.left[at], self.right[at] = side, cut, n, n + 1
        self.node[tile] = n
        self.node.append(n + 1)
        self.low.append(self.low[tile].copy())
        self.high.append(self.high[tile].copy())
        self.count.append(0)
        self.high[tile] = self.high[tile].copy()
        self.high[tile][side] = self.low[new][side] = cut
        return new

    def of(self, xy: np.ndarray) -> np.ndarray:
        side, cut, left, right = (np.array(a) for a in (self.side, self.cut, self.left, self.right))
        at = np.zeros(len(xy), np.int64)
        while (inner := np.flatnonzero(side[at] >= 0)).size:
            n = at[inner]
            at[inner] = np.where(xy[inner, side[n]] < cut[n], left[n], right[n])
        return left[at]


def tiles_of(knots: DataFrame, low: np.ndarray, high: np.ndarray, most: int) -> Tiles:
    """Tiles of ``most`` knots at most, by counts of cells. A cell that has more is counted again in cells of its own."""
    tiles, heavy = Tiles(low, high), [0]
    least = np.ptp([low, high]) * 1e-13
    while heavy:
        size = np.array([tiles.high[t] - tiles.low[t] for t in heavy])
        nx = np.clip(np.sqrt(CELLS * size[:, 0] / np.maximum(size[:, 1], 1e-300)), 1, CELLS).astype(int)
        shape, corner = np.column_stack([nx, np.maximum(CELLS // nx, 1)]), np.array([tiles.low[t] for t in heavy])
        number = np.full(len(tiles.node), -1)
        number[heavy] = np.arange(len(heavy))
        shared = knots.sparkSession.sparkContext.broadcast((tiles, number, corner, size, shape))

        def counted(frames):
            tiles, number, corner, size, shape = shared.value  # noqa: B023
            for f in frames:
                xy = f[["x", "y"]].to_numpy(float)
                of = number[tiles.of(xy)]
                xy, of = xy[of >= 0], of[of >= 0]
                cell = np.clip((xy - corner[of]) / np.maximum(size[of], 1e-300) * shape[of], 0, shape[of] - 1).astype(np.int64)
                key, n = np.unique(of * (2 * CELLS) + cell[:, 0] * shape[of, 1] + cell[:, 1], return_counts=True)
                yield pd.DataFrame({"key": key, "n": n})

        found = knots.mapInPandas(counted, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas()
        of, cell, n, again = found["key"].to_numpy() // (2 * CELLS), found["key"].to_numpy() % (2 * CELLS), found["n"].to_numpy(), []
        for k, tile in enumerate(heavy):
            counts = np.zeros(shape[k].prod(), np.int64)
            counts[cell[of == k]] = n[of == k]
            todo = [(tile, counts.reshape(shape[k]), np.zeros(2, int))]
            while todo:
                t, part, begin = todo.pop()
                tiles.count[t] = int(part.sum())
                if tiles.count[t] <= most:
                    continue
                if part.size == 1:
                    again += [t] if (tiles.high[t] - tiles.low[t]).max() > least else []
                    continue
                side = int(np.argmax(np.where(np.array(part.shape) > 1, size[k] / shape[k] * part.shape, -1)))
                below = np.cumsum(part.sum(1 - side))[:-1]
                cut = int(np.argmin(np.abs(below - tiles.count[t] / 2))) + 1
                new = tiles.split(t, side, float(corner[k][side] + size[k][side] * (begin[side] + cut) / shape[k][side]))
                step = np.where(np.arange(2) == side, cut, 0)
                todo += [(t, np.take(part, range(cut), side), begin), (new, np.take(part, range(cut, part.shape[side]), side), begin + step)]
        heavy = again
    return tiles


def hull_of(points: DataFrame) -> np.ndarray:
    """Corners of the hull of all points (x, y): of the hulls of batches."""
    from geostrata.operators.spatial import convex_hull

    def hulls(frames):
        for f in frames:
            yield pd.DataFrame(convex_hull(f[["x", "y"]].to_numpy(float)).reshape(-1, 2), columns=["x", "y"])

    return convex_hull(points.mapInPandas(hulls, "x double, y double").toPandas().to_numpy(float).reshape(-1, 2)).reshape(-1, 2)


def within(hull: np.ndarray, q: np.ndarray, scale: float) -> np.ndarray:
    """Whether places are in a hull (counter-clockwise from its leftmost corner) or on its border, as nearly as Located tells."""
    if len(hull) < 3:
        return np.zeros(len(q), bool)
    last = int(np.lexsort((hull[:, 1], hull[:, 0]))[-1])
    lower, upper = hull[: last + 1], np.concatenate([hull[:1], hull[last:][::-1]])
    inside = np.isfinite(q).all(1)
    p = q[inside]
    slack = 1e-14 * scale
    good = (p[:, 0] >= hull[0, 0] - slack) & (p[:, 0] <= hull[last, 0] + slack)
    for chain, way, sign in ((lower, "left", 1), (upper, "right", -1)):
        i = np.clip(np.searchsorted(chain[:, 0], p[:, 0], way) - 1, 0, len(chain) - 2)
        a, e = chain[i], chain[i + 1] - chain[i]
        good &= sign * (e[:, 0] * (p[:, 1] - a[:, 1]) - e[:, 1] * (p[:, 0] - a[:, 0])) >= -slack * scale
    inside[inside] = good
    return inside


def _clipped(ring: np.ndarray, side: int, bound: float, sign: int) -> np.ndarray:
    """The part of a convex polygon where sign * coordinate > sign * bound."""
    far, out = sign * (ring[:, side] - bound), []
    for i in range(len(ring)):
        a, b = far[i - 1], far[i]
        if (a > 0) != (b > 0):
            out.append(ring[i - 1] + (ring[i] - ring[i - 1]) * (a / (a - b)))
        if b > 0:
            out.append(ring[i])
    return np.array(out).reshape(-1, 2)


def _apart(ring: np.ndarray, center: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Whether discs have nothing of a convex polygon in them."""
    out = np.ones(len(center), bool)
    a, e = np.roll(ring, 1, 0), ring - np.roll(ring, 1, 0)
    length = np.maximum((e * e).sum(1), 1e-300)
    for at in np.array_split(np.arange(len(center)), max(1, len(center) * len(ring) // 1_000_000)):
        d = center[at, None] - a
        along = np.clip((d * e).sum(-1) / length, 0, 1)
        near = np.hypot(*np.moveaxis(d - along[..., None] * e, -1, 0)).min(1)
        inside = (e[:, 0] * d[..., 1] - e[:, 1] * d[..., 0] >= 0).all(1)
        out[at] = ~inside & (near > radius[at])
    return out


def certified(located: Located, at: np.ndarray, places: np.ndarray, low: np.ndarray, high: np.ndarray, hull: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the located places have a triangle of the whole triangulation, if all knots in the box are known; and how far around each place its circle reaches."""
    used, of = np.unique(at, return_inverse=True)
    c = located.xy[located.triangles[used]]
    b, d = c[:, 1] - c[:, 0], c[:, 2] - c[:, 0]
    bb, dd = (b * b).sum(1), (d * d).sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        u = np.stack([d[:, 1] * bb - b[:, 1] * dd, b[:, 0] * dd - d[:, 0] * bb], 1) / (2 * (b[:, 0] * d[:, 1] - b[:, 1] * d[:, 0]))[:, None]
        radius = np.hypot(*u.T) * (1 + 1e-6)
    center, radius = c[:, 0] + np.nan_to_num(u), np.where(np.isfinite(u).all(1), radius, np.inf)
    first, last = np.maximum(center - radius[:, None], hull.min(0)), np.minimum(center + radius[:, None], hull.max(0))
    good = ((first >= low) & (last <= high)).all(1)
    rest = np.flatnonzero(~good & np.isfinite(radius))
    for side in (0, 1):
        for bound, sign in ((low[side], -1), (high[side], 1)):
            beyond = _clipped(hull, side, bound, sign)
            if len(beyond) and len(rest):
                rest = rest[_apart(beyond, center[rest], radius[rest])]
    good[rest] = True
    # a place that is a knot needs no triangle
    knot = (located.xy[located.triangles[at]] == places[:, None]).all(-1).any(1)
    return good[of] | knot, np.maximum(places - first[of], last[of] - places).max(1)


def triangles_around(asked: DataFrame, points: DataFrame, values: list[str], made: Callable, kinds: str, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """For all places asked (query_id, _x, _y) in the hull of points (id, x, y, values) what ``made`` returns, with columns ``kinds``; and the places outside.

    ``made`` gets Located, the triangle of every place, the weights of its corners, the ids of all knots and a dict of their values, and returns a dict of
    columns. Equal points count once, that of the lowest id. Places without coordinates are in neither result.
    """
    spark, most = asked.sparkSession, most or KNOTS
    points = points.where(" and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < double('infinity')" for c in "xy"))
    knots = saved(points.groupBy("x", "y").agg(F.min_by(F.struct("id", *values), "id").alias("_k")).select("x", "y", "_k.*"), "knots")
    hull = hull_of(knots)
    low, high = (hull.min(0), hull.max(0)) if len(hull) else (np.zeros(2), np.zeros(2))
    scale = max((high - low).max(), 1e-300)
    tiles = tiles_of(knots, low, high, most)
    shared = spark.sparkContext.broadcast((tiles, hull))

    def placed(frames):
        tiles, hull = shared.value
        for f in frames:
            q = f[["_x", "_y"]].to_numpy(float)
            f["_tile"] = np.where(within(hull, q, scale), tiles.of(np.nan_to_num(q)), -1)
            yield f[np.isfinite(q).all(1)]

    names, asked_kinds = ["query_id", "_x", "_y", "_tile"], f"query_id {asked.schema['query_id'].dataType.simpleString()}, _x double, _y double, _tile long"
    places = saved(asked.mapInPandas(placed, asked_kinds), "places")
    outside, left = places.where("_tile < 0"), places.where("_tile >= 0")
    spacing = {t: BORDER * float(np.sqrt(np.prod(tiles.high[t] - tiles.low[t]) / max(tiles.count[t], 1))) for t in range(len(tiles.node))}
    border, out, columns = spacing, None, [k.split()[0] for k in kinds.split(", ")]
    while True:
        found = left.groupBy("_tile").agg(F.count("*").alias("n"), F.min("_x"), F.min("_y"), F.max("_x"), F.max("_y"), *([F.max("_need").alias("need")] if out is not None else [])).toPandas()
        if not len(found):
            break
        at = found["_tile"].to_numpy()
        if out is not None:  # at most sixteen times as wide, at least twice
            border = {t: float(np.clip(need * 1.001, 2 * border[t], 16 * border[t])) for t, need in zip(at, found["need"])}
        wide = np.array([max(border[t], 1e-9 * scale) for t in at])
        border = dict(zip(at, wide))
        box = found[["min(_x)", "min(_y)"]].to_numpy(float) - wide[:, None], found[["max(_x)", "max(_y)"]].to_numpy(float) + wide[:, None]
        parts = {t: -(-int(n) // PLACES) for t, n in zip(at, found["n"])}
        result = saved(_round(left.select(*names), knots, at, box, border, parts, hull, (low, scale), values, made, kinds, asked_kinds), "located")
        whole = np.array([(a <= low).all() and (b >= high).all() for a, b in zip(*box)])
        done = result.where("_need < 0").select("query_id", *columns)
        out = done if out is None else out.unionByName(done)
        left = result.where("_need >= 0").select(*names, "_need")
        if whole.any():  # all knots were known there: what is in no triangle lies outside by a rounding
            known = F.col("_tile").isin([int(t) for t in at[whole]])
            outside, left = outside.unionByName(left.where(known).select(*names)), left.where(~known)
    if out is None:
        out = spark.createDataFrame([], f"{asked_kinds}, {kinds}").select("query_id", *columns)
    return out, outside.select("query_id", "_x", "_y")


def _round(places, knots, at, box, border, parts, hull, frame, values, made, kinds, asked_kinds) -> DataFrame:
    """One round: knots go to all boxes that they are in, each box is triangulated, and its places are located."""
    spark, n = places.sparkSession, len(at)
    shared = spark.sparkContext.broadcast((at, *box, border, hull, frame))
    ids = knots.schema["id"].dataType.simpleString()
    fields = ["x", "y", "id", *values]

    def spread(frames):
        at, low, high = shared.value[:3]
        for f in frames:
            f = f.sort_values("x")
            x, y = f["x"].to_numpy(float), f["y"].to_numpy(float)
            first, last = np.searchsorted(x, low[:, 0], "left"), np.searchsorted(x, high[:, 0], "right")
            rows = [np.flatnonzero((y[a:b] >= lo) & (y[a:b] <= hi)) + a for a, b, lo, hi in zip(first, last, low[:, 1], high[:, 1])]
            out = f.iloc[np.concatenate(rows)]
            yield out.assign(_tile=np.repeat(at, [len(r) for r in rows]))

    def triangulated(f: pd.DataFrame) -> pd.DataFrame:
        low, scale = shared.value[5]
        f = f.sort_values("id")
        triangles, beside = delaunay(f[["x", "y"]].to_numpy(float), low, scale)
        return pd.DataFrame({"_tile": f["_tile"].iloc[:1].to_numpy(), **{c: [f[c].to_numpy()] for c in fields}, "triangles": [triangles.ravel().astype(np.int32)], "beside": [beside.ravel().astype(np.int32)]})

    def located(key: tuple, tile: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        at, low, high, border, hull, _ = shared.value
        names = ["query_id", "_x", "_y", "_tile"]
        q, out = f[["_x", "_y"]].to_numpy(float), {c: f[c].to_numpy() for c in names}
        if not len(f) or not len(tile):
            empty = {c.split()[0]: pd.Series([None] * len(f), dtype=object) for c in kinds.split(", ")}
            return pd.DataFrame(out | {"_need": np.full(len(f), 4 * border[key[0]])} | empty)
        row, k = tile.iloc[0], int(np.flatnonzero(at == key[0])[0])
        on = Located(np.column_stack([row["x"], row["y"]]), *(np.asarray(row[c], np.int64).reshape(-1, 3) for c in ("triangles", "beside")))
        triangle, w = on.weights(q)
        inside = np.flatnonzero(triangle >= 0)
        need = np.full(len(f), 4 * border[key[0]])
        if len(inside):
            good, reach = certified(on, triangle[inside], q[inside], low[k], high[k], hull)
            need[inside] = np.where(good, -1.0, np.maximum(reach, 0))
            triangle[inside[~good]] = -1
        kept = np.flatnonzero(triangle >= 0)
        results = made(on, triangle[kept], w[kept], np.asarray(row["id"]), {v: np.asarray(row[v], float) for v in values})
        frames = [pd.DataFrame({c: v[kept] for c, v in out.items()} | {"_need": need[kept]} | results)]
        rest = np.flatnonzero(triangle < 0)
        if len(rest):
            frames.append(pd.DataFrame({c: v[rest] for c, v in out.items()} | {"_need": need[rest]} | {c: (v.dtype.type() if v.dtype != object else None) for c, v in ((c, np.asarray(v)) for c, v in results.items())}))
        return pd.concat(frames, ignore_index=True) if len(rest) and len(kept) else frames[-1]

    known = knots.mapInPandas(spread, ", ".join(f"{c} {knots.schema[c].dataType.simpleString()}" for c in knots.columns) + ", _tile long")
    kind = "_tile long, x array<double>, y array<double>, id array<" + ids + ">" + "".join(f", {v} array<double>" for v in values) + ", triangles array<int>, beside array<int>"
    tiles = known.repartition(n, "_tile").groupBy("_tile").applyInPandas(triangulated, kind)
    many = F.create_map(*(F.lit(int(v)) for pair in parts.items() for v in pair)) if max(parts.values()) > 1 else None
    number = F.element_at(many, F.col("_tile").cast("int")) if many is not None else F.lit(1)
    tiles = tiles.withColumn("_part", F.explode(F.sequence(F.lit(0), number - 1)))
    asked = places.withColumn("_part", F.pmod(F.hash("query_id", "_x", "_y"), number))
    tasks = sum(parts.values())
    a, b = (df.repartition(tasks, "_tile", "_part").groupBy("_tile", "_part") for df in (tiles, asked))
    return a.cogroup(b).applyInPandas(located, f"{asked_kinds}, _need double, {kinds}")
