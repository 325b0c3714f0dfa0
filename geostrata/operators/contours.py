"""Outlines of a survey's bins.

The sides of bins that have no neighbour are joined to one another: where a side ends, the bins around that corner tell which side follows. Pointers to
the following side are doubled until every side knows its ring and its place in it, so a ring of n sides takes log n joins. Only corners, where a ring
turns, come to the driver; an outline runs through the middles of its bins.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geostrata.sources.scratch import saved

#: Sides in the order in which they follow one another around a bin: where the neighbour is missing, and the way along the side.
_SIDES = [((0, 1), (1, 0)), ((1, 0), (0, -1)), ((0, -1), (-1, 0)), ((-1, 0), (0, 1))]


def sides(bins: DataFrame) -> DataFrame:
    """id, next, a, b, side: the free sides of ``bins`` (a, b; distinct), each with the one that follows. Bins that meet at a corner are connected.

    At the end of a side its ring goes on with the bin across the corner if there is one, else with the next bin along, else around the same bin.
    """
    rows = None
    for k, ((da, db), (ea, eb)) in enumerate(_SIDES):
        one = bins.select("a", "b", F.lit(k).alias("side"), (F.col("a") + da).alias("na"), (F.col("b") + db).alias("nb"), (F.col("a") + ea).alias("sa"), (F.col("b") + eb).alias("sb"))
        rows = one if rows is None else rows.unionByName(one)
    known = lambda a, b, name: bins.select(F.col("a").alias(a), F.col("b").alias(b), F.lit(True).alias(name))
    free = rows.join(known("na", "nb", "_taken"), ["na", "nb"], "left_anti")
    free = free.withColumns({"ca": F.col("na") + F.col("sa") - F.col("a"), "cb": F.col("nb") + F.col("sb") - F.col("b")})
    free = free.join(known("sa", "sb", "along"), ["sa", "sb"], "left").join(known("ca", "cb", "across"), ["ca", "cb"], "left")
    key = lambda a, b, side: F.concat_ws(":", a, b, side.cast("string"))
    turned = lambda by: F.pmod(F.col("side") + by, F.lit(4))
    after = F.when(F.col("across"), key("ca", "cb", turned(-1))).when(F.col("along"), key("sa", "sb", F.col("side"))).otherwise(key("a", "b", turned(1)))
    return free.select(key("a", "b", F.col("side")).alias("id"), after.alias("next"), "a", "b", "side")


def ringed(links: DataFrame) -> DataFrame:
    """id, ring (the least id of its ring) and place (steps from that) of ``links`` (id, next), each of whose rings is closed."""
    state = saved(links.select("id", "next", F.least("id", "next").alias("low")), "rings")
    while True:
        ahead = state.select(F.col("id").alias("next"), F.col("next").alias("_next"), F.col("low").alias("_low"))
        new = saved(state.join(ahead, "next").select("id", F.col("_next").alias("next"), F.least("low", "_low").alias("low"), (F.col("_low") < F.col("low")).alias("changed")), "rings")
        if new.where("changed").isEmpty():
            break
        state = new.drop("changed")
    rings = new.select("id", F.col("low").alias("ring"))
    # the ring is cut before its least id: how many steps are left to that end
    steps = saved(links.select("id", "next").join(rings, "id").select("id", "ring", F.when(F.col("next") != F.col("ring"), F.col("next")).alias("next"), F.lit(1).cast("long").alias("left")), "steps")
    while not steps.where("next is not null").isEmpty():
        ahead = steps.select(F.col("id").alias("next"), F.col("next").alias("_next"), F.col("left").alias("_left"))
        steps = saved(steps.join(ahead, "next", "left").select("id", "ring", F.col("_next").alias("next"), (F.col("left") + F.coalesce("_left", F.lit(0))).alias("left")), "steps")
    sizes = steps.groupBy("ring").agg(F.max("left").alias("size"))
    return steps.join(sizes, "ring").select("id", "ring", (F.col("size") - F.col("left")).alias("place"), "size")


def outlines(df: DataFrame, bins: tuple[str, str]) -> DataFrame:
    """ring, place, a, b: the bins at which the outer outlines of connected bins turn, in order. Holes are left out; a single bin is a ring of one."""
    distinct = saved(df.select(F.col(bins[0]).cast("long").alias("a"), F.col(bins[1]).cast("long").alias("b")).where("a is not null and b is not null").distinct(), "bins")
    free = saved(sides(distinct), "sides")
    placed = free.drop("next").join(ringed(free), "id")
    # twice the area to the right of the way around: rings around holes have it negative
    start = F.array(*(F.struct(F.lit(da - ea).alias("a"), F.lit(db - eb).alias("b")) for (da, db), (ea, eb) in _SIDES))
    stop = F.array(*(F.struct(F.lit(da + ea).alias("a"), F.lit(db + eb).alias("b")) for (da, db), (ea, eb) in _SIDES))
    x0, y0, x1, y1 = (2 * F.col(c) + F.get(s, F.col("side"))[c] for s in (start, stop) for c in ("a", "b"))
    outer = placed.withColumn("twice", y0 * x1 - x0 * y1).groupBy("ring").agg(F.sum("twice").alias("twice"), F.min(F.struct("a", "b")).alias("least")).where("twice > 0").select("ring")
    around = placed.join(outer, "ring")
    w = Window.partitionBy("ring").orderBy("place")
    # one row for every bin that the way passes, and of these where it turns
    moved = around.withColumns({"pa": F.lag("a").over(w), "pb": F.lag("b").over(w)}).where("pa is null or pa != a or pb != b")
    ends = moved.groupBy("ring").agg(F.min_by(F.struct("a", "b"), "place").alias("first"), F.max_by(F.struct("a", "b"), "place").alias("last"), F.count("*").alias("n"))
    moved = moved.join(ends, "ring").where((F.col("n") == 1) | (F.col("place") > 0) | (F.col("first") != F.col("last")))
    before, after = (lambda c: F.coalesce(F.lag(c).over(w), F.last(c).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))), (lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    ways = moved.withColumns({"ia": F.col("a") - before("a"), "ib": F.col("b") - before("b"), "oa": after("a") - F.col("a"), "ob": after("b") - F.col("b")})
    return ways.where("n = 1 or ia != oa or ib != ob").select("ring", "place", "a", "b")


def contours(df: DataFrame, bins: tuple[str, str]) -> list[np.ndarray]:
    """The outlines as arrays of corners, those with the least bins first; such as lie inside another one are left out."""
    rows = outlines(df, bins).orderBy("ring", "place").toPandas()  # the corners of an outline
    found = [part[["a", "b"]].to_numpy(float) for _, part in rows.groupby("ring", sort=False)]
    found.sort(key=lambda c: c.min(0).tolist())

    def holds(ring, p):
        a, b = ring, np.roll(ring, -1, 0)
        crosses = (a[:, 1] > p[1]) != (b[:, 1] > p[1])
        at = a[:, 0] + (p[1] - a[:, 1]) * (b[:, 0] - a[:, 0]) / np.where(crosses, b[:, 1] - a[:, 1], 1)
        return (crosses & (p[0] < at)).sum() % 2 == 1

    return [c for i, c in enumerate(found) if not any(k != i and holds(ring, c[0]) for k, ring in enumerate(found))]


def described(df: DataFrame, bins: tuple[str, str], affine: dict[str, float]) -> dict[str, float]:
    """n_bins, bin sizes, lengths, area and perimeter of a survey whose bins have the given map to coordinates."""
    n, la, ha, lb, hb = df.select(*bins).distinct().agg(F.count("*"), F.min(bins[0]), F.max(bins[0]), F.min(bins[1]), F.max(bins[1])).first()
    m = np.array([[affine["x_by_first"], affine["x_by_second"]], [affine["y_by_first"], affine["y_by_second"]]])
    u, s, vt = np.linalg.svd(m)
    size = np.diag(vt.T @ np.diag(s) @ vt)  # the stretch of the map, without its turn
    around = sum(float(np.hypot(*((np.roll(c, -1, 0) - c) @ m.T).T).sum()) for c in contours(df, bins))
    return {"n_bins": n, "first_size": float(size[0]), "second_size": float(size[1]), "first_length": (ha - la + 1) * float(size[0]), "second_length": (hb - lb + 1) * float(size[1]), "area": n * float(size.prod()), "perimeter": around}
