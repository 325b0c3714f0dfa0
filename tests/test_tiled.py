"""Triangulations made in tiles give what one triangulation of all knots gives."""

import time

import numpy as np
import pandas as pd
import pytest

from geostrata.operators import fields, spatial, tiled
from geostrata.operators.triangulation import delaunay


@pytest.fixture
def small(monkeypatch):
    """Bounds so low that small tables take the way of large ones."""
    for module, name, value in ((spatial, "BROADCAST_POINTS", 200), (tiled, "KNOTS", 150), (tiled, "PLACES", 300)):
        monkeypatch.setattr(module, name, value)


def tables(spark, xy, q, **columns):
    frames = (pd.DataFrame({"id": np.arange(len(p)), "x": p[:, 0], "y": p[:, 1]}) for p in (xy, q))
    known, places = (spark.createDataFrame(f.assign(**(columns if i == 0 else {}))) for i, f in enumerate(frames))
    return known, places


def around(xy, n, rng):
    low, high = xy.min(0), xy.max(0)
    return rng.uniform(low - (high - low) / 20, high + (high - low) / 20, (n, 2))


def test_clough_tocher_of_more_knots_than_are_broadcast(spark, small):
    """F1."""
    rng = np.random.default_rng(1)
    xy, q = rng.uniform(size=(700, 2)) * [900, 400], rng.uniform(size=(500, 2)) * [940, 420] - [20, 10]
    f = lambda p: 0.02 * p[:, 0] ** 2 - 0.03 * p[:, 0] * p[:, 1] + 5 * p[:, 0] - 7
    known, places = tables(spark, xy, q, v=f(xy), by_x=0.04 * xy[:, 0] - 0.03 * xy[:, 1] + 5, by_y=-0.03 * xy[:, 0])
    found = spatial.clough_tocher(places, known, "id", "id", ["v"], slopes={"v": ("by_x", "by_y")}).toPandas().sort_values("query_id")
    inside = tiled.within(spatial.convex_hull(xy), q, 900.0)
    assert found["query_id"].tolist() == list(range(500)) and 0 < inside.sum() < 500
    assert np.allclose(found["v"][inside], f(q)[inside], atol=1e-6)
    assert found["v"][~inside].between(f(xy).min(), f(xy).max()).all()


def test_triangles_do_not_depend_on_order_or_part():
    xy = np.array([(i, j) for i in range(20) for j in range(20)], float)
    corners = lambda p, t: {frozenset(map(tuple, p[c])) for c in t}
    whole = corners(xy, delaunay(xy)[0])
    turned, half = xy[np.random.default_rng(2).permutation(400)], xy[xy[:, 0] < 10]
    assert corners(turned, delaunay(turned)[0]) == whole
    assert corners(half, delaunay(half, xy.min(0), 19.0)[0]) <= whole


def test_columns_of_knots_are_triangulated_quickly():
    xy = np.column_stack([np.repeat(np.arange(3) * 100.0, 2500), np.random.default_rng(4).permutation(300_000)[:7500] / 1000])
    begin = time.process_time()
    assert len(delaunay(xy)[0]) > 9_000
    assert time.process_time() - begin < 5  # 0.5 s; 25 s when knots were added along the curve only


def test_tiles_hold_few_knots_each(spark):
    rng = np.random.default_rng(3)
    xy = np.concatenate([rng.normal(size=(400, 2)) * s + s * 3 for s in (1e-4, 1, 1e3)])
    known, _ = tables(spark, xy, xy[:1])
    tiles = tiled.tiles_of(known, xy.min(0), xy.max(0), 60)
    assert np.bincount(tiles.of(xy)).max() <= 60 and sum(tiles.count) == len(xy)


def same_weights(spark, monkeypatch, xy, q):
    known, places = tables(spark, xy, q)
    tiled_rows = spatial.delaunay_weights(places, known, "id", "id").toPandas()
    monkeypatch.setattr(spatial, "BROADCAST_POINTS", 100_000)
    whole = spatial.delaunay_weights(places, known, "id", "id").toPandas()
    both = tiled_rows.merge(whole, on=["query_id", "point_id"], how="outer").fillna(0)
    assert tiled_rows["query_id"].nunique() == len(q) and (both["weight_x"] - both["weight_y"]).abs().max() < 1e-6


def test_delaunay_weights_of_more_knots_than_are_broadcast(spark, small, monkeypatch):
    """a lattice that leans over, as long as it is narrow, with places outside."""
    rng = np.random.default_rng(6)
    xy = np.array([(100.0 * i + 30 * j, 90.0 * j) for i in range(90) for j in range(10)])
    same_weights(spark, monkeypatch, np.concatenate([xy, xy[200:230]]), around(xy, 500, rng))


def test_fields_between_more_knots_than_are_broadcast(spark, small):
    """models are linear in time and place, so any triangle gives their values."""
    rng = np.random.default_rng(7)
    xy = rng.uniform(size=(500, 2)) * 100
    q = rng.uniform(size=(300, 2)) * 60 + 20
    v = lambda p: 1500 + 3 * p[:, 0] - 2 * p[:, 1]
    known, places = tables(spark, xy, q, v=v(xy))
    field = known.selectExpr("id", "x", "y", "array(0d, 1000d) as t", "array(v, v + 500) as vel")
    found = fields.interpolate(field, places, "id", "t", "vel", [0.0, 500.0], interpolator="delaunay").toPandas().sort_values(["t", "query_id"])
    assert np.allclose(found["v"], np.concatenate([v(q), v(q) + 250]), atol=1e-6)


def test_columns_of_more_knots_than_are_broadcast(spark, small, monkeypatch):
    """columns far apart, whose tiles know no triangle at first."""
    rng = np.random.default_rng(8)
    xy = np.column_stack([rng.integers(0, 25, 1200) * 100.0, rng.permutation(110_000)[:1200] / 100])
    same_weights(spark, monkeypatch, xy, around(xy, 400, rng))
