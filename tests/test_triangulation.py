"""Triangulations, surfaces, nearest knots and splines against their definitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from geostrata.operators import spatial
from geostrata.operators.triangulation import Cells, Located, clough_tocher, delaunay, gradients

KNOTS = {
    "random": np.random.default_rng(1).normal(size=(200, 2)), "grid": np.array([(i, j) for i in range(12) for j in range(9)], float), "clusters": np.concatenate([np.random.default_rng(2).normal(size=(80, 2)) * s + s for s in (1e-6, 1, 1e4)]),
    "line and one": np.array([*((i, 0) for i in range(20)), (3.3, 5)], float), "repeated": np.repeat(np.random.default_rng(3).uniform(size=(30, 2)), 3, 0), "circle": np.array([(np.cos(a), np.sin(a)) for a in np.linspace(0, 2 * np.pi, 41)]),
}


def area(p):
    return ((p[..., 1, 0] - p[..., 0, 0]) * (p[..., 2, 1] - p[..., 0, 1]) - (p[..., 1, 1] - p[..., 0, 1]) * (p[..., 2, 0] - p[..., 0, 0])) / 2


@pytest.mark.parametrize("kind", KNOTS)
def test_triangles_cover_the_hull_and_their_circles_are_empty(kind):
    xy = KNOTS[kind]
    triangles, beside = delaunay(xy)
    hull = spatial.convex_hull(xy)
    whole = sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(hull, np.roll(hull, -1, 0))) / 2
    assert (area(xy[triangles]) > 0).all() and area(xy[triangles]).sum() == pytest.approx(whole)
    for own, near in zip(triangles, beside):
        a, b, c = xy[own]
        center = np.linalg.lstsq(2 * np.array([b - a, c - a]), np.array([b @ b - a @ a, c @ c - a @ a]), rcond=None)[0]
        assert (np.hypot(*(xy - center).T) >= np.hypot(*(a - center)) * (1 - 1e-5)).all()
        for k, n in enumerate(near):
            assert n < 0 or {own[(k + 1) % 3], own[(k + 2) % 3]} <= set(triangles[n])
    assert kind == "repeated" or len(np.unique(triangles)) == len(np.unique(xy.round(12), axis=0))


def test_knots_of_one_line_have_no_triangles():
    for xy in (np.array([(i, 2.0 * i) for i in range(9)]), np.zeros((5, 2)), np.zeros((0, 2)), np.ones((2, 2))):
        assert len(delaunay(xy)[0]) == 0


@pytest.mark.parametrize("kind", KNOTS)
def test_places_are_located_with_their_weights(kind):
    xy, rng = KNOTS[kind], np.random.default_rng(7)
    triangles, beside = delaunay(xy)
    located = Located(xy, triangles, beside)
    q = np.concatenate([rng.uniform(xy.min(0) - np.ptp(xy) / 9, xy.max(0) + np.ptp(xy) / 9, (400, 2)), xy])
    at, w = located.weights(q)
    inside = at >= 0
    assert np.allclose((w[inside][:, :, None] * xy[triangles[at[inside]]]).sum(1), q[inside], atol=1e-9 * np.ptp(xy)) and (w >= 0).all()
    hull = spatial.convex_hull(xy)
    edge = np.roll(hull, -1, 0) - hull
    side = (edge[:, 0] * (q[:, None, 1] - hull[:, 1]) - edge[:, 1] * (q[:, None, 0] - hull[:, 0])).min(1)
    assert inside[side > 1e-9 * np.ptp(xy) ** 2].all() and not inside[side < -1e-9 * np.ptp(xy) ** 2].any()


def test_surfaces_have_no_creases_and_meet_quadratic_functions():
    xy, rng = KNOTS["random"], np.random.default_rng(8)
    triangles, beside = delaunay(xy)
    located = Located(xy, triangles, beside)
    f, g = (lambda p: 2 * p[..., 0] ** 2 - 3 * p[..., 0] * p[..., 1] + p[..., 1] ** 2 + p[..., 0] - 4), (lambda p: np.stack([4 * p[..., 0] - 3 * p[..., 1] + 1, -3 * p[..., 0] + 2 * p[..., 1]], -1))
    q = rng.normal(size=(2000, 2)) * 0.7
    at, w = located.weights(q)
    own, inside = triangles[at[at >= 0]], at >= 0
    assert np.allclose(clough_tocher(xy[own], f(xy)[own], g(xy)[own], w[inside]), f(q[inside]), atol=1e-9)
    # any values and gradients: on both sides of an edge the surface and its slope across it agree
    values, slopes = rng.normal(size=len(xy)), rng.normal(size=(len(xy), 2))
    t, k = np.nonzero(beside >= 0)
    a, b = xy[triangles[t, (k + 1) % 3]], xy[triangles[t, (k + 2) % 3]]
    middle = a + (b - a) * rng.uniform(0.2, 0.8, (len(t), 1))
    normal = np.stack([-(b - a)[:, 1], (b - a)[:, 0]], 1) / np.hypot(*(b - a).T)[:, None]

    def surface(tri, p):
        c = xy[triangles[tri]]
        w = np.stack([area(np.stack([p, c[:, (i + 1) % 3], c[:, (i + 2) % 3]], 1)) for i in range(3)], 1) / area(c)[:, None]
        return clough_tocher(c, values[triangles[tri]], slopes[triangles[tri]], w)

    h = 1e-6 * np.sqrt(np.minimum(area(xy[triangles[t]]), area(xy[triangles[beside[t, k]]])))[:, None]
    here, there = surface(t, middle + h * normal), surface(beside[t, k], middle - h * normal)
    on = surface(t, middle)
    assert np.allclose(on, surface(beside[t, k], middle), atol=1e-8)
    assert np.abs((here - on) - (on - there)).max() < 5e-3 * np.abs(here - there).max()
    assert np.allclose(gradients(xy, triangles, xy @ [3.0, -2.0] + 1), [3.0, -2.0], atol=1e-6)


def test_gradients_bend_the_edges_least():
    xy, rng = KNOTS["random"][:40], np.random.default_rng(9)
    triangles, _ = delaunay(xy)
    values = rng.normal(size=40)
    edges = {tuple(sorted((t[i], t[i - 1]))) for t in triangles.tolist() for i in range(3)}

    def energy(g):
        total = 0
        for a, b in edges:
            e = xy[b] - xy[a]
            s, t, d = g[a] @ e, g[b] @ e, values[b] - values[a]
            total += (s * s + s * t + t * t - 3 * d * (s + t) + 3 * d * d) / np.hypot(*e) ** 3
        return total

    best = gradients(xy, triangles, values)
    assert all(energy(best) <= energy(best + rng.normal(size=(40, 2)) * s) for s in (1e-3, 1e-2, 0.1, 1) for _ in range(20))


def test_nearest_knots_are_those_of_a_full_search():
    rng = np.random.default_rng(3)
    for xy in (*KNOTS.values(), np.zeros((4, 2)), np.ones((1, 2))):
        for q in (xy[:50], rng.normal(size=(60, 2)) * 3, rng.normal(size=(20, 2)) * 1e5):
            for k in (1, 4, 50):
                at, far = Cells(xy).nearest(q, k)
                d = q[:, None] - xy[None]
                full = np.sqrt(d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1])
                wanted = np.argsort(full, 1, kind="stable")[:, :k]
                assert (at == wanted).all() and (far == np.take_along_axis(full, wanted, 1)).all()
    assert Cells(np.zeros((0, 2))).nearest(rng.normal(size=(3, 2)), 4)[0].shape == (3, 0)


def test_surfaces_through_points_of_a_table(spark):
    rng = np.random.default_rng(6)
    rows = [(i, float(x), float(y), float(np.sin(x) * y), float(3 * x - y)) for i, (x, y) in enumerate(rng.uniform(-2, 2, (300, 2)))]
    points = spark.createDataFrame(rows, "id long, x double, y double, v double, u double")
    places = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate([*rng.uniform(-1.7, 1.7, (100, 2)), (9.0, 9.0), rows[5][1:3]])], "id long, x double, y double")
    found = {r.query_id: r for r in spatial.clough_tocher(places, points, "id", "id", ["v", "u"]).collect()}
    at = {r.id: (r.x, r.y) for r in places.collect()}
    assert len(found) == 102 and max(abs(found[i].v - np.sin(x) * y) for i, (x, y) in at.items() if i != 100) < 0.05
    assert max(abs(found[i].u - 3 * x + y) for i, (x, y) in at.items() if i != 100) < 1e-6 and found[101].v == pytest.approx(rows[5][3])
    assert min(r[3] for r in rows) <= found[100].v <= max(r[3] for r in rows)
    with pytest.raises(ValueError, match="knots at most"):
        spatial.clough_tocher(places, spark.range(spatial.BROADCAST_POINTS + 1).selectExpr("id", "double(id) x", "double(id % 7) y", "1.0d v"), "id", "id", ["v"])


def test_splines_in_boxes_are_near_the_whole_one(spark):
    rng = np.random.default_rng(5)
    points = rng.uniform(0, 10, (900, 2))
    values = np.sin(points[:, 0]) + 0.3 * points[:, 1]
    df = spark.createDataFrame([(float(x), float(y)) for x, y in [*rng.uniform(0.5, 9.5, (200, 2)), *points[:20], (30.0, 5.0)]], "x double, y double").repartition(3)
    whole, boxed = (spatial.rbf(df, points, values, most=n).orderBy("x", "y").toPandas() for n in (2000, 100))
    near = whole.x < 20
    assert np.abs(whole.value - boxed.value)[near].max() < 2e-3 and np.isfinite(boxed.value).all()
    assert np.abs(np.sin(whole.x) + 0.3 * whole.y - boxed.value)[near].max() < 0.02
    assert spatial.rbf(df, points[:3], values[:3]).where(F.isnan("value")).count() == 0
