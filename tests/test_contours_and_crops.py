"""Outlines against following borders bin by bin, and crops against padded arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from geostrata.operators import contours, crops, geometry


def followed(mask):
    """The outer outlines of a set of bins, by walking around each connected part; corners only."""
    left, found = set(mask), []
    while left:
        start = min(left)
        part, todo = {start}, [start]
        while todo:
            a, b = todo.pop()
            for n in ((a + i, b + k) for i in (-1, 0, 1) for k in (-1, 0, 1)):
                if n in left and n not in part:
                    part.add(n)
                    todo.append(n)
        left -= part
        # start is the lowest of the leftmost: nothing lies before it; turn around the present bin, beginning after where the way came from
        ring, here, came = [start], start, 4
        around = [(-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1)]
        first = None
        while len(part) > 1:
            k = next(k % 8 for k in range(came + 1, came + 9) if (here[0] + around[k % 8][0], here[1] + around[k % 8][1]) in part) if first is not None else next(k for k in range(8) if (here[0] + around[k][0], here[1] + around[k][1]) in part)
            if first is None:
                first = k
            elif here == start and k == first:
                break
            here = (here[0] + around[k][0], here[1] + around[k][1])
            ring.append(here)
            came = (k + 4) % 8
        ring = ring[:-1] if len(ring) > 1 else ring
        turns = [p for i, p in enumerate(ring) if len(ring) == 1 or (p[0] - ring[i - 1][0], p[1] - ring[i - 1][1]) != (ring[(i + 1) % len(ring)][0] - p[0], ring[(i + 1) % len(ring)][1] - p[1])]
        found.append(turns)
    return found


def rotated(ring):
    """A ring begun at its least corner, the same whichever way around."""
    ring = [tuple(map(int, p)) for p in ring]
    return min(tuple(way[i:] + way[:i]) for way in (ring, ring[::-1]) for i in range(len(ring)))


def test_outlines_are_the_followed_borders(spark):
    rng = np.random.default_rng(5)
    masks = [{(a, b) for a in range(9) for b in range(7) if not (3 <= a <= 5 and 2 <= b <= 4)} | {(20 + a, b - 3) for a in range(4) for b in range(a + 1)} | {(40, 0)}, {(0, 0), (1, 1), (2, 2), (3, 1), (2, 3)}]
    masks += [{(int(a), int(b)) for a, b in rng.integers(0, 9, (n, 2))} for n in (20, 40, 60)]
    for mask in masks:
        df = spark.createDataFrame([(a, b, 1) for a, b in mask] * 2 + [(None, 1, 1)], "il int, xl int, id int").repartition(3)
        found = sorted(rotated(c) for c in contours.contours(df, ("il", "xl")))
        wanted = [rotated(r) for r in followed(mask)]
        assert set(found) <= set(wanted) and len(found) >= 1
        for ring in set(wanted) - set(found):  # only such as lie within another outline are missing
            inside = geometry.contour_distance(spark.createDataFrame([ring[0]], "x int, y int"), [list(r) for r in found], "x", "y").first().distance
            assert inside > 0


def test_a_survey_with_a_hole_and_two_parts(spark):
    mask = [(a, b) for a in range(9) for b in range(7) if not (3 <= a <= 5 and 2 <= b <= 4)] + [(a, b) for a in range(20, 24) for b in range(3)]
    df = spark.createDataFrame(mask, "il int, xl int")
    rings = contours.contours(df, ("il", "xl"))
    assert [rotated(r) for r in rings] == [((0, 0), (0, 6), (8, 6), (8, 0)), ((20, 0), (20, 2), (23, 2), (23, 0))]
    places = spark.createDataFrame([(4.0, 3.0, 3.0), (-2.0, 3.0, -2.0), (21.0, 1.0, 1.0), (14.0, 3.0, -6.0)], "x double, y double, wanted double")
    assert all(r.distance == pytest.approx(r.wanted, abs=0.2) for r in geometry.contour_distance(places, rings, "x", "y").collect())
    found = contours.described(df, ("il", "xl"), dict(zip(geometry.AFFINE, (3.0, -8.0, 5.0, 4.0, 6.0, 5.0))))
    assert found == pytest.approx({"n_bins": 66, "first_size": 5, "second_size": 10, "first_length": 24 * 5, "second_length": 70, "area": 66 * 50, "perimeter": 2 * (8 * 5 + 6 * 10) + 2 * (3 * 5 + 2 * 10)})


@pytest.mark.parametrize("mode", ["constant", "edge", "reflect", "symmetric", "wrap"])
def test_crops_are_cut_from_padded_gathers(spark, mode):
    rng = np.random.default_rng(1)
    gathers = {g: rng.normal(size=(n, 6)) for g, n in ((0, 5), (1, 2), (2, 1))}
    df = spark.createDataFrame([(g, i, row.tolist(), (-row).tolist()) for g, x in gathers.items() for i, row in enumerate(x)], "g int, pos int, data array<double>, other array<double>")
    origins, shape = [(0, 0), (3, 4), (1, 13), (7, 2)], (4, 5)
    out = crops.crops(df, crops.listed(crops.sizes(df, ["g"], "data"), ["g"], origins), ["g"], ["data", "other"], "pos", shape, mode, 9.0)
    found = {(r.g, int(r.crop), r.row): r for r in out.collect()}
    assert len(found) == 3 * 4 * 4
    for g, x in gathers.items():
        padded = np.pad(x, ((0, 12), (0, 20)), mode=mode, **({"constant_values": 9.0} if mode == "constant" else {}))
        other = np.pad(-x, ((0, 12), (0, 20)), mode=mode, **({"constant_values": 9.0} if mode == "constant" else {}))
        for k, (a, b) in enumerate(origins):
            for i in range(4):
                r = found[g, k, i]
                assert r.data == padded[a + i, b : b + 5].tolist() and r.other == other[a + i, b : b + 5].tolist()


def test_grids_and_drawn_origins(spark):
    df = spark.createDataFrame([(g, i, [float(10 * i + k) for k in range(11)]) for g, n in ((0, 7), (1, 3)) for i in range(n)], "g int, pos int, data array<double>")
    gathers, shape = crops.sizes(df, ["g"], "data"), (3, 4)
    origins = crops.grid(gathers, ["g"], shape, (2, 5))
    assert sorted((r.g, r.origin_trace, r.origin_sample) for r in origins.collect()) == [(0, a, b) for a in (0, 2, 4) for b in (0, 5, 7)] + [(1, 0, b) for b in (0, 5, 7)]
    whole = crops.assembled(crops.crops(df, crops.grid(gathers, ["g"], shape), ["g"], ["data"], "pos", shape), gathers, ["g"], "data")
    assert sorted((r.g, r.trace, r.i, r.x) for r in whole.collect()) == sorted((g, i, k, float(10 * i + k)) for g, n in ((0, 7), (1, 3)) for i in range(n) for k in range(11))
    drawn = crops.drawn(gathers, ["g"], shape, 800, seed=3).collect()
    assert {(r.g, r.origin_trace, r.origin_sample) for r in drawn} == {(0, a, b) for a in range(5) for b in range(8)} | {(1, 0, b) for b in range(8)}
    assert drawn == crops.drawn(gathers, ["g"], shape, 800, seed=3).collect() and len(drawn) == 1600
    with pytest.raises(ValueError):
        crops.listed(gathers, ["g"], [(-1, 0)])
