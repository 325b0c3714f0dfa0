"""Models and places against plain versions."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from geostrata.operators import fields, geometry, headers, muters, nearsurface, spatial, velocity


def test_affine_maps_are_inverse(spark):
    affine = dict(zip(geometry.AFFINE, (12.0, -3.0, 1000.0, 4.0, 25.0, -70.0)))
    df = spark.range(50).select((F.col("id") % 7).alias("a"), (F.col("id") * 3 - 20).alias("b"))
    there = geometry.transform_coords(df, affine, ("a", "b"), True)
    back = geometry.transform_coords(there, affine, ("a", "b"), False).collect()
    assert sorted((round(r.a, 6), round(r.b, 6)) for r in back) == sorted((r.a, r.b) for r in df.collect())
    with pytest.raises(ValueError):
        geometry.coords_to_bins(df, dict.fromkeys(geometry.AFFINE, 1.0), ("a", "b"))


def test_distances_to_contours(spark):
    """Against the nearest of many points on the borders, and ray casting, for polygons that are not convex."""
    rng = np.random.default_rng(4)
    star = [(np.cos(a) * r, np.sin(a) * r) for a, r in zip(np.linspace(0, 2 * np.pi, 11)[:-1], itertools.cycle([10, 4]))]
    box = [(20, -5), (30, -5), (30, 5), (20, 5)]
    places = [(float(x), float(y)) for x, y in rng.uniform(-15, 35, (60, 2))]
    df = geometry.contour_distance(spark.createDataFrame(places, "x double, y double"), [star, box], "x", "y")
    for r in df.collect():
        signed = []
        for corners in (star, box):
            c = np.array(corners, float)
            d = np.roll(c, -1, 0) - c
            border = (c[:, None] + np.linspace(0, 1, 4001)[None, :, None] * d[:, None]).reshape(-1, 2)
            far = np.hypot(border[:, 0] - r.x, border[:, 1] - r.y).min()
            inside = sum((c[i][1] > r.y) != (c[i - 1][1] > r.y) and r.x < c[i][0] + (r.y - c[i][1]) * (c[i - 1][0] - c[i][0]) / (c[i - 1][1] - c[i][1]) for i in range(len(c))) % 2
            signed.append(far if inside else -far)
        assert r.distance == pytest.approx(min(signed, key=abs), abs=1e-3)


def test_uphole_flags_and_ids(spark):
    df = spark.createDataFrame([(1, 0, None), (1, 2, 0), (2, None, 0)], "s int, SourceUpholeTime int, z int")
    assert geometry.is_uphole(df).first()[0] is True and geometry.is_uphole(df.where("SourceUpholeTime = 0")).first()[0] is False
    assert geometry.is_uphole(df.select("s")).first()[0] is None and geometry.is_uphole(df.limit(0)).first()[0] is False
    assert tuple(geometry.ids(df, ["s", "SourceUpholeTime"]).first()) == (3, 1, False) and geometry.ids(df, ["z"]).first().all_zero
    with pytest.raises(ValueError):
        geometry.ids(df, ["nothing"])


def test_gathers_are_numbered_over_ranges(spark):
    df = spark.createDataFrame([(int(x) % 97, int(x)) for x in np.random.default_rng(2).permutation(500)], "g int, t int").repartition(7)
    found = headers.gather_numbers(df, ["g"]).select("g", "gather_pos").distinct().orderBy("g").collect()
    assert [tuple(r) for r in found] == [(i, i) for i in range(97)]


def test_delaunay_outside_the_hull_is_by_distance(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 4.0, 0.0), (3, 0.0, 4.0), (4, 4.0, 4.0)], "id long, x double, y double")
    queries = spark.createDataFrame([(10, 1.0, 0.5), (11, 9.0, 9.0), (12, 4.0, 0.0)], "id long, x double, y double")
    rows = spatial.delaunay_weights(queries, points, "id", "id").collect()
    weights = {q: {r.point_id: r.weight for r in rows if r.query_id == q} for q in (10, 11, 12)}
    assert all(sum(w.values()) == pytest.approx(1) for w in weights.values()) and weights[12] == pytest.approx({2: 1.0})
    assert 4 in weights[11] and max(weights[11], key=weights[11].get) == 4
    line = points.where("x = 0")  # points of one line have no triangles: all places are outside
    assert spatial.delaunay_weights(queries.where("id = 10"), line, "id", "id").count() == 2


def test_distances_are_transformed_by_functions(spark):
    pairs = spark.createDataFrame([(1, 1, 1.0), (1, 2, 2.0)], "query_id long, point_id long, dist double")
    found = {r.point_id: r.weight for r in spatial.idw_weights(pairs, power=lambda d: F.exp(d)).collect()}
    assert found[1] / found[2] == pytest.approx(np.e)


def test_weighted_muters(spark):
    df = spark.createDataFrame([(1, [0.0, 10.0], [0.0, 10.0], 1.0), (1, [0.0, 5.0], [4.0, 9.0], 3.0)], "g int, x array<double>, y array<double>, w double")
    r = muters.weighted(df, ["g"], weight="w").first()
    assert r.x == [0, 5, 10] and r.y == pytest.approx([(0 + 3 * 4) / 4, (5 + 3 * 9) / 4, (10 + 3 * 14) / 4])
    with pytest.raises(Exception, match="positive"):
        muters.from_refractors(spark.createDataFrame([(1, 0.0, 50.0)], "id int, t0 double, v1 double"), ["id"], 1, velocity_reduction=60.0).collect()


def test_parameters_of_models_are_checked():
    good = {"t0": 5.0, "x1": 100.0, "v1": 1500.0, "v2": 2500.0}
    assert velocity.check_params(good, 500, 100, 50) == good and velocity.constant_refractor(800) == {"t0": 0.0, "v1": 800.0}
    bounds = {k: (v - 1, v + 1) for k, v in good.items()}
    assert velocity.check_params(good, bounds=bounds) == good
    for bad, more in [({**good, "v1": -1.0}, {}), ({**good, "v2": 1400.0}, {}), (good, {"min_size": 150}), (good, {"max_offset": 90.0}), (good, {"min_velocity_step": 2000}), ({"t0": 1.0, "x2": 1.0}, {}), (good, {"bounds": {**bounds, "t0": (6.0, 4.0)}}), (good, {"bounds": {**bounds, "x1": (0.0, 9.0)}}), (good, {"bounds": {"t0": (0.0, 9.0)}})]:
        with pytest.raises(ValueError):
            velocity.check_params(bad, **more)


def test_missing_parameters_are_completed_and_bounds_are_kept():
    x = np.linspace(0, 1000, 200)
    t = nearsurface.arrival_times(x, 12.0, np.array([400.0]), np.array([1500.0, 3000.0]))
    full = nearsurface.complete_init({"x1": 400.0}, x, t, 2)
    assert full == pytest.approx({"t0": 12.0, "x1": 400.0, "v1": 1500.0, "v2": 3000.0}, rel=1e-3)
    assert list(nearsurface.complete_init({"v1": 1400.0}, x, t, 3)) == velocity.param_names(3)
    fitted = nearsurface.fit_refractors(x, t, 2, init={"x1": 380.0}, bounds={"t0": (0.0, 20.0), "x1": (300.0, 390.0), "v1": (1400.0, 1600.0), "v2": (2900.0, 3100.0)})
    assert fitted["x1"] <= 390 and velocity.check_params(fitted) and 2900 <= fitted["v2"] <= 3100
    assert nearsurface.fit_refractors(x, t, 1, max_offset=390.0)["v1"] == pytest.approx(1500, rel=1e-3)


def test_steps_are_enforced_around_what_is_fixed():
    out = nearsurface.rising(np.array([5.0, 4.0, 3.0, 9.0, 9.0]), np.array([1, 1e9, 1, 1e9, 1]), 1.0)
    assert out == pytest.approx([3, 4, 5, 9, 10], abs=1e-6)


def test_models_that_are_no_models(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (None, [1.0, 2.0])], "x int, v array<double>")
    assert fields.checked(df.where("x = 1"), ["x"], "v", 2).count() == 1 and fields.constant(5.0) == ([0.0, 10000.0], [5.0, 5.0])
    for bad, n in [(df, None), (df.where("x = 1").withColumn("v", F.array(F.lit(-1.0))), None), (df.where("x = 1"), 3), (df.where("x = 1").withColumn("v", F.lit(None).cast("array<double>")), None)]:
        with pytest.raises(Exception, match="no valid model"):
            fields.checked(bad, ["x"], "v", n).collect()


def test_refitting_stays_in_its_bounds(spark):
    rng = np.random.default_rng(6)
    rows, truth = [], {}
    for g in range(6):
        truth[g] = (10.0 + g, 300.0 + 5 * g, 1500.0 + 10 * g, 3000.0 + 10 * g)
        x = np.linspace(0, 900, 60)
        t = nearsurface.arrival_times(x, truth[g][0], np.array([truth[g][1]]), np.array(truth[g][2:])) + rng.normal(0, 0.5, 60)
        rows += [(g, float(a), float(b)) for a, b in zip(x, t)]
    picks = spark.createDataFrame(rows, "g int, off double, t double")
    params = spark.createDataFrame([(g, 100.0 * g, 0.0, *p) for g, p in truth.items()], "g int, x double, y double, t0 double, x1 double, v1 double, v2 double")
    out = velocity.refit(picks, params, "g", "off", "t", 2, 150.0).toPandas()
    smooth = velocity.search_bounds(velocity.smoothed_refractors(params, "g", 2, 150.0), ["g"], 2).toPandas().set_index("g")
    assert len(out) == 6 and (out.loss < 2.5).all()
    for r in out.itertuples():
        for c in ("t0", "x1", "v1", "v2"):
            assert smooth.loc[r.g, f"{c}_low"] - 1e-6 <= getattr(r, c) <= smooth.loc[r.g, f"{c}_high"] + 1e-6


def test_spectra_of_split_gathers(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(1, float(o), rng.normal(size=20).tolist()) for o in range(30)]
    df = spark.createDataFrame(rows, "g int, o double, d array<double>").repartition(3)
    get = lambda: [r.value for r in velocity.vertical_spectrum(df, ["g"], "d", "o", [1500.0, 2500.0], 2.0, 10).orderBy("v_ix", "t_ix").collect()]
    whole = get()
    monkeypatch.setattr(velocity, "PART_TRACES", 4)
    assert get() == pytest.approx(whole) and len(whole) == 40


def test_knots_of_velocity_ranges():
    assert velocity.velocity_range(([0, 1], [1000.0, 2000.0]), 0.1, 500.0) == pytest.approx([900, 1400, 1900, 2400])
