import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from geostrata.functions.arrays import limits, piecewise, running_sums
from geostrata.operators import combine, fields, gathers, headers, maps, nearsurface, qc, signal, spatial, supergathers, velocity
from geostrata.sources import segy, synthetic, text
from geostrata.streaming import maps as streaming


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def array(*values):
    return F.array(*(F.lit(float(v)) for v in values))


def test_muting_times_through_knots(spark):
    rng = np.random.default_rng(8)
    xs, ys = np.sort(rng.choice(np.arange(40, 900), 5, False)).tolist(), rng.integers(5, 700, 5).tolist()
    at = [float(x) for x in (*rng.integers(-200, 1500, 30), *xs)]

    def plain(x):
        k = min(max(sum(x > v for v in xs) - 1, 0), len(xs) - 2)
        return ys[k] + (x - xs[k]) * (ys[k + 1] - ys[k]) / (xs[k + 1] - xs[k])

    df = spark.createDataFrame([(x,) for x in at], "x double")
    assert [r[0] for r in df.select(piecewise(F.col("x"), xs, ys)).collect()] == pytest.approx([plain(x) for x in at])


def test_picks_and_masks(spark):
    """Against plain loops, and back from a mask to the pick that it was made of."""
    rng = np.random.default_rng(9)
    n, interval, delay = 13, 1.5, 7.0
    picks = [float(delay + k * interval + shift) for k in rng.integers(0, n, 12) for shift in (0.0, 0.4, -0.4)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(picks)], "i int, t double")
    masks = [r.m for r in df.select("i", gathers.pick_to_mask(F.col("t"), n, interval, delay).alias("m")).orderBy("i").collect()]
    for t, mask in zip(picks, masks):
        first = round((t - delay) / interval)
        assert mask == [int(k >= first) for k in range(n)]
    back = [r.t for r in df.select("i", gathers.mask_to_pick(gathers.pick_to_mask(F.col("t"), n, interval, delay).cast("array<double>"), interval, delay).alias("t")).orderBy("i").collect()]
    assert back == pytest.approx([delay + interval * round((t - delay) / interval) for t in picks])
    scores = [[round(float(x), 2) for x in rng.random(11)] for _ in range(20)] + [[0.1] * 11]
    for row in scores:
        best = max(((b - a, -a) for a in range(11) for b in range(a + 1, 12) if min(row[a:b]) >= 0.6), default=(0, 0))
        assert one(spark, gathers.mask_to_pick(array(*row), interval, delay, 0.6)) == delay - best[1] * interval


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 100])
def test_running_sums(spark, n):
    x = np.random.default_rng(n).normal(size=n)
    assert one(spark, running_sums(array(*x).cast("array<double>"))) == pytest.approx([0, *np.cumsum(x)])


def test_limits_fail_when_nothing_is_left(spark):
    assert one(spark, limits(array(1, 2, 3, 4, 5), 1, -1, 2)) == [2, 4]
    with pytest.raises(Exception, match="no samples"):
        one(spark, limits(array(1, 2, 3), 3, 3))


def test_metrics_of_odd_traces(spark):
    nan = float("nan")
    assert one(spark, qc.dead(array(1, 1, 1))) == 1
    assert one(spark, qc.max_clips_len(array(2, 2, 2))) == 6
    assert one(spark, qc.max_clips_len(array(3, 3, 1, 0, 0, 0))) == 3
    assert one(spark, qc.max_const_len(array(1, 2, 3))) == 0
    assert one(spark, qc.max_const_len(array(1, 1, 3))) == 2
    assert math.isnan(one(spark, qc.autocorrelation(array(*[nan] * 40, 1))))
    assert one(spark, qc.spikes(array(nan, 0, 0, 3, 0))) == 2
    assert one(spark, qc.is_bad(F.lit(nan), True, 0.5)) is False
    with pytest.raises(ValueError):
        qc.is_bad(F.lit(1.0), True, None)


def test_agc_is_a_sliding_window(spark):
    x = np.random.default_rng(0).normal(size=20)
    for window in (5, 8, 20):
        half, end = window // 2, 20 - (window - window // 2)
        centre = [max(half, min(i, end)) for i in range(20)]
        wanted = [math.sqrt(window / (np.sum(x[c - half : c - half + window] ** 2) + 1e-15)) for c in centre]
        assert one(spark, gathers.agc_coefs(array(*x), 20, window)) == pytest.approx(wanted)


def nmo_by_hand(data, offsets, n, dt, v, grad, s):
    t = dt * np.arange(n)
    h = np.sqrt(t[:, None] ** 2 + (offsets[None] / v[:, None]) ** 2)
    zero = t[:, None] - offsets[None] ** 2 * grad[:, None] / v[:, None] ** 3
    bad = (zero <= 0) | (h > (1 + s) * zero)
    limit = np.array([offsets[b].min() if b.any() else np.inf for b in bad])
    limit = np.minimum.accumulate(limit[::-1])[::-1]
    out = np.full((len(offsets), n), np.nan)
    for i in range(n):
        for k, x in enumerate(offsets):
            at = h[i, k] / dt
            if at <= n - 1 and x < limit[i]:
                low = int(at)
                out[k, i] = data[k, low] * (1 - at + low) + data[k, min(low + 1, n - 1)] * (at - low)
    return out


def test_nmo_with_a_velocity_that_changes(spark):
    rng, n, dt = np.random.default_rng(1), 40, 4.0
    offsets = rng.permutation(np.arange(10) * 30.0)
    data = rng.normal(size=(10, n))
    knots = ([0.0, 80.0, 160.0], [1500.0, 1900.0, 2600.0])
    v = np.interp(dt * np.arange(n), *knots) / 1000
    wanted = nmo_by_hand(data, offsets, n, dt, v, np.gradient(v, dt), 0.65)
    df = spark.createDataFrame(pd.DataFrame({"g": 1, "k": range(10), "offset": offsets, "data": [r.tolist() for r in data]}))
    found = gathers.apply_nmo(df, "data", "offset", n, dt, knots, ["g"], 0.65).orderBy("k").toPandas()
    np.testing.assert_allclose(np.stack(found.corrected), wanted, rtol=1e-9)


def test_spectrum_finds_the_velocity(spark):
    df = synthetic.ricker_traces(spark.createDataFrame([(1, float(20 * i)) for i in range(30)], "g long, offset double"), 120, 2.0, (60.0, 160.0), (5.0, 5.0), (2.0, 2.0))
    grid = [1400.0, 1700.0, 2000.0, 2300.0, 2600.0]
    s = velocity.vertical_spectrum(df, ["g"], "data", "offset", grid, 2.0, 20)
    best = s.groupBy("v_ix").agg(F.sum("value").alias("v")).orderBy(F.desc("v")).first()
    assert grid[best.v_ix] == 2000
    picked = velocity.stacking_velocities(s, ["g"], grid, 2.0, times_step=40).first()
    assert np.interp(160, picked.times, picked.velocities) == pytest.approx(2000, abs=150)


def test_refractor_fit_recovers_a_model():
    x = np.arange(0, 1000, 10.0)
    t = nearsurface.arrival_times(x, 20.0, np.array([400.0]), np.array([1500.0, 3500.0]))
    p = nearsurface.fit_refractors(x, t, 2)
    assert (p["t0"], p["x1"], p["v1"], p["v2"]) == pytest.approx((20, 400, 1500, 3500), rel=0.05)


def test_filters_and_resampling(spark):
    t = np.arange(200) * 2.0
    x = np.sin(2 * np.pi * 20 * t / 1000) + np.sin(2 * np.pi * 180 * t / 1000)
    df = spark.createDataFrame([(x.tolist(),)], "data array<double>")
    low = np.array(signal.bandpass(df, "data", 2.0, high=60).first().filtered)
    np.testing.assert_allclose(low[60:140], np.sin(2 * np.pi * 20 * t / 1000)[60:140], atol=0.05)
    smooth = np.sin(2 * np.pi * 20 * t / 1000)
    df = spark.createDataFrame([(smooth.tolist(),)], "data array<double>")
    fine = np.array(signal.resample(df, "data", 200, 2.0, 0.5).first().resampled)
    np.testing.assert_allclose(fine[40:-40], np.sin(2 * np.pi * 20 * np.arange(len(fine)) * 0.5 / 1000)[40:-40], atol=1e-3)
    assert signal.grid_origins(10, 4, 3) == [0, 3, 6]


def test_nearest_by_grid_is_the_same(spark):
    rng = np.random.default_rng(2)
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    p = spark.createDataFrame(pd.DataFrame(rng.random((60, 2)) * 100, columns=["x", "y"]).assign(id=range(60)))
    near = lambda f: {(r.query_id, r.rank): r.point_id for r in f.collect()}
    assert near(spatial.nearest_pairs(p, p, 3, "id", "id")) == near(spatial._nearest_by_grid(p, p, 3, "id", "id", ("x", "y"), ("x", "y"), []))


def test_rbf_meets_its_points(spark):
    points = np.array([[0, 0], [1, 0], [0, 1], [1, 1.0]])
    df = spark.createDataFrame(pd.DataFrame(points, columns=["x", "y"]))
    assert [r.value for r in spatial.rbf(df, points, np.array([1, 2, 3, 4.0])).collect()] == pytest.approx([1, 2, 3, 4])


def test_idw_weights(spark):
    pairs = spark.createDataFrame([(1, 1, 0.0), (1, 2, 3.0), (2, 1, 1.0), (2, 2, 2.0), (2, 3, 1000.0)], "query_id long, point_id long, dist double")
    w = {(r.query_id, r.point_id): r.weight for r in spatial.idw_weights(pairs).collect()}
    assert w == pytest.approx({(1, 1): 1.0, (2, 1): 0.8, (2, 2): 0.2})


def test_merge_needs_unique_keys(spark):
    a = spark.createDataFrame([(1, 2), (1, 3)], "k long, v long")
    with pytest.raises(Exception, match="not unique"):
        combine.merge(a, a, ["k"]).collect()
    assert combine.merge(a, a, ["k"], validate_unique=False).count() == 4


def test_items_need_one_place(spark):
    a = spark.createDataFrame([(1, 2, 3.0), (1, 3, 3.0)], "k long, x long, v double")
    with pytest.raises(Exception, match="more than one place"):
        maps.item_map(a, "v", ["k"], ["x"]).collect()


def test_unknown_headers_fail(spark):
    with pytest.raises(KeyError):
        headers.select(spark.range(1), ["nothing"])


def test_field_models(spark):
    m = spark.createDataFrame([(1, [0.0], [5.0]), (2, [0.0, 10.0], [1.0, 3.0])], "id long, t array<double>, v array<double>")
    assert [r.y for r in m.select(fields.evaluate("t", "v", F.lit(20.0)).alias("y")).collect()] == [5, 5]


def test_synthetic_survey(spark):
    g = synthetic.geometry(spark)
    assert g.count() == 357
    assert g.select("FieldRecord").distinct().count() == 12
    assert g.where("abs(SourceX - GroupX) > 200 or abs(SourceY - GroupY) > 200").isEmpty()
    assert supergathers.generate(g, ("INLINE_3D", "CROSSLINE_3D"), (3, 3), (2, 2)).where("abs(INLINE_3D - center_INLINE_3D) > 1").isEmpty()


@pytest.mark.parametrize("fmt", [1, 5])
def test_segy_round_trip(spark, tmp_path, fmt):
    segy.register(spark)
    df = synthetic.noise_traces(synthetic.geometry(spark), 25).coalesce(2)
    df.write.format("segy").mode("append").option("sample_format", fmt).option("sample_interval", 2.0).save(str(tmp_path / "a"))
    back = spark.read.format("segy").option("chunk_size", 50).load(str(tmp_path / "a/*.sgy"))
    key = ["FieldRecord", "TraceNumber"]
    a, b = (x.select(*key, "offset", "CDP_X", "data").orderBy(*key).toPandas() for x in (df, back))
    pd.testing.assert_frame_equal(a.drop(columns="data").astype(int), b.drop(columns="data").astype(int))
    np.testing.assert_allclose(np.stack(a.data), np.stack(b.data), rtol=1e-5)
    assert set(spark.read.format("segy").option("headers", "offset").option("data", "false").load(str(tmp_path / "a/*.sgy")).columns) == {"file", "TRACE_SEQUENCE_FILE", "offset"}
    segy.aggregate(spark, str(tmp_path / "a/*.sgy"), str(tmp_path / "b"))
    assert spark.read.format("segy").load(str(tmp_path / "b/*.sgy")).agg(F.max("TRACE_SEQUENCE_FILE")).first()[0] == 357


def test_ibm_floats():
    x = np.array([0, 1, -1, 0.1, 1e8, -118.625, 3e-20], np.float32)
    np.testing.assert_allclose(segy.ibm_to_ieee(segy.ieee_to_ibm(x)), x, rtol=1e-6)


@pytest.mark.parametrize("fmt", ["fwf", "csv"])
@pytest.mark.parametrize("decimal", [".", ","])
def test_tables_of_headers(spark, tmp_path, fmt, decimal):
    df = spark.createDataFrame([(i, i / 7 - 3, -1000.0 * i) for i in range(20)], "a long, b double, c double").coalesce(1)
    path = str(tmp_path / "t")
    if (fmt, decimal) == ("csv", ","):
        with pytest.raises(ValueError):
            text.write_table(df, path, fmt, decimal=decimal)
        return
    text.write_table(df, path, fmt, decimal=decimal, precision=3, header=fmt == "fwf")
    back = text.read_table(spark, path, ["a", "c"], [0, -1], fmt, skiprows=int(fmt == "fwf"), decimal=decimal).orderBy("a").toPandas()
    np.testing.assert_allclose(back.c, [-1000.0 * i for i in range(20)], atol=1e-3)


def test_velocity_functions_in_text(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, [0.0, 100.0, 200.0, 300.0, 400.0], [1500.0, 1600.0, 1700.0, 1800.0, 1900.0]), (3, 4, [0.0], [1500.0])], "INLINE_3D long, CROSSLINE_3D long, x array<double>, y array<double>")
    text.write_vfuncs(df, str(tmp_path / "v"))
    assert sorted(text.read_vfuncs(spark, str(tmp_path / "v")).collect()) == sorted(df.collect())


def test_near_surface_tables(spark, tmp_path):
    df = spark.createDataFrame([("SourceX", "SourceY", 1.0, 2.0, True, 10.0, 300.0, 1500.0, 3000.0)], "name_x string, name_y string, x double, y double, is_uphole_corrected boolean, t0 double, x1 double, v1 double, v2 double")
    text.write_refractors(df, str(tmp_path / "r"))
    assert text.read_refractors(spark, str(tmp_path / "r"), 2).collect() == df.collect()


def test_streamed_map_is_the_batch_map(spark, tmp_path):
    df = spark.createDataFrame([(i % 3, float(i)) for i in range(30)], "k long, v double")
    for i in range(3):
        df.where(f"v >= {10 * i} and v < {10 * i + 10}").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streaming.append_to_map(stream, str(tmp_path / "map"), str(tmp_path / "state"), ["k"], "v").awaitTermination()
    found = streaming.read_map(spark, str(tmp_path / "map"), ["k"], "v").orderBy("k").collect()
    assert [tuple(r) for r in found] == [(0, 10, 27.0), (1, 10, 28.0), (2, 10, 29.0)]
