"""Models per gather against the same models one by one, and quantiles by ranks against sorted samples."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from geostrata.operators import gathers, moveout, quantiles, velocity


@pytest.fixture(scope="module")
def traces(spark):
    rng = np.random.default_rng(4)
    rows = [(i, i % 3, float(rng.integers(0, 400)) * (-1 if i % 7 == 0 else 1), [float(x) for x in rng.normal(size=40)]) for i in range(60)]
    return spark.createDataFrame(rows, "id int, gather int, offset double, data array<double>")


def by_id(df, col):
    return {r["id"]: np.array(r[col], float) for r in df.select("id", col).collect()}


def test_each_gather_is_corrected_by_its_own_velocity(spark, traces):
    functions = {0: ([0.0, 78.0], [1500.0, 2500.0]), 1: ([0.0], [2000.0]), 2: ([10.0, 30.0, 60.0], [1600.0, 2600.0, 2700.0])}
    models = spark.createDataFrame([(g, *f) for g, f in functions.items()], "gather int, t array<double>, v array<double>")
    for stretch in (0.65, float("inf")):
        found = by_id(moveout.nmo_by_model(traces, models, ["gather"], "data", "offset", 40, 2.0, max_stretch_factor=stretch), "corrected")
        assert len(found) == 60
        for g, f in functions.items():
            alone = by_id(gathers.apply_nmo(traces.where(F.col("gather") == g), "data", "offset", 40, 2.0, f, ["gather"], stretch), "corrected")
            assert all(np.allclose(found[i], x, equal_nan=True, atol=1e-9) for i, x in alone.items())


def test_each_gather_is_shifted_by_its_own_surface_model(spark, traces):
    models = {0: (5.0, 100.0, 1500.0, 3000.0), 1: (0.0, 50.0, 1000.0, 1100.0), 2: (20.0, 200.0, 2000.0, 2500.0)}
    field = spark.createDataFrame([(g, *m, g != 1) for g, m in models.items()], "gather int, t0 double, x1 double, v1 double, v2 double, is_uphole_corrected boolean")
    df = traces.withColumns({"offset": F.abs("offset"), "up": F.col("id").cast("double"), "pick": F.lit(7.0)})
    out = moveout.lmo_by_model(df, field, ["gather"], "data", "offset", 2, 2.0, 50.0, uphole_col="up", event_cols=["pick"])
    found, picks = by_id(out, "corrected"), {r.id: r.pick for r in out.collect()}
    for g, m in models.items():
        alone = gathers.apply_lmo(df.where(F.col("gather") == g), "data", "offset", dict(zip(("t0", "x1", "v1", "v2"), m)), 2.0, 50.0, uphole_col="up" if g != 1 else None, event_cols=["pick"])
        assert all(np.array_equal(found[i], x, equal_nan=True) for i, x in by_id(alone, "corrected").items())
        assert all(abs(picks[r.id] - r.pick) < 1e-9 for r in alone.collect())


def test_residual_spectra_in_parts_and_around_one_velocity(spark, traces, monkeypatch):
    models = spark.createDataFrame([(g, [0.0, 78.0], [1500.0 + 100 * g, 2000.0 + 300 * g]) for g in range(3)], "gather int, t array<double>, v array<double>")
    spectrum = lambda: {(r.gather, r.t_ix, r.m_ix): r.value for r in moveout.residual_spectra(traces, models, ["gather"], "data", "offset", 2.0, 40, velocity_step=100, window_ms=12).collect()}
    whole = spectrum()
    monkeypatch.setattr(moveout, "PART_TRACES", 4)
    assert whole.keys() == spectrum().keys() and all(abs(v - whole[k]) < 1e-9 for k, v in spectrum().items())
    # a constant velocity of a middle margin that a trial velocity hits has the vertical spectrum's values
    one = spark.createDataFrame([(0, [0.0], [2000.0])], "gather int, t array<double>, v array<double>")
    of = {(r.t_ix, round(r.margin, 6)): r.value for r in moveout.residual_spectra(traces, one, ["gather"], "data", "offset", 2.0, 40, velocity_step=100, window_ms=12).collect()}
    assert {m for _, m in of} == {round(x, 6) for x in np.linspace(-0.2, 0.2, 8)}
    vertical = velocity.vertical_spectrum(traces.where("gather = 0").withColumn("offset", F.abs("offset")), ["gather"], "data", "offset", [1600.0, 2400.0], 2.0, 12)
    for r in vertical.collect():
        assert abs(of[r.t_ix, -0.2 if r.v_ix == 0 else 0.2] - r.value) < 1e-9


@pytest.mark.parametrize("leaf", [3, 50, 1 << 16])
def test_quantiles_by_ranks(spark, leaf, monkeypatch):
    monkeypatch.setattr(quantiles, "BINS", 7)
    rng = np.random.default_rng(leaf)
    samples = {"normal": rng.normal(size=400), "ties": rng.integers(0, 3, 300).astype(float), "tail": np.append(10.0 ** rng.uniform(-300, 300, 200), [0.0, -1e308]), "one": np.array([5.0]), "ends": np.array([-np.inf, 1.0, 2.0, np.inf, np.inf]), None: rng.exponential(size=100)}
    rows = [(g, [float(x) for x in part] + [float("nan")]) for g, v in samples.items() for part in np.array_split(v, 7)] + [("none", [float("nan")]), ("none", [])]
    df = spark.createDataFrame(rows, "g string, data array<double>").repartition(5)
    q = [0.0, 0.1, 0.5, 0.987, 1.0]
    found = {r.g: r[1:] for r in quantiles.exact_quantiles(df, "data", q, ["g"], leaf=leaf).collect()}
    assert found.keys() == samples.keys()
    for g, v in samples.items():
        v = np.sort(v)
        for p, x in zip(q, found[g]):
            at = (len(v) - 1) * p
            low, high = v[int(at)], v[min(int(at) + 1, len(v) - 1)]
            wanted = low if low == high else low + (high - low) * (at - int(at))
            assert x == wanted or np.isclose(x, wanted, rtol=1e-12) or (np.isnan(wanted) and np.isnan(x))
    whole = quantiles.exact_quantiles(df.where("g = 'normal'"), "data", q, leaf=leaf).first()
    assert np.allclose(list(whole), np.quantile(samples["normal"], q))
    assert quantiles.exact_quantiles(df.where("false"), "data", q).count() == 0
