"""Fits of near-surface models against fine searches, and their rules."""

import itertools

import numpy as np
import pytest

from geostrata.operators import nearsurface, velocity

LOSSES = ["MSE", "L1", "huber", "soft_L1", "cauchy"]


def noisy(seed, n=120, t0=20.0, x1=400.0, v=(1500.0, 3500.0)):
    rng = np.random.default_rng(seed)
    x = np.sort(rng.uniform(0, 1000, n))
    t = nearsurface.arrival_times(x, t0, np.array([x1]), np.array(v)) + rng.normal(0, 3, n)
    t[rng.choice(n, 8, False)] += rng.uniform(40, 120, 8)
    return x, t


def mean_loss(p, x, t, loss):
    r = nearsurface.arrival_times(x, p[0], np.array([p[1]]), np.array(p[2:])) - t
    return nearsurface.losses(r, loss, 20.0)[0].mean()


@pytest.mark.parametrize("loss", LOSSES)
@pytest.mark.parametrize("tight", [False, True])
def test_fits_reach_the_optimum_of_a_search(loss, tight):
    """A grid around the found model, refined three times around its own best, finds nothing better by more than a thousandth."""
    x, t = noisy(3)
    bounds = {"t0": (0.0, 15.0), "x1": (200.0, 380.0), "v1": (1000.0, 2000.0), "v2": (2000.0, 3300.0)} if tight else None
    rise = 1900.0 if tight else 1.0
    p = nearsurface.fit_refractors(x, t, 2, loss, min_velocity_step=rise, bounds=bounds)
    velocity.check_params(p, max_offset=1000, min_velocity_step=rise, min_size=1.0)
    found = mean_loss(list(p.values()), x, t, loss)
    center, width = np.array(list(p.values()) if not tight else [7.5, 290, 1300, 3000]), np.array([15.0, 120.0, 300.0, 600.0])
    best = np.inf
    for _ in range(4):
        axes = [c + w * np.linspace(-1, 1, 9) for c, w in zip(center, width)]
        for q in itertools.product(*axes):
            if min(q) < 0 or q[3] - q[2] < rise or not 1 <= q[1] <= 999 or (bounds and any(not a <= v <= b for v, (a, b) in zip(q, bounds.values()))):
                continue
            value = mean_loss(q, x, t, loss)
            if value < best:
                best, center = value, np.array(q)
        width = width / 4
    assert found <= best * 1.001


def test_steps_within_rules_are_those_of_all_active_sets():
    rng = np.random.default_rng(2)
    for _ in range(60):
        m = rng.normal(size=(3, 3))
        h, g, a, room = m @ m.T + 0.1 * np.eye(3), rng.normal(size=3) * 3, rng.normal(size=(5, 3)), rng.uniform(0, 1, 5) * (rng.uniform(size=5) > 0.2)
        d = nearsurface.least_within(h, g, a, room)
        assert (a @ d >= -room - 1e-9).all()
        best = np.inf
        for k in range(4):
            for active in itertools.combinations(range(5), k):
                b = a[list(active)]
                full = np.block([[h, -b.T], [b, np.zeros((k, k))]])
                s = np.linalg.lstsq(full, np.concatenate([-g, -room[list(active)]]), rcond=None)[0][:3]
                if (a @ s >= -room - 1e-9).all():
                    best = min(best, s @ h @ s / 2 + g @ s)
        assert d @ h @ d / 2 + g @ d <= best + 1e-7


def test_three_layers_and_counted_picks():
    x = np.linspace(0, 2000, 160)
    t = nearsurface.arrival_times(x, 10.0, np.array([300.0, 900.0]), np.array([800.0, 1800.0, 4000.0]))
    p = nearsurface.fit_refractors(x, t, 3, "MSE")
    assert list(p.values()) == pytest.approx([10, 300, 900, 800, 1800, 4000], rel=0.02)
    x, t = noisy(5)
    n = np.random.default_rng(0).integers(1, 4, len(x))
    assert nearsurface.fit_refractors(x, t, 2, counts=n) == pytest.approx(nearsurface.fit_refractors(np.repeat(x, n), np.repeat(t, n), 2), rel=1e-3)


def test_poor_picks_still_give_models():
    for x, t in (([], []), ([5.0], [3.0]), ([5.0] * 4, [3.0, 4, 5, 6]), ([0.0, 100.0], [50.0, 10.0]), (list(range(50)), [0.0] * 50)):
        for n in (1, 2, 4):
            p = nearsurface.fit_refractors(np.array(x, float), np.array(t, float), n)
            assert velocity.check_params(p) == p
            assert velocity.check_params(nearsurface.complete_init({}, np.array(x, float), np.array(t, float), n, 5.0, 2.0), min_velocity_step=5.0, min_size=2.0)


def test_rising_numbers_are_the_nearest():
    rng = np.random.default_rng(1)
    for _ in range(50):
        values, weights = rng.normal(size=4) * 3, rng.uniform(0.1, 5, 4)
        out = nearsurface.rising(values, weights, 0.5)
        assert (np.diff(out) >= 0.5 - 1e-9).all()
        cost = (weights * (out - values) ** 2).sum()
        assert all(cost <= (weights * (np.cumsum(np.append(out[0] + a, 0.5 + np.abs(np.diff(out) - 0.5 + b))) - values) ** 2).sum() + 1e-9 for a, b in zip(rng.normal(size=40) * 0.3, rng.normal(size=(40, 3)) * 0.3))


@pytest.mark.parametrize("loss", ["L1", "MSE", "huber"])
def test_fits_made_of_sums_are_those_of_one_task(spark, monkeypatch, loss):
    rows, n = [], 2
    for g in range(3):
        x, t = noisy(g, 200, 10.0 + 5 * g, 300.0 + 50 * g, (1500.0 + 100 * g, 3500.0))
        rows += [(g, float(a), float(b)) for a, b in zip(x, t)]
    df = spark.createDataFrame(rows, "g int, off double, t double").repartition(3)
    whole = {r.g: r for r in velocity.refractor_velocities(df, ["g"], "off", "t", n, loss).collect()}
    monkeypatch.setattr(velocity, "MOST_PICKS", 100)
    sums = {r.g: r for r in velocity.refractor_velocities(df, ["g"], "off", "t", n, loss).collect()}
    assert whole.keys() == sums.keys() == {0, 1, 2}
    for g in whole:
        velocity.check_params({c: sums[g][c] for c in velocity.param_names(n)}, min_velocity_step=1.0, min_size=1.0)
        assert sums[g].loss <= whole[g].loss * 1.01
