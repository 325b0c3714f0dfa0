"""Fits of near-surface models: t0, offsets at which layers change, and velocities that rise downwards.

All rules of a model are linear: none of its parameters is negative, layers have a least width and velocities a least rise, and each parameter may have
bounds. A fit goes down by steps that minimise a quadratic model of the loss within these rules: residuals are linear in a small step, and every loss is
bounded from above by weighted squares that touch it at the present residuals. An active set finds a step's minimum; a step that doesn't lower the loss is damped.
"""

from __future__ import annotations

import numpy as np

#: Rounds of a descent at most, the relative change of the loss that ends it, and the residual (ms) below which weights don't grow.
ROUNDS, TOLERANCE, SMALL = 100, 1e-7, 1e-4
#: Passes over all ways of a polish, and different t0 at which losses with many minima begin besides.
SWEEPS, T0_STARTS = 20, 9
#: Where layers change at the beginning of a descent, as powers of evenly spaced shares of the picks.
BENDS = (0.4, 1.0, 2.5)


def travelled(offsets: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The part of each offset that lies in each layer (picks by layers)."""
    edges = np.concatenate([[0.0], x])
    below = np.maximum(offsets[:, None] - edges, 0)
    widths = np.append(np.diff(edges), np.inf)
    return np.minimum(below, widths)


def arrival_times(offsets: np.ndarray, t0: float, x: np.ndarray, v: np.ndarray) -> np.ndarray:
    return t0 + travelled(offsets, x) @ (1000 / v)


def losses(residuals: np.ndarray, loss: str, huber: float) -> tuple[np.ndarray, np.ndarray]:
    """The loss of each residual, and the weight with which its square touches it there."""
    a = np.abs(residuals)
    small = np.maximum(a, SMALL)
    if loss == "MSE":
        return a * a, np.full(len(a), 2.0)
    if loss == "L1":
        return a, 1 / small
    if loss == "huber":
        return np.where(a <= huber, a * a / 2, huber * a - huber * huber / 2), np.where(a <= huber, 1.0, huber / small)
    if loss == "soft_L1":
        return 2 * (np.sqrt(1 + a) - 1), 1 / (np.sqrt(1 + a) * small)
    if loss == "cauchy":
        return np.log1p(a), 1 / ((1 + a) * small)
    raise ValueError(f"no such loss: {loss}")


def rising(values: np.ndarray, weights: np.ndarray, least: float) -> np.ndarray:
    """The nearest numbers, by weighted squares, each of which exceeds the one before by ``least`` at least: neighbours that don't are pooled."""
    slope = least * np.arange(len(values))
    pools: list[list[float]] = []  # mean, weight, count
    for value, weight in zip(values - slope, weights):
        pools.append([value, weight, 1])
        while len(pools) > 1 and pools[-2][0] > pools[-1][0]:
            b, a = pools.pop(), pools.pop()
            pools.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.concatenate([np.full(int(n), mean) for mean, _, n in pools]) + slope


def start_from(offsets: np.ndarray, times: np.ndarray, counts: np.ndarray, n: int, min_velocity_step: float, min_size: float, bend: float = 1.0, init: dict[str, float] | None = None) -> np.ndarray:
    """Parameters to begin at: t0, x1.., v1... What ``init`` has stays. Other layers change at shares of the picks between those that are given, t0 and the
    slownesses fit the picks by least squares, and all is moved as little as the rules ask for."""
    init = init or {}
    far = max(float(offsets.max(initial=0)), max((init.get(f"x{i}", 0.0) for i in range(1, n)), default=0.0) + n * min_size)
    edges, given = np.empty(n + 1), np.zeros(n + 1, bool)
    for i in range(n + 1):
        given[i] = i in (0, n) or f"x{i}" in init
        edges[i] = 0.0 if i == 0 else far if i == n else init.get(f"x{i}", np.nan)
    known = np.flatnonzero(given)
    ranked = np.sort(np.repeat(offsets, np.minimum(counts, 1000).astype(int))) if len(offsets) else np.zeros(1)
    for a, b in zip(known, known[1:]):
        own = ranked[(ranked >= edges[a]) & (ranked <= edges[b])]
        for i in range(a + 1, b):
            share = ((i - a) / (b - a)) ** bend
            edges[i] = np.quantile(own, share) if len(own) else edges[a] + (edges[b] - edges[a]) * share
    x = rising(edges, np.where(given, 1e9, 1.0), min_size)[1:-1]
    slow = np.array([1000 / init[f"v{i}"] if f"v{i}" in init else np.nan for i in range(1, n + 1)])
    basis = np.column_stack([np.ones(len(offsets)), travelled(offsets, x)])
    fixed = np.array([init.get("t0", np.nan), *slow])
    free = np.isnan(fixed)
    root = np.sqrt(counts)
    solved = np.linalg.lstsq(basis[:, free] * root[:, None], (times - basis[:, ~free] @ fixed[~free]) * root, rcond=None)[0] if free.any() and len(offsets) else np.zeros(int(free.sum()))
    fixed[free] = solved
    # a layer whose picks tell nothing goes on as the one above it, the first of all at a usual velocity
    reached = np.append(True, travelled(offsets, x).max(0, initial=0) > 0)
    v = []
    for i in range(n):
        sensible = reached[i + 1] and fixed[i + 1] > 1e-2
        v.append(1000 / fixed[i + 1] if sensible or not free[i + 1] else (v[-1] if v else 1600.0))
    v = rising(np.maximum(v, 1 + min_velocity_step * np.arange(n)), np.where(free[1:], 1.0, 1e9), min_velocity_step)
    return np.concatenate([[max(fixed[0], 0.0)], x, v])


def rules(n: int, min_velocity_step: float, min_size: float, far: float, bounds: list[tuple[float, float]] | None) -> tuple[np.ndarray, np.ndarray]:
    """a and b of the rules a @ parameters >= b."""
    rows, least = [], []

    def rule(least_, **at):
        row = np.zeros(2 * n)
        for name, sign in at.items():
            row[int(name[1:])] = sign
        rows.append(row)
        least.append(least_)

    rule(0.0, p0=1)
    for i in range(1, n):
        rule(min_size, **{f"p{i}": 1} | ({f"p{i - 1}": -1} if i > 1 else {}))
    if n > 1:
        rule(min_size - far, **{f"p{n - 1}": -1})
    rule(1.0, **{f"p{n}": 1})
    for i in range(n + 1, 2 * n):
        rule(min_velocity_step, **{f"p{i}": 1, f"p{i - 1}": -1})
    for i, (low, high) in enumerate(bounds or []):
        rule(low, **{f"p{i}": 1})
        rule(-high, **{f"p{i}": -1})
    return np.array(rows), np.array(least)


def least_within(h: np.ndarray, g: np.ndarray, a: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The d with the least d h d / 2 + g d for which a d >= -room, where room is not negative: a set of active rules, changed one at a time."""
    size, norms = max(np.trace(h), 1e-300), np.maximum(np.linalg.norm(a, axis=1), 1e-300)
    h, g, a, room = h / size, g / size, a / norms[:, None], room / norms
    d, active = np.zeros(len(g)), []
    for _ in range(3 * (len(room) + 2)):
        k = len(active)
        system = np.block([[h, -a[active].T], [a[active], np.zeros((k, k))]])
        solved = np.linalg.lstsq(system, np.concatenate([-(g + h @ d), np.zeros(k)]), rcond=None)[0]
        step, force = solved[: len(g)], solved[len(g) :]
        if np.abs(step).max() <= 1e-13 * (1 + np.abs(d).max()):
            if not k or force.min() >= -1e-12:
                break
            active.pop(int(np.argmin(force)))
            continue
        fall = -(a @ step)
        free = np.setdiff1d(np.flatnonzero(fall > 1e-14), active)
        reach = (room[free] + a[free] @ d) / fall[free]
        if len(free) and reach.min() < 1:
            d = d + max(reach.min(), 0.0) * step
            active.append(int(free[np.argmin(reach)]))
        else:
            d = d + step
    return d


def within_rules(p: np.ndarray, n: int, min_velocity_step: float, min_size: float, far: float, bounds: list[tuple[float, float]]) -> np.ndarray:
    """``p`` moved into its bounds and to rising steps, in turns, until it stays; bounds that leave no room for the steps win."""
    low, high = np.array(bounds).T
    for _ in range(500):
        q = np.clip(p, low, high)
        x = rising(np.concatenate([[0.0], q[1:n], [far]]), np.concatenate([[1e9], np.ones(n - 1), [1e9]]), min_size)[1:-1]
        moved = np.concatenate([q[:1], x, rising(q[n:], np.ones(n), min_velocity_step)])
        if np.abs(moved - p).max() <= 1e-12:
            break
        p = moved
    return np.clip(p, low, high)


def descend(p: np.ndarray, offsets: np.ndarray, times: np.ndarray, counts: np.ndarray, n: int, a: np.ndarray, b: np.ndarray, loss: str, huber: float) -> tuple[np.ndarray, float]:
    """A minimum of the mean loss within the rules, from ``p`` on; rules that ``p`` breaks are kept as far as they are."""
    b = np.minimum(b, a @ p)
    share = counts / counts.sum()
    scale = np.concatenate([[max(np.ptp(times), 1.0)], np.full(n - 1, max(offsets.max(), 1.0)), np.full(n, max(p[n:].max(), 1.0))])

    def at(p):
        far = travelled(offsets, p[1:n])
        residuals = p[0] + far @ (1000 / p[n:]) - times
        value, weight = losses(residuals, loss, huber)
        return far, residuals, float(value @ share), weight

    far, r, value, weight = at(p)
    damping = 1e-3
    for _ in range(ROUNDS):
        bends = (offsets[:, None] > p[1:n]) * (1000 / p[n:-1] - 1000 / p[n + 1 :]) if n > 1 else np.zeros((len(offsets), 0))
        slopes = np.column_stack([np.ones(len(offsets)), bends, -far * (1000 / p[n:] ** 2)]) * scale
        w = weight * share
        h, g = slopes.T @ (slopes * w[:, None]), slopes.T @ (w * r)
        done = True
        while damping < 1e9 and value > 1e-9:
            d = least_within(h + damping * np.diag(np.diag(h) + 1e-9 * np.trace(h) + 1e-300), g, a * scale, np.maximum(a @ p - b, 0.0)) * scale
            tried = at(p + d)
            if tried[2] < value * (1 - TOLERANCE) - 1e-300:
                p, (far, r, value, weight), damping, done = p + d, tried, max(damping / 10, 1e-12), False
                break
            damping *= 10
        if done:
            break
    return p, value


def polished(p: np.ndarray, value: float, offsets: np.ndarray, times: np.ndarray, counts: np.ndarray, n: int, a: np.ndarray, b: np.ndarray, loss: str, huber: float) -> tuple[np.ndarray, float]:
    """``p`` improved along single parameters and pairs of them, by steps from a tenth of a parameter down: a loss with kinks or several minima may stop a descent early."""
    share, eye = counts / counts.sum(), np.eye(2 * n)
    ways = np.array([eye[i] + sign * eye[j] * (i != j) for i in range(2 * n) for j in range(i, 2 * n) for sign in (1, -1)])
    ways = np.concatenate([ways, -ways]) * np.maximum(np.abs(p), 1.0)
    b, step = np.minimum(b, a @ p), 0.1
    for _ in range(SWEEPS):
        better = False
        for way in ways:
            q = p + step * way
            if (a @ q >= b - 1e-12).all():
                found = float(losses(q[0] + travelled(offsets, q[1:n]) @ (1000 / q[n:]) - times, loss, huber)[0] @ share)
                if found < value * (1 - 1e-6):
                    p, value, better = q, found, True
        step = step if better else step / 3
    return p, value


def fit_refractors(offsets: np.ndarray, times: np.ndarray, n: int, loss: str = "L1", huber: float = 20.0, min_velocity_step: float = 1.0, min_size: float = 1.0, init: dict[str, float] | None = None, bounds: dict[str, tuple[float, float]] | None = None, max_offset: float | None = None, counts: np.ndarray | None = None) -> dict[str, float]:
    """A model of ``n`` layers that fits first breaks with the least mean loss found.

    ``counts`` tells how many picks each pair of offset and time stands for. With ``init`` the descent begins there, with what is missing
    completed; else it begins several times, with layers at shares of the picks, and the best end counts. Picks beyond ``max_offset`` don't count.
    """
    counts = np.ones(len(offsets)) if counts is None else counts.astype(float)
    if max_offset is not None:
        near = offsets <= max_offset
        offsets, times, counts = offsets[near], times[near], counts[near]
    names = ["t0", *(f"x{i}" for i in range(1, n)), *(f"v{i}" for i in range(1, n + 1))]
    far = max(float(offsets.max(initial=0)), n * min_size, max(((init or {}).get(f"x{i}", 0.0) for i in range(1, n)), default=0.0) + min_size)
    a, b = rules(n, min_velocity_step, min_size, far, [bounds[c] for c in names] if bounds else None)
    best, begins = None, [(bend, init) for bend in (BENDS if init is None and n > 1 else (1.0,))]
    if loss in ("soft_L1", "cauchy") and "t0" not in (init or {}) and len(offsets):
        # these losses have many minima, most of them along t0
        low, high = bounds["t0"] if bounds else (0.0, max(2 * start_from(offsets, times, counts, n, min_velocity_step, min_size)[0], float(np.ptp(times)) / 10))
        begins += [(1.0, (init or {}) | {"t0": low + (high - low) * share}) for share in np.linspace(0.1, 0.9, T0_STARTS)]
    for bend, known in begins:
        p = start_from(offsets, times, counts, n, min_velocity_step, min_size, bend, known)
        if bounds:
            p = within_rules(p, n, min_velocity_step, min_size, far, [bounds[c] for c in names])
        if len(offsets):
            found = descend(p, offsets, times, counts, n, a, b, loss, huber)
            best = found if best is None or found[1] < best[1] else best
        else:
            best = best or (p, 0.0)
    if len(offsets):
        best = descend(polished(*best, offsets, times, counts, n, a, b, loss, huber)[0], offsets, times, counts, n, a, b, loss, huber)
    return dict(zip(names, (max(float(x), 0.0) for x in best[0])))


def complete_init(init: dict[str, float], offsets: np.ndarray, times: np.ndarray, n: int, min_velocity_step: float = 1.0, min_size: float = 1.0) -> dict[str, float]:
    """All parameters of a model of which ``init`` has some."""
    p = start_from(np.asarray(offsets, float), np.asarray(times, float), np.ones(len(offsets)), n, min_velocity_step, min_size, init=init)
    return dict(zip(["t0", *(f"x{i}" for i in range(1, n)), *(f"v{i}" for i in range(1, n + 1))], (float(x) for x in p)))
