"""Triangulations of an interpolator's knots, places located in them, and smooth surfaces over them.

Knots are few next to the places asked for (spatial.BROADCAST_POINTS bounds them): the driver triangulates them once, and every task gets the
triangles with their neighbours and walks through them with a batch of places at a time.
"""

from __future__ import annotations

import numpy as np

#: Knots are put on a grid of so many steps, on which all tests of the construction are exact.
STEPS = 1 << 52
#: Relative change of gradients below which their iteration ends, and its rounds at most; each halves the error at least.
GRADIENT_TOLERANCE, GRADIENT_ROUNDS = 1e-9, 200


def along_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """An order of places in which neighbours follow one another: by their interleaved bits."""
    key = np.zeros(len(x), np.int64)
    for bit in range(20):
        key |= (((x >> (32 + bit)) & 1) << (2 * bit)) | (((y >> (32 + bit)) & 1) << (2 * bit + 1))
    return np.argsort(key, kind="stable")


def delaunay(xy: np.ndarray, low: np.ndarray | None = None, size: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Triangles (corners counter-clockwise) whose circles hold no other knot, and each corner's opposite neighbour, -1 at the hull.

    Knots are added one by one. Those triangles whose circle holds the new knot make a hole, which is filled with triangles from its border to the
    knot. Triangles with the corner -1 stand for the outside of a hull's edge. Equal knots count once, knots of one line have no triangles. Of knots on one
    circle the lowest counts as a trace outside of it, so the triangles are the same in any order and in any part of the knots. ``low`` and ``size`` are
    those of a whole of which ``xy`` is a part.
    """
    xy = np.asarray(xy, float).reshape(-1, 2)
    if len(xy) < 3:
        return np.zeros((0, 3), np.int64), np.zeros((0, 3), np.int64)
    low, size = (xy.min(0) if low is None else low), (np.ptp(xy, axis=0).max() if size is None else size)
    steps = np.rint((xy - low) / max(size, 1e-300) * STEPS).astype(np.int64)
    _, first = np.unique(steps, axis=0, return_index=True)
    first = np.sort(first)
    # by chance in rounds that double, each along the curve: however knots lie, a new one changes few triangles
    rounds = np.floor(np.log2(np.random.default_rng(0).permutation(len(first)) + 1))
    along = along_curve(steps[first, 0], steps[first, 1])
    order = first[along[np.argsort(rounds[along], kind="stable")]].tolist()
    px, py = steps[:, 0].tolist(), steps[:, 1].tolist()  # integers of Python: no product overflows

    def turn(a, b, c):
        return (px[b] - px[a]) * (py[c] - py[a]) - (py[b] - py[a]) * (px[c] - px[a])

    third = next((i for i in range(2, len(order)) if turn(order[0], order[1], order[i])), None)
    if third is None:
        return np.zeros((0, 3), np.int64), np.zeros((0, 3), np.int64)
    a, b, c = order[0], order[1], order.pop(third)
    if turn(a, b, c) < 0:
        a, b = b, a
    corners, beside, free = [[a, b, c], [c, b, -1], [a, c, -1], [b, a, -1]], [[1, 2, 3], [3, 2, 0], [1, 3, 0], [2, 1, 0]], []

    def holds(t, p):
        a, b, c = corners[t]
        if c < 0:
            side = turn(a, b, p)
            return side > 0 or (side == 0 and (px[a] - px[p]) * (px[b] - px[p]) + (py[a] - py[p]) * (py[b] - py[p]) < 0)
        ax, ay, bx, by, cx, cy = px[a] - px[p], py[a] - py[p], px[b] - px[p], py[b] - py[p], px[c] - px[p], py[c] - py[p]
        found = (ax * ax + ay * ay) * (bx * cy - by * cx) - (bx * bx + by * by) * (ax * cy - ay * cx) + (cx * cx + cy * cy) * (ax * by - ay * bx)
        if found:
            return found > 0
        lowest = min((a, b, c, p), key=lambda i: (px[i], py[i]))
        return lowest != p and turn(*((b, c) if lowest == a else (c, a) if lowest == b else (a, b)), p) > 0

    at = 0
    for p in order[2:]:
        while corners[at][2] >= 0:  # towards p, until p is inside or an edge of the hull is crossed
            a, b, c = corners[at]
            crossed = 0 if turn(b, c, p) < 0 else 1 if turn(c, a, p) < 0 else 2 if turn(a, b, p) < 0 else None
            if crossed is None:
                break
            at = beside[at][crossed]
        hole, todo, border = {at}, [at], []
        while todo:
            t = todo.pop()
            for i in range(3):
                n = beside[t][i]
                if n in hole:
                    continue
                if holds(n, p):
                    hole.add(n)
                    todo.append(n)
                else:
                    border.append((corners[t][(i + 1) % 3], corners[t][(i + 2) % 3], n, t))
        border = [e for e in border if e[2] not in hole]
        free += hole
        made, ending = {}, {}
        for u, v, outer, old in border:
            t = free.pop() if free else len(corners)
            if t == len(corners):
                corners.append(None)
                beside.append(None)
            made[u], ending[v] = t, t
        for u, v, outer, old in border:
            t = made[u]
            own, near = [u, v, p], [made[v], ending[u], outer]
            turns = 1 if u < 0 else 2 if v < 0 else 0  # the corner -1 comes last
            border_of = beside[outer]
            # the outer triangle may border the hole with several edges: find this one by its ends
            for i in range(3):
                if corners[outer][(i + 1) % 3] == v and corners[outer][(i + 2) % 3] == u:
                    border_of[i] = t
            corners[t], beside[t] = own[turns:] + own[:turns], near[turns:] + near[:turns]
            if -1 not in own:
                at = t
        if corners[at] is None or corners[at][2] < 0:
            at = next(t for t in made.values())
            at = at if corners[at][2] >= 0 else beside[at][2]
    gone = set(free)
    kept = [t for t in range(len(corners)) if t not in gone and corners[t][2] >= 0]
    number = {t: i for i, t in enumerate(kept)}
    return np.array([corners[t] for t in kept], np.int64).reshape(-1, 3), np.array([[number.get(n, -1) for n in beside[t]] for t in kept], np.int64).reshape(-1, 3)


class Located:
    """Triangles made ready for locating batches of places in them."""

    def __init__(self, xy: np.ndarray, triangles: np.ndarray, beside: np.ndarray):
        self.xy, self.triangles, self.beside = np.asarray(xy, float), triangles, beside
        self.shift, self.scale = (self.xy.mean(0), max(np.ptp(self.xy, axis=0).max(), 1e-300)) if len(self.xy) else (np.zeros(2), 1.0)
        self.z = (self.xy - self.shift) / self.scale
        self.cells = max(int(np.sqrt(len(triangles) / 2)), 1)
        centers = self.z[triangles].mean(1) if len(triangles) else np.zeros((0, 2))
        self.low = self.z.min(0) if len(self.z) else np.zeros(2)
        self.start = np.zeros(self.cells * self.cells, np.int64)
        at = self._cell(centers)
        self.start[at] = np.arange(len(triangles))
        known = np.zeros(len(self.start), bool)
        known[at] = True
        # a cell without a triangle's centre begins where the last one before it does
        self.start = self.start[np.maximum.accumulate(np.where(known, np.arange(len(known)), 0))]

    def _cell(self, z: np.ndarray) -> np.ndarray:
        place = np.clip(np.nan_to_num((z - self.low) * self.cells), 0, self.cells - 1).astype(np.int64)
        return place[:, 1] * self.cells + place[:, 0]

    def weights(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The triangle of every place, -1 outside, and the weights of its corners, which sum to 1."""
        q = (np.asarray(places, float).reshape(-1, 2) - self.shift) / self.scale
        found, weights = np.full(len(q), -1), np.zeros((len(q), 3))
        if not len(self.triangles):
            return found, weights
        live, at = np.flatnonzero(np.isfinite(q).all(1)), None
        at = self.start[self._cell(q[live])]
        for _ in range(len(self.triangles) + 1):
            if not len(live):
                break
            p = self.z[self.triangles[at]] - q[live, None]
            # twice the signed areas that the place makes with the edges opposite to the corners
            areas = np.stack([p[:, (i + 1) % 3, 0] * p[:, (i + 2) % 3, 1] - p[:, (i + 1) % 3, 1] * p[:, (i + 2) % 3, 0] for i in range(3)], 1)
            worst = areas.argmin(1)
            inside = areas[np.arange(len(at)), worst] >= -1e-14
            found[live[inside]] = at[inside]
            w = np.maximum(areas[inside], 0)
            weights[live[inside]] = w / w.sum(1, keepdims=True)
            at = self.beside[at, worst]
            on = ~inside & (at >= 0)  # beyond an edge of the hull there is nothing
            live, at = live[on], at[on]
        return found, weights


def gradients(xy: np.ndarray, triangles: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The gradient at each knot for which the cubics along all edges, with these slopes at their ends, bend least in total.

    With the slopes s and t of an edge's cubic and d the difference of its ends, an edge's energy is 4 (s s + s t + t t - 3 d (s + t) + 3 d d) over its
    length cubed. At the least, every knot's gradient solves a system of two equations that holds its neighbours' gradients at half the
    weight of its own, so solving all knots at once, again and again, halves the error each time.
    """
    edges = np.unique(np.sort(np.concatenate([triangles[:, [0, 1]], triangles[:, [1, 2]], triangles[:, [2, 0]]]), axis=1), axis=0)
    a, b = np.concatenate([edges, edges[:, ::-1]]).T
    e = xy[b] - xy[a]
    weight = 1 / np.maximum(np.hypot(*e.T), 1e-300) ** 3
    n, used = len(xy), np.unique(triangles)
    total = lambda v: np.bincount(a, v, n)
    xx, xy_, yy = (total(2 * weight * e[:, i] * e[:, j]) for i, j in ((0, 0), (0, 1), (1, 1)))
    det = np.where(np.isin(np.arange(n), used), xx * yy - xy_ * xy_, 1.0)
    rise, g = 3 * (values[b] - values[a]), np.zeros((n, 2))
    for _ in range(GRADIENT_ROUNDS):
        part = weight * (rise - (e * g[b]).sum(1))
        r0, r1 = total(part * e[:, 0]), total(part * e[:, 1])
        new = np.stack([(yy * r0 - xy_ * r1) / det, (xx * r1 - xy_ * r0) / det], 1)
        change, g = np.abs(new - g).max(), new
        if change <= GRADIENT_TOLERANCE * max(np.abs(g).max(), 1e-300):
            break
    return g


def clough_tocher(corners: np.ndarray, values: np.ndarray, slopes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Values of cubic patches at places with ``weights`` in triangles: corners (n, 3, 2), values (n, 3) and gradients (n, 3, 2).

    A triangle is split at its centre in three. Neighbouring triangles share values and gradients along an edge, since the slope across it is
    linear between its ends; so the surface has no creases, and a quadratic function with its own gradients is met exactly.
    """
    center = corners.mean(1)
    ordinate = {}
    for i in range(3):
        ordinate[i, i, i] = values[:, i]
        ordinate[i, i, 3] = values[:, i] + (slopes[:, i] * (center - corners[:, i])).sum(1) / 3
        for j in range(3):
            if j != i:
                ordinate[i, i, j] = values[:, i] + (slopes[:, i] * (corners[:, j] - corners[:, i])).sum(1) / 3
    for i, j in ((0, 1), (1, 2), (0, 2)):
        edge = corners[:, j] - corners[:, i]
        foot = ((center - corners[:, i]) * edge).sum(1) / np.maximum((edge * edge).sum(1), 1e-300)  # of the centre on the edge
        across = lambda k, m: -(1 - foot) * k - foot * m  # noqa: B023, E731
        ends = across(ordinate[i, i, i], ordinate[i, i, j]) + ordinate[i, i, 3], across(ordinate[j, j, i], ordinate[j, j, j]) + ordinate[j, j, 3]
        ordinate[i, j, 3] = sum(ends) / 2 - across(ordinate[i, i, j], ordinate[j, j, i])
    for i, j, k in ((0, 1, 2), (1, 0, 2), (2, 0, 1)):
        ordinate[i, 3, 3] = (ordinate[i, i, 3] + ordinate[min(i, j), max(i, j), 3] + ordinate[min(i, k), max(i, k), 3]) / 3
    top = (ordinate[0, 3, 3] + ordinate[1, 3, 3] + ordinate[2, 3, 3]) / 3
    least, out = weights.argmin(1), np.zeros(len(weights))
    for k in range(3):
        i, j = (x for x in range(3) if x != k)
        at = least == k
        a, b, c = weights[at, i] - weights[at, k], weights[at, j] - weights[at, k], 3 * weights[at, k]
        o = lambda *key: ordinate[key][at]  # noqa: B023, E731
        out[at] = (
            a**3 * o(i, i, i) + b**3 * o(j, j, j) + c**3 * top[at] + 3 * (a * a * b * o(i, i, j) + a * b * b * o(j, j, i) + a * a * c * o(i, i, 3) + b * b * c * o(j, j, 3))
            + 3 * c * c * (a * o(i, 3, 3) + b * o(j, 3, 3)) + 6 * a * b * c * o(i, j, 3)
        )
    return out


class Cells:
    """Knots sorted into square cells, so that a place meets those around it only."""

    def __init__(self, xy: np.ndarray):
        self.xy = np.asarray(xy, float).reshape(-1, 2)
        self.n = max(int(np.sqrt(len(self.xy) / 2)), 1)
        self.low = self.xy.min(0) if len(self.xy) else np.zeros(2)
        self.width = max(np.ptp(self.xy, axis=0).max() / self.n, 1e-12) if len(self.xy) else 1.0
        cell = np.clip(((self.xy - self.low) / self.width).astype(np.int64), 0, self.n - 1)
        key = cell[:, 1] * self.n + cell[:, 0]
        self.order = np.argsort(key, kind="stable")
        self.first = np.searchsorted(key[self.order], np.arange(self.n * self.n + 1))

    def nearest(self, places: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of each place's k nearest knots (all, if there are fewer) and their distances; ties go to the lower number."""
        q, k = np.asarray(places, float).reshape(-1, 2), min(k, len(self.xy))
        found, far = np.zeros((len(q), k), np.int64), np.zeros((len(q), k))
        if not k:
            return found, far
        place = (q - self.low) / self.width
        live, reach = np.arange(len(q)), 1
        while len(live):
            cell = np.floor(np.clip(place[live], -(2.0**40), 2.0**40)).astype(np.int64)
            top, bottom = np.clip(cell[:, 1] - reach, 0, self.n), np.clip(cell[:, 1] + reach + 1, 0, self.n)
            left, right = np.clip(cell[:, 0] - reach, 0, self.n), np.clip(cell[:, 0] + reach + 1, 0, self.n)
            rows = np.maximum(bottom - top, 0) * (right > left)
            of = np.repeat(np.arange(len(live)), rows)
            row = np.repeat(top - (np.cumsum(rows) - rows), rows) + np.arange(int(rows.sum()))
            begin, end = self.first[row * self.n + left[of]], self.first[row * self.n + right[of]]
            size = end - begin
            knots = self.order[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
            of = np.repeat(of, size)
            d = q[live[of]] - self.xy[knots]
            dist = np.sqrt(d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1])
            by = np.lexsort((knots, dist, of))
            counts = np.bincount(of, minlength=len(live))
            starts = np.cumsum(counts) - counts
            enough = np.flatnonzero(counts >= k)
            take = by[starts[enough][:, None] + np.arange(k)]
            # nothing outside the block of cells is nearer than its border, and around the whole grid there is nothing
            inner = np.minimum(place[live] - cell + reach, cell + reach + 1 - place[live]).min(1) * self.width
            all_ = (cell - reach <= 0).all(1) & (cell + reach >= self.n - 1).all(1)
            sure = (dist[take[:, -1]] <= inner[enough] * (1 - 1e-12)) | all_[enough]
            done = live[enough[sure]]
            found[done], far[done] = knots[take[sure]], dist[take[sure]]
            live, reach = np.setdiff1d(live, done), 2 * reach
        return found, far
