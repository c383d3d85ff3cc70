"""NumPy arithmetic on one outline: points in boundary order."""

from __future__ import annotations

import math

import numpy as np


def points(coords: list[dict] | None) -> tuple[np.ndarray, np.ndarray]:
    """x and y of a list of points."""
    coords = coords or []
    return np.array([p["x"] for p in coords], dtype=float), np.array([p["y"] for p in coords], dtype=float)


def farthest_pair(x: np.ndarray, y: np.ndarray, few: int = 256) -> tuple[int, int]:
    """Indices (first, second) of the pair farthest apart; of equal ones that with the smallest second, then first.

    Only corners of the convex hull can be farthest apart. Up to `few` points all pairs are compared; beyond, those of the hull
    that rotating calipers meet, so that a long outline takes n log n steps.
    """
    if len(x) <= few:
        d = (x[:, None] - x) ** 2 + (y[:, None] - y) ** 2
        second, first = divmod(int(d.argmax()), len(x))
        return first, second
    h = hull(x, y)
    pairs = antipodal(x[h], y[h])
    p, q = h[pairs[:, 0]], h[pairs[:, 1]]
    d = (x[p] - x[q]) ** 2 + (y[p] - y[q]) ** 2
    best = d == d.max()
    second, first = min((int(min(a, b)), int(max(a, b))) for a, b in zip(p[best], q[best], strict=True))
    return first, second


def hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Indices of the corners of the convex hull, counter-clockwise; of equal points the first (Andrew's monotone chain)."""
    order = np.lexsort((np.arange(len(x)), y, x))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0)
    order = order[new]
    px, py = x[order].tolist(), y[order].tolist()

    def half(numbers: range) -> list[int]:
        out: list[int] = []
        for i in numbers:
            while len(out) > 1 and (px[out[-1]] - px[out[-2]]) * (py[i] - py[out[-2]]) - (py[out[-1]] - py[out[-2]]) * (px[i] - px[out[-2]]) <= 0:
                out.pop()
            out.append(i)
        return out

    n = len(order)
    lower, upper = half(range(n)), half(range(n - 1, -1, -1))
    return order[np.array([*lower[:-1], *upper[:-1]] or [0])]


def antipodal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Pairs of corners of a convex polygon (counter-clockwise) among which are all farthest ones, by rotating calipers."""
    n = len(x)
    if n < 3:
        return np.array([[0, n - 1]])
    px, py, out, j = x.tolist(), y.tolist(), [], 1
    for i in range(n):
        k = (i + 1) % n
        dx, dy = px[k] - px[i], py[k] - py[i]
        while True:
            m = (j + 1) % n
            turn = dx * (py[m] - py[j]) - dy * (px[m] - px[j])
            if turn < 0:
                break
            out += [(i, m), (k, m)]  # where the next side is parallel its end is as far, too
            if turn == 0:
                break
            j = m
        out += [(i, j), (k, j)]
    return np.array(out)


def extents(x: np.ndarray, y: np.ndarray) -> tuple[float | None, float | None]:
    """Extents along and across the farthest pair's line."""
    if len(x) == 0:
        return None, None
    p, q = farthest_pair(x, y)
    turn = math.atan2(y[p] - y[q], x[p] - x[q])
    along = math.cos(turn) * x + math.sin(turn) * y
    across = math.cos(turn) * y - math.sin(turn) * x
    return float(np.ptp(along)), float(np.ptp(across))


def corners(x: np.ndarray, y: np.ndarray, off: float = 2.5, apart: int = 4) -> list[int]:
    """Corners of a polygon near the outline.

    From the first point and the one farthest from it, sides are split at the point farthest from their line, where that is
    more than `off` away and the side spans more than `apart` points, until none is. The last side runs to the end of the
    outline and is measured against the line to its beginning.
    """
    n = len(x)

    def split(a: int, b: int, stop: int) -> int | None:
        last = stop - 1 if b else stop
        if stop - a <= apart or last <= a:
            return None
        dx, dy = x[b] - x[a], y[b] - y[a]
        length = math.hypot(dx, dy)
        if length == 0:
            return None
        d = np.abs(dx * (y[a + 1 : last + 1] - y[a]) - dy * (x[a + 1 : last + 1] - x[a])) / length
        i = int(d.argmax())
        return a + 1 + i if d[i] > off else None

    far = int(((x - x[0]) ** 2 + (y - y[0]) ** 2).argmax())
    at = [0, far]
    while True:
        new = [0]
        for a, b in zip(at, [*at[1:], 0], strict=True):
            s = split(a, b, b if b else n - 1)
            if s is not None:
                new.append(s)
            if b:
                new.append(b)
        if len(new) == len(at):
            return new
        at = new


def polygon_features(x: np.ndarray, y: np.ndarray) -> tuple[float | None, ...]:
    """Longest side, smallest angle, sample variances of angles and of sides."""
    if len(x) < 2:
        return None, None, None, None
    at = np.array(corners(x, y))
    px, py = x[at], y[at]
    a2 = (px - np.roll(px, -1)) ** 2 + (py - np.roll(py, -1)) ** 2
    b2 = np.roll(a2, -1)
    c2 = (px - np.roll(px, -2)) ** 2 + (py - np.roll(py, -2)) ** 2
    with np.errstate(invalid="ignore", divide="ignore"):
        cosine = (a2 + b2 - c2) / (2 * np.sqrt(a2 * b2))
        # a straight angle back onto itself counts as a whole turn
        angle = np.where(np.abs(cosine - 1) > 0.001, np.arccos(np.clip(cosine, -1, 1)), 2 * np.pi)
    side = np.sqrt(a2)
    spread = [float(v.var(ddof=1)) if len(v) > 1 else None for v in (angle, side)]
    return float(side.max()), float(angle.min()), spread[0], spread[1]


def densify(x: np.ndarray, y: np.ndarray, step: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """The closed outline resampled at equal steps of arc length, as whole pixels without repeats in a row."""
    cx, cy = np.append(x, x[0]), np.append(y, y[0])
    length = np.concatenate([[0.0], np.cumsum(np.hypot(np.diff(cx), np.diff(cy)))])
    n = max(1, round(length[-1] / step))
    t = np.arange(n) * (length[-1] / n)
    px, py = np.rint(np.interp(t, length, cx)).astype(int), np.rint(np.interp(t, length, cy)).astype(int)
    new = np.ones(n, dtype=bool)
    new[1:] = (np.diff(px) != 0) | (np.diff(py) != 0)
    return px[new], py[new]
