"""NumPy arithmetic on one crop: the part of a frame inside an outline's bounding box, y down the rows."""

from __future__ import annotations

import numpy as np

OUTSIDE, BOUNDARY, INTERIOR = -1, 0, 1


def mask(x: np.ndarray, y: np.ndarray, width: int, height: int) -> np.ndarray:
    """Each pixel of a crop as outside, boundary or interior; x and y are boundary pixels from 0.

    In every column, then in every row, what lies before the first and behind the last boundary pixel is outside; a line
    without any changes sign as a whole. Then outside spreads to interior pixels beside it.
    """
    m = np.ones((height, width), dtype=np.int8)
    m[y, x] = BOUNDARY
    for lines in (m.T, m):
        edge = lines == BOUNDARY
        has = edge.any(axis=1)
        first, last = edge.argmax(axis=1), lines.shape[1] - 1 - edge[:, ::-1].argmax(axis=1)
        place = np.arange(lines.shape[1])
        out = (place < first[:, None]) | (place > last[:, None])
        lines[has[:, None] & out] = OUTSIDE
        lines[~has] *= -1
    while True:
        out = m == OUTSIDE
        beside = np.zeros_like(out)
        beside[1:] |= out[:-1]
        beside[:-1] |= out[1:]
        beside[:, 1:] |= out[:, :-1]
        beside[:, :-1] |= out[:, 1:]
        turned = beside & (m == INTERIOR)
        if not turned.any():
            return m
        m[turned] = OUTSIDE


def halve(image: np.ndarray, tap: float) -> np.ndarray:
    """Haar approximation, scaled to a mean: pairs down, then across; an odd edge is repeated."""
    image = np.pad(image, ((0, image.shape[0] % 2), (0, image.shape[1] % 2)), mode="edge")
    down = tap * (image[::2] + image[1::2]) / 2**0.5
    return tap * (down[:, ::2] + down[:, 1::2]) / 2**0.5


def enlarge(image: np.ndarray, times: int, shape: tuple[int, int]) -> np.ndarray:
    """Each pixel repeated, cut to a shape."""
    return image.repeat(times, axis=0).repeat(times, axis=1)[: shape[0], : shape[1]]


def levels(image: np.ndarray, n: int = 10) -> np.ndarray | None:
    """The image scaled to 0..n and cut to whole levels; None if it is constant."""
    lo, hi = image.min(), image.max()
    return np.floor((image - lo) * n / (hi - lo) + 1e-6).astype(int) if hi > lo else None


def cooccurrence(a: np.ndarray | None, b: np.ndarray | None, inside: np.ndarray, n: int = 10) -> np.ndarray:
    """How often each pair of levels meets at a pixel inside; level 0 is left out."""
    if a is None or b is None:
        return np.zeros((n, n))
    use = inside & (a > 0) & (b > 0)
    return np.bincount((np.minimum(a[use], n) - 1) * n + np.minimum(b[use], n) - 1, minlength=n * n).reshape(n, n).astype(float)


HARALICK = ("ASM", "Con", "IDM", "Ent", "Cor", "Var", "Sav", "Sen", "Den", "Dva", "Sva", "f13", "Sha", "Pro")


def _entropy(p: np.ndarray) -> float:
    p = p[p > 0]
    return float(-(p * np.log10(p)).sum())


def haralick(counts: np.ndarray) -> list[float | None]:
    """The fourteen features of a co-occurrence matrix, first image down the rows.

    As the results to match have them: logarithms to base 10, means crossed in Cor, Dva and Sva around the entropies.
    """
    total = counts.sum()
    if total == 0:
        return [None] * len(HARALICK)
    p = counts / total
    k = np.arange(1, len(p) + 1)
    i, j = k[:, None], k[None, :]
    px, py = p.sum(axis=0), p.sum(axis=1)
    mx, my = (k * px).sum(), (k * py).sum()
    vx, vy = ((k - mx) ** 2 * px).sum(), ((k - my) ** 2 * py).sum()
    sums = np.bincount((i + j).ravel(), weights=p.ravel())
    gaps = np.bincount(np.abs(i - j).ravel(), weights=p.ravel())
    ent, sen, den = _entropy(p), _entropy(sums), _entropy(gaps)
    hxy2 = _entropy(px[None, :] * py[:, None])
    v = vx * vy
    return [
        (p**2).sum(),
        ((i - j) ** 2 * p).sum(),
        (p / (1 + (i - j) ** 2)).sum(),
        ent,
        ((i - mx) * (j - my) * p).sum() / v**0.5 if v > 0 else 0.0,
        ((i - (mx + my) / 2) ** 2 * p).sum(),
        ((i + j) * p).sum(),
        sen,
        den,
        ((np.abs(i - j) - den) ** 2 * p).sum(),
        ((i + j - sen) ** 2 * p).sum(),
        float(np.sqrt(1 - np.exp(-2 * abs(hxy2 - ent)))),
        ((i + j - mx - my) ** 3 * p).sum(),
        ((i + j - mx - my) ** 4 * p).sum(),
    ]


def pair_dispersion(shape: np.ndarray) -> float | None:
    """Sample variance over mean of the distances of all pairs of pixels in a boolean mask.

    Distances depend on offsets alone, and the mask's autocorrelation counts the pairs of each offset.
    """
    if shape.sum() < 3:
        return None
    ys, xs = np.flatnonzero(shape.any(axis=1)), np.flatnonzero(shape.any(axis=0))
    m = shape[ys[0] : ys[-1] + 1, xs[0] : xs[-1] + 1].astype(float)
    h, w = m.shape
    f = np.fft.rfft2(m, (2 * h, 2 * w))
    n = np.rint(np.fft.irfft2(f * f.conj(), (2 * h, 2 * w)))
    dy = np.minimum(np.arange(2 * h), 2 * h - np.arange(2 * h))[:, None]
    dx = np.minimum(np.arange(2 * w), 2 * w - np.arange(2 * w))[None, :]
    d = np.sqrt(dy**2 + dx**2)
    n[0, 0] = 0
    pairs = n.sum() / 2
    mean = (n * d).sum() / 2 / pairs
    return float((n * (d - mean) ** 2).sum() / 2 / (pairs - 1) / mean)


def intensity_quantiles(image: np.ndarray, interior: np.ndarray) -> list[float | None]:
    """pair_dispersion of the interior pixels at or above each decile of their intensity."""
    v = image[interior]
    if len(v) == 0:
        return [None] * 9
    return [pair_dispersion(interior & (image >= t)) for t in np.quantile(v, np.arange(1, 10) / 10)]


def skewness(v: np.ndarray) -> float | None:
    """Bias-corrected; None where undefined."""
    n, m = len(v), v - v.mean()
    m2 = (m**2).mean()
    return float((m**3).mean() / m2**1.5 * np.sqrt(n * (n - 1)) / (n - 2)) if n >= 3 and m2 > 0 else None
