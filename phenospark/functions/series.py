"""The variables of one track as NumPy arithmetic on its frames x features matrix."""

from __future__ import annotations

import numpy as np


def on_line(frames: np.ndarray, values: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Values at frames t between the first and the last, linear between observed ones."""
    if len(frames) == 1:
        return np.repeat(values, len(t), axis=0)
    right = np.clip(np.searchsorted(frames, t, side="left"), 1, len(frames) - 1)
    a, b = frames[right - 1], frames[right]
    share = ((t - a) / (b - a))[:, None]
    return values[right - 1] + share * (values[right] - values[right - 1])


def rises(d: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the positive values and of the others, over n."""
    return np.where(d > 0, d, 0).sum(axis=0) / n, np.where(d <= 0, d, 0).sum(axis=0) / n


def skewness(v: np.ndarray) -> np.ndarray:
    """Bias-corrected; NaN below three rows or without variance, 0 unless a value is above 0."""
    n, m = len(v), v - v.mean(axis=0)
    m2, m3 = (m**2).mean(axis=0), (m**3).mean(axis=0)
    with np.errstate(invalid="ignore", divide="ignore"):
        g = m3 / m2**1.5 * np.sqrt(n * (n - 1)) / (n - 2) if n >= 3 else np.full(v.shape[1], np.nan)
    return np.where(v.max(axis=0) > 0, np.where(m2 > 0, g, np.nan), 0.0)


def variables(frames: np.ndarray, values: np.ndarray, levels: int, tap: float) -> np.ndarray:
    """(statistics, features), in the order mean, std, skew, asc, des, max, then asc, des, max of each level."""
    none = np.full(values.shape[1], np.nan)
    std = values.std(axis=0, ddof=1) if len(values) > 1 else none
    span = int(frames[-1] - frames[0]) + 1
    asc, des = rises(np.diff(values, axis=0), span) if len(values) > 1 else (none, none)
    out = [values.mean(axis=0), std, skewness(values), asc, des, values.max(axis=0)]
    # blocks whole on the line between two rows are counted, the others are made
    width, k = 2**levels, frames - frames[0]
    begins, ends = k // width, np.append(k[1:] - 1, k[-1]) // width
    between = np.maximum(ends - begins - 1, 0)[:-1]
    slope = np.diff(values, axis=0)[between > 0] / np.diff(k)[between > 0, None]
    between = between[between > 0]
    t = (np.unique(np.concatenate([begins, ends]))[:, None] * width + np.arange(width)).ravel()
    whole = np.where((t < span)[:, None], on_line(frames, values, np.minimum(t, span - 1) + frames[0]), np.nan)
    for level in range(1, levels + 1):
        half, scale = 2 ** (level - 1), tap * (tap / 2**0.5) ** (level - 1)
        halves = whole.reshape(-1, 2, half, values.shape[1]).sum(axis=2)
        d = scale * (halves[:, 0] - halves[:, 1])
        d = d[~np.isnan(d).any(axis=1)]
        many = between * (width // (2 * half))
        n = len(d) + int(many.sum())
        if n < 2:
            out += [none, none, none]
            continue
        same = -scale * half * half * slope
        more = [np.where(keep, same * many[:, None], 0).sum(axis=0) / n for keep in (same > 0, same <= 0)]
        asc, des = rises(d, n)
        out += [asc + more[0], des + more[1], np.concatenate([d, same]).max(axis=0)]
    return np.array(out)


def box_area(frames: np.ndarray, x: np.ndarray, y: np.ndarray) -> float:
    """Area of the box around the positions, for each frame of the span."""
    return float(np.ptp(x) * np.ptp(y) / (frames[-1] - frames[0] + 1))
