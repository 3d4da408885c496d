"""A rebuilt segment within an array of samples: what it is let see, whether it stays, its line and its edges.

The rules are those of operators/restore.py, for repairs that depend on one another, so that a task goes through a chunk in order. Arrays hold the samples from place `lo` on; nan stands for null.
"""

from __future__ import annotations

import numpy as np


def median(x: np.ndarray) -> float | None:
    return float(np.median(x)) if len(x) else None


def spread(x: np.ndarray, m: float) -> float:
    return 1.4826 * float(np.median(np.abs(x - m)))


def line(x: np.ndarray, y: np.ndarray) -> tuple[float, float] | None:
    """Intercept and slope by least squares; none if x doesn't vary."""
    if not len(x) or (var := float(np.mean((x - x.mean()) ** 2))) == 0:
        return None
    slope = float(np.mean((x - x.mean()) * (y - y.mean()))) / var
    return float(y.mean()) - slope * float(x.mean()), slope


class Chunk:
    """Samples lo, lo + 1, ... of a trace of n: v as repaired so far, bad (missing still), first and first_bad as given to the guard."""

    def __init__(self, lo: int, n: int, v: np.ndarray, bad: np.ndarray, first: np.ndarray | None = None, first_bad: np.ndarray | None = None):
        self.lo, self.n, self.v, self.bad, self.first, self.first_bad = lo, n, v, bad, first, first_bad

    def cut(self, a: int, b: int) -> slice:
        """The places a to b, as far as there are such."""
        a, b = max(a - self.lo, 0), min(b - self.lo + 1, len(self.v))
        return slice(a, max(a, b))

    def _good(self, a: int, b: int, v: np.ndarray, bad: np.ndarray) -> np.ndarray:
        at = self.cut(a, b)
        x = v[at][~bad[at]]
        return x[~np.isnan(x)]

    def good(self, a: int, b: int) -> np.ndarray:
        return self._good(a, b, self.v, self.bad)

    def seen(self, s: int, e: int, parts: list[tuple[int, int]], reach: int, whole: float, windows: list[tuple[int, int]]) -> list[np.ndarray]:
        """What windows show while s to e is rebuilt: the parts of other segments within reach at the level of their surroundings, missing samples left out."""
        level = np.full(len(self.v), np.inf)
        for a, b in {(max(a, s - reach, 0), min(b, e + reach)) for a, b in parts if a <= e + reach and b >= s - reach and (a, b) != (s, e)}:
            near = np.concatenate([self.good(max(a - reach, 0), a - 1), self.good(b + 1, b + reach)])
            at = self.cut(a, b)
            level[at] = np.minimum(level[at], median(near) if len(near) >= 8 else whole)
        set_ = np.isfinite(level)
        shown = np.where(set_, level, self.v)
        there = (set_ | ~self.bad) & ~np.isnan(shown)
        return [shown[at][there[at]] for at in (self.cut(a, b) for a, b in windows)]

    def guard(self, s: int, e: int, w: np.ndarray, reach: int, low: float = 0.2, high: float = 4.0, raw_factor: float = 1.1, around_factor: float = 2.0, floor: float = 0.5) -> tuple[str, float | None]:
        """The verdict on w, in place of s to e, and the deviation of its surroundings."""
        at = self.cut(s, e)
        own, kept = self._good(s, e, self.first, self.first_bad), w[~np.isnan(w)]
        raw_std = float(own.std()) if len(own) > 3 else None
        new_std = float(kept.std()) if len(kept) > 3 else 0.0
        inner = self.first[self.cut(s, min(e, self.n - 2))]
        moves, n1 = inner[~np.isnan(inner)], len(inner)
        beside = np.concatenate([self._good(max(s - reach, 0), s - 1, self.first, self.first_bad), self._good(e + 1, e + reach, self.first, self.first_bad)])
        around = spread(beside, median(beside)) if len(beside) >= 30 else raw_std
        around = None if around is None else max(around, floor)
        if raw_std is not None and new_std > max(raw_factor * raw_std, around_factor * around):
            return "energy", around
        alive = len(own) >= 30 and n1 >= 8 and len(moves) and moves.max() > moves.min() and self.first_bad[at].mean() <= 0.5 and low <= raw_std / around <= high
        return "alive" if alive else "kept", around

    def realigned(self, s: int, e: int, w: np.ndarray, around: float | None, side: int, skip: int, around_factor: float = 2.0) -> np.ndarray:
        """w on the line that its surroundings give, and pressed around it."""
        left, right = self.good(max(s - side, 0), s - 1), self.good(e + 1 + skip, e + skip + side)
        t, there = np.arange(len(w)) / max(e - s, 1), ~np.isnan(w)
        if not there.any():
            return w
        own = median(w[there])
        ml, cl = (median(left), spread(left, median(left))) if len(left) >= 4 else (own, 0.0)
        mr, cr = (median(right), spread(right, median(right))) if len(right) >= 4 else (ml, cl)
        unsteady = cr > 0 and cl > 0 and cr > 3.0 * max(cl, 0.5)
        clean = abs(mr - ml) < 2.0 * max(around or 0.0, 0.5) and not unsteady
        target = ml + (mr - ml if clean else 0.0) * t
        fit = line(t[there], w[there])
        x = w - (fit[0] + fit[1] * t if fit else w[there].mean()) + target
        std = float(x[there].std()) if there.sum() > 3 else 0.0
        most = max(around_factor * (around or 0.0), 0.5)
        return target + (x - target) * (most / std if std > most and std > 1e-9 else 1.0)

    def crossfaded(self, s: int, e: int, w: np.ndarray, blend: int, reach: int) -> np.ndarray:
        """w, at both edges fading into the line that the good samples outside go on with."""
        k = min(blend, (e - s + 1) // 4)
        if k < 2:
            return w
        out, size = w.copy(), len(w)
        p = np.arange(k)
        left, right = self.good(max(s - reach, 0), s - 1)[-3 * k :], self.good(e + 1, e + reach)[: 3 * k]
        for x, place, at, ahead in ((right, np.arange(len(right)), size - 1 - p, -(p + 1)), (left, np.arange(-len(left), 0), p, p)):
            if len(x) >= 4 and (fit := line(place.astype(float), x)):
                mixed = (fit[0] + fit[1] * ahead) * (1 - p / max(k - 1, 1)) + w[at] * (p / max(k - 1, 1))
                out[at] = np.where(np.isnan(mixed), w[at], mixed)
        return out
