"""Numpy kernels on one segment: spectra, synthesis, splines and baselines. No Spark here; tasks call them per segment."""

from __future__ import annotations

import numpy as np


def power_of_two(n: int) -> int:
    return 1 << max(0, int(n) - 1).bit_length()


def smoothstep(n: int) -> np.ndarray:
    x = np.linspace(0.0, 1.0, n)
    return x * x * (3 - 2 * x)


def welch(x: np.ndarray, fs: float, n_fft: int) -> np.ndarray:
    """Power density: half-overlapping Hann segments of the demeaned signal, each demeaned, one-sided."""
    x = np.asarray(x, float)
    if len(x) < 8:
        return np.zeros(n_fft // 2 + 1)
    x = x - x.mean()
    size = int(np.clip(min(len(x), max(64, len(x) // 4)), 16, min(len(x), max(16, n_fft)))) if len(x) >= 16 else len(x)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    starts = range(0, len(x) - size + 1, size - size // 2)
    parts = np.stack([x[s : s + size] for s in starts])
    parts = parts - parts.mean(axis=1, keepdims=True)
    power = np.abs(np.fft.rfft(parts * window, n=max(n_fft, size))) ** 2 / (fs * (window**2).sum())
    power[:, 1 : -1 if max(n_fft, size) % 2 == 0 else None] *= 2
    return power.mean(axis=0)


def analytic(x: np.ndarray) -> np.ndarray:
    n = len(x)
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x) * gain)


def fuse(before: np.ndarray | None, after: np.ndarray | None) -> np.ndarray | None:
    if before is None or after is None:
        return after if before is None else before
    return np.exp(0.5 * np.log(before + 1e-30) + 0.5 * np.log(after + 1e-30))


def smoothed(psd: np.ndarray, fs: float, bandwidth: float = 0.005) -> np.ndarray:
    width = max(1, int(bandwidth / (fs / (2 * max(1, len(psd) - 1)))))
    return np.convolve(psd, np.ones(width) / width, mode="same") if width > 1 else psd


def target_spectrum(before, after, fs: float, n: int) -> np.ndarray:
    n_fft = power_of_two(2 * n)
    sides = [smoothed(welch(r, fs, n_fft), fs) if r is not None and len(r) >= 8 else None for r in (before, after)]
    sides = [None if s is None or len(s) != n_fft // 2 + 1 else s for s in sides]
    out = fuse(*sides)
    return np.zeros(n_fft // 2 + 1) if out is None else out


def block_template(references: list[np.ndarray], n: int, fs: float, rng: np.random.Generator, block_s: float = 60.0, fade_s: float = 2.0) -> np.ndarray:
    """Circular pieces of the references, joined by short fades until they are long enough."""
    size = min(max(16, round(block_s * fs)), max(len(r) for r in references))
    overlap = min(max(1, round(fade_s * fs)), max(1, size // 4))
    pieces, have = [], 0
    while have < n:
        r = references[int(rng.integers(len(references)))]
        piece = np.take(r, np.arange(size) + int(rng.integers(len(r))), mode="wrap")
        if pieces:
            k = min(overlap, len(pieces[-1]), size - 1)
            w = np.arange(k) / k
            pieces[-1][-k:] = pieces[-1][-k:] * (1 - w) + piece[:k] * w
            piece = piece[k:]
        pieces.append(piece.copy())
        have += len(piece)
    return np.concatenate(pieces)[:n]


def with_spectrum(template: np.ndarray, psd: np.ndarray, fs: float) -> np.ndarray:
    """The template's phases with the amplitudes of a power spectrum, without mean."""
    n_fft = max(power_of_two(2 * len(template)), 2 * (len(psd) - 1))
    spectrum = np.fft.rfft(template - template.mean(), n=n_fft)
    at = np.fft.rfftfreq(n_fft, 1 / fs)
    amplitude = np.sqrt(np.maximum(np.interp(at, np.linspace(0, fs / 2, len(psd)), psd), 0))
    if amplitude.max() <= 1e-15:
        return template - template.mean()
    shaped = amplitude * np.exp(1j * np.angle(spectrum))
    shaped[0] = 0
    shaped[-1] = shaped[-1].real
    return np.fft.irfft(shaped, n=n_fft)[: len(template)]


def line_through(before: np.ndarray | None, after: np.ndarray | None, n: int, gap: int) -> tuple[float, float]:
    """Levels at the first and the last place of the hole: a line through both references, or each side's median."""
    if before is not None and after is not None and min(len(before), len(after)) >= 10:
        t = np.concatenate([np.arange(len(before)) - len(before) + 1 - gap, np.arange(len(after)) + n + gap])
        slope, level = np.polyfit(t, np.concatenate([before, after]), 1)
        return float(level), float(level + slope * (n - 1))
    left = float(np.median(before)) if before is not None and len(before) else None
    right = float(np.median(after)) if after is not None and len(after) else None
    return (left if left is not None else right), (right if right is not None else left)


def robust_scale(x: np.ndarray) -> float:
    mad = float(np.median(np.abs(x - np.median(x))))
    return 1.4826 * mad if mad > 0 else max(float(np.std(x)), 1e-12)


def robust_slope(x: np.ndarray) -> float:
    d = np.diff(x)
    if not len(d):
        return 0.0
    limit = 6 * float(np.median(np.abs(d)))
    slope = float(np.median(d))
    return float(np.clip(slope, -limit, limit)) if limit > 6e-12 else slope


def aligned(x: np.ndarray, before, after, fs: float, gap: int, mode: str = "auto") -> tuple[np.ndarray, str]:
    """The median taken off and a line between the two sides' levels put on; a level step on stable sides stays at the end instead."""
    if mode == "off" or before is None or after is None or min(len(before), len(after)) < 4:
        return x, "off" if mode == "off" else "bridge"
    left, right = line_through(before, after, len(x), gap)
    context = max(4, round(60 * fs))
    a, b = robust_scale(before[-context:]), robust_scale(after[:context])
    if mode == "auto":
        mode = "post_shift" if abs(right - left) > max(8 * max(a, b), 0.5) and max(a, b) / max(min(a, b), 1e-12) <= 2.5 else "bridge"
    return x - np.median(x) + np.linspace(left, left if mode == "post_shift" else right, len(x)), mode


def blended(x: np.ndarray, left: np.ndarray, right: np.ndarray, fs: float, share: float = 0.08, least: int = 8, most_s: float = 20.0) -> np.ndarray:
    """Ends that go over smoothly from the trend of the samples outside."""
    x, n = x.copy(), len(x)
    edge = min(max(least, round(n * share)), max(1, round(most_s * fs)), n // 2) if n >= 4 else 0
    if edge <= 1:
        return x
    fade, fit = smoothstep(edge), max(4, min(2 * edge, 64))
    for side, context in ((0, left), (1, right)):
        context = context[np.isfinite(context)]
        context = context[-fit:] if side == 0 else context[:fit]
        if len(context) >= 2:
            slope, steps = robust_slope(context), np.arange(1, edge + 1)
            if side == 0:
                x[:edge] = (context[-1] + slope * steps) * (1 - fade) + x[:edge] * fade
            else:
                x[-edge:] = x[-edge:] * fade[::-1] + (context[0] - slope * steps[::-1]) * (1 - fade[::-1])
        elif len(context) == 1:
            x[0 if side == 0 else -1] = context[0]
    return x


def reconstructed(before, after, left, right, n: int, fs: float, gap: int, seed: int, mode: str = "auto") -> np.ndarray:
    """A long gap from both references: block template, fused spectrum, healthy spread, level line and smooth ends."""
    references = [r for r in (before, after) if r is not None and len(r) >= 4]
    if not references:
        return np.full(n, np.nan)
    x = with_spectrum(block_template(references, n, fs, np.random.default_rng(seed)), target_spectrum(before, after, fs, n), fs)
    spread = float(np.mean([np.std(r) for r in references]))
    if np.std(x) > 1e-12:
        x = x * (spread / np.std(x))
    start, end = line_through(before, after, n, gap)
    x = x - x.mean() + np.linspace(start, end, n)
    x, _ = aligned(x, before, after, fs, gap, mode)
    return blended(x, left, right, fs)


# Baselines.


def pchip(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Monotone cubic interpolation; outside, the end pieces go on."""
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    if len(x) == 2:
        return y[0] + d[0] * (at - x[0])
    m = np.zeros(len(x))
    same = d[:-1] * d[1:] > 0
    w1, w2 = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        m[1:-1] = np.where(same, (w1 + w2) / (w1 / d[:-1] + w2 / d[1:]), 0)
    for end, (h0, h1, d0, d1) in ((0, (h[0], h[1], d[0], d[1])), (-1, (h[-1], h[-2], d[-1], d[-2]))):
        s = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        m[end] = 0 if s * d0 <= 0 else 3 * d0 if d0 * d1 <= 0 and abs(s) > 3 * abs(d0) else s
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, len(x) - 2)
    t = (at - x[k]) / h[k]
    return y[k] * (1 + 2 * t) * (1 - t) ** 2 + h[k] * m[k] * t * (1 - t) ** 2 + y[k + 1] * t * t * (3 - 2 * t) + h[k] * m[k + 1] * t * t * (t - 1)


def cubic_spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Natural cubic spline."""
    h, n = np.diff(x), len(x)
    a = np.zeros((n, n))
    a[0, 0] = a[-1, -1] = 1
    rhs = np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        rhs[i] = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
    m = np.linalg.solve(a, rhs)
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 2)
    u, v = x[k + 1] - at, at - x[k]
    return (m[k] * u**3 + m[k + 1] * v**3) / (6 * h[k]) + (y[k] / h[k] - m[k] * h[k] / 6) * u + (y[k + 1] / h[k] - m[k + 1] * h[k] / 6) * v


def low_pass(x: np.ndarray, keep: float = 0.1) -> np.ndarray:
    f = np.fft.rfft(x)
    f[max(1, int(len(f) * keep)) :] = 0
    return np.fft.irfft(f, n=len(x))


def burg(x: np.ndarray, order: int) -> np.ndarray:
    """Prediction coefficients by Burg's recursion: x[t] is about their sum with the last samples, the newest first."""
    f, b, a = x[1:].copy(), x[:-1].copy(), np.zeros(0)
    for _ in range(order):
        k = 2 * (f @ b) / max(f @ f + b @ b, 1e-30)
        a = np.concatenate([a - k * a[::-1], [k]])
        f, b = (f - k * b)[1:], (b - k * f)[:-1]
    return a


def autoregressive(left: np.ndarray, right: np.ndarray, n: int, order: int = 8) -> np.ndarray:
    """Predictions from both sides, faded into one another; a line where they diverge."""

    def predict(x: np.ndarray) -> np.ndarray:
        level = x.mean()
        a, past = burg(x - level, order), list((x - level)[-order:])
        for _ in range(n):
            past.append(float(a @ np.array(past[: -order - 1 : -1])))
        return np.array(past[order:]) + level

    w = np.linspace(0, 1, n)
    out = predict(left) * (1 - w) + predict(right[::-1])[::-1] * w
    bound = 100 * max(np.std(np.concatenate([left, right])), 1e-12)
    return out if np.isfinite(out).all() and np.abs(out - np.mean([left.mean(), right.mean()])).max() < bound else np.linspace(left[-1], right[0], n)


def singular_spectrum(x: np.ndarray, hole: np.ndarray, window: int, rank: int = 10, rounds: int = 30) -> np.ndarray:
    """Gap filling by repeated low-rank approximation of the trajectory matrix (Kondrashov and Ghil)."""
    x = x.copy()
    level = x[~hole].mean()
    x[hole] = level
    for _ in range(rounds):
        m = np.lib.stride_tricks.sliding_window_view(x - level, window)
        u, s, v = np.linalg.svd(m, full_matrices=False)
        low = (u[:, :rank] * s[:rank]) @ v[:rank]
        total, count = np.zeros(len(x)), np.zeros(len(x))
        for k in range(window):
            total[k : k + len(low)] += low[:, k]
            count[k : k + len(low)] += 1
        new = (total / count + level)[hole]
        done = np.max(np.abs(new - x[hole])) < 1e-6
        x[hole] = new
        if done:
            break
    return x


# Smoothing and other spectra.
