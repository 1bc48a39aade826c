"""Weights that turn bounded recursions into dot products.

Indicators see a window of N values, oldest first, and seed their recursion
inside it, so each is a fixed linear function of the window.
"""

from __future__ import annotations


def ema_taps(period: int, n: int) -> list[float]:
    """EMA over n values seeded with the mean of the first ``period``."""
    if n < period:
        raise ValueError("the window is shorter than the period")
    alpha = 2.0 / (period + 1.0)
    return seeded_taps(period, n, alpha)


def wilder_taps(period: int, n: int) -> list[float]:
    """Wilder's smoothing over n values seeded with the mean of the first ``period``."""
    return seeded_taps(period, n, 1.0 / period)


def seeded_taps(period: int, n: int, alpha: float) -> list[float]:
    fade = 1.0 - alpha
    later = [alpha * fade ** (n - 1 - i) for i in range(period, n)]
    return [fade ** (n - period) / period] * period + later


def macd_taps(n: int, fast: int = 12, slow: int = 26, signal: int = 9) -> tuple[list[float], list[float], list[float]]:
    """Taps of line, signal and histogram; the signal is an EMA of the line at every prefix of the window."""
    lines = []
    for m in range(slow, n + 1):
        f, s = ema_taps(fast, m), ema_taps(slow, m)
        lines.append([a - b for a, b in zip(f, s)] + [0.0] * (n - m))
    over = ema_taps(signal, len(lines))
    sig = [sum(w * line[i] for w, line in zip(over, lines)) for i in range(n)]
    return lines[-1], sig, [a - b for a, b in zip(lines[-1], sig)]


def fracdiff_taps(d: float, threshold: float = 1e-5, cap: int = 500) -> list[float]:
    """Binomial weights of (1-B)**d, newest value first, down to ``threshold`` and at most ``cap``."""
    taps = [1.0]
    while len(taps) < cap:
        k = len(taps)
        w = -taps[-1] * (d - k + 1.0) / k
        if abs(w) < threshold:
            break
        taps.append(w)
    return taps
