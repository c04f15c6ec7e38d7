"""Derivatives of the log-gamma function, by recurrence to 8 and asymptotic series."""

from __future__ import annotations

import math


def _shifted(x: float, term) -> tuple[float, float]:
    total = 0.0
    while x < 8:
        total += term(x)
        x += 1
    return x, total


def digamma(x: float) -> float:
    x, low = _shifted(x, lambda v: -1 / v)
    i = 1 / (x * x)
    return low + math.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i * (1 / 240 - i / 132))))


def trigamma(x: float) -> float:
    x, low = _shifted(x, lambda v: 1 / (v * v))
    i = 1 / (x * x)
    return low + 1 / x + i / 2 + i / x * (1 / 6 - i * (1 / 30 - i * (1 / 42 - i * (1 / 30 - i * 5 / 66))))


def tetragamma(x: float) -> float:
    x, low = _shifted(x, lambda v: -2 / v**3)
    i = 1 / (x * x)
    return low - i - i / x - i * i * (1 / 2 - i * (1 / 6 - i * (1 / 6 - i * (3 / 10 - i * 5 / 6))))


def inverse_trigamma(q: float) -> float:
    """The r with trigamma(r) = q, by Newton steps on 1 / trigamma, which is nearly linear."""
    r = 0.5 + 1 / q
    for _ in range(60):
        t = trigamma(r)
        step = t * (1 - t / q) / tetragamma(r)
        r = max(r + step, r / 2)
        if abs(step) < 1e-12 * r:
            break
    return max(r, 1e-6)
