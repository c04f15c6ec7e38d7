"""Distribution and spectrum statistics of one series without missing values."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np


def welch(x: np.ndarray, rate: float, nperseg: int) -> tuple[np.ndarray, np.ndarray]:
    """One-sided power density: Hann windows, half overlapping, each less its mean."""
    win = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(nperseg) / nperseg)
    parts = np.lib.stride_tricks.sliding_window_view(x, nperseg)[:: nperseg - nperseg // 2]
    power = np.abs(np.fft.rfft((parts - parts.mean(axis=1, keepdims=True)) * win, axis=1)) ** 2 / (rate * (win**2).sum())
    power[:, 1 : (nperseg + 1) // 2] *= 2
    return np.fft.rfftfreq(nperseg, 1 / rate), power.mean(axis=0)


def spectrum(x: np.ndarray, grid: float = 10.0, most: int = 288) -> dict:
    """Log-log slope with its fit, shares of power in the 20-28 h and 9-14 h bands, and the dominant period in hours."""
    f, p = welch(x, 1 / grid, min(len(x) // 4, most))
    pos = f > 0
    lf, lp = np.log10(f[pos]), np.log10(p[pos])
    slope, intercept = np.polyfit(lf, lp, 1)
    hours = 1 / (60 * f[pos])
    share = lambda a, b: float(p[pos][(hours >= a) & (hours <= b)].sum() / p[pos].sum() * 100)
    top = int(np.argmax(p))
    return {
        "slope": float(slope), "intercept": float(intercept), "r2": float(np.corrcoef(lf, lp)[0, 1] ** 2), "pct_circadian": share(20, 28),
        "pct_semidiurnal": share(9, 14), "dominant_hours": float(1 / (60 * f[top])) if f[top] > 0 else None,
    }


def kde_modes(x: np.ndarray, points: int = 100) -> int:
    """Interior peaks of a Gaussian kernel density (Scott's width) on a grid over the range."""
    width = x.std(ddof=1) * len(x) ** -0.2
    if not width > 0:
        return 0
    grid = np.linspace(x.min(), x.max(), points)
    y = np.zeros(points)
    for part in np.array_split(x, max(1, len(x) // 5000)):
        y += np.exp(-0.5 * ((grid[:, None] - part[None, :]) / width) ** 2).sum(axis=1)
    return int(((y[1:-1] > y[:-2]) & (y[1:-1] > y[2:])).sum())


def gmm_delta_bic(x: np.ndarray, rounds: int = 200, tol: float = 1e-3) -> dict:
    """BIC of one normal less that of a mixture of two (EM from the quartiles): over 10 speaks for two."""
    n, floor = len(x), 1e-6
    one = -0.5 * n * (math.log(2 * math.pi * (x.var() + floor)) + x.var() / (x.var() + floor))
    mean, var, share, last = np.quantile(x, [0.25, 0.75]), np.full(2, x.var() + floor), np.full(2, 0.5), -np.inf
    for _ in range(rounds):
        logs = np.log(share) - 0.5 * ((x[:, None] - mean) ** 2 / var + np.log(2 * np.pi * var))
        total = np.logaddexp(logs[:, 0], logs[:, 1])
        post = np.exp(logs - total[:, None])
        mass = post.sum(axis=0) + 1e-12
        share, mean = mass / mass.sum(), post.T @ x / mass
        var = (post * (x[:, None] - mean) ** 2).sum(axis=0) / mass + floor
        if total.mean() - last < tol:
            break
        last = total.mean()
    order = np.argsort(mean)
    delta = (-2 * one + 2 * math.log(n)) - (-2 * float(total.sum()) + 5 * math.log(n))
    return {"delta_bic": delta, "bimodal": delta > 10, "means": mean[order].tolist(), "mode_gap": float(np.ptp(mean)), "weights": sorted(share.tolist())}


#: Rows of the regression that are held at a time.
ADF_ROWS = 4096


def adf(x: np.ndarray) -> float:
    """p-value of the augmented Dickey-Fuller test with a constant; lags by AIC up to 12 (n/100)^(1/4)."""
    d, n = np.diff(x), len(x)
    most = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)

    def triangle(lags: int, skip: int, until: int, r: np.ndarray) -> np.ndarray:
        """R of the QR of [1, level, lagged differences, difference] below the rows ``r``, some rows at a time: it has all that least squares need."""
        for first in range(skip, until, ADF_ROWS):
            at = slice(first, min(first + ADF_ROWS, until))
            block = np.empty((len(r) + at.stop - first, lags + 3))
            block[: len(r)] = r
            rows = block[len(r) :]
            rows[:, 0], rows[:, 1], rows[:, -1] = 1, x[at], d[at]
            for k in range(1, lags + 1):
                rows[:, k + 1] = d[first - k : at.stop - k]
            r = np.linalg.qr(block, mode="r")
        return r

    def fit(r, m, lags: int):
        a, y = r[:, : lags + 2], r[:, -1]
        coef, *_ = np.linalg.lstsq(a, y, rcond=np.finfo(float).eps * m)
        return a, coef, float(((y - a @ coef) ** 2).sum())

    r, m = triangle(most, most, len(d), np.empty((0, most + 3))), len(d) - most
    size = np.linalg.svd(r[:, :-1], compute_uv=False)
    whole = size[-1] > 4 * np.finfo(float).eps * m * size[0]
    if whole:
        # Of full rank, as are then all fewer lags: a fit leaves what the triangle has of the difference below its columns.
        below = np.cumsum(r[::-1, -1] ** 2)[::-1]
        left = [float(below[k + 2]) if k + 2 < len(below) else 0.0 for k in range(most + 1)]
    else:
        left = [fit(r, m, k)[2] for k in range(most + 1)]
    lags = min((m * math.log(max(rss, 1e-300) / m) + 2 * (k + 2), k) for k, rss in enumerate(left))[1]
    # The rows from ``most`` on are in the triangle already; fewer lags have a few rows more.
    known = np.column_stack([r[:, : lags + 2], r[:, -1]]) if whole else np.empty((0, lags + 3))
    r, m = triangle(lags, lags, most if whole else len(d), known), len(d) - lags
    a, coef, rss = fit(r, m, lags)
    se = math.sqrt(max(rss, 1e-300) / (m - lags - 2) * np.linalg.pinv(a.T @ a)[1, 1])
    stat = coef[1] / se
    # MacKinnon's response surface for one series with a constant.
    if stat > 2.74:
        return 1.0
    if stat < -18.83:
        return 0.0
    poly = (2.1659, 1.4412, 0.038269) if stat <= -1.61 else (1.7339, 0.93202, -0.12745, -0.010368)
    return NormalDist().cdf(sum(c * stat**i for i, c in enumerate(poly)))


def shapiro(x: np.ndarray) -> tuple[float, float]:
    """(W, p) of the Shapiro-Wilk test by Royston's approximation; for 12 to 5000 values."""
    x, n = np.sort(x), len(x)
    normal = NormalDist()
    m = np.array([normal.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    u, mm = n**-0.5, float(m @ m)
    # The polynomials of the approximation.
    last = np.polyval([-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, m[-1] / math.sqrt(mm)], u)
    near = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, m[-2] / math.sqrt(mm)], u)
    a = m / math.sqrt((mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * near**2))
    a[-1], a[-2], a[0], a[1] = last, near, -last, -near
    ss = float(((x - x.mean()) ** 2).sum())
    if ss <= 0:
        return 1.0, 1.0
    w = min(float(a @ x) ** 2 / ss, 1.0)
    ln = math.log(n)
    mu = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], ln)
    sigma = math.exp(np.polyval([0.0030302, -0.082676, -0.4803], ln))
    return w, 1 - normal.cdf((math.log(max(1 - w, 1e-300)) - mu) / sigma)
