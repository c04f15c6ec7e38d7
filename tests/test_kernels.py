import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.functions import changes, filters, special, spectra


@given(st.floats(0.05, 500))
@settings(max_examples=100, deadline=None)
def test_special_functions_recur(x):
    assert special.digamma(x + 1) == pytest.approx(special.digamma(x) + 1 / x, rel=1e-10, abs=1e-10)
    assert special.trigamma(x + 1) == pytest.approx(special.trigamma(x) - 1 / x**2, rel=1e-9, abs=1e-10)
    assert special.tetragamma(x + 1) == pytest.approx(special.tetragamma(x) + 2 / x**3, rel=1e-8, abs=1e-9)


def test_special_values():
    assert special.digamma(1) == pytest.approx(-0.5772156649015329, abs=1e-12)
    assert special.trigamma(1) == pytest.approx(math.pi**2 / 6, abs=1e-12)
    assert special.tetragamma(1) == pytest.approx(-2.404113806319188, abs=1e-9)
    for q in (1e-6, 1e-3, 0.1, 1.0, 5.0):
        assert special.trigamma(special.inverse_trigamma(q)) == pytest.approx(q, rel=1e-9)


def signal(n=80, seed=3):
    rng = np.random.default_rng(seed)
    t = np.cumsum(np.r_[0, rng.uniform(8, 12, n - 1)])
    return t, np.maximum(40 + 10 * np.sin(2 * np.pi * t / 1440) + rng.normal(0, 6, n), 1.0)


GAMMA = (20.0, -math.log(45.0), 10.0, 90.0)
CAUSAL = {
    "linear": lambda t, v: filters.smooth_linear(t, np.log(v), 0.95, 0.02, 0.05, 10.0),
    "switching": lambda t, v: filters.smooth_switching(t, np.log(v) - 3.7, [-0.2, 0.2], [0.01, 0.01], [0.05, 0.05], 10.0),
    "ssa": lambda t, v: filters.smooth_ssa(np.log(v)),
    "krls": lambda t, v: filters.smooth_krls(t, np.log(v) - 3.7, budget=20),
    "gamma": lambda t, v: filters.GammaModel(*GAMMA).run(t, v)[0],
    "regimes": lambda t, v: filters.smooth_regimes(t, v, 1.0, 90.0, [-1, 0, 1], 1.0, 5.0, 0.4, 7)[0],
}


@pytest.mark.parametrize("name", CAUSAL)
def test_causal_filters_never_look_ahead(name):
    t, v = signal()
    whole, part = CAUSAL[name](t, v), CAUSAL[name](t[:50], v[:50])
    assert np.isfinite(whole).all()
    assert np.abs(whole[:50] - part).max() < 1e-9


def test_switching_filter_with_equal_regimes_is_a_kalman_filter():
    t, v = signal()
    z = np.log(v) - 3.7
    got = filters.smooth_switching(t, z, [0.0, 0.0], [0.02, 0.02], [0.05, 0.05], 10.0, phi=1.0)
    assert got == pytest.approx(filters.smooth_linear(t, z, 1.0, 0.02, 0.05, 10.0), abs=1e-9)


def test_regime_filter_agrees_with_the_exact_law():
    """Without the harmonic the law is that of a regime and a level: summed over a fine grid."""
    rng = np.random.default_rng(5)
    t = np.cumsum(rng.uniform(5, 30, 60))
    mu, spread, sigma, stay, tau, share, lo, hi = np.array([-1.0, 1.0]), 0.8, 4.0, 0.9, 200.0, 0.3, 0.0, 100.0
    y = np.where(np.arange(60) // 20 == 1, 70, 30) + rng.normal(0, 4, 60)
    x = np.linspace(-5, 5, 1201)
    bell = lambda d, sd: np.exp(-0.5 * (d / sd) ** 2)
    p = bell(x - mu[:, None], 0.5 * spread) / 2
    want = []
    for i in range(60):
        if i:
            dt = t[i] - t[i - 1]
            p = np.array([[stay, 1 - stay], [1 - stay, stay]]) @ p
            for j in range(2):
                move = bell(x[:, None] - (mu[j] + math.exp(-dt / tau) * (x - mu[j])), share * spread * math.sqrt(dt / 10))
                p[j] = (move / move.sum(axis=0)) @ p[j]
        shown = lo + (hi - lo) / (1 + np.exp(-x))
        p = p * bell(y[i] - shown, sigma)
        p /= p.sum()
        want.append((p * shown).sum())
    got, level = filters.smooth_regimes(t, y, lo, hi, mu, spread, sigma, 0.0, 3, n=6000, stay=stay, tau=tau, level_share=share, season=0.0)
    miss = np.abs(got - want)
    assert miss.mean() < 0.15 and miss.max() < 3 and np.array_equal(got, level), miss  # few particles live through a jump


def test_smc_agrees_with_the_truth():
    t, v = signal(60)
    par = {"lo": 10.0, "hi": 90.0, "z_level_loc": 0.0, "z_level_scale": 0.5, "z_seas_scale": 0.3, "sigma_obs": 6.0, "sigma_level": 0.05, "sigma_seas": 0.01, "omega1": 2 * math.pi / 144, "omega2": 4 * math.pi / 144}
    mean, level, low, high = filters.smooth_smc(t, v, par, 1)
    truth = 40 + 10 * np.sin(2 * np.pi * t / 1440)
    assert np.sqrt(((mean - truth) ** 2).mean()) < 4 and (low <= mean).all() and (mean <= high).all()
    assert ((mean > 10) & (mean < 90) & (level > 10) & (level < 90)).all()
    assert np.array_equal(mean, filters.smooth_smc(t, v, par, 1)[0])


def test_smc_holds_one_stretch_of_particles(monkeypatch):
    import tracemalloc

    t, v = signal(1500)
    par = {"lo": 10.0, "hi": 90.0, "z_level_loc": 0.0, "z_level_scale": 0.5, "z_seas_scale": 0.3, "sigma_obs": 6.0, "sigma_level": 0.05, "sigma_seas": 0.01, "omega1": 2 * math.pi / 144, "omega2": 4 * math.pi / 144}
    whole = filters.smooth_smc(t, v, par, 1)
    monkeypatch.setattr(filters, "MARK", 100)
    tracemalloc.start()
    parts = filters.smooth_smc(t, v, par, 1)
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # All states of 1500 times are 18 MB.
    assert held < 6e6 and all(np.array_equal(a, b) for a, b in zip(whole, parts, strict=True))


def test_gamma_model_offline_forecast_and_missing():
    t, v = signal(120)
    v[40] = np.nan
    m = filters.GammaModel(*GAMMA)
    online, _ = m.run(t, v)
    offline = m.look_back()
    assert (offline > 0).all() and np.isfinite(online[40]) and np.isfinite(m.loglik)
    mean, q = m.forecast(6, samples=4000, seed=0)
    assert (q[0] < q[1]).all() and (q[1] < q[2]).all() and (mean > q[0]).all()


def long_signal(n=9000):
    rng = np.random.default_rng(5)
    return np.cumsum(rng.exponential(4.0, n)), np.maximum(rng.exponential(50.0, n), 0.5)


def test_gamma_model_stays_a_law_over_a_long_chunk():
    m = filters.GammaModel(1.0, -math.log(35.0), 0.5, 560.0)
    mean, _ = m.run(*long_signal())
    assert np.isfinite(mean).all() and np.array_equal(m.c, m.c.T) and np.linalg.eigvalsh(m.c)[0] > 0


def test_gamma_model_far_from_the_readings():
    # Means beyond the range of doubles are kept within the series' bounds.
    for level in (-2000.0, 2000.0):
        m = filters.GammaModel(1e4, level, 10.0, 90.0)
        mean, _ = m.run(*signal())
        assert ((mean >= 10) & (mean <= 90)).all() and np.isfinite(m.loglik)


def test_gamma_model_looks_back_over_a_long_chunk(monkeypatch):
    t, v = long_signal()
    found = []
    for mark in (1024, 50_000):
        monkeypatch.setattr(filters, "MARK", mark)
        m = filters.GammaModel(1.0, -math.log(35.0), 0.5, 560.0)
        m.run(t, v)
        found.append(m.look_back())
    assert np.isfinite(found[0]).all() and np.array_equal(*found)


def test_gamma_model_forecasts_after_a_long_chunk():
    m = filters.GammaModel(1.0, -math.log(35.0), 0.5, 560.0)
    m.run(*long_signal())
    mean, q = m.forecast(6, samples=1000)
    assert ((mean > 20) & (mean < 120)).all() and (q[0] < q[1]).all() and (q[1] < q[2]).all()


def test_detectors_find_a_jump():
    rng = np.random.default_rng(0)
    v = np.r_[rng.normal(40, 1, 60), rng.normal(60, 1, 60)]
    t = np.arange(120) * 10.0
    assert 60 in changes.kernel_breaks(v)
    assert changes.kcp(t, v)[0][60] == "shift"
    assert changes.hmm(t, v)[0][60] == "shift"
    assert (changes.bocpd(t, v)[1] == 1 / 150).all()
    types, p = changes.bocpd_run_length(t, v)
    assert p[59] < 0.5 < p[62] and "shift" in types[60:70]
    flat = np.full(30, 5.0)
    for f in (changes.kcp, changes.hmm, changes.kalman, changes.bocpd, changes.bocpd_run_length):
        types, degrees = f(t[:30], flat)
        assert len(types) == 30 and np.isfinite(degrees).all()
        assert len(f(t[:1], flat[:1])[0]) == 1


def test_chain_by_stretches_is_the_chain():
    rng = np.random.default_rng(7)
    like, move, start = rng.uniform(0, 1, (2003, 2)) ** 9, np.array([[0.9, 0.1], [0.3, 0.7]]), np.array([0.2, 0.8])
    got = changes._by_stretches(like, move, start)
    forward = np.empty((2003, 2))
    for i in range(2003):
        p = (forward[i - 1] @ move if i else start) * like[i]
        forward[i] = p / p.sum()
        assert got[2][i] == pytest.approx(p.sum(), rel=1e-9)
    back = np.ones(2)
    for i in range(2002, -1, -1):
        assert got[0][i] == pytest.approx(forward[i], abs=1e-12) and got[1][i] == pytest.approx(back, rel=1e-9)
        back = move @ (like[i] * back) / got[2][i]
    path, ways = changes._likeliest(np.log(like[:10]), move, start), {}
    for bits in range(1024):
        s = [bits >> i & 1 for i in range(10)]
        ways[tuple(s)] = np.log(start[s[0]]) + sum(np.log(move[a, b]) for a, b in zip(s, s[1:])) + sum(np.log(like[i, a]) for i, a in enumerate(s))
    assert tuple(path) == max(ways, key=ways.get)


def test_two_state_annotation_of_a_long_segment_is_by_stretches(monkeypatch):
    calls, whole = [], changes._by_stretches
    monkeypatch.setattr(changes, "_by_stretches", lambda *a: calls.append(1) or whole(*a))
    rng = np.random.default_rng(9)
    v = np.r_[rng.normal(40, 1, 1500), rng.normal(60, 1, 1500)]
    long = changes.hmm(np.arange(3000.0), v)
    monkeypatch.setattr(changes, "LONG", 10**9)
    plain = changes.hmm(np.arange(3000.0), v)
    assert calls and (long[0] == plain[0]).all() and long[1] == pytest.approx(plain[1], abs=1e-9)


def test_kernel_breaks_are_the_cheapest():
    rng = np.random.default_rng(4)
    v = np.r_[rng.normal(0, 1, 7), rng.normal(4, 1, 6), rng.normal(0, 1, 5)]
    n, least, pen = len(v), 3, 4.0
    d = np.subtract.outer(v, v) ** 2
    k = np.exp(-np.clip(d / np.median(d[np.triu_indices(n, 1)]), 1e-2, 1e2))
    np.fill_diagonal(k, 1)
    cost = lambda a, b: (b - a) - k[a:b, a:b].sum() / (b - a)
    best = [0.0, *[np.inf] * n]
    cut = [0] * (n + 1)
    best[0] = -pen
    for e in range(least, n + 1):
        for s in [0, *range(least, e - least + 1)]:
            if e - s >= least and best[s] + cost(s, e) + pen < best[e]:
                best[e], cut[e] = best[s] + cost(s, e) + pen, s
    want, at = [], n
    while cut[at]:
        at = cut[at]
        want.append(at)
    assert changes.kernel_breaks(v, pen, least) == want[::-1]


def test_kernel_breaks_look_back_to_the_oldest_open_start_only(monkeypatch):
    v = np.repeat(np.random.default_rng(8).permutation(200) * 1.0, 20)
    seen, cut = [], np.cumsum
    monkeypatch.setattr(changes.np, "cumsum", lambda x: seen.append(len(x)) or cut(x))
    assert changes.kernel_breaks(v)
    # From the first row on it was half of all pairs, 8 million.
    assert sum(seen) < 1e6


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 50, 51, 2500])
def test_kernel_scale_is_the_median_of_all_pairs(n):
    rng = np.random.default_rng(n)
    # The first 2000 rows differ from the rest in level and variance; there are ties.
    for v in (np.r_[rng.normal(40, 1, n), rng.normal(90, 20, n // 2)], np.round(rng.normal(0, 2, n)), np.full(n, 5.0)):
        d = np.subtract.outer(v, v)[np.triu_indices(len(v), 1)] ** 2
        assert changes.median_squared_distance(v) == (np.median(d) if len(d) else 0.0)


def test_breaks_see_the_scale_of_the_whole_chunk():
    rng = np.random.default_rng(0)
    v = np.r_[rng.normal(40, 100, 2000), rng.normal(40, 0.3, 2500), rng.normal(44, 0.3, 2500)]
    # At the scale of the first 2000 rows the step of four is none.
    assert any(abs(at - 4500) < 3 for at in changes.kernel_breaks(v))


def test_welch_keeps_variance_and_finds_the_period():
    rng = np.random.default_rng(1)
    x = np.sin(2 * np.pi * np.arange(2880) / 144) + 0.1 * rng.normal(size=2880)
    f, p = spectra.welch(x, 0.1, 288)
    assert p.sum() * (f[1] - f[0]) == pytest.approx(x.var(), rel=0.1)
    assert spectra.spectrum(x)["dominant_hours"] == pytest.approx(24, rel=0.01)
    assert spectra.spectrum(x)["pct_circadian"] > 50


def test_distribution_tests():
    rng = np.random.default_rng(2)
    normal, two, walk = rng.normal(size=800), np.r_[rng.normal(-4, 1, 400), rng.normal(4, 1, 400)], np.cumsum(rng.normal(size=800))
    assert spectra.kde_modes(normal) == 1 and spectra.kde_modes(two) == 2
    assert not spectra.gmm_delta_bic(normal)["bimodal"] and spectra.gmm_delta_bic(two)["mode_gap"] == pytest.approx(8, abs=0.4)
    assert spectra.adf(normal) < 0.01 < 0.1 < spectra.adf(walk)
    assert spectra.shapiro(normal)[1] > 0.01 and spectra.shapiro(two)[1] < 1e-6


def test_unit_root_regression_is_held_some_rows_at_a_time(monkeypatch):
    import tracemalloc

    walk = np.cumsum(np.random.default_rng(6).normal(size=60_000))
    tracemalloc.start()
    p = spectra.adf(walk)
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # The whole regression has 62 columns of 60,000 doubles, 30 MB.
    assert held < 10e6 and 0.01 < p < 1
    monkeypatch.setattr(spectra, "ADF_ROWS", 10**6)
    assert spectra.adf(walk) == pytest.approx(p, abs=1e-9)


def test_kernel_breaks_of_a_smoothed_segment_stay_near(monkeypatch):
    z = np.log(np.repeat(np.random.default_rng(10).exponential(50, 150) + 1, 30))
    v = np.exp(filters.smooth_switching(np.repeat(np.arange(150.0), 30) * 5, z - z.mean(), [-0.5, 0.5], [0.01, 0.01], [0.05, 0.05], 5.0))
    seen, cut = [], np.cumsum
    monkeypatch.setattr(changes.np, "cumsum", lambda x: seen.append(len(x)) or cut(x))
    assert changes.kernel_breaks(v) and sum(seen) < 2e6  # of 10 million pairs


def test_unit_root_of_a_smoothed_series_solves_small_systems_only(monkeypatch):
    z = np.random.default_rng(11).normal(size=5000)
    x = np.exp(3.7 + filters.smooth_switching(np.arange(5000) * 10.0, z, [-0.5, 0.5], [0.01, 0.01], [0.05, 0.05], 10.0))
    rows, solve = [], np.linalg.lstsq
    monkeypatch.setattr(spectra.np.linalg, "lstsq", lambda a, y, rcond: rows.append(len(a)) or solve(a, y, rcond=rcond))
    assert 0 <= spectra.adf(x) <= 1 and max(rows) < 50


def test_median_distance_is_searched_once_if_both_middle_ones_are_equal(monkeypatch):
    v = np.repeat([0.0, 1.0, 3.0], 8)  # an even number of pairs
    d = np.sort([(a - b) ** 2 for i, a in enumerate(v) for b in v[:i]])
    assert d[len(d) // 2 - 1] == d[len(d) // 2] and len(d) % 2 == 0
    calls, search = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda *a, **b: calls.append(1) or search(*a, **b))
    assert changes.median_squared_distance(v) == d[len(d) // 2]
    assert len(calls) < 100  # one search over the bits of a double takes 62, and more for ties


def test_kernel_breaks_take_few_numpy_calls_a_row(monkeypatch):
    v = np.random.default_rng(5).normal(size=300) + np.repeat([0.0, 6.0, 0.0], 100)
    seen, clip = [], np.clip
    monkeypatch.setattr(np, "clip", lambda *a, **b: seen.append(1) or clip(*a, **b))
    assert changes.kernel_breaks(v) == [100, 200] and len(seen) < 300
    assert changes.kernel_breaks(np.repeat([0, 6, 0], 20)) == [20, 40]


def test_unit_root_passes_over_a_long_series_once(monkeypatch):
    """All lags, and the fit of the best, come from one triangle; the best is the one that least squares finds lag by lag."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=3000).cumsum() + np.sin(np.arange(3000) / 7)
    plain, rows = np.linalg.qr, []
    monkeypatch.setattr(spectra, "ADF_ROWS", 500)
    monkeypatch.setattr(np.linalg, "qr", lambda a, mode: (rows.append(len(a)), plain(a, mode=mode))[1])
    p = spectra.adf(x)
    assert len(rows) <= 7  # six blocks of 500 rows and the few rows that fewer lags have more
    d, most = np.diff(x), 29

    def least(k, skip):
        at = np.arange(skip, len(d))
        a = np.column_stack([np.ones(len(at)), x[at], *[d[at - j] for j in range(1, k + 1)]])
        coef = np.linalg.lstsq(a, d[at], rcond=None)[0]
        return a, coef, float(((d[at] - a @ coef) ** 2).sum())

    n = len(d) - most
    lags = min((n * np.log(least(k, most)[2] / n) + 2 * (k + 2), k) for k in range(most + 1))[1]
    a, coef, rss = least(lags, lags)
    stat = coef[1] / np.sqrt(rss / (len(a) - lags - 2) * np.linalg.inv(a.T @ a)[1, 1])
    poly = (2.1659, 1.4412, 0.038269) if stat <= -1.61 else (1.7339, 0.93202, -0.12745, -0.010368)
    from statistics import NormalDist

    assert p == pytest.approx(NormalDist().cdf(sum(c * stat**i for i, c in enumerate(poly))), abs=1e-9)


def _pairs(monkeypatch):
    """Sizes of the arrays whose exponentials are taken from now on."""
    seen, exp = [], np.exp
    monkeypatch.setattr(changes.np, "exp", lambda x, *a, **b: seen.append(np.size(x)) or exp(x, *a, **b))
    return seen


def test_kernel_breaks_without_a_change_do_not_take_all_pairs(monkeypatch):
    v = np.round(np.random.default_rng(12).exponential(50, 12_000), 2)
    seen = _pairs(monkeypatch)
    assert changes.kernel_breaks(v) == []
    assert sum(seen) < 3e7  # of 72 million pairs, and in proportion to the rows


def test_kernel_breaks_take_pairs_of_the_open_reach_only(monkeypatch):
    v = np.repeat(np.random.default_rng(8).permutation(200) * 1.0, 20)
    seen = _pairs(monkeypatch)
    assert changes.kernel_breaks(v) and sum(seen) < 1e6  # of 8 million pairs


def test_kernel_breaks_make_the_sums_of_many_rows_at_once(monkeypatch):
    v = np.random.default_rng(5).normal(size=300) + np.repeat([0.0, 6.0, 0.0], 100)
    seen = _pairs(monkeypatch)
    assert changes.kernel_breaks(v) == [100, 200] and len(seen) < 30


@pytest.mark.parametrize("near", [16, 100, 400])
@pytest.mark.parametrize("kind", ["none", "steps", "small steps", "integers", "heavy", "walk", "constant", "runs"])
def test_kernel_breaks_are_the_same_with_starts_in_groups(monkeypatch, near, kind):
    rng = np.random.default_rng(13)
    v = {
        "none": rng.exponential(50, 2000),
        "steps": rng.normal(size=2000) + np.repeat([0.0, 2.0, 1.0, -1.0], 500),
        "small steps": rng.normal(size=2000) + np.repeat([0.0, 0.4, -0.2, 0.1], 500),
        "integers": rng.integers(0, 6, 2000) * 1.0,
        "heavy": rng.standard_t(2, 2000),
        "walk": np.cumsum(rng.normal(size=2000)) * 0.02 + rng.normal(size=2000),
        "constant": np.full(700, 3.0),
        "runs": np.r_[rng.exponential(50, 900), np.repeat(rng.exponential(50, 30), 30)],
    }[kind]
    monkeypatch.setattr(changes, "NEAR", 10**9)
    want = changes.kernel_breaks(v)
    monkeypatch.setattr(changes, "NEAR", near)
    assert changes.kernel_breaks(v) == want


def test_kernel_sums_are_those_of_the_pairs():
    rng = np.random.default_rng(14)
    for v in (rng.exponential(50, 1200), rng.normal(size=1200), rng.integers(0, 5, 1200) * 0.1):
        scale = changes.median_squared_distance(v)
        k = np.exp(-np.clip(np.subtract.outer(v, v) ** 2 / scale, 1e-2, 1e2))
        got = changes._KernelSums(v, scale).at([0, 1, 8, 600, 1000], slice(1000, 1200))
        want = [k[a:b, 1000:].sum(axis=0) for a, b in ((0, 1), (1, 8), (8, 600), (600, 1000))]
        assert np.abs(got - want).max() < 1e-9


def test_two_state_chain_takes_few_steps_of_its_stretches(monkeypatch):
    like = np.random.default_rng(15).uniform(0.1, 1, (40_000, 2))
    steps, maximum = [], np.maximum
    monkeypatch.setattr(changes.np, "maximum", lambda *a, **b: steps.append(1) or maximum(*a, **b))
    alpha, beta, scale = changes._forward_backward(like, np.array([[0.9, 0.1], [0.2, 0.8]]), np.full(2, 0.5))
    assert len(steps) <= 50  # the root of the rows was 200
    assert alpha[:, 0].flags.c_contiguous and (alpha * beta).sum(axis=1) == pytest.approx(np.ones(40_000))
