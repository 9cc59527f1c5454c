"""Tests and forecasts of time series against numpy, cut into many stretches."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import forecasting as FC
from quarry.operators import timeseries as TS

DAY0 = dt.datetime(2023, 5, 3)


def series(kind, n, seed):
    rng = np.random.default_rng(seed)
    e = rng.standard_normal(n)
    if kind == "walk":
        return 1e6 + np.cumsum(e)
    if kind == "ar":
        y = np.zeros(n)
        for t in range(1, n):
            y[t] = 0.5 * y[t - 1] + e[t]
        return y
    t = np.arange(n)
    return 50 + 0.3 * t + 4 * np.sin(2 * np.pi * t / 7) + 6 * np.cos(2 * np.pi * t / 365.25) + e


DATA = {"walk": series("walk", 230, 1), "ar": series("ar", 180, 2), "wave": series("wave", 400, 3), "short": series("ar", 25, 4)}


@pytest.fixture(params=[1024, 26], ids=["whole", "cut"])
def numbered(spark, request, monkeypatch):
    monkeypatch.setattr(FC, "CHUNK", request.param)
    monkeypatch.setattr(FC, "FOLD", 4 if request.param < 100 else 4096)
    rows = [(k, DAY0 + dt.timedelta(days=i), float(v)) for k, y in DATA.items() for i, v in enumerate(y)]
    rows += [("ar", DAY0 + dt.timedelta(hours=1), None), ("ar", None, 3.0), ("ar", DAY0 + dt.timedelta(hours=2), float("nan"))]
    rows += [("one", DAY0, 5.0), ("flat", DAY0, 2.0), *(("flat", DAY0 + dt.timedelta(days=i), 2.0) for i in range(1, 40))]
    return FC.numbered(spark.createDataFrame(rows, "series string, ts timestamp_ntz, value double").repartition(3))


def smooth(y, a, b):
    """(sse, level, trend) with the best start."""
    y = y - y.mean()
    m, c, rows, rest = np.eye(2), np.zeros(2), [], []
    step, gain = np.array([[1 - a, 1 - a], [-a * b, 1 - a * b]]), np.array([a, a * b])
    for v in y:
        rows.append(m.sum(axis=0))
        rest.append(v - c.sum())
        m, c = step @ m, step @ c + gain * v
    s, *_ = np.linalg.lstsq(np.array(rows), np.array(rest), rcond=None)
    return float(((np.array(rest) - np.array(rows) @ s) ** 2).sum()), *(m @ s + c)


def search(y, rounds):
    best, step = (None, 0.5, 0.5), 0.2
    for _ in range(rounds):
        tried = {(min(max(round(best[1] + i * step, 6), 0.01), 0.99), min(max(round(best[2] + j * step, 6), 0.01), 0.99))
                 for i in range(-2, 3) for j in range(-2, 3)}
        best = min((smooth(y, a, b)[0], a, b) for a, b in tried)
        step /= 2
    return best


def test_smoothing(numbered):
    got = {r.series: r for r in FC.fit_smoothing(numbered, 3).collect()}
    for k, y in DATA.items():
        sse, a, b = search(y, 3)
        _, level, trend = smooth(y, a, b)
        assert (got[k].alpha, got[k].beta) == (a, b) and got[k].n == len(y)
        assert np.allclose([got[k].sse, got[k].level, got[k].trend], [sse, level + y.mean(), trend], rtol=1e-6, atol=1e-6)
    assert got["one"].level is None and abs(got["flat"].level - 2) < 1e-9 and abs(got["flat"].trend) < 1e-9
    ahead = FC.smoothing_forecast(FC.fit_smoothing(numbered, 1), 3).where("series = 'wave'").orderBy("step").collect()
    assert [r.step for r in ahead] == [1, 2, 3] and ahead[2].forecast - ahead[1].forecast == pytest.approx(ahead[1].forecast - ahead[0].forecast)


def design(days, start, yearly, weekly):
    cols = [np.ones(len(days)), days - start]
    for period, kk in ((365.25, yearly), (7.0, weekly)):
        for k in range(1, kk + 1):
            cols += [np.sin(2 * np.pi * k / period * days), np.cos(2 * np.pi * k / period * days)]
    return np.stack(cols, axis=1)


@pytest.mark.parametrize("yearly, weekly, ridge", [(0, 0, 0.0), (0, 2, 0.0), (3, 3, 1e-3)])
def test_seasons(numbered, yearly, weekly, ridge):
    fit = FC.fit_seasons(numbered, yearly, weekly, ridge)
    got = {(r.series, r.step): r for r in FC.seasons_forecast(fit, 5, yearly, weekly).collect()}
    start = (DAY0 - dt.datetime(1970, 1, 1)).days
    for k, y in DATA.items():
        if k == "short" and weekly:
            continue
        n = len(y)
        x = design(start + np.arange(n + 5.0), start, yearly, weekly)
        pen = np.diag([0, 0, *[ridge * n] * (x.shape[1] - 2)])
        inv = np.linalg.inv(x[:n].T @ x[:n] + pen)
        coef = inv @ x[:n].T @ (y - y.mean())
        sigma = np.sqrt(((y - y.mean() - x[:n] @ coef) ** 2).sum() / (n - x.shape[1]))
        for h in range(1, 6):
            r, row = got[k, h], x[n + h - 1]
            assert r.ts == DAY0 + dt.timedelta(days=n + h - 1)
            spread = 1.959963984540054 * sigma * np.sqrt(1 + row @ inv @ row)
            assert np.allclose([r.forecast, r.upper - r.forecast, r.forecast - r.lower], [row @ coef + y.mean(), spread, spread], rtol=1e-6)


def dickey_fuller(y, p, first):
    d = np.diff(y)
    rows = np.arange(first, len(y))
    x = np.stack([np.ones(len(rows)), y[rows - 1], *(d[rows - 1 - k] for k in range(1, p + 1))], axis=1)
    t = d[rows - 1]
    inv = np.linalg.inv(x.T @ x)
    coef = inv @ x.T @ t
    ssr = ((t - x @ coef) ** 2).sum()
    aic = len(rows) * (np.log(2 * np.pi * ssr / len(rows)) + 1) + 2 * (p + 2)
    return coef[1] / np.sqrt(ssr / (len(rows) - p - 2) * inv[1, 1]), aic


def test_stationarity(numbered):
    got = {r.series: r for r in FC.stationarity(numbered).collect()}
    for k, y in DATA.items():
        z = y - y.mean()
        most = min(int(np.ceil(12 * (len(y) / 100) ** 0.25)), len(y) // 2 - 2)
        lag = min(range(most + 1), key=lambda p: (dickey_fuller(z, p, most + 1)[1], p))
        assert got[k].lags == lag and got[k].nobs == len(y) - lag - 1
        assert got[k].statistic == pytest.approx(dickey_fuller(z, lag, lag + 1)[0], rel=1e-6)
    assert not got["walk"].stationary and got["walk"].p_value > 0.05 and got["ar"].stationary
    assert got["flat"].statistic is None and got["flat"].stationary is None
    assert got["one"].statistic is None and got["one"].nobs == 0
    fixed = {r.series: r.statistic for r in FC.stationarity(numbered, lag=2).collect()}
    assert fixed["ar"] == pytest.approx(dickey_fuller(DATA["ar"], 2, 3)[0], rel=1e-8)


def test_p_values_at_published_critical_points(spark):
    from quarry.functions import dist
    t = spark.createDataFrame([(-3.43035, 0.01), (-2.86154, 0.05), (-2.56677, 0.10)], "t double, p double")
    small = sum((F.lit(a) * F.pow("t", F.lit(k)) for k, a in enumerate(FC.TAIL_SMALL)), F.lit(0.0))
    for r in t.select("p", dist.norm_sf_col(-small).alias("q")).collect():
        assert r.q == pytest.approx(r.p, rel=0.03)


def arima(y, lags):
    w = np.diff(y)
    t = np.arange(lags, len(w))
    a, *_ = np.linalg.lstsq(np.stack([w[t - k] for k in range(1, lags + 1)], axis=1), w[t], rcond=None)
    t = np.arange(lags + 1, len(w))
    e = w[t - 1] - sum(a[k - 1] * w[t - 1 - k] for k in range(1, lags + 1))
    (phi, theta), *_ = np.linalg.lstsq(np.stack([w[t - 1], e], axis=1), w[t], rcond=None)
    phi, theta = np.clip([phi, theta], -0.99, 0.99)
    out, s = [], 0.0
    for k in range(1, len(w)):
        s = w[k] - phi * w[k - 1] - theta * s
        out.append(s)
    return phi, theta, np.array(out), w[-1]


def ahead(y, phi, theta, e, last, steps):
    out, v, f = [], y[-1], phi * last + theta * e[-1]
    for _ in range(steps):
        v, f = v + f, phi * f
        out.append(v)
    return np.array(out)


def test_arima(numbered):
    fit, residuals = FC.fit_arima(numbered, 4)
    got = {r.series: r for r in fit.collect()}
    f = {(r.series, r.step): r for r in FC.arima_forecast(fit, 6).collect()}
    res = {}
    for r in residuals.orderBy("series", "pos").collect():
        res.setdefault(r.series, []).append(r.residual)
    for k, y in DATA.items():
        phi, theta, e, last = arima(y, 4)
        g, n = got[k], len(e)
        s2 = (e ** 2).mean()
        want = [phi, theta, s2, abs(e).mean(), n * (np.log(2 * np.pi * s2) + 1) + 6, n * (np.log(2 * np.pi * s2) + 1) + 3 * np.log(n)]
        assert np.allclose([g.phi, g.theta, g.sigma2, g.mae, g.aic, g.bic], want, rtol=1e-6) and g.n == len(y)
        assert np.allclose(res[k], e, rtol=1e-6, atol=1e-8)
        assert np.allclose([f[k, h].forecast for h in range(1, 7)], ahead(y, phi, theta, e, last, 6), rtol=1e-8)
        move = np.cumsum([1, *((phi + theta) * phi ** j for j in range(5))])
        spread = 1.959963984540054 * np.sqrt(s2 * np.cumsum(move ** 2))
        assert np.allclose([f[k, h].upper - f[k, h].forecast for h in range(1, 7)], spread, rtol=1e-6)
    assert "flat" not in got and "one" not in got


def test_compare(numbered):
    got = {(r.series, r.model): r for r in FC.compare(numbered, long_lags=4, rounds=2).collect()}
    for k, y in DATA.items():
        n = int(len(y) * (1 - 0.2))
        train, test = y[:n], y[n:]
        _, a, b = search(train, 2)
        _, level, trend = smooth(train, a, b)
        want = {"Exponential Smoothing": test - level - train.mean() - trend * np.arange(1, len(test) + 1),
                "ARIMA": test - ahead(train, *arima(train, 4), len(test))}
        for m, e in want.items():
            assert np.allclose([got[k, m].mae, got[k, m].rmse], [abs(e).mean(), np.sqrt((e ** 2).mean())], rtol=1e-6)
            assert got[k, m].best == (m == min(want, key=lambda w: abs(want[w]).mean()))


def test_decomposition_of_a_cut_series(spark, numbered):
    got = {(r.series, r.ts): r for r in TS.decompose(numbered.select("series", "ts", "value"), 12).collect()}
    y = DATA["wave"]
    kernel = np.array([0.5, *[1] * 11, 0.5]) / 12
    trend = np.convolve(y, kernel, "valid")
    phase = np.array([np.mean([y[i] - trend[i - 6] for i in range(6, len(y) - 6) if i % 12 == p]) for p in range(12)])
    for i in range(len(y)):
        r = got["wave", DAY0 + dt.timedelta(days=i)]
        assert (r.trend is None) == (i < 6 or i >= len(y) - 6)
        assert r.seasonal == pytest.approx(phase[i % 12] - phase.mean(), abs=1e-8)
        if r.trend is not None:
            assert r.trend == pytest.approx(trend[i - 6]) and r.trend + r.seasonal + r.resid == pytest.approx(r.observed)


def test_empty_table(spark):
    x = FC.numbered(spark.createDataFrame([], "series string, ts timestamp_ntz, value double"))
    assert FC.fit_smoothing(x, 1).collect() == [] and FC.stationarity(x).collect() == [] and FC.compare(x, rounds=1).collect() == []
    assert FC.fit_seasons(x).collect() == [] and FC.fit_arima(x)[0].collect() == []


def test_stationary_flag_of_a_repeating_series(spark):
    rows = [("s", DAY0 + dt.timedelta(days=i), v) for i, v in enumerate([1.0, 1.1, 0.9, 1.05, 0.95] * 20)]
    got = FC.stationarity(FC.numbered(spark.createDataFrame(rows, "series string, ts timestamp_ntz, value double"))).collect()
    assert len(got) == 1 and "stationary" in got[0].asDict()
