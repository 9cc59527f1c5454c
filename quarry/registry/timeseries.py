"""Registry entries: time series."""

from __future__ import annotations

from quarry.operators import forecasting as FC
from quarry.operators import timeseries as TS
from quarry.registry.common import r, round_all, t

Q: dict = {}
SQL: dict = {}


def q(name, sql=None):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


@q("ts_prepare", """
SELECT 'all' AS series, o_orderdate AS ts, o_totalprice AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY o_orderdate ORDER BY o_orderkey) AS rn FROM orders
  WHERE o_orderdate IS NOT NULL) WHERE rn = 1 AND o_totalprice IS NOT NULL""")
def ts_prepare(spark, sf):
    return TS.prepare(t(spark, sf, "orders"), "o_orderdate", "o_totalprice", ["o_orderkey"])


def _event_grid(spark, sf):
    """Daily value totals per event type: one series per type."""
    return TS.to_grid(t(spark, sf, "events"), "ts", "value", series="event_type")


@q("ts_decompose", """
WITH g AS (SELECT event_type AS series, date_trunc('day', ts) AS ts, sum(value) AS value FROM events
           WHERE ts IS NOT NULL GROUP BY 1, 2),
p AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts) - 1 AS pos FROM g),
w AS (SELECT *, CASE WHEN count(value) OVER (PARTITION BY series ORDER BY pos ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) = 13
          THEN (sum(value) OVER (PARTITION BY series ORDER BY pos ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)
                - 0.5 * (lag(value, 6) OVER (PARTITION BY series ORDER BY pos) + lead(value, 6) OVER (PARTITION BY series ORDER BY pos))) / 12
          END AS trend, pos % 12 AS phase FROM p),
ph AS (SELECT series, phase, avg(value - trend) AS pm FROM w GROUP BY 1, 2),
s AS (SELECT series, phase, pm - avg(pm) OVER (PARTITION BY series) AS seasonal FROM ph)
SELECT w.series, w.ts, round(value, 8) AS observed, round(trend, 8) AS trend, round(seasonal, 8) AS seasonal,
       round(value - trend - seasonal, 8) AS resid
FROM w JOIN s ON w.series = s.series AND w.phase = s.phase""")
def ts_decompose(spark, sf):
    # 8 digits: the parts are short exact decimals (cents / 12, / 24), so 6
    # digits can land exactly on a rounding tie decided by summation order
    return round_all(TS.decompose(_event_grid(spark, sf), 12), 8)


# ---- T3-T7: daily totals per event type, numbered; the SQL solves the same
# regressions by hand and runs the recursions row by row ----------------------

_GRID = """g AS (SELECT event_type AS series, date_trunc('day', ts) AS ts, sum(value) AS value FROM events
           WHERE ts IS NOT NULL GROUP BY 1, 2 HAVING sum(value) IS NOT NULL),
x AS (SELECT series, ts, value, row_number() OVER (PARTITION BY series ORDER BY ts) - 1 AS pos,
             count(*) OVER (PARTITION BY series) AS n FROM g)"""


def _numbered(spark, sf):
    return FC.numbered(_event_grid(spark, sf))


def _smoothing_sql(src: str, rounds: int) -> str:
    """CTEs ending in ``smooth``: the grid search of ``fit_smoothing``, every
    candidate run by a recursive query."""
    out = [f"""c AS (SELECT series, pos, value - avg(value) OVER (PARTITION BY series) AS y,
                            avg(value) OVER (PARTITION BY series) AS mean, count(*) OVER (PARTITION BY series) AS n FROM {src}),
b0 AS (SELECT DISTINCT series, 0.5::DOUBLE AS alpha, 0.5::DOUBLE AS beta FROM c)"""]
    for r in range(1, rounds + 1):
        step = 0.2 / 2 ** (r - 1)
        around = "least(greatest(round({0} + k * CAST({1} AS DOUBLE), 6), 0.01), 0.99)"
        out.append(f"""cand{r} AS (SELECT DISTINCT b.series, a.alpha, d.beta FROM b{r - 1} b,
  LATERAL (SELECT {around.format('b.alpha', step)} AS alpha FROM range(-2, 3) t(k)) a,
  LATERAL (SELECT {around.format('b.beta', step)} AS beta FROM range(-2, 3) t(k)) d),
run{r} AS (
  SELECT series, alpha, beta, CAST(-1 AS BIGINT) AS pos, 1::DOUBLE AS m11, 0::DOUBLE AS m12, 0::DOUBLE AS m21, 1::DOUBLE AS m22,
         0::DOUBLE AS c1, 0::DOUBLE AS c2, 0::DOUBLE AS q11, 0::DOUBLE AS q12, 0::DOUBLE AS q22, 0::DOUBLE AS l1, 0::DOUBLE AS l2, 0::DOUBLE AS k
  FROM cand{r}
  UNION ALL
  SELECT r.series, alpha, beta, c.pos, (1 - alpha) * (m11 + m21), (1 - alpha) * (m12 + m22),
         (1 - alpha * beta) * m21 - alpha * beta * m11, (1 - alpha * beta) * m22 - alpha * beta * m12,
         (1 - alpha) * (c1 + c2) + alpha * y, (1 - alpha * beta) * c2 - alpha * beta * c1 + alpha * beta * y,
         q11 + (m11 + m21) ** 2, q12 + (m11 + m21) * (m12 + m22), q22 + (m12 + m22) ** 2,
         l1 + (y - c1 - c2) * (m11 + m21), l2 + (y - c1 - c2) * (m12 + m22), k + (y - c1 - c2) ** 2
  FROM run{r} r JOIN c ON c.series = r.series AND c.pos = r.pos + 1),
end{r} AS (SELECT r.*, (q22 * l1 - q12 * l2) / (q11 * q22 - q12 * q12) AS s1, (q11 * l2 - q12 * l1) / (q11 * q22 - q12 * q12) AS s2
           FROM run{r} r JOIN c ON c.series = r.series AND c.pos = r.pos WHERE r.pos = c.n - 1),
b{r} AS (SELECT * FROM (SELECT *, k - l1 * s1 - l2 * s2 AS sse FROM end{r})
         QUALIFY row_number() OVER (PARTITION BY series ORDER BY sse, alpha, beta) = 1)""")
    out.append(f"""smooth AS (SELECT b.series, c.n, alpha, beta, sse, m11 * s1 + m12 * s2 + c1 + c.mean AS level, m21 * s1 + m22 * s2 + c2 AS trend
           FROM b{rounds} b JOIN c ON c.series = b.series AND c.pos = 0)""")
    return ",\n".join(out)


def _arima_sql(src: str) -> str:
    """CTEs ending in ``arima``: both regressions by Cramer's rule (two long
    lags), the shocks by a recursive query."""
    return f"""w AS (SELECT *, value - lag(value) OVER s AS w0 FROM {src} WINDOW s AS (PARTITION BY series ORDER BY pos)),
v AS (SELECT *, lag(w0, 1) OVER s AS w1, lag(w0, 2) OVER s AS w2, lag(w0, 3) OVER s AS w3 FROM w
      WINDOW s AS (PARTITION BY series ORDER BY pos)),
long AS (SELECT series, (sum(w2 * w2) * sum(w0 * w1) - sum(w1 * w2) * sum(w0 * w2)) / (sum(w1 * w1) * sum(w2 * w2) - sum(w1 * w2) ** 2) AS a1,
                (sum(w1 * w1) * sum(w0 * w2) - sum(w1 * w2) * sum(w0 * w1)) / (sum(w1 * w1) * sum(w2 * w2) - sum(w1 * w2) ** 2) AS a2
         FROM v WHERE pos >= 3 GROUP BY series),
h AS (SELECT v.series, w0, w1, w1 - a1 * w2 - a2 * w3 AS e FROM v JOIN long USING (series) WHERE pos >= 4),
pt AS (SELECT series, least(greatest((sum(e * e) * sum(w0 * w1) - sum(w1 * e) * sum(w0 * e)) / (sum(w1 * w1) * sum(e * e) - sum(w1 * e) ** 2), -0.99), 0.99) AS phi,
              least(greatest((sum(w1 * w1) * sum(w0 * e) - sum(w1 * e) * sum(w0 * w1)) / (sum(w1 * w1) * sum(e * e) - sum(w1 * e) ** 2), -0.99), 0.99) AS theta
       FROM h GROUP BY series),
shock AS (SELECT series, CAST(1 AS BIGINT) AS pos, phi, theta, 0::DOUBLE AS e FROM pt
  UNION ALL
  SELECT s.series, v.pos, phi, theta, w0 - phi * w1 - theta * e FROM shock s JOIN v ON v.series = s.series AND v.pos = s.pos + 1),
arima AS (SELECT s.series, any_value(phi) AS phi, any_value(theta) AS theta, count(*) AS nobs, avg(e * e) AS sigma2, avg(abs(e)) AS mae,
                 arg_max(value, v.pos) AS last_value, arg_max(w0, v.pos) AS last_step, arg_max(e, v.pos) AS last_shock, count(*) + 2 AS n
          FROM shock s JOIN v ON v.series = s.series AND v.pos = s.pos WHERE s.pos >= 2 GROUP BY s.series)"""


_ARIMA_AT = "last_value + (phi * last_step + theta * last_shock) * (1 - phi ** step) / (1 - phi)"


@q("ts_smoothing", f"""
WITH RECURSIVE {_GRID}, {_smoothing_sql('x', 4)}
SELECT series, CAST(n AS BIGINT) AS n, round(alpha, 6) AS alpha, round(beta, 6) AS beta, round(sse, 2) AS sse, round(level, 4) AS level,
       round(trend, 4) AS trend FROM smooth""")
def ts_smoothing(spark, sf):
    fit = FC.fit_smoothing(_numbered(spark, sf))
    return fit.select("series", "n", r("alpha"), r("beta"), r("sse", 2).alias("sse"), r("level", 4).alias("level"),
                      r("trend", 4).alias("trend")).toDF("series", "n", "alpha", "beta", "sse", "level", "trend")


@q("ts_smoothing_forecast", f"""
WITH RECURSIVE {_GRID}, {_smoothing_sql('x', 4)}
SELECT series, CAST(step AS INTEGER) AS step, round(level + step * trend, 4) AS forecast FROM smooth, range(1, 31) t(step)""")
def ts_smoothing_forecast(spark, sf):
    return round_all(FC.smoothing_forecast(FC.fit_smoothing(_numbered(spark, sf))), 4)


def _ortho(new: str, basis: int) -> str:
    """A feature without its parts along the mean and the basis columns before."""
    parts = "".join(f" - o{k} * sum({new} * o{k}) FILTER (old) OVER s / sum(o{k} * o{k}) FILTER (old) OVER s" for k in range(1, basis + 1))
    return f"{new} - avg({new}) FILTER (old) OVER s{parts} AS o{basis + 1}"


@q("ts_seasons", f"""
WITH {_GRID},
f AS (SELECT series, ts, value, true AS old, NULL::INTEGER AS step FROM x UNION ALL
      SELECT series, max(ts) + to_days(CAST(step AS INTEGER)), NULL, false, CAST(step AS INTEGER) FROM x, range(1, 15) t(step) GROUP BY series, step),
f0 AS (SELECT *, epoch(ts) / 86400.0 AS f1, sin(2 * pi() * epoch(ts) / 86400.0 / 7) AS f2, cos(2 * pi() * epoch(ts) / 86400.0 / 7) AS f3 FROM f),
f1 AS (SELECT *, {_ortho('f1', 0)} FROM f0 WINDOW s AS (PARTITION BY series)),
f2 AS (SELECT *, {_ortho('f2', 1)} FROM f1 WINDOW s AS (PARTITION BY series)),
f3 AS (SELECT *, {_ortho('f3', 2)} FROM f2 WINDOW s AS (PARTITION BY series)),
fit AS (SELECT series, count(*) AS n, avg(value) AS m, {', '.join(f'sum(value * o{k}) / sum(o{k} * o{k}) AS g{k}, sum(o{k} * o{k}) AS z{k}' for k in (1, 2, 3))}
        FROM f3 WHERE old GROUP BY series),
err AS (SELECT series, sqrt(sum((value - m - g1 * o1 - g2 * o2 - g3 * o3) ** 2) / (count(*) - 4)) AS sigma FROM f3 JOIN fit USING (series) WHERE old GROUP BY series),
p AS (SELECT series, step, ts, m + g1 * o1 + g2 * o2 + g3 * o3 AS y, 1.959963984540054 * sigma * sqrt(1 + 1.0 / n + o1 * o1 / z1 + o2 * o2 / z2 + o3 * o3 / z3) AS d
      FROM f3 JOIN fit USING (series) JOIN err USING (series) WHERE NOT old)
SELECT series, step, ts, round(y, 4) AS forecast, round(y - d, 4) AS lower, round(y + d, 4) AS upper FROM p""")
def ts_seasons(spark, sf):
    fit = FC.fit_seasons(_numbered(spark, sf), yearly=0, weekly=1, ridge=0.0)
    return round_all(FC.seasons_forecast(fit, 14, yearly=0, weekly=1), 4)


@q("ts_trend", f"""
WITH {_GRID}, fit AS (SELECT series, max(ts) AS last, regr_slope(value, epoch(ts) / 86400.0) AS b, regr_intercept(value, epoch(ts) / 86400.0) AS a
                      FROM x GROUP BY series)
SELECT series, CAST(step AS INTEGER) AS step, round(a + b * (epoch(last) / 86400.0 + step), 4) AS forecast FROM fit, range(1, 31) t(step)""")
def ts_trend(spark, sf):
    fit = FC.fit_seasons(_numbered(spark, sf), yearly=0, weekly=0)
    return round_all(FC.seasons_forecast(fit, 30, yearly=0, weekly=0).select("series", "step", "forecast"), 4)


@q("ts_seasons_full")
def ts_seasons_full(spark, sf):
    """Trend, year and week together with the penalty: pytest compares it with numpy."""
    return round_all(FC.seasons_forecast(FC.fit_seasons(_numbered(spark, sf))), 4)


_TAIL = """0.5 + {0} / 6000.0 * list_sum(list_transform(range(0, 1001), lambda k:
    (CASE WHEN k IN (0, 1000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * exp(-0.5 * ({0} * k / 1000.0) ** 2))) * 2 / sqrt(2 * pi())"""


@q("ts_stationarity", f"""
WITH {_GRID},
d AS (SELECT series, pos, value - lag(value) OVER s AS w0, lag(value) OVER s AS lvl, lag(value) OVER s - lag(value, 2) OVER s AS w1
      FROM x WINDOW s AS (PARTITION BY series ORDER BY pos)),
s AS (SELECT series, regr_slope(lvl, w1) AS b1, regr_intercept(lvl, w1) AS a1, regr_slope(w0, w1) AS b2, regr_intercept(w0, w1) AS a2
      FROM d WHERE pos >= 2 GROUP BY series),
e AS (SELECT series, lvl - a1 - b1 * w1 AS rx, w0 - a2 - b2 * w1 AS ry FROM d JOIN s USING (series) WHERE pos >= 2),
f AS (SELECT series, count(*) AS nobs, sum(rx * ry) / sum(rx * rx) AS gamma, sum(rx * rx) AS xx, sum(ry * ry) - sum(rx * ry) ** 2 / sum(rx * rx) AS ssr
      FROM e GROUP BY series),
t AS (SELECT series, nobs, gamma / sqrt(ssr / (nobs - 3) / xx) AS t FROM f),
z AS (SELECT *, CASE WHEN t <= -1.61 THEN 2.1659 + 1.4412 * t + 0.038269 * t * t
                     ELSE 1.7339 + 0.93202 * t - 0.12745 * t * t - 0.010368 * t * t * t END AS z FROM t),
p AS (SELECT *, CASE WHEN t > 2.74 THEN 1 WHEN t < -18.83 THEN 0 ELSE {_TAIL.format('z')} END AS p FROM z)
SELECT series, round(t, 6) AS statistic, round(p, 6) AS p_value, 1 AS lags, CAST(nobs AS BIGINT) AS nobs,
       round(-3.43035 - 6.5393 / nobs - 16.786 / nobs ** 2 - 79.433 / nobs ** 3, 6) AS critical_1,
       round(-2.86154 - 2.8903 / nobs - 4.234 / nobs ** 2 - 40.04 / nobs ** 3, 6) AS critical_5,
       round(-2.56677 - 1.5384 / nobs - 2.809 / nobs ** 2, 6) AS critical_10, p < 0.05 AS stationary FROM p""")
def ts_stationarity(spark, sf):
    return round_all(FC.stationarity(_numbered(spark, sf), lag=1))


@q("ts_stationarity_aic")
def ts_stationarity_aic(spark, sf):
    """Lags chosen by AIC: pytest compares it with numpy."""
    return round_all(FC.stationarity(_numbered(spark, sf)))


@q("ts_arima", f"""
WITH RECURSIVE {_GRID}, {_arima_sql('x')}
SELECT series, CAST(n AS BIGINT) AS n, round(phi, 6) AS phi, round(theta, 6) AS theta, round(sigma2, 2) AS sigma2, round(mae, 4) AS mae,
       round(sqrt(sigma2), 4) AS rmse, round(nobs * (ln(2 * pi() * sigma2) + 1) + 6, 4) AS aic,
       round(nobs * (ln(2 * pi() * sigma2) + 1) + 3 * ln(nobs), 4) AS bic FROM arima""")
def ts_arima(spark, sf):
    fit = FC.fit_arima(_numbered(spark, sf), long_lags=2)[0]
    return fit.select("series", "n", *(r(c, d).alias(c) for c, d in {"phi": 6, "theta": 6, "sigma2": 2, "mae": 4, "rmse": 4, "aic": 4, "bic": 4}.items()))


@q("ts_arima_forecast", f"""
WITH RECURSIVE {_GRID}, {_arima_sql('x')},
p AS (SELECT series, step, {_ARIMA_AT} AS y, 1.959963984540054 * sqrt(sigma2 * list_sum(list_transform(range(0, step),
             lambda k: (1 + (phi + theta) * (1 - phi ** k) / (1 - phi)) ** 2))) AS d FROM arima, range(1, 31) t(step))
SELECT series, CAST(step AS INTEGER) AS step, round(y, 4) AS forecast, round(y - d, 4) AS lower, round(y + d, 4) AS upper FROM p""")
def ts_arima_forecast(spark, sf):
    return round_all(FC.arima_forecast(FC.fit_arima(_numbered(spark, sf), long_lags=2)[0]), 4)


@q("ts_arima_residuals", f"""
WITH RECURSIVE {_GRID}, {_arima_sql('x')}
SELECT v.series, v.ts, round(e, 4) AS residual FROM shock s JOIN v ON v.series = s.series AND v.pos = s.pos WHERE s.pos >= 2""")
def ts_arima_residuals(spark, sf):
    return round_all(FC.fit_arima(_numbered(spark, sf), long_lags=2)[1].select("series", "ts", "residual"), 4)


@q("ts_compare", f"""
WITH RECURSIVE {_GRID}, train AS (SELECT series, ts, value, pos FROM x WHERE pos < floor(n * 0.8)),
test AS (SELECT series, value, CAST(pos - floor(n * 0.8) + 1 AS BIGINT) AS step FROM x WHERE pos >= floor(n * 0.8)),
{_smoothing_sql('train', 4)}, {_arima_sql('train')},
f AS (SELECT t.series, 'Exponential Smoothing' AS model, value - level - step * trend AS e FROM test t JOIN smooth USING (series)
      UNION ALL SELECT t.series, 'ARIMA', value - ({_ARIMA_AT}) FROM test t JOIN arima USING (series)),
m AS (SELECT series, model, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse FROM f GROUP BY series, model)
SELECT series, model, round(mae, 4) AS mae, round(rmse, 4) AS rmse,
       row_number() OVER (PARTITION BY series ORDER BY mae, model) = 1 AS best FROM m""")
def ts_compare(spark, sf):
    return round_all(FC.compare(_numbered(spark, sf), long_lags=2), 4)
