"""Stationarity, forecasts and their comparison for any number of series.

A table ``(series, ts, value)`` is numbered once (``numbered``).  Series are cut
into stretches of ``CHUNK`` rows: rows near a cut are given to the next stretch
too (``lagged``), sums go over all rows at once, and recursions are folded inside a
stretch first and over stretches afterwards.  No step sees a whole series, so one
series of any length is spread like many short ones.  What is solved per series
are rows of sums.

Rows with a null value are no observations.  A series that is too short, or
constant where a regression needs variation, gets null results.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import dist, linear
from quarry.operators.order import BROADCAST_ROWS, with_position
from quarry.session import materialize

CHUNK = 1024   # rows of a stretch
FOLD = 4096    # summaries folded at once

#: Critical values of the unit root statistic with a constant,
#: as polynomials in 1 / observations (MacKinnon 2010), and the two pieces of the
#: polynomial in the statistic whose normal tail is the p-value (MacKinnon 1994).
CRITICAL = {"1%": (-3.43035, -6.5393, -16.786, -79.433), "5%": (-2.86154, -2.8903, -4.234, -40.040),
            "10%": (-2.56677, -1.5384, -2.809)}
TAIL_SPLIT, TAIL_LOW, TAIL_HIGH = -1.61, -18.83, 2.74
TAIL_SMALL = (2.1659, 1.4412, 0.038269)
TAIL_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)


# ---- numbering, neighbours, joins -----------------------------------------

def numbered(ts: DataFrame) -> DataFrame:
    """(series, ts, value, pos, n): 0-based positions and lengths; doubled
    dates keep the smallest value (``timeseries.prepare`` chooses otherwise)."""
    x = ts.where("ts is not null and value is not null and not isnan(value)").groupBy("series", "ts").agg(
        F.min("value").cast("double").alias("value"))
    return materialize(with_position(x, ["ts"], by=["series"], pos_col="pos", n_col="n"), "numbered")


def attach(big: DataFrame, small: DataFrame, on: Sequence[str]) -> DataFrame:
    """Per-series results joined to rows: written, counted, and broadcast only
    under the bound."""
    small = materialize(small, "per-series")
    return big.join(F.broadcast(small) if small.count() <= BROADCAST_ROWS else small, list(on))


def _stretch() -> Column:
    return F.floor(F.col("pos") / CHUNK)


def with_halo(x: DataFrame, before: int, after: int = 0) -> DataFrame:
    """Rows with the stretch (``_cell``) that they serve in: their own, and the
    next or the one before if they stand near its cut."""
    if max(before, after) > CHUNK:
        raise ValueError(f"at most {CHUNK} rows back or ahead")
    at, own = F.col("pos") % CHUNK, _stretch()
    cells = [own]
    if before:
        cells.append(F.when(at >= CHUNK - before, own + 1))
    if after:
        cells.append(F.when((at < after) & (own > 0), own - 1))
    return x.withColumn("_cell", F.explode(F.filter(F.array(*cells), lambda c: c.isNotNull())))


#: Rows of one stretch and its halo in order: a bounded window.
IN_STRETCH = ("series", "_cell")


def own_rows(x: DataFrame) -> DataFrame:
    """Without the rows that only served their neighbours."""
    return x.where(F.col("_cell") == _stretch()).drop("_cell")


def lagged(x: DataFrame, columns: dict[str, tuple[Column, int]], before: int) -> DataFrame:
    """Adds ``columns`` {name: (expression, rows back)}."""
    w = Window.partitionBy(*IN_STRETCH).orderBy("pos")
    y = with_halo(x, before)
    return own_rows(y.select("*", *(F.lag(c, k).over(w).alias(n) for n, (c, k) in columns.items())))


def centred(x: DataFrame) -> DataFrame:
    """Values without the mean of their series, which is kept as ``mean``:
    sums of squares then lose no digits to a large level."""
    mean = x.groupBy("series").agg(F.avg("value").alias("mean"))
    return attach(x, mean, ["series"]).withColumn("value", F.col("value") - F.col("mean"))


# ---- T5 exponential smoothing ---------------------------------------------
# With level and trend as a state s, smoothing is s -> A s + g y and the one-step
# error is y - (1, 1) s.  Over any run of rows the state after it is an affine map
# of the state s0 before it, and the sum of squared errors is s0'Q s0 - 2 l's0 + k.
# Both compose, so runs can be summarised apart and put together in order, and
# the best s0 of a whole series is the solution of Q s0 = l.

_RUN = "m11 m12 m21 m22 c1 c2 q11 q12 q22 l1 l2 k".split()


def _run(**parts: Column) -> Column:
    return F.struct(*(parts[n].cast("double").alias(n) for n in _RUN))


def _nothing() -> Column:
    return _run(**{n: F.lit(1.0 if n in ("m11", "m22") else 0.0) for n in _RUN})


def _step(s: Column, y: Column, a: Column, b: Column) -> Column:
    """A run extended by one row."""
    g = {n: s[n] for n in _RUN}
    p1, p2, r = g["m11"] + g["m21"], g["m12"] + g["m22"], y - (g["c1"] + g["c2"])
    ab = a * b
    return _run(m11=(1 - a) * p1, m12=(1 - a) * p2, m21=(1 - ab) * g["m21"] - ab * g["m11"],
                m22=(1 - ab) * g["m22"] - ab * g["m12"], c1=(1 - a) * (g["c1"] + g["c2"]) + a * y,
                c2=(1 - ab) * g["c2"] - ab * g["c1"] + ab * y,
                q11=g["q11"] + p1 * p1, q12=g["q12"] + p1 * p2, q22=g["q22"] + p2 * p2,
                l1=g["l1"] + r * p1, l2=g["l2"] + r * p2, k=g["k"] + r * r)


def _then(x: Column, y: Column) -> Column:
    """Two runs, one after the other, as one."""
    u, v = {n: x[n] for n in _RUN}, {n: y[n] for n in _RUN}
    qc1 = v["q11"] * u["c1"] + v["q12"] * u["c2"]
    qc2 = v["q12"] * u["c1"] + v["q22"] * u["c2"]
    d1, d2 = v["l1"] - qc1, v["l2"] - qc2

    def quad(i: str, j: str) -> Column:
        return (u[f"m1{i}"] * (v["q11"] * u[f"m1{j}"] + v["q12"] * u[f"m2{j}"])
                + u[f"m2{i}"] * (v["q12"] * u[f"m1{j}"] + v["q22"] * u[f"m2{j}"]))

    return _run(**{f"m{i}{j}": v[f"m{i}1"] * u[f"m1{j}"] + v[f"m{i}2"] * u[f"m2{j}"] for i in "12" for j in "12"},
                **{f"c{i}": v[f"m{i}1"] * u["c1"] + v[f"m{i}2"] * u["c2"] + v[f"c{i}"] for i in "12"},
                q11=u["q11"] + quad("1", "1"), q12=u["q12"] + quad("1", "2"), q22=u["q22"] + quad("2", "2"),
                l1=u["l1"] + u["m11"] * d1 + u["m21"] * d2, l2=u["l2"] + u["m12"] * d1 + u["m22"] * d2,
                k=u["k"] + v["k"] - v["l1"] * u["c1"] - v["l2"] * u["c2"] - d1 * u["c1"] - d2 * u["c2"])


def _smoothed(stretches: DataFrame, most: int) -> DataFrame:
    """Per (series, alpha, beta) the run over the whole series, solved for its
    best start; ``most`` is the largest number of stretches of a series."""
    runs = stretches.select("series", "alpha", "beta", "stretch", F.aggregate(
        "ys", _nothing(), lambda s, y: _step(s, y["value"], F.col("alpha"), F.col("beta"))).alias("run"))
    while True:
        runs = runs.groupBy("series", "alpha", "beta", F.floor(F.col("stretch") / FOLD).alias("stretch")).agg(
            F.sort_array(F.collect_list(F.struct("stretch", "run"))).alias("_r"))  # at most FOLD rows
        runs = runs.withColumn("run", F.aggregate("_r", _nothing(), lambda s, y: _then(s, y["run"]))).drop("_r")
        most = math.ceil(most / FOLD)
        if most <= 1:
            break
    g = {n: F.col(f"run.{n}") for n in _RUN}
    det = g["q11"] * g["q22"] - g["q12"] * g["q12"]
    det = F.when(det > 1e-12 * g["q11"] * g["q22"], det)
    s1 = (g["q22"] * g["l1"] - g["q12"] * g["l2"]) / det
    s2 = (g["q11"] * g["l2"] - g["q12"] * g["l1"]) / det
    out = runs.select("series", "alpha", "beta", "run", s1.alias("level0"), s2.alias("trend0"))
    return out.select(
        "series", "alpha", "beta", "level0", "trend0",
        F.greatest(g["k"] - g["l1"] * F.col("level0") - g["l2"] * F.col("trend0"), F.lit(0.0)).alias("sse"),
        (g["m11"] * F.col("level0") + g["m12"] * F.col("trend0") + g["c1"]).alias("level"),
        (g["m21"] * F.col("level0") + g["m22"] * F.col("trend0") + g["c2"]).alias("trend"))


def fit_smoothing(x: DataFrame, rounds: int = 4) -> DataFrame:
    """Additive-trend exponential smoothing (T5) of ``numbered`` series: the
    smoothing weights of least one-step squared error, with the best starting
    level and trend for every pair of weights.  The weights are searched on a grid
    of 5 x 5, five steps of 0.2 around 0.5 first, then around the best pair with the
    step halved, ``rounds`` times; ties go to the smaller weights."""
    c = centred(x)
    stretches = materialize(c.groupBy("series", _stretch().alias("stretch"), "mean").agg(
        F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("ys")), "stretches")  # at most CHUNK rows each
    most = (stretches.agg(F.max("stretch")).first()[0] or 0) + 1
    best, step = None, 0.2
    for _ in range(rounds):
        if best is None:
            rows = stretches.withColumn("_a", F.lit(0.5)).withColumn("_b", F.lit(0.5))
        else:
            rows = attach(stretches, best.select("series", F.col("alpha").alias("_a"), F.col("beta").alias("_b")), ["series"])
        around = lambda c: F.array_distinct(F.array(*(  # noqa: E731 - weights that meet at a bound are one candidate
            F.least(F.greatest(F.round(F.col(c) + k * step, 6), F.lit(0.01)), F.lit(0.99)) for k in range(-2, 3))))
        rows = rows.withColumn("alpha", F.explode(around("_a"))).withColumn("beta", F.explode(around("_b")))
        tried = _smoothed(rows, most)
        order = F.struct(F.col("sse").isNull().alias("none"), "sse", "alpha", "beta")
        best = materialize(tried.groupBy("series").agg(F.min_by(F.struct(*tried.columns[1:]), order).alias("_f")).select(
            "series", "_f.*"), "smoothing")
        step /= 2
    size = stretches.groupBy("series").agg(F.first("mean").alias("mean"), F.sum(F.size("ys")).alias("n"))
    out = best.join(size, "series")
    return out.select("series", "n", "alpha", "beta", "sse", (F.col("level") + F.col("mean")).alias("level"), "trend",
                      F.sqrt(F.col("sse") / F.col("n")).alias("rmse"))


def smoothing_forecast(fit: DataFrame, periods: int = 30) -> DataFrame:
    """(series, step, forecast) of fitted smoothing."""
    return fit.select("series", "level", "trend", F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("step")).select(
        "series", "step", (F.col("level") + F.col("step") * F.col("trend")).alias("forecast"))


# ---- T6 trend and seasons by regression ------------------------------------

def _days(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 86_400_000_000.0


def _features(day: Column, start: Column, yearly: int, weekly: int) -> list[Column]:
    waves = [(365.25, k) for k in range(1, yearly + 1)] + [(7.0, k) for k in range(1, weekly + 1)]
    angles = [2 * math.pi * k / period * day for period, k in waves]
    return [F.lit(1.0), day - start, *(f(a) for a in angles for f in (F.sin, F.cos))]


def fit_seasons(x: DataFrame, yearly: int = 3, weekly: int = 3, ridge: float = 1e-3) -> DataFrame:
    """Linear trend plus Fourier terms of the year and the week (T6), by the
    normal equations of each series.  ``ridge`` is the penalty on the Fourier
    weights as a share of the observations; it keeps apart waves that a short
    series cannot."""
    start = x.groupBy("series").agg(F.min(_days(F.col("ts"))).alias("start"), F.max("ts").alias("last"))
    rows = attach(centred(x), start, ["series"])
    cols = _features(_days(F.col("ts")), F.col("start"), yearly, weekly)
    sums = rows.groupBy("series").agg(
        F.count(F.lit(1)).alias("n"), F.first("mean").alias("mean"), F.first("start").alias("start"), F.first("last").alias("last"),
        linear.gram([*cols, F.col("value")]).alias("gram"))
    k = len(cols)
    if ridge and k > 2:  # in sums of products: penalty * n on the waves' own squares
        diagonal = [i * (k + 1) - i * (i - 1) // 2 for i in range(k)]
        add = F.array(*(F.lit(1.0 if j in diagonal[2:] else 0.0) for j in range((k + 1) * (k + 2) // 2)))
        sums = sums.withColumn("gram", F.zip_with("gram", add, lambda g, w: g + w * ridge * F.col("n")))
    out = sums.withColumn("_s", linear.solve("gram"))
    waves = F.aggregate(F.slice("_s.coef", 3, max(1, k - 2)), F.lit(0.0), lambda s, c: s + c * c)
    sse = F.greatest(F.col("_s.sse") - ridge * F.col("n") * waves, F.lit(0.0))  # without the penalty
    free = F.when(F.col("n") > k, F.col("n") - k)
    return out.select("series", "n", "mean", "start", "last", F.col("_s.coef").alias("coef"), F.col("_s.inverse").alias("inverse"),
                      sse.alias("sse"), F.sqrt(sse / free).alias("sigma"))


def _at(fit: DataFrame, day: Column, yearly: int, weekly: int, interval: float) -> list[Column]:
    """Value and bounds of a fitted regression at a day."""
    f = F.array(*_features(day, F.col("start"), yearly, weekly))
    k = 2 + 2 * (yearly + weekly)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    value = F.col("mean") + total(F.zip_with("coef", f, lambda c, v: c * v))
    row = F.transform(F.sequence(F.lit(0), F.lit(k - 1)),
                      lambda i: total(F.zip_with(F.slice("inverse", i * k + 1, k), f, lambda c, v: c * v)))
    spread = F.col("sigma") * F.sqrt(1 + total(F.zip_with(row, f, lambda c, v: c * v)))
    z = dist.norm_ppf((1 + interval) / 2)
    return [value.alias("forecast"), (value - z * spread).alias("lower"), (value + z * spread).alias("upper")]


def seasons_forecast(fit: DataFrame, periods: int = 30, yearly: int = 3, weekly: int = 3, interval: float = 0.95) -> DataFrame:
    """(series, step, ts, forecast, lower, upper): the days after each series' last."""
    rows = fit.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(periods)))).withColumn(
        "ts", (F.col("last") + F.make_dt_interval(days=F.col("step"))).cast("timestamp_ntz"))
    return rows.select("series", "step", "ts", *_at(fit, _days(F.col("ts")), yearly, weekly, interval))


# ---- T3 stationarity ---------------------------------------------------------

def _differences(x: DataFrame, lags: int) -> DataFrame:
    """Adds level (the value before), w0 (the difference), w1 ... (its lags)."""
    back = {f"_y{k}": (F.col("value"), k) for k in range(1, lags + 2)}
    y = lagged(x, back, lags + 1)
    past = [F.col("value"), *(F.col(f"_y{k}") for k in range(1, lags + 2))]
    return y.select("series", "ts", "value", "pos", "n", past[1].alias("level"),
                    *((past[k] - past[k + 1]).alias(f"w{k}") for k in range(lags + 1)))


def stationarity(x: DataFrame, lag: int | None = None, most: int = 24) -> DataFrame:
    """Augmented Dickey-Fuller test with a constant (T3) of ``numbered`` series.

    Without ``lag``, the number of lagged differences is the one of least AIC
    among 0 .. min(ceil(12 (n / 100)^(1/4)), n // 2 - 2, ``most``), all fitted on
    the same rows.  One row per series: statistic, p_value, lags, nobs, critical
    values, stationary (p < 0.05)."""
    if lag is None:
        rule = F.ceil(12 * F.pow(F.col("n") / 100.0, 0.25))
        limit = F.greatest(F.least(rule, F.floor(F.col("n") / 2) - 2, F.lit(most)), F.lit(0)).cast("int")
        widest = x.agg(F.max(limit)).first()[0] or 0
    else:
        limit, widest = F.lit(lag), lag
    rows = _differences(centred(x), widest)
    past = [F.col(f"w{k}") for k in range(1, widest + 1)]
    cols = [F.lit(1.0), F.col("level"), *past, F.col("w0")]

    def sums(src: DataFrame, lags: Column) -> DataFrame:
        used = F.col("pos") >= lags + 1
        return src.groupBy("series").agg(linear.gram(cols, used).alias("gram"), F.count(F.when(used, 1)).alias("nobs"),
                                         F.max(lags).alias("lags"))

    if lag is None and widest:
        rows = materialize(rows, "differences")  # two aggregates read it
        chosen = sums(rows, limit).select("series", linear.best_lag("gram", "lags", "nobs").alias("_lag"))
        found = sums(attach(rows, chosen, ["series"]), F.col("_lag"))
    else:
        found = sums(rows, limit)
    found = found.withColumn("_t", dist.nan_to_null(linear.unit_root("gram", "lags", "nobs")))
    t = F.col("_t")

    def poly(c: Sequence[float], v: Column) -> Column:
        return sum((F.lit(a) * F.pow(v, k) for k, a in enumerate(c)), F.lit(0.0))

    p = dist.norm_sf_col(-F.when(t <= TAIL_SPLIT, poly(TAIL_SMALL, t)).otherwise(poly(TAIL_LARGE, t)))
    p = F.when(t > TAIL_HIGH, 1.0).when(t < TAIL_LOW, 0.0).otherwise(p)
    out = found.select("series", t.alias("statistic"), p.alias("p_value"), F.col("lags").cast("int").alias("lags"), "nobs",
                       *(poly(c, F.try_divide(F.lit(1.0), F.col("nobs"))).alias(f"critical_{k[:-1]}") for k, c in CRITICAL.items()))
    return out.withColumn("stationary", F.col("p_value") < 0.05)


# ---- T4 ARIMA(1, 1, 1) --------------------------------------------------------

def fit_arima(x: DataFrame, long_lags: int = 5) -> tuple[DataFrame, DataFrame]:
    """ARIMA(1,1,1) without constant (T4) by two regressions: a long
    autoregression of the differences gives approximate shocks, then the
    difference is regressed on its predecessor and the shock before it.  Both
    weights are kept within 0.99.  The model's own shocks follow by recursion from
    zero.  Returns (per series: n, phi, theta, sigma2, mae, rmse, aic, bic, last
    value, difference and shock; residuals: series, ts, pos, residual)."""
    rows = _differences(x, long_lags + 1)
    w = [F.col(f"w{k}") for k in range(long_lags + 2)]
    sums = rows.groupBy("series").agg(linear.gram([*w[1:long_lags + 1], w[0]], F.col("pos") >= long_lags + 1).alias("gram"))
    first = sums.select("series", linear.solve("gram").coef.alias("long"))
    rows = materialize(attach(rows, first, ["series"]), "differences")
    shock = w[1] - sum((F.col("long")[k - 1] * w[k + 1] for k in range(1, long_lags + 1)), F.lit(0.0))
    known = F.col("pos") >= long_lags + 2
    e = rows.where(known).groupBy("series").agg(
        F.sum(w[1] * w[1]).alias("a"), F.sum(w[1] * shock).alias("b"), F.sum(shock * shock).alias("c"),
        F.sum(w[0] * w[1]).alias("u"), F.sum(w[0] * shock).alias("v"))
    det = F.expr("a * c - b * b")
    det = F.when(det > 1e-12 * F.col("a") * F.col("c"), det)
    bound = lambda c: F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(-0.99)), F.lit(0.99)))
    weights = e.select("series", bound(F.expr("c * u - b * v") / det).alias("phi"), bound(F.expr("a * v - b * u") / det).alias("theta"))
    weights = weights.where("phi is not null")

    # shock_t = w0 - phi w1 - theta shock_(t-1), from zero at the first difference
    known = attach(rows.where("pos >= 2"), weights, ["series"])
    cells = materialize(known.groupBy("series", "phi", "theta", _stretch().alias("stretch")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "ts", (w[0] - F.col("phi") * w[1]).alias("u")))).alias("us")), "stretches")
    ends = cells.select("series", "stretch", F.pow(-F.col("theta"), F.size("us")).alias("m"), F.aggregate(
        "us", F.lit(0.0), lambda s, r: r["u"] - F.col("theta") * s).alias("c"))
    # one row per stretch: the state that each starts with
    line = ends.groupBy("series").agg(F.sort_array(F.collect_list(F.struct("stretch", "m", "c"))).alias("_l"))
    starts = line.select("series", F.explode(F.aggregate(
        "_l", F.struct(F.lit(0.0).alias("s"), F.expr("cast(array() as array<struct<stretch:bigint,start:double>>)").alias("out")),
        lambda acc, r: F.struct((r["m"] * acc["s"] + r["c"]).alias("s"), F.concat(acc["out"], F.array(F.struct(
            r["stretch"].alias("stretch"), acc["s"].alias("start")))).alias("out")),
        lambda acc: acc["out"])).alias("_s")).select("series", "_s.*")
    back = attach(cells, starts, ["series", "stretch"])
    run = F.aggregate("us", F.struct(F.col("start").alias("s"), F.expr("cast(array() as array<double>)").alias("out")),
                      lambda acc, r: F.struct((r["u"] - F.col("theta") * acc["s"]).alias("s"), F.concat(
                          acc["out"], F.array(r["u"] - F.col("theta") * acc["s"])).alias("out")), lambda acc: acc["out"])
    shocks = back.select("series", F.explode(F.arrays_zip("us", run.alias("e"))).alias("_z")).select(
        "series", F.col("_z.us.ts").alias("ts"), F.col("_z.us.pos").alias("pos"), F.col("_z.e").alias("residual"))
    shocks = materialize(shocks, "residuals")
    size = shocks.groupBy("series").agg(
        F.count(F.lit(1)).alias("nobs"), F.avg(F.abs("residual")).alias("mae"), F.avg(F.col("residual") * F.col("residual")).alias("sigma2"),
        F.max_by("residual", "pos").alias("last_shock"))
    last = rows.groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.max_by("value", "pos").alias("last_value"), F.max_by("w0", "pos").alias("last_step"))
    fit = weights.join(size, "series").join(last, "series")
    aic = F.col("nobs") * (F.log(2 * math.pi * F.col("sigma2")) + 1)
    fit = fit.select("series", "n", "phi", "theta", "sigma2", "mae", F.sqrt("sigma2").alias("rmse"), (aic + 6).alias("aic"),
                     (aic + 3 * F.log("nobs")).alias("bic"), "last_value", "last_step", "last_shock")
    return materialize(fit, "arima"), shocks


def _arima_at(step: Column) -> Column:
    """The forecast so many steps ahead of a fitted series."""
    phi = F.col("phi")
    first = phi * F.col("last_step") + F.col("theta") * F.col("last_shock")
    return F.col("last_value") + first * (1 - F.pow(phi, step)) / (1 - phi)


def arima_forecast(fit: DataFrame, periods: int = 30, interval: float = 0.95) -> DataFrame:
    """(series, step, forecast, lower, upper)."""
    rows = fit.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(periods))))
    phi, z = F.col("phi"), dist.norm_ppf((1 + interval) / 2)
    # a shock k steps back has moved the value by 1 + (phi + theta) (1 - phi^k) / (1 - phi)
    moved = lambda k: 1 + (phi + F.col("theta")) * (1 - F.pow(phi, k)) / (1 - phi)
    spread = F.sqrt(F.col("sigma2") * F.aggregate(F.sequence(F.lit(0), F.col("step") - 1), F.lit(0.0),
                                                  lambda s, k: s + moved(k) * moved(k)))
    value = _arima_at(F.col("step"))
    return rows.select("series", "step", value.alias("forecast"), (value - z * spread).alias("lower"), (value + z * spread).alias("upper"))


# ---- T7 comparison -------------------------------------------------------------

def compare(x: DataFrame, test_size: float = 0.2, long_lags: int = 5, rounds: int = 4) -> DataFrame:
    """Both models fitted on the first floor(n (1 - test_size)) rows of each
    series and judged on the rest (T7): (series, model, mae, rmse, best)."""
    split = F.floor(F.col("n") * (1 - test_size))
    train = materialize(x.where(F.col("pos") < split).withColumn("n", split), "train")
    test = materialize(x.where(F.col("pos") >= split).withColumn("step", F.col("pos") - split + 1).select("series", "step", "value"), "test")
    smooth = attach(test, fit_smoothing(train, rounds).select("series", "level", "trend"), ["series"]).select(
        "series", "value", F.lit("Exponential Smoothing").alias("model"), (F.col("level") + F.col("step") * F.col("trend")).alias("f"))
    arima = attach(test, fit_arima(train, long_lags)[0], ["series"]).select(
        "series", "value", F.lit("ARIMA").alias("model"), _arima_at(F.col("step")).alias("f"))
    err = F.col("value") - F.col("f")
    scored = materialize(smooth.union(arima).where("f is not null").groupBy("series", "model").agg(
        F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse")), "scores")
    best = scored.groupBy("series").agg(F.min_by("model", F.struct("mae", "model")).alias("best"))
    return scored.join(best, "series").select("series", "model", "mae", "rmse", (F.col("model") == F.col("best")).alias("best"))
