"""Time series, many in parallel.

A table ``(series, ts, value)`` holds any number of series.  Parsing,
de-duplication, aggregation to a regular grid and the decomposition are Spark
operations; tests and forecasts (T3-T7) are in ``forecasting``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.stats import clean_double, col_of
from quarry.operators.order import with_position
from quarry.session import materialize
from quarry.sources.io import parse_timestamp

# --- T1 ---------------------------------------------------------------------------
def prepare(df: DataFrame, date_col: str, value_col: str, order_by: Sequence[str],
            series: str | None = None) -> DataFrame:
    """Cast the date, keep the first row per (series, date) in input order,
    then drop nulls (this order matters: a first null value removes the
    date).  ``min_by`` keeps the first value with partial aggregation, so a
    date holding a third of all rows is not funnelled into one task."""
    dt = col_of(date_col)
    if dict(df.dtypes)[date_col] == "string":
        dt = parse_timestamp(dt)
    src = df.select((col_of(series).cast("string") if series else F.lit("all")).alias("series"),
                    dt.cast("timestamp_ntz").alias("ts"), clean_double(col_of(value_col)).alias("value"),
                    F.struct(*[col_of(o) for o in order_by]).alias("_o"))
    first = src.where(F.col("ts").isNotNull()).groupBy("series", "ts").agg(F.min_by("value", "_o").alias("value"))
    return first.where(F.col("value").isNotNull())


def to_grid(df: DataFrame, date_col: str, value_col: str, series: str | None = None, grain: str = "day",
            agg: str = "sum") -> DataFrame:
    """Aggregate raw rows to one value per (series, time bucket)."""
    fn = {"sum": F.sum, "mean": F.avg, "count": F.count, "max": F.max, "min": F.min}[agg]
    return df.where(col_of(date_col).isNotNull()).groupBy(
        (col_of(series).cast("string") if series else F.lit("all")).alias("series"),
        F.date_trunc(grain, col_of(date_col)).cast("timestamp_ntz").alias("ts")).agg(
        fn(clean_double(col_of(value_col))).alias("value"))


# --- T2 ---------------------------------------------------------------------------
def decompose(ts: DataFrame, period: int = 12) -> DataFrame:
    """Additive decomposition per series (T2): centred moving average trend
    (2 x period for an even period), seasonal = mean detrended value per phase
    minus the mean of those phase means, residual = rest; trend ends are null.

    Positions are numbered over all rows at once and the moving average runs
    inside stretches that also hold the rows around them, so one long series is
    spread over many tasks."""
    from quarry.operators import forecasting as C

    x = materialize(with_position(ts, ["ts", "value"], by=["series"], pos_col="pos", n_col=None), "numbered")
    h = period // 2
    w = Window.partitionBy(*C.IN_STRETCH).orderBy("pos")
    span = w.rowsBetween(-h, h)
    tot = F.sum("value").over(span)
    if period % 2 == 0:
        tot = tot - 0.5 * (F.lag("value", h).over(w) + F.lead("value", h).over(w))
    full = F.count("value").over(span) == (2 * h + 1)
    x = C.own_rows(C.with_halo(x, h, h).withColumn("trend", F.when(full, tot / period)))
    x = materialize(x.withColumn("phase", F.col("pos") % period), "trends")  # read twice
    ph = x.groupBy("series", "phase").agg(F.avg(F.col("value") - F.col("trend")).alias("_pm"))
    seasonal = F.col("_pm") - F.avg("_pm").over(Window.partitionBy("series"))  # at most ``period`` rows
    out = C.attach(x, ph.select("series", "phase", seasonal.alias("seasonal")), ["series", "phase"])
    return out.select("series", "ts", F.col("value").alias("observed"), "trend", "seasonal",
                      (F.col("value") - F.col("trend") - F.col("seasonal")).alias("resid"))
