"""Column expressions shared by operators: type families, null-safe Pearson,
rounding used to compare engines, NaN cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)
DATETIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, NUMERIC_TYPES)


def is_datetime(dt: T.DataType) -> bool:
    return isinstance(dt, DATETIME_TYPES)


def is_text(dt: T.DataType) -> bool:
    return isinstance(dt, T.StringType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def datetime_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_datetime(f.dataType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_text(f.dataType)]


def col_of(name: str) -> Column:
    """Column by exact name, quoting odd characters such as ``Change_%``."""
    return F.col(f"`{name}`") if not name.startswith("`") else F.col(name)


def clean_double(c: Column) -> Column:
    """NaN is a value in Spark but 'missing' in the reference: turn it into null."""
    d = c.cast("double")
    return F.when(F.isnan(d), F.lit(None).cast("double")).otherwise(d)


def finite_double(c: Column) -> Column:
    """A double without NaN and infinities, which have no place on a scale."""
    d = clean_double(c)
    return F.when(F.abs(d) != F.lit(float("inf")), d)


def present(df: DataFrame, name: str) -> Column:
    """A column whose NaN counts as missing (floating types only)."""
    c = col_of(name)
    floating = isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType))
    return F.when(~F.isnan(c), c) if floating else c


def rnd(c: Column, digits: int = 6) -> Column:
    """Round a double for cross-engine comparison (last-bit sum differences)."""
    return F.round(c.cast("double"), digits)


def pearson(x: Column, y: Column) -> Column:
    """Pairwise-complete Pearson r that is null (not an error) when either
    side is constant.  Both sides are nulled where the partner is null so the
    moments use the same rows as ``corr``."""
    xd, yd = clean_double(x), clean_double(y)
    both = xd.isNotNull() & yd.isNotNull()
    xp = F.when(both, xd)
    yp = F.when(both, yd)
    return F.try_divide(F.covar_pop(xp, yp), F.sqrt(F.var_pop(xp) * F.var_pop(yp)))
