"""Projections, filters and predicates.

All predicates are plain Column expressions so Catalyst pushes them into the
Parquet scan (``PushedFilters``) and prunes columns (``ReadSchema``).
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.stats import DATETIME_TYPES, NUMERIC_TYPES, col_of, present
from quarry.session import materialize


def _dtype(df: DataFrame, column: str) -> T.DataType:
    for f in df.schema.fields:
        if f.name == column:
            return f.dataType
    raise KeyError(f"Column '{column}' not found")


def typed_literal(df: DataFrame, column: str, value) -> Column:
    """Text from a request cast to the column's type (try_cast: a bad value
    matches nothing instead of failing).  Declared difference: the reference
    compares text with numbers and never matches."""
    dt = _dtype(df, column)
    if isinstance(value, str) and not isinstance(dt, T.StringType):
        return F.lit(value).try_cast(dt)
    return F.lit(value).cast(dt)


def eq_predicate(df: DataFrame, column: str, value) -> Column:
    return col_of(column) == typed_literal(df, column, value)


# --- P1 -------------------------------------------------------------------
def filter_eq(df: DataFrame, column: str, value, order_by: Sequence[str], limit: int = 100) -> DataFrame:
    """Rows where column == value: first ``limit`` rows by ``order_by`` plus
    the full matched count on every row.  The count is a one-row aggregate
    (proven size) broadcast onto the top-k."""
    hit = df.where(eq_predicate(df, column, value))
    cnt = hit.agg(F.count(F.lit(1)).alias("matched_count"))
    return hit.orderBy(*order_by).limit(limit).crossJoin(F.broadcast(cnt))


# --- P2, P3, P4 -------------------------------------------------------------
def in_predicate(df: DataFrame, column: str, values: Iterable) -> Column:
    return col_of(column).isin([typed_literal(df, column, v) for v in values])


def range_predicate(column: str, lo, hi) -> Column:
    """Inclusive both ends (slider semantics)."""
    return col_of(column).between(lo, hi)


def column_bounds(df: DataFrame, column: str) -> tuple:
    """Slider bounds: min and max in one aggregate."""
    r = df.agg(F.min(col_of(column)).alias("lo"), F.max(col_of(column)).alias("hi")).first()
    return r["lo"], r["hi"]


def filter_multi(df: DataFrame, in_filters: Mapping[str, Iterable] | None = None,
                 ranges: Mapping[str, tuple] | None = None,
                 eq: Mapping[str, object] | None = None) -> DataFrame:
    """Conjunction of column filters (P4); empty -> the table unchanged."""
    preds: list[Column] = []
    for c, vals in (in_filters or {}).items():
        preds.append(in_predicate(df, c, vals))
    for c, (lo, hi) in (ranges or {}).items():
        preds.append(range_predicate(c, lo, hi))
    for c, v in (eq or {}).items():
        preds.append(eq_predicate(df, c, v))
    if not preds:
        return df
    return df.where(reduce(lambda a, b: a & b, preds))


# --- P6 ---------------------------------------------------------------------
def valid_points(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """Non-null coordinates inside [-90,90] x [-180,180]."""
    return df.where(col_of(lat).isNotNull() & col_of(lon).isNotNull()
                    & col_of(lat).between(-90, 90) & col_of(lon).between(-180, 180))


# --- P7 -------------------------------------------------------------------
def project_family(df: DataFrame, family: str) -> DataFrame:
    """Columns of one type family: numeric, datetime or categorical."""
    fam = {"numeric": NUMERIC_TYPES, "datetime": DATETIME_TYPES, "categorical": (T.StringType,),
           "boolean": (T.BooleanType,)}[family]
    return df.select(*[col_of(f.name) for f in df.schema.fields if isinstance(f.dataType, fam)])


# --- P8 -------------------------------------------------------------------
def preview(df: DataFrame, order_by: Sequence[str], n: int = 100) -> DataFrame:
    """First n rows (1..1000) by an explicit order: a top-k (TakeOrdered)."""
    if not 1 <= n <= 1000:
        raise ValueError("n must be between 1 and 1000")
    return df.orderBy(*order_by).limit(n)


# --- P9 -------------------------------------------------------------------
def sample_n(df: DataFrame, n: int, order_by: Sequence[str], seed: int = 42) -> DataFrame:
    """Exactly ``min(n, rows)`` rows drawn uniformly without replacement, in
    the original order (P9).  ``df.sample`` gives only a fraction, not an
    exact n; sampling is the feature here, so the limit is part of the
    semantics.

    Every row draws its own seeded key u in [0, 1), so equal rows are drawn
    independently.  Rows under a threshold that lets about n plus ten standard
    deviations through are pinned, and the n smallest of them are the sample;
    should fewer than n pass, a new draw has twice the threshold."""
    total = df.count()
    share = min(1.0, (n + 10.0 * math.sqrt(n) + 10.0) / max(1, total))
    while True:
        drawn = materialize(df.withColumn("_u", F.rand(seed)).where(F.col("_u") < share), "drawn")
        if share >= 1.0 or drawn.count() >= n:
            break
        share = min(1.0, 2 * share)
    return drawn.orderBy("_u", *order_by).limit(n).drop("_u").orderBy(*order_by)


# --- P10, P11 ---------------------------------------------------------------
def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(col_of(column).alias(column)).distinct()


def first_distinct(df: DataFrame, column: str, order_by: Sequence[str], n: int = 10) -> DataFrame:
    """First ``n`` distinct trimmed non-blank values by first appearance.

    A group-by value keeps the earliest order key (partial aggregation
    map-side), then a top-n over the distinct values."""
    v = F.trim(col_of(column).cast("string"))
    first = (df.select(v.alias("value"), F.struct(*[col_of(c) for c in order_by]).alias("_o"))
               .where(F.col("value").isNotNull() & (F.col("value") != ""))
               .groupBy("value").agg(F.min("_o").alias("_o")))
    return first.orderBy("_o").limit(n).select("value")


# --- P12 --------------------------------------------------------------------
def split_by_flag(df: DataFrame, flag: Column) -> tuple[DataFrame, DataFrame]:
    """Anomalous and normal rows: two complementary filters (P12); a null
    flag counts as normal."""
    f = F.coalesce(flag, F.lit(False))
    return df.where(f), df.where(~f)


# --- P13 --------------------------------------------------------------------
#: Leading rows in which most columns have their first values.
HEAD_ROWS = 100


def sample_values(df: DataFrame, order_by: Sequence[str], k: int = 3,
                  columns: Sequence[str] | None = None) -> DataFrame:
    """First ``k`` present values of each column, as text, in long form
    (column_name, k, value).

    One top-n of whole rows serves every column that has ``k`` values in it;
    a column with fewer there has a top-k of its own, over two columns."""
    cols = list(columns or df.columns)
    head = materialize(df.orderBy(*order_by).limit(max(HEAD_ROWS, k)), "head")
    seen = head.agg(*[F.count(present(head, c)).alias(f"_{i}") for i, c in enumerate(cols)]).first()
    first = Window.orderBy(*order_by)  # over the rows of a limit
    parts = []
    for i, c in enumerate(cols):
        src = (head if seen[f"_{i}"] >= k else df).select(*[col_of(o) for o in order_by], present(df, c).alias("_v"))
        top = src.where(F.col("_v").isNotNull()).orderBy(*order_by).limit(k)
        parts.append(top.select(F.lit(c).alias("column_name"), F.row_number().over(first).alias("k"),
                                F.col("_v").cast("string").alias("value")))
    return reduce(DataFrame.unionByName, parts)
