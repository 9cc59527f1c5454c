"""Scans, load validation, re-typing, dataset registry and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.stats import is_numeric, present

# Date formats tried, in order, when a text column is re-typed
# as a timestamp (Spark datetime patterns).
DATE_FORMATS = (
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
    "yyyy/MM/dd",
    "MM/dd/yyyy HH:mm:ss",
    "MM/dd/yyyy",
    "dd.MM.yyyy",
    "yyyyMMdd",
)


class LoadError(ValueError):
    pass


# --- S1 -------------------------------------------------------------------
def read_csv(spark: SparkSession, path: str, infer_schema: bool = True) -> DataFrame:
    """CSV with header and inferred types (S1).  For production prefer an
    explicit schema: inference costs an extra pass over the files."""
    return (spark.read.option("header", True).option("inferSchema", infer_schema)
            .option("mode", "PERMISSIVE").csv(path))


def read_any(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    fmt = fmt or path.rsplit(".", 1)[-1].lower()
    if fmt == "csv":
        return read_csv(spark, path)
    if fmt in ("json", "jsonl", "ndjson"):
        return spark.read.json(path)
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt == "orc":
        return spark.read.orc(path)
    raise LoadError(f"unsupported format: {fmt}")


# --- S2, S3, S5 ------------------------------------------------------------
def validate(df: DataFrame) -> DataFrame:
    """Reject an empty table or one with fewer than two columns."""
    if len(df.columns) < 2:
        raise LoadError("Dataset must have at least 2 columns for meaningful analysis.")
    if df.isEmpty():
        raise LoadError("The uploaded file is empty.")
    return df


def clean_names(df: DataFrame) -> DataFrame:
    """Strip names and turn spaces into underscores (S3); metadata only."""
    new = [c.strip().replace(" ", "_") for c in df.columns]
    if len(set(new)) != len(new):
        raise LoadError(f"column names collide after cleaning: {new}")
    return df.toDF(*new)


def parse_timestamp(c: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """First format that parses wins; nothing parses -> null (coerce)."""
    s = F.trim(c.cast("string"))
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in formats]).cast("timestamp_ntz")


def infer_dates(df: DataFrame, threshold: float = 0.5, formats: Sequence[str] = DATE_FORMATS,
                sample: int | None = None, order_by: Sequence[str] = ()) -> DataFrame:
    """Re-type text columns as timestamps (S4) and keep other text as nullable
    string (S5).

    A text column becomes a timestamp when more than ``threshold`` of its
    non-null values parse; one aggregate decides for all columns.  With
    ``sample`` only the first ``sample`` rows by ``order_by`` are looked at.
    """
    text_cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not text_cols:
        return df
    src = df.orderBy(*order_by).limit(sample) if sample else df
    got = src.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(text_cols)],
                  *[F.count(parse_timestamp(F.col(f"`{c}`"), formats)).alias(f"k{i}") for i, c in enumerate(text_cols)]).first()
    convert = {c for i, c in enumerate(text_cols) if got[f"n{i}"] and got[f"k{i}"] / got[f"n{i}"] > threshold}
    return df.select(*[parse_timestamp(F.col(f"`{c}`"), formats).alias(c) if c in convert
                       else F.col(f"`{c}`") for c in df.columns])


def nan_as_null(df: DataFrame) -> DataFrame:
    """NaN in floating columns becomes null: a loaded table has one kind of
    missing value."""
    return df.select(*[present(df, c).alias(c) for c in df.columns])


def load(spark: SparkSession, path: str, dates: bool = True, fmt: str | None = None) -> DataFrame:
    """S1 + S2 + S3 + S4 + S5 in the reference's order, with NaN as null."""
    df = nan_as_null(clean_names(validate(read_any(spark, path, fmt))))
    return infer_dates(df) if dates else df


# --- S6 -------------------------------------------------------------------
def register(spark: SparkSession, name: str, df: DataFrame) -> None:
    df.createOrReplaceTempView(name)


def drop(spark: SparkSession, name: str) -> bool:
    return spark.catalog.dropTempView(name)


def dataset_listing(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """One row per registered dataset: name, rows, columns."""
    parts = []
    for n in names:
        t = spark.table(n)
        parts.append(t.agg(F.count(F.lit(1)).alias("n_rows"))
                      .select(F.lit(n).alias("name"), "n_rows",
                              F.lit(len(t.columns)).cast("bigint").alias("n_columns")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- S7 -------------------------------------------------------------------
def json_rows(df: DataFrame) -> DataFrame:
    """Each row as a JSON record string, the layout of a records export."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("json"))


def export(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> str:
    """Write a table as CSV (header) or JSON lines (S7); distributed writers,
    one file per partition, no pass through the driver."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "json":
        w.json(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise LoadError(f"unsupported export format: {fmt}")
    return path


# --- S8 -------------------------------------------------------------------
def completeness(df: DataFrame) -> Column:
    """Non-null cells / all cells x 100 as one aggregate expression."""
    nn = None
    for c in df.columns:
        e = F.count(present(df, c))
        nn = e if nn is None else nn + e
    return F.coalesce(F.try_divide(nn, F.count(F.lit(1)) * F.lit(len(df.columns))) * 100.0, F.lit(0.0))


def profile_log_row(df: DataFrame, name: str, description: str = "", file_type: str = "parquet") -> DataFrame:
    """One log row for a dataset (S8); append it with ``write.mode('append')``."""
    return df.agg(F.count(F.lit(1)).alias("row_count"), completeness(df).alias("data_quality_score")).select(
        F.lit(name).alias("name"), F.lit(description).alias("description"), F.lit(file_type).alias("file_type"),
        F.current_timestamp().alias("upload_date"), F.col("row_count"),
        F.lit(len(df.columns)).cast("bigint").alias("column_count"), F.col("data_quality_score"))


def newest(log: DataFrame, n: int = 50) -> DataFrame:
    return log.orderBy(F.desc("upload_date"), "name").limit(n)


# --- S9 -------------------------------------------------------------------
def report_overview(df: DataFrame) -> DataFrame:
    """Record / column counts for a report header (S9), one pass; NaN is a
    missing cell."""
    num = [f.name for f in df.schema.fields if is_numeric(f.dataType)]
    nulls = None
    for c in df.columns:
        e = F.sum(F.when(present(df, c).isNull(), 1).otherwise(0))
        nulls = e if nulls is None else nulls + e
    return df.agg(F.count(F.lit(1)).alias("record_count"), nulls.cast("bigint").alias("null_cells")).select(
        "record_count", F.lit(len(df.columns)).cast("bigint").alias("column_count"),
        F.lit(len(num)).cast("bigint").alias("numeric_column_count"), "null_cells")


def report(df: DataFrame, order_by: Sequence[str], rows: int = 100) -> dict[str, DataFrame]:
    """The content of a report as one unit (S9): overview, describe table and
    the first ``rows`` rows in ``order_by`` order."""
    from quarry.operators.aggregates import describe
    from quarry.operators.filters import preview

    return {"overview": report_overview(df), "describe": describe(df), "first_rows": preview(df, order_by, rows)}
