"""Aggregates behind charts and summaries.

Conventions
-----------
* One ``agg`` per operator over all requested columns (one scan, partial +
  final hash aggregation chosen by Spark).
* Group keys drop nulls, as the reference's group-by does (the streaming
  aggregate keeps them; see quarry.streaming).
* Exact quantiles come from sketch brackets or histogram selection
  (``quarry.operators.order``), never from a value map merged in one task; ``approx=True`` switches to
  ``percentile_approx`` for very large inputs.
* Results computed from a one-row aggregate are attached with a broadcast of
  that one row (a proven size).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.stats import clean_double, col_of, finite_double, is_datetime, is_numeric, numeric_columns, pearson, present
from quarry.operators.filters import sample_values
from quarry.operators.order import bracket_exprs, column_quantiles, exact_quantiles, join_small, quantiles_between, with_position

AGGS = ("sum", "mean", "count", "max", "min")


def agg_expr(fn: str, c: Column) -> Column:
    if fn == "sum":
        return F.sum(c)
    if fn in ("mean", "avg"):
        return F.avg(c)
    if fn == "count":
        return F.count(c)
    if fn == "max":
        return F.max(c)
    if fn == "min":
        return F.min(c)
    if fn == "median":
        return F.median(c)
    if fn == "std":
        return F.stddev_samp(c)
    if fn == "nunique":
        return F.count_distinct(c)
    raise ValueError(f"Unknown aggregation: {fn}")


def _nonnull_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    if not keys:
        return df
    return df.where(reduce(lambda a, b: a & b, [col_of(k).isNotNull() for k in keys]))


# --- A1, A2 -------------------------------------------------------------------
def group_agg(df: DataFrame, keys: Sequence[str], value: str, fns: Sequence[str] = ("sum",),
              names: Sequence[str] | None = None) -> DataFrame:
    """Bar chart table: group by x (and colour), aggregate y (A1/A2)."""
    names = list(names or [f"{fn}_{value}" for fn in fns])
    src = _nonnull_keys(df, keys)
    return src.groupBy(*[col_of(k) for k in keys]).agg(
        *[agg_expr(fn, present(df, value)).alias(nm) for fn, nm in zip(fns, names)])


# --- A3, A4 ---------------------------------------------------------------------
def value_counts(df: DataFrame, column: str) -> DataFrame:
    return _nonnull_keys(df, [column]).groupBy(col_of(column)).agg(F.count(F.lit(1)).alias("count"))


def category_totals(df: DataFrame, column: str, value: str, share: bool = True) -> DataFrame:
    """Totals per category plus share of the grand total (A4).  The grand
    total is a one-row aggregate broadcast onto the groups."""
    g = _nonnull_keys(df, [column]).groupBy(col_of(column)).agg(F.sum(present(df, value)).alias("total"))
    if not share:
        return g
    tot = g.agg(F.sum("total").alias("_grand"))
    return g.crossJoin(F.broadcast(tot)).withColumn(
        "share", F.try_divide(F.col("total"), F.col("_grand"))).drop("_grand")


# --- A5 -----------------------------------------------------------------------
def rollup_totals(df: DataFrame, path: Sequence[str], value: str | None = None) -> DataFrame:
    """Hierarchy totals (treemap / sunburst, A5): every level of ``path``
    via ROLLUP, leaf = sum of value or row count; ``level`` = grouping_id.
    Rows with a null path member are dropped first (as the reference's
    group-by drops them)."""
    src = _nonnull_keys(df, path)
    m = F.sum(present(df, value)) if value else F.count(F.lit(1))
    return src.rollup(*[col_of(p) for p in path]).agg(
        m.alias("total"), F.grouping_id().alias("level"))


# --- A6 -----------------------------------------------------------------------
def sankey_edges(df: DataFrame, source: str, target: str) -> DataFrame:
    """Flow edges with node ids shared by sources and targets.

    Node id = position of the label in label order (declared rule; the
    reference numbers by first appearance).  Positions come from the
    distributed position helper, so a large label set is not ranked in one
    task; the two id lookups are size-checked joins."""
    src = _nonnull_keys(df, [source, target])
    edges = src.groupBy(col_of(source).cast("string").alias("source"),
                        col_of(target).cast("string").alias("target")).agg(F.count(F.lit(1)).alias("value"))
    labels = edges.select(F.col("source").alias("label")).union(edges.select(F.col("target").alias("label"))).distinct()
    nodes = with_position(labels, ["label"], pos_col="node_id", n_col=None)
    nodes = nodes.select("label", "node_id")
    out = join_small(edges, nodes.withColumnRenamed("label", "source").withColumnRenamed("node_id", "source_id"),
                     ["source"])
    out = join_small(out, nodes.withColumnRenamed("label", "target").withColumnRenamed("node_id", "target_id"),
                     ["target"])
    return out.select("source", "target", "source_id", "target_id", "value")


# --- A7 -----------------------------------------------------------------------
def metric_cards(df: DataFrame, cards: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Dashboard metric cards in one aggregate (A7).  Each card is
    (name, column, fn) with fn in sum/mean/max; anything else counts the
    non-null values."""
    exprs = []
    for name, column, fn in cards:
        e = agg_expr(fn if fn in ("sum", "mean", "max") else "count", present(df, column))
        exprs.append(e.alias(name))
    return df.agg(*exprs)


# --- A8 -------------------------------------------------------------------------
def _unpivot_stats(df: DataFrame, cols: Sequence[str], stats: Sequence[tuple[str, callable]],
                   types: Sequence[str] | None = None) -> DataFrame:
    """One wide aggregate, then rows (column, stat...).  The aggregate has a
    single row whose size depends on the column count only; it is turned
    into the long table directly instead of through a wide generated
    projection."""
    return _stat_rows(df, cols, stats, types, df.agg(*_stat_exprs(cols, stats)).first())


def _stat_exprs(cols: Sequence[str], stats) -> list[Column]:
    return [fn(clean_double(col_of(c))).alias(f"_{i}_{nm}") for i, c in enumerate(cols) for nm, fn in stats]


def _stat_rows(df: DataFrame, cols: Sequence[str], stats, types, w) -> DataFrame:
    types = list(types or ["double"] * len(stats))
    rows = [(c, *[w[f"_{i}_{nm}"] for nm, _ in stats]) for i, c in enumerate(cols)]
    schema = "column string, " + ", ".join(f"{nm} {t}" for (nm, _), t in zip(stats, types))
    return df.sparkSession.createDataFrame(rows, schema)


def describe(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """count, mean, std (ddof 1), min, 25/50/75 % (linear), max per numeric
    column (A8), one row per column."""
    cols = list(cols or numeric_columns(df))
    stats = [("count", lambda x: F.count(x)), ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max)]
    probs, names = [0.25, 0.5, 0.75], ["p25", "p50", "p75"]
    # one scan for the moments and the brackets of the quartiles, one for the quartiles
    w = df.agg(*_stat_exprs(cols, stats), *([] if approx else bracket_exprs(df, cols, probs))).first()
    base = _stat_rows(df, cols, stats, ["bigint", "double", "double", "double", "double"], w)
    q = quantiles(df, cols, probs, names, approx=True) if approx else quantiles_between(df, cols, probs, names, w).drop("n")
    return base.join(F.broadcast(q), ["column"], "left").select(
        "column", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], names: Sequence[str],
              by: Sequence[str] = (), approx: bool = False) -> DataFrame:
    """(by..., column, names...) quantiles, exact by default."""
    if not approx:
        return column_quantiles(df, cols, probs, by=by, names=names).drop("n")
    parts = []
    for c in cols:
        pa = F.percentile_approx(clean_double(col_of(c)), list(probs), 10000)
        g = df.groupBy(*by).agg(pa.alias("_q")) if by else df.agg(pa.alias("_q"))
        parts.append(g.select(*by, F.lit(c).alias("column"), *[F.col("_q")[i].alias(n) for i, n in enumerate(names)]))
    return reduce(DataFrame.unionByName, parts)


# --- A9, A10 ----------------------------------------------------------------------
def distinct_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, n_distinct): distinct present values of each column.

    A value goes through the shuffle as its column's number and two 64-bit
    hashes, never as itself, so long texts cost as much as numbers; equal
    values of a task are merged before.  128 bits keep any number of values
    apart that a table can hold."""
    cols = list(df.columns if cols is None else cols)
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, n_distinct bigint")
    cells = [F.when(present(df, c).isNotNull(), F.struct(
        F.lit(i).alias("c"), F.xxhash64(col_of(c)).alias("h"), F.xxhash64(F.lit(i), F.lit("again"), col_of(c)).alias("g")))
        for i, c in enumerate(cols)]
    seen = df.select(F.explode(F.array(*cells)).alias("v")).where("v IS NOT NULL").select("v.*").distinct()
    n = seen.groupBy("c").agg(F.count(F.lit(1)).alias("n_distinct"))
    names = df.sparkSession.createDataFrame(list(enumerate(cols)), "c int, column string")
    return names.join(F.broadcast(n), "c", "left").select(  # one row per column on both sides
        "column", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"))


def column_profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """Per column: dtype, null count / %, distinct count, numeric and
    datetime flags, and for numeric columns min/max/mean/std (A9).  One
    aggregate over all columns, and one narrow shuffle for the distinct counts
    (``exact=False``: HyperLogLog++ estimates within the aggregate)."""
    exprs = [F.count(F.lit(1)).alias("_rows")]
    fields = df.schema.fields
    for i, f in enumerate(fields):
        c = present(df, f.name)
        exprs.append(F.count(c).alias(f"_{i}_nn"))
        if not exact:
            exprs.append(F.approx_count_distinct(c, 0.01).alias(f"_{i}_nd"))
        if is_numeric(f.dataType):
            x = clean_double(c)
            exprs += [F.min(x).alias(f"_{i}_min"), F.max(x).alias(f"_{i}_max"),
                      F.avg(x).alias(f"_{i}_mean"), F.stddev_samp(x).alias(f"_{i}_std")]
    w = df.agg(*exprs).first().asDict()  # one row, sized by the column count
    distinct = dict(distinct_counts(df).collect()) if exact else {}  # one row per column
    n = w["_rows"]
    rows = []
    for i, f in enumerate(fields):
        num = is_numeric(f.dataType)
        nulls = n - w[f"_{i}_nn"]
        rows.append((f.name, f.dataType.simpleString(), nulls, (nulls / n * 100.0) if n else None,
                     distinct[f.name] if exact else w[f"_{i}_nd"], num, is_datetime(f.dataType),
                     *[(w[f"_{i}_{k}"] if num else None) for k in ("min", "max", "mean", "std")]))
    return df.sparkSession.createDataFrame(rows, PROFILE_SCHEMA)


def column_details(df: DataFrame, order_by: Sequence[str], k: int = 3) -> DataFrame:
    """What the profile lists beside its numbers (A9): per column whether it has
    nulls, its median (numeric columns) and its first ``k`` present values as
    texts, in the order of ``order_by``."""
    head = sample_values(df, order_by, k).groupBy("column_name").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "value"))), lambda v: v["value"]), " | ")
        .alias("samples"))  # at most k rows per column
    filled = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(present(df, c)).alias(f"_{i}") for i, c in enumerate(df.columns)])
    rows = [F.struct(F.lit(c).alias("column"), (F.col(f"_{i}") < F.col("n")).alias("has_nulls"))
            for i, c in enumerate(df.columns)]
    out = filled.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    out = out.join(F.broadcast(head.withColumnRenamed("column_name", "column")), "column", "left")
    numeric = numeric_columns(df)
    if not numeric:
        return out.withColumn("median", F.lit(None).cast("double"))
    return out.join(F.broadcast(quantiles(df, numeric, [0.5], ["median"])), "column", "left")


PROFILE_SCHEMA = ("column string, dtype string, null_count bigint, null_pct double, unique_count bigint, "
                  "is_numeric boolean, is_datetime boolean, min double, max double, mean double, std double")


def data_quality(df: DataFrame) -> DataFrame:
    """Null count and % per column plus table completeness (A10)."""
    exprs = [F.count(F.lit(1)).alias("_rows")] + [
        F.count(present(df, c)).alias(f"_{i}") for i, c in enumerate(df.columns)]
    wide = df.agg(*exprs)
    k = len(df.columns)
    total_nn = reduce(lambda a, b: a + b, [F.col(f"_{i}") for i in range(k)])
    wide = wide.withColumn("_compl", F.try_divide(total_nn * 100.0, F.col("_rows") * F.lit(k)))
    rows = [F.struct(F.lit(c).alias("column"), (F.col("_rows") - F.col(f"_{i}")).alias("null_count"),
                     (F.try_divide(F.col("_rows") - F.col(f"_{i}"), F.col("_rows")) * 100.0).alias("null_pct"),
                     F.col("_compl").alias("completeness"))
            for i, c in enumerate(df.columns)]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


# --- A11 ------------------------------------------------------------------------
def pivot_mean(df: DataFrame, rows: str, cols: str, value: str, values: Sequence | None = None,
               max_values: int = 50) -> DataFrame:
    """Heatmap table: rows y, one column per x value, mean of value.

    The pivot values are explicit; when not given they are read with a
    bounded distinct.  Above ``max_values`` of them the table comes in long form:
    (rows, cols, mean), one row per pair, whatever their number."""
    src = _nonnull_keys(df, [rows, cols])
    mean = F.avg(present(df, value))
    if values is None:
        vals = [r[0] for r in src.select(col_of(cols)).distinct().limit(max_values + 1).collect()]
        if len(vals) > max_values:
            return src.groupBy(col_of(rows), col_of(cols)).agg(mean.alias("mean"))
        values = sorted(vals)
    return src.groupBy(col_of(rows)).pivot(cols, list(values)).agg(mean)


# --- A12, A13 -------------------------------------------------------------------
def top_category(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Most frequent value per text column and its share of all rows, kept
    only when the column has more than one distinct value (A12).  Ties go to
    the smallest value.  Counting is one group-by over (column, value); the
    pick per column is a min over a struct, partially aggregated."""
    cols = list(columns or [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"])
    arr = F.array(*[F.struct(F.lit(c).alias("column"), col_of(c).cast("string").alias("value")) for c in cols])
    long_df = df.select(F.explode(arr).alias("kv")).select("kv.*")
    total = df.agg(F.count(F.lit(1)).alias("_rows"))
    counts = long_df.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("cnt"))
    best = counts.groupBy("column").agg(
        F.min(F.struct((-F.col("cnt")).alias("neg"), F.col("value"))).alias("b"),
        F.count(F.lit(1)).alias("n_distinct"))
    return (best.where(F.col("n_distinct") > 1).crossJoin(F.broadcast(total))
                .select("column", F.col("b.value").alias("top_value"), (-F.col("b.neg")).alias("count"),
                        (F.col("b.neg") * -100.0 / F.col("_rows")).alias("pct")))


def top_group(df: DataFrame, key: str, value: str) -> DataFrame:
    """Group with the largest total; ties to the smallest key."""
    g = _nonnull_keys(df, [key]).groupBy(col_of(key)).agg(F.sum(present(df, value)).alias("total"))
    return g.orderBy(F.desc("total"), col_of(key)).limit(1)


# --- A14 --------------------------------------------------------------------------
def bin_index(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Equal-width bin 1..bins; the max falls in the last bin; a constant
    column puts everything in bin 1 (declared rule)."""
    raw = F.floor((v - lo) / (hi - lo) * F.lit(bins)) + 1
    return F.when(hi == lo, F.lit(1)).otherwise(F.least(raw, F.lit(bins))).cast("int")


def histogram(df: DataFrame, column: str, bins: int = 30, by: str | None = None) -> DataFrame:
    """Counts per equal-width bin, optionally split by a colour column.
    Min/max come from a one-row aggregate broadcast onto the rows.  The bins
    cover the finite values; infinities are counted in bins 0 and ``bins`` + 1,
    which have no bounds."""
    x = clean_double(col_of(column))
    src = df.select(*([col_of(by).alias(by)] if by else []), x.alias("_v")).where(F.col("_v").isNotNull())
    if by:
        src = src.where(col_of(by).isNotNull())
    finite = finite_double(F.col("_v"))
    mm = src.agg(F.min(finite).alias("_lo"), F.max(finite).alias("_hi"))
    inside = bin_index(finite, F.col("_lo"), F.col("_hi"), bins)
    b = src.crossJoin(F.broadcast(mm)).withColumn("bin", F.when(finite.isNotNull(), inside).when(F.col("_v") < 0, 0).otherwise(bins + 1).cast("int"))
    keys = ([by] if by else []) + ["bin"]
    w = F.when(F.col("bin").between(1, bins), (F.col("_hi") - F.col("_lo")) / F.lit(bins))
    return b.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), F.first("_lo").alias("_lo"),
                                F.first("_hi").alias("_hi")).select(
        *keys, (F.col("_lo") + (F.col("bin") - 1) * w).alias("bin_lo"),
        (F.col("_lo") + F.col("bin") * w).alias("bin_hi"), "count")


# --- A15 ------------------------------------------------------------------------
def box_stats(df: DataFrame, value: str, by: str | None = None) -> DataFrame:
    """Box plot numbers per group (A15): linear quartiles, 1.5 IQR fences,
    whiskers = most extreme values inside the fences, outlier count.
    Exact quartiles first; the second pass joins the (one row per
    group) fences back with a size-checked join."""
    keys = [by] if by else []
    src = df.select(*[col_of(k).alias(k) for k in keys], clean_double(col_of(value)).alias("value"))
    src = _nonnull_keys(src, keys).where(F.col("value").isNotNull())
    q = exact_quantiles(src, [0.25, 0.5, 0.75], keys, names=["q1", "median", "q3"])
    q = (q.withColumn("iqr", F.col("q3") - F.col("q1"))
          .withColumn("lower_fence", F.col("q1") - 1.5 * F.col("iqr"))
          .withColumn("upper_fence", F.col("q3") + 1.5 * F.col("iqr")))
    joined = src.crossJoin(F.broadcast(q)) if not keys else join_small(src, q, keys)
    inside = F.col("value").between(F.col("lower_fence"), F.col("upper_fence"))
    second = joined.groupBy(*keys).agg(
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.sum(F.when(~inside, 1).otherwise(0)).cast("bigint").alias("n_outliers"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    out = q.join(second, keys) if keys else q.crossJoin(second)
    return out.select(*keys, "n", "min", "q1", "median", "q3", "max", "iqr", "lower_fence", "upper_fence",
                      "whisker_low", "whisker_high", "n_outliers")


# --- A16, A17 ----------------------------------------------------------------------
def dist_insight(df: DataFrame, column: str) -> DataFrame:
    """Mean, median, std of one column (A16); median in two scans."""
    m = df.agg(F.avg(clean_double(col_of(column))).alias("mean"),
               F.stddev_samp(clean_double(col_of(column))).alias("std"))
    med = column_quantiles(df, [column], [0.5], names=["median"]).select("median")
    return m.crossJoin(med).select("mean", "median", "std")


def summary_means(df: DataFrame, k: int | None = None) -> DataFrame:
    """Means of the numeric columns (A17), or the first ``k``; long form."""
    cols = numeric_columns(df)[:k]
    return _unpivot_stats(df, cols, [("mean", F.avg)])


# --- A18-A21 ----------------------------------------------------------------------
def _moment_frame(df: DataFrame, cols: Sequence[str]):
    """Pass 1 of the correlation matrix: row count, non-null counts and
    means (the shift that keeps pass-2 sums well conditioned)."""
    xs = [clean_double(col_of(c)) for c in cols]
    r = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(x).alias(f"c{i}") for i, x in enumerate(xs)],
               *[F.avg(x).alias(f"m{i}") for i, x in enumerate(xs)]).first()
    return r, xs


def corr_matrix(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Pairwise-complete Pearson matrix in long form (x, y, r).

    Two scans of plain sums: pass 1
    gives means (a one-row result); pass 2 sums centred products for all
    pairs.  Without nulls that is k(k+1)/2 + k + 1 sums; with nulls each
    pair also sums over its own complete rows (a product is null when either
    side is).  The last step turns the single summary row (its size depends
    on the column count only) into r; a constant column gives null, not an
    error."""
    cols = list(cols or numeric_columns(df))
    k = len(cols)
    first, xs = _moment_frame(df, cols)
    n = first["n"]
    shift = [first[f"m{i}"] if first[f"m{i}"] is not None else 0.0 for i in range(k)]
    d = [xs[i] - F.lit(float(shift[i])) for i in range(k)]
    complete = all(first[f"c{i}"] == n for i in range(k))
    exprs = []
    if complete:
        exprs.append(F.count(F.lit(1)).alias("_n"))
        exprs += [F.sum(d[i]).alias(f"_s{i}") for i in range(k)]
        for i in range(k):
            for j in range(i, k):
                exprs.append(F.sum(d[i] * d[j]).alias(f"_p{i}_{j}"))
    else:
        for i in range(k):
            for j in range(i, k):
                both = d[i] * F.lit(0.0) + d[j] * F.lit(0.0)  # null unless both present
                exprs += [F.count(both).alias(f"_n{i}_{j}"), F.sum(d[i] + both).alias(f"_a{i}_{j}"),
                          F.sum(d[j] + both).alias(f"_b{i}_{j}"), F.sum(d[i] * d[i] + both).alias(f"_aa{i}_{j}"),
                          F.sum(d[j] * d[j] + both).alias(f"_bb{i}_{j}"), F.sum(d[i] * d[j]).alias(f"_ab{i}_{j}")]
    # one row of k(k+1)/2 + k + 1 (or 6 per pair) sums: bounded by the column count
    w = df.agg(*exprs).first().asDict()

    def moments(i, j):
        a_, b_ = min(i, j), max(i, j)
        if complete:
            return w["_n"], w[f"_s{i}"], w[f"_s{j}"], w[f"_p{i}_{i}"], w[f"_p{j}_{j}"], w[f"_p{a_}_{b_}"]
        sw = i > j
        return (w[f"_n{a_}_{b_}"], w[f"_{'b' if sw else 'a'}{a_}_{b_}"], w[f"_{'a' if sw else 'b'}{a_}_{b_}"],
                w[f"_{'bb' if sw else 'aa'}{a_}_{b_}"], w[f"_{'aa' if sw else 'bb'}{a_}_{b_}"], w[f"_ab{a_}_{b_}"])

    def r_of(i, j):
        nn, a_, b_, aa, bb, ab = moments(i, j)
        if not nn or any(v is None for v in (a_, b_, aa, bb, ab)):
            return None
        cab, caa, cbb = ab - a_ * b_ / nn, aa - a_ * a_ / nn, bb - b_ * b_ / nn
        if caa <= 0 or cbb <= 0:  # constant column (or one that cancels to zero)
            return None
        return max(-1.0, min(1.0, cab / math.sqrt(caa * cbb)))

    rows = [(cols[i], cols[j], r_of(i, j)) for i in range(k) for j in range(k)]
    return df.sparkSession.createDataFrame(rows, "x string, y string, r double")


def corr_pairs(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Upper-triangle pairs (x before y in column order) with r."""
    cols = list(cols or numeric_columns(df))
    order = {c: i for i, c in enumerate(cols)}
    m = corr_matrix(df, cols)
    idx = F.create_map(*[x for c, i in order.items() for x in (F.lit(c), F.lit(i))])
    return m.where(idx[F.col("x")] < idx[F.col("y")])


def top_corr_pairs(df: DataFrame, k_cols: int | None = None, top: int = 8) -> DataFrame:
    """Top pairs by |r| over the numeric columns (A19), or the first ``k_cols``."""
    cols = numeric_columns(df)[:k_cols]
    return corr_pairs(df, cols).where(F.col("r").isNotNull()).orderBy(
        F.desc(F.abs("r")), "x", "y").limit(top)


def strong_corr(df: DataFrame, threshold: float = 0.7, cols: Sequence[str] | None = None) -> DataFrame:
    """Pairs with |r| > threshold and their sign."""
    p = corr_pairs(df, cols).where(F.abs("r") > threshold)
    return p.withColumn("direction", F.when(F.col("r") > 0, "positive").otherwise("negative"))


def pair_corr(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(pearson(col_of(x), col_of(y)).alias("r"))
