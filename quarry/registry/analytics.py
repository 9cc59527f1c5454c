"""Registry entries: profiles, outliers, trends, formulas, joins, chart plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import formulas as FM
from quarry.operators import joins as J
from quarry.operators import profile as R
from quarry.plans import spec as PL
from quarry.registry.common import LINEITEM_ORDER, NUMERIC, r, round_all, t

Q: dict = {}
SQL: dict = {}


def q(name, sql=None):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


# ------------------------------------------------------------ roles
_TYPES = {
    "customer": [("c_custkey", "num"), ("c_name", "str"), ("c_nationkey", "num"), ("c_acctbal", "num"),
                 ("c_mktsegment", "str")],
    "documents": [("doc_id", "num"), ("text", "str"), ("lang", "str"), ("source", "str"), ("n_chars", "num")],
    "lineitem": [(c, "num") for c in NUMERIC["lineitem"]] + [("l_returnflag", "str"), ("l_linestatus", "str"),
                                                             ("l_shipdate", "ts")],
}


def _role_sql(table, c, kind):
    if kind == "num":
        if R.name_means(c, "latitude"):
            return "'latitude'"
        if R.name_means(c, "longitude"):
            return "'longitude'"
        return f"CASE WHEN count(DISTINCT {c}) <= 12 AND count(*) < 5000 THEN 'numeric_code' ELSE 'numeric_measure' END"
    if kind == "ts":
        return "'datetime'"
    ident = R.name_means(c, "identifier")
    head = f"WHEN {str(ident).upper()} AND count(DISTINCT {c}) >= greatest(3, count(*) * 0.85) THEN 'identifier' "
    if R.name_means(c, "place"):
        return f"CASE {head}ELSE 'location_text' END"
    return (f"CASE {head}WHEN count({c}) = 0 THEN 'mostly_empty' "
            f"WHEN avg(length({c})) > 48 AND count(DISTINCT {c}) > least(50, count(*) * 0.2) THEN 'free_text' "
            f"WHEN count(DISTINCT {c}) <= least(24, greatest(2, floor(count(*) / 10))) THEN 'category' "
            f"ELSE 'text_or_category' END")


def _roles_sql(table):
    return " UNION ALL ".join(f"SELECT '{table}' AS table_name, '{c}' AS column, {_role_sql(table, c, k)} AS role "
                              f"FROM {table}" for c, k in _TYPES[table])


@q("column_roles", _roles_sql("customer") + " UNION ALL " + _roles_sql("documents"))
def column_roles(spark, sf):
    a = R.column_roles(t(spark, sf, "customer")).select(F.lit("customer").alias("table_name"), "*")
    b = R.column_roles(t(spark, sf, "documents")).select(F.lit("documents").alias("table_name"), "*")
    return a.unionByName(b)


@q("data_digest", f"""
WITH roles AS ({_roles_sql("customer")})
SELECT (SELECT CAST(count(*) AS BIGINT) FROM customer) AS n_rows, CAST(5 AS BIGINT) AS n_columns,
       CAST(sum(CASE WHEN role = 'numeric_measure' THEN 1 ELSE 0 END) AS BIGINT) AS n_numeric_measure,
       CAST(sum(CASE WHEN role = 'category' THEN 1 ELSE 0 END) AS BIGINT) AS n_category,
       CAST(sum(CASE WHEN role = 'datetime' THEN 1 ELSE 0 END) AS BIGINT) AS n_datetime,
       FALSE AS has_coords, '' AS location_columns
FROM roles""")
def data_digest(spark, sf):
    return R.data_digest(t(spark, sf, "customer"))


# ------------------------------------------------------------ outliers
@q("anomaly_iqr", """
SELECT event_id, event_type, value FROM events,
  (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events) b
WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""")
def anomaly_iqr(spark, sf):
    return R.anomalies(t(spark, sf, "events"), "value").select("event_id", "event_type", "value")


def _anom_counts_sql(table, cols):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column, CAST(count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))"
        f" AS BIGINT) AS anomaly_rows, "
        f"round(count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) * 100.0 / count(*), 6)"
        f" AS pct FROM {table}, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {table}) b"
        for c in cols)


@q("anomaly_counts", _anom_counts_sql("events", NUMERIC["events"]))
def anomaly_counts(spark, sf):
    return round_all(R.anomaly_counts(t(spark, sf, "events")))


def _corr_pairs_sql(table, cols):
    return " UNION ALL ".join(f"SELECT '{cols[i]}' AS x, '{cols[j]}' AS y, corr({cols[i]}, {cols[j]}) AS r FROM {table}"
                              for i in range(len(cols)) for j in range(i + 1, len(cols)))


@q("auto_summary", f"""
SELECT 'anomaly' AS kind, "column" AS a, '' AS b, round(CAST(anomaly_rows AS DOUBLE), 6) AS value
  FROM ({_anom_counts_sql("lineitem", NUMERIC["lineitem"])})
UNION ALL
SELECT 'corr', x, y, round(r, 6) FROM (SELECT * FROM ({_corr_pairs_sql("lineitem", NUMERIC["lineitem"])})
  WHERE r IS NOT NULL ORDER BY abs(r) DESC, x, y LIMIT 8)
UNION ALL
SELECT 'role', role, '', round(CAST(count(*) AS DOUBLE), 6) FROM (
  {" UNION ALL ".join(f"SELECT {_role_sql('lineitem', c, k)} AS role" + (" FROM lineitem" if k != "ts" else "")
                      for c, k in _TYPES["lineitem"])})
GROUP BY role""")
def auto_summary(spark, sf):
    return round_all(R.auto_summary(t(spark, sf, "lineitem")))


@q("insights")
def insights(spark, sf):
    return R.insights(t(spark, sf, "orders"), "o_orderdate", ["o_orderkey"])


# ------------------------------------------------------------ trend
@q("trend_slope", """
WITH p AS (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos FROM orders)
SELECT "column", round(slope, 6) AS slope, CASE WHEN slope > 0 THEN 'increasing' ELSE 'decreasing' END AS direction,
       coalesce(abs(slope) > 0.01, FALSE) AS reported FROM (
  SELECT 'o_orderkey' AS "column", regr_slope(coalesce(CAST(o_orderkey AS DOUBLE), 0), pos) AS slope FROM p
  UNION ALL
  SELECT 'o_custkey', regr_slope(coalesce(CAST(o_custkey AS DOUBLE), 0), pos) FROM p
  UNION ALL
  SELECT 'o_totalprice', regr_slope(coalesce(o_totalprice, 0), pos) FROM p)""")
def trend_slope(spark, sf):
    return R.trend_slopes(t(spark, sf, "orders"), "o_orderdate", ["o_orderkey"]).withColumn("slope", r("slope"))


# ------------------------------------------------------------ formulas
_ARITH = "([l_extendedprice] * (1 - [l_discount])) % 7 + [l_quantity] / ([l_linenumber] - 1) - 2 ** 3"


@q("formula_arith", """
SELECT l_orderkey, l_linenumber,
  round(((l_extendedprice * (1 - l_discount)) - 7 * floor((l_extendedprice * (1 - l_discount)) / 7))
        + l_quantity / nullif(CAST(l_linenumber - 1 AS DOUBLE), 0) - pow(2, 3), 6) AS result
FROM lineitem""")
def formula_arith(spark, sf):
    li = t(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", r(FM.compile_formula(_ARITH, li).col).alias("result"))


@q("formula_compare", """
SELECT l_orderkey, l_linenumber, (0.02 < l_discount AND l_discount <= 0.06) AS result FROM lineitem""")
def formula_compare(spark, sf):
    li = t(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", FM.compile_formula("0.02 < [l_discount] <= 0.06", li).col.alias("result"))


_CASES = [{"condition": "[l_quantity] > 40", "value": "'bulk'"},
          {"condition": "[l_quantity] > 10 and [l_discount] < 0.05 or not [l_returnflag] == 'N'", "value": "'regular'"},
          {"condition": "[l_quantity] > 0", "value": "'small'"}]


@q("formula_case", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 40 THEN 'bulk'
  WHEN (l_quantity > 10 AND l_discount < 0.05) OR NOT (l_returnflag = 'N') THEN 'regular' ELSE 'small' END AS result
FROM lineitem""")
def formula_case(spark, sf):
    li = t(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", FM.conditional_column(_CASES, li).alias("result"))


@q("formula_concat", """
SELECT l_orderkey, l_linenumber, l_returnflag || '-' || l_linestatus AS result FROM lineitem""")
def formula_concat(spark, sf):
    li = t(spark, sf, "lineitem")
    c = FM.compile_formula("[l_returnflag] + '-' + [l_linestatus]", li)
    return li.select("l_orderkey", "l_linenumber", c.col.alias("result"))


@q("formula_global_agg", """
SELECT l_orderkey, l_linenumber, round(quantile_cont(l_extendedprice, 0.5) OVER (), 4) AS median_price FROM lineitem""")
def formula_global_agg(spark, sf):
    li = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    out = FM.with_aggregate(li, "median_price", "l_extendedprice", "median")
    return out.select("l_orderkey", "l_linenumber", r("median_price", 4).alias("median_price"))


@q("formula_group_agg", """
SELECT l_orderkey, l_linenumber, l_returnflag,
  round(CASE WHEN l_returnflag IS NULL THEN NULL ELSE avg(l_extendedprice) OVER (PARTITION BY l_returnflag) END, 6)
    AS mean_price
FROM lineitem""")
def formula_group_agg(spark, sf):
    li = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice")
    out = FM.with_aggregate(li, "mean_price", "l_extendedprice", "mean", group_by="l_returnflag")
    return out.select("l_orderkey", "l_linenumber", "l_returnflag", r("mean_price").alias("mean_price"))


@q("formula_group_nunique", """
SELECT l.l_orderkey, l.l_linenumber, l.l_suppkey, CAST(g.parts AS BIGINT) AS parts FROM lineitem l LEFT JOIN
  (SELECT l_suppkey, count(DISTINCT l_partkey) AS parts FROM lineitem WHERE l_suppkey IS NOT NULL GROUP BY 1) g
  ON l.l_suppkey = g.l_suppkey""")
def formula_group_nunique(spark, sf):
    li = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    out = FM.with_aggregate(li, "parts", "l_partkey", "nunique", group_by="l_suppkey")
    return out.select("l_orderkey", "l_linenumber", "l_suppkey", "parts")


def _formula_set():
    fs = (FM.FormulaSet()
          .add_arithmetic("net_price", "[l_extendedprice] * (1 - [l_discount])")
          .add_conditional("size_class", _CASES)
          .add_string("flag_status", "[l_returnflag] + '/' + [l_linestatus]")
          .add_aggregation("avg_net", "net_price_result", "mean", group_by="l_returnflag"))
    return FM.FormulaSet.from_json(fs.to_json())  # exported and re-imported


@q("formula_set", """
WITH b AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_extendedprice * (1 - l_discount) AS net,
  CASE WHEN l_quantity > 40 THEN 'bulk'
  WHEN (l_quantity > 10 AND l_discount < 0.05) OR NOT (l_returnflag = 'N') THEN 'regular' ELSE 'small' END AS sc,
  l_returnflag || '/' || l_linestatus AS fs FROM lineitem)
SELECT l_orderkey, l_linenumber, round(net, 6) AS net_price_result, sc AS size_class_result, fs AS flag_status_result,
  round(avg(net) OVER (PARTITION BY l_returnflag), 6) AS avg_net_result FROM b""")
def formula_set(spark, sf):
    li = t(spark, sf, "lineitem")
    out = _formula_set().apply(li)
    return out.select("l_orderkey", "l_linenumber", r("net_price_result").alias("net_price_result"),
                      "size_class_result", "flag_status_result", r("avg_net_result").alias("avg_net_result"))


# ------------------------------------------------------------ joins
@q("geo_lookup_join", """
SELECT c_custkey, c_nationkey, lat AS dv_latitude, lon AS dv_longitude FROM customer LEFT JOIN
  (SELECT trim(CAST(n_nationkey AS VARCHAR)) AS place, n_nationkey * 3.5 - 40.0 AS lat, n_regionkey * 30.0 - 60.0 AS lon
   FROM nation WHERE n_nationkey < 20) g ON trim(CAST(c_nationkey AS VARCHAR)) = g.place""")
def geo_lookup_join(spark, sf):
    nat = t(spark, sf, "nation").where("n_nationkey < 20")
    lookup = nat.select(F.col("n_nationkey").alias("place"), (F.col("n_nationkey") * 3.5 - 40.0).alias("lat"),
                        (F.col("n_regionkey") * 30.0 - 60.0).alias("lon"))
    cu = t(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return J.attach_coordinates(cu, "c_nationkey", lookup)


# ------------------------------------------------------------ chart plans
SPEC = {"chart_type": "bar", "x_column": "l_returnflag", "y_column": "l_extendedprice",
        "color_column": "l_linestatus", "aggregation": "sum", "filters": {"l_linenumber": "1"}}


@q("spec_query", """
SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice), 2) AS sum_l_extendedprice FROM lineitem
WHERE l_linenumber = 1 AND l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY 1, 2""")
def spec_query(spark, sf):
    out = PL.run_spec(t(spark, sf, "lineitem"), SPEC)
    return out.withColumn("sum_l_extendedprice", r("sum_l_extendedprice", 2))


@q("chart_recommendations", """
SELECT * FROM (VALUES (1, 'line', 'Time Series: o_orderkey over time', 'high'),
  (2, 'histogram', 'Distribution: o_orderkey', 'high'), (3, 'heatmap', 'Correlation Matrix', 'high'),
  (4, 'bar', 'o_orderstatus vs o_orderkey', 'high'), (5, 'box', 'Outlier Detection: o_orderkey by o_orderstatus', 'medium'),
  (6, 'scatter', 'o_orderkey vs o_custkey', 'medium'), (7, 'pie', 'Distribution of o_orderstatus', 'medium'),
  (8, 'scatter_3d', '3D Scatter Plot Analysis', 'low')) v(rank, chart_type, title, priority)
JOIN (SELECT 1 AS rank, CAST(count(*) AS BIGINT) AS result_rows FROM orders
  UNION ALL SELECT 2, CAST(count(DISTINCT CASE WHEN mx = mn THEN 1 ELSE least(floor((o_orderkey - mn) / (mx - mn) * 30) + 1, 30) END) AS BIGINT)
    FROM orders, (SELECT min(o_orderkey) AS mn, max(o_orderkey) AS mx FROM orders) m WHERE o_orderkey IS NOT NULL
  UNION ALL SELECT 3, CAST(9 AS BIGINT)
  UNION ALL SELECT 4, CAST(count(DISTINCT o_orderstatus) AS BIGINT) FROM orders
  UNION ALL SELECT 5, CAST(count(DISTINCT o_orderstatus) AS BIGINT) FROM orders
  UNION ALL SELECT 6, CAST(count(*) AS BIGINT) FROM orders
  UNION ALL SELECT 7, CAST(count(DISTINCT o_orderstatus) AS BIGINT) FROM orders
  UNION ALL SELECT 8, CAST(count(*) AS BIGINT) FROM orders) c USING (rank)""")
def chart_recommendations(spark, sf):
    return PL.recommendation_tables(t(spark, sf, "orders"), ["o_orderkey"])


@q("auto_dashboard", """
SELECT 'summary' AS component, CAST(3 AS BIGINT) AS rows
UNION ALL
SELECT 'histogram', CAST(count(DISTINCT CASE WHEN mx = mn THEN 1
         ELSE least(floor((o_orderkey - mn) / (mx - mn) * 30) + 1, 30) END) AS BIGINT)
  FROM orders, (SELECT min(o_orderkey) AS mn, max(o_orderkey) AS mx FROM orders) m WHERE o_orderkey IS NOT NULL
UNION ALL
SELECT 'correlation', CAST(9 AS BIGINT)
UNION ALL
SELECT 'categories', CAST(count(DISTINCT o_orderstatus) AS BIGINT) FROM orders
UNION ALL
SELECT 'line', CAST(count(DISTINCT date_trunc('day', o_orderdate)) AS BIGINT) FROM orders""")
def auto_dashboard(spark, sf):
    return PL.dashboard_sizes(t(spark, sf, "orders"), ["o_orderkey"])


@q("waterfall", """
SELECT o_orderpriority, round(total, 2) AS total,
       round(sum(total) OVER (ORDER BY o_orderpriority ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running_total
FROM (SELECT o_orderpriority, sum(o_totalprice) AS total FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1)""")
def waterfall(spark, sf):
    w = PL.waterfall(t(spark, sf, "orders"), "o_orderpriority", "o_totalprice")
    return w.select("o_orderpriority", r("total", 2).alias("total"), r("running_total", 2).alias("running_total"))


@q("line_series", """
SELECT date_trunc('day', o_orderdate) AS o_orderdate, o_orderstatus, round(sum(o_totalprice), 2) AS sum_o_totalprice
FROM orders WHERE o_orderdate IS NOT NULL AND o_orderstatus IS NOT NULL GROUP BY 1, 2""")
def line_series(spark, sf):
    out = PL.line_series(t(spark, sf, "orders"), "o_orderdate", "o_totalprice", "o_orderstatus")
    return out.withColumn("sum_o_totalprice", r("sum_o_totalprice", 2))


@q("scatter_points", "SELECT l_quantity, l_extendedprice, l_returnflag FROM lineitem")
def scatter_points(spark, sf):
    spec = {"chart_type": "scatter", "x_column": "l_quantity", "y_column": "l_extendedprice",
            "color_column": "l_returnflag"}
    return PL.run_spec(t(spark, sf, "lineitem"), spec, LINEITEM_ORDER)


# ------------------------------------------------------------ one key per chart type, on values (Q1)
@q("spec_pie", "SELECT o_orderstatus, count(*) AS count FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY 1")
def spec_pie(spark, sf):
    return PL.run_spec(t(spark, sf, "orders"), {"chart_type": "pie", "x_column": "o_orderstatus"})


@q("spec_heatmap_pair", "SELECT 'o_custkey' AS x, 'o_totalprice' AS y, round(corr(o_custkey, o_totalprice), 6) AS r FROM orders")
def spec_heatmap_pair(spark, sf):
    spec = {"chart_type": "heatmap", "x_column": "o_custkey", "y_column": "o_totalprice"}
    return round_all(PL.run_spec(t(spark, sf, "orders"), spec))


@q("spec_heatmap_categories", """
SELECT o_orderstatus, o_orderpriority, round(avg(o_orderkey), 6) AS mean_o_orderkey FROM orders
WHERE o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL GROUP BY 1, 2""")
def spec_heatmap_categories(spark, sf):
    spec = {"chart_type": "heatmap", "x_column": "o_orderstatus", "y_column": "o_orderpriority"}
    return round_all(PL.run_spec(t(spark, sf, "orders"), spec))


@q("spec_line_points", "SELECT o_orderdate, o_orderstatus, o_totalprice FROM orders")
def spec_line_points(spark, sf):
    spec = {"chart_type": "line", "x_column": "o_orderdate", "y_column": "o_totalprice", "color_column": "o_orderstatus"}
    return PL.run_spec(t(spark, sf, "orders"), spec, ["o_orderkey"])


@q("spec_box_colour", """
SELECT o_orderstatus, o_orderpriority, CAST(count(o_totalprice) AS BIGINT) AS n,
       round(quantile_cont(o_totalprice, 0.5), 4) AS median
FROM orders WHERE o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL GROUP BY 1, 2""")
def spec_box_colour(spark, sf):
    spec = {"chart_type": "box", "x_column": "o_orderstatus", "y_column": "o_totalprice", "color_column": "o_orderpriority"}
    out = PL.run_spec(t(spark, sf, "orders"), spec)
    return out.select("o_orderstatus", "o_orderpriority", F.col("n").cast("bigint").alias("n"), r("median", 4).alias("median"))


# ------------------------------------------------------------ names (R1, R2) and rejected formulas (F8)
@q("column_meanings", """
SELECT v.*, CAST(count(c.c_custkey) AS BIGINT) AS n_filled
FROM (VALUES ('c_nationkey', FALSE, FALSE, FALSE), ('city name', FALSE, FALSE, TRUE), ('store-lat', TRUE, FALSE, FALSE),
  ('lng', FALSE, TRUE, FALSE), ('Latest', FALSE, FALSE, FALSE), ('zip_code', FALSE, FALSE, TRUE)) v("column", latitude, longitude, place),
  customer c GROUP BY ALL""")
def column_meanings(spark, sf):
    c = t(spark, sf, "customer")
    return R.column_meanings(c.select(
        "c_nationkey", F.col("c_name").alias("city name"), F.col("c_acctbal").alias("store-lat"), F.col("c_acctbal").alias("lng"),
        F.col("c_custkey").alias("Latest"), F.col("c_custkey").alias("zip_code")))


_MISSING = "CASE WHEN value > 20 AND event_id % 3 = 0 THEN NULL ELSE value END"


def _with_nan(spark, sf):
    """events with NaN in place of some values."""
    e = t(spark, sf, "events")
    return e.withColumn("value", F.when((F.col("value") > 20) & (F.col("event_id") % 3 == 0), F.lit(float("nan"))).otherwise(F.col("value")))


@q("missing_group_agg", f"""
SELECT event_type, round(sum(v), 2) AS total, round(avg(v), 4) AS mean, CAST(count(v) AS BIGINT) AS n, max(v) AS top
FROM (SELECT event_type, {_MISSING} AS v FROM events) WHERE event_type IS NOT NULL GROUP BY 1""")
def missing_group_agg(spark, sf):
    from quarry.operators import aggregates as A

    out = A.group_agg(_with_nan(spark, sf), ["event_type"], "value", ["sum", "mean", "count", "max"], ["total", "mean", "n", "top"])
    return out.withColumn("total", r("total", 2)).withColumn("mean", r("mean", 4))


@q("missing_anomalies", f"""
WITH e AS (SELECT event_id, {_MISSING} AS v FROM events),
b AS (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM e)
SELECT event_id, v AS value FROM e, b WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)""")
def missing_anomalies(spark, sf):
    return R.anomalies(_with_nan(spark, sf), "value").select("event_id", "value")


@q("missing_top_group", f"""
SELECT event_type, round(sum(v), 2) AS total FROM (SELECT event_type, {_MISSING} AS v FROM events) WHERE event_type IS NOT NULL
GROUP BY 1 ORDER BY sum(v) DESC, event_type LIMIT 1""")
def missing_top_group(spark, sf):
    from quarry.operators import aggregates as A

    return A.top_group(_with_nan(spark, sf), "event_type", "value").withColumn("total", r("total", 2))


def _with_infinity(spark, sf):
    """events with NaN, and infinities in place of some small values."""
    return _with_nan(spark, sf).withColumn("value", F.when(F.col("event_id") % 50 == 0, F.lit(float("inf"))).when(
        F.col("event_id") % 77 == 0, F.lit(float("-inf"))).otherwise(F.col("value")))


_ODD = f"""SELECT event_id, event_type, CASE WHEN event_id % 50 = 0 THEN 'inf'::DOUBLE WHEN event_id % 77 = 0 THEN '-inf'::DOUBLE ELSE {_MISSING} END AS v
FROM events"""


@q("missing_histogram", f"""
WITH e AS ({_ODD}), m AS (SELECT min(v) AS lo, max(v) AS hi FROM e WHERE isfinite(v)),
b AS (SELECT lo, hi, CASE WHEN v = 'inf'::DOUBLE THEN 31 WHEN v = '-inf'::DOUBLE THEN 0
                          ELSE least(CAST(floor((v - lo) / (hi - lo) * 30) AS INTEGER) + 1, 30) END AS bin FROM e, m WHERE v IS NOT NULL)
SELECT CAST(bin AS INTEGER) AS bin, CASE WHEN bin BETWEEN 1 AND 30 THEN round(any_value(lo) + (bin - 1) * (any_value(hi) - any_value(lo)) / 30, 6) END AS bin_lo,
       CASE WHEN bin BETWEEN 1 AND 30 THEN round(any_value(lo) + bin * (any_value(hi) - any_value(lo)) / 30, 6) END AS bin_hi, CAST(count(*) AS BIGINT) AS count
FROM b GROUP BY bin""")
def missing_histogram(spark, sf):
    from quarry.operators import aggregates as A

    h = A.histogram(_with_infinity(spark, sf), "value")
    return h.withColumn("bin_lo", r("bin_lo")).withColumn("bin_hi", r("bin_hi"))


@q("missing_zscore", f"""
WITH e AS (SELECT * FROM ({_ODD}) WHERE isfinite(v)), s AS (SELECT event_type, avg(v) AS m, stddev_pop(v) AS d, count(*) AS n FROM e GROUP BY 1)
SELECT event_id, round(abs((v - m) / d), 6) AS anomaly_score FROM e JOIN s USING (event_type) WHERE n >= 2 AND d > 0 AND abs((v - m) / d) > 1.5""")
def missing_zscore(spark, sf):
    from quarry.streaming import streams as ST

    z = ST.zscore_anomalies(_with_infinity(spark, sf).withColumn("stream_id", F.col("event_type")), "value", 1.5)
    return z.select("event_id", r("anomaly_score").alias("anomaly_score"))


@q("missing_pivot_long", f"""
SELECT event_type, user_id, round(avg(v), 6) AS mean FROM (SELECT event_type, user_id, {_MISSING} AS v FROM events)
WHERE event_type IS NOT NULL AND user_id IS NOT NULL GROUP BY 1, 2""")
def missing_pivot_long(spark, sf):
    """More columns than a table can show: the long form."""
    from quarry.operators import aggregates as A

    return A.pivot_mean(_with_nan(spark, sf), "event_type", "user_id", "value", max_values=1).withColumn("mean", r("mean"))


@q("missing_cells", f"""
SELECT CAST(count(*) AS BIGINT) AS record_count, CAST(6 AS BIGINT) AS column_count, CAST(3 AS BIGINT) AS numeric_column_count,
       CAST(sum(CASE WHEN {_MISSING} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_cells FROM events""")
def missing_cells(spark, sf):
    from quarry.sources import io as S

    return S.report_overview(_with_nan(spark, sf))


@q("missing_quality", f"""
SELECT 'value' AS column, CAST(sum(CASE WHEN {_MISSING} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_count FROM events""")
def missing_quality(spark, sf):
    from quarry.operators import aggregates as A

    return A.data_quality(_with_nan(spark, sf)).where("column = 'value'").select("column", "null_count")
