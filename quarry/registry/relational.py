"""Registry entries: sources, filters and aggregates (S, P, A rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import aggregates as A
from quarry.operators import filters as P
from quarry.registry.common import LINEITEM_ORDER, NUMERIC, SCHEMAS, r, round_all, sr, t
from quarry.session import TABLES, register_tables
from quarry.sources import io as S

Q: dict = {}
SQL: dict = {}


def q(name, sql=None):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


LI_ORDER_SQL = ", ".join(LINEITEM_ORDER)


# ---------------------------------------------------------------- sources
@q("infer_dates", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
       CAST(CAST(o_orderdate AS VARCHAR) AS TIMESTAMP) AS o_orderdate, o_orderpriority
FROM orders""")
def infer_dates(spark, sf):
    o = t(spark, sf, "orders")
    as_text = o.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return S.infer_dates(as_text)


@q("dataset_listing", " UNION ALL ".join(
    f"SELECT '{n}' AS name, CAST(count(*) AS BIGINT) AS n_rows, CAST({len(SCHEMAS[n])} AS BIGINT) AS n_columns FROM {n}"
    for n in TABLES))
def dataset_listing(spark, sf):
    names = register_tables(spark, sf)
    return S.dataset_listing(spark, names)


@q("export_json_rows")
def export_json_rows(spark, sf):
    return S.json_rows(t(spark, sf, "orders"))


def _quality_sql():
    parts = []
    for n in TABLES:
        nn = " + ".join(f"count({c})" for c in SCHEMAS[n])
        k = len(SCHEMAS[n])
        parts.append(f"SELECT '{n}' AS name, 'parquet' AS file_type, CAST(count(*) AS BIGINT) AS row_count, "
                     f"CAST({k} AS BIGINT) AS column_count, "
                     f"{sr(f'({nn}) * 100.0 / (count(*) * {k})')} AS data_quality_score FROM {n}")
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") ORDER BY name LIMIT 50"


@q("dataset_quality_log", _quality_sql())
def dataset_quality_log(spark, sf):
    logs = None
    for n in TABLES:
        row = S.profile_log_row(t(spark, sf, n), n, file_type="parquet")
        logs = row if logs is None else logs.unionByName(row)
    top = S.newest(logs, 50)
    return top.select("name", "file_type", "row_count", "column_count", r("data_quality_score").alias("data_quality_score"))


@q("report_overview", """
SELECT CAST(count(*) AS BIGINT) AS record_count, CAST(11 AS BIGINT) AS column_count,
       CAST(8 AS BIGINT) AS numeric_column_count,
       CAST(""" + " + ".join(f"sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)" for c in SCHEMAS["lineitem"]) +
   """ AS BIGINT) AS null_cells
FROM lineitem""")
def report_overview(spark, sf):
    return S.report_overview(t(spark, sf, "lineitem"))


# ---------------------------------------------------------------- filters
@q("filter_eq", f"""
SELECT l.*, c.matched_count FROM
  (SELECT * FROM lineitem WHERE l_returnflag = 'R' ORDER BY {LI_ORDER_SQL} LIMIT 100) l,
  (SELECT CAST(count(*) AS BIGINT) AS matched_count FROM lineitem WHERE l_returnflag = 'R') c""")
def filter_eq(spark, sf):
    return P.filter_eq(t(spark, sf, "lineitem"), "l_returnflag", "R", LINEITEM_ORDER, 100)


@q("filter_eq_typed", f"""
SELECT l.*, c.matched_count FROM
  (SELECT * FROM lineitem WHERE l_linenumber = 3 ORDER BY {LI_ORDER_SQL} LIMIT 100) l,
  (SELECT CAST(count(*) AS BIGINT) AS matched_count FROM lineitem WHERE l_linenumber = 3) c""")
def filter_eq_typed(spark, sf):
    # the value arrives as text and is cast to the int column's type
    return P.filter_eq(t(spark, sf, "lineitem"), "l_linenumber", "3", LINEITEM_ORDER, 100)


@q("filter_in", """
SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_quantity
FROM lineitem WHERE l_returnflag IN ('A', 'N')""")
def filter_in(spark, sf):
    li = t(spark, sf, "lineitem")
    return li.where(P.in_predicate(li, "l_returnflag", ["A", "N"])).select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity")


@q("filter_range", """
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, lo, hi FROM lineitem,
  (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem) b
WHERE l_quantity BETWEEN lo + 10 AND hi - 10""")
def filter_range(spark, sf):
    li = t(spark, sf, "lineitem")
    lo, hi = P.column_bounds(li, "l_quantity")
    out = li.where(P.range_predicate("l_quantity", lo + 10, hi - 10))
    return out.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
                      F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))


@q("filter_multi", """
SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_quantity, l_discount
FROM lineitem
WHERE l_returnflag IN ('R', 'A') AND l_quantity BETWEEN 5 AND 20 AND l_discount BETWEEN 0.02 AND 0.06
  AND l_linestatus = 'F'""")
def filter_multi(spark, sf):
    li = t(spark, sf, "lineitem")
    out = P.filter_multi(li, in_filters={"l_returnflag": ["R", "A"]},
                         ranges={"l_quantity": (5, 20), "l_discount": (0.02, 0.06)},
                         eq={"l_linestatus": "F"})
    return out.select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity", "l_discount")


# synthetic coordinates derived from customer keys (some outside the valid box)
_LAT = "((c_custkey * 37) % 211) - 105.0"
_LON = "((c_custkey * 53) % 401) - 200.0"


@q("geo_valid_points", f"""
SELECT c_custkey, lat, lon FROM (SELECT c_custkey, {_LAT} AS lat, {_LON} AS lon FROM customer)
WHERE lat IS NOT NULL AND lon IS NOT NULL AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180""")
def geo_valid_points(spark, sf):
    cu = t(spark, sf, "customer").select("c_custkey", F.expr(_LAT).alias("lat"), F.expr(_LON).alias("lon"))
    return P.valid_points(cu, "lat", "lon")


@q("numeric_projection", "SELECT " + ", ".join(NUMERIC["lineitem"]) + " FROM lineitem")
def numeric_projection(spark, sf):
    return P.project_family(t(spark, sf, "lineitem"), "numeric")


@q("preview", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 100")
def preview(spark, sf):
    return P.preview(t(spark, sf, "orders"), ["o_orderkey"], 100)


@q("sample_n")
def sample_n(spark, sf):
    return P.sample_n(t(spark, sf, "lineitem"), 10000, LINEITEM_ORDER, seed=42)


@q("distinct_values", "SELECT DISTINCT p_type FROM part")
def distinct_values(spark, sf):
    return P.distinct_values(t(spark, sf, "part"), "p_type")


@q("distinct_first10", """
SELECT value FROM (SELECT trim(p_brand) AS value, min(p_partkey) AS o FROM part
  WHERE p_brand IS NOT NULL AND trim(p_brand) <> '' GROUP BY 1) ORDER BY o LIMIT 10""")
def distinct_first10(spark, sf):
    return P.first_distinct(t(spark, sf, "part"), "p_brand", ["p_partkey"], 10)


@q("anomaly_split", """
SELECT event_id, value, CASE WHEN value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)
            THEN 'anomaly' ELSE 'normal' END AS segment
FROM events, (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events) b""")
def anomaly_split(spark, sf):
    from quarry.operators.profile import iqr_flag
    ev = t(spark, sf, "events")
    flagged = iqr_flag(ev, "value")
    bad, good = P.split_by_flag(flagged, F.col("is_anomaly"))
    cols = ["event_id", "value"]
    return bad.select(*cols, F.lit("anomaly").alias("segment")).unionByName(
        good.select(*cols, F.lit("normal").alias("segment")))


@q("sample_values", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(row_number() OVER (ORDER BY c_custkey) AS INTEGER) AS k, "
    f"CAST({c} AS VARCHAR) AS value FROM (SELECT c_custkey, {c} FROM customer WHERE {c} IS NOT NULL "
    f"ORDER BY c_custkey LIMIT 3)" for c in SCHEMAS["customer"]))
def sample_values(spark, sf):
    return P.sample_values(t(spark, sf, "customer"), ["c_custkey"], 3)


# ---------------------------------------------------------------- aggregates
@q("bar_agg", """
SELECT l_returnflag, round(sum(l_extendedprice), 2) AS sum_l_extendedprice,
       round(avg(l_extendedprice), 6) AS mean_l_extendedprice, CAST(count(l_extendedprice) AS BIGINT) AS count_l_extendedprice,
       max(l_extendedprice) AS max_l_extendedprice, min(l_extendedprice) AS min_l_extendedprice
FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag""")
def bar_agg(spark, sf):
    g = A.group_agg(t(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", A.AGGS)
    return g.select("l_returnflag", r("sum_l_extendedprice", 2).alias("sum_l_extendedprice"),
                    r("mean_l_extendedprice").alias("mean_l_extendedprice"), "count_l_extendedprice",
                    "max_l_extendedprice", "min_l_extendedprice")


@q("bar_agg_color", """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_l_quantity
FROM lineitem WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY 1, 2""")
def bar_agg_color(spark, sf):
    g = A.group_agg(t(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", ["sum"])
    return g.withColumn("sum_l_quantity", r("sum_l_quantity", 2))


@q("value_counts", """
SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS count FROM orders
WHERE o_orderpriority IS NOT NULL GROUP BY 1""")
def value_counts(spark, sf):
    return A.value_counts(t(spark, sf, "orders"), "o_orderpriority")


@q("pie_sum", """
SELECT c_mktsegment, round(total, 2) AS total, round(total / sum(total) OVER (), 6) AS share FROM
  (SELECT c_mktsegment, sum(c_acctbal) AS total FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1)""")
def pie_sum(spark, sf):
    g = A.category_totals(t(spark, sf, "customer"), "c_mktsegment", "c_acctbal")
    return g.select("c_mktsegment", r("total", 2).alias("total"), r("share").alias("share"))


@q("treemap_rollup", """
SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice), 2) AS total,
       CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS level
FROM lineitem WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL
GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def treemap_rollup(spark, sf):
    g = A.rollup_totals(t(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice")
    return g.select("l_returnflag", "l_linestatus", r("total", 2).alias("total"), "level")


@q("sunburst_rollup", """
SELECT o_orderstatus, o_orderpriority, CAST(year(o_orderdate) AS INTEGER) AS yr, CAST(count(*) AS BIGINT) AS total,
       CAST(grouping(o_orderstatus, o_orderpriority, year(o_orderdate)) AS BIGINT) AS level
FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority, year(o_orderdate))""")
def sunburst_rollup(spark, sf):
    o = t(spark, sf, "orders").withColumn("yr", F.year("o_orderdate"))
    return A.rollup_totals(o, ["o_orderstatus", "o_orderpriority", "yr"])


@q("sankey_edges", """
WITH e AS (SELECT o_orderstatus AS source, o_orderpriority AS target, CAST(count(*) AS BIGINT) AS value
           FROM orders WHERE o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL GROUP BY 1, 2),
     n AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS BIGINT) AS node_id
           FROM (SELECT source AS label FROM e UNION SELECT target FROM e))
SELECT e.source, e.target, s.node_id AS source_id, d.node_id AS target_id, e.value
FROM e JOIN n s ON e.source = s.label JOIN n d ON e.target = d.label""")
def sankey_edges(spark, sf):
    return A.sankey_edges(t(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")


@q("metric_cards", """
SELECT round(sum(l_extendedprice), 2) AS revenue, round(avg(l_discount), 6) AS avg_discount,
       max(l_quantity) AS max_quantity, CAST(count(l_returnflag) AS BIGINT) AS n_flags FROM lineitem""")
def metric_cards(spark, sf):
    m = A.metric_cards(t(spark, sf, "lineitem"), [("revenue", "l_extendedprice", "sum"),
                                                   ("avg_discount", "l_discount", "mean"),
                                                   ("max_quantity", "l_quantity", "max"),
                                                   ("n_flags", "l_returnflag", "count")])
    return m.select(r("revenue", 2).alias("revenue"), r("avg_discount").alias("avg_discount"),
                    "max_quantity", "n_flags")


def _describe_sql(table, cols):
    parts = []
    for c in cols:
        parts.append(
            f"SELECT '{c}' AS column, CAST(count({c}) AS BIGINT) AS count, {sr(f'avg({c})', 4)} AS mean, "
            f"{sr(f'stddev_samp({c})', 4)} AS std, CAST(min({c}) AS DOUBLE) AS min, "
            f"{sr(f'quantile_cont({c}, 0.25)', 4)} AS p25, {sr(f'quantile_cont({c}, 0.5)', 4)} AS p50, "
            f"{sr(f'quantile_cont({c}, 0.75)', 4)} AS p75, CAST(max({c}) AS DOUBLE) AS max FROM {table}")
    return " UNION ALL ".join(parts)


@q("describe", _describe_sql("lineitem", NUMERIC["lineitem"]))
def describe(spark, sf):
    return round_all(A.describe(t(spark, sf, "lineitem")), 4)


def _profile_sql(table, types):
    parts = []
    for c, dt in types:
        num = dt in ("bigint", "int", "double")
        stat = (lambda e: sr(e, 4)) if num else (lambda e: "CAST(NULL AS DOUBLE)")
        parts.append(
            f"SELECT '{c}' AS column, '{dt}' AS dtype, CAST(count(*) - count({c}) AS BIGINT) AS null_count, "
            f"{sr(f'(count(*) - count({c})) * 100.0 / count(*)', 4)} AS null_pct, "
            f"CAST(count(DISTINCT {c}) AS BIGINT) AS unique_count, {str(num).upper()} AS is_numeric, "
            f"{str(dt.startswith('timestamp')).upper()} AS is_datetime, "
            f"{stat(f'min({c})')} AS min, {stat(f'max({c})')} AS max, {stat(f'avg({c})')} AS mean, "
            f"{stat(f'stddev_samp({c})')} AS std FROM {table}")
    return " UNION ALL ".join(parts)


_ORDER_TYPES = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
                ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")]


@q("column_profile", _profile_sql("orders", _ORDER_TYPES))
def column_profile(spark, sf):
    return round_all(A.column_profile(t(spark, sf, "orders")), 4)


@q("column_details", " UNION ALL ".join(
    f"SELECT '{c}' AS column, count(*) > count({c}) AS has_nulls, "
    f"{sr(f'quantile_cont({c}, 0.5)', 4) if dt in ('bigint', 'double') else 'CAST(NULL AS DOUBLE)'} AS median, "
    f"(SELECT string_agg(CAST({c} AS VARCHAR), ' | ' ORDER BY o_orderkey) FROM (SELECT o_orderkey, {c} FROM orders "
    f"WHERE {c} IS NOT NULL ORDER BY o_orderkey LIMIT 3)) AS samples FROM orders" for c, dt in _ORDER_TYPES))
def column_details(spark, sf):
    return round_all(A.column_details(t(spark, sf, "orders"), ["o_orderkey"]), 4)


@q("distinct_counts", " UNION ALL ".join(
    f"SELECT '{c}' AS column, CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct FROM documents" for c in SCHEMAS["documents"]))
def distinct_counts(spark, sf):
    return A.distinct_counts(t(spark, sf, "documents"))


def _quality_cols_sql(table):
    cols = SCHEMAS[table]
    k = len(cols)
    nn = " + ".join(f"count({c})" for c in cols)
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column, CAST(count(*) - count({c}) AS BIGINT) AS null_count, "
        f"{sr(f'(count(*) - count({c})) * 100.0 / count(*)', 4)} AS null_pct, "
        f"{sr(f'({nn}) * 100.0 / (count(*) * {k})', 4)} AS completeness FROM {table}" for c in cols)


@q("data_quality", _quality_cols_sql("documents"))
def data_quality(spark, sf):
    return round_all(A.data_quality(t(spark, sf, "documents")), 4)


@q("pivot_mean", """
SELECT l_returnflag, round(avg(l_quantity) FILTER (WHERE l_linestatus = 'F'), 6) AS F,
       round(avg(l_quantity) FILTER (WHERE l_linestatus = 'O'), 6) AS O
FROM lineitem WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY 1""")
def pivot_mean(spark, sf):
    p = A.pivot_mean(t(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", "l_quantity")
    return round_all(p)


@q("top_category", """
WITH c AS (
  SELECT 'c_name' AS column, c_name AS value, count(*) AS cnt FROM customer WHERE c_name IS NOT NULL GROUP BY 2
  UNION ALL
  SELECT 'c_mktsegment', c_mktsegment, count(*) FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 2),
r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY cnt DESC, value) AS rn,
             count(*) OVER (PARTITION BY "column") AS nd FROM c)
SELECT "column", value AS top_value, CAST(cnt AS BIGINT) AS count,
       round(cnt * 100.0 / (SELECT count(*) FROM customer), 4) AS pct
FROM r WHERE rn = 1 AND nd > 1""")
def top_category(spark, sf):
    g = A.top_category(t(spark, sf, "customer"))
    return g.withColumn("pct", r("pct", 4))


@q("top_group", """
SELECT c_nationkey, round(sum(c_acctbal), 2) AS total FROM customer WHERE c_nationkey IS NOT NULL
GROUP BY 1 ORDER BY sum(c_acctbal) DESC, c_nationkey LIMIT 1""")
def top_group(spark, sf):
    return A.top_group(t(spark, sf, "customer"), "c_nationkey", "c_acctbal").withColumn("total", r("total", 2))


def _hist_sql(by=None):
    keys = f"{by}, " if by else ""
    where = f" AND {by} IS NOT NULL" if by else ""
    return f"""
WITH s AS (SELECT {keys}l_extendedprice AS v FROM lineitem WHERE l_extendedprice IS NOT NULL{where}),
m AS (SELECT min(v) AS lo, max(v) AS hi FROM s),
b AS (SELECT {keys}CAST(CASE WHEN hi = lo THEN 1 ELSE least(floor((v - lo) / (hi - lo) * 30) + 1, 30) END AS INTEGER)
             AS bin, lo, hi FROM s, m)
SELECT {keys}bin, round(lo + (bin - 1) * ((hi - lo) / 30), 4) AS bin_lo, round(lo + bin * ((hi - lo) / 30), 4) AS bin_hi,
       CAST(count(*) AS BIGINT) AS count
FROM b GROUP BY {keys}bin, lo, hi"""


@q("histogram", _hist_sql())
def histogram(spark, sf):
    return round_all(A.histogram(t(spark, sf, "lineitem"), "l_extendedprice", 30), 4)


@q("histogram_by", _hist_sql("l_returnflag"))
def histogram_by(spark, sf):
    return round_all(A.histogram(t(spark, sf, "lineitem"), "l_extendedprice", 30, by="l_returnflag"), 4)


@q("box_stats", """
WITH q AS (SELECT l_returnflag, count(*) AS n, min(l_quantity) AS mn, max(l_quantity) AS mx,
                  quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.5) AS median,
                  quantile_cont(l_quantity, 0.75) AS q3
           FROM lineitem WHERE l_returnflag IS NOT NULL AND l_quantity IS NOT NULL GROUP BY 1),
f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lf, q3 + 1.5 * (q3 - q1) AS uf FROM q)
SELECT f.l_returnflag, CAST(n AS BIGINT) AS n, round(mn, 4) AS min, round(q1, 4) AS q1, round(median, 4) AS median,
       round(q3, 4) AS q3, round(mx, 4) AS max, round(iqr, 4) AS iqr, round(lf, 4) AS lower_fence,
       round(uf, 4) AS upper_fence,
       round(min(CASE WHEN l.l_quantity BETWEEN lf AND uf THEN l.l_quantity END), 4) AS whisker_low,
       round(max(CASE WHEN l.l_quantity BETWEEN lf AND uf THEN l.l_quantity END), 4) AS whisker_high,
       CAST(sum(CASE WHEN l.l_quantity BETWEEN lf AND uf THEN 0 ELSE 1 END) AS BIGINT) AS n_outliers
FROM f JOIN lineitem l ON l.l_returnflag = f.l_returnflag AND l.l_quantity IS NOT NULL
GROUP BY f.l_returnflag, n, mn, mx, q1, median, q3, iqr, lf, uf""")
def box_stats(spark, sf):
    return round_all(A.box_stats(t(spark, sf, "lineitem"), "l_quantity", by="l_returnflag"), 4)


@q("dist_insight", """
SELECT round(avg(l_extendedprice), 4) AS mean, round(quantile_cont(l_extendedprice, 0.5), 4) AS median,
       round(stddev_samp(l_extendedprice), 4) AS std FROM lineitem""")
def dist_insight(spark, sf):
    return round_all(A.dist_insight(t(spark, sf, "lineitem"), "l_extendedprice"), 4)


@q("summary_means", " UNION ALL ".join(
    f"SELECT '{c}' AS column, round(avg({c}), 4) AS mean FROM lineitem" for c in NUMERIC["lineitem"]))
def summary_means(spark, sf):
    return round_all(A.summary_means(t(spark, sf, "lineitem")), 4)


def _corr_sql(table, cols, pairs):
    return " UNION ALL ".join(
        f"SELECT '{x}' AS x, '{y}' AS y, round(corr({x}, {y}), 6) AS r FROM {table}" for x, y in pairs)


_LC = NUMERIC["lineitem"]


@q("corr_matrix", _corr_sql("lineitem", _LC, [(x, y) for x in _LC for y in _LC]))
def corr_matrix(spark, sf):
    return round_all(A.corr_matrix(t(spark, sf, "lineitem")))


@q("top_corr_pairs", "SELECT * FROM (" + _corr_sql(
    "lineitem", _LC, [(_LC[i], _LC[j]) for i in range(len(_LC)) for j in range(i + 1, len(_LC))])
   + ") WHERE r IS NOT NULL ORDER BY abs(r) DESC, x, y LIMIT 8")
def top_corr_pairs(spark, sf):
    return round_all(A.top_corr_pairs(t(spark, sf, "lineitem"), top=8))


@q("strong_corr", "SELECT *, CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction FROM (" + _corr_sql(
    "lineitem", _LC, [(_LC[i], _LC[j]) for i in range(len(_LC)) for j in range(i + 1, len(_LC))])
   + ") WHERE abs(r) > 0.7")
def strong_corr(spark, sf):
    return round_all(A.strong_corr(t(spark, sf, "lineitem")))


@q("pair_corr", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem")
def pair_corr(spark, sf):
    return round_all(A.pair_corr(t(spark, sf, "lineitem"), "l_quantity", "l_extendedprice"))
