"""Registry entries: experiments."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import dist
from quarry.operators import experiments as X
from quarry.registry.common import round_all, t

Q: dict = {}
SQL: dict = {}


def q(name, sql=None):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def _frame(spark, sf):
    """Experiments = order status; A = '1-URGENT', B = '2-HIGH'; metric = total price."""
    return X.experiment_frame(t(spark, sf, "orders"), "o_orderstatus", "o_orderpriority", "o_totalprice",
                              "1-URGENT", "2-HIGH", order_by=["o_orderkey"])


def _by_customer(spark, sf):
    """Experiments = customers, with a handful of orders each: exact rank sums, short t tests, many
    experiments that are too small."""
    return X.experiment_frame(t(spark, sf, "orders"), "o_custkey", "o_orderpriority", "o_totalprice",
                              "1-URGENT", "2-HIGH", order_by=["o_orderkey"])


# Tails by Simpson's rule: of F (and t, whose square is F with one degree) over an angle, of chi-square (and the
# normal distribution, whose square has one degree) over a root.
def _simpson(f, top, steps):
    return (f"({top} / {3 * steps} * (SELECT sum(CASE WHEN i IN (0, {steps}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * "
            f"({f(f'({top} * i / {steps})')})) FROM range(0, {steps + 1}) g(i)))")


def _f_tail_sql(f, d1, d2):
    scale = f"2 * exp(lgamma(({d1} + {d2}) / 2.0) - lgamma({d1} / 2.0) - lgamma({d2} / 2.0))"
    inside = _simpson(lambda x: f"sin({x}) ^ ({d1} - 1) * cos({x}) ^ ({d2} - 1)", f"atan(sqrt({d1} * {f} / {d2}))", 400)
    return f"(1 - {scale} * {inside})"


def _chi2_tail_sql(x, k):
    inside = _simpson(lambda u: f"{u} ^ ({k} - 1) * exp(- {u} * {u} / 2)", f"least(sqrt({x}), 40.0)", 2000)
    return f"(1 - 2 * exp(- lgamma({k} / 2.0)) / 2.0 ^ ({k} / 2.0) * {inside})"


_FRAME_SQL = """(SELECT o_orderstatus AS experiment,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'A' ELSE 'B' END AS variant, o_totalprice AS value, o_orderkey
  FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice IS NOT NULL
    AND o_orderstatus IS NOT NULL)"""

_CUSTOMER_SQL = _FRAME_SQL.replace("SELECT o_orderstatus AS", "SELECT CAST(o_custkey AS VARCHAR) AS").replace(
    "o_orderstatus IS NOT NULL", "o_custkey IS NOT NULL")

_PAIR_SQL = f"""(SELECT experiment,
   count(*) FILTER (WHERE variant = 'A') AS n_a, count(*) FILTER (WHERE variant = 'B') AS n_b,
   avg(value) FILTER (WHERE variant = 'A') AS mean_a, avg(value) FILTER (WHERE variant = 'B') AS mean_b,
   stddev_samp(value) FILTER (WHERE variant = 'A') AS std_a, stddev_samp(value) FILTER (WHERE variant = 'B') AS std_b
 FROM {_FRAME_SQL} GROUP BY experiment)"""


@q("ab_summary", f"""
SELECT experiment, variant, CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS mean,
       round(stddev_samp(value), 6) AS std, min(value) AS min, max(value) AS max
FROM {_FRAME_SQL} GROUP BY experiment, variant""")
def ab_summary(spark, sf):
    return round_all(X.variant_summary(_frame(spark, sf)))


@q("ab_t_test", f"""
WITH p AS (SELECT *, ((n_a - 1) * std_a ^ 2 + (n_b - 1) * std_b ^ 2) / (n_a + n_b - 2) AS pv FROM {_PAIR_SQL}
           WHERE n_a >= 2 AND n_b >= 2),
r AS (SELECT experiment, n_a, n_b, mean_a, mean_b, (mean_a - mean_b) / sqrt(pv * (1.0 / n_a + 1.0 / n_b)) AS t,
             CAST(n_a + n_b - 2 AS DOUBLE) AS df,
             CASE WHEN sqrt(pv) > 0 THEN (mean_b - mean_a) / sqrt(pv) ELSE 0.0 END AS d FROM p)
SELECT experiment, CAST(n_a AS BIGINT) AS n_a, CAST(n_b AS BIGINT) AS n_b, round(mean_a, 6) AS variant_a_mean,
       round(mean_b, 6) AS variant_b_mean, round(t, 6) AS t_statistic, round(df, 6) AS df, round(d, 6) AS cohens_d,
       round(mean_b - mean_a, 6) AS mean_difference,
       CASE WHEN abs(d) < 0.2 THEN 'Negligible' WHEN abs(d) < 0.5 THEN 'Small' WHEN abs(d) < 0.8 THEN 'Medium'
            ELSE 'Large' END AS effect_size_interpretation
FROM r""")
def ab_t_test(spark, sf):
    return round_all(X.t_test(_frame(spark, sf), with_p=False))


def _t_p_sql(frame):
    return f"""
WITH p AS (SELECT *, ((n_a - 1) * std_a ^ 2 + (n_b - 1) * std_b ^ 2) / (n_a + n_b - 2) AS pv
           FROM {_PAIR_SQL.replace(_FRAME_SQL, frame)} WHERE n_a >= 2 AND n_b >= 2),
r AS (SELECT *, (mean_a - mean_b) / sqrt(pv * (1.0 / n_a + 1.0 / n_b)) AS t, n_a + n_b - 2 AS df,
             CASE WHEN pv > 0 THEN (mean_b - mean_a) / sqrt(pv) ELSE 0.0 END AS d FROM p),
x AS (SELECT *, {_f_tail_sql("(t * t)", "1", "df")} AS pval FROM r)
SELECT experiment, CAST(n_a AS BIGINT) AS n_a, CAST(n_b AS BIGINT) AS n_b, round(mean_a, 6) AS variant_a_mean,
       round(mean_b, 6) AS variant_b_mean, round(t, 6) AS t_statistic, round(CAST(df AS DOUBLE), 6) AS df,
       round(d, 6) AS cohens_d, round(mean_b - mean_a, 6) AS mean_difference,
       CASE WHEN abs(d) < 0.2 THEN 'Negligible' WHEN abs(d) < 0.5 THEN 'Small' WHEN abs(d) < 0.8 THEN 'Medium'
            ELSE 'Large' END AS effect_size_interpretation,
       round(pval, 6) AS p_value, pval < 0.05 AS is_significant,
       CASE WHEN pval >= 0.05 THEN '{X.NOT_SIG}' WHEN mean_b > mean_a THEN '{X.B_BETTER}' ELSE '{X.A_BETTER}' END
         AS recommendation
FROM x"""


@q("ab_t_test_p", _t_p_sql(_FRAME_SQL))
def ab_t_test_p(spark, sf):
    return round_all(X.t_test(_frame(spark, sf)))


@q("ab_t_test_customers", _t_p_sql(_CUSTOMER_SQL))
def ab_t_test_customers(spark, sf):
    return round_all(X.t_test(_by_customer(spark, sf)))


@q("ab_invalid", f"""
WITH s AS (SELECT experiment, count(*) FILTER (WHERE variant = 'A') AS n_a, count(*) FILTER (WHERE variant = 'B') AS n_b
           FROM {_CUSTOMER_SQL} GROUP BY experiment)
SELECT experiment, CAST(n_a AS BIGINT) AS n_a, CAST(n_b AS BIGINT) AS n_b, 'too few observations: ' ||
       CASE WHEN n_a < 2 AND n_b < 2 THEN 'A and B' WHEN n_a < 2 THEN 'A' ELSE 'B' END AS error
FROM s WHERE n_a < 2 OR n_b < 2""")
def ab_invalid(spark, sf):
    return X.invalid_experiments(_by_customer(spark, sf))


@q("ab_welch_test", f"""
WITH p AS (SELECT * FROM {_PAIR_SQL} WHERE n_a >= 2 AND n_b >= 2)
SELECT experiment, round((mean_a - mean_b) / sqrt(std_a ^ 2 / n_a + std_b ^ 2 / n_b), 6) AS t_statistic,
       round((std_a ^ 2 / n_a + std_b ^ 2 / n_b) ^ 2 / ((std_a ^ 2 / n_a) ^ 2 / (n_a - 1) + (std_b ^ 2 / n_b) ^ 2 / (n_b - 1)), 4) AS df
FROM p""")
def ab_welch_test(spark, sf):
    out = X.t_test(_frame(spark, sf), equal_var=False, with_p=False).select("experiment", "t_statistic", "df")
    return out.select("experiment", F.round("t_statistic", 6).alias("t_statistic"), F.round("df", 4).alias("df"))


@q("ab_mann_whitney", f"""
WITH f AS {_FRAME_SQL},
r AS (SELECT experiment, variant, value,
             rank() OVER (PARTITION BY experiment ORDER BY value)
             + (count(*) OVER (PARTITION BY experiment, value) - 1) / 2.0 AS rk FROM f),
s AS (SELECT experiment, sum(rk) FILTER (WHERE variant = 'A') AS r_a, count(*) FILTER (WHERE variant = 'A') AS n_a,
             count(*) FILTER (WHERE variant = 'B') AS n_b FROM r GROUP BY experiment),
m AS (SELECT experiment, quantile_cont(value, 0.5) FILTER (WHERE variant = 'A') AS median_a,
             quantile_cont(value, 0.5) FILTER (WHERE variant = 'B') AS median_b FROM f GROUP BY experiment)
SELECT s.experiment, CAST(n_a AS BIGINT) AS n_a, CAST(n_b AS BIGINT) AS n_b,
       round(r_a - n_a * (n_a + 1) / 2.0, 6) AS u_statistic, round(median_a, 6) AS median_a, round(median_b, 6) AS median_b
FROM s JOIN m USING (experiment) WHERE n_a >= 2 AND n_b >= 2""")
def ab_mann_whitney(spark, sf):
    return round_all(X.mann_whitney(_frame(spark, sf), with_p=False))


def _mwu_p_sql(frame):
    """The normal branch by Simpson's rule; the exact one counts all arrangements:
    ways(a, b, u) = ways(a - 1, b, u - b) + ways(a, b - 1, u), the largest value being of A or of B."""
    z = "(greatest(u, n_a * n_b - u) - n_a * n_b / 2.0 - 0.5) / sqrt(n_a * n_b / 12.0 * ((n + 1) - ties / (n * (n - 1))))"
    return f"""
WITH RECURSIVE f AS {frame},
r AS (SELECT experiment, variant, value, count(*) OVER (PARTITION BY experiment, value) AS same,
             rank() OVER (PARTITION BY experiment ORDER BY value)
             + (count(*) OVER (PARTITION BY experiment, value) - 1) / 2.0 AS rk FROM f),
s AS (SELECT experiment, sum(rk) FILTER (WHERE variant = 'A') AS r_a, count(*) FILTER (WHERE variant = 'A') AS n_a,
             count(*) FILTER (WHERE variant = 'B') AS n_b, count(*) AS n, sum(same * same - 1) AS ties, max(same) AS most,
             quantile_cont(value, 0.5) FILTER (WHERE variant = 'A') AS median_a,
             quantile_cont(value, 0.5) FILTER (WHERE variant = 'B') AS median_b FROM r GROUP BY experiment),
u AS (SELECT *, r_a - n_a * (n_a + 1) / 2.0 AS u, least(n_a, n_b) <= 8 AND most = 1 AS exact FROM s
      WHERE n_a >= 2 AND n_b >= 2),
lim AS (SELECT coalesce(max(n_a), 0) AS la, coalesce(max(n_b), 0) AS lb FROM u WHERE exact),
ways AS (SELECT 0 AS a, 0 AS b, 0 AS u, 1.0::DOUBLE AS c
         UNION ALL
         SELECT a, b, u, sum(c) FROM (
           SELECT w.a + d.x AS a, w.b + 1 - d.x AS b, w.u + d.x * w.b AS u, w.c
           FROM ways w, (VALUES (0), (1)) d(x), lim WHERE w.a + d.x <= la AND w.b + 1 - d.x <= lb) GROUP BY a, b, u),
e AS (SELECT x.experiment, least(1.0, 2 * sum(w.c) FILTER (WHERE w.u >= greatest(x.u, n_a * n_b - x.u)) / sum(w.c)) AS p
      FROM u x JOIN ways w ON w.a = x.n_a AND w.b = x.n_b WHERE x.exact GROUP BY x.experiment),
z AS (SELECT *, {z} AS z FROM u),
p AS (SELECT z.*, CASE WHEN exact THEN e.p WHEN z <= 0 THEN 1.0 ELSE {_chi2_tail_sql("(z * z)", "1")} END AS pval
      FROM z LEFT JOIN e USING (experiment))
SELECT experiment, CAST(n_a AS BIGINT) AS n_a, CAST(n_b AS BIGINT) AS n_b, round(u, 6) AS u_statistic,
       round(median_a, 6) AS median_a, round(median_b, 6) AS median_b, round(pval, 6) AS p_value, pval < 0.05 AS is_significant,
       CASE WHEN pval >= 0.05 THEN '{X.NOT_SIG}' WHEN median_b > median_a THEN '{X.B_BETTER}' ELSE '{X.A_BETTER}' END
         AS recommendation
FROM p"""


@q("ab_mann_whitney_p", _mwu_p_sql(_FRAME_SQL))
def ab_mann_whitney_p(spark, sf):
    return round_all(X.mann_whitney(_frame(spark, sf)))


@q("ab_mann_whitney_customers", _mwu_p_sql(_CUSTOMER_SQL))
def ab_mann_whitney_customers(spark, sf):
    return round_all(X.mann_whitney(_by_customer(spark, sf)))


def _chi_sql(src):
    return f"""
WITH s AS ({src}),
c AS (SELECT r, c, count(*) AS o FROM s GROUP BY r, c),
rt AS (SELECT r, sum(o) AS rt FROM c GROUP BY r), ct AS (SELECT c, sum(o) AS ct FROM c GROUP BY c),
n AS (SELECT sum(o) AS n FROM c),
g AS (SELECT rt.r, ct.c, rt.rt * ct.ct / n.n AS e, coalesce(c.o, 0) AS o FROM rt CROSS JOIN ct CROSS JOIN n
      LEFT JOIN c ON c.r = rt.r AND c.c = ct.c),
k AS (SELECT (SELECT count(*) FROM rt) AS nr, (SELECT count(*) FROM ct) AS nc),
x AS (SELECT CASE WHEN (nr - 1) * (nc - 1) = 1
                  THEN sum((abs(o - e) - least(0.5, abs(o - e))) ^ 2 / e) ELSE sum((o - e) ^ 2 / e) END AS chi2,
             (nr - 1) * (nc - 1) AS dof, least(nr, nc) - 1 AS md FROM g, k GROUP BY nr, nc)
SELECT 'all' AS experiment, round(chi2, 6) AS chi_square_statistic, CAST(dof AS BIGINT) AS degrees_of_freedom,
       round(CASE WHEN md > 0 THEN sqrt(chi2 / ((SELECT n FROM n) * md)) ELSE 0 END, 6) AS cramers_v,
       CAST((SELECT n FROM n) AS BIGINT) AS n,
       CASE WHEN CASE WHEN md > 0 THEN sqrt(chi2 / ((SELECT n FROM n) * md)) ELSE 0 END < 0.1 THEN 'Negligible'
            WHEN CASE WHEN md > 0 THEN sqrt(chi2 / ((SELECT n FROM n) * md)) ELSE 0 END < 0.3 THEN 'Small'
            WHEN CASE WHEN md > 0 THEN sqrt(chi2 / ((SELECT n FROM n) * md)) ELSE 0 END < 0.5 THEN 'Medium'
            ELSE 'Large' END AS effect_size_interpretation
FROM x"""


@q("chi_square", _chi_sql("SELECT l_returnflag AS r, l_linestatus AS c FROM lineitem "
                          "WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL"))
def chi_square(spark, sf):
    return round_all(X.chi_square(t(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", with_p=False))


_URGENT = "o_orderpriority IN ('1-URGENT', '2-HIGH')"


@q("chi_square_2x2", _chi_sql(f"SELECT o_orderstatus AS r, {_URGENT} AS c FROM orders "
                              "WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority IS NOT NULL"))
def chi_square_2x2(spark, sf):
    o = t(spark, sf, "orders").where("o_orderstatus IN ('F', 'O') AND o_orderpriority IS NOT NULL")
    o = o.withColumn("urgent", F.expr(_URGENT))
    return round_all(X.chi_square(o, "o_orderstatus", "urgent", with_p=False))


def _chi_p_sql(key):
    tail = _chi2_tail_sql("chi_square_statistic", "degrees_of_freedom")
    return f"""SELECT *, round({tail}, 4) AS p_value, {tail} < 0.05 AS is_significant FROM ({SQL[key]})"""


@q("chi_square_p", _chi_p_sql("chi_square"))
def chi_square_p(spark, sf):
    out = round_all(X.chi_square(t(spark, sf, "lineitem"), "l_returnflag", "l_linestatus"))
    return out.withColumn("p_value", F.round("p_value", 4))


@q("chi_square_2x2_p", _chi_p_sql("chi_square_2x2"))
def chi_square_2x2_p(spark, sf):
    o = t(spark, sf, "orders").where("o_orderstatus IN ('F', 'O') AND o_orderpriority IS NOT NULL")
    o = o.withColumn("urgent", F.expr(_URGENT))
    return round_all(X.chi_square(o, "o_orderstatus", "urgent")).withColumn("p_value", F.round("p_value", 4))


_ZA, _ZB = dist.norm_ppf(0.975), dist.norm_ppf(0.8)


@q("sample_size_by_segment", f"""
SELECT event_type, round(p1, 6) AS baseline_conversion, CAST(n AS BIGINT) AS sample_size_per_variant,
       CAST(n * 2 AS BIGINT) AS total_sample_size FROM (
  SELECT event_type, p1, ceil({(_ZA + _ZB) ** 2!r} * (p1 * (1 - p1) + (p1 + 0.05) * (1 - (p1 + 0.05)))
                             / ((p1 + 0.05) - p1) ^ 2) AS n
  FROM (SELECT event_type, avg(CASE WHEN value > 20 THEN 1.0 ELSE 0.0 END) AS p1 FROM events
        WHERE event_type IS NOT NULL GROUP BY 1))""")
def sample_size_by_segment(spark, sf):
    out = X.sample_size_by_segment(t(spark, sf, "events"), "event_type", F.col("value") > 20, 0.05)
    return out.withColumn("baseline_conversion", F.round("baseline_conversion", 6))


@q("ab_confint", f"""
SELECT experiment, round(mean_b - mean_a, 6) AS mean_difference,
       round({_ZA!r} * sqrt(std_a ^ 2 / n_a + std_b ^ 2 / n_b), 6) AS margin_of_error,
       round(mean_b - mean_a - {_ZA!r} * sqrt(std_a ^ 2 / n_a + std_b ^ 2 / n_b), 6) AS confidence_interval_lower,
       round(mean_b - mean_a + {_ZA!r} * sqrt(std_a ^ 2 / n_a + std_b ^ 2 / n_b), 6) AS confidence_interval_upper
FROM {_PAIR_SQL} WHERE n_a >= 2 AND n_b >= 2""")
def ab_confint(spark, sf):
    return round_all(X.confidence_interval(_frame(spark, sf)))


@q("sequential_t", f"""
WITH f AS (SELECT *, row_number() OVER (PARTITION BY experiment, variant ORDER BY o_orderkey) AS pos FROM {_FRAME_SQL}),
z AS (SELECT a.experiment, a.pos, a.value AS a, b.value AS b FROM f a JOIN f b
      ON a.experiment = b.experiment AND a.pos = b.pos AND a.variant = 'A' AND b.variant = 'B'),
s AS (SELECT experiment, pos, max(pos) OVER (PARTITION BY experiment) AS m,
        avg(a) OVER w AS ma, var_samp(a) OVER w AS va, avg(b) OVER w AS mb, var_samp(b) OVER w AS vb FROM z
      WINDOW w AS (PARTITION BY experiment ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT experiment, CAST(pos AS BIGINT) AS n,
  round((ma - mb) / nullif(sqrt((va + vb) / 2 * (2.0 / pos)), 0), 4) AS t_statistic
FROM s WHERE pos >= 2 AND pos < m""")
def sequential_t(spark, sf):
    return round_all(X.sequential_t(_frame(spark, sf), ["o_orderkey"]), 4)


_SEQUENTIAL_SQL = SQL["sequential_t"].replace("round((ma", "(ma").replace("0), 4) AS t_statistic", "0) AS t_statistic")


@q("sequential_test", f"""
WITH ts AS ({_SEQUENTIAL_SQL}),
p AS (SELECT *, {_f_tail_sql("(t_statistic * t_statistic)", "1", "(2 * n - 2)")} AS p FROM ts WHERE abs(t_statistic) > 1.9),
f AS (SELECT experiment, min(n) AS n FROM p WHERE p < 0.05 GROUP BY experiment),
l AS (SELECT experiment, count(*) AS looks FROM ts GROUP BY experiment)
SELECT l.experiment, CAST(coalesce(f.n, looks) AS BIGINT) AS stopped_at_n, round(p.p, 6) AS p_value,
       round(p.t_statistic, 6) AS final_t_statistic,
       CASE WHEN f.n IS NOT NULL THEN 'Significant difference detected'
            ELSE 'No significant difference at current sample size' END AS conclusion
FROM l LEFT JOIN f USING (experiment) LEFT JOIN p ON p.experiment = f.experiment AND p.n = f.n""")
def sequential_test(spark, sf):
    return round_all(X.sequential_test(_frame(spark, sf), ["o_orderkey"]))


@q("anova", """
WITH g AS (SELECT o_orderstatus AS experiment, o_orderpriority AS variant, count(*) AS n, avg(o_totalprice) AS m,
                  var_samp(o_totalprice) AS v FROM orders
           WHERE o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL GROUP BY 1, 2),
t AS (SELECT experiment, sum(n) AS nn, sum(n * m) / sum(n) AS grand, count(*) AS k FROM g GROUP BY 1)
SELECT experiment, CAST(k AS BIGINT) AS num_variants, CAST(nn AS BIGINT) AS n,
       round((sum(n * (m - grand) ^ 2) / (k - 1)) / (sum((n - 1) * coalesce(v, 0)) / (nn - k)), 6) AS f_statistic
FROM g JOIN t USING (experiment) GROUP BY experiment, k, nn""")
def anova(spark, sf):
    return round_all(X.anova(t(spark, sf, "orders"), "o_orderpriority", "o_totalprice", "o_orderstatus", with_p=False))


_ANOVA_TAIL = _f_tail_sql("f", "(num_variants - 1)", "(n - num_variants)")


@q("anova_p", f"""
WITH a AS ({SQL["anova"].replace("round((sum(", "(sum(").replace("(nn - k)), 6) AS f_statistic", "(nn - k)) AS f")}),
p AS (SELECT *, {_ANOVA_TAIL} AS p FROM a)
SELECT experiment, num_variants, n, round(f, 6) AS f_statistic, round(p, 6) AS p_value, p < 0.05 AS is_significant,
       CASE WHEN p < 0.05 THEN '{X.SOME_DIFFER}' ELSE '{X.NONE_DIFFER}' END AS recommendation FROM p""")
def anova_p(spark, sf):
    return round_all(X.anova(t(spark, sf, "orders"), "o_orderpriority", "o_totalprice", "o_orderstatus"))


@q("anova_means", """
WITH g AS (SELECT o_orderstatus AS experiment, o_orderpriority AS variant, count(*) AS n, sum(o_totalprice) AS s
           FROM orders WHERE o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL GROUP BY 1, 2)
SELECT experiment, variant, CAST(n AS BIGINT) AS n, round(s / n, 4) AS mean,
       round(s / n - (sum(s) OVER e - s) / nullif(sum(n) OVER e - n, 0), 4) AS vs_others
FROM g WINDOW e AS (PARTITION BY experiment)""")
def anova_means(spark, sf):
    return round_all(X.variant_means(t(spark, sf, "orders"), "o_orderpriority", "o_totalprice", "o_orderstatus"), 4)


@q("ab_overview", f"""
WITH p AS {_PAIR_SQL},
pv AS (SELECT *, ((n_a - 1) * std_a ^ 2 + (n_b - 1) * std_b ^ 2) / (n_a + n_b - 2) AS v FROM p WHERE n_a >= 2 AND n_b >= 2)
SELECT p.experiment, CAST(p.n_a AS BIGINT) AS n_a, CAST(p.n_b AS BIGINT) AS n_b, round(p.mean_a, 6) AS mean_a,
       round(p.std_a, 6) AS std_a, round(p.mean_b, 6) AS mean_b, round(p.std_b, 6) AS std_b,
       round((pv.mean_a - pv.mean_b) / sqrt(pv.v * (1.0 / pv.n_a + 1.0 / pv.n_b)), 6) AS t_statistic,
       pv.experiment IS NOT NULL AS has_results
FROM p LEFT JOIN pv USING (experiment)""")
def ab_overview(spark, sf):
    fr = _frame(spark, sf)
    return round_all(X.overview(fr, X.t_test(fr, with_p=False)))
