"""Experiments from sufficient statistics.

Re-aim: instead of two in-memory Series per experiment, one long table
``(experiment, variant, value)`` carries any number of experiments.  Every
statistic is a Spark aggregate grouped by experiment (partial aggregation
map-side, one shuffle of a few numbers per task); only the per-experiment
summary rows go through the Arrow UDFs that turn statistics into p-values.

Conventions: variant labels are ``'A'`` and ``'B'``; the t statistic is
A minus B (as ``ttest_ind(a, b)``), Cohen's d and mean difference are
B minus A, as in the reference.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import dist
from quarry.functions.stats import clean_double, col_of
from quarry.operators.order import cumulative_sum, join_small, with_position

# Effect-size cut points (Cohen's d and Cramer's V).
D_CUTS = ((0.2, "Negligible"), (0.5, "Small"), (0.8, "Medium"))
V_CUTS = ((0.1, "Negligible"), (0.3, "Small"), (0.5, "Medium"))
NOT_SIG = "no difference shown: keep A or collect more"
B_BETTER = "B is ahead: switch to B"
A_BETTER = "A is ahead: keep A"
SOME_DIFFER = "some variants differ"
NONE_DIFFER = "no difference between variants shown"


def _label(x: Column, cuts) -> Column:
    e = None
    for cut, name in cuts:
        e = F.when(x < cut, name) if e is None else e.when(x < cut, name)
    return e.otherwise("Large")


def recommendation(significant: Column, b_better: Column) -> Column:
    return F.when(~F.coalesce(significant, F.lit(False)), NOT_SIG).when(b_better, B_BETTER).otherwise(A_BETTER)


# --- X1 ---------------------------------------------------------------------------
def experiment_frame(df: DataFrame, experiment: str | None, variant: str, value: str,
                     a_label=None, b_label=None, order_by: Sequence[str] | None = None) -> DataFrame:
    """Long frame (experiment, variant in A/B, value[, order cols]) with nulls
    dropped.  Variants are the given labels, or the first two groups seen
    (by the smallest ``order_by``) in each experiment."""
    exp = col_of(experiment).cast("string") if experiment else F.lit("all")
    keep = [col_of(o).alias(o) for o in (order_by or [])]
    src = df.select(exp.alias("experiment"), col_of(variant).alias("_g"), clean_double(col_of(value)).alias("value"),
                    *keep).where(F.col("value").isNotNull() & F.col("_g").isNotNull())
    if a_label is not None and b_label is not None:
        lab = F.when(F.col("_g") == F.lit(a_label), "A").when(F.col("_g") == F.lit(b_label), "B")
        return src.withColumn("variant", lab).where(F.col("variant").isNotNull()).drop("_g")
    if not order_by:
        raise ValueError("order_by is needed to find the first two groups")
    first = src.groupBy("experiment", "_g").agg(F.min(F.struct(*order_by)).alias("_o"))
    w = Window.partitionBy("experiment").orderBy("_o")  # one row per (experiment, group): small
    pick = first.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= 2).select(
        "experiment", "_g", F.when(F.col("_r") == 1, "A").otherwise("B").alias("variant"))
    return join_small(src, pick, ["experiment", "_g"]).drop("_g")


def variant_summary(frame: DataFrame) -> DataFrame:
    """n, mean, std (ddof 1), min, max per (experiment, variant)."""
    return frame.groupBy("experiment", "variant").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))


def paired_summary(frame: DataFrame) -> DataFrame:
    """One row per experiment with A and B statistics side by side and a
    validity flag (both variants need at least 2 observations)."""
    s = variant_summary(frame)
    wide = s.groupBy("experiment").agg(*[
        F.max(F.when(F.col("variant") == v, F.col(c))).alias(f"{c}_{v.lower()}")
        for v in ("A", "B") for c in ("n", "mean", "std", "min", "max")])
    return wide.withColumn("valid", (F.coalesce(F.col("n_a"), F.lit(0)) >= 2) & (F.coalesce(F.col("n_b"), F.lit(0)) >= 2))


def invalid_experiments(frame: DataFrame) -> DataFrame:
    """Experiments that no test can take, with their sizes and the reason (X1):
    a variant with fewer than 2 observations, or none at all."""
    n = [F.coalesce(F.col(f"n_{v}"), F.lit(0)).alias(f"n_{v}") for v in ("a", "b")]
    why = F.concat(F.lit("too few observations: "), F.concat_ws(" and ", *[
        F.when(F.coalesce(F.col(f"n_{v}"), F.lit(0)) < 2, v.upper()) for v in ("a", "b")]))
    return paired_summary(frame).where("NOT valid").select("experiment", *n, why.alias("error"))


# --- X2 ---------------------------------------------------------------------------
def t_test(frame: DataFrame, equal_var: bool = True, alpha: float = 0.05, with_p: bool = True) -> DataFrame:
    """Independent two-sample t-test per experiment."""
    s = paired_summary(frame).where("valid")
    na, nb = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    va, vb = F.col("std_a") ** 2, F.col("std_b") ** 2
    pooled_var = ((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)
    pooled_std = F.sqrt(pooled_var)
    diff = F.col("mean_a") - F.col("mean_b")
    if equal_var:
        t = F.try_divide(diff, F.sqrt(pooled_var * (1 / na + 1 / nb)))
        df_ = na + nb - 2
    else:
        se2 = va / na + vb / nb
        t = F.try_divide(diff, F.sqrt(se2))
        df_ = F.try_divide(se2 ** 2, (va / na) ** 2 / (na - 1) + (vb / nb) ** 2 / (nb - 1))
    d = F.when(pooled_std > 0, (F.col("mean_b") - F.col("mean_a")) / pooled_std).otherwise(F.lit(0.0))
    out = s.select("experiment", "n_a", "n_b", F.col("mean_a").alias("variant_a_mean"),
                   F.col("mean_b").alias("variant_b_mean"), t.alias("t_statistic"), df_.alias("df"),
                   d.alias("cohens_d"), (F.col("mean_b") - F.col("mean_a")).alias("mean_difference"))
    out = out.withColumn("effect_size_interpretation", _label(F.abs("cohens_d"), D_CUTS))
    if with_p:
        out = out.withColumn("p_value", dist.t_pvalue(F.col("t_statistic"), F.col("df")))
        out = out.withColumn("is_significant", F.coalesce(F.col("p_value") < alpha, F.lit(False)))
        out = out.withColumn("recommendation", recommendation(
            F.col("is_significant"), F.col("variant_b_mean") > F.col("variant_a_mean")))
    return out


# --- X3 ---------------------------------------------------------------------------
def mann_whitney(frame: DataFrame, alpha: float = 0.05, with_p: bool = True) -> DataFrame:
    """Mann-Whitney U of A with average ranks for ties.

    Values are counted per (experiment, value) first, so ranking works on
    distinct values; the rank offsets are a distributed running count (no
    one-task window even for one huge experiment).  The same running counts
    per variant give each variant's median."""
    cnt = frame.groupBy("experiment", "value").agg(
        F.sum(F.when(F.col("variant") == "A", 1).otherwise(0)).cast("double").alias("ca"),
        F.sum(F.when(F.col("variant") == "B", 1).otherwise(0)).cast("double").alias("cb"))
    cnt = cnt.withColumn("c", F.col("ca") + F.col("cb"))
    ranked = cumulative_sum(cnt, ["value"], ["c", "ca", "cb"], by=["experiment"], inclusive=False,
                            prefix="before_")
    totals = cnt.groupBy("experiment").agg(F.sum("ca").alias("n_a"), F.sum("cb").alias("n_b"))
    ranked = join_small(ranked, totals, ["experiment"]).withColumn(
        "rank", F.col("before_c") + (F.col("c") + 1) / 2)

    def at(k: Column, side: str) -> Column:
        # the value holding rank k among one variant's sorted values
        before, here = F.col(f"before_c{side}"), F.col(f"c{side}")
        return F.max(F.when((before <= k) & (k < before + here), F.col("value")))

    med = {}
    for side in ("a", "b"):
        h = (F.col(f"n_{side}") - 1) / 2
        med[side] = (at(F.floor(h), side), at(F.ceil(h), side))
    agg = ranked.groupBy("experiment").agg(
        F.sum(F.col("ca") * F.col("rank")).alias("r_a"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"),
        F.sum(F.col("c") ** 3 - F.col("c")).alias("tie_term"), F.max("c").alias("max_tie"),
        med["a"][0].alias("_a_lo"), med["a"][1].alias("_a_hi"), med["b"][0].alias("_b_lo"), med["b"][1].alias("_b_hi"))
    agg = agg.where((F.col("n_a") >= 2) & (F.col("n_b") >= 2))
    u = F.col("r_a") - F.col("n_a") * (F.col("n_a") + 1) / 2
    out = (agg.withColumn("u_statistic", u)
              .withColumn("median_a", (F.col("_a_lo") + F.col("_a_hi")) / 2)
              .withColumn("median_b", (F.col("_b_lo") + F.col("_b_hi")) / 2))
    out = out.select("experiment", F.col("n_a").cast("bigint").alias("n_a"), F.col("n_b").cast("bigint").alias("n_b"),
                     "u_statistic", "median_a", "median_b", "tie_term", "max_tie")
    if with_p:
        n = F.col("n_a") + F.col("n_b")
        mu = F.col("n_a") * F.col("n_b") / 2
        sigma = F.sqrt(F.col("n_a") * F.col("n_b") / 12 * ((n + 1) - F.col("tie_term") / (n * (n - 1))))
        big_u = F.greatest(F.col("u_statistic"), F.col("n_a") * F.col("n_b") - F.col("u_statistic"))
        z = F.try_divide(big_u - mu - 0.5, sigma)
        asym = F.least(F.lit(1.0), 2 * dist.norm_sf_col(z))
        exact = (F.least(F.col("n_a"), F.col("n_b")) <= 8) & (F.col("max_tie") <= 1)
        p = F.when(exact, dist.mwu_exact_pvalue(F.col("u_statistic"), F.col("n_a"), F.col("n_b"))).otherwise(asym)
        out = out.withColumn("p_value", p).withColumn("is_significant", F.col("p_value") < alpha)
        out = out.withColumn("recommendation", recommendation(F.col("is_significant"),
                                                              F.col("median_b") > F.col("median_a")))
    return out.drop("tie_term", "max_tie")


# --- X4 ---------------------------------------------------------------------------
def chi_square(df: DataFrame, row: str, col: str, experiment: str | None = None, alpha: float = 0.05,
               with_p: bool = True) -> DataFrame:
    """Chi-square test of independence per experiment (X4), Yates
    correction when dof = 1 (the library default), Cramer's V.

    Only observed cells are materialised: the empty cells' share
    sum (O-E)^2/E = E is recovered as N - sum of observed E, so no grid
    is built."""
    ex = col_of(experiment).cast("string") if experiment else F.lit("all")
    src = df.select(ex.alias("experiment"), col_of(row).alias("_r"), col_of(col).alias("_c")).where(
        F.col("_r").isNotNull() & F.col("_c").isNotNull())
    cells = src.groupBy("experiment", "_r", "_c").agg(F.count(F.lit(1)).cast("double").alias("o"))
    rows = cells.groupBy("experiment", "_r").agg(F.sum("o").alias("rt"))
    cols = cells.groupBy("experiment", "_c").agg(F.sum("o").alias("ct"))
    tot = rows.groupBy("experiment").agg(F.sum("rt").alias("n"), F.count(F.lit(1)).alias("nr"),
                                         F.sum(1 / F.col("rt")).alias("inv_r"))
    ctot = cols.groupBy("experiment").agg(F.count(F.lit(1)).alias("nc"), F.sum(1 / F.col("ct")).alias("inv_c"))
    j = join_small(join_small(cells, rows, ["experiment", "_r"]), cols, ["experiment", "_c"])
    j = join_small(j, tot, ["experiment"])
    e = F.col("rt") * F.col("ct") / F.col("n")
    per = j.groupBy("experiment").agg(
        F.sum((F.col("o") - e) ** 2 / e - e).alias("_part"), F.max(F.abs(F.col("o") - e)).alias("_d"),
        F.first("n").alias("n"), F.first("nr").alias("nr"), F.first("inv_r").alias("inv_r"))
    per = join_small(per, ctot, ["experiment"])
    dof = (F.col("nr") - 1) * (F.col("nc") - 1)
    plain = F.col("_part") + F.col("n")
    d = F.col("_d")
    yates = (d - F.least(F.lit(0.5), d)) ** 2 * F.col("n") * F.col("inv_r") * F.col("inv_c")
    chi2 = F.when(dof == 1, yates).otherwise(plain)
    min_dim = F.least(F.col("nr"), F.col("nc")) - 1
    v = F.when(min_dim > 0, F.sqrt(chi2 / (F.col("n") * min_dim))).otherwise(F.lit(0.0))
    out = per.select("experiment", chi2.alias("chi_square_statistic"), dof.cast("bigint").alias("degrees_of_freedom"),
                     v.alias("cramers_v"), F.col("n").cast("bigint").alias("n"))
    out = out.withColumn("effect_size_interpretation", _label(F.col("cramers_v"), V_CUTS))
    if with_p:
        out = out.withColumn("p_value", dist.chi2_pvalue(F.col("chi_square_statistic"), F.col("degrees_of_freedom")))
        out = out.withColumn("is_significant", F.col("p_value") < alpha)
    return out


# --- X5 ---------------------------------------------------------------------------
def sample_size(p1: Column, min_effect: float, alpha: float = 0.05, power: float = 0.8) -> Column:
    """Observations per variant for a two-proportion test."""
    za, zb = dist.norm_ppf(1 - alpha / 2), dist.norm_ppf(power)
    p2 = p1 + F.lit(min_effect)
    n = (za + zb) ** 2 * (p1 * (1 - p1) + p2 * (1 - p2)) / (p2 - p1) ** 2
    return F.ceil(n).cast("bigint")


def sample_size_by_segment(df: DataFrame, segment: str, flag: Column, min_effect: float,
                           alpha: float = 0.05, power: float = 0.8) -> DataFrame:
    """Baseline conversion measured per segment, then the required size."""
    g = df.where(col_of(segment).isNotNull()).groupBy(col_of(segment).alias(segment)).agg(
        F.avg(flag.cast("double")).alias("baseline_conversion"))
    n = sample_size(F.col("baseline_conversion"), min_effect, alpha, power)
    return g.withColumn("sample_size_per_variant", n).withColumn("total_sample_size", n * 2)


# --- X6 ---------------------------------------------------------------------------
def confidence_interval(frame: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Normal CI of mean(B) - mean(A) with the unpooled standard error."""
    s = paired_summary(frame).where("valid")
    z = dist.norm_ppf((1 + confidence) / 2)
    diff = F.col("mean_b") - F.col("mean_a")
    se = F.sqrt(F.col("std_a") ** 2 / F.col("n_a") + F.col("std_b") ** 2 / F.col("n_b"))
    return s.select("experiment", diff.alias("mean_difference"), (F.lit(z) * se).alias("margin_of_error"),
                    (diff - F.lit(z) * se).alias("confidence_interval_lower"),
                    (diff + F.lit(z) * se).alias("confidence_interval_upper"))


# --- X7 ---------------------------------------------------------------------------
def sequential_t(frame: DataFrame, order_by: Sequence[str], max_observations: int | None = None) -> DataFrame:
    """Pooled t statistic of the first n observations of A against the
    first n of B, for n = 2 .. min(nA, nB, max_observations) - 1 (X7).

    O(n) instead of re-testing every prefix: positions per variant come from
    the distributed position helper, the two variants are zipped on position,
    and running sums from the distributed cumulative sum give every prefix's
    means and variances, so a hot experiment stays cut across partitions.
    Values are shifted by the experiment's mean first: large offsets do not
    cancel."""
    pos = with_position(frame, list(order_by), by=["experiment", "variant"], pos_col="_p0", n_col=None)
    pos = pos.withColumn("pos", F.col("_p0") + 1)
    if max_observations is not None:
        pos = pos.where(F.col("pos") <= max_observations)
    a = pos.where("variant = 'A'").select("experiment", "pos", F.col("value").alias("a"))
    b = pos.where("variant = 'B'").select("experiment", "pos", F.col("value").alias("b"))
    z = a.join(b, ["experiment", "pos"])
    lim = z.groupBy("experiment").agg(F.max("pos").alias("_m"), F.avg((F.col("a") + F.col("b")) / 2).alias("_mean"))
    z = join_small(z, lim, ["experiment"])
    z = z.withColumn("a", F.col("a") - F.col("_mean")).withColumn("b", F.col("b") - F.col("_mean"))
    z = z.select("experiment", "pos", "_m", "a", "b", (F.col("a") ** 2).alias("aa"), (F.col("b") ** 2).alias("bb"))
    s = cumulative_sum(z, ["pos"], ["a", "b", "aa", "bb"], by=["experiment"], prefix="s")
    s = s.where((F.col("pos") >= 2) & (F.col("pos") < F.col("_m")))
    n = F.col("pos").cast("double")
    va = (F.col("saa") - F.col("sa") ** 2 / n) / (n - 1)
    vb = (F.col("sbb") - F.col("sb") ** 2 / n) / (n - 1)
    t = F.try_divide(F.col("sa") / n - F.col("sb") / n, F.sqrt(F.greatest((va + vb) / 2 * (2 / n), F.lit(0.0))))
    return s.select("experiment", F.col("pos").cast("bigint").alias("n"), t.alias("t_statistic"))


def sequential_test(frame: DataFrame, order_by: Sequence[str], alpha: float = 0.05,
                    max_observations: int | None = None) -> DataFrame:
    """First n whose prefix test has p < alpha, else the number of looks
    (the reference reports looks, not n, when nothing is significant)."""
    ts = sequential_t(frame, order_by, max_observations)
    zc = dist.norm_ppf(1 - alpha / 2)
    # |t| must exceed the normal critical value before p can be < alpha
    cand = ts.where(F.abs("t_statistic") > zc).withColumn(
        "p_value", dist.t_pvalue(F.col("t_statistic"), 2 * F.col("n") - 2)).where(F.col("p_value") < alpha)
    first = cand.groupBy("experiment").agg(F.min(F.struct("n", "p_value", "t_statistic")).alias("f"))
    looks = ts.groupBy("experiment").agg(F.count(F.lit(1)).alias("looks"))
    out = looks.join(first, ["experiment"], "left")
    hit = F.col("f").isNotNull()
    return out.select(
        "experiment", F.when(hit, F.col("f.n")).otherwise(F.col("looks")).alias("stopped_at_n"),
        F.col("f.p_value").alias("p_value"), F.col("f.t_statistic").alias("final_t_statistic"),
        F.when(hit, "Significant difference detected")
         .otherwise("No significant difference at current sample size").alias("conclusion"))


# --- X8 ---------------------------------------------------------------------------
def anova(df: DataFrame, group: str, value: str, experiment: str | None = None, alpha: float = 0.05,
          with_p: bool = True) -> DataFrame:
    """One-way ANOVA over all variants of each experiment (X8).  The means of
    the variants are a table of their own, ``variant_means``: an experiment may
    have any number of variants."""
    ex = col_of(experiment).cast("string") if experiment else F.lit("all")
    src = df.select(ex.alias("experiment"), col_of(group).cast("string").alias("variant"),
                    clean_double(col_of(value)).alias("value")).where("value IS NOT NULL AND variant IS NOT NULL")
    g = src.groupBy("experiment", "variant").agg(F.count("value").alias("n"), F.avg("value").alias("m"),
                                                 F.var_samp("value").alias("v"), F.sum("value").alias("s"))
    tot = g.groupBy("experiment").agg(F.sum("n").alias("n_total"), (F.sum("s") / F.sum("n")).alias("grand"),
                                      F.count(F.lit(1)).alias("k"))
    j = join_small(g, tot, ["experiment"])
    per = j.groupBy("experiment").agg(
        F.sum(F.col("n") * (F.col("m") - F.col("grand")) ** 2).alias("ssb"),
        F.sum((F.col("n") - 1) * F.coalesce(F.col("v"), F.lit(0.0))).alias("ssw"),
        F.first("n_total").alias("n_total"), F.first("k").alias("k"))
    # one variant, or one observation each: no statistic
    f = F.try_divide(F.try_divide(F.col("ssb"), F.col("k") - 1), F.try_divide(F.col("ssw"), F.col("n_total") - F.col("k")))
    out = per.select("experiment", F.col("k").cast("bigint").alias("num_variants"),
                     F.col("n_total").cast("bigint").alias("n"), f.alias("f_statistic"))
    if with_p:
        out = out.withColumn("p_value", dist.f_pvalue(F.col("f_statistic"), F.col("num_variants") - 1,
                                                      F.col("n") - F.col("num_variants")))
        out = out.withColumn("is_significant", F.coalesce(F.col("p_value") < alpha, F.lit(False)))
        out = out.withColumn("recommendation", F.when(F.col("is_significant"), SOME_DIFFER).otherwise(NONE_DIFFER))
    return out


def variant_means(df: DataFrame, group: str, value: str, experiment: str | None = None) -> DataFrame:
    """(experiment, variant, n, mean, vs_others) behind ``anova``: each variant's mean
    and how far it stands from the mean of all other rows of its experiment."""
    ex = col_of(experiment).cast("string") if experiment else F.lit("all")
    src = df.select(ex.alias("experiment"), col_of(group).cast("string").alias("variant"),
                    clean_double(col_of(value)).alias("value")).where("value IS NOT NULL AND variant IS NOT NULL")
    g = src.groupBy("experiment", "variant").agg(F.count("value").alias("n"), F.sum("value").alias("s"))
    tot = g.groupBy("experiment").agg(F.sum("n").alias("n_all"), F.sum("s").alias("s_all"))
    others = F.try_divide(F.col("s_all") - F.col("s"), F.col("n_all") - F.col("n"))
    return join_small(g, tot, ["experiment"]).select("experiment", "variant", "n", (F.col("s") / F.col("n")).alias("mean"),
                                                     (F.col("s") / F.col("n") - others).alias("vs_others"))


# --- X9 ---------------------------------------------------------------------------
def overview(frame: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """Experiment listing: summary per experiment left-joined to stored
    results (X9)."""
    s = paired_summary(frame).select("experiment", "n_a", "n_b", "mean_a", "std_a", "mean_b", "std_b")
    if results is None:
        return s.withColumn("has_results", F.lit(False))
    r = results.select("experiment", F.col("t_statistic"), F.lit(True).alias("has_results"))
    return s.join(r, ["experiment"], "left").withColumn("has_results", F.coalesce("has_results", F.lit(False)))


class ExperimentNotFound(KeyError):
    pass


def analyze(frame: DataFrame, experiment_id: str, test: str = "t", **kw) -> DataFrame:
    """Run one test for one experiment id; an unknown id is an error, not
    an empty result."""
    one = frame.where(F.col("experiment") == F.lit(experiment_id))
    if one.isEmpty():
        raise ExperimentNotFound(f"Experiment not found: {experiment_id}")
    fn = {"t": t_test, "mann_whitney": mann_whitney, "confidence_interval": confidence_interval}[test]
    return fn(one, **kw)
