"""Operator behaviour on small literals: nulls, ties, edge cases, and
brute-force comparisons for the distributed algorithms."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import dist
from quarry.functions import formulas as FM
from quarry.operators import aggregates as A
from quarry.operators import experiments as X
from quarry.operators import filters as P
from quarry.operators import order as O
from quarry.operators import profile as R
from quarry.plans import spec as PL
from quarry.sources import io as S


@pytest.fixture(scope="module")
def nums(spark):
    rows = [(1, "a", 10.0, 2), (2, "b", None, 0), (3, None, -7.0, 3), (4, "a", 5.5, -3), (5, "c", float("nan"), 1)]
    return spark.createDataFrame(rows, "id long, g string, x double, d int")


# ---------------------------------------------------------------- ordering helpers
def test_positions_with_a_hot_group(spark):
    rnd = random.Random(7)
    rows = [("hot", rnd.random(), i) for i in range(3000)] + [(f"k{i % 7}", rnd.random(), i) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, v double, i long")
    got = {(r["g"], r["i"]): r["_pos"] for r in O.with_position(df, ["v", "i"], by=["g"]).collect()}
    for g in {r[0] for r in rows}:
        mine = sorted((v, i) for gg, v, i in rows if gg == g)
        for p, (_, i) in enumerate(mine):
            assert got[(g, i)] == p


def test_exact_quantiles_match_numpy(spark):
    rnd = np.random.default_rng(3)
    vals = rnd.normal(size=2001)
    df = spark.createDataFrame([(float(v), "a" if k % 3 else "b") for k, v in enumerate(vals)], "v double, g string")
    q = {r["g"]: r for r in O.column_quantiles(df, ["v"], [0.1, 0.5, 0.9], by=["g"], names=["a", "b", "c"]).collect()}
    for g, sel in (("a", [k % 3 != 0 for k in range(2001)]), ("b", [k % 3 == 0 for k in range(2001)])):
        ref = np.quantile(vals[np.array(sel)], [0.1, 0.5, 0.9])
        assert [q[g]["a"], q[g]["b"], q[g]["c"]] == pytest.approx(list(ref), abs=1e-12)


def test_cumulative_sum_matches_pandas(spark):
    rows = [("x" if i % 4 else "y", i, float(i % 5)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, o long, v double")
    out = {(r["g"], r["o"]): r["cum_v"] for r in O.cumulative_sum(df, ["o"], ["v"], by=["g"]).collect()}
    run = {}
    for g, o, v in sorted(rows, key=lambda t: (t[0], t[1])):
        run[g] = run.get(g, 0.0) + v
        assert out[(g, o)] == run[g]


# ---------------------------------------------------------------- formulas
def test_formula_value_rules(spark):
    df = spark.createDataFrame([(-7.0, 3.0, "a", "b"), (7.0, -3.0, None, "z"), (1.0, 0.0, "p", "q")],
                               "a double, b double, s string, t string")

    def ev(text):
        return [r[0] for r in df.select(FM.compile_formula(text, df).col).collect()]

    assert ev("[a] % [b]") == [2.0, -2.0, None]          # sign of the divisor, x % 0 -> null
    assert ev("[a] / [b]")[2] is None                      # division by zero -> null
    assert ev("[s] + '-' + [t]") == ["a-b", None, "p-q"]   # null propagates through concat
    assert ev("-1 < [b] <= 3") == [True, False, True]      # chained comparison
    assert ev("2 ** 3 + [a] * 0") == [8.0, 8.0, 8.0]


@pytest.mark.parametrize("bad", ["abs([a])", "[a].real", "[a][0]", "[x for x in [a]]", "foo + 1", "[nope] + 1"])
def test_formula_rejects_unsafe(spark, bad):
    df = spark.createDataFrame([(1.0,)], "a double")
    with pytest.raises(FM.FormulaError):
        FM.compile_formula(bad, df)


def test_conditional_last_value_is_default(spark):
    df = spark.createDataFrame([(50.0,), (20.0,), (1.0,), (None,)], "q double")
    conds = [{"condition": "[q] > 40", "value": "'big'"}, {"condition": "[q] > 10", "value": "'mid'"},
             {"condition": "[q] > 1000", "value": "'small'"}]
    got = [r[0] for r in df.select(FM.conditional_column(conds, df)).collect()]
    assert got == ["big", "mid", "small", "small"]


def test_group_aggregate_null_key_gets_null(spark, nums):
    out = {r["id"]: r["m"] for r in FM.with_aggregate(nums, "m", "d", "mean", group_by="g").collect()}
    assert out[3] is None and out[1] == pytest.approx(-0.5) and out[2] == 0.0


def test_formula_set_roundtrip(spark, nums):
    fs = FM.FormulaSet().add_arithmetic("two", "[d] * 2").add_aggregation("tot", "two_result", "sum")
    back = FM.FormulaSet.from_json(fs.to_json())
    r = back.apply(nums).agg(F.max("tot_result")).first()[0]
    assert r == 2 * (2 + 0 + 3 - 3 + 1)


# ---------------------------------------------------------------- filters / sources
def test_typed_equality_and_sample(spark, nums):
    assert P.filter_eq(nums, "d", "3", ["id"]).first()["matched_count"] == 1
    assert P.filter_eq(nums, "d", "not a number", ["id"]).count() == 0
    s = P.sample_n(nums, 3, ["id"])
    ids = [r["id"] for r in s.collect()]
    assert len(ids) == 3 and ids == sorted(ids)


def test_first_distinct_trims_and_skips_blank(spark):
    df = spark.createDataFrame([(1, " b"), (2, ""), (3, "a "), (4, "b"), (5, None), (6, "c")], "i long, v string")
    assert [r[0] for r in P.first_distinct(df, "v", ["i"], 2).collect()] == ["b", "a"]


def test_load_validation_and_names(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("Order Date, Total Sales ,Region\n03/15/2024,10.5,West\n2024-03-16,3,East\nbad,1,East\n")
    df = S.load(spark, str(p))
    assert df.columns == ["Order_Date", "Total_Sales", "Region"]
    assert dict(df.dtypes)["Order_Date"] == "timestamp_ntz"
    assert sorted(r[0] is None for r in df.select("Order_Date").collect()) == [False, False, True]
    one = tmp_path / "one.csv"
    one.write_text("a\n1\n")
    with pytest.raises(S.LoadError):
        S.load(spark, str(one))


# ---------------------------------------------------------------- aggregates
def test_histogram_constant_and_max_bin(spark):
    df = spark.createDataFrame([(1.0,), (1.0,)], "v double")
    assert [(r["bin"], r["count"]) for r in A.histogram(df, "v", 30).collect()] == [(1, 2)]
    df2 = spark.createDataFrame([(0.0,), (3.0,)], "v double")
    assert sorted(r["bin"] for r in A.histogram(df2, "v", 3).collect()) == [1, 3]


def test_corr_constant_column_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, 7.0, 5.0), (None, 1.0, 5.0)],
                               "a double, b double, c double")
    m = {(r["x"], r["y"]): r["r"] for r in A.corr_matrix(df).collect()}
    assert m[("a", "c")] is None and m[("a", "a")] == pytest.approx(1.0)
    ref = np.corrcoef([1.0, 2.0, 3.0], [2.0, 4.0, 7.0])[0, 1]
    assert m[("a", "b")] == pytest.approx(ref) and m[("b", "a")] == pytest.approx(ref)


def test_box_stats_by_hand(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 100.0]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    r = A.box_stats(df, "v").first()
    q1, q3 = np.quantile(vals, [0.25, 0.75])
    assert (r["q1"], r["q3"]) == (q1, q3)
    assert r["whisker_high"] == 4.0 and r["n_outliers"] == 1


def test_top_category_tie_goes_to_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",)], "s string")
    r = A.top_category(df).first()
    assert (r["top_value"], r["count"], r["pct"]) == ("a", 2, 40.0)


def test_waterfall_running_total(spark):
    df = spark.createDataFrame([("b", 2.0), ("a", 1.0), ("c", 4.0), ("a", 1.0)], "k string, v double")
    out = [(r["k"], r["running_total"]) for r in PL.waterfall(df, "k", "v").orderBy("k").collect()]
    assert out == [("a", 2.0), ("b", 4.0), ("c", 8.0)]


# ---------------------------------------------------------------- experiments
def test_mann_whitney_brute_force(spark):
    rnd = random.Random(11)
    a = [rnd.randint(0, 20) for _ in range(40)]
    b = [rnd.randint(5, 25) for _ in range(35)]
    rows = [("e", "A", float(v)) for v in a] + [("e", "B", float(v)) for v in b]
    df = spark.createDataFrame(rows, "experiment string, variant string, value double")
    u = X.mann_whitney(df).first()
    brute = sum(1.0 if x > y else 0.5 if x == y else 0.0 for x in a for y in b)
    assert u["u_statistic"] == pytest.approx(brute)
    assert 0.0 <= u["p_value"] <= 1.0


def test_mann_whitney_exact_small():
    # 3 vs 3, complete separation: 2 of the 20 arrangements are as extreme
    assert dist.mwu_exact_p(0, 3, 3) == pytest.approx(0.1)


@pytest.mark.parametrize("n1,n2", [(1, 9), (2, 5), (6, 4), (8, 8)])
def test_mann_whitney_exact_counts_all_arrangements(n1, n2):
    ways = Counter(sum(c) - n1 * (n1 - 1) // 2 for c in itertools.combinations(range(n1 + n2), n1))
    us = list(range(n1 * n2 + 1))
    want = [min(1.0, 2 * sum(v for k, v in ways.items() if k >= max(u, n1 * n2 - u)) / math.comb(n1 + n2, n1)) for u in us]
    assert dist.mwu_exact_p(us, n1, n2) == pytest.approx(want, abs=1e-12)


def test_mann_whitney_exact_takes_any_larger_side():
    # one value against n: it may stand at any of n + 1 places
    n = 10 ** 9
    assert dist.mwu_exact_p(n // 4, 1, n) == pytest.approx(0.5, abs=1e-8)
    sd = math.sqrt(8 * n * (n + 9) / 12)
    assert dist.mwu_exact_p(4 * n - 1.5 * sd, 8, n) == pytest.approx(2 * dist.norm_sf(1.5), abs=5e-3)


@pytest.mark.parametrize("df", [1e4, 1e6, 1e9, 1e12])
def test_tails_of_large_samples(df):
    """t, F and chi-square over ever more observations tend to the normal distribution and to each other."""
    t = np.array([0.0, 0.5, 1.7, 1.8, 3.0, 6.0])
    fourth = (t ** 3 + t) / 2 * np.exp(-t * t / 2) / math.sqrt(2 * math.pi) / df  # first correction of the t tail
    assert dist.t_sf2(t, df) == pytest.approx(2 * dist.norm_sf(t) + fourth, rel=1e-3, abs=1e-9)
    assert dist.f_sf(t * t, 1, df) == pytest.approx(dist.t_sf2(t, df), rel=1e-9)
    assert dist.f_sf([0.9, 1.5], 10, df) == pytest.approx(dist.chi2_sf([9.0, 15.0], 10), rel=50 / df + 1e-4)


def test_tails_without_a_value():
    assert np.isnan(dist.t_sf2([np.nan, 1.0, 1.0], [3, 0, np.nan])).all()
    assert np.isnan(dist.chi2_sf([np.nan, 1.0], [1, 0])).all() and np.isnan(dist.mwu_exact_p([3.0, np.nan], [9, 3], [9, 3])).all()
    assert len(dist.norm_sf(np.array([]))) == 0


def test_chi_square_yates_by_hand(spark):
    rows = [("x", "p")] * 10 + [("x", "q")] * 20 + [("y", "p")] * 30 + [("y", "q")] * 5
    df = spark.createDataFrame(rows, "r string, c string")
    got = X.chi_square(df, "r", "c").first()
    obs = np.array([[10, 20], [30, 5]], dtype=float)
    e = obs.sum(1, keepdims=True) * obs.sum(0, keepdims=True) / obs.sum()
    d = np.abs(obs - e)
    chi2 = (((d - np.minimum(0.5, d)) ** 2) / e).sum()
    assert got["degrees_of_freedom"] == 1
    assert got["chi_square_statistic"] == pytest.approx(chi2)
    assert got["cramers_v"] == pytest.approx(math.sqrt(chi2 / obs.sum()))


def test_p_value_functions():
    # reference values of standard tables
    assert dist.t_sf2(2.228, 10) == pytest.approx(0.05, abs=2e-4)
    assert dist.chi2_sf(3.841, 1) == pytest.approx(0.05, abs=2e-4)
    assert dist.f_sf(4.10, 2, 10) == pytest.approx(0.05, abs=2e-3)
    assert dist.norm_sf(1.959963984540054) == pytest.approx(0.025, abs=1e-12)


def test_sequential_matches_prefix_tests(spark):
    rnd = random.Random(5)
    a = [rnd.gauss(0, 1) for _ in range(30)]
    b = [rnd.gauss(0.8, 1) for _ in range(30)]
    rows = [("e", "A", v, i) for i, v in enumerate(a)] + [("e", "B", v, i) for i, v in enumerate(b)]
    df = spark.createDataFrame(rows, "experiment string, variant string, value double, o long")
    ts = {r["n"]: r["t_statistic"] for r in X.sequential_t(df, ["o"]).collect()}
    assert sorted(ts) == list(range(2, 30))
    for n in (2, 10, 29):
        xa, xb = np.array(a[:n]), np.array(b[:n])
        sp = math.sqrt(((n - 1) * xa.var(ddof=1) + (n - 1) * xb.var(ddof=1)) / (2 * n - 2))
        assert ts[n] == pytest.approx((xa.mean() - xb.mean()) / (sp * math.sqrt(2 / n)))


def test_anova_by_hand(spark):
    groups = {"a": [1.0, 2.0, 3.0], "b": [2.0, 4.0, 6.0], "c": [5.0, 5.0, 8.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double")
    r = X.anova(df, "g", "v").first()
    allv = np.concatenate(list(groups.values()))
    ssb = sum(len(v) * (np.mean(v) - allv.mean()) ** 2 for v in groups.values())
    ssw = sum(((np.array(v) - np.mean(v)) ** 2).sum() for v in groups.values())
    assert r["f_statistic"] == pytest.approx((ssb / 2) / (ssw / 6))


@pytest.mark.parametrize("buckets,final,passes", [(4, 10, 8), (3, 5, 2), (1024, 50, 8)])
def test_exact_quantiles_refinement_paths(spark, monkeypatch, buckets, final, passes):
    """Force several histogram passes (and the position fallback) on data
    with heavy ties, a hot group and outliers."""
    monkeypatch.setattr(O, "QUANTILE_BUCKETS", buckets)
    monkeypatch.setattr(O, "FINAL_ROWS", final)
    monkeypatch.setattr(O, "MAX_PASSES", passes)
    rnd = np.random.default_rng(9)
    hot = np.concatenate([rnd.exponential(size=700), np.full(200, 3.0), [1e9, -1e9]])
    cold = rnd.integers(0, 4, size=50).astype(float)
    one = np.array([7.0])
    rows = [("hot", float(v)) for v in hot] + [("cold", float(v)) for v in cold] + [("one", 7.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {r["g"]: r for r in O.column_quantiles(df, ["v"], probs, by=["g"], names=list("abcdef")).collect()}
    for g, vals in (("hot", hot), ("cold", cold), ("one", one)):
        ref = np.quantile(vals, probs)
        assert [got[g][c] for c in "abcdef"] == pytest.approx(list(ref), rel=1e-12, abs=1e-12)


def test_experiment_first_two_groups_by_input_order(spark):
    rows = [(1, "e", "late", 1.0), (0, "e", "early", 2.0), (2, "e", "third", 3.0), (3, "e", "early", None),
            (4, "f", "x", 1.0), (5, "f", "y", 2.0), (6, "f", "x", 3.0)]
    df = spark.createDataFrame(rows, "o long, exp string, grp string, v double")
    fr = X.experiment_frame(df, "exp", "grp", "v", order_by=["o"])
    got = sorted((r["experiment"], r["variant"], r["value"]) for r in fr.collect())
    assert got == [("e", "A", 2.0), ("e", "B", 1.0), ("f", "A", 1.0), ("f", "A", 3.0), ("f", "B", 2.0)]
    s = {(r["experiment"], r["variant"]): r["n"] for r in X.variant_summary(fr).collect()}
    assert s[("f", "A")] == 2
    assert X.t_test(fr).where("experiment = 'e'").count() == 0  # fewer than 2 per variant


def test_trend_slopes_match_polyfit(spark):
    from quarry.operators import profile as R
    rnd = random.Random(3)
    rows = [(f"2024-01-{1 + (i % 3 if i < 900 else i % 28):02d}", i, rnd.random() * 10 + 0.01 * i,
             None if i % 17 == 0 else float(i % 11)) for i in range(1200)]
    df = spark.createDataFrame(rows, "d string, key long, a double, b double")
    got = {r["column"]: r["slope"] for r in R.trend_slopes(df, "d", ["key"], cols=["a", "b"]).collect()}
    ordered = sorted(rows, key=lambda t: (t[0], t[1]))
    x = np.arange(len(ordered))
    for j, c in ((2, "a"), (3, "b")):
        y = np.array([0.0 if r[j] is None else r[j] for r in ordered])
        assert got[c] == pytest.approx(np.polyfit(x, y, 1)[0], rel=1e-9, abs=1e-12)


def test_missing_and_infinite_values(spark):
    from quarry.operators import aggregates as A
    from quarry.sources import io as S
    from quarry.streaming import streams as ST
    nan, inf = float("nan"), float("inf")
    g = spark.createDataFrame([("a", 3.0), ("b", nan), ("c", 9.0), ("c", nan)], "k string, v double")
    assert tuple(A.top_group(g, "k", "v").first()) == ("c", 9.0)
    assert {r.column: r.null_count for r in A.data_quality(g).collect()} == {"k": 0, "v": 2}
    assert S.report_overview(g).first().null_cells == 2
    h = spark.createDataFrame([(float(i),) for i in range(100)] + [(inf,), (-inf,), (nan,)], "v double")
    bins = {r.bin: r["count"] for r in A.histogram(h, "v", 10).collect()}
    assert bins == {0: 1, 11: 1, **{b: 10 for b in range(1, 11)}}
    z = spark.createDataFrame([("s", 1.0)] * 30 + [("s", 50.0), ("s", nan), ("s", inf)], "stream_id string, v double")
    assert [r.v for r in ST.zscore_anomalies(z, "v").collect()] == [50.0]
    wide = spark.createDataFrame([("r", i, float(i)) for i in range(60)] + [("r", 3, nan)], "a string, b long, v double")
    assert sorted(tuple(r) for r in A.pivot_mean(wide, "a", "b", "v").collect()) == [("r", i, float(i)) for i in range(60)]
    got = S.report(wide, ["b", "v"], 5)
    assert got["first_rows"].count() == 5 and got["overview"].first().record_count == 61 and got["describe"].count() == 2


# ---------------------------------------------------------------- whole-column quantiles, distinct counts, samples
@pytest.mark.parametrize("final,buckets,k,slack", [
    (50_000, 1024, 4096, 0.003),   # values inside the brackets are counted one by one
    (1, 16, 4096, 0.003),          # brackets are cut into buckets, narrowed by more passes
    (50_000, 1024, 8, 0.0),        # coarse sketch, no slack: ranks fall outside their brackets
    (1, 4, 8, 0.0),
])
def test_column_quantiles_paths(spark, monkeypatch, final, buckets, k, slack):
    for name, v in (("FINAL_ROWS", final), ("QUANTILE_BUCKETS", buckets), ("SKETCH_K", k), ("SKETCH_SLACK", slack)):
        monkeypatch.setattr(O, name, v)
    rnd = np.random.default_rng(4)
    cols = {"skewed": rnd.exponential(size=3000), "ties": rnd.integers(0, 3, 3000).astype(float), "one": np.full(3000, 7.0),
            "wide": np.concatenate([rnd.normal(size=2990), np.full(10, 1e300)])}
    rows = [tuple(float(v[i]) for v in cols.values()) + (None, float("nan")) for i in range(3000)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in (*cols, "empty", "nans")))
    probs = [0.0, 0.25, 0.5, 0.5005, 1.0]
    got = {r["column"]: r for r in O.column_quantiles(df, df.columns, probs, names=["a", "b", "c", "d", "e"]).collect()}
    assert set(got) == set(cols)
    for c, v in cols.items():
        assert got[c]["n"] == 3000
        assert [got[c][x] for x in "abcde"] == pytest.approx(np.quantile(v, probs).tolist(), rel=1e-12)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert O.column_quantiles(df.limit(0), ["v"], [0.5]).count() == 0
    assert [r["n"] for r in O.exact_quantiles(df.withColumnRenamed("v", "value"), [0.5], []).collect()] == [None]
    kept = R.iqr_flag(df, "v").collect()  # a column without values has no outliers, and no row is lost
    assert [r["is_anomaly"] for r in kept] == [False]


def test_distinct_counts(spark):
    rows = [("x", 0.0, 1, None), ("x", -0.0, 2, None), ("", float("nan"), 2, None), (None, 5.0, None, None)]
    df = spark.createDataFrame(rows, "t string, d double, `a.b` int, n string")
    assert dict(A.distinct_counts(df).collect()) == {"t": 2, "d": 2, "a.b": 2, "n": 0}
    assert set(dict(A.distinct_counts(df.limit(0)).collect()).values()) == {0}
    same = df.selectExpr("t AS a", "t AS b")  # equal values of two columns stay apart
    assert dict(A.distinct_counts(same).collect()) == {"a": 2, "b": 2}


def test_roles_near_a_threshold_are_counted(spark):
    n = 400  # a category has at most 24 distinct values here
    df = spark.range(n).selectExpr("concat('v', id % 24) AS few", "concat('v', id % 25) AS more", "concat('k', id) AS user_id",
                                   "id % 12 AS code", "id % 13 AS amount", "CAST(NULL AS STRING) AS nothing", "id > 3 AS flag")
    roles = dict(R.column_roles(df).collect())
    assert roles == {"few": "category", "more": "text_or_category", "user_id": "identifier", "code": "numeric_code",
                     "amount": "numeric_measure", "nothing": "mostly_empty", "flag": "boolean"}


def test_samples_of_a_sparse_column(spark):
    df = spark.range(1000).selectExpr("id", "IF(id % 400 = 399, concat('s', id), NULL) AS sparse", "CAST(NULL AS INT) AS none")
    got = [(r["column_name"], r["k"], r["value"]) for r in P.sample_values(df, ["id"], 3).collect()]
    assert sorted(got) == [("id", 1, "0"), ("id", 2, "1"), ("id", 3, "2"), ("sparse", 1, "s399"), ("sparse", 2, "s799")]
    details = {r["column"]: r for r in A.column_details(df, ["id"]).collect()}
    assert (details["id"]["median"], details["id"]["samples"], details["id"]["has_nulls"]) == (499.5, "0 | 1 | 2", False)
    assert details["sparse"]["samples"] == "s399 | s799" and details["none"]["samples"] is None and details["none"]["has_nulls"]


def test_invalid_experiments_and_variant_means(spark):
    df = spark.createDataFrame([("x", "A", 1.0), ("x", "A", 2.0), ("x", "B", 3.0), ("y", "B", 1.0), ("z", "A", 1.0), ("z", "A", 3.0),
                                ("z", "B", 2.0), ("z", "B", 9.0)], "experiment string, variant string, value double")
    bad = {r["experiment"]: (r["n_a"], r["n_b"], r["error"]) for r in X.invalid_experiments(df).collect()}
    assert bad == {"x": (2, 1, "too few observations: B"), "y": (0, 1, "too few observations: A and B")}
    m = {(r["experiment"], r["variant"]): (r["n"], r["mean"], r["vs_others"])
         for r in X.variant_means(df, "variant", "value", "experiment").collect()}
    assert m["z", "A"] == (2, 2.0, -3.5) and m["y", "B"] == (1, 1.0, None)
