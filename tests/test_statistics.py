"""Golden and property tests for the statistics operators."""

import math
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from rejoinder.functions import special as S
from rejoinder.operators import agreement as AG
from rejoinder.operators import significance as SG


def _one(spark, expr, schema, row):
    return spark.createDataFrame([row], schema).select(expr.alias("v")).first().v


def test_erfc_and_tails(spark):
    for x in [-1.5, 0.0, 0.7, 2.9]:
        assert abs(_one(spark, S.erfc("x"), "x double", (x,)) - math.erfc(x)) < 1e-13
    for x in [3.1, 6.0, 9.0]:
        assert _one(spark, S.erfc("x"), "x double", (x,)) == pytest.approx(math.erfc(x), rel=1e-12)
    assert _one(spark, S.chi2_sf("x", "k"), "x double, k int", (9.487729, 4)) == pytest.approx(0.05, abs=1e-8)
    assert _one(spark, S.chi2_sf("x", "k"), "x double, k int", (3.841459, 1)) == pytest.approx(0.05, abs=1e-7)
    assert _one(spark, S.chi2_sf("x", "k"), "x double, k int", (7.814728, 3)) == pytest.approx(0.05, abs=1e-7)


@pytest.mark.parametrize("s,n", [(0, 0), (0, 5), (2, 10), (7, 30), (120, 300)])
def test_exact_binomial_tail(spark, s, n):
    exp = min(1.0, 2 * sum(math.comb(n, i) for i in range(s + 1)) / 2 ** n) if n else 1.0
    assert _one(spark, S.binom_two_sided("s", "n"), "s long, n long", (s, n)) == pytest.approx(exp, rel=1e-10)


def test_signed_rank_exact_cdf(spark):
    n = 6
    sums = [sum(c) for k in range(n + 1) for c in combinations(range(1, n + 1), k)]
    for w in [0, 3, 7, 10.5]:
        exp = sum(1 for x in sums if x <= w) / 2 ** n
        assert _one(spark, S.signed_rank_cdf("w", "n"), "w double, n int", (float(w), n)) == pytest.approx(exp)


def _long(spark, table):
    rows = [("c", s, m, float(v)) for s, row in enumerate(table) for m, v in zip(["a", "b", "c"], row)]
    return spark.createDataFrame(rows, "category string, subject long, model string, score double")


def test_friedman_hand_computed(spark):
    # ranks per subject (mid-ranks for the tie in subject 3)
    table = [[1, 2, 3], [2, 3, 1], [3, 3, 1], [1, 3, 2], [2, 3, 1]]
    r = SG.friedman(_long(spark, table)).first()
    n, k = 5, 3
    ranks = [[1, 2, 3], [2, 3, 1], [2.5, 2.5, 1], [1, 3, 2], [2, 3, 1]]
    rj = [sum(x[j] for x in ranks) for j in range(k)]
    c = 1 - (2 ** 3 - 2) / (k * (k * k - 1) * n)
    chi = (12 / (n * k * (k + 1)) * sum(x * x for x in rj) - 3 * n * (k + 1)) / c
    assert r.statistic == pytest.approx(round(chi, 6))
    assert r.p_value == pytest.approx(round(math.exp(-chi / 2), 6), abs=1e-6)   # df = 2
    assert r.kendall_w == pytest.approx(round(chi / (n * (k - 1)), 6), abs=1e-6)


def test_wilcoxon_exact_small_and_identical_pair(spark):
    # a - b = [1, 2, 3, 4, 5, -6] : no ties, no zeros -> exact; R- = 6, R+ = 15, W = 6
    a = [2, 3, 4, 5, 6, 0]
    b = [1, 1, 1, 1, 1, 6]
    rows = [("c", i, "a", float(x)) for i, x in enumerate(a)] + [("c", i, "b", float(y)) for i, y in enumerate(b)]
    rows += [("c", i, "z", float(x)) for i, x in enumerate(a)]          # z identical to a
    df = spark.createDataFrame(rows, "category string, subject long, model string, score double")
    res = {(r.model_1, r.model_2): r for r in SG.wilcoxon_pairs(df).collect()}
    ab = res[("a", "b")]
    assert ab.w_stat == 6.0
    # exact two-sided p = 2 * P(T <= 6) for n = 6: subsets of 1..6 with sum <= 6 = 14 -> 28/64
    assert ab.p_value == pytest.approx(round(28 / 64, 6))
    az = res[("a", "z")]
    assert az.p_value is None and az.w_stat is None and az.better_model is None


def test_mcnemar_and_prf(spark):
    rows = [(i, m, t, p) for i, (t, p0, p1) in enumerate([(1, 1, 0), (1, 0, 1), (0, 0, 0), (1, 1, 1), (0, 1, 0)])
            for m, t, p in [("m0", t, p0), ("m1", t, p1)]]
    df = spark.createDataFrame([(i, m, float(t), float(p)) for i, m, t, p in rows],
                               "row_id long, model string, y_true double, y_pred double")
    c = SG.mcnemar_pairs(df).first()
    # rows: both right x2 (rows 3, 4), only m0 right (row 1), only m1 right (rows 2, 5)
    assert (c.n11, c.n10, c.n01, c.n00) == (2, 1, 2, 0)
    assert c.statistic == 1 and c.p_value == pytest.approx(1.0)
    prf = {r.model: r for r in SG.binary_prf(df).collect()}
    assert prf["m0"].precision == pytest.approx(round(2 / 3, 6)) and prf["m0"].recall == pytest.approx(round(2 / 3, 6))


def _alpha_ref(units, level):
    """Direct computation from the published coincidence-matrix definition."""
    from collections import Counter, defaultdict
    o = defaultdict(float)
    for vals in units:
        vals = [v for v in vals if v is not None]
        m = len(vals)
        if m < 2:
            continue
        cnt = Counter(vals)
        for c in cnt:
            for k in cnt:
                o[(c, k)] += cnt[c] * (cnt[k] - (c == k)) / (m - 1)
    dom = sorted({c for c, _ in o})
    nc = {c: sum(o[(c, k)] for k in dom) for c in dom}
    n = sum(nc.values())

    def d2(c, k):
        if level == "nominal":
            return float(c != k)
        lo, hi = sorted([dom.index(c), dom.index(k)])
        return (sum(nc[dom[g]] for g in range(lo, hi + 1)) - (nc[c] + nc[k]) / 2) ** 2
    do = sum(o[(c, k)] * d2(c, k) for c in dom for k in dom)
    de = sum(nc[c] * nc[k] * d2(c, k) for c in dom for k in dom)
    return 1 - (n - 1) * do / de


# Reliability data, 4 coders x 12 units (None = missing); published nominal alpha = 0.743
CODERS = [[1, 2, 3, 3, 2, 1, 4, 1, 2, None, None, None],
          [1, 2, 3, 3, 2, 2, 4, 1, 2, 5, None, 3],
          [None, 3, 3, 3, 2, 3, 4, 2, 2, 5, 1, None],
          [1, 2, 3, 3, 2, 4, 4, 1, 2, 5, 1, None]]


def _alpha_df(spark):
    rows = [("q", u, f"r{r}", None if v is None else float(v)) for r, coder in enumerate(CODERS)
            for u, v in enumerate(coder)]
    return spark.createDataFrame(rows, "category string, unit long, rater string, value double")


def test_alpha_nominal_published_value(spark):
    r = AG.alpha(_alpha_df(spark).withColumn("value", F.col("value").cast("string")), level="nominal").first()
    assert r.alpha == pytest.approx(0.743, abs=5e-4)


def test_alpha_ordinal_matches_definition(spark):
    units = [[c[u] for c in CODERS] for u in range(12)]
    r = AG.alpha(_alpha_df(spark), level="ordinal").first()
    assert r.alpha == pytest.approx(round(_alpha_ref(units, "ordinal"), 6), abs=1e-6)


def test_alpha_identical_raters_is_one(spark):
    rows = [("q", u, r, float(u % 3 + 1)) for u in range(10) for r in ("a", "b")]
    df = spark.createDataFrame(rows, "category string, unit long, rater string, value double")
    assert AG.alpha(df, level="ordinal").first().alpha == pytest.approx(1.0)
