"""Order statistics, mid-ranks and tails against direct computation."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rejoinder.functions import special as S
from rejoinder.operators import ranges as R
from rejoinder.operators import significance as SG
from rejoinder.operators import stats as ST


def test_order_statistics_against_numpy(spark):
    rnd = np.random.default_rng(3)
    groups = {"ties": rnd.integers(0, 4, 500).astype(float), "continuous": rnd.normal(size=801), "one": np.array([2.5]),
              "two": np.array([1.0, 4.0]), "equal": np.full(9, 7.0), "negative": -rnd.random(33) * 1e6}
    rows = [(g, float(v)) for g, own in groups.items() for v in own] + [("ties", None), ("nulls", None), ("nulls", None), (None, 1.0), (None, 3.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = {r.g: r for r in R.order_statistics(df, group_cols=["g"], value_col="v", shares=[0, 0.1, 0.25, 0.5, 0.9, 1]).collect()}
    for g, own in groups.items():
        assert got[g]["count"] == len(own) and got[g]["min"] == own.min() and got[g]["max"] == own.max()
        assert got[g].q == pytest.approx(np.quantile(own, [0, 0.1, 0.25, 0.5, 0.9, 1]).tolist(), rel=1e-12, abs=1e-12)
        assert got[g]["mean"] == pytest.approx(own.mean()) and (len(own) == 1 and got[g].std is None or got[g].std == pytest.approx(own.std(ddof=1), abs=1e-9))
    assert (got["nulls"]["count"], got["nulls"]["mean"], got["nulls"].std, got["nulls"].q) == (0, None, None, [None] * 6)
    assert got[None].q[3] == 2.0
    assert R.order_statistics(df.limit(0), group_cols=["g"], value_col="v", shares=[0.5]).count() == 0


def test_describe_without_group_buffers(spark):
    df = spark.range(1000).select(F.lit("p").alias("pair"), F.col("id").cast("double").alias("value"))
    out = ST.describe_columns(df)
    plan = out._jdf.queryExecution().toString().lower()
    assert "percentile" not in plan and "median" not in plan
    r = out.first()
    assert (r.p25, r.p50, r.p75, r["count"]) == (249.75, 499.5, 749.25, 1000)


def test_running_totals_cross_partition_borders(spark):
    rows = [(g, v, (v * 7 + g) % 5) for g in range(3) for v in range(200)]
    df = spark.createDataFrame(rows, "g int, v int, w int").repartition(7)
    got = {(r.g, r.v): r.upto for r in R.running_totals(df, by=["g"], order="v", weight="w").collect()}
    for g in range(3):
        total = 0
        for _, v, w in sorted(r for r in rows if r[0] == g):
            total += w
            assert got[g, v] == total


def wilcoxon_ref(d):
    """(W, tie-corrected p, n) from the definition."""
    d = [x for x in d if x != 0]
    order = sorted(abs(x) for x in d)
    rank = {a: (order.index(a) + 1 + len(order) - order[::-1].index(a)) / 2 for a in set(order)}
    plus, minus = sum(rank[abs(x)] for x in d if x > 0), sum(rank[abs(x)] for x in d if x < 0)
    n, w = len(d), min(plus, minus)
    ties = sum(order.count(a) ** 3 - order.count(a) for a in set(order))
    z = (w - n * (n + 1) / 4) / math.sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24)
    return w, math.erfc(abs(z) / math.sqrt(2))


@pytest.mark.parametrize("continuous", [False, True])
def test_wilcoxon_of_one_large_pair(spark, continuous):
    rnd = np.random.default_rng(8)
    a, b = (rnd.normal(size=400), rnd.normal(0.1, 1, 400)) if continuous else (rnd.integers(0, 6, 400), rnd.integers(0, 5, 400))
    rows = [("c", i, m, float(v)) for i, pair in enumerate(zip(a, b, strict=True)) for m, v in zip("ab", pair, strict=True)]
    df = spark.createDataFrame(rows, "category string, subject long, model string, score double").repartition(5)
    r = SG.wilcoxon_pairs(df).first()
    w, p = wilcoxon_ref([float(x - y) for x, y in zip(a, b, strict=True)])
    assert r.w_stat == w and r.p_value == pytest.approx(p, rel=1e-9) and r.p_method == "normal"


def test_wilcoxon_method_is_asked_for_and_told(spark):
    rows = [("c", i, m, float(v)) for i in range(1, 9) for m, v in (("a", i * 1.5), ("b", 0), ("z", i * 1.5 - (i % 2)))]
    df = spark.createDataFrame(rows, "category string, subject long, model string, score double")
    for method, want in (("auto", "exact"), ("exact", "exact"), ("normal", "normal")):
        got = {(r.model_1, r.model_2): r for r in SG.wilcoxon_pairs(df, method=method).collect()}
        assert got["a", "b"].p_method == want and got["a", "z"].p_method == "normal"         # zeros have no exact distribution
    assert got["a", "b"].p_value != pytest.approx(2 / 2**8) and SG.wilcoxon_pairs(df, method="exact").where("model_2 = 'b'").first().p_value == pytest.approx(2 / 2**8)
    assert SG.wilcoxon_pairs(df, exact_max_n=5).where("p_method = 'exact'").count() == 0
    with pytest.raises(ValueError):
        SG.wilcoxon_pairs(df, method="other")


def test_duplicates_raise(spark):
    rows = [("c", 1, "a", 1.0), ("c", 1, "a", 2.0), ("c", 1, "b", 2.0)]
    df = spark.createDataFrame(rows, "category string, subject long, model string, score double")
    for f in (SG.friedman, SG.wilcoxon_pairs, SG.significance_report):
        with pytest.raises(Exception, match="scores one subject twice"):
            f(df).collect()
    with pytest.raises(Exception, match="more than once"):
        ST.pivot_scores(df, ["a", "b"]).collect()
    wide = ST.pivot_scores(df.where("score = 2"), ["a", "b", "c"]).first()
    assert (wide.category, wide.subject, wide.a, wide.b, wide.c) == ("c", 1, 2.0, 2.0, None)


def test_gate_and_family_use_the_whole_p(spark):
    p = [1.2e-9, 0.0499999996, None, 0.3]
    df = spark.createDataFrame([("x", v) for v in p], "f string, p_value double")
    for family in ((), ("f",)):
        got = sorted((r.p_value_bonferroni for r in SG.bonferroni(df, family=family).collect()), key=lambda v: (v is None, v))
        assert got == [pytest.approx(3.6e-9), pytest.approx(3 * 0.0499999996), pytest.approx(0.9), None]
    panel = SG.score_panel(spark.createDataFrame([("c", i, m, float(v)) for i in range(9) for m, v in (("a", i), ("b", i + 1), ("c", 2 * i))],
                                                 "category string, subject long, model string, score double"))
    near = spark.createDataFrame([("c", 0.0499999996)], "category string, p_value double")
    assert SG._wilcoxon(panel, near, 0.05, "auto", 50).count() == 3
    assert SG._wilcoxon(panel, near.withColumn("p_value", F.lit(0.05)), 0.05, "auto", 50).count() == 0


def tail_ref(s, n):
    """2 P(X <= s): the largest term by whole numbers, the sum of ratios down from it."""
    top = (math.comb(n, s) << 200) >> n
    ratio = np.cumprod((s - np.arange(s, dtype=float)) / (n - s + 1 + np.arange(s)))
    return min(1.0, 2 * (top / 2**200) * (1 + ratio.sum()))


def test_binomial_tail_against_whole_numbers(spark):
    cases = [(s, n) for n in (1, 2, 3, 15, 16, 17, 31, 200) for s in range(n // 2 + 1)]
    cases += [(s, n) for n in (10_001, 1_000_000) for s in (n // 2, n // 2 - 3, n // 2 - int(n**0.5), n // 2 - 3 * int(n**0.5))]
    rows = spark.createDataFrame(cases, "s long, n long").select("s", "n", S.binom_two_sided("s", "n").alias("p")).collect()
    for r in rows:
        assert r.p == pytest.approx(tail_ref(r.s, r.n), rel=2e-11), (r.s, r.n)
    assert spark.createDataFrame([(0, 0), (10, 10**6)], "s long, n long").select(S.binom_two_sided("s", "n").alias("p")).collect()[1].p == 0.0


def test_scratch_files_go_with_their_block(spark):
    import os

    from rejoinder import session

    with session.scratch(spark):
        held = session.cut(spark.range(5), "held")
        path = held.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path) and held.count() == 5
    assert not os.path.exists(os.path.dirname(path))
    assert session.cut(spark.range(3), "kept").count() == 3
