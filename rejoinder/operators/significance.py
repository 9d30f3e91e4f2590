"""Significance and classification statistics, all categories and all model pairs in one plan.

Inputs are long tables.  Scores are gathered once, one row a (category, subject) with an array of
its (model, score); ranks, ties and pairs of models are read inside that row.  Ranks of differences over
subjects are prefix sums over ranges (``ranges``), so neither a category nor a model pair gathers in one task.
Tail probabilities are column expressions (``rejoinder.functions.special``).  Nothing is rounded here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rejoinder.constants import SIGNIFICANCE_LEVEL
from rejoinder.functions.special import binom_two_sided, chi2_sf, normal_sf2, signed_rank_cdf
from rejoinder.operators.ranges import running_totals
from rejoinder.session import cut

R = 6
NO_DIFF = "No significant difference"


def _r(c):
    return F.round(c, R)


def _at_most_one(p):
    """``least`` passes over nulls, so a missing p has to be kept missing."""
    return F.when(p.isNotNull(), F.least(F.lit(1.0), p))


def score_panel(long: DataFrame, *, category: str = "category", subject: str = "subject", model: str = "model",
                score: str = "score") -> DataFrame:
    """(category, subject, s): the subject's (model, score) in order of models, written once.

    A model that scores a subject twice raises an error, as a table of subjects and models has one cell for it.
    """
    rows = long.where(F.col(model).isNotNull()).groupBy(category, subject).agg(
        F.sort_array(F.collect_list(F.struct(F.col(model).alias("model"), F.col(score).cast("double").alias("score")))).alias("s"))
    names = F.transform("s", lambda x: x["model"])
    twice = F.size(F.array_distinct(names)) < F.size(names)
    say = F.concat(F.lit("a model scores one subject twice: "), F.coalesce(F.col(category).cast("string"), F.lit("null")), F.lit(", "),
                   F.coalesce(F.col(subject).cast("string"), F.lit("null")))
    return cut(rows.select(F.col(category).alias("category"), F.col(subject).alias("subject"),
                           F.when(twice, F.raise_error(say)).otherwise(F.col("s")).alias("s")), "panel")


def _friedman(panel: DataFrame, min_models: int) -> DataFrame:
    k = panel.select("category", F.explode("s.model").alias("m")).distinct().groupBy("category").agg(F.count(F.lit(1)).alias("k"))
    rows = panel.withColumn("s", F.filter("s", lambda x: x["score"].isNotNull())).join(k, "category").where(F.size("s") == F.col("k"))

    def ranked(x):
        below = F.size(F.filter("s", lambda y: y["score"] < x["score"]))
        equal = F.size(F.filter("s", lambda y: y["score"] == x["score"]))
        # an element of a tie of t adds t^2 - 1, all of them t^3 - t
        return F.struct(x["model"].alias("model"), (below + (equal + 1) / 2.0).alias("rank"), (equal * equal - 1).cast("long").alias("tie"))

    each = rows.select("category", "k", F.posexplode(F.transform("s", ranked)).alias("at", "r"))
    by_model = each.groupBy("category", "k", "r.model").agg(
        F.sum("r.rank").alias("rj"), F.sum("r.tie").alias("tt"), F.count_if(F.col("at") == 0).alias("firsts"))
    agg = by_model.groupBy("category", "k").agg(F.sum(F.pow("rj", 2)).alias("ssbn"), F.sum("tt").alias("tt"), F.sum("firsts").alias("n"))
    kk, nn = F.col("k").cast("double"), F.col("n").cast("double")
    c = 1 - F.col("tt") / (kk * (kk * kk - 1) * nn)
    chi = F.when(c == 0, F.lit(None).cast("double")).otherwise(
        (12.0 / (kk * nn * (kk + 1)) * F.col("ssbn") - 3 * nn * (kk + 1)) / c)
    out = agg.where(F.col("k") >= min_models).select("category", chi.alias("statistic"), "n", "k")
    return out.select("category", "statistic", chi2_sf(F.col("statistic"), F.col("k") - 1).alias("p_value"),
                      (F.col("statistic") / (F.col("n") * (F.col("k") - 1))).alias("kendall_w"),
                      F.col("n").alias("n_subjects"), F.col("k").cast("long").alias("k_models"))


def friedman(long: DataFrame, *, min_models: int = 3, **columns) -> DataFrame:
    """Friedman chi-square per category over subjects scored by every model of the category.

    Output: category, statistic, p_value, kendall_w, n_subjects, k_models.  Categories with no complete
    subject or fewer than ``min_models`` models are absent.  ``columns``: names as in ``score_panel``.
    """
    return _friedman(score_panel(long, **columns), min_models)


def _wilcoxon(panel: DataFrame, gate: DataFrame | None, alpha: float, method: str, exact_max_n: int) -> DataFrame:
    if method not in ("auto", "exact", "normal"):
        raise ValueError(f"unknown method {method!r}")
    s = panel.withColumn("s", F.filter("s", lambda x: x["score"].isNotNull()))
    if gate is not None:
        s = s.join(gate.where(F.col("p_value") < alpha).select("category"), "category", "left_semi")

    def with_later(x, i):
        later = F.slice("s", i + 2, F.size("s"))
        return F.transform(later, lambda y: F.struct(x["model"].alias("model_1"), y["model"].alias("model_2"),
                                                     (x["score"] - y["score"]).alias("d")))

    pairs = s.select("category", F.explode(F.flatten(F.transform("s", with_later))).alias("p")).select("category", "p.*")
    keys = ["category", "model_1", "model_2"]
    support = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("support"),
                                        F.count_if(F.col("d") == 0).alias("n_zero"))
    hist = (pairs.where(F.col("d") != 0).groupBy(*keys, F.abs("d").alias("ad"))
            .agg(F.count(F.lit(1)).alias("t"), F.count_if(F.col("d") > 0).alias("pos")))
    hist = running_totals(hist, by=keys, order="ad", weight="t").withColumn("mid", F.col("upto") - (F.col("t") - 1) / 2.0)
    sums = hist.groupBy(*keys).agg(
        F.sum(F.col("pos") * F.col("mid")).alias("r_plus"),
        F.sum((F.col("t") - F.col("pos")) * F.col("mid")).alias("r_minus"),
        F.sum("t").alias("n_r"),
        F.sum(F.pow("t", 3) - F.col("t")).alias("tt"),
        F.max("t").alias("tmax"))
    j = support.join(sums, keys, "left")
    W = F.least("r_plus", "r_minus")
    nr = F.col("n_r").cast("double")
    se = F.sqrt((nr * (nr + 1) * (2 * nr + 1) - 0.5 * F.col("tt")) / 24.0)
    z_corr = (W - nr * (nr + 1) / 4.0) / se
    plain = (F.col("n_zero") == 0) & (F.col("tmax") <= 1)              # the exact distribution knows no ties and zeros
    exact = {"auto": plain & (F.col("n_r") <= exact_max_n), "exact": plain, "normal": F.lit(False)}[method]
    none = F.col("n_r").isNull()
    p = F.when(none, F.lit(None).cast("double")).when(
        exact, F.least(F.lit(1.0), 2.0 * signed_rank_cdf(W, F.col("n_r")))).otherwise(normal_sf2(z_corr))
    p_method = F.when(none, F.lit(None).cast("string")).when(exact, F.lit("exact")).otherwise(F.lit("normal"))
    npd = F.col("support").cast("double")
    z_stat = (W - npd * (npd + 1) / 4.0) / F.sqrt(npd * (npd + 1) * (2 * npd + 1) / 24.0)
    res = j.select(*keys, "support", W.alias("w_stat"), z_stat.alias("z_stat"), z_corr.alias("z_corrected"),
                   p.alias("p_value"), p_method.alias("p_method"), (F.col("r_plus") - F.col("r_minus")).alias("_dir"))
    fam = Window.partitionBy("category")                               # pairs of one category
    res = res.withColumn("p_bonferroni", _at_most_one(F.col("p_value") * F.count("p_value").over(fam)))
    better = (F.when(F.col("p_value").isNull(), F.lit(None).cast("string"))
              .when(F.col("p_value") >= alpha, F.lit(NO_DIFF))
              .when(F.col("_dir") > 0, F.col("model_1")).otherwise(F.col("model_2")))
    return res.select(
        *keys, F.concat_ws(" vs ", "model_1", "model_2").alias("comparison"), "w_stat", "z_stat", "z_corrected", "p_value", "p_method",
        "p_bonferroni", (F.abs(F.col("z_stat")) / F.sqrt(F.col("support").cast("double"))).alias("effect_size"),
        "support", better.alias("better_model"))


def wilcoxon_pairs(long: DataFrame, *, gate: DataFrame | None = None, alpha: float = SIGNIFICANCE_LEVEL, method: str = "auto",
                   exact_max_n: int = 50, **columns) -> DataFrame:
    """Wilcoxon signed-rank test for every model pair of every category (pairwise-complete subjects).

    Zero differences are dropped before ranking; mid-ranks of |d| are prefix sums over the counts of
    distinct |d|.  Statistic W = min(R+, R-).  ``method``: "exact" takes p from the exact null
    distribution, "normal" from the tie-corrected normal approximation, "auto" the exact one up to
    ``exact_max_n`` differences.  Pairs with zeros or ties have no exact distribution and take the normal one in any
    case; ``p_method`` tells which a row holds.  ``z_stat`` is (W - n(n+1)/4) / sqrt(n(n+1)(2n+1)/24) with
    n = all paired subjects (zeros included); ``z_corrected`` is the statistic of the approximation.
    Identical pairs yield a row with null statistic and p.  ``gate``: optional
    (category, p_value) table; only categories with p < alpha are tested.
    Bonferroni is applied within each category over the pairs that have a p-value.
    """
    return _wilcoxon(score_panel(long, **columns), gate, alpha, method, exact_max_n)


def significance_report(long: DataFrame, *, min_models: int = 3, alpha: float = SIGNIFICANCE_LEVEL, method: str = "auto",
                        exact_max_n: int = 50, **columns) -> DataFrame:
    """Friedman rows plus gated pairwise rows: category, comparison, statistic, p_value, effect_size,
    support, better_model (Friedman: effect = Kendall's W, p uncorrected; pairs: z and Bonferroni p).
    The scores are read once; the gate is on the unrounded p."""
    panel = score_panel(long, **columns)
    fr = _friedman(panel, min_models)
    pw = _wilcoxon(panel, fr, alpha, method, exact_max_n)
    a = fr.select("category", F.lit("Friedman").alias("comparison"), "statistic", "p_value",
                  F.col("kendall_w").alias("effect_size"), F.col("n_subjects").alias("support"),
                  F.lit(None).cast("string").alias("better_model"))
    b = pw.select("category", "comparison", F.col("z_stat").alias("statistic"),
                  F.col("p_bonferroni").alias("p_value"), "effect_size", "support", "better_model")
    return a.unionByName(b)


def bonferroni(df: DataFrame, *, p_col: str = "p_value", family: tuple[str, ...] = ()) -> DataFrame:
    """p * (number of p-values in the family), capped at 1.  Without ``family`` all rows are one."""
    names = list(family)
    own = df.withColumn("__all", F.lit(0)) if not names else df
    keys = names or ["__all"]
    counts = own.groupBy(*keys).agg(F.count(p_col).alias("__m"))
    counts = F.broadcast(counts) if not names else counts              # one row
    match = None
    for c in keys:
        same = F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
        match = same if match is None else match & same
    both = own.alias("x").join(counts.alias("y"), match)
    return both.select(*[F.col(f"x.{c}") for c in df.columns], _at_most_one(F.col(p_col) * F.col("__m")).alias(f"{p_col}_bonferroni"))


# --- classification ---------------------------------------------------------

def paired_predictions(pred: DataFrame, models: list[str], *, key: str = "row_id") -> DataFrame:
    """Wide (key, y_true, <model>...) for keys predicted by every model (inner-join semantics)."""
    aggs = [F.first("y_true").alias("y_true")] + \
           [F.max(F.when(F.col("model") == m, F.col("y_pred"))).alias(m) for m in models] + \
           [F.count_if(F.col("model") == m).alias(f"_n_{m}") for m in models]
    g = pred.groupBy(key).agg(*aggs)
    cond = None
    for m in models:
        e = F.col(f"_n_{m}") > 0
        cond = e if cond is None else cond & e
    return g.where(cond).select(key, "y_true", *models)


def contingency_pairs(pred: DataFrame, *, key: str = "row_id") -> DataFrame:
    """Per model pair: n11 both right, n10 only model 1, n01 only model 2, n00 neither (NaN = wrong)."""
    p = pred.select(key, "model", F.coalesce(F.col("y_pred") == F.col("y_true"), F.lit(False)).alias("ok"))
    a, b = p.alias("a"), p.alias("b")
    j = a.join(b, key).where(F.col("a.model") < F.col("b.model"))
    ra, rb = F.col("a.ok"), F.col("b.ok")
    return j.groupBy(F.col("a.model").alias("model_1"), F.col("b.model").alias("model_2")).agg(
        F.count_if(ra & rb).alias("n11"), F.count_if(ra & ~rb).alias("n10"),
        F.count_if(~ra & rb).alias("n01"), F.count_if(~ra & ~rb).alias("n00"))


def mcnemar_pairs(pred: DataFrame, **kw) -> DataFrame:
    """Exact McNemar per pair: statistic min(n10, n01), two-sided binomial p, Bonferroni over all pairs."""
    c = contingency_pairs(pred, **kw)
    s = F.least("n10", "n01")
    out = c.select("model_1", "model_2", "n11", "n10", "n01", "n00", s.alias("statistic"),
                   binom_two_sided(s, F.col("n10") + F.col("n01")).alias("p_value"))
    return bonferroni(out).withColumnRenamed("p_value_bonferroni", "p_bonferroni")


def binary_prf(pred: DataFrame, *, positive: float = 1.0) -> DataFrame:
    """Precision, recall, F1 of the positive class per model (zero denominators give 0)."""
    t, p = F.col("y_true") == positive, F.col("y_pred") == positive
    g = pred.groupBy("model").agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"),
                                  F.count_if(t & ~p).alias("fn"))
    def safe(n, d):
        return F.coalesce(F.try_divide(n.cast("double"), d.cast("double")), F.lit(0.0))
    return g.select("model", "tp", "fp", "fn",
                    _r(safe(F.col("tp"), F.col("tp") + F.col("fp"))).alias("precision"),
                    _r(safe(F.col("tp"), F.col("tp") + F.col("fn"))).alias("recall"),
                    _r(safe(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("f1"))


def classification_report(pred: DataFrame) -> DataFrame:
    """Per model: one row per class (precision, recall, f1, support), plus accuracy, macro avg, weighted avg."""
    cells = pred.groupBy("model", "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    true_side = cells.groupBy("model", F.col("y_true").alias("label")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n"))).alias("tp"))
    pred_side = cells.groupBy("model", F.col("y_pred").alias("label")).agg(F.sum("n").alias("npred"))
    per = true_side.join(pred_side, ["model", "label"], "full").select(
        "model", "label", F.coalesce("support", F.lit(0)).alias("support"),
        F.coalesce("tp", F.lit(0)).alias("tp"), F.coalesce("npred", F.lit(0)).alias("npred"))
    def safe(n, d):
        return F.coalesce(F.try_divide(n.cast("double"), d.cast("double")), F.lit(0.0))
    per = per.select("model", "label", "support",
                     safe(F.col("tp"), F.col("npred")).alias("precision"),
                     safe(F.col("tp"), F.col("support")).alias("recall"),
                     safe(2 * F.col("tp"), F.col("npred") + F.col("support")).alias("f1"), "tp")
    tot = per.groupBy("model").agg(
        F.sum("support").alias("n"), F.sum("tp").alias("correct"),
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        F.sum(F.col("precision") * F.col("support")).alias("wp"),
        F.sum(F.col("recall") * F.col("support")).alias("wr"),
        F.sum(F.col("f1") * F.col("support")).alias("wf"))
    classes = per.select("model", F.col("label").cast("string").alias("label"), _r(F.col("precision")).alias("precision"),
                         _r(F.col("recall")).alias("recall"), _r(F.col("f1")).alias("f1"), "support")
    acc = tot.select("model", F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
                     F.lit(None).cast("double").alias("recall"),
                     _r(safe(F.col("correct"), F.col("n"))).alias("f1"), F.col("n").alias("support"))
    macro = tot.select("model", F.lit("macro avg").alias("label"), _r(F.col("mp")).alias("precision"),
                       _r(F.col("mr")).alias("recall"), _r(F.col("mf")).alias("f1"), F.col("n").alias("support"))
    weighted = tot.select("model", F.lit("weighted avg").alias("label"), _r(safe(F.col("wp"), F.col("n"))).alias("precision"),
                          _r(safe(F.col("wr"), F.col("n"))).alias("recall"), _r(safe(F.col("wf"), F.col("n"))).alias("f1"),
                          F.col("n").alias("support"))
    return classes.unionByName(acc).unionByName(macro).unionByName(weighted)
