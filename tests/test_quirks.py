"""One test per visible quirk decision."""

import pytest
from pyspark.sql import functions as F

from rejoinder.operators import agreement as AG
from rejoinder.operators import entities as EN
from rejoinder.operators import significance as SG
from rejoinder.operators.diversity import sentence_shape


def test_q6_article_stripping_correct_and_compat(spark):
    df = spark.createDataFrame([("the Federal Reserve",), ("The Economist",), ("economy",), ("Theatre",)], "e string")
    r = df.select(EN.strip_article("e").alias("a"), EN.strip_article("e", compat=True).alias("b")).collect()
    assert [x.a for x in r] == ["Federal Reserve", "Economist", "economy", "Theatre"]
    assert [x.b for x in r] == [s.lstrip("the").lstrip("The ") for s in
                                ["the Federal Reserve", "The Economist", "economy", "Theatre"]]


def test_q13_alias_with_null_canonical_drops_unknown_passes(spark):
    m = spark.createDataFrame([(1, "m", "response", "person", "Biden"), (1, "m", "response", "person", "Fico"),
                               (1, "m", "response", "person", "Nobody")],
                              "row_id long, model string, side string, kind string, entity string")
    dim = spark.createDataFrame([("person", "Biden", "Joe Biden"), ("person", "Fico", None)],
                                "kind string, alias string, canonical string")
    got = sorted((r.entity is None, r.entity or "") for r in EN.normalize_entities(m, dim).collect())
    assert got == [(False, "Joe Biden"), (False, "Nobody"), (True, "")]
    assert EN.diff_itemwise(EN.normalize_entities(m, dim)).where(F.col("entity").isNull()).count() == 0


def test_q20_missing_prediction_counts_as_wrong(spark):
    df = spark.createDataFrame([(1, "a", 1.0, None), (1, "b", 1.0, 1.0)],
                               "row_id long, model string, y_true double, y_pred double")
    c = SG.contingency_pairs(df).first()
    assert (c.n11, c.n10, c.n01, c.n00) == (0, 0, 1, 0)


def test_q5_token_share_and_sentence_share(spark):
    corpus = spark.createDataFrame([("t", "m", 1, "Why? Because. Really?")],
                                   "theme string, model string, row_id long, text string")
    r = sentence_shape(corpus).first()
    # tokens: Why ? Because . Really ?  -> 2 of 6 end with '?'; sentences: 2 of 3 end with '?'
    assert r.pct_questions == pytest.approx(round(2 / 6, 6)) and r.pct_question_sentences == pytest.approx(round(2 / 3, 6))


def test_q7_missing_as_category_changes_alpha(spark):
    rows = [("q", u, r, v) for u, (a, b) in enumerate([("1", "1"), ("0", "0"), ("1", None), (None, "0"), ("1", "0")])
            for r, v in (("r1", a), ("r2", b))]
    df = spark.createDataFrame(rows, "category string, unit long, rater string, value string")
    ign = AG.alpha(df, level="nominal").first()
    cat = AG.alpha(df, level="nominal", missing="category").first()
    assert ign.n_values == 2 and cat.n_values == 3 and ign.alpha != cat.alpha
    with pytest.raises(ValueError):
        AG.alpha(df, level="ordinal", missing="category")
