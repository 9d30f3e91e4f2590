import pytest
from pyspark.sql import functions as F

from rejoinder.functions import normalize as N
from rejoinder.operators import sampling as SA
from rejoinder.operators import shape as SH


def test_parse_tagged_edge_cases(spark):
    rows = [(0, None), (1, "no tag"), (2, "a<XXX>b"), (3, "pre<XXX>speech<XXX>post"), (4, "a<XXX>b<XXX>c<XXX>d")]
    df = spark.createDataFrame(rows, "row_id long, model_output string")
    got = {r.row_id: (r.model_counter_speech, r.model_strategies) for r in SH.parse_tagged_output(df).collect()}
    assert got[0] == (None, None)
    assert got[1] == ("no tag", "")
    assert got[2] == ("b", "a ")
    assert got[3] == ("speech", "pre post")
    assert got[4] == ("b", "a c\nd")


def test_normalisers(spark):
    df = spark.createDataFrame([("n/a",), (None,), ("0",), ("0.0",), ("3",), ("",)], "v string")
    r = df.select(N.ordinal("v").alias("o"), N.nominal("v").alias("n"), N.binary("v").alias("b"),
                  N.sign("v").alias("s")).collect()
    assert [x.o for x in r] == [None, None, None, None, 3.0, None]
    assert [x.n for x in r] == [None, None, "0", "0.0", "3", ""]
    assert [x.b for x in r] == ["0", "0", "0", "0", "1", "0"]
    assert [x.s for x in r] == [-1.0, -1.0, -1.0, -1.0, 1.0, -1.0]
    with pytest.raises(ValueError):
        N.normalize("v", "interval")


def test_overlay_merge_priority_and_fallback(spark):
    base = spark.createDataFrame([(1, "b1"), (2, "b2"), (3, None)], "row_id long, a string")
    o1 = spark.createDataFrame([(1, "x1", "e1"), (2, "x2", None)], "row_id long, a string, extra string")
    o2 = spark.createDataFrame([(1, None, "f1"), (3, "y3", None)], "row_id long, a string, extra string")
    m = {r.row_id: (r.a, r.extra) for r in SH.overlay_merge(base, [o1, o2]).collect()}
    assert m == {1: ("x1", "f1"), 2: ("x2", None), 3: ("y3", None)}
    # idempotent: applying the same overlay twice changes nothing
    m2 = {r.row_id: (r.a, r.extra) for r in SH.overlay_merge(base, [o1, o2, o2]).collect()}
    assert m2 == m


def test_guards(spark):
    a = spark.createDataFrame([(1,), (2,)], "row_id long")
    b = spark.createDataFrame([(2,), (3,)], "row_id long")
    with pytest.raises(SH.GuardError):
        SH.check_disjoint(a, b)
    SH.check_disjoint(a, spark.createDataFrame([(5,)], "row_id long"))
    with pytest.raises(SH.GuardError):
        SH.check_coverage(a.unionByName(b), [a])


def test_split_is_disjoint_and_covering(spark):
    df = spark.range(0, 500).withColumnRenamed("id", "row_id")
    parts = SA.split_for_annotation(df, n_sample=50)
    counts = {r.part: r["count"] for r in parts.groupBy("part").count().collect()}
    assert counts["sample"] == 50 and sum(counts.values()) == 500
    assert parts.select("row_id").distinct().count() == 500
    SH.check_coverage(df, [parts.where(F.col("part") == p) for p in counts])


def test_split_compound_default(spark):
    df = spark.createDataFrame([("1-0",), (None,)], "h string")
    r = SH.split_compound_label(df, "h").collect()
    assert (r[0].h_message, r[0].h_response) == (1.0, 0.0) and (r[1].h_message, r[1].h_response) == (0.0, 0.0)


def test_exact_half_split_sizes(spark):
    for n in (151, 152):                       # rest = 101 -> round(50.5) = 50 ; rest = 102 -> 51
        df = spark.range(0, n).withColumnRenamed("id", "row_id")
        parts = SA.split_for_annotation_exact(df, n_sample=50)
        counts = {r.part: r["count"] for r in parts.groupBy("part").count().collect()}
        assert counts["sample"] == 50
        assert counts["part_1"] == round((n - 50) * 0.5)
        assert counts["part_1"] + counts["part_2"] == n - 50
