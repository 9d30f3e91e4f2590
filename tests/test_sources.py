import pytest
from pyspark.sql import functions as F

from rejoinder.sources import files as FS

TRICKY = [(1, 'He said "no".\nThen left, quietly.'), (2, "semi;colon, comma"), (3, ""), (4, None), (5, "  lead"),
          (6, "trail \n"), (7, " "), (8, "\\"), (9, "null")]


@pytest.mark.parametrize("sep", [",", ";"])
def test_csv_roundtrip_keeps_quotes_newlines(spark, sep):
    df = spark.createDataFrame(TRICKY, "row_id bigint, response string")
    path = FS.scratch_path(spark, "t-csv")
    FS.write_csv(df, path, sep=sep)
    back = FS.read_csv(spark, path, "row_id bigint, response string", sep=sep, multi_line=True)
    assert {r.row_id: r.response for r in back.collect()} == dict(TRICKY)


def test_report_sink_formats(spark):
    df = spark.createDataFrame([("m", 1.5)], "model string, v double")
    for fmt in ("csv", "json", "parquet"):
        FS.write_report(df, FS.scratch_path(spark, "t-rep"), fmt)
    with pytest.raises(ValueError):
        FS.write_report(df, FS.scratch_path(spark, "t-rep"), "latex")


def test_theme_partitioned_sink_prunes(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "row_id bigint, theme string")
    path = FS.scratch_path(spark, "t-theme")
    FS.write_by_theme(df, path)
    got = FS.read_theme(spark, path, "a")
    assert sorted(r.row_id for r in got.collect()) == [1, 3]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(theme" in plan and "(theme" in plan


def test_parse_nested_list(spark):
    df = spark.createDataFrame([("[['Biden'], [], ['Robert Fico', 'Fico']]",), ("[]",)], "s string")
    r = df.select(FS.parse_nested_list("s").alias("v")).collect()
    assert r[0].v == [["Biden"], [], ["Robert Fico", "Fico"]] and r[1].v == []
    odd = spark.createDataFrame([("[['A', None], [\"None, True\", 'O\\'N']]",), (None,)], "s string")
    r = odd.select(FS.parse_nested_list("s").alias("v")).collect()
    assert r[0].v == [["A", None], ["None, True", "O'N"]] and r[1].v is None
    with pytest.raises(Exception, match="not a nested list"):
        spark.createDataFrame([("oops",)], "s string").select(FS.parse_nested_list("s")).collect()


def test_model_from_path_rule(spark):
    df = spark.createDataFrame([("/x/ct_gpt4o.csv",), ("/x/ct_llama3.csv",), ("/x/other.csv",),
                                ("/data/gpt-runs/ct_llama3.csv",), ("/y/ct_gpt.parquet/part-0.parquet",)], "p string")
    assert [r.m for r in df.select(FS.model_from_path(F.col("p")).alias("m")).collect()] == \
        ["gpt-4o", "llama", "mistral", "llama", "gpt-4o"]
