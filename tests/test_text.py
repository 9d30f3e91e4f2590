import re

from pyspark.sql import functions as F

from rejoinder.functions import text as T

EDGE = [None, "", "   ", '""', "one", "a b c", "no tag here", "x  y\tz\n", "Hello, world! Is it? Yes... ok",
        "don't stop 'til", "flags \U0001F1E9\U0001F1EA and \U0001F600!", "see https://a.b/c, and http://x.y?q=1#f",
        "#tag1 #Tag_2 #ünï", "théâtre ÉTÉ naïve"]


def _rows(spark, fn):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(EDGE)], "i int, t string")
    return {r.i: r.v for r in df.select("i", fn(F.col("t")).alias("v")).collect()}


def test_ws_tokens_match_python_split(spark):
    got = _rows(spark, T.ws_tokens)
    for i, t in enumerate(EDGE):
        if t is not None:
            assert got[i] == t.split(), t


def test_simple_tokens_match_python_re(spark):
    got = _rows(spark, T.simple_tokens)
    for i, t in enumerate(EDGE):
        if t is not None:
            assert got[i] == re.findall(r"\b\w+(?:'\w+)?\b", t), t


def test_hashtags_urls_emojis(spark):
    h, u, e = _rows(spark, T.hashtags), _rows(spark, T.urls), _rows(spark, T.emojis)
    for i, t in enumerate(EDGE):
        if t is None:
            continue
        assert h[i] == re.findall(r"#\w+", t)
        assert u[i] == re.findall(r"(https?://[^\s]+)", t)      # keeps the trailing comma
        assert len(e[i]) == len(re.findall("[\U0001F600-\U0001F64F\U0001F1E0-\U0001F1FF]", t))


def test_ngrams(spark):
    df = spark.createDataFrame([("a b c d",), ("x",), ("",)], "t string")
    r = df.select(T.ngrams(T.ws_tokens("t"), 2).alias("b"), T.ngrams(T.ws_tokens("t"), 3).alias("c")).collect()
    assert r[0].b == ["a b", "b c", "c d"] and r[0].c == ["a b c", "b c d"]
    assert r[1].b == [] and r[2].c == []


def test_sentences_rule(spark):
    df = spark.createDataFrame([("One. Two!  Three?\nFour... five",), ("no end",), ("   ",)], "t string")
    r = [x.s for x in df.select(T.sentences("t").alias("s")).collect()]
    assert r[0] == ["One.", "Two!", "Three?", "Four...", "five"]
    assert r[1] == ["no end"] and r[2] == []


def test_trim_chars_and_strip(spark):
    df = spark.createDataFrame([(' " quoted" ',), ("  x \n",)], "t string")
    r = df.select(T.trim_chars("t").alias("a"), T.strip_ws("t").alias("b")).collect()
    assert r[0].a == ' " quoted" '.strip(' "') and r[1].b == "  x \n".strip()
