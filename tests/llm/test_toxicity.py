import math
import random
import re

from pyspark.sql import functions as F

from rejoinder.llm import toxicity as X
from rejoinder.llm.common import table


def test_folding_boundaries_exceptions_and_length():
    m = X.Matcher({"idiot": 2.0, "trash": 1.0}, ["trash can"])
    one = m.features("you idiot")
    assert one[0] > 0 and m.features("You 1D10T!") == one and m.features("yоu іdіоt") == one      # Cyrillic
    assert m.features("idiotic trashy") == (0.0, 0.0) and m.features("a trash can") == (0.0, 0.0)
    assert m.features("trash can trash")[0] == m.features("a b trash")[0]
    assert m.features("idiot " + "x " * 99)[1] < one[1] and m.features("") == (0.0, 0.0)
    assert X.Matcher({}, []).features("idiot") == (0.0, 0.0)


def test_learned_model_on_planted_words(spark):
    rnd = random.Random(1)
    plain = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]
    rows = []
    for i in range(600):
        toxic = i % 5 == 0
        w = [rnd.choice(plain) for _ in range(40)]
        for _ in range(3 * toxic):
            w[rnd.randrange(40)] = rnd.choice(["blarg", "snozz"])
        if i % 10 == 1:
            w[5:7] = ["blarg", "cake"]                      # harmless phrase
        rows.append((i, " ".join(w), int(toxic)))
    copies = [(1000 + i, "same passage with glim word " + " ".join(plain[:30]), 1) for i in range(40)]
    df = spark.createDataFrame(rows + copies, "doc_id long, text string, toxic int").repartition(3)
    model = X.fit(df)
    assert set(model.words) == {"blarg", "snozz"} and "blarg cake" in model.phrases
    got = {r.doc_id: r.score for r in X.score(df.drop("toxic").withColumn("score", F.lit("x")), model).collect()}
    assert all((got[i] >= 0.3) == bool(t) for i, _, t in rows)
    odd = spark.createDataFrame([(1, None), (1, ""), (None, "BL4RG " * 3)], "doc_id long, text string")
    low = X.score(odd, model).orderBy("text").collect()
    assert low[0].score == low[1].score < 0.3 < low[2].score <= 1


def test_one_label_or_none(spark):
    none = spark.createDataFrame([], "doc_id long, text string, toxic int")
    assert X.fit(none).slopes == (0.0, 0.0)
    one = spark.createDataFrame([(1, "a", 0), (2, None, 0)], "doc_id long, text string, toxic int")
    assert [r.score < 0.5 for r in X.score(one, X.fit(one)).collect()] == [True, True]


def brute_score(model, text):
    """Matching by regular expressions word for word, and the curve, written apart from the operator."""
    same = {}
    for a, b in (p for p in X.LOOK_ALIKES.split()):
        same.setdefault(b, set()).add(a)
    low = (text or "").lower()
    spell = lambda w: "".join("[" + re.escape("".join(sorted({c, *same.get(c, ())}))) + "]" for c in w)
    edge = lambda i: i < 0 or i >= len(low) or not low[i].isalnum()

    def places(w):
        return [(m.start(), m.start() + len(w)) for m in re.finditer(f"(?={spell(w)})", low) if edge(m.start() - 1) and edge(m.start() + len(w))]

    free = [s for p in model.phrases for s in places(p)]
    total = sum(w for word, w in model.words.items() for s, e in places(word) if not any(a <= s and e <= b for a, b in free))
    z = model.bias + model.slopes[0] * math.log1p(total) + model.slopes[1] * total / max(1, len((text or "").split())) * 100
    return 1 / (1 + math.exp(-z))


def test_matching_and_scoring_against_brute_force(spark):
    model = X.Model({"idiot": 2.5, "trash": 1.25, "ass": 0.5, "it": 0.25, "trash bin": 3.0}, ("trash can", "an ass", "idiot savant"), -2.0, (0.8, 0.03))
    rnd = random.Random(2)
    bits = ["idiot", "1d10t", "IDIOT", "іdiоt", "trash", "tra5h", "7rash", "can", "an", "@ss", "ass", "it", "1t", "savant", "bin", "é", "x", "!", ".", " ", "  ", "\n", "-", "_", "$", "ß", "İ"]
    texts = [None, "", " ", "idiot " * 50_000, "x" * 200_000 + " idiot"] + [
        "".join(rnd.choice(bits) + rnd.choice(["", " ", " "]) for _ in range(rnd.randint(1, 14))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.score for r in X.score(df, model).collect()}
    hits = 0
    for i, t in enumerate(texts):
        if len(t or "") < 1000:
            want = brute_score(model, t)
            hits += want > brute_score(model, "")
            assert abs(got[i] - want) < 1e-9, (t, got[i], want)
    assert hits > 300 and got[3] > got[4] > 0.9 and got[0] == got[1] < 0.2


def test_held_out_quality(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = table(spark, d, "documents", "doc_id", "text"), table(spark, d, "labels", "doc_id", "toxic")
    model = X.fit(X.sample(docs, labels, ~X.held_out(F.col("doc_id"))))
    rows = X.score(docs, model).join(labels, "doc_id").where(X.held_out(F.col("doc_id"))).select("score", "toxic").collect()
    toxic, other = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    assert len(toxic) > 100 and len(other) > 500
    above = sum((a > b) + (a == b) / 2 for a in toxic for b in other) / len(toxic) / len(other)
    found, wrong = sum(s >= X.CUT for s in toxic) / len(toxic), sum(s >= X.CUT for s in other) / len(other)
    assert above > 0.9 and found > 0.8 and wrong < 0.01, (above, found, wrong)
