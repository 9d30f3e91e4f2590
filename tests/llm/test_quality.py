import random
import re

import numpy as np

from rejoinder.llm import quality as Q


def brute(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    repeated = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(repeated))


def cases():
    rnd = random.Random(4)
    texts = [None, "", " ", "\n\n", "a", "a b", "a a a", "a a a a a", "a b c a b c", "x\x85y \xa0z", "é😀 #*$ é😀",
             "l\nl\n l\nl\n", "\x1c\x0b\x0c", "a b c d a b c x a b c", "w " * 3000]
    return texts + [" ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 30))) + "\n" * rnd.randint(0, 2) for _ in range(200)]


def test_base_counts_against_brute_force(spark):
    texts = cases()
    df = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)], "doc_id long, text string, n_words int").repartition(3)
    voted = Q.votes(Q.features(df))
    got = {r.doc_id: r for r in Q.judge(voted, Q.fit(voted)).collect()}
    for i, t in enumerate(texts):
        want = brute(t)
        assert tuple(got[i][c] for c in Q.BASE) == want, repr((t or "")[:60])
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert got[i].base_failed == failed and not (failed and got[i].kept)


def test_estimation_recovers_rules_of_known_accuracy():
    rnd = np.random.default_rng(0)
    n, fine = 20000, rnd.random(20000) < 0.8
    against_poor = np.array([.9, .6, .7, .5, .8, .6, .7])
    votes = np.where(fine[:, None], np.where(rnd.random((n, 7)) < .03, -1, 1), np.where(rnd.random((n, 7)) < against_poor, -1, 1))
    votes[rnd.random((n, 7)) < .2] = 0
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = Q.estimate(zip(map(tuple, patterns.tolist()), counts.tolist(), strict=True))
    assert abs(model.fine - 0.8) < 0.02
    for j, rule in enumerate(Q.RULES):
        assert abs(model.given_poor[rule][0] - 0.8 * against_poor[j]) < 0.05
        assert abs(model.given_fine[rule][0] - 0.8 * .03) < 0.02


def test_filter_keeps_columns_rows_and_empty_tables(spark):
    prose = " ".join(f"the word{i} of" for i in range(60)) + "."
    junk = " ".join(f"W{i}###" for i in range(200))
    rows = [(1, prose, "x"), (1, prose, "x"), (None, prose + " end", "y"), (2, junk, "z"), (3, None, "n")] + \
           [(10 + i, prose.replace("word", f"v{i}w"), "x") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = Q.keep_fine(df)
    assert got.columns == df.columns
    assert {(r.doc_id, r.kept) for r in got.collect()} >= {(1, "x"), (None, "y")} and got.count() == 53
    assert Q.keep_fine(df.limit(0)).count() == 0
