"""Inputs that the driver tables do not hold."""

import hashlib

import numpy as np
import pytest

from rejoinder.operators import agreement as AG
from rejoinder.operators import corpus as C
from rejoinder.operators import diversity as D
from rejoinder.operators import generate as GE
from rejoinder.operators import pairs as P
from rejoinder.operators import selfbleu as SB
from rejoinder.operators import vectors as V


def test_null_group_keys_are_dropped_everywhere(spark):
    rows = [(1, 1, "m", None, "a b c d e"), (2, 2, "m", None, "a b c d f"), (3, 3, "m", "t", "a b c d e"),
            (4, 4, "m", "t", "x y z w v")]
    df = spark.createDataFrame(rows, "row_id long, message_id long, model string, theme string, response string")
    corpus = C.corpora(df, with_random=True)
    assert corpus.where("theme is null").count() == 0
    for f in (lambda c: D.distinct_ngrams(c, group_cols=("theme", "model"), orders=(1, 2)),
              lambda c: SB.self_bleu(c, group_cols=("theme", "model")),
              lambda c: P.jaccard_diversity(c, group_cols=("theme", "model"))):
        assert {r.theme for r in f(corpus).collect()} == {"t"}


def test_encoder_hook(spark):
    def encode(texts):
        return texts.map(lambda t: [float(len(t)), 1.0])

    df = spark.createDataFrame([(1, "abc"), (2, "")], "row_id long, text string")
    got = V.embed_text(df, encoder=encode).orderBy("row_id").collect()
    assert [r.embedding for r in got] == [[3.0, 1.0], [0.0, 1.0]]


def test_generation_sees_prompts_and_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, "one two"), (2, "three")], "row_id long, message string")
    p = GE.build_prompts(df, system_prompt="S.", layout="user_with_prefix", assistant_prefix="A:")
    assert p.orderBy("row_id").first().prompt[0].content == "S. one two"
    out = GE.batch_generate(p).orderBy("row_id").collect()
    assert out[1].message == "three" and out[1].model_output.startswith("S. three")


def brute_alpha(units, level):
    units = [[v for v in u if v is not None] for u in units]
    units = [u for u in units if len(u) > 1]
    domain = sorted({v for u in units for v in u})
    at = {v: i for i, v in enumerate(domain)}
    o = np.zeros((len(domain), len(domain)))
    for u in units:
        for i, a in enumerate(u):
            for j, b in enumerate(u):
                if i != j:
                    o[at[a], at[b]] += 1 / (len(u) - 1)
    n = o.sum(1)
    d = np.zeros_like(o)
    for c in range(len(domain)):
        for k in range(len(domain)):
            lo, hi = min(c, k), max(c, k)
            d[c, k] = (c != k) if level == "nominal" else (n[lo:hi + 1].sum() - (n[c] + n[k]) / 2) ** 2 * (c != k)
    return 1 - (n.sum() - 1) * (o * d).sum() / (np.outer(n, n) * d).sum()


@pytest.mark.parametrize("level", ["nominal", "ordinal"])
def test_alpha_against_pairs_of_values(spark, level):
    rng = np.random.default_rng(2)
    units = [[None if rng.random() < .2 else float(max(1, min(5, base + rng.integers(-1, 2)))) for _ in range(4)]
             for base in rng.integers(1, 6, 60)]
    rows = [("q", u, str(r), v) for u, own in enumerate(units) for r, v in enumerate(own)]
    df = spark.createDataFrame(rows, "category string, unit long, rater string, value double")
    assert AG.alpha(df, level=level).first().alpha == pytest.approx(brute_alpha(units, level), abs=2e-6)


@pytest.mark.parametrize("level", ["nominal", "ordinal"])
def test_alpha_lists_the_value_domain(spark, level):
    rows = [("q", 1, 10.0), ("q", 1, 2.0), ("q", 2, 2.0), ("q", 2, 2.0), ("q", 3, 1.0), ("q", 3, None), ("r", 1, 4.0), ("r", 1, 4.0)]
    df = spark.createDataFrame(rows, "category string, unit long, value double")
    got = AG.alpha(df, level=level).collect()
    assert [(r.category, r.n_values, r["values"]) for r in got] == [("q", 3, "1.0,10.0,2.0")]


def test_baseline_counts_a_message_in_each_of_its_themes(spark):
    import rejoinder.plans.catalog as K
    rows = [(1, 1, "m0", 1, [1.0, 0.0]), (2, 2, "m0", 1, [0.0, 1.0]), (3, 3, "m0", 2, [1.0, 0.0]), (4, 4, "m0", 2, [1.0, 1.0])]
    own = spark.createDataFrame(rows, "vec_id long, message_id long, model string, theme long, embedding array<float>")
    old, K.X.vectors = K.X.vectors, lambda s, d: own
    try:
        got = {r.scope: r.n for r in K.QUERIES["semantic_baseline"](spark, "").collect()}
    finally:
        K.X.vectors = old
    assert got == {"all": 3, "theme=1": 2, "theme=2": 2}


def _sparse_ref(texts, features):
    place = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % features     # noqa: E731
    bags = [{i: sum(place(w) == i for w in t.split()) for i in map(place, t.split())} for t in texts]
    out = []
    for bag in bags:
        v = {i: c * np.log((len(texts) + 1) / (sum(i in b for b in bags) + 1)) for i, c in bag.items()}
        norm = np.sqrt(sum(x * x for x in v.values()))
        out.append({i: x / norm for i, x in v.items() if x})
    return out


TEXTS = ["a b b c", "a c d", "a", "e e e f b", "", None, "e f f"]


def test_embed_text_returns_the_whole_vector(spark, tmp_path):
    from rejoinder.plans.catalog import QUERIES

    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {}
    for r in QUERIES["embed_text"](spark, str(tmp_path)).collect():
        got.setdefault(r.row_id, {})[r.i] = r.x
    want = _sparse_ref([t or "" for t in TEXTS], 1 << 12)
    assert got == {d: {i: pytest.approx(x, abs=1e-5) for i, x in v.items()} for d, v in enumerate(want) if v}


@pytest.mark.parametrize("block", [3, 4096])
def test_sparse_vectors_find_their_nearest(spark, monkeypatch, block):
    monkeypatch.setattr(P, "BLOCK", block)
    rng = np.random.default_rng(6)
    texts = TEXTS + [" ".join(rng.choice(list("abcdefghijkl"), int(rng.integers(0, 9)))) for _ in range(40)]
    df = spark.createDataFrame([(i, "g", t) for i, t in enumerate(texts)], "row_id long, theme string, text string")
    emb = V.embed_text(df, id_cols=["theme", "row_id"], num_features=64)
    assert emb.columns == ["theme", "row_id", "embedding"] and emb.count() == len(texts)
    got = {r.row_id: r.max_sim for r in V.semantic_max(emb, group_cols=["theme"], id_col="row_id").collect()}
    want = _sparse_ref([t or "" for t in texts], 64)
    for i, a in enumerate(want):
        best = max(sum(x * b.get(k, 0) for k, x in a.items()) for j, b in enumerate(want) if j != i)
        assert got[i] == pytest.approx(best, abs=1e-9)
