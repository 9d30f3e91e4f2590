import random
import re

import numpy as np
import pytest

from rejoinder.llm import jaccard_join as J


def brute_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + 3]) for i in range(len(w) - 2)} or ({tuple(w)} if w else set())


def brute(rows):
    s = [brute_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            o = len(s[i] & s[j])
            if o and 100 * o >= 90 * (len(s[i]) + len(s[j]) - o):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    low = {}
    for i, (d, _) in enumerate(rows):
        low.setdefault(root(i), []).append(d)
    return {rows[i][0]: (len(s[i]), rows[i][0] if not s[i] else min(low[root(i)])) for i in range(len(rows))}


def family(rnd, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rnd.randint(0, edits)):
            w[rnd.randrange(len(w))] = f"e{rnd.randrange(10**6)}"
        if rnd.random() < .3:
            w += [f"t{rnd.randrange(50)}" for _ in range(rnd.randint(0, edits))]
        out.append(" ".join(w))
    return out


def cases(seed):
    rnd = random.Random(seed)
    texts = [None, "", " \n", "a", "A", "a b", "a  B", "a b c", "A b\nc", "a b\x85c", "x " * 50]
    for length in (10, 11, 12, 20, 25, 60, 200):
        base = [f"w{rnd.randrange(500)}" for _ in range(length)]
        texts += family(rnd, base, 25, max(1, length // 40)) + family(rnd, base, 8, max(1, length // 12))
    common = [f"c{i}" for i in range(14)]
    texts += [" ".join(common + [f"u{rnd.randrange(10**6)}" for _ in range(6)]) for _ in range(60)]
    chain = [f"k{i}" for i in range(100)]
    for i in range(40):                                       # neighbours link, distant ones do not
        chain = [*chain[2:], f"k{100 + 2 * i}", f"k{101 + 2 * i}"]
        texts.append(" ".join(chain))
    ids = list(range(len(texts)))
    rnd.shuffle(ids)
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize(("seed", "block", "whole"), [(1, 4096, 512), (2, 5, 20)])
def test_against_brute_force(spark, monkeypatch, seed, block, whole):
    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(J, "WHOLE", whole)
    rows = cases(seed)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n long").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.join(df).collect()}
    assert got == brute(rows)


def test_every_linked_pair_shares_a_key():
    rnd = np.random.default_rng(3)
    for n in [*range(9, 60), 100, 333, 1000]:
        for _ in range(20):
            a = np.unique(rnd.integers(0, 2**63, n).astype(np.uint64))
            gone = int(rnd.integers(0, n // 10 + 1))
            new = np.unique(rnd.integers(0, 2**63, int(rnd.integers(0, n // 9 + 2))).astype(np.uint64))
            b = np.union1d(a[gone:], new)
            if J.linked(a, b):
                assert len(np.intersect1d(J.keys(a), J.keys(b)))


def test_tree_loses_no_linked_point():
    rnd = np.random.default_rng(5)
    base = [np.unique(rnd.integers(0, 2**63, 80).astype(np.uint64)) for _ in range(10)]
    members = [np.union1d(b[int(rnd.integers(0, 6)):], rnd.integers(0, 2**63, int(rnd.integers(0, 6))).astype(np.uint64)) for b in base for _ in range(40)]
    points, sizes = np.array([J.point(s) for s in members]), np.array([len(s) for s in members])
    tree = J.CountTree(points, sizes)
    for i, s in enumerate(members):
        found = set(tree.near(points[i], len(s))[0].tolist())
        assert {j for j, t in enumerate(members) if J.linked(s, t)} <= found and len(found) < 80


def test_packed_sets_never_refute_a_link_and_confirm_only_links(monkeypatch):
    monkeypatch.setattr(J, "WHOLE", 40)
    rnd, told = np.random.default_rng(7), {-1: 0, 0: 0, 1: 0}
    for n in (5, 30, 41, 45, 300, 2000):
        for _ in range(60):
            a = np.unique(rnd.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
            b = np.union1d(a[int(rnd.integers(0, n // 6 + 1)):], rnd.integers(0, 2**63, int(rnd.integers(0, n // 9 + 2))).astype(np.uint64))
            v = J.verdict(len(a), J.packed(a), len(b), J.packed(b))
            told[v] += 1
            assert v == -1 or v == J.linked(a, b)
            assert v != -1 or max(len(a), len(b)) > 40
    assert min(told.values()) > 20


def test_nearest_and_merging_against_all_pairs():
    rnd = np.random.default_rng(11)
    for m in (1, 2, 9, 16, 17, 60):
        base = [np.unique(rnd.integers(0, 2**63, 100).astype(np.uint64)) for _ in range(3)]
        sets = [np.union1d(base[i % 3][int(rnd.integers(0, 8)):], rnd.integers(0, 2**63, int(rnd.integers(0, 8))).astype(np.uint64)) for i in range(m)]
        points, sizes, comp = np.array([J.point(s) for s in sets]), np.array([len(s) for s in sets]), rnd.integers(0, 5, m)
        at, gap = J.nearest(points, sizes, comp)
        for i in range(m):
            near = {j: np.abs(points[i].astype(int) - points[j]).sum() / (sizes[i] + sizes[j]) for j in range(m) if comp[i] != comp[j]}
            near = {j: d for j, d in near.items() if 19 * d <= 1 + 1e-9}
            assert at[i] == -1 and not near or abs(gap[i] - min(near.values())) < 1e-9 and at[i] in near
        edges, part = J.forest(points, sizes, comp), list(range(m))
        for i, j in edges:
            assert part[i] != part[j] and comp[i] != comp[j]
            part = [part[j] if x == part[i] else x for x in part]
        for i in range(m):
            for j in range(m):
                if comp[i] != comp[j] and 19 * np.abs(points[i].astype(int) - points[j]).sum() <= sizes[i] + sizes[j]:
                    assert part[i] == part[j]
        out, label = J.merging(sets, points, sizes, comp), comp.copy()
        for i, j in out:
            assert J.linked(sets[i], sets[j]) and label[i] != label[j]
            label[label == label[i]] = label[j]
        assert all(label[i] == label[j] for i in range(m) for j in range(m) if J.linked(sets[i], sets[j])) and len(out) < m


def test_one_id_with_several_texts(spark):
    long, short = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(40))
    rows = [(1, long), (1, short), (2, short + " x"), (3, long + " y"), (4, short), (4, short), (5, long + " y")]
    got = {r.doc_id: r.component_id for r in J.join(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.doc_id > 1}
    assert got[2] == got[4] and got[3] == got[5]


def test_a_very_long_text(spark):
    base = [f"w{i * 7919 % 100_003}" for i in range(120_000)]
    rows = [(1, " ".join(base)), (2, " ".join(base[3000:])), (3, " ".join(base[40_000:])), (4, "x " * 200_000)]
    got = {r.doc_id: r.component_id for r in J.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_filter_null_ids_and_empty_tables(spark):
    t = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(3, t, "a"), (1, t + " x", "b"), (None, t, "c"), (None, None, "d"), (5, "", "e"), (6, "", "f")], "doc_id long, text string, id string")
    assert sorted(r.id for r in J.keep_one(df).collect()) == ["b", "c", "d", "e", "f"] and J.keep_one(df).columns == df.columns
    assert J.join(df.limit(0)).count() == 0


def brute_at(rows, size, percent):
    """Components as in ``brute``, for word n-grams of ``size`` words and another similarity."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in rows]
    s = [{tuple(w[i:i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set()) for w in words]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            o = len(s[i] & s[j])
            if label[i] != label[j] and o and 100 * o >= percent * (len(s[i]) + len(s[j]) - o):
                label = [label[j] if x == label[i] else x for x in label]
    low = {}
    for (d, _), x in zip(rows, label, strict=True):
        low[x] = min(d, low.get(x, d))
    return {d: (len(s[i]), low[label[i]]) for i, (d, _) in enumerate(rows)}


@pytest.mark.parametrize(("size", "percent"), [(5, 80), (2, 55)])
def test_other_sizes_and_similarities(spark, size, percent):
    rows = cases(size)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.join(df, size=size, similarity=percent / 100).collect()}
    assert got == brute_at(rows, size, percent)


@pytest.mark.parametrize("similarity", [1.0, 0.95, 0.8, 0.7, 0.5, 0.2])
def test_linked_pairs_share_a_key_and_stay_in_the_tree(similarity):
    rnd, pairs = np.random.default_rng(9), 0
    for n in [*range(1, 40), 100, 333, 1000]:
        for _ in range(20):
            a = np.unique(rnd.integers(0, 2**63, n).astype(np.uint64))
            new = rnd.integers(0, 2**63, int(rnd.integers(0, n * (1 - similarity) + 2))).astype(np.uint64)
            b = np.union1d(a[int(rnd.integers(0, n * (1 - similarity) + 1)):], new)
            if J.linked(a, b, similarity) and len(a) + len(new) and not np.array_equal(a, b):
                pairs += 1
                assert len(np.intersect1d(J.keys(a, similarity), J.keys(b, similarity)))
                small, large = sorted((a, b), key=len)
                assert len(J.CountTree(J.point(large)[None], np.array([len(large)])).near(J.point(small), len(small), similarity)[0])
    assert pairs > 50 or similarity == 1
