import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from rejoinder.llm import lexical_search as L

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, k=10):
    held = [(key, Counter(words(t))) for key, t in docs if words(t)]
    total, all_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for key, c in held:
            m = 10 + (90 * sum(c.values()) * total) // all_terms
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                    for t in set(words(text)) if t in c)
            if s > 0:
                scores.append((-s, key is None, key or 0))
        out += [(item, r + 1, None if x[1] else x[2], -x[0]) for r, x in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def corpus(seed, n=400):
    rnd = random.Random(seed)
    vocabulary = [f"w{int(rnd.paretovariate(0.7))}" for _ in range(300)] + ["É", "é", "ß", "漢字", "A1", "İ"]
    docs = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([0, 1, 3, 30, 200])))) for i in range(n)]
    docs += [(n + i, docs[i % 7][1]) for i in range(40)]                # exact copies: ties
    docs += [(n + 100, None), (n + 101, ""), (n + 102, " .,!\n"), (None, docs[5][1]), (None, docs[5][1]), (3, docs[4][1])]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 40)))) for i in range(15)]
    items += [(50, None), (51, ""), (52, "nowhere"), (53, docs[8][1] + " W1, w1;W2"), (54, "é É A1 a1 İ i̇")]
    rnd.shuffle(docs)
    return docs, items


@pytest.mark.parametrize("chunk", [16, 8192])
def test_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(L, "CHUNK", chunk)
    monkeypatch.setattr(L, "BUFFER", 128)
    docs, items = corpus(chunk)
    got = L.rank(spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, rank int").repartition(5),
                 spark.createDataFrame([(a, b, "x") for a, b in items], "item_id long, text string, score string")).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(docs, items)


def test_items_in_blocks_string_ids_and_repeated_items(spark, monkeypatch):
    monkeypatch.setattr(L, "QUERY_BLOCK", 4)
    docs, items = corpus(3, 60)
    items = [(f"i{a}" if a else None, b) for a, b in items] * 2
    got = L.rank(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"), k=3).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(docs, items, 3)


def test_no_documents_or_no_items(spark):
    docs, items = (spark.createDataFrame(x, s) for x, s in zip(corpus(1, 20), ("doc_id long, text string", "item_id long, text string"), strict=True))
    assert L.rank(docs.limit(0), items).count() == 0 == L.rank(docs, items.limit(0)).count() == L.rank(docs.where("text is null"), items).count()
    assert L.rank(docs, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


def test_a_very_long_text(spark):
    docs = [(1, "alpha beta " * 300_000), (2, "alpha " + "x" * 1_000_000), (3, "gamma")]
    items = [(1, "beta alpha"), (2, "x" * 1_000_000)]
    got = L.rank(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(docs, items)


def test_masks_come_by_descending_bound_and_stop_early():
    """A chunk of many masks: far fewer are scored than there are, with the right result."""
    rnd = np.random.default_rng(5)
    held = rnd.random((4000, 12)) < 0.5
    doc, term = np.nonzero(held)
    chunk = L.Chunk(list(range(4000)), np.full(4000, 100), doc, term, np.ones(len(doc), np.int64), 4000, 400_000)
    wanted = [(t, 100 + 10 * t) for t in range(12)]
    best = []
    scored = L.search(chunk, wanted, best, 10)
    factor = 10**9 // (1000 + 8 * 100)
    full = held @ np.array([w for _, w in wanted]) * factor
    order = np.lexsort((np.arange(4000), -full))[:10]
    assert sorted(((s, -k) for s, _, k in best), key=lambda x: (-x[0], x[1])) == [(int(full[i]), int(i)) for i in order]
    assert 0 < scored < 30 < len(np.unique(held, axis=0))
