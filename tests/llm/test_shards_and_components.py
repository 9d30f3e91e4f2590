import random

import pytest
from pyspark.sql import functions as F

from rejoinder.llm import shards as S
from rejoinder.llm.components import components


def dealt(spark, rows, target):
    df = spark.createDataFrame(rows, "k long, size long, shard string").repartition(3)
    add, n = S.plan(df, "k", F.col("size"), target)
    got = [(r.k, r["size"], r.shard) for r in add(df.drop("shard")).collect()]
    assert len(got) == len(rows) and {s for _, _, s in got} <= set(range(n))
    return got, n


@pytest.mark.parametrize("outliers", [[], [2**62], [-2**62, 2**62], [-2**63, 2**63 - 1], [10**9, 10**12, 10**15, 10**18]])
def test_shards_are_ranges_of_the_wanted_size(spark, monkeypatch, outliers):
    monkeypatch.setattr(S, "GRID", 64)
    rnd = random.Random(1)
    keys = [rnd.randrange(20_000) for _ in range(3000)] + outliers
    got, n = dealt(spark, [(k, 10, "x") for k in keys] + [(None, 10, None)], 1000)
    shard_of = {}
    for k, _, s in got:
        assert shard_of.setdefault(k, s) == s                               # a key has one shard
    order = [shard_of[k] for k in sorted(k for k in shard_of if k is not None)]
    assert order == sorted(order) and shard_of[None] == 0
    sizes = [sum(10 for k, _, s in got if s == x and k is not None) for x in range(n)]
    assert max(sizes) <= 1000 + 10 * max(keys.count(k) for k in set(keys)) and sum(sizes) == 10 * len(keys) and n < 70


def test_one_key_of_everything_and_empty_tables(spark):
    got, n = dealt(spark, [(7, 100, "x")] * 50 + [(8, 1, "x")], 200)
    assert n == 2 and {(k, s) for k, _, s in got} == {(7, 0), (8, 1)}
    assert dealt(spark, [], 200)[1] == 1
    assert dealt(spark, [(None, 5, "x")], 200) == ([(None, 5, 0)], 1)


def brute(links):
    label = {}
    for a, b in links:
        x, y = label.setdefault(a, a), label.setdefault(b, b)
        low = min(x, y)
        label = {k: low if v in (x, y) else v for k, v in label.items()}
    return {k: v for k, v in label.items() if k != v}


@pytest.mark.parametrize("links", [
    [], [(1, 1)], [(2, 1), (1, 2), (2, 1)], [(i, i + 1) for i in range(60)], [(i + 1, i) for i in range(60)],
    [(0, i) for i in range(1, 40)], [(99, i) for i in range(40)], [(-5, 3), (3, 2**62), (7, 8), (-2**62, 8)],
    [(random.Random(4).randrange(80), random.Random(i).randrange(80)) for i in range(50)]])
def test_components_against_brute_force(spark, links):
    df = spark.createDataFrame(links, "a long, b long").repartition(3)
    assert {r.id: r.component for r in components(df).collect()} == brute(links)
