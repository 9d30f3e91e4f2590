"""Entities of any length, and the exact split, against brute force."""

import hashlib
import random

import pytest

from rejoinder.operators import entities as EN
from rejoinder.operators import sampling as SA


def brute_mentions(tok, gaz):
    """At a place the longest alias; none that begins inside a longest alias of an earlier place."""
    longest = {}
    for i in range(len(tok)):
        own = [n for n in range(1, len(tok) - i + 1) if " ".join(tok[i:i + n]) in gaz]
        if own:
            longest[i] = max(own)
    return {(i, " ".join(tok[i:i + n]), k) for i, n in longest.items() if all(j + m <= i for j, m in longest.items() if j < i)
            for k in gaz[" ".join(tok[i:i + n])]}


@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_entities_of_any_length_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(EN, "BROADCAST_ROWS", limit)
    rnd = random.Random(5)
    gaz = {}
    for _ in range(60):
        gaz.setdefault(" ".join(rnd.choice("abcde") for _ in range(rnd.choice([1, 1, 2, 3, 6]))), set()).add(rnd.choice(["person", "organization"]))
    texts = [" ".join(rnd.choice("abcdefg") for _ in range(rnd.randint(0, 30))) for _ in range(60)] + ["", None]
    items = spark.createDataFrame([(str(i), "m", t, None) for i, t in enumerate(texts)], "row_id string, model string, message string, response string")
    table = spark.createDataFrame([(k, a) for a, kinds in gaz.items() for k in kinds], "kind string, alias string")
    got = {}
    for r in EN.extract_entities(items, table).collect():
        got.setdefault(int(r.row_id), set()).add((r.pos, r.entity, r.kind))
    assert got == {i: m for i, t in enumerate(texts) if (m := brute_mentions((t or "").split(), gaz))}
    assert EN.extract_entities(items, table.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 50, 51, 52, 53, 150])
def test_exact_half_is_exact_and_runs_nothing_ahead(spark, n):
    df = spark.range(n).withColumnRenamed("id", "row_id")
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    out = SA.split_for_annotation_exact(df)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == len(jobs)
    counts = {r.part: r["count"] for r in out.groupBy("part").count().collect()}
    rest = max(n - 50, 0)
    assert counts.get("sample", 0) == min(n, 50) and counts.get("part_1", 0) == round(rest / 2) and sum(counts.values()) == n
    keys = sorted((hashlib.md5(f"42:{i}".encode()).hexdigest(), i) for i in range(n))
    want = {i: "sample" if k < 50 else "part_1" if k - 50 < round(rest / 2) else "part_2" for k, (_, i) in enumerate(keys)}
    assert {r.row_id: r.part for r in out.collect()} == want
