import hashlib
import random

import pytest
from pyspark.sql import functions as F

from rejoinder.llm import substring_dedup as S


def brute(rows, length=100):
    """rows (id, text), ids distinct; null first."""
    seen, out = set(), {}
    for d, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            w = data[i:i + length]
            if w in seen:
                gone[i:i + length] = b"\1" * length
            seen.add(w)
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[d] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest(), gone)
    return out


def cases(seed):
    rnd = random.Random(seed)
    say = lambda n: "".join(rnd.choice("abcdé 漢\n") for _ in range(n))
    passages = [say(150), say(99), say(100), say(101), say(400), "Der " * 60, "x" * 300]
    texts = [None, "", "a" * 99, "a" * 100, "a" * 101, "a" * 350]
    for _ in range(60):
        texts.append("".join(rnd.choice([say(rnd.randint(0, 80)), rnd.choice(passages)]) for _ in range(rnd.randint(1, 6))))
    base = say(900)
    for _ in range(12):
        k = rnd.randrange(900)
        texts.append(base[:k] + say(3) + base[k + 2:])
    texts += [texts[10], texts[10], base, base, "a" * 350, passages[1], passages[1]]
    ids = list(range(len(texts)))
    rnd.shuffle(ids)
    return list(zip(ids, texts, strict=True)) + [(None, base[200:500])]


@pytest.mark.parametrize(("seed", "block", "batch"), [(1, 1 << 20, 1 << 20), (2, 700, 500)])
def test_against_brute_force(spark, monkeypatch, seed, block, batch):
    monkeypatch.setattr(S, "BLOCK", block)
    monkeypatch.setattr(S, "BATCH", batch)
    rows = cases(seed)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, t string").repartition(4)
    want = brute(rows)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.digests(df).collect()}
    assert got == {k: v[:4] for k, v in want.items()}
    texts = {r.doc_id: r.text for r in S.deduplicate(df).collect()}
    for d, text in rows:
        data, gone = (text or "").encode(), want[d][4]
        kept, i = [], 0
        for c in text or "":
            n = len(c.encode())
            if not all(gone[i:i + n]):
                kept.append(c)
            i += n
        assert (texts[d] or "") == "".join(kept), d
        assert data[:0] == b""


def test_order_of_suffixes_is_right():
    rnd = random.Random(4)
    texts = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 12))) for _ in range(20)]
    symbols, places = S.suffix_order(texts)
    begin = [1]
    for t in texts:
        begin.append(begin[-1] + len(t) + 1)
    want = sorted(((t[i:], j, begin[j] + i) for j, t in enumerate(texts) for i in range(len(t) + 1)), key=lambda x: (x[0], x[1]))
    assert [w[2] for w in want] == places.tolist()


def test_repeated_ids_and_rows_and_empty_tables(spark):
    a, b = "q" * 50 + "".join(map(str, range(100))), "z" * 20
    df = spark.createDataFrame([(1, a), (1, a), (1, a + b), (2, a), (None, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in S.digests(df).collect())
    removed = [r[2] for r in got]
    assert got[0][0] == "1" and len(got) == 5 and got[3] == ("2", 240, 240) and got[4] == ("None", 0, 0)
    assert sorted(removed[:3]) in ([0, 0, 240], [0, 240, 240])        # by the hash of the texts one of the two comes first
    assert S.digests(df.limit(0)).count() == 0 and S.deduplicate(df.limit(0)).columns == df.columns


@pytest.mark.parametrize("copies", [1, 2])
def test_repeats_inside_a_lone_segment(spark, copies):
    rnd = random.Random(7)
    texts = ["".join(chr(97 + 5 * k + rnd.randrange(5)) for _ in range(period)) * (400 // period + 1) for k, period in enumerate((1, 3, 40, 69, 70))]
    texts = [f"{t}{'-' * i}" for t in texts for i in range(copies)] + ["Z" * 350] * copies
    rows = list(enumerate(texts))
    want = brute(rows)
    assert want[len(rows) - copies][1] == 349
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: v[:4] for k, v in want.items()}


def test_segments_tell_whether_their_key_stands_twice():
    rnd = random.Random(8)
    for data in [bytes(rnd.choice(b"abcdefgh") for _ in range(n)) * k for n, k in ((100, 1), (700, 1), (30, 9), (69, 5), (90, 4), (1, 500), (140, 3))]:
        grams = [data[i:i + S.GRAM] for i in range(len(data) - S.GRAM + 1)]
        for _, a, b, twice in zip(*S.segments(data), strict=True):
            common = set.intersection(*(set(grams[i:i + S.LENGTH - S.GRAM + 1]) for i in range(a, b + 1)))
            inside = grams[a:b + S.LENGTH - S.GRAM + 1]
            windows = [data[i:i + S.LENGTH] for i in range(a, b + 1)]
            assert twice or (len(set(windows)) == len(windows) and any(inside.count(g) == 1 for g in common))
            assert not twice or any(inside.count(g) > 1 for g in inside)


@pytest.mark.parametrize("batch", [1, 3, 10_000])
def test_told_holds_one_row_back(spark, batch):
    rnd = random.Random(batch)
    rows = []
    for d in range(400):
        m, twice = rnd.randrange(60), rnd.random() < 0.1
        g = rnd.choice([m, m, m + 100, rnd.randrange(5)])
        rows.append((m, g, d, rnd.randrange(2), (rnd.randrange(9) << S.PLACE) + (rnd.randrange(7) << 2) + twice * S.TWICE))
    seen, marked = set(), []
    for m, g, d, t, place in rows:                          # some equal ones are known ahead
        again = (m, g) in seen and rnd.random() < 0.5
        seen.add((m, g))
        marked.append((m, g, d, t, place + again * S.AGAIN))
    want = []
    for m in {r[0] for r in marked}:
        contents = {r[1] for r in marked if r[0] == m}
        for g in contents:
            own = sorted((r for r in marked if r[:2] == (m, g)), key=lambda r: (r[4] & S.AGAIN, r[2], r[3], r[4]))
            for k, (_, _, d, t, place) in enumerate(own):
                if k or len(contents) > 1 or place & S.TWICE:
                    first = place >> S.PLACE
                    want.append((m, d, t, first, first + ((place & 0xFFFFFFFF) >> 2), k > 0))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = [tuple(r) for r in S._told(spark.createDataFrame(marked, S.SEGMENT)).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert sorted(got) == sorted(want)


def test_a_passage_of_all_documents_sends_a_row_a_batch(spark):
    passage = " ".join(f"shared{i}" for i in range(60))
    docs = spark.createDataFrame([(i, 0, f"{i} {passage} {i}") for i in range(300)], "d long, t long, text string").coalesce(2)
    found = S._segments(docs)
    hot = found.groupBy("m", "g").count().where("count = 300").first()
    assert found.where((F.col("m") == hot.m) & (F.col("g") == hot.g) & (F.col("place").bitwiseAND(F.lit(S.AGAIN)) == 0)).count() <= 2


def test_very_long_texts(spark):
    rnd = random.Random(9)
    long = "".join(rnd.choice("abcdefgh ") for _ in range(60_000))
    rows = [(1, long), (2, "z" + long[5000:40_000] + "y"), (3, long + long[:300]), (4, "ab" * 20_000)]
    got = {r.doc_id: tuple(r)[1:] for r in S.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute(rows)
    assert got == {k: v[:4] for k, v in want.items()}
