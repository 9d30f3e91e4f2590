import random

import regex

from rejoinder.llm import decontaminate as D

WORDS = "ada bolt cedar dune ember flint grove heath iris jade knoll larch".split()


def py_tokens(text):
    t = (text or "").replace(D.SLOT, " ")
    t = regex.sub(D._NAME, D.SLOT + r"a\1", t)
    t = regex.sub(D._NUMBER, D.SLOT + r"n\1", t)
    t = regex.sub(D._UNIT, D.SLOT + r"u\1", t).lower()
    return regex.findall(D._TOKEN, t)


def py_windows(tok, n):
    out = []
    for i in range(len(tok) - n + 1):
        own = tok[i:i + n]
        slots = [t for t in own if t[0] == D.SLOT]
        key = tuple(t[:2] if t[0] == D.SLOT else t for t in own) if n - len(slots) >= min(4, n) else tuple(own)
        out.append((key, slots))
    return out


def brute(docs, items):
    out = {}
    for d, text in docs:
        tok = py_tokens(text)
        for item, itext in items:
            itok = py_tokens(itext)
            n = min(len(itok), D.WINDOW)
            if not n:
                continue
            own, mine = py_windows(itok, n), py_windows(tok, n)
            lines = {}
            for p, (k, s) in enumerate(mine):
                for q, (k2, s2) in enumerate(own):
                    if k == k2:
                        at, pairs = lines.setdefault(p - q, (set(), set()))
                        at.add(q)
                        pairs.update(zip(s2, s, strict=True))
            at = set().union(*[a for a, p in lines.values() if len({x for x, _ in p}) == len(p)])
            if len(at) / len(own) >= D.MIN_SHARE:
                out.setdefault(d, set()).add(item)
    return out


def test_against_brute_force_with_changed_numbers_and_names(spark):
    rnd = random.Random(6)
    say = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n))
    question = "A farmer named {0} has 12 sheep and buys 30 more for 12 dollars from {0} then walks 5 km with them. How many stay?"
    items = [(0, question.format("Tom")), (1, say(30)), (2, say(9)), (3, "short one"), (4, None), (5, ""), (6, "1 2 3 4 5 6 7 8 9 10"), (7, say(30))]
    docs = [(1, say(50) + ". " + question.format("Ann").replace("12", "77").replace("30", "41") + " " + say(20)),
            (2, question.format("Tom").replace("12 dollars", "13 dollars")),     # 12 goes to 12 and to 13
            (3, say(40) + " " + items[1][1].upper() + " " + say(3)), (4, " ".join(items[1][1].split()[:12])), (5, None), (6, ""),
            (7, "9 8 7 6 5 4 3 2 1 0"), (8, "x 1 2 3 4 5 6 7 8 9 10"), (9, "a short one b"), (None, items[2][1]), (10, items[7][1]), (10, items[7][1])]
    docs += [(100 + i, say(rnd.randint(0, 60))) for i in range(60)]
    d = spark.createDataFrame([(*x, "k") for x in docs], "doc_id long, text string, key string").repartition(3)
    b = spark.createDataFrame([(*x, "z") for x in items], "item_id long, text string, share string")
    want = brute(docs, items)
    assert 0 in want[1] and 1 in want[3] and None in want and 3 in want[9]
    got = {r.doc_id: set(r.item_ids) for r in D.judge(d, b).collect() if r.contaminated}
    assert got == want
    assert D.judge(d, b).count() == len(docs)
    kept = D.keep_clean(d, b)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in docs if i not in want)


def test_shuffled_join_and_empty_tables(spark, monkeypatch):
    text = " ".join(WORDS)
    d = spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string")
    b = spark.createDataFrame([(5, text), (4, text)], "item_id long, text string")
    monkeypatch.setattr(D, "BROADCAST_WINDOWS", 0)
    assert [(r.doc_id, r.item_ids, r.share) for r in D.judge(d, b).where("contaminated").collect()] == [(1, [4], 1.0)]
    assert D.judge(d, b.limit(0)).where("contaminated").count() == 0 and D.judge(d.limit(0), b).count() == 0
    assert D.keep_clean(d, b.limit(0)).count() == 2


def test_ids_of_any_type_and_items_without_one(spark):
    text, other = " ".join(WORDS), " ".join(reversed(WORDS))
    d = spark.createDataFrame([("a", text), (None, other), ("c", "x")], "doc_id string, text string")
    b = spark.createDataFrame([("q1", text), (None, other)], "item_id string, text string")
    got = {r.doc_id: (r.contaminated, r.item_ids) for r in D.judge(d, b).collect()}
    assert got == {"a": (True, ["q1"]), None: (True, []), "c": (False, [])} and [r.doc_id for r in D.keep_clean(d, b).collect()] == ["c"]
    assert D.judge(d, b.limit(0)).where("contaminated").count() == 0


def test_a_very_long_text(spark):
    rnd = random.Random(3)
    say = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n))
    item = say(30)
    docs = [(1, say(15_000) + " " + item + " " + say(15_000)), (2, "a " * 100_000), (3, "x" * 300_000)]
    got = {r.doc_id: r.contaminated for r in D.judge(spark.createDataFrame(docs, "doc_id long, text string"),
                                                     spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {1: True, 2: False, 3: False}
