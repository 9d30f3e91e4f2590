import hashlib
import random
import struct

import public_tokenizers as P

import corpus_pipeline as C
from rejoinder.llm import byte_bpe
from rejoinder.llm import quality as Q

from . import test_decontaminate, test_jaccard_join, test_quality, test_substring_dedup


def tables(spark, folder):
    rnd = random.Random(11)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 8))) for _ in range(400)]
    say = lambda n: " ".join(rnd.choice(["the", "of", "and"]) if rnd.random() < .3 else rnd.choice(vocabulary) for _ in range(n)) + ". "
    prose = lambda k: "".join(say(12) for _ in range(k))
    items = [(i, say(20)) for i in range(5)]
    passage = prose(3)
    rows = [prose(rnd.randint(5, 15)) for _ in range(80)]
    rows += [prose(6) + passage + prose(6) for _ in range(5)] + [rows[3], rows[4]] + [rows[5] + "end", rows[6] + "tail"]
    rows += [prose(5) + items[2][1] + prose(2), prose(5) + items[4][1]]
    rows += [" ".join(f"{w}###" for w in prose(8).split()) for _ in range(6)] + [None, "", "short text", "spam spam " * 60]
    for k in range(3):                                      # near copies between 0.8 at five words and 0.9 at three
        words = prose(17).split()
        places = {20, 60, 100, 140}
        rows += [" ".join(words), " ".join(f"edit{k}" if i in places else w for i, w in enumerate(words))]
    docs = [(i, t, "en", "src", len(t or "")) for i, t in enumerate(rows)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3) \
        .write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, items


def brute_quality(docs):
    """Votes from plain Python, the estimate from their patterns."""
    def votes(t):
        n, chars, sym, dup, rep = test_quality.brute(t)
        lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        words = t.split()
        up, stops = sum(c.isupper() for c in t) / chars, sum(c in ".?" for c in t) / n
        fun = sum(w.lower() in Q.FUNCTION_WORDS for w in words) / n
        sign = lambda poor, fine: -1 if poor else 1 if fine else 0
        return (sign(sym / chars > .05, sym / chars < .01), sign(dup / len(lines) > .3, dup / len(lines) < .1),
                sign(rep / n > .25, rep / n < .1), sign(up > .25, up < .1), sign(stops < .01 or stops > .5, .03 <= stops <= .3),
                sign(fun < .05, fun > .15), sign(chars / n < 2 or chars / n > 11, 3 <= chars / n <= 9))

    passed = [d for d in docs if not (test_quality.brute(d[1])[0] < 50 or 100 * test_quality.brute(d[1])[4] > 50 * test_quality.brute(d[1])[0])]
    seen = {}
    for d in passed:
        seen[votes(d[1])] = seen.get(votes(d[1]), 0) + 1
    model = Q.estimate(sorted(seen.items()))

    def fine(v):
        p, q = model.fine, 1 - model.fine
        for rule, x in zip(Q.RULES, v, strict=True):
            p, q = p * model.given_fine[rule][x + 1], q * model.given_poor[rule][x + 1]
        return p / (p + q) >= Q.KEEP_FROM

    return [(d[0], d[1]) for d in passed if fine(votes(d[1]))]


def test_run_against_brute_force(spark, tmp_path):
    docs, items = tables(spark, str(tmp_path))
    left = brute_quality(docs)
    assert 80 <= len(left) < 101
    first = {d: c for d, (_, c) in test_jaccard_join.brute_at(left, 5, 80).items()}
    assert first != {d: c for d, (_, c) in test_jaccard_join.brute(left).items()} and first != {d: c for d, (_, c) in test_jaccard_join.brute_at(left, 5, 90).items()}
    near = [r for r in left if first[r[0]] == r[0]]
    assert len(near) < len(left)
    gone = test_substring_dedup.brute(near)
    cut = [(d, bytes(c for c, g in zip(t.encode(), gone[d][4], strict=True) if not g).decode()) for d, t in near]
    assert cut != near
    bad = test_decontaminate.brute(cut, items)
    clean = [r for r in cut if r[0] not in bad]
    assert len(clean) < len(cut)
    codec = byte_bpe.Codec(open(P.path(C.TOKENIZER), "rb").read())
    want = {}
    for (d, t), (ids, _) in zip(clean, codec.encode([t for _, t in clean]), strict=True):
        want[d] = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in C.run(spark, str(tmp_path)).collect()}
    assert got == want


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for frame in (docs, docs.limit(0)):
        for _, stage in C.STAGES[:-1]:
            assert sorted(stage(spark, frame, str(tmp_path)).dtypes) == sorted(docs.dtypes)


def test_near_duplicates_link_from_five_words_and_four_fifths(spark):
    rnd = random.Random(12)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base)]
    for edits in (2, 4, 5, 6, 12):                            # four edits: 5 words 176 / 216, 3 words 186 / 210
        places = rnd.sample(range(10, 190, 9), edits)
        texts.append(" ".join(f"e{edits}-{i}" if i in places else w for i, w in enumerate(base)))
    rows = list(enumerate(texts))
    want = test_jaccard_join.brute_at(rows, 5, 80)
    assert want != test_jaccard_join.brute_at(rows, 5, 90) and {d for d, (_, c) in test_jaccard_join.brute(rows).items() if d == c} != {d for d, (_, c) in want.items() if d == c}
    docs = spark.createDataFrame([(d, t, "en", "src", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in C.near_duplicates(spark, docs, "").collect()) == sorted(d for d, (_, c) in want.items() if d == c)
