import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from rejoinder.llm import token_alignment as A

A_PATH, B_PATH = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
HARD = ["", " ", "  ", "a  b", "a \n b", "a\n b", "a ", "a  ", " a", "\n", "\t x", "it's <|endoftext|> 'll", "<s> </s> <unk> <0x41>", "▁", "a▁b c", "漢字 😀😀 é",
        "x" * 300 + " y", "\x00 a", "a  b", "a  b", "\u0085 z", "ﬁ é ①", "The quick brown fox jumps", "   many     spaces   ", "\r\n\r\n x"]


@pytest.fixture(scope="module")
def library():
    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    table = {}
    for n, c in enumerate([*range(33, 127), *range(161, 173), *range(174, 256)]):
        table[chr(c)] = c
    for n, c in enumerate(x for x in range(256) if chr(x) not in table):
        table[chr(256 + n)] = c
    return a, b, table


def tokens(library, text):
    """(A ids, B ids, A bytes, B bytes) of a text, whole."""
    a, b, table = library
    if not text:
        return [], [], [], []
    x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    xb = [bytes(table[c] for c in a.id_to_token(i)) for i in x]
    yb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
    data = (" " + text).encode()
    return (x, y, xb, yb) if b"".join(xb) == data == b"".join(yb) else ([], [], [], [])


def spans(parts):
    out, at = [], 0
    for p in parts:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def brute(library, rows):
    held = []
    for key, text in rows:
        x, y, xb, yb = tokens(library, text)
        sx, sy = spans(xb), spans(yb)
        links = [(i, j) for i, (s, e) in enumerate(sx) for j, (p, q) in enumerate(sy) if s < q and p < e]
        ends = sorted({e for _, e in sx} & {e for _, e in sy})
        groups, begin = [], 0
        for end in ends:
            groups.append(([i for i, (s, e) in enumerate(sx) if begin < e <= end], [j for j, (s, e) in enumerate(sy) if begin < e <= end]))
            begin = end
        held.append((key, x, y, links, groups))
    count = Counter((x[i], y[j]) for _, x, y, links, _ in held for i, j in links)
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = []
    for key, x, y, links, groups in held:
        text = ";".join(",".join(str(x[i]) for i in p) + "|" + ",".join(str(y[j]) for j in q) for p, q in groups)
        n = [count[x[i], y[j]] for i, j in links]
        out.append((key, len(x), len(y), len(groups), len(links), sum(c == most[y[j]] for c, (_, j) in zip(n, links, strict=True)), sum(n),
                    hashlib.sha256(text.encode()).hexdigest() if x else "", sum(len(p) * len(q) for p, q in groups)))
    return sorted(out, key=str), count


def texts(seed, n):
    rnd = random.Random(seed)
    return HARD + ["".join(rnd.choice(["the ", "ing", " ", "  ", "\n", "é", "漢", "😀", "a", "Straße ", "tokenizer", "1234", "don't ", ".", "\t", "▁", " "])
                           for _ in range(rnd.randint(0, 40))) for _ in range(n)]


def test_products_against_dense_matrices():
    rnd = np.random.default_rng(1)
    for _ in range(50):
        x, y = (rnd.integers(0, 3, s) * (rnd.random(s) < 0.4) for s in ((7, 9), (9, 5)))

        def rows(m):
            i, j = np.nonzero(m)
            return A.Rows(np.concatenate([[0], np.cumsum((m != 0).sum(1))]), j, m[i, j], m.shape[1])

        got = rows(x).times(rows(y))
        dense = np.zeros((7, 5), int)
        dense[got.cells()] = got.values
        assert (dense == x @ y).all() and len(got.values) == np.count_nonzero(x @ y)
        t = rows(x).transposed()
        dense = np.zeros((9, 7), int)
        dense[t.cells()] = t.values
        assert (dense == x.T).all()


@pytest.mark.parametrize("block", [500, 4 << 20])
def test_digests_against_brute_force(spark, library, monkeypatch, block):
    monkeypatch.setattr(A, "BLOCK_BYTES", block)
    rows = list(enumerate(texts(block, 300))) + [(3, None), (None, "the same the same"), (None, "the same the same"), (5, "the same the same")]
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "doc_id long, text string, pairs string, block int").repartition(3)
    want, count = brute(library, rows)
    assert sorted(map(tuple, A.digests(df, A_PATH, B_PATH).collect()), key=str) == want
    got = {(r.a_id, r.b_id): r["count"] for r in A.corpus_pairs(df, A_PATH, B_PATH).collect()}
    assert got == dict(count)


def test_align_gives_the_links_themselves(spark, library):
    rows = list(enumerate(texts(9, 60)))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id as id", "text", "doc_id as links")
    for r in A.align(df, A_PATH, B_PATH).collect():
        x, y, xb, yb = tokens(library, r.text)
        assert (r.a_ids, r.b_ids) == (x, y)
        both = [(i, j, min(e, q) - max(s, p)) for i, (s, e) in enumerate(spans(xb)) for j, (p, q) in enumerate(spans(yb)) if s < q and p < e]
        assert [tuple(v) for v in r.links] == both
    assert A.align(df, A_PATH, B_PATH).columns == ["id", "text", "links", "a_ids", "b_ids", "shared"]


def test_a_cut_at_spaces_is_exact_over_units(library):
    with open(A_PATH, encoding="utf-8") as f, open(B_PATH, "rb") as g:
        own = A.Aligner(f.read(), g.read())
    assert own.by_unit
    every = texts(77, 1500)
    for text, (a, b) in zip(every, own.tokens(every), strict=True):
        x, y, *_ = tokens(library, text)
        assert np.frombuffer(a, own.a.dtype).tolist() == x and np.frombuffer(b, np.int32).tolist() == y, repr(text)


def test_long_text_empty_table(spark, library):
    rows = [(1, "word another " * 40_000), (2, "é" * 200_000), (3, "a")]
    got = {r.doc_id: r for r in A.digests(spark.createDataFrame(rows, "doc_id long, text string"), A_PATH, B_PATH).collect()}
    assert {k: (r.n_a, r.n_b) for k, r in got.items()} == {k: tuple(map(len, tokens(library, t)[:2])) for k, t in rows}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert A.digests(empty, A_PATH, B_PATH).count() == 0 == A.corpus_pairs(empty, A_PATH, B_PATH).count()
    none = A.digests(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), A_PATH, B_PATH).collect()
    assert [tuple(r)[1:] for r in none] == [(0, 0, 0, 0, 0, 0, "", 0)] * 2


def test_no_row_of_a_block_grows_with_the_block(spark, library, monkeypatch):
    monkeypatch.setattr(A, "PIECE", 32, raising=False)
    rows = list(enumerate(texts(12, 300)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    held = A.blocks(df, A_PATH, B_PATH).collect()
    listed = [r for r in held if r.pairs is not None]
    assert len({r.block for r in held}) == 1 and max(len(r.pairs) for r in listed) <= 32
    assert sorted(r.doc_id for r in held if r.pairs is None) == [k for k, _ in rows]
    assert max(len(r["at"] or []) for r in held) <= max(len(r.links) for r in A.align(df, A_PATH, B_PATH).collect())
    want, _ = brute(library, rows)
    assert sorted(map(tuple, A.digests(df, A_PATH, B_PATH).collect()), key=str) == want
