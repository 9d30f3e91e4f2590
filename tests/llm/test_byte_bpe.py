import base64
import hashlib
import random
import struct
import sys

import public_tokenizers as P
import pytest
import tiktoken

from rejoinder.llm import byte_bpe as B

PATH = P.path("byte_bpe_multi_50k.tiktoken")
HARD = ["", " ", "  ", "a", "it's we'll I'VE 's ''s 'stop '' 'l 'll x're 've", " 's", "  's", "\n's", "a\n's", "'re're'",
        "a \n b\n\n c   d \t", "x  ", "\r\n\r\n", "123abc456", "№①²x", "a b　 c", "\x1c\x1d\x85x", "étude", "日本語 テスト",
        "😀😀 😀'd", "don't'", "'t 't't", " '", "'", "a'", "O'Neil's '90s", "   z", "a\x00b", "</s>[INST]"]


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equal_to_library_on_hard_and_random_texts():
    rnd = random.Random(1)
    alphabet = "ab 's'tlrevdm\n\t 12é 漢😀!?' "
    texts = HARD + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    texts += ["x" * 5000, " " * 3000 + "y", "ab'll" * 500, "".join(rnd.choice("abcde") for _ in range(2000))]
    ref, codec = reference(), B.Codec(open(PATH, "rb").read())
    for text, (ids, offsets) in zip(texts, codec.encode(texts), strict=True):
        assert ids.tolist() == ref.encode_ordinary(text), repr(text[:80])
        assert codec.decode(ids.tolist()) == text.encode()
        assert (len(offsets) == 0) == (text == "") and (not text or offsets[0] == 0)


def test_every_code_point_class():
    """Ids alone need not show where slices break: compare the slices of ``a?a1?1 `` with the library's."""
    codec = B.Codec(open(PATH, "rb").read())
    single = tiktoken.Encoding("one", pat_str=r"a\p{L}a|1\p{N}1|\s\s", special_tokens={},
                               mergeable_ranks={bytes([b]): b for b in range(256)})
    points = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    text = "".join(f"a{chr(c)}a1{chr(c)}1 {chr(c)}!" for c in points)
    found = bytes(single.encode_ordinary(text)).decode()
    letters, numbers = set(), set()
    for m in range(0, len(found)):
        if found[m] == "a" and m + 2 < len(found) and found[m + 2] == "a":
            letters.add(found[m + 1])
        if found[m] == "1" and m + 2 < len(found) and found[m + 2] == "1":
            numbers.add(found[m + 1])
    for c in points:
        want = B.LETTER if chr(c) in letters else B.NUMBER if chr(c) in numbers else None
        if want is not None:
            assert codec.classes[c] == want, hex(c)
        else:
            assert codec.classes[c] not in (B.LETTER, B.NUMBER) or chr(c) in "a1", hex(c)


@pytest.mark.parametrize("chunk", [1, 7, 100])
def test_chunks_do_not_matter(monkeypatch, chunk):
    monkeypatch.setattr(B, "CHUNK", chunk)
    ref, codec = reference(), B.Codec(open(PATH, "rb").read())
    assert [i.tolist() for i, _ in codec.encode(HARD)] == [ref.encode_ordinary(t) for t in HARD]


def test_spark_columns_nulls_repeats_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "it's  ok", "x"), (1, "it's  ok", "y"), (2, None, None), (None, "", "z")],
                               "doc_id long, text string, ids string")
    got = B.decode(B.encode(df, PATH), PATH).orderBy("doc_id").collect()
    assert [bytes(r.decoded) for r in got] == [b"", b"it's  ok", b"it's  ok", b""]
    assert got[1].ids == reference().encode_ordinary("it's  ok") and got[1].offsets == [0, 2, 4, 5]
    rows = {(r.doc_id, r.n_tokens): r for r in B.digests(df, PATH).collect()}
    ids = reference().encode_ordinary("it's  ok")
    assert rows[1, len(ids)].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
    assert rows[2, 0].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert B.digests(df.limit(0), PATH).count() == 0
