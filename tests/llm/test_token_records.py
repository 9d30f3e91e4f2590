import random
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from rejoinder.llm import token_records as R
from rejoinder.llm.common import shared_folder

PATH = P.path("byte_bpe_50k.json")


def crc32c(data):
    c = 0xFFFFFFFF
    for b in data:
        c ^= b
        for _ in range(8):
            c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def masked(data):
    c = crc32c(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def test_checksum_known_value_and_brute_force():
    assert crc32c(b"123456789") == 0xE3069283
    rnd = random.Random(3)
    parts = [rnd.randbytes(n) for n in (4, 8, 31, 32, 33, 64, 100, 1000, 5, 8)]
    lengths = np.array([len(p) for p in parts])
    got = R.masked_crc32c(np.frombuffer(b"".join(parts), np.uint8), np.cumsum(lengths) - lengths, lengths)
    assert got.tolist() == [masked(p) for p in parts]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)                        # on defaults: special tokens become their ids


def test_cut_at_spaces_is_exact(library):
    rnd = random.Random(5)
    texts = ["", " ", "  ", "a  b", "a   b", "a \n b", "a \n  b", "a\n ", "x\n  b", "it's <|endoftext|> 'll", "<|endoftext|>", "x<|endoftext|> <|endoftext|>y", "a  <|endoftext|>  b", "<|endoftext",  "\t \t", " a ", "a  "]
    texts += ["".join(rnd.choice("ab ., !?'\n1ñ;:.") for _ in range(rnd.randint(0, 30))) for _ in range(3000)]
    texts += ["x a.", "x a.. b!? é, 1. ʰ. ª! a'. '. . , a", "x 漢. ǅ, ß: e\u0301."]
    texts += ["".join(rnd.choice("a b '\ns\t é  ") for _ in range(rnd.randint(0, 40))) for _ in range(2000)]
    enc = R.WordEncoder(open(PATH).read())
    for text, got in zip(texts, enc.encode(texts), strict=True):
        assert np.frombuffer(got, "<u2").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_special_tokens_as_text_on_request(library):
    enc = R.WordEncoder(open(PATH).read(), special_as_text=True)
    library.encode_special_tokens = True
    try:
        for text in ("a <|endoftext|> b", "<|endoftext|>"):
            assert np.frombuffer(next(enc.encode([text])), "<u2").tolist() == library.encode(text, add_special_tokens=False).ids
    finally:
        library.encode_special_tokens = False
    assert np.frombuffer(next(R.WordEncoder(open(PATH).read()).encode(["a <|endoftext|> b"])), "<u2").tolist() == [64, 220, 50256, 275]


def test_round_trip(spark, library, monkeypatch):
    monkeypatch.setattr(R, "SHARD_BYTES", 2000)
    rows = [(i * 3, f"word{i} two  three\n" * (i % 7)) for i in range(300)] + [(1, None), (2, ""), (4, "x" * 30000), (None, "n"), (5, "b <|endoftext|> c")]
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, shard string, start int").repartition(5)
    folder = shared_folder(spark, "t")
    manifest = R.write(df, PATH, folder)
    assert len(manifest) > 3
    got = {r.doc_id: r for r in R.read_digests(spark, folder, manifest).collect()}
    start = 0
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        r = got[key]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))), key
        start += len(ids)
    shuffled = R.read_shuffled(spark, folder, manifest, 7).collect()
    assert sorted(len(r.ids) for r in shuffled) == sorted(r.n_tokens for r in got.values())
    assert [r.doc_id for r in shuffled] != sorted((r.doc_id for r in shuffled), key=lambda k: k or 0)


def test_empty_table_and_damage(spark):
    folder = shared_folder(spark, "t")
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert R.read_digests(spark, folder, R.write(empty, PATH, folder)).count() == 0
    frame = bytearray(R.frames([b"payload-of-it"])[0])
    frame[15] ^= 1
    import pyarrow as pa
    with pytest.raises(ValueError):
        list(R.scan(pa.BufferReader(bytes(frame))))


def test_equal_ids_and_outlying_ids_have_a_defined_order(spark, library, monkeypatch):
    import xxhash

    def order(row):
        return row[0], struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(row[1].encode(), seed=42)))[0]

    monkeypatch.setattr(R, "SHARD_BYTES", 3000)
    rows = [(i, f"text {i} " * 20) for i in range(200)] + [(2**62, "far"), (-2**62, "low"), (5, "b"), (5, "a"), (5, "c c"), (5, "a")]
    answers = []
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        folder = shared_folder(spark, "t")
        manifest = R.write(df, PATH, folder)
        assert len(manifest) > 5 and max(m["records"] for m in manifest) < 60
        answers.append(sorted(tuple(r) for r in R.read_digests(spark, folder, manifest).collect()))
    start, want = 0, []
    for key, text in sorted(rows, key=order):
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        want.append((key, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert answers == [sorted(want)] * 2
