import random

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from rejoinder.llm import unigram_count as U

PATH = P.path("piece_bpe_32k.model")


def library(vocabulary, byte_fallback):
    t = Tokenizer(models.Unigram(vocabulary, next(i for i, v in enumerate(vocabulary) if v[0] == "<unk>"), byte_fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=True)
    return t


@pytest.fixture(scope="module")
def model():
    return U.vocabulary(open(PATH, "rb").read())


def texts():
    rnd = random.Random(8)
    hard = ["", " ", "  a", "a  ", "▁", "▁▁a", "hello world", "漢字 😀😀 é", "\n\n x\t", "<0x0A>", "<unk>", "x" * 3000,
            "\x00\x01", "ǅ𐍈", "a▁b", "      many     spaces"]
    return hard + ["".join(rnd.choice("abcde ABthe ing  \n漢😀é<>0x1") for _ in range(rnd.randint(0, 80))) for _ in range(3000)]


def test_equal_to_library(model):
    counter, ref = U.Counter(*model), library(*model)
    for t in texts():
        assert counter.text(t)[0] == len(ref.encode(t, add_special_tokens=False).ids), repr(t)


@pytest.mark.parametrize("fallback", [False, True])
def test_ties_go_as_in_the_library(fallback):
    rnd = random.Random(9)
    for _ in range(30):
        pieces = {"".join(rnd.choice("ab▁") for _ in range(rnd.randint(1, 4))) for _ in range(12)}
        vocab = [("<unk>", 0.0)] + [(p, -float(rnd.randint(1, 3))) for p in sorted(pieces)]
        vocab += [(f"<0x{b:02X}>", 0.0) for b in range(256)] if fallback else []
        counter, ref = U.Counter(vocab, fallback), library(vocab, fallback)
        for _ in range(60):
            t = "".join(rnd.choice("aabbc ") for _ in range(rnd.randint(0, 20)))
            assert counter.text(t)[0] == len(ref.encode(t, add_special_tokens=False).ids), (vocab[:14], t)


def test_spark_nulls_repeats_and_clashing_names(spark, model):
    df = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "y"), (None, None, None)], "doc_id long, text string, n_tokens string")
    got = U.count(df, PATH).orderBy("doc_id").collect()
    assert [r.n_tokens for r in got] == [0, 2, 2] and U.count(df.limit(0), PATH).count() == 0
