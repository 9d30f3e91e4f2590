"""Token counts of a unigram tokenizer without building tokens.

An Aho-Corasick automaton lists every vocabulary piece that ends at each character
of a word; dynamic programming carries the best score and, beside it, the number of
pieces on the best path.  Ties follow the tokenizers library exactly: scores add up
in double precision from the left, and of equal candidates for an end the one that
starts first (the longest piece) stays.  A character without a piece of its own
scores the lowest score less 10; with byte fallback it counts as its UTF-8 bytes,
otherwise a run of such characters counts as one.

Spaces become the word mark and a text gets one in front, so every mark starts a
word, and words are independent: their counts are cached per worker in a bounded table.
Null and empty texts have no tokens.  Texts are counted whole; other columns pass through,
an existing column with an output's name is replaced.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rejoinder.llm.common import worker_state

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Entries of a worker's cache of words, and the longest word kept in it.
CACHE_WORDS, CACHE_LEN = 600_000, 64


class Counts(dict):
    """Word (without its mark) -> (pieces, score)."""

    def __init__(self, count):
        super().__init__()
        self.count = count

    def __missing__(self, word: str) -> tuple[int, float]:
        got = self.count(MARK + word)
        if len(word) <= CACHE_LEN:
            self[word] = got
        return got


class Counter:
    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        self.bytes = byte_fallback
        self.cache = Counts(self.word)

    def word(self, word: str) -> tuple[int, float]:
        """(pieces, score) of the best path through one word."""
        n = len(word)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        unknown = [False] * (n + 1)                     # the best path's last character has no piece
        found = self.automaton.iter(word)
        at, match = next(found, (n, None))
        for end in range(1, n + 1):
            top, pieces, single, last = None, 0, False, False
            while at == end - 1:                        # the longest piece comes first
                length, score = match
                candidate = best[end - length] + score
                if top is None or candidate > top:
                    top, pieces = candidate, count[end - length] + 1
                single |= length == 1
                at, match = next(found, (n, None))
            if not single:
                candidate = best[end - 1] + self.unknown
                if top is None or candidate > top:
                    top, last = candidate, True
                    more = len(word[end - 1].encode()) if self.bytes else not unknown[end - 1]
                    pieces = count[end - 1] + more
            best[end], count[end], unknown[end] = top, pieces, last
        return count[n], best[n]

    def text(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        marked = text.replace(" ", MARK)
        words = (marked if marked[0] == MARK else MARK + marked).split(MARK)[1:]
        counts, scores = zip(*map(self.cache.__getitem__, words), strict=True)
        return sum(counts), sum(scores)


def vocabulary(model: bytes) -> tuple[list[tuple[str, float]], bool]:
    """(piece, score) pairs of a sentencepiece model, without control pieces; whether bytes stand in."""
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    ids = [i for i in range(sp.get_piece_size()) if not sp.is_control(i)]
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in ids], any(sp.is_byte(i) for i in ids)


def count(df: DataFrame, model_path: str, *, text_col: str = "text", out_col: str = "n_tokens",
          score_col: str = "best_score") -> DataFrame:
    """``df`` with the token count of each text and its best path's score."""
    with open(model_path, "rb") as f:
        model = f.read()
    name = "unigram_" + hashlib.sha1(model).hexdigest()

    @F.arrow_udf(T.StructType([T.StructField("n", T.LongType()), T.StructField("s", T.DoubleType())]))
    def run(text: pa.Array) -> pa.Array:
        counter = worker_state(name, lambda: Counter(*vocabulary(model)))
        got = [counter.text(t or "") for t in text.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.float64())],
                                          ["n", "s"])

    return (df.withColumn("__c", run(F.col(text_col)))
              .withColumns({out_col: F.col("__c.n"), score_col: F.col("__c.s")}).drop("__c"))
