"""Toxicity by a weighted lexicon.

Folding: lower case, look-alike letters of other scripts and digits or signs that stand
for letters are mapped to the letters.  An Aho-Corasick automaton finds the lexicon's
words in the folded text as whole words; a match inside an exception phrase does not
count.  The weights found, alone and by length, go through a logistic curve.

Everything is learned from labelled rows: at most ``FIT_ROWS`` of them, those first by
the hash of their id.  A word's weight is its log-odds between toxic and other texts,
counted in distinct contexts (the words on both sides), so that copies of one passage count
once.  Exception phrases are lexicon words with a neighbour that stand in texts not
labelled toxic; callers may add their own.

Only the text is an input of a score.  Null, empty and wordless texts score as texts
without a match.  Repeated rows are scored alike; without labelled rows of both kinds every
score is the labels' smoothed mean.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from dataclasses import asdict, dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rejoinder.llm.common import cut, worker_state

#: Labelled documents used at most; this bounds the lexicon and its exceptions as well, which hold words of theirs.
FIT_ROWS = 8000
#: A lexicon word: contexts and documents in toxic texts, log-odds, and its standard errors, at least.
MIN_CONTEXTS, MIN_DOCS, MIN_LOG_ODDS, MIN_Z = 10, 5, 2.0, 6.0
#: An exception phrase: documents, and share of them labelled toxic at most.
PHRASE_DOCS, PHRASE_TOXIC = 5, 0.2
CUT = 0.3
# Look-alikes, as pairs "from to" (fixed values).
LOOK_ALIKES = ("аa вb еe кk мm нh оo рp сc тt уy хx іi јj ѕs ԁd ԛq ԝw αa βb εe ιi κk νv οo ρp τt υu χx ωw "
               "áa àa âa äa ãa åa ée èe êe ëe íi ìi îi ïi óo òo ôo öo õo úu ùu ûu üu ñn çc ýy ÿy øo "
               "0o 1i 3e 4a 5s 7t 8b @a $s !i |i")
FOLD = str.maketrans({p[0]: p[1] for p in LOOK_ALIKES.split()})


def fold(text: str) -> str:
    """The text in lower case with look-alikes mapped to plain letters."""
    return text.lower().translate(FOLD)


@dataclass(frozen=True)
class Model:
    words: dict[str, float]
    phrases: tuple[str, ...]
    bias: float
    slopes: tuple[float, float]


class Matcher:
    """Sums of lexicon weights in texts."""

    def __init__(self, words: dict[str, float], phrases: Iterable[str]):
        self.automaton = ahocorasick.Automaton()
        for w, weight in words.items():
            self.automaton.add_word(w, (len(w), weight))
        for p in phrases:
            self.automaton.add_word(p, (len(p), None))
        self.any = bool(len(self.automaton))
        self.automaton.make_automaton()

    def features(self, text: str) -> tuple[float, float]:
        """(log of the weights' sum, weights per 100 words), both 0 without a match."""
        if not self.any:
            return 0.0, 0.0
        lowered = text.lower()                           # folding keeps places, so signs at a word's edge stay edges
        folded = lowered.translate(FOLD)
        hits, free = [], []
        for end, (length, weight) in self.automaton.iter(folded):
            start = end + 1 - length
            if (start and lowered[start - 1].isalnum()) or (end + 1 < len(lowered) and lowered[end + 1].isalnum()):
                continue
            (free if weight is None else hits).append((start, end, weight))
        total = sum(w for s, e, w in hits if not any(a <= s and e <= b for a, b, _ in free))
        return float(np.log1p(total)), total / max(1, len(text.split())) * 100

    @staticmethod
    def of(model: Model) -> Matcher:
        key = hashlib.sha1(json.dumps(asdict(model), sort_keys=True).encode()).hexdigest()
        return worker_state("toxicity_" + key, lambda: Matcher(model.words, model.phrases))


def _features(model: Model, text: Column) -> Column:
    @F.arrow_udf(T.StructType([T.StructField("sum", T.DoubleType()), T.StructField("rate", T.DoubleType())]))
    def run(text: pa.Array) -> pa.Array:
        matcher = Matcher.of(model)
        got = [matcher.features(t or "") for t in text.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([g[k] for g in got], pa.float64()) for k in (0, 1)], ["sum", "rate"])

    return run(text)


@F.arrow_udf(T.StringType())
def _folded(text: pa.Array) -> pa.Array:
    return pa.array([fold(t or "") for t in text.to_pylist()], pa.string())


def sample(docs: DataFrame, labels: DataFrame, allowed: Column) -> DataFrame:
    """(text, toxic) of at most FIT_ROWS labelled documents, the first by the hash of their id."""
    ids = (labels.where(allowed & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
                 .orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS))
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "text", "toxic")


def fit(labelled: DataFrame, *, phrases: Iterable[str] = ()) -> Model:
    """The model of (doc_id, text, toxic) rows; what reaches the driver is bounded by ``FIT_ROWS``."""
    letters = F.regexp_extract_all(_folded("text"), F.lit(r"([\p{L}\p{M}']+)"), 1)
    labelled = cut(labelled.select("doc_id", "text", "toxic"), "toxicity-sample")
    words = (labelled.select("doc_id", "toxic", letters.alias("w"))
             .select("doc_id", "toxic", F.explode(F.transform("w", lambda x, i: F.struct(
                 x.alias("word"), F.coalesce(F.get("w", i - 1), F.lit("")).alias("left"),
                 F.coalesce(F.get("w", i + 1), F.lit("")).alias("right")))).alias("c"))
             .select("doc_id", "toxic", "c.*"))
    context = (words.groupBy("word", F.xxhash64("left", "right").alias("c"))
                    .agg(F.avg("toxic").alias("toxic"), F.min("doc_id").alias("doc")))
    seen = cut(context.groupBy("word").agg(F.sum(F.col("toxic")).alias("a"), F.sum(1 - F.col("toxic")).alias("b"),
                                           F.approx_count_distinct(F.when(F.col("toxic") > 0.5, F.col("doc"))).alias("docs")),
               "toxicity-words")
    total = seen.agg(F.sum("a"), F.sum("b")).first()
    toxic, other = total[0] or 0.0, total[1] or 0.0
    odds = F.log((F.col("a") + 0.5) / (toxic + 1)) - F.log((F.col("b") + 0.5) / (other + 1))
    error = F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    picked = (seen.withColumn("odds", odds).where((F.col("a") >= MIN_CONTEXTS) & (F.col("docs") >= MIN_DOCS)
                                                  & (F.col("odds") >= MIN_LOG_ODDS) & (F.col("odds") >= MIN_Z / 3 * error))
                  .orderBy(F.desc("odds"), "word").collect())
    lexicon = {r["word"]: float(r["odds"]) for r in picked}
    own: list[str] = [fold(p) for p in phrases]
    if lexicon:
        near = words.where(F.col("word").isin(list(lexicon)))
        pairs = (near.where("left != ''").select("doc_id", "toxic", F.concat_ws(" ", "left", "word").alias("p"))
                     .union(near.where("right != ''").select("doc_id", "toxic", F.concat_ws(" ", "word", "right"))))
        own += [r["p"] for r in pairs.distinct().groupBy("p").agg(F.count("*").alias("n"), F.avg("toxic").alias("t"))
                .where((F.col("n") >= PHRASE_DOCS) & (F.col("t") <= PHRASE_TOXIC))
                .collect()]
    bare = Model(lexicon, tuple(sorted(set(own))), 0.0, (0.0, 0.0))
    rows = labelled.select("toxic", _features(bare, F.col("text")).alias("f")).select("toxic", "f.*").collect()   # FIT_ROWS at most
    bias, slopes = logistic(np.array([[r["sum"], r["rate"]] for r in rows], float).reshape(-1, 2),
                            np.array([r["toxic"] for r in rows], float))
    return Model(bare.words, bare.phrases, bias, slopes)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, tuple[float, float]]:
    """Bias and two slopes by Newton's method, slopes held at 0 or above; a smoothed mean if one label is missing."""
    mean = (y.sum() + 0.5) / (len(y) + 1)
    if len(np.unique(y)) < 2:
        return float(np.log(mean / (1 - mean))), (0.0, 0.0)
    used = [0, 1]
    while True:
        z = np.column_stack([np.ones(len(y)), x[:, used]])
        w = np.zeros(z.shape[1])
        w[0] = np.log(mean / (1 - mean))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            keep = np.diag([0.0] + [ridge * len(y) ** 0.5] * len(used))
            step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + keep + 1e-9 * np.eye(len(w)), z.T @ (y - p) - keep @ w)
            w += np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-8:
                break
        bad = [u for u, s in zip(used, w[1:], strict=True) if s < 0]
        if not bad:
            slopes = dict(zip(used, w[1:].tolist(), strict=True))
            return float(w[0]), (slopes.get(0, 0.0), slopes.get(1, 0.0))
        used = [u for u in used if u not in bad]


def score(docs: DataFrame, model: Model, *, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with a score between 0 and 1."""
    logit = F.lit(model.bias) + model.slopes[0] * F.col("__f.sum") + model.slopes[1] * F.col("__f.rate")
    return docs.withColumn("__f", _features(model, F.col(text_col))).withColumn(out_col, 1 / (1 + F.exp(-logit))).drop("__f")


def held_out(doc_id: Column) -> Column:
    """The rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2, F.lit(False))
