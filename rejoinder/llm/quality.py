r"""Quality rules by weak supervision.

Each rule looks at a text's counts and votes +1 (fine), -1 (poor) or 0 (abstains).
Nobody says how good the rules are: expectation-maximisation over the vote patterns
of all documents estimates, for fine and for poor texts, how often each rule votes
which way.  A document's posterior probability of being fine replaces "must pass
every rule".  Votes of m rules have at most 3^m patterns, so one aggregate with a
proven bound (2,187 rows here) carries all that the estimation needs to the driver.

Everything on the data path is DataFrame functions: words and windows are arrays of
the row, nothing is exploded or shuffled but the pattern counts.

A null text has no words.  A document that fails the base rule (fewer than 50 words, or
more than half of the words in repeated 3-word windows) is never kept.  Repeated rows and
other columns pass through; existing columns with an output's name are replaced.  An
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rejoinder.llm.common import cut, settled

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"
#: Very frequent words of the four languages; their share is one rule's measure.
FUNCTION_WORDS = ("the of and to in is that it for with on as are was by or "
                  "de la le les et des en un une du que qui dans est pour par sur pas "
                  "el los las y del se por con no "
                  "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als").split()
RULES = ("symbols", "lines", "repeats", "capitals", "stops", "function_words", "word_length")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: A document is kept from this posterior on.
KEEP_FROM = 0.5
ROUNDS, SMOOTH = 100, 1.0


def _blank_free(c: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(c, F.lit(r"([^\x20\x09-\x0D]+)"), 1), F.array().cast("array<string>"))


def features(df: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``df`` with the base counts and the measures of the rules (``__``-named), row by row."""
    n = F.col("n_words")
    lines = F.filter(F.split("__t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    own = (df.withColumn("__t", F.coalesce(F.col(text_col), F.lit("")))
             .withColumn("__w", _blank_free(F.col("__t"))).withColumn("__l", lines)
             .withColumn("n_words", F.size("__w").cast("long"))
             .withColumn("__h", F.when(n >= 3, F.transform(
                 F.sequence(F.lit(0), (n - 3).cast("int")),
                 lambda i: F.xxhash64(F.get("__w", i), F.get("__w", i + 1), F.get("__w", i + 2)))))
             # windows in order of their hash, only where one occurs twice
             .withColumn("__s", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), F.sort_array(F.transform(
                 "__h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))))
    twice = F.transform("__s", lambda x, i: F.when(
        (F.get("__s", i - 1)["h"] == x["h"]) | (F.get("__s", i + 1)["h"] == x["h"]), x["i"]))
    own = own.withColumn("__p", F.sort_array(F.filter(twice, lambda i: i.isNotNull())))
    # a window at p covers the words up to the next window's start, three at most
    covered = F.aggregate(F.zip_with("__p", F.slice("__p", 2, F.greatest(F.size("__p"), F.lit(1))), lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3))),
                          F.lit(0).cast("long"), lambda s, x: s + x)
    return own.withColumns({
        "word_chars": F.length(F.array_join("__w", "")).cast("long"),
        "n_symbols": (F.length("__t") - F.length(F.translate("__t", SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        "__lines": F.size("__l"),
        "__stops": F.length("__t") - F.length(F.translate("__t", ".?", "")),
        "__upper": F.length("__t") - F.length(F.regexp_replace("__t", r"\p{Lu}", "")),
        "__function": F.size(F.filter("__w", lambda w: F.lower(w).isin(FUNCTION_WORDS))),
    }).drop("__t", "__w", "__l", "__h", "__s", "__p")


def votes(df: DataFrame) -> DataFrame:
    """``df`` with ``v_<rule>`` in -1, 0, 1; all abstain where there are no words."""
    n, chars = F.col("n_words"), F.col("word_chars")

    def vote(measure: Column, poor: Column, fine: Column) -> Column:
        return F.when((n > 0) & poor, -1).when((n > 0) & fine & measure.isNotNull(), 1).otherwise(0)

    sym, upper = F.try_divide("n_symbols", chars), F.try_divide("__upper", chars)
    dup, rep, stops, fun, length = (F.try_divide(a, b) for a, b in (
        (F.col("n_dup_lines"), F.col("__lines")), (F.col("n_repeat_words"), n), (F.col("__stops"), n),
        (F.col("__function"), n), (chars, n)))
    return df.withColumns({
        "v_symbols": vote(sym, sym > 0.05, sym < 0.01),
        "v_lines": vote(dup, dup > 0.3, dup < 0.1),
        "v_repeats": vote(rep, rep > 0.25, rep < 0.1),
        "v_capitals": vote(upper, upper > 0.25, upper < 0.1),
        "v_stops": vote(stops, (stops < 0.01) | (stops > 0.5), stops.between(0.03, 0.3)),
        "v_function_words": vote(fun, fun < 0.05, fun > 0.15),
        "v_word_length": vote(length, (length < 2) | (length > 11), length.between(3, 9)),
    })


@dataclass(frozen=True)
class Model:
    """Share of fine documents, and P(vote | fine), P(vote | poor) by rule and vote -1, 0, 1."""

    fine: float
    given_fine: dict[str, tuple[float, float, float]]
    given_poor: dict[str, tuple[float, float, float]]

    def log_odds(self) -> Column:
        total = F.lit(math.log(self.fine / (1 - self.fine)))
        for rule in RULES:
            odds = [math.log(a / b) for a, b in zip(self.given_fine[rule], self.given_poor[rule], strict=True)]
            v = F.col(f"v_{rule}")
            total = total + F.when(v < 0, odds[0]).when(v > 0, odds[2]).otherwise(odds[1])
        return total


def estimate(patterns: Iterable[tuple[tuple[int, ...], int]]) -> Model:
    """Expectation-maximisation from (votes, documents) counts.

    Starts from "most votes are right" and treats rules as independent given the
    class; one pseudo-document per vote keeps every probability off 0 and 1.
    """
    rows = [(p, n) for p, n in patterns]
    # start: each vote against, beyond one vote in favour for three, counts towards poor
    weight = [1 / (1 + math.exp(2.0 * (2 * sum(v < 0 for v in p) - 0.7 * sum(v > 0 for v in p)))) for p, _ in rows]
    model = Model(0.5, {}, {})
    for _ in range(ROUNDS):
        total = sum(n for _, n in rows)
        fine_n = sum(w * n for w, (_, n) in zip(weight, rows, strict=True))
        tables: list[dict] = [{}, {}]
        for j, rule in enumerate(RULES):
            for table, side in zip(tables, (weight, [1 - w for w in weight]), strict=True):
                seen = [SMOOTH] * 3
                for w, (p, n) in zip(side, rows, strict=True):
                    seen[p[j] + 1] += w * n
                table[rule] = tuple(s / sum(seen) for s in seen)
        model = Model((fine_n + SMOOTH) / (total + 2 * SMOOTH), *tables)
        before, weight = weight, []
        for p, _ in rows:
            odds = math.log(model.fine / (1 - model.fine)) + sum(
                math.log(model.given_fine[r][v + 1] / model.given_poor[r][v + 1]) for r, v in zip(RULES, p, strict=True))
            weight.append(1 / (1 + math.exp(-max(-700.0, min(700.0, odds)))))
        if max((abs(a - b) for a, b in zip(before, weight, strict=True)), default=0) < 1e-9:
            break
    return model


def fit(voted: DataFrame) -> Model:
    """The model of all documents that pass the base rule."""
    names = [f"v_{r}" for r in RULES]
    counted = settled(voted, ~base_failed()).groupBy(*names).count().collect()      # at most 3^7 rows
    return estimate(sorted((tuple(r[c] for c in names), r["count"]) for r in counted))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def judge(voted: DataFrame, model: Model) -> DataFrame:
    """``voted`` with base_failed, p_fine and kept; the rules' own columns are dropped."""
    out = (voted.withColumn("base_failed", base_failed()).withColumn("p_fine", 1 / (1 + F.exp(-model.log_odds())))
                .withColumn("kept", ~F.col("base_failed") & (F.col("p_fine") >= KEEP_FROM)))
    return out.drop(*[c for c in out.columns if c.startswith("__") or c.startswith("v_") and c[2:] in RULES])


def keep_fine(df: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that are kept, with its own columns."""
    row = F.struct(*[F.col(c) for c in df.columns]).alias("__row")
    voted = votes(features(df.select(row, F.col(text_col).alias("__text")), text_col="__text"))
    # counting is the costly part, so rows are written with their counts and votes, and read for the estimate and the verdicts
    voted = cut(voted.select("__row", "n_words", "n_repeat_words", *[f"v_{r}" for r in RULES]), "quality-rows")
    good = 1 / (1 + F.exp(-fit(voted).log_odds())) >= KEEP_FROM
    return settled(voted, ~base_failed() & good).select("__row.*")
