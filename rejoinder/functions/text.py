"""Text column expressions: tokenisers, n-grams, pattern extraction.

Patterns carry ``(?U)`` so that Java's ``\\w``, ``\\s`` and ``\\b`` follow
Unicode like Python's ``re`` on ``str``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rejoinder.constants import EMOJI_RANGES

WS_SPLIT = r"(?U)\s+"
SIMPLE_TOKEN = r"(?U)\b\w+(?:'\w+)?\b"
WORD_OR_PUNCT = r"(?U)\w+(?:'\w+)?|[^\w\s]"
HASHTAG = r"(?U)#\w+"
URL = r"(?U)https?://\S+"
EMOJI = "[" + "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in EMOJI_RANGES) + "]"
SENTENCE_END = r"(?U)([.!?]+)\s+"
_SENT_MARK = "\u0001"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_ws(c) -> Column:
    """Whitespace runs -> one space, ends stripped (Unicode whitespace, like ``str.split``)."""
    return F.regexp_replace(F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")


def ws_tokens(c) -> Column:
    """Whitespace tokens, like Python's ``str.split()`` (no empty tokens).

    Native expressions only (no lambda), so the projection stays in codegen.
    """
    t = normalize_ws(c)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " ", -1))


def _gram_pattern(n: int) -> str:
    # after normalize_ws tokens are runs of non-space characters separated by single spaces;
    # a zero-width lookahead at every token start captures the n tokens starting there
    if n == 1:
        return r"([^ ]+)"
    return r"(?<![^ ])(?=([^ ]+" + "(?: [^ ]+)" * (n - 1) + "))"


def text_ngrams(c, n: int) -> Column:
    """n-grams (space-joined whitespace tokens) of a text column, by one native regex pass."""
    return F.regexp_extract_all(normalize_ws(c), F.lit(_gram_pattern(n)), F.lit(1))


def ngrams(tokens, n: int, sep: str = " ") -> Column:
    """Array of n-grams (joined by ``sep``) of a token array; empty if too short.

    Built from ``n`` shifted slices zipped together.  Prefer ``text_ngrams`` on
    raw text in hot paths (no per-element lambda).
    """
    t = _c(tokens)
    if n == 1:
        return t
    m = F.greatest(F.size(t) - (n - 1), F.lit(0))
    shifted = [F.slice(t, k + 1, m) for k in range(n)]
    zipped = F.arrays_zip(*shifted)
    fields = [str(k) for k in range(n)]
    return F.transform(zipped, lambda z: F.concat_ws(sep, *[z[f] for f in fields]))


def regex_all(c, pattern: str) -> Column:
    return F.regexp_extract_all(_c(c), F.lit(pattern), F.lit(0))


def simple_tokens(c) -> Column:
    """Word tokens ``\\b\\w+(?:'\\w+)?\\b``."""
    return regex_all(c, SIMPLE_TOKEN)


def word_punct_tokens(c) -> Column:
    """Words plus each punctuation mark as its own token."""
    return regex_all(c, WORD_OR_PUNCT)


def sentences(c) -> Column:
    """Rule-based sentences: split after runs of ``.``, ``!``, ``?`` followed by whitespace.

    Segments without any non-space character are dropped.
    """
    marked = F.regexp_replace(_c(c), SENTENCE_END, "$1" + _SENT_MARK)
    return F.filter(F.split(marked, _SENT_MARK), lambda s: s.rlike(r"(?U)\S"))


def emojis(c) -> Column:
    return regex_all(c, EMOJI)


def hashtags(c) -> Column:
    return regex_all(c, HASHTAG)


def urls(c) -> Column:
    return regex_all(c, URL)


def trim_chars(c, chars: str = ' "') -> Column:
    """Strip a character set from both ends (Python ``str.strip(chars)``)."""
    return F.trim(_c(c), F.lit(chars))


def strip_ws(c) -> Column:
    """Python ``str.strip()`` (Unicode whitespace)."""
    return F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", "")

