"""Missing-value rules and small parsers as column expressions (ANSI-safe: try_cast only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rejoinder.constants import OUTPUT_SEPARATOR


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _s(c) -> Column:
    return _c(c).cast("string")


def ordinal(c) -> Column:
    """null, 'n/a' and 0 mean missing; anything else as DOUBLE (unparsable -> missing)."""
    v = _s(c).try_cast("double")
    v = F.when(_s(c) == "n/a", F.lit(None)).otherwise(v)
    return F.when(v == 0.0, F.lit(None).cast("double")).otherwise(v)


def nominal(c) -> Column:
    """null and 'n/a' mean missing; 0 is a value."""
    return F.when(_s(c) == "n/a", F.lit(None).cast("string")).otherwise(_s(c))


def binary(c) -> Column:
    """Ordinal missing (null, 'n/a', 0) -> '0', else '1'."""
    return F.when(ordinal(c).isNull(), F.lit("0")).otherwise(F.lit("1"))


def sign(c) -> Column:
    """Ordinal missing -> -1.0, else 1.0 (applied / not applied)."""
    return F.when(ordinal(c).isNull(), F.lit(-1.0)).otherwise(F.lit(1.0))


def normalize(c, kind: str) -> Column:
    if kind == "ordinal":
        return ordinal(c)
    if kind == "nominal":
        return nominal(c)
    if kind == "binary":
        return binary(c)
    raise ValueError(f"Unknown column type {kind}")


def empty_to_null(c) -> Column:
    return F.when(_s(c) == "", F.lit(None)).otherwise(_c(c))


def split_compound(c, default: str = "0-0") -> tuple[Column, Column]:
    """'m-r' label -> (message part, response part) as DOUBLE; null label -> default first."""
    parts = F.split(F.coalesce(_s(c), F.lit(default)), "-", -1)
    return (F.get(parts, 0).try_cast("double"), F.get(parts, 1).try_cast("double"))


def parse_tagged(c, tag: str = OUTPUT_SEPARATOR) -> tuple[Column, Column]:
    """(counter speech, rest): text between the first two tags, and part 0 + ' ' + parts 2.. joined by newline.

    No tag -> (text, ''); null -> (null, null).
    """
    quoted = "\\Q" + tag + "\\E"
    p = F.split(_c(c), quoted, -1)
    speech = F.when(F.size(p) == 1, _c(c)).otherwise(F.get(p, 1))
    rest = F.when(F.size(p) == 1, F.lit("")).otherwise(
        F.concat(F.get(p, 0), F.lit(" "), F.array_join(F.slice(p, 3, F.greatest(F.size(p) - 2, F.lit(1))), "\n")))
    return (F.when(_c(c).isNull(), F.lit(None).cast("string")).otherwise(speech),
            F.when(_c(c).isNull(), F.lit(None).cast("string")).otherwise(rest))
