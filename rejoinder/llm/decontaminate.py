r"""Benchmark decontamination by template windows.

Texts become token streams in which numbers, names (capitalised words, not all in
capitals, inside a sentence) and units (after a number) are typed slots.  Every window of ``WINDOW``
tokens is hashed with its slots' types in place of their values, so a question
whose numbers and names were changed keeps its windows.  A window with fewer than
``LITERALS`` ordinary words says too little that way and is hashed with the values.

Windows of documents and benchmark items are joined on the hash.  On each diagonal
(document position minus item position) the matched windows pair up slot values; the
diagonal counts only if every value of the item goes to one value of the document.
An item has leaked if at least ``MIN_SHARE`` of its windows are matched on counting
diagonals.  Items shorter than a window are one window of their own length.

Only DataFrame functions are used.  Documents are keyed by the md5 of their text, so
null or repeated ids do no harm and copies are judged alike.  Benchmark windows are
broadcast only if there are at most ``BROADCAST_WINDOWS`` of them, else the join shuffles.
Null, empty and wordless texts hold no windows and are clean; an empty benchmark leaves
every document clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW, LITERALS, MIN_SHARE = 8, 4, 0.5
BROADCAST_WINDOWS = 1_000_000
SLOT = ""
UNITS = ("mm cm dm m km in ft yd mi mg g kg t lb oz ml cl dl l s ms min h hr hrs mph kmh kw kwh w v a hz khz mhz ghz "
         "kb mb gb tb k c f usd eur gbp percent meters metres miles inches feet pounds hours minutes seconds days "
         "weeks months years euros dollars").split()
_NAME = r"(?<=[\p{L}\p{N},;:] )(\p{Lu}[\p{Ll}\p{M}]+)(?![\p{L}\p{M}])"
_NUMBER = r"(\p{N}+(?:[.,:]\p{N}+)*)"
_UNIT = rf"(?i)(?<=\p{{N}}|\p{{N}} )({'|'.join(sorted(UNITS, key=len, reverse=True))})(?![\p{{L}}\p{{M}}])"
_TOKEN = rf"({SLOT}n[\p{{N}}.,:]*\p{{N}}|{SLOT}?[\p{{L}}\p{{M}}]+)"


def tokens(text: Column) -> Column:
    """Lower-cased words and slots; a slot is ``SLOT``, its type (a name, n number, u unit) and its value."""
    t = F.translate(F.coalesce(text, F.lit("")), SLOT, " ")
    t = F.regexp_replace(F.regexp_replace(t, _NAME, f"{SLOT}a$1"), _NUMBER, f"{SLOT}n$1")
    return F.regexp_extract_all(F.lower(F.regexp_replace(t, _UNIT, f"{SLOT}u$1")), F.lit(_TOKEN), 1)


def windows(df: DataFrame, lengths: list[int]) -> DataFrame:
    """(key, n_windows, pos, hash, slots) of every window of the given lengths of ``df`` (key, text)."""
    is_slot = lambda t: t.startswith(SLOT)
    rows = (df.withColumn("__tok", tokens(F.col("text"))).drop("text")
              .withColumn("__any", F.exists("__tok", is_slot))
              .withColumn("__tpl", F.when(F.col("__any"), F.transform("__tok", lambda t: F.when(is_slot(t), F.substring(t, 1, 2)).otherwise(t)))))

    def at(i: Column, n: int) -> Column:
        own = F.slice("__tok", i + 1, F.lit(n))
        slots = F.filter(own, is_slot)
        by_type = F.xxhash64(F.lit(n), F.slice("__tpl", i + 1, F.lit(n)))
        plain = F.xxhash64(F.lit(n), own)
        return F.struct(i.alias("pos"),
                        F.when(F.col("__any") & (n - F.size(slots) >= min(LITERALS, n)), by_type).otherwise(plain).alias("hash"),
                        F.when(F.col("__any"), F.array_join(slots, " ")).otherwise("").alias("slots"))

    size = F.size("__tok")
    def every(n: int) -> Column:
        return F.when(size >= n, F.transform(F.sequence(F.lit(0), size - n), lambda i: at(i, n)))

    found = [every(n) for n in lengths]
    listed = F.flatten(F.array_compact(F.array(*found))) if len(found) > 1 else found[0]
    return (rows.select("key", size.alias("n_tokens"), F.explode(listed).alias("__v"))
                .select("key", "n_tokens", "__v.pos", "__v.hash", "__v.slots"))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(key, item_id, share) of the items that leaked into the texts with md5 ``key``.

    ``docs`` has a column text; ``benchmark`` has item_id and text.  Equal items count as the smallest id.
    """
    items = (benchmark.select(F.md5("text").alias("key"), "text", "item_id")
                      .groupBy("key", "text").agg(F.min("item_id").alias("item_id")))
    short = [r[0] for r in items.select(F.size(tokens(F.col("text"))).alias("n")).where((F.col("n") > 0) & (F.col("n") < WINDOW))
             .distinct().collect()]                                        # at most WINDOW - 1 lengths
    own = windows(items.select("key", "text"), [WINDOW])
    for n in sorted(short):
        own = own.unionByName(windows(items.select("key", "text"), [n]).where(F.col("n_tokens") == n))
    own = own.join(items.select("key", "item_id"), "key")
    own = own.select(F.col("item_id").alias("item"), F.col("key").alias("item_key"), F.col("pos").alias("item_pos"), "hash",
                     F.col("slots").alias("item_slots"), F.greatest(F.col("n_tokens") - WINDOW + 1, F.lit(1)).alias("of"))
    if own.count() <= BROADCAST_WINDOWS:
        own = F.broadcast(own)
    mine = windows(docs.select(F.md5("text").alias("key"), "text"), [WINDOW, *sorted(short)])
    hits = mine.join(own, "hash").withColumn("diagonal", F.col("pos") - F.col("item_pos"))
    split = lambda c: F.split(c, " ")
    lines = (hits.groupBy("key", "item_key", "item", "of", "diagonal")
                 .agg(F.collect_set("item_pos").alias("at"),
                      F.collect_set(F.when(F.col("item_slots") != "", F.struct("item_slots", "slots"))).alias("pairs"))
                 .withColumn("pairs", F.array_distinct(F.flatten(F.transform("pairs", lambda p: F.arrays_zip(
                     split(p["item_slots"]).alias("i"), split(p["slots"]).alias("d")))))))
    steady = F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda p: p["i"])))
    return (lines.where(steady).groupBy("key", "item_key", "item", "of")
                 .agg((F.size(F.array_distinct(F.flatten(F.collect_list("at")))) / F.col("of")).alias("share"))
                 .where(F.col("share") >= MIN_SHARE).select("key", F.col("item").alias("item_id"), "share"))


def judge(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """One row per document: whether an item leaked into it, which ones (ids of any type), and the largest share.

    An item without an id is found like any other, but has no id to list.
    """
    kind = benchmark.schema["item_id"].dataType.simpleString()
    by_text = leaks(docs, benchmark).groupBy("key").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"),
                                                       F.max("share").alias("share"))
    return (docs.select(id_col, F.md5("text").alias("key")).join(by_text, "key", "left")
                .select(id_col, F.col("share").isNotNull().alias("contaminated"),
                        F.coalesce("item_ids", F.array().cast(f"array<{kind}>")).alias("item_ids"),
                        F.coalesce("share", F.lit(0.0)).alias("share")))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents into which no item leaked, with their own columns."""
    bad = leaks(docs, benchmark).select("key").distinct()
    return docs.join(bad, F.md5(docs["text"]) == bad["key"], "left_anti")
