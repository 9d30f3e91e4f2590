r"""Removal of repeated 100-byte strings over the whole collection.

Every byte covered by a ``LENGTH``-byte string (a window) that also starts earlier, in a
document of smaller id or further left in the same one, goes.  Windows never cross documents.

1. Equal texts: only the first is looked into; the others go as a whole (if they hold a window).
2. Dealing.  A window's key is the least hash of its ``GRAM``-byte strings, so equal windows have
   equal keys, and neighbouring windows mostly share one: a run of windows with one key is a segment,
   about one for 35 bytes.  Only (key, hash of the segment, place) is shuffled.
3. Of equal segments all but the first repeat it: those of one task are told before the shuffle, so a passage that
   very many documents share sends a row a task, not a row a document.  The rest is read in order of key and content, a
   row at a time.  A key with one content that holds the key's string at
   one place only is settled by that (equal windows hold it at the same offset, so windows of one segment
   can be equal only if it holds it twice); else the first segment of each content goes on, with its bytes.
4. Suffix sorting.  Tasks build the Burrows-Wheeler transform of their segments column by column:
   round t puts the suffixes of length t of all segments in order, by the symbol before each suffix
   of the round before (a stable sort of the transform).  Common prefixes of neighbours are then
   extended column by column up to ``LENGTH``; neighbours that reach it are one string, and all its
   places but the first repeat it.  Segments are cut so that a round count stays small.  A key with more than
   ``BLOCK`` bytes is dealt to several tasks; their strings' first places meet by fingerprint.
5. The spans of a document are united, and its bytes removed.

The rounds run in memory over blocks of bounded size, not over files on disk: tasks keep nothing on
their machines, and a lost one is run again from the shuffled segments.

Null texts are empty.  Rows without an id come before all others; different texts with one id
are documents in the order of a hash of their text; rows repeated exactly are one document.  Other columns
pass through ``deduplicate``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from rejoinder.llm.common import cut, shuffle_partitions

LENGTH, GRAM = 100, 32
#: Windows of a piece that is sorted; bytes sorted together; bytes of one key in one task.
PIECE, BATCH, BLOCK = 64, 1 << 18, 1 << 20
#: A list of ids is broadcast up to this many rows; a larger one is joined by shuffling.
BROADCAST_ROWS = 1_000_000
FIRST_ID = -(1 << 63)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _widest(h: np.ndarray, width: int, of: np.ufunc) -> np.ndarray:
    """``of`` (minimum or maximum) over every ``width`` neighbours."""
    span = 1
    while 2 * span <= width:                            # over 2, 4, 8 ... neighbours
        h = of(h[:-span], h[span:])
        span *= 2
    return of(h[:span - width], h[width - span:]) if span < width else h


def segments(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, first window, last window, whether the key's string stands in it twice) of the runs of windows with one key, in order."""
    n = len(data)
    if n < LENGTH:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none.astype(bool)
    eight = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), 8)
    eight = np.ascontiguousarray(eight).view("<u8")[:, 0]
    grams = n - GRAM + 1
    h = np.zeros(grams, np.uint64)
    for k in range(0, GRAM, 8):
        h = _mix(h + eight[k:k + grams])
    width = LENGTH - GRAM + 1
    key = _widest(h, width, np.minimum)
    first = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
    # a string that is the least of some window equals the greatest key of the windows that hold it; those of one run follow each other
    least = h[h == _widest(np.pad(key, width - 1), width, np.maximum)]
    held = np.diff(np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1, [len(least)]]))
    return key[first], first, np.concatenate([first[1:] - 1, [n - LENGTH]]), held > 1


def suffix_order(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, places in order) of all suffixes of a collection; symbol 0 ends a text, others are bytes + 1.

    ``places`` are the sorted suffixes of lengths up to the round's number.  The
    symbols before them are the transform; sorting it stably and stepping one symbol
    left gives the suffixes that are one longer, and each text gains one.
    """
    symbols = np.frombuffer(b"\xff" + b"\xff".join(texts) + b"\xff", np.uint8) + np.uint8(1)   # UTF-8 has no byte FF
    last = (np.cumsum([len(t) + 1 for t in texts]) - 1).astype(np.int32)
    before = last                                       # the symbol before each suffix, in the suffixes' order
    for _ in range(max(map(len, texts), default=0)):
        transform = symbols[before]
        ended = len(transform) - np.count_nonzero(transform)
        order = np.argsort(transform, kind="stable")[ended:]
        before = np.concatenate([last, before[order] - 1])
    return symbols, before + 1


def repeats(texts: list[bytes], places_of: list[tuple]) -> tuple[list[np.ndarray], list[tuple[bytes, int, int]]]:
    """Windows of each text that repeat an earlier one, and (window, text, offset) of each string's first place.

    ``places_of`` orders the texts' first bytes in the collection: (document ..., offset).
    """
    symbols, order = suffix_order(texts)
    begin = np.cumsum([1] + [len(t) + 1 for t in texts[:-1]])
    whose = np.searchsorted(begin, order, side="right") - 1
    offset = order - begin[whose]
    held = np.array([len(t) for t in texts])[whose] - offset >= LENGTH
    order, whose, offset = order[held], whose[held], offset[held]
    if not len(order):
        return [np.zeros(0, np.int64) for _ in texts], []
    same = np.ones(len(order) - 1, bool)
    for column in range(LENGTH):                        # common prefixes of neighbours, column by column
        same &= symbols[order[1:] + column] == symbols[order[:-1] + column]
    string = np.concatenate([[0], np.cumsum(~same)])
    columns = np.array(places_of, np.int64).reshape(len(texts), -1)
    at = columns[whose, -1] + offset
    sort = np.lexsort((at, *(columns[whose, k] for k in range(columns.shape[1] - 2, -1, -1)), string))
    first = np.concatenate([[True], string[sort][1:] != string[sort][:-1]])
    again, fresh = sort[~first], sort[first]
    return _by_text(whose[again], offset[again], len(texts)), [(texts[w][o:o + LENGTH], w, o) for w, o in zip(whose[fresh].tolist(), offset[fresh].tolist(), strict=True)]


def _by_text(whose: np.ndarray, offset: np.ndarray, n: int) -> list[np.ndarray]:
    sort = np.lexsort((offset, whose))
    return np.split(offset[sort], np.searchsorted(whose[sort], np.arange(1, n)))


def _runs(starts: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of the runs of consecutive numbers."""
    if not len(starts):
        return []
    breaks = np.flatnonzero(np.diff(starts) != 1)
    return list(zip(starts[np.concatenate([[0], breaks + 1])].tolist(),
                    starts[np.concatenate([breaks, [len(starts) - 1]])].tolist(), strict=True))


# --- Spark ---------------------------------------------------------------------

def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    other = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    return docs.join(other, ["d", "t"], "left_anti")


#: A segment's first window, the number of windows less one, and two marks, in one number.
PLACE, TWICE, AGAIN = 32, 1, 2
SEGMENT = "m long, g long, d long, t long, place long"


def _segments(docs: DataFrame) -> DataFrame:
    """The segments of all documents; of equal ones (m, g) of one batch all but the first are marked as again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for d, t, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = text.encode()
                m, a, b, twice = segments(data)
                g = np.fromiter((xxhash.xxh3_64_intdigest(data[x:y + LENGTH]) for x, y in zip(a.tolist(), b.tolist(), strict=True)),
                                np.uint64, len(m))
                out.append((m.view(np.int64), g.view(np.int64), np.full(len(m), d), np.full(len(m), t),
                            (a.astype(np.int64) << PLACE) + ((b - a) << 2) + twice * TWICE))
                held += len(m)
                if held > 1_000_000:
                    yield pack(out)
                    out, held = [], 0
            if held:
                yield pack(out)

    def pack(out):
        m, g, d, t, place = (np.concatenate(c) for c in zip(*out, strict=True))
        order = np.lexsort((place, t, d, g, m))
        same = (m[order][1:] == m[order][:-1]) & (g[order][1:] == g[order][:-1])
        place[order[1:][same]] += AGAIN
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (m, g, d, t, place)], names=["m", "g", "d", "t", "place"])

    return docs.select("d", "t", "text").mapInArrow(run, SEGMENT)


TOLD = "m long, d long, t long, s1 int, s2 int, again boolean"


def _told(found: DataFrame) -> DataFrame:
    """Segments that repeat an equal one (again), and the first ones of each content of keys that are not settled.

    Rows come by key, content and place; only the one before, and the first of a key that has shown one content, are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m0 = g0 = None                                  # of the row before
        waiting = None                                  # the first of the key at hand, while it has one content
        for batch in batches:
            if not batch.num_rows:
                continue
            m, g, d, t, place = (batch.column(c).to_numpy() for c in range(5))
            known = (place & AGAIN) > 0
            if known.any():                             # they come last
                yield rows(*(c[known] for c in (m, d, t, place)), np.ones(np.count_nonzero(known), bool), None)
                m, g, d, t, place = (c[~known] for c in (m, g, d, t, place))
                if not len(m):
                    continue
            key = np.concatenate([[m0 is None or m[0] != m0], m[1:] != m[:-1]])             # a key begins
            content = key | np.concatenate([[g0 is None or g[0] != g0], g[1:] != g[:-1]])   # a content begins
            twice = (place & TWICE) > 0
            number = np.cumsum(key)                                                      # 0: the key of the batch before goes on
            several = np.bincount(number, content & ~key, number[-1] + 1) > 0            # another content of a key begins
            go = content & (twice | ~key)                                                # firsts of later contents, and of strings held twice
            go |= key & several[number]
            early = None
            if waiting is not None and several[0]:
                early, waiting = waiting, None
            if key.any():
                last = np.flatnonzero(key)[-1]
                waiting = None if go[last] else (m[last], d[last], t[last], place[last])
            again = ~content
            keep = go | again
            yield rows(m[keep], d[keep], t[keep], place[keep], again[keep], early)
            m0, g0 = m[-1], g[-1]

    def rows(m, d, t, place, again, early):
        if early is not None:
            m, d, t, place = (np.append(c, e) for c, e in zip((m, d, t, place), early, strict=True))
            again = np.append(again, False)
        first = place >> PLACE
        last = first + ((place & ((1 << PLACE) - 1)) >> 2)
        return pa.RecordBatch.from_arrays([pa.array(m), pa.array(d), pa.array(t), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)),
                                           pa.array(again)], names=["m", "d", "t", "s1", "s2", "again"])

    # segments already known to repeat one need no company: they are spread
    known = F.col("place").bitwiseAND(F.lit(AGAIN)) > 0
    dealt = found.repartition(shuffle_partitions(found), F.when(known, F.xxhash64("d", "t", "place")).otherwise(F.col("m")))
    return dealt.sortWithinPartitions(known, "m", "g", "d", "t", "place").mapInArrow(run, TOLD)


def _pieces(docs: DataFrame, contested: DataFrame) -> DataFrame:
    """(m, blocks, block, d, t, s1, piece): the contested segments' bytes, cut into pieces."""
    size = F.col("s2") - F.col("s1") + 1
    blocks = contested.groupBy("m").agg(F.ceil(F.sum(size + F.ceil(size / PIECE) * (LENGTH - 1)) / BLOCK).cast("int").alias("blocks"))
    listed = (contested.join(blocks, "m").groupBy("d", "t").agg(F.collect_list(F.struct("m", "blocks", "s1", "s2")).alias("own")))

    @F.arrow_udf(T.ArrayType(T.BinaryType()))
    def bytes_of(text: pa.Array, own: pa.Array) -> pa.Array:
        out = []
        for x, rows in zip(text.to_pylist(), own.to_pylist(), strict=True):
            data = x.encode()
            out.append([data[r["s1"]:r["s2"] + LENGTH] for r in rows])
        return pa.array(out, pa.list_(pa.binary()))

    cuts = F.sequence(F.lit(0), F.length("bytes") - LENGTH, F.lit(PIECE))
    return (docs.join(listed, ["d", "t"]).select("d", "t", F.explode(F.arrays_zip("own", bytes_of("text", "own").alias("bytes"))).alias("z"))
                .select("d", "t", "z.own.m", "z.own.blocks", "z.own.s1", "z.bytes")
                .select("m", "blocks", "d", "t", "s1", "bytes", F.explode(cuts).alias("cut"))
                .select("m", "blocks", F.pmod(F.xxhash64("d", "t", "s1", "cut"), "blocks").alias("block"), "d", "t",
                        (F.col("s1") + F.col("cut")).cast("int").alias("s1"),
                        F.substring("bytes", F.col("cut") + 1, F.lit(PIECE + LENGTH - 1)).alias("piece")))


FOUND = "d long, t long, first int, last int, f1 long, f2 long"


def _sorted_repeats(pieces: DataFrame) -> DataFrame:
    """Runs of repeated windows (f1 null), and first places of the strings of keys dealt to several tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, key = [], 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= BATCH and row[:3] != key:    # whole keys (or blocks of a large one) together
                    yield solve(held)
                    held, size = [], 0
                key = row[:3]
                held.append(row)
                size += len(row[6])
        if held:
            yield solve(held)

    def solve(rows):
        again, fresh = repeats([r[6] for r in rows], [(r[3], r[4], r[5]) for r in rows])
        out = [(r[3], r[4], r[5] + a, r[5] + b, None, None) for r, starts in zip(rows, again, strict=True) for a, b in _runs(starts)]
        for window, w, o in fresh:
            m, blocks, _, d, t, s1, _ = rows[w]
            if blocks > 1:
                f = xxhash.xxh3_128(window).digest()
                out.append((d, t, s1 + o, s1 + o, int.from_bytes(f[:8], "little", signed=True), int.from_bytes(f[8:], "little", signed=True)))
        cols = list(zip(*out, strict=True)) or [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(),
                                                                                pa.int64(), pa.int64()), strict=True)],
                                          names=["d", "t", "first", "last", "f1", "f2"])

    return (pieces.repartition("m", "block").sortWithinPartitions("m", "block")
                  .select("m", "blocks", "block", "d", "t", "s1", "piece").mapInArrow(run, FOUND))


def _identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with d (id, nulls first), t (0, or a hash of the text where ids repeat) and text."""
    base = docs.withColumns({"d": F.coalesce(F.col(id_col).cast("long"), F.lit(FIRST_ID)), "text": F.coalesce(F.col(text_col), F.lit(""))})
    hashed = base.select("d", F.md5("text").alias("h"))
    repeated = hashed.groupBy("d").agg((F.min("h") < F.max("h")).alias("x")).where("x").limit(1).count()
    return base.withColumn("t", F.xxhash64(F.md5("text")) if repeated else F.lit(0).cast("long"))


def spans(docs: DataFrame) -> DataFrame:
    """(d, t, spans): first and last windows of the repeated runs of each document (d, t, text)."""
    own = cut(docs.select("d", "t", F.md5("text").alias("h"), F.octet_length("text").alias("n")).distinct(), "texts")
    firsts = own.groupBy("h").agg(F.min(F.struct("d", "t")).alias("f"), F.count("*").alias("c")).where("c > 1")
    copies = cut(own.join(firsts, "h").where(F.struct("d", "t") != F.col("f")).select("d", "t", "n"), "copies")
    alone = _without(docs.where(F.octet_length("text") >= LENGTH).select("d", "t", "text"), copies.select("d", "t"))
    found = _segments(alone)
    told = cut(_told(found), "segments")
    pieces = _pieces(alone, told.where("not again").select("m", "d", "t", "s1", "s2"))
    found = cut(_sorted_repeats(pieces), "repeats")
    by_string = Window.partitionBy("f1", "f2").orderBy("d", "t", "first")
    later = found.where("f1 is not null").withColumn("k", F.row_number().over(by_string)).where("k > 1")
    every = (told.where("again").select("d", "t", "s1", "s2")
             .union(found.where("f1 is null").select("d", "t", "first", "last")).union(later.select("d", "t", "first", "last"))
             .union(copies.where(F.col("n") >= LENGTH).select("d", "t", F.lit(0), (F.col("n") - LENGTH).cast("int"))))
    return every.groupBy("d", "t").agg(F.collect_set(F.struct(F.col("s1").alias("a"), F.col("s2").alias("b"))).alias("spans"))


def removed_runs(rows: list[dict] | None) -> list[tuple[int, int]]:
    """Bytes (from, to) that the runs of windows cover, united."""
    out: list[list[int]] = []
    for a, b in sorted((r["a"], r["b"] + LENGTH) for r in rows or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def without(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    ends = [0, *(b for _, b in runs)]
    return b"".join(data[e:a] for e, a in zip(ends, [*(a for a, _ in runs), len(data)], strict=True))


def whole_points(data: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs, shrunk to whole code points."""
    inside = lambda i: i < len(data) and data[i] & 0xC0 == 0x80
    out = []
    for a, b in runs:
        while inside(a):
            a += 1
        while inside(b):
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    own = _identified(docs.select(F.col(id_col), F.col(text_col).alias("text")), id_col, "text")

    @F.arrow_udf(T.StructType([T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
                               T.StructField("kept_sha256", T.StringType())]))
    def cut_out(text: pa.Array, rows: pa.Array) -> pa.Array:
        removed, n, kept = [], [], []
        for x, r in zip(text.to_pylist(), rows.to_pylist(), strict=True):
            runs = removed_runs(r)
            removed.append(sum(b - a for a, b in runs))
            n.append(len(runs))
            kept.append(hashlib.sha256(without(x.encode(), runs)).hexdigest())
        return pa.StructArray.from_arrays([pa.array(removed, pa.int64()), pa.array(n, pa.int64()), pa.array(kept, pa.string())],
                                          ["n_removed", "n_spans", "kept_sha256"])

    return (own.join(spans(own), ["d", "t"], "left")
               .select(id_col, F.octet_length("text").cast("long").alias("n_bytes"), cut_out("text", "spans").alias("__c"))
               .select(id_col, "n_bytes", "__c.*"))


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated bytes taken out of its texts; code points go whole or stay."""
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("row")
    own = _identified(docs.select(row), f"row.{id_col}", f"row.{text_col}")

    @F.arrow_udf(T.StringType())
    def cut_out(text: pa.Array, rows: pa.Array) -> pa.Array:
        out = []
        for x, r in zip(text.to_pylist(), rows.to_pylist(), strict=True):
            data = x.encode()
            out.append(without(data, whole_points(data, removed_runs(r))).decode())
        return pa.array(out, pa.string())

    text = F.col(f"row.{text_col}")
    kept: Column = F.when(F.col("spans").isNull(), text).otherwise(cut_out(F.coalesce(text, F.lit("")), "spans"))
    return (own.select("d", "t", "row").join(spans(own.select("d", "t", "text")), ["d", "t"], "left")
               .select(F.col("row").withField(text_col, kept).alias("row")).select("row.*"))
