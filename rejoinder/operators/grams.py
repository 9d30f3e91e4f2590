"""Row-local n-gram histograms: each row's distinct grams with their counts, as fixed-width hashes.

A row's tokens are hashed once; a gram is 96 bits over its tokens' hashes and the group's key, and a row's
grams of one order are sorted and run-length encoded, some rows at a time in Arrow batches.  So only distinct
grams leave a row, nothing is aggregated to count them, and every later key has a fixed width (no
strings in hash tables or shuffles).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from rejoinder.functions.text import ws_tokens
from rejoinder.session import cut

#: Tokens whose grams are held at once; the same where grams are packed by bucket; tokens of the corpus for each bucket.
TOKENS, PACKED, BUCKET = 1 << 16, 1 << 19, 1 << 20
#: Tokens of a corpus whose grams of all orders are exchanged together; ranges of hashes, at most, in which a larger corpus's grams of an order are.
PASS, RANGES = 1 << 24, 6

# Functions of this module run inside Python workers: pickled by value, as in ``pairs``.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def group_hash(group_cols: Sequence[str]) -> Column:
    """One 64-bit value for a row's group (a constant without group columns)."""
    return F.xxhash64(F.lit(0), *[x for c in group_cols for x in (F.col(c), F.col(c).isNull())])


def _mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on all bits of ``h`` (a bijection of 64 bits)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _runs(tokens: np.ndarray, lengths: np.ndarray, seed: np.ndarray, orders: Sequence[int],
          part: tuple[int, int] = (0, 1)) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(n, row, h1, h2, c) for each order: the distinct grams of rows of ``lengths`` tokens (64-bit hashes), and their counts.

    ``part``: (k, parts), only grams whose h1 lies in the k-th of so many equal ranges.
    """
    low, high = (np.uint64(min((k << 64) // part[1], (1 << 64) - 1)) for k in (part[0], part[0] + 1))
    row, left = np.repeat(np.arange(len(lengths)), lengths), np.repeat(np.cumsum(lengths), lengths) - np.arange(len(tokens))
    own = _mixed(np.arange(1, len(lengths) + 1, dtype=np.uint64))
    for n in orders:
        at = np.flatnonzero(left >= n)
        one = _mixed(seed[row[at]] + np.uint64(n))
        for k in range(n):
            one = _mixed(one * np.uint64(3) + tokens[at + k])
        if part[1] > 1:
            own_part = np.flatnonzero((one >= low) & ((one < high) | (part[0] + 1 == part[1])))
            at, one = at[own_part], one[own_part]
        two = _mixed(_mixed(seed[row[at]] + np.uint64(n)))
        for k in range(n):
            two = _mixed(two ^ (tokens[at + k] * np.uint64(0x9E3779B97F4A7C15)))
        r, two = row[at], (two >> np.uint64(32)).astype(np.uint32)
        order = np.argsort(one ^ own[r])                        # a row's equal grams become neighbours
        r, one, two = r[order], one[order], two[order]
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        first = np.flatnonzero(new)
        yield n, r[first], one[first].view(np.int64), two[first].view(np.int32), np.diff(first, append=len(r)).astype(np.int32)


def _slices(batches: Iterator[pa.RecordBatch], most: int = TOKENS) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, tokens, lengths): pieces of the batches with about ``most`` tokens, or one row."""
    for batch in batches:
        th = batch.column("th")
        lengths = np.array(th.value_lengths().fill_null(0), np.int64)
        tokens, ends = th.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.cumsum(lengths)
        a = 0
        while a < batch.num_rows:
            before = ends[a] - lengths[a]
            b = max(a + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(a, b - a), tokens[before:ends[b - 1]], lengths[a:b]
            a = b


#: White space of one byte, and of several: (first byte, those after it), as ``ws_tokens`` splits at it.
_SPACE = np.isin(np.arange(256), [*range(9, 14), 32])
_LONG_SPACE = [(0xC2, [[0x85], [0xA0]]), (0xE1, [[0x9A, 0x80]]), (0xE3, [[0x80, 0x80]]),
               (0xE2, [*([0x80, x] for x in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), [0x81, 0x9F]])]


def _text_pieces(texts: pa.Array, most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes and 8 more, where tokens begin, where they end) of some ``most`` bytes of texts, or one text."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        low, high = int(offsets[a]), int(offsets[b])
        data = np.zeros(high - low + 8, np.uint8)
        if high > low:
            data[:-8] = np.frombuffer(texts.buffers()[2], np.uint8)[low:high]
        gap = _SPACE[data[:-8]]
        for first, rest in _LONG_SPACE:
            at = np.flatnonzero(data[:-8] == first)
            for more in rest if len(at) else ():
                found = at[np.logical_and.reduce([data[at + k] == x for k, x in enumerate(more, 1)])]
                for k in range(len(more) + 1):
                    gap[found + k] = True
        edge = np.zeros(len(gap) + 1, bool)                     # a text ends where the next one begins
        edge[offsets[a:b + 1] - low] = True
        starts, ends = ~gap, ~gap
        starts[1:] &= gap[:-1] | edge[1:-1]
        ends[:-1] &= gap[1:] | edge[1:-1]
        yield a, b, data, np.flatnonzero(starts), np.flatnonzero(ends) + 1
        a = b


def _in_rows(texts: pa.Array, a: int, b: int, starts: np.ndarray) -> np.ndarray:
    """How many tokens each text from a to b has."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset + a:texts.offset + b + 1]
    return np.diff(np.searchsorted(starts, offsets - offsets[0]))


def _token_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits for each token, the same in every task: its bytes, eight at a time, mixed into its length."""
    words = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    out, left, at, own = _mixed((ends - starts).astype(np.uint64)), ends - starts, starts, np.arange(len(starts))
    while len(own):
        unused = np.maximum(8 - left, 0).astype(np.uint64) * np.uint64(8)
        out[own] = _mixed((out[own] ^ (words[at] << unused >> unused)) * np.uint64(0x9E3779B97F4A7C15))
        more = left > 8
        own, at, left = own[more], at[more] + 8, left[more] - 8
    return out


def _hashed(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """``_slices`` of batches that hold texts (``text``) instead of their tokens' hashes."""
    for batch in batches:
        texts = batch.column("text")
        for a, b, data, starts, ends in _text_pieces(texts, 6 * most):
            yield batch.slice(a, b - a), _token_hashes(data, starts, ends), _in_rows(texts, a, b, starts)


def token_counts(rows: DataFrame, *, keep: Sequence[str], text_col: str = "text") -> DataFrame:
    """(*keep, hyp_len): the number of a text's whitespace tokens; null for a null text."""
    names = list(keep)
    kinds = StructType([*rows.select(*names).schema, StructField("hyp_len", IntegerType())])

    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            many = [_in_rows(texts, a, b, starts) for a, b, _, starts, _ in _text_pieces(texts, 6 * PACKED)]
            if many:
                counted = pa.array(np.concatenate(many).astype(np.int32), mask=texts.is_null().to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), counted], names=[*names, "hyp_len"])

    return rows.select(*names, F.col(text_col).alias("text")).mapInArrow(run, kinds)


def gram_runs(corpus: DataFrame, *, group_cols: Sequence[str], orders: Sequence[int], keep: Sequence[str] = ("row_id",),
              text_col: str = "text") -> DataFrame:
    """(gh, *keep, n, h1, h2, c): for every row, order and distinct gram of whitespace tokens its hashes and its count in the row.

    ``gh`` is the hash of the group.  A null text has no grams.
    """
    names, orders = ["gh", *keep], list(orders)
    x = corpus.select(group_hash(group_cols).alias("gh"), *keep, F.transform(ws_tokens(text_col), lambda t: F.xxhash64(t)).alias("th"))

    def run(batches):
        for rows, tokens, lengths in _slices(batches):
            seed = rows.column("gh").to_numpy().view(np.uint64)
            for n, row, h1, h2, c in _runs(tokens, lengths, seed, orders):
                own = [rows.column(name).take(pa.array(row)) for name in names]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.full(len(row), n, np.int32)), pa.array(h1), pa.array(h2), pa.array(c)],
                                                 names=[*names, "n", "h1", "h2", "c"])

    added = [StructField(name, of, False) for name, of in (("n", IntegerType()), ("h1", LongType()), ("h2", IntegerType()), ("c", IntegerType()))]
    return x.mapInArrow(run, StructType([x.schema[name] for name in names] + added))


# --- rows of several groups ---------------------------------------------------------

#: An entry of a packed bucket: a row's gram, its count in the row, the row's key and the place of its groups in the bucket's list.
ENTRY = np.dtype([("h1", "<u8"), ("h2", "<u4"), ("c", "<i4"), ("row", "<i8"), ("set", "<i4")])


def _two_best(entries: np.ndarray) -> np.ndarray:
    """``entries`` (in order of h1), of a gram's entries with equal groups but two of the largest counts: no other matters to any group."""
    h1 = entries["h1"]
    if len(h1) < 3:
        return entries
    third = np.flatnonzero(h1[2:] == h1[:-2])                   # grams of three entries or more
    often = np.zeros(len(h1), bool)
    for k in range(3):
        often[third + k] = True
    some = entries[often]
    some = some[np.lexsort((-some["c"], some["set"], some["h2"], some["h1"]))]
    same = np.zeros(len(some), bool)
    same[2:] = (some["h1"][2:] == some["h1"][:-2]) & (some["h2"][2:] == some["h2"][:-2]) & (some["set"][2:] == some["set"][:-2])
    out = np.concatenate([entries[~often], some[~same]])
    return out[np.argsort(out["h1"], kind="stable")]


def _tops(entries: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gh, row, pen, grams) of a bucket: by group and row the grams that the row tops in the group, and the sum of what it has more of them than any other."""
    entries = entries[np.lexsort((entries["h2"], entries["h1"]))]
    gram = np.zeros(len(entries), np.int64)
    gram[1:] = np.cumsum((entries["h1"][1:] != entries["h1"][:-1]) | (entries["h2"][1:] != entries["h2"][:-1]))
    alone = np.bincount(gram)[gram] == 1                        # held by one row
    named, at = np.unique(np.concatenate(sets), return_inverse=True)
    size = np.array([len(s) for s in sets])
    first = np.cumsum(size) - size
    rows, row = np.unique(entries["row"], return_inverse=True)
    many = size[entries["set"]]
    one = np.repeat(np.arange(len(entries)), many)              # an entry for each of its groups
    place = np.arange(len(one)) - np.repeat(np.cumsum(many) - many, many) + first[entries["set"]][one]
    group, c, gram, row = at[place], entries["c"][one].astype(np.int64), gram[one], row[one]
    single = alone[one]
    rest = np.flatnonzero(~single)
    rest = rest[np.lexsort((-c[rest], group[rest], gram[rest]))]
    g, k = group[rest], gram[rest]
    opens = np.ones(len(rest), bool)
    opens[1:] = (g[1:] != g[:-1]) | (k[1:] != k[:-1])
    below = np.zeros(len(rest), np.int64)
    below[:-1] = np.where(opens[1:], 0, c[rest][1:])
    top = rest[opens]
    pen = np.concatenate([c[single], (c[rest] - below)[opens]])
    key, where = np.unique(np.concatenate([group[single], group[top]]) * len(rows) + np.concatenate([row[single], row[top]]), return_inverse=True)
    return (named[key // max(len(rows), 1)], rows[key % max(len(rows), 1)], np.bincount(where, pen, len(key)).astype(np.int64),
            np.bincount(where, minlength=len(key)))


def shared_gram_tops(rows: DataFrame, *, orders: Sequence[int], tokens: int) -> DataFrame:
    """(gh, row, n, pen, grams) of rows that belong to several groups each, their grams exchanged once whatever the number of groups.

    ``rows``: (row: a row's key, sets: hashes of its groups, th: hashes of its tokens, or text); ``tokens``: how many those are in all.  A gram that
    rows of a group hold counts, in ``grams``, for the one with the largest count; ``pen`` sums what that is above any other row's.
    A corpus of more than ``PASS`` tokens is read several times, each time for the grams of one order in one of at most ``RANGES`` ranges of
    their hash: only those are exchanged together, and their files are gone when the next ones are made.
    """
    if tokens <= PASS:
        passes = [(list(orders), (0, 1))]
    else:
        parts = min(RANGES, -(-tokens // PASS))
        passes = [([n], (k, parts)) for n in orders for k in range(parts)]
    out = None
    for some, part in passes:
        tops = _pass_tops(rows, some, -(-tokens // part[1]), part)
        summed = tops.groupBy("gh", "row", "n").agg(F.sum("pen").alias("pen"), F.sum("grams").alias("grams"))
        found = cut(summed, "gram-tops")
        out = found if out is None else out.unionByName(found)
    return out


def _pass_tops(rows: DataFrame, orders: list[int], tokens: int, part: tuple[int, int]) -> DataFrame:
    """``shared_gram_tops`` of the grams of ``orders`` in a ``part`` of the hashes, by bucket: ranges of about ``BUCKET`` tokens' grams, packed as bytes."""
    buckets, hashed = max(1, -(-tokens // BUCKET)), "th" in rows.columns
    low, high = ((k << 64) // part[1] for k in (part[0], part[0] + 1))
    edges = np.array([low + (high - low) * b // buckets for b in range(1, buckets)], np.uint64)

    def pack(batches):
        for piece, tokens, lengths in _slices(batches, PACKED) if hashed else _hashed(batches, PACKED):
            keys = piece.column("row").to_numpy()
            codes = piece.column("sets").to_pylist()
            known: dict = {}
            code = np.array([known.setdefault(tuple(s), len(known)) for s in codes], np.int32)
            listed = [np.array(s, np.int64) for s in known]
            held = pa.array([np.concatenate([np.array([len(listed)]), [len(s) for s in listed], *listed]).astype("<i8").tobytes()], pa.binary())
            for n, row, h1, h2, c in _runs(tokens, lengths, np.zeros(len(lengths), np.uint64), orders, part):
                entries = np.empty(len(row), ENTRY)
                entries["h1"], entries["h2"], entries["c"], entries["row"], entries["set"] = h1.view(np.uint64), h2.view(np.uint32), c, keys[row], code[row]
                entries = _two_best(entries[np.argsort(entries["h1"])])
                ends = [0, *np.searchsorted(entries["h1"], edges).tolist(), len(entries)]
                found = [(b, entries[x:y].tobytes()) for b, (x, y) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if x < y]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([n] * len(found), pa.int32()), pa.array([b for b, _ in found], pa.int32()),
                                                      pa.array([e for _, e in found], pa.binary()), held.take(pa.array([0] * len(found)))],
                                                     names=["n", "bucket", "entries", "sets"])

    def settle(table: pa.Table) -> pa.Table:
        known, parts = {}, []
        for data, held in zip(table.column("entries").to_pylist(), table.column("sets").to_pylist(), strict=True):
            flat = np.frombuffer(held, "<i8")
            lengths = flat[1:1 + flat[0]]
            own = np.array([known.setdefault(s.tobytes(), len(known)) for s in np.split(flat[1 + flat[0]:], np.cumsum(lengths)[:-1])], np.int32)
            part = np.frombuffer(data, ENTRY).copy()
            part["set"] = own[part["set"]]
            parts.append(part)
        gh, row, pen, grams = _tops(np.concatenate(parts), [np.frombuffer(s, "<i8") for s in known])
        return pa.table({"gh": gh, "row": row, "n": pa.array(np.full(len(gh), table.column("n")[0].as_py(), np.int32)), "pen": pen, "grams": grams})

    packed = rows.select("row", "sets", "th" if hashed else "text").mapInArrow(pack, "n int, bucket int, entries binary, sets binary")
    return packed.groupBy("n", "bucket").applyInArrow(settle, "gh long, row long, n int, pen long, grams long")
