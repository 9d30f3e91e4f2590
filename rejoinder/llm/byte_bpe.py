r"""Byte-level BPE encoding and decoding without a regular expression in the hot path.

Pre-tokenisation works on whole arrays of code points:

1. every code point gets a class (letter, number, white space, other) from a
   table; white space that ends a run, and apostrophes that can open a
   contraction, get symbols of their own by looking at the next code points;
2. every symbol is a function from the state before it to the state after it
   (eight states, e.g. "inside a letter run" or "after a prefix space").
   Composition of such functions is associative, so the state before every
   code point comes from a blocked scan: functions of blocks, a doubling scan
   over the blocks, then the states inside all blocks side by side;
3. (symbol, state) says whether a slice starts there.

The slices are looked up in a bounded per-worker cache; only unseen slices run
the pair merging.  The byte offset of every slice is kept, and decoding
concatenates the tokens' bytes.

The pattern reproduced is the usual byte-level one:
``'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+``.

Null and empty texts encode to no ids and decode to no bytes.  Rows, repeated
rows and other columns pass through; an existing column with an output's name is
replaced.  Texts are encoded whole; a batch is cut between texts to bound memory.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rejoinder.llm.common import worker_state

#: Code points handled at once in a worker (a longer text is handled alone).
CHUNK = 1 << 20
#: Entries of the slice cache of a worker, and the longest slice kept in it (bytes).
CACHE_SLICES, CACHE_LEN = 250_000, 48
#: Up to so many bytes a slice's pairs are searched anew for each merge; beyond, a heap holds them.
SHORT = 100
NO_RANK = 1 << 40

LETTER, NUMBER, OTHER, END_WS, END_SPACE, RUN_WS, APOS_1, APOS_2 = range(8)
FREE, IN_LETTER, IN_NUMBER, IN_OTHER, IN_WS, PREFIX, LEFT_1, LEFT_2 = range(8)


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, slice starts here) by symbol and state."""
    nxt, start = np.zeros((8, 8), np.uint8), np.ones((8, 8), bool)
    for symbol, state in ((LETTER, IN_LETTER), (NUMBER, IN_NUMBER), (OTHER, IN_OTHER)):
        nxt[symbol] = state
        start[symbol, [state, PREFIX]] = False
    nxt[LETTER, [LEFT_1, LEFT_2]] = FREE, LEFT_1       # the letters of a contraction
    start[LETTER, [LEFT_1, LEFT_2]] = False
    nxt[END_WS], nxt[END_SPACE], nxt[RUN_WS] = FREE, PREFIX, IN_WS
    start[RUN_WS, IN_WS] = False
    for symbol, state in ((APOS_1, LEFT_1), (APOS_2, LEFT_2)):
        nxt[symbol] = state
        nxt[symbol, [IN_OTHER, PREFIX]] = IN_OTHER     # inside a run of others it is one of them
        start[symbol, [IN_OTHER, PREFIX]] = False
    return nxt, start


NEXT, START = _automaton()
#: The same for the first code point of a text: whatever came before, the state is FREE.
NEXT = np.concatenate([NEXT, np.repeat(NEXT[:, :1], 8, axis=1)])
START = np.concatenate([START, np.repeat(START[:, :1], 8, axis=1)])


def class_table() -> np.ndarray:
    r"""LETTER, NUMBER, OTHER or RUN_WS for every code point, built once per worker.

    Unicode versions differ in newly assigned letters, so the classes are read
    from the library whose ids are to be matched: an encoding of single bytes
    with the pattern ``\p{L}`` returns the bytes of the letters alone.
    """
    single = {bytes([b]): b for b in range(256)}
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (RUN_WS, r"\s")):
        own = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        table[np.frombuffer(bytes(own.encode_ordinary(every)).decode().encode("utf-32-le"), np.uint32)] = kind
    return table


#: NEXT by symbol * 8 + state, as a table that bytes.translate() reads.
STEP = NEXT.tobytes().ljust(256, b"\0")


def _step(symbols: np.ndarray, states: np.ndarray) -> np.ndarray:
    at = symbols << 3 | states
    return np.frombuffer(at.tobytes().translate(STEP), np.uint8).reshape(at.shape)


def states_before(symbols: np.ndarray, block: int = 256) -> np.ndarray:
    """The automaton's state before each symbol, by an associative scan of transition functions."""
    n = len(symbols)
    rows = -(-n // block)
    grid = np.full(rows * block, END_WS, np.uint8)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(rows, block).T)
    whole = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
    for column in grid:
        whole = _step(column[:, None], whole)
    whole, step = whole.copy(), 1
    while step < rows:                                  # whole[i] becomes block 0 .. block i
        whole[step:] = np.take_along_axis(whole[step:], whole[:-step].copy(), axis=1)
        step *= 2
    state = np.concatenate([np.zeros(1, np.uint8), whole[:-1, FREE]])
    before = np.empty((block, rows), np.uint8)
    for j, column in enumerate(grid):
        before[j] = state
        state = _step(column, state)
    return before.T.reshape(-1)[:n]


def slice_starts(points: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Whether a slice starts at each code point; ``first`` holds where the texts start."""
    n = len(points)
    symbols = classes[points]
    opens = np.zeros(n + 2, bool)                       # a text starts here, or all texts end
    opens[first] = opens[n:] = True
    white = symbols == RUN_WS
    ends = white.copy()                                 # last of its run, and something follows
    ends[:-1] &= ~white[1:]
    ends &= ~opens[1:n + 1]
    symbols[ends] = END_WS
    symbols[ends & (points == 0x20)] = END_SPACE
    if len(at := np.flatnonzero(points == 0x27)):
        ahead = np.concatenate([points, np.zeros(2, points.dtype)])
        one = np.where(opens[at + 1], 0, ahead[at + 1])
        two = np.where(opens[at + 1] | opens[at + 2], 0, ahead[at + 2])
        symbols[at[np.isin(one, [ord(c) for c in "stmd"])]] = APOS_1
        pairs = [(ord(p[0]) << 21) + ord(p[1]) for p in ("re", "ve", "ll")]
        symbols[at[np.isin((one.astype(np.int64) << 21) + two, pairs)]] = APOS_2
    symbols[first] += 8
    return START[symbols, states_before(symbols)]


class SliceCache(dict):
    """Slice -> its ids as little-endian unsigned 32-bit integers; misses run the merging."""

    def __init__(self, merge):
        super().__init__()
        self.merge = merge

    def __missing__(self, piece: bytes) -> bytes:
        ids = array("I", self.merge(piece)).tobytes()
        if len(piece) <= CACHE_LEN:
            self[piece] = ids
        return ids


class Codec:
    """Encoder and decoder for one rank file (``base64(token) rank`` per line)."""

    def __init__(self, rank_file: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines()) if a}
        self.tokens = dict(zip(self.ranks.values(), self.ranks.keys(), strict=True))
        self.classes = class_table()
        self.cache = SliceCache(self.merge)

    def merge(self, piece: bytes) -> list[int]:
        """Merge the pair of lowest rank, leftmost first, until none is a token."""
        rank = self.ranks.get
        if (whole := rank(piece)) is not None:
            return [whole]
        if len(piece) > SHORT:
            return self._merge_long(piece)
        cuts = list(range(len(piece) + 1))
        pairs = [rank(piece[i:i + 2], NO_RANK) for i in range(len(piece) - 1)]
        while (low := min(pairs, default=NO_RANK)) < NO_RANK:
            i = pairs.index(low)
            del cuts[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = rank(piece[cuts[i]:cuts[i + 2]], NO_RANK)
            if i:
                pairs[i - 1] = rank(piece[cuts[i - 1]:cuts[i + 1]], NO_RANK)
        return [self.ranks[piece[a:b]] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _merge_long(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        end = list(range(1, len(piece) + 1))            # part starting at i ends at end[i]; 0: merged away
        prev = list(range(-1, len(piece) - 1))
        heap = [(r, i, i + 2) for i in range(len(piece) - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            mid = end[i]
            if not mid or mid == len(piece) or end[mid] != stop:
                continue                                # one of the two parts has changed since
            end[i], end[mid] = stop, 0
            if stop < len(piece):
                prev[stop] = i
                if (r := ranks.get(piece[i:end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := prev[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < len(piece):
            out.append(ranks[piece[i:end[i]]])
            i = end[i]
        return out

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, byte offset of each slice) of each text."""
        group: list[str] = []
        size = 0
        for text in texts:
            if group and size + len(text) > CHUNK:
                yield from self._encode(group)
                group, size = [], 0
            group.append(text)
            size += len(text)
        yield from self._encode(group)

    def _encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        lengths = np.array([len(t) for t in texts], np.int64)
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        first = (np.cumsum(lengths) - lengths)[lengths > 0]
        if len(points):
            at = np.flatnonzero(slice_starts(points, first, self.classes))
            width = 1 + (points >= 0x80).astype(np.uint8) + (points >= 0x800) + (points >= 0x10000)
            byte_at = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
        else:
            at, byte_at = np.zeros(0, np.int64), np.zeros(1, np.int64)
        data = "".join(texts).encode()
        bounds = [*byte_at[at].tolist(), len(data)]
        pieces = [data[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        cut = np.searchsorted(at, np.concatenate([[0], np.cumsum(lengths)])).tolist()
        if len(self.cache) > CACHE_SLICES:
            self.cache.clear()
        coded = list(map(self.cache.__getitem__, pieces))
        starts = byte_at[at]
        begin = byte_at[np.cumsum(lengths) - lengths].tolist()
        for i, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
            yield np.frombuffer(b"".join(coded[a:b]), "<u4"), starts[a:b] - begin[i]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def _codec(rank_file: bytes) -> Codec:
    return worker_state("byte_bpe_" + hashlib.sha1(rank_file).hexdigest(), lambda: Codec(rank_file))


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_udf(rank_path: str):
    """Text -> struct(ids, offsets); the rank file (under 1 MB) travels with the function."""
    ranks = _read(rank_path)

    @F.arrow_udf(T.StructType([T.StructField("ids", T.ArrayType(T.LongType())),
                               T.StructField("offsets", T.ArrayType(T.LongType()))]))
    def run(text: pa.Array) -> pa.Array:
        got = list(_codec(ranks).encode([t or "" for t in text.to_pylist()]))
        lists = []
        for k in (0, 1):
            ends = np.concatenate([[0], np.cumsum([len(x[k]) for x in got])]).astype(np.int32)
            flat = np.concatenate([x[k] for x in got]) if got else np.zeros(0)
            lists.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int64))))
        return pa.StructArray.from_arrays(lists, ["ids", "offsets"])

    return run


def decode_udf(rank_path: str):
    """Ids -> the decoded bytes (null ids: no bytes)."""
    ranks = _read(rank_path)

    @F.arrow_udf(T.BinaryType())
    def run(ids: pa.Array) -> pa.Array:
        codec = _codec(ranks)
        return pa.array([codec.decode(x or ()) for x in ids.to_pylist()], pa.binary())

    return run


def digest_udf(rank_path: str):
    """Text -> struct(n_tokens, ids_sha256, decoded_sha256, n_slices) after a round trip.

    One pass: the ids never leave the worker, only their digests do.
    """
    ranks = _read(rank_path)

    @F.arrow_udf(T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
                               T.StructField("decoded_sha256", T.StringType()), T.StructField("n_slices", T.LongType())]))
    def run(text: pa.Array) -> pa.Array:
        codec = _codec(ranks)
        rows = [(len(ids), hashlib.sha256(ids.tobytes()).hexdigest(),
                 hashlib.sha256(codec.decode(ids.tolist())).hexdigest(), len(offsets))
                for ids, offsets in codec.encode([t or "" for t in text.to_pylist()])]
        n, a, b, m = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string()),
                                           pa.array(m, pa.int64())],
                                          ["n_tokens", "ids_sha256", "decoded_sha256", "n_slices"])

    return run


def encode(df: DataFrame, rank_path: str, *, text_col: str = "text", ids_col: str = "ids",
           offsets_col: str = "offsets") -> DataFrame:
    """``df`` with the ids of each text and the byte offset of each of its slices."""
    coded: Column = encode_udf(rank_path)(F.col(text_col))
    return (df.withColumn("__coded", coded)
              .withColumns({ids_col: F.col("__coded.ids"), offsets_col: F.col("__coded.offsets")}).drop("__coded"))


def decode(df: DataFrame, rank_path: str, *, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with the bytes its ids stand for."""
    return df.withColumn(out_col, decode_udf(rank_path)(F.col(ids_col)))


def digests(df: DataFrame, rank_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts and digests of its ids and of the bytes decoded from them."""
    return (df.select(F.col(id_col), digest_udf(rank_path)(F.col(text_col)).alias("__d"))
              .select(id_col, "__d.*"))
