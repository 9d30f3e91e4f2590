r"""Alignment of two tokenizers' tokens over the bytes of each text, and corpus-wide counts of the id pairs it links.

A text is encoded by a byte-level BPE tokenizer with a space in front (A) and by a sentencepiece model that
adds that space itself (B).  Strings of special tokens are plain text.  Tokens stand for bytes: A's entries
decode byte by byte, B's pieces are UTF-8 with the word mark as a space and ``<0xHH>`` as one byte.

* Incidence.  Rows of the matrices A and B are token occurrences, columns the bytes of the text, in compressed sparse
  rows.  The product A B' (row by row, in Gustavson's manner: the rows of B' that a row of A names are added up) has
  an entry for each overlapping pair of occurrences, with the number of bytes they share: the links.
* Groups.  Where an A and a B token end at the same byte, a group ends.  The product of the token-group matrices
  has an entry for each pair of occurrences in one group: the shared-group links.
* Texts are multiplied together, about ``PRODUCT_BYTES`` at once, as one block-diagonal product: tokens of both end where a text does.
* Units.  Neither tokenizer joins a space to a character other than white space before it, so a text's tokens are those of the parts
  between such spaces, which are encoded once and kept in a bounded cache.  (Where a B piece holds a word mark after another
  character, a text is one part.)
* Corpus counts.  Texts form blocks of about ``BLOCK_BYTES``.  A block is a row for each text, with which of the block's distinct
  id pairs it has and how often, and rows of at most ``PIECE`` of those pairs with their counts: no row grows with the block, so a
  reader or writer holds a bounded part of a task's blocks.  Pairs are added up over blocks (never over texts), and what a
  block needs comes back to it by a join on the pair and a regrouping by block, one block at a time.

Null and empty texts, and texts whose A or B bytes differ from space and text, have no tokens: all counts are 0, the digest
is ''.  Rows are independent but for the corpus counts; repeated ids and rows are rows of their own and add to them.  Texts
are read whole.  Extra columns: ``align`` passes them through and replaces those with an output's name, ``digests`` drops them.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from rejoinder.llm.common import cut, worker_state
from rejoinder.llm.token_records import WordEncoder

MARK = "▁"
#: Bytes of text in a block, units in a worker's cache, the longest unit kept, characters of text multiplied at once.
BLOCK_BYTES, CACHE_UNITS, CACHE_LEN, PRODUCT_BYTES = 4 << 20, 500_000, 64, 1 << 18
#: Id pairs of a row, and rows of texts that are taken from Arrow at once.
PIECE, TAKEN = 4096, 256


# --- sparse rows ---------------------------------------------------------------

@dataclass
class Rows:
    """A sparse matrix by rows: the columns of row i are columns[start[i]:start[i + 1]]."""

    start: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int

    def transposed(self) -> Rows:
        order = np.argsort(self.columns, kind="stable")
        row = np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))
        start = np.concatenate([[0], np.cumsum(np.bincount(self.columns, minlength=self.width))])
        return Rows(start, row[order], self.values[order], len(self.start) - 1)

    def times(self, other: Rows) -> Rows:
        """The product: row i is the sum of the rows of ``other`` that row i names."""
        many = other.start[self.columns + 1] - other.start[self.columns]
        n_rows = len(self.start) - 1
        row = np.repeat(np.repeat(np.arange(n_rows), np.diff(self.start)), many)
        ends = np.cumsum(many)
        at = np.arange(len(row)) - np.repeat(ends - many, many) + np.repeat(other.start[self.columns], many)
        column, value = other.columns[at], np.repeat(self.values, many) * other.values[at]
        cell = row * other.width + column
        if len(cell) > 1 and (cell[1:] < cell[:-1]).any():
            order = np.argsort(cell, kind="stable")
            cell, row, column, value = cell[order], row[order], column[order], value[order]
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
        value = np.add.reduceat(value, first) if len(first) else value
        start = np.concatenate([[0], np.cumsum(np.bincount(row[first], minlength=n_rows))])
        return Rows(start, column[first], value, other.width)

    def cells(self) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(self.start) - 1), np.diff(self.start)), self.columns


def over_bytes(lengths: np.ndarray) -> Rows:
    """Tokens by bytes: each token holds the next ``length`` bytes."""
    start = np.concatenate([[0], np.cumsum(lengths)])
    return Rows(start, np.arange(start[-1]), np.ones(start[-1], np.int64), int(start[-1]))


def over_groups(ends: np.ndarray, borders: np.ndarray) -> Rows:
    """Tokens by groups: each token lies in the group whose border is the first at or after its end."""
    return Rows(np.arange(len(ends) + 1), np.searchsorted(borders, ends), np.ones(len(ends), np.int64), len(borders))


#: A space that white space precedes.
_RUN = re.compile(r"\s ")


# --- tokenizers ----------------------------------------------------------------

def _byte_of() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself if visible, else the next from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Aligner:
    """Both tokenizers, and the aligned units."""

    def __init__(self, config: str, model: bytes):
        self.a = WordEncoder(config, special_as_text=True)
        byte_of, own = _byte_of(), Tokenizer.from_str(config).get_vocab()
        self.a_bytes = [b""] * (max(own.values()) + 1)
        for piece, i in own.items():
            self.a_bytes[i] = bytes(byte_of[c] for c in piece) if all(c in byte_of for c in piece) else piece.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.by_unit = self.a.by_word and not self.a.added and not any(MARK in p.lstrip(MARK) for p in pieces)
        self.a_len, self.b_len = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.width = len(pieces)
        names = [str(i).encode() for i in range(max(len(self.a_bytes), len(pieces)))]
        self.digits = np.array([len(x) for x in names], np.int64)
        self.decimal = np.array([list(x.ljust(len(names[-1]))) for x in names], np.uint8)
        self.cache: dict[str, tuple[bytes, bytes] | None] = {}

    def units(self, text: str) -> list[str]:
        """Parts of a text; each but for the space in front of it, which is A's first character and added by B."""
        if not self.by_unit:
            return [text]
        parts = text.split(" ")
        if text[0] != " " and text[-1] != " " and not _RUN.search(text):
            return parts
        out = [parts[0]]
        for i, p in enumerate(parts[1:], 1):
            if not out[-1] or out[-1][-1].isspace() or not p and i + 1 == len(parts):
                out[-1] = f"{out[-1]} {p}"
            else:
                out.append(p)
        return out

    def encoded(self, units: list[str]) -> list[tuple[bytes, bytes] | None]:
        """(A ids, B ids) of each unit, as bytes; None if they do not stand for the unit's bytes."""
        spaced = [" " + u for u in units]
        a = self.a.library(spaced)
        b = [array("i", x).tobytes() for x in self.b.encode(units, num_threads=1)]
        wanted = [u.encode() for u in spaced]
        size = np.array([len(u) for u in wanted])
        whole = True
        for coded, kind, length, table in ((a, self.a.dtype, self.a_len, self.a_bytes), (b, np.int32, self.b_len, self.b_bytes)):
            ids = np.frombuffer(b"".join(coded), kind)
            ends = np.cumsum([len(x) // np.dtype(kind).itemsize for x in coded])
            stands = np.concatenate([[0], np.cumsum(length[ids])])[np.concatenate([[0], ends]).astype(np.int64)]
            whole = whole and (np.diff(stands) == size).all() and b"".join(map(table.__getitem__, ids.tolist())) == b"".join(wanted)
        if whole:
            return list(zip(a, b, strict=True))
        if len(units) > 1:                              # some differ: told one by one
            half = len(units) // 2
            return self.encoded(units[:half]) + self.encoded(units[half:])
        return [None]

    def _learn(self, units: list[str], into: dict) -> None:
        part, size = [], 0
        for u in units:
            part.append(u)
            size += len(u)
            if size > PRODUCT_BYTES:
                into.update(zip(part, self.encoded(part), strict=True))
                part, size = [], 0
        if part:
            into.update(zip(part, self.encoded(part), strict=True))

    def tokens(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """(A ids, B ids) of each text, as bytes; none for an empty text and for one whose bytes differ."""
        split = [self.units(t) if t else [] for t in texts]
        needed = set().union(*split)
        if len(self.cache) > CACHE_UNITS:
            self.cache.clear()
        new = needed.difference(self.cache)
        self._learn([u for u in new if len(u) <= CACHE_LEN], self.cache)
        long: dict = {}
        self._learn([u for u in new if len(u) > CACHE_LEN], long)
        out = []
        for text, units in zip(texts, split, strict=True):
            found = [long[u] if u in long else self.cache[u] for u in units] if long else list(map(self.cache.__getitem__, units))
            if None in found:                           # told by the whole text
                found = [x for x in self.encoded([text]) if x] if len(units) > 1 else []
            a, b = zip(*found, strict=True) if found else ((), ())
            out.append((b"".join(a), b"".join(b)))
        return out

    def groups_as_text(self, a: np.ndarray, b: np.ndarray, in_a: Rows, in_b: Rows) -> tuple[np.ndarray, np.ndarray]:
        """The groups ``a1,a2|b1;a3|b2,b3;`` of all tokens as bytes, and where each token, in that order, begins."""
        many_a, many_b = (np.bincount(x.columns, minlength=x.width) for x in (in_a, in_b))
        upto_a, upto_b = np.cumsum(many_a), np.cumsum(many_b)
        place_a = np.arange(len(a)) + (upto_b - many_b)[in_a.columns]
        place_b = np.arange(len(b)) + upto_a[in_b.columns]
        ids, mark = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[place_a], ids[place_b] = a, b
        mark[place_a[upto_a - 1]], mark[place_b[upto_b - 1]] = ord("|"), ord(";")
        size = self.digits[ids]
        start = np.concatenate([[0], np.cumsum(size + 1)])
        out = np.empty(start[-1], np.uint8)
        for k in range(self.decimal.shape[1]):
            has = size > k
            out[start[:-1][has] + k] = self.decimal[ids[has], k]
        out[start[:-1] + size] = mark
        return out, start

    def aligned(self, texts: list[str]) -> tuple[list[list[int]], list[str], list[np.ndarray]]:
        """For each text [A tokens, B tokens, groups, links, shared-group links], the groups' digest, and the id pairs of its links."""
        coded = self.tokens(texts)
        a = np.frombuffer(b"".join(x for x, _ in coded), self.a.dtype).astype(np.int64)
        b = np.frombuffer(b"".join(y for _, y in coded), np.int32).astype(np.int64)
        n_a, n_b = (np.array([len(x[k]) // size for x in coded], np.int64) for k, size in ((0, self.a.dtype.itemsize), (1, 4)))
        tokens_a, tokens_b = over_bytes(self.a_len[a]), over_bytes(self.b_len[b])
        links = tokens_a.times(tokens_b.transposed())
        borders = np.intersect1d(tokens_a.start[1:], tokens_b.start[1:], assume_unique=True)
        in_a, in_b = over_groups(tokens_a.start[1:], borders), over_groups(tokens_b.start[1:], borders)
        shared = in_a.times(in_b.transposed())
        i, j = links.cells()
        pairs = a[i] * self.width + b[j]
        text, start = self.groups_as_text(a, b, in_a, in_b)
        upto_a, upto_b = (np.concatenate([[0], np.cumsum(n)]) for n in (n_a, n_b))
        n_groups = np.diff(np.searchsorted(borders, tokens_a.start[upto_a], side="right"))
        counts = np.stack([n_a, n_b, n_groups, np.diff(links.start[upto_a]), np.diff(shared.start[upto_a])], 1).tolist()
        cut_at = start[upto_a + upto_b]
        digest = [hashlib.sha256(text[s:e - 1]).hexdigest() if e > s else "" for s, e in zip(cut_at[:-1].tolist(), cut_at[1:].tolist(), strict=True)]
        return counts, digest, np.split(pairs, links.start[upto_a[1:-1]])


def _aligner(config: str, model: bytes) -> Aligner:
    name = hashlib.sha1(config.encode() + model).hexdigest()
    return worker_state("aligner_" + name, lambda: Aligner(config, model))


def _files(a_path: str, b_path: str) -> tuple[str, bytes]:
    with open(a_path, encoding="utf-8") as f, open(b_path, "rb") as g:
        return f.read(), g.read()


# --- Spark ---------------------------------------------------------------------

def align(df: DataFrame, a_path: str, b_path: str, *, text_col: str = "text") -> DataFrame:
    """``df`` with a_ids, b_ids, links (a, b, bytes: places of tokens and shared bytes) and shared (a, b: in one group) of each text."""
    config, model = _files(a_path, b_path)
    pair = [("a", pa.int32()), ("b", pa.int32())]
    kinds = {"a_ids": pa.list_(pa.int32()), "b_ids": pa.list_(pa.int32()), "links": pa.list_(pa.struct([*pair, ("bytes", pa.int32())])),
             "shared": pa.list_(pa.struct(pair))}

    @F.arrow_udf("struct<a_ids:array<int>,b_ids:array<int>,links:array<struct<a:int,b:int,bytes:int>>,shared:array<struct<a:int,b:int>>>")
    def run(texts: pa.Array) -> pa.Array:
        own = _aligner(config, model)
        rows = []
        for t in texts.to_pylist():
            coded = (own.encoded([t])[0] if t else None) or (b"", b"")
            a, b = np.frombuffer(coded[0], own.a.dtype).astype(np.int64), np.frombuffer(coded[1], np.int32)
            x, y = over_bytes(own.a_len[a]), over_bytes(own.b_len[b])
            links = x.times(y.transposed())
            borders = np.intersect1d(x.start[1:], y.start[1:])
            shared = over_groups(x.start[1:], borders).times(over_groups(y.start[1:], borders).transposed())
            rows.append({"a_ids": a.tolist(), "b_ids": b.tolist(),
                         "links": [dict(zip(("a", "b", "bytes"), c, strict=True)) for c in zip(*(v.tolist() for v in (*links.cells(), links.values)), strict=True)],
                         "shared": [dict(zip("ab", c, strict=True)) for c in zip(*(v.tolist() for v in shared.cells()), strict=True)]})
        return pa.array(rows, pa.struct(list(kinds.items())))

    return df.withColumn("__x", run(F.col(text_col))).withColumns({c: F.col(f"__x.{c}") for c in kinds}).drop("__x")


_COUNTS = ["n_a", "n_b", "n_groups", "n_links", "n_shared"]
_TEXT = [("doc_id", "long"), *((c, "long") for c in _COUNTS), ("digest", "string"), ("at", "array<int>"), ("times", "array<int>")]
_BLOCK = ", ".join(f"{c} {kind}" for c, kind in [("block", "long"), *_TEXT, ("pairs", "array<long>"), ("totals", "array<long>")])
_ARROW = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}


def blocks(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Blocks of texts (doc_id, text): a row for each text, with counts and its share in the block's distinct id pairs, and rows of those (``pairs``) with totals."""
    config, model = _files(a_path, b_path)

    def block(own: Aligner, number: int, ids: list, texts: list[str]) -> Iterator[pa.RecordBatch]:
        counts, digest, codes, part, size = [], [], [], [], 0
        for at, text in enumerate(texts):
            part.append(text)
            size += len(text)
            if size > PRODUCT_BYTES or at + 1 == len(texts):
                for into, more in zip((counts, digest, codes), own.aligned(part), strict=True):
                    into += more
                part, size = [], 0
        lengths = [len(c) for c in codes]
        pairs, place = np.unique(np.concatenate(codes), return_inverse=True)
        totals = np.bincount(place, minlength=len(pairs))
        del codes

        def rows(many: int, **columns) -> pa.RecordBatch:
            kinds = dict([("block", pa.int64()), *((c, _ARROW[kind]) for c, kind in _TEXT), ("pairs", pa.list_(pa.int64())), ("totals", pa.list_(pa.int64()))])
            columns["block"] = [number] * many
            return pa.RecordBatch.from_arrays([columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns.get(c, [None] * many), kind)
                                               for c, kind in kinds.items()], names=list(kinds))

        def listed(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.ListArray:
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))

        begin = 0
        for a in range(0, len(texts), TAKEN):
            at, times, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [0]
            for n in lengths[a:a + TAKEN]:
                x, many = np.unique(place[begin:begin + n], return_counts=True)
                begin += n
                at.append(x)
                times.append(many)
                ends.append(ends[-1] + len(x))
            b = min(a + TAKEN, len(texts))
            yield rows(b - a, doc_id=ids[a:b], **dict(zip(_COUNTS, zip(*counts[a:b], strict=True), strict=True)), digest=digest[a:b],
                       at=listed(np.concatenate(at), ends, pa.int32()), times=listed(np.concatenate(times), ends, pa.int32()))
        for a in range(0, len(pairs), PIECE * TAKEN):
            own_pairs, own_totals = pairs[a:a + PIECE * TAKEN], totals[a:a + PIECE * TAKEN]
            ends = [*range(0, len(own_pairs), PIECE), len(own_pairs)]
            yield rows(len(ends) - 1, pairs=listed(own_pairs, ends, pa.int64()), totals=listed(own_totals, ends, pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _aligner(config, model)
        number, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in (whole.slice(a, TAKEN) for whole in batches for a in range(0, whole.num_rows, TAKEN)):
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(key)
                texts.append(text or "")
                size += 64 + len(texts[-1])
                if size > BLOCK_BYTES:
                    yield from block(own, number, ids, texts)
                    number, ids, texts, size = number + 1, [], [], 0
        if ids:
            yield from block(own, number, ids, texts)

    return docs.mapInArrow(run, _BLOCK)


def pair_counts(held: DataFrame, width: int) -> DataFrame:
    """(pair, count, best): links of every id pair over all blocks, and whether none of its B id has more."""
    each = held.where("pairs is not null").select(F.explode(F.arrays_zip("pairs", "totals")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.totals").alias("n"))
    counts = cut(each.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.col("pair") % width), "pair-counts")
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def _width(model_path: str) -> int:
    return sentencepiece.SentencePieceProcessor(model_file=model_path).get_piece_size()


def corpus_pairs(docs: DataFrame, a_path: str, b_path: str, *, text_col: str = "text") -> DataFrame:
    """(a_id, b_id, count, best): the id pairs that links of the corpus hold."""
    width = _width(b_path)
    held = cut(blocks(docs.select(F.lit(None).cast("long").alias("doc_id"), F.col(text_col).alias("text")), a_path, b_path), "aligned")
    counts = pair_counts(held, width)
    return counts.select(F.floor(F.col("pair") / width).cast("int").alias("a_id"), (F.col("pair") % width).cast("int").alias("b_id"), "count", "best")


def digests(docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and n_shared (shared-group links)."""
    held = cut(blocks(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), a_path, b_path), "aligned")
    counts = pair_counts(held, _width(b_path))
    wanted = held.where("pairs is not null").select("block", F.explode("pairs").alias("pair")).join(counts, "pair").select(F.col("block").alias("of"), "pair", "count", "best")
    texts = held.where("pairs is null").select("block", *[c for c, _ in _TEXT])

    def run(own: pa.Table, told: pa.Table) -> pa.Table:
        order = np.argsort(told.column("pair").to_numpy())          # texts name pairs by their place in this order
        at, times = (own.column(c).combine_chunks().flatten().to_numpy() for c in ("at", "times"))
        ends = np.concatenate([[0], np.cumsum(own.column("at").combine_chunks().value_lengths().to_numpy())])
        sums = []
        for c in ("best", "count"):
            value = told.column(c).to_numpy()[order].astype(np.int64)
            running = np.concatenate([[0], np.cumsum(times * value[at])])
            sums.append(pa.array(np.diff(running[ends]), pa.int64()))
        return pa.table([own.column("doc_id"), *(own.column(c) for c in _COUNTS[:4]), *sums, own.column("digest"), own.column("n_shared")],
                        names=["doc_id", *_COUNTS[:4], "n_best", "count_sum", "groups_sha256", "n_shared"])

    longs = ["doc_id", *_COUNTS[:4], "n_best", "count_sum"]
    schema = T.StructType([*(T.StructField(c, T.LongType()) for c in longs), T.StructField("groups_sha256", T.StringType()),
                           T.StructField("n_shared", T.LongType())])
    return texts.groupBy("block").cogroup(wanted.groupBy("of")).applyInArrow(run, schema)
