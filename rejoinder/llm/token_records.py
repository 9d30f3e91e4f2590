"""Token ids as length-delimited binary records with masked checksums and an offset index.

A data file is a run of frames ``u64 length | u32 masked CRC-32C of the length |
payload | u32 masked CRC-32C of the payload`` (little-endian, the framing that
record readers of common training frameworks expect).  A payload is the
document's id (i64; the smallest i64 stands for null) and its token ids, u16
where the vocabulary fits, else u32.  Beside each data file an index file holds
``i64 doc_id | u64 offset | u64 length`` per record, so that readers can visit
records in any order.

Documents are dealt by ranges of doc_id (``shards.by_key_range``), so file order
and order inside a file are ascending in doc_id, rows of one id in the order of a hash of their text.  A task
writes under a name of its own attempt; only files that the manifest lists, made
from successful attempts, count.  A null text is an empty one: its record holds
the end id alone.  Other columns are not written.  No documents: no files.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rejoinder.llm.common import shared_folder, worker_state
from rejoinder.llm.shards import by_key_range, open_folder

#: Bytes of text for a shard (one data file), characters handled at once, bytes read at once.
SHARD_BYTES, CHUNK, READ = 32 << 20, 1 << 20, 4 << 20
#: Entries of a worker's cache of encoded words, and the longest word kept in it.  A full cache takes no more, and is
#: started anew when it knows fewer than half of the words.
CACHE_WORDS, CACHE_LEN = 1_000_000, 48
NULL_ID = -(1 << 63)
#: The reversed CRC-32C polynomial and the mask constant of the record format.
POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8
BLOCK = 32


# --- checksums ---------------------------------------------------------------

def _tables() -> np.ndarray:
    """[k][b]: the raw checksum of byte b followed by k zero bytes."""
    first = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        first = np.where(first & 1, first >> 1 ^ POLYNOMIAL, first >> 1).astype(np.uint32)
    out = [first]
    for _ in range(BLOCK - 1):
        out.append(out[-1] >> 8 ^ first[out[-1] & 255])
    return np.array(out, np.uint32)


TABLES = _tables()


def masked_crc32c(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Masked CRC-32C of many byte strings of at least 4 bytes at once.

    The checksum is linear: flipping the first four bytes stands for the initial
    value, zero bytes in front change nothing.  So every string is padded in
    front to whole blocks, all blocks are looked up together, and the blocks of
    all strings are folded side by side.
    """
    blocks = -(-lengths // BLOCK)
    order = np.argsort(-blocks, kind="stable")
    base = (np.cumsum(blocks) - blocks).astype(np.int64)
    padded = np.zeros(int(blocks.sum()) * BLOCK, np.uint8)
    into = (base + blocks) * BLOCK - lengths
    for a, b, n in zip(starts.tolist(), into.tolist(), lengths.tolist(), strict=True):
        padded[b:b + n] = data[a:a + n]
    for k in range(4):
        padded[into + k] ^= 255
    grid = padded.reshape(-1, BLOCK)
    raw = np.zeros(len(grid), np.uint32)
    for j in range(BLOCK):
        raw ^= TABLES[BLOCK - 1 - j][grid[:, j]]
    crc, at, left = np.zeros(len(lengths), np.uint32), base[order], blocks[order]
    active = len(left)
    for t in range(int(left[0]) if active else 0):
        while left[active - 1] <= t:
            active -= 1
        c = crc[:active]
        crc[:active] = (raw[at[:active] + t] ^ TABLES[BLOCK - 1][c & 255] ^ TABLES[BLOCK - 2][c >> 8 & 255]
                        ^ TABLES[BLOCK - 3][c >> 16 & 255] ^ TABLES[BLOCK - 4][c >> 24])
    crc = ~crc
    out = np.empty_like(crc)
    out[order] = (crc >> 15 | crc << 17) + np.uint32(MASK)
    return out


# --- encoding ----------------------------------------------------------------

#: A space that white space both precedes and follows.
_NO_CUT = regex.compile(r"\s (?:\s|$)")


class WordEncoder:
    """The tokenizers library's ids of whole texts, through a cache of words.

    A byte-level tokenizer with the usual pattern never joins a space to what
    stands before it, so a text may be cut before every space that white space
    does not both precede and follow; each part is encoded by the library once.
    Texts that hold such a space or an added token, and tokenizers of another make, are encoded whole.
    ``special_as_text``: strings of special tokens are ordinary text (by default they become their ids, as in the library).
    """

    def __init__(self, config: str, *, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(config)
        self.tokenizer.encode_special_tokens = special_as_text
        own = json.loads(config)
        self.added = [t["content"] for t in own.get("added_tokens") or [] if not (special_as_text and t.get("special"))]
        pre = own.get("pre_tokenizer") or {}
        self.by_word = (own.get("normalizer") is None and pre.get("type") == "ByteLevel"
                        and not pre.get("add_prefix_space") and pre.get("use_regex", True))
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.cache: dict[str, bytes] = {}

    def library(self, parts: list[str]) -> list[bytes]:
        return [array(self.dtype.char, e.ids).tobytes()
                for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        group: list[str] = []
        size = 0
        for text in texts:
            if group and size + len(text) > CHUNK:
                yield from self._encode(group)
                group, size = [], 0
            group.append(text)
            size += len(text)
        yield from self._encode(group)

    def _encode(self, texts: list[str]) -> Iterator[bytes]:
        if not self.by_word:
            yield from self.library(texts)
            return
        split = [text.split(" ") for text in texts]
        words = set().union(*split)
        odd = {w for w in words if not w or w[0].isspace()}     # a space before them may not be a cut
        if odd:
            split = [parts if odd.isdisjoint(parts) or not _NO_CUT.search(text) else [text]
                     for text, parts in zip(texts, split, strict=True)]
        whole = [i for i, text in enumerate(texts) if any(t in text for t in self.added)]
        for i in whole:
            split[i] = [texts[i]]
        firsts = self.library([parts[0] for parts in split])
        for parts in split:
            del parts[0]
        needed = set().union(*split) if odd or whole else words
        cache = self.cache
        new = list(needed.difference(cache))
        if len(cache) > CACHE_WORDS and 2 * len(new) > len(needed):     # of other texts: started anew
            cache.clear()
            new = list(needed)
        full, own = len(cache) > CACHE_WORDS, {}
        for w, ids in zip(new, self.library([" " + w for w in new]), strict=True):
            (cache if len(w) <= CACHE_LEN and not full else own)[w] = ids
        get = cache.get
        for first, parts in zip(firsts, split, strict=True):
            coded = list(map(get, parts))
            if own and None in coded:
                coded = [own[w] if c is None else c for c, w in zip(coded, parts, strict=True)]
            yield first + b"".join(coded)


def _encoder(config: str) -> WordEncoder:
    return worker_state("word_encoder_" + hashlib.sha1(config.encode()).hexdigest(), lambda: WordEncoder(config))


# --- files -------------------------------------------------------------------

MANIFEST = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("file", T.StringType()),
                         T.StructField("records", T.LongType()), T.StructField("ids", T.LongType()),
                         T.StructField("width", T.IntegerType())])


def frames(payloads: list[bytes]) -> list[bytes]:
    """The payloads, framed."""
    lengths = np.array([len(p) for p in payloads], np.int64)
    heads = lengths.astype("<u8").tobytes()
    data = np.frombuffer(b"".join(payloads), np.uint8)
    of_data = masked_crc32c(data, np.cumsum(lengths) - lengths, lengths).astype("<u4").tobytes()
    of_head = masked_crc32c(np.frombuffer(heads, np.uint8), np.arange(len(lengths)) * 8,
                            np.full(len(lengths), 8)).astype("<u4").tobytes()
    return [heads[8 * i:8 * i + 8] + of_head[4 * i:4 * i + 4] + p + of_data[4 * i:4 * i + 4]
            for i, p in enumerate(payloads)]


def write(df: DataFrame, tokenizer_path: str, folder: str, *, id_col: str = "doc_id", text_col: str = "text",
          end_id: int = 0) -> list:
    """Write the records of ``df`` under ``folder``; returns the manifest (at most twice ``shards.GRID`` rows), in order."""
    with open(tokenizer_path, encoding="utf-8") as f:
        config = f.read()
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = by_key_range(docs, "doc_id", F.octet_length("text") + 64, SHARD_BYTES, F.xxhash64("text"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(config)
        end = np.array([end_id], encoder.dtype).tobytes()
        system, path = open_folder(folder)
        data = index = None
        offset = records = ids = 0
        for batch in batches:
            if data is None:
                shard = batch.column("shard")[0].as_py()
                name = f"shard-{shard:05d}-{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex[:8]}"
                data = system.open_output_stream(f"{path}/{name}.rec", buffer_size=1 << 20)
                index = system.open_output_stream(f"{path}/{name}.idx", buffer_size=1 << 18)
            keys = [NULL_ID if k is None else k for k in batch.column("doc_id").to_pylist()]
            own: list[bytes] = []
            held, first = 0, 0
            for i, coded in enumerate(encoder.encode(batch.column("text").to_pylist())):
                own.append(struct.pack("<q", keys[i]) + coded + end)
                ids += (len(own[-1]) - 8) // encoder.dtype.itemsize
                held += len(own[-1])
                if held > READ or i + 1 == len(keys):
                    for key, frame in zip(keys[first:i + 1], frames(own), strict=True):
                        data.write(frame)
                        index.write(struct.pack("<qQQ", key, offset, len(frame)))
                        offset += len(frame)
                    records += len(own)
                    own, held, first = [], 0, i + 1
        if data is not None:
            data.close()
            index.close()
            yield pa.RecordBatch.from_pylist([{"shard": shard, "file": f"{name}.rec", "records": records, "ids": ids,
                                               "width": encoder.dtype.itemsize}],
                                             pa.schema([("shard", pa.int32()), ("file", pa.string()),
                                                        ("records", pa.int64()), ("ids", pa.int64()), ("width", pa.int32())]))

    return sorted(dealt.select("shard", "doc_id", "text").mapInArrow(put, MANIFEST).collect())


def scan(stream) -> Iterator[tuple[list[bytes], int]]:
    """Payloads of a data file, checked, a few MB at a time."""
    rest = b""
    while True:
        more = stream.read(READ)
        buffer, at, found = rest + more, 0, []
        while len(buffer) - at >= 12:
            n = struct.unpack_from("<Q", buffer, at)[0]
            if len(buffer) - at < n + 16:
                break
            found.append((at, n))
            at += n + 16
        if found:
            data = np.frombuffer(buffer, np.uint8)
            begin, n = (np.array(x, np.int64) for x in zip(*found, strict=True))
            for start, length in ((begin, np.full(len(begin), 8)), (begin + 12, n)):
                stored = data[(start + length)[:, None] + np.arange(4)].copy().view("<u4")[:, 0]
                if (stored != masked_crc32c(data, start, length)).any():
                    raise ValueError("a record's checksum does not match")
            yield [buffer[a + 12:a + 12 + m] for a, m in found]
        rest = buffer[at:]
        if not more:
            if rest:
                raise ValueError("the file ends inside a record")
            return


RECORD = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()),
                       T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])


def read_digests(spark: SparkSession, folder: str, manifest: list) -> DataFrame:
    """One row per record read back from the files: place, count and checksum of its ids."""
    starts = np.cumsum([0] + [m["ids"] for m in manifest]).tolist()
    files = spark.createDataFrame([(i, m["file"], s, m["width"]) for i, (m, s) in
                                   enumerate(zip(manifest, starts, strict=False))],
                                  "at int, file string, start long, width int")

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        for row in (r for b in batches for r in b.to_pylist()):
            start = row["start"]
            with system.open_input_stream(f"{path}/{row['file']}") as stream:
                for payloads in scan(stream):
                    out = []
                    for p in payloads:
                        ids = np.frombuffer(p, f"<u{row['width']}", offset=8)
                        key = struct.unpack_from("<q", p)[0]
                        out.append((None if key == NULL_ID else key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)],
                                                     names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.repartitionById(max(1, len(manifest)), F.col("at")).mapInArrow(get, RECORD)


def read_shuffled(spark: SparkSession, folder: str, manifest: list, seed: int) -> DataFrame:
    """(doc_id, ids) in a seeded random order: index entries are shuffled, then records fetched by offset."""
    files = spark.createDataFrame([(m["file"], m["width"]) for m in manifest], "file string, width int")

    def entries(batches):
        system, path = open_folder(folder)
        for row in (r for b in batches for r in b.to_pylist()):
            with system.open_input_stream(f"{path}/{row['file'][:-4]}.idx") as f:
                flat = np.frombuffer(f.read(), "<i8").reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([pa.array([row["file"]] * len(flat)), pa.array([row["width"]] * len(flat), pa.int32()),
                                              pa.array(flat[:, 1]), pa.array(flat[:, 2])], names=["file", "width", "offset", "length"])

    def fetch(batches):
        system, path = open_folder(folder)
        opened: dict = {}
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["file"] not in opened:
                    if len(opened) > 64:
                        opened.popitem()[1].close()
                    opened[row["file"]] = system.open_input_file(f"{path}/{row['file']}")
                f = opened[row["file"]]
                f.seek(row["offset"])
                (payload,) = next(scan(pa.BufferReader(f.read(row["length"]))))
                key = struct.unpack_from("<q", payload)[0]
                out.append({"doc_id": None if key == NULL_ID else key,
                            "ids": np.frombuffer(payload, f"<u{row['width']}", offset=8).astype(np.int64)})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))]))

    listed = files.mapInArrow(entries, "file string, width int, offset long, length long")
    return (listed.withColumn("__o", F.xxhash64(F.lit(seed), "file", "offset")).repartition("__o")
                  .sortWithinPartitions("__o").drop("__o").mapInArrow(fetch, "doc_id long, ids array<long>"))


def write_and_read(spark: SparkSession, df: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write ``df`` to a fresh shared folder and return the digests read back from its files."""
    folder = shared_folder(spark, "token-records")
    return read_digests(spark, folder, write(df, tokenizer_path, folder))
