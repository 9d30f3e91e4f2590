"""Web archive (WARC 1.1) writer and reader over deterministic shards.

Pages are dealt by ranges of page_id (``shards.plan``) and written in
that order, one gzip member per record, with headers and digests made anew from
the payload.  A file is rolled once its compressed size reaches a limit.  A task
writes under a temporary name of its own attempt and reports it; the reports of
successful attempts form the manifest, and only then are files renamed to their
final names (which depend on the input alone; renaming again is harmless) and the
manifest committed.  Readers follow the committed manifest.

Records of equal payloads (SHA-1) of at least ``MIN_REVISIT`` bytes: the one with the
largest page_id is the response, the others are revisits that refer to it.  Repeated
rows of that page_id are responses too.  A page without an id is always a response and
never referred to; a null html is an empty payload, a null url leaves the header out.
Other columns are not written; an empty table makes no files.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rejoinder.llm.common import shared_folder
from rejoinder.llm.shards import open_folder, plan

MIN_REVISIT = 1000
#: Payload bytes of a shard, compressed bytes after which a file is rolled, bytes read at once.
SHARD_BYTES, ROLL_BYTES, READ = 32 << 20, 16 << 20, 1 << 20
#: Tasks that read archives, at most.
READERS = 4096
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, temporary string, records long, bytes long, sha1 string"
PAGE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def revisits(pages: DataFrame, *, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """(page_id, digest, refers_to) of the pages (page_id, digest, size) whose payload another page holds.

    Largest ids are pre-aggregated by digest, and only digests held twice are
    joined back; a digest of very many pages is one row on that side.  Payloads
    do not take part.
    """
    held = (pages.where(F.col("size") >= min_bytes).groupBy("digest")
                 .agg(F.max("page_id").alias("refers_to"), F.count("page_id").alias("n")).where("n > 1").drop("n"))
    return (pages.select("page_id", "digest").join(held, "digest").where(F.col("page_id") < F.col("refers_to"))
                 .select("page_id", "digest", "refers_to").distinct())


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page_id(urn: str) -> int | None:
    own = urn.strip("<>").rpartition(":")[2]
    return None if own == "null" else int(own)


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member; the same bytes for the same content."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers),
             f"WARC-Block-Digest: {_sha1(block)}", f"Content-Length: {len(block)}"]
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gz.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + gz.flush()


def page_record(page_id: int | None, url: str | None, size: int, sha1: bytes, payload: bytes | None = None,
                refers_to: int | None = None) -> bytes:
    """The response that holds ``payload``, or without one the revisit of ``refers_to``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    headers = [("WARC-Record-ID", _urn(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        headers.append(("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]")))
    headers += [("WARC-Payload-Digest", "sha1:" + base64.b32encode(sha1).decode()), ("Content-Type", "application/http; msgtype=response")]
    if payload is not None:
        return record("response", headers, http + payload)
    return record("revisit", [*headers, ("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(refers_to))], http)


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages`` (page_id, url, html) under ``folder``; returns the committed manifest."""
    spark = pages.sparkSession
    roll = ROLL_BYTES

    @F.arrow_udf(T.BinaryType())
    def response(page_id: pa.Array, url: pa.Array, html: pa.Array) -> pa.Array:
        rows = zip(*(c.to_pylist() for c in (page_id, url, html)), strict=True)
        return pa.array([page_record(p, u, len(b := (h or "").encode()), hashlib.sha1(b).digest(), b) for p, u, h in rows], pa.binary())

    # Responses are compressed where the pages are read, so the one exchange of payloads moves compressed
    # records.  What a page revisits comes in the same exchange, ahead of the page, and takes its place there.
    own = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"))
    counted = own.select("page_id", F.sha1("html").alias("digest"), F.octet_length("html").alias("size"))
    add, n = plan(counted, "page_id", F.col("size") + 512, SHARD_BYTES)
    records = own.select("page_id", F.sha1("html").alias("digest"), F.lit(None).cast("long").alias("refers_to"), "url",
                         F.octet_length("html").alias("size"), response("page_id", "url", "html").alias("record"))
    refers = revisits(counted).select("page_id", "digest", "refers_to", F.lit(None).cast("string").alias("url"),
                                      F.lit(0).alias("size"), F.lit(None).cast("binary").alias("record"))
    dealt = (add(records.unionByName(refers)).repartitionById(n, F.col("shard"))
             .sortWithinPartitions("page_id", F.col("refers_to").desc_nulls_last(), "digest", "url"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(f"{folder}/temporary")
        attempt = f"{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        out = None
        rolled = size = records = 0
        held: dict = {}                                 # of the page at hand: digest -> (page, what it refers to)

        def close() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"file": [name], "temporary": [f"{name}.{attempt}"], "records": [records],
                                               "bytes": [size], "sha1": [sha1.hexdigest()]})

        for batch in batches:
            for shard, page, digest, target, url, bytes_, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if target is not None:
                    held = {d: r for d, r in held.items() if r[0] == page} | {digest: (page, target)}
                    continue
                if held.get(digest, (None,))[0] == page and page is not None:
                    data = page_record(page, url, bytes_, bytes.fromhex(digest), refers_to=held[digest][1])
                if out is not None and size >= roll:
                    yield close()
                    out, rolled = None, rolled + 1
                if out is None:
                    name = f"pages-{shard:05d}-{rolled:05d}.warc.gz"
                    out = system.open_output_stream(f"{path}/{name}.{attempt}", buffer_size=1 << 20, compression=None)
                    info = record("warcinfo", [("WARC-Record-ID", f"<urn:file:{name}>"), ("WARC-Date", DATE),
                                               ("WARC-Filename", name), ("Content-Type", "application/warc-fields")],
                                  b"format: WARC File Format 1.1\r\n")
                    sha1, records, size = hashlib.sha1(info), 0, len(info)
                    out.write(info)
                out.write(data)
                sha1.update(data)
                size, records = size + len(data), records + 1
        if out is not None:
            yield close()

    dealt.select("shard", "page_id", "digest", "refers_to", "url", "size", "record").mapInArrow(put, MANIFEST).write.parquet(f"{folder}/reported")

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        for batch in batches:
            for row in batch.to_pylist():
                if system.get_file_info(f"{path}/{row['file']}").type.name == "NotFound":
                    system.move(f"{path}/temporary/{row['temporary']}", f"{path}/{row['file']}")
            yield batch

    reported = spark.read.schema(MANIFEST).parquet(f"{folder}/reported")
    reported.mapInArrow(rename, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def members(stream) -> Iterator[bytes]:
    """The decompressed gzip members of a file, one by one."""
    gz, parts, rest = zlib.decompressobj(31), [], b""
    while more := rest or stream.read(READ):
        parts.append(gz.decompress(more))
        rest = b""
        if gz.eof:
            yield b"".join(parts)
            gz, parts, rest = zlib.decompressobj(31), [], gz.unused_data
    if any(parts):
        raise ValueError("the file ends inside a record")


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of a record; its block digest is checked."""
    head, _, rest = member.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[:int(headers["Content-Length"])]
    if lines[0] != "WARC/1.1" or rest[len(block):] != b"\r\n\r\n" or headers["WARC-Block-Digest"] != _sha1(block):
        raise ValueError(f"damaged record {headers.get('WARC-Record-ID')}")
    return headers, block


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row per page record of the archives that the manifest lists, digests checked."""
    listed = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").select("file")

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        for name in (n for b in batches for n in b.column("file").to_pylist()):
            rows = []
            with system.open_input_stream(f"{path}/{name}", compression=None) as stream:
                for headers, block in map(parse, members(stream)):
                    if (kind := headers["WARC-Type"]) == "warcinfo":
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
                    digest = headers["WARC-Payload-Digest"]
                    if kind == "response" and (size != len(payload) or digest != _sha1(payload)):
                        raise ValueError(f"payload digest of {headers['WARC-Record-ID']} does not match")
                    refers = headers.get("WARC-Refers-To")
                    rows.append((_page_id(headers["WARC-Record-ID"]), size, base64.b32decode(digest[5:]).hex(), kind,
                                 None if refers is None else _page_id(refers)))
            for i in range(0, len(rows), 10_000):
                cols = list(zip(*rows[i:i + 10_000], strict=True))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)],
                                                 names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return listed.repartition(min(READERS, max(1, listed.count())), "file").mapInArrow(get, PAGE)


def write_and_read(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write ``pages`` to a fresh shared folder and return what its archives say."""
    folder = shared_folder(spark, "warc")
    write(pages, folder)
    return read(spark, folder)


ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS d FROM pages),
     k AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS kept FROM p)
SELECT page_id, CAST(b AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN b >= 1000 AND page_id < kept THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN b >= 1000 AND page_id < kept THEN kept END AS refers_to
FROM k
"""
