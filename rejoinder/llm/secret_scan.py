r"""Secrets in texts: patterns, and structures confirmed by decoding them.

Three kinds come from patterns alone and are always reported, leftmost and without overlap within a kind:

* ``assign``: a name like password or token, an assignment mark, and a value of at least six characters;
* ``access``: ``AKIA`` and capitals or digits, twenty characters or more;
* ``hex``: lower-case hexadecimal digits, twenty-four or more.

Two kinds are reported only after their content was decoded and parsed:

* ``key``: base64 (one line in either alphabet, or lines as in key files, with real or escaped line ends) or
  hex that holds a private key: a DER sequence laid out as PKCS#1, PKCS#8 (plain or encrypted), SEC1 or DSA,
  whose nested lengths fill it exactly, or the length-prefixed fields of an OpenSSH key.  The outer length tells
  how many characters belong to it; the first bytes are checked before the rest is read.  Base64 of
  the text of a key file counts as well (it is decoded and searched in turn).
* ``signed``: a compact signed token: two base64url JSON objects, the first naming an algorithm other than
  "none", and a signature.

A span is (kind, start, end) of the whole match in code points, end exclusive (for ``assign``: name, mark and value;
for ``key``: the encoded characters with their padding).  Spans are ordered by start, then kind as listed
above, then end; a text that several kinds match gets a span of each.  Null texts are empty ones; empty texts have
no spans; texts are read whole.  Rows are independent: repeated rows and ids give repeated results.  Other columns pass
through, an existing column with the output's name is replaced.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The patterns of the three base kinds, and the least lengths of what they match.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"        # of greedy runs only length decides, so it may stand in the pattern
ASSIGN_VALUE = 6
KINDS = ("assign", "access", "hex", "key", "signed")
BASE_KINDS = KINDS[:3]
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                                  T.StructField("end", T.LongType())]))

_ASSIGN, _ACCESS, _HEX = re.compile(ASSIGN, re.A | re.I), re.compile(ACCESS), re.compile(HEX)
#: Where an encoded structure may begin: a DER sequence, the magic of an OpenSSH key, the armour of a key file.
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])(?:M[A-P][A-Za-z0-9+/_-]{14}|b3BlbnNzaC1rZXktdjE|LS0tLS1CRUdJTi)")
_HEXED = re.compile(r"(?<![0-9A-Fa-f])(?:30[0-9A-Fa-f]{22,}|6[Ff]70656[Ee]7373682[Dd]6[Bb]65792[Dd]7631[0-9A-Fa-f]+)(?![0-9A-Fa-f])")
_SIGNED = re.compile(r"(?<![A-Za-z0-9_.-])(e[w-z][A-Za-z0-9_-]+)\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]{2,})(?![A-Za-z0-9_.-])")
_LINE, _URL_LINE, _BREAK, _PAD = (re.compile(x) for x in (
    r"[A-Za-z0-9+/]+", r"[A-Za-z0-9_-]+", r"(?:(?:\\[rn]|[\r\n])[ \t]*)+", r"={1,2}"))
_MAGIC = b"openssh-key-v1\0"
#: Texts inside texts are searched to this depth (a key file, its base64, and once more).
DEPTH = 3


# --- structures ----------------------------------------------------------------

def _element(b: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start and end of the content) of the DER element at ``at``, if its length is well-formed and fits."""
    if end - at < 2:
        return None
    tag, n, at = b[at], b[at + 1], at + 2
    if n & 0x80:
        size = n & 0x7F
        if not 1 <= size <= 4 or end - at < size:
            return None
        n, first, at = int.from_bytes(b[at:at + size], "big"), b[at], at + size
        if not first or n < 0x80:                       # DER lengths are as short as can be
            return None
    return (tag, at, at + n) if at + n <= end else None


def _inside(b: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill b[start:end] exactly."""
    out = []
    while start < end:
        found = _element(b, start, end)
        if found is None:
            return None
        out.append(found)
        start = found[2]
    return out


def _small(b: bytes, element: tuple[int, int, int]) -> int:
    """The value of a one-byte integer, else -1."""
    tag, s, e = element
    return b[s] if tag == 0x02 and e - s == 1 else -1


def _algorithm(b: bytes, element: tuple[int, int, int]) -> bool:
    """A sequence that begins with an object identifier, and whose elements fill it."""
    parts = _inside(b, *element[1:]) if element[0] == 0x30 else None
    return bool(parts) and parts[0][0] == 0x06 and parts[0][2] > parts[0][1]


def is_private_key(b: bytes) -> bool:
    """A DER private key whose nested lengths fill ``b`` exactly."""
    top = _element(b, 0, len(b))
    if top is None or top[0] != 0x30 or top[2] != len(b):
        return False
    parts = _inside(b, top[1], top[2])
    if not parts or len(parts) < 2:
        return False
    tags, version = [p[0] for p in parts], _small(b, parts[0])
    if version in (0, 1) and len(parts) >= 3 and tags[1] == 0x30 and tags[2] == 0x04:              # PKCS#8
        return _algorithm(b, parts[1]) and set(tags[3:]) <= {0xA0, 0xA1, 0x81}
    if version in (0, 1) and len(parts) >= 9 and set(tags[:9]) == {0x02}:                          # PKCS#1
        return len(parts) == 9 or version == 1 and tags[9:] == [0x30]
    if version == 0 and tags == [0x02] * 6:                                                        # DSA
        return True
    if version == 1 and tags[1] == 0x04 and set(tags[2:]) <= {0xA0, 0xA1}:                         # SEC1
        return parts[1][2] - parts[1][1] >= 16
    return len(parts) == 2 and tags[1] == 0x04 and parts[1][2] > parts[1][1] and _algorithm(b, parts[0])   # encrypted PKCS#8


def is_openssh_key(b: bytes) -> bool:
    """The magic, cipher, derivation and options, the count of keys, as many public keys, one private block: no byte left."""
    if not b.startswith(_MAGIC):
        return False
    at, fields, wanted = len(_MAGIC), 0, 3
    while fields < wanted:
        if len(b) - at < 4:
            return False
        n = struct.unpack_from(">I", b, at)[0]
        at += 4 + n
        fields += 1
        if fields == 3 and wanted == 3:
            if len(b) - at < 4:
                return False
            keys = struct.unpack_from(">I", b, at)[0]
            at, wanted = at + 4, 3 + keys + 1
            if not keys or keys > len(b):
                return False
    return at == len(b) and n > 0 and n % 8 == 0


def _may_be_key(head: bytes) -> bool:
    """Whether the first bytes of a DER sequence may begin a private key: a version, or an algorithm's sequence."""
    if len(head) < 8 or head[0] != 0x30:
        return False
    at = 2 + (head[1] & 0x7F if head[1] & 0x80 else 0)
    inner = head[at:]
    return inner[:2] == b"\x02\x01" and inner[2:3] in (b"\0", b"\1") or inner[:1] == b"\x30"


# --- candidates ----------------------------------------------------------------

def _plain(characters: str) -> bytes:
    """Bytes of base64 characters of either alphabet, without padding; none if they are no base64."""
    try:
        return base64.b64decode(characters.replace("-", "+").replace("_", "/") + "=" * (-len(characters) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def _read(text: str, start: int, need: int | None) -> tuple[str, int]:
    """Base64 characters from ``start`` on: ``need`` of them (or all there are), over line ends; and where they end."""
    line = _URL_LINE.match(text, start)                 # the URL alphabet stands in one line
    if line and (need is not None and line.end() - start == need):
        return line.group(), line.end()
    parts, held, at = [], 0, start
    while need is None or held < need:
        line = _LINE.match(text, at)
        if not line:
            break
        parts.append(line.group())
        held, end = held + len(parts[-1]), line.end()
        if need is None or held < need:
            gap = _BREAK.match(text, end)
            if not gap:
                break
            at = gap.end()
    return ("".join(parts), end) if parts else ("", start)


def _base64_key(text: str, start: int, depth: int) -> int | None:
    """Where the key encoded at ``start`` ends, padding included; none if it is no key."""
    if text[start] == "M":
        head = _plain(text[start:start + 16])
        if not _may_be_key(head):
            return None
        size = head[1] & 0x7F if head[1] & 0x80 else 0
        total = 2 + size + (int.from_bytes(head[2:2 + size], "big") if size else head[1])
        need = -(-total * 8 // 6)
        characters, end = _read(text, start, need)
        good = len(characters) == need and is_private_key(_plain(characters))
    else:
        characters, end = _read(text, start, None)
        content = _plain(characters)
        if text[start] == "b":
            good = is_openssh_key(content)
        else:
            good = depth < DEPTH and any(True for _ in _keys(content.decode("utf-8", "replace"), depth + 1))
    if not good:
        return None
    pad = _PAD.match(text, end)
    return pad.end() if pad and pad.end() - pad.start() == -len(characters) % 4 else end


def _keys(text: str, depth: int = 0):
    at = 0
    while m := _BASE64.search(text, at):
        end = _base64_key(text, m.start(), depth)
        if end is None:
            at = m.start() + 1
        else:
            yield m.start(), end
            at = end
    for m in _HEXED.finditer(text):
        run = m.group()
        if len(run) % 2 == 0 and (run[:2] != "30" or _may_be_key(bytes.fromhex(run[:24]))):
            content = bytes.fromhex(run)
            if is_private_key(content) or is_openssh_key(content):
                yield m.span()


def _object(segment: str) -> dict:
    try:
        value = json.loads(_plain(segment))
    except (ValueError, RecursionError):
        return {}
    return value if isinstance(value, dict) else {}


def _is_signed(header: str, payload: str, signature: str) -> bool:
    algorithm = _object(header).get("alg")
    return isinstance(algorithm, str) and algorithm.lower() not in ("", "none") and bool(_object(payload)) and len(_plain(signature)) > 0


def spans(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text, in order."""
    out = []
    low = text.lower()
    if any(w in low for w in ("password", "passwd", "secret", "token", "api")):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end() - m.start(2) >= ASSIGN_VALUE]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    out += [("key", *found) for found in sorted(_keys(text))]
    out += [("signed", *m.span()) for m in _SIGNED.finditer(text) if _is_signed(*m.groups())]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# --- Spark ---------------------------------------------------------------------

def scan(df: DataFrame, *, text_col: str = "text", out_col: str = "secrets") -> DataFrame:
    """``df`` with an array of (kind, start, end) for each text."""

    @F.arrow_udf(SPANS)
    def run(texts: pa.Array) -> pa.Array:
        found = [spans(t) if t else [] for t in texts.to_pylist()]
        flat = [s for row in found for s in row]
        ends = [0]
        for row in found:
            ends.append(ends[-1] + len(row))
        values = pa.StructArray.from_arrays([pa.array([s[0] for s in flat], pa.string()), pa.array([s[1] for s in flat], pa.int64()),
                                             pa.array([s[2] for s in flat], pa.int64())], ["kind", "start", "end"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)

    return df.withColumn(out_col, run(F.col(text_col)))


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_kinds(*kinds: str) -> Column:
    return F.filter("found", lambda s: s["kind"].isin(*kinds))


def digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, counts of the base kinds, digest of their spans, all spans as text, and n_confirmed."""
    found = scan(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), out_col="found").select("doc_id", "found")
    base = _of_kinds(*BASE_KINDS)
    counts = [F.size(_of_kinds(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"),
                        (F.size("found") - F.size(base)).cast("long").alias("n_confirmed"))
