r"""Chat formatting that survives a grammar round trip.

A conversation is rendered as ``<s>`` and one marked piece per turn::

    [SYS] text [/SYS]    [INST] text [/INST]    [OUT] text</s>    [ROLE name] text [/ROLE]

A deterministic parser reads pieces back: inside a text any control string is an
error, and ``\\``, ``\<``, ``\[``, ``\]`` stand for the second character.  A turn is
rendered as it is, parsed, and compared with its source; if they differ its text (and
role name) is escaped, so that ``\ < [ ]`` all carry a backslash, and parsed again.
Escaped text always comes back, because no control string can start in it, and
ordinary text stays untouched.

The loss mask of a piece is the span of its assistant text.  Null texts and roles are
empty ones.  Turns are ordered by ``turn`` (nulls first), then by role and text; repeated rows
are turns of their own; rows without a conv_id form one conversation.  Other columns are dropped.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BEGIN = "<s>"
MARKS = {"system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": ("[OUT] ", "</s>")}
OTHER = ("[ROLE ", " [/ROLE]")
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[OUT]", "[ROLE", "[/ROLE]")
_TOKEN = re.compile(r"\\[\\<\[\]]|" + "|".join(map(re.escape, CONTROL)))
_OPEN = re.compile("|".join(re.escape(m[0]) for m in MARKS.values()) + r"|\[ROLE ((?:[^\\\]]|\\.)*)\] ", re.S)
_UNESCAPE = re.compile(r"\\([\\<\[\]])")
_ESCAPE = re.compile(r"([\\<\[\]])")
_ROLE = {m[0]: role for role, m in MARKS.items()}


class GrammarError(ValueError):
    pass


def parse_turn(piece: str, at: int = 0) -> tuple[str, str, int, int, int]:
    """(role, text, where its raw text starts and ends, where the next piece starts)."""
    opened = _OPEN.match(piece, at)
    if not opened:
        raise GrammarError("a turn's mark is expected")
    role = _ROLE.get(opened[0])
    close = MARKS[role][1] if role else OTHER[1]
    role = role or _UNESCAPE.sub(r"\1", opened[1])
    tag, lead = close.lstrip(), len(close) - len(close.lstrip())
    for token in _TOKEN.finditer(piece, opened.end()):
        if token[0][0] == "\\":
            continue
        end = token.start() - lead
        if token[0] != tag or end < opened.end() or piece[end:token.start()] != close[:lead]:
            raise GrammarError("a control string stands inside a text")
        return role, _UNESCAPE.sub(r"\1", piece[opened.end():end]), opened.end(), end, token.end()
    raise GrammarError("a turn has no end")


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """(piece, start and end of its raw text), escaped only where the round trip asks for it."""
    for escape in (lambda s: s, lambda s: _ESCAPE.sub(r"\\\1", s)):
        begin, end = MARKS.get(role) or (f"{OTHER[0]}{escape(role)}] ", OTHER[1])
        piece = f"{begin}{escape(text)}{end}"
        try:
            got = parse_turn(piece)
        except GrammarError:
            continue
        if got[:2] == (role, text) and got[4] == len(piece):
            return piece, got[2], got[3]
    raise AssertionError("escaped content comes back")


PIECE = T.StructType([T.StructField("piece", T.StringType()), T.StructField("text_start", T.IntegerType()),
                      T.StructField("text_end", T.IntegerType()), T.StructField("trained", T.BooleanType())])


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, piece, text_start, text_end, trained) of each row; spans in characters of the piece."""

    @F.arrow_udf(PIECE)
    def run(role: pa.Array, text: pa.Array) -> pa.Array:
        rows = [(*render_turn(r or "", t or ""), r == "assistant")
                for r, t in zip(role.to_pylist(), text.to_pylist(), strict=True)]
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], t) for k, t in
                                           enumerate((pa.string(), pa.int32(), pa.int32(), pa.bool_()))],
                                          ["piece", "text_start", "text_end", "trained"])

    return (turns.select("conv_id", "turn", "role", "text")
                 .withColumn("__r", run("role", "text")).select("conv_id", "turn", "role", "text", "__r.*"))


READ_BACK = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
             "formatted_chars long, formatted_sha256 string")


def read_back(rendered: DataFrame) -> DataFrame:
    """One row per conversation, read from its pieces alone.

    Pieces are dealt by conversation and stream through in order; a conversation
    of any length is held one turn at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, done = None, []

        def row():
            conv, n, turns, chars, loss, size, whole = state
            return {"conv_id": conv, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars,
                    "loss_sha256": loss.hexdigest(), "formatted_chars": size, "formatted_sha256": whole.hexdigest()}

        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                            ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
                            ("formatted_sha256", pa.string())])
        for batch in batches:
            for conv, piece, start, end, trained in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or state[0] != conv:
                    if state is not None:
                        done.append(row())
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), len(BEGIN), hashlib.sha256(BEGIN.encode())]
                role, text, _, _, stop = parse_turn(piece)
                if stop != len(piece):
                    raise GrammarError("a piece holds more than a turn")
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                if trained:
                    masked = _UNESCAPE.sub(r"\1", piece[start:end])
                    state[3] += len(masked)
                    state[4].update(masked.encode())
                state[5] += len(piece)
                state[6].update(piece.encode())
            if len(done) >= 1000:
                yield pa.RecordBatch.from_pylist(done, schema)
                done = []
        if state is not None:
            done.append(row())
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)

    return (rendered.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
                    .select("conv_id", "piece", "text_start", "text_end", "trained").mapInArrow(run, READ_BACK))


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
m AS (
  SELECT *, contains(text, '<s>') OR contains(text, '</s>') OR contains(text, '[INST]') OR contains(text, '[/INST]')
         OR contains(text, '[SYS]') OR contains(text, '[/SYS]') OR contains(text, '[OUT]') OR contains(text, '[ROLE')
         OR contains(text, '[/ROLE]') OR contains(text, '\\') OR contains(text, '\<') OR contains(text, '\[')
         OR contains(text, '\]') OR (ends_with(text, '\') AND role = 'assistant') AS clash,
         length(text) - length(replace(replace(replace(replace(text, '\', ''), '<', ''), '[', ''), ']', '')) AS marks
  FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(3 + sum(length(text) + CASE WHEN clash THEN marks ELSE 0 END
                    + CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 ELSE 10 END) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id
"""
