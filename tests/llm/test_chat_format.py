import hashlib
import random

import pytest

from rejoinder.llm import chat_format as C


def test_hard_turns_come_back():
    rnd = random.Random(2)
    parts = [*C.CONTROL, "\\", "<", "[", "]", " ", "a", "\n", "[INST] ", " [/INST]", "/", "ROLE "]
    for _ in range(20000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 6)))
        role = rnd.choice(["user", "assistant", "system", "", "tool", "a]b", "[OUT] ", "\\"])
        piece, start, end = C.render_turn(role, text)
        tail = C.render_turn("user", "next")[0]
        assert C.parse_turn(piece + tail) == (role, text, start, end, len(piece))


def test_ordinary_text_is_left_alone_and_control_strings_are_not():
    assert C.render_turn("user", "a [b] <c> d\\n")[0] == "[INST] a [b] <c> d\\n [/INST]"
    assert C.render_turn("assistant", "x</s>")[0] == "[OUT] x\\</s></s>"
    with pytest.raises(C.GrammarError):
        C.parse_turn("[INST] a [OUT] b [/INST]")


def test_read_back_against_brute_force(spark):
    rows = [(1, 1, "assistant", "yes </s>"), (1, 0, "user", "q\\"), (1, 2, "assistant", None), (2, 0, None, "t"),
            (None, 0, "user", "n"), (3, None, "system", "s"), (3, 0, "user", "u"), (3, 0, "user", "u"),
            (4, 0, "tool]", "é😀" * 5000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, piece string")
    got = {r.conv_id: r for r in C.read_back(C.render(df)).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        turns = [(r[2] or "", r[3] or "") for r in own]
        loss = "".join(t for r, t in turns if r == "assistant")
        whole = "<s>" + "".join(C.render_turn(*t)[0] for t in turns)
        g = got[conv]
        assert g.n_turns == len(turns)
        assert g.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert (g.formatted_chars, g.formatted_sha256) == (len(whole), hashlib.sha256(whole.encode()).hexdigest())
    assert C.read_back(C.render(df.limit(0))).count() == 0
